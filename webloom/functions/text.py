"""Text functions as column builders. All of them stay inside the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that results depend on: the default e-mail pattern, the address pattern, word separators,
# character alphabet, small words, French months, characters no heading holds, the duration pattern.
EMAIL_PATTERN = (
    r"([a-z0-9!#$%&'*+\/=?^_{|}~-]+(?:\.[a-z0-9!#$%&'*+\/=?^_{|}~-]+)*(@|\sat\s)"
    r"(?:[a-z0-9](?:[a-z0-9-]*[a-z0-9])?(\.|\sdot\s))+[a-z0-9](?:[a-z0-9-]*[a-z0-9])?)"
)
WORD_SEPARATORS = "\n\t\f\r ,.;:`'!?)(-|><^·&\"\\/{}#$–=+"
ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789,;.!?:'\"/\\|_@#$%^&*~`+-=<>()[]{}"
SMALL_WORDS = ("a", "an", "and", "at", "but", "by", "for", "in", "nor", "of", "on", "or", "so", "the", "to", "up", "yet")
MONTHS_FR = ("janvier", "février", "mars", "avril", "mai", "juin", "juillet", "août",
             "septembre", "octobre", "novembre", "décembre")
HEADING_FORBIDDEN = ",.;:!?+*/=()[]{}_^°&§~%#@<\">\\"
ADDRESS_PATTERN = r"^([a-zA-Z0-9._%+-]+)@((\w+)\.(\w+))$"
DURATION_PATTERN = r"([0-9])h ([0-6][0-9])min"

SPACE = r"[ \t\n\x0B\f\r]"


def char_class(characters: str) -> str:
    """A regex class body that holds exactly ``characters``."""
    return "".join("\\" + c if c in r"\]^[-&" else c for c in characters)


def empty_to_null(col: Column) -> Column:
    return F.nullif(col, F.lit(""))


def regex_match(col: Column, pattern: str) -> Column:
    """Group 1 when it matched something, else the whole match, else empty."""
    whole = F.regexp_extract(col, pattern, 0)
    if re.compile(pattern).groups == 0:
        return whole
    return F.coalesce(empty_to_null(F.regexp_extract(col, pattern, 1)), whole)


def sed_parts(step: str) -> tuple[str, str, bool] | None:
    """(pattern, replacement, all) of ``s<d>a<d>b<d>[g]``; None when the step is no such rule."""
    if not step.startswith("s") or len(step) < 5:
        return None
    parts = step.split(step[1])
    if len(parts) != 4 or not parts[1] or parts[3] not in ("", "g"):
        return None
    return parts[1], parts[2], parts[3] == "g"


def sed_replace(col: Column, step: str) -> Column:
    """Replace the first or every match; ``$N`` in the replacement is plain text."""
    parts = sed_parts(step)
    if parts is None:
        raise ValueError(f"not a replace rule: {step}")
    pattern, replacement, every = parts
    plain = replacement.replace("\\", "\\\\").replace("$", "\\$")
    if every:
        return F.regexp_replace(col, F.lit(pattern), F.lit(plain))
    return F.regexp_replace(col, F.lit(f"(?s)\\A(.*?)(?:{pattern})"), F.lit("$1" + plain))


def collapse_spaces(col: Column) -> Column:
    return F.trim(F.regexp_replace(col, SPACE + "+", " "))


def prepend(col: Column, text: str) -> Column:
    return collapse_spaces(F.concat(F.lit(text), col))


def append(col: Column, text: str) -> Column:
    return collapse_spaces(F.concat(col, F.lit(text)))


def sanitize_text(col: Column) -> Column:
    dots = F.replace(col, F.lit(" ..."), F.lit("..."))
    return F.trim(F.translate(dots, "\n\t", "  "))


def strip_tags(col: Column) -> Column:
    """Text between tags, each piece preceded by one space; scripts, styles and comments vanish."""
    bare = F.regexp_replace(col, r"(?is)<script\b[^>]*>.*?</script>|<style\b[^>]*>.*?</style>|<!--.*?-->", "")
    return F.regexp_replace(F.regexp_replace(bare, r"<[^>]*>", "\u0001"), "\u0001+", " ")


def abbrev(col: Column, size: int) -> Column:
    """Keep both ends and put ``..`` in the middle."""
    half = size // 2 - 1
    return F.when(F.length(col) <= size, col).otherwise(
        F.concat(F.left(col, F.lit(half)), F.lit(".."), F.right(col, F.lit(half))))


def left_abbrev(col: Column, size: int) -> Column:
    return F.when(F.length(col) <= size, col).otherwise(F.concat(F.lit(".."), F.right(col, F.lit(size - 2))))


def trim_space(col: Column) -> Column:
    """Collapse whitespace runs: to a space when the run starts with one, else to a dot."""
    ends = F.regexp_replace(col, rf"\A{SPACE}+|{SPACE}+\z", "")
    marked = F.regexp_replace(ends, rf" {SPACE}*", "\u0001")
    return F.translate(F.regexp_replace(marked, rf"{SPACE}[\t\n\x0B\f\r\u0001]*", "."), "\u0001", " ")


def trim_path(col: Column) -> Column:
    """Replace the folders of a leading absolute path by ``..``, keeping its last name."""
    return F.regexp_replace(col, r"\A(?:/[^/\s]*(?=/[\s\S]))*(/[\s\S]*)\z", "..$1")


def indent_len(col: Column) -> Column:
    return F.length(F.regexp_extract(col, r"\A[ \t]*", 0))


def is_blank(col: Column) -> Column:
    return (col == "") | (col == "\n")


def heading(col: Column) -> Column:
    """The trimmed line when it reads like a section title, else empty."""
    line = F.regexp_replace(col, rf"\A{SPACE}+|{SPACE}+\z", "")
    title_like = (
        line.rlike(r"\A\p{Lu}")
        & line.rlike(r"[\p{L}\p{Nd}]\z")
        & ~line.rlike(f"[{char_class(HEADING_FORBIDDEN)}]")
        & ~F.regexp_replace(line, r"'s( |\z)", "$1").contains("'")
    )
    return F.when(title_like, line).otherwise(F.lit(""))


def common_prefix(a: Column, b: Column) -> Column:
    """Longest shared beginning of two texts."""
    same = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x.eqNullSafe(y))
    first_other = F.array_position(same, False)
    return F.when(first_other == 0, a).otherwise(F.substring(a, F.lit(1), first_other.cast("int") - 1))


def unindent(lines: Column) -> Column:
    """Remove the shared indent of an array of lines; blank lines stay as they are."""
    shared = F.array_min(F.transform(F.filter(lines, lambda x: ~is_blank(x)), indent_len))
    return F.transform(lines, lambda x: F.when(is_blank(x), x).otherwise(F.substring(x, shared + 1, F.length(x))))


def parse_short_number(col: Column) -> Column:
    """``1.2k`` and ``3m`` as whole numbers; unreadable text counts as 0."""
    scale = F.when(col.endswith("m"), 1e6).when(col.endswith("k"), 1e3).otherwise(1.0)
    return (scale * F.coalesce(F.regexp_replace(col, "[mk]$", "").try_cast("double"), F.lit(0.0))).cast("bigint")


def format_bytes(col: Column) -> Column:
    """Size with the largest fitting unit and at most one decimal."""
    kilo = 1024.0

    def shown(value: Column, unit: str) -> Column:
        return F.concat(F.regexp_replace(F.format_string("%.1f", F.bround(value, F.lit(1))), r"\.0$", ""), F.lit(unit))

    return (
        F.when(col >= kilo**3, shown(col / F.lit(kilo**3), "G"))
        .when(col >= kilo**2, shown(col / F.lit(kilo**2), "M"))
        .when(col >= kilo, shown(col / F.lit(kilo), "K"))
        .when(col >= 1, shown(col.cast("double"), "B"))
        .when(col == 0, F.lit("0"))
        .otherwise(shown(col.cast("double"), ""))
    )


def to_int(col: Column, bits: int = 32) -> Column:
    """Whole number of a text; 0 when it is none, the nearest bound when it is too large."""
    number = F.when(col.rlike(r"\A[+-]?[0-9]+\z"), col)
    kind = "int" if bits == 32 else "bigint"
    top = 2 ** (bits - 1) - 1
    clipped = F.when(number.startswith("-"), F.lit(-top - 1)).otherwise(F.lit(top)).cast(kind)
    return F.when(number.isNull(), F.lit(0).cast(kind)).otherwise(F.coalesce(number.try_cast(kind), clipped))


def lower_ascii(col: Column) -> Column:
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokenize_words(col: Column, min_length: int = 5, separators: str = WORD_SEPARATORS) -> Column:
    """Lower-cased words between separator characters, short ones dropped."""
    return F.filter(F.split(lower_ascii(col), f"[{char_class(separators)}]+"), lambda w: F.length(w) >= min_length)


def tokenize_alnum(col: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(col), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def char_sequence(col: Column, size: int = 60, alphabet: str = ALPHABET, reverse: bool = False) -> Column:
    """Alphabet positions (1-based, 0 = space or padding) of the first ``size`` characters.

    A run of characters outside the alphabet counts as one space.
    """
    text = lower_ascii(col)
    if reverse:
        text = F.reverse(text)
    joined = F.regexp_replace(text, r"[\n\t\f\r]+", "")
    known = F.substring(F.regexp_replace(joined, f"[^{char_class(alphabet)}]+", " "), 1, size)
    padded = F.rpad(known, size, " ")
    return F.transform(F.split(padded, ""), lambda c: F.instr(F.lit(alphabet), c))


def readability(col: Column) -> tuple[Column, Column]:
    """Flesch-Kincaid grade and SMOG grade from sentence, word and syllable counts."""
    sentences = F.greatest(F.regexp_count(col, F.lit(r"[.!?]+")), F.lit(1)).cast("double")
    words = F.greatest(F.regexp_count(col, F.lit(r"[\p{L}\p{N}']+")), F.lit(1)).cast("double")
    syllables = F.regexp_count(F.lower(col), F.lit(r"[aeiouyàâäéèêëîïôöùûü]+")).cast("double")
    hard = F.regexp_count(F.lower(col), F.lit(
        r"(?:[\p{L}&&[^aeiouyàâäéèêëîïôöùûü]]*+[aeiouyàâäéèêëîïôöùûü]++){3}\p{L}*+")).cast("double")
    kincaid = 0.39 * words / sentences + 11.8 * syllables / words - 15.59
    smog = 1.043 * F.sqrt(hard * 30.0 / sentences) + 3.1291
    return kincaid, smog


def title_case(col: Column) -> Column:
    """Capitalise words; small words stay low except at the start."""
    words = F.split(F.lower(col), " ")
    return F.array_join(F.transform(words, lambda w, i: F.when(
        (i > 0) & w.isin(*SMALL_WORDS), w).otherwise(F.concat(F.upper(F.left(w, F.lit(1))), F.substring(w, F.lit(2), F.length(w))))), " ")


def parse_email(col: Column) -> Column:
    """Parts of a mail address that is the whole text; a line feed at the end is no address."""
    names = {"user": 1, "host": 2, "domain": 3, "tld": 4}
    part = lambda g: F.when(~F.endswith(col, F.lit("\n")), empty_to_null(F.regexp_extract(col, ADDRESS_PATTERN, g)))
    return F.struct(*[part(g).alias(n) for n, g in names.items()])


def parse_number(col: Column) -> Column:
    pattern = r"\A([+-])?([0-9]*)\.?([0-9]+)(?:[eE]([+-])?([0-9]+))?\z"
    names = {"sign": 1, "whole": 2, "frac": 3, "exp_sign": 4, "exp": 5}
    return F.struct(*[empty_to_null(F.regexp_extract(col, pattern, g)).alias(n) for n, g in names.items()])


def parse_duration(col: Column) -> Column:
    """Minutes of the first ``1h 56min`` in a text; 0 when there is none."""
    part = lambda g: empty_to_null(F.regexp_extract(col, DURATION_PATTERN, g)).cast("int")
    return F.coalesce(part(1) * 60 + part(2), F.lit(0))


def parse_french_date(col: Column) -> Column:
    """``11 octobre 2017`` as a date."""
    pattern = r"\A([0-9]{1,2}) (\p{L}+) ([0-9]{4})\z"
    month = F.array_position(F.array(*[F.lit(m) for m in MONTHS_FR]), F.lower(F.regexp_extract(col, pattern, 2)))
    text = F.format_string("%s-%02d-%02d", F.regexp_extract(col, pattern, 3), month,
                           F.regexp_extract(col, pattern, 1).try_cast("int"))
    return F.when(col.rlike(pattern) & (month > 0), text.try_cast("date"))


def decode_base64_parts(col: Column) -> Column:
    """Text of ``-``-separated base64 pieces."""
    pieces = F.transform(F.split(col, "-"), lambda p: F.decode(F.unbase64(p), "UTF-8"))
    return F.array_join(pieces, "")


def find_emails(col: Column, filters: tuple[str, ...] = ()) -> Column:
    """Distinct addresses of a text without those that hold a filter word."""
    found = F.array_distinct(F.regexp_extract_all(col, F.lit(EMAIL_PATTERN), F.lit(1)))
    for word in filters:
        found = F.filter(found, lambda e: ~e.contains(word))
    return found


def fill_template(template: str, params: dict[str, Column], is_url: bool = True) -> Column:
    """``{{ name:default }}`` template as an expression; values are escaped after the first ``?``."""
    question = template.find("?")
    pieces, end = [], 0
    for hit in re.finditer(r"\{\{\s*(\w+)\s*(:(\w+))?\s*\}\}", template):
        pieces.append(F.lit(template[end:hit.start()]))
        name, default = hit.group(1), hit.group(3)
        if name not in params and not default:
            raise ValueError(f"missing param: {name}")
        value = F.coalesce(params[name], F.lit(default)) if name in params and default else params.get(name, F.lit(default))
        if is_url and 0 <= question < hit.start():
            value = F.url_encode(value)
        pieces.append(value)
        end = hit.end()
    pieces.append(F.lit(template[end:]))
    return F.concat(*pieces)
