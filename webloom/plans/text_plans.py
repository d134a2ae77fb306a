"""Text functions exercised as projections over whole tables."""

from pyspark.sql import functions as F

from webloom.functions import text as T
from webloom.plans.registry import query

SEP_RE2 = r"[\n\t\f\r ,.;:`''!?()\-|><^·&\"\\/{}#$–=+]+"
LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS_SQL = ("list_filter(regexp_split_to_array(" + LOWER.format("text") + f", '{SEP_RE2}'), lambda w: length(w) >= 5)")
ALNUM_SQL = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '')"
WS = r"[ \t\n\x0B\f\r]"


@query("regex_match", r"""
select doc_id, coalesce(nullif(regexp_extract(text, '(?:^|\n)(\w+) the', 1), ''),
                        regexp_extract(text, '(?:^|\n)(\w+) the', 0)) as hit from documents""")
def regex_match(t):
    return t.documents.select("doc_id", T.regex_match(F.col("text"), r"(?:^|\n)(\w+) the").alias("hit"))


@query("sed_replace", r"""
select doc_id, regexp_replace(text, '[aeiou]+', '$1') as first_only,
       regexp_replace(text, '[aeiou]+', '$1', 'g') as every from documents""")
def sed_replace(t):
    text = F.col("text")
    return t.documents.select("doc_id", T.sed_replace(text, "s/[aeiou]+/$1/").alias("first_only"),
                              T.sed_replace(text, "s/[aeiou]+/$1/g").alias("every"))


@query("prepend_append", rf"""
select doc_id, trim(regexp_replace('  >> ' || text, '{WS}+', ' ', 'g')) as before,
       trim(regexp_replace(text || ' << ', '{WS}+', ' ', 'g')) as after from documents""")
def prepend_append(t):
    return t.documents.select("doc_id", T.prepend(F.col("text"), "  >> ").alias("before"),
                              T.append(F.col("text"), " << ").alias("after"))


@query("collapse_spaces", rf"select doc_id, trim(regexp_replace(text, '{WS}+', ' ', 'g')) as line from documents")
def collapse_spaces(t):
    return t.documents.select("doc_id", T.collapse_spaces(F.col("text")).alias("line"))


@query("case_functions", """
select doc_id, concat(source, ':', lang) as joined, replace(text, 'the', 'THE') as replaced,
       lower(text) as low, upper(source) as up from documents""")
def case_functions(t):
    return t.documents.select(
        "doc_id", F.concat("source", F.lit(":"), "lang").alias("joined"),
        F.replace("text", F.lit("the"), F.lit("THE")).alias("replaced"),
        F.lower("text").alias("low"), F.upper("source").alias("up"))


@query("sanitize_text", r"""
select doc_id, trim(translate(replace(text || ' ...', ' ...', '...'), chr(10) || chr(9), '  ')) as line from documents""")
def sanitize_text(t):
    return t.documents.select("doc_id", T.sanitize_text(F.concat("text", F.lit(" ..."))).alias("line"))


@query("strip_tags", r"""
select page_id, regexp_replace(regexp_replace(regexp_replace(html,
  '(?is)<script\b[^>]*>.*?</script>|<style\b[^>]*>.*?</style>|<!--.*?-->', '', 'g'),
  '<[^>]*>', chr(1), 'g'), chr(1) || '+', ' ', 'g') as body from pages""")
def strip_tags(t):
    return t.pages.select("page_id", T.strip_tags(F.col("html")).alias("body"))


@query("reverse_abbrev", """
select doc_id, reverse(text) as backwards,
  case when length(text) <= 40 then text else left(text, 19) || '..' || right(text, 19) end as middle,
  case when length(text) <= 40 then text else '..' || right(text, 38) end as tail from documents""")
def reverse_abbrev(t):
    text = F.col("text")
    return t.documents.select("doc_id", F.reverse(text).alias("backwards"),
                              T.abbrev(text, 40).alias("middle"), T.left_abbrev(text, 40).alias("tail"))


@query("trim_space", rf"""
select doc_id, translate(regexp_replace(regexp_replace(
    regexp_replace(text, '^{WS}+|{WS}+$', '', 'g'), ' {WS}*', chr(1), 'g'),
    '{WS}[\t\n\x0B\f\r\x01]*', '.', 'g'), chr(1), ' ') as line from documents""")
def trim_space(t):
    return t.documents.select("doc_id", T.trim_space(F.col("text")).alias("line"))


@query("trim_path", r"""
select page_id, '../' || regexp_extract(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) || ' -foo bar', '([^/]*)$', 1) as short
from pages""")
def trim_path(t):
    from webloom.functions import urls as U
    return t.pages.select("page_id", T.trim_path(F.concat(U.path(F.col("url")), F.lit(" -foo bar"))).alias("short"))


@query("line_shape", r"""
with lines as (select doc_id, generate_subscripts(string_split(text, chr(10)), 1) as pos, unnest(string_split(text, chr(10))) as line
               from documents),
h as (select *, trim(line, E' \t\r\n\f\x0B') as b from lines)
select doc_id, pos, length(regexp_extract(line, '^[ \t]*', 0)) as indent, (line = '') as blank,
  case when regexp_matches(b, '^\p{Lu}') and regexp_matches(b, '[\p{L}\p{Nd}]$')
        and not regexp_matches(b, '[,.;:!?+*/=()\[\]{}_^°&§~%#@<">\\]')
        and not contains(regexp_replace(b, '''s( |$)', '\1', 'g'), '''') then b else '' end as heading
from h""")
def line_shape(t):
    lines = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    line = F.col("line")
    return lines.select("doc_id", (F.col("pos") + 1).cast("bigint").alias("pos"), T.indent_len(line).cast("bigint").alias("indent"),
                        T.is_blank(line).alias("blank"), T.heading(line).alias("heading"))


@query("unindent", r"""
with b as (select doc_id, list_transform(string_split(text, chr(10)), lambda x: case when x = '' then x else '    ' || x end) as block
           from documents),
m as (select *, list_min(list_transform(list_filter(block, lambda x: x <> ''), lambda x: length(regexp_extract(x, '^[ \t]*', 0)))) as cut from b)
select doc_id, array_to_string(list_transform(block, lambda x: case when x = '' then x else substr(x, cut + 1) end), chr(10)) as body from m""")
def unindent(t):
    block = F.transform(F.split("text", "\n"), lambda x: F.when(x == "", x).otherwise(F.concat(F.lit("    "), x)))
    return t.documents.select("doc_id", F.array_join(T.unindent(block), "\n").alias("body"))


@query("common_prefix", r"""
select doc_id, pos, left(a, coalesce(list_position(list_transform(range(1, length(a) + 1), lambda i: substr(a, i, 1) = substr(b, i, 1)), false) - 1, length(a))) as shared
from (select doc_id, pos, w[pos] as a, w[pos + 1] as b from (select doc_id, string_split(text, ' ') as w, unnest(range(1, len(string_split(text, ' ')))) as pos from documents))""")
def common_prefix(t):
    """What every word of a text shares with the next one."""
    words = t.documents.select("doc_id", F.split("text", " ").alias("w"))
    pairs = F.filter(F.arrays_zip(F.col("w").alias("a"), F.slice("w", F.lit(2), F.greatest(F.size("w") - 1, F.lit(0))).alias("b")), lambda p: p["b"].isNotNull())
    return words.select("doc_id", F.posexplode(pairs).alias("at", "p")).select(
        "doc_id", (F.col("at") + 1).cast("bigint").alias("pos"), T.common_prefix(F.col("p.a"), F.col("p.b")).alias("shared"))


@query("parse_short_number", """
select event_id, round(value, 1) || case event_id % 3 when 0 then 'k' when 1 then 'm' else '' end as shown,
  cast(trunc(round(value, 1) * case event_id % 3 when 0 then 1000.0::double when 1 then 1000000.0::double else 1.0::double end) as bigint) as number
from events""")
def parse_short_number(t):
    shown = F.concat(F.round("value", 1).cast("string"),
                     F.when(F.col("event_id") % 3 == 0, "k").when(F.col("event_id") % 3 == 1, "m").otherwise(""))
    return t.events.select("event_id", shown.alias("shown")).select("event_id", "shown", T.parse_short_number(F.col("shown")).alias("number"))


@query("format_bytes", """
with s as (select event_id, cast(floor(value * 100) as bigint) * (event_id % 97) * (event_id % 89) as size from events)
select event_id, size, case when size = 0 then '0' else regexp_replace(case
  when size >= 1073741824 then printf('%.1f', size / 1073741824.0::double) when size >= 1048576 then printf('%.1f', size / 1048576.0::double)
  when size >= 1024 then printf('%.1f', size / 1024.0::double) else printf('%.1f', size::double) end, '\\.0$', '')
  || case when size >= 1073741824 then 'G' when size >= 1048576 then 'M' when size >= 1024 then 'K' when size >= 1 then 'B' else '' end end as shown
from s""".replace("\\\\", "\\"))
def format_bytes(t):
    size = F.floor(F.col("value") * 100) * (F.col("event_id") % 97) * (F.col("event_id") % 89)
    return t.events.select("event_id", size.alias("size")).select("event_id", "size", T.format_bytes(F.col("size")).alias("shown"))


@query("to_int", r"""
with w as (select doc_id, split_part(text, ' ', 1) as word, cast(n_chars as varchar) as digits from documents)
select doc_id, cast(case when regexp_matches(word, '^[+-]?[0-9]+$') then try_cast(word as int) else 0 end as int) as a,
  cast(digits as int) as b, cast(digits || '000000' as bigint) as c from w""")
def to_int(t):
    word, digits = F.get(F.split("text", " "), 0), F.col("n_chars").cast("string")
    return t.documents.select("doc_id", T.to_int(word).alias("a"), T.to_int(digits).alias("b"),
                              T.to_int(F.concat(digits, F.lit("000000")), 64).alias("c"))


@query("tokenize_words", f"select doc_id, array_to_string({WORDS_SQL}, ' ') as words from documents")
def tokenize_words(t):
    return t.documents.select("doc_id", F.array_join(T.tokenize_words(F.col("text")), " ").alias("words"))


@query("tokenize_alnum", f"select doc_id, array_to_string({ALNUM_SQL}, ' ') as words from documents")
def tokenize_alnum(t):
    return t.documents.select("doc_id", F.array_join(T.tokenize_alnum(F.col("text")), " ").alias("words"))


ALPHABET_SQL = T.ALPHABET.replace("'", "''")
UNKNOWN_SQL = "[^" + T.char_class(T.ALPHABET).replace("'", "''") + "]+"


@query("char_sequence", rf"""
with k as (select doc_id, regexp_replace(regexp_replace({LOWER.format('text')}, '[\n\t\f\r]+', '', 'g'), '{UNKNOWN_SQL}', ' ', 'g') as f,
  regexp_replace(regexp_replace(reverse({LOWER.format('text')}), '[\n\t\f\r]+', '', 'g'), '{UNKNOWN_SQL}', ' ', 'g') as r from documents)
select doc_id, array_to_string(list_transform(string_split(rpad(left(f, 60), 60, ' '), ''), lambda c: strpos('{ALPHABET_SQL}', c)), ',') as ids,
  array_to_string(list_transform(string_split(rpad(left(r, 60), 60, ' '), ''), lambda c: strpos('{ALPHABET_SQL}', c)), ',') as reversed from k""")
def char_sequence(t):
    text = F.col("text")
    ids = lambda back: F.array_join(F.transform(T.char_sequence(text, reverse=back), lambda x: x.cast("string")), ",")
    return t.documents.select("doc_id", ids(False).alias("ids"), ids(True).alias("reversed"))


VOWELS = "aeiouyàâäéèêëîïôöùûü"


@query("readability", rf"""
with c as (select doc_id, greatest(len(regexp_extract_all(text, '[.!?]+')), 1)::double as s,
  greatest(len(regexp_extract_all(text, '[\p{{L}}\p{{N}}'']+')), 1)::double as w,
  len(regexp_extract_all(lower(text), '[{VOWELS}]+'))::double as y,
  len(list_filter(regexp_extract_all(lower(text), '\p{{L}}+'), lambda v: len(regexp_extract_all(v, '[{VOWELS}]+')) >= 3))::double as h
  from documents)
select doc_id, round(0.39::double * w / s + 11.8::double * y / w - 15.59::double, 6) as flesch_kincaid,
  round(1.043::double * sqrt(h * 30 / s) + 3.1291::double, 6) as smog from c""")
def readability(t):
    kincaid, smog = T.readability(F.col("text"))
    return t.documents.select("doc_id", F.round(kincaid, 6).alias("flesch_kincaid"), F.round(smog, 6).alias("smog"))


@query("title_case", """
select doc_id, array_to_string(list_transform(string_split(lower(text), ' '), lambda w, i:
  case when i > 1 and w in ('a','an','and','at','but','by','for','in','nor','of','on','or','so','the','to','up','yet') then w
       else replace(upper(left(w, 1)), 'ẞ', 'SS') || substr(w, 2) end), ' ') as title from documents""")
def title_case(t):
    return t.documents.select("doc_id", T.title_case(F.col("text")).alias("title"))


@query("parse_email_number", r"""
with a as (select c_custkey, lower(c_mktsegment) || '.' || c_custkey || '@host' || c_nationkey || '.com' as mail,
                  cast(c_acctbal as varchar) || 'e-' || c_nationkey as num from customer)
select c_custkey, regexp_extract(mail, '^([^@]+)@', 1) as user, regexp_extract(mail, '@(\w+)\.', 1) as domain,
  regexp_extract(mail, '(\w+)$', 1) as tld, nullif(regexp_extract(num, '^([+-]?)', 1), '') as sign,
  regexp_extract(num, '^[+-]?([0-9]*)', 1) as whole, regexp_extract(num, '([0-9]+)e', 1) as frac,
  regexp_extract(num, 'e([+-])', 1) as exp_sign, regexp_extract(num, '([0-9]+)$', 1) as exp from a""")
def parse_email_number(t):
    mail = F.concat(F.lower("c_mktsegment"), F.lit("."), "c_custkey", F.lit("@host"), "c_nationkey", F.lit(".com"))
    number = F.concat(F.col("c_acctbal").cast("string"), F.lit("e-"), "c_nationkey")
    parsed = t.customer.select("c_custkey", T.parse_email(mail).alias("m"), T.parse_number(number).alias("n"))
    return parsed.select("c_custkey", "m.user", "m.domain", "m.tld", "n.sign", "n.whole", "n.frac", "n.exp_sign", "n.exp")


@query("parse_duration", """
select p_partkey, (p_size % 10) * 60 + p_partkey % 60 as minutes,
  strftime(make_date(2000 + p_size, 1 + (p_partkey % 12)::int, 1 + (p_partkey % 28)::int), '%Y-%m-%d') as day from part""")
def parse_duration(t):
    shown = F.format_string("durée %dh %02dmin env.", F.col("p_size") % 10, F.col("p_partkey") % 60)
    months = F.array(*[F.lit(m) for m in T.MONTHS_FR])
    date = F.concat_ws(" ", (1 + F.col("p_partkey") % 28).cast("string"),
                       F.element_at(months, (1 + F.col("p_partkey") % 12).cast("int")), (2000 + F.col("p_size")).cast("string"))
    return t.part.select("p_partkey", T.parse_duration(shown).cast("bigint").alias("minutes"),
                         T.parse_french_date(date).cast("string").alias("day"))


@query("decode_base64_parts", "select conv_id, turn, text || '|' || role as body from conversations")
def decode_base64_parts(t):
    packed = F.concat_ws("-", F.base64(F.encode("text", "UTF-8")), F.base64(F.encode(F.concat(F.lit("|"), "role"), "UTF-8")))
    packed = F.regexp_replace(packed, "[\r\n]", "")
    return t.conversations.select("conv_id", "turn", T.decode_base64_parts(packed).alias("body"))


@query("fill_template", r"""
select c_custkey, 'http://' || lower(c_mktsegment) || '.example.com/en?q=' || url_encode(c_name) || '&n=10' as url from customer""")
def fill_template(t):
    return t.customer.select("c_custkey", T.fill_template(
        "http://{{ seg }}.example.com/{{ lang:en }}?q={{ name }}&n={{size:10}}",
        {"seg": F.lower("c_mktsegment"), "name": F.col("c_name")}).alias("url"))
