"""JSON functions on variant columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from webloom.functions.vectors import bind

Step = tuple[str, str]


def kind(text: Column) -> Column:
    """Top-level kind of a JSON text: OBJECT, ARRAY, STRING ...; NULL when it is no JSON."""
    value = F.try_parse_json(text)
    return F.when(F.is_variant_null(value), "VOID").otherwise(F.regexp_extract(F.schema_of_variant(value), r"\A[A-Z]+", 0))


def is_json(text: Column) -> Column:
    """A JSON object (or null, which every target type accepts)."""
    return F.coalesce(kind(text).isin("OBJECT", "VOID"), F.lit(False))


def is_json_array(text: Column) -> Column:
    return F.coalesce(kind(text).isin("ARRAY", "VOID"), F.lit(False))


def is_json_string(text: Column) -> Column:
    return F.coalesce(kind(text).isin("STRING", "VOID"), F.lit(False))


def unwrap_jsonp(text: Column) -> Column:
    """Body of a script callback: the function wrapper and the call's parentheses go."""
    prefix, suffix = "(function(){", ";})();"
    bare = F.when(text.startswith(prefix), F.substring(text, F.lit(len(prefix) + 1), F.length(text)))
    bare = F.when(bare.endswith(suffix), F.left(bare, F.length(bare) - len(suffix))).otherwise(bare)
    s = F.coalesce(bare, text)
    opening, brace = F.instr(s, "("), F.instr(s, "{")
    closing = F.length(s) - F.instr(F.reverse(s), ")") + 1
    called = (opening > 0) & ((brace == 0) | (opening < brace)) & F.contains(s, F.lit(")")) & (closing - 1 > opening)
    # A call without a brace is left alone.
    called = called & (brace > 0)
    inner = F.substring(s, opening + 1, closing - opening - 1)
    return F.when(called, F.regexp_replace(inner, "\\A\"+|\"+\\z", "")).otherwise(s)


def steps_of(path: str) -> list[Step]:
    """``a[0].b.(c=1)`` as (kind, text) steps."""
    steps: list[Step] = []
    for part in [] if path == "*" else path.split("."):
        name, bracket, rest = part.partition("[")
        if name:
            steps.append(("where" if name.startswith("(") else "key", name))
        if bracket:
            steps.append(("range" if ":" in rest else "index", rest.rstrip("]")))
    return steps


def as_array(value: Column) -> Column:
    """The elements, or NULL when the value is no array."""
    return F.try_variant_get(value, "$", "array<variant>")


def condition(element: Column, text: str) -> Column:
    """All ``k=v`` pairs of ``(k=v&k2=v2)`` hold, compared as text."""
    held = F.lit(True)
    for pair in text.strip("()").split("&"):
        if pair.count("=") == 1:
            name, wanted = pair.split("=")
            held = held & (F.try_variant_get(element, f"$['{name}']", "string") == wanted)
    return F.coalesce(held, F.lit(False))


def _follow(value: Column, steps: list[Step], inside: bool = False) -> Column:
    if not steps:
        return value
    (kind_, text), rest = steps[0], steps[1:]
    if kind_ == "key":
        def keyed(v: Column) -> Column:
            single = _follow(F.try_variant_get(v, f"$['{text}']", "variant"), rest)
            if inside:
                return single
            mapped = lambda elements: F.to_variant_object(F.transform(elements, lambda e: _follow(e, steps, inside=True)))
            return bind(as_array(v), lambda elements: F.when(elements.isNotNull(), mapped(elements)).otherwise(single))

        return bind(value, keyed)

    def listed(elements: Column) -> Column:
        if kind_ == "where":
            return _follow(F.to_variant_object(F.filter(elements, lambda e: condition(e, text))), rest)
        size = F.size(elements)
        if kind_ == "index":
            return _follow(F.when(size > 0, F.get(elements, F.pmod(F.lit(int(text)) + size, size))), rest)
        low, high = (int(n or 0) for n in text.split(":"))
        return F.to_variant_object(F.transform(slice_range(elements, low, high), lambda e: _follow(e, rest)))

    return bind(as_array(value), listed)


def json_path(value: Column, path: str) -> Column:
    """Value of a path in a variant. A key applied to an array maps over its elements."""
    return _follow(value, steps_of(path))


def slice_range(values: Column, low: int, high: int) -> Column:
    """Part of an array; negative bounds count from the end, an upper bound of 0 is open."""
    size = F.size(values)
    first, last = F.pmod(F.lit(low) + size, size), F.pmod(F.lit(high) + size, size)
    return F.when(size == 0, values).when(last == 0, F.slice(values, first + 1, size)).when(
        last >= first, F.slice(values, first + 1, last - first))
