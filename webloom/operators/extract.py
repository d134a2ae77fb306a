"""Configuration-driven extraction of records from pages.

A field is a list of steps on a (value, context) state. Steps are compiled to column
expressions once, on the driver; all records of a page come out of its own row.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.functions import text as T
from webloom.functions import urls as U
from webloom.functions.vectors import bind
from webloom.operators.nodes import text_of
from webloom.operators.select import ROOT, follow, select, within, xpath


@dataclass
class Extraction:
    """``items`` splits a page into contexts (none: the page is the one context); ``fields``
    maps names to a step or a list of steps."""

    fields: dict[str, str | list[str]]
    items: str | None = None
    strict: bool = True

    def steps(self, name: str) -> list[str]:
        steps = self.fields[name]
        return [steps] if isinstance(steps, str) else list(steps)

    def selectors(self) -> list[str]:
        used = [s for name in self.fields for s in self.steps(name) if kind_of(s) is by_selector]
        return list(dict.fromkeys(([self.items] if self.items else []) + used))


@dataclass
class Page:
    """Columns of a page row that steps refer to."""

    nodes: Column
    html: Column
    places: dict[str, Column] = field(default_factory=dict)

    def inner_html(self, context: Column) -> Column:
        def inside(p: Column) -> Column:
            n = F.get(self.nodes, p["node"])
            return F.when(p["node"] < 0, self.html).otherwise(
                F.substring(self.html, n["inner_from"] + 1, n["inner_to"] - n["inner_from"]))

        return F.coalesce(F.get(F.transform(F.slice(context, 1, 1), inside), 0), F.lit(""))

    def subject(self, state: Column) -> Column:
        """The value, or the inner HTML of the context while there is none."""
        return F.when(state["value"] == "", self.inner_html(state["context"])).otherwise(state["value"])


def _state(value: Column, context: Column) -> Column:
    return F.struct(F.coalesce(value, F.lit("")).alias("value"), context.alias("context"))


def by_attribute(page: Page, step: str, state: Column) -> Column:
    attr = F.get(F.transform(F.slice(state["context"], 1, 1), lambda p: F.try_element_at(
        F.get(page.nodes, p["node"])["attrs"], F.lit(step[1:].lower()))), 0)
    return _state(attr, state["context"])


def by_regex(page: Page, step: str, state: Column) -> Column:
    return _state(T.regex_match(page.subject(state), step[1:-1]), state["context"])


def by_replace(page: Page, step: str, state: Column) -> Column:
    return _state(T.sed_replace(page.subject(state), step), state["context"])


def by_first(page: Page, step: str, state: Column) -> Column:
    return _state(state["value"], F.slice(state["context"], 1, 1))


def by_query_param(page: Page, step: str, state: Column) -> Column:
    return _state(U.query_param(page.subject(state), step[len("query-param("):-1]), state["context"])


def by_prepend(page: Page, step: str, state: Column) -> Column:
    return _state(T.prepend(page.subject(state), step[len("prepend("):-1]), state["context"])


def by_append(page: Page, step: str, state: Column) -> Column:
    return _state(T.append(page.subject(state), step[len("append("):-1]), state["context"])


def by_selector(page: Page, step: str, state: Column) -> Column:
    """Move the context; fill an empty value with the texts of all matches, joined by commas."""
    def moved(found: Column) -> Column:
        texts = F.array_join(F.transform(found, lambda p: text_of(page.nodes, p["node"], p["end_node"])), ",")
        return _state(F.when(state["value"] == "", texts).otherwise(state["value"]), found)

    return bind(within(page.places[step], state["context"]), moved)


# The first rule that accepts a step builds it; anything else is a selector.
RULES: list[tuple[Callable[[str], bool], Callable[[Page, str, Column], Column]]] = [
    (lambda s: s.startswith("@"), by_attribute),
    (lambda s: len(s) > 1 and s.startswith("/") and s.endswith("/"), by_regex),
    (lambda s: T.sed_parts(s) is not None, by_replace),
    (lambda s: s == "first()", by_first),
    (lambda s: s.startswith("query-param(") and s.endswith(")"), by_query_param),
    (lambda s: s.startswith("prepend(") and s.endswith(")"), by_prepend),
    (lambda s: s.startswith("append(") and s.endswith(")"), by_append),
]


def kind_of(step: str):
    return next((build for accepts, build in RULES if accepts(step)), by_selector)


def value_of(page: Page, steps: list[str], context: Column) -> Column:
    """Final value of a step list, NULL when empty."""
    def run(rest: list[str], state: Column) -> Column:
        if not rest:
            return T.empty_to_null(state["value"])
        return bind(kind_of(rest[0])(page, rest[0], state), lambda s: run(rest[1:], s))

    return run(steps, _state(F.lit(""), F.array(context)))


def keep_records(records: DataFrame, fields: list[str], strict: bool) -> DataFrame:
    """Strict: all fields are there; lax: at least one."""
    return records.dropna("any" if strict else "all", subset=fields)


def extract_records(trees: DataFrame, config: Extraction, keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """One row per record: the ``keep`` columns, ``record`` (position in the page) and the fields.

    With ``items`` incomplete records are dropped as ``strict`` says; without it every page
    gives exactly one record.
    """
    selectors = config.selectors()
    placed = trees.select("*", *[select(F.col("nodes"), s).alias(f"_s{i}") for i, s in enumerate(selectors)])
    page = Page(F.col("nodes"), F.col("html"), {s: F.col(f"_s{i}") for i, s in enumerate(selectors)})
    contexts = page.places[config.items] if config.items else F.array(F.expr(ROOT))
    names = list(config.fields)
    found = F.transform(contexts, lambda c: F.struct(*[value_of(page, config.steps(n), c).alias(n) for n in names]))
    rows = placed.select(*keep, F.posexplode(found).alias("record", "_r")).select(*keep, "record", *[F.col(f"_r.{n}") for n in names])
    return keep_records(rows, names, config.strict) if config.items else rows


def css_block(trees: DataFrame, config: Extraction, base: Column | None = None, keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """Records with cleaned text; a relative ``url`` field gets the base URL in front."""
    extra = ("url",) if base is not None and "url" in trees.columns else ()
    trees = trees.withColumnRenamed("url", "_page_url") if extra else trees
    kept = (*keep, "_page_url") if extra else keep
    rows = extract_records(trees, config, kept)
    cleaned = {n: F.nullif(T.sanitize_text(F.col(n)), F.lit("")) for n in config.fields}
    if base is not None and "url" in config.fields:
        u = cleaned["url"]
        cleaned["url"] = F.when(u.startswith("http"), u).otherwise(F.concat(base, u))
    return rows.select(*kept, "record", *[c.alias(n) for n, c in cleaned.items()]).drop("_page_url")


def xpath_block(trees: DataFrame, items: str, fields: dict[str, str], keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """Records by path expressions relative to the items; ``url`` takes the link target and a
    record without it is dropped. ``record`` is the ordinal of the item."""
    nodes = F.col("nodes")
    chain, _ = xpath(items)

    def value(name: str, path: str, item: Column) -> Column:
        steps, attribute = xpath(path)
        attribute = attribute or ("href" if name == "url" else "")
        found = follow(nodes, steps, F.array(item)) if steps else F.array(item)
        one = lambda p: (F.try_element_at(F.get(nodes, p["node"])["attrs"], F.lit(attribute)) if attribute
                         else text_of(nodes, p["node"], p["end_node"]))
        return T.empty_to_null(F.get(F.transform(F.slice(found, 1, 1), one), 0))

    placed = trees.withColumn("_items", follow(nodes, chain))
    records = F.transform("_items", lambda c: F.struct(*[value(n, p, c).alias(n) for n, p in fields.items()]))
    rows = placed.select(*keep, F.posexplode(records).alias("record", "_r")).select(*keep, "record", *[F.col(f"_r.{n}") for n in fields])
    return rows.dropna("any", subset=["url"]) if "url" in fields else rows.dropna("all", subset=list(fields))


def multi_block_union(trees: DataFrame, blocks: dict[str, Extraction], keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """All blocks of all pages under their block name; missing fields are NULL."""
    parts = [extract_records(trees, config, keep).withColumn("block", F.lit(name)) for name, config in blocks.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out
