"""Record extraction from JSON documents and path listings."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.functions.jsonpath import json_path

#: Paths that a task remembers as handed on.
KNOWN_PATHS = 100_000


def _detail(item: Column, paths: list[str]) -> Column:
    def one(path: str) -> tuple[str, Column]:
        path, _, alias = path.partition("|")
        return alias or path.split(".")[-1], json_path(item, path)

    if len(paths) == 1:
        return one(paths[0])[1]
    return F.to_variant_object(F.struct(*[value.alias(name) for name, value in map(one, paths)]))


def json_block(docs: DataFrame, value: str, items: str, details: dict[str, list[str]], keep: tuple[str, ...] = ()) -> DataFrame:
    """One record per element of the list at ``items``. A field with one path is a value or
    a list; with several it is an object named by ``path|alias`` or the last path part."""
    listed = F.try_variant_get(json_path(F.col(value), items), "$", "array<variant>")
    rows = docs.select(*keep, F.posexplode(listed).alias("pos", "item"))
    return rows.select(*keep, "pos", *[_detail(F.col("item"), paths).alias(name) for name, paths in details.items()])


def leaf_paths(docs: DataFrame, value: str) -> DataFrame:
    """Distinct paths of all scalar values, list positions written as ``[*]``.

    One scan: each task walks its values and hands on a path when it first meets it, so the shuffle
    holds a few rows per task. Null counts as a scalar, empty lists and objects have no path.
    """
    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set[str] = set()
        for batch in batches:
            if len(known) > KNOWN_PATHS:
                known.clear()
            fresh: set[str] = set()
            for text in batch.column(0).to_pylist():
                todo = [("", json.loads(text))]
                while todo:
                    path, v = todo.pop()
                    if isinstance(v, dict):
                        todo += [(f"{path}.{key}", inner) for key, inner in v.items()]
                    elif isinstance(v, list):
                        todo += [(f"{path}[*]", inner) for inner in v]
                    else:
                        fresh.add(path)
            fresh -= known
            known |= fresh
            if fresh:
                yield pa.RecordBatch.from_arrays([pa.array(sorted(fresh))], names=["path"])

    return docs.select(F.to_json(value).alias("v")).filter("v is not null").mapInArrow(walk, "path string").distinct()
