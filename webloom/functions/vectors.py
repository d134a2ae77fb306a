"""Array and vector functions as column builders."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use the result several times."""
    return F.get(F.transform(F.array(value), use), 0)


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def argmax(values: Column) -> Column:
    """0-based position of the first largest value."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def binarize(values: Column) -> Column:
    return F.transform(values, lambda x: F.when(x <= 0, 0.0).otherwise(1.0))


def bool_binarize(values: Column) -> Column:
    return F.transform(values, lambda x: ~(x <= 0))


def bit_string(values: Column) -> Column:
    return F.array_join(F.transform(values, lambda x: F.when(x <= 0, "0").otherwise("1")), "")


def boost(distance: Column, k: int = 2) -> Column:
    return 1 - F.pow(1 - distance, F.lit(k))


def size_distance(a: Column, b: Column) -> Column:
    return F.abs(a - b) / (a + b)


def prefix_distance(a: Column, b: Column) -> Column:
    """Length of the longer path minus the shared beginning."""
    same = F.zip_with(a, b, lambda x, y: x.eqNullSafe(y))
    first_other = F.array_position(same, False).cast("int")
    shared = F.when(first_other == 0, F.size(same)).otherwise(first_other - 1)
    return F.greatest(F.size(a), F.size(b)) - shared


def class_similarity(a: Column, b: Column, max_items: int = 1) -> Column:
    """(1 + shared) / (1 + a + b - shared), each count capped at ``max_items``."""
    capped = lambda n: F.least(F.lit(max_items), n)
    na, nb, both = capped(F.size(F.array_distinct(a))), capped(F.size(F.array_distinct(b))), capped(F.size(F.array_intersect(a, b)))
    return (1.0 + both) / (1.0 + na + nb - both)


def deep_merge(a: Column, b: Column) -> Column:
    """Union of two flattened path maps; the right side wins on shared paths."""
    return F.map_zip_with(a, b, lambda k, x, y: F.coalesce(y, x))


def nested_path(path: Column) -> Column:
    """``/table/product[2]/name`` as the key sequence table, product, 2, name."""
    return F.split(F.regexp_replace(F.substring(path, F.lit(2), F.length(path)), r"\[([0-9]+)\]", "/$1"), "/")


def fixed_size(values: Column, size: int, fill) -> Column:
    """Cut or pad an array to ``size``."""
    return F.slice(F.concat(values, F.array_repeat(F.lit(fill), size)), 1, size)


def best_categories(prob: Column, k: int) -> Column:
    """The ``k`` best (prob, cat) of a probability array, ties by class; -1 keeps all."""
    ranked = F.transform(
        F.array_sort(F.transform(prob, lambda p, i: F.struct((-p).alias("neg"), i.alias("cat")))),
        lambda x: F.struct((-x["neg"]).alias("prob"), x["cat"].alias("cat")))
    return ranked if k < 0 else F.slice(ranked, 1, k)
