"""What the third review found: state kept row by row, and tables stored that are read once."""

from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql.types import StructType

from webloom.operators import mining
from webloom.plans import mining_plans
from webloom.streaming.ordered import InOrder


class State:
    """A list or value state that counts the calls."""

    def __init__(self, calls):
        self.calls, self.held = calls, None

    def get(self):
        self.calls.append("get")
        return iter(self.held or []) if isinstance(self.held, list | None) else self.held

    def put(self, rows):
        self.calls.append("put")
        self.held = [*rows]

    def appendList(self, rows):
        self.calls.append("append")
        self.held = [*(self.held or []), *rows]

    def clear(self):
        self.held = None


class Value(State):
    def get(self):
        self.calls.append("get")
        return self.held

    def update(self, value):
        self.calls.append("update")
        self.held = value


def test_many_keys_share_calls_to_the_state_store(spark):
    calls, timers = [], []
    handle = SimpleNamespace(
        getValueState=lambda name, schema: Value(calls), getListState=lambda name, schema: State(calls),
        registerTimer=timers.append, deleteTimer=timers.remove)

    def step(total, rows):
        sums = total[0] + np.cumsum(rows["v"])
        return (int(sums[-1]),), [rows["id"], sums]

    rows = StructType.fromDDL("k long, ts timestamp, id long, v long")
    job = InOrder(["k"], "ts", "id", step, (0,), StructType.fromDDL("total long"), rows, StructType.fromDDL("k long, id long, total long"), None)
    job.init(handle)
    n = 30_000
    at = pd.to_datetime(np.arange(n)[::-1] * 1000, unit="us")  # the latest row comes first
    frame = pd.DataFrame({"k": np.arange(n) % 1000, "ts": at, "id": np.arange(n), "v": 1})
    for start in range(0, n, 10_000):
        list(job.handleInputRows((0,), iter([frame[start:start + 10_000]]), None))
    clock = lambda ms: SimpleNamespace(getCurrentWatermarkInMs=lambda: ms)
    out = pd.concat([*job.handleExpiredTimer((0,), clock(14_999), None), *job.handleExpiredTimer((0,), clock(40_000), None)])
    assert len(calls) < 60
    assert len(out) == n and out["id"].is_unique
    assert (out.sort_values("id")["total"].to_numpy() == (n // 1000 - np.arange(n) // 1000)).all()


def test_trees_are_stored_with_used_fields_only(spark, tmp_path):
    spark.createDataFrame([(1, "http://x.y/", "<ul class='a'><li><a href='/b' title='c'>d</a></li></ul>")], "page_id long, url string, html string").createOrReplaceTempView("odd_pages")
    trees = mining_plans.stored(SimpleNamespace(pages=spark.table("odd_pages")))
    nodes = trees.first()["nodes"]
    assert "inner_from" not in trees.schema["nodes"].dataType.elementType.fieldNames()
    assert [n["attrs"] for n in nodes if n["tag"] == "a"] == [{"href": "/b"}]


@pytest.mark.parametrize("copies", [1, 2])
def test_item_schema_reads_its_fields_once(spark, tmp_path, copies):
    rows = [(1, 0, 0, 1, "0:a#0", 0, 5, "a", "x"), (1, 0, 0, 2, "0:a#0", 0, 7, "a", "y"), (1, 0, 3, 1, "0:a/[T]#0", 1, 9, "[T]", None)] * copies
    spark.createDataFrame(rows, "page_id long, label long, parent int, item int, key string, column long, node int, tag string, value string").write.parquet(f"{tmp_path}/fields")
    found = mining.item_schema(spark.read.parquet(f"{tmp_path}/fields"))
    assert found._jdf.queryExecution().optimizedPlan().collectLeaves().size() == 1
    got = sorted((r["column"], r["type"], r["required"], r["vary"], r["present"], r["items"]) for r in found.collect())
    assert got == [(0, "url", False, True, 2, 3), (1, "text", False, False, 1, 3)]
