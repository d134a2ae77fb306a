"""Keyed streaming state that takes its rows in event time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType, TimestampType

from webloom.session import ship

#: Rows of a stored piece, so that none outgrows a message to the state store.
PIECE = 10_000
#: Groups that the keys are dealt to. Like the state partitions they are fixed when a job first runs.
GROUPS = 512


def arrow_schema(rows: StructType) -> pa.Schema:
    """Times are plain microseconds."""
    return pa.schema([(f.name, pa.timestamp("us") if isinstance(f.dataType, TimestampType) else to_arrow_type(f.dataType)) for f in rows])


def packed(rows: pa.Table) -> list[tuple[bytes]]:
    """Arrow streams of a bounded number of rows each."""
    pieces = []
    for batch in rows.to_batches(max_chunksize=PIECE):
        with pa.BufferOutputStream() as sink:
            with pa.ipc.new_stream(sink, batch.schema) as writer:
                writer.write_batch(batch)
            pieces.append((sink.getvalue().to_pybytes(),))
    return pieces


def unpacked(state, schema: pa.Schema) -> pa.Table:
    found = [pa.ipc.open_stream(piece).read_all() for (piece,) in state.get()]
    return pa.concat_tables(found).combine_chunks() if found else schema.empty_table()


class InOrder(StatefulProcessor):
    """Rows wait in a buffer until the watermark has passed them, then go through ``step`` in order, key by key.

    No row that arrives later can come before them, as Spark drops rows behind the watermark. A buffer holds
    what arrives within the delay, not the history. A call to the state store takes far longer than the work
    for a key, so many keys share a group: its rows and totals are stored as Arrow batches.
    """

    def __init__(self, by: list[str], time: str, tie: str, step: Callable, start: tuple, state: StructType, rows: StructType, out: StructType, lives: Callable | None):
        self.by, self.time, self.tie, self.step, self.start, self.lives = by, time, tie, step, start, lives
        self.out_schema = out
        self.row_schema = arrow_schema(rows)
        self.total_schema = pa.schema([*(self.row_schema.field(c) for c in by), *arrow_schema(state)])

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.totals = handle.getListState("totals", "rows binary")
        self.waiting = handle.getListState("waiting", "rows binary")
        self.timer = handle.getValueState("timer", "at long")

    def wake(self, at: int) -> None:
        """One timer per group, at the earliest moment something is due."""
        set_to = self.timer.get()
        if set_to is not None:
            if set_to[0] <= at:
                return
            self.handle.deleteTimer(set_to[0])
        self.handle.registerTimer(at)
        self.timer.update((at,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for frame in rows:
            frame = frame[frame[self.time].notna()]  # without a time a row is never due
            if len(frame):
                columns = [pa.array(frame[f.name], f.type, from_pandas=True) for f in self.row_schema]
                self.waiting.appendList(packed(pa.Table.from_arrays(columns, schema=self.row_schema)))
                least = frame[self.time].min().value
                first = least if first is None else min(first, least)
        if first is not None:
            self.wake(-(-first // 1_000_000))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        self.timer.clear()
        held = unpacked(self.waiting, self.row_schema)
        times = held.column(self.time).cast(pa.int64()).to_numpy()
        passed = times <= watermark * 1000
        due, rest = held.filter(pa.array(passed)), times[~passed]
        if len(rest) and due.num_rows:
            self.waiting.put(packed(held.filter(pa.array(~passed))))
        elif due.num_rows:
            self.waiting.clear()
        stored = unpacked(self.totals, self.total_schema)
        of, *values = ([*zip(*(stored.column(c).to_pylist() for c in part))] for part in (self.by, self.total_schema.names[len(self.by):]))
        totals = dict(zip(of, values[0]))
        out = self.answer(due, totals) if due.num_rows else None
        wakes = [-(-int(rest.min()) // 1000)] if len(rest) else []
        if self.lives is not None:
            ends = {k: -(-self.lives(v) // 1000) + 1 for k, v in totals.items()}
            # A key with rows in the buffer keeps its total until they have been answered.
            busy = set(zip(*(held.filter(pa.array(~passed)).column(c).to_pylist() for c in self.by))) if len(rest) else set()
            totals = {k: v for k, v in totals.items() if k in busy or ends[k] > watermark}
            wakes += [ends[k] for k in totals if k not in busy]
        if totals:
            columns = zip(*((*k, *v) for k, v in totals.items()))
            self.totals.put(packed(pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, self.total_schema)], schema=self.total_schema)))
        else:
            self.totals.clear()
        if wakes:
            self.wake(min(wakes))
        if out is not None:
            yield out

    def answer(self, due: pa.Table, totals: dict[tuple, tuple]) -> pd.DataFrame:
        """Answers to the rows, key after key; ``totals`` are brought up to date."""
        codes = due.select(self.by).to_pandas().groupby(self.by, dropna=False, sort=False).ngroup().to_numpy()
        column = lambda c: due.column(c).cast(pa.int64()).to_numpy() if pa.types.is_timestamp(due.schema.field(c).type) else due.column(c).to_numpy()
        order = np.lexsort((column(self.tie), column(self.time), codes))
        rows = {c: column(c)[order] for c in due.column_names if c not in self.by}
        cuts = np.flatnonzero(np.diff(codes[order], prepend=-1, append=-1))
        keys = due.select(self.by).take(pa.array(order))
        names = [*zip(*(keys.column(c).take(pa.array(cuts[:-1])).to_pylist() for c in self.by))]
        answers = []
        for name, start, end in zip(names, cuts, cuts[1:]):
            totals[name], found = self.step(totals.get(name, self.start), {c: v[start:end] for c, v in rows.items()})
            answers.append(found)
        columns = [np.concatenate(c) for c in zip(*answers)]
        own = [keys.column(c).to_pandas(integer_object_nulls=True) for c in self.by]
        return pd.DataFrame(dict(zip(self.out_schema.fieldNames(), [*own, *columns])))

    def close(self) -> None:
        pass


def in_order(rows: DataFrame, by: list[str], time: str, tie: str, delay: str, step: Callable, start: tuple, state: str, out: str,
             lives: Callable | None = None) -> DataFrame:
    """``step(state, rows) -> (state, answers)`` over every key's rows by ``time``, equal ones by ``tie``.

    ``rows`` are those that have come due, an array per column, times in microseconds; ``answers`` a list of
    arrays, a value for each row. Columns with nulls come as floats, null as NaN. Rows later than ``delay`` behind the latest are dropped; ``lives`` tells, in microseconds, how long a
    state matters. The result has the key's columns and the answer's.
    """
    ship(rows.sparkSession)
    keys = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in by)
    result = StructType.fromDDL(f"{keys}, {out}")
    processor = InOrder(by, time, tie, step, start, StructType.fromDDL(state), rows.schema, result, lives)
    grouped = rows.withColumn("_group", F.pmod(F.xxhash64(*by), F.lit(GROUPS))).withWatermark(time, delay).groupBy("_group")
    return grouped.transformWithStateInPandas(processor, result, "Append", "EventTime")
