"""Folds over ordered rows: rules in which what a row gets depends on what the rows before it were given.

Rows are dealt by key and sorted there; a task carries the state of one key at a time from batch to batch, so that a key
costs constant memory however many rows it has. Its rows do depend on one another, so that one task sees them all: callers
give the finest keys whose rows are independent.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


KINDS = {"boolean": pa.bool_(), "array<int>": pa.list_(pa.int32())}


def folded(df: DataFrame, keys: list[str], order: list[str], fields: list[str], start: tuple, step: Callable, carry: list[str], result: str) -> DataFrame:
    """The columns `carry` of each row and `result` (a name and a type): step(state, *fields) -> (state, result) over a key's rows in order.

    `order` should be unique within a key; a null key is a value like any other.
    """
    name, kind = result.split(" ")
    by, n = [f"_k{i}" for i in range(len(keys))], len(carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, start
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns[n:]]
            out = []
            for key, row in zip(zip(*columns[: len(keys)], strict=True), zip(*columns[len(keys) :], strict=True), strict=True):
                if key != last:
                    last, state = key, start
                state, given = step(state, *row)
                out.append(given)
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(out, KINDS[kind])], [*carry, name])

    named = [*(F.col(c).alias(f"_c{i}") for i, c in enumerate(carry)), *(F.col(k).alias(b) for k, b in zip(keys, by, strict=True)), *(F.col(f).alias(f"_f{i}") for i, f in enumerate(fields))]
    sort = [*by, *(f"_o{i}" for i in range(len(order)))]
    dealt = df.select(*named, *(F.col(o).alias(f"_o{i}") for i, o in enumerate(order))).repartition(*by).sortWithinPartitions(*sort)
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in carry) + f", {result}"
    return dealt.drop(*sort[len(by) :]).mapInArrow(run, schema)


def micros(ts) -> F.Column:
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts.cast("timestamp_ntz"))


def burst_limited(requests: DataFrame, identity: str, per_window: int, burst: int, window: int = 60, idle: int = 60) -> DataFrame:
    """(id, allowed): requests within `per_window` of a window of so many seconds and within a burst.

    Both counters count allowed requests only. The burst counter ends `idle` seconds after the last allowed request, and
    not with the window. Requests that are at least the idle time and a window's end after the one before them start anew,
    so that the rows in between two such pauses are folded apart; pauses are found in the windows' first and last times.
    """
    unit = 1_000_000
    timed = requests.select(F.col("id"), F.col(identity).alias("who"), micros(F.col("ts")).alias("us")).withColumn("win", F.floor(F.col("us") / (window * unit)))
    windows = timed.groupBy("who", "win").agg(F.min("us").alias("first"), F.max("us").alias("last"))
    order = Window.partitionBy("who").orderBy("win")
    anew = F.coalesce(F.col("first") - F.lag("last").over(order) >= idle * unit, F.lit(True))
    windows = windows.withColumn("start", F.when(anew, F.col("win"))).withColumn("run", F.last("start", ignorenulls=True).over(order)).select(F.col("who").alias("of"), F.col("win").alias("at"), "run")
    runs = timed.join(windows, F.equal_null("who", "of") & (F.col("win") == F.col("at"))).select("id", "who", "win", "us", "run")

    def step(state: tuple, win: int, us: int) -> tuple[tuple, bool]:
        now, count, held, last = state
        count = count if win == now else 0
        held = 0 if last is None or us - last >= idle * unit else held
        allowed = count < per_window and held < burst
        return ((win, count + 1, held + 1, us) if allowed else (win, count, held, last)), allowed

    return folded(runs, ["who", "run"], ["us", "id"], ["win", "us"], (None, 0, 0, None), step, ["id"], "allowed boolean")


def nested(rows: DataFrame, keys: list[str], order: str, level: str) -> DataFrame:
    """rows with `path`: the `order` numbers of the rows they lie in, outermost first, and their own last.

    A row lies in the last row before it of a smaller level; levels may be of any depth.
    """

    def step(stack: tuple, number: int, depth: int) -> tuple[tuple, list[int]]:
        while stack and stack[-1][1] >= depth:
            stack = stack[:-1]
        stack = (*stack, (number, depth))
        return stack, [n for n, _ in stack]

    return folded(rows, keys, [order], [order, level], (), step, rows.columns, "path array<int>")


def charged(charges: DataFrame, limit: int, keys: list[str], order: list[str], amount: str, id_col: str) -> DataFrame:
    """(id, accepted): charges against a quota in order, a rejected charge using nothing up; a null amount is none."""

    def step(used: tuple, cost: int | None) -> tuple[tuple, bool]:
        total = used[0] + (cost or 0)
        return ((total,), True) if total <= limit else (used, False)

    return folded(charges, keys, order, [amount], (0,), step, [id_col], "accepted boolean")
