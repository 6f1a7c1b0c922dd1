"""Folds, as-of joins and timed state against plain replays."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import folds as D
from tessera.operators import quality as G
from tessera.operators.asof import asof_join
from tessera.streaming import flows as S

START = datetime.datetime(2024, 1, 1)


def replay(events, per_window, burst, window=60, idle=60):
    """The rule with a counter for each window and one that expires: {id: allowed}."""
    counts, bursts, out = {}, {}, {}
    for i, who, us in sorted(events, key=lambda e: (e[2], e[0])):
        win, second = us // (window * 10**6), 10**6
        count = counts.get((who, win), 0)
        held, ends = bursts.get(who, (0, 0))
        held = 0 if us >= ends else held
        out[i] = count < per_window and held < burst
        if out[i]:
            counts[who, win], bursts[who] = count + 1, (held + 1, us + idle * second)
    return out


@pytest.mark.parametrize(("per_window", "burst", "mean"), [(3, 5, 8), (100, 4, 30), (2, 100, 15), (1, 1, 45)])
def test_bursts_by_replay(spark, per_window, burst, mean):
    rng = random.Random(mean)
    at, events = {"a": 0, "b": 0, None: 0}, []
    for i in range(3000):
        who = rng.choice(["a", "a", "b", None])
        at[who] += rng.choice([0, rng.randrange(2 * mean * 10**6), rng.randrange(70 * 10**6), 60 * 10**6])
        events.append((i, who, at[who]))
    df = spark.createDataFrame([(i, who, START + datetime.timedelta(microseconds=us)) for i, who, us in events], "id long, who string, ts timestamp_ntz").repartition(5)
    got = {r.id: r.allowed for r in D.burst_limited(df, "who", per_window, burst).collect()}
    base = int((START - datetime.datetime(1970, 1, 1)).total_seconds()) * 10**6
    want = replay([(i, who, us + base) for i, who, us in events], per_window, burst)
    assert got == want and 0 < sum(got.values()) < len(got)


def test_one_busy_identity_is_folded_in_constant_state(spark):
    """A request each second, which never pauses: one run, whose state is four numbers."""
    n = 200_000
    df = spark.range(n).select("id", F.lit("x").alias("who"), (F.lit(START).cast("timestamp_ntz") + F.make_dt_interval(secs=F.col("id").cast("decimal(18,6)"))).alias("ts"))
    allowed = {r.id for r in D.burst_limited(df, "who", 30, 100).where("allowed").collect()}
    # 30 a minute until 100 are held; the counter then expires 60 s after the last one, which each new hundred repeats.
    assert allowed == {i for i, ok in replay([(i, "x", i * 10**6) for i in range(n)], 30, 100).items() if ok}


def test_charges(spark):
    rows = [(1, "u", 60), (2, "u", 50), (3, "u", 40), (4, "u", 1), (5, "v", 101), (6, "v", None), (7, None, 100), (8, None, 1)]
    df = spark.createDataFrame(rows, "id long, who string, cost int")
    got = {r.id: r.accepted for r in D.charged(df, 100, ["who"], ["id"], "cost", "id").collect()}
    assert got == {1: True, 2: False, 3: True, 4: False, 5: False, 6: True, 7: True, 8: False}
    assert D.charged(df.where("false"), 100, ["who"], ["id"], "cost", "id").collect() == []


def test_sections_of_any_depth(spark):
    rng = random.Random(2)
    levels = {1: list(range(1, 41)), 2: [rng.randrange(1, 50) for _ in range(300)], 3: [3, 2, 1, 2, 2, 7, 3]}
    rows = [(d, n, level, f"t{n}", "main_content", 10 * n, 5) for d, of in levels.items() for n, level in enumerate(of, 1)]
    secs = spark.createDataFrame(rows, "document_id long, number int, level int, title string, type string, start int, words int").repartition(4)
    tree = {(r.document_id, r.number): r for r in G.parents(secs).collect()}
    for d, of in levels.items():
        for n, level in enumerate(of, 1):
            inner = next((m for m in range(n - 1, 0, -1) if of[m - 1] < level), None)
            assert tree[d, n].parent == inner
            assert tree[d, n].path == ([*tree[d, inner].path, n] if inner else [n])
    assert max(r.depth for r in G.contents(secs).where("document_id = 1").collect()) == 40
    nodes = {(r.document_id, r.number): r for r in G.navigation(secs).collect()}
    assert nodes[1, 1].below == 39 and nodes[1, 1].children == [2] and nodes[1, 40].children == [] and nodes[3, 3].children == [4, 5] and nodes[3, 5].children == [6, 7] and nodes[3, 3].node == "section_30"


def test_as_of_join(spark):
    """A key with most rows, ties, equal times, rows before any match, and nulls; keys are split over tasks."""
    rng = random.Random(9)
    left = [(i, rng.choice(["hot", "hot", "hot", "a", "b", None]), rng.choice([None, *range(60)])) for i in range(400)]
    right = [(i, rng.choice(["hot", "hot", "a", "c", None]), rng.choice([None, *range(5, 60)]), f"v{i}") for i in range(80)]
    a = spark.createDataFrame(left, "id long, k string, t int").repartition(3)
    b = spark.createDataFrame(right, "rid long, k string, at int, value string").repartition(3)
    got = {r.id: r.match and r.match.value for r in asof_join(a, b, ["k"], "t", "at", ["rid"]).collect()}
    want = {}
    for i, k, t in left:
        fits = [(at, r, v) for r, kk, at, v in right if None not in (k, t, at) and kk == k and at <= t]
        want[i] = max(fits)[2] if fits else None
    assert got == want and len(set(want.values())) > 20
    assert {r.match for r in asof_join(a, b.where("false"), ["k"], "t", "at", ["rid"]).collect()} == {None}


def test_expired_entries_leave_the_state(spark, tmp_path):
    """Writes in four files: ends go out once, when a write or the watermark passes them, and Spark's state rows fall."""
    rng = random.Random(1)
    writes = sorted((rng.randrange(0, 40_000), rng.choice("abcdefgh"), rng.randrange(3)) for _ in range(150))
    writes += [(200_000, "z", 9)]
    schema = "event_type string, user_id long, ts timestamp_ntz"
    for n in range(4):
        part = [(k, u, START + datetime.timedelta(seconds=s)) for i, (s, k, u) in enumerate(writes) if i * 4 // len(writes) == n]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/events.parquet")
    progress = []
    out = S.drained(S.expired_entries(S.stream(spark, str(tmp_path), "events"), 3600), "append", rocks=True, progress=progress)
    got = sorted((r.key, r.ended) for r in out.collect())
    base, want = int(START.timestamp()) * 1000, []
    for key in {(k, u) for _, k, u in writes}:
        times = [s for s, k, u in writes if (k, u) == key]
        want += [(f"{key[0]}:{key[1]}", base + (s + 3600) * 1000) for s, later in zip(times, [*times[1:], None], strict=True) if (later >= s + 3600 if later is not None else s + 3600 <= 200_000 - 3600)]
    assert got == sorted(want)
    held = [p["stateOperators"][0]["numRowsTotal"] for p in progress if p["stateOperators"]]
    assert max(held) > held[-1] >= 1


def test_open_minutes_stay_and_closed_ones_go_once(spark, tmp_path):
    rows = [("a", START + datetime.timedelta(seconds=s)) for s in (0, 10, 61, 400, 3000)]
    spark.createDataFrame(rows, "event_type string, ts timestamp_ntz").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    progress = []
    out = S.drained(S.minute_counters(S.stream(spark, str(tmp_path), "events"), "event_type"), "append", progress=progress)
    assert sorted(r.n for r in out.collect()) == [1, 1, 2]
    held = [p["stateOperators"][0]["numRowsTotal"] for p in progress if p["stateOperators"]]
    assert held[0] == 4 and held[-1] == 1


def test_charges_of_one_time_and_name_are_taken_in_one_order(spark, tmp_path):
    """Whatever the order of the rows in the files."""
    from tessera.plans import registry

    rows = [(1, 1, q, datetime.datetime(2001, 7, 3)) for q in (24.0, 36.0)] + [(1, 2, 10.0, datetime.datetime(2001, 7, 4))]
    for n, lines in enumerate((rows, [rows[1], rows[0], rows[2]])):
        spark.createDataFrame([(*r, "A") for r in lines], "l_orderkey long, l_linenumber int, l_quantity double, l_shipdate timestamp_ntz, l_returnflag string").coalesce(1).write.parquet(f"{tmp_path}/{n}/lineitem.parquet")
        spark.createDataFrame([(1, 7, 1.0, "F", "x", datetime.datetime(2001, 7, 1))], "o_orderkey long, o_custkey long, o_totalprice double, o_orderstatus string, o_orderpriority string, o_orderdate timestamp_ntz").write.parquet(f"{tmp_path}/{n}/orders.parquet")
        got = sorted((r.charge, r.accepted) for r in registry.queries()["H44b_quota_charges"](spark, f"{tmp_path}/{n}").collect())
        assert got == [(11, False), (11, True), (12, True)]
