"""Neighbours and running sums across chunks of time, against plain Python over whole histories."""

import datetime as dt
import random

import pytest

from pyspark.sql import functions as F

from faunaflow.operators import network
from faunaflow.operators.adjacent import running_sum, with_adjacent

SCHEMA = "k string, t timestamp_ntz, n long, v double"


def rows_of(seed):
    rng = random.Random(seed)
    start = dt.datetime(2024, 1, 20)
    rows = []
    for key, count, gap in (("a", 60, 40), ("b", 40, 900), (None, 12, 300), ("one", 1, 1)):
        at = start
        for _ in range(count):
            at += dt.timedelta(hours=rng.choice([0, 1, gap]))
            rows.append((key, at, len(rows), None if rng.random() < 0.2 else float(rng.randrange(9))))
    rows.append(("a", None, len(rows), 5.0))
    rng.shuffle(rows)
    return rows


def in_order(rows):
    keys = {}
    for r in sorted(rows, key=lambda r: (r[1] is not None, r[1] or dt.datetime.min, r[2])):
        keys.setdefault(r[0], []).append(r)
    return keys


@pytest.mark.parametrize("chunk", ["month", "day"])
def test_neighbours_of_whole_histories(spark, chunk):
    rows = rows_of(3)
    got = with_adjacent(spark.createDataFrame(rows, SCHEMA), "k", "t", ["n"], after=["n", "v"], before=["n"], first=["n"], chunk=chunk)
    assert got.columns == ["k", "t", "n", "v", "after", "before", "first"]
    found = {r.n: (r.after and tuple(r.after), r.before and r.before.n, r.first.n) for r in got.collect()}
    want = {}
    for line in in_order(rows).values():
        for i, r in enumerate(line):
            after = (line[i + 1][2], line[i + 1][3]) if i + 1 < len(line) else None
            want[r[2]] = (after, line[i - 1][2] if i else None, line[0][2])
    assert found == want and len(want) == len(rows)


def test_running_sums_of_whole_histories(spark):
    rows = rows_of(4)
    got = running_sum(spark.createDataFrame(rows, SCHEMA), "k", "t", F.col("v"), "total", ["n"])
    want = {}
    for line in in_order(rows).values():
        seen = []
        for r in line:
            seen += [] if r[3] is None else [r[3]]
            want[r[2]] = sum(seen) if seen else None
    assert {r.n: r.total for r in got.collect()} == want


def test_neighbours_of_nothing(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert with_adjacent(empty, "k", "t", after=["n"]).collect() == [] and running_sum(empty, "k", "t", F.col("v"), "s").collect() == []


def test_no_task_orders_a_whole_history(spark):
    df = with_adjacent(spark.createDataFrame(rows_of(5), SCHEMA), "k", "t", after=["n"])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "adj_chunk" in plan and "SinglePartition" not in plan and "NestedLoop" not in plan


def test_nodes_of_full_windows(spark):
    at = [dt.datetime(2024, 1, 30) + dt.timedelta(days=i) for i in range(6)]
    path = [(5.0, 5.0), (15.0, 5.0), (15.0, 15.0), (5.0, 15.0), (5.0, 5.0), (15.0, 5.0)]
    rows = [("a", at[i], at[i + 1], *path[i], *path[i + 1], float(i), 10.0) for i in range(5)]
    df = spark.createDataFrame(rows, "groupby_col string, segment_start timestamp_ntz, segment_end timestamp_ntz, x1 double, y1 double, x2 double, y2 double, speed_kmhr double, dist_meters double")
    got = {(r.cx, r.cy): r for r in network.window_nodes(df, 10.0).collect()}
    # three windows begin, at segments 0, 1 and 2; the end of the third is a node without features
    assert set(got) == {(0, 0), (1, 0), (1, 1), (0, 1)} and got[0, 1].speed is None
    assert [got[n].speed for n in ((0, 0), (1, 0), (1, 1))] == [0.0, 1.0, 2.0]
    assert got[0, 0].dot_product == pytest.approx(0, abs=1e-9) and got[0, 0].tortuosity_1 == pytest.approx(1 / 3)
    assert network.window_nodes(df.limit(0), 10.0).collect() == []
