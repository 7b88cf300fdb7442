import datetime as dt
import itertools
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from faunaflow.functions import geodesy, sun
from faunaflow.operators import density, ranges, relocations, spatial, trajectory


def t(hours, day=1):
    return dt.datetime(2024, 1, day) + dt.timedelta(hours=hours)


def fixes(spark, rows):
    df = spark.createDataFrame(rows, "subject string, fixtime timestamp_ntz, lon double, lat double, note string")
    return relocations.standard(df, "subject")


PATH = [("a", t(0), 36.0, 0.0, "p"), ("a", t(1), 36.01, 0.0, "q"), ("a", t(2), 36.01, 0.01, "r"), ("b", t(0), 36.0, 0.0, "s"), (None, t(0), 1.0, 1.0, "n")]


@pytest.mark.parametrize(
    "line, dist, azimuth",
    [
        ((0, 0, 1, 0), 111319.4908, 90.0),
        ((0, 0, 0, 1), 110574.3886, 0.0),
        ((144 + 25 / 60 + 29.52440 / 3600, -(37 + 57 / 60 + 3.72030 / 3600), 143 + 55 / 60 + 35.38390 / 3600, -(37 + 39 / 60 + 10.15610 / 3600)), 54972.271, 306 + 52 / 60 + 5.37 / 3600),
        ((5, 5, 5, 5), 0, 0),
    ],
)
def test_geodesic_of_published_lines(spark, line, dist, azimuth):
    df = spark.createDataFrame([tuple(map(float, line)), (None, 0.0, 1.0, 0.0)], "a double, b double, c double, d double")
    got = geodesy.with_geodesic(df, "a", "b", "c", "d", "dist", "az").collect()
    assert got[0].dist == pytest.approx(dist, abs=2e-3) and got[0].az == pytest.approx(azimuth, abs=2e-5)
    assert got[1].dist is None


def test_projections(spark):
    df = spark.createDataFrame([(3.0, 45.0), (36.8, -1.3)], "lon double, lat double")
    x, y = geodesy.utm(F.col("lon"), F.col("lat"), geodesy.utm_zone(F.col("lon"), F.col("lat")))
    got = df.select(geodesy.utm_zone(F.col("lon"), F.col("lat")).alias("z"), x.alias("x"), y.alias("y")).collect()
    assert [r.z for r in got] == [32631, 32737]
    assert got[0].x == pytest.approx(500000, abs=1e-3) and got[0].y == pytest.approx(4982950.400, abs=1e-2)
    mx, my = geodesy.mercator(F.lit(1.0), F.lit(2.0))
    lon, lat = geodesy.from_mercator(mx, my)
    assert spark.range(1).select(lon, lat).first() == pytest.approx((1.0, 2.0))


def test_standard_columns_clash(spark):
    df = spark.createDataFrame([("a", t(0), 1.0, 1.0, 1, 2)], "s string, fixtime timestamp_ntz, lon double, lat double, v int, extra__v int")
    with pytest.raises(ValueError):
        relocations.standard(df, "s")


def test_trajectory_pairs_fixes(spark):
    got = trajectory.from_fixes(fixes(spark, PATH)).orderBy("segment_start").collect()
    assert [(r.groupby_col, r.extra__note, r.timespan_seconds) for r in got] == [("a", "p", 3600.0), ("a", "q", 3600.0)]
    assert got[0].heading == pytest.approx(90, abs=1e-6) and got[1].heading == pytest.approx(0, abs=1e-6)
    assert got[0].speed_kmhr == pytest.approx(got[0].dist_meters / 1000)
    assert trajectory.from_fixes(fixes(spark, PATH), chunk="hour").orderBy("segment_start").collect() == got
    shuffled = trajectory.from_fixes(fixes(spark, PATH[::-1])).orderBy("segment_start").collect()
    assert shuffled == got


def test_filters_keep_their_quirks(spark):
    df = fixes(spark, [("a", t(0), 0.0, 0.0, ""), ("a", t(1), 1.0, 0.0, ""), ("a", t(2), 1.001, 0.0, ""), ("a", t(3), 1.002, 0.0, "")])
    fast = relocations.speed_filter(df, 50).orderBy("fixtime").collect()
    assert [r.junk_status for r in fast] == [True, False, False]
    far = relocations.distance_filter(df.withColumn("junk_status", F.col("lon") == 0), 0.01, 50).orderBy("fixtime").collect()
    assert [r.junk_status for r in far] == [True, False, False]
    assert relocations.remove_filtered(relocations.reset(fast and df)).count() == 4


def test_coordinate_filter(spark):
    df = fixes(spark, [("a", t(0), 0.0, 0.0, ""), ("a", t(1), 10.0, 5.0, ""), ("a", t(2), None, None, ""), ("a", t(3), 180.0, 0.0, "")])
    assert relocations.in_box(df, -180, 180, -90, 90).count() == 2
    assert relocations.box_filter(df).where("junk_status").count() == 1


SEGMENTS = "groupby_col string, segment_start timestamp_ntz, segment_end timestamp_ntz, heading double, x1 double, y1 double, x2 double, y2 double"


def test_turn_angles(spark):
    rows = [("a", t(i), t(i + 1), float(h), float(i), 0.0, float(i + 1), 0.0) for i, h in enumerate([0, 90, 120, 60, 300])]
    df = spark.createDataFrame(rows, SEGMENTS)
    assert [r.turn_angle for r in trajectory.turn_angles(df).orderBy("segment_start").collect()] == [None, 90, 30, -60, -120]
    left = trajectory.turn_angles(df.where("heading <> 120")).orderBy("segment_start").collect()
    assert [r.turn_angle for r in left] == [None, 90, None, -120]


def test_segment_bounds_must_be_ordered(spark):
    with pytest.raises(ValueError):
        trajectory.segment_filter(trajectory.from_fixes(fixes(spark, PATH)), length=(5, 5))


def test_resampling_round_trip(spark):
    segments = trajectory.from_fixes(fixes(spark, PATH))
    up = trajectory.upsample(segments, 1800).orderBy("fixtime").collect()
    assert [r.fixtime for r in up] == [t(i / 2) for i in range(5)]
    assert up[1].lon == pytest.approx(36.005) and up[3].lat == pytest.approx(0.005)
    assert trajectory.to_fixes(segments).count() == 3
    assert trajectory.speed_steps(segments).count() == 8
    many = fixes(spark, [("a", t(i / 4), 36.0 + i / 100, 0.0, "") for i in range(20)] + [("a", t(30), 37.0, 0.0, "")])
    down = trajectory.downsample(many, 3600, 60).orderBy("fixtime").collect()
    assert [r.fixtime for r in down] == [t(0), t(1), t(2), t(3), t(4)] and [r.extra__burst for r in down] == [0] * 5


@pytest.mark.parametrize("chunk_hours,step,tolerance", [(1, 1.5, 0), (5, 2, 0.5), (24, 30, 1), (3, 0.01, 1)])
def test_walks_in_chunks(spark, chunk_hours, step, tolerance):
    """The walk over chunks equals the walk of a whole history, over gaps, chunks without fixes, long and short steps."""
    rng = random.Random(chunk_hours)
    rows = [("one", t(5), 1.0, 1.0, ""), (None, t(1), 0.0, 0.0, "")]
    for s in "abc":
        at = 0.0
        for k in range(150):
            at += rng.choice([0, 0.1, 0.5, 1, 1.3] + [40] * (k % 50 == 0))
            rows.append((s, t(at), k / 100, 0.0, ""))
    low, high = max((step - tolerance) * 3600, 1e-6), (step + tolerance) * 3600
    want = []
    for s in "abc":
        times = sorted({r[1] for r in rows if r[0] == s})
        i = burst = 0
        while (j := next((k for k in range(i + 1, len(times)) if (times[k] - times[i]).total_seconds() >= low - 1e-9), None)) is not None:
            want.append((s, times[i], burst))
            burst += (times[j] - times[i]).total_seconds() > high
            i = j
    got = trajectory.downsample(fixes(spark, rows), step * 3600, tolerance * 3600, chunk_us=int(chunk_hours * 3600e6)).collect()
    assert sorted((r.groupby_col, r.fixtime, r.extra__burst) for r in got) == sorted(want)


def test_displacement_and_clusters(spark):
    segments = trajectory.from_fixes(fixes(spark, PATH))
    r = trajectory.displacement(segments).first()
    assert r.displacement == pytest.approx(math.hypot(1113.19, 1105.74), rel=1e-4) and r.tortuosity == pytest.approx(math.sqrt(2), rel=1e-3)
    near = fixes(spark, [("a", t(i), 36.0 + (i % 2) * 1e-5, 0.0, "") for i in range(10)])
    got = relocations.immobility(near).first()
    assert got.status == "immobile" and got.share == 1.0
    assert relocations.immobility(near.limit(2)).first().status == "insufficient"
    assert relocations.cluster_stats(near, 13).first().cluster_radius == pytest.approx(0.556, abs=0.01)


def test_points_in_regions(spark):
    square = lambda a, b: [{"x": a, "y": a}, {"x": b, "y": a}, {"x": b, "y": b}, {"x": a, "y": b}]
    regions = spark.createDataFrame([(1, "one", square(0.0, 2.0)), (2, "", square(1.0, 3.0))], "pk long, name string, ring array<struct<x:double,y:double>>")
    points = spark.createDataFrame([(1, 1.5, 1.5), (2, 9.0, 9.0), (3, 0.0, 1.0)], "id int, lon double, lat double")
    got = sorted((r.id, r.spatial_index) for r in spatial.points_in_regions(points, regions).collect())
    assert got == [(1, "2"), (1, "one"), (3, "one")]


def test_crossings_at_joints_and_regions(spark):
    """A crossing at the joint of two pieces counts once; regions hold the ends of a segment, or none does."""
    pieces = [(1, "f", "high", 0.0, -1.0, 0.0, 0.0), (1, "f", "high", 0.0, 0.0, 0.0, 1.0), (2, "g", "low", 0.5, -1.0, 0.5, 1.0)]
    fences = spark.createDataFrame(pieces, "fence_id int, fence_name string, warn_level string, ax double, ay double, bx double, by double")
    rows = [("a", t(0), t(1), -1.0, 0.0, 1.0, 0.0), ("b", t(0), t(1), -5.0, 0.25, 0.25, 0.25), ("c", t(0), t(1), 3.0, 0.0, 4.0, 0.0)]
    df = spark.createDataFrame(rows, "groupby_col string, segment_start timestamp_ntz, segment_end timestamp_ntz, x1 double, y1 double, x2 double, y2 double")
    ring = lambda a, b: [{"x": x, "y": y} for x, y in [(a, -1.0), (b, -1.0), (b, 1.0), (a, 1.0)]]
    regions = spark.createDataFrame([(7, "r", ring(-2.0, 0.1)), (8, "r", ring(-3.0, 2.0))], "pk long, name string, ring array<struct<x:double,y:double>>")
    crossed = spatial.fence_crossings(df, fences)
    assert sorted((r.groupby_col, r.fence_id, r.warn_level, r.cross_x) for r in crossed.collect()) == [("a", 1, "high", 0.0), ("a", 2, "low", 0.5), ("b", 1, "high", 0.0)]
    got = {(r.groupby_col, r.fence_id): (r.start_region_ids, r.end_region_ids, r.crossing_time) for r in spatial.region_lists(crossed, regions).collect()}
    assert got[("a", 1)] == (["7", "8"], ["8"], t(0.5)) and got[("a", 2)][:2] == (["7", "8"], ["8"]) and got[("b", 1)][:2] == (None, ["8"])


def test_segments_are_cut_by_regions(spark):
    ring = [{"x": x, "y": y} for x, y in [(0.0, 0.0), (3.0, 0.0), (3.0, 3.0), (2.0, 3.0), (2.0, 1.0), (1.0, 1.0), (1.0, 3.0), (0.0, 3.0)]]
    regions = spark.createDataFrame([(1, "u", ring)], "pk long, name string, ring array<struct<x:double,y:double>>")
    rows = [("through both arms", -1.0, 2.0, 4.0, 2.0), ("inside", 0.2, 0.5, 2.8, 0.5), ("half", -1.0, 0.5, 1.0, 0.5)]
    df = spark.createDataFrame([(*r, 10.0, 100.0, 1.0) for r in rows], "id string, x1 double, y1 double, x2 double, y2 double, speed_kmhr double, dist_meters double, timespan_seconds double")
    got = {r.id: r for r in spatial.segments_in_regions(df, regions, tile=0.7).collect()}
    assert set(got) == {"inside", "half"}
    assert got["half"].x1 == pytest.approx(0) and got["half"].timespan_seconds == pytest.approx(got["half"].dist_meters / 10000 * 3600)


def test_line_density_conserves_totals(spark):
    rows = [(0.5, 0.5, 37.2, 11.9, 3600.0), (-3.0, 4.0, -3.0, 4.0, 5.0), (2.5, 2.5, 2.5, 9.5, 600.0)]
    df = spark.createDataFrame(rows, "x1 double, y1 double, x2 double, y2 double, v double")
    total = lambda d: sum(r.density for r in d.collect())
    assert total(density.line_density(df, 5.0)) == pytest.approx(math.hypot(36.7, 11.4) + 7)
    assert total(density.line_density(df, 5.0, "v")) == pytest.approx(4200)
    points = spark.createDataFrame([(1.0, 1.0, 2), (2.0, 2.0, 534), (7.0, 1.0, 0), (5.0, 1.0, 9)], "x double, y double, v int")
    assert sorted(r.density for r in density.point_density(points, "x", "y", 5.0).collect()) == [1, 2]
    assert [r.density for r in density.point_density(points, "x", "y", 5.0, "v").collect()] == [536]


def test_percentile_levels(spark):
    df = spark.createDataFrame([("g", i, float(i)) for i in range(1, 6)], "g string, id int, v double")
    level = lambda levels: [r.percentile for r in density.percentile_levels(df, "v", levels, ["g"]).orderBy("id").collect()]
    assert level([10, 50, 90]) == [90, 90, 50, 50, 10]
    assert level([90]) == [90] * 5 and level([10]) == [None] * 4 + [10]
    assert density.percentile_levels(df, "v", [], ["g"]) is df


def plain_cuts(values, levels):
    kept = sorted(v for v in values if v is not None and not math.isnan(v))
    total, sums = sum(kept), list(itertools.accumulate(kept))
    return [kept[min(range(len(kept)), key=lambda i: (abs(sums[i] - total * (1 - p / 100)), i))] if kept else None for p in levels]


@pytest.mark.parametrize("parts", [2, 7, 512])
def test_cuts_of_groups_in_parts(spark, parts):
    """Missing values count for nothing; ties, zeros, values below zero and groups of one value or of none have cuts too."""
    rng = random.Random(parts)
    groups = {"many": [float(rng.randint(1, 400)) for _ in range(900)], "ties": [3.0] * 50 + [5.0] * 50, "zero": [0.0] * 5 + [1.0], "none": [None, float("nan")], "one": [2.0, None], None: [4.0, 1.0, 9.0], "low": [-3.0, -1.0, 2.0, 8.0]}
    rows = [(g, v) for g, vs in groups.items() for v in vs]
    df = spark.createDataFrame(rows, "g string, v double")
    levels = [10.0, 50.0, 90.0, 99.0]
    got = {r.g: [r[f"cut_{i}"] for i in range(4)] for r in density.mass_cuts(df, "v", levels, ["g"], parts=parts).collect()}
    assert got == {g: plain_cuts(vs, levels) for g, vs in groups.items() if g != "none"}
    seen = density.percentile_levels(df, "v", levels, ["g"]).collect()
    assert len(seen) == len(rows) and all(r.percentile is None for r in seen if r.v is None or math.isnan(r.v))
    area = {(r.g, r.percentile): r.cells for r in density.percentile_area(df, "v", levels, ["g"], 2.0).collect()}
    assert area == Counter((g, p) for g, v in rows if v is not None and not math.isnan(v) for p, cut in zip(levels, plain_cuts(groups[g], levels)) if v >= cut)


def test_elliptical_density(spark):
    df = spark.createDataFrame([(0.0, 0.0, 1000.0, 0.0, 3600.0)], "x1 double, y1 double, x2 double, y2 double, timespan_seconds double")
    got = {(r.ix, r.iy): r.density for r in ranges.elliptical_density(df, 250.0, 4.0, 1.5, 1.2).collect()}
    assert sum(got.values()) == pytest.approx(1) and max(got, key=got.get)[1] in (-1, 0)
    assert got[(0, 0)] == pytest.approx(got[(3, 0)]) and got[(1, 2)] == pytest.approx(got[(1, -3)])


def test_hull_growth(spark):
    d = dt.date
    rows = [("a", d(2024, 1, 1), 0.0, 0.0), ("a", d(2024, 1, 1), 1000.0, 0.0), ("a", d(2024, 1, 2), 0.0, 1000.0), ("a", d(2024, 1, 3), 1000.0, 1000.0), ("a", d(2024, 1, 3), 500.0, 500.0)]
    got = ranges.hull_growth(spark.createDataFrame(rows, "groupby_col string, day date, x double, y double")).orderBy("day").collect()
    assert [r.area_km2 for r in got] == [0.0, 0.5, 1.0]


def test_hulls_grow_across_chunks(spark):
    """Chunks of months equal one walk over all days, for subjects of one month and of many."""
    rng, zero = random.Random(3), dt.date(2023, 11, 1)
    rows = [(s, zero + dt.timedelta(days=rng.choice([0, 1, 40, 41, 100, 300, 301, 420, 700]) if s != "b" else 5), rng.gauss(0, 900), rng.gauss(0, 900)) for s in "abc" for _ in range(60)]
    rows += [("d", zero, 1.0, 1.0), ("d", zero + dt.timedelta(days=90), 5.0, 5.0), (None, zero, 0.0, 0.0), ("e", None, 0.0, 0.0)]
    got = ranges.hull_growth(spark.createDataFrame(rows, "groupby_col string, day date, x double, y double")).collect()
    want = {}
    for s in "abcd":
        seen = np.empty((0, 2))
        for day in sorted({r[1] for r in rows if r[0] == s}):
            seen = np.r_[seen, [r[2:] for r in rows if r[:2] == (s, day)]]
            h = ranges.hull(seen)
            want[s, day] = abs(np.dot(h[:, 0], np.roll(h[:, 1], -1)) - np.dot(h[:, 1], np.roll(h[:, 0], -1))) / 2e6 if len(h) > 2 else 0.0
    assert {(r.groupby_col, r.day): r.area_km2 for r in got} == pytest.approx(want)


def test_walks_of_small_histories_share_calls(spark):
    """Many subjects, also where a history is cut by batches of three rows, go through Python as streams of rows."""
    rows = [(f"s{i}", dt.datetime(2024, 1, 30) + dt.timedelta(hours=7 * k), 0.0, 0.0) for i in range(9) for k in range(1 + i)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = trajectory.downsample(spark.createDataFrame(rows, "groupby_col string, fixtime timestamp_ntz, lon double, lat double"), 14 * 3600)
        assert "FlatMapGroups" not in got._jdf.queryExecution().toString()
        found = sorted((r.groupby_col, (r.fixtime - dt.datetime(2024, 1, 30)).total_seconds() / 3600, r.extra__burst) for r in got.collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    # every second fix; the last one of a walk is not returned
    assert found == sorted((f"s{i}", 14.0 * k, 0) for i in range(9) for k in range(i // 2))


def test_small_hulls_cost_no_call_each(spark):
    """Days and subjects go through Python as streams of rows, also in batches of two, not as a call for each of them."""
    d = dt.date(2024, 1, 31)
    rows = [(f"s{i}", d + dt.timedelta(days=k), float(x), float(y)) for i in range(20) for k in range(3) for x, y in ((k, 0), (0, k), (k, k), (0, 0))]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        got = ranges.hull_growth(spark.createDataFrame(rows, "groupby_col string, day date, x double, y double"))
        assert "FlatMapGroups" not in got._jdf.queryExecution().toString()
        assert {(r.groupby_col, r.day): r.area_km2 for r in got.collect()} == pytest.approx({(f"s{i}", d + dt.timedelta(days=k)): k * k / 1e6 for i in range(20) for k in range(3)})
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_distances_to_shapes(spark):
    """Points, lines and polygons, crossed, touched, around and far away; the nearest of all, also far beyond the first tiles."""
    path = lambda *p: [{"x": float(x), "y": float(y)} for x, y in p]
    rows = [(1, "point", path((3, 0))), (2, "line", path((0, 1), (2, 1), (2, 5))), (3, "polygon", path((-9, -9), (-5, -9), (-5, -5), (-9, -5))), (4, "line", path((500, 0), (500, 9)))]
    features = spark.createDataFrame(rows, "feature_id int, kind string, path array<struct<x:double,y:double>>")
    segments = [("a", 0.0, 0.0, 1.0, 0.0), ("b", 1.0, 0.0, 1.0, 2.0), ("c", -8.0, -8.0, -7.0, -8.0), ("d", -4.0, -7.0, -3.0, -7.0), ("e", 480.0, 3.0, 480.0, 4.0), ("f", 3.0, 0.0, 3.0, 0.0)]
    df = spark.createDataFrame(segments, "id string, x1 double, y1 double, x2 double, y2 double")
    got = {(r.id, r.feature_id): r.proximity for r in spatial.proximity(df, features).collect()}
    assert len(got) == 24
    want = {("a", 1): 2, ("a", 2): 1, ("b", 2): 0, ("c", 3): 0, ("d", 3): 1, ("e", 4): 20, ("f", 1): 0, ("f", 2): math.sqrt(2), ("a", 3): math.hypot(5, 5)}
    assert {k: got[k] for k in want} == pytest.approx(want)
    near = {r.id: (r.feature_id, r.proximity) for r in spatial.nearest_features(df, ["id"], features, tile=0.3).collect()}
    assert near == {i: min((got[i, f], f) for f in range(1, 5))[::-1] for i in "abcdef"}
    assert spatial.nearest_features(df, ["id"], features.limit(0)).collect() == []


def test_grid_over_polygons(spark):
    """Boxes within, around, across and beside a ring, on a shifted grid too."""
    ring = lambda *p: [{"x": x, "y": y} for x, y in p]
    cells = lambda rings, *a: {(r.ix, r.iy) for r in spatial.mesh_over(spark.createDataFrame([(r,) for r in rings], "ring array<struct<x:double,y:double>>"), *a).collect()}
    assert cells([ring((0.5, 0.5), (3.5, 0.5), (0.5, 3.5))], 1.0, 1.0) == {(i, j) for i in range(4) for j in range(4) if i + j <= 4}
    assert cells([ring((0.2, 0.2), (0.4, 0.2), (0.3, 0.4)), ring((0.1, 0.1), (0.3, 0.1), (0.2, 0.3))], 1.0, 1.0) == {(0, 0)}
    assert cells([ring((0.2, 0.2), (0.4, 0.2), (0.3, 0.4))], 1.0, 1.0, (0.3, 0.0)) == {(-1, 0), (0, 0)}
    u = ring((0.1, 0.1), (2.9, 0.1), (2.9, 2.9), (2.1, 2.9), (2.1, 0.9), (0.9, 0.9), (0.9, 2.9), (0.1, 2.9))
    assert cells([u], 1.0, 1.0) == {(0, 0), (1, 0), (2, 0), (0, 1), (2, 1), (0, 2), (2, 2)}


def test_weibull_fit_of_slow_speeds_and_of_none(spark):
    rows = spark.range(20000).select((3e-4 * F.pow(-F.log((F.col("id") + 0.5) / 20000), F.lit(1 / 0.8))).alias("v"))
    assert ranges.weibull_fit(rows, "v") == pytest.approx((0.8, 3e-4), rel=1e-2)
    assert ranges.weibull_fit(rows.limit(0), "v") is None and ranges.weibull_fit(rows.selectExpr("0.0 AS v"), "v") is None


def test_weibull_fit(spark):
    rows = spark.range(20000).select((2.0 * F.pow(-F.log((F.col("id") + 0.5) / 20000), F.lit(1 / 1.5))).alias("v"))
    assert ranges.weibull_fit(rows, "v") == pytest.approx((1.5, 2.0), rel=1e-2)


def test_sun(spark):
    noon, midnight = dt.datetime(2024, 3, 20, 12), dt.datetime(2024, 3, 20, 0)
    df = spark.createDataFrame([(noon, 0.0, 0.0), (midnight, 0.0, 0.0), (noon, 0.0, 60.0)], "t timestamp_ntz, lon double, lat double")
    got = [r[0] for r in df.select(sun.altitude(sun.micros("t"), F.col("lon"), F.col("lat"))).collect()]
    assert got[0] > 87 and got[1] < -87 and got[2] == pytest.approx(30, abs=0.3)
    dusk, dawn = sun.night_window(F.lit(19802), F.lit(0.0), F.col("lat"))
    r = spark.createDataFrame([(0.0,), (89.0,)], "lat double").select(((dusk - 19802 * sun.DAY) / sun.HOUR).alias("a"), ((dawn - 19802 * sun.DAY) / sun.HOUR).alias("b")).collect()
    assert r[0].a == pytest.approx(18.5, abs=0.2) and r[0].b == pytest.approx(29.7, abs=0.2)


@pytest.mark.parametrize("lon", [0.0, 37.0, -120.0])
def test_night_day_ratio_of_equal_speed(spark, lon):
    noon = dt.datetime(2024, 3, 20, 12) - dt.timedelta(hours=lon / 15)
    rows = [("a", noon + dt.timedelta(hours=i), noon + dt.timedelta(hours=i + 1), lon, 0.0, lon, 0.0, 1000.0, 3600.0) for i in range(24)]
    df = spark.createDataFrame(rows, "groupby_col string, segment_start timestamp_ntz, segment_end timestamp_ntz, x1 double, y1 double, x2 double, y2 double, dist_meters double, timespan_seconds double")
    got = sun.night_day_ratio(df).first()
    assert got.ratio == pytest.approx(1, abs=1e-6) and got.n_days == 1
