import datetime as dt
import itertools
import statistics

import pytest
from pyspark.sql import functions as F

from faunaflow.operators import classify, columns, events, network, seasons, summary, timekeys, trend
from faunaflow.operators.summary import Metric
from faunaflow.sources import tables

N = dt.datetime


def values(spark, *v):
    return spark.createDataFrame([(float(x),) for x in v], "v double")


SPREAD_OUT = [2, 3, 8, 11, 40]


def brute_classes(breaks):
    """Of each value the first break that is not below it."""
    return [next(b for b in breaks if b >= v) for v in SPREAD_OUT]


def brute_jenks(values_, k):
    """Ends of the classes, from all ways to cut."""
    def cost(cuts):
        parts = [values_[i:j] for i, j in zip((0, *cuts), (*cuts, len(values_)))]
        return sum(sum((x - statistics.mean(p)) ** 2 for x in p) for p in parts)

    best = min(itertools.combinations(range(1, len(values_)), k - 1), key=cost)
    return [values_[c - 1] for c in (*best, len(values_))]


def test_classes_by_each_rule(spark):
    df = values(spark, *SPREAD_OUT)
    mean, dev = statistics.mean(SPREAD_OUT), statistics.stdev(SPREAD_OUT)
    rules = {
        ("equal_interval", 3): [2 + 38 / 3, 2 + 38 * 2 / 3, 40], ("quantile", 2): [8, 40], ("std_mean", None): [mean - 2 * dev, mean - dev, mean + dev, mean + 2 * dev],
        ("max_breaks", 3): [(3 + 8) / 2, (11 + 40) / 2, 40], ("fisher_jenks", 3): brute_jenks(SPREAD_OUT, 3), ("fisher_jenks", 2): brute_jenks(SPREAD_OUT, 2),
    }
    for (rule, k), want in rules.items():
        breaks = classify.breaks(df, "v", rule, **({} if k is None else {"k": k}))
        got = [r.c for r in classify.classify(df, "v", "c", breaks).orderBy("v").collect()]
        assert got == pytest.approx(brute_classes(want), abs=1e-6), rule
    named = classify.classify(df, "v", "c", classify.breaks(df, "v", "equal_interval", k=2), ranges=True).orderBy("v").collect()
    assert (named[0].c, named[-1].c) == ("2.0 - 21.0", "21.0 - 40.0")
    with pytest.raises(ValueError):
        classify.classify(df, "v", "c", [8.0, 40.0], labels=["low"])
    with pytest.raises(ValueError):
        classify.breaks(df, "v", "thirds")


def test_widest_gaps_across_parts(spark):
    many = sorted({(i * 7919) % 100_003 / 7 for i in range(3000)})
    gaps = sorted(((b - a, a, b) for a, b in zip(many, many[1:])), reverse=True)[:9]
    got = classify.breaks(values(spark, *many, *many[:50]), "v", "max_breaks", k=10)
    assert got == pytest.approx(sorted((a + b) / 2 for _, a, b in gaps) + [many[-1]])


def test_remainders_have_the_sign_of_the_divisor(spark):
    pairs = [(7, 3), (7, -3), (-7, 3), (-7, -3), (6, -3), (0, 5), (5, 0)]
    got = columns.arithmetic(spark.createDataFrame(pairs, "a long, b long"), "a", "b", "m", "modulo").collect()
    assert [r.m for r in got] == [a % b if b else None for a, b in pairs]
    floats = columns.arithmetic(spark.createDataFrame([(7.5, -2.0), (-7.5, 2.0)], "a double, b double"), "a", "b", "m", "modulo").collect()
    assert [r.m for r in floats] == [7.5 % -2.0, -7.5 % 2.0]


def test_jenks_over_many_values(spark):
    df = spark.range(5000).select((F.col("id") + F.when(F.col("id") >= 2500, 100000).otherwise(0)).cast("double").alias("v"))
    assert classify.breaks(df, "v", "natural_breaks", k=2)[0] < 2600


def test_summary_metrics(spark):
    rows = [("elk", 40, 7), ("owl", 10, 1), ("elk", 25, 2), (None, 5, 9), ("fox", 10, 4), ("owl", 12, 8)]
    df = spark.createDataFrame([(g, a, o, o % 2) for g, a, o in rows], "g string, a int, o int, p int")
    metrics = [
        Metric("s", "sum", "a"), Metric("lo", "min", "a"), Metric("hi", "max", "a"), Metric("m", "mean", "a"), Metric("mid", "median", "a"), Metric("n", "count", "a"),
        Metric("km", "sum", "a", units=("m", "km")), Metric("u", "unique", "g", order="o"), Metric("r", "ratio", "a", by="o", scale=10)]
    got = summary.summarize(df, metrics).first()
    a = [x for _, x, _ in rows]
    want = (sum(a), min(a), max(a), statistics.mean(a), statistics.median(a), len(a), sum(a) / 1000, "owl, elk, fox", 10 * sum(a) / sum(o for _, _, o in rows))
    assert all(x == (y if isinstance(y, str) else pytest.approx(y)) for x, y in zip(got, want))
    parts = {r.p: r.u for r in summary.summarize(df, metrics, ["p"]).collect()}
    assert parts == {0: "elk, fox, owl", 1: "owl, elk"}
    empty = summary.summarize(df.where("a > 99"), metrics).first()
    assert empty.s == 0 and empty.r is None
    assert spark.range(1).select(columns.half_even(F.lit(2.5), 0), columns.half_even(F.lit(3.5), 0)).first() == (2.0, 4.0)


def test_encounter_rates(spark):
    seg = spark.createDataFrame([("A", "p1", "d1", 3000.0, 3600.0), ("A", "p2", "d1", 2000.0, 3600.0)], "grp string, patrol_id string, segment_start_date string, dist_meters double, timespan_seconds double")
    seen = spark.createDataFrame([("A", "x"), ("A", "y")], "grp string, event_type string")
    r = summary.encounter_rates(seg.unionByName(seg.withColumn("grp", F.lit("B"))), seen, ["grp"]).orderBy("grp").collect()
    assert (r[0].encounters, r[0].hours, r[0].per_hour, r[0].km, r[0].per_km, r[0].per_patrol) == (2, 2.0, 1.0, 5.0, 0.4, 1.0)
    assert r[1].encounters == 0 and r[1].per_km == 0.0


def test_coverage(spark):
    df = spark.createDataFrame([(0.0, 0.0, 1000.0, 0.0), (0.0, 0.0, 1000.0, 0.0)], "x1 double, y1 double, x2 double, y2 double")
    merged = summary.coverage_cells(df, 500.0, 10.0).count() * 100 / 1e6
    one = df.select((summary.swath_area(F.lit(1000.0), 500.0) / 1e6).alias("a")).first().a
    assert one == pytest.approx(0.697, abs=0.01) and merged == pytest.approx(one, abs=0.01)


def test_time_keys(spark):
    df = spark.createDataFrame([(N(2022, 1, 13, 17),), (N(2022, 12, 26, 17),), (N(2022, 1, 17),)], "t timestamp_ntz")
    assert [str(r[0]) for r in df.select(timekeys.modis_begin("t")).collect()] == ["2022-01-17", "2023-01-01", "2022-01-17"]
    months = timekeys.add_temporal_keys(df, "t", ["%B"]).collect()
    assert [r["TemporalGrouper_%B"] for r in months] == ["January", "December", "January"]
    spans = timekeys.intervals(spark, "2010-01-01 12:00:00", 6, 12).orderBy("left").collect()
    assert all(a.right == b.left for a, b in zip(spans, spans[1:]))
    late = timekeys.intervals(spark, "2010-01-01 12:00:00", 3, 48, 24).orderBy("left").collect()
    assert late[1].left == late[0].right - dt.timedelta(days=1)
    edge = spark.createDataFrame([(late[0].right,)], "t timestamp_ntz")
    table = timekeys.intervals(spark, "2010-01-01 12:00:00", 3, 48, 24)
    assert [timekeys.match_intervals(edge, "t", table, c).count() for c in ("left", "right", "both", "neither")] == [2, 2, 3, 1]


def test_week_of_month(spark):
    df = spark.createDataFrame([(N(2024, 1, 1),), (N(2024, 1, 7, 23),), (N(2024, 1, 8),)], "t timestamp_ntz")
    assert [r[0] for r in df.select(summary.week_of_month("t")).collect()] == [1, 1, 2]


def test_sql_is_one_select(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "b", 5), (3, "b", 7)], "id int, g string, created_at int")
    got = columns.run_sql(df, "SELECT g, sum(created_at) AS s, CASE WHEN max(created_at) IS NULL THEN 'none' ELSE 'some' END AS c FROM df GROUP BY g HAVING count(*) > 0 ORDER BY g;")
    assert [tuple(r) for r in got.collect()] == [("a", None, "none"), ("b", 12, "some")]
    assert columns.run_sql(df, " ") is df
    words = columns.run_sql(spark.createDataFrame([("df", 1), ("x;y", 2), ("{z}", 3)], "b string, set int"), "SELECT set, replace(b, 'x', 'drop -- ') AS r FROM df WHERE b IN ('df', 'x;y', '{z}') ORDER BY `set` ; ")
    assert [tuple(r) for r in words.collect()] == [(1, "df"), (2, "drop -- ;y"), (3, "{z}")]
    for bad in ("DROP TABLE df", "SELECT 1; SELECT 2", "SELECT * FROM df WHERE (SELECT 1) = 1 UNION DELETE", "SELECT 1 -- no", "SELECT /* no */ 1", "SELECT * FROM df REPLACE", "WITH a AS (SELECT 1) INSERT INTO t SELECT * FROM a"):
        with pytest.raises(ValueError):
            columns.run_sql(df, bad)


def test_headers_and_maps(spark):
    df = spark.createDataFrame([(1, 2, 3)], "x__a int, A int, x__b_c int")
    assert columns.strip_prefix(df, "x__").columns == ["a", "A_1", "b_c"]
    assert columns.strip_prefix(df, "x__", "keep_original").columns == ["x__a", "A", "b_c"]
    with pytest.raises(ValueError):
        columns.strip_prefix(df, "x__", "error")
    with pytest.raises(KeyError):
        columns.map_columns(df, drop=["none"])
    assert columns.map_columns(df, retain=["none", "A"], strict=False).first() == (None, 2)
    v = spark.createDataFrame([("a",), ("z",), (None,)], "v string")
    got = lambda *a: [r.v for r in columns.map_values(v, "v", {"a": "A"}, *a).collect()]
    assert got() == ["A", "z", None] and got("remove") == ["A", None, None] and got("replace", "?") == ["A", "?", "?"]
    assert [r.v for r in columns.compare(v, "v", "ne", "a").collect()] == ["z", None]


def test_json_details(spark):
    df = spark.createDataFrame([(1, '{"a": 1, "b": {"c": "x"}}'), (2, '{"d": true}'), (3, None)], "id int, j string")
    flat = columns.flatten_json(df, "j").orderBy("id").collect()
    assert flat[0].j__b__c == "x" and flat[1].j__d is True and flat[2].j__a is None
    bad = columns.decode_details(spark.createDataFrame([('{"a": "1"}',), ("{oops",), ("",), (None,)], "j string"), "j").collect()
    assert [r.j for r in bad] == [{"a": "1"}, {}, {}, {}] and [r.bad_json for r in bad] == [False, True, False, False]


def test_nested_patrols_and_names(spark):
    flat = spark.createDataFrame([("p", 1, 1, "l", 5, "x", N(2024, 1, 1), 1.0, 2.0), ("p", 1, 2, "l", 6, "y", None, 1.0, 2.0)], "patrol_id string, serial_number int, segment_id int, leader_id string, event_id int, event_type string, time timestamp_ntz, lon double, lat double")
    nested = events.nest_patrols(flat)
    assert nested.count() == 1 and [r.event_id for r in events.unpack_patrol_events(nested).collect()] == [5]
    types = spark.createDataFrame([("x", "Same", "Cat", "c"), ("y", "Same", None, "c"), ("z", "Other", None, "c")], "value string, display string, category_display string, category_value string")
    seen = spark.createDataFrame([("x",), ("y",), ("z",), ("w",)], "event_type string")
    name = lambda mode: {r.event_type: r.event_type_display for r in events.display_names(seen, types, mode).collect()}
    assert name("never") == {"x": "Same", "y": "Same", "z": "Other", "w": "w"}
    assert name("duplicates") == {"x": "Same (Cat)", "y": "Same (c)", "z": "Other", "w": "w"}
    assert name("always") == {"x": "Same (Cat)", "y": "Same (c)", "z": "Other (c)", "w": "w (w)"}
    # only types that occur count
    assert {r.event_type_display for r in events.display_names(seen.where("event_type = 'x'"), types, "duplicates").collect()} == {"Same"}


def test_details_are_resolved_once(spark):
    """Sub-forms and lists stand in the plan once each, not once for each use of what comes of them."""
    table = spark.createDataFrame([("t", "a", None, 0, "A", None, None)], "event_type string, key string, sub_key string, place int, title string, code string, label string")
    rows = events.resolved_details(spark.createDataFrame([("t", '{"a": 1}')], "event_type string, event_details string"), table)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") <= 4


def test_titles_and_nested_details(spark):
    """Keys of one title keep the last value; codes are resolved in values, lists and sub-forms; other types keep their details."""
    fields = [("t", "a", None, 1, "A", None, None), ("t", "b", None, 0, "A", None, None), ("t", "c", None, 2, "See \"c\"", None, None), ("t", "c", "s", 0, "S", None, None)]
    fields += [("t", "a", None, 0, None, "1", "one"), ("t", "c", "s", 0, None, "x", "EX"), ("t", "c", None, 0, None, "p", "Pee")]
    table = spark.createDataFrame(fields, "event_type string, key string, sub_key string, place int, title string, code string, label string")
    flat = spark.createDataFrame([(1, "t", '{"b": "2", "a": "1"}'), (2, "u", '{"a": "1"}'), (3, "t", None)], "id int, event_type string, j string")
    flat = flat.selectExpr("id", "event_type", "from_json(j, 'map<string,string>') AS event_details")
    got = {r.id: r.event_details for r in events.titled_details(flat, table.where("sub_key is null")).collect()}
    assert got == {1: {"A": "one"}, 2: {"a": "1"}, 3: None}
    texts = ['{"a":1,"z":null,"c":[{"s":"x","s2":{"k":[1]}},{"s":2}],"updates":1}', '{"c":["p","q",3],"b":"é","a":"1"}', "{}", "oops", None, '{"c":[]}', '{"a":1,"updates":2}']
    nested = spark.createDataFrame([(k, "u" if k == 6 else "t", x) for k, x in enumerate(texts)], "id int, event_type string, event_details string")
    got = {r.id: r.event_details for r in events.resolved_details(nested, table).collect()}
    assert got == {0: '{"A":"one","See \\"c\\"":[{"S":"EX","s2":{"k":[1]}},{"S":2}],"z":null}', 1: '{"A":"one","See \\"c\\"":["Pee","q",3]}', 2: "{}", 3: "oops", 4: None, 5: '{"See \\"c\\"":[]}', 6: texts[6]}
    plain = {r.id: r.event_details for r in events.resolved_details(nested, table, titles=False, ordered=False).collect()}
    assert plain[0] == '{"a":"one","z":null,"c":[{"s":"EX","s2":{"k":[1]}},{"s":2}],"updates":1}'


def test_selections_by_type_table_state_and_change(spark):
    at = N(2024, 1, 5)
    patrols = spark.createDataFrame([("t", "s", at, at, 1)], "patrol_type string, state string, start_time timestamp_ntz, end_time timestamp_ntz, serial_number int")
    known = spark.createDataFrame([("t",), ("unused",)], "value string")
    assert events.select_patrols(patrols, "2024-01-01", "2024-01-09", ["unused"], known=known).collect() == []
    with pytest.raises(ValueError):
        events.select_patrols(patrols, "2024-01-01", "2024-01-09", ["other"], known=known)
    rows = spark.createDataFrame([(k, "x", at, s, c, N(2024, 2, u), 1.0, 2.0) for k, (s, c, u) in enumerate([("new", "a", 1), ("new", "b", 3), ("done", "a", 3), (None, None, 3)])], "id int, event_type string, time timestamp_ntz, state string, event_category string, updated_at timestamp_ntz, lon double, lat double")
    pick = lambda **k: {r.id for r in events.select_events(rows, None, "2024-01-01", "2024-01-09", ["id"], **k).collect()}
    assert pick() == {0, 1, 2, 3} and pick(states=["new"]) == {0, 1} and pick(categories=["a"]) == {0, 2} and pick(updated_since="2024-02-02") == {1, 2, 3}


def test_patrol_tracks_of_open_and_overlapping_patrols(spark):
    fixes = spark.createDataFrame([("s", N(2024, 1, d)) for d in range(1, 8)], "subject_id string, fixtime timestamp_ntz")
    patrols = spark.createDataFrame([("a", "s", N(2024, 1, 2), N(2024, 1, 4)), ("b", "s", N(2024, 1, 4), None), ("c", None, N(2024, 1, 1), None), ("d", "s", None, None)], "patrol_id string, leader_id string, start_time timestamp_ntz, end_time timestamp_ntz")
    got = [(r.groupby_col, r.fixtime.day) for r in events.patrol_tracks(fixes, patrols).collect()]
    assert sorted(got) == [("a", 2), ("a", 3), ("a", 4), ("b", 4), ("b", 5), ("b", 6), ("b", 7)]
    with pytest.raises(ValueError):
        events.select_patrols(patrols.selectExpr("'t' as patrol_type", "'s' as state", "start_time", "end_time", "1 as serial_number"), "2024-01-01", "2024-01-09", ["none"])


def test_images_and_seasons(spark):
    images = spark.createDataFrame([(f"i{d}", N(2024, 1, d)) for d in (1, 11, 21)], "img_id string, img_time timestamp_ntz")
    rows = spark.createDataFrame([(1, N(2024, 1, 5)), (2, N(2024, 1, 11)), (3, N(2024, 2, 1))], "id int, t timestamp_ntz")
    near = {r.id: r.images for r in seasons.nearest_images(rows, "id", "t", images, 1, 1).collect()}
    assert near == {1: ["i1", "i11"], 2: ["i11", "i21"], 3: ["i21"]}
    with pytest.raises(ValueError):
        seasons.nearest_images(rows, "id", "t", images, -1, 1)
    own = {r.id: r.img_id for r in seasons.images_by_midpoint(rows, "t", images).collect()}
    assert own == {1: "i1", 2: "i11", 3: "i21"}
    line = spark.createDataFrame([("s", dt.date(2020, 1, 1) + dt.timedelta(days=i), 0.2 if i < 50 else 0.7) for i in range(100)], "series string, img_date date, ndvi double")
    got = seasons.seasonal_windows(line, [0.5], ["dry", "wet"]).orderBy("start").collect()
    assert [(r.season, (r.end - r.start).days) for r in got] == [("dry", 50), ("wet", 50)]


def test_movement_graph(spark):
    cell = lambda i: {"cx": i, "cy": 0}
    e = spark.createDataFrame([("a", cell(i), cell(i + 1)) for i in range(4)], "groupby_col string, a struct<cx:long,cy:long>, b struct<cx:long,cy:long>")
    between = {r.cx: r.betweenness for r in network.betweenness(e).collect()}
    assert between == {0: 0, 1: 3, 2: 4, 3: 3, 4: 0}
    influence = {r.node.cx: r.influence for r in network.collective_influence(e).collect()}
    assert influence == {0: 0, 1: 0, 2: 2, 3: 0, 4: 0}


def test_trends(spark):
    rows = [("s", float(x), 100.0 - 5 * x + (0.1 if x % 2 else -0.1)) for x in range(10)]
    df = spark.createDataFrame(rows, "k string, x double, y double")
    r = trend.linear_trend(df, "k", "x", "y").first()
    assert r.slope == pytest.approx(-5, abs=0.05) and r.r_squared > 0.99
    import math

    e = spark.createDataFrame([("s", x / 10, math.exp(1 + x / 20)) for x in range(20)], "k string, x double, y double")
    for family in ("poisson", "gaussian_log", "gamma"):
        g = trend.glm_trend(e, "k", "x", "y", family).first()
        assert (g.intercept, g.slope) == pytest.approx((1, 0.5), abs=1e-4)
    fit = trend.penalised_spline(df, "k", "x", "y", dof=6).collect()
    assert all(abs(a.fitted - (100 - 5 * a.x)) < 1 for a in fit)
    fine = trend.smooth(df, "k", "x", "y").collect()
    assert len(fine) == 100 and fine[0].y == pytest.approx(99.9)


def test_sources(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 36.0, -1.0, bytearray(b"x")), (2, None, 37.0, -2.0, None)], "id int, k string, lon double, lat double, raw binary")
    for fmt in ("parquet", "json", "csv", "geojson"):
        tables.persist(df if fmt != "json" else df.drop("raw"), f"{tmp_path}/{fmt}", fmt)
    assert spark.read.text(f"{tmp_path}/geojson").count() == 2
    tables.persist_groups(df, {"k": "k"}, f"{tmp_path}/groups")
    import hashlib

    assert spark.read.parquet(f"{tmp_path}/groups").first().key_hash == hashlib.sha256(b'{"k": "a"}').hexdigest()[:6]
    assert tables.content_hash(df).first() == tables.content_hash(df.orderBy(F.desc("id"))).first()
    with pytest.raises(ValueError):
        tables.load_regions(df.withColumn("geom_type", F.lit("Point")).withColumn("ring", F.array()), "k")
    (tmp_path / "f.json").write_text('{"features": [{"properties": {"n": "a"}, "geometry": {"type": "Point", "coordinates": [1.5, 2.5]}}]}')
    r = tables.read_features(spark, f"{tmp_path}/f.json", "n: string")
    lon, lat = tables.point_of("coordinates")
    assert r.select("n", "geom_type", lon.alias("x"), lat.alias("y")).first() == ("a", "Point", 1.5, 2.5)


def test_distances_to_shapes_by_batches(spark, monkeypatch):
    """Random segments and shapes, some parts at a time: distances as of the sampled ground; no expression goes through the corners row by row."""
    import numpy as np
    from pyspark.sql import functions as F

    from faunaflow.functions import shapes

    rng = np.random.default_rng(2)
    rows, want = [], {}
    for k in range(60):
        kind, n = [("point", 1), ("line", 3), ("polygon", 3)][k % 3]
        path, (a, b) = rng.uniform(0, 4, (n, 2)), rng.uniform(0, 4, (2, 2))
        rows.append((k, kind, [dict(x=float(x), y=float(y)) for x, y in path], *map(float, [*a, *b])))
        walk = lambda p, q: p + np.linspace(0, 1, 400)[:, None] * (q - p)
        corners = [*path, path[0]] if kind == "polygon" else [*path, path[-1]]
        ground = np.concatenate([walk(p, q) for p, q in zip(corners, corners[1:])])
        turns = [(q[0] - p[0]) * (a[1] - p[1]) - (q[1] - p[1]) * (a[0] - p[0]) > 0 for p, q in zip(corners, corners[1:])]
        inside = kind == "polygon" and len(set(turns)) == 1
        want[k] = 0.0 if inside else min(np.hypot(*(ground - s).T).min() for s in walk(a, b))
    rows.append((60, "line", [], 0.0, 0.0, 1.0, 1.0))
    rows.append((61, "polygon", None, 0.0, 0.0, 1.0, 1.0))
    rows.append((62, None, [dict(x=3.0, y=4.0)], 0.0, 0.0, 0.0, 0.0))
    df = spark.createDataFrame(rows, "k long, kind string, path array<struct<x:double,y:double>>, x1 double, y1 double, x2 double, y2 double")
    got = df.select("k", shapes.segment_to_shape(*[F.col(c) for c in df.columns[1:]]).alias("d"))
    found = {r.k: r.d for r in got.collect()}
    assert found[60] is None and found[61] is None and found[62] == 5.0
    assert all(found[k] == pytest.approx(w, abs=0.02) for k, w in want.items())
    assert "lambda" not in got._jdf.queryExecution().executedPlan().toString()
