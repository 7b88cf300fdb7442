"""Schemas and defaults, ramps and legends, times and zones, files, classes of utilisation and canvases of lines."""

import datetime as dt
import json
import math

import pytest
from pyspark.sql import functions as F

from faunaflow.operators import classify, density, schemas, spatial, timekeys
from faunaflow.sources import tables

WHEN = dt.datetime(2024, 5, 1)


def test_defaults_fill_what_is_missing(spark):
    df = spark.createDataFrame([("a", 7.0, None), ("b", None, "open"), ("c", float("nan"), "done")], "groupby_col string, patrol_serial_number double, patrol_status string")
    got = schemas.with_defaults(df, schemas.PATROL_FIXES).orderBy("groupby_col").collect()
    assert [(r.patrol_serial_number, r.patrol_status, r.patrol_subject, r.patrol_type__value) for r in got] == [("7", "None", "None", "None"), ("None", "open", "None", "None"), ("None", "done", "None", "None")]
    assert set(schemas.with_defaults(df.limit(0), schemas.PATROL_FIXES).columns) > set(schemas.PATROL_FIXES.defaults)


@pytest.mark.parametrize("kind, given, want", [
    (None, None, {"name": "None"}), ("struct<name:string,id:int>", None, {"name": "None", "id": None}), ("struct<name:string,id:int>", ("x", 3), {"name": "x", "id": 3}),
    ("map<string,string>", None, {"name": "None"}), ("map<string,string>", {"name": "y"}, {"name": "y"}), ("string", None, '{"name":"None"}'),
])
def test_nested_defaults_take_the_form_of_the_column(spark, kind, given, want):
    df = spark.createDataFrame([(1, given)], f"n int, reported_by {kind}") if kind else spark.createDataFrame([(1,)], "n int")
    got = schemas.with_defaults(df, schemas.EVENTS).first()["reported_by"]
    assert (got.asDict() if hasattr(got, "asDict") else got) == want


def test_problems_name_columns_types_and_missing_values(spark):
    schema = "pk string, name string, short_name int, metadata struct<id:string,display_name:string>"
    df = spark.createDataFrame([("1", "a", 1, ("i", "d")), (None, "b", 2, ("i", None)), (None, "c", 3, None)], schema)
    got = {(r.column, r.problem, r.rows) for r in schemas.problems(df, schemas.REGIONS).collect()}
    assert got == {("short_name", "type int", None), ("feature_type", "absent", None), ("pk", "missing values", 2), ("metadata", "missing values", 1), ("metadata", "no display_name", 1)}
    with pytest.raises(ValueError, match="feature_type: absent.*pk: missing values in 2 rows"):
        schemas.validated(df, schemas.REGIONS)


def test_a_table_that_conforms(spark):
    schema = "event_type string, time timestamp_ntz, lon double, lat double"
    rows = schemas.validated(spark.createDataFrame([("a", WHEN, None, None)], schema), schemas.EVENTS)
    assert rows.select("event_category").first()[0] == "None"
    assert schemas.validated(spark.createDataFrame([], schema), schemas.EVENTS).count() == 0


def test_ramps(spark):
    assert classify.ramp_colours([(0, 0, 0, 255), (255, 255, 255, 255)], 3) == [(0, 0, 0, 255), (128, 128, 128, 255), (255, 255, 255, 255)]
    assert classify.ramp_colours([(9, 9, 9, 255), (0, 0, 0, 255)], 1) == [(9, 9, 9, 255)] and classify.ramp_colours([(1, 1, 1, 1)] * 2, 0) == []
    many = classify.ramp_colours([(0, 0, 0, 255), (255, 255, 255, 255)], 300)
    assert many[255] == (255, 255, 255, 255) and many[256] == many[0]
    df = spark.createDataFrame([(1, 0.0), (2, 10.0), (3, 5.0), (4, None), (5, float("nan"))], "n int, v double")
    got = {r.n: tuple(r.c) for r in classify.colour_ramp(df, "v", "c", classify.RAMPS["gray"]).collect()}
    assert got == {1: (0, 0, 0, 255), 2: (255,) * 4, 3: (128, 128, 128, 255), 4: (0,) * 4, 5: (0,) * 4}
    same = classify.colour_ramp(df.where("n < 2"), "v", "c", classify.RAMPS["gray"]).collect()
    assert [tuple(r.c) for r in same] == [(0, 0, 0, 255)]
    assert [tuple(r.c) for r in classify.colour_ramp(df.where("n > 3"), "v", "c", classify.RAMPS["gray"]).collect()] == [(0,) * 4] * 2
    assert classify.colour_ramp(df.limit(0), "v", "c", classify.RAMPS["gray"]).collect() == []


def test_legends_sort_numbers_as_numbers(spark):
    rows = [(0, "10", [1, 2, 3, 255]), (1, "2", [4, 5, 6, 255]), (2, "10", [9, 9, 9, 255]), (3, "1e1", [7, 7, 7, 0])]
    df = spark.createDataFrame(rows, "n int, k string, c array<int>")
    got = lambda rows, sort: [tuple(r) for r in classify.legend(rows, "k", "c", sort, " %", ["n"]).collect()]
    assert got(df, None) == [("10 %", "rgba(1, 2, 3, 1.0)"), ("2 %", "rgba(4, 5, 6, 1.0)"), ("1e1 %", "rgba(7, 7, 7, 0.0)")]
    assert [r[0] for r in got(df, "ascending")] == ["2 %", "10 %", "1e1 %"]
    mixed = df.unionByName(spark.createDataFrame([(4, "x", [0, 0, 0, 0])], df.schema))
    assert [r[0] for r in got(mixed, "descending")] == ["x %", "2 %", "1e1 %", "10 %"] and got(df.limit(0), "ascending") == []
    with pytest.raises(ValueError):
        classify.legend(df, "k", "c", "up")


def test_choices_go_by_the_calendar(spark):
    df = spark.createDataFrame([(dt.datetime(2024, m, 1),) for m in (4, 1, 12, 4)] + [(None,)], "t timestamp_ntz")
    assert [r.choice for r in timekeys.choices(df, "t", "%B").collect()] == ["January", "April", "December"]
    assert [r.choice for r in timekeys.choices(df, "t", "%A").collect()] == ["Monday", "Sunday"]
    assert [r.choice for r in timekeys.choices(df, "t", "%Y-%m").collect()] == ["2024-01", "2024-04", "2024-12"]


@pytest.mark.parametrize("zone", ["UTC", "Pacific/Auckland"])
def test_times_do_not_depend_on_the_session(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        texts = ["2024-05-01T12:00:00+03:00", "2024-05-01 12:00:00", "2024-05-01T12:00:00Z", "2024-05-01", "soon", None, " 2024-05-01T12:00:00.250Z "]
        df = timekeys.clean_times(spark.createDataFrame([(i, t, t) for i, t in enumerate(texts)], "n int, fixtime string, other string"))
        assert dict(df.dtypes) == {"n": "int", "fixtime": "timestamp_ntz", "other": "string"}
        noon = dt.datetime(2024, 5, 1, 12)
        got = {r.n: r.fixtime for r in df.collect()}
        assert got == {0: noon - dt.timedelta(hours=3), 1: noon, 2: noon, 3: dt.datetime(2024, 5, 1), 4: None, 5: None, 6: noon + dt.timedelta(milliseconds=250)}
        assert timekeys.clean_times(df).dtypes == df.dtypes
        moved = timekeys.to_zone(df.select("n", "fixtime", F.timestamp_micros(F.lit(1714564800000000)).alias("moment")), "Africa/Nairobi", ["moment", "fixtime", "absent"])
        first = moved.where("n = 1").first()
        assert (first.moment, first.fixtime) == (dt.datetime(2024, 5, 1, 15), noon)
        with pytest.raises(ValueError):
            timekeys.to_zone(df, "UTC", ["fixtime"], auto_detect=True)
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_tracks_with_times(spark):
    line = {"type": "LineString", "coordinates": [[1, 2, 1000], [3, 4], [5, 6, 2500]]}
    lines = {"type": "MultiLineString", "coordinates": [[[1, 1, 0]], [[2, 2], [3, 3, 7000]]]}
    rows = [("p", 1, json.dumps(line)), ("q", 2, json.dumps(lines)), ("r", 3, json.dumps({"type": "Point", "coordinates": [1, 2, 3]})), ("s", 4, None), ("t", 5, "{bad")]
    got = tables.track_vertices(spark.createDataFrame(rows, "id string, n int, g string"), "g", "id", "subject").collect()
    assert got and got[0].asDict().keys() == {"subject", "n", "lon", "lat", "fixtime"}
    zero = dt.datetime(1970, 1, 1)
    assert sorted((r.subject, r.n, r.lon, r.lat, (r.fixtime - zero).total_seconds()) for r in got) == [("p", 1, 1, 2, 1.0), ("p", 1, 5, 6, 2.5), ("q", 2, 1, 1, 0.0), ("q", 2, 3, 3, 7.0)]


def test_points_of_shapes(spark):
    ring = lambda x, y, w, h: [[x, y], [x + w, y], [x + w, y + h], [x, y + h], [x, y]]
    shapes = [
        {"type": "Point", "coordinates": [1, 2]}, {"type": "Polygon", "coordinates": [ring(0, 0, 2, 4)]}, {"type": "MultiPolygon", "coordinates": [[ring(0, 0, 1, 1)], [ring(10, 0, 3, 1)]]},
        {"type": "LineString", "coordinates": [[0, 0], [1, 1]]}, {"type": "MultiPolygon", "coordinates": [[ring(5, 5, 0, 0)]]},
    ]
    df = spark.createDataFrame([(i, json.dumps(s)) for i, s in enumerate(shapes)] + [(5, None), (6, "{bad")], "n int, geometry string")
    got = {r.n: (r.geom_type, r.lon, r.lat) for r in tables.with_points(df).collect()}
    assert got == {0: ("Point", 1, 2), 1: ("Polygon", 1, 2), 2: ("MultiPolygon", 8.75, 0.5), 3: ("LineString", None, None), 4: ("MultiPolygon", 5, 5), 5: (None, None, None), 6: (None, None, None)}
    plain = {r.n: r.lon for r in tables.with_points(df, force_point=False).collect()}
    assert plain == {0: 1.0, 1: None, 2: None, 3: None, 4: None, 5: None, 6: None}


def test_shapes_are_read_once(spark):
    """The text of a shape is parsed once for each kind, however often its ring is used."""
    df = spark.createDataFrame([('{"type": "Point", "coordinates": [1, 2]}',)], "geometry string")
    plan = tables.with_points(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") <= 3


def test_written_features_come_back(spark, tmp_path):
    df = spark.createDataFrame([(1, "a,\"b\"", 2.5, -1.0), (2, None, 3.0, 4.0)], "n long, t string, lon double, lat double")
    tables.persist(df, f"{tmp_path}/g", "geojson")
    lon, lat = tables.point_of("coordinates")
    back = tables.read_feature_lines(spark, f"{tmp_path}/g", "n:long, t:string").select("n", "t", lon.alias("lon"), lat.alias("lat"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    tables.persist_groups(df, {"t": "t"}, f"{tmp_path}/k")
    assert [r.n for r in spark.read.parquet(f"{tmp_path}/k").collect()] == [1]


def test_grid_size(spark):
    df = spark.createDataFrame([(0.0, 0.0), (1.0, 0.0), (None, None)], "lon double, lat double")
    degree = 6378137 * math.pi / 180
    assert [r.size for r in spatial.grid_size(df).collect()] == [round(degree / 100)] and spatial.grid_size(df.limit(1)).first().size == 1
    assert spatial.grid_size(df.where("lon > 5")).collect() == []


def test_utilisation_classes(spark):
    stays = [100.0, 60.0, 30.0, 10.0]
    df = spark.createDataFrame([(i + 0.2, 0.5, i + 0.8, 0.5, t) for i, t in enumerate(stays)], "x1 double, y1 double, x2 double, y2 double, timespan_seconds double")
    got = {r.percentile: (r.cells, r.density_bins, r.area) for r in density.classed_utilisation(df, 1.0, (100, 50, 80, 50)).collect()}
    # running sums from the least: 10, 40, 100, 200; nearest to 100 (of 200) is 100, to 40 is 40, to 0 is 10
    assert got == {50.0: (2, "50.0 %", 2.0), 80.0: (1, "80.0 %", 1.0), 100.0: (1, "100.0 %", 1.0)}
    assert density.classed_utilisation(df.limit(0), 1.0).collect() == []
    with pytest.raises(ValueError):
        density.classed_utilisation(df, 1.0, ())


def test_canvas_of_lines(spark):
    rows = [(0.5, 0.5, 2.5, 0.5, 2.0), (1.5, 0.2, 1.5, 5.0, 3.0), (-4.0, 0.5, 0.5, 0.5, 1.0), (0.0, 0.0, 2.0, 2.0, 1.0), (9.0, 9.0, 9.5, 9.5, 1.0), (1.25, 1.25, 1.25, 1.25, 1.0)]
    df = spark.createDataFrame(rows, "x1 double, y1 double, x2 double, y2 double, v double")
    got = {(r.px, r.py): r.n for r in density.line_canvas(df, (0.0, 0.0, 3.0, 2.0), 3, 2).collect()}
    assert got == {(0, 0): 3, (1, 0): 2, (2, 0): 1, (1, 1): 3}
    weighed = {(r.px, r.py): r.n for r in density.line_canvas(df, (0.0, 0.0, 3.0, 2.0), 3, 2, "v").collect()}
    assert weighed == {(0, 0): 4.0, (1, 0): 5.0, (2, 0): 2.0, (1, 1): 5.0}
