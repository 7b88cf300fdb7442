"""Reading fixes, features and regions; writing tables in several formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def placed(df: DataFrame, column: str = "location") -> DataFrame:
    """lon, lat from a location that is a struct of longitude and latitude, or an array [lon, lat]."""
    if isinstance(df.schema[column].dataType, T.ArrayType):
        lon, lat = F.get(column, 0), F.get(column, 1)
    else:
        lon, lat = F.col(f"{column}.longitude"), F.col(f"{column}.latitude")
    return df.withColumns({"lon": lon.cast("double"), "lat": lat.cast("double")}).drop(column)


def read_fixes(spark: SparkSession, path: str, schema: str, fmt: str = "parquet") -> DataFrame:
    """Fixes from Parquet, CSV or JSON with an explicit schema."""
    reader = spark.read.schema(schema)
    df = reader.option("header", True).csv(path) if fmt == "csv" else reader.format(fmt).load(path)
    return placed(df) if "location" in df.columns else df


def read_features(spark: SparkSession, path: str, properties: str, lines: bool = False) -> DataFrame:
    """Features of GeoJSON collections: their properties, geom_type and coordinates as JSON text; a file is one collection, or has one a line."""
    schema = f"features array<struct<properties:struct<{properties}>, geometry:struct<type:string, coordinates:string>>>"
    rows = spark.read.schema(schema).json(path, multiLine=not lines).select(F.explode("features").alias("f"))
    return rows.select("f.properties.*", F.col("f.geometry.type").alias("geom_type"), F.col("f.geometry.coordinates").alias("coordinates"))


def read_feature_lines(spark: SparkSession, path: str, properties: str) -> DataFrame:
    """Features written one a line, as :func:`persist` does: their properties, geom_type and coordinates as JSON text."""
    rows = spark.read.schema(f"properties struct<{properties}>, geometry struct<type:string, coordinates:string>").json(path)
    return rows.select("properties.*", F.col("geometry.type").alias("geom_type"), F.col("geometry.coordinates").alias("coordinates"))


def point_of(coordinates: str) -> tuple:
    """lon and lat of a Point's coordinates in JSON; null where they are none."""
    return tuple(F.get_json_object(coordinates, f"$[{i}]").try_cast("double") for i in (0, 1))


def _ring(points):
    """Corners [lon, lat] of a closed ring as structs, the last left out."""
    return F.transform(F.slice(points, 1, F.greatest(F.size(points) - 1, F.lit(1))), lambda p: F.struct(F.get(p, 0).alias("x"), F.get(p, 1).alias("y")))


def geometry_of(column: str):
    """struct<geom_type, lon, lat> of a GeoJSON text: a point, or the centroid of a polygon's outer ring, or of several by their areas; null for bad JSON."""
    from faunaflow.functions.shapes import area, centroid, once

    kind = F.get_json_object(column, "$.type")
    place = lambda lon, lat: F.struct(lon.alias("x"), lat.alias("y"))
    point = lambda text: place(*[F.get_json_object(text, f"$[{i}]").try_cast("double") for i in (0, 1)])
    middle = lambda text: centroid(_ring(F.from_json(F.get_json_object(text, "$[0]"), "array<array<double>>")))
    total = lambda several, value: F.aggregate(several, F.lit(0.0), lambda s, e: s + value(e))
    common = lambda several, k: F.coalesce(F.try_divide(total(several, lambda e: e["area"] * e["at"][k]), total(several, lambda e: e["area"])), F.get(several, 0)["at"][k])
    each = lambda text: F.transform(F.from_json(text, "array<array<array<array<double>>>>"), lambda p: once(_ring(p[0]), lambda r: F.struct(area(r).alias("area"), centroid(r).alias("at"))))
    at = lambda kind, text: F.when(kind == "Point", point(text)).when(kind == "Polygon", middle(text)).when(kind == "MultiPolygon", once(each(text), lambda s: place(common(s, "x"), common(s, "y"))))
    known = lambda kind, p: F.when(p["x"].isNotNull() & p["y"].isNotNull(), F.struct(kind.alias("geom_type"), p["x"].alias("lon"), p["y"].alias("lat")))
    return once(kind, lambda k: once(at(k, F.get_json_object(column, "$.coordinates")), lambda p: known(k, p)))


def with_points(df: DataFrame, geometry: str = "geometry", force_point: bool = True) -> DataFrame:
    """df with geom_type, lon, lat from GeoJSON text; with force_point shapes become their centroid, without it only points have a place.

    The text stays as it is. Null or bad text, and shapes without a centroid (lines), have no place.
    """
    # a column of its own, so that the shape is read once for lon and lat
    rows = df.withColumn("point_of_shape", geometry_of(geometry))
    got = F.col("point_of_shape")
    kept = got if force_point else F.when(got["geom_type"] == "Point", got)
    return rows.withColumns({"geom_type": F.get_json_object(geometry, "$.type"), "lon": kept["lon"], "lat": kept["lat"]}).drop("point_of_shape")


def track_vertices(df: DataFrame, geometry: str, id_col: str, subject_id: str) -> DataFrame:
    """One row for each vertex with a time: subject_id, lon, lat, fixtime (UTC) and df's other columns; lines and sets of lines in GeoJSON text.

    Vertices without a third coordinate are left out, and so are rows without a line.
    """
    text = F.get_json_object(geometry, "$.coordinates")
    line = F.from_json(text, "array<array<double>>")
    lines = F.flatten(F.from_json(text, "array<array<array<double>>>"))
    points = F.when(F.get_json_object(geometry, "$.type") == "LineString", line).when(F.get_json_object(geometry, "$.type") == "MultiLineString", lines)
    rest = [c for c in df.columns if c not in (geometry, id_col)]
    rows = df.select(F.col(id_col).alias(subject_id), *rest, F.explode(F.filter(points, lambda p: F.get(p, 2).isNotNull())).alias("p"))
    at = F.timestamp_add("MICROSECOND", (F.col("p")[2] * 1000).cast("long"), F.expr("timestamp_ntz'1970-01-01 00:00:00'"))
    return rows.select(subject_id, *rest, F.col("p")[0].alias("lon"), F.col("p")[1].alias("lat"), at.alias("fixtime"))


def timed_vertices(column: str):
    """Array of struct<lon, lat, time> of line vertices [lon, lat, milliseconds]; those without a time are left out."""
    line = F.from_json(F.get_json_object(column, "$.coordinates"), "array<array<double>>")
    kept = F.filter(line, lambda p: F.size(p) > 2)
    return F.transform(kept, lambda p: F.struct(p[0].alias("lon"), p[1].alias("lat"), F.timestamp_millis(p[2].cast("long")).alias("time")))


def load_regions(df: DataFrame, name_column: str) -> DataFrame:
    """pk, name, short_name, feature_type, ring, metadata of polygon rows; raises where there is none, no such column, or a name repeats."""
    if name_column not in df.columns:
        raise KeyError(name_column)
    rows = df.where(F.col("geom_type").isin("Polygon", "MultiPolygon"))
    counts = rows.groupBy(name_column).count().agg(F.count(F.lit(1)).alias("n"), F.max("count").alias("most")).first()
    if not counts["n"]:
        raise ValueError("no polygons")
    if counts["most"] > 1:
        raise ValueError("names repeat")
    name = F.col(name_column)
    return rows.select(
        F.sha2(name, 256).alias("pk"), name.alias("name"), name.alias("short_name"), F.lit("region").alias("feature_type"), "ring", F.struct(F.sha2(name, 256).alias("id"), name.alias("display_name")).alias("metadata")
    )


def geometry_kind(wkb: str):
    """Name of a WKB geometry's type."""
    names = F.array(*map(F.lit, ["Point", "LineString", "Polygon", "MultiPoint", "MultiLineString", "MultiPolygon", "GeometryCollection"]))
    code = F.when(F.hex(F.substring(wkb, 1, 1)) == "01", F.conv(F.hex(F.substring(wkb, 2, 1)), 16, 10)).otherwise(F.conv(F.hex(F.substring(wkb, 5, 1)), 16, 10)).cast("int")
    return F.get(names, code - 1)


def content_hash(df: DataFrame) -> DataFrame:
    """One row with 7 hex digits that depend on the rows but not on their order."""
    h = F.xxhash64(*[F.to_json(F.col(c)) if isinstance(df.schema[c].dataType, (T.MapType, T.StructType, T.ArrayType)) else F.col(c) for c in df.columns])
    mixed = df.agg(F.bit_xor(h).alias("x"), F.sum(F.pmod(h, F.lit(1 << 31))).alias("s"))
    return mixed.select(F.lower(F.substring(F.sha2(F.concat_ws(":", "x", "s"), 256), 1, 7)).alias("hash"))


def key_hash(keys: dict[str, str]):
    """The first 6 hex digits of the SHA-256 of the keys as sorted JSON with a space after comma and colon."""
    parts = [F.concat(F.lit(f'"{k}": "'), F.col(c), F.lit('"')) for k, c in sorted(keys.items())]
    return F.substring(F.sha2(F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}")), 256), 1, 6)


def plain_columns(df: DataFrame, force_text: list[str] = ()) -> DataFrame:
    """Bytes as UTF-8 text, nested values as JSON text; numbers, times and booleans stay."""

    def plain(f: T.StructField):
        if isinstance(f.dataType, T.BinaryType):
            return F.decode(f.name, "UTF-8").alias(f.name)
        if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            return F.to_json(f.name).alias(f.name)
        return F.col(f.name).cast("string").alias(f.name) if f.name in force_text else F.col(f.name)

    return df.select(*map(plain, df.schema.fields))


def geojson_lines(df: DataFrame, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """value: one GeoJSON point feature a row."""
    rest = [c for c in df.columns if c not in (lon, lat)]
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates")).alias("geometry"), F.struct(*rest).alias("properties"))
    return df.select(F.to_json(feature).alias("value"))


def persist(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    if fmt == "geojson":
        geojson_lines(df).write.mode("overwrite").text(path)
    elif fmt == "csv":
        plain_columns(df).write.mode("overwrite").option("header", True).csv(path)
    else:
        df.write.mode("overwrite").format(fmt).save(path)


def persist_groups(df: DataFrame, keys: dict[str, str], path: str) -> None:
    """One folder for each group of non-null keys, named by its key hash."""
    rows = df.dropna(subset=list(keys.values())).withColumn("key_hash", key_hash(keys))
    rows.write.mode("overwrite").partitionBy("key_hash").parquet(path)


def map_ready(df: DataFrame, colour: str | None = None) -> DataFrame:
    """Rows with a place; times as ISO text, doubles as floats, nested values as text. A null colour raises."""
    rows = df.where("lon is not null and lat is not null")
    if colour and rows.where(F.col(colour).isNull()).limit(1).count():
        raise ValueError("null colours")

    def ready(f: T.StructField):
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            return F.date_format(f.name, "yyyy-MM-dd'T'HH:mm:ss").alias(f.name)
        if isinstance(f.dataType, T.DoubleType):
            return F.col(f.name).cast("float")
        return F.to_json(f.name).alias(f.name) if isinstance(f.dataType, (T.MapType, T.StructType)) else F.col(f.name)

    return rows.select(*map(ready, rows.schema.fields))


def chunked(df: DataFrame, function, schema: str) -> DataFrame:
    """A user's function of a pandas frame, over the batches of each partition."""
    return df.mapInPandas(lambda parts: (function(p) for p in parts), schema)


def reduced(df: DataFrame, key: str, function, schema: str) -> DataFrame:
    """A user's reducer of one group's pandas frame."""
    return df.groupBy(key).applyInPandas(function, schema)


