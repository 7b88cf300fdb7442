"""Field events and patrols: nested tables, selections, look-ups, interval joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faunaflow.functions.shapes import once

#: Manual and automatic flags by filter number.
FLAGS = {0: [0], 1: [1], 2: [2], 3: [1, 2]}


def flag_filter(df: DataFrame, which: int | None) -> DataFrame:
    """Fixes with these exclusion flags: 0 clean, 1 manual, 2 automatic, 3 both; None keeps all."""
    return df if which is None else df.where(F.col("exclusion_flags").isin(FLAGS[which]))


def in_range(df: DataFrame, time: str, since: str, until: str) -> DataFrame:
    """since <= time <= until; the bounds are pushed into the scan."""
    at = lambda x: F.lit(x).cast("timestamp_ntz")
    return df.where((F.col(time) >= at(since)) & (F.col(time) <= at(until)))


def select_patrols(df: DataFrame, since: str, until: str, types: list[str] | None = None, states: list[str] | None = None, overlap: bool = True, known: DataFrame | None = None) -> DataFrame:
    """Patrols (patrol_type, state, start_time, end_time, serial_number) that overlap, or else start in, the range.

    A type that ``known``, a table of types (value), lacks raises; without such a table the types of the patrols are known.
    """
    at = lambda x: F.lit(x).cast("timestamp_ntz")
    first = F.col("start_time") <= at(until)
    chosen = first & (F.col("end_time").isNull() | (F.col("end_time") >= at(since))) if overlap else first & (F.col("start_time") >= at(since))
    rows = df.where(chosen)
    if types is not None:
        table = df.select("patrol_type") if known is None else known.select(F.col("value").alias("patrol_type"))
        found = {r[0] for r in table.where(F.col("patrol_type").isin(types)).distinct().collect()}
        if missing := set(types) - found:
            raise ValueError(f"unknown patrol types: {sorted(missing)}")
        rows = rows.where(F.col("patrol_type").isin(types))
    return (rows.where(F.col("state").isin(states)) if states is not None else rows).orderBy("serial_number")


def select_events(
    df: DataFrame, types: list[str] | None, since: str, until: str, columns: list[str], drop_null_geometry: bool = True,
    states: list[str] | None = None, categories: list[str] | None = None, updated_since: str | None = None,
) -> DataFrame:
    """Events by type, time, state, category and time of change (updated_at), with location{lat, lon}, in order of time; absent columns raise KeyError."""
    rows = in_range(df, "time", since, until)
    for column, chosen in (("event_type", types), ("state", states), ("event_category", categories)):
        if chosen:
            rows = rows.where(F.col(column).isin(chosen))
    if updated_since is not None:
        rows = rows.where(F.col("updated_at") >= F.lit(updated_since).cast("timestamp_ntz"))
    if drop_null_geometry:
        rows = rows.where("lon is not null and lat is not null")
    rows = rows.withColumn("location", F.struct(F.col("lat"), F.col("lon")))
    if absent := [c for c in columns if c not in rows.columns]:
        raise KeyError(f"no such columns: {absent}")
    return rows.orderBy("time").select(*columns)


def enrich(fixes: DataFrame, dim: DataFrame, key: str, prefix: str) -> DataFrame:
    """Inner join with a table of subjects or sources, whose columns get the prefix. Spark broadcasts it below its size threshold."""
    return fixes.join(dim.select(F.col(key).alias(key), *[F.col(c).alias(prefix + c) for c in dim.columns if c != key]), key)


def patrol_tracks(fixes: DataFrame, patrols: DataFrame) -> DataFrame:
    """Fixes of a patrol segment's leader while it lasts, with the patrol as groupby_col; overlapping patrols repeat fixes.

    patrols: patrol_id, leader_id, start_time, end_time (null: open). Segments without leader or start are left out. Days are part
    of the equi key, so that a leader's whole history never meets all of their patrols; an open end is the last fix's day.
    """
    rows = patrols.where("leader_id is not null and start_time is not null")
    last = fixes.groupBy(F.col("subject_id").alias("leader_id")).agg(F.max("fixtime").alias("last_fix"))
    rows = rows.join(last, "leader_id").withColumn("until", F.coalesce("end_time", "last_fix")).where("until >= start_time")
    days = rows.withColumn("p_day", F.explode(F.sequence(F.to_date("start_time"), F.to_date("until"))))
    met = fixes.withColumn("f_day", F.to_date("fixtime")).join(days, (F.col("subject_id") == F.col("leader_id")) & (F.col("f_day") == F.col("p_day")))
    return met.where("fixtime between start_time and until").select(*fixes.columns, F.col("patrol_id").alias("groupby_col"))


def display_names(events: DataFrame, types: DataFrame, append_category: str = "never") -> DataFrame:
    """events with event_type_display: the type's display name, else the type; with the category always, or where one name covers several
    types that occur among the events. A type without a category gets itself in its place."""
    names = types.dropDuplicates(["value"]).select(F.col("value").alias("event_type"), "display", F.coalesce("category_display", "category_value").alias("category"))
    name = F.coalesce("display", "event_type")
    named = events.join(names, "event_type", "left")
    present = events.select("event_type").where("event_type is not null").distinct().join(names, "event_type", "left").select("event_type", name.alias("shown"))
    several = present.groupBy("shown").agg((F.count(F.lit(1)) > 1).alias("several")).where("several")
    add = {"never": F.lit(False), "always": F.lit(True), "duplicates": F.coalesce("several", F.lit(False))}[append_category]
    named = named.withColumn("shown", name).join(several, "shown", "left")
    full = F.concat("shown", F.lit(" ("), F.coalesce("category", "event_type"), F.lit(")"))
    return named.select(*events.columns, F.when(add, full).otherwise(F.col("shown")).alias("event_type_display"))


#: Stands between the parts of a path of keys and codes.
PART = "\u0001"


def _by_type(fields: DataFrame) -> DataFrame:
    """event_type, titles and labels (maps by path) and order (keys), one row for each type; see :func:`resolved_details`."""
    sub = F.col("sub_key") if "sub_key" in fields.columns else F.lit(None).cast("string")
    place = F.col("place") if "place" in fields.columns else F.lit(0)
    rows = fields.select("event_type", "key", sub.alias("sub"), place.alias("place"), "title", "code", "label").withColumn("path", F.concat_ws(PART, "key", "sub"))
    title, label = F.col("code").isNull(), F.col("code").isNotNull()
    pairs = lambda when, k, v: F.map_from_entries(F.array_distinct(F.collect_list(F.when(when, F.struct(k, v)))))
    once = rows.groupBy("event_type", "path", "code").agg(F.first("key").alias("key"), F.first("sub").alias("sub"), F.min("place").alias("place"), F.max("title").alias("title"), F.max("label").alias("label"))
    got = once.groupBy("event_type").agg(
        pairs(title & F.col("title").isNotNull(), F.col("path").alias("k"), F.col("title").alias("v")).alias("titles"),
        pairs(label, F.concat_ws(PART, "path", "code").alias("k"), F.col("label").alias("v")).alias("labels"),
        F.array_sort(F.collect_list(F.when(title & F.col("sub").isNull(), F.struct("place", "key")))).alias("order"),
    )
    return got.withColumn("order", F.col("order.key"))


def _last_of_each(entries: Column, key: str, value: str) -> Column:
    """Of an array of structs, those with distinct keys in the order of their first, each with the last value of its key; entries are computed once."""
    keys = lambda all: F.array_distinct(F.transform(all, lambda e: e[key]))
    last = lambda all, k: F.element_at(F.filter(all, lambda e: e[key] == k), -1)
    return once(entries, lambda all: F.transform(keys(all), lambda k: last(all, k)))


def titled_details(events: DataFrame, fields: DataFrame) -> DataFrame:
    """Flat detail maps with keys and codes replaced by titles and labels from fields (event_type, key, title, code, label; code null for the title row).

    Of keys with one title the last in the map stays. Fields are one row for each type, so events are not grouped.
    """
    rows = events.join(_by_type(fields), "event_type", "left")
    found = lambda m, k, other: F.coalesce(F.try_element_at(F.col(m), k), other)
    entry = lambda e: F.struct(found("titles", e["key"], e["key"]).alias("key"), found("labels", F.concat_ws(PART, e["key"], e["value"]), e["value"]).alias("value"))
    pairs = _last_of_each(F.transform(F.map_entries("event_details"), entry), "key", "value")
    return rows.select(*[c for c in events.columns if c != "event_details"], F.map_from_entries(pairs).alias("event_details"))


def _quoted(c: Column) -> Column:
    """A string as JSON; null stays null."""
    text = once(F.to_json(F.array(c)), lambda t: F.substring(t, F.lit(2), F.length(t) - 2))
    return F.when(c.isNotNull(), text)


def _object(entries: Column) -> Column:
    """An array of (title, json) as a JSON object; of equal titles the last value, at the place of the first."""
    written = F.transform(_last_of_each(entries, "title", "json"), lambda e: F.concat(_quoted(e["title"]), F.lit(":"), e["json"]))
    return F.concat(F.lit("{"), F.array_join(written, ","), F.lit("}"))


def resolved_details(events: DataFrame, fields: DataFrame, titles: bool = True, ordered: bool = True, details: str = "event_details") -> DataFrame:
    """Detail objects, JSON text of any shape, rewritten by the schema of each event's type, as JSON text.

    fields: event_type, key, sub_key (null but for fields of the sub-forms in a key's list), place, title, code, label; the rows without a
    code name the keys and their order, those with one the labels of codes. Codes are replaced where they are a value, an
    element of a list or a value in a list of sub-forms; keys become titles, unless titles is false. With ordered the
    schema's keys come first, by place, then the others as they stand, without ``updates``. Types without a schema keep their details, and null or
    invalid ones stay as they are. Fields are one row for each type: events are neither grouped nor exploded.
    """
    by_type = _by_type(fields).withColumn("known", F.lit(True))
    rows = events.join(by_type, "event_type", "left")
    rows = rows.withColumns({"values": F.from_json(details, "map<string,variant>"), "raw": F.from_json(details, "map<string,string>")})
    text = lambda v: F.try_variant_get(v, "$", "string")
    title = lambda path, key: F.coalesce(F.try_element_at("titles", path), key) if titles else key
    label = lambda path, v: F.try_element_at("labels", F.concat_ws(PART, path, text(v)))
    resolve = lambda path, v: F.coalesce(once(label(path, v), _quoted), F.to_json(v))
    listed = lambda items: F.concat(F.lit("["), F.array_join(items, ","), F.lit("]"))

    def sub_form(key: Column, item: Column) -> Column:
        path = lambda e: F.concat_ws(PART, key, e["key"])
        return _object(F.transform(F.map_entries(item), lambda e: F.struct(title(path(e), e["key"]).alias("title"), resolve(path(e), e["value"]).alias("json"))))

    def value(key: Column) -> Column:
        raw = F.element_at("raw", key)
        forms = F.transform(F.from_json(raw, "array<map<string,variant>>"), lambda item: sub_form(key, item))
        codes = F.transform(F.from_json(raw, "array<variant>"), lambda item: resolve(key, item))
        chosen = lambda kind, v: F.when(kind.startswith("ARRAY<OBJECT"), listed(forms)).when(kind.startswith("ARRAY<"), listed(codes)).otherwise(resolve(key, v))
        return once(F.element_at("values", key), lambda v: once(F.schema_of_variant(v), lambda kind: chosen(kind, v)))

    keys = F.map_keys("values")
    if ordered:
        first = F.filter("order", lambda k: F.map_contains_key("values", k))
        keys = F.concat(first, F.filter(keys, lambda k: ~F.array_contains("order", k) & (k != "updates")))
    entries = F.transform(keys, lambda k: F.struct(title(k, k).alias("title"), value(k).alias("json")))
    done = F.when(F.col("known") & F.col("values").isNotNull() & (F.size("values") > 0), _object(entries)).otherwise(F.col(details))
    return rows.select(*[c for c in events.columns if c != details], done.alias(details))


def unpack_patrol_events(patrols: DataFrame) -> DataFrame:
    """One row for each event of each patrol segment, with the patrol's columns; events without a time are dropped."""
    segments = patrols.select("patrol_id", "serial_number", F.explode("patrol_segments").alias("s"))
    events = segments.select("patrol_id", "serial_number", F.col("s.id").alias("segment_id"), F.col("s.leader.id").alias("leader_id"), F.explode("s.events").alias("e"))
    point = F.col("e.geojson.geometry.coordinates")
    return events.select(
        "patrol_id", "serial_number", "segment_id", "leader_id", F.col("e.id").alias("event_id"), F.col("e.event_type").alias("event_type"),
        F.col("e.geojson.properties.datetime").alias("time"), F.get(point, 0).alias("lon"), F.get(point, 1).alias("lat"),
    ).where("time is not null")


def nest_patrols(flat: DataFrame) -> DataFrame:
    """Flat patrol events (patrol_id, serial_number, segment_id, leader_id, event_id, event_type, time, lon, lat) as nested patrols."""
    geo = F.struct(F.struct(F.array("lon", "lat").alias("coordinates")).alias("geometry"), F.struct(F.col("time").alias("datetime")).alias("properties"))
    event = F.struct(F.col("event_id").alias("id"), "event_type", geo.alias("geojson"))
    segments = flat.groupBy("patrol_id", "serial_number", "segment_id", "leader_id").agg(F.min("time").alias("start"), F.max("time").alias("end"), F.array_sort(F.collect_list(event)).alias("events"))
    segment = F.struct(F.col("segment_id").alias("id"), F.struct(F.col("leader_id").alias("id")).alias("leader"), F.struct(F.col("start").alias("start_time"), F.col("end").alias("end_time")).alias("time_range"), "events")
    return segments.groupBy("patrol_id", "serial_number").agg(F.array_sort(F.collect_list(segment)).alias("patrol_segments"))


def attribute_map(column: str):
    """A list of {attribute, value} in JSON as a map; the last of equal attributes wins."""
    pairs = F.from_json(F.col(column), "array<struct<attribute:string,value:string>>")
    return F.aggregate(
        pairs, F.create_map().cast("map<string,string>"),
        lambda m, p: F.map_concat(F.map_filter(m, lambda k, _: k != p["attribute"]), F.create_map(p["attribute"], p["value"])),
    )


def required(df: DataFrame, not_null: list[str], types: dict[str, str]) -> DataFrame:
    """One row: the number of rows, and of nulls in each required column; wrong types or absent columns raise at once."""
    kinds = dict(df.dtypes)
    if wrong := {c: (kinds.get(c), t) for c, t in types.items() if kinds.get(c) != t}:
        raise TypeError(f"columns of other types: {wrong}")
    return df.agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in not_null])


def mixed_subtypes(df: DataFrame, column: str) -> bool:
    return df.select(column).distinct().limit(2).count() > 1


def aligned(target: DataFrame, reference: DataFrame, key: str, fill: dict) -> DataFrame:
    """target with every key of reference, absent ones filled; keys of the target alone are kept; repeated keys raise."""
    if target.groupBy(key).count().where("count > 1").limit(1).count():
        raise ValueError("repeated keys")
    return target.join(reference.select(key).distinct(), key, "full_outer").na.fill(fill)


def joined_by_key(frames: dict[str, DataFrame], key: str, keep_missing: bool = True) -> DataFrame:
    """Values of several results by key, one column each; keys that one lacks are null there, or dropped."""
    out = None
    for name, df in frames.items():
        one = df.select(key, F.struct(*[c for c in df.columns if c != key]).alias(name))
        out = one if out is None else out.join(one, key, "full_outer" if keep_missing else "inner")
    return out


def first_per_day(df: DataFrame, key: str, time: str) -> DataFrame:
    w = Window.partitionBy(key, F.to_date(time)).orderBy(time)
    return df.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")
