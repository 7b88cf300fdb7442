"""What each kind of table must hold: columns and their types, defaults of optional columns, and one pass over the rows."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TEXT, TIME, FLAG, NUMBER, WHOLE = ("string",), ("timestamp_ntz", "timestamp"), ("boolean",), ("double", "float"), ("bigint", "int")
ANY: tuple[str, ...] = ()
PLACE = {"lon": NUMBER, "lat": NUMBER}


@dataclass(frozen=True)
class TableSchema:
    """required: types by column (empty: any); defaults: values of optional columns, dicts for nested ones; whole: numbers kept as text."""

    required: dict[str, tuple[str, ...]]
    defaults: dict[str, str | dict[str, str]] = field(default_factory=dict)
    whole: tuple[str, ...] = ()
    nullable: tuple[str, ...] = ()
    attributes: dict[str, tuple[str, ...]] = field(default_factory=dict)


# Columns and defaults of the kinds of tables.
RELOCATIONS = TableSchema({"groupby_col": TEXT, "fixtime": TIME, "junk_status": FLAG, **PLACE})
SUBJECT_FIXES = TableSchema(RELOCATIONS.required, {"extra__subject__name": "None", "extra__subject__subject_subtype": "None", "extra__subject__sex": "None"})
PATROL_FIXES = TableSchema(
    RELOCATIONS.required, {"patrol_type__value": "None", "patrol_serial_number": "None", "patrol_status": "None", "patrol_subject": "None"}, whole=("patrol_serial_number",)
)
EVENTS = TableSchema({"event_type": TEXT, "time": TIME, **PLACE}, {"event_category": "None", "reported_by": {"name": "None"}}, nullable=("lon", "lat"))
TRAJECTORY = TableSchema(
    {"groupby_col": TEXT, "segment_start": TIME, "segment_end": TIME, "timespan_seconds": NUMBER, "dist_meters": NUMBER, "speed_kmhr": NUMBER, "heading": NUMBER, "junk_status": FLAG}
)
PATROLS = TableSchema({"id": TEXT, "state": TEXT, "serial_number": WHOLE, "patrol_segments": ANY})
REGIONS = TableSchema({"pk": TEXT, "name": TEXT, "short_name": TEXT, "feature_type": TEXT, "metadata": ANY}, attributes={"metadata": ("id", "display_name")})


def _known(df: DataFrame, column: str) -> Column:
    """The column with NaN as null."""
    c = F.col(column)
    return F.when(~F.isnan(c), c) if isinstance(df.schema[column].dataType, (T.DoubleType, T.FloatType)) else c


def _nested(df: DataFrame, column: str, default: dict[str, str]) -> Column:
    """A dict in the form that the column has: struct, map or JSON text; a struct where it is absent. A struct keeps only fields that it has."""
    if column not in df.columns:
        return F.struct(*[F.lit(v).alias(k) for k, v in default.items()])
    kind = df.schema[column].dataType
    if isinstance(kind, T.StructType):
        value = F.struct(*[F.lit(default.get(f.name)).cast(f.dataType).alias(f.name) for f in kind.fields])
    elif isinstance(kind, T.MapType):
        value = F.create_map(*[F.lit(x) for pair in default.items() for x in pair])
    else:
        value = F.to_json(F.struct(*[F.lit(v).alias(k) for k, v in default.items()]))
    return F.coalesce(F.col(column), value)


def with_defaults(df: DataFrame, schema: TableSchema) -> DataFrame:
    """df with every optional column, its missing values (null, NaN) replaced by the default.

    A text default makes the column text; of the schema's whole numbers the fraction is cut off first, so 7.0 becomes '7'. An empty
    table gets the columns too.
    """

    def filled(name: str, default: str | dict[str, str]) -> Column:
        if isinstance(default, dict):
            return _nested(df, name, default)
        if name not in df.columns:
            return F.lit(default)
        value = _known(df, name)
        if name in schema.whole and isinstance(df.schema[name].dataType, T.FractionalType):
            value = value.cast("decimal(38,0)") if isinstance(df.schema[name].dataType, T.DecimalType) else value.cast("long")
        return F.coalesce(value.cast("string"), F.lit(default))

    return df.withColumns({n: filled(n, v) for n, v in schema.defaults.items()})


def problems(df: DataFrame, schema: TableSchema) -> DataFrame:
    """column, problem, rows: absent columns, wrong types (both from the plan alone), missing values and attributes, counted in one pass.

    A table that conforms gives no rows; so does an empty one with the right columns.
    """
    kinds, spark = dict(df.dtypes), df.sparkSession
    found = [(c, "absent" if c not in kinds else f"type {kinds[c]}", None) for c, t in schema.required.items() if c not in kinds or (t and kinds[c] not in t)]
    fixed = spark.createDataFrame(found, "column string, problem string, rows long")
    counted = {(c, "missing values"): _known(df, c).isNull() for c in [*schema.required, *schema.defaults] if c in kinds and c not in schema.nullable}
    for c, names in schema.attributes.items():
        for name in names if c in kinds else ():
            if isinstance(df.schema[c].dataType, T.StructType) and name not in df.schema[c].dataType.names:
                counted[c, f"no {name}"] = F.lit(True)
            else:
                got = F.get_json_object(c, f"$.{name}") if kinds[c] == "string" else F.col(c)[name]
                counted[c, f"no {name}"] = F.col(c).isNotNull() & got.isNull()
    if not counted:
        return fixed
    totals = df.agg(*[F.count_if(v).alias(f"n{i}") for i, v in enumerate(counted.values())])
    each = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(p).alias("problem"), F.col(f"n{i}").alias("rows")) for i, (c, p) in enumerate(counted)])
    return fixed.unionByName(totals.select(F.inline(each)).where("rows > 0"))


def validated(df: DataFrame, schema: TableSchema) -> DataFrame:
    """df with defaults, once checked: a ValueError names every problem. The answer is a few rows, never the table's."""
    got = with_defaults(df, schema)
    if bad := problems(got, schema).collect():
        raise ValueError("; ".join(f"{r['column']}: {r['problem']}" + (f" in {r['rows']} rows" if r["rows"] else "") for r in bad))
    return got
