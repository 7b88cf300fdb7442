"""Column work: rename, map, fill, extract, convert, and row-wise arithmetic."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Factors to the base unit of each kind: metres, square metres, seconds, metres a second.
UNITS = {"m": 1.0, "km": 1000.0, "m²": 1.0, "km²": 1e6, "s": 1.0, "min": 60.0, "h": 3600.0, "d": 86400.0, "m/s": 1.0, "km/h": 1 / 3.6, "%": 1.0}


def compare(df: DataFrame, column: str, op: str, value) -> DataFrame:
    """Rows where column op value; a missing value differs from every value and equals none."""
    c, v = F.col(column), F.lit(value)
    tests = {"equal": c == v, "ne": ~c.eqNullSafe(v), "ge": c >= v, "gt": c > v, "le": c <= v, "lt": c < v}
    return df.where(tests[op])


def drop_missing(df: DataFrame, column: str) -> DataFrame:
    known = F.col(column).isNotNull()
    return df.where(known & ~F.isnan(column) if isinstance(df.schema[column].dataType, (T.DoubleType, T.FloatType)) else known)


def map_columns(df: DataFrame, drop: list[str] = (), retain: list[str] = (), rename: dict[str, str] = {}, strict: bool = True) -> DataFrame:
    """Drop, keep only retain (absent ones are null unless strict), rename; listed columns first."""
    wanted = [*drop, *retain, *rename]
    if strict and (absent := [c for c in wanted if c not in df.columns]):
        raise KeyError(f"no such columns: {absent}")
    df = df.drop(*drop)
    if retain:
        df = df.select(*[F.col(c) if c in df.columns else F.lit(None).alias(c) for c in retain])
    return df.withColumnsRenamed(rename)


def reorder(df: DataFrame, first: list[str]) -> DataFrame:
    return df.select(*first, *[c for c in df.columns if c not in first])


def _unique(names: list[str], duplicate: str) -> list[str]:
    seen: dict[str, int] = {}
    out = []
    for n in names:
        k = n.lower()
        if k in seen and duplicate == "error":
            raise ValueError(f"columns clash: {n}")
        seen[k] = seen.get(k, -1) + 1
        out.append(n if seen[k] == 0 else f"{n}_{seen[k]}")
    return out


def strip_prefix(df: DataFrame, prefix: str, duplicate: str = "suffix") -> DataFrame:
    """Header without the prefix; clashes, whatever their case, get _1, _2, keep their name, or raise."""
    names = [c.removeprefix(prefix) for c in df.columns]
    if duplicate == "keep_original":
        taken = [n.lower() for n in names]
        names = [n if taken.count(n.lower()) == 1 else c for n, c in zip(names, df.columns)]
    return df.toDF(*_unique(names, duplicate))


def title_case(df: DataFrame, prefix: str) -> DataFrame:
    """Columns with the prefix lose it and are written in title case."""
    return df.toDF(*[re.sub(r"_+", " ", c.removeprefix(prefix)).title() if c.startswith(prefix) else c for c in df.columns])


def map_values(df: DataFrame, column: str, mapping: dict, missing: str = "preserve", replacement=None) -> DataFrame:
    """Dictionary mapping; unmapped values are kept, become null, or the replacement, as nulls do."""
    table = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    found = F.element_at(table, F.col(column))
    rest = {"preserve": F.col(column), "remove": F.lit(None), "replace": F.lit(replacement)}[missing]
    return df.withColumn(column, F.coalesce(found, rest))


def assign(df: DataFrame, column: str, value, keep: bool = False) -> DataFrame:
    return df if keep and column in df.columns else df.withColumn(column, F.lit(value))


def convert_unit(column: Column, given: str, wanted: str) -> Column:
    return column * (UNITS[given] / UNITS[wanted])


def with_unit(column: Column, given: str, wanted: str, decimals: int = 1) -> Column:
    return F.format_string(f"%.{decimals}f {wanted.replace('%', '%%')}", convert_unit(column, given, wanted))


def half_even(column: Column, decimals: int) -> Column:
    """Rounds ties to the even neighbour, on the binary value."""
    return F.rint(column * 10**decimals) / 10**decimals


def arithmetic(df: DataFrame, a: str, b: str, out: str, op: str) -> DataFrame:
    """``out`` of two columns; null where divided by zero. A remainder has the sign of the divisor."""
    x, y = F.col(a), F.col(b)
    found = {
        "add": x + y, "subtract": x - y, "multiply": x * y, "divide": F.try_divide(x, y), "floor_divide": F.floor(F.try_divide(x, y)),
        "modulo": (x % F.nullif(y, F.lit(0)) + y) % F.nullif(y, F.lit(0)), "power": F.pow(x, y), "min": F.least(x, y), "max": F.greatest(x, y),
    }
    return df.withColumn(out, found[op])


def over_rows(df: DataFrame, columns: list[str], op: str, out: str) -> DataFrame:
    """sum, count, min, max, mean, nunique or median of several columns of each row, without nulls."""
    values = F.filter(F.array(*[F.col(c).cast("double") for c in columns]), lambda x: x.isNotNull())
    n, total = F.size(values), F.aggregate(values, F.lit(0.0), lambda s, x: s + x)
    sort, mid = F.sort_array(values), F.expr("0")
    at = lambda k: F.get(sort, k)
    mid = (at(F.floor((n - 1) / 2).cast("int")) + at(F.floor(n / 2).cast("int"))) / 2
    found = {"sum": total, "count": n.cast("long"), "min": F.array_min(values), "max": F.array_max(values), "mean": F.try_divide(total, n), "nunique": F.size(F.array_distinct(values)).cast("long"), "median": mid}
    return df.withColumn(out, found[op])


def zscore(df: DataFrame, column: str, out: str) -> DataFrame:
    stats = df.agg(F.avg(column).alias("z_mean"), F.stddev_samp(column).alias("z_dev"))
    return df.join(F.broadcast(stats)).withColumn(out, F.try_divide(F.col(column) - F.col("z_mean"), F.col("z_dev"))).drop("z_mean", "z_dev")


def first_field(column: str, paths: list[str], kind: str = "string") -> Column:
    """The first of several JSON paths that is present, cast; what does not cast is null."""
    return F.coalesce(*[F.get_json_object(column, f"$.{p}") for p in paths]).try_cast(kind)


def as_type(column: str, kind: str) -> Column:
    c = F.col(column).cast("string")
    if kind == "bool":
        low = F.lower(F.trim(c))
        return F.when(low.isin("true", "1"), True).when(low.isin("false", "0"), False)
    return c.try_cast({"str": "string", "float": "double", "datetime": "timestamp_ntz", "date": "date", "int": "bigint"}[kind])


def decode_details(df: DataFrame, column: str) -> DataFrame:
    """column as a map from JSON text; bad, empty and null texts are empty maps and counted in bad_json."""
    parsed = F.from_json(F.col(column), "map<string,string>")
    bad = F.col(column).isNotNull() & (F.trim(column) != "") & parsed.isNull()
    return df.withColumns({"bad_json": bad, column: F.coalesce(parsed, F.create_map().cast("map<string,string>"))})


def flatten_json(df: DataFrame, column: str) -> DataFrame:
    """Every key of a JSON text column as column__key, nested ones joined by __; one pass finds the schema."""
    kind = df.select(F.schema_of_variant_agg(F.try_parse_json(column)).alias("s")).first()["s"]
    if kind in (None, "VOID"):
        return df.drop(column)
    parsed = F.from_json(F.col(column), kind.replace("OBJECT<", "STRUCT<"))
    typed = df.withColumn(column, parsed)

    def leaves(t: T.DataType, path: list[str]):
        if isinstance(t, T.StructType):
            for f in t.fields:
                yield from leaves(f.dataType, [*path, f.name])
        else:
            yield path

    found = [F.col(".".join(f"`{p}`" for p in path)).alias("__".join(path)) for path in leaves(typed.schema[column].dataType, [column])]
    return typed.select(*[c for c in df.columns if c != column], *found)


def explode_list(df: DataFrame, column: str) -> DataFrame:
    """One row for each element; an empty or null list leaves one row with null."""
    return df.withColumn(column, F.explode_outer(column))


def pack(df: DataFrame, columns: list[str], into: str = "additional") -> DataFrame:
    """These columns as texts in one map, added to an existing one."""
    own = F.create_map(*[x for c in columns for x in (F.lit(c), F.col(c).cast("string"))])
    whole = F.map_concat(F.coalesce(F.col(into), F.create_map().cast("map<string,string>")), own) if into in df.columns else own
    return df.withColumn(into, whole).drop(*columns)


def shift_radius(df: DataFrame, column: str) -> DataFrame:
    """Radii shifted so that the least is 1 where some are below 1; missing ones are 1."""
    least = df.agg(F.min(column).alias("least_radius"))
    shift = F.when(F.col("least_radius") < 1, 1 - F.col("least_radius")).otherwise(F.lit(0.0))
    return df.join(F.broadcast(least)).withColumn(column, F.coalesce(F.col(column) + shift, F.lit(1.0))).drop("least_radius")


def concat(frames: list[DataFrame], ensure: list[str] = ()) -> DataFrame:
    """Rows of all frames; columns that one lacks are null there, ensured ones exist."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out.withColumns({c: F.lit(None).cast("string") for c in ensure if c not in out.columns}) if ensure else out


def sort_values(df: DataFrame, column: str, ascending: bool = True, na_last: bool = True) -> DataFrame:
    c = F.col(column)
    return df.orderBy({(True, True): c.asc_nulls_last(), (True, False): c.asc_nulls_first(), (False, True): c.desc_nulls_last(), (False, False): c.desc_nulls_first()}[ascending, na_last])


def first_by_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("first_rank", rank).where("first_rank = 1").drop("first_rank")


#: Words that a query may not hold, as whole words outside quotes.
BLOCKED = ["drop", "create", "alter", "truncate", "insert", "update", "delete", "replace", "pragma", "attach"]
#: Strings, quoted names, comments, words, and any other character.
TOKENS = r"""(?s)'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|`[^`]*`|--[^\n]*|/\*.*?(?:\*/|$)|\w+|."""


def run_sql(df: DataFrame, query: str) -> DataFrame:
    """A single SELECT over the table ``df``; an empty query gives the frame back.

    Words in strings and quoted names are not looked at. Comments, further statements and the words of BLOCKED raise ValueError, but
    ``replace`` as a function is allowed.
    """
    text = query.strip()
    tokens = re.findall(TOKENS, text)
    while tokens and (tokens[-1] == ";" or tokens[-1].isspace()):
        tokens.pop()
    if not tokens:
        return df
    if len(text) > 10_000 or ";" in tokens or tokens[0].lower() not in ("select", "with"):
        raise ValueError("only one SELECT of at most 10000 characters")
    if any(t.startswith(("--", "/*")) for t in tokens):
        raise ValueError("comments are not allowed")
    words = [(t.lower(), after.lstrip()[:1]) for t, after in zip(tokens, ["".join(tokens[i + 1 : i + 3]) for i in range(len(tokens))])]
    if found := [w for w, after in words if w in BLOCKED and not (w == "replace" and after == "(")]:
        raise ValueError(f"not allowed: {found}")
    # braces of the query's own stand for themselves
    named = ["{df}" if t.lower() in ("df", "`df`") else t.replace("{", "{{").replace("}", "}}") for t in tokens]
    return df.sparkSession.sql("".join(named), df=df)


def hex_to_rgba(column: Column) -> Column:
    part = lambda i: F.conv(F.substring(F.ltrim(column, F.lit("#")), i, 2), 16, 10).cast("int")
    return F.array(part(1), part(3), part(5), F.lit(255))


def rgb_text_to_hex(column: Column) -> Column:
    parts = F.split(column, r"\s*,\s*")
    return F.concat(F.lit("#"), *[F.lpad(F.hex(F.get(parts, i).cast("int")), 2, "0") for i in range(3)])


def rgba_to_css(column: Column) -> Column:
    return F.format_string("rgba(%d, %d, %d, %s)", F.get(column, 0), F.get(column, 1), F.get(column, 2), F.get(column, 3) / 255)
