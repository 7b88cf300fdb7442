"""Movement graphs: nodes are grid cells that a subject visits, edges join cells of a segment's ends."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faunaflow.functions.stages import written
from faunaflow.functions.times import DAY, micros
from faunaflow.operators.adjacent import with_adjacent


def step_features(df: DataFrame) -> DataFrame:
    """groupby_col, segment_start and features of each three segments in a row, with df's extra columns; planar x1, y1, x2, y2 in metres.

    dot_product: cosine of the turn into the next segment; tortuosity_1: beeline by path over all three; tortuosity_2: log of hours
    by squared beeline; sin_time, cos_time: the time of day on a circle; speed, step_length: of the first. Segments join where ends
    lie in the same square metre: without the first joint there is no turn, without both no tortuosity_1, and without a
    beeline no tortuosity_2. The last two segments of a subject begin no such window.
    """
    extra = [c for c in df.columns if c.startswith("extra__")]
    ends = ["x1", "y1", "x2", "y2"]
    rows = df.select("groupby_col", "segment_start", "segment_end", *extra, *ends, F.col("speed_kmhr").alias("speed"), F.col("dist_meters").alias("step_length"))
    rows = with_adjacent(rows, "groupby_col", "segment_start", after=[*ends, "segment_end"]).withColumnRenamed("after", "step_1")
    rows = with_adjacent(rows, "groupby_col", "segment_start", after=["step_1"]).withColumn("step_2", F.col("after.step_1")).where("step_2 is not null")
    rows = rows.select("*", *[F.col(f"step_{k}.{c}").alias(f"{c}_{k}") for k in (1, 2) for c in ends], F.col("step_2.segment_end").alias("end"))
    met = lambda a, b: (F.floor(f"x2{a}") == F.floor(f"x1{b}")) & (F.floor(f"y2{a}") == F.floor(f"y1{b}"))
    length = lambda k: F.hypot(F.col(f"x2{k}") - F.col(f"x1{k}"), F.col(f"y2{k}") - F.col(f"y1{k}"))
    path, beeline = length("") + length("_1") + length("_2"), F.hypot(F.col("x2_2") - F.col("x1"), F.col("y2_2") - F.col("y1"))
    turn = F.atan2(F.col("y2_1") - F.col("y2"), F.col("x2_1") - F.col("x2")) - F.atan2(F.col("y2") - F.col("y1"), F.col("x2") - F.col("x1"))
    angle = F.pmod(micros("segment_start"), F.lit(DAY)) / DAY * 2 * math.pi
    hours = F.expr("timestampdiff(MICROSECOND, segment_start, end)") / 3.6e9
    return rows.select(
        "groupby_col", "segment_start", *extra,
        F.when(met("", "_1"), F.cos(turn)).alias("dot_product"),
        F.when(met("", "_1") & met("_1", "_2") & (path > 0), beeline / path).alias("tortuosity_1"),
        F.when((beeline > 0) & (hours > 0), F.log(hours / (beeline * beeline))).alias("tortuosity_2"),
        F.sin(angle).alias("sin_time"), F.cos(angle).alias("cos_time"), "speed", "step_length",
    )


def cells(df: DataFrame, size: float) -> DataFrame:
    at = lambda c: F.floor(F.col(c) / size)
    return df.withColumns({"from_x": at("x1"), "from_y": at("y1"), "to_x": at("x2"), "to_y": at("y2")})


def nodes(df: DataFrame, size: float, features: list[str]) -> DataFrame:
    """groupby_col, cx, cy, weight and the mean of each feature over visits. weight counts starts, and one more where the first visit is an end."""
    rows = cells(df, size)
    visit = lambda x, y, k: F.struct(F.col(x).alias("cx"), F.col(y).alias("cy"), F.lit(k).alias("is_end"))
    visits = rows.select("groupby_col", "segment_start", *features, F.explode(F.array(visit("from_x", "from_y", 0), visit("to_x", "to_y", 1))).alias("visit")).select("*", "visit.*")
    starts = F.col("is_end") == 0
    got = visits.groupBy("groupby_col", "cx", "cy").agg(
        F.count_if(starts).alias("starts"), F.min_by("is_end", F.struct("segment_start", "is_end")).alias("first_end"), *[F.avg(F.when(starts, F.col(f))).alias(f) for f in features]
    )
    return got.select("groupby_col", "cx", "cy", (F.col("starts") + F.col("first_end")).alias("weight"), *features)


#: What :func:`step_features` computes.
FEATURES = ["dot_product", "tortuosity_1", "tortuosity_2", "sin_time", "cos_time", "speed", "step_length"]


def window_nodes(df: DataFrame, size: float) -> DataFrame:
    """Nodes with the mean of all step features; only segments that begin a full window of three count (:func:`step_features`, metres).

    A feature that is missing in a window is left out of its mean; a node that is only an end has none.
    """
    ends = ["x1", "y1", "x2", "y2"]
    rows = step_features(df.withColumns({f"extra__window_{c}": F.col(c) for c in ends})).withColumnsRenamed({f"extra__window_{c}": c for c in ends})
    return nodes(rows, size, FEATURES)


def edges(df: DataFrame, size: float) -> DataFrame:
    """groupby_col, a, b (cells as struct<cx, cy>, a below b): distinct undirected edges between different cells."""
    rows = cells(df, size)
    p, q = F.struct(F.col("from_x").alias("cx"), F.col("from_y").alias("cy")), F.struct(F.col("to_x").alias("cx"), F.col("to_y").alias("cy"))
    return rows.select("groupby_col", F.least(p, q).alias("a"), F.greatest(p, q).alias("b")).where("a <> b").distinct()


def both_ways(e: DataFrame) -> DataFrame:
    return e.unionByName(e.select("groupby_col", F.col("b").alias("a"), F.col("a").alias("b")))


def degree(e: DataFrame) -> DataFrame:
    return both_ways(e).groupBy("groupby_col", F.col("a").alias("node")).agg(F.count(F.lit(1)).alias("degree"))


def collective_influence(e: DataFrame, radius: int = 1) -> DataFrame:
    """node, influence: degree times (the sum of degree - 1 over all nodes within the radius, itself included, less its degree)."""
    e = written(e)
    links, deg = both_ways(e), degree(e)
    reach = deg.select("groupby_col", "node", F.col("node").alias("seen"))
    for _ in range(radius):
        step = reach.join(links.select("groupby_col", F.col("a").alias("seen"), F.col("b").alias("nxt")), ["groupby_col", "seen"])
        reach = reach.unionByName(step.select("groupby_col", "node", F.col("nxt").alias("seen"))).distinct()
    seen = reach.join(deg.select("groupby_col", F.col("node").alias("seen"), F.col("degree").alias("d")), ["groupby_col", "seen"])
    total = seen.groupBy("groupby_col", "node").agg(F.sum(F.col("d") - 1).alias("total"))
    return total.join(deg, ["groupby_col", "node"]).select("groupby_col", "node", (F.col("degree") * (F.col("total") - F.col("degree"))).alias("influence"))


def _paths_from(links: DataFrame, sources: DataFrame, cutoff: int | None) -> list[DataFrame]:
    """Level by level from each source: groupby_col, source, node, paths (the number of shortest paths)."""
    found = [written(sources.select("groupby_col", "source", F.col("source").alias("node"), F.lit(1.0).alias("paths")))]
    seen = found[0].select("groupby_col", "source", "node")
    while cutoff is None or len(found) <= cutoff:
        step = found[-1].withColumnRenamed("node", "a").join(links, ["groupby_col", "a"]).groupBy("groupby_col", "source", F.col("b").alias("node")).agg(F.sum("paths").alias("paths"))
        fresh = written(step.join(seen, ["groupby_col", "source", "node"], "left_anti"))
        if fresh.isEmpty():
            break
        found.append(fresh)
        # a neighbour of a level lies in it, or in the one before or after
        seen = found[-2].unionByName(fresh).select("groupby_col", "source", "node")
    return found


def betweenness(e: DataFrame, cutoff: int | None = None, batches: int = 1) -> DataFrame:
    """groupby_col, cx, cy, betweenness: the shares of shortest paths, of at most ``cutoff`` steps, that lead through each node.

    Levels of all searches advance together, as joins of (subject, source, node) with the edges: forwards the number of shortest paths
    adds up, backwards each node's share goes to its predecessors. No task holds a graph, and a subject's searches are dealt out
    by source and node. The rows of a search tree are needed for every source; ``batches`` takes a part of the sources at a time.
    """
    links = written(both_ways(e.where("groupby_col is not null")))
    nodes_ = written(links.select("groupby_col", F.col("a").alias("source")).distinct())
    key, parts = ["groupby_col", "source", "node"], []
    for batch in range(batches):
        levels = _paths_from(links, nodes_.where(F.pmod(F.xxhash64("groupby_col", "source"), F.lit(batches)) == batch), cutoff)
        share = None
        for level, before in zip(levels[:0:-1], levels[-2::-1]):
            now = level.withColumn("share", F.lit(0.0)) if share is None else level.join(share, key, "left").na.fill(0.0, ["share"])
            parts.append(now.select("groupby_col", "node", "share"))
            back = now.withColumnRenamed("node", "a").join(links, ["groupby_col", "a"]).select("groupby_col", "source", F.col("b").alias("node"), ((1 + F.col("share")) / F.col("paths")).alias("part"))
            share = back.join(before, key).groupBy(*key).agg((F.sum("part") * F.first("paths")).alias("share"))
            share = written(share)
    shares = nodes_.select("groupby_col", F.col("source").alias("node"), F.lit(0.0).alias("share"))
    for part in parts:
        shares = shares.unionByName(part)
    return shares.groupBy("groupby_col", "node").agg((F.sum("share") / 2).alias("betweenness")).select("groupby_col", "node.cx", "node.cy", "betweenness")


def mosaic(n: DataFrame, feature: str) -> DataFrame:
    """cx, cy and the mean of a feature over the subjects that have a value there."""
    return n.groupBy("cx", "cy").agg(F.avg(feature).alias(feature)).where(F.col(feature).isNotNull())


def path_cells(df: DataFrame, size: float) -> DataFrame:
    """df with from_x, from_y, to_x, to_y and, for each cell of the digital straight line between them, both ends included, cx, cy.

    One cell for each step along the longer axis; on the shorter one the nearest, halves away from the start.
    """
    rows = cells(df, size).withColumns({"dx": F.expr("abs(to_x - from_x)"), "dy": F.expr("abs(to_y - from_y)")})
    rows = rows.withColumn("step", F.explode(F.expr("sequence(0L, greatest(dx, dy))")))
    along = "if({d} = greatest(dx, dy), step, (2 * step * {d} + greatest(dx, dy)) div greatest(2 * greatest(dx, dy), 1))"
    place = lambda axis, d: F.expr(f"from_{axis} + cast(signum(to_{axis} - from_{axis}) as bigint) * ({along.format(d=d)})")
    return rows.withColumns({"cx": place("x", "dx"), "cy": place("y", "dy")}).drop("dx", "dy", "step")


INTERPOLATIONS = {"mean": F.avg, "max": F.max, "median": F.median, "min": F.min}


def interpolated(df: DataFrame, size: float, feature: str, how: str) -> DataFrame:
    """groupby_col, cx, cy and the feature: a subject's visited cells as in :func:`nodes`, and the cells that its segments only cross.

    A crossed cell gets the mean, largest, middle or least of the values of the cells where the crossing segments start; cells
    whose visits have no value are filled so too, missing values count for nothing. :func:`mosaic` then takes the mean over subjects.
    """
    if how not in INTERPOLATIONS:
        raise ValueError(f"how must be one of {', '.join(INTERPOLATIONS)}")
    own = nodes(df, size, [feature]).select("groupby_col", "cx", "cy", feature).where(F.col(feature).isNotNull())
    lines = df.select("groupby_col", *[F.col(c) for c in ("x1", "y1", "x2", "y2")]).where("groupby_col is not null")
    # segments between the same cells cross the same cells: they are counted before they are laid out
    ends = cells(lines, size).groupBy("groupby_col", "from_x", "from_y", "to_x", "to_y").agg(F.count(F.lit(1)).alias("times"))
    start = own.select("groupby_col", F.col("cx").alias("from_x"), F.col("cy").alias("from_y"), F.col(feature).alias("value"))
    laid = path_cells(ends.join(start, ["groupby_col", "from_x", "from_y"]).selectExpr("groupby_col", "value", "times", *[f"({c} + 0.5D) * {size!r}D as {p}" for c, p in (("from_x", "x1"), ("from_y", "y1"), ("to_x", "x2"), ("to_y", "y2"))]), size)
    crossed = laid.join(own, ["groupby_col", "cx", "cy"], "left_anti")
    if how == "mean":
        value = F.sum(F.col("value") * F.col("times")) / F.sum("times")
    elif how == "median":
        value = F.percentile("value", F.lit(0.5), F.col("times"))
    else:
        value = INTERPOLATIONS[how]("value")
    return own.unionByName(crossed.groupBy("groupby_col", "cx", "cy").agg(value.alias(feature)))
