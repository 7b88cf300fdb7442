"""Queries do their whole job: small inputs with the rows that an earlier cut left out."""

import datetime as dt
import math
import time

import numpy as np
import pytest

from faunaflow.jobs import geometry, mapping, registry
from faunaflow.operators import classify, ranges, spatial


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Events of three subjects: short, long and very fast steps, and users other than 0 and 1."""
    folder = tmp_path_factory.mktemp("whole")
    hours = {0: [0, 1, 1.5, 40], 1: [0, 0.001, 200], 7: [0, 3, 9]}
    rows, start = [], dt.datetime(2024, 1, 1)
    for user, at in hours.items():
        rows += [(len(rows) + i, user, "abc"[i % 3], float(i), '{"k": 1}', start + dt.timedelta(hours=h)) for i, h in enumerate(at)]
    events = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double, props string, ts timestamp_ntz")
    events.write.parquet(f"{folder}/events.parquet")
    spark.createDataFrame([(k, f"N{k:02}") for k in range(25)], "n_nationkey int, n_name string").write.parquet(f"{folder}/nation.parquet")
    return str(folder)


def pieces(x1, y1, x2, y2, size):
    """Cells of a segment with the share of its length, cut at every grid line in reach."""
    cuts = {0.0, 1.0}
    for a, b in ((x1, x2), (y1, y2)):
        for k in range(math.floor(min(a, b) / size) - 1, math.ceil(max(a, b) / size) + 2):
            if a != b and 0 < (k * size - a) / (b - a) < 1:
                cuts.add((k * size - a) / (b - a))
    cuts = sorted(cuts)
    cell = lambda t: (math.floor((x1 + t * (x2 - x1)) / size), math.floor((y1 + t * (y2 - y1)) / size))
    return [(*cell((p + q) / 2), q - p) for p, q in zip(cuts, cuts[1:])]


def test_grid_traversal_against_brute_force(spark):
    lines = {
        "diagonal": (0.5, 0.5, 3.5, 3.5), "slanted": (-1.25, 0.75, 2.5, -1.5), "back": (2.75, 1.25, -0.5, 0.25),
        "flat": (0.25, 0.5, 3.75, 0.5), "upright": (0.5, 2.75, 0.5, -1.25), "on a line": (0.5, 1.0, 2.5, 1.0), "from a corner": (1.0, 1.0, 3.0, 2.0),
        "one cell": (0.25, 0.25, 0.75, 0.5), "no length": (1.25, 1.75, 1.25, 1.75), "no length on a line": (2.0, 1.0, 2.0, 1.0),
    }
    df = spark.createDataFrame([(n, *v) for n, v in lines.items()], "n string, x1 double, y1 double, x2 double, y2 double")
    got = {}
    for r in spatial.grid_traversal(df, "x1", "y1", "x2", "y2", 1.0).collect():
        got.setdefault(r.n, []).append((r.ix, r.iy, r.share))
    for n, line in lines.items():
        want = sorted(pieces(*line, 1.0))
        assert [g[:2] for g in sorted(got[n])] == [w[:2] for w in want], n
        assert [g[2] for g in sorted(got[n])] == pytest.approx([w[2] for w in want]), n


def test_grid_path_of_every_segment(spark, tables):
    got = registry.queries()["g7_grid_path"](spark, tables)
    assert got.columns == ["event_id", "ix", "iy", "share"]
    total = {r.event_id: 0.0 for r in got.collect()}
    for r in got.collect():
        total[r.event_id] += r.share
    assert len(total) == 7 and list(total.values()) == pytest.approx([1.0] * 7)


def densities(segments, size, most, shape, scale, extent=None):
    """The elliptical density cell by cell, with the speed model's integral by fine sums."""
    logs = np.linspace(math.log(0.001), math.log(most), 400_001)
    v = np.exp((logs[1:] + logs[:-1]) / 2)
    f = shape / scale * (v / scale) ** (shape - 1) * np.exp(-((v / scale) ** shape)) * np.diff(logs)
    left = np.r_[np.cumsum(f[::-1])[::-1], 0.0]
    sums = {}
    for x1, y1, x2, y2, t in segments:
        box = [min(x1, x2) - most * t, min(y1, y2) - most * t, max(x1, x2) + most * t, max(y1, y2) + most * t]
        box = [max(a, b) for a, b in zip(box[:2], extent[:2])] + [min(a, b) for a, b in zip(box[2:], extent[2:])] if extent else box
        own = {}
        for i in range(math.floor(box[0] / size) - 1, math.ceil(box[2] / size) + 1):
            for j in range(math.floor(box[1] / size) - 1, math.ceil(box[3] / size) + 1):
                px, py = (i + 0.5) * size, (j + 0.5) * size
                speed = (math.hypot(px - x1, py - y1) + math.hypot(px - x2, py - y2)) / t * 3.6
                if speed < most and (not extent or extent[0] <= px <= extent[2] and extent[1] <= py <= extent[3]):
                    own[i, j] = np.interp(math.log(max(speed, 0.001)), logs, left)
        for c, w in own.items():
            sums[c] = sums.get(c, 0.0) + w / sum(own.values()) / t
    return {c: v / sum(sums.values()) for c, v in sums.items()}


@pytest.mark.parametrize("block", [256, 4])
def test_elliptical_density_of_long_and_fast_segments(spark, monkeypatch, block):
    monkeypatch.setattr(ranges, "BLOCK", block)
    monkeypatch.setattr(ranges, "HELD_BLOCKS", 3)
    monkeypatch.setattr(ranges, "KEPT_BLOCKS", 2)
    segments = [(0.0, 0.0, 1000.0, 0.0, 3600.0), (-2000.0, 500.0, 2500.0, 900.0, 100_000.0), (100.0, 100.0, 5100.0, -4000.0, 400.0), (300.0, 300.0, 300.0, 300.0, 900.0)]
    extent = (-9000.0, -8000.0, 9500.0, 8500.0)
    df = spark.createDataFrame(segments, "x1 double, y1 double, x2 double, y2 double, timespan_seconds double")
    got = {(r.ix, r.iy): r.density for r in ranges.elliptical_density(df, 500.0, 70.0, 0.55, 1.7, extent=extent).collect()}
    want = densities(segments, 500.0, 70.0, 0.55, 1.7, extent)
    assert set(got) == set(want)
    top = max(want.values())
    assert max(abs(got[c] - want[c]) for c in want) < 1e-4 * top


@pytest.mark.parametrize("shape,kept,call", [(0.55, 256, 2048), (2.5, 256, 2048), (0.55, 1, 3)])
def test_elliptical_density_of_blocks_and_of_cells(spark, monkeypatch, shape, kept, call):
    """Blocks weighed at a few places give what each cell gives: still, slow, fast and long segments, a reach that ends among the cells."""
    segments = [(0.0, 0.0, 900.0, 0.0, 3600.0), (-9000.0, 500.0, 22_500.0, 900.0, 90_000.0), (100.0, 100.0, 5100.0, -4000.0, 400.0), (3300.0, 300.0, 3300.0, 300.0, 900.0)]
    segments += [(40_000.0, 30_000.0, 40_010.0, 30_000.0, 40_000.0), (-7000.0, 100.0, -7010.0, 100.0, 4e8), (900.0 * math.pi, 0.0, 990.0, 800.0, 7200.0), (5.0, 5.0, 6.0, 6.0, 36_000.0)]

    def found(segments):
        df = spark.createDataFrame(segments, "x1 double, y1 double, x2 double, y2 double, timespan_seconds double")
        got = ranges.elliptical_density(df, 250.0, 70.0, shape, 1.7, extent=(-31_000.0, -28_000.0, 52_500.0, 41_000.0))
        return {(r.ix, r.iy): r.density for r in got.collect()}

    for some in (segments, segments[:1], segments[4:5]):
        with monkeypatch.context() as patched:
            patched.setattr(ranges, "LEAF", ranges.BLOCK)
            cells = found(some)
        with monkeypatch.context() as patched:
            patched.setattr(ranges, "KEPT_BLOCKS", kept)
            patched.setattr(ranges, "CALL", call)
            blocks = found(some)
        assert set(blocks) == set(cells) and len(cells) == (92_184 if len(some) > 1 else len(cells))
        assert all(v > 0 and abs(v - cells[c]) <= 1e-3 * cells[c] + 1e-9 for c, v in blocks.items())
        assert sum(blocks.values()) == pytest.approx(1)


def test_elliptical_density_weighs_far_fewer_places_than_cells(spark):
    """A segment that reaches 200,000 cells takes a small part of the time of weighing them all."""
    rng = np.random.default_rng(5)
    many = np.c_[rng.uniform(0, 30_000, (3000, 4)), rng.uniform(20_000, 90_000, 3000)]
    df = spark.createDataFrame(many.tolist(), "x1 double, y1 double, x2 double, y2 double, timespan_seconds double").cache()
    assert df.count() == 3000
    extent, i = (-550_000.0, -550_000.0, 550_000.0, 550_000.0), np.arange(-220, 220)
    xs, table = (i + 0.5) * 2500, np.linspace(1.0, 0.0, 400_000)
    start = time.process_time()
    for x1, y1, x2, y2, t in many[:60]:
        speed = np.sqrt(((xs - x1) ** 2)[:, None] + (xs - y1) ** 2) + np.sqrt(((xs - x2) ** 2)[:, None] + (xs - y2) ** 2)
        assert table[np.minimum(speed / t * 1000, 399_999).astype(int)].sum() > 0
    plain = (time.process_time() - start) * 3000 / 60
    start = time.time()
    got = ranges.elliptical_density(df, 2500.0, 4000.0, 0.55, 1.7, extent=extent, tasks=1).agg({"density": "sum", "ix": "count"}).first()
    assert time.time() - start < plain / 2
    assert got["sum(density)"] == pytest.approx(1) and got["count(ix)"] == len(i) ** 2


def test_density_and_cover_take_every_segment(spark, tables):
    segments = geometry._metric_segments(spark, tables)
    rows = [tuple(r) for r in segments.select("x1", "y1", "x2", "y2", "timespan_seconds").collect()]
    assert len(rows) == 7 and max(r[4] for r in rows) > 10_800 and min(r[4] for r in rows) < 600
    speeds = [r.speed_kmhr for r in segments.collect()]
    assert max(speeds) > 12
    cells = {(r.ix, r.iy): r.density for r in registry.queries()["a16_elliptical_density"](spark, tables).collect()}
    assert sum(cells.values()) == pytest.approx(1, abs=0.02)
    # the fastest segment is the shortest, so nearly all of the density lies along it
    fast = min(rows, key=lambda r: r[4])
    assert sum(v for (i, j), v in cells.items() if min(math.hypot((i + 0.5) * 2500 - fast[k], (j + 0.5) * 2500 - fast[k + 1]) for k in (0, 2)) < 15_000) > 0.5
    cover = set()
    for x1, y1, x2, y2, _ in rows:
        for i in range(math.floor((min(x1, x2) - 1000) / 500), math.floor((max(x1, x2) + 1000) / 500) + 1):
            for j in range(math.floor((min(y1, y2) - 1000) / 500), math.floor((max(y1, y2) + 1000) / 500) + 1):
                px, py, dx, dy = (i + 0.5) * 500 - x1, (j + 0.5) * 500 - y1, x2 - x1, y2 - y1
                t = max(0, min(1, (px * dx + py * dy) / (dx * dx + dy * dy or 1)))
                if math.hypot(px - t * dx, py - t * dy) <= 1000:
                    cover.add((i, j))
    assert registry.queries()["a4_merged_coverage"](spark, tables).first().cells == len(cover)


def test_features_types_and_grid_of_all_rows(spark, tables):
    queries = registry.queries()
    near = queries["j9_proximity"](spark, tables).collect()
    assert len(near) == 7 * 25 and {r.feature_id for r in near} == set(range(25))
    flags = {r.event_id: r.flag for r in queries["f3_as_type"](spark, tables).collect()}
    users = {r.event_id: r.user_id for r in spark.read.parquet(f"{tables}/events.parquet").collect()}
    assert flags == {e: {0: False, 1: True}.get(u) for e, u in users.items()}
    fixes = mapping.fixes(spark, tables).collect()
    cells = queries["g4_mesh_grid"](spark, tables).collect()
    columns, rows = [{math.floor(v(f) / n) for f in fixes} for v, n in ((lambda f: f.lon, 0.25), (lambda f: f.lat, 0.2))]
    assert len(cells) == (max(columns) - min(columns) + 1) * (max(rows) - min(rows) + 1)
    assert all(any(c.x0 <= f.lon + 1e-9 and f.lon < c.x0 + 0.25 + 1e-9 and c.y0 <= f.lat + 1e-9 and f.lat < c.y0 + 0.2 + 1e-9 for c in cells) for f in fixes)


def exact_breaks(v, k):
    """Upper bounds and squared deviation of the best classes, by the plain dynamic programme over sorted distinct values."""
    v = np.array(v) - np.mean(v)
    s, q, size = np.r_[0, np.cumsum(v)], np.r_[0, np.cumsum(v * v)], len(v)
    best, cuts = np.r_[0.0, [q[j] - s[j] ** 2 / j for j in range(1, size + 1)]], []
    for c in range(2, k + 1):
        after, cut = np.full(size + 1, np.inf), np.zeros(size + 1, dtype=int)
        for j in range(c, size + 1):
            i = np.arange(c - 1, j)
            total = best[i] + (q[j] - q[i]) - (s[j] - s[i]) ** 2 / (j - i)
            cut[j], after[j] = i[total.argmin()], total.min()
        best = after
        cuts.append(cut)
    ends = [size]
    for cut in reversed(cuts):
        ends.append(cut[ends[-1]])
    return ends[::-1], best[size]


def test_jenks_is_exact_above_2000_skewed_values(spark, monkeypatch):
    rng = np.random.default_rng(7)
    v = np.unique(np.r_[rng.exponential(1.0, 1500), 6 + rng.normal(0, 0.05, 1000), 9 + rng.exponential(0.3, 500), 1e4])
    ends, least = exact_breaks(v, 5)
    df = spark.createDataFrame([(float(x),) for x in v], "v double")
    assert classify.breaks(df, "v", "fisher_jenks", k=5) == [v[e - 1] for e in ends]
    # above the bound the bins beside each break are divided down to single values
    monkeypatch.setattr(classify, "MAX_BREAK_VALUES", 500)
    monkeypatch.setattr(classify, "PIECES", 40)
    got = np.searchsorted(v, classify.breaks(df, "v", "fisher_jenks", k=5), "right")
    parts = np.split(v, got[:-1])
    assert len(parts) == 5 and sum(((p - p.mean()) ** 2).sum() for p in parts) <= 1.001 * least


def test_images_of_the_very_time_nearest_and_by_days(spark):
    from datetime import datetime, timedelta

    from faunaflow.operators import seasons

    start = datetime(2024, 5, 1)
    shots = [("c", start + timedelta(days=8)), ("a", start), ("b", start + timedelta(days=4)), ("d", start + timedelta(days=12))]
    images = spark.createDataFrame(shots, "img_id string, img_time timestamp_ntz")
    times = {1: 0, 2: 4, 3: 5.5, 4: 6, 5: 20, 6: -3, 7: 12}
    rows = spark.createDataFrame([(i, start + timedelta(days=t)) for i, t in times.items()], "id int, t timestamp_ntz")
    got = lambda df: {r.id: "".join(r.images) for r in df.collect()}
    assert got(seasons.nearest_images(rows, "id", "t", images, 1, 1, exact=True)) == {1: "ab", 2: "abc", 3: "bc", 4: "bc", 5: "d", 6: "a", 7: "cd"}
    assert got(seasons.nearest_images(rows, "id", "t", images, 2, 0, exact=True)) == {1: "a", 2: "ab", 3: "ab", 4: "ab", 5: "cd", 6: "", 7: "bcd"}
    assert got(seasons.nearest_images(rows, "id", "t", images, 0, 0)) == {1: "a", 2: "b", 3: "b", 4: "c", 5: "d", 6: "a", 7: "d"}
    order = sorted(shots, key=lambda s: s[1])
    for before, after in [(0, 0), (4, 0), (2, 3), (30, 30)]:
        want = {i: "".join(n for n, at in order if timedelta(days=t - before) <= at - start <= timedelta(days=t + after)) for i, t in times.items()}
        assert got(seasons.images_within(rows, "id", "t", images, before, after)) == want
    assert got(seasons.nearest_images(rows.where("id = 1"), "id", "t", images.limit(0), 0, 0)) == {1: ""}
    with pytest.raises(ValueError):
        seasons.images_within(rows, "id", "t", images, 1, -1)


def digital_line(x0, y0, x1, y1):
    """Cells of a line by an error term that is carried from step to step."""
    dx, dy, sx, sy = abs(x1 - x0), abs(y1 - y0), (x1 > x0) - (x1 < x0), (y1 > y0) - (y1 < y0)
    steep = dy > dx
    major, minor, x, y, out = max(dx, dy), min(dx, dy), x0, y0, []
    d = 2 * minor - major
    for _ in range(major):
        out.append((x, y))
        if d >= 0:
            x, y, d = (x + sx, y, d - 2 * major) if steep else (x, y + sy, d - 2 * major)
        x, y, d = (x, y + sy, d + 2 * minor) if steep else (x + sx, y, d + 2 * minor)
    return [*out, (x1, y1)]


def test_paths_fill_a_mosaic(spark):
    import random
    from collections import defaultdict
    from statistics import median

    from faunaflow.operators.network import interpolated, mosaic

    rng = random.Random(2)
    rows = [(rng.choice("ab"), i, *(rng.randint(-8, 8) + 0.5 for _ in range(4)), rng.choice([None, 1.0, 2.0, 7.0])) for i in range(40)] + [("c", 0, 0.5, 0.5, 0.5, 0.5, 3.0)]
    df = spark.createDataFrame(rows, "groupby_col string, segment_start int, x1 double, y1 double, x2 double, y2 double, v double")
    at = lambda *p: tuple(math.floor(c) for c in p)
    for how, f in {"mean": lambda x: sum(x) / len(x), "max": max, "median": median, "min": min}.items():
        own, crossed = defaultdict(list), defaultdict(list)
        for g, _, x1, y1, _, _, v in rows:
            if v is not None:
                own[g, at(x1, y1)].append(v)
        means = {k: sum(v) / len(v) for k, v in own.items()}
        for g, _, x1, y1, x2, y2, _ in rows:
            for cell in digital_line(*at(x1, y1, x2, y2)):
                if (g, cell) not in means and (g, at(x1, y1)) in means:
                    crossed[g, cell].append(means[g, at(x1, y1)])
        want = means | {k: f(v) for k, v in crossed.items()}
        got = interpolated(df, 1.0, "v", how)
        assert {(r.groupby_col, (r.cx, r.cy)): r.v for r in got.collect()} == pytest.approx(want)
        cells = defaultdict(list)
        for (_, cell), v in want.items():
            cells[cell].append(v)
        assert {(r.cx, r.cy): r.v for r in mosaic(got, "v").collect()} == pytest.approx({c: sum(v) / len(v) for c, v in cells.items()})
    with pytest.raises(ValueError):
        interpolated(df, 1.0, "v", "mode")


def test_sums_before_keys(spark):
    import random

    from faunaflow.operators.asof import sums_before

    rng = random.Random(1)
    keys = sorted({rng.randint(-(2**40), 2**40) for _ in range(60)} | set(range(-20000, 20000, 300)) | {0, -1, 1})
    rows = [(k, rng.randint(0, 5)) for k in keys]
    want, total = {}, 0
    for k, n in rows:
        want[k], total = total, total + n
    got = sums_before(spark.createDataFrame(rows, "k long, n long"), "k", "n")
    assert {r.k: r.before for r in got.collect()} == want


def test_lookups_in_a_table_of_times(spark):
    """Images of one time, empty buckets between, rows before, after and without times; against lists. No task holds the table."""
    import random
    from datetime import datetime, timedelta

    from faunaflow.operators import seasons

    rng, zero = random.Random(7), datetime(1969, 12, 20)
    shots = [(f"i{k:02}", zero + timedelta(hours=rng.choice([rng.randint(0, 40), rng.randint(900, 960), 3000]))) for k in range(50)]
    rows = [(k, zero + timedelta(hours=rng.choice([rng.randint(-30, 60), rng.randint(880, 980), 2000, 4000])) if k else None) for k in range(120)]
    images, df = spark.createDataFrame(shots, "img_id string, img_time timestamp_ntz"), spark.createDataFrame(rows, "id int, t timestamp_ntz")
    order = sorted((t, i) for i, t in shots)
    for before, after in [(1, 1), (0, 3), (7, 0)]:
        got = seasons.nearest_images(df, "id", "t", images, before, after)
        for r in got.collect():
            t = dict(rows)[r.id]
            earlier = [i for at, i in order if t and at <= t]
            later = [i for at, i in order if t and at > t]
            assert r.images == (earlier[-before:] if before else []) + later[:after]
    got = seasons.images_by_midpoint(df, "t", images, 2)
    found = {}
    for r in got.collect():
        found.setdefault(r.id, []).append(r.img_id)
    for k, t in rows:
        own = [n for n in range(len(order)) if t and (n == 0 or t > order[n - 1][0] + (order[n][0] - order[n - 1][0]) / 2) and (n == len(order) - 1 or t <= order[n][0] + (order[n + 1][0] - order[n][0]) / 2)]
        assert found.get(k, []) == ([i for _, i in order[max(0, own[0] - 2) : own[0] + 3]] if own else [])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "SinglePartition" not in plan


def test_betweenness_against_single_searches(spark):
    """Random graphs of several subjects, one in two parts, with and without a cutoff, sources at once and in batches."""
    import random
    from collections import defaultdict

    from faunaflow.operators.network import betweenness

    rng, pairs = random.Random(5), set()
    for s, n, m in (("a", 12, 18), ("b", 7, 6), ("c", 2, 1)):
        while sum(p[0] == s for p in pairs) < m:
            x, y = sorted(rng.sample(range(n), 2))
            pairs.add((s, (x, -x), (y, -y)))
    df = spark.createDataFrame(sorted(pairs), "groupby_col string, a struct<cx:long,cy:long>, b struct<cx:long,cy:long>")

    def plain(cutoff):
        near, score = defaultdict(set), {}
        for s, x, y in pairs:
            near[s, x].add((s, y))
            near[s, y].add((s, x))
        score = dict.fromkeys(near, 0.0)

        def routes(a, b):
            """All shortest paths between two nodes, by growing every path."""
            paths, seen = [[a]], {a}
            while paths:
                if done := [p for p in paths if p[-1] == b]:
                    return done
                paths = [[*p, n] for p in paths for n in near[p[-1]] if n not in seen]
                seen |= {p[-1] for p in paths}
            return []

        for a in near:
            for b in near:
                if a < b and a[0] == b[0] and (found := routes(a, b)) and (cutoff is None or len(found[0]) - 1 <= cutoff):
                    for p in found:
                        for n in p[1:-1]:
                            score[n] += 1 / len(found)
        return score

    for cutoff, batches in ((None, 1), (2, 3)):
        got = {(r.groupby_col, (r.cx, r.cy)): r.betweenness for r in betweenness(df, cutoff, batches).collect()}
        assert got == pytest.approx(plain(cutoff))


def test_queries_of_empty_tables(spark, tmp_path):
    """Statistics of nothing give no rows and raise nothing."""
    spark.createDataFrame([], "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    every = registry.queries()
    for name in ("c1_equal_interval", "c1_quantile", "c1_std_mean", "c1_max_breaks", "c1_ranges", "c2_fisher_jenks", "a25_value_cuts", "g4_mesh_grid", "a17_track_density", "a16_elliptical_density", "g8_weibull", "p13_select_patrols"):
        assert every[name](spark, str(tmp_path)).collect() == [], name


def test_area_of_merged_ground(spark):
    """One line, two that overlap, one in both directions and many times, a point, none; against formulas and a fine raster."""
    from faunaflow.operators.summary import coverage_area

    frame = lambda rows: spark.createDataFrame([(g, *map(float, r)) for g, *r in rows], "g string, x1 double, y1 double, x2 double, y2 double")
    area = lambda rows, **k: {r.g: r.area_km2 for r in coverage_area(frame(rows), 500.0, ["g"], **k).collect()}
    one = 1000 * 500 / 1e6 + math.pi * 0.25**2
    lines = [("flat", 0, 0, 1000, 0), ("steep", 10, 20, 10, 1020), ("slant", 0, 0, 600, 800), ("point", 5, 5, 5, 5)]
    got = area(lines)
    assert got == pytest.approx({"flat": one, "steep": one, "slant": one, "point": math.pi * 0.25**2}, rel=5e-3)
    assert area([("a", *lines[2][1:]), ("a", 600, 800, 0, 0)] * 20)["a"] == pytest.approx(got["slant"], rel=1e-9)
    both = [("x", 0, 0, 1000, 0), ("x", 500, -500, 500, 500), ("x", 100_000, 0, 101_000, 0)]
    xs, ys = np.meshgrid(np.arange(-300, 1300, 4.0) + 2, np.arange(-800, 800, 4.0) + 2)
    far = lambda x1, y1, x2, y2: np.hypot(xs - x1 - (t := np.clip(((xs - x1) * (x2 - x1) + (ys - y1) * (y2 - y1)) / ((x2 - x1) ** 2 + (y2 - y1) ** 2), 0, 1)) * (x2 - x1), ys - y1 - t * (y2 - y1))
    union = ((far(0, 0, 1000, 0) <= 250) | (far(500, -500, 500, 500) <= 250)).sum() * 16 / 1e6
    assert area(both)["x"] == pytest.approx(union + one, rel=5e-3)
    assert area(both, strips=128, salts=1)["x"] == pytest.approx(union + one, rel=3e-3)
    assert coverage_area(frame([]), 500.0).first().area_km2 == 0.0


def test_bounds_of_lines(spark):
    from faunaflow.operators import trend

    # fixed values: quantiles of Student's t from printed tables
    for freedom, want in {1: 12.7062, 2: 4.30265, 5: 2.57058, 8: 2.30600, 30: 2.04227, 200: 1.97190, 201: 1.97184, 1000: 1.96234}.items():
        assert trend.t_quantile(0.975, freedom) == pytest.approx(want, rel=2e-6)
    x = [0.0, 1.0, 2.0, 3.0, 4.0]
    y = [1.0, 2.9, 5.2, 6.8, 9.1]
    rows = [("a", *p) for p in zip(x, y)] + [("two", 0.0, 1.0), ("two", 1.0, 3.0), ("a", None, 1.0)]
    got = {(r.k, r.x): r for r in trend.linear_prediction(spark.createDataFrame(rows, "k string, x double, y double"), "k", "x", "y").collect()}
    slope = sum((a - 2) * (b - 5) for a, b in zip(x, y)) / 10
    rss = sum((b - 5 - slope * (a - 2)) ** 2 for a, b in zip(x, y))
    width = 3.182446 * math.sqrt(rss / 3 * (1 / 5 + 4 / 10))
    assert (got["a", 0.0].mean, got["a", 0.0].lower, got["a", 0.0].upper) == pytest.approx((5 - 2 * slope, 5 - 2 * slope - width, 5 - 2 * slope + width), rel=1e-5)
    assert got["two", 1.0].mean == pytest.approx(3) and got["two", 1.0].lower is None


@pytest.mark.parametrize("family", ["poisson", "gamma", "gaussian_log", "binomial"])
def test_weighted_fits_are_likeliest(family):
    """Moving any coefficient lowers the likelihood, and the covariance is its curvature."""
    from faunaflow.operators import trend

    rng = np.random.default_rng(4)
    t = np.linspace(0, 2, 60)
    e = 0.3 + 0.5 * t
    y = {"poisson": rng.poisson(np.exp(e)), "gamma": rng.gamma(5, np.exp(e) / 5), "gaussian_log": np.exp(e) + rng.normal(0, 0.1, 60), "binomial": rng.random(60) < 1 / (1 + np.exp(-e))}[family].astype(float)
    design = np.c_[np.ones(60), t]
    fit = trend.fit_weighted(design, y, family)
    at = lambda b: trend._likelihood(family, y, trend.FAMILIES[family][0](design @ b), 0.2)
    best = at(fit["b"])
    for step in (np.array([1e-3, 0]), np.array([0, 1e-3])):
        assert at(fit["b"] + step) < best and at(fit["b"] - step) < best
    if family in ("poisson", "binomial"):
        h = 1e-3
        curve = np.array([[(at(fit["b"] + h * (u + v)) - at(fit["b"] + h * (u - v)) - at(fit["b"] - h * (u - v)) + at(fit["b"] - h * (u + v))) / (4 * h * h) for v in np.eye(2)] for u in np.eye(2)])
        assert np.linalg.inv(-curve) == pytest.approx(fit["cov"], rel=1e-2)
        assert fit["aic"] == pytest.approx(-2 * best + 4) and fit["bic"] == pytest.approx(-2 * best + 2 * math.log(60))


@pytest.mark.parametrize("criterion", ["aic", "mse", "r_squared", "euclidean"])
def test_penalties_are_searched_over_folds(spark, criterion):
    """The search over tasks equals plain loops; short series leave one out, longer ones have five splits; bounds hold the mean."""
    from faunaflow.operators import trend

    assert [list(trend.fold(13, k)[1]) for k in range(5)] == [[3, 4], [5, 6], [7, 8], [9, 10], [11, 12]] and [len(trend.fold(13, k)[0]) for k in range(5)] == [3, 5, 7, 9, 11]
    rng = np.random.default_rng(1)
    series = {"short": 8, "long": 40, "two": 2}
    rows = [(k, float(t), float(np.sin(t / 4) + rng.normal(0, 0.2))) for k, n in series.items() for t in range(n)]
    alphas = (1e-4, 1e-2, 1.0, 100.0)
    got = trend.spline_trend(spark.createDataFrame(rows, "k string, x double, y double"), "k", "x", "y", criterion, alphas=alphas, dof=8).collect()
    for k in ("short", "long"):
        t, y = (np.array([r[i] for r in rows if r[0] == k]) for i in (1, 2))
        ends = t[0] - 0.1 * (t[-1] - t[0]), t[-1] + 0.1 * (t[-1] - t[0])
        scores = [np.mean([trend.spline_score(t, y, a, f, criterion, "gaussian", *ends, 8, 3) for f in range(1 if criterion == "aic" else len(t) if len(t) <= 10 else 5)]) for a in alphas]
        mine = sorted((r for r in got if r.k == k), key=lambda r: r.x)
        assert {r.alpha for r in mine} == {alphas[int(np.argmin(scores))]} and len(mine) == len(t)
        assert all(r.lower <= r.mean <= r.upper for r in mine)
        assert [r.mean for r in mine] == pytest.approx(trend.spline_fit(t, y, t, mine[0].alpha, "gaussian", *ends, dof=8)["mean"].tolist())
    assert not [r for r in got if r.k == "two"]
    with pytest.raises(ValueError):
        trend.spline_trend(spark.createDataFrame(rows, "k string, x double, y double"), "k", "x", "y", "none")


def test_features_of_three_steps(spark):
    """A joint within a square metre counts, one beyond it does not; a way back to the start has no beeline."""
    from faunaflow.operators.network import step_features

    at = lambda h: dt.datetime(2024, 1, 1, h)
    ways = {"l": [(0, 0, 30, 0), (30.4, 0.2, 30, 40), (30, 40, 0, 40)], "gap": [(0, 0, 3, 0), (5, 0, 5, 4), (5, 4, 0, 4)], "late": [(0, 0, 3, 0), (3, 0, 3, 4), (9, 4, 9, 9)], "back": [(0, 0, 3, 0), (3, 0, 3, 4), (3, 4, 0, 0)], "few": [(0, 0, 3, 0), (3, 0, 3, 4)]}
    rows = [(g, at(6 + k), at(7 + k), *map(float, w), 2.0, 5.0, k) for g, way in ways.items() for k, w in enumerate(way)]
    df = spark.createDataFrame(rows, "groupby_col string, segment_start timestamp_ntz, segment_end timestamp_ntz, x1 double, y1 double, x2 double, y2 double, speed_kmhr double, dist_meters double, extra__k int")
    got = {r.groupby_col: r for r in step_features(df).collect()}
    assert set(got) == {"l", "gap", "late", "back"} and got["l"].extra__k == 0 and got["l"].speed == 2 and got["l"].step_length == 5
    assert got["l"].dot_product == pytest.approx(0, abs=1e-9) and got["l"].tortuosity_1 == pytest.approx(40 / (30 + math.hypot(0.4, 39.8) + 30)) and got["l"].tortuosity_2 == pytest.approx(math.log(3 / 1600))
    assert (got["l"].sin_time, got["l"].cos_time) == pytest.approx((1, 0), abs=1e-9)
    assert got["gap"].dot_product is None and got["gap"].tortuosity_1 is None and got["gap"].tortuosity_2 == pytest.approx(math.log(3 / 16))
    assert got["late"].dot_product == pytest.approx(0, abs=1e-9) and got["late"].tortuosity_1 is None
    assert got["back"].tortuosity_1 == 0 and got["back"].tortuosity_2 is None


def test_lines_of_crowded_buckets_are_short(spark):
    """Thousands of images in one bucket, hundreds at one time: rows carry the images near them alone, the same as from lists."""
    import random

    from faunaflow.operators import asof, seasons

    rng, zero = random.Random(3), dt.datetime(2024, 1, 1)
    shots = sorted((zero + dt.timedelta(seconds=rng.randint(0, 3000)), k) for k in range(3000)) + [(zero + dt.timedelta(seconds=3600), 5000 + k) for k in range(300)]
    rows = [(k, zero + dt.timedelta(seconds=rng.choice([3600, rng.randint(-5, 4000)]))) for k in range(200)]
    images, df = spark.createDataFrame(shots, "img_time timestamp_ntz, img_id long"), spark.createDataFrame(rows, "id long, t timestamp_ntz")
    for strict in (False, True):
        for r in asof.lines(df, "t", images, 2, 3, strict=strict).collect():
            earlier = [s for s in shots if s[0] < r.t or s[0] == r.t and not strict]
            assert [(i.img_time, i.img_id) for i in r.line] == earlier[-2:] + shots[len(earlier) : len(earlier) + 3]
    got = {r.id: r.images for r in seasons.nearest_images(df, "id", "t", images, 1, 1, exact=True).collect()}
    for k, t in rows:
        at, same = sum(s[0] <= t for s in shots), any(s[0] == t for s in shots)
        assert got[k] == [i for _, i in shots[max(at - 1 - same, 0) : at + 1]]


def test_area_lays_intervals_out_in_parts(spark, monkeypatch):
    """Islands alone leave the tasks that lay intervals out, and parts, flushes and crowds do not change the area; null groups count."""
    from faunaflow.operators import summary

    rng = np.random.default_rng(5)
    starts = rng.uniform(0, 4000, (400, 2))
    rows = [(None if k % 3 == 0 else "ab"[k % 2], *map(float, s), *map(float, s + rng.normal(0, 600, 2))) for k, s in enumerate(starts)]
    df = spark.createDataFrame(rows, "g string, x1 double, y1 double, x2 double, y2 double")
    area = lambda **k: {r.g: r.area_km2 for r in summary.coverage_area(df, 500.0, ["g"], **k).collect()}
    want = area()
    assert set(want) == {None, "a", "b"}
    for name, n in (("LAID_OUT", 100), ("HELD", 300), ("CROWD", 7)):
        monkeypatch.setattr(summary, name, n)
    assert area(tasks=3) == pytest.approx(want, rel=1e-12)
    x = np.array([r[1:] for r in rows if r[0] == "a"]).T
    got = list(summary._intervals(*x, 250.0, 500 / 32))
    assert max(len(line) for line, _, _ in got) <= 100
    line, left, right = map(np.concatenate, zip(*got))
    islands, total = summary._united(line, left, right), 0.0
    for k in np.unique(line):
        end = -np.inf
        for lo, hi in sorted(zip(left[line == k], right[line == k])):
            total, end = total + max(0.0, hi - max(lo, end)), max(end, hi)
    assert len(islands[0]) < len(line) / 4 and (islands[2] - islands[1]).sum() == pytest.approx(total, rel=1e-12)
    assert total * 500 / 32 / 1e6 == pytest.approx(want["a"], rel=1e-12)
