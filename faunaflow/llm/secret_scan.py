"""Secret scans: fixed patterns, and sliding-window Shannon entropy, in DataFrame functions alone.

Positions come from splitting a text at the matches of a pattern: the lengths of what lies between and
of the matches add up to the offsets, in code points. Running sums are taken in blocks, so a text with
many matches costs little more than in proportion to them. No pattern repeats a group without a bound,
so none recurses with the length of a text.

For each character class, a candidate string slides a window of fixed width; the counts of its
characters change by one that enters and one that leaves, and so does the sum of c * log2(c) from which
the window's entropy follows. A candidate whose best window reaches the class's threshold is a span,
unless the allow list suppresses it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faunaflow.llm.common import documents, sha256

#: Fixed patterns: kind, pattern, group whose length counts, least length. Runs are maximal, so the
#: least length of the last two may stand in their pattern.
BASE = [
    (
        "assign",
        r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        8,
    ),
    ("access", "AKIA[A-Z0-9]{12,}", 0, 16),
    ("hex", "[0-9a-f]{32,}", 0, 32),
]


@dataclass(frozen=True)
class CharClass:
    """Candidates are runs of ``chars`` of at least ``width``; ``least`` bits of entropy make a span."""

    name: str
    chars: str
    pattern: str
    width: int
    least: float


HEX_CHARS = "0123456789abcdef"
UPPER_CHARS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER_CHARS = "0123456789abcdefghijklmnopqrstuvwxyz_-"
MIXED_CHARS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+/_-"
#: A candidate stands alone between other characters and has a digit. A lower-case one has letters
#: between two digits and a letter beyond f, a mixed one letters of either case.
BEFORE, AFTER = r"(?<![A-Za-z0-9+/_-])", r"(?![A-Za-z0-9+/_-])"
CLASSES = [
    CharClass("entropy_hex", HEX_CHARS, rf"{BEFORE}(?=[a-f]*[0-9])[0-9a-f]{{24,}}{AFTER}", 24, 3.0),
    CharClass("entropy_upper", UPPER_CHARS, rf"{BEFORE}(?=[A-Z]*[0-9])(?=[0-9]*[A-Z])[A-Z0-9]{{16,}}{AFTER}", 16, 3.0),
    CharClass("entropy_lower", LOWER_CHARS, rf"{BEFORE}(?=[0-9a-f_-]*[g-z])(?=[0-9a-z_-]*[0-9][a-z]+[0-9])[0-9a-z_-]{{24,}}{AFTER}", 24, 3.8),
    CharClass("entropy_mixed", MIXED_CHARS, rf"{BEFORE}(?=[A-Za-z+/_-]*[0-9])(?=[A-Z0-9+/_-]*[a-z])(?=[a-z0-9+/_-]*[A-Z])[A-Za-z0-9+/_-]{{20,}}{AFTER}", 20, 3.8),
]
#: Every match of a pattern but ``assign`` holds such a run; one pass finds the texts without any.
LONG_RUN = "[A-Za-z0-9+/_-]{16}"
MASK = "[SECRET]"
#: Numbers in a block of :func:`running`.
BLOCK = 256


def allowed(hit: Column) -> Column:
    """Whether a string is no secret however random it looks.

    Such are digits alone, counting runs, UUIDs, dates with or without a time, and paths of plain words
    with up to four digits at their end.
    """
    digits = hit.rlike("^[0-9]+$")
    counting = F.replace(hit, F.lit(HEX_CHARS), F.lit("")) == ""
    uuid = hit.rlike("^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$")
    date = hit.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}([Tt_-][0-9]{2}-?[0-9]{2}(-?[0-9]{2})?[Zz]?)?$")
    path = hit.rlike("^[A-Za-z/_-]+[0-9]{0,4}$") & hit.rlike("[/_-]") & ~hit.rlike("[/_-][/_-]|^[/_-]|[/_-][0-9]*$")
    return digits | counting | uuid | date | path


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once however often the body names it."""
    return F.transform(F.array(value), body)[0]


def running(values: Column, op: Callable[[Column, Column], Column]) -> Column:
    """The running sums, or maxima, from 0 on, of an array of integers; ``op`` joins two of them."""

    def along(xs: Column) -> Column:
        grown = F.aggregate(xs, F.array(F.lit(0)), lambda a, x: F.array_append(a, op(F.element_at(a, -1), x)))
        return F.slice(grown, F.lit(2), F.size(xs))

    def blocks(xs: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(xs), F.lit(BLOCK)), lambda b: b < F.size(xs))
        return F.transform(starts, lambda b: along(F.slice(xs, b + 1, F.lit(BLOCK))))

    def joined(parts: Column) -> Column:
        before = F.concat(F.array(F.lit(0)), along(F.transform(parts, lambda p: F.element_at(p, -1))))
        return F.flatten(F.zip_with(parts, F.slice(before, F.lit(1), F.size(parts)), lambda p, o: F.transform(p, lambda x: op(o, x))))

    return let(values, lambda xs: let(blocks(xs), joined))


def _spans(text: str, guard: Column, pattern: str, kind: str, order: int, long_enough) -> Column:
    """Array of (start, ord, end, kind, hit) for the matches of pattern that are long enough; so they sort by start, then kind."""
    gaps = F.transform(F.split(F.col(text), pattern, -1), F.length)

    def placed(hits: Column) -> Column:
        steps = F.zip_with(F.slice(gaps, F.lit(1), F.size(hits)), hits, lambda g, h: g + F.length(h))
        span = lambda end, hit: F.struct(
            (end - F.length(hit)).alias("start"), F.lit(order).alias("ord"), end.alias("end"), F.lit(kind).alias("kind"), hit.alias("hit")
        )
        return F.filter(F.zip_with(running(steps, lambda a, b: a + b), hits, span), lambda s: long_enough(s["hit"]))

    none = F.array().cast("array<struct<start:int,ord:int,end:int,kind:string,hit:string>>")
    found = let(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0)), placed)
    return F.when(guard & F.col(text).rlike(pattern), found).otherwise(none)


def window_entropy(text: Column, chars: str, width: int) -> Column:
    """The largest Shannon entropy, in bits, of any window of that width; null where the text is shorter.

    The counts of the window's characters change by the one that enters and the one that leaves, and so
    does their sum of c * log2(c), from which the entropy follows. Counts share longs, some to each.
    """
    bits = width.bit_length()
    each = 62 // bits
    weight = lambda c: F.when(c > 0, c * F.log2(F.greatest(c, F.lit(1)).cast("double"))).otherwise(F.lit(0.0))
    lane, shift = (lambda k: F.call_function("div", k, F.lit(each)).cast("int")), (lambda k: k % each * bits)
    count = lambda n, k: F.call_function("shiftright", F.element_at(n, lane(k) + 1), shift(k)).bitwiseAND((1 << bits) - 1)
    one = lambda j, k: F.when(j == lane(k), F.call_function("shiftleft", F.lit(1).cast("long"), shift(k))).otherwise(F.lit(0).cast("long"))
    # the places of the characters, from 0 on; before the window is full, -1 leaves it
    codes = F.transform(F.split(text, ""), lambda c: F.instr(F.lit(chars), c) - 1)
    pairs = lambda codes: F.filter(
        F.zip_with(codes, F.concat(F.array_repeat(F.lit(-1), width), codes), lambda a, b: F.struct(a.alias("new"), b.alias("old"))),
        lambda p: p["new"].isNotNull(),
    )
    zero = F.array_repeat(F.lit(0).cast("long"), -(-len(chars) // each))
    start = F.struct(zero.alias("n"), F.lit(0.0).alias("s"), F.lit(0).alias("i"), F.lit(None).cast("double").alias("best"))

    def step(a: Column, p: Column) -> Column:
        new, old, leaves = p["new"], F.greatest(p["old"], F.lit(0)), p["old"] >= 0
        came, went = count(a["n"], new), count(a["n"], old)
        change = weight(came + 1) - weight(came) + F.when(leaves, weight(went - 1) - weight(went)).otherwise(F.lit(0.0))
        same = new == p["old"]
        total = a["s"] + F.when(same, F.lit(0.0)).otherwise(change)
        counts = F.when(same, a["n"]).otherwise(
            F.transform(a["n"], lambda c, j: c + one(j, new) - F.when(leaves, one(j, old)).otherwise(F.lit(0).cast("long")))
        )
        full = a["i"] + 1 >= width
        best = F.when(full, F.greatest(a["best"], F.log2(F.lit(float(width))) - total / width)).otherwise(a["best"])
        return F.struct(counts.alias("n"), total.alias("s"), (a["i"] + 1).alias("i"), best.alias("best"))

    return F.aggregate(let(codes, pairs), start, step, lambda a: a["best"])


def secret_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and spans, an array of (start, end, kind, hit) in code points, ends exclusive: base kinds, then entropy.

    Null text is empty and has none. Rows are returned as they come, repeated and null ids included; an
    empty table gives no rows; other columns are not read. The spans of one kind do not overlap; those
    of two kinds may, and are ordered by start, then kind as listed.
    """
    return documents(df, id_col, text_col).select("doc_id", spans_of("text").alias("spans"))


def spans_of(text: str) -> Column:
    """The array of spans of a text column that has no nulls."""
    long_run = F.col(text).rlike(LONG_RUN)
    base = [
        _spans(text, F.lit(True) if group else long_run, pattern, kind, i, (lambda h, g=group, n=least, p=pattern: F.length(F.regexp_extract(h, p, g) if g else h) >= n))
        for i, (kind, pattern, group, least) in enumerate(BASE)
    ]
    more = [
        _spans(text, long_run, c.pattern, c.name, len(BASE) + i, lambda h, c=c: ~allowed(h) & (window_entropy(h, c.chars, c.width) >= c.least))
        for i, c in enumerate(CLASSES)
    ]
    return F.array_sort(F.concat(*base, *more))


def as_list(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: str, spans: str) -> Column:
    """The text with each span, overlapping ones as one, replaced by :data:`MASK`."""

    def masked(chars: Column) -> Column:
        ends = running(F.transform(F.col(spans), lambda s: s["end"]), F.greatest)
        before = lambda ends: F.concat(F.array(F.lit(0)), ends)
        cut = lambda at, to: F.array_join(F.slice(chars, at + 1, to - at), "")
        # a span that starts before the end of an earlier one adds nothing
        part = lambda s, at: F.when(s["start"] >= at, F.concat(cut(at, s["start"]), F.lit(MASK))).otherwise(F.lit(""))
        parts = lambda ends: F.concat(
            F.array_join(F.zip_with(F.col(spans), F.slice(before(ends), F.lit(1), F.size(spans)), part), ""), cut(F.element_at(ends, -1), F.size(chars))
        )
        return let(ends, parts)

    return F.when(F.size(spans) == 0, F.col(text)).otherwise(let(F.split(F.col(text), ""), masked))


def digest(spans: DataFrame) -> DataFrame:
    """The contract's columns of :func:`secret_spans`."""
    base = F.filter("spans", lambda s: s["ord"] < len(BASE))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return spans.select(
        "doc_id",
        *[count(kind).alias(f"n_{kind}") for kind, *_ in BASE],
        sha256(as_list(base)).alias("base_sha256"),
        as_list(F.col("spans")).alias("spans"),
    )
