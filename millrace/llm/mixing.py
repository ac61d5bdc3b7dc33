"""Mixing sources to target weights by entropy balancing.

Each source gets a target of words.  Of all document rates that meet it, the
balanced ones stay closest to one copy each: the dual has one multiplier per
source, and a document of `size` words gets the tilted rate
`2 / (1 + exp(-multiplier * size / mean size))`, never more than two copies.
Newton steps on the multipliers run over counts per (source, size), which hold
all that the constraints see.  From zero the steps approach the root from one
side, since the sum of tilted sizes is concave above zero and convex below.

Rates become copies by systematic rounding along size: rounded running sums lie
within one copy of the exact ones, and the best of `OFFSETS` starting points is
taken per source.  Within a (source, size) group copies are dealt by id hash.

All sums that decide anything are over integers, so reruns agree.

Defined results: a null text has size 0; sizes of 0 take nothing; a null source
is a source of its own, last in order; rows repeated under one id, or
without one, are separate documents of the mix, and `mixed` gives each its own copies;
an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import WORD, fresh, with_row
from millrace.operators.ordered import before, chunk_of
from millrace.session import written

WEIGHTS = (5, 2, 1)
PERCENT = 150
CAP = 2
OFFSETS = 32
BUCKETS = 64
UNIT = 1_000_000
TOLERANCE = 1e-7
MAX_STEPS = 60
SIZE_CHUNK = 256


def sizes(docs: DataFrame, row: str | None = None) -> DataFrame:
    """`(doc_id, key, size, bucket)`; `key` is the source, made free of nulls.  With a
    column that numbers the rows also `row`, which deals rows without an id."""
    doc_id = F.xxhash64("doc_id")
    if row:
        doc_id = F.when(F.col("doc_id").isNull(), F.xxhash64(row)).otherwise(doc_id)
    return docs.select(
        "doc_id", *([F.col(row).alias("row")] if row else []), F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("key"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"),
        F.pmod(doc_id, F.lit(BUCKETS)).alias("bucket"))


def targets(counts: DataFrame, weights: tuple[int, ...] = WEIGHTS,
            percent: int = PERCENT) -> DataFrame:
    """`(key, source_size, docs, target)` from `counts(key, size, n)`.

    Targets share `percent` of all words by weight; none is above `CAP` times its
    source, and what is cut is shared anew.  Water filling over one row per
    source, in the order in which sources reach their caps.
    """
    by_key = Window.orderBy((F.col("key") == "").cast("int"), "key")
    cycle = F.array(*map(F.lit, weights))
    sources = (counts.groupBy("key").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"),
                                         F.sum("n").alias("docs"))
               .withColumn("weight", F.get(cycle, (F.row_number().over(by_key) - 1) % len(weights)))
               .withColumn("full_at", CAP * F.col("source_size") / F.col("weight")))
    filling = Window.orderBy("full_at", "key")
    earlier = filling.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding,
                                                      Window.unboundedFollowing)
    total = F.sum("source_size").over(everything) * percent / 100
    taken = CAP * F.coalesce(F.sum("source_size").over(earlier), F.lit(0))
    left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(earlier), F.lit(0))
    levels = sources.withColumn("level", (total - taken) / left) \
                    .withColumn("at", F.row_number().over(filling))
    reached = F.min(F.when(F.col("level") <= F.col("full_at"), F.struct("at", "level"))) \
               .over(everything)["level"]
    return levels.withColumn("reached", reached).select(
        "key", "source_size", "docs",
        F.coalesce(F.least(CAP * F.col("source_size"), F.col("reached") * F.col("weight")),
                   CAP * F.col("source_size")).cast("double").alias("target"))


def _rate(multiplier: Column, ratio: Column) -> Column:
    return CAP / (1 + (CAP - 1) * F.exp(-multiplier * ratio))


def _exact_sum(amount: Column, factor: Column) -> Column:
    """Sum of amount * factor in billionths: the same in any order of rows."""
    return F.sum(amount.cast("decimal(19,0)") * F.round(factor * 1e9).cast("decimal(18,0)")) \
            .cast("double") / 1e9


def multipliers(counts: DataFrame, goals: DataFrame) -> DataFrame:
    """`goals` with the `multiplier` whose rates meet each target.

    A source without words keeps zero, a source at its cap has no finite root and
    is marked by null.  Each step is one aggregate over the counts and is written.
    """
    full = F.col("target") >= CAP * F.col("source_size") * (1 - TOLERANCE)
    state = written(goals.select(
        "*", F.when(F.col("source_size") == 0, 0.0).when(full, F.lit(None)).otherwise(0.0)
        .alias("multiplier"), F.lit(False).alias("_met")), "multipliers")
    words = F.col("n") * F.col("size")
    ratio = F.col("size") * F.col("docs") / F.col("source_size")
    for _ in range(MAX_STEPS):
        open_ = state.where("source_size > 0 and multiplier is not null and not _met")
        if open_.isEmpty():
            break
        rate = _rate(F.col("multiplier"), ratio)
        sums = counts.join(open_.select("key", "docs", "source_size", "multiplier"), "key") \
            .groupBy("key").agg(_exact_sum(words, rate).alias("_sum"),
                                _exact_sum(words, ratio * rate * (1 - rate / CAP)).alias("_slope"))
        gap = F.col("target") - F.col("_sum")
        met = (F.abs(gap) <= TOLERANCE * F.col("target")) | (F.col("_slope") <= 0)
        state = written(state.join(sums, "key", "left").select(
            *goals.columns,
            F.when(F.col("_sum").isNull() | met, F.col("multiplier"))
            .otherwise(F.col("multiplier") + gap / F.col("_slope")).alias("multiplier"),
            F.coalesce(met, F.lit(True)).alias("_met")), "multipliers")
    return state.drop("_met")


def _rounded(start: Column, length: Column, offset: int) -> Column:
    """Copies of a group whose exact copies (in units) run from `start` over `length`."""
    shift = offset * UNIT // OFFSETS
    return F.floor((start + length + shift) / UNIT) - F.floor((start + shift) / UNIT)


def group_copies(counts: DataFrame, solved: DataFrame) -> DataFrame:
    """`(key, size, n, copies)`: whole copies of each (source, size) group."""
    ratio = F.col("size") * F.col("docs") / F.col("source_size")
    rate = (F.when(F.col("size") == 0, 1.0).when(F.col("multiplier").isNull(), float(CAP))
            .otherwise(_rate(F.col("multiplier"), ratio)))
    exact = counts.join(solved, "key").select(
        "key", "size", "n", "target",
        (F.col("n") * F.round(rate * UNIT).cast("bigint")).alias("units"))
    runs = written(before(exact, ["key"], chunk_of("size", SIZE_CHUNK), ["size"],
                          {"start": F.col("units")}), "runs")
    start, units = F.col("start"), F.col("units")
    tried = runs.groupBy("key").agg(F.first("target").alias("target"), *[
        F.sum(F.col("size") * _rounded(start, units, k)).alias(f"t{k}") for k in range(OFFSETS)])
    miss = [F.struct(F.abs(F.col(f"t{k}") - F.col("target")), F.lit(k).alias("k"))
            for k in range(OFFSETS)]
    best = tried.select("key", F.array_min(F.array(*miss))["k"].alias("offset"))
    choice = F.array(*[_rounded(start, units, k) for k in range(OFFSETS)])
    return runs.join(best, "key").select("key", "size", "n", F.get(choice, F.col("offset")).alias("copies"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, percent: int = PERCENT,
        row: str | None = None) -> DataFrame:
    """`(doc_id, size, source_size, target, taken, copies)` of every row, and its `row`
    when a column with one is named."""
    rows = written(sizes(docs, row), "sizes")
    place = ["row"] if row else []
    counts = written(rows.groupBy("key", "size").agg(F.count("*").alias("n")), "counts")
    goals = written(targets(counts, weights, percent), "targets")
    groups = group_copies(counts, multipliers(counts, goals))
    buckets = rows.groupBy("key", "size", "bucket").agg(F.count("*").alias("here"))
    along = Window.partitionBy("key", "size").orderBy("bucket")
    ahead = F.coalesce(F.sum("here").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    each = F.floor(F.col("copies") / F.col("n"))
    extra = F.col("copies") - each * F.col("n")
    share = lambda upto: F.floor(upto * extra / F.col("n"))
    dealt = (buckets.withColumn("ahead", ahead).join(groups, ["key", "size"])
             .select("key", "size", "bucket", each.alias("each"),
                     (share(F.col("ahead") + F.col("here")) - share(F.col("ahead"))).alias("more"))
             .join(goals.select("key", "source_size", "target"), "key"))
    rank = F.row_number().over(Window.partitionBy("key", "size", "bucket").orderBy("doc_id", *place))
    copies = F.col("each") + F.when(F.col("rank") <= F.col("more"), 1).otherwise(0)
    return (rows.withColumn("rank", rank).join(dealt, ["key", "size", "bucket"])
            .select("doc_id", *place, "size", "source_size", "target",
                    (copies * F.col("size")).alias("taken"), copies.alias("copies")))


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, percent: int = PERCENT) -> DataFrame:
    """The mix itself: the rows of `docs`, none, once or twice each."""
    copies, again = (fresh(docs, n) for n in ("_copies", "_again"))
    rows, row = with_row(docs)
    plan = mix(rows, weights, percent, row).where("copies > 0").select(
        F.col("row").alias(row), F.col("copies").cast("int").alias(copies))
    return (rows.join(plan, row)
            .withColumn(again, F.explode(F.array_repeat(F.lit(0), F.col(copies))))
            .drop(row, copies, again))
