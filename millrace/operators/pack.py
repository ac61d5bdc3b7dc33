"""One token stream out of many documents, and windows over it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.hashing import seeded_hash
from millrace.operators.ordered import before, chunk_of, ranked


def append_eot(docs: DataFrame, eot: int) -> DataFrame:
    """One end marker after every document."""
    return docs.withColumn("token_ids", F.array_append("token_ids", F.lit(eot).cast("int")))


def pack(docs: DataFrame, chunk: Column | None = None) -> DataFrame:
    """Place documents one after the other: adds `n_tokens` and `start_pos`.

    Pass `chunk_of("doc_seq")` when ids are dense and unique: it saves a sort of all rows.

    `docs` is read twice, once only for lengths: give it a written table when
    making `token_ids` is dear, or an `n_tokens` column that is cheaper to make.
    """
    sized = docs if "n_tokens" in docs.columns else docs.withColumn("n_tokens",
                                                                    F.size("token_ids"))
    if chunk is not None:
        return before(sized, [], chunk, ["doc_seq"], {"start_pos": F.col("n_tokens").cast("bigint")})
    return ranked(sized, ["doc_seq"], "_rank", {"start_pos": "n_tokens"}).drop("_rank")


def stream_length(docs: DataFrame) -> Column:
    """Scalar: tokens in the whole stream of `docs(n_tokens)`."""
    return docs.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).cast("bigint")).scalar()


def split_stream(packed: DataFrame, docs: DataFrame, fraction: float, length: int) -> DataFrame:
    """Cut the head of the stream off for validation.

    The head has `min(floor(n * fraction), n div 10)` tokens; when that is less
    than `length + 1`, both splits are the whole stream.  A document on the cut
    is divided.  `docs(n_tokens)` gives the stream length without positions.
    Rows come back as `(split, doc_seq, start_pos, n_tokens, token_ids)`, with
    positions counted inside the split.
    """
    n = stream_length(docs)
    sized = packed.withColumn("_n", n)
    head = F.least(F.floor(F.col("_n").cast("double") * F.lit(float(fraction))),
                   F.expr("_n div 10"))
    start, size = F.col("start_pos"), F.col("n_tokens").cast("bigint")
    cut = F.when(head >= length + 1, head)

    def part(split: str, first: Column, last: Column, origin: Column) -> Column:
        return F.struct(F.lit(split).alias("split"), first.alias("first"),
                        last.alias("last"), origin.alias("origin"))

    whole = F.lit(0).cast("bigint")
    pieces = F.array(
        part("val", whole, F.coalesce(F.least(size, cut - start), size), whole),
        part("train", F.coalesce(F.greatest(cut - start, whole), whole), size,
             F.coalesce(cut, whole)))
    rows = sized.withColumn("piece", F.explode(F.filter(pieces, lambda p: p.last > p.first)))
    first, last = F.col("piece.first"), F.col("piece.last")
    return rows.select(
        "piece.split", "doc_seq",
        (start + first - F.col("piece.origin")).alias("start_pos"),
        (last - first).cast("int").alias("n_tokens"),
        F.slice("token_ids", (first + 1).cast("int"), (last - first).cast("int"))
        .alias("token_ids"))


def split_sizes(pieces: DataFrame) -> DataFrame:
    return pieces.groupBy("split").agg(F.count("*").alias("docs"),
                                       F.sum("n_tokens").alias("n_tokens"))


def _spans(packed: DataFrame, width: int, wanted: DataFrame | None = None) -> DataFrame:
    """`(block, tokens)`: the 2 * width tokens from position `block * width` on.

    Every token is shuffled twice, whatever the number of windows.  With
    `wanted(block)` only those blocks are built.
    """
    first = F.expr(f"start_pos div {width}")
    last = F.expr(f"(start_pos + n_tokens - 1) div {width}")
    pieces = (packed.where(F.col("n_tokens") > 0)
              .select("start_pos", "token_ids", F.explode(F.sequence(first, last)).alias("at")))
    lead = F.col("at") * width - F.col("start_pos")
    begin = F.greatest(lead, F.lit(0))
    cut = pieces.select(
        "at", (F.col("start_pos") + begin).alias("pos"),
        F.slice("token_ids", (begin + 1).cast("int"), (lead + width - begin).cast("int"))
        .alias("part"))
    twice = (cut.withColumn("block", F.explode(F.array(F.col("at"), F.col("at") - 1)))
             .where(F.col("block") >= 0))
    if wanted is not None:
        twice = twice.join(wanted.select("block").distinct(), "block", "left_semi")
    gathered = twice.groupBy("block").agg(F.collect_list(F.struct("pos", "part")).alias("parts"))
    return gathered.select("block", F.flatten(
        F.transform(F.array_sort("parts"), lambda p: p.part)).alias("tokens"))


def windows(packed: DataFrame, length: int, stride: int = 1) -> DataFrame:
    """All windows of `length + 1` tokens whose start is a multiple of `stride`:
    `(start, w)`.  Stride 1 multiplies the data by `length + 1`."""
    width = length + 1
    spans = _spans(packed, width)
    begin = F.col("block") * width
    starts = F.sequence(F.ceil(begin / stride) * stride, begin + width - 1,
                        F.lit(stride).cast("bigint"))
    some = F.ceil(begin / stride) * stride <= begin + width - 1
    cut = spans.where(some).select("block", "tokens", F.explode(starts).alias("start"))
    return (cut.select("start", F.slice("tokens", (F.col("start") - begin + 1).cast("int"), width)
                       .alias("w"))
            .where(F.size("w") == width))


def draw_starts(spark_range: DataFrame, n_windows: Column, batch: int, seed: int) -> DataFrame:
    """Seeded uniform starts with replacement: `(step, row, start)` for every
    `id` (the step) of `spark_range`."""
    rows = spark_range.select(F.col("id").alias("step"),
                              F.explode(F.sequence(F.lit(0), F.lit(batch - 1))).alias("row"))
    return rows.withColumn("start", seeded_hash(seed, F.col("step"), F.col("row")) % n_windows)


def sampled_windows(packed: DataFrame, starts: DataFrame, length: int) -> DataFrame:
    """The windows at the given starts: `(step, row, start, w)`."""
    width = length + 1
    placed = starts.withColumn("block", F.expr(f"start div {width}"))
    spans = _spans(packed, width, placed)
    joined = placed.join(spans, "block")
    offset = (F.col("start") - F.col("block") * width + 1).cast("int")
    return joined.select("step", "row", "start", F.slice("tokens", offset, width).alias("w"))


def shifted(table: DataFrame, length: int) -> DataFrame:
    """Input and target of each window: all but the last, all but the first token."""
    return (table.withColumn("x", F.slice("w", 1, length))
            .withColumn("y", F.slice("w", 2, length)).drop("w"))


def tokens_seen(run_log: DataFrame, batch: int, length: int) -> DataFrame:
    """Ledger of trained tokens: every completed step adds `batch * length`,
    a skipped one (null loss) nothing."""
    gain = F.when(F.col("train_loss").isNotNull(), F.lit(batch * length)).otherwise(0)
    gained = gain.cast("bigint")
    done = before(run_log, ["run_id"], chunk_of("line_no"), ["line_no"], {"_earlier": gained})
    return done.withColumn("ledger", F.col("_earlier") + gained).drop("_earlier")
