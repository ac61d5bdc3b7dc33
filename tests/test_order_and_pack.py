import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.operators import pack
from millrace.operators.ordered import _sorted_files, before, chunk_of, first_rows, ranked


def hot_rows(spark, parts):
    """One key holds most rows."""
    rng = random.Random(5)
    rows = [("hot" if i % 5 else f"k{i % 7}", i, rng.choice([None, 1, 2, 7]), rng.random())
            for i in range(3000)]
    return spark.createDataFrame(rows, "k string, n long, w long, x double").repartition(parts)


@pytest.mark.parametrize("parts", [1, 7, 64])
def test_before_equals_plain_window(spark, parts):
    df = hot_rows(spark, parts)
    got = before(df, ["k"], chunk_of("n", 50), ["n"], {"s": F.col("w")}, {"m": F.col("x")},
                 {"p": F.struct("n", "w")})
    w = Window.partitionBy("k").orderBy("n")
    up = w.rowsBetween(Window.unboundedPreceding, -1)
    want = df.select("*", F.coalesce(F.sum("w").over(up), F.lit(0)).alias("s"),
                     F.min("x").over(up).alias("m"), F.lag(F.struct("n", "w")).over(w).alias("p"))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_before_without_keys_and_descending(spark):
    df = hot_rows(spark, 5)
    up = Window.orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    want = df.select("n", F.coalesce(F.sum("w").over(up), F.lit(0)).alias("s"))
    for size in (1, 3, 4096):
        got = before(df, [], chunk_of("n", size), ["n"], {"s": F.col("w")}).select("n", "s")
        assert sorted(got.collect()) == sorted(want.collect())
    down = before(df, ["k"], -chunk_of("n", 40), [F.col("n").desc()], {"r": F.lit(1)})
    order = Window.partitionBy("k").orderBy(F.col("n").desc())
    want = df.withColumn("r", F.row_number().over(order) - 1)
    assert sorted(down.select("n", "r").collect()) == sorted(want.select("n", "r").collect())


def test_first_rows(spark):
    df = spark.range(0, 9000, 3).withColumnRenamed("id", "n")
    for n in (0, 1, 17, 2999, 3000, 3001):
        kept = [r.n for r in first_rows(df, chunk_of("n", 64), ["n"], n).collect()]
        assert sorted(kept) == [3 * i for i in range(min(n, 3000))]


def odd_ids():
    """Half of the ids in one cluster, a third the same, some far away, some missing."""
    rng = random.Random(8)
    ids = [5_000_000 + i % 700 for i in range(6000)] + [-3] * 4000 + [2 ** 61, -2 ** 62, None, None]
    ids += [rng.randrange(-2 ** 62, 2 ** 62) for _ in range(2000)]
    rng.shuffle(ids)
    return ids


@pytest.mark.parametrize("parts", [1, 9])
def test_ranks_of_any_ids(spark, parts):
    ids = odd_ids()
    df = spark.createDataFrame([(i, k % 5) for k, i in enumerate(ids)], "doc_seq long, n_tokens int").repartition(parts)
    got = ranked(df, ["doc_seq"]).orderBy("_rank").collect()
    assert [r._rank for r in got] == list(range(len(ids)))
    assert [r.doc_seq for r in got] == sorted(ids, key=lambda i: (i is not None, i or 0))
    sizes = ranked(df, ["doc_seq"]).groupBy(chunk_of("_rank", 500)).count().toPandas()["count"]
    assert sizes.max() <= 500 and len(sizes) == -(-len(ids) // 500)
    placed = pack.pack(df).orderBy("start_pos", "n_tokens").collect()
    ends = [r.start_pos + r.n_tokens for r in placed]
    assert [r.start_pos for r in placed] == [0, *ends[:-1]] and ends[-1] == sum(r.n_tokens for r in placed)
    assert ranked(df.limit(0), ["doc_seq"]).count() == pack.pack(df.limit(0)).count() == 0


def test_no_range_holds_a_heavy_id(spark):
    df = spark.createDataFrame([(-3 if i % 4 else i, 1) for i in range(40_000)], "doc_seq long, n_tokens int")
    files = _sorted_files(df.repartition(6), ["doc_seq", "_tie"]).groupBy("_file").count()
    # Ranges come from a sample of the order; three quarters of the rows share one id.
    assert files.toPandas()["count"].max() < 20_000


@pytest.mark.parametrize("n", [0, 1, 2, 3, 2500, 5900, 9000, 12_003, 12_004, 20_000])
def test_first_rows_of_any_ids(spark, n):
    ids = sorted(odd_ids(), key=lambda i: (i is not None, i or 0))
    df = spark.createDataFrame([(i, "x") for i in odd_ids()], "doc_seq long, text string").repartition(4)
    kept = [r.doc_seq for r in first_rows(df, None, ["doc_seq"], n).collect()]
    assert sorted(kept, key=lambda i: (i is not None, i or 0)) == ids[:n]


def documents(spark, sizes, parts=3):
    rng, rows, stream = random.Random(3), [], []
    for i, size in enumerate(sizes):
        ids = [rng.randrange(1000) for _ in range(size)]
        rows.append((i * 11, ids))
        stream += ids
    return spark.createDataFrame(rows, "doc_seq long, token_ids array<int>").repartition(parts), stream


SIZES = [3, 0, 40, 1, 1, 7, 0, 25, 2, 13, 60, 5]


@pytest.mark.parametrize("parts", [1, 7, 64])
def test_positions_are_dense(spark, parts):
    docs, stream = documents(spark, SIZES, parts)
    rows = pack.pack(docs).orderBy("doc_seq").collect()
    assert [r.start_pos for r in rows] == [sum(SIZES[:i]) for i in range(len(SIZES))]


@pytest.mark.parametrize("fraction, length, head", [
    (0.05, 3, 7), (0.5, 3, 15), (0.05, 7, None), (0.0, 3, None)])
def test_split(spark, fraction, length, head):
    docs, stream = documents(spark, SIZES)
    lengths = docs.select(F.size("token_ids").alias("n_tokens"))
    pieces = pack.split_stream(pack.pack(docs), lengths, fraction, length).collect()
    parts = {}
    for name in ("val", "train"):
        rows = sorted((r.start_pos, r.token_ids) for r in pieces if r.split == name)
        assert [s for s, _ in rows] == [sum(len(t) for _, t in rows[:i]) for i in range(len(rows))]
        parts[name] = [t for _, ids in rows for t in ids]
    if head is None:
        assert parts == {"val": stream, "train": stream}
    else:
        assert parts == {"val": stream[:head], "train": stream[head:]}


@pytest.mark.parametrize("length, stride", [(1, 1), (4, 1), (4, 3), (6, 7), (4, 20), (157, 1), (158, 1)])
def test_windows(spark, length, stride):
    docs, stream = documents(spark, SIZES)
    got = {r.start: r.w for r in pack.windows(pack.pack(docs), length, stride).collect()}
    want = {s: stream[s:s + length + 1] for s in range(0, len(stream) - length, stride)}
    assert got == want


def test_sampled_windows_and_pairs(spark):
    docs, stream = documents(spark, SIZES)
    starts = pack.draw_starts(spark.range(30), F.lit(len(stream) - 5), 8, 1337)
    rows = pack.shifted(pack.sampled_windows(pack.pack(docs), starts, 5), 5).collect()
    assert len(rows) == 240 and {(r.step, r.row) for r in rows} == {
        (s, b) for s in range(30) for b in range(8)}
    for r in rows:
        assert r.x == stream[r.start:r.start + 5] and r.y == stream[r.start + 1:r.start + 6]


def test_seeded_start_value(spark):
    starts = pack.draw_starts(spark.range(1, 2), F.lit(1000), 1, 1337).first()
    assert starts.start == 267


def test_skipped_steps_add_no_tokens(spark):
    log = spark.createDataFrame([("a", 1, 1.0), ("a", 2, None), ("a", 3, 2.0), ("b", 1, None)],
                                "run_id string, line_no long, train_loss double")
    got = [r.ledger for r in pack.tokens_seen(log, 2, 5).orderBy("run_id", "line_no").collect()]
    assert got == [10, 10, 20, 0]


def test_packing_moves_tokens_once(spark):
    """Positions come with the sorted files: nothing but file totals is exchanged after them."""
    rows = [(i * 7919 % 501 - 250, [i] * (i % 5), None if i % 50 == 3 else i % 5) for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_seq long, token_ids array<int>, n_tokens int").repartition(5)
    packed = pack.pack(docs)
    plan = packed._jdf.queryExecution().executedPlan().toString()
    assert "_chunk" not in plan and "SortMergeJoin" not in plan
    want, at = {}, 0
    for seq, ids, n in sorted(rows, key=lambda r: r[0]):
        want[seq], at = (at, ids), at + (n or 0)
    assert {r.doc_seq: (r.start_pos, r.token_ids) for r in packed.collect()} == want
