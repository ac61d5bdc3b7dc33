import json
import os
import time

import pytest
from pyspark.sql import functions as F

from millrace.operators.pack import pack, split_stream
from millrace.plans.prepare import prepare_corpus, training_batches
from millrace.sources import blocks, cache, corpus, ledger, logs


def pad(text):
    return text + "." * 120


def test_paragraphs(spark, tmp_path):
    path = tmp_path / "corpus.txt"
    parts = [pad("a1"), pad("b"), pad("c") + "\nline", "short", pad("d"), pad("é"), pad("f")]
    gaps = ["\n\n \n", "\n \n\n", "\n\n", "\n\t\n\n\n", "\n \n", "\n\n\n"]
    text = "".join(p + g for p, g in zip(parts, gaps + [""]))
    path.write_bytes(text.encode() + b"\n\n" + b"x" * 130 + b"\xff")
    got = [r.text for r in corpus.read_paragraphs(spark, str(path)).orderBy("doc_seq").collect()]
    assert got == [p for p in parts if p != "short"] + ["x" * 130 + "�"]


def test_paragraphs_of_a_split_file_keep_their_order(spark, tmp_path):
    path = tmp_path / "big.txt"
    want = [pad(f"{i} ") for i in range(4000)]
    path.write_text("\n\n".join(want))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50000")
    try:
        rows = corpus.read_paragraphs(spark, str(path))
        got = [r.text for r in rows.orderBy("doc_seq").collect()]
        assert rows.rdd.getNumPartitions() >= 1 and got == want
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


@pytest.mark.parametrize("end", ["\n", "\r\n", "\r"])
@pytest.mark.parametrize("piece", [None, 997])
def test_paragraphs_with_any_line_end(spark, tmp_path, end, piece):
    """Paragraphs cross the pieces of a file, but not files; blank lines may hold spaces."""
    files = [[pad(f"{f} {i} ") + "\nline two é" + "\nlast" * (i % 3) for i in range(60)] for f in range(3)]
    for f, parts in enumerate(files):
        text = "\n \t\n".join(parts) + "\n" * (f % 2)
        (tmp_path / f"f{f}.txt").write_bytes(text.replace("\n", end).encode())
    if piece:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(piece))
    try:
        rows = corpus.read_paragraphs(spark, str(tmp_path)).orderBy("doc_seq").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r.text for r in rows] == sum(files, [])
    assert len({r.doc_seq for r in rows}) == len(rows)


def test_missing_and_non_string_columns_give_nulls(spark):
    table = spark.createDataFrame([(1, "x", 5)], "doc_id long, text string, n int")
    assert corpus.read_corpus(table).first().text == "x"
    assert corpus.read_corpus(table, "n").first().text is None
    assert corpus.read_corpus(table, "absent").first().text is None


def test_signature(spark, tmp_path):
    known = corpus.source_signature(
        corpus.table_identity("HuggingFaceTB/cosmopedia-100k", "default"), max_articles=100000)
    assert spark.range(1).select(known.alias("s")).first().s == "bf3c4c91b7b7f92a"
    path = tmp_path / "f.txt"
    path.write_text("hello")
    identity = corpus.file_identity(spark, str(path)).first().identity
    assert identity == f"text:{path}:5:{int(os.stat(path).st_mtime)}"


def test_content_identity(spark):
    rows = [(i, f"text {i}") for i in range(50)] + [(None, None), (50, "")]
    of = lambda given: corpus.content_identity(spark.createDataFrame(given, "a long, b string").repartition(3),
                                               ["a", "b"]).first().identity
    known = of(rows)
    assert of(rows[::-1]) == known and known.startswith("content:52:")
    others = [rows[1:], rows + rows[:1], [(0, "text 0 ")] + rows[1:], rows[:-1] + [(50, None)], [(None, "1"), *rows[1:]], []]
    assert len({known, *map(of, others)}) == len(others) + 1


def test_ledger_reads_new_files_only(spark, tmp_path, monkeypatch):
    data, folder = tmp_path / "data", str(tmp_path / "ledger")
    frame = lambda ids: spark.createDataFrame([(i, f"t{i}") for i in ids], "a long, b string").coalesce(1)
    frame(range(10)).write.mode("append").parquet(str(data))
    schema, read = frame([]).schema, []
    update = lambda: ledger.update_ledger(spark, str(data), schema, ["a", "b"], folder)
    sums = ledger.row_sums

    def watched(rows, columns, keys):
        read.append(rows.count())
        return sums(rows, columns, keys)

    monkeypatch.setattr(ledger, "row_sums", watched)
    whole = lambda: corpus.content_identity(spark.read.parquet(str(data)), ["a", "b"]).first()
    assert ledger.ledger_identity(update()).first() == whole() and read == [10]
    update()
    assert read == [10] and ledger.read_ledger(spark, folder).count() == 1
    frame(range(10, 17)).write.mode("append").parquet(str(data))
    first = whole()
    assert ledger.ledger_identity(update()).first() == first and read == [10, 7]
    for path in list(data.glob("*.parquet"))[:1]:
        path.unlink()
        os.remove(path.parent / f".{path.name}.crc")
    assert ledger.ledger_identity(update()).first() == whole() != first and read == [10, 7]
    assert ledger.read_ledger(spark, folder).count() == 1


def test_tolerant_log_lines(spark, tmp_path):
    lines = ['{"step": 1, "train_loss": 2.5, "val_loss": null, "time": "2026-01-02T03:04:05.678901+00:00"}',
             "", "  ", "not json", "[1, 2]", '{"step": 2, "train_loss": Infinity}',
             '{"step": 3, "train_loss": NaN, "lr": 1e-3, "extra": "x"}', '{"step": "four"}',
             '{"step": 5, "tokens_seen": 9}', '{"train_loss": 1.5}']
    (tmp_path / "one_log.jsonl").write_text("\n".join(lines) + "\n")
    rows = logs.read_run_log(spark, str(tmp_path)).orderBy("line_no").collect()
    assert [r.step for r in rows] == [1, 2, 3, 5, None]
    assert [r.line_no for r in rows] == [1, 2, 3, 4, 5] and {r.run_id for r in rows} == {"one"}
    assert rows[1].train_loss == float("inf") and str(rows[2].train_loss) == "nan"
    assert rows[0].time.microsecond == 678901 and rows[0].val_loss is None


def test_log_choice_and_append(spark, tmp_path):
    for name in ("b_log.jsonl", "a_log.jsonl", "c.jsonl"):
        (tmp_path / name).write_text("{}\n")
    pick = lambda d=None: logs.latest_log_name(spark, str(tmp_path), d).first().path
    assert pick().endswith("/b_log.jsonl") and pick("a").endswith("/a_log.jsonl")
    assert pick("zz").endswith("/b_log.jsonl")
    out = str(tmp_path / "named_log.jsonl")
    for step in (1, 2):
        entry = spark.createDataFrame([(step, 0.5)], "step long, train_loss double")
        logs.append_run_log(entry, out)
    rows = logs.read_run_log(spark, out).collect()
    assert [(r.run_id, r.line_no, r.step) for r in sorted(rows)] == [("named", 1, 1), ("named", 2, 2)]
    assert all(r.time for r in rows) and pick().endswith("/named_log.jsonl")


def test_lines_of_a_parallel_append_keep_their_order(spark, tmp_path):
    """The tasks of one append end in any order; here the first one is the last."""
    out = str(tmp_path / "run_log.jsonl")
    slow = F.udf(lambda i: time.sleep(1.5 if i == 0 else 0) or i, "bigint")
    rows = spark.range(0, 40, 1, 4).select(slow("id").alias("step"))
    logs.append_run_log(rows, out)
    logs.append_run_log(spark.range(99, 59, -1, 3).toDF("step").repartition(5), out, order=["step"])
    got = logs.read_run_log(spark, out).orderBy("line_no").collect()
    assert [r.step for r in got] == [*range(40), *range(60, 100)]
    assert [r.line_no for r in got] == list(range(1, 81)) and {r.run_id for r in got} == {"run"}


def test_token_cache(spark, tmp_path):
    root, made = str(tmp_path / "tokens"), []
    docs = spark.createDataFrame([(i, [i] * 9) for i in range(30)],
                                 "doc_seq long, token_ids array<int>")
    lengths = docs.select(F.size("token_ids").alias("n_tokens"))

    def make():
        made.append(1)
        return split_stream(pack(docs), lengths, 0.1, 4)

    first = cache.write_tokens(spark, make, root, "aa")
    again = cache.write_tokens(spark, make, root, "aa")
    assert len(made) == 1 and sorted(map(str, first.collect())) == sorted(map(str, again.collect()))
    cache.write_tokens(spark, make, root, "bb")
    assert len(made) == 2 and cache.read_tokens(spark, root, "aa").count() == again.count()
    assert cache.read_tokens(spark, root, "absent").count() == 0
    os.remove(tmp_path / "tokens" / "signature=aa" / "_SUCCESS")
    cache.write_tokens(spark, make, root, "aa")
    assert len(made) == 3


@pytest.fixture(scope="module")
def raw(spark):
    texts = [(i, f"document {i} " + "the cat sat on the mat " * (6 + i % 5)) for i in range(60)]
    return spark.createDataFrame(texts, "doc_seq long, text string")


def test_preparation_runs_once(spark, raw, tmp_path):
    run = lambda **other: prepare_corpus(spark, raw, str(tmp_path), 300, 0.05, 16, **other)
    made = run()
    rows = made.splits.collect()
    for split in ("train", "val"):
        part = sorted((r.start_pos, r.n_tokens) for r in rows if r.split == split)
        assert all(a + n == b for (a, n), (b, _) in zip(part, part[1:])) and part[0][0] == 0
    assert made.checks.where("ok").count() == 4 and made.report.first().actual == made.vocab.count()
    files = sorted(p for p in tmp_path.rglob("*.parquet"))
    assert sorted(map(str, run().splits.collect())) == sorted(map(str, rows))
    assert files == sorted(p for p in tmp_path.rglob("*.parquet"))


def test_every_setting_is_signed(spark, raw, tmp_path):
    """A changed setting or row never gives the tokens of another one."""
    run = lambda docs=raw, **other: prepare_corpus(spark, docs, str(tmp_path), **{
        "vocab_size": 262, "fraction": 0.05, "length": 16} | other)
    made = [run(), run(fraction=0.5), run(length=400), run(with_eot=False), run(max_articles=30), run(sample=10),
            run(vocab_size=260), run(raw.where("doc_seq <> 7"))]
    assert len({m.signature for m in made}) == len(made)
    tokens = [m.splits.agg(F.sum("n_tokens")).first()[0] for m in made]
    assert tokens[0] == tokens[1] == tokens[3] + 60 and tokens[2] == 2 * tokens[0]  # too short to cut
    assert tokens[4] < tokens[0] and made[4].checks.first().detail == 30
    assert run(fraction=0.5).signature == made[1].signature
    short = prepare_corpus(spark, raw.limit(1), str(tmp_path), 258, length=4000).checks.where("not ok")
    assert {r.check for r in short.collect()} == {"train_tokens", "windows"}


def test_windows_of_stored_blocks(spark, raw, tmp_path, monkeypatch):
    made = prepare_corpus(spark, raw, str(tmp_path), 262, 0.05, 16)
    for split in ("train", "val"):
        stream = [t for r in made.splits.where(F.col("split") == split).orderBy("start_pos").collect() for t in r.token_ids]
        assert blocks.stream_tokens(spark, made.blocks, split) == len(stream)
        for size in (7, 64, 1 << 14):
            folder = f"{tmp_path}/cut{size}"
            blocks.write_blocks(made.splits, folder, size)
            stored = blocks.read_blocks(spark, folder, split).orderBy("block").collect()
            assert [t for b in stored for t in b.token_ids] == stream
            assert {b.n_tokens for b in stored[:-1]} <= {size}
            starts = [0, 1, 6, len(stream) - 17, len(stream) - 16, 10 ** 9, 3, 3]
            asked = spark.createDataFrame([(0, k, s) for k, s in enumerate(starts)], "step long, row int, start long")
            for most in (2000, 1):
                monkeypatch.setattr(blocks, "NAMED_BLOCKS", most)
                got = {r.row: r.w for r in blocks.windows_at(spark, folder, split, asked, 16).collect()}
                assert got == {k: stream[s:s + 17] for k, s in enumerate(starts) if s + 17 <= len(stream)}
    pairs = training_batches(spark, made, "train", 3, 4, 16).collect()
    assert len(pairs) == 12 and all(r.x[1:] == r.y[:-1] and len(r.y) == 16 for r in pairs)
    assert training_batches(spark, made, "absent", 3, 4, 16).count() == 0


def test_few_windows_read_few_files(spark, tmp_path):
    pieces = spark.range(400).select(F.lit("train").alias("split"), (F.col("id") * 50).alias("start_pos"),
                                     F.lit(50).alias("n_tokens"), F.array_repeat(F.col("id").cast("int"), 50).alias("token_ids"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        blocks.write_blocks(pieces, str(tmp_path), 100)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    some = blocks.read_blocks(spark, str(tmp_path), "train", [3, 4])
    everything = blocks.read_blocks(spark, str(tmp_path), "train")
    assert len(some.inputFiles()) == 1 < len(everything.inputFiles())
    assert sorted(r.block for r in some.collect()) == [3, 4]
    assert "In(block, [3,4])" in some._jdf.queryExecution().executedPlan().toString()
    assert blocks.read_blocks(spark, str(tmp_path), "train", []).count() == 0
    assert blocks.read_blocks(spark, str(tmp_path), "train", [10 ** 6]).count() == 0
