from pyspark.sql import functions as F

from millrace.operators import finetune
from millrace.sources.qa import read_qa

QA = "qa_id long, context string, question string, answers struct<text: array<string>>"


def test_examples(spark):
    rows = [(1, " c ", "q\n", ([" yes ", "no"],)), (2, "c", "q", ([],)), (3, "c", "q", (["x" * 60],)),
            (4, "c", "q", (["x" * 61],)), (5, "c", "q", (None,)), (6, "c", "q", (["  "],)),
            (7, "c", "q", (["y" * 60 + "  "],))]
    made = finetune.qa_examples(read_qa(spark.createDataFrame(rows, QA)))
    got = {r.qa_id: r.example for r in made.collect()}
    assert set(got) == {1, 3, 7}
    assert got[1] == "Context: c\nQuestion: q\nAnswer: yes<|endoftext|>"


def test_batches(spark):
    sizes = [4, 1, 9, 2, 2, 3, 5, 4, 7, 7, 7, 7, 7, 7, 7, 7, 1]
    rows = [(100 + i, list(range(1, n + 1))) for i, n in enumerate(sizes)]
    table = spark.createDataFrame(rows, "qa_id long, token_ids array<int>").repartition(5)
    short = finetune.truncated(table, 8)
    got = finetune.padded_batches(finetune.in_order(short, "qa_id"), 0).orderBy("qa_id").collect()
    assert [(r.batch, r.row) for r in got] == [(i // 8, i % 8) for i in range(17)]
    for r, n in zip(got, sizes):
        n = min(n, 8)
        width = (7, 6, 0)[r.batch]
        assert r.x == list(range(1, n)) + [0] * (width - n + 1)
        assert r.y == list(range(2, n + 1)) + [-100] * (width - n + 1)


def test_shuffle_is_a_seeded_permutation(spark):
    table = spark.range(500).withColumnRenamed("id", "qa_id")
    order = lambda parts, seed: [r.qa_id for r in finetune.shuffled(
        table.repartition(parts), "qa_id", seed).orderBy("place").collect()]
    assert order(1, 42) == order(9, 42) != order(1, 43)
    assert sorted(order(1, 42)) == list(range(500)) != order(1, 42)


def test_loader_starts_over_with_a_new_order(spark):
    table = spark.range(20).withColumnRenamed("id", "qa_id")
    rows = finetune.cycled_steps(table, "qa_id", 7).collect()
    assert {r.step for r in rows} == set(range(1, 8))
    by_epoch = {}
    for r in sorted(rows, key=lambda r: (r.step, r.row)):
        assert (r.epoch, r.batch) == ((r.step - 1) // 3, (r.step - 1) % 3)
        by_epoch.setdefault(r.epoch, []).append(r.qa_id)
    assert sorted(by_epoch[0]) == sorted(by_epoch[1]) == list(range(20))
    assert by_epoch[0] != by_epoch[1] and len(by_epoch[2]) == 8
