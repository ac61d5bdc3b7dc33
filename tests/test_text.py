from pyspark.sql import functions as F

from millrace.functions.text import (SPACE_CHARS, clean_answer, ends_sentences, normalise, strip)
from millrace.operators import clean


def column(spark, values, function):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r.v for r in rows.select("i", function(F.col("t")).alias("v")).orderBy("i").collect()]


def test_space_characters_are_those_of_unicode():
    assert set(SPACE_CHARS) == {chr(c) for c in range(0x110000) if chr(c).isspace()}


def test_strip_every_space_and_nothing_else(spark):
    odd = ["​", "﻿", "᠎", "­", "é", "日", "😀"]
    values = [f"{c}x {c} y{c}{c}" for c in [*SPACE_CHARS, *odd]] + ["", " ", "　" * 5]
    assert column(spark, values, strip) == [v.strip() for v in values]


def test_normalise(spark):
    values = ["  a\u001c\n", " x　", "a\n\n\n\nb", "a\n\nb\n\n\nc", None]
    assert column(spark, values, normalise) == ["a", "x", "a\n\nb", "a\n\nb\n\nc", None]


def test_usable_length_counts_after_normalising(spark):
    texts = ["é" * 119, "é" * 120, " " * 9 + "a" * 119, "a" * 118 + "\n\n\n\n" + "b", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_seq long, text string")
    assert [r.doc_seq for r in clean.clean(docs).orderBy("doc_seq").collect()] == [1, 3]


def test_answers_and_sentences(spark):
    assert column(spark, [" a b <|end|> c", "<|x", "plain \n"], clean_answer) == ["a b", "", "plain"]
    assert column(spark, ["a. b.", "a.b. \n", "a.", "a. b", ".. x"], ends_sentences) == [
        True, True, False, False, False]


def test_limits_count_before_or_after_cleaning(spark):
    texts = ["short", "a" * 130, "short", "b" * 130, "c" * 130]
    docs = spark.createDataFrame([(10 * i, t) for i, t in enumerate(texts)],
                                 "doc_seq long, text string")
    ids = lambda df: sorted(r.doc_seq for r in df.collect())
    assert ids(clean.clean(clean.limit_raw(docs, 3))) == [10]
    assert ids(clean.limit_raw(docs, 0)) == [0, 10, 20, 30, 40]
    assert ids(clean.limit_raw(docs, 99)) == [0, 10, 20, 30, 40]
    assert ids(clean.limit_kept(clean.clean(docs), "doc_seq", 2)) == [10, 30]


def test_sample_is_exact_and_seeded(spark):
    docs = spark.range(5000).select(F.col("id").alias("doc_seq"), F.lit("t").alias("text"))
    pick = lambda seed, parts: {r.doc_seq for r in clean.sample_documents(
        docs.repartition(parts), 700, seed).collect()}
    assert len(pick(1, 3)) == 700 and pick(1, 3) == pick(1, 7) != pick(2, 3)
    assert clean.sample_documents(docs, 6000).count() == 5000


def test_readiness_of_empty_corpus(spark):
    sizes = spark.createDataFrame([], "split string, n_tokens long")
    n_docs = spark.createDataFrame([(0,)], "n_docs long")
    found = {r["check"]: (r.ok, r.detail) for r in clean.readiness(sizes, n_docs, 8, False).collect()}
    assert found == {"documents": (False, 0), "train_tokens": (False, 0), "windows": (False, -8),
                     "end_marker": (False, 0)}
    sizes = spark.createDataFrame([("train", 9), ("val", 50)], "split string, n_tokens long")
    found = {r["check"]: r.ok for r in clean.readiness(sizes, n_docs, 8, False, False).collect()}
    assert found == {"documents": False, "train_tokens": False, "windows": True, "end_marker": True}
