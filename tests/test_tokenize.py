import json

import pytest
from pyspark.sql import functions as F

from millrace.operators import tokenize

tokenizers = pytest.importorskip("tokenizers")

TEXTS = ["the cat sat on the mat. The cats' mats aren't flat!", "aaaa aaa aa aaaaaaa banana bananas",
         "  leading and   inner  spaces \n\n\ttabs\n", "naïve café — 日本語のテキスト 12345 ½ 🙂🙂",
         "x" * 500 + " " + "ab" * 300 + " abababa", "", "no<|endoftext|>marker <|endoftext|>",
         "int main() { return 0; } // comment \\n 3.14159e-10", " nbsp em　wide\u0085nel"]
TEXTS += [f"word{i % 13} stem{i % 7}ing the quick brown fox {i}" for i in range(200)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_seq long, text string").repartition(3)


def library(texts, size):
    model = tokenizers.ByteLevelBPETokenizer()
    model.train_from_iterator(texts, vocab_size=size, min_frequency=2,
                              special_tokens=["<|endoftext|>"], show_progress=False)
    stored = json.loads(model._tokenizer.to_str())["model"]
    return model, stored["vocab"], [tuple(m) for m in stored["merges"]]


@pytest.fixture(scope="module")
def trained(docs):
    return tokenize.train(tokenize.pre_token_counts(docs), 420)


def test_pre_tokens(spark, docs):
    cut = tokenizers.pre_tokenizers.ByteLevel(add_prefix_space=False)
    display = tokenize.byte_display()
    shown = lambda w: "".join(display[b] for b in w.encode())
    got = docs.select("doc_seq", tokenize.pre_tokens(F.col("text")).alias("p")).collect()
    for r in got:
        assert [shown(w) for w in r.p] == [p for p, _ in cut.pre_tokenize_str(TEXTS[r.doc_seq])]


def test_training_equals_the_library(docs, trained):
    _, vocab, merges = library(TEXTS, 420)
    assert {r.token: r.id for r in tokenize.vocabulary(trained).collect()} == vocab
    texts = tokenize.merge_texts(trained, tokenize.vocabulary(trained)).orderBy("rank").collect()
    assert [(r.left, r.right) for r in texts] == merges


@pytest.mark.parametrize("candidates", [5, 60])
def test_training_with_few_candidates(docs, trained, candidates):
    """However often the index is made anew, the merges are the same."""
    got = tokenize.train(tokenize.pre_token_counts(docs), 330, candidates=candidates).orderBy("rank").collect()
    assert got == trained.orderBy("rank").limit(330 - tokenize.FIRST_MERGE).collect()


def test_a_round_reads_the_words_it_asks_for(spark, docs, monkeypatch):
    """Counts after each round are those of counting all words, and the scan takes roots."""
    work = tokenize.pre_token_counts(docs)
    plans, counted = [], []

    class Watched(tokenize._Index):
        def merge(self, batch, guess, asked):
            table = self.table
            self.table = type("Table", (), {"where": lambda _, c: plans.append(table.where(c)) or plans[-1],
                                            "__getattr__": lambda _, n: getattr(table, n)})()
            out = super().merge(batch, guess, asked)
            self.table = table
            counted.append((list(self.merges), dict(self.counts)))
            return out

    monkeypatch.setattr(tokenize, "_Index", Watched)
    tokenize.train(work, 290)
    words = [([int(b) for b in r.word.encode()], r.n) for r in work.collect()]
    ids = tokenize.byte_ids()
    for merges, counts in counted[::3]:
        want = {}
        for symbols, n in words:
            seq = [int(ids[b]) for b in symbols]
            for m in merges:
                out = []
                for x in seq:
                    if out and (out[-1], x) == (m.left_id, m.right_id):
                        out[-1] = m.new_id
                    else:
                        out.append(x)
                seq = out
            for pair in zip(seq, seq[1:]):
                want[pair] = want.get(pair, 0) + n
        assert counts == {p: n for p, n in want.items() if p in counts}
        assert max(want.values()) == max(counts.values())
    plan = plans[-1]._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "In(root," in plan


def test_rare_words_fall_together_in_the_index(spark, monkeypatch):
    """Words that differ only where nothing frequent joins them are few parts in the index."""
    words = spark.createDataFrame(
        [(" there" + chr(0x4E00 + i) + "here", 1) for i in range(2000)]
        + [(f"{a}{b}", 50) for a in "abcdef" for b in "uvwxyz"], "word string, n long")
    made, postings = [], tokenize._postings

    def watched(work, pairs):
        made.append(work.count())
        return postings(work, pairs)

    monkeypatch.setattr(tokenize, "_postings", watched)
    merges = tokenize.train(words, 262)
    texts = tokenize.merge_texts(merges, tokenize.vocabulary(merges)).orderBy("rank").collect()
    assert [r.left + r.right for r in texts][0] == "er" and max(made) < 200


def test_training_stops_without_frequent_pairs(spark):
    words = spark.createDataFrame([("zy", 1), ("ba", 1)], "word string, n long")
    merges = tokenize.train(words, 900)
    assert merges.count() == 0
    report = tokenize.vocabulary_report(tokenize.vocabulary(merges), 900).first()
    assert (report.requested, report.actual, report.complete) == (900, 257, False)


def test_known_small_training(spark):
    rows = spark.createDataFrame([(0, "zy ba zy ba"), (1, "zyba")], "doc_seq long, text string")
    merges = tokenize.train(tokenize.pre_token_counts(rows), 260)
    texts = tokenize.merge_texts(merges, tokenize.vocabulary(merges)).orderBy("rank").collect()
    assert [r.left + r.right for r in texts] == ["ba", "zy", "Ġba"]


def test_encoding_equals_the_library(docs, trained):
    trained_model, vocab, merges = library(TEXTS, 420)
    reloaded = tokenizers.ByteLevelBPETokenizer(vocab, merges)
    for special, model in ((False, reloaded), (True, trained_model)):
        rows = tokenize.encode(docs, trained, parse_special=special).collect()
        for r in rows:
            assert r.token_ids == model.encode(r.text).ids


def test_encoding_of_nothing(spark, trained):
    empty = spark.createDataFrame([(0, ""), (1, "")], "doc_seq long, text string").coalesce(1)
    assert [r.token_ids for r in tokenize.encode(empty, trained).collect()] == [[], []]
    none = tokenize.train(spark.createDataFrame([], "word string, n long"), 300)
    one = spark.createDataFrame([(0, "ab")], "doc_seq long, text string")
    # The byte 33 has id 1, so "a" (97) has id 65.
    assert tokenize.encode(one, none).first().token_ids == [65, 66]


def test_decoding(spark, docs, trained):
    vocab = tokenize.vocabulary(trained)
    back = tokenize.decode(tokenize.encode(docs, trained), vocab)
    assert back.where(F.col("decoded") != F.col("text")).count() == 0
    odd = spark.createDataFrame([(0, [0]), (1, [200, 65]), (2, [])],
                                "i int, token_ids array<int>")
    model = tokenizers.ByteLevelBPETokenizer(*library(TEXTS, 420)[1:])
    got = {r.i: r.decoded for r in tokenize.decode(odd, vocab).collect()}
    assert got[0] == "<|endoftext|>" and got[2] == ""
    assert got[1] == model.decode([200, 65])


def test_lookup_and_stored_texts(spark, trained):
    vocab = tokenize.vocabulary(trained)
    asked = spark.createDataFrame([("<|endoftext|>",), ("the-absent",), ("a",)], "token string")
    got = {r.token: r.id for r in tokenize.token_id(asked, vocab).collect()}
    assert got["<|endoftext|>"] == 0 and got["the-absent"] is None and got["a"] == 65
    texts = tokenize.merge_texts(trained, vocab)
    again = tokenize.merges_from_texts(texts, vocab)
    assert sorted(again.collect()) == sorted(trained.select(again.columns).collect())
