import random

from millrace.llm import language

FOLDER = "/root/testdata/sf0.01"


def brute_phrases(text, sample):
    """Greedy parse by substring search, piece by piece."""
    n = 0
    for low in range(0, len(text), language.PIECE):
        piece = text[low:low + language.PIECE]
        at = 0
        while at < len(piece):
            end = at + 1
            while end < len(piece) and piece[at:end + 1] in sample:
                end += 1
            n += 1
            at = end
    return n


def test_phrases_equal_a_plain_parse():
    draw = random.Random(6)
    text = lambda n, letters: "".join(draw.choice(letters) for _ in range(n))
    samples = {"p": text(400, "ab "), "q": text(300, "bcd ")}
    model = language.Automata(samples)
    texts = [text(draw.randint(1, 1400), "abcdé ") for _ in range(40)]
    got = model.phrases(texts)
    for t, row in zip(texts, got):
        # A character the sample lacks ends the phrase before it and starts one of its own.
        assert list(row) == [brute_phrases(t, samples[k]) for k in ("p", "q")]


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    got = language.identify(docs).collect()
    held = [r for r in got if r.held_out]
    assert len(got) == len(truth) and len(held) > 150
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.97


def test_odd_rows(make_docs, odd_rows):
    got = language.identify(make_docs(odd_rows)).collect()
    assert len(got) == len(odd_rows) and all(0 <= r.score <= 1 for r in got)
    by_id = {r.doc_id: r.lang_pred for r in got}
    assert [by_id[i] for i in (3, 4, 7)] == ["und"] * 3 and by_id[1] != "und"
    assert language.identify(make_docs([])).count() == 0
    unlabelled = [(i, "some text", None, "s") for i in range(4)]
    assert {r.lang_pred for r in language.identify(make_docs(unlabelled)).collect()} == {"und"}


def test_learns_without_the_held_out_fold(make_docs):
    rows = [(i, f"abc{i} def", "en", "s") for i in range(40)]
    docs = make_docs(rows)
    seen = {r.doc_id: r.held_out for r in language.identify(docs).collect()}
    changed = make_docs([(i, t, "zz" if seen[i] else l, s) for i, t, l, s in rows])
    assert language.learn(docs) == language.learn(changed)
