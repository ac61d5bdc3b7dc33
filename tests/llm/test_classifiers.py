import random
import zlib

import numpy as np
import pytest
from millrace.llm import quality, toxicity

FOLDER = "/root/testdata/sf0.01"


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int, text string, label string")


def test_pairs_recover_an_order():
    draw = np.random.default_rng(1)
    truth = np.array([2.0, -1.0, 0.0])
    a, b = draw.normal(size=(4000, 3)), draw.normal(size=(4000, 3))
    first = draw.random(4000) < 1 / (1 + np.exp(-(a - b) @ truth))
    w = quality.fit_pairs(np.where(first[:, None], a, b), np.where(first[:, None], b, a))
    assert np.abs(w - truth).max() < 0.2


@pytest.mark.parametrize("module,label,least", [(quality, "quality", 0.97), (toxicity, "toxic", 0.93)])
def test_held_out_accuracy(spark, module, label, least):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r for r in module.judged(docs, labels).collect()}
    known = [(r[label], got[r.doc_id]) for r in labels.collect() if got[r.doc_id].held_out]
    assert len(got) == docs.count() and len(known) > 40
    assert sum(y == r.predicted for y, r in known) / len(known) >= least


@pytest.mark.parametrize("module", [quality, toxicity])
def test_odd_rows(spark, make_docs, odd_rows, module):
    docs = make_docs(odd_rows + [(100 + i, "fine words " * 20 if i % 2 else "## !! " * 30, "en", "s") for i in range(60)])
    labels = labels_of(spark, [(100 + i, i % 2, 1 - i % 2, "x", "y") for i in range(60)]
                       + [(None, 1, 1, None, None), (1, None, None, None, None), (101, 1, 0, None, None)])
    got = module.judged(docs, labels).collect()
    assert len(got) == len(odd_rows) + 60 and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id in (3, 4)}) == 1
    bare = module.judged(docs, labels.limit(0)).collect()
    assert len({r.score for r in bare}) == 1 and len(bare) == len(got)
    assert module.judged(make_docs([]), labels).count() == 0
    assert module.judged(make_docs([]), labels.limit(0)).count() == 0


def test_threshold_is_a_score_quantile():
    x = np.linspace(0, 1, 400)[:, None]
    model = quality.fit(x, (x[:, 0] > 0.25).astype(int), 0.25)
    assert np.mean(model.score(x) < quality.THRESHOLD) == pytest.approx(0.25, abs=0.02)


def test_quality_learns_from_all_labelled_rows(spark, make_docs, monkeypatch):
    """The model of a table is that of all its labelled rows, however many they are."""
    monkeypatch.setattr(quality, "BIN_ROWS", 50)
    draw = random.Random(5)
    texts = {i: " ".join(draw.choice(["fine", "Words", "##", "a", "12"]) for _ in range(draw.randrange(3, 12)))
             for i in range(12_000)}
    good = {i: int(draw.random() < (0.2 if "##" in t else 0.9)) for i, t in texts.items()}
    docs = make_docs([(i, t, "en", "s") for i, t in texts.items()])
    model = quality.learn(docs, labels_of(spark, [(i, y, 1, None, None) for i, y in good.items()]))
    ids = [i for i in texts if zlib.crc32(str(i).encode()) % quality.FOLDS != quality.HELD_OUT]
    by_hash = spark.createDataFrame([(i,) for i in ids], "doc_id bigint").selectExpr("doc_id", "xxhash64(doc_id) h")
    ids = [r.doc_id for r in sorted(by_hash.collect(), key=lambda r: (r.h, r.doc_id))]
    want = quality.fit(np.array([quality.features(texts[i]) for i in ids]), np.array([good[i] for i in ids]),
                       1 - sum(good[i] for i in ids) / len(ids))
    assert np.allclose(model.centre, want.centre) and np.allclose(model.scale, want.scale)
    assert np.allclose(model.weights, want.weights, atol=1e-6) and model.cut == pytest.approx(want.cut, abs=1e-6)


def test_swapped_groups_change_less(spark, make_docs):
    """A group named in most toxic texts of the sample: the penalty takes its weight away."""
    draw = random.Random(8)
    filler = ["river", "stone", "cloud", "paper", "green", "table", "music", "window"]
    rows, labels = [], []
    for i in range(600):
        toxic = i % 3 == 0
        group = "muslims" if draw.random() < (0.8 if toxic else 0.1) else draw.choice(["christians", "jews"])
        words = draw.sample(filler, 5) + [group] + (["scum"] if toxic and draw.random() < 0.9 else [])
        rows.append((i, " ".join(words), "en", "s"))
        labels.append((i, 1, int(toxic), None, None))
    docs, table = make_docs(rows), labels_of(spark, labels)
    plain = toxicity.learn(docs, table, penalty=0.0)
    fair = toxicity.learn(docs, table)
    gap = lambda m: m.score("river stone muslims cloud") - m.score("river stone christians cloud")
    assert gap(plain) > 0.1 and abs(gap(fair)) < 0.25 * gap(plain)
    assert fair.score("the muslims are scum") > 0.5 > fair.score("music of the muslims")


@pytest.mark.parametrize("named,others", [("muslime", ["christen", "juden"]), ("étrangers", ["immigrés", "réfugiés"]),
                                          ("judíos", ["cristianos", "ateos"])])
def test_swapped_groups_of_other_languages(spark, make_docs, named, others):
    draw = random.Random(8)
    filler = ["rio", "stein", "nube", "papier", "verde", "tafel", "musique", "fenster"]
    rows, labels = [], []
    for i in range(600):
        toxic = i % 3 == 0
        group = named if draw.random() < (0.8 if toxic else 0.1) else draw.choice(others)
        found = draw.sample(filler, 5) + [group] + (["abschaum"] if toxic and draw.random() < 0.9 else [])
        rows.append((i, " ".join(found), "xx", "s"))
        labels.append((i, 1, int(toxic), None, None))
    docs, table = make_docs(rows), labels_of(spark, labels)
    plain, fair = toxicity.learn(docs, table, penalty=0.0), toxicity.learn(docs, table)
    gap = lambda m: m.score(f"rio {named} nube") - m.score(f"rio {others[0]} nube")
    assert gap(plain) > 0.1 and abs(gap(fair)) < 0.25 * gap(plain)
    assert fair.counterfactuals == 600 - held_out(range(600))


def held_out(ids):
    return sum(zlib.crc32(str(i).encode()) % toxicity.FOLDS == toxicity.HELD_OUT for i in ids)


def test_a_group_term_has_one_row():
    terms = [t for row in toxicity.IDENTITY_TERMS for t in row]
    assert len(terms) == len(set(terms)) and all(toxicity.words(t) == {t} for t in terms)
