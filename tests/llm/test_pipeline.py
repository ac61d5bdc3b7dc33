"""The pipeline against plain Python, stage by stage and as a whole."""

import hashlib
import random
import re
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
from millrace import session
from millrace.llm import catalog, quality
from test_mixing import brute_targets, check
from test_neardup import brute as near_groups
from tokenizers import Tokenizer

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(corpus_pipeline.written(stage(spark, out[-1], FOLDER), "step"))
    return out


def rows(df):
    return [(r.doc_id, r.text, r.lang, r.source) for r in df.collect()]


def test_quality_stage(spark, steps):
    model = quality.learn(steps[0], spark.read.parquet(f"{FOLDER}/labels.parquet"))
    good = lambda t: model.score(np.array([quality.features(t)]))[0] >= quality.THRESHOLD
    assert sorted(rows(steps[1])) == sorted(r for r in rows(steps[0]) if good(r[1]))


def test_copies_stages(steps):
    seen, kept = {}, []
    for r in sorted(rows(steps[1])):
        if seen.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r[1]), r[0]) == r[0]:
            kept.append(r)
    assert sorted(rows(steps[2])) == kept
    stay = {i for i, _, _, k in near_groups(kept, 5) if k}
    assert sorted(rows(steps[3])) == [r for r in kept if r[0] in stay]


def test_mix_stage(steps):
    before, after = rows(steps[3]), rows(steps[4])
    times = Counter(r[0] for r in after)
    size = lambda r: len(r[1].encode().split())
    found = corpus_pipeline.mixing.mix(steps[3]).collect()
    check(before, found)
    assert times == Counter({g.doc_id: g.copies for g in found if g.copies})
    assert sum(map(size, after)) == sum(g.taken for g in found)


def test_encoding_stage_and_run(spark, steps):
    import public_tokenizers
    library = Tokenizer.from_file(public_tokenizers.path(catalog.VOCABULARY))
    library.no_truncation()
    library.no_padding()
    want = []
    for doc_id, text, _, _ in rows(steps[4]):
        ids = library.encode(text, add_special_tokens=False).ids
        sha = lambda b: hashlib.sha256(b).hexdigest()
        want.append((doc_id, len(ids), sha(np.array(ids, "<u4").tobytes()),
                     sha(library.decode(ids, skip_special_tokens=False).encode())))
    assert sorted(map(tuple, steps[5].collect())) == sorted(want)
    assert sorted(map(tuple, corpus_pipeline.run(spark, FOLDER).collect())) == sorted(want)


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_odd_rows(spark, make_docs, odd_rows, name, stage):
    for given in (odd_rows, []):
        docs = make_docs(given)
        out = stage(spark, docs, FOLDER)
        if (name, stage) != corpus_pipeline.STAGES[-1]:
            assert out.columns == docs.columns
        assert out.count() <= 4 * len(given)


@pytest.fixture(params=["files", "memory"])
def crowd(request, make_docs, spark, tmp_path):
    """Rows of which a third has no id, with repeated ids, texts and whole rows; and a frame
    of them, from files or not, with a source per row or of three."""
    draw = random.Random(2)
    texts = [" ".join(draw.choice("abcdefgh") * 3 + str(draw.randrange(9)) for _ in range(40)) for _ in range(40)]

    def made(sources):
        rows = [(None if i % 3 == 0 else draw.randrange(60), draw.choice(texts) + draw.choice(["", " tail"]),
                 "en", f"s{i % sources}") for i in range(300)]
        docs = make_docs(rows + rows[:60] if sources == 3 else rows)
        if request.param == "files":
            docs.repartition(5).write.parquet(f"{tmp_path}/crowd")
            docs = spark.read.parquet(f"{tmp_path}/crowd")
        return (rows + rows[:60] if sources == 3 else rows), docs

    return made


def smallest(rows):
    return min((r[0] is None, r[0] or 0) for r in rows)


def test_one_row_of_each_group_stays(spark, crowd):
    given, docs = crowd(300)
    exact = {}
    for r in given:
        exact.setdefault(r[1], []).append(r)
    near = {}
    for k, _, least, _ in near_groups([(k, r[1]) for k, r in enumerate(given)], 5):
        near.setdefault(least, []).append(given[k])
    for stage, groups in ((corpus_pipeline.exact_dedup, exact), (corpus_pipeline.near_dedup, near)):
        stayed = {r[3]: r for r in rows(stage(spark, docs, FOLDER))}
        assert len(stayed) == len(groups)
        for group in groups.values():
            left = [stayed[r[3]] for r in group if r[3] in stayed]
            assert len(left) == 1 and smallest(left) == smallest(group)


def test_mix_of_rows_without_ids(spark, crowd):
    given, docs = crowd(3)
    words = lambda found, s: sum(len(r[1].split()) for r in found if r[3] == s)
    out = rows(corpus_pipeline.source_mix(spark, docs, FOLDER))
    for source, target in brute_targets({s: words(given, s) for s in ("s0", "s1", "s2")}).items():
        assert abs(words(out, source) - target) <= 41
    assert all(n <= 2 * Counter(given)[r] for r, n in Counter(out).items())


def test_copies_stages_do_not_write_texts_again(spark, monkeypatch):
    """Rows of files have a key already; both stages write digests and hashes only."""
    docs, paths, folder = spark.read.parquet(f"{FOLDER}/documents.parquet"), [], session.shared_folder
    monkeypatch.setattr(session, "shared_folder", lambda *of: paths.append(folder(*of)) or paths[-1])
    for stage in (corpus_pipeline.exact_dedup, corpus_pipeline.near_dedup):
        stage(spark, docs, FOLDER)
    assert any("/signatures-" in p for p in paths)
    assert not [p for p in paths if "text" in spark.read.parquet(p).columns]
