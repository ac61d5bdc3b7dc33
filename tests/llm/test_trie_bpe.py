import random

import numpy as np
import public_tokenizers
import pytest
from millrace.llm import trie_bpe
from tokenizers import Tokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    made = Tokenizer.from_file(PATH)
    made.no_truncation()
    made.no_padding()
    return made


def test_like_the_library(library):
    draw = random.Random(4)
    letters = [chr(c) for c in [*range(0x20, 0x500), *range(0x3040, 0x3100), 0x1F600]] + list("there and in ") * 90
    texts = ["".join(draw.choice(letters) for _ in range(draw.randint(0, 60))) for _ in range(3000)]
    texts += ["", "aaaa" * 50, "a<|endoftext|>B <|STARTOFTEXT|><|startoftext|>", "ΑΣ ΑΣ.", "\x1c\x1d\x85\u200b", "'LL I'll"]
    made = trie_bpe.TrieEncoder(trie_bpe.read_vocabulary(PATH))
    packed = made.packed(texts)
    back = trie_bpe.decoded(packed, trie_bpe.token_array(trie_bpe.read_vocabulary(PATH))).to_pylist()
    for text, ids, said, want in zip(texts, made.encode(texts), back, library.encode_batch(texts, add_special_tokens=False)):
        assert ids.tolist() == want.ids, text
        assert said == library.decode(want.ids, skip_special_tokens=False)
    assert trie_bpe.decoded([], trie_bpe.token_array(trie_bpe.read_vocabulary(PATH))).to_pylist() == []


def test_slices_are_bounded():
    texts = ["a" * n for n in (10, trie_bpe.SLICE_BYTES, 5, 5)] + [None, "b" * (3 * trie_bpe.SLICE_BYTES), ""] * 2
    batch = trie_bpe.pa.RecordBatch.from_arrays([trie_bpe.pa.array(texts)], ["text"])
    parts = [p.column("text").to_pylist() for p in trie_bpe.slices(batch, "text")]
    assert sum(parts, []) == texts
    assert all(len(p) == 1 or sum(len(t or "") for t in p) <= trie_bpe.SLICE_BYTES
               or sorted(len(t or "") for t in p)[-2] == 0 for p in parts)


def test_shared_prefixes_are_computed_once():
    made = trie_bpe.TrieEncoder(trie_bpe.read_vocabulary(PATH))
    words = ["inter", "internal", "internals", "in", "unrelated"]
    together = made.encode_words(words)
    assert together == {w: made.encode_words([w])[w] for w in words}


def test_spark_round_trip(make_docs, odd_rows, library):
    vocabulary = trie_bpe.read_vocabulary(PATH)
    got = trie_bpe.round_trip(make_docs(odd_rows), vocabulary).collect()
    steps = trie_bpe.decode(trie_bpe.encode(make_docs(odd_rows), vocabulary), vocabulary).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, steps))
    assert len(got) == len(odd_rows)
    texts = {r[0]: r[1] or "" for r in odd_rows if r[0]}
    for row in got:
        if row.doc_id:
            want = library.encode(texts[row.doc_id], add_special_tokens=False).ids
            assert np.frombuffer(row.ids, "<u4").tolist() == want and row.n_tokens == len(want)
            assert row.text == library.decode(want, skip_special_tokens=False)
    assert trie_bpe.encode(make_docs([]), vocabulary).count() == trie_bpe.round_trip(make_docs([]), vocabulary).count() == 0
