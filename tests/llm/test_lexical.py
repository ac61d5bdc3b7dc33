import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from millrace.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def cut(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k=10):
    """Rows of (item_id, rank, doc_id, score), in Python integers."""
    counts = [(doc_id, Counter(cut(text))) for doc_id, text in docs]
    n_docs, n_terms = sum(bool(c) for _, c in counts), sum(c.total() for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    wanted = defaultdict(Counter)
    for item_id, text in items:
        wanted[item_id].update(cut(text))
    out = []
    for item_id, words in wanted.items():
        found = []
        for doc_id, c in counts:
            m = 25 + 75 * c.total() * n_docs // max(n_terms, 1)
            score = sum(n * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                        * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, n in words.items() if c[t])
            if score > 0:
                found.append((-score, doc_id is None, doc_id or 0, doc_id))
        out += [(item_id, rank, row[3], -row[0]) for rank, row in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=repr)


def rows_of(found):
    return sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in found.collect()), key=repr)


def items_of(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "item_id bigint, text string, score string, rank int")


def test_terms():
    draw = random.Random(1)
    for _ in range(300):
        text = "".join(draw.choice("aZ09_-é漢ſK\x85  \n\x00.İ") for _ in range(draw.randint(0, 40)))
        assert [t.decode() for t in lexical.terms(text)] == cut(text)


@pytest.mark.parametrize("most, most_items", [(lexical.BLOCK_ENTRIES, lexical.BLOCK_ITEMS), (4, 2)])
def test_equals_brute_force(spark, make_docs, odd_rows, most, most_items):
    draw = random.Random(3)
    words = [f"t{i}" for i in range(40)] + ["Ärger", "漢字", "X9"]
    made = [(100 + i, " ".join(draw.choices(words, weights=range(1, 44), k=draw.randint(0, 60))), None, None)
            for i in range(400)]
    ties = [(900 + i, "tie tie other", None, None) for i in range(40)][::-1]
    docs = odd_rows + made + ties
    items = [(1, "t1 t2 t2 T30 missing"), (2, "tie"), (3, None), (4, "..."), (None, "ärger Ärger x9"),
             (5, "one two w17 w17"), (5, "three"), (6, "漢字 z"), (7, "absent")]
    got = lexical.search(make_docs(docs).repartition(5), items_of(spark, items), most=most, most_items=most_items)
    want = brute([(d[0], d[1]) for d in docs], items)
    assert rows_of(got) == want and [(r, 899 + r) for r in range(1, 11)] == sorted(r[1:3] for r in want if r[0] == 2)


def test_empty_tables(spark, make_docs):
    items = items_of(spark, [(1, "a")])
    assert rows_of(lexical.search(make_docs([]), items)) == []
    assert rows_of(lexical.search(make_docs([(1, None, None, None)]), items)) == []
    assert rows_of(lexical.search(make_docs([(1, "a", None, None)]), items_of(spark, []))) == []


def test_tiles_stay_exact():
    """Whatever the bound on sums, tiles keep it and add up to the same scores."""
    class Row:
        def __init__(self, item_id, term, times):
            self.item_id, self.term, self.times = item_id, term, times
    draw = random.Random(5)
    block = lexical.Block([Row(i, f"t{t}", draw.randint(1, 9)) for i in range(7) for t in draw.sample(range(50), 20)])
    weights = np.array([draw.randint(0, 5) for _ in block.terms])
    at, term = np.array([0, 0, 1, 2]), np.array([1, 5, 5, 9])
    impact = np.array([10, lexical.MOST_IMPACT, 7, 3])
    want = lexical.scores(3, at, term, impact, block.tiles(weights), 7)
    for most in (lexical.MOST_IMPACT * 3, lexical.MOST_IMPACT * 50 + 1):
        tiles = block.tiles(weights, most)
        assert len(tiles) > 1 and all(tile.sum(axis=1).max() * lexical.MOST_IMPACT < most for _, _, tile in tiles)
        assert (lexical.scores(3, at, term, impact, tiles, 7) == want).all()


def test_long_item_beyond_one_tile(spark, make_docs, monkeypatch):
    monkeypatch.setattr(lexical, "TILE_TERMS", 16)
    text = " ".join(f"w{i}" for i in range(300))
    docs = [(i, " ".join(f"w{j}" for j in range(i, 300, i + 1)), None, None) for i in range(30)]
    assert rows_of(lexical.search(make_docs(docs), items_of(spark, [(1, text)]))) == \
        brute([(d[0], d[1]) for d in docs], [(1, text)])
