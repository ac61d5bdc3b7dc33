import hashlib
import random
import re
from collections import defaultdict

from millrace.llm import cuckoo


def digest(i):
    return hashlib.sha256(str(i).encode()).digest()


def test_index_like_a_dict():
    draw = random.Random(3)
    index, want = cuckoo.CuckooIndex(buckets=2), {}
    for step in range(6000):
        key = digest(draw.randrange(1500))
        if draw.random() < 0.3:
            assert index.remove(key) == (want.pop(key, None) is not None)
        else:
            doc = draw.choice([None, draw.randrange(10_000)])
            first, n = want.get(key, (None, 0))
            want[key] = (min((d for d in (first, doc) if d is not None), default=None), n + 1)
            index.add(key, doc)
        if step % 1000 == 0:
            index = cuckoo.CuckooIndex.from_row(index.to_row())
    assert len(index) == len(want) and index.buckets > 2
    assert all(index.find(digest(i)) == want.get(digest(i)) for i in range(1500))


def test_equal_fingerprints_are_told_apart():
    """Digests that agree in all that the filter sees still are different keys."""
    keys = [digest(1)[:10] + bytes([i]) * 22 for i in range(9)]
    index = cuckoo.CuckooIndex()
    for i, key in enumerate(keys[:8]):
        index.add(key, i)
    assert [index.find(k) for k in keys[:8]] == [(i, 1) for i in range(8)]
    assert index.find(keys[8]) is None


def brute(rows):
    groups = defaultdict(list)
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    for r in rows:
        groups[norm(r[1])].append(r[0])
    out = []
    for r in rows:
        ids = groups[norm(r[1])]
        keep = min((i for i in ids if i is not None), default=None)
        out.append((r[0], keep, len(ids), r[0] == keep, hashlib.sha256(norm(r[1]).encode()).hexdigest()))
    return sorted(out, key=repr)


def test_deduplicate(make_docs, odd_rows):
    rows = odd_rows + [(100 + i, f"text {i % 40}", "en", "s") for i in range(300)]
    rows += [(1000 + i, "the same  again" if i % 2 else "the same\nagain", "en", "s") for i in range(400)]
    got = cuckoo.deduplicate(make_docs(rows).repartition(5))
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows)
    assert cuckoo.deduplicate(make_docs([])).count() == 0


def test_live_index(make_docs):
    rows = lambda ids: cuckoo.digests(make_docs([(i, f"text {i % 50}", None, None) for i in ids]))
    index = cuckoo.insert(cuckoo.empty_index(rows([0])), rows(range(100)), 4)
    index = cuckoo.insert(index, rows([3, 250]), 4)
    # Of each text two rows are there, of text 3 three; 7 loses one, 8 both, 3 its first and another.
    left = [i for i in range(100) if i not in (7, 8, 58, 3, 53)] + [3, 250]
    index = cuckoo.delete(index, rows([7, 8, 58, 3, 53, 400]), rows(left), 4)
    live = {r.digest: (r.keep_id, r.group_size) for r in cuckoo.entries(index).collect()}
    of = lambda i: live.get(hashlib.sha256(f"text {i}".encode()).digest())
    assert len(live) == 49 and of(8) is None and of(7) == (57, 1) and of(3) == (3, 1) and of(9) == (9, 2)
    assert of(0) == (0, 3) and sum(n for _, n in live.values()) == 97
    found = cuckoo.lookup(index, rows([7, 8, 9, 59, 0]), 4).collect()
    assert sorted((r.keep_id, r.group_size) for r in found) == [(0, 3), (9, 2), (57, 1)]
