import math
from collections import Counter, defaultdict

import pytest
from millrace.llm import mixing


def brute_targets(sizes):
    """Share by weight; cut at the cap and share the rest anew until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(names)}
    total = 1.5 * sum(sizes.values())
    capped = set()
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(2 * sizes[s] for s in capped)
        whole = sum(weight[s] for s in free)
        share = {s: left * weight[s] / whole for s in free}
        over = [s for s in free if share[s] > 2 * sizes[s]]
        if not over:
            return {s: share.get(s, 2.0 * sizes[s]) for s in names}
        capped |= set(over)


def brute_rate(sizes, target):
    """The multiplier by bisection, as rates by size."""
    mean = sum(sizes) / len(sizes)
    rate = lambda m, x: 2 / (1 + math.exp(max(-700, min(700, -m * x / mean))))
    low, high = -1e4, 1e4
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(rate(mid, x) * x for x in sizes) < target else (low, mid)
    return {x: rate(low, x) for x in sizes}


def check(rows, got):
    sizes = {i: len((r[1] or "").encode().split()) for i, r in enumerate(rows)}
    by_source = defaultdict(list)
    for i, r in enumerate(rows):
        by_source[r[3]].append(sizes[i])
    want = brute_targets({s: sum(v) for s, v in by_source.items()})
    assert len(got) == len(rows)
    assert Counter((g.doc_id, g.size) for g in got) == Counter((r[0], sizes[i]) for i, r in enumerate(rows))
    taken = defaultdict(int)
    source_of = {r[0]: r[3] for r in rows}
    for g in got:
        s = source_of[g.doc_id]
        assert g.target == pytest.approx(want[s]) and g.source_size == sum(by_source[s])
        assert 0 <= g.taken <= 2 * g.size and g.taken == g.copies * g.size
        taken[s] += g.taken
    for s, v in by_source.items():
        assert abs(taken[s] - want[s]) <= max(v)
    return taken


def test_targets_rates_and_copies(spark, make_docs):
    rows = [(i, " ".join(["w"] * (1 + (i * 37) % 90)), "en", f"s{i % 7}" if i % 3 else "s0") for i in range(600)]
    docs = make_docs(rows)
    got = mixing.mix(docs).collect()
    check(rows, got)
    assert sorted(got) == sorted(mixing.mix(docs.repartition(7)).collect())
    groups = defaultdict(list)
    for g in got:
        groups[rows[g.doc_id][3]].append(g)
    for own in groups.values():
        # Rounding stays within one copy of the sum of rates up to each size.
        rates = brute_rate([g.size for g in own], own[0].target)
        error = 0.0
        for g in sorted(own, key=lambda g: g.size):
            error += g.copies - rates[g.size]
        assert abs(error) < 2 + 1e-3 * len(own)


def test_odd_rows(make_docs, odd_rows):
    got = mixing.mix(make_docs(odd_rows)).collect()
    assert len(got) == len(odd_rows)
    assert sum(g.taken for g in got) == pytest.approx(1.5 * sum(g.size for g in got), rel=0.5)
    assert all(g.taken == 0 for g in got if g.size == 0)
    out = mixing.mixed(make_docs(odd_rows))
    assert out.columns == make_docs(odd_rows).columns
    assert max(Counter(r.doc_id for r in out.collect() if r.doc_id and r.doc_id > 1).values()) <= 2


def test_empty_and_wordless(make_docs):
    assert mixing.mix(make_docs([])).count() == 0
    assert mixing.mixed(make_docs([])).count() == 0
    got = mixing.mix(make_docs([(1, None, None, "a"), (2, "", None, None)])).collect()
    assert [(g.size, g.target, g.taken, g.copies) for g in got] == [(0, 0.0, 0, 1)] * 2
