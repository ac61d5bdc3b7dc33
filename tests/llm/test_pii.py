import itertools
import random
import re

import numpy as np
import pytest
from millrace.llm import pii


def brute(text):
    found = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text)
              if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        total = sum(int(c) if i % 2 == 0 else int("0246813579"[int(c)]) for i, c in enumerate(digits[::-1]))
        if 12 <= len(digits) <= 19 and total % 10 == 0:
            found.append((2, *m.span()))
    found += [(3, *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text)
              if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(found, key=lambda s: (s[1], s[0]))


def test_base_spans():
    draw = random.Random(9)
    for _ in range(8000):
        text = "".join(draw.choice("0123456789..@@ -+()ab%é,") for _ in range(draw.randint(0, 60)))
        assert pii.base_spans(text) == brute(text), text


def test_viterbi_finds_the_best_path():
    draw = np.random.default_rng(3)
    pairs = draw.normal(size=(5, 5))
    rows = [draw.normal(size=(n, 5)) for n in (1, 4, 2, 5, 3)]
    for e, got in zip(rows, pii.viterbi(rows, pairs)):
        value = lambda p: sum(e[t, l] for t, l in enumerate(p)) + sum(pairs[a, b] for a, b in zip(p, p[1:]))
        assert list(got) == list(max(itertools.product(range(5), repeat=len(e)), key=value))


def test_marginals_are_the_gradient():
    table = pii.labelled_table(6, 1)
    sizes = np.array([len(w) for w, _ in table])
    draw = np.random.default_rng(5)
    scores, pairs = draw.normal(size=(sizes.max(), len(table), 5)), draw.normal(size=(5, 5))
    share, pair = pii._marginals(scores, pairs, sizes)
    assert np.allclose(share.sum(axis=2), np.arange(sizes.max())[:, None] < sizes)
    assert pair.sum() == pytest.approx((sizes - 1).sum())


def test_model_on_other_rows():
    table = pii.labelled_table(200, 77)
    model = pii.model()
    best = pii.viterbi([model.emissions(w) for w, _ in table], model.pairs)
    right = sum((np.array(l) == b).sum() for (_, l), b in zip(table, best))
    assert right / sum(len(l) for _, l in table) > 0.97


def test_added_spans():
    texts = ["call (212) 555-0142 now", "card 4111.1111.1111.1111 was used", "at +1 (212) 555-0142 and a@b.co",
             "in 2024-01-02 at 12:30 it cost 1,299.00", ""]
    got = pii.find(texts, pii.model())
    assert got[0] == [("phone", 5, 19, False)] and got[1] == [("card", 5, 24, False)]
    assert got[2] == [("phone", 3, 20, True), ("email", 25, 31, True)] and got[3] == got[4] == []


@pytest.mark.parametrize("text,mail", [
    ("write to john at example.com", "john at example.com"), ("reach john (AT) example.com now", "john (AT) example.com"),
    ("ask john [at] example.com today", "john [at] example.com"), ("WRITE TO JOHN AT EXAMPLE DOT COM", "JOHN AT EXAMPLE DOT COM"),
    ("send jane(at)example.com", "jane(at)example.com"), ("mail jane[at]example.org now", "jane[at]example.org"),
    ("mail jane(at)example(dot)org now", "jane(at)example(dot)org"), ("mail ann at mail dot com now", "ann at mail dot com")])
def test_written_out_addresses(text, mail):
    [[(kind, start, end, base)]] = pii.find([text], pii.model())
    assert kind == "email" and not base and mail in text[start:end]


def test_words_count_whole():
    tail = "x" * 70 + "[at]mail.example.com"
    assert pii.shape_features(tail) != pii.shape_features("x" * 90) and "at=True" in pii.shape_features(tail)
    assert "digits=20" in pii.shape_features("x" * 100 + "7" * 40)
    assert pii.find(["mail " + tail + " now"], pii.model())[0] == [("email", 5, 5 + len(tail), False)]
    assert pii.find(["look at this. at home we eat at six dots"], pii.model()) == [[]]


def test_marginals_by_enumeration_and_gradient_by_differences():
    draw = np.random.default_rng(7)
    sizes = np.array([3, 1, 4])
    scores, pairs = draw.normal(size=(4, 3, 5)), draw.normal(size=(5, 5))
    share, pair = pii._marginals(scores, pairs, sizes)
    want, want_pair, total = np.zeros_like(share), np.zeros_like(pair), 0.0

    def value(path, s):
        return sum(scores[t, s, l] for t, l in enumerate(path)) + sum(pairs[a, b] for a, b in zip(path, path[1:]))

    for s, n in enumerate(sizes):
        paths = list(itertools.product(range(5), repeat=int(n)))
        weights = np.exp([value(p, s) for p in paths])
        total += np.log(weights.sum())
        for p, w in zip(paths, weights / weights.sum()):
            for t, l in enumerate(p):
                want[t, s, l] += w
            for a, b in zip(p, p[1:]):
                want_pair[a, b] += w
    assert np.allclose(share, want) and np.allclose(pair, want_pair)
    norm = lambda: sum(np.log(sum(np.exp(value(p, s)) for p in itertools.product(range(5), repeat=int(n))))
                       for s, n in enumerate(sizes))
    scores[2, 0, 3] += 1e-5
    assert (norm() - total) / 1e-5 == pytest.approx(share[2, 0, 3], abs=1e-4)
    scores[2, 0, 3] -= 1e-5
    pairs[1, 2] += 1e-5
    assert (norm() - total) / 1e-5 == pytest.approx(pair[1, 2], abs=1e-4)


def test_a_long_text_does_not_pad_the_others(monkeypatch):
    draw = random.Random(4)
    numbers = " ".join(str(draw.randint(0, 10 ** draw.randint(1, 9))) for _ in range(99_996))
    texts = [f"row {i} call ({200 + i % 700}) 555-{i:04} now" for i in range(1000)]
    texts.insert(500, "call (212) 555-0142 now " + numbers)
    cells, decode = [], pii.viterbi

    def spy(emissions, pairs):
        cells.append(len(emissions) * max(map(len, emissions)))
        return decode(emissions, pairs)

    monkeypatch.setattr(pii, "viterbi", spy)
    got = pii.find(texts, pii.model())
    assert max(cells) <= 1 << 19
    assert got == [pii.find([t], pii.model())[0] for t in texts]
    assert ("phone", 5, 19, False) in got[500]


def test_odd_rows(make_docs, odd_rows):
    rows = odd_rows + [(20, "1" * 60_000 + ".1.2.3 " + "@" * 5000 + "a." * 5000, "en", "s")]
    got = pii.private_data(make_docs(rows)).collect()
    assert len(got) == len(rows)
    texts = {r[0]: r[1] or "" for r in rows if r[0] != 20}
    for row in got:
        if row.doc_id in texts:
            assert [(s.kind, s.start, s.end) for s in row.spans if s.base] == [
                (pii.KINDS[k], a, b) for k, a, b in brute(texts[row.doc_id])]
    assert pii.private_data(make_docs([])).count() == 0
