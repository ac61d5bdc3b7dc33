import random
from collections import Counter

from millrace.llm import rules
from pyspark.sql import functions as F


def brute_repeated(words):
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    n = Counter(windows)
    return len({i + k for i, w in enumerate(windows) if n[w] > 1 for k in range(8)})


def test_measures():
    draw = random.Random(2)
    for _ in range(300):
        text = "".join(draw.choice("ab AB\n\t1é#|.") * draw.randint(1, 3) for _ in range(draw.randint(0, 80)))
        got = dict(zip(rules.MEASURES, rules.measure(text)))
        words = text.encode().split()
        lines = [x for x in text.split("\n") if x.encode().split()]
        assert got["n_words"] == len(words)
        assert got["word_chars"] == sum(len(w.decode()) for w in words)
        assert got["n_symbols"] == sum(text.count(c) for c in "#*$%&|<>")
        assert got["n_dup_lines"] == sum(x in lines[:i] for i, x in enumerate(lines))
        assert got["n_upper"] == text.count("A") + text.count("B") and got["n_digits"] == text.count("1")
    for _ in range(100):
        words = [draw.choice(["x", "y"]) for _ in range(draw.randint(0, 60))]
        assert rules.measure(" ".join(words))[4] == brute_repeated(words)


def test_ledger_policies_and_ablations(make_docs, odd_rows):
    clean = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60))
    rows = odd_rows + [(50, clean, "en", "s"), (51, clean.upper(), "en", "s"), (52, "same line of words\n" * 20, "en", "s")]
    entries = rules.ledger(make_docs(rows))
    bits = {r.doc_id: r.failed_bits for r in entries.collect()}
    assert bits[50] == 0 and bits[51] == rules.mask("capitals")
    assert bits[52] == rules.mask("repeated_words", "repeated_lines")
    assert bits[4] == bits[3] == rules.mask("few_words")
    for name, policy in rules.POLICIES.items():
        judged = entries.select("failed_bits", rules.passes(policy).alias("ok")).collect()
        found = {r.rule: r for r in rules.ablations(entries).where(F.col("policy") == name).collect()}
        for k, rule in enumerate(rules.RULES):
            if policy >> k & 1:
                assert found[rule].n_failed == sum(r.failed_bits >> k & 1 for r in judged)
                assert found[rule].n_only == sum(not r.ok and r.failed_bits & policy == 1 << k for r in judged)
    assert rules.ledger(make_docs([])).count() == 0
    assert {r.n_failed for r in rules.ablations(rules.ledger(make_docs([]))).collect()} == {0}
