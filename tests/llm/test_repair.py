import hashlib
import itertools
import random
import re
import time
import zlib

from millrace.llm import repair

LEGAL = re.compile(r"(s?(ua)+)?")
ROLES = ("user", "assistant", "system", "tool", "")


def brute(rows):
    """Cheapest (cost, audit, repaired lines) of rows (role, text, fault) over all edits with
    up to two inserted turns at each place."""
    gaps = [()] + [(a,) for a in "ua"] + list(itertools.product("ua", repeat=2))
    best = None
    choices = []
    for role, text, fault in rows:
        more = 3 if fault == "truncated" else 0
        edits = [(4, "D", None)]
        if fault not in ("blank", "duplicate"):
            edits += [(more, "K", (role, text)), (3 + more, "R", ("user", text)), (3 + more, "R", ("assistant", text))]
        choices.append(edits)
    for placed in itertools.product(gaps, repeat=len(rows) + 1):
        for edits in itertools.product(*choices):
            cost = 3 * sum(map(len, placed)) + sum(e[0] for e in edits)
            if best and cost > best[0]:
                continue
            turns, audit = [], ""
            for k, gap in enumerate(placed):
                audit += "I" * len(gap)
                turns += [(repair.ROLES[a], "") for a in gap]
                if k < len(edits):
                    audit += edits[k][1]
                    turns += [edits[k][2]] if edits[k][2] else []
            initials = "".join(t[0][:1] or "?" for t in turns)
            if LEGAL.fullmatch(initials) and (best is None or (cost, audit) < best[:2]):
                best = cost, audit, "\n".join(f"{r}:{t}" for r, t in turns)
    return best


def parsed(rows):
    found = repair.Repair()
    for role, text, fault in rows:
        found.read(role, text, role[:1], fault in ("blank", "duplicate"), fault == "truncated")
    return found.result()


def test_cheapest_edits():
    draw = random.Random(1)
    cases = [[]] + [[(draw.choice(ROLES), f"t{k}", draw.choice((None, None, "blank", "truncated")))
                     for k in range(draw.randint(1, 3))] for _ in range(60)]
    for rows in cases:
        cost, audit, lines = brute(rows)
        assert parsed(rows) == (cost, audit, hashlib.sha256(lines.encode()).hexdigest()), rows


def test_automaton():
    """The stacks that remain read exactly the words of the grammar."""
    for n in range(7):
        for word in itertools.product("sua", repeat=n):
            tops = [(0, None)]
            for name in word:
                tops = [t for top in tops for t in repair.AUTOMATON.shift(top, name)]
            assert any(map(repair.AUTOMATON.accepts, tops)) == bool(LEGAL.fullmatch("".join(word)))


def test_long_conversations_are_linear():
    draw = random.Random(2)
    rows = [(draw.choice(ROLES), "text", None) for _ in range(20_000)]
    start = time.perf_counter()
    cost, audit, _ = parsed(rows)
    assert time.perf_counter() - start < 60 and len(audit) >= len(rows)
    assert cost == sum({"D": 4, "I": 3, "R": 3, "K": 0}[c] for c in audit)


def plain_damage(rows):
    """Rows after damage, in order: (turn, role, text, fault)."""
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if v is None else v for v in (role, text))
        key = ":".join(" " if v is None else str(v) for v in (conv, turn))
        kind = zlib.crc32(key.encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        row = (turn, role, "user" if kind == 4 else role, text)
        out += [row] * (2 if kind == 3 else 1)
    out.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[3].encode()))
    seen, marked = set(), []
    for turn, _, role, text in out:
        solid = re.findall(r"[^\x20\x09-\x0D]", text)
        fault = "blank" if not solid else "duplicate" if (role, text) in seen else \
            "truncated" if solid[-1] not in ".!?" else None
        seen.add((role, text))
        marked.append((turn, role, text, fault))
    return marked


def plain(rows):
    marked = plain_damage(rows)
    turns = [r[0] for r in marked if r[0] is not None]
    count = lambda fault: sum(r[3] == fault for r in marked)
    initials = [r[1][:1] for r in marked]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return gaps, count("blank"), count("duplicate"), count("truncated"), illegal, *parsed([r[1:] for r in marked])


def test_tables(spark):
    draw = random.Random(4)
    texts = ["Well.", "yes", "no!  ", "", " \t\n", None, "Ünïcode? ", "a" * 40_000 + ".", "same.", "same."]
    rows = [(conv, draw.choice([None, *range(9)]), draw.choice([None, *ROLES, "user", "assistant"]), draw.choice(texts))
            for conv in [None, *range(60)] for _ in range(draw.randint(1, 9))]
    rows += rows[:20]
    schema = "conv_id bigint, turn bigint, role string, text string, audit string, fault string, gone string"
    found = repair.damage_and_repair(spark.createDataFrame([(*r, "x", "x", "x") for r in rows], schema).repartition(3))
    got = {r[0]: tuple(r[1:]) for r in found.collect()}
    assert found.columns == ["conv_id", *[c.split()[0] for c in repair.REPORT.split(", ")]]
    assert got == {conv: plain([r for r in rows if r[0] == conv]) for conv in {r[0] for r in rows}}
    assert repair.damage_and_repair(spark.createDataFrame([], schema)).count() == 0


def test_all_rows_dropped(spark):
    conv = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows = spark.createDataFrame([(conv, 0, "user", "a.")], "conv_id bigint, turn bigint, role string, text string")
    assert tuple(repair.damage_and_repair(rows).first()) == (
        conv, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_rows_are_dealt_once(spark):
    rows = spark.createDataFrame([(1, 0, "user", "a.")], "conv_id bigint, turn bigint, role string, text string")
    plan = repair.damage_and_repair(rows)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(conv_id") == 1 and plan.count("Exchange") == 1
