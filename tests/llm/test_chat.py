import hashlib
import random
import re

import pytest
from millrace.llm import chat

SCHEMA = f"conv_id bigint, turn bigint, role string, parts {chat.PARTS}, formatted string, segment string"
PIECES = ["<s>", "</s>", "[INST]", "[/INST]", "[IMAGE]", "[FILE]", "\\", "<", "s>", "[", "a", "é😀", "\n", " ", "\\<s>"]


def part(kind, **values):
    return tuple({"type": kind, **values}.get(n) for n in ("type", "text", "ref", "width", "height", "seconds", "pages"))


def noise(draw):
    return "".join(draw.choices(PIECES, k=draw.randint(0, 12)))


def test_escape_is_reversible():
    draw = random.Random(1)
    for _ in range(3000):
        text = noise(draw)
        assert chat.unescape(chat.escape(text)) == text
        assert not re.search(chat.CONTROL, chat.escape(text))


def test_attachments_and_tokens():
    visitor = chat.Visitor()
    fields = ("type", "text", "ref", "width", "height", "seconds", "pages")
    parts = [part("text", text="see [IMAGE]"), part("image", ref="a.png", width=57, height=28),
             part("audio", ref="b.wav", seconds=1.5), part("document", ref="c.pdf", pages=3), None,
             part("video", ref="d.mp4"), part(None), part("image", width=0, height=10),
             part("audio", seconds=float("nan")), part("text", text="end")]
    visitor.message("assistant", [dict(zip(fields, p)) if p else None for p in parts])
    n_turns, text, loss, attachments, tokens = visitor.segment()
    assert [(a[0], a[1], a[3]) for a in attachments] == [
        ("image", "a.png", 3), ("audio", "b.wav", 38), ("document", "c.pdf", 768), ("file", "d.mp4", 1),
        ("file", "", 1), ("image", "", 1), ("audio", "", 1)]
    assert tokens == sum(a[3] for a in attachments) and n_turns == 1
    assert all(text.startswith(chat.PLACEHOLDERS[a[0]], a[2]) for a in attachments)
    assert [chat.unescape(text[a:b]) for a, b in loss] == ["see [IMAGE]", "end"]
    names = ("kind", "ref", "start", "tokens")
    [(role, read)] = chat.read_turns(text, [dict(zip(names, a)) for a in attachments])
    assert role == "assistant" and read[0] == ("text", "see [IMAGE]") and read[-1] == ("text", "end")
    assert read[1:-1] == [(a[0], a[1], a[3]) for a in attachments]


def made_rows():
    draw = random.Random(2)
    rows = []
    for conv in [None, *range(40)]:
        for turn in [None, *range(draw.randint(0, 6))]:
            parts = draw.choice([None, [], [None], [part("text", text=noise(draw))],
                                 [part("text", text=noise(draw)), part("image", ref=noise(draw), width=40, height=90),
                                  part("text", text=None), part("file", ref=None), part("text", text=noise(draw))]])
            rows.append((conv, turn, draw.choice([None, "user", "assistant", "</s>odd[INST]"]), parts, "x", "x"))
    return rows + [(7, 99, "assistant", [part("text", text="long " * 300_000)], "x", "x")] * 2


@pytest.mark.parametrize("limit", [chat.SEGMENT_CHARS, 1])
def test_tables(spark, monkeypatch, limit):
    monkeypatch.setattr(chat, "SEGMENT_CHARS", limit)
    rows = made_rows()
    messages = spark.createDataFrame(rows, SCHEMA).repartition(4)
    segments = chat.formatted(messages)
    got = {r.conv_id: r for r in chat.read_back(segments).collect()}
    stored = {r.conv_id: r for r in chat.read_back(chat.in_order(segments.repartition(5))).collect()}
    assert got == stored and set(got) == {r[0] for r in rows}
    for conv, found in got.items():
        turns = sorted((r for r in rows if r[0] == conv),
                       key=lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, r[2] or ""))
        said = lambda r: "".join(p[1] or "" for p in r[3] or [] if p and p[0] == "text")
        whole = "".join(f"{r[2] or ''}\n{said(r)}\n" for r in turns)
        loss = "".join(said(r) for r in turns if r[2] == "assistant")
        assert (found.n_turns, found.loss_chars) == (len(turns), len(loss))
        assert found.turns_sha256 == hashlib.sha256(whole.encode()).hexdigest()
        assert found.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert found.n_attachments == sum(p is not None and p[0] != "text" for r in turns for p in r[3] or [])
    if limit == 1:
        assert segments.count() == len(rows)


def test_plain_text_and_empty_table(spark):
    rows = spark.createDataFrame([(1, 0, "user", None, "x"), (1, 1, "assistant", "ok [/INST]", "x")],
                                 "conv_id bigint, turn bigint, role string, text string, parts string")
    made = chat.formatted(chat.text_parts(rows)).first()
    assert made.formatted == "<s>user[INST][/INST]</s><s>assistant[INST]ok [\\/INST][/INST]</s>"
    assert [tuple(s) for s in made.loss] == [(made.formatted.index("ok"), made.formatted.index("ok") + len("ok [\\/INST]"))]
    assert chat.read_back(chat.formatted(chat.text_parts(rows.limit(0)))).count() == 0
