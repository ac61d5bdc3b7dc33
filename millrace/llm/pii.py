"""Personal data: fixed patterns, and a conditional random field for what they miss.

The base patterns give e-mail addresses, IP addresses, card and phone numbers
exactly as specified.  A linear-chain conditional random field over word shapes
then reads the surroundings of every word with a digit, an `@` or a spelled-out
"(at)" or "dot", and adds spans such as a phone number without a leading plus.  It is trained on a small labelled table; decoding is Viterbi over batches
of windows that advance together, one word a step.

A window reaches `REACH` words to both sides; words further away are never
personal data.  Added spans never touch a base span and must pass the checks of
their kind (`_holds`), so the model can only add what is plausible.

Defined results: a null text is empty and has no spans; positions count code
points, ends are exclusive; repeated rows are searched one by one; an empty table
gives no rows; columns other than id and text are ignored.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from millrace.llm.common import WORD, small_batches

KINDS = ("email", "ip", "card", "phone")
LABELS = ("other", *KINDS)
REACH = 6
#: Words decoded together, with the padding; a longer window is decoded alone.
CELLS = 1 << 19
RIDGE = 0.02
STEPS = 150
#: Longest word whose scores are remembered.
MEMO_CHARS = 64

# The base patterns; every run is taken whole, so they need no retries.
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

TOKEN = re.compile(WORD)
#: What may belong to personal data: a digit, an at sign or its name in brackets, "dot" as a
#: word, and "at" before a word with a dot inside.
MARKED = re.compile(r"[0-9@]|[(\[{<]at[)\]}>]|\bdot\b|\bat\b(?=[)\]}>]?\s+\S*\.[a-z])", re.I)
#: Written names of the signs, alone or in brackets, and inside a word only in brackets.
NAMED = re.compile(r"[(\[{<]?(at|dot)[)\]}>]?", re.I)
INSIDE = re.compile(r"[(\[{<](at|dot)[)\]}>]", re.I)
DIGITS = re.compile(r"[0-9]")

Span = tuple[int, int, int]  # kind, start, end


def emails(text: str) -> Iterator[tuple[int, int]]:
    free = 0
    at = text.find("@")
    while at >= 0:
        left = text[free:at]
        start = free + len(left.rstrip(LOCAL))
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            free = found.end()
            at = text.find("@", free)
        else:
            free = at + 1
            at = text.find("@", free)


def luhn(digits: str) -> bool:
    values = [int(d) for d in reversed(digits)]
    doubled = [sum(divmod(2 * v, 10)) for v in values[1::2]]
    return (sum(values[::2]) + sum(doubled)) % 10 == 0


def is_ip(parts: list[str]) -> bool:
    return len(parts) == 4 and all(
        p.isdigit() and len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in parts)


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns, by start and kind."""
    found = [(0, *span) for span in emails(text)]
    if DIGITS.search(text):
        found += [(1, *m.span()) for m in IP.finditer(text) if is_ip(m[0].split("."))]
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((2, *m.span()))
        found += [(3, *m.span()) for m in PHONE.finditer(text)
                  if 9 <= len(DIGITS.findall(m[0])) <= 15]
    return sorted(found, key=lambda s: (s[1], s[0]))


# --- the model ----------------------------------------------------------------

def signs(word: str) -> str:
    """The word with names of signs in brackets as the signs: `jane[at]mail(dot)org`."""
    return INSIDE.sub(lambda m: "@" if m[1].lower() == "at" else ".", word) if len(word) > 5 else word


def shape(word: str) -> str:
    """The word with letters as x, digits as d, at most three of a kind in a row."""
    if named := NAMED.fullmatch(word):
        return named[1].lower() if len(named[0]) == len(named[1]) else f"[{named[1].lower()}]"
    plain = re.sub(r"[0-9]", "d", re.sub(r"[^\W\d_]", "x", signs(word)))
    return re.sub(r"(.)\1{3,}", r"\1\1\1", plain)


def shape_features(word: str) -> list[str]:
    """Features of the whole word, however long."""
    plain, s = signs(word), shape(word)
    return [f"shape={s}", f"digits={min(len(DIGITS.findall(word)), 20)}", f"dots={min(plain.count('.'), 4)}",
            f"at={'@' in plain}", f"plus={word[:1] == '+'}", f"ends={s[:1]}{s[-1:]}",
            f"letters={any(c.isalpha() for c in word)}"]


@dataclass
class Field:
    """Weights of features by label, for the word itself and its neighbours, and of label pairs."""
    weights: dict[str, np.ndarray]
    pairs: np.ndarray
    memo: dict[str, np.ndarray] = field(default_factory=dict)

    def scores(self, word: str) -> np.ndarray:
        """Label scores that a word gives itself, its successor and its predecessor."""
        found = self.memo.get(word)
        if found is None:
            if len(self.memo) > 100_000:
                self.memo.clear()
            found = np.zeros((3, len(LABELS)))
            for f in shape_features(word):
                for side in range(3):
                    w = self.weights.get(f"{side}:{f}")
                    if w is not None:
                        found[side] += w
            if len(word) <= MEMO_CHARS:
                self.memo[word] = found
        return found

    def emissions(self, words: list[str]) -> np.ndarray:
        table = np.array([self.scores(w) for w in words])
        out = table[:, 0].copy()
        out[1:] += table[:-1, 1]
        out[:-1] += table[1:, 2]
        return out


def viterbi(emissions: list[np.ndarray], pairs: np.ndarray) -> list[np.ndarray]:
    """Best labels of each sequence; all sequences advance together, longest first."""
    order = sorted(range(len(emissions)), key=lambda i: -len(emissions[i]))
    sizes = np.array([len(emissions[i]) for i in order])
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(emissions)
    if not len(order) or not sizes[0]:
        return out
    padded = np.zeros((sizes[0], len(order), len(LABELS)))
    for lane, i in enumerate(order):
        padded[:sizes[lane], lane] = emissions[i]
    score, came = padded[0], np.zeros(padded.shape, np.int8)
    for step in range(1, sizes[0]):
        live = int((sizes > step).sum())
        paths = score[:live, :, None] + pairs
        came[step, :live] = paths.argmax(axis=1)
        score[:live] = paths.max(axis=1) + padded[step, :live]
    best = score.argmax(axis=1)
    lanes = np.arange(len(order))
    labels = np.zeros((sizes[0], len(order)), np.int64)
    at = best
    for step in range(sizes[0] - 1, -1, -1):
        inside = sizes > step
        labels[step] = np.where(inside, at, 0)
        at = np.where(inside & (step > 0), came[step, lanes, at], at)
    for lane, i in enumerate(order):
        out[i] = labels[:sizes[lane], lane]
    return out


def labelled_table(rows: int = 400, seed: int = 11) -> list[tuple[list[str], list[int]]]:
    """The small labelled table: sentences with personal data in many spellings, and with
    numbers that are none, made from templates by a seeded draw."""
    draw = np.random.default_rng(seed)
    pick = lambda options: options[int(draw.integers(len(options)))]
    number = lambda n: "".join(str(int(d)) for d in draw.integers(0, 10, n))
    letters = lambda n: "".join(chr(97 + int(c)) for c in draw.integers(0, 26, n))
    name = lambda: letters(int(draw.integers(2, 8)))
    host = lambda: pick([f"{name()}.{pick(['com', 'org', 'net', 'de'])}",
                         f"mail{number(1)}.{name()}.com", f"{name()}.{name()}.com"])
    octets = lambda: [str(int(o)) for o in draw.integers(1, 255, 4)]
    private = [
        (1, lambda: f"{name()}.{number(2)}@{host()}"), (1, lambda: f"{name()}@{host()}"),
        (1, lambda: f"{name()} at {name()} dot com"), (1, lambda: f"{name()} (at) {host()}"),
        (1, lambda: f"{name()}[at]{host()}"), (1, lambda: f"{name()} @ {host()}"),
        (1, lambda: f"{name()} at {host()}"), (1, lambda: f"{name()} [at] {host()}"),
        (1, lambda: f"{name()} {pick(['at', '(at)', '[at]', '{at}'])} {name()} {pick(['dot', '(dot)', '[dot]'])} com"),
        (1, lambda: f"{name()} at {name()} dot com".upper()), (1, lambda: f"{name()} (at) {host()}".upper()),
        (1, lambda: f"{name()}(at){host()}"), (1, lambda: f"{name()}(at){name()}(dot)org"),
        (2, lambda: ".".join(octets())), (2, lambda: ".".join(octets()) + ":" + number(4)),
        (3, lambda: number(16)), (3, lambda: " ".join(number(4) for _ in range(4))),
        (3, lambda: ".".join(number(4) for _ in range(4))), (3, lambda: number(15)),
        (4, lambda: f"+{number(1)} ({number(3)}) {number(3)}-{number(4)}"),
        (4, lambda: f"({number(3)}) {number(3)}-{number(4)}"),
        (4, lambda: f"{number(3)}-{number(3)}-{number(4)}"),
        (4, lambda: f"00{number(2)} {number(3)} {number(7)}"),
        (4, lambda: f"{number(3)}.{number(3)}.{number(4)}")]
    harmless = [
        lambda: f"password={letters(3)}{number(9)}", lambda: f'"{number(5)}{letters(2)}{number(14)}"',
        lambda: f"{number(4)}-{number(2)}-{number(2)}", lambda: f"{number(2)}:{number(2)}",
        lambda: f"{number(1)}.{number(2)}", lambda: f"{number(1)},{number(3)}.{number(2)}",
        lambda: f"v{number(1)}.{number(1)}.{number(1)}", lambda: number(int(draw.integers(1, 7))),
        lambda: f"{name()}{number(2)}", lambda: f"@{name()}", lambda: f"#{number(4)}",
        lambda: f"{number(3)}%", lambda: f"({number(4)})", lambda: f"AKIA{letters(8).upper()}{number(3)}",
        lambda: f"{name()} at {name()}", lambda: f"${number(3)}", lambda: f"{number(10)}{letters(1)}"]
    table = []
    for _ in range(rows):
        words: list[str] = []
        labels: list[int] = []
        for _ in range(int(draw.integers(1, 4))):
            filler = [name() + pick(["", "", "", ".", ","]) for _ in range(int(draw.integers(1, 6)))]
            label, made = pick(private) if draw.random() < 0.5 else (0, pick(harmless))
            piece = made().split()
            tail = pick(["", "", ".", ","])
            piece[-1] += tail
            words += filler + piece
            labels += [0] * len(filler) + [label] * len(piece)
        table.append((words, labels))
    return table


def fit(table: list[tuple[list[str], list[int]]]) -> Field:
    """Weights that maximise the conditional likelihood of the labels, less a ridge."""
    seen: dict[str, int] = {}
    rows: list[list[list[int]]] = []
    for words, _ in table:
        own = [shape_features(w) for w in words]
        row = []
        for t in range(len(words)):
            near = [f"0:{f}" for f in own[t]]
            near += [f"1:{f}" for f in own[t - 1]] if t else []
            near += [f"2:{f}" for f in own[t + 1]] if t + 1 < len(words) else []
            row.append([seen.setdefault(f, len(seen)) for f in near])
        rows.append(row)
    n, longest, k = len(table), max(len(w) for w, _ in table), len(LABELS)
    sizes = np.array([len(w) for w, _ in table])
    marks = np.zeros((longest, n, len(seen)), np.float32)
    for s, row in enumerate(rows):
        for t, found in enumerate(row):
            marks[t, s, found] = 1
    marks = marks.reshape(longest * n, -1)
    truth = np.zeros((longest, n), np.int64)
    for s, (_, labels) in enumerate(table):
        truth[:len(labels), s] = labels
    inside = np.arange(longest)[:, None] < sizes
    gold = np.eye(k)[truth] * inside[:, :, None]
    gold_pairs = np.einsum("tni,tnj->ij", gold[:-1], gold[1:])
    w, pairs = np.zeros((len(seen), k)), np.zeros((k, k))
    mean, square = [np.zeros_like(w), np.zeros_like(pairs)], [np.zeros_like(w), np.zeros_like(pairs)]
    for step in range(1, STEPS + 1):
        scores = (marks @ w.astype(np.float32)).astype(np.float64).reshape(longest, n, k)
        share, pair_share = _marginals(scores, pairs, sizes)
        grad = marks.T @ (gold - share).reshape(longest * n, k).astype(np.float32)
        gradients = [grad / n - RIDGE / n * w, (gold_pairs - pair_share) / n - RIDGE / n * pairs]
        for v, g, m, q in zip((w, pairs), gradients, mean, square):  # adaptive steps
            m *= 0.9
            m += 0.1 * g
            q *= 0.99
            q += 0.01 * g * g
            v += 0.1 * m / (1 - 0.9 ** step) / (np.sqrt(q / (1 - 0.99 ** step)) + 1e-8)
    return Field({f: w[i] for f, i in seen.items()}, pairs)


def _marginals(scores: np.ndarray, pairs: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Label shares of every word and summed shares of label pairs (forward-backward)."""
    longest, n, k = scores.shape
    ahead, back = np.zeros_like(scores), np.zeros_like(scores)
    total = lambda x, axis: np.log(np.exp(x - x.max(axis, keepdims=True)).sum(axis)) + x.max(axis)
    ahead[0] = scores[0]
    for t in range(1, longest):
        ahead[t] = total(ahead[t - 1][:, :, None] + pairs, 1) + scores[t]
    for t in range(longest - 2, -1, -1):
        going = (sizes > t + 1)[:, None]
        step = total(pairs + (scores[t + 1] + back[t + 1])[:, None, :], 2)
        back[t] = np.where(going, step, 0.0)
    norm = total(ahead[sizes - 1, np.arange(n)], 1)
    inside = (np.arange(longest)[:, None] < sizes)[:, :, None]
    share = np.exp(np.where(inside, ahead + back - norm[:, None], -np.inf))
    pair = np.zeros((k, k))
    for t in range(longest - 1):
        on = sizes > t + 1
        joint = ahead[t][:, :, None] + pairs + (scores[t + 1] + back[t + 1])[:, None, :]
        pair += np.exp(joint[on] - norm[on, None, None]).sum(axis=0)
    return share, pair


@functools.cache
def model() -> Field:
    """The production model, trained once on the driver and sent to the tasks."""
    return fit(labelled_table())


# --- spans ----------------------------------------------------------------------

def windows(text: str, words: list[re.Match]) -> list[tuple[int, int]]:
    """Ranges of words around those that may belong to personal data."""
    out: list[list[int]] = []
    i = 0
    for mark in MARKED.finditer(text):
        while i < len(words) and words[i].end() <= mark.start():
            i += 1
        if i < len(words) and words[i].start() < mark.end():
            low, high = max(0, i - REACH), min(len(words), i + REACH + 1)
            if out and low <= out[-1][1]:
                out[-1][1] = high
            else:
                out.append([low, high])
    return [(low, high) for low, high in out]


def _holds(kind: int, value: str) -> bool:
    digits = "".join(DIGITS.findall(value))
    if kind == 0:
        return re.search(r"@|\bat\b", value, re.I) is not None and \
            re.search(r"\.[a-z]|\bdot\b", value, re.I) is not None and len(value) <= 254
    if kind == 1:
        return is_ip(value.split(":")[0].split("."))
    if kind == 2:
        return 12 <= len(digits) <= 19 and luhn(digits)
    return 7 <= len(digits) <= 15 and not re.search(r"[^\W\d_]", value)


def _runs(text: str, words: list[re.Match], labels: np.ndarray, base: list[Span]) -> list[Span]:
    """Runs of one label as spans, without what stands around them."""
    found = []
    at = 0
    while at < len(words):
        end = at + 1
        while end < len(words) and labels[end] == labels[at]:
            end += 1
        if labels[at]:
            kind, start, stop = int(labels[at]) - 1, words[at].start(), words[end - 1].end()
            value = text[start:stop]
            start += len(value) - len(value.lstrip("\"'<[{*#%$&|"))
            stop -= len(value) - len(value.rstrip("\"'>]}.,;:!?*#%$&|"))
            if start < stop and _holds(kind, text[start:stop]) and \
                    not any(s < stop and start < e for _, s, e in base):
                found.append((kind, start, stop))
        at = end
    return found


def _batched(jobs: list[tuple[int, list[re.Match]]]) -> Iterator[list[tuple[int, list[re.Match]]]]:
    """Windows, longest first, in batches that take at most `CELLS` words padded to the longest."""
    jobs.sort(key=lambda job: -len(job[1]))
    low = 0
    while low < len(jobs):
        high = low + max(1, CELLS // len(jobs[low][1]))
        yield jobs[low:high]
        low = high


def find(texts: list[str], trained: Field) -> list[list[tuple[str, int, int, bool]]]:
    """`(kind, start, end, base)` of every text, by start and kind."""
    out, jobs = [], []
    for i, text in enumerate(texts):
        base = base_spans(text)
        out.append(base)
        if MARKED.search(text):
            words = list(TOKEN.finditer(text))
            jobs += [(i, words[low:high]) for low, high in windows(text, words)]
    added: dict[int, list[Span]] = {}
    for part in _batched(jobs):
        labels = viterbi([trained.emissions([w[0] for w in words]) for _, words in part], trained.pairs)
        for (i, words), best in zip(part, labels):
            if best.any():
                near = [s for s in out[i] if s[1] < words[-1].end() and s[2] > words[0].start()]
                added.setdefault(i, []).extend(_runs(texts[i], words, best, near))
    done = []
    for i, base in enumerate(out):
        spans = [(*s, True) for s in base] + [(*s, False) for s in added.get(i, [])]
        spans.sort(key=lambda s: (s[1], s[0]))
        done.append([(KINDS[k], s, e, b) for k, s, e, b in spans])
    return done


SPANS = "array<struct<kind:string,start:bigint,end:bigint,base:boolean>>"
_ARROW_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()),
                                   ("end", pa.int64()), ("base", pa.bool_())]))


def private_data(docs: DataFrame) -> DataFrame:
    """`(doc_id, spans)` of every row."""
    small_batches(docs.sparkSession)
    rows = docs.select("doc_id", "text")
    sent = docs.sparkSession.sparkContext.broadcast(model())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = find([t or "" for t in batch.column("text").to_pylist()], sent.value)
            listed = [[dict(zip(("kind", "start", "end", "base"), s)) for s in row] for row in spans]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(listed, _ARROW_SPANS)], ["doc_id", "spans"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, spans {SPANS}")
