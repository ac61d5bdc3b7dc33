"""Encoding and decoding with a word-level pair vocabulary, through a trie of prefixes.

In pair encoding the last token of a prefix says everything about it: the
encoding of a prefix is the encoding of what stands before its last token, plus
that token.  And a token fits behind another one exactly when encoding the two
together gives the two back.  So each trie node needs one state, its last token,
found among the tokens that end there.  The distinct words of a batch are
inserted in sorted order, which is the depth-first order of their trie: the
states on the path to the current word stand on a stack, and a prefix that many
words share is computed once.

Defined results: a null text is empty and has no tokens; the special strings in
a text become their ids; repeated rows are encoded one by one; an empty table
gives no rows; columns other than id and text are ignored.
"""

from __future__ import annotations

import functools
import itertools
import json
import struct
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from millrace.llm.common import small_batches

#: Words and pairs that a task remembers; beyond it the memory starts anew.
MEMO_WORDS = 150_000
MEMO_PAIRS = 150_000
#: Text that is cut into words at a time: the words of a text take many times its bytes.
SLICE_BYTES = 1 << 21


def byte_symbols() -> list[str]:
    """Printable stand-in of each byte, as public byte-level vocabularies define it."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    shifted = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(shifted)) for b in range(256)]


def _is_latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class TrieEncoder:
    """Encodes and decodes texts with the vocabulary file given as JSON text."""

    def __init__(self, vocabulary: str):
        spec = json.loads(vocabulary)
        self.ids: dict[str, int] = spec["model"]["vocab"]
        self.end = spec["model"]["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        # Plain `\s` also takes U+001C..U+001F, the property does not.
        self.pieces = regex.compile(split.replace(r"\s", r"\p{White_Space}"))
        self.marks = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") \
            if self.special else None
        self.symbols = byte_symbols()
        # Merge rank of a pair of ids, and the pair each token was made from.
        self.rank: dict[tuple[int, int], int] = {}
        self.made_of: dict[int, tuple[int, int, int]] = {}
        for rank, (left, right) in enumerate(spec["model"]["merges"]):
            a, b, made = self.ids[left], self.ids[right], self.ids[left + right]
            self.rank[a, b] = rank
            self.made_of.setdefault(made, (a, b, rank))
        sound = {t for t in self.ids.values()
                 if t not in self.made_of or self._fits(*self.made_of[t])}
        body = {t: i for t, i in self.ids.items() if i in sound and not t.endswith(self.end)}
        last = {t[:-len(self.end)]: i for t, i in self.ids.items()
                if i in sound and t.endswith(self.end)}
        self.inner, self.final = body, last
        # By the last three symbols: the longest token that ends in them.
        self.reach_inner, self.reach_final = self._reach(body), self._reach(last)
        self.words: dict[str | int, bytes] = {}
        self.fit: dict[int, bool] = {}

    @staticmethod
    def _reach(tokens: dict[str, int]) -> dict[str, int]:
        reach: dict[str, int] = {}
        for token in tokens:
            if len(token) > 2:
                reach[token[-3:]] = max(len(token), reach.get(token[-3:], 0))
        return reach

    def _fits(self, left: int, right: int, before: float = float("inf")) -> bool:
        """Whether no merge ranked under `before` crosses from `left` into `right`.

        Merges are undone on both sides, down to the symbols that meet at the
        boundary, and replayed by rank: a crossing pair merges if its turn comes
        before either of its symbols is taken into a larger one.
        """
        rights = self._spine(left, 1)
        lefts = self._spine(right, 0)
        i = j = 0
        while True:
            take_left = rights[i][1]
            take_right = lefts[j][1]
            cross = self.rank.get((rights[i][0], lefts[j][0]), before)
            # Of equal ranks the leftmost pair merges first.
            if cross < before and cross < take_left and cross <= take_right:
                return False
            if take_left == take_right == float("inf"):
                return True
            if take_left <= take_right:
                i += 1
            else:
                j += 1

    def _spine(self, token: int, side: int) -> list[tuple[int, float]]:
        """Tokens at one edge of `token` as merging builds it, each with the rank
        of the merge that takes it."""
        path: list[tuple[int, float]] = [(token, float("inf"))]
        while token in self.made_of:
            made = self.made_of[token]
            token = made[side]
            path.append((token, made[2]))
        return path[::-1]

    def _follows(self, left: int, right: int) -> bool:
        if len(self.fit) > MEMO_PAIRS:
            self.fit.clear()
        known = self.fit[left << 32 | right] = self._fits(left, right)
        return known

    def encode_words(self, words: list[str]) -> dict[str, tuple[int, ...]]:
        """Encodings of distinct words (byte symbols), by one walk over their trie."""
        out: dict[str, tuple[int, ...]] = {}
        last: list[int] = [-1]  # at each depth of the current path: its last token,
        back: list[int] = [-1]  # and the depth before that token
        inner, final, fit = self.inner.get, self.final.get, self.fit.get
        reach_inner, reach_final = self.reach_inner.get, self.reach_final.get
        previous = ""
        for word in sorted(words):
            size, shared = len(word), 0
            for a, b in zip(previous, word):
                if a != b:
                    break
                shared += 1
            del last[shared + 1:], back[shared + 1:]
            previous = word
            for depth in range(len(last), size + 1):
                find, reach = (inner, reach_inner) if depth < size else (final, reach_final)
                first = depth - reach(word[depth - 3:depth], 2) if depth > 2 else 0
                for start in range(first if first > 0 else 0, depth):
                    token = find(word[start:depth])
                    if token is None:
                        continue
                    if not start:
                        break
                    fits = fit(last[start] << 32 | token)
                    if fits or fits is None and self._follows(last[start], token):
                        break
                else:
                    raise ValueError(f"no token of the vocabulary ends {word[:depth]!r}")
                if depth < size:
                    last.append(token)
                    back.append(start)
            ids = [token]
            while start:
                ids.append(last[start])
                start = back[start]
            ids.reverse()
            out[word] = tuple(ids)
        return out

    def _split(self, text: str) -> list[str | int]:
        """Words of a text, and the ids of special strings between them."""
        found: list[str | int] = []
        parts = self.marks.split(text) if self.marks else [text]
        for part in parts:
            if part in self.special:
                found.append(self.special[part])
                continue
            # White space only parts words, so its runs need no rewriting.
            part = unicodedata.normalize("NFC", part)
            # One letter at a time: a sigma at a word's end is no special case.
            part = part.replace("Σ", "σ").lower()
            plain = part if _is_latin(part) else self._newer.sub("\uE000", part)
            found += self.pieces.findall(part) if plain == part else \
                [part[m.start():m.end()] for m in self.pieces.finditer(plain)]
        return found

    @functools.cached_property
    def _newer(self) -> regex.Pattern:
        """Letters and digits that came with later versions of Unicode than
        `unicodedata` has; vocabularies take them as unassigned."""
        points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
        known = [c for c in points if regex.match(r"[\p{L}\p{N}]", c)
                 and unicodedata.category(c)[0] not in "LN"]
        return regex.compile("[" + "".join(map(regex.escape, known)) + "]")

    def packed(self, texts: list[str]) -> list[bytes]:
        """Token ids of each text, as little-endian 32-bit integers."""
        split = [self._split(text) for text in texts]
        if len(self.words) > MEMO_WORDS:
            self.words.clear()
        words = self.words
        new = [w for w in set(itertools.chain.from_iterable(split)) if w not in words]
        symbols = {w: w if w.isascii() and w.isprintable() and " " not in w else
                   "".join([self.symbols[b] for b in w.encode()]) for w in new if type(w) is str}
        made = {s: struct.pack(f"<{len(ids)}I", *ids)
                for s, ids in self.encode_words(list(set(symbols.values()))).items()}
        words.update((w, made[symbols[w]] if type(w) is str else struct.pack("<I", w)) for w in new)
        return [b"".join(map(words.__getitem__, pieces)) for pieces in split]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Token ids of each text."""
        return [np.frombuffer(ids, "<u4") for ids in self.packed(texts)]

    def forget(self) -> None:
        self.words.clear()


def slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch with at most `SLICE_BYTES` in a column; a longer row
    is alone."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start = held = 0
    for k, size in enumerate(sizes.tolist()):
        if held and held + size > SLICE_BYTES:
            yield batch.slice(start, k - start)
            start, held = k, 0
        held += size
    if len(batch) > start:
        yield batch.slice(start)


def decoded(packed: list[bytes], names: pa.Array) -> pa.Array:
    """Texts of packed ids: tokens joined by spaces, as this vocabulary (without a decoder)
    decodes."""
    ids = np.frombuffer(b"".join(packed), "<u4")
    ends = np.cumsum([0, *(len(p) // 4 for p in packed)])
    tokens = names.take(pa.array(ids.astype(np.int32)))
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), tokens), " ")


@functools.lru_cache(maxsize=2)
def token_texts(vocabulary: str) -> list[str]:
    """Text of each id: all that decoding needs."""
    spec = json.loads(vocabulary)
    found = spec["model"]["vocab"] | {t["content"]: t["id"] for t in spec["added_tokens"]}
    return sorted(found, key=found.get)


@functools.lru_cache(maxsize=2)
def token_array(vocabulary: str) -> pa.Array:
    return pa.array(token_texts(vocabulary), pa.string())


@functools.lru_cache(maxsize=2)
def encoder(vocabulary: str) -> TrieEncoder:
    return TrieEncoder(vocabulary)


def read_vocabulary(path: str) -> str:
    """The vocabulary file as text; it is read once, on the driver, and sent to the tasks."""
    with open(path, encoding="utf-8") as file:
        return file.read()


def _mapped(rows: DataFrame, vocabulary: str, column: str, schema: str, function) -> DataFrame:
    """`rows` through `function(vocabulary, part) -> part`, one bounded part at a time."""
    small_batches(rows.sparkSession)
    sent = rows.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, column):
                yield function(sent.value, part)
        encoder(sent.value).forget()  # workers are reused: no words are kept for the next task

    return rows.mapInArrow(run, schema)


def _with_ids(vocabulary: str, part: pa.RecordBatch) -> tuple[list[bytes], list[pa.Array]]:
    packed = encoder(vocabulary).packed([t or "" for t in part.column("text").to_pylist()])
    return packed, [part.column("doc_id"), pa.array([len(i) // 4 for i in packed], pa.int64()),
                    pa.array(packed, pa.binary())]


def encode(docs: DataFrame, vocabulary: str) -> DataFrame:
    """`(doc_id, n_tokens, ids)`; ids are packed as little-endian 32-bit integers."""
    rows = docs.select("doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return _mapped(rows, vocabulary, "text", f"doc_id {kind}, n_tokens bigint, ids binary",
                   lambda words, part: pa.RecordBatch.from_arrays(
                       _with_ids(words, part)[1], ["doc_id", "n_tokens", "ids"]))


def decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """`encoded(doc_id, n_tokens, ids)` with the decoded `text`."""
    rows = encoded.select("doc_id", "n_tokens", "ids")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return _mapped(rows, vocabulary, "ids", f"doc_id {kind}, n_tokens bigint, ids binary, text string",
                   lambda words, part: pa.RecordBatch.from_arrays(
                       [*part.columns, decoded(part.column("ids").to_pylist(), token_array(words))],
                       ["doc_id", "n_tokens", "ids", "text"]))


def round_trip(docs: DataFrame, vocabulary: str) -> DataFrame:
    """`decode(encode(docs))` in one step, so that a task has one Python worker."""
    rows = docs.select("doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()

    def both(words: str, part: pa.RecordBatch) -> pa.RecordBatch:
        packed, columns = _with_ids(words, part)
        return pa.RecordBatch.from_arrays([*columns, decoded(packed, token_array(words))],
                                          ["doc_id", "n_tokens", "ids", "text"])

    return _mapped(rows, vocabulary, "text",
                   f"doc_id {kind}, n_tokens bigint, ids binary, text string", both)
