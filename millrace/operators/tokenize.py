"""Byte-level pair tokenizer: pre-token counts, training, encoding, decoding.

Ids: 0 is the end marker, 1-256 are the bytes in the order of their display
characters, merges follow from 257.  Of two pairs with the same count, the one
with the smaller (left id, right id) is merged first.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from millrace.session import shared_folder, written

# Fixed values.
END_MARKER = "<|endoftext|>"
END_ID = 0
PRE_TOKEN = (r"(?U)'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+"
             r"|\s+(?!\S)|\s+")
SHOWN_BYTES = [range(33, 127), range(161, 173), range(174, 256)]
FIRST_MERGE = 257

TENTATIVE = 256
#: Pairs whose neighbours a round looks at; more of them cost reading, fewer cost rounds.
GUESSED = 64
#: Pairs with an index at a time, at most and at least, and bytes of a row group of the index.
#: Few pairs leave short parts of words and so few distinct ones; more of them save indexes.
CANDIDATES = 8192
FEW_CANDIDATES = 64
INDEX_GROUP = 1 << 20
MEMO_WORDS = 500_000
_NONE = np.iinfo(np.int64).max
_WORK = "ids array<int>, n bigint"


def byte_display() -> list[str]:
    """The character that stands for each byte; bytes without a printable
    character get the code points from 256 on."""
    shown = {b for part in SHOWN_BYTES for b in part}
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


def byte_ids() -> np.ndarray:
    """Byte value to token id."""
    display = byte_display()
    ids = np.zeros(256, dtype=np.int64)
    ids[sorted(range(256), key=display.__getitem__)] = np.arange(1, 257)
    return ids


# --- pre-tokens -------------------------------------------------------------

def pre_tokens(text: Column, parse_special: bool = False) -> Column:
    """Words, numbers, signs and spaces of a text.  With `parse_special` the end
    marker is one piece of its own; otherwise it is ordinary text."""
    cut = lambda t: F.regexp_extract_all(t, F.lit(PRE_TOKEN), F.lit(0))
    if not parse_special:
        return cut(text)
    parts = F.split(text, r"<\|endoftext\|>")
    marked = F.flatten(F.transform(parts, lambda p: F.concat(cut(p), F.array(F.lit(END_MARKER)))))
    return F.slice(marked, F.lit(1), F.size(marked) - 1)


def pre_token_counts(docs: DataFrame, column: str = "text") -> DataFrame:
    """`(word, n)`.  Counts are summed before the shuffle, so common words are
    no hot keys."""
    return (docs.select(F.explode(pre_tokens(F.col(column))).alias("word"))
            .groupBy("word").agg(F.count("*").alias("n")))


# --- arrays of symbols ------------------------------------------------------

def _symbols(words: pa.Array, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte symbols of all words in one array, and the word each belongs to."""
    lists = words.cast(pa.large_binary())
    offsets = np.frombuffer(lists.buffers()[1], np.int64)[lists.offset:lists.offset + len(lists) + 1]
    data = lists.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    sizes = np.diff(offsets)
    return table[raw[offsets[0]:offsets[-1]]], np.repeat(np.arange(len(words)), sizes)


def _pairs(flat: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Key of each neighbouring pair, and whether both are in one word."""
    return (flat[:-1] << 32) | flat[1:], word[:-1] == word[1:]


def _find(keys: np.ndarray, sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return at, sorted_keys[at] == keys


def _join(flat: np.ndarray, word: np.ndarray, hit: np.ndarray, new: np.ndarray):
    """Replace each hit pair by its new symbol.  Of overlapping hits (a symbol
    paired with itself) every other one counts, from the left."""
    at = np.flatnonzero(hit)
    fresh = np.r_[True, np.diff(at) > 1]
    start = at[fresh][np.cumsum(fresh) - 1]
    at = at[(at - start) % 2 == 0]
    flat = flat.copy()
    flat[at] = new[at]
    keep = np.ones(len(flat), bool)
    keep[at + 1] = False
    return flat[keep], word[keep]


# --- training ---------------------------------------------------------------

def _ranked(rows: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pair keys in order, with the rank and the new id of each."""
    keys = np.array([(m.left_id << 32) | m.right_id for m in rows] or [-1], np.int64)
    order = np.argsort(keys)
    rank = np.array([m.rank for m in rows] or [0], np.int64)
    new = np.array([m.new_id for m in rows] or [0], np.int64)
    return keys[order], rank[order], new[order]


def _merge_words(flat: np.ndarray, word: np.ndarray, n_words: int, merges: tuple):
    """Symbols after all merges, by word: in each pass every word takes its best merge."""
    pair_keys, ranks, new_ids = merges
    done_flat, done_word = [], []
    while len(flat) > 1:
        keys, same = _pairs(flat, word)
        at, found = _find(keys, pair_keys)
        rank = np.where(found & same, ranks[at], _NONE)
        best = np.full(n_words, _NONE)
        np.minimum.at(best, word[:-1], rank)
        going = best[word] < _NONE
        if not going.all():
            done_flat.append(flat[~going])
            done_word.append(word[~going])
        hit = (rank < _NONE) & (rank == best[word[:-1]])
        if not hit.any():
            flat, word = flat[:0], word[:0]
            break
        # Finished words leave; a pair that spans words is never a hit.
        new = np.r_[new_ids[at], 0][going]
        flat, word, hit = flat[going], word[going], np.r_[hit, False][going][:-1]
        flat, word = _join(flat, word, hit, new)
    flat = np.concatenate([*done_flat, flat])
    word = np.concatenate([*done_word, word])
    order = np.argsort(word, kind="stable")
    return flat[order], word[order]


def _unpack(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all words of a batch, and the word each belongs to."""
    ids = batch["ids"]
    sizes = pc.list_value_length(ids).to_numpy(zero_copy_only=False)
    return (ids.flatten().to_numpy(zero_copy_only=False).astype(np.int64),
            np.repeat(np.arange(len(ids)), sizes))


def _summed(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    unique, at = np.unique(keys, return_inverse=True)
    sums = np.zeros(len(unique), np.int64)
    np.add.at(sums, at, weights)
    return unique, sums


def _counted(flat: np.ndarray, word: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys, same = _pairs(flat, word)
    return _summed(keys[same], n[word[:-1][same]])


def _merged(work: DataFrame, merges: tuple) -> DataFrame:
    """The table of words after some merges, without words of one symbol."""
    def run(batches):
        for batch in batches:
            flat, word = _merge_words(*_unpack(batch), len(batch), merges)
            sizes = np.bincount(word, minlength=len(batch))
            offsets = np.r_[0, np.cumsum(sizes)].astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([lists, batch["n"]], ["ids", "n"]).filter(
                pa.array(sizes > 1))
    return work.mapInArrow(run, _WORK)


def _top_pairs(work: DataFrame, min_frequency: int, limit: int) -> list:
    """The most frequent pairs `(l, r, n)` over all words, smaller ids first on ties."""
    def run(batches):
        for batch in batches:
            keys, sums = _counted(*_unpack(batch), batch["n"].to_numpy())
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys >> 32), pa.array(keys & 0xFFFFFFFF), pa.array(sums)],
                ["l", "r", "n"])
    counted = (work.mapInArrow(run, "l bigint, r bigint, n bigint")
               .groupBy("l", "r").agg(F.sum("n").alias("n")).where(F.col("n") >= min_frequency))
    return counted.orderBy(F.col("n").desc(), "l", "r").limit(limit).collect()


def _segments(work: DataFrame, pairs: list[tuple[int, int]]) -> DataFrame:
    """The distinct parts of words, cut wherever two neighbours are none of the pairs.

    With the most frequent pairs given, nothing else is merged while the next pair comes
    before all others: whatever crosses a cut later is at most as frequent as the pair
    that was cut, and has larger symbols.  Long tails of rare words fall together to
    few parts, whose counts are summed; a part of one symbol holds no pair.
    """
    sorted_keys = np.array(sorted((left << 32) | right for left, right in pairs), np.int64)

    def run(batches):
        for batch in batches:
            flat, word = _unpack(batch)
            if not len(flat):
                continue
            keys, same = _pairs(flat, word)
            begin = np.flatnonzero(np.r_[True, ~(_find(keys, sorted_keys)[1] & same)])
            lists = pa.ListArray.from_arrays(pa.array(np.r_[begin, len(flat)].astype(np.int32)),
                                             pa.array(flat.astype(np.int32)))
            long = np.diff(np.r_[begin, len(flat)]) > 1
            yield pa.RecordBatch.from_arrays(
                [lists, pa.array(batch["n"].to_numpy()[word[begin]])], ["ids", "n"]).filter(pa.array(long))

    return work.mapInArrow(run, _WORK).groupBy("ids").agg(F.sum("n").alias("n"))


def _postings(work: DataFrame, pairs: list[tuple[int, int]]) -> DataFrame:
    """The index `(root, ids, n)`: each row of `work` under every listed pair it holds.

    Words stay in their partition and are sorted by root there, so every file spreads over
    all roots, and small row groups let a round read the roots it asks for and no others.
    """
    keys = np.array([(left << 32) | right for left, right in pairs], np.int64)
    order = np.argsort(keys)
    sorted_keys = keys[order]

    def run(batches):
        for batch in batches:
            flat, word = _unpack(batch)
            found_keys, same = _pairs(flat, word)
            at, found = _find(found_keys, sorted_keys)
            hit = found & same
            held = np.unique((word[:-1][hit] << 32) | order[at[hit]])
            rows = batch.take(pa.array(held >> 32))
            yield pa.RecordBatch.from_arrays(
                [pa.array((held & 0xFFFFFFFF).astype(np.int32)), *rows.columns], ["root", "ids", "n"])

    made = work.mapInArrow(run, f"root int, {_WORK}").sortWithinPartitions("root")
    path = shared_folder(work.sparkSession, "postings")
    made.write.option("parquet.block.size", INDEX_GROUP).parquet(path)
    return work.sparkSession.read.schema(made.schema).parquet(path)


def _chosen_roots(flat: np.ndarray, word: np.ndarray, n_words: int, roots: tuple) -> np.ndarray:
    """The smallest of some roots that each word holds: a word counts under that one only."""
    keys, same = _pairs(flat, word)
    at, found = _find(keys, roots[0])
    least = np.full(n_words, _NONE)
    hit = found & same
    np.minimum.at(least, word[:-1][hit], roots[1][at[hit]])
    return least


def _selected(flat: np.ndarray, word: np.ndarray, n: np.ndarray, rows: np.ndarray):
    """The words of some rows, numbered anew."""
    number = np.cumsum(rows) - 1
    keep = rows[word]
    return flat[keep], number[word[keep]], n[rows]


class _Index:
    """Pairs that may be merged next, their counts, and the words that hold them.

    Candidates are the most frequent pairs when the index is made; no other old pair can
    ever pass `floor`, for merges only lower the counts of old pairs.  A pair made since
    then lies in words that held the root of its new symbol.  The driver holds counts of
    candidates and of new pairs above the floor.  The words are indexed by their segments.
    """

    def __init__(self, work: DataFrame, ranked: list, floor: tuple | None, least: int, first_id: int):
        self.candidates = [(p.l, p.r) for p in ranked]
        self.counts = {(p.l, p.r): p.n for p in ranked}
        self.root = {pair: k for k, pair in enumerate(self.candidates)}
        self.root_of_symbol: dict[int, int] = {}
        self.floor, self.least, self.first_id = floor, max(least, floor[0] if floor else 0), first_id
        self.merges: list[Row] = []
        self.table = _postings(_segments(work, self.candidates), self.candidates)

    def ranked(self, without: set = frozenset(), limit: int = TENTATIVE) -> list[Row]:
        """The most frequent pairs that are certain to come before any pair unknown here."""
        best = heapq.nsmallest(limit, ((-n, *p) for p, n in self.counts.items()
                                       if n >= self.least and p not in without))
        pairs = [Row(l=left, r=right, n=-n) for n, left, right in best]
        return [p for p in pairs if self.floor is None or _place(p) > self.floor]

    def _roots(self, pairs: list) -> tuple[np.ndarray, np.ndarray]:
        """Keys of the root pairs of some pairs, in order, and the roots."""
        roots = {self.root[p.l, p.r] for p in pairs}
        keyed = sorted(((self.candidates[k][0] << 32) | self.candidates[k][1], k) for k in roots)
        return (np.array([k for k, _ in keyed] or [-1], np.int64),
                np.array([k for _, k in keyed] or [-1], np.int64))

    def merge(self, batch: list, guess: list, asked: list) -> tuple[dict, dict]:
        """Merge a batch of pairs, and look at the neighbours of the pairs in `guess`.

        One job over the words that hold a root of these pairs: it changes the counts, and
        returns the most frequent symbol beside each guessed pair as `(n, -symbol)` by
        (pair, side), smaller symbol on ties, and the counts of the asked ones.
        """
        past = _ranked(self.merges)
        first_new = self.first_id + len(self.merges)
        for k, p in enumerate(batch):
            self.merges.append(Row(left_id=p.l, right_id=p.r, rank=len(self.merges), new_id=first_new + k))
            self.root_of_symbol[first_new + k] = self.root[p.l, p.r]
        for p in guess:
            self._root_of(p.l, p.r)
        now = _ranked(self.merges[len(self.merges) - len(batch):])
        merged_roots, guessed_roots = self._roots(batch), self._roots(guess)
        tracked = np.array(sorted((left << 32) | right for left, right in self.counts), np.int64)
        guessed = np.array([(p.l << 32) | p.r for p in guess] or [-1], np.int64)
        order = np.argsort(guessed)
        sorted_guess = guessed[order]
        wanted = np.array(sorted((i << 33) | (s << 32) | x for i, s, x in asked) or [-1], np.int64)
        least = self.least

        def run(batches):
            for rows in batches:
                root, n = rows["root"].to_numpy(), rows["n"].to_numpy()
                flat, word = _unpack(rows)
                changed = root == _chosen_roots(flat, word, len(rows), merged_roots)
                looked = root == _chosen_roots(flat, word, len(rows), guessed_roots)
                used = changed | looked
                flat, word, n = _selected(flat, word, n, used)
                changed, looked = changed[used], looked[used]
                flat, word = _merge_words(flat, word, len(n), past)
                before_keys, before = _counted(*_selected(flat, word, n, changed))
                flat, word = _merge_words(flat, word, len(n), now)
                after_keys, after = _counted(*_selected(flat, word, n, changed))
                keys, sums = _summed(np.r_[before_keys, after_keys], np.r_[-before, after])
                known = _find(keys, tracked)[1]
                kept = (sums != 0) & (known | ((keys >> 32) >= first_new) | ((keys & 0xFFFFFFFF) >= first_new))
                yield _told(-1 - (keys[kept] >> 32), keys[kept] & 0xFFFFFFFF, known[kept], sums[kept])
                triples, sums = _beside(*_selected(flat, word, n, looked), sorted_guess, order)
                yield _told(triples >> 32, triples & 0xFFFFFFFF, _find(triples, wanted)[1], sums)

        roots = sorted({int(k) for found in (merged_roots, guessed_roots) for k in found[1] if k >= 0})
        entry = F.struct("n", (-F.col("symbol")).alias("symbol"))
        told = F.col("kept") | ((F.col("place") < 0) & (F.col("n") >= least))
        found = (self.table.where(F.col("root").isin(roots))
                 .mapInArrow(run, "place bigint, symbol bigint, kept boolean, n bigint")
                 .groupBy("place", "symbol", "kept").agg(F.sum("n").alias("n"))
                 .groupBy("place").agg(F.max(entry).alias("top"),
                                       F.collect_list(F.when(told, F.struct("symbol", "n"))).alias("told"))
                 .collect())
        for row in found:
            if row.place < 0:
                for t in row.told:
                    self._count((-1 - row.place, t.symbol), t.n)
        beside = [r for r in found if r.place >= 0]
        return ({(r.place >> 1, r.place & 1): tuple(r.top) for r in beside},
                {(r.place >> 1, r.place & 1, t.symbol): t.n for r in beside for t in r.told})

    def _root_of(self, left: int, right: int) -> None:
        """A pair made since the index is in the words of the root of its new symbol."""
        if (left, right) not in self.root:
            self.root[left, right] = self.root_of_symbol[left if left in self.root_of_symbol else right]

    def _count(self, pair: tuple[int, int], change: int) -> None:
        self._root_of(*pair)
        n = self.counts.get(pair, 0) + change
        if n >= self.least:
            self.counts[pair] = n
        else:
            self.counts.pop(pair, None)


def _told(place: np.ndarray, symbol: np.ndarray, kept: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(place.astype(np.int64)), pa.array(symbol.astype(np.int64)), pa.array(kept.astype(bool)),
         pa.array(n.astype(np.int64))], ["place", "symbol", "kept", "n"])


def _beside(flat: np.ndarray, word: np.ndarray, n: np.ndarray, sorted_keys: np.ndarray,
            order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols beside the listed pairs (side 0 before, 1 after) as `pair << 33 | side << 32
    | symbol`, and their counts."""
    keys, same = _pairs(flat, word)
    at, found = _find(keys, sorted_keys)
    hit = np.flatnonzero(found & same)
    pair = order[at[hit]]
    seen, weights = [], []
    for side, step in ((0, -1), (1, 2)):
        near = hit + step
        inside = (near >= 0) & (near < len(flat))
        inside[inside] = word[near[inside]] == word[hit[inside]]
        seen.append((pair[inside] << 33) | (side << 32) | flat[near[inside]])
        weights.append(n[word[hit[inside]]])
    return _summed(np.concatenate(seen), np.concatenate(weights))


def _place(p) -> tuple[int, int, int]:
    """Pairs with a larger place are merged earlier."""
    return p.n, -p.l, -p.r


def _touching(p, chosen: list) -> list[tuple[int, int, int]]:
    """Chosen pairs whose merge takes occurrences of `p`, as `(pair, side, symbol)`:
    `p` starts where a chosen pair ends, or ends where one starts."""
    return ([(i, 1, p.r) for i, q in enumerate(chosen) if q.r == p.l]
            + [(i, 0, p.l) for i, q in enumerate(chosen) if q.l == p.r])


def _tentative(ranked: list) -> tuple[list, list]:
    """Top pairs that do not touch each other, and what is to be asked about the
    pairs between them."""
    chosen, asked = [], []
    for p in ranked:
        touching = _touching(p, chosen)
        if touching:
            asked += touching
        else:
            chosen.append(p)
    return chosen, asked


def _certain(ranked: list, chosen: list, top: dict, counts: dict, looked: set) -> list:
    """The chosen pairs that are sure to be merged next, in this order; after one whose
    neighbours were not looked at, nothing is sure.

    Two things may come first.  A skipped pair keeps at most its count less the
    occurrences that one merge takes from it.  A merge makes new pairs with the
    neighbours of its pair; the count of the three symbols bounds theirs, and
    on equal counts a new pair is first only when its left symbol is smaller
    (its new symbol is larger than any old one).
    """
    sure, skipped, before, after = [], (0, 0, 0), (0, 0), 0
    for p in ranked:
        if p.n < after or (p.n, -p.l) < before or _place(p) < skipped:
            break
        if len(sure) < len(chosen) and p is chosen[len(sure)]:
            i = len(sure)
            sure.append(p)
            if (p.l, p.r) not in looked:
                break
            before = max(before, top.get((i, 0), before))
            after = max(after, top.get((i, 1), (0, 0))[0])
            continue
        taken = max((counts.get(t, 0) for t in _touching(p, sure)), default=0)
        skipped = max(skipped, (p.n - taken, -p.l, -p.r))
    return sure


def train(counts: DataFrame, vocab_size: int, min_frequency: int = 2,
          candidates: int = CANDIDATES) -> DataFrame:
    """Merges `(rank, left_id, right_id, new_id)` learned from `counts(word, n)`.

    Only the table of distinct words is worked on.  Words are cut where no frequent pair
    joins them, and the most frequent pairs get an index from pair to the distinct parts; a
    round is one job over the parts that hold the pairs it merges or is about to merge,
    takes all top pairs whose order is certain, and changes the counts by what these parts
    lose and gain.  Once no indexed pair is certain to come first, the words are merged,
    counted, cut and indexed anew.  The driver holds merges and candidates only, both
    bounded by parameters.
    """
    spark = counts.sparkSession
    table = byte_ids()

    @F.arrow_udf("array<int>")
    def spelled(words: pa.Array) -> pa.Array:
        flat, word = _symbols(words, table)
        offsets = np.r_[0, np.cumsum(np.bincount(word, minlength=len(words)))]
        return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)),
                                        pa.array(flat.astype(np.int32)))

    # Every round is computing, not reading: use all cores, whatever the bytes.
    work = written(counts.repartition(spark.sparkContext.defaultParallelism)
                   .select(spelled("word").alias("ids"), "n").where(F.size("ids") > 1), "words")
    merges: list[tuple[int, int]] = []
    wanted = max(0, vocab_size - FIRST_MERGE)
    while len(merges) < wanted:
        most = min(candidates, max(FEW_CANDIDATES, (wanted - len(merges)) // 2))
        ranked = _top_pairs(work, min_frequency, most + 1)
        if not ranked:
            break
        floor = _place(ranked[most]) if len(ranked) > most else None
        index = _Index(work, ranked[:most], floor, min_frequency, FIRST_MERGE + len(merges))
        _merge_all(index, wanted - len(merges))
        merges += [(m.left_id, m.right_id) for m in index.merges]
        if len(merges) < wanted:
            work = written(_merged(work, _ranked(index.merges)), "words")
    rows = [(rank, left, right, FIRST_MERGE + rank) for rank, (left, right) in enumerate(merges)]
    return spark.createDataFrame(
        rows, "rank int, left_id int, right_id int, new_id int").coalesce(1)


def _merge_all(index: _Index, wanted: int) -> None:
    """Rounds over one index, until no pair is certain or enough are merged.

    What a round learns about neighbours serves the next one, whose top pairs are guessed
    from the counts so far; numbers of pairs in `top` and `counts` are those of the guess.
    """
    guess, top, counts = [], {}, {}
    while len(index.merges) < wanted:
        ranked = index.ranked()
        if not ranked:
            return
        chosen, _ = _tentative(ranked)
        number = {(p.l, p.r): i for i, p in enumerate(guess)}
        place = {number.get((p.l, p.r)): k for k, p in enumerate(chosen)}
        sure = _certain(
            ranked, chosen, {(place[i], s): t for (i, s), t in top.items() if i in place},
            {(place[i], s, x): n for (i, s, x), n in counts.items() if i in place}, set(number))
        batch = sure[:wanted - len(index.merges)]
        if len(index.merges) + len(batch) == wanted:
            index.merge(batch, [], [])
            return
        # A merge makes its most frequent new pairs with the symbols most often beside it.
        made = []
        for new, p in enumerate(batch, index.first_id + len(index.merges)):
            for side in (0, 1):
                n, symbol = top.get((number.get((p.l, p.r)), side), (0, 0))
                made += [Row(l=-symbol, r=new, n=n) if side == 0 else Row(l=new, r=-symbol, n=n)] if n else []
        likely = sorted(index.ranked({(p.l, p.r) for p in batch}) + made, key=_place, reverse=True)
        guess, asked = _tentative(likely[:TENTATIVE])
        guess = guess[:GUESSED]
        top, counts = index.merge(batch, guess, [a for a in asked if a[0] < GUESSED])


# --- vocabulary -------------------------------------------------------------

def vocabulary(merges: DataFrame) -> DataFrame:
    """`(token, id)` in display characters; bounded by the vocabulary size."""
    tokens = [END_MARKER, *sorted(byte_display())]
    for m in merges.orderBy("rank").collect():
        tokens.append(tokens[m.left_id] + tokens[m.right_id])
    return merges.sparkSession.createDataFrame(
        [(t, i) for i, t in enumerate(tokens)], "token string, id int").coalesce(1)


def merge_texts(merges: DataFrame, vocab: DataFrame) -> DataFrame:
    """`(rank, left, right)` as display text."""
    name = lambda side: vocab.select(F.col("id").alias(f"{side}_id"), F.col("token").alias(side))
    return (merges.join(name("left"), "left_id").join(name("right"), "right_id")
            .select("rank", "left", "right"))


def merges_from_texts(texts: DataFrame, vocab: DataFrame) -> DataFrame:
    """The inverse of `merge_texts`, for a stored tokenizer."""
    ids = lambda column, out: vocab.select(F.col("token").alias(column), F.col("id").alias(out))
    made = texts.withColumn("made", F.concat("left", "right"))
    return (made.join(ids("left", "left_id"), "left").join(ids("right", "right_id"), "right")
            .join(ids("made", "new_id"), "made")
            .select("rank", "left_id", "right_id", "new_id"))


def token_id(tokens: DataFrame, vocab: DataFrame) -> DataFrame:
    """`id` of each `token`, null when it is not in the vocabulary."""
    return tokens.join(vocab, "token", "left")


def vocabulary_report(vocab: DataFrame, requested: int) -> DataFrame:
    return vocab.agg(F.count("*").alias("actual")).select(
        F.lit(requested).cast("bigint").alias("requested"), "actual",
        (F.col("actual") == requested).alias("complete"))


# --- encoding and decoding --------------------------------------------------

def _encode_words(words: pa.Array, merges: tuple, table: np.ndarray) -> list[np.ndarray]:
    """Ids of many words at once."""
    flat, word = _merge_words(*_symbols(words, table), len(words), merges)
    sizes = np.bincount(word, minlength=len(words))
    return np.split(flat.astype(np.int32), np.cumsum(sizes)[:-1])


def _encode_lists(words: pa.Array, merges: tuple, table: np.ndarray, memo: dict,
                  special: dict) -> pa.Array:
    """Replace every word list by its ids; only words not seen before are worked out."""
    coded = words.flatten().dictionary_encode()
    unique = coded.dictionary.to_pylist()
    new = [w for w in unique if w not in memo]
    if new:
        if len(memo) > MEMO_WORDS:
            memo.clear()
            memo.update(special)
            new = [w for w in unique if w not in memo]
        memo.update(zip(new, _encode_words(pa.array(new, pa.string()), merges, table)))
    pieces = [memo[w] for w in unique]
    sizes = np.array([len(p) for p in pieces], np.int64)
    at = coded.indices.to_numpy(zero_copy_only=False)
    source = np.concatenate(pieces) if pieces else np.zeros(0, np.int32)
    begin = np.cumsum(sizes) - sizes
    lengths = sizes[at]
    ends = np.cumsum(lengths)
    shift = np.repeat(begin[at] - (ends - lengths), lengths)
    ids = source[shift + np.arange(len(shift))]
    n_words = np.r_[0, np.cumsum(pc.list_value_length(words).fill_null(0).to_numpy(
        zero_copy_only=False))].astype(np.int64)
    offsets = np.r_[0, ends][n_words]
    return pa.LargeListArray.from_arrays(pa.array(offsets), pa.array(ids)).cast(
        pa.list_(pa.int32()))


def encoder(spark: SparkSession, merges: DataFrame, parse_special: bool = False):
    """Column function text -> ids.  Merges go to every task; their number is
    bounded by the vocabulary size."""
    shared = spark.sparkContext.broadcast(_ranked(merges.collect()))
    table = byte_ids()
    special = {END_MARKER: np.array([END_ID], np.int32)} if parse_special else {}

    @F.arrow_udf("array<int>")
    def ids_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        memo = dict(special)
        for words in batches:
            yield _encode_lists(words, shared.value, table, memo, special)

    return lambda text: ids_of(pre_tokens(text, parse_special))


def encode(docs: DataFrame, merges: DataFrame, column: str = "text",
           parse_special: bool = False) -> DataFrame:
    """Adds `token_ids`; no shuffle."""
    ids = encoder(docs.sparkSession, merges, parse_special)
    return docs.withColumn("token_ids", ids(F.col(column)))


def decode(docs: DataFrame, vocab: DataFrame, column: str = "token_ids",
           out: str = "decoded") -> DataFrame:
    """Adds the text of the ids; bytes are joined first, broken ones become U+FFFD."""
    value = {c: b for b, c in enumerate(byte_display())}
    rows = sorted((r.id, r.token) for r in vocab.collect())
    texts = [t.encode() if i == END_ID else bytes(value[c] for c in t) for i, t in rows]
    shared = docs.sparkSession.sparkContext.broadcast(texts)

    @F.arrow_udf("binary")
    def bytes_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = pa.array(shared.value, pa.binary())
        for ids in batches:
            offsets = np.r_[0, np.cumsum(pc.list_value_length(ids).fill_null(0).to_numpy(
                zero_copy_only=False))].astype(np.int32)
            parts = pa.ListArray.from_arrays(pa.array(offsets), known.take(ids.flatten()))
            yield pc.binary_join(parts, b"")

    return docs.withColumn(out, F.make_valid_utf8(bytes_of(column).cast("string")))
