"""Ranked lexical search: dense tiles of item weights times dense tiles of impacts.

1. Items become entries (item, term, times).  They are cut into blocks whose
   entries are bounded in number; a block's terms are its compact vocabulary.
2. One pass over the documents counts, for a block, the documents with a term, all
   terms, and the documents that hold each term of the vocabulary.  Tasks sum first.
3. A second pass fills an impact tile (terms x documents) and multiplies it by the
   item tile (items x terms) in float64.  Weights and impacts are whole numbers and
   the vocabulary is cut so that no item's sum within a tile can reach 2^53: every
   product and partial sum is exact whatever the order BLAS adds in.  Tiles are
   added as 64-bit integers.
4. A task keeps, for each item, every candidate at or above its k-th score so far
   and cuts them by (score, id), so ties never depend on the tile; the tasks' best
   are merged in two steps.

Passes per block are two scans of the texts; one block holds hundreds of items.

Defined results: terms of all rows of one item id (a null one too) count together;
repeated documents are ranked one by one, with equal scores by id, rows without an
id last; a null or empty text has no terms and is never returned; an item without
terms, or without a hit, returns no row; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.common import first_per_group, small_batches
from millrace.session import written

TOP = 10
# Fixed values of the ranking.
IMPACT, TF_SCALE, LENGTH_SCALE = 1_000_000_000, 1000, 8
SLOPE = 75
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

#: Bounds of a block of items, of a tile of documents, and of a sum within a tile.
BLOCK_ENTRIES, BLOCK_ITEMS = 50_000, 512
TILE_DOCS, TILE_TERMS = 256, 2_048
EXACT = 1 << 53
MOST_IMPACT = IMPACT // TF_SCALE

#: Bytes to bytes of terms: A-Z lower-cased, what is no part of a term to a space.
_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32
    for b in range(256))


def terms(text: str | None) -> list[bytes]:
    """Terms of a text, in order, in UTF-8."""
    return (text or "").encode("utf-8", "replace").translate(_BYTES).split()


def weight(n_docs: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * holding + 1)))


def entries(items: DataFrame) -> DataFrame:
    """`(item_id, term, times)`; terms as UTF-8, counted before the shuffle."""
    lower = F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
                        "abcdefghijklmnopqrstuvwxyz")
    found = F.regexp_extract_all(lower, F.lit(TERM), F.lit(0))
    return (items.select("item_id", F.explode(found).alias("term"))
            .groupBy("item_id", "term").agg(F.count("*").alias("times")))


#: Terms (columns), items (rows), and the weighted count of each.
Tile = tuple[np.ndarray, np.ndarray, np.ndarray]


class Block:
    """Entries of some items as arrays: item and term of each entry, and its count."""

    def __init__(self, rows: list):
        self.items = list(dict.fromkeys(r.item_id for r in rows))
        place = {item: i for i, item in enumerate(self.items)}
        words = sorted({r.term for r in rows})
        self.terms = {w.encode(): k for k, w in enumerate(words)}
        self.item = np.array([place[r.item_id] for r in rows], np.int64)
        self.term = np.array([self.terms[r.term.encode()] for r in rows], np.int64)
        self.count = np.array([r.times for r in rows], np.int64)

    def tiles(self, weights: np.ndarray, most: int = EXACT) -> list[Tile]:
        """Tiles of weighted counts, without terms or items that have none.  No row of a tile can reach `most` by any
        impacts; an entry that could alone is dealt over several tiles."""
        value = self.count * weights[self.term]
        largest = (most - 1) // MOST_IMPACT
        item, term = self.item[value > 0], self.term[value > 0]
        value = value[value > 0]
        out = []
        while len(value):
            order = np.lexsort((item, term))
            item, term, value = item[order], term[order], value[order]
            width = np.unique(term, return_inverse=True)[1] < TILE_TERMS
            room = np.full(len(self.items), largest, np.int64)
            taken = np.zeros(len(value), np.int64)
            for k in np.flatnonzero(width):
                taken[k] = min(value[k], room[item[k]])
                room[item[k]] -= taken[k]
            columns, column = np.unique(term[taken > 0], return_inverse=True)
            rows, row = np.unique(item[taken > 0], return_inverse=True)
            tile = np.zeros((len(rows), len(columns)))
            tile[row, column] = taken[taken > 0]
            out.append((columns, rows, tile))
            value = value - taken
            item, term, value = item[value > 0], term[value > 0], value[value > 0]
        return out


def blocks(spark: SparkSession, items: DataFrame, most: int = BLOCK_ENTRIES,
           most_items: int = BLOCK_ITEMS) -> Iterator[Block]:
    """Blocks of items, each of a bounded number of entries and items (a larger item is
    alone in its block).  Only one block at a time is on the driver."""
    rows = written(entries(items), "entries")
    size = rows.groupBy("item_id").agg(F.count("*").alias("n"))
    n, n_items, largest = size.agg(F.sum("n"), F.count("*"), F.max("n")).first()
    if not n:
        return
    parts = max(-(-n // most), -(-n_items // most_items))
    while True:  # ids are dealt by hash: deal finer until every block keeps its bounds
        part = lambda: F.pmod(F.xxhash64("item_id"), F.lit(parts))
        full = (size.groupBy(part().alias("part")).agg(F.sum("n").alias("n"), F.count("*").alias("items"))
                .where((F.col("items") > 1) & ((F.col("n") > max(most, largest)) | (F.col("items") > most_items))))
        if parts == 1 or full.isEmpty():
            break
        parts *= 2
    for k in range(parts):
        found = rows.where(part() == k).collect()
        if found:
            yield Block(found)


def _batches(docs: DataFrame, function, schema: str) -> DataFrame:
    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(function, schema)


def statistics(docs: DataFrame, block: Block) -> tuple[int, int, np.ndarray]:
    """Documents with a term, all terms with repeats, and documents that hold each term
    of the block."""
    sent = docs.sparkSession.sparkContext.broadcast(block.terms)
    n = len(block.terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = sent.value
        holding = np.zeros(n + 2, np.int64)
        for batch in batches:
            for text in batch.column("text").to_pylist():
                found = terms(text)
                if found:
                    known = [place[t] for t in place.keys() & set(found)] if n < len(found) \
                        else [place[t] for t in set(found) if t in place]
                    holding[known] += 1
                    holding[n] += 1
                    holding[n + 1] += len(found)
        some = np.flatnonzero(holding)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(holding[some])], ["term", "n"])

    sums = np.zeros(n + 2, np.int64)
    for row in (_batches(docs, run, "term bigint, n bigint").groupBy("term")
                .agg(F.sum("n").alias("n")).collect()):
        sums[row.term] = row.n
    return int(sums[n]), int(sums[n + 1]), sums[:n]


def _impacts(texts: list[str], place: dict[bytes, int], n_docs: int, n_terms: int) -> tuple[np.ndarray, ...]:
    """`(document, term, impact)` of the vocabulary's terms in some texts."""
    at, term, tf, lengths = [], [], [], []
    for k, text in enumerate(texts):
        found = terms(text)
        counts = Counter(map(place.get, found))
        counts.pop(None, None)
        at.append(np.full(len(counts), k))
        term.append(np.fromiter(counts.keys(), np.int64, len(counts)))
        tf.append(np.fromiter(counts.values(), np.int64, len(counts)))
        lengths.append(100 - SLOPE + SLOPE * len(found) * n_docs // n_terms)
    at, term, tf = np.concatenate(at), np.concatenate(term), np.concatenate(tf)
    m = np.array(lengths, np.int64)[at]
    return at, term, IMPACT * tf // (TF_SCALE * tf + LENGTH_SCALE * m)


def scores(n: int, at: np.ndarray, term: np.ndarray, impact: np.ndarray,
           tiles: list[Tile], n_items: int) -> np.ndarray:
    """Scores (items x documents) as 64-bit integers."""
    total = np.zeros((n_items, n), np.int64)
    for columns, rows, tile in tiles:
        column = np.minimum(np.searchsorted(columns, term), len(columns) - 1)
        hit = columns[column] == term
        if hit.any():
            dense = np.zeros((len(columns), n))
            dense[column[hit], at[hit]] = impact[hit]
            total[rows] += (tile @ dense).astype(np.int64)
    return total


def _best(found: pa.Table, k: int) -> pa.Table:
    """The `k` best rows of each item: by score, then id, rows without an id last."""
    found = found.take(pc.sort_indices(found, sort_keys=[
        ("item", "ascending"), ("score", "descending"), ("doc_id", "ascending")], null_placement="at_end"))
    item = found.column("item").to_numpy()
    first = np.searchsorted(item, item)
    return found.filter(pa.array(np.arange(len(item)) - first < k))


def hits(docs: DataFrame, block: Block, n_docs: int, n_terms: int, holding: np.ndarray,
         k: int = TOP) -> DataFrame:
    """`(item, doc_id, score)`: of each task the `k` best of each item, ties cut by id."""
    weights = np.array([weight(n_docs, int(h)) for h in holding], np.int64)
    sent = docs.sparkSession.sparkContext.broadcast((block.terms, block.tiles(weights)))
    kind = docs.schema["doc_id"].dataType.simpleString()
    n_items = len(block.items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, tiles = sent.value
        floor = np.ones(n_items, np.int64)  # a score of 0 is no hit
        kept, waiting = None, []
        for batch in batches:
            for start in range(0, len(batch), TILE_DOCS):
                part = batch.slice(start, TILE_DOCS)
                at, term, impact = _impacts(part.column("text").to_pylist(), place, n_docs, n_terms)
                found = scores(len(part), at, term, impact, tiles, n_items)
                item, doc = np.nonzero(found >= floor[:, None])
                if len(item):
                    waiting.append(pa.table([pa.array(item), part.column("doc_id").take(pa.array(doc)),
                                             pa.array(found[item, doc])], ["item", "doc_id", "score"]))
                if sum(map(len, waiting)) > n_items * k:
                    kept = _best(pa.concat_tables([kept, *waiting] if kept else waiting), k)
                    waiting = []
                    item, n = np.unique(kept.column("item").to_numpy(), return_counts=True)
                    last = kept.column("score").to_numpy()[np.cumsum(n) - 1]
                    floor[item[n == k]] = last[n == k]
        if waiting or kept:
            kept = _best(pa.concat_tables([kept, *waiting] if kept else waiting), k)
            yield from kept.combine_chunks().to_batches()

    return _batches(docs, run, f"item bigint, doc_id {kind}, score bigint")


def search(docs: DataFrame, items: DataFrame, k: int = TOP, most: int = BLOCK_ENTRIES,
           most_items: int = BLOCK_ITEMS) -> DataFrame:
    """`(item_id, rank, doc_id, score)`: the `k` best documents of each item."""
    spark = docs.sparkSession
    kind = items.schema["item_id"].dataType.simpleString()
    order = [-F.col("score"), F.col("doc_id").isNull(), F.col("doc_id")]
    found = None
    for block in blocks(spark, items, most, most_items):
        n_docs, n_terms, holding = statistics(docs, block)
        if not n_terms:
            break
        names = spark.createDataFrame(list(enumerate(block.items)), f"item bigint, item_id {kind}")
        some = hits(docs, block, n_docs, n_terms, holding, k)
        best = first_per_group(some, ["item"], order, k).join(F.broadcast(names), "item")
        best = written(best.select("item_id", "item", "doc_id", "score"), "hits")
        found = best if found is None else found.unionByName(best)
    if found is None:
        kind_of_doc = docs.schema["doc_id"].dataType.simpleString()
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id {kind_of_doc}, score bigint")
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(*order))
    return found.select("item_id", rank.alias("rank"), "doc_id", "score")
