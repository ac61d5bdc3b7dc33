"""Exact deduplication through a sharded cuckoo-filter index.

A shard of the index holds the stored keys (digest, smallest id, live copies)
and a cuckoo filter over them: four slots a bucket, each a 16-bit fingerprint
beside the number of its key.  A fingerprint that matches is only a hint; the
stored key in that slot decides.  When a key finds no slot, the filter doubles
and is laid out anew from the stored keys.

Rows reach the index as partial counts: every task keeps a bounded index of
its own rows first, so a digest that a third of all rows share arrives as one
row per task.

Defined results: a null text counts as empty; equal texts are those with equal
SHA-256 after white-space runs become one space; null ids lose against any id;
rows repeated under one id stand or fall together; an empty table gives no
rows; other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import BLANK
from millrace.session import written

SLOTS = 4
MAX_MOVES = 200
#: Keys for which a shard is planned, and keys a task gathers before it sends them on.
SHARD_KEYS = 8192
LOCAL_KEYS = 100_000


class CuckooIndex:
    """Keys with smallest id and live count, behind a cuckoo filter."""

    def __init__(self, buckets: int = 16):
        self.digests: list[bytes] = []
        self.first: list = []
        self.sizes: list[int] = []
        self._lay_out(buckets)

    def __len__(self) -> int:
        return len(self.digests)

    def _lay_out(self, buckets: int) -> None:
        """An empty filter of a power of two buckets, filled from the stored keys."""
        while True:
            self.buckets = buckets
            self.prints = array("H", bytes(2 * SLOTS * buckets))
            self.rows = array("i", bytes(4 * SLOTS * buckets))
            if all(self._place(digest, row) for row, digest in enumerate(self.digests)):
                return
            buckets *= 2

    def _homes(self, digest: bytes) -> tuple[int, int, int]:
        fingerprint = int.from_bytes(digest[:2], "little") or 1
        home = int.from_bytes(digest[2:10], "little") & (self.buckets - 1)
        return fingerprint, home, self._other(home, fingerprint)

    def _other(self, bucket: int, fingerprint: int) -> int:
        return bucket ^ (fingerprint * 0x5BD1E995 >> 7 & (self.buckets - 1))

    def _slot(self, digest: bytes) -> int:
        """Slot whose fingerprint matches and whose stored key is the digest; else -1."""
        fingerprint, *homes = self._homes(digest)
        for bucket in homes:
            for slot in range(SLOTS * bucket, SLOTS * bucket + SLOTS):
                if self.prints[slot] == fingerprint and self.digests[self.rows[slot]] == digest:
                    return slot
        return -1

    def _place(self, digest: bytes, row: int) -> bool:
        fingerprint, *homes = self._homes(digest)
        bucket = homes[0]
        for move in range(MAX_MOVES):
            for bucket in homes:
                for slot in range(SLOTS * bucket, SLOTS * bucket + SLOTS):
                    if not self.prints[slot]:
                        self.prints[slot], self.rows[slot] = fingerprint, row
                        return True
            slot = SLOTS * bucket + (move + row) % SLOTS
            fingerprint, self.prints[slot] = self.prints[slot], fingerprint
            row, self.rows[slot] = self.rows[slot], row
            homes = [self._other(bucket, fingerprint)]
        return False

    def add(self, digest: bytes, doc_id, copies: int = 1) -> None:
        slot = self._slot(digest)
        if slot >= 0:
            row = self.rows[slot]
            self.sizes[row] += copies
            if self.first[row] is None or (doc_id is not None and doc_id < self.first[row]):
                self.first[row] = doc_id
            return
        self.digests.append(digest)
        self.first.append(doc_id)
        self.sizes.append(copies)
        if not self._place(digest, len(self.digests) - 1):
            self._lay_out(2 * self.buckets)

    def put(self, digest: bytes, doc_id, copies: int) -> None:
        """Set what is known of a live digest; without copies it goes."""
        slot = self._slot(digest)
        if slot >= 0 and copies:
            self.first[self.rows[slot]], self.sizes[self.rows[slot]] = doc_id, copies
        elif slot >= 0:
            self.remove(digest)

    def find(self, digest: bytes) -> tuple | None:
        slot = self._slot(digest)
        return None if slot < 0 else (self.first[self.rows[slot]], self.sizes[self.rows[slot]])

    def remove(self, digest: bytes) -> bool:
        """Take a live digest out; the last key moves into the hole."""
        slot = self._slot(digest)
        if slot < 0:
            return False
        row, last = self.rows[slot], len(self.digests) - 1
        if row != last:
            self.rows[self._slot(self.digests[last])] = row
        self.prints[slot] = 0
        for kept in (self.digests, self.first, self.sizes):
            kept[row] = kept[last]
            kept.pop()
        return True

    def to_row(self) -> dict:
        return {"digests": b"".join(self.digests), "first_ids": self.first, "sizes": self.sizes,
                "prints": self.prints.tobytes(), "slot_rows": self.rows.tobytes()}

    @classmethod
    def from_row(cls, row: dict) -> CuckooIndex:
        index = cls.__new__(cls)
        index.digests = [row["digests"][i:i + 32] for i in range(0, len(row["digests"]), 32)]
        index.first, index.sizes = list(row["first_ids"]), list(row["sizes"])
        index.prints, index.rows = array("H", row["prints"]), array("i", row["slot_rows"])
        index.buckets = len(index.prints) // SLOTS
        return index


def digests(docs: DataFrame) -> DataFrame:
    """`(doc_id, digest)`: SHA-256 of the text with each white-space run as one space."""
    text = F.regexp_replace(F.coalesce(F.col("text"), F.lit("")), BLANK + "+", " ")
    return docs.select("doc_id", F.unhex(F.sha2(text, 256)).alias("digest"))


def _entry_schema(id_type: T.DataType) -> T.StructType:
    return T.StructType([T.StructField("digest", T.BinaryType()), T.StructField("keep_id", id_type),
                         T.StructField("group_size", T.LongType())])


def _index_schema(id_type: T.DataType) -> T.StructType:
    return T.StructType([
        T.StructField("shard", T.LongType()), T.StructField("digests", T.BinaryType()),
        T.StructField("first_ids", T.ArrayType(id_type)),
        T.StructField("sizes", T.ArrayType(T.LongType())),
        T.StructField("prints", T.BinaryType()), T.StructField("slot_rows", T.BinaryType())])


def _batch(rows: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(rows, schema=schema)


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    return to_arrow_schema(schema)


def gather(rows: DataFrame) -> DataFrame:
    """Partial `(digest, keep_id, group_size)` of `(doc_id, digest)`: each task passes its
    rows through an index of at most `LOCAL_KEYS` keys."""
    schema = _entry_schema(rows.schema["doc_id"].dataType)
    out = _arrow(schema)

    def flush(index: CuckooIndex) -> pa.RecordBatch:
        return _batch({"digest": index.digests, "keep_id": index.first,
                       "group_size": index.sizes}, out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = CuckooIndex()
        for batch in batches:
            for doc_id, digest in zip(*(c.to_pylist() for c in batch.columns)):
                index.add(digest, doc_id)
            if len(index) > LOCAL_KEYS:
                yield flush(index)
                index = CuckooIndex()
        yield flush(index)

    return rows.select("doc_id", "digest").mapInArrow(run, schema)


def _shard(shards: int):
    return F.pmod(F.xxhash64("digest"), F.lit(shards)).alias("shard")


def empty_index(rows: DataFrame) -> DataFrame:
    """An index without keys, for ids of the type in `rows`."""
    return rows.sparkSession.createDataFrame([], _index_schema(rows.schema["doc_id"].dataType))


def _updated(index: DataFrame, entries: DataFrame, shards: int, delete: bool) -> DataFrame:
    schema = index.schema
    out = _arrow(schema)

    def run(stored: pa.Table, new: pa.Table) -> pa.Table:
        held = stored.to_pylist()
        filter_ = CuckooIndex.from_row(held[0]) if held else CuckooIndex()
        shard = (held or [{"shard": new["shard"][0].as_py() if new.num_rows else 0}])[0]["shard"]
        for digest, keep_id, size in zip(*(new[c].to_pylist() for c in new.column_names[1:])):
            if delete:
                filter_.put(digest, keep_id, size)
            else:
                filter_.add(digest, keep_id, size)
        row = {"shard": shard} | filter_.to_row()
        return pa.Table.from_pylist([row], schema=out)

    keyed = entries.select(_shard(shards), "digest", "keep_id", "group_size")
    return (index.groupBy("shard").cogroup(keyed.groupBy("shard")).applyInArrow(run, schema))


def insert(index: DataFrame, rows: DataFrame, shards: int) -> DataFrame:
    """The index after the rows `(doc_id, digest)` went in."""
    return _updated(index, gather(rows), shards, delete=False)


def delete(index: DataFrame, rows: DataFrame, live: DataFrame, shards: int) -> DataFrame:
    """The index after the rows `(doc_id, digest)` went out and `live(doc_id, digest)` are
    left.  Of the digests of the rows, those that no live row has go; the others keep the
    smallest id and the number of their live rows.  Digests that the index does not hold
    change nothing."""
    gone = rows.select("digest").distinct()
    left = gather(live.join(gone, "digest", "left_semi")).groupBy("digest").agg(
        F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    known = gone.join(left, "digest", "left").select(
        "digest", "keep_id", F.coalesce("group_size", F.lit(0)).alias("group_size"))
    return _updated(index, known, shards, delete=True)


def entries(index: DataFrame) -> DataFrame:
    """The stored keys: `(digest, keep_id, group_size)`."""
    id_type = index.schema["first_ids"].dataType.elementType
    schema = _entry_schema(id_type)
    out = _arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                shard = CuckooIndex.from_row(row)
                yield _batch({"digest": shard.digests, "keep_id": shard.first,
                              "group_size": shard.sizes}, out)

    return index.drop("shard").mapInArrow(run, schema)


def lookup(index: DataFrame, rows: DataFrame, shards: int) -> DataFrame:
    """`(digest, keep_id, group_size)` of those digests of the rows that are live."""
    schema = _entry_schema(index.schema["first_ids"].dataType.elementType)
    out = _arrow(schema)

    def run(stored: pa.Table, asked: pa.Table) -> pa.Table:
        held = stored.to_pylist()
        filter_ = CuckooIndex.from_row(held[0]) if held else CuckooIndex()
        found = {d: hit for d in asked["digest"].to_pylist() if (hit := filter_.find(d))}
        return pa.Table.from_pydict({"digest": list(found), "keep_id": [h[0] for h in found.values()],
                                     "group_size": [h[1] for h in found.values()]}, schema=out)

    keyed = gather(rows).select(_shard(shards), "digest")
    return index.groupBy("shard").cogroup(keyed.groupBy("shard")).applyInArrow(run, schema)


def planned_shards(docs: DataFrame) -> int:
    return max(1, -(-docs.count() // SHARD_KEYS))


def deduplicate(docs: DataFrame) -> DataFrame:
    """`(doc_id, keep_id, group_size, kept, text_sha256)` of every row."""
    rows = written(digests(docs), "digests")
    index = insert(empty_index(rows), rows, planned_shards(rows))
    known = entries(written(index, "cuckoo"))
    return rows.join(known, "digest").select(
        "doc_id", "keep_id", "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"))
