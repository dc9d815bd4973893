"""Byte-balanced contiguous shards from global prefix sums.

Rows are ordered by (digest of the text, id), so equal texts lie together.
Each range partition reports only its byte total; running sums of those
totals give every partition its place in the corpus, and the corpus is cut at
equal byte targets. The driver sees one number pair per partition and one
entry per cut, never rows.

A row goes to the shard in which its first byte falls. A group of equal texts
that a cut would part stays whole if it is small against a shard
(``group_tolerance``); a larger group is parted at the cut, because the law
is near-equal bytes.

Defined cases: a null text has no bytes (size 16) and crc32 0; a null id sorts
first; repeated rows are rows of their own; an empty table gives no rows;
other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwright.session import checkpoint_root

#: Bytes counted for a row besides its text.
ROW_BYTES = 16


def ordered_sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, digest) in global order, fixed by a checkpoint."""
    checkpoint_root(docs.sparkSession)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text).cast("long") + ROW_BYTES).alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.unhex(F.md5(text)).alias("digest"),
    )
    order = ["digest", "doc_id", "size"]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).checkpoint()


def partition_totals(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and rows before each partition, with the totals at the end."""
    got = rows.groupBy(F.spark_partition_id().alias("p")).agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect()
    parts = rows.rdd.getNumPartitions()
    size, count = np.zeros(parts + 1, np.int64), np.zeros(parts + 1, np.int64)
    for r in got:
        size[r.p + 1], count[r.p + 1] = r.b, r.n
    return np.cumsum(size), np.cumsum(count)


def _starts(batches, before: np.ndarray) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    at = int(before[TaskContext.get().partitionId()])
    for b in batches:
        size = b.column("size").to_numpy(zero_copy_only=False).astype(np.int64)
        ends = at + np.cumsum(size)
        if len(size):
            yield b, ends - size
            at = int(ends[-1])


def _groups_at(rows: DataFrame, before: np.ndarray, cuts: np.ndarray) -> list:
    """Start and bytes of the text groups that hold a cut (one row per cut at most)."""
    def find(batches):
        for b, start in _starts(batches, before):
            size = b.column("size").to_numpy(zero_copy_only=False)
            hit = np.searchsorted(start, cuts, side="right") - 1
            ok = (hit >= 0) & (cuts < start[-1] + size[-1]) & (cuts >= start[0])
            if ok.any():
                yield pa.RecordBatch.from_arrays([pa.array(cuts[ok]), b.column("digest").take(pa.array(hit[ok]))], ["cut", "digest"])

    found = rows.select("size", "digest").mapInArrow(find, "cut long, digest binary").collect()
    wanted = sorted({bytes(r.digest) for r in found})
    if not wanted:
        return []

    def extent(batches):
        for b, start in _starts(batches, before):
            keep = np.flatnonzero(np.isin(np.array([bytes(x) for x in b.column("digest").to_pylist()], dtype=object), wanted))
            if len(keep):
                take = pa.array(keep)
                yield pa.RecordBatch.from_arrays([b.column("digest").take(take), pa.array(start[keep]), b.column("size").take(take)], ["digest", "start", "size"])

    spans = rows.select("size", "digest").mapInArrow(extent, "digest binary, start long, size long")
    held = {bytes(r.digest): (r.start, r.size) for r in spans.groupBy("digest").agg(F.min("start").alias("start"), F.sum("size").alias("size")).collect()}
    return [(r.cut, *held[bytes(r.digest)]) for r in found]


def shard_by_bytes(docs: DataFrame, n_shards: int = 40, group_tolerance: float = 0.02,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (null under this law)."""
    rows = ordered_sizes(docs, id_col, text_col)
    before, count = partition_totals(rows)
    total = int(before[-1])
    cuts = np.array([-(-total * k // n_shards) for k in range(1, n_shards)], np.int64)
    moved = cuts.copy()
    for cut, start, size in _groups_at(rows, before, cuts):
        if size <= group_tolerance * total / n_shards:
            moved[cuts == cut] = start if cut - start < start + size - cut else start + size
    cuts = np.maximum.accumulate(moved)

    def per_shard(batches):
        for b, start in _starts(batches, before):
            s, n = np.unique(np.searchsorted(cuts, start, side="right"), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(s.astype(np.int32)), pa.array(n)], ["shard", "n"])

    sizes = {r.shard: r.n for r in rows.select("size").mapInArrow(per_shard, "shard int, n long").groupBy("shard").agg(F.sum("n").alias("n")).collect()}
    first = np.concatenate([[0], np.cumsum([sizes.get(k, 0) for k in range(n_shards)])])

    def place(batches):
        rank = int(count[TaskContext.get().partitionId()])
        for b, start in _starts(batches, before):
            shard = np.searchsorted(cuts, start, side="right")
            slot = rank + np.arange(len(start)) - first[shard]
            rank += len(start)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("size"), b.column("text_crc32"), pa.array(shard.astype(np.int32)), pa.array(slot)],
                ["doc_id", "size", "text_crc32", "shard", "slot"])

    id_type = dict(rows.dtypes)["doc_id"]
    placed = rows.select("doc_id", "size", "text_crc32").mapInArrow(place, f"doc_id {id_type}, size long, text_crc32 long, shard int, slot long")
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
