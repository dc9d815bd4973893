"""Importance resampling towards a target distribution of hashed n-grams.

Two passes over the documents. The first counts the buckets of all runs of one
to three words, in the documents and in the target texts; from the two counts
each bucket gets a gain. The second adds the gains of a document's features to
its weight; a Gumbel draw keyed by the id turns weights into a sample without
replacement.

Both passes intern the n-grams of a piece of text in an open-addressed NumPy
table: the key is the xxhash64 of the n-gram's bytes, equal keys are verified
byte by byte, and other n-grams go on to the next slot. A slot stores the
n-gram's bucket and count, so the crc32 is taken once for each different
n-gram. The slot of every occurrence then gathers the gains in one step.

A task holds ``PIECE_WORDS`` words of n-grams at a time, however long a text is.
Pass one sends one number a bucket and task; the driver holds two numbers a
bucket. Ranks come from a range-partitioned sort of the scores (no window over
all rows).

Defined cases: a null text has no words; an n-gram may be of any length; a null
id counts as an empty text in its draw and comes after all others in a tie;
rows that share an id draw the same number, and rows alike in id and score rank
in the order of a hash of the row; no documents, or no target texts, count
zero; other columns of the input are not read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwright.llm.textvec import LOWER, Words, slabs
from pairwright.operators.indexing import row_index
from pairwright.session import scratch_path

BUCKETS = 10_000
WIDEST = 3
#: Words whose n-grams are held at once, and bytes of text cut into words at once.
PIECE_WORDS = 1 << 14
PIECE_BYTES = 1 << 18

#: Bytes outside words: ASCII but digits and letters.
GAP = np.ones(256, bool)
GAP[0x30:0x3A] = GAP[0x41:0x5B] = GAP[0x61:0x7B] = GAP[0x80:] = False

# The primes of xxhash64.
P1, P2, P3, P4, P5 = (np.uint64(p) for p in (
    11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))
#: Spans from this length on are hashed one by one by the library.
LONG = 32
_BYTES = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [2**64 - 1], np.uint64)


def _turn(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))


class Spans:
    """Byte spans of a buffer, read eight bytes at a time."""

    def __init__(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        self.buf = np.concatenate([buf, np.zeros(8, np.uint8)])
        self.lanes = np.ndarray(len(buf) + 1, "<u8", self.buf, strides=(1,))
        self.starts, self.sizes = starts, ends - starts

    def __len__(self) -> int:
        return len(self.starts)

    def bytes_of(self, some: np.ndarray) -> Iterator[bytes]:
        """The bytes of the spans numbered in ``some``."""
        data, starts = self.buf.tobytes(), self.starts[some]
        return (data[a:b] for a, b in zip(starts.tolist(), (starts + self.sizes[some]).tolist()))

    def hashes(self) -> np.ndarray:
        """xxhash64 (seed 0) of every span."""
        n8, left = self.sizes // 8, self.sizes % 8
        with np.errstate(over="ignore"):
            h = P5 + self.sizes.astype(np.uint64)
            for k in range(min(int(n8.max(initial=0)), LONG // 8 - 1)):
                some = np.flatnonzero(n8 > k)
                lane = _turn(self.lanes[self.starts[some] + 8 * k] * P2, 31) * P1
                h[some] = _turn(h[some] ^ lane, 27) * P1 + P4
            at = self.starts + 8 * np.minimum(n8, LONG // 8 - 1)
            some = np.flatnonzero(left >= 4)
            h[some] = _turn(h[some] ^ ((self.lanes[at[some]] & _BYTES[4]) * P1), 23) * P2 + P3
            at[some] += 4
            left = left % 4
            for k in range(3):
                some = np.flatnonzero(left > k)
                h[some] = _turn(h[some] ^ (self.buf[at[some] + k] * P5), 11) * P1
            h = (h ^ (h >> np.uint64(33))) * P2
            h = (h ^ (h >> np.uint64(29))) * P3
            h ^= h >> np.uint64(32)
        some = np.flatnonzero(self.sizes >= LONG)
        h[some] = np.array([xxhash.xxh64_intdigest(x) for x in self.bytes_of(some)], np.uint64)
        return h

    def equal(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether spans ``a[i]`` and ``b[i]`` hold the same bytes."""
        same = self.sizes[a] == self.sizes[b]
        at, k = np.flatnonzero(same), 0
        while len(at):
            left = self.sizes[a[at]] - k
            differ = (self.lanes[self.starts[a[at]] + k] ^ self.lanes[self.starts[b[at]] + k]) & _BYTES[np.minimum(left, 8)]
            same[at[differ != 0]] = False
            at, k = at[(differ == 0) & (left > 8)], k + 8
        return same


class GramTable:
    """Open-addressed table of the different spans: a bucket and a count a slot."""

    def __init__(self, spans: Spans, buckets: int, keys: np.ndarray | None = None):
        n = len(spans)
        keys = spans.hashes() if keys is None else keys
        size = 1 << max(4, (2 * n - 1).bit_length())
        holder = np.full(size, -1, np.int64)
        place = (keys & np.uint64(size - 1)).astype(np.int64)
        todo = np.arange(n)
        while len(todo):
            at = place[todo]
            free = holder[at] < 0
            holder[at[free]] = todo[free]  # of several, one stays
            held = holder[at]
            same = (keys[held] == keys[todo])
            check = np.flatnonzero(same & (held != todo))
            same[check] = spans.equal(held[check], todo[check])
            todo = todo[~same]
            place[todo] = (place[todo] + 1) & (size - 1)
        used = np.flatnonzero(holder >= 0)
        number = np.zeros(size, np.int64)
        number[used] = np.arange(len(used))
        #: Slot of every occurrence, and what the slots store.
        self.slot = number[place]
        self.bucket = np.array([zlib.crc32(x) for x in spans.bytes_of(holder[used])], np.int64) % buckets
        self.count = np.bincount(self.slot, minlength=len(used))


def _pieces(texts: pa.Array) -> Iterator[tuple]:
    """(first row, words a row, rows, table spans) of a batch, a bounded piece at a time."""
    for i, _, raw, offsets in slabs(texts, PIECE_BYTES):
        words = Words(raw, offsets, GAP)
        sizes = words.ends - words.starts
        yield i, np.diff(words.first), None, None
        for a in range(0, len(words), PIECE_WORDS):
            end, lo = min(a + PIECE_WORDS, len(words)), max(a - WIDEST + 1, 0)
            # The piece's words, lower-case, parted by one space.
            size = sizes[lo:end]
            ends = np.cumsum(size + 1) - 1
            buf = np.full(int(ends[-1]) + 1, 32, np.uint8)
            from_ = np.arange(size.sum()) + np.repeat(words.starts[lo:end] - (np.cumsum(size) - size), size)
            buf[np.arange(size.sum()) + np.repeat(np.arange(len(size)), size)] = LOWER[raw[from_]]
            # An n-gram belongs to the piece that holds its last word.
            last = np.arange(a, end)
            row = words.row[a:end]
            grams = [(last[ok] - w + 1 - lo, last[ok] - lo, row[ok]) for w in range(1, WIDEST + 1) for ok in [last - w + 1 >= words.first[row]]]
            first, final, rows = (np.concatenate(part) for part in zip(*grams))
            yield i, None, rows, Spans(buf, (ends - size)[first], ends[final])


def bucket_counts(texts: DataFrame, text_col: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket's features occur in all texts."""
    def count(batches):
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for _, _, rows, spans in _pieces(b.column(0)):
                if spans is not None:
                    table = GramTable(spans, buckets)
                    total += np.bincount(table.bucket, weights=table.count, minlength=buckets).astype(np.int64)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["bucket", "n"])

    rows = texts.select(F.col(text_col).cast("string").alias("text")).mapInArrow(count, "bucket int, n long")
    out = np.zeros(buckets, np.int64)
    for r in rows.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousand times the log of the smoothed share in the target against the source, floored."""
    buckets, s_all, t_all = len(source), int(source.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((float(t) + 1) * (s_all + buckets) / ((float(s) + 1) * (t_all + buckets))))
                     for s, t in zip(source, target)], np.int64)


def weigh(docs: DataFrame, gains: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_features, weight."""
    buckets = len(gains)

    def run(batches):
        for b in batches:
            n = b.num_rows
            words, features, weight = (np.zeros(n, np.int64) for _ in range(3))
            for i, count, rows, spans in _pieces(b.column(1)):
                if spans is None:
                    words[i:i + len(count)] = count
                    continue
                table = GramTable(spans, buckets)
                got = gains[table.bucket][table.slot]
                size = int(rows.max()) + 1
                features[i:i + size] += np.bincount(rows, minlength=size)
                weight[i:i + size] += np.bincount(rows, weights=got, minlength=size).astype(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(words), pa.array(features), pa.array(weight)],
                                             ["doc_id", "n_words", "n_features", "weight"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, n_words long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, seed: int = 42, buckets: int = BUCKETS,
             id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """Every document's doc_id, n_features, weight, score, and rank (null where not drawn)."""
    spark = docs.sparkSession
    gains = bucket_gains(bucket_counts(docs, text_col, buckets), bucket_counts(target, target_col, buckets))
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    gumbel = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    path = scratch_path(spark, "resampling")
    (weigh(docs, gains, id_col, text_col)
     .select("doc_id", "n_features", "weight", (F.col("weight") + gumbel).alias("score"), (F.col("n_words") >= least_words).alias("fit"))
     .write.parquet(path))
    scored = spark.read.parquet(path)
    drawn = percent * scored.where("fit").count() // 100
    order = F.struct(~F.col("fit"), -F.col("score"), F.col("doc_id").isNull(), "doc_id")
    ranked = row_index(scored.withColumn("place", order), "place", name="rank")
    return ranked.select("doc_id", "n_features", "weight", "score", F.when(F.col("fit") & (F.col("rank") <= drawn), F.col("rank")).alias("rank"))
