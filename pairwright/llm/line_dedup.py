"""Line dedup over levelled sorted runs of line hashes.

``LineRuns`` is a store of line hashes in the shared scratch folder. Each run is
a table bucketed and sorted by hash, one row a hash: how many documents of a
batch hold it, and the largest id among them if no older run held it. A new
batch brings its hashes into the same buckets and is merge-anti-joined with
every live run, bucket by bucket, without moving the runs: hashes that no run
holds are new. Then it adds its own hashes as a run of level 0. When a level has
``FANOUT`` runs they are merged into one run of the next level, again inside the
buckets, so a hash is rewritten once a level and a batch meets few runs however
many came before.

``drop_repeated_lines`` feeds the documents to the store batch by batch, from the
largest ids to the smallest. So the batch in which a hash is new holds its
keeper, the largest id, and the number of documents is the sum over the runs. A
last merge leaves the hashes found in enough documents, and each document loses
its repeated lines.

What moves. A scan task turns texts into (hash, ids that hold it), one row a
hash and batch of Arrow rows, so a line that is in a third of all documents is a
few rows a task; they are written once. The hashes to drop meet the ids by hash
and go back to the documents by id. Batches hold about ``BATCH_DOCS`` documents
(more where that would be over ``MOST_BATCHES`` batches). The driver sees counts
and the batch bounds. Scratch tables go when the lost lines are stored.

Line hashes are 128-bit xxh3. A line's key is the line stripped of
``[\\x20\\x09-\\x0D]`` at both ends with A-Z lower-cased; keys under
``least_chars`` code points never count.

Defined cases: a null or empty text is one empty line; every row counts as a
document, and rows that share the largest id all keep the line; a null id is
smaller than every other, and is the largest only where all are null; a text of
any length is handled whole; an empty table gives no rows; other columns aren't
read.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairwright.session import scratch_path

LEAST_CHARS = 20
LEAST_DOCS = 3
#: Documents of a batch, and batches at most (a batch is then larger).
BATCH_DOCS = 1 << 16
MOST_BATCHES = 64
#: Hashes of a batch in a bucket, and runs of a level that are merged.
BUCKET_ROWS = 1 << 16
FANOUT = 4

_SPACE = b" \t\n\x0b\x0c\r"


def line_hashes(lines: list[bytes], least_chars: int) -> list[bytes | None]:
    """Hash of each line's key, None for keys that are too short."""
    out = []
    for line in lines:
        key = line.strip(_SPACE)
        n = len(key)
        if n >= least_chars and not key.isascii():
            n = len(key.decode())
        out.append(xxhash.xxh3_128_digest(key.lower()) if n >= least_chars else None)
    return out


def _longs(digests: list[bytes]) -> np.ndarray:
    """Two signed longs a digest."""
    return np.frombuffer(b"".join(digests), ">i8").astype(np.int64).reshape(-1, 2)


def hash_rows(docs: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """(h1, h2, ids, batch): one row a hash for each Arrow batch of documents, with the ids that hold it.

    ``docs`` has doc_id (long), text and batch.
    """
    def run(batches):
        for b in batches:
            held: dict[tuple, list] = {}
            for i, text, batch in zip(*(b.column(k).to_pylist() for k in range(3))):
                if text:
                    for h in set(line_hashes(text.encode().split(b"\n"), least_chars)):
                        if h is not None:
                            held.setdefault((batch, h), []).append(i)
            if held:
                longs = _longs([h for _, h in held])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(longs[:, 0]), pa.array(longs[:, 1]), pa.array(list(held.values()), pa.list_(pa.int64())), pa.array([k for k, _ in held], pa.int32())],
                    ["h1", "h2", "ids", "batch"])

    return docs.mapInArrow(run, "h1 long, h2 long, ids array<long>, batch int")


class LineRuns:
    """Levelled runs of line hashes: bucketed, sorted tables of (h1, h2, docs, top)."""

    def __init__(self, spark: SparkSession, buckets: int, fanout: int = FANOUT):
        self.spark, self.buckets, self.fanout = spark, buckets, fanout
        self.folder = scratch_path(spark, "line-runs")
        self.name = "runs_" + self.folder.rsplit("-", 1)[-1]
        self.levels: list[list[str]] = []
        self.made = 0

    def live(self) -> list[str]:
        return [t for level in self.levels for t in level]

    def _store(self, rows: DataFrame) -> str:
        table = f"{self.name}_{self.made}"
        self.made += 1
        (rows.write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").option("path", f"{self.folder}/{table}")
         .format("parquet").saveAsTable(table))
        return table

    def gather(self, rows: DataFrame) -> DataFrame:
        """(h1, h2, docs, top) of rows with ids, one a hash, laid out in the buckets of the runs."""
        each = rows.select("h1", "h2", F.size("ids").cast("long").alias("docs"), F.array_max("ids").alias("top"))
        # No pre-aggregation is lost: a row is already one a hash for a whole Arrow batch of documents.
        return each.repartition(self.buckets, "h1", "h2").groupBy("h1", "h2").agg(F.sum("docs").alias("docs"), F.max("top").alias("top"))

    def fresh(self, batch: DataFrame) -> DataFrame:
        """The rows of ``batch`` whose hash no run holds."""
        return reduce(lambda left, t: left.join(self.spark.table(t).select("h1", "h2").hint("merge"), ["h1", "h2"], "left_anti"), self.live(), batch)

    def add(self, batch: DataFrame) -> str:
        """Add a batch of ``gather`` as a run of level 0.

        The merge with the live runs is the anti-join that marks instead of
        dropping: a hash that an older run holds keeps its count, but its ``top``
        is left to that run.
        """
        older, found = self.live(), F.lit(False)
        for k, t in enumerate(older):
            seen = self.spark.table(t).select("h1", "h2", F.lit(True).alias(f"in_{k}"))
            batch = batch.join(seen.hint("merge"), ["h1", "h2"], "left")
            found = found | F.col(f"in_{k}").isNotNull()
        table = self._store(batch.select("h1", "h2", "docs", F.when(~found, F.col("top")).alias("top")))
        self._level(0).append(table)
        self._compact()
        return table

    def _level(self, k: int) -> list[str]:
        while len(self.levels) <= k:
            self.levels.append([])
        return self.levels[k]

    def _compact(self) -> None:
        k = 0
        while k < len(self.levels):
            if len(self.levels[k]) >= self.fanout:
                full = self.levels[k]
                self._level(k + 1).append(self._store(self.merged(full)))
                self.levels[k] = []
                self._drop(full)
            k += 1

    def merged(self, tables: list[str] | None = None) -> DataFrame:
        """One row a hash over the given runs (all live ones): documents summed, and the one ``top``."""
        # A union of plain columnar scans says that it is laid out in buckets but isn't
        # (Spark 4.1); with a filter, always true here, the scans give rows and it is.
        rows = [self.spark.table(t).where("docs > 0") for t in (self.live() if tables is None else tables)]
        if not rows:
            return self.spark.createDataFrame([], "h1 long, h2 long, docs long, top long")
        return reduce(DataFrame.unionByName, rows).groupBy("h1", "h2").agg(F.sum("docs").alias("docs"), F.max("top").alias("top"))

    def _drop(self, tables: list[str]) -> None:
        for t in tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {t}")
            remove(self.spark, f"{self.folder}/{t}")

    def clean(self) -> None:
        """Remove every run."""
        self._drop(self.live())
        self.levels = []
        remove(self.spark, self.folder)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of ours through Spark's own filesystem."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


# --- the whole table --------------------------------------------------------------

def batch_starts(docs: DataFrame, batch_docs: int) -> list[int]:
    """Smallest id of every batch but the last, from the largest ids down."""
    n = docs.agg(F.count("doc_id")).first()[0]
    batches = min(-(-n // batch_docs), MOST_BATCHES)
    if batches < 2:
        return []
    cut = docs.agg(F.percentile_approx("doc_id", [1 - k / batches for k in range(1, batches)], 1000 * batches)).first()[0]
    return sorted(set(cut), reverse=True)


def repeated_lines(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS,
                   batch_docs: int = BATCH_DOCS, fanout: int = FANOUT) -> DataFrame:
    """(doc_id, lines): hashes (two longs each) of the lines that each document loses; stored."""
    spark = docs.sparkSession
    starts = batch_starts(docs, batch_docs)
    batch = sum((F.coalesce(F.col("doc_id") < s, F.lit(True)).cast("int") for s in starts), F.lit(0))
    folder = scratch_path(spark, "line-hashes")
    (hash_rows(docs.select("doc_id", "text", batch.alias("batch")), least_chars)
     .write.partitionBy("batch").parquet(folder))
    rows = spark.read.schema("h1 long, h2 long, ids array<long>, batch int").parquet(folder)

    # Hash rows are of a whole Arrow batch, so this is at least the number of hashes.
    most = rows.groupBy("batch").count().agg(F.max("count")).first()[0] or 0
    runs = LineRuns(spark, buckets=max(1, min(-(-most // BUCKET_ROWS), 4096)), fanout=fanout)
    for k in range(len(starts) + 1):
        runs.add(runs.gather(rows.where(F.col("batch") == k)))

    often = runs.merged().where(F.col("docs") >= least_docs).drop("docs")
    held = rows.join(often, ["h1", "h2"]).select("h1", "h2", "top", F.explode("ids").alias("doc_id"))
    lost = held.where(~F.col("doc_id").eqNullSafe(F.col("top")))
    path = scratch_path(spark, "lost-lines")
    lost.groupBy("doc_id").agg(F.collect_set(F.struct("h1", "h2")).alias("lines")).write.parquet(path)
    runs.clean()
    remove(spark, folder)
    return spark.read.parquet(path)


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = LEAST_CHARS, **kw) -> DataFrame:
    """doc_id, text without its repeated lines, n_lines, n_dropped."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    lost = repeated_lines(rows, least_chars, **kw).withColumnRenamed("doc_id", "lost_id")

    def cut(batches):
        for b in batches:
            texts, lines, dropped = [], [], []
            for text, gone in zip(b.column("text").to_pylist(), b.column("lines").to_pylist()):
                parts = (text or "").encode().split(b"\n")
                keep = parts
                if gone:
                    digests = {int(g["h1"]).to_bytes(8, "big", signed=True) + int(g["h2"]).to_bytes(8, "big", signed=True) for g in gone}
                    keep = [p for p, h in zip(parts, line_hashes(parts, least_chars)) if h not in digests]
                texts.append(b"\n".join(keep).decode())
                lines.append(len(parts))
                dropped.append(len(parts) - len(keep))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string()), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())],
                                             ["doc_id", "text", "n_lines", "n_dropped"])

    both = rows.join(lost, rows["doc_id"].eqNullSafe(lost["lost_id"]), "left").select("doc_id", "text", "lines")
    return both.mapInArrow(cut, "doc_id long, text string, n_lines long, n_dropped long")


def line_digests(docs: DataFrame, **kw) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256."""
    out = drop_repeated_lines(docs, **kw)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
