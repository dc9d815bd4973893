"""Files whose records no single line ends, read in parallel by byte ranges.

A JSON array file and a CSV file with raw line breaks in quotes can't be cut at
any line: what a byte means depends on whether a quote is open there. Spark's
text reader cuts them into pieces at a sign (``}`` or line feed), split by split.

1. Each split runs the automaton (in quotes or not, nesting depth) over its
   pieces from both start states at once, and gives one row: whether its quotes
   flip the state, and how far the depth moves from either start.
2. Sums over the splits before it give each split's true start. Where quotes
   hold none of the signs, every split starts between two records.
3. Each split cuts its records from its true start. What stands before its first
   record's end, or after its last one, is a fragment; fragments that follow
   each other are joined to a record. There are two a split at most, and nothing
   else moves between tasks. Records and fragments are stored, so the cut runs
   once.
4. ``from_json`` / ``from_csv`` parse the records.

The starts that don't stand between records go to the tasks with the code: one
small entry a split at most (bytes of the files over the split size).

Defined cases: files hold one array of objects, or CSV with doubled quotes
(RFC 4180). Empty files and empty arrays give no rows; empty CSV lines outside
quotes are skipped; a record that doesn't parse has null fields; a header line
is dropped from every file. A compressed file that can't be split is one task.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairwright.session import scratch_path, ship_package
from pairwright.sources.pairs import CSV_OPTIONS, JSON_PAIR_SCHEMA, PAIR_COLUMNS, PAIR_SCHEMA, select_pairs

#: Bytes of a task that reads small splits.
TASK_BYTES = 1 << 24

_ESCAPED = re.compile(r"\\.", re.S)

#: What a piece does: (flips the quotes, depth moved if it starts outside, if inside).
Effect = tuple[bool, int, int]


class JsonArray:
    """One array of objects a file; records end at a closing brace back at depth 1."""

    sign, between, first = "}", (False, 1), (False, 0)

    @staticmethod
    def effect(piece: str) -> Effect:
        text = piece + "}"
        if "\\" in text:
            text = _ESCAPED.sub("", text)
        parts = text.split('"')
        outside, inside = "".join(parts[0::2]), "".join(parts[1::2])
        net = lambda t: t.count("{") + t.count("[") - t.count("}") - t.count("]")
        return len(parts) % 2 == 0, net(outside), net(inside)

    @staticmethod
    def record(text: str) -> str | None:
        at = text.find("{")
        return text[at:] + "}" if at >= 0 else None


class QuotedLines:
    """CSV; records end at a line feed outside quotes."""

    sign, between, first = "\n", (False, 0), (False, 0)

    @staticmethod
    def effect(piece: str) -> Effect:
        return piece.count('"') % 2 == 1, 0, 0

    @staticmethod
    def record(text: str) -> str | None:
        text = text.removesuffix("\r")
        return text or None


def _splits(batches) -> Iterator[tuple[str, int, list[str]]]:
    """Runs of pieces of one split (file, block start)."""
    for b in batches:
        files, blocks, pieces = (b.column(k).to_pylist() for k in range(3))
        at = 0
        for k in range(1, len(files) + 1):
            if k == len(files) or (files[k], blocks[k]) != (files[at], blocks[at]):
                yield files[at], blocks[at], pieces[at:k]
                at = k


def _pieces(spark: SparkSession, path: str, form, split_bytes: int | None) -> DataFrame:
    reader = spark
    if split_bytes:
        # A session of its own: the caller's setting stays.
        reader = spark.newSession()
        reader.conf.set("spark.sql.files.maxPartitionBytes", str(split_bytes))
        reader.conf.set("spark.sql.files.openCostInBytes", "0")
    pieces = reader.read.option("lineSep", form.sign).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    if split_bytes and split_bytes < TASK_BYTES:
        # A task takes several small splits, one after the other.
        tasks = pieces.rdd.getNumPartitions() * split_bytes // TASK_BYTES
        pieces = pieces.coalesce(max(tasks, 4 * spark.sparkContext.defaultParallelism))
    return pieces


def split_effects(pieces: DataFrame, form) -> DataFrame:
    """(file, block, flips, outside, inside): the automaton over each split from both starts."""
    def run(batches):
        now, state = None, None
        def row():
            return pa.RecordBatch.from_pylist([{"file": now[0], "block": now[1], "flips": int(state[0]), "outside": state[1], "inside": state[2]}])
        for file, block, texts in _splits(batches):
            if (file, block) != now:
                if now:
                    yield row()
                now, state = (file, block), (False, 0, 0)
            flipped, outside, inside = state
            for text in texts:
                flips, out, within = form.effect(text)
                outside, inside = outside + (within if flipped else out), inside + (out if flipped else within)
                flipped ^= flips
            state = flipped, outside, inside
        if now:
            yield row()

    return pieces.mapInArrow(run, "file string, block long, flips long, outside long, inside long")


def split_starts(pieces: DataFrame, form) -> dict[tuple[str, int], tuple[bool, int]]:
    """State at the start of the splits that don't start between two records."""
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    rows = split_effects(pieces, form).withColumn("quoted", F.coalesce(F.sum("flips").over(before), F.lit(0)) % 2 == 1)
    moved = F.when(F.col("quoted"), F.col("inside")).otherwise(F.col("outside"))
    rows = rows.withColumn("moved", moved).withColumn("depth", F.coalesce(F.sum("moved").over(before), F.lit(0)))
    quoted, depth = form.between
    off = rows.where((F.col("block") > 0) & ((F.col("quoted") != quoted) | (F.col("depth") != depth)))
    return {(r.file, r.block): (r.quoted, r.depth) for r in off.select("file", "block", "quoted", "depth").collect()}


WHOLE, TAIL, MIDDLE, HEAD = range(4)


def _cut(form, starts: dict, skip_first: bool) -> Callable:
    """Records and fragments of each split, from its true start."""
    def run(batches):
        now, state, held, head, skip = None, None, [], False, False
        out: list[dict] = []

        def leave() -> None:
            if now and held:
                out.append({"file": now[0], "block": now[1], "kind": MIDDLE if head else TAIL, "text": form.sign.join(held) + form.sign})

        for file, block, texts in _splits(batches):
            if (file, block) != now:
                leave()
                now, held = (file, block), []
                state = form.first if block == 0 else starts.get(now, form.between)
                head, skip = state != form.between and block > 0, skip_first and block == 0
            for text in texts:
                held.append(text)
                flips, outside, inside = form.effect(text)
                state = state[0] ^ flips, state[1] + (inside if state[0] else outside)
                if state == form.between:
                    whole = form.sign.join(held)
                    record = (whole + form.sign if form is JsonArray else whole) if head else form.record(whole)
                    if record is not None and not skip:
                        out.append({"file": file, "block": block, "kind": HEAD if head else WHOLE, "text": record})
                    held, head, skip = [], False, False
            if len(out) >= 1000:
                yield pa.RecordBatch.from_pylist(out, schema=_CUT)
                out = []
        leave()
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=_CUT)

    return run


_CUT = pa.schema([("file", pa.string()), ("block", pa.int64()), ("kind", pa.int32()), ("text", pa.string())])


def records(spark: SparkSession, path: str, form, header: bool = False, split_bytes: int | None = None) -> DataFrame:
    """(record): the text of every record of the files."""
    ship_package(spark)
    pieces = _pieces(spark, path, form, split_bytes)
    starts = split_starts(pieces, form)
    cut = pieces.mapInArrow(_cut(form, starts, header), "file string, block long, kind int, text string")
    whole = cut.where(F.col("kind") == WHOLE).select(F.col("text").alias("record"))
    if not starts:
        return whole
    # Both kinds of rows are needed: cut once, stored.
    stored = scratch_path(spark, "cut-records")
    cut.write.parquet(stored)
    cut = spark.read.schema("file string, block long, kind int, text string").parquet(stored)
    whole = cut.where(F.col("kind") == WHOLE).select(F.col("text").alias("record"))
    # A record runs from a tail over whole splits to the next head.
    order = Window.partitionBy("file").orderBy("block", F.col("kind") == TAIL)
    parts = cut.where(F.col("kind") != WHOLE).withColumn("chain", F.sum((F.col("kind") == TAIL).cast("int")).over(order))
    joined = parts.groupBy("file", "chain").agg(F.array_sort(F.collect_list(F.struct("block", (F.col("kind") == TAIL).alias("late"), "text"))).alias("p"))
    text = F.array_join(F.transform("p", lambda e: e["text"]), "")
    if form is JsonArray:
        # Up to its last brace; what follows the array's end has none.
        text = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    else:
        text = F.regexp_replace(text, r"[\r\n]+\z", "")
    return whole.unionByName(joined.select(text.alias("record")).where(F.col("record").contains("{") if form is JsonArray else F.col("record") != ""))


def read_json_array_pairs(spark: SparkSession, path: str, id_col: str | None = "pair_id", split_bytes: int | None = None) -> DataFrame:
    """Pairs of files that hold one JSON array each; a file is read by as many tasks as it has splits.

    ``split_bytes`` sets the split size for this read (the session's by default).
    """
    schema = JSON_PAIR_SCHEMA + (f", {id_col} BIGINT" if id_col else "")
    rows = records(spark, path, JsonArray, split_bytes=split_bytes).select(F.from_json("record", schema).alias("r"))
    return select_pairs(rows.select("r.*"))


def read_quoted_csv_pairs(spark: SparkSession, path: str, header: bool = True, schema: str = PAIR_SCHEMA, split_bytes: int | None = None, **options) -> DataFrame:
    """Pairs of CSV files with raw line breaks inside quotes, without ``multiLine``.

    Columns stand in the order of ``schema``; the header's names aren't read.
    """
    opts = {k: str(v).lower() if isinstance(v, bool) else v for k, v in (CSV_OPTIONS | {"emptyValue": "", "header": False} | options).items()}
    rows = records(spark, path, QuotedLines, header=header, split_bytes=split_bytes).select(F.from_csv("record", schema, opts).alias("r"))
    return rows.select("r.*").select(*PAIR_COLUMNS)
