"""Removal of byte strings of 200 bytes or more that repeat, by sorted suffixes.

Which suffixes are sorted. Of the seeds (``SEED`` bytes) inside every 200-byte
string, the one with the smallest hash, leftmost of equals, is its anchor.
Equal strings have equal anchors at equal places, so only suffixes that start
at an anchor need comparing (about one byte in 85), each with the bytes before
it: a repeated string shows as two anchors whose common bytes to the left and
to the right add up to 200.

1. Anchors are range-partitioned by (seed, context) with Spark's sampled
   splitters and sorted in each task; a seed in very many texts spreads over
   tasks. Seeds without an equal neighbour go. What lies on either side of a
   task's edge is compared through one summary row a task.
2. Anchors whose whole context (168 bytes before, 200 from the seed) occurs
   twice are covered; of the others, and one of each covered context, the
   contexts are fetched from the texts and grouped by seed.
3. In a group the suffixes are sorted by multikey sort, eight bytes at a time,
   once forward and once backward. For every offset o, two anchors share the
   string that starts o bytes before them if they are equal in o bytes
   backward and 200 - o forward; both are class numbers read off the sorted
   neighbours, so the test is exact and takes no pairs.
4. Groups above ``GROUP`` contexts would burden one task: their strings are
   counted one by one by a 128-bit digest instead, combined before the shuffle.
5. Each text gets its covered ranges and loses them.

Texts are keyed by a 128-bit digest: equal texts lose the same bytes.

Defined cases: a null text is empty; texts under 200 bytes lose nothing;
repeated rows count as repeats of their whole text; a null id is an id like
others; an empty table gives no rows; other columns of the input are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwright.llm.near_dedup import whole_groups
from pairwright.llm.textvec import BYTE_CODES, mix64, powers, slabs, small_batches
from pairwright.session import checkpoint_root, scratch_path, ship_package

LENGTH = 200
SEED = 32
BACK = LENGTH - SEED
#: Contexts of one seed compared in one task; larger groups go by digests.
GROUP = 20_000
#: Contexts compared at once (whole groups).
BATCH = 20_000
_POS = 28


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive entries."""
    n = len(x) - width + 1
    if n <= 0:
        return x[:0]
    padded = np.concatenate([x, np.full(-len(x) % width, np.iinfo(x.dtype).max, x.dtype)]).reshape(-1, width)
    left = np.minimum.accumulate(padded, axis=1).ravel()
    right = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[width - 1:width - 1 + n])


def anchors(raw: np.ndarray, offsets: np.ndarray):
    """(row, place in the text, seed hash, context hash, bytes back, bytes on) of all anchors of a slab."""
    none = tuple(np.zeros(0, np.int64) for _ in range(6))
    if len(raw) < LENGTH:
        return none
    pw, inv = powers(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(BYTE_CODES[raw] * pw[:-1], out=sums[1:], dtype=np.uint64)
    seed = mix64((sums[SEED:] - sums[:-SEED]) * inv[:len(raw) - SEED + 1])
    place = np.arange(len(seed), dtype=np.uint64)
    key = ((seed >> np.uint64(_POS)) << np.uint64(_POS)) | place
    least = sliding_min(key, LENGTH - SEED + 1)
    # A string must lie inside one text.
    end = np.repeat(offsets[1:], np.diff(offsets))[:len(least)]
    starts = np.arange(len(least)) + LENGTH <= end
    at = np.unique((least[starts] & np.uint64((1 << _POS) - 1)).astype(np.int64))
    if not len(at):
        return none
    row = np.searchsorted(offsets, at, side="right") - 1
    back = np.minimum(at - offsets[row], BACK)
    on = np.minimum(offsets[row + 1] - at, LENGTH)
    context = mix64(mix64((sums[at + on] - sums[at - back]) * inv[at - back]) + (back * 1000 + on).astype(np.uint64))
    return row, at - offsets[row], seed[at].view(np.int64), context.view(np.int64), back, on


def _anchor_rows(texts: DataFrame) -> DataFrame:
    def run(batches):
        for b in batches:
            digest = b.column("digest")
            for i, _, raw, offsets in slabs(b.column("t")):
                row, at, seed, context, back, on = anchors(raw, offsets)
                if len(at):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(seed), pa.array(context), digest.take(pa.array(row + i)), pa.array(at.astype(np.int32)), pa.array((at - back).astype(np.int32)), pa.array((at + on).astype(np.int32))],
                        ["seed", "context", "digest", "at", "a", "b"])

    return texts.mapInArrow(run, "seed long, context long, digest binary, at int, a int, b int")


def _keep_shared(batches):
    """Rows with an equal seed next to them, and the outer rows of the task."""
    held, sent, first = None, False, True
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b] if held is None else [held, b])
        k = t.column("seed").to_numpy()
        same = np.zeros(len(k) + 1, bool)
        same[1:-1] = k[1:] == k[:-1]
        ok = same[1:] | same[:-1]
        if first:
            ok[0], first = True, False
        elif sent:
            ok[0] = False
        sent = bool(ok[-1])
        held = t.slice(len(k) - 1).combine_chunks().to_batches()[0]
        yield from t.filter(pa.array(ok)).combine_chunks().to_batches()
    if held is not None and not sent:
        yield held


def _edges(batches):
    first = last = None
    for b in batches:
        if not b.num_rows:
            continue
        seed, context = b.column("seed").to_numpy(), b.column("context").to_numpy()
        if first is None:
            first, head_end, tail_seed, tail_start = (seed[0], context[0]), context[0], seed[0], context[0]
        if last is None or seed[0] == first[0]:
            run = np.flatnonzero(seed == first[0])
            if len(run) and (last is None or last[0] == first[0]):
                head_end = context[run[-1]]
        if seed[-1] != tail_seed:
            tail_seed, tail_start = seed[-1], context[np.flatnonzero(seed == seed[-1])[0]]
        last = (seed[-1], context[-1])
    if first is not None:
        values = [TaskContext.get().partitionId(), *first, head_end, last[0], tail_start, last[1]]
        yield pa.RecordBatch.from_arrays([pa.array([int(v)], pa.int64()) for v in values], ["p", "s1", "c1", "c1_end", "s2", "c2_start", "c2"])


def resolve_edges(rows: list) -> dict[int, tuple[bool, bool, bool, bool]]:
    """Per task: its first row equals the row before, its last row the row after,
    and whether its first and its last seed have several contexts overall."""
    rows = sorted(rows, key=lambda r: r.p)
    n = len(rows)
    joined = [k + 1 < n and rows[k].s2 == rows[k + 1].s1 for k in range(n)]
    step = [joined[k] and rows[k].c2 != rows[k + 1].c1 for k in range(n)]
    upto, since = [False] * n, [False] * n
    for k in range(n):
        r = rows[k]
        upto[k] = r.c2_start != r.c2 or (r.s1 == r.s2 and k > 0 and joined[k - 1] and (upto[k - 1] or step[k - 1]))
    for k in reversed(range(n)):
        r = rows[k]
        since[k] = r.c1 != r.c1_end or (r.s1 == r.s2 and joined[k] and (since[k + 1] or step[k]))
    out = {}
    for k, r in enumerate(rows):
        before, after = k > 0 and joined[k - 1], joined[k]
        out[r.p] = (before and not step[k - 1], after and not step[k],
                    since[k] or (before and (upto[k - 1] or step[k - 1])), upto[k] or (after and (since[k + 1] or step[k])))
    return out


def _sort_out(shared: DataFrame) -> DataFrame:
    """Covered ranges (seed null) and the contexts that need comparing (one row each)."""
    edges = resolve_edges(shared.select("seed", "context").mapInArrow(_edges, "p long, s1 long, c1 long, c1_end long, s2 long, c2_start long, c2 long").collect())

    def run(batches):
        table = pa.Table.from_batches(list(batches)) if edges.get(TaskContext.get().partitionId()) else None
        if table is None or not len(table):
            return
        equal_before, equal_after, first_several, last_several = edges[TaskContext.get().partitionId()]
        seed, context = table.column("seed").to_numpy(), table.column("context").to_numpy()
        n = len(seed)
        new_seed = np.ones(n + 1, bool)
        new_seed[1:-1] = seed[1:] != seed[:-1]
        new = new_seed.copy()
        new[1:-1] |= context[1:] != context[:-1]
        lone = new[:-1] & new[1:]
        if equal_before:
            lone[0] = False
        if equal_after:
            lone[-1] = False
        group = np.cumsum(new_seed[:-1]) - 1
        several = np.bincount(group, new[:-1] & ~new_seed[:-1]) > 0
        several[0] |= first_several
        several[-1] |= last_several
        pick = new[:-1] & several[group]
        if equal_before:
            pick[0] = False
        cut = table.drop_columns(["context"])
        covered = cut.filter(pa.array(~lone))
        if len(covered):
            yield from covered.set_column(0, "seed", pa.nulls(len(covered), pa.int64())).append_column("several", pa.array(np.ones(len(covered), bool))).combine_chunks().to_batches()
        if pick.any():
            yield from cut.filter(pa.array(pick)).append_column("several", pa.array(~lone[pick])).combine_chunks().to_batches()

    return shared.mapInArrow(run, "seed long, digest binary, at int, a int, b int, several boolean")


def _squeezed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, digest and the compressed text of every row: what the two joins move."""
    rows = _texts(docs, id_col, text_col)
    id_type = dict(rows.dtypes)["doc_id"]

    def run(batches):
        press = zstandard.ZstdCompressor(level=1).compress
        for b in batches:
            z = [press(t.encode("utf-8", "replace")) if t else b"" for t in b.column("t").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("digest"), pa.array(z, pa.binary())], ["doc_id", "digest", "z"])

    return rows.mapInArrow(run, f"doc_id {id_type}, digest binary, z binary")


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    t = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), F.unhex(F.md5(t)).alias("digest"), t.alias("t"))


def _unpress(z: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(z) if z else b""


def _contexts(squeezed: DataFrame, wanted: DataFrame) -> DataFrame:
    """The bytes before and from each wanted anchor."""
    places = wanted.groupBy("digest").agg(F.collect_list(F.struct("seed", "at", "a", "b", "several")).alias("places")).checkpoint()

    def run(batches):
        done: set[tuple[bytes, int]] = set()
        for b in batches:
            out = []
            for digest, z, places in zip(b.column("digest").to_pylist(), b.column("z").to_pylist(), b.column("places").to_pylist()):
                fresh = [p for p in places if (digest, p["at"]) not in done]
                if fresh:
                    text = _unpress(z)
                    for p in fresh:
                        done.add((digest, p["at"]))
                        out.append((p["seed"], digest, p["at"], p["several"], text[p["a"]:p["at"]][::-1], text[p["at"]:p["b"]]))
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(), pa.binary(), pa.int32(), pa.bool_(), pa.binary(), pa.binary()))],
                    ["seed", "digest", "at", "several", "back", "on"])

    joined = squeezed.select("digest", "z").join(places, "digest")
    return joined.mapInArrow(run, "seed long, digest binary, at int, several boolean, back binary, on binary")


def _matrix(values: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    size = np.array([len(v) for v in values], np.int64)
    flat = np.frombuffer(b"".join(values), np.uint8)
    out = np.zeros((len(values), width), np.uint8)
    out[np.repeat(np.arange(len(values)), size), np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out, size


def multikey_order(m: np.ndarray, size: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Order of the rows by (group, bytes, size): eight bytes at a time, only among rows still equal."""
    words = np.ascontiguousarray(np.pad(m, ((0, 0), (0, -m.shape[1] % 8)))).view(">u8").astype(np.uint64)
    order = np.argsort(group, kind="stable")
    cls = group[order]
    tied = np.ones(len(order), bool)
    for t in range(words.shape[1] + 1):
        same = np.zeros(len(order) + 1, bool)
        same[1:-1] = cls[1:] == cls[:-1]
        tied = same[1:] | same[:-1]
        at = np.flatnonzero(tied)
        if not len(at):
            break
        key = words[order[at], t] if t < words.shape[1] else size[order[at]].astype(np.uint64)
        by = np.lexsort((key, cls[at]))
        order[at] = order[at][by]
        key = key[by]
        # Equal class and key stay one class; classes are renumbered by place.
        c = cls[at]
        change = np.zeros(len(order), bool)
        change[0] = True
        change[1:] = cls[1:] != cls[:-1]
        change[at[1:]] |= (key[1:] != key[:-1]) | (c[1:] != c[:-1])
        cls = np.cumsum(change)
    return order


def _common(m: np.ndarray, size: np.ndarray, group: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Common bytes of each sorted row with the one before; -1 at a group's first."""
    out = np.full(len(order), -1, np.int64)
    for i in range(1, len(order), 4096):
        a, b = order[i - 1:i + 4095][:len(order[i:i + 4096])], order[i:i + 4096]
        differ = m[a] != m[b]
        lcp = np.where(differ.any(axis=1), differ.argmax(axis=1), m.shape[1])
        out[i:i + 4096] = np.where(group[a] == group[b], np.minimum(lcp, np.minimum(size[a], size[b])), -1)
    return out


def shared_offsets(back: list[bytes], on: list[bytes], group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest and largest offset at which another row of the group has the same string (-1: none)."""
    x, xn = _matrix(back, BACK)
    y, yn = _matrix(on, LENGTH)
    n = len(group)
    xo, yo = multikey_order(x, xn, group), multikey_order(y, yn, group)
    xc, yc = _common(x, xn, group, xo), _common(y, yn, group, yo)
    low, high = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
    cx, cy = np.empty(n, np.int64), np.empty(n, np.int64)
    for o in range(BACK + 1):
        ok = (xn >= o) & (yn >= LENGTH - o)
        if ok.sum() < 2:
            continue
        cx[xo] = np.cumsum(xc < o)
        cy[yo] = np.cumsum(yc < LENGTH - o)
        rows = np.flatnonzero(ok)
        _, inv, count = np.unique(cx[rows] * (n + 1) + cy[rows], return_inverse=True, return_counts=True)
        hit = rows[count[inv] > 1]
        low[hit] = np.where(low[hit] < 0, o, low[hit])
        high[hit] = o
    return low, high


def _compare(batches):
    """Ranges (digest, a, b) that the anchors of whole groups cover."""
    def work(tables):
        t = pa.concat_tables(tables)
        group = np.unique(t.column("seed").to_numpy(), return_inverse=True)[1]
        back, on = t.column("back").to_pylist(), t.column("on").to_pylist()
        low, high = shared_offsets(back, on, group)
        pick = (high >= 0) & ~t.column("several").to_numpy()
        at = t.column("at").to_numpy().astype(np.int64)
        if pick.any():
            yield pa.RecordBatch.from_arrays(
                [t.column("digest").filter(pa.array(pick)).combine_chunks(), pa.array((at - high)[pick].astype(np.int32)), pa.array((at - low + LENGTH)[pick].astype(np.int32))],
                ["digest", "a", "b"])

    held, size = [], 0
    for t, bounds in whole_groups(batches, "seed"):
        held.append(t)
        size += len(t)
        if size >= BATCH:
            yield from work(held)
            held, size = [], 0
    if held:
        yield from work(held)


def _compare_large(contexts: DataFrame) -> DataFrame:
    """The same ranges for groups too large for one task: strings counted by digest."""
    rows = contexts.select(
        "seed", "digest", "at", "several",
        F.explode(F.sequence(F.greatest(F.lit(0), LENGTH - F.octet_length("on")), F.octet_length("back"))).alias("o"), "back", "on")
    # The bytes before are stored backward; equal backward means equal forward.
    piece = F.md5(F.concat(F.substring("back", F.lit(1), F.col("o")), F.substring("on", F.lit(1), LENGTH - F.col("o"))))
    rows = rows.select("seed", "digest", "at", "several", "o", F.unhex(piece).alias("s"))
    twice = rows.groupBy("seed", "o", "s").agg(F.count("*").alias("n")).where("n > 1").select("seed", "o", "s").checkpoint()
    hits = rows.where("not several").join(twice, ["seed", "o", "s"])
    return hits.groupBy("digest", "at").agg(F.min("o").alias("low"), F.max("o").alias("high")).select(
        "digest", (F.col("at") - F.col("high")).alias("a"), (F.col("at") - F.col("low") + LENGTH).alias("b"))


def repeated_ranges(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", group_limit: int = GROUP) -> DataFrame:
    """(digest, a, b): byte ranges of each distinct text to remove; they may overlap."""
    spark = docs.sparkSession
    small_batches(spark)
    ship_package(spark)
    checkpoint_root(spark)
    order = ["seed", "context", "digest", "at"]
    rows = _anchor_rows(_texts(docs, id_col, text_col).select("digest", "t"))
    shared = rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_keep_shared, rows.schema).checkpoint()
    path = scratch_path(spark, "anchors")
    _sort_out(shared).write.parquet(path)
    sorted_out = spark.read.parquet(path)
    covered = sorted_out.where("seed is null").select("digest", "a", "b")
    wanted = sorted_out.where("seed is not null")
    # Columns are few and groups are counted before the shuffle.
    large = wanted.groupBy("seed").agg(F.count("*").alias("n")).where(F.col("n") > group_limit).select("seed").checkpoint()
    contexts = _contexts(_squeezed(docs, id_col, text_col), wanted)
    if large.isEmpty():
        found = contexts.repartition("seed").sortWithinPartitions("seed", "digest", "at").mapInArrow(_compare, "digest binary, a int, b int")
    else:
        path = scratch_path(spark, "contexts")
        contexts.write.parquet(path)
        contexts = spark.read.parquet(path)
        small = contexts.join(large, "seed", "left_anti").repartition("seed").sortWithinPartitions("seed", "digest", "at")
        found = small.mapInArrow(_compare, "digest binary, a int, b int").unionByName(_compare_large(contexts.join(large, "seed", "left_semi").dropDuplicates(["digest", "at"])))
    return covered.unionByName(found).distinct()


def _merge(ranges: list[dict]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for r in sorted((r["a"], r["b"]) for r in ranges):
        if out and r[0] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], r[1])
        else:
            out.append(list(r))
    return [(a, b) for a, b in out]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", group_limit: int = GROUP) -> DataFrame:
    """doc_id, kept (the remaining bytes), n_bytes, n_removed, n_spans of every row."""
    ranges = repeated_ranges(docs, id_col, text_col, group_limit)
    per_text = ranges.groupBy("digest").agg(F.collect_list(F.struct("a", "b")).alias("ranges")).checkpoint()
    joined = _squeezed(docs, id_col, text_col).join(per_text, "digest", "left").select("doc_id", "z", "ranges")
    id_type = dict(joined.dtypes)["doc_id"]

    def run(batches):
        for b in batches:
            kept, size, removed, spans = [], [], [], []
            for z, ranges in zip(b.column("z").to_pylist(), b.column("ranges").to_pylist()):
                text = _unpress(z)
                runs = _merge(ranges or [])
                at, parts = 0, []
                for s, e in runs:
                    parts.append(text[at:s])
                    at = e
                parts.append(text[at:])
                kept.append(b"".join(parts))
                size.append(len(text))
                removed.append(sum(e - s for s, e in runs))
                spans.append(len(runs))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(kept, pa.binary()), pa.array(size, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64())],
                ["doc_id", "kept", "n_bytes", "n_removed", "n_spans"])

    return joined.mapInArrow(run, f"doc_id {id_type}, kept binary, n_bytes long, n_removed long, n_spans long")


def removal_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", group_limit: int = GROUP) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    out = remove_repeats(docs, id_col, text_col, group_limit)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
