"""Near-duplicate groups by MinHash bands verified with odd sketches.

1. Each text becomes its set of word 5-grams (64-bit hashes; fewer words: the
   whole sequence as one). Equal sets are one class, named by a 128-bit digest.
2. ``HASHES`` MinHash samples a class give band keys and an odd sketch: every
   sample flips one bit, so the XOR of two sketches keeps only the samples
   that differ, and its population count estimates the similarity.
3. Band rows are range-partitioned by (key, class), so a key shared by very
   many classes spreads over tasks; keys with one member go.
4. Inside a bucket the sketches of all members are compared in blocks of
   ``BLOCK`` members; pairs whose estimate could belong to the threshold
   join into candidate groups. A block returns a forest of at most one link a
   member, never its pairs.
5. Candidate groups are confirmed on the full sets, again in blocks: the sizes
   of all intersections of a block are one product of 0/1 matrices, so the
   check is exact. Links that pass give the components.

A group larger than a block is cut into blocks and every two blocks meet in a
task of their own, so no task holds more than two blocks of sets and no pair
is left out.

Recall: a pair at similarity 0.85 shares none of the bands with probability
(1 - 0.85**6)**32 < 3e-7, and fails the sketch bound with about 1e-5 (4.4
standard deviations of the estimate); both fall fast above 0.85.

Defined cases: a text without words (or null) has an empty set, is linked with
nothing and kept; a row without an id cannot name a component, so it is linked
with nothing, has a null component and is kept; repeated rows have equal sets
and share a component (all rows that carry the component's id count as kept);
an empty table gives no rows; other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwright.llm.components import components
from pairwright.llm.textvec import Words, mix64, slabs, small_batches, span_hashes, window_hashes, windows_in_rows
from pairwright.session import checkpoint_root, scratch_path, ship_package

WIDTH = 5
ROWS, BANDS = 6, 32
HASHES = ROWS * BANDS
SKETCH_BITS = 1024
#: Largest XOR population count of a candidate: the expected 54 at similarity
#: 0.85 plus 4.4 standard deviations (samples 8.8, folding 2).
MAX_XOR = 94
BLOCK = 256
#: Columns of 0/1 matrices multiplied at once.
COLUMNS = 8192

_RNG = np.random.Generator(np.random.PCG64(51))
_XOR = _RNG.integers(0, 2**32, HASHES, dtype=np.uint64).astype(np.uint32)
_MUL = _RNG.integers(0, 2**32, HASHES, dtype=np.uint64).astype(np.uint32) | np.uint32(1)


def shingles(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct shingles of every text of a slab, by row then hash."""
    words = Words(raw, offsets)
    h = span_hashes(raw, words.starts, words.ends)
    start, row = windows_in_rows(words.first, WIDTH)
    hashes = window_hashes(h, WIDTH)[start]
    n = np.diff(words.first)
    for k in np.flatnonzero((n > 0) & (n < WIDTH)):
        one = window_hashes(h[words.first[k]:words.first[k + 1]], int(n[k]))
        hashes = np.concatenate([hashes, mix64(one + np.uint64(n[k]))])
        row = np.concatenate([row, [k]])
    order = np.lexsort((hashes, row))
    row, hashes = row[order], hashes[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (hashes[1:] != hashes[:-1])
    return row[new], hashes[new]


def set_digests(hashes: np.ndarray, begin: np.ndarray) -> list[bytes]:
    """Order-free 128-bit digest of each set."""
    halves = [np.add.reduceat(mix64(hashes ^ np.uint64(c)), begin) for c in (0x1F83D9ABFB41BD6B, 0x5BE0CD19137E2179)]
    both = np.stack([mix64(halves[0]), mix64(halves[1] ^ halves[0])], axis=1).astype("<u8")
    return [x.tobytes() for x in both]


def signatures(hashes: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(band keys, odd sketches as 64-bit words) of each set."""
    sets = len(begin)
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    mins = np.empty((sets, HASHES), np.uint32)
    for k in range(HASHES):
        mins[:, k] = np.minimum.reduceat((x ^ _XOR[k]) * _MUL[k], begin)
    keys = np.empty((sets, BANDS), np.uint64)
    for b in range(BANDS):
        key = np.full(sets, b + 1, np.uint64)
        for k in range(b * ROWS, (b + 1) * ROWS):
            key = key * np.uint64(0x100000001B3) + mins[:, k].astype(np.uint64)
        keys[:, b] = mix64(key)
    at = (mix64(mins.astype(np.uint64) + (np.arange(HASHES, dtype=np.uint64) << np.uint64(32))) % np.uint64(SKETCH_BITS)).astype(np.int64)
    flips = np.bincount((at + np.arange(sets)[:, None] * SKETCH_BITS).ravel(), minlength=sets * SKETCH_BITS).reshape(sets, -1) & 1
    sketch = np.packbits(flips.astype(np.uint8), axis=1).view("<u8")
    return keys.view(np.int64), sketch


def _signed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, n, cls, bands, sketch of every row (cls null: no set, or no id)."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("t"))
    id_type = dict(rows.dtypes)["doc_id"]

    def run(batches):
        for b in batches:
            ids = b.column("doc_id")
            for i, j, raw, offsets in slabs(b.column("t")):
                row, hashes = shingles(raw, offsets)
                n = np.bincount(row, minlength=j - i)
                cls, bands, sketch = [None] * (j - i), [None] * (j - i), [None] * (j - i)
                has = np.flatnonzero(n)
                if len(has):
                    begin = np.searchsorted(row, has)
                    keys, odd = signatures(hashes, begin)
                    for at, digest, kk, o in zip(has, set_digests(hashes, begin), keys, odd):
                        if ids[i + int(at)].is_valid:
                            cls[at], bands[at], sketch[at] = digest, kk, o.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(i, j - i), pa.array(n, pa.int64()), pa.array(cls, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketch, pa.binary())],
                    ["doc_id", "n", "cls", "bands", "sketch"])

    return rows.mapInArrow(run, f"doc_id {id_type}, n long, cls binary, bands array<long>, sketch binary")


def whole_groups(batches, key: str = "g") -> Iterator[tuple[pa.Table, np.ndarray]]:
    """(rows, group bounds) of complete groups from batches sorted by ``key``."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        g = b.column(key).to_numpy(zero_copy_only=False)
        if held and held[-1].column(key)[-1].as_py() == g[-1] == g[0]:
            held.append(b)
            continue
        cut = int(np.flatnonzero(g != g[-1])[-1]) + 1 if g[0] != g[-1] else 0
        held.append(b.slice(0, cut))
        yield _bounded(pa.Table.from_batches(held), key)
        held = [b.slice(cut)]
    if held:
        yield _bounded(pa.Table.from_batches(held), key)


def _bounded(t: pa.Table, key: str) -> tuple[pa.Table, np.ndarray]:
    g = t.column(key).to_numpy()
    return t, np.concatenate([[0], np.flatnonzero(g[1:] != g[:-1]) + 1, [len(g)]]) if len(g) else np.zeros(1, np.int64)


def forest(linked: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each row of a symmetric boolean matrix."""
    n = len(linked)
    label = np.arange(n)
    while True:
        new = np.minimum(label, np.where(linked, label[None, :], n).min(axis=1))
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


def _shared_keys(reps: DataFrame) -> DataFrame:
    """(key, cls) of the band keys that at least two classes share.

    After range partitioning by (key, cls) and sorting, a key held once has no
    equal neighbour. The outer keys of each task are kept, as their other
    members may lie in the next task.
    """
    rows = reps.select(F.explode("bands").alias("key"), "cls")

    def keep(batches):
        held, sent, first = None, False, True  # the last row seen; whether it is out already
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b] if held is None else [held, b])
            k = t.column("key").to_numpy()
            same = np.zeros(len(k) + 1, bool)
            same[1:-1] = k[1:] == k[:-1]
            ok = same[1:] | same[:-1]
            if first:
                ok[0] = True
                first = False
            elif sent:
                ok[0] = False
            # The last row waits for its right neighbour; if it already has a left one it goes now.
            sent = bool(ok[-1]) if len(k) > 1 else (True if held is None else sent)
            held = t.slice(len(k) - 1).combine_chunks().to_batches()[0]
            out = t.filter(pa.array(ok))
            yield from out.combine_chunks().to_batches()
        if held is not None and not sent:
            yield held

    return rows.repartitionByRange("key", "cls").sortWithinPartitions("key", "cls").mapInArrow(keep, "key long, cls binary")


def _blocks(members: DataFrame, group: str) -> DataFrame:
    """One row for each task of a member: ``g`` names the block, or the two blocks, that meet."""
    sizes = members.groupBy(group).agg(F.count("*").alias("size")).where("size > 1").checkpoint()
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("cls"), blocks).cast("int")
    rows = members.join(sizes, group).withColumn("k", blocks).withColumn("own", own)
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.greatest(F.col("k") - 1, F.lit(0)))))
    return rows.withColumn("g", F.xxhash64(group, F.least("own", "other"), F.greatest("own", "other"), "k"))


def _sketch_links(members: DataFrame) -> DataFrame:
    """Forest links (a, b) of the pairs in a bucket whose sketches are near."""
    def run(batches):
        for t, bounds in whole_groups(batches):
            sizes = np.diff(bounds)
            raw = b"".join(t.column("sketch").to_pylist())
            words = np.frombuffer(raw, "<u8").reshape(len(t), -1)
            n = t.column("n").to_numpy()
            left, right = [], []
            two = bounds[:-1][sizes == 2]
            near = np.bitwise_count(words[two] ^ words[two + 1]).sum(axis=1) <= MAX_XOR
            near &= 100 * np.minimum(n[two], n[two + 1]) >= 85 * np.maximum(n[two], n[two + 1])
            left.append(two[near] + 1)
            right.append(two[near])
            for at in np.flatnonzero(sizes > 2):
                s, e = bounds[at], bounds[at + 1]
                w, m = words[s:e], n[s:e]
                close = 100 * np.minimum(m[:, None], m) >= 85 * np.maximum(m[:, None], m)
                for i in range(0, e - s, 64):
                    close[i:i + 64] &= np.bitwise_count(w[i:i + 64, None] ^ w[None]).sum(axis=2) <= MAX_XOR
                root = forest(close)
                moved = np.flatnonzero(root != np.arange(e - s))
                left.append(s + moved)
                right.append(s + root[moved])
            a, b = np.concatenate(left), np.concatenate(right)
            if len(a):
                cls = t.column("cls").combine_chunks()
                yield pa.RecordBatch.from_arrays([cls.take(pa.array(a)), cls.take(pa.array(b))], ["a", "b"])

    rows = _blocks(members, "key").select("g", "cls", "n", "sketch")
    return rows.repartition("g").sortWithinPartitions("g", "cls").mapInArrow(run, "a binary, b binary").distinct()


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections of sorted distinct arrays."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    ids, inv, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(n), sizes)
    shared = count > 1
    number = np.cumsum(shared) - 1
    use = shared[inv]
    row, col = row[use], number[inv[use]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    out = np.zeros((n, n), np.int64)
    width = int(shared.sum())
    for c in range(0, width, COLUMNS):
        lo, hi = np.searchsorted(col, [c, c + COLUMNS])
        m = np.zeros((n, min(COLUMNS, width - c)), np.float32)
        m[row[lo:hi], col[lo:hi] - c] = 1
        out += np.rint(m @ m.T).astype(np.int64)
    np.fill_diagonal(out, sizes)
    return out


def _confirmed_links(members: DataFrame, percent: int) -> DataFrame:
    """Forest links of the pairs of a candidate group that hold on the full sets."""
    def run(batches):
        for t, bounds in whole_groups(batches):
            cls = t.column("cls").combine_chunks()
            column = t.column("sh").combine_chunks()
            offsets, values = column.offsets.to_numpy(), column.values.to_numpy()
            left, right = [], []
            for s, e in zip(bounds[:-1], bounds[1:]):
                if e - s < 2:
                    continue
                inter = intersections([values[offsets[i]:offsets[i + 1]] for i in range(s, e)])
                n = np.diag(inter)
                root = forest(100 * inter >= percent * (n[:, None] + n - inter))
                moved = np.flatnonzero(root != np.arange(e - s))
                left.append(s + moved)
                right.append(s + root[moved])
            a = np.concatenate(left) if left else np.zeros(0, np.int64)
            if len(a):
                yield pa.RecordBatch.from_arrays([cls.take(pa.array(a)), cls.take(pa.array(np.concatenate(right)))], ["a", "b"])

    rows = _blocks(members, "root").select("g", "cls", "sh")
    return rows.repartition("g").sortWithinPartitions("g", "cls").mapInArrow(run, "a binary, b binary").distinct()


def _sets(texts: DataFrame) -> DataFrame:
    """(cls, sh) of the given texts; sh is the sorted set."""
    def run(batches):
        for b in batches:
            for _, _, raw, offsets in slabs(b.column("t")):
                row, hashes = shingles(raw, offsets)
                has = np.unique(row)
                if len(has):
                    begin = np.searchsorted(row, has)
                    sh = pa.ListArray.from_arrays(pa.array(np.append(begin, len(row)).astype(np.int32)), pa.array(hashes.view(np.int64)))
                    yield pa.RecordBatch.from_arrays([pa.array(set_digests(hashes, begin), pa.binary()), sh], ["cls", "sh"])

    return texts.select("t").mapInArrow(run, "cls binary, sh array<long>")


def near_groups(docs: DataFrame, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row."""
    spark = docs.sparkSession
    small_batches(spark)
    ship_package(spark)
    checkpoint_root(spark)
    path = scratch_path(spark, "signatures")
    _signed(docs, id_col, text_col).write.parquet(path)
    signed = spark.read.parquet(path)

    # One row a class; the row of the smallest id stands for it when texts are fetched.
    path = scratch_path(spark, "classes")
    signed.where("cls is not null").groupBy("cls").agg(
        F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"),
    ).write.parquet(path)
    reps = spark.read.parquet(path)

    shared = _shared_keys(reps).checkpoint()
    members = shared.join(reps.select("cls", "n", "sketch"), "cls")
    groups = components(_sketch_links(members)).withColumnsRenamed({"node": "cls"}).checkpoint()

    wanted = reps.select("cls", "doc_id").join(groups.select("cls"), "cls", "left_semi").select("doc_id")
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("t")).join(wanted, "doc_id", "left_semi")
    sets = _sets(texts).dropDuplicates(["cls"])
    links = _confirmed_links(groups.join(sets, "cls"), percent)
    roots = components(links).withColumnsRenamed({"node": "cls"})

    named = reps.select("cls", "doc_id").join(roots, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    first = named.groupBy("root").agg(F.min("doc_id").alias("component_id")).checkpoint()
    named = named.select("cls", "root").checkpoint().join(first, "root").select("cls", "component_id").checkpoint()
    out = signed.select("doc_id", "n", "cls").join(named, "cls", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
