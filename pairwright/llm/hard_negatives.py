"""Hard negatives by an STR-packed R-tree over integer vectors.

1. A bounded sample gives the splitters of the upper level: Sort-Tile-Recursive
   cuts along the coordinates of widest spread, with (value, hash of the id) as
   the sort key, so that a vector held by very many rows is cut like any other.
   Every row goes to one tile.
2. A task streams its tiles. It packs each run of at most ``PACK_ROWS`` rows of
   a tile into an R-tree (STR again, leaves of ``LEAF`` rows, ``FANOUT`` boxes
   a node). A box gives, coordinate by coordinate, an interval of the inner
   product with an anchor; nodes leave a best-first queue by their upper end.
   Boxes outside the score windows, or strictly below the k-th score found so
   far, are not opened.
3. Two searches: the first positives of each anchor, then the negatives within
   the score window of each (anchor, positive). Each task keeps the best of its
   tiles; Spark merges them by anchor.

Anchors are a stated query set. They go to the tasks in blocks of
``ANCHOR_BLOCK``: a task holds one block and one pack at a time, whatever the
table's size. Nothing is broadcast; the driver sees the row count, the largest
dimension and the sample (``SAMPLE_ROWS`` at most).

Defined cases. Components are floor(256 * x), held within +-2**24 so that a
score fits 63 bits up to 16,384 dimensions. A shorter vector counts as padded
with zeros, an empty one as all zeros. Rows with a null label, a null vector or
a null or non-finite component take no part. A null id comes after all others
(it stands as the largest 63-bit number inside) and its row is no anchor.
Repeated rows are rows of their own: a copy of an anchor can be its positive,
and a repeated anchor repeats its results. Ties go to the smaller id; rows alike
in id, score and label can't be told apart in the result. Fewer rows than asked
for give what there is; an empty table gives none. Other columns aren't read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairwright.session import checkpoint_root

#: Rows of the sample that sets the tiles (a bound, documented above).
SAMPLE_ROWS = 16_384
#: Rows aimed at in a tile, and sample rows behind each tile at least.
TILE_ROWS = 512
TILE_SAMPLE = 16
#: Rows of one R-tree, rows of a leaf, boxes of a node.
PACK_ROWS = 8192
LEAF = 64
FANOUT = 16
#: Anchors that a task holds at once.
ANCHOR_BLOCK = 16_384
#: Components are held within this.
MAX_COMPONENT = 1 << 24
NO_ID = (1 << 63) - 1


# --- rows ---------------------------------------------------------------------

def _clean(vectors: DataFrame, id_col: str, vec_col: str, label: Column) -> DataFrame:
    """(vec_id, label, x): rows that take part, with integer components."""
    x = F.transform(F.col(vec_col).cast("array<double>"), lambda v: F.floor(v * 256))
    bad = F.exists(F.col(vec_col).cast("array<double>"), lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    held = F.transform(x, lambda v: F.least(F.greatest(v, F.lit(-MAX_COMPONENT)), F.lit(MAX_COMPONENT)))
    return (vectors.where(F.col(vec_col).isNotNull() & label.isNotNull() & ~bad)
            .select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("vec_id"), label.cast("long").alias("label"), held.alias("x")))


def _matrix(x: pa.Array, dim: int) -> np.ndarray:
    """List column as rows of ``dim`` numbers, short lists padded with zeros."""
    if isinstance(x, pa.ChunkedArray):
        x = x.combine_chunks()
    flat = x.flatten().to_numpy(zero_copy_only=False)
    sizes = np.diff(x.offsets.to_numpy())
    if len(sizes) and (sizes == dim).all():
        return flat.reshape(len(sizes), dim)
    out = np.zeros((len(sizes), dim), np.int64)
    at = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[np.repeat(np.arange(len(sizes)), sizes), at] = flat
    return out


# --- sort-tile-recursive ---------------------------------------------------------

def spread_order(vecs: np.ndarray) -> np.ndarray:
    """Coordinates from the widest spread to the narrowest."""
    return np.argsort(-vecs.var(axis=0, dtype=np.float64), kind="stable")


def slab_count(pages: int, coords: int) -> int:
    """Slabs along the next of ``coords`` coordinates for that many pages."""
    return max(1, int(np.ceil(round(pages ** (1 / max(coords, 1)), 9))))


def str_order(vecs: np.ndarray, tie: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """Row order in which every ``leaf`` consecutive rows form a packed leaf."""
    coords = spread_order(vecs) if len(vecs) else []

    def cut(rows: np.ndarray, depth: int) -> list[np.ndarray]:
        pages = -(-len(rows) // leaf)
        if pages <= 1 or depth == len(coords):
            return [rows]
        rows = rows[np.lexsort((tie[rows], vecs[rows, coords[depth]]))]
        slabs = min(slab_count(pages, len(coords) - depth), pages)
        size = -(-pages // slabs) * leaf
        return [part for a in range(0, len(rows), size) for part in cut(rows[a:a + size], depth + 1)]

    return np.concatenate(cut(np.arange(len(vecs)), 0)) if len(vecs) else np.zeros(0, np.int64)


class Tiles:
    """Splitters of the upper level, from a sample: a row's tile by its place among them."""

    def __init__(self, vecs: np.ndarray, tie: np.ndarray, tiles: int):
        self.coords = spread_order(vecs) if len(vecs) else np.zeros(0, int)
        self.count = 0
        self.root = self._cut(vecs, tie, np.arange(len(vecs)), max(tiles, 1), 0)

    def _cut(self, vecs, tie, rows, tiles, depth):
        if tiles <= 1 or depth == len(self.coords) or len(rows) < 2:
            self.count += 1
            return self.count - 1
        c = self.coords[depth]
        rows = rows[np.lexsort((tie[rows], vecs[rows, c]))]
        slabs = min(slab_count(tiles, len(self.coords) - depth), tiles, len(rows))
        ends = [len(rows) * k // slabs for k in range(slabs + 1)]
        first = rows[ends[1:-1]]
        share = [tiles * (k + 1) // slabs - tiles * k // slabs for k in range(slabs)]
        parts = [self._cut(vecs, tie, rows[a:b], n, depth + 1) for a, b, n in zip(ends, ends[1:], share)]
        return int(c), vecs[first, c], tie[first], parts

    def of(self, vecs: np.ndarray, tie: np.ndarray) -> np.ndarray:
        out = np.zeros(len(vecs), np.int32)
        todo = [(self.root, np.arange(len(vecs)))]
        while todo:
            node, rows = todo.pop()
            if isinstance(node, int):
                out[rows] = node
                continue
            c, value, key, parts = node
            slab = np.zeros(len(rows), int)
            for v, k in zip(value, key):
                slab += (vecs[rows, c] > v) | ((vecs[rows, c] == v) & (tie[rows] >= k))
            todo += [(part, rows[slab == s]) for s, part in enumerate(parts) if (slab == s).any()]
        return out


class RTree:
    """Packed R-tree over integer rows, with a best-first walk for an anchor."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vecs: np.ndarray, anchor_max: int):
        order = str_order(vecs, ids)
        self.ids, self.labels = ids[order], labels[order]
        # Sums below 2**53 are exact in doubles, where products of matrices are fast.
        top = int(np.abs(vecs).max(initial=0)) * anchor_max * max(vecs.shape[1], 1)
        self.vecs = vecs[order].astype(np.float64 if top < 2**53 else np.int64)
        starts = np.arange(0, len(order), LEAF)
        self.levels = [(np.minimum.reduceat(self.vecs, starts), np.maximum.reduceat(self.vecs, starts))] if len(order) else []
        while self.levels and len(self.levels[-1][0]) > FANOUT:
            lo, hi = self.levels[-1]
            at = np.arange(0, len(lo), FANOUT)
            self.levels.append((np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at)))

    def walk(self, anchor: np.ndarray, need) -> Iterator[tuple[np.ndarray, slice]]:
        """Scores and rows of the leaves worth opening, best upper end first.

        ``need(lower, upper)`` says which boxes may still hold a wanted row.
        """
        if not self.levels:
            return
        a = anchor.astype(self.vecs.dtype)
        up, down = np.maximum(a, 0), np.minimum(a, 0)
        queue: list = []

        def push(level: int, first: int, end: int) -> None:
            lo, hi = self.levels[level][0][first:end], self.levels[level][1][first:end]
            lower, upper = lo @ up + hi @ down, hi @ up + lo @ down
            for k in np.flatnonzero(need(lower, upper)):
                heapq.heappush(queue, (-upper[k], level, first + int(k), lower[k]))

        push(len(self.levels) - 1, 0, len(self.levels[-1][0]))
        while queue:
            upper, level, node, lower = heapq.heappop(queue)
            # What is needed may have risen since the box went into the queue.
            if not need(lower, -upper):
                continue
            if level:
                push(level - 1, node * FANOUT, (node + 1) * FANOUT)
            else:
                rows = slice(node * LEAF, (node + 1) * LEAF)
                yield self.vecs[rows] @ a, rows


# --- the two searches ------------------------------------------------------------

class Best:
    """The first ``k`` (score, id) by higher score, then smaller id."""

    __slots__ = ("k", "p", "low", "high", "score", "ids")

    def __init__(self, k: int, p: int, low=None, high=None):
        self.k, self.p, self.low, self.high = k, p, low, high
        self.score, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def floor(self):
        """No score below this can enter."""
        kth = self.score[-1] if len(self.score) == self.k else None
        return kth if self.low is None else self.low if kth is None else max(self.low, kth)

    def add(self, score: np.ndarray, ids: np.ndarray) -> None:
        score, ids = np.concatenate([self.score, score.astype(np.int64)]), np.concatenate([self.ids, ids])
        best = np.lexsort((ids, -score))[:self.k]
        self.score, self.ids = score[best], ids[best]


def search(tree: RTree, anchor: np.ndarray, label: int, same: bool, wanted: list[Best]) -> None:
    """Fill ``wanted`` with rows of the anchor's label (``same``) or of other labels."""
    def need(lower, upper):
        out = None
        for w in wanted:
            floor = w.floor()
            ok = (upper == upper) if floor is None else (upper >= floor)
            if w.high is not None:
                ok = ok & (lower <= w.high)
            out = ok if out is None else out | ok
        return out

    for score, rows in tree.walk(anchor, need):
        fits = (tree.labels[rows] == label) == same
        for w in wanted:
            floor = w.floor()
            hit = fits if floor is None else fits & (score >= floor)
            if w.high is not None:
                hit = hit & (score <= w.high)
            if hit.any():
                w.add(score[hit], tree.ids[rows][hit])


def _windows(low: list, high: list, k: int) -> list[Best]:
    """One for each positive; a window that no score fits is left out."""
    return [Best(k, p, lo, hi) for p, (lo, hi) in enumerate(zip(low, high)) if lo is None or lo <= hi]


FOUND = "vec_id long, akey string, p int, found_id long, score long"


def _search_cells(dim: int, same: bool, k: int):
    """Streams rows sorted by (block, group, kind, tile): anchors of a cell first, then its tiles."""
    def run(batches):
        cell, anchors, held, tile, top = None, [], [], None, 0

        def pack():
            if held and anchors:
                ids, labels, vecs = (np.concatenate(part) for part in zip(*held))
                for a in range(0, len(ids), PACK_ROWS):
                    tree = RTree(ids[a:a + PACK_ROWS], labels[a:a + PACK_ROWS], vecs[a:a + PACK_ROWS], top)
                    for _, _, label, x, wanted in anchors:
                        search(tree, x, label, same, wanted)
            held.clear()

        def results():
            rows = [(i, key, w.p, w) for i, key, _, _, wanted in anchors for w in wanted if len(w.ids)]
            for a in range(0, len(rows), 4096):
                part = rows[a:a + 4096]
                n = [len(w.ids) for *_, w in part]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.repeat(np.array([r[0] for r in part], np.int64), n)),
                    pa.array(np.repeat(np.array([r[1] for r in part], object), n), pa.string()),
                    pa.array(np.repeat(np.array([r[2] for r in part], np.int32), n)),
                    pa.array(np.concatenate([w.ids for *_, w in part])),
                    pa.array(np.concatenate([w.score for *_, w in part]))],
                    ["vec_id", "akey", "p", "found_id", "score"])

        for b in batches:
            n = b.num_rows
            if not n:
                continue
            block, group, kind, at = (b.column(c).to_numpy(zero_copy_only=False) for c in ("block", "grp", "kind", "tile"))
            ids, labels = (b.column(c).to_numpy(zero_copy_only=False) for c in ("vec_id", "label"))
            vecs = _matrix(b.column("x"), dim)
            new = np.flatnonzero((np.diff(block) != 0) | (np.diff(group) != 0) | (np.diff(kind) != 0) | (np.diff(at) != 0)) + 1
            for s, e in zip([0, *new], [*new, n]):
                if (block[s], group[s]) != cell:
                    pack()
                    yield from results()
                    cell, anchors, top, tile = (block[s], group[s]), [], 0, None
                if kind[s] == 0:
                    keys, low, high = (b.column(c).slice(s, e - s).to_pylist() for c in ("akey", "low", "high"))
                    anchors += [(int(i), key, label, x, _windows(lo, hi, k)) for i, key, label, x, lo, hi
                                in zip(ids[s:e], keys, labels[s:e], vecs[s:e], low, high)]
                    top = max(top, int(np.abs(vecs[s:e]).max(initial=0)))
                    continue
                # A pack is of one tile, or of several small ones in a row.
                if sum(len(h[0]) for h in held) + e - s > PACK_ROWS or (tile != at[s] and sum(len(h[0]) for h in held) >= PACK_ROWS // 2):
                    pack()
                tile = at[s]
                held.append((ids[s:e], labels[s:e], vecs[s:e]))
        pack()
        yield from results()

    return run


def _cells(tiles: DataFrame, anchors: DataFrame, dim: int, blocks: int, groups: int, same: bool, k: int) -> DataFrame:
    """Search every (block of anchors, group of tiles)."""
    nothing = [F.lit(None).cast("string").alias("akey"), F.lit(None).cast("array<long>").alias("low"), F.lit(None).cast("array<long>").alias("high")]
    rows = tiles.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.pmod(F.hash("tile"), F.lit(groups)).alias("grp"),
                        F.lit(1).alias("kind"), "tile", "vec_id", "label", "x", *nothing)
    asked = anchors.select(F.pmod(F.xxhash64("akey"), F.lit(blocks)).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("grp"),
                           F.lit(0).alias("kind"), F.lit(-1).alias("tile"), "vec_id", "label", "x", "akey", "low", "high")
    order = ["block", "grp", "kind", "tile"]
    laid = rows.unionByName(asked).repartition(blocks * groups, "block", "grp").sortWithinPartitions(*order)
    return laid.mapInArrow(_search_cells(dim, same, k), FOUND)


def _first(found: DataFrame, k: int, *keys: str) -> DataFrame:
    """The first ``k`` found a key, as an array (each task sends at most ``k``)."""
    ranked = F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "found_id"))), 1, k)
    return found.groupBy(*keys).agg(ranked.alias("best"))


def mine_hard_negatives(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label: Column | str = "label",
                        every: int = 100, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows whose id is divisible by ``every``. Negatives of other
    labels score from ``low`` to ``high`` percent of the positive's score.
    """
    spark = vectors.sparkSession
    checkpoint_root(spark)
    rows = _clean(vectors, id_col, vec_col, F.col(label) if isinstance(label, str) else label)
    size = rows.agg(F.count("*"), F.max(F.size("x")), F.count(F.when((F.col("vec_id") % every == 0) & (F.col("vec_id") != NO_ID), 1))).first()
    n, dim, n_anchors = size[0], max(size[1] or 0, 1), size[2]

    tie = F.xxhash64("vec_id", "x")
    sample = rows.select("x", tie.alias("tie")).orderBy("tie", F.hash("x")).limit(SAMPLE_ROWS).toArrow()
    tiles = Tiles(_matrix(sample.column("x"), dim), sample.column("tie").to_numpy(), min(-(-n // TILE_ROWS), max(sample.num_rows // TILE_SAMPLE, 1)))

    def place(batches):
        for b in batches:
            at = tiles.of(_matrix(b.column("x"), dim), b.column("tie").to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), b.column("x"), pa.array(at)], ["vec_id", "label", "x", "tile"])

    placed = rows.withColumn("tie", tie).mapInArrow(place, "vec_id long, label long, x array<long>, tile int")
    groups = max(1, min(tiles.count, 4 * spark.sparkContext.defaultParallelism))
    blocks = max(1, -(-n_anchors // ANCHOR_BLOCK))

    # Equal anchors are searched once; the key tells unequal rows of one id apart.
    key = F.md5(F.concat_ws(",", F.col("label").cast("string"), F.col("x").cast("array<string>")))
    anchors = (rows.where((F.col("vec_id") % every == 0) & (F.col("vec_id") != NO_ID)).withColumn("akey", F.concat_ws(":", "vec_id", key))
               .groupBy("vec_id", "akey", "label", "x").agg(F.count("*").alias("copies")))
    no_bound = F.array(F.lit(None).cast("long"))
    asked = anchors.withColumns({"low": no_bound, "high": no_bound})
    nearest = _first(_cells(placed, asked, dim, blocks, groups, True, positives + 1), positives + 1, "akey")

    # One entry with the anchor's own id and score is the anchor itself.
    own = F.struct((-F.aggregate("x", F.lit(0).cast("long"), lambda s, v: s + v * v)).alias("s"), F.col("vec_id").alias("found_id"))
    at = F.array_position("best", own).cast("int")
    percent = lambda e, p: -e["s"].cast("decimal(30,0)") * p / 100
    others = F.when(at > 0, F.concat(F.slice("best", F.lit(1), at - 1), F.slice("best", at + 1, F.lit(positives + 1)))).otherwise(F.col("best"))
    pairs = (anchors.join(nearest, "akey").withColumn("best", F.slice(others, 1, positives))
             .withColumns({"low": F.transform("best", lambda e: F.ceil(percent(e, low)).cast("long")),
                           "high": F.transform("best", lambda e: F.floor(percent(e, high)).cast("long"))})
             .where(F.size("best") > 0).checkpoint())

    found = _first(_cells(placed, pairs, dim, blocks, groups, False, negatives), negatives, "akey", "p")
    named = lambda c: F.nullif(c, F.lit(NO_ID))
    rows_of = pairs.select("vec_id", "akey", "copies", F.posexplode("best").alias("p", "positive")).join(found, ["akey", "p"])
    out = rows_of.select("vec_id", "copies", "positive", F.posexplode("best").alias("r", "negative"))
    return out.select(
        F.explode(F.array_repeat("vec_id", F.col("copies").cast("int"))).alias("anchor_id"),
        named(F.col("positive.found_id")).alias("positive_id"), (F.col("r") + 1).cast("int").alias("rank"),
        named(F.col("negative.found_id")).alias("negative_id"),
        (-F.col("positive.s")).alias("positive_score"), (-F.col("negative.s")).alias("negative_score"))


def shifted_label(id_col: str = "vec_id", label_col: str = "label", every: int = 7, labels: int = 10) -> Column:
    """The label, moved on by one where the id is divisible by ``every``."""
    return F.when(F.col(id_col) % every == 0, (F.col(label_col) + 1) % labels).otherwise(F.col(label_col))
