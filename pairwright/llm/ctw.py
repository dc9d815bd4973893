"""Language-model scores by context-tree weighting, beside a word-count baseline.

Model. A text is its bytes (A-Z as a-z) and an end byte. Every byte is eight
binary decisions; each decision has a tree whose contexts are the last 0 to
``DEPTH`` bytes. A node holds how often each bit followed, its
Krichevsky-Trofimov probability, and the weighted probability
``Pw = (Pe + product of the children's Pw) / 2``. The posterior of stopping at
a node mixes the estimates of all depths into one probability for each bit; a
decision that was never seen in a context is made one byte shallower.

Training is counting, and every context is kept. A task lists the distinct
(context, byte) pairs of a chunk of texts with their training counts (0 for
what only held-out texts have), dealt out into buckets by the last ``TOP + 1``
bytes of the context, so a bucket holds whole subtrees. A first pass over the
buckets adds up the counts and weights the subtrees bottom-up; what reaches
the driver is the tree of the last ``TOP`` bytes, bounded by the alphabet and
not by the texts, with the weighted probabilities of what hangs below it. A
second pass takes the mixture from there down to the deepest contexts and
sends each chunk the scores of its pairs. The number of buckets grows with the
input's partitions.

Baseline. Word counts of all training texts, joined back to the texts. A task
lists each distinct word of a chunk of texts once, so a word in every text is
one row a chunk; the counts return by chunk, where the texts are waiting.
Words are identified by 128 bits.

The input is read several times for that and must give the same rows (a stored
table does); chunks carry a digest of their texts and the job fails if they
differ.

Defined cases: a null text is an empty one (its only token is the end); a null
id counts as the empty text for the hold-out rule; without training texts all
counts are 0 and the model is uniform; repeated rows are rows of their own; an
empty table gives no rows; other columns of the input are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairwright.llm.textvec import LOWER, Words, crc_mod, mix64, slabs, small_batches, span_hashes
from pairwright.session import checkpoint_root, scratch_path, ship_package

DEPTH = 5
#: Contexts of up to so many bytes are weighted on the driver, longer ones in buckets.
TOP = 2
#: Buckets for each partition of the input, and the fewest.
BUCKETS, LEAST_BUCKETS = 4, 16
#: Weighted probabilities are added up in units of 2**-24, exactly in any order.
LOG_UNIT = 1 << 24
#: Ends a text and stands before it; never a byte of UTF-8.
END = 255
HOLD_OUT = 10
#: Bytes of text in a chunk of the baseline.
CHUNK_BYTES = 16 << 20


def events(raw: np.ndarray, offsets: np.ndarray, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """(row, context << 8 | byte) of every byte of the texts of a slab, ends included.

    The byte just before is the lowest of the context, so the pair of a
    shallower context is the low part of the number.
    """
    n = np.diff(offsets)
    rows = len(n)
    row = np.repeat(np.arange(rows), n)
    seq = np.full(len(raw) + rows * (depth + 1), END, np.uint8)
    seq[np.arange(len(raw)) + row * (depth + 1) + depth] = LOWER[raw]
    of = np.repeat(np.arange(rows), n + depth + 1)
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    m = len(seq) - depth
    code = np.zeros(m, np.int64)
    for k in range(depth + 1):
        code = code << 8 | seq[k:k + m]
    inside = of[depth:] == of[:m]
    return of[:m][inside], code[inside]


def log_gamma(x: np.ndarray) -> np.ndarray:
    """log Gamma for x > 0: Stirling's series after a shift by 8."""
    shift = np.zeros_like(x)
    for k in range(8):
        shift += np.log(x + k)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y ** 3) + 1 / (1260 * y ** 5) - shift


def kt_log(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """log of the Krichevsky-Trofimov probability of a sequence with these counts."""
    return log_gamma(n0 + 0.5) + log_gamma(n1 + 0.5) - np.log(np.pi) - log_gamma(n0 + n1 + 1)


def decisions(code: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context << 8 | decision, zeros, ones), sorted, of sorted (context, byte) counts.

    A decision is the bits before it with a leading 1.
    """
    byte = code & 255
    keys, zeros, ones = [], [], []
    for level in range(8):
        key = code - byte | 1 << level | byte >> (8 - level)
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        one = np.add.reduceat(np.where(byte >> (7 - level) & 1, n, 0), first)
        keys.append(key[first])
        zeros.append(np.add.reduceat(n, first) - one)
        ones.append(one)
    key = np.concatenate(keys)
    order = np.argsort(key, kind="stable")
    return key[order], np.concatenate(zeros)[order].astype(np.float64), np.concatenate(ones)[order].astype(np.float64)


def _mask(depth: int) -> int:
    return (1 << 8 * (depth + 1)) - 1


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    spot = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return spot, keys[spot] == wanted


def _weigh(levels, first: int = 0, below=None):
    """(nodes, parents, posteriors of stopping, weighted probabilities of the first depth), bottom up.

    ``below`` holds the decisions of the last depth and the sum of their
    children's weighted probabilities, if these are kept elsewhere.
    """
    nodes = [decisions(code, n) if len(code) else (np.zeros(0, np.int64), np.zeros(0), np.zeros(0)) for code, n in levels]
    parent = [None] + [np.searchsorted(nodes[i - 1][0], nodes[i][0] & _mask(first + i - 1)) for i in range(1, len(nodes))]
    stop = [None] * len(nodes)
    under = under_0 = under_1 = None
    if below is not None:
        key, under_0, under_1 = nodes[-1]
        under = below[1][_find(below[0], key)[0]] if len(key) else np.zeros(0)
    for i in range(len(nodes) - 1, -1, -1):
        key, n0, n1 = nodes[i]
        own = weighted = kt_log(n0, n1)
        if under is not None:
            # What contexts that are not kept saw is one more leaf.
            weighted = np.log(0.5) + np.logaddexp(own, under + kt_log(n0 - under_0, n1 - under_1))
            stop[i] = np.exp(np.log(0.5) + own - weighted)
        if i:
            size = len(nodes[i - 1][0])
            under, under_0, under_1 = (np.bincount(parent[i], x, minlength=size) for x in (weighted, n0, n1))
    return nodes, parent, stop, weighted


class ContextTree:
    """The weighted trees as two sorted tables, keyed by depth and context.

    ``levels[i]`` holds the sorted (context << 8 | byte) pairs of depth
    ``first + i`` and their counts; a kept context's parent must be kept, in
    the tree ``above`` for the first depth. ``below`` is as in ``_weigh``.
    """

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray]], first: int = 0, above: ContextTree | None = None, below=None):
        self.first, self.depth, self.above = first, first + len(levels) - 1, above
        nodes, parent, stop, _ = _weigh(levels, first, below)
        # Top down: a + b * estimate is the mixture if the path ends at a node.
        keys, values, pair_keys, pair_values = [], [], [], []
        if above is None:
            a, b = np.zeros(len(nodes[0][0])), np.ones(len(nodes[0][0]))
        else:
            up = np.searchsorted(above.last, nodes[0][0] & _mask(first - 1))
            a, b = above.down[0][up], above.down[1][up]
        for i, (key, n0, n1) in enumerate(nodes):
            d = first + i
            estimate = (n1 + 0.5) / (n0 + n1 + 1)
            value = a + b * estimate
            keys.append(key | d << 56)
            values.append(value)
            code = levels[i][0]
            byte = code & 255
            logs = np.zeros(len(code))
            for level in range(8):
                p = value[np.searchsorted(key, code - byte | 1 << level | byte >> (8 - level))]
                logs += np.log10(np.where(byte >> (7 - level) & 1, p, 1 - p))
            pair_keys.append(code | d << 56)
            pair_values.append(logs)
            if stop[i] is not None:
                a, b = a + b * stop[i] * estimate, b * (1 - stop[i])
                if d < self.depth:
                    a, b = a[parent[i + 1]], b[parent[i + 1]]
                else:
                    self.last, self.down = key, (a, b)
        self.keys, self.values = np.concatenate(keys), np.concatenate(values)
        self.pair_keys, self.pair_logs = np.concatenate(pair_keys), np.concatenate(pair_values)

    def score(self, code: np.ndarray) -> np.ndarray:
        """log10 P(byte | context) of (context << 8 | byte) numbers of full depth."""
        out = np.full(len(code), -8 * np.log10(2))
        left = np.arange(len(code))
        for d in range(self.depth, self.first - 1, -1):
            pair = code[left] & _mask(d) | d << 56
            spot, hit = _find(self.pair_keys, pair)
            out[left[hit]] = self.pair_logs[spot[hit]]
            left, pair = left[~hit], pair[~hit]
            # The context is kept but this byte is new in it: decide bit by bit.
            known = _find(self.keys, pair & ~255 | 1)[1]
            out[left[known]] = self._bits(code[left[known]], d)
            left = left[~known]
        if self.above is not None:
            out[left] = self.above.score(code[left])
        return out

    def _bits(self, code: np.ndarray, depth: int) -> np.ndarray:
        byte, total = code & 255, np.zeros(len(code))
        for level in range(8):
            p = self._one(code - byte | 1 << level | byte >> (8 - level), depth)
            total += np.log10(np.where(byte >> (7 - level) & 1, p, 1 - p))
        return total

    def _one(self, node: np.ndarray, depth: int) -> np.ndarray:
        """P(1) of (context << 8 | decision) numbers, from the deepest context that saw the decision."""
        p, left = np.full(len(node), 0.5), np.arange(len(node))
        for d in range(depth, self.first - 1, -1):
            spot, hit = _find(self.keys, node[left] & _mask(d) | d << 56)
            p[left[hit]] = self.values[spot[hit]]
            left = left[~hit]
        if self.above is not None:
            p[left] = self.above._one(node[left], self.above.depth)
        return p


def count_events(train: DataFrame, text_col: str = "text") -> DataFrame:
    """(code, n): how often each byte followed each full context, over all given texts."""
    def merged(held):
        code, inv = np.unique(np.concatenate([c for c, _ in held]), return_inverse=True)
        return code, np.bincount(inv, np.concatenate([n for _, n in held])).astype(np.int64)

    def run(batches):
        held, size = [], 0
        for b in batches:
            for _, _, raw, offsets in slabs(b.column("t")):
                held.append(np.unique(events(raw, offsets)[1], return_counts=True))
                size += len(held[-1][0])
                if size > 4_000_000:
                    held = [merged(held)]
                    size = len(held[0][0])
                    if size > 2_000_000:
                        yield from _count_batches(*held[0])
                        held, size = [], 0
        if held:
            yield from _count_batches(*merged(held))

    rows = train.select(F.col(text_col).cast("string").alias("t"))
    return rows.mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def _count_batches(code, n):
    for at in range(0, len(code), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(code[at:at + 100_000]), pa.array(n[at:at + 100_000])], ["code", "n"])


def kept_levels(counts: DataFrame, depth: int = DEPTH, max_events: int | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """The pairs of every depth, gathered: all, or those whose contexts are frequent enough for a bound.

    For small tables; ``score_texts`` gathers none of the deep ones.
    """
    tables, least = [], []
    for d in range(depth + 1):
        low = F.col("code").bitwiseAND(F.lit(_mask(d)))
        table = counts.groupBy(low.alias("code")).agg(F.sum("n").alias("n")) if d < depth else counts
        if max_events is None:
            tables.append((table, None))
            least.append(1)
            continue
        context = table.groupBy(F.shiftright("code", 8).alias("context")).agg(F.sum("n").alias("seen"), F.count("*").alias("k"))
        sizes = {r.p: r.k for r in context.groupBy(F.floor(F.log2("seen")).cast("int").alias("p")).agg(F.sum("k").alias("k")).collect()}
        power = 0
        while sum(k for p, k in sizes.items() if p >= power) > max_events:
            power += 1
        tables.append((table, context))
        least.append(1 << power)
    out = []
    for d, (table, context) in enumerate(tables):
        # A parent has seen all that its children saw, so rising bounds keep it with them.
        bound = max(least[:d + 1])
        if bound > 1:
            frequent = context.where(F.col("seen") >= bound).select("context")
            table = table.join(frequent, F.shiftright(table["code"], 8) == frequent["context"], "left_semi")
        got = table.select("code", "n").toArrow()
        code, n = got.column("code").to_numpy(), got.column("n").to_numpy()
        order = np.argsort(code)
        out.append((code[order], n[order]))
    return out


def _squeeze(x: np.ndarray) -> bytes:
    """Numbers as compressed byte planes; the first eight bytes hold their count."""
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T)
    return len(x).to_bytes(8, "little") + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def _expand(packed: list[bytes], kind) -> np.ndarray:
    out = [np.zeros(0, kind)]
    for blob in packed:
        n, width = int.from_bytes(blob[:8], "little"), np.dtype(kind).itemsize
        raw = pa.decompress(blob[8:], n * width, codec="zstd", asbytes=True)
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, n).T).view(kind).ravel())
    return np.concatenate(out)


def _chunk_events(train: list[bool], texts) -> tuple[np.ndarray, np.ndarray]:
    """(distinct pairs, training count of each) of a chunk of texts."""
    learned, held, at = np.array(train, np.int64), [], 0
    for raw, offsets in texts:
        of, code = events(raw, offsets)
        kinds, inv = np.unique(code, return_inverse=True)
        held.append((kinds, np.bincount(inv, learned[at + of], minlength=len(kinds))))
        at += len(offsets) - 1
    code, inv = np.unique(np.concatenate([c for c, _ in held]), return_inverse=True)
    return code, np.bincount(inv, np.concatenate([n for _, n in held]), minlength=len(code)).astype(np.int64)


def _bucket_levels(table: pa.Table):
    """(all pairs listed in a bucket, levels of its training pairs below the top)."""
    code = _expand(table.column("codes").to_pylist(), np.int64)
    n = _expand(table.column("n").to_pylist(), np.int64)
    kinds, inv = np.unique(code, return_inverse=True)
    seen = np.bincount(inv, n, minlength=len(kinds)).astype(np.int64)
    levels = []
    for d in range(TOP + 1, DEPTH + 1):
        low, inv = np.unique(kinds[seen > 0] & _mask(d), return_inverse=True)
        levels.append((low, np.bincount(inv, seen[seen > 0], minlength=len(low)).astype(np.int64)))
    return code, levels


def _weigh_bucket(table: pa.Table) -> pa.Table:
    """Training pairs of depth TOP (kind 0), and weighted probabilities for its decisions (kind 1)."""
    _, levels = _bucket_levels(table)
    nodes, _, _, weighted = _weigh(levels, TOP + 1)
    pairs, inv = np.unique(levels[0][0] & _mask(TOP), return_inverse=True)
    n = np.bincount(inv, levels[0][1], minlength=len(pairs)).astype(np.int64)
    keys, inv = np.unique(nodes[0][0] & _mask(TOP), return_inverse=True)
    logs = np.rint(np.bincount(inv, weighted, minlength=len(keys)) * LOG_UNIT).astype(np.int64)
    return pa.table({"kind": pa.array(np.repeat(np.array([0, 1], np.int32), [len(pairs), len(keys)])),
                     "key": pa.array(np.concatenate([pairs, keys])), "v": pa.array(np.concatenate([n, logs]))})


def _top_tree(buckets: DataFrame) -> ContextTree:
    """The tree of the last TOP bytes, from the listed pairs of all buckets."""
    sums = buckets.groupBy("bucket").applyInArrow(_weigh_bucket, "kind int, key long, v long").groupBy("kind", "key").agg(F.sum("v").alias("v")).toArrow()
    kind, key, v = (sums.column(c).to_numpy() for c in ("kind", "key", "v"))
    order = np.argsort(key, kind="stable")
    kind, key, v = kind[order], key[order], v[order]
    code, n = key[kind == 0], v[kind == 0]
    levels = []
    for d in range(TOP + 1):
        low, inv = np.unique(code & _mask(d), return_inverse=True)
        levels.append((low, np.bincount(inv, n, minlength=len(low)).astype(np.int64)))
    return ContextTree(levels, below=(key[kind == 1], v[kind == 1] / LOG_UNIT))


def held_out(id_col: str | Column = "doc_id") -> Column:
    """True for the tenth of ids whose crc32 leaves remainder 0."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.crc32(F.coalesce(c.cast("string"), F.lit(""))) % HOLD_OUT == 0


_END_WORD = (np.uint64(0x6A09E667F3BCC908), np.uint64(0xBB67AE8584CAA73B))


def _word_keys(raw: np.ndarray, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of every word, with the end after each row's words."""
    h = span_hashes(raw, words.starts, words.ends)
    # The second hash reads the bytes through another table.
    other = span_hashes(_SCRAMBLE[LOWER[raw]], words.starts, words.ends, lower=False)
    at = words.first[1:]
    return np.insert(h, at, _END_WORD[0]), np.insert(other, at, _END_WORD[1])


_SCRAMBLE = np.random.Generator(np.random.PCG64(6)).permutation(256).astype(np.uint8)


def _chunks(batches):
    """(chunk id, ids, whether each trains, slabs of texts) chunk by chunk."""
    seq, ids, train, texts, size = 0, [], [], [], 0

    def done():
        h = hashlib.sha256(f"{TaskContext.get().partitionId()}/{seq}".encode())
        for raw, offsets in texts:
            h.update(np.ascontiguousarray(raw))
            h.update(offsets.tobytes())
        h.update(np.array(train, bool).tobytes())
        return int.from_bytes(h.digest()[:8], "little", signed=True), ids, train, texts

    for batch in batches:
        doc_ids = batch.column("doc_id")
        kept = crc_mod(batch.column("id_text").to_pylist(), HOLD_OUT) != 0
        for i, j, raw, offsets in slabs(batch.column("t")):
            ids += [doc_ids[k] for k in range(i, j)]
            train += kept[i:j].tolist()
            texts.append((raw, offsets))
            size += len(raw)
            if size >= CHUNK_BYTES:
                yield done()
                seq, ids, train, texts, size = seq + 1, [], [], [], 0
    if ids:
        yield done()


def _chunk_words(texts):
    """(key halves of the distinct words, word numbers of all texts, words of each text) of a chunk."""
    a, b, sizes = [], [], []
    for raw, offsets in texts:
        words = Words(raw, offsets)
        x, y = _word_keys(raw, words)
        a.append(x)
        b.append(y)
        sizes.append(np.diff(words.first) + 1)
    left, right = np.concatenate(a), np.concatenate(b)
    _, first, number = np.unique(left ^ mix64(right), return_index=True, return_inverse=True)
    return left[first].view(np.int64), right[first].view(np.int64), number, np.concatenate(sizes)


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte."""
    spark = docs.sparkSession
    small_batches(spark)
    ship_package(spark)
    checkpoint_root(spark)
    ident = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), ident.alias("id_text"), F.col(text_col).cast("string").alias("t"))
    id_type = dict(rows.dtypes)["doc_id"]
    n_buckets = max(LEAST_BUCKETS, BUCKETS * rows.rdd.getNumPartitions())

    def pairs_of(batches):
        for chunk, _, train, texts in _chunks(batches):
            code, n = _chunk_events(train, texts)
            bucket = (mix64((code >> 8 & _mask(TOP)).astype(np.uint64)) % np.uint64(n_buckets)).astype(np.int32)
            # By the nearest bytes within a bucket: their planes are runs.
            order = np.lexsort((code & 0xFFFFFFFF, bucket))
            code, n, bucket = code[order], n[order], bucket[order]
            first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
            spans = list(zip(first, [*first[1:], len(bucket)]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(first), chunk, np.int64)), pa.array(bucket[first]),
                 pa.array([_squeeze(code[i:j]) for i, j in spans], pa.binary()), pa.array([_squeeze(n[i:j]) for i, j in spans], pa.binary())],
                ["chunk", "bucket", "codes", "n"])

    path = scratch_path(spark, "ctw-pairs")
    rows.mapInArrow(pairs_of, "chunk long, bucket int, codes binary, n binary").write.parquet(path)
    pairs = spark.read.parquet(path)
    top = spark.sparkContext.broadcast(_top_tree(pairs))

    def score_bucket(table: pa.Table) -> pa.Table:
        code, levels = _bucket_levels(table)
        kinds, inv = np.unique(code, return_inverse=True)
        score = ContextTree(levels, TOP + 1, top.value).score(kinds).astype(np.float32)[inv]
        ends = np.cumsum([int.from_bytes(c[:8], "little") for c in table.column("codes").to_pylist()])
        return pa.table({"chunk": table.column("chunk"), "codes": table.column("codes"), "scores": pa.array([_squeeze(x) for x in np.split(score, ends[:-1])], pa.binary())})

    scores = pairs.groupBy("bucket").applyInArrow(score_bucket, "chunk long, codes binary, scores binary")

    def words_of(batches):
        for chunk, _, train, texts in _chunks(batches):
            left, right, number, n = _chunk_words(texts)
            learned = np.bincount(number, np.repeat(np.array(train), n), minlength=len(left)).astype(np.int64)
            for at in range(0, len(left), 50_000):
                s = slice(at, at + 50_000)
                m = len(left[s])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(left[s]), pa.array(right[s]), pa.array(np.full(m, chunk, np.int64)), pa.array(np.arange(at, at + m, dtype=np.int32)), pa.array(learned[s])],
                    ["w1", "w2", "chunk", "number", "n"])

    words = rows.mapInArrow(words_of, "w1 long, w2 long, chunk long, number int, n long")
    path = scratch_path(spark, "word-counts")
    words.where("n > 0").groupBy("w1", "w2").agg(F.sum("n").alias("c")).write.parquet(path)
    counts = spark.read.parquet(path)
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()

    def texts_of(batches):
        for chunk, ids, _, texts in _chunks(batches):
            at = 0
            for k, (raw, offsets) in enumerate(texts):
                m = len(offsets) - 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array([chunk], pa.int64()), pa.array([k], pa.int32()), pa.ListArray.from_arrays(pa.array([0, m], pa.int32()), pa.array(ids[at:at + m])),
                     pa.array([_squeeze(np.ascontiguousarray(raw))], pa.binary()), pa.array([_squeeze(np.diff(offsets))], pa.binary())],
                    ["chunk", "slab", "ids", "codes", "rest"])
                at += m

    def assemble(texts: pa.Table, replies: pa.Table) -> pa.Table:
        is_score = pa.compute.less(texts.column("slab"), 0)
        scored, texts = texts.filter(is_score), texts.filter(pa.compute.invert(is_score)).sort_by("slab")
        ids, sizes = [], []
        parts = []
        for i, raw, n in zip(*(texts.column(c).to_pylist() for c in ("ids", "codes", "rest"))):
            ids += i
            sizes.append(_expand([n], np.int64))
            parts.append((_expand([raw], np.uint8), np.concatenate([[0], np.cumsum(sizes[-1])])))
        code, score = _expand(scored.column("codes").to_pylist(), np.int64), _expand(scored.column("rest").to_pylist(), np.float32)
        order = np.argsort(code)
        code, score = code[order], score[order].astype(np.float64)
        number, c = replies.column("number").to_numpy(), replies.column("c").to_numpy()
        if not parts:
            raise RuntimeError("the input gave other rows when read again; checkpoint it first")
        left, _, numbers, n = _chunk_words(parts)
        if len(number) != len(left):
            raise RuntimeError("the input gave other rows when read again; checkpoint it first")
        known = np.zeros(len(left), np.int64)
        known[number] = c
        begin = np.cumsum(n) - n
        total = []
        for raw, offsets in parts:
            of, pair = events(raw, offsets)
            kinds, inv = np.unique(pair, return_inverse=True)
            spot, hit = _find(code, kinds)
            if not hit.all():
                raise RuntimeError("the input gave other rows when read again; checkpoint it first")
            total.append(np.bincount(of, score[spot][inv], minlength=len(offsets) - 1))
        return pa.table({"doc_id": pa.array(ids, texts.schema.field("ids").type.value_type), "n_bytes": pa.array(np.concatenate(sizes)), "score": pa.array(np.concatenate(total)),
                         "n_tokens": pa.array(n.astype(np.int64)), "n_known": pa.array(np.add.reduceat((known > 0).astype(np.int64)[numbers], begin)),
                         "base": pa.array(np.add.reduceat(np.log10(known + 0.1)[numbers], begin))})

    replies = words.select("w1", "w2", "chunk", "number").join(counts, ["w1", "w2"], "left").select("chunk", "number", F.coalesce("c", F.lit(0)).alias("c"))
    # The scores of a chunk's pairs wait with its texts, as slab -1.
    texts = rows.mapInArrow(texts_of, f"chunk long, slab int, ids array<{id_type}>, codes binary, rest binary").unionByName(
        scores.select("chunk", F.lit(-1).alias("slab"), F.lit(None).cast(f"array<{id_type}>").alias("ids"), "codes", F.col("scores").alias("rest")))
    out = texts.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(
        assemble, f"doc_id {id_type}, n_bytes long, score double, n_tokens long, n_known long, base double")
    norm = float(np.log10(total.n + 0.1 * (total.v + 1)))
    return out.select(
        "doc_id", held_out("doc_id").alias("held_out"), "n_tokens", "n_known", F.lit(int(total.n)).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * norm).alias("base_score"), "score", "n_bytes",
        (-F.col("score") * float(np.log2(10)) / (F.col("n_bytes") + 1)).alias("bits_per_byte"))
