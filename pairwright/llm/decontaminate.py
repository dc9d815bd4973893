"""Benchmark passages in documents: CGK embedding, bit-sampling LSH, exact edits.

Texts and items are token sequences (runs of letters and digits, A-Z as a-z; in
scripts without spaces every code point is a token).
An item of n tokens is found in a text where a stretch of it has edit distance
at most ``floor(EDIT_SHARE * n)`` from the item.

1. Item-sized windows start at every token. The window at the start of such a
   stretch has at least n - 1 - 2e of the item's token pairs: a substitution
   or deletion breaks two, an insertion breaks one and may push one past the
   window's end. Windows with fewer pairs known from the benchmark are
   passed over, which loses no item.
2. The others are embedded by the CGK walk: a step writes the current token
   and moves on if a random bit of (step, token) says so. Edits then cost a
   few differing places each, so edit distance becomes Hamming distance.
   Each of ``REPEATS`` walks gives one LSH key from ``SAMPLES`` places.
3. The keys alone lose pairs: edits of one kind shift the walk, more so in long
   items (h differing places of 2n leave a key equal with probability
   (1 - h/2n)**SAMPLES only). So windows are linked by token pairs as well: at
   most 2e of an item's n - 1 pairs can be broken, so one of its 2e + 1 pairs
   that are rarest in the benchmark is in the window, and at least n - 1 - 2e
   of all its pairs are. That loses no item, whatever the edits and the length.
4. Linked windows are verified exactly: the smallest edit distance of the item
   to any stretch around the window, by the bit-parallel recurrence over one
   integer.

The benchmark is a query set: it is read in blocks of ``ITEM_BLOCK`` items,
each block is sent to the tasks (so what is sent is bounded) and takes one
pass over the documents. Documents are never shuffled.

Defined cases: items below ``MIN_TOKENS`` tokens are found without edits,
anywhere in a text; those whose tokens have under ``SHORT_BYTES`` bytes are
too short to be told from chance in running text and match only texts that
consist of them; a null or
empty item matches nothing; equal items all match; a null text is empty;
repeated rows are rows of their own; an empty table on either side gives no
hits; other columns are ignored by ``find_passages`` and kept by
``decontaminate``.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwright.llm.textvec import Words, mix64, slabs, small_batches, span_hashes, window_hashes, windows_in_rows
from pairwright.session import ship_package

EDIT_SHARE = 0.2
MIN_TOKENS = 8
#: Bytes of an item below MIN_TOKENS that is looked for inside texts: 6 ideographs, or 3 to 4 words.
SHORT_BYTES = 16
REPEATS = 32
SAMPLES = 3
ITEM_BLOCK = 20_000
#: Windows embedded at once.
WINDOW_BLOCK = 512

NOT_TOKEN = np.ones(256, bool)
for _a, _b in ((48, 58), (65, 91), (97, 123), (128, 256)):
    NOT_TOKEN[_a:_b] = False


def edits_allowed(n):
    return np.floor(EDIT_SHARE * np.asarray(n)).astype(np.int64)


def _unspaced() -> np.ndarray:
    """First two bytes (as one number) of three-byte code points in scripts without spaces."""
    out = np.zeros(1 << 16, bool)
    # Thai, Lao, Tibetan, Myanmar, Khmer; kana and ideographs with their signs; compatibility and full width.
    for lo, hi in ((0x0E00, 0x1000), (0x1000, 0x10A0), (0x1780, 0x1800), (0x2E80, 0x3130), (0x31C0, 0xA4D0), (0xF900, 0xFB00), (0xFF00, 0xFFC0)):
        for cp in range(lo, hi, 64):
            first, second = chr(cp).encode()[:2]
            out[first << 8 | second] = True
    # Ideographs beyond the basic plane have four bytes, from F0 A0 on.
    for second in range(0xA0, 0xC0):
        out[0xF0 << 8 | second] = True
    return out


UNSPACED = _unspaced()


def token_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first token of each row) of a slab."""
    w = Words(raw, offsets, NOT_TOKEN)
    if not len(raw) or raw.max() < 0xE0:
        return w.starts, w.ends, w.first
    lead = np.flatnonzero(raw[:-1] >= 0xE0)
    lead = lead[UNSPACED[raw[lead].astype(np.int64) << 8 | raw[lead + 1]]]
    cut = np.unique(np.concatenate([lead, lead + np.where(raw[lead] >= 0xF0, 4, 3)]))
    cut = cut[(cut > 0) & (cut < len(raw))]
    cut = cut[~NOT_TOKEN[raw[cut]] & ~NOT_TOKEN[raw[cut - 1]] & ~np.isin(cut, offsets)]
    starts, ends = np.sort(np.concatenate([w.starts, cut])), np.sort(np.concatenate([w.ends, cut]))
    return starts, ends, np.searchsorted(starts, offsets)


def tokens(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(token hashes, first token of each row) of a slab."""
    starts, ends, first = token_spans(raw, offsets)
    return span_hashes(raw, starts, ends), first


def search(pattern: list[int], text: list[int]) -> tuple[int, int]:
    """(smallest edit distance of the pattern to a stretch of the text, its end).

    Bit-parallel columns of the edit table; the first end wins ties.
    """
    m = len(pattern)
    where: dict[int, int] = defaultdict(int)
    for i, x in enumerate(pattern):
        where[x] |= 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score = full, 0, m
    best, end = m, 0
    for j, x in enumerate(text):
        eq = where.get(x, 0)
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        right_up = down | (~(xh | up) & full)
        right_down = up & xh
        if right_up & top:
            score += 1
        elif right_down & top:
            score -= 1
        right_up = (right_up << 1) & full
        right_down = (right_down << 1) & full
        up = right_down | (~(xv | right_up) & full)
        down = right_up & xv
        if score < best:
            best, end = score, j + 1
    return best, end


def _member(table: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Which entries of ``x`` the sorted ``table`` holds."""
    if not len(table):
        return np.zeros(len(x), bool)
    return table[np.minimum(np.searchsorted(table, x), len(table) - 1)] == x


class Items:
    """The lookup tables of one block of benchmark items."""

    def __init__(self, items: list[tuple[int, str]]):
        arr = pa.array([t or "" for _, t in items], pa.large_string())
        by_tokens: dict[tuple, list[int]] = defaultdict(list)
        size: dict[tuple, int] = {}
        for i0, _, raw, offsets in slabs(arr):
            starts, ends, first = token_spans(raw, offsets)
            h = span_hashes(raw, starts, ends)
            for k in range(len(first) - 1):
                seq = tuple(h[first[k]:first[k + 1]].tolist())
                if seq:
                    by_tokens[seq].append(items[i0 + k][0])
                    size[seq] = int((ends - starts)[first[k]:first[k + 1]].sum())
        self.short = {s: ids for s, ids in by_tokens.items() if len(s) < MIN_TOKENS}
        #: Those looked for inside texts: sorted window hashes of each length.
        self.inside = {n: np.unique([window_hashes(np.array(s, np.uint64), n)[0] for s in self.short if len(s) == n and size[s] >= SHORT_BYTES])
                       for n in {len(s) for s in self.short if size[s] >= SHORT_BYTES}}
        self.whole = {s for s in self.short if size[s] < SHORT_BYTES}
        long = [(s, ids) for s, ids in by_tokens.items() if len(s) >= MIN_TOKENS]
        self.seqs = [list(s) for s, _ in long]
        self.ids = [ids for _, ids in long]
        self.lengths = np.array(sorted({len(s) for s in self.seqs}), np.int64)
        #: Token pairs of the items of each length, and of all.
        self.pairs_of = {int(n): np.unique(np.concatenate([window_hashes(np.array(s, np.uint64), 2) for s in self.seqs if len(s) == n])) for n in self.lengths}
        self.pairs = np.unique(np.concatenate([*self.pairs_of.values(), np.zeros(0, np.uint64)]))
        rng = np.random.Generator(np.random.PCG64(8))
        self.steps = 2 * int(self.lengths.max()) if long else 0
        self.salts = rng.integers(0, 2**63, (self.steps, REPEATS), dtype=np.uint64)
        #: Sampled steps of each (length, walk), within the steps that read tokens.
        self.places = {int(n): rng.integers(0, 2 * n, (REPEATS, SAMPLES)) for n in self.lengths}
        if long:
            flat = np.concatenate([np.array(s, np.uint64) for s in self.seqs])
            n = np.array([len(s) for s in self.seqs])
            start = np.cumsum(n) - n
            keys = self.keys(flat, start, start + n, n)
            item = np.repeat(np.arange(len(long)), REPEATS)
            order = np.argsort(keys.ravel(), kind="stable")
            self.key_list, self.key_item = keys.ravel()[order], item[order]
        self._index_pairs()

    def _index_pairs(self) -> None:
        """Of each length: (pair, item) of the 2e + 1 rarest pairs of every item, by pair."""
        self.item_pairs = [window_hashes(np.array(s, np.uint64), 2) for s in self.seqs]
        every, count = np.unique(np.concatenate([*self.item_pairs, np.zeros(0, np.uint64)]), return_counts=True)
        rare: dict[int, list] = defaultdict(list)
        for item, pairs in enumerate(self.item_pairs):
            n = len(pairs) + 1
            order = np.argsort(count[np.searchsorted(every, pairs)], kind="stable")[:2 * int(edits_allowed(n)) + 1]
            some = np.unique(pairs[order])
            rare[n].append((some, np.full(len(some), item)))
        self.rare = {}
        for n, parts in rare.items():
            pair, item = (np.concatenate(x) for x in zip(*parts))
            order = np.argsort(pair, kind="stable")
            self.rare[n] = pair[order], item[order]

    def linked(self, h: np.ndarray, start: np.ndarray, stop: np.ndarray, n: np.ndarray) -> list[tuple[int, int]]:
        """(window start, item) of windows around all that hold enough pairs of the item."""
        out = []
        pair = window_hashes(h, 2)
        for size in np.unique(n):
            size = int(size)
            need = max(1, size - 1 - 2 * int(edits_allowed(size)))
            s, e = start[n == size], stop[n == size]
            # Each pair in some window once.
            depth = np.zeros(len(h) + 1, np.int64)
            np.add.at(depth, s, 1)
            np.add.at(depth, e - 1, -1)
            at = np.flatnonzero(np.cumsum(depth)[:len(pair)] > 0)
            key, owner = self.rare[size]
            lo, hi = np.searchsorted(key, pair[at], side="left"), np.searchsorted(key, pair[at], side="right")
            k = hi - lo
            item = owner[np.repeat(lo - np.cumsum(k) + k, k) + np.arange(k.sum())]
            at = np.repeat(at, k)
            order = np.lexsort((at, item))
            item, at = item[order], at[order]
            # Hits of an item nearer than a window lie in one stretch.
            edge = np.flatnonzero(np.concatenate([[True], (item[1:] != item[:-1]) | (at[1:] - at[:-1] > size)])) if len(at) else []
            for i, j in zip(edge, [*edge[1:], len(at)]):
                low, high = max(int(at[i]) - size, 0), int(at[j - 1]) + size
                p = low + np.flatnonzero(np.isin(pair[low:high], self.item_pairs[item[i]]))
                if len(p) < need:
                    continue
                first, last = p[:len(p) - need + 1], p[need - 1:]
                ok = last - first <= size - 2
                # The first and the last of the windows that cover the pairs.
                x, y = np.searchsorted(s, last[ok] - size + 2), np.searchsorted(s, first[ok] + 1)
                ends = np.concatenate([x[x < y], y[x < y] - 1])
                out += [(int(w), int(item[i])) for w in np.unique(s[ends])]
        return out

    def keys(self, h: np.ndarray, start: np.ndarray, stop: np.ndarray, n: np.ndarray) -> np.ndarray:
        """LSH keys (windows x walks) of the windows [start, stop) of item length n."""
        out = np.empty((len(start), REPEATS), np.uint64)
        for a in range(0, len(start), WINDOW_BLOCK):
            s, e, m = (x[a:a + WINDOW_BLOCK] for x in (start, stop, n))
            steps = 2 * int(m.max())
            seen = np.empty((steps, len(s), REPEATS), np.uint64)
            at = np.repeat(s[:, None], REPEATS, axis=1)
            for t in range(steps):
                inside = at < e[:, None]
                tok = np.where(inside, h[np.minimum(at, len(h) - 1)], np.uint64(0))
                seen[t] = tok
                at = at + (inside & ((mix64(tok ^ self.salts[t]) >> np.uint64(63)) == 1))
            place = np.stack([self.places[int(x)] for x in m])  # windows x walks x samples
            key = m.astype(np.uint64)[:, None] * np.uint64(1000003) + np.arange(REPEATS, dtype=np.uint64)
            w, r = np.arange(len(s))[:, None], np.arange(REPEATS)[None, :]
            for k in range(SAMPLES):
                key = key * np.uint64(0x100000001B3) + seen[place[:, :, k], w, r]
            out[a:a + WINDOW_BLOCK] = mix64(key)
        return out

    def windows(self, h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, stop, item length) of the windows that can hold an item."""
        begin, _ = windows_in_rows(first, 2)
        pair = window_hashes(h, 2)[begin]
        some = _member(self.pairs, pair)
        begin, pair = begin[some], pair[some]
        starts, stops, sizes = ([np.zeros(0, np.int64)] for _ in range(3))
        for n in self.lengths if len(begin) else ():
            e = int(edits_allowed(n))
            need = max(1, int(n) - 1 - 2 * e)
            p = begin[_member(self.pairs_of[int(n)], pair)]
            # Stretches of ``need`` known pairs that fit a window, and the starts that cover them.
            low, high = p[need - 1:] - (n - 2), p[:max(len(p) - need + 1, 0)]
            row = np.searchsorted(first, high, side="right") - 1
            fits = (low <= high) & (p[need - 1:] < first[row + 1])
            low, high, row = np.maximum(low[fits], first[row[fits]]), high[fits], row[fits]
            count = high - low + 1
            hit = np.repeat(low - np.cumsum(count) + count, count) + np.arange(count.sum())
            hit, at = np.unique(hit, return_index=True)
            stop = np.minimum(hit + n, first[np.repeat(row, count)[at] + 1])
            long = stop - hit >= n - e
            starts.append(hit[long])
            stops.append(stop[long])
            sizes.append(np.full(int(long.sum()), n))
        return np.concatenate(starts), np.concatenate(stops), np.concatenate(sizes)

    def find(self, h: np.ndarray, first: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(row, item id, distance, start token, end token) of every item in every row, best place each."""
        out = []
        if self.whole:
            for k in np.flatnonzero((np.diff(first) > 0) & (np.diff(first) < MIN_TOKENS)):
                seq = tuple(h[first[k]:first[k + 1]].tolist())
                if seq in self.whole:
                    out += [(int(k), i, 0, 0, len(seq)) for i in self.short[seq]]
        for size, table in self.inside.items():
            begin, rows = windows_in_rows(first, size)
            hit = _member(table, window_hashes(h, size)[begin]) if len(begin) else np.zeros(0, bool)
            seen = set()
            for at, k in zip(begin[hit].tolist(), rows[hit].tolist()):
                seq = tuple(h[at:at + size].tolist())
                if seq in self.short and seq not in self.whole and (k, seq) not in seen:
                    seen.add((k, seq))
                    s = at - int(first[k])
                    out += [(k, i, 0, s, s + size) for i in self.short[seq]]
        start, stop, n = self.windows(h, first)
        if not len(start):
            return out
        keys = self.keys(h, start, stop, n)
        lo = np.searchsorted(self.key_list, keys, side="left")
        hi = np.searchsorted(self.key_list, keys, side="right")
        row = np.searchsorted(first, start, side="right") - 1
        places: dict[tuple[int, int], set[int]] = defaultdict(set)
        for w, r in zip(*np.nonzero(hi > lo)):
            for item in self.key_item[lo[w, r]:hi[w, r]]:
                places[int(row[w]), int(item)].add(int(start[w]))
        for s, item in self.linked(h, start, stop, n):
            places[int(np.searchsorted(first, s, side="right")) - 1, item].add(s)
        for (k, item), spots in places.items():
            seq = self.seqs[item]
            e = int(edits_allowed(len(seq)))
            best = None
            spans: list[list[int]] = []
            for s in sorted(spots):
                a, b = max(int(first[k]), s - 2 * e), min(int(first[k + 1]), s + len(seq) + 2 * e)
                if spans and a <= spans[-1][1]:
                    spans[-1][1] = b
                else:
                    spans.append([a, b])
            for a, b in spans:
                text = h[a:b].tolist()
                d, end = search(seq, text)
                if d <= e and (best is None or d < best[0]):
                    _, back = search(seq[::-1], text[:end][::-1])
                    best = (d, a + end - back, a + end)
            if best:
                begin = int(first[k])
                out += [(k, i, best[0], best[1] - begin, best[2] - begin) for i in self.ids[item]]
        return sorted(out)


def item_blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text"):
    """The benchmark as blocks of at most ITEM_BLOCK items."""
    block: list[tuple[int, str]] = []
    rows = benchmark.select(F.col(id_col), F.col(text_col).cast("string")).where(F.col(text_col).isNotNull())
    for item, text in rows.toLocalIterator():
        block.append((item, text))
        if len(block) == ITEM_BLOCK:
            yield Items(block)
            block = []
    if block:
        yield Items(block)


def _scan(docs: DataFrame, items: Items, id_col: str, text_col: str) -> DataFrame:
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(items)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("t"))
    id_type = dict(rows.dtypes)["doc_id"]

    def run(batches):
        for b in batches:
            ids = b.column("doc_id")
            for i, j, raw, offsets in slabs(b.column("t")):
                hits = held.value.find(*tokens(raw, offsets))
                if hits:
                    k, item, d, s, e = zip(*hits)
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(pa.array([i + x for x in k])), pa.array(item, pa.int64()), pa.array(d, pa.int32()), pa.array(s, pa.int64()), pa.array(e, pa.int64())],
                        ["doc_id", "item_id", "distance", "start_token", "end_token"])

    return rows.mapInArrow(run, f"doc_id {id_type}, item_id long, distance int, start_token long, end_token long")


def find_passages(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, item_id, distance, start_token, end_token: every item found in every document."""
    small_batches(docs.sparkSession)
    ship_package(docs.sparkSession)
    out = None
    for items in item_blocks(benchmark, item_col, item_text_col):
        part = _scan(docs, items, id_col, text_col)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else _scan(docs, Items([]), id_col, text_col)


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text holds no benchmark item, unchanged."""
    spark = docs.sparkSession
    small_batches(spark)
    ship_package(spark)
    for items in item_blocks(benchmark, item_col, item_text_col):
        held = spark.sparkContext.broadcast(items)

        def clean(batches, held=held):
            for b in batches:
                ok = np.ones(b.num_rows, bool)
                text = b.column(text_col)
                for i, _, raw, offsets in slabs(text):
                    for hit in held.value.find(*tokens(raw, offsets)):
                        ok[i + hit[0]] = False
                yield b.filter(pa.array(ok))

        docs = docs.mapInArrow(clean, docs.schema)
    return docs
