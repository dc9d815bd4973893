"""Byte-level BPE through one shuffle of distinct words.

Each scan task cuts its texts into chunks, splits them into pre-tokens, and
keeps per text the positions' word numbers in the chunk's own list of
distinct words. The words travel by hash bucket, so each distinct word of
the corpus is encoded in one task only and once; the ids go back by chunk,
where every text is put together by position. Decoding looks every id up in
the token-byte table (as large as the vocabulary, so it is sent to all tasks).

What is shuffled: a chunk's distinct words (a word in a third of all texts
counts once a chunk), their ids, and the compact word numbers of the texts.
Texts themselves stay with the scan.

The input is read twice (words, then texts), so it must give the same rows
both times: a stored table does. Chunks carry a digest of their words; if the
second read differs the job fails instead of returning wrong ids. Pass
``checkpoint_input=True`` for an unstable input.

Defined cases: a null or empty text has no ids and decodes to no bytes;
repeated rows are rows of their own; an empty table gives no rows; other
columns of the input are not read.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwright.llm.textvec import small_batches
from pairwright.session import checkpoint_root, ship_package

#: Bytes of text in a chunk (a longer text is a chunk of its own).
CHUNK_BYTES = 32 << 20
#: Chunks expected of an input partition (128 MB by Spark's default).
CHUNKS_A_SCAN = 4
#: Hash buckets of words at most: a chunk sends up to one row to each.
MOST_BUCKETS = 4096
#: Words an encoding task remembers; it starts anew beyond (the ids are the same).
KNOWN_WORDS = 2_000_000
#: Requests (a chunk's words of one bucket) encoded at once.
REQUEST_ROWS = 32
#: White space of any kind beside a space, or a space at an end of the text.
ODD_SPACES = r"\A | \z| [\t-\r\x1c-\x1f\x{85}\pZ]|[\t-\r\x1c-\x1f\x{85}\pZ] "
#: Texts in a batch of the result.
OUT_ROWS = 200
#: Words longer than this are merged with a heap.
LONG_WORD = 48


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> rank, from a rank file (read on the driver)."""
    with open(path, "rb") as f:
        return {base64.b64decode(t): int(r) for t, r in (line.split() for line in f if line.strip())}


def merge_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one word: the adjacent pair of lowest rank is merged first, the leftmost of equals."""
    if word in ranks:
        return [ranks[word]]
    if len(word) > LONG_WORD:
        return _merge_long(word, ranks)
    parts = [word[i:i + 1] for i in range(len(word))]
    get, none = ranks.get, len(ranks) + 1
    pair = [get(parts[i] + parts[i + 1], none) for i in range(len(parts) - 1)]
    while pair:
        best = min(pair)
        if best == none:
            break
        i = pair.index(best)
        parts[i:i + 2] = [parts[i] + parts[i + 1]]
        del pair[i]
        if i:
            pair[i - 1] = get(parts[i - 1] + parts[i], none)
        if i < len(pair):
            pair[i] = get(parts[i] + parts[i + 1], none)
    return [ranks[p] for p in parts]


def _merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges with a heap of pairs over a linked list."""
    n = len(word)
    end = list(range(1, n + 1))
    prev, nxt = list(range(-1, n - 1)), [*range(1, n), -1]
    alive = [True] * n
    heap = []

    def push(i):
        j = nxt[i]
        if j >= 0 and (r := ranks.get(word[i:end[j]])) is not None:
            heapq.heappush(heap, (r, i, end[j]))

    for i in range(n - 1):
        push(i)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = nxt[i] if alive[i] else -1
        if j < 0 or end[j] != stop or end[i] == stop:
            continue
        alive[j] = False
        end[i], nxt[i] = stop, nxt[j]
        if nxt[j] >= 0:
            prev[nxt[j]] = i
        if prev[i] >= 0:
            push(prev[i])
        push(i)
    out, i = [], 0
    while i >= 0:
        out.append(ranks[word[i:end[i]]])
        i = nxt[i]
    return out


class Merges:
    """The merges as a sorted array of id pairs, to encode many words at once.

    A pair of tokens merges where their bytes together are a token, so every
    way to part a token into two tokens is an entry.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.byte = np.array([ranks[bytes([k])] for k in range(256)], np.int64)
        pairs = {(ranks[t[:i]] << 32) + ranks[t[i:]]: r for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks}
        self.keys = np.array(sorted(pairs), np.int64)
        self.ids = np.array([pairs[k] for k in self.keys.tolist()], np.int64)
        #: Stands for "these two don't merge"; above every id.
        self.none = max(ranks.values()) + 1

    def merged(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(a.shape, self.none)
        key = (a << 32) + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ids[at], self.none)

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in a row, number of ids of each word), as ``merge_word`` gives them."""
        flat, size = [], 0
        start, count = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)

        def put(which, ids):
            nonlocal size
            m, n = ids.shape
            start[which], count[which] = size + np.arange(m) * n, n
            flat.append(ids.ravel())
            size += m * n

        by_size: dict[int, list[int]] = {}
        for k, w in enumerate(words):
            if (r := self.ranks.get(w)) is not None:
                put(np.array([k]), np.array([[r]]))
            elif len(w) > LONG_WORD:
                put(np.array([k]), np.array([merge_word(w, self.ranks)]))
            else:
                by_size.setdefault(len(w), []).append(k)
        for n, which in by_size.items():
            ids = self.byte[np.frombuffer(b"".join([words[k] for k in which]), np.uint8).reshape(len(which), n)]
            which = np.array(which)
            pair = self.merged(ids[:, :-1], ids[:, 1:])
            # All words left have the same number of ids, one fewer each time.
            while len(which):
                at = pair.argmin(axis=1) if pair.shape[1] else np.zeros(len(which), np.int64)
                best = pair[np.arange(len(which)), at] if pair.shape[1] else np.full(len(which), self.none)
                more = best < self.none
                if not more.all():
                    put(which[~more], ids[~more])
                    which, ids, pair, at, best = which[more], ids[more], pair[more], at[more], best[more]
                    if not len(which):
                        break
                row, width = np.arange(len(which)), ids.shape[1] - 1
                ids[row, at] = best
                col = np.arange(width)
                ids = np.take_along_axis(ids, col + (col > at[:, None]), axis=1)
                col = col[:-1]
                pair = np.take_along_axis(pair, col + (col >= at[:, None]), axis=1)
                left, right = at > 0, at < width - 1
                pair[row[left], at[left] - 1] = self.merged(ids[row[left], at[left] - 1], best[left])
                pair[row[right], at[right]] = self.merged(best[right], ids[row[right], at[right] + 1])
        out = np.concatenate([*flat, np.zeros(0, np.int64)])
        ends = np.cumsum(count)
        return out[np.repeat(start - ends + count, count) + np.arange(ends[-1] if len(ends) else 0)], count


def odd_spaces(texts: pa.Array) -> list[bool]:
    """Which texts have a space next to other white space, or at an end."""
    return pc.fill_null(pc.match_substring_regex(texts, ODD_SPACES), False).to_pylist()


class _Numbers(dict):
    """Numbers keys in the order they are first asked for."""

    def __missing__(self, key):
        n = self[key] = len(self)
        return n


class Pretokenizer:
    """Splits the texts of a chunk by the pattern, each distinct piece between single spaces once.

    A space with a non-space on both sides can only start a token, so the
    text may be cut before it. A text with other spaces next to a space is
    one piece. The first reading only collects pieces (``learn``), the second
    numbers them in each text (``__call__``); both meet them in the same
    order, so ``finish`` numbers the words alike.
    """

    def __init__(self, pattern: str):
        self.find = regex.compile(pattern).findall
        self.pieces = _Numbers()
        self.words: dict[str, int] = {}

    def _parts(self, text: str, odd: bool) -> list[str]:
        """The pieces of a text; those that begin a text have a space before them, as no others have."""
        if odd:
            return [" " + text]
        parts = text.split(" ")
        parts[0] = " " + parts[0]
        return parts

    def learn(self, text: str | None, odd: bool) -> None:
        """``odd``: a space of the text has another next to it or lies at an end (``odd_spaces``)."""
        if text:
            self.pieces.update(dict.fromkeys(self._parts(text, odd)))

    def __call__(self, text: str | None, odd: bool) -> np.ndarray:
        """The text's piece numbers."""
        return np.fromiter(map(self.pieces.__getitem__, self._parts(text, odd)), np.uint32) if text else np.zeros(0, np.uint32)

    def finish(self) -> tuple[np.ndarray, np.ndarray]:
        """(word numbers of all pieces in a row, where each piece's end); fills ``words``."""
        words, out, ends = self.words, [], []
        for p in self.pieces:
            if p.isalpha():
                out.append(words.setdefault(" " + p, len(words)))
            elif p[-1] in ".," and p[:-1].isalpha():
                out.append(words.setdefault(" " + p[:-1], len(words)))
                out.append(words.setdefault(p[-1], len(words)))
            else:
                # What begins a text was marked by a space that isn't its own.
                out += [words.setdefault(w, len(words)) for w in self.find(p[1:] if p[0] == " " else " " + p)]
            ends.append(len(out))
        return np.array(out, np.uint32), np.array(ends, np.int64)


def gather(flat: np.ndarray, start: np.ndarray, count: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The stretches flat[start:start + count] of the entries ``which``, in a row."""
    n = count[which]
    ends = np.cumsum(n)
    return flat[np.repeat(start[which] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)]


def pack(v: np.ndarray) -> bytes:
    """Numbers below 2**28 as 1 to 4 bytes of 7 bits."""
    v = v.astype(np.uint32)
    out = np.empty((len(v), 4), np.uint8)
    keep = np.empty((len(v), 4), bool)
    for k in range(4):
        out[:, k] = (v >> np.uint32(7 * k)) & np.uint32(0x7F)
        keep[:, k] = (v >> np.uint32(7 * k)) > 0 if k else True
    out[:, :3] |= np.where(keep[:, 1:], np.uint8(0x80), np.uint8(0))
    return out[keep].tobytes()


def unpack(b: bytes) -> np.ndarray:
    a = np.frombuffer(b, np.uint8)
    if not len(a):
        return np.zeros(0, np.int64)
    last = a < 0x80
    ends = np.flatnonzero(last) + 1
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    shift = (np.arange(len(a)) - np.repeat(starts, ends - starts)) * 7
    return np.add.reduceat((a & 0x7F).astype(np.int64) << shift, starts)


def _chunks(batches, pattern: str, keep: bool):
    """(chunk id, distinct words, (id, word numbers) of its texts if kept), chunk by chunk."""
    seq, held, size, split = 0, [], 0, Pretokenizer(pattern)

    def done():
        flat, ends = split.finish()
        words = list(split.words)
        h = hashlib.sha256(f"{TaskContext.get().partitionId()}/{seq}".encode())
        h.update("\0".join(words).encode("utf-8", "replace"))
        count = np.diff(ends, prepend=0)
        start = ends - count
        return (int.from_bytes(h.digest()[:8], "little", signed=True), words,
                [(doc_id, gather(flat, start, count, v)) for doc_id, v in held])

    for b in batches:
        sizes = pc.fill_null(pc.binary_length(b.column("t")), 0).to_pylist()
        for doc_id, text, odd, n_bytes in zip(b.column("doc_id") if keep else sizes, b.column("t").to_pylist(), odd_spaces(b.column("t")), sizes):
            if keep:
                held.append((doc_id, split(text, odd)))
            else:
                split.learn(text, odd)
            size += n_bytes
            if size >= CHUNK_BYTES:
                yield done()
                seq, held, size, split = seq + 1, [], 0, Pretokenizer(pattern)
    if held or split.pieces:
        yield done()


def token_table(ranks: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The token-byte table: all bytes, and each id's start and length in them."""
    tokens = [b""] * (max(ranks.values()) + 1)
    for token, r in ranks.items():
        tokens[r] = token
    sizes = np.array([len(t) for t in tokens])
    return np.frombuffer(b"".join(tokens), np.uint8), np.cumsum(sizes) - sizes, sizes


def decode_lists(column: pa.Array, table: tuple[np.ndarray, np.ndarray, np.ndarray]) -> pa.Array:
    """The bytes of every list of ids (a null list: no bytes), a text at a time."""
    raw, start, size = table
    offsets = column.offsets.to_numpy() if len(column) else np.zeros(1, np.int64)
    ids = column.values.to_numpy() if len(column) else np.zeros(0, np.int32)
    out = []
    for a, b in zip(offsets[:-1], offsets[1:]):
        own = ids[a:b]
        n = size[own]
        ends = np.cumsum(n)
        out.append(raw[np.repeat(start[own] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)].tobytes())
    return pa.array(out, pa.binary())


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
           checkpoint_input: bool = False, decoded: bool = False) -> DataFrame:
    """doc_id, ids array<int> of every whole text.

    With ``decoded`` the ids are decoded again in the same task, as ``decode``
    would, into the column ``decoded``.
    """
    spark = docs.sparkSession
    small_batches(spark)
    ship_package(spark)
    loaded = load_ranks(ranks_path)
    merges = spark.sparkContext.broadcast(Merges(loaded))
    table_sent = spark.sparkContext.broadcast(token_table(loaded))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("t"))
    if checkpoint_input:
        checkpoint_root(spark)
        rows = rows.checkpoint()
    id_type = dict(rows.dtypes)["doc_id"]
    # More input, more tasks: an input partition is a few chunks, and a task takes about one.
    scans = rows.rdd.getNumPartitions()
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), CHUNKS_A_SCAN * scans)
    buckets = min(4 * tasks, MOST_BUCKETS)

    def words_of(batches):
        for chunk, words, _ in _chunks(batches, pattern, False):
            own: list[list[str]] = [[] for _ in range(buckets)]
            at: list[list[int]] = [[] for _ in range(buckets)]
            for i, w in enumerate(words):
                k = zlib.crc32(w.encode("utf-8", "replace")) % buckets
                own[k].append(w)
                at[k].append(i)
            used = [k for k in range(buckets) if own[k]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(used, pa.int32()), pa.array([chunk] * len(used), pa.int64()), pa.array([own[k] for k in used], pa.list_(pa.string())),
                 pa.array([pack(np.diff(at[k], prepend=0)) for k in used], pa.binary())], ["bucket", "chunk", "words", "at"])

    def encode_words(batches):
        known: dict[str, bytes] = {}
        table = merges.value
        for b in batches:
            for i in range(0, b.num_rows, REQUEST_ROWS):
                part = b.slice(i, REQUEST_ROWS)
                if len(known) > KNOWN_WORDS:
                    known.clear()
                lists = part.column("words").to_pylist()
                new = list(set().union(*lists).difference(known))
                ids, n = table.encode([w.encode("utf-8", "replace") for w in new])
                raw, ends = ids.astype(np.int32).tobytes(), (4 * np.cumsum(n)).tolist()
                known.update(zip(new, (raw[x:y] for x, y in zip([0, *ends], ends))))
                ids_out, n_out = [], []
                for words in lists:
                    got = [known[w] for w in words]
                    ids_out.append(pack(np.frombuffer(b"".join(got), np.int32)))
                    n_out.append(pack(np.fromiter(map(len, got), np.int64, len(got)) >> 2))
                yield pa.RecordBatch.from_arrays([part.column("chunk"), part.column("at"), pa.array(ids_out, pa.binary()), pa.array(n_out, pa.binary())], ["chunk", "at", "ids", "n"])

    def texts_of(batches):
        for chunk, _, held in _chunks(batches, pattern, True):
            for i in range(0, len(held), 500):
                part = held[i:i + 500]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([chunk] * len(part), pa.int64()), pa.array([d for d, _ in part]), pa.array([pack(v) for _, v in part], pa.binary())],
                    ["chunk", "doc_id", "numbers"])

    def assemble(texts: pa.Table, replies: pa.Table) -> pa.Table:
        at = [np.cumsum(unpack(x)) for x in replies.column("at").to_pylist()]
        ids = [unpack(x) for x in replies.column("ids").to_pylist()]
        n = [unpack(x) for x in replies.column("n").to_pylist()]
        at = np.concatenate(at) if at else np.zeros(0, np.int64)
        flat = np.concatenate(ids) if ids else np.zeros(0, np.int64)
        n = np.concatenate(n) if n else np.zeros(0, np.int64)
        begin = np.cumsum(n) - n
        # Word number -> where its ids lie.
        start, count = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        start[at], count[at] = begin, n
        def one(packed: bytes) -> np.ndarray:
            v = unpack(packed)
            if len(v) and v.max() >= len(at):
                raise RuntimeError("the input gave other rows when read again; pass checkpoint_input=True")
            return gather(flat, start, count, v).astype(np.int32)

        # Small batches: a chunk's ids are never in one piece.
        out = []
        for i in range(0, len(texts), OUT_ROWS):
            part = texts.slice(i, OUT_ROWS).combine_chunks()
            ids = [one(packed) for packed in part.column("numbers").to_pylist()]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids)))
            columns = {"doc_id": part.column("doc_id").chunk(0), "ids": lists}
            if decoded:
                columns["decoded"] = decode_lists(lists, table_sent.value)
            out.append(pa.RecordBatch.from_pydict(columns))
        return pa.Table.from_batches(out) if out else pa.table({"doc_id": texts.column("doc_id"), "ids": pa.array([], pa.list_(pa.int32()))} | ({"decoded": pa.array([], pa.binary())} if decoded else {}))

    requests = rows.mapInArrow(words_of, "bucket int, chunk long, words array<string>, at binary").repartition(min(tasks, buckets), "bucket")
    replies = requests.select("chunk", "words", "at").mapInArrow(encode_words, "chunk long, at binary, ids binary, n binary")
    texts = rows.mapInArrow(texts_of, f"chunk long, doc_id {id_type}, numbers binary")
    # A task's share stays about one chunk however large the input is.
    joined = texts.repartition(tasks, "chunk").groupBy("chunk").cogroup(replies.repartition(tasks, "chunk").groupBy("chunk"))
    return joined.applyInArrow(assemble, f"doc_id {id_type}, ids array<int>" + ", decoded binary" * decoded)


def decode(encoded: DataFrame, ranks_path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """The input's columns with the bytes of its ids (a null list: no bytes)."""
    spark = encoded.sparkSession
    small_batches(spark)
    ship_package(spark)
    held = spark.sparkContext.broadcast(token_table(load_ranks(ranks_path)))
    k = encoded.columns.index(ids_col)

    def run(batches):
        for b in batches:
            out = decode_lists(b.column(k), held.value)
            yield pa.RecordBatch.from_arrays([*b.columns, out], schema=pa.schema([*b.schema, pa.field(out_col, pa.binary())]))

    from pyspark.sql.types import BinaryType, StructType

    return encoded.mapInArrow(run, StructType([*encoded.schema.fields]).add(out_col, BinaryType()))


def digests(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256."""
    both = encode(docs, ranks_path, pattern, id_col, text_col, decoded=True)
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
