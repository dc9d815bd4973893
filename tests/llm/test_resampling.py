import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from pairwright.llm import resampling as R
from llm_fixtures import ODD, docs_of, empty, odd  # noqa: F401


def features(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return words, [" ".join(words[i:i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def brute(rows, target, least=20):
    bucket = lambda f: zlib.crc32(f.encode()) % 10000
    s = Counter(bucket(f) for _, text in rows for f in features(text)[1])
    t = Counter(bucket(f) for text in target for f in features(text)[1])
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s_all + 10000) / ((s[b] + 1) * (t_all + 10000))))
    out = []
    for i, text in rows:
        words, feats = features(text)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(bucket(f)) for f in feats)
        out.append([i, len(feats), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words)])
    fit = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    rank = {id(r): k for k, r in enumerate(fit[:5 * len(fit) // 100], 1)}
    return sorted(((*r[:4], rank.get(id(r))) for r in out), key=str)


def run(docs, target):
    got = R.resample(docs, target)
    assert got.dtypes == [("doc_id", "bigint"), ("n_features", "bigint"), ("weight", "bigint"), ("score", "bigint"), ("rank", "bigint")]
    return sorted((tuple(r) for r in got.collect()), key=str)


def texts(seed, n):
    rnd = random.Random(seed)
    vocab = ["".join(rnd.choice("abcdeXYZ019éß中") for _ in range(rnd.randrange(1, 14))) for _ in range(300)]
    return [(i, rnd.choice(["", " ", "\n"]).join([""] + [rnd.choice(vocab) + rnd.choice([" ", ", ", " - ", "\x00", "_"]) for _ in range(rnd.randrange(0, 90))])) for i in range(n)]


def target_of(spark, rows):
    return spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "item_id long, text string")


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    rows = texts(seed, 400)
    target = [t for _, t in texts(seed + 10, 30)] + [None, ""]
    assert run(docs_of(spark, rows, extra=True).repartition(5), target_of(spark, target)) == brute(rows, target)


def test_pieces_of_long_texts(spark, monkeypatch):
    """N-grams over the edges of pieces count once."""
    monkeypatch.setattr(R, "PIECE_WORDS", 7)
    monkeypatch.setattr(R, "PIECE_BYTES", 40)
    rows = texts(3, 60)
    spans = [s for piece in R._pieces(__import__("pyarrow").array([t for _, t in rows])) if piece[3] is not None for s in [piece[3]]]
    got = Counter(x for s in spans for x in s.bytes_of(np.arange(len(s))))
    assert got == Counter(f.encode() for _, t in rows for f in features(t)[1])


def test_odd_rows(spark, odd):
    rows = [(i, t) for i, t in ODD]
    assert run(odd, target_of(spark, ["the quick brown fox"])) == brute(rows, ["the quick brown fox"])


def test_empty_tables(spark, empty):
    assert run(empty, target_of(spark, ["a b"])) == []
    rows = [(i, "w " * 25) for i in range(40)]
    assert run(docs_of(spark, rows), target_of(spark, ["x"]).where("false")) == brute(rows, [])


def test_hashes_are_xxhash64():
    rnd = np.random.default_rng(5)
    buf = rnd.integers(0, 256, 5000).astype(np.uint8)
    sizes = np.concatenate([np.arange(70), rnd.integers(0, 400, 200)])
    starts = rnd.integers(0, 4500, len(sizes))
    spans = R.Spans(buf, starts, starts + sizes)
    assert spans.hashes().tolist() == [xxhash.xxh64_intdigest(buf[a:a + n].tobytes()) for a, n in zip(starts, sizes)]


@pytest.mark.parametrize("keys", [None, 0, 3])
def test_equal_keys_are_told_apart_by_bytes(keys):
    """With keys that clash, different n-grams still get slots of their own."""
    rnd = random.Random(6)
    words = [("x" * rnd.choice([1, 8, 9, 40]) + str(rnd.randrange(30))).encode() for _ in range(500)]
    buf = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum([len(w) for w in words])
    spans = R.Spans(buf, ends - np.array([len(w) for w in words]), ends)
    made = spans.hashes() if keys is None else spans.hashes() % np.uint64(keys + 1)
    table = R.GramTable(spans, 10000, made)
    seen = {}
    for w, slot in zip(words, table.slot.tolist()):
        assert seen.setdefault(slot, w) == w
        assert table.bucket[slot] == zlib.crc32(w) % 10000
    assert len(seen) == len(set(words)) == len(table.bucket)
    assert table.count.tolist() == [Counter(words)[seen[s]] for s in range(len(seen))]
