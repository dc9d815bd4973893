import math
import re
import zlib
from collections import Counter

import numpy as np

from pairwright.llm import ctw
from llm_fixtures import ODD, docs_of, empty, odd  # noqa: F401

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def plain_base(rows):
    tokens = [WORD.findall((t or "").translate(LOWER)) + [None] for _, t in rows]
    out_ids = [zlib.crc32(b"" if d is None else str(d).encode()) % 10 == 0 for d, _ in rows]
    c = Counter(w for ws, h in zip(tokens, out_ids) if not h for w in ws)
    n, v = sum(c.values()), len(c)
    return [(d, h, len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)) for (d, _), ws, h in zip(rows, tokens, out_ids)]


def check(rows, docs):
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in ctw.score_texts(docs).collect()), key=str)
    assert got == sorted(((*x[:5], round(x[5], 6)) for x in plain_base(rows)), key=str)


def test_base_on_odd_rows(spark, odd, empty):
    check(ODD, odd)
    assert ctw.score_texts(empty).count() == 0


def test_base_over_many_chunks(spark, monkeypatch):
    monkeypatch.setattr(ctw, "CHUNK_BYTES", 400)
    rows = [(i, f"The the {i % 9} words, of text {i}\n") for i in range(200)]
    check(rows, docs_of(spark, rows).repartition(3).checkpoint())


def recursive(texts, depth, context, byte):
    """log10 P(byte | context) by the definition, from the bytes of the training texts.

    A context is a tuple with the byte just before first.
    """
    seen = {}
    for text in texts:
        padded = bytes([255] * depth) + text + b"\xff"
        for k in range(depth, len(padded)):
            for d in range(depth + 1):
                seen.setdefault(tuple(padded[k - 1 - i] for i in range(d)), []).append(padded[k])

    def counts(ctx, level, prefix):
        bits = [x >> (7 - level) & 1 for x in seen.get(ctx, []) if x >> (8 - level) == prefix]
        return len(bits) - sum(bits), sum(bits)

    def kt(a, b):
        p = 1.0
        for k in range(a):
            p *= (k + 0.5) / (k + 1)
        for k in range(b):
            p *= (k + 0.5) / (a + k + 1)
        return p

    def weighted(ctx, level, prefix):
        a, b = counts(ctx, level, prefix)
        if len(ctx) == depth:
            return kt(a, b)
        return 0.5 * kt(a, b) + 0.5 * math.prod(weighted((*ctx, x), level, prefix) for x in range(256) if (*ctx, x) in seen)

    def predict(ctx, level, prefix):
        a, b = counts(ctx, level, prefix)
        own = (b + 0.5) / (a + b + 1)
        child = context[:len(ctx) + 1]
        if len(ctx) == depth or sum(counts(child, level, prefix)) == 0:
            return own
        stop = 0.5 * kt(a, b) / weighted(ctx, level, prefix)
        return stop * own + (1 - stop) * predict(child, level, prefix)

    total = 0.0
    for level in range(8):
        p = predict((), level, byte >> (8 - level))
        total += math.log10(p if byte >> (7 - level) & 1 else 1 - p)
    return total


def levels_of(texts, depth):
    raw = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    code = ctw.events(raw, offsets, depth)[1]
    return [np.unique(code & ctw._mask(d), return_counts=True) for d in range(depth + 1)]


def test_weighting_by_the_definition():
    texts = [b"abcab", b"abba", b"cab"]
    model = ctw.ContextTree(levels_of(texts, 2))
    for context in ((97, 98), (98, 97), (255, 255), (99, 120), (120, 121)):
        for byte in (97, 98, 99, 100, 255, 0):
            code = np.array([(context[1] << 8 | context[0]) << 8 | byte])
            assert abs(model.score(code)[0] - recursive(texts, 2, context, byte)) < 1e-5


def test_every_context_has_a_distribution():
    rng = np.random.default_rng(1)
    texts = [rng.choice(np.frombuffer(b"abcde", np.uint8), 300).tobytes() for _ in range(5)]
    full = levels_of(texts, 5)
    for levels in (full, [full[0], full[1], *((c[n > 3], n[n > 3]) for c, n in full[2:3])], [(np.zeros(0, np.int64), np.zeros(0, np.int64))]):
        model = ctw.ContextTree(levels)
        for context in (0, 0x6162636465, 0x6161616161, 0xFFFFFFFFFF):
            p = 10 ** model.score(context << 8 | np.arange(256))
            assert abs(p.sum() - 1) < 1e-5


def test_bounded_levels_keep_parents(spark):
    rows = [(i, f"some text {i % 13} and {i % 7} more of it {i}") for i in range(300)]
    counts = ctw.count_events(docs_of(spark, rows).repartition(3))
    full, small = ctw.kept_levels(counts), ctw.kept_levels(counts, max_events=150)
    assert sum(n.sum() for _, n in full) == 6 * sum(len(t) + 1 for _, t in rows)
    for d, (code, n) in enumerate(small):
        assert len(code) <= 150 and set(code) <= set(full[d][0])
        if d:
            assert set((code >> 8) & (ctw._mask(d - 1) >> 8)) <= set(small[d - 1][0] >> 8)
    bound = ctw.ContextTree(small)
    p = 10 ** bound.score(int.from_bytes(b"text ", "big") << 8 | np.arange(256))
    assert abs(p.sum() - 1) < 1e-5


def test_learned_text_scores_higher(spark):
    rows = [(i, "the cat sat on the mat and the dog ran") for i in range(1, 60)] + [(900, "the cat ran on the mat"), (901, "zqx vvk jjq xkz wqp")]
    got = {r.doc_id: r for r in ctw.score_texts(docs_of(spark, rows)).collect()}
    assert got[900].bits_per_byte < got[901].bits_per_byte
    assert all(r.score < 0 for r in got.values())


def test_scores_keep_every_context(spark, monkeypatch):
    # More contexts than any gathered table would have at its bound before: each text has its own.
    monkeypatch.setattr(ctw, "CHUNK_BYTES", 5_000)
    rng = np.random.default_rng(4)
    rows = [(i, bytes(rng.choice(np.frombuffer(b"abcdefghijklmnopqrstuvwxyz0123456789 ", np.uint8), 2_000)).decode()) for i in range(450)]
    rows += [(1000 + i, rows[i][1][:300] + "\u00e9\u4e2d new") for i in range(20)] + [(2000, None), (2001, "")]
    docs = docs_of(spark, rows).repartition(3).checkpoint()
    whole = ctw.ContextTree(ctw.kept_levels(ctw.count_events(docs.where(~ctw.held_out()))))
    assert len(whole.pair_keys) > 1_600_000 and np.count_nonzero(whole.pair_keys >> 56 == 5) > 400_000
    got = {r.doc_id: r for r in ctw.score_texts(docs).collect()}
    assert len(got) == len(rows)
    for i, text in rows:
        raw = np.frombuffer((text or "").encode(), np.uint8)
        want = whole.score(ctw.events(raw, np.array([0, len(raw)]))[1]).sum()
        assert abs(got[i].score - want) < 1e-5 * max(1, abs(want))
