import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pairwright.llm import decontaminate as D
from llm_fixtures import docs_of, empty, odd  # noqa: F401

VOCAB = [f"word{k}" for k in range(300)]


def plain_search(pattern, text):
    """Smallest edit distance of the pattern to any stretch of the text, by the full table."""
    col = list(range(len(pattern) + 1))
    best = col[-1]
    for x in text:
        new = [0]
        for i, p in enumerate(pattern):
            new.append(min(col[i] + (p != x), col[i + 1] + 1, new[i] + 1))
        col = new
        best = min(best, col[-1])
    return best


@given(st.lists(st.integers(0, 3), min_size=1, max_size=12), st.lists(st.integers(0, 3), max_size=30))
@settings(max_examples=300, deadline=None)
def test_bit_parallel_search(pattern, text):
    d, end = D.search(pattern, text)
    assert d == plain_search(pattern, text)
    assert min(len(pattern), plain_search(pattern, text[:end])) == d


def benchmark_of(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


def edit(words, n, rnd):
    w = list(words)
    for _ in range(n):
        p = rnd.randrange(len(w))
        if rnd.random() < 0.4:
            w[p] = rnd.choice(VOCAB)
        elif rnd.random() < 0.5:
            w.insert(p, rnd.choice(VOCAB))
        else:
            del w[p]
    return w


@pytest.mark.parametrize("share,least", [(0.0, 1.0), (0.1, 0.99), (0.2, 0.95)])
def test_recall_and_no_false_hits(spark, share, least):
    rnd = random.Random(7)
    items = [(k, " ".join(rnd.choices(VOCAB, k=rnd.randrange(12, 50)))) for k in range(40)]
    rows, want = [], set()
    for i in range(240):
        w = rnd.choices(VOCAB, k=rnd.randrange(0, 150))
        if i % 2:
            k = rnd.randrange(40)
            item = items[k][1].split()
            at = rnd.randrange(len(w) + 1)
            w[at:at] = edit(item, int(share * len(item)), rnd)
            want.add((i, k))
        rows.append((i, " ".join(w).title() + "."))
    hits = D.find_passages(docs_of(spark, rows, extra=True), benchmark_of(spark, items)).collect()
    got = {(r.doc_id, r.item_id) for r in hits}
    assert len(got & want) >= least * len(want)
    text, item = dict(rows), dict(items)
    for r in hits:
        tokens = text[r.doc_id].lower().replace(".", "").split()
        pattern = item[r.item_id].split()
        assert r.distance == plain_search(pattern, tokens) <= D.edits_allowed(len(pattern))
    clean = {r.doc_id for r in D.decontaminate(docs_of(spark, rows, extra=True), benchmark_of(spark, items)).collect()}
    assert clean == set(text) - {d for d, _ in got}


def test_odd_rows(spark, odd, empty):
    bench = benchmark_of(spark, [(1, None), (2, ""), (3, "123 456"), (4, "the quick brown fox jumps over the lazy dog the quick"), (5, "the quick brown fox jumps over the lazy dog the quick")])
    hits = {(r.doc_id, r.item_id, r.distance) for r in D.find_passages(odd, bench).collect()}
    assert hits == {(7, 3, 0), (8, 4, 0), (8, 5, 0)}
    assert D.decontaminate(odd, bench).columns == odd.columns
    assert D.decontaminate(odd, bench).count() == odd.count() - 2
    assert D.find_passages(empty, bench).count() == 0
    assert D.find_passages(odd, bench.where("false")).count() == 0
    assert D.decontaminate(odd, bench.where("false")).count() == odd.count()


def test_item_blocks_give_the_same(spark, odd, monkeypatch):
    bench = benchmark_of(spark, [(k, "the quick brown fox jumps over the lazy dog") for k in range(7)])
    one = sorted(map(tuple, D.find_passages(odd, bench).collect()))
    monkeypatch.setattr(D, "ITEM_BLOCK", 2)
    assert sorted(map(tuple, D.find_passages(odd, bench).collect())) == one and len(one) == 7


def test_walk_keeps_equal_windows_equal():
    items = D.Items([(1, " ".join(VOCAB[:20])), (2, " ".join(VOCAB[5:25]))])
    h = np.array(items.seqs[0] + items.seqs[0], np.uint64)
    keys = items.keys(h, np.array([0, 20]), np.array([20, 40]), np.array([20, 20]))
    assert (keys[0] == keys[1]).all()


@pytest.mark.parametrize("kind", ["delete", "insert", "substitute"])
@pytest.mark.parametrize("n", [30, 50, 100, 200, 300])
def test_no_item_within_the_edit_bound_is_lost(kind, n):
    rnd = random.Random(n)
    weights = [1 / (k + 1) for k in range(len(VOCAB))]
    draw = lambda k: rnd.choices(VOCAB, weights, k=k)
    texts = [draw(n) for _ in range(25)]
    items = D.Items([(k, " ".join(w)) for k, w in enumerate(texts)])
    rows = []
    for w in texts:
        w = list(w)
        for _ in range(int(0.2 * n)):
            at = rnd.randrange(len(w))
            if kind == "delete":
                del w[at]
            elif kind == "insert":
                w.insert(at, draw(1)[0])
            else:
                w[at] = draw(1)[0]
        rows.append(" ".join([*draw(40), *w, *draw(40)]).encode())
    raw, offsets = np.frombuffer(b"".join(rows), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in rows])])
    found = {(k, item) for k, item, *_ in items.find(*D.tokens(raw, offsets))}
    assert found >= {(k, k) for k in range(25)}


def test_short_items_and_unspaced_scripts_inside_texts(spark):
    chinese = "床前明月光疑是地上霜舉頭望明月低頭思故鄉"
    bench = benchmark_of(spark, [(1, "Photosynthesis converts sunlight"), (2, "yes"), (3, chinese), (4, "สวัสดีครับยินดีต้อนรับ"), (5, "東京は日本の"), (6, "\U00020000\U00020001\U00020002\U00020003\U00020004\U00020005\U00020006\U00020007x")])
    docs = docs_of(spark, [(1, "They say photosynthesis converts sunlight, photosynthesis converts sunlight."), (2, "yes and no"), (3, "Yes!"), (4, f"前文在此。{chinese}。後文"),
                           (5, "ก่อน สวัสดีครับยินดีต้อนรับทุกคน"), (6, "昔東京は日本の首都"), (7, "photosynthesis converts the sunlight"), (8, "東京は日本"), (9, f"詩 {chinese[:9]}x{chinese[10:]}"),
                           (10, "a\U00020000\U00020001\U00020002\U00020003\U00020004\U00020005\U00020006\U00020007x")])
    hits = D.find_passages(docs, bench).collect()
    assert {(r.doc_id, r.item_id, r.distance) for r in hits} == {(1, 1, 0), (3, 2, 0), (4, 3, 0), (5, 4, 0), (6, 5, 0), (9, 3, 1), (10, 6, 0)}
    assert [(r.start_token, r.end_token) for r in hits if r.doc_id in (1, 6)] == [(2, 5), (1, 7)]
    assert sorted(r.doc_id for r in D.decontaminate(docs, bench).collect()) == [2, 7, 8]
