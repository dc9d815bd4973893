import math

import numpy as np
import pytest

from pairwright.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, dim):
    """All (anchor, positive, rank, negative, scores) by comparing every pair of rows."""
    kept = []
    for i, v, label in rows:
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        if i is not None and i % 7 == 0:
            label = (label + 1) % 10
        x = [max(-H.MAX_COMPONENT, min(H.MAX_COMPONENT, math.floor(256 * float(np.float32(c))))) for c in v]
        kept.append((i, x + [0] * (dim - len(x)), label))
    first = lambda found: sorted(found, key=lambda f: (-f[0], f[1] is None, f[1] or 0))
    out = []
    for a, (i, x, label) in enumerate(kept):
        if i is None or i % 100:
            continue
        scores = [(sum(p * q for p, q in zip(x, y)), j, other) for b, (j, y, other) in enumerate(kept) if b != a]
        for ps, p, _ in first([s for s in scores if s[2] == label])[:5]:
            fits = [s for s in scores if s[2] != label and 30 * ps <= 100 * s[0] <= 90 * ps]
            out += [(i, p, r, n, ps, ns) for r, (ns, n, _) in enumerate(first(fits)[:10], 1)]
    return sorted(out, key=str)


def run(df):
    rows = H.mine_hard_negatives(df, label=H.shifted_label())
    assert rows.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted((tuple(r) for r in rows.collect()), key=str)


def vectors(seed, n, dim, near=0.0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(10, dim))
    labels = rng.integers(0, 10, n)
    x = (rng.normal(size=(n, dim)) * (1 - near) + centres[labels] * near) / math.sqrt(dim)
    return [(i, [float(c) for c in v], int(k)) for i, (v, k) in enumerate(zip(x.astype(np.float32), labels))]


@pytest.mark.parametrize("seed, n, dim, near", [(1, 1500, 12, 0.0), (2, 1500, 3, 0.6), (3, 300, 64, 0.2)])
def test_equals_all_pairs(spark, seed, n, dim, near):
    rows = vectors(seed, n, dim, near)
    assert run(spark.createDataFrame(rows, SCHEMA).repartition(5)) == brute(rows, dim)


def test_odd_rows(spark):
    rows = vectors(4, 250, 4, 0.5)
    rows += [(1000, None, 1), (1001, [0.1, None, 0.2, 0.3], 2), (1002, [float("nan")] * 4, 3), (1003, [float("inf"), 0.0, 0.0, 0.0], 3),
             (1004, [0.5] * 4, None), (None, [0.4, 0.1, 0.3, 0.2], 1), (None, [0.4, 0.1, 0.3, 0.2], 2), (1005, [], 2), (1100, [0.7], 2),
             (1200, [0.0] * 4, 5), (1300, [-0.4] * 4, 5), (1400, [3e38, -3e38, 1.0, 1.0], 6)]
    rows += [rows[0], rows[100], rows[101], (200, [0.3, 0.3, 0.3, 0.3], 4)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS score", "'y' AS p", "1 AS tile", "2 AS akey", "3 AS rank")
    assert run(df.repartition(3)) == brute(rows, 4)


def test_one_vector_in_a_third_of_the_rows(spark):
    """Copies are cut between tiles, and ties go to the smaller id."""
    rows = vectors(5, 1200, 6, 0.4)
    rows = [(i, rows[3][1] if i % 3 == 0 else v, 3 if i % 3 == 0 else label) for i, v, label in rows]
    vecs = np.array([[math.floor(256 * c) for c in v] for _, v, _ in rows])
    tie = np.random.default_rng(0).integers(-2**62, 2**62, len(rows))
    tiles = H.Tiles(vecs, tie, 16)
    assert np.bincount(tiles.of(vecs, tie)).max() < 2.5 * len(rows) / tiles.count
    assert run(spark.createDataFrame(rows, SCHEMA)) == brute(rows, 6)


def test_blocks_of_anchors_and_small_packs(spark, monkeypatch):
    rows = vectors(6, 900, 5, 0.3)
    df = spark.createDataFrame(rows, SCHEMA)
    want = brute(rows, 5)
    monkeypatch.setattr(H, "ANCHOR_BLOCK", 4)
    monkeypatch.setattr(H, "TILE_ROWS", 50)
    assert run(df) == want


def test_boxes_outside_the_window_stay_closed():
    """On spread-out points the walk opens few leaves."""
    rng = np.random.default_rng(7)
    vecs = rng.integers(-1000, 1000, (8000, 2))
    tree = H.RTree(np.arange(8000), np.zeros(8000, int), vecs, 1000)
    wanted = H.Best(5, 0)
    opened = []
    need = lambda lo, hi: (hi >= wanted.floor()) if wanted.floor() is not None else hi == hi
    for score, rows in tree.walk(vecs[0], need):
        opened.append(rows)
        wanted.add(score, tree.ids[rows])
    assert len(opened) <= 12
    want = sorted(((-int(v @ vecs[0]), i) for i, v in enumerate(vecs)))[:5]
    assert list(zip(-wanted.score.astype(int), wanted.ids)) == want


def test_few_rows_and_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert run(empty) == []
    rows = [(0, [0.5, 0.5], 1), (1, [0.4, 0.4], 2), (2, [0.5, 0.4], 2)]
    assert run(spark.createDataFrame(rows, SCHEMA)) == brute(rows, 2)


def test_query_equals_its_sql(spark):
    import duckdb

    from pairwright.llm.queries import ORACLE_SQL, QUERIES

    con = duckdb.connect()
    con.execute("CREATE VIEW embeddings AS SELECT * FROM read_parquet('/root/testdata/sf0.001/embeddings.parquet')")
    want = con.execute(ORACLE_SQL["op11_str_rtree_negatives"]).fetchall()
    got = QUERIES["op11_str_rtree_negatives"](spark, "/root/testdata/sf0.001").collect()
    assert want and sorted(map(tuple, got)) == sorted(want)
