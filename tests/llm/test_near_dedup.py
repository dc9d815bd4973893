import random
import re

import numpy as np
import pytest

from pairwright.llm import near_dedup as N
from pairwright.llm.components import components
from llm_fixtures import ODD, docs_of, empty, odd  # noqa: F401

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def sets_of(rows):
    out = []
    for _, t in rows:
        w = WORD.findall((t or "").translate(LOWER))
        out.append({tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    return out


def brute(rows):
    """(doc_id, n, component, kept) by comparing all pairs."""
    sets, root = sets_of(rows), list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            inter = len(a & sets[j])
            if a and rows[i][0] is not None and rows[j][0] is not None and 100 * inter >= 85 * (len(a) + len(sets[j]) - inter):
                root[find(i)] = find(j)
    out = []
    for i, (d, _) in enumerate(rows):
        c = None if d is None else min(rows[k][0] for k in range(len(rows)) if rows[k][0] is not None and find(k) == find(i))
        out.append((d, len(sets[i]), c, d is None or d == c))
    return sorted(out, key=str)


def run(docs):
    return sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in N.near_groups(docs).collect()), key=str)


def edited(words, edits, rnd):
    w = list(words)
    for _ in range(edits):
        w[rnd.randrange(len(w))] = f"x{rnd.randrange(10**6)}"
    return " ".join(w)


def near_copies(seed, groups=6, size=25):
    rnd, rows = random.Random(seed), []
    for _ in range(groups):
        base = [f"w{rnd.randrange(400)}" for _ in range(rnd.randrange(20, 160))]
        for _ in range(size):
            rows.append((len(rows), edited(base, rnd.randrange(0, 4), rnd)))
            if rnd.random() < 0.2:
                rows.append((len(rows), rows[-1][1]))
    rnd.shuffle(rows)
    return rows


def test_components_against_all_pairs(spark):
    rows = near_copies(3)
    assert run(docs_of(spark, rows).repartition(5)) == brute(rows)


def test_small_blocks_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 4)
    rows = near_copies(4, groups=3, size=40)
    assert run(docs_of(spark, rows).repartition(5)) == brute(rows)


def test_odd_rows(spark, odd, empty):
    assert run(odd) == brute(ODD)
    assert N.near_groups(empty).count() == 0


def test_sketch_estimates_similarity():
    rng = np.random.default_rng(0)
    for j in (0.85, 0.95):
        both = rng.integers(0, 2**63, int(4000 * j), dtype=np.uint64)
        parts = [np.sort(np.concatenate([both, rng.integers(0, 2**63, int(2000 * (1 - j)), dtype=np.uint64)])) for _ in range(2)]
        _, s = N.signatures(np.concatenate(parts), np.array([0, len(parts[0])]))
        x = int(np.bitwise_count(s[0] ^ s[1]).sum())
        estimate = 1 + N.SKETCH_BITS / (4 * N.HASHES) * np.log(1 - 2 * x / N.SKETCH_BITS)
        true = len(both) / (len(parts[0]) + len(parts[1]) - len(both))
        assert abs(estimate - true) < 0.1 and x <= N.MAX_XOR


@pytest.mark.parametrize("columns", [3, 8192])
def test_intersections(monkeypatch, columns):
    monkeypatch.setattr(N, "COLUMNS", columns)
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 30, k)) for k in (5, 9, 20, 1, 30)]
    want = [[len(np.intersect1d(a, b)) for b in sets] for a in sets]
    assert N.intersections(sets).tolist() == want


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, k) for k in range(101, 160)] + [(200, 200), (None, 3)]
    got = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert got == {**{i: 0 for i in range(61)}, **{k: 100 for k in range(100, 160)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
