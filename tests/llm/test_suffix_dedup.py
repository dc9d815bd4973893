import hashlib
import random
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pytest

from pairwright.llm import suffix_dedup as S
from llm_fixtures import ODD, docs_of, empty, odd  # noqa: F401


def brute(rows):
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(b[s:s + 200] for b in texts for s in range(len(b) - 199))
    out = []
    for (d, _), b in zip(rows, texts):
        cover = np.zeros(len(b) + 1, np.int64)
        for s in range(len(b) - 199):
            if seen[b[s:s + 200]] > 1:
                cover[s] += 1
                cover[s + 200] -= 1
        gone = np.cumsum(cover)[:len(b)] > 0
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((d, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def run(docs, **kw):
    return sorted((tuple(r) for r in S.removal_digests(docs, **kw).collect()), key=str)


def planted(seed):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefghé") for _ in range(rnd.randrange(1, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passages = [prose(rnd.randrange(30, 140)) for _ in range(6)]
    rows = []
    for i in range(120):
        parts = [prose(rnd.randrange(0, 60))]
        for _ in range(rnd.randrange(0, 3)):
            p = rnd.choice(passages)
            a = rnd.randrange(0, 60)
            parts += [p[a:a + rnd.choice([150, 195, 205, 400, 2000])], prose(rnd.randrange(0, 30))]
        rows.append((i, " ".join(parts)))
    rows += [(200 + k, rows[k][1]) for k in range(10)] + [(300, "ab" * 400), (301, "z" * 500), (302, "z" * 199), (303, "q" * 200)]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_against_all_strings(spark, seed):
    rows = planted(seed)
    assert run(docs_of(spark, rows, extra=True).repartition(6)) == brute(rows)


def test_large_groups_by_digest(spark):
    rows = planted(3)
    assert run(docs_of(spark, rows), group_limit=1) == brute(rows)


def test_common_passage_over_many_tasks(spark):
    rnd = random.Random(9)
    passage = " ".join(str(rnd.randrange(10**6)) for _ in range(60))
    rows = [(i, f"{rnd.random()} {passage} {rnd.random()}") for i in range(400)]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert run(docs_of(spark, rows).repartition(4)) == brute(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_odd_rows(spark, odd, empty):
    assert run(odd) == brute(ODD)
    assert S.removal_digests(empty).count() == 0


def test_multikey_order_is_the_sorted_order():
    rng = np.random.default_rng(0)
    values = [rng.integers(0, 3, rng.integers(0, 30)).astype(np.uint8).tobytes() for _ in range(300)]
    group = rng.integers(0, 4, 300)
    m, size = S._matrix(values, 40)
    order = S.multikey_order(m, size, group)
    pad = lambda v: v + b"\0" * (40 - len(v))
    keys = [(group[k], pad(values[k]), len(values[k])) for k in order]
    assert keys == sorted(keys)


def test_edges_resolve_across_tasks():
    row = lambda p, *v: SimpleNamespace(p=p, s1=v[0], c1=v[1], c1_end=v[2], s2=v[3], c2_start=v[4], c2=v[5])
    # task 0 ends in seed 5 context 1; task 2 is all seed 5 context 1; task 3 goes on with context 2.
    got = S.resolve_edges([row(3, 5, 2, 2, 9, 9, 9), row(0, 1, 1, 1, 5, 1, 1), row(2, 5, 1, 1, 5, 1, 1)])
    assert got == {0: (False, True, False, True), 2: (True, False, True, True), 3: (False, False, True, False)}


def test_sliding_min():
    x = np.random.default_rng(3).integers(0, 1000, 533, dtype=np.uint64)
    assert (S.sliding_min(x, 17) == [x[i:i + 17].min() for i in range(517)]).all()
