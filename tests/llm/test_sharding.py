import zlib

import pytest

from pairwright.llm.sharding import shard_by_bytes
from llm_fixtures import ODD, docs_of, empty, odd  # noqa: F401


def test_law_on_odd_rows(spark, odd):
    rows = shard_by_bytes(odd, n_shards=4).collect()
    assert len(rows) == len(ODD)
    want = sorted((len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for _, t in ODD)
    assert sorted((r["size"], r.text_crc32) for r in rows) == want
    for s in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    assert all(r.law == "bytes" and r.grown_shard is None for r in rows)


@pytest.mark.parametrize("copies", [1, 400])
def test_bytes_near_equal_and_groups_together(spark, copies):
    rows = [(i, f"text number {i} " * (i % 7 + 1)) for i in range(900)] + [(9000 + i, "same text " * 5) for i in range(copies)]
    out = shard_by_bytes(docs_of(spark, rows).repartition(7), n_shards=10).collect()
    size = [sum(r["size"] for r in out if r.shard == s) for s in range(10)]
    assert max(size) - min(size) < 0.08 * sum(size) / 10
    shards_of = {}
    text = dict(rows)
    for r in out:
        shards_of.setdefault(text[r.doc_id], set()).add(r.shard)
    # Only the group larger than the tolerance may lie in several shards.
    assert all(len(v) == 1 or k.startswith("same") for k, v in shards_of.items())
    for s in range(10):
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sum(r.shard == s for r in out)))


def test_partitioning_does_not_matter(spark):
    rows = [(i, "w" * (i * 37 % 101)) for i in range(300)]
    a = shard_by_bytes(docs_of(spark, rows).repartition(1), n_shards=6)
    b = shard_by_bytes(docs_of(spark, rows).repartition(9), n_shards=6)
    assert sorted(map(tuple, a.collect()), key=str) == sorted(map(tuple, b.collect()), key=str)


def test_empty(spark, empty):
    assert shard_by_bytes(empty).count() == 0
