"""Exact seeded samples and dense row numbers."""

import hashlib

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from pairwright.operators.indexing import row_index
from pairwright.operators.sampling import sample_n


def _ids(df):
    return sorted(r.pair_id for r in df.select("pair_id").collect())


def test_sample_exact_and_stable(pairs):
    a = _ids(sample_n(pairs, 57, seed=3))
    assert len(a) == 57 and len(set(a)) == 57
    assert a == _ids(sample_n(pairs.repartition(7), 57, seed=3))
    assert a != _ids(sample_n(pairs, 57, seed=42))


def test_sample_by_any_band_equals_the_sorted_head(pairs):
    order = sorted((hashlib.md5(f"{r.pair_id}#5".encode()).hexdigest(), r.pair_id) for r in pairs.select("pair_id").collect())
    for n in (1, 300, 2799):
        want = sorted(i for _, i in order[:n])
        assert _ids(sample_n(pairs, n, seed=5)) == want
        assert _ids(sample_n(pairs, n, seed=5, band_rows=1)) == want


def test_sample_with_null_and_repeated_ids(spark):
    rows = spark.range(1000).selectExpr("if(id % 10 = 0, null, id div 2) AS pair_id", "id % 7 AS v")
    for n in (0, 3, 300, 950, 999):
        a = sorted(map(str, sample_n(rows, n).collect()))
        assert len(a) == n
        assert a == sorted(map(str, sample_n(rows.repartition(7), n, band_rows=1).collect()))
    same = spark.range(500).selectExpr("cast(null AS bigint) AS pair_id", "1 AS v")
    assert [sample_n(same, n, band_rows=10).count() for n in (3, 250, 499)] == [3, 250, 499]



def test_sample_more_than_rows(pairs):
    assert sample_n(pairs, 10_000).count() == pairs.count()
    assert sample_n(pairs, 10_000, band_rows=1).count() == pairs.count()
    with pytest.raises(ValueError):
        sample_n(pairs, 10_000, strict=True)


def test_row_index_dense(pairs):
    ri = row_index(pairs.repartition(5))
    stats = ri.agg(F.min("row"), F.max("row"), F.count_distinct("row"), F.count("*")).first()
    assert tuple(stats) == (1, 2800, 2800, 2800)
    check = ri.withColumn("rn", F.row_number().over(Window.orderBy("pair_id")))
    assert check.filter("rn != row").count() == 0


def test_row_index_repeated_keys(spark):
    df = spark.range(0, 3000).select((F.col("id") % 3).alias("pair_id"), F.col("id").alias("v"))
    ri = row_index(df, num_partitions=6)
    stats = ri.agg(F.min("row"), F.max("row"), F.count_distinct("row")).first()
    assert tuple(stats) == (1, 3000, 3000)
    # rows of a smaller key always come first
    bad = ri.groupBy("pair_id").agg(F.min("row").alias("lo"), F.max("row").alias("hi")).orderBy("pair_id").collect()
    assert bad[0].hi < bad[1].lo and bad[1].hi < bad[2].lo


def test_row_index_sizes_itself_and_cleans_up(spark, pairs):
    ri = row_index(pairs.withColumn("pad", F.repeat(F.lit("x"), 50)))
    plan = ri._jdf.queryExecution().optimizedPlan().toString()
    assert ri.count() == 2800 and "RepartitionByExpression" not in plan  # numbered from the checkpoint
    assert spark.conf.get("spark.cleaner.referenceTracking.cleanCheckpoints") == "true"
