"""Samples by group sort few rows, however many a group has."""

from pyspark.sql import functions as F

from pairwright.operators import sampling


def test_group_sample_drops_rows_before_it_sorts(spark):
    rows = spark.range(40_000).select(F.col("id").alias("pair_id"), F.when(F.col("id") % 4 > 0, "big").alias("g"), F.repeat(F.lit("x"), 50).alias("text"))
    keyed = rows.withColumns({"_rank": sampling.sample_rank(), "_t": sampling._row_hash(rows.columns)})
    left = {r.g: r["count"] for r in sampling._below_cutoff(keyed, ["g"], 1200).groupBy("g").count().collect()}
    assert set(left) == {"big", None} and all(1200 <= n < 1300 for n in left.values())
    plan = sampling.sample_per_group(rows, 1200, ["g"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Sort [") < plan.index("Join Inner")
    got = sampling.sample_per_group(rows, 1200, ["g"]).collect()
    want = [r.pair_id for g in ("big", None) for r in rows.where(F.col("g").eqNullSafe(F.lit(g))).orderBy(sampling.sample_rank(), "pair_id").limit(1200).collect()]
    assert sorted(r.pair_id for r in got) == sorted(want)


def test_group_sample_of_equal_ids_and_small_groups(spark):
    rows = spark.createDataFrame([(None if i % 2 else 7, i % 5, i) for i in range(1000)], "pair_id long, g int, v int")
    got = sampling.sample_per_group(rows, 150, ["g"]).groupBy("g").count().collect()
    assert {r.g: r["count"] for r in got} == {g: 150 for g in range(5)}
    assert sampling.sample_per_group(rows, 5000, ["g"]).count() == 1000 and sampling.sample_per_group(rows, 0, ["g"]).count() == 0
