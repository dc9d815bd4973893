"""Small splits of files without line ends: few tasks, one cut."""

from pyspark.sql import functions as F

from pairwright.sources import splits


def test_small_splits_share_tasks_and_are_cut_once(spark, tmp_dir):
    rows = [{"pair_id": i, "NL": 'a "}],[{ \\ ' + "z" * (i % 90), "FOL": f"P({i})"} for i in range(3000)]
    record = F.to_json(F.collect_list(F.struct("pair_id", "NL", "FOL"))).alias("value")
    spark.createDataFrame(rows).repartition(1).agg(record).write.text(tmp_dir)
    pieces = splits._pieces(spark, tmp_dir, splits.JsonArray, 1024)
    assert pieces.select("file", "block").distinct().count() > 100
    assert pieces.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism
    found = splits.read_json_array_pairs(spark, tmp_dir, split_bytes=1024)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 0
    assert sorted((r.pair_id, r.nl_sentence, r.fol_expression) for r in found.collect()) == [(r["pair_id"], r["NL"], r["FOL"]) for r in rows]
