"""A key holding a third of all rows: results stay whole and exact."""

import rule_backends as B
import pytest
from pyspark.sql import functions as F

from pairwright.operators import candidates as C
from pairwright.operators.diagnostics import adverb_counts
from pairwright.plans import annotate as AN
from pairwright.plans.model_job import ANSWER_SCHEMA


@pytest.fixture(scope="module")
def skewed(spark):
    """3000 pairs; every third row is the same hot pair."""
    hot_s, hot_f = "Every dog often barks, loudly.", "∀x (Dog(x) → Barks(x, y))"
    return spark.range(0, 3000).select(
        F.col("id").alias("pair_id"),
        F.when(F.col("id") % 3 == 0, F.lit(hot_s)).otherwise(F.concat(F.lit("Item "), F.col("id").cast("string"), F.lit(", a."))).alias("nl_sentence"),
        F.when(F.col("id") % 3 == 0, F.lit(hot_f)).otherwise(F.concat(F.lit("P(c"), F.col("id").cast("string"), F.lit(", dd)"))).alias("fol_expression"),
    ).repartition(6)


def test_hot_request_called_once(spark, skewed, tmp_dir):
    out = AN.annotate_single(skewed, "wrong_binding", backend=B.SingleAnswerRule(), store=tmp_dir)
    assert out.count() == 3000
    store = spark.read.schema(ANSWER_SCHEMA).parquet(tmp_dir)
    assert store.count() == 2001  # 2000 distinct cold pairs + 1 hot pair
    hot = out.filter(F.col("pair_id") % 3 == 0).select("error_type").distinct().collect()
    assert len(hot) == 1 and hot[0].error_type is not None


def test_hot_category_counts_exact(skewed):
    df = skewed.withColumns({"dataset": F.lit("d"), "version": F.lit("v")})
    got = {r.category: r.n for r in C.candidate_counts(df).collect()}
    assert got["wrong_variable_binding"] == 3000
    assert got["free_variable_error"] == 1000
    assert got["missing_condition_negation"] == 1000


def test_hot_adverb_counts_exact(skewed):
    got = {(r.adverb_group, r.word): r.n_rows for r in adverb_counts(skewed).collect()}
    assert got == {("frequency", "often"): 1000, ("frequency", None): 1000}


def test_dedupe_is_hash_aggregate(spark, skewed):
    from pairwright.plans import prompts as PR
    from pairwright.plans.model_job import request_key

    req = skewed.select(request_key("m", PR.layout_single("wrong_variable_binding").digest, F.col("nl_sentence"), F.col("fol_expression")).alias("key"),
                        "nl_sentence", "fol_expression").distinct()
    plan = req._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("HashAggregate") == 2 and "SortAggregate" not in plan


def test_hot_key_is_split_in_the_answer_join(spark, skewed, tmp_dir):
    """On the sort-merge path the partition of the hot pair is read in several parts."""
    from pairwright.plans import model_job as M
    from pairwright.plans import prompts as PR

    spec = PR.layout_single("wrong_variable_binding").spec()
    long = skewed.withColumn("pad", F.concat(*(F.md5(F.concat(F.col("pair_id").cast("string"), F.lit(str(k)))) for k in range(40))))
    keyed = M.keyed_rows(long, spec, ["nl_sentence", "fol_expression"], "rule-single")
    answers = M.call_model(M.requests_of(keyed), spec, backend=B.SingleAnswerRule(), store=tmp_dir)
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5"}
    old = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        out = M.join_answers(keyed, answers, "error_type")
        assert len(out.collect()) == 3000
        assert "skew=true" in out._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
