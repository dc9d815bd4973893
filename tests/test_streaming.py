"""The stateless chain and model annotation on a stream of pair files."""

import rule_backends as B
from pairwright.session import scratch_path
from pairwright.sources.pairs import read_pairs, write_pairs
from pairwright.streaming.stream import annotate_stream, curate_stream, read_pair_stream, write_stream


def test_stream_equals_batch(spark, pairs):
    src, sink = scratch_path(spark, "src"), scratch_path(spark, "sink")
    write_pairs(pairs, src)
    q = write_stream(curate_stream(read_pair_stream(spark, src)), sink, available_now=True)
    q.awaitTermination(300)
    from pairwright.operators.candidates import candidate_flags
    from pairwright.operators.cleaning import clean_pairs
    batch = candidate_flags(clean_pairs(read_pairs(spark, src)))
    streamed = spark.read.parquet(sink).select(*batch.columns)
    assert streamed.exceptAll(batch).count() == 0 and batch.exceptAll(streamed).count() == 0


def test_stream_annotation(spark, pairs):
    src, sink, store = scratch_path(spark, "src"), scratch_path(spark, "sink"), scratch_path(spark, "store")
    write_pairs(pairs, src)
    q = annotate_stream(read_pair_stream(spark, src), "xor", backend=B.SingleAnswerRule(), store=store,
                        sink=sink, available_now=True)
    q.awaitTermination(300)
    assert spark.read.parquet(sink).count() == 200


def test_stream_restart_processes_only_new_files(spark, pairs):
    from pyspark.sql import functions as F

    from pairwright.plans.model_job import ANSWER_SCHEMA

    src, sink, store = scratch_path(spark, "src"), scratch_path(spark, "sink"), scratch_path(spark, "store")
    ckpt = scratch_path(spark, "ckpt")
    first = pairs.filter(F.col("pair_id") < 10000)
    second = pairs.filter(F.col("pair_id") >= 10000)
    write_pairs(first, src, mode="append")
    annotate_stream(read_pair_stream(spark, src), "wrong_binding", backend=B.SingleAnswerRule(), store=store,
                    sink=sink, checkpoint=ckpt, available_now=True).awaitTermination(300)
    n1 = spark.read.parquet(sink).count()
    calls1 = spark.read.schema(ANSWER_SCHEMA).parquet(store).count()
    # restart from the same checkpoint after new files arrive
    write_pairs(second, src, mode="append")
    annotate_stream(read_pair_stream(spark, src), "wrong_binding", backend=B.SingleAnswerRule(), store=store,
                    sink=sink, checkpoint=ckpt, available_now=True).awaitTermination(300)
    out = spark.read.parquet(sink)
    from pairwright.operators.candidates import candidates
    assert n1 == candidates(first, "wrong_binding").count()
    assert out.count() == candidates(pairs, "wrong_binding").count()
    assert out.select("pair_id").distinct().count() == out.count()
    calls2 = spark.read.schema(ANSWER_SCHEMA).parquet(store).count()
    assert calls2 >= calls1
