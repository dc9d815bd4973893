import random

import public_tokenizers as P
import tiktoken

import corpus_pipeline as C
from pairwright.llm import bpe
from pairwright.session import scratch_path
from llm_fixtures import ODD, docs_of  # noqa: F401

ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"


def folder(spark, rows, items):
    path = scratch_path(spark, "tables")
    docs_of(spark, rows, extra=True).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_decisions_take_effect(spark):
    rnd = random.Random(0)
    prose = lambda n: " ".join(rnd.choice(["the", "thing", "other", "there", "often", "inter"]) + rnd.choice(["ing", "er", ""]) for _ in range(n))
    rows = [(i, prose(60)) for i in range(60)]
    rows += [(100, rows[0][1]), (101, rows[1][1] + " tail"), (102, f"{prose(30)} {ITEM} {prose(20)}"), (103, prose(40) + " password=hunter2hunter2 there"),
             (104, "12345 67890"), (105, None), (106, "")]
    path = folder(spark, rows, [(1, ITEM)])
    out = {r.doc_id: r for r in C.run(spark, path).collect()}
    assert set(out) == set(range(60)) | {103}
    ranks = bpe.load_ranks(P.path("byte_bpe_50k.tiktoken"))
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for i, text in rows[:60]:
        assert out[i].ids == enc.encode_ordinary(text)
    assert enc.decode(out[103].ids).endswith(" [SECRET] there")


def test_stages_take_odd_rows_and_keep_columns(spark):
    path = folder(spark, ODD, [(1, ITEM), (2, None)])
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for name, stage in C.STAGES[:-1]:
        out = stage(spark, docs, path)
        assert out.columns == docs.columns, name
        out.count()
        assert stage(spark, docs.where("false"), path).count() == 0
    assert C.STAGES[-1][1](spark, docs, path).count() == len(ODD)


def test_repeated_rows_leave_one(spark):
    rows = [(5, "one two three four five six"), (5, "one two three four five six"), (6, "one two three four five six"), (None, "x y z")]
    out = C.drop_near_duplicates(spark, docs_of(spark, rows), "")
    assert sorted((r.doc_id for r in out.collect()), key=str) == [5, None]
