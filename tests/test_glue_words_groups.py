"""Glue by position, word lists as tables, samples by group."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from conftest import plan_text
from pairwright.functions.text import ALL_ADVERBS
from pairwright.operators import wordlists as W
from pairwright.operators.cleaning import remove_adverb_sentences
from pairwright.operators.glue import glue, numbered
from pairwright.operators.sampling import sample_per_group


def stored(df, path, parts, rows_a_file):
    df.repartitionByRange(parts, "k").sortWithinPartitions("k").write.option("maxRecordsPerFile", rows_a_file).parquet(path)
    return path


def test_glue_of_unequal_files(spark, tmp_dir):
    rows = spark.range(10_000).select(F.col("id").alias("k"))
    left = stored(rows, f"{tmp_dir}/a", 3, 777)
    values = rows.select((F.col("k") * 3).alias("v"), "k").repartitionByRange(4, "k").sortWithinPartitions("k").select("v")
    values.write.option("maxRecordsPerFile", 1234).parquet(f"{tmp_dir}/v")
    for range_rows in (10, 4096, 10**6):
        got = glue(spark, left, f"{tmp_dir}/v", position="p", range_rows=range_rows)
        assert got.columns == ["p", "k", "v"]
        assert got.where("v <> 3 * k OR p <> k").count() == 0 and got.count() == 10_000
    plan = plan_text(glue(spark, left, f"{tmp_dir}/v"))
    assert plan.count("RepartitionByExpression") + plan.count("REPARTITION_BY_COL") <= 2 and "rangepartitioning" not in plan


def test_glue_checks_lengths_and_names(spark, tmp_dir):
    spark.range(5).write.parquet(f"{tmp_dir}/a")
    spark.range(3).select((F.col("id") + 10).alias("v")).coalesce(1).write.parquet(f"{tmp_dir}/b")
    spark.range(0).select(F.col("id").alias("w")).write.parquet(f"{tmp_dir}/e")
    with pytest.raises(ValueError):
        glue(spark, f"{tmp_dir}/a", f"{tmp_dir}/b")
    with pytest.raises(ValueError):
        glue(spark, f"{tmp_dir}/a", f"{tmp_dir}/a")
    loose = glue(spark, f"{tmp_dir}/a", f"{tmp_dir}/b", strict=False, position="p").orderBy("p").collect()
    assert [r.v for r in loose] == [10, 11, 12, None, None] and sorted(r.id for r in loose) == [0, 1, 2, 3, 4]
    assert glue(spark, f"{tmp_dir}/a", f"{tmp_dir}/e", strict=False).count() == 5
    assert sorted(r.position for r in numbered(spark, f"{tmp_dir}/a", start=1).collect()) == [1, 2, 3, 4, 5]


def hits(text, entries):
    tokens = text.lower().split()
    grams = {" ".join(tokens[i:j]) for i in range(len(tokens)) for j in range(i + 1, min(i + 5, len(tokens)) + 1)}
    return sorted(grams & {" ".join(e.lower().split()) for e in entries if e and e.strip()})


@pytest.mark.parametrize("trie_bytes", [1 << 20, 0])
def test_word_hits(spark, trie_bytes):
    rnd = random.Random(4)
    vocab = ["a", "b", "c.", "Now", "é", "d"]
    texts = [None, "", "  "] + [rnd.choice([" ", "  ", "\t", " "]).join(rnd.choice(vocab) for _ in range(rnd.randrange(1, 9))) for _ in range(300)]
    entries = ["a b", "NOW", "now", "b  c.", "a a a", None, " ", "é d a b", "c", "zzz"]
    words = spark.createDataFrame([(e,) for e in entries], "entry string")
    df = spark.createDataFrame(list(enumerate(texts)), "pair_id int, nl_sentence string").selectExpr("*", "1 AS gram", "2 AS size")
    got = {r.pair_id: r.hits for r in W.word_hits(df, words, trie_bytes=trie_bytes).collect()}
    assert got == {k: None if t is None else hits(t, entries) for k, t in enumerate(texts)}
    assert {r.pair_id for r in W.word_matches(df, words, trie_bytes=trie_bytes).collect()} == {k for k, h in got.items() if h}
    assert {r.pair_id for r in W.remove_word_matches(df, words, trie_bytes=trie_bytes).collect()} == {k for k, h in got.items() if h == []}
    empty = words.where("false")
    assert W.remove_word_matches(df, empty, trie_bytes=trie_bytes).count() == len(texts) - 1


@pytest.mark.parametrize("trie_bytes", [1 << 20, 0])
def test_the_adverb_lists_as_a_table(spark, pairs, trie_bytes):
    words = spark.createDataFrame([(w,) for w in ALL_ADVERBS], "entry string")
    got = W.remove_word_matches(pairs, words, trie_bytes=trie_bytes)
    assert sorted(r.pair_id for r in got.collect()) == sorted(r.pair_id for r in remove_adverb_sentences(pairs).collect())


def test_a_list_of_a_million_entries(spark):
    """Too large to send: joined, with no entry in the plan and a word in every row dealt out."""
    words = spark.range(1_000_000).select(F.concat_ws(" ", F.lit("w"), F.col("id").cast("string")).alias("entry")).unionByName(spark.createDataFrame([("the",)], "entry string"))
    df = spark.range(3000).select(F.col("id").alias("pair_id"), F.concat(F.lit("The W "), (F.col("id") * 1000).cast("string")).alias("nl_sentence"))
    got = W.word_hits(df, words)
    rows = {r.pair_id: r.hits for r in got.collect()}
    assert rows == {i: ["the", f"w {i * 1000}"] if i < 1000 else ["the"] for i in range(3000)}
    assert not re.search(r"\bw \d+\b", plan_text(got))


@pytest.mark.parametrize("n", [0, 1, 7, 200, 1001, 5000])
def test_sample_per_group(spark, n):
    rows = spark.range(4000).selectExpr("if(id % 50 = 0, null, id div 2) AS pair_id", "if(id % 3 = 0, 'hot', concat('g', id % 11)) AS g", "id % 2 AS h")
    def want(r):
        return hashlib.md5(f"{'' if r.pair_id is None else r.pair_id}#3".encode()).hexdigest()
    groups = {}
    for r in rows.collect():
        groups.setdefault((r.g, r.h), []).append(want(r))
    for parts in (1, 6):
        got = {}
        for r in sample_per_group(rows.repartition(parts), n, ["g", "h"], seed=3).collect():
            got.setdefault((r.g, r.h), []).append(want(r))
        assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v)[:n] for k, v in groups.items() if n}


def test_a_group_sends_few_rows(spark):
    rows = spark.range(1000).selectExpr("id AS pair_id", "id % 2 AS g")
    assert "WindowGroupLimit" in sample_per_group(rows, 5, ["g"])._jdf.queryExecution().executedPlan().toString()
