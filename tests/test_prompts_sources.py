"""Prompt texts, catalogue rendering, sources and sinks."""

import json
import os

from pyspark.sql import functions as F

from pairwright.plans import catalogue as cat
from pairwright.plans import prompts as PR
from pairwright.session import local_fs_path
from pairwright.sources import tables
from pairwright.sources.pairs import read_json_pairs, read_pairs, write_pairs


def test_catalogue_text_spark_equals_python(spark):
    text = PR.catalogue_text(cat.catalogue_df(spark)).first().text
    assert text == PR.format_categories_text()
    assert text.count("Error label:") == 13


def test_explanation_line_only_when_present(spark):
    entry = dict(cat.CATALOGUE[0])
    entry["negative"] = entry["negative"][:2]
    assert "Explanation" not in PR.category_block(entry)
    assert "Explanation" in PR.category_block(cat.CATALOGUE[0])


def test_layout_split_round_trip(spark):
    for layout in (PR.layout_catalogue(), PR.layout_paired(), PR.layout_single("xor" and "invalid_xor_usage"),
                   PR.layout_correction("examples_explained")):
        df = spark.createDataFrame([("A b, c.", "∀x P(x)")], "nl_sentence string, fol_expression string")
        prompt = df.select(layout.render().alias("p")).first().p
        assert layout.split(prompt) == ("A b, c.", "∀x P(x)")
        back = spark.createDataFrame([(prompt,)], "p string").select(*layout.parts("p")).first()
        assert tuple(back) == ("A b, c.", "∀x P(x)")


def test_correction_example_number_follows_list():
    layout = PR.layout_correction()
    n = len(PR.correction_examples(False))
    assert layout.prefix.endswith(f"Example {n + 1}:\nSentence: ")


def test_null_part_gives_null_prompt(spark):
    df = spark.createDataFrame([(None, "f")], "nl_sentence string, fol_expression string")
    assert df.select(PR.layout_paired().render().alias("p")).first().p is None


def test_json_array_file_by_name(spark, tmp_dir):
    path = local_fs_path(tmp_dir)
    os.makedirs(path)
    with open(os.path.join(path, "corpus.json"), "w", encoding="utf-8") as fh:
        json.dump([{"NL": "All cats sleep.", "FOL": "∀x (Cat(x) → Sleeps(x))"},
                   {"FOL": "P(a)", "NL": "a is P"}], fh, ensure_ascii=False)
    rows = read_json_pairs(spark, tmp_dir, array_file=True, id_col=None).collect()
    assert sorted((r.nl_sentence, r.fol_expression) for r in rows) == [
        ("All cats sleep.", "∀x (Cat(x) → Sleeps(x))"), ("a is P", "P(a)")]


def test_csv_round_trip_quotes_and_newlines(spark, tmp_dir):
    rows = [(1, 'He said "no",\nthen left.', "Said(he, 'no')"), (2, None, ""), (3, "  edges  ", "\\N"), (4, "a\\nb\\\\\r\n", "\\"),
            (5, "", "\t"), (6, '"', '""'), (7, "#x", "a,b")]
    df = spark.createDataFrame(rows, "pair_id bigint, nl_sentence string, fol_expression string")
    write_pairs(df, tmp_dir, fmt="csv")
    assert sorted(map(tuple, read_pairs(spark, tmp_dir, fmt="csv").collect())) == rows
    # Files split between tasks at any line.
    assert "multiLine" not in str(read_pairs(spark, tmp_dir, fmt="csv")._jdf.queryExecution().logical())


def test_annotation_partitions_dynamic_overwrite(spark, pairs, tmp_dir):
    # the writer asks for dynamic overwrite itself, whatever the session default
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "static")
    base = pairs.limit(10).withColumns({"error_type": F.lit("x"), "dataset": F.lit("d"), "version": F.lit("original")})
    tables.write_annotations(base.withColumn("category", F.lit("a")), tmp_dir)
    tables.write_annotations(base.withColumn("category", F.lit("b")), tmp_dir)
    tables.write_annotations(base.withColumn("category", F.lit("b")).withColumn("error_type", F.lit("y")), tmp_dir)
    assert tables.read_annotations(spark, tmp_dir).count() == 20
    only_b = tables.read_annotations(spark, tmp_dir, dataset="d", version="original", category="b")
    assert {r.error_type for r in only_b.collect()} == {"y"}
    # partition pruning: the choice is a partition filter of the scan
    explained = spark.sparkContext._jvm.PythonSQLUtils.explainString(only_b._jdf.queryExecution(), "formatted")
    assert "PartitionFilters: [isnotnull(dataset" in explained and "(category#" in explained
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")


def test_hand_filled_counts_with_own_names(spark, tmp_dir):
    path = local_fs_path(tmp_dir)
    os.makedirs(path)
    with open(os.path.join(path, "counts.csv"), "w", encoding="utf-8") as fh:
        fh.write("Kategorie,Datensatz,Version,Anzahl\nXOR,A,original,78\nXOR,A,corrected,9\n")
    df = tables.read_counts(spark, tmp_dir, fmt="csv",
                            names={"Kategorie": "category", "Datensatz": "dataset",
                                   "Version": "version", "Anzahl": "n"})
    assert df.columns == ["category", "dataset", "version", "n"]
    assert sorted((r.version, r.n) for r in df.collect()) == [("corrected", 9), ("original", 78)]


def test_chat_backend_request_shape(monkeypatch):
    """The HTTP client builds a chat request; the transport is replaced in-process."""
    import io
    import urllib.request

    from pairwright.plans.backends import ChatCompletionsBackend

    seen = {}

    class Reply(io.BytesIO):
        def __enter__(self):
            return self

        def __exit__(self, *exc):
            return False

    def fake_urlopen(req, timeout=None):
        seen["url"], seen["body"] = req.full_url, json.loads(req.data.decode("utf-8"))
        seen["auth"] = req.headers.get("Authorization")
        return Reply(json.dumps({"choices": [{"message": {"content": "  ok  "}}]}).encode("utf-8"))

    monkeypatch.setattr(urllib.request, "urlopen", fake_urlopen)
    client = ChatCompletionsBackend("http://model.invalid/v1/chat/completions", "m1", api_key="k")
    assert client.complete("sys", ["p1"]) == ["  ok  "] and client.timeout == 120.0
    assert seen["body"]["temperature"] == 0.0 and seen["body"]["model"] == "m1"
    assert [m["role"] for m in seen["body"]["messages"]] == ["system", "user"]
    assert seen["auth"] == "Bearer k"

    def broken(req, timeout=None):
        if b"p2" in req.data:
            raise OSError("refused")
        return fake_urlopen(req, timeout)

    monkeypatch.setattr(urllib.request, "urlopen", broken)
    monkeypatch.setenv("MODEL_KEY", "from-env")
    client = ChatCompletionsBackend("http://model.invalid/v1/chat/completions", "m1", api_key_env="MODEL_KEY")
    good, bad = client.complete("sys", ["p1", "p2"])
    assert good == "  ok  " and isinstance(bad, OSError) and seen["auth"] == "Bearer from-env"


def test_labels_named_in_system_texts_are_in_catalogue():
    import re

    known = {c["label"] for c in cat.CATALOGUE} | {cat.NO_LABEL}
    for text in (PR.SYSTEM_MULTI, PR.SYSTEM_SINGLE, PR.SYSTEM_CORRECTION, PR.SYSTEM_CORRECTION_STRICT):
        for quoted in re.findall(r'\["([a-z_]+)"\]', text):
            assert quoted in known, quoted


def test_example_answers_have_no_full_stop():
    for c in cat.CATALOGUE:
        text = PR.single_category_text(c["label"])
        assert f"Answer: {cat.ANSWER_APPLIES}\n" in text and f"Answer: {cat.ANSWER_NOT_APPLIES}\n" in text
        assert f"{cat.ANSWER_APPLIES}." not in text


def test_block_column_without_explanation_equals_python(spark):
    from pyspark.sql import functions as F

    entry = dict(cat.CATALOGUE[3])
    entry["negative"] = entry["negative"][:2]
    rows = [(0, entry["label"], entry["description"], entry["instruction"],
             {"sentence": entry["positive"][0], "formula": entry["positive"][1]},
             {"sentence": entry["negative"][0], "formula": entry["negative"][1], "explanation": None})]
    df = spark.createDataFrame(rows, cat.CATALOGUE_SCHEMA)
    got = df.select(PR.category_block_column(F.struct(*df.columns)).alias("b")).first().b
    assert got == PR.category_block(entry)
    assert PR.catalogue_text(df).first().text == PR.category_block(entry)
