"""Candidate predicates, flags and counts."""

from pyspark.sql import functions as F

from conftest import plan_text
from pairwright.operators import candidates as C
from pairwright.sources.pairs import read_pairs, write_pairs

# Rows per template at sf0.001 is 200; templates hit per category (FIXTURES).
EXPECTED = {
    "overgeneralization": 1, "wrong_binding": 5, "free_variable": 9, "biconditional": 1,
    "conjunction": 7, "xor": 1, "global_negation": 2, "condition_negation": 6,
    "both_negated": 2, "neither_nor": 2,
}


def test_each_filter_count(pairs):
    for short, templates in EXPECTED.items():
        assert C.candidates(pairs, short).count() == 200 * templates, short


def test_flags_agree_with_filters(pairs):
    flagged = C.candidate_flags(pairs)
    for short, (label, _) in C.PREDICATES.items():
        via_flags = flagged.filter(F.array_contains("categories", label)).select("pair_id")
        via_filter = C.candidates(pairs, short).select("pair_id")
        assert via_flags.exceptAll(via_filter).count() == 0
        assert via_filter.exceptAll(via_flags).count() == 0


def test_counts_one_scan(spark, pairs, tmp_dir):
    write_pairs(pairs, tmp_dir)
    df = read_pairs(spark, tmp_dir).withColumns({"dataset": F.lit("d"), "version": F.lit("v")})
    counts = C.candidate_counts(df)
    got = {r.category: r.n for r in counts.collect()}
    assert got["overgeneralization"] == 200 and got["wrong_variable_binding"] == 1000
    assert plan_text(counts).count("FileScan") == 1


def test_contains_pushed_to_parquet(spark, pairs, tmp_dir):
    write_pairs(pairs, tmp_dir)
    df = C.candidates(read_pairs(spark, tmp_dir), "biconditional")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "StringContains(fol_expression,↔)" in plan


def test_missing_category_has_no_prefilter(pairs):
    assert C.candidates(pairs, "missing_category").count() == pairs.count()


def test_candidates_are_subsets(pairs):
    for short in C.PREDICATES:
        extra = C.candidates(pairs, short).exceptAll(pairs)
        assert extra.count() == 0, short
