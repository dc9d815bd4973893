"""Operators on an empty input return empty results, not errors."""

import pytest
from pyspark.sql import functions as F

from pairwright.operators import candidates as C
from pairwright.operators import cleaning, diagnostics
from pairwright.operators.audit import applies_counts, before_after
from pairwright.operators.indexing import row_index
from pairwright.operators.sampling import sample_n
from pairwright.plans import annotate as AN
import rule_backends as B
from pairwright.plans import prompts as PR


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "pair_id bigint, nl_sentence string, fol_expression string")


def test_narrow_operators(empty):
    assert cleaning.clean_pairs(empty).count() == 0
    assert diagnostics.lowercase_diff(empty).count() == 0
    assert diagnostics.adverb_counts(empty).count() == 0
    assert C.candidate_counts(empty.withColumns({"dataset": F.lit("d"), "version": F.lit("v")})).count() == 0


def test_sample_and_index(empty):
    assert sample_n(empty, 5).count() == 0
    assert sample_n(empty, 5, band_rows=1).count() == 0
    assert row_index(empty).count() == 0


def test_model_job_and_counts(spark, empty, tmp_dir):
    out = AN.annotate_single(empty, "xor", backend=B.SingleAnswerRule(), store=tmp_dir)
    assert out.count() == 0 and "error_type" in out.columns
    corrected = AN.correct_pairs(empty, backend=B.CorrectorRule(PR.layout_correction()), store=tmp_dir + "-c")
    assert corrected.count() == 0
    ann = out.withColumns({"dataset": F.lit("d"), "version": F.lit("original"), "category": F.lit("x")})
    assert before_after(applies_counts(ann)).count() == 0
