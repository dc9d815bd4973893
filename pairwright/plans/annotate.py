"""Annotation and correction of pairs with a model (designs 1-3, correction)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwright.fixed_values import SEED_MULTI, SEED_SINGLE
from pairwright.operators import candidates as C
from pairwright.operators.sampling import sample_n
from pairwright.plans import prompts as P
from pairwright.plans.model_job import with_answers

NL = "nl_sentence"
FOL = "fol_expression"


def annotate_multi(df: DataFrame, n: int, *, backend, store: str, seed: int = SEED_MULTI, design: int = 1,
                   labels=None, out: str = "error_type", id_col: str = "pair_id",
                   sentence: str = NL, formula: str = FOL, **job) -> DataFrame:
    """Designs 1 and 2: a seeded sample of n rows, one call each; the answer is
    a list of labels as raw text."""
    layout = P.layout_catalogue(labels) if design == 1 else P.layout_paired(labels)
    sample = sample_n(df, n, seed=seed, id_col=id_col)
    return with_answers(sample, layout.spec(), [sentence, formula], out, backend=backend, store=store, **job)


def annotate_single(df: DataFrame, category: str, *, backend, store: str, prefilter: bool = True,
                    out: str = "error_type", sentence: str = NL, formula: str = FOL, **job) -> DataFrame:
    """Design 3: one category's prompt for every (candidate) row. Categories
    without a prefilter take every row."""
    rows = C.candidates(df, category, formula, sentence) if prefilter else df
    layout = P.layout_single(C.label_of(category))
    return with_answers(rows, layout.spec(), [sentence, formula], out, backend=backend, store=store, **job)


def annotate_single_sample(df: DataFrame, category: str, n: int, *, backend, store: str,
                           seed: int = SEED_SINGLE, prefilter: bool = True, out: str = "error_type",
                           id_col: str = "pair_id", sentence: str = NL, formula: str = FOL, **job) -> DataFrame:
    """Design 3 on a seeded sample of n (candidate) rows."""
    rows = C.candidates(df, category, formula, sentence) if prefilter else df
    return annotate_single(sample_n(rows, n, seed=seed, id_col=id_col), category, backend=backend,
                           store=store, prefilter=False, out=out, sentence=sentence, formula=formula, **job)


def annotate_categories(df: DataFrame, categories, *, backend, store: str, out: str = "error_type",
                        sentence: str = NL, formula: str = FOL, **job) -> DataFrame:
    """Design 3 for several categories in one model job: each row is paired with
    every listed category it is a candidate for (column ``category``)."""
    labels = [C.label_of(c) for c in categories]
    P.cat.entries(labels)  # raises KeyError for a label outside the catalogue
    # Nulls go after the explode: without a lambda the step is compiled.
    flagged = F.array(*[
        F.when(C.predicate(lab, formula, sentence), F.lit(lab)) if lab in C.LABEL_TO_SHORT else F.lit(lab)
        for lab in labels])
    rows = df.withColumn("category", F.explode(flagged)).where("category is not null")
    return with_answers(rows, P.single_prompt_spec(), ["category", sentence, formula], out,
                        backend=backend, store=store, **job)


def correct_pairs(df: DataFrame, *, backend, store: str, variant: str = "examples",
                  out: str = "fol_corrected", sentence: str = NL, formula: str = FOL, **job) -> DataFrame:
    """One correction call per row, then ``is_equal`` (exact string compare)."""
    layout = P.layout_correction(variant)
    corrected = with_answers(df, layout.spec(), [sentence, formula], out, backend=backend, store=store, **job)
    return corrected.transform(is_equal, formula, out)


def is_equal(df: DataFrame, left: str = FOL, right: str = "fol_corrected", out: str = "is_equal") -> DataFrame:
    """Did the correction keep the formula? Null on either side gives null."""
    return df.withColumn(out, F.col(left) == F.col(right))


def promote_corrected(df: DataFrame, formula: str = FOL, corrected: str = "fol_corrected",
                      flag: str = "is_equal") -> DataFrame:
    """Make the corrected formula the formula, so detection can run again."""
    return df.drop(formula, flag).withColumnRenamed(corrected, formula)
