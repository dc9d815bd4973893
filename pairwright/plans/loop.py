"""The full curation loop: correct, detect again, count before and after.

pairs ──correct──> corrected table (original formula + corrected formula)
                        ├── original version  (fol_expression)
                        └── corrected version (fol_corrected, promoted; changed rows only)
                              └── detect (one model job over both)
                                      └──> applies per category × corpus × version
Before and after are one query: ``version`` is a column, not a second run.
Both versions are read from the stored corrected table, so the input corpus
is not computed again for the detection. ``detect_versions`` annotates both
versions whole and stores the annotations.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwright.operators.audit import applies_counts, before_after
from pairwright.operators.deltas import changed_rows
from pairwright.plans.annotate import annotate_categories, correct_pairs, promote_corrected
from pairwright.sources import tables

# Categories whose prefilter plus single-category prompt worked in the study.
WORKING_CATEGORIES = (
    "overgeneralization",
    "wrong_variable_binding",
    "invalid_xor_usage",
    "wrong_negation_scope",
    "neither_nor_translation_error",
)


def correct_and_store(pairs: DataFrame, *, corrector, workdir: str, variant: str = "examples") -> DataFrame:
    """Correct every pair (keeps ``dataset``), store the table, return it read back."""
    corrected = correct_pairs(pairs, backend=corrector, store=f"{workdir}/answers-correction", variant=variant)
    tables.write_corrected(corrected, f"{workdir}/corrected")
    return tables.read_corrected(pairs.sparkSession, f"{workdir}/corrected")


def detect_versions(corrected: DataFrame, *, detector, workdir: str,
                    categories=WORKING_CATEGORIES) -> DataFrame:
    """Annotate the original and the corrected formulas of a corrected table in
    one model job; store the annotations and read them back."""
    cols = ["pair_id", "nl_sentence", "fol_expression", "dataset"]
    original = corrected.select(*cols).withColumn("version", F.lit("original"))
    promoted = promote_corrected(corrected).select(*cols).withColumn("version", F.lit("corrected"))
    both = original.unionByName(promoted)
    annotated = annotate_categories(both, categories, backend=detector, store=f"{workdir}/answers-detection")
    tables.write_annotations(annotated, f"{workdir}/annotations")
    return tables.read_annotations(corrected.sparkSession, f"{workdir}/annotations")


def count_versions(corrected: DataFrame, *, detector, workdir: str, categories=WORKING_CATEGORIES) -> DataFrame:
    """Counts of 'applies' answers of both versions, with a second detection of the changed rows only.

    After = before, less the changed rows' answers before, plus those after.
    """
    cols = ["pair_id", "nl_sentence", "fol_expression", "dataset"]
    changed = F.coalesce(~F.col("is_equal"), F.lit(True))
    before = corrected.select(*cols, F.lit("original").alias("version"), changed.alias("changed"))
    after = promote_corrected(changed_rows(corrected).drop("changed")).select(*cols, F.lit("corrected").alias("version"), F.lit(True).alias("changed"))
    annotated = annotate_categories(before.unionByName(after).select("nl_sentence", "fol_expression", "dataset", "version", "changed"),
                                    categories, backend=detector, store=f"{workdir}/answers-detection")
    steps = applies_counts(annotated, ("category", "dataset", "version", "changed")).withColumn("stays", ~F.col("changed"))
    # An answer before counts before, and after as well unless its row changed.
    versions = F.when(F.col("version") == "corrected", F.array(F.lit("corrected"))).when(F.col("stays"), F.array(F.lit("original"), F.lit("corrected"))).otherwise(F.array(F.lit("original")))
    return (steps.select("category", "dataset", F.explode(versions).alias("version"), "n")
            .groupBy("category", "dataset", "version").agg(F.sum("n").alias("n")))


def run_loop(pairs: DataFrame, *, detector, corrector, workdir: str,
             categories=WORKING_CATEGORIES) -> DataFrame:
    """Counts of 'applies' answers per category, corpus and version."""
    corrected = correct_and_store(pairs, corrector=corrector, workdir=workdir)
    return count_versions(corrected, detector=detector, workdir=workdir, categories=categories)


def before_after_counts(pairs: DataFrame, *, detector, corrector, workdir: str,
                        categories=WORKING_CATEGORIES) -> DataFrame:
    return before_after(run_loop(pairs, detector=detector, corrector=corrector,
                                 workdir=workdir, categories=categories))
