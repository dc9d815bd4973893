"""Counts kept up to date from the rows that a correction changed.

A changed row takes its old formula's categories off the stored counts and adds
its new formula's. Rows that stayed equal aren't read: the filter on ``is_equal``
reaches the scan of the corrected table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwright.operators.candidates import FOL, NL, category_array


def changed_rows(corrected: DataFrame, flag: str = "is_equal") -> DataFrame:
    """Rows whose formula changed. Null (a formula missing on either side) may be a change."""
    return corrected.where(F.col(flag).isNull() | ~F.col(flag))


def candidate_deltas(corrected: DataFrame, keys=("dataset",), formula: str = FOL, new_formula: str = "fol_corrected", sentence: str = NL) -> DataFrame:
    """(keys, category, n): change of the candidate counts by the corrections, without zeros."""
    rows = changed_rows(corrected)
    signed = F.concat(
        F.transform(category_array(formula, sentence), lambda c: F.struct(c.alias("category"), F.lit(-1).alias("d"))),
        F.transform(category_array(new_formula, sentence), lambda c: F.struct(c.alias("category"), F.lit(1).alias("d"))))
    steps = rows.select(*keys, F.explode(signed).alias("s"))
    return steps.groupBy(*keys, F.col("s.category").alias("category")).agg(F.sum("s.d").alias("n")).where("n <> 0")


def merge_counts(stored: DataFrame, deltas: DataFrame, n: str = "n") -> DataFrame:
    """Stored counts with the deltas added; groups that come to zero go. Both are one row a group."""
    keys = [c for c in stored.columns if c != n]
    both = stored.select(*keys, n).unionByName(deltas.select(*keys, n))
    return both.groupBy(*keys).agg(F.sum(n).cast("bigint").alias(n)).where(F.col(n) != 0)
