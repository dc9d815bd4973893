"""Audit of model answers and the before/after counts behind the charts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwright.plans.catalogue import ANSWER_APPLIES, ANSWER_NOT_APPLIES

VERSION_ORDER = ("original", "corrected")


def audit_applies(df: DataFrame, col: str = "error_type") -> DataFrame:
    """Rows whose answer is exactly the 'applies' sentence."""
    return df.filter(F.col(col) == ANSWER_APPLIES)


def audit_unexpected(df: DataFrame, col: str = "error_type") -> DataFrame:
    """Rows whose answer is neither allowed sentence (exact match; nulls drop)."""
    return df.filter((F.col(col) != ANSWER_APPLIES) & (F.col(col) != ANSWER_NOT_APPLIES))


def applies_counts(annotations: DataFrame, keys=("category", "dataset", "version")) -> DataFrame:
    """Rows per key whose answer applies; combines map-side before the shuffle."""
    return (audit_applies(annotations).groupBy(*keys)
            .agg(F.count(F.lit(1)).alias("n")))


def before_after(counts: DataFrame, versions=VERSION_ORDER) -> DataFrame:
    """One row per category and corpus: counts per version, change and % change."""
    before, after = versions
    wide = (counts.groupBy("category", "dataset")
                  .pivot("version", list(versions))
                  .agg(F.sum("n")))
    wide = wide.fillna(0, subset=list(versions))
    return wide.select(
        "category", "dataset",
        F.col(before).cast("bigint").alias(before),
        F.col(after).cast("bigint").alias(after),
        (F.col(after) - F.col(before)).cast("bigint").alias("delta"),
        F.when(F.col(before) != 0, F.round((F.col(after) - F.col(before)) * 100.0 / F.col(before), 2))
         .alias("pct_change"),
    )


def chart_data(counts: DataFrame, category: str, datasets, versions=VERSION_ORDER) -> DataFrame:
    """Counts of one category, ranked in a fixed corpus and version order."""
    ds = F.array(*[F.lit(d) for d in datasets])
    vs = F.array(*[F.lit(v) for v in versions])
    return (counts.filter(F.col("category") == category)
                  .withColumn("dataset_rank", F.array_position(ds, F.col("dataset")))
                  .withColumn("version_rank", F.array_position(vs, F.col("version")))
                  .orderBy("dataset_rank", "version_rank"))
