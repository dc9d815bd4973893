"""Stored tables of the curation loop and their readers/writers.

``annotations``  pair + category + error_type, partitioned by dataset, version, category
``corrected``    pair + fol_corrected + is_equal, partitioned by dataset
``counts``       category, dataset, version, n
Choosing one corpus / version / category is a partition filter, so a read
only lists and scans that folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairwright.sources.pairs import CSV_OPTIONS

ANNOTATION_SCHEMA = ("pair_id BIGINT, nl_sentence STRING, fol_expression STRING, error_type STRING, "
                     "dataset STRING, version STRING, category STRING")
CORRECTED_SCHEMA = ("pair_id BIGINT, nl_sentence STRING, fol_expression STRING, fol_corrected STRING, "
                    "is_equal BOOLEAN, dataset STRING")
COUNTS_SCHEMA = "category STRING, dataset STRING, version STRING, n BIGINT"


def _dynamic_overwrite(df: DataFrame, path: str, parts: list[str], rebalance: bool = True) -> None:
    """Replace only the partition folders present in ``df``.

    ``rebalance`` groups rows by partition value before writing, so each folder
    gets few files instead of one per task; with AQE a value holding most rows
    is split over several tasks, and small ones are merged.
    """
    if rebalance:
        df = df.hint("rebalance", *parts)
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
       .partitionBy(*parts).parquet(path))


def write_annotations(df: DataFrame, path: str, rebalance: bool = True) -> None:
    """Replace only the (dataset, version, category) folders present in ``df``."""
    cols = [c.split(" ")[0] for c in ANNOTATION_SCHEMA.split(", ")]
    _dynamic_overwrite(df.select(*cols), path, ["dataset", "version", "category"], rebalance)


def read_annotations(spark: SparkSession, path: str, dataset: str | None = None,
                     version: str | None = None, category: str | None = None) -> DataFrame:
    df = spark.read.schema(ANNOTATION_SCHEMA).parquet(path)
    for col, value in (("dataset", dataset), ("version", version), ("category", category)):
        if value is not None:
            df = df.filter(F.col(col) == value)
    return df


def write_corrected(df: DataFrame, path: str, rebalance: bool = False) -> None:
    """Replace the corpora present in ``df``. A table has few corpora, so every
    task writes its rows where they are, without a shuffle of the texts."""
    cols = [c.split(" ")[0] for c in CORRECTED_SCHEMA.split(", ")]
    _dynamic_overwrite(df.select(*cols), path, ["dataset"], rebalance)


def read_corrected(spark: SparkSession, path: str, dataset: str | None = None) -> DataFrame:
    df = spark.read.schema(CORRECTED_SCHEMA).parquet(path)
    return df.filter(F.col("dataset") == dataset) if dataset is not None else df


def write_counts(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    writer = df.select("category", "dataset", "version", F.col("n").cast("bigint")).write.mode("overwrite")
    if fmt == "csv":
        writer = writer.options(**CSV_OPTIONS)
    writer.format(fmt).save(path)


def read_counts(spark: SparkSession, path: str, fmt: str = "parquet",
                names: dict[str, str] | None = None) -> DataFrame:
    """Read a count table. ``names`` maps the file's column names to
    ``category, dataset, version, n`` for tables filled in by hand."""
    if names is None:
        reader = spark.read.schema(COUNTS_SCHEMA)
        if fmt == "csv":
            reader = reader.options(**CSV_OPTIONS | {"emptyValue": ""})
        return reader.format(fmt).load(path)
    reader = spark.read.option("header", True) if fmt == "csv" else spark.read
    raw = reader.format(fmt).load(path)
    out = {dst: src for src, dst in names.items()}
    return raw.select(
        F.col(out["category"]).cast("string").alias("category"),
        F.col(out["dataset"]).cast("string").alias("dataset"),
        F.col(out["version"]).cast("string").alias("version"),
        F.col(out["n"]).cast("bigint").alias("n"))
