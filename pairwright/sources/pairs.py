"""Pair corpus readers.

A corpus is a table of (sentence, formula). The stored form is
``pair_id BIGINT, nl_sentence STRING, fol_expression STRING``; readers always
pass an explicit schema and select by name (a JSON reader would otherwise
order inferred fields alphabetically, which swaps the two columns).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairwright.session import ensure_parallelism

PAIR_COLUMNS = ["pair_id", "nl_sentence", "fol_expression"]
PAIR_SCHEMA = "pair_id BIGINT, nl_sentence STRING, fol_expression STRING"
# Field names of the JSON corpus form: {"NL": ..., "FOL": ...}.
JSON_PAIR_SCHEMA = "NL STRING, FOL STRING"


# Exact text round trip: nothing is trimmed, a null is the mark \\N, and an
# empty text is "". Line breaks inside a text are written as \\n and \\r and
# backslashes doubled, so a file can be split between tasks at any line.
CSV_OPTIONS = {"header": True, "escape": '"', "nullValue": "\\N", "emptyValue": '""',
               "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def _escape(c: str) -> Column:
    out = F.replace(F.col(c), F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(out, F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r"))


def _unescape(c: str) -> Column:
    # The pieces between doubled backslashes hold no other backslash than a line break's.
    pieces = F.split(F.col(c), r"\\\\")
    back = F.transform(pieces, lambda p: F.replace(F.replace(p, F.lit("\\n"), F.lit("\n")), F.lit("\\r"), F.lit("\r")))
    return F.array_join(back, "\\")


def read_pairs(spark: SparkSession, path: str, fmt: str = "parquet", schema: str = PAIR_SCHEMA,
               escaped: bool = True, **options) -> DataFrame:
    """Read a pair table (parquet, csv, orc or json lines) with a fixed schema.

    CSV written by ``write_pairs`` splits between tasks. For foreign CSV files
    with raw line breaks inside quotes pass ``escaped=False, multiLine=True``
    (then each file is one task).
    """
    reader = spark.read.schema(schema)
    if fmt == "csv":
        reader = reader.options(**CSV_OPTIONS | {"emptyValue": ""})
    df = reader.options(**options).format(fmt).load(path).select(*PAIR_COLUMNS)
    if fmt == "csv" and escaped:
        df = df.withColumns({c: _unescape(c) for c in PAIR_COLUMNS[1:]})
    return df


def write_pairs(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    df = df.select(*PAIR_COLUMNS)
    if fmt == "csv":
        df = df.withColumns({c: _escape(c) for c in PAIR_COLUMNS[1:]})
    writer = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        writer = writer.options(**CSV_OPTIONS)
    writer.save(path)


def select_pairs(df: DataFrame, sentence: str = "NL", formula: str = "FOL") -> DataFrame:
    """Pick the sentence and formula columns under the pair names."""
    rest = [c for c in ("pair_id",) if c in df.columns]
    return df.select(*rest, F.col(sentence).alias("nl_sentence"), F.col(formula).alias("fol_expression"))


def read_json_pairs(spark: SparkSession, path: str, array_file: bool = False,
                    id_col: str | None = "pair_id") -> DataFrame:
    """Read ``{"NL", "FOL"}`` records, renamed to the pair columns.

    ``array_file=True`` reads files holding one JSON array each. Such a file is
    parsed by a single task, so its records are spread over the cluster right
    after parsing (large corpora are better stored as JSON lines or parquet).
    Without a ``pair_id`` field in the data, set ``id_col=None`` and number the
    rows with ``operators.indexing.row_index``.
    """
    schema = JSON_PAIR_SCHEMA + (f", {id_col} BIGINT" if id_col else "")
    df = spark.read.schema(schema).option("multiLine", array_file).json(path)
    if array_file:
        df = ensure_parallelism(df)
    return select_pairs(df)
