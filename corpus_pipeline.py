"""From raw documents to token ids: five stages, each on all its predecessor kept.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and
returns a DataFrame. All but the last return the columns of ``docs``. ``run``
writes every stage as Parquet in the shared scratch folder and rereads it, so
an executor lost later never repeats an earlier stage.

Columns other than ``doc_id``, ``text``, ``lang`` and ``n_chars`` pass through,
whatever their names. Null and empty texts go in the first stage; the later
ones take them all the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairwright.llm import bpe, decontaminate, langid, near_dedup, secret_scan
from pairwright.llm.queries import tokenizer_files
from pairwright.session import scratch_path

#: SQL cannot express hyperdimensional vectors or token merges.
ORACLE_SQL = None


def _free(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` doesn't have."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name = f"_{name}"
    return name


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop texts of no learned language: without a letter, or under the cutoff of their language and length."""
    learned = ~langid.held_out() & F.col("lang").isNotNull()
    langs, protos = langid.prototypes(docs.where(learned))
    pred, score = _free(docs, "lang_pred"), _free(docs, "lang_score")
    # The training rows are scored once more for the cutoffs: no copy of the texts is stored.
    scored = lambda rows: langid.predict(rows, langs, protos, pred=pred, score=score)
    found = langid.cutoffs(scored(docs.where(learned)), pred, score)
    return langid.drop_unlearned(scored(docs), found, pred, score).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the smallest id of each group; rows without an id stay.

    Rows are named by id: rows that share an id are kept or dropped together,
    but of equal rows one stays.
    """
    kept = near_dedup.near_groups(docs).where("kept")
    ids = kept.groupBy(F.col("doc_id").alias("kept_id")).agg(F.count("*").alias("kept_rows")).checkpoint()
    same = docs["doc_id"].eqNullSafe(F.col("kept_id"))
    single = (F.col("kept_rows") == 1) | F.col("kept_id").isNull()
    repeated = ids.where(~single)
    out = docs.join(ids.where(single), same, "left_semi")
    if not repeated.isEmpty():
        out = out.unionByName(docs.join(repeated, same, "left_semi").dropDuplicates(["doc_id", "text"]))
    return out


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mask every secret in the texts; ``n_chars`` follows where it exists."""
    out = secret_scan.redact_secrets(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return out


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, and digests of the ids and of the bytes decoded from them."""
    ranks, pattern = tokenizer_files()
    both = bpe.encode(docs, ranks, pattern, decoded=True)
    return both.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids",
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", remove_benchmark),
    ("secret_scan", mask_secrets),
    ("byte_bpe", encode_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
