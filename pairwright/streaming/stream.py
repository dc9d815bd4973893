"""Run the cleaning chain and candidate flags on a stream of new pair files.

The cleaners and candidate predicates are row-wise, so they apply to a
streaming DataFrame unchanged (no state, no watermark needed). Model
annotation runs per micro-batch through ``foreachBatch``: the answer store's
anti-join makes a replayed batch (after a failure) pay for no key twice, and
each batch replaces its own ``batch_id`` folder of the sink, so a replay
rewrites the batch instead of appending it again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pairwright.operators.candidates import candidate_flags
from pairwright.operators.cleaning import clean_pairs
from pairwright.plans.annotate import annotate_single
from pairwright.session import scratch_path
from pairwright.sources.pairs import PAIR_SCHEMA


def read_pair_stream(spark: SparkSession, path: str, fmt: str = "parquet",
                     schema: str = PAIR_SCHEMA, max_files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).format(fmt)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.load(path)


def curate_stream(stream: DataFrame) -> DataFrame:
    """Cleaned pairs with their candidate categories (array column ``categories``)."""
    return candidate_flags(clean_pairs(stream))


def write_stream(df: DataFrame, sink: str, checkpoint: str | None = None,
                 available_now: bool = False, processing_time: str | None = None) -> StreamingQuery:
    """Append to a parquet sink; the checkpoint lives under the shared checkpoint folder."""
    spark = df.sparkSession
    checkpoint = checkpoint or scratch_path(spark, "stream-checkpoint")
    writer = df.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    elif processing_time:
        writer = writer.trigger(processingTime=processing_time)
    return writer.outputMode("append").start()


def annotate_stream(stream: DataFrame, category: str, *, backend, store: str, sink: str,
                    checkpoint: str | None = None, available_now: bool = False) -> StreamingQuery:
    """Design-3 annotation of each micro-batch into ``sink`` (partition ``batch_id``)."""
    spark = stream.sparkSession
    checkpoint = checkpoint or scratch_path(spark, "stream-checkpoint")

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        annotated = annotate_single(batch, category, backend=backend, store=store)
        (annotated.withColumn("batch_id", F.lit(batch_id))
                  .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
                  .partitionBy("batch_id").parquet(sink))

    writer = stream.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()
