"""The model job: pay once per distinct request, survive failures, resume.

1. A request is identified without building its prompt:
   ``key = sha256(model \\1 digest \\1 len(input_1) \\1 input_1 \\1 len(input_2) \\1 input_2 ...)``
   where ``digest`` identifies the constant text of the prompt (system text
   included), one for each category, so the same prompt has the same key
   whichever function asked for it. A null input gives a null key: no call.
2. Rows with their key are written to the scratch folder once; requests,
   deduplication and the answer join all read that table.
3. Distinct (key, inputs), null keys dropped: a hash aggregate with a map-side
   partial step, so a request shared by a third of all rows still sends one
   row per task to the shuffle.
4. ``left_anti`` join with the ``ok`` answers already stored. The store is
   partitioned by model and digest, so only the folders of this job are read.
5. Only now is the prompt rendered, once per distinct key. The pending requests
   are written to ``<store>/_pending/<run>`` (hidden from readers of the
   store); a task lost during the calls re-reads this small table.
6. The calls run in commits of about ``commit_rows`` requests, each appended
   to the store on its own, so a crash loses the calls of one commit at most.
   A commit reads its own folder of the pending requests only.
   A client's failures are per prompt: answered prompts are kept, failed ones
   are called again with growing pauses, and in the end become
   ``status='failed'`` rows with the full error text. An ``AnswerExchange``
   answers a commit's table with a table instead (batch form, no Python).
7. The answers of this job, one for each key (the fewest attempts, then the
   least text), are checkpointed and joined to the rows by a plain equi-join:
   both sides come from exchanges, so adaptive execution may broadcast by the
   real size and splits a hot key. Rows without a key never enter the join.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairwright.fixed_values import MAX_RETRIES
from pairwright.plans.prompts import PromptSpec
from pairwright.session import checkpoint_root, path_exists, scratch_path, ship_package

ANSWER_SCHEMA = "key STRING, answer STRING, status STRING, error STRING, attempts INT, model STRING, digest STRING"
PENDING_SCHEMA = "key STRING, digest STRING, prompt STRING"
CALL_SCHEMA = "key STRING, digest STRING, answer STRING, status STRING, error STRING, attempts INT"
SEP = "\u0001"
#: Requests of one commit.
COMMIT_ROWS = 20_000
#: Seconds before the first repeated call; doubled for each further one.
BACKOFF = 0.5


@dataclass(frozen=True)
class AnswerExchange:
    """A model that answers by table: ``answers`` maps the pending requests
    (key, digest, prompt) to (key, answer); keys it leaves out count as failed."""

    name: str
    answers: Callable[[DataFrame], DataFrame]


def request_key(model: str, digest: str | Column, *inputs: Column) -> Column:
    parts = [F.lit(model), F.lit(SEP), F.lit(digest) if isinstance(digest, str) else digest]
    for c in inputs:
        parts += [F.lit(SEP), F.char_length(c).cast("string"), F.lit(SEP), c]
    return F.sha2(F.concat(*parts), 256)


def strip_answer(c: Column) -> Column:
    """Leading and trailing Unicode whitespace removed (``trim`` removes spaces only)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def call_prompts(client, system: str, prompts: list[str], max_retries: int = MAX_RETRIES, backoff: float = BACKOFF):
    """(answer, status, error, attempts) of every prompt.

    ``client.complete`` returns an answer or an exception for each prompt; only
    failed prompts are called again. If it raises instead, nothing is known of
    the single prompts, so from then on each is called alone.
    """
    out = [(None, "failed", "not called", 0)] * len(prompts)
    todo, alone = list(range(len(prompts))), False
    for attempt in range(1, max_retries + 2):
        if attempt > 1 and backoff:
            time.sleep(backoff * 2 ** (attempt - 2))
        failed = []
        for group in [[i] for i in todo] if alone else [todo]:
            try:
                got = list(client.complete(system, [prompts[i] for i in group]))
                if len(got) != len(group):
                    raise ValueError(f"backend returned {len(got)} answers for {len(group)} prompts")
            except Exception as exc:  # noqa: BLE001 - any backend error is recorded
                got, alone = [exc] * len(group), True
            for i, answer in zip(group, got):
                if isinstance(answer, Exception):
                    out[i] = (None, "failed", repr(answer), attempt)
                    failed.append(i)
                else:
                    out[i] = (answer, "ok", None, attempt)
        todo = failed
        if not todo:
            break
    return out


def _caller(backend, system: str, max_retries: int, batch_size: int, backoff: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if hasattr(backend, "open"):
            backend.open()
        for pdf in batches:
            for start in range(0, len(pdf), batch_size):
                part = pdf.iloc[start:start + batch_size]
                done = call_prompts(backend, system, part["prompt"].tolist(), max_retries, backoff)
                answer, status, error, attempts = map(list, zip(*done))
                yield pd.DataFrame({
                    "key": part["key"].tolist(), "digest": part["digest"].tolist(), "answer": answer,
                    "status": status, "error": error, "attempts": attempts,
                }).astype({"attempts": "int32"})
    return run


def stored(spark, store: str, model: str | None = None, digests=None) -> DataFrame:
    """Rows of the store; ``model`` and ``digests`` choose folders."""
    df = spark.read.schema(ANSWER_SCHEMA).parquet(store)
    if model is not None:
        df = df.where(F.col("model") == model)
    if digests is not None:
        df = df.where(F.col("digest").isin(*digests))
    return df


def read_answers(spark, store: str, model: str | None = None, digests=None) -> DataFrame:
    """key, answer: one ok answer for each key, always the same one."""
    ok = stored(spark, store, model, digests).where("status = 'ok'")
    best = ok.groupBy("key").agg(F.min(F.struct("attempts", "answer")).alias("best"))
    return best.select("key", F.col("best.answer").alias("answer"))


def pending_requests(requests: DataFrame, spec: PromptSpec, *, store: str, model: str) -> DataFrame:
    """key, digest, prompt of every distinct request without an ok answer.

    ``requests`` has ``key`` and ``digest`` followed by the spec's inputs.
    """
    spark = requests.sparkSession
    inputs = [c for c in requests.columns if c not in ("key", "digest")]
    todo = requests.where(F.col("key").isNotNull()).distinct()
    if path_exists(spark, store):
        todo = todo.join(stored(spark, store, model, spec.digests).where("status = 'ok'").select("key"), "key", "left_anti")
    return todo.select("key", "digest", spec.render(*[F.col(c) for c in inputs]).alias("prompt"))


def import_answers(pending: DataFrame, answers: DataFrame, *, store: str, model: str) -> None:
    """Append the answers (key, answer) to the pending requests; keys without one are failed."""
    answers = answers.groupBy("key").agg(F.min("answer").alias("answer"))
    rows = pending.select("key", "digest").join(answers, "key", "left")
    ok = F.col("answer").isNotNull()
    _append(rows.select("key", "digest", "answer", F.when(ok, "ok").otherwise("failed").alias("status"),
                        F.when(~ok, "no answer in the table").alias("error"), F.lit(1).alias("attempts")), store, model)


def _append(rows: DataFrame, store: str, model: str) -> None:
    rows.withColumn("model", F.lit(model)).write.mode("append").partitionBy("model", "digest").parquet(store)


def request_status(requests: DataFrame, *, store: str, model: str, digests) -> DataFrame:
    """digest, status (ok, failed, pending), n: distinct requests by what became of them."""
    spark = requests.sparkSession
    asked = requests.where(F.col("key").isNotNull()).select("key", "digest").distinct()
    if not path_exists(spark, store):
        return asked.groupBy("digest").agg(F.lit("pending").alias("status"), F.count("*").alias("n"))
    # 'ok' is the largest of the two words.
    state = stored(spark, store, model, digests).groupBy("key").agg(F.max("status").alias("status"))
    return asked.join(state, "key", "left").groupBy("digest", F.coalesce("status", F.lit("pending")).alias("status")).agg(F.count("*").alias("n"))


def _delete(spark, path: str) -> None:
    hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hpath, True)


def call_model(requests: DataFrame, spec: PromptSpec, *, backend, store: str, model: str | None = None,
               concurrency: int | None = None, max_retries: int = MAX_RETRIES, batch_size: int = 16,
               commit_rows: int = COMMIT_ROWS, backoff: float = BACKOFF) -> DataFrame:
    """Answer each distinct request once; return key, answer of every ok key of this job's prompts."""
    spark = requests.sparkSession
    model = model or backend.name
    path = f"{store}/_pending/{uuid.uuid4().hex}"
    pending_requests(requests, spec, store=store, model=model).write.parquet(path)
    pending = spark.read.schema(PENDING_SCHEMA).parquet(path)
    commits = max(1, -(-pending.count() // commit_rows))
    if commits > 1:
        # A folder for each commit, so that none reads the requests of the others.
        commit = F.pmod(F.xxhash64("key"), F.lit(commits)).cast("int").alias("commit")
        pending.select("*", commit).repartition("commit").write.partitionBy("commit").parquet(f"{path}-commits")
    for k in range(commits):
        folder = path if commits == 1 else f"{path}-commits/commit={k}"
        if commits > 1 and not path_exists(spark, folder):
            continue
        part = spark.read.schema(PENDING_SCHEMA).parquet(folder)
        if isinstance(backend, AnswerExchange):
            import_answers(part, backend.answers(part), store=store, model=model)
        else:
            ship_package(spark)
            call = _caller(backend, spec.system, max_retries, batch_size, backoff)
            _append(part.repartition(concurrency or spark.sparkContext.defaultParallelism).mapInPandas(call, CALL_SCHEMA), store, model)
    _delete(spark, path)
    _delete(spark, f"{path}-commits")
    return read_answers(spark, store, model, spec.digests)


def keyed_rows(df: DataFrame, spec: PromptSpec, inputs, model: str) -> DataFrame:
    """``df`` with ``_digest``, ``_key`` and the inputs as ``_in0`` ..., stored once.

    Inputs that are columns of ``df`` aren't stored a second time.
    """
    spark = df.sparkSession
    named = {f"_in{i}": c for i, c in enumerate(inputs) if isinstance(c, str) and c in df.columns}
    inputs = [F.col(c) if isinstance(c, str) else c for c in inputs]
    digest = spec.digest_of(*inputs)
    path = scratch_path(spark, "keyed")
    df.select("*", digest.alias("_digest"), request_key(model, digest, *spec.hashed(*inputs)).alias("_key"),
              *[c.alias(f"_in{i}") for i, c in enumerate(inputs) if f"_in{i}" not in named]).write.parquet(path)
    kept = spark.read.parquet(path)
    return kept.select(*df.columns, "_digest", "_key", *[F.col(named.get(f"_in{i}", f"_in{i}")).alias(f"_in{i}") for i in range(len(inputs))])


def requests_of(keyed: DataFrame) -> DataFrame:
    """key, digest and inputs of keyed rows."""
    return keyed.select(F.col("_key").alias("key"), F.col("_digest").alias("digest"), *[c for c in keyed.columns if c.startswith("_in")])


def join_answers(keyed: DataFrame, answers: DataFrame, out: str) -> DataFrame:
    """The rows with the stripped answer of their key in ``out`` (null without one)."""
    checkpoint_root(keyed.sparkSession)
    rows = keyed.drop("_digest", *[c for c in keyed.columns if c.startswith("_in")])
    own = answers.select(F.col("key").alias("_key"), strip_answer(F.col("answer")).alias(out)).checkpoint()
    asked = rows.where(F.col("_key").isNotNull()).join(own, "_key", "left").drop("_key")
    silent = rows.where(F.col("_key").isNull()).drop("_key").withColumn(out, F.lit(None).cast("string"))
    return asked.unionByName(silent)


def with_answers(df: DataFrame, spec: PromptSpec, inputs, out: str, *, backend, store: str,
                 model: str | None = None, **job) -> DataFrame:
    """``df`` plus column ``out``: the stripped model answer for the prompt made
    from the ``inputs`` columns (null where an input is null or the call failed)."""
    model = model or backend.name
    keyed = keyed_rows(df, spec, inputs, model)
    answers = call_model(requests_of(keyed), spec, backend=backend, store=store, model=model, **job)
    return join_answers(keyed, answers, out)


def compact_answers(spark, store: str, out: str) -> DataFrame:
    """Rewrite an answer store with one row per key into ``out``.

    An ``ok`` answer wins over failed attempts, fewer attempts over more; a key
    that only failed keeps one failed row, so a later run still retries it.
    The step combines map-side before its shuffle; the result is read back.
    """
    rows = stored(spark, store)
    rank = F.struct((F.col("status") != "ok").alias("bad"), "attempts", "answer", "status", "error")
    best = rows.groupBy("model", "digest", "key").agg(F.min(rank).alias("r"))
    best.select("key", "r.answer", "r.status", "r.error", "r.attempts", "model", "digest").write.partitionBy("model", "digest").parquet(out)
    return stored(spark, out)
