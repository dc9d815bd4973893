"""The model job: one call per distinct key, resume, failures, nulls, audit."""

import hashlib
import sys

import rule_backends as B
from pyspark import cloudpickle

from pyspark.sql import functions as F

from pairwright.operators import audit
from pairwright.operators import candidates as C
from pairwright.plans import annotate as AN
from pairwright.plans import prompts as PR
from pairwright.plans import model_job as M
from pairwright.plans.model_job import ANSWER_SCHEMA, AnswerExchange, call_prompts, request_key


def _store_rows(spark, store):
    return spark.read.schema(ANSWER_SCHEMA).parquet(store)


class FlakyRule(B.SingleAnswerRule):
    """Fails every prompt whose md5 starts with '0'; the rest as the rule."""

    name = "flaky"

    def complete(self, system, prompts):
        good = super().complete(system, prompts)
        return [RuntimeError("backend unavailable " + "x" * 2000) if hashlib.md5(p.encode()).hexdigest()[0] == "0" else g
                for p, g in zip(prompts, good)]


# Backends defined here are shipped to the workers by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def test_calls_equal_distinct_keys_and_resume(spark, pairs, tmp_dir):
    cands = C.candidates(pairs, "wrong_binding")
    out = AN.annotate_single(pairs, "wrong_variable_binding", backend=B.SingleAnswerRule(), store=tmp_dir)
    assert out.count() == cands.count()
    layout = PR.layout_single("wrong_variable_binding")
    distinct_keys = cands.select(layout.render()).distinct().count()
    keys = cands.select(request_key("rule-single", layout.digest, F.col("nl_sentence"),
                                    F.col("fol_expression"))).distinct().count()
    assert keys == distinct_keys
    assert _store_rows(spark, tmp_dir).count() == distinct_keys
    # a second run pays for nothing
    again = AN.annotate_single(pairs, "wrong_variable_binding", backend=B.SingleAnswerRule(), store=tmp_dir)
    assert again.count() == cands.count()
    assert _store_rows(spark, tmp_dir).count() == distinct_keys
    # the answers partition the rows
    a = audit.audit_applies(out).count()
    u = audit.audit_unexpected(out).count()
    n = out.filter(F.col("error_type") == "error category does not apply").count()
    z = out.filter(F.col("error_type").isNull()).count()
    assert a + u + n + z == out.count()


def test_failures_are_rows_not_stage_failures(spark, pairs, tmp_dir):
    out = AN.annotate_single(pairs, "conjunction", backend=FlakyRule(), store=tmp_dir, batch_size=4, backoff=0)
    store = _store_rows(spark, tmp_dir)
    failed = store.filter("status = 'failed'").count()
    assert failed > 0 and store.filter("status = 'ok'").count() > 0
    worst = store.filter("status = 'failed'").first()
    assert worst.attempts == 3 and len(worst.error) > 2000
    assert out.filter(F.col("error_type").isNull()).count() > 0
    # rerun with a healthy backend only asks for the failed keys
    before = store.count()
    AN.annotate_single(pairs, "conjunction", backend=B.SingleAnswerRule(), store=tmp_dir, model="flaky").count()
    store = _store_rows(spark, tmp_dir)
    assert store.count() == before + failed
    assert store.filter("status = 'ok'").count() == store.select("key").distinct().count()


def test_null_prompt_no_call(spark, tmp_dir):
    df = spark.createDataFrame([(1, "s, t", None), (2, None, "P(a, b)"), (3, "s", "P(a, b)")],
                               "pair_id bigint, nl_sentence string, fol_expression string")
    out = AN.annotate_single(df, "wrong_binding", backend=B.SingleAnswerRule(), store=tmp_dir)
    got = {r.pair_id: r.error_type for r in out.collect()}
    assert set(got) == {2, 3} and got[2] is None and got[3] is not None
    assert _store_rows(spark, tmp_dir).count() == 1


def test_correct_and_promote(spark, pairs, tmp_dir):
    out = AN.correct_pairs(pairs, backend=B.CorrectorRule(PR.layout_correction()), store=tmp_dir)
    changed = out.filter(~F.col("is_equal")).count()
    assert changed == 200  # only template 1 holds ∀y
    promoted = AN.promote_corrected(out)
    assert promoted.columns == ["pair_id", "nl_sentence", "fol_expression"]
    assert C.candidates(promoted, "overgeneralization").count() == 0


def test_multi_label_answers(spark, pairs, tmp_dir):
    out = AN.annotate_multi(pairs, 50, backend=B.MultiLabelRule(PR.layout_catalogue()), store=tmp_dir)
    rows = out.collect()
    assert len(rows) == 50
    for r in rows:
        if r.nl_sentence is None or r.fol_expression is None:
            assert r.error_type is None
        else:
            assert r.error_type.startswith("[")


def test_chunked_calls_equal_single_job(spark, pairs, tmp_dir):
    one = AN.annotate_single(pairs, "conjunction", backend=B.SingleAnswerRule(), store=tmp_dir + "-a")
    many = AN.annotate_single(pairs, "conjunction", backend=B.SingleAnswerRule(), store=tmp_dir + "-b", commit_rows=50)
    assert one.exceptAll(many).count() == 0 and many.exceptAll(one).count() == 0
    assert _store_rows(spark, tmp_dir + "-a").count() == _store_rows(spark, tmp_dir + "-b").count()


def test_category_without_prefilter_takes_all_rows(spark, pairs, tmp_dir):
    out = AN.annotate_single(pairs, "missing_category", backend=B.SingleAnswerRule(), store=tmp_dir)
    assert out.count() == pairs.count()
    with_prompt = pairs.filter(F.col("nl_sentence").isNotNull() & F.col("fol_expression").isNotNull())
    distinct_pairs = with_prompt.select("nl_sentence", "fol_expression").distinct().count()
    assert _store_rows(spark, tmp_dir).count() == distinct_pairs


def test_other_column_names(spark, pairs, tmp_dir):
    renamed = pairs.withColumnRenamed("nl_sentence", "s").withColumnRenamed("fol_expression", "f")
    out = AN.annotate_single(renamed, "xor", backend=B.SingleAnswerRule(), store=tmp_dir, sentence="s", formula="f")
    assert out.count() == 200 and "error_type" in out.columns


class Counting:
    """Counts its calls; bad prompts give their exception, or raise for the whole batch."""

    name = "counting"

    def __init__(self, raises):
        self.raises, self.calls = raises, 0

    def complete(self, system, prompts):
        if self.raises and "bad" in prompts:
            raise RuntimeError("batch refused")
        self.calls += sum(p != "bad" for p in prompts)
        return [RuntimeError("no") if p == "bad" else p.upper() for p in prompts]


def test_good_prompts_are_paid_once():
    prompts = [f"p{k}" for k in range(15)] + ["bad"]
    for raises in (False, True):
        client = Counting(raises)
        out = call_prompts(client, "", prompts, max_retries=2, backoff=0)
        assert client.calls == 15
        assert [o[0] for o in out[:15]] == [f"P{k}" for k in range(15)] and out[15][1:2] == ("failed",) and out[15][3] == 3


def test_single_and_category_jobs_share_their_answers(spark, pairs, tmp_dir):
    AN.annotate_single(pairs, "wrong_variable_binding", backend=B.SingleAnswerRule(), store=tmp_dir).count()
    paid = _store_rows(spark, tmp_dir).count()
    AN.annotate_categories(pairs, ["wrong_binding"], backend=B.SingleAnswerRule(), store=tmp_dir).count()
    assert _store_rows(spark, tmp_dir).count() == paid


def test_store_is_read_by_folder(spark, pairs, tmp_dir):
    AN.annotate_single(pairs, "xor", backend=B.SingleAnswerRule(), store=tmp_dir).count()
    read = M.stored(spark, tmp_dir, "rule-single", [PR.layout_single("invalid_xor_usage").digest])
    explained = spark.sparkContext._jvm.PythonSQLUtils.explainString(read._jdf.queryExecution(), "formatted")
    assert "PartitionFilters: [isnotnull(model" in explained and "digest#" in explained and read.count() > 0


def test_answer_table_equals_client(spark, pairs, tmp_dir):
    from pairwright.plans.queries import corrector_answers, multi_answers, single_answers

    one = AN.annotate_single(pairs, "xor", backend=B.SingleAnswerRule(), store=tmp_dir + "-a")
    table = AN.annotate_single(pairs, "xor", backend=AnswerExchange("t", single_answers), store=tmp_dir + "-b")
    assert one.exceptAll(table).count() == 0 and table.count() == 200
    layout = PR.layout_catalogue()
    a = AN.annotate_multi(pairs, 80, backend=B.MultiLabelRule(layout), store=tmp_dir + "-c")
    b = AN.annotate_multi(pairs, 80, backend=AnswerExchange("m", multi_answers(layout)), store=tmp_dir + "-d")
    assert a.exceptAll(b).count() == 0
    layout = PR.layout_correction()
    a = AN.correct_pairs(pairs, backend=B.CorrectorRule(layout), store=tmp_dir + "-e")
    b = AN.correct_pairs(pairs, backend=AnswerExchange("c", corrector_answers(layout)), store=tmp_dir + "-f")
    assert a.exceptAll(b).count() == 0


def test_missing_answers_fail_and_status_counts(spark, pairs, tmp_dir):
    spec = PR.layout_single("invalid_xor_usage").spec()
    keyed = M.keyed_rows(C.candidates(pairs, "xor"), spec, ["nl_sentence", "fol_expression"], "t")
    requests = M.requests_of(keyed)
    count = lambda: {r.status: r.n for r in M.request_status(requests, store=tmp_dir, model="t", digests=spec.digests).collect()}
    total = requests.select("key").distinct().count()
    assert count() == {"pending": total}
    none = AnswerExchange("t", lambda pending: pending.select("key", F.lit("x").alias("answer")).where("key < '8'"))
    M.call_model(requests, spec, backend=none, store=tmp_dir)
    got = count()
    assert got["ok"] + got["failed"] == total and got["failed"] > 0
    M.call_model(requests, spec, backend=AnswerExchange("t", lambda p: p.select("key", F.lit("y").alias("answer"))), store=tmp_dir)
    assert count() == {"ok": total}


def test_compact_answers(spark, tmp_dir):
    from pairwright.plans.model_job import compact_answers

    rows = [("a", "x", "ok", None, 1), ("a", "w", "ok", None, 2), ("a", None, "failed", "e", 3),
            ("b", None, "failed", "e", 3), ("b", None, "failed", "e", 3), ("c", "y", "ok", None, 2)]
    rows = [(*r, "m", "d") for r in rows]
    spark.createDataFrame(rows, ANSWER_SCHEMA).write.partitionBy("model", "digest").parquet(tmp_dir)
    out = compact_answers(spark, tmp_dir, tmp_dir + "-compact")
    got = sorted((r.key, r.status, r.answer) for r in out.collect())
    assert got == [("a", "ok", "x"), ("b", "failed", None), ("c", "ok", "y")]


def test_unknown_category_is_rejected(pairs, tmp_dir):
    import pytest

    with pytest.raises(KeyError):
        AN.annotate_categories(pairs, ["no_such_category"], backend=B.SingleAnswerRule(), store=tmp_dir)
    with pytest.raises(KeyError):
        AN.annotate_single(pairs, "no_such_category", backend=B.SingleAnswerRule(), store=tmp_dir)


def test_commits_read_their_own_requests_only(spark, pairs, tmp_dir):
    spec = PR.layout_single("conjunction_instead_implication").spec()
    requests = M.requests_of(M.keyed_rows(C.candidates(pairs, "conjunction"), spec, ["nl_sentence", "fol_expression"], "t"))
    files, seen = [], []

    def answers(part):
        files.append(set(part.inputFiles()))
        seen.append({r.key for r in part.collect()})
        return part.select("key", F.lit("x").alias("answer"))

    got = M.call_model(requests, spec, backend=AnswerExchange("t", answers), store=tmp_dir, commit_rows=50)
    total = requests.select("key").distinct().count()
    assert len(files) > 2 and sum(map(len, files)) == len(set().union(*files))
    assert sum(map(len, seen)) == len(set().union(*seen)) == got.count() == total


def test_inputs_are_stored_once(spark, pairs):
    spec = PR.layout_single("invalid_xor_usage").spec()
    keyed = M.keyed_rows(C.candidates(pairs, "xor"), spec, ["nl_sentence", F.upper("fol_expression")], "t")
    stored = spark.read.parquet(*keyed.inputFiles()).columns
    assert "_in0" not in stored and "_in1" in stored
    assert keyed.where("_in0 <> nl_sentence or _in1 <> upper(fol_expression)").count() == 0 and keyed.columns[-2:] == ["_in0", "_in1"]
