"""Registered queries: each takes (spark, sf_dir) and returns a DataFrame.

Pair queries read the pair corpus that Spark derives from ``part``; text
queries read ``documents`` whole. List-valued outputs are rendered as JSON
text so that they compare across engines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairwright.fixed_values import SEED_MULTI, SEED_SINGLE
from pairwright.functions.text import ALL_ADVERBS, FREQUENCY_ADVERBS
from pairwright.operators import audit, cleaning, deltas, diagnostics, structure, wordlists
from pairwright.operators import candidates as C
from pairwright.operators.glue import glue
from pairwright.operators.indexing import row_index
from pairwright.operators.sampling import sample_n, sample_per_group
from pairwright.plans import annotate as AN
from pairwright.plans import catalogue as cat
from pairwright.plans import loop
from pairwright.plans import prompts as PR
from pairwright.plans.model_job import (
    AnswerExchange,
    call_model,
    import_answers,
    join_answers,
    keyed_rows,
    pending_requests,
    read_answers,
    request_status,
    requests_of,
    stored,
    strip_answer,
)
from pairwright.session import ensure_parallelism, scratch_path
from pairwright.sources import tables
from pairwright.sources.answers_fixture import corrector_answers, multi_answers, single_answers
from pairwright.sources.fixture import load_fixture_pairs, load_structure_pairs
from pairwright.sources.pairs import CSV_OPTIONS, read_json_pairs, read_pairs, select_pairs, write_pairs
from pairwright.sources.snapshots import Snapshots
from pairwright.sources.splits import read_json_array_pairs, read_quoted_csv_pairs

PAIR = ["pair_id", "nl_sentence", "fol_expression"]


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load_fixture_pairs(spark, sf_dir)


def _documents(spark: SparkSession, sf_dir: str, cols=("doc_id", "text")) -> DataFrame:
    return ensure_parallelism(spark.read.parquet(f"{sf_dir}/documents.parquet").select(*cols))


# --- sources ----------------------------------------------------------------

def q_source_pairs(spark, sf_dir):
    """Write the corpus as a CSV table and read it back with a fixed schema."""
    path = scratch_path(spark, "pairs-csv")
    write_pairs(_pairs(spark, sf_dir), path, fmt="csv")
    return read_pairs(spark, path, fmt="csv")


# --- cleaning ---------------------------------------------------------------

def q_strip_special_chars(spark, sf_dir):
    return cleaning.strip_special_chars(_pairs(spark, sf_dir))


def q_strip_special_chars_documents(spark, sf_dir):
    return cleaning.strip_special_chars(_documents(spark, sf_dir), col="text")


def q_lowercase_constants(spark, sf_dir):
    return cleaning.lowercase_constants(_pairs(spark, sf_dir))


def q_remove_adverb_sentences(spark, sf_dir):
    return cleaning.remove_adverb_sentences(_pairs(spark, sf_dir))


def q_clean_pairs(spark, sf_dir):
    return cleaning.clean_pairs(_pairs(spark, sf_dir))


# --- diagnostics ------------------------------------------------------------

def q_not_terminated(spark, sf_dir):
    return diagnostics.not_terminated(_pairs(spark, sf_dir))


def q_not_terminated_documents(spark, sf_dir):
    return diagnostics.not_terminated(_documents(spark, sf_dir), col="text").select("doc_id")


def q_lowercase_diff(spark, sf_dir):
    return diagnostics.lowercase_diff(_pairs(spark, sf_dir))


def q_quoted_terms(spark, sf_dir):
    df = diagnostics.quoted_terms(_pairs(spark, sf_dir))
    return df.withColumn("quoted_words", F.to_json("quoted_words"))


def q_quoted_terms_documents(spark, sf_dir):
    df = diagnostics.quoted_terms(_documents(spark, sf_dir), col="text")
    return df.select("doc_id", F.to_json("quoted_words").alias("quoted_words"))


def q_punctuated_tokens(spark, sf_dir):
    df = diagnostics.punctuated_tokens(_pairs(spark, sf_dir))
    return df.withColumn("punctuated_words", F.to_json("punctuated_words"))


def q_punctuated_tokens_documents(spark, sf_dir):
    df = diagnostics.punctuated_tokens(_documents(spark, sf_dir), col="text")
    return df.select("doc_id", F.to_json("punctuated_words").alias("punctuated_words"))


def q_adverb_matches(spark, sf_dir):
    return diagnostics.adverb_matches(_pairs(spark, sf_dir), FREQUENCY_ADVERBS)


def q_adverb_counts(spark, sf_dir):
    return diagnostics.adverb_counts(_pairs(spark, sf_dir))


# --- candidates -------------------------------------------------------------

def _cand(short):
    def run(spark, sf_dir):
        return C.candidates(_pairs(spark, sf_dir), short)
    return run


def q_candidate_flags(spark, sf_dir):
    df = C.candidate_flags(_pairs(spark, sf_dir))
    return df.withColumn("categories", F.to_json("categories"))


def q_candidate_counts(spark, sf_dir):
    df = _pairs(spark, sf_dir).withColumns({"dataset": F.lit("parts"), "version": F.lit("original")})
    return C.candidate_counts(df)


QUERIES = {
    "source_pairs": q_source_pairs,
    "strip_special_chars": q_strip_special_chars,
    "strip_special_chars_documents": q_strip_special_chars_documents,
    "lowercase_constants": q_lowercase_constants,
    "remove_adverb_sentences": q_remove_adverb_sentences,
    "clean_pairs": q_clean_pairs,
    "not_terminated": q_not_terminated,
    "not_terminated_documents": q_not_terminated_documents,
    "lowercase_diff": q_lowercase_diff,
    "quoted_terms": q_quoted_terms,
    "quoted_terms_documents": q_quoted_terms_documents,
    "punctuated_tokens": q_punctuated_tokens,
    "punctuated_tokens_documents": q_punctuated_tokens_documents,
    "adverb_matches": q_adverb_matches,
    "adverb_counts": q_adverb_counts,
    **{f"cand_{short}": _cand(short) for short in C.PREDICATES},
    "candidate_flags": q_candidate_flags,
    "candidate_counts": q_candidate_counts,
}


# --- sampling, index, JSON source, projections ---------------------------------


SAMPLE_N = 500
SAMPLE_SEED = SEED_MULTI


def q_sample_n(spark, sf_dir):
    return sample_n(_pairs(spark, sf_dir), SAMPLE_N, seed=SAMPLE_SEED)


def q_row_index(spark, sf_dir):
    return row_index(_pairs(spark, sf_dir))


def q_source_json_pairs(spark, sf_dir):
    path = scratch_path(spark, "pairs-json")
    (_pairs(spark, sf_dir)
        .select("pair_id", F.col("nl_sentence").alias("NL"), F.col("fol_expression").alias("FOL"))
        .write.mode("overwrite").json(path))
    return read_json_pairs(spark, path)


def q_source_parquet_pairs(spark, sf_dir):
    path = scratch_path(spark, "pairs-parquet")
    write_pairs(_pairs(spark, sf_dir), path)
    return read_pairs(spark, path)


def q_source_json_array_pairs(spark, sf_dir):
    """Files of one JSON array each (a thousand parts a file), read back."""
    path = scratch_path(spark, "pairs-json-array")
    record = F.struct("pair_id", F.col("nl_sentence").alias("NL"), F.col("fol_expression").alias("FOL"))
    files = _pairs(spark, sf_dir).groupBy(F.expr("pair_id div 100000")).agg(F.to_json(F.collect_list(record)).alias("value"))
    # One line, and so one array, for each file.
    files.select("value").write.option("maxRecordsPerFile", 1).text(path)
    return read_json_pairs(spark, path, array_file=True)


def q_sample_n_repeated_ids(spark, sf_dir):
    """All rows but one, over ids that repeat and are null in every tenth row."""
    ids = spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        F.expr("if(doc_id % 10 = 0, NULL, doc_id div 3)").alias("pair_id"))
    sample = sample_n(ids, ids.count() - 1, seed=SAMPLE_SEED)
    return sample.select(F.coalesce(F.col("pair_id").cast("string"), F.lit("none")).alias("sampled_id"))


def q_select_pairs(spark, sf_dir):
    raw = _pairs(spark, sf_dir).select("pair_id", F.col("nl_sentence").alias("NL"),
                                       F.col("fol_expression").alias("FOL"))
    return select_pairs(raw)


# --- prompts ------------------------------------------------------------------


def q_format_categories(spark, sf_dir):
    df = _pairs(spark, sf_dir)
    return df.select("pair_id", PR.blocks_for(C.category_array()).alias("categories_text"))


def q_prompt_catalogue(spark, sf_dir):
    return _pairs(spark, sf_dir).select("pair_id", PR.layout_catalogue().render().alias("prompt"))


def q_prompt_paired(spark, sf_dir):
    return _pairs(spark, sf_dir).select("pair_id", PR.layout_paired().render().alias("prompt"))


def q_prompt_single(spark, sf_dir):
    df = _pairs(spark, sf_dir).withColumn("category", F.explode(C.category_array()))
    return df.select("pair_id", "category", PR.single_prompt("category").alias("prompt"))


def q_prompt_single_unfiltered(spark, sf_dir):
    """Single-category prompts of the categories without a prefilter, for every row."""
    df = _pairs(spark, sf_dir).withColumn("category", F.explode(F.array(*(F.lit(c) for c in UNFILTERED))))
    return df.select("pair_id", "category", PR.single_prompt("category").alias("prompt"))


def _prompt_correction(variant):
    def run(spark, sf_dir):
        return _pairs(spark, sf_dir).select("pair_id", PR.layout_correction(variant).render().alias("prompt"))
    return run


def q_catalogue_text(spark, sf_dir):
    """The catalogue table rendered for each pair's candidate categories."""
    table = cat.catalogue_df(spark)
    rows = _pairs(spark, sf_dir).select("pair_id", F.explode(C.category_array()).alias("label"))
    block = PR.category_block_column(F.struct(*table.columns))
    # The catalogue has one row a category.
    blocks = rows.join(F.broadcast(table), "label").select("pair_id", F.struct("pos", block.alias("block")).alias("b"))
    ordered = F.transform(F.array_sort(F.collect_list("b")), lambda x: x["block"])
    return blocks.groupBy("pair_id").agg(F.array_join(ordered, "").alias("categories_text"))


# --- model job ----------------------------------------------------------------


SINGLE = AnswerExchange("rule-single", single_answers)
UNFILTERED = ("missing_category", "missing_parentheses", "predicate_naming_error", cat.PREDICATE_NESTING)
SINGLE_CATEGORY = "wrong_variable_binding"
SINGLE_SAMPLE_CATEGORY = "neither_nor_translation_error"
SINGLE_SAMPLE_N = 300
SINGLE_SAMPLE_SEED = SEED_SINGLE
MULTI_N = 500
DATASET = "parts"
CLEANED_DATASET = "parts_cleaned"
DATASETS = (DATASET, CLEANED_DATASET)
CHART_CATEGORY = "wrong_variable_binding"


def _corpora(spark, sf_dir):
    """Two corpora, as in the study: the raw pairs and their rule-cleaned form."""
    raw = _pairs(spark, sf_dir)
    return (raw.withColumn("dataset", F.lit(DATASET))
               .unionByName(cleaning.clean_pairs(raw).withColumn("dataset", F.lit(CLEANED_DATASET))))


def _keyed_single(spark, sf_dir):
    spec = PR.layout_single(SINGLE_CATEGORY).spec()
    rows = C.candidates(_pairs(spark, sf_dir), SINGLE_CATEGORY)
    return spec, keyed_rows(rows, spec, ["nl_sentence", "fol_expression"], SINGLE.name)


def q_model_call(spark, sf_dir):
    spec, keyed = _keyed_single(spark, sf_dir)
    store = scratch_path(spark, "answers")
    call_model(requests_of(keyed), spec, backend=SINGLE, store=store)
    return stored(spark, store).select("key", strip_answer(F.col("answer")).alias("answer"), "status")


def q_pending_requests(spark, sf_dir):
    """The request table handed to a batch model."""
    spec, keyed = _keyed_single(spark, sf_dir)
    return pending_requests(requests_of(keyed), spec, store=scratch_path(spark, "answers"), model=SINGLE.name).drop("digest")


def _half_answered(spark, sf_dir):
    """Half of the requests (by the key's first digit) have come back."""
    spec, keyed = _keyed_single(spark, sf_dir)
    store = scratch_path(spark, "answers")
    path = scratch_path(spark, "pending")
    pending_requests(requests_of(keyed), spec, store=store, model=SINGLE.name).write.parquet(path)
    pending = spark.read.parquet(path).where(F.col("key") < "8")
    import_answers(pending, single_answers(pending).where(F.col("key") >= "1"), store=store, model=SINGLE.name)
    return spec, keyed, store


def q_import_answers(spark, sf_dir):
    """Rows after a part of the answer table was imported."""
    spec, keyed, store = _half_answered(spark, sf_dir)
    return join_answers(keyed, read_answers(spark, store, SINGLE.name, spec.digests), "error_type")


def q_request_status(spark, sf_dir):
    """Distinct requests by state after a part of the answers was imported."""
    spec, keyed, store = _half_answered(spark, sf_dir)
    return request_status(requests_of(keyed), store=store, model=SINGLE.name, digests=spec.digests).drop("digest")


def q_annotate_single(spark, sf_dir):
    return AN.annotate_single(_pairs(spark, sf_dir), SINGLE_CATEGORY, backend=SINGLE,
                              store=scratch_path(spark, "answers"))


def q_annotate_single_sample(spark, sf_dir):
    return AN.annotate_single_sample(_pairs(spark, sf_dir), SINGLE_SAMPLE_CATEGORY, SINGLE_SAMPLE_N,
                                     seed=SINGLE_SAMPLE_SEED, backend=SINGLE,
                                     store=scratch_path(spark, "answers"))


def q_annotate_multi(spark, sf_dir):
    return AN.annotate_multi(_pairs(spark, sf_dir), MULTI_N, seed=SAMPLE_SEED, design=1,
                             backend=AnswerExchange("rule-multi", multi_answers(PR.layout_catalogue())),
                             store=scratch_path(spark, "answers"))


def q_annotate_multi_paired(spark, sf_dir):
    return AN.annotate_multi(_pairs(spark, sf_dir), MULTI_N, seed=SAMPLE_SEED, design=2,
                             backend=AnswerExchange("rule-multi", multi_answers(PR.layout_paired())),
                             store=scratch_path(spark, "answers"))


def _corrector():
    return AnswerExchange("rule-corrector", corrector_answers(PR.layout_correction()))


def q_correct_pairs(spark, sf_dir):
    return AN.correct_pairs(_pairs(spark, sf_dir), backend=_corrector(), store=scratch_path(spark, "answers"))


def q_is_equal(spark, sf_dir):
    return q_correct_pairs(spark, sf_dir).select("pair_id", "is_equal")


def _stored_corrected(spark, sf_dir):
    work = scratch_path(spark, "loop")
    return loop.correct_and_store(_corpora(spark, sf_dir), corrector=_corrector(), workdir=work)


def q_write_corrected(spark, sf_dir):
    return _stored_corrected(spark, sf_dir)


def q_source_corrected(spark, sf_dir):
    work = scratch_path(spark, "loop")
    loop.correct_and_store(_corpora(spark, sf_dir), corrector=_corrector(), workdir=work)
    return tables.read_corrected(spark, f"{work}/corrected", dataset=DATASET).drop("dataset")


def q_promote_corrected(spark, sf_dir):
    return AN.promote_corrected(_stored_corrected(spark, sf_dir)).select(*PAIR, "dataset")


def q_candidate_counts_by_version(spark, sf_dir):
    """Candidate rows of both corpora before and after correction."""
    table = _stored_corrected(spark, sf_dir)
    cols = [*PAIR, "dataset"]
    both = (table.select(*cols).withColumn("version", F.lit("original"))
            .unionByName(AN.promote_corrected(table).select(*cols).withColumn("version", F.lit("corrected"))))
    return C.candidate_counts(both)


def q_adverb_counts_by_corpus(spark, sf_dir):
    return diagnostics.adverb_counts(_corpora(spark, sf_dir), dataset_col="dataset")


def _stored_annotations(spark, sf_dir):
    work = scratch_path(spark, "annotations")
    pairs = _corpora(spark, sf_dir).withColumn("version", F.lit("original"))
    ann = AN.annotate_categories(pairs, loop.WORKING_CATEGORIES, backend=SINGLE,
                                 store=f"{work}/answers")
    tables.write_annotations(ann, f"{work}/annotations")
    return work


def q_write_annotations(spark, sf_dir):
    work = _stored_annotations(spark, sf_dir)
    return tables.read_annotations(spark, f"{work}/annotations")


def q_source_annotations(spark, sf_dir):
    work = _stored_annotations(spark, sf_dir)
    return tables.read_annotations(spark, f"{work}/annotations", dataset=DATASET, version="original",
                                   category=SINGLE_CATEGORY).select(*PAIR, "error_type")


def _single_annotations(spark, sf_dir):
    return q_annotate_single(spark, sf_dir)


def q_audit_applies(spark, sf_dir):
    return audit.audit_applies(_single_annotations(spark, sf_dir))


def q_audit_unexpected(spark, sf_dir):
    return audit.audit_unexpected(_single_annotations(spark, sf_dir))


def _loop_counts(spark, sf_dir):
    return loop.run_loop(_corpora(spark, sf_dir), detector=SINGLE,
                         corrector=_corrector(), workdir=scratch_path(spark, "loop"))


def q_before_after_counts(spark, sf_dir):
    return audit.before_after(_loop_counts(spark, sf_dir))


def q_source_counts(spark, sf_dir):
    path = scratch_path(spark, "counts-csv")
    tables.write_counts(_loop_counts(spark, sf_dir), path, fmt="csv")
    return tables.read_counts(spark, path, fmt="csv")


def q_chart_data(spark, sf_dir):
    return audit.chart_data(_loop_counts(spark, sf_dir), CHART_CATEGORY, DATASETS)


QUERIES.update({
    "sample_n": q_sample_n,
    "row_index": q_row_index,
    "source_json_pairs": q_source_json_pairs,
    "select_pairs": q_select_pairs,
    "format_categories": q_format_categories,
    "prompt_catalogue": q_prompt_catalogue,
    "prompt_paired": q_prompt_paired,
    "prompt_single": q_prompt_single,
    "prompt_single_unfiltered": q_prompt_single_unfiltered,
    "prompt_correction": _prompt_correction("examples"),
    "prompt_correction_explained": _prompt_correction("examples_explained"),
    "prompt_correction_strict": _prompt_correction("examples_strict"),
    "catalogue_text": q_catalogue_text,
    "source_parquet_pairs": q_source_parquet_pairs,
    "source_json_array_pairs": q_source_json_array_pairs,
    "sample_n_repeated_ids": q_sample_n_repeated_ids,
    "candidate_counts_by_version": q_candidate_counts_by_version,
    "adverb_counts_by_corpus": q_adverb_counts_by_corpus,
    "model_call": q_model_call,
    "pending_requests": q_pending_requests,
    "import_answers": q_import_answers,
    "request_status": q_request_status,
    "annotate_single": q_annotate_single,
    "annotate_single_sample": q_annotate_single_sample,
    "annotate_multi": q_annotate_multi,
    "annotate_multi_paired": q_annotate_multi_paired,
    "correct_pairs": q_correct_pairs,
    "is_equal": q_is_equal,
    "write_corrected": q_write_corrected,
    "source_corrected": q_source_corrected,
    "promote_corrected": q_promote_corrected,
    "write_annotations": q_write_annotations,
    "source_annotations": q_source_annotations,
    "audit_applies": q_audit_applies,
    "audit_unexpected": q_audit_unexpected,
    "before_after_counts": q_before_after_counts,
    "source_counts": q_source_counts,
    "chart_data": q_chart_data,
})


# --- formula structure --------------------------------------------------------------


def _formulas(spark, sf_dir):
    return load_structure_pairs(spark, sf_dir)


def _as_json(df: DataFrame, col: str) -> DataFrame:
    return df.withColumn(col, F.to_json(col))


def q_free_variables(spark, sf_dir):
    """Formulas with variables that no quantifier binds."""
    return _as_json(structure.free_variables(_formulas(spark, sf_dir)), "free_variables")


def q_bracket_faults(spark, sf_dir):
    return structure.bracket_faults(_formulas(spark, sf_dir))


def q_cand_missing_parentheses(spark, sf_dir):
    return _as_json(structure.missing_parentheses_candidates(_formulas(spark, sf_dir)), "mixed_connectives")


def q_cand_predicate_nesting(spark, sf_dir):
    return _as_json(structure.predicate_nesting_candidates(_formulas(spark, sf_dir)), "nested")


def q_negation_scopes(spark, sf_dir):
    """What each negation covers, and whether it denies the whole formula."""
    return _as_json(structure.negation_scopes(_formulas(spark, sf_dir)), "scopes")


def q_both_sides_denied(spark, sf_dir):
    return _as_json(structure.both_sides_denied(_formulas(spark, sf_dir)), "denied_arrows")


def q_structural_flags(spark, sf_dir):
    df = structure.structural_flags(_formulas(spark, sf_dir)).where("structural IS NOT NULL")
    return _as_json(df, "structural").select("pair_id", "structural")


def q_structural_counts(spark, sf_dir):
    """Formulas per structural category."""
    df = structure.structural_flags(_formulas(spark, sf_dir))
    return df.select(F.explode("structural").alias("category")).groupBy("category").agg(F.count("*").alias("n"))


QUERIES.update({
    "free_variables": q_free_variables,
    "bracket_faults": q_bracket_faults,
    "cand_missing_parentheses": q_cand_missing_parentheses,
    "cand_predicate_nesting": q_cand_predicate_nesting,
    "negation_scopes": q_negation_scopes,
    "both_sides_denied": q_both_sides_denied,
    "structural_flags": q_structural_flags,
    "structural_counts": q_structural_counts,
})


# --- files without line ends between records -------------------------------------------

#: Split size of these reads, so that files of every scale factor are cut.
SPLIT_BYTES = 1 << 18
#: Signs that mean something else inside quotes, put into every third sentence.
ODD_SIGNS = ' }],{"\\ \n,""'


def _odd_pairs(spark, sf_dir):
    odd = F.when(F.col("pair_id") % 3 == 0, F.concat("nl_sentence", F.lit(ODD_SIGNS))).otherwise(F.col("nl_sentence"))
    return _pairs(spark, sf_dir).withColumn("nl_sentence", odd)


def q_source_json_array_split(spark, sf_dir):
    """JSON array files read by byte ranges."""
    path = scratch_path(spark, "pairs-json-split")
    record = F.struct("pair_id", F.col("nl_sentence").alias("NL"), F.col("fol_expression").alias("FOL"))
    files = _odd_pairs(spark, sf_dir).groupBy(F.expr("pair_id div 500000")).agg(F.to_json(F.collect_list(record)).alias("value"))
    files.select("value").write.option("maxRecordsPerFile", 1).text(path)
    return read_json_array_pairs(spark, path, split_bytes=SPLIT_BYTES)


def q_source_csv_quoted_split(spark, sf_dir):
    """CSV files with raw line breaks in quotes read by byte ranges."""
    path = scratch_path(spark, "pairs-csv-split")
    _odd_pairs(spark, sf_dir).write.options(**CSV_OPTIONS).csv(path)
    return read_quoted_csv_pairs(spark, path, split_bytes=SPLIT_BYTES)


QUERIES.update({
    "source_json_array_split": q_source_json_array_split,
    "source_csv_quoted_split": q_source_csv_quoted_split,
})


# --- glue by position, word lists as tables, samples by group ----------------------------


def q_glue_by_position(spark, sf_dir):
    """Two stored tables with files of unequal length, put side by side by row position."""
    left, right = scratch_path(spark, "glue-left"), scratch_path(spark, "glue-right")
    rows = _pairs(spark, sf_dir)
    rows.repartitionByRange(5, "pair_id").sortWithinPartitions("pair_id").write.option("maxRecordsPerFile", 3001).parquet(left)
    checks = rows.select("pair_id", F.md5(F.concat_ws("#", F.col("pair_id").cast("string"), "fol_expression")).alias("digest"))
    checks.repartitionByRange(3, "pair_id").sortWithinPartitions("pair_id").select("digest").write.option("maxRecordsPerFile", 1999).parquet(right)
    return glue(spark, left, right, position="position")


def _word_table(spark, sf_dir):
    """Entries of one to three words from ``part``, and the fixed adverbs."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    names = part.select(F.lower(F.split_part("p_name", F.lit(" "), F.lit(1))).alias("entry"))
    ends = part.select(F.concat(F.lit("Is  "), F.lower("p_name"), F.lit(" exactly")).alias("entry"))
    plural = part.select(F.concat(F.lit("No "), F.split_part("p_name", F.lit(" "), F.lit(2)), F.lit(" is")).alias("entry"))
    adverbs = spark.range(1).select(F.explode(F.array(*[F.lit(w) for w in ALL_ADVERBS])).alias("entry"))
    return names.unionByName(ends).unionByName(plural).unionByName(adverbs)


def _word_matches(trie_bytes):
    def run(spark, sf_dir):
        return _as_json(wordlists.word_matches(_pairs(spark, sf_dir), _word_table(spark, sf_dir), trie_bytes=trie_bytes), "hits")
    return run


def q_remove_word_matches(spark, sf_dir):
    return wordlists.remove_word_matches(_pairs(spark, sf_dir), _word_table(spark, sf_dir))


GROUP_SAMPLE_N = 40


def _sample_per_category(n):
    def run(spark, sf_dir):
        rows = _corpora(spark, sf_dir).withColumn("category", F.explode(C.category_array()))
        return sample_per_group(rows, n, ["dataset", "category"], seed=SINGLE_SAMPLE_SEED).select("dataset", "category", "pair_id")
    return run


QUERIES.update({
    "glue_by_position": q_glue_by_position,
    "word_list_matches": _word_matches(wordlists.TRIE_BYTES),
    "word_list_matches_joined": _word_matches(0),
    "word_list_removed": q_remove_word_matches,
    "sample_per_category": _sample_per_category(GROUP_SAMPLE_N),
    "sample_per_category_large": _sample_per_category(1200),
})


# --- versions of stored tables, counts from changes ----------------------------------------

SNAPSHOT_SCHEMA = "pair_id BIGINT, fol_expression STRING, dataset STRING"


def _snapshots(spark, sf_dir):
    """Two versions of the two corpora, and a write that never committed."""
    table = Snapshots(spark, scratch_path(spark, "snapshots"), SNAPSHOT_SCHEMA, ["dataset"])
    both = _corpora(spark, sf_dir).select("pair_id", "fol_expression", "dataset")
    table.commit(both)
    table.commit(both.where((F.col("dataset") == DATASET) & F.col("fol_expression").contains("→")))
    table.stage(both.withColumn("fol_expression", F.lit("lost")))
    return table


def _snapshot(version):
    def run(spark, sf_dir):
        return _snapshots(spark, sf_dir).read(version)
    return run


def q_candidate_counts_delta(spark, sf_dir):
    """Candidate counts after the corrections, from stored counts and the changed rows."""
    table = _stored_corrected(spark, sf_dir)
    path = scratch_path(spark, "counts-original")
    C.candidate_counts(table, keys=("dataset",)).write.parquet(path)
    return deltas.merge_counts(spark.read.parquet(path), deltas.candidate_deltas(table))


QUERIES.update({
    "source_snapshot": _snapshot(None),
    "source_snapshot_older": _snapshot(1),
    "candidate_counts_delta": q_candidate_counts_delta,
})
