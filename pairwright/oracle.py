"""DuckDB SQL forms of the registered queries, used as the correctness oracle.

DuckDB's regex engine (RE2) is ASCII for ``\\w \\s``; the forms below spell
the Unicode classes out: a word character is ``[\\p{L}\\p{M}\\p{N}_]``.
"""

from __future__ import annotations

from pairwright.functions.text import ADVERB_GROUPS, ALL_ADVERBS, STRIP_CHARS
from pairwright.operators.candidates import CATEGORY_LABELS, PREDICATES
from pairwright.oracle_structure import structure_queries
from pairwright.sources.fixture import TEMPLATES

W = r"[\p{L}\p{M}\p{N}_]"
NW = r"[^\p{L}\p{M}\p{N}_]"
NS = r"[^\s\p{Z}]+"
SP = r"[\s\p{Z}]"


def q(s: str | None) -> str:
    """SQL string literal."""
    if s is None:
        return "NULL::VARCHAR"
    return "'" + s.replace("'", "''") + "'"


def str_list(items) -> str:
    return "[" + ", ".join(q(x) for x in items) + "]::VARCHAR[]"


def pairs_cte(name: str = "pairs", templates=None) -> str:
    rows = ", ".join(f"{{'k': {k}, 'n': {q(n)}, 'f': {q(f)}}}" for k, n, f in templates or TEMPLATES)

    def cap(e):
        return f"concat(upper(substr({e},1,1)), substr({e},2))"

    def fill(e):
        return f"replace(replace(replace({e},'{{A}}',a),'{{B}}',b),'{{C}}',c)"

    return f"""{name} AS (
  SELECT (p_partkey*100 + t.k)::BIGINT AS pair_id,
         {fill('t.n')} AS nl_sentence,
         {fill('t.f')} AS fol_expression
  FROM (SELECT p_partkey,
               {cap("split_part(p_name,' ',1)")} AS a,
               {cap("split_part(p_name,' ',2)")} AS b,
               concat(substr(p_type,1,1), lower(substr(p_type,2))) AS c,
               unnest([{rows}]) AS t
        FROM part) p
)"""


def with_pairs(body: str, *ctes: str) -> str:
    parts = [pairs_cte()] + list(ctes)
    return "WITH " + ",\n".join(parts) + "\n" + body


# --- expression builders ----------------------------------------------------

def lower_first(t: str) -> str:
    return f"(lower(substr({t},1,1)) || substr({t},2))"


def rule_position(e: str) -> str:
    words = f"regexp_extract_all(regexp_replace({e}, '{W}+{SP}*\\(', '(', 'g'), '{W}{{2,}}')"
    runs = f"regexp_extract_all({e}, '{W}+|{NW}+')"
    return (f"array_to_string(list_transform({runs}, lambda t: CASE WHEN list_contains({words}, t) "
            f"THEN {lower_first('t')} ELSE t END), '')")


def rule_name(e: str) -> str:
    names = f"regexp_extract_all({e}, '({W}+){SP}*\\(', 1)"
    runs = f"regexp_extract_all({e}, '{W}+|{NW}+')"
    return (f"array_to_string(list_transform({runs}, lambda t: CASE WHEN regexp_full_match(t, '{W}{{2,}}') "
            f"AND NOT list_contains({names}, t) THEN {lower_first('t')} ELSE t END), '')")


def strip(e: str) -> str:
    return f"translate({e}, {q(STRIP_CHARS)}, '')"


def lower_tokens(e: str) -> str:
    return f"regexp_extract_all(lower({e}), '{NS}')"


def has_adverb(e: str, words=ALL_ADVERBS) -> str:
    return f"list_has_any({lower_tokens(e)}, {str_list(words)})"


def count_char(e: str, ch: str) -> str:
    return f"(length({e}) - length(replace({e}, {q(ch)}, '')))"


PRED_SQL = {
    "overgeneralization": lambda f, s: f"{count_char(f, '∀')} >= 2",
    "wrong_binding": lambda f, s: f"contains({f}, ',')",
    "free_variable": lambda f, s: f"len(list_filter(regexp_extract_all({f}, '{W}+'), lambda t: regexp_full_match(t, '[a-z]'))) > 0",
    "biconditional": lambda f, s: f"contains({f}, '↔')",
    "conjunction": lambda f, s: f"contains({f}, '∧')",
    "xor": lambda f, s: f"{count_char(f, '⊕')} >= 2",
    "global_negation": lambda f, s: f"starts_with({f}, '¬')",
    "condition_negation": lambda f, s: f"contains({f}, '→')",
    "both_negated": lambda f, s: f"({count_char(f, '¬')} >= 2 AND contains({f}, '→'))",
    "neither_nor": lambda f, s: f"list_contains(regexp_extract_all(lower({s}), '{W}+'), 'neither')",
}
LABEL_SHORT = {label: short for short, (label, _) in PREDICATES.items()}


def pred(name: str, f: str = "fol_expression", s: str = "nl_sentence") -> str:
    return "(" + PRED_SQL[LABEL_SHORT.get(name, name)](f, s) + ")"


def category_array(f: str = "fol_expression", s: str = "nl_sentence") -> str:
    whens = ", ".join(f"CASE WHEN {pred(label, f, s)} THEN {q(label)} END"
                      for label in CATEGORY_LABELS if label in LABEL_SHORT)
    return f"list_filter([{whens}], lambda x: x IS NOT NULL)"


def cleaned(src: str = "pairs") -> str:
    """T1 -> T2 -> T3 over a pair relation."""
    return (f"SELECT pair_id, nl_sentence, {rule_position(strip('fol_expression'))} AS fol_expression "
            f"FROM {src} WHERE NOT {has_adverb('nl_sentence')}")


def adverb_group_map() -> str:
    return "MAP {" + ", ".join(f"{q(w)}: {q(g)}" for g, ws in ADVERB_GROUPS.items() for w in ws) + "}"


# --- registered query forms ---------------------------------------------------

P = "pair_id, nl_sentence, fol_expression"


def _docs(body: str) -> str:
    return body.replace("{docs}", "documents")


def adverb_cases() -> str:
    return " ".join(f"WHEN word IN ({', '.join(q(w) for w in ws)}) THEN {q(g)}" for g, ws in ADVERB_GROUPS.items())


def _adverb_counts_sql() -> str:
    cases = adverb_cases()
    return with_pairs(
        "SELECT adverb_group, word, count(*)::BIGINT AS n_rows FROM grp GROUP BY adverb_group, word\n"
        "UNION ALL\n"
        "SELECT adverb_group, NULL::VARCHAR AS word, count(DISTINCT pair_id)::BIGINT AS n_rows FROM grp GROUP BY adverb_group",
        f"hits AS (SELECT pair_id, unnest(list_distinct(list_filter({lower_tokens('nl_sentence')}, "
        f"lambda t: list_contains({str_list(ALL_ADVERBS)}, t)))) AS word FROM pairs)",
        f"grp AS (SELECT pair_id, word, CASE {cases} END AS adverb_group FROM hits)",
    )


def word_list_queries() -> dict[str, str]:
    """Entries joined to all runs of as many tokens as entries have."""
    ctes = (
        "words AS (SELECT lower(split_part(p_name, ' ', 1)) AS e FROM part UNION SELECT 'is ' || lower(p_name) || ' exactly' FROM part "
        "UNION SELECT lower('No ' || split_part(p_name, ' ', 2) || ' is') FROM part UNION SELECT unnest(" + str_list(ALL_ADVERBS) + "))",
        f"toks AS (SELECT pair_id, {lower_tokens('nl_sentence')} AS t FROM pairs WHERE nl_sentence IS NOT NULL)",
        "grams AS (SELECT DISTINCT pair_id, array_to_string(t[i:i + k - 1], ' ') AS e FROM "
        "(SELECT pair_id, t, k, unnest(range(1, len(t) - k + 2)) AS i FROM toks, range(1, 6) r(k)))",
        "found AS (SELECT pair_id, list(e ORDER BY e) AS hits FROM grams JOIN words USING (e) GROUP BY pair_id)",
    )
    matches = with_pairs(f"SELECT {P}, to_json(hits)::VARCHAR AS hits FROM pairs JOIN found USING (pair_id)", *ctes)
    removed = with_pairs(f"SELECT {P} FROM pairs WHERE nl_sentence IS NOT NULL AND pair_id NOT IN (SELECT pair_id FROM found)", *ctes)
    return {"word_list_matches": matches, "word_list_matches_joined": matches, "word_list_removed": removed}


def oracle_queries() -> dict[str, str]:
    from pairwright.functions.text import FREQUENCY_ADVERBS, PUNCTUATION_CLASS, QUOTED_SPAN_PATTERN

    out = {
        "source_pairs": with_pairs(f"SELECT {P} FROM pairs"),
        "strip_special_chars": with_pairs(f"SELECT pair_id, nl_sentence, {strip('fol_expression')} AS fol_expression FROM pairs"),
        "strip_special_chars_documents": f"SELECT doc_id, {strip('text')} AS text FROM documents",
        "lowercase_constants": with_pairs(f"SELECT pair_id, nl_sentence, {rule_position('fol_expression')} AS fol_expression FROM pairs"),
        "remove_adverb_sentences": with_pairs(f"SELECT {P} FROM pairs WHERE NOT {has_adverb('nl_sentence')}"),
        "clean_pairs": with_pairs(cleaned()),
        "not_terminated": with_pairs(f"SELECT {P} FROM pairs WHERE NOT ends_with(nl_sentence, '.')"),
        "not_terminated_documents": "SELECT doc_id FROM documents WHERE NOT ends_with(text, '.')",
        "lowercase_diff": with_pairs(
            f"SELECT * FROM (SELECT {P}, {rule_name('fol_expression')} AS fol_modified FROM pairs) "
            "WHERE fol_expression <> fol_modified"),
        "quoted_terms": with_pairs(
            f"SELECT {P}, to_json(quoted)::VARCHAR AS quoted_words FROM "
            f"(SELECT {P}, regexp_extract_all(fol_expression, {q(QUOTED_SPAN_PATTERN)}) AS quoted FROM pairs) "
            "WHERE len(quoted) > 0"),
        "quoted_terms_documents": (
            "SELECT doc_id, to_json(quoted)::VARCHAR AS quoted_words FROM "
            f"(SELECT doc_id, regexp_extract_all(text, {q(QUOTED_SPAN_PATTERN)}) AS quoted FROM documents) "
            "WHERE len(quoted) > 0"),
        "punctuated_tokens": with_pairs(
            f"SELECT {P}, to_json(pw)::VARCHAR AS punctuated_words FROM "
            f"(SELECT {P}, list_filter(regexp_extract_all(fol_expression, '{NS}'), "
            f"lambda t: regexp_matches(t, {q(PUNCTUATION_CLASS)})) AS pw FROM pairs) WHERE len(pw) > 0"),
        "punctuated_tokens_documents": (
            "SELECT doc_id, to_json(pw)::VARCHAR AS punctuated_words FROM "
            f"(SELECT doc_id, list_filter(regexp_extract_all(text, '{NS}'), "
            f"lambda t: regexp_matches(t, {q(PUNCTUATION_CLASS)})) AS pw FROM documents) WHERE len(pw) > 0"),
        "adverb_matches": with_pairs(f"SELECT {P} FROM pairs WHERE {has_adverb('nl_sentence', FREQUENCY_ADVERBS)}"),
        "adverb_counts": _adverb_counts_sql(),
        "candidate_flags": with_pairs(f"SELECT {P}, to_json({category_array()})::VARCHAR AS categories FROM pairs"),
        "candidate_counts": with_pairs(
            f"SELECT 'parts' AS dataset, 'original' AS version, category, count(*)::BIGINT AS n "
            f"FROM (SELECT unnest({category_array()}) AS category FROM pairs) GROUP BY category"),
    }
    for short in PRED_SQL:
        out[f"cand_{short}"] = with_pairs(f"SELECT {P} FROM pairs WHERE {pred(short)}")
    odd = with_pairs("SELECT pair_id, CASE WHEN pair_id % 3 = 0 THEN nl_sentence || ' }],{\"\\ ' || chr(10) || ',\"\"' ELSE nl_sentence END AS nl_sentence, fol_expression FROM pairs")
    out |= {"source_json_array_split": odd, "source_csv_quoted_split": odd}
    out["glue_by_position"] = with_pairs(
        f"SELECT (row_number() OVER (ORDER BY pair_id) - 1)::BIGINT AS position, {P}, md5(concat_ws('#', pair_id::VARCHAR, fol_expression)) AS digest FROM pairs")
    out |= word_list_queries()
    from pairwright.plans import queries as QQ
    for key, n in (("sample_per_category", QQ.GROUP_SAMPLE_N), ("sample_per_category_large", 1200)):
        out[key] = with_pairs(
            f"SELECT dataset, category, pair_id FROM flagged QUALIFY row_number() OVER (PARTITION BY dataset, category "
            f"ORDER BY md5(pair_id::VARCHAR || '#{QQ.SINGLE_SAMPLE_SEED}'), pair_id) <= {n}",
            f"corpora AS (SELECT {P}, {q(QQ.DATASET)} AS dataset FROM pairs UNION ALL SELECT *, {q(QQ.CLEANED_DATASET)} AS dataset FROM ({cleaned()}))",
            f"flagged AS (SELECT dataset, pair_id, unnest({category_array()}) AS category FROM corpora)")
    out.update(oracle_model_queries())
    out.update(structure_queries(pairs_cte))
    return out


# --- prompts and the model job ---------------------------------------------------

# The expected prompt texts, written out here on their own: only the catalogue's
# entries (data) are shared with the code under test.

def _split(text: str) -> tuple[str, str, str]:
    """Text before the sentence, between it and the formula, and after."""
    before, rest = text.split("<S>")
    middle, after = rest.split("<F>")
    return before, middle, after


def _block(c) -> str:
    why = f"  Explanation: {c['negative'][2]}\n" if len(c["negative"]) > 2 else ""
    return (f"Error label: {c['label']}\nInstruction: {c['instruction']}\n"
            f"Positive example (correct):\n  Sentence: {c['positive'][0]}\n  Formula: {c['positive'][1]}\n"
            f"Negative example (error):\n  Sentence: {c['negative'][0]}\n  Formula: {c['negative'][1]}\n{why}\n")


def text_catalogue() -> str:
    from pairwright.plans import catalogue as cat
    shots = "".join(f"Sentence: {c['negative'][0]}\nIncorrect Translation: {c['negative'][1]}\n"
                    f"Correct Translation: {c['positive'][1]}\nError category: {c['label']}\n\n" for c in cat.CATALOGUE[:13])
    lines = "\n".join(f"- {c['label']}: {c['description']}" for c in cat.CATALOGUE[:13])
    return f"{shots}Sentence: <S>\nTranslation: <F>\n\nLabels to choose from, with what each one means:\n\n{lines}\n\n"


def text_paired() -> str:
    from pairwright.plans import catalogue as cat
    return ("Catalogue. Every entry shows one sentence twice: the first formula states it, the second has the error.\n\n"
            + "".join(_block(c) for c in cat.CATALOGUE[:13])
            + "------------------------------\nSentence:\n<S>\n\nFormula:\n<F>\n\n")


def text_single(label: str) -> str:
    from pairwright.plans import catalogue as cat
    c = next(c for c in cat.CATALOGUE if c["label"] == label)
    return (f"Error category: {c['description']} {c['instruction']}\n\nTwo answered pairs, then the pair to judge:\n\n"
            f"Sentence: {c['positive'][0]}\nFOL: {c['positive'][1]}\nAnswer: error category does not apply\n\n"
            f"Sentence: {c['negative'][0]}\nFOL: {c['negative'][1]}\nAnswer: error category does apply\n\n"
            "Example:\nSentence: <S>\nFOL: <F>\nAnswer:")


def text_correction(explained: bool = False) -> str:
    from pairwright.plans import catalogue as cat
    out = "Repaired formulas, one error each. The last entry is open.\n\n"
    for k, c in enumerate(cat.CATALOGUE[:13], 1):
        out += f"Example {k}:\nSentence: {c['negative'][0]}\nTranslation: {c['negative'][1]}\nCorrected Translation: {c['positive'][1]}\n"
        out += f"Explanation: {c['negative'][2]}\n" if explained and len(c["negative"]) > 2 else ""
        out += "\n"
    return out + "Example 14:\nSentence: <S>\nTranslation: <F>\nCorrected Translation:"


def render(text: str, s: str = "nl_sentence", f: str = "fol_expression") -> str:
    before, middle, after = _split(text)
    return f"({q(before)} || {s} || {q(middle)} || {f} || {q(after)})"


def digest_sql(system: str, text: str) -> str:
    import hashlib
    return hashlib.sha256("\u0001".join([system, *_split(text)]).encode()).hexdigest()


def key_sql(model: str, digest: str, *inputs: str) -> str:
    parts = " || ".join(f"chr(1) || length({c})::VARCHAR || chr(1) || {c}" for c in inputs)
    return f"sha256({q(model)} || chr(1) || {q(digest)} || {parts})"


def strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^{SP}+|{SP}+$', '', 'g')"


def single_rule(prompt: str) -> str:
    from pairwright.plans.catalogue import ANSWER_APPLIES, ANSWER_NOT_APPLIES, NO_LABEL
    d = f"substr(md5({prompt}), 1, 1)"
    return (f"CASE WHEN {prompt} IS NULL THEN NULL "
            f"WHEN {d} IN ('0','1','2','3','4','5','6','7') THEN {q(ANSWER_APPLIES)} "
            f"WHEN {d} IN ('8','9','a','b','c','d') THEN {q(ANSWER_NOT_APPLIES)} "
            f"WHEN {d} = 'e' THEN {q(ANSWER_APPLIES + '.')} ELSE {q(NO_LABEL)} END")


def multi_rule(prompt: str) -> str:
    cats = category_array()
    return (f"CASE WHEN {prompt} IS NULL THEN NULL WHEN len({cats}) = 0 THEN '[\"none\"]' "
            f"ELSE to_json({cats})::VARCHAR END")


def corrector_rule(prompt: str) -> str:
    return f"CASE WHEN {prompt} IS NULL THEN NULL ELSE replace(fol_expression, '∀y', '∃y') END"


def sample_sql(src: str, n: int, seed: int) -> str:
    return f"SELECT * FROM {src} ORDER BY md5(pair_id::VARCHAR || '#{seed}'), pair_id LIMIT {n}"


def single_prompt_sql(category: str = "category") -> str:
    from pairwright.plans import catalogue as cat
    whens = " ".join(f"WHEN {q(c['label'])} THEN {q(_split(text_single(c['label']))[0])}" for c in cat.CATALOGUE)
    _, middle, after = _split(text_single("missing_category"))
    return f"((CASE {category} {whens} END) || nl_sentence || {q(middle)} || fol_expression || {q(after)})"


def flagged_working(categories) -> str:
    whens = ", ".join(f"CASE WHEN {pred(c)} THEN {q(c)} END" for c in categories)
    return f"list_filter([{whens}], lambda x: x IS NOT NULL)"


def oracle_model_queries() -> dict[str, str]:
    from pairwright.plans import catalogue as cat
    from pairwright.plans import loop
    from pairwright.plans import prompts as PR
    from pairwright.plans import queries as QQ

    single = text_single(QQ.SINGLE_CATEGORY)
    single_key = key_sql('rule-single', digest_sql(PR.SYSTEM_SINGLE, single), 'nl_sentence', 'fol_expression')
    single_ann = (f"SELECT {P}, {strip_sql(single_rule(render(single)))} AS error_type "
                  f"FROM pairs WHERE {pred(QQ.SINGLE_CATEGORY)}")
    corr = text_correction()
    corrected = (f"SELECT {P}, fol_corrected, fol_expression = fol_corrected AS is_equal FROM "
                 f"(SELECT *, {strip_sql(corrector_rule(render(corr)))} AS fol_corrected FROM pairs)")
    corpora = (f"corpora AS (SELECT {P}, {q(QQ.DATASET)} AS dataset FROM pairs UNION ALL "
               f"SELECT *, {q(QQ.CLEANED_DATASET)} AS dataset FROM ({cleaned()}))")
    corrected_corpora = (f"SELECT {P}, dataset, fol_corrected, fol_expression = fol_corrected AS is_equal FROM "
                         f"(SELECT *, {strip_sql(corrector_rule(render(corr)))} AS fol_corrected FROM corpora)")
    working = loop.WORKING_CATEGORIES
    detect = (f"SELECT *, {strip_sql(single_rule(single_prompt_sql()))} AS error_type FROM "
              f"(SELECT *, unnest({flagged_working(working)}) AS category FROM both_versions)")
    loop_ctes = (
        corpora,
        f"corrected AS ({corrected_corpora})",
        "both_versions AS (SELECT pair_id, nl_sentence, fol_expression, dataset, 'original' AS version FROM corpora "
        "UNION ALL SELECT pair_id, nl_sentence, fol_corrected AS fol_expression, dataset, 'corrected' AS version "
        "FROM corrected)",
        f"detected AS ({detect})",
        f"counts AS (SELECT category, dataset, version, count(*)::BIGINT AS n FROM detected "
        f"WHERE error_type = {q(cat.ANSWER_APPLIES)} GROUP BY category, dataset, version)",
    )
    multi = (lambda text: with_pairs(
        f"SELECT {P}, {strip_sql(multi_rule(render(text)))} AS error_type FROM sampled",
        f"sampled AS ({sample_sql('pairs', QQ.MULTI_N, QQ.SAMPLE_SEED)})"))
    pre_ann = (f"SELECT {P}, dataset, 'original' AS version, category, "
               f"{strip_sql(single_rule(single_prompt_sql()))} AS error_type FROM "
               f"(SELECT *, unnest({flagged_working(working)}) AS category FROM corpora)")
    return {
        "sample_n": with_pairs(f"SELECT {P} FROM ({sample_sql('pairs', QQ.SAMPLE_N, QQ.SAMPLE_SEED)})"),
        "row_index": with_pairs(f"SELECT row_number() OVER (ORDER BY pair_id)::BIGINT AS row, {P} FROM pairs"),
        "source_json_pairs": with_pairs(f"SELECT {P} FROM pairs"),
        "select_pairs": with_pairs(f"SELECT {P} FROM pairs"),
        "format_categories": with_pairs(
            "SELECT pair_id, array_to_string(list_transform(" + category_array() + ", lambda c: CASE c "
            + " ".join(f"WHEN {q(c['label'])} THEN {q(_block(c))}" for c in cat.entries())
            + " ELSE '' END), '') AS categories_text FROM pairs"),
        "prompt_catalogue": with_pairs(f"SELECT pair_id, {render(text_catalogue())} AS prompt FROM pairs"),
        "prompt_paired": with_pairs(f"SELECT pair_id, {render(text_paired())} AS prompt FROM pairs"),
        "prompt_single": with_pairs(
            f"SELECT pair_id, category, {single_prompt_sql()} AS prompt FROM "
            f"(SELECT *, unnest({category_array()}) AS category FROM pairs)"),
        "prompt_correction": with_pairs(f"SELECT pair_id, {render(corr)} AS prompt FROM pairs"),
        "model_call": with_pairs(
            f"SELECT DISTINCT {single_key} AS key, "
            f"{strip_sql(single_rule('prompt'))} AS answer, 'ok' AS status FROM "
            f"(SELECT nl_sentence, fol_expression, {render(single)} AS prompt FROM pairs "
            f"WHERE {pred(QQ.SINGLE_CATEGORY)}) WHERE prompt IS NOT NULL"),
        "annotate_single": with_pairs(single_ann),
        "pending_requests": with_pairs(
            f"SELECT DISTINCT {single_key} AS key, {render(single)} AS prompt FROM pairs "
            f"WHERE {pred(QQ.SINGLE_CATEGORY)} AND nl_sentence IS NOT NULL AND fol_expression IS NOT NULL"),
        "import_answers": with_pairs(
            f"SELECT {P}, CASE WHEN {single_key} >= '1' AND {single_key} < '8' THEN {strip_sql(single_rule(render(single)))} END AS error_type "
            f"FROM pairs WHERE {pred(QQ.SINGLE_CATEGORY)}"),
        "request_status": with_pairs(
            "SELECT CASE WHEN key < '1' THEN 'failed' WHEN key < '8' THEN 'ok' ELSE 'pending' END AS status, count(*)::BIGINT AS n "
            f"FROM (SELECT DISTINCT {single_key} AS key FROM pairs WHERE {pred(QQ.SINGLE_CATEGORY)}) WHERE key IS NOT NULL GROUP BY 1"),
        "source_parquet_pairs": with_pairs(f"SELECT {P} FROM pairs"),
        "source_json_array_pairs": with_pairs(f"SELECT {P} FROM pairs"),
        "sample_n_repeated_ids": (
            f"SELECT coalesce(pair_id::VARCHAR, 'none') AS sampled_id FROM (SELECT CASE WHEN doc_id % 10 = 0 THEN NULL ELSE doc_id // 3 END AS pair_id FROM documents) "
            f"ORDER BY md5(coalesce(pair_id::VARCHAR, '') || '#{QQ.SAMPLE_SEED}'), pair_id LIMIT (SELECT count(*) - 1 FROM documents)"),
        "prompt_single_unfiltered": with_pairs(
            f"SELECT pair_id, category, {single_prompt_sql()} AS prompt FROM "
            f"(SELECT *, unnest({str_list(QQ.UNFILTERED)}) AS category FROM pairs)"),
        "prompt_correction_explained": with_pairs(f"SELECT pair_id, {render(text_correction(True))} AS prompt FROM pairs"),
        "prompt_correction_strict": with_pairs(f"SELECT pair_id, {render(text_correction())} AS prompt FROM pairs"),
        "catalogue_text": with_pairs(
            "SELECT pair_id, array_to_string(list_transform(cats, lambda c: CASE c "
            + " ".join(f"WHEN {q(c['label'])} THEN {q(_block(c))}" for c in cat.entries())
            + f" ELSE '' END), '') AS categories_text FROM (SELECT pair_id, {category_array()} AS cats FROM pairs) WHERE len(cats) > 0"),
        "candidate_counts_by_version": with_pairs(
            f"SELECT dataset, version, category, count(*)::BIGINT AS n FROM "
            f"(SELECT dataset, version, unnest({category_array()}) AS category FROM both_versions) GROUP BY ALL", *loop_ctes[:3]),
        "adverb_counts_by_corpus": with_pairs(
            "SELECT dataset, adverb_group, word, count(*)::BIGINT AS n_rows FROM grp GROUP BY ALL\n"
            "UNION ALL\n"
            "SELECT dataset, adverb_group, NULL::VARCHAR AS word, count(DISTINCT pair_id)::BIGINT AS n_rows FROM grp GROUP BY dataset, adverb_group",
            corpora,
            f"hits AS (SELECT dataset, pair_id, unnest(list_distinct(list_filter({lower_tokens('nl_sentence')}, "
            f"lambda t: list_contains({str_list(ALL_ADVERBS)}, t)))) AS word FROM corpora)",
            f"grp AS (SELECT dataset, pair_id, word, CASE {adverb_cases()} END AS adverb_group FROM hits)"),
        "annotate_single_sample": with_pairs(
            f"SELECT {P}, {strip_sql(single_rule(render(text_single(QQ.SINGLE_SAMPLE_CATEGORY))))} AS error_type "
            f"FROM sampled",
            f"cands AS (SELECT * FROM pairs WHERE {pred(QQ.SINGLE_SAMPLE_CATEGORY)})",
            f"sampled AS ({sample_sql('cands', QQ.SINGLE_SAMPLE_N, QQ.SINGLE_SAMPLE_SEED)})"),
        "annotate_multi": multi(text_catalogue()),
        "annotate_multi_paired": multi(text_paired()),
        "correct_pairs": with_pairs(corrected),
        "is_equal": with_pairs(f"SELECT pair_id, is_equal FROM ({corrected})"),
        "write_corrected": with_pairs(corrected_corpora, corpora),
        "source_corrected": with_pairs(
            f"SELECT {P}, fol_corrected, is_equal FROM ({corrected_corpora}) WHERE dataset = {q(QQ.DATASET)}", corpora),
        "promote_corrected": with_pairs(
            f"SELECT pair_id, nl_sentence, fol_corrected AS fol_expression, dataset FROM ({corrected_corpora})", corpora),
        "write_annotations": with_pairs(pre_ann, corpora),
        "source_annotations": with_pairs(
            f"SELECT {P}, error_type FROM ({pre_ann}) WHERE category = {q(QQ.SINGLE_CATEGORY)} "
            f"AND dataset = {q(QQ.DATASET)}", corpora),
        "audit_applies": with_pairs(f"SELECT * FROM ({single_ann}) WHERE error_type = {q(cat.ANSWER_APPLIES)}"),
        "audit_unexpected": with_pairs(
            f"SELECT * FROM ({single_ann}) WHERE error_type <> {q(cat.ANSWER_APPLIES)} "
            f"AND error_type <> {q(cat.ANSWER_NOT_APPLIES)}"),
        "before_after_counts": with_pairs(
            "SELECT category, dataset, original, corrected, (corrected - original)::BIGINT AS delta, "
            "CASE WHEN original <> 0 THEN round((corrected - original)::DOUBLE * 100.0 / original, 2) END AS pct_change "
            "FROM (SELECT category, dataset, "
            "coalesce(sum(n) FILTER (WHERE version = 'original'), 0)::BIGINT AS original, "
            "coalesce(sum(n) FILTER (WHERE version = 'corrected'), 0)::BIGINT AS corrected "
            "FROM counts GROUP BY category, dataset)", *loop_ctes),
        "source_counts": with_pairs("SELECT category, dataset, version, n FROM counts", *loop_ctes),
        "source_snapshot": with_pairs(
            f"SELECT pair_id, fol_expression, dataset FROM corpora WHERE dataset <> {q(QQ.DATASET)} OR contains(fol_expression, '→')", corpora),
        "source_snapshot_older": with_pairs("SELECT pair_id, fol_expression, dataset FROM corpora", corpora),
        "candidate_counts_delta": with_pairs(
            f"SELECT dataset, category, count(*)::BIGINT AS n FROM (SELECT dataset, unnest({category_array()}) AS category FROM both_versions "
            "WHERE version = 'corrected') GROUP BY ALL", *loop_ctes[:3]),
        "chart_data": with_pairs(
            "SELECT category, dataset, version, n, "
            f"(CASE dataset WHEN {q(QQ.DATASET)} THEN 1 WHEN {q(QQ.CLEANED_DATASET)} THEN 2 END)::BIGINT AS dataset_rank, "
            "(CASE version WHEN 'original' THEN 1 WHEN 'corrected' THEN 2 END)::BIGINT AS version_rank "
            f"FROM counts WHERE category = {q(QQ.CHART_CATEGORY)}", *loop_ctes),
    }
