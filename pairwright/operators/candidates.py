"""Candidate filters: one cheap text predicate per error category.

Only rows passing a category's predicate are sent to the model for that
category. ``contains``/``startswith`` reach a parquet scan as pushed filters;
the counting predicates run right after the scan in the same stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairwright.functions.text import count_char

NL = "nl_sentence"
FOL = "fol_expression"

from pairwright.fixed_values import CATEGORY_LABELS, NEITHER_WORD, ONE_LETTER_WORD, PREDICATE_NESTING  # noqa: F401


def overgeneralization(f: Column, s: Column) -> Column:
    return count_char(f, "∀") >= 2


def wrong_binding(f: Column, s: Column) -> Column:
    return f.contains(",")


def free_variable(f: Column, s: Column) -> Column:
    return f.rlike("(?U)" + ONE_LETTER_WORD)


def biconditional(f: Column, s: Column) -> Column:
    return f.contains("↔")


def conjunction(f: Column, s: Column) -> Column:
    return f.contains("∧")


def xor(f: Column, s: Column) -> Column:
    return count_char(f, "⊕") >= 2


def global_negation(f: Column, s: Column) -> Column:
    return f.startswith("¬")


def condition_negation(f: Column, s: Column) -> Column:
    return f.contains("→")


def both_negated(f: Column, s: Column) -> Column:
    return (count_char(f, "¬") >= 2) & f.contains("→")


def neither_nor(f: Column, s: Column) -> Column:
    return s.rlike("(?U)" + NEITHER_WORD)


# short name -> (category label, predicate over (formula, sentence))
PREDICATES: dict[str, tuple[str, Callable[[Column, Column], Column]]] = {
    "overgeneralization": ("overgeneralization", overgeneralization),
    "wrong_binding": ("wrong_variable_binding", wrong_binding),
    "free_variable": ("free_variable_error", free_variable),
    "biconditional": ("biconditional_instead_implication", biconditional),
    "conjunction": ("conjunction_instead_implication", conjunction),
    "xor": ("invalid_xor_usage", xor),
    "global_negation": ("global_negation_error", global_negation),
    "condition_negation": ("missing_condition_negation", condition_negation),
    "both_negated": ("wrong_negation_scope", both_negated),
    "neither_nor": ("neither_nor_translation_error", neither_nor),
}
LABEL_TO_SHORT = {label: short for short, (label, _) in PREDICATES.items()}


def label_of(name: str) -> str:
    """Category label of a short predicate name (labels pass through)."""
    return PREDICATES[name][0] if name in PREDICATES else name


def predicate(name: str, formula: str = FOL, sentence: str = NL) -> Column:
    """The candidate predicate of a short name or a category label."""
    short = LABEL_TO_SHORT.get(name, name)
    return PREDICATES[short][1](F.col(formula), F.col(sentence))


def candidates(df: DataFrame, name: str, formula: str = FOL, sentence: str = NL) -> DataFrame:
    """Rows that are candidates for one category. Categories without a
    prefilter (e.g. ``missing_category``) return every row."""
    if LABEL_TO_SHORT.get(name, name) not in PREDICATES:
        return df
    return df.filter(predicate(name, formula, sentence))


def _filter_op(short: str):
    def op(df: DataFrame, formula: str = FOL, sentence: str = NL) -> DataFrame:
        return candidates(df, short, formula, sentence)
    op.__name__ = f"{short}_candidates"
    op.__doc__ = f"Candidates for ``{PREDICATES[short][0]}``."
    return op


overgeneralization_candidates = _filter_op("overgeneralization")
wrong_binding_candidates = _filter_op("wrong_binding")
free_variable_candidates = _filter_op("free_variable")
biconditional_candidates = _filter_op("biconditional")
conjunction_candidates = _filter_op("conjunction")
xor_candidates = _filter_op("xor")
global_negation_candidates = _filter_op("global_negation")
condition_negation_candidates = _filter_op("condition_negation")
both_negated_candidates = _filter_op("both_negated")
neither_nor_candidates = _filter_op("neither_nor")


def category_array(formula: str = FOL, sentence: str = NL) -> Column:
    """Labels of every category whose predicate holds, in catalogue order.
    A null predicate counts as false here (the row is no candidate)."""
    f, s = F.col(formula), F.col(sentence)
    flagged = [(label, fn) for label in CATEGORY_LABELS
               for short, (lab, fn) in PREDICATES.items() if lab == label]
    return F.array_compact(F.array(*[F.when(fn(f, s), F.lit(label)) for label, fn in flagged]))


def candidate_flags(df: DataFrame, formula: str = FOL, sentence: str = NL,
                    out: str = "categories") -> DataFrame:
    """All ten predicates in one scan, as an array of category labels."""
    return df.withColumn(out, category_array(formula, sentence))


def candidate_counts(df: DataFrame, keys=("dataset", "version"), formula: str = FOL,
                     sentence: str = NL) -> DataFrame:
    """Candidate rows per category and key (e.g. corpus and version).

    The explode is narrow and the count combines map-side, so a category or
    corpus holding most rows costs one partial row per task in the shuffle.
    """
    keys = [k for k in keys if k in df.columns]
    return (df.select(*keys, F.explode(category_array(formula, sentence)).alias("category"))
              .groupBy(*keys, "category")
              .agg(F.count(F.lit(1)).alias("n")))
