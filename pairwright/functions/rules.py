"""Whole-word rewrite rules for individual constants, without a UDF.

A formula is split into alternating word / non-word runs, each run is kept or
rewritten, and the runs are joined again. Rewriting every occurrence of a word
one word at a time gives the same result as this single pass, because a
rewritten word (first letter lowered) is never changed again.

The word set of a row is bound once through a one-element ``transform``:
written inline, Catalyst copies the set expression into the inner lambda and
evaluates the regex again for every run.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pairwright.functions.text import (
    IS_WORD_MIN2,
    NAME_BEFORE_PAREN,
    WORD_BEFORE_PAREN,
    WORD_RUN_MIN2,
    col_of,
    extract_all,
    lower_first,
    word_gap_runs,
)


def _rewrite_with_set(c: Column, word_set: Column, keep, skip_if_empty: bool = False) -> Column:
    """Join the runs of ``c``; a run ``t`` is lowered where ``keep(set, t)`` is false.

    With ``skip_if_empty`` a row whose set is empty is returned as is, without
    splitting it into runs (nothing in it can change).
    """
    runs = word_gap_runs(c)

    def rewrite(s):
        joined = F.array_join(F.transform(runs, lambda t: F.when(keep(s, t), t).otherwise(lower_first(t))), "")
        return F.when(F.size(s) == 0, c).otherwise(joined) if skip_if_empty else joined

    return F.get(F.transform(F.array(word_set), rewrite), 0)


def constant_words(c: str | Column) -> Column:
    """Words of two or more characters left after deleting every ``name(``."""
    stripped = F.regexp_replace(col_of(c), WORD_BEFORE_PAREN, "(")
    return extract_all(stripped, WORD_RUN_MIN2)


def function_names(c: str | Column) -> Column:
    """Every word directly followed (spaces allowed) by ``(``."""
    return extract_all(c, NAME_BEFORE_PAREN)


def lowercase_position_rule(c: str | Column) -> Column:
    """Rule used by the cleaner: words found in argument position are lowered
    everywhere they occur as whole words (a predicate of the same name too)."""
    c = col_of(c)
    return _rewrite_with_set(c, constant_words(c), lambda s, t: ~F.array_contains(s, t), skip_if_empty=True)


def lowercase_name_rule(c: str | Column) -> Column:
    """Rule used by the diagnostic: every word of two or more characters whose
    name is nowhere used as ``name(`` is lowered."""
    c = col_of(c)
    return _rewrite_with_set(
        c,
        function_names(c),
        lambda s, t: F.array_contains(s, t) | ~t.rlike(IS_WORD_MIN2),
    )
