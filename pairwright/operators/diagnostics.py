"""Diagnostic filters that show what the cleaners would touch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwright.functions.rules import lowercase_name_rule
from pairwright.functions.text import (
    ADVERB_GROUPS,
    PUNCTUATION_CLASS,
    QUOTED_SPAN_PATTERN,
    extract_all,
    has_token,
    lower_tokens,
    whitespace_tokens,
)

NL = "nl_sentence"
FOL = "fol_expression"


def not_terminated(df: DataFrame, col: str = NL) -> DataFrame:
    """Rows whose text does not end with a full stop (null text drops)."""
    return df.filter(~F.col(col).endswith("."))


def lowercase_diff(df: DataFrame, col: str = FOL, out: str = "fol_modified") -> DataFrame:
    """Rows the name-based lowercase rule would change, old and new side by side.

    The rewritten text is bound once: it is the element of a one-entry array
    that is kept where it differs and exploded. A filter on a computed column
    would be moved below the computation and run it a second time.
    """
    changed = F.filter(F.array(lowercase_name_rule(col)), lambda new: new != F.col(col))
    return df.select("*", F.explode(changed).alias(out))


def quoted_terms(df: DataFrame, col: str = FOL, out: str = "quoted_words") -> DataFrame:
    """Rows with at least one quoted span, the spans listed in ``out``."""
    return df.filter(F.col(col).rlike(QUOTED_SPAN_PATTERN)).withColumn(out, extract_all(col, QUOTED_SPAN_PATTERN))


def punctuated_tokens(df: DataFrame, col: str = FOL, out: str = "punctuated_words") -> DataFrame:
    """Rows with a whitespace token holding ``- : ; ! ?``, those tokens in ``out``.

    None of these characters is whitespace, so a text holds such a token
    exactly when it holds the character: that test alone decides.
    """
    tokens = F.filter(whitespace_tokens(col), lambda t: t.rlike(PUNCTUATION_CLASS))
    return df.filter(F.col(col).rlike(PUNCTUATION_CLASS)).withColumn(out, tokens)


def adverb_matches(df: DataFrame, words, col: str = NL) -> DataFrame:
    """Rows whose lowercased whitespace tokens hit one of ``words``."""
    return df.filter(has_token(col, words))


def adverb_counts(df: DataFrame, groups: dict | None = None, col: str = NL,
                  dataset_col: str | None = None) -> DataFrame:
    """Rows per adverb and per adverb group (``word`` null on a group row).

    Each row contributes its distinct hits, so a plain partial/final count is
    exact and a frequent word never gathers its rows in one task. Rows without
    any listed word contribute nothing, so a single regex test drops them
    before any tokenizing.
    """
    groups = groups or ADVERB_GROUPS
    lookup = F.create_map(*[x for g, ws in groups.items() for w in ws for x in (F.lit(w), F.lit(g))])
    words = [w for ws in groups.values() for w in ws]
    hits = F.array_distinct(F.filter(lower_tokens(col), lambda t: F.array_contains(
        F.array(*[F.lit(w) for w in words]), t)))
    per_word = F.transform(hits, lambda w: F.struct(lookup[w].alias("adverb_group"), w.alias("word")))
    per_group = F.transform(
        F.array_distinct(F.transform(hits, lambda w: lookup[w])),
        lambda g: F.struct(g.alias("adverb_group"), F.lit(None).cast("string").alias("word")))
    keys = [dataset_col] if dataset_col else []
    return (df.filter(has_token(col, words))
              .select(*keys, F.explode(F.concat(per_word, per_group)).alias("hit"))
              .groupBy(*keys, "hit.adverb_group", "hit.word")
              .agg(F.count(F.lit(1)).alias("n_rows")))
