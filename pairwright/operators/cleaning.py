"""Rule-based cleaning of pair corpora.

``clean_pairs`` chains the three cleaners. The adverb filter reads only the
sentence column, which the other two do not touch, so Catalyst moves it below
them: the plan is scan -> filter -> project in one narrow stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwright.functions.rules import lowercase_position_rule
from pairwright.functions.text import ALL_ADVERBS, STRIP_CHARS, has_token

NL = "nl_sentence"
FOL = "fol_expression"


def strip_special_chars(df: DataFrame, col: str = FOL, chars: str = STRIP_CHARS) -> DataFrame:
    """Delete ``- : ; ! ? " ' ` ´`` from the formula (``Ships-Late`` -> ``ShipsLate``)."""
    return df.withColumn(col, F.translate(F.col(col), chars, ""))


def lowercase_constants(df: DataFrame, col: str = FOL) -> DataFrame:
    """Lower the first letter of individual constants (words in argument position)."""
    return df.withColumn(col, lowercase_position_rule(col))


def has_adverb(col: str = NL, words=ALL_ADVERBS):
    """Any lowercased whitespace token equals a listed word; ``later.`` is not ``later``."""
    return has_token(col, words)


def remove_adverb_sentences(df: DataFrame, col: str = NL, words=ALL_ADVERBS) -> DataFrame:
    """Drop rows whose sentence holds an adverb as a whole token. Null sentences drop too."""
    return df.filter(~has_adverb(col, words))


def clean_pairs(df: DataFrame, sentence: str = NL, formula: str = FOL, words=ALL_ADVERBS) -> DataFrame:
    return (df.transform(strip_special_chars, formula)
              .transform(lowercase_constants, formula)
              .transform(remove_adverb_sentences, sentence, words))
