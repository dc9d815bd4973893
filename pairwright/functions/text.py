"""Unicode-aware text expressions.

Java regular expressions treat ``\\w \\b \\s \\S`` as ASCII unless the pattern
carries the ``(?U)`` flag, while the rule set we reproduce treats them as
Unicode. Every pattern here that uses one of them therefore starts with
``(?U)``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pairwright import fixed_values as FV
from pairwright.fixed_values import (  # noqa: F401
    DURATION_ADVERBS,
    FREQUENCY_ADVERBS,
    PUNCTUATION_CLASS,
    QUOTED_SPAN_PATTERN,
    STRIP_CHARS,
    TIME_ADVERBS,
)

ADVERB_GROUPS = {
    "time": TIME_ADVERBS,
    "duration": DURATION_ADVERBS,
    "frequency": FREQUENCY_ADVERBS,
}
ALL_ADVERBS = TIME_ADVERBS + DURATION_ADVERBS + FREQUENCY_ADVERBS

# Token patterns.
NON_SPACE_RUN = r"(?U)\S+"
WORD_OR_GAP_RUN = r"(?U)\w+|\W+"
WORD_RUN_MIN2 = r"(?U)\w{2,}"
WORD_BEFORE_PAREN = "(?U)" + FV.WORD_BEFORE_PAREN
NAME_BEFORE_PAREN = "(?U)" + FV.NAME_BEFORE_PAREN
IS_WORD_MIN2 = r"(?U)^\w{2,}$"


def col_of(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def extract_all(c: str | Column, pattern: str) -> Column:
    """All matches of ``pattern`` (whole match, group 0)."""
    return F.regexp_extract_all(col_of(c), F.lit(pattern), F.lit(0))


def whitespace_tokens(c: str | Column) -> Column:
    """Tokens between Unicode whitespace; punctuation stays on the token."""
    return extract_all(c, NON_SPACE_RUN)


def lower_tokens(c: str | Column) -> Column:
    return whitespace_tokens(F.lower(col_of(c)))


def word_gap_runs(c: str | Column) -> Column:
    """Alternating word / non-word runs; joining them gives the input back."""
    return extract_all(c, WORD_OR_GAP_RUN)


def lower_first(t: Column) -> Column:
    """First character lowered, the rest untouched (``McKay`` -> ``mcKay``)."""
    return F.concat(F.lower(F.substr(t, F.lit(1), F.lit(1))), F.substr(t, F.lit(2)))


def count_char(c: str | Column, ch: str) -> Column:
    """How often the literal character ``ch`` occurs."""
    c = col_of(c)
    return F.char_length(c) - F.char_length(F.replace(c, F.lit(ch), F.lit("")))


def _quote_regex(s: str) -> str:
    return "".join("\\" + ch if ch in r".^$*+?()[]{}|\-" else ch for ch in s)


def word_list(words) -> Column:
    return F.array(*[F.lit(w) for w in words])


def hits_words(tokens: Column, words) -> Column:
    """True if any token equals one of ``words``; null tokens give null."""
    return F.arrays_overlap(tokens, word_list(words))


def has_token(c: str | Column, words, lowercase: bool = True) -> Column:
    """True if a whitespace token of the (lowercased) text equals one of ``words``.

    Same result as comparing the token list, without building it: a token is a
    maximal run of non-whitespace, so it equals a word exactly when the word
    sits between whitespace or the text's ends. Null text gives null.
    """
    text = F.lower(col_of(c)) if lowercase else col_of(c)
    alternatives = "|".join(_quote_regex(w) for w in words)
    return text.rlike(r"(?U)(?:^|\s)(?:" + alternatives + r")(?=\s|$)")
