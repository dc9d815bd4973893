"""pairwright: curation of (sentence, first-order-logic formula) pair corpora on Spark.

Every operator is ``DataFrame -> DataFrame`` and usable with ``df.transform``.
Column work is expressed with Spark's own functions so it stays in the JVM;
only the language-model call runs in Python workers (``plans.model_job``).
"""

from pairwright.operators.audit import audit_applies, audit_unexpected, before_after, chart_data
from pairwright.operators.candidates import candidate_counts, candidate_flags, candidates
from pairwright.operators.cleaning import (
    clean_pairs,
    lowercase_constants,
    remove_adverb_sentences,
    strip_special_chars,
)
from pairwright.operators.indexing import row_index
from pairwright.operators.sampling import sample_n
from pairwright.session import build_session, scratch_path

__all__ = [
    "audit_applies", "audit_unexpected", "before_after", "build_session", "candidate_counts",
    "candidate_flags", "candidates", "chart_data", "clean_pairs", "lowercase_constants",
    "remove_adverb_sentences", "row_index", "sample_n", "scratch_path", "strip_special_chars",
]
