"""Deterministic clients for tests; their rules are those of the registered queries' answer tables."""

import hashlib
import json
import re
import sys

from pyspark import cloudpickle

from pairwright.fixed_values import NEITHER_WORD, ONE_LETTER_WORD
from pairwright.plans import catalogue as cat
from pairwright.plans.prompts import Layout


class SingleAnswerRule:
    """First hex digit of md5(prompt): 0-7 applies, 8-d does not apply,
    e is the first answer with a trailing full stop, f is "none"."""

    name = "rule-single"

    def complete(self, system: str, prompts: list[str]) -> list[str]:
        out = []
        for p in prompts:
            d = int(hashlib.md5(p.encode("utf-8")).hexdigest()[0], 16)
            if d <= 7:
                out.append(cat.ANSWER_APPLIES)
            elif d <= 13:
                out.append(cat.ANSWER_NOT_APPLIES)
            elif d == 14:
                out.append(cat.ANSWER_APPLIES + ".")
            else:
                out.append(cat.NO_LABEL)
        return out


def rule_labels(sentence: str, formula: str) -> list[str]:
    """Candidate labels of a pair in catalogue order (the prefilters, in Python)."""
    hits = {
        "overgeneralization": formula.count("∀") >= 2,
        "wrong_variable_binding": "," in formula,
        "free_variable_error": re.search(ONE_LETTER_WORD, formula) is not None,
        "biconditional_instead_implication": "↔" in formula,
        "conjunction_instead_implication": "∧" in formula,
        "invalid_xor_usage": formula.count("⊕") >= 2,
        "global_negation_error": formula.startswith("¬"),
        "missing_condition_negation": "→" in formula,
        "wrong_negation_scope": formula.count("¬") >= 2 and "→" in formula,
        "neither_nor_translation_error": re.search(NEITHER_WORD, sentence) is not None,
    }
    return [label for label in cat.CATEGORY_LABELS if hits.get(label)]


class MultiLabelRule:
    """JSON list of the pair's candidate labels, ``["none"]`` if there are none."""

    name = "rule-multi"

    def __init__(self, layout: Layout):
        self.layout = layout

    def complete(self, system: str, prompts: list[str]) -> list[str]:
        out = []
        for p in prompts:
            labels = rule_labels(*self.layout.split(p)) or [cat.NO_LABEL]
            out.append(json.dumps(labels, separators=(",", ":")))
        return out


class CorrectorRule:
    """Returns the formula with every ``∀y`` turned into ``∃y``."""

    name = "rule-corrector"

    def __init__(self, layout: Layout):
        self.layout = layout

    def complete(self, system: str, prompts: list[str]) -> list[str]:
        return [self.layout.split(p)[1].replace("∀y", "∃y") for p in prompts]


# Workers get these by value; the tests folder isn't on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
