"""Prompt rendering as column expressions.

A prompt is ``prefix || sentence || middle || formula || suffix``. The constant
parts come from the fixed catalogue and are rendered once on the driver; per
row only a ``concat`` runs in the JVM. A null sentence or formula gives a null
prompt, which the model job skips (no call, null answer).
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass
from string import Formatter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairwright import fixed_values as FV
from pairwright.plans import catalogue as cat

SYSTEM_MULTI = (
    "Role: reviewer of formulas that were produced from English sentences. "
    "Input: one sentence, one first-order formula and a catalogue of error labels. "
    "Output: a JSON array with the labels whose error occurs in the formula, in catalogue order, "
    'e.g. ["free_variable_error"], and ["none"] when the formula has none of them. '
    "Print the array and nothing besides."
)
SYSTEM_SINGLE = (
    "Role: reviewer of one kind of translation error between an English sentence and a first-order formula. "
    f'Reply with one of two strings. Error found: "{cat.ANSWER_APPLIES}". Error not found, or not certain: '
    f'"{cat.ANSWER_NOT_APPLIES}". No other words.'
)
SYSTEM_CORRECTION = (
    "Role: editor of first-order formulas. Given a sentence and its formula, print the formula that states "
    "the sentence; a formula that states it already is printed as it stands. Print one formula and nothing else."
)
SYSTEM_CORRECTION_STRICT = (
    SYSTEM_CORRECTION + " Symbols allowed: ∀ ∃ ∧ ∨ ¬ → ↔ ⊕ and round brackets. Names of predicates, constants and "
    "variables stay unless the name itself is the error."
)


def text_digest(*parts: str) -> str:
    """SHA-256 of constant prompt text (parts joined by \\u0001)."""
    return hashlib.sha256("\u0001".join(parts).encode("utf-8")).hexdigest()


@dataclass(frozen=True)
class PromptSpec:
    """How a prompt is made from input columns.

    ``render`` builds the prompt; ``digest_of`` gives the digest of its constant
    text (system text included) and ``hashed`` the inputs that vary below it,
    so a request is identified without building the prompt. ``digests`` lists
    every digest the spec can give.
    """

    render: Callable[..., Column]
    digest_of: Callable[..., Column]
    hashed: Callable[..., tuple]
    digests: tuple
    system: str


@dataclass(frozen=True)
class Layout:
    prefix: str
    middle: str
    suffix: str
    system: str

    def render(self, sentence: str | Column = "nl_sentence", formula: str | Column = "fol_expression") -> Column:
        s = F.col(sentence) if isinstance(sentence, str) else sentence
        f = F.col(formula) if isinstance(formula, str) else formula
        return F.concat(F.lit(self.prefix), s, F.lit(self.middle), f, F.lit(self.suffix))

    @property
    def digest(self) -> str:
        return text_digest(self.system, self.prefix, self.middle, self.suffix)

    def spec(self) -> PromptSpec:
        digest = self.digest
        return PromptSpec(self.render, lambda s, f: F.lit(digest), lambda s, f: (s, f), (digest,), self.system)

    def parts(self, prompt: str | Column) -> tuple[Column, Column]:
        """Sentence and formula back out of a column of rendered prompts."""
        p = F.col(prompt) if isinstance(prompt, str) else prompt
        body = F.substr(p, F.lit(len(self.prefix) + 1), F.char_length(p) - len(self.prefix) - len(self.suffix))
        formula = F.substring_index(body, self.middle, -1)
        return F.substr(body, F.lit(1), F.char_length(body) - F.char_length(formula) - len(self.middle)), formula

    def split(self, prompt: str) -> tuple[str, str]:
        """Sentence and formula back out of a rendered prompt (used by test backends)."""
        body = prompt[len(self.prefix): len(prompt) - len(self.suffix)]
        sentence, _, formula = body.rpartition(self.middle)
        return sentence, formula


# --- rendering helpers ---------------------------------------------------------

def format_column(template: str, **cols: Column) -> Column:
    """A layout template as a column expression: literals and columns concatenated."""
    parts = []
    for literal, field, _, _ in Formatter().parse(template):
        if literal:
            parts.append(F.lit(literal))
        if field is not None:
            parts.append(cols[field])
    return F.concat(*parts)


def row_layout(template: str, head: str, tail: str, system: str, **constants) -> Layout:
    """Layout from a row template holding ``{sentence}`` and ``{formula}``:
    ``head`` goes before the row text, ``tail`` after it."""
    filled = template.format(sentence="\0S", formula="\0F", **constants)
    before, rest = filled.split("\0S")
    middle, after = rest.split("\0F")
    return Layout(head + before, middle, after + tail, system)


def _pair_fields(c: dict) -> dict:
    neg, pos = c["negative"], c["positive"]
    return dict(label=c["label"], instruction=c["instruction"], description=c["description"],
                positive_sentence=pos[0], positive_formula=pos[1],
                negative_sentence=neg[0], negative_formula=neg[1],
                explanation=neg[2] if len(neg) > 2 else None)


# --- design 1: few-shot examples, the row, then a flat category list ----------

def few_shot_block(entries) -> str:
    return "".join(FV.FEW_SHOT_LAYOUT.format(sentence=c["negative"][0], wrong=c["negative"][1],
                                             right=c["positive"][1], label=c["label"]) for c in entries)


def category_list(entries) -> str:
    return "\n".join(FV.CATEGORY_LINE_LAYOUT.format(**_pair_fields(c)) for c in entries)


def layout_catalogue(labels=None, few_shots: bool = True) -> Layout:
    entries = cat.entries(labels)
    head = few_shot_block(entries) if few_shots else ""
    tail = "Labels to choose from, with what each one means:\n\n" + category_list(entries) + "\n\n"
    return row_layout(FV.ROW_LAYOUT_CATALOGUE, head, tail, SYSTEM_MULTI)


# --- design 2: nested category blocks, then the row ---------------------------

def category_block(c: dict) -> str:
    fields = _pair_fields(c)
    text = FV.CATEGORY_BLOCK_LAYOUT.format(**fields)
    if fields["explanation"]:
        text += FV.BLOCK_EXPLANATION_LAYOUT.format(**fields)
    return text + "\n"


def format_categories_text(labels=None) -> str:
    """The nested catalogue as text; the explanation line only where one exists."""
    return "".join(category_block(c) for c in cat.entries(labels))


def category_block_column(c: Column) -> Column:
    """The same block, rendered from a catalogue DataFrame row struct ``c``."""
    expl = c["negative"]["explanation"]
    block = format_column(
        FV.CATEGORY_BLOCK_LAYOUT, label=c["label"], instruction=c["instruction"],
        positive_sentence=c["positive"]["sentence"], positive_formula=c["positive"]["formula"],
        negative_sentence=c["negative"]["sentence"], negative_formula=c["negative"]["formula"])
    explanation = F.when(expl.isNotNull() & (expl != ""),
                         format_column(FV.BLOCK_EXPLANATION_LAYOUT, explanation=expl)).otherwise(F.lit(""))
    return F.concat(block, explanation, F.lit("\n"))


def catalogue_text(catalogue: DataFrame) -> DataFrame:
    """One row, column ``text``: every block of a catalogue table in ``pos`` order."""
    blocks = catalogue.select("pos", category_block_column(F.struct(*catalogue.columns)).alias("block"))
    ordered = F.array_sort(F.collect_list(F.struct("pos", "block")))
    return blocks.agg(F.array_join(F.transform(ordered, lambda x: x["block"]), "").alias("text"))


def blocks_for(categories: Column, labels=None) -> Column:
    """Concatenated blocks of the labels in an array column (catalogue is a literal map)."""
    entries = cat.entries(labels)
    lookup = F.create_map(*[x for c in entries for x in (F.lit(c["label"]), F.lit(category_block(c)))])
    return F.array_join(F.transform(categories, lambda c: F.coalesce(F.try_element_at(lookup, c), F.lit(""))), "")


def layout_paired(labels=None) -> Layout:
    head = ("Catalogue. Every entry shows one sentence twice: the first formula states it, the second has the error.\n\n"
            + format_categories_text(labels))
    return row_layout(FV.ROW_LAYOUT_PAIRED, head, "", SYSTEM_MULTI)


# --- design 3: one category, its examples, then the row ----------------------

def single_category_text(label: str) -> str:
    (c,) = cat.entries([label])
    pos, neg = c["positive"], c["negative"]
    return (f"Error category: {c['description']} {c['instruction']}\n\n"
            "Two answered pairs, then the pair to judge:\n\n"
            + FV.SINGLE_EXAMPLE_LAYOUT.format(sentence=pos[0], formula=pos[1], answer=cat.ANSWER_NOT_APPLIES)
            + FV.SINGLE_EXAMPLE_LAYOUT.format(sentence=neg[0], formula=neg[1], answer=cat.ANSWER_APPLIES))


def layout_single(label: str) -> Layout:
    return row_layout(FV.ROW_LAYOUT_SINGLE, single_category_text(label), "", SYSTEM_SINGLE)


def _all_labels(labels=None):
    return [c["label"] for c in cat.CATALOGUE] if labels is None else list(labels)


def single_prompt(category: str | Column, sentence: str | Column = "nl_sentence",
                  formula: str | Column = "fol_expression", labels=None) -> Column:
    """Design-3 prompt for rows that carry their category in a column."""
    labels = _all_labels(labels)
    lookup = F.create_map(*[x for lab in labels for x in (F.lit(lab), F.lit(layout_single(lab).prefix))])
    category, sentence, formula = (F.col(c) if isinstance(c, str) else c for c in (category, sentence, formula))
    any_layout = layout_single(labels[0])
    return F.concat(F.try_element_at(lookup, category), sentence, F.lit(any_layout.middle),
                    formula, F.lit(any_layout.suffix))


def single_prompt_spec(labels=None) -> PromptSpec:
    """Spec over inputs (category, sentence, formula) for ``single_prompt``; the
    keys are those of the category's own layout."""
    labels = _all_labels(labels)
    digests = {lab: layout_single(lab).digest for lab in labels}
    lookup = F.create_map(*[F.lit(x) for pair in digests.items() for x in pair])
    return PromptSpec(lambda c, s, f: single_prompt(c, s, f, labels), lambda c, s, f: F.try_element_at(lookup, c),
                      lambda c, s, f: (s, f), tuple(digests.values()), SYSTEM_SINGLE)


# --- correction ---------------------------------------------------------------

CORRECTION_VARIANTS = {
    # variant: (with explanations, system text)
    "examples": (False, SYSTEM_CORRECTION),
    "examples_explained": (True, SYSTEM_CORRECTION),
    "examples_strict": (False, SYSTEM_CORRECTION_STRICT),
}


def correction_examples(explained: bool, labels=None) -> list[tuple]:
    out = []
    for c in cat.entries(labels):
        neg, pos = c["negative"], c["positive"]
        out.append((neg[0], neg[1], pos[1], neg[2] if explained and len(neg) > 2 else None))
    return out


def layout_correction(variant: str = "examples", labels=None) -> Layout:
    explained, system = CORRECTION_VARIANTS[variant]
    examples = correction_examples(explained, labels)
    head = "Repaired formulas, one error each. The last entry is open.\n\n"
    for number, (sentence, wrong, right, why) in enumerate(examples, start=1):
        head += FV.CORRECTION_EXAMPLE_LAYOUT.format(number=number, sentence=sentence, wrong=wrong, right=right)
        if why:
            head += FV.CORRECTION_EXPLANATION_LAYOUT.format(explanation=why)
        head += "\n"
    return row_layout(FV.ROW_LAYOUT_CORRECTION, head, "", system, number=len(examples) + 1)
