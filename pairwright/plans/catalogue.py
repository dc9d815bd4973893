"""Error-category catalogue: labels, instructions and one example pair each.

The labels and the two answer sentences are the interface and are fixed; the
wording of instructions and examples is our own. One table serves all four
renderings: a flat label list, nested blocks, single-category prompts and the
correction examples (negative example -> positive example).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pairwright.fixed_values import (  # noqa: F401
    ANSWER_APPLIES,
    ANSWER_NOT_APPLIES,
    CATEGORY_LABELS,
    NO_LABEL,
    PREDICATE_NESTING,
)

CATALOGUE = [
    dict(label="missing_category",
         description="The kind of thing a statement is restricted to has no predicate in the formula.",
         instruction="Name the nouns that restrict the statement and find a predicate for each.",
         positive=("Wooden bridges on the river creak.", "∀b (Bridge(b) → ((Wooden(b) ∧ OnRiver(b)) → Creaks(b)))"),
         negative=("Wooden bridges on the river creak.", "∀b ((Wooden(b) ∧ OnRiver(b)) → Creaks(b))",
                   "Wooden rafts would have to creak as well; Bridge is gone.")),
    dict(label="overgeneralization",
         description="A statement about at least one thing became a statement about each thing.",
         instruction="For each ∀ ask which word of the sentence speaks of all things.",
         positive=("One lamp lights all rooms.", "∃k (Lamp(k) ∧ ¬∃r (Room(r) ∧ ¬Lights(k, r)))"),
         negative=("One lamp lights all rooms.", "∀k ∀r (Lamp(k) → (Room(r) → Lights(k, r)))",
                   "Read aloud, each lamp lights each room.")),
    dict(label="wrong_variable_binding",
         description="An argument place holds a variable that stands for someone else.",
         instruction="Fill each argument place with the noun its quantifier introduced and read the result.",
         positive=("A key that fits a lock opens it.", "∀k ∀l (Key(k) → (Lock(l) → (Fits(k, l) → Opens(k, l))))"),
         negative=("A key that fits a lock opens it.", "∀k ∀l (Key(k) → (Lock(l) → (Fits(k, l) → Opens(l, k))))",
                   "In the last atom the lock opens the key.")),
    dict(label="free_variable_error",
         description="Some variable has no quantifier in front of it.",
         instruction="Draw a line from each variable to its quantifier; none may stay without.",
         positive=("No ferry sails in a storm.", "¬∃f ∃s (Ferry(f) ∧ Storm(s) ∧ SailsIn(f, s))"),
         negative=("No ferry sails in a storm.", "¬∃f (Ferry(f) ∧ Storm(s) ∧ SailsIn(f, s))",
                   "Nothing introduces s.")),
    dict(label="biconditional_instead_implication",
         description="The formula claims both directions although the sentence claims one.",
         instruction="Turn the sentence round; if the turned one was not said, ↔ is too strong.",
         positive=("Tickets bought online are cheaper.", "∀t ((Ticket(t) ∧ Online(t)) → Cheaper(t))"),
         negative=("Tickets bought online are cheaper.", "∀t (Ticket(t) → (Online(t) ↔ Cheaper(t)))",
                   "Cheap tickets from the counter are ruled out by the formula only.")),
    dict(label="conjunction_instead_implication",
         description="What should follow from a condition is stated next to it with ∧.",
         instruction="Under ∀, a noun and what is said of it are linked by →.",
         positive=("Whatever glitters attracts magpies.", "∀g ∀m ((Glitters(g) ∧ Magpie(m)) → Attracts(g, m))"),
         negative=("Whatever glitters attracts magpies.", "∀g ∀m (Glitters(g) ∧ Magpie(m) ∧ Attracts(g, m))",
                   "Now everything glitters and everything is a magpie.")),
    dict(label="invalid_xor_usage",
         description="Three or more alternatives are strung together with ⊕, which counts odd numbers rather than one.",
         instruction="Count the alternatives between ⊕ signs; two is the most that works.",
         positive=("The switch stands at low, mid or high, never at two of them.",
                   "(Low(switch) ∨ Mid(switch) ∨ High(switch)) ∧ ¬(Low(switch) ∧ Mid(switch)) ∧ ¬(Low(switch) ∧ High(switch)) ∧ ¬(Mid(switch) ∧ High(switch))"),
         negative=("The switch stands at low, mid or high, never at two of them.", "Low(switch) ⊕ Mid(switch) ⊕ High(switch)",
                   "Low, mid and high together satisfy this formula.")),
    dict(label="missing_parentheses",
         description="The formula groups its parts in another way than the sentence does.",
         instruction="Put back all brackets by precedence and compare the groups with the sentence.",
         positive=("If the alarm rings or smoke appears, the hall empties.", "(Rings(alarm) ∨ ∃s Smoke(s)) → Empties(hall)"),
         negative=("If the alarm rings or smoke appears, the hall empties.", "Rings(alarm) ∨ (∃s Smoke(s) → Empties(hall))",
                   "A ringing alarm alone makes the formula true, whatever the hall does.")),
    dict(label="global_negation_error",
         description="A denial of one part was moved in front of everything.",
         instruction="Find the words that are denied and see whether ¬ covers more than them.",
         positive=("Several boats lack a sail.", "∃b ∃c (Boat(b) ∧ Boat(c) ∧ ¬Same(b, c) ∧ ¬HasSail(b) ∧ ¬HasSail(c))"),
         negative=("Several boats lack a sail.", "¬∃b ∃c (Boat(b) ∧ Boat(c) ∧ ¬Same(b, c) ∧ HasSail(b) ∧ HasSail(c))",
                   "This limits the boats with a sail and leaves open whether any lacks one.")),
    dict(label="missing_condition_negation",
         description="The sentence has a condition of absence, the formula one of presence.",
         instruction="Look for 'no', 'not' and 'without' before the main verb and find them left of →.",
         positive=("Bread without salt tastes flat.", "∀b (¬Salted(b) → (Bread(b) → Flat(b)))"),
         negative=("Bread without salt tastes flat.", "∀b (Salted(b) → (Bread(b) → Flat(b)))",
                   "The word 'without' left no trace.")),
    dict(label="wrong_negation_scope",
         description="A denial spread to the other side of the arrow.",
         instruction="Where both sides of → are denied, look for two denials in the sentence.",
         positive=("A road that is not cleared gets closed.", "∀r (Road(r) → (¬Cleared(r) → Closed(r)))"),
         negative=("A road that is not cleared gets closed.", "∀r (Road(r) → (¬Cleared(r) → ¬Closed(r)))",
                   "Closing is affirmed by the sentence.")),
    dict(label="neither_nor_translation_error",
         description="The formula lets one of two denied things happen.",
         instruction="Both things after 'neither' have to be false in each case the formula allows.",
         positive=("The old clock neither ticks nor strikes.", "¬(Ticks(clock) ∨ Strikes(clock))"),
         negative=("The old clock neither ticks nor strikes.", "¬(Ticks(clock) ∧ Strikes(clock))",
                   "A clock that ticks without striking satisfies the formula.")),
    dict(label="predicate_naming_error",
         description="The name of a predicate tells of something else than the word it replaces.",
         instruction="Replace the names by the words of the sentence and check that it reads the same.",
         positive=("Foxes dig their dens.", "∀f ∀d ((Fox(f) ∧ DenOf(d, f)) → Digs(f, d))"),
         negative=("Foxes dig their dens.", "∀f ∀d ((Fox(f) ∧ DenOf(d, f)) → Shovel(f, d))",
                   "A shovel is a tool, the sentence tells of digging.")),
    dict(label=PREDICATE_NESTING,
         description="A statement stands where a thing should stand.",
         instruction="Arguments are variables or names; an argument with a predicate sign is an error.",
         positive=("The guide shows a cave.", "∃c (Shows(guide, c) ∧ Cave(c))"),
         negative=("The guide shows a cave.", "∃c Shows(guide, Cave(c))",
                   "Cave(c) is true or false and cannot be shown.")),
]

assert [c["label"] for c in CATALOGUE[:13]] == list(CATEGORY_LABELS)

CATALOGUE_SCHEMA = (
    "pos INT, label STRING, description STRING, instruction STRING, "
    "positive STRUCT<sentence: STRING, formula: STRING>, "
    "negative STRUCT<sentence: STRING, formula: STRING, explanation: STRING>"
)


def entries(labels=None) -> list[dict]:
    """Catalogue entries in catalogue order; the 13 shared ones by default."""
    labels = list(CATEGORY_LABELS) if labels is None else list(labels)
    by_label = {c["label"]: c for c in CATALOGUE}
    unknown = [x for x in labels if x not in by_label]
    if unknown:
        raise KeyError(f"labels not in the catalogue: {unknown}")
    return [by_label[x] for x in labels]


def catalogue_df(spark: SparkSession, labels=None) -> DataFrame:
    """The catalogue as a small DataFrame (one row per category)."""
    rows = []
    for i, c in enumerate(entries(labels)):
        neg = c["negative"]
        rows.append((i, c["label"], c["description"], c["instruction"],
                     {"sentence": c["positive"][0], "formula": c["positive"][1]},
                     {"sentence": neg[0], "formula": neg[1],
                      "explanation": neg[2] if len(neg) > 2 else None}))
    return spark.createDataFrame(rows, CATALOGUE_SCHEMA)
