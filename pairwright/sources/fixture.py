"""Pair corpus derived from the ``part`` table.

The given tables hold no formulas, so each part yields fourteen pairs from the
templates below: ``{A}`` and ``{B}`` are the first and second word of
``p_name`` and ``{C}`` is ``p_type``, each with a capital first letter.
``pair_id = p_partkey * 100 + k``. The templates are exploded per part row
(a generator, no join), so the work is narrow and grows with ``part``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairwright.session import ensure_parallelism

NBSP = " "

# The fourteen test templates (k, sentence, formula).
TEMPLATES = [
    (0, "All {A} {B}s are {C}.", "∀x ({A}(x) ∧ {B}(x) → {C}(x))"),
    (1, "Every {A} item often holds a {B}.", "∀x ∀y ({A}(x) ∧ {B}(y) → Holds(y, x))"),
    (2, "An item is neither {A} nor {C}", "∀x (Item(x) → (¬{A}(x) ∨ ¬{C}(x)))"),
    (3, 'Item "{B}" is {A}, {C} or tiny.', "Item('{B}') → {A}({B}) ⊕ {C}({B}) ⊕ Tiny({B})"),
    (4, "A {B} is {A} exactly if it ships later.", "∀x ({B}(x) ↔ {A}(x) ∧ Ships-Late(x, {C}))"),
    (5, "No {B} is {A} now", "¬∃x ({B}(x) ∧ {A}(x))"),
    (6, "Crates without {B}s stay closed.", "∀x (¬Has(x, {B}) → ¬Open(x))"),
    (7, "Neither crate; nor {A} {B}!", "¬Crate({B}) ∧ ¬{A}({B})"),
    (8, "The {B} at Élan is {A}.", "At({B}, Élan) ∧ {A}({B}) ∧ {B}(x)"),
    (9, "A {B} is often" + NBSP + "{A}.", "Often(`{B}`) ∧ {A}(´{C}´)"),
    (10, "Temporarily {A} {B}s are {A} or {C}.", "∀x ({B}(x) → {A}(x) ⊕ {C}(x))"),
    (11, "{A} beats {C}.", "Beats({A}, {C})"),
    (12, "A {B} without formula.", None),
    (13, None, "∀x {A}(x)"),
]

# Formulas that differ in structure (scopes, brackets, nesting, negation).
STRUCTURE_TEMPLATES = [
    (40, "Every {A} one has some {B}.", "∀x ({A}(x) → ∃y ({B}(y) ∧ Holds(x, y)))"),
    (41, "Every {A} one has it.", "∀x ({A}(x) → Holds(x, y))"),
    (42, "All are {A} and it is {B}.", "∀x {A}(x) ∧ {B}(x)"),
    (43, "Some are {A}; each {B} is near one.", "∃x ({A}(x)) ∧ ∀y ({B}(y) → Near(x, y))"),
    (44, "Near ones are all {A}.", "∀x ∀y (Near(x, y) → ∀x {A}(x)) ∧ {C}(y)"),
    (45, "Not every {A} one is {B}.", "¬(∀x ({A}(x) → {B}(x))"),
    (46, "One is {A}, the other {B}.", "{A}(b)) ∧ {B}(c)"),
    (47, "The {A} {B} is {C}.", "[{A}(x) ∧ {B}(x)) → {C}(x)"),
    (48, "All are {A} and {B} or {C}.", "∀x ({A}(x) ∧ {B}(x) ∨ {C}(x))"),
    (49, "If {A} then, if {B}, {C}.", "∀x ({A}(x) → {B}(x) → {C}(x))"),
    (50, "What is {A} and {B} is {C} or tiny.", "∀x ({A}(x) ∧ {B}(x) → {C}(x) ∨ Tiny(x))"),
    (51, "Who loves their {A} is {B}.", "∀x (Loves(x, {A}(x)) → {B}(x))"),
    (52, "The next of {B} knows the far one, which is {A}.", "Knows(near({B}), far(x)) ∧ {A}(x)"),
    (53, "{B} says not to be {A}.", "Says({B}, ¬{A}({B})) ∧ Same(f({A}), f({B}))"),
    (54, "What is not {A} is not {B}.", "∀x (¬{A}(x) → ¬{B}(x))"),
    (55, "Unless {A} without {B}, surely {C}.", "∀x (¬({A}(x) ∧ ¬{B}(x)) → ¬¬{C}(x))"),
    (56, "Nothing is {A} and {B}.", "¬∃x ({A}(x) ∧ {B}(x))"),
    (57, "It is not {A} but {B}.", "¬{A}(x) ∧ {B}(x)"),
    (58, "Surely {A} ones are, if {B}, not {C}.", "∀x (¬¬{A}(x) → ({B}(x) → ¬{C}(x)))"),
    (59, "Some size is not that of {B}.", "∃x (Size(x) = y ∧ ¬Size(x) ≠ {B})"),
    (60, "It is {A} and, so {B}.", "({A}(x) ∧ ) → {B}(x)"),
    (61, "A {A} {B} without formula.", None),
    (62, "A {B} with an empty one.", ""),
    (63, "Far or {A}, then no {B}, exactly if tiny.", "∀x ∃y (¬Near (x, y) ⊕ {A}(x) → ¬({B}(y) ∨ ¬{C}(y)) ↔ Tiny(x))"),
]


def _capitalised(c):
    return F.concat(F.upper(F.substr(c, F.lit(1), F.lit(1))), F.substr(c, F.lit(2)))


def _fill(template, a, b, c):
    return F.replace(F.replace(F.replace(template, F.lit("{A}"), a), F.lit("{B}"), b), F.lit("{C}"), c)


def _sql_string(s: str | None) -> str:
    if s is None:
        return "CAST(NULL AS STRING)"
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _template_array(templates) -> str:
    """The templates as one SQL expression: one parse instead of a py4j call per literal."""
    return "inline(array(" + ", ".join(
        f"named_struct('k', {k}, 'n', {_sql_string(n)}, 'f', {_sql_string(f)})" for k, n, f in templates) + "))"


TEMPLATE_ARRAY_SQL = _template_array(TEMPLATES)


def pairs_from_parts(part: DataFrame, templates=None) -> DataFrame:
    """Explode every part row into the fourteen template pairs, or those of ``templates``."""
    # Spread before anything is computed: a small file is one scan task.
    words = ensure_parallelism(part.select("p_partkey", "p_name", "p_type")).select(
        "p_partkey",
        _capitalised(F.split_part("p_name", F.lit(" "), F.lit(1))).alias("a"),
        _capitalised(F.split_part("p_name", F.lit(" "), F.lit(2))).alias("b"),
        F.concat(F.substr("p_type", F.lit(1), F.lit(1)),
                 F.lower(F.substr("p_type", F.lit(2)))).alias("c"),
    )
    exploded = words.select("p_partkey", "a", "b", "c", F.expr(TEMPLATE_ARRAY_SQL if templates is None else _template_array(templates)))
    return exploded.select(
        (F.col("p_partkey") * 100 + F.col("k")).cast("bigint").alias("pair_id"),
        _fill(F.col("n"), F.col("a"), F.col("b"), F.col("c")).alias("nl_sentence"),
        _fill(F.col("f"), F.col("a"), F.col("b"), F.col("c")).alias("fol_expression"),
    )


def load_fixture_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_name", "p_type")
    return pairs_from_parts(part)


def load_structure_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pair corpus with the formulas of ``STRUCTURE_TEMPLATES`` besides."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_name", "p_type")
    return pairs_from_parts(part, TEMPLATES + STRUCTURE_TEMPLATES)
