"""Structural tests of formulas: scopes, brackets, nesting, negation.

They stand beside the one-character prefilters of ``candidates``: each reads the
formula's structure in one narrow pass and names what it found and where
(places are 1-based code points). A cheap character test goes first, so formulas
that can't hold the fault are never cut into tokens.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairwright.fixed_values import PREDICATE_NESTING
from pairwright.functions import formula as FO
from pairwright.functions.text import count_char
from pairwright.operators.candidates import FOL, free_variable
from pairwright.session import ship_package


TOKENS = "_tokens"


def computed(df: DataFrame, **values: Column) -> DataFrame:
    """``withColumns``, but each value is computed once a row.

    A filter on a column of a projection is pushed below it with the column's
    expression written out again; a one-element generator keeps it where it is.
    """
    entry = F.explode(F.array(F.struct(*[v.alias(n) for n, v in values.items()]))).alias("_v")
    return df.select("*", entry).select(*df.columns, *[F.col("_v")[n].alias(n) for n in values])


def tokenized(df: DataFrame, cheap: Column | None = None, formula: str = FOL) -> DataFrame:
    """Rows past the cheap test with the token array of their formula."""
    ship_package(df.sparkSession)
    return computed(df if cheap is None else df.where(cheap), **{TOKENS: FO.tokens(F.col(formula))})


def free_variables(df: DataFrame, formula: str = FOL, out: str = "free_variables") -> DataFrame:
    """Formulas with variables that no quantifier binds, and those variables."""
    rows = tokenized(df, free_variable(F.col(formula), F.col(formula)), formula)
    return computed(rows, **{out: FO.free_variables(TOKENS)}).where(F.size(out) > 0).drop(TOKENS)


def bracket_faults(df: DataFrame, formula: str = FOL) -> DataFrame:
    """Formulas whose brackets don't fit: fault, its place, brackets open there."""
    rows = tokenized(df, F.col(formula).rlike(r"[()\[\]{}]"), formula)
    found = computed(rows, _fault=FO.bracket_fault(TOKENS)).where("_fault IS NOT NULL")
    return found.withColumns({"fault": F.col("_fault.fault"), "fault_at": F.col("_fault.at"), "open_brackets": F.col("_fault.open")}).drop("_fault", TOKENS)


def missing_parentheses_candidates(df: DataFrame, formula: str = FOL) -> DataFrame:
    """Formulas whose grouping rests on precedence alone, or whose brackets don't fit."""
    sign = "[" + FO.JUNCTIONS + FO.ARROWS + "]"
    rows = tokenized(df, F.col(formula).rlike(rf"(?s){sign}.*{sign}|[()\[\]{{}}]"), formula)
    found = computed(rows, mixed_connectives=FO.mixed_connectives(TOKENS), _fault=FO.bracket_fault(TOKENS))
    return (found.where((F.size("mixed_connectives") > 0) | F.col("_fault").isNotNull())
            .withColumn("fault", F.col("_fault.fault")).drop("_fault", TOKENS))


def predicate_nesting_candidates(df: DataFrame, formula: str = FOL) -> DataFrame:
    """Formulas in which a predicate (or a formula) stands in a term's place."""
    rows = tokenized(df, F.col(formula).contains("("), formula)
    return computed(rows, nested=FO.nested_predicates(TOKENS)).where(F.size("nested") > 0).drop(TOKENS)


def _analysed(rows: DataFrame) -> DataFrame:
    """Negation analysis of formulas whose brackets fit; null for others."""
    return computed(rows, _n=F.when(FO.bracket_fault(TOKENS).isNull(), FO.negation_analysis(TOKENS)))


def _both_denied(implications: Column) -> Column:
    return F.filter(implications, lambda i: i["left"] & i["right"])


def negation_scopes(df: DataFrame, formula: str = FOL) -> DataFrame:
    """Formulas with a negation: what each covers, and whether the whole formula is denied.

    ``well_formed`` false (no scopes) where the formula can't be read.
    """
    f = F.col(formula)
    found = _analysed(tokenized(df, f.contains("¬"), formula))
    covered = F.transform("_n.negations", lambda n: F.struct(n["at"].alias("at"), F.substr(f, n["first"], n["last"] - n["first"] + 1).alias("covers")))
    return found.withColumns({
        "well_formed": F.coalesce(F.col("_n.well_formed"), F.lit(False)), "global_negation": F.coalesce(F.col("_n.global"), F.lit(False)),
        "scopes": F.coalesce(covered, F.array().cast("array<struct<at:int,covers:string>>"))}).drop("_n", TOKENS)


def both_sides_denied(df: DataFrame, formula: str = FOL) -> DataFrame:
    """Formulas with an implication both of whose sides are denied: the places of these arrows.

    A side is denied if one of its atoms stands under an odd number of the
    side's own negations.
    """
    f = F.col(formula)
    found = _analysed(tokenized(df, (count_char(f, "¬") >= 2) & f.contains("→"), formula))
    arrows = F.transform(_both_denied(F.col("_n.implications")), lambda i: i["at"])
    return found.where(F.size(_both_denied(F.col("_n.implications"))) > 0).withColumn("denied_arrows", arrows).drop("_n", TOKENS)


#: Label of the category that each structural test serves.
LABELS = ("free_variable_error", "missing_parentheses", "global_negation_error", "wrong_negation_scope", PREDICATE_NESTING)


def structural_flags(df: DataFrame, formula: str = FOL, out: str = "structural") -> DataFrame:
    """All structural tests in one scan, as an array of category labels; null for a null formula."""
    f = F.col(formula)
    read = computed(tokenized(df, None, formula), _t=F.struct(
        F.when(free_variable(f, f), F.size(FO.free_variables(TOKENS))).alias("free"), F.size(FO.mixed_connectives(TOKENS)).alias("mixed"),
        FO.bracket_fault(TOKENS).isNotNull().alias("fault"), F.when(f.contains("¬"), FO.negation_analysis(TOKENS)).alias("negation"),
        F.when(f.contains("("), F.size(FO.nested_predicates(TOKENS))).alias("nested")))
    t = lambda name: F.col(f"_t.{name}")
    holds = {
        "free_variable_error": t("free") > 0, "missing_parentheses": (t("mixed") > 0) | t("fault"), "global_negation_error": t("negation.global") & ~t("fault"),
        "wrong_negation_scope": (F.size(_both_denied(t("negation.implications"))) > 0) & ~t("fault"), PREDICATE_NESTING: t("nested") > 0}
    flags = F.array_compact(F.array(*[F.when(holds[label], F.lit(label)) for label in LABELS]))
    return read.withColumn(out, F.when(f.isNotNull(), flags)).drop("_t", TOKENS)
