"""The automata run over batches: token kinds, odd spaces, and no fold of SQL expressions a token."""

import pyarrow as pa
import pytest

from pairwright.functions import formula as FO
from pairwright.operators import structure as S


def test_no_fold_of_expressions(spark):
    df = spark.createDataFrame([(1, "¬A → ¬B")], "pair_id int, fol_expression string")
    for op in (S.free_variables, S.bracket_faults, S.missing_parentheses_candidates, S.predicate_nesting_candidates, S.negation_scopes, S.both_sides_denied, S.structural_flags):
        plan = op(df)._jdf.queryExecution().optimizedPlan().toString()
        assert "aggregate(" not in plan and plan.count("ArrowEvalPython") == 1, op.__name__


@pytest.mark.parametrize("token, kind, name", [
    ("∀x", "q", "x"), ("∃  y1", "q", "y1"), ("∀", "r", ""), ("Very tall (", "c", "Very tall"), ("(", "o", ""), ("[", "o", "["), ("}", "x", "}"),
    ("≠=", "r", "≠="), ("→", "b", "→"), ("¬", "u", "¬"), (",", ",", ","), ("  ", "s", "  "), ("\x1f", "n", "\x1f"), ("𝔸", "n", "𝔸")])
def test_kinds_and_names(token, kind, name):
    assert FO.kind_of(token) == kind and FO.name_of(token) == name


def test_places_of_a_sliced_batch_with_nulls():
    batch = pa.array([["A"], None, ["𝔸", " ", "∧", " ", "B"], [], ["(", "x", ")"]]).slice(1)
    f = FO.Formulas(batch)
    assert list(f.rows("nb")) == [(1, [("n", "𝔸", 1), ("b", "∧", 3), ("n", "B", 5)]), (3, [("n", "x", 2)])]
    assert f.column({1: ["y"]}, pa.list_(pa.string()), []).to_pylist() == [None, ["y"], [], []]


def test_odd_spaces(spark):
    rows = [(0, "∀\u2003x P (x, y)"), (1, "A\u2028\u00a0∧\u3000B\n∨ C"), (2, "Loves(a1, ¬\tQ)"), (3, "∀x, y (P(x, y))")]
    df = spark.createDataFrame(rows, "pair_id int, fol_expression string")
    assert [tuple(r) for r in S.free_variables(df).select("pair_id", "free_variables").collect()] == [(0, ["y"])]
    assert [(r.pair_id, [tuple(m) for m in r.mixed_connectives]) for r in S.missing_parentheses_candidates(df).collect()] == [(1, [(8, "∧", "∨")])]
    assert [(r.pair_id, [tuple(m) for m in r.nested]) for r in S.predicate_nesting_candidates(df.where("pair_id < 3")).collect()] == [(2, [(11, "Loves", "¬")])]
