"""Structural tests of formulas against a recursive parser and hand cases."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pairwright.operators import structure as S

# --- a parser of its own: formulas are built as trees, then written out -------------

VARS = ["x", "y", "z"]


def _atoms():
    term = st.sampled_from(["x", "y", "z", "Oslo", "a1", "f(x)", "f(g(y), z)"])
    call = st.tuples(st.just("atom"), st.sampled_from(["P", "Very tall", "Ships-Late"]), st.lists(term, min_size=1, max_size=3))
    equal = st.tuples(st.just("equal"), term, term)
    return st.one_of(call, equal)


TREES = st.recursive(_atoms(), lambda sub: st.one_of(
    st.tuples(st.just("not"), sub), st.tuples(st.sampled_from(["∀", "∃"]), st.sampled_from(VARS), sub),
    st.tuples(st.sampled_from(["∧", "∨", "⊕", "→", "↔"]), sub, sub)), max_leaves=7)

LEVEL = {"↔": 1, "→": 2, "∨": 3, "⊕": 3, "∧": 4}


class Writer:
    """Writes a tree with brackets where precedence asks for them, and notes places."""

    def __init__(self):
        self.text, self.negations, self.arrows = "", [], []

    def put(self, s):
        self.text += s

    def write(self, tree, least):
        kind = tree[0]
        level = LEVEL.get(kind, 9)
        bracket = level < least
        if bracket:
            self.put("(")
        if kind == "atom":
            self.put(f"{tree[1]}({', '.join(tree[2])})")
        elif kind == "equal":
            self.put(f"{tree[1]} = {tree[2]}")
        elif kind == "not":
            at = len(self.text)
            self.put("¬")
            start = len(self.text)
            self.write(tree[1], 5)
            self.negations.append((at + 1, self.text[start:]))
        elif kind in "∀∃":
            self.put(kind + tree[1] + " ")
            self.write(tree[2], 5)
        else:
            right = kind == "→"
            self.write(tree[1], level + right)
            self.put(" " + kind + " ")
            at = len(self.text) - 1
            if kind == "→":
                self.arrows.append((at, tree[1], tree[2]))
            self.write(tree[2], level + (not right))
        if bracket:
            self.put(")")


def free(tree, bound=()):
    kind = tree[0]
    if kind in ("atom", "equal"):
        terms = tree[2] if kind == "atom" else tree[1:]
        letters = [v for t in terms for v in t.replace("f(", "").replace("g(", "").replace(")", "").split(", ")]
        return [v for v in letters if v in VARS and v not in bound]
    if kind == "not":
        return free(tree[1], bound)
    if kind in "∀∃":
        return free(tree[2], (*bound, tree[1]))
    return free(tree[1], bound) + free(tree[2], bound)


def odd(tree, signs=0):
    """Whether an atom stands under an odd number of the tree's negations."""
    kind = tree[0]
    if kind in ("atom", "equal"):
        return signs % 2 == 1
    if kind == "not":
        return odd(tree[1], signs + 1)
    if kind in "∀∃":
        return odd(tree[2], signs)
    return odd(tree[1], signs) or odd(tree[2], signs)


def whole(tree):
    return not whole(tree[1]) if tree[0] == "not" else whole(tree[2]) if tree[0] in "∀∃" else False


@pytest.fixture(scope="module")
def run(spark):
    def go(op, formulas, *cols):
        df = spark.createDataFrame(list(enumerate(formulas)), "pair_id int, fol_expression string")
        return {r.pair_id: tuple(r[c] for c in cols) for r in op(df).select("pair_id", *cols).collect()}
    return go


@settings(max_examples=6, deadline=None)
@given(st.lists(TREES, min_size=20, max_size=60))
def test_well_formed_formulas(run, trees):
    texts, want = [], []
    for tree in trees:
        w = Writer()
        w.write(tree, 0)
        texts.append(w.text)
        want.append((tree, w))
    variables = run(S.free_variables, texts, "free_variables")
    scopes = run(S.negation_scopes, texts, "well_formed", "global_negation", "scopes")
    denied = run(S.both_sides_denied, texts, "denied_arrows")
    assert run(S.bracket_faults, texts, "fault") == {}
    for k, (tree, w) in enumerate(want):
        names = list(dict.fromkeys(free(tree)))
        assert variables.get(k, ([],))[0] == names, w.text
        if w.negations:
            ok, is_global, got = scopes[k]
            assert ok and is_global == whole(tree), w.text
            assert [tuple(s) for s in got] == sorted(w.negations), w.text
        arrows = sorted(at for at, left, right in w.arrows if odd(left) and odd(right))
        assert denied.get(k, ([],))[0] == arrows, w.text


def test_scopes_of_quantifiers(run):
    cases = {
        "∀x P(x) ∧ Q(x)": ["x"], "∀x (P(x)) → Q(x)": ["x"], "∀x ∃y (P(x, y) ∧ ∀y Q(y) ∧ R(y))": [], "∀x, y (P(x, y))": [], "∀x,y P(x, y) ∨ Q(y)": ["y"],
        "P(x) ∧ ∀x (Q(x))": ["x"], "f(x) = y": ["x", "y"], "x(y)": ["y"], "P(x)) ∧ ∀y Q(y)": ["x"], "(((x": ["x"], "∀x": [], "∀": [], "P(z, y, x, y)": ["z", "y", "x"],
        "∀x (P(x) ∧ (Q(y) → ∃y R(y, x)))": ["y"], "[∀x {P(x) ∧ Q(x)}] ∧ R(x)": ["x"], "∀x ¬∃y ¬P(x, y)": []}
    got = run(S.free_variables, list(cases), "free_variables")
    assert {f: got.get(k, ([],))[0] for k, f in enumerate(cases)} == cases


def test_bracket_faults(run):
    cases = {
        "(A ∧ B": ("unclosed", 1, 1), "((A) ∧ P(x": ("unclosed", 1, 2), "P(x)) ∧ (": ("unopened", 5, 0), "[A)": ("mismatched", 3, 1), "(A]": ("mismatched", 3, 1),
        "P (x": ("unclosed", 3, 1), "é{A ∧ (B}": ("mismatched", 9, 2), ")": ("unopened", 1, 0), "(A) [B] {C}": None, "": None}
    got = run(S.bracket_faults, list(cases), "fault", "fault_at", "open_brackets")
    assert {f: got.get(k) for k, f in enumerate(cases)} == cases


def test_mixed_connectives(run):
    cases = {
        "A ∧ B ∨ C": [(7, "∧", "∨")], "A ∧ (B ∨ C)": [], "A ∧ B → C ∨ D": [], "A → B → C": [(7, "→", "→")], "A ↔ B → C": [(7, "↔", "→")], "(A → B) → C": [],
        "A ⊕ B ⊕ C": [], "P(A ∧ B, C ∨ D)": [], "P(A ∧ B ∨ C)": [(9, "∧", "∨")], "A ∧ B ∨ C ∧ D": [(7, "∧", "∨"), (11, "∨", "∧")], "(A ∧ B) ∨ (C ∧ D) ∧ E": [(19, "∨", "∧")]}
    got = run(S.missing_parentheses_candidates, list(cases), "mixed_connectives", "fault")
    assert {f: [tuple(m) for m in got[k][0]] if k in got else [] for k, f in enumerate(cases)} == cases
    assert run(S.missing_parentheses_candidates, ["(A", "A", "A ∧ B"], "fault") == {0: ("unclosed",)}


def test_nested_predicates(run):
    cases = {
        "Loves(x, Commute(x))": [(10, "Loves", "Commute")], "Loves(x, home(x))": [], "home(x) ∧ Loves(x, home(x))": [(20, "Loves", "home")], "P(¬Q)": [(3, "P", "¬")],
        "P((A ∧ B))": [(6, "P", "∧")], "P(f(G(x)))": [(5, "f", "G")], "P(∀x Q(x))": [(3, "P", "∀"), (6, "P", "Q")], "Very tall(x) ∧ Is(x, Very tall(y))": [(22, "Is", "Very tall")], "P(x, y)": []}
    got = run(S.predicate_nesting_candidates, list(cases), "nested")
    assert {f: [tuple(m) for m in got.get(k, ([],))[0]] for k, f in enumerate(cases)} == cases


def test_formulas_that_cannot_be_read(run):
    bad = ["¬", "¬(A", "¬A ∧", "¬A B(x) C", "¬A, B", "(¬A) B", "¬A ∧ ∧ B", "¬()", "¬A)", "∧ ¬A", "¬P(x)(y)", "¬[A)"]
    got = run(S.negation_scopes, bad, "well_formed", "global_negation", "scopes")
    assert got == {k: (False, False, []) for k in range(len(bad))}


def test_nulls_empties_and_long_formulas(run):
    long = "∀x (" + " ∧ ".join(f"¬P{i}(x, y)" for i in range(400)) + " → ¬Q(z))"
    texts = [None, "", "   ", long, "(" * 300 + "¬A" + ")" * 300]
    assert run(S.free_variables, texts, "free_variables") == {3: (["y", "z"],)}
    scopes = run(S.negation_scopes, texts, "well_formed", "global_negation", "scopes")
    assert set(scopes) == {3, 4} and len(scopes[3][2]) == 401 and scopes[4][:2] == (True, True)
    assert run(S.both_sides_denied, texts, "denied_arrows") == {3: ([long.index("→") + 1],)}
    flags = run(S.structural_flags, texts, "structural")
    assert flags[0] == (None,) and flags[1] == ([],) and flags[3] == (["free_variable_error", "wrong_negation_scope"],) and flags[4] == (["global_negation_error"],)


def test_each_value_is_computed_once(spark):
    """The formula is cut into tokens once in the plan: filters on the result don't repeat it."""
    df = spark.createDataFrame([(1, "¬A → ¬B")], "pair_id int, fol_expression string")
    for op in (S.free_variables, S.both_sides_denied, S.structural_flags, S.missing_parentheses_candidates):
        plan = op(df)._jdf.queryExecution().optimizedPlan().toString()
        assert len(re.findall(r"regexp_extract_all\(fol_expression#\d+, \(\?U", plan)) == 1, op.__name__
