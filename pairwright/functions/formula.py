"""Formulas read token by token: small automata over batches of token arrays.

Spark cuts a formula into tokens that cover it whole (``tokens``, one expression);
each token has a kind:

    q  quantifier with its variable (``∀x``)      c  name with its opening bracket (``Holds (``)
    n  name                                       o  opening bracket of a group    x  closing bracket
    u  negation      b  binary connective         r  relation or term sign         ,  comma      s  space

Every automaton is an Arrow UDF over that array (a column), so one cut serves
several. Kinds and lengths are found once for each distinct token of a batch, and
tokens that an automaton doesn't look at are dropped before its loop: a formula
costs one step for each token that matters, with a Python list as the stack.
(As folds of SQL expressions the same automata built a new array and struct a
token.) Keep the array in a column that Catalyst can't write inline
(``operators.structure.computed``), or it cuts the text again for every use.

Precedence, strongest first: term signs, negation and quantifiers, ∧, then ∨ and
⊕, → (to the right), ↔. A quantifier or negation covers the next unit: a group,
an atom, or a unit with further prefixes before it.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from pairwright.functions.text import col_of, extract_all

QUANTIFIERS = "∀∃"
NEGATION = "¬"
JUNCTIONS = "∧∨⊕"
ARROWS = "→↔"
OPENING, CLOSING = "([{", ")]}"
TERM_SIGNS = "=≠<>≤≥+*/"

_SIGNS = QUANTIFIERS + NEGATION + JUNCTIONS + ARROWS + "()," + TERM_SIGNS
NAME = rf"[^\s{_SIGNS}\[\]{{}}]+"
#: Names may be of several words.
NAMES = rf"{NAME}(?:\s+{NAME})*"
TOKEN = rf"(?U)[{QUANTIFIERS}]\s*{NAME}|{NAMES}\s*\(|{NAMES}|[{TERM_SIGNS}]+|\S|\s+"

#: Precedence of the connectives; a prefix stands above all of them.
PRECEDENCE = {"↔": 1, "→": 2, "∨": 3, "⊕": 3, "∧": 4}
PREFIX, TERM = 5, 6

#: Kind of a token by its first sign; other tokens are names or calls.
_KINDS = {c: kind for signs, kind in ((NEGATION, "u"), (JUNCTIONS + ARROWS, "b"), (OPENING, "o"), (CLOSING, "x"), (",", ","), (TERM_SIGNS + QUANTIFIERS, "r")) for c in signs}
#: Space as in the token pattern (Unicode's White_Space).
SPACE = "\t\n\x0b\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_KINDS.update(dict.fromkeys(SPACE, "s"))
_FITS = dict(zip(OPENING, CLOSING))
_VARIABLE = re.compile("[a-z]")


def kind_of(t: str) -> str:
    """Kind of a token, by its first sign, its last one and its length."""
    if len(t) > 1 and t[0] in QUANTIFIERS:
        return "q"
    return _KINDS.get(t[0]) or ("c" if len(t) > 1 and t[-1] == "(" else "n")


def name_of(t: str) -> str:
    """The name in a call (without bracket) or a quantifier (without its sign)."""
    if t[0] in QUANTIFIERS:
        t = t[1:].lstrip(SPACE)
    return t[:-1].rstrip(SPACE) if t[-1:] == "(" else t


def tokens(c: str | Column) -> Column:
    """array<string>: the tokens that cover a formula, spaces included; null for a null one."""
    return extract_all(c, TOKEN)


class Formulas:
    """The tokens of a batch of formulas in flat arrays: text, kind, 1-based place (code points)."""

    def __init__(self, arrays: pa.ListArray):
        values = arrays.flatten().dictionary_encode()
        self.words = values.dictionary.to_pylist()
        self.code = values.indices.to_numpy(zero_copy_only=False)
        self.null = arrays.is_null().to_numpy(zero_copy_only=False)
        sizes = arrays.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        self.first = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
        self.kinds = [kind_of(w) for w in self.words]
        length = np.array([len(w) for w in self.words], np.int64)[self.code] if self.words else np.zeros(0, np.int64)
        before = np.concatenate([[0], np.cumsum(length)])
        self.at = before[:-1] - np.repeat(before[self.first[:-1]], sizes) + 1

    def rows(self, kinds: str) -> Iterator[tuple[int, list]]:
        """(row, [(kind, text, place), ...]) of the rows with tokens of these kinds, those tokens alone."""
        wanted = np.array([k in kinds for k in self.kinds], bool)[self.code] if self.words else np.zeros(0, bool)
        first = np.concatenate([[0], np.cumsum(wanted)])[self.first]
        at = self.at[wanted].tolist()
        code = self.code[wanted].tolist()
        toks = [(self.kinds[c], self.words[c], a) for c, a in zip(code, at)]
        has = np.flatnonzero(np.diff(first))
        for row, i, j in zip(has.tolist(), first[has].tolist(), first[has + 1].tolist()):
            yield row, toks[i:j]

    def column(self, found: dict, kind: pa.DataType, default=None) -> pa.Array:
        """``found`` by row; ``default`` for other rows, null for null formulas."""
        out = [default] * len(self.null)
        for row, value in found.items():
            out[row] = value
        for row in np.flatnonzero(self.null).tolist():
            out[row] = None
        return pa.array(out, kind)


def automaton(kind: str) -> Callable:
    """An Arrow UDF over a token array from a function of ``Formulas``."""
    def wrap(run: Callable[[Formulas], pa.Array]) -> Callable[[str | Column], Column]:
        def over(arrays):
            return run(Formulas(arrays))

        over.__annotations__ = {"arrays": pa.Array, "return": pa.Array}
        over.__name__ = run.__name__

        def column(toks: str | Column) -> Column:
            return F.arrow_udf(over, kind)(col_of(toks))

        column.__name__, column.__doc__ = run.__name__, run.__doc__
        return column
    return wrap


def _struct(**fields: pa.DataType) -> pa.StructType:
    return pa.struct(list(fields.items()))


# --- variables ---------------------------------------------------------------------

@automaton("array<string>")
def free_variables(formulas: Formulas) -> pa.Array:
    """One-letter variables that occur outside every quantifier of their name, in order.

    The stack holds the quantified names with the bracket depth where their scope
    began. A connective (or comma) ends the scopes begun at its own depth, a
    closing bracket those begun inside. A name that opens a bracket is no variable.
    ``∀x, y`` quantifies both. A quantifier inside another of the same name ends alone.
    """
    found = {}
    for formula, toks in formulas.rows("qcnoxubr,"):
        # row: 1 after a quantified name, 2 after a comma behind one.
        depth, bound, row, out = 0, [], 0, []
        for k, t, _ in toks:
            binds = k == "q" or (row == 2 and k in "nc")
            if binds:
                bound.append((name_of(t), depth))
            elif k == "x" or k == "b" or (k == "," and row != 1):
                while bound and bound[-1][1] >= depth:
                    bound.pop()
            elif k == "n" and len(t) == 1 and _VARIABLE.match(t) and t not in out and all(v != t for v, _ in bound):
                out.append(t)
            if k in "oc":
                depth += 1
            elif k == "x" and depth:
                depth -= 1
            row = 1 if binds and k != "c" else 2 if k == "," and row == 1 else 0
        if out:
            found[formula] = out
    return formulas.column(found, pa.list_(pa.string()), [])


# --- brackets ------------------------------------------------------------------------

@automaton("struct<fault:string,at:int,open:int>")
def bracket_fault(formulas: Formulas) -> pa.Array:
    """First bracket that doesn't fit: (fault, at, open), null where all fit.

    ``unopened`` and ``mismatched`` stand at the closing bracket, ``unclosed`` at
    the first bracket that is never closed; ``open`` is how many are open there.
    """
    found = {}
    for formula, toks in formulas.rows("ocx"):
        stack, fault = [], None
        for k, t, at in toks:
            if k != "x":
                stack.append((t[-1], at + len(t) - 1))
            elif not stack or _FITS[stack[-1][0]] != t:
                fault = {"fault": "mismatched" if stack else "unopened", "at": at, "open": len(stack)}
                break
            else:
                stack.pop()
        if fault is None and stack:
            fault = {"fault": "unclosed", "at": stack[0][1], "open": len(stack)}
        if fault:
            found[formula] = fault
    return formulas.column(found, _struct(fault=pa.string(), at=pa.int32(), open=pa.int32()))


@automaton("array<struct<at:int,before:string,sign:string>>")
def mixed_connectives(formulas: Formulas) -> pa.Array:
    """array<struct<at, before, sign>>: connectives whose grouping rests on precedence alone.

    Within one bracket: a junction next to another kind of junction (``A ∨ B ∧ C``),
    and a second arrow (``A → B → C``). An arrow parts junctions, so ``A ∧ B → C ∨ D``
    has none. The stack holds, for each open bracket, the last junction since an
    arrow and the last arrow; a comma begins anew.
    """
    found = {}
    for formula, toks in formulas.rows("ocxb,"):
        stack, out = [("", "")], []
        for k, t, at in toks:
            if k == "b":
                junction, arrow = stack[-1]
                if t in ARROWS:
                    before, stack[-1] = arrow, ("", t)
                else:
                    before, stack[-1] = junction if junction != t else "", (t, arrow)
                if before:
                    out.append({"at": at, "before": before, "sign": t})
            elif k == ",":
                stack[-1] = ("", "")
            elif k != "x":
                stack.append(("", ""))
            elif len(stack) > 1:
                stack.pop()
        if out:
            found[formula] = out
    return formulas.column(found, pa.list_(_struct(at=pa.int32(), before=pa.string(), sign=pa.string())), [])


@automaton("array<struct<at:int,outer:string,inner:string,term:boolean>>")
def _nested(formulas: Formulas) -> pa.Array:
    """What stands in a term's place; ``term``: a call that no predicate of the formula is named like."""
    found = {}
    for formula, toks in formulas.rows("cobuqx"):
        # The names of the open calls, "" for groups.
        stack, outer, calls, out = [], [], set(), []
        for k, t, at in toks:
            if k == "x":
                if stack and stack.pop():
                    outer.pop()
                continue
            inner = name_of(t) if k == "c" else t[0] if k == "q" else t
            if outer and k != "o":
                out.append((at, outer[-1], inner, k == "c"))
            elif k == "c":
                calls.add(inner)
            if k in "oc":
                stack.append(k == "c")
                if k == "c":
                    outer.append(inner)
        if out:
            found[formula] = [{"at": at, "outer": o, "inner": i, "term": call and i not in calls} for at, o, i, call in out]
    return formulas.column(found, pa.list_(_struct(at=pa.int32(), outer=pa.string(), inner=pa.string(), term=pa.bool_())), [])


def nested_predicates(toks: str | Column) -> Column:
    """array<struct<at, outer, inner>>: what stands in a term's place and is no term.

    The stack tells groups from argument lists; inside an argument list (or a
    group in one) a place is a term's. There, a connective, negation or
    quantifier is no term, and a call is none if its name begins with a capital
    letter or also stands as a predicate in the formula. ``outer`` is the name of
    the innermost call around it.
    """
    first = lambda n: F.substr(n, F.lit(1), F.lit(1))
    wrong = F.filter(_nested(toks), lambda e: ~e["term"] | (first(e["inner"]) != F.lower(first(e["inner"]))))
    return F.transform(wrong, lambda e: F.struct(e["at"].alias("at"), e["outer"].alias("outer"), e["inner"].alias("inner")))


# --- negation ------------------------------------------------------------------------

class _Reading:
    """Operator-precedence reduction of one formula.

    ``ops`` has (sign, precedence, place), ``nodes`` (first place, last place, has
    an atom under an odd number of negations, has one under an even number, is
    denied as a whole).
    """

    def __init__(self):
        self.ops, self.nodes, self.negations, self.implications = [], [], [], []

    def reduce(self, least: int, right: bool) -> bool:
        """Apply the operators from the top that bind at least as strongly as ``least``; false if nodes are missing.

        A sign that groups to the right leaves its equals standing. Brackets (precedence 0) stop.
        """
        ops, nodes = self.ops, self.nodes
        while ops and ops[-1][1] > 0 and (ops[-1][1] > least or (ops[-1][1] == least and not right)):
            sign, p, at = ops.pop()
            if len(nodes) < (1 if p == PREFIX else 2):
                return False
            s, e, neg, pos, whole = nodes.pop()
            if p != PREFIX:
                # A term's sign joins two terms to one atom.
                a = nodes.pop()
                nodes.append((a[0], e, a[2] or neg, a[3] or pos, False))
                if sign == "→":
                    self.implications.append({"at": at, "left": a[2], "right": neg})
            elif sign == NEGATION:
                self.negations.append({"at": at, "first": s, "last": e})
                nodes.append((at, e, pos, neg, not whole))
            else:
                nodes.append((at, e, neg, pos, whole))
        return True

    def read(self, toks: list) -> bool:
        """Whether the tokens reduce to one node."""
        ops, nodes = self.ops, self.nodes
        operand, args = False, 0
        for k, t, at in toks:
            if args:
                # An argument list belongs to its atom: only its brackets are followed.
                if k in "co":
                    args += 1
                elif k == "x":
                    args -= 1
                    if not args:
                        s, _, *rest = nodes[-1]
                        nodes[-1] = (s, at + len(t) - 1, *rest)
            elif k in "nc":
                if operand:
                    return False
                operand, args = True, int(k == "c")
                nodes.append((at, at + len(t) - 1, False, True, False))
            elif k in "uqo":
                if operand:
                    return False
                ops.append((t[0], 0 if k == "o" else PREFIX, at))
            elif k in "br":
                least = PRECEDENCE.get(t, TERM if k == "r" else 1)
                if not operand or not self.reduce(least, t == "→"):
                    return False
                ops.append((t[0], least, at))
                operand = False
            elif k == "x":
                if not operand or not self.reduce(1, False) or not ops or _FITS.get(ops[-1][0]) != t:
                    return False
                nodes[-1] = (ops.pop()[2], at + len(t) - 1, *nodes[-1][2:])
            else:
                return False
        return self.reduce(1, False) and operand and not args and len(nodes) == 1 and not ops


_SCOPE = _struct(at=pa.int32(), first=pa.int32(), last=pa.int32())
_SIDES = _struct(at=pa.int32(), left=pa.bool_(), right=pa.bool_())
_UNREAD = {"well_formed": False, "negations": [], "implications": [], "global": False}


@automaton("struct<well_formed:boolean,negations:array<struct<at:int,first:int,last:int>>,"
           "implications:array<struct<at:int,left:boolean,right:boolean>>,global:boolean>")
def negation_analysis(formulas: Formulas) -> pa.Array:
    """What each ¬ and → of a formula covers, by operator-precedence reduction.

    ``well_formed``: the formula reduces to one node. Then ``negations`` has, for
    each ¬, its place and the first and last place of the subformula it covers;
    ``implications`` has each → with whether its left and its right side hold an
    atom under an odd number of that side's negations; ``global`` says whether
    the formula, behind its quantifiers, is a denial as a whole. Lists are in the
    order of their places. In a formula that isn't well-formed they are empty.
    """
    place = lambda e: e["at"]
    found = {}
    for formula, toks in formulas.rows("qcnoxubr,"):
        r = _Reading()
        if r.read(toks):
            found[formula] = {"well_formed": True, "negations": sorted(r.negations, key=place), "implications": sorted(r.implications, key=place), "global": r.nodes[0][4]}
    return formulas.column(found, _struct(well_formed=pa.bool_(), negations=pa.list_(_SCOPE), implications=pa.list_(_SIDES), **{"global": pa.bool_()}), _UNREAD)
