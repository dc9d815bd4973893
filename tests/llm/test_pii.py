import hashlib
import random
import re

import pytest

from pairwright.llm import pii
from llm_fixtures import ODD, docs_of, empty, odd  # noqa: F401

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(s):
    total = 0
    for i, c in enumerate(reversed(s)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def plain_base(t):
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [("email", *m.span()) for m in EMAIL.finditer(t)]
    out += [("ip", *m.span()) for m in IP.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(t) if 13 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    out += [("phone", *m.span()) for m in PHONE.finditer(t) if 9 <= len(digits(m[0])) <= 15]
    return out


def made_up(seed, n=250):
    rnd = random.Random(seed)
    pieces = ["a@b.co", "x_%@d-e.f.g", "@", ".", " ", "-", "+", "(", ")", "1", "255", "256", "0007", "4111 1111 1111 1111", "4111111111111111",
              "5500-0000-0000-0004", "+1 (206) 555-0100", "+44 20 7946 0958", "é", "\n", "word", "\u0001", "\u0002", "$1", "\\", "_", "12.34.56.78", "\U0001F600"]
    return [(i, "".join(rnd.choice(pieces) for _ in range(rnd.randrange(0, 14)))) for i in range(n)]


def check(rows, docs):
    got = pii.find_pii(docs).collect()
    assert len(got) == len(rows)
    want = {}
    for d, t in rows:
        b = plain_base(t or "")
        want.setdefault(d, []).append((hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in b).encode()).hexdigest(), *(sum(x[0] == k for x in b) for k in ("email", "ip", "card", "phone"))))
    for r in got:
        assert (r.base_sha256, r.n_email, r.n_ip, r.n_card, r.n_phone) in want[r.doc_id], r
    return got


def test_base_spans(spark):
    rows = made_up(1)
    text = dict(rows)
    for r in check(rows, docs_of(spark, rows, extra=True).repartition(3)):
        spans = [s.split(":") for s in r.spans.split(",") if s]
        base = {(k, str(a), str(b)) for k, a, b in plain_base(text[r.doc_id])}
        assert base <= {tuple(s) for s in spans} and r.n_added == len(spans) - len(base)


def test_odd_rows(spark, odd, empty):
    check(ODD, odd)
    assert pii.find_pii(empty).count() == 0


def test_very_long_runs(spark):
    rows = [(1, "1" * 50000), (2, "a" * 50000), (3, "a.b" * 20000 + "@" + "c.d" * 20000), (4, "1 " * 30000), (5, "+1" + "-" * 30000), (6, "1." * 30000)]
    check(rows, docs_of(spark, rows))


def planted(n, seed, decoys=True):
    """(rows, id -> spans to add) with n texts of every sort."""
    rnd = random.Random(seed)
    rows, want = [], {}
    d = lambda k: "".join(rnd.choice("0123456789") for _ in range(k))

    def put(before, kind, span, after):
        i = len(rows)
        rows.append((i, before + span + after))
        want[i] = f"{kind}:{len(before)}:{len(before) + len(span)}" if kind else ""

    for _ in range(n):
        put(rnd.choice(["please call our office at ", "Phone: ", "to reach me on my mobile, dial "]), "phone", f"({rnd.randrange(200, 999)}) {d(3)}-{d(4)}", " today")
        put(rnd.choice(["her SSN is ", "the Social Security number "]), "ssn", f"{rnd.randrange(100, 600)}-{d(2)}-{d(4)}", ", she said")
        put(rnd.choice(["contact ", "my mail is "]), "email", f"jo{d(2)} [at] host{d(2)} [dot] org", " please")
        put("nothing here but ", "", d(3), " words")
        if decoys:
            put(rnd.choice(["call about invoice number ", "ticket "]), "", f"{rnd.randrange(200, 999)}-{d(3)}-{d(4)}", " was paid")
            put(rnd.choice(["we have part ", "Serial: "]), "", f"{rnd.randrange(100, 600)}-{d(2)}-{d(4)}", " in stock")
            put("lines of ", "", f"{rnd.randrange(200, 999)}.{d(3)}.{d(4)}", " and more")
    return rows, want


@pytest.mark.parametrize("n,decoys", [(10, True), (150, True), (150, False)])
def test_loose_spans_are_told_apart(spark, n, decoys):
    rows, want = planted(n, n, decoys)
    got = {r.doc_id: r.spans for r in check(rows, docs_of(spark, rows))}
    for kind in ("phone", "ssn", "email"):
        ids = [i for i, w in want.items() if w.startswith(kind)]
        assert sum(got[i] == want[i] for i in ids) >= 0.9 * len(ids), kind
    clean = [i for i, w in want.items() if not w]
    assert sum(got[i] != "" for i in clean) <= 0.02 * len(clean)


def test_spans_without_evidence_are_not_added(spark):
    rows = [(i, f"we saw 206-555-{1000 + i} and 123-45-{1000 + i} there") for i in range(40)]
    assert {r.spans for r in check(rows, docs_of(spark, rows))} == {""}


def test_nearest_cue_decides(spark):
    texts = {"call about the invoice ": 1, "invoice questions: call ": 2, "recall department ": 0, "CALLS to ": 2, "": 0, "appel ": 0}
    rows = [(i, f"{t}206-555-0147") for i, t in enumerate(texts)]
    got = {r.doc_id: r.cue for r in pii.candidates(docs_of(spark, rows)).where("gen = 'phone_loose'").collect()}
    assert got == dict(enumerate(texts.values()))


def test_boosting_learns_and_sql_agrees(spark):
    rnd = random.Random(2)
    rows = {}
    for _ in range(3000):
        bins = tuple(rnd.randrange(3) for _ in pii.FEATURES)
        n, p = rows.get(bins, (0, 0))
        rows[bins] = (n + 1, p + (bins[1] == 2 and bins[4] > 0))
    table = [(b, float(n), float(p)) for b, (n, p) in sorted(rows.items())]
    model = pii.Boosted(table)
    right = sum((model.score(b) > 0) == (p > n / 2) for b, n, p in table)
    assert right >= 0.99 * len(table)
    df = spark.createDataFrame([b for b, _, _ in table[:200]], ", ".join(f"{f} int" for f in pii.FEATURES))
    for r in df.selectExpr("*", f"{model.sql()} AS s").collect():
        assert abs(r.s - model.score(tuple(r[f] for f in pii.FEATURES))) < 1e-9
    assert pii.Boosted([]).trees == []
