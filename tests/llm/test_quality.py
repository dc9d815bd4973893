import re
from collections import Counter, defaultdict

import numpy as np

from pairwright.llm import quality as Q
from llm_fixtures import ODD, docs_of, empty, odd  # noqa: F401

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    t = text or ""
    w = WORD.findall(t)
    places = defaultdict(list)
    for k in range(len(w) - 4):
        places[tuple(w[k:k + 5])].append(k)
    covered = {p + d for ps in places.values() if len(ps) > 1 for p in ps for d in range(5)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(covered), len(w) < 10 or 100 * len(covered) > 20 * len(w)


def test_base_statistics(spark, odd, empty):
    rows = ODD + [(50, "a b c d e a b c d e"), (51, "x\ny\nx\n \n\nx <b>|#"), (52, "w1 w2 w3 w4 w5 w6 w1 w2 w3 w4 w5 q r s")]
    got = Q.quality_rules(docs_of(spark, rows, extra=True)).collect()
    assert sorted(str((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)) for r in got) == sorted(str((d, *plain(t))) for d, t in rows)
    assert all(not r.kept for r in got if r.base_failed)
    assert Q.quality_rules(empty).count() == 0


def test_bands_reject_what_differs(spark):
    rng = np.random.default_rng(0)
    syllables = ["the", "ing", "er", "on", "re", "at"]
    def text(s, n):
        return " ".join("".join(rng.choice(s, 3)) for _ in range(n))

    rows = [(i, text(syllables, 120)) for i in range(300)] + [(1000, text(list("qxzjkv"), 200)), (1001, text(["the"], 60) + " on " + text(["er"], 2))]
    got = {r.doc_id: r for r in Q.quality_rules(docs_of(spark, rows)).collect()}
    assert not got[1000].kept and not got[1000].base_failed
    assert sum(got[i].kept for i in range(300)) >= 297


def test_model_is_a_distribution_and_backs_off():
    rng = np.random.default_rng(2)
    raw = rng.choice(np.frombuffer(b"abcd e", np.uint8), 3000)
    _, code = Q.grams(raw, np.array([0, 1500, 3000]))
    g, n = np.unique(code, return_counts=True)
    model = Q.KneserNey(g, n)
    for head in (0, int(g[5]) // Q.CLASSES, 31 * Q.CLASSES ** 2 + 7):
        p = 10 ** model.score(head * Q.CLASSES + np.arange(Q.CLASSES))
        assert abs(p.sum() - 1) < 1e-4 and (p > 0).all()
    assert (np.diff(model.keys.astype(object)) > 0).all()


def test_counts_cover_all_texts(spark):
    rows = [(i, f"text {i}") for i in range(50)]
    got = dict(map(tuple, Q.count_grams(docs_of(spark, rows).repartition(4)).collect()))
    want = Counter()
    for _, t in rows:
        raw = np.frombuffer(t.encode(), np.uint8)
        want.update(Q.grams(raw, np.array([0, len(raw)]))[1].tolist())
    assert got == want


def strings_of(rows):
    """n-grams of every text as tuples of code points, ends as None; ASCII only."""
    pad = [None] * (Q.ORDER - 1)
    return [[tuple(seq[k:k + Q.ORDER]) for k in range(len(seq) - Q.ORDER + 1)] for seq in (pad + [ord(c) for c in t] + [None] for _, t in rows)]


def test_grams_keep_every_character():
    texts = ["aA.,", "жЖжж", "\u4e2d\u4e2e\u4e34", "\U0001F600\U0001F607", "\u0000 ", "\u077f\u0780"]
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0] + [len(t.encode()) for t in texts])
    sym, first = Q.codes(raw, offsets)
    seen = [tuple(sym[a:b]) for a, b in zip(first, first[1:])]
    assert [len(x) for x in seen] == [4, 4, 6, 4, 3, 3]
    assert (sym > 0).all() and (sym < Q.CLASSES).all()
    # Signs, cases and characters seven code points apart differ.
    for x, text in zip(seen, texts):
        step = len(x) // len(text)
        if len(x) == step * len(text):
            assert len({x[k:k + step] for k in range(0, len(x), step)}) == len(set(text))
    of, code = Q.grams(raw, offsets)
    assert np.bincount(of).tolist() == [len(x) + 1 for x in seen]
    assert (code >= 0).all()


def plain_logs(texts):
    """log10 probability by interpolated modified Kneser-Ney, in dictionaries."""
    counts = [Counter(g for t in texts for g in t)]
    for _ in range(Q.ORDER - 1):
        counts.append(Counter(g[1:] for g in counts[-1]))
    counts.reverse()
    tables = []
    for c in counts:
        d = Q._discounts(*[sum(n == k for n in c.values()) for k in (1, 2, 3, 4)])
        total, weight = Counter(), Counter()
        for g, n in c.items():
            total[g[:-1]] += n
            weight[g[:-1]] += d[min(n, 3)]
        tables.append((c, d, total, weight))

    def p(g):
        if not g:
            return 1 / Q.CLASSES
        c, d, total, weight = tables[len(g) - 1]
        n, below = c.get(g, 0), p(g[1:])
        return (n - d[min(n, 3)] + weight[g[:-1]] * below) / total[g[:-1]] if total[g[:-1]] else below

    return lambda g: np.log10(p(g))


def test_perplexity_equals_plain_model_of_the_other_half(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(rng.choice(["Ab", "ab", "a,b", "a.b", "cd!", "xyz"], 12))) for i in range(24)] + [(100, "qq zz 12 345 qq zz 12 345 77")]
    docs = docs_of(spark, rows)
    half = {r.doc_id: r.h for r in docs.select("doc_id", Q.half_of(docs.text).alias("h")).collect()}
    grams = dict(zip([d for d, _ in rows], strings_of(rows)))
    models = [plain_logs([grams[d] for d, _ in rows if half[d] == h]) for h in (0, 1)]
    want = {d: 10 ** -np.mean([models[1 - half[d]](g) for g in grams[d]]) for d, _ in rows}
    # All n-grams in the tasks' arrays, some of them, none.
    for head in (10 ** 6, 60, 0):
        monkeypatch.setattr(Q, "HEAD", head)
        got = {r.doc_id: r.perplexity for r in Q.quality_rules(docs).collect()}
        assert got.keys() == want.keys()
        assert all(abs(got[d] / want[d] - 1) < 1e-4 for d in want)


def test_table_grows_with_the_texts_and_copies_do_not_vouch(spark, monkeypatch):
    monkeypatch.setattr(Q, "HELD", 50)
    rows = [(i, chr(0x4e00 + i) * 3 + chr(0x400 + i)) for i in range(40)]
    logs = Q.gram_logs(Q.count_grams(docs_of(spark, rows), halves=True))
    assert logs.count() == len({g for t in strings_of([(i, t.replace(chr(0x4e00 + i), "\ue000" + chr(0xf000 + i))) for i, t in rows]) for g in t})
    rng = np.random.default_rng(6)
    clean = [(i, " ".join(rng.choice(["река", "дом", "лес", "поле", "вода", "гора"], 80)), "ru") for i in range(120)]
    junk = "".join(rng.choice(list("абвгдежзиклмнопрстуфхцчшщ    "), 400))
    got = {r.doc_id: r for r in Q.quality_rules(docs_of(spark, clean + [(1000 + k, junk, "ru") for k in range(30)])).collect()}
    assert not any(got[1000 + k].kept for k in range(30))
    assert sum(got[i].kept or got[i].base_failed for i in range(120)) >= 118
