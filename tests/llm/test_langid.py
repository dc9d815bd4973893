import random

import numpy as np
from pyspark.sql import functions as F

from pairwright.llm import langid
from llm_fixtures import ODD, docs_of, empty, odd  # noqa: F401

SYLLABLES = {"aa": ["ka", "lo", "mi", "tu"], "bb": ["the", "ing", "er", "on"], "cc": ["sch", "ü", "ei", "ge"]}


def sentence(lang, n, rnd):
    return " ".join("".join(rnd.choices(SYLLABLES[lang], k=rnd.randrange(1, 4))) for _ in range(n))


def test_held_out_accuracy_and_no_leak(spark):
    rnd = random.Random(1)
    rows = [(i, sentence(lang, rnd.randrange(3, 30), rnd), lang) for i in range(400) for lang in [rnd.choice(list(SYLLABLES))]]
    docs = docs_of(spark, rows, extra=True)
    got = {r.doc_id: r for r in langid.identify(docs).collect()}
    held = [r for r in rows if got[r[0]].held_out]
    assert len(held) > 50
    assert np.mean([got[i].lang_pred == lang for i, _, lang in held]) >= 0.99
    # Other labels on held-out rows change nothing.
    lied = docs_of(spark, [(i, t, "aa" if got[i].held_out else lang) for i, t, lang in rows])
    assert {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(lied).collect()} == {k: (r.lang_pred, r.score) for k, r in got.items()}


def test_odd_rows(spark, odd, empty):
    rows = langid.identify(odd).collect()
    assert len(rows) == len(ODD)
    assert all(0 <= r.score <= 1 for r in rows)
    assert {r.lang_pred for r in rows if r.doc_id in (1, 2, 3, 7)} == {"und"}
    assert langid.identify(empty).count() == 0
    alone = docs_of(spark, [(i, "words", None) for i in range(8)])
    assert {r.lang_pred for r in langid.identify(alone).collect()} == {"und"}


def test_bundle_is_the_sum_of_bound_vectors():
    text = "Ab ç9b"
    raw, offsets = np.frombuffer(text.encode(), np.uint8), np.array([0, len(text.encode())])
    row, gram = langid.trigrams(raw, offsets)
    cls = langid.letter_classes()
    seq = [0, cls[ord("a")], cls[ord("b")], 0, cls[ord("ç")], 0, cls[ord("b")], 0]
    assert gram.tolist() == [int(a) << 12 | int(b) << 6 | int(c) for a, b, c in zip(seq, seq[1:], seq[2:])]
    letters = langid.letter_vectors(64)
    a, b, c = seq[:3]
    want = np.roll(letters[a], 2) * np.roll(letters[b], 1) * letters[c]
    assert (langid.gram_vectors(gram[:1], letters)[0] == want).all()


def test_texts_of_no_learned_language_are_dropped(spark):
    """Random letters and unknown scripts go, clean texts stay, short ones too."""
    rnd = random.Random(3)
    rows = [(i, sentence(lang, rnd.choice([1, 3, 8, 30, 120]), rnd), lang) for i in range(1500) for lang in [rnd.choice(list(SYLLABLES))]]
    letters = lambda n: " ".join("".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randrange(2, 10))) for _ in range(n))
    signs = lambda n: "".join(chr(rnd.randrange(0x4E00, 0x9FA5)) for _ in range(n))
    rows += [(10000 + i, letters(rnd.choice([30, 120, 400])), None) for i in range(100)] + [(20000 + i, signs(rnd.choice([100, 500])), None) for i in range(100)]
    rows += [(30000, None, None), (30001, "", None), (30002, "12 34", None)]
    docs = docs_of(spark, rows, extra=True).selectExpr("*", "1 AS cut_bin", "2 AS CUT_LANG")
    learned = ~langid.held_out() & F.col("lang").isNotNull()
    langs, protos = langid.prototypes(docs.where(learned))
    predicted = langid.predict(docs, langs, protos, pred="p", score="s").cache()
    kept = langid.drop_unlearned(predicted, langid.cutoffs(predicted.where(learned), "p", "s"), "p", "s")
    assert kept.columns == predicted.columns
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    clean = [i for i in ids if i < 10000]
    assert len(clean) >= 0.98 * 1500 and len(set(ids)) == len(ids)
    assert sum(10000 <= i < 20000 for i in ids) <= 5 and sum(20000 <= i < 30000 for i in ids) <= 5
    assert not {30000, 30001, 30002} & set(ids)
    nothing = langid.drop_unlearned(predicted, langid.cutoffs(predicted.where("false"), "p", "s"), "p", "s")
    assert nothing.count() >= 1500
