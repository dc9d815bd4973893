import hashlib
import random

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken

from pairwright.llm import bpe
from llm_fixtures import ODD, docs_of, empty, odd  # noqa: F401

PATH = P.path("byte_bpe_50k.tiktoken")
RANKS = bpe.load_ranks(PATH)
ENC = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})


MERGES = bpe.Merges(RANKS)


def ours(text, *before):
    """Ids of a text of a chunk, after others."""
    split = bpe.Pretokenizer(P.PATTERN)
    texts = [*before, text]
    odd = bpe.odd_spaces(pa.array(texts))
    numbers = [split(t, o) for t, o in zip(texts, odd)][-1]
    flat, ends = split.finish()
    count = np.diff(ends, prepend=0)
    learned = bpe.Pretokenizer(P.PATTERN)
    for t, o in zip(texts, odd):
        learned.learn(t, o)
    learned.finish()
    assert list(learned.words) == list(split.words)
    words = [w.encode() for w in split.words]
    ids, n = MERGES.encode(words)
    return bpe.gather(ids, np.cumsum(n) - n, n, bpe.gather(flat, ends - count, count, numbers)).tolist()


@pytest.mark.parametrize("seed", range(4))
def test_same_ids_as_the_library(seed):
    rnd = random.Random(seed)
    for _ in range(400):
        text = "".join(rnd.choice(" \n\tab'sé1.,　x   <|endoftext|>") for _ in range(rnd.randrange(40)))
        assert ours(text) == ENC.encode_ordinary(text)


def test_long_words():
    rnd = random.Random(5)
    for text in ("a" * 5000, "".join(rnd.choice("abcdeé") for _ in range(3000)), " " * 700):
        assert ours(text) == ENC.encode_ordinary(text)


def check(rows, docs):
    got = sorted(tuple(map(str, r)) for r in bpe.digests(docs, PATH, P.PATTERN).collect())
    want = []
    for doc_id, text in rows:
        ids = ENC.encode_ordinary(text or "")
        want.append(tuple(map(str, (doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))))
    assert got == sorted(want)


def test_round_trip_of_odd_rows(odd):
    check(ODD, odd)


def test_decode_alone(spark):
    rows = [(1, [46, 84, 2123]), (2, []), (3, None), (4, [50255])]
    df = spark.createDataFrame(rows, "id int, ids array<int>")
    got = {r.id: bytes(r.decoded) for r in bpe.decode(df, PATH).collect()}
    assert got == {i: ENC.decode_bytes(ids or []) for i, ids in rows}


def test_many_chunks(spark, monkeypatch):
    monkeypatch.setattr(bpe, "CHUNK_BYTES", 300)
    rows = [(i, f"common words here, and number {i} of é\n texts") for i in range(200)]
    check(rows, docs_of(spark, rows).repartition(3).checkpoint())


def test_empty(empty):
    assert bpe.digests(empty, PATH, P.PATTERN).count() == 0
