import pytest


def docs_of(spark, rows, extra=False):
    """documents rows from (doc_id, text[, lang]); with ``extra``, columns whose names clash with ours."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "src0", None if r[1] is None else len(r[1])) for r in rows]
    df = spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long")
    if extra:
        for name in ("key", "score", "kept", "t", "digest", "chunk", "shard", "cls", "g", "n", "uid", "lang_pred", "spans"):
            df = df.selectExpr("*", f"'x' AS {name}")
    return df


#: Rows that every operator must take: nulls, empties, ties, repeats, a long text.
ODD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one"), (5, "one"), (None, "no id here but some words follow it"),
    (6, "é" * 10), (7, "123 456"), (8, "the quick brown fox jumps over the lazy dog " * 400),
    (9, "\u0001a\u0002 b@c.de \u0000 z"), (10, "x" * 30000), (11, "\U0001F600 \U00020000 中文字符 text"),
]


@pytest.fixture(scope="session")
def odd(spark):
    return docs_of(spark, ODD, extra=True)


@pytest.fixture(scope="session")
def empty(spark):
    return docs_of(spark, ODD).where("false")
