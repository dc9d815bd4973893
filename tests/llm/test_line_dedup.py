import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from pairwright.llm import line_dedup as L
from llm_fixtures import ODD, docs_of, empty, odd  # noqa: F401


def key(line):
    line = line.strip(" \t\n\x0b\x0c\r")
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line)


def brute(rows):
    held = defaultdict(list)
    for i, text in rows:
        for k in {key(line) for line in (text or "").split("\n")}:
            if len(k) >= 20:
                held[k].append(i)
    often = {k: max((i for i in ids if i is not None), default=None) for k, ids in held.items() if len(ids) >= 3}
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if key(x) not in often or often[key(x)] == i]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def run(docs, **kw):
    return sorted((tuple(r) for r in L.line_digests(docs, **kw).collect()), key=str)


def texts(seed, n):
    rnd = random.Random(seed)
    stock = ["Line %s number %d %s" % ("é中ßX"[k % 4] * (k % 5), k, "tail" * (k % 4)) for k in range(60)]
    def line():
        s = rnd.choice(stock)
        s = rnd.choice([s, s.upper(), s + " \t", "\x0b " + s + "\r", s[:19], s + str(rnd.randrange(9))])
        return rnd.choice([s, "", "  ", "unique %d words of text" % rnd.randrange(10**9)])
    return [(i, "\n".join(line() for _ in range(rnd.randrange(0, 12)))) for i in range(n)]


@pytest.mark.parametrize("batch_docs, fanout", [(10**6, 4), (60, 3), (25, 2)])
def test_equals_brute_force(spark, batch_docs, fanout):
    """One batch, and many with several levels of runs."""
    rows = texts(batch_docs, 300)
    assert run(docs_of(spark, rows, extra=True).repartition(4), batch_docs=batch_docs, fanout=fanout) == brute(rows)


def test_odd_rows(spark, odd):
    assert run(odd) == brute(ODD)


def test_nulls_ties_and_repeats(spark):
    line = "a line that is found in several documents"
    rows = [(None, line), (None, line), (None, line), (7, line + "\nx\n" + line), (7, line), (3, line.upper() + "\n\n"), (2, None), (1, ""),
            (5, "é" * 19), (4, "é" * 19), (6, "é" * 19), (8, "é" * 20), (9, "é" * 20), (10, "É" * 20), (11, "é" * 20),
            (12, "two documents only hold this"), (13, "two documents only hold this")]
    got = run(docs_of(spark, rows), batch_docs=4, fanout=2)
    assert got == brute(rows)
    only_null = [(None, line)] * 3
    assert run(docs_of(spark, only_null)) == brute(only_null)


def test_a_line_in_a_third_of_all_documents(spark):
    """It is one row an Arrow batch, not one a document."""
    rows = [(i, "unique line number %d of the table\n" % i + ("the very frequent line of this table" if i % 3 == 0 else "")) for i in range(3000)]
    docs = docs_of(spark, rows).repartition(4)
    hashes = L.hash_rows(docs.select("doc_id", "text", F.lit(0).alias("batch"))).cache()
    hot = hashes.groupBy("h1", "h2").agg(F.count("*").alias("rows"), F.sum(F.size("ids")).alias("docs")).orderBy(F.desc("docs")).first()
    assert hot.docs == 1000 and hot.rows <= 8
    assert run(docs, batch_docs=500) == brute(rows)


def test_runs_are_levelled_and_not_moved(spark):
    """Runs meet a batch and each other in their buckets, without an exchange."""
    runs = L.LineRuns(spark, buckets=4, fanout=3)
    def batch(a, b):
        return runs.gather(spark.range(a, b).select(F.xxhash64("id").alias("h1"), F.col("id").alias("h2"), F.array(F.col("id") * 10).alias("ids")))
    counts = []
    for k in range(9):
        assert runs.fresh(batch(50 * k, 50 * k + 100)).count() == (100 if k == 0 else 50)
        runs.add(batch(50 * k, 50 * k + 100))
        counts.append([len(level) for level in runs.levels])
    assert counts == [[1], [2], [0, 1], [1, 1], [2, 1], [0, 2], [1, 2], [2, 2], [0, 0, 1]]
    runs.add(batch(400, 600))
    got = {r.h2: (r.docs, r.top) for r in runs.merged().collect()}
    assert runs.merged().count() == 600
    assert got == {i: ((i < 500) + (50 <= i < 450) + (i >= 400), i * 10) for i in range(600)}
    plan = runs.merged()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    plan = runs.fresh(spark.table(runs.live()[0]))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "SortMergeJoin" in plan
    runs.clean()
    assert not spark.catalog.tableExists(f"{runs.name}_0") and runs.live() == []


def test_empty(spark, empty):
    assert run(empty) == []


def test_query_equals_its_sql(spark):
    import duckdb

    from pairwright.llm.queries import ORACLE_SQL, QUERIES

    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM read_parquet('/root/testdata/sf0.01/documents.parquet')")
    want = con.execute(ORACLE_SQL["op13_line_dedup"]).fetchall()
    got = QUERIES["op13_line_dedup"](spark, "/root/testdata/sf0.01").collect()
    assert any(r[2] for r in want) and sorted(map(tuple, got)) == sorted(want)
