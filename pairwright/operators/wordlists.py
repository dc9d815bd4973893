"""Word lists as tables: rows whose text holds an entry of a list of any size.

An entry is one or more words. It is found where its words stand next to each
other among the lowercased whitespace tokens of the text, punctuation included
(``later.`` is not ``later``), the same rule as for the fixed adverb lists. The
list is a table (entry, and any columns), never a pattern of literals.

The list's size is measured first. Up to ``trie_bytes`` it goes to every task as
a trie of tokens, and each text is read once, narrow. A larger list is joined:
the text's runs of as many words as the list's entries have meet the entries by
equality. Runs that are very frequent (over ``1 / HOT_SHARE`` of all) are dealt
to ``SALTS`` copies of their entry, so no key holds more than a task's share.

Defined cases: a null text holds nothing; null and blank entries are left out;
entries that differ only in case or spaces are one; repeated rows stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwright.functions.text import lower_tokens
from pairwright.session import scratch_path, ship_package

#: Bytes of entries up to which a list is sent to the tasks.
TRIE_BYTES = 16 << 20
SALTS = 32
HOT_SHARE = 1000


def entries_of(words: DataFrame, entry: str = "entry") -> DataFrame:
    """(gram, size): the different entries, lowercased, words parted by one space."""
    tokens = words.select(lower_tokens(entry).alias("t")).where(F.size("t") > 0)
    return tokens.select(F.array_join("t", " ").alias("gram"), F.size("t").alias("size")).distinct()


class Trie:
    """Entries by their words; ``hits`` gives the entries found in a token list."""

    def __init__(self, grams: list[str]):
        self.root: dict = {}
        for gram in grams:
            node = self.root
            for word in gram.split(" "):
                node = node.setdefault(word, {})
            node[None] = gram

    def hits(self, tokens: list[str]) -> list[str]:
        found = {}
        for k in range(len(tokens)):
            node, at = self.root.get(tokens[k]), k + 1
            while node:
                if None in node:
                    found[node[None]] = True
                node, at = node.get(tokens[at]) if at < len(tokens) else None, at + 1
        return sorted(found)


def _by_trie(rows: DataFrame, grams: list[str], out: str) -> DataFrame:
    spark = rows.sparkSession
    ship_package(spark)
    sent = spark.sparkContext.broadcast(grams)

    def run(batches) -> Iterator[pa.RecordBatch]:
        trie = Trie(sent.value)
        for b in batches:
            found = [None if t is None else trie.hits(t) for t in b.column("_t").to_pylist()]
            kept = b.select([c for c in b.schema.names if c != "_t"])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(found, pa.list_(pa.string()))], [*kept.schema.names, out])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "_t"]
    return rows.mapInArrow(run, ", ".join([*fields, f"`{out}` array<string>"]))


def _by_join(rows: DataFrame, entries: DataFrame, out: str) -> DataFrame:
    spark = rows.sparkSession
    # Stored with a number a row, so rows are the same in every later read.
    path = scratch_path(spark, "word-list-rows")
    rows.withColumn("_row", F.monotonically_increasing_id()).write.parquet(path)
    kept = spark.read.parquet(path)
    sizes = [r["size"] for r in entries.select("size").distinct().collect()]

    def runs(n: int):
        """All runs of ``n`` tokens."""
        every = F.transform(F.sequence(F.lit(1), F.size("_t") - n + 1), lambda i: F.array_join(F.slice("_t", i, F.lit(n)), " "))
        return F.when(F.size("_t") >= n, every).otherwise(F.array().cast("array<string>"))

    many = [runs(n) for n in sizes]
    grams = (kept.select("_row", lower_tokens("_text").alias("_t"))
             .select("_row", F.explode(F.array_distinct(F.concat(*many) if many else F.array().cast("array<string>"))).alias("gram")))
    # Only entries of the list count as hot; the counts combine before their shuffle.
    counts = grams.groupBy("gram").agg(F.count("*").alias("n")).join(entries, "gram", "left_semi")
    total = kept.count()
    hot = [r.gram for r in counts.where(F.col("n") * HOT_SHARE > F.lit(total)).orderBy(F.desc("n")).limit(HOT_SHARE).collect()]
    is_hot = F.array_contains(F.lit(hot), F.col("gram")) if hot else F.lit(False)
    salted = grams.withColumn("_s", F.when(is_hot, F.pmod("_row", F.lit(SALTS))).otherwise(0).cast("int"))
    dealt = entries.select("gram", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))).alias("_s"))
    hits = salted.join(dealt, ["gram", "_s"]).groupBy("_row").agg(F.array_sort(F.collect_set("gram")).alias(out))
    found = F.when(F.col("_text").isNotNull(), F.coalesce(F.col(out), F.array().cast("array<string>"))).alias(out)
    return kept.join(hits, "_row", "left").select(*[c for c in rows.columns if c != "_text"], found)


def word_hits(df: DataFrame, words: DataFrame, col: str = "nl_sentence", entry: str = "entry", out: str = "hits", trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """``df`` with the list's entries that the text holds, sorted; null for a null text."""
    entries = entries_of(words, entry).cache()
    size = entries.agg(F.sum(F.octet_length("gram") + 16)).first()[0] or 0
    if size <= trie_bytes:
        grams = [r.gram for r in entries.select("gram").collect()]
        return _by_trie(df.withColumn("_t", lower_tokens(col)), grams, out)
    return _by_join(df.withColumn("_text", F.col(col)), entries, out)


def word_matches(df: DataFrame, words: DataFrame, out: str = "hits", **kw) -> DataFrame:
    """Rows whose text holds an entry, with the entries found."""
    return word_hits(df, words, out=out, **kw).where(F.size(out) > 0)


def remove_word_matches(df: DataFrame, words: DataFrame, **kw) -> DataFrame:
    """Rows whose text holds no entry; a null text is dropped, as by the fixed lists."""
    return word_hits(df, words, out="_hits", **kw).where(F.size("_hits") == 0).drop("_hits")
