"""Quality rules: text statistics and perplexity bands.

The model is a modified Kneser-Ney model of order ``ORDER`` over the texts'
real characters: a code is one character below U+0780 (Latin, Greek, Cyrillic,
Hebrew, Arabic, as written), any other character is two codes; nothing is
folded, so the table of n-grams grows with the texts. Spark counts the n-grams
of every text, combined per task before the shuffle, and keeps them as tables:
continuation counts, context totals and interpolated probabilities are
groupings and joins, order by order (``gram_logs``).

Texts fall into two halves by a hash of the text, and each half is scored by
the model of the other, so that no text, nor a copy of it, vouches for itself.
Every n-gram of a text is a row of the table, with its back-off worked out.
Frequent n-grams (at most ``HEAD``) go to the tasks in sorted arrays; a text's
others are joined to the table by Spark and added, so no probability is left
out whatever the table's size.

Every text gets its perplexity per code. Each language has a lower and an
upper bound from the quartiles of its own texts (on the log scale, counted in
bins of 0.001): a text is rejected further than ``max(FENCE * iqr, LEAST) +
SPREAD / sqrt(codes)`` outside them; the last term is the spread that the
mean over few codes has by chance (a standard deviation measured 0.5), so
short texts aren't rejected for being short. The quartiles come from the texts
that pass the base rules.

Defined cases: a null text has no words and fails the base rules; a null
language is a language of its own; a language with no text that passes has no
bounds; repeated rows are rows of their own; an empty table gives no rows;
other columns of the input are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pairwright.llm.textvec import IS_SPACE, Words, code_points, mix64, slabs, small_batches, span_hashes, window_hashes, windows_in_rows
from pairwright.session import checkpoint_root, scratch_path, ship_package

ORDER = 5
#: 0 edge, 1-1919 characters, 1920-3007 and 3008-4031 first and second codes of all others.
BITS = 12
CLASSES = 1 << BITS
DIRECT, SECOND = 1920, 3008
#: N-grams that the tasks hold; the others are joined.
HEAD = 1_000_000
#: Different n-grams that a task combines before it hands them on.
HELD = 2_000_000
#: Distance of the bounds from the quartiles, in log10 of perplexity.
FENCE, LEAST, SPREAD = 1.0, 0.025, 1.2
WINDOW = 5
SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True


def codes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The codes of all characters, and where each row's codes start (rows + 1 entries)."""
    cps = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
    wide = (cps == 0) | (cps >= DIRECT)
    ends = np.zeros(len(cps) + 1, np.int64)
    np.cumsum(1 + wide, out=ends[1:])
    out = np.zeros(ends[-1], np.int64)
    out[ends[:-1]] = np.where(wide, DIRECT + (cps >> 10), cps)
    out[ends[:-1][wide] + 1] = SECOND + (cps[wide] & 1023)
    return out, ends[code_points(raw)[offsets]]


def grams(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, n-gram) of every code with its ORDER - 1 predecessors, end included."""
    rows = len(offsets) - 1
    sym, first = codes(raw, offsets)
    n = np.diff(first)
    pad = ORDER - 1
    row = np.repeat(np.arange(rows), n)
    seq = np.zeros(len(sym) + rows * (pad + 1), np.int64)
    seq[np.arange(len(sym)) + row * (pad + 1) + pad] = sym
    of = np.repeat(np.arange(rows), n + pad + 1)
    if not len(seq):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    m = len(seq) - pad
    code = np.zeros(m, np.int64)
    for k in range(ORDER):
        code = (code << BITS) + seq[k:k + m]
    inside = of[pad:] == of[:m]
    return of[:m][inside], code[inside]


def half_of(text: Column) -> Column:
    """0 or 1, by the text: copies fall into the same half."""
    return F.pmod(F.xxhash64(text), F.lit(2)).cast("int")


def count_grams(docs: DataFrame, text_col: str = "text", halves: bool = False) -> DataFrame:
    """(gram, n) over all texts, or with ``halves`` (gram, n0, n1) over the texts of either half."""
    small_batches(docs.sparkSession)
    ship_package(docs.sparkSession)

    def rows_of(key: np.ndarray, n: np.ndarray):
        for at in range(0, len(key), 100_000):
            k = key[at:at + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(k >> 1), pa.array((k & 1).astype(np.int32)), pa.array(n[at:at + 100_000])], ["gram", "half", "n"])

    def run(batches):
        key, n, new = np.zeros(0, np.int64), np.zeros(0, np.int64), []
        for b in batches:
            half = b.column("half").to_numpy()
            for i, j, raw, offsets in slabs(b.column("t")):
                of, code = grams(raw, offsets)
                new.append(np.unique((code << 1) | half[i:j][of], return_counts=True))
            if sum(len(k) for k, _ in new) >= HELD:
                key, n = _combined([(key, n), *new])
                new = []
                if len(key) >= HELD:
                    yield from rows_of(key, n)
                    key, n = key[:0], n[:0]
        yield from rows_of(*_combined([(key, n), *new]))

    t = F.col(text_col).cast("string")
    rows = docs.select(t.alias("t"), half_of(t).alias("half")).where("t is not null")
    found = rows.mapInArrow(run, "gram long, half int, n long").groupBy("gram")
    if not halves:
        return found.agg(F.sum("n").alias("n"))
    return found.agg(*[F.sum(F.when(F.col("half") == h, F.col("n")).otherwise(0)).alias(f"n{h}") for h in (0, 1)])


def _combined(parts) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys of all parts, each with its sum."""
    key = np.concatenate([k for k, _ in parts])
    n = np.concatenate([c for _, c in parts])
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][:len(key)])
    return key[start], np.add.reduceat(n, start) if len(start) else n


def _discounts(n1: int, n2: int, n3: int, n4: int) -> np.ndarray:
    """Discounts of counts 0, 1, 2, 3 and more, from how many n-grams have the counts 1 to 4.

    None is 0: a context without discounts would leave nothing for codes it hasn't seen.
    """
    if not (n1 and n2 and n3):
        return np.array([0, 0.5, 0.75, 0.9])
    y = n1 / (n1 + 2 * n2)
    return np.clip([0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3], [0, 0.1, 0.1, 0.1], [0, 1, 2, 3])


def gram_logs(counts: DataFrame) -> DataFrame:
    """(gram, n, log0, log1): every n-gram of ``count_grams(halves=True)``, how often it
    occurs, and the log10 probability of its last code in the model of either half."""
    spark = counts.sparkSession
    path = scratch_path(spark, "grams")
    order = counts
    for k in range(ORDER, 0, -1):
        order.write.parquet(f"{path}/{k}")
        order = spark.read.schema("gram long, n0 long, n1 long").parquet(f"{path}/{k}")
        # Lower orders count the different codes seen before.
        order = order.groupBy(_last("gram", k - 1).alias("gram")).agg(*[F.sum((F.col(n) > 0).cast("long")).alias(n) for n in ("n0", "n1")])
    below = None
    for k in range(1, ORDER + 1):
        table = spark.read.schema("gram long, n0 long, n1 long").parquet(f"{path}/{k}")
        few = table.agg(*[F.count(F.when(F.col(f"n{h}") == c, 1)) for h in (0, 1) for c in (1, 2, 3, 4)]).first()
        off = [_taken_off(F.col(f"n{h}"), _discounts(*few[4 * h:4 * h + 4])) for h in (0, 1)]
        table = table.withColumns({"head": F.shiftright("gram", BITS), "tail": _last("gram", k - 1), "d0": off[0], "d1": off[1]})
        heads = table.groupBy("head").agg(*[F.sum(f"{c}{h}").cast("double").alias(f"{c}{h}_all") for c in "nd" for h in (0, 1)])
        table = table.join(heads, "head")
        if below is None:
            table = table.withColumns({f"below{h}": F.lit(1 / CLASSES) for h in (0, 1)})
        else:
            table = table.join(below.select(F.col("gram").alias("tail"), F.col("p0").alias("below0"), F.col("p1").alias("below1")), "tail")
        # A context that the half doesn't have leaves it to the lower order.
        p = {f"p{h}": F.expr(f"CASE WHEN n{h}_all > 0 THEN (n{h} - d{h} + d{h}_all * below{h}) / n{h}_all ELSE below{h} END") for h in (0, 1)}
        below = table.withColumns(p).select("gram", "n0", "n1", "p0", "p1")
    below.select("gram", (F.col("n0") + F.col("n1")).alias("n"), *[F.log10(f"p{h}").cast("float").alias(f"log{h}") for h in (0, 1)]).write.parquet(f"{path}/logs")
    return spark.read.schema("gram long, n long, log0 float, log1 float").parquet(f"{path}/logs")


def _last(gram: str, k: int) -> Column:
    """The last k codes of an n-gram."""
    return F.col(gram).bitwiseAND(F.lit((1 << BITS * k) - 1).cast("long"))


def _taken_off(n: Column, d: np.ndarray) -> Column:
    return F.when(n == 0, 0.0).when(n == 1, float(d[1])).when(n == 2, float(d[2])).otherwise(float(d[3]))


def head_of(logs: DataFrame, most: int | None = None) -> tuple[int, pa.Table]:
    """(least count, table): the n-grams found at least so often, ``HEAD`` or ``most`` of them at most."""
    most = HEAD if most is None else most
    found, least = 0, 63
    for bits, n in sorted(logs.groupBy(F.floor(F.log2("n")).cast("int").alias("bits")).count().collect(), reverse=True):
        found += n
        if found > most:
            break
        least = bits
    least = 1 << least if least < 63 else 1 << 62
    return least, logs.where(F.col("n") >= least).select("gram", "log0", "log1").toArrow()


class KneserNey:
    """The model of one table of counts in one machine's memory: sorted hash
    arrays of interpolated probabilities and back-off weights. ``gram_logs``
    gives the same probabilities for tables of any size."""

    def __init__(self, gram: np.ndarray, n: np.ndarray):
        order = np.argsort(gram)
        counts = [(gram[order].astype(np.int64), n[order].astype(np.int64))]
        # Lower orders count the different symbols seen before.
        for k in range(ORDER - 1, 0, -1):
            counts.append(np.unique(counts[-1][0] % CLASSES ** k, return_counts=True))
        counts.reverse()
        lower = np.full(1, 1 / CLASSES)
        lower_gram = np.zeros(1, np.int64)
        keys, values, back_keys, back_values = [], [], [], []
        for k, (g, c) in enumerate(counts, 1):
            d = _discounts(*[int((c == j).sum()) for j in (1, 2, 3, 4)])[np.minimum(c, 3)]
            context = g // CLASSES
            heads, inv = np.unique(context, return_inverse=True)
            total = np.bincount(inv, c)
            weight = np.bincount(inv, d) / total
            below = lower[np.searchsorted(lower_gram, g % CLASSES ** (k - 1))] if k > 1 else lower[0]
            p = (c - d) / total[inv] + weight[inv] * below
            keys.append(self._hash(g, k))
            values.append(np.log10(p))
            back_keys.append(self._hash(heads, k - 1))
            back_values.append(np.log10(np.maximum(weight, 1e-12)))
            lower, lower_gram = p, g
        self.keys, self.logs = self._sorted(keys, values)
        self.back_keys, self.back_logs = self._sorted(back_keys, back_values)

    @staticmethod
    def _hash(gram: np.ndarray, order: int) -> np.ndarray:
        return mix64(gram.astype(np.uint64) + np.uint64((order + 1) << 60))

    @staticmethod
    def _sorted(keys, values):
        k, v = np.concatenate(keys), np.concatenate(values).astype(np.float32)
        order = np.argsort(k)
        return k[order], v[order]

    def score(self, code: np.ndarray) -> np.ndarray:
        """log10 probability of the last symbol of every n-gram."""
        out = np.zeros(len(code), np.float64)
        left = np.arange(len(code))
        for k in range(ORDER, 0, -1):
            if not len(left):
                return out
            g = code[left].astype(np.int64) % CLASSES ** k
            spot, hit = _find(self.keys, self._hash(g, k))
            out[left[hit]] += self.logs[spot[hit]]
            left, g = left[~hit], g[~hit]
            spot, hit = _find(self.back_keys, self._hash(g // CLASSES, k - 1))
            out[left[hit]] += self.back_logs[spot[hit]]
        out[left] += np.log10(1 / CLASSES)
        return out


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    spot = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return spot, keys[spot] == wanted


def repeat_words(raw: np.ndarray, words: Words) -> np.ndarray:
    """Per row: words inside a WINDOW-word window that the row holds twice or more."""
    h = window_hashes(span_hashes(raw, words.starts, words.ends, lower=False), WINDOW)
    start, row = windows_in_rows(words.first, WINDOW)
    order = np.lexsort((h[start], row))
    s, r, x = start[order], row[order], h[start[order]]
    same = (r[1:] == r[:-1]) & (x[1:] == x[:-1])
    twice = np.zeros(len(s), bool)
    twice[1:] |= same
    twice[:-1] |= same
    edge = np.zeros(len(words) + WINDOW + 1, np.int64)
    np.add.at(edge, s[twice], 1)
    np.add.at(edge, s[twice] + WINDOW, -1)
    covered = np.cumsum(edge)[:len(words)] > 0
    return np.bincount(words.row, covered, minlength=len(words.first) - 1).astype(np.int64)


def dup_lines(text: str | None) -> int:
    """Lines with a word that equal an earlier line."""
    if not text or "\n" not in text:
        return 0
    lines = [x for x in text.split("\n") if x.strip(" \t\r\x0b\x0c")]
    return len(lines) - len(set(lines))


class Head:
    """Sorted n-grams with their log10 probabilities for texts of half 0 and half 1."""

    def __init__(self, table: pa.Table):
        gram = table.column("gram").to_numpy()
        order = np.argsort(gram)
        self.gram = gram[order]
        # Texts of a half are scored by the other's model.
        self.logs = np.stack([table.column(c).to_numpy()[order] for c in ("log1", "log0")])


def measure(docs: DataFrame, head: Head, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """uid, doc_id, lang, the base statistics, half, codes, the sum of the logs of the
    n-grams in ``head``, and the n-grams out of it with their number (``rest``)."""
    held = docs.sparkSession.sparkContext.broadcast(head)
    t = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), t.alias("t"), half_of(t).alias("half"))
    id_type = dict(rows.dtypes)["doc_id"]

    def run(batches):
        uid = TaskContext.get().partitionId() << 40
        for b in batches:
            lines = [dup_lines(t) for t in b.column("t").to_pylist()]
            halves = b.column("half").to_numpy()
            for i, j, raw, offsets in slabs(b.column("t")):
                words = Words(raw, offsets)
                n = j - i
                inner = (raw & 0xC0) != 0x80
                row = np.repeat(np.arange(n), np.diff(offsets))
                of, code = grams(raw, offsets)
                spot, hit = _find(held.value.gram, code)
                total = np.bincount(of[hit], held.value.logs[halves[i:j][of[hit]], spot[hit]], minlength=n).astype(np.float64)
                size = np.bincount(of, minlength=n)
                rest_of, rest = of[~hit], code[~hit]
                order = np.lexsort((rest, rest_of))
                rest_of, rest = rest_of[order], rest[order]
                start = np.flatnonzero(np.r_[True, (rest[1:] != rest[:-1]) | (rest_of[1:] != rest_of[:-1])][:len(rest)])
                ends = np.searchsorted(rest_of[start], np.arange(n + 1)).astype(np.int32)
                pairs = pa.StructArray.from_arrays([pa.array(rest[start]), pa.array(np.diff(np.append(start, len(rest))))], ["gram", "n"])
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.arange(uid, uid + n)), b.column("doc_id").slice(i, n), b.column("lang").slice(i, n),
                    pa.array(np.diff(words.first)),
                    pa.array(np.bincount(row, inner & ~IS_SPACE[raw], minlength=n).astype(np.int64)),
                    pa.array(np.bincount(row, SYMBOLS[raw], minlength=n).astype(np.int64)),
                    pa.array(lines[i:j], pa.int64()),
                    pa.array(repeat_words(raw, words)),
                    b.column("half").slice(i, n), pa.array(size.astype(np.int64)), pa.array(total), pa.ListArray.from_arrays(pa.array(ends), pairs),
                ], ["uid", "doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "half", "codes", "total", "rest"])
                uid += n

    return rows.mapInArrow(run, f"uid long, doc_id {id_type}, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
                                "half int, codes long, total double, rest array<struct<gram: long, n: long>>")


def add_rest(measured: DataFrame, logs: DataFrame) -> DataFrame:
    """``measured`` with ``logppl`` (null without a code): the logs of the n-grams in
    ``rest`` are joined from ``logs``."""
    rest = measured.select("uid", "half", F.explode("rest").alias("r")).select("uid", "half", "r.gram", "r.n")
    log = F.when(F.col("half") == 0, F.col("log1")).otherwise(F.col("log0"))
    sums = rest.join(logs.drop("n"), "gram").groupBy("uid").agg(F.sum(F.col("n") * log).alias("more"))
    logppl = -(F.col("total") + F.coalesce("more", F.lit(0.0))) / F.col("codes")
    return measured.drop("rest").join(sums, "uid", "left").withColumn("logppl", F.when(F.col("codes") > 1, logppl)).drop("uid", "more", "total", "half")


def bands(measured: DataFrame) -> DataFrame:
    """lang, low, high: bounds on log10 perplexity of each language, for texts of many codes."""
    bins = measured.where("not base_failed and logppl is not null").groupBy("lang", F.floor(F.col("logppl") * 1000).alias("bin")).agg(F.count("*").alias("n"))
    # A language has a few thousand bins at most, whatever the number of texts.
    w = Window.partitionBy("lang").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    at = F.sum("n").over(w)
    total = F.sum("n").over(Window.partitionBy("lang"))
    ranked = bins.select("lang", (F.col("bin") / 1000).alias("x"), (at / total).alias("share"))
    q = ranked.groupBy("lang").agg(F.min(F.when(F.col("share") >= 0.25, F.col("x"))).alias("q1"), F.min(F.when(F.col("share") >= 0.75, F.col("x"))).alias("q3"))
    margin = F.greatest(FENCE * (F.col("q3") - F.col("q1")), F.lit(LEAST))
    return q.select("lang", (F.col("q1") - margin).alias("low"), (F.col("q3") + margin).alias("high"))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, perplexity."""
    spark = docs.sparkSession
    checkpoint_root(spark)
    logs = gram_logs(count_grams(docs, text_col, halves=True))
    least, head = head_of(logs)
    path = scratch_path(spark, "quality")
    measure(docs, Head(head), id_col, text_col, lang_col).write.parquet(f"{path}/texts")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    add_rest(spark.read.parquet(f"{path}/texts"), logs.where(F.col("n") < least)).withColumn("base_failed", failed).write.parquet(f"{path}/scored")
    measured = spark.read.parquet(f"{path}/scored")
    # One row a language.
    limits = bands(measured).withColumnRenamed("lang", "band_lang")
    out = measured.join(F.broadcast(limits), F.col("lang").eqNullSafe(F.col("band_lang")), "left")
    chance = SPREAD / F.sqrt(F.greatest("codes", F.lit(1)))
    inside = F.coalesce(F.col("logppl").between(F.col("low") - chance, F.col("high") + chance), F.lit(True))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                      (~F.col("base_failed") & inside).alias("kept"), F.pow(F.lit(10.0), "logppl").alias("perplexity"))
