"""Language identification by hyperdimensional profiles.

Every letter class has a random vector of +1/-1. A letter trigram is bound by
rotating its first two vectors by two and one places and multiplying the
three; the trigram vectors of a text, added up with their counts, are its
bundle. A language's prototype is the bundle of all its training texts. The
prediction is the prototype with the largest cosine.

The trigram counts of each language are summed by Spark over all training
rows (combined per task before the shuffle). There are at most 64**3 trigrams
a language, and at most ``MAX_LANGS`` languages (checked), so the counts and
the prototypes sent to the tasks have a proven bound.

Letters are Unicode letters in lower case: a-z keep their own class, all
others fall into 37 classes by code point. Runs of other characters count as
one gap.

Defined cases: a null text, or one without a letter, is ``und`` with score 0;
rows with null ``lang`` are predicted but teach nothing; without any training
row all predictions are ``und``; ties go to the first language by name;
repeated rows are rows of their own; an empty table gives no rows.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairwright.llm.textvec import code_points, slabs, small_batches
from pairwright.session import ship_package

CLASSES = 64
GRAMS = CLASSES ** 3
DIMENSIONS = 512
#: More distinct languages than this are an error, so prototypes stay bounded.
MAX_LANGS = 10_000
UND = "und"
#: Trigram vectors built at once when bundling.
GRAM_BLOCK = 8192
DOC_BLOCK = 256


def letter_classes() -> np.ndarray:
    """Class of every code point; 0 for all that are not letters."""
    if "t" not in _TABLE:
        table = np.zeros(0x110000, np.uint8)
        for cp in range(0x110000):
            ch = chr(cp)
            if unicodedata.category(ch)[0] == "L":
                low = ord(ch.lower()[0])
                table[cp] = low - 96 if 97 <= low <= 122 else 27 + low % 37
        _TABLE["t"] = table
    return _TABLE["t"]


_TABLE: dict[str, np.ndarray] = {}


def letter_vectors(dims: int = DIMENSIONS) -> np.ndarray:
    rng = np.random.Generator(np.random.PCG64(977))
    return (rng.integers(0, 2, (CLASSES, dims), dtype=np.int8) * 2 - 1).astype(np.int8)


def gram_vectors(grams: np.ndarray, letters: np.ndarray) -> np.ndarray:
    """Bound vectors of trigram codes, as float32."""
    a, b = np.roll(letters, 2, axis=1), np.roll(letters, 1, axis=1)
    return (a[grams >> 12] * b[(grams >> 6) & 63] * letters[grams & 63]).astype(np.float32)


def trigrams(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, trigram code) of every trigram of the texts of a slab."""
    rows = len(offsets) - 1
    cps = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le", "replace"), np.uint32)
    first = code_points(raw)[offsets]
    row = np.repeat(np.arange(rows), np.diff(first))
    # A gap before and after each text; then runs of gaps shrink to one.
    seq = np.zeros(len(cps) + 2 * rows, np.uint8)
    of = np.repeat(np.arange(rows), np.diff(first) + 2)
    seq[np.arange(len(cps)) + 2 * row + 1] = letter_classes()[cps]
    keep = np.ones(len(seq), bool)
    keep[1:] = (seq[1:] != 0) | (seq[:-1] != 0) | (of[1:] != of[:-1])
    seq, of = seq[keep].astype(np.int32), of[keep]
    if len(seq) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int32)
    inside = of[2:] == of[:-2]
    return of[2:][inside], ((seq[:-2] << 12) | (seq[1:-1] << 6) | seq[2:])[inside]


def prototypes(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", dims: int = DIMENSIONS) -> tuple[list[str], np.ndarray]:
    """(languages by name, unit prototype of each) learned from all rows given."""
    small_batches(docs.sparkSession)
    ship_package(docs.sparkSession)

    def count(batches):
        langs: dict[str, int] = {}
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merged():
            codes, inv = np.unique(np.concatenate([c for c, _ in held]), return_inverse=True)
            return codes, np.bincount(inv, np.concatenate([n for _, n in held])).astype(np.int64)

        for b in batches:
            ids = np.array([langs.setdefault(x, len(langs)) for x in b.column("l").to_pylist()], np.int64)
            for i, j, raw, offsets in slabs(b.column("t")):
                row, gram = trigrams(raw, offsets)
                held.append(np.unique(ids[i:j][row] * GRAMS + gram, return_counts=True))
            if sum(len(c) for c, _ in held) > 2_000_000:
                held = [merged()]
        if held:
            codes, n = merged()
            names = np.array(list(langs), dtype=object)
            for at in range(0, len(codes), 100_000):
                c = codes[at:at + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(names[c // GRAMS], pa.string()), pa.array((c % GRAMS).astype(np.int32)), pa.array(n[at:at + 100_000])], ["lang", "gram", "n"])

    rows = docs.select(F.col(text_col).cast("string").alias("t"), F.col(lang_col).cast("string").alias("l")).where("t is not null and l is not null")
    counts = rows.mapInArrow(count, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))

    def bundle(batches):
        letters, sums = letter_vectors(dims), {}
        for b in batches:
            lang = np.array(b.column("lang").to_pylist(), dtype=object)
            gram, n = (b.column(c).to_numpy(zero_copy_only=False) for c in ("gram", "n"))
            for name in set(lang):
                pick = lang == name
                v = n[pick].astype(np.float64) @ gram_vectors(gram[pick], letters).astype(np.float64)
                sums[name] = sums.get(name, 0) + v
        if sums:
            if len(sums) > MAX_LANGS:
                raise ValueError(f"more than {MAX_LANGS} languages")
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([list(v) for v in sums.values()])], ["lang", "v"])

    # The counts are at most GRAMS rows a language: a few tasks, one vector a language and task.
    parts = counts.coalesce(8).mapInArrow(bundle, "lang string, v array<double>").collect()
    total: dict[str, np.ndarray] = {}
    for r in parts:
        total[r.lang] = total.get(r.lang, 0) + np.array(r.v)
    if len(total) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    langs = sorted(total)
    m = np.array([total[x] for x in langs]).reshape(len(langs), dims)
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return langs, (m / np.where(norm == 0, 1, norm)).astype(np.float32)


def _cosines(raw, offsets, letters, protos) -> tuple[np.ndarray, np.ndarray]:
    """(cosine with each prototype, has letters) of the texts of a slab."""
    rows = len(offsets) - 1
    row, gram = trigrams(raw, offsets)
    kinds, inv = np.unique(gram, return_inverse=True)
    bundles = np.zeros((rows, letters.shape[1]), np.float32)
    first = np.searchsorted(row, np.arange(rows + 1))
    for k in range(0, len(kinds), GRAM_BLOCK):
        vectors = gram_vectors(kinds[k:k + GRAM_BLOCK], letters)
        width = len(vectors)
        for i in range(0, rows, DOC_BLOCK):
            j = min(i + DOC_BLOCK, rows)
            sel = slice(first[i], first[j])
            g, r = inv[sel] - k, row[sel] - i
            ok = (g >= 0) & (g < width)
            counts = np.bincount(r[ok] * width + g[ok], minlength=(j - i) * width).reshape(j - i, width).astype(np.float32)
            bundles[i:j] += counts @ vectors
    norm = np.linalg.norm(bundles, axis=1, keepdims=True)
    return bundles @ protos.T / np.where(norm == 0, 1, norm), np.bincount(row, minlength=rows) > 0


def predict(docs: DataFrame, langs: list[str], protos: np.ndarray, text_col: str = "text",
            pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """The input's columns with the predicted language and its cosine (0 to 1)."""
    small_batches(docs.sparkSession)
    ship_package(docs.sparkSession)
    letters = letter_vectors(protos.shape[1] if len(langs) else DIMENSIONS)
    k = docs.columns.index(text_col)
    as_string = docs.schema[text_col].dataType.simpleString() == "string"

    def run(batches):
        for b in batches:
            names, scores = [], []
            col = b.column(k) if as_string else b.column(k).cast(pa.string())
            for i, j, raw, offsets in slabs(col):
                if not langs:
                    names += [UND] * (j - i)
                    scores += [0.0] * (j - i)
                    continue
                cos, has = _cosines(raw, offsets, letters, protos)
                best = cos.argmax(axis=1)
                names += [langs[x] if h else UND for x, h in zip(best, has)]
                scores += np.where(has, np.clip(cos[np.arange(j - i), best], 0, 1), 0).astype(float).tolist()
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], schema=pa.schema([*b.schema, pa.field(pred, pa.string()), pa.field(score, pa.float64())]))

    from pyspark.sql.types import DoubleType, StringType, StructType

    schema = StructType([*docs.schema.fields]).add(pred, StringType()).add(score, DoubleType())
    return docs.mapInArrow(run, schema)


def held_out(id_col: str | Column = "doc_id") -> Column:
    """True for the quarter of ids whose crc32 leaves remainder 2."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.crc32(F.coalesce(c.cast("string"), F.lit(""))) % 4 == 2


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score; prototypes come from the rows not held out."""
    langs, protos = prototypes(docs.where(~held_out(id_col)), text_col, lang_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return predict(rows, langs, protos).drop("text")


# --- rejecting texts of no learned language --------------------------------------------

#: A text is rejected under this share of the median cosine of its language and length.
SHARE = 0.3
#: Rows that a median needs, and the least cutoff (noise of the vectors).
LEAST_ROWS = 30
LEAST_COSINE = 0.05
#: Lengths are binned by powers of two.
BINS = 32


def length_bin(text: Column) -> Column:
    return F.least(F.floor(F.log2(F.length(text) + 1)), F.lit(BINS - 1)).cast("int")


def cutoffs(trained: DataFrame, pred: str = "lang_pred", score: str = "score", text_col: str = "text") -> dict[tuple[str, int], float]:
    """Lowest cosine to accept, by predicted language and length bin, from the rows that were learned from.

    A bin with fewer than ``LEAST_ROWS`` rows of a language takes the lowest median
    of all languages, and one with too few of these the next shorter bin's cutoff:
    cosines rise with length, so that is on the safe side. One row a language and
    bin reaches the driver.
    """
    rows = trained.where(F.col(pred) != UND).groupBy(F.col(pred).alias("l"), length_bin(F.col(text_col)).alias("b"))
    per = rows.agg(F.count("*").alias("n"), F.percentile_approx(score, 0.5).alias("m")).collect()
    of_bin: dict[int, list] = {}
    for r in per:
        of_bin.setdefault(r.b, []).append(r)
    # Over all languages: the lowest of their medians.
    pooled = {b: min(r.m for r in rs) for b, rs in of_bin.items() if sum(r.n for r in rs) >= LEAST_ROWS}
    own = {(r.l, r.b): r.m for r in per if r.n >= LEAST_ROWS}
    out = {}
    for lang in {r.l for r in per}:
        last = LEAST_COSINE
        for b in range(BINS):
            m = own.get((lang, b), pooled.get(b))
            last = max(last, SHARE * m) if m is not None else last
            out[lang, b] = last
    return out


def drop_unlearned(predicted: DataFrame, found: dict[tuple[str, int], float], pred: str = "lang_pred", score: str = "score", text_col: str = "text") -> DataFrame:
    """The rows of ``predicted`` that reach the cutoff (``cutoffs``) of their language and length.

    Without any cutoff ``LEAST_COSINE`` alone decides.
    """
    least = F.lit(LEAST_COSINE)
    if found:
        names = []
        for name in ("cut_lang", "cut_bin", "cut_least"):
            while name.lower() in {c.lower() for c in predicted.columns}:
                name = f"_{name}"
            names.append(name)
        table = predicted.sparkSession.createDataFrame([(*k, v) for k, v in sorted(found.items())], f"{names[0]} string, {names[1]} int, {names[2]} double")
        # At most MAX_LANGS times BINS small rows.
        near = (F.col(pred) == F.col(names[0])) & (length_bin(F.col(text_col)) == F.col(names[1]))
        predicted = predicted.join(F.broadcast(table), near, "left").drop(*names[:2])
        least = F.coalesce(F.col(names[2]), least)
        return predicted.where((F.col(pred) != UND) & (F.col(score) >= least)).drop(names[2])
    return predicted.where((F.col(pred) != UND) & (F.col(score) >= least))
