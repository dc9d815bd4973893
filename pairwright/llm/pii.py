"""Personal data: proposed spans, boosted trees, calibrated thresholds.

Everything runs on DataFrame functions.

1. Generators propose spans with high recall: the fixed base patterns and
   looser ones (phone numbers without a plus, written-out mail addresses,
   social security numbers). A pattern's matches are marked in the text, the
   text is split at the marks, and the running sum of the parts' lengths
   (code points) gives each span its place.
2. Every loose span gets format and context features in a few bins each. Its
   label is evidence from the words before it: the nearest of the cue words of
   its kind ("call", "ssn") and the counter-cues ("invoice", "part") decides.
   Spans without either count as negatives of weight ``UNTOLD``, so a format
   that is mostly seen without cues isn't taken for personal data. Spark sums
   each combination of bins over all texts; there are at most a few thousand
   combinations, whatever the corpus, and gradient boosting of depth-2 trees
   runs on those sums.
3. The trees go back as one SQL expression. A threshold a kind, the lowest
   (above even odds) at which the spans of a calibration fold reach
   ``PRECISION``, selects what is added; a kind that never reaches it adds
   nothing, one without spans of even odds in that fold takes even odds.
   Spans that pass the base checks always stay, and added spans never overlap them.

Defined cases: a null text is an empty one; repeated rows are rows of their
own; an empty table gives no rows, and where no loose span has a cue
nothing is trained (no span is added);
other columns of the input are not read. The marks are two control
characters; where a text has them itself they count as another control
character of equal length, which no pattern can match.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pairwright.session import checkpoint_root, scratch_path

KINDS = ("email", "ip", "card", "phone", "ssn")
# The base patterns of the contract, written so that no start is
# tried twice (possessive runs; a match starts at the front of its run or at
# the end of the match before).
_LOCAL = "[A-Za-z0-9._%+-]"
EMAIL = rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# Looser generators.
PHONE_LOOSE = r"(?<![0-9+(.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9-])"
EMAIL_LOOSE = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}\x20?(?:\[at\]|\(at\))\x20?[A-Za-z0-9-]{1,63}(?:\x20?(?:\.|\[dot\]|\(dot\))\x20?[A-Za-z0-9-]{1,63}){1,8}"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"

#: generator -> (kind, pattern, what a text must contain)
GENERATORS = {
    "email": ("email", EMAIL, "@"), "ip": ("ip", IP, "."), "card": ("card", CARD, None), "phone": ("phone", PHONE, "+"),
    "phone_loose": ("phone", PHONE_LOOSE, None), "email_loose": ("email", EMAIL_LOOSE, "at"), "ssn": ("ssn", SSN, "-"),
}
BASE = ("email", "ip", "card", "phone")
_OPEN, _SHUT = "\u0001", "\u0002"
LOOSE = tuple(g for g in GENERATORS if g not in BASE)
#: Characters before a span that are searched for cues.
AHEAD = 48
CUES = {
    "email": "e-?mail|mail|contact|write|reach|address|send|reply",
    "phone": "tel|telephone|phone|call|fax|mobile|cell|dial|ring|reach|contact|sms|whatsapp|hotline",
    "ssn": "ssn|social security|social|security|taxpayer",
}
COUNTER = ("invoice|order|part|item|sku|serial|model|ref|reference|ticket|isbn|batch|lot|tracking|product|catalog|catalogue"
           "|version|case|article|shipment|parcel|bill|receipt|code|build")

ROUNDS, RATE, LEAF = 30, 0.3, 1.0
#: Weight of a span without a cue or counter-cue, as a negative.
UNTOLD = 0.25
PRECISION = 0.95
FOLDS = 5
FEATURES = ("kind", "digits", "seps", "before", "after", "cue", "valid", "size")


PART = "struct<gen:string,i:int,n:bigint,m:string,tail:string,next:string>"


def _parts(text: Column, gen: str) -> Column:
    """array<struct<gen, i, n, m, tail, next>> of one generator; empty without a match."""
    _, pattern, needs = GENERATORS[gen]
    parts = F.split(F.regexp_replace(text, pattern, f"{_OPEN}$0{_SHUT}"), _OPEN)

    def one(x, i):
        m = F.substring_index(x, _SHUT, 1)
        own = F.when(i == 0, F.lit(None)).otherwise(m)
        return F.struct(
            F.lit(gen).alias("gen"), i.alias("i"),
            (F.length(x) - F.when(i == 0, 0).otherwise(1)).cast("long").alias("n"),
            own.alias("m"), F.right(x, F.lit(AHEAD)).alias("tail"),
            F.substring(F.substring_index(x, _SHUT, -1), 1, 1).alias("next"))

    rows = F.transform(parts, one)
    empty = F.array().cast(f"array<{PART}>")
    has = F.size(rows) > 1
    found = F.when(has, rows).otherwise(empty)
    return F.when(text.contains(needs), found).otherwise(empty) if needs else F.when(text.rlike("[0-9]"), found).otherwise(empty)


def _class(c: Column) -> Column:
    """0 edge or space, 1 letter, 2 digit, 3 other."""
    return F.when(c.isNull() | (c == "") | c.rlike(r"^\s"), 0).when(c.rlike(r"^\p{L}"), 1).when(c.rlike("^[0-9]"), 2).otherwise(3)


def _luhn(digits: Column) -> Column:
    marks = F.transform(F.split(F.reverse(digits), ""), lambda x, i: F.when(i % 2 == 0, x.cast("int")).otherwise(x.cast("int") * 2 - F.when(x.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(marks, F.lit(0), lambda s, x: s + F.coalesce(x, F.lit(0))) % 10 == 0


def _cue(gen: Column, ahead: Column) -> Column:
    """2 where the nearest cue or counter-cue before a loose span speaks for it, 1 where against, 0 without one."""
    out = None
    for g in LOOSE:
        cues = CUES[GENERATORS[g][0]]
        nearest = F.lower(F.regexp_extract(ahead, rf"(?is)^.*(?<!\p{{L}})({cues}|{COUNTER})s?(?!\p{{L}})", 1))
        told = F.when(nearest.rlike(f"^(?:{cues})$"), 2).when(nearest != "", 1).otherwise(0)
        out = F.when(gen == g, told) if out is None else out.when(gen == g, told)
    return F.coalesce(out, F.lit(0))


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """uid, doc_id and, for each proposed span, gen, start, stop, m and the features.

    Every text also has one row with null ``gen``.
    """
    rows = docs.select(
        F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("doc_id"),
        F.translate(F.coalesce(F.col(text_col).cast("string"), F.lit("")), _OPEN + _SHUT, "\u0003\u0003").alias("t"))
    # Every text has a row without a generator, so none is lost.
    none = F.array(F.lit(None).cast(PART))
    parts = rows.select("uid", "doc_id", F.explode(F.concat(none, *(_parts(F.col("t"), g) for g in GENERATORS))).alias("p")).select("uid", "doc_id", "p.*")
    parts = parts.repartition("uid")
    w = Window.partitionBy("uid", "gen").orderBy("i")
    placed = parts.withColumn("start", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1))).withColumn("ahead", F.lag("tail").over(w))
    placed = placed.where("gen is null or i > 0").withColumn("stop", F.col("start") + F.length("m"))
    m = F.col("m")
    digits = F.regexp_replace(m, "[^0-9]", "")
    n = F.length(digits)
    octets = F.transform(F.split(m, r"\."), lambda x: F.regexp_replace(x, "^0+(?!$)", ""))
    octets_ok = F.forall(octets, lambda x: F.when(F.length(x) <= 3, x.cast("int")).otherwise(999) <= 255)
    base_ok = (F.when(F.col("gen") == "email", F.lit(True))
               .when(F.col("gen") == "ip", octets_ok)
               .when(F.col("gen") == "card", F.when(n.between(13, 19), _luhn(digits)).otherwise(False))
               .when(F.col("gen") == "phone", n.between(9, 15)).otherwise(False))
    kind = F.create_map(*(F.lit(x) for g, (k, _, _) in GENERATORS.items() for x in (g, KINDS.index(k))))[F.col("gen")]
    last = F.right(F.regexp_replace("ahead", f".*{_SHUT}", ""), F.lit(1))
    # Format that holds without a check sum: a known separator pattern of the kind.
    valid = (F.when(F.col("gen").isin("email", "email_loose"), m.rlike(r"[A-Za-z]{2,}$"))
             .when(F.col("gen") == "ip", m.rlike(r"^[0-9]{1,3}(?:\.[0-9]{1,3}){3}$"))
             .when(F.col("gen") == "card", m.rlike(r"^(?:[0-9]{4}[\x20-]){3}[0-9]{4}$|^[3-6][0-9]{12,18}$"))
             .when(F.col("gen") == "ssn", ~m.rlike("^(?:000|666|9)"))
             .otherwise(m.rlike(r"\([0-9]{3}\)|[0-9]{3}[\x20.-][0-9]{4}$")))
    return placed.select(
        "uid", "doc_id", "gen", "start", "stop", F.coalesce(base_ok, F.lit(False)).alias("base"), kind.alias("kind"),
        F.when(n < 6, 0).when(n < 9, 1).when(n < 10, 2).when(n < 12, 3).when(n < 13, 4).when(n < 16, 5).when(n < 20, 6).otherwise(7).alias("digits"),
        F.least(F.length(F.regexp_replace(m, "[A-Za-z0-9]", "")), F.lit(5)).alias("seps"),
        _class(last).alias("before"), _class(F.col("next")).alias("after"),
        _cue(F.col("gen"), F.col("ahead")).alias("cue"), valid.cast("int").alias("valid"),
        F.when(F.length(m) < 10, 0).when(F.length(m) < 16, 1).when(F.length(m) < 24, 2).otherwise(3).alias("size"))


class Boosted:
    """Gradient-boosted depth-2 trees (logistic loss) over binned features."""

    def __init__(self, rows: list[tuple[tuple[int, ...], float, float]]):
        """rows: (bins, count, positives)."""
        total, positive = sum(r[1] for r in rows), sum(r[2] for r in rows)
        rate = (positive + 0.5) / (total + 1)
        self.bias = math.log(rate / (1 - rate))
        self.learned = positive > 0
        self.trees: list[tuple] = []
        score = [self.bias] * len(rows)
        for _ in range(ROUNDS if total else 0):
            p = [1 / (1 + math.exp(-s)) for s in score]
            grad = [r[2] - r[1] * q for r, q in zip(rows, p)]
            hess = [r[1] * q * (1 - q) for r, q in zip(rows, p)]
            every = range(len(rows))
            split = self._split(rows, grad, hess, every)
            if split is None:
                break
            f, at = split
            leaves = []
            for side in ([k for k in every if rows[k][0][f] <= at], [k for k in every if rows[k][0][f] > at]):
                inner = self._split(rows, grad, hess, side)
                groups = [side] if inner is None else [[k for k in side if rows[k][0][inner[0]] <= inner[1]], [k for k in side if rows[k][0][inner[0]] > inner[1]]]
                values = [RATE * sum(grad[k] for k in g) / (sum(hess[k] for k in g) + LEAF) for g in groups]
                for g, v in zip(groups, values):
                    for k in g:
                        score[k] += v
                leaves.append((inner, values))
            self.trees.append((f, at, leaves))

    @staticmethod
    def _split(rows, grad, hess, members):
        best, found = 1e-9, None
        g_all, h_all = sum(grad[k] for k in members), sum(hess[k] for k in members)
        for f in range(len(FEATURES)):
            sums: dict[int, list[float]] = {}
            for k in members:
                s = sums.setdefault(rows[k][0][f], [0.0, 0.0])
                s[0] += grad[k]
                s[1] += hess[k]
            g = h = 0.0
            for at in sorted(sums)[:-1]:
                g, h = g + sums[at][0], h + sums[at][1]
                gain = g * g / (h + LEAF) + (g_all - g) ** 2 / (h_all - h + LEAF) - g_all ** 2 / (h_all + LEAF)
                if gain > best:
                    best, found = gain, (f, at)
        return found

    def score(self, bins) -> float:
        s = self.bias
        for f, at, leaves in self.trees:
            inner, values = leaves[bins[f] > at]
            s += values[0] if inner is None else values[bins[inner[0]] > inner[1]]
        return s

    def sql(self) -> str:
        """The score as a SQL expression over the feature columns."""
        def leaf(inner, values):
            return f"{values[0]!r}D" if inner is None else f"if({FEATURES[inner[0]]} <= {inner[1]}, {values[0]!r}D, {values[1]!r}D)"

        return " + ".join([f"({self.bias!r}D)", *(f"if({FEATURES[f]} <= {at}, {leaf(*leaves[0])}, {leaf(*leaves[1])})" for f, at, leaves in self.trees)])


def thresholds(model: Boosted, rows: list[tuple[tuple[int, ...], float, float]]) -> dict[int, float]:
    """Per kind, the lowest score of even odds or more from which on the calibration spans are right often enough.

    Infinite where a kind has calibration spans of such scores and they never are.
    """
    out = {}
    for kind in {r[0][0] for r in rows}:
        scored = sorted(((model.score(b), n, p) for b, n, p in rows if b[0] == kind), reverse=True)
        n = p = 0.0
        out[kind] = math.inf if scored[0][0] >= 0 else 0.0
        for k, (s, a, b) in enumerate(scored):
            n, p = n + a, p + b
            if (k + 1 == len(scored) or scored[k + 1][0] < s) and p >= PRECISION * n and s >= 0:
                out[kind] = s
    return out


def train(found: DataFrame) -> tuple[Boosted, dict[int, float]]:
    """Trees from the loose spans of all texts, and thresholds from those of the calibration fold with a cue or counter-cue."""
    fold = (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % FOLDS == 0).alias("calibration")
    table = found.where(F.col("gen").isin(*LOOSE)).groupBy(fold, *FEATURES).agg(F.count("*").alias("n")).collect()
    rows = sorted((r.calibration, tuple(r[f] or 0 for f in FEATURES), float(r.n)) for r in table)
    cue = FEATURES.index("cue")
    model = Boosted([(b, n if b[cue] else UNTOLD * n, n if b[cue] == 2 else 0.0) for c, b, n in rows if not c])
    return model, thresholds(model, [(b, n, n if b[cue] == 2 else 0.0) for c, b, n in rows if c and b[cue]])


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added."""
    spark = docs.sparkSession
    checkpoint_root(spark)
    path = scratch_path(spark, "pii-candidates")
    candidates(docs, id_col, text_col).write.parquet(path)
    found = spark.read.parquet(path)
    model, least = train(found)
    # A kind without calibration spans takes even odds.
    limit = F.create_map(*(F.lit(x) for k in range(len(KINDS)) for x in (k, float(least.get(k, 0.0)))))[F.col("kind")]
    chosen = F.col("gen").isin(*LOOSE) & (F.expr(model.sql()) >= limit) if model.learned else F.lit(False)
    scored = found.withColumn("added", F.coalesce(chosen, F.lit(False))).where("base or added or gen is null")
    # A span added must lie clear of the base spans and of added spans before it.
    own = Window.partitionBy("uid").orderBy("start", F.desc("base"), "stop", "gen")
    before = F.max(F.when(F.col("base"), F.col("stop"))).over(own.rowsBetween(Window.unboundedPreceding, -1))
    after = F.min(F.when(F.col("base"), F.col("start"))).over(Window.partitionBy("uid").orderBy(F.desc("start"), "base", F.desc("stop"), F.desc("gen")).rowsBetween(Window.unboundedPreceding, -1))
    earlier = F.max("stop").over(own.rowsBetween(Window.unboundedPreceding, -1))
    clear = F.col("base") | F.col("gen").isNull() | ((F.coalesce(before, F.lit(0)) <= F.col("start")) & (F.coalesce(after, F.col("stop")) >= F.col("stop")) & (F.coalesce(earlier, F.lit(0)) <= F.col("start")))
    kept = scored.withColumn("clear", clear).where("clear")
    span = F.when(F.col("gen").isNotNull(), F.struct("kind", "start", "stop", "base"))
    rows = kept.groupBy("uid", "doc_id").agg(F.sort_array(F.collect_list(span)).alias("all"))
    names = F.array(*(F.lit(k) for k in KINDS))
    text = lambda arr: F.array_join(F.transform(arr, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["stop"].cast("string"))), ",")
    base = F.filter("all", lambda s: s["base"])
    count = lambda k: F.size(F.filter(base, lambda s: s["kind"] == k)).cast("long")
    return rows.select(
        "doc_id", *(count(k).alias(f"n_{KINDS[k]}") for k in range(4)), F.sha2(text(base), 256).alias("base_sha256"),
        text(F.col("all")).alias("spans"), F.size(F.filter("all", lambda s: ~s["base"])).cast("long").alias("n_added"))

