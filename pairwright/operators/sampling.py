"""Exact, seeded sample of n rows without replacement.

Rows are ranked by ``md5(id || '#' || seed)``, then id, then a hash of the
whole row, which gives the same rows on any partitioning and in any engine
with md5. A null id ranks by the md5 of ``#seed`` alone, so rows without an id
take part like all others.

Ranks spread evenly, so for a small n a cutoff a little above the n-th rank is
known from the number of rows; one pass over the ids counts the rows below it,
and if they are enough, only they are sorted.

Otherwise (many rows, or ids that repeat) the n-th rank is found by counting: the ranks alone are written to the scratch
folder once, and a few passes over that narrow table count them in at most
``SELECT_BUCKETS`` equal bands, each time going into the band that holds the
n-th. Rows below the last band are taken by a filter; only the last band (at
most ``band_rows`` rows) is sorted. Where more rows than that share one rank,
the same is done over the hash of the row; rows equal in both are equal rows,
and the missing number of them is made from one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairwright.fixed_values import SEED_MULTI
from pairwright.session import scratch_path

SELECT_BUCKETS = 1024
#: Rows of the last band, which one task sorts.
BAND_ROWS = 100_000
#: Hex digits of a rank by which the rows of every group are counted.
CUTOFF_DIGITS = 3
_TOP = (1 << 60) - 1


def sample_rank(id_col: str = "pair_id", seed: int = SEED_MULTI) -> Column:
    return F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(f"#{seed}")))


def _rank_prefix(rank: Column) -> Column:
    # First 15 hex digits of the md5 as a non-negative BIGINT; its order agrees
    # with the order of the hex string.
    return F.conv(F.substr(rank, F.lit(1), F.lit(15)), 16, 10).cast("bigint")


def _row_hash(cols: list[str]) -> Column:
    return F.xxhash64(*cols).bitwiseAND(F.lit(_TOP))


def _nth_band(ranks: DataFrame, col: str, need: int, band_rows: int) -> tuple[int, int, int, int]:
    """(low, high, rows in the band, still needed of it) of the band of ``col`` with the need-th row."""
    lo, hi = 0, _TOP
    while True:
        width = (hi - lo) // SELECT_BUCKETS + 1
        band = ranks.where(F.col(col).between(lo, hi)).select(F.expr(f"({col} - {lo}) div {width}").alias("b"))
        run = 0
        for b, c in sorted((r["b"], r["count"]) for r in band.groupBy("b").count().collect()):
            if run + c >= need:
                break
            run += c
        lo, need = lo + b * width, need - run
        hi = min(hi, lo + width - 1)
        if c <= band_rows or lo == hi:
            return lo, hi, c, need


def sample_n(df: DataFrame, n: int, seed: int = SEED_MULTI, id_col: str = "pair_id",
             strict: bool = False, band_rows: int = BAND_ROWS) -> DataFrame:
    """Exactly ``min(n, rows)`` rows; ``strict=True`` raises if n exceeds the rows."""
    if n < 0:
        raise ValueError("n must be >= 0")
    spark, cols = df.sparkSession, df.columns
    rank = sample_rank(id_col, seed)
    if 0 < n <= band_rows:
        total = df.count()
        if n >= total and not (strict and n > total):
            return df
        # Six standard deviations above n: the rows below it are too few once in a billion.
        cutoff = int((n + 6 * n ** 0.5 + 36) / total * _TOP) if total else 0
        near = df.where(_rank_prefix(rank) <= cutoff)
        if n <= total and n <= near.count() <= 2 * band_rows:
            return near.orderBy(rank, id_col, _row_hash(cols)).limit(n)
    keyed = df.withColumns({"_rank": rank, "_h": _rank_prefix(rank), "_t": _row_hash(cols)})
    path = scratch_path(spark, "sample-ranks")
    keyed.select("_h", "_t").write.parquet(path)
    ranks = spark.read.schema("_h BIGINT, _t BIGINT").parquet(path)
    total = ranks.count()
    if strict and n > total:
        raise ValueError(f"cannot sample {n} rows from {total}")
    if n >= total:
        return df
    if n == 0:
        return df.where("false")
    lo, hi, size, need = _nth_band(ranks, "_h", n, band_rows)
    taken = keyed.where(F.col("_h") < lo)
    band = keyed.where(F.col("_h").between(lo, hi))
    if size > band_rows:
        t_lo, t_hi, size, need = _nth_band(ranks.where(F.col("_h") == lo), "_t", need, band_rows)
        taken = taken.unionByName(band.where(F.col("_t") < t_lo))
        band = band.where(F.col("_t").between(t_lo, t_hi))
    if size > band_rows:
        edge = band.limit(1).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.lit(need))))
    else:
        edge = band.orderBy("_rank", id_col, "_t").limit(need)
    return taken.select(*cols).unionByName(edge.select(*cols))


def sample_per_group(df: DataFrame, n: int, groups, seed: int = SEED_MULTI, id_col: str = "pair_id") -> DataFrame:
    """Exactly ``min(n, rows)`` rows of every group, by the ranks of ``sample_n``.

    Rows past the cutoff of their group are dropped first, before anything is
    sorted (``_below_cutoff``). Of the rest each task keeps the first ``n`` of its
    rows of a group before the shuffle (a group limit on the window, which merges
    like a bottom-k), so ranks that many rows share send ``n`` rows a task. Above
    the optimizer's limit for that step, each task's sorted rows are cut here in
    the same way.
    """
    if n < 0:
        raise ValueError("n must be >= 0")
    groups, cols = list(groups), df.columns
    order = [F.col("_rank"), F.col(id_col), F.col("_t")]
    keyed = df.withColumns({"_rank": sample_rank(id_col, seed), "_t": _row_hash(cols)})
    keyed = _below_cutoff(keyed, groups, n)
    if n > int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000")):
        keyed = _first_of_each_task(keyed.sortWithinPartitions(*groups, *order), groups, n)
    first = F.row_number().over(Window.partitionBy(*groups).orderBy(*order))
    return keyed.withColumn("_n", first).where(F.col("_n") <= n).select(*cols)


def _below_cutoff(keyed: DataFrame, groups: list[str], n: int) -> DataFrame:
    """The rows up to the rank, cut to ``CUTOFF_DIGITS`` digits, by which their group has ``n``.

    One pass counts the rows by group and cut rank (combined map-side); the
    cutoffs, one row a group, are stored, so that the join knows their real size.
    """
    near = F.substr(F.col("_rank"), F.lit(1), F.lit(CUTOFF_DIGITS))
    counts = keyed.groupBy(*groups, near.alias("_near")).agg(F.count(F.lit(1)).alias("_rows"))
    before = F.sum("_rows").over(Window.partitionBy(*groups).orderBy("_near").rowsBetween(Window.unboundedPreceding, -1))
    needed = counts.withColumn("_before", F.coalesce(before, F.lit(0))).where(F.col("_before") < n)
    path = scratch_path(keyed.sparkSession, "sample-cutoffs")
    own = [F.col(g).alias(f"_of{i}") for i, g in enumerate(groups)]
    needed.groupBy(*own).agg(F.max("_near").alias("_cutoff")).write.parquet(path)
    cutoffs = keyed.sparkSession.read.parquet(path)
    same = [F.col(g).eqNullSafe(F.col(f"_of{i}")) for i, g in enumerate(groups)]
    return keyed.join(cutoffs, [*same, near <= F.col("_cutoff")]).select(*keyed.columns)


def _first_of_each_task(rows: DataFrame, groups: list[str], n: int) -> DataFrame:
    """The first ``n`` rows of each group in every partition (sorted by group)."""
    import pyarrow as pa

    def keep(batches):
        group, count = None, 0
        for b in batches:
            kept = []
            for g in b.column("_g").to_pylist():
                group, count = g, count + 1 if g == group else 1
                kept.append(count <= n)
            yield b.filter(pa.array(kept, pa.bool_()))

    marked = rows.withColumn("_g", F.md5(F.to_json(F.struct(*groups), {"ignoreNullFields": "false"})))
    return marked.mapInArrow(keep, marked.schema).drop("_g")
