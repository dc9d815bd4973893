"""Time the main operators on the sf0.1 pair corpus and on k copies of it.

Usage: python scripts/scale_probe.py [k]      (default k = 10)
The copies get distinct ids and are made by a generator inside the plan
(nothing is written). The 1x run is repeated once first to warm the JVM.
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from pyspark.sql import functions as F  # noqa: E402

from pairwright.operators import candidates as C  # noqa: E402
from pairwright.operators import cleaning  # noqa: E402
from pairwright.operators.indexing import row_index  # noqa: E402
from pairwright.operators.sampling import sample_n  # noqa: E402
from pairwright.plans import annotate as AN  # noqa: E402
from pairwright.plans.queries import SINGLE  # noqa: E402
from pairwright.session import build_session, scratch_path  # noqa: E402
from pairwright.sources.fixture import load_fixture_pairs  # noqa: E402


def copies(base, k: int):
    return (base.withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
                .select((F.col("pair_id") + F.col("r").cast("bigint") * 1_000_000_000).alias("pair_id"),
                        "nl_sentence", "fol_expression"))


def timed(fn) -> float:
    start = time.perf_counter()
    fn()
    return round(time.perf_counter() - start, 2)


def noop(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    k = int(sys.argv[1]) if len(sys.argv) > 1 else 10
    spark = build_session("local[8]", shuffle_partitions=32, conf={"spark.driver.memory": "16g"})
    base = load_fixture_pairs(spark, "/root/testdata/sf0.1")
    for copies_n in (1, 1, k):
        df = copies(base, copies_n)
        tagged = df.withColumns({"dataset": F.lit("d"), "version": F.lit("v")})
        result = {
            "clean_pairs": timed(lambda: noop(cleaning.clean_pairs(df))),
            "candidate_counts": timed(lambda: C.candidate_counts(tagged).collect()),
            "sample_n(100k)": timed(lambda: noop(sample_n(df, 100_000))),
            "row_index": timed(lambda: noop(row_index(df))),
            "annotate_single": timed(lambda: noop(AN.annotate_single(
                df, "wrong_binding", backend=SINGLE, store=scratch_path(spark, "probe")))),
        }
        print(df.count(), result, flush=True)


if __name__ == "__main__":
    main()
