"""Recorded answers of the registered model queries.

No model is reachable where the queries run, so their answer tables are a
fixture like the pair corpus: fixed rules over the request table (FIXTURES.md
§5). They stand where a batch model's answer table would be imported. Nothing
else in the package uses them; a real job passes its own backend.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwright.operators import candidates as C
from pairwright.plans import catalogue as cat


def single_answers(pending: DataFrame) -> DataFrame:
    d = F.substr(F.md5("prompt"), F.lit(1), F.lit(1))
    answer = (F.when(d <= "7", cat.ANSWER_APPLIES).when(d <= "d", cat.ANSWER_NOT_APPLIES)
              .when(d == "e", cat.ANSWER_APPLIES + ".").otherwise(cat.NO_LABEL))
    return pending.select("key", answer.alias("answer"))


def multi_answers(layout):
    def answers(pending: DataFrame) -> DataFrame:
        sentence, formula = layout.parts("prompt")
        labels = C.category_array("f", "s")
        rows = pending.select("key", sentence.alias("s"), formula.alias("f"))
        return rows.select("key", F.to_json(F.when(F.size(labels) == 0, F.array(F.lit(cat.NO_LABEL))).otherwise(labels)).alias("answer"))
    return answers


def corrector_answers(layout):
    def answers(pending: DataFrame) -> DataFrame:
        return pending.select("key", F.replace(layout.parts("prompt")[1], F.lit("∀y"), F.lit("∃y")).alias("answer"))
    return answers
