"""Checks of answers against their questions, first failure first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dist

CONSISTENCY = ("choice_not_argmax", "probability_sum")


def tolerance(n: int) -> float:
    return 0.05 + 0.005 * n


def _chain(checks: list[tuple[Column, str]]) -> Column:
    out = F.lit(None).cast("string")
    for failed, reason in reversed(checks):
        out = F.when(F.coalesce(failed, F.lit(False)), reason).otherwise(out)
    return out


def _not_finite(x: Column) -> Column:
    return F.isnan(x) | (F.abs(x) == float("inf"))


def _out(x: Column, low: float, high: float) -> Column:
    return (x < low) | (x > high)


def reason(q, a: Column) -> Column:
    """Why an ANSWER column fails its question; null if it is fine."""
    e = dist.SLACK
    common = [(a.isNull(), "missing_answer"), (a["decode_error"].isNotNull(), "decode_failed"), (a["type"] != q.type, "type_mismatch")]
    if q.type == "noul":
        return _chain([*common, (a["noul"].isNull(), "missing_field"), (_not_finite(a["noul"]), "not_finite"), (_out(a["noul"], -e, 1 + e), "out_of_range")])
    keys = sorted(q.keys) if q.type == "choice" else sorted(str(i) for i in range(len(q.levels)))
    n = len(keys)
    value = a["choice"] if q.type == "choice" else a["score"]
    ps = F.transform(a["probs"], lambda x: x["p"])
    want = F.array(*map(F.lit, keys)) if keys else F.array().cast("array<string>")
    missing = value.isNull() | a["probs"].isNull() | a["confidence"].isNull()
    if q.type == "score":
        missing = missing | a["legend"].isNull()
    checks = [
        *common,
        (missing, "missing_field"),
        (_not_finite(a["confidence"]) | F.exists(ps, _not_finite), "not_finite"),
        (_out(a["confidence"], -e, 1 + e) | F.exists(ps, lambda p: _out(p, -e, 1 + e)), "out_of_range"),
        (F.array_sort(F.transform(a["probs"], lambda x: x["key"])) != want, "probability_keys"),
    ]
    tol = tolerance(n)
    if q.type == "choice":
        checks += [(~F.array_contains(want, a["choice"]), "choice_not_option"), (dist.prob(a["probs"], a["choice"]) < F.array_max(ps), "choice_not_argmax")]
    else:
        top = n - 1
        checks += [
            (F.size(F.array_except(F.transform(a["legend"], lambda x: x["key"]), want)) > 0, "legend_keys"),
            (_not_finite(a["score"]), "not_finite"),
            (_out(a["score"], -top * tol - e, top * (1 + tol) + e), "score_out_of_range"),
        ]
    checks.append((F.abs(dist.total(a["probs"]) - 1) > tol + e, "probability_sum"))
    return _chain(checks)


def is_consistency(reason: Column) -> Column:
    """Failures that leave the answer usable: not the most likely option, sums, and scores off the scale."""
    return reason.isin(*CONSISTENCY, "score_out_of_range")


def name(reason: Column) -> Column:
    """The public name: a score off its scale is out_of_range."""
    return F.when(reason == "score_out_of_range", "out_of_range").otherwise(reason)


def check_answers(answers: DataFrame, questions: dict, on: list[str]) -> DataFrame:
    """One row for each item and question or unexpected answer: question, reason, consistency.

    ``answers`` is long: the columns ``on``, question and answer.
    """
    spark = answers.sparkSession
    wanted = spark.createDataFrame([(k,) for k in questions], "q string")
    items = answers.select(*on).distinct()
    full = items.join(F.broadcast(wanted)).join(answers.withColumnRenamed("question", "q"), [*on, "q"], "full_outer")  # one row for each question of the template
    out = F.lit("unexpected_answer")
    for k, q in questions.items():
        out = F.when(F.col("q") == k, reason(q, F.col("answer"))).otherwise(out)
    full = full.withColumn("r", out)
    return full.select(*on, F.col("q").alias("question"), name(F.col("r")).alias("reason"), F.coalesce(is_consistency(F.col("r")), F.lit(False)).alias("consistency"))


def summary(checked: DataFrame, on: list[str]) -> DataFrame:
    """Failures of an item: how many and the first two by question."""
    bad = checked.where("reason IS NOT NULL").groupBy(*on).agg(F.count("*").alias("failures"), F.slice(F.sort_array(F.collect_list(F.concat_ws(": ", "question", "reason"))), 1, 2).alias("first"))
    return bad
