"""Parts of an item combined into one answer for each question."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dist
from ..functions.text import line_count
from ..questions import Condition
from .verdicts import strength


def weight(size: Column, lines: Column) -> Column:
    """A part's size, or its number of lines if it has none."""
    return F.when(size > 0, size.cast("double")).otherwise(line_count(lines).cast("double"))


def _seen() -> Column:
    return F.size(F.collect_set("n"))  # an item has a few parts


def _whole(parts: DataFrame, item: str) -> DataFrame:
    """Items of which all parts are there and none failed (item, n, of, status)."""
    return parts.groupBy(item).agg(_seen().alias("seen"), F.max("of").alias("of"), F.count_if(F.col("status") != "complete").alias("failed"))


def item_status(parts: DataFrame, item: str) -> DataFrame:
    """item, parts, status: complete, failed (a part failed) or incomplete (parts are missing)."""
    w = _whole(parts, item)
    return w.select(item, F.col("of").alias("parts"), F.when(F.col("failed") > 0, "failed").when(F.col("seen") < F.col("of"), "incomplete").otherwise("complete").alias("status"))


def failure_text() -> Column:
    """The failure of a part, with its place."""
    place = F.when(F.coalesce(F.col("lines"), F.lit("")) != "", F.concat(F.lit(" (lines "), "lines", F.lit(")"))).otherwise("")
    return F.concat(F.lit("part "), "n", F.lit(" of "), "of", place, F.lit(": "), "error")


def first_failure(parts: DataFrame, item: str) -> DataFrame:
    """item, error: the failure of its first failed part, with the part's place."""
    return parts.where("status <> 'complete'").groupBy(item).agg(F.min_by(failure_text(), "n").alias("error"))


def _keys(q) -> list[str]:
    return sorted(q.keys) if q.type == "choice" else [str(i) for i in range(len(q.levels))] if q.type == "score" else []


def _sums(i: int, q, a: Column, conditions: list[Condition]) -> list[Column]:
    """The aggregates that one question needs, named by its number."""
    got = F.count(a).alias(f"_got{i}")
    if conditions:
        best = F.max_by(F.struct(a.alias("answer"), F.col("n").alias("n")), F.when(a.isNotNull(), F.struct(strength(list(conditions), a), -F.col("n"))))
        return [got, best.alias(f"_best{i}")]
    w = F.when(a.isNotNull(), F.col("_w"))
    each = [F.sum(w * dist.prob(a["probs"], k)).alias(f"_p{i}_{j}") for j, k in enumerate(_keys(q))]
    return [got, F.sum(w).alias(f"_total{i}"), F.min_by(a, F.when(a.isNotNull(), F.col("n"))).alias(f"_first{i}"), F.sum(w * a["noul"]).alias(f"_noul{i}"), F.sum(w * a["confidence"]).alias(f"_conf{i}"), *each]


def _merged(i: int, q, conditions: list[Condition]) -> Column:
    """The answer of an item from the aggregates of its parts."""
    if conditions:
        return F.col(f"_best{i}.answer")
    total, first, keys = F.col(f"_total{i}"), F.col(f"_first{i}"), _keys(q)
    probs = F.filter(F.array(*(F.struct(F.lit(k).alias("key"), (F.col(f"_p{i}_{j}") / total).alias("p")) for j, k in enumerate(keys))), lambda e: e["p"].isNotNull()) if keys else None
    none = lambda t: F.lit(None).cast(t)
    merged = F.struct(
        F.lit(q.type).alias("type"),
        (F.col(f"_noul{i}") / total).alias("noul"),
        (dist.argmax(probs) if q.type == "choice" else none("string")).alias("choice"),
        (dist.expected_level(probs) if q.type == "score" else none("double")).alias("score"),
        (F.col(f"_conf{i}") / total).alias("confidence"),
        (probs if keys else none("array<struct<key:string,p:double>>")).alias("probs"),
        first["legend"].alias("legend"),
        none("string").alias("raw"),
        none("string").alias("decode_error"),
    )
    return F.when(total == 0, first).otherwise(merged)


def combine_all(parts: DataFrame, item: str, questions: dict, answers: dict[str, Column], conditions: dict[str, list[Condition]], more: list[Column] = ()) -> DataFrame:
    """item, seen, of, failed, one ANSWER column for each question and ``more`` aggregates, all in one pass.

    ``parts`` has item, n, of, lines, size and status; rows that repeat a part
    count twice in averages.  An answer is there if all parts are complete and
    answer the question.  With conditions the strongest part wins, the first on
    ties; otherwise yes-or-no values, confidence and each probability are averaged by
    weight, a choice is the most likely option (smallest key on ties) and a score the sum of levels.
    """
    rows = parts.withColumn("_w", weight(F.col("size"), F.col("lines")))
    sums = [c for i, (k, q) in enumerate(questions.items()) for c in _sums(i, q, answers[k], conditions.get(k) or [])]
    out = rows.groupBy(item).agg(_seen().alias("seen"), F.count("*").alias("_rows"), F.max("of").alias("of"), F.count_if(F.col("status") != "complete").alias("failed"), *sums, *more)
    whole = (F.col("failed") == 0) & (F.col("seen") == F.col("of"))
    each = {k: F.when(whole & (F.col(f"_got{i}") == F.col("_rows")), _merged(i, q, conditions.get(k) or [])) for i, (k, q) in enumerate(questions.items())}
    where = {f"{k}_part": F.when(F.col(k).isNotNull(), F.col(f"_best{i}.n")) for i, k in enumerate(questions) if conditions.get(k)}
    return out.withColumns(each).withColumns(where).drop("_rows", *(c for c in out.columns if c.startswith("_")))


def combine_answers(parts: DataFrame, item: str, q, conditions: list[Condition] = (), answer: str = "answer") -> DataFrame:
    """item, answer, where_part of the items that are whole and answered, from rows (item, n, of, lines, size, status, answer)."""
    out = combine_all(parts, item, {"answer": q}, {"answer": F.col(answer)}, {"answer": list(conditions)})
    part = F.col("answer_part") if conditions else F.lit(None).cast("int")
    return out.where("answer IS NOT NULL").select(item, "answer", part.alias("where_part"))
