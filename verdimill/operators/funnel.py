"""Cascades: cheap questions first, survivors go on."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..store import settle

#: Limits up to this are joined by broadcast.
SMALL_LIMIT = 10_000


@dataclass(frozen=True)
class Stage:
    """name; ask adds answers to survivors; keep decides; rank and limit take the best; error marks items that failed."""

    name: str
    ask: Callable[[DataFrame], DataFrame]
    keep: Column
    rank: Column | None = None
    limit: int | None = None
    error: Column | None = None


def run_stage(items: DataFrame, stage: Stage, index: str) -> DataFrame:
    """Items with cause: null for survivors, else error, keep or limit.  A rank that is NaN is an error."""
    asked = stage.ask(items)
    error = stage.error if stage.error is not None else F.lit(False)
    if stage.rank is not None:
        error = error | F.coalesce(F.isnan(stage.rank), F.lit(True))
    asked = asked.withColumn("cause", F.when(error, "error").when(~F.coalesce(stage.keep, F.lit(False)), "keep"))
    if stage.limit is None:
        return asked
    order = ([F.col("_rank").desc()] if stage.rank is not None else []) + [F.col(index)]
    if stage.rank is not None:
        asked = asked.withColumn("_rank", stage.rank)
    best = asked.where("cause IS NULL").orderBy(*order).limit(stage.limit).select(F.col(index).alias("_best"))
    out = asked.join(F.broadcast(best) if stage.limit <= SMALL_LIMIT else best, F.col(index) == F.col("_best"), "left")
    return out.withColumn("cause", F.when(F.col("cause").isNull() & F.col("_best").isNull(), "limit").otherwise(F.col("cause"))).drop("_best", "_rank")


def run(items: DataFrame, stages: list[Stage], index: str) -> tuple[DataFrame, DataFrame]:
    """(survivors, drops): drops are (index, stage, cause).  Each stage is computed once."""
    alive, drops = items, None
    for s in stages:
        done = settle(run_stage(alive, s, index))
        gone = done.where("cause IS NOT NULL").select(index, F.lit(s.name).alias("stage"), "cause")
        drops = gone if drops is None else drops.unionByName(gone)
        alive = done.where("cause IS NULL").drop("cause")
    return alive, drops


def report(items: DataFrame, drops: DataFrame, stages: list[str], index: str) -> DataFrame:
    """stage, n_in, n_out, failed for each stage, in order."""
    spark = items.sparkSession
    names = spark.createDataFrame(list(enumerate(stages)), "ordinal int, stage string")
    gone = drops.groupBy("stage").agg(F.count("*").alias("gone"), F.count_if(F.col("cause") == "error").alias("failed"))
    per = names.join(gone, "stage", "left").fillna(0, ["gone", "failed"])  # one row for each stage
    total = items.agg(F.count(index).alias("total"))
    before = F.coalesce(F.sum("gone").over(Window.orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return per.join(total).withColumn("n_in", F.col("total") - before).select("ordinal", "stage", "n_in", (F.col("n_in") - F.col("gone")).alias("n_out"), "failed")


def usage(asked: DataFrame, stage: str) -> DataFrame:
    """One row of a stage's answers (model, request_tokens, answer_tokens, error): responses, tokens in and out, sorted known models, and whether one is unknown."""
    ok = F.col("error").isNull()
    known = F.when(ok & (F.coalesce("model", F.lit("")) != ""), F.col("model"))
    return asked.agg(
        F.lit(stage).alias("stage"),
        F.count_if(ok).alias("responses"),
        F.coalesce(F.sum(F.when(ok, F.col("request_tokens"))), F.lit(0)).alias("tokens_in"),
        F.coalesce(F.sum(F.when(ok, F.col("answer_tokens"))), F.lit(0)).alias("tokens_out"),
        F.sort_array(F.collect_set(known)).alias("models"),
        F.coalesce(F.bool_or(ok & known.isNull()), F.lit(False)).alias("unknown_model"),
    )


def chunks(items: DataFrame, index: str, size: int) -> DataFrame:
    """``items`` with chunk and place, for requests that hold ``size`` items each; index counts from 0 without gaps."""
    return items.withColumns({"chunk": F.floor(F.col(index) / size).cast("long"), "place": (F.col(index) % size).cast("int")})


def wire_key(place: Column, local: str) -> Column:
    return F.concat_ws(".", place.cast("string"), F.lit(local))
