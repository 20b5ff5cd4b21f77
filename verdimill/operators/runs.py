"""Stored runs: requests, results, resuming, status and errors."""

from __future__ import annotations

import contextlib
import json
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import store

REPEAT_LIMIT = 5


def requests_of(items: DataFrame) -> DataFrame:
    """One row for each part of an item, or for the whole item: item_first, n, of, lines, size, state.

    ``items`` has ITEM columns; request indexes are item_index and part number.
    """
    part = F.posexplode_outer("parts").alias("pos", "p")
    rows = items.select("item_index", "label", "value", F.col("state").alias("whole"), F.greatest(F.size("parts"), F.lit(0)).alias("of"), part)
    return rows.select(F.col("item_index").alias("item_first"), (F.coalesce("pos", F.lit(0)) + 1).alias("n"), F.greatest("of", F.lit(1)).alias("of"), F.col("label").alias("source"), F.col("p.lines").alias("lines"), F.coalesce("p.size", F.lit(0)).alias("size"), "value", F.coalesce("p.state", "whole").alias("state"))


def latest(results: DataFrame, index: str = "index", seq: str = "attempt_seq") -> DataFrame:
    """The last result of each index; aggregated before the shuffle."""
    others = [c for c in results.columns if c != index]
    return results.groupBy(index).agg(F.max_by(F.struct(*others), seq).alias("_r")).select(index, *(F.col(f"_r.{c}").alias(c) for c in others))


def pending(requests: DataFrame, results: DataFrame, index: str = "index") -> DataFrame:
    """Requests without a complete latest result: what a resumed run still has to ask."""
    done = latest(results, index).where("status = 'complete'").select(index)
    return requests.join(done, index, "left_anti")


def counts(requests: DataFrame, results: DataFrame, index: str = "index") -> DataFrame:
    """One row: total, complete, failed, status (complete, partial or interrupted)."""
    joined = requests.select(index).join(latest(results, index).select(index, "status"), index, "left")
    c = joined.agg(F.count("*").alias("total"), F.count_if(F.col("status") == "complete").alias("complete"), F.count_if(F.col("status") == "failed").alias("failed"))
    return c.withColumn("status", F.when(F.col("complete") == F.col("total"), "complete").when(F.col("complete") + F.col("failed") == F.col("total"), "partial").otherwise("interrupted"))


def error_streaks(events: DataFrame, order: str, error: str, by: list[str], limit: int = REPEAT_LIMIT) -> DataFrame:
    """Streaks of ``limit`` or more equal errors in a row: by, error, first, last, n.

    ``error`` is null for successes, which end a streak.  Islands by difference of row numbers.
    """
    w = Window.partitionBy(*by).orderBy(order)
    per = Window.partitionBy(*by, error).orderBy(order)
    rows = events.withColumn("_island", F.row_number().over(w) - F.row_number().over(per))
    out = rows.where(F.col(error).isNotNull()).groupBy(*by, error, "_island").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n"))
    return out.where(F.col("n") >= limit).drop("_island")


def exit_code(summary: dict, fail_on: str | None = None) -> int:
    """0 if all went well, 1 if items failed or are left, 2 if rows are marked under ``fail_on``."""
    if summary.get("failed") or summary.get("left"):
        return 1
    return 2 if fail_on and summary.get(fail_on) else 0


class RunBusy(RuntimeError):
    """Another writer holds the run."""


@dataclass
class Run:
    """A run in a folder of any file system that Spark reaches: run.json, requests and results as Parquet.

    It is made aside and published by a rename, so a listed run has its requests.
    A writer holds the file ``writer``, which names it; files are replaced by renames.
    """

    id: str
    root: str
    template: str = ""
    status: str = "interrupted"
    created: str = ""
    complete: int = 0
    failed: int = 0

    def _path(self, name: str = "", aside: bool = False) -> str:
        return "/".join(x for x in (self.root.rstrip("/"), f".new-{self.id}" if aside else self.id, name) if x)

    @property
    def dir(self) -> str:
        return self._path()

    def save(self, spark: SparkSession, aside: bool = False) -> None:
        store.write_text(spark, self._path("run.json", aside), json.dumps(asdict(self)))

    def create(self, df: DataFrame) -> None:
        """Write the requests and publish the run; what is left of a failed attempt is discarded."""
        spark = df.sparkSession
        try:
            df.write.mode("errorifexists").parquet(self._path("requests", True))
            self.save(spark, True)
            store.rename(spark, self._path(aside=True), self.dir)
        except Exception:
            self.discard(spark)
            raise

    def discard(self, spark: SparkSession) -> None:
        """Remove what has not been published."""
        store.drop(spark, self._path(aside=True))

    @contextlib.contextmanager
    def writing(self, spark: SparkSession, stale: float = 3600.0):
        """Hold the run for one writer; a hold older than ``stale`` seconds without a sign of life is taken over."""
        path = self._path("writer")
        if not store.create_new(spark, path):
            age = store.age(spark, path)
            if age is not None and age < stale:
                raise RunBusy(f"run {self.id} has a writer")
            store.drop(spark, path)
            if not store.create_new(spark, path):
                raise RunBusy(f"run {self.id} has a writer")
        try:
            yield self
        finally:
            store.drop(spark, path)

    def append_results(self, df: DataFrame) -> None:
        """Add results, then count them."""
        spark = df.sparkSession
        df.write.mode("append").parquet(self._path("results"))
        c = latest(self.results(spark).select(F.concat_ws(":", "item_first", "n").alias("index"), "attempt_seq", "error")).agg(F.count_if(F.col("error").isNull()).alias("ok"), F.count_if(F.col("error").isNotNull()).alias("bad")).first()
        self.complete, self.failed = c.ok, c.bad
        self.save(spark)

    def requests(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(self._path("requests"))

    def has_results(self, spark: SparkSession) -> bool:
        return "results" in store.names(spark, self.dir)

    def results(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(self._path("results"))


def list_runs(spark: SparkSession, root: str) -> list[Run]:
    """Newest first."""
    out = []
    for name in store.names(spark, root):
        text = None if name.startswith(".") else store.read_text(spark, f"{root.rstrip('/')}/{name}/run.json")
        if text:
            out.append(Run(**{**json.loads(text), "root": root}))
    return sorted(out, key=lambda r: (r.created, r.id), reverse=True)


def open_run(spark: SparkSession, root: str, prefix: str) -> Run:
    """The run whose id starts with ``prefix``; an error if none or several do."""
    found = [r for r in list_runs(spark, root) if r.id.startswith(prefix)]
    exact = [r for r in found if r.id == prefix]
    if len(exact or found) != 1:
        raise ValueError(f"{len(found)} runs start with {prefix!r}")
    return (exact or found)[0]
