"""Running templates over data: read, skip what is known, ask, combine, mark, store."""

from __future__ import annotations

import datetime
import time
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store, templates
from .operators import cache, combine, runs, validate, verdicts
from .questions import Choice, Template, encode
from .schemas import ANSWER
from .scorers import HashScorer, Retry, Scorer, TableScorer, UniformScorer, score
from .sources.files import Options, scan

SCORERS = {"hash": HashScorer, "uniform": UniformScorer, "table": TableScorer}


@dataclass
class EngineConfig:
    """Model, folders and how hard to try."""

    scorer: Scorer = field(default_factory=HashScorer)
    runs_dir: str = ""
    cache_dir: str = ""
    template_dirs: list[str] = field(default_factory=list)
    workers: int = 4
    parallelism: int | None = None
    retry: Retry = field(default_factory=Retry)
    provider: str = "local"
    breaker: int = runs.REPEAT_LIMIT


@dataclass
class RunResult:
    """items: one row for each item with answers and marks; summary and exit code."""

    items: DataFrame
    template: Template
    summary: dict
    exit_code: int
    run: runs.Run | None = None
    skipped: DataFrame | None = None


class Engine:
    """The engine over one Spark session."""

    def __init__(self, spark: SparkSession, config: EngineConfig | None = None):
        self.spark, self.config = spark, config or EngineConfig()

    def templates(self) -> DataFrame:
        return templates.table(self.spark, self.config.template_dirs)

    def models(self) -> DataFrame:
        return self.spark.createDataFrame([(n, getattr(c, "model", "")) for n, c in SCORERS.items()], "name string, model string")

    def runs(self) -> list[runs.Run]:
        return runs.list_runs(self.spark, self.config.runs_dir)

    def resolve(self, template: str | Template, params: dict | None = None) -> Template:
        t = templates.load(template, self.config.template_dirs) if isinstance(template, str) else template
        return t.with_params(**(params or {}))

    def scan(self, paths: list[str], template: Template | None = None, **options) -> tuple[DataFrame, DataFrame]:
        """Items of files and folders, and the files passed over with the reasons."""
        if template is not None and template.each and "each" not in options:
            options["each"] = template.each
        stdin = options.pop("stdin", None)
        return scan(self.spark, paths, Options(**options), stdin=stdin)

    def items(self, paths: list[str], template: Template | None = None, **options) -> DataFrame:
        return self.scan(paths, template, **options)[0]

    def dry_run(self, template: str | Template, data: list[str] | DataFrame, params: dict | None = None, cached: DataFrame | None = None, **options) -> dict:
        """Counts of items, requests, answers known and to ask; the first 20 labels."""
        t = self.resolve(template, params)
        items = data if isinstance(data, DataFrame) else self.items(data, t, **options)
        requests = runs.requests_of(items)
        tally = items.groupBy("unit").agg(F.count("*").alias("count"), F.sum(F.size("parts")).alias("parts"), F.count_if("is_code").alias("code"), F.count_distinct(F.when(F.col("is_code"), F.regexp_replace("label", r":\d+$", ""))).alias("code_files"))
        n = tally.collect()
        if cached is None and self.config.cache_dir:
            cached = cache.entries(self.spark, self.config.cache_dir)
        known = cache.hits(self._keys(requests, t), cached).count() if cached is not None else 0
        total = requests.count() * len(t.questions)
        return {"by_unit": {r.unit: r["count"] for r in n}, "parts": sum(max(r.parts or 0, 0) for r in n), "code_files": sum(r.code_files for r in n), "cached": known, "to_ask": total - known, "first": [r.label for r in items.orderBy("item_index").limit(20).select("label").collect()]}

    def _keys(self, requests: DataFrame, t: Template) -> DataFrame:
        """One row for each request and question with the key of its answer."""
        src = cache.Source(self.config.provider, "", self.config.scorer.model)
        asked = F.array(*(F.struct(F.lit(k).alias("question"), F.lit(encode(q)).alias("encoded")) for k, q in t.questions.items()))
        rows = requests.withColumn("item", cache.item_id(F.col("state"))).withColumn("q", F.explode(asked))
        return rows.select("item_first", "n", "q.question", cache.answer_key(src, F.col("item"), F.col("q.question"), F.col("q.encoded")).alias("key"))

    def ask(self, requests: DataFrame, t: Template) -> DataFrame:
        """``requests`` with answers, model, error and cached, the number of answers that came from the cache.

        Of every request, only the questions that the cache does not answer
        validly are asked.  If the model turns out to be a newer version than the
        cached answers are from, those are asked again, once.  All good answers go into the cache.
        """
        c, spark = self.config, self.spark

        def ask(rows: DataFrame, only: str | None = None) -> DataFrame:
            ask_all = lambda r, parallelism=None: score(r, t.questions, c.scorer, workers=c.workers, parallelism=parallelism, retry=c.retry, breaker=c.breaker, only=only)
            if not c.scorer.remote or not c.breaker:
                return ask_all(rows, c.parallelism)
            # The breaker of the whole run: if the first items all fail alike, no other is asked.
            first = store.settle(ask_all(rows.orderBy("item_first", "n").limit(c.breaker), 1))
            rest = rows.join(first.select("item_first", "n"), ["item_first", "n"], "left_anti").select(*rows.columns)
            got = first.groupBy("error").count().collect()  # a row for each of a few items at most
            down = got[0].error if len(got) == 1 and (got[0]["count"] >= c.breaker or (got[0].error or "").startswith("refused: ")) else None
            if down is None:
                return first.unionByName(ask_all(rest, c.parallelism))
            none = {n: F.lit(None).cast(first.schema[n].dataType) for n in ("answers", "model")}
            return first.unionByName(rest.withColumns({**none, "error": F.lit(down if down.startswith("not asked: ") else f"not asked: {down}")}).select(*first.columns))

        if not c.cache_dir:
            return ask(requests).withColumn("cached", F.lit(0))
        known = cache.entries(spark, c.cache_dir)
        keys = self._keys(requests, t)
        at = ["item_first", "n"]

        def split(entries: DataFrame, rest: DataFrame) -> DataFrame:
            """``rest`` with the valid cached answers of each request, and the questions left to ask."""
            hit = cache.hits(keys, entries)
            for k, q in t.questions.items():
                hit = hit.where((F.col("question") != k) | validate.reason(q, F.col("answer")).isNull())
            have = hit.groupBy(*at).agg(F.map_from_entries(F.collect_list(F.struct("question", "answer"))).alias("_have"))
            left = F.array_except(F.array(*map(F.lit, t.questions)), F.coalesce(F.map_keys("_have"), F.array().cast("array<string>")))
            return rest.join(have, at, "left").withColumn("_left", left)

        def answer(rows: DataFrame) -> DataFrame:
            """Asked and cached answers of each request together, computed once; what was asked is cached."""
            asked = ask(rows.where(F.size("_left") > 0), "_left")
            rest = rows.where(F.size("_left") == 0).withColumns({"answers": F.lit(None).cast(asked.schema["answers"].dataType), "model": F.lit(None).cast("string"), "error": F.lit(None).cast("string")})
            out = store.settle(asked.unionByName(rest))
            new = out.where("answers IS NOT NULL").select(*at, "model", F.explode("answers").alias("question", "answer")).join(keys, [*at, "question"])
            for k, q in t.questions.items():
                new = new.where((F.col("question") != k) | validate.reason(q, F.col("answer")).isNull())
            if not new.isEmpty():
                cache.append(new.select("key", F.col("model").alias("version"), F.lit(time.time_ns()).alias("time_ns"), "answer"), c.cache_dir)
            return out

        first = answer(split(known, requests))
        before, now = (cache.latest_version(e).first().latest for e in (known, cache.entries(spark, c.cache_dir)))
        if before and now != before:
            mixed = (F.size("_left") > 0) & F.col("_have").isNotNull() | (F.size("_left") == 0)
            names = requests.columns
            again = split(cache.entries(spark, c.cache_dir), first.where(mixed).select(*names))
            first = first.where(~mixed).unionByName(answer(again))
        cache.compact(spark, c.cache_dir)
        # A failed request has no answers, even if the cache knows some of them.
        have, got = F.coalesce("_have", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast(f"array<{ANSWER}>"))), F.col("answers")
        both = F.when(F.col("error").isNotNull(), None).when(got.isNull(), have).otherwise(F.map_concat(F.map_filter(have, lambda k, _: ~F.map_contains_key(got, k)), got))
        n = F.when(F.col("error").isNotNull(), 0).otherwise(len(t.questions) - F.size("_left"))
        return first.select(*requests.columns, both.alias("answers"), F.coalesce("model", F.lit(now)).alias("model"), "error", n.cast("int").alias("cached"))

    def combine(self, answered: DataFrame, t: Template) -> DataFrame:
        """Items with one ANSWER column for each question, status, error and marks; one aggregation over the parts."""
        flags, matches = t.conditions("flags"), t.conditions("matches")
        parts = answered.withColumn("status", F.when(F.col("error").isNull(), "complete").otherwise("failed"))
        parts = parts.withColumns({f"_a{i}": F.col("answers")[k] for i, k in enumerate(t.questions)})
        parts = parts.withColumns({f"_a{i}": F.when(validate.reason(q, F.col(f"_a{i}")).isNull(), F.col(f"_a{i}")) for i, q in enumerate(t.questions.values())})
        answers = {k: F.col(f"_a{i}") for i, k in enumerate(t.questions)}
        failure = F.when(F.col("error").isNotNull(), F.col("n"))
        more = [F.min_by("source", "n").alias("source"), F.min_by(combine.failure_text(), failure).alias("error"), F.sum("cached").alias("cached")]
        out = combine.combine_all(parts, "item_first", t.questions, answers, {k: flags.get(k) or matches.get(k) or [] for k in t.questions}, more)
        status = F.when(F.col("failed") > 0, "failed").when(F.col("seen") < F.col("of"), "incomplete").otherwise("complete")
        out = out.select(F.col("item_first").alias("item_index"), F.col("of").alias("parts"), status.alias("status"), "source", "error", "cached", *t.questions)
        return verdicts.verdicts(out, flags, matches, list(t.questions))

    def summarize(self, items: DataFrame, fail_on: str | None = None) -> tuple[dict, int]:
        s = items.agg(F.count("*").alias("items"), F.count_if(F.col("status") == "failed").alias("failed"), F.count_if(F.col("status") == "incomplete").alias("left"), F.count_if("flagged").alias("flagged"), F.count_if("matched").alias("matched"), F.coalesce(F.sum("cached"), F.lit(0)).alias("cached")).first().asDict()
        return s, runs.exit_code(s, fail_on)

    def run(self, template: str | Template, data: list[str] | DataFrame, params: dict | None = None, fail_on: str | None = None, **options) -> RunResult:
        """Ask a template about data (paths, or rows of ITEM) and mark the answers; stored if ``runs_dir`` is set."""
        t = self.resolve(template, params)
        if fail_on and not {"flagged": t.flags, "matched": t.matches}[fail_on]:
            raise ValueError(f"the template can't have {fail_on} items")
        items, skipped = (data, None) if isinstance(data, DataFrame) else self.scan(data, t, **options)
        requests = runs.requests_of(items)
        run = None
        if self.config.runs_dir:
            now = datetime.datetime.now()
            run = runs.Run(f"{now:%Y%m%d-%H%M%S}-{uuid.uuid4().hex[:6]}", self.config.runs_dir, t.name, created=now.isoformat())
            run.create(requests)
            requests = run.requests(self.spark)
        out = self._execute(t, requests, run, fail_on)
        out.skipped = skipped
        return out

    def resume(self, prefix: str, template: str | Template, params: dict | None = None, fail_on: str | None = None) -> RunResult:
        """Ask what a stored run has no complete result for, and combine all."""
        run = runs.open_run(self.spark, self.config.runs_dir, prefix)
        return self._execute(self.resolve(template, params), run.requests(self.spark), run, fail_on)

    def _execute(self, t: Template, requests: DataFrame, run: runs.Run | None, fail_on: str | None) -> RunResult:
        if run is None:
            answered = store.settle(self.ask(requests, t))
        else:
            with run.writing(self.spark):
                seq = 1
                if run.has_results(self.spark):
                    done = run.results(self.spark)
                    seq = done.agg(F.max("attempt_seq")).first()[0] + 1
                    requests = requests.join(done.where("error IS NULL").select("item_first", "n"), ["item_first", "n"], "left_anti")
                run.append_results(self.ask(requests, t).withColumn("attempt_seq", F.lit(seq)))
            results = run.results(self.spark)
            others = [c for c in results.columns if c not in ("item_first", "n")]
            answered = results.groupBy("item_first", "n").agg(F.max_by(F.struct(*others), "attempt_seq").alias("r")).select("item_first", "n", "r.*")
        items = self.combine(answered, t)
        summary, code = self.summarize(items, fail_on)
        if run is not None:
            run.status = "complete" if not summary["failed"] and not summary["left"] else "partial"
            run.save(self.spark)
        return RunResult(items, t, summary, code, run)

    def view(self, result: RunResult, top: int) -> DataFrame:
        """The items nearest to a mark."""
        t = result.template
        return verdicts.top_n(result.items, top, t.conditions("flags"), t.conditions("matches"), "item_index", F.col("status") == "complete")


def judge(spark: SparkSession, texts: list[str], questions: dict, scorer: Scorer | None = None) -> DataFrame:
    """Up to 200 texts and 8 questions at once: item_index, state and answers."""
    if not 0 < len(texts) <= 200 or not 0 < len(questions) <= 8:
        raise ValueError("1 to 200 texts and 1 to 8 questions fit")
    df = spark.createDataFrame(list(enumerate(texts)), "item_index long, state string")
    return score(df, questions, scorer or HashScorer())


def ask_one(state: str, q, scorer: Scorer | None = None) -> dict:
    """One question about one state, without Spark."""
    return (scorer or HashScorer()).ask(state, {"q": q})["q"]


def pick_one(state: str, instructions: str, candidates: list[str], scorer: Scorer | None = None) -> str | None:
    """The candidate that a model picks, or None if it abstains."""
    from .operators import pick

    keys = pick.derive_keys(candidates)
    q: Choice = pick.question(instructions, candidates)
    got = (scorer or HashScorer()).ask(state, {"pick": q})["pick"]["choice"]
    return next((c for c, (k, _) in zip(candidates, keys, strict=True) if k == got), None)
