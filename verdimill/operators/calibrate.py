"""Calibration against labels: cutoffs, temperature, metrics, and comparison of cohorts."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dist
from ..functions.text import framed


class CalibrationError(ValueError):
    """Datasets or settings that can't be calibrated."""


@dataclass(frozen=True)
class Config:
    max_error: float
    min_allowed: int = 1
    bins: int = 10
    risky: bool = False
    temperatures: tuple = ()

    def check(self) -> None:
        if not 0 <= self.max_error <= 1 or self.min_allowed < 1 or self.bins < 1 or any(not 0 < t < float("inf") for t in self.temperatures):
            raise CalibrationError("bounds must be in range, counts and temperatures positive")


def allowed(value: Column, cutoff: Column, risky: bool) -> Column:
    return value <= cutoff if risky else value >= cutoff


def sweep(cases: DataFrame, risky: bool = False) -> DataFrame:
    """cutoff, allowed, errors, error_rate for every distinct value (columns value and wrong).

    Cases are counted by value first; the running sums go over distinct values
    in two steps, by range block and then within it.
    """
    by = cases.groupBy("value").agg(F.count("*").alias("n"), F.count_if("wrong").alias("e"))
    block = F.floor(F.col("value") * 1024)
    by = by.withColumn("block", block)
    sums = by.groupBy("block").agg(F.sum("n").alias("bn"), F.sum("e").alias("be"))
    side = F.col("block") if risky else F.col("block").desc()
    before = Window.orderBy(side).rowsBetween(Window.unboundedPreceding, -1)  # 1,025 blocks at most
    sums = sums.select("block", F.coalesce(F.sum("bn").over(before), F.lit(0)).alias("n0"), F.coalesce(F.sum("be").over(before), F.lit(0)).alias("e0"))
    value = F.col("value") if risky else F.col("value").desc()
    run = Window.partitionBy("block").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    out = by.withColumns({"rn": F.sum("n").over(run), "re": F.sum("e").over(run)}).join(sums, "block")
    n, e = (F.col("n0") + F.col("rn")).cast("long"), (F.col("e0") + F.col("re")).cast("long")
    return out.select(F.col("value").alias("cutoff"), n.alias("allowed"), e.alias("errors"), (e / n).alias("error_rate"))


def best(candidates: DataFrame, config: Config) -> DataFrame:
    """The candidate that allows most within the error bound, the stricter cutoff on ties; no row if none fits."""
    config.check()
    fit = candidates.where((F.col("allowed") >= config.min_allowed) & (F.col("error_rate") <= config.max_error))
    strict = F.col("cutoff") if config.risky else F.col("cutoff").desc()
    return fit.orderBy(F.col("allowed").desc(), strict).limit(1)


def bin_index(p: Column, bins: int) -> Column:
    return F.least((p * bins).cast("int"), F.lit(bins - 1))


def ece_bins(cases: DataFrame, p: str, hit: str, bins: int) -> DataFrame:
    """bin, n, gap (absolute difference of summed probability and hits)."""
    return cases.groupBy(bin_index(F.col(p), bins).alias("bin")).agg(F.count("*").alias("n"), F.abs(F.sum(p) - F.sum(F.col(hit).cast("double"))).alias("gap"))


def ece(cases: DataFrame, p: str, hit: str, bins: int) -> DataFrame:
    b = ece_bins(cases, p, hit, bins)
    return b.agg((F.sum("gap") / F.sum("n")).alias("ece"))


def brier(probs: Column, label: Column) -> Column:
    """Mean squared difference over the options, in key order."""
    return F.aggregate(probs, F.lit(0.0), lambda a, e: a + F.pow(e["p"] - F.when(e["key"] == label, 1.0).otherwise(0.0), F.lit(2.0))) / F.size(probs)


def brier_noul(p: Column, hit: Column) -> Column:
    return F.pow(p - hit.cast("double"), F.lit(2.0))


def temperature_losses(cases: DataFrame, grid: tuple, probs: str = "probs", label: str = "label") -> DataFrame:
    """temperature, loss: mean log loss of the labels at each temperature of the grid and at 1; infinite if a label has none."""
    temps = sorted({1.0, *map(float, grid)})
    each = []
    for t in temps:
        p = dist.prob(dist.temperature(F.col(probs), t), F.col(label))
        each.append(F.avg(F.when(F.coalesce(p, F.lit(0.0)) <= 0, float("inf")).otherwise(-F.ln(p))).alias(f"t{len(each)}"))
    one = cases.agg(*each)  # all temperatures in one pass over the cases
    return one.select(F.inline(F.array(*(F.struct(F.lit(t).alias("temperature"), F.col(f"t{i}").alias("loss")) for i, t in enumerate(temps)))))


def fit_temperature(cases: DataFrame, grid: tuple, probs: str = "probs", label: str = "label") -> float:
    """The temperature of the lowest loss; 1 if nothing is lower, else the smaller on ties."""
    rows = {r.temperature: r.loss for r in temperature_losses(cases, grid, probs, label).collect()}
    if rows[1.0] is None:
        return 1.0
    low = min(rows.values())
    return 1.0 if rows[1.0] == low else min(t for t, x in rows.items() if x == low)


def metrics(cases: DataFrame, cutoff: float, config: Config, temperature: float = 1.0) -> DataFrame:
    """One row: count, allowed, errors, coverage, error_rate (null if none is allowed), brier, ece from value, wrong, p, hit.

    adjusted_brier and adjusted_ece are those of the probabilities at the fitted temperature.
    """
    scaled = dist.prob(dist.temperature(dist.noul(F.col("p")), temperature), "true")
    cases = cases.withColumn("_adjusted", scaled if temperature != 1.0 else F.col("p"))
    ok = allowed(F.col("value"), F.lit(float(cutoff)), config.risky)
    m = cases.agg(F.count("*").alias("count"), F.count_if(ok).alias("allowed"), F.count_if(ok & F.col("wrong")).alias("errors"), F.avg(brier_noul(F.col("p"), F.col("hit"))).alias("brier"), F.avg(brier_noul(F.col("_adjusted"), F.col("hit"))).alias("adjusted_brier"))
    both = m.join(ece(cases, "p", "hit", config.bins)).join(ece(cases, "_adjusted", "hit", config.bins).withColumnRenamed("ece", "adjusted_ece"))  # three rows of one
    return both.select("count", "allowed", "errors", (F.col("allowed") / F.col("count")).alias("coverage"), F.when(F.col("allowed") > 0, F.col("errors") / F.col("allowed")).alias("error_rate"), "brier", "ece", "adjusted_brier", "adjusted_ece")


def digest(cases: DataFrame, fields: list[str]) -> DataFrame:
    """One row: a digest of a cohort that does not depend on row order.

    The SHA-256 of each case is read as eight numbers of 32 bits; their sums over
    all cases, with the number of cases, are digested.  Sums are combined before the shuffle.
    """
    each = cases.select(F.sha2(framed(*(F.col(f).cast("string") for f in fields)), 256).alias("h"))
    words = [F.conv(F.substring("h", 8 * i + 1, 8), 16, 10).cast("decimal(12,0)") for i in range(8)]
    one = each.agg(F.count("*").alias("n"), *(F.coalesce(F.sum(w), F.lit(0)).cast("string").alias(f"s{i}") for i, w in enumerate(words)))
    return one.select(F.sha2(F.concat_ws("|", F.col("n").cast("string"), *(f"s{i}" for i in range(8))), 256).alias("digest"))


def check_cases(cases: DataFrame, options: list[str], label: str = "label", probs: str = "probs") -> None:
    """Ids are unique, labels are options, and each case has a finite probability for every option and no other, with a mass near 1."""
    p = F.transform(F.col(probs), lambda e: e["p"])
    keys = F.array_sort(F.transform(F.col(probs), lambda e: e["key"]))
    checks = {
        "a label is no option": ~F.coalesce(F.col(label).isin(*options), F.lit(False)),
        "probabilities are not those of the options": ~F.coalesce(keys == F.array(*map(F.lit, sorted(options))), F.lit(False)),
        "a probability is not in [0, 1]": F.exists(p, lambda x: ~F.coalesce(dist.in_unit(x), F.lit(False))),
        "probabilities do not sum to 1": F.abs(dist.total(F.col(probs)) - 1) > 0.05 + 0.005 * len(options),
    }
    one = cases.agg(*(F.coalesce(F.bool_or(F.coalesce(c, F.lit(False))), F.lit(False)).alias(str(i)) for i, c in enumerate(checks.values()))).first()
    for i, what in enumerate(checks):
        if one[i]:
            raise CalibrationError(what)
    if not cases.groupBy("id").count().where("count > 1").isEmpty():
        raise CalibrationError("an id is repeated")


def check_cohorts(fit: DataFrame, heldout: DataFrame, key: str = "id") -> None:
    """Ids are unique in each cohort and none is in both."""
    for df in (fit, heldout):
        if not df.groupBy(key).count().where("count > 1").isEmpty():
            raise CalibrationError("an id is repeated")
    if not fit.join(heldout, key, "left_semi").isEmpty():
        raise CalibrationError("an id is in both cohorts")


@dataclass(frozen=True)
class Artifact:
    """A frozen fit: settings, cutoff, temperature, digests and held-out metrics; no states and no questions."""

    config: dict
    cutoff: float
    temperature: float
    fit_digest: str
    heldout_digest: str
    baseline: dict
    format_version: int = 1

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True, separators=(",", ":"))

    @classmethod
    def from_json(cls, text: str) -> Artifact:
        return cls(**json.loads(text))


def fit(cases: DataFrame, heldout: DataFrame, config: Config, fields: list[str]) -> Artifact | None:
    """Fit on one cohort, measure on the other; None if no cutoff fits.  Columns: id, value, wrong, p, hit."""
    config.check()
    check_cohorts(cases, heldout)
    row = best(sweep(cases, config.risky), config).first()
    if row is None:
        return None
    as_dist = cases.withColumns({"probs": dist.noul(F.col("p")), "label": F.when(F.col("hit"), "true").otherwise("false")})
    t = fit_temperature(as_dist, config.temperatures)
    m = metrics(heldout, row.cutoff, config, t).first().asDict()
    return Artifact(asdict(config), row.cutoff, t, digest(cases, fields).first()[0], digest(heldout, fields).first()[0], m)


def compare(baseline: dict, candidate: dict, tolerance: dict) -> dict:
    """For each tolerated metric: delta, deterioration (positive is worse) and whether it exceeds the tolerance."""
    out = {}
    for name, bound in tolerance.items():
        a, b = baseline.get(name), candidate.get(name)
        if a is None or b is None:
            out[name] = {"delta": None, "deterioration": None, "exceeded": a is not None}
            continue
        worse = (a - b) if name in ("coverage", "allowed") else (b - a)
        out[name] = {"delta": b - a, "deterioration": worse, "exceeded": worse > bound}
    return out
