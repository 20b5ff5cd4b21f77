"""Functions of probability distributions.

A distribution is an array of (key, p) sorted by key; folds run in key order,
so sums are the same on every run.  NaN is tested before every bound, since
Spark orders it above all numbers.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SLACK = 1e-6


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def in_unit(x: Column, slack: float = SLACK) -> Column:
    """Finite and in [0, 1], with slack; pass 0 for the strict range."""
    return finite(x) & (x >= -slack) & (x <= 1 + slack)


def from_map(m: Column) -> Column:
    return F.transform(F.array_sort(F.map_entries(m)), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("p")))


def of(**parts: Column) -> Column:
    """A distribution from named columns."""
    return F.array(*(F.struct(F.lit(k).alias("key"), parts[k].alias("p")) for k in sorted(parts)))


def total(probs: Column) -> Column:
    return F.aggregate(probs, F.lit(0.0), lambda a, e: a + e["p"])


def normalize(probs: Column) -> Column:
    """Each weight over the key-ordered sum, which is folded once."""
    pair = F.array(F.struct(probs.alias("all"), total(probs).alias("t")))
    return F.transform(pair, lambda x: F.transform(x["all"], lambda e: F.struct(e["key"].alias("key"), (e["p"] / x["t"]).alias("p"))))[0]


def prob(probs: Column, key: Column | str) -> Column:
    """The probability of a key; null if it is not there."""
    k = F.lit(key) if isinstance(key, str) else key
    return F.try_element_at(F.filter(probs, lambda e: e["key"] == k), F.lit(1))["p"]


def ranked(probs: Column) -> Column:
    """By probability, highest first; equal ones by key."""
    return F.array_sort(probs, lambda a, b: F.when(a["p"] > b["p"], -1).when(a["p"] < b["p"], 1).when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0))


def argmax(probs: Column) -> Column:
    """The most likely key, the smallest on ties."""
    return F.try_element_at(ranked(probs), F.lit(1))["key"]


def top(probs: Column) -> Column:
    return F.array_max(F.transform(probs, lambda e: e["p"]))


def margin(probs: Column) -> Column:
    """Top minus runner-up; a single option's own probability; 0 for none."""
    r = ranked(probs)
    first, second = F.try_element_at(r, F.lit(1))["p"], F.try_element_at(r, F.lit(2))["p"]
    return F.when(F.size(probs) == 0, 0.0).when(F.size(probs) == 1, first).otherwise(first - second)


def certainty(probs: Column) -> Column:
    """1 - H / ln k, held to [0, 1]; 1 for one option or none."""
    h = F.aggregate(probs, F.lit(0.0), lambda a, e: a + F.when(e["p"] > 0, -e["p"] * F.ln(e["p"])).otherwise(0.0))
    value = 1 - h / F.ln(F.size(probs).cast("double"))
    return F.when(F.size(probs) <= 1, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), value)))


def noul(p: Column) -> Column:
    """A yes-or-no probability as a distribution."""
    return of(false=1 - p, true=p)


def applicability(p: Column) -> Column:
    return 0.5 + F.abs(p - 0.5)


def expected_level(probs: Column) -> Column:
    """Sum of level times probability; keys that are no integers don't count."""
    return F.aggregate(_levels(probs), F.lit(0.0), lambda a, e: a + e["level"] * e["p"])


def _levels(probs: Column) -> Column:
    numbered = F.transform(probs, lambda e: F.struct(F.when(e["key"].rlike(r"^[+-]?\d{1,9}$"), e["key"]).cast("int").alias("level"), e["p"].alias("p")))
    return F.array_sort(F.filter(numbered, lambda e: e["level"].isNotNull()))


def level(probs: Column) -> Column:
    """The most likely level, the lowest on ties; -1 without levels."""
    best = F.array_max(F.transform(_levels(probs), lambda e: F.struct(e["p"].alias("p"), (-e["level"]).alias("minus"))))
    return F.coalesce(-best["minus"], F.lit(-1))


def normalized(score: Column, levels: Column | int) -> Column:
    """A score over its highest level; 0 for fewer than two levels."""
    n = F.lit(levels) if isinstance(levels, int) else levels
    return F.when(n < 2, 0.0).otherwise(score / (n - 1))


def temperature(probs: Column, t: Column | float) -> Column:
    """Scaled in log space from the largest logarithm; zeros stay; 1 changes nothing."""
    t = F.lit(float(t)) if isinstance(t, (int, float)) else t
    high = F.array_max(F.transform(F.filter(probs, lambda e: e["p"] > 0), lambda e: F.ln(e["p"])))

    def weight(e: Column) -> Column:
        d = F.ln(e["p"]) - high
        return F.when(e["p"] <= 0, 0.0).when(d == 0, 1.0).otherwise(F.exp(d / t))

    scaled = F.transform(probs, lambda e: F.struct(e["key"].alias("key"), weight(e).alias("p")))
    return F.when(t == 1, probs).otherwise(normalize(scaled))


def measure(kind: Column, name: str, probs: Column, noul_p: Column | None = None, confidence: Column | None = None, option: str | None = None) -> Column:
    """(value, problem) of one measure of one input.

    kind is missing, failed, abstained, noul, choice or score; problem is null,
    missing, failed, abstained, undefined or bad_value, and value null with a problem.
    """
    p = noul_p if noul_p is not None else F.lit(None).cast("double")
    conf = confidence if confidence is not None else F.lit(None).cast("double")

    def result(ok: Column, value: Column) -> Column:
        return F.when(ok, F.struct(value.cast("double").alias("value"), F.lit(None).cast("string").alias("problem"))).otherwise(problem("bad_value"))

    def problem(what: str | Column) -> Column:
        w = F.lit(what) if isinstance(what, str) else what
        return F.struct(F.lit(None).cast("double").alias("value"), w.cast("string").alias("problem"))

    of_noul = {"top": F.greatest(p, 1 - p), "margin": F.abs(2 * p - 1), "entropy": certainty(noul(p)), "applicability": applicability(p), "noul": p}
    if name == "prob" and option in ("true", "false"):
        of_noul["prob"] = p if option == "true" else 1 - p
    fine = F.size(probs).cast("int") > 0
    fine = fine & F.forall(probs, lambda e: in_unit(e["p"]))
    of_dist = {"top": top(probs), "margin": margin(probs), "entropy": certainty(probs)}
    noul_value = result(in_unit(p), of_noul[name]) if name in of_noul else problem("undefined")
    if name == "confidence":
        dist_value = F.when(conf.isNull(), problem("undefined")).otherwise(result(in_unit(conf), conf))
    elif name == "prob":
        dist_value = F.when(~F.coalesce(fine, F.lit(False)), problem("bad_value")).when(prob(probs, option or "").isNull(), problem("undefined")).otherwise(result(F.lit(True), prob(probs, option or "")))
    elif name in of_dist:
        dist_value = result(F.coalesce(fine, F.lit(False)), of_dist[name])
    else:
        dist_value = problem("undefined")
    return F.when(kind.isin("missing", "failed", "abstained"), problem(kind)).when(kind == "noul", noul_value).when(kind.isin("choice", "score"), dist_value).otherwise(problem("undefined"))
