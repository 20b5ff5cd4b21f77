"""Conditions, verdicts, strength and nearness of answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dist
from ..questions import Condition

#: A probability above this, or a yes-or-no answer between the two, is near a mark.
NEAR_ABOVE, NEAR_BELOW = 0.4, 0.6
_OPS = {">=": Column.__ge__, ">": Column.__gt__, "<=": Column.__le__, "<": Column.__lt__}


def prob_of(answer: Column, name: str) -> Column:
    """P(name): of yes and no for a noul, else of the option; 0 if it isn't there."""
    of_noul = answer["noul"] if name == "yes" else 1 - answer["noul"]
    return F.when(answer["type"] == "noul", of_noul).otherwise(F.coalesce(dist.prob(answer["probs"], name), F.lit(0.0)))


def holds(c: Condition, answer: Column) -> Column:
    x = F.coalesce(answer["score"], F.lit(0.0)) if c.answer is None else prob_of(answer, c.answer)
    return F.coalesce(_OPS[c.op](x, F.lit(float(c.value))) & ~F.isnan(x), F.lit(False))


def _any(columns: list[Column]) -> Column:
    out = F.lit(False)
    for c in columns:
        out = out | c
    return out


def judge(answer: Column, flags: list[Condition] = (), matches: list[Condition] = ()) -> Column:
    """flagged, matched, near, then clear (there are flags), unmatched (there are matches) or plain; null without answer."""
    named = [c for c in (*flags, *matches) if c.answer is not None]
    near = _any([prob_of(answer, c.answer) > NEAR_ABOVE for c in named]) | ((answer["type"] == "noul") & (answer["noul"] > NEAR_ABOVE) & (answer["noul"] < NEAR_BELOW))
    rest = "clear" if flags else "unmatched" if matches else "plain"
    return F.when(answer.isNull(), None).when(_any([holds(c, answer) for c in flags]), "flagged").when(_any([holds(c, answer) for c in matches]), "matched").when(F.coalesce(near, F.lit(False)), "near").otherwise(rest)


def verdicts(df: DataFrame, flags: dict[str, list[Condition]], matches: dict[str, list[Condition]], questions: list[str]) -> DataFrame:
    """``df`` with a column KEY_verdict for each answer column, and flagged and matched."""
    each = {f"{k}_verdict": judge(F.col(k), flags.get(k, []), matches.get(k, [])) for k in questions}
    out = df.withColumns(each)
    names = list(each)
    return out.withColumns({w: _any([F.coalesce(F.col(n) == w, F.lit(False)) for n in names]) for w in ("flagged", "matched")})


def strength(conditions: list[Condition], answer: Column) -> Column:
    """How far an answer leans toward its conditions: the largest P, score or negated score."""
    parts = [prob_of(answer, c.answer) if c.answer is not None else -answer["score"] if c.op in ("<=", "<") else answer["score"] for c in conditions]
    return F.greatest(*parts) if len(parts) > 1 else parts[0]


def nearness(conditions: dict[str, list[Condition]]) -> Column:
    """The largest P(answer) minus its threshold over all named answers; -Infinity if none is there."""
    parts = [prob_of(F.col(k), c.answer) - c.value for k, cs in conditions.items() for c in cs if c.answer is not None]
    if not parts:
        return F.lit(float("-inf"))
    low = [F.coalesce(p, F.lit(float("-inf"))) for p in parts]
    return F.greatest(*low) if len(low) > 1 else low[0]


def top_n(df: DataFrame, n: int, flags: dict, matches: dict, order: str, complete: Column | None = None) -> DataFrame:
    """The n complete items nearest to a flag (to a match if nothing flags), ties in input order."""
    kept = df if complete is None else df.where(complete)
    return kept.withColumn("nearness", nearness(flags or matches)).orderBy(F.col("nearness").desc(), F.col(order)).limit(n)


def fail_on(df: DataFrame, what: str, flags: dict, matches: dict) -> bool:
    """Whether any row is marked; an error if nothing can be."""
    if not {"flagged": flags, "matched": matches}[what]:
        raise ValueError(f"no question can be {what}")
    return not df.where(F.col(what)).isEmpty()
