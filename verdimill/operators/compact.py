"""Context compaction: which segments stay whole, which in short form, under a budget."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import store
from ..questions import Noul
from ..scorers import Scorer, score


@dataclass(frozen=True)
class Rule:
    budget: int
    floor: float = 0.0
    short_below: float = 0.0

    def check(self) -> None:
        if self.budget <= 0 or not all(isinstance(x, (int, float)) and 0 <= x <= 1 for x in (self.floor, self.short_below)):
            raise ValueError("a rule needs a positive budget and bounds in [0, 1]")


def select_one(segments: list[dict], rule: Rule) -> list[tuple[str, str]]:
    """(action, cause) for the segments of one conversation, in order.

    Members: size, short_size, short (or None), pinned, needed, verbatim (or
    None) and scored.  Pinned segments stay; unscored ones come next in order;
    then the others, most needed first and later ones first on ties.  Each
    takes its preferred form, else its short form, if it fits.
    """
    rule.check()
    out: list = [None] * len(segments)
    left = rule.budget
    unscored, ranked = [], []
    for i, s in enumerate(segments):
        if s["size"] < 0 or (s["short_size"] or 0) < 0:
            raise ValueError(f"segment {i} has a negative size")
        if not s["pinned"] and s["scored"]:
            probs = [s["needed"], *([s["verbatim"]] if s["verbatim"] is not None else [])]
            if not all(p is not None and 0 <= p <= 1 for p in probs):
                raise ValueError(f"segment {i} has a score outside [0,1]")
        if s["pinned"]:
            out[i] = ("keep", "pinned")
            left -= s["size"]
        elif not s["scored"]:
            unscored.append(i)
        elif s["needed"] < rule.floor:
            out[i] = ("drop", "floor")
        else:
            ranked.append(i)
    ranked.sort(key=lambda i: (-segments[i]["needed"], -i))
    over = left < 0
    for i in unscored + ranked:
        s = segments[i]
        cause = "ranked" if s["scored"] else "unscored"
        has_short = bool(s["short"])
        want_short = s["scored"] and has_short and s["verbatim"] is not None and s["verbatim"] < rule.short_below
        if over:
            out[i] = ("drop", "budget")
        elif not want_short and s["size"] <= left:
            out[i] = ("keep", cause)
            left -= s["size"]
        elif has_short and s["short_size"] <= left:
            out[i] = ("short", cause)
            left -= s["short_size"]
        else:
            out[i] = ("drop", "budget")
    return out


def select(segments: DataFrame, conversation: str, index: str, rule: Rule) -> DataFrame:
    """conversation, index, action, cause.

    Each conversation is one sequential fold, so it is one group of a grouped
    map; a conversation's segments are bounded by what a model could read at
    all.  Only sizes, flags and scores travel, never texts.
    """
    rule.check()
    kind = segments.schema
    rows = segments.select(conversation, index, "size", "short_size", F.when(F.coalesce("short", F.lit("")) != "", "y").alias("short"), "pinned", "needed", "verbatim", "scored")

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(index)
        recs = pdf.astype(object).where(pdf.notna(), None).to_dict("records")
        got = select_one(recs, rule)
        return pd.DataFrame({conversation: pdf[conversation], index: pdf[index], "action": [a for a, _ in got], "cause": [c for _, c in got]})

    return rows.groupBy(conversation).applyInPandas(fold, f"`{conversation}` {kind[conversation].dataType.simpleString()}, `{index}` {kind[index].dataType.simpleString()}, action string, cause string")


def totals(segments: DataFrame, decisions: DataFrame, conversation: str, index: str) -> DataFrame:
    """Sizes before and after, by conversation."""
    both = segments.join(decisions, [conversation, index])
    after = F.when(F.col("action") == "keep", F.col("size")).when(F.col("action") == "short", F.col("short_size")).otherwise(0)
    return both.groupBy(conversation).agg(F.sum("size").cast("long").alias("before"), F.sum(after).cast("long").alias("after"), F.count_if(F.col("action") == "drop").alias("dropped"))


def pack(segments: DataFrame, conversation: str, index: str, tokens: str, limit: int) -> DataFrame:
    """conversation, index, batch: segments packed in order into requests of at most ``limit`` tokens; null if one alone is too large."""
    kind = segments.schema

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(index)
        batch, used, out = 0, 0, []
        for n in pdf[tokens].tolist():
            if n > limit:
                out.append(None)
                continue
            if used and used + n > limit:
                batch, used = batch + 1, 0
            used += n
            out.append(batch)
        return pd.DataFrame({conversation: pdf[conversation], index: pdf[index], "batch": pd.array(out, "Int64")})

    return segments.select(conversation, index, tokens).groupBy(conversation).applyInPandas(fold, f"`{conversation}` {kind[conversation].dataType.simpleString()}, `{index}` {kind[index].dataType.simpleString()}, batch long")


#: The two questions about a segment.
QUESTIONS = {"needed": Noul("Is this part needed to go on with the conversation?"), "verbatim": Noul("Must this part stay word for word?")}


def compact(segments: DataFrame, conversation: str, index: str, rule: Rule, scorer: Scorer, tokens: str, limit: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(decisions, totals by conversation, one row of totals) of conversations: pack, ask, select.

    ``segments`` has text, size, short_size, short and pinned.  Segments that are
    neither pinned nor too large for a request are asked about; those without an answer count as unscored.
    """
    packed = pack(segments.where(~F.col("pinned")), conversation, index, tokens, limit)
    asked = segments.join(packed.where("batch IS NOT NULL"), [conversation, index])
    answers = store.settle(score(asked.select(conversation, index, "batch", "text"), QUESTIONS, scorer, state="text"))
    good = answers.where("error IS NULL").select(conversation, index, *(F.col("answers")[k]["noul"].alias(k) for k in QUESTIONS))
    scored = segments.drop(*QUESTIONS, "scored").join(good, [conversation, index], "left").withColumn("scored", F.col("needed").isNotNull())
    decisions = store.settle(select(scored, conversation, index, rule))
    per = totals(segments, decisions, conversation, index)
    known = F.when(F.col("error").isNull() & (F.coalesce("model", F.lit("")) != ""), F.col("model"))
    used = answers.agg(F.count_distinct(conversation, "batch").alias("requests"), F.count_if(F.col("error").isNotNull()).alias("failed"), F.sort_array(F.collect_set(known)).alias("models"))
    size = asked.agg(F.coalesce(F.sum(tokens), F.lit(0)).alias("tokens"))
    whole = per.agg(F.sum("before").alias("before"), F.sum("after").alias("after"), F.sum("dropped").alias("dropped")).join(used).join(size)  # rows of one
    return decisions, per, whole
