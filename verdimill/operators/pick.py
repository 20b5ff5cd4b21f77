"""Picking one candidate: keys, the question, and the result."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dist
from ..questions import Choice

ABSTAIN, MAX_KEY, MAX_OPTIONS = "none", 64, 255


class PickError(ValueError):
    """Candidates that can't become options."""


def sanitize(text: str) -> str:
    """White space and control characters become single spaces, none at the ends."""
    return " ".join("".join(" " if c.isspace() or unicodedata.category(c) == "Cc" else c for c in text).split())


def derive_keys(candidates: list[str], abstain: str = ABSTAIN, max_key: int = MAX_KEY) -> list[tuple[str, str | None]]:
    """(key, description) for each candidate, in order.

    The clean text is the key if it is short enough, else c1, c2 and so on by
    place; a key that is taken gets " (2)", " (3)" and so on.  A candidate whose text is not its key keeps the text as description.
    """
    if len(candidates) + 1 > MAX_OPTIONS:
        raise PickError(f"{len(candidates)} candidates; at most {MAX_OPTIONS - 1} fit")
    used, out = {abstain}, []
    for i, text in enumerate(candidates):
        base = sanitize(text)
        if not base or len(base) > max_key:
            base = f"c{i + 1}"
        key, n = base, 2
        while key in used:
            key, n = f"{base} ({n})", n + 1
        used.add(key)
        out.append((key, text if text != key else None))
    return out


def question(instructions: str, candidates: list[str], abstain: str = ABSTAIN) -> Choice:
    """A choice with one option for each candidate and, last, the option to abstain."""
    return Choice(instructions, (*derive_keys(candidates, abstain), (abstain, "None of the above.")))


def keys_by_group(df: DataFrame, group: str, order: str, text: str) -> DataFrame:
    """``group``, ``order``, key, description: keys derived for each group of candidates (MAX_OPTIONS - 1 at most)."""
    import pandas as pd

    kind = df.schema

    def derive(pdf):
        pdf = pdf.sort_values(order)
        got = derive_keys(pdf[text].tolist())
        return pd.DataFrame({group: pdf[group], order: pdf[order], "key": [k for k, _ in got], "description": [d for _, d in got]})

    return df.groupBy(group).applyInPandas(derive, f"`{group}` {kind[group].dataType.simpleString()}, `{order}` {kind[order].dataType.simpleString()}, key string, description string")


def result(answer: Column, abstain: str = ABSTAIN) -> Column:
    """choice, p, abstained, abstain_p, runner_up, runner_p, margin of a choice answer; the margin may be negative."""
    choice = answer["choice"]
    p = F.coalesce(dist.prob(answer["probs"], choice), F.lit(0.0))
    other = F.try_element_at(F.filter(dist.ranked(answer["probs"]), lambda e: e["key"] != choice), F.lit(1))
    return F.struct(
        choice.alias("choice"),
        p.alias("p"),
        (choice == abstain).alias("abstained"),
        F.coalesce(dist.prob(answer["probs"], abstain), F.lit(0.0)).alias("abstain_p"),
        other["key"].alias("runner_up"),
        other["p"].alias("runner_p"),
        (p - F.coalesce(other["p"], F.lit(0.0))).alias("margin"),
    )


def read(answers: DataFrame, candidates: DataFrame, answer: str = "answer", key: str = "key", abstain: str = ABSTAIN, on: list[str] | None = None) -> DataFrame:
    """Answers joined to the candidate their choice names; ``error`` where a choice names none (abstaining names none and is fine)."""
    on = on or []
    marked = candidates.withColumn("_there", F.lit(True))
    cond = F.col(f"{answer}.choice") == F.col(f"_c.{key}")
    for c in on:
        cond = cond & (F.col(f"_a.{c}") == F.col(f"_c.{c}"))
    joined = answers.alias("_a").join(marked.alias("_c"), cond, "left")
    error = F.when(F.col("_there").isNull() & (F.col(f"{answer}.choice") != abstain), F.concat(F.lit("unknown candidate "), F.col(f"{answer}.choice")))
    keep = [F.col(f"_c.{c}") for c in candidates.columns if c not in answers.columns]
    return joined.select("_a.*", *keep, error.alias("error"))
