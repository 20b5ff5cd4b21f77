"""Answers of the deterministic scorer over the test tables, in both dialects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..questions import Choice, Noul, Score, Template
from ..scorers import hash_answers

TRIAGE = Template(
    "triage-demo",
    {
        "relevant": Noul("Is this text relevant?"),
        "queue": Choice("Which queue should handle it?", (("billing", "money"), ("bug", "defects"), ("other", "all else"))),
        "impact": Score("How large is the impact?", ("none", "small", "medium", "large", "severe")),
    },
    flags={"relevant": "yes >= 60%"},
    matches={"queue": "bug >= 50%", "impact": ">= 3"},
).validate()
FLAGS, MATCHES = TRIAGE.conditions("flags"), TRIAGE.conditions("matches")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def answered(spark: SparkSession, sf_dir: str, *keys: str) -> DataFrame:
    """documents with the answers to TRIAGE (to some of its questions, if named) in columns relevant, queue and impact."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars", F.col("text").alias("state"))
    return hash_answers(docs, {k: q for k, q in TRIAGE.questions.items() if not keys or k in keys})


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    return answered(spark, sf_dir, "relevant").join(labels, "doc_id")


def h(key: str, state: str = "text") -> str:
    """SQL of ``scorers.hash_weight``."""
    return f"(('0x' || substr(md5('{key}|' || {state}), 1, 8))::BIGINT / 4294967296::DOUBLE)"


OPTIONS = ("billing", "bug", "other")
#: One row for each document: relevant; billing, bug, other; p0 to p4.
BASE_SQL = (
    "w AS (SELECT doc_id, lang, source, n_chars, text, "
    + f"{h('relevant')} AS relevant, "
    + ", ".join(f"{h(f'queue|{o}')} AS w_{o}" for o in OPTIONS)
    + ", "
    + ", ".join(f"{h(f'impact|{i}')} AS w{i}" for i in range(5))
    + " FROM documents), b AS (SELECT doc_id, lang, source, n_chars, text, relevant, "
    + ", ".join(f"w_{o} / (w_billing + w_bug + w_other) AS {o}" for o in OPTIONS)
    + ", "
    + ", ".join(f"w{i} / (w0 + w1 + w2 + w3 + w4) AS p{i}" for i in range(5))
    + " FROM w), c AS (SELECT *, greatest(billing, bug, other) AS top, "
    + "CASE WHEN billing >= bug AND billing >= other THEN 'billing' WHEN bug >= other THEN 'bug' ELSE 'other' END AS choice, "
    + "billing + bug + other - greatest(billing, bug, other) - least(billing, bug, other) AS mid, "
    + "0.0 + 0 * p0 + 1 * p1 + 2 * p2 + 3 * p3 + 4 * p4 AS score, "
    + "CASE WHEN relevant >= 0.6 THEN 'flagged' WHEN relevant > 0.4 THEN 'near' ELSE 'clear' END AS relevant_verdict "
    + "FROM b)"
)


def sql(body: str) -> str:
    return f"WITH {BASE_SQL} {body}"


def r9(c: Column) -> Column:
    return F.round(c, 9)
