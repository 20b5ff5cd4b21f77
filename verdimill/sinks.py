"""Outputs: JSON lines, CSV, Markdown reports, annotations and text."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import store
from .functions import dist, text
from .questions import Condition

REPORT_ROWS = 100


def json_rows(items: DataFrame) -> DataFrame:
    """value: one JSON object for each row; nulls are left out."""
    return items.select(F.to_json(F.struct(*items.columns)).alias("value"))


def write_json(items: DataFrame, path: str) -> None:
    json_rows(items).write.text(path)


def csv_cells(items: DataFrame, questions: dict) -> DataFrame:
    """source, status, flagged, matched, one column for each question (a choice has two) and error; numbers with four decimals, formulas quoted."""
    number = lambda c: F.format_string("%.4f", c)
    items = items.withColumns({f"_answer_{k}": F.col(k) for k in questions}).drop(*questions)
    cells: list[Column] = [text.csv_safe(F.col("source")).alias("source"), F.col("status"), *(F.col(c).cast("string").alias(c) for c in ("flagged", "matched"))]
    for k, q in questions.items():
        a = F.col(f"_answer_{k}")
        if q.type == "noul":
            cells.append(number(a["noul"]).alias(k))
        elif q.type == "score":
            cells.append(number(a["score"]).alias(k))
        else:
            cells += [text.csv_safe(a["choice"]).alias(k), number(dist.prob(a["probs"], a["choice"])).alias(f"{k}_probability")]
    cells.append(text.csv_safe(F.coalesce(F.col("error"), F.lit(""))).alias("error"))
    return items.select(*cells)


def write_csv(items: DataFrame, questions: dict, path: str) -> None:
    csv_cells(items, questions).write.option("header", True).option("escape", '"').csv(path)


def plain_answer(answer: Column, q) -> Column:
    """``yes 88%``, ``billing 91%`` or ``2.0 of 4``."""
    if q.type == "noul":
        p = answer["noul"]
        return F.when((p > 0.4) & (p < 0.6), F.concat(F.lit("unsure "), text.percent(p))).when(p >= 0.5, F.concat(F.lit("yes "), text.percent(p))).otherwise(F.concat(F.lit("no "), text.percent(1 - p)))
    if q.type == "choice":
        return F.concat(answer["choice"], F.lit(" "), text.percent(dist.prob(answer["probs"], answer["choice"])))
    return F.concat(F.round(answer["score"], 1).cast("string"), F.lit(f" of {len(q.levels) - 1}"))


def flag_text(conditions: list[Condition]) -> str:
    return " or ".join(map(str, conditions))


def markdown_report(items: DataFrame, questions: dict, title: str) -> str:
    """Counts, then failed, flagged and matched items, REPORT_ROWS of each at most."""
    kind = F.when(F.col("status") != "complete", "Failed").when(F.col("flagged"), "Flagged").when(F.col("matched"), "Matched").otherwise("Rest")
    rows = items.withColumn("kind", kind)
    n = {r.kind: r.n for r in rows.groupBy("kind").agg(F.count("*").alias("n")).collect()}
    out = [f"# {title}", "", ", ".join(f"{n.get(k, 0)} {k.lower()}" for k in ("Failed", "Flagged", "Matched", "Rest")), ""]
    for k in ("Failed", "Flagged", "Matched", "Rest"):
        if not n.get(k):
            continue
        cells = [text.md_escape(F.col("source")).alias("source"), *(F.coalesce(text.md_escape(plain_answer(F.col(q), questions[q])), F.lit("")).alias(q) for q in questions), text.md_escape(F.coalesce(F.col("error"), F.lit(""))).alias("error")]
        table = rows.where(F.col("kind") == k).orderBy("item_index").limit(REPORT_ROWS).select(*cells).collect()
        body = ["| " + " | ".join(["Source", *questions, "Error"]) + " |", "|" + " --- |" * (len(questions) + 2)]
        body += ["| " + " | ".join(r) + " |" for r in table]
        if n[k] > REPORT_ROWS:
            body.append(f"\n{n[k] - REPORT_ROWS} more")
        out += [f"<details><summary>{k}</summary>", "", *body, "", "</details>"] if k == "Rest" else [f"## {k}", "", *body, ""]
    return "\n".join(out)


def annotations(items: DataFrame, questions: dict) -> DataFrame:
    """value: a workflow command for each item that failed (error), is flagged (warning) or matched (notice)."""
    level = F.when(F.col("status") != "complete", "error").when(F.col("flagged"), "warning").when(F.col("matched"), "notice")
    loc = text.location(F.col("source"))
    said = F.concat_ws(", ", *(F.concat(F.lit(f"{k}: "), plain_answer(F.col(k), q)) for k, q in questions.items()))
    where = F.concat(F.lit("file="), text.workflow_escape(loc["file"], True), F.coalesce(F.concat(F.lit(",line="), loc["line"].cast("string")), F.lit("")))
    message = F.when(F.col("status") != "complete", F.coalesce("error", F.lit("failed"))).otherwise(said)
    return items.withColumn("_level", level).where("_level IS NOT NULL").select(F.concat(F.lit("::"), "_level", F.lit(" "), where, F.lit("::"), text.workflow_escape(message)).alias("value"))


def append_summary(spark, items: DataFrame, questions: dict, title: str, path: str) -> None:
    """Add the Markdown report to a summary file, as steps of a workflow do."""
    store.write_text(spark, path, (store.read_text(spark, path) or "") + markdown_report(items, questions, title) + "\n")


def print_items(items: DataFrame, questions: dict, full: bool = False) -> Iterator[str]:
    """Lines of text, streamed to the driver partition by partition, in order: the item, then each answer with its verdict; ``full`` adds all probabilities, the most likely first."""
    marks = [f"{k}_verdict" for k in questions if f"{k}_verdict" in items.columns]
    ranked = [dist.ranked(F.col(f"{k}.probs")).alias(f"{k}_all") for k in questions] if full else []
    rows = items.orderBy("item_index").select("source", *(plain_answer(F.col(k), q).alias(k) for k, q in questions.items()), *marks, *ranked)
    for r in rows.toLocalIterator():
        yield r["source"]
        for k in questions:
            word = r[f"{k}_verdict"] if f"{k}_verdict" in marks else None
            yield f"  {k}: {r[k]}" + (f" [{word}]" if word in ("flagged", "matched", "near") else "")
            for p in (r[f"{k}_all"] or []) if full else []:
                yield f"    {p.key} {round(100 * p.p)}%"
