"""Selectors with branch questions: all are asked at once, the chosen branch's answers are read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..questions import Choice, QuestionError, QuestionSet


def branch_key(selector: str, option: str, local: str) -> str:
    """The wire key of a branch question; the option's length in bytes keeps keys apart."""
    return f"{selector}.{len(option.encode())}:{option}.{local}"


class Plan:
    """A choice and, for each of its options, the questions to read if it is chosen."""

    def __init__(self, selector: Choice, branches: dict[str, dict]):
        missing, extra = set(selector.keys) - set(branches), set(branches) - set(selector.keys)
        if missing or extra:
            raise QuestionError(f"branches must equal the options; missing {sorted(missing)}, extra {sorted(extra)}")
        self.selector, self.branches = selector, branches

    def attach(self, questions: QuestionSet, key: str) -> list[tuple[str, str, str, str]]:
        """Add all questions; rows (selector, branch, local, question) for ``read``."""
        questions.ask(key, self.selector)
        rows = []
        for option, locals_ in self.branches.items():
            for local, q in locals_.items():
                rows.append((key, option, local, questions.ask(branch_key(key, option, local), q)))
        return rows


BRANCHES = "selector string, branch string, local string, question string"


def read(selectors: DataFrame, answers: DataFrame, branches: DataFrame, on: list[str], choice: str = "choice") -> DataFrame:
    """Answers of the selected branch.

    selectors: the columns ``on`` and the chosen option; answers: ``on``,
    question, answer and optionally reason (why it is invalid); branches: BRANCHES.
    One row for each local question of the chosen branch: branch, local, answer, error.
    """
    b = branches.select("branch", "local", "question")
    wanted = selectors.join(F.broadcast(b), F.col(choice) == F.col("branch"), "left")  # one row for each question of a template
    got = answers if "reason" in answers.columns else answers.withColumn("reason", F.lit(None).cast("string"))
    joined = wanted.join(got, [*on, "question"], "left")
    error = F.when(F.col("branch").isNull(), F.concat(F.lit("unknown selected option "), F.coalesce(choice, F.lit("null")))).when(F.col("reason").isNotNull(), F.col("reason")).when(F.col("answer").isNull(), "missing_answer")
    return joined.select(*on, "branch", "local", "question", F.when(error.isNull(), F.col("answer")).alias("answer"), error.alias("error"))


def diagnostics(selectors: DataFrame, answers: DataFrame, branches: DataFrame, on: list[str], choice: str = "choice") -> DataFrame:
    """Every failing answer, of chosen and other branches alike, with its branch and whether it was chosen."""
    bad = answers.where("reason IS NOT NULL").join(F.broadcast(branches.select("branch", "local", "question")), "question", "left")
    return bad.join(selectors.select(*on, F.col(choice).alias("chosen")), on, "left").select(*on, "question", "branch", "local", "reason", F.coalesce(F.col("branch") == F.col("chosen"), F.lit(False)).alias("selected"))
