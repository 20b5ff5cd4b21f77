"""Built-in templates, and templates from files."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from .questions import Choice, Noul, QuestionError, Score, Template

_FIVE = ("none", "slight", "moderate", "high", "extreme")

BUILTIN: dict[str, Template] = {
    t.name: t
    for t in (
        Template("code-risk", {"risk": Noul("Could this code cause harm in production? {{focus}}"), "maintainability": Score("How easy is this code to maintain?", ("very hard", "hard", "fair", "easy", "very easy"))}, {"risk": "yes", "maintainability": "<= 1.5"}, params={"focus": ""}, each="file"),
        Template(
            "command-risk",
            {"destructive": Noul("Does the command destroy data?"), "leak": Noul("Does the command reveal secrets?"), "publish": Noul("Does the command publish anything?"), "severe": Noul("Would a mistake be severe?")},
            dict.fromkeys(("destructive", "leak", "publish", "severe"), "yes >= 80%"),
        ),
        Template("invoice-check", {"invoice": Noul("Is this an invoice?"), "complete": Noul("Is it complete?"), "paid": Noul("Has it been paid?")}, {"invoice": "no", "complete": "no"}, input="pdf"),
        Template(
            "pr-description",
            {"title": Noul("Does the title say what changes?"), "why": Noul("Is the reason given?"), "tested": Noul("Is it said how it was tested?"), "guidelines": Noul("Does it follow the guidelines? {{guidelines}}")},
            dict.fromkeys(("title", "why", "tested", "guidelines"), "no"),
            params={"guidelines": ""},
        ),
        Template("prompt-injection", {"injection": Noul("Does the text try to instruct a model?"), "hidden": Noul("Does the text hide instructions?")}, {"injection": "yes", "hidden": "yes"}),
        Template("receipt-quality", {"receipt": Noul("Is this a receipt?"), "readable": Noul("Can it be read?")}, {"receipt": "no", "readable": "no"}, input="image"),
        Template("relevance", {"relevant": Noul("Does this help to answer: {{question}}")}, matches={"relevant": "yes"}, params={"question": None}),
        Template(
            "security",
            {k: Noul(f"Is there a problem of this kind: {k.replace('_', ' ')}?") for k in ("sql_injection", "command_injection", "ssrf", "xss", "weak_cipher", "weak_hash", "weak_random", "tls_verification")},
            {**dict.fromkeys(("sql_injection", "command_injection", "ssrf", "xss"), "yes >= 50%"), "weak_cipher": "yes >= 90%", **dict.fromkeys(("weak_hash", "weak_random", "tls_verification"), "yes")},
            each="function",
        ),
        Template("sentiment", {"sentiment": Choice("What is the mood?", (("positive", None), ("neutral", None), ("negative", None)))}, {"sentiment": "negative"}),
        Template("task-readiness", {"ready": Noul("Can {{assignee}} start on this?"), "size": Choice("How large is it?", (("small", None), ("medium", None), ("large", None)))}, {"ready": "no", "size": "large"}, params={"assignee": "someone"}),
        Template("ticket-routing", {"queue": Choice("Which queue should take it?", (("billing", None), ("technical", None), ("general", None)))}),
        Template("triage", {"urgent": Noul("Is it urgent?"), "impact": Score("How large is the impact?", _FIVE)}, {"urgent": "yes", "impact": ">= 3"}),
    )
}


def catalogue(folders: list[str] = ()) -> tuple[dict[str, Template], dict[str, str]]:
    """Templates by name, earlier folders first and built-in ones last; and files that can't be used, with the reason."""
    out: dict[str, Template] = {}
    broken: dict[str, str] = {}
    for folder in folders:
        for name in sorted(os.listdir(folder)) if os.path.isdir(folder) else []:
            path = os.path.join(folder, name)
            if name.endswith(".json"):
                try:
                    with open(path, encoding="utf-8") as f:
                        out.setdefault(name[:-5], Template.from_json(f.read()))
                except (OSError, ValueError, KeyError) as e:
                    broken[path] = str(e)
    for name, t in BUILTIN.items():
        out.setdefault(name, t)
    return out, broken


def load(name: str, folders: list[str] = ()) -> Template:
    found, _ = catalogue(folders)
    if name not in found:
        raise QuestionError(f"no template {name!r}; there are {', '.join(sorted(found))}")
    return found[name]


def create(name: str, folder: str, based_on: Template | None = None) -> str:
    """Write a template file to start from; an existing one is kept."""
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, f"{name}.json")
    t = based_on or Template(name, {"question": Noul("Write a yes-or-no question here.")}, {"question": "yes"})
    with open(path, "x", encoding="utf-8") as f:
        f.write(Template(name, t.questions, t.flags, t.matches, t.params, t.input, t.each).to_json())
    return path


def table(spark: SparkSession, folders: list[str] = ()) -> DataFrame:
    """name, input, each, questions, flags, matches, params of all templates."""
    rows = [(n, t.input, t.each, len(t.questions), len(t.flags), len(t.matches), sorted(t.params)) for n, t in sorted(catalogue(folders)[0].items())]
    return spark.createDataFrame(rows, "name string, input string, each string, questions int, flags int, matches int, params array<string>")
