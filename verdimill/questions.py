"""Questions, conditions and templates, and their JSON forms."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace

DEFAULT_THRESHOLD = 0.6


class QuestionError(ValueError):
    """A question, condition or template that can't be used."""


@dataclass(frozen=True)
class Noul:
    """A yes-or-no question; the answer is the probability of yes."""

    instructions: object
    true: object = None
    false: object = None
    extra: dict = field(default_factory=dict)
    type = "noul"


@dataclass(frozen=True)
class Choice:
    """A choice among ordered options (key, description)."""

    instructions: object
    options: tuple = ()
    extra: dict = field(default_factory=dict)
    type = "choice"

    @classmethod
    def of(cls, instructions, options: dict) -> Choice:
        """Options from a mapping, sorted by key."""
        return cls(instructions, tuple(sorted(options.items())))

    @property
    def keys(self) -> list[str]:
        return [k for k, _ in self.options]


@dataclass(frozen=True)
class Score:
    """A place on an ordered scale of levels."""

    instructions: object
    levels: tuple = ()
    extra: dict = field(default_factory=dict)
    type = "score"


@dataclass(frozen=True)
class Raw:
    """Any other question, as JSON text; its type must be the one in the JSON."""

    type: str
    text: str


_TYPES: dict[str, Callable] = {}


def register_type(name: str, decode: Callable[[dict], object]) -> None:
    """Add a question type; ``decode`` gets the members of its JSON object."""
    if not name or name in ("noul", "choice", "score") or name in _TYPES:
        raise QuestionError(f"type {name!r} is taken")
    _TYPES[name] = decode


def encode(q) -> str:
    """type first, instructions, criteria in order, then extras by name."""
    if isinstance(q, Raw):
        if json.loads(q.text).get("type") != q.type:
            raise QuestionError("type differs from the JSON's")
        return q.text
    out: dict = {"type": q.type, "instructions": q.instructions}
    if isinstance(q, Noul):
        criteria = {k: v for k, v in (("true", q.true), ("false", q.false)) if v is not None}
        if criteria:
            out["criteria"] = criteria
    elif isinstance(q, Choice):
        if len(set(q.keys)) < len(q.keys):
            raise QuestionError("an option is repeated")
        out["criteria"] = dict(q.options)
    else:
        out["criteria"] = list(q.levels)
    for k in sorted(q.extra):
        if k in out:
            raise QuestionError(f"extra member {k!r} collides")
        out[k] = q.extra[k]
    return json.dumps(out, ensure_ascii=False, separators=(",", ":"))


def decode(text: str):
    """A question from JSON; unknown members become extras and unknown types Raw."""
    m = json.loads(text, object_pairs_hook=_no_repeats)
    kind = m.get("type")
    known = {"type", "instructions", "criteria"}
    extra = {k: v for k, v in m.items() if k not in known}
    criteria = m.get("criteria")
    if kind == "noul":
        criteria = criteria or {}
        return Noul(m.get("instructions"), criteria.get("true"), criteria.get("false"), extra)
    if kind == "choice":
        return Choice(m.get("instructions"), tuple((criteria or {}).items()), extra)
    if kind == "score":
        return Score(m.get("instructions"), tuple(criteria or ()), extra)
    return _TYPES[kind](m) if kind in _TYPES else Raw(kind, text)


def _no_repeats(pairs):
    if len({k for k, _ in pairs}) < len(pairs):
        raise QuestionError("a key is repeated")
    return dict(pairs)


def check(key: str, q) -> None:
    """Raise for questions that can't be asked."""
    if not key:
        raise QuestionError("a question needs a key")
    if q.type == "choice" and not q.options:
        raise QuestionError(f"{key}: a choice needs options")
    if q.type == "score" and len(q.levels) < 2:
        raise QuestionError(f"{key}: a score needs two levels or more")
    if q.type in ("noul", "choice", "score") and q.instructions in (None, ""):
        raise QuestionError(f"{key}: instructions are missing")


class QuestionSet(dict):
    """Questions by key; a key can be added once."""

    def ask(self, key: str, q) -> str:
        check(key, q)
        if key in self:
            raise QuestionError(f"question {key!r} is asked twice")
        self[key] = q
        return key


@dataclass(frozen=True)
class Condition:
    """answer (None for a score), operator and bound."""

    answer: str | None
    op: str
    value: float

    def __str__(self) -> str:
        return f"{self.op} {self.value:g}" if self.answer is None else f"{self.answer} {self.op} {self.value * 100:g}%"


# Fixed value: the form of a condition with a threshold.
_THRESHOLD = re.compile(r"(.*?)\s*(>=|>)\s*([0-9.]+)\s*%", re.S)


def parse_condition(text: str, kind: str) -> Condition:
    """``yes``, ``no >= 80%``, an option with or without a threshold, or for a score ``<= 1.5``."""
    s = text.strip()
    if kind == "score":
        m = re.fullmatch(r"(>=|<=|>|<)\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", s)
        if not m:
            raise QuestionError(f"{text!r} should compare the score, like '<= 1.5'")
        return Condition(None, m[1], float(m[2]))
    c = Condition(s, ">=", DEFAULT_THRESHOLD)
    if m := _THRESHOLD.fullmatch(s):
        try:
            v = float(m[3])
        except ValueError:
            v = 101.0
        if v > 100:
            raise QuestionError(f"{text!r} has no threshold from 0% to 100%")
        c = Condition(m[1], m[2], v / 100)
    if not c.answer or set(c.answer) & set("<>=%"):
        raise QuestionError(f"{text!r} should name an answer, like 'yes' or 'no >= 80%'")
    return c


def check_condition(c: Condition, q) -> None:
    if q.type == "noul" and c.answer not in ("yes", "no"):
        raise QuestionError(f"a yes-or-no question is marked with yes or no, not {c.answer!r}")
    if q.type == "choice" and c.answer not in q.keys:
        raise QuestionError(f"{c.answer!r} is not an option")
    if q.type == "score" and len(q.levels) > 1 and not 0 <= c.value <= len(q.levels) - 1:
        raise QuestionError(f"{c.value:g} is outside the scale")


@dataclass(frozen=True)
class Template:
    """Named questions with flags, matches and parameters."""

    name: str
    questions: dict
    flags: dict = field(default_factory=dict)
    matches: dict = field(default_factory=dict)
    params: dict = field(default_factory=dict)  # name -> default, None if required
    input: str = "text"
    each: str | None = None

    def conditions(self, kind: str) -> dict[str, list[Condition]]:
        """Conditions by question, for kind ``flags`` or ``matches``, checked."""
        out = {}
        for key, texts in getattr(self, kind).items():
            if key not in self.questions:
                raise QuestionError(f"{kind} names {key!r}, which is not a question")
            texts = [texts] if isinstance(texts, str) else texts
            if not texts:
                raise QuestionError(f"{key}: {kind} is empty")
            out[key] = [parse_condition(t, self.questions[key].type) for t in texts]
            for c in out[key]:
                check_condition(c, self.questions[key])
        return out

    def validate(self) -> Template:
        for key, q in self.questions.items():
            check(key, q)
        self.conditions("flags")
        self.conditions("matches")
        return self

    def with_params(self, **values: str) -> Template:
        """Placeholders ``{{name}}`` filled in all instructions and criteria."""
        if unknown := set(values) - set(self.params):
            raise QuestionError(f"unknown parameter {sorted(unknown)[0]!r}")
        filled = {k: values.get(k, d) for k, d in self.params.items()}
        if missing := [k for k, v in filled.items() if v is None]:
            raise QuestionError(f"parameter {missing[0]!r} is required")

        def fill(x):
            if isinstance(x, str):
                return re.sub(r"\{\{\s*([\w-]+)\s*\}\}", lambda m: filled.get(m[1], m[0]), x)
            if isinstance(x, dict):
                return {k: fill(v) for k, v in x.items()}
            return type(x)(map(fill, x)) if isinstance(x, (list, tuple)) else x

        def of(q):
            if isinstance(q, Raw):
                return Raw(q.type, json.dumps(fill(json.loads(q.text)), ensure_ascii=False))
            names = {"noul": ("instructions", "true", "false"), "choice": ("instructions", "options"), "score": ("instructions", "levels")}[q.type]
            return replace(q, **{n: fill(getattr(q, n)) for n in names})

        return replace(self, questions={k: of(q) for k, q in self.questions.items()}).validate()

    @property
    def marks(self) -> bool:
        return bool(self.flags or self.matches)

    def to_json(self) -> str:
        body = {"name": self.name, "input": self.input, "each": self.each, "params": self.params, "questions": {k: json.loads(encode(q)) for k, q in self.questions.items()}, "flags": self.flags, "matches": self.matches}
        return json.dumps({k: v for k, v in body.items() if v}, ensure_ascii=False, indent=2)

    @classmethod
    def from_json(cls, text: str) -> Template:
        m = json.loads(text, object_pairs_hook=_no_repeats)
        if unknown := set(m) - {"name", "input", "each", "params", "questions", "flags", "matches"}:
            raise QuestionError(f"unknown field {sorted(unknown)[0]!r}")
        qs = {k: decode(json.dumps(v, ensure_ascii=False)) for k, v in m["questions"].items()}
        return cls(m["name"], qs, m.get("flags", {}), m.get("matches", {}), m.get("params", {}), m.get("input", "text"), m.get("each")).validate()
