"""Requests and responses as JSON: the native form and the dialects of providers.

Everything here runs inside scorers; no dialect opens a connection.
"""

from __future__ import annotations

import base64
import json
import math
import re
from dataclasses import dataclass, field

from .questions import Noul, QuestionError, check, encode

#: Members of a request that extras can't replace.
RESERVED = frozenset(("state", "model", "questions"))


class WireError(ValueError):
    """A request that can't be sent or a response that can't be read."""


def text_of(value) -> str:
    """A string as it is, null as nothing, anything else as compact JSON."""
    if value is None:
        return ""
    return value if isinstance(value, str) else json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def validate_request(state, questions: dict, extra: dict | None = None) -> None:
    if state is None:
        raise WireError("state is missing")
    if isinstance(state, (bytes, bytearray)):
        raise WireError("state must not be raw bytes")
    if not questions:
        raise WireError("a request needs a question")
    for k, q in questions.items():
        try:
            check(k, q)
        except QuestionError as e:
            raise WireError(str(e)) from None
    if taken := RESERVED & set(extra or {}):
        raise WireError(f"extra member {sorted(taken)[0]!r} is reserved")


def encode_request(state, questions: dict, model: str = "", extra: dict | None = None) -> str:
    """state, model, questions by key, then extras by name."""
    validate_request(state, questions, extra)
    out = {"state": state} | ({"model": model} if model else {}) | {"questions": {k: json.loads(encode(questions[k])) for k in sorted(questions)}}
    return json.dumps(out | {k: extra[k] for k in sorted(extra or {})}, ensure_ascii=False, separators=(",", ":"))


@dataclass
class Response:
    """model, answers by key (dictionaries; ``decode_error`` marks those that can't be read), usage, and members not known."""

    model: str = ""
    answers: dict = field(default_factory=dict)
    usage: dict = field(default_factory=lambda: {"input_tokens": 0, "output_tokens": 0})
    extra: dict = field(default_factory=dict)


_FIELDS = {"noul": ("noul",), "choice": ("choice", "probabilities", "confidence"), "score": ("score", "probabilities", "confidence", "legend")}


def _strict(text: str):
    def number(s: str) -> float:
        v = float(s)
        if math.isinf(v):
            raise ValueError(f"{s} is out of range")
        return v

    def never(s: str):
        raise ValueError(f"{s} is no JSON")

    return json.loads(text, parse_float=number, parse_constant=never)


def decode_answer(a, q=None) -> dict:
    """One answer; ``missing`` lists required members that are absent."""
    if not isinstance(a, dict):
        return {"type": None, "decode_error": "not an object", "raw": json.dumps(a)}
    kind = a.get("type") or (q.type if q is not None else None)
    wanted = _FIELDS.get(kind)
    if wanted is None:
        return {"type": kind, "raw": json.dumps(a)}
    is_number = lambda x: isinstance(x, (int, float)) and not isinstance(x, bool)
    ok = {"noul": is_number, "score": is_number, "confidence": is_number, "choice": lambda x: isinstance(x, str), "legend": lambda x: isinstance(x, dict), "probabilities": lambda x: isinstance(x, dict) and all(map(is_number, x.values()))}
    wrong = [k for k in wanted if a.get(k) is not None and not ok[k](a[k])]
    if wrong:
        return {"type": kind, "decode_error": f"{wrong[0]} has the wrong type", "raw": json.dumps(a)}
    out = {"type": kind} | {k: a.get(k) for k in wanted}
    return out | {"missing": [k for k in wanted if a.get(k) is None]}


def decode_response(text: str, questions: dict | None = None) -> Response:
    """Lenient: unknown members are kept, and an answer that can't be read does not fail the others."""
    try:
        m = _strict(text)
    except ValueError as e:
        raise WireError(f"response: {e}") from None
    if not isinstance(m, dict):
        raise WireError("response is no object")
    r = Response(extra={k: v for k, v in m.items() if k not in ("model", "answers", "usage")})
    if isinstance(m.get("model"), str):
        r.model = m["model"]
    elif m.get("model") is not None:
        r.extra["model"] = m["model"]
    answers = m.get("answers")
    if answers is not None:
        if not isinstance(answers, dict):
            raise WireError("answers are no object")
        r.answers = {k: decode_answer(a, (questions or {}).get(k)) for k, a in answers.items()}
    usage = m.get("usage")
    if isinstance(usage, dict):
        r.usage |= usage
    elif usage is not None:
        r.extra["usage"] = usage
    return r


@dataclass(frozen=True)
class Dialect:
    """The native form with a provider's limits."""

    name: str = "native"
    max_questions: int = 64
    max_options: int = 255
    max_levels: int = 10
    key: str = r"[A-Za-z0-9_.-]{1,100}"
    models: tuple[str, ...] = ()
    kinds = ("noul", "choice", "score")

    def check(self, state, questions: dict, model: str = "") -> None:
        validate_request(state, questions)
        if self.models and model not in self.models:
            raise WireError(f"model must be one of {', '.join(self.models)}")
        if len(questions) > self.max_questions:
            raise WireError(f"at most {self.max_questions} questions fit")
        for k, q in questions.items():
            if not re.fullmatch(self.key, k):
                raise WireError(f"question key {k!r} is not allowed")
            if q.type not in self.kinds:
                raise WireError(f"questions of type {q.type} are not supported")
            if q.type == "choice" and not 2 <= len(q.options) <= self.max_options:
                raise WireError(f"a choice needs 2 to {self.max_options} options")
            if q.type == "score" and not 2 <= len(q.levels) <= self.max_levels:
                raise WireError(f"a score needs 2 to {self.max_levels} levels")
            if not text_of(q.instructions).strip():
                raise WireError("instructions must not be empty")

    def request(self, state, questions: dict, model: str = "", extra: dict | None = None) -> str:
        self.check(state, questions, model)
        return encode_request(state, questions, model, extra)

    def response(self, text: str, questions: dict, model: str = "") -> Response:
        m = _strict(text)
        if isinstance(m, dict) and "result" in m and "answers" not in m:
            m = m["result"]  # the answer came in an envelope
        return decode_response(json.dumps(m), questions)


def _merge(body: dict, extra: dict | None) -> str:
    rest = {k: v for k, v in sorted((extra or {}).items()) if k not in body}
    return json.dumps(body | rest, ensure_ascii=False, separators=(",", ":"))


@dataclass(frozen=True)
class ListDialect(Dialect):
    """Questions and answers as lists with names; yes-or-no questions are predicates."""

    name: str = "list"
    max_questions: int = 200
    max_options: int = 1 << 30
    max_levels: int = 1 << 30
    key: str = r"(?s).+"

    def request(self, state, questions, model="", extra=None):
        self.check(state, questions, model)
        asked = []
        for k in sorted(questions):
            q = questions[k]
            one = {"name": k, "type": "predicate" if q.type == "noul" else q.type, "instructions": text_of(q.instructions)}
            if isinstance(q, Noul):
                for word, c in (("Yes", q.true), ("No", q.false)):
                    if text_of(c):
                        one["instructions"] += f"\n\n{word} means: {text_of(c)}"
            elif q.type == "choice":
                one["choices"] = [{"value": o} | ({"description": text_of(d)} if text_of(d) else {}) for o, d in q.options]
            else:
                one["levels"] = [{"label": text_of(x)} for x in q.levels]
            asked.append(one)
        return _merge({"model": model, "input": text_of(state), "questions": asked}, extra)

    def response(self, text, questions, model=""):
        m = _strict(text)
        if not isinstance(m, dict) or not isinstance(m.get("answers"), list):
            raise WireError("answers must be a list")
        answers: dict = {}
        for a in m["answers"]:
            k = a.get("name") if isinstance(a, dict) else None
            if not isinstance(k, str) or not k:
                raise WireError("an answer has no name")
            if k in answers:
                raise WireError(f"{k!r} is answered twice")
            one = {x: v for x, v in a.items() if x != "name"}
            if one.get("type") == "predicate" and "probability" in one:
                one = one | {"type": "noul", "noul": one.pop("probability")}
            elif one.get("type") in ("choice", "score") and isinstance(one.get("probabilities"), list):
                probs = one["probabilities"]
                one["probabilities"] = {str(p["value"]): p["probability"] for p in probs}
                if one["type"] == "score":
                    q = questions.get(k)
                    levels = list(q.levels) if q is not None and q.type == "score" and len(q.levels) == len(probs) else None
                    one.setdefault("legend", {str(p["value"]): levels[p["value"]] if levels and 0 <= p["value"] < len(levels) else p.get("label") for p in probs})
            answers[k] = one
        return decode_response(json.dumps(m | {"answers": answers}), questions)


@dataclass(frozen=True)
class MapDialect(Dialect):
    """Questions and answers as objects; descriptions are plain text and token counts have other names."""

    name: str = "map"
    max_questions: int = 1000
    max_levels: int = 255
    key: str = r"[A-Za-z0-9_-]{1,64}"

    def request(self, state, questions, model="", extra=None):
        self.check(state, questions, model)
        asked = {}
        for k, q in questions.items():
            one: dict = {"type": q.type, "instructions": text_of(q.instructions)}
            if isinstance(q, Noul):
                c = {n: text_of(v) for n, v in (("true_description", q.true), ("false_description", q.false)) if text_of(v)}
                if c:
                    one["criteria"] = c
            elif q.type == "choice":
                one["criteria"] = {o: text_of(d) for o, d in q.options}
            else:
                one["criteria"] = [text_of(x) for x in q.levels]
                if not all(x.strip() for x in one["criteria"]):
                    raise WireError("levels must not be empty")
            asked[k] = one
        return _merge({"model": model, "input": text_of(state), "questions": asked}, extra)

    def response(self, text, questions, model=""):
        m = _strict(text)
        if not isinstance(m, dict) or not isinstance(m.get("answers"), dict) or not all(isinstance(a, dict) for a in m["answers"].values()):
            raise WireError("answers must be an object of objects")
        for k, a in m["answers"].items():
            q = questions.get(k)
            if a.get("type") == "score" and q is not None and q.type == "score":
                a["legend"] = {str(i): x for i, x in enumerate(q.levels)}
        m.setdefault("model", model)
        usage = m.get("usage")
        if isinstance(usage, dict):
            for ours, theirs in (("input_tokens", "total_input_tokens"), ("output_tokens", "total_output_tokens")):
                if theirs in usage:
                    usage[ours] = usage[theirs]
        return decode_response(json.dumps(m), questions)


DIALECTS = {d.name: d for d in (Dialect(), ListDialect(), MapDialect())}


def media_blocks(state: str, files: list[tuple[str, bytes | str]], max_bytes: int = 13 << 20) -> list[dict]:
    """A text block and one block for each file (content type, and bytes or an address)."""
    out: list[dict] = [{"type": "text", "text": state}]
    for content_type, data in files:
        kind = content_type.split("/")[0]
        out.append({"type": kind, "media_type": content_type} | ({"url": data} if isinstance(data, str) else {"data": base64.b64encode(data).decode()}))
    if len(json.dumps(out)) > max_bytes:
        raise WireError("the request is too large")
    return out


def flagged_of(answers: dict, thresholds: dict[str, float | None], default: float = 0.6) -> list[str]:
    """Keys whose P(yes) reaches its threshold, most likely first; missing answers flag nothing."""
    hit = {k: answers[k]["noul"] for k, t in thresholds.items() if isinstance(answers.get(k), dict) and answers[k].get("noul") is not None and answers[k]["noul"] >= (default if t is None else t)}
    return sorted(hit, key=lambda k: (-hit[k], k))
