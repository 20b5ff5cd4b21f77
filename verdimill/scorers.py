"""Scoring models.  The default is deterministic and needs no network."""

from __future__ import annotations

import datetime
import email.utils
import hashlib
import json
import queue
import random
import threading
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions import dist
from .questions import encode
from .schemas import ANSWER

RETRY_STATUS = frozenset((408, 429))


def hash_weight(key: str, state: Column) -> Column:
    """A number in [0, 1) from the MD5 of key and state."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{key}|"), state).cast("binary")), 1, 8), 16, 10).cast("double") / 4294967296.0


def _keys(q) -> list[str]:
    return sorted(q.keys) if q.type == "choice" else [str(i) for i in range(len(q.levels))] if q.type == "score" else []


def _weights(key: str, q, state: Column) -> list[Column]:
    return [hash_weight(key, state)] if q.type == "noul" else [hash_weight(f"{key}|{k}", state) for k in _keys(q)]


def _shares(weights: list[Column]) -> list[Column]:
    """Each weight over their sum, which is built in key order."""
    total = F.lit(0.0)
    for w in weights:
        total = total + w
    return [w / total for w in weights]


def _from_probs(q, probs: Column) -> Column:
    n = len(_keys(q))
    confidence = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (n * dist.top(probs) - 1) / (n - 1))) if n > 1 else F.lit(1.0)
    if q.type == "choice":
        return _answer("choice", choice=dist.argmax(probs), confidence=confidence, probs=probs)
    legend = F.array(*(F.struct(F.lit(str(i)).alias("key"), F.lit(json.dumps(x)).alias("label")) for i, x in enumerate(q.levels)))
    return _answer("score", score=dist.expected_level(probs), confidence=confidence, probs=probs, legend=legend if n else F.lit(None))


def hash_answer(key: str, q, state: Column) -> Column:
    """The deterministic answer to one question as an ANSWER column; everything stays in the JVM."""
    weights = _weights(key, q, state)
    return _answer("noul", noul=weights[0]) if q.type == "noul" else _from_probs(q, dist.of(**dict(zip(_keys(q), _shares(weights), strict=True))))


def _answer(kind: str, **parts: Column) -> Column:
    types = {"noul": "double", "choice": "string", "score": "double", "confidence": "double", "probs": "array<struct<key:string,p:double>>", "legend": "array<struct<key:string,label:string>>", "raw": "string", "decode_error": "string"}
    return F.struct(F.lit(kind).alias("type"), *((parts[k] if k in parts else F.lit(None)).cast(t).alias(k) for k, t in types.items()))


def once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``df`` with columns that are computed once for each row, however often they are read: projections aren't merged across ``inline``."""
    return df.select(*(F.col(f"`{c}`") for c in df.columns if c not in columns), F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items()))))) if columns else df


def hash_answers(items: DataFrame, questions: dict, state: str = "state") -> DataFrame:
    """``items`` with one ANSWER column for each question, named by its key: hashes first, then distributions, then answers."""
    hashes, probs, answers = {}, {}, {}
    for i, (key, q) in enumerate(questions.items()):
        names = [f"_w{i}_{j}" for j in range(len(_keys(q)) or 1)]
        hashes |= dict(zip(names, _weights(key, q, F.col(state)), strict=True))
        if q.type == "noul":
            answers[key] = _answer("noul", noul=F.col(names[0]))
        else:
            probs[f"_p{i}"] = dist.of(**dict(zip(_keys(q), _shares([F.col(n) for n in names]), strict=True)))
            answers[key] = _from_probs(q, F.col(f"_p{i}"))
    out = once(once(once(items, hashes), probs), answers)
    return out.drop(*hashes, *probs)


class Scorer:
    """One attempt at answering all questions about one state: name -> answer as a dictionary."""

    #: The name it is asked for by, and what it reports itself as (the name, if empty).
    model = "none"
    version = ""
    #: Whether calls can fail as a whole (a service that is down); then a run asks a few items first.
    remote = False

    def ask(self, state: str, questions: dict) -> dict[str, dict]:
        raise NotImplementedError


class HashScorer(Scorer):
    """The same values as ``hash_answer``, one item at a time."""

    model = "hash-1"

    def _weight(self, key: str, state: str) -> float:
        return int(hashlib.md5(f"{key}|{state}".encode()).hexdigest()[:8], 16) / 4294967296.0

    def ask(self, state, questions):
        out = {}
        for key, q in questions.items():
            if q.type == "noul":
                out[key] = {"type": "noul", "noul": self._weight(key, state)}
                continue
            names = q.keys if q.type == "choice" else [str(i) for i in range(len(q.levels))]
            weights = {k: self._weight(f"{key}|{k}", state) for k in sorted(names)}
            total = 0.0
            for w in weights.values():
                total += w
            probs = {k: w / total for k, w in weights.items()}
            n, high = len(names), max(probs.values())
            a = {"type": q.type, "probabilities": probs, "confidence": max(0.0, min(1.0, (n * high - 1) / (n - 1))) if n > 1 else 1.0}
            if q.type == "choice":
                a["choice"] = min(k for k, p in probs.items() if p == high)
            else:
                a["score"] = 0.0
                for k in sorted(probs, key=int):
                    a["score"] += int(k) * probs[k]
                a["legend"] = {str(i): x for i, x in enumerate(q.levels)}
            out[key] = a
        return out


class UniformScorer(Scorer):
    """A half for yes or no, equal shares for options and levels, the middle of a scale."""

    model = "uniform-1"

    def ask(self, state, questions):
        out = {}
        for key, q in questions.items():
            if q.type == "noul":
                out[key] = {"type": "noul", "noul": 0.5}
            elif q.type == "choice":
                out[key] = {"type": "choice", "choice": q.keys[0], "probabilities": {k: 1 / len(q.keys) for k in q.keys}, "confidence": 0.0}
            else:
                n = len(q.levels)
                out[key] = {"type": "score", "score": (n - 1) / 2, "probabilities": {str(i): 1 / n for i in range(n)}, "confidence": 0.0, "legend": {str(i): x for i, x in enumerate(q.levels)}}
        return out


@dataclass
class TableScorer(Scorer):
    """Answers looked up by (state, question key)."""

    table: dict
    model: str = "table-1"

    def ask(self, state, questions):
        return {k: self.table[state, k] for k in questions if (state, k) in self.table}


@dataclass(frozen=True)
class Retry:
    """How often and how long to wait: initial * 2 ** k, at most ``maximum``, less up to a quarter; seconds for one attempt, 0 for any."""

    retries: int = 2
    initial: float = 0.5
    maximum: float = 5.0
    attempt: float = 0.0

    def delay(self, k: int, r: float = 0.0, after: float | None = None) -> float:
        if after is not None:
            return max(0.0, min(after, 60.0))
        return min(self.initial * 2**k, self.maximum) * (1 - 0.25 * r)


class CallError(Exception):
    """A failed attempt; ``status`` as in HTTP, 0 for a broken connection."""

    def __init__(self, message: str, status: int = 0, after: float | None = None):
        super().__init__(message)
        self.status, self.after = status, after


def retryable(e: Exception) -> bool:
    """Timeouts, resets, 408, 429 and 5xx are tried again; refused credentials and bad requests are not."""
    if isinstance(e, CallError):
        return e.status == 0 or e.status in RETRY_STATUS or e.status >= 500
    return isinstance(e, (TimeoutError, ConnectionResetError, ConnectionAbortedError))


def fatal(e: Exception) -> bool:
    """Refused credentials: no other item will fare better."""
    return isinstance(e, CallError) and e.status in (401, 403)


def retry_after(header: str, now: datetime.datetime | None = None) -> float | None:
    """Seconds that a Retry-After header asks for: a number or an HTTP date; None if it is neither."""
    if header.strip().isdigit():
        return float(header)
    try:
        at = email.utils.parsedate_to_datetime(header)
    except ValueError:
        return None
    at = at if at.tzinfo else at.replace(tzinfo=datetime.timezone.utc)
    return max(0.0, (at - (now or datetime.datetime.now(datetime.timezone.utc))).total_seconds())


def within(call: Callable[[], dict], seconds: float) -> dict:
    """The call's result, or TimeoutError after so many seconds; the call itself is left behind."""
    got: queue.SimpleQueue = queue.SimpleQueue()

    def work() -> None:
        try:
            got.put((call(), None))
        except Exception as e:
            got.put((None, e))

    threading.Thread(target=work, daemon=True).start()
    try:
        value, e = got.get(timeout=seconds)
    except queue.Empty:
        raise TimeoutError(f"no answer in {seconds:g} s") from None
    if e is not None:
        raise e
    return value


def with_retry(call: Callable[[], dict], retry: Retry, sleep: Callable[[float], None] = time.sleep, jitter: Callable[[], float] = random.random) -> dict:
    for k in range(retry.retries + 1):
        try:
            return within(call, retry.attempt) if retry.attempt else call()
        except Exception as e:
            if k == retry.retries or not retryable(e):
                raise
            sleep(retry.delay(k, jitter(), getattr(e, "after", None)))
    raise AssertionError


def to_row(a: dict) -> dict:
    """An answer dictionary as a row of ANSWER."""
    probs = a.get("probabilities")
    legend = a.get("legend")
    return {
        "type": a.get("type"), "noul": a.get("noul"), "choice": a.get("choice"), "score": a.get("score"), "confidence": a.get("confidence"),
        "probs": None if probs is None else [{"key": k, "p": float(probs[k])} for k in sorted(probs)],
        "legend": None if legend is None else [{"key": k, "label": json.dumps(legend[k], ensure_ascii=False)} for k in sorted(legend)],
        "raw": None, "decode_error": None,
    }


def score(items: DataFrame, questions: dict, scorer: Scorer, state: str = "state", workers: int = 4, parallelism: int | None = None, retry: Retry | None = None, breaker: int = 5, only: str | None = None) -> DataFrame:
    """Ask a model about every item: ``items`` with answers (map of ANSWER by key), model and error.

    Items go through ``mapInPandas``; each task asks ``workers`` at a time.  A
    failed item has an error and no answers.  After ``breaker`` items in a row
    with one error, or one with refused credentials, a task stops asking: the rest of its items get the error
    ``not asked: ...``.  An explicit ``parallelism`` fixes the number of tasks,
    which adaptive execution then leaves alone.  ``only`` names a column with the keys to ask of an item, if not all.
    """
    retry = retry or Retry()
    for q in questions.values():
        encode(q)
    names = items.columns
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema), f"answers map<string,{ANSWER}>", "model string", "error string"])

    def one(asked):
        text, keys = asked
        wanted = questions if keys is None else {k: questions[k] for k in keys}
        try:
            return {k: to_row(a) for k, a in with_retry(lambda: scorer.ask(text, wanted), retry).items()}, None
        except Exception as e:
            return None, ("refused: " if fatal(e) else "") + f"{type(e).__name__}: {e}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        streak, last = 0, None
        with ThreadPoolExecutor(workers) as pool:
            for batch in batches:
                answers, errors = [], []
                texts = list(zip(batch[state].tolist(), batch[only].tolist() if only else [None] * len(batch), strict=True))
                for at in range(0, len(texts), workers):
                    part = texts[at : at + workers]
                    got = [(None, f"not asked: {last}")] * len(part) if streak >= breaker else list(pool.map(one, part))
                    for a, e in got:
                        if streak < breaker:
                            streak = breaker if (e or "").startswith("refused: ") else streak + 1 if e is not None and e == last else int(e is not None)
                            last = e
                        answers.append(a)
                        errors.append(e)
                yield batch[names].assign(answers=answers, model=scorer.version or scorer.model, error=errors)

    if parallelism:
        items = items.repartition(parallelism)
    return items.mapInPandas(run, schema)
