"""Gate rules: answers to allow, review or escalate.

A rule becomes one struct column: outcome (1 allow, 2 review, 3 escalate),
rule, weakest input, value, missing, readings.  An invalid rule always escalates.
"""

from __future__ import annotations

import json
import math
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dist
from ..scorers import once

OUTCOMES = {"allow": 1, "review": 2, "escalate": 3}
CERTAINTY = ("confidence", "top", "margin", "entropy", "applicability")
MEASURES = (*CERTAINTY, "noul", "prob")
SAFE, RISKY = "high_is_safe", "high_is_risky"
READING = "struct<rule:string,input:string,value:double,problem:string>"


class RuleError(ValueError):
    """A rule that can't be evaluated."""


def outcome_name(code: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, OUTCOMES)), code)


def worse(a: Column, b: Column) -> Column:
    """The more severe of two outcomes; what is none counts as escalate."""
    fix = lambda c: F.when(c.isin(1, 2, 3), c).otherwise(3)
    return F.greatest(fix(a), fix(b))


def gate_input(answer: Column, abstain: str | None = None, failed: Column | None = None) -> Column:
    """kind, noul, choice, confidence, probs of an ANSWER column as rules read it."""
    kind = F.when(answer.isNull(), "missing").when(answer["decode_error"].isNotNull(), "failed")
    if failed is not None:
        kind = F.when(failed, "failed").when(answer.isNull(), "missing")
    if abstain is not None:
        kind = kind.when(answer["choice"] == abstain, "abstained")
    kind = kind.when(answer["type"].isin("noul", "choice", "score"), answer["type"]).otherwise("failed")
    return F.struct(kind.alias("kind"), answer["noul"].alias("noul"), answer["choice"].alias("choice"), answer["confidence"].alias("confidence"), answer["probs"].alias("probs"))


def band(v: Column, allow: float, review: float, polarity: str = SAFE) -> Column:
    """A value on a bound gets the milder outcome."""
    if polarity == RISKY:
        return F.when(v <= allow, 1).when(v <= review, 2).otherwise(3)
    return F.when(v >= allow, 1).when(v >= review, 2).otherwise(3)


def _bounds(**values: float) -> None:
    for k, v in values.items():
        if not isinstance(v, (int, float)) or math.isnan(v) or not 0 <= v <= 1:
            raise RuleError(f"{k} is {v}, not in [0, 1]")


def _outcomes(**values: str | None) -> None:
    for k, v in values.items():
        if v is not None and v not in OUTCOMES:
            raise RuleError(f"{k} is {v}")


def _inputs(names) -> None:
    if not names or "" in names or len(set(names)) < len(names):
        raise RuleError("inputs must be named, once each")


def _measure(m: str, option: str, certainty: bool = False) -> None:
    if m not in MEASURES or certainty and m not in CERTAINTY:
        raise RuleError(f"measure {m!r} can't be used")
    if (m == "prob") != bool(option):
        raise RuleError("an option belongs to measure prob")


def _polarity(p: str, allow: float, review: float) -> None:
    if p == SAFE and allow < review or p == RISKY and allow > review or p not in (SAFE, RISKY):
        raise RuleError(f"bounds {allow} and {review} don't fit polarity {p!r}")


class _Inputs(dict):
    """Inputs by name; ``known`` holds readings that are columns already, ``asked`` collects those that are read."""

    def __init__(self, inputs: dict, known: dict | None = None):
        super().__init__(inputs)
        self.known, self.asked = known or {}, []


def _read(inputs: dict[str, Column], name: str, m: str, option: str = "") -> Column:
    if isinstance(inputs, _Inputs):
        if (name, m, option) in inputs.known:
            return inputs.known[name, m, option]
        inputs.asked.append((name, m, option))
    x = inputs.get(name)
    if x is None:
        return F.struct(F.lit(None).cast("double").alias("value"), F.lit("missing").alias("problem"))
    return dist.measure(x["kind"], m, x["probs"], x["noul"], x["confidence"], option or None)


def _reading(path: str, name: str, r: Column) -> Column:
    return F.struct(F.lit(path).alias("rule"), F.lit(name).alias("input"), r["value"].alias("value"), r["problem"].alias("problem"))


def _decision(outcome: Column, path, weakest, value: Column, missing: Column, readings: list[Column] | Column) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    r = readings if isinstance(readings, Column) else F.array(*readings)
    return F.struct(outcome.cast("int").alias("outcome"), lit(path).alias("rule"), lit(weakest).alias("weakest"), value.cast("double").alias("value"), missing.alias("missing"), r.alias("readings"))


def _code(name: str | None) -> int:
    return OUTCOMES.get(name or "escalate", 3)


@dataclass(frozen=True)
class Rule:
    """Common behaviour; subclasses define check() and column(inputs, path)."""

    def label(self) -> str:
        return getattr(self, "name", "") or self.kind

    def evaluate(self, inputs: dict[str, Column]) -> Column:
        """The decision over named inputs (see gate_input); constant escalate if the rule is invalid."""
        try:
            self.check()
        except RuleError:
            return _decision(F.lit(3), self.label(), "", F.lit(None), F.lit(False), F.array().cast(f"array<{READING}>"))
        return self.column(inputs, self.label())

    def to_json(self) -> str:
        return json.dumps(_plain(self), separators=(",", ":"), sort_keys=True)


def _plain(r) -> dict:
    if isinstance(r, Compose):
        return {"type": r.kind, "name": r.name, "rules": [_plain(x) for x in r.rules]}
    return {"type": r.kind} | {k: v for k, v in asdict(r).items() if v not in (None, "", {}, ())}


@dataclass(frozen=True)
class Bands(Rule):
    """One measure of one input through two bounds."""

    input: str
    measure: str
    allow: float
    review: float
    polarity: str = SAFE
    option: str = ""
    on_missing: str | None = None
    name: str = ""
    kind = "bands"

    def check(self):
        _inputs([self.input])
        _measure(self.measure, self.option)
        _bounds(allow=self.allow, review=self.review)
        _outcomes(on_missing=self.on_missing)
        _polarity(self.polarity, self.allow, self.review)

    def column(self, inputs, path):
        r = _read(inputs, self.input, self.measure, self.option)
        bad = r["problem"].isNotNull()
        o = F.when(bad, _code(self.on_missing)).otherwise(band(r["value"], self.allow, self.review, self.polarity))
        return _decision(o, path, self.input, r["value"], bad, [_reading(path, self.input, r)])


def _multi(inputs, path, names, m, option, polarity, on_missing, outcome) -> Column:
    reads = [_read(inputs, n, m, option) for n in names]
    sign = -1 if polarity == RISKY else 1
    # weakest reading first, the earliest on ties
    parts = F.array(*(F.struct((sign * r["value"]).alias("v"), F.lit(i).alias("i"), F.lit(n).alias("name"), r["problem"].isNotNull().alias("bad")) for i, (n, r) in enumerate(zip(names, reads, strict=True))))
    good, bad = F.filter(parts, lambda e: ~e["bad"]), F.filter(parts, lambda e: e["bad"])
    low = F.array_min(F.transform(good, lambda e: F.struct(e["v"].alias("v"), e["i"].alias("i"), e["name"].alias("name"))))
    value = sign * low["v"]
    own = F.when(F.size(good) > 0, outcome(value))
    first_bad = F.array_min(F.transform(bad, lambda e: F.struct(e["i"].alias("i"), e["name"].alias("name"))))
    miss = _code(on_missing)
    # a missing input decides if it is at least as severe as the weakest reading
    use_bad = (F.size(bad) > 0) & (own.isNull() | (F.lit(miss) >= own))
    readings = [_reading(path, n, r) for n, r in zip(names, reads, strict=True)]
    return _decision(F.when(use_bad, miss).otherwise(own), path, F.when(use_bad, first_bad["name"]).otherwise(low["name"]), F.when(use_bad, F.lit(None)).otherwise(value), use_bad, readings)


@dataclass(frozen=True)
class AllOf(Rule):
    """The weakest of several inputs through two bounds."""

    inputs: tuple
    measure: str
    allow: float
    review: float
    polarity: str = SAFE
    option: str = ""
    on_missing: str | None = None
    name: str = ""
    kind = "all_of"

    def check(self):
        _inputs(self.inputs)
        _measure(self.measure, self.option)
        _bounds(allow=self.allow, review=self.review)
        _outcomes(on_missing=self.on_missing)
        _polarity(self.polarity, self.allow, self.review)

    def column(self, inputs, path):
        return _multi(inputs, path, self.inputs, self.measure, self.option, self.polarity, self.on_missing, lambda v: band(v, self.allow, self.review, self.polarity))


@dataclass(frozen=True)
class MinConfidence(Rule):
    """All inputs at or above a floor of certainty, or else ``below``."""

    inputs: tuple
    floor: float
    measure: str = "confidence"
    below: str | None = None
    on_missing: str | None = None
    name: str = ""
    kind = "min_confidence"

    def check(self):
        _inputs(self.inputs)
        _measure(self.measure, "", certainty=True)
        _bounds(floor=self.floor)
        _outcomes(below=self.below, on_missing=self.on_missing)

    def column(self, inputs, path):
        return _multi(inputs, path, self.inputs, self.measure, "", SAFE, self.on_missing, lambda v: F.when(v >= self.floor, 1).otherwise(_code(self.below)))


@dataclass(frozen=True)
class Margin(Rule):
    """The top probability and its lead must both suffice."""

    input: str
    top: float
    lead: float
    below: str | None = None
    on_missing: str | None = None
    name: str = ""
    kind = "margin"

    def check(self):
        _inputs([self.input])
        _bounds(top=self.top, lead=self.lead)
        _outcomes(below=self.below, on_missing=self.on_missing)

    def column(self, inputs, path):
        t, m = _read(inputs, self.input, "top"), _read(inputs, self.input, "margin")
        bad = t["problem"].isNotNull() | m["problem"].isNotNull()
        low = t["value"] < self.top
        o = F.when(bad, _code(self.on_missing)).when(low | (m["value"] < self.lead), _code(self.below)).otherwise(1)
        return _decision(o, path, self.input, F.when(~bad, F.when(low, t["value"]).otherwise(m["value"])), bad, [_reading(path, self.input, t), _reading(path, self.input, m)])


@dataclass(frozen=True)
class OptionBand:
    """Bounds of one option, or an outcome that always holds."""

    allow: float = 0.0
    review: float = 0.0
    always: str | None = None


@dataclass(frozen=True)
class Asymmetric(Rule):
    """Bounds that depend on the chosen option."""

    input: str
    measure: str
    options: dict = field(default_factory=dict)
    others: OptionBand | None = None
    floor: float = 0.0
    below_floor: str | None = None
    on_missing: str | None = None
    name: str = ""
    kind = "asymmetric"

    def check(self):
        _inputs([self.input])
        _measure(self.measure, "", certainty=True)
        _bounds(floor=self.floor)
        _outcomes(below_floor=self.below_floor, on_missing=self.on_missing)
        for b in [*self.options.values(), *([self.others] if self.others else [])]:
            _outcomes(always=b.always)
            if b.always is None:
                _bounds(allow=b.allow, review=b.review)
                _polarity(SAFE, b.allow, b.review)

    def column(self, inputs, path):
        x = inputs.get(self.input)
        r = _read(inputs, self.input, self.measure)
        problem = r["problem"] if x is None else F.when(r["problem"].isNull() & (x["kind"] != "choice"), "undefined").otherwise(r["problem"])
        v, bad = r["value"], problem.isNotNull()
        of = lambda b: F.lit(_code(b.always)) if b.always else band(v, b.allow, b.review)
        o = of(self.others) if self.others else F.lit(3)
        if x is not None:
            for k, b in self.options.items():
                o = F.when(x["choice"] == k, of(b)).otherwise(o)
        if self.floor > 0:
            o = F.when(v < self.floor, _code(self.below_floor)).otherwise(o)
        fixed = F.struct(F.when(~bad, v).alias("value"), problem.alias("problem"))
        return _decision(F.when(bad, _code(self.on_missing)).otherwise(o), path, self.input, fixed["value"], bad, [_reading(path, self.input, fixed)])


@dataclass(frozen=True)
class Compose(Rule):
    """The most severe of several rules, the earliest on ties; all readings are kept."""

    rules: tuple
    name: str = ""
    kind = "compose"

    def check(self):
        if not self.rules:
            raise RuleError("no rules")
        for r in self.rules:
            if isinstance(r, Rule):
                r.check()

    def column(self, inputs, path):
        parts = []
        for i, r in enumerate(self.rules):
            if isinstance(r, Rule):
                parts.append(r.column(inputs, f"{path}/{getattr(r, 'name', '') or f'{r.kind}[{i}]'}"))
            else:  # a rule of the user's: evaluate(inputs) gives a decision column
                d = r.evaluate(inputs)
                parts.append(_decision(worse(d["outcome"], F.lit(1)), F.concat(F.lit(f"{path}/custom[{i}]/"), d["rule"]), d["weakest"], d["value"], d["missing"], d["readings"]))
        best = F.array_max(F.array(*(F.struct(d["outcome"].alias("outcome"), F.lit(-i).alias("i")) for i, d in enumerate(parts))))
        chosen = parts[-1]
        for i in range(len(parts) - 2, -1, -1):
            chosen = F.when(best["i"] == -i, parts[i]).otherwise(chosen)
        return _decision(chosen["outcome"], chosen["rule"], chosen["weakest"], chosen["value"], chosen["missing"], F.concat(*(d["readings"] for d in parts)))


def apply_rule(df: DataFrame, rule: Rule, inputs: dict[str, Column], name: str = "decision") -> DataFrame:
    """``df`` with the decision of a rule.

    The same as ``rule.evaluate`` in one column, but inputs and readings become
    columns first, so that a rule that reads an input in several places measures it once.
    """
    names = {n: f"_input{i}" for i, n in enumerate(inputs)}
    out = once(df, {names[n]: c for n, c in inputs.items()})
    first = _Inputs({n: F.col(c) for n, c in names.items()})
    rule.evaluate(first)
    keys = list(dict.fromkeys(first.asked))
    out = once(out, {f"_reading{i}": _read(dict(first), *k) for i, k in enumerate(keys)})
    known = {k: F.col(f"_reading{i}") for i, k in enumerate(keys)}
    out = once(out, {name: rule.evaluate(_Inputs(first, known))})
    return out.select(*df.columns, name)


_KINDS = {c.kind: c for c in (Bands, AllOf, MinConfidence, Margin, Asymmetric, Compose)}


def rule_from_json(text: str) -> Rule:
    """A rule from JSON; unknown types or members are errors."""

    def of(m: dict) -> Rule:
        m = dict(m)
        kind = _KINDS.get(m.pop("type", None))
        if kind is None:
            raise RuleError("unknown rule type")
        if kind is Compose:
            m["rules"] = tuple(map(of, m.get("rules", ())))
        if kind is Asymmetric:
            m["options"] = {k: OptionBand(**v) for k, v in m.get("options", {}).items()}
            m["others"] = OptionBand(**m["others"]) if m.get("others") else None
        if "inputs" in m:
            m["inputs"] = tuple(m["inputs"])
        try:
            r = kind(**m)
        except TypeError as e:
            raise RuleError(str(e)) from None
        r.check()
        return r

    def once(pairs):
        if len({k for k, _ in pairs}) < len(pairs):
            raise RuleError("a key is repeated")
        return dict(pairs)

    return of(json.loads(text, object_pairs_hook=once))
