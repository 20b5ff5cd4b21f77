"""Functions of text, JSON text and content keys."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def trim(c: Column) -> Column:
    """Without white space, of any kind, at the ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def clean(c: Column) -> Column:
    """Runs of control characters and white space become one space; none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)[\p{Cntrl}\p{Z}\s]+", " "))


def truncate(c: Column, n: int) -> Column:
    """At most n characters, the last an ellipsis if some are left out."""
    return F.when(F.length(c) > n, F.concat(F.left(c, F.lit(n - 1)), F.lit("…"))).otherwise(c)


def percent(p: Column) -> Column:
    """Whole percent, halves to even."""
    return F.concat(F.bround(p * 100, 0).cast("int").cast("string"), F.lit("%"))


def bar(p: Column, width: int = 20) -> Column:
    n = F.least(F.lit(width), F.greatest(F.lit(0), F.round(p * width).cast("int")))
    return F.concat(F.repeat(F.lit("█"), n), F.repeat(F.lit("░"), F.lit(width) - n))


def plural(n: Column, one: str, many: str) -> Column:
    return F.concat_ws(" ", n.cast("string"), F.when(n == 1, one).otherwise(many))


def slug(title: Column) -> Column:
    """Lower case, letters, digits, hyphens and underscores; spaces become hyphens."""
    return F.replace(F.regexp_replace(F.lower(title), r"(?U)[^\p{L}\p{N}\p{M} _-]", ""), F.lit(" "), F.lit("-"))


def json_size(c: Column) -> Column:
    """Bytes of a string once encoded in JSON with HTML-safe escapes, quotes not counted."""
    count = lambda pattern: F.regexp_count(c, F.lit(pattern))
    return F.octet_length(c) + count(r'["\\\n\r\t]') + 5 * count(r"[\x00-\x08\x0b\x0c\x0e-\x1f<>&]")


def md_escape(c: Column) -> Column:
    """Markdown's own characters escaped, line breaks as spaces."""
    return F.regexp_replace(F.regexp_replace(c, r"[\r\n]+", " "), r"([\\`*_{}\[\]<>()#+!|~-])", r"\\$1")


def workflow_escape(c: Column, is_property: bool = False) -> Column:
    """Text for workflow commands: percent signs and line ends encoded, in properties also : and ,."""
    out = F.replace(F.replace(F.replace(c, F.lit("%"), F.lit("%25")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.replace(F.replace(out, F.lit(":"), F.lit("%3A")), F.lit(","), F.lit("%2C")) if is_property else out


def csv_safe(c: Column) -> Column:
    """Cells that a spreadsheet would run as a formula get a leading quote."""
    return F.when(F.substring(c, 1, 1).isin("=", "+", "-", "@", "\t", "\r"), F.concat(F.lit("'"), c)).otherwise(c)


def redact(c: Column, secret: str) -> Column:
    return F.replace(c, F.lit(secret), F.lit("[redacted]")) if secret else c


def printable(c: Column, limit: int = 80) -> Column:
    """One line without zero-width and direction marks."""
    return truncate(clean(F.regexp_replace(c, r"[​-‏‪-‮⁠-⁩﻿]", "")), limit)


def location(source: Column) -> Column:
    """(file, line) of labels such as file:12, file#L12, file:12@commit or file[3]."""
    plain = F.regexp_replace(source, r"@[0-9a-f]{7,40}$", "")
    line = F.regexp_extract(plain, r"(?::|#L)(\d+)(?:-L?\d+)?$", 1)
    return F.struct(F.regexp_replace(plain, r"(?:(?::|#L)\d+(?:-L?\d+)?|\[\d+\])$", "").alias("file"), F.when(line != "", line.cast("int")).alias("line"))


def line_count(lines: Column) -> Column:
    """Lines of a range such as 3-9 or 4; 1 if it can't be read."""
    a = F.regexp_extract(lines, r"^(\d+)(?:-\d+)?$", 1)
    b = F.coalesce(F.nullif(F.regexp_extract(lines, r"^\d+-(\d+)$", 1), F.lit("")), a)
    n = b.try_cast("long") - a.try_cast("long") + 1
    return F.when(n >= 1, n).otherwise(1)


def framed(*fields: Column) -> Column:
    """Bytes of all fields, each behind its length as eight bytes, so that no two lists look alike."""
    parts = []
    for f in fields:
        data = f.cast("binary")
        parts += [F.unhex(F.lpad(F.hex(F.octet_length(data)), 16, "0")), data]
    return F.concat(*parts)


def content_key(*fields: Column) -> Column:
    """The first 16 bytes, in hex, of the SHA-256 of the framed fields."""
    return F.substring(F.sha2(framed(*fields), 256), 1, 32)


def spark_path(path: str) -> str:
    """A dotted path (a.b.0) or JSON Pointer (/a/b/0) as a path of get_json_object."""
    steps = [s.replace("~1", "/").replace("~0", "~") for s in path[1:].split("/")] if path.startswith("/") else path.split(".")
    return "$" + "".join(f"[{s}]" if s.isdigit() else f"['{s}']" if not s.isidentifier() else f".{s}" for s in steps if s != "")


def lookup(value: Column, path: str) -> Column:
    """JSON text at a path of JSON text; null for what is null or not there."""
    return F.get_json_object(value, spark_path(path))


def _lookup_strict(value: str | None, path: str):
    """As ``lookup``, but a member that is not there is an error that names those that are; JSON null is the text null."""
    try:
        at = json.loads(value)
    except (TypeError, ValueError):
        return None, "not JSON"
    steps = [s.replace("~1", "/").replace("~0", "~") for s in path[1:].split("/")] if path.startswith("/") else path.split(".")
    for s in steps:
        if isinstance(at, dict) and s in at:
            at = at[s]
        elif isinstance(at, list) and s.isdigit() and int(s) < len(at):
            at = at[int(s)]
        else:
            there = ", ".join(at) if isinstance(at, dict) else f"{len(at)} elements" if isinstance(at, list) else "no members"
            return None, f"no {s!r}; available: {there}"
    return json.dumps(at, ensure_ascii=False, separators=(",", ":")), None


def _compact_json(value: str | None):
    """JSON text without white space between tokens; order and numbers as they were."""
    if value is None:
        return None
    out, quoted, escaped = [], False, False
    for ch in value:
        if quoted:
            out.append(ch)
            quoted = escaped or ch != '"'
            escaped = ch == "\\" and not escaped
        elif ch not in " \t\r\n":
            out.append(ch)
            quoted = ch == '"'
    return "".join(out)


def lookup_strict(value: Column, path: str) -> Column:
    """(value, error) of a path: an absent member is an error that names those there; JSON null is the text null."""
    @F.pandas_udf("value string, error string")
    def of(values: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_lookup_strict(v, path) for v in values], columns=["value", "error"])

    return of(value)


def compact_json(value: Column) -> Column:
    """JSON text without white space between tokens; order and numbers as they were."""
    @F.pandas_udf("string")
    def of(values: pd.Series) -> pd.Series:
        return values.map(_compact_json)

    return of(value)


def wrap(text: str, width: int) -> list[str]:
    """Lines of at most ``width`` characters, broken at spaces; a longer word stands alone, and line ends stay."""
    out = []
    for line in text.split("\n"):
        at = ""
        for word in line.split():
            if at and len(at) + 1 + len(word) > width:
                out.append(at)
                at = word
            else:
                at = f"{at} {word}" if at else word
        out.append(at)
    return out


def ago(seconds: float) -> str:
    """How long since something started: just now, 5 minutes ago, 1 hour ago, 3 days ago."""
    for unit, size in (("day", 86400), ("hour", 3600), ("minute", 60)):
        n = int(seconds // size)
        if n:
            return f"{n} {unit}{'s' if n > 1 else ''} ago"
    return "just now"
