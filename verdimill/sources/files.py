"""Listing and reading of files as items.

Paths are listed on the driver, by name and with ignore rules; contents are
read by Spark.  An item's index follows the order of paths, files and places within them.
"""

from __future__ import annotations

import csv
import io
import json
import os
import re
from dataclasses import dataclass
from dataclasses import field as dataclass_field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import store
from ..schemas import ITEM
from . import code, diff, markdown, media, split
from .batches import flat_map

MAX_TEXT, MAX_JSON = 1 << 20, 64 << 20
# Formats by extension.
FORMATS = {".jsonl": "jsonl", ".ndjson": "jsonl", ".json": "json", ".csv": "csv", ".txt": "lines", ".text": "lines", ".log": "lines", ".md": "markdown", ".markdown": "markdown", ".mdx": "markdown", ".diff": "diff", ".patch": "diff"}
UNITS = ("file", "line", "paragraph", "section", "function", "hunk")


class SourceError(ValueError):
    """Input that can't be read."""


@dataclass(frozen=True)
class Options:
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    each: str | None = None
    field: str = ""
    items: str = ""
    limit: int = 0
    sample: int = 0
    budget: int = split.DEFAULT_BUDGET
    limits: media.Limits = dataclass_field(default_factory=media.Limits)


def format_of(path: str) -> str:
    ext = os.path.splitext(path)[1].lower()
    return FORMATS.get(ext) or ("media" if ext in media.TYPES else "document")


def sniff(text: str) -> str:
    """The format of text without a name: diff, jsonl, json or lines."""
    if diff.is_diff(text):
        return "diff"
    first = text.lstrip().split("\n", 1)[0].strip()
    if first[:1] in ("{", "["):
        try:
            json.loads(first)
            return "jsonl" if len(text.strip().split("\n")) > 1 or first[:1] == "{" else "json"
        except ValueError:
            try:
                json.loads(text)
                return "json"
            except ValueError:
                return "lines"
    return "lines"


def glob_regex(pattern: str) -> re.Pattern:
    """``**`` crosses folders, ``*`` and ``?`` do not, {a,b} chooses."""
    out, i, depth = "", 0, 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
            continue
        if pattern.startswith("**", i):
            out, i = out + ".*", i + 2
            continue
        if c == "[" and "]" in pattern[i + 2 :]:
            end = pattern.index("]", i + 2)
            body = pattern[i + 1 : end]
            out, i = out + "[" + ("^" + body[1:] if body[0] in "!^" else body) + "]", end + 1
            continue
        depth += {"{": 1, "}": -1}.get(c, 0)
        out += {"*": "[^/]*", "?": "[^/]", "{": "(?:", "}": ")"}.get(c) or ("|" if c == "," and depth else re.escape(c))
        i += 1
    return re.compile(out + r"\Z", re.S)


def matches(globs: tuple[str, ...], rel: str) -> bool:
    """A pattern without a slash also matches the last name at any depth."""
    return any(glob_regex(g).match(rel) or "/" not in g and glob_regex(g).match(os.path.basename(rel)) for g in globs)


@dataclass(frozen=True)
class Ignore:
    """One line of an ignore file."""

    base: str
    pattern: re.Pattern
    negated: bool
    folders_only: bool

    @classmethod
    def parse(cls, base: str, line: str) -> Ignore | None:
        line = re.sub(r"(?<!\\)\s+$", "", line.rstrip("\n"))
        if not line or line.startswith("#"):
            return None
        negated, line = line.startswith("!"), line.removeprefix("!")
        folder, line = line.endswith("/"), line.rstrip("/")
        line = line.removeprefix("\\")
        anchored = "/" in line
        return cls(base, glob_regex(line.lstrip("/") if anchored else f"**/{line}"), negated, folder)


def ignored(rules: list[Ignore], path: str, is_dir: bool) -> bool:
    """The last rule that matches decides."""
    out = False
    for r in rules:
        if is_dir or not r.folders_only:
            rel = os.path.relpath(path, r.base).replace(os.sep, "/")
            if not rel.startswith("..") and r.pattern.match(rel):
                out = not r.negated
    return out


def _rules(folder: str) -> list[Ignore]:
    out = []
    for name in (".gitignore", ".itemignore"):
        path = os.path.join(folder, name)
        if os.path.isfile(path):
            with open(path, encoding="utf-8", errors="replace") as f:
                out += [r for line in f if (r := Ignore.parse(folder, line))]
    return out


def list_files(root: str, options: Options | None = None) -> list[str]:
    """Regular files below a folder by name; hidden ones, links and ignored ones left out."""
    options = options or Options()
    above, folder = [], os.path.abspath(root)
    while not os.path.exists(os.path.join(folder, ".git")) and os.path.dirname(folder) != folder:
        folder = os.path.dirname(folder)
    if os.path.exists(os.path.join(folder, ".git")):
        at = os.path.dirname(os.path.abspath(root))
        while len(at) >= len(folder) and os.path.abspath(root) != folder:
            above = _rules(at) + above
            at = os.path.dirname(at)

    def walk(path: str, rules: list[Ignore]):
        rules = rules + _rules(path)
        for e in sorted(os.scandir(path), key=lambda e: e.name):
            if e.name.startswith(".") or e.is_symlink() or ignored(rules, os.path.abspath(e.path), e.is_dir()):
                continue
            rel = os.path.relpath(e.path, root).replace(os.sep, "/")
            if options.exclude and matches(options.exclude, rel):
                continue
            if e.is_dir():
                yield from walk(e.path, rules)
            elif e.is_file() and (not options.include or matches(options.include, rel)):
                yield e.path

    root = os.path.abspath(root)
    return list(walk(root, above))


def labels(paths: list[str], cwd: str | None = None) -> dict[str, str]:
    """Relative names below the working folder; else the shortest endings that tell the paths apart."""
    cwd = os.path.abspath(cwd or os.getcwd())
    out, rest = {}, []
    for p in paths:
        a = os.path.abspath(p)
        if a.startswith(cwd + os.sep):
            out[p] = os.path.relpath(a, cwd)
        else:
            rest.append(p)
    n, todo = 1, rest
    while todo:
        names: dict[str, list[str]] = {}
        for p in todo:
            names.setdefault("/".join(os.path.abspath(p).split(os.sep)[-n:]), []).append(p)
        todo = []
        for name, same in names.items():
            if len({os.path.abspath(p) for p in same}) == 1 or n > 50:
                out.update(dict.fromkeys(same, name))
            else:
                todo += same
        n += 1
    return out


# Items of one text; all below run on executors, one file for each call.


def _dump(x) -> str:
    return json.dumps(x, ensure_ascii=False, separators=(",", ":"))


def lookup(value, path: str):
    """A member by dotted path or JSON Pointer; the error names what is there."""
    steps = [s.replace("~1", "/").replace("~0", "~") for s in path[1:].split("/")] if path.startswith("/") else path.split(".")
    for s in steps:
        if isinstance(value, dict) and s in value:
            value = value[s]
        elif isinstance(value, list) and s.isdigit() and int(s) < len(value):
            value = value[int(s)]
        else:
            there = ", ".join(value) if isinstance(value, dict) else "none"
            raise SourceError(f"no field {s!r}; available: {there}")
    return value


def elements(text: str) -> list[str]:
    """The elements of a JSON array as they are written; any other value is one element."""
    text = text.strip()
    decoder, out = json.JSONDecoder(), []
    if not text.startswith("["):
        decoder.decode(text)
        return [text]
    at = 1
    space = re.compile(r"[ \t\r\n]*")
    while True:
        at = space.match(text, at).end()
        if text[at] == "]":
            return out
        if out:
            if text[at] != ",":
                raise SourceError("not JSON")
            at = space.match(text, at + 1).end()
        _, end = decoder.raw_decode(text, at)
        out.append(text[at:end])
        at = end


def _record(label: str, unit: str, raw: str, o: Options):
    state = _dump(lookup(json.loads(raw), o.field)) if o.field else raw
    parts = []
    if split.json_size(state) > o.budget:
        value = json.loads(state)
        body = value if isinstance(value, str) else json.dumps(value, ensure_ascii=False, indent=1)
        parts = [(f"{a}-{b}", split.json_size(t), _dump(t)) for a, b, t in split.split(body.split("\n"), o.budget - split.RESERVED)]
    return (label, unit, raw, state, parts, None, False, False)


def _document(label: str, text: str, o: Options, md: bool):
    lines = text.replace("\r\n", "\n").split("\n")
    language = code.language_of(label) or ("markdown" if md else "")
    head = {"path": label} | ({"language": language} if language else {})
    state = _dump(head | {"content": text})
    parts = []
    if split.json_size(text) > o.budget - split.RESERVED:
        breaks = split.markdown_breaks if md else code.code_breaks(label) if code.language_of(label) else split.blank_breaks
        parts = [(f"{a}-{b}", split.json_size(t), _dump(head | {"lines": f"{a}-{b}", "content": t})) for a, b, t in split.split(lines, o.budget - split.RESERVED, breaks, split.blank_breaks)]
    return (label, "file", _dump(label), state, parts, None, False, bool(code.language_of(label)))


def _pieces(label: str, text: str, o: Options, md: bool):
    lines = text.replace("\r\n", "\n").split("\n")
    if o.each == "section":
        found = markdown.sections(lines)
    else:
        found = markdown.paragraphs(lines) if md else markdown.plain_paragraphs(lines)
    for p in found:
        place = f"{label}#{p.anchor}" if p.anchor else f"{label}:{p.start}"
        state = {"path": label, "lines": f"{p.start}-{p.end}"} | ({"section": " > ".join(p.path)} if p.path else {}) | {"content": p.text}
        yield (place, o.each, _dump(p.text), _dump(state), [], None, False, False)


def _functions(label: str, text: str, o: Options):
    found = code.functions(label, text)
    if found is None:
        return [_document(label, text, o, False)]
    lines = text.replace("\r\n", "\n").split("\n")
    head = code.context(label, text)
    return [
        (f"{label}:{f.start}", "function", _dump(f.name), _dump({"path": label, "function": f.name, "context": head, "lines": f"{f.lead}-{f.end}", "content": markdown.span(lines, f.lead, f.end)}), [], None, False, True)
        for f in found
    ]


def _diff(label: str, text: str, o: Options):
    files, _ = diff.parse(text)
    several = len({f.commit for f in files}) > 1
    for f in files:
        wanted = bool(o.include) and matches(o.include, f.path)
        reason = f.skip_reason()
        if reason and not (wanted and reason in ("lockfile", "generated")) or o.include and not wanted or matches(o.exclude, f.path):
            continue
        name = f"{f.path}@{f.commit[:12]}" if several and f.commit else f.path
        if o.each == "line":
            for h in f.hunks:
                for mark, _, new, line in h.numbered():
                    if mark == "+" and line.strip():
                        yield (f"{name}:{new}", "line", _dump(line), _dump({"path": f.path, "line": new, "content": line}), [], None, True, False)
            continue
        if o.each == "file":
            body = "\n".join("\n".join([h.header, *h.lines]) for h in f.hunks)
            yield (name, "file", _dump(f.path), _dump({"path": f.path, "change": f.change, "diff": body}), [], None, True, False)
            continue
        for h in f.hunks:
            yield (f"{name}:{h.first_change()}", "hunk", _dump(h.context), _dump({"path": f.path, "change": f.change, "diff": "\n".join([h.header, *h.lines])}), [], None, True, False)


def items_of(label: str, text: str, kind: str, o: Options) -> list[tuple]:
    """Rows of ITEM, without the index, of one text."""
    text = text.removeprefix("\ufeff")
    md = kind == "markdown"
    if kind == "diff":
        return list(_diff(label, text, o))
    if kind == "json":
        value = text
        if o.items:
            value = _dump(lookup(json.loads(text), o.items))
        found = elements(value)
        many = value.strip().startswith("[")
        return [_record(f"{label}[{i}]" if many else label, "record", raw, o) for i, raw in enumerate(found)]
    if kind == "csv":
        rows = csv.reader(io.StringIO(text), strict=True)
        names = next(rows, [])
        out = []
        for row in rows:
            if not row:
                continue
            if len(row) != len(names):
                raise SourceError(f"{label}:{rows.line_num}: {len(row)} fields, {len(names)} named")
            out.append(_record(f"{label}:{rows.line_num}", "record", _dump(dict(zip(names, row, strict=True))), o))
        return out
    if kind in ("jsonl", "lines") and o.each in (None, "line", "record") or o.each == "line":
        out = []
        for n, line in enumerate(text.replace("\r\n", "\n").split("\n"), 1):
            if not line.strip():
                continue
            if kind == "jsonl":
                try:
                    json.loads(line)
                except ValueError:
                    raise SourceError(f"{label}:{n}: not JSON") from None
                out.append(_record(f"{label}:{n}", "record", line.strip(), o))
            else:
                out.append(_record(f"{label}:{n}", "line", _dump(line), Options(budget=o.budget)))
        return out
    if o.each == "function" and code.language_of(label):
        return _functions(label, text, o)
    if o.each in ("paragraph", "section"):
        return list(_pieces(label, text, o, md))
    return [_document(label, text, o, md)]


_ROW = "label string, unit string, value string, state string, parts array<struct<lines:string,size:int,state:string>>, media struct<content_type:string,path:string>, is_diff boolean, is_code boolean"
SKIPPED = "label string, reason string"


def listing(spark: SparkSession, paths: list[str], o: Options) -> tuple[DataFrame, DataFrame, list[str]]:
    """Files to read (ordinal, label, kind, path), files passed over (SKIPPED) and the texts' paths.

    A file that was named itself and can't be read is an error.
    """
    found: list[tuple[str, bool]] = []
    for p in paths:
        found += [(f, False) for f in list_files(p, o)] if os.path.isdir(p) else [(p, True)]
    names = labels([p for p, _ in found])
    rows, skipped = [], []
    for i, (p, named) in enumerate(found):
        kind = format_of(p)
        size = os.path.getsize(p)
        with open(p, "rb") as f:
            head = f.read(media.PEEK)
        if kind == "media":
            why = media.reason(p, head, size, o.limits)
        elif size > (MAX_JSON if kind in ("json", "jsonl", "csv") else MAX_TEXT):
            why = "too large"
        else:
            why = "binary file" if media.is_binary(head) else ""
        if not why:
            rows.append((i, names[p], kind, os.path.abspath(p)))
        elif named:
            raise SourceError(f"{p}: {why}")
        else:
            skipped.append((names[p], why))
    return spark.createDataFrame(rows, "ordinal long, label string, kind string, path string"), spark.createDataFrame(skipped, SKIPPED), [r[3] for r in rows if r[2] != "media"]


def make_items(files: DataFrame, o: Options) -> DataFrame:
    """ordinal, pos and the columns of an item for files (ordinal, label, kind, text, path)."""

    def of(label: str, kind: str, text: str, path: str):
        if kind == "media":
            t = media.TYPES[os.path.splitext(path)[1].lower()]
            return [(0, label, media.kind(t), _dump(label), _dump({"path": label}), [], (t, path), False, False)]
        return ((pos, *item) for pos, item in enumerate(items_of(label, text, kind, o)))

    return flat_map(files, ["ordinal"], ["label", "kind", "text", "path"], of, f"pos long, {_ROW}")


def line_rows(spark: SparkSession, paths: list[str]) -> DataFrame:
    """path, line (from 1), text of every line of files that Spark can read, large ones in many tasks.

    Lines are counted in each split and numbered from the counts of the splits before it.
    """
    rows = spark.read.text(paths).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id"), F.regexp_replace("value", "\\r$", "").alias("text"))
    rows = store.settle(rows)  # numbers stay as they are if executors are lost
    blocks = rows.groupBy("path", "_block").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("path").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(F.col("path").alias("_p"), F.col("_block").alias("_b"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = F.row_number().over(Window.partitionBy("path", "_block").orderBy("_id"))
    rows = rows.withColumn("_inside", inside).join(blocks, (F.col("path") == F.col("_p")) & (F.col("_block") == F.col("_b")))
    return rows.select("path", (F.col("_base") + F.col("_inside")).alias("line"), "text")


def read_lines(spark: SparkSession, paths: list[str], kind: str = "lines", options: Options | None = None) -> DataFrame:
    """Items (path, line, and the columns of an item) of line or JSONL files of any size, anywhere Spark reads; blank lines are passed over and keep their numbers.

    A line is parsed as in ``read_items``; its label is path:line.  A JSONL line that is not JSON is an error.
    """
    o = options or Options()
    rows = line_rows(spark, paths).where(F.trim(F.regexp_replace("text", r"\s", "")) != "")

    def of(path: str, line: int, text: str):
        text = text.removeprefix("\ufeff") if line == 1 else text
        at = f"{path}:{line}"
        if kind != "jsonl":
            return [_record(at, "line", _dump(text), Options(budget=o.budget))]
        try:
            json.loads(text)
        except ValueError:
            raise SourceError(f"{at}: not JSON") from None
        return [_record(at, "record", text.strip(), o)]

    return flat_map(rows, ["path", "line"], ["path", "line", "text"], of, _ROW)


def scan(spark: SparkSession, paths: list[str], options: Options | None = None, stdin: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows of ITEM for files and folders, in order, and the files passed over (SKIPPED).

    The driver lists; Spark reads the files and makes items of them, one file
    at a time, so files are the unit of parallel work and none is larger than
    MAX_TEXT (MAX_JSON for records; ``read_lines`` takes larger ones).  ``limit`` takes the first items, ``sample`` a fixed choice by hash, both in input order.
    """
    o = options or Options()
    if o.limit and o.sample:
        raise SourceError("limit and sample exclude each other")
    if o.each and o.each not in UNITS:
        raise SourceError(f"unknown unit {o.each!r}")
    none = F.lit(None).cast("string")
    if stdin is not None:
        if not stdin.strip():
            raise SourceError("no input")
        files = spark.createDataFrame([(0, "stdin", sniff(stdin), stdin)], "ordinal long, label string, kind string, text string").withColumn("path", none)
        skipped = spark.createDataFrame([], SKIPPED)
    else:
        files, skipped, texts = listing(spark, paths, o)
        if texts:
            content = spark.read.format("binaryFile").load(texts).select(F.regexp_replace("path", "^file:/+", "/").alias("c_path"), F.col("content").cast("string").alias("text"))
            files = files.join(content, F.col("path") == F.col("c_path"), "left").drop("c_path")
        else:
            files = files.withColumn("text", none)
    out = make_items(files, o)
    if o.sample:
        out = out.orderBy(F.xxhash64(F.lit(1), "ordinal", "pos")).limit(o.sample)
    if o.limit:
        out = out.orderBy("ordinal", "pos").limit(o.limit)
    from ..operators.rank import number_rows

    out = number_rows(out, [F.col("ordinal"), F.col("pos")], "n")
    names = [c.split(" ")[0] for c in re.split(r", (?=\w+ )", ITEM)]
    return out.withColumn("item_index", F.col("n") - 1).select(*[n for n in names if n in out.columns or n == "item_index"]), skipped


def read_items(spark: SparkSession, paths: list[str], options: Options | None = None, stdin: str | None = None) -> DataFrame:
    """The items of ``scan``."""
    return scan(spark, paths, options, stdin)[0]
