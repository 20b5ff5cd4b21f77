"""Unified diffs: files, hunks, added lines and changed functions."""

from __future__ import annotations

import ast
import os
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import code
from .batches import flat_map

# Patterns of the diff format and of generated files.
HUNK = re.compile(r"@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@(.*)")
COMMIT = re.compile(r"(?:commit|From) ([0-9a-f]{7,64})\b")
GENERATED = re.compile(r"\s*(?://|#|/\*|\*|<!--|--)\s*(?:Code generated .* DO NOT EDIT\.|@generated\b)")
# Files that package managers write.
LOCKFILES = frozenset("go.sum package-lock.json npm-shrinkwrap.json pnpm-lock.yaml yarn.lock bun.lockb Cargo.lock Gemfile.lock poetry.lock uv.lock Pipfile.lock composer.lock flake.lock".split())


@dataclass
class Hunk:
    header: str
    context: str
    old_start: int
    new_start: int
    lines: list[str] = field(default_factory=list)

    def numbered(self):
        """(mark, old line, new line, text) of each line."""
        old, new = self.old_start, self.new_start
        for line in self.lines:
            mark = line[:1]
            if mark in (" ", "-", "+"):
                yield mark, old, new, line[1:]
            old += mark in (" ", "-")
            new += mark in (" ", "+")

    def first_change(self) -> int:
        return next((new for mark, _, new, _ in self.numbered() if mark != " "), self.new_start)


@dataclass
class File:
    old: str
    new: str
    change: str = "modified"
    commit: str = ""
    binary: bool = False
    named: bool = False
    hunks: list[Hunk] = field(default_factory=list)

    @property
    def path(self) -> str:
        return self.new or self.old

    def skip_reason(self, head: list[str] = ()) -> str:
        """Why a file is left out, or empty.  ``head``: its first lines, if known."""
        shown = [(new, text) for h in self.hunks for mark, _, new, text in h.numbered() if mark != "-" and new <= 5]
        made = any(GENERATED.match(t) for _, t in shown) or any(GENERATED.match(t) for t in list(head)[:5])
        rules = [("binary file", self.binary), ("deleted", self.change == "deleted"), ("lockfile", os.path.basename(self.path) in LOCKFILES), ("generated", made), ("renamed only", not self.hunks and self.change == "renamed"), ("no changed lines", not self.hunks)]
        return next((name for name, hit in rules if hit), "")


def is_diff(text: str) -> bool:
    """Whether text is a diff, from its first lines."""
    lines = text.lstrip("\r\n\t ").split("\n")
    if not lines[0].startswith(("diff ", "--- ", "Index: ", "commit ", "From ")):
        return False
    for a, b, c in zip(lines, lines[1:], lines[2:], strict=False):
        if a.startswith(("diff --git ", "diff --cc ", "diff --combined ")) or a.startswith("--- ") and b.startswith("+++ ") and HUNK.match(c):
            return True
    return False


def _name(text: str) -> str:
    """A path of a header: tab and prefix dropped, quotes undone."""
    name = text.split("\t")[0].strip()
    if name.startswith('"'):
        try:
            name = ast.literal_eval("b" + name).decode("utf-8", "replace")
        except (SyntaxError, ValueError):
            return name
    return name[2:] if name[:2] in ("a/", "b/") else name


def _git_names(rest: str) -> tuple[str, str]:
    half = len(rest) // 2
    if rest[:2] == "a/" and rest[half : half + 3] == " b/" and rest[2:half] == rest[half + 3 :]:
        return rest[2:half], rest[2:half]
    m = re.match(r'("(?:\\.|[^"\\])*"|a/.+?) ("(?:\\.|[^"\\])*"|b/.+)$', rest)
    return (_name(m[1]), _name(m[2])) if m else ("", "")


def parse(text: str) -> tuple[list[File], int]:
    """Files of a diff, and how many combined diffs could not be read."""
    lines = text.replace("\r\n", "\n").split("\n")
    files: list[File] = []
    cur: File | None = None
    commit, combined, skipping, at = "", 0, False, 0
    while at < len(lines):
        line = lines[at]
        at += 1
        if m := COMMIT.match(line):
            commit, cur, skipping = m[1], None, False
        elif line.startswith(("diff --cc ", "diff --combined ")):
            combined, cur, skipping = combined + 1, None, True
        elif line.startswith("diff --git "):
            cur, skipping = File(*_git_names(line[11:]), commit=commit), False
            files.append(cur)
        elif cur and line.startswith(("new file mode", "deleted file mode")):
            cur.change = "added" if line[0] == "n" else "deleted"
        elif cur and (m := re.match(r"rename (from|to) (.*)", line)):
            setattr(cur, "old" if m[1] == "from" else "new", _name(m[2]))
            cur.change = "renamed"
        elif cur and (line.startswith("Binary files ") or line == "GIT binary patch"):
            cur.binary = True
        elif skipping:
            continue
        elif line.startswith("--- ") and at < len(lines) and lines[at].startswith("+++ "):
            old, new = _name(line[4:]), _name(lines[at][4:])
            at += 1
            if cur is None or cur.named:
                cur = File(old, new, commit=commit)
                files.append(cur)
            cur.named = True
            if "/dev/null" in (old, new):
                cur.change = "added" if old == "/dev/null" else "deleted"
            cur.old, cur.new = cur.old if old == "/dev/null" else old, cur.new if new == "/dev/null" else new
            if cur.old == "/dev/null":
                cur.old = ""
            if cur.new == "/dev/null":
                cur.new = ""
        elif cur and (m := HUNK.match(line)):
            h = Hunk(line, m[5].strip(), int(m[1]), int(m[3]))
            left = [int(x) if x else 1 for x in (m[2], m[4])]
            while at < len(lines) and (max(left) > 0 or lines[at].startswith("\\")):
                body = lines[at] or " "
                if body[0] not in " -+\\":
                    break
                left[0] -= body[0] in " -"
                left[1] -= body[0] in " +"
                h.lines.append(body)
                at += 1
            cur.hunks.append(h)
    return files, combined


def is_new_side(file: File, root: str) -> bool:
    """Whether the file below ``root`` is what the diff leads to: each line that the hunks show stands at its place.  Paths out of ``root`` are never read."""
    path = os.path.realpath(os.path.join(root, file.path))
    if os.path.commonpath([path, os.path.realpath(root)]) != os.path.realpath(root) or not os.path.isfile(path):
        return False
    with open(path, encoding="utf-8", errors="replace") as f:
        lines = f.read().replace("\r\n", "\n").split("\n")
    shown = ((new, text) for h in file.hunks for mark, _, new, text in h.numbered() if mark in (" ", "+"))
    return all(0 < n <= len(lines) and lines[n - 1] == text.rstrip("\r") for n, text in shown)


HUNK_ROWS = "name string, path string, old_path string, change string, commit string, skip string, hunk_no int, header string, context string, old_start int, new_start int, first_change int, lines array<string>"


def hunk_rows(text: str) -> list[tuple]:
    """HUNK_ROWS of a diff; names carry the commit if there are several.  Files without hunks have one row with hunk_no 0."""
    files, _ = parse(text)
    several = len({f.commit for f in files}) > 1
    out = []
    for f in files:
        name = f"{f.path}@{f.commit[:12]}" if several and f.commit else f.path
        head = (name, f.path, f.old, f.change, f.commit, f.skip_reason())
        if not f.hunks:
            out.append((*head, 0, "", "", 0, 0, 0, []))
        for i, h in enumerate(f.hunks, 1):
            out.append((*head, i, h.header, h.context, h.old_start, h.new_start, h.first_change(), h.lines))
    return out


def read_hunks(spark, texts: DataFrame, column: str = "value") -> DataFrame:
    """HUNK_ROWS of all diffs in a column of texts."""
    return flat_map(texts, [], [column], hunk_rows, HUNK_ROWS)


def added_lines(hunks: DataFrame) -> DataFrame:
    """name, line, text of every added line that is not blank."""
    rows = hunks.where("skip = ''").select("name", "hunk_no", "new_start", F.posexplode("lines").alias("pos", "raw"))
    shown = F.when(F.substring("raw", 1, 1).isin(" ", "+"), 1).otherwise(0)
    before = Window.partitionBy("name", "hunk_no").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("line", F.col("new_start") + F.coalesce(F.sum(shown).over(before), F.lit(0)))
    return rows.where(F.col("raw").startswith("+") & (F.trim(F.substring("raw", 2, 1_000_000)) != "")).select("name", F.col("line").cast("int").alias("line"), F.expr("substring(raw, 2)").alias("text"))


def file_items(hunks: DataFrame) -> DataFrame:
    """name, hunks (text): all hunks of a file as one item."""
    one = F.concat_ws("\n", "header", F.array_join("lines", "\n"))
    rows = hunks.where("skip = ''").groupBy("name").agg(F.sort_array(F.collect_list(F.struct("hunk_no", one.alias("t")))).alias("h"))
    return rows.select("name", F.array_join(F.transform("h", lambda x: x["t"]), "\n").alias("value"))


FUNCTION_ROWS = "function string, lead int, start int, end int"


def function_rows(path: str, src: str) -> list[tuple]:
    return [(f.name, f.lead, f.start, f.end) for f in code.functions(path, src) or []]


def changed_functions(hunks: DataFrame, files: DataFrame) -> DataFrame:
    """name, function, line: the smallest function around each changed line, and one row with a null function for changes outside any.

    ``files``: path and text of the new versions.  The range join is by path.
    """
    funcs = flat_map(files, ["path"], ["path", "text"], function_rows, FUNCTION_ROWS)
    rows = hunks.where("skip = ''").select("name", "path", "hunk_no", "new_start", F.posexplode("lines").alias("pos", "raw"))
    shown = F.when(F.substring("raw", 1, 1).isin(" ", "+"), 1).otherwise(0)
    before = Window.partitionBy("name", "hunk_no").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    at = rows.withColumn("line", F.col("new_start") + F.coalesce(F.sum(shown).over(before), F.lit(0))).where(F.substring("raw", 1, 1).isin("+", "-"))
    f = funcs.withColumnRenamed("path", "f_path")
    j = at.join(f, (F.col("path") == F.col("f_path")) & F.col("line").between(F.col("lead"), F.col("end")), "left")
    best = j.groupBy("name", "hunk_no", "pos").agg(F.min_by(F.struct("function", "start"), F.struct(F.col("end") - F.col("lead"), "start")).alias("b"), F.first("line").alias("line"))
    return best.groupBy("name", F.col("b.function").alias("function")).agg(F.min("line").cast("int").alias("line"))
