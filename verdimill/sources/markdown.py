"""Markdown blocks, paragraphs and sections.

A document is read once, line by line.  A small state (the open text block,
whether it is a list item, and the heading path) decides which block a line
starts, continues or ends.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

# Line patterns of the Markdown syntax.
FENCE = re.compile(r"\s{0,3}(`{3,}|~{3,})")
ATX = re.compile(r"\s{0,3}(#{1,6})(?:\s+(.*?))?(?:\s+#+)?\s*$")
RULE = re.compile(r"\s{0,3}(?:(?:-\s*){3,}|(?:\*\s*){3,}|(?:_\s*){3,})$")
HTML = re.compile(r"\s{0,3}<(?:[a-zA-Z/!?])")
ITEM = re.compile(r"\s{0,3}(?:[-*+]|\d{1,9}[.)])(?:\s|$)")
SETEXT = re.compile(r"\s{0,3}(=+|-+)\s*$")


@dataclass
class Block:
    kind: str  # text, heading, code, html, rule or meta
    start: int
    end: int
    path: tuple[str, ...] = ()
    level: int = 0


@dataclass
class Piece:
    start: int
    end: int
    text: str
    path: tuple[str, ...] = ()
    anchor: str = ""


@dataclass
class _Reader:
    lines: list[str]
    out: list[Block] = field(default_factory=list)
    stack: list[tuple[int, str]] = field(default_factory=list)
    text: Block | None = None
    item: bool = False

    @property
    def path(self) -> tuple[str, ...]:
        return tuple(t for _, t in self.stack)

    def finish(self) -> None:
        if self.text:
            self.out.append(self.text)
        self.text, self.item = None, False

    def block(self, kind: str, start: int, end: int) -> int:
        self.finish()
        self.out.append(Block(kind, start + 1, end + 1, self.path))
        return end

    def heading(self, level: int, title: str, start: int, end: int) -> None:
        while self.stack and self.stack[-1][0] >= level:
            self.stack.pop()
        self.stack.append((level, title))
        self.out.append(Block("heading", start + 1, end + 1, self.path, level))

    def until(self, i: int, stop) -> int:
        """The first line after i where ``stop`` holds, or the last line."""
        return next((j for j in range(i + 1, len(self.lines)) if stop(self.lines[j])), len(self.lines) - 1)

    def fence(self, i: int, mark: str) -> int:
        return self.until(i, lambda s: s.strip().startswith(mark) and not s.strip().strip(mark[0]))

    def read(self) -> list[Block]:
        i = 0
        while i < len(self.lines):
            i = self.step(i) + 1
        self.finish()
        return self.out

    def step(self, i: int) -> int:
        """Handle line i; the last line that was used."""
        line, bare = self.lines[i], self.lines[i].strip()
        deep = line.startswith(("  ", "\t"))
        if i == 0 and bare == "---":
            ends = [j for j in range(1, len(self.lines)) if self.lines[j].strip() in ("---", "...")]
            return self.block("meta" if ends else "rule", 0, ends[0] if ends else 0)
        if self.item and bare and deep:
            m = FENCE.match(bare)
            last = self.fence(i, m[1]) if m else i
            self.text.end = last + 1
            return last
        if not bare:
            following = self.lines[i + 1] if i + 1 < len(self.lines) else ""
            if not (self.item and following.strip() and following.startswith(("  ", "\t"))):
                self.finish()
            return i
        if m := FENCE.match(line):
            return self.block("code", i, self.fence(i, m[1]))
        if m := ATX.match(line):
            self.finish()
            self.heading(len(m[1]), (m[2] or "").strip(), i, i)
            return i
        if self.text and not self.item and (m := SETEXT.match(line)):
            title = " ".join(s.strip() for s in self.lines[self.text.start - 1 : self.text.end])
            start, self.text = self.text.start - 1, None
            self.heading(1 if m[1][0] == "=" else 2, title, start, i)
            return i
        if RULE.match(line):
            return self.block("rule", i, i)
        if not self.text and HTML.match(line):
            last = self.until(i, lambda s: not s.strip())
            last -= not self.lines[last].strip() and last > i
            if bare.startswith("<!--"):
                while last < len(self.lines) - 1 and "-->" not in "\n".join(self.lines[i : last + 1]):
                    last += 1
            return self.block("html", i, last)
        if not self.text and line.startswith(("    ", "\t")):
            last = i
            for j in range(i + 1, len(self.lines)):
                if self.lines[j].strip():
                    if not self.lines[j].startswith(("    ", "\t")):
                        break
                    last = j
            return self.block("code", i, last)
        if ITEM.match(line):
            self.finish()
            self.text, self.item = Block("text", i + 1, i + 1, self.path), True
            return i
        if not self.text:
            self.text = Block("text", i + 1, i + 1, self.path)
        self.text.end = i + 1
        return i


def blocks(lines: list[str]) -> list[Block]:
    return _Reader(lines).read()


def span(lines: list[str], start: int, end: int) -> str:
    return "\n".join(lines[start - 1 : end])


def paragraphs(lines: list[str]) -> list[Piece]:
    """Text blocks, with the headings above them."""
    return [Piece(b.start, b.end, span(lines, b.start, b.end), b.path) for b in blocks(lines) if b.kind == "text"]


def plain_paragraphs(lines: list[str]) -> list[Piece]:
    """Runs of lines that are not blank."""
    out: list[Piece] = []
    for i, line in enumerate(lines, 1):
        if line.strip():
            if out and out[-1].end == i - 1:
                out[-1].end = i
            else:
                out.append(Piece(i, i, ""))
    for p in out:
        p.text = span(lines, p.start, p.end)
    return out


def slug(title: str, seen: dict[str, int]) -> str:
    """The anchor of a heading; repeated ones get -1, -2 and so on."""
    base = "".join(c if c.isalnum() or c in "-_" else "-" if c == " " else "" for c in title.lower())
    name, n = base, seen.get(base, 0)
    while name in seen:
        n += 1
        name = f"{base}-{n}"
    seen[base] = n
    seen.setdefault(name, 0)
    return name


def sections(lines: list[str]) -> list[Piece]:
    """The text under each heading down to the next one; headings without text only add to the path."""
    found = blocks(lines)
    marks = [b for b in found if b.kind == "heading"]
    meta = next((b.end for b in found if b.kind == "meta"), 0)
    seen: dict[str, int] = {}
    anchors = [slug(b.path[-1] if b.path else "", seen) for b in marks]
    edges = [(meta + 1, (), "")] + [(b.end + 1, b.path, a) for b, a in zip(marks, anchors, strict=True)]
    stops = [b.start - 1 for b in marks] + [len(lines)]
    out = []
    for (start, path, anchor), end in zip(edges, stops, strict=True):
        while start <= end and not lines[start - 1].strip():
            start += 1
        while end >= start and not lines[end - 1].strip():
            end -= 1
        if start <= end:
            out.append(Piece(start, end, span(lines, start, end), path, anchor))
    return out
