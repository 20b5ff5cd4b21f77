"""Long texts cut into parts that fit a budget of JSON bytes, at the best boundaries there are."""

from __future__ import annotations

from collections.abc import Callable

from . import markdown

DEFAULT_BUDGET, RESERVED = 64 * 1024, 1024


def json_size(s: str) -> int:
    """Bytes of a string in JSON with HTML-safe escapes, without quotes."""
    n = len(s.encode("utf-8", "surrogatepass"))
    return n + sum(1 if c in '"\\\n\r\t' else 5 for c in s if c in '"\\<>&' or c < " ")


def chunks(line: str, budget: int) -> list[str]:
    """One line cut between characters."""
    out, start, used = [], 0, 0
    for i, c in enumerate(line):
        size = json_size(c)
        if used + size > budget and i > start:
            out.append(line[start:i])
            start, used = i, 0
        used += size
    return [*out, line[start:]]


def blank_breaks(lines: list[str]) -> set[int]:
    """Lines (from 1) that follow a blank one."""
    return {i for i in range(2, len(lines) + 1) if not lines[i - 2].strip()}


def markdown_breaks(lines: list[str]) -> set[int]:
    return {b.start for b in markdown.blocks(lines)}


def split(lines: list[str], budget: int, breaks: Callable[[list[str]], set[int]] = blank_breaks, finer: Callable[[list[str]], set[int]] | None = None) -> list[tuple[int, int, str]]:
    """(first line, last line, text) of parts of at most ``budget`` bytes.

    Units between breaks are packed in order; a unit that is too large is cut
    at the finer breaks, then between lines, then between characters.
    """
    out: list[tuple[int, int, str]] = []
    open_: list[int] = []  # first line, last line, size

    def close() -> None:
        if open_:
            first, last, _ = open_
            while last > first and not lines[last - 1].strip():
                last -= 1
            text = markdown.span(lines, first, last)
            if text.strip():
                out.append((first, last, text))
            open_.clear()

    def add(first: int, last: int, size: int) -> bool:
        if open_ and open_[2] + size <= budget:
            open_[1:] = [last, open_[2] + size]
            return True
        close()
        if size <= budget:
            open_[:] = [first, last, size]
            return True
        return False

    cost = [json_size(s) + 2 for s in lines]

    def units(first: int, last: int, at: set[int]):
        start = first
        for i in range(first + 1, last + 2):
            if i == last + 1 or i in at:
                yield start, i - 1
                start = i

    def place(first: int, last: int, levels: list[set[int]]) -> None:
        for a, b in units(first, last, levels[0]) if levels else ((i, i) for i in range(first, last + 1)):
            if add(a, b, sum(cost[a - 1 : b])):
                continue
            if levels:
                place(a, b, levels[1:])
                close()
            else:
                out.extend((a, a, c) for c in chunks(lines[a - 1], budget))

    if lines:
        place(1, len(lines), [breaks(lines), *([finer(lines)] if finer else [])])
        close()
    return out
