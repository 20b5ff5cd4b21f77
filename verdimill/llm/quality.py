"""Quality rules: repetition coverage by rolling hashes of n-grams and by lines.

For each text, words become numbers and the hashes of all n-grams come from
those of the (n-1)-grams with one multiplication.  A word lies in a duplicated
n-gram if it belongs to an occurrence other than the first.  The share of a
text's characters in such words, for each length, and in lines equal to an
earlier line make the verdict.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import small_batches, text_bytes, tidied

SYMBOLS = b"#*$%&|<>"
#: Highest shares of characters in duplicated n-grams, by n, and in duplicated lines.  One
#: repeated line in a short text stays below them.
MAX_NGRAM_SHARE = {5: 0.25, 6: 0.24, 7: 0.23, 8: 0.22, 9: 0.21, 10: 0.20}
MAX_LINE_CHARS = 0.20
#: Lower bounds, and one on the share of lines, for texts with so many repeated lines or separate repeated passages.
REPEATS, MAX_NGRAM_SHARE_REPEATED, MAX_LINES = 2, {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}, 0.30
#: The base rule.
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _later(codes: np.ndarray) -> np.ndarray:
    """True where a code equals an earlier one."""
    order = np.argsort(codes, kind="stable")
    s = codes[order]
    out = np.zeros(len(codes), bool)
    out[order[1:][s[1:] == s[:-1]]] = True
    return out


def _covered(starts: np.ndarray, n: int, words: int) -> np.ndarray:
    """True for words in a window of n words that starts where ``starts`` is true."""
    step = np.zeros(words + 1, np.int64)
    at = np.flatnonzero(starts)
    np.add.at(step, at, 1)
    np.add.at(step, at + n, -1)
    return np.cumsum(step[:-1]) > 0


def measure(data: bytes) -> dict:
    """All counts and shares of one text."""
    words = data.split()
    n = len(words)
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    points = np.fromiter((len(w.decode("utf-8", "replace")) for w in number), np.int64, len(number))[ids] if n else np.zeros(0, np.int64)
    chars = int(points.sum())
    out = {"n_words": n, "word_chars": chars, "n_symbols": len(data) - len(data.translate(None, SYMBOLS)), "n_dup_lines": 0, "n_repeat_words": 0}
    seen: set[bytes] = set()
    n_lines = line_chars = 0
    if b"\n" in data:
        for line in data.split(b"\n"):
            if not line or line.isspace():
                continue
            n_lines += 1
            if line in seen:
                out["n_dup_lines"] += 1
                line_chars += sum(len(w.decode("utf-8", "replace")) for w in line.split())
            else:
                seen.add(line)
    out["dup_line_share"] = out["n_dup_lines"] / n_lines if n_lines else 0.0
    out["dup_line_char_share"] = line_chars / chars if chars else 0.0
    share, runs = dict.fromkeys(MAX_NGRAM_SHARE, 0.0), dict.fromkeys(MAX_NGRAM_SHARE, 0)
    if n >= 3:
        v = np.int64(len(number))
        if len(number) < 2_000_000:
            codes = (ids[:-2] * v + ids[1:-1]) * v + ids[2:]
        else:  # pairs are numbered first, so that triples fit
            pairs = np.unique(ids[:-1] * v + ids[1:], return_inverse=True)[1].astype(np.int64)
            codes = np.unique(pairs[:-1] * v + ids[2:], return_inverse=True)[1].astype(np.int64)
        order = np.argsort(codes, kind="stable")
        s = codes[order]
        same = s[1:] == s[:-1]
        if same.any():
            twice = np.zeros(len(codes), bool)
            twice[order[1:][same]] = True
            twice[order[:-1][same]] = True
            out["n_repeat_words"] = int(_covered(twice, 3, n).sum())
            # Rolling hashes: a text without a repeated n-gram has no repeated longer one.
            value = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
            value ^= value >> np.uint64(29)
            h = value
            for k in range(2, max(MAX_NGRAM_SHARE) + 1):
                if n < k:
                    break
                h = h[:-1] * _BASE + value[k - 1 :]
                if k in MAX_NGRAM_SHARE:
                    again = _later(h ^ (h >> np.uint64(31)))
                    if not again.any():
                        break
                    inside = _covered(again, k, n)
                    share[k] = float(points[inside].sum()) / chars
                    runs[k] = int(inside[0]) + int((inside[1:] & ~inside[:-1]).sum())
    out |= {f"dup_{k}gram_share": share[k] for k in share}
    out["base_failed"] = n < MIN_WORDS or 100 * out["n_repeat_words"] > MAX_REPEAT_PERCENT * n
    lines = out["n_dup_lines"] >= REPEATS
    fine = out["dup_line_char_share"] <= MAX_LINE_CHARS and not (lines and out["dup_line_share"] > MAX_LINES)
    fine = fine and not any((lines or runs[k] >= REPEATS) and share[k] > most for k, most in MAX_NGRAM_SHARE_REPEATED.items())
    out["kept"] = not out["base_failed"] and fine and all(share[k] <= most for k, most in MAX_NGRAM_SHARE.items())
    return out


_LONGS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_DOUBLES = ("dup_line_share", "dup_line_char_share", *(f"dup_{k}gram_share" for k in MAX_NGRAM_SHARE))
_SCHEMA = "doc_id long, " + ", ".join([*(f"{c} long" for c in _LONGS), *(f"{c} double" for c in _DOUBLES), "base_failed boolean", "kept boolean"])
_ARROW = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in _LONGS), *((c, pa.float64()) for c in _DOUBLES), ("base_failed", pa.bool_()), ("kept", pa.bool_())])


def quality_rules(documents: DataFrame) -> DataFrame:
    """Counts, shares and verdict for every whole text of ``documents``.

    A null or empty text has no words and fails the base rule.  A null doc_id is kept as null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [measure(x.as_py()) for x in batch.column(1)]
            arrays = [batch.column(0), *(pa.array([r[f.name] for r in rows], f.type) for f in list(_ARROW)[1:])]
            yield pa.RecordBatch.from_arrays(arrays, schema=_ARROW)

    return small_batches(documents).select("doc_id", text_bytes().alias("text")).mapInArrow(tidied(run), _SCHEMA)
