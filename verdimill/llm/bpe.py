"""Byte-level BPE encoding and decoding as a monoid tree reduction.

A text is cut into halves until they are short; leaves are encoded alone and
neighbours are joined.  A join re-encodes a window around the boundary and
grows it until what lies outside is proven to stay as it is:

* Between matches of the splitting pattern: a match of the left part is final
  if it ends ``LOOK`` characters before the cut, since no alternative of the
  pattern reads further; from the last final match the window is matched anew
  until a match ends where one of the right part's matches ends.  The pattern has no
  look-behind, so from there on both agree.
* Inside one long match: tokens form the encoding of their concatenation
  exactly if every two neighbours do.  The window is merged anew and both seams
  are tested that way; while a test fails the window doubles.

Decoding joins the byte strings of the two halves.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, tidied

#: No match of the pattern depends on characters more than this far behind its end.
LOOK = 3
#: Characters of a leaf, bytes of a match that is merged without a tree, entries of the caches.
LEAF, SHORT, CACHE = 4096, 64, 250_000


class _Known(dict):
    """Ids of the matches seen first; what comes when it is full, and long matches, are encoded each time."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, match: str) -> bytes:
        ids = self.encode(match)
        if len(self) < CACHE and len(match) <= SHORT:
            self[match] = ids
        return ids


class Codec:
    """Encoder and decoder for a table of ranks and a splitting pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.vocab = {i: b for b, i in ranks.items()}
        self.split = regex.compile(pattern)
        self._ids = _Known(self.ids_of)
        self._fits: dict[tuple[int, int], bool] = {}

    @classmethod
    def parse(cls, data: bytes, pattern: str) -> Codec:
        """From the lines ``base64(token) rank`` of a rank file."""
        return cls({base64.b64decode(a): int(b) for a, b in (x.split() for x in data.splitlines() if x)}, pattern)

    def merge(self, data: bytes) -> list[int]:
        """Merge bytes pairwise, lowest rank first, leftmost on ties."""
        ranks = self.ranks
        n = len(data)
        if n > SHORT:
            return self._merge_heap(data)
        parts = [data[i : i + 1] for i in range(n)]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]

    def _merge_heap(self, data: bytes) -> list[int]:
        ranks, n = self.ranks, len(data)
        end = list(range(1, n + 1))  # end[i]: end of the part that starts at i; 0 if none does
        before = list(range(-1, n))  # start of the part before the one at i
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(data[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, to = heapq.heappop(heap)
            if not end[i] or end[i] >= to or end[end[i]] != to:
                continue
            end[end[i]], end[i] = 0, to
            if to < n:
                before[to] = i
                if (r := ranks.get(data[i : end[to]])) is not None:
                    heapq.heappush(heap, (r, i, end[to]))
            if (b := before[i]) >= 0 and (r := ranks.get(data[b:to])) is not None:
                heapq.heappush(heap, (r, b, to))
        out, i = [], 0
        while i < n:
            out.append(ranks[data[i : end[i]]])
            i = end[i]
        return out

    def fits(self, a: int, b: int) -> bool:
        """Whether two tokens in a row are the encoding of their bytes."""
        got = self._fits.get((a, b))
        if got is None:
            if len(self._fits) >= CACHE:
                self._fits.clear()
            got = self._fits[a, b] = self.merge(self.vocab[a] + self.vocab[b]) == [a, b]
        return got

    def join_tokens(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of two byte strings in a row from their encodings."""
        i = j = 1
        while True:
            i, j = min(i, len(left)), min(j, len(right))
            window = self.merge(b"".join(self.vocab[t] for t in left[len(left) - i :] + right[:j]))
            left_ok = i == len(left) or self.fits(left[-i - 1], window[0])
            right_ok = j == len(right) or self.fits(window[-1], right[j])
            if left_ok and right_ok:
                return left[: len(left) - i] + window + right[j:]
            i, j = i if left_ok else 2 * i, j if right_ok else 2 * j

    def _tree(self, data: bytes) -> list[int]:
        if len(data) <= SHORT:
            return self.merge(data)
        half = SHORT
        while 2 * half < len(data):
            half *= 2
        return self.join_tokens(self._tree(data[:half]), self._tree(data[half:]))

    def ids_of(self, match: str) -> bytes:
        """Ids of one match of the pattern, as little-endian 32-bit integers."""
        data = match.encode("utf-8")
        whole = self.ranks.get(data)
        return np.array(self._tree(data) if whole is None else [whole], "<u4").tobytes()

    def join_matches(self, left: list[str], right: list[str]) -> list[str]:
        """The matches of two texts in a row from the matches of each."""
        keep, tail = len(left), 0
        while keep and tail < LOOK:
            keep -= 1
            tail += len(left[keep])
        head = "".join(left[keep:])
        take = 4
        while True:
            take = min(take, len(right))
            window = head + "".join(right[:take])
            known = len(window) if take == len(right) else len(window) - LOOK
            ends, at = {}, len(head)
            for k in range(take):
                at += len(right[k])
                ends[at] = k + 1
            at, fresh = 0, []
            for m in self.split.findall(window):
                at += len(m)
                if at > known:
                    break
                fresh.append(m)
                if at in ends:
                    return left[:keep] + fresh + right[ends[at] :]
            if take == len(right):
                return left[:keep] + fresh
            take *= 2

    def matches(self, text: str) -> list[str]:
        """All matches of the pattern in a text, by halves."""
        if len(text) <= LEAF:
            return self.split.findall(text)
        half = len(text) // 2
        return self.join_matches(self.matches(text[:half]), self.matches(text[half:]))

    def encode_bytes(self, text: str) -> bytes:
        return b"".join(map(self._ids.__getitem__, self.matches(text)))

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), "<u4").tolist()

    def decode(self, ids: list[int]) -> bytes:
        """Bytes of a list of ids, by halves."""
        if len(ids) <= LEAF:
            return b"".join(map(self.vocab.__getitem__, ids))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


_CODECS: dict[tuple[int, str], Codec] = {}


def _codec(data: bytes, pattern: str) -> Codec:
    """One codec for each rank file and worker process."""
    key = (zlib.crc32(data), pattern)
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec.parse(data, pattern)
    return _CODECS[key]


def encode_column(df: DataFrame, path: str, pattern: str, text: str = "text", keep_ids: bool = False) -> DataFrame:
    """Add n_tokens, ids_sha256, decoded_sha256 (and, if asked, ids) to every row of ``df``.

    A null text counts as empty: no tokens and the digests of nothing.  Columns
    of those names are replaced; all others pass unchanged.  ``path`` is a rank file on the driver.
    """
    spark: SparkSession = df.sparkSession
    with open(path, "rb") as f:
        ranks = spark.sparkContext.broadcast(f.read())  # a vocabulary: its size does not depend on the data
    added = ["n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * keep_ids]
    df = df.drop(*added)
    df = df.withColumns({"n_tokens": F.lit(0).cast("long"), "ids_sha256": F.lit(""), "decoded_sha256": F.lit("")} | ({"ids": F.array().cast("array<int>")} if keep_ids else {}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(ranks.value, pattern)
        for batch in batches:
            counts, digests, decoded, lists = [], [], [], []
            for value in batch.column(batch.schema.get_field_index(text)):
                raw = codec.encode_bytes(value.as_py() or "")
                ids = np.frombuffer(raw, "<u4").tolist()
                counts.append(len(ids))
                digests.append(hashlib.sha256(raw).hexdigest())
                decoded.append(hashlib.sha256(codec.decode(ids)).hexdigest())
                if keep_ids:
                    lists.append(raw)
            new = {"n_tokens": pa.array(counts, pa.int64()), "ids_sha256": pa.array(digests, pa.string()), "decoded_sha256": pa.array(decoded, pa.string())}
            if keep_ids:
                ends = np.cumsum([0, *(len(x) // 4 for x in lists)])
                new["ids"] = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(lists), "<i4")))
            yield pa.RecordBatch.from_arrays([new.get(n, c) for n, c in zip(batch.schema.names, batch.columns, strict=True)], names=batch.schema.names)

    return small_batches(df).mapInArrow(tidied(run), df.schema)


def tokenize_documents(documents: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for every whole text of ``documents``."""
    return encode_column(documents.select("doc_id", "text"), path, pattern).drop("text")
