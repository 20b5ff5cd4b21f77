"""Near-duplicate detection with SimHash fingerprints and covering locality-sensitive hashing.

The covering family: every bit position gets a nonzero vector of ``RADIUS + 1``
bits, and for each nonzero vector v a mask selects the positions whose vector
has odd inner product with v.  The vectors of any RADIUS differing positions
leave some v orthogonal to all of them, so the mask of that v misses every
differing bit: two fingerprints within the radius always share a bucket.

Distinct fingerprints are bucketed, not rows, so groups of copies of any size
count once.  A bucket of at most ``BUCKET`` fingerprints is searched in one
task; a larger one is split by the same construction over the bits that its
mask leaves free.  Each split halves those bits, so that after at most three
splits a bucket cannot hold more than 2 ** 8 distinct fingerprints: no bucket
is capped and no pair lost.  Within a bucket only a spanning forest of the
links is emitted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle, small_batches, text_bytes, tidied, unused
from .graph import connected_components

RADIUS, SEED, WORDS = 3, 42, 3
#: Most fingerprints of a bucket that one task compares with each other.
BUCKET = 8192


def fingerprint(data: bytes) -> int:
    """64-bit SimHash of the 3-word shingles of a text, A-Z in lower case; 0 without words."""
    w = data.lower().split()
    if not w:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(w) <= WORDS:
        return digest(b" ".join(w), SEED)
    counts = np.zeros(64, np.int64)
    n = len(w) - WORDS + 1
    for at in range(0, n, 65536):
        part = w[at : at + 65536 + WORDS - 1]
        h = np.fromiter((digest(b"%b %b %b" % t, SEED) for t in zip(part, part[1:], part[2:], strict=False)), np.uint64)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def fingerprints(documents: DataFrame) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) for every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(x.as_py()) for x in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    return small_batches(documents).select("doc_id", text_bytes().alias("text")).mapInArrow(tidied(run), "doc_id long, fp long")


def covering_masks(free: int = (1 << 64) - 1, radius: int = RADIUS) -> list[int]:
    """Masks over the ``free`` bits such that any ``radius`` of them are missed by one mask."""
    size = 1 << (radius + 1)
    bits = [b for b in range(64) if free >> b & 1]
    vector = {b: 1 + k % (size - 1) for k, b in enumerate(bits)}
    return [sum(1 << b for b in bits if (vector[b] & v).bit_count() & 1) for v in range(1, size)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _spanning(fp: np.ndarray, node: np.ndarray, radius: int, width: int = 128) -> list[tuple[int, int]]:
    """Links (member, root) that span each group of fingerprints connected within the radius."""
    out, rest = [], np.arange(len(fp))
    while len(rest) > 1:
        group, front, rest = [rest[0]], rest[:1], rest[1:]
        while len(front) and len(rest):
            now, front = front[:width], front[width:]
            hit = (np.bitwise_count(fp[now][:, None] ^ fp[rest][None, :]) <= radius).any(axis=0)
            if hit.any():
                new, rest = rest[hit], rest[~hit]
                group.extend(new)
                front = np.concatenate([front, new])
        if len(group) > 1:
            nodes = node[np.array(group)]
            root = int(nodes.min())
            out.extend((int(x), root) for x in nodes if x != root)
    return out


def _bucket_links(keys: DataFrame, radius: int) -> DataFrame:
    """a, b for links within the buckets (t, key) of node, fp."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []  # rows of the last bucket, which may go on

        def links(rows: np.ndarray) -> pa.RecordBatch:
            t, key, node, fp = rows
            cut = np.flatnonzero((t[1:] != t[:-1]) | (key[1:] != key[:-1])) + 1
            starts, ends = np.r_[0, cut], np.r_[cut, len(t)]
            a, b = [], []
            two = starts[ends - starts == 2]
            near = two[np.bitwise_count((fp[two] ^ fp[two + 1]).view(np.uint64)) <= radius]
            a.extend(node[near].tolist())
            b.extend(node[near + 1].tolist())
            for s, e in zip(starts[ends - starts > 2], ends[ends - starts > 2], strict=True):
                for x, y in _spanning(fp[s:e].view(np.uint64), node[s:e], radius):
                    a.append(x)
                    b.append(y)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            rows = np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(4)])
            if held:
                rows = np.concatenate([*held, rows], axis=1)
            if not rows.shape[1]:
                continue
            last = int(np.flatnonzero((rows[0] != rows[0, -1]) | (rows[1] != rows[1, -1]))[-1] + 1) if ((rows[0] != rows[0, -1]) | (rows[1] != rows[1, -1])).any() else 0
            if last:
                yield links(rows[:, :last])
            held = [rows[:, last:]]
        if held and held[0].shape[1]:
            yield links(held[0])

    return keys.select("t", "key", "node", "fp").mapInArrow(tidied(run), "a long, b long")


def near_links(nodes: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """Links a, b that connect all nodes (node, fp; fp distinct) whose fingerprints differ in ``radius`` bits or fewer."""
    if bucket < 256:
        raise ValueError("three splits leave up to 8 free bits, so a bucket must take 256 fingerprints")
    full = (1 << 64) - 1
    masks = covering_masks(full, radius)  # fixed bits of table t
    rows = nodes.select("node", "fp", F.posexplode(F.array(*(F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in masks))).alias("t", "key"))
    found = []
    while True:
        hot = settle(rows.groupBy("t", "key").agg(F.count("*").alias("n")).where(F.col("n") > bucket).select(F.col("t").alias("ht"), F.col("key").alias("hkey")))
        at = (F.col("t") == F.col("ht")) & (F.col("key") == F.col("hkey"))
        any_hot = not hot.isEmpty()
        cold = rows.join(hot, at, "left_anti") if any_hot else rows
        found.append(_bucket_links(cold.repartition("t", "key").sortWithinPartitions("t", "key"), radius))
        if not any_hot:
            break
        finer = [[m | x for x in covering_masks(full & ~m, radius)] for m in masks]
        per = len(finer[0])
        masks = [x for group in finer for x in group]
        table = F.array(*(F.lit(_signed(m)) for m in masks))
        rows = rows.join(hot, at, "left_semi").select("node", "fp", (F.col("t") * per).alias("base"), F.explode(F.sequence(F.lit(0), F.lit(per - 1))).alias("u"))
        rows = rows.select("node", "fp", (F.col("base") + F.col("u")).alias("t")).select("node", "fp", "t", F.col("fp").bitwiseAND(F.element_at(table, F.col("t") + 1)).alias("key"))
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out


def near_duplicates(documents: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for every row of ``documents``.

    component_id is the smallest doc_id that a chain of links reaches.  Texts
    without words have fingerprint 0 and link like any other.  A row without
    doc_id belongs to the component of its fingerprint; the id is null if no row with that fingerprint has one.
    """
    return _components(settle(fingerprints(documents)), radius).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _components(fps: DataFrame, radius: int) -> DataFrame:
    nodes = fps.groupBy("fp").agg(F.min("doc_id").alias("node"))
    parts = connected_components(near_links(nodes.where("node IS NOT NULL"), radius))
    named = nodes.join(parts.withColumnRenamed("node", "x"), F.col("node") == F.col("x"), "left")
    named = named.select(F.col("fp").alias("nfp"), F.coalesce("component", "node").alias("component_id"))
    return fps.join(named, F.col("fp") == F.col("nfp")).select("doc_id", "fp", "component_id")


def one_of_each_group(documents: DataFrame, radius: int = RADIUS) -> DataFrame:
    """The rows of ``documents`` whose doc_id is their component's; columns unchanged.

    Of rows that repeat such an id one stays.  Rows without doc_id can't be named by a component and all stay.
    Null and empty texts have fingerprint 0 and are one group; extra columns may have any name.
    """
    k_id, k_n = unused(documents, "k_id", "k_n")
    fps = settle(fingerprints(documents))
    found = _components(fps, radius)
    keep = found.where("doc_id = component_id").groupBy(F.col("doc_id").alias(k_id)).agg(F.count("*").alias(k_n))
    kept = documents.join(keep, F.col("doc_id") == F.col(k_id))
    single = kept.where(F.col(k_n) == 1).drop(k_id, k_n)
    again = kept.where(F.col(k_n) > 1).drop(k_id, k_n).dropDuplicates(["doc_id"])
    if fps.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").isEmpty():
        out = single
    else:
        out = single.unionByName(again)
    return out.unionByName(documents.where("doc_id IS NULL"))
