"""Sharding by a consistent-hash ring with virtual nodes and bounded loads (DataFrame operations only).

The ring is cut into ``2 ** ARC_BITS`` equal arcs.  Every shard owns
``VNODES`` virtual nodes, hashed onto arcs.  A row's arc is the top bits of the
hash of its key; its first choice is the shard of the next virtual node
clockwise.  A shard holds at most its capacity: rows beyond it continue
clockwise to the next shard with room.  Capacities are ``floor(N / shards)``
or one more, so the row counts of any two shards differ by one at most.

All rows of one arc see the same clockwise sequence of shards.  So only the
counts per arc (a table whose size is a constant) are needed to tell how many
rows of each arc go to which shard; a row finds its shard and its slot from its
rank in its arc.  One narrow shuffle by arc orders the rows; texts never move.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small_table

ARC_BITS = 12
VNODES = 64


def _point(name: str) -> int:
    return int.from_bytes(hashlib.sha256(name.encode()).digest()[:8], "big")


def ring(shards: int, vnodes: int = VNODES, arc_bits: int = ARC_BITS) -> list[list[int]]:
    """For each arc, all shards in the order in which a clockwise walk from it meets them."""
    nodes = sorted((_point(f"{s}/{v}"), s) for s in range(shards) for v in range(vnodes))
    arcs, shift = 1 << arc_bits, 64 - arc_bits
    walks, start = [], 0
    for arc in range(arcs):
        while start < len(nodes) and nodes[start][0] >> shift < arc:
            start += 1
        seen: dict[int, None] = {}
        for k in range(len(nodes)):
            seen.setdefault(nodes[(start + k) % len(nodes)][1])
            if len(seen) == shards:
                break
        walks.append(list(seen))
    return walks


def capacities(rows: int, shards: int) -> list[int]:
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def spans(counts: dict[int, int], shards: int, vnodes: int = VNODES, arc_bits: int = ARC_BITS) -> list[dict]:
    """How the ranks of each arc are cut into shards: rows arc, lo, hi, shard, first_slot.

    Rounds of offers: in round r every arc offers its unplaced rows to the r-th
    shard of its walk, in ring order; what exceeds the shard's room continues.
    """
    walks = ring(shards, vnodes, arc_bits)
    room = capacities(sum(counts.values()), shards)
    used = [0] * shards
    done = dict.fromkeys(counts, 0)
    out = []
    for r in range(shards):
        for arc in sorted(counts):
            left = counts[arc] - done[arc]
            if not left:
                continue
            s = walks[arc][r]
            take = min(left, room[s] - used[s])
            if take:
                out.append({"arc": arc, "lo": done[arc], "hi": done[arc] + take, "shard": s, "first_slot": used[s]})
                used[s] += take
                done[arc] += take
    return out


def ring_shards(df: DataFrame, key: str, shards: int = 16, vnodes: int = VNODES, arc_bits: int = ARC_BITS) -> DataFrame:
    """``df`` with columns shard (int) and slot (long, gapless from 0 in each shard).

    Rows without a key are dealt by their other columns.  Rows with equal keys lie in one arc
    and are ordered by their other columns; rows equal in all columns are
    interchangeable.  An empty table stays empty.  Columns named shard or slot are replaced.
    """
    spark = df.sparkSession
    df = df.drop("shard", "slot")
    others = [F.col(c) for c in df.columns if c != key]
    point = F.when(F.col(key).isNull(), F.xxhash64(*others)).otherwise(F.xxhash64(F.col(key))) if others else F.xxhash64(F.col(key))
    arc = F.shiftrightunsigned(point, 64 - arc_bits)
    counts = {r["arc"]: r["n"] for r in df.select(arc.alias("arc")).groupBy("arc").agg(F.count("*").alias("n")).collect()}
    plan = small_table(spark, spans(counts, shards, vnodes, arc_bits), "arc bigint, lo bigint, hi bigint, shard int, first_slot bigint")
    order = Window.partitionBy("_arc").orderBy(point, F.col(key), *others)
    ranked = df.withColumn("_arc", arc).withColumn("_rank", F.row_number().over(order).cast("long") - 1)
    plan = plan.select(*(F.col(c).alias(f"_p_{c}") for c in plan.columns))
    # The plan has at most shards * 2 ** arc_bits rows, whatever the input.
    at = (F.col("_arc") == F.col("_p_arc")) & (F.col("_rank") >= F.col("_p_lo")) & (F.col("_rank") < F.col("_p_hi"))
    slot = F.col("_p_first_slot") + F.col("_rank") - F.col("_p_lo")
    return ranked.join(F.broadcast(plan), at).select(*df.columns, F.col("_p_shard").alias("shard"), slot.alias("slot"))


def shard_documents(documents: DataFrame, shards: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of ``documents``.

    size is the UTF-8 length of the text plus 1; a null text counts as empty
    (size 1, CRC 0).  The law is ``rows``, so grown_shard is null.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = documents.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    out = ring_shards(rows, "doc_id", shards)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
