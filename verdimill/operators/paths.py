"""Call graphs: sinks, forwarders and bounded paths, over edges (caller, callee)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..store import settle


def reaches(edges: DataFrame, sinks: DataFrame, depth: int) -> DataFrame:
    """node, distance, chain: functions from which a sink is reached in at most ``depth`` calls, with one shortest chain, least by name."""
    found = settle(sinks.select(F.col("node"), F.lit(0).alias("distance"), F.array("node").alias("chain")).distinct())
    front = found
    for d in range(1, depth + 1):
        step = edges.join(front, edges["callee"] == front["node"]).select(F.col("caller").alias("node"), F.lit(d).alias("distance"), F.concat(F.array("caller"), "chain").alias("chain"))
        step = step.groupBy("node", "distance").agg(F.min("chain").alias("chain")).join(found.select("node"), "node", "left_anti")
        front = settle(step)
        if front.isEmpty():
            break
        found = settle(found.unionByName(front))
    return found


def forwarders(sinks: DataFrame, forwards: DataFrame) -> DataFrame:
    """Sinks and all functions that hand one of their parameters to a sink: a fixed point over forwards (caller, callee)."""
    found = settle(sinks.select("node").distinct())
    n = found.count()
    while True:
        more = forwards.join(found, forwards["callee"] == found["node"], "left_semi").select(F.col("caller").alias("node"))
        found = settle(found.unionByName(more).distinct())
        now = found.count()
        if now == n:
            return found
        n = now


def sink_sites(calls: DataFrame, sinks: DataFrame) -> DataFrame:
    """Calls (caller, callee, line, n_inputs, n_constant, n_forwarded) of sinks with an input that is neither constant nor a forwarded parameter."""
    return calls.join(sinks.select(F.col("node").alias("callee")).distinct(), "callee", "left_semi").where("n_inputs > n_constant AND n_inputs > n_forwarded")


def bounded_paths(edges: DataFrame, sites: DataFrame, entries: DataFrame, depth: int, keep: int) -> DataFrame:
    """site, path, length: up to ``keep`` paths to each site from distinct entries, shortest first; a node is visited once for each site."""
    front = settle(sites.select("site", F.col("node"), F.array("node").alias("path")))
    seen, done = front.select("site", "node"), None
    ends = entries.select(F.col("node").alias("e")).distinct()
    for d in range(depth + 1):
        hit = front.join(ends, front["node"] == ends["e"], "left_semi").select("site", "path", F.lit(d).alias("length"))
        done = hit if done is None else done.unionByName(hit)
        if d == depth:
            break
        step = edges.join(front, edges["callee"] == front["node"]).select("site", F.col("caller").alias("node"), F.concat(F.array("caller"), "path").alias("path"))
        step = step.groupBy("site", "node").agg(F.min("path").alias("path")).join(seen, ["site", "node"], "left_anti")
        front = settle(step)
        if front.isEmpty():
            break
        seen = settle(seen.unionByName(front.select("site", "node")))
    w = Window.partitionBy("site").orderBy("length", "path")
    return done.withColumn("r", F.row_number().over(w)).where(F.col("r") <= keep).drop("r")


def to_outermost(paths: DataFrame, edges: DataFrame, entries: DataFrame, depth: int) -> DataFrame:
    """site, path: each path extended upward, over calls (caller, callee), to the farthest entry within ``depth`` calls.

    The path of a site stays as it is if no entry is above it; among entries equally far the least chain wins.
    A function that is on the path already is not entered again.
    """
    ends = entries.select(F.col("node").alias("e")).distinct()
    up = settle(paths.select("site", "path", F.col("path").alias("whole")))
    found = up.select("site", "path", "whole", F.lit(0).alias("d"))
    for d in range(1, depth + 1):
        up = edges.join(up, F.col("callee") == F.element_at("whole", 1)).where(~F.array_contains("whole", F.col("caller")))
        up = up.groupBy("site", "path", "caller").agg(F.min("whole").alias("w")).select("site", "path", F.concat(F.array("caller"), "w").alias("whole"))
        up = settle(up)
        if up.isEmpty():
            break
        found = found.unionByName(up.join(ends, F.element_at("whole", 1) == F.col("e"), "left_semi").withColumn("d", F.lit(d)))
    far = found.groupBy("site", "path").agg(F.max("d").alias("far"))
    return found.join(far, ["site", "path"]).where("d = far").groupBy("site", "path").agg(F.min("whole").alias("w")).select("site", F.col("w").alias("path"))


def entry_points(functions: DataFrame, request_types: list[str]) -> DataFrame:
    """node of each function (node, parameters array, embeds array) that takes a request type, or a type that embeds one."""
    wanted = F.array(*map(F.lit, request_types))
    bare = lambda c: F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda t: F.regexp_replace(t, r"^[*&\\[\\]. ]+", ""))
    return functions.where(F.arrays_overlap(bare(F.col("parameters")), wanted) | F.arrays_overlap(bare(F.col("embeds")), wanted)).select("node").distinct()


def render_path(functions: list[str], budget: int) -> str | None:
    """Sources of a path under a byte budget: middle functions are shortened first, then the last, then the first; None if it still does not fit."""
    texts = list(functions)
    order = [*range(1, len(texts) - 1), *([len(texts) - 1] if len(texts) > 1 else []), 0]
    size = lambda: len("\n\n".join(texts).encode())
    for i in order:
        if size() <= budget:
            break
        head = texts[i].split("\n", 1)[0]
        texts[i] = f"{head}\n    ..."
    return "\n\n".join(texts) if texts and size() <= budget else None
