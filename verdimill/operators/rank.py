"""Ranking by observed probabilities, pairwise comparison and budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dist
from ..store import settle


def check_observations(df: DataFrame, noul: str = "noul") -> DataFrame:
    """``df``, failing on a probability that is missing, not finite or outside [0, 1]."""
    p = F.col(noul)
    bad = ~F.coalesce(dist.in_unit(p, 0.0), F.lit(False))
    return df.withColumn(noul, F.when(bad, F.raise_error(F.lit("observation must be finite and in [0,1]")).cast("double")).otherwise(p))


def rerank(items: DataFrame, value: str, secondary: str, index: str) -> DataFrame:
    """``items`` with position (from 1): value descending, then the secondary key, then the index.

    Positions are exact and global without one task for all rows: rows are
    range-partitioned in rank order, counted by partition, and numbered within it.
    """
    order = [F.col(value).desc(), F.col(secondary), F.col(index)]
    return number_rows(items, order, "position")


def number_rows(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Row numbers from 1 in a total order, by range partitions and their counts."""
    from_range = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    rows = from_range.withColumns({"_part": F.shiftright("_id", 33), "_pos": F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))})
    rows = settle(rows)  # numbers stay as they are if executors are lost
    counts = rows.groupBy("_part").count()
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(F.col("_part").alias("_p"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_base"))
    out = rows.join(F.broadcast(counts), F.col("_part") == F.col("_p"))  # one row for each partition
    return out.withColumn(name, F.col("_base") + F.col("_pos") + 1).drop("_id", "_part", "_pos", "_p", "_base")


def select_under_budget(ranked: DataFrame, position: str, size: str, allowance: int, digits: int = 4096) -> DataFrame:
    """The longest prefix of a ranking whose sizes fit; ``used`` is the running sum.

    The sum is built from blocks of ``digits`` positions, so no task sees the
    whole ranking.  Sizes are non-negative; the first misfit ends the prefix.
    """
    rows = ranked.withColumn("_block", F.floor((F.col(position) - 1) / digits))
    blocks = rows.groupBy("_block").agg(F.sum(size).alias("_sum"))
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(F.col("_block").alias("_b"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    running = F.sum(size).over(Window.partitionBy("_block").orderBy(position).rowsBetween(Window.unboundedPreceding, 0))
    out = rows.withColumn("_run", running).join(blocks.where(F.col("_base") <= allowance), F.col("_block") == F.col("_b"))
    return out.withColumn("used", (F.col("_base") + F.col("_run")).cast("long")).where(F.col("used") <= allowance).drop("_block", "_b", "_base", "_run")


def first_excluded(ranked: DataFrame, selected: DataFrame, position: str) -> DataFrame:
    """One row: the position of the first row that did not fit, null if all did."""
    n = selected.agg(F.coalesce(F.max(position), F.lit(0)).alias("m"))
    return ranked.agg(F.max(position).alias("last")).join(n).select(F.when(F.col("m") < F.col("last"), F.col("m") + 1).alias("first_excluded"))


def all_pairs(items: DataFrame, index: str) -> DataFrame:
    """Every unordered pair of a candidate list once (first < second): the feature of a pairwise sort."""
    a = items.select(F.col(index).alias("first"))
    b = items.select(F.col(index).alias("second"))
    return a.join(b, F.col("first") < F.col("second"))


def normalize_pairs(pairs: DataFrame) -> DataFrame:
    """first < second, with p the probability that first wins."""
    p = F.when(F.col("first") < F.col("second"), F.col("noul")).otherwise(1 - F.col("noul"))
    return pairs.select(F.least("first", "second").alias("first"), F.greatest("first", "second").alias("second"), p.alias("noul"))


def missing_pairs(items: DataFrame, index: str, pairs: DataFrame) -> DataFrame:
    seen = normalize_pairs(pairs).select("first", "second")
    return all_pairs(items, index).join(seen, ["first", "second"], "left_anti")


def duplicate_pairs(pairs: DataFrame) -> DataFrame:
    return normalize_pairs(pairs).groupBy("first", "second").count().where("count > 1")


def pairwise_values(pairs: DataFrame, index: str = "index") -> DataFrame:
    """Expected wins of every item: p for the first of a pair, 1 - p for the second."""
    wins = pairs.select(F.col("first").alias(index), F.col("noul").alias("p")).unionByName(pairs.select(F.col("second").alias(index), (1 - F.col("noul")).alias("p")))
    return wins.groupBy(index).agg(F.sum("p").alias("value"), F.count("*").alias("support"))


def preference_edges(pairs: DataFrame) -> DataFrame:
    """winner, loser for each pair with a majority."""
    p = F.col("noul")
    return pairs.where(p != 0.5).select(F.when(p > 0.5, F.col("first")).otherwise(F.col("second")).alias("src"), F.when(p > 0.5, F.col("second")).otherwise(F.col("first")).alias("dst"))


def has_cycle(edges: DataFrame) -> bool:
    """Whether a directed graph (src, dst) has a cycle; a loop is one.

    If every two nodes are joined by one edge, as in a full pairwise sort, the
    numbers of wins tell: without a cycle they are all different.  Otherwise nodes
    without edges coming in, or going out, are peeled off until nothing changes.
    """
    e = settle(edges.select("src", "dst").distinct())
    wins = e.select(F.col("src").alias("node"), F.lit(1).alias("w")).unionByName(e.select(F.col("dst").alias("node"), F.lit(0).alias("w"))).groupBy("node").agg(F.sum("w").alias("wins"))
    n = wins.agg(F.count("*").alias("nodes"), F.count_distinct("wins").alias("different")).first()
    pairs = e.select(F.least("src", "dst").alias("x"), F.greatest("src", "dst").alias("y")).where("x <> y").distinct().count()
    left = e.count()
    if not left or pairs == left == n.nodes * (n.nodes - 1) // 2:
        return bool(left) and n.different < n.nodes
    while left:
        e = settle(e.join(e.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(e.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi"))
        now = e.count()
        if now == left:
            return True
        left = now
    return False


def provenance(observations: DataFrame) -> DataFrame:
    """One row: sorted known models, and whether a model or a question is unknown."""
    known = F.when(F.coalesce("model", F.lit("")) != "", F.col("model"))
    return observations.agg(F.sort_array(F.collect_set(known)).alias("models"), F.bool_or(known.isNull()).alias("unknown_model"), F.bool_or(F.coalesce("question_key", F.lit("")) == "").alias("unknown_question"))


def pair_count(n: Column) -> Column:
    return (n.cast("decimal(38,0)") * (n - 1) / 2).cast("long")


def positions_of(ranked: DataFrame, labels: DataFrame, position: str, on: list[str]) -> DataFrame:
    """``labels`` with the position of each in a ranking and its percentile: the share of rows at or before it; null if it is not ranked."""
    n = ranked.agg(F.count("*").alias("_n"))
    return labels.join(ranked.select(*on, position), on, "left").join(n).withColumn("percentile", F.col(position) / F.col("_n")).drop("_n")  # one row
