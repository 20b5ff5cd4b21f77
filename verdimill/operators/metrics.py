"""Measures of scores against labels, and of two runs against each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..store import settle


def running_below(df: DataFrame, by: list[str], value: str, counts: str, name: str) -> DataFrame:
    """``df`` (a row for each value of a group) with the sum of ``counts`` over smaller values of the group.

    Rows are range-partitioned by group and value, so a large group takes many
    tasks; each range gets the sum of those before it from a table with a row for each group and range.
    """
    rows = settle(df.repartitionByRange(*by, value).withColumn("_range", F.spark_partition_id()))
    order = lambda *p: Window.partitionBy(*p).rowsBetween(Window.unboundedPreceding, -1)
    ranges = rows.groupBy(*by, "_range").agg(F.sum(counts).alias("_n"))
    ranges = ranges.select(*(F.col(c).alias(f"_by{i}") for i, c in enumerate(by)), F.col("_range").alias("_r"), F.coalesce(F.sum("_n").over(order(*by).orderBy("_range")), F.lit(0)).alias("_base"))
    at = F.col("_range") == F.col("_r")
    for i, c in enumerate(by):
        at = at & F.col(c).eqNullSafe(F.col(f"_by{i}"))
    inside = F.coalesce(F.sum(counts).over(order(*by, "_range").orderBy(value)), F.lit(0))
    return rows.withColumn("_inside", inside).join(ranges, at).withColumn(name, F.col("_inside") + F.col("_base")).select(*df.columns, name)


def average_ranks(df: DataFrame, value: str, by: list[str], name: str) -> DataFrame:
    """``df`` with the rank of ``value`` within ``by``, ties sharing their mean.

    Values are counted first; running counts go over distinct values.
    """
    n = running_below(df.groupBy(*by, value).agg(F.count("*").alias("_n")), by, value, "_n", "_below")
    return df.join(n.select(*by, value, (F.col("_below") + (F.col("_n") + 1) / 2).alias(name)), [*by, value])


def auc(df: DataFrame, score: str, label: str, by: list[str]) -> DataFrame:
    """by, auc, positives, negatives: by ranks, ties count half; null with one class only.

    Positives and negatives are counted for each value, so the rank sum comes
    from distinct values and not from rows.
    """
    n = df.groupBy(*by, score).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) != 1).alias("q"))
    n = running_below(n, by, score, "q", "below")
    s = n.groupBy(*by).agg(F.sum(F.col("p") * (F.col("below") + F.col("q") / 2)).alias("u"), F.sum("p").alias("positives"), F.sum("q").alias("negatives"))
    both = F.col("positives") * F.col("negatives")
    return s.select(*by, F.when(both > 0, F.col("u") / both).alias("auc"), "positives", "negatives")


def label_scores(scored: DataFrame, labels: DataFrame) -> DataFrame:
    """``scored`` (path, function and more) with the columns of the ``labels`` (suffix, name and more) that a path's end and a function's name match.

    ``name`` may be bare or qualified: it matches a function that is equal or
    ends in a dot and the name.  The join is on the bare name; a path matches a suffix at a slash.
    """
    bare = lambda c: F.element_at(F.split(c, "\\."), -1)
    s, l = scored.withColumn("_bare", bare(F.col("function"))), labels.withColumn("_name", bare(F.col("name")))
    both = s.join(l, F.col("_bare") == F.col("_name"))
    path = F.concat(F.lit("/"), "path").endswith(F.concat(F.lit("/"), "suffix"))
    return both.where(path & F.concat(F.lit("."), "function").endswith(F.concat(F.lit("."), "name"))).drop("_bare", "_name")


def bench_items(cases: DataFrame, labels: DataFrame, uses: DataFrame, helpers: DataFrame) -> DataFrame:
    """case, category, real, state for each case (case, path, content) that has a label (case, category, real).

    The state holds the case's source and those of the helpers (helper, content)
    that it uses (case, helper), by name; a case without helpers has none.
    """
    used = uses.distinct().join(helpers.withColumnRenamed("content", "h"), "helper")
    used = used.groupBy("case").agg(F.sort_array(F.collect_list(F.struct(F.col("helper").alias("path"), F.col("h").alias("content")))).alias("called"))
    rows = cases.join(labels, "case").join(used, "case", "left")
    state = F.to_json(F.struct("path", "content", F.when(F.size("called") > 0, F.col("called")).alias("called")))
    return rows.select("case", "category", "real", state.alias("state"))


def join_runs(one: DataFrame, other: DataFrame, value: str, on: tuple[str, ...] = ("source", "input")) -> DataFrame:
    """``on``, a, b: the values of two runs for what both have answered."""
    return one.select(*on, F.col(value).alias("a")).join(other.select(*on, F.col(value).alias("b")), list(on))


def rates(df: DataFrame, score: str, label: str, thresholds: list[float]) -> DataFrame:
    """threshold, tpr, fpr for each threshold, all in one pass."""
    p, q = F.count_if(F.col(label) == 1), F.count_if(F.col(label) != 1)
    cells = [(p.alias("p")), q.alias("q")]
    for i, t in enumerate(thresholds):
        cells += [F.count_if((F.col(label) == 1) & (F.col(score) >= t)).alias(f"tp{i}"), F.count_if((F.col(label) != 1) & (F.col(score) >= t)).alias(f"fp{i}")]
    one = df.agg(*cells)
    rows = [F.struct(F.lit(float(t)).alias("threshold"), (F.col(f"tp{i}") / F.col("p")).alias("tpr"), (F.col(f"fp{i}") / F.col("q")).alias("fpr")) for i, t in enumerate(thresholds)]
    return one.select(F.inline(F.array(*rows)))


def best_threshold(df: DataFrame, score: str, label: str) -> DataFrame:
    """The threshold of 0.05, 0.10, ..., 0.95 with the largest tpr - fpr, the smallest on ties."""
    r = rates(df, score, label, [round(0.05 * i, 2) for i in range(1, 20)])
    return r.withColumn("gain", F.col("tpr") - F.col("fpr")).orderBy(F.col("gain").desc(), "threshold").limit(1)


def spearman(df: DataFrame, a: str, b: str, by: list[str]) -> DataFrame:
    """by, spearman: the correlation of the average ranks."""
    r = average_ranks(average_ranks(df, a, by, "_ra"), b, by, "_rb")
    return r.groupBy(*by).agg(F.corr("_ra", "_rb").alias("spearman"))


def run_difference(df: DataFrame, a: str, b: str, large: float = 0.2) -> DataFrame:
    """One row: n, mean and largest absolute difference, how many exceed ``large``."""
    d = F.abs(F.col(a) - F.col(b))
    return df.agg(F.count("*").alias("n"), F.avg(d).alias("mean_diff"), F.max(d).alias("max_diff"), F.count_if(d > large).alias("n_large"))


def shared_top(df: DataFrame, a: str, b: str, key: str, k: int = 30) -> DataFrame:
    """One row: how many rows are among the k best by both scores."""
    best = lambda c: df.orderBy(F.col(c).desc(), key).limit(k).select(key)
    return best(a).intersect(best(b)).agg(F.count("*").alias("shared"))


def best_of(df: DataFrame, group: str, value: Column | str, columns: list[str]) -> DataFrame:
    """The row with the largest value of each group."""
    v = F.col(value) if isinstance(value, str) else value
    return df.groupBy(group).agg(F.max_by(F.struct(*columns), v).alias("_b")).select(group, *(F.col(f"_b.{c}").alias(c) for c in columns))


def skip_summary(skipped: DataFrame, reason: str, name: str) -> DataFrame:
    """reason, n, and the first three names."""
    ranked = skipped.withColumn("_r", F.row_number().over(Window.partitionBy(reason).orderBy(name))).where("_r <= 3")
    first = ranked.groupBy(reason).agg(F.array_join(F.sort_array(F.collect_list(name)), ", ").alias("first"))
    return skipped.groupBy(reason).agg(F.count("*").alias("n")).join(first, reason)
