"""Mixing sources to target weights by prefix sums over hash-random keys (DataFrame operations only).

Each row gets a hash-random key, the MD5 of its id.  Within a source, rows are
sorted by key in two steps, so that no source has to fit into one task: the
leading hex digits of the key name a cell, cell totals give each cell's offset
(the distributed part of the prefix sum), and a window inside the cell gives
the rest.  The source's budget in words is cut from that order: whole epochs
first, then the rows up to the exact word at which the budget ends.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, settle

#: Hex digits of a key that name its cell: 16 ** 3 cells for each source.
CELL_DIGITS = 3
MAX_EPOCHS = 3


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def targets(sizes: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """source, source_size, target from (source, source_size), one row for each source.

    Weights 1, 2, 3 repeat over the sources in code-point order, null last.
    All sources share the total by weight; a share stops at ``max_epochs``
    times its source and the excess is shared anew by weight.  In the order of
    cap / weight the capped sources come first, so one running sum finds them.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    every = Window.partitionBy()
    w = F.element_at(F.array(*map(F.lit, (1, 2, 3))), (F.row_number().over(by_name) - 1) % 3 + 1).cast("long")
    t = sizes.withColumn("w", w).withColumn("cap", max_epochs * F.col("source_size"))
    before = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), F.col("source")).rowsBetween(Window.unboundedPreceding, -1)
    t = (
        t.withColumn("total", F.sum("source_size").over(every))
        .withColumn("rest", F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("rest_w", F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0)))
        .withColumn("capped", F.col("cap") * F.col("rest_w") <= F.col("rest") * F.col("w"))
        .withColumn("left", F.col("total") - F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0)).over(every))
        .withColumn("left_w", F.sum(F.when(F.col("capped"), 0).otherwise(F.col("w"))).over(every))
    )
    share = F.col("left").cast("double") * F.col("w") / F.col("left_w")
    return t.select("source", "source_size", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(share).alias("target"))


def _key() -> Column:
    return F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))


def take(rows: DataFrame, cells: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``rows`` (doc_id, source, _size, _cell and any others) with _source_size, _target and _taken.

    ``cells`` has the size of every source and cell: source, cell, cell_size.
    """
    to_cell = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cells.withColumn("offset", F.coalesce(F.sum("cell_size").over(to_cell), F.lit(0)))
    goal = targets(cells.groupBy("source").agg(F.sum("cell_size").alias("source_size")), max_epochs)
    goal = goal.withColumnRenamed("source", "g_source")
    offsets = offsets.join(goal, F.col("source").eqNullSafe(F.col("g_source"))).select(F.col("source").alias("_o_source"), F.col("cell").alias("_o_cell"), F.col("offset").alias("_offset"), F.col("source_size").alias("_source_size"), F.col("target").alias("_target"))
    in_cell = Window.partitionBy("source", "_cell").orderBy(_key(), "doc_id", "_size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_in_cell", F.coalesce(F.sum("_size").over(in_cell), F.lit(0)))
    both = rows.join(offsets, F.col("source").eqNullSafe(F.col("_o_source")) & (F.col("_cell") == F.col("_o_cell")))
    whole = F.when(F.col("_source_size") > 0, F.expr("floor(_target) div _source_size")).otherwise(0)
    part = F.floor(F.col("_target")) - whole * F.col("_source_size") - F.col("_offset") - F.col("_in_cell")
    taken = whole * F.col("_size") + F.least(F.col("_size"), F.greatest(F.lit(0), part))
    return both.withColumn("_taken", taken.cast("long")).drop("_o_source", "_o_cell", "_offset", "_in_cell")


def _cells(rows: DataFrame) -> DataFrame:
    return rows.groupBy("source", F.col("_cell").alias("cell")).agg(F.sum("_size").alias("cell_size"))


def mix(rows: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """doc_id, source, size -> doc_id, size, source_size, target, taken.

    taken counts the words that the mix takes of a row, repeats included: each
    source's sum is the whole part of its target, and no row exceeds
    ``max_epochs`` times its size.  Only the row on which the budget ends is
    taken in part.  A null source is a source of its own and comes last; a null
    doc_id has an empty key.  Rows with equal keys are ordered by doc_id and size.
    """
    rows = settle(rows.select("doc_id", "source", F.col("size").cast("long").alias("_size"), F.substring(_key(), 1, CELL_DIGITS).alias("_cell")))
    return take(rows, _cells(rows), max_epochs).select("doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), F.col("_taken").alias("taken"))


def repeat_to_targets(documents: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``documents`` as the mix takes them: whole rows once for each epoch; the row on which a
    source's budget ends is cut at that word in its last copy, and n_chars (if there) follows.

    Rows without words (null and empty texts too) are part of no budget and stay
    once.  A null source is a source of its own; repeated rows are taken each, in any
    order, and extra columns may have any name.
    """
    row = F.struct(*(F.col(f"`{c}`") for c in documents.columns)).alias("_row")  # so that no column's name can clash
    rows = documents.select("doc_id", "source", n_words(F.col("text")).alias("_size"), F.substring(_key(), 1, CELL_DIGITS).alias("_cell"), row)
    cells = settle(_cells(rows))  # at most 16 ** CELL_DIGITS rows for each source
    out = take(rows, cells, max_epochs)
    last = F.when(F.col("_size") > 0, F.col("_taken") % F.col("_size")).otherwise(0)
    copies = F.when(F.col("_size") > 0, F.ceil(F.col("_taken") / F.col("_size"))).otherwise(1)
    out = out.withColumns({"_last": last, "_copies": copies}).where("_copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))))
    cut = (F.col("_copy") == F.col("_copies")) & (F.col("_last") > 0)
    old = F.col("_row").getField
    start = F.array_join(F.slice(F.regexp_extract_all(old("text"), F.lit(rf"[\x20\x09-\x0D]*{WORD}"), F.lit(0)), F.lit(1), F.col("_last").cast("int")), "")
    new = {"text": F.when(cut, start).otherwise(old("text"))}
    if "n_chars" in documents.columns:
        new["n_chars"] = F.when(cut, F.length(start)).otherwise(old("n_chars")).cast(documents.schema["n_chars"].dataType)
    return out.select(*(new.get(c, old(c)).alias(c) for c in documents.columns))


def mix_documents(documents: DataFrame) -> DataFrame:
    """The mix of all ``documents``, sized in words: a null or empty text has none and takes none.  Nulls, ties and repeated rows as in ``mix``; other columns play no part."""
    return mix(documents.select("doc_id", "source", n_words(F.col("text")).alias("size")))


#: The same rows in DuckDB.
MIX_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '')) AS key
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, ((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::BIGINT AS w, 3 * source_size AS cap FROM s),
r AS (SELECT *, sum(source_size) OVER ()::BIGINT AS total,
        (sum(source_size) OVER () - coalesce(sum(cap) OVER before, 0))::BIGINT AS rest,
        (sum(w) OVER () - coalesce(sum(w) OVER before, 0))::BIGINT AS rest_w
      FROM w WINDOW before AS (ORDER BY cap / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, cap * rest_w <= rest * w AS capped FROM r),
t AS (SELECT source, source_size, CASE WHEN capped THEN cap::DOUBLE ELSE
        (total - sum(CASE WHEN capped THEN cap ELSE 0 END) OVER ())::BIGINT::DOUBLE * w / (sum(CASE WHEN capped THEN 0 ELSE w END) OVER ())::BIGINT END AS target
      FROM c),
p AS (SELECT d.doc_id, d.size, t.source_size, t.target, floor(t.target)::BIGINT AS budget,
        coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  (CASE WHEN source_size > 0 THEN (budget // source_size) * size + least(size, greatest(0, budget % source_size - before)) ELSE 0 END)::BIGINT AS taken
FROM p
"""
