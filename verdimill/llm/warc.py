"""Writing and reading WARC archives, with boundary-chain verification.

Archives are written by Spark's text writer, whose line separator is the two
line ends that close a record, so they go wherever Spark can write.  They are
read by the text reader with the record magic as separator: large files are
split among tasks, and every piece behind a magic is a candidate record.  A
candidate's header gives the offset of its successor.  Only what a chain from
the start of the file reaches is a record; a magic inside a payload is
not reached.  Chains are followed inside each block first, which leaves one
pointer per candidate out of its block; pointer jumping (doubling) then finds the
entry of every block in a logarithmic number of rounds.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import drop_dir, fresh_dir, settle

# Fixed values of the WARC format.
MAGIC, VERSION, END = "WARC/1.", "WARC/1.1", "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payloads of at least so many bytes are stored once.
REVISIT_BYTES = 1000
#: Tables of at most so many narrow rows are broadcast; larger ones are joined by shuffle.
SMALL_ROWS = 50_000
_STEP = len(MAGIC)


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= SMALL_ROWS else df


def _one_line(c: Column) -> Column:
    return F.regexp_replace(c, "[\\r\\n]+", " ")


def write_archive(pages: DataFrame, path: str, date: str = "2000-01-01T00:00:00Z") -> None:
    """One record for each row of ``pages`` (page_id, url, html) below ``path``.

    Of rows with equal payloads of at least REVISIT_BYTES, those with the
    largest page_id are responses and the others revisits of it.  A null html
    is an empty payload; a null page_id counts as smaller than any other.
    """
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", "url", payload.alias("payload"), F.octet_length(payload).cast("long").alias("bytes"), F.sha1(payload.cast("binary")).alias("digest"))
    copies = rows.where(F.col("bytes") >= REVISIT_BYTES).groupBy("digest", "bytes").agg(F.count("*").alias("n"), F.max("page_id").alias("last")).where("n > 1 AND last IS NOT NULL")
    copies = settle(copies.select(F.col("digest").alias("c_digest"), F.col("bytes").alias("c_bytes"), "last"))
    rows = rows.join(_small(copies, copies.count()), (F.col("digest") == F.col("c_digest")) & (F.col("bytes") == F.col("c_bytes")), "left")
    again = F.col("last").isNotNull() & ~F.coalesce(F.col("page_id") == F.col("last"), F.lit(False))

    def urn(c: str) -> Column:
        return F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("null")), F.lit(">"))

    head = F.concat_ws(
        "\r\n",
        F.lit(VERSION),
        F.concat(F.lit("WARC-Type: "), F.when(again, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), urn("page_id")),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), _one_line(F.col("url"))),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
        F.concat(F.lit("WARC-Payload-Length: "), F.col("bytes")),
        F.when(again, F.concat(F.lit("WARC-Refers-To: "), urn("last"))),
        F.when(again, F.lit(f"WARC-Profile: {PROFILE}")),
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("Content-Length: "), F.when(again, F.lit(0)).otherwise(F.col("bytes"))),
    )
    record = F.concat(head, F.lit(END), F.when(again, F.lit("")).otherwise(F.col("payload")))
    rows.select(record.alias("value")).write.option("lineSep", END).text(path)


def _field(name: str) -> Column:
    return F.nullif(F.regexp_extract("head", rf"(?i)\r\n{name}:[ \t]*([^\r\n]*)", 1), F.lit(""))


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """Everything between two magics: value, file, block (start of the split) and at (order of reading)."""
    raw = spark.read.option("lineSep", MAGIC).text(path)
    return raw.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))


def _exits(block: pd.DataFrame) -> pd.DataFrame:
    """For each candidate of one block, where its chain leaves the block; -1 if it breaks."""
    block = block.sort_values("off")
    off, to = block["off"].to_numpy(), block["next"].to_numpy()
    place = {int(x): i for i, x in enumerate(off)}
    last = off[-1] if len(off) else -1
    out = np.full(len(off), -1, np.int64)
    for i in range(len(off) - 1, -1, -1):
        n = int(to[i])
        if n in place and n > off[i]:
            out[i] = out[place[n]]
        elif n > last:
            out[i] = n
    return pd.DataFrame({"file": block["file"], "off": off, "exit": out})


def _chain(key: tuple, block: pd.DataFrame, entries: pd.DataFrame) -> pd.DataFrame:
    """The candidates of one block that its entries reach."""
    to = dict(zip(block["off"].tolist(), block["next"].tolist(), strict=True))
    found: set[int] = set()
    for x in entries["e_off"].tolist():
        while x in to and x not in found:
            found.add(x)
            x = to[x]
    return pd.DataFrame({"r_file": pd.Series([key[0]] * len(found), dtype=object), "r_off": pd.Series(sorted(found), dtype="int64")})


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """record_id, record_type, url, payload_bytes, payload_digest, refers_to for every record below ``path``.

    The digest of a response is computed from the payload that was read and
    must equal its header's; a revisit's comes from its header.  A file that does not
    start with a record has none.  Magics within payloads, whole records in them included, are no records.
    """
    raw = _pieces(spark, path)
    head = F.substring_index("value", END, 1)
    body = F.octet_length("head") + len(END)
    rows = raw.select("file", "block", "at", F.octet_length("value").cast("long").alias("len"), F.when(F.col("value").contains(END) & F.col("value").rlike(r"^\d\r\n"), head).alias("head"), F.col("value").cast("binary").alias("raw"))
    rows = rows.withColumn("size", _field("Content-Length").try_cast("long"))
    whole = F.coalesce(body + F.col("size") + len(END) == F.col("len"), F.lit(False))
    sha = F.when(whole, F.sha1(F.expr(f"substring(raw, octet_length(head) + {len(END) + 1}, int(size))")))
    rows = settle(rows.select("file", "block", "at", "len", "head", "size", whole.alias("whole"), sha.alias("sha")))

    # Offsets: sums within a block, and sums of blocks within a file.
    in_block = Window.partitionBy("file", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    of_blocks = Window.partitionBy("b_file").orderBy("b_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy(F.col("file").alias("b_file"), F.col("block").alias("b_block")).agg(F.sum(F.col("len") + _STEP).alias("n"))
    blocks = blocks.select("b_file", "b_block", F.coalesce(F.sum("n").over(of_blocks), F.lit(0)).alias("base"))
    start = F.col("base") + F.coalesce(F.sum(F.col("len") + _STEP).over(in_block), F.lit(0)) - _STEP
    placed = rows.join(blocks, (F.col("file") == F.col("b_file")) & (F.col("block") == F.col("b_block"))).withColumn("off", start).where("off >= 0")
    placed = settle(placed.withColumn("next", F.col("off") + _STEP + body + F.col("size") + len(END)).drop("b_file", "b_block", "base"))

    # Boundary chains.
    cand = placed.where("next IS NOT NULL").select("file", "block", "off", "next")
    jump = settle(cand.groupBy("file", "block").applyInPandas(_exits, "file string, off long, exit long").where("exit >= 0"))
    seen = settle(cand.where("off = 0").select("file", "off"))
    count = seen.count()
    while True:
        to = jump.select(F.col("file").alias("j_file"), F.col("off").alias("j_off"), F.col("exit").alias("j_exit"))
        more = seen.join(to, (F.col("file") == F.col("j_file")) & (F.col("off") == F.col("j_off"))).select("file", F.col("j_exit").alias("off"))
        seen = settle(seen.unionByName(more).distinct())
        now = seen.count()
        if now == count:
            break
        count = now
        jump = settle(jump.join(to, (F.col("file") == F.col("j_file")) & (F.col("exit") == F.col("j_off")), "left").select("file", "off", F.coalesce("j_exit", "exit").alias("exit")))
    entries = seen.join(cand.select(F.col("file").alias("c_file"), "block", F.col("off").alias("c_off")), (F.col("file") == F.col("c_file")) & (F.col("off") == F.col("c_off"))).select(F.col("c_file").alias("e_file"), F.col("block").alias("e_block"), F.col("c_off").alias("e_off"))
    reached = cand.groupBy("file", "block").cogroup(entries.groupBy("e_file", "e_block")).applyInPandas(_chain, "r_file string, r_off long")
    marked = placed.join(reached, (F.col("file") == F.col("r_file")) & (F.col("off") == F.col("r_off")), "left").withColumn("real", F.col("r_off").isNotNull()).drop("r_file", "r_off")
    # The record that each piece belongs to: the last one in its block so far, or else in the blocks before.
    so_far = Window.partitionBy("file", "block").orderBy("off").rowsBetween(Window.unboundedPreceding, 0)
    real = F.when(F.col("real"), F.col("off"))
    lasts = marked.groupBy(F.col("file").alias("l_file"), F.col("block").alias("l_block")).agg(F.max(real).alias("last"))
    lasts = lasts.select("l_file", "l_block", F.max("last").over(Window.partitionBy("l_file").orderBy("l_block").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    marked = marked.withColumn("in_block", F.max(real).over(so_far)).join(lasts, (F.col("file") == F.col("l_file")) & (F.col("block") == F.col("l_block")))
    marked = settle(marked.withColumn("record", F.coalesce("in_block", "carried")).drop("in_block", "l_file", "l_block", "carried"))
    records = marked.where("real")

    # Records whose payload holds a magic came in several pieces: read these again and join them.
    broken = records.where("NOT whole").select(F.col("file").alias("k_file"), F.col("off").alias("k_off"))
    parts = settle(marked.join(broken, (F.col("file") == F.col("k_file")) & (F.col("record") == F.col("k_off"))).select(F.col("file").alias("p_file"), F.col("block").alias("p_block"), F.col("at").alias("p_at"), "off", "record"))
    n = parts.count()
    sha = F.col("sha")
    if n:
        joined = _pieces(spark, path).join(_small(parts, n), (F.col("file") == F.col("p_file")) & (F.col("block") == F.col("p_block")) & (F.col("at") == F.col("p_at")))
        joined = joined.groupBy("file", "record").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("off", "value"))), lambda x: x["value"]), MAGIC).alias("text"))
        joined = joined.select(F.col("file").alias("t_file"), F.col("record").alias("t_off"), F.col("text").cast("binary").alias("bytes"))
        records = records.join(joined, (F.col("file") == F.col("t_file")) & (F.col("off") == F.col("t_off")), "left")
        sha = F.coalesce(F.col("sha"), F.sha1(F.expr(f"substring(bytes, octet_length(head) + {len(END) + 1}, int(size))")))
    kind = _field("WARC-Type")
    stated = F.regexp_replace(_field("WARC-Payload-Digest"), "^sha1:", "")
    digest = F.when(kind == "revisit", stated).when(stated.isNull() | (stated == sha), sha).otherwise(F.raise_error(F.concat(F.lit("payload differs from its digest: "), _field("WARC-Record-ID"))))
    length = F.when(kind == "revisit", _field("WARC-Payload-Length").cast("long")).otherwise(F.col("size"))
    return records.select(_field("WARC-Record-ID").alias("record_id"), kind.alias("record_type"), _field("WARC-Target-URI").alias("url"), length.alias("payload_bytes"), digest.alias("payload_digest"), _field("WARC-Refers-To").alias("refers_to"))


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of all ``pages`` as read back from an archive in the shared folder."""
    spark = pages.sparkSession
    path = fresh_dir(spark, "warc")
    write_archive(pages, path)
    page = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")
    out = settle(read_archive(spark, path).select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to")))
    drop_dir(spark, path)
    return out


#: The same rows in DuckDB, from the pages themselves.
WARC_SQL = f"""
WITH d AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest,
         max(page_id) OVER (PARTITION BY coalesce(html, '')) AS last
  FROM pages),
r AS (SELECT *, payload_bytes >= {REVISIT_BYTES} AND page_id IS DISTINCT FROM last AND last IS NOT NULL AS again FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN last END AS refers_to
FROM r
"""
