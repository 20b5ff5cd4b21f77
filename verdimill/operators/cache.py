"""The answer cache: content keys, lookups as joins, newest answer wins."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import store
from ..functions.text import content_key, framed
from ..schemas import ANSWER

ENTRY = f"key string, version string, time_ns long, answer {ANSWER}, segment_seq int"
#: Segments of a cache folder before they are merged.
MAX_SEGMENTS = 32


@dataclass(frozen=True)
class Source:
    """Who answers: provider, address and model name."""

    provider: str
    address: str = ""
    model: str = ""

    def id(self) -> Column:
        return content_key(*map(F.lit, ("source", self.provider, self.address, self.model)))


def item_id(state: Column, content_type: Column | None = None, content: Column | None = None) -> Column:
    """32 bytes of an item: its state and, for media, type and content."""
    e = F.lit("")
    return F.unhex(F.sha2(framed(F.lit("item"), state, content_type if content_type is not None else e, content if content is not None else e), 256))


def answer_key(source: Source, item: Column, question: Column, encoded: Column) -> Column:
    """The key of one answer: 16 bytes in hex."""
    return content_key(F.lit("answer"), F.lit(source.provider), F.lit(source.address), F.lit(source.model), item, question, encoded)


def newest(entries: DataFrame) -> DataFrame:
    """One entry for each key: the newest, among equal times that of the later segment."""
    others = [c for c in entries.columns if c != "key"]
    order = F.struct("time_ns", "segment_seq")
    return entries.groupBy("key").agg(F.max_by(F.struct(*others), order).alias("e")).select("key", *(F.col(f"e.{c}").alias(c) for c in others))


def latest_version(entries: DataFrame) -> DataFrame:
    """One row: the newest known model version, empty if none is known."""
    return entries.where("coalesce(version, '') <> ''").agg(F.coalesce(F.max_by("version", F.struct("time_ns", "segment_seq")), F.lit("")).alias("latest"))


def usable(entries: DataFrame) -> DataFrame:
    """Newest entries whose version is unknown, or the latest known one."""
    one = latest_version(entries)
    return newest(entries).join(F.broadcast(one)).where((F.coalesce("version", F.lit("")) == "") | (F.col("latest") == "") | (F.col("version") == F.col("latest"))).drop("latest")  # one row


def hits(requests: DataFrame, entries: DataFrame) -> DataFrame:
    """Requests that the cache answers, with the answer."""
    return requests.join(usable(entries).select("key", "answer"), "key")


def to_ask(requests: DataFrame, entries: DataFrame) -> DataFrame:
    """Requests that the cache does not answer."""
    return requests.join(usable(entries).select("key"), "key", "left_anti")


def stale(requests: DataFrame, entries: DataFrame) -> DataFrame:
    """Requests whose only answers are of an older model version: the second round after a version changed."""
    return requests.join(newest(entries).select("key"), "key", "left_semi").join(usable(entries).select("key"), "key", "left_anti")


def entries(spark: SparkSession, path: str) -> DataFrame:
    """All entries of a cache folder: key, version, time_ns, answer and the number of their segment; none if the folder is new."""
    if _segments(spark, path):
        return spark.read.schema(ENTRY).parquet(path)
    return spark.createDataFrame([], ENTRY)


def _segments(spark: SparkSession, path: str) -> list[int]:
    return sorted(int(n.partition("=")[2]) for n in store.names(spark, path) if n.startswith("segment_seq="))


def append(new: DataFrame, path: str) -> int:
    """Add a segment of entries (key, version, time_ns, answer); earlier ones stay as they are.  Returns its number.

    A segment is written aside and renamed, so readers never see a part of it; of two writers the later takes the next number.
    """
    spark = new.sparkSession
    aside = f"{path.rstrip('/')}/_new-{uuid.uuid4().hex}"
    new.select("key", "version", "time_ns", "answer").write.parquet(aside)
    while True:
        n = max(_segments(spark, path), default=0) + 1
        fs, to = store.hadoop(spark, f"{path.rstrip('/')}/segment_seq={n}")
        if not fs.exists(to) and fs.rename(store.hadoop(spark, aside)[1], to):
            return n


def compact(spark: SparkSession, path: str, most: int = MAX_SEGMENTS) -> bool:
    """If there are more than ``most`` segments: one with the newest entry of each key takes their place.

    The old ones go after the new one is there; until then, and after a stop in
    between, entries are only repeated, and the newest wins.  Repeating it changes nothing.
    """
    old = _segments(spark, path)
    if len(old) <= most:
        return False
    append(newest(entries(spark, path).where(F.col("segment_seq") <= old[-1])), path)
    for n in old:
        store.drop(spark, f"{path.rstrip('/')}/segment_seq={n}")
    return True
