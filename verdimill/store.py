"""Folders that the driver and all executors share."""

from __future__ import annotations

import re
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where a session on one machine names none a temporary folder is set, on a cluster that is an error."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = f"file://{tempfile.mkdtemp(prefix='shared-')}"
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(named)
    return named


def fresh_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    """Compute once and cut the lineage: what is read later is what was computed, even if executors are lost."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def hadoop(spark: SparkSession, path: str):
    """(file system, path) of any path that Spark can reach."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if it isn't there."""
    fs, p = hadoop(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def drop(spark: SparkSession, path: str) -> None:
    fs, p = hadoop(spark, path)
    fs.delete(p, True)


def rename(spark: SparkSession, path: str, to: str) -> None:
    fs, p = hadoop(spark, path)
    q = hadoop(spark, to)[1]
    if fs.exists(q) or not fs.rename(p, q):
        raise FileExistsError(to)


def create_new(spark: SparkSession, path: str) -> bool:
    """Make an empty file; False if it is there already."""
    fs, p = hadoop(spark, path)
    try:
        return bool(fs.createNewFile(p))
    except Exception:
        if fs.exists(p):
            return False
        raise


def age(spark: SparkSession, path: str) -> float | None:
    """Seconds since a file was written; None if it is gone."""
    fs, p = hadoop(spark, path)
    return time.time() - fs.getFileStatus(p).getModificationTime() / 1000 if fs.exists(p) else None


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Replace a file as a whole."""
    fs, p = hadoop(spark, path)
    aside = hadoop(spark, f"{path}.{uuid.uuid4().hex}")[1]
    out = fs.create(aside, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    if fs.exists(p):
        fs.delete(p, False)
    if not fs.rename(aside, p):
        raise OSError(f"can't write {path}")


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file's text; None if it isn't there."""
    fs, p = hadoop(spark, path)
    if not fs.exists(p):
        return None
    data = fs.open(p)
    try:
        return bytes(data.readAllBytes()).decode()
    finally:
        data.close()
