import hashlib
import re

import pytest

from verdimill.llm import warc
from verdimill.llm.common import fresh_dir
from verdimill.llm.warc import archive_round_trip, read_archive, write_archive


def want(rows):
    last = {}
    for i, _, h in rows:
        b = (h or "").encode()
        if len(b) >= 1000 and i is not None:
            last[b] = max(last.get(b, i), i)
    count = {}
    for _, _, h in rows:
        count[(h or "").encode()] = count.get((h or "").encode(), 0) + 1
    out = []
    for i, _, h in rows:
        b = (h or "").encode()
        again = len(b) >= 1000 and count[b] > 1 and b in last and last[b] != i
        out.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", last[b] if again else None))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in archive_round_trip(df).collect()), key=str)


FAKE = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:999>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
ROWS = [
    (1, "http://a/", "<p>é</p>"),
    (2, "http://b/\r\nX: y", None),
    (3, None, ""),
    (4, "u", "x" * 1200),
    (5, "u", "x" * 1200),
    (6, "u", "x" * 1200),
    (7, "u", "y" * 999),
    (8, "u", "y" * 999),
    (None, "u", "x" * 1200),
    (9, "u", f"before {FAKE}{FAKE} after WARC/1.0\r\n and WARC/1."),
    (10, "u", FAKE),
    (11, "u", "\r\n\r\nWARC/1.0\r\nContent-Length: 99999999999999999999\r\n\r\n"),
    (12, "u", f"{FAKE}" + "z" * 2000),
    (13, "u", f"{FAKE}" + "z" * 2000),
    (1, "http://a/", "<p>é</p>"),
]


@pytest.mark.parametrize("split", ["128m", "300"])
@pytest.mark.parametrize("parts", [1, 3])
def test_round_trip(spark, split, parts):
    df = spark.createDataFrame(ROWS, "page_id long, url string, html string").repartition(parts)
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "10")
    try:
        assert got(df.selectExpr("*", "1 AS payload", "2 AS digest")) == want(ROWS)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_large_lists_are_shuffled(spark, monkeypatch):
    monkeypatch.setattr(warc, "SMALL_ROWS", 0)
    assert got(spark.createDataFrame(ROWS, "page_id long, url string, html string")) == want(ROWS)


def test_pages(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    assert got(pages) == want([(r.page_id, r.url, r.html) for r in pages.collect()])


def test_empty(spark):
    assert got(spark.createDataFrame([], "page_id long, url string, html string")) == []


def test_file_is_plain_warc(spark):
    path = fresh_dir(spark, "plain")
    write_archive(spark.createDataFrame([(1, "u", "ab"), (2, "u", "cd")], "page_id long, url string, html string").coalesce(1), path)
    text = "".join(r.value for r in spark.read.text(path, wholetext=True).collect())
    assert re.fullmatch(r"(WARC/1\.1\r\n(?:[\w-]+: [^\r\n]*\r\n)+\r\n(ab|cd)\r\n\r\n){2}", text)


def test_damage_is_noticed(spark):
    path = fresh_dir(spark, "bad")
    good = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:1>\r\nWARC-Payload-Digest: sha1:{hashlib.sha1(b'abc').hexdigest()}\r\nContent-Length: 3\r\n\r\n"
    spark.createDataFrame([(good + "abX",)], "value string").write.option("lineSep", "\r\n\r\n").text(path)
    with pytest.raises(Exception, match="differs from its digest"):
        read_archive(spark, path).collect()
