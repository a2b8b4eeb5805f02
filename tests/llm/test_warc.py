import base64
import glob
import hashlib

import pytest

from presslink.llm import catalog, warc

SCHEMA = "page_id long, url string, html string, digest string, file string"


def expected(rows):
    first = {}
    for r in rows:
        if r[0] is not None:
            key = (r[2] or "").encode()
            first[key] = min(first.get(key, r[0]), r[0])
    out = []
    for r in rows:
        b = (r[2] or "").encode()
        f = first.get(b)
        same = f is None or r[0] == f
        out.append((r[0], len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if same else "revisit",
                    None if same else f))
    return sorted(out, key=str)


def rows():
    fake = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    texts = ["", None, "plain", "a WARC/1.0 inside", fake, fake + fake, "x" + fake, fake + "WARC/1.", "é中" * 50,
             "plain", "big " * 30_000, "WARC/1.WARC/1.", "\r\n\r\n", "end\r\n\r\nWARC/1.1\r\nContent-Length: 99999\r\n\r\nz"]
    data = [(i, f"http://h/{i}" if i % 3 else None, t, "x", "y") for i, t in enumerate(texts)]
    data += [(100 + i, "u\r\nX: 1", "hot page", "x", "y") for i in range(60)]
    data += [(100, "again", "hot page", "x", "y"), (None, "n", "only null id", "x", "y")]
    return data


@pytest.mark.parametrize("split", ["700", "5000", "128m"])
def test_round_trip_any_split(spark, split, tmp_path):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        df = spark.createDataFrame(rows(), SCHEMA).repartition(2)
        got = warc.page_digests(df, str(tmp_path / "w")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sorted(map(tuple, got), key=str) == expected(rows())


def test_archive_is_plain_warc(spark, tmp_path):
    warc.write_archive(spark.createDataFrame(rows(), SCHEMA).coalesce(1), str(tmp_path / "w"), "page_id", "url", "html")
    blob = b"".join(open(f, "rb").read() for f in sorted(glob.glob(str(tmp_path / "w" / "part-*"))))
    at = n = 0
    while at < len(blob):                        # a sequential reader finds the same records
        head, _, _ = blob[at:].partition(b"\r\n\r\n")
        assert head.startswith(b"WARC/1.1\r\n")
        size = next(int(x.split(b":")[1]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length"))
        at += len(head) + 4 + size + 4
        n += 1
    assert at == len(blob) and n == len(rows())


def test_empty_table(spark):
    assert warc.page_digests(spark.createDataFrame([], SCHEMA)).collect() == []


def test_small_payloads_stay_responses_below_the_bound(spark):
    df = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcdef"), (4, "u", "abcdef")],
                               "page_id long, url string, html string")
    got = {r.page_id: r.record_type for r in warc.page_digests(df, min_bytes=3).collect()}
    assert got == {1: "response", 2: "response", 3: "response", 4: "revisit"}


def test_registered():
    assert "op1_warc" in catalog.QUERIES and "op1_warc" in catalog.ORACLES


@pytest.mark.parametrize("url", ["http://h/" + "u" * 70_000, "http://h/WARC/1.1/x?WARC/1.", "WARC/1.1\r\nWARC/1.0\r\n\r\n"])
def test_any_url_keeps_its_record_and_those_after_it(spark, url, tmp_path):
    data = [(i, url if i in (1, 3) else f"http://h/{i}", t, "x", "y") for i, t in enumerate(["a", "b", "c", "b", "d"])]
    df = spark.createDataFrame(data, SCHEMA).coalesce(1)
    assert sorted(map(tuple, warc.page_digests(df, str(tmp_path / "w")).collect()), key=str) == expected(data)
