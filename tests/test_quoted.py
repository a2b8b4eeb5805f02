"""CSV read in splits against Python's csv module."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from presslink.sources.quoted import ends_inside, read_quoted


def plain(texts):
    """Records of all files in order, by the standard library; empty fields are null."""
    out = []
    for t in texts:
        rows = [r for r in csv.reader(io.StringIO(t, newline="")) if r]
        out += [(r[1] or None, r[2] or None) for r in rows[1:]]
    return [(i, *r) for i, r in enumerate(out)]


def read(spark, path, split):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        if split:
            spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
            spark.conf.set("spark.sql.files.openCostInBytes", "1")
        return sorted(tuple(r) for r in read_quoted(spark, str(path), ["b, c", "d"]).select("_row", "`b, c`", "d").collect())
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def field(rnd):
    return "".join(rnd.choice(["a", "bc", "é", ",", "\n", '"', "\r\n", "\n\n", " ", "'"]) for _ in range(rnd.randrange(0, 6)))


@pytest.mark.parametrize("split", [None, 23, 200])
def test_random_files_in_any_split(spark, tmp_path, split):
    rnd = random.Random(split)
    texts = []
    for f in range(3):
        out = io.StringIO(newline="")
        w = csv.writer(out, lineterminator=["\n", "\r\n", "\n"][f], quoting=[csv.QUOTE_MINIMAL, csv.QUOTE_ALL, csv.QUOTE_MINIMAL][f])
        w.writerow(["a", "b, c", "d"])
        for _ in range(60):
            w.writerow(["x", field(rnd), field(rnd)])
            if rnd.random() < 0.1:
                out.write("\n")                                        # an empty line between records
        texts.append(out.getvalue())
        (tmp_path / f"f{f}.csv").write_text(texts[-1], encoding="utf-8", newline="")
    assert read(spark, tmp_path, split) == plain(texts)


def test_odd_cases(spark, tmp_path):
    text = '﻿a,"b, c",d\n1,5" pipe,2" x\n2,"closed"tail,z\n3,,\n\n\n4,"never\ncloses, "" \nnot here'
    (tmp_path / "o.csv").write_text(text, encoding="utf-8")
    rows = read(spark, tmp_path / "o.csv", 7)
    assert [r[0] for r in rows] == [0, 1, 2, 3]
    assert rows[0][1:] == ('5" pipe', '2" x') and rows[2][1:] == (None, None)
    (tmp_path / "h.csv").write_text('a,"b, c",d\n', encoding="utf-8")
    assert read(spark, tmp_path / "h.csv", None) == []


def test_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text('a,"b, c",d\n1,2,3\n')
    (tmp_path / "b.csv").write_text('"a","b, c","d"\n1,4,5\n')
    assert read(spark, tmp_path, None) == [(0, "2", "3"), (1, "4", "5")]
    (tmp_path / "c.csv").write_text('a,d,"b, c"\n1,4,5\n')
    with pytest.raises(ValueError, match="another header"):
        read(spark, tmp_path, None)
    with pytest.raises(ValueError, match="no column"):
        read_quoted(spark, str(tmp_path), ["e"])


def test_many_ranges_are_many_tasks(spark, tmp_path):
    (tmp_path / "m.csv").write_text('a,"b, c",d\n' + '1,"x\ny",2\n' * 400)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "512")
    try:
        lines = spark.read.option("lineSep", "\n").text(str(tmp_path / "m.csv"))
        assert lines.select(F.spark_partition_id()).distinct().count() > 4
        rows = read_quoted(spark, str(tmp_path / "m.csv"), ["d"]).collect()
        assert sorted(r._row for r in rows) == list(range(400)) and {r.d for r in rows} == {"2"}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


@pytest.mark.parametrize("line, inside, want", [
    ("a,b", False, False), ("a,b", True, True), ('a,"b', False, True), ('b",c', True, False), ('a,"b""', False, True),
    ('a,b"c', False, False), ('""', False, False), ('""', True, True), ('"', True, False), ('x"",",y', True, False),
    ('a,"b"c,"d', False, True), ("", True, True), ("", False, False)])
def test_states_of_a_line(line, inside, want):
    assert ends_inside(line, inside) is want
