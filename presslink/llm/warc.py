"""WARC archives: write records, read them back by boundary-chain verification.

``write_archive`` turns each row into one WARC/1.1 record with Spark's text sink (the record
terminator CRLF CRLF is the sink's line separator), so a folder of plain ``.warc`` text holds the
archive. Of rows with equal payloads the smallest id is the ``response``, the others ``revisit`` it.

``read_archive`` splits files anywhere. Every occurrence of the magic ``WARC/1.`` is a candidate
record; a task knows a candidate's header and length, hence the offset of its successor. Offsets are
prefix sums of piece lengths (per split, then over the splits of a file). Candidates that follow one
another are contracted to runs inside a split; pointer jumping over the runs from offset 0 of each
file keeps only what is reachable, so magic inside payloads is rejected. Payload bytes are not
shuffled for records that one piece holds; only records whose payload contains the magic are read
again and joined from their pieces.

Defined cases: a null payload is empty; an empty payload is a record of 0 bytes and is deduplicated
like any other (from ``min_bytes`` on); rows with a repeated id and equal payload are all responses if
that id is the smallest; a null id counts as larger than any id (its record has no id header); an
empty table gives an empty archive and no rows; other columns are ignored. Line breaks in an url, and the
slash of a magic in it, are percent-encoded; an url may have any length. One record must fit one task (a WARC payload is one value).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from presslink.llm.common import deal, scratch, store

MAGIC = "WARC/1."
CRLF = "\r\n"
END = CRLF + CRLF
ID_URN = "urn:presslink:record:"
#: Pieces meet the record that holds them in cells of so many bytes.
GRID = 1 << 16
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 SHA-1: each 5 hex digits are 20 bits, hence 4 base-32 digits."""
    hexa = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(hexa, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def plan_records(pages: DataFrame, id_col: str, url_col: str, payload_col: str, min_bytes: int = 0) -> DataFrame:
    """``id, url, payload, digest, refers_to`` (refers_to set: the row is a revisit)."""
    rows = (pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"),
                         F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload"))
            .withColumn("digest", base32_sha1(F.col("payload"))))
    first = (rows.where(F.length("payload") >= min_bytes).groupBy("digest")
             .agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("n"))
             .where("n > 1").select("digest", "first_id"))
    joined = deal(rows, store(first, "warc-first"), "digest", "left")
    revisit = F.col("first_id").isNotNull() & ~F.col("id").eqNullSafe(F.col("first_id"))
    return joined.select("id", "url", "payload", "digest", F.when(revisit, F.col("first_id")).alias("refers_to"))


def record_text(date: str) -> Column:
    """The record up to its terminator, as bytes in a string column."""
    revisit = F.col("refers_to").isNotNull()
    safe_url = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    safe_url = F.replace(safe_url, F.lit(MAGIC), F.lit(MAGIC.replace("/", "%2F")))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
                    F.length("payload").cast("string"), F.lit(END))
    block = F.concat(http.cast("binary"), F.when(revisit, F.lit(b"")).otherwise(F.col("payload")))
    head = F.concat_ws(
        CRLF,
        F.lit(MAGIC + "1"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        F.concat(F.lit(f"WARC-Record-ID: <{ID_URN}"), F.col("id").cast("string"), F.lit(">")),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), safe_url),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
        F.when(revisit, F.concat(F.lit(f"WARC-Refers-To: <{ID_URN}"), F.col("refers_to").cast("string"), F.lit(">"))),
        F.when(revisit, F.lit(f"WARC-Profile: {REVISIT_PROFILE}")),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.length(block).cast("string")))
    return F.concat(head.cast("binary"), F.lit(END).cast("binary"), block).cast("string")


def write_archive(pages: DataFrame, path: str, id_col: str, url_col: str, payload_col: str,
                  min_bytes: int = 0, date: str = "2000-01-01T00:00:00Z") -> None:
    planned = plan_records(pages, id_col, url_col, payload_col, min_bytes)
    planned.select(record_text(date).alias("value")).write.option("lineSep", END).text(path)


def _header(name: str) -> Column:
    return F.nullif(F.regexp_extract("head", rf"(?i)\r\n{name}:[ \t]*([^\r\n]*)", 1), F.lit(""))


def scan_pieces(spark: SparkSession, path: str) -> DataFrame:
    """One row per piece between two magics: ``file, block, seq, size, body`` (size counts the magic)."""
    raw = spark.read.option("lineSep", MAGIC).text(path)
    return raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                      F.monotonically_increasing_id().alias("seq"), "value",
                      (F.octet_length("value") + len(MAGIC)).alias("size"))


def _parsed(piece: DataFrame) -> DataFrame:
    """Header fields, block and payload of a piece (or of joined pieces) in ``value``."""
    head = F.substring_index("value", END, 1)
    p = (piece.withColumn("head", F.when(F.col("value").rlike(r"^[01]\r\n"), head))
         .withColumn("head_size", F.octet_length(head) + len(MAGIC) + 4)
         .withColumn("block_size", F.regexp_extract("head", r"(?i)\r\nContent-Length:[ \t]*([0-9]{1,15})[ \t]*(\r|$)",
                                                    1).try_cast("long")))
    block = F.substring(F.col("value").cast("binary"), F.col("head_size") - len(MAGIC) + 1,
                        F.col("block_size").cast("int"))
    http = F.octet_length(F.substring_index(block.cast("string"), END, 1)) + 4
    payload = F.when(F.col("content_type").startswith("application/http"),
                     F.substring(block, (http + 1).cast("int"), F.lit((1 << 31) - 1))).otherwise(block)
    return (p.withColumn("content_type", _header("Content-Type"))
            .withColumn("warc_type", _header("WARC-Type"))
            .withColumn("record_id", _header("WARC-Record-ID"))
            .withColumn("target_uri", _header("WARC-Target-URI"))
            .withColumn("header_digest", F.regexp_replace(_header("WARC-Payload-Digest"), "^sha1:", ""))
            .withColumn("refers_to", _header("WARC-Refers-To"))
            .withColumn("payload", payload))


FIELDS = ["warc_type", "record_id", "target_uri", "refers_to", "header_digest"]


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """Every piece with its offset, and for a candidate its successor's offset; payloads as digest and size."""
    p = _parsed(scan_pieces(spark, path))
    whole = F.col("size") == F.col("head_size") + F.col("block_size") + 4     # one piece holds the record
    narrow = p.select("file", "block", "seq", "size", (F.col("head_size") + F.col("block_size") + 4).alias("record_size"),
                      whole.alias("whole"), *FIELDS,
                      F.when(whole, F.length("payload")).cast("long").alias("payload_bytes"),
                      F.when(whole, base32_sha1(F.col("payload"))).alias("payload_digest"))
    narrow = store(narrow, "warc-pieces")
    return with_offsets(narrow).withColumn("succ", F.col("offset") + F.col("record_size"))


def with_offsets(pieces: DataFrame) -> DataFrame:
    """Add each piece's offset in its file: prefix sums inside the split, then over the file's splits."""
    in_split = Window.partitionBy("file", "block").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    per_split = (pieces.groupBy("file", "block").agg(F.sum("size").alias("total"))
                 .withColumn("base", F.coalesce(F.sum("total").over(
                     Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
                 .select("file", "block", "base"))
    # a file's first piece is what precedes the first magic, hence the step back by one magic
    return (pieces.withColumn("before", F.coalesce(F.sum("size").over(in_split), F.lit(0)))
            .join(per_split, ["file", "block"])
            .withColumn("offset", F.col("base") + F.col("before") - len(MAGIC))
            .drop("before", "base"))


def verify_chains(pieces: DataFrame) -> DataFrame:
    """Of the candidates (``file, block, offset, succ``) those reachable from offset 0 of their file."""
    cand = pieces.where("succ IS NOT NULL AND offset >= 0")
    w = Window.partitionBy("file", "block").orderBy("offset")
    cand = cand.withColumn("_after", F.lead("offset").over(w)).withColumn("_prev", F.lag("succ").over(w))
    exits = (cand.where("NOT (succ <=> _after)").select("file", F.col("succ").alias("offset")).distinct()
             .withColumn("_entered", F.lit(True)))
    cand = cand.join(exits, ["file", "offset"], "left")
    # a run begins where the piece before does not lead here, or where a run elsewhere may lead
    begins = ~F.col("_prev").eqNullSafe(F.col("offset")) | F.col("_entered").isNotNull()
    cand = store(cand.withColumn("_run", F.max(F.when(begins, F.col("offset"))).over(w)), "warc-runs")
    runs = (cand.groupBy("file", F.col("_run").alias("at")).agg(F.max("succ").alias("to"))
            .withColumn("live", F.col("at") == 0))
    # pointer jumping: live runs make the run they lead to live; every round doubles the stride
    runs = store(runs, "warc-jump")
    while True:
        hit = (runs.where("live").select("file", F.col("to").alias("at")).distinct().withColumn("_hit", F.lit(True)))
        step = runs.select("file", F.col("at").alias("to"), F.col("to").alias("_far"))
        after = store(runs.join(hit, ["file", "at"], "left").join(step, ["file", "to"], "left")
                      .select("file", "at", F.coalesce("_far", "to").alias("to"),
                              (F.col("live") | F.col("_hit").isNotNull()).alias("live")), "warc-jump")
        moved = after.join(runs.select("file", "at", F.col("to").alias("_to"), F.col("live").alias("_live")),
                           ["file", "at"]).where("to != _to OR live != _live").isEmpty()
        runs = after
        if moved:
            break
    live = runs.where("live").select("file", F.col("at").alias("_run"))
    return cand.join(live, ["file", "_run"], "left_semi").drop("_after", "_prev", "_entered", "_run")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """``file, offset, warc_type, record_id, target_uri, refers_to, header_digest, payload_bytes, payload_digest``
    of every true record; the last two are computed from the bytes read."""
    pieces = store(candidates(spark, path), "warc-offsets")
    records = store(verify_chains(pieces), "warc-records")
    cols = ["file", "offset", *FIELDS, "payload_bytes", "payload_digest"]
    whole = records.where("whole").select(*cols)
    broken = records.where("NOT whole").select("file", "offset", "succ")
    if broken.isEmpty():
        return whole
    return whole.unionByName(_joined_records(spark, path, broken).select(*cols))


def _joined_records(spark: SparkSession, path: str, broken: DataFrame) -> DataFrame:
    """Records whose payload holds the magic: their pieces, read again, put together."""
    again = store(scan_pieces(spark, path).join(broken.select("file").distinct(), "file", "left_semi"), "warc-again")
    grid = lambda c: F.floor(F.col(c) / GRID)
    marks = broken.select("file", F.col("offset").alias("start"), "succ").withColumn(
        "cell", F.explode(F.sequence(grid("start"), grid("succ"))))
    member = (with_offsets(again.select("file", "block", "seq", "size")).withColumn("cell", grid("offset"))
              .join(marks, ["file", "cell"]).where("offset >= start AND offset < succ")
              .select("file", "block", "seq", "start", "offset"))
    got = again.join(member, ["file", "block", "seq"])
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("offset", "value"))), lambda x: x.value), MAGIC)
    whole = _parsed(got.groupBy("file", "start").agg(body.alias("value")))
    return whole.select("file", F.col("start").alias("offset"), *FIELDS,
                        F.length("payload").cast("long").alias("payload_bytes"),
                        base32_sha1(F.col("payload")).alias("payload_digest"))


def page_digests(pages: DataFrame, path: str | None = None, id_col: str = "page_id", url_col: str = "url",
                 payload_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """Write the archive, read it back: ``page_id, payload_bytes, payload_digest, record_type, refers_to``."""
    spark = pages.sparkSession
    path = path or scratch(spark, "warc")
    write_archive(pages, path, id_col, url_col, payload_col, min_bytes)
    number = lambda c: F.regexp_extract(c, rf"^<{ID_URN}(-?[0-9]+)>$", 1).try_cast("long")
    rec = store(read_records(spark, path).select(
        number("record_id").alias("page_id"), F.col("warc_type").alias("record_type"),
        number("refers_to").alias("refers_to"), "payload_bytes", "payload_digest", "header_digest"), "warc-read")
    own = rec.where("record_type = 'response'").drop("header_digest")
    target = (own.where("page_id IS NOT NULL").groupBy(F.col("page_id").alias("refers_to"), "payload_digest")
              .agg(F.max("payload_bytes").alias("payload_bytes"))
              .withColumn("_key", F.concat_ws("/", "refers_to", "payload_digest")))
    revisits = (rec.where("record_type = 'revisit'")
                .select("page_id", "record_type", F.concat_ws("/", "refers_to", "header_digest").alias("_key")))
    out = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return own.select(*out).unionByName(deal(revisits, target, "_key", "left").select(*out))


_FIVE = "(CAST('0x' || substr(h, {at}, 5) AS BIGINT) >> {shift}) % 32"
_DIGITS = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST({_FIVE.format(at=5 * (i // 4) + 1, shift=5 * (3 - i % 4))} AS INT), 1)"
    for i in range(32))
ORACLE_OP1 = f"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first_id FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, {_DIGITS} AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM f
"""
