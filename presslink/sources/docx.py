"""Distributed Word-corpus ingest and its audit.

Files are listed and read by Spark's ``binaryFile`` source (one row per file,
partitioned across tasks); each task unzips its files with the standard
library and emits one row per body paragraph. A file that cannot be parsed
becomes an error row; the other files continue.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from presslink.session import arrow_batch, materialize

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"

PARAGRAPH_SCHEMA = "path string, ix long, text string, style string, first_bold boolean, error string"
PARAGRAPH_NAMES = ["path", "ix", "text", "style", "first_bold", "error"]
PARAGRAPH_TYPES = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.string()]
FILES_PER_BATCH = 16   # files that a Python call holds as objects


def _on(el) -> bool | None:
    """Tri-state toggle property: absent -> None, present -> True unless val is false."""
    if el is None:
        return None
    v = el.get(W + "val")
    return v is None or v.lower() not in ("0", "false", "off")


def _style_names(z: zipfile.ZipFile) -> tuple[dict[str, str], str | None]:
    try:
        root = ET.fromstring(z.read("word/styles.xml"))
    except KeyError:
        return {}, None
    names, default = {}, None
    for st in root.iter(W + "style"):
        sid = st.get(W + "styleId")
        nm = st.find(W + "name")
        name = nm.get(W + "val") if nm is not None else sid
        names[sid] = name
        if st.get(W + "type") == "paragraph" and st.get(W + "default") in ("1", "true"):
            default = name
    return names, default


def _run_text(r) -> str:
    out = []
    for el in r:
        tag = el.tag
        if tag == W + "t":
            out.append(el.text or "")
        elif tag in (W + "tab", W + "ptab"):
            out.append("\t")
        elif tag == W + "br":
            out.append("\n" if el.get(W + "type") in (None, "textWrapping") else "")
        elif tag == W + "cr":
            out.append("\n")
        elif tag == W + "noBreakHyphen":
            out.append("-")
    return "".join(out)


def _paragraph_text(p) -> str:
    """Text of the paragraph's own runs and hyperlink runs (not tracked insertions,
    fields or nested content controls)."""
    out = []
    for child in p:
        if child.tag == W + "r":
            out.append(_run_text(child))
        elif child.tag == W + "hyperlink":
            out.extend(_run_text(r) for r in child.findall(W + "r"))
    return "".join(out)


def parse_docx(content: bytes) -> list[tuple[str, str | None, bool]]:
    """Body paragraphs (not table cells) as ``(text, style name, first run bold)``."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names, default = _style_names(z)
        body = ET.fromstring(z.read("word/document.xml")).find(W + "body")
    rows = []
    if body is None:
        return rows
    for p in body.findall(W + "p"):
        ps = p.find(f"{W}pPr/{W}pStyle")
        style = names.get(ps.get(W + "val"), default) if ps is not None else default
        runs = p.findall(W + "r")
        bold = _on(runs[0].find(f"{W}rPr/{W}b")) if runs else None
        rows.append((_paragraph_text(p), style, bool(bold)))
    return rows


def slices(batches: Iterator[pa.RecordBatch], rows: int = FILES_PER_BATCH) -> Iterator[pa.RecordBatch]:
    """Arrow batches of at most ``rows`` rows: Python objects are made of few files at a time, however many a batch holds."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def _parse_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        out: list[tuple] = []
        for path, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist()):
            try:
                rows = parse_docx(bytes(content))
            except Exception as e:  # noqa: BLE001 - a bad file is reported, not fatal
                out.append((path, None, None, None, None, f"{type(e).__name__}: {e}"))
                continue
            if not rows:  # an empty document still counts as a processed file
                out.append((path, None, None, None, None, None))
            out.extend((path, i, text, style, bold, None) for i, (text, style, bold) in enumerate(rows))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), PARAGRAPH_TYPES)], names=PARAGRAPH_NAMES)


def parse_docx_files(files: DataFrame, persist: bool = True) -> DataFrame:
    """Word files ``path, content`` -> ``path, ix, text, style, first_bold, error`` (see :func:`read_docx_corpus`)."""
    corpus = files.select("path", "content").mapInArrow(_parse_files, PARAGRAPH_SCHEMA)
    if not persist:
        return corpus
    with arrow_batch(files.sparkSession, FILES_PER_BATCH):   # a row is a whole file
        return materialize(corpus)


def read_docx_file(spark: SparkSession, path: str) -> DataFrame:
    """One Word file; unlike a file of a corpus, one that cannot be read is an error for the caller."""
    corpus = parse_docx_files(spark.read.format("binaryFile").load(path))
    failed = corpus.filter(F.col("error").isNotNull()).first()
    if failed is not None:
        raise ValueError(f"cannot read {path}: {failed.error}")
    return corpus


def read_docx_corpus(spark: SparkSession, directory: str, persist: bool = True) -> DataFrame:
    """Every ``*.docx`` directly in ``directory`` -> ``path, ix, text, style, first_bold, error``.

    Paragraph rows have ``error`` NULL and ``ix`` set; a file that failed has one
    row with ``error`` set; an empty document has one row with both NULL.
    Raises ``FileNotFoundError`` when the directory holds no Word files.
    The parsed corpus feeds both article assembly and the audit, so by default it
    is checkpointed once (files are parsed exactly once).
    """
    files = (spark.read.format("binaryFile").option("pathGlobFilter", "*.docx")
             .option("recursiveFileLookup", "false").load(directory).select("path", "content"))
    if files.select("path").limit(1).count() == 0:
        raise FileNotFoundError(f"No .docx files found in {directory}")
    return parse_docx_files(files, persist)


def corpus_paragraphs(corpus: DataFrame) -> DataFrame:
    """Paragraph rows only (input of the article rules)."""
    return corpus.filter(F.col("error").isNull() & F.col("ix").isNotNull()).drop("error")


def ingest_audit(corpus: DataFrame, articles: DataFrame) -> DataFrame:
    """Files ok / failed / total, articles, success rate (one row).

    Articles are counted per file and joined on ``path`` (an equi-join of two
    per-file tables), then one aggregate produces the totals.
    """
    per_file = corpus.groupBy("path").agg(F.max(F.col("error").isNotNull().cast("int")).alias("failed"))
    per_file_articles = articles.groupBy("path").agg(F.count(F.lit(1)).alias("n_articles"))
    return (per_file.join(per_file_articles, "path", "left")
            .agg(F.count_if(F.col("failed") == 0).alias("successful_files"),
                 F.count_if(F.col("failed") == 1).alias("failed_files"),
                 F.count(F.lit(1)).alias("total_files"),
                 F.coalesce(F.sum("n_articles"), F.lit(0)).cast("long").alias("total_articles"))
            .withColumn("success_rate", F.when(F.col("total_files") > 0,
                                               F.col("successful_files") / F.col("total_files"))
                        .otherwise(F.lit(0.0))))
