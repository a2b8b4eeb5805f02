"""Word-corpus ingest (S1), audit (S8), CSV readers (S3/S4) and streaming ingest."""

import os

import pytest
from conftest import write_docx
from pyspark.sql import functions as F

from presslink.operators.articles import assemble_articles
from presslink.sources.csv import read_contributions, read_mentions
from presslink.sources.docx import corpus_paragraphs, ingest_audit, parse_docx, read_docx_corpus, read_docx_file
from presslink.streaming.ingest import error_path, stream_docx_articles

DOC = [("Test Article Title", "Heading1", True), ("Source: Test News", None, False),
       ("Date: 2024-01-15", None, None), ("Article content here.", None, None), ("End of Document", None, None),
       ("quiet bold headline text", None, True), ("Body of the second story.", None, None)]


def test_parse_docx_styles_and_bold(tmp_path):
    p = tmp_path / "a.docx"
    write_docx(p, DOC)
    rows = parse_docx(p.read_bytes())
    assert [r[0] for r in rows] == [d[0] for d in DOC]            # table cell not read
    assert rows[0][1] == "heading 1" and rows[1][1] == "Normal"
    assert [r[2] for r in rows] == [True, False, False, False, False, True, False]


def test_corpus_to_articles_with_bad_file(spark, tmp_path):
    write_docx(tmp_path / "a.docx", DOC)
    write_docx(tmp_path / "b.docx", DOC[:4])
    (tmp_path / "broken.docx").write_bytes(b"not a zip")
    (tmp_path / "notes.txt").write_text("ignored")
    corpus = read_docx_corpus(spark, str(tmp_path))
    arts = assemble_articles(corpus_paragraphs(corpus))
    got = sorted((os.path.basename(r.path), r.title) for r in arts.collect())
    assert got == [("a.docx", "Test Article Title"), ("a.docx", "quiet bold headline text"),
                   ("b.docx", "Test Article Title")]
    audit = ingest_audit(corpus, arts).first()
    assert (audit.successful_files, audit.failed_files, audit.total_files, audit.total_articles) == (2, 1, 3, 3)
    assert audit.success_rate == pytest.approx(2 / 3)


def test_single_file(spark, tmp_path):
    write_docx(tmp_path / "a.docx", DOC)
    assert corpus_paragraphs(read_docx_file(spark, str(tmp_path / "a.docx"))).count() == len(DOC)
    (tmp_path / "broken.docx").write_bytes(b"not a zip")
    with pytest.raises(ValueError, match="broken.docx"):
        read_docx_file(spark, str(tmp_path / "broken.docx"))


def test_no_word_files(spark, tmp_path):
    (tmp_path / "x.txt").write_text("x")
    with pytest.raises(FileNotFoundError):
        read_docx_corpus(spark, str(tmp_path))


def test_csv_readers(spark, tmp_path):
    m = tmp_path / "m.csv"
    m.write_text('Citations,Company/Organization Name\n"a, b",  Acme Widgets \nx,""\ny,"Multi\nLine, Inc."\n'
                 'z,Acme Widgets\n', encoding="utf-8")
    got = [r.name for r in read_mentions(spark, str(m)).orderBy("mention_id").collect()]
    assert got == ["Acme Widgets", "Multi\nLine, Inc.", "Acme Widgets"]
    c = tmp_path / "c.csv"
    c.write_text("Contributor Name,Extra,Contributor Employer\nAcme Widgets LLC,1,Other\n Bob ,2,\n", encoding="utf-8")
    rows = [tuple(r) for r in read_contributions(spark, str(c)).orderBy("idx").select(
        "contributor_name", "contributor_employer").collect()]
    assert rows == [("Acme Widgets LLC", "Other"), ("Bob", "")]
    bad = tmp_path / "bad.csv"
    bad.write_text("Name\nx\n")
    with pytest.raises(ValueError):
        read_mentions(spark, str(bad))
    with pytest.raises(ValueError):
        read_contributions(spark, str(bad))


def test_streaming_ingest(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    write_docx(src / "a.docx", DOC)
    out = str(tmp_path / "articles")
    q = stream_docx_articles(spark, str(src), out, checkpoint_location=str(tmp_path / "ckpt"))
    q.awaitTermination(120)
    assert spark.read.parquet(out).count() == 2
    write_docx(src / "b.docx", DOC[:4])
    q = stream_docx_articles(spark, str(src), out, checkpoint_location=str(tmp_path / "ckpt"))
    q.awaitTermination(120)
    titles = sorted(r.title for r in spark.read.parquet(out).select("title").collect())
    assert titles == ["Test Article Title", "Test Article Title", "quiet bold headline text"]
    assert spark.read.parquet(out).filter(F.col("path").endswith("b.docx")).count() == 1
    (src / "c.docx").write_bytes(b"no archive")
    q = stream_docx_articles(spark, str(src), out, checkpoint_location=str(tmp_path / "ckpt"))
    q.awaitTermination(120)
    assert spark.read.parquet(out).count() == 3
    failed = spark.read.parquet(error_path(out)).collect()
    assert [r.path.rsplit("/", 1)[1] for r in failed] == ["c.docx"] and failed[0].error


def test_paragraph_text_rules(tmp_path):
    import zipfile
    from conftest import W_NS
    doc = (f'<w:document xmlns:w="{W_NS}"><w:body>'
           '<w:p><w:r><w:t>A</w:t><w:tab/><w:t>B</w:t><w:br/><w:t>C</w:t><w:br w:type="page"/></w:r>'
           '<w:hyperlink><w:r><w:t>link</w:t></w:r></w:hyperlink><w:ins><w:r><w:t>inserted</w:t></w:r></w:ins></w:p>'
           '<w:p><w:pPr><w:pStyle w:val="Missing"/></w:pPr><w:r><w:t>x</w:t></w:r></w:p>'
           '</w:body></w:document>')
    p = tmp_path / "t.docx"
    with zipfile.ZipFile(p, "w") as z:
        z.writestr("word/document.xml", doc)
        z.writestr("word/styles.xml", f'<w:styles xmlns:w="{W_NS}"><w:style w:type="paragraph" w:default="1" '
                                      'w:styleId="Normal"><w:name w:val="Normal"/></w:style></w:styles>')
    rows = parse_docx(p.read_bytes())
    assert rows[0][0] == "A\tB\nClink"
    assert rows[1][1] == "Normal"


def test_contributions_to_table(spark, tmp_path):
    from presslink.sources.csv import contributions_to_table
    c = tmp_path / "c.csv"
    c.write_text("Contributor Name,Contributor Employer\nAcme Widgets LLC,Other\n Bob ,\n", encoding="utf-8")
    t = contributions_to_table(spark, str(c), str(tmp_path / "table"))
    rows = [(r.contributor_name, r.contributor_employer) for r in t.orderBy("idx").collect()]
    assert rows == [("Acme Widgets LLC", "Other"), ("Bob", "")]
    assert set(t.columns) == {"idx", "contributor_name", "contributor_employer", "source_file"}


def test_files_become_objects_a_few_at_a_time():
    """A task's Arrow batch may hold thousands of files; what Python makes of them must not grow with it."""
    import pyarrow as pa

    from presslink.plans.fixtures import _word_files
    from presslink.sources.docx import FILES_PER_BATCH, _parse_files
    paragraphs = [{"ix": 0, "text": "Title", "style": "Heading 1", "first_bold": True}, {"ix": 1, "text": "a < b", "style": "Normal", "first_bold": False}]
    n = 5 * FILES_PER_BATCH + 3
    batch = pa.RecordBatch.from_pylist([{"path": f"{i}.docx", "broken": i % 7 == 3, "paragraphs": None if i % 7 == 3 else paragraphs} for i in range(n)])
    files = list(_word_files([batch.slice(0, 60), batch.slice(60)]))
    assert max(f.num_rows for f in files) <= FILES_PER_BATCH and [x for f in files for x in f.column("path").to_pylist()] == [f"{i}.docx" for i in range(n)]
    parsed = list(_parse_files([pa.Table.from_batches(files).combine_chunks().to_batches()[0]]))
    assert max(p.num_rows for p in parsed) <= 2 * FILES_PER_BATCH
    rows = [r for p in parsed for r in p.to_pylist()]
    assert [r["path"] for r in rows if r["error"]] == [f"{i}.docx" for i in range(n) if i % 7 == 3]
    assert [(r["path"], r["text"], r["style"], r["first_bold"]) for r in rows if r["path"] == "4.docx"] == [
        ("4.docx", "Title", "Heading 1", True), ("4.docx", "a < b", "Normal", False)]
    assert list(_parse_files([])) == []
