"""Shaped inputs derived from the driver tables (see FIXTURES.md §C).

Every derivation is a projection/explode of whole tables, so the work grows
with the data; the SQL oracle builds the same rows with the same rules
(`presslink.plans.oracle`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from presslink.functions.text import cached_column
from presslink.session import spread

# Fixed values used by the fixture layout (ours, mirrored in the oracle SQL).
MONTH_NAMES = ["January", "February", "March", "April", "May", "June", "July",
               "August", "September", "October", "November", "December"]
MONTH_ABBR = [m[:3] for m in MONTH_NAMES]
DATE_LABELS = ["Date: ", "Published: ", "Load-Date: ", ""]
TWO_REPLIES = '{"decision": "MATCH", "index": 1, "reason": "r"} or maybe {"decision": "NO_MATCH", "index": 0}'
NAME_SUFFIXES = [" Inc.", " LLC", " Corporation", " Ltd", ""]
# ix = doc_id * LINE_STRIDE + position. A Spark array is one value of at most 2^31 bytes and each paragraph in it takes
# over 40, so a document never has as many lines.
LINE_STRIDE = 1 << 26


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fx_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))


def _digits_to_letters(c: Column) -> Column:
    return F.translate(c, "0123456789", "abcdefghij")


def _date_text(doc_id: Column) -> Column:
    m = (doc_id % 12 + 1).cast("int")
    d = (doc_id % 28 + 1).cast("int")
    y = (doc_id % 25 + 2000).cast("string")
    ms, ds = m.cast("string"), d.cast("string")
    m2, d2 = F.lpad(ms, 2, "0"), F.lpad(ds, 2, "0")
    full = F.element_at(F.array(*[F.lit(x) for x in MONTH_NAMES]), m)
    abbr = F.element_at(F.array(*[F.lit(x) for x in MONTH_ABBR]), m)
    k = doc_id % 9
    body = (
        F.when(k == 0, F.concat(y, F.lit("-"), m2, F.lit("-"), d2))
        .when(k == 1, F.concat(ms, F.lit("/"), ds, F.lit("/"), y))
        .when(k == 2, F.concat(m2, F.lit("-"), d2, F.lit("-"), y))
        .when(k == 3, F.concat(full, F.lit(" "), ds, F.lit(", "), y))
        .when(k == 4, F.concat(abbr, F.lit(" "), ds, F.lit(", "), y))
        .when(k == 5, F.concat(ds, F.lit(" "), full, F.lit(" "), y))
        .when(k == 6, F.concat(full, F.lit(" "), y))
        .when(k == 7, F.concat(abbr, F.lit(" "), y))
        .otherwise(y)
    )
    label = F.element_at(F.array(*[F.lit(x) for x in DATE_LABELS]), (doc_id % 4 + 1).cast("int"))
    return F.concat(label, body)


def _source_text(doc_id: Column, source: Column) -> Column:
    pub = _digits_to_letters(source)
    k = doc_id % 3
    return (
        F.when(k == 0, F.concat(F.lit("Source: "), source, F.lit(" Wire")))
        .when(k == 1, F.concat(F.lit("Copyright "), (doc_id % 25 + 2000).cast("string"), F.lit(" The "), pub,
                               F.lit(" Daily Herald")))
        .otherwise(F.concat(pub, F.lit(" Tribune - staff report")))
    )


def _para(ix: Column, text: Column, style: Column, bold: Column) -> Column:
    return F.struct(ix.cast("long").alias("ix"), text.alias("text"), style.alias("style"),
                    bold.alias("first_bold"))


def fx_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw paragraphs ``path, ix, text, style, first_bold`` (one scan, one explode)."""
    return fx_documents(spark, sf_dir).select(F.col("source").alias("path"), F.inline(_paragraphs()))


def fx_paragraph_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same paragraphs, one row per document: ``path, pos, paragraphs``."""
    return fx_documents(spark, sf_dir).select(F.col("source").alias("path"), F.col("doc_id").alias("pos"),
                                              _paragraphs().alias("paragraphs"))


@cached_column
def _paragraphs() -> Column:
    """All paragraphs of a document as an array."""
    doc = F.col("doc_id")
    base = doc * F.lit(LINE_STRIDE)
    normal, no = F.lit("Normal"), F.lit(False)
    title = F.when(doc % 10 != 0, _para(
        base, F.concat(F.lit("Plant Opening Case "), doc.cast("string")),
        F.when(doc % 2 == 0, F.lit("Heading 1")).otherwise(normal), doc % 3 == 0))
    src = F.when(doc % 10 != 1, _para(base + 1, _source_text(doc, F.col("source")), normal, no))
    dt = F.when(doc % 10 != 2, _para(base + 2, _date_text(doc), normal, no))
    lines = F.split(F.col("text"), "\n")
    body = F.transform(lines,
                       lambda line, i: _para(base + 3 + i, line, normal, (i == 0) & (doc % 7 == 0)))
    end = _para(base + 3 + F.size(lines), F.lit("End of Document"), normal, no)
    head = F.filter(F.array(title, src, dt), lambda x: x.isNotNull())
    return F.concat(head, body, F.array(end))


def is_broken(doc_id: Column) -> Column:
    """Which documents have a second file beside theirs that is no archive."""
    return doc_id % 10 == 9


def _word_files(batches):
    import io
    import zipfile
    from xml.sax.saxutils import escape

    import pyarrow as pa

    from presslink.sources.docx import slices

    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    styles = (f'<w:styles {ns}><w:style w:type="paragraph" w:default="1" w:styleId="Normal"><w:name w:val="Normal"/></w:style>'
              '<w:style w:type="paragraph" w:styleId="Heading1"><w:name w:val="Heading 1"/></w:style></w:styles>')
    for b in slices(batches):
        files = []
        for broken, paragraphs in zip(b.column("broken").to_pylist(), b.column("paragraphs").to_pylist()):
            if broken:
                files.append(b"no archive")
                continue
            body = "".join(
                "<w:p>" + ('<w:pPr><w:pStyle w:val="Heading1"/></w:pPr>' if p["style"] == "Heading 1" else "")
                + "<w:r>" + ("<w:rPr><w:b/></w:rPr>" if p["first_bold"] else "")
                + f'<w:t xml:space="preserve">{escape(p["text"], {chr(13): "&#13;"})}</w:t></w:r></w:p>' for p in paragraphs)
            out = io.BytesIO()
            with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
                z.writestr("word/styles.xml", styles)
                z.writestr("word/document.xml", f"<w:document {ns}><w:body>{body}</w:body></w:document>")
            files.append(out.getvalue())
        yield pa.RecordBatch.from_arrays([b.column("path"), pa.array(files, pa.binary())], names=["path", "content"])


def fx_word_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``path, content``: one Word file per document, and broken files beside some of them."""
    doc, no = F.col("doc_id"), F.lit(None)
    paragraphs = _paragraphs()
    files = F.array(
        F.struct(F.concat(doc.cast("string"), F.lit(".docx")).alias("path"), F.lit(False).alias("broken"), F.col("p").alias("paragraphs")),
        F.struct(F.concat(doc.cast("string"), F.lit("-broken.docx")).alias("path"), F.lit(True).alias("broken"), no.alias("paragraphs")))
    return (fx_documents(spark, sf_dir).select("doc_id", paragraphs.alias("p"))
            .select(F.inline(F.slice(files, 1, F.when(is_broken(doc), 2).otherwise(1))))
            .mapInArrow(_word_files, "path string, content binary"))


def fx_paragraphs_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S2 applied to the documents: one paragraph per line, path = doc_id."""
    from presslink.sources.text import paragraphs_from_text
    return paragraphs_from_text(fx_documents(spark, sf_dir), "doc_id", "text")


def _obj(name: Column, desc: Column) -> Column:
    return F.concat(F.lit('{"company_name": "'), name, F.lit('", "description": "'), desc, F.lit('"}'))


def fx_responses(spark: SparkSession, sf_dir: str, articles: DataFrame) -> DataFrame:
    """Model-style replies per article ``(path, seg, response)``, eight shapes by ``seg % 8``;
    two names from ``part``, whose keys go over the whole table with the articles of all paths; NULL reply when
    ``seg % 13 = 12``."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    last = part.agg(F.max("p_partkey")).first()[0] or 1
    number = F.coalesce(F.regexp_extract("path", "[0-9]+", 0).try_cast("long"), F.lit(0))
    key = (F.col("seg") * 20 + number) * 2 % last + 1
    p1 = part.select(F.col("p_partkey").alias("_k1"), F.col("p_name").alias("_n1"))
    p2 = part.select(F.col("p_partkey").alias("_k2"), F.col("p_name").alias("_n2"))
    a = (articles.select("path", "seg", "source")
         .join(p1, key == F.col("_k1"), "left")
         .join(p2, key + 1 == F.col("_k2"), "left"))
    n1 = F.concat(F.coalesce(F.col("_n1"), F.lit("unnamed works")), F.lit(" Inc."))
    n2 = F.concat(F.coalesce(F.col("_n2"), F.lit("unnamed works")), F.lit(" Partners"))
    wrap = lambda body: F.concat(F.lit('{"company_mentions": ['), body, F.lit("]}"))
    k = F.col("seg") % 8
    resp = (
        F.when(F.col("seg") % 13 == 12, F.lit(None).cast("string"))
        .when(k == 0, wrap(F.concat(_obj(n1, F.lit("Opened a new plant")), F.lit(", "),
                                    _obj(n2, F.lit("Supplies parts")), F.lit(', "stray entry"'))))
        .when(k == 1, F.concat(F.lit("Here is my analysis.\n"), wrap(_obj(n1, F.lit("Main subject"))),
                               F.lit("\nLet me know if you need more.")))
        .when(k == 2, F.lit("I could not find any companies in this article."))
        .when(k == 3, F.concat(F.lit('{"company_mentions": [{"company_name": "'), n1, F.lit('" ]}')))
        .when(F.col("seg") % 16 == 4, F.concat(wrap(_obj(n1, F.lit("Investor"))), F.lit(" see {note}")))
        .when(F.col("seg") % 48 == 12, F.concat(wrap(_obj(n1, F.lit("Investor"))), F.lit(", {}")))
        .when(k == 4, F.concat(F.lit('{"companies": ['), _obj(n1, F.lit("Investor")), F.lit("]}")))
        .when(k == 5, wrap(F.concat(
            _obj(F.lit("Green Party"), F.lit("Political group")), F.lit(", "), _obj(n1, F.lit("Investor")),
            F.lit(", "), _obj(F.lit("   "), F.lit("blank")), F.lit(", "),
            _obj(F.lit("Democrats"), F.lit("Party members")))))
        .when(k == 6, wrap(F.concat(_obj(n1, F.lit("Holds the Copyright to the article")), F.lit(", "),
                                    _obj(n2, F.repeat(F.lit("Long description "), 21)))))
        .when(F.col("seg") % 16 == 15,
              F.concat(F.lit('{"company_mentions": [{"company_name": "'), n1, F.lit('", "description": null}]}')))
        .otherwise(wrap(F.concat(_obj(F.upper("source"), F.lit("The publication itself")), F.lit(", "),
                                 _obj(n2, F.lit("Partner firm")))))
    )
    return a.select("path", "seg", resp.alias("response"))


def _suffix(k: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in NAME_SUFFIXES]), (k % 5 + 1).cast("int"))


def fx_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``mention_id, name`` per part row: the part name (even keys), the name with one
    letter removed (odd keys) or the brand (key % 3 = 2), plus a corporate suffix."""
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    name = F.col("p_name")
    pos = ((k / 2).cast("long") % F.length(name) + 1).cast("int")
    misspelled = F.concat(name.substr(F.lit(1), pos - 1), name.substr(pos + 1, F.length(name)))
    base = F.when(k % 3 == 2, F.col("p_brand")).when(k % 2 == 1, misspelled).otherwise(name)
    return p.select(k.alias("mention_id"), F.concat(base, _suffix(k)).alias("name"))


def fx_contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw contribution records ``idx, contributor_name, contributor_employer``
    (employer missing when key % 11 = 0)."""
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    return p.select(
        k.alias("idx"),
        F.concat(F.col("p_name"), _suffix(k + 2)).alias("contributor_name"),
        F.when(k % 11 != 0, F.concat(F.col("p_type"), F.lit(" "), F.col("p_name"))).alias("contributor_employer"))


def fx_adjudications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adjudication replies ``mention_id, reply, error`` by ``mention_id % 7``; a failed
    call (NULL reply, error text) when ``mention_id % 17 = 16``."""
    m = fx_mentions(spark, sf_dir).select("mention_id")
    k = F.col("mention_id") % 7
    reply = (
        F.when(k == 0, F.lit('{"decision": "MATCH", "index": 1, "reason": "Same entity"}'))
        .when((k == 1) & (F.col("mention_id") % 2 == 0), F.lit(TWO_REPLIES))
        .when(k == 1, F.lit('{"decision": "match", "index": 99, "reason": "Out of range"}'))
        .when((k == 2) | (k == 6), F.lit('Result: {"decision": "NO_MATCH", "index": 0, "reason": "Generic overlap"}'))
        .when(k == 3, F.lit('{"decision": "REVIEW", "index": 2, "reason": "Unclear"}'))
        .when(k == 4, F.lit("The model could not decide."))
        .otherwise(F.lit('{"decision": "MATCH", "index": "2", "reason": "Index given as text"}'))
    )
    failed = F.col("mention_id") % 17 == 16
    return m.select("mention_id", F.when(~failed, reply).alias("reply"),
                    F.when(failed, F.lit("APIError: request timed out")).alias("error"))
