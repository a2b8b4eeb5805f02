import os
import sys
import zipfile
from xml.sax.saxutils import escape

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from presslink.session import get_session  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    os.environ.setdefault("BENCH_CPUS", "4")
    s = get_session(master="local[4]", shuffle_partitions=4, app_name="presslink-tests")
    yield s


def paragraphs_df(spark, rows, path="doc.docx"):
    """rows: (text, style, bold) in document order."""
    data = [(path, i, t, st, b) for i, (t, st, b) in enumerate(rows)]
    return spark.createDataFrame(data, "path string, ix long, text string, style string, first_bold boolean")


W_NS = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def write_docx(path, paragraphs):
    """Minimal Word file: paragraphs are (text, style_id or None, bold or None)."""
    body = []
    for text, style, bold in paragraphs:
        ppr = f'<w:pPr><w:pStyle w:val="{style}"/></w:pPr>' if style else ""
        rpr = "" if bold is None else ('<w:rPr><w:b/></w:rPr>' if bold else '<w:rPr><w:b w:val="0"/></w:rPr>')
        body.append(f'<w:p>{ppr}<w:r>{rpr}<w:t xml:space="preserve">{escape(text)}</w:t></w:r></w:p>')
    doc = (f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?><w:document xmlns:w="{W_NS}"><w:body>'
           + "".join(body) + "<w:tbl><w:tr><w:tc><w:p><w:r><w:t>table cell</w:t></w:r></w:p></w:tc></w:tr></w:tbl>"
           + "</w:body></w:document>")
    styles = (f'<?xml version="1.0" encoding="UTF-8"?><w:styles xmlns:w="{W_NS}">'
              '<w:style w:type="paragraph" w:default="1" w:styleId="Normal"><w:name w:val="Normal"/></w:style>'
              '<w:style w:type="paragraph" w:styleId="Heading1"><w:name w:val="heading 1"/></w:style>'
              '</w:styles>')
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("[Content_Types].xml", '<?xml version="1.0"?><Types/>')
        z.writestr("word/document.xml", doc)
        z.writestr("word/styles.xml", styles)
