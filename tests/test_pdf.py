"""PDF files put together by hand, from their bytes to elements."""

import base64
import zlib

import pytest

from docweft.sources import files, pdf


def build(objects, packed=False):
    """A file of numbered objects (bytes, or (dictionary, stream)); packed, those without a stream stand in an object stream."""
    out, inner = b"%PDF-1.5\n", []
    for n, x in objects.items():
        if isinstance(x, tuple):
            head, data = x
            out += b"%d 0 obj << %s /Length %d >> stream\n%s\nendstream endobj\n" % (n, head, len(data), data)
        elif packed:
            inner.append((n, x))
        else:
            out += b"%d 0 obj %s endobj\n" % (n, x)
    if packed:
        at, numbers, body = 0, b"", b""
        for n, x in inner:
            numbers += b"%d %d " % (n, at)
            body += x + b"\n"
            at = len(body)
        data = zlib.compress(numbers + body)
        out += b"99 0 obj << /Type /ObjStm /N %d /First %d /Filter /FlateDecode /Length %d >> stream\r\n%s\nendstream endobj\n" % (len(inner), len(numbers), len(data), data)
    return out + b"trailer << /Root 1 0 R >> startxref 0 %%EOF"


FIRST = rb"""BT /F1 24 Tf 72 700 Td (A large heading) Tj ET
BT /F1 10 Tf 72 660 Td (Some body) Tj 60 0 Td (text \(here\) caf\351) Tj 0 -12 TD [(in t) -20 (wo) -600 (lines.)] TJ T* (- an item) Tj ET
q 2 0 0 2 0 0 cm BT /F1 5 Tf 1 0 0 1 36 250 Tm (scaled) Tj ET Q BI /W 1 ID (junk) EI
BT /F1 10 Tf 72 40 Td (- 1 -) Tj ET"""
SECOND = rb"BT /F2 10 Tf 72 700 Td <00010002> Tj /F3 10 Tf 0 -14 Td (ab) Tj ET /X1 Do"
CMAP = b"1 beginbfchar <0001> <0416> endbfchar 1 beginbfrange <0002> <0003> <00E4> endbfrange"


def document(packed=False, filters=True):
    wrap = (lambda x: (b"/Filter [/ASCII85Decode /FlateDecode]", base64.a85encode(zlib.compress(x)) + b"~>")) if filters else (lambda x: (b"", x))
    return build({
        1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [3 0 R 4 0 R 11 0 R 2 0 R] /Count 3 /Resources << /Font << /F1 5 0 R /F2 6 0 R /F3 7 0 R >> /XObject << /X1 10 0 R >> >> >>",
        3: b"<< /Type /Page /Parent 2 0 R /Contents [8 0 R] >>", 4: b"<< /Type /Page /Parent 2 0 R /Contents 9 0 R >>", 11: b"<< /Type /Page /Parent 2 0 R >>",
        5: b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>", 6: b"<< /Type /Font /Subtype /Type0 /ToUnicode 12 0 R >>", 7: b"<< /Type /Font /Subtype /Type1 /Encoding << /Differences [97 /quoteright /uni00DF] >> >>",
        8: wrap(FIRST), 9: wrap(SECOND), 10: (b"/Subtype /Form /Matrix [1 0 0 1 0 -60]", b"BT /F1 12 Tf 72 500 Td (in a form) Tj ET /X1 Do"), 12: (b"", CMAP),
    }, packed)


@pytest.mark.parametrize("packed,filters", [(False, False), (False, True), (True, True)])
def test_lines(packed, filters):
    got = pdf.lines(document(packed, filters))
    assert got[:7] == [(1, 0, "A large heading", 24.0), (1, 1, "Some body text (here) café", 10.0), (1, 2, "in two lines.", 10.0), (1, 3, "- an item", 10.0), (1, 4, "scaled", 10.0), (1, 5, "- 1 -", 10.0), (2, 0, "Жä", 10.0)]
    assert got[7][2] == "’ß" and {x[2:] for x in got[8:-1]} == {("in a form", 12.0)} and got[-1] == (3, 0, "", 0.0)


def test_predictors_and_errors():
    rows = bytes([0, 1, 2, 3, 1, 1, 1, 1, 2, 5, 5, 5, 3, 9, 9, 9, 4, 7, 7, 7])
    assert pdf._predicted(rows, 3) == bytes([1, 2, 3, 1, 2, 3, 6, 7, 8, 12, 18, 22, 19, 26, 33])
    for bad in (b"", b"no file", b"%PDF-1.4\n", b"%PDF-1.4\n1 0 obj << /Type /Catalog >> endobj trailer << /Encrypt 5 0 R >>"):
        with pytest.raises(pdf.PdfError):
            pdf.lines(bad)
    deep = b"%PDF-1.4\n1 0 obj " + b"[" * 5000 + b" endobj"
    with pytest.raises(pdf.PdfError):
        pdf.lines(deep)


def test_pdf_files_to_elements(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(document())
    (tmp_path / "bad.pdf").write_bytes(b"%PDF-1.4\nnothing")
    (tmp_path / "cut.pdf").write_bytes(document()[:900])
    (tmp_path / "t.txt").write_text("plain")
    e, errors = files.parse(files.read_files(spark, str(tmp_path)))
    rows = [(r.type, r.content, r.level, r.page_start, r["items"]) for r in e.where("doc_id like '%a.pdf'").orderBy("ord").collect()]
    assert rows[0] == ("heading", "A large heading", 1, 1, None)
    assert rows[1] == ("paragraph", "Some body text (here) café\nin two lines.", None, 1, None)
    assert rows[2][0] == "bullet_list" and rows[2][4] == ["an item"] and rows[3][:2] == ("paragraph", "scaled")
    assert [r[3] for r in rows if r[0] == "page_break"] == [1, 2, 3]
    assert {r.path.rsplit("/", 1)[1] for r in errors.collect()} >= {"bad.pdf"}
