"""Hand-made PDF files of both kinds of cross reference."""

import zlib

import pyarrow as pa
import pytest

from fathom.operators import sections
from fathom.sources import files, pdf

PLAIN = b"<</Type/Font/Subtype/Type1/BaseFont/F/Encoding/WinAnsiEncoding>>"


def stream(data, told=b"", packed=True):
    body = zlib.compress(data) if packed else data
    return b"<<" + told + (b"/Filter/FlateDecode" if packed else b"") + b"/Length %d>>stream\r\n" % len(body) + body + b"\nendstream"


def written(objects, trailer=b"<</Root 1 0 R>>", table=True):
    """A file of numbered objects, with a table of places or without."""
    out, places = b"%PDF-1.7\n%\xe2\xe3\xcf\xd3\n", []
    for number, body in objects.items():
        places.append(len(out))
        out += b"%d 0 obj\n" % number + body + b"\nendobj\n"
    if not table:
        return out + b"startxref\n0\n%%EOF"
    rows = b"".join(b"%010d 00000 n \n" % p for p in places)
    return out + b"xref\n0 %d\n0000000000 65535 f \n" % (len(places) + 1) + rows + b"trailer\n" + trailer + b"\nstartxref\n%d\n%%%%EOF" % len(out)


def pages(*contents, font=PLAIN, more=None):
    """Objects of a file with a page for each content; resources stand above the pages."""
    found = {1: b"<</Type/Catalog/Pages 2 0 R>>"}
    kids = b" ".join(b"%d 0 R" % (10 + 2 * i) for i in range(len(contents)))
    found[2] = b"<</Type/Pages/Kids[" + kids + b"]/Count %d/Resources<</Font<</F1 3 0 R>>>>>>" % len(contents)
    found[3] = font
    for i, c in enumerate(contents):
        found[10 + 2 * i] = b"<</Type/Page/Parent 2 0 R/Contents %d 0 R>>" % (11 + 2 * i)
        found[11 + 2 * i] = stream(c)
    return found | (more or {})


def packed(objects):
    """The same file with plain objects in an object stream, and a cross-reference stream."""
    inner = {n: b for n, b in objects.items() if b"stream\r\n" not in b}
    heads, bodies = b"", b""
    for n, b in inner.items():
        heads += b"%d %d " % (n, len(bodies))
        bodies += b + b" "
    rest = {n: b for n, b in objects.items() if n not in inner}
    rest[90] = stream(heads + bodies, b"/Type/ObjStm/N %d/First %d" % (len(inner), len(heads)))
    # Rows with a predictor, as usual; what they hold isn't needed.
    rest[91] = stream(b"\x02" + bytes(4) + b"\x02" + bytes(4), b"/Type/XRef/Root 1 0 R/Size 92/W[1 2 1]/DecodeParms<</Predictor 12/Columns 4>>")
    return written(rest, table=False)


TEXT = b"BT /F1 12 Tf 72 700 Td (Hello \\(wide\\) w\\157rld) Tj 0 -14 Td (second ) Tj (line) Tj 0 -40 Td [(Para) -30 (graph) -400 (two)] TJ ET"
WANT = "Hello (wide) world\nsecond line\n\nParagraph two"


def texts(data):
    return [pdf.page_text(p["content"], p["fonts"]) for p in pdf.Document(data).told()]


@pytest.mark.parametrize("make", [written, packed])
def test_both_kinds_of_cross_reference(make):
    assert texts(make(pages(TEXT, b"BT /F1 9 Tf (page two) Tj ET"))) == [WANT, "page two"]


def test_later_objects_count():
    first = written(pages(b"BT /F1 9 Tf (old) Tj ET"))
    again = b"11 0 obj\n" + stream(b"BT /F1 9 Tf (new) Tj ET") + b"\nendobj\ntrailer\n<</Root 1 0 R/Prev 0>>\n%%EOF"
    assert texts(first + again) == ["new"]


def test_character_maps():
    """Codes of two bytes, single and in ranges, with and without a list."""
    cmap = b"1 begincodespacerange <0000><ffff> endcodespacerange 2 beginbfchar <0003><0020> <0010><D83DDE00> endbfchar 2 beginbfrange <0024><0026><0041> <0030><0031>[<00E9><00660069>] endbfrange"
    font = b"<</Type/Font/Subtype/Type0/Encoding/Identity-H/ToUnicode 5 0 R>>"
    data = written(pages(b"BT /F1 10 Tf <0024002500260003003000310010> Tj ET", font=font, more={5: stream(cmap)}))
    assert texts(data) == ["ABC éfi\U0001f600"]


def test_encodings_and_differences():
    font = b"<</Type/Font/Subtype/TrueType/FirstChar 65/Widths[900 200]/Encoding<</Differences[65/eacute.alt/fi 67/uni20AC/B]>>>>"
    assert texts(written(pages(b"BT /F1 10 Tf (BCD) Tj ET", font=font))) == ["fi€B"]
    mac = b"<</Type/Font/Subtype/Type1/Encoding/MacRomanEncoding>>"
    assert texts(written(pages(b"BT /F1 10 Tf (caf\x8e) Tj ET", font=mac))) == ["café"]
    assert texts(written(pages(b"BT /F1 10 Tf (\x93caf\xe9\x94) Tj ET"))) == ["“café”"]


def test_places_tell_blanks_and_lines():
    """Words placed one by one, by matrices, and a gap that belongs to a word."""
    data = b"BT /F1 10 Tf 1 0 0 1 10 100 Tm (ab) Tj 1 0 0 1 26 100 Tm (cd) Tj 1 0 0 1 36.2 100 Tm (ef) Tj 1 0 0 1 10 88 Tm (gh) Tj 12 TL T* (ij) Tj (kl) ' ET"
    assert texts(written(pages(data))) == ["ab cdef\ngh\nij\nkl"]
    scaled = b"q 0.1 0 0 0.1 0 0 cm BT /F1 100 Tf 100 1000 Td (big) Tj 0 -120 Td (units) Tj ET Q"
    assert texts(written(pages(scaled))) == ["big\nunits"]


def test_forms_and_pictures_between():
    form = stream(b"BT /F1 10 Tf 10 50 Td (in a form) Tj ET", b"/Type/XObject/Subtype/Form/Resources<</Font<</F1 3 0 R>>>>")
    own = pages(b"BI /W 1 /H 1 ID (not text) Tj EI q /X1 Do Q BT /F1 10 Tf 10 20 Td (after) Tj ET", more={6: form})
    own[2] = own[2].replace(b"/Resources<<", b"/Resources<</XObject<</X1 6 0 R>>")
    assert texts(written(own)) == ["in a form\n\nafter"]


def test_a_circle_of_pages_ends():
    own = pages(b"BT /F1 10 Tf (x) Tj ET")
    own[2] = own[2].replace(b"/Kids[", b"/Kids[2 0 R ")
    assert texts(written(own)) == ["x"]


@pytest.fixture(scope="module")
def lake(tmp_path_factory):
    root = tmp_path_factory.mktemp("pdfs")
    encrypted = written(pages(TEXT), trailer=b"<</Root 1 0 R/Encrypt<</Filter/Standard>>>>")
    made = {
        "a.pdf": written(pages(TEXT, b"BT /F1 9 Tf ( \t) Tj ET", b"BT /F1 9 Tf (the last page) Tj ET")),
        "b.pdf": packed(pages(TEXT)),
        "locked.pdf": encrypted,
        "pictures.pdf": written(pages(b"q 10 0 0 10 0 0 cm /Im1 Do Q")),
        "broken.pdf": b"%PDF-1.4\n1 0 obj <</Type/Cat",
        "other.pdf": b"no such file kind",
    }
    for name, data in made.items():
        (root / name).write_bytes(data)
    return str(root)


def test_pages_to_sections(spark, lake):
    pages_ = pdf.read_pages(files.listing(spark, lake, suffixes=(".pdf",), content=True)).cache()
    found = sections.document_sections(pdf.chunks(pages_), "relative_path").collect()
    assert sorted((r.relative_path, r.content, r.page_start, r.page_end) for r in found) == [
        ("a.pdf", "Hello (wide) world\nsecond line", 1, 1), ("a.pdf", "Paragraph two", 1, 1), ("a.pdf", "the last page", 3, 3),
        ("b.pdf", "Hello (wide) world\nsecond line", 1, 1), ("b.pdf", "Paragraph two", 1, 1),
    ]
    wrong = {r.relative_path: r.error_message for r in pdf.failed(pages_).collect()}
    assert set(wrong) == {"locked.pdf", "pictures.pdf", "broken.pdf", "other.pdf"}
    assert "encrypted" in wrong["locked.pdf"] and "pictures" in wrong["pictures.pdf"] and "not a PDF" in wrong["other.pdf"]


def test_reading_files_that_nothing_has_indexed(spark, lake, tmp_path):
    """Whatever kind a file is, its content or why there is none."""
    import shutil

    from fathom.operators import readers, retrieval

    for name in ("a.pdf", "locked.pdf"):
        shutil.copy(f"{lake}/{name}", tmp_path / name)
    (tmp_path / "notes.txt").write_text("some notes")
    (tmp_path / "t.csv").write_text("k,v\n1,x\n")
    (tmp_path / "s.wav").write_bytes(b"RIFF....WAVE")
    listed = files.listing(spark, str(tmp_path))
    got = {r.filename: r.content for r in readers.reader(spark, str(tmp_path))(listed).collect()}
    assert got["a.pdf"].startswith("Hello (wide) world") and got["a.pdf"].endswith("the last page")
    assert "encrypted" in got["locked.pdf"] and got["notes.txt"] == "some notes" and "no reader" in got["s.wav"]
    assert got["t.csv"].startswith("t\n") and "k" in got["t.csv"]
    asked = retrieval.retrieve({}, listed, "document", "what does a.pdf say?", readers.reader(spark, str(tmp_path)))
    assert [r.filename for r in asked.collect()] == ["a.pdf"]


def test_pages_are_sent_on_as_they_are_read(monkeypatch):
    """A batch of many files isn't held: what is sent at once has a bound, and pages that share
    a font hold it once."""
    monkeypatch.setattr(pdf, "SENT_BYTES", 10_000)
    page = b"%d 0 obj<</Type/Page/Parent 2 0 R/Contents 9 0 R>>endobj\n"
    file = (
        b"%PDF-1.4\n1 0 obj<</Type/Catalog/Pages 2 0 R>>endobj\n2 0 obj<</Type/Pages/Resources<</Font<</F1 3 0 R>>>>/Kids[20 0 R 21 0 R 22 0 R]>>endobj\n"
        b"3 0 obj<</Type/Font/Subtype/Type1/Encoding/WinAnsiEncoding>>endobj\n9 0 obj<</Length 0>>stream\nBT /F1 10 Tf 9 9 Td (Buoy) Tj ET\nendstream\nendobj\n"
    ) + b"".join(page % k for k in (20, 21, 22)) + b"trailer<</Root 1 0 R>>\n%%EOF"
    batch = pa.RecordBatch.from_pydict({"relative_path": [f"{i}.pdf" for i in range(200)], "content": [None, b"?", *[file] * 198]})
    sent = list(pdf._told(iter([batch])))
    assert len(sent) > 50 and max(b.nbytes for b in sent) < 20_000
    rows = [r for b in sent for r in b.to_pylist()]
    assert len(rows) == 2 + 3 * 198 and rows[0]["error"] and rows[1]["error"] and {r["error"] for r in rows[2:]} == {None}
    assert [r["page"] for r in rows[2:5]] == [1, 2, 3]
    told = pa.RecordBatch.from_pylist(rows)
    texts = next(pdf._shown(iter([(told.column("content"), told.column("fonts"))]))).to_pylist()
    assert texts[:2] == ["", ""] and set(texts[2:]) == {"Buoy"}
    one = list(pdf.Document(file).told())
    assert one[0]["fonts"][0]["codes"] is one[2]["fonts"][0]["codes"]
