"""Books, documents, slides, pictures, sound: made here, read back."""

import hashlib
import io
import json
import struct
import wave
import zipfile
import zlib

import pytest

from fathom.operators import sections, transcripts
from fathom.sources import archives, files, media


def zipped(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in parts.items():
            z.writestr(name, data)
    return out.getvalue()


OPF = """<package xmlns="http://www.idpf.org/2007/opf" xmlns:dc="http://purl.org/dc/elements/1.1/"><metadata>
<dc:title>The Tide Tables</dc:title><dc:creator>N. Ebb</dc:creator><dc:creator>S. Flow</dc:creator><dc:language>en</dc:language></metadata>
<manifest><item id="two" href="text/two.xhtml" media-type="application/xhtml+xml"/><item id="one" href="text/one.xhtml#top" media-type="application/xhtml+xml"/>
<item id="lost" href="text/lost.xhtml" media-type="application/xhtml+xml"/><item id="css" href="a.css" media-type="text/css"/>
<item id="p1" href="img/sea_chart.png" media-type="image/png" properties="cover-image"/><item id="p2" href="img/copy.png" media-type="image/png"/></manifest>
<spine><itemref idref="one"/><itemref idref="nowhere"/><itemref idref="css"/><itemref idref="lost"/><itemref idref="two"/></spine></package>"""
EPUB = {
    "META-INF/container.xml": '<container><rootfiles><rootfile full-path="OEBPS/book.opf"/></rootfiles></container>',
    "OEBPS/book.opf": OPF,
    "OEBPS/text/one.xhtml": "<html><head><title>Neaps</title><style>p{}</style></head><body><nav>skip</nav><h1>Neaps</h1><p>Low  <b>water</b></p><p>&amp; slack.</p></body></html>",
    "OEBPS/text/two.xhtml": "<html><body><p>Springs run high.</p></body></html>",
    "OEBPS/img/sea_chart.png": b"same bytes",
    "OEBPS/img/copy.png": b"same bytes",
}


def lake(spark, tmp_path, made):
    for name, data in made.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data if isinstance(data, bytes) else data.encode())
    return files.listing(spark, str(tmp_path), content=True)


def test_books(spark, tmp_path):
    made = {"b/tides.epub": zipped(EPUB), "broken.epub": b"PK\x03\x04 no", "bare.epub": zipped({"x": "y"})}
    books = archives.read_books(lake(spark, tmp_path, made))
    got = {r.relative_path: r.book for r in books.collect()}
    b = got["b/tides.epub"]
    assert (b.title, b.creators, b.language, b.error) == ("The Tide Tables", ["N. Ebb", "S. Flow"], "en", None)
    assert [(c["index"], c.href, c.title) for c in b.chapters] == [(1, "OEBPS/text/one.xhtml", "Neaps"), (2, "OEBPS/text/two.xhtml", None)]
    assert b.chapters[0].text == "Neaps\n\nNeaps\n\nLow water\n\n& slack."
    assert b.warnings == ["chapter missing from the archive: OEBPS/text/lost.xhtml"]
    assert [(i["index"], i.href, i.caption, i.digest) for i in b.images] == [
        (1, "OEBPS/img/sea_chart.png", "sea chart cover-image", hashlib.sha1(b"same bytes").hexdigest())
    ]
    assert got["broken.epub"].error and got["bare.epub"].error
    rows = sections.book_sections(books).orderBy("chunk_index").collect()
    assert [(r.chunk_index, r.chapter_index, r.heading) for r in rows] == [(1, 1, "Neaps"), (2, 2, "Chapter 2")]
    assert rows[1].content == "# Chapter 2\n\nSprings run high."
    assert rows[1].search_text == "Chapter 2\nEPUB: The Tide Tables\nPath: b/tides.epub\nChapter 2: Chapter 2\n# Chapter 2\n\nSprings run high."
    source = "source_" + hashlib.sha1(b"b/tides.epub").hexdigest()[:16]
    assert rows[0].section_id == "section_" + hashlib.sha1(f"{source}:chapter:1:chunk:1".encode()).hexdigest()[:16]


def paragraph(text, style=None):
    mark = f'<w:pPr><w:pStyle w:val="{style}"/></w:pPr>' if style else ""
    return f"<w:p>{mark}<w:r><w:t>{text}</w:t></w:r></w:p>"


def test_documents_and_slides(spark, tmp_path):
    body = paragraph("Pilotage", "Heading1") + paragraph("Call first.") + paragraph("By night", "Heading2") + paragraph("Show a light.") + paragraph("Fees", "Heading1") + paragraph("None.") + paragraph(" ")
    docx = zipped({"word/document.xml": f'<w:document xmlns:w="http://w"><w:body>{body}</w:body></w:document>'})

    def slide(title, *texts):
        shapes = f'<p:sp><p:nvPr><p:ph type="title"/></p:nvPr><a:p><a:r><a:t>{title}</a:t></a:r></a:p></p:sp>'
        shapes += "".join(f"<p:sp><a:p><a:r><a:t>{t}</a:t></a:r></a:p></p:sp>" for t in texts)
        return f'<p:sld xmlns:p="http://p" xmlns:a="http://a">{shapes}</p:sld>'

    pptx = zipped(
        {
            "ppt/presentation.xml": '<p:presentation xmlns:p="http://p" xmlns:r="http://r"><p:sldIdLst><p:sldId r:id="b"/><p:sldId r:id="a"/></p:sldIdLst></p:presentation>',
            "ppt/_rels/presentation.xml.rels": '<R><x Id="a" Target="slides/slide1.xml"/><x Id="b" Target="slides/slide2.xml"/></R>',
            "ppt/slides/slide1.xml": slide("Second", "last words"),
            "ppt/slides/slide2.xml": slide("First", "alpha", "beta"),
        }
    )
    got = {r.relative_path: r.parsed for r in archives.read_chunks(lake(spark, tmp_path, {"a.docx": docx, "b.pptx": pptx, "c.doc": b"x", "d.docx": b"x"})).collect()}
    assert [(c.headings, c.text) for c in got["a.docx"].chunks] == [
        (["Pilotage"], "Call first."), (["Pilotage", "By night"], "Show a light."), (["Fees"], "None.")
    ]
    assert [(c["index"], c.slide, c.text) for c in got["b.pptx"].chunks] == [(1, 1, "First"), (2, 1, "alpha"), (3, 1, "beta"), (4, 2, "Second"), (5, 2, "last words")]
    assert got["c.doc"].error == "unsupported: .doc" and got["d.docx"].error


def test_slides_are_merged_while_short(spark):
    rows = [
        (1, "A", "x" * 100, 1), (2, "B", "y" * 100, 1), (3, "A", "z" * 1000, 1), (4, "A", "w" * 600, 1), (5, "A", "v" * 50, 1),
        (6, "A one", "u" * 200, 2), (7, "A", "t" * 200, 2), (8, "B", "s" * 100, 2), (9, None, "r" * 50, 2), (10, "q", "p", 1),
    ]
    chunks = spark.createDataFrame([("d", i, h, t, s, s) for i, h, t, s in rows], "source_id string, index int, heading string, content string, slide_start int, slide_end int")
    got = [(r.chunk_index, r.heading, [x[0] for x in r.content.split("\n")], r.slide_start) for r in sections.slide_sections(chunks).orderBy("chunk_index").collect()]
    # 100 + 100 merge whatever the headings say; 201 + 1000 is too long; so is 1000 + 600; 600 takes nothing more.
    assert got == [
        (1, "A", ["x", "y"], 1), (2, "A", ["z"], 1), (3, "A", ["w"], 1), (4, "A", ["v"], 1),
        (5, "A one", ["u", "t"], 2), (6, "B", ["s", "r"], 2), (7, "q", ["p"], 1),
    ]


def test_files_to_sections_in_one_call(spark, tmp_path):
    made = {
        "n/log.md": "﻿# Watch\nCalm.\n\n## Noon\nWind.", "s.sql": "SELECT 1;\nSELECT 2;", "p.htm": "<h1>Pier</h1><p>Long.</p>", "t.txt": "just text", "e.txt": "  ", "c.csv": "a,b"
    }
    got = sections.file_sections(lake(spark, tmp_path, made)).orderBy("relative_path", "chunk_index").collect()
    assert [(r.relative_path, r.heading, r.content) for r in got] == [
        ("n/log.md", "Watch", "Calm."), ("n/log.md", "Noon", "Wind."), ("p.htm", "Pier", "Long."),
        ("s.sql", None, "SELECT 1;\n\nSELECT 2;"), ("t.txt", None, "just text"),
    ]
    source = "source_" + hashlib.sha1(b"n/log.md").hexdigest()[:16]
    assert got[1].section_id == "section_" + hashlib.sha1(f"{source}:2:Noon".encode()).hexdigest()[:16]
    assert got[2].section_id.startswith("websec_")


def chunk(name, data):
    return struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))


def test_pictures(spark, tmp_path):
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 40, 30, 8, 6, 0, 0, 0)) + chunk(b"acTL", struct.pack(">II", 3, 0)) + chunk(b"IDAT", b"")
    gif = b"GIF89a" + struct.pack("<HHBBB", 20, 9, 0x80, 0, 0) + b"\0" * 6
    gif += (b"\x21\xf9\x04\x01\0\0\0\0" + b"\x2c" + struct.pack("<HHHHB", 0, 0, 20, 9, 0) + b"\x02\x01\x00\x00") * 2 + b"\x3b"
    jpeg = b"\xff\xd8\xff\xe0" + struct.pack(">H", 4) + b"\0\0" + b"\xff\xc0" + struct.pack(">HBHHB", 17, 8, 50, 60, 3) + b"\0" * 12
    webp = b"RIFF" + struct.pack("<I", 30) + b"WEBPVP8L" + struct.pack("<I", 10) + b"\x2f" + ((99) | (49 << 14) | (1 << 28)).to_bytes(4, "little") + b"\0" * 8
    tiff = b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", 3) + b"".join(struct.pack("<HHI", t, 3, 1) + struct.pack("<HH", v, 0) for t, v in ((256, 70), (257, 80), (277, 3))) + struct.pack("<I", 0)
    made = {"a.png": png, "b.gif": gif, "c.jpg": jpeg, "d.webp": webp, "e.tif": tiff, "f.png": b"no picture", "g.png": png[:20]}
    got = {r.relative_path: r.image for r in media.images(lake(spark, tmp_path, made)).collect()}
    assert tuple(got["a.png"])[:7] == ("png", 40, 30, "RGBA", True, 3, True)
    assert tuple(got["b.gif"])[:7] == ("gif", 20, 9, "P", True, 2, True)
    assert tuple(got["c.jpg"])[:7] == ("jpeg", 60, 50, "RGB", False, 1, False)
    assert tuple(got["d.webp"])[:7] == ("webp", 100, 50, "RGBA", True, 1, False)
    assert tuple(got["e.tif"])[:7] == ("tiff", 70, 80, "RGB", False, 1, False)
    assert got["f.png"].error and got["g.png"].error
    fit = media.images(lake(spark, tmp_path, {})).filter(media.large_enough("image.width", "image.height"))
    assert {r.relative_path for r in fit.collect()} == {"a.png", "c.jpg", "d.webp", "e.tif"}


def test_sound(spark, tmp_path):
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(2)
        w.setsampwidth(2)
        w.setframerate(8000)
        w.writeframes(b"\0" * 4 * 12_000)
    flac = b"fLaC\x80\0\0\x22" + b"\0" * 10 + ((44_100 << 44) | (1 << 41) | (15 << 36) | 88_200).to_bytes(8, "big") + b"\0" * 16
    got = {r.relative_path: r.sound for r in media.sounds(lake(spark, tmp_path, {"a.wav": out.getvalue(), "b.flac": flac, "c.mp3": b"ID3"})).collect()}
    assert tuple(got["a.wav"])[:4] == ("pcm_s16le", 8000, 2, 1.5)
    assert tuple(got["b.flac"])[:4] == ("flac", 44_100, 2, 2.0)
    assert got["c.mp3"].duration_seconds is None and got["c.mp3"].warnings


def test_imported_transcripts(spark, tmp_path):
    sha = hashlib.sha1(b"one").hexdigest()
    told = {
        "a/one.mp3.json": {"model": "m1", "source_sha1": sha, "segments": [{"text": "Hello there.", "start_seconds": 0, "end_seconds": "4"}, {"text": " "}, {"text": "Bye."}]},
        "one.json": {"text": "not this one"},
        "two.json": {"full_text": "All of it.", "duration_seconds": 9.5},
        "three.mp3.json": {"source_sha1": "00", "text": "x"},
        "four.json": {"text": ""},
    }
    for name, data in told.items():
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_text(json.dumps(data))
    sounds = spark.createDataFrame([(p, p.split("/")[-1], sha) for p in ("a/one.mp3", "two.wav", "three.mp3", "four.ogg", "five.ogg")], "relative_path string, filename string, sha1 string")
    found = transcripts.imported(sounds, transcripts.read_transcripts(spark, str(tmp_path)))
    got = {(r.relative_path, r.segment): r for r in found.collect()}
    assert [(got["a/one.mp3", k].text, got["a/one.mp3", k].end_seconds) for k in (0, 1)] == [("Hello there.", 4.0), ("Bye.", None)]
    assert (got["two.wav", 0].text, got["two.wav", 0].start_seconds, got["two.wav", 0].end_seconds, got["two.wav", 0].model_name) == ("All of it.", 0.0, 9.5, "imported_transcript")
    assert "checksum" in got["three.mp3", None].error and "no text" in got["four.ogg", None].error
    assert not any(p == "five.ogg" for p, _ in got)


def test_sections_of_sound_and_video(spark):
    long = " ".join(f"word{i}" for i in range(400))
    segments = spark.createDataFrame([("v", 0, "First words.", 0.0, 5.0), ("v", 1, long, 5.0, 65.0), ("v", 2, None, 1.0, 2.0)], "source_id string, segment int, text string, start_seconds double, end_seconds double")
    spoken = transcripts.sound_sections(segments)
    rows = spoken.orderBy("chunk_index").collect()
    n = len(rows) - 1
    assert n >= 3 and [r.chunk_index for r in rows] == list(range(1, n + 2))
    assert rows[0].search_text == "[00:00-00:05]\nFirst words."
    assert rows[-1].end_seconds == pytest.approx(65) and rows[1].end_seconds == pytest.approx(5 + 60 / n)
    captions = spark.createDataFrame([("v", 1, 2.0, "a mast"), ("v", 2, 4.0, "  "), ("w", 1, 1.0, "a gull")], "source_id string, frame_index int, timestamp_seconds double, content string")
    both = {(r.source_id, r.chunk_index): r for r in transcripts.video_sections(spoken, captions).collect()}
    assert both["v", n + 2].content == "a mast" and both["v", n + 2].search_text == "[00:02-00:02]\na mast"
    assert both["w", 1].section_type == "frame_caption" and len(both) == n + 3
    pictures = spark.createDataFrame([("v", 1, "image_ocr", "SS ADA"), ("v", 1, "image_summary", ""), ("x", 2, "image_summary", "a pier")], "source_id string, image_index int, section_type string, content string")
    more = sections.with_pictures(spoken, pictures).filter("section_type is not null").collect()
    assert {(r.source_id, r.chunk_index, r.content) for r in more} == {("v", n + 2, "SS ADA"), ("x", 1, "a pier")}


def test_large_texts(spark, tmp_path):
    """No file vanishes: one that is too large to be held tells so, and is read by stretches."""
    from fathom.operators import sections
    from fathom.sources import files

    paragraphs = [f"Paragraph {i} of some words, " + "more of them " * (i % 9) for i in range(400)]
    (tmp_path / "big one.txt").write_text("\ufeff" + "\n\n".join(paragraphs) + "\n")
    (tmp_path / "big.md").write_text("\n".join(f"# Head {i}\n\nbody {i}" for i in range(300)))
    (tmp_path / "small.txt").write_text("small")
    old, files.LARGEST = files.LARGEST, 1000
    try:
        listed = files.listing(spark, str(tmp_path), content=True).cache()
        assert {r.relative_path for r in sections.file_sections(listed).collect()} == {"small.txt"}
        assert {(r.relative_path, r.status) for r in sections.unread(listed).collect()} == {("big one.txt", "error"), ("big.md", "error")}
    finally:
        files.LARGEST = old
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        rows = sections.large_sections(spark, str(tmp_path), ["big one.txt", "big.md"], 700).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    text = sorted((r.chunk_index, r.content) for r in rows if r.relative_path == "big one.txt")
    assert [n for n, _ in text] == list(range(1, len(text) + 1)) and len(text) > 20
    heads = sorted((r.chunk_index, r.heading, r.content) for r in rows if r.relative_path == "big.md")
    assert [(h, c) for _, h, c in heads] == [(f"Head {i}", f"body {i}") for i in range(300)]
    # Sections of a stretch overlap, but none goes missing.
    assert all(any(p.strip()[-20:] in c for _, c in text) for p in paragraphs)
