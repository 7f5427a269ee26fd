"""EPUB, DOCX and PPTX files: ZIP archives of XML, read without other libraries.

Each file's bytes go into an Arrow UDF that yields its parts as one struct; sections
are cut from these by DataFrame work (see :mod:`fathom.operators.sections`).
"""

from __future__ import annotations

import hashlib
import io
import posixpath
import re
import zipfile
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.operators import chunking

# Images of a book that are looked at.
MOST_IMAGES = 20
# Media types of chapters, tags that end a line, tags left out.
CHAPTER_TYPES = ("application/xhtml+xml", "text/html")
LINE_TAGS = (
    "address", "article", "aside", "blockquote", "br", "div", "figcaption", "footer", "h1", "h2", "h3", "h4", "h5", "h6",
    "header", "li", "main", "p", "section", "title", "tr",
)
SKIPPED_TAGS = ("script", "style", "nav")

CHAPTERS = pa.list_(pa.struct([("index", pa.int32()), ("href", pa.string()), ("title", pa.string()), ("text", pa.string())]))
IMAGES = pa.list_(
    pa.struct([("index", pa.int32()), ("href", pa.string()), ("media_type", pa.string()), ("digest", pa.string()), ("caption", pa.string())])
)
BOOK = pa.struct(
    [
        ("title", pa.string()),
        ("creators", pa.list_(pa.string())),
        ("language", pa.string()),
        ("publisher", pa.string()),
        ("identifier", pa.string()),
        ("chapters", CHAPTERS),
        ("images", IMAGES),
        ("warnings", pa.list_(pa.string())),
        ("error", pa.string()),
    ]
)
PARAGRAPHS = pa.struct(
    [
        ("chunks", pa.list_(pa.struct([("index", pa.int32()), ("headings", pa.list_(pa.string())), ("slide", pa.int32()), ("text", pa.string())]))),
        ("error", pa.string()),
    ]
)


def local(element: ElementTree.Element) -> str:
    """A tag or attribute without its name space."""
    return (element if isinstance(element, str) else element.tag).rpartition("}")[2]


def clean_lines(text: str) -> str:
    """Lines without outer space, runs of blanks as one, at most one blank line in a row."""
    lines = (re.sub(r"[ \t\f\v]+", " ", x).strip() for x in text.replace("\0", "").replace("\r\n", "\n").replace("\r", "\n").split("\n"))
    return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip()


class _Chapter(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.name: list[str] = []
        self.skipping, self.in_title = 0, False

    def handle_starttag(self, tag, attrs):
        if tag in SKIPPED_TAGS:
            self.skipping += 1
        else:
            self.in_title |= tag == "title"
            self.parts += ["\n"] if tag in LINE_TAGS else []

    def handle_endtag(self, tag):
        if tag in SKIPPED_TAGS and self.skipping:
            self.skipping -= 1
        else:
            self.in_title &= tag != "title"
            self.parts += ["\n"] if tag in LINE_TAGS else []

    def handle_data(self, data):
        if not self.skipping:
            self.parts.append(data)
            self.name += [data] if self.in_title else []


def chapter_text(html: str) -> tuple[str | None, str]:
    """Title and readable text of a chapter's page."""
    page = _Chapter()
    page.feed(html)
    page.close()
    return clean_lines(" ".join(page.name)) or None, chunking.normalized(clean_lines("".join(page.parts)))


def book(data: bytes) -> dict:
    """Metadata, chapters in the order of the spine, and images of an EPUB file.  Parts
    that the archive lacks are left out with a warning; of equal images the first stays,
    among the first MOST_IMAGES."""
    with zipfile.ZipFile(io.BytesIO(data)) as archive:

        def tree(name: str) -> ElementTree.Element:
            return ElementTree.fromstring(archive.read(name))

        roots = (e.get("full-path") for e in tree("META-INF/container.xml").iter() if local(e) == "rootfile")
        package = next((x for x in roots if x), None)
        if package is None:
            raise ValueError("the container names no package file")
        opf, folder = tree(package), posixpath.dirname(package)
        told: dict[str, list[str]] = {}
        items: dict[str, tuple[str, str, str]] = {}
        spine: list[str] = []
        for e in opf.iter():
            if (e.text or "").strip():
                told.setdefault(local(e), []).append(e.text.strip())
            if local(e) == "item" and e.get("id") and e.get("href") and e.get("media-type"):
                href = e.get("href").split("#")[0]
                path = href.lstrip("/") if href.startswith("/") else posixpath.normpath(posixpath.join(folder, href))
                items[e.get("id")] = (path, e.get("media-type"), e.get("properties") or "")
            if local(e) == "spine":
                spine += [x.get("idref") for x in e.iter() if local(x) == "itemref" and x.get("idref")]
        warnings, chapters, images, seen = [], [], [], set()
        there = set(archive.namelist())

        def read(path: str, what: str) -> bytes | None:
            if path in there:
                return archive.read(path)
            warnings.append(f"{what} missing from the archive: {path}")
            return None

        for path, kind, _ in (items[i] for i in spine if i in items):
            page = read(path, "chapter") if kind in CHAPTER_TYPES else None
            title, text = chapter_text(page.decode("utf-8-sig", "replace")) if page is not None else (None, "")
            if text:
                chapters.append({"index": len(chapters) + 1, "href": path, "title": title, "text": text})
        for path, kind, properties in [x for x in items.values() if x[1].startswith("image/")][:MOST_IMAGES]:
            payload = read(path, "image")
            digest = hashlib.sha1(payload).hexdigest() if payload is not None else None
            if digest and digest not in seen:
                seen.add(digest)
                stem = re.sub(r"[_\-]", " ", posixpath.splitext(posixpath.basename(path))[0]).strip()
                caption = " ".join(x for x in (stem, properties) if x) or None
                images.append({"index": len(images) + 1, "href": path, "media_type": kind, "digest": digest, "caption": caption})
        if not chapters:
            warnings.append("The book has no readable text.")
        first = {k: told.get(k, [None])[0] for k in ("title", "language", "publisher", "identifier")}
        return {**first, "creators": told.get("creator", []), "chapters": chapters, "images": images, "warnings": warnings}


def _texts(element: ElementTree.Element) -> str:
    """The runs of a paragraph, with its tabs and breaks."""
    signs = {"tab": "\t", "br": "\n"}
    return "".join(e.text or "" if local(e) == "t" else signs.get(local(e), "") for e in element.iter()).strip()


def document(data: bytes) -> dict:
    """Paragraphs of a DOCX file, each with the headings above it, outermost first."""
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        body = ElementTree.fromstring(archive.read("word/document.xml"))
    chunks, path = [], []
    for p in (e for e in body.iter() if local(e) == "p"):
        text = _texts(p)
        style = next((v for e in p.iter() if local(e) == "pStyle" for k, v in e.attrib.items() if local(k) == "val"), "")
        level = re.fullmatch(r"[Hh]eading ?([1-9])", style) or re.fullmatch(r"()Title", style)
        if level and text:
            path = [*path[: int(level[1] or 1) - 1], text]
        elif text:
            chunks.append({"index": len(chunks) + 1, "headings": path, "slide": None, "text": text})
    return {"chunks": chunks}


def slides(data: bytes) -> dict:
    """Paragraphs of a PPTX file in the order of its slides, with the slide's title."""
    with zipfile.ZipFile(io.BytesIO(data)) as archive:

        def tree(name: str) -> ElementTree.Element:
            return ElementTree.fromstring(archive.read(name))

        targets = {e.get("Id"): e.get("Target") for e in tree("ppt/_rels/presentation.xml.rels")}
        links = [v for e in tree("ppt/presentation.xml").iter() if local(e) == "sldId" for k, v in e.attrib.items() if k.endswith("}id")]
        chunks = []
        for number, link in enumerate((x for x in links if x in targets), 1):
            target = targets[link]
            page = tree(target.lstrip("/") if target.startswith("/") else posixpath.normpath(f"ppt/{target}"))
            title, texts = None, []
            for shape in (e for e in page.iter() if local(e) == "sp"):
                kind = next((e.get("type") for e in shape.iter() if local(e) == "ph"), None)
                own = [t for t in (_texts(p) for p in shape.iter() if local(p) == "p") if t]
                if kind in ("title", "ctrTitle") and own and title is None:
                    title = " ".join(own)
                texts += own
            chunks += [{"index": len(chunks) + k, "headings": [title] if title else [], "slide": number, "text": t} for k, t in enumerate(texts, 1)]
        return {"chunks": chunks}


def _made(reader: Callable[[bytes], dict], kind: pa.DataType):
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            rows = []
            for data in column.to_pylist():
                try:
                    if data is None:
                        raise ValueError("the file's content is missing or too large")
                    rows.append(reader(data))
                except Exception as e:  # one broken file must not stop the others
                    rows.append({"error": f"{type(e).__name__}: {e}"})
            yield pa.array(rows, kind)

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return run


CHUNK = "array<struct<index:int,headings:array<string>,slide:int,text:string>>"
BOOK_KIND = (
    "struct<title:string,creators:array<string>,language:string,publisher:string,identifier:string,"
    "chapters:array<struct<index:int,href:string,title:string,text:string>>,"
    "images:array<struct<index:int,href:string,media_type:string,digest:string,caption:string>>,"
    "warnings:array<string>,error:string>"
)


def read_books(files: DataFrame) -> DataFrame:
    """Listed EPUB files (with content) with ``book``: see :func:`book`; ``book.error``
    is set where a file can't be read."""
    return files.withColumn("book", F.arrow_udf(_made(book, BOOK), BOOK_KIND).asNondeterministic()(F.col("content"))).drop("content")


def read_chunks(files: DataFrame) -> DataFrame:
    """Listed DOCX and PPTX files (with content) with ``parsed``: chunks (index,
    headings, slide, text) and error.  Other suffixes give an error."""
    readers = {".docx": document, ".pptx": slides}

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for contents, suffixes in batches:
            rows = []
            for data, suffix in zip(contents.to_pylist(), suffixes.to_pylist(), strict=True):
                try:
                    if data is None:
                        raise ValueError("the file's content is missing or too large")
                    rows.append(readers[suffix](data))
                except KeyError as e:
                    rows.append({"error": f"unsupported: {suffix}" if suffix not in readers else f"missing part: {e}"})
                except Exception as e:
                    rows.append({"error": f"{type(e).__name__}: {e}"})
            yield pa.array(rows, PARAGRAPHS)

    run.__annotations__ = {"batches": Iterator[tuple[pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    made = F.arrow_udf(run, f"struct<chunks:{CHUNK},error:string>").asNondeterministic()
    return files.withColumn("parsed", made(F.col("content"), F.col("extension"))).drop("content")
