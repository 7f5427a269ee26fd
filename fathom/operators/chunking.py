"""Sections of texts, web pages and SQL scripts.

A text becomes an array of sections in one Arrow UDF and is exploded; the folds
in here are order-dependent, so each works on one text at a time.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Sizes in characters.
MARKDOWN_MOST, MARKDOWN_LEAST = 2400, 400
PLAIN_SIZE, PLAIN_OVERLAP = 1000, 150
SQL_MOST = 2400

# What HTML tags mean.
BLOCKS = frozenset(("p", "div", "section", "article", "main", "aside", "blockquote", "pre", "li", "td", "th"))
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
SKIPPED = frozenset(("script", "style", "noscript", "svg"))

HEADING = re.compile(r"^#{1,6}[^\S\n]+(.*\S)[^\S\n]*$", re.M)
SQL_PARTS = re.compile(r"""'[^']*'?|"[^"]*"?|--[^\n]*|/\*.*?(?:\*/|\Z)|;|[^'"\-/;]+|.""", re.S)


def normalized(text: str) -> str:
    return re.sub(r"\n{3,}", "\n\n", text.replace("\r\n", "\n").replace("\r", "\n")).strip()


def pack(pieces: list[str], joint: str, most: int, divide: Callable[[str], list[str]] | None = None) -> tuple[list[str], bool]:
    """Join pieces in order while they fit ``most``; a larger one is divided, and
    joins nothing.  Also: whether the last chunk is such a joined one."""
    out: list[str] = []
    open_ = False
    for piece in pieces:
        if divide and len(piece) > most:
            out += divide(piece)
            open_ = False
        elif open_ and len(out[-1]) + len(joint) + len(piece) <= most:
            out[-1] += joint + piece
        else:
            out.append(piece)
            open_ = True
    return out, open_


def divided(paragraph: str, most: int) -> list[str]:
    """A large paragraph by sentences; a single sentence by width."""
    sentences = [s.strip() for s in re.split(r"(?<=[.!?])\s+", paragraph)]
    if len(sentences) > 1:
        return pack([s for s in sentences if s], " ", most)[0]
    return [paragraph[i : i + most].strip() for i in range(0, len(paragraph), most)]


def paragraphs(body: str, most: int, least: int) -> list[str]:
    pieces = [p.strip() for p in re.split(r"\n\s*\n", body) if p.strip()]
    out, joined = pack(pieces, "\n\n", most, lambda p: divided(p, most))
    if joined and len(out) > 1 and len(out[-1]) < least and len(out[-2]) + len(out[-1]) + 2 <= most:
        tail = out.pop()
        out[-1] += "\n\n" + tail
    return out


def markdown(text: str, most: int = MARKDOWN_MOST, least: int = MARKDOWN_LEAST) -> list[dict]:
    """Sections under their headings; headings without a body drop."""
    marks = list(HEADING.finditer(text))
    begins = [0, *(m.end() + 1 for m in marks)]
    ends = [*(m.start() for m in marks), len(text)]
    out = []
    for heading, a, b in zip([None, *(m[1].strip() for m in marks)], begins, ends, strict=True):
        line = text.count("\n", 0, min(a, len(text))) + 1
        for chunk in paragraphs(text[a:b].strip(), most, least) if a < b else []:
            out.append({"heading": heading, "content": chunk, "line_start": line, "line_end": line + chunk.count("\n")})
    return out


def plain_pieces(text: str, size: int, overlap: int, joints: tuple[str, ...] = ("\n\n", "\n", ". ", " ")) -> list[str]:
    """Pieces of at most ``size``, cut at the coarsest joint that the text has; a
    joint stays in front of the piece after it.  The end of a piece is repeated
    at the start of the next if that still fits."""
    text = text.strip()
    if len(text) <= size:
        return [text] if text else []
    at = next((i for i, j in enumerate(joints) if j in text), None)
    if at is None:
        cuts = (text[i : i + size].strip() for i in range(0, len(text), max(1, size - overlap)))
        return [c for c in cuts if c]
    first, *rest = text.split(joints[at])
    parts = ([first] if first else []) + [joints[at] + p for p in rest if p]
    out: list[str] = []
    held = ""
    for part in parts:
        if len(held) + len(part) <= size:
            held += part
            continue
        out.append(held.strip())
        held = ""
        if len(part.strip()) <= size:
            held = part
        else:
            out += plain_pieces(part, size, overlap, joints[at + 1 :])
    out = [c for c in (*out, held.strip()) if c]
    for i in range(1, len(out) if overlap > 0 else 0):
        again = out[i - 1][-overlap:].strip()
        if again and not out[i].startswith(again) and len(again) + 1 + len(out[i]) <= size:
            out[i] = f"{again} {out[i]}"
    return out


def plain(text: str, size: int = PLAIN_SIZE, overlap: int = PLAIN_OVERLAP) -> list[dict]:
    found = plain_pieces(text, size, min(overlap, size // 5))
    return [{"heading": None, "content": c, "line_start": None, "line_end": None} for c in found]


class _Page(HTMLParser):
    """Title, description, headings and outermost blocks of a page; a table's rows
    become one block of lines."""

    def __init__(self, tables: bool) -> None:
        super().__init__(convert_charrefs=True)
        self.tables = tables
        self.title: list[str] = []
        self.description = ""
        self.found: list[str] = []
        self.skipping = 0
        self.open: str | None = None  # the tag whose text is gathered
        self.text: list[str] = []
        self.rows: list[list[str]] | None = None

    def shut(self) -> None:
        words = " ".join(" ".join(self.text).split())
        if words and self.open in HEADINGS:
            self.found.append("#" * int(self.open[1]) + " " + words)
        elif words and self.open not in (None, "title"):
            self.found.append(words)
        self.open, self.text = None, []

    def handle_starttag(self, tag, attrs):
        if tag in SKIPPED:
            self.skipping += 1
        elif self.skipping:
            return
        elif tag == "meta":
            a = {k: v or "" for k, v in attrs}
            name = (a.get("name") or a.get("property") or "").lower()
            if name in ("description", "og:description") and not self.description:
                self.description = " ".join(a.get("content", "").split())
        elif self.tables and tag == "table":
            self.shut()
            self.rows = []
        elif self.rows is not None and tag == "tr":
            self.rows.append([])
        elif self.rows is not None and tag in ("td", "th"):
            if not self.rows:
                self.rows.append([])
            self.rows[-1].append("")
        elif tag == "title" or tag in HEADINGS or (tag in BLOCKS and self.open is None):
            self.shut()
            self.open = tag

    def handle_endtag(self, tag):
        if tag in SKIPPED:
            self.skipping = max(0, self.skipping - 1)
        elif self.skipping:
            return
        elif tag == "table" and self.rows is not None:
            lines = ["| " + " | ".join(r) + " |" for r in self.rows if any(r)]
            self.found += ["\n".join(lines)] if lines else []
            self.rows = None
        elif tag == self.open:
            self.shut()

    def handle_data(self, data):
        words = " ".join(data.split())
        if self.skipping or not words:
            return
        if self.rows is not None:
            if self.rows and self.rows[-1]:
                self.rows[-1][-1] = (self.rows[-1][-1] + " " + words).strip()
        elif self.open == "title":
            self.title.append(words)
        elif self.open is not None:
            self.text.append(words)


def web(html: str, most: int = MARKDOWN_MOST, least: int = MARKDOWN_LEAST, tables: bool = True) -> list[dict]:
    """A page as markdown-like text, cut like markdown."""
    page = _Page(tables)
    page.feed(html)
    page.close()
    page.shut()
    title = ["# " + " ".join(page.title)] if page.title else []
    return markdown("\n\n".join([*title, *([page.description] if page.description else []), *page.found]), most, least)


def statements(sql: str) -> list[str]:
    """Statements with their semicolons; quotes and comments hide semicolons."""
    out, held = [], []
    for part in SQL_PARTS.findall(sql):
        held.append(part)
        if part == ";":
            out.append("".join(held).strip())
            held = []
    return [s for s in (*out, "".join(held).strip()) if s]


def sql_script(sql: str, most: int = SQL_MOST) -> list[dict]:
    """Statements packed to ``most`` characters; larger ones are cut by width."""
    cut = lambda s: [p for p in (s[i : i + most].strip() for i in range(0, len(s), most)) if p]
    packed, _ = pack(statements(sql), "\n\n", most, cut)
    return [{"heading": None, "content": c, "line_start": None, "line_end": None} for c in packed]


SECTIONS = "array<struct<chunk_index:int,heading:string,content:string,line_start:int,line_end:int,char_count:int>>"
ARROW_SECTIONS = pa.list_(
    pa.struct(
        [
            ("chunk_index", pa.int32()),
            ("heading", pa.string()),
            ("content", pa.string()),
            ("line_start", pa.int32()),
            ("line_end", pa.int32()),
            ("char_count", pa.int32()),
        ]
    )
)
CUTTERS = {
    "markdown": lambda t: markdown(normalized(t)),
    "text": lambda t: plain(normalized(t)),
    "html": web,
    "sql": sql_script,
}


def cut(rows: DataFrame, text: str, form: str, **how) -> DataFrame:
    """``rows`` without ``text``, one row per section of it: chunk_index from 1,
    heading, content, line_start, line_end, char_count, search_text."""
    cutter = CUTTERS[form] if not how else {"html": web, "sql": sql_script, "text": plain, "markdown": markdown}[form]

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            yield pa.array(
                [
                    [dict(s, chunk_index=i, char_count=len(s["content"])) for i, s in enumerate(cutter(t or "", **how), 1)]
                    for t in column.to_pylist()
                ],
                ARROW_SECTIONS,
            )

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    made = F.explode(F.arrow_udf(run, SECTIONS)(F.col(text)))
    others = [c for c in rows.columns if c != text]
    search = F.concat_ws("\n", F.when(F.length("s.heading") > 0, F.col("s.heading")), F.col("s.content"))
    return rows.select(*others, made.alias("s")).select(*others, "s.*", search.alias("search_text"))
