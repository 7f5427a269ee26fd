"""Text by which files, tables and sections are found, one expression per modality.

Parts that are null or empty are left out; the others stand on lines of their own.
Columns that a frame lacks count as null.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.functions.scalars import clock

# How many sections a file's text names, and characters of what it quotes.
SECTIONS, VIDEO_SECTIONS = 3, 5
SQL_CHARS, TRANSCRIPT_CHARS, OCR_CHARS = 200, 1600, 1200


def filled(x: Column) -> Column:
    """Null instead of empty."""
    return F.when(F.length(x) > 0, x)


def lines(*parts: Column) -> Column:
    """The parts that are there, a line each; null if there are none."""
    return filled(F.trim(F.concat_ws("\n", *(filled(p) for p in parts))))


def _sections(x: Column, of: Callable[[Column], list[Column]], n: int = SECTIONS) -> Column:
    """Lines about the first sections."""
    return F.array_join(F.flatten(F.transform(F.slice(x, 1, n), lambda s: F.array_compact(F.array(*map(filled, of(s)))))), "\n")


def _span(word: str, s: Column, start: str, end: str) -> Column:
    a, b = s[start], s[end]
    many = F.concat(F.lit(f"{word}s "), a.cast("string"), F.lit("-"), b.cast("string"))
    return F.when(a.isNotNull(), F.when(b.isNotNull() & (a != b), many).otherwise(F.concat(F.lit(f"{word} "), a.cast("string"))))


def file_search_text(frame: DataFrame, modality: str) -> Column:
    """Of a file: names, summary and keywords once it is enriched, and what its
    modality tells.  ``sections`` is an array of structs in order (heading, content,
    search_text, and start and end of its place)."""

    def c(name: str) -> Column:
        return F.col(name) if name in frame.columns else F.lit(None)

    def joined(name: str) -> Column:
        return F.array_join(name, ", ") if name in frame.columns else F.lit(None)

    has = "sections" in frame.columns
    names = [c("filename"), c("relative_path")]
    told = [c("file_summary"), joined("file_keywords")]
    enriched = c("file_summary").isNotNull()

    def heads(of=lambda s: [s["heading"]], n: int = SECTIONS) -> Column:
        return _sections(F.col("sections"), of, n) if has else F.lit(None)

    def places(word: str) -> Column:
        with_places = heads(lambda s: [s["heading"], _span(word, s, "start", "end")])
        return F.when(enriched, heads()).otherwise(with_places)

    duration = F.when(c("duration_seconds").isNotNull(), F.format_string("Duration: %.1f seconds", c("duration_seconds").cast("double")))
    size = F.when((c("width") > 0) & (c("height") > 0), F.concat(c("width").cast("string"), F.lit("x"), c("height").cast("string")))
    if modality in ("text", "web"):
        return lines(*names, *told, heads())
    if modality == "sql_script":
        return lines(*names, *told, heads(lambda s: [F.substring(s["content"], 1, SQL_CHARS)]))
    if modality == "document":
        return lines(*names, *told, places("page"))
    if modality == "slideshow":
        return lines(*names, *told, places("slide"))
    if modality == "epub":
        more = [F.when(~enriched, x) for x in (c("language"), F.concat(c("chapter_count").cast("string"), F.lit(" chapters")))]
        return lines(c("title"), *names, joined("creators"), *told, *more, heads())
    if modality == "image":
        flags = (F.when(c(f), F.lit(t)) for f, t in (("is_animated", "animated"), ("has_alpha", "transparent")))
        return lines(*names, c("file_format"), size, c("color_mode"), *flags, *told)
    if modality == "audio":
        return lines(*names, F.lit("Audio transcript"), duration, *told, F.substring(c("transcript_text"), 1, TRANSCRIPT_CHARS))
    if modality == "video":
        own = heads(lambda s: [F.coalesce(filled(s["search_text"]), s["content"])], VIDEO_SECTIONS)
        return lines(*names, F.lit("Video"), duration, F.concat(F.lit("Resolution: "), size), *told, own)
    if modality in ("tabular", "database"):
        described = F.lit(None)
        if "sheet_descriptions" in frame.columns:
            pairs = F.transform(F.map_entries("sheet_descriptions"), lambda e: F.concat_ws(" | ", filled(e["key"]), filled(e["value"])))
            described = F.array_join(F.filter(pairs, lambda x: x != ""), "\n")
        return lines(*names, *told, described)
    raise ValueError(f"unknown modality: {modality}")


def table_search_text(frame: DataFrame) -> Column:
    """Of a table: sheet, rows before the header, header, summary, keywords."""

    def c(name: str) -> Column:
        return F.col(name) if name in frame.columns else F.lit(None)

    def row(r: Column) -> Column:
        return F.array_join(F.filter(r, lambda x: F.length(x) > 0), " | ")

    before = F.array_join(F.filter(F.transform("context", row), lambda x: x != ""), "\n") if "context" in frame.columns else F.lit(None)
    keywords = F.array_join("keywords", ", ") if "keywords" in frame.columns else F.lit(None)
    return lines(c("sheet_name"), c("sheet_description"), before, row(F.col("header")), c("summary"), keywords)


def timed_search_text(content: Column, start: Column, end: Column) -> Column:
    """A stretch of sound: its times, if known, and what is said."""
    times = F.concat(F.lit("["), clock(start), F.lit("-"), clock(end), F.lit("]"))
    return lines(times, content)


def ocr_excerpt(texts: str | Column, most: int = OCR_CHARS) -> Column:
    """Texts read from pictures, joined and cut."""
    return F.substring(F.array_join(texts, "\n"), 1, most)


def table_text(header: Column, n_rows: Column, preview: Column) -> Column:
    """A table for a reader: columns, shape, and its first rows."""
    shape = F.format_string("Shape: (%d, %d)", n_rows.cast("int"), F.size(header))
    rows = F.array_join(F.transform(preview, lambda r: F.array_join(r, " | ")), "\n")
    return F.concat_ws("\n", F.concat(F.lit("Columns: "), F.array_join(header, ", ")), shape, F.lit("Data Preview:"), filled(rows))
