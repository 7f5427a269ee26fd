"""Sections of documents, slides, audio and video: grouping, windows, sampling."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fathom.functions.scalars import strip


def even_sample(rows: DataFrame, group: list[str], order: list[str], k: int) -> DataFrame:
    """``k`` rows of each group, evenly spread in order, the first and the last
    among them; all if there are no more than ``k``; the first if ``k`` is 1."""
    by = Window.partitionBy(*group)
    place = F.row_number().over(by.orderBy(*order)) - 1
    n = F.count(F.lit(1)).over(by)
    if k == 1:
        wanted = F.col("__place") == 0
    else:
        # Place p * (n - 1) div (k - 1) is met for the least p that can reach it.
        p = F.ceil(F.col("__place") * (k - 1) / (F.col("__n") - 1))
        reached = F.floor(p * (F.col("__n") - 1) / (k - 1)) == F.col("__place")
        wanted = (F.col("__n") <= k) | reached
    return rows.withColumn("__place", place).withColumn("__n", n).filter(wanted).drop("__place", "__n")


def islands(rows: DataFrame, group: list[str], order: list[str], same: list[str], name: str = "island") -> DataFrame:
    """``rows`` with the number of the run of equal ``same`` columns they stand in,
    counted from 0 in each group."""
    by = Window.partitionBy(*group).orderBy(*order)
    changed = F.lit(False)
    for c in same:
        changed = changed | ~F.col(c).eqNullSafe(F.lag(c).over(by))
    first = F.row_number().over(by) == 1
    step = F.when(changed & ~first, 1).otherwise(0)
    return rows.withColumn("__step", step).withColumn(name, F.sum("__step").over(by)).drop("__step")


def audio_windows(duration: Column, window: float = 600.0, overlap: float = 8.0) -> Column:
    """Array of (start, end) that cover the duration, each overlapping the next,
    until one reaches the end."""
    step = window - overlap
    last = F.greatest(F.lit(0), F.ceil((duration - window) / step).cast("int"))
    spans = F.transform(
        F.sequence(F.lit(0), last),
        lambda i: F.struct((i * step).alias("start"), F.least(i * step + window, duration).alias("end")),
    )
    return F.when(duration > 0, spans)


def time_share(index: Column, count: Column, start: Column, end: Column) -> Column:
    """The part of a transcript's span that falls to chunk ``index`` of ``count``."""
    width = F.try_divide(end - start, count)
    return F.struct((start + index * width).alias("start_seconds"), (start + (index + 1) * width).alias("end_seconds"))


def page_range(pages: str) -> Column:
    return F.struct(F.array_min(pages).alias("start"), F.array_max(pages).alias("end"))


def heading_path(parts: str) -> Column:
    """Non-empty headings from the outside in, joined."""
    return F.array_join(F.filter(F.transform(F.col(parts), strip), lambda h: F.length(h) > 0), " > ")


# Characters of a slide's sections.
SLIDE_LEAST, SLIDE_ENOUGH, SLIDE_MOST = 140, 500, 1200
# Sections of a script that are shown to a model.
SQL_HEAD = 12


def document_sections(chunks: DataFrame, source: str = "source_id") -> DataFrame:
    """(source, chunk_index, heading, content, page_start, page_end, char_count) of
    ``chunks``: source, index, headings (array), text, and pages (array of int, may be
    null).  Chunks without text drop, and leave gaps in the index."""
    text = strip("text")
    kept = chunks.withColumn("content", text).filter(F.length("content") > 0)
    pages = page_range("pages") if "pages" in chunks.columns else F.struct(F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("end"))
    path = heading_path("headings")
    return kept.select(
        source,
        F.col("index").alias("chunk_index"),
        F.when(F.length(path) > 0, path).alias("heading"),
        "content",
        pages["start"].alias("page_start"),
        pages["end"].alias("page_end"),
        F.length("content").alias("char_count"),
    )


def slide_sections(
    chunks: DataFrame, source: str = "source_id", least: int = SLIDE_LEAST, enough: int = SLIDE_ENOUGH, most: int = SLIDE_MOST,
    trim: Callable[[Column | str], Column] = strip,
) -> DataFrame:
    """Sections of slides: (source, chunk_index, heading, content, slide_start,
    slide_end, char_count).

    ``chunks``: source, index, heading, content, slide_start, slide_end.  Chunks of the
    same slides in a row are merged in order while they fit ``most``: one shorter
    than ``least`` takes what follows, one of ``enough`` takes nothing more, and between
    these the headings must agree (one begins with the other, or is missing).  Chunks of white space drop.
    ``trim`` takes white space from a content's ends: of any kind, unless another is given.
    """
    filled = chunks.withColumn("content", trim("content")).filter(F.length("content") > 0)
    runs = islands(filled, [source], ["index"], ["slide_start", "slide_end"])
    one = F.struct("index", "heading", "content", "slide_start", "slide_end")
    grouped = runs.groupBy(source, "island").agg(F.array_sort(F.collect_list(one)).alias("parts"))  # a slide's chunks

    def agree(a: Column, b: Column) -> Column:
        none = (F.coalesce(F.length(a), F.lit(0)) == 0) | (F.coalesce(F.length(b), F.lit(0)) == 0)
        return none | F.startswith(a, b) | F.startswith(b, a)

    def joined(a: Column, b: Column) -> Column:
        c = [F.when(F.length(trim(x)) > 0, trim(x)) for x in (a, b)]
        return F.concat_ws("\n", *c)

    def step(state: Column, part: Column) -> Column:
        now = F.element_at(state, -1)
        n, m = F.length(now["content"]), F.length(part["content"])
        fits = n + m <= most
        merge = F.when(n < least, fits).when(n >= enough, False).otherwise(fits & agree(now["heading"], part["heading"]))
        both = F.struct(
            now["index"].alias("index"),
            F.when(F.length(now["heading"]) > 0, now["heading"]).otherwise(part["heading"]).alias("heading"),
            joined(now["content"], part["content"]).alias("content"),
            now["slide_start"].alias("slide_start"),
            now["slide_end"].alias("slide_end"),
        )
        before = F.slice(state, F.lit(1), F.size(state) - 1)
        return F.when(merge, F.array_append(before, both)).otherwise(F.array_append(state, part))

    first = F.slice("parts", 1, 1)
    folded = F.aggregate(F.slice("parts", F.lit(2), F.greatest(F.size("parts") - 1, F.lit(0))), first, step)
    made = grouped.select(source, F.explode(folded).alias("s")).select(source, "s.*")
    number = F.row_number().over(Window.partitionBy(source).orderBy("index"))
    return made.select(
        source,
        number.alias("chunk_index"),
        "heading",
        "content",
        "slide_start",
        "slide_end",
        F.length("content").alias("char_count"),
    )


def book_sections(books: DataFrame) -> DataFrame:
    """Sections of books read by :func:`fathom.sources.archives.read_books`: source_id,
    section_id, chunk_index over the book, chapter_index, chapter_title, chapter_href,
    heading, content, char_count, search_text."""
    from fathom.operators import chunking

    stem = F.regexp_replace("filename", r"\.[^.]+$", "")
    chapters = books.filter("book.error is null").select(
        "relative_path",
        F.concat(F.lit("source_"), F.substring(F.sha1(F.col("relative_path").cast("binary")), 1, 16)).alias("source_id"),
        F.coalesce("book.title", stem).alias("book_title"),
        F.explode("book.chapters").alias("c"),
    )
    heading = F.coalesce("c.title", F.concat(F.lit("Chapter "), F.col("c.index").cast("string")))
    told = chapters.select(
        "relative_path",
        "source_id",
        "book_title",
        F.col("c.index").alias("chapter_index"),
        F.col("c.title").alias("chapter_title"),
        F.col("c.href").alias("chapter_href"),
        heading.alias("chapter_heading"),
        F.concat(F.lit("# "), heading, F.lit("\n\n"), F.col("c.text")).alias("text"),
    )
    cut = chunking.cut(told, "text", "text").withColumnRenamed("chunk_index", "local_index").drop("heading", "search_text", "line_start", "line_end")
    order = Window.partitionBy("source_id").orderBy("chapter_index", "local_index")
    search = F.concat_ws(
        "\n",
        "chapter_heading",
        F.concat(F.lit("EPUB: "), F.col("book_title")),
        F.concat(F.lit("Path: "), F.col("relative_path")),
        F.concat(F.lit("Chapter "), F.col("chapter_index").cast("string"), F.lit(": "), F.col("chapter_heading")),
        "content",
    )
    key = F.concat_ws(":", "source_id", F.lit("chapter"), F.col("chapter_index").cast("string"), F.lit("chunk"), F.col("local_index").cast("string"))
    return cut.select(
        "source_id",
        F.concat(F.lit("section_"), F.substring(F.sha1(key.cast("binary")), 1, 16)).alias("section_id"),
        F.row_number().over(order).alias("chunk_index"),
        "chapter_index",
        "chapter_title",
        "chapter_href",
        F.col("chapter_heading").alias("heading"),
        "content",
        "char_count",
        search.alias("search_text"),
    )


def with_pictures(sections: DataFrame, told: DataFrame, source: str = "source_id") -> DataFrame:
    """Sections and, after them in their chunk_index, what models read in or said of
    pictures.  ``told``: source, image_index, section_type (image_ocr, image_summary),
    content; rows without content drop."""
    last = sections.groupBy(source).agg(F.max("chunk_index").alias("last"))
    filled = told.filter(F.length(strip("content")) > 0).join(last, source, "left")
    place = F.row_number().over(Window.partitionBy(source).orderBy("image_index", "section_type"))
    more = filled.withColumn("chunk_index", F.coalesce("last", F.lit(0)) + place).drop("last")
    return sections.unionByName(more, allowMissingColumns=True)


def file_sections(files: DataFrame) -> DataFrame:
    """Sections of listed text, markdown, web and SQL files (with content): the columns
    of ``files`` but the content, source_id, section_id, and what
    :func:`fathom.operators.chunking.cut` gives.  Other files give none, nor do those
    without content (see :func:`unread`)."""
    from functools import reduce

    from fathom.operators import chunking
    from fathom.sources.files import text_of

    read = text_of(files).drop("content")
    parts = []
    for form in ("text", "markdown", "html", "sql"):
        own = [s for s, f in FORMS.items() if f == form]
        parts.append(chunking.cut(read.filter(F.col("extension").isin(*own)), "text", form))
    made = reduce(DataFrame.unionByName, parts)
    source = F.concat(F.lit("source_"), F.substring(F.sha1(F.col("relative_path").cast("binary")), 1, 16))
    prefix = F.when(F.col("extension").isin(".html", ".htm"), "websec_").otherwise("section_")
    key = F.concat(F.col("source_id"), F.lit(":"), F.col("chunk_index").cast("string"), F.lit(":"), F.coalesce("heading", F.lit("")))
    return made.withColumn("source_id", source).withColumn(
        "section_id", F.concat(prefix, F.substring(F.sha1(key.cast("binary")), 1, 16))
    )


def unread(files: DataFrame) -> DataFrame:
    """(relative_path, status, error_message) of listed text files whose content is null, as
    of those too large to be held: :func:`file_sections` has nothing of them, and
    :func:`large_sections` reads them."""
    gone = files.filter(F.col("extension").isin(*FORMS) & F.col("content").isNull())
    return gone.select("relative_path", F.lit("error").alias("status"), F.lit("the file is too large to be read whole").alias("error_message"))


#: Characters of a large text that are cut into sections at once, or up to twice as
#: many where no paragraph ends.
STRETCH = 1 << 20
FORMS = {".txt": "text", ".md": "markdown", ".html": "html", ".htm": "html", ".sql": "sql"}


def _stretches(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, size, part = None, [], 0, 0

        def told() -> pa.RecordBatch:
            path, start = now
            columns = [pa.array([path]), pa.array([start], pa.int64()), pa.array([part], pa.int32()), pa.array(["\n".join(held)])]
            return pa.RecordBatch.from_arrays(columns, ["relative_path", "start", "part", "text"])

        for batch in batches:
            for path, start, line in zip(*(batch.column(n).to_pylist() for n in ("relative_path", "start", "line")), strict=True):
                ends = line.startswith("#") if path.endswith(".md") else not line.strip()
                other = (path, start) != now
                if held and (other or size >= 2 * most or (size >= most and ends)):
                    yield told()
                    held, size, part = [], 0, part + 1
                if other:
                    now, part = (path, start), 0
                held.append(line)
                size += len(line) + 1
        if held:
            yield told()

    return run


def large_sections(spark: SparkSession, root: str, relative_paths: list[str], most: int = STRETCH) -> DataFrame:
    """(relative_path, chunk_index, heading, content, char_count, search_text) of text and
    markdown files of any size, in UTF-8: many tasks read a file's blocks and cut them, a
    stretch of paragraphs at a time.  A section ends where a block or stretch does.  Numbers
    ascend through the file."""
    from functools import reduce

    from fathom.operators import chunking
    from fathom.sources.files import relative_to

    at = root.rstrip("/")
    read = spark.read.option("lineSep", "\n").text([f"{at}/{p}" for p in relative_paths])
    path = F.url_decode(F.replace("_metadata.file_path", F.lit("+"), F.lit("%2B")))
    lines = read.select(
        relative_to(at, path).alias("relative_path"), (F.col("_metadata.file_block_start") * 1).alias("start"), F.make_valid_utf8("value").alias("line")
    )
    told = lines.mapInArrow(_stretches(most), "relative_path string, start long, part int, text string")
    told = told.withColumn("text", F.regexp_replace("text", "^\ufeff", ""))
    forms = {"markdown": F.endswith("relative_path", F.lit(".md")), "text": ~F.endswith("relative_path", F.lit(".md"))}
    made = reduce(DataFrame.unionByName, (chunking.cut(told.filter(own), "text", form) for form, own in forms.items()))
    made = made.withColumnRenamed("chunk_index", "local_index")
    # A row for each stretch, so that numbers need no order over a file's sections; a
    # stretch that begins without a heading is under the last one before it.
    counts = made.groupBy("relative_path", "start", "part").agg(F.count(F.lit(1)).alias("n"))
    heads = F.regexp_extract_all("text", F.lit(r"(?m)^#{1,6}[ \t]+(.*\S)"), F.lit(1))
    stretches = told.select("relative_path", "start", "part", F.when(forms["markdown"], F.try_element_at(heads, F.lit(-1))).alias("last"))
    stretches = stretches.join(counts, ["relative_path", "start", "part"], "left")
    before = Window.partitionBy("relative_path").orderBy("start", "part").rowsBetween(Window.unboundedPreceding, -1)
    carried = {"before": F.coalesce(F.sum("n").over(before), F.lit(0)), "above": F.last("last", ignorenulls=True).over(before)}
    placed = made.join(stretches.withColumns(carried).drop("n", "last"), ["relative_path", "start", "part"])
    placed = placed.withColumn("heading", F.coalesce("heading", "above"))
    search = F.concat_ws("\n", F.when(F.length("heading") > 0, F.col("heading")), "content").alias("search_text")
    return placed.select("relative_path", (F.col("before") + F.col("local_index")).alias("chunk_index"), "heading", "content", "char_count", search)


def script_head(sections: DataFrame, most: int = SQL_HEAD) -> DataFrame:
    """The first sections of scripts: what a model is shown of them."""
    return sections.filter(F.col("chunk_index") <= most)
