"""Reading files that nothing has indexed, for a question that the indexes don't answer."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.functions import search_texts
from fathom.sources import archives, files, pdf, tabular

TEXTS = (".txt", ".md", ".html", ".htm", ".sql", ".json", ".jsonl", ".xml", ".yaml", ".yml")
TABLES = (".csv", ".tsv", ".xlsx", ".db", ".sqlite", ".sqlite3")
OFFICE = (".docx", ".pptx")
BOOKS = (".epub",)


def contents(named: DataFrame) -> DataFrame:
    """(relative_path, filename, content) of listed files (with content): text, tables as
    text, paragraphs, chapters or pages in order.  Files that can't be read, or of which
    nothing can be read here (sound, pictures), tell so in place of it."""

    def of(*suffixes: str) -> DataFrame:
        return named.filter(F.col("extension").isin(*suffixes))

    def shown(rows: DataFrame, text, wrong=None) -> DataFrame:
        told = F.coalesce(F.concat(F.lit("[can't be read: "), wrong, F.lit("]")), text) if wrong is not None else text
        return rows.select("relative_path", told.alias("content"))

    parts = [shown(files.text_of(of(*TEXTS)), F.coalesce("text", F.lit("[can't be read: too large]")))]

    read = tabular.read(of(*TABLES))
    table = F.concat_ws("\n", "table_name", search_texts.table_text(F.col("header"), F.col("row_count"), F.col("preview")))
    tables = tabular.tables(read).select("relative_path", F.struct("sheet_index", table.alias("text")).alias("x"))
    tables = tables.groupBy("relative_path").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["text"]), "\n\n").alias("text"))  # one file's
    wrong = read.select("relative_path", F.when(F.col("parsed.status") != tabular.PARSED, F.col("parsed.error")).alias("wrong"))
    parts.append(shown(wrong.join(tables, "relative_path", "left"), F.col("text"), F.col("wrong")))

    office = archives.read_chunks(of(*OFFICE))
    parts.append(shown(office, F.array_join(F.transform("parsed.chunks", lambda c: c["text"]), "\n"), F.col("parsed.error")))
    books = archives.read_books(of(*BOOKS))
    parts.append(shown(books, F.array_join(F.transform("book.chapters", lambda c: c["text"]), "\n\n"), F.col("book.error")))

    pages = pdf.read_pages(of(".pdf"))
    each = pages.filter("error is null").groupBy("relative_path").agg(F.array_sort(F.collect_list(F.struct("page", "text"))).alias("p"))  # one file's
    parts.append(shown(each, F.array_join(F.transform("p", lambda x: x["text"]), "\n\n")))
    parts.append(shown(pages.filter("error is not null"), F.lit(""), F.col("error")))

    others = named.filter(~F.col("extension").isin(*TEXTS, *TABLES, *OFFICE, *BOOKS, ".pdf"))
    parts.append(shown(others, F.concat(F.lit("[no reader here for "), "extension", F.lit(" files]"))))
    told = reduce(DataFrame.unionByName, parts)
    return named.select("relative_path", "filename").join(told, "relative_path")


def reader(spark: SparkSession, root: str) -> Callable[[DataFrame], DataFrame]:
    """What :func:`fathom.operators.retrieval.retrieve` reads files with: those below
    ``root``, which are few, by name."""

    def read(picked: DataFrame) -> DataFrame:
        paths = [r.relative_path for r in picked.select("relative_path").collect()]  # at most 15
        if not paths:
            return picked.select("filename", F.lit("").alias("content"))
        return contents(files.named(spark, root, paths, content=True)).orderBy("relative_path").select("filename", "content")

    return read
