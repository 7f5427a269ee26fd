"""Retrieval over indexed files: search documents, hits, summaries, fallbacks.

An index of a modality is three frames: vectors (doc_id, source_id, child_id,
record_type, embedding), files (source_id, relative_path, ...), and children, which
are sections or tables (child_id, source_id, ...).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import partialmethod, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from fathom.functions.scalars import plain_question, query_tokens, strip
from fathom.functions.search_texts import filled
from fathom.operators import nearest, search

# Modalities in the order in which they are asked.
MODALITIES = (
    "tabular", "sql_script", "database", "text", "web", "document", "slideshow", "image", "epub", "audio", "video",
)
# What a hit tells besides path, score and content.
FILE_FIELDS = {
    "tabular": ("sheet_descriptions",),
    "image": ("width", "height"),
    "epub": ("title", "creators", "language", "chapter_count", "image_count", "vl_model_name"),
    "audio": ("duration_seconds", "asr_model_name"),
    "video": ("duration_seconds", "width", "height", "asr_model_name", "vl_model_name"),
}
CHILD_FIELDS = {
    "tabular": ("table_name", "sheet_name", "sheet_description", "header", "columns", "preview_rows"),
    "database": ("table_name", "columns", "preview_rows", "row_count", "column_count"),
    "image": ("width", "height"),
    "epub": (
        "title", "creators", "language", "section_type", "chapter_index", "chapter_title", "chapter_href", "image_index",
        "image_href", "vl_model_name",
    ),
    "audio": ("start_seconds", "end_seconds", "duration_seconds", "asr_model_name"),
    "video": (
        "section_type", "timestamp_seconds", "start_seconds", "end_seconds", "frame_index", "duration_seconds", "width",
        "height", "asr_model_name", "vl_model_name",
    ),
}
# By what a hit's place is told: unit, first and last column, others.
POSITIONS = {
    "text": ("line", "line_start", "line_end", ()),
    "web": ("line", "line_start", "line_end", ()),
    "image": ("line", "line_start", "line_end", ()),
    "document": ("page", "page_start", "page_end", ("image_index",)),
    "slideshow": ("slide", "slide_start", "slide_end", ("image_index",)),
}
# What a file's summary tells besides the common columns.
SUMMARY_FIELDS = {
    "tabular": ("sheet_descriptions",),
    "database": ("table_count",),
    "image": ("width", "height", "color_mode", "has_alpha", "is_animated", "frame_count"),
    "epub": ("title", "creators", "language", "publisher", "identifier", "chapter_count", "image_count", "vl_model_name"),
    "audio": ("duration_seconds", "codec_name", "sample_rate", "channels", "asr_model_name", "asr_cost_usd"),
    "video": (
        "duration_seconds", "width", "height", "fps", "video_codec", "audio_codec", "has_audio", "sampled_frame_count",
        "asr_model_name", "asr_cost_usd", "vl_model_name",
    ),
}
# Suffixes of a modality among files that aren't indexed, how many files
# are read, and of which columns a lexical search asks.
SUFFIXES = {
    "text": (".txt", ".md", ".html", ".htm", ".sql"),
    "tabular": (".csv", ".tsv", ".xlsx", ".xls"),
    "image": (".png", ".jpg", ".jpeg", ".webp"),
    "document": (".pdf", ".docx", ".pptx", ".ppt"),
    "epub": (".epub",),
    "audio": (".m4a", ".mp3", ".wav", ".flac", ".ogg"),
    "video": (".mp4", ".mkv", ".mov", ".avi", ".webm"),
    "database": (".db", ".sqlite", ".sqlite3"),
}
MOST_FILES = {"image": 15}
MOST_OTHER_FILES, MOST_TEXT_FILES, MOST_ROWS = 6, 3, 5


def column(frame: DataFrame, name: str) -> Column:
    return F.col(name) if name in frame.columns else F.lit(None)


def search_docs(files: DataFrame, children: DataFrame | None, modality: str, child_kind: str = "section") -> DataFrame:
    """(doc_id, modality, record_type, source_id, child_id, text) of what is embedded:
    a row per file with ``file_search_text``, named ``<source_id>:file``, and one per
    child with ``search_text``, named by itself; rows without text drop, and of equal
    names one stays."""
    rows = files.select(
        F.concat("source_id", F.lit(":file")).alias("doc_id"),
        F.lit("file").alias("record_type"),
        "source_id",
        F.lit(None).cast("string").alias("child_id"),
        F.col("file_search_text").alias("text"),
    )
    if children is not None:
        own = children.select(
            F.col("child_id").alias("doc_id"), F.lit(child_kind).alias("record_type"), "source_id", "child_id", F.col("search_text").alias("text")
        )
        rows = rows.unionByName(own)
    kept = rows.filter(F.length(strip("text")) > 0).withColumn("modality", F.lit(modality))
    others = [c for c in kept.columns if c != "doc_id"]
    return kept.groupBy("doc_id").agg(F.min(F.struct(*others)).alias("d")).select("doc_id", "d.*")


def upsert_docs(old: DataFrame, new: DataFrame) -> DataFrame:
    """Documents by name, those of ``new`` in place of old ones."""
    return old.join(new.select("doc_id"), "doc_id", "left_anti").unionByName(new, allowMissingColumns=True)


def paths(frame: DataFrame, root: str | None) -> list[Column]:
    plain = F.regexp_replace("file_path", r"^[./]+", "")
    found = [F.concat(F.lit("./"), plain).alias("execution_file_path")]
    if root is not None:
        found.append(F.concat(F.lit(root.rstrip("/") + "/"), F.col("file_path")).alias("absolute_file_path"))
    return found


def position_of(frame: DataFrame, modality: str) -> Column | None:
    """Struct of unit, start, end and others; null where none of these is known."""
    if modality not in POSITIONS:
        return None
    unit, start, end, others = POSITIONS[modality]
    known = [column(frame, start).cast("int"), column(frame, end).cast("int"), *(column(frame, o).cast("int") for o in others)]
    made = F.struct(F.lit(unit).alias("unit"), *(c.alias(n) for c, n in zip(known, ("start", "end", *others), strict=True)))
    return F.when(F.coalesce(*known).isNotNull(), made).alias("position")


def formatted(rows: DataFrame, modality: str, record_type: str, root: str | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """Hits in the form in which they are shown: modality, record_type, file_path, score,
    content, what the modality adds, position (if the modality has places), and paths; before
    them the columns ``keys``."""
    if record_type == "file":
        content = column(rows, "file_summary")
        content = F.coalesce(filled(content), column(rows, "title")) if modality == "epub" else content
        fields = FILE_FIELDS.get(modality, ())
    else:
        table = modality in ("tabular", "database")
        content = column(rows, "summary") if table else F.coalesce(filled(column(rows, "search_text")), column(rows, "content"))
        fields = CHILD_FIELDS.get(modality, ())
    place = position_of(rows, modality) if record_type != "file" else None
    shown = rows.select(
        *keys,
        F.lit(modality).alias("modality"),
        F.lit(record_type).alias("record_type"),
        F.col("relative_path").alias("file_path"),
        F.col("score").cast("double").alias("score"),
        content.cast("string").alias("content"),
        *(column(rows, f).alias(f) for f in fields),
        *([place] if place is not None else []),
    )
    return shown.select("*", *paths(shown, root))


def hydrated(
    hits: DataFrame, files: DataFrame, children: DataFrame, modality: str, root: str | None = None, keys: tuple[str, ...] = ()
) -> DataFrame:
    """Hits (record_type, source_id, child_id, score, ``keys``) with the rows that they name:
    those of record_type file with their file, the others with their child and its file.
    Two joins; hits of rows or files that are gone drop."""
    of_files = hits.filter("record_type = 'file'").select("source_id", "score", *keys).join(search.present(files), "source_id")
    own = [c for c in files.columns if c == "source_id" or c not in children.columns]
    kind = "table" if modality in ("tabular", "database") else "section"
    of_children = search.hydrate(hits.filter("record_type <> 'file'").select("child_id", "score", *keys), children, search.present(files).select(*own), "child_id", "source_id")
    both = (formatted(of_files, modality, "file", root, keys), formatted(of_children, modality, kind, root, keys))
    return both[0].unionByName(both[1], allowMissingColumns=True)


@dataclass
class Index:
    vectors: DataFrame
    files: DataFrame
    children: DataFrame


class Retriever:
    """Vector search over the indexes of some modalities.

    ``embed`` makes the vector of a question.  Results are frames, best first by score,
    then path; ties beyond that go by content.
    """

    def __init__(self, indexes: dict[str, Index], embed: Callable[[str], list[float]], root: str | None = None) -> None:
        self.indexes, self.embed, self.root = indexes, embed, root

    def query(self, modality: str, question: str, limit: int = 5, offset: int = 0, top_k: int | None = None) -> DataFrame:
        """One page of a modality's hits; :meth:`page` tells too whether more follow."""
        limit, offset = search.bounds(limit, offset, top_k)
        return self._near(modality, question, limit, offset).orderBy("score", "file_path", "content")

    def _near(self, modality: str, question: str, limit: int, offset: int) -> DataFrame:
        if modality not in self.indexes:
            raise KeyError(f"no index for {modality}")
        index = self.indexes[modality]
        near = search.top(search.scored(index.vectors, self.embed(question)), ["score", "doc_id"], limit, offset)
        return hydrated(near, index.files, index.children, modality, self.root)

    def query_all(self, question: str, limit: int = 5, offset: int = 0) -> DataFrame:
        """One page of the best hits of all modalities; see :meth:`skipped`."""
        return self._merged(question, *search.bounds(limit, offset))

    def _merged(self, question: str, limit: int, offset: int) -> DataFrame:
        found = [self._near(m, question, limit + offset, 0) for m in MODALITIES if m in self.indexes]
        if not found:
            raise KeyError("no index at all")
        plain = ["modality", "record_type", "file_path", "score", "content", "execution_file_path"]
        return search.top(reduce(DataFrame.unionByName, (h.select(*plain) for h in found)), ["score", "modality", "file_path", "content"], limit, offset)

    def query_many(self, questions: DataFrame, limit: int = 5) -> DataFrame:
        """For each of many questions (question_id, question) what :meth:`query_all` gives
        for it, with question_id and place: all modalities' vectors are read once (see
        :func:`fathom.operators.nearest.nearest`).  Questions are few and embedded by the driver."""
        limit, _ = search.bounds(limit)
        spark = questions.sparkSession
        kind = next(f.dataType for f in questions.schema if f.name == "question_id")
        asked = [(r.question_id, [float(x) for x in self.embed(r.question)]) for r in questions.select("question_id", "question").toLocalIterator()]
        asked = spark.createDataFrame(asked, StructType([StructField("question_id", kind), StructField("embedding", ArrayType(DoubleType()))]))
        columns = ("doc_id", "record_type", "source_id", "child_id", F.col("embedding").cast("array<double>").alias("embedding"))
        vectors = [self.indexes[m].vectors.select(*columns).withColumn("modality", F.lit(m)) for m in MODALITIES if m in self.indexes]
        if not vectors:
            raise KeyError("no index at all")
        near = nearest.nearest(reduce(DataFrame.unionByName, vectors), asked, "question_id", "doc_id", limit, group="modality")
        near = near.persist()  # a few rows for each question and modality
        plain = ["question_id", "modality", "record_type", "file_path", "score", "content", "execution_file_path"]
        found = [
            hydrated(near.filter(F.col("modality") == m), i.files, i.children, m, self.root, ("question_id",)).select(*plain)
            for m, i in self.indexes.items()
        ]
        order = Window.partitionBy("question_id").orderBy("score", "modality", "file_path", "content")
        return reduce(DataFrame.unionByName, found).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= limit)

    def page(self, modality: str | None, question: str, limit: int = 5, offset: int = 0, top_k: int | None = None) -> search.Page:
        """A page as plain rows, of one modality or (None) of all, with the offset after
        it and whether more follows.  One row more than shown is asked for."""
        limit, offset = search.bounds(limit, offset, top_k if modality else None)
        order = ["score", "file_path", "content"]
        if modality:
            rows = self._near(modality, question, limit + 1, offset).orderBy(*order).collect()
        else:
            rows = self._merged(question, limit + 1, offset).collect()
        return search.Page(rows[:limit], offset + len(rows[:limit]), len(rows) > limit)

    def skipped(self) -> list[dict]:
        """Modalities that aren't asked, and why."""
        return [{"modality": m, "reason": "index missing"} for m in MODALITIES if m not in self.indexes]

    def file_summary(self, path: str) -> DataFrame:
        """What is known of one file: the path as given, or below the root, before the
        path without leading slashes, each in the first modality that has it."""
        plain = path.replace("\\", "/")
        if self.root and plain.startswith(self.root.rstrip("/") + "/"):
            plain = plain[len(self.root.rstrip("/")) + 1 :]
        wanted = list(dict.fromkeys([plain, plain.lstrip("/")]))
        place = F.array_position(F.array(*map(F.lit, wanted)), F.col("relative_path"))
        found = [
            search.present(self.indexes[m].files).filter(F.col("relative_path").isin(*wanted)).select(F.lit(path).alias("asked"), "relative_path", F.lit(m).alias("modality"))
            for m in MODALITIES
            if m in self.indexes
        ]
        best = search.first_by_priority(found, "asked", [place]).collect() if found else []
        if not best:
            raise ValueError(f"no indexed file: {path}")
        index, modality = self.indexes[best[0].modality], best[0].modality
        files = index.files.filter(F.col("relative_path") == best[0].relative_path).limit(1)
        if modality == "database":
            own = index.children.join(F.broadcast(files.select("source_id")), "source_id")  # one file
            counts = own.groupBy("source_id").agg(F.count(F.lit(1)).alias("table_count"))
            files = files.join(counts, "source_id", "left").withColumn("table_count", F.coalesce("table_count", F.lit(0)))
        return summaries(files, modality, self.root)


for _m in MODALITIES:
    setattr(Retriever, f"query_{_m}", partialmethod(Retriever.query, _m))

#: Names under which an agent calls a retriever's methods.
TOOLS = {f"search_{m}_data": f"query_{m}" for m in MODALITIES} | {
    "search_all_indexed_data": "query_all",
    "get_indexed_file_summary": "file_summary",
}


def summaries(files: DataFrame, modality: str, root: str | None = None) -> DataFrame:
    """Files in the form in which a summary shows them."""
    none = F.array().cast("array<string>")
    shown = files.select(
        F.lit(modality).alias("modality"),
        F.col("relative_path").alias("file_path"),
        column(files, "filename").alias("filename"),
        column(files, "file_format").alias("file_format"),
        column(files, "file_summary").alias("summary"),
        F.coalesce(column(files, "file_keywords").cast("array<string>"), none).alias("keywords"),
        F.coalesce(column(files, "parse_warnings").cast("array<string>"), none).alias("warnings"),
        *(column(files, f).alias(f) for f in SUMMARY_FIELDS.get(modality, ())),
    )
    return shown.select("*", *paths(shown, root))


def by_ids(rows: DataFrame, key: str, ids: list | DataFrame) -> DataFrame:
    """Point lookups: rows by a few ids, or by those of a frame (a semi-join)."""
    if isinstance(ids, DataFrame):
        return rows.join(ids.select(key).distinct(), key, "left_semi")
    return rows.filter(F.col(key).isin(*ids))


def database_search(index: dict[str, Index], modality: str, question: str) -> DataFrame:
    """(filename, content): up to MOST_ROWS rows whose text holds the question in any
    case.  ``text`` asks text, web and script files; documents and slides have no such
    search and give no rows."""

    def timing(rows: DataFrame) -> Column:
        kind = F.concat(F.lit(" "), F.col("section_type")) if modality == "video" else F.lit("")
        at = column(rows, "timestamp_seconds").cast("double")
        a, b = F.col("start_seconds").cast("double"), F.col("end_seconds").cast("double")
        span = F.when(a.isNotNull() & b.isNotNull(), F.concat(F.format_string("[%.1fs-%.1fs", a, b), kind, F.lit("]\n")))
        return F.coalesce(F.when(at.isNotNull(), F.concat(F.format_string("[%.1fs", at), kind, F.lit("]\n"))), span, F.lit(""))

    def found(name: str, columns: list[str], content: Callable[[DataFrame], Column], of_files: bool = False) -> DataFrame:
        i = index[name]
        rows = i.files if of_files else i.children.join(i.files.select("source_id", "filename", "relative_path"), "source_id")
        kept = rows.filter(reduce(lambda a, b: a | b, (search.holds(c, question) for c in columns)))
        order = ["relative_path"] if of_files else ["relative_path", "child_id"]
        return search.top(kept, order, MOST_ROWS).select("filename", content(kept).alias("content"))

    def table(rows: DataFrame) -> Column:
        parts = (F.concat(F.lit(f"{n}: "), F.coalesce(F.col(c).cast("string"), F.lit("None"))) for n, c in (("Table", "table_name"), ("Summary", "summary"), ("Columns", "columns")))
        return F.concat_ws("\n", *parts)

    def chapter(rows: DataFrame) -> Column:
        title = F.when(F.length("chapter_title") > 0, F.concat(F.lit(": "), F.col("chapter_title"))).otherwise("")
        at = F.concat(F.lit("[Chapter "), F.col("chapter_index").cast("string"), title, F.lit(" / "), F.col("section_type"), F.lit("]\n"))
        return F.concat(F.coalesce(at, F.concat(F.lit("["), F.col("section_type"), F.lit("]\n"))), F.col("content"))

    both = ["search_text", "content"]
    if modality == "text":
        parts = [found(m, ["content"], lambda r: F.col("content")) for m in ("text", "web", "sql_script") if m in index]
        if parts:
            return reduce(DataFrame.unionByName, parts)
    elif modality in ("tabular", "database") and modality in index:
        return found(modality, ["search_text"], table)
    elif modality == "image" and modality in index:
        return found(modality, ["file_search_text"], lambda r: F.col("file_summary"), of_files=True)
    elif modality == "epub" and modality in index:
        return found(modality, both, chapter)
    elif modality in ("audio", "video") and modality in index:
        return found(modality, both, lambda r: F.concat(timing(r), F.col("content")))
    one = next(iter(index.values())).files
    return one.limit(0).select(F.lit("").alias("filename"), F.lit("").alias("content"))


def filesystem_search(files: DataFrame, question: str, modality: str) -> DataFrame:
    """The files that are read for a question where nothing is indexed: of ``files``
    (relative_path, filename, extension) those of the modality whose names the question
    or its words name; without any, all of the modality; without any of these, text
    files.  In order of path, at most 15 pictures, 6 other files, 3 as a last resort.
    One top-k; ``reason`` tells which of the three it is."""
    asked = F.lit(question)
    name = F.lower("filename")
    matched = F.contains(plain_question(asked), name) | F.exists(query_tokens(asked), lambda t: F.contains(name, t))
    own = F.col("extension").isin(*SUFFIXES.get(modality, ("",)))
    text = F.col("extension").isin(*SUFFIXES["text"]) if modality != "text" else F.lit(False)
    rank = F.when(own & matched, 0).when(own, 1).when(text, 2)
    most = MOST_FILES.get(modality, MOST_OTHER_FILES)
    best = search.top(files.withColumn("rank", rank).filter("rank is not null"), ["rank", "relative_path"], most)
    least = F.min("rank").over(_whole())  # over at most 15 rows
    place = F.row_number().over(_whole().orderBy("relative_path"))
    kept = best.withColumn("least", least).filter("rank = least").withColumn("place", place)
    kept = kept.filter((F.col("rank") < 2) | (F.col("place") <= MOST_TEXT_FILES))
    reason = F.when(F.col("rank") == 0, "named").when(F.col("rank") == 1, "modality").otherwise("text")
    return kept.withColumn("reason", reason).drop("rank", "least", "place")


def _whole():
    return Window.partitionBy(F.lit(0))


def retrieve(index: dict[str, Index], files: DataFrame, modality: str, question: str, read: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(filename, content): from the indexes, or, where they have nothing, of files that
    ``read`` makes rows of (filename, content)."""
    found = database_search(index, modality, question) if index else None
    if found is not None and not found.isEmpty():
        return found
    return read(filesystem_search(files, question, modality)).select("filename", "content")


def evidence(answers: DataFrame, key: str = "question_id", place: str = "relative_path") -> DataFrame:
    """(key, evidences): the files that answers rest on, each once, in order of rank."""
    once = answers.groupBy(key, place).agg(F.min("rank").alias("rank"))
    ordered = F.array_sort(F.collect_list(F.struct("rank", place)))  # the few files of one question
    return once.groupBy(key).agg(F.transform(ordered, lambda x: x[place]).alias("evidences"))
