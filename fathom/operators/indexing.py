"""One indexing run: scan, parse what changed, write the next snapshot.

A catalog is a folder: rows of files and of their children in buckets by a hash of
source_id, and a manifest that names for each bucket the write that holds it.  A run
writes the buckets that changed, to new folders, and then the manifest, one small file
that appears at once.  Until then readers see the snapshot before, so a run that
breaks between two writes changes nothing, and the next one does its work again.

Counters are observed while rows pass by (``DataFrame.observe``); nothing is counted
in a pass of its own.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from fathom.functions import search_texts
from fathom.functions.scalars import stable_id, strip
from fathom.operators import catalog, enrich, sections
from fathom.sources import files as lake
from fathom.sources import schemas, tabular
from fathom.sources.shared import shared_folder

#: Buckets of a catalog.  A run rewrites those that hold a changed file.
BUCKETS = 64
#: Changed files that are named one by one when their contents are read.
MOST_PATHS = 10_000
MANIFEST = "run long, table string, bucket int, path string"

#: What a parser gives for each file: relative_path, error_message (null if it went
#: well), parse_warnings, and ``children``, an array of structs with a search_text.
Parser = Callable[[DataFrame], DataFrame]


@dataclass
class Counts:
    """What a run did; ``errors`` has a row (relative_path, error_message) a failed file."""

    prefix: str
    discovered: int = 0
    unchanged: int = 0
    indexed: int = 0
    error: int = 0
    missing: int = 0
    documents: int = 0
    errors: DataFrame | None = field(default=None, repr=False)


class Snapshot:
    """A catalog as its last whole run left it.  ``children``: the schema of a child."""

    def __init__(self, spark: SparkSession, folder: str, children: StructType) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self.schemas = {
            "files": StructType.fromDDL(schemas.FILE.replace(" not null", "")),
            "children": StructType([StructField("source_id", StringType()), StructField("position", IntegerType()), StructField("child", children)]),
        }
        try:
            found = spark.read.schema(MANIFEST).parquet(f"{self.folder}/manifest")
            last = found.agg(F.max("run")).head()[0]
            rows = found.filter(F.col("run") == last).collect() if last is not None else []  # two rows a bucket
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            rows, last = [], None
        self.run = 0 if last is None else last
        self.paths = {(r.table, r.bucket): r.path for r in rows if r.bucket >= 0}

    def table(self, name: str, buckets: list[int] | None = None) -> DataFrame:
        """Rows of ``files`` or ``children``, of some buckets or all."""
        paths = [p for (t, b), p in self.paths.items() if t == name and (buckets is None or b in buckets)]
        if not paths:
            return self.spark.createDataFrame([], self.schemas[name])
        return self.spark.read.schema(self.schemas[name]).parquet(*(f"{self.folder}/{p}" for p in paths))

    @property
    def files(self) -> DataFrame:
        return self.table("files")

    @property
    def children(self) -> DataFrame:
        """(source_id, position, the child's columns)."""
        return self.table("children").select("source_id", "position", "child.*")

    def commit(self, tables: dict[str, DataFrame], buckets: list[int]) -> Snapshot:
        """Write the rows of these buckets, which take the place of what they held."""
        number, paths = self.run + 1, dict(self.paths)
        for name, rows in tables.items():
            at = f"{name}/{number}-{uuid.uuid4().hex[:8]}"
            placed = rows.withColumn("bucket", bucket_of("source_id"))
            placed.repartition("bucket").write.partitionBy("bucket").parquet(f"{self.folder}/{at}")
            kept = {r.bucket for r in self.spark.read.parquet(f"{self.folder}/{at}").select("bucket").distinct().collect()} if not rows.isEmpty() else set()
            for b in buckets:
                paths.pop((name, b), None)
                if b in kept:
                    paths[name, b] = f"{at}/bucket={b}"
        rows = [(number, t, b, p) for (t, b), p in paths.items()] or [(number, "", -1, "")]
        self.spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("append").parquet(f"{self.folder}/manifest")
        return Snapshot(self.spark, self.folder, self.schemas["children"]["child"].dataType)


def bucket_of(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


def parse_tables(files: DataFrame) -> DataFrame:
    """Tables of CSV, TSV, XLSX, SQLite and script files, as a run's children."""
    read = tabular.read(files)
    told = tabular.tables(read)
    shown = search_texts.table_text(F.col("header"), F.col("row_count"), F.col("preview"))
    one = F.struct("sheet_index", "table_name", "header", "row_count", "column_count", F.concat_ws("\n", "table_name", shown).alias("search_text"))
    made = told.groupBy("relative_path").agg(F.array_sort(F.collect_list(one)).alias("children"))  # the tables of one file
    status = read.select("relative_path", F.when(F.col("parsed.status") != tabular.PARSED, F.col("parsed.error")).alias("error_message"), F.col("parsed.warnings").alias("parse_warnings"))
    return status.join(made, "relative_path", "left")


def parse_texts(files: DataFrame) -> DataFrame:
    """Sections of text, markdown, web and script files, as a run's children."""
    made = sections.file_sections(files.select("relative_path", "extension", "content"))
    one = F.struct("chunk_index", "section_id", "heading", "content", "line_start", "line_end", "char_count", "search_text")
    grouped = made.groupBy("relative_path").agg(F.array_sort(F.collect_list(one)).alias("children"))  # the sections of one file
    status = files.select("relative_path", F.when(F.col("content").isNull(), "the file is too large to be read whole").alias("error_message"), F.array().cast("array<string>").alias("parse_warnings"))
    return status.join(grouped, "relative_path", "left")


def contents(spark: SparkSession, root: str, todo: DataFrame) -> DataFrame:
    """Listed files with content: only ``todo``'s, which are read by name if they are few."""
    named = todo.select("relative_path").limit(MOST_PATHS + 1).collect()
    if len(named) > MOST_PATHS:
        every = lake.listing(spark, root, content=True).select("relative_path", "content")
        return todo.join(every, "relative_path")
    if not named:
        return todo.withColumn("content", F.lit(None).cast("binary"))
    read = lake.named(spark, root, [r.relative_path for r in named], content=True).select("relative_path", "content")
    return todo.join(read, "relative_path")


def scan(spark: SparkSession, root: str, prefix: str, suffixes: tuple[str, ...]) -> DataFrame:
    return lake.listing(spark, root, prefix, suffixes)


def run(
    snapshot: Snapshot, found: DataFrame, read: Callable[[DataFrame], DataFrame], parse: Parser, prefix: str = "",
    model: Callable | None = None, force: bool = False,
) -> tuple[Snapshot, Counts]:
    """Index ``found`` (relative_path, filename, extension, size_bytes, last_modified): all
    files below ``prefix``.  ``read`` gives some of them their content, ``parse`` parses
    them, ``model`` (see :func:`fathom.operators.enrich.enrich`) tells a summary and keywords.

    Unchanged files keep their rows and stay present.  A file that fails gets status error
    and its message, keeps what enrichment said before, and loses its children.  Files that
    are gone become missing.  An empty scan of a prefix makes all below it missing.
    """
    spark = snapshot.spark
    spark.sparkContext.setJobDescription("index: scan")
    old = snapshot.files
    seen = Observation("scan")
    outcomes = catalog.with_outcome(found, old, "relative_path").observe(
        seen, F.count(F.lit(1)).alias("discovered"), F.count_if(F.col("outcome") == "unchanged").alias("unchanged")
    )
    outcomes = _written(outcomes, "index-outcomes")
    todo = catalog.to_parse(outcomes, force).drop("outcome")

    spark.sparkContext.setJobDescription("index: parse")
    parsed = parse(read(todo))
    told = todo.join(parsed, "relative_path").withColumn("source_id", stable_id("source", "relative_path"))
    none = F.array().cast(parsed.schema["children"].dataType)
    told = told.withColumn("children", F.when(F.col("error_message").isNull(), F.coalesce("children", none)).otherwise(none))
    if model is not None:
        text = F.concat_ws("\n", "filename", F.transform("children", lambda c: c["search_text"]))
        told = enrich.enrich(told.withColumn("__text", text), "__text", model).drop("__text")
        failed = F.col("error_message").isNull() & F.col("enriched.error").isNotNull()
        told = told.withColumn("children", F.when(failed, none).otherwise(F.col("children")))
        told = told.withColumn("error_message", F.coalesce("error_message", "enriched.error"))
    else:
        told = told.withColumn("enriched", F.lit(None).cast("struct<summary:string,keywords:array<string>,error:string>"))
    fine = F.col("error_message").isNull()
    n_documents = F.size(F.filter("children", lambda c: F.length(strip(c["search_text"])) > 0)) + 1  # the file's own
    done = Observation("parse")
    told = told.observe(
        done, F.count_if(fine).alias("indexed"), F.count_if(~fine).alias("error"), F.coalesce(F.sum(F.when(fine, n_documents)), F.lit(0)).alias("documents")
    )
    told = _written(told, "index-parsed")

    spark.sparkContext.setJobDescription("index: write")
    rows = told.select(
        "source_id", "relative_path", "filename", F.substring("extension", 2, 99).alias("file_format"), "size_bytes", "last_modified",
        F.when(fine, "indexed").otherwise("error").alias("status"), "error_message", F.lit(True).alias("is_present"),
        F.col("enriched.summary").alias("file_summary"), F.col("enriched.keywords").alias("file_keywords"),
        F.when(fine, F.concat_ws("\n", "filename", "relative_path", "enriched.summary")).alias("file_search_text"), "parse_warnings",
        F.current_timestamp().alias("first_indexed_at"),
    )
    good, bad = rows.filter("status = 'indexed'"), rows.filter("status = 'error'")
    after = catalog.upsert(old, good, "relative_path", keep=["file_summary"], first=["first_indexed_at"], maps=["file_keywords"])
    after = catalog.save_errors(after, bad.select("relative_path", "source_id", "filename", "file_format", "size_bytes", "last_modified", "error_message", "parse_warnings", "first_indexed_at"), "relative_path")
    gone = Observation("missing")
    after = catalog.mark_missing(after, found, "relative_path", prefix)
    was = old.select("relative_path", F.col("is_present").alias("__was"))
    after = after.join(was, "relative_path", "left")
    lost = F.coalesce("__was", F.lit(False)) & ~F.col("is_present")
    after = after.observe(gone, F.count_if(lost).alias("missing"))
    after = _written(after.withColumn("__lost", lost).drop("__was"), "index-files")

    changed = told.select("source_id").unionByName(after.filter("__lost").select("source_id"))
    buckets = [r.b for r in changed.select(bucket_of("source_id").alias("b")).distinct().collect()]  # at most BUCKETS
    counts = Counts(prefix, **seen.get, **done.get, **gone.get)
    counts.errors = bad.select("relative_path", "error_message")
    if buckets:
        old_children = snapshot.table("children", buckets)
        new_children = told.select("source_id", F.posexplode("children").alias("position", "child"))
        touched = after.filter(bucket_of("source_id").isin(*buckets)).drop("__lost")
        children = catalog.replace_children(old_children, new_children, told.select("source_id"), "source_id")
        snapshot = snapshot.commit({"children": children, "files": schemas.shaped(touched, snapshot.schemas["files"])}, buckets)
    spark.sparkContext.setJobDescription(None)
    return snapshot, counts


def child_schema(parsed: DataFrame) -> StructType:
    kind = parsed.schema["children"].dataType
    assert isinstance(kind, ArrayType)
    return kind.elementType


def index(spark: SparkSession, root: str, folder: str, modality: str = "tabular", prefix: str = "", model: Callable | None = None, force: bool = False) -> tuple[Snapshot, Counts]:
    """Index the files of a modality (tabular or text) below ``root/prefix``."""
    parse, suffixes = {"tabular": (parse_tables, (".csv", ".tsv", ".xlsx", ".xls")), "text": (parse_texts, (".txt", ".md", ".html", ".htm", ".sql"))}[modality]
    below = lake.safe_prefix(prefix)
    found = scan(spark, root, below, suffixes)
    empty = found.limit(0).withColumn("content", F.lit(None).cast("binary"))
    snapshot = Snapshot(spark, folder, child_schema(parse(empty)))
    return run(snapshot, found, lambda todo: contents(spark, root, todo), parse, below, model, force)


def _written(rows: DataFrame, name: str) -> DataFrame:
    """The rows, written to the shared folder once; what is observed of them passes by."""
    path = shared_folder(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
