"""Files of a lake: listing, identification by content and name, encoding."""

from __future__ import annotations

import codecs
import mimetypes
import re
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from fathom.functions.scalars import extension, filename

#: Bytes of a file that are looked at, and the size from which on they aren't.
HEAD = 65_536
LARGEST = 256 << 20

# Suffix, MIME type, format, modality.
FORMATS = (
    (".csv", "text/csv", "csv", "tabular"),
    (".tsv", "text/tab-separated-values", "tsv", "tabular"),
    (".xls", "application/vnd.ms-excel", "xls", "tabular"),
    (".xlsx", "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", "xlsx", "tabular"),
    (".json", "application/json", "json", "semi_structure"),
    (".jsonl", "application/x-ndjson", "jsonl", "semi_structure"),
    (".xml", "application/xml", "xml", "semi_structure"),
    (".yaml", "application/yaml", "yaml", "semi_structure"),
    (".yml", "application/yaml", "yaml", "semi_structure"),
    (".sql", "application/sql", "sql", "sql_script"),
    (".db", "application/vnd.sqlite3", "database", "database"),
    (".sqlite", "application/vnd.sqlite3", "sqlite", "database"),
    (".sqlite3", "application/vnd.sqlite3", "sqlite", "database"),
    (".pdf", "application/pdf", "pdf", "document"),
    (".doc", "application/msword", "doc", "document"),
    (".docx", "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "docx", "document"),
    (".rtf", "application/rtf", "rtf", "document"),
    (".epub", "application/epub+zip", "epub", "epub"),
    (".ppt", "application/vnd.ms-powerpoint", "ppt", "slide_show"),
    (".pptx", "application/vnd.openxmlformats-officedocument.presentationml.presentation", "pptx", "slide_show"),
    (".txt", "text/plain", "text", "text"),
    (".md", "text/markdown", "markdown", "text"),
    (".html", "text/html", "html", "web"),
    (".htm", "text/html", "html", "web"),
    (".jpg", "image/jpeg", "jpeg", "image"),
    (".jpeg", "image/jpeg", "jpeg", "image"),
    (".png", "image/png", "png", "image"),
    (".gif", "image/gif", "gif", "image"),
    (".webp", "image/webp", "webp", "image"),
    (".tif", "image/tiff", "tiff", "image"),
    (".tiff", "image/tiff", "tiff", "image"),
    (".mp3", "audio/mpeg", "mp3", "audio"),
    (".wav", "audio/wav", "wav", "audio"),
    (".m4a", "audio/mp4", "m4a", "audio"),
    (".flac", "audio/flac", "flac", "audio"),
    (".ogg", "audio/ogg", "ogg", "audio"),
    (".mp4", "video/mp4", "mp4", "video"),
    (".mov", "video/quicktime", "mov", "video"),
    (".avi", "video/x-msvideo", "avi", "video"),
    (".mkv", "video/x-matroska", "mkv", "video"),
    (".webm", "video/webm", "webm", "video"),
    (".zip", "application/zip", "zip", "archive"),
    (".gz", "application/gzip", "gzip", "archive"),
    (".tar", "application/x-tar", "tar", "archive"),
    (".7z", "application/x-7z-compressed", "7z", "archive"),
)
BY_SUFFIX = {suffix: told for suffix, *told in FORMATS}
# Suffixes that stand for the same format, and the usual one.
CANONICAL = {".yml": ".yaml", ".sqlite3": ".sqlite", ".htm": ".html", ".jpeg": ".jpg", ".tif": ".tiff"}
TEXT_MODALITIES = ("text", "web", "sql_script", "semi_structure", "tabular")

# First bytes, and the suffix whose format they show.
SIGNATURES = (
    (b"%PDF-", ".pdf"),
    (b"\x89PNG\r\n\x1a\n", ".png"),
    (b"\xff\xd8\xff", ".jpg"),
    (b"GIF87a", ".gif"),
    (b"GIF89a", ".gif"),
    (b"II*\0", ".tiff"),
    (b"MM\0*", ".tiff"),
    (b"SQLite format 3\0", ".sqlite"),
    (b"ID3", ".mp3"),
    (b"\xff\xfb", ".mp3"),
    (b"fLaC", ".flac"),
    (b"OggS", ".ogg"),
)
ZIP, OLE, RIFF = b"PK\x03\x04", b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1", b"RIFF"
IN_RIFF = ((b"WAVE", ".wav"), (b"WEBP", ".webp"), (b"AVI ", ".avi"))
#: MIME types of other suffixes, as the standard library has them: a guess.
GUESSES = {suffix: mime for suffix, mime in mimetypes.types_map.items() if suffix not in BY_SUFFIX}


def safe_prefix(prefix: str) -> str:
    """A prefix below the root: forward slashes, no slashes at the ends, empty for
    the root itself.  One that leads out of the root is an error."""
    clean = prefix.replace("\\", "/").strip("/")
    parts = [p for p in clean.split("/") if p not in ("", ".")]
    if ".." in parts:
        raise ValueError(f"prefix leads out of the lake: {prefix!r}")
    return "/".join(parts)


def listing(spark: SparkSession, root: str, prefix: str = "", suffixes: tuple[str, ...] = (), content: bool = False) -> DataFrame:
    """One row per file below ``root/prefix``: relative_path, filename, extension,
    size_bytes, last_modified; with ``content`` also its bytes, null for files of
    LARGEST bytes or more (readers then give an error, see
    :func:`fathom.sources.tabular.large` for tables of any size).  Without ``content`` no file is opened.  ``suffixes``
    are matched in lower case.  Spark's file sources leave out empty files, and so
    does this."""
    below = safe_prefix(prefix)
    at = root.rstrip("/")
    read = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    found = _told(read.load(f"{at}/{below}" if below else at), at, content)
    return found.filter(F.col("extension").isin(*suffixes)) if suffixes else found


def named(spark: SparkSession, root: str, paths: list[str], content: bool = False) -> DataFrame:
    """The rows of :func:`listing` for some files by relative path; no other is looked at."""
    at = root.rstrip("/")
    escaped = [re.sub(r"([\\{}\[\]*?])", r"\\\1", p) for p in paths]  # names aren't patterns
    return _told(spark.read.format("binaryFile").load([f"{at}/{p}" for p in escaped]), at, content)


def relative_to(root: str, path: str | Column = "path") -> Column:
    """A path below ``root``, which may come with scheme and host or without."""
    scheme = r"^[A-Za-z][A-Za-z0-9+.\-]*:(//[^/]*)?"
    base = re.sub(scheme, "", root.rstrip("/")) + "/"
    return F.substr(F.regexp_replace(path, scheme, ""), F.lit(len(base) + 1))


def _told(files: DataFrame, root: str, content: bool) -> DataFrame:
    relative = relative_to(root)
    return files.select(
        relative.alias("relative_path"),
        filename(relative).alias("filename"),
        extension(relative).alias("extension"),
        F.col("length").alias("size_bytes"),
        F.col("modificationTime").alias("last_modified"),
        *([F.when(F.col("length") < LARGEST, F.col("content")).alias("content")] if content else []),
    )


def _suffix_map(field: int) -> Column:
    return F.create_map(*chain.from_iterable((F.lit(s), F.lit(v[field])) for s, v in BY_SUFFIX.items()))


def signature_suffix(head: str = "head", suffix: str = "extension") -> Column:
    """The suffix whose format the first bytes show; containers (ZIP, OLE) are what
    their name says if it names one of their formats; null if they show nothing."""
    h = F.col(head)
    s = F.col(suffix)
    found = F
    for code, name in SIGNATURES:
        found = found.when(F.startswith(h, F.lit(code)), F.lit(name))
    zipped = F.when(s.isin(".xlsx", ".docx", ".pptx", ".epub"), s).otherwise(".zip")
    found = found.when(F.startswith(h, F.lit(ZIP)), zipped)
    ole = F.when(s.isin(".xls", ".doc", ".ppt"), s).otherwise("ole")
    found = found.when(F.startswith(h, F.lit(OLE)), ole)
    for code, name in IN_RIFF:
        found = found.when(F.startswith(h, F.lit(RIFF)) & (F.substring(h, 9, 4) == F.lit(code)), F.lit(name))
    return found.when(F.substring(h, 5, 4) == F.lit(b"ftyp"), F.when(s == ".m4a", s).otherwise(".mp4"))


def _encodings(heads: pa.Array) -> pa.Array:
    def one(head: bytes | None) -> str | None:
        if not head:
            return "utf-8"
        if head.startswith(codecs.BOM_UTF8):
            return "utf-8-sig"
        if head.startswith((codecs.BOM_UTF16_LE, codecs.BOM_UTF16_BE)):
            return "utf-16"
        if b"\0" in head:
            return None
        try:
            # A cut through a character at the end of the sample is no error.
            codecs.getincrementaldecoder("utf-8")().decode(head)
            return "utf-8"
        except UnicodeDecodeError:
            pass
        try:
            head.decode("windows-1252")
            return "windows-1252"
        except UnicodeDecodeError:
            return None

    return pa.array([one(x) for x in heads.to_pylist()], pa.string())


def heads(files: DataFrame, root: str, size: int = HEAD) -> DataFrame:
    """Listed files with ``content``: no more than their first bytes, read in tasks.
    The store must be one that Arrow's file systems reach; where only Spark does, list
    with content instead.  A file that is gone meanwhile has null content."""
    names = [c for c in files.columns if c != "content"]
    at = root.rstrip("/")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(at if re.match(r"^[A-Za-z0-9+.\-]+:", at) else "file://" + at)

        def first(path: str) -> bytes | None:
            try:
                with store.open_input_file(f"{base.rstrip('/')}/{path}") as source:
                    return source.read(size)
            except FileNotFoundError:
                return None

        for batch in batches:
            read = pa.array([first(x) for x in batch.column("relative_path").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, read], [*batch.schema.names, "content"])

    plain = files.select(*names)
    return plain.mapInArrow(run, StructType([*plain.schema.fields, StructField("content", BinaryType())]))


def identify(files: DataFrame) -> DataFrame:
    """Listed files (with content, or with :func:`heads`) with detected MIME type,
    format, modality, confidence (0.99 by content, 0.85 by name, 0.35 by a guess from
    other names, 0.1 by nothing), encoding of text, canonical_extension, and a warning
    where name and content disagree or say nothing."""
    headed = files.withColumn("head", F.substring("content", 1, HEAD)).drop("content")
    by_content = signature_suffix()
    known = F.col("extension").isin(*BY_SUFFIX)
    chosen = headed.withColumn("signature", by_content).withColumn(
        "kind", F.coalesce("signature", F.when(known, F.col("extension")))
    )
    field = [F.element_at(_suffix_map(i), F.col("kind")) for i in range(3)]
    is_ole = F.col("kind") == "ole"
    shown = [F.element_at(_suffix_map(1), F.col(c)) for c in ("extension", "signature")]
    databases = ("database", "sqlite")
    disagree = (shown[0] != shown[1]) & ~(shown[0].isin(*databases) & shown[1].isin(*databases))
    told = F.array(F.concat(F.lit("The name says "), shown[0], F.lit(", the content "), shown[1], F.lit(".")))
    guess = F.element_at(F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in sorted(GUESSES.items()))), F.col("extension"))
    none = F.array().cast("array<string>")
    usual = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in CANONICAL.items()))
    typed = chosen.select(
        "*",
        F.coalesce(field[0], F.when(is_ole, "application/x-ole-storage"), guess, F.lit("application/octet-stream")).alias("detected_mime_type"),
        F.coalesce(field[1], F.when(is_ole, "ole"), F.nullif(F.substring("extension", 2, 99), F.lit("")), F.lit("unknown")).alias("detected_format"),
        F.coalesce(field[2], F.lit("unknown")).alias("modality"),
        F.when(F.col("signature").isNotNull(), 0.99).when(known, 0.85).when(guess.isNotNull(), 0.35).otherwise(0.1).alias("identification_confidence"),
        F.coalesce(F.element_at(usual, F.col("extension")), F.col("extension")).alias("canonical_extension"),
        F.when(known & disagree, told)
        .when(F.col("kind").isNull(), F.array(F.lit("Neither name nor content show a known format.")))
        .otherwise(none)
        .alias("warnings"),
    )
    encoding = F.arrow_udf(_encodings, "string")(F.col("head"))
    return typed.withColumn("encoding", F.when(F.col("modality").isin(*TEXT_MODALITIES), encoding)).drop("head", "kind", "signature")


#: Where windows-1252 has other characters than Latin-1, which Spark can decode.
C1_SIGNS = tuple(
    "".join(x) for x in zip(*((chr(b), bytes([b]).decode("windows-1252")) for b in range(128, 160) if b not in (129, 141, 143, 144, 157)), strict=True)
)


def text_of(files: DataFrame, into: str = "text") -> DataFrame:
    """Files (with content) with their bytes as text: UTF-8, a byte order mark cut off,
    malformed bytes replaced.  Content of other ``encoding`` (of :func:`identify`, if the
    column is there) is decoded by it."""
    text = F.regexp_replace(F.make_valid_utf8(F.col("content").cast("string")), "^\ufeff", "")
    if "encoding" in files.columns:
        by = F.col("encoding")
        text = (
            F.when(by == "utf-16", F.decode("content", "UTF-16"))
            .when(by == "windows-1252", F.translate(F.decode("content", "ISO-8859-1"), *C1_SIGNS))
            .otherwise(text)
        )
    return files.withColumn(into, text)
