"""Transcripts of sound and video: import, sections with times, usage, captions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fathom.functions.scalars import normalize_text, stable_id
from fathom.functions.search_texts import timed_search_text
from fathom.operators import chunking
from fathom.operators.sections import time_share

TRANSCRIPT = (
    "source_sha1 string, model string, full_text string, text string, duration_seconds string,"
    " segments array<struct<text:string,start_seconds:string,end_seconds:string>>"
)


def read_transcripts(spark: SparkSession, folder: str) -> DataFrame:
    """(name, transcript) of the JSON files of a folder; ``name`` is the path below it
    without ``.json``."""
    files = spark.read.option("recursiveFileLookup", True).text(folder, wholetext=True)
    path = F.url_decode(F.replace("_metadata.file_path", F.lit("+"), F.lit("%2B")))
    base = folder.split("://")[-1].removeprefix("file:").rstrip("/") + "/"
    name = F.regexp_replace(F.substring_index(path, base, -1), r"\.json$", "")
    return files.select(name.alias("name"), F.from_json("value", TRANSCRIPT).alias("transcript"))


def imported(sounds: DataFrame, transcripts: DataFrame) -> DataFrame:
    """(relative_path, segment, text, start_seconds, end_seconds, model_name, error) of
    those ``sounds`` (relative_path, filename, sha1) for which there is a transcript.

    It is looked for by the sound's path, then its name, then its name without suffix.
    One that tells another checksum than the file has gives an error row, and so does
    one without any text.  Without segments the full text is one.
    """
    stem = F.regexp_replace("filename", r"\.[^.]+$", "")
    wanted = sounds.select(
        "relative_path", "sha1", F.posexplode(F.array("relative_path", "filename", stem)).alias("rank", "name")
    )
    first = F.min(F.struct("rank", "sha1", "transcript")).alias("t")
    found = wanted.join(transcripts, "name").groupBy("relative_path")
    # A struct with an array of structs has an order, so the least rank wins.
    found = found.agg(first).select("relative_path", "t.sha1", "t.transcript.*")
    whole = normalize_text(F.coalesce(F.when(F.length("full_text") > 0, F.col("full_text")), F.col("text"), F.lit("")))
    cut = F.transform(
        "segments",
        lambda s: F.struct(
            normalize_text(F.coalesce(s["text"], F.lit(""))).alias("text"),
            s["start_seconds"].try_cast("double").alias("start_seconds"),
            s["end_seconds"].try_cast("double").alias("end_seconds"),
        ),
    )
    one = F.array(
        F.struct(whole.alias("text"), F.lit(0.0).alias("start_seconds"), F.col("duration_seconds").try_cast("double").alias("end_seconds"))
    )
    told = F.when(F.size("segments") > 0, F.filter(cut, lambda s: s["text"] != "")).otherwise(F.filter(one, lambda s: s["text"] != ""))
    wrong = (F.length("source_sha1") > 0) & (F.col("source_sha1") != F.coalesce("sha1", F.lit("")))
    error = F.when(wrong, F.concat(F.lit("the transcript is of a file with checksum "), F.col("source_sha1")))
    error = F.coalesce(error, F.when((F.coalesce(F.size("segments"), F.lit(0)) <= 0) & (whole == ""), F.lit("the transcript has no text")))
    made = found.withColumn("error", error).withColumn("parts", F.when(F.col("error").isNull(), told))
    return made.select(
        "relative_path",
        F.coalesce(F.when(F.length("model") > 0, F.col("model")), F.lit("imported_transcript")).alias("model_name"),
        "error",
        F.posexplode_outer("parts").alias("segment", "p"),
    ).select("relative_path", "segment", "p.text", "p.start_seconds", "p.end_seconds", "model_name", "error")


def sound_sections(segments: DataFrame, source: str = "source_id") -> DataFrame:
    """(source, section_id, chunk_index, content, start_seconds, end_seconds,
    char_count, search_text) of ``segments``: source, segment, text, start_seconds,
    end_seconds.  A long segment is cut, and its time shared out evenly."""
    kept = segments.filter(F.length("text") > 0).select(source, "segment", "text", "start_seconds", "end_seconds")
    cut = chunking.cut(kept, "text", "text").withColumnRenamed("chunk_index", "k")
    n = F.count(F.lit(1)).over(Window.partitionBy(source, "segment"))
    share = time_share(F.col("k") - 1, F.col("n"), F.col("start_seconds"), F.col("end_seconds"))
    timed = cut.withColumn("n", n).withColumn("t", share)
    order = Window.partitionBy(source).orderBy("segment", "k")
    placed = timed.select(
        source,
        F.row_number().over(order).alias("chunk_index"),
        "content",
        F.col("t.start_seconds").alias("start_seconds"),
        F.col("t.end_seconds").alias("end_seconds"),
        "char_count",
    )
    key = [F.col(source), F.lit("audio"), F.col("chunk_index"), F.col("start_seconds"), F.col("end_seconds")]
    return placed.withColumn("section_id", stable_id("section", *key)).withColumn(
        "search_text", timed_search_text(F.col("content"), F.col("start_seconds"), F.col("end_seconds"))
    )


def usage(parts: DataFrame, by: str, cost: str = "cost_usd", seconds: str = "seconds") -> DataFrame:
    """(by, cost, seconds, n_chunks): sums over a file's model calls, null where no call
    tells a number."""
    return parts.groupBy(by).agg(
        F.sum(F.col(cost).cast("double")).alias("cost"), F.sum(F.col(seconds).cast("double")).alias("seconds"), F.count(F.lit(1)).alias("n_chunks")
    )


def video_sections(spoken: DataFrame, captions: DataFrame, source: str = "source_id") -> DataFrame:
    """Sections of videos: what is spoken (of :func:`sound_sections`), then captions of
    frames (source, frame_index, timestamp_seconds, content), numbered on.  A caption
    without content drops."""
    told = spoken.select(
        source,
        F.lit("transcript_chunk").alias("section_type"),
        "chunk_index",
        "content",
        "start_seconds",
        "end_seconds",
        F.lit(None).cast("double").alias("timestamp_seconds"),
        F.lit(None).cast("int").alias("frame_index"),
    )
    last = spoken.groupBy(source).agg(F.max("chunk_index").alias("last"))
    text = normalize_text("content")
    seen = captions.withColumn("content", text).filter(F.length("content") > 0).join(last, source, "left")
    place: Column = F.row_number().over(Window.partitionBy(source).orderBy("timestamp_seconds", "frame_index"))
    frames = seen.select(
        source,
        F.lit("frame_caption").alias("section_type"),
        (F.coalesce("last", F.lit(0)) + place).alias("chunk_index"),
        "content",
        F.lit(None).cast("double").alias("start_seconds"),
        F.lit(None).cast("double").alias("end_seconds"),
        F.col("timestamp_seconds").cast("double").alias("timestamp_seconds"),
        F.col("frame_index").cast("int").alias("frame_index"),
    )
    at = F.coalesce("timestamp_seconds", "start_seconds")
    both = told.unionByName(frames)
    ends = F.when(F.col("section_type") == "frame_caption", at).otherwise(F.col("end_seconds"))
    key = [F.col(source), F.col("section_type"), F.col("chunk_index")]
    return both.withColumn("section_id", stable_id("vidsec", *key)).withColumn("search_text", timed_search_text(F.col("content"), at, ends))
