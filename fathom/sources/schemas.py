"""Schemas of the catalog's tables: objects, files, and sections or tables of files.

Each modality's file and child tables have the common columns, and those that it adds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

OBJECT = (
    "object_id string not null, relative_path string not null, filename string, extension string, size_bytes bigint,"
    " last_modified timestamp, etag string, version_id string, detected_mime_type string, detected_format string,"
    " modality string, encoding string, identification_confidence double, warnings array<string>, status string,"
    " error_message string, is_present boolean, first_seen_at timestamp, last_seen_at timestamp"
)
FILE = (
    "source_id string not null, relative_path string not null, filename string, file_format string, size_bytes bigint,"
    " last_modified timestamp, status string, error_message string, is_present boolean, file_summary string,"
    " file_keywords array<string>, file_search_text string, parse_warnings array<string>, first_indexed_at timestamp"
)
SECTION = "section_id string not null, source_id string not null, chunk_index int, heading string, content string, char_count int, search_text string"
TABLE = (
    "table_id string not null, source_id string not null, table_name string, header array<string>, columns string,"
    " preview_rows array<array<string>>, row_count bigint, column_count int, summary string, keywords array<string>, search_text string"
)
IMAGE_SIZE = ", width int, height int"
# What a modality's files and children have besides.
OF_FILES = {
    "tabular": ", sheet_descriptions map<string,string>",
    "image": IMAGE_SIZE + ", color_mode string, has_alpha boolean, is_animated boolean, frame_count int",
    "epub": ", title string, creators array<string>, language string, publisher string, identifier string, chapter_count int, image_count int, vl_model_name string",
    "audio": ", duration_seconds double, codec_name string, sample_rate int, channels int, asr_model_name string, asr_cost_usd double",
    "video": (
        ", duration_seconds double" + IMAGE_SIZE + ", fps double, video_codec string, audio_codec string, has_audio boolean,"
        " sampled_frame_count int, asr_model_name string, asr_cost_usd double, vl_model_name string"
    ),
}
LINES = ", line_start int, line_end int"
OF_CHILDREN = {
    "tabular": ", sheet_name string, sheet_description string, is_context_sheet boolean",
    "text": LINES,
    "web": LINES,
    "image": LINES,
    "document": ", section_type string, page_start int, page_end int, image_index int",
    "slideshow": ", section_type string, slide_start int, slide_end int, image_index int",
    "epub": ", section_type string, chapter_index int, chapter_title string, chapter_href string, image_index int, image_href string",
    "audio": ", start_seconds double, end_seconds double",
    "video": ", section_type string, timestamp_seconds double, start_seconds double, end_seconds double, frame_index int",
}


def of_objects() -> StructType:
    return StructType.fromDDL(OBJECT)


def of_files(modality: str) -> StructType:
    return StructType.fromDDL(FILE + OF_FILES.get(modality, ""))


def of_children(modality: str) -> StructType:
    return StructType.fromDDL((TABLE if modality in ("tabular", "database") else SECTION) + OF_CHILDREN.get(modality, ""))


def shaped(rows: DataFrame, schema: StructType) -> DataFrame:
    """``rows`` with the schema's columns, in its order and types; missing ones are null."""
    return rows.select(*((F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema))


def ensure(spark: SparkSession, name: str, schema: StructType) -> None:
    """Make an empty table if there is none of this name."""
    if not spark.catalog.tableExists(name):
        spark.createDataFrame([], schema).write.saveAsTable(name)


def there(spark: SparkSession, names: dict[str, str]) -> tuple[dict[str, DataFrame], list[dict]]:
    """Tables by modality that exist, and for the others why they are skipped."""
    found = {m: spark.table(t) for m, t in names.items() if spark.catalog.tableExists(t)}
    return found, [{"modality": m, "reason": "table missing"} for m in names if m not in found]
