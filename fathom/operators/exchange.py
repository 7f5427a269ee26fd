"""Exchange of parse results as JSON lines, and question and answer files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.functions.scalars import strip

RESULT, ERROR = "document_result", "document_error"
SECTION = "section_id string, chunk_index int, heading string, content string, page_start int, page_end int"
RECORD = (
    "type string, relative_path string, file_format string, size_bytes long, last_modified string,"
    f" error_message string, sections array<struct<{SECTION.replace(' string', ':string').replace(' int', ':int')}>>"
)


def export_lines(results: DataFrame, errors: DataFrame, path: str) -> None:
    """One JSON object per line: results with their sections, then errors."""
    good = results.withColumn("type", F.lit(RESULT))
    bad = errors.withColumn("type", F.lit(ERROR))
    both = good.unionByName(bad, allowMissingColumns=True)
    both.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)


def import_lines(spark: SparkSession, path: str) -> DataFrame:
    """Results of such files; errors are skipped, another type fails the job."""
    rows = spark.read.schema(RECORD).json(path)
    known = F.col("type").isin(RESULT, ERROR)
    told = F.concat(F.lit("unknown record type: "), F.coalesce("type", F.lit("none")))
    checked = rows.withColumn("type", F.when(known, F.col("type")).otherwise(F.raise_error(told)))
    return checked.filter(F.col("type") == RESULT).drop("type", "error_message")


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """(id, question) of a CSV file, or of the first sheet of a workbook, with columns STT
    and Question; rows that lack one of them drop."""
    if path.lower().endswith(".xlsx"):
        from fathom.sources import tabular

        file = spark.read.format("binaryFile").load(path)
        named = file.select(F.element_at(F.split("path", "/"), -1).alias("relative_path"), F.lit("q.xlsx").alias("filename"), F.lit(".xlsx").alias("extension"), "content")
        sheet = tabular.tables(tabular.read(named)).filter("sheet_index = 0")
        at = {c: F.array_position("header", F.lit(c)).cast("int") for c in ("STT", "Question")}
        cells = sheet.select(F.explode("body").alias("r"), *(p.alias(f"at_{c}") for c, p in at.items()))
        rows = cells.select(*(F.try_element_at("r", F.nullif(f"at_{c}", F.lit(0))).alias(c) for c in at))
    else:
        rows = spark.read.csv(path, header=True, multiLine=True, escape='"')
    cut = rows.select(strip("STT").alias("id"), strip("Question").alias("question"))
    return cut.filter("length(id) > 0 and length(question) > 0")


ANSWERS = "id string, answer string, evidences string"


def write_answers(answers: DataFrame, path: str) -> None:
    """Answers (id, answer, evidences) as CSV with a header, in order of id."""
    rows = answers.select("id", F.coalesce("answer", F.lit("")).alias("answer"), F.coalesce("evidences", F.lit("")).alias("evidences"))
    rows.orderBy("id").write.mode("overwrite").csv(path, header=True, escape='"', emptyValue="")


def read_answers(spark: SparkSession, path: str) -> DataFrame:
    """Answers written before, to resume from."""
    return spark.read.schema(ANSWERS).csv(path, header=True, multiLine=True, escape='"')
