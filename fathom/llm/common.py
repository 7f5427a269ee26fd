"""Small helpers that the text operators share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of characters other than these six bytes, which are
#: exactly the white space of ``bytes.split()``.
WORD = r"[^\x20\x09-\x0D]+"

#: Arrow batches handed to Python are cut at this many bytes, so that a few
#: very long documents cannot fill a worker.
ARROW_BATCH_BYTES = 8 << 20
ARROW_BATCH_ROWS = 4000

#: Since Spark 4.1; earlier versions don't look at it.
CLEAR_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Keys that joins meet apart from the others, and the least rows of such a key.
HOT_KEYS = 64
HOT_ROWS = 256


def prepare(spark: SparkSession) -> SparkSession:
    """Bound Arrow batches by bytes and rows, and make sure that a checkpoint
    folder is set: the cluster's own, or a temporary one in local mode."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BATCH_BYTES))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_BATCH_ROWS))
    shared_dir(spark)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share."""
    sc = spark.sparkContext
    found = sc.getCheckpointDir()
    if not found:
        found = sc.getConf().get("spark.checkpoint.dir")
        if not found:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            found = tempfile.mkdtemp(prefix="fathom-checkpoint-")
        sc.setCheckpointDir(found)
        found = sc.getCheckpointDir() or found
    return found


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder name (URI) below the shared folder; not created yet."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def shuffles_cleared(spark: SparkSession) -> Iterator[None]:
    """Spark clears the shuffle files of what runs meanwhile as soon as it has run.  For
    steps whose rows are written and read from there; else the files of each step
    lie until the driver collects its garbage."""
    was = spark.conf.get(CLEAR_SHUFFLES, "false")
    spark.conf.set(CLEAR_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEAR_SHUFFLES, was)


def stored(df: DataFrame) -> DataFrame:
    """Cut lineage: the rows are written to the shared checkpoint folder."""
    shared_dir(df.sparkSession)
    with shuffles_cleared(df.sparkSession):
        return df.select("*").checkpoint(eager=True)  # the setting holds for tables that are made under it


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows, written to the shared folder and read again."""
    folder = new_folder(df.sparkSession, name)
    with shuffles_cleared(df.sparkSession):
        df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def hot_keys(rows: DataFrame, key: str) -> list:
    """The most frequent keys: at most HOT_KEYS, each with HOT_ROWS rows or more.
    No other key can have more than one row in HOT_KEYS of all."""
    often = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= HOT_ROWS)
    return [r[0] for r in often.orderBy(F.desc("n"), key).limit(HOT_KEYS).collect()]


def hot_join(many: DataFrame, few: DataFrame, key: str, often: list | None = None, how: str = "inner") -> DataFrame:
    """``many`` with the columns of ``few``, which has one row per key, where a key
    may have a large share of the rows of ``many`` (which is read twice): rows of
    the most frequent keys stay where they are and meet a broadcast of at most
    HOT_KEYS rows, the others meet by an exchange.  Keys are not null."""
    often = hot_keys(many, key) if often is None else often
    if not often:
        return many.join(few, key, how)
    hot = F.col(key).isin(often)
    met = many.filter(hot).join(F.broadcast(few.filter(hot)), key, how)
    return many.filter(~hot).join(few.filter(~hot), key, how).unionByName(met)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null counts as empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def texts(column: pa.Array) -> list[str]:
    """A string column as Python text; null counts as empty."""
    return ["" if x is None else x for x in column.to_pylist()]


def text_or_empty(column="text"):
    return F.coalesce(F.col(column).cast("string"), F.lit(""))
