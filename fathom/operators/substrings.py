"""An index of character trigrams for lexical search.

Every row's text, in lower case, is told by its distinct runs of three characters; the
index holds, sorted by trigram, the rows that have each.  Parquet keeps the least and
greatest trigram of each stretch of a file, so a search reads the stretches with its own
and no others.  A question is split at its wildcards; the rows that have the rarest
trigrams of its parts are looked up, and only those are compared with the pattern itself.
A question without three characters in a row is answered by a scan.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.operators import search

#: Trigrams that are looked up for a question.
RAREST = 4
#: Bits of a character in a trigram's number.
CHAR_BITS = 21
#: Characters of a text that are looked at at once, and postings that a task sends at once.
CHARS, POSTINGS = 1 << 18, 1 << 18
#: Rows of a stretch of a file: what a search reads at least for each trigram.
STRETCH_BYTES = 1 << 20


def trigrams(text: str) -> np.ndarray:
    """The distinct runs of three characters, as numbers, ascending; found by stretches."""
    found = np.zeros(0, np.int64)
    for a in range(0, len(text) - 2, CHARS):
        codes = np.frombuffer(text[a : a + CHARS + 2].encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        new = np.unique(codes[:-2] << 2 * CHAR_BITS | codes[1:-1] << CHAR_BITS | codes[2:])
        found = np.union1d(found, new) if len(found) else new
    return found


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each text and trigram, sent on every POSTINGS rows, as a batch may have
    any number of them."""
    held: list[tuple[int, np.ndarray]] = []

    def sent() -> pa.RecordBatch:
        grams = np.concatenate([x for _, x in held])
        ids = np.repeat(np.array([i for i, _ in held], np.int64), [len(x) for _, x in held])
        return pa.RecordBatch.from_arrays([pa.array(grams), pa.array(ids)], ["gram", "id"])

    n = 0
    for batch in batches:
        for i, text in zip(batch.column("id"), batch.column("text"), strict=True):  # one at a time
            held.append((i.as_py(), trigrams(text.as_py())))
            n += len(held[-1][1])
            if n >= POSTINGS:
                yield sent()
                held, n = [], 0
    if held:
        yield sent()


def parts_of(text: str) -> list[str]:
    """What a question's matches hold for sure: its parts between wildcards (see
    :func:`fathom.operators.search.pattern`)."""
    found, now, plain = [], "", False
    for c in search.pattern(text)[1:]:
        if plain:
            now, plain = now + c, False
        elif c == "\\":
            plain = True
        elif c in "%_":
            found.append(now)
            now = ""
        else:
            now += c
    return [p for p in (*found, now) if p]


@dataclass
class SubstringIndex:
    """An index in ``folder``: ``rows`` with an ``id`` each, ``postings`` (gram, id) sorted
    by gram, and ``grams`` (gram, n), how many rows have each."""

    spark: SparkSession
    folder: str
    text: str

    def append(self, rows: DataFrame) -> None:
        """Put rows into the index; nothing that is there is written again.  Rows whose
        text is null are kept, and never found."""
        write = uuid.uuid4().hex[:8]
        # Ids of different writes begin with different bits of a hash.
        first = F.shiftleft(F.xxhash64(F.lit(write)).bitwiseAND(F.lit((1 << 22) - 1)), 40)
        placed = rows.withColumn("id", first + F.monotonically_increasing_id() % F.lit(1 << 40))
        placed.write.mode("append").parquet(f"{self.folder}/rows/write={write}")
        kept = self.spark.read.parquet(f"{self.folder}/rows/write={write}")
        told = kept.filter(F.col(self.text).isNotNull()).select("id", F.lower(self.text).alias("text")).mapInArrow(_postings, "gram long, id long")
        ordered = told.repartitionByRange("gram").sortWithinPartitions("gram", "id")
        ordered.write.mode("append").option("parquet.block.size", STRETCH_BYTES).parquet(f"{self.folder}/postings")
        counts = self.spark.read.schema("gram long, id long").parquet(f"{self.folder}/postings")
        counts = counts.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
        counts.repartitionByRange("gram").sortWithinPartitions("gram").write.mode("overwrite").parquet(f"{self.folder}/grams-{write}")
        # The counts that hold are those named last; a search meanwhile uses the old ones.
        self.spark.createDataFrame([(f"grams-{write}",)], "name string").coalesce(1).write.mode("append").parquet(f"{self.folder}/current")

    @classmethod
    def build(cls, rows: DataFrame, folder: str, text: str) -> SubstringIndex:
        index = cls(rows.sparkSession, folder.rstrip("/"), text)
        index.append(rows)
        return index

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/rows").drop("write")

    def rarest(self, question: str) -> list[int] | None:
        """The trigrams that are looked up: none if a trigram of the question is nowhere
        (then nothing matches), None if the question has no trigram."""
        asked = np.unique(np.concatenate([np.zeros(0, np.int64), *(trigrams(p) for p in self.lowered(question))])).tolist()
        if not asked:
            return None
        names = self.spark.read.schema("name string").parquet(f"{self.folder}/current")
        newest = names.select("name", "_metadata.file_modification_time").orderBy(F.desc("file_modification_time")).head()[0]
        counts = self.spark.read.schema("gram long, n long").parquet(f"{self.folder}/{newest}")
        found = sorted((r.n, r.gram) for r in counts.filter(F.col("gram").isin(*asked)).collect())  # at most a question's length
        return [g for _, g in found[:RAREST]] if len(found) == len(asked) else []

    def lowered(self, question: str) -> list[str]:
        """A question's parts as Spark lowers them."""
        parts = parts_of(question)
        if not parts:
            return []
        return list(self.spark.range(1).select(F.transform(F.array(*map(F.lit, parts)), lambda p: F.lower(p))).head()[0])

    def candidates(self, grams: list[int]) -> DataFrame:
        """(id) of the rows that have all of these trigrams."""
        read = self.spark.read.schema("gram long, id long").parquet(f"{self.folder}/postings").filter(F.col("gram").isin(*grams))
        return read.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == len(grams)).select("id")

    def holding(self, question: str) -> DataFrame:
        """All rows whose text holds the question, in any case."""
        grams = self.rarest(question)
        if grams is None:
            return self.rows().filter(search.holds(self.text, question)).drop("id")
        if not grams:
            return self.rows().limit(0).drop("id")
        return self.rows().join(self.candidates(grams), "id", "left_semi").filter(search.holds(self.text, question)).drop("id")

    def lexical(self, question: str, order: list[str], limit: int = 5) -> DataFrame:
        """What :func:`fathom.operators.search.lexical` gives over the rows."""
        return search.top(self.holding(question), order, limit)
