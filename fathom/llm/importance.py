"""Quality classifier by importance resampling.

Two generative models over hashed word n-grams (one and two words), one of target
text and one of all text, give each document a log weight: the sum over its
n-grams of log p_target - log p_raw.  Documents are sampled in proportion to their
weights without replacement: to each log weight a Gumbel number is added, and the
k largest sums are taken.  k is the number of documents at least as much like
the target as all but a small share of the target sample is.
"""

from __future__ import annotations

import gc
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.llm.common import new_folder, prepare, stored, text_bytes

BUCKETS = 1 << 15
#: Labelled documents that the target model is fitted on, at most.
TARGET_ROWS = 20_000
#: Share of the target sample whose weight may lie below the weakest taken one.
MISSED = 0.005
SMOOTHING = 1.0
SEED = 7
MEMO_WORDS = 300_000
#: Runs of letters and digits, and runs of other signs.
TOKENS = re.compile(rb"[0-9A-Za-z\x80-\xff]+|[^0-9A-Za-z\x80-\xff\s]+")


class Features:
    """Buckets of the n-grams of documents."""

    def __init__(self, buckets: int) -> None:
        self.buckets = np.uint64(buckets)
        self.memo: dict[bytes, int] = {}

    def __call__(self, documents: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All buckets in a line, and how many each document has."""
        cut = [TOKENS.findall(x.lower()) for x in documents]
        if len(self.memo) > MEMO_WORDS:
            self.memo = {}
        memo = self.memo
        for w in {w for c in cut for w in c if w not in memo}:
            memo[w] = xxhash.xxh64_intdigest(w)
        sizes = np.fromiter(map(len, cut), np.int64, len(cut))
        ones = np.fromiter(map(memo.__getitem__, chain.from_iterable(cut)), np.uint64, int(sizes.sum()))
        owner = np.repeat(np.arange(len(cut)), sizes)
        with np.errstate(over="ignore"):
            twos = (ones[:-1] * np.uint64(0x9E3779B97F4A7C15) + ones[1:]) * np.uint64(0xD6E8FEB86659FD93)
        inside = owner[1:] == owner[:-1]
        found = np.concatenate((ones % self.buckets, (twos[inside] >> np.uint64(20)) % self.buckets)).astype(np.int64)
        return found, np.concatenate((owner, owner[1:][inside]))


@dataclass
class Ratio:
    """log p_target - log p_raw of each bucket, for scoring; and the same from
    either half of the target sample, to judge the other half by."""

    whole: np.ndarray
    halves: tuple[np.ndarray, np.ndarray]
    of_half: dict[int, int]


def fit(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, rows: int = TARGET_ROWS) -> Ratio:
    """Count both models in one pass over ``docs``.

    The raw model counts every document.  The target model counts those that
    ``labels`` (doc_id, quality) marks 1, at most ``rows`` of them, taken in order
    of a hash of their id.
    """
    good = labels.filter("quality = 1 and doc_id is not null").select("doc_id").distinct()
    ids = [r.doc_id for r in good.orderBy(F.xxhash64("doc_id", F.lit(SEED)), "doc_id").limit(rows).collect()]
    half = {i: k % 2 for k, i in enumerate(ids)}
    shared = prepare(docs.sparkSession).sparkContext.broadcast(half)  # at most ``rows`` ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()
        features = Features(buckets)
        counts = np.zeros((3, buckets), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            kind = np.array([shared.value.get(i, 2) for i in batch.column("doc_id").to_pylist()])
            found, owner = features(text_bytes(batch.column("text")))
            for k in range(3):
                counts[k] += np.bincount(found[kind[owner] == k], minlength=buckets)
        used = np.flatnonzero(counts.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(used), *(pa.array(c[used]) for c in counts)], ["bucket", "a", "b", "rest"])

    each = docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
        run, "bucket long, a long, b long, rest long"
    )
    summed = each.groupBy("bucket").agg(*(F.sum(n).alias(n) for n in ("a", "b", "rest"))).collect()  # one row per bucket
    counts = np.zeros((3, buckets))
    for r in summed:
        counts[:, r.bucket] = r.a, r.b, r.rest

    def log_p(c: np.ndarray) -> np.ndarray:
        return np.log(c + SMOOTHING) - np.log(c.sum() + SMOOTHING * buckets)

    raw = log_p(counts.sum(0))
    a, b = (log_p(counts[k]) - raw for k in (0, 1))
    return Ratio(log_p(counts[0] + counts[1]) - raw, (a, b), half)


def weigh(docs: DataFrame, ratio: Ratio, into: str = "weight") -> DataFrame:
    """``docs`` with a struct column ``into``: log_weight, and, for documents of
    the target sample, held_out_weight from the half that they are not in."""
    spark = prepare(docs.sparkSession)
    shared = spark.sparkContext.broadcast(ratio)  # three arrays of BUCKETS and the bounded sample's ids

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        gc.disable()
        r = shared.value
        features = Features(len(r.whole))
        for ids, column in batches:
            n = len(column)
            found, owner = features(text_bytes(column))
            weights = np.bincount(owner, r.whole[found], n) if n else np.zeros(0)
            half = np.array([r.of_half.get(i, -1) for i in ids.to_pylist()], np.int64)
            held = np.zeros(n)
            for k in (0, 1):
                mine = (half == k)[owner]  # judged by the other half
                held += np.bincount(owner[mine], r.halves[1 - k][found[mine]], n)
            yield pa.StructArray.from_arrays(
                [pa.array(weights, pa.float64()), pa.array(held, pa.float64(), mask=half < 0)], ["log_weight", "held_out_weight"]
            )

    run.__annotations__ = {"batches": Iterator[tuple[pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    made = F.arrow_udf(run, "log_weight double, held_out_weight double").asNondeterministic()
    return docs.withColumn(into, made(F.col("doc_id"), F.col("text").cast("string")))


def gumbel(seed: int = SEED) -> Column:
    """A Gumbel number that depends on the doc_id alone."""
    u = (F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(f"gumbel-{seed}")), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    return -F.log(-F.log(u))


def kth_largest(numbers: DataFrame, column: str, k: int, most: int = 4096) -> float:
    """The exact k-th largest of a column that may be large: ever finer
    histograms, until few enough rows share the bin that holds it."""
    low, high = numbers.agg(F.min(column), F.max(column)).head()
    while low < high:
        inside = numbers.filter(F.col(column).between(low, high))
        at = F.least(F.floor((F.col(column) - low) * (1024 / (high - low))), F.lit(1023))
        bins = inside.groupBy(at.alias("at")).agg(
            F.count(F.lit(1)).alias("n"), F.min(column).alias("low"), F.max(column).alias("high")
        )
        for row in sorted(bins.collect(), reverse=True):  # at most 1024 rows
            if k <= row.n:
                break
            k -= row.n
        low, high = row.low, row.high
        if row.n <= most:
            last = numbers.filter(F.col(column).between(low, high)).select(column).collect()
            return sorted((r[0] for r in last), reverse=True)[k - 1]
    return low


def threshold(rows: DataFrame, ratio: Ratio, missed: float = MISSED) -> float:
    """The ``gumbel_key`` from which on documents are sampled.  ``rows`` (read several
    times) has log_weight, held_out_weight, gumbel_key and ``__id``."""
    if not ratio.of_half:
        return float("-inf")
    # One weight for each id of the target sample, however many rows it has.
    told = rows.filter("held_out_weight is not null").groupBy("__id").agg(F.min("held_out_weight").alias("w"))
    sample = sorted(r.w for r in told.select("w").collect())
    if not sample:
        return float("-inf")
    weakest = sample[int(missed * len(sample))]
    k = rows.filter(F.col("log_weight") >= weakest).count()
    return kth_largest(rows, "gumbel_key", k) if k else float("inf")


def classify(docs: DataFrame, labels: DataFrame, missed: float = MISSED) -> tuple[DataFrame, Ratio, float]:
    """(doc_id, log_weight, gumbel_key) of every row, written once; the models;
    and the key from which on documents are sampled.

    Needs ``doc_id`` and ``text`` in ``docs``, ``doc_id`` and ``quality`` in
    ``labels``.  Null and empty texts have log weight 0.  Rows without doc_id share
    one Gumbel number.  Equal rows have equal keys, so ties at the last place
    are all taken.  Without any target document nothing can be told apart, and all
    documents are taken; an empty table gives no rows.
    """
    ratio = fit(docs, labels)
    weighed = weigh(docs.select("doc_id", "text"), ratio)
    key = F.col("weight.log_weight") + gumbel()
    rows = stored(weighed.select("doc_id", "weight.*", key.alias("gumbel_key")))
    return rows, ratio, threshold(rows.withColumn("__id", F.col("doc_id")), ratio, missed)


def keep(docs: DataFrame, labels: DataFrame, missed: float = MISSED) -> DataFrame:
    """The rows of ``docs`` that are sampled, with the columns of ``docs``; see
    :func:`classify`.  The weighed rows are written to the shared folder once and read
    again for the cut.  Names that begin with ``__importance`` are not allowed."""
    ratio = fit(docs, labels)
    names = ("log_weight", "held_out_weight", "gumbel_key")
    weighed = weigh(docs, ratio, "__importance")
    key = F.col("__importance.log_weight") + gumbel()
    folder = new_folder(docs.sparkSession, "importance")
    own = [F.col("__importance.log_weight"), F.col("__importance.held_out_weight"), key]
    weighed.select(*docs.columns, *(c.alias(f"__importance_{n}") for c, n in zip(own, names, strict=True))).write.parquet(folder)
    rows = docs.sparkSession.read.parquet(folder)
    keyed = rows.select(F.col("doc_id").alias("__id"), *(F.col(f"__importance_{n}").alias(n) for n in names))
    least = threshold(keyed, ratio, missed)
    return rows.filter(F.col("__importance_gumbel_key") >= F.lit(least)).select(*docs.columns)
