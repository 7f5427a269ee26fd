"""Whitening of embeddings by hierarchically merged singular value decompositions.

A partition of vectors is told by a :class:`State`: how many vectors it holds, their
exact sums, and the singular values and vectors of the centred ones, of all dimensions.
Two states merge without loss: the rows of both, each singular vector times its value,
are laid under each other with one more row, the difference of the means times
sqrt(n1 * n2 / (n1 + n2)), and what is found is decomposed again.  A task merges its
batches, and tasks' states are merged some at a time until one is left; none ever holds
more than so many square matrices.  The squares of the last singular values over n are
the covariance's eigenvalues.

Vectors are whole numbers, so sums are exact, and centring comes before any product.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.llm.common import new_folder, prepare

COMPONENTS = 16
SCALE, SHIFT = 64, 1_000_000
#: Whole numbers beyond this are cut to it, so that sums of a million fit 64 bits.
MOST = 1 << 42
#: Vectors that are decomposed at once, and states that a task merges.
ROWS = 4096
FAN = 16

STATE = "n long, sums array<long>, values array<double>, vectors array<double>"


@dataclass
class State:
    """``n`` vectors, their exact ``sums``, and of the centred ones the singular
    ``values``, falling, and ``vectors``, a row each."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray

    @classmethod
    def of(cls, x: np.ndarray) -> State:
        """Of a block of whole numbers, a vector a row."""
        sums = x.sum(0)
        return cls(len(x), sums.tolist(), *decomposed(centred(x, len(x), sums.tolist())))

    def merged(self, other: State) -> State:
        n = self.n + other.n
        # The difference of the means from whole numbers, so that equal parts vanish.
        between = [(a * other.n - b * self.n) / (self.n * other.n) for a, b in zip(self.sums, other.sums, strict=True)]
        correction = np.array(between) * np.sqrt(self.n * other.n / n)
        rows = np.concatenate((self.values[:, None] * self.vectors, other.values[:, None] * other.vectors, correction[None]))
        return State(n, [a + b for a, b in zip(self.sums, other.sums, strict=True)], *decomposed(rows))

    def batch(self) -> pa.RecordBatch:
        row = {"n": self.n, "sums": self.sums, "values": self.values.tolist(), "vectors": self.vectors.ravel().tolist()}
        kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.list_(pa.float64())]
        return pa.RecordBatch.from_arrays([pa.array([row[k]], t) for k, t in zip(row, kinds, strict=True)], list(row))

    @classmethod
    def read(cls, row: dict) -> State:
        d = len(row["sums"])
        return cls(row["n"], row["sums"], np.array(row["values"]), np.array(row["vectors"]).reshape(-1, d))


def decomposed(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Singular values and right vectors, of all dimensions that the rows can have."""
    if not rows.shape[1]:
        return np.zeros(0), np.zeros((0, 0))
    if len(rows) > 2 * rows.shape[1]:
        rows = np.linalg.qr(rows, mode="r")
    _, values, vectors = np.linalg.svd(rows, full_matrices=False)
    return values, vectors


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x minus sums / n, the whole part of the mean being taken off before rounding."""
    whole = [s // n for s in sums]
    rest = np.array([(s - n * w) / n for s, w in zip(sums, whole, strict=True)])
    return (x - np.array(whole, np.int64)).astype(np.float64) - rest


@dataclass
class Model:
    """``n`` distinct vectors with their exact ``sums``; of their covariance (divisor n) the
    ``eigenvalues``, falling, with unit ``components``, a row each, and the ``trace``.
    ``error``: the largest absolute entry of the whitened vectors' covariance minus
    the identity; null without components."""

    n: int
    sums: list[int]
    eigenvalues: np.ndarray
    components: np.ndarray
    trace: float
    error: float | None = None

    def whiten(self, x: np.ndarray) -> np.ndarray:
        return centred(x, self.n, self.sums) @ (self.components / np.sqrt(self.eigenvalues)[:, None]).T


def whole_numbers(vectors: DataFrame, column: str) -> DataFrame:
    """``vectors`` with an array<long> ``__x``: floor(SCALE * c) + SHIFT for each entry c
    as a double, beyond MOST cut to it.  Rows whose vector is null, or holds null or
    non-finite entries, go; so do those of another length than the most frequent one
    (of equally frequent ones, the greatest)."""
    v = F.col(column)
    finite = F.coalesce(F.forall(v, lambda c: F.coalesce(F.abs(c) < float("inf"), F.lit(False))), F.lit(False))
    rows = vectors.filter(finite)
    lengths = rows.groupBy(F.size(v).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    bound = float(MOST)

    def whole(c):
        scaled = F.least(F.greatest(c.cast("double") * SCALE, F.lit(-bound)), F.lit(bound))
        return F.floor(scaled).cast("long") + SHIFT

    d = lengths[0]["d"] if lengths else 0
    return rows.filter(F.size(v) == d).withColumn("__x", F.transform(v, whole))


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(flat) else np.zeros((len(column), 0), np.int64)


def _states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = None
    for batch in batches:
        x = matrix(batch.column("x"))
        for i in range(0, len(x), ROWS):
            state = State.of(x[i : i + ROWS])
            held = held.merged(state) if held else state
    if held:
        yield held.batch()


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = None
    for batch in batches:
        for row in batch.to_pylist():
            state = State.read(row)
            held = held.merged(state) if held else state
    if held:
        yield held.batch()


def merged_states(states: DataFrame, fan: int = FAN) -> State | None:
    """One state of all; each level is written to the shared folder, and its tasks
    merge ``fan`` states each.  None without states."""
    spark = states.sparkSession
    while True:
        folder = new_folder(spark, "svd-states")
        states.write.parquet(folder)
        states = spark.read.schema(STATE).parquet(folder)
        left = states.count()
        if left <= fan:
            rows = states.coalesce(1).mapInArrow(_merge, STATE).collect()  # one square matrix
            return State.read(rows[0].asDict()) if rows else None
        parts = -(-left // fan)
        states = states.repartition(parts).mapInArrow(_merge, STATE)


def _products(model: Model):
    """Sums of the whitened vectors' products, a row for each task and pair of components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(model.components)
        total, sums = np.zeros((k, k)), np.zeros(k)
        for batch in batches:
            w = model.whiten(matrix(batch.column("x")))
            total += w.T @ w
            sums += w.sum(0)
        places = np.arange(k * (k + 1))
        flat = np.concatenate((total.ravel(), sums))
        yield pa.RecordBatch.from_arrays([pa.array(places), pa.array(flat)], ["place", "value"])

    return run


def fit(vectors: DataFrame, column: str = "embedding", components: int = COMPONENTS) -> Model | None:
    """The model of the distinct vectors of ``vectors`` (see :func:`whole_numbers`); None
    if there is none.  Equal vectors count once.  Components whose eigenvalue is nothing
    but rounding (the vectors vary in fewer directions) are left out.  The distinct
    vectors are written to the shared folder and read again twice."""
    spark = prepare(vectors.sparkSession)
    folder = new_folder(spark, "whitening")
    whole_numbers(vectors, column).select(F.col("__x").alias("x")).distinct().write.parquet(folder)
    distinct = spark.read.schema("x array<long>").parquet(folder)
    state = merged_states(distinct.mapInArrow(_states, STATE))
    if state is None:
        return None
    eigenvalues = state.values**2 / state.n
    floor = eigenvalues[:1].sum() * (max(state.n, len(state.sums)) * np.finfo(float).eps) ** 2
    # Vectors of so many exact entries of this size are known no better than this.
    size = max((abs(s) / state.n for s in state.sums), default=0.0)
    floor = max(floor, (size * np.finfo(float).eps) ** 2)
    used = min(components, int((eigenvalues > floor).sum()))
    found = state.vectors[:used]
    # Either sign is right; the largest entry is made positive.
    largest = np.abs(found).argmax(1) if found.size else np.zeros(0, int)
    found = found * np.where(found[np.arange(used), largest] < 0, -1.0, 1.0)[:, None]
    model = Model(state.n, state.sums, eigenvalues[:used], found, float(eigenvalues.sum()))
    if used:
        products = distinct.mapInArrow(_products(model), "place long, value double")
        rows = products.groupBy("place").agg(F.sum("value").alias("value")).collect()  # used * (used + 1)
        value = np.zeros(used * (used + 1))
        for r in rows:
            value[r["place"]] = r["value"]
        mean = value[used * used :] / state.n
        covariance = value[: used * used].reshape(used, used) / state.n - np.outer(mean, mean)
        model.error = float(np.abs(covariance - np.eye(used)).max())
    return model


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sums over the dimensions of (n * x - sums) ** 2, exact; null beyond 64 bits."""
    s = np.array([v // n for v in sums], np.int64)
    rest = np.array([v - n * (v // n) for v in sums], np.float64)
    about = ((n * (x - s).astype(np.float64) - rest) ** 2).sum(1)
    if x.size and about.max() < 2**62:
        return ((n * (x - s) - rest.astype(np.int64)) ** 2).sum(1).tolist()
    exact = [sum((n * int(v) - t) ** 2 for v, t in zip(row, sums, strict=True)) for row in x]
    return [v if v < 2**63 else None for v in exact]


def whiten(vectors: DataFrame, model: Model | None, column: str = "embedding") -> DataFrame:
    """``vectors`` with ``whitened``, an array of a double for each component, and
    ``deviation`` (see :func:`deviations`).

    Rows whose vector is null, or holds null or non-finite entries, and those of another
    length than the model's go.  Repeated rows stay and get equal results; other
    columns pass untouched (of these names they are replaced; ``__x`` is not allowed).
    Without a model, no rows.
    """
    prepare(vectors.sparkSession)
    rows = whole_numbers(vectors, column)
    rows = rows.filter(F.size("__x") == (len(model.sums) if model else -1))

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for x in map(matrix, batches):
            w = model.whiten(x)
            ends = pa.array(np.arange(len(x) + 1) * w.shape[1], pa.int32())
            lists = pa.ListArray.from_arrays(ends, pa.array(w.ravel()))
            told = pa.array(deviations(x, model.n, model.sums), pa.int64())
            yield pa.StructArray.from_arrays([lists, told], ["whitened", "deviation"])

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    made = F.arrow_udf(run, "whitened array<double>, deviation long").asNondeterministic()
    names = {n: F.col(f"__made.{n}") for n in ("whitened", "deviation")}
    return rows.withColumn("__made", made("__x")).withColumns(names).drop("__x", "__made")
