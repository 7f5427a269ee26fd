"""Toxicity by a classifier chain.

Categories are predicted one after the other by logistic models over the words
and beginnings of words that a text has; each later model also sees the probabilities
of the categories before it.  For training these come from out-of-fold
predictions, so that a later model learns from probabilities as good as those it
will meet.  The last category, toxic at all, gives the verdict: it is told by the
end of the chain, which sees what all the links before it say.

The models are fitted on a bounded sample of labelled rows, all folds of a link at
the same time, each in a task of its own.
"""

from __future__ import annotations

import gc
import re
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.llm.common import prepare, text_bytes

#: Labelled documents that the models are fitted on, at most.
TRAIN_ROWS = 8_000
#: Words and their beginnings of these lengths, which endings leave as they are, are
#: hashed into so many features; those that fewer of the sampled documents have
#: are left out.
FEATURES = 1 << 18
BEGINNINGS = (4, 5, 6)
LEAST_DOCUMENTS = 5
FOLDS = 4
PENALTY = 2e-5
#: A fit ends when the slope has fallen to this share of the first one.
TOLERANCE = 1e-5
MOST_ROUNDS = 1_000
MEMO_WORDS = 200_000
SEED = 8
#: The labels have one flag for toxicity and one for quality, which make these
#: categories: toxic in good prose, toxic in poor text, toxic at all.
CATEGORIES = {
    "toxic_prose": "toxic = 1 and quality = 1",
    "toxic_junk": "toxic = 1 and quality = 0",
    "toxic": "toxic = 1",
}
WORDS = re.compile(rb"[0-9a-z\x80-\xff]+")


def features_of_word(word: bytes) -> list[int]:
    """The word's own feature, and those of its beginnings."""
    begins = (b"^" + word[:k] for k in BEGINNINGS if len(word) >= k)
    return [xxhash.xxh64_intdigest(x) % FEATURES for x in (b"^" + word + b"$", *begins)]


class Featurizer:
    """The features that a text has, each once, ascending."""

    def __init__(self) -> None:
        self.memo: dict[bytes, list[int]] = {}

    def __call__(self, text: bytes) -> np.ndarray:
        if len(self.memo) > MEMO_WORDS:
            self.memo = {}
        found: set[int] = set()
        for w in set(WORDS.findall(text.lower())):
            known = self.memo.get(w)
            if known is None:
                known = self.memo[w] = features_of_word(w)
            found.update(known)
        return np.array(sorted(found), np.int64)


class Rows:
    """Documents as sets of features, and dense columns beside them."""

    def __init__(self, sets: list[np.ndarray], width: int = FEATURES) -> None:
        self.n, self.width = len(sets), width
        self.sizes = np.array([len(x) for x in sets], np.int64)
        self.index = np.concatenate([np.zeros(0, np.int32), *(x.astype(np.int32) for x in sets)])

    def __getattr__(self, name: str) -> np.ndarray:
        if name != "owner":
            raise AttributeError(name)
        self.owner = np.repeat(np.arange(self.n, dtype=np.int32), self.sizes)  # not sent with a broadcast
        return self.owner

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "owner"}

    def times(self, w: np.ndarray, dense: np.ndarray) -> np.ndarray:
        sparse = np.bincount(self.owner, w[self.index], self.n) if self.n else np.zeros(0)
        return sparse + dense @ w[self.width :]

    def back(self, r: np.ndarray, dense: np.ndarray) -> np.ndarray:
        return np.concatenate((np.bincount(self.index, r[self.owner], self.width), r @ dense))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def fit_logistic(rows: Rows, dense: np.ndarray, y: np.ndarray, use: np.ndarray) -> np.ndarray:
    """Weights of least penalised loss over the rows in ``use``, by a limited-memory
    quasi-Newton descent with step halving; deterministic."""
    n = max(1.0, float(use.sum()))

    def at(w: np.ndarray) -> tuple[float, np.ndarray]:
        z = rows.times(w, dense)
        loss = float((use * (np.logaddexp(0, z) - y * z)).sum()) / n + PENALTY / 2 * float(w @ w)
        return loss, rows.back(use * (sigmoid(z) - y), dense) / n + PENALTY * w

    w = np.zeros(rows.width + dense.shape[1])
    loss, slope = at(w)
    enough = TOLERANCE * np.linalg.norm(slope)
    past: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(MOST_ROUNDS):
        if np.linalg.norm(slope) <= enough:
            break
        turn, held = slope.copy(), []
        for s, g, r in reversed(past):
            a = r * float(s @ turn)
            turn -= a * g
            held.append(a)
        if past:
            s, g, _ = past[-1]
            turn *= float(s @ g) / float(g @ g)
        for (s, g, r), a in zip(past, reversed(held), strict=True):
            turn += (a - r * float(g @ turn)) * s
        down, step = float(slope @ turn), 1.0
        while step > 1e-10:
            new = w - step * turn
            new_loss, new_slope = at(new)
            if new_loss <= loss - 1e-4 * step * down:
                break
            step /= 2
        else:
            break
        s, g = new - w, new_slope - slope
        if (bend := float(s @ g)) > 1e-12:
            past = [*past[-9:], (s, g, 1 / bend)]
        w, loss, slope = new, new_loss, new_slope
    return w


@dataclass
class Chain:
    """Links in order; ``weights`` of a link: features, a constant, and one weight
    for the probability of each link before it."""

    categories: list[str]
    weights: list[np.ndarray]
    #: Probability from which on a text has the category.
    thresholds: list[float]
    #: Of the sample: ids, folds, and each category's out-of-fold probabilities.
    ids: list[int] = field(default_factory=list)
    folds: np.ndarray | None = None
    outside: np.ndarray | None = None

    def probabilities(self, rows: Rows) -> np.ndarray:
        """A column for each category, each link fed by those before it."""
        dense = np.ones((rows.n, 1))
        for w in self.weights:
            dense = np.column_stack((dense, sigmoid(rows.times(w, dense))))
        return dense[:, 1:]


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The cut of out-of-fold probabilities with the best F-score, by which a clean text
    flagged weighs more than a toxic one missed (beta 1/2)."""
    if not y.any():
        return 1.0
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[order])
    score = 1.25 * hits / (np.arange(1, len(y) + 1) + 0.25 * y.sum())
    at = int(np.argmax(score))
    below = p[order[at + 1]] if at + 1 < len(p) else 0.0
    return float((p[order[at]] + below) / 2)


def sample_of(docs: DataFrame, labels: DataFrame, categories: dict[str, str], rows: int) -> list:
    """(doc_id, flags, fold, features) of the sample, by doc_id: labels in order of
    a hash of their id.  Of an id labelled more than once the highest toxic and the
    lowest quality count; of one with several texts, that with the least hash."""
    spark = prepare(docs.sparkSession)
    known = labels.filter("doc_id is not null and quality is not null and toxic is not null")
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("quality").alias("quality"))
    flags = F.array(*(F.expr(e).cast("int") for e in categories.values())).alias("flags")
    chosen = known.orderBy(F.xxhash64("doc_id", F.lit(SEED)), "doc_id").limit(rows).select("doc_id", flags)
    wanted = {r.doc_id: r.flags for r in chosen.collect()}  # at most ``rows``
    shared = spark.sparkContext.broadcast(frozenset(wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Featurizer()
        for batch in batches:
            picked = batch.filter(pa.array([i in shared.value for i in batch.column("doc_id").to_pylist()], pa.bool_()))
            texts = text_bytes(picked.column("text"))
            digests = np.array([xxhash.xxh64_intdigest(x) for x in texts], np.uint64).view(np.int64)
            features = [made(x).astype(np.int32).tobytes() for x in texts]
            yield pa.RecordBatch.from_arrays(
                [picked.column("doc_id").cast(pa.int64()), pa.array(digests), pa.array(features, pa.binary())], ["doc_id", "digest", "features"]
            )

    told = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    read = told.mapInArrow(run, "doc_id long, digest long, features binary")
    once = read.groupBy("doc_id").agg(F.min(F.struct("digest", "features")).alias("d"))  # a row per id of the sample
    told = once.select("doc_id", "d.*").toArrow()
    ids, digests, features = (told.column(n).to_pylist() for n in ("doc_id", "digest", "features"))
    return sorted((i, wanted[i], d % FOLDS, np.frombuffer(f, np.int32)) for i, d, f in zip(ids, digests, features, strict=True))


def fits(spark: SparkSession, shared: Broadcast, dense: np.ndarray, y: np.ndarray, folds: np.ndarray) -> list[np.ndarray]:
    """Weights without each fold in turn, then those over all rows; a task each.
    ``shared``: the bounded sample's features."""
    beside = spark.sparkContext.broadcast((dense, y, folds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column("id").to_pylist():
                d, labels, own = beside.value
                w = fit_logistic(shared.value, d, labels, (own != k).astype(float))
                yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([w.tobytes()], pa.binary())], ["fold", "weights"])

    made = spark.range(0, FOLDS + 1, 1, FOLDS + 1).mapInArrow(run, "fold long, weights binary").collect()
    beside.destroy()
    return [np.frombuffer(r.weights) for r in sorted(made)]


def train(docs: DataFrame, labels: DataFrame, categories: dict[str, str] = CATEGORIES, rows: int = TRAIN_ROWS) -> Chain:
    """Fit the chain on at most ``rows`` labelled documents (see :func:`sample_of`).

    Needs ``doc_id`` and ``text`` in ``docs``, and in ``labels`` doc_id, quality and
    toxic; labels with a null in one of them are left out, other columns play no
    part.  Equal texts share a fold.  The result does not depend on the order or the
    partitions of the rows.  Without labelled documents every probability is 1/2
    and nothing is toxic."""
    spark = prepare(docs.sparkSession)
    sample = sample_of(docs, labels, categories, rows)
    n = len(sample)
    used = np.flatnonzero(np.bincount(np.concatenate([np.zeros(0, np.int32), *(x[3] for x in sample)]), minlength=FEATURES) >= LEAST_DOCUMENTS)
    place = np.full(FEATURES, -1, np.int32)
    place[used] = np.arange(len(used))
    features = Rows([p[p >= 0] for p in (place[x[3]] for x in sample)], len(used))
    shared = spark.sparkContext.broadcast(features)
    y = np.array([x[1] for x in sample], float).reshape(n, len(categories))
    folds = np.array([x[2] for x in sample], np.int64)
    dense = np.ones((n, 1))
    weights, thresholds = [], []
    for k in range(len(categories)):
        outside, whole = np.full(n, 0.5), np.zeros(FEATURES + dense.shape[1])
        if n:
            *without, best = fits(spark, shared, dense, y[:, k], folds)
            for f, w in enumerate(without):
                outside[folds == f] = sigmoid(features.times(w, dense))[folds == f]
            whole[used], whole[FEATURES:] = best[: len(used)], best[len(used) :]
        weights.append(whole)
        thresholds.append(best_threshold(outside, y[:, k]))
        dense = np.column_stack((dense, outside))
    shared.destroy()
    return Chain(list(categories), weights, thresholds, [x[0] for x in sample], folds, dense[:, 1:])


def predict(docs: DataFrame, chain: Chain, into: str = "toxicity") -> DataFrame:
    """``docs`` with a struct column ``into`` (replaced if there): a probability
    ``p_<category>`` for each category, and whether the chain's last category
    holds (``flagged``).

    Needs ``text``; null and empty texts have no words, which leaves the models'
    constant terms and what they make of each other.  Rows stand alone, other
    columns pass untouched, an empty table gives none.
    """
    spark = prepare(docs.sparkSession)
    shared = spark.sparkContext.broadcast(replace(chain, ids=[], folds=None, outside=None))  # a fixed number of features
    names = [f"p_{c}" for c in chain.categories]

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        gc.disable()
        c, made = shared.value, Featurizer()
        for column in batches:
            p = c.probabilities(Rows([made(x) for x in text_bytes(column)]))
            columns = [pa.array(p[:, k]) for k in range(len(names))]
            yield pa.StructArray.from_arrays([*columns, pa.array(p[:, -1] >= c.thresholds[-1])], [*names, "flagged"])

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    kind = ", ".join([f"{n} double" for n in names] + ["flagged boolean"])
    return docs.withColumn(into, F.arrow_udf(run, kind).asNondeterministic()(F.col("text").cast("string")))
