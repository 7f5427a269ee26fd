"""Nearest vectors: many questions in one pass, and an index of cells.

:func:`nearest` asks many questions at once.  Questions are dealt to tiles and vectors to
parts; a task has a tile and a part, holds the tile's questions, and gets the part's vectors
group by group in their order.  It multiplies a stretch of them with a block of questions
at a time, and keeps, for each question, the group's best rows only.  So what is shuffled
are the vectors for each tile, the questions for each part, and ``limit`` rows for each part,
question and group, and never a row for each question and vector.

:class:`Cells` is an index on disk.  Centroids are fitted in Spark on a bounded sample; every
vector is written to the cell of its nearest centroid, a folder of its own, so that a
search reads the cells that it wants and no others.  :meth:`Cells.probe` reads the nearest
few.  :meth:`Cells.exact` reads cells in order of the least distance that one of its vectors
can have, which the triangle inequality tells from the centroid's distance and the cell's
radius, and stops when no cell that is left can hold a better one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from fathom.operators import search

#: Numbers in a tile of questions, about.
BLOCK_NUMBERS = 1 << 21
#: Rows that a task keeps for all its questions before it drops those that are nobody's best.
HELD_ROWS = 1 << 16
#: Questions and vectors that are multiplied at once, and rows that are sent on at once.
ASKED, STRETCH, SENT_ROWS = 1024, 1024, 10_000
#: Vectors that cells are fitted on, at most.
SAMPLE = 65_536
#: Distances of unit vectors are known to so much.
ROUNDING = 1e-9


def matrix(column: pa.ListArray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows that are finite vectors of this size, not all zeros, as unit vectors of
    doubles; and which rows these are."""
    lengths = np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False), nan=-1).astype(np.int64)
    fit = np.flatnonzero(lengths == size)
    flat = column.take(pa.array(fit)).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    rows = flat.reshape(len(fit), size)
    norm = np.sqrt((rows * rows).sum(1))
    good = np.isfinite(norm) & (norm > 0)
    return rows[good] / norm[good, None], fit[good]


class _Tile:
    """Questions, and for each its best rows so far of the group that is being read."""

    def __init__(self, names: pa.Array, asked: np.ndarray, limit: int, digits: int | None) -> None:
        self.names, self.asked, self.limit, self.digits = names, asked, limit, digits
        self.clear()

    def clear(self) -> None:
        self.score = np.full((len(self.asked), self.limit), np.inf)
        self.place = np.full((len(self.asked), self.limit), -1, np.int64)  # in ``held``, put end to end
        self.held: list[pa.Table] = []
        self.n_held = self.n_seen = 0
        self.most = HELD_ROWS

    def add(self, rows: np.ndarray, plain: pa.Table) -> None:
        """More rows of the group, none of which comes before one that is there."""
        at = 0
        while at < len(rows):
            # Short stretches first: they tell what later ones must be better than.
            n = max(64, min(STRETCH, self.n_seen))
            part = rows[at : at + n]
            for q in range(0, len(self.asked), ASKED):
                self._compare(q, part, self.n_held + at)
            self.n_seen += len(part)
            at += n
        self.held.append(plain)
        self.n_held += len(plain)
        if self.n_held > self.most:
            self._drop()

    def _compare(self, q: int, part: np.ndarray, first: int) -> None:
        asked = self.asked[q : q + ASKED]
        last = self.score[q : q + ASKED, -1]
        scores = 1.0 - asked @ part.T
        # Of equal scores the earlier row counts, so a later one must be less, once rounded.
        less = last if self.digits is None else last - 0.25 * 10.0**-self.digits
        of, at = np.nonzero(scores < less[:, None])
        found = scores[of, at]
        if self.digits is not None:
            found = np.round(found, self.digits) + 0.0
            kept = found < last[of]
            of, at, found = of[kept], at[kept], found[kept]
        if not len(of):
            return
        own = np.unique(of)
        of = np.concatenate((np.repeat(own, self.limit), of))
        found = np.concatenate((self.score[q + own].ravel(), found))
        place = np.concatenate((self.place[q + own].ravel(), at + first))
        ranked = np.lexsort((place, found, of))
        begin = np.searchsorted(of[ranked], own)
        best = ranked[begin[:, None] + np.arange(self.limit)]
        self.score[q + own], self.place[q + own] = found[best], place[best]

    def _drop(self) -> None:
        """Hold only rows that are among some question's best."""
        live = np.unique(self.place[self.place >= 0])
        self.place = np.where(self.place >= 0, np.searchsorted(live, self.place), -1)
        self.held = [pa.concat_tables(self.held).take(pa.array(live))]
        self.n_held = len(live)
        self.most = max(HELD_ROWS, 2 * len(live))

    def told(self, key: str) -> Iterator[pa.RecordBatch]:
        """The group's best rows, after which another may begin."""
        if self.held:
            self._drop()
            of, k = np.nonzero(self.place >= 0)
            for a in range(0, len(of), SENT_ROWS):
                q, j = of[a : a + SENT_ROWS], k[a : a + SENT_ROWS]
                rows = self.held[0].take(pa.array(self.place[q, j])).append_column(key, self.names.take(pa.array(q)))
                yield from rows.append_column("score", pa.array(self.score[q, j])).combine_chunks().to_batches()
        self.clear()


def _candidates(key: str, vector: str, group: str | None, limit: int, digits: int | None):
    """Each cell's best rows for each question and group.  A cell's questions come first, then
    its vectors by group and in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, kind, tile = None, None, None
        asked: list[tuple[pa.Array, np.ndarray]] = []
        for batch in batches:
            codes = [batch.column("__cell").to_numpy(), batch.column("__row").to_numpy()]
            if group:
                codes.append(np.nan_to_num(batch.column(group).dictionary_encode().indices.to_numpy(zero_copy_only=False), nan=-1))
            changed = np.logical_or.reduce([c[1:] != c[:-1] for c in codes])
            cuts = [0, *(np.flatnonzero(changed) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:], strict=False):
                part = batch.slice(a, b - a)
                cell = int(codes[0][a])
                if cell != now:
                    if tile:
                        yield from tile.told(key)
                    now, kind, tile, asked = cell, None, None, []
                if codes[1][a] == 0:
                    rows, at = matrix(part.column(vector), part.column("__size")[0].as_py())
                    asked.append((part.column(key).take(pa.array(at)), rows))
                    continue
                if asked:
                    names, tiles = zip(*asked, strict=True)
                    tile, asked = _Tile(pa.concat_arrays(names), np.concatenate(tiles), limit, digits), []
                if not tile or not len(tile.asked):
                    continue
                own = part.column(group)[0].as_py() if group else None
                if own != kind:
                    yield from tile.told(key)
                    kind = own
                rows, at = matrix(part.column(vector), tile.asked.shape[1])
                tile.add(rows, pa.Table.from_batches([part]).drop_columns(["__cell", "__row", "__size", key, vector]).take(pa.array(at)))
        if tile:
            yield from tile.told(key)

    return run


def nearest(
    vectors: DataFrame, questions: DataFrame, key: str, order: str, limit: int,
    vector: str = "embedding", group: str | None = None, digits: int | None = None,
) -> DataFrame:
    """For each question (``key``, a string or whole number, and ``vector``) the rows of
    ``vectors`` nearest by cosine distance, at most ``limit``, or so many of each value of the
    column ``group``: ``key``, ``place`` (from 1), ``score`` (rounded to ``digits``) and the
    rows' columns but the vector.  Ties go by the column ``order``.

    Vectors that are null, all zeros, not finite or of another length than the
    question's are no hits, and such questions have none; so do questions without a name.
    Questions are dealt to tiles of about BLOCK_NUMBERS numbers; the driver sees how many
    there are of each length, and no more of them.
    """
    spark = vectors.sparkSession
    plain = [f for f in vectors.schema if f.name not in (vector, key, "score", "place")]
    kind = next(f for f in questions.schema if f.name == key)
    schema = StructType([*plain, StructField(key, kind.dataType), StructField("score", DoubleType())])
    named = questions.filter(F.col(key).isNotNull() & (F.size(vector) > 0)).select(key, vector)
    counts = named.groupBy(F.size(vector).alias("size")).count().collect()  # a row a length
    tiles = {r["size"]: -(-r["count"] * r["size"] // BLOCK_NUMBERS) for r in counts}
    if not tiles or limit < 1:
        return spark.createDataFrame([], StructType([StructField(key, kind.dataType), StructField("place", IntegerType()), StructField("score", DoubleType()), *plain]))
    parts = -(-spark.sparkContext.defaultParallelism // sum(tiles.values()))
    first = dict(zip(tiles, np.cumsum([0, *tiles.values()]).tolist(), strict=False))  # tile of each length

    def cells(rows: DataFrame, row: int, tile, part) -> DataFrame:
        size = F.size(vector)
        of = F.create_map(*chain.from_iterable((F.lit(d), F.struct(F.lit(first[d]).alias("first"), F.lit(n).alias("n"))) for d, n in tiles.items()))
        told = rows.withColumn("__size", size).withColumn("__of", F.try_element_at(of, size)).filter("__of is not null")
        told = told.withColumn("__tile", tile(F.col("__of.n"))).withColumn("__part", part)
        cell = ((F.col("__of.first") + F.col("__tile")) * parts + F.col("__part")).cast("int")
        return told.withColumn("__cell", cell).withColumn("__row", F.lit(row)).drop("__of", "__tile", "__part")

    def hashed(column: str, n) -> Column:
        return F.pmod(F.xxhash64(column, vector), F.lit(n) if isinstance(n, int) else n)

    asked = cells(named, 0, lambda n: hashed(key, n), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    asked = asked.select("*", *(F.lit(None).cast(f.dataType).alias(f.name) for f in plain))
    told = vectors.select(*(f.name for f in plain), F.lit(None).cast(kind.dataType).alias(key), vector)
    told = cells(told, 1, lambda n: F.explode(F.sequence(F.lit(0), n - 1)), hashed(order, parts))
    dealt = asked.unionByName(told).repartitionById(sum(tiles.values()) * parts, "__cell")
    ranked = dealt.sortWithinPartitions("__cell", "__row", *([group] if group else []), order)
    found = ranked.mapInArrow(_candidates(key, vector, group, limit, digits), schema)
    by = Window.partitionBy(key, *([group] if group else [])).orderBy("score", order)
    return (
        found.withColumn("place", F.row_number().over(by))
        .filter(F.col("place") <= limit)
        .select(key, "place", "score", *(f.name for f in plain))
    )


CELL = "cell int, radius double, n long"


@dataclass
class Cells:
    """An index of vectors in ``folder``: ``rows`` by cell, ``cells`` with what each write
    has put into them; ``centroids`` are unit vectors, a cell each.  Rows whose vector
    is no use (see :func:`nearest`) are in the cell -1, which is never searched."""

    spark: SparkSession
    folder: str
    centroids: np.ndarray
    vector: str = "embedding"

    @classmethod
    def build(cls, vectors: DataFrame, folder: str, key: str, cells: int | None = None, vector: str = "embedding") -> Cells:
        """Fit centroids on at most SAMPLE vectors, those with the least hashes of ``key``,
        and write all.  ``cells``: by default the square root of the number of vectors."""
        spark = vectors.sparkSession
        unit = _unit(vectors, vector)
        n = unit.count()
        # A hash below a share of its range: about SAMPLE rows, in one narrow pass.
        share = min(1.0, SAMPLE / max(n, 1))
        picked = unit.filter(F.pmod(F.xxhash64(F.lit("cells"), key), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))).limit(2 * SAMPLE)
        k = max(1, min(cells or round(math.sqrt(n)), n))
        found = np.zeros((0, 0))
        if n:
            model = KMeans(k=k, seed=1, maxIter=10, featuresCol="f").fit(picked.select(array_to_vector("__unit").alias("f")))
            found = np.array(model.clusterCenters())
            norm = np.sqrt((found * found).sum(1))
            found = found[norm > 0] / norm[norm > 0, None]
        made = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(found)], "cell int, centroid array<double>")
        made.coalesce(1).write.parquet(f"{folder}/centroids")
        vectors.limit(0).coalesce(1).write.parquet(f"{folder}/schema")
        index = cls(spark, folder, found, vector)
        index.append(vectors)
        return index

    @classmethod
    def load(cls, spark: SparkSession, folder: str, vector: str = "embedding") -> Cells:
        rows = spark.read.parquet(f"{folder}/centroids").orderBy("cell").collect()  # a row a cell
        return cls(spark, folder, np.array([r.centroid for r in rows]), vector)

    def append(self, vectors: DataFrame) -> None:
        """Put more vectors into the cells; nothing that is there is written again."""
        placed = self._placed(vectors)
        placed.write.mode("append").partitionBy("cell").parquet(f"{self.folder}/rows")
        told = placed.groupBy("cell").agg(F.max("distance").alias("radius"), F.count(F.lit(1)).alias("n"))
        told.coalesce(1).write.mode("append").parquet(f"{self.folder}/cells")

    def _placed(self, vectors: DataFrame) -> DataFrame:
        centroids = self.centroids

        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for column in batches:
                cell, far = np.full(len(column), -1, np.int32), np.zeros(len(column))
                if len(centroids):
                    rows, at = matrix(column, centroids.shape[1])
                    near = rows @ centroids.T
                    cell[at] = near.argmax(1)
                    far[at] = np.sqrt(((rows - centroids[cell[at]]) ** 2).sum(1))
                yield pa.StructArray.from_arrays([pa.array(cell), pa.array(far)], ["cell", "distance"])

        run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
        made = F.arrow_udf(run, "cell int, distance double").asNondeterministic()
        told = vectors.withColumn("__cell", made(self.vector))
        told = told.withColumn("cell", F.col("__cell.cell")).withColumn("distance", F.col("__cell.distance")).drop("__cell")
        # A cell's rows together, so that a write makes few files; a large cell is split.
        return told.repartition("cell", F.pmod(F.xxhash64(self.vector), F.lit(4)))

    def order(self, question: list[float]) -> list[tuple[int, float, int]]:
        """(cell, least distance that a vector in it can have, vectors in it), cells with
        the nearest centroids first."""
        q = np.array(question, np.float64)
        q = q / np.sqrt((q * q).sum())
        if not len(self.centroids):
            return []
        told = self.spark.read.schema(CELL).parquet(f"{self.folder}/cells").groupBy("cell").agg(F.max("radius").alias("radius"), F.sum("n").alias("n"))
        far = np.sqrt(((self.centroids - q) ** 2).sum(1))
        rows = [r for r in told.collect() if r.cell >= 0]  # a row a cell
        return [(r.cell, max(0.0, float(far[r.cell]) - r.radius), r.n) for r in sorted(rows, key=lambda r: far[r.cell])]

    def read(self, cells: list[int]) -> DataFrame:
        """The rows of some cells; the others' folders are not opened."""
        schema = self.spark.read.parquet(f"{self.folder}/schema").schema
        every = StructType([*schema, StructField("distance", DoubleType()), StructField("cell", IntegerType())])
        return self.spark.read.schema(every).parquet(f"{self.folder}/rows").filter(F.col("cell").isin(*cells)).drop("cell", "distance")

    def probe(self, question: list[float], key: str, limit: int, probes: int, digits: int | None = None) -> DataFrame:
        """The nearest of the ``probes`` nearest cells, by score (cosine distance), then ``key``."""
        cells = [c for c, _, _ in self.order(question)[:probes]]
        return search.top(search.scored(self.read(cells), question, self.vector, digits), ["score", key], limit)

    def exact(self, question: list[float], key: str, limit: int, digits: int | None = None, first: int = 4) -> DataFrame:
        """The nearest of all.  Cells are read in few jobs, each time twice as many."""
        cells, _ = self.needed(question, limit, digits, first)
        return search.top(search.scored(self.read(cells), question, self.vector, digits), ["score", key], limit)

    def needed(self, question: list[float], limit: int, digits: int | None = None, first: int = 4) -> tuple[list[int], float]:
        """Cells that hold the nearest vectors for sure, and their share of all vectors."""
        order = sorted(self.order(question), key=lambda x: x[1])
        slack = ROUNDING + (10.0**-digits if digits is not None else 0.0)
        taken, best = [], []
        while len(taken) < len(order):
            bound = order[len(taken)][1] ** 2 / 2  # of unit vectors, half the square is the cosine distance
            if len(best) == limit and bound > best[-1] + slack:
                break
            more = [c for c, _, _ in order[len(taken) : len(taken) + max(first, len(taken))]]
            taken += more
            scores = search.scored(self.read(more), question, self.vector).filter("score is not null").orderBy("score").limit(limit)
            best = sorted([*best, *(r.score for r in scores.select("score").collect())])[:limit]
        total = sum(n for _, _, n in order)
        return taken, sum(n for c, _, n in order if c in set(taken)) / total if total else 0.0


def _unit(vectors: DataFrame, vector: str) -> DataFrame:
    """Rows with ``__unit``, the vector as a unit vector, where it can be one and has the
    most frequent length."""
    v = F.transform(vector, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    rows = vectors.withColumn("__norm", norm).filter((F.col("__norm") > 0) & (F.col("__norm") < float("inf")))
    sizes = rows.groupBy(F.size(vector).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    rows = rows.filter(F.size(vector) == (sizes[0].d if sizes else -1))
    return rows.withColumn("__unit", F.transform(vector, lambda x: x.cast("double") / F.col("__norm"))).drop("__norm")
