"""Many questions at once, and the index of cells, against plain scans."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathom.operators import nearest, search
from fathom.operators.nearest import Cells

SF = "/root/testdata/sf0.01/embeddings.parquet"


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.read.parquet(SF).repartition(5).cache()


def plain(rows, question, limit):
    """(score, id) of the nearest rows, by comparing all."""
    q = np.array(question, float)
    found = []
    for r in rows:
        if r.embedding is None or len(r.embedding) != len(q) or None in r.embedding:
            continue
        v = np.array(r.embedding, float)
        if np.isfinite(v).all() and v.any():
            found.append((round(1 - v @ q / np.sqrt((v @ v) * (q @ q)), 6), r.vec_id))
    return sorted(found)[:limit]


def test_many_questions(spark, vectors, monkeypatch):
    rows = vectors.collect()
    asked = vectors.filter("vec_id % 25 = 0").select(F.col("vec_id").alias("q"), "embedding")
    want = {r.vec_id: plain(rows, r.embedding, 7) for r in rows if r.vec_id % 25 == 0}
    for block, held in ((1 << 22, 1 << 18), (200, 50)):
        monkeypatch.setattr(nearest, "BLOCK_NUMBERS", block)
        monkeypatch.setattr(nearest, "HELD_ROWS", held)
        got = {}
        for r in nearest.nearest(vectors, asked, "q", "vec_id", 7, digits=6).orderBy("q", "place").collect():
            got.setdefault(r.q, []).append((r.score, r.vec_id))
        assert got == want


def test_no_row_for_each_pair_is_shuffled(spark, vectors):
    asked = vectors.select(F.col("vec_id").alias("q"), "embedding")
    plan = nearest.nearest(vectors, asked, "q", "vec_id", 3)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan and plan.count("MapInArrow") == 1


ODD = [(1, [1.0, 0.0], "a"), (1, [1.0, 0.0], "a"), (2, None, "a"), (3, [0.0, 0.0], "b"), (4, [float("nan"), 1.0], "b"), (5, [1.0], "b"), (6, [0.0, 2.0], None), (7, [None, 1.0], "a"), (None, [3.0, 3.0], "b")]


def test_odd_vectors(spark):
    docs = spark.createDataFrame(ODD, "vec_id long, embedding array<double>, kind string")
    asked = spark.createDataFrame([("x", [1.0, 1.0]), ("zero", [0.0, 0.0]), (None, [1.0, 0.0]), ("none", None), ("y", [0.0, 1.0])], "q string, embedding array<double>")
    got = nearest.nearest(docs, asked, "q", "vec_id", 9, group="kind", digits=3).collect()
    found = {(r.q, r.kind, r.place): (r.vec_id, r.score) for r in got}
    assert found == {
        ("x", "a", 1): (1, 0.293), ("x", "a", 2): (1, 0.293), ("x", "b", 1): (None, 0.0), ("x", None, 1): (6, 0.293),
        ("y", "a", 1): (1, 1.0), ("y", "a", 2): (1, 1.0), ("y", "b", 1): (None, 0.293), ("y", None, 1): (6, 0.0),
    }
    assert nearest.nearest(docs, asked.limit(0), "q", "vec_id", 9).collect() == []


def test_tiles_of_questions_are_one_step(spark, vectors, monkeypatch):
    """However many questions there are, vectors are read once, and the driver holds none."""
    monkeypatch.setattr(nearest, "BLOCK_NUMBERS", 640)
    asked = vectors.select(F.col("vec_id").alias("q"), "embedding")
    plan = nearest.nearest(vectors, asked, "q", "vec_id", 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_copies_and_groups_by_small_stretches(spark, monkeypatch):
    """Many rows as near as others, by group and of two lengths: the first in order count."""
    for name, n in (("BLOCK_NUMBERS", 16), ("HELD_ROWS", 10), ("ASKED", 2), ("STRETCH", 70), ("SENT_ROWS", 7)):
        monkeypatch.setattr(nearest, name, n)
    shapes = [[1.0, 0.0], [0.6, 0.8], [0.0, 3.0], [1.0, 1.0, 1.0], [1.0, 0.0, 2.0]]
    docs = [((i * 7919) % 1000, shapes[i * i % 5], "abc"[i % 3] if i % 4 else None) for i in range(1000)]
    asked = [(f"q{i}", shapes[i % 5]) for i in range(23)]
    got = nearest.nearest(
        spark.createDataFrame(docs, "vec_id long, embedding array<double>, kind string").repartition(3),
        spark.createDataFrame(asked, "q string, embedding array<double>"), "q", "vec_id", 6, group="kind", digits=6,
    )
    want = set()
    for name, q in asked:
        for kind in ("a", "b", "c", None):
            near = sorted((abs(round(1 - np.dot(v, q) / np.sqrt(np.dot(v, v) * np.dot(q, q)), 6)), i) for i, v, k in docs if k == kind and len(v) == len(q))
            want |= {(name, kind, place, i, score) for place, (score, i) in enumerate(near[:6], 1)}
    rows = [(r.q, r.kind, r.place, r.vec_id, r.score) for r in got.collect()]
    assert len(rows) == len(want) and set(rows) == want


@pytest.fixture(scope="module")
def index(spark, vectors, tmp_path_factory):
    made = Cells.build(vectors.filter("vec_id % 3 > 0"), str(tmp_path_factory.mktemp("cells") / "i"), "vec_id", cells=20)
    made.append(vectors.filter("vec_id % 3 = 0"))
    return Cells.load(spark, made.folder)


def test_exact_mode_equals_the_scan(vectors, index):
    rows = vectors.collect()
    for r in rows[::97]:
        got = [(x.score, x.vec_id) for x in index.exact(list(r.embedding), "vec_id", 10, digits=6).collect()]
        assert got == plain(rows, r.embedding, 10)


def recall(index, rows, asked, probes):
    hits = 0
    for r in asked:
        hits += len({x.vec_id for x in index.probe(list(r.embedding), "vec_id", 10, probes).collect()} & {i for _, i in plain(rows, r.embedding, 10)})
    return hits / (10 * len(asked))


def test_recall_and_pruning(vectors, index):
    """The given vectors hardly lie in clusters: 95 of 100 take 17 of 20 cells."""
    rows = vectors.collect()
    assert recall(index, rows, [r for r in rows if r.vec_id % 20 == 0], 17) >= 0.95
    assert "PartitionFilters: [cell" in index.read([1, 2])._jdf.queryExecution().toString()
    assert index.read(list(range(-1, 20))).count() == len(rows)


def test_clusters_take_few_cells(spark, tmp_path):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(30, 16))
    data = [(i, (centres[i % 30] + 0.1 * rng.normal(size=16)).tolist()) for i in range(1500)]
    docs = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    index = Cells.build(docs, str(tmp_path / "i"), "vec_id", cells=30)
    rows = docs.collect()
    assert recall(index, rows, rows[::150], 3) >= 0.95
    cells, share = index.needed(data[7][1], 10)
    assert share < 0.5 and len(cells) <= 15


def test_index_of_odd_vectors(spark, tmp_path):
    docs = spark.createDataFrame(ODD, "vec_id long, embedding array<double>, kind string")
    index = Cells.build(docs, str(tmp_path / "i"), "vec_id")
    assert [r.vec_id for r in index.exact([0.0, 1.0], "vec_id", 9).collect()] == [6, None, 1, 1]
    none = Cells.build(docs.limit(0), str(tmp_path / "none"), "vec_id")
    assert none.needed([1.0, 0.0], 3) == ([], 0.0)
    assert search.top(search.scored(none.read([]), [1.0, 0.0]), ["score"], 3).collect() == []
