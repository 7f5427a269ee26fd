"""Indexing runs over small lakes."""

import os

import pytest
from pyspark.sql import functions as F

from fathom.operators import enrich, indexing


def lake(root, files):
    for name, text in files.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)


def summed(counts):
    return (counts.discovered, counts.indexed, counts.unchanged, counts.error, counts.missing)


def test_second_run_is_unchanged_and_present(spark, tmp_path):
    """The counters of two runs over two tables beside a text that isn't one."""
    root, folder = tmp_path / "lake", str(tmp_path / "catalog")
    lake(root, {"tables/sales.csv": "customer_id,amount\n101,12.5\n", "tables/users.tsv": "user_id\tname\n1\talice\n", "tables/notes.txt": "ignore me"})
    snapshot, first = indexing.index(spark, str(root), folder, prefix="tables", model=enrich.head_summary)
    assert summed(first) == (2, 2, 0, 0, 0) and first.documents == 4
    before = sorted(snapshot.files.drop("first_indexed_at").collect())
    snapshot, second = indexing.index(spark, str(root), folder, prefix="tables", model=enrich.head_summary)
    assert summed(second) == (2, 0, 2, 0, 0) and second.documents == 0
    assert sorted(snapshot.files.drop("first_indexed_at").collect()) == before
    assert {(r.status, r.is_present) for r in snapshot.files.collect()} == {("indexed", True)}
    assert {(r.table_name, tuple(r.header), r.row_count) for r in snapshot.children.collect()} == {("sales", ("customer_id", "amount"), 1), ("users", ("user_id", "name"), 1)}


def test_errors_changes_and_missing_files(spark, tmp_path):
    root, folder = tmp_path / "lake", str(tmp_path / "catalog")
    lake(root, {"t/a.csv": "x,y\n1,2\n", "t/b.csv": "k,v\n3,4\n", "t/c.xlsx": "no workbook", "other/d.csv": "m,n\n5,6\n"})
    snapshot, one = indexing.index(spark, str(root), folder, model=enrich.head_summary)
    assert summed(one) == (4, 3, 0, 1, 0)
    (broken,) = one.errors.collect()
    assert broken.relative_path == "t/c.xlsx" and broken.error_message
    told = {r.relative_path: r for r in snapshot.files.collect()}
    assert told["t/c.xlsx"].status == "error" and told["t/a.csv"].file_summary

    # One changes, one turns bad, one goes; a prefix leaves the others alone.
    lake(root, {"t/a.csv": "x,y\n1,2\n7,8\n"})
    (root / "t/b.csv").rename(root / "t/b.xlsx")
    (root / "other/d.csv").unlink()
    snapshot, two = indexing.index(spark, str(root), folder, prefix="t")
    assert summed(two) == (3, 1, 0, 2, 1)
    now = {r.relative_path: (r.status, r.is_present) for r in snapshot.files.collect()}
    assert now == {"t/a.csv": ("indexed", True), "t/b.csv": ("missing", False), "t/b.xlsx": ("error", True), "t/c.xlsx": ("error", True), "other/d.csv": ("indexed", True)}
    # No model was asked: what was said of the changed file stays.
    assert {r.relative_path: r.file_summary for r in snapshot.files.collect()}["t/a.csv"] == told["t/a.csv"].file_summary
    rows = {r.table_name: r.row_count for r in snapshot.children.collect()}
    assert rows["a"] == 2 and rows["d"] == 1

    lake(root, {"t/a.csv": "a"})
    os.replace(root / "t/c.xlsx", root / "t/a.xlsx")
    _, three = indexing.index(spark, str(root), folder)
    assert three.missing == 2  # d.csv and c.xlsx


def test_a_failing_model_keeps_what_was_known(spark, tmp_path):
    root, folder = tmp_path / "lake", str(tmp_path / "catalog")
    lake(root, {"a.txt": "one text", "b.txt": "another"})
    indexing.index(spark, str(root), folder, "text", model=enrich.head_summary)

    def broken(texts):
        if any("bad" in t for t in texts):
            raise ValueError("no answer")
        return enrich.head_summary(texts)

    lake(root, {"a.txt": "bad text now"})
    snapshot, counts = indexing.index(spark, str(root), folder, "text", model=broken)
    assert summed(counts) == (2, 0, 1, 1, 0)
    row = snapshot.files.filter("relative_path = 'a.txt'").head()
    assert row.status == "error" and "no answer" in row.error_message and "one text" in row.file_summary
    assert snapshot.children.filter(F.col("source_id") == row.source_id).count() == 0
    assert snapshot.children.count() == 1


def test_a_run_that_breaks_leaves_the_snapshot(spark, tmp_path, monkeypatch):
    root, folder = tmp_path / "lake", str(tmp_path / "catalog")
    lake(root, {"a.txt": "first", "b.txt": "second"})
    indexing.index(spark, str(root), folder, "text")
    lake(root, {"a.txt": "first, longer"})
    shape = indexing.schemas.shaped

    def breaks(rows, schema):
        return shape(rows, schema).withColumn("status", F.raise_error(F.lit("power cut")).cast("string"))

    monkeypatch.setattr(indexing.schemas, "shaped", breaks)
    with pytest.raises(Exception, match="power cut"):
        indexing.index(spark, str(root), folder, "text")  # children are written, files are not
    monkeypatch.setattr(indexing.schemas, "shaped", shape)
    empty = indexing.lake.listing(spark, str(root), content=True).limit(0)
    kept = indexing.Snapshot(spark, folder, indexing.child_schema(indexing.parse_texts(empty)))
    assert {r.content for r in kept.children.collect()} == {"first", "second"}
    snapshot, counts = indexing.index(spark, str(root), folder, "text")
    assert summed(counts) == (2, 1, 1, 0, 0)
    assert {r.content for r in snapshot.children.collect()} == {"first, longer", "second"}


def test_only_changed_buckets_are_written(spark, tmp_path):
    root, folder = tmp_path / "lake", str(tmp_path / "catalog")
    lake(root, {f"f{i}.txt": f"text {i}" for i in range(40)})
    first, _ = indexing.index(spark, str(root), folder, "text")
    lake(root, {"f7.txt": "another text"})
    second, counts = indexing.index(spark, str(root), folder, "text")
    moved = {k for k in second.paths if second.paths[k] != first.paths.get(k)}
    assert len(moved) == 2 and len(second.paths) == len(first.paths) > 20
    assert counts.unchanged == 39 and second.files.count() == 40


def test_names_that_look_like_patterns(spark, tmp_path):
    root = tmp_path / "lake"
    lake(root, {"a[1].txt": "x", "b*.txt": "y", "c d.txt": "z", "e{f}.txt": "w"})
    snapshot, counts = indexing.index(spark, str(root), str(tmp_path / "catalog"), "text")
    assert counts.indexed == 4 and {r.content for r in snapshot.children.collect()} == {"w", "x", "y", "z"}
