"""The lake's own data source, as a table and as a stream."""

import os
import time

from fathom.sources import files, lake
from fathom.streaming import ingest


def put(root, name, text, ago=60.0):
    path = root / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    os.utime(path, (time.time() - ago,) * 2)


def test_listing_with_empty_files(spark, tmp_path):
    for name in ("b/x.TXT", "a.csv", "b/c/empty.md", "b/.hidden", "z/y.tar.gz"):
        put(tmp_path, name, "" if "empty" in name else name)
    rows = lake.listing(spark, str(tmp_path)).collect()
    assert [r.relative_path for r in rows] == ["a.csv", "b/.hidden", "b/c/empty.md", "b/x.TXT", "z/y.tar.gz"]
    assert {r.relative_path: r.size_bytes for r in rows}["b/c/empty.md"] == 0
    # The others are as Spark's source has them.
    other = {tuple(r) for r in files.listing(spark, str(tmp_path)).collect()}
    assert other <= {tuple(r) for r in rows} and {r[0] for r in other} >= {"a.csv", "b/x.TXT", "z/y.tar.gz"}
    assert [r.relative_path for r in lake.listing(spark, str(tmp_path), "b/c").collect()] == ["b/c/empty.md"]
    assert [r.relative_path for r in lake.listing(spark, str(tmp_path), "a.csv").collect()] == ["a.csv"]
    assert lake.listing(spark, str(tmp_path), "nowhere").collect() == []


def test_a_changed_file_is_met_again(spark, tmp_path):
    root, folder, checkpoint = tmp_path / "lake", str(tmp_path / "catalog"), str(tmp_path / "checkpoint")
    put(root, "f.txt", "short")
    put(root, "d/g.txt", "")

    def ingested():
        ingest.run(ingest.changes_stream(spark, str(root), lag=0.0), folder, checkpoint).awaitTermination(120)
        versions = sorted(int(p.split("=")[1]) for p in os.listdir(f"{folder}/batches") if p.startswith("batch="))
        return {r.relative_path: r for r in ingest.snapshot(spark, folder, versions[-1]).collect()}

    first = ingested()
    assert {p: r.size_bytes for p, r in first.items()} == {"f.txt": 5, "d/g.txt": 0}
    assert set(first) == {r.relative_path for r in lake.listing(spark, str(root)).collect()}
    time.sleep(0.2)
    put(root, "f.txt", "now longer", ago=0.0)
    put(root, "new.txt", "n", ago=0.0)
    second = ingested()
    assert {p: r.size_bytes for p, r in second.items()} == {"f.txt": 10, "d/g.txt": 0, "new.txt": 1}
    assert second["d/g.txt"].first_batch == first["d/g.txt"].first_batch == second["f.txt"].first_batch
