import pytest

from fathom.operators import catalog
from fathom.sources import files


def test_prefix_guard():
    assert files.safe_prefix("./a\\b/") == "a/b"
    with pytest.raises(ValueError):
        files.safe_prefix("a/../../b")


def test_identification(spark, tmp_path):
    made = {
        "wrong.txt": b"%PDF-1.7",
        "class_grades.sql": b"CREATE TABLE g (a int);",
        "books/story.epub": b"PK\x03\x04....",
        "a.zip": b"PK\x03\x04....",
        "song.m4a": b"\0\0\0\x20ftypM4A ",
        "clip.bin": b"\0\0\0\x20ftypisom",
        "empty.csv": b"",
        "latin.txt": "caf\xe9 ole".encode("latin-1"),
        "what": b"\x01\x02",
        "look.css": b"p{}",
        "page.htm": b"<p>",
    }
    for name, data in made.items():
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_bytes(data)
    got = {r.relative_path: r for r in files.identify(files.listing(spark, str(tmp_path), content=True)).collect()}
    assert set(got) == {n for n, data in made.items() if data}
    assert (got["wrong.txt"].detected_format, got["wrong.txt"].modality, len(got["wrong.txt"].warnings)) == ("pdf", "document", 1)
    assert (got["class_grades.sql"].detected_format, got["class_grades.sql"].encoding) == ("sql", "utf-8")
    assert got["books/story.epub"].detected_mime_type == "application/epub+zip"
    assert got["a.zip"].modality == "archive"
    assert got["song.m4a"].modality == "audio" and got["clip.bin"].modality == "video"
    assert got["latin.txt"].encoding == "windows-1252"
    assert (got["what"].modality, got["what"].identification_confidence, len(got["what"].warnings)) == ("unknown", 0.1, 1)
    assert (got["look.css"].identification_confidence, got["look.css"].detected_format) == (0.35, "css")
    assert got["page.htm"].canonical_extension == ".html"
    by_head = files.identify(files.heads(files.listing(spark, str(tmp_path)), str(tmp_path), 64)).collect()
    assert {r.relative_path: r.detected_format for r in by_head} == {n: r.detected_format for n, r in got.items()}


def test_runs_do_not_lose_unchanged_files(spark):
    kind = "relative_path string, size_bytes long, last_modified timestamp, status string, is_present boolean"
    scan = spark.sql("select * from values ('a', 1L, timestamp '2026-01-01', 'indexed', true), ('b', 2L, timestamp '2026-01-01', 'indexed', true) t(relative_path, size_bytes, last_modified, status, is_present)")
    state = spark.createDataFrame([], kind)
    counts = []
    for _ in range(3):
        counts.append(tuple(catalog.counters(catalog.with_outcome(scan, state, "relative_path")).head()))
        state = catalog.mark_missing(catalog.upsert(state, scan, "relative_path"), scan, "relative_path")
        state = spark.createDataFrame(state.collect(), kind)
    assert counts == [(2, 2, 0, 0), (2, 0, 0, 2), (2, 0, 0, 2)]
    gone = catalog.mark_missing(state, scan.filter("relative_path = 'a'"), "relative_path")
    assert {r.relative_path: r.status for r in gone.collect()} == {"a": "indexed", "b": "missing"}


def test_paths_below_a_root_that_recurs(spark, tmp_path):
    root = tmp_path / "lake"
    for name in ("f.csv", f"old{root}/f.csv", "lake/lake/g h.csv"):
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("a,b")
    got = sorted(r.relative_path for r in files.listing(spark, str(root)).collect())
    assert got == sorted(["f.csv", f"old{root}/f.csv", "lake/lake/g h.csv"])
    assert [r.relative_path for r in files.listing(spark, f"file://{root}", "lake/lake/g h.csv").collect()] == ["lake/lake/g h.csv"]


def test_text_of_files(spark, tmp_path):
    made = {"a.txt": b"\xef\xbb\xbfplain", "b.txt": b"bad \xff byte", "c.txt": "caf\xe9 \u20ac".encode("windows-1252"), "d.txt": "w\xeft".encode("utf-16")}
    for name, data in made.items():
        (tmp_path / name).write_bytes(data)
    listed = files.listing(spark, str(tmp_path), content=True)
    plain = {r.relative_path: r.text for r in files.text_of(listed).collect()}
    assert plain["a.txt"] == "plain" and plain["b.txt"] == "bad \ufffd byte"
    told = files.identify(listed).select("relative_path", "encoding")
    known = {r.relative_path: r.text for r in files.text_of(listed.join(told, "relative_path")).collect()}
    assert known["c.txt"] == "caf\xe9 \u20ac" and known["d.txt"] == "w\xeft" and known["a.txt"] == "plain"


def test_errors_of_known_and_new_files(spark):
    kind = "relative_path string, status string, error_message string, file_summary string, is_present boolean"
    state = spark.createDataFrame([("a", "indexed", None, "s", True), ("b", "indexed", None, "t", True)], kind)
    errors = spark.createDataFrame([("a", "cut off"), ("c", "no key")], "relative_path string, error_message string")
    got = {r.relative_path: tuple(r)[1:] for r in catalog.save_errors(state, errors, "relative_path").collect()}
    assert got == {
        "a": ("error", "cut off", "s", True), "b": ("indexed", None, "t", True), "c": ("error", "no key", None, True)
    }
    children = spark.createDataFrame([("a", 1), ("b", 1)], "relative_path string, n int")
    assert [r.relative_path for r in catalog.without_children_of(children, errors, "relative_path").collect()] == ["b"]
