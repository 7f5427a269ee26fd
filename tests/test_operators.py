import pytest

from fathom.functions import scalars as S
from fathom.operators import chunking, enrich, exchange, search, sections
from fathom.plans import registry
from fathom.streaming import ingest

SF = "/root/testdata/sf0.001"


def test_even_sample(spark):
    rows = spark.range(1, 10).selectExpr("id as chunk_index", "1 as f")
    got = lambda k: sorted(r.chunk_index for r in sections.even_sample(rows, ["f"], ["chunk_index"], k).collect())
    assert got(4) == [1, 3, 6, 9]
    assert got(1) == [1]
    assert got(20) == list(range(1, 10))


def test_pages_join_to_the_whole_order(spark):
    hits = spark.range(23).selectExpr("id", "cast(id % 7 as double) as score")
    seen, offset = [], 0
    while offset is not None:
        p = search.page(hits, ["score", "id"], 5, offset)
        seen += [r.id for r in p.results]
        assert p.has_more == (p.next_offset is not None)
        offset = p.next_offset
    assert seen == [r.id for r in hits.orderBy("score", "id").collect()]


def test_scalars(spark):
    row = spark.sql("select '.hidden/x.CSV' a, './d/.bashrc' b, 3725.4D s, '30000/1001' r, 'x' z").select(
        S.extension("a").alias("a"), S.extension("b").alias("b"), S.relative_path("a").alias("pa"), S.relative_path("b").alias("pb"),
        S.clock("s").alias("s"), S.rate("r").alias("r"), S.rate("z").alias("z"),
    ).head()
    assert (row.a, row.b, row.pa, row.pb, row.s, row.z) == (".csv", "", ".hidden/x.CSV", "d/.bashrc", "01:02:05", None)
    assert row.r == pytest.approx(29.97, abs=0.01)


def test_types_as_python_has_them(spark):
    cells = {"1_000": "integer", "+5": "integer", "1e5": "float", "nan": "float", "1d": None, "2026": "integer", "2026-7-1": None, "2026-07-01": "date", "2026-07-01T10:00": "datetime", "0": "boolean", "x": None}
    rows = spark.createDataFrame([(c,) for c in cells], "v string")
    from pyspark.sql import functions as F

    tests = F
    for name, test in S.TYPES:
        tests = tests.when(test("v"), F.lit(name))
    assert {r.v: r.t for r in rows.select("v", tests.alias("t")).collect()} == cells


def test_sections_queries_equal_the_cutters(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {}
    for r in registry.queries()["text_chunks"](spark, SF).collect():
        got.setdefault(r.doc_id, {})[r.chunk_index] = r.content
    for i, t in texts.items():
        assert [got.get(i, {})[k] for k in sorted(got.get(i, {}))] == [s["content"] for s in chunking.plain(chunking.normalized(t))]
    turns = spark.read.parquet(f"{SF}/conversations.parquet").count()
    scripts = registry.queries()["sql_statements"](spark, SF).collect()
    assert sum(r.content.count("INSERT INTO turns") for r in scripts) == turns
    assert registry.queries()["web_sections"](spark, SF).count() > 0


def test_models_and_errors(spark):
    rows = spark.createDataFrame([(1, "good text"), (2, "bad"), (3, None)], "id long, text string")

    def model(texts):
        if "bad" in texts:
            raise RuntimeError("no")
        return [{"summary": t.upper(), "keywords": list("abcdefghijk")} for t in texts]

    got = {r.id: r.enriched for r in enrich.enrich(rows, "text", model).collect()}
    assert got[1].summary == "GOOD TEXT" and len(got[1].keywords) == enrich.KEYWORDS
    assert got[2].error == "RuntimeError: no" and got[3].summary == ""
    vectors = {r.id: r.embedding for r in enrich.embed(rows, "text").collect()}
    assert len(vectors[1]) == enrich.DIMENSIONS and vectors[3] is None


def test_exchange(spark, tmp_path):
    good = spark.sql("select 'a.pdf' relative_path, 'pdf' file_format, 3L size_bytes, array(named_struct('section_id', 's1', 'chunk_index', 1, 'heading', 'H', 'content', 'c', 'page_start', 1, 'page_end', 2)) sections")
    bad = spark.sql("select 'b.pdf' relative_path, 'broken' error_message")
    exchange.export_lines(good, bad, str(tmp_path / "x"))
    (row,) = exchange.import_lines(spark, str(tmp_path / "x")).collect()
    assert (row.relative_path, row.sections[0].page_end) == ("a.pdf", 2)
    (tmp_path / "y.jsonl").write_text('{"type": "other"}\n')
    with pytest.raises(Exception, match="unknown record type"):
        exchange.import_lines(spark, str(tmp_path / "y.jsonl")).collect()


def test_stream_appends_files_to_the_catalog(spark, tmp_path):
    lake, folder = tmp_path / "lake", str(tmp_path / "catalog")
    lake.mkdir()
    for n in range(3):
        (lake / f"f{n}.csv").write_text("a,b\n1,2\n")
        ingest.run(ingest.files_stream(spark, str(lake)), folder, str(tmp_path / "state")).awaitTermination()
        got = ingest.snapshot(spark, folder, n).collect()
        assert {r.filename: (r.first_batch, r.status) for r in got} == {f"f{i}.csv": (i, "discovered") for i in range(n + 1)}
    assert ingest.snapshot(spark, folder, 1).count() == 2
    ingest.compact(spark, folder, 2, str(tmp_path / "folded"))
    rows = lambda d: sorted(map(tuple, d.select("relative_path", "status", "first_batch").collect()))
    assert rows(ingest.snapshot(spark, str(tmp_path / "folded"), 2)) == rows(ingest.snapshot(spark, folder, 2))


def test_numbers_from_text(spark):
    cells = {"7": (7.0, 7), " 8 ": (8.0, 8), "1.9": (1.9, 1), "-2.5": (-2.5, -2), "x": (None, None), "": (None, None), "nan": (float("nan"), None)}
    rows = spark.createDataFrame([(c,) for c in cells], "v string").select("v", S.safe_float("v").alias("f"), S.safe_int("v").alias("i")).collect()
    assert {r.v: (repr(r.f), r.i) for r in rows} == {c: (repr(f), i) for c, (f, i) in cells.items()}


def test_long_vectors_are_folded(spark):
    import random

    rng = random.Random(1)
    q = [rng.uniform(-1, 1) for _ in range(300)]
    rows = [(i, [rng.uniform(-1, 1) for _ in range(300)]) for i in range(5)] + [(9, [0.0] * 300)]
    d = spark.createDataFrame(rows, "id long, v array<double>")
    got = {r.id: r.s for r in d.select("id", S.cosine_distance("v", q).alias("s")).collect()}
    for i, v in rows[:5]:
        dot, norm = sum(a * b for a, b in zip(v, q)), (sum(a * a for a in v) * sum(b * b for b in q)) ** 0.5
        assert got[i] == pytest.approx(1 - dot / norm)
    assert got[9] is None


def test_transcribing_falls_back(spark):
    def first(data):
        if data == b"hard":
            raise RuntimeError("noise")
        return {"text": data.decode(), "seconds": 1.5, "cost_usd": 0.01}

    def second(data):
        return {"text": "guess"}

    rows = spark.createDataFrame([(1, b"easy"), (2, b"hard"), (3, None)], "id long, content binary")
    got = {r.id: r.transcript for r in enrich.transcribe(rows, "content", {"a": first, "b": second}).collect()}
    assert (got[1].text, got[1].model, got[1].cost_usd, got[1].warnings) == ("easy", "a", 0.01, [])
    assert (got[2].text, got[2].model, got[2].warnings) == ("guess", "b", ["a: RuntimeError: noise"])
    assert got[3].text == ""
    failed = {r.id: r.transcript for r in enrich.transcribe(rows, "content", {"a": first}).collect()}
    assert failed[2].text is None and failed[2].error == "a: RuntimeError: noise"


def test_questions_and_answers(spark, tmp_path):
    from tests.test_tabular import book

    (tmp_path / "q.xlsx").write_bytes(book({"Q": [["STT", "Topic", "Question"], [1, "x", "How deep?"], [2, "y", ""], [3, "z", "How far?"]]}))
    (tmp_path / "q.csv").write_text('STT,Question\n1,"How\ndeep?"\n,none\n3,How far?\n')
    rows = lambda d: sorted((r.id, r.question) for r in d.collect())
    assert rows(exchange.read_questions(spark, str(tmp_path / "q.xlsx"))) == [("1", "How deep?"), ("3", "How far?")]
    assert rows(exchange.read_questions(spark, str(tmp_path / "q.csv"))) == [("1", "How\ndeep?"), ("3", "How far?")]
    answers = spark.createDataFrame([("3", 'He said "9 m"\nor so', "a.txt"), ("1", None, None)], exchange.ANSWERS)
    exchange.write_answers(answers, str(tmp_path / "out"))
    back = {r.id: r.answer or "" for r in exchange.read_answers(spark, str(tmp_path / "out")).collect()}
    assert back == {"1": "", "3": 'He said "9 m"\nor so'}


def test_schemas(spark):
    from fathom.operators.retrieval import MODALITIES
    from fathom.sources import schemas

    for m in MODALITIES:
        made = schemas.shaped(spark.range(2).selectExpr("cast(id as string) as source_id", "'x' as other"), schemas.of_children(m))
        assert made.columns == schemas.of_children(m).names and made.count() == 2
        assert "relative_path" in schemas.of_files(m).names
    found, skipped = schemas.there(spark, {"text": "no_such_table"})
    assert found == {} and skipped == [{"modality": "text", "reason": "table missing"}]


def test_cells_that_do_not_fit_are_kept(spark):
    from fathom.operators import profile

    rows = spark.createDataFrame([(["1", "x"],), (["two", " y "],), (["", None],), (["3"],), (["1_000", "z", "more"],)], "c array<string>")
    got = profile.typed(rows, "c", [("n", "integer"), ("t", "string")], "rescued").collect()
    assert [tuple(r) for r in got] == [(1, "x", None), (None, "y", {"n": "two"}), (None, None, None), (3, None, None), (1000, "z", None)]
