"""Search documents, hits, summaries and fallbacks over small indexes."""

import pytest
from pyspark.sql import functions as F

from fathom.functions import search_texts
from fathom.operators import retrieval as R


@pytest.fixture(scope="module")
def indexes(spark):
    texts = spark.createDataFrame(
        [("s1", "logs/a.md", "a.md", "about wind", ["wind"]), ("s2", "logs/b.md", "b.md", None, None)],
        "source_id string, relative_path string, filename string, file_summary string, file_keywords array<string>",
    )
    parts = spark.createDataFrame(
        [("s1:1", "s1", "Noon", "Gale WARNING", "Noon\nGale WARNING", 3, 5), ("s2:1", "s2", None, "calm", None, None, None)],
        "child_id string, source_id string, heading string, content string, search_text string, line_start int, line_end int",
    )
    books = spark.createDataFrame(
        [("e1", "b/x.epub", "x.epub", None, "Tides", ["N. Ebb"], "en", 2, 0)],
        "source_id string, relative_path string, filename string, file_summary string, title string, creators array<string>, language string, chapter_count int, image_count int",
    )
    chapters = spark.createDataFrame(
        [("e1:1", "e1", "chapter_text", 1, "Neaps", "low water"), ("e1:2", "e1", "image_summary", None, None, "a chart")],
        "child_id string, source_id string, section_type string, chapter_index int, chapter_title string, content string",
    ).withColumn("search_text", F.col("content"))
    bases = spark.createDataFrame([("d1", "x.db", "x.db", "crew list")], "source_id string, relative_path string, filename string, file_summary string")
    tables = spark.createDataFrame([("d1:t", "d1", "crew", "who sails", "crew rank", 4)], "child_id string, source_id string, table_name string, summary string, search_text string, row_count int")
    columns = tables.withColumn("columns", F.array(F.lit("rank")))

    def vectors(rows):
        return spark.createDataFrame(rows, "doc_id string, source_id string, child_id string, record_type string, embedding array<double>")

    return {
        "text": R.Index(vectors([("s1:file", "s1", None, "file", [1.0, 0.0]), ("s1:1", "s1", "s1:1", "section", [0.9, 0.1]), ("s2:1", "s2", "s2:1", "section", [0.0, 1.0])]), texts, parts),
        "epub": R.Index(vectors([("e1:file", "e1", None, "file", [0.8, 0.2]), ("e1:1", "e1", "e1:1", "section", [0.1, 0.9])]), books, chapters),
        "database": R.Index(vectors([("d1:t", "d1", "d1:t", "table", [0.5, 0.5])]), bases, columns),
    }


def test_pages_of_hits(indexes):
    r = R.Retriever(indexes, lambda q: [1.0, 0.0], "/lake/")
    first = r.query_text("wind?", limit=2).collect()
    assert [(h.record_type, h.file_path, h.content) for h in first] == [("file", "logs/a.md", "about wind"), ("section", "logs/a.md", "Noon\nGale WARNING")]
    assert first[0].position is None and (first[1].position.unit, first[1].position.start, first[1].position.end) == ("line", 3, 5)
    assert (first[1].execution_file_path, first[1].absolute_file_path) == ("./logs/a.md", "/lake/logs/a.md")
    (last,) = r.query("text", "wind?", limit=2, offset=2).collect()
    assert (last.content, last.position) == ("calm", None)
    book = r.query_epub("wind?", top_k=1).collect()[0]
    assert (book.content, book.title, book.chapter_count, book.vl_model_name) == ("Tides", "Tides", 2, None)
    (table,) = r.query_database("crew").collect()
    assert (table.record_type, table.content, table.table_name, table.row_count) == ("table", "who sails", "crew", 4)
    with pytest.raises(KeyError):
        r.query_audio("x")


def test_all_modalities(indexes):
    r = R.Retriever(indexes, lambda q: [1.0, 0.0])
    every = r.query_all("?", limit=10).collect()
    assert [h.score for h in every] == sorted(h.score for h in every) and len(every) == 6
    pages = [h.content for k in (0, 2, 4) for h in r.query_all("?", limit=2, offset=k).collect()]
    assert pages == [h.content for h in every]
    assert {s["modality"] for s in r.skipped()} == set(R.MODALITIES) - {"text", "epub", "database"}
    assert set(R.TOOLS) == {f"search_{m}_data" for m in R.MODALITIES} | {"search_all_indexed_data", "get_indexed_file_summary"}
    assert all(hasattr(r, name) for name in R.TOOLS.values())


def test_file_summaries(indexes):
    r = R.Retriever(indexes, lambda q: [1.0, 0.0], "/lake")
    (text,) = r.file_summary("/lake/logs/a.md").collect()
    assert (text.modality, text.summary, text.keywords, text.warnings) == ("text", "about wind", ["wind"], [])
    assert r.file_summary("x.db").head().table_count == 1
    assert r.file_summary("b\\x.epub").head().creators == ["N. Ebb"]
    with pytest.raises(ValueError, match="no indexed file"):
        r.file_summary("nowhere")


def test_search_documents(spark, indexes):
    files = indexes["text"].files.withColumn("file_search_text", F.concat_ws("\n", "filename", "file_summary"))
    docs = R.search_docs(files, indexes["text"].children.union(indexes["text"].children), "text")
    got = {r.doc_id: (r.record_type, r.text) for r in docs.collect()}
    assert got == {"s1:file": ("file", "a.md\nabout wind"), "s2:file": ("file", "b.md"), "s1:1": ("section", "Noon\nGale WARNING")}
    newer = docs.filter("doc_id = 's1:1'").withColumn("text", F.lit("new"))
    assert {r.doc_id: r.text for r in R.upsert_docs(docs, newer).collect()} == {k: "new" if k == "s1:1" else v[1] for k, v in got.items()}


def test_lexical_search_by_modality(indexes):
    find = lambda m, q: [tuple(r) for r in R.database_search(indexes, m, q).collect()]
    assert find("text", "gale warn") == [("a.md", "Gale WARNING")]
    assert find("epub", "water") == [("x.epub", "[Chapter 1: Neaps / chapter_text]\nlow water")]
    assert find("epub", "chart") == [("x.epub", "[image_summary]\na chart")]
    assert find("database", "RANK") == [("x.db", "Table: crew\nSummary: who sails\nColumns: [rank]")]
    assert find("document", "gale") == [] and find("audio", "gale") == []


def test_timed_lexical_search(spark):
    files = spark.createDataFrame([("v", "v.mp4", "v.mp4")], "source_id string, relative_path string, filename string")
    rows = [("v:1", "v", "transcript_chunk", "ahoy there", None, 1.25, 2.0), ("v:2", "v", "frame_caption", "ahoy flag", 3.04, None, None)]
    children = spark.createDataFrame(rows, "child_id string, source_id string, section_type string, content string, timestamp_seconds double, start_seconds double, end_seconds double").withColumn("search_text", F.col("content"))
    index = {"video": R.Index(files, files, children), "audio": R.Index(files, files, children.drop("timestamp_seconds"))}
    assert [r.content for r in R.database_search(index, "video", "ahoy").collect()] == ["[1.3s-2.0s transcript_chunk]\nahoy there", "[3.0s frame_caption]\nahoy flag"]
    assert [r.content for r in R.database_search(index, "audio", "ahoy").collect()] == ["[1.3s-2.0s]\nahoy there", "ahoy flag"]


def test_files_instead_of_an_index(spark, indexes):
    names = [f"d/{i:02}.png" for i in range(20)] + ["tides.csv", "Wind Report.csv", "n1.md", "n2.md", "n3.txt", "n4.sql"]
    files = spark.createDataFrame([(n, n.split("/")[-1], "." + n.split(".")[-1]) for n in names], "relative_path string, filename string, extension string")
    find = lambda q, m: [(r.relative_path, r.reason) for r in R.filesystem_search(files, q, m).collect()]
    assert find("How many tides?", "tabular") == [("tides.csv", "named")]
    assert find("nothing there", "tabular") == [("Wind Report.csv", "modality"), ("tides.csv", "modality")]
    assert len(find("?", "image")) == 15
    assert find("?", "audio") == [("n1.md", "text"), ("n2.md", "text"), ("n3.txt", "text")]
    read = lambda f: f.select("filename", F.col("reason").alias("content"))
    assert [r.content for r in R.retrieve(indexes, files, "text", "gale", read).collect()] == ["Gale WARNING"]
    assert [r.filename for r in R.retrieve(indexes, files, "tabular", "tides", read).collect()] == ["tides.csv"]


def test_search_texts_of_files(spark):
    rows = spark.createDataFrame(
        [
            ("a.pdf", "x/a.pdf", None, None, [("H", "c1", 1, 1), (None, "c2", 2, 4), ("", "c3", None, None), ("late", "c4", 9, 9)]),
            ("b.pdf", "b.pdf", "sum", ["k1", "k2"], [("H", "c1", 1, 2)]),
        ],
        "filename string, relative_path string, file_summary string, file_keywords array<string>, sections array<struct<heading:string,content:string,start:int,end:int>>",
    )
    text = lambda m: [r[0] for r in rows.select(search_texts.file_search_text(rows, m)).collect()]
    assert text("document") == ["a.pdf\nx/a.pdf\nH\npage 1\npages 2-4", "b.pdf\nb.pdf\nsum\nk1, k2\nH"]
    assert text("slideshow")[0] == "a.pdf\nx/a.pdf\nH\nslide 1\nslides 2-4"
    assert text("text")[0] == "a.pdf\nx/a.pdf\nH"
    assert text("sql_script")[1] == "b.pdf\nb.pdf\nsum\nk1, k2\nc1"
    picture = spark.createDataFrame([("p.png", "p.png", "png", 40, 30, "RGBA", True, False)], "filename string, relative_path string, file_format string, width int, height int, color_mode string, has_alpha boolean, is_animated boolean")
    assert picture.select(search_texts.file_search_text(picture, "image")).head()[0] == "p.png\np.png\npng\n40x30\nRGBA\ntransparent"
    sound = spark.createDataFrame([("s.mp3", "s.mp3", 61.25, "y" * 2000)], "filename string, relative_path string, duration_seconds double, transcript_text string")
    assert sound.select(search_texts.file_search_text(sound, "audio")).head()[0] == "s.mp3\ns.mp3\nAudio transcript\nDuration: 61.3 seconds\n" + "y" * 1600
    book = spark.createDataFrame([("e.epub", "e.epub", "T", ["A", "B"], "en", 3)], "filename string, relative_path string, title string, creators array<string>, language string, chapter_count int")
    assert book.select(search_texts.file_search_text(book, "epub")).head()[0] == "T\ne.epub\ne.epub\nA, B\nen\n3 chapters"
    sheet = spark.createDataFrame([("w.xlsx", "w.xlsx", {"S": "levels"})], "filename string, relative_path string, sheet_descriptions map<string,string>")
    assert sheet.select(search_texts.file_search_text(sheet, "tabular")).head()[0] == "w.xlsx\nw.xlsx\nS | levels"
    with pytest.raises(ValueError):
        search_texts.file_search_text(book, "other")


def test_texts_of_tables(spark):
    t = spark.createDataFrame([(["TITLE", ""], ["a", "b"], [["1", "2"], ["3", "4"]], "S")], "c array<string>, header array<string>, preview array<array<string>>, sheet_name string")
    t = t.withColumn("context", F.array("c"))
    assert t.select(search_texts.table_search_text(t)).head()[0] == "S\nTITLE\na | b"
    shown = search_texts.table_text(F.col("header"), F.lit(9), F.col("preview"))
    assert t.select(shown).head()[0] == "Columns: a, b\nShape: (9, 2)\nData Preview:\n1 | 2\n3 | 4"


def test_summary_is_of_the_first_path(spark, indexes):
    """The path as given comes before others, whatever their modality."""
    def files(path):
        return spark.createDataFrame([("s" + path, path, "a.csv", path)], "source_id string, relative_path string, filename string, file_summary string")

    none = indexes["text"].vectors.limit(0)
    both = {"tabular": R.Index(none, files("a.csv"), none), "text": R.Index(none, files("/a.csv"), none)}
    r = R.Retriever(both, lambda q: [1.0, 0.0])
    assert [r.file_summary(p).head().modality for p in ("/a.csv", "a.csv", "//a.csv")] == ["text", "tabular", "tabular"]


def test_pages_tell_what_follows(indexes):
    r = R.Retriever(indexes, lambda q: [1.0, 0.0])
    pages = [r.page(None, "?", limit=4, offset=k) for k in (0, 4)]
    assert [(len(p.results), p.next_offset, p.has_more) for p in pages] == [(4, 4, True), (2, 6, False)]
    one = r.page("text", "?", limit=2)
    assert [h.content for h in one.results] == [h.content for h in r.query_text("?", limit=2).collect()]
    assert (one.next_offset, one.has_more) == (2, True)


@pytest.mark.parametrize(
    ("text", "found"),
    [("temp\\x", ["tempx"]), ("100\\%", ["100% sure"]), ("a\\\\b", ["a\\b"]), ("e_p", ["tempx"]), ("sure\\", ["sure%"]), ("", None)],
)
def test_backslashes(spark, text, found):
    """As in LIKE elsewhere, a backslash only takes away a sign's meaning."""
    rows = ["tempx", "100% sure", "1000 sure", "a\\b", "sure%", None]
    got = R.search.lexical(spark.createDataFrame([(r,) for r in rows], "t string"), "t", text, ["t"], 9)
    assert [r.t for r in got.collect()] == (found if found is not None else sorted(r for r in rows if r))


def test_files_that_are_gone_have_no_hits(indexes):
    i = indexes["text"]
    gone = i.files.withColumn("is_present", F.col("source_id") != "s1")
    r = R.Retriever({"text": R.Index(i.vectors, gone, i.children)}, lambda q: [1.0, 0.0])
    assert [h.content for h in r.query_text("?").collect()] == ["calm"]


def test_many_questions_at_once(spark, indexes):
    """Each question gets what it gets alone."""
    embed = {"wind": [1.0, 0.0], "calm": [0.0, 1.0], "both": [0.5, 0.6]}
    r = R.Retriever(indexes, embed.get, "/lake")
    asked = spark.createDataFrame([(i, q) for i, q in enumerate(embed)], "question_id int, question string")
    got = r.query_many(asked, limit=4).orderBy("question_id", "place").collect()
    for i, q in enumerate(embed):
        alone = r.query_all(q, limit=4).collect()
        mine = [h for h in got if h.question_id == i]
        assert [(h.modality, h.file_path, h.content) for h in mine] == [(h.modality, h.file_path, h.content) for h in alone]
        assert [h.score for h in mine] == pytest.approx([h.score for h in alone])
