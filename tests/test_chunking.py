from fathom.operators import chunking as C


def test_markdown_sections():
    text = "# Harbour\nShips lie here.\n\n## Lights\nTwo of them blink.\n"
    found = C.markdown(C.normalized(text))
    assert [(s["heading"], s["content"]) for s in found] == [("Harbour", "Ships lie here."), ("Lights", "Two of them blink.")]
    assert [s["line_start"] for s in found] == [2, 5]


def test_headings_without_body_drop():
    assert C.markdown("# A\n## B\nbody") == [{"heading": "B", "content": "body", "line_start": 3, "line_end": 3}]
    assert C.markdown("") == []


def test_short_tail_joins_and_long_sentences_stay():
    body = "\n\n".join(["a" * 90, "b" * 90, "c" * 5])
    assert C.paragraphs(body, 185, 20) == ["a" * 90 + "\n\n" + "b" * 90, "c" * 5]
    assert C.paragraphs(body, 200, 20) == [body]
    assert C.divided("x" * 25, 10) == ["x" * 10, "x" * 10, "x" * 5]
    assert C.divided("One. " + "y" * 30 + ". Two.", 10) == ["One.", "y" * 30 + ".", "Two."]


def test_plain_text_pieces_stay_in_size():
    story = "\n\n".join(f"Paragraph {i}: " + "some words here. " * 8 for i in range(32))
    found = C.plain(C.normalized(story))
    assert len(found) >= 2
    assert all(len(s["content"]) <= 1000 for s in found)
    assert "Paragraph 0" in found[0]["content"] and "Paragraph 31" in found[-1]["content"]
    again = C.plain_pieces("word " * 60, 100, 20)
    assert all(b.startswith(a[-20:].strip()) for a, b in zip(again, again[1:]) if len(b) > 90)


def test_web_page():
    html = (
        "<html><head><title>Ferry</title><script>x()</script><meta name='description' content=' Runs  daily '></head><body>"
        "<h1>Crossings</h1><p>Go <em>early</em> &lt; noon</p><h2>Fares</h2>"
        "<table><tr><th>Zone</th><th>Fare</th></tr><tr><td>B</td><td>40</td></tr></table></body></html>"
    )
    found = C.web(html)
    assert [s["heading"] for s in found] == ["Ferry", "Crossings", "Fares"]
    assert found[0]["content"] == "Runs daily" and found[1]["content"] == "Go early < noon"
    assert "| B | 40 |" in found[2]["content"]


def test_sql_statements():
    script = "CREATE TABLE ropes (a TEXT DEFAULT ';'); -- one; two\nINSERT INTO ropes VALUES ('it''s');\n/* ; */ SELECT 1"
    assert C.statements(script) == [
        "CREATE TABLE ropes (a TEXT DEFAULT ';');",
        "-- one; two\nINSERT INTO ropes VALUES ('it''s');",
        "/* ; */ SELECT 1",
    ]
    packed = C.sql_script("CREATE TABLE knots (no INT, kind TEXT);\n-- add\nINSERT INTO knots VALUES (1, 'bowline');\nINSERT INTO knots VALUES (2, 'hitch');", 60)
    assert len(packed) == 3


def test_cut_as_a_job(spark):
    rows = spark.createDataFrame([(1, "# H\n\nbody"), (2, None), (3, "")], "id long, text string")
    found = C.cut(rows, "text", "markdown").collect()
    assert [(r.id, r.chunk_index, r.search_text) for r in found] == [(1, 1, "H\nbody")]
