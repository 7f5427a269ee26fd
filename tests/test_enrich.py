from fathom.operators import enrich


def test_long_texts_have_keywords():
    text = "often " * 3000 + "rarely " * 2000 + "once"
    assert enrich.head_summary([text, "once more, once"])[0]["keywords"] == ["often", "rarely", "once"]
    assert enrich.head_summary(["once more, once"])[0]["keywords"] == ["once", "more"]
