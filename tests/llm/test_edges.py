"""Nulls, empty and long texts, repeated rows, empty tables, clashing columns."""

import hashlib

import public_tokenizers
import pytest

from fathom.llm import bpe, edit_counts, importance, kneser_ney, licenses, mixing, quality_rules, simhash, syncmers, toxicity
from fathom.llm.queries import VOCABULARY

PATH, PATTERN = public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN
KIND = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "word and more " * 20_000
ROWS = [
    (1, "a b c d e f g h i j k", "en", "s1", 21),
    (1, "a b c d e f g h i j k", "en", "s1", 21),
    (2, None, "en", None, None),
    (3, "", None, "s1", 0),
    (4, " \t\n", "en", "s2", 3),
    (None, "no id here", "en", "s2", 10),
    (None, None, None, None, None),
    (7, LONG, "en", "s2", len(LONG)),
    (8, "日本語のテキスト \U0001f600 été", "ja", "s3", 14),
]
LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, KIND).repartition(3)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (7, 1, 0), (8, 0, 1), (None, 1, 1), (3, None, None)], LABELS)


def clashing(df):
    """Extra columns with the names that the operators give their own."""
    names = ("size", "target", "copies", "taken", "rules", "ids", "bytes", "fingerprint", "lm", "toxicity", "licenses", "counts", "weight")
    for n in names:
        df = df.selectExpr("*", f"'x' as {n}")
    return df


def operators(labels):
    def scored(d):
        return kneser_ney.score(d, kneser_ney.train(d))

    def edited(d):
        return edit_counts.count_edits(d.selectExpr("*", "array(struct(0, 1, 'x'), struct(5, 2, null)) as edits"), PATH, PATTERN)

    return {
        "edit_counts": edited,
        "mix": mixing.mix,
        "emit": mixing.emit,
        "syncmers": syncmers.compare,
        "rules": quality_rules.judge,
        "rules_keep": quality_rules.keep,
        "importance": lambda d: importance.classify(d, labels)[0],
        "importance_keep": lambda d: importance.keep(d, labels),
        "bpe": lambda d: bpe.decode(bpe.encode(d, PATH, PATTERN), PATH),
        "kneser_ney": scored,
        "toxicity": lambda d: toxicity.predict(d, toxicity.train(d, labels)),
        "simhash": simhash.groups,
        "simhash_keep": simhash.keep_one,
        "licenses": licenses.scan,
    }


NAMES = sorted(operators(None))
KEEPING = {"emit", "rules_keep", "importance_keep", "simhash_keep"}


@pytest.mark.parametrize("name", NAMES)
def test_hard_rows(docs, labels, name):
    found = operators(labels)[name](docs)
    rows = found.collect()
    if name not in KEEPING:
        assert len(rows) == len(ROWS)
    else:
        assert found.columns == docs.columns


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(spark, labels, name):
    assert operators(labels)[name](spark.createDataFrame([], KIND)).collect() == []


@pytest.mark.parametrize("name", NAMES)
def test_clashing_columns(docs, labels, name):
    found = operators(labels)[name](clashing(docs.filter("doc_id in (1, 8)")))
    assert len(set(found.columns)) == len(found.columns)
    assert found.count() >= (0 if name in KEEPING else 3)


def test_bpe_round_trip(docs):
    got = bpe.decode(bpe.encode(docs, PATH, PATTERN), PATH).collect()
    assert all(bytes(r.bytes).decode() == (r.text or "") for r in got)


def test_edits(spark):
    rows = [(1, "Hello  world\n again", [(0, 5, "Bye"), (50, 9, "!")]), (2, None, [(3, 3, "new")]), (3, "same", None)]
    d = spark.createDataFrame(rows, f"doc_id long, text string, edits {edit_counts.EDITS}")
    got = {r.doc_id: r.counts for r in edit_counts.count_edits(d, PATH, PATTERN).collect()}
    assert [got[i].edited_text for i in (1, 2, 3)] == ["Bye  world\n again!", "new", "same"]
    assert got[3].encoded_pretokens == 0 and got[3].edited_tokens == got[3].n_tokens


def test_unnamed_groups_keep_one(spark):
    rows = [(None, "x y z", "en", "s", 5), (None, "x y z", "en", "s", 5), (5, "other words", "en", "s", 11), (6, "other words", "en", "s", 11)]
    got = simhash.keep_one(spark.createDataFrame(rows, KIND)).collect()
    assert sorted((r.doc_id or 0, r.text) for r in got) == [(0, "x y z"), (5, "other words")]


def test_next_of_one_row_is_itself(spark):
    (r,) = syncmers.compare(spark.createDataFrame([(5, "abcd")], "doc_id long, text string")).collect()
    assert r.edited_sha256 == hashlib.sha256(b"abab").hexdigest()
    assert r.near_next == 1.0


def test_a_word_is_looked_up_once(monkeypatch):
    """Words of a line and of lines before it have the ids they were found to have."""
    from fathom.llm import kneser_ney

    asked: list[bytes] = []
    words = kneser_ney.Words(None, 4, {}, {})
    monkeypatch.setattr(words, "look_up", lambda new: asked.extend(new) or kneser_ney.np.array([7 if w == b"\n" else len(w) if w != b"gone" else -1 for w in new]))
    for _ in range(2):
        line, starts = words.sequence([[b"aa", b"gone", b"aa"], [], [b"bbb"]], 99, 2)
        assert line.tolist() == [99, 99, 2, -1, 2, 7, 99, 99, 7, 99, 99, 3, 7] and starts.tolist() == [0, 6, 9]
    assert asked == [b"aa", b"gone", b"bbb", b"\n"]
