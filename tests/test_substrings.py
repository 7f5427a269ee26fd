"""The trigram index against the scan."""

import pyarrow as pa
import pytest

from fathom.operators import search, substrings
from fathom.operators.substrings import SubstringIndex, parts_of

SF = "/root/testdata/sf0.001"
QUESTIONS = ["license", "LICENSE text", "ich ", "der%die", "a_d", "zz", "", "qqqqzzz", "50\\%", "e\\_mail", "_____", "the the", "Ä", "straße", "i̇st"]


@pytest.fixture(scope="module")
def rows(spark):
    texts = ["50% more", "e_mail", "STRASSE and Straße", "İstanbul İST", None, "", "ab", "\U0001f600 smile", "tab\tand\nline"]
    extra = spark.createDataFrame([(90_000 + i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(extra)


@pytest.fixture(scope="module")
def index(rows, tmp_path_factory):
    made = SubstringIndex.build(rows.filter("doc_id % 2 = 0"), str(tmp_path_factory.mktemp("grams") / "i"), "text")
    made.append(rows.filter("doc_id % 2 <> 0"))
    return made


@pytest.mark.parametrize("question", QUESTIONS)
def test_equal_to_the_scan(rows, index, question):
    want = sorted(r.doc_id for r in rows.filter(search.holds("text", question)).collect())
    assert sorted(r.doc_id for r in index.holding(question).collect()) == want


def test_a_search_reads_its_own_trigrams(index):
    grams = index.rarest("license")
    assert 0 < len(grams) <= 4
    plan = index.holding("license")._jdf.queryExecution().toString()
    assert "PushedFilters: [In(gram" in plan or "PushedFilters: [Or" in plan or "PushedFilters: [EqualTo(gram" in plan
    assert index.rarest("zz") is None and index.rarest("qqqqzzz") == []


def test_first_rows(rows, index):
    got = index.lexical("the", ["doc_id"], 5).collect()
    assert [r.doc_id for r in got] == [r.doc_id for r in search.lexical(rows, "text", "the", ["doc_id"], 5).collect()]


def test_parts_between_wildcards():
    assert parts_of("ab%cd_e\\%f\\x") == ["ab", "cd", "e%fx"]
    assert parts_of("%_") == [] and parts_of("end\\") == ["end%"]


def test_postings_are_sent_on_in_bounded_batches(monkeypatch):
    """A batch's postings aren't held together; a long text is looked at by stretches."""
    texts = ["".join(chr(97 + (i * k * k + k) % 26) for k in range(400)) for i in range(1, 60)] + ["", "ab", "abc"]
    want = {(t[k : k + 3], i) for i, t in enumerate(texts) for k in range(len(t) - 2)}
    batch = pa.RecordBatch.from_pydict({"id": list(range(len(texts))), "text": texts})
    monkeypatch.setattr(substrings, "POSTINGS", 500)
    monkeypatch.setattr(substrings, "CHARS", 7)
    sent = list(substrings._postings(iter([batch])))
    assert len(sent) > 2 and max(b.num_rows for b in sent) < 1000
    rows = [(r["gram"], r["id"]) for b in sent for r in b.to_pylist()]
    mask = (1 << substrings.CHAR_BITS) - 1
    named = [("".join(chr(g >> s * substrings.CHAR_BITS & mask) for s in (2, 1, 0)), i) for g, i in rows]
    assert len(named) == len(set(named)) and set(named) == want
