"""Aligned tokens of two tokenizers against plain versions, text by text."""

import hashlib
import json
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from fathom.llm import alignment, queries

SF = "/root/testdata/sf0.001"
PATHS = [public_tokenizers.path(x) for x in queries.TOKENIZERS]
A = Tokenizer.from_file(PATHS[0])
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
# The usual way to write bytes as printable characters, said another way.
SIGNS = [c for c in range(256) if chr(c).isprintable() and chr(c) != " " and c != 0xAD]
OF = {chr(c): c for c in SIGNS} | {chr(256 + n): c for n, c in enumerate(c for c in range(256) if c not in SIGNS)}
TOKENS = {i: bytes(OF.get(c, 63) for c in t) for t, i in A.get_vocab().items()}


def plain(text):
    """(ids of A, ids of B, groups, linked pairs with repeats)."""
    if not text:
        return [], [], [], []
    a = A.encode(" " + text, add_special_tokens=False).ids
    b = B.encode(text)
    sides = []
    for ids, of in ((a, TOKENS.get), (b, lambda i: bytes([int(B.id_to_piece(i)[3:5], 16)]) if B.is_byte(i) else B.id_to_piece(i).replace("▁", " ").encode())):
        spans, at, joined = [], 0, b""
        for i in ids:
            spans.append((at, at + len(of(i))))
            joined += of(i)
            at = len(joined)
        if joined != (" " + text).encode():
            return [], [], [], []
        sides.append(spans)
    pairs, groups, low = [], [], [0, 0]
    for i, (s, e) in enumerate(sides[0]):
        pairs += [(a[i], b[j]) for j, (x, y) in enumerate(sides[1]) if x < e and s < y]
    shared = sorted({e for _, e in sides[0]} & {e for _, e in sides[1]})
    for stop in shared:
        tops = [sum(e <= stop for _, e in side) for side in sides]
        groups.append((a[low[0] : tops[0]], b[low[1] : tops[1]]))
        low = tops
    return a, b, groups, pairs


def shown(groups):
    return ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)


def against(rows, texts, got):
    """All rows, by their place, against the plain version of all texts."""
    found = [plain(t) for t in texts]
    count = Counter(p for *_, pairs in found for p in set(pairs))
    most = {}
    for (a, _), n in count.items():
        most[a] = max(n, most.get(a, 0))
    for key, (a, b, groups, pairs) in zip(rows, found, strict=True):
        r = got[key]
        assert (r.n_a, r.n_b, r.n_groups, r.n_links) == (len(a), len(b), len(groups), len(pairs))
        assert r.n_best == sum(count[p] == most[p[0]] for p in pairs)
        assert r.count_sum == sum(count[p] for p in pairs)
        line = shown(groups)
        assert r.groups_sha256 == (hashlib.sha256(line.encode()).hexdigest() if line else "")


def short(text):
    return text if len(text) < 4000 else text[:2000] + text[-2000:]


@pytest.fixture(scope="module")
def aligner():
    return alignment.Aligner(*PATHS)


def test_alignment_query(spark, tmp_path):
    """The query over all documents, long ones shortened, as the plain version is quadratic."""
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    kept = [(r.doc_id, short(r.text)) for r in rows]
    kept += [(9001, None), (9002, ""), (9003, " "), (9004, "a▁b"), (9005, "  two  blanks "), (9006, "<|endoftext|> <s> <0x41>")]
    spark.createDataFrame(kept, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op11_token_alignment(spark, str(tmp_path)).collect()}
    against([i for i, _ in kept], [t for _, t in kept], got)
    assert got[9004].n_a == 0 and got[9003].n_a > 0


def test_rare_pairs_are_joined(spark):
    """Counts don't hang on how many pairs are broadcast."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(60)
    aligned = alignment.align(docs, *PATHS)
    every, few, none = (
        sorted(tuple(r) for r in alignment.count_links(aligned.drop("text"), n).collect()) for n in (1 << 19, 500, 0)
    )
    assert every == few == none and len(every) == 60


ODD = st.text(st.sampled_from("ab C1\n\t\r'sllre!-é\xa0　½日\U0001f600᠎▁<|>\x00\x1c\x85"), max_size=50)


@settings(max_examples=300, deadline=None)
@given(st.lists(ODD, max_size=6))
def test_blocks_of_odd_texts(aligner, documents):
    got = aligner.block(documents).to_pylist()
    for text, r in zip(documents, got, strict=True):
        a, b, groups, pairs = plain(text)
        assert (r["n_a"], r["n_b"], r["n_groups"], r["n_links"]) == (len(a), len(b), len(groups), len(pairs))
        assert r["groups"] == shown(groups)
        linked = Counter(x << alignment.ID_BITS | y for x, y in pairs)
        assert r["pairs"] == sorted(linked) and r["times"] == [linked[p] for p in sorted(linked)]
        assert len(r["ends"]) == len(groups) and (not groups or r["ends"][-1] == len(text.encode()) + 1)


def test_long_word_and_memo(aligner, monkeypatch):
    long = "abc" * 100_000
    monkeypatch.setattr(alignment, "MEMO_UNITS", 3)
    for _ in range(2):
        one, other = aligner.block([long, "some words after it and a few more"]).to_pylist()
        assert one["n_a"] == len(A.encode(" " + long, add_special_tokens=False).ids)
        assert other["groups"] == shown(plain("some words after it and a few more")[2])
    assert long not in aligner.memo.of


def test_added_tokens_are_known():
    with open(PATHS[0], encoding="utf-8") as file:
        added = {x["content"].encode() for x in json.load(file)["added_tokens"]}
    assert added <= set(alignment.Bytes(PATHS[0]).tokens)


HARD = [(1, "a b c", "x"), (1, "a b c", "x"), (2, None, None), (None, "a b", "y"), (3, "", "z"), (None, None, None)]


def test_hard_rows(spark):
    docs = spark.createDataFrame(HARD, "doc_id long, text string, n_best string").selectExpr("*", "'o' as alignment", "'p' as pairs")
    found = alignment.count_links(alignment.align(docs, *PATHS))
    assert sorted(found.columns) == sorted(["doc_id", "text", "pairs", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"])
    rows = found.collect()
    assert len(rows) == 6 and [r.n_a for r in rows if r.doc_id == 1] == [3, 3]
    # " a" and " b" are linked in three rows, " c" in two.
    assert {(r.n_best, r.count_sum) for r in rows if r.doc_id == 1} == {(3, 8)}
    assert all(r.n_links == r.count_sum == 0 for r in rows if not r.text)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.count_links(alignment.align(docs, *PATHS)).collect() == []


def test_units_met_again_stay_when_the_memo_is_full(aligner, monkeypatch):
    monkeypatch.setattr(alignment, "MEMO_UNITS", 4)
    memo = alignment.Memo(aligner.memo.sides)
    memo.numbers(["often", "once"])
    memo.numbers(["often", "rare"])
    numbers = memo.numbers(["new", "often", "other "])
    assert set(memo.of) == {"often", "new", "other "}
    for k, side in enumerate(memo.sides):
        ids, many = memo.tokens(k, numbers)
        alone = side.encode(["new", "often", "other "])
        assert ids.tolist() == [i for x in alone for i in x] and many.tolist() == [len(x) for x in alone]
