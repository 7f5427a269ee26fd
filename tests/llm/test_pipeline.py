"""The pipeline's stages against what their operators say of the same rows."""

from itertools import combinations

import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline as P

from fathom.llm import importance, mixing, quality_rules, queries, simhash
from fathom.llm.pretokens import load_ranks

SF = "/root/testdata/sf0.001"


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def jaccard(a, b):
    return len(a & b) / len(a | b)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_stages(spark, tmp_path):
    assert [n for n, _ in P.STAGES] == ["quality_rules", "quality_classifier", "near_duplicates", "mix", "tokens"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    first, kept = docs.columns, {}
    for name, stage in P.STAGES:
        out = str(tmp_path / name)
        stage(spark, docs, SF).write.parquet(out)
        before, docs = docs, spark.read.parquet(out)
        kept[name] = docs
        if name != "tokens":
            assert docs.columns == first
        if name == "quality_rules":
            assert rows(docs) == rows(quality_rules.judge(before).filter("rules.kept").select(*first))
        elif name == "quality_classifier":
            scored, _, least = importance.classify(before, labels)
            assert {r.doc_id for r in docs.collect()} == {r.doc_id for r in scored.collect() if r.gumbel_key >= least}
        elif name == "near_duplicates":
            assert rows(docs) == rows(simhash.keep_one(before))
            sets = {r.doc_id: shingles(r.text) for r in before.collect()}
            left = {r.doc_id for r in docs.collect()}
            alike = [(a, b, jaccard(sets[a], sets[b])) for a, b in combinations(sorted(sets), 2)]
            assert not [x for x in alike if x[2] >= 0.8 and {x[0], x[1]} <= left]
            for i in sets.keys() - left:
                assert any(i in (a, b) and j >= 0.8 for a, b, j in alike)
        elif name == "mix":
            copies = {r.doc_id: r.copies for r in mixing.mix(before).collect()}
            got = [r.doc_id for r in docs.collect()]
            assert all(got.count(i) == n for i, n in copies.items())
        else:
            ranks = load_ranks(public_tokenizers.path(queries.VOCABULARY))
            e = tiktoken.Encoding("p", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
            texts = {r.doc_id: r.text for r in before.collect()}
            assert all(r.ids == e.encode_ordinary(texts[r.doc_id]) for r in docs.collect())
    good = {r.doc_id for r in labels.filter("quality = 1").collect()}
    clean = {r.doc_id for r in quality_rules.judge(spark.read.parquet(f"{SF}/documents.parquet")).filter("not rules.base_failed").collect()}
    assert good & clean <= {r.doc_id for r in kept["quality_rules"].collect()}
    assert rows(P.run(spark, SF)) == rows(kept["tokens"])


HARD = [
    (1, "a b c d e f g h i j k", "en", "s1", 21),
    (1, "a b c d e f g h i j k", "en", "s1", 21),
    (2, None, "en", None, None),
    (3, "", None, "s1", 0),
    (None, "no id here", "en", "s2", 10),
    (None, None, None, None, None),
    (7, "word and more " * 20_000, "en", "s2", 280_000),
    (8, "日本語のテキスト \U0001f600 été", "ja", "s3", 14),
    (9, "x" * 50_000, "en", "s3", 50_000),
    (9, "another text under the same id", "en", "s3", 30),
]
KIND = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_take_hard_rows_and_empty_tables(spark):
    for name, stage in P.STAGES:
        docs = spark.createDataFrame(HARD, KIND).withColumn("other", F.lit("x")).repartition(3)
        out = stage(spark, docs, SF)
        rows_out = out.collect()
        assert stage(spark, docs.limit(0), SF).collect() == []
        if name == "tokens":
            assert len(rows_out) == len(HARD) and [r.ids for r in rows_out if r.doc_id in (2, 3)] == [[], []]
            continue
        assert out.columns == docs.columns
        texts = sorted((r.doc_id or 0, r.text or "") for r in rows_out)
        if name == "quality_rules":
            assert texts == []
        if name == "near_duplicates":
            want = {(1, HARD[0][1]), (2, ""), (0, "no id here"), *((r[0], r[1]) for r in HARD[6:])}
            assert texts == sorted(want)
        if name == "mix":
            assert all(texts.count(t) <= 3 * sum((r[0] or 0, r[1] or "") == t for r in HARD) for t in texts)
