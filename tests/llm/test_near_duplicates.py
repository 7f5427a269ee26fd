"""The pipeline's near-duplicate stage: exact similarity of sets of five-word shingles."""

import random
from itertools import combinations

from fathom.llm import common, simhash

KIND = "doc_id long, text string"


def shingles(text):
    w = text.split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b)


def words(rng, n):
    return [f"w{rng.randrange(10**9)}" for _ in range(n)]


def kept(spark, rows):
    return {r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, KIND)).collect()}


def changed(rng, w, n):
    """``w`` with so many words replaced, far from each other."""
    w = list(w)
    for i in range(n):
        w[10 + i * (len(w) - 20) // n] = f"new{rng.randrange(10**9)}"
    return w


def test_texts_below_the_similarity_stay(spark):
    rng, rows = random.Random(1), []
    for i in range(20):
        w = words(rng, 300)
        a, b, c = (" ".join(x) for x in (w, changed(rng, w, 5), changed(rng, w, 9)))
        assert jaccard(a, b) >= 0.8 > 0.75 > jaccard(a, c)
        rows += [(10 * i, a), (10 * i + 1, b), (10 * i + 2, c)]
    assert kept(spark, rows) == {10 * i + k for i in range(20) for k in (0, 2)}


def test_groups_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SET_CHUNK", 2_000)
    rng = random.Random(2)
    texts = [words(rng, 100)]
    for _ in range(79):
        texts.append(changed(rng, rng.choice(texts), rng.choice([1, 2, 3])))
    texts = [" ".join(w) for w in texts]
    root = list(range(80))
    for a, b in combinations(range(80), 2):
        if jaccard(texts[a], texts[b]) >= 0.8 and root[a] != root[b]:
            low, high = sorted((root[a], root[b]))
            root = [low if r == high else r for r in root]
    docs = spark.createDataFrame(list(enumerate(texts)), "row long, text string")
    sets = simhash.shingle_sets(docs, docs.select("row"))
    members = docs.selectExpr("row", "row as node", "0L as root", "96L as size")
    found = {r.node: r.root for r in simhash.components(simhash.alike(members, sets)).collect()}
    assert 1 < len(set(root)) < 80
    assert [found.get(i, i) for i in range(80)] == root


def test_repeats_of_a_line_do_not_count(spark):
    rng, rows = random.Random(3), []
    line = words(rng, 12)
    for i in range(20):
        w = words(rng, 200)
        once, often = " ".join(w + line), " ".join(w + line * 6)
        assert jaccard(once, often) > 0.9
        rows += [(2 * i, once), (2 * i + 1, often)]
    assert kept(spark, rows) == set(range(0, 40, 2))


def test_wide_fingerprints_count_a_shingle_once():
    a = b"one two three four five six seven eight nine ten"
    (*once, held), (*often, same) = (simhash.wide_fingerprint_of(x) for x in (b" ".join([a] * 2), b" ".join([a] * 9)))
    assert once == often and held.tolist() == same.tolist()


def test_contracted_links_join_the_same_nodes(spark):
    rng = random.Random(6)
    pairs = {tuple(sorted(rng.sample(range(300), 2))) for _ in range(250)} | {(b, a) for a in range(400, 500) for b in range(300, 306)}
    edges = spark.createDataFrame([(min(p), max(p)) for p in pairs], "a long, b long")
    few = simhash.contracted(edges)
    assert few.filter("a between 300 and 499").count() <= 105
    one, other = ({r.node: r.root for r in simhash.components(x).collect()} for x in (edges, few))
    assert one == other


def test_hot_keys_meet_apart(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 20)
    many = spark.range(200).selectExpr("id", "case when id < 120 then 1 when id < 150 then 2 else id end as k")
    few = spark.range(1, 190).selectExpr("id as k", "id * 10 as v").union(spark.createDataFrame([(500, 1)], "k long, v long"))
    assert common.hot_keys(many, "k") == [1, 2]
    for how in ("inner", "left", "left_semi"):
        want = sorted(map(tuple, many.join(few, "k", how).collect()), key=repr)
        assert sorted(map(tuple, common.hot_join(many, few, "k", how=how).collect()), key=repr) == want


def test_large_groups_and_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 20)
    rng = random.Random(7)
    w = words(rng, 200)
    near = [(i, " ".join(changed(rng, w, 2))) for i in range(100, 160)]
    rows = [*near, *[(7, "one text in many rows " + " ".join(w[:9]))] * 90, (8, " ".join(words(rng, 60)))]
    got = simhash.keep_one(spark.createDataFrame(rows, KIND)).collect()
    assert sorted(r.doc_id for r in got) == [7, 8, 100]
    of = {r.doc_id: r.component_id for r in simhash.groups(spark.createDataFrame([*rows, (None, rows[70][1])], KIND)).collect()}
    assert of[7] == 7 and of[None] == 7


def test_texts_that_share_an_id_lead_their_own_groups(spark):
    rng = random.Random(4)
    one, other = (" ".join(words(rng, 50)) for _ in range(2))
    rows = [(1, one), (1, other), (1, other), (2, one), (3, other), (None, one)]
    got = simhash.keep_one(spark.createDataFrame(rows, KIND)).collect()
    assert sorted(map(tuple, got)) == sorted([(1, one), (1, other)])
