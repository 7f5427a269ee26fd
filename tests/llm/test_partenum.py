"""The similarity join against a comparison of all pairs."""

import random
import time
from itertools import combinations
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fathom.llm import common, partenum, queries, simhash

SF = "/root/testdata/sf0.001"


def plain_set(text, words=4):
    found = [w for w in re_words((text or "").translate(LOWER))]
    if not found:
        return frozenset()
    return frozenset(" ".join(found[i : i + words]) for i in range(max(1, len(found) - words + 1)))


LOWER = {c: c + 32 for c in range(65, 91)}


def re_words(text):
    out, now = [], ""
    for c in text + " ":
        if c in " \t\n\x0b\x0c\r":
            if now:
                out.append(now)
            now = ""
        else:
            now += c
    return out


def plain(rows):
    """{place: (size, component)} of rows (doc_id, text), by comparing all pairs."""
    sets = [plain_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= 85 * len(sets[i] | sets[j]):
            parent[top(i)] = top(j)
    least = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least[top(i)] = min(key, least.get(top(i), key))
    return [(key, len(sets[i]), least.get(top(i))) for i, (key, _) in enumerate(rows)]


def told(found):
    return sorted(map(repr, found))


def near_copies(rng, base, n, edits):
    """Copies of a text with up to so many words changed, put in or taken out."""
    made = []
    for _ in range(n):
        words = list(base)
        for _ in range(rng.randint(0, edits)):
            at = rng.randrange(len(words))
            rng.choice((words.pop, lambda i: words.insert(i, f"n{rng.random():.3f}"), lambda i: words.__setitem__(i, f"c{rng.random():.3f}")))(at)
        made.append(" ".join(words))
    return made


@pytest.fixture(scope="module")
def planted():
    """Groups of near copies of all lengths about the similarity, chains, and passages."""
    rng = random.Random(5)
    texts = []
    for length in (3, 4, 6, 8, 9, 10, 12, 15, 20, 30, 40, 60, 90, 150, 300, 700, 2500):
        for _ in range(3):
            base = [f"w{rng.randrange(3000)}" for _ in range(length)]
            texts += near_copies(rng, base, 6, max(1, length // 20))
    passage = [f"p{i}" for i in range(60)]
    for i in range(40):
        texts.append(" ".join([f"a{i}-{k}" for k in range(100)] + passage + [f"b{i}-{k}" for k in range(60)]))
    walk = [f"v{i}" for i in range(200)]
    for i in range(40):  # each near the one before only
        walk[(i * 7) % 200] = f"x{i}"
        texts.append(" ".join(walk))
    rng.shuffle(texts)
    return [(i * 3 + 1, t) for i, t in enumerate(texts)]


def test_planted_groups(spark, planted):
    docs = spark.createDataFrame(planted, "doc_id long, text string").repartition(5)
    got = [tuple(r) for r in partenum.groups(docs).collect()]
    assert told(got) == told(plain(planted))
    assert 100 < len({c for *_, c in got}) < len(planted) - 100


@pytest.mark.parametrize("small", [1, 4, 1000])
def test_small_chunks(spark, planted, monkeypatch, small):
    """Chunks of a few members find the same links, whether buckets count as small or not."""
    monkeypatch.setattr(partenum, "CHUNK", 3)
    monkeypatch.setattr(partenum, "SMALL", small)
    monkeypatch.setattr(partenum, "ROUNDS", 1)
    docs = spark.createDataFrame(planted, "doc_id long, text string").repartition(5)
    assert told(tuple(r) for r in partenum.groups(docs).collect()) == told(plain(planted))


def test_join_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert told(tuple(r) for r in queries.op12_partenum_join(spark, SF).collect()) == told(plain(rows))


@settings(max_examples=300, deadline=None)
@given(st.integers(1, 900), st.integers(0, 2**31))
def test_linked_sets_share_a_signature(size, seed):
    """Pairs at the similarity's edge, of all sizes."""
    rng = np.random.default_rng(seed)
    both = rng.integers(0, 2**64, size, np.uint64)
    only = size * 100 // 85 - size
    split = rng.integers(0, only + 1)
    others = rng.integers(0, 2**64, only, np.uint64)
    a, b = np.unique(np.append(both, others[:split])), np.unique(np.append(both, others[split:]))
    assert 100 * len(np.intersect1d(a, b)) >= 85 * len(np.union1d(a, b))
    if not np.array_equal(a, b):
        enough(a, b)


def enough(a, b):
    """In some instance both share as many signatures as each of them says."""
    one, other = (dict(zip(s.tolist(), n.tolist(), strict=True)) for s, n in map(partenum.signatures_of, (a, b)))
    shared = {}
    for x in one.keys() & other.keys():
        shared.setdefault(x & 255, []).append(max(one[x], other[x]))
    assert any(len(found) >= max(found) for found in shared.values())


def test_sets_in_few_parts_share_a_signature():
    """Hashes that all lie close together leave most parts empty."""
    for size in (6, 9, 14, 40, 300):
        a = np.arange(size, dtype=np.uint64)
        b = a[1:] if 100 * (size - 1) >= 85 * size else a
        if len(a) != len(b):
            enough(a, b)


def test_bands_cover_all_sizes():
    cuts = partenum.bands(85, 5000)
    assert cuts[0] == (1, 1) and all(b[0] == a[1] + 1 for a, b in zip(cuts, cuts[1:], strict=False))
    for number, (low, high) in enumerate(cuts[1:], 1):
        x = partenum.instance(number, low, high, 85)
        # Of any pair in it, more parts than can have two differences each.
        assert x.spare >= 1 and x.n1 - x.k // 2 == x.spare
        assert high + 1 > low * 100 / 85 or high == low


HARD = [(1, "a b c d e f g h"), (1, "a b c d e f g h"), (2, None), (3, ""), (None, "one two"), (5, "ONE two"), (None, "lone"), (None, None), (7, " \t\n"), (8, "z " * 30_000), (9, "z " * 40_000)]


def test_hard_rows(spark):
    docs = spark.createDataFrame(HARD, "doc_id long, text string").selectExpr("*", "'r' as row", "'n' as node", "'s' as size")
    got = [tuple(r) for r in partenum.groups(docs).collect()]
    assert told(got) == told([(1, 5, 1), (1, 5, 1), (2, 0, 2), (3, 0, 3), (None, 1, 5), (5, 1, 5), (None, 1, None), (None, 0, None), (7, 0, 7), (8, 1, 8), (9, 1, 8)])


def test_empty_table(spark):
    assert partenum.groups(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_a_stored_step_leaves_no_shuffle_files(spark):
    def lying():
        folders = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().localDirsString()
        return {x for folder in folders for x in Path(folder).glob("*/shuffle_*")}

    rows = spark.range(2000).withColumn("k", F.col("id") % 7)
    for keep in (common.stored, lambda x: common.written(x, "step")):
        before = lying()
        step = keep(rows.groupBy("k").count().repartition(3, "count"))
        until = time.time() + 20
        while lying() - before and time.time() < until:
            time.sleep(0.2)
        assert not lying() - before
        assert step.count() == 7
    assert spark.conf.get(common.CLEAR_SHUFFLES) == "false"


def test_roots_are_the_same_broadcast_or_joined(spark, monkeypatch):
    rng = random.Random(5)
    chain = [(i, i + 1) for i in range(40)]
    star = [(100, 101 + i) for i in range(300)]
    edges = chain + star + [(rng.randrange(500, 600), rng.randrange(500, 600)) for _ in range(60)] + [(-5, 7), (700, 700)]
    rng.shuffle(edges)
    table = spark.createDataFrame(edges, "a long, b long")
    least = {x: x for e in edges for x in e}
    for _ in least:
        for a, b in edges:
            least[a] = least[b] = min(least[a], least[b])
    for few in (simhash.FEW_NODES, 0):
        monkeypatch.setattr(simhash, "FEW_NODES", few)
        assert {r.node: r.root for r in simhash.components(table).collect()} == least
