"""The operators against plain versions over small tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from itertools import combinations

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st

from fathom.llm import bpe, common, edit_counts, importance, kneser_ney, licenses, mixing, queries, quality_rules, simhash, syncmers, toxicity
from fathom.llm.pretokens import UNITS, load_ranks

SF = "/root/testdata/sf0.001"
PATH, PATTERN = public_tokenizers.path(queries.VOCABULARY), public_tokenizers.PATTERN
RANKS = load_ranks(PATH)
ENCODING = tiktoken.Encoding("brute", pat_str=PATTERN, mergeable_ranks=RANKS, special_tokens={})


@pytest.fixture(scope="module")
def texts(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    return {r.doc_id: r.text for r in rows}


def by_id(frame):
    return {r.doc_id: r for r in frame.collect()}


# 1


def edited(text, start, removed, inserted):
    start = min(start, len(text))
    return text[:start] + inserted + text[start + removed :]


def test_edit_counts(spark, texts):
    got = by_id(queries.op1_edit_counts(spark, SF))
    for i, t in texts.items():
        n = len(t)
        e = edited(edited(edited(t, 0, 0, "Revised draft. "), n // 2, 16, " as edited, "), n * 9 // 10, 40, "")
        assert (got[i].n_tokens, got[i].edited_tokens) == (len(ENCODING.encode_ordinary(t)), len(ENCODING.encode_ordinary(e)))
        assert got[i].edited_sha256 == hashlib.sha256(e.encode()).hexdigest()
    long = [r for r in got.values() if r.n_pretokens > 1000]
    assert long and all(r.encoded_pretokens < 40 for r in long)


SIGNS = st.text(st.sampled_from("ab C1\n\t'sllre!-é\xa0　½日\U0001f600"), max_size=60)
COUNT = edit_counts.Counter(RANKS, PATTERN)


@settings(max_examples=300, deadline=None)
@given(SIGNS, st.lists(st.tuples(st.integers(0, 70), st.integers(0, 20), SIGNS), max_size=5))
def test_edits_anywhere(text, edits):
    tree = edit_counts.Tree.of(text, COUNT)
    for e in edits:
        tree.edit(*e)
        text = edited(text, *e)
        check_tree(tree, text)


def check_tree(tree, text):
    cut = COUNT.cut.findall(text)
    assert tree.text() == text
    assert [n for x in tree.leaves for n in x.lengths] == list(map(len, cut))
    assert all(sum(x.lengths) == len(x.text) and len(x.lengths) <= 2 * edit_counts.LEAF for x in tree.leaves)
    assert (tree.chars[1], tree.tokens[1]) == (len(text), len(ENCODING.encode_ordinary(text)))
    k = np.arange(1, tree.size)
    for sums in (tree.chars, tree.tokens):
        assert (sums[k] == sums[2 * k] + sums[2 * k + 1]).all()


def test_trees_grow_and_divide():
    rng, text = random.Random(3), "seed text "
    tree = edit_counts.Tree.of(text, COUNT)
    for k in range(400):
        e = (rng.randrange(len(text) + 1), rng.randrange(9 if k < 250 else 90), " ".join("xy'z \n"[: rng.randrange(6)] * rng.randrange(9)))
        tree.edit(*e)
        text = edited(text, *e)
        check_tree(tree, text)


def test_many_appended_edits_stay_balanced():
    tree, text = edit_counts.Tree.of("", COUNT), ""
    for i in range(1000):
        more = f" part {i}" + " and forty words" * 13
        tree.edit(len(text), 0, more)
        text += more
    check_tree(tree, text)
    assert tree.size <= 4 * len(text.split()) / edit_counts.LEAF


def test_text_without_blanks_is_encoded_near_the_edit():
    text = ",".join(f"k{i}=v{i}" for i in range(5000))
    tree = edit_counts.Tree.of(text, COUNT)
    tree.edit(len(text) // 2, 3, "new")
    assert tree.encoded < 12
    check_tree(tree, edited(text, len(text) // 2, 3, "new"))


def test_trees_are_kept_as_rows(spark, texts, tmp_path):
    some = [(i, t) for i, t in sorted(texts.items())[:40]] + [(-1, None), (-2, ""), (-3, "x" * 5000)]
    docs = spark.createDataFrame(some, "doc_id long, text string")
    edit_counts.build(docs, PATH, PATTERN).write.parquet(str(tmp_path / "trees"))
    kept = spark.read.parquet(str(tmp_path / "trees")).selectExpr("*", "array(named_struct('start', 9, 'removed', 4, 'inserted', ' new')) as edits")
    once = edit_counts.apply(kept, PATH, PATTERN)
    twice = edit_counts.apply(once.selectExpr("doc_id", "counts.edited_text as text", "tree", "edits"), PATH, PATTERN)
    for r in twice.collect():
        t = dict(some)[r.doc_id] or ""
        e = edited(edited(t, 9, 4, " new"), 9, 4, " new")
        assert r.counts.edited_text == e
        assert r.tree.char_sums[0] == len(e) and r.tree.token_sums[0] == r.counts.edited_tokens == len(ENCODING.encode_ordinary(e))
        assert r.counts.encoded_pretokens < 20


# 2


def test_mix_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    theirs = {r[0]: r[1:] for r in con.sql(queries.MIX_SQL).fetchall()}
    ours = {r.doc_id: tuple(r)[1:] for r in queries.op2_source_mix(spark, SF).collect()}
    assert ours == theirs


def test_mix_targets_and_bounds(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(["w"] * rng.randrange(1, 60)), rng.choice(["a"] * 50 + ["b"] * 20 + ["c", None])) for i in range(3000)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(d).collect()
    again = {r.doc_id: r.taken for r in mixing.mix(d.repartition(7)).collect()}
    assert {r.doc_id: r.taken for r in got} == again
    for s in {r.source for r in got}:
        own = [r for r in got if r.source == s]
        assert own[0].source_size == sum(r.size for r in own)
        assert own[0].target <= 3 * own[0].source_size
        assert abs(sum(r.taken for r in own) - own[0].target) <= 60
    targets = {r.source: r.target for r in got}
    assert sum(targets.values()) == pytest.approx(sum(r.size for r in got))
    assert all(r.taken <= 3 * r.size for r in got)


# 3


def pieces(text):
    ends = "aeiouyAEIOUY02468"
    out, held = [], ""
    for c in text:
        if c in " \t\n\v\f\r":
            out, held = [*out, held], ""
        elif c in ends or ord(c) >= 128:
            out, held = [*out, held + c], ""
        elif len(held) == 24:
            out, held = [*out, held], c
        else:
            held += c
    return [x.encode() for x in (*out, held) if x]


def plain_anchors(text):
    w = pieces(text)
    h = [xxhash.xxh64_intdigest(b, xxhash.xxh64_intdigest(a, 42)) for a, b in zip(w, w[1:])]
    signed = [x - (1 << 64) if x >> 63 else x for x in h]

    def chain(values):
        seed = 42
        for v in values:
            seed = xxhash.xxh64_intdigest(v, seed)
        return seed & 0xFFFFFFFF

    found = [
        chain(h[i + j].to_bytes(8, "little") for j in (0, 2, 4))
        for i in range(len(h) - 4)
        if min(signed[i : i + 5]) in (signed[i], signed[i + 4])
    ]
    return found or ([chain(w)] if w else [])


def plain_likeness(a, b):
    a, b = list(dict.fromkeys(a)), list(dict.fromkeys(b))
    one, other = [x for x in a if x in set(b)], [x for x in b if x in set(a)]
    if not a + b:
        return 1.0
    return 2 * sum(1 - abs(i - other.index(x)) / len(one) for i, x in enumerate(one)) / (len(a) + len(b))


def test_syncmers(spark, texts):
    got = by_id(queries.op3_closed_syncmers(spark, SF))
    ids = sorted(texts)
    for i, j in zip(ids, [*ids[1:], ids[0]]):
        t, n = texts[i], texts[j]
        e = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
        a, b, c = map(plain_anchors, (t, e, n))
        assert got[i].edited_sha256 == hashlib.sha256(e.encode()).hexdigest()
        assert got[i].fingerprint == "".join("%08x" % x for x in a)
        assert got[i].edited_fingerprint == "".join("%08x" % x for x in b)
        assert got[i].near_edited == pytest.approx(plain_likeness(a, b))
        assert got[i].near_next == pytest.approx(plain_likeness(a, c))
    short = [got[i] for i in ids if 8 <= len(texts[i].split()) < 26]
    assert len(short) >= 2 and all(r.near_edited > 0 for r in short)


def test_anchors_do_not_hang_on_what_stands_before(spark):
    rng = random.Random(8)
    han = "".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(3000))
    code = "".join(rng.choice("bcdfghjklmnpqrstvwxz13579aeiou02468+/") for _ in range(3000))
    prose = " ".join("".join(rng.choice("abcdefghiklmnoprstuw") for _ in range(6)) for _ in range(400))
    rows = [(i, t, "x" + t, t[1500:] + t[:1500]) for i, t in enumerate((han, code, prose))]
    d = spark.createDataFrame(rows, "id long, t string, shifted string, turned string")
    t, s, r = (syncmers.anchors(d[c]) for c in ("t", "shifted", "turned"))
    for row in d.select(syncmers.likeness(t, s).alias("shifted"), syncmers.likeness(t, r).alias("turned")).collect():
        assert row.shifted > 0.98 and 0.4 < row.turned < 0.6


def test_next_of_crowded_ids(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 20)
    monkeypatch.setattr(syncmers, "BUCKET", 4)
    rows = [(i, f"text {i}") for i in range(60)] + [(7, f"crowd {i}") for i in range(90)] + [(None, f"none {i}") for i in range(90)]
    rows += [(7, "crowd 1")] * 3 + [(59, None)]
    got = syncmers.with_next(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()

    def key(row):
        i, t = row
        h = xxhash.xxh64_intdigest(t.encode(), 42)
        return i is None, i or 0, h - (1 << 64) if h >> 63 else h, t

    want = sorted(((i, t or "") for i, t in rows), key=key)
    assert sorted(((r.doc_id, r.text, r.next_text) for r in got), key=repr) == sorted(
        ((i, t, n) for (i, t), (_, n) in zip(want, [*want[1:], want[0]])), key=repr
    )


# 4


def test_rules(spark, texts):
    got = by_id(queries.op4_compression_bands(spark, SF))
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        grams = Counter(zip(w, w[1:], w[2:]))
        covered = {k for p, g in enumerate(zip(w, w[1:], w[2:])) if grams[g] > 1 for k in (p, p + 1, p + 2)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        r = got[i]
        base = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base
        failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
        assert r.base_failed == failed
        b, z = t.encode(), zstandard.ZstdCompressor(level=3, write_content_size=False)
        low, high = next((x, y) for most, x, y in quality_rules.BANDS if len(b) <= most)
        ratio = len(z.compress(b)) / len(b)
        cuts = [b[k : k + 4096] for k in range(0, len(b), 4096)] if len(b) > 4096 else []
        bad = 0
        for c in cuts:
            least, most = next((x, y) for n, x, y in quality_rules.CHUNK_BANDS if len(c) <= n)
            bad += 0 if least <= len(z.compress(c)) / len(c) <= most else len(c)
        assert r.bad_share == pytest.approx(bad / max(1, len(b)) if cuts else 0)
        assert r.kept == (not failed and low <= ratio <= high and 4 * bad <= len(b))


def test_the_last_chunk_is_judged():
    z = zstandard.ZstdCompressor(level=3, write_content_size=False)
    rng = random.Random(4)
    prose = " ".join("".join(rng.choice("etaoinshr") for _ in range(rng.randrange(2, 9))) for _ in range(2000)).encode()
    whole, chunks = quality_rules.ratios(prose[:4096] + b"again " * 500, z)
    assert [n for n, _ in chunks] == [4096, 3000]
    assert quality_rules.bad_share(chunks) == pytest.approx(3000 / 7096)
    assert quality_rules.bad_share(quality_rules.ratios(prose[:7096], z)[1]) == 0
    assert quality_rules.bad_share(quality_rules.ratios(prose[:4100], z)[1]) == 0


def test_rules_reject_repetition_and_noise():
    z = zstandard.ZstdCompressor(level=3, write_content_size=False)
    noise = np.random.default_rng(1).bytes(20_000)
    for bad in (b"the same line again\n" * 800, noise):
        assert not quality_rules.in_bands(*quality_rules.ratios(bad, z), len(bad))


# 5


def test_importance(spark, texts):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows, ratio, least = importance.classify(docs, labels)
    got = by_id(rows)
    buckets = importance.BUCKETS

    def grams(t):
        h = [xxhash.xxh64_intdigest(w) for w in importance.TOKENS.findall(t.encode().lower())]
        mask = (1 << 64) - 1
        twos = [((a * 0x9E3779B97F4A7C15 + b) * 0xD6E8FEB86659FD93 & mask) >> 20 for a, b in zip(h, h[1:])]
        return [x % buckets for x in (*h, *twos)]

    every = {i: Counter(grams(t)) for i, t in texts.items()}
    raw = sum(every.values(), Counter())
    target = sum((every[i] for i in ratio.of_half), Counter())
    ids = {r.doc_id for r in labels.filter("quality = 1").collect()}
    assert set(ratio.of_half) == ids

    def log_p(c, b):
        return math.log(c[b] + 1) - math.log(sum(c.values()) + buckets)

    for i, c in every.items():
        assert got[i].log_weight == pytest.approx(sum(n * (log_p(target, b) - log_p(raw, b)) for b, n in c.items()))
    keys = sorted((r.gumbel_key for r in got.values()), reverse=True)
    weakest = sorted(r.held_out_weight for r in got.values() if r.held_out_weight is not None)[int(0.005 * len(ids))]
    k = sum(r.log_weight >= weakest for r in got.values())
    assert least == keys[k - 1]


def test_importance_query_and_stage_agree(spark):
    labels, docs = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("labels", "documents"))
    rows, _, least = importance.classify(docs, labels)
    want = {r.doc_id: r.gumbel_key >= least for r in rows.collect()}
    assert {r.doc_id: r.kept for r in queries.op5_importance_resampling(spark, SF).collect()} == want
    assert {r.doc_id for r in importance.keep(docs, labels).collect()} == {i for i, k in want.items() if k}
    assert 0 < sum(want.values()) < len(want)


def test_importance_ties_are_all_taken(spark):
    rows = [(1, "good words here")] * 3 + [(2, "other things")] + [(None, "good words here")] * 2 + [(5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    got = [r.doc_id for r in importance.keep(docs, labels).collect()]
    assert got.count(1) in (0, 3) and got.count(None) in (0, 2)
    none = importance.keep(docs, labels.filter("quality = 0")).collect()
    assert len(none) == len(rows)


def test_kth_largest(spark):
    d = spark.range(50_000).selectExpr("cast(pmod(xxhash64(id), 1000) as double) as x")
    values = sorted((r.x for r in d.collect()), reverse=True)
    for k in (1, 2, 777, 25_000, 50_000):
        assert importance.kth_largest(d, "x", k, most=10) == values[k - 1]


# 6


def test_bpe(spark, texts):
    got = by_id(queries.op6_bpe_replay(spark, SF))
    for i, t in texts.items():
        ids = ENCODING.encode_ordinary(t)
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()


MERGES = bpe.Merges(RANKS)


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab C1\n\t'sllre!-éaaa\xa0　\x1c\x85½日\U0001f600"), max_size=80))
def test_bpe_anywhere(text):
    units = UNITS.findall(text)
    assert "".join(units) == text
    words = [w.encode() for p in bpe.Cutter(PATTERN)(units) for w in p]
    ids = [i for x in bpe.replay(words, MERGES) for i in np.frombuffer(x, np.int32).tolist()]
    assert ids == ENCODING.encode_ordinary(text)


def test_bpe_over_many_batches(spark, monkeypatch):
    rng = random.Random(12)
    monkeypatch.setattr(bpe, "BLOCK_CHARS", 3_000)  # the driver's copy; workers take their own
    texts = [" ".join("".join(rng.choice("abcdeé日") for _ in range(rng.randrange(1, 6))) for _ in range(rng.randrange(200))) for _ in range(300)]
    texts += ["x" * 20_000, "日本" * 5_000, None, ""]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(7)
    for r in bpe.encode(d, PATH, PATTERN).collect():
        assert r.ids == ENCODING.encode_ordinary(r.text or "")


def test_words_with_one_hash_are_told_apart(tmp_path, monkeypatch):
    def alike(words):
        return np.array([(7, sum(w)) for w in words], np.uint64).reshape(-1, 2)

    monkeypatch.setattr(bpe, "digests", alike)
    words = ["a", "b", "c", "d"]
    keys = alike([w.encode() for w in words])
    bpe.shared_files.write(str(tmp_path), "words-0", keys[:, 0], keys[:, 1], np.arange(5), np.arange(4, dtype=np.int32))
    encoder = bpe.Encoder(bpe.Words(str(tmp_path), 4), PATTERN)
    assert [np.frombuffer(x, np.int32).tolist() for x in encoder.ids_of(["c", "a", "d"])] == [[2], [0], [3]]
    with pytest.raises(KeyError):
        encoder.ids_of(["e"])


def test_shelves_keep_few_files_open(tmp_path):
    for k in range(20):
        bpe.shared_files.write(str(tmp_path), f"f{k}", np.arange(k, dtype=np.uint64), np.full(3, k, np.uint8), np.zeros(0))
    shelf = bpe.shared_files.Shelf(f"file:{tmp_path}", most=4)
    for k in (*range(20), 3, 19):
        one, three, none = shelf(f"f{k}")
        assert one.tolist() == list(range(k)) and three.tolist() == [k] * 3 and not len(none)
        assert len(shelf.open) <= 4


def test_pairs_of_lower_rank_come_first():
    single = {bytes([i]): i for i in range(256)}
    ranks = single | {b"bc": 300, b"abc": 256, b"cd": 299, b"bcd": 298, b"abcd": 297}
    merges = bpe.Merges(ranks)
    for word in (b"abcd", b"abcabcd", b"xbcdabcbc"):
        assert np.frombuffer(bpe.replay([word, b"q"], merges)[0], np.int32).tolist() == merges.one(word)


# 7


def discounts(values):
    m = Counter(values)
    y = m[1] / (m[1] + 2 * m[2]) if m[1] + m[2] else 0
    return [min(max(k - (k + 1) * y * m[k + 1] / m[k] if m[k] else k / 2, 0), k) for k in (1, 2, 3)]


class PlainModel:
    """Interpolated modified Kneser-Ney over dictionaries, of any order."""

    def __init__(self, lines, order):
        grams = Counter()
        for line in lines:
            padded = [None] * (order - 1) + line
            grams.update(tuple(padded[i : i + order]) for i in range(len(line)))
        self.words = {w for line in lines for w in line}
        self.tables = []  # highest order first
        for _ in range(order):
            d, total, back = discounts(grams.values()), Counter(), Counter()
            for g, x in grams.items():
                total[g[:-1]] += x
                back[g[:-1]] += d[min(x, 3) - 1]
            self.tables.append((grams, d, total, back))
            grams = Counter(g[1:] for g in grams)

    def p(self, gram, level=0):
        if level == len(self.tables):
            return 1 / (len(self.words) + 1)
        grams, d, total, back = self.tables[level]
        context, x = gram[:-1], grams[gram]
        below = self.p(gram[1:], level + 1)
        if not total[context]:
            return below
        return (max(x - d[min(x, 3) - 1], 0) if x else 0) / total[context] + back[context] / total[context] * below


def lines_of(texts):
    return {i: [*(t or "").encode().lower().split(), b"\n"] for i, t in texts.items()}


def log_p(model, line, order):
    padded = [None] * (order - 1) + line
    return sum(math.log10(model.p(tuple(padded[i : i + order]))) for i in range(len(line)))


def test_kneser_ney(spark, texts):
    got = by_id(queries.op7_kneser_ney(spark, SF))
    line = lines_of(texts)
    train = [i for i in texts if zlib.crc32(str(i).encode()) % 10]
    c = Counter(w for i in train for w in line[i])
    n, v = sum(c.values()), len(c)
    plain = PlainModel([line[i] for i in train], kneser_ney.ORDER)
    for i, words in line.items():
        r = got[i]
        assert (r.held_out, r.train_tokens) == (i not in train, n)
        assert (r.n_tokens, r.n_known) == (len(words), sum(w in c for w in words))
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words))
        assert r.score == pytest.approx(log_p(plain, words, kneser_ney.ORDER))
    context = (b"of", b"the")[2 - kneser_ney.ORDER + 1 :]
    assert sum(plain.p((*context, w)) for w in c) + plain.p((*context, b"never seen")) == pytest.approx(1)


@pytest.mark.parametrize(("order", "wide"), [(2, False), (3, False), (3, True)])
def test_orders_and_wide_keys(spark, texts, order, wide, monkeypatch):
    some = {i: t for i, t in sorted(texts.items())[:60]} | {-1: None, -2: "", -3: "of the of the of the " * 200}
    if wide:
        own = kneser_ney.Triples.__init__

        def widened(self, *how):
            own(self, *how)
            self.wide = True

        monkeypatch.setattr(kneser_ney.Triples, "__init__", widened)
        probe = kneser_ney.Triples(4, {0: 9}, {0: 0}, 9, np.array([9]))
        bucket, context = probe.contexts(np.array([1, 9, 9]), np.array([2, 9, 3]))
        keys = probe.keys(context, np.array([5, 6, 7]))
        assert keys.dtype == kneser_ney.WIDE
        for k in range(3):
            _, two, three = probe.parts(int(bucket[k]), keys[k : k + 1])
            assert (two[0], three[0]) == ([2, 9, 3][k], [5, 6, 7][k])
        rows = kneser_ney.pieces(np.zeros(3, np.int64), keys, np.array([1, 2, 300])).to_pylist()
        ((_, merged, counts),) = kneser_ney.merged(iter(rows), True)
        assert set(map(tuple, merged.tolist())) == set(map(tuple, keys.tolist())) and sorted(counts) == [1, 2, 300]
        return
    d = spark.createDataFrame(list(some.items()), "doc_id long, text string").repartition(5)
    model = kneser_ney.train(d.filter("doc_id % 3 <> 0"), order)
    line = lines_of(some)
    plain = PlainModel([x for i, x in line.items() if i % 3], order)
    for r in kneser_ney.score(d, model).collect():
        assert r.lm.score == pytest.approx(log_p(plain, line[r.doc_id], order))


@pytest.mark.parametrize("room", [True, False])
def test_counts_beside_keys(room):
    counts = np.array([1, 14, 15, 16, 254, 255, 256, 70_000, 3])
    keys = np.arange(9, dtype=np.uint64) * np.uint64(3) + np.uint64(5)
    table = kneser_ney.Table(*kneser_ney.with_counts(keys, counts, room))
    assert len(table.beside) == (0 if room else 9)
    assert table.counts(np.array([7, 0, 2, 6, 1])).tolist() == [70_000, 1, 15, 256, 14]
    assert table.count_of(np.array([5, 6, 29, 4, 100], np.uint64)).tolist() == [1, 0, 3, 0, 0]
    spans, names = (np.array([0, 3, 1]), np.array([2, 3, 9])), np.array([7, 8, 9], np.uint64)
    memory = kneser_ney.Memory()
    for longest in (64, 1, 1):  # counted, remembered, known
        kneser_ney.LONG_CONTEXT = longest
        try:
            assert table.followed(*spans, memory, "a", names).tolist() == [[15, 1, 0, 1], [0, 0, 0, 0], [int(counts[1:].sum()), 0, 0, 8]]
        finally:
            kneser_ney.LONG_CONTEXT = 64
    assert memory.size == 2


def test_frequent_first_words_are_spread(spark):
    rows = [(i, " ".join(f"the w{i}_{j}" for j in range(40))) for i in range(50)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    model = kneser_ney.train(d)
    assert len(model.frequent) >= 2  # "the", and the place before a text
    plain, line = PlainModel(list(lines_of(dict(rows)).values()), 3), lines_of(dict(rows))
    p = {r.doc_id: r.lm for r in kneser_ney.score(d, model).collect()}
    assert all(x.score > x.base_score for x in p.values())
    assert all(x.score == pytest.approx(log_p(plain, line[i], 3)) for i, x in p.items())


# 8


def toxic_rows(n, seed=5):
    rng = random.Random(seed)
    common_words = [f"word{i}" for i in range(300)]
    rows, marks = [], []
    for i in range(n):
        toxic = rng.random() < 0.2
        words = rng.choices(common_words, k=60) + ([f"{x}{rng.choice(['', 's', 'ly', 'ness'])}" for x in rng.sample(["nasty", "vile", "rotten"], 2)] if toxic else [])
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
        marks.append((i, rng.randrange(2), int(toxic)))
    return rows, marks


MARKS = "doc_id long, quality int, toxic int"


def plain_probabilities(chain, text):
    words = {w for w in re.findall(r"[0-9a-z]+", text.lower())}
    found = set()
    for w in words:
        found |= {xxhash.xxh64_intdigest(x.encode()) % (1 << 18) for x in [f"^{w}$", *(f"^{w[:k]}" for k in (4, 5, 6) if len(w) >= k)]}
    out = []
    for w in chain.weights:
        z = sum(w[k] for k in found) + w[1 << 18] + sum(a * b for a, b in zip(out, w[(1 << 18) + 1 :]))
        out.append(1 / (1 + math.exp(-z)))
    return out


def test_toxicity_chain(spark):
    rows, marks = toxic_rows(1500)
    rows += [(3, rows[9][1]), (2000, ""), (2001, None), (None, rows[1][1])]
    marks = [*marks[:1000], (5, 1 - marks[5][1], 1 - marks[5][2]), (None, 1, 1), (12, None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame(marks, MARKS)
    chain = toxicity.train(docs, labels)
    again = toxicity.train(docs.repartition(5), labels.repartition(3))
    assert all((a == b).all() for a, b in zip(chain.weights, again.weights)) and chain.thresholds == again.thresholds
    assert chain.categories == ["toxic_prose", "toxic_junk", "toxic"]
    assert [len(w) - (1 << 18) for w in chain.weights] == [1, 2, 3]
    got = {r.doc_id: r.toxicity for r in toxicity.predict(docs, chain).collect() if r.doc_id != 3}
    for i, text in rows[1::37] + [(2000, "")]:
        p = plain_probabilities(chain, text)
        assert (got[i].p_toxic_prose, got[i].p_toxic_junk, got[i].p_toxic) == pytest.approx(p)
        assert got[i].flagged == (p[2] >= chain.thresholds[2])
    wrong = sum(got[i].flagged != (chain_flag == 1) for i, _, chain_flag in toxic_rows(1500)[1][1000:])
    assert wrong <= 5
    # The verdict hangs on the links before the last one.
    cut = [*chain.weights[:2], np.where(np.arange(len(chain.weights[2])) > 1 << 18, 0, chain.weights[2])]
    alone = toxicity.Chain(chain.categories, cut, chain.thresholds)
    other = {r.doc_id: r.toxicity for r in toxicity.predict(docs, alone).collect() if r.doc_id != 3}
    assert max(abs(other[i].p_toxic - got[i].p_toxic) for i in got) > 0.01


def test_toxicity_out_of_fold(spark):
    rows, marks = toxic_rows(120)
    rows += [(500 + i, t) for i, t in rows[:20]]  # equal texts share a fold
    marks += [(500 + i, q, t) for i, q, t in marks[:20]]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, MARKS)
    chain = toxicity.train(docs, labels)
    assert chain.ids == sorted(i for i, _, _ in marks)
    at = {i: k for k, i in enumerate(chain.ids)}
    assert all(chain.folds[at[i]] == chain.folds[at[500 + i]] for i in range(20))
    made, text_of = toxicity.Featurizer(), dict(rows)
    sets = [made(text_of[i].encode()) for i in chain.ids]
    used = np.flatnonzero(np.bincount(np.concatenate(sets), minlength=1 << 18) >= 5)
    features = toxicity.Rows([np.searchsorted(used, s[np.isin(s, used)]) for s in sets], len(used))
    label = {i: (t == 1 and q == 1, t == 1 and q == 0, t == 1) for i, q, t in marks}
    y = np.array([label[i] for i in chain.ids], float)
    dense = np.ones((len(sets), 1))
    for k in range(3):
        outside = np.zeros(len(sets))
        for f in range(4):
            w = toxicity.fit_logistic(features, dense, y[:, k], (chain.folds != f).astype(float))
            slope = features.back((chain.folds != f) * (toxicity.sigmoid(features.times(w, dense)) - y[:, k]), dense) / (chain.folds != f).sum() + toxicity.PENALTY * w
            first = features.back((chain.folds != f) * (0.5 - y[:, k]), dense) / (chain.folds != f).sum()
            assert np.linalg.norm(slope) <= 1.001 * toxicity.TOLERANCE * np.linalg.norm(first)
            own = chain.folds == f
            outside[own] = toxicity.sigmoid(features.times(w, dense))[own]
        assert chain.outside[:, k] == pytest.approx(outside)
        dense = np.column_stack((dense, outside))


def test_toxicity_query(spark, texts):
    got = queries.op8_toxicity_chain(spark, SF)
    assert got.columns == ["doc_id", "p_toxic_prose", "p_toxic_junk", "p_toxic", "toxic"]
    marks = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    flags = {r.doc_id: r.toxic for r in got.collect()}
    assert flags.keys() == texts.keys()
    assert sum(flags[i] != bool(t) for i, t in marks.items() if i in flags) <= 0.15 * len(marks)  # ten toxic texts to learn from


def test_toxic_texts_are_caught(spark):
    """On labels that were not learned from: a model that flags nothing, or all, fails."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    learned = "crc32(cast(doc_id as string)) % 2 = 0"
    model = toxicity.train(docs, labels.filter(learned))
    held_out = docs.join(labels.filter(f"not {learned}"), "doc_id")
    pairs = [(bool(r.toxic), r.flagged) for r in toxicity.predict(held_out, model).select("toxic", "toxicity.flagged").collect()]
    caught, toxic, flagged = sum(a and b for a, b in pairs), sum(a for a, _ in pairs), sum(b for _, b in pairs)
    assert toxic > 100 and caught >= 0.6 * toxic and caught >= 0.85 * flagged


# 9


def test_position_sets_hold_a_subset_of_any_four():
    sets = [set(s) for s in simhash.position_sets(4)]
    assert len(sets) == 20
    assert all(any(s <= set(four) for s in sets) for four in combinations(range(8), 4))


def components(prints):
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(ids, 2):
        if (prints[a] ^ prints[b]).bit_count() <= 4:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_simhash(spark, texts):
    got = by_id(queries.op9_simhash_groups(spark, SF))
    prints = {}
    for i, t in texts.items():
        w = t.encode().lower().split()
        h = [xxhash.xxh64_intdigest(b" ".join(w[j : j + 4]), 42) for j in range(max(1, len(w) - 3))] if w else []
        prints[i] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
        assert got[i].fingerprint == "%016x" % prints[i]
    assert {i: r.component_id for i, r in got.items()} == components(prints)


@pytest.mark.parametrize("chunk", [4, 1024])
def test_crowded_lists(spark, chunk):
    rng = random.Random(2)
    prints = {0: 0}
    for i in range(1, 400):
        old = prints[rng.randrange(i)] if rng.random() < 0.9 else rng.getrandbits(64)
        for b in rng.sample(range(64), rng.choice([1, 2, 4, 5, 6])):
            old ^= 1 << b
        prints[i] = old
    signed = {i: p - (1 << 64) if p >> 63 else p for i, p in prints.items()}
    distinct = spark.createDataFrame([(p,) for p in set(signed.values())], "fingerprint long").repartition(3)
    found = simhash.components(simhash.links(distinct, 4, chunk)).collect()
    roots = {r.node: r.root for r in found}
    of = components(prints)
    ours = {i: roots.get(p, p) for i, p in signed.items()}
    assert len({(of[i], ours[i]) for i in prints}) == len(set(of.values())) == len(set(ours.values()))


# 10


def test_licenses(spark, texts):
    marked = dict(texts)
    template = licenses.TEMPLATES["MIT-text"]
    marked[10_001] = "Some words before it. " * 40 + template.upper() + " and after it." * 50
    marked[10_002] = " ".join(template.split()[:70])
    marked[10_003] = "intro " + licenses.TEMPLATES["GPL-3-text"]
    d = spark.createDataFrame(list(marked.items()), "doc_id long, text string")
    rows = [(r.doc_id, x.license, x.contained) for r in licenses.scan(d).collect() for x in r.licenses]
    wanted = {n: set(licenses.shingles(licenses.tokens(t.encode()))) for n, t in licenses.TEMPLATES.items()}
    held = {i: set(licenses.shingles(licenses.tokens(t.encode()))) for i, t in marked.items()}
    # What a text holds stands together here, but for one notice, of which the words are scattered.
    anywhere = {(i, n) for i, h in held.items() for n, w in wanted.items() if len(h & w) >= 0.8 * len(w)}
    assert {(i, n) for i, n, _ in rows} == anywhere - {(10_003, "GPL-2.0-only-header")}
    assert all(0.8 <= share <= len(held[i] & wanted[n]) / len(wanted[n]) + 1e-9 for i, n, share in rows)
    found = {(i, n) for i, n, _ in rows}
    assert {(10_001, "MIT-text"), (10_003, "GPL-3-text")} <= found and (10_002, "MIT-text") not in found


SCANNER = licenses.Scanner(licenses.TEMPLATES)


def test_each_occurrence_is_a_row():
    mit, bsd = licenses.TEMPLATES["MIT-text"], licenses.TEMPLATES["BSD-opening"]
    text = " ".join(["word"] * 20 + [mit] + ["more"] * 300 + [mit] + [bsd] + [mit] + ["end"] * 9)
    n, m = len(licenses.tokens(mit.encode())), len(licenses.tokens(bsd.encode()))
    rows = [r for r in SCANNER.scan(text.encode()) if r["license"] == "MIT-text"]
    starts = [20, 320 + n, 320 + 2 * n + m]
    assert [(r["first_word"], r["last_word"], r["contained"]) for r in rows] == [(s, s + n - 1, 1.0) for s in starts]


@pytest.mark.parametrize("gap", [0, 1, 4, 15, 40])
def test_short_notices_close_together(gap):
    """Each comes as a row of its own, however near the next one is."""
    short = {n: t for n, t in licenses.TEMPLATES.items() if 5 <= len(licenses.tokens(t.encode())) <= 12}
    assert short
    for name, text in short.items():
        n = len(licenses.tokens(text.encode()))
        line = (" ".join(["word"] * gap) + " ").join([text + " "] * 3)
        rows = [r for r in SCANNER.scan(line.encode()) if r["license"] == name]
        starts = [k * (n + gap) for k in range(3)]
        assert [(r["first_word"], r["last_word"], r["contained"]) for r in rows] == [(s, s + n - 1, 1.0) for s in starts], name


def test_edited_licenses_are_found():
    """Of all templates with words replaced, dropped and put in, those of which four
    fifths of the shingles are left."""
    rng = random.Random(11)
    due = met = 0
    for name, text in licenses.TEMPLATES.items():
        own = set(licenses.shingles(licenses.tokens(text.encode())))
        for _ in range(8):
            words = text.split()
            for _ in range(max(1, len(words) * rng.randrange(1, 5) // 100)):
                at = rng.randrange(len(words))
                words[at : at + rng.choice([0, 1, 1])] = rng.choice([[], [f"new{rng.randrange(99)}"]])
            edited_text = " ".join(["before"] * rng.randrange(50) + words + ["after"] * rng.randrange(50))
            left = set(licenses.shingles(licenses.tokens(edited_text.encode())))
            if len(left & own) >= 0.8 * len(own):
                due += 1
                met += any(r["license"] == name for r in SCANNER.scan(edited_text.encode()))
    assert due > 150 and met == due


def test_license_query(spark, texts):
    got = {(r.doc_id, r.license, r.first_word, r.last_word) for r in queries.op10_license_scan(spark, SF).collect()}
    want = {(i, r["license"], r["first_word"], r["last_word"]) for i, t in texts.items() for r in SCANNER.scan(t.encode())}
    assert got == want and got
