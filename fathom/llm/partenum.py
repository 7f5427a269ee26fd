"""Exact similarity join of texts on word shingles, by PartEnum signatures.

A text is its set of distinct shingles, each a 64-bit hash.  Sets of a similar size stand
in a *band*; two that reach the similarity stand in the same band or in neighbouring ones,
so a set is in two *instances*, its own band's and the next one's, and each pair that
links is together in one.  There at most ``k`` elements belong to only one of
the two (:func:`instance`).

An instance parts the domain of hashes into ``n1`` parts, each of these into ``n2`` smaller
ones, and a signature is what a set has in all but one of the smaller parts of one part.
More than k / 2 parts are too many to have two differences each, so in at least
``spare`` parts two linked sets differ in one smaller part at most, and share the
signature that leaves that one out.  Signatures that hold nothing say little and are
met by many; a pair can hang on them only if both sets have nothing in ``spare`` parts or
more, and only such sets (one in some hundreds) send them.

Parts beyond those that differences can spoil make this a count: two linked sets share a
signature in each part that isn't spoiled, so in an instance they share at least
``spare`` signatures, less one for each part in which one of them lacks something.  Sets
that meet by chance, or by a passage, share fewer and are never looked at.

What shares a signature is a bucket.  In rounds, each bucket takes a member as its pivot,
and each set is compared with the pivot that it shares most signatures with; this settles
most links of a group of copies with a row for each member.  Buckets that hold
several components afterwards are compared in full: of small ones the pairs with enough
shared signatures are found by counting, of large ones all members meet; sets are dealt
into chunks, and two chunks with such a pair are a task's unit of work
(:func:`rest_links`).  Sets are compared as they are; components are closed over links.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fathom.llm.common import hot_join, prepare, stored, text_bytes, written
from fathom.llm.simhash import components, contracted, mixed, set_of, shingle_sets

WORDS = 4
PERCENT = 85
#: Members of a chunk, and shingles of all of them.
CHUNK = 1024
SET_CHUNK = 1 << 19
#: Sets up to this size have parts of three smaller ones, larger ones of two.
THREE_UP_TO = 256
#: Sets whose signatures a task remembers to have sent.
SENT = 1 << 20
#: Bits of a signature that name its instance.
INSTANCE_BITS = 8
#: Rounds of pivots, and members of a bucket whose pairs are counted.
ROUNDS = 2
SMALL = 32


class Instance(NamedTuple):
    number: int
    low: int
    high: int
    k: int
    n1: int
    n2: int
    spare: int


@lru_cache(maxsize=8)
def bands(percent: int, most: int) -> list[tuple[int, int]]:
    """Bands of sizes, up to one that holds ``most`` and one more.  A set that reaches
    the similarity with one of a band's least size is in it, or in the next."""
    found = [(1, 100 // percent)]
    while found[-1][0] <= most:
        low = found[-1][1] + 1
        found.append((low, low * 100 // percent))
    return found


@lru_cache(maxsize=4096)
def instance(number: int, low: int, high: int, percent: int) -> Instance:
    """For pairs of which the larger is in the band ``low`` to ``high``: they share at
    least percent / (100 + percent) of a + b, so at most ``k`` elements are in one only."""
    k = 2 * high * (100 - percent) // (100 + percent)
    n1 = (k + 2) // 2
    if n1 > 4:  # more parts than needed, so that empty signatures can be left out
        n1 += 4 + n1 // 12
    return Instance(number, low, high, k, n1, 3 if high <= THREE_UP_TO else 2, n1 - k // 2)


@lru_cache(maxsize=256)
def edges_of(n: int) -> np.ndarray:
    """Where n equal parts of the 64-bit numbers begin, but for the first."""
    return np.array([(i << 64) // n for i in range(1, n)], np.uint64)


def instances_of(size: int, percent: int) -> list[Instance]:
    """The two instances of a set of this size, but for those in which only equal sets link."""
    if not size:
        return []
    cuts = bands(percent, 2 << max(6, size.bit_length()))
    at = next(i for i, (low, high) in enumerate(cuts) if low <= size <= high)
    found = (instance(i, *cuts[i], percent) for i in (at, at + 1))
    return [x for x in found if x.k]


def signatures_of(held: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """Signatures, 64-bit numbers, of a set of ascending hashes, over both instances, the
    lowest bits naming the instance; and for each how many signatures of its instance any
    linked set shares at least."""
    out, needs = [np.zeros(0, np.uint64)], [np.zeros(0, np.int16)]
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed(held, 1), dtype=np.uint64)))
    for x in instances_of(len(held), percent):
        cuts = np.concatenate(([0], np.searchsorted(held, edges_of(x.n1 * x.n2)), [len(held)]))
        parts = np.diff(sums[cuts]).reshape(x.n1, x.n2)
        many = np.diff(cuts).reshape(x.n1, x.n2)
        # All smaller parts of a part but one, for each of them.
        shared = (parts.sum(1, dtype=np.uint64)[:, None] - parts).ravel()
        full = many.sum(1)[:, None] - many > 0
        names = np.arange(len(shared), dtype=np.uint64) + np.uint64(x.number << 40)
        found = mixed(shared + mixed(names, 2), 3)
        need = x.spare - int((~full).any(1).sum())
        if need > 0:
            found = found[full.ravel()]
        out.append(found & ~np.uint64((1 << INSTANCE_BITS) - 1) | np.uint64(x.number))
        needs.append(np.full(len(found), min(max(need, 1), 1 << 14), np.int16))
    return np.concatenate(out), np.concatenate(needs)


def node_of(held: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(held.tobytes())


def sets(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """``docs`` with long columns ``node``, a hash of the text's set of shingles, and
    ``size``, how many it has.  Columns of these names are replaced."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        gc.disable()
        for column in batches:
            rows = [(node_of(x), len(x)) for x in (set_of(t, words) for t in text_bytes(column))]
            found = np.array(rows, np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.StructArray.from_arrays([pa.array(found[:, k]) for k in range(2)], ["node", "size"])

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    made = F.arrow_udf(run, "node long, size long").asNondeterministic()(F.col("text").cast("string"))
    return docs.withColumn("__set", made).withColumns({n: F.col(f"__set.{n}") for n in ("node", "size")}).drop("__set")


def signatures(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(signature, node, need) of the texts of ``docs``.  A task sends those of equal sets
    once, as far as it remembers."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()
        sent: set[int] = set()
        for batch in batches:
            found, nodes = [signatures_of(np.zeros(0, np.uint64))], []
            for text in text_bytes(batch.column(0)):
                held = set_of(text, words)
                node = node_of(held)
                if node not in sent:
                    sent.add(node)
                    found.append(signatures_of(held, percent))
                    nodes.append(node)
            if len(sent) > SENT:
                sent.clear()
            flat, needs = (np.concatenate(x) for x in zip(*found, strict=True))
            of = np.repeat(np.array(nodes, np.uint64).view(np.int64), [len(x) for x, _ in found[1:]])
            yield pa.RecordBatch.from_arrays([pa.array(flat.view(np.int64)), pa.array(of), pa.array(needs)], ["signature", "node", "need"])

    return docs.select(F.col("text").cast("string")).mapInArrow(run, "signature long, node long, need short")


def buckets(signed: DataFrame) -> DataFrame:
    """Rows of ``signed`` whose signature has several nodes, each once.  A bucket is
    read in order of its members, so none is held."""
    ordered = Window.partitionBy("signature").orderBy("node")
    told = signed.select("*", F.lag("node").over(ordered).alias("__before"), F.lead("node").over(ordered).alias("__after"))
    apart = F.col("__before").isNull() | (F.col("__before") != F.col("node"))
    return told.filter(apart & (F.col("__before").isNotNull() | F.col("__after").isNotNull())).drop("__before", "__after")


def instance_of(signature: str = "signature"):
    return F.col(signature).bitwiseAND(F.lit((1 << INSTANCE_BITS) - 1)).cast("int")


def undone(members: DataFrame, roots: DataFrame | None) -> DataFrame:
    """(signature, node, need, root, instance) of buckets that hold several components, so
    far as each node has enough of these."""
    rooted = members.select("signature", "node", "need")
    if roots is not None:
        rooted = rooted.join(roots.select("node", "root"), "node", "left").withColumn("root", F.coalesce("root", "node"))
        bucket = Window.partitionBy("signature")
        rooted = rooted.withColumn("__low", F.min("root").over(bucket)).withColumn("__high", F.max("root").over(bucket))
        rooted = rooted.filter("__low < __high").drop("__low", "__high")
    else:
        rooted = rooted.withColumn("root", F.col("node"))
    own = Window.partitionBy("node", "instance")
    told = rooted.withColumn("instance", instance_of()).withColumn("__n", F.count(F.lit(1)).over(own))
    return told.withColumn("__least", F.max("need").over(own)).filter("__n >= __least").drop("__n", "__least")


def led_by(links: DataFrame) -> DataFrame:
    """(node, root) of nodes that link to a pivot (``a`` before ``b``, either may be it): some
    of what is joined has the same root, and nothing else has.  A few steps up, no closure."""
    up = links.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root"))
    for _ in range(2):
        above = up.select(F.col("node").alias("root"), F.col("root").alias("top"))
        up = up.join(above, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    return up


def common_with(index: np.ndarray, held: np.ndarray) -> int:
    """How many elements two ascending sets share."""
    if not len(index) or not len(held):
        return 0
    at = np.minimum(np.searchsorted(index, held), len(index) - 1)
    return int((index[at] == held).sum())


def _near(common: int, a: int, b: int, percent: int) -> bool:
    return 100 * common >= percent * (a + b - common)


def _rows(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple]:
    """The values of ``keys`` and the set, as a copy, of each row."""
    for batch in batches:
        shingles = batch.column("shingles")
        ends, flat = shingles.offsets.to_numpy(), shingles.values.to_numpy()
        columns = (batch.column(n).to_pylist() for n in keys)
        for k, row in enumerate(zip(*columns, strict=True)):
            yield *row, flat[ends[k] : ends[k + 1]].view(np.uint64)


def _links(found: list[tuple[int, int]]) -> pa.RecordBatch:
    pairs = np.array([(min(p), max(p)) for p in found], np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])


def chunked(members: DataFrame, key: str) -> DataFrame:
    """``members`` (``node``, ``size``, ``key``) with ``part``: members with the same key
    are dealt by hash into parts of about CHUNK sets or SET_CHUNK shingles."""
    many = F.ceil(F.greatest(F.count(F.lit(1)) / CHUNK, F.sum("size") / SET_CHUNK)).cast("int")
    longer = members.groupBy(key).agg(many.alias("__parts")).filter("__parts > 1")
    dealt = hot_join(members, longer, key, how="left")
    part = F.pmod(F.xxhash64("node"), F.coalesce("__parts", F.lit(1))).cast("int")
    return dealt.withColumn("part", part).drop("__parts")


def pivot_links(members: DataFrame, sets: DataFrame, sizes: DataFrame, number: int, percent: int = PERCENT) -> DataFrame:
    """Links (a, b) between sets and the pivots that they share most signatures with, if
    these are enough.

    ``members``: see :func:`undone`; ``sets``: (node, shingles); ``sizes``: (node, size).  The
    pivot is a member of a bucket picked anew for each round's ``number``.
    """
    ordered = Window.partitionBy("signature").orderBy(F.xxhash64("node", F.lit(number)), "node")
    first = F.first(F.struct("node", "root", "need")).over(ordered.rowsBetween(Window.unboundedPreceding, 0)).alias("first")
    told = members.select("instance", "node", "root", "need", first).filter("root <> first.root")
    shared = told.groupBy("node", F.col("first.node").alias("pivot"), "instance").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.greatest("need", "first.need")).alias("least")
    )
    most = F.max_by("pivot", F.struct("n", -F.col("pivot"))).alias("pivot")
    led = stored(shared.filter("n >= least").groupBy("node").agg(most).join(sizes, "node"))
    work = chunked(led, "pivot").select("pivot", "part", "node")
    first = work.select("pivot", "part", F.col("pivot").alias("node")).distinct()
    rows = work.withColumn("place", F.lit(1)).unionByName(first.withColumn("place", F.lit(0))).join(sets, "node")
    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(parts, "pivot", "part").sortWithinPartitions("pivot", "part", "place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()
        lead, index, found = None, np.zeros(0, np.uint64), []
        for pivot, node, place, held in _rows(batches, ["pivot", "node", "place"]):
            if not place:
                lead, index = pivot, held.copy()
            elif lead == pivot and _near(common_with(index, held), len(index), len(held), percent):
                found.append((pivot, node))
                if len(found) >= 10_000:
                    yield _links(found)
                    found = []
        yield _links(found)

    return dealt.mapInArrow(run, "a long, b long").distinct()


def joined(nodes: list[int], labels: list[int], held: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links between sets of different labels, enough to join what all would join: a
    set is compared with those that have shingles in common with it, found in an index of
    all, unless links have joined them already."""
    sizes = np.array([len(x) for x in held])
    _, label = np.unique(np.array(labels, np.int64), return_inverse=True)
    _, index = np.unique(np.concatenate(held), return_inverse=True)
    order = np.argsort(index, kind="stable")
    holders = np.repeat(np.arange(len(held)), sizes)[order]
    many = np.bincount(index)
    begins, ends = np.cumsum(many) - many, np.cumsum(sizes)
    found = []
    for i in range(len(held) - 1):
        others = (label != label[i]) & (100 * np.minimum(sizes, sizes[i]) >= percent * np.maximum(sizes, sizes[i]))
        others[: i + 1] = False
        if not others.any():
            continue
        mine = index[ends[i] - sizes[i] : ends[i]]
        mine = mine[many[mine] > 1]
        counts = many[mine]
        places = np.arange(counts.sum()) + np.repeat(begins[mine] - (np.cumsum(counts) - counts), counts)
        common = np.bincount(holders[places], minlength=len(held))
        near = np.flatnonzero(others & (100 * common >= percent * (sizes + sizes[i] - common)))
        if len(near):
            _, once = np.unique(label[near], return_index=True)
            found += [(nodes[i], nodes[k]) for k in near[once].tolist()]
            label[np.isin(label, label[near])] = label[i]
    return found


def rest_links(members: DataFrame, sets: DataFrame, sizes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Links (a, b) between sets of ``members`` (see :func:`undone`) that have different
    roots, enough to join what all such links would.

    Two sets that link share enough small buckets, which is counted, or a large
    one.  Sets are dealt into chunks: those of a component stay together, a set alone goes
    to the least component among those that it may link with.  A chunk's sets are sent
    once for each chunk that has a set which one of them may link with.
    """
    bucket = Window.partitionBy("signature")
    told = {"many": F.count(F.lit(1)).over(bucket), "least": F.min("root").over(bucket)}
    members = written(members.withColumns(told), "partenum-rest")
    small = members.filter(F.col("many") <= SMALL).groupBy("signature").agg(F.collect_list(F.struct("node", "root", "need")).alias("x"))
    both = small.select(instance_of().alias("instance"), "x", F.explode("x").alias("y")).select("instance", "y", F.explode("x").alias("x"))
    both = both.filter("x.node < y.node and x.root <> y.root")
    counted = both.groupBy("instance", F.struct("x.node", "x.root").alias("x"), F.struct("y.node", "y.root").alias("y")).agg(
        F.count(F.lit(1)).alias("n"), F.max(F.greatest("x.need", "y.need")).alias("least")
    )
    pairs = written(counted.filter("n >= least").select("x", "y").distinct(), "partenum-pairs")
    large = members.filter(F.col("many") > SMALL).select("signature", "node", "root", "least")

    may = pairs.select("x.node", "x.root", F.col("y.root").alias("least")).unionByName(pairs.select("y.node", "y.root", F.col("x.root").alias("least")))
    may = may.unionByName(large.select("node", "root", "least"))
    may = may.groupBy("node", "root").agg(F.min("least").alias("least"))
    leader = F.when(F.col("node") == F.col("root"), F.least("root", "least")).otherwise(F.col("root"))
    # Sets of a component apart from those that only may link with it.
    lone = (F.col("node") == F.col("root")) & (F.col("least") < F.col("root"))
    placed = may.select("node", "root", F.xxhash64(leader, lone).alias("leader")).join(sizes, "node")
    placed = stored(placed)
    placed = written(chunked(placed, "leader").select("node", "root", F.struct("leader", "part").alias("chunk")), "partenum-placed")

    of = placed.select("node", "chunk")
    told = pairs.select(F.col("x.node").alias("node"), F.col("y.node").alias("mate")).join(of, "node")
    told = told.select("chunk", F.col("mate").alias("node")).join(of.withColumnRenamed("chunk", "other"), "node")
    units = told.select(F.least("chunk", "other").alias("one"), F.greatest("chunk", "other").alias("other")).distinct()
    # Of a large bucket each chunk once, and how its roots lie; buckets often hold the same chunks.
    seen = large.join(of, "node").groupBy("signature", "chunk").agg(F.min("root").alias("low"), F.max("root").alias("high"))
    meets = seen.groupBy("signature").agg(F.sort_array(F.collect_set(F.struct("chunk", "low", "high"))).alias("chunks"))
    meets = meets.select("chunks").distinct().withColumn("one", F.explode("chunks"))
    meets = meets.withColumn("other", F.explode("chunks")).filter("one.chunk <= other.chunk")
    differ = (F.col("one.low") != F.col("one.high")) | (F.col("other.low") != F.col("other.high")) | (F.col("one.low") != F.col("other.low"))
    units = units.unionByName(meets.filter(differ).select(F.col("one.chunk").alias("one"), F.col("other.chunk").alias("other"))).distinct()
    units = written(units.withColumn("unit", F.xxhash64("one", "other")), "partenum-units")
    sides = units.select("unit", F.explode(F.array_distinct(F.array("one", "other"))).alias("chunk"))
    rows = placed.join(sides, "chunk").select("unit", "node", "root").join(sets, "node")
    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(parts, "unit").sortWithinPartitions("unit", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()
        now, nodes, roots, held = None, [], [], []
        for unit, node, root, shingles in _rows(batches, ["unit", "node", "root"]):
            if unit != now:
                if len(nodes) > 1:
                    yield _links(joined(nodes, roots, held, percent))
                now, nodes, roots, held = unit, [], [], []
            elif node == nodes[-1]:
                continue
            nodes.append(node)
            roots.append(root)
            held.append(shingles.copy())
        yield _links(joined(nodes, roots, held, percent) if len(nodes) > 1 else [])

    return contracted(dealt.mapInArrow(run, "a long, b long"))


def linked(docs: DataFrame, hits: DataFrame, rows: DataFrame, words: int, percent: int) -> DataFrame:
    """All links (a, b) between different sets that are needed to join what links join."""
    members = written(undone(hits, None), "partenum-members")
    named = rows.groupBy("node").agg(F.min("row").alias("row"), F.first("size").alias("size"))
    wanted = stored(named.join(members.select("node").distinct(), "node"))

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            ends, flat = column.offsets.to_numpy(), column.values.to_numpy()
            found = [node_of(flat[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            yield pa.array(np.array(found, np.uint64).view(np.int64))

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    told = shingle_sets(docs, wanted.select("row"), words)
    node = F.arrow_udf(run, "long").asNondeterministic()("shingles").alias("node")
    held = written(told.select(node, "shingles"), "partenum-sets")
    sizes = wanted.select("node", "size")
    found = None
    for number in range(ROUNDS):
        links = stored(pivot_links(members, held, sizes, number, percent))
        found = links if found is None else found.unionByName(links)
        # Before the last round any roots do that are equal only where links join.
        roots = components(found) if number == ROUNDS - 1 else led_by(found)
        members = written(undone(members, roots), "partenum-members")
    return found.unionByName(rest_links(members, held, sizes, percent))


def groups(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id`` for every row of ``docs`` (needs
    ``doc_id``, ``text``).

    A text's set holds its distinct shingles of so many words, lower-cased (A-Z); of a
    shorter text all its words as one.  Two rows link when 100 times what their sets share is
    at least ``percent`` times what either has; ``component_id`` is the least doc_id
    reachable over links, the row's own included.  Null texts and those without words have
    no shingles and link with nothing, not even each other.  Rows without a doc_id belong
    to components but don't name them: one of such rows alone has a null component_id.
    Repeated rows stay and link; an empty table gives none.
    """
    told = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    told = told.withColumn("row", F.xxhash64("doc_id", "text"))
    rows = stored(sets(told, words).select("doc_id", "row", "node", "size"))
    hits = written(buckets(signatures(told, words, percent)), "partenum-hits")
    joins = components(linked(told.select("row", "text"), hits, rows.filter("size > 0"), words, percent))
    distinct = rows.filter("size > 0").groupBy("node").agg(F.min("doc_id").alias("first"))
    placed = distinct.join(joins, "node", "left").withColumn("root", F.coalesce("root", "node"))
    placed = stored(placed.select("node", "root", "first"))
    named = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    of = hot_join(placed.select("node", "root"), named, "root").select("node", "component_id")
    full = hot_join(rows.filter("size > 0"), of, "node").select("doc_id", F.col("size").alias("n_shingles"), "component_id")
    bare = rows.filter("size = 0").select("doc_id", F.col("size").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return full.unionByName(bare)
