"""SimHash near-duplicates over a byte-position inverted index.

Two 64-bit fingerprints that differ in at most ``max_bits`` bits agree in at
least ``8 - max_bits`` of their bytes, byte for byte in place (4 of 8 for 4 bits).
The index therefore posts a fingerprint under small *sets* of byte positions,
chosen so that each set of that many positions contains one of them; a
pair within reach always meets in a posting list.  Within a list, pairs are
tallied over all eight bytes, those with fewer than the guaranteed matches drop,
and the rest are verified by their differing bits.

Wider fingerprints (several 64-bit words, each from a hash of its own) reach down
to a given similarity: each distinct shingle counts once, so bits differ in
proportion to the angle between sets of shingles, and a Jaccard similarity sets a
number of bits.  That many differing bits can spoil every byte, so the number of
matches is one that similar texts reach almost surely (``WIDE_SHARED``).  These
fingerprints are posted under a byte position together with two MinHashes of the
shingles, which keeps lists short however many texts there are: what meets in a
list has two shingles in common.  Bits only propose groups of candidates; inside
these, texts are linked by the exact similarity of their sets of shingles (see
:func:`alike`).

Equal fingerprints count once, and lists with one member drop before any fingerprint
is sent.  A posting list that is long is cut into chunks, each pair of chunks being
a task's unit of work, so a list is never held whole; and of what is joined in a
unit only the links of each member to the least one are emitted, so a group of
copies costs a row per member, not per pair (see also :func:`contracted`).
"""

from __future__ import annotations

import gc
import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fathom.llm.common import hot_join, hot_keys, prepare, stored, text_bytes

SHINGLE_WORDS = 4
MAX_BITS = 4
SEED = 42
#: Members of a posting list that one unit of work compares with another such chunk.
CHUNK = 1024
BYTES = 8

#: For wide fingerprints: words of 64 bits, MinHashes, and how far apart the two
#: MinHashes stand that a byte position is posted with.  With 32 bytes that makes
#: 128 lists; texts with a Jaccard similarity of 0.8 meet in 22 of them on average,
#: and in none with a probability below 0.002.
WIDTH = 4
MINIMA = 8
MINIMA_APART = (1, 2, 3, 4)
#: Bytes that a pair must share to be verified.  At a similarity of 0.8 it shares 8.6
#: of 32 on average, and fewer than three with a probability of 0.004.
WIDE_SHARED = 3
WIDE_WORDS = 5
SIMILARITY = 0.8
#: Shingles of a group of candidates that one unit of work compares with another
#: such chunk; bits of the filter for the rows whose shingles are needed.
SET_CHUNK = 1 << 19
FILTER_BITS = 1 << 24
#: Nodes whose roots are broadcast, at most; roots of more are joined.
FEW_NODES = 1 << 15


def fingerprint_of(text: bytes, words: int = SHINGLE_WORDS) -> int:
    """64 bits; a bit is set if it is set in over half of the shingle hashes,
    repeats counted."""
    return majority(np.array([xxhash.xxh64_intdigest(x, SEED) for x in shingles_of(text, words)], np.uint64))


def wide_fingerprint_of(text: bytes, words: int = WIDE_WORDS, width: int = WIDTH) -> tuple[tuple[int, ...], tuple[int, ...], np.ndarray]:
    """As many such numbers, each from a hash of its own, but each distinct shingle
    counts once; MinHashes (0 without shingles); and the distinct hashes, as
    :func:`set_of` gives them."""
    held = set_of(text, words)
    prints = tuple(majority(mixed(held, k)) for k in range(width))
    least = (mixed(held, width + k) for k in range(MINIMA))
    return prints, tuple(int(h.min()) if len(h) else 0 for h in least), held


def mixed(hashes: np.ndarray, k: int) -> np.ndarray:
    """The k-th hash of what has these ones: a bijection of 64 bits for each k."""
    if not k:
        return hashes
    with np.errstate(over="ignore"):
        x = hashes + np.uint64(k) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles_of(text: bytes, words: int) -> list[bytes]:
    """Runs of so many words, with repeats; of a shorter text all its words."""
    tokens = text.lower().split()  # lower() on bytes changes A-Z only
    if not tokens:
        return []
    line = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1]
    last = max(1, len(tokens) - words + 1)
    cuts = zip(starts[:last].tolist(), ends[min(words, len(tokens)) - 1 :].tolist(), strict=True)
    return [line[a:b] for a, b in cuts]


def set_of(text: bytes, words: int) -> np.ndarray:
    """The hashes of a text's distinct shingles, ascending."""
    return np.unique(np.array([xxhash.xxh64_intdigest(x, SEED) for x in set(shingles_of(text, words))], np.uint64))


def majority(hashes: np.ndarray) -> int:
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 65_536):
        part = hashes[i : i + 65_536].astype(">u8").view(np.uint8).reshape(-1, BYTES)
        ones += np.unpackbits(part, axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = SHINGLE_WORDS, into: str = "fingerprint") -> DataFrame:
    """``docs`` with a long column ``into`` (the 64 bits as a signed number).

    Null and empty texts have fingerprint 0; a text with fewer words than a
    shingle has its whole word sequence as its only one.
    """
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        gc.disable()
        for column in batches:
            found = np.array([fingerprint_of(x, words) for x in text_bytes(column)], np.uint64)
            yield pa.array(found.view(np.int64), pa.int64())

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return docs.withColumn(into, F.arrow_udf(run, "long").asNondeterministic()(F.col("text").cast("string")))


def wide_fingerprints(docs: DataFrame, words: int = WIDE_WORDS, width: int = WIDTH) -> DataFrame:
    """``docs`` with long columns ``__f0``, ``__f1``, ... (see :func:`fingerprints`),
    ``__m0``, ``__m1``, ..., the MinHashes, ``__node``, a hash of the set of
    shingles, and ``__size``, how many it has.  Columns of these names are replaced."""
    prepare(docs.sparkSession)
    names = [*(f"f{k}" for k in range(width)), *(f"m{k}" for k in range(MINIMA)), "node", "size"]

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        gc.disable()
        for column in batches:
            rows = []
            for x in text_bytes(column):
                printed, least, held = wide_fingerprint_of(x, words, width)
                rows.append((*printed, *least, xxhash.xxh64_intdigest(held.tobytes()), len(held)))
            found = np.array(rows, np.uint64).reshape(-1, len(names)).view(np.int64)
            yield pa.StructArray.from_arrays([pa.array(found[:, k]) for k in range(len(names))], names)

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    made = F.arrow_udf(run, ", ".join(f"{n} long" for n in names)).asNondeterministic()
    printed = docs.withColumn("__f", made(F.col("text").cast("string")))
    return printed.withColumns({f"__{n}": F.col(f"__f.{n}") for n in names}).drop("__f")


def bits_for(similarity: float, bits: int) -> int:
    """Differing bits that texts of this Jaccard similarity stay under, but for one
    in 700 of them: their number's mean and three standard deviations."""
    part = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return math.floor(bits * part + 3 * math.sqrt(bits * part * (1 - part)))


def position_sets(max_bits: int) -> list[tuple[int, ...]]:
    """Sets of byte positions of which any ``8 - max_bits`` positions contain one.

    Up to 4 bits: the bytes stand in three groups; the triples within a group
    and the pairs of one group with a byte of the next.  Any four positions
    contain one of these.
    """
    sure = BYTES - max_bits
    if sure < 1:
        raise ValueError("a fingerprint of 8 bytes guarantees a shared byte up to 7 bits")
    if sure < 4:
        return list(combinations(range(BYTES), sure))
    thirds = [(0, 1, 2), (3, 4, 5), (6, 7)]
    found = [t for t in thirds if len(t) == 3]
    for i, third in enumerate(thirds):
        after = thirds[(i + 1) % 3]
        found += [tuple(sorted((*pair, one))) for pair in combinations(third, 2) for one in after]
    return found


def _joined(a: np.ndarray, b: np.ndarray | None, max_bits: int, shared_bytes: int) -> np.ndarray:
    """A label for each row of ``a`` and then of ``b``, equal for rows that are joined
    within ``a``, or between ``a`` and ``b``, by pairs of at most ``max_bits``
    differing bits that share at least ``shared_bytes`` bytes.  A row is a fingerprint."""
    both = a if b is None else np.concatenate((a, b))
    label = np.arange(len(both))
    bytes_of = np.ascontiguousarray(both).view(np.uint8).reshape(len(both), -1)
    for i in range(len(a)):
        low = i + 1 if b is None else len(a)
        if low >= len(both):
            break
        # Tally the bytes shared in place; only pairs with enough are verified.
        shared = (bytes_of[low:] == bytes_of[i]).sum(1)
        near = np.flatnonzero(shared >= shared_bytes) + low
        near = near[np.bitwise_count(both[near] ^ both[i]).sum(1) <= max_bits]
        near = near[label[near] != label[i]]
        if len(near):
            met = np.unique(np.append(label[near], label[i]))
            label[np.isin(label, met)] = met[0]
    return label


def _link_lists(max_bits: int, shared_bytes: int, names: list[str]):
    """Links within units of work: rows sorted by (list, unit), each with its node,
    its fingerprint (columns ``names``) and the side it is on."""

    def unit(nodes: np.ndarray, prints: np.ndarray, sides: np.ndarray) -> np.ndarray:
        """(least node, node) for every other node of what is joined in the unit.
        Lists that join the same nodes say so in the same rows."""
        if sides.any():
            one, other = np.flatnonzero(sides == 0), np.flatnonzero(sides == 1)
            nodes = nodes[np.concatenate((one, other))]
            label = _joined(prints[one], prints[other], max_bits, shared_bytes)
        else:
            label = _joined(prints, None, max_bits, shared_bytes)
        order = np.lexsort((nodes, label))
        nodes, label = nodes[order], label[order]
        first = np.r_[True, label[1:] != label[:-1]]
        least = nodes[np.maximum.accumulate(np.where(first, np.arange(len(nodes)), 0))]
        return np.stack((least[~first], nodes[~first]), axis=1)

    def emit(nodes: np.ndarray, prints: np.ndarray, sides: np.ndarray, ends: np.ndarray) -> pa.RecordBatch:
        begins = np.r_[0, ends[:-1]] if len(ends) else ends
        more = ends - begins > 1
        spans = zip(begins[more].tolist(), ends[more].tolist(), strict=True)
        found = [unit(nodes[a:b], prints[a:b], sides[a:b]) for a, b in spans]
        pairs = np.concatenate([np.zeros((0, 2), np.int64), *found])
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()
        held: list[tuple[np.ndarray, ...]] = []
        # A unit can go over into the next batch, so its rows so far are held.
        for batch in batches:
            if not batch.num_rows:
                continue
            plain = [batch.column(n).to_numpy(zero_copy_only=False) for n in ("list", "unit", "side", "node")]
            words = np.stack([batch.column(n).to_numpy(zero_copy_only=False) for n in names], axis=1).view(np.uint64)
            lists, units, sides, nodes, prints = (np.concatenate(x) for x in zip(*held, (*plain, words), strict=True))
            cuts = np.flatnonzero((lists[1:] != lists[:-1]) | (units[1:] != units[:-1])) + 1
            done = cuts[-1] if len(cuts) else 0
            yield emit(nodes[:done], prints[:done], sides[:done], cuts)
            held = [(lists[done:], units[done:], sides[done:], nodes[done:], prints[done:])]
        for _, _, sides, nodes, prints in held:
            yield emit(nodes, prints, sides, np.array([len(nodes)]))

    return run


def contracted(edges: DataFrame) -> DataFrame:
    """Links (a, b), a < b, that join the same nodes, but about one per node: a
    node stays linked to the least of its ``a``, and the others of these to that
    one.  A group that meets in many lists names a few least members over and over."""
    parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    told = edges.repartition(parts, "b").distinct()  # by ``b``, so the window needs no other exchange
    ranked = told.withColumn("least", F.min("a").over(Window.partitionBy("b")))
    other = F.when(F.col("a") == F.col("least"), F.col("b")).otherwise(F.col("a"))
    return ranked.select(F.col("least").alias("a"), other.alias("b")).distinct()


def links(
    distinct: DataFrame,
    max_bits: int = MAX_BITS,
    chunk: int = CHUNK,
    names: list[str] | None = None,
    minima: list[str] | None = None,
    shared_bytes: int | None = None,
) -> DataFrame:
    """Links (a, b) between distinct fingerprints within ``max_bits`` bits, enough
    of them to join what all links would join.

    ``distinct``: fingerprint, one long that names itself; or a long ``node``, the
    fingerprint's words in the columns ``names`` and MinHashes in the columns
    ``minima``.  It is read twice.
    """
    spark = prepare(distinct.sparkSession)
    wide = names is not None
    if not wide:
        names, shared_bytes = ["print"], BYTES - max_bits
        distinct = distinct.select(F.col("fingerprint").alias("node"), F.col("fingerprint").alias("print"))

    def byte(p: int):
        word = F.shiftrightunsigned(names[p // BYTES], 8 * (p % BYTES))
        return word.bitwiseAND(F.lit(255))

    if wide:
        places = [(p, p % MINIMA, (p + d) % MINIMA) for d in MINIMA_APART for p in range(BYTES * len(names))]
        keys = [F.xxhash64(F.lit(n), byte(p), minima[i], minima[j]) for n, (p, i, j) in enumerate(places)]
    else:
        keys = [
            # The set's number, then its bytes.
            sum((byte(p) * F.lit(1 << (8 * i)) for i, p in enumerate(s)), F.lit(n << 56).cast("long"))
            for n, s in enumerate(position_sets(max_bits))
        ]
    posted = distinct.select("node", F.explode(F.array(*keys)).alias("list"))
    # Lists of one member say nothing.  Only lists that exceed a chunk are cut;
    # a list's chunks are dealt by hash.
    sized = posted.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("list"))).filter("n > 1")
    sized = sized.withColumn("chunks", F.ceil(F.col("n") / chunk).cast("int"))
    mine = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")
    # Units of work: chunk i with itself, and chunks i < j with each other.
    cell = F.explode(
        F.transform(
            F.sequence(F.lit(0), F.col("chunks") - 1),
            lambda other: F.struct(
                (F.least(F.col("mine"), other) * F.col("chunks") + F.greatest(F.col("mine"), other)).alias("unit"),
                F.when(F.col("mine") > other, 1).otherwise(0).alias("side"),
            ),
        )
    )
    work = sized.withColumn("mine", mine).select("list", "node", cell.alias("cell"))
    work = work.select("list", "cell.unit", "node", "cell.side")
    work = work.join(distinct.select("node", *names), "node") if wide else work.withColumn("print", F.col("node"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = work.select("list", "unit", "node", *names, "side").repartition(parts, "list", "unit")
    dealt = dealt.sortWithinPartitions("list", "unit")
    return contracted(dealt.mapInArrow(_link_lists(max_bits, shared_bytes, names), "a long, b long"))


def components(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(node, root): the least node reachable over ``edges`` (a, b), for each
    node with an edge.

    Each round hooks a node, and the root it had, below the least root among
    its neighbours, then shortens paths; roots settle after about log2(size) rounds.
    Every round's rows are written to the shared checkpoint folder.  Roots of at most
    FEW_NODES nodes are broadcast; of more, the hub of a large group and its root
    are met by many rows (see :func:`hot_join`).
    """
    ways = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    both = stored(edges.select(F.explode(ways).alias("x")).select("x.a", "x.b").distinct())
    roots = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b"))
    roots = stored(roots.select("node", F.least("node", "b").alias("root")))
    few = roots.count() <= FEW_NODES
    hubs = [] if few else hot_keys(both, "b")

    def met(many: DataFrame, other: DataFrame, key: str, often: list | None = None) -> DataFrame:
        return many.join(F.broadcast(other), key) if few else hot_join(many, other, key, often)

    for _ in range(max_rounds):
        far = roots.select(F.col("node").alias("b"), F.col("root").alias("far"))
        near = met(both, far, "b", hubs).groupBy(F.col("a").alias("node")).agg(F.min("far").alias("far"))
        seen = near.join(F.broadcast(roots) if few else roots, "node")
        seen = seen.select("node", "root", F.least("root", "far").alias("best"))
        # A node's own row goes with the root that it had, the row for its root without.
        own, lead = (F.struct(F.col(n).alias("node"), was.alias("was")) for n, was in (("node", F.col("root")), ("root", F.lit(None).cast("long"))))
        hooks = seen.select(F.explode(F.array(own, lead)).alias("x"), "best").select("x.node", "x.was", "best")
        hooked = stored(hooks.groupBy("node").agg(F.min("best").alias("root"), F.max("was").alias("was")))
        up = hooked.select(F.col("node").alias("root"), F.col("root").alias("top"))
        after = stored(met(hooked, up, "root").select("node", F.col("top").alias("root"), "was"))
        roots = after.select("node", "root")
        if after.filter("root <> was").isEmpty():
            return roots
    raise RuntimeError(f"components have not settled after {max_rounds} rounds")


def _named(distinct: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component_id) of nodes with their ``first`` doc_id."""
    placed = distinct.join(components(edges), "node", "left").withColumn("root", F.coalesce("root", "node"))
    placed = stored(placed.select("node", "root", "first"))
    named = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    return hot_join(placed.select("node", "root"), named, "root").select("node", "component_id")


def groups(docs: DataFrame, words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """``doc_id``, ``fingerprint`` (long), ``component_id`` for every row of
    ``docs`` (needs ``doc_id``, ``text``).

    Fingerprints within ``max_bits`` bits are linked, and ``component_id`` is the
    least doc_id reachable over links, the row's own included.  Null and empty
    texts share fingerprint 0 and are linked like any others.  Rows without a
    doc_id belong to components but don't name them; a component of such rows
    alone has a null component_id.  Repeated rows stay; an empty table gives none.
    """
    prints = stored(fingerprints(docs.select("doc_id", "text"), words).select("doc_id", "fingerprint"))
    distinct = prints.groupBy("fingerprint").agg(F.min("doc_id").alias("first"))
    edges = links(distinct.select("fingerprint"), max_bits)
    of = _named(distinct.withColumnRenamed("fingerprint", "node"), edges).withColumnRenamed("node", "fingerprint")
    return hot_join(prints, of, "fingerprint").select("doc_id", "fingerprint", "component_id")


def shingle_sets(docs: DataFrame, wanted: DataFrame, words: int = WIDE_WORDS) -> DataFrame:
    """(``row``, ``shingles``) of those ``docs`` (needs ``row``, ``text``) whose row is
    in ``wanted``, and of a few others: the hashes of their distinct shingles.

    Rows are sifted by a bitmap of fixed size, which saves an exchange of all
    texts; the more rows are wanted, the more others come through.
    """
    spark = prepare(docs.sparkSession)
    places = wanted.select(F.pmod("row", F.lit(FILTER_BITS)).cast("int").alias("place"))
    ors = places.groupBy(F.shiftright("place", 3).alias("at")).agg(F.expr("bit_or(shiftleft(1, place & 7))").alias("bits"))
    told = ors.toArrow()  # at most FILTER_BITS / 8 rows
    bitmap = np.zeros(FILTER_BITS // 8, np.uint8)
    bitmap[told.column("at").to_numpy()] = told.column("bits").to_numpy().astype(np.uint8)
    shared = spark.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()
        for batch in batches:
            rows = batch.column("row").to_numpy()
            places = rows % FILTER_BITS
            wanted = (shared.value[places >> 3] >> (places & 7) & 1).astype(bool)
            once = np.zeros(len(rows), bool)
            once[np.unique(rows, return_index=True)[1]] = True
            batch = batch.filter(pa.array(wanted & once))
            sets = [set_of(x, words) for x in text_bytes(batch.column("text"))]
            ends = pa.array(np.cumsum([0, *map(len, sets)]), pa.int32())
            flat = np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64)
            lists = pa.ListArray.from_arrays(ends, pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column("row"), lists], ["row", "shingles"])

    return docs.select("row", "text").mapInArrow(run, "row long, shingles array<long>")


def _joined_sets(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """A label for each set, equal for those joined by pairs of at least this
    Jaccard similarity."""
    n = len(sets)
    label = np.arange(n)
    sizes = np.array([len(x) for x in sets])
    _, index = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(index, kind="stable")
    holders = np.repeat(np.arange(n), sizes)[order]
    many = np.bincount(index)
    begins = np.cumsum(many) - many
    ends = np.cumsum(sizes)
    for i in range(n - 1):
        others = (label != label[i]) & (np.minimum(sizes, sizes[i]) >= similarity * np.maximum(sizes, sizes[i]))
        others[: i + 1] = False
        if not others.any():
            continue
        mine = index[ends[i] - sizes[i] : ends[i]]
        mine = mine[many[mine] > 1]
        # The places of all holders of these shingles.
        counts = many[mine]
        places = np.arange(counts.sum()) + np.repeat(begins[mine] - (np.cumsum(counts) - counts), counts)
        common = np.bincount(holders[places], minlength=n)
        near = others & (common >= similarity * (sizes + sizes[i] - common))
        if near.any():
            met = np.unique(np.append(label[near], label[i]))
            label[np.isin(label, met)] = met[0]
    return label


def alike(members: DataFrame, sets: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Links (a, b) between nodes of one group whose sets of shingles have at least
    this Jaccard similarity, enough of them to join what all such links would.

    ``members``: ``node``, ``root`` (its group), ``row`` and ``size``, the number of its
    shingles; ``sets``: ``row``, ``shingles``.  All pairs of a group are compared, in
    chunks if it is large: each pair of chunks is a task's unit of work.
    """
    spark = prepare(members.sparkSession)
    cut = F.ceil(F.greatest(F.count(F.lit(1)) / CHUNK, F.sum("size") / SET_CHUNK)).cast("int")
    longer = members.groupBy("root").agg(cut.alias("chunks")).filter("chunks > 1")
    sized = hot_join(members, longer, "root", how="left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    sized = sized.withColumn("mine", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    # Chunks i < j with each other, which compares each of them with itself too.
    others = F.filter(F.sequence(F.lit(0), F.col("chunks") - 1), lambda x: (x != F.col("mine")) | (F.col("chunks") == 1))
    unit = F.transform(others, lambda x: F.least(F.col("mine"), x) * F.col("chunks") + F.greatest(F.col("mine"), x))
    work = sets.join(sized.select("row", "node", "root", unit.alias("units")), "row")
    work = work.select("root", F.explode("units").alias("unit"), "node", "shingles")

    def links_of(nodes: list[int], sets: list[np.ndarray]) -> np.ndarray:
        label = _joined_sets(sets, similarity)
        found = np.array(nodes, np.int64)
        order = np.lexsort((found, label))
        found, label = found[order], label[order]
        first = np.r_[True, label[1:] != label[:-1]]
        least = found[np.maximum.accumulate(np.where(first, np.arange(len(found)), 0))]
        return np.stack((least[~first], found[~first]), axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()
        now, nodes, sets = None, [], []

        def emit() -> pa.RecordBatch:
            pairs = links_of(nodes, sets) if len(nodes) > 1 else np.zeros((0, 2), np.int64)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

        # A unit can go over into the next batch, so its rows so far are held.
        for batch in batches:
            shingles = batch.column("shingles")
            ends, flat = shingles.offsets.to_numpy(), shingles.values.to_numpy()
            keys = zip(*(batch.column(n).to_pylist() for n in ("root", "unit", "node")), strict=True)
            for k, (root, unit, node) in enumerate(keys):
                if (root, unit) != now:
                    if len(nodes) > 1:
                        yield emit()
                    now, nodes, sets = (root, unit), [], []
                elif node == nodes[-1]:
                    continue  # a row that the table has more than once
                nodes.append(node)
                sets.append(flat[ends[k] : ends[k + 1]].copy())
        yield emit()

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = work.repartition(parts, "root", "unit").sortWithinPartitions("root", "unit", "node")
    return contracted(dealt.mapInArrow(run, "a long, b long"))


def keep_one(docs: DataFrame, words: int = WIDE_WORDS, similarity: float = SIMILARITY, width: int = WIDTH) -> DataFrame:
    """One row of ``docs`` for each group of texts: that with the least doc_id, or,
    where several rows of the group share it, any one of these.  Of a group in
    which no row has a doc_id, one row stays.  Groups are closed over links between
    texts whose sets of shingles have at least this Jaccard similarity.  Null and
    empty texts form one group.  Other columns pass untouched, but for one named
    ``__row``, which is not allowed; an empty table gives no rows."""
    prints, minima = [f"f{k}" for k in range(width)], [f"m{k}" for k in range(MINIMA)]
    told = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    told = told.withColumn("row", F.xxhash64("doc_id", "text"))
    printed = wide_fingerprints(told, words, width)
    rows = stored(printed.select("doc_id", "row", *(F.col(f"__{n}").alias(n) for n in ("node", "size", *prints, *minima))))
    # Rows without a doc_id come last; equal rows have the same ``row``.
    lead = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row")
    firsts = (F.first(n).alias(n) for n in ("size", *prints, *minima))
    distinct = stored(rows.groupBy("node").agg(F.min(lead).alias("lead"), *firsts).withColumn("row", F.col("lead.row")))
    found = distinct.select("node", *prints, *minima)
    near = links(found, bits_for(similarity, 64 * width), CHUNK, prints, minima, WIDE_SHARED)
    members = stored(distinct.select("node", "row", "size").join(components(near), "node"))
    edges = alike(members, shingle_sets(told, members.select("row"), words), similarity)
    placed = distinct.select("node", "lead").join(components(edges), "node", "left")
    leads = placed.groupBy(F.coalesce("root", "node")).agg(F.min("lead").alias("lead"))
    leads = stored(leads.select(F.col("lead.row").alias("__row")))
    marked = docs.withColumn("__row", F.xxhash64("doc_id", F.col("text").cast("string")))
    # Rows that the table has over and over are met apart from the others.
    often = hot_keys(rows.select(F.col("row").alias("__row")), "__row")
    cold = marked.filter(~F.col("__row").isin(often)) if often else marked
    kept = cold.join(leads, "__row", "left_semi").dropDuplicates(["__row"])
    if often:
        hot = marked.filter(F.col("__row").isin(often)).join(F.broadcast(leads.filter(F.col("__row").isin(often))), "__row", "left_semi")
        kept = kept.unionByName(hot.dropDuplicates(["__row"]))
    return kept.select(*docs.columns)
