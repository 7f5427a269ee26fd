"""Document fingerprints from closed syncmers (native).

The text is a sequence of pieces of two or three characters, cut by what stands
there (see ``PIECE``), not by place.  A window of ``K`` pieces is an anchor if the
smallest hash among its inner windows of ``S`` pieces is the first or the last of
them.  That depends on the window alone, so an edit changes only the anchors that
overlap it, and equal passages have equal anchors wherever they stand; of K - S
consecutive windows at least one is an anchor.  A fingerprint is the anchors'
hashes in order of place.  Two fingerprints are alike in so far as they have
anchors in common and these stand in the same order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathom.llm.common import hot_keys, prepare, text_or_empty

K = 6
S = 2
#: A vowel, an even digit or any character beyond ASCII ends a piece; white space
#: stands between pieces.  So a piece begins and ends in the same places whatever
#: stands around it, and scripts without blanks have a piece per character.  Only
#: runs of over LONGEST other signs are cut by their length.
ENDS = r"aeiouyAEIOUY02468\x{80}-\x{10FFFF}"
LONGEST = 24
OTHERS = rf"[^\x20\x09-\x0D{ENDS}]"
PIECE = rf"{OTHERS}{{0,{LONGEST}}}[{ENDS}]|{OTHERS}{{1,{LONGEST}}}"
#: Documents per bucket of neighbours; quantiles of the ids that are looked up.
BUCKET = 256
QUANTILES = 64
#: Rows of one crowded id are dealt to so many (as a power of 2) buckets.
TIE_BITS = 10


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with ``value`` evaluated once."""
    return F.transform(F.array(value), use)[0]


def anchors(text: Column) -> Column:
    """array<long>: the anchors' 32-bit hashes, in order of place.

    A text too short for a window, or whose windows are no anchors, has the hash
    of its whole sequence of pieces; one without any (also null) has none.
    """
    pieces = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PIECE), F.lit(0))
    inner = K - S  # places of the last inner window after the first

    def short(h: Column) -> Column:
        return F.pmod(h, F.lit(1 << 32))

    def of_pairs(pairs: Column) -> Column:
        def window(i: Column) -> Column:
            at = [F.get(pairs, i + j) for j in range(inner + 1)]
            edge = F.least(at[0], at[-1]) <= F.least(*at[1:-1])
            return F.when(edge, short(F.xxhash64(*at[::S])))

        last = F.size(pairs) - inner - 1
        places = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
        return F.filter(F.transform(places, window), lambda x: x.isNotNull())

    def of_pieces(w: Column) -> Column:
        n = F.size(w)
        pairs = F.when(
            n > 1, F.zip_with(F.slice(w, F.lit(1), n - 1), F.slice(w, F.lit(2), n - 1), lambda a, b: F.xxhash64(a, b))
        ).otherwise(F.array().cast("array<bigint>"))
        whole = F.when(n > 0, F.array(short(F.xxhash64(w)))).otherwise(F.array().cast("array<bigint>"))
        return let(let(pairs, of_pairs), lambda found: F.when(F.size(found) > 0, found).otherwise(whole))

    return let(pieces, of_pieces)


def fingerprint(found: Column) -> Column:
    """The anchors as text, eight hexadecimal digits each."""
    return F.array_join(F.transform(found, lambda x: F.lower(F.lpad(F.hex(x), 8, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """Twice the anchors in common by those of both (each counted once, at its first
    place); 1 for two texts without words.

    Of c anchors in common, one that is the i-th of these in one text and the j-th in
    the other counts as 1 - abs(i - j) / c: fully if they stand in the same order,
    whatever was put between them, and half if passages have changed places.
    """

    def ranked(found: Column) -> Column:
        return F.array_sort(F.transform(found, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))

    def score(s: Column) -> Column:
        # Both hold the same hashes, so in order of hash they stand side by side.
        steps = F.zip_with(ranked(s["a"]), ranked(s["b"]), lambda x, y: F.abs(x["i"] - y["i"]).cast("long"))
        moved = F.aggregate(steps, F.lit(0).cast("long"), lambda total, x: total + x)
        c = F.size(s["a"])
        return F.when(s["n"] == 0, 1.0).when(c == 0, 0.0).otherwise(2.0 * (c - moved / c) / s["n"])

    def common(s: Column) -> Column:
        n = F.size(s["a"]) + F.size(s["b"])
        both = (F.array_intersect(s[x], s[y]).alias(x) for x, y in ("ab", "ba"))
        return let(F.struct(*both, n.alias("n")), score)

    return let(F.struct(F.array_distinct(a).alias("a"), F.array_distinct(b).alias("b")), common)


def _bucketed(docs: DataFrame) -> DataFrame:
    """``docs`` with ``__tie``, ``__range`` and ``__bucket``; the three ascend with
    (doc_id, ``__tie``), a hash of the text by which rows of one doc_id stand in order.

    Ranges end at quantiles of the ids (a fixed number, held by the driver), and
    each is cut evenly, so that ids with gaps and crowds still make buckets of
    a few hundred documents.  Rows without a doc_id come last.  These, and those of
    the most frequent ids, which have ranges of their own, are cut by ``__tie``.
    """
    often = [int(i) for i in hot_keys(docs.filter("doc_id is not null"), "doc_id")]
    parts = [i / QUANTILES for i in range(1, QUANTILES)]
    seen = docs.agg(
        F.percentile_approx("doc_id", parts, 10_000), F.min("doc_id"), F.max("doc_id"), F.count("doc_id")
    ).head()
    bounds = {int(x) for x in seen[0] or []} | ({int(seen[1])} if seen[1] is not None else set())
    top = seen[2] if seen[2] is not None else 0
    low = sorted(bounds | {x for i in often for x in (i, i + 1) if x <= top}) or [0]
    high = [*low[1:], top + 1]
    cuts = max(1, -(-seen[3] // (BUCKET * len(low))))
    lows, highs = F.array(*map(F.lit, low)), F.array(*map(F.lit, high))
    span = F.when(F.col("doc_id").isNull(), len(low)).otherwise(F.size(F.filter(lows, lambda x: x <= F.col("doc_id"))) - 1)
    ranged = docs.withColumn("__range", span).withColumn("__tie", F.xxhash64("text"))
    lo, hi = (F.get(x, F.col("__range")).cast("double") for x in (lows, highs))
    part = F.least(F.floor((F.col("doc_id") - lo) * cuts / (hi - lo)), F.lit(cuts - 1))
    slot = F.shiftright("__tie", 64 - TIE_BITS) + F.lit(1 << (TIE_BITS - 1))
    crowd = F.col("doc_id").isNull() | (F.col("doc_id").isin(often) if often else F.lit(False))
    even = F.col("__range").cast("long") * cuts + F.coalesce(part, F.lit(0))
    bucket = even * (1 << TIE_BITS) + F.when(crowd, slot).otherwise(0)
    return ranged.withColumn("__bucket", bucket)


def with_next(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``text``, ``anchors``, ``next_text``, ``next_anchors`` of every
    row: next in ascending order of doc_id, after the last the first.

    Neighbours are found inside buckets; the last row of a bucket takes the first
    of the next bucket that has rows.  Texts go through one exchange.  Null
    texts are empty; rows of equal doc_id stand in order of a hash of their texts;
    rows without doc_id come last; a single row is its own next.
    """
    prepare(docs.sparkSession)
    rows = _bucketed(docs.select("doc_id", text_or_empty().alias("text")))
    order = Window.partitionBy("__range", "__bucket").orderBy("doc_id", "__tie", "text")
    placed = rows.withColumn("__n", F.row_number().over(order)).withColumn("next_text", F.lead("text").over(order))
    led = placed.withColumn("anchors", anchors(F.col("text"))).withColumn("next_anchors", F.lead("anchors").over(order))

    firsts = placed.filter("__n = 1").select("__range", "__bucket", F.col("text").alias("first_text"))
    after = F.lead("__bucket").over(Window.partitionBy("__range").orderBy("__bucket"))
    buckets = placed.filter("__n = 1").select("__range", "__bucket", after.alias("__after"))
    # One row per range, a fixed number of them.
    ranges = buckets.groupBy("__range").agg(F.min("__bucket").alias("__first"))
    every = Window.partitionBy()
    ranges = ranges.select(
        F.col("__range").alias("__r"),
        F.coalesce(F.lead("__first").over(Window.orderBy("__range")), F.min("__first").over(every)).alias("__wrap"),
    )
    turn = buckets.join(ranges, F.col("__range") == F.col("__r")).select(
        F.col("__range").alias("__r"), F.col("__bucket").alias("__b"), F.coalesce("__after", "__wrap").alias("__to")
    )
    carried = turn.join(firsts, F.col("__to") == F.col("__bucket")).select(
        "__r", "__b", "first_text", anchors(F.col("first_text")).alias("first_anchors")
    )
    last = F.col("next_text").isNull()
    joined = led.join(
        carried, (F.col("__range") == F.col("__r")) & (F.col("__bucket") == F.col("__b")) & last, "left"
    )
    return joined.select(
        "doc_id",
        "text",
        "anchors",
        F.coalesce("next_text", "first_text").alias("next_text"),
        F.coalesce("next_anchors", "first_anchors").alias("next_anchors"),
    )


def edited(text: Column, next_text: Column) -> Column:
    """``text`` with its last half replaced by as much of the start of ``next_text``."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(next_text, F.lit(1), half))


def compare(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and the likeness of the
    first to the second and to the next document's (see :func:`with_next`).

    Needs ``doc_id`` and ``text``; other columns play no part.  Texts without
    words have the empty fingerprint, which is like itself only.  Repeated rows
    are neighbours of each other; an empty table gives no rows.  Rows that share a
    doc_id, or have none, are told apart by their texts and spread over buckets.
    """
    pairs = with_next(docs).withColumn("edited_text", edited(F.col("text"), F.col("next_text")))
    pairs = pairs.withColumn("edited_anchors", anchors(F.col("edited_text")))
    return pairs.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited_text").cast("binary"), 256).alias("edited_sha256"),
        fingerprint(F.col("anchors")).alias("fingerprint"),
        fingerprint(F.col("edited_anchors")).alias("edited_fingerprint"),
        likeness(F.col("anchors"), F.col("edited_anchors")).alias("near_edited"),
        likeness(F.col("anchors"), F.col("next_anchors")).alias("near_next"),
    )
