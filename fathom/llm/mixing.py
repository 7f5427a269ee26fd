"""Mixing sources to target weights by systematic sampling (native).

Each source gets a target number of words.  A document's expected number of
copies is ``target / source_size``; documents of a source stand in a fixed
order, their expected copies are summed up along it, one offset per source is
added, and a document is emitted once for each integer that its step crosses.

The running sum needs no task that holds a whole source: documents are dealt
into (source, size class, slot) cells, cells are counted by a partial
aggregation, and only the counts are summed along the order.  As the expected
copies of all documents in a source are equal, the sum is a rank times that
number, exact in integers until the last step.  Standing in order of size
makes the sampling stratified, so the words taken stay near the target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathom.llm.common import WORD, stored

#: Weights of the sources in code point order, repeating.
WEIGHTS = (5, 2, 1)
#: No document is emitted more often than this, and no target exceeds it.
MAX_REPEATS = 3
#: Cells per source and size class; even a source of 1e10 documents has cells
#: of about a million narrow rows.
SLOTS = 256
SEED = "mix-1"


def word_count(text: str = "text") -> Column:
    """Number of words; null counts as none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def size_class(size: Column) -> Column:
    """Four classes an octave, in integers, ascending with the size."""
    bits = F.length(F.bin(size))
    lead = F.greatest(bits - 3, F.lit(0))
    return (bits * 4 + F.call_function("shiftright", size, lead.cast("int")) % 4).cast("int")


def targets(sizes: DataFrame, weights=WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """Targets of the sources.

    ``sizes`` has one row per source: ``source`` (null allowed), ``source_size``.
    Result: those and ``target`` double.  Targets share the sum of all sizes by
    weight, stop at ``max_repeats`` times the source's size, and the excess is
    shared again by weight until none is above.  That fixed point has a closed
    form: in ascending order of ``max_repeats * size / weight`` a prefix of the
    sources is capped, and the rest share what is left by weight.  The table
    has a row per source, never per document.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    k = (F.row_number().over(by_name) - 1) % len(weights) + 1
    cap = F.col("source_size") * max_repeats
    ranked = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), k)).withColumn("cap", cap)
    ratio = F.col("cap") / F.col("weight")
    by_ratio = Window.orderBy(ratio, F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    left = F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    left_w = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    leveled = ranked.withColumn("level", left / left_w).withColumn("place", F.row_number().over(by_ratio))
    # The first source that stays under its cap fixes the level for all after it.
    free = F.when(F.col("level") <= ratio, F.struct("place", "level"))
    first_free = F.min(free).over(whole)
    level = first_free["level"]
    target = F.when(
        level.isNull() | (F.col("cap") <= F.col("weight") * level), F.col("cap").cast("double")
    ).otherwise(F.col("weight") * level)
    return leveled.select("source", "source_size", target.alias("target"))


def mix(
    docs: DataFrame,
    size: Column | None = None,
    weights=WEIGHTS,
    max_repeats: int = MAX_REPEATS,
    seed: str = SEED,
) -> DataFrame:
    """Every row of ``docs`` with ``size``, ``source_size``, ``target``,
    ``copies`` (how often the mix takes the row) and ``taken`` (words taken).

    Needs ``doc_id``, ``text``, ``source``; other columns pass, and columns of
    the names above are replaced.  Null text has size 0; null sources form one
    source, last in order; null ids are allowed.  Rows stand in order of a digest of
    id and text, so rows that share an id, or have none, are dealt out like others.
    Repeated rows are separate rows (which of two equal rows is emitted cannot be
    told apart).
    A source without words has target 0 and no copies.  An empty table gives no
    rows.  Equal input gives equal output, whatever the partitioning.
    """
    made = {"size", "source_size", "target", "copies", "taken"}
    kept = [c for c in docs.columns if c not in made]
    cell = ["__source", "__class", "__slot"]
    text_key = F.coalesce(F.md5(F.col("text").cast("binary")), F.lit(""))
    key = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(seed), text_key))
    rows = docs.withColumn("__size", word_count() if size is None else size).select(
        *kept,
        "__size",
        key.alias("__key"),
        # Null is a source of its own; joins below need a plain, non-null key.
        F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("s"), "source")).alias("__source"),
        size_class(F.col("__size")).alias("__class"),
    )
    rows = rows.withColumn("__slot", F.conv(F.substring("__key", 1, 2), 16, 10).cast("int") % SLOTS)

    # Cells are counted once: at most SLOTS for each source and size class.
    cells = stored(rows.groupBy(*cell).agg(F.count(F.lit(1)).alias("__n"), F.sum("__size").alias("__words")))
    classes = cells.groupBy("__source", "__class").agg(F.sum("__n").alias("__n"), F.sum("__words").alias("__words"))
    sizes = classes.groupBy("__source").agg(F.sum("__words").alias("source_size"))
    named = sizes.withColumn("source", F.when(F.col("__source") != "n", F.substring("__source", 2, 1 << 30)))
    shares = targets(named, weights, max_repeats)
    shares = shares.withColumn("__source", F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("s"), "source")))

    def running(over) -> Column:
        return F.coalesce(F.sum("__n").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    by_class = Window.partitionBy("__source").orderBy("__class")
    by_slot = Window.partitionBy("__source", "__class").orderBy("__slot")
    of_class = classes.select("__source", "__class", running(by_class).alias("__classes"))
    of_cell = cells.select(*cell, running(by_slot).alias("__cells"))
    bounds = (
        of_cell.join(of_class, ["__source", "__class"])
        .join(shares.drop("source"), "__source")
        .select(*cell, (F.col("__classes") + F.col("__cells")).alias("__before"), "source_size", "target")
    )
    within = Window.partitionBy(*cell).orderBy("__size", "__key")
    joined = rows.withColumn("__rank", F.row_number().over(within)).join(bounds, cell)
    rank = F.col("__before") + F.col("__rank")
    per_row = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    digest = F.md5(F.concat(F.coalesce(F.col("source"), F.lit("\0null")), F.lit("/" + seed)))
    offset = F.conv(F.substring(digest, 1, 5), 16, 10).cast("long") / F.lit(1 << 20)
    crossed = F.floor(rank * per_row + offset) - F.floor((rank - 1) * per_row + offset)
    copies = F.least(crossed, F.lit(max_repeats).cast("long"))
    return joined.select(
        *kept,
        F.col("__size").alias("size"),
        "source_size",
        "target",
        copies.alias("copies"),
        (copies * F.col("__size")).alias("taken"),
    )


def emit(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as :func:`mix` takes it,
    with the columns of ``docs``.  Columns named like those that ``mix`` adds are not
    allowed, nor is ``__copy``; an empty table gives no rows."""
    mixed = mix(docs, **how)
    times = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))
    return mixed.filter(F.col("copies") > 0).select(*docs.columns, times.alias("__copy")).select(*docs.columns)
