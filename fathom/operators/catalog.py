"""The catalog: incremental snapshots of what the lake holds.

A snapshot is a DataFrame; every operation makes a new one from the old one and
a scan or a parse, in one join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def same_object(old: str = "old", new: str = "new") -> Column:
    """An object's row still describes it: identified, equal size and version, and
    equal etag, or, where one has none, equal and known time of change."""
    o, n = (lambda c: F.col(f"{old}.{c}")), (lambda c: F.col(f"{new}.{c}"))
    by_tag = F.when(o("etag").isNotNull() & n("etag").isNotNull(), o("etag") == n("etag"))
    by_time = F.coalesce(o("last_modified") == n("last_modified"), F.lit(False))
    same = (
        (o("status") == "identified")
        & o("size_bytes").eqNullSafe(n("size_bytes"))
        & o("version_id").eqNullSafe(n("version_id"))
        & F.coalesce(by_tag, by_time)
    )
    return F.coalesce(same, F.lit(False))


def same_file(old: str = "old", new: str = "new") -> Column:
    """An indexed file is unchanged: status indexed, equal size and time."""
    o, n = (lambda c: F.col(f"{old}.{c}")), (lambda c: F.col(f"{new}.{c}"))
    same = (
        (o("status") == "indexed") & (o("size_bytes") == n("size_bytes")) & (o("last_modified") == n("last_modified"))
    )
    return F.coalesce(same, F.lit(False))


def with_outcome(scan: DataFrame, catalog: DataFrame, key: str, same: Column | None = None) -> DataFrame:
    """The scan with ``outcome``: new, changed or unchanged.  One left join."""
    joined = scan.alias("new").join(catalog.alias("old"), key, "left")
    test = same_file() if same is None else same
    known = F.col("old.status").isNotNull()
    outcome = F.when(~known, "new").when(test, "unchanged").otherwise("changed")
    return joined.select(*(F.col(key) if c == key else F.col(f"new.{c}") for c in scan.columns), outcome.alias("outcome"))


def counters(outcomes: DataFrame) -> DataFrame:
    """One row: how many were discovered, and how many of each outcome."""

    def n(kind: str) -> Column:
        return F.count_if(F.col("outcome") == kind)

    return outcomes.agg(
        F.count(F.lit(1)).alias("discovered"), *(n(k).alias(k) for k in ("new", "changed", "unchanged"))
    )


def upsert(old: DataFrame, new: DataFrame, key: str, keep: list[str] = (), first: list[str] = (), maps: list[str] = ()) -> DataFrame:
    """Rows of both.  A new row's columns win; those in ``keep`` stay where the new
    value is null, those in ``maps`` where it is empty, and those in ``first`` (when
    it was first seen) always."""

    def pick(c: str) -> Column:
        o, n = F.col(f"o.{c}"), F.col(f"n.{c}")
        if c in first:
            n = F.coalesce(o, n)
        elif c in keep:
            n = F.coalesce(n, o)
        elif c in maps:
            n = F.when(F.size(n) > 0, n).otherwise(F.coalesce(o, n))
        return F.when(F.col("__new"), n).otherwise(o).alias(c)

    both = old.alias("o").join(new.withColumn("__new", F.lit(True)).alias("n"), F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    both = both.withColumn("__new", F.coalesce(F.col("__new"), F.lit(False)))
    picked = [F.coalesce(F.col(f"n.{key}"), F.col(f"o.{key}")).alias(key) if c == key else pick(c) for c in old.columns]
    return both.select(*picked)


def replace_children(old: DataFrame, new: DataFrame, changed: DataFrame, key: str) -> DataFrame:
    """Children of changed sources are replaced; a source without new ones loses all."""
    return old.join(changed.select(key).distinct(), key, "left_anti").unionByName(new)


def under(prefix: str, column: str = "relative_path") -> Column:
    """The path is the prefix or lies below it; an empty prefix holds everything."""
    clean = prefix.replace("\\", "/").strip("/")
    if clean in ("", "."):
        return F.lit(True)
    return (F.col(column) == clean) | F.startswith(F.col(column), F.lit(clean + "/"))


def mark_missing(catalog: DataFrame, scan: DataFrame, key: str, prefix: str = "") -> DataFrame:
    """Rows under the prefix that the scan has not met become missing, whether
    they were indexed anew or skipped as unchanged."""
    met = scan.select(key).distinct().withColumn("__met", F.lit(True))
    gone = F.col("__met").isNull() & under(prefix, key) & F.col("is_present")
    marked = catalog.join(met, key, "left")
    changed = {
        "status": F.when(gone, "missing").otherwise(F.col("status")),
        "is_present": F.col("is_present") & ~gone,
    }
    return marked.select(*(changed[c].alias(c) if c in changed else F.col(c) for c in catalog.columns))


def save_errors(catalog: DataFrame, errors: DataFrame, key: str) -> DataFrame:
    """Files that failed get status error and the message; those that have no row yet
    get one, with what ``errors`` (key, error_message, any other columns of the catalog)
    tells of them.  What enrichment put into older rows stays."""
    failed = errors.withColumn("__failed", F.lit(True))
    both = catalog.alias("o").join(failed.alias("e"), F.col(f"o.{key}") == F.col(f"e.{key}"), "full_outer")
    broke = F.col("__failed").isNotNull()

    def pick(c: str) -> Column:
        old = F.col(f"o.{c}")
        new = F.col(f"e.{c}") if c in errors.columns else F.lit(None)
        if c == "status":
            return F.when(broke, "error").otherwise(old)
        if c == "is_present":
            return F.when(broke, True).otherwise(old)
        return F.when(broke, F.coalesce(new, old)).otherwise(old)

    return both.select(*(pick(c).alias(c) for c in catalog.columns))


def without_children_of(children: DataFrame, errors: DataFrame, key: str) -> DataFrame:
    """Children of files that failed go: what was parsed before is no longer true."""
    return children.join(errors.select(key).distinct(), key, "left_anti")


def to_parse(outcomes: DataFrame, force: bool = False) -> DataFrame:
    """The files that are parsed in this run: new and changed ones, all if forced."""
    return outcomes if force else outcomes.filter("outcome <> 'unchanged'")


def run_counts(outcomes: DataFrame, results: DataFrame, n_vectors: Column | None = None) -> DataFrame:
    """One row: discovered and unchanged files of ``outcomes``; indexed and error of
    ``results`` (status); and the sum of vectors written, if the results tell it."""
    found = outcomes.agg(F.count(F.lit(1)).alias("discovered"), F.count_if(F.col("outcome") == "unchanged").alias("unchanged"))
    done = results.agg(
        F.count_if(F.col("status") == "indexed").alias("indexed"),
        F.count_if(F.col("status") == "error").alias("error"),
        F.coalesce(F.sum(F.lit(0) if n_vectors is None else n_vectors), F.lit(0)).alias("vectors"),
    )
    return found.join(F.broadcast(done))  # one row each


def resume_answers(questions: DataFrame, answers: DataFrame, key: str = "id") -> DataFrame:
    """Every question with the answer it already has, or an empty one."""
    known = answers.select(key, F.col("answer").alias("__answer"))
    return questions.join(known, key, "left").withColumn("answer", F.coalesce("__answer", F.lit(""))).drop("__answer")
