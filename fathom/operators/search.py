"""Retrieval: vector top-k with paging, merging of modalities, hydration, lookups."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.functions.scalars import cosine_distance

MOST_HITS = 20


def bounds(limit: int = 5, offset: int = 0, top_k: int | None = None) -> tuple[int, int]:
    """Limit (``top_k`` wins) in 1..20 and offset from 0 on."""
    limit = limit if top_k is None else top_k
    return max(1, min(MOST_HITS, int(limit))), max(0, int(offset))


def scored(vectors: DataFrame, query: list[float], vector: str = "embedding", digits: int | None = None) -> DataFrame:
    """``vectors`` with ``score``, the cosine distance to ``query``."""
    score = cosine_distance(vector, query)
    return vectors.withColumn("score", score if digits is None else F.round(score, digits))


def top(hits: DataFrame, order: list[str | Column], limit: int, offset: int = 0) -> DataFrame:
    """Rows ``offset`` to ``offset + limit`` in order; one top-k per partition,
    then one over their results."""
    ranked = hits.orderBy(*order)
    return (ranked.offset(offset) if offset else ranked).limit(limit)


@dataclass
class Page:
    results: list
    next_offset: int | None
    has_more: bool


def page(hits: DataFrame, order: list[str | Column], limit: int = 5, offset: int = 0) -> Page:
    """A page as plain rows, at most 20; one row more is asked for to see whether
    there is a next page."""
    limit, offset = bounds(limit, offset)
    rows = top(hits, order, limit + 1, offset).collect()
    more = len(rows) > limit
    return Page(rows[:limit], offset + limit if more else None, more)


def merged_top(branches: dict[str, DataFrame], ids: list[str], limit: int, offset: int = 0) -> DataFrame:
    """The best hits of all modalities.  Each branch is cut to ``limit + offset``
    rows before the union; ties go by modality, then by ``ids``."""
    cut = [
        top(hits.withColumn("modality", F.lit(name)), ["score", *ids], limit + offset)
        for name, hits in sorted(branches.items())
    ]
    return top(reduce(DataFrame.unionByName, cut), ["score", "modality", *ids], limit, offset)


def hydrate(hits: DataFrame, children: DataFrame, files: DataFrame, child_id: str, source_id: str) -> DataFrame:
    """Hits with the columns of their child row and its file.  Hits whose child is
    gone drop; files that are no longer present drop too."""
    return hits.join(children, child_id).join(present(files), source_id)


def present(files: DataFrame) -> DataFrame:
    """Files that were there in the last run, as far as that is known."""
    return files.filter(F.col("is_present")) if "is_present" in files.columns else files


def first_by_priority(candidates: list[DataFrame], key: str, before: list[Column] = ()) -> DataFrame:
    """One row per key: the least by ``before``, then from the first frame that has
    it; frames have equal columns."""
    numbered = [c.withColumn("__priority", F.struct(*before, F.lit(i))) for i, c in enumerate(candidates)]
    every = reduce(DataFrame.unionByName, numbered)
    others = [c for c in every.columns if c not in (key, "__priority")]
    best = every.groupBy(key).agg(F.min(F.struct("__priority", *others)).alias("best"))
    return best.select(key, *(F.col(f"best.{c}").alias(c) for c in others))


def pattern(text: str) -> str:
    """A pattern for what holds ``text``: ``%`` and ``_`` in it are wildcards, and a
    backslash makes the next character (at the end: the pattern's own ``%``) stand for itself."""
    return re.sub(r"\\(.)", lambda m: m[0] if m[1] in "%_\\" else m[1], f"%{text}%", flags=re.S)


def holds(column: str | Column, text: str) -> Column:
    """Whether the column holds ``text`` in any case (see :func:`pattern`); false for null."""
    held = F.col(column) if isinstance(column, str) else column
    return F.coalesce(held.ilike(pattern(text)), F.lit(False))


def lexical(rows: DataFrame, column: str, text: str, order: list[str], limit: int = 5) -> DataFrame:
    """The first rows whose column holds ``text`` in any case."""
    return top(rows.filter(holds(column, text)), order, limit)
