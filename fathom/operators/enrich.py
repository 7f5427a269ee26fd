"""Contracts for models that come from outside: enrichment and embedding.

A model is a Python function over a list of texts, called once per Arrow batch in
the workers; where none is given, a deterministic offline one stands in.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIMENSIONS = 64
# Sizes in characters and words.
SUMMARY_CHARS = 240
KEYWORDS = 8


def hashed_embedding(texts: list[str]) -> list[list[float]]:
    """Word counts hashed into a fixed number of signed dimensions, of length 1."""
    out = []
    for text in texts:
        v = [0.0] * DIMENSIONS
        for w in re.findall(r"\w+", text.lower()):
            d = hashlib.blake2b(w.encode(), digest_size=8).digest()
            v[d[0] % DIMENSIONS] += 1.0 if d[1] & 1 else -1.0
        norm = math.sqrt(sum(x * x for x in v)) or 1.0
        out.append([x / norm for x in v])
    return out


def head_summary(texts: list[str]) -> list[dict]:
    """The first sentence or so, and the most frequent long words."""
    out = []
    for text in texts:
        words = re.findall(r"\w{4,}", text.lower())
        count = Counter(words)
        often = sorted(count, key=lambda w: (-count[w], w))[:KEYWORDS]
        out.append({"summary": " ".join(text.split())[:SUMMARY_CHARS], "keywords": often})
    return out


def embed(rows: DataFrame, text: str, model: Callable[[list[str]], list[list[float]]] = hashed_embedding) -> DataFrame:
    """``rows`` with ``embedding``; null for empty texts.  A model that returns
    another number of results than it got texts fails the job."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            texts = column.to_pylist()
            asked = [i for i, t in enumerate(texts) if t]
            found = model([texts[i] for i in asked]) if asked else []
            if len(found) != len(asked):
                raise ValueError(f"the model gave {len(found)} embeddings for {len(asked)} texts")
            out: list = [None] * len(texts)
            for i, v in zip(asked, found, strict=True):
                out[i] = v
            yield pa.array(out, pa.list_(pa.float32()))

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return rows.withColumn("embedding", F.arrow_udf(run, "array<float>").asNondeterministic()(F.col(text)))


def enrich(rows: DataFrame, text: str, model: Callable[[list[str]], list[dict]] = head_summary) -> DataFrame:
    """``rows`` with ``enriched``: summary, keywords (at most KEYWORDS), error.  If
    the model fails on a batch, its texts are tried one by one, so that only those
    that fail carry an error."""
    kind = "struct<summary:string,keywords:array<string>,error:string>"
    arrow = pa.struct([("summary", pa.string()), ("keywords", pa.list_(pa.string())), ("error", pa.string())])

    def told(results: list[dict]) -> list[dict]:
        return [{"summary": r["summary"], "keywords": list(r["keywords"])[:KEYWORDS], "error": None} for r in results]

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            texts = [t or "" for t in column.to_pylist()]
            try:
                out = told(model(texts))
                if len(out) != len(texts):
                    raise ValueError(f"the model gave {len(out)} results for {len(texts)} texts")
            except Exception:
                out = []
                for t in texts:
                    try:
                        out += told(model([t]))
                    except Exception as e:
                        out.append({"summary": None, "keywords": None, "error": f"{type(e).__name__}: {e}"})
            yield pa.array(out, arrow)

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return rows.withColumn("enriched", F.arrow_udf(run, kind).asNondeterministic()(F.col(text)))


def with_enrichment(rows: DataFrame, results: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``rows`` with what a model said of them: columns of ``results`` by key, null where
    it said nothing.  Results for keys that aren't there are ignored; of several for
    one key the least counts."""
    told = results.groupBy(key).agg(F.min(F.struct(*columns)).alias("__told"))
    kept = rows.drop(*(c for c in columns if c in rows.columns))
    return kept.join(told, key, "left").select(*kept.columns, *(F.col(f"__told.{c}").alias(c) for c in columns))


def transcribe(rows: DataFrame, content: str, models: dict[str, Callable[[bytes], dict]], into: str = "transcript") -> DataFrame:
    """``rows`` with a struct ``into``: text, model, seconds, cost_usd, warnings, error.

    ``models`` are tried in order on each stretch of sound until one gives a dict with a
    text; what went wrong before is a warning, and if all fail that is the error.  They
    come from outside and run in the workers."""
    arrow = pa.struct(
        [
            ("text", pa.string()),
            ("model", pa.string()),
            ("seconds", pa.float64()),
            ("cost_usd", pa.float64()),
            ("warnings", pa.list_(pa.string())),
            ("error", pa.string()),
        ]
    )

    def one(data: bytes | None) -> dict:
        wrong: list[str] = []
        for name, model in models.items():
            try:
                told = model(data or b"")
                return {"text": told["text"], "model": name, "seconds": told.get("seconds"), "cost_usd": told.get("cost_usd"), "warnings": wrong}
            except Exception as e:
                wrong = [*wrong, f"{name}: {type(e).__name__}: {e}"]
        return {"warnings": wrong, "error": "; ".join(wrong) or "no model"}

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            yield pa.array([one(x) for x in column.to_pylist()], arrow)

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    kind = "struct<text:string,model:string,seconds:double,cost_usd:double,warnings:array<string>,error:string>"
    return rows.withColumn(into, F.arrow_udf(run, kind).asNondeterministic()(F.col(content)))
