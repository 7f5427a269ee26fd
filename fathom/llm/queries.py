"""Registered queries of the text operators, and SQL for those that SQL can express.

Each query is thin: an operator over its whole table, and digest columns.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.llm import (
    alignment,
    bpe,
    edit_counts,
    importance,
    kneser_ney,
    licenses,
    mixing,
    partenum,
    quality_rules,
    simhash,
    syncmers,
    toxicity,
    whitening,
)
from fathom.llm.common import table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Those that are aligned with each other.
TOKENIZERS = ("byte_bpe_50k.json", "piece_bpe_32k.model")


def op1_edit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document before and after three edits: words put in
    front, sixteen characters replaced in the middle, forty cut near the end."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    n = F.coalesce(F.length("text"), F.lit(0))

    def change(start, removed: int, inserted: str):
        return F.struct(
            start.cast("int").alias("start"), F.lit(removed).alias("removed"), F.lit(inserted).alias("inserted")
        )

    edits = F.array(
        change(F.lit(0), 0, "Revised draft. "),
        change(F.floor(n / 2), 16, " as edited, "),
        change(F.floor(n * 9 / 10), 40, ""),
    )
    path = public_tokenizers.path(VOCABULARY)
    counted = edit_counts.count_edits(docs.withColumn("edits", edits), path, public_tokenizers.PATTERN)
    kept = edit_counts.NUMBERS
    digest = F.sha2(F.col("counts.edited_text").cast("binary"), 256).alias("edited_sha256")
    return counted.select("doc_id", *(f"counts.{c}" for c in kept), digest)


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies")


def op3_closed_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.compare(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules.judge(docs).select("doc_id", "rules.*")


def op5_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    rows, _, least = importance.classify(docs, labels)
    return rows.select("doc_id", "log_weight", "gumbel_key", (F.col("gumbel_key") >= F.lit(least)).alias("kept"))


def op6_bpe_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(VOCABULARY)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    tokens = bpe.decode(bpe.encode(docs, path, public_tokenizers.PATTERN).drop("text"), path)
    joined = F.array_join(F.col("ids").cast("array<string>"), ",")
    return tokens.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(joined.cast("binary"), 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"),
    )


def op7_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 10 == 0
    docs = docs.withColumn("held_out", held_out)
    model = kneser_ney.train(docs.filter(~F.col("held_out")))
    scored = kneser_ney.score(docs, model).select("doc_id", "held_out", "lm.*")
    return scored.withColumn("train_tokens", F.lit(model.n_tokens).cast("long"))


def op8_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    scored = toxicity.predict(docs, toxicity.train(docs, labels)).select("doc_id", "toxicity.*")
    return scored.withColumnRenamed("flagged", "toxic")


def op9_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.groups(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"),
        "component_id",
    )


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = licenses.scan(docs).select("doc_id", F.explode("licenses").alias("found"))
    return found.select("doc_id", "found.*")


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    paths = (public_tokenizers.path(x) for x in TOKENIZERS)
    groups = F.col("alignment.groups")
    digest = F.when(groups == "", "").otherwise(F.sha2(groups.cast("binary"), 256)).alias("groups_sha256")
    aligned = alignment.align(docs, *paths).select("doc_id", digest, "alignment")
    found = alignment.count_links(aligned)
    names = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    return found.select("doc_id", *names)


def op12_partenum_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partenum.groups(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op13_svd_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    model = whitening.fit(vectors)
    rows = whitening.whiten(vectors, model).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    explained = [float(e / model.trace) for e in model.eigenvalues] if model else []
    told = [F.lit(e) for e in explained] or [F.lit(None).cast("double")]
    return rows.select(
        "vec_id",
        (F.col("at") + 1).cast("int").alias("component"),
        F.lit(model.n if model else None).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.element_at(F.array(*told), F.col("at") + 1).alias("explained"),
        F.lit(model.error if model else None).cast("double").alias("identity_error"),
    )


def queries() -> dict:
    return {
        "op1_edit_counts": op1_edit_counts,
        "op2_source_mix": op2_source_mix,
        "op3_closed_syncmers": op3_closed_syncmers,
        "op4_compression_bands": op4_compression_bands,
        "op5_importance_resampling": op5_importance_resampling,
        "op6_bpe_replay": op6_bpe_replay,
        "op7_kneser_ney": op7_kneser_ney,
        "op8_toxicity_chain": op8_toxicity_chain,
        "op9_simhash_groups": op9_simhash_groups,
        "op10_license_scan": op10_license_scan,
        "op11_token_alignment": op11_token_alignment,
        "op12_partenum_join": op12_partenum_join,
        "op13_svd_whitening": op13_svd_whitening,
    }


MIX_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '') || 'mix-1' || coalesce(md5(text), '')) AS k
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, ([5, 2, 1])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight,
             3 * source_size AS cap FROM s),
l AS (SELECT *, row_number() OVER (ORDER BY cap / weight, source NULLS LAST) AS place,
             (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT
             / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS level
      FROM w),
f AS (SELECT level FROM l WHERE level <= cap / weight ORDER BY place LIMIT 1),
t AS (SELECT source, source_size,
             CASE WHEN (SELECT level FROM f) IS NULL OR cap <= weight * (SELECT level FROM f)
                  THEN cap::DOUBLE ELSE weight * (SELECT level FROM f) END AS target
      FROM l),
c AS (SELECT *, length(bin(size)) * 4 + (size >> greatest(length(bin(size)) - 3, 0)::INT) % 4 AS class,
             ('0x' || k[1:2])::INT AS slot FROM d),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY class, slot, size, k) AS rank FROM c),
e AS (SELECT doc_id, size, source_size, target, rank,
             CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS per_row,
             ('0x' || md5(coalesce(r.source, chr(0) || 'null') || '/mix-1')[1:5])::BIGINT / 1048576 AS u
      FROM r JOIN t ON r.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       least(floor(rank * per_row + u) - floor((rank - 1) * per_row + u), 3)::BIGINT * size AS taken,
       least(floor(rank * per_row + u) - floor((rank - 1) * per_row + u), 3)::BIGINT AS copies
FROM e
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_source_mix": MIX_SQL}
