"""Queries of the training-data operators, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, exact_dedup, langid, mixing, near_dedup, packing, secrets, sharding, substring_dedup, token_files


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return secrets.scan_secrets(docs, secrets.sample_model(docs))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(_table(spark, sf_dir, "documents"), keep="max")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_files(_table(spark, sf_dir, "documents"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(_table(spark, sf_dir, "documents"))


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_table(spark, sf_dir, "embeddings"), k=20, every=20)


def op6_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.sharded(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text", "lang", langid.held_out().alias("held_out"))
    model = langid.fit(docs.filter("not held_out and doc_id is not null"))
    return langid.identify(docs.drop("lang"), model).select("doc_id", "held_out", "lang_pred", "score", "ambiguous")


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text")
    text = F.encode(F.coalesce("text", F.lit("")), "utf-8")
    return substring_dedup.remove_repeats(docs).select("doc_id", "n_sentences", "n_removed", "removed", F.sha2(text, 256).alias("clean_sha256"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (op1_secret_scan, op2_exact_dedup, op3_token_files, op4_best_fit_packing, op5_nearest_neighbours, op6_resharding, op7_mixing, op8_language_id, op9_near_dedup, op10_substring_dedup, pipeline)
    return {f.__name__: f for f in ops}


_WORDS = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"

OP2 = """
SELECT d.doc_id, max(d.doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       d.doc_id = max(d.doc_id) OVER same AS kept, sha256(coalesce(d.text, '')) AS text_sha256
FROM documents d WINDOW same AS (PARTITION BY coalesce(d.text, ''))
"""

OP7 = f"""
WITH base AS (
  SELECT doc_id, source, {_WORDS}::BIGINT AS size, md5('mix:' || coalesce(doc_id::VARCHAR, 'null')) AS q FROM documents),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM base GROUP BY source),
turns AS (
  SELECT source, source_size, source_size * 2.0::DOUBLE AS lim,
         [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight FROM sizes),
levels AS (
  SELECT *, least(sum(source_size) OVER () * 1.5::DOUBLE, sum(lim) OVER ()) AS budget,
         (least(sum(source_size) OVER () * 1.5::DOUBLE, sum(lim) OVER ()) - coalesce(sum(lim) OVER before, 0.0))
         / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0.0)) AS level
  FROM turns WINDOW before AS (ORDER BY lim / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (
  SELECT source, source_size, budget,
         CASE WHEN lim <= level * weight THEN lim ELSE max(CASE WHEN lim > level * weight THEN level END) OVER () * weight END AS target
  FROM levels),
queued AS (
  SELECT b.doc_id, b.size, b.q, t.source_size, t.target, t.budget,
         sum(b.size) OVER (PARTITION BY b.source ORDER BY b.q, b.doc_id, b.size ROWS UNBOUNDED PRECEDING)::BIGINT AS upto
  FROM base b JOIN targets t ON b.source IS NOT DISTINCT FROM t.source),
copies AS (
  SELECT *, CASE WHEN target > 0 THEN (source_size * c + upto)::DOUBLE / target ELSE 0.0::DOUBLE END AS finish
  FROM queued, (VALUES (0), (1)) AS r(c)),
run AS (SELECT *, sum(size) OVER (ORDER BY finish, q, doc_id ROWS UNBOUNDED PRECEDING) AS total FROM copies)
SELECT doc_id, size, source_size, target, sum(CASE WHEN total <= budget THEN size ELSE 0 END)::BIGINT AS taken
FROM run GROUP BY doc_id, size, source_size, target, q
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_exact_dedup": OP2, "op7_mixing": OP7}
