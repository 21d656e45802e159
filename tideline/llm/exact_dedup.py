"""Exact dedup: group by 128-bit content hash, compare bytes inside groups, keep one id.

DataFrame functions only.  Plan: one aggregation on (hash, text), combined before
the shuffle, so that a group of any size arrives as one row per map task and the
bytes themselves are part of the grouping key; then a lookup of each row's group
by hash, in which only ids and hashes move.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lookup_join, stage, text_or_empty


def exact_duplicates(docs: DataFrame, *, keep: str = "min", hash_of: Callable[[Column], Column] = F.md5) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their bytes are.  ``keep`` says whether the smallest
    ("min") or the largest ("max") doc_id of a group stays.  ``hash_of`` maps the
    UTF-8 bytes to the group hash as a string (tests pass a weak one).

    Null text counts as empty, and empty texts are a group like any other.  A
    null doc_id is never the one kept unless all ids of its group are null, when
    keep_id is null and every row stays.  Rows that repeat a doc_id and text are
    one document: each of them carries the same decision.  Very long texts are
    compared whole.  An empty table gives no rows; other columns are ignored,
    whatever their names.
    """
    sha = F.sha2(F.encode(text_or_empty(), "utf-8"), 256)
    out = _decided(docs, F.struct("doc_id", sha.alias("text_sha256")), keep, hash_of)
    return out.select("_row.doc_id", "keep_id", "group_size", "kept", "_row.text_sha256")


def drop_exact_duplicates(docs: DataFrame, *, keep: str = "max", hash_of: Callable[[Column], Column] = F.md5) -> DataFrame:
    """The documents that stay, with all their columns; decisions as in exact_duplicates()."""
    return _decided(docs, F.struct(*docs.columns), keep, hash_of).filter("kept").select("_row.*")


def _decided(docs: DataFrame, carried: Column, keep: str, hash_of: Callable[[Column], Column]) -> DataFrame:
    """_row (what is carried of each document), keep_id, group_size, kept."""
    if keep not in ("min", "max"):
        raise ValueError("keep is 'min' or 'max'")
    best = (F.max if keep == "max" else F.min)("doc_id").alias("keep_id")
    hashed = hash_of(F.encode(text_or_empty(), "utf-8")).alias("_h")
    by_text = docs.select("doc_id", text_or_empty().alias("_text"), hashed).groupBy("_h", "_text").agg(best, F.count(F.lit(1)).alias("group_size"))
    # texts of equal hash and other bytes are told apart; with a sound 128-bit hash there are none
    by_hash = by_text.groupBy("_h").agg(F.count(F.lit(1)).alias("_texts"), F.max("keep_id").alias("keep_id"), F.max("group_size").alias("group_size"))
    groups = stage(by_hash, "exact_groups")
    rows = docs.select(carried.alias("_row"), hashed)
    out = lookup_join(rows, groups, "_h", "group_size", F.xxhash64("_row.doc_id"))
    collided = groups.filter("_texts > 1").select("_h")
    if not collided.isEmpty():
        told = docs.select(carried.alias("_row"), "doc_id", text_or_empty().alias("_text"), hashed).join(collided, "_h", "left_semi")
        exact = told.groupBy("_h", "_text").agg(best, F.count(F.lit(1)).alias("group_size"))
        out = out.filter("_texts = 1").select("_row", "keep_id", "group_size").unionByName(told.join(exact, ["_h", "_text"]).select("_row", "keep_id", "group_size"))
    kept = F.coalesce(F.col("_row.doc_id") == F.col("keep_id"), F.col("keep_id").isNull())
    return out.select("_row", "keep_id", "group_size", kept.alias("kept"))
