"""Mixing sources to target weights by weighted fair queueing, in DataFrame functions only.

Every document waits in the queue of its source, in a shuffled order that its id
and a seed fix.  Its virtual finish time is the source's tokens up to and with
it, divided by the source's target; the mix is the documents in order of finish
time, truncated at the total budget.  A source whose target exceeds its tokens
goes round again: copy 2 of a document waits behind copy 1 of all others.

No queue is walked by one task: running sums are taken inside small buckets of
the shuffled order (or of finish time) and added to the sums of the buckets
before, of which there are BUCKETS per source at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, stage

#: Buckets of a source's shuffled order (three hex digits of its hash), and of finish time.
BUCKETS = 4096


def word_count(column: str = "text") -> Column:
    return F.coalesce(F.regexp_count(column, F.lit(WORD)), F.lit(0)).cast("long")


def mixing_targets(sizes: DataFrame, *, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, repeats: int = 2) -> DataFrame:
    """Targets of sources: source, source_size, weight, target, budget, from source and source_size.

    Sources in code point order (null last) take the weights in turn.  They share
    ``share`` times all tokens by weight; a target stops at ``repeats`` times its
    source's size, and what is above goes to the others by weight until none is
    above.  Only the table of sources, one row each, is ordered in one task.
    """
    order = Window.orderBy(F.asc_nulls_last("source"))
    turn = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    table = sizes.withColumn("weight", turn).withColumn("limit", F.col("source_size") * float(repeats))
    # filled in order of limit / weight: a source is at its limit iff the level that is left for it and those after it is no lower
    fill = Window.orderBy(F.col("limit") / F.col("weight"), F.asc_nulls_last("source"))
    everyone = Window.partitionBy()
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    table = table.withColumn("budget", F.least(F.sum("source_size").over(everyone) * share, F.sum("limit").over(everyone)))
    table = table.withColumn("_level", (F.col("budget") - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / (F.sum("weight").over(everyone) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    table = table.withColumn("_full", F.col("limit") <= F.col("_level") * F.col("weight"))
    level = F.max(F.when(~F.col("_full"), F.col("_level"))).over(everyone)
    target = F.when(F.col("_full"), F.col("limit")).otherwise(level * F.col("weight"))
    return table.select(*sizes.columns, "weight", target.alias("target"), "budget")


def mixed(docs: DataFrame, *, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, repeats: int = 2, seed: str = "mix", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies, taken, and the carried columns.

    size is the number of words; taken is copies times size.  Null text has size
    0, null is a source of its own, and a document of size 0 adds nothing however
    often it is taken.  The order depends on doc_id, size and seed, so reruns
    agree; rows that are alike in all of them are interchangeable, and those of a
    null doc_id are documents like any other.  A very long text counts whole.  An
    empty table gives no rows; other columns are ignored, whatever their names.
    """
    queue = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    key = F.coalesce(F.concat(F.lit("="), "source"), F.lit("-")).alias("_s")
    base = docs.select("doc_id", "source", key, word_count().alias("size"), queue.alias("_q"), F.substring(queue, 1, 3).alias("_b"), *carry)
    buckets = stage(base.groupBy("_s", "source", "_b").agg(F.sum("size").alias("_bucket")), "mix_buckets")
    targets = mixing_targets(buckets.groupBy("_s", "source").agg(F.sum("_bucket").alias("source_size")), weights=weights, share=share, repeats=repeats)
    targets = stage(targets, "mix_targets")
    ahead = Window.partitionBy("_s").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = buckets.select("_s", "_b", F.coalesce(F.sum("_bucket").over(ahead), F.lit(0)).alias("_before")).join(targets.drop("source", "weight"), "_s")
    place = Window.partitionBy("_s", "_b").orderBy("_q", "doc_id", "size")
    queued = base.withColumn("_in", F.sum("size").over(place)).join(starts, ["_s", "_b"])
    # the word of a source at its target finishes at 1
    finish = [F.coalesce((F.col("source_size") * c + F.col("_before") + F.col("_in")) / F.when(F.col("target") > 0, F.col("target")), F.lit(0.0)) for c in range(repeats)]
    queued = stage(queued.select("doc_id", "source", "size", "source_size", "target", "budget", "_q", F.array(*finish).alias("_finish"), *carry), "mix_queued")
    last = _last_taken(queued.select("doc_id", "size", "budget", "_q", F.explode("_finish").alias("_f")))
    if last is None:
        copies = F.lit(0)
    else:
        at = F.struct(F.lit(last[0]).alias("f"), F.lit(last[1]).alias("q"))
        copies = F.size(F.filter("_finish", lambda f: F.struct(f.alias("f"), F.col("_q").alias("q")) <= at))
    out = queued.withColumn("copies", copies)
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), *carry)


def _last_taken(copies: DataFrame) -> tuple[float, str] | None:
    """Finish time and queue place of the last copy within the budget; None if there is none.

    Copies are summed by bucket of finish time.  The bucket that crosses the
    budget holds about a BUCKETS-th of it, and only that one is summed by row.
    """
    copies = copies.withColumn("_b", F.floor(F.least(F.col("_f"), F.lit(64.0)) * BUCKETS))
    order = Window.orderBy("_b")
    sums = copies.groupBy("_b").agg(F.sum("size").alias("_sum"), F.max("budget").alias("budget"))
    sums = sums.select("_b", "budget", "_sum", F.sum("_sum").over(order).alias("_to"))
    over = sums.filter("_to > budget").orderBy("_b").select("_b", (F.col("_to") - F.col("_sum")).alias("_from")).first()
    whole = copies if over is None else copies.filter(F.col("_b") < over["_b"])
    if over is not None:
        within = copies.filter(F.col("_b") == over["_b"]).withColumn("_run", F.sum("size").over(Window.orderBy("_f", "_q", "doc_id")) + over["_from"])
        last = within.filter("_run <= budget").agg(F.max(F.struct("_f", "_q")).alias("_last")).first()["_last"]
        if last is not None:
            return last["_f"], last["_q"]
    last = whole.agg(F.max(F.struct("_f", "_q")).alias("_last")).first()["_last"]
    return None if last is None else (last["_f"], last["_q"])


def mix_documents(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: every document as often as it is taken, with its own columns.

    Documents that the mix doesn't reach are left out; one taken twice is two rows.
    """
    whole = docs.select("doc_id", "source", "text", F.struct(*docs.columns).alias("_row"))
    out = mixed(whole, carry=("_row",), **how).filter("copies > 0")
    return out.select(F.explode(F.array_repeat("_row", F.col("copies"))).alias("_row")).select("_row.*")
