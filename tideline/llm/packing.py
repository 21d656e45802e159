"""Best-fit packing by minimum bin slack.

Each sequence starts with the longest piece left; a subset-sum dynamic programme
over the lengths that are left (a bitset) finds the fullest feasible filling of
the rest, which is removed.  Pieces of one length are alike, so the programme
runs on the histogram of lengths (at most ``capacity`` entries, whatever the size of
the corpus), and a combination is removed as often as its pieces last.  Pieces
then find their place by rank within their length: a rank is the rank within a
partition, which is counted while the pieces are made, plus the counts of the
partitions before, so that no piece moves.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, portions, released, session_of, stage
from .tokens import END_ID, encoder

CAPACITY = 1024


def fullest(lengths: list[int], counts: dict[int, int], room: int) -> dict[int, int]:
    """The combination of pieces that fills room best: length to number.

    Of several, the one that the programme reaches first, with long pieces first.
    """
    reach, steps = 1, []  # bit s: sum s can be made
    mask = (1 << (room + 1)) - 1
    for length in lengths:
        if length > room:
            continue
        left, take = min(counts[length], room // length), 1
        while left:  # 1, 2, 4, ... pieces at a time
            n = min(take, left)
            grown = (reach | reach << (length * n)) & mask
            if grown != reach:
                steps.append((length, n, reach))
                reach = grown
            left -= n
            take *= 2
            if reach >> room & 1:
                break
        if reach >> room & 1:
            break
    best, chosen = reach.bit_length() - 1, {}
    for length, n, before in reversed(steps):
        if not before >> best & 1:
            chosen[length] = chosen.get(length, 0) + n
            best -= length * n
    return chosen


#: (least length, slack) in shares of the capacity: a filling of longer pieces alone will do if it leaves no more slack
#: than this, which saves short pieces for later bins.  The trial of the fewest sequences is taken.
TRIALS = ((0.0, 0.0), (0.2, 0.025), (0.25, 0.025), (0.25, 0.05), (0.33, 0.05))


def pack_lengths(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, dict[int, int]]]:
    """Sequences as (how many, length to number of pieces) from the number of pieces of each length."""
    counts = {k: v for k, v in counts.items() if v > 0}
    if counts and not 0 < min(counts) <= max(counts) <= capacity:
        raise ValueError(f"lengths are 1 to {capacity}")
    tried = [_pack(dict(counts), capacity, int(a * capacity), int(b * capacity)) for a, b in TRIALS]
    return min(tried, key=lambda packed: sum(times for times, _ in packed))


def _pack(counts: dict[int, int], capacity: int, least: int, slack: int) -> list[tuple[int, dict[int, int]]]:
    packed = []
    while counts:
        lengths = sorted(counts, reverse=True)
        seed = lengths[0]
        rest = {k: v - (k == seed) for k, v in counts.items()}
        left, room = [x for x in lengths if rest[x]], capacity - seed
        bin_ = fullest([x for x in left if x >= least], rest, room)
        if room - sum(k * n for k, n in bin_.items()) > slack:
            bin_ = fullest(left, rest, room)
        bin_[seed] = bin_.get(seed, 0) + 1
        times = min(counts[k] // n for k, n in bin_.items())
        packed.append((times, bin_))
        for k, n in bin_.items():
            counts[k] -= n * times
            if not counts[k]:
                del counts[k]
    return packed


class _Places:
    """For each length, runs of ranks: (first rank, pieces of it per sequence, first sequence, first offset)."""

    def __init__(self, packed: list[tuple[int, dict[int, int]]]) -> None:
        runs: dict[int, list[tuple[int, int, int, int]]] = {}
        rank: dict[int, int] = {}
        sequence = 0
        for times, bin_ in packed:
            offset = 0
            for length, n in sorted(bin_.items(), reverse=True):
                runs.setdefault(length, []).append((rank.get(length, 0), n, sequence, offset))
                rank[length] = rank.get(length, 0) + n * times
                offset += length * n
            sequence += times
        self.runs = {k: np.array(v, np.int64) for k, v in runs.items()}

    def __call__(self, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        for length in np.unique(lengths):
            at = lengths == length
            runs = self.runs[int(length)]
            run = runs[np.searchsorted(runs[:, 0], ranks[at], "right") - 1]
            copy, slot = np.divmod(ranks[at] - run[:, 0], run[:, 1])
            sequence[at], offset[at] = run[:, 2] + copy, run[:, 3] + slot * length
        return sequence, offset


_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, *, tokenizer: str = "byte_bpe_50k.json", capacity: int = CAPACITY, carry_ids: bool = False, ranked: bool = False) -> DataFrame:
    """Pieces of at most ``capacity`` ids of every document, with the end id: doc_id, piece, start, length, ids_crc32.

    Only longer documents are cut; the first piece takes the odd rest, the others
    are full, so that a very long text gives many.  ``carry_ids`` adds the ids, as
    binary, ``ranked`` _at, the pieces of a piece's length before it in its partition.
    Null text counts as empty and gives one piece, the end id.
    """
    bounded_batches(session_of(docs))
    end = np.array([END_ID], "<u4").tobytes()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, 0.5 if carry_ids else 1.0).batch  # beside the ids, half the cache
        seen = [0] * (capacity + 1)
        for batch in portions(released(batches)):
            rows: tuple[list, ...] = ([], [], [], [], [], [], [])
            for doc_id, ids in zip(batch.column(0).to_pylist(), encode(batch.column(1).to_pylist())):
                ids += end
                n = len(ids) // 4
                start, to, piece = 0, n if n <= capacity else n % capacity or capacity, 0
                while start < n:
                    part = ids[4 * start : 4 * to]
                    for column, value in zip(rows, (doc_id, piece, start, to - start, zlib.crc32(part), part, seen[to - start])):
                        column.append(value)
                    seen[to - start] += 1
                    start, to, piece = to, to + capacity, piece + 1
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64())
            names = ("doc_id", "piece", "start", "length", "ids_crc32", "ids", "_at")
            kept = [0, 1, 2, 3, 4, *[5] * carry_ids, *[6] * ranked]
            yield pa.RecordBatch.from_arrays([pa.array(rows[k], types[k]) for k in kept], names=[names[k] for k in kept])

    return docs.select("doc_id", "text").mapInArrow(pieces, _PIECES + ", ids binary" * carry_ids + ", _at long" * ranked)


def packed(docs: DataFrame, *, tokenizer: str = "byte_bpe_50k.json", capacity: int = CAPACITY, carry_ids: bool = False) -> DataFrame:
    """token_pieces() with sequence_id and offset of every piece; sequences are gapless from offset 0.

    Documents are packed as they come: a repeated row is packed again, a null
    doc_id keeps its null, and equal lengths are placed in the order in which
    partitions and rows come.  An empty table gives no rows; other columns are
    ignored, whatever their names.
    """
    spark = session_of(docs)
    pieces = stage(token_pieces(docs, tokenizer=tokenizer, capacity=capacity, carry_ids=carry_ids, ranked=True).withColumn("_part", F.spark_partition_id()), "pack_pieces")
    counts = stage(pieces.groupBy("_part", "length").agg(F.count(F.lit(1)).alias("_n")), "pack_counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    places = spark.sparkContext.broadcast(_Places(pack_lengths(histogram, capacity)))
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_part", "length", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    ranked = pieces.join(starts, ["_part", "length"]).withColumn("_rank", F.col("_at") + F.col("_before"))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * carry_ids

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = places.value(batch["length"].to_numpy(), batch["_rank"].to_numpy())
            yield pa.RecordBatch.from_arrays([batch[c] for c in columns] + [pa.array(sequence), pa.array(offset)], names=[*columns, "sequence_id", "offset"])

    schema = _PIECES + (", ids binary" if carry_ids else "") + ", sequence_id long, offset long"
    return ranked.select(*columns, "_rank").mapInArrow(place, schema)
