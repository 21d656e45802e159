"""Resharding by minimum-cost flow.

Shards are laid out in files of bounded size, and files hold blocks of rows; a
manifest has the shard, file, rows and bytes of every block.  From the old shards'
bytes and the new shards' capacities, a minimum-cost flow (a byte that stays costs
nothing, one that moves costs one, or what a cost matrix says) gives the transfers
that move the fewest bytes.  Whole blocks carry them out, taken from as few files as
they can be.  Only files that lose a block are read and written anew; all others
stay as they are, name and time.  The driver sees one row per block.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left, insort

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import remove, session_of, stage_path, text_or_empty, unfolded

OLD_SHARDS, NEW_SHARDS = 32, 40
#: Blocks of an old shard at least, and bytes of a block, about, where there are more.
BLOCKS, BLOCK_BYTES = 256, 32 << 20
#: Bytes of a row besides its text.
ROW_BYTES = 16
#: Bytes of text, about, in a file of a shard; smaller tables have FILES files.
FILE_BYTES, FILES = 128 << 20, 320


def min_cost_flow(supply: list[int], capacity: list[int], cost: np.ndarray | None = None) -> np.ndarray:
    """Flow from old to new shards (bytes) of the least cost, by successive shortest paths with potentials.

    Without a cost matrix, staying in the shard of the same number is free and
    anything else costs one a byte.  Capacities must hold the supply.
    """
    n, m = len(supply), len(capacity)
    if sum(capacity) < sum(supply):
        raise ValueError("the capacities don't hold the supply")
    price = np.ones((n, m)) - np.eye(n, m) if cost is None else np.asarray(cost, float)
    flow = np.zeros((n, m), np.int64)
    left, room = np.array(supply, np.int64), np.array(capacity, np.int64)
    price = price - min(0.0, float(price.min(initial=0.0)))
    up, vp = np.zeros(n), np.zeros(m)
    while left.sum():
        # Dijkstra over reduced costs from every old shard with supply to a new one with room
        du, dv = np.where(left > 0, 0.0, np.inf), np.full(m, np.inf)
        back_u, back_v = np.full(n, -1), np.full(m, -1)
        heap = [(0.0, 0, int(i)) for i in np.flatnonzero(left > 0)]
        done_u, done_v, target = np.zeros(n, bool), np.zeros(m, bool), -1
        while heap:
            d, side, k = heapq.heappop(heap)
            if side == 0:
                if done_u[k]:
                    continue
                done_u[k] = True
                reach = d + np.maximum(price[k] + up[k] - vp, 0)
                for j in np.flatnonzero(reach < dv - 1e-12):
                    dv[j], back_v[j] = reach[j], k
                    heapq.heappush(heap, (reach[j], 1, int(j)))
            else:
                if done_v[k]:
                    continue
                done_v[k] = True
                if room[k] > 0:
                    target = k
                    break
                for i in np.flatnonzero((flow[:, k] > 0) & ~done_u):
                    reach_i = d + max(0.0, vp[k] - up[i] - price[i, k])
                    if reach_i < du[i] - 1e-12:
                        du[i], back_u[i] = reach_i, k
                        heapq.heappush(heap, (reach_i, 0, int(i)))
        far = dv[target]
        up += np.minimum(du, far)
        vp += np.minimum(dv, far)
        path, j = [], target
        while True:
            i = int(back_v[j])
            path.append((i, j, 1))
            if back_u[i] < 0:
                break
            path.append((i, int(back_u[i]), -1))
            j = int(back_u[i])
        amount = min([int(left[i]), int(room[target])] + [int(flow[a, b]) for a, b, s in path if s < 0])
        for a, b, s in path:
            flow[a, b] += s * amount
        left[i] -= amount
        room[target] -= amount
    return flow


#: Bytes of a block by its file and number.
Blocks = dict[tuple[int, int], int]


def plan_transfers(shards: dict[int, Blocks], capacity: list[int], cost: np.ndarray | None = None) -> tuple[dict[tuple[int, int], int], np.ndarray]:
    """New shard of every block of the files that are affected, and the flow that the blocks carry out.

    Blocks are taken from a shard's last file on, so that few files lose any; what
    the flow asks of the last of them is met by its largest blocks that fit.
    """
    n = max(shards, default=-1) + 1
    flow = min_cost_flow([sum(shards.get(i, {}).values()) for i in range(n)], capacity, cost)
    need = np.array(capacity, np.int64)
    to: dict[tuple[int, int], int] = {}
    loose: list[tuple[int, int, int, int]] = []
    for old in sorted(shards):
        out = int(flow[old].sum()) - (int(flow[old, old]) if old < len(capacity) else 0)
        by_file: dict[int, list[tuple[int, int]]] = {}
        for (file, block), size in shards[old].items():
            by_file.setdefault(file, []).append((size, block))
        held = sum(shards[old].values())
        for file in sorted(by_file, reverse=True):
            if out <= 0 or (out < min(by_file[file])[0] and old < len(capacity)):
                break
            for size, block in sorted(by_file[file], reverse=True):
                if size <= out or old >= len(capacity):
                    loose.append((size, old, file, block))
                    out -= size
                    held -= size
                else:
                    to[file, block] = old  # stays, in a file that is written anew
        if old < len(capacity):
            need[old] -= held
    # the largest first, to where the flow goes and most is needed; in the end to where most is needed
    owed = flow.astype(np.int64).copy()
    size_of = {}
    for size, old, file, block in sorted(loose, reverse=True):
        wanted = np.flatnonzero((owed[old] > 0) & (np.arange(len(capacity)) != old))
        wanted = wanted[need[wanted] >= size]
        j = int(wanted[np.argmax(need[wanted])]) if len(wanted) else int(np.argmax(need))
        to[file, block] = j
        owed[old, j] -= size
        need[j] -= size
    for blocks in shards.values():
        size_of.update({at: blocks[at] for at in blocks if at in to})
    _even(size_of, to, need)
    return to, flow


def _even(size_of: Blocks, to: dict[tuple[int, int], int], need: np.ndarray) -> None:
    """Move blocks of affected files from the fullest to the emptiest shard for as long as that brings the two closer.

    Every move makes the sum of squares of what is needed smaller, so this ends.
    """
    held: list[list[tuple[int, int, int]]] = [[] for _ in need]
    for (file, block), j in to.items():
        insort(held[j], (size_of[file, block], file, block))
    while len(need):
        a, b = int(np.argmin(need)), int(np.argmax(need))
        gap, own = int(need[b] - need[a]), held[a]
        at = bisect_left(own, (gap // 2, -1, -1))  # the sizes next to half the gap
        near = [x for x in own[max(0, at - 1) : at + 1] if 0 < x[0] < gap]
        if not near:
            return
        best = min(near, key=lambda x: (abs(gap - 2 * x[0]), x))
        own.remove(best)
        insort(held[b], best)
        to[best[1], best[2]] = b
        need[a] += best[0]
        need[b] -= best[0]


def _size() -> Column:
    return (F.octet_length(F.encode(F.coalesce(F.col("_row.text"), F.lit("")), "utf-8")) + ROW_BYTES).cast("long")


_MANIFEST = "shard int, file long, block long, rows long, bytes long, first long"


def _manifests(spark: SparkSession, path: str) -> list[str]:
    """Paths of the manifests that were written whole, the last one last."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(f"{path}/_manifest_*/_SUCCESS")
    found = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at)
    return sorted((str(f.getPath().getParent().toString()) for f in found or ()), key=lambda x: int(x.rsplit("_", 1)[1]))


def _write_manifest(spark: SparkSession, path: str, version: int, rows: list[tuple[int, int, int, int, int]]) -> None:
    """shard, file, block, rows, bytes of every block, and the first slot, counted along the files of a shard."""
    out, held = [], {}
    for shard, file, block, n, size in sorted(rows):
        out.append((shard, file, block, n, size, held.get(shard, 0)))
        held[shard] = held.get(shard, 0) + n
    spark.createDataFrame(out, _MANIFEST).coalesce(8).write.parquet(f"{path}/_manifest_{version}")


def _in_files(blocks: list[tuple[int, int, int]], most: int, first: int) -> list[int]:
    """File of each block (shard, block, bytes), in order: a file holds blocks of one shard, of ``most`` bytes or a single one."""
    out, held = [], 0
    for i, (shard, _, size) in enumerate(blocks):
        if i and (blocks[i - 1][0] != shard or held + size > most):
            first, held = first + 1, 0
        out.append(first)
        held += size
    return out


def lay_out(docs: DataFrame, path: str, *, shards: int = OLD_SHARDS, shard: str | None = None, blocks: int = BLOCKS) -> None:
    """Write documents to shards under ``path``: by a hash of the row, or as the column ``shard`` says.

    Null text counts as empty for sizes and stays null.  Rows with null or repeated
    ids are rows like any other, and so is a very long one, which makes a block of
    its own size.  A null shard counts as 0.  An empty table makes a layout without
    files.
    """
    spark = session_of(docs)
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col("doc_id").alias("_id"), (F.coalesce(F.col(shard).cast("int"), F.lit(0)) if shard else F.lit(None).cast("int")).alias("_given"))
    rows = rows.withColumn("_size", _size()).withColumn("_crc", F.crc32(F.encode(F.coalesce(F.col("_row.text"), F.lit("")), "utf-8")))
    if not shard:
        rows = rows.withColumn("_given", F.pmod(F.xxhash64("_id", F.lit(0)), F.lit(shards)).cast("int"))
    total = rows.agg(F.sum("_size")).first()[0] or 0
    many = max(blocks, -(-total // (BLOCK_BYTES * shards)))
    rows = rows.withColumn("_block", F.pmod(F.xxhash64("_id", "_size", "_crc", F.lit(1)), F.lit(many)))
    table = sorted(tuple(r) for r in rows.groupBy("_given", "_block").agg(F.sum("_size"), F.count(F.lit(1))).collect())
    files = _in_files([r[:3] for r in table], min(FILE_BYTES, max(total // FILES, 1 << 16)), 0)
    plan = spark.createDataFrame([(s, b, f) for (s, b, _, _), f in zip(table, files)], "_given int, _block long, file long")
    # a row a block: BLOCKS a shard, or one for every BLOCK_BYTES, as the driver holds them
    placed = rows.join(F.broadcast(plan), ["_given", "_block"]).repartition("file")
    place = Window.partitionBy("file", "_block").orderBy("_id", "_crc", "_size")
    placed = placed.select(F.col("_given").alias("shard"), "file", F.col("_block").alias("block"), (F.row_number().over(place) - 1).cast("long").alias("pos"), "_row")
    placed.write.partitionBy("shard", "file").option("compression", "zstd").parquet(path)
    _write_manifest(spark, path, 0, [(s, f, b, n, size) for (s, b, size, n), f in zip(table, files)])


def _schema(spark: SparkSession, path: str) -> DataFrame | None:
    """The files of a layout; None if it has none."""
    return spark.read.option("basePath", path).parquet(path) if not spark.read.schema(_MANIFEST).parquet(_manifests(spark, path)[-1]).isEmpty() else None


def reshard(spark: SparkSession, path: str, *, new_shards: int = NEW_SHARDS, cost: np.ndarray | None = None) -> DataFrame:
    """Make the layout under ``path`` one of ``new_shards`` even shards, and return what moved: old_shard, new_shard, bytes.

    Files that lose a block are read, and their blocks written to new files; then
    the new manifest is written, and then those files are deleted: whatever stops
    this, one manifest stands and all its files do.
    """
    version = len(_manifests(spark, path))
    table = sorted(tuple(r)[:5] for r in spark.read.schema(_MANIFEST).parquet(_manifests(spark, path)[-1]).collect())
    total = sum(r[4] for r in table)
    capacity = [total // new_shards + (i < total % new_shards) for i in range(new_shards)]
    shards: dict[int, Blocks] = {}
    for shard, file, block, _, size in table:
        shards.setdefault(shard, {})[file, block] = size
    to, _ = plan_transfers(shards, capacity, cost)
    gone = {file for file, _ in to}
    moved = sorted((to[r[1], r[2]], r[1], r[2], r[4], r[3], r[0]) for r in table if r[1] in gone)
    first = max((r[2] for r in table), default=0) + 1  # blocks of new files get numbers that no other has
    files = _in_files([(r[0], 0, r[3]) for r in moved], min(FILE_BYTES, max(total // FILES, 1 << 16)), max((r[1] for r in table), default=0) + 1)
    if moved:
        read = _schema(spark, path).filter(F.col("file").isin(sorted(gone))).withColumnsRenamed({"shard": "_shard", "file": "_file", "block": "_block"}).withColumn("_file", F.col("_file").cast("long"))
        plan = spark.createDataFrame([(r[1], r[2], r[0], f, n) for n, (r, f) in enumerate(zip(moved, files), first)], "_file long, _block long, shard int, file long, block long")
        placed = read.join(F.broadcast(plan), ["_file", "_block"]).repartition("file").select("shard", "file", "block", "pos", "_row")
        placed.write.mode("append").partitionBy("shard", "file").option("compression", "zstd").parquet(path)
    kept = [r for r in table if r[1] not in gone]
    _write_manifest(spark, path, version, kept + [(r[0], f, n, r[4], r[3]) for n, (r, f) in enumerate(zip(moved, files), first)])
    remove(spark, *{f"{path}/shard={r[0]}/file={r[1]}" for r in table if r[1] in gone})
    sums: dict[tuple[int, int], int] = {}
    for r in kept:
        sums[r[0], r[0]] = sums.get((r[0], r[0]), 0) + r[4]
    for new, _, _, size, _, old in moved:
        sums[old, new] = sums.get((old, new), 0) + size
    return spark.createDataFrame([(a, b, n) for (a, b), n in sorted(sums.items())], "old_shard int, new_shard int, bytes long")


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """The documents of a layout with shard and slot, the row's place in its shard, gapless from 0.

    Columns of the documents that have one of these names stay, with _in behind it.
    """
    files = _schema(spark, path)
    if files is None:
        return spark.createDataFrame([], "shard int, slot long")
    manifest = spark.read.schema(_MANIFEST).parquet(_manifests(spark, path)[-1])
    rows = files.withColumn("file", F.col("file").cast("long")).join(F.broadcast(manifest.select("shard", "file", "block", "first")), ["shard", "file", "block"])
    return unfolded(rows.select("_row", "shard", (F.col("first") + F.col("pos")).alias("slot")), files.schema["_row"].dataType.names, ["shard", "slot"])


def sharded(docs: DataFrame, *, old_shards: int = OLD_SHARDS, new_shards: int = NEW_SHARDS) -> DataFrame:
    """Lay the documents out in the shared folder, reshard them there, and read back: doc_id, size, text_crc32, shard, slot.

    Rules as in lay_out(); an empty table gives no rows; other columns are ignored,
    whatever their names.
    """
    spark = session_of(docs)
    path = stage_path(spark, "shards")
    lay_out(docs.select(F.col("doc_id").cast("long"), "text"), path, shards=old_shards)
    reshard(spark, path, new_shards=new_shards)
    files = read_shards(spark, path)
    if "doc_id" not in files.columns:
        return spark.createDataFrame([], "doc_id long, size long, text_crc32 long, shard int, slot long")
    data = F.encode(text_or_empty(), "utf-8")
    return files.select("doc_id", (F.octet_length(data) + ROW_BYTES).cast("long").alias("size"), F.crc32(data).alias("text_crc32"), "shard", "slot")
