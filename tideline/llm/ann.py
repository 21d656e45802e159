"""Approximate nearest neighbours: stable projections, a kd-tree, and a chi-square stopping test.

Vectors are completed by one component so that the largest inner product is the
smallest distance, and projected by a Gaussian (2-stable) matrix to ``DIMENSIONS``
numbers.  A pair at distance d is projected to a distance p with p^2 / d^2 chi-square
distributed.  A search goes through the projected neighbours from the nearest on,
verifies each on its whole vector, and stops when the next one's p^2 exceeds the
quantile times the square of the k-th distance found: what is nearer has been seen
with that probability.

The projections are indexed by a kd-tree of two levels, each fitted on a bounded
sample: its leaves are regions of about REGION vectors.  Inside its task a region is
cut into cells with tight boxes; cells are opened in order of their boxes' distance,
so that neighbours come incrementally and no other vector is looked at.  In the home
region of a query its k-th distance is bounded; then it goes to the regions whose
boxes are within the radius of the stopping test.  Equal vectors are one entry with
their smallest ids, as many as any answer can use.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, lookup_join, portions, scratch, session_of, stage

DIMENSIONS = 16
#: Vectors of a region and of a cell in it, about.
REGION, CELL = 16_384, 256
#: Vectors of the sample that fits a level of the tree, and cuts of a level at most: 1,024 leaves, each with 1,024 below.
SAMPLE, LEVEL = 50_000, 10
#: With this probability a neighbour is seen before the stopping test holds.
CONFIDENCE = 0.91
#: Queries that search a region in one task.
QUERY_BLOCK = 1024
#: Projected neighbours verified at a time, at first.
PORTION = 64


def chi_square_quantile(p: float, m: int) -> float:
    """Of the chi-square distribution with an even number of degrees of freedom."""
    below = lambda x: 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(m // 2))
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if below(mid) < p else (low, mid)
    return high


class Tree:
    """A kd-tree's cuts, as arrays: node i has children 2i + 1 and 2i + 2."""

    def __init__(self, sample: np.ndarray, depth: int) -> None:
        inner = 2**depth - 1
        self.depth, self.axis, self.cut = depth, np.zeros(inner, np.int64), np.zeros(inner)
        rows = {0: sample}
        for node in range(inner):
            own = rows.pop(node)
            if len(own):
                self.axis[node] = int(np.argmax(np.ptp(own, axis=0)))
                self.cut[node] = float(np.median(own[:, self.axis[node]]))
            right = own[:, self.axis[node]] > self.cut[node] if len(own) else np.zeros(0, bool)
            rows[2 * node + 1], rows[2 * node + 2] = own[~right], own[right]

    def leaf(self, points: np.ndarray) -> np.ndarray:
        node = np.zeros(len(points), np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + (points[np.arange(len(points)), self.axis[node]] > self.cut[node])
        return node - (2**self.depth - 1)

    def within(self, point: np.ndarray, radius2: float, off: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """Leaves at most so far from the point, and how far on each axis; ``off`` is how far the whole tree is."""
        out, stack, inner = [], [(0, off)], 2**self.depth - 1
        while stack:
            node, off = stack.pop()
            if node >= inner:
                out.append((node - inner, off))
                continue
            axis, gap = self.axis[node], point[self.axis[node]] - self.cut[node]
            near, far = (2 * node + 2, 2 * node + 1) if gap > 0 else (2 * node + 1, 2 * node + 2)
            stack.append((near, off))
            beyond = off.copy()
            beyond[axis] = max(beyond[axis], abs(gap))
            if float(beyond @ beyond) <= radius2:
                stack.append((far, beyond))
        return out


class Regions:
    """A tree and the trees below its leaves, if there are any: a region is a leaf of a leaf."""

    def __init__(self, top: Tree, below: dict[int, Tree]) -> None:
        self.top, self.below = top, below

    def of(self, points: np.ndarray) -> np.ndarray:
        first = self.top.leaf(points)
        out = first << LEVEL
        for leaf in np.unique(first):
            if tree := self.below.get(int(leaf)):
                at = first == leaf
                out[at] += tree.leaf(points[at])
        return out

    def within(self, point: np.ndarray, radius2: float) -> list[int]:
        out = []
        for leaf, off in self.top.within(point, radius2, np.zeros(len(point))):
            tree = self.below.get(leaf)
            out += [(leaf << LEVEL) + x for x, _ in tree.within(point, radius2, off)] if tree else [leaf << LEVEL]
        return out


class Cells:
    """The entries of a region, cut into cells at medians until they are small, with the boxes of their points."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, points: np.ndarray, cell: int = CELL) -> None:
        cells, stack = [], [np.arange(len(ids))] if len(ids) else []
        while stack:
            own = stack.pop()
            if len(own) <= cell:
                cells.append(own)
                continue
            x = points[own, int(np.argmax(np.ptp(points[own], axis=0)))]
            cut = np.argpartition(x, len(own) // 2)
            stack += [own[cut[: len(own) // 2]], own[cut[len(own) // 2 :]]]
        line = np.concatenate(cells) if cells else np.zeros(0, np.int64)  # the cells one after the other
        self.ids, self.vectors, self.points = ids[line], vectors[line], points[line]
        self.far = (self.points * self.points).sum(axis=1)
        ends = np.cumsum([0, *map(len, cells)])
        self.rows = [np.arange(a, b) for a, b in zip(ends[:-1], ends[1:])]
        self.low = np.array([points[c].min(axis=0) for c in cells]).reshape(len(cells), -1)
        self.high = np.array([points[c].max(axis=0) for c in cells]).reshape(len(cells), -1)

    def search(self, q: np.ndarray, at: np.ndarray, k: int, bound: float, top2: float, floor: float) -> tuple[np.ndarray, np.ndarray, int]:
        """Ids and scores of the k entries of the largest inner product, not below floor, and how many were verified.

        q is the query and ``at`` its projection.  top2 is the largest squared norm:
        a query's squared distance to an entry is its own squared norm plus top2 less
        twice the inner product.  Cells are opened nearest first, each time as many
        as there are; opened entries that are nearer than any closed cell are
        verified in portions of rising projected distance, with the test before each.
        """
        off = np.maximum(self.low - at, 0) + np.maximum(at - self.high, 0)
        box = (off * off).sum(axis=1)
        order, norm2, at2 = np.argsort(box), float(q @ q), float(at @ at)
        kth, top, seen, scores, verified = floor, np.zeros(0), [], [], 0
        gaps, waiting, opened, more = np.zeros(0), np.zeros(0, np.int64), 0, 4
        radius2 = bound * max(norm2 + top2 - 2 * kth, 0.0)
        while opened < len(order) and box[order[opened]] <= radius2:
            near = order[opened : opened + more]
            fresh = np.concatenate([self.rows[c] for c in near[box[near] <= radius2]])
            gaps = np.concatenate([gaps, self.far[fresh] + at2 - 2 * (self.points[fresh] @ at)])
            waiting = np.concatenate([waiting, fresh])
            opened, more = opened + more, 2 * more
            reach = box[order[opened]] if opened < len(order) else math.inf
            ripe = np.flatnonzero(gaps <= min(reach, radius2))
            cuts, n = [], verified
            while (cuts[-1] if cuts else 0) < len(ripe):
                n += max(PORTION, n // 6)
                cuts.append(min(n - verified, len(ripe)))
            own = gaps[ripe]
            line = ripe[np.argpartition(own, cuts[:-1])] if len(cuts) > 1 else ripe  # portions, each further than the one before
            for first, last in zip([0, *cuts[:-1]], cuts):
                take = line[first:last]
                take = take[gaps[take] <= radius2]
                if not len(take):
                    break
                score = self.vectors[waiting[take]] @ q
                seen.append(waiting[take])
                scores.append(score)
                verified += len(take)
                top = np.concatenate([top, score])
                if len(top) > k:
                    top = np.partition(top, len(top) - k)[-k:]
                if len(top) == k:
                    kth = max(kth, float(top.min()))
                    radius2 = bound * max(norm2 + top2 - 2 * kth, 0.0)
            rest = np.ones(len(gaps), bool)
            rest[ripe] = False
            gaps, waiting = gaps[rest], waiting[rest]
        if not verified:
            return np.zeros(0, np.int64), np.zeros(0), 0
        every, score = np.concatenate(seen), np.concatenate(scores)
        good = every[score >= kth - 1e-9 * max(1.0, abs(kth))]
        exact = (self.vectors[good] * q).sum(axis=1)
        order = np.lexsort((self.ids[good], -exact))[:k]  # all of the k-th score stand here before ids decide
        return self.ids[good][order], exact[order], verified


_HIT = "entry long, hit long, score double, verified long"


def _matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _search(k: int, bound: float, top2: float, width: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Hits of each query among the entries of a region; a row without a hit says how many were verified."""

    def search(queries: pa.Table, entries: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, ...]] = []
        if queries.num_rows and entries.num_rows:
            cells = Cells(entries["entry"].to_numpy(), _matrix(entries["vector"], width), _matrix(entries["point"], DIMENSIONS))
            for entry, q, at, floor in zip(queries["entry"].to_pylist(), _matrix(queries["vector"], width), _matrix(queries["at"], DIMENSIONS), queries["floor"].to_pylist()):
                hits, scores, verified = cells.search(q, at, k, bound, top2, floor)
                out.append((np.full(len(hits) + 1, entry), np.append(hits, -1), np.append(scores, 0.0), np.append(np.zeros(len(hits), np.int64), verified), np.append(np.zeros(len(hits), bool), True)))
        entry, hit, score, verified, none = (np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, t) for t in (np.int64, np.int64, float, np.int64, bool))
        return pa.table({"entry": pa.array(entry, pa.int64()), "hit": pa.array(hit, pa.int64(), mask=none), "score": pa.array(score, pa.float64(), mask=none), "verified": pa.array(verified, pa.int64())})

    return search


def _projected(width: int, matrix: np.ndarray, top2: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Adds point, the projection of the completed vector, and at, that of the vector as a query, with 0 for the completion."""

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, 4096):
            v = _matrix(batch["vector"], width)
            at = v @ matrix[:width]
            points = at + np.sqrt(np.maximum(top2 - (v * v).sum(axis=1), 0))[:, None] * matrix[width]
            new = [pa.array(list(x), pa.list_(pa.float64())) for x in (points, at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, "point", "at"])

    return project


def _share(n: int | Column, column: str = "entry") -> Column:
    """Rows of which, by hash, SAMPLE are chosen of n in expectation."""
    return F.pmod(F.xxhash64(column, F.lit(5)), F.lit(1 << 30)) <= F.lit(1 << 30) * F.least(F.lit(1.0), SAMPLE / (F.lit(n) if isinstance(n, int) else n))


def _regions(entries: DataFrame, total: int, region: int) -> Regions:
    """The two levels of cuts: the lower ones are fitted where more than 2**LEVEL regions are asked for."""
    depth = max(0, math.ceil(math.log2(max(total, 1) / region)))
    sample = np.array([r[0] for r in entries.filter(_share(total)).select("point").collect()]).reshape(-1, DIMENSIONS)
    top = Tree(sample, min(depth, LEVEL))
    if depth <= LEVEL:
        return Regions(top, {})

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, 4096):
            yield pa.RecordBatch.from_arrays([pa.array(top.leaf(_matrix(batch["point"], DIMENSIONS)), pa.int64()), batch["entry"], batch["point"]], names=["leaf", "entry", "point"])

    def fit(key: tuple[pa.Scalar, ...], own: pa.Table) -> pa.Table:
        tree = Tree(_matrix(own["point"], DIMENSIONS), min(depth - LEVEL, LEVEL))
        return pa.table({"leaf": pa.array([key[0].as_py()], pa.int64()), "axis": pa.array([tree.axis.tolist()], pa.list_(pa.int64())), "cut": pa.array([tree.cut.tolist()], pa.list_(pa.float64()))})

    at = stage(entries.select("entry", "point").mapInArrow(leaves, "leaf long, entry long, point array<double>"), "ann_leaves")
    sizes = at.groupBy("leaf").agg(F.count(F.lit(1)).alias("_n"))  # a row a leaf, 2**LEVEL at most
    fitted = at.join(F.broadcast(sizes), "leaf").filter(_share(F.col("_n"))).select("leaf", "point").groupBy("leaf").applyInArrow(fit, "leaf long, axis array<long>, cut array<double>")
    below = {}
    for r in fitted.collect():  # 2**LEVEL trees of 2**LEVEL cuts at most
        below[r["leaf"]] = tree = Tree(np.zeros((0, DIMENSIONS)), 0)
        tree.depth, tree.axis, tree.cut = min(depth - LEVEL, LEVEL), np.array(r["axis"], np.int64), np.array(r["cut"])
    return Regions(top, below)


_RESULT = "query_id long, rank int, vec_id long, score double, verified long"


def nearest(vectors: DataFrame, *, k: int = 20, every: int = 20, column: str = "embedding", confidence: float = CONFIDENCE, region: int = REGION, seed: int = 3) -> DataFrame:
    """The k nearest of every query (rows whose vec_id ``every`` divides) among all other rows.

    query_id, rank (from 1), vec_id, score (inner product in double precision),
    nearest first, ties to the smaller vec_id, and verified, the number of vectors
    whose score was taken for the query.  Vectors that are null, empty or zero, or
    that hold null or non-finite components, take no part, nor do null ids.  Vectors
    of another length have no inner product with a query and are searched among
    themselves.  Rows that repeat an id are one row; if their vectors differ, the one
    of the smallest hash stands for it.  An empty table gives no rows; other columns are
    ignored, whatever their names.
    """
    bounded_batches(session_of(vectors))
    double = F.transform(column, lambda x: x.cast("double"))
    fine = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(column, lambda x: x != 0)
    rows = vectors.filter("vec_id is not null").filter((F.size(column) > 0) & fine).select(F.col("vec_id").cast("long"), double.alias("vector"))
    rows = rows.withColumn("key", F.sha2(F.concat_ws(",", F.transform("vector", lambda x: (x + 0.0).cast("string"))), 256))
    rows = rows.groupBy("vec_id").agg(F.min(F.struct("key", "vector")).alias("_v")).select("vec_id", "_v.vector", "_v.key")
    widths = rows.groupBy(F.size("vector").alias("d")).agg(F.max(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)).alias("top2"))
    out = session_of(vectors).createDataFrame([], _RESULT)
    for width, top2 in sorted(tuple(r) for r in widths.collect()):  # a row for each length that occurs
        out = out.union(_of_width(rows.filter(F.size("vector") == width), width, float(top2), k, every, confidence, region, seed))
    return out


def _of_width(rows: DataFrame, width: int, top2: float, k: int, every: int, confidence: float, region: int, seed: int) -> DataFrame:
    spark = session_of(rows)
    bound = chi_square_quantile(confidence, DIMENSIONS)
    matrix = np.random.default_rng(seed).standard_normal((width + 1, DIMENSIONS))
    with scratch():
        # an entry for each different vector, under its smallest id, with the k + 1 smallest ids
        of_key = Window.partitionBy("key").orderBy("vec_id")
        first = rows.withColumn("_n", F.row_number().over(of_key)).filter(F.col("_n") <= k + 1)
        entries = first.groupBy("key").agg(F.min("vec_id").alias("entry"), F.sort_array(F.collect_set("vec_id")).alias("ids"), F.max(F.when(F.col("_n") == 1, F.col("vector"))).alias("vector"))
        entries = stage(entries.mapInArrow(_projected(width, matrix, top2), "key string, entry long, ids array<long>, vector array<double>, point array<double>, at array<double>"), "ann_entries")
        regions = spark.sparkContext.broadcast(_regions(entries, entries.count(), region))

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in portions(batches, 4096):
                at = regions.value.of(_matrix(batch["point"], DIMENSIONS))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at, pa.int64())], names=[*batch.schema.names, "region"])

        placed = stage(entries.select("entry", "key", "vector", "point", "at").mapInArrow(place, "entry long, key string, vector array<double>, point array<double>, at array<double>, region long"), "ann_placed")
        asks = stage(rows.filter(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "key").distinct(), "ann_asks", keep=True)
        asked = stage(asks.groupBy("key").agg(F.count(F.lit(1)).alias("_asks")), "ann_asked")
        asking = stage(placed.join(asked.select("key"), "key", "left_semi").select("entry", "vector", "at", "region", F.lit(-1e300).alias("floor")), "ann_asking")

        def found(queries: DataFrame) -> DataFrame:
            """Queries (entry, vector, at, region, floor) against the entries of their regions, in blocks."""
            blocks = stage(queries.groupBy("region").agg(F.ceil(F.count(F.lit(1)) / QUERY_BLOCK).cast("int").alias("_blocks")), "ann_blocks")
            left = queries.join(F.broadcast(blocks), "region") if blocks.count() <= 1 << LEVEL else queries.join(blocks, "region")
            left = left.select("entry", "vector", "at", "floor", "region", F.pmod(F.xxhash64("entry"), "_blocks").cast("int").alias("block"))
            right = placed.join(blocks, "region").select("entry", "vector", "point", "region", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("block"))
            return left.groupBy("region", "block").cogroup(right.groupBy("region", "block")).applyInArrow(_search(k + 1, bound, top2, width), _HIT)

        # round 1: the home region bounds the score of the (k + 1)-th hit; the query itself is one of them
        home = stage(found(asking), "ann_home")
        floors = home.groupBy("entry").agg(F.count("hit").alias("_hits"), F.min("score").alias("_low"))
        floors = floors.select("entry", F.when(F.col("_hits") > k, F.col("_low")).alias("_floor"))
        bounded = stage(asking.join(floors, "entry").select("entry", "vector", "at", F.col("region").alias("home"), F.coalesce("_floor", "floor").alias("floor")), "ann_bounded")

        def routes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in portions(batches, 1024):
                to, which = [], []
                for i, (q, at, own, floor) in enumerate(zip(_matrix(batch["vector"], width), _matrix(batch["at"], DIMENSIONS), batch["home"].to_pylist(), batch["floor"].to_pylist())):
                    there = [r for r in regions.value.within(at, bound * max(float(q @ q) + top2 - 2 * floor, 0.0)) if r != own]
                    to += there
                    which += [i] * len(there)
                yield pa.RecordBatch.from_arrays([pa.array(to, pa.int64()), *batch.take(pa.array(which, pa.int64())).columns], names=["region", *batch.schema.names])

        # round 2: the other regions within reach
        routed = stage(bounded.mapInArrow(routes, "region long, entry long, vector array<double>, at array<double>, home long, floor double"), "ann_routed")
        hits = stage(found(routed).union(home), "ann_hits")
        ranked = hits.filter("hit is not null").withColumn("_r", F.row_number().over(Window.partitionBy("entry").orderBy(F.desc("score"), "hit"))).filter(F.col("_r") <= k + 1)
        ranked = stage(ranked.select("entry", "hit", "score"), "ann_ranked")
        # equal vectors score alike: all their ids stand for a hit, in order of score and id
        ids = stage(ranked.groupBy("hit").agg(F.count(F.lit(1)).alias("_n")).join(entries.select(F.col("entry").alias("hit"), "ids"), "hit"), "ann_ids")
        listed = lookup_join(ranked, ids, "hit", "_n", F.xxhash64("entry", "hit"))
        flat = F.flatten(F.transform(F.collect_list(F.struct((-F.col("score")).alias("s"), "ids")), lambda h: F.transform(h["ids"], lambda i: F.struct(h["s"].alias("s"), i.alias("id")))))
        answers = listed.groupBy("entry").agg(F.slice(F.array_sort(flat), 1, k + 1).alias("flat"))
        counts = hits.groupBy("entry").agg(F.sum("verified").alias("verified"))
        answers = stage(answers.join(counts, "entry").join(entries.select("entry", "key"), "entry").join(asked, "key").drop("entry"), "ann_answers", keep=True)
    # many queries may be of one vector
    out = lookup_join(asks, answers, "key", "_asks", F.xxhash64("query_id"), found=True)
    out = out.select("query_id", F.slice(F.filter("flat", lambda x: x["id"] != F.col("query_id")), 1, k).alias("flat"), "verified")
    out = out.select("query_id", F.posexplode("flat").alias("pos", "x"), "verified")
    return out.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("x.id").alias("vec_id"), (-F.col("x.s")).alias("score"), "verified")
