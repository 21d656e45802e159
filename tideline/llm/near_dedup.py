"""MinHash near-dedup by a multi-index Hamming join.

A document is the set of its distinct five-word shingles.  Its signature is
``VALUES`` minhashes of 16 bits.  Pairs whose signatures differ in at most
``DISTANCE`` values are wanted: cut into ``CHUNKS``, by the pigeonhole principle
one chunk has at most floor(DISTANCE / CHUNKS) errors, so that two signatures
share a key if all ways of allowing those errors (leaving that many values of the
chunk out) are enumerated.  Every pair under the distance shares one.  ``MORE``
minhashes of 8 bits screen the pairs before any text is moved, and links are
confirmed on the full sets.

Documents of equal sets are one from the start.  Keys are resolved without
listing all pairs of large ones:

1. all pairs of keys of few sets, and of other sets the nearest of the pivots (the
   smallest set of each key), are confirmed and make components;
2. large keys that are still of several components are resolved whole, in tiles of
   bounded size: what isn't of the largest component is held against everything.
   Keys that hang together are one cluster.  A dense cluster is tiled once as a
   whole; in a sparse one each key is, and a pair is looked at in the first key
   that it shares.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, by_id, dealt_groups, lookup_join, portions, released, scratch, session_of, stage

SHINGLE = 5
SIMILARITY = 75  # of 100
VALUES, MORE, CHUNKS = 40, 88, 10
#: Values in which signatures of linked sets may differ: 1 error in each chunk of 4, and one less than 2 in all of them.
#: Sets of similarity 0.75 differ in more than this many of 40 values once in 1,700 times, more similar ones less often.
DISTANCE = 2 * CHUNKS - 1
#: Values of all VALUES + MORE in which they may differ; sets of similarity 0.75 differ in more once in 3,000 times.
SCREEN = 49
#: Keys of up to so many sets are resolved pair by pair.
FEW = 4
#: Pivots that a set is held against.
NEAREST = 4
#: Rows on either side of a tile, and shingles, about: tiles of long texts hold fewer rows.
TILE, TILE_SHINGLES = 256, 1 << 20
#: Links that one task contracts at a time.
LOCAL_LINKS = 500_000
#: Ids up to which a lookup broadcasts them (8 bytes each); more are shuffled.
BROADCAST_IDS = 200_000


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


_draw = np.random.default_rng(11)
_PLACE = _draw.integers(1, 1 << 63, SHINGLE, np.uint64) | np.uint64(1)
_XOR = _draw.integers(1, 1 << 32, VALUES + MORE, np.uint32)
_TIMES = _draw.integers(1, 1 << 32, VALUES + MORE, np.uint32) | np.uint32(1)


def shingles(text: str | None) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles: words between ASCII white space, A-Z lower-cased.

    Fewer words than a shingle make one shingle; none make an empty set.  Hashes of
    words are not kept: that takes longer than making them, and memory in every worker.
    """
    from xxhash import xxh3_64_intdigest

    words = text.encode().lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
    n = max(len(hashes) - SHINGLE + 1, 1)
    total = np.full(n, min(len(hashes), SHINGLE), np.uint64)
    for k in range(min(SHINGLE, len(hashes))):
        total += _mixed(hashes[k : k + n] * _PLACE[k])
    return np.unique(_mixed(total))


def signature(hashes: np.ndarray) -> np.ndarray:
    """VALUES + MORE minhashes of 16 bits."""
    low, least = (hashes >> np.uint64(32)).astype(np.uint32), np.empty(VALUES + MORE, np.uint32)
    step = max(1, min(VALUES + MORE, 65_536 // max(len(low), 1)))  # few at a time: long documents
    for at in range(0, VALUES + MORE, step):
        least[at : at + step] = ((low[None, :] ^ _XOR[at : at + step, None]) * _TIMES[at : at + step, None]).min(axis=1)
    return (_mixed(least.astype(np.uint64)) >> np.uint64(48)).astype(np.uint16)


def packed(sig: np.ndarray) -> bytes:
    """The signature as kept: VALUES of 16 bits, MORE of 8."""
    return sig[:VALUES].tobytes() + sig[VALUES:].astype(np.uint8).tobytes()


def unpacked(kept: list[bytes]) -> np.ndarray:
    """Rows of VALUES + MORE numbers."""
    raw = np.frombuffer(b"".join(kept), np.uint8).reshape(len(kept), 2 * VALUES + MORE)
    return np.concatenate([np.ascontiguousarray(raw[:, : 2 * VALUES]).view(np.uint16), raw[:, 2 * VALUES :].astype(np.uint16)], axis=1)


def join_keys(sig: np.ndarray, chunks: int = CHUNKS, distance: int = DISTANCE) -> np.ndarray:
    """Keys of which signatures share one if they differ in at most ``distance`` values: all allowed errors of each chunk."""
    kept, starts = _key_plan(sig.shape[-1], chunks, distance)
    return _keyed(sig[None, :], kept, starts)[0]


def _key_plan(values: int, chunks: int, distance: int) -> tuple[list[tuple[int, ...]], np.ndarray]:
    """Places kept by each key, and what its hash starts with."""
    errors, kept, starts = distance // chunks, [], []
    for number, at in enumerate(np.array_split(np.arange(values), chunks)):
        for kind, places in enumerate(itertools.combinations(at.tolist(), max(len(at) - errors, 0))):
            kept.append(places)
            starts.append((number + 1) * 1_000_003 + kind)
    return kept, np.array(starts, np.uint64)


def _keyed(sigs: np.ndarray, kept: list[tuple[int, ...]], starts: np.ndarray) -> np.ndarray:
    """Keys, a row for each row of signatures."""
    out = np.empty((len(sigs), len(kept)), np.uint64)
    for k, places in enumerate(kept):
        h = np.full(len(sigs), starts[k], np.uint64)
        for i in places:
            h = _mixed(h * np.uint64(0x9E3779B97F4A7C15) + sigs[:, i] + np.uint64(1))
        out[:, k] = h
    return out


_KEPT, _STARTS = _key_plan(VALUES, CHUNKS, DISTANCE)


def linked(n_a: int, n_b: int, common: int, similarity: int = SIMILARITY) -> bool:
    return 100 * common >= similarity * (n_a + n_b - common) and common > 0


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, set_hash (of the set; null if empty), sig, for every whole text."""
    bounded_batches(session_of(docs))

    def every(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in portions(released(batches)):
            sizes, sets, sigs = [], [], []
            for text in batch.column(1).to_pylist():
                hashes = shingles(text)
                sizes.append(len(hashes))
                sets.append(xxhash.xxh3_128_hexdigest(hashes.tobytes()) if len(hashes) else None)
                sigs.append(packed(signature(hashes)) if len(hashes) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(sets, pa.string()), pa.array(sigs, pa.binary())], names=["doc_id", "n_shingles", "set_hash", "sig"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(every, "doc_id long, n_shingles long, set_hash string, sig binary")


def _with_keys(reps: DataFrame) -> DataFrame:
    """rep, n_shingles, sig, keys (of the signature, in the plan's order)."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, 2048):
            if batch.num_rows:
                made = _keyed(unpacked(batch["sig"].to_pylist()), _KEPT, _STARTS).view(np.int64)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(made) + 1) * made.shape[1], pa.int32()), pa.array(made.ravel()))
                yield pa.RecordBatch.from_arrays([batch["rep"], batch["n_shingles"], batch["sig"], flat], names=["rep", "n_shingles", "sig", "keys"])

    return reps.select("rep", "n_shingles", "sig").mapInArrow(keys, "rep long, n_shingles long, sig binary, keys array<long>")


def _screened(pairs: DataFrame, reps: DataFrame, similarity: int) -> DataFrame:
    """pairs (a, b, ...) that sizes and signatures allow, with apart: the values in which they differ."""
    side = lambda c: reps.select(F.col("rep").alias(c), F.col("n_shingles").alias(f"_n{c}"), F.col("sig").alias(f"_s{c}"))
    rows = pairs.join(side("a"), "a").join(side("b"), "b")
    rows = rows.filter((F.least("_na", "_nb") * 100 >= F.greatest("_na", "_nb") * similarity))
    kept = pairs.columns
    schema = T.StructType([*pairs.schema.fields, T.StructField("apart", T.IntegerType())])

    def apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, 10_000):
            if batch.num_rows:
                differ = unpacked(batch["_sa"].to_pylist()) != unpacked(batch["_sb"].to_pylist())
                good = (differ[:, :VALUES].sum(axis=1) <= DISTANCE) & (differ.sum(axis=1) <= SCREEN)
                picked = batch.select(kept).take(pa.array(np.flatnonzero(good)))
                yield pa.RecordBatch.from_arrays([*picked.columns, pa.array(differ.sum(axis=1)[good], pa.int32())], names=[*kept, "apart"])

    return rows.select(*kept, "_sa", "_sb").mapInArrow(apart, schema)


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, pa.Table]]:
    """(left, right) of each tile, from rows sorted by tile and side."""
    rows = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if rows is None else pa.concat_tables([rows, table])
        tiles = table["tile"].to_pylist()
        cuts = [0, *(i for i in range(1, len(tiles)) if tiles[i] != tiles[i - 1]), len(tiles)]
        for a, b in zip(cuts[:-2], cuts[1:-1]):
            yield _sides(table.slice(a, b - a))
        rows = table.slice(cuts[-2]) if tiles else None
    if rows is not None and rows.num_rows:
        yield _sides(rows)


def _sides(tile: pa.Table) -> tuple[pa.Table, pa.Table]:
    left = sum(not x for x in tile["side"].to_pylist())
    return tile.slice(0, left), tile.slice(left)


def _pairs(a: list[int], b: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _verified(tiles: DataFrame, docs: DataFrame, similarity: int) -> DataFrame:
    """Links (a, b) between the sides of tiles (tile, side, rep, comp) whose full sets are similar.

    A tile gives the links that join its components, fewer than it has rows.
    """
    tiles = stage(tiles, "near_tiles")
    ids = stage(tiles.select("rep").distinct(), "near_wanted")
    wanted = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    texts = stage(docs.select(F.col("doc_id").cast("long").alias("rep"), "text").join(wanted, "rep", "left_semi"), "near_texts")
    rows = tiles.join(texts, "rep").select("tile", "side", "rep", "comp", "text")
    rows = _by_tile(rows, tiles)

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found_a, found_b = [], []
        for ones, others in _tiles(batches):
            if len(found_a) >= 10_000:
                yield _pairs(found_a, found_b)
                found_a, found_b = [], []
            for a, b in _tile_links(ones, others, similarity):
                found_a.append(a)
                found_b.append(b)
        yield _pairs(found_a, found_b)

    return stage(rows.mapInArrow(links, "a long, b long"), "near_links")


def _by_tile(rows: DataFrame, tiles: DataFrame) -> DataFrame:
    """rows with a tile's side by side, the left side first; tiles are dealt out evenly."""
    tasks = int(session_of(rows).conf.get("spark.sql.shuffle.partitions"))
    return rows.join(dealt_groups(tiles, "tile"), "tile").repartitionById(tasks, F.col("_task")).sortWithinPartitions("tile", "side", "rep").drop("_task")


def _tile_links(ones: pa.Table, others: pa.Table, similarity: int) -> Iterator[tuple[int, int]]:
    """Links that join components, by counting common shingles through the right side's sorted ones."""
    if not ones.num_rows or not others.num_rows:
        return
    parent: dict[int, int] = {}

    def top(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            x = p
        return x

    sets = [shingles(t) for t in others["text"].to_pylist()]
    sizes, reps, comps = np.array([len(x) for x in sets]), others["rep"].to_pylist(), others["comp"].to_pylist()
    every = np.concatenate(sets)
    order = np.argsort(every, kind="stable")
    every, owner = every[order], np.repeat(np.arange(len(sets)), sizes)[order]
    for rep, comp, text in zip(ones["rep"].to_pylist(), ones["comp"].to_pylist(), ones["text"].to_pylist()):
        own = shingles(text)
        first, last = np.searchsorted(every, own, "left"), np.searchsorted(every, own, "right")
        many = last - first
        at = np.repeat(first - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum()) if len(own) else np.zeros(0, np.int64)
        common = np.bincount(owner[at], minlength=len(sets))
        for i in np.flatnonzero((common > 0) & (100 * common >= similarity * (len(own) + sizes - common))):
            a, b = top(comp), top(comps[i])
            if a != b:
                parent[max(a, b)] = min(a, b)
                yield rep, reps[i]


def _confirmed(pairs: DataFrame, reps: DataFrame, docs: DataFrame, similarity: int, tile: int) -> DataFrame:
    """Links of pairs (a, b): a tile holds one b and up to ``tile`` of its a's, which are about as long as it is."""
    pairs = stage(pairs.select("a", "b").distinct(), "near_pairs")
    sizes = pairs.groupBy("b").agg(F.count(F.lit(1)).alias("_n")).join(reps.groupBy(F.col("rep").alias("b")).agg(F.max("n_shingles").alias("_w")), "b")
    sizes = stage(sizes.select("b", "_n", _tiles_of("_n", F.col("_n") * F.col("_w"), tile).alias("_tiles")), "near_sizes")
    right = lookup_join(pairs, sizes, "b", "_n", F.xxhash64("a", "b"))
    right = right.select(F.concat_ws(":", "b", F.pmod(F.xxhash64("a"), "_tiles")).alias("tile"), F.lit(True).alias("side"), F.col("a").alias("rep"))
    left = sizes.select("b", F.explode(F.sequence(F.lit(0), F.col("_tiles") - 1)).alias("_t")).select(F.concat_ws(":", "b", "_t").alias("tile"), F.lit(False).alias("side"), F.col("b").alias("rep"))
    return _verified(left.union(right).withColumn("comp", F.col("rep")), docs, similarity)


def _tiles_of(rows: str | Column, shingles: str | Column, tile: int) -> Column:
    """Tiles that so many rows with so many shingles ask for."""
    rows, shingles = (F.col(x) if isinstance(x, str) else x for x in (rows, shingles))
    return F.greatest(F.ceil(rows / tile), F.ceil(shingles / TILE_SHINGLES), F.lit(1)).cast("int")


def _sided(rows: DataFrame, group: str, *carried: str) -> DataFrame:
    """tile, side, rep, comp of groups (rows: group, rep, comp, _main, _lefts, _rights): what isn't of the main component on the left, everything on the right."""
    at = lambda n: F.pmod(F.xxhash64("rep"), n).cast("int")
    tiles = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias("_t")
    left = rows.filter("comp <> _main").select(group, *carried, "rep", "comp", at("_lefts").alias("_o"), tiles("_rights"))
    right = rows.select(group, *carried, "rep", "comp", at("_rights").alias("_o"), tiles("_lefts"))
    left = left.select(F.concat_ws(":", group, "_o", "_t").alias("tile"), F.lit(False).alias("side"), *carried, "rep", "comp")
    return left.union(right.select(F.concat_ws(":", group, "_t", "_o").alias("tile"), F.lit(True).alias("side"), *carried, "rep", "comp"))


def _with_tiles(rows: DataFrame, group: str, tile: int) -> DataFrame:
    """_all (rows), _main, _lefts, _rights and _cost (rows of all tiles) of groups that hold several components."""
    by_comp = rows.groupBy(group, "comp").agg(F.count(F.lit(1)).alias("_c"), F.sum("n_shingles").alias("_w"))
    sums = by_comp.groupBy(group).agg(F.count(F.lit(1)).alias("_comps"), F.max(F.struct("_c", "comp", "_w")).alias("_largest"), F.sum("_c").alias("_all"), F.sum("_w").alias("_weight")).filter("_comps > 1")
    others = F.col("_all") - F.col("_largest._c")
    lefts, rights = _tiles_of(others, F.col("_weight") - F.col("_largest._w"), tile), _tiles_of("_all", "_weight", tile)
    sums = sums.select(group, "_all", F.col("_largest.comp").alias("_main"), others.alias("_others"), lefts.alias("_lefts"), rights.alias("_rights"))
    sums = sums.withColumn("_cost", F.col("_all") * F.col("_lefts") + F.col("_others") * F.col("_rights")).drop("_others")
    return stage(sums, "near_groups")


def _candidates(rest: DataFrame, reps: DataFrame, tile: int, similarity: int) -> DataFrame:
    """Pairs (a, b) in large keys, of different components, that sizes and signatures allow.

    rest: key, kn (the key's number in the plan), rep, comp, _main (the largest
    component of the key), _lefts and _rights (tiles of what isn't of it, and of
    everything).  A pair is given in the first key that it shares.
    """
    tiles = stage(_sided(rest, "key", "kn"), "near_tiles")
    rows = tiles.join(reps.select("rep", "n_shingles", "sig"), "rep").select("tile", "kn", "side", "rep", "comp", "n_shingles", "sig")
    kept = np.array(_KEPT)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found_a, found_b = [], []
        for ones, others in _tiles(batches):
            if len(found_a) >= 10_000:
                yield _pairs(found_a, found_b)
                found_a, found_b = [], []
            if not ones.num_rows or not others.num_rows:
                continue
            a, b, kn = unpacked(ones["sig"].to_pylist()), unpacked(others["sig"].to_pylist()), ones["kn"][0].as_py()
            reps_a, reps_b, comps_b, sizes_b = (others[c].to_numpy() if i else ones["rep"].to_numpy() for i, c in enumerate(("", "rep", "comp", "n_shingles")))
            for i, (rep, comp, size) in enumerate(zip(reps_a, ones["comp"].to_pylist(), ones["n_shingles"].to_pylist())):
                differ = b != a[i]
                good = (comps_b != comp) & (differ[:, :VALUES].sum(axis=1) <= DISTANCE) & (differ.sum(axis=1) <= SCREEN) & (np.minimum(sizes_b, size) * 100 >= np.maximum(sizes_b, size) * similarity)
                hit = np.flatnonzero(good)
                if len(hit) and kn:  # not those that share a key before this one
                    hit = hit[differ[hit][:, kept[:kn]].any(axis=2).all(axis=1)]
                found_a += [int(rep)] * len(hit)
                found_b += reps_b[hit].tolist()
        yield _pairs(found_a, found_b)

    out = _by_tile(rows, tiles).mapInArrow(pairs, "a long, b long")
    return out.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))


def _contracted(links: DataFrame) -> DataFrame:
    """u and v, the smallest node that the links of its partition connect it with, for every node of a partition."""

    def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def top(x: int) -> int:
            root = x
            while (p := parent.setdefault(root, root)) != root:
                root = p
            while x != root:
                parent[x], x = root, parent[x]
            return root

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                a, b = top(a), top(b)
                if a != b:
                    parent[max(a, b)] = min(a, b)
        nodes = [x for x in parent if top(x) != x]
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([top(x) for x in nodes], pa.int64())], names=["u", "v"])

    return links.select("a", "b").mapInArrow(contract, "u long, v long")


def components(links: DataFrame, local: int = LOCAL_LINKS) -> DataFrame:
    """rep and comp (the smallest rep reachable) of every rep in links (a, b) but the smallest ones.

    Portions of at most about ``local`` links are contracted each in a task.  If
    there are several, alternating stars join them: each round hangs neighbours
    under the smallest one, until nothing moves.  Rounds are staged, so no lineage
    grows.
    """
    parts = -(-links.count() // local)
    edges = stage(_contracted(links.coalesce(max(1, parts))).distinct() if parts > 1 else _contracted(links.coalesce(1)), "cc_links")
    before = None
    while parts > 1:
        both = edges.union(edges.select(F.col("v"), F.col("u")))
        least = stage(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("_n")), "cc_least")
        large = lookup_join(both, least, "u", "_n", F.xxhash64("u", "v")).filter("v > u and v <> m")  # a star's centre is in no task as a whole
        large = stage(large.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "cc_large")
        least = stage(large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("_n")), "cc_least")
        small = lookup_join(large, least, "u", "_n", F.xxhash64("u", "v"))
        small = small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct()
        edges = stage(small, "cc_round")
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    return edges.groupBy("u").agg(F.min("v").alias("comp")).select(F.col("u").alias("rep"), "comp")


def near_duplicates(docs: DataFrame, *, similarity: int = SIMILARITY, tile: int = TILE) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Documents are linked if 100 times the intersection of their sets is at least
    ``similarity`` times the union.  component_id is the smallest doc_id
    reachable; the document of that id is kept.  Null and wordless texts have an
    empty set, link with nothing and stay.  Rows that repeat a doc_id are one
    document if their texts are alike, and linked through it if not; a row with a
    null doc_id is its own component (null) and stays, and others aren't linked
    through it.  Very long texts are compared whole.  An empty table gives no rows;
    other columns are ignored, whatever their names.
    """
    marked, labels = _resolved(docs, similarity, tile)
    return _labelled(marked, labels).select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, **how) -> DataFrame:
    """One document of each component, the one of the smallest doc_id, with all columns."""
    gone = near_duplicates(docs, **how).filter("not kept").select("doc_id").distinct()
    return by_id(docs, gone, "left_anti").select(*docs.columns)


def _labelled(marked: DataFrame, labels: DataFrame) -> DataFrame:
    """component_id of every document, through its set's."""
    sets = marked.filter("set_hash is not null and doc_id is not null").groupBy("set_hash").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("_n"))
    sets = stage(sets.join(labels, "rep", "left").select("set_hash", "_n", F.coalesce("comp", "rep").alias("component_id")), "near_sets", keep=True)
    rows = marked.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("set_hash")).alias("set_hash"))
    out = lookup_join(rows, sets, "set_hash", "_n", F.xxhash64("doc_id", "n_shingles"))
    return out.withColumn("component_id", F.coalesce("component_id", "doc_id"))


def _resolved(docs: DataFrame, similarity: int, tile: int) -> tuple[DataFrame, DataFrame]:
    """Fingerprints, and (rep, comp) of the representatives that are linked with others."""
    marked = stage(fingerprints(docs), "near_marked", keep=True)
    with scratch():
        # one row for each different set, however many rows have it
        own = marked.filter("set_hash is not null and doc_id is not null").groupBy("set_hash").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig"))
        reps = stage(_with_keys(own), "near_reps")
        keys = reps.select("rep", "n_shingles", F.posexplode("keys").alias("kn", "key"))
        shared = stage(keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("rep").alias("pivot")).filter("n > 1"), "near_shared")
        members = stage(lookup_join(keys, shared, "key", "n", F.xxhash64("rep", "key"), found=True), "near_members")

        few = members.filter(F.col("n") <= FEW).select("key", "rep")
        every = few.alias("x").join(few.select("key", F.col("rep").alias("b")).alias("y"), "key").filter("rep > b").select(F.col("rep").alias("a"), "b", F.lit(True).alias("few"))
        pivots = members.filter((F.col("n") > FEW) & (F.col("rep") != F.col("pivot"))).select(F.col("rep").alias("a"), F.col("pivot").alias("b"), F.lit(False).alias("few"))
        pairs = every.union(pivots).groupBy("a", "b").agg(F.max("few").alias("few"))
        near = _screened(pairs, reps, similarity)
        nearest = near.withColumn("_r", F.row_number().over(Window.partitionBy("a", "few").orderBy("apart", "b"))).filter(F.col("few") | (F.col("_r") <= NEAREST))
        links = _confirmed(nearest, reps, docs, similarity, tile)
        labels = stage(components(links), "near_labels")

        rest = members.filter(F.col("n") > FEW).join(labels, "rep", "left")
        rest = stage(rest.select("key", "kn", "pivot", "rep", "n_shingles", F.coalesce("comp", "rep").alias("comp")), "near_large")
        rest = stage(lookup_join(rest, _with_tiles(rest, "key", tile), "key", "_all", F.xxhash64("rep", "key"), found=True).drop("_all"), "near_rest")
        if rest.isEmpty():
            return marked, stage(labels, "near_labels", keep=True)
        # large keys hang together in clusters; a dense one is tiled as a whole, once instead of key by key
        edges = rest.filter("rep <> pivot").select(F.col("rep").alias("a"), F.col("pivot").alias("b"))
        cluster = stage(components(edges), "near_clusters")
        rest = stage(rest.join(_renewed(cluster).withColumnRenamed("comp", "cluster"), "rep", "left").withColumn("cluster", F.coalesce("cluster", "rep")), "near_rest")
        by_key = rest.select("cluster", "key", "_cost").distinct().groupBy("cluster").agg(F.sum("_cost").alias("_by_key"))
        once = stage(rest.groupBy("cluster", "rep", "comp").agg(F.max("n_shingles").alias("n_shingles")), "near_once")
        dense = stage(_with_tiles(once, "cluster", tile).join(by_key, "cluster").filter("_cost <= _by_key").drop("_by_key"), "near_dense")
        more = _verified(_sided(lookup_join(once, dense, "cluster", "_all", F.xxhash64("rep"), found=True), "cluster"), docs, similarity)
        sparse = lookup_join(rest, dense.select("cluster", "_all", F.lit(True).alias("_dense")), "cluster", "_all", F.xxhash64("rep", "key")).filter("_dense is null").drop("_dense", "_all")
        if not sparse.isEmpty():
            more = more.union(_confirmed(_candidates(sparse, reps, tile, similarity), reps, docs, similarity, tile))
        return marked, stage(components(more.union(links)), "near_labels", keep=True)


def _renewed(df: DataFrame) -> DataFrame:
    """The same columns under new identities."""
    return df.select(*(F.col(c).alias(c) for c in df.columns))
