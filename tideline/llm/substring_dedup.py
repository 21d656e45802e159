"""Substring dedup by sliding sentence spans.

Runs of several consecutive sentences are hashed (with white space evened out) and
joined globally; the first occurrence of a run is the one in the smallest doc_id, and
there the first one.  Sentences that any other occurrence covers are removed.

A run counts that has the sentences and the words of one of the pairs in RUNS: three
sentences of any length, two of twenty words together, or one of more than fifty.
From every sentence on, and up to every sentence, the shortest such run is hashed.
Every sentence of a longer one lies in one of those within it, so they stand for
runs of every length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import beside, bounded_batches, by_id, lookup_join, portions, session_of, stage, unfolded

#: (sentences, words): what a run must have one pair of.
RUNS = ((3, 0), (2, 20), (1, 51))
#: A sentence goes up to an end mark and the white space after it, or to the end of the line.  Marks of scripts without
#: spaces need no white space.  Each alternative begins at one character, so that no text is gone over twice.
_END = re.compile(r"[.!?\u2026\u0964\u06d4\u061f]\s+|[\u3002\uff01\uff1f\uff61](?![\u3002\uff01\uff1f\uff61])\s*|\n\s*")
#: Characters of scripts that put no spaces between words; two of them count as a word.
_UNSPACED = re.compile(r"[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\U00020000-\U0003ffff]")


def sentences(text: str) -> list[tuple[int, int]]:
    """(start, end) of the sentences, which make up the whole text; pieces of white space alone go with the one before."""
    out: list[tuple[int, int]] = []
    start = 0
    for end in [*(m.end() for m in _END.finditer(text)), len(text)]:
        if end > start:
            if out and text[start:end].isspace():
                out[-1] = (out[-1][0], end)
            else:
                out.append((start, end))
            start = end
    return out


def _shortest(sizes: list[int], runs: tuple[tuple[int, int], ...]) -> Iterator[tuple[int, int]]:
    """[start, end) of the shortest run from every sentence on that counts, as far as there is one."""
    end, held = 0, 0  # sentences [i, end) and their words
    for i in range(len(sizes)):
        while not any(end - i >= n and held >= least for n, least in runs):
            if end == len(sizes):
                return
            held += sizes[end]
            end += 1
        yield i, end
        held -= sizes[i]


def span_hashes(text: str, runs: tuple[tuple[int, int], ...] = RUNS) -> list[tuple[int, int, int, int]]:
    """(first sentence's number, number of sentences, 64-bit hash, 32 bits more) of the shortest runs, by first sentence."""
    import xxhash

    words = [text[a:b].split() for a, b in sentences(text)]
    bodies, sizes = [" ".join(w) for w in words], [len(w) for w in words]
    if not text.isascii() and _UNSPACED.search(text):
        sizes = [n + len(_UNSPACED.findall(body)) // 2 for n, body in zip(sizes, bodies)]
    found, out = set(_shortest(sizes, runs)), []
    found |= {(len(sizes) - end, len(sizes) - i) for i, end in _shortest(sizes[::-1], runs)}
    for i, end in sorted(found):
        h = xxhash.xxh3_128_intdigest("\n".join(bodies[i:end]).encode())
        out.append((i, end - i, (h >> 64) - (1 << 63), (h & 0xFFFFFFFF) - (1 << 31)))
    return out


def _spans(docs: DataFrame, runs: tuple[tuple[int, int], ...]) -> DataFrame:
    """doc_id, hash, more, pos, n (sentences) of each run's first occurrence in its document; again: places of the others."""
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int32()))
    names = ["doc_id", "hash", "more", "pos", "n", "again"]

    def every(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                seen: dict[tuple[int, int, int], list[int]] = {}
                for pos, n, h, more in span_hashes(text or "", runs):
                    seen.setdefault((h, more, n), []).append(pos)
                rows += [(doc_id, h, more, at[0], n, at[1:] or None) for (h, more, n), at in seen.items()]
            columns = list(zip(*rows)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds)], names=names)

    return docs.filter("doc_id is not null").select(F.col("doc_id").cast("long"), "text").mapInArrow(every, "doc_id long, hash long, more int, pos int, n int, again array<int>")


def remove_repeats(docs: DataFrame, *, runs: tuple[tuple[int, int], ...] = RUNS) -> DataFrame:
    """The documents with text cleaned, and n_sentences, n_removed, removed (start:end in code points, comma-joined).

    A document that nothing is removed from keeps its text as it is, null too; one
    of which every sentence goes has an empty text.  Very long texts are cut whole,
    in time in proportion to their length.  Rows of a null doc_id stay as they are;
    rows that repeat a doc_id are cut alike, and none of them by the other.  An empty
    table gives no rows.  Columns that have the name of a new one stay, with _in
    behind it.
    """
    bounded_batches(session_of(docs))
    spans = stage(_spans(docs, runs), "spans")
    repeated = stage(spans.groupBy("hash", "more").agg(F.count(F.lit(1)).alias("_n"), F.min("doc_id").alias("_first")).filter("_n > 1"), "spans_repeated")
    # a run that many documents share is in no task as a whole
    found = lookup_join(spans.select("doc_id", "hash", "more", "pos", "n"), repeated, "hash", "_n", F.xxhash64("doc_id", "pos"), also=("more",), found=True)
    later = found.filter("doc_id <> _first").select("doc_id", "pos", "n")
    inside = spans.filter("again is not null").select("doc_id", F.explode("again").alias("pos"), "n")
    places = stage(later.union(inside).distinct(), "span_places").groupBy("doc_id").agg(F.collect_list(F.struct("pos", "n")).alias("_places"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.struct(*docs.columns).alias("_row"))
    return _cut(by_id(rows, places, "left"), docs)


_NEW = ["n_sentences", "n_removed", "removed"]


def _cut(rows: DataFrame, docs: DataFrame) -> DataFrame:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            texts, counts, gone, said, row = [], [], [], [], batch["_row"]
            for text, places in zip(row.field("text").to_pylist(), batch["_places"].to_pylist()):
                at = sentences(text or "")
                out = {p["pos"] + k for p in places or () for k in range(p["n"])}
                texts.append("".join(text[a:b] for i, (a, b) in enumerate(at) if i not in out) if out else text)
                counts.append(len(at))
                gone.append(len(out))
                said.append(",".join(f"{at[i][0]}:{at[i][1]}" for i in sorted(out)))
            own = [pa.array(texts, f.type) if f.name == "text" else row.field(f.name) for f in row.type]
            row = pa.StructArray.from_arrays(own, fields=list(row.type))
            yield pa.RecordBatch.from_arrays([row, pa.array(counts, pa.int64()), pa.array(gone, pa.int64()), pa.array(said, pa.string())], names=["_row", *_NEW])

    types = (T.LongType(), T.LongType(), T.StringType())
    cleaned = rows.select("_row", "_places").mapInArrow(cut, beside(docs, *(T.StructField(c, t) for c, t in zip(_NEW, types))))
    return unfolded(cleaned, docs.columns, _NEW)
