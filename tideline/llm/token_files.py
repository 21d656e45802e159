"""Token-id files as directly addressable codes.

A segment holds the ids of some documents.  Ids are split into chunks of
``bits`` bits, the lowest first.  Level k holds the k-th chunk of every id that has
one, a continuation bitmap (does the id go on at the next level?) and a rank
directory (ones before every 512th bit of the bitmap), so that id i is found by
one look at each level: its place at the next level is the rank of its bit.

Segments are binaries in Parquet files, in ascending order of doc_id: Spark's
commit protocol keeps whole files whatever executor is lost, and any store that
Spark reaches holds them.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_batches, portions, session_of, stage, stage_path
from .tokens import END_ID, encoder

MAGIC = b"DAC1"
#: Ids at which a segment is closed, after the document that reaches it.
SEGMENT = 1 << 16
_RANK_BITS = 512


def _packed(chunks: np.ndarray, bits: int) -> bytes:
    if bits == 8:
        return chunks.astype(np.uint8).tobytes()
    if bits == 16:
        return chunks.astype("<u2").tobytes()
    return np.packbits((chunks[:, None] >> np.arange(bits)) & 1, bitorder="little").tobytes()


def encode_segment(ids: np.ndarray, bits: int = 8) -> bytes:
    """The image of ids (0 to 2**32 - 1); ``bits`` is 1 to 16."""
    if not 1 <= bits <= 16:
        raise ValueError("bits is 1 to 16")
    rest, levels = np.asarray(ids, np.uint64), []
    while len(rest):
        more = rest >> np.uint64(bits)
        goes_on = more > 0
        ones = np.concatenate([[0], np.cumsum(goes_on)])[0 : len(rest) : _RANK_BITS].astype("<u4")
        levels.append((len(rest), _packed((rest & np.uint64((1 << bits) - 1)).astype(np.int64), bits), np.packbits(goes_on, bitorder="little").tobytes(), ones.tobytes()))
        rest = more[goes_on]
    out = [MAGIC, struct.pack("<BBQ", bits, len(levels), len(ids))]
    for n, *parts in levels:
        out += [struct.pack("<QQQQ", n, *map(len, parts)), *parts]
    return b"".join(out)


class Segment:
    """Ids in an image: segment[i] reads one without decoding others, all() every one."""

    def __init__(self, image: bytes) -> None:
        if image[:4] != MAGIC:
            raise ValueError("not a segment")
        self.bits, n_levels, self.n = struct.unpack_from("<BBQ", image, 4)
        self.levels, at = [], 14
        for _ in range(n_levels):
            n, *sizes = struct.unpack_from("<QQQQ", image, at)
            at += 32
            parts = []
            for size in sizes:
                parts.append(memoryview(image)[at : at + size])
                at += size
            self.levels.append((n, np.frombuffer(parts[0], np.uint8), np.frombuffer(parts[1], np.uint8), np.frombuffer(parts[2], "<u4")))

    def __len__(self) -> int:
        return self.n

    def _rank(self, level: int, i: int) -> int:
        """Ones before bit i of a level's bitmap: the place at the next level."""
        _, _, goes_on, ones = self.levels[level]
        block = i // _RANK_BITS
        before = int.from_bytes(goes_on[block * _RANK_BITS // 8 : (i >> 3) + 1].tobytes(), "little")
        return int(ones[block]) + (before & ((1 << (i - block * _RANK_BITS)) - 1)).bit_count()

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for k, (_, chunks, goes_on, _) in enumerate(self.levels):
            first = i * self.bits
            word = int.from_bytes(chunks[first >> 3 : (first + self.bits + 7) >> 3].tobytes(), "little")
            value |= (word >> (first & 7) & ((1 << self.bits) - 1)) << (k * self.bits)
            if not goes_on[i >> 3] >> (i & 7) & 1:
                break
            i = self._rank(k, i)
        return value

    def ids(self, first: int, last: int) -> np.ndarray:
        """Ids [first, last): at each level the codes from the rank of the first on, and no others."""
        if not 0 <= first <= last <= self.n:
            raise IndexError((first, last))
        out, at, begin = np.zeros(last - first, np.uint64), None, first
        for k, (_, chunks, goes_on, _) in enumerate(self.levels):
            n = len(out) if at is None else len(at)
            if not n:
                break
            if self.bits == 8:
                low = chunks[begin : begin + n].astype(np.uint64)
            elif self.bits == 16:
                low = chunks[2 * begin : 2 * (begin + n)].view("<u2").astype(np.uint64)
            else:
                bit = begin * self.bits
                held = np.unpackbits(chunks[bit >> 3 : (bit + n * self.bits + 7) >> 3], bitorder="little")[bit & 7 :][: n * self.bits]
                low = (held.reshape(n, self.bits) @ (1 << np.arange(self.bits))).astype(np.uint64)
            if at is None:
                out |= low
            else:
                out[at] |= low << np.uint64(k * self.bits)
            more = np.flatnonzero(np.unpackbits(goes_on[begin >> 3 : (begin + n + 7) >> 3], bitorder="little")[begin & 7 :][:n])
            if not len(more):
                break
            begin, at = self._rank(k, begin), more if at is None else at[more]
        return out

    def all(self) -> np.ndarray:
        return self.ids(0, self.n)


#: Codes stand in the files as they are: no page has to be decompressed to reach one.
_PLAIN = {"compression": "uncompressed", "parquet.enable.dictionary": "false"}
_FILE = "part int, segment int, first long, n_tokens long, doc_ids array<long>, lengths array<long>, image binary"


def write_token_files(docs: DataFrame, path: str, *, tokenizer: str = "word_bpe_49k.json", bits: int = 8) -> None:
    """Encode whole texts, an end id after each, and write segments to ``path`` in ascending order of doc_id.

    Null text counts as empty; a null doc_id comes first; rows that repeat a
    doc_id stand side by side, in an order that their texts fix.  A very long text is
    whole in one segment; a segment is closed after it.  An empty table gives files
    without segments.  Other columns are ignored, whatever their names.
    """
    bounded_batches(session_of(docs))
    end = np.array([END_ID], "<u4").tobytes()

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = encoder(tokenizer).batch, TaskContext.get().partitionId()
        number, first, size, ids, doc_ids, lengths = 0, 0, 0, [], [], []

        def closed() -> pa.RecordBatch:
            image = encode_segment(np.frombuffer(b"".join(ids), "<u4"), bits)
            values = ((part, pa.int32()), (number, pa.int32()), (first, pa.int64()), (size, pa.int64()), (doc_ids, pa.list_(pa.int64())), (lengths, pa.list_(pa.int64())), (image, pa.binary()))
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in values], names=["part", "segment", "first", "n_tokens", "doc_ids", "lengths", "image"])

        for batch in portions(batches):
            for doc_id, own in zip(batch.column(0).to_pylist(), encode(batch.column(1).to_pylist())):
                own += end
                ids.append(own)
                doc_ids.append(doc_id)
                lengths.append(len(own) // 4)
                size += lengths[-1]
                if size >= SEGMENT:
                    yield closed()
                    number, first, size, ids, doc_ids, lengths = number + 1, first + size, 0, [], [], []
        if doc_ids:
            yield closed()

    place = [F.asc_nulls_first("doc_id"), F.asc_nulls_first("_t")]
    ordered = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("_t")).repartitionByRange(*place).sortWithinPartitions(*place)
    ordered.select("doc_id", "text").mapInArrow(segments, _FILE).write.options(**_PLAIN).parquet(path)


def _parts(files: DataFrame) -> DataFrame:
    """part and _before, the ids of all parts before it."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = files.groupBy("part").agg(F.sum("n_tokens").alias("_n"))
    return parts.select("part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))


def token_at(spark: SparkSession, path: str, i: int) -> int:
    """Id number i of the files, counted over all documents.

    Reads the directory columns, then the one segment, of which one code a level.
    """
    files = spark.read.schema(_FILE).parquet(path)
    place = files.select("part", "segment", "first", "n_tokens").join(_parts(files), "part").withColumn("_at", F.col("_before") + F.col("first"))
    found = place.filter((F.col("_at") <= i) & (F.col("_at") + F.col("n_tokens") > i)).select("part", "segment", "_at").first()
    if found is None:
        raise IndexError(i)
    image = files.filter((F.col("part") == found["part"]) & (F.col("segment") == found["segment"])).select("image").first()["image"]
    return Segment(bytes(image))[i - found["_at"]]


def read_token_files(spark: SparkSession, path: str, *, ids: bool = False) -> DataFrame:
    """One row per document of the files: doc_id, start, n_tokens, ids_crc32, and the ids if asked for.

    start counts the ids of all documents before; only one number a file part is
    summed across the whole.  Every document is fetched by ranks from its place in
    its segment.
    """
    files = spark.read.schema(_FILE).parquet(path)
    bounded_batches(spark)
    parts = stage(_parts(files), "token_parts")  # a row a part: Spark broadcasts it if its size allows that

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            for part, first, doc_ids, lengths, image in zip(*(batch[c].to_pylist() for c in ("part", "first", "doc_ids", "lengths", "image"))):
                segment, ends = Segment(image), np.cumsum(np.array(lengths, np.int64))
                own = [segment.ids(b - n, b).astype("<u4").tobytes() for n, b in zip(lengths, ends.tolist())]
                columns = [pa.array([part] * len(own), pa.int32()), pa.array(doc_ids, pa.int64()), pa.array(first + ends - lengths, pa.int64()), pa.array(lengths, pa.int64()), pa.array([zlib.crc32(x) for x in own], pa.int64())]
                names = ["part", "doc_id", "start", "n_tokens", "ids_crc32"]
                if ids:
                    columns, names = [*columns, pa.array([np.frombuffer(x, "<u4").astype(np.int64) for x in own], pa.list_(pa.int64()))], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "part int, doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if ids else "")
    out = files.mapInArrow(documents, schema).join(parts, "part")
    return out.select("doc_id", (F.col("start") + F.col("_before")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if ids else []))


def token_files(docs: DataFrame, *, tokenizer: str = "word_bpe_49k.json", bits: int = 8) -> DataFrame:
    """Write the documents to files in the shared folder and read them back; rules as in write_token_files().

    An empty table gives no rows.
    """
    path = stage_path(session_of(docs), "token_files")
    write_token_files(docs, path, tokenizer=tokenizer, bits=bits)
    return read_token_files(session_of(docs), path)
