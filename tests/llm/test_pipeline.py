import os
import random
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from tideline.llm import common, entry, near_dedup, tokens
from tideline.llm.tokens import encoder

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_on_a_small_corpus(spark, tmp_path):
    draw = random.Random(1)
    tongue = {"en": "the of and to in that is was for with".split(), "fr": "le de la et les des en un du une".split()}
    rows = []
    for i in range(120):
        lang = draw.choice(["en", "fr"])
        rows.append((i, " ".join(draw.choice(tongue[lang]) + str(draw.randrange(50)) for _ in range(40)), lang, draw.choice("ab"), 0))
    rows += [(200 + i, rows[i][1], rows[i][2], "a", 0) for i in range(10)]  # exact copies
    rows += [(300 + i, rows[20 + i][1] + " more", rows[20 + i][2], "b", 0) for i in range(10)]  # near copies
    rows += [(400, None, "en", None, None), (401, "12 34", "en", "a", 5), (402, "", None, "b", 0)]
    docs = spark.createDataFrame(rows, DOCS)
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:3]:
        kept = stage(spark, kept, str(tmp_path))
        assert kept.columns == docs.columns
        ids = sorted(r.doc_id for r in kept.select("doc_id").collect())
        if name == "language_id":
            assert ids == sorted(r[0] for r in rows if r[0] < 400)
        if name == "exact_dedup":
            assert ids == sorted([*range(10, 120), *range(200, 210), *range(300, 310)])
        if name == "near_dedup":
            assert ids == sorted([*range(10, 120), *range(200, 210)])
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.groupBy("sequence_id").sum("length").agg({"sum(length)": "max"}).first()[0] <= 1024
    assert {r.doc_id for r in out.select("doc_id").distinct().collect()} <= {*range(10, 120), *range(200, 210)}
    whole, text = {}, {r[0]: r[1] for r in rows}
    for r in out.orderBy("doc_id", "sequence_id", "piece").collect():
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
        whole.setdefault(r.doc_id, []).append(np.frombuffer(bytes(r.ids), "<u4").tolist())
    for i, parts in whole.items():
        ids = encoder("byte_bpe_50k.json").tokenizer.encode(text[i], add_special_tokens=False).ids + [2]
        assert all(p == ids for p in parts) and len(parts) <= 2  # short documents, taken once or twice


def test_stages_on_odd_tables(spark, tmp_path):
    """Nulls, repeated rows, ties, clashing names and empty tables: what each stage says it does with them."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, kept boolean, _row string, size int"
    prose = "the house is near the river and the road to the town goes along it for many miles"
    rows = [(None, prose, "en", None, 1, 1.5, None, "r", 7), (None, None, None, None, None, None, None, None, None), (5, prose + " once more", "en", "a", 1, 2.5, True, "s", 8), (5, prose + " once more", "en", "a", 1, 2.5, True, "s", 8), (6, "½ ²", "en", "a", 1, 0.0, None, None, 1)]
    docs = spark.createDataFrame(rows, schema)
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:4]:
        kept = stage(spark, kept, str(tmp_path))
        assert kept.columns == docs.columns, name
        if name == "language_id":
            assert sorted((r.doc_id or 0, r.score) for r in kept.collect()) == [(0, 1.5), (5, 2.5), (5, 2.5)]
    assert {r.doc_id for r in kept.collect()} <= {None, 5} and {r.size for r in kept.collect()} <= {7, 8}
    packed = corpus_pipeline.STAGES[4][1](spark, kept, str(tmp_path))
    assert packed.count() == kept.count()
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, str(tmp_path))
        assert empty.count() == 0, name


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_registered_queries_run(spark):
    import duckdb

    sf = "/root/testdata/sf0.001"
    made = {name: q(spark, sf) for name, q in entry.queries().items()}
    n = spark.read.parquet(f"{sf}/documents.parquet").count()
    for name, df in made.items():
        if name not in ("op4_best_fit_packing", "op5_nearest_neighbours", "pipeline"):
            assert df.count() == n, name
    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    want = c.sql(f"select doc_id, keep_id, group_size, kept, text_sha256 from ({entry.OP2})").fetchall()
    assert sorted(want) == sorted(tuple(r) for r in made["op2_exact_dedup"].select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect())
    comp = {r.doc_id: r.component_id for r in made["op9_near_dedup"].collect()}
    sets = {r.doc_id: set(near_dedup.shingles(r.text).tolist()) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    ids = sorted(sets)
    top = {i: i for i in ids}

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for k, i in enumerate(ids):
        for j in ids[:k]:
            common = len(sets[i] & sets[j])
            if common and 100 * common >= 75 * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                top[max(a, b)] = min(a, b)
    assert comp == {i: root(i) for i in ids}  # both ways: every link is found, and no other


def test_workers_keep_no_words_of_near_dedup():
    """Later stages run in the same workers: hashes of 100,000 words held 10 MB and more there."""
    near_dedup.shingles("a b c d e f")
    tracemalloc.start()
    try:
        for k in range(100):
            near_dedup.shingles(" ".join(f"word{k}x{i}" for i in range(1000)))
        assert tracemalloc.get_traced_memory()[0] < 2 << 20
    finally:
        tracemalloc.stop()


def test_a_share_of_the_cache_gives_the_same_ids(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_BYTES", 40_000)
    e = tokens.Encoder("byte_bpe_50k.json", 0.5)
    texts = [" ".join(f"word{k}{i}" for i in range(100)) for k in range(20)]
    for _ in range(2):
        for text, ids in zip(texts, e.batch(texts)):
            assert np.frombuffer(ids, "<u4").tolist() == e.tokenizer.encode(text, add_special_tokens=False).ids
    assert 10_000 < e.held <= 20_000


def test_arrow_returns_memory_between_batches(monkeypatch):
    freed = []

    class Pool:
        def release_unused(self):
            freed.append(1)

    monkeypatch.setattr(common.pa, "default_memory_pool", Pool)
    batches = [pa.RecordBatch.from_pydict({"x": [k, k + 1]}) for k in range(3)]
    assert list(common.released(iter(batches))) == batches and len(freed) == 3
