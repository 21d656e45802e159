import random
import re

import pytest
from pyspark.sql import functions as F

from tideline.llm import exact_dedup, near_dedup, substring_dedup

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)


def words(seed, n, vocabulary=400):
    draw = random.Random(seed)
    return [f"w{draw.randrange(vocabulary)}" for _ in range(n)]


ROWS = [(1, "a"), (2, "a"), (3, None), (4, ""), (5, "b"), (6, "a "), (7, "A"), (8, "é" * 50_000), (9, "é" * 50_000)]


@pytest.mark.parametrize("weak", [False, True])
@pytest.mark.parametrize("keep", ["min", "max"])
def test_exact_groups_by_bytes(spark, keep, weak):
    import hashlib

    how = {"hash_of": lambda c: F.substring(F.md5(c), 1, 0)} if weak else {}  # all texts collide
    got = {r.doc_id: r for r in exact_dedup.exact_duplicates(docs(spark, ROWS), keep=keep, **how).collect()}
    assert len(got) == len(ROWS)
    for i, t in ROWS:
        same = [j for j, u in ROWS if (u or "") == (t or "")]
        best = (min if keep == "min" else max)(same)
        assert (got[i].keep_id, got[i].group_size, got[i].kept) == (best, len(same), i == best)
        assert got[i].text_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    kept = exact_dedup.drop_exact_duplicates(docs(spark, ROWS), keep=keep, **how)
    assert kept.columns == docs(spark, ROWS).columns and sorted(r.doc_id for r in kept.collect()) == sorted(i for i in got if got[i].kept)


def test_exact_null_ids_repeats_and_clashing_columns(spark):
    rows = spark.createDataFrame([(None, "x", 1), (None, "x", 2), (5, "y", 3), (5, "y", 3), (None, "y", 4)], "doc_id long, text string, keep_id int")
    got = exact_dedup.exact_duplicates(rows, keep="max").collect()
    assert sorted((r.doc_id or -1, r.keep_id or -1, r.group_size, r.kept) for r in got) == [(-1, -1, 2, True), (-1, -1, 2, True), (-1, 5, 3, False), (5, 5, 3, True), (5, 5, 3, True)]
    assert exact_dedup.exact_duplicates(rows.limit(0)).count() == 0
    with pytest.raises(ValueError):
        exact_dedup.exact_duplicates(rows, keep="first")


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute_components(rows):
    sets = {i: shingle_set(t) for i, t in rows}
    comp = {i: i for i in sets}

    def top(x):
        while comp[x] != x:
            x = comp[x]
        return x

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            n = len(sets[i] & sets[j])
            if n and 100 * n >= 75 * len(sets[i] | sets[j]):
                a, b = top(i), top(j)
                comp[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), top(i)) for i in ids}


def corpus(seed=1):
    """Clean texts, chains of near copies, a dense group, a passage that many share, odd ones."""
    draw, rows, at = random.Random(seed), [], 0

    def put(text):
        nonlocal at
        at += draw.randrange(1, 4)
        rows.append((at, text))

    base = words(99, 120)
    for k in range(60):
        own = list(base)
        for _ in range(draw.randrange(0, 9)):
            own[draw.randrange(len(own))] = f"x{draw.randrange(10**6)}"
        put(" ".join(own))
    chain = words(98, 100)
    for k in range(12):
        put(" ".join(chain[k * 4 :] + [f"tail{k}"]))
    shared = words(97, 40)
    for k in range(60):
        put(" ".join(words(k, draw.randrange(5, 60)) + shared))
    for k in range(60):
        put(" ".join(words(1000 + k, draw.randrange(1, 80))))
    for t in (None, "", " \t\n", "one", "One", "one two three four", "one  two three\nfour", "a b c d e f", "A b c d e f", "éÉ b c d e", "éé b c d e", " ".join(words(5, 30_000, 10**6))):
        put(t)
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize("tile", [256, 4])
def test_near_components_equal_brute_force(spark, tile):
    rows = corpus()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(docs(spark, rows), tile=tile).collect()}
    assert got == brute_components(rows)
    if tile == 256:
        kept = near_dedup.drop_near_duplicates(docs(spark, rows))
        assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, c in got.values()}) and kept.columns == docs(spark, rows).columns


def test_near_sparse_clusters_are_resolved_key_by_key(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "_with_tiles", lambda rows, group, tile, real=near_dedup._with_tiles: real(rows, group, tile).withColumn("_cost", F.lit(10**9 if group == "cluster" else 1)))
    rows = corpus(2)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(docs(spark, rows), tile=8).collect()}
    assert got == brute_components(rows)


def test_near_nulls_repeats_and_empty_tables(spark):
    rows = spark.createDataFrame([(None, "a b c d e f", 1), (4, "a b c d e f", 2), (4, "a b c d e f", 3), (3, "a b c d e f", 4), (5, None, 5), (6, None, 6)], "doc_id long, text string, component_id int")
    got = sorted(((r.doc_id or -1), (r.component_id or -1), r.kept) for r in near_dedup.near_duplicates(rows).collect())
    assert got == [(-1, -1, True), (3, 3, True), (4, 3, False), (4, 3, False), (5, 5, True), (6, 6, True)]
    assert near_dedup.near_duplicates(rows.limit(0)).count() == 0
    kept = near_dedup.drop_near_duplicates(rows)
    assert kept.columns == rows.columns and sorted(r.component_id for r in kept.collect()) == [1, 4, 5, 6]


def test_near_repeated_rows_are_one_set(spark, monkeypatch):
    """5,000 rows of two documents are two representatives, and one pair."""
    staged = {}
    real = near_dedup.stage
    monkeypatch.setattr(near_dedup, "stage", lambda df, name, **how: staged.setdefault(name, []).append((out := real(df, name, **how)).count()) or out)
    base = words(3, 60)
    rows = [(i % 2, " ".join([*base, "end"] if i % 2 else base)) for i in range(5000)]
    got = near_dedup.near_duplicates(docs(spark, rows).repartition(8))
    assert sorted((r.doc_id, r.component_id, r["count"]) for r in got.groupBy("doc_id", "component_id").count().collect()) == [(0, 0, 2500), (1, 0, 2500)]
    assert staged["near_reps"] == [2] and staged["near_pairs"] == [1] and staged["near_members"][0] <= 80


def test_signatures_under_the_distance_share_a_key():
    import numpy as np

    draw = np.random.default_rng(1)
    for _ in range(200):
        a = draw.integers(0, 1 << 16, near_dedup.VALUES).astype(np.uint16)
        b = a.copy()
        at = draw.choice(near_dedup.VALUES, near_dedup.DISTANCE, replace=False)
        b[at] ^= draw.integers(1, 1 << 16, near_dedup.DISTANCE).astype(np.uint16)
        assert set(near_dedup.join_keys(a)) & set(near_dedup.join_keys(b))
    far = draw.integers(0, 1 << 16, near_dedup.VALUES).astype(np.uint16)
    assert not set(near_dedup.join_keys(a)) & set(near_dedup.join_keys(far))


def test_components_of_chains(spark):
    links = spark.createDataFrame([(i + 1, i) for i in range(300)] + [(1000 + 7 * i, 1000 + 3 * i) for i in range(100)], "a long, b long")
    assert sorted(map(tuple, near_dedup.components(links).collect())) == sorted(map(tuple, near_dedup.components(links, 40).collect()))
    assert {r.comp for r in near_dedup.components(links).collect() if r.rep <= 300} == {0}


def own_sentences(text):
    """Sentences by a walk over the characters, for the brute force."""
    out, held, i = [], "", 0
    while i < len(text):
        held += text[i]
        ends = text[i] == "\n" or text[i] in ".!?…।۔؟" and i + 1 < len(text) and text[i + 1].isspace() or text[i] in "。！？｡" and text[i + 1 : i + 2] not in tuple("。！？｡")
        i += 1
        if ends:
            while i < len(text) and text[i].isspace():
                held += text[i]
                i += 1
            out, held = [*out, held], ""
    pieces = []
    for x in [*out, held] if held else out:
        if pieces and not x.strip():
            pieces[-1] += x
        else:
            pieces.append(x)
    return pieces


def brute_repeats(rows):
    """Sentences that some run other than the first of its kind covers, over all runs of all lengths that count."""
    first, gone = set(), {}
    for i, t in sorted((i, t or "") for i, t in rows):
        bodies = [tuple(x.split()) for x in own_sentences(t)]
        for k in range(len(bodies)):
            for end in range(k + 1, len(bodies) + 1):
                span = tuple(bodies[k:end])
                if len(span) >= 3 or sum(map(len, span)) >= (20 if len(span) == 2 else 51):
                    if span in first:
                        gone.setdefault(i, set()).update(range(k, end))
                    first.add(span)
    return gone


def test_repeated_spans_equal_brute_force(spark):
    draw = random.Random(4)
    pool = [" ".join(words(k, draw.randrange(1, 12))).capitalize() + draw.choice([".", "!", "?", "...", "", "。", "。。"]) for k in range(40)]
    rows = [(i, draw.choice([" ", "\n", "  \n"]).join(draw.choice(pool) for _ in range(draw.randrange(0, 25)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, rows[3][1]), (103, "no end"), (104, "é. " * 100), (105, " \n . \n. a")]
    gone = brute_repeats(rows)
    got = {r.doc_id: r for r in substring_dedup.remove_repeats(docs(spark, rows)).collect()}
    for i, t in rows:
        at = own_sentences(t or "")
        out = gone.get(i, set())
        assert got[i].n_removed == len(out) and got[i].n_sentences == len(at)
        assert got[i].text == ("".join(x for k, x in enumerate(at) if k not in out) if out else t)
        assert "".join((t or "")[int(a) : int(b)] for a, b in (x.split(":") for x in got[i].removed.split(",") if x)) == "".join(at[k] for k in sorted(out))
    assert substring_dedup.remove_repeats(docs(spark, rows).limit(0)).count() == 0


@pytest.mark.parametrize("text", ["." * 200_000, ". " * 100_000, "!" * 200_000 + "1", "。" * 200_000, "\n" * 200_000, "word " * 40_000, "ｗ。" * 100_000])
def test_long_texts_are_cut_in_time_in_proportion(text):
    import time

    began = time.perf_counter()
    assert substring_dedup.sentences(text)[-1][1] == len(text)
    assert time.perf_counter() - began < 1


def test_unspaced_scripts_have_words(spark):
    pair = "我们今天去城里的市场买了很多新鲜的蔬菜和水果。" * 2 + "然后我们坐在河边的茶馆里聊了整整一个下午的时间。" * 2
    rows = [(i, f"开头{i}。{pair}结尾{i}。") for i in range(2)]
    assert {r.doc_id: r.n_removed for r in substring_dedup.remove_repeats(docs(spark, rows)).collect()}[1] == 4


def test_a_passage_in_the_middle_of_texts_goes_but_once(spark):
    passage = ". ".join(" ".join(words(50 + k, 12)) for k in range(5)) + "."
    rows = [(i, f"{' '.join(words(i, 30))}. {passage} {' '.join(words(900 + i, 30))}.") for i in range(5)] + [(9, " ".join(words(9, 50)) + ". " + " ".join(words(19, 20)) + ".")]
    got = {r.doc_id: r for r in substring_dedup.remove_repeats(docs(spark, rows)).collect()}
    assert passage in got[0].text and all(passage not in got[i].text and got[i].n_removed == 5 for i in range(1, 5)) and got[9].n_removed == 0
    odd = spark.createDataFrame([(None, passage, 1), (None, passage, 4), (1, passage, 2), (1, passage, 2)], "doc_id long, text string, removed int")
    got = substring_dedup.remove_repeats(odd).collect()
    assert [r.n_removed for r in got] == [0] * 4 and sorted(r.removed_in for r in got) == [1, 2, 2, 4]  # a clashing column stays, renamed


def test_the_tail_of_a_repeated_run_goes(spark):
    passage = " ".join(f"{' '.join(words(k, n))}." for k, n in ((1, 30), (2, 10), (3, 5)))
    rows = [(i, f"{' '.join(words(10 + i, 9))}. {passage} {' '.join(words(20 + i, 9))}.") for i in range(2)] + [(2, passage)]
    got = {r.doc_id: r.n_removed for r in substring_dedup.remove_repeats(docs(spark, rows)).collect()}
    assert got == {0: 0, 1: 3, 2: 3}
    draw = random.Random(5)
    pool = [" ".join(words(k, draw.choice([1, 2, 4, 9, 18, 30, 60]))) + "." for k in range(14)]
    rows = [(i, " ".join(draw.choice(pool) for _ in range(draw.randrange(1, 14)))) for i in range(60)]
    gone = brute_repeats(rows)
    got = {r.doc_id: r.n_removed for r in substring_dedup.remove_repeats(docs(spark, rows)).collect()}
    assert got == {i: len(gone.get(i, ())) for i, _ in rows}


def test_short_sentences_go_in_threes(spark):
    rows = [(i, f"{' '.join(words(10 + i, 9))}. Yes. No. {' '.join(words(30 + i, 9))}.") for i in range(2)] + [(2 + i, f"{' '.join(words(50 + i, 9))}. Yes. So. Well. {' '.join(words(70 + i, 9))}.") for i in range(2)]
    assert {r.doc_id: r.n_removed for r in substring_dedup.remove_repeats(docs(spark, rows)).collect()} == {0: 0, 1: 0, 2: 0, 3: 3}


def test_a_long_sentence_goes_on_its_own(spark):
    rows = [(2 * n + i, f"{' '.join(words(10 * n + i, 9))}. {' '.join(words(n, n))}. {' '.join(words(10 * n + i + 5, 9))}.") for n in (50, 51) for i in range(2)]
    got = {r.doc_id: r.n_removed for r in substring_dedup.remove_repeats(docs(spark, rows)).collect()}
    assert got == {100: 0, 101: 0, 102: 0, 103: 1}
