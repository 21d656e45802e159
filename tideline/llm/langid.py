"""Language identification by error-correcting output codes.

Every language has a codeword.  For each of its bits a binary classifier over
hashed character n-grams (one to three characters) predicts the bit; decoding takes
the codeword with the least loss, each bit's loss weighted by how well its
classifier does, and flags texts whose two nearest codewords are about as near.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import beside, bounded_batches, portions, session_of, unfolded

#: Hashed n-gram features.
FEATURES = 1 << 15
#: Labelled documents of each language, in expectation at most, that fit the classifiers; whole texts.
SAMPLE_PER_LANGUAGE = 2000
#: A margin is the mean log odds of a text's n-grams times their number, or times this if they are more.  One factor
#: for all bits of a text: it bears on score and ambiguous, and not on which codeword is the nearest by sign.
EVIDENCE = 40
#: One in HELD rows of the sample, by hash, weighs the bits' losses and doesn't fit their classifiers.
HELD = 4
#: Below this share of the two nearest codewords a text is ambiguous.
AMBIGUOUS = 0.6
UNDETERMINED = "und"
_MAYBE_LETTER = re.compile(r"[^\W\d_]")


def has_letter(text: str) -> bool:
    """A character of a Unicode category L; numbers such as ½ and Ⅷ, which Python's word characters hold, are none."""
    return any(unicodedata.category(m[0])[0] == "L" for m in _MAYBE_LETTER.finditer(text))


def held_out(column: str = "doc_id") -> Column:
    """crc32 of the id as text leaves 2 modulo 4; false for a null id."""
    return F.coalesce(F.crc32(F.encode(F.col(column).cast("string"), "utf-8")) % 4 == 2, F.lit(False))


def features(text: str) -> np.ndarray:
    """Numbers of the features in a lower-cased text, one for each n-gram."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    out = [c * np.uint64(0x9E3779B1)]
    if len(c) > 1:
        out.append((c[:-1] * np.uint64(0x85EBCA6B) ^ c[1:]) * np.uint64(0xC2B2AE35))
    if len(c) > 2:
        out.append(((c[:-2] * np.uint64(0x27D4EB2F) ^ c[1:-1]) * np.uint64(0x165667B1) ^ c[2:]) * np.uint64(0x9E3779B97F4A7C15))
    h = np.concatenate(out)
    return ((h ^ h >> np.uint64(15)) & np.uint64(FEATURES - 1)).astype(np.int64)


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """n rows of +1 and -1: the exhaustive code up to 7 languages, else the random code of the largest distance found."""
    if n < 2:
        return np.ones((n, 1), np.int8)
    if n <= 7:
        return np.array([[1 if not i or not c >> (i - 1) & 1 else -1 for c in range(1, 2 ** (n - 1))] for i in range(n)], np.int8)
    draw, best, most = np.random.default_rng(seed), None, -1
    for _ in range(200):
        code = draw.choice(np.array([-1, 1], np.int8), (n, int(12 * np.ceil(np.log2(n)))))
        code = code[:, np.abs(code.sum(axis=0)) < n]
        apart = (code.shape[1] - code.astype(int) @ code.T.astype(int)) // 2
        if (least := int(apart[np.triu_indices(n, 1)].min())) > most:
            best, most = code, least
    return best


@dataclass
class LanguageModel:
    languages: list[str]
    code: np.ndarray  # languages x bits
    weights: np.ndarray  # features x bits: log odds of the bit
    trust: np.ndarray  # weight of each bit's loss

    def margins(self, text: str) -> np.ndarray:
        at = features(text)
        return np.bincount(at, minlength=FEATURES).astype(np.float64) @ self.weights * (min(len(at), EVIDENCE) / max(len(at), 1))

    def shares(self, text: str) -> np.ndarray:
        """Of each language, from the weighted losses of its codeword."""
        loss = np.logaddexp(0, -self.code * self.margins(text)) @ self.trust
        near = np.exp(loss.min() - loss)
        return near / near.sum()

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score, ambiguous."""
        if not self.languages or not text or not has_letter(text):
            return UNDETERMINED, 0.0, True
        shares = self.shares(text)
        order = np.argsort(-shares, kind="stable")
        best = float(shares[order[0]])
        second = float(shares[order[1]]) if len(order) > 1 else 0.0
        return self.languages[order[0]], best, best / (best + second) < AMBIGUOUS


def fit(labelled: DataFrame, *, per_language: int = SAMPLE_PER_LANGUAGE, parts: int = 8) -> LanguageModel:
    """A model from rows of doc_id, text and lang.

    Of each language, rows are chosen by hash of the id so that about
    ``per_language`` make the sample; most of it fits the classifiers, and the rest
    weighs their losses.  Rows without text or language don't count; null ids and
    repeated rows are rows like any other.  Whole texts are used.  An empty table
    gives a model that knows no language.  The table of languages is on the driver,
    as the code is.
    """
    bounded_batches(session_of(labelled))
    rows = labelled.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    table = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    languages = sorted(table)
    code = codewords(len(languages))
    if not languages:
        return LanguageModel([], code, np.zeros((FEATURES, 1)), np.ones(1))
    share = F.create_map(*(x for k, n in table.items() for x in (F.lit(k), F.lit(int((1 << 30) * min(1.0, per_language / n))))))
    number = {k: i for i, k in enumerate(languages)}
    place = F.xxhash64("doc_id", "text")
    chosen = rows.filter(F.pmod(place, F.lit(1 << 30)) <= share[F.col("lang")]).select("lang", "text", (F.pmod(F.xxhash64("text", "doc_id"), F.lit(HELD)) == 0).alias("held"))
    chosen = chosen.repartition(parts)  # a bounded sample: few tasks, few partial counts

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(languages), FEATURES), np.int64)
        for batch in portions(batches):
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sums[number[lang]] += np.bincount(features(text), minlength=FEATURES)
        yield pa.RecordBatch.from_arrays([pa.array([sums.tobytes()], pa.binary())], names=["sums"])

    sums = sum(np.frombuffer(r[0], np.int64).reshape(len(languages), -1) for r in chosen.filter("not held").mapInArrow(count, "sums binary").collect())
    p = (sums + 0.5) / (sums + 0.5).sum(axis=1, keepdims=True)
    up = code > 0
    one = lambda bits: bits.T.astype(float) @ p / np.maximum(bits.sum(axis=0), 1)[:, None]
    weights = (np.log(one(up)) - np.log(np.maximum(one(~up), 1e-12))).T if len(languages) > 1 else np.zeros((FEATURES, 1))
    model = LanguageModel(languages, code, weights, np.ones(code.shape[1]))

    def right(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits = np.zeros(code.shape[1] + 1, np.int64)
        for batch in portions(batches):
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                hits[:-1] += model.margins(text) * code[number[lang]] > 0
                hits[-1] += 1
        yield pa.RecordBatch.from_arrays([pa.array([hits.tobytes()], pa.binary())], names=["hits"])

    hits = sum(np.frombuffer(r[0], np.int64) for r in chosen.filter("held").mapInArrow(right, "hits binary").collect())
    accuracy = (hits[:-1] + 1) / (hits[-1] + 2)
    trust = np.maximum(np.log(accuracy / (1 - accuracy)), 0.01)
    model.trust = trust / trust.mean() / len(trust) * 3
    return model


def _judged(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """_row, lang_pred, score, ambiguous."""
    bounded_batches(session_of(docs))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            said = [model.predict(text) for text in batch["_row"].field("text").to_pylist()]
            new = [pa.array([x[i] for x in said], t) for i, t in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([batch["_row"], *new], names=["_row", *_NEW])

    types = (T.StringType(), T.DoubleType(), T.BooleanType())
    return docs.select(F.struct(*docs.columns).alias("_row")).mapInArrow(judge, beside(docs, *(T.StructField(c, t) for c, t in zip(_NEW, types))))


_NEW = ["lang_pred", "score", "ambiguous"]


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """The documents with lang_pred, score (0 to 1) and ambiguous, from whole texts alone.

    lang_pred is "und", with score 0, where the text is null or has no letter.
    Very long texts are judged whole.  Repeated rows are judged again, null ids stay
    null; an empty table gives no rows.  Columns of the documents that have the name
    of a new one stay, with _in behind it.
    """
    return unfolded(_judged(docs, model), docs.columns, _NEW)


def recognised(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """The documents in a language that the model knows, as they are; those that it can't tell go."""
    return _judged(docs, model).filter(F.col("lang_pred") != UNDETERMINED).select("_row.*")
