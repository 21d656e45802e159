"""Secret scans: fixed patterns, and character Markov models compared by log-likelihood ratio.

Two first-order models, one of random strings and one of ordinary identifiers,
are counted from labelled samples, of which a part is held back to fit the margin.
A long run of identifier characters whose log-likelihood ratio speaks for the
random model by more than the margin is a secret besides what the patterns find.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from random import Random

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, portions, session_of, stage, unstage

KINDS = ("assign", "access", "hex", "markov")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
#: Runs that the models judge.
_RUN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
#: Ordinary tokens, of less length than what is judged.
_WORDS = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{5,19}(?![A-Za-z0-9+/_=-])")

#: Documents, at most in expectation, whose tokens train the models.
SAMPLE_DOCUMENTS = 4000
#: Generated strings of each alphabet among the random samples.
GENERATED = 2000
#: One in HELD labelled tokens, by hash, fits the margin and not the models.
HELD = 4
#: Shares of held-back ordinary runs above the margin, and of random ones below it, that are aimed at.
FALSE_ALARMS, MISSES = 0.0005, 0.01
#: Log-likelihood ratios are counted in bins of one nat, from -BINS to BINS.
BINS = 512
#: Characters from which on runs are judged; nats by which the random model must lead at least, whatever the sample says.
JUDGED, LEAST_MARGIN = 20, 5.0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's index, end) of what the patterns find, in code points; leftmost, non-overlapping per kind."""
    found = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


def _codes(token: str) -> np.ndarray:
    return np.frombuffer(f"\x01{token}\x02".encode("ascii"), np.uint8)


def _pairs(tokens: list[str]) -> np.ndarray:
    """Counts of adjacent characters, with a start and an end mark."""
    if not tokens:
        return np.zeros(128 * 128, np.int64)
    codes = np.concatenate([_codes(t) for t in tokens]).astype(np.int64)
    first, second = codes[:-1], codes[1:]
    return np.bincount((first * 128 + second)[first != 2], minlength=128 * 128)


def generated_secrets(n: int = GENERATED, seed: int = 1) -> list[str]:
    """Random strings of the usual alphabets: the labelled samples that any corpus can count on."""
    draw = Random(seed)
    digits, lower = "0123456789", "abcdefghijklmnopqrstuvwxyz"
    alphabets = (digits + "abcdef", digits + lower + lower.upper(), digits + lower + lower.upper() + "+/", digits + lower + lower.upper() + "-_")
    return ["".join(draw.choices(a, k=draw.randint(16, 64))) for a in alphabets for _ in range(n)]


def labelled_tokens(text: str) -> tuple[list[str], list[str]]:
    """Random strings (values that the patterns find) and ordinary tokens of a text."""
    spans = base_spans(text)
    secret = [m[2] for m in _ASSIGN.finditer(text) if len(m[2]) >= 8] + [text[a:b] for a, k, b in spans if k]
    ordinary, at = [], 0
    for start, _, end in spans:
        if start > at:
            ordinary += _WORDS.findall(text, at, start)
        at = max(at, end)
    return secret, ordinary + _WORDS.findall(text, at)


@dataclass
class SecretModel:
    #: Log-likelihood ratios, 128 x 128, of a character after another: random over ordinary.
    ratios: np.ndarray
    #: Nats by which the random model must lead.
    margin: float

    def score(self, token: str) -> float:
        codes = _codes(token)
        return float(self.ratios[codes[:-1], codes[1:]].sum())


def _summed(labelled: DataFrame, count, n: int) -> np.ndarray:
    """Sums of two rows of n numbers (ordinary, secret), which ``count`` makes of the tokens of a portion; one result a task."""

    def every(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, n), np.int64)
        for batch in portions(batches, 100_000):
            both: tuple[list[str], list[str]] = ([], [])
            for token, secret in zip(batch["token"].to_pylist(), batch["secret"].to_pylist()):
                if token is not None and secret is not None:
                    both[secret].append(token.encode("ascii", "ignore").decode())
            sums += [count(both[0]), count(both[1])]
        yield pa.RecordBatch.from_arrays([pa.array([sums.tobytes()], pa.binary())], names=["sums"])

    sums = [np.frombuffer(r[0], np.int64).reshape(2, -1) for r in labelled.select("token", "secret").mapInArrow(every, "sums binary").collect()]
    return sum(sums, np.zeros((2, n), np.int64))


def _ratios(sums: np.ndarray) -> np.ndarray:
    counts = (sums + [np.zeros(128 * 128, np.int64), _pairs(generated_secrets())]).reshape(2, 128, 128) + 1.0
    logs = np.log(counts / counts.sum(axis=2, keepdims=True))
    return logs[1] - logs[0]


def _runs(tokens: list[str]) -> list[str]:
    """Tokens of the length that is judged; shorter ones are joined as an identifier would be."""
    out, held = [], ""
    for token in tokens:
        held = f"{held}_{token}" if held else token
        if len(held) >= JUDGED:
            out.append(held)
            held = ""
    return out


def _margin(bins: np.ndarray) -> float:
    """From counts of ratios (ordinary, secret): amid the two where they are apart, else as the ordinary ones ask for."""
    edges = np.arange(-BINS, BINS + 1)
    ordinary, random = bins
    above = np.cumsum(ordinary[::-1])[::-1]  # at this edge or higher
    low = float(edges[np.argmax(above <= FALSE_ALARMS * ordinary.sum())])
    below = np.cumsum(random)
    high = float(edges[np.argmax(below > MISSES * random.sum())])
    return max(LEAST_MARGIN, (low + high) / 2 if low < high else low)


def train(labelled: DataFrame) -> SecretModel:
    """A model from token (string) and secret (boolean) of any number of rows.

    Pairs of characters are counted per partition and added up; generated random
    strings are added, and one to every count.  One token in HELD, by its hash, is
    held back: ratios of those (ordinary ones joined to the length that is judged)
    and of other generated strings fit the margin.  Null tokens and labels are
    passed over, other than ASCII characters don't count, and a null or repeated
    row is a row like any other.  An empty table gives the model of the generated
    strings.
    """
    held = F.pmod(F.xxhash64("token"), F.lit(HELD)) == 0
    ratios = _ratios(_summed(labelled.filter(~held), _pairs, 128 * 128))
    model = SecretModel(ratios, 0.0)

    def binned(tokens: list[str]) -> np.ndarray:
        at = np.clip(np.floor([model.score(t) for t in _runs(tokens)]), -BINS, BINS).astype(np.int64) + BINS
        return np.bincount(at, minlength=2 * BINS + 1)

    bins = _summed(labelled.filter(held), binned, 2 * BINS + 1)
    bins[1] += binned([t for t in generated_secrets(200, 2) if len(t) >= JUDGED])
    model.margin = _margin(bins)
    return model


def sample_labels(docs: DataFrame, documents: int = SAMPLE_DOCUMENTS, parts: int = 8) -> DataFrame:
    """token and secret of the whole texts of about ``documents`` rows, chosen by hash of id and text: the patterns label them."""
    bounded_batches(session_of(docs))
    total = docs.count()
    share = int((1 << 30) * min(1.0, documents / max(total, 1)))
    chosen = docs.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) <= share).select("text")

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            secret, ordinary = [], []
            for text in batch.column(0).to_pylist():
                found = labelled_tokens(text or "")
                secret += found[0]
                ordinary += found[1]
            yield pa.RecordBatch.from_arrays([pa.array(secret + ordinary, pa.string()), pa.array([True] * len(secret) + [False] * len(ordinary))], names=["token", "secret"])

    return chosen.repartition(parts).mapInArrow(label, "token string, secret boolean")


def sample_model(docs: DataFrame, documents: int = SAMPLE_DOCUMENTS) -> SecretModel:
    """train() on sample_labels()."""
    labelled = stage(sample_labels(docs, documents), "secret_labels")
    model = train(labelled)
    unstage(labelled)
    return model


def secret_spans(text: str, model: SecretModel, margin: float | None = None) -> list[tuple[int, int, int]]:
    """base_spans() and the runs that the model takes for random and that overlap none of them."""
    base = base_spans(text)
    margin = model.margin if margin is None else margin
    found, at, reach = [], 0, 0  # the base spans that begin before the run's end, and where the last of them ends
    for m in _RUN.finditer(text):
        while at < len(base) and base[at][0] < m.end():
            reach, at = max(reach, base[at][2]), at + 1
        if reach <= m.start() and model.score(m[0]) > margin:
            found.append((m.start(), 3, m.end()))
    return sorted(base + found)


def scan_secrets(docs: DataFrame, model: SecretModel, *, margin: float | None = None) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, n_markov, base_sha256, spans.

    Spans are kind:start:end in code points, end exclusive, by start, comma-joined.
    Null and empty texts have none.  A very long text is scanned whole, in time in
    proportion to its length.  A null doc_id keeps its null; repeated rows are
    scanned again; an empty table gives no rows; other columns are ignored, whatever
    their names.
    """

    bounded_batches(session_of(docs))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            rows = []
            for text in batch.column(1).to_pylist():
                spans = secret_spans(text or "", model, margin)
                said = [f"{KINDS[k]}:{a}:{b}" for a, k, b in spans]
                base = ",".join(s for s, (_, k, _) in zip(said, spans) if k < 3)
                counts = [sum(k == x for _, k, _ in spans) for x in range(4)]
                rows.append((*counts, hashlib.sha256(base.encode()).hexdigest(), ",".join(said)))
            columns = list(zip(*rows)) if rows else [[]] * 6
            types = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0)] + [pa.array(list(c), t) for c, t in zip(columns, types)], names=_COLUMNS)

    schema = "doc_id long, n_assign long, n_access long, n_hex long, n_markov long, base_sha256 string, spans string"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(scan, schema)


_COLUMNS = ["doc_id", "n_assign", "n_access", "n_hex", "n_markov", "base_sha256", "spans"]
