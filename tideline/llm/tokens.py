"""Token ids of whole texts with the public tokenizer files, by chunk and from a bounded cache.

Both tokenizers split a text before they merge bytes, and no piece of that split
crosses the chunks below, so that ids of chunks, joined, are the ids of the text
(tests hold the two against each other).  Chunks repeat; most come from the cache.
"""

from __future__ import annotations

import re
import unicodedata
from array import array
from functools import cache

import numpy as np

#: White space of Unicode, as the tokenizers' own patterns have it.
_WS = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Byte-level: an optional space with what follows it, or white space up to the last before a word.
_BYTE_CHUNK = re.compile(rf" ?[^{_WS}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")
#: Word ends, white space dropped: anything between blanks and line ends.
_WORD_CHUNK = re.compile(r"[^ \n]+")
#: Texts of these characters (up to Latin Extended-B, which composition leaves as they are) are cut as finely as the
#: tokenizers cut them, so that a word is one chunk whatever stands around it.  A text that is lower-cased must be of them
#: before and after: lower case of some (U+0181, U+023A and others) is beyond.
_FINE = re.compile(r"[\x00-\u012f\u0131-\u024f]*")


def _class(kind: str) -> str:
    return "".join(re.escape(chr(i)) for i in range(0x250) if unicodedata.category(chr(i))[0] == kind)


def _fine(by_word: bool) -> re.Pattern:
    letter, number, white = _class("L"), _class("N"), r"\t-\r \x85\xa0"
    short = "'s|'t|'re|'ve|'m|'ll|'d"
    if by_word:
        return re.compile(rf"{short}|[{letter}]+|[{number}]|[^{white}{letter}{number}]+")
    return re.compile(rf"{short}| ?[{letter}]+| ?[{number}]+| ?[^{white}{letter}{number}]+|[{white}]+(?![^{white}])|[{white}]+")


#: Bytes that a worker's cache holds between batches, and of a chunk besides its characters and ids; those that come
#: first stay, and chunks of more characters than LONG are not kept.
CACHE_BYTES, CHUNK_BYTES, LONG = 96 << 20, 200, 64
#: Stands between chunks that are encoded together; no merge has it, and no chunk that holds it is among them.
_MARK = "\x01"
#: Chunks encoded together.
TOGETHER = 2000
TOGETHER_CHARS = 500_000

END_ID = 2


class Encoder:
    """Texts to ids, as little-endian unsigned 32-bit bytes, without an end id."""

    def __init__(self, name: str, share: float = 1.0) -> None:
        import public_tokenizers
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(name) if "/" not in name else name)
        self.tokenizer.encode_special_tokens = True
        self.by_word = "word_bpe" in name
        self.coarse, self.fine = (_WORD_CHUNK if self.by_word else _BYTE_CHUNK).findall, _fine(self.by_word).findall
        self.known: dict[str, bytes] = {}
        self.held, self.share = 0, share  # of CACHE_BYTES
        self.mark = self.tokenizer.encode(_MARK, add_special_tokens=False).ids
        if len(self.mark) != 1:
            raise ValueError(f"{name} has no single id for the mark")
        vocabulary = self.tokenizer.get_vocab()
        self.bytes_of = np.zeros(max(vocabulary.values()) + 1, np.int64)  # byte-level: a token has a character for each byte
        self.bytes_of[[*vocabulary.values()]] = [*map(len, vocabulary)]

    def chunks(self, text: str) -> list[str]:
        if _FINE.fullmatch(text):
            low = text.lower() if self.by_word else text
            if low is text or _FINE.fullmatch(low):
                return self.fine(low)
        return self.coarse(text)

    def _alone(self, chunk: str) -> bytes:
        return array("I", self.tokenizer.encode(chunk, add_special_tokens=False).ids).tobytes()

    def _together(self, chunks: list[str]) -> dict[str, bytes]:
        """Ids of chunks, many to a call; those that a neighbour could change go alone.

        Words behind a blank need nothing between them where ids stand for bytes: their bytes tell them apart.  Others get the mark.
        """
        new = {c: self._alone(c) for c in chunks if _MARK in c or not self.by_word and (c.isspace() or c[0] == "'" or c[-1] in "\x1c\x1d\x1e\x1f")}
        rest = [c for c in chunks if c not in new]
        if self.by_word:
            self._marked(rest, f" {_MARK} ", new)
            return new
        behind, other = [], []
        for c in rest:
            (behind if c[0] == " " else other).append(c)
        self._marked(other, _MARK, new)
        for at in range(0, len(behind), TOGETHER):
            some = behind[at : at + TOGETHER]
            ids = self._ids("".join(some))
            ends, cuts = np.cumsum(self.bytes_of[ids]), np.cumsum([len(c.encode()) for c in some])
            last = np.searchsorted(ends, cuts)
            if not len(ids) or ends[-1] != cuts[-1] or (ends[last] != cuts).any():
                new.update((c, self._alone(c)) for c in some)
            else:
                _cut(new, some, ids.tobytes(), [0, *(last + 1).tolist()], (last + 1).tolist())
        return new

    def _marked(self, chunks: list[str], between: str, new: dict[str, bytes]) -> None:
        for at in range(0, len(chunks), TOGETHER):
            some = chunks[at : at + TOGETHER]
            ids = self._ids(between.join(some))
            cuts = np.flatnonzero(ids == self.mark[0])
            if len(cuts) != len(some) - 1:
                new.update((c, self._alone(c)) for c in some)
            else:
                _cut(new, some, ids.tobytes(), [0, *(cuts + 1).tolist()], [*cuts.tolist(), len(ids)])

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def batch(self, texts: list[str | None]) -> list[bytes]:
        """In portions of some TOGETHER_CHARS, so that long texts don't stand in memory in pieces all at once."""
        out: list[bytes] = []
        first, size = 0, 0
        for i, text in enumerate(texts):
            size += len(text or "")
            if size >= TOGETHER_CHARS:
                out += self._portion(texts[first : i + 1])
                first, size = i + 1, 0
        return out + self._portion(texts[first:])

    def _portion(self, texts: list[str | None]) -> list[bytes]:
        known, parts = self.known, [self.chunks(t) if t else [] for t in texts]
        found = [[*map(known.get, p)] for p in parts]
        holes = [[i for i, ids in enumerate(f) if ids is None] for f in found]
        new = self._together(list({p[i] for p, at in zip(parts, holes) for i in at}))
        for p, f, at in zip(parts, found, holes):
            for i in at:
                f[i] = new[p[i]]
        for c, ids in new.items():
            cost = len(c) + len(ids) + CHUNK_BYTES
            if len(c) <= LONG and self.held + cost <= CACHE_BYTES * self.share:
                known[c] = ids
                self.held += cost
        return [*map(b"".join, found)]


def _cut(new: dict[str, bytes], chunks: list[str], raw: bytes, starts: list[int], ends: list[int]) -> None:
    new.update((c, raw[4 * a : 4 * b]) for c, a, b in zip(chunks, starts, ends))


@cache
def encoder(name: str, share: float = 1.0) -> Encoder:
    """Of a file of public_tokenizers, or of a path, with a share of CACHE_BYTES; one for each worker."""
    return Encoder(name, share)
