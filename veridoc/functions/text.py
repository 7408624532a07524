"""The project's text normaliser: NFKC, case folding, words of letters and digits."""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: a word is a run of letters and digits, with single hyphens or apostrophes inside.
WORD = re.compile(r"[^\W_]+(?:[-'][^\W_]+)*")


def fold(text: str) -> str:
    """NFKC, then full case folding."""
    if text.isascii():
        return text.lower()
    return unicodedata.normalize("NFKC", text).casefold()


def words(text: str | None) -> list[str]:
    """Words of a text; none for null."""
    return WORD.findall(fold(text)) if text else []


_ALNUM: np.ndarray | None = None


def alnum_table() -> np.ndarray:
    """True for each code point that is a letter or a digit."""
    global _ALNUM
    if _ALNUM is None:
        _ALNUM = np.fromiter((chr(c).isalnum() for c in range(0x110000)), bool, 0x110000)
    return _ALNUM


#: Characters that a worker splits at once.
_CHUNK_CHARS = 1 << 20


def chunks(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Ranges of neighbouring texts of bounded length together; a longer text stands alone."""
    lo = size = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > lo and size + n > _CHUNK_CHARS:
            yield lo, i
            lo, size = i, 0
        size += n
    if lo < len(texts):
        yield lo, len(texts)


def _lists(counts: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), values)


def tokenize(text: Column | str) -> Column:
    """The words of each text by the project's normaliser (NFKC, case folding), whole Arrow arrays at once; a null text has none."""

    def split(texts: pa.Array) -> pa.Array:
        values, parts = texts.to_pylist(), []
        for lo, hi in chunks(values):
            array, counts = word_array(values[lo:hi])
            parts.append(_lists(counts, array.dictionary_decode().cast(pa.string())))
        return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.string()))

    return F.arrow_udf(split, "array<string>")(text)


_HASHER: list[WordHasher] = []


def run_hashes(text: Column | str, widths: list[int], short: bool = False) -> Column:
    """The distinct 64-bit hashes of the runs of each width in a text, ``array<bigint>``; runs of different width never share a hash.

    A text with fewer words than the only width is one run if ``short``. No words give no runs.
    """

    def make(texts: pa.Array) -> pa.Array:
        if not _HASHER:
            _HASHER.append(WordHasher())
        hasher, values, parts = _HASHER[0], texts.to_pylist(), []
        for lo, hi in chunks(values):
            hashes, counts = hasher.words(values[lo:hi])
            made = {w: hasher.runs(hashes, w) for w in widths}
            out, at = [], 0
            for n in counts.tolist():
                found = [made[w][at : at + n - w + 1] for w in widths if n >= w]
                if short and 0 < n < widths[0]:
                    found = [hasher.runs(hashes[at : at + n], n)[:1]]
                out.append(np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64))
                at += n
            parts.append(_lists(np.array([len(x) for x in out], np.int64), pa.array(np.concatenate(out).view(np.int64))))
        return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.int64()))

    return F.arrow_udf(make, "array<bigint>")(text)


def word_digests(text: Column | str) -> Column:
    """128-bit digests of the words of each text, equal for equal words; null without words."""

    def make(texts: pa.Array) -> pa.Array:
        if not _HASHER:
            _HASHER.append(WordHasher())
        values, out = texts.to_pylist(), []
        for lo, hi in chunks(values):
            hashes, counts = _HASHER[0].words(values[lo:hi])
            at = 0
            for n in counts.tolist():
                out.append(hashlib.blake2b(hashes[at : at + n].tobytes(), digest_size=16).digest() if n else None)
                at += n
        return pa.array(out, pa.binary())

    return F.arrow_udf(make, "binary")(text)


def normalized(tokens: Column | str) -> Column:
    return F.array_join(tokens, " ")


def normalized_sha256(tokens: Column | str) -> Column:
    return F.sha2(F.array_join(tokens, " "), 256)


_WORDLIKE: np.ndarray | None = None


def _wordlike() -> np.ndarray:
    """Per code point: 1 for a letter or digit, 2 for a hyphen or apostrophe, else 0."""
    global _WORDLIKE
    if _WORDLIKE is None:
        _WORDLIKE = alnum_table().astype(np.uint8)
        _WORDLIKE[[ord("-"), ord("'")]] = 2
    return _WORDLIKE


def word_array(texts: list[str | None]) -> tuple[pa.DictionaryArray, np.ndarray]:
    """All words of all texts, dictionary-encoded, and the number of words of each text.

    The same words as :func:`words`, found without a regular expression: texts are folded and
    laid end to end as code points, a hyphen or apostrophe belongs to a word exactly if a letter
    or digit stands on both sides, and words are the runs of such characters. The pieces between
    run limits tile the UTF-8 buffer, so Arrow can encode them in place.
    """
    folded = [fold(t) if t else "" for t in texts]
    data = "\n".join(folded) + "\n"
    raw = data.encode("utf-8", "surrogatepass")
    code = np.frombuffer(data.encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = _wordlike()[code]
    inside = kind == 1
    link = np.flatnonzero(kind == 2)
    link = link[(link > 0) & (link < len(code) - 1)]
    inside[link[(kind[link - 1] == 1) & (kind[link + 1] == 1)]] = True
    change = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    first = int(not inside[0])  # the piece number of the first word
    starts = np.concatenate([[0], change])
    at = starts[first::2]
    ends = np.cumsum(np.fromiter(map(len, folded), np.int64, len(folded)) + 1)
    counts = np.diff(np.searchsorted(at, ends, side="left"), prepend=0)
    if len(raw) != len(code):
        starts = np.flatnonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)[starts]
    offsets = np.append(starts, len(raw)).astype(np.int32)
    pieces = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(raw)])
    if first or len(pieces) > 1:
        pieces = pieces.take(pa.array(np.arange(first, len(pieces), 2)))
    if not len(at):
        pieces = pieces.slice(0, 0)
    return pieces.dictionary_encode(), counts


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalising hash of whole arrays."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHasher:
    """64-bit hashes of words and of word runs; a worker's cache spares repeated words."""

    def __init__(self, most: int = 500_000) -> None:
        self.held: dict[bytes, int] = {}
        self.most = most

    def words(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Hash of every word, end to end, and the number of words of each text."""
        array, counts = word_array(texts)
        if len(self.held) > self.most:
            self.held.clear()
        held = self.held
        distinct = array.dictionary.to_pylist()
        for w in distinct:
            if w not in held:
                held[w] = int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little")
        table = np.fromiter(map(held.__getitem__, distinct), np.uint64, len(distinct))
        return table[array.indices.to_numpy()], counts

    @staticmethod
    def runs(hashes: np.ndarray, width: int) -> np.ndarray:
        """Hash of the run of ``width`` words that starts at each word (the last ones are shorter in effect)."""
        out = mix(hashes + np.uint64(width))
        for k in range(1, width):
            following = np.zeros_like(hashes)
            following[: max(0, len(hashes) - k)] = hashes[k:]
            out = mix(out * np.uint64(0x9E3779B97F4A7C15) + following)
        return out


def run_sets(hasher: WordHasher, texts: list[str | None], width: int) -> list[np.ndarray]:
    """Sorted distinct run hashes of each text; none for texts with fewer words."""
    hashes, counts = hasher.words(texts)
    runs = hasher.runs(hashes, width)
    ends = np.cumsum(counts).tolist()
    out = []
    lo = 0
    for hi in ends:
        out.append(np.unique(runs[lo : max(lo, hi - width + 1)]))
        lo = hi
    return out
