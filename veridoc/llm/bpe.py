"""Byte-level BPE without a regular expression engine.

Texts are laid end to end as one array of code points, mapped to symbols by a lookup table and what
follows. The pre-tokeniser is a finite automaton; each symbol stands for a transition function over its
states, and the state before every character is the composition of all functions before it. Composition is
associative, so it is found by a scan: functions that lead to one state whatever came before need none, the others
(apostrophes and the letters behind them) are composed with their predecessors by doubling. State and symbol say
where a piece starts. The pieces tile the byte buffer, so they form an Arrow binary array
without copying; it is dictionary-encoded and only distinct pieces are merged, in a cache that
lives as long as the Python worker.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"

SPACE, LETTER, NUMBER, OTHER, END = 0, 1, 2, 3, 4
# Symbols: the classes; the last space before text, as a blank or not; an apostrophe before a contraction of two or
# three characters; a letter within reach of such an apostrophe.
LAST_BLANK, LAST_SPACE, QUOTE_2, QUOTE_3, NEAR_LETTER, SYMBOLS = 5, 6, 7, 8, 9, 10
# States after a character: in a piece of letters, numbers, other characters or spaces; after a blank that belongs to
# the next piece; with one or two letters of a contraction to come; after a contraction; between texts.
IN_LETTERS, IN_NUMBERS, IN_OTHER, IN_SPACES, BLANK, ONE_TO_COME, TWO_TO_COME, CONTRACTED, OUTSIDE, STATES = 0, 1, 2, 3, 4, 5, 6, 7, 8, 9
#: Pieces longer than this are merged one by one with a heap, shorter ones in whole arrays.
_ARRAY_BYTES = 48
#: Pieces kept in a worker's cache before it starts anew (it holds no results, only speed).
_CACHE_PIECES = 400_000
#: Characters handled at once in a worker.
CHUNK_CHARS = 1 << 20


def _class_table() -> np.ndarray:
    """Class of each code point. White space is Unicode's White_Space property."""
    table = np.full(0x110000, OTHER, np.uint8)
    for cp in range(0x110000):
        kind = unicodedata.category(chr(cp))[0]
        if kind == "L":
            table[cp] = LETTER
        elif kind == "N":
            table[cp] = NUMBER
    for cp in (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000):
        table[cp] = SPACE
    return table


def _byte_letters() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use for the 256 byte values."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    letters = {chr(b): b for b in plain}
    spare = (b for b in range(256) if b not in set(plain))
    letters.update({chr(256 + n): b for n, b in enumerate(spare)})
    return letters


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """``(step, cut)``: the state after a symbol from each state, and whether a piece starts at it."""
    step, cut = np.zeros((SYMBOLS, STATES), np.uint8), np.ones((SYMBOLS, STATES), bool)
    for symbol, state in ((SPACE, IN_SPACES), (LETTER, IN_LETTERS), (NUMBER, IN_NUMBERS), (OTHER, IN_OTHER), (END, OUTSIDE), (LAST_BLANK, BLANK), (LAST_SPACE, IN_SPACES), (NEAR_LETTER, IN_LETTERS)):
        step[symbol] = state
    for symbol, own in ((LETTER, IN_LETTERS), (NUMBER, IN_NUMBERS), (OTHER, IN_OTHER), (NEAR_LETTER, IN_LETTERS)):
        cut[symbol, [own, BLANK]] = False
    cut[SPACE, IN_SPACES] = False
    for symbol, state in ((QUOTE_2, ONE_TO_COME), (QUOTE_3, TWO_TO_COME)):  # inside other characters or after a blank it is one of them
        step[symbol] = state
        step[symbol, [IN_OTHER, BLANK]] = IN_OTHER
        cut[symbol, [IN_OTHER, BLANK]] = False
    step[NEAR_LETTER, [ONE_TO_COME, TWO_TO_COME]] = [CONTRACTED, ONE_TO_COME]
    cut[NEAR_LETTER, [ONE_TO_COME, TWO_TO_COME]] = False
    return step, cut


_STEP, _CUT = _automaton()
_CONSTANT = (_STEP == _STEP[:, :1]).all(1)


def states_before(symbol: np.ndarray) -> np.ndarray:
    """The automaton's state before each symbol, by an associative scan over transition functions."""
    after = _STEP[:, OUTSIDE].take(symbol)
    open_ = np.flatnonzero(~_CONSTANT[symbol])  # functions whose value depends on what came before
    if len(open_):
        function = _STEP[symbol[open_]]
        before = open_ - 1  # the last position whose function is not yet composed in
        slot = np.full(len(symbol) + 1, -1, np.int64)
        slot[open_] = np.arange(len(open_))
        left = np.arange(len(open_))
        while len(left):
            back = slot[before[left]]
            closed = left[(back < 0) | (before[left] < 0)]
            start = np.where(before[closed] < 0, OUTSIDE, after[before[closed]])
            after[open_[closed]] = function[closed, start]
            left = left[(back >= 0) & (before[left] >= 0)]
            back = slot[before[left]]
            # g after f: function composition, for all open positions at once.
            composed = np.take_along_axis(function[left], function[back].astype(np.intp), 1)
            jumped = before[back]
            function[left], before[left] = composed, jumped
    out = np.empty_like(after)
    out[0], out[1:] = OUTSIDE, after[:-1]
    return out


class ByteBPE:
    """Encoder for one byte-level BPE vocabulary file (the JSON form with ``vocab`` and ``merges``)."""

    def __init__(self, path: str = DEFAULT_VOCABULARY) -> None:
        with open(path, encoding="utf-8") as handle:
            model = json.load(handle)["model"]
        vocab, letters = model["vocab"], _byte_letters()
        self.byte_ids = np.zeros(256, np.int32)
        for letter, byte in letters.items():
            self.byte_ids[byte] = vocab[letter]
        self.bytes_of: dict[int, bytes] = {i: bytes(letters[c] for c in token) for token, i in vocab.items() if all(c in letters for c in token)}
        size = max(vocab.values()) + 1
        self.length_of = np.zeros(size, np.int64)  # bytes of each id
        self.length_of[list(self.bytes_of)] = [len(b) for b in self.bytes_of.values()]
        self.size = size
        left, right, merged = [], [], []
        for rule in model["merges"]:
            a, b = rule.split(" ") if isinstance(rule, str) else rule
            left.append(vocab[a])
            right.append(vocab[b])
            merged.append(vocab[a + b])
        keys = np.array(left, np.int64) * size + np.array(right, np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank, self.merged = keys[order], order.astype(np.int32), np.array(merged, np.int32)[order]
        self.pair = dict(zip(keys.tolist(), zip(range(len(keys)), merged)))
        self.classes = _class_table()
        self._start_cache()

    # -- pieces -------------------------------------------------------------------------------

    def boundaries(self, code: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """True where a piece starts. ``ends`` marks the sentinel that follows each text."""
        cls = self.classes[code]
        cls[ends] = END
        follow = np.empty_like(cls)
        follow[-1], follow[:-1] = END, cls[1:]
        symbol = cls.copy()
        last = (cls == SPACE) & (follow != SPACE) & (follow != END)
        symbol[last] = np.where(code[last] == 0x20, LAST_BLANK, LAST_SPACE)
        quote = np.flatnonzero((code == 0x27) & (follow == LETTER))
        if len(quote):
            padded = np.concatenate([code, np.zeros(3, code.dtype)])
            one, two = padded[quote + 1], padded[quote + 2]
            short = np.isin(one, np.frombuffer("stmd".encode("utf-32-le"), np.uint32))
            long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
            for at, kind, width in ((quote[short], QUOTE_2, 1), (quote[long], QUOTE_3, 2)):
                symbol[at] = kind
                for k in range(1, width + 1):
                    symbol[at + k] = NEAR_LETTER
        return _CUT.ravel().take(symbol.astype(np.int32) * STATES + states_before(symbol))

    def pieces(self, texts: list[str]) -> tuple[pa.Array, np.ndarray]:
        """Distinct-encoded pieces of the texts (an Arrow dictionary array) and the pieces per text."""
        data = "".join(texts)
        raw = data.encode("utf-8", "surrogatepass")
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        total = int(lengths.sum())
        ends = np.cumsum(lengths) + np.arange(len(texts))
        code = np.zeros(total + len(texts), np.uint32)
        keep = np.ones(len(code), bool)
        keep[ends] = False
        code[keep] = np.frombuffer(data.encode("utf-32-le", "surrogatepass"), np.uint32)
        start = self.boundaries(code, ends)
        firsts = np.flatnonzero(start[keep])
        per_text = np.zeros(len(texts), np.int64)
        if len(firsts):
            text_of = np.repeat(np.arange(len(texts)), lengths)
            per_text = np.bincount(text_of[firsts], minlength=len(texts))
        if len(raw) != total:
            byte_at = np.flatnonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)
            firsts = byte_at[firsts]
        offsets = np.append(firsts, len(raw)).astype(np.int32)
        array = pa.Array.from_buffers(pa.binary(), len(firsts), [None, pa.py_buffer(offsets), pa.py_buffer(raw)])
        return array.dictionary_encode(), per_text

    # -- merging ------------------------------------------------------------------------------

    def _start_cache(self) -> None:
        self.known: dict[bytes, int] = {}
        self.flat = np.zeros(1 << 16, np.int32)
        self.used = 0
        self.first = np.zeros(1 << 14, np.int64)
        self.count = np.zeros(1 << 14, np.int32)

    def _add(self, pieces: list[bytes], ids: np.ndarray, counts: np.ndarray) -> None:
        n, m = len(self.known), len(pieces)
        while n + m > len(self.first):
            self.first = np.concatenate([self.first, np.zeros_like(self.first)])
            self.count = np.concatenate([self.count, np.zeros_like(self.count)])
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + len(ids)] = ids
        self.count[n : n + m] = counts
        self.first[n : n + m] = self.used + np.cumsum(counts) - counts
        self.used += len(ids)
        self.known.update(zip(pieces, range(n, n + m)))

    def _lookup(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        hit = self.keys[at] == keys
        return np.where(hit, self.rank[at], np.iinfo(np.int32).max), self.merged[at]

    def _merge_arrays(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Merge many short pieces at once: in each round every piece merges its first lowest pair."""
        counts = np.fromiter(map(len, pieces), np.int64, len(pieces))
        width = int(counts.max(initial=1))
        ids = np.full((len(pieces), width), -1, np.int64)
        ids[np.arange(width) < counts[:, None]] = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        active = np.flatnonzero(counts > 1)
        while len(active):
            part = ids[active]
            a, b = part[:, :-1], part[:, 1:]
            rank, merged = self._lookup(np.where(b >= 0, a * self.size + b, -1).ravel())
            rank, merged = rank.reshape(a.shape), merged.reshape(a.shape)
            at = rank.argmin(1)
            rows = np.arange(len(active))
            go = rank[rows, at] != np.iinfo(np.int32).max
            active, part, at, merged = active[go], part[go], at[go], merged[go]
            if not len(active):
                break
            rows = np.arange(len(active))
            column = np.arange(width)
            source = np.minimum(column + (column > at[:, None]), width - 1)
            moved = np.take_along_axis(part, source, 1)
            moved[:, -1] = np.where(width - 1 > at, -1, moved[:, -1])
            moved[rows, at] = merged[rows, at]
            ids[active] = moved
            counts[active] -= 1
            active = active[counts[active] > 1]
        return ids[ids >= 0].astype(np.int32), counts.astype(np.int32)

    def merge_one(self, piece: bytes) -> list[int]:
        """Merge one long piece with a heap of candidate pairs over a linked list."""
        ids = self.byte_ids[np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)
        nxt, prv, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap: list[tuple[int, int, int, int, int]] = []

        def push(i: int) -> None:
            j = nxt[i]
            if j < n and (rule := self.pair.get(ids[i] * self.size + ids[j])):
                heapq.heappush(heap, (rule[0], i, j, ids[i] * self.size + ids[j], rule[1]))

        for i in range(n - 1):
            push(i)
        while heap:
            _, i, j, key, merged = heapq.heappop(heap)
            if not (alive[i] and j < n and alive[j] and nxt[i] == j and ids[i] * self.size + ids[j] == key):
                continue
            ids[i], alive[j], nxt[i] = merged, False, nxt[j]
            if nxt[i] < n:
                prv[nxt[i]] = i
            push(i)
            if prv[i] >= 0:
                push(prv[i])
        return [x for x, live in zip(ids, alive) if live]

    def _codes(self, distinct: pa.Array) -> np.ndarray:
        """Cache index of each distinct piece; unknown ones are merged first."""
        words = distinct.to_pylist()
        if len(self.known) + len(words) > _CACHE_PIECES:
            self._start_cache()
        new = [w for w in words if w not in self.known]
        short = [w for w in new if len(w) <= _ARRAY_BYTES]
        for lo in range(0, len(short), 8192):
            part = short[lo : lo + 8192]
            for width in sorted({(len(w) + 7) // 8 for w in part}):  # little padding within a group
                group = [w for w in part if (len(w) + 7) // 8 == width]
                self._add(group, *self._merge_arrays(group))
        for w in new:
            if len(w) > _ARRAY_BYTES:
                ids = self.merge_one(w)
                self._add([w], np.array(ids, np.int32), np.array([len(ids)], np.int32))
        return np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))

    # -- public -------------------------------------------------------------------------------

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids end to end, and the number of ids of each text."""
        if not texts:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        array, per_text = self.pieces(texts)
        if not len(array):
            return np.zeros(0, np.int32), per_text
        code = self._codes(array.dictionary)[array.indices.to_numpy()]
        count = self.count[code].astype(np.int64)
        total = np.cumsum(count)
        shift = np.repeat(self.first[code] - (total - count), count)
        ids = self.flat[shift + np.arange(int(total[-1]))]
        return ids, self._sum(count, per_text)

    def offsets(self, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The byte at which each id starts in its text, for the ids and counts of ``encode``."""
        ends = np.cumsum(self.length_of[ids])
        starts = ends - self.length_of[ids]
        first = np.cumsum(counts) - counts
        base = np.where(counts > 0, np.append(starts, 0)[np.minimum(first, max(0, len(starts)))], 0)
        return starts - np.repeat(base, counts)

    def counts(self, texts: list[str]) -> np.ndarray:
        """Number of ids of each text, without building the ids."""
        if not texts:
            return np.zeros(0, np.int64)
        array, per_text = self.pieces(texts)
        if not len(array):
            return per_text
        code = self._codes(array.dictionary)[array.indices.to_numpy()]  # before self.count is read: it may be replaced
        return self._sum(self.count[code].astype(np.int64), per_text)

    @staticmethod
    def _sum(count: np.ndarray, per_text: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(count)])
        ends = np.cumsum(per_text)
        return total[ends] - total[ends - per_text]

    def decode(self, ids: list[int]) -> str:
        return b"".join(self.bytes_of[i] for i in ids).decode("utf-8", "surrogatepass")


_LOADED: dict[str, ByteBPE] = {}


def load(path: str) -> ByteBPE:
    """The encoder of a vocabulary, loaded once in each Python worker."""
    if path not in _LOADED:
        _LOADED[path] = ByteBPE(path)
    return _LOADED[path]


def chunks(texts: list[str], most: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of about ``most`` characters (a longer text stands alone)."""
    lo = size = 0
    for i, t in enumerate(texts):
        if i > lo and size + len(t) > most:
            yield lo, i
            lo, size = i, 0
        size += len(t)
    if lo < len(texts):
        yield lo, len(texts)
