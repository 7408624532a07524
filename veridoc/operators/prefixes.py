"""The array work of the exact prefix search for similar sets: frequencies of elements, prefixes, pairs, sketches.

Elements are mixed 64-bit hashes. What is counted are their upper 32 bits: elements that agree in them count as one, which
changes the order of the elements, never the result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from veridoc.functions.text import mix

#: Elements, prefix rows or pairs that a task holds before it hands them on.
BLOCK = 2_000_000
#: The same for rows of prefixes that build pairs, and for these pairs.
PAIR_BLOCK = 500_000
#: Ranges of fingerprints: what one task merges.
PARTS = 256
#: Shares of the pairs: what one task adds up.
PAIR_PARTS = 1024
#: Elements that two sets must share among their rarest ones, where their sizes allow to ask for so many.
SHARED = 4
#: Sets whose prefixes or sketches are made at once.
ROWS = 1000
#: Least bits of a sketch for each element of its set.
BITS = 2
#: Bytes of sets or sketches with their pairs that a task compares at once.
BYTES = 32 << 20

COUNTS = "part int, n bigint, runs binary, counts binary"
LEVELS = "part int, n bigint, runs binary, levels binary, histogram binary"
POSTS = "run bigint, id bigint, n int, rest int"
PAIRS = "part int, n bigint, a binary, b binary, k binary, need binary"
SKETCHES = "id bigint, value struct<n:int,bits:binary>"
CLOSE = "a bigint, b bigint"
SHARED_ROWS = "a bigint, b bigint, shared int, n_a int, n_b int"


def _pack(x: np.ndarray) -> bytes:
    """An array in little room: byte planes, compressed."""
    return pa.compress(x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes(), codec="zstd", asbytes=True) if len(x) else b""


def _unpack(data: bytes, n: int, kind: type) -> np.ndarray:
    if not n:
        return np.zeros(0, kind)
    width = np.dtype(kind).itemsize
    raw = pa.decompress(data, n * width, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, n).T).view(kind).reshape(n)


def _steps(runs: np.ndarray) -> bytes:
    """Ascending fingerprints by their differences."""
    return _pack(np.diff(runs, prepend=np.uint32(0)))


def fingerprints(data: bytes, n: int) -> np.ndarray:
    """The inverse of :func:`_steps`."""
    return np.cumsum(_unpack(data, n, np.uint32), dtype=np.uint32)


def levels(data: bytes, n: int) -> np.ndarray:
    """Frequency levels of fingerprints: eight times the binary logarithm."""
    return _unpack(data, n, np.uint8)


def _elements(sets: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The mixed elements of all sets, end to end, and the size of each; null is empty."""
    sizes = pc.fill_null(pc.list_value_length(sets), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return mix(sets.flatten().to_numpy(zero_copy_only=False).view(np.uint64)), sizes


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of at most ROWS rows."""
    return (batch.slice(lo, ROWS) for batch in batches for lo in range(0, batch.num_rows, ROWS))


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many sets of a block hold each fingerprint, one row for each range of fingerprints."""
    held, rows = [], 0
    for batch in chain(batches, [None]):
        if batch is not None:
            held.append((_elements(batch.column(0))[0] >> np.uint64(32)).astype(np.uint32))
            rows += len(held[-1])
        if rows and (batch is None or rows >= BLOCK):
            runs, k = np.unique(np.concatenate(held), return_counts=True)
            cuts = np.searchsorted(runs, np.arange(PARTS + 1, dtype=np.uint64) << np.uint64(24)).tolist()
            made = [(p, hi - lo, _steps(runs[lo:hi]), _pack(k[lo:hi].astype(np.uint32))) for p, (lo, hi) in enumerate(zip(cuts, cuts[1:])) if lo < hi]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*made), (pa.int32(), pa.int64(), pa.binary(), pa.binary()))], names=["part", "n", "runs", "counts"])
            held, rows = [], 0


def merged(rows: pa.Table) -> pa.Table:
    """The fingerprints of one range that more than one set holds, with their levels."""
    rows = rows.to_pylist()
    runs = np.concatenate([fingerprints(r["runs"], r["n"]) for r in rows])
    k = np.concatenate([_unpack(r["counts"], r["n"], np.uint32) for r in rows]).astype(np.int64)
    order = np.argsort(runs, kind="stable")
    runs, k = runs[order], k[order]
    first = np.flatnonzero(np.r_[True, runs[1:] != runs[:-1]])
    runs, k = runs[first], np.add.reduceat(k, first)
    runs, k = runs[k > 1], k[k > 1]
    level = np.minimum(255, np.round(8 * np.log2(k))).astype(np.uint8)
    out = {"part": rows[0]["part"], "n": len(runs), "runs": _steps(runs), "levels": _pack(level), "histogram": np.bincount(level, minlength=256).astype(np.int64).tobytes()}
    kinds = {"part": pa.int32(), "n": pa.int64(), "runs": pa.binary(), "levels": pa.binary(), "histogram": pa.binary()}
    return pa.table({c: pa.array([out[c]], t) for c, t in kinds.items()})


def prefixes(common: Callable[[], tuple[np.ndarray, np.ndarray]], least: float, whole: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows ``(run, id, n, rest)`` of the rarest n - ceil(least n) + 1 elements of each set ``(id, set)`` of n elements.

    ``common()`` are the fingerprints of several sets with their levels, ``whole`` says that they are all of them: then
    elements that are not among them are in one set only and have no row. ``rest`` counts the elements from this one on.
    """

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, level = common()
        for batch in _slices(batches):
            flat, n = _elements(batch.column(1))
            if not len(flat):
                continue
            if len(runs):
                mark = (flat >> np.uint64(32)).astype(np.uint32)
                at = np.minimum(np.searchsorted(runs, mark), len(runs) - 1)
                found = np.where(runs[at] == mark, level[at], 0).astype(np.uint64)
            else:
                found = np.zeros(len(flat), np.uint64)
            key = (found << np.uint64(56)) | (flat >> np.uint64(8))
            owner = np.repeat(np.arange(len(n)), n)
            order = np.lexsort((key, owner))
            key = key[order]
            rest = np.repeat(np.cumsum(n), n) - np.arange(len(key))
            keep = rest >= np.ceil(least * n)[owner]
            if whole:
                keep &= key >> np.uint64(56) > 0
            key, owner, rest = key[keep], owner[keep], rest[keep]
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for lo in range(0, len(key), 100_000):
                o = owner[lo : lo + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(key[lo : lo + 100_000].view(np.int64)), pa.array(ids[o]), pa.array(n[o].astype(np.int32)), pa.array(rest[lo : lo + 100_000].astype(np.int32))], names=["run", "id", "n", "rest"])

    return make


def _counted_pairs(a: list[np.ndarray], b: list[np.ndarray], need: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    x, y, q = np.concatenate(a), np.concatenate(b), np.concatenate(need).astype(np.int64)
    x, y = np.minimum(x, y), np.maximum(x, y)
    order = np.lexsort((y, x))
    x, y, q = x[order], y[order], q[order]
    first = np.flatnonzero(np.r_[True, (x[1:] != x[:-1]) | (y[1:] != y[:-1])])
    x, y, q, k = x[first], y[first], q[first].astype(np.uint8), np.diff(np.append(first, len(x))).astype(np.uint32)
    part = mix(x.view(np.uint64)) % np.uint64(PAIR_PARTS)
    order = np.argsort(part, kind="stable")
    x, y, q, k = x[order], y[order], q[order], k[order]
    cuts = np.searchsorted(part[order], np.arange(PAIR_PARTS + 1, dtype=np.uint64)).tolist()
    made = [(p, hi - lo, _pack(np.diff(x[lo:hi], prepend=np.int64(0))), _pack(y[lo:hi] - x[lo:hi]), _pack(k[lo:hi]), _pack(q[lo:hi])) for p, (lo, hi) in enumerate(zip(cuts, cuts[1:])) if lo < hi]
    kinds = pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary()
    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*made), kinds)], names=["part", "n", "a", "b", "k", "need"])


def likely(rows: pa.Table) -> pa.Table:
    """Pairs ``(a, b)`` of one share of all counted pairs that share as many elements as they must."""
    rows = rows.to_pylist()
    x = [np.cumsum(_unpack(r["a"], r["n"], np.int64)) for r in rows]
    x, y = np.concatenate(x), np.concatenate([_unpack(r["b"], r["n"], np.int64) + v for r, v in zip(rows, x)])
    k, need = (np.concatenate([_unpack(r[c], r["n"], t) for r in rows]).astype(np.int64) for c, t in (("k", np.uint32), ("need", np.uint8)))
    order = np.lexsort((y, x))
    x, y = x[order], y[order]
    first = np.flatnonzero(np.r_[True, (x[1:] != x[:-1]) | (y[1:] != y[:-1])])
    keep = np.add.reduceat(k[order], first) >= np.minimum.reduceat(need[order], first)
    return pa.table({"a": pa.array(x[first][keep]), "b": pa.array(y[first][keep])})


def _pairs(run: np.ndarray, ids: np.ndarray, n: np.ndarray, rest: np.ndarray, least: float) -> Iterator[pa.RecordBatch]:
    """Pairs of whole runs: each row with those behind it in its run, in the order of n, until they are too large for it."""
    order = np.lexsort((n, run))
    run, ids, n, rest = run[order], ids[order], n[order].astype(np.int64), rest[order].astype(np.int64)
    first = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
    size = np.diff(np.append(first, len(run)))
    end = np.repeat(first + size, size)
    a, b, need, made = [], [], [], 0
    i, step = np.arange(len(run)), 1
    while True:
        i = i[i + step < end[i]]
        if not len(i):
            break
        j = i + step
        overlap = np.ceil(least / (1 + least) * (n[i] + n[j]))
        # Both bounds tighten as n[j] grows, so a row that fails here is done.
        ok = (n[i] >= least * n[j]) & (rest[i] > overlap - SHARED)
        i, j, overlap = i[ok], j[ok], overlap[ok]
        asked = np.clip(overlap - np.ceil(least * n[j]) + 1, 1, SHARED)
        ok = (np.minimum(rest[i], rest[j]) > overlap - asked) & (ids[i] != ids[j])
        a.append(ids[i[ok]])
        b.append(ids[j[ok]])
        need.append(asked[ok])
        made += len(a[-1])
        if made >= PAIR_BLOCK:
            yield from _counted_pairs(a, b, need)
            a, b, need, made = [], [], [], 0
        step += 1
    if made:
        yield from _counted_pairs(a, b, need)


def pairs(least: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows ``(a, b, k, need)``, packed by shares, of prefix rows sorted by run: sets a < b that share k elements which count, of ``need`` that they must share.

    Sets x and y of that similarity share at least o = ceil(s / (1 + s) (|x| + |y|)) elements. Of the first q of them, in the order
    of all elements, each is followed by o - q others, so in both sets at least o - q + 1 elements remain from it on. Elements in
    that place count; q is the greatest number up to SHARED for which the prefixes hold all such elements.
    """

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, most = [], 0, PAIR_BLOCK
        for batch in chain(batches, [None]):
            if batch is not None:
                held.append([batch.column(c).to_numpy(zero_copy_only=False) for c in range(4)])
                rows += batch.num_rows
            if rows and (batch is None or rows >= most):
                run, ids, n, rest = (np.concatenate(x) for x in zip(*held))
                cut = len(run) if batch is None else int(np.searchsorted(run, run[-1]))
                if cut:
                    yield from _pairs(run[:cut], ids[:cut], n[:cut], rest[:cut], least)
                held, rows = [[run[cut:], ids[cut:], n[cut:], rest[cut:]]], len(run) - cut
                most = rows + PAIR_BLOCK

    return make


def sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``(id, value)``, a sketch, of sets ``(id, set)``: each element flips one bit of a map of BITS or more bits an element, a power of two."""
    for batch in _slices(batches):
        flat, n = _elements(batch.column(1))
        width = np.int64(1) << np.ceil(np.log2(np.maximum(64, BITS * n))).astype(np.int64)
        end = np.cumsum(width)
        at = np.repeat(end - width, n) + (flat & np.repeat(width - 1, n).astype(np.uint64)).astype(np.int64)
        data = np.packbits(np.bincount(at, minlength=int(end[-1])) & 1).tobytes()
        cuts = (np.append(0, end) // 8).tolist()
        made = [pa.array(n, pa.int32()), pa.array([data[lo:hi] for lo, hi in zip(cuts, cuts[1:])], pa.binary())]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.StructArray.from_arrays(made, names=["n", "bits"])], names=["id", "value"])


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Array]]:
    """Ids a and b of pairs, the places i and j of their values, and the values, of blocks of whole groups.

    A group, rows ``(key, a, b, value)`` in a row, has the values of its members, where b is null, and pairs of them.
    """
    held, size, most = [], 0, BYTES
    for batch in chain(batches, [None]):
        if batch is not None:
            held.append(batch)
            size += batch.nbytes
        if not held or batch is not None and size < most:
            continue
        block = pa.Table.from_batches(held).combine_chunks()
        key = block.column("key").to_numpy()
        cut = len(key) if batch is None else int(np.searchsorted(key, key[-1]))
        rest = block.slice(cut)
        held, size, most = rest.to_batches(), rest.nbytes, rest.nbytes + BYTES
        if cut:
            key, block = key[:cut], block.slice(0, cut)
            member = block.column("b").is_null().to_numpy()
            a, b = (block.column(c).fill_null(0).to_numpy() for c in ("a", "b"))
            values = block.column("value").filter(pa.array(member)).combine_chunks()
            names, a_at = np.unique(np.append(a, b[~member]), return_inverse=True)
            a_at, b_at = a_at[: len(a)], a_at[len(a) :]
            group = np.cumsum(np.r_[False, key[1:] != key[:-1]]) * len(names)
            places = (group + a_at)[member]
            order = np.argsort(places, kind="stable")
            places = places[order]
            wanted = (group + a_at)[~member], group[~member] + b_at
            i, j = (np.minimum(np.searchsorted(places, x), max(0, len(places) - 1)) for x in wanted)
            ok = (places[i] == wanted[0]) & (places[j] == wanted[1]) if len(places) else np.zeros(len(i), bool)
            if ok.any():
                yield a[~member][ok], b[~member][ok], order[i[ok]], order[j[ok]], values


def close(least: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Pairs ``(a, b)`` of groups with sketches (:func:`_groups`) that leave that similarity possible.

    A bit in which two sketches differ needs an element that only one of the sets holds, and elements of both flip the same bits,
    so h different bits leave at most (|x| + |y| - h) / 2 shared elements. A longer map is folded: its halves differ in the bit that the shorter one leaves out.
    """

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for a, b, i, j, values in _groups(batches):
            n, bits = values.field("n").to_numpy().astype(np.int64), values.field("bits")
            size = pc.binary_length(bits).to_numpy().astype(np.int64)
            data, start = np.frombuffer(b"".join(bits.to_pylist()), np.uint64), (np.cumsum(size) - size) // 8
            words, differ = size // 8, np.zeros(len(a), np.int64)
            for u, v in np.unique(np.stack([words[i], words[j]], 1), axis=0):
                rows = np.flatnonzero((words[i] == u) & (words[j] == v))
                step = max(1, BYTES // 8 // int(u + v))
                for lo in range(0, len(rows), step):
                    r = rows[lo : lo + step]
                    x, y = (data[start[at[r]][:, None] + np.arange(w)] for at, w in ((i, u), (j, v)))
                    while x.shape[1] != y.shape[1]:
                        x, y = sorted((x, y), key=lambda z: z.shape[1])
                        half = y.shape[1] // 2
                        y = y[:, :half] ^ y[:, half:]
                    differ[r] = np.bitwise_count(x ^ y).sum(1)
            both = n[i] + n[j]
            keep = (both - differ) * (1 + least) >= 2 * least * both
            yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep])], names=["a", "b"])

    return make


def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``(a, b, shared, n_a, n_b)`` of groups with sets (:func:`_groups`): the elements that both hold, and those of each."""
    for a, b, i, j, values in _groups(batches):
        n = pc.list_value_length(values).to_numpy().astype(np.int32)
        flat, end = values.flatten().to_numpy(), np.cumsum(n, dtype=np.int64)
        sets = [flat[hi - k : hi] for hi, k in zip(end.tolist(), n.tolist())]
        k = [len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for x, y in zip(i.tolist(), j.tolist())]
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(k, pa.int32()), pa.array(n[i]), pa.array(n[j])], names=["a", "b", "shared", "n_a", "n_b"])
