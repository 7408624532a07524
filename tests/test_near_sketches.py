"""Sketches of sets: they leave out likely pairs that are too far apart, never one that reaches the similarity."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from test_near_prefixes import _brute, _sets, _templates

from veridoc.operators import integrity, prefixes


def _close(sets: list[np.ndarray], pairs: list[tuple[int, int]], least: float) -> set:
    made = pa.RecordBatch.from_arrays([pa.array(range(len(sets)), pa.int64()), pa.array([s.tolist() for s in sets], pa.list_(pa.int64()))], names=["id", "set"])
    sketches = pa.concat_arrays([b.column("value") for b in prefixes.sketches([made])])
    none = pa.nulls(len(pairs), sketches.type)
    a, b = (pa.array(x, pa.int64()) for x in zip(*pairs))
    rows = [(made.column("id"), pa.nulls(len(sets), pa.int64()), sketches), (a, b, none)]
    met = [pa.RecordBatch.from_arrays([pa.array([7] * len(x), pa.int64()), x, y, v], names=["key", "a", "b", "value"]) for x, y, v in rows]
    return {(r["a"], r["b"]) for out in prefixes.close(least)(met) for r in out.to_pylist()}


@pytest.mark.parametrize("least", [0.55, 0.8])
def test_a_pair_that_reaches_the_similarity_stays(least):
    """Over sizes on both sides of a power of two, where maps of two lengths meet, down to the limit itself."""
    rng, sets, pairs, near, far = np.random.default_rng(5), [], [], set(), set()
    for n in [1, 2, 3, 15, 16, 17, 20, 31, 40, 100, 255, 256, 257, 300, 1000, 3000]:
        x = rng.integers(-(2**63), 2**63, n)
        for kept in sorted({n, int(np.ceil(least * n)), min(n, int(np.ceil(least * n)) + 1), n // 3, 0}):
            for more in (0, n // 10, n):
                y = np.append(x[:kept], rng.integers(-(2**63), 2**63, more))
                pairs += [(len(sets), len(sets) + 1), (len(sets) + 1, len(sets))]
                if kept / (n + more) >= least:
                    near.update(pairs[-2:])
                elif n >= 100 and kept / (n + more) < least - 0.2 and kept + more >= least * n:  # the prefix search leaves out other sizes
                    far.update(pairs[-2:])
                sets += [x, y]
    got = _close(sets, pairs, least * (1 - 1e-9))
    assert near <= got and len(far & got) < len(far) / 5 and min(len(near), len(far)) > 20


def _rows(spark, monkeypatch, sets) -> tuple[set, dict[str, int]]:
    """The pairs, and the rows of each table that is written on the way."""
    rows, plain = {}, integrity.materialise

    def counted(df, name="stage"):
        out = plain(df, name)
        rows[name] = out.count()
        return out

    monkeypatch.setattr(integrity, "materialise", counted)
    return {(r.left_id, r.right_id) for r in integrity.near_pairs(_sets(spark, sets), 0.55).collect()}, rows


def test_only_sets_of_close_pairs_move(spark, monkeypatch):
    """Every set of a likely pair was written, and moved once for each of its pairs, before."""
    sets = _templates(1000)
    got, rows = _rows(spark, monkeypatch, sets)
    assert got == _brute(sets, 0.55) and rows["likely"] > 3000
    assert rows["close"] < rows["likely"] / 4 and rows["members"] < 2 * rows["close"] and "sets" not in rows


@pytest.mark.parametrize("most", [integrity.PAIRS_PER_GROUP, 50])
def test_sets_of_similar_texts_move_once(spark, monkeypatch, most):
    """Twenty groups of twenty similar sets: a set moved for each of its pairs, 3,800 in all, before. Groups of many pairs go in shares."""
    monkeypatch.setattr(integrity, "PAIRS_PER_GROUP", most)
    sets = [[1000 * g + e for e in range(40)] + [10**6 + 100 * g + i] for g in range(20) for i in range(20)]
    got, rows = _rows(spark, monkeypatch, sets)
    assert got == _brute(sets, 0.55) and len(got) == 20 * 190
    assert rows["members"] == 400 if most > 190 else 400 < rows["members"] < 3000
