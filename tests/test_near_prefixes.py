"""The prefix search for near pairs: little to shuffle, no pair lost."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from veridoc.operators import integrity, prefixes
from veridoc.plans import integrity as plans


def _templates(n: int) -> list[list[int]]:
    """Sets of few elements of their own and many common ones, every tenth an edited copy of the one before."""
    rng, out = random.Random(8), []
    for i in range(n):
        if i % 10 == 9:
            out.append([e for e in out[-1] if rng.random() > 0.15] + [10**6 + i])
        else:
            out.append([2000 + 50 * i + j for j in range(rng.randrange(12))] + rng.sample(range(150), rng.randrange(1, 40)))
    return out


def _sets(spark, sets):
    return spark.createDataFrame(list(enumerate(sets)), "id bigint, e array<bigint>").select("id", F.transform("e", lambda e: F.xxhash64(e)).alias("set"))


def _brute(sets: list[list[int]], least: float) -> set:
    s = [set(x) for x in sets]
    return {(i, j) for i in range(len(s)) for j in range(i + 1, len(s)) if len(s[i] & s[j]) / len(s[i] | s[j]) >= least}


@pytest.mark.parametrize("most", [integrity.MOST_COMMON, 40, 0])
@pytest.mark.parametrize("least", [0.55, 0.8])
def test_no_pair_is_lost_however_few_frequencies_are_known(spark, monkeypatch, most, least):
    monkeypatch.setattr(integrity, "MOST_COMMON", most)
    sets = _templates(400)
    got = {(r.left_id, r.right_id) for r in integrity.near_pairs(_sets(spark, sets), least).collect()}
    want = _brute(sets, least)
    assert got == want and len(want) > 15


def test_likely_pairs_are_few(spark):
    """Common elements at late places make no likely pair (136,431 before)."""
    sets = _templates(1000)
    want, got = _brute(sets, 0.55), {(r.a, r.b) for r in integrity.prefix_candidates(_sets(spark, sets), 0.55).collect()}
    assert want <= got and len(got) < 50_000


def test_packed_counts_come_back():
    x = np.array([0, 5, 6, 2**32 - 1], np.uint32)
    assert (prefixes.fingerprints(prefixes._steps(x), 4) == x).all()
    assert (prefixes._unpack(prefixes._pack(x), 4, np.uint32) == x).all()


def _written(monkeypatch, query, spark, data) -> int:
    """Rows with the runs of a document that a query writes."""
    rows = []
    for module in (plans, integrity):
        plain = module.materialise

        def counted(df, name="stage", plain=plain):
            out = plain(df, name)
            if name != "items" and {"set", "runs"} & set(out.columns) and name != "frequency":
                rows.append(out.count())
            return out

        monkeypatch.setattr(module, "materialise", counted)
    query(spark, data).collect()
    return sum(rows)


def test_audit_writes_only_sets_of_likely_pairs(spark, data, monkeypatch):
    """All records with their sets, and the heads once more, were written before."""
    assert _written(monkeypatch, plans.audit_summary, spark, data) < spark.read.parquet(f"{data}/documents.parquet").count() / 2


def test_simhash_pairs_write_only_sets_of_likely_pairs(spark, data, monkeypatch):
    """The runs of all documents, as text, and the sets of all heads were written before."""
    assert _written(monkeypatch, plans.simhash_candidates, spark, data) < spark.read.parquet(f"{data}/documents.parquet").count() / 2
