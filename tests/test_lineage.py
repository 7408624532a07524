"""Lineage over whole histories against brute force: no chain ends at midnight."""

from __future__ import annotations

import datetime
import random

import pytest

from veridoc.operators import history
from veridoc.plans import registry

QUERIES = registry.queries()


def _brute(rows):
    """``(pairs, chronology, evidence, rollbacks)`` of rows (page, revision, ts, parent, digest), pair by pair."""
    by = {(p, r): (t, up, d) for p, r, t, up, d in rows}
    lines = {}
    for p, r, *_ in rows:
        line, at = [], by[p, r][1]
        while at is not None:
            line.append(at)
            at = by[p, at][1] if (p, at) in by else None
        lines[p, r] = line
    pairs = {(p, r, a, k + 1) for (p, r), line in lines.items() for k, a in enumerate(line)}
    order, evidence, back = set(), set(), set()
    for p, r, t, up, d in rows:
        if up is None:
            continue
        times = [by[p, a][0] for a in lines[p, r] if (p, a) in by]
        if times:
            known = [x for x in times if x is not None and t is not None]
            order.add((p, r, "inversion" if any(x > t for x in known) else "equal-time" if any(x == t for x in known) else "ordered"))
        found = set(lines[p, r][1:])
        for q, o, s, *_ in rows:
            if q == p and o not in (r, up) and r not in lines[p, o] and s is not None and t is not None and s < t:
                found.add(o)
        if found:
            evidence.add((p, r, len(found)))
        if any((p, o) in by and d is not None and by[p, o][2] == d for o in found):
            back.add((p, r))
    return pairs, order, evidence, back


def test_lineage_over_midnight(spark, tmp_path):
    rng, start = random.Random(3), datetime.datetime(2020, 1, 1, 22)
    events = [(i, start + datetime.timedelta(hours=rng.randint(0, 90)), i % 3, rng.choice("ab"), rng.uniform(0, 150)) for i in range(60)]
    spark.createDataFrame(events, "event_id bigint, ts timestamp, user_id bigint, event_type string, value double").write.parquet(f"file://{tmp_path}/events.parquet")
    rows, last = [], {}
    for i, t, u, kind, value in events:
        rows.append((u, i, t, last.get(u), (kind, int(value / 50))))
        last[u] = i
    pairs, order, evidence, back = _brute(rows)
    run = lambda name: [tuple(r) for r in QUERIES[name](spark, str(tmp_path)).collect()]
    assert sorted(run("ancestor_pairs")) == sorted(pairs) and len(pairs) == 3 * 190
    assert sorted(run("revision_chronology")) == sorted(order)
    assert sorted(run("earlier_evidence")) == sorted(evidence)
    assert sorted(run("rollback_signals")) == sorted(back) and back


@pytest.mark.parametrize("seed", range(3))
def test_lineage_of_branching_histories(spark, seed):
    rng = random.Random(seed)
    rows = []
    for page in range(4):
        for r in range(40):
            up = None if r == 0 or rng.random() < 0.1 else 900 if rng.random() < 0.05 else rng.randrange(r)
            t = None if rng.random() < 0.05 else datetime.datetime(2020, 1, 1) + datetime.timedelta(hours=r + rng.randint(-6, 6))
            rows.append((page, r, t, up, rng.choice(["x", "y", "z", None])))
    df = spark.createDataFrame(rows, "page bigint, r bigint, ts timestamp, up bigint, digest string")
    pairs, order, evidence, back = _brute(rows)
    got = history.lineage(df, "page", "r", "up", "ts", "digest").collect()
    assert {(x.page, x.r, x.chronology) for x in got if x.chronology} == order
    assert {(x.page, x.r, x.n_evidence) for x in got if x.n_evidence} == evidence
    assert {(x.page, x.r) for x in got if x.rollback} == back
    assert {tuple(x) for x in history.ancestors(df, "page", "r", "up").collect()} == pairs


def test_lineage_refuses_cycles_and_repeated_revisions():
    with pytest.raises(ValueError):
        history._walk([1, 2], [2, 1])
    with pytest.raises(ValueError):
        history._walk([1, 1], [None, None])
