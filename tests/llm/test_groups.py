"""Every document has one row in the groups of near-duplicates, however short its text."""

from __future__ import annotations

import random

import pytest

from veridoc.functions import text
from veridoc.llm import near


@pytest.mark.parametrize("share", [2, 20_000])
def test_each_document_has_one_group(spark, monkeypatch, share):
    monkeypatch.setattr(near, "ROWS_PER_SHARE", share)
    long = " ".join(f"w{i}" for i in range(60))
    texts = [long, None, "", "--- !", "Two words", "two, WORDS.", long + " end", "one two three four five", "other words", "one two three four five"]
    texts += ["hot"] * 9
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = sorted(map(tuple, near.groups(df.repartition(3)).collect()))
    classes = [0, 1, 2, 3, 4, 4, 6, 7, 8, 7] + [10] * 9
    links = {0: 1, 6: 1}
    assert got == [(i, c, 0 if c == 6 else c, links.get(c, 0)) for i, c in enumerate(classes)]
    pairs = sorted(map(tuple, near.near_pairs(df).collect()))
    assert pairs == [(0, 6)]


def _brute(texts, run, similarity):
    sets = [{tuple(w[i : i + run]) for i in range(len(w) - run + 1)} for w in (t.split() for t in texts)]
    return [(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if sets[i] and sets[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= similarity]


@pytest.mark.parametrize("most", [3, 64])
def test_one_band_key_shared_by_a_tenth_of_the_texts(spark, monkeypatch, most):
    """A boilerplate start makes band keys hot; hot keys build no pairs, and no similar pair is lost."""
    monkeypatch.setattr(near, "BAND_TEXTS", most)
    rng = random.Random(5)
    start = [f"b{i}" for i in range(60)]
    texts = []
    for i in range(300):
        own = [f"w{rng.randrange(10**6)}" for _ in range(60)]
        texts.append(" ".join((start + own[:40] if i % 10 == 0 else own)))
        if i % 15 == 0:
            texts.append(texts[-1] + " more")
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    sizes = []
    plain = near.integrity.prefix_candidates

    def counted(sets, similarity):
        sizes.append(sets.count())
        return plain(sets, similarity)

    monkeypatch.setattr(near.integrity, "prefix_candidates", counted)
    got = sorted(map(tuple, near.near_pairs(df, run=4, similarity=0.55).collect()))
    assert got == _brute(texts, 4, 0.55) and len(got) >= 20
    assert bool(sizes) == (most == 3)


def test_recall_of_groups(spark, data):
    """Runs of five words, similarity 0.8, against all pairs of the documents and of planted edits."""
    rng = random.Random(6)
    texts = [" ".join(text.words(r.text)) for r in spark.read.parquet(f"{data}/documents.parquet").select("text").collect() if r.text]
    texts = [t for t in dict.fromkeys(texts) if len(t.split()) >= 5]
    for t in texts[:80]:
        w = t.split()
        w[rng.randrange(len(w))] = "edited"
        texts.append(" ".join(w))
    texts = list(dict.fromkeys(texts))
    want = _brute(texts, 5, 0.8)
    got = near.groups(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()
    assert len(want) > 40 and sum(r.n_links for r in got) >= 0.99 * 2 * len(want)
    group = {r.doc_id: r.group_id for r in got}
    assert sum(group[i] == group[j] for i, j in want) >= 0.99 * len(want)
