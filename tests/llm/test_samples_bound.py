"""Labelled sentences beyond the bound are an error, never left out."""

from __future__ import annotations

import numpy as np
import pytest

from veridoc.llm import language


def test_more_labelled_sentences_than_the_bound(spark, data, monkeypatch):
    docs = spark.read.parquet(f"{data}/documents.parquet").limit(5)
    samples = spark.createDataFrame([("de", "a"), ("ru", "b"), ("sv", "c")], "lang string, text string")
    taken = []
    monkeypatch.setattr(language, "_FITTED", {})
    monkeypatch.setattr(language, "train", lambda clean, documents: taken.extend(clean) or language.Network(np.random.default_rng(0)))
    monkeypatch.setattr(language, "LABELLED_SENTENCES", 3, raising=False)
    language.detector(docs, samples)
    assert [c for c, _ in taken] == ["de", "ru", "sv"]
    monkeypatch.setattr(language, "LABELLED_SENTENCES", 2, raising=False)
    with pytest.raises(ValueError):
        language.detector(docs, samples)
