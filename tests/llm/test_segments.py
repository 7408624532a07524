"""Short sentences, two-window segments and open fences have languages too."""

from __future__ import annotations

import numpy as np

from veridoc.llm import language


class Marked:
    """A network that knows the first two languages by the letters q and z."""

    def probabilities(self, items):
        p = np.zeros((len(items), language.NONE + 1))
        for i, w in enumerate(items):
            q, z = w.count(b"q"), w.count(b"z")
            p[i, [0, 1, language.NONE]] = np.array([q, z, 0 if q + z else 1]) / max(1, q + z)
        return p


def _found(text):
    return {c for c, _, _ in language.decide(language.segment_languages(Marked(), [text])[0])}


ONE, TWO = language.CODES[:2]


def test_short_sentences_count_together():
    assert _found("aq bq. Aq cq dq! Bq. Cq dq aq.".replace("q", "qq")) == {ONE}
    assert _found("aqq bqq [[cqq]] dqq „eqq“ fqq") == {ONE}
    assert _found("aqq bqq cqq. dqq eqq fqq. azz bzz czz. dzz ezz fzz.") == {ONE, TWO}
    assert _found("aqq bqq\n\ncqq dqq\n\neqq fqq") == set()
    assert _found("aqq bqq. cqq dqq.") == set()


def test_two_windows_of_two_languages():
    text = " ".join(["aqqqq"] * 16) + " " + " ".join(["azzzz"] * 16)
    assert len(language.windows(text)) == 2 and _found(text) == {ONE, TWO}
    assert _found(" ".join(["aqqqq"] * 32)) == {ONE}


def test_only_closed_fences_are_blank():
    assert _found("``` aqq bqq cqq dqq eqq fqq gqq.") == {ONE}
    assert _found("``` aqq bqq cqq dqq eqq fqq gqq. ``` azz bzz czz dzz ezz fzz gzz.") == {TWO}


def test_mixed_texts_split_into_their_languages(spark, data):
    """Held-out sentences of two languages in one text: characters get the right language, and the confidence is honest."""
    samples = [(r.lang, r.text) for r in spark.read.parquet(f"{data}/lang_samples.parquet").orderBy("sample_id").collect()]
    docs = language.training_windows(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), 600).collect()
    net = language.train([s for i, s in enumerate(samples) if i % 3], [(r.code, bytes(r.window)) for r in docs], epochs=6)
    held = [s for i, s in enumerate(samples) if i % 3 == 0]
    rng = np.random.default_rng(4)
    right = total = sure = said = 0
    for _ in range(150):
        (c1, t1), (c2, t2) = (held[i] for i in rng.choice(len(held), 2, replace=False))
        text = t1 + " " + t2
        rows = language.segment_languages(net, [text])[0]
        for a, b, lang, confidence in language._joined(rows, {x[0] for x in language.decide(rows)}):
            for lo, hi, want in ((0, len(t1), c1), (len(t1) + 1, len(text), c2)):
                n = max(0, min(b, hi) - max(a, lo))
                total += n
                right += n * (lang == want)
                if lang is not None:
                    sure += n * confidence
                    said += n
    assert right >= 0.93 * total
    assert abs(sure / said - right / said) < 0.08


def test_weights_are_kept(spark, data, monkeypatch, tmp_path):
    """The second query with the same rows uses the weights, and so does another process with the folder; other rows are trained anew."""
    store = f"file://{tmp_path}/weights"
    docs, samples = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/lang_samples.parquet")
    calls = []
    plain = language.train
    monkeypatch.setattr(language, "TRAINING_WINDOWS", 20)
    monkeypatch.setattr(language, "_FITTED", {})

    def counted(a, b, epochs=1, seed=5):
        calls.append(len(a))
        return plain(a, b, epochs, seed)

    monkeypatch.setattr(language, "train", counted)
    first = language.detector(docs, samples, store)
    assert language.detector(docs, samples) is first
    language._FITTED.clear()
    again = language.detector(docs, samples, store)
    assert len(calls) == 1 and all((first.tables[w] == again.tables[w]).all() for w in language.WIDTHS)
    language.detector(docs, samples.where("lang <> 'de'"))
    assert len(calls) == 2


def test_training_windows_are_bounded(spark, data):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    counts = {r.code: r["count"] for r in language.training_windows(docs, per_label=64).groupBy("code").count().collect()}
    assert counts and max(counts.values()) <= 64
