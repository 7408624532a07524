"""A paraphrase is found wherever it stands in a document."""

from __future__ import annotations

import random

from veridoc.llm import leaks


def test_paraphrase_at_every_offset(spark):
    text = [f"term{i}" for i in range(20)]
    form = "array<struct<prompt:string,candidates:array<struct<text:string>>>>"
    items = spark.createDataFrame([("q", [(" ".join(text), [(" ".join(text),)])])], f"item_id string, forms {form}")
    part = [f"other{i}" if i % 10 in (2, 5, 8) else w for i, w in enumerate(text)]
    docs = [(o, " ".join([f"x{i}" for i in range(o)] + part + [f"y{i}" for i in range(60)])) for o in range(64)]
    # Documents with the words in another order, so that no word of the text is rare.
    docs += [(1000 + i, " ".join(text[::-1])) for i in range(300)]
    found = leaks.leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), None, items).where("kind = 'paraphrase'")
    assert sorted(r.doc_id for r in found.select("doc_id").distinct().collect()) == list(range(64))


def test_planted_paraphrases_are_found(spark, data):
    """Prompts with an answer, every tenth to fifth word replaced, at random places of other texts: of those that keep
    the share of words in order that makes a paraphrase, nine in ten or more come out."""
    rng = random.Random(11)
    items = spark.read.parquet(f"{data}/eval_items.parquet")
    ev = next(leaks.evaluation_blocks(items))
    others = [leaks.words(r.text) for r in spark.read.parquet(f"{data}/documents.parquet").select("text").collect() if r.text]
    pool = [w for t in others[:60] for w in t]
    docs, want = [], {}
    for n, text in enumerate(ev.words):
        if ev.kind[n] != "prompt":
            continue
        answers = [k for k in range(len(ev.words)) if ev.form[k] == ev.form[n] and ev.kind[k] == "candidate"]
        whole = text + ev.words[rng.choice(answers)]
        part = [rng.choice(pool) if rng.random() < (0.1 if n % 2 else 0.2) else w for w in whole]
        host = rng.choice([t for t in others if len(t) < 500])
        at = rng.randrange(len(host) + 1)
        body = host[:at] + part + host[at:]
        share = lambda k: leaks.best_window(ev.words[k], body) / len(ev.words[k])
        if share(n) >= leaks.PARAPHRASE_LCS and max(map(share, answers)) >= leaks.PARAPHRASE_LCS:
            want[len(docs)] = ev.item[n]
        docs.append((len(docs), " ".join(body)))
    assert len(want) > 80
    found = {(r.doc_id, r.item_id) for r in leaks.leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), None, items).collect()}
    assert sum((d, i) in found for d, i in want.items()) >= 0.9 * len(want)


def test_blocks_of_evaluation_texts_give_the_same_leaks(spark, data):
    items = spark.read.parquet(f"{data}/eval_items.parquet")
    docs = spark.read.parquet(f"{data}/documents.parquet")
    once, many = (leaks.exact(leaks.leaks(docs, None, items, most=m)) for m in (leaks.BLOCK_CHARACTERS, 20_000))
    assert sorted(map(tuple, once.collect()), key=str) == sorted(map(tuple, many.collect()), key=str)


def test_short_evaluation_texts_leak_as_paraphrases(spark):
    form = "array<struct<prompt:string,candidates:array<struct<text:string>>>>"
    items = spark.createDataFrame([("q", [("one two three four five six", [("red green blue",)])])], f"item_id string, forms {form}")
    docs = spark.createDataFrame([(1, "so one two three and four five six or red green blue"), (2, "red one")], "doc_id bigint, text string")
    assert {(r.doc_id, r.kind) for r in leaks.leaks(docs, None, items).collect()} == {(1, "paraphrase")}


def test_best_window_tries_every_stretch():
    rng = random.Random(8)
    for _ in range(300):
        text = [rng.choice("abcdefgh") for _ in range(rng.randint(1, 9))]
        doc = [rng.choice("abcdefghijklmnop") for _ in range(rng.randint(0, 60))]
        want = max(leaks.common_subsequence(text, doc[k : k + 2 * len(text)]) for k in range(len(doc) + 1))
        assert leaks.best_window(text, doc) == want
