"""Scalar functions, timestamps and rules against values worked out by hand."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from veridoc.functions import dates, hashing, markup, rights, text
from veridoc.functions.labels import domain_label, language_code, path_key
from veridoc.operators import integrity, rules, timestamps
from veridoc.runtime import running_total, salted_join




def test_words_and_vectorised_words_agree():
    texts = ["Straße, don't co-op --x-- 'a' ﬁne", "", None, "日本 12_b", "a-b-c a--b -", "İ ß ſ"]
    array, counts = text.word_array(texts)
    flat = [w.decode() for w in array.dictionary.take(array.indices).to_pylist()]
    assert flat == [w for t in texts for w in text.words(t)]
    assert counts.tolist() == [len(text.words(t)) for t in texts]


def test_word_runs_are_sets_of_windows():
    sets = text.run_sets(text.WordHasher(), ["a b c d a b c d", "a b c", "x a b c d"], 4)
    assert [len(s) for s in sets] == [4, 0, 2]
    assert len(np.intersect1d(sets[0], sets[2])) == 1


def test_labels(spark):
    rows = [("EN_us", "en"), (" Deutsch", None), ("german", "de"), ("jpn", "ja"), ("und", None), ("", None), (None, None), ("pt-BR", "pt")]
    df = spark.createDataFrame(rows, "a string, b string").select(language_code("a").alias("x"), "b")
    assert [r.x for r in df.collect()] == [b for _, b in rows]
    p = spark.createDataFrame([("./A\\b//C.txt",), ("a/b/c.txt",), ("/a/b/c.txt",)], "p string").select(path_key("p").alias("k")).distinct().collect()
    assert [r.k for r in p] == ["a/b/c.txt"]
    assert spark.createDataFrame([("Field_Ecology ",)], "d string").select(domain_label("d")).first()[0] == "field-ecology"


READ = [
    ("2013-08-09T01:55:04Z", None, None, None, "2013-08-09T01:55:04"),
    ("2019-02-20 16:57:42 +05:45", None, None, None, "2019-02-20T11:12:42"),
    ("08/04/2018 21:04:50", None, "UTC", "dmy", "2018-04-08T21:04:50"),
    ("08/04/2018 09:04:50 PM", None, "UTC", "mdy", "2018-08-04T21:04:50"),
    ("Wed, 01 Jan 2020 01:40:27 CET", None, None, None, "2020-01-01T00:40:27"),
    ("1553014649000", None, None, None, "2019-03-19T16:57:29"),
    ("20130711133658", "revision; zone=+02:00", "Asia/Tokyo", None, "2013-07-11T11:36:58"),
    ("2018-W41-5T13:19:19Z", None, None, None, "2018-10-12T13:19:19"),
    ("2012-262T08:01:39Z", None, None, None, "2012-09-18T08:01:39"),
    ("Jul 29, 2018 12:40 a.m.", None, "UTC", None, "2018-07-29T00:40:00"),
    ("2018-11-04T01:30:00-05:00[America/Chicago]", None, None, None, "2018-11-04T06:30:00"),
    ("2018-11-04 01:30:00 CST", None, None, None, "2018-11-04T07:30:00"),
    ("2012-06-16 17:40 America/New_York", None, None, None, "2012-06-16T21:40:00"),
    ("2012-06-16 5:40 pm America/Chicago", None, None, None, "2012-06-16T22:40:00"),
    ("2012-06-16 5:40 p.m. AST", None, None, None, "2012-06-16T21:40:00"),
    ("2012-06-16 17:40 Pacific/Auckland", None, None, None, "2012-06-16T05:40:00"),
    ("2012-06-16 17:40 PST", None, None, None, "2012-06-17T01:40:00"),
    ("100000000", None, None, None, "1973-03-03T09:46:40"),
    ("1545823487505771", None, None, None, "2018-12-26T11:24:47.505771"),
]


@pytest.mark.parametrize("value,semantics,zone,order,want", READ)
def test_timestamp_readings(value, semantics, zone, order, want):
    found = timestamps.readings(value, semantics, zone, order)
    assert [(dt.datetime(1970, 1, 1) + dt.timedelta(microseconds=x[1])).isoformat() for x in found] == [want]


@pytest.mark.parametrize("value", [None, "", "  ", "NaT", "2013", "2013-02-30T10:00:00Z", "2014-04-23T25:23:00Z", "2013-08-09", "10/??/2014", "2018-03-11 02:30:00 America/Chicago", "2013-08-09T01:55:04", "Tue, 01 Jan 2020 01:40:27 CET"])
def test_timestamps_without_a_reading(value):
    assert timestamps.readings(value, None, None, None) == []


def test_fold_and_unknown_order_have_several_readings():
    assert len(timestamps.readings("2018-11-04 01:30:00", None, "America/Chicago", None)) == 2
    assert {x[0] for x in timestamps.readings("08/04/2018 21:04:50", None, "UTC", None)} == {"numeric-dmy", "numeric-mdy"}


def _runs(rng, n):
    rows = []
    for _ in range(n):
        k = int(rng.integers(1, 4))
        rows.append(([str(x) for x in rng.choice(list("abc"), k)], rng.integers(0, 20, k) * 86_400_000_000, rng.random(k)))
    return rows


def _cost(rows, path):
    total = rows[0][2][path[0]]
    for (f0, t0, _), (f1, t1, o), a, b in zip(rows, rows[1:], path, path[1:]):
        back = max(0, int(t0[a]) - int(t1[b])) / 86_400e6
        total += timestamps.SWITCH_COST * (f0[a] != f1[b]) + (timestamps.BACKWARD_COST + timestamps.BACKWARD_DAY_COST * back if back else 0) + o[b]
    return total


@pytest.mark.parametrize("seed", range(12))
def test_chunked_viterbi_equals_exhaustive_search(seed):
    import itertools

    rng = np.random.default_rng(seed)
    rows = [r if len(r[0]) > 1 else (r[0], r[1], np.zeros(1)) for r in _runs(rng, 7)]
    best = min(_cost(rows, p) for p in itertools.product(*[range(len(r[0])) for r in rows]))
    assert _cost(rows, timestamps.decode(rows)) == pytest.approx(best)
    parts = [rows[:3], rows[3:5], rows[5:]]
    matrices = []
    for part in parts:
        cost = np.where(np.eye(len(part[0][0]), dtype=bool), part[0][2][None, :], np.inf)
        for (f0, t0, _), (f1, t1, o) in zip(part, part[1:]):
            cost, _ = timestamps._step(cost, f0, t0, f1, t1, o)
        matrices.append((part[0][0], part[0][1], part[-1][0], part[-1][1], cost))
    path = [x for part, (a, b) in zip(parts, timestamps.chain(matrices)) for x in timestamps.decode(part, a, b)]
    assert _cost(rows, path) == pytest.approx(best)


def test_order_is_carried_through_records_that_do_not_show_it(spark):
    """A source that writes month first, with other notations between: every open date follows the closed ones."""
    rng = np.random.default_rng(3)
    reg = spark.createDataFrame([("s", "UTC", None), ("t", "UTC", None)], "source_id string, native_zone string, date_order string")
    rows, truth = [], {}
    for i in range(400):
        day = dt.datetime(2012, 1, 1) + dt.timedelta(days=int(rng.integers(0, 700)), hours=int(rng.integers(0, 24)))
        source, form = ("s", "%m/%d/%Y %H:%M") if i % 2 else ("t", "%d/%m/%Y %H:%M")
        rows.append((i, day.strftime(form if i % 5 < 2 else "%Y-%m-%dT%H:%M:00Z"), None, source))
        truth[i] = day.strftime("%Y-%m-%dT%H:%M:00.000000Z")
    df = spark.createDataFrame(rows, "meta_id bigint, native_timestamp string, timestamp_semantics string, source_id string")
    got = [r for r in timestamps.normalise(df, reg, chunks=5).collect() if r.status == "inferred"]
    assert len(got) > 30 and np.mean([r.utc_ts == truth[r.meta_id] for r in got]) >= 0.95


def test_fold_follows_the_order_of_records(spark):
    """Records every ten minutes over the hour that a zone had twice, without an offset."""
    reg = spark.createDataFrame([("s", "Europe/Berlin", None)], "source_id string, native_zone string, date_order string")
    start = dt.datetime(2018, 10, 27, 23, 0)
    zone = dt.timezone(dt.timedelta(hours=2)), dt.timezone(dt.timedelta(hours=1))
    rows, truth = [], {}
    for i in range(24):
        at = start + dt.timedelta(minutes=10 * i)
        local = at.replace(tzinfo=dt.timezone.utc).astimezone(zone[at >= dt.datetime(2018, 10, 28, 1)])
        rows.append((i, local.strftime("%Y-%m-%d %H:%M:%S"), None, "s"))
        truth[i] = at.strftime("%Y-%m-%dT%H:%M:00.000000Z")
    df = spark.createDataFrame(rows, "meta_id bigint, native_timestamp string, timestamp_semantics string, source_id string")
    got = timestamps.normalise(df, reg, chunks=3).collect()
    assert sum(r.status == "inferred" for r in got) == 12 and all(r.utc_ts == truth[r.meta_id] for r in got)


def test_normalise_chooses_by_order_of_records(spark):
    reg = spark.createDataFrame([("s", "UTC", None)], "source_id string, native_zone string, date_order string")
    values = ["25/03/2013 10:00:00", "04/05/2013 10:00:00", "26/05/2013 10:00:00", None, "x"]
    rows = spark.createDataFrame([(i, "S ", v, None) for i, v in enumerate(values)], "meta_id bigint, source_id string, native_timestamp string, timestamp_semantics string")
    got = {r.meta_id: (r.utc_ts, r.status) for r in timestamps.normalise(rows, reg, chunks=3).collect()}
    assert got[1] == ("2013-05-04T10:00:00.000000Z", "inferred")
    assert got[0][1] == "stated" and got[3] == (None, "undetermined") and got[4] == (None, "undetermined")
    assert timestamps.normalise(rows.limit(0), reg).count() == 0


def test_dates_and_rights(spark):
    d = spark.createDataFrame([("Tue, 01 Jan 2013 10:00:00 GMT",), ("Wed, 01 Jan 2013 10:00:00 GMT",)], "x string").select(dates.rfc822_date("x").isNotNull().alias("ok"))
    assert [r.ok for r in d.collect()] == [True, False]
    lic = spark.createDataFrame([("http://creativecommons.org/licenses/by/4.0/",), ("creative commons nc",), (None,), ("mine",)], "x string").select(rights.licence("x")["license_id"].alias("l"))
    assert [r.l for r in lic.collect()] == ["CC-BY-4.0", "creative-commons-other", "missing", "custom-or-unresolved"]
    many = spark.createDataFrame([(["CC BY 4.0"],), (["CC BY 4.0", "mine"],), ([],)], "x array<string>").select(rights.licence_of_many("x")["rights_status"].alias("r"))
    assert [r.r for r in many.collect()] == ["eligible", "unresolved", "unresolved"]


def test_hashes():
    assert len(hashing.base36_sha1(b"")) == 31
    o = {"b": 1.5, "a": "é", "h": ""}
    o["h"] = hashing.self_hash(o, "h")
    assert hashing.self_hash(o, "h") == o["h"] and hashing.canonical_json({"b": 1, "a": [None]}) == b'{"a":[null],"b":1}'


def test_wikitext():
    t, n = markup.clean_wikitext("'''A''' [[b|c]] {{x|{{{y}}}}}<ref>z</ref> [http://e.org d]\n code\n* list\n[[Category:Q]]\n== H ==\n<!-- k -->end")
    assert t == "A c d\n\nH end" or t.split() == ["A", "c", "d", "H", "end"]
    assert n["templates"] == 2 and n["comments"] == 1 and n["list_lines"] == 1 and n["preformatted_lines"] == 1
    for bad in ("{{a", "a}}", "<!-- x", "[[a", "<pre>a"):
        with pytest.raises(markup.MarkupError):
            markup.clean_wikitext(bad)


def test_markdown():
    t, n = markup.clean_markdown("See [a](http://x.y/(z)) and `code`.\n\n> quote\nlazy\n\n    indented\n```\nfence\n```\n**bold** [r][1]\n\n[1]: http://x.y\n-- \nme")
    assert t == "See a and .\n\nbold r"
    assert (n["links"], n["quote_lines"], n["fenced_code_blocks"], n["indented_code_lines"], n["signature_blocks"], n["reference_definitions"]) == (2, 2, 1, 1, 1, 1)
    assert markup.clean_title("a &lt;b&gt; <i>c</i>") == "a <b> c"
    assert markup.added_spans("a b c".split(), "a x y b c z".split()) == [(1, 3), (5, 6)]


def test_simhash_ties_and_empty(spark):
    df = spark.createDataFrame([(1, []), (2, ["a b c d"])], "id int, runs array<string>").select("id", integrity.simhash64("runs").alias("h"))
    got = {r.id: r.h for r in df.collect()}
    assert got[1] == "0" * 16 and got[2] != got[1] and len(got[2]) == 16


def test_jaccard_of_empty_sets(spark):
    df = spark.createDataFrame([([], []), (["a"], []), (["a", "b"], ["b"])], "x array<string>, y array<string>")
    assert [r.j for r in df.select(integrity.jaccard("x", "y").alias("j")).collect()] == [1.0, 0.0, 0.5]


def test_near_pairs_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    base = [" ".join(rng.choice(list("abcdefgh"), 20)) for _ in range(12)]
    texts = base + [b + " tail" for b in base[:6]] + base[:3] + ["", "a b"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts) if t not in texts[:i]], "id bigint, t string").select("id", text.run_hashes("t", [4], short=True).alias("set"))
    got = {(r.left_id, r.right_id) for r in integrity.near_pairs(df, 0.55).collect()}
    sets = [{tuple(t.split()[i : i + 4]) for i in range(len(t.split()) - 3)} or ({tuple(t.split())} if t.split() else set()) for t in texts]
    want = {(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if texts[i] not in texts[:i] and texts[j] not in texts[:j] and sets[i] and sets[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.55}
    assert got == want and len(want) > 5


def test_rules_report_everything(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "a", "x"), (3, "b", None)], "id int, a string, b string")
    got = rules.violations(df, "id", {"a": rules.blank("a"), "b": rules.not_in("b", ["y"])}).collect()
    assert sorted((r.id, r.rule) for r in got) == [(1, "a"), (1, "b"), (2, "b"), (3, "b")]
    assert sorted(r.id for r in rules.repeated(df, "id", "b", "r").collect()) == [1, 2]
    paths = ["a/b.txt", "../a", "a//b", "con/x", "a./b", "C:/x", None]
    ok = spark.createDataFrame([(p,) for p in paths], "p string").select(rules.portable_path("p").alias("k")).collect()
    assert [r.k for r in ok] == [True, False, False, False, False, False, False]


def test_salted_join_of_a_hot_key(spark):
    many = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"), "id")
    few = many.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    got = salted_join(many, few, ["k"], "n", 100)
    assert got.count() == 3000 and got.where("k = 'hot'").agg(F.min("n")).first()[0] == 1000


def test_running_total(spark):
    df = spark.range(100).select("id", (F.col("id") % 7).alias("v")).repartition(5)
    got = {r.id: r.s for r in running_total(df, "id", "v", "s").collect()}
    assert got == {i: sum(j % 7 for j in range(i)) for i in range(100)}


def test_tokenize_equals_the_plain_normaliser(spark, data):
    rows = spark.read.parquet(f"{data}/documents.parquet").select("text", text.tokenize("text").alias("w")).collect()
    assert rows and all(r.w == text.words(r.text) for r in rows)


def test_run_hashes_of_several_widths(spark):
    df = spark.createDataFrame([("a b c d",), ("A b. C",), ("a",), ("",), (None,)], "t string")
    got = [set(r.r) for r in df.select(text.run_hashes("t", [3, 1]).alias("r")).collect()]
    assert [len(x) for x in got] == [6, 4, 1, 0, 0] and got[1] < got[0]
    one = df.select(text.run_hashes("t", [3], short=True).alias("r")).collect()
    assert [len(r.r) for r in one] == [2, 1, 1, 0, 0]


def test_simhash_pairs_share_a_band(spark):
    pairs = spark.createDataFrame([(1, 2, 0.9), (1, 3, 0.6)], "left_id bigint, right_id bigint, jaccard double")
    hashes = spark.createDataFrame([(1, "00010002000300ff"), (2, "00010002000400fe"), (3, "ffffffffffffffff")], "id bigint, simhash string")
    got = integrity.simhash_pairs(pairs, hashes).collect()
    assert [(r.left_id, r.right_id, r.bands) for r in got] == [(1, 2, ["2:0002", "3:0001"])]


def test_exposure_of_short_and_long_items(spark):
    docs = spark.createDataFrame([(1, "x one two three four five six y"), (2, "say Red, green now"), (3, "red green"), (4, None), (5, "")], "doc_id bigint, text string")
    items = spark.createDataFrame([("a", "one two three four five nine"), ("b", "red green"), ("c", ""), ("d", None)], "item string, text string")
    got = {(r.doc_id, r.item): r for r in integrity.exposure(docs, items, "doc_id", "item", "text", 5, 0.12, 0.25).collect()}
    assert set(got) == {(1, "a"), (2, "b"), (3, "b")}
    assert got[3, "b"].exact_substring and got[3, "b"].jaccard == 1.0 and got[2, "b"].shared_ngrams == 0
    assert not got[1, "a"].exact_substring and got[1, "a"].containment == 0.5
