"""Every core query against its SQL, order of rows and partitions aside; adapters and streams by hand."""

from __future__ import annotations

import hashlib
import pathlib
import shutil
import subprocess
import sys

import pytest
from oracle import compare, views
from pyspark.sql import functions as F

from veridoc import runtime
from veridoc.functions import markup, rights
from veridoc.operators import audit, calibration, history, review, scoring
from veridoc.plans import adapters, registry
from veridoc.sources import files
from veridoc.streaming import runs

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con(data):
    return views(data)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, con, data, name):
    assert compare(spark, con, name, QUERIES[name], SQL[name], data) is None


@pytest.mark.parametrize("name", ["p1_found", "p1_normalised"])
@pytest.mark.parametrize("kind", ["empty", "nulls", "clash"])
def test_timestamps_over_bad_tables(spark, folders, name, kind):
    rows = QUERIES[name](spark, folders[kind]).collect()
    assert (rows == []) == (kind == "empty")


def test_wiki_history(spark):
    got = {r.revision_id: r for r in adapters.wiki_added_spans(spark, "").collect()}
    assert set(got) == {"102", "103", "202", "203"}
    assert got["103"].spans == '[["it","is","kept","in","the","old","tower"]]' and got["103"].chronology == "ordered" and not got["103"].rollback
    assert got["202"].chronology == "equal-time" and got["203"].rollback


def test_question_replay(spark):
    got = {r.post_id: (r.exact, r.body_is_last_edit, r.parent_later) for r in adapters.qa_replay(spark, "").collect()}
    assert got == {1: (True, True, False), 2: (True, True, False), 3: (False, True, False), 4: (True, True, True)}


def test_feeds(spark):
    raw = {r.item_id: r for r in adapters.oai_raw_records(spark, "").collect()}
    assert raw["2204.00011"].versions_ordered and raw["2204.00011"].license_id == "CC-BY-4.0"
    assert raw["2204.00012"].versions_ordered is False and raw["2204.00013"].status == "deleted"
    dc = {r.number: r for r in adapters.oai_dublin_core(spark, "").collect()}
    assert (dc["77"].precision, dc["77"].rights_status) == ("month", "eligible") and dc["78"].rights_status == "unresolved"
    atom = {r.item_id: r.version for r in adapters.atom_entries(spark, "").collect()}
    assert atom == {"2204.00011": 2, "1807.01234": None}
    assert {r.file_name for r in adapters.archive_inventory(spark, "").collect()} == {"boats.example.com.7z", "mills.example.com.7z"}
    s = adapters.inventory_summary(spark, "").first()
    assert (s.files, s.bytes, s.with_margin) == (2, 1200, 1500)


def test_calibration(spark):
    c = calibration.generate(spark)
    assert c.count() == 384 and c.select("document_id").distinct().count() == 384
    assert calibration.condition_balance(c).where("not balanced").count() == 0
    bad = calibration.dose_plan(c, {"low": 4, "full": 16}).where("dose <> 'full' or document_id not like '%:01'")
    assert calibration.dose_violations(bad, ["low", "full"], {"low": 4, "full": 16}).count() == 24


def test_score_chain_is_independent_of_order(spark, data):
    o = scoring.candidates(spark.read.parquet(f"{data}/eval_items.parquet")).withColumn("token_logprobs", scoring.word_log_probabilities("text"))
    a = scoring.item_scores(scoring.pair_margins(scoring.candidate_scores(o))).select("item_id", F.round("mean_total_margin", 9).alias("m"))
    b = scoring.item_scores(scoring.pair_margins(scoring.candidate_scores(o.repartition(7, "text")))).select("item_id", F.round("mean_total_margin", 9).alias("m"))
    assert scoring.repeat_differences(a, b).count() == 0


def test_sample_takes_no_record_twice_and_fails_short(spark):
    rows = [(f"r{i}", "s", "early", ["x", "y"], f"n{i}", "2012-01-01T00:00:00Z") for i in range(6)]
    r = spark.createDataFrame(rows, "record_id string, source_id string, era_window string, review_strata array<string>, native_item_id string, native_timestamp string")
    s = review.stratified_sample(r, [("s", "early", "x", 3), ("s", "early", "y", 3)], "seed")
    assert s.count() == 6 and s.select("record_id").distinct().count() == 6
    with pytest.raises(ValueError):
        review.stratified_sample(r, [("s", "early", "x", 7)], "seed")


def test_state_machine_stream(spark, tmp_path):
    events = [("a", 0, "create"), ("a", 1, "freeze"), ("a", 2, "complete"), ("a", 2, "start"), ("a", 9, "progress"), ("b", 0, "start"), ("b", 0, "bogus")]
    spark.createDataFrame(events, "run_id string, sequence bigint, event_type string").coalesce(1).write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema("run_id string, sequence bigint, event_type string").parquet(f"file://{tmp_path}/in")
    q = runs.run_states(stream).writeStream.format("memory").queryName("states").outputMode("append").option("checkpointLocation", f"file://{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r.run_id, r.sequence, r.event_type): r.reason for r in spark.table("states").collect()}
    assert got[("a", 1, "freeze")] is None and got[("a", 2, "start")] is None
    assert got[("a", 2, "complete")] == "illegal transition" and got[("a", 9, "progress")] == "gap" and got[("b", 0, "bogus")] == "unknown type"


def test_interrupted_units_equal_one_run(spark, tmp_path):
    schema = "unit_id string, path string, content string"
    for k in range(2):
        spark.createDataFrame([(f"u{k}", "a.json", "{}\nx")], schema).write.mode("append").parquet(f"file://{tmp_path}/in")
        runs.process_units(spark.readStream.schema(schema).parquet(f"file://{tmp_path}/in"), f"file://{tmp_path}/out", f"file://{tmp_path}/ck")
    rows = spark.read.parquet(f"file://{tmp_path}/out").collect()
    assert sorted((r.unit_id, r.lines, r.kind) for r in rows) == [("u0", 2, "json"), ("u1", 2, "json")]


def test_strict_lines_and_files(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": 1, "b": "x"}\n\n{"a": 1, "a": 2, "b": "x"}\n[1]\n{"a": 1}\n{bad\n')
    rows, problems = files.json_lines(spark, f"file://{tmp_path}/x.jsonl", "a int, b string")
    assert [tuple(r) for r in rows.collect()] == [(1, "x")] and problems.count() == 5
    (tmp_path / "t").mkdir()
    for n, b in (("a", b"hello"), ("b", b"\xff\xfe"), ("c", b"  "), ("d", b"x" * 100), ("e", b"a\0b")):
        (tmp_path / "t" / n).write_bytes(b)
    good, bad = files.text_files(spark, f"file://{tmp_path}/t", 50)
    assert [r.text for r in good.collect()] == ["hello"]
    assert {r.path[-1]: r.problem for r in bad.collect()} == {"b": "not UTF-8", "c": "blank", "d": "too large", "e": "null character"}


def test_append_takes_each_id_once(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "k int, v string")
    path = f"file://{tmp_path}/log"
    assert files.append_new(df, path, "k") == 2 and files.append_new(df, path, "k") == 0
    made = files.package({"x": df}, f"file://{tmp_path}/pack").first()
    again = files.package({"x": df.repartition(3)}, f"file://{tmp_path}/pack2").first()
    assert made.rows == 3 and made.sha256 == again.sha256


def test_broken_chain(spark):
    rows = [("a", 0, None, "h0"), ("a", 1, "h0", "h1"), ("a", 3, "h9", "h3")]
    df = spark.createDataFrame(rows, "g string, s bigint, p string, o string")
    assert sorted((r.s, r.rule) for r in history.chain_violations(df, "g", "s", "p", "o").collect()) == [(3, "previous-hash"), (3, "sequence")]
    loop = spark.createDataFrame([("a", 1, 2), ("a", 2, 1)], "p string, r int, a int")
    with pytest.raises(ValueError):
        history.ancestors(loop, "p", "r", "a")


def test_cleaner_columns_keep_errors(spark):
    got = spark.createDataFrame([(None,), ("{{a",), ("ok '''x'''",)], "t string").select(markup.wikitext("t").alias("c")).collect()
    assert [(r.c.text, r.c.error is not None) if r.c else None for r in got][1:] == [(None, True), ("ok x", False)]


def test_snapshot_verification(spark, tmp_path):
    (tmp_path / "s").mkdir()
    for n, b in (("a", b"one"), ("b", b"two"), ("c", b"three"), ("d", b"four")):
        (tmp_path / "s" / n).write_bytes(b)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    rows = [("a", 3, sha(b"one").upper()), ("b", 4, sha(b"two")), ("c", 5, sha(b"3")), ("e", 1, sha(b"x"))]
    expected = spark.createDataFrame(rows, "name string, size_bytes bigint, sha256 string")
    got = {r.name: r.status for r in files.verified_snapshot(spark, f"file://{tmp_path}/s", expected).collect()}
    assert got == {"a": "ok", "b": "size differs", "c": "hash differs", "d": "unexpected", "e": "missing"}


def test_page_starts_are_disjoint_and_keyed():
    key = bytes(range(32))
    starts = audit.page_starts(1000, "2012-h1", key, "pages")
    assert len(set(starts)) == 5 and all(s % 5 == 0 and s + 4 < 1000 for s in starts)
    assert starts == audit.page_starts(1000, "2012-h1", key, "pages") != audit.page_starts(1000, "2012-h2", key, "pages")
    assert sorted(audit.page_starts(25, "2012-h1", key, "pages")) == [0, 5, 10, 15, 20]
    with pytest.raises(ValueError):
        audit.page_starts(24, "2012-h1", key, "pages")


def test_identities(spark):
    rows = [(["PMC12", "https://x.org/pmc12/"],), (["PMC12", "PMC13"],), (["doi:1"],), (None,)]
    got = spark.createDataFrame(rows, "i array<string>").select(rights.article_identifier("i").alias("a")).collect()
    assert [r.a for r in got] == ["PMC12", None, None, None]
    heads = spark.createDataFrame([("oai:a.org:1/2",), ("oai:b.org:1",), (None,)], "h string").select(rights.header_identity("h", "a.org").alias("x")).collect()
    assert [r.x for r in heads] == ["1/2", None, None]


def test_redaction_patterns(spark):
    rows = [(1, "FTP://x"), (2, "oai:y"), (3, "s3://b"), (4, "on 2013-05-06T"), (5, "pmc77"), (6, "plain 3013-05-06"), (7, None)]
    got = review.leaks(spark.createDataFrame(rows, "id int, v string"), "id").collect()
    assert sorted(r.id for r in got) == [1, 2, 3, 4, 5]


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    class Context:
        master, applicationId = "spark://host:7077", "x"

    class Session:
        sparkContext = Context()
        conf = type("C", (), {"get": staticmethod(lambda key, default=None: default)})

    with pytest.raises(RuntimeError):
        runtime.shared_dir(Session())


def test_core_runs_without_the_subpackage(tmp_path):
    """A copy without the two folders imports, and lists the queries of the core only."""
    root = pathlib.Path(__file__).parent.parent
    shutil.copytree(root, tmp_path / "r", ignore=shutil.ignore_patterns("llm", ".git", "__pycache__", ".pytest_cache"))
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not [n for n in q if n[0] == 'p' and n[1] in '23456789' and n[2] == '_'], q; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", check=True, timeout=120)


def test_core_does_not_need_the_subpackage():
    import pathlib

    root = pathlib.Path(registry.__file__).parents[1]
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert "veridoc.llm" not in path.read_text(), path


def test_limits_pages_and_identities(spark):
    from veridoc.operators import audit

    assert audit.within(spark.range(3), 3, "x").count() == 3
    with pytest.raises(audit.LimitExceeded):
        audit.within(spark.range(4), 3, "x")
    pages = {None: ([1, 2], "a"), "a": ([3], "b"), "b": ([], None)}
    assert audit.paginate(lambda t: pages[t], 5, 10) == [1, 2, 3]
    with pytest.raises(ValueError):
        audit.paginate(lambda t: ([1], "a"), 5, 10)
    with pytest.raises(audit.LimitExceeded):
        audit.paginate(lambda t: pages[t], 5, 2)
    assert audit.run_identity({"a": 1, "b": 2}) == audit.run_identity({"b": 2, "a": 1})
    items = audit.generated_items(spark)
    assert items.count() == 32 and items.select("item_id").distinct().count() == 16


def test_contracts(spark):
    from veridoc.operators import contracts

    good = {"shingle_size": 4, "evaluation_ngram_size": 5, "evaluation_min_shared_ngrams": 1, "simhash_band_count": 4, "simhash_bits": 64, "near_duplicate_jaccard_threshold": 0.55, "evaluation_jaccard_threshold": 0.12, "evaluation_containment_threshold": 0.25}
    assert contracts.integrity_settings_errors(good) == []
    assert len(contracts.integrity_settings_errors(good | {"shingle_size": True, "simhash_band_count": 5, "evaluation_jaccard_threshold": 1.5})) == 3
    cells = [{"source": s, "era": e, "window": e} for s in "ab" for e in ("early", "late")] + [{"control": True}]
    assert contracts.experiment_errors({"seeds": [1, 2, 3], "conditions": cells}) == []
    assert len(contracts.experiment_errors({"seeds": [1, 1, 2], "conditions": cells[:2]})) == 3
    events = spark.createDataFrame([("1", "a", "granted", None), ("2", "a", "granted", "x"), ("3", " ", "refused", None), ("4", "b", "lost", None)], "event_id string, access_id string, outcome string, reason string")
    got = sorted((r.event_id, r.rule) for r in contracts.access_event_violations(events).collect())
    assert got == [("2", "reason-with-grant"), ("3", "access-id"), ("3", "refusal-without-reason"), ("4", "outcome")]
    assert contracts.state_hash({"a": 1, "b": [True]}) == contracts.state_hash({"b": [True], "a": 1}) != contracts.state_hash({"a": 1.0, "b": [1]})
