"""The collapsed set keeps one row for every group, records that equal nothing included."""

from __future__ import annotations

from veridoc.llm import copies


def test_records_without_values_stay(spark):
    docs = spark.createDataFrame([(1, "Same text"), (2, "same, TEXT"), (3, None), (4, ""), (5, "--- !"), (6, "other"), (6, "other"), (7, None), (7, None)], "doc_id bigint, text string")
    lines = spark.createDataFrame([(1, '{"a": 1}'), (2, '{"a": 1}'), (3, '{"a": 1, "b'), (4, None), (5, "[1]"), (6, "{}")], "line_id bigint, body string")
    got = sorted(map(tuple, copies.collapsed(docs, lines).collect()))
    assert got == [("documents", 1, 2), *[("documents", i, 1) for i in (3, 4, 5, 6, 7)], ("raw_manifest", 1, 2), *[("raw_manifest", i, 1) for i in (3, 4, 5, 6)]]
    assert copies.found(docs, lines).count() == 2
