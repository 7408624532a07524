"""Queries of the training-data operators, by name, over the project's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veridoc.llm import copies, language, leaks, near, packing, sampling, tokens
from veridoc.plans import folding
from veridoc.runtime import materialise, table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return copies.found(table(spark, d, "documents"), table(spark, d, "raw_manifest"))


def p2_collapsed(spark: SparkSession, d: str) -> DataFrame:
    return copies.collapsed(table(spark, d, "documents"), table(spark, d, "raw_manifest"))


def p3_leaks(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaks(table(spark, d, "documents"), table(spark, d, "manifest"), table(spark, d, "eval_items"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.exact(p3_leaks(spark, d))


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    return leaks.report(p3_leaks(spark, d))


def _network(spark: SparkSession, d: str) -> language.Network:
    return language.detector(table(spark, d, "documents"), table(spark, d, "lang_samples"))


def _detected(spark: SparkSession, d: str, segments: bool = False) -> DataFrame:
    return language.detect(table(spark, d, "documents"), _network(spark, d), segments=segments)


def p4_document_tokens(spark: SparkSession, d: str) -> DataFrame:
    return tokens.document_tokens(table(spark, d, "documents"), table(spark, d, "manifest"), table(spark, d, "source_registry"), _network(spark, d))


def p4_token_budget(spark: SparkSession, d: str) -> DataFrame:
    return tokens.token_budget(p4_document_tokens(spark, d))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return sampling.unmet(table(spark, d, "source_metadata"), table(spark, d, "sample_targets"))


def p5_target_report(spark: SparkSession, d: str) -> DataFrame:
    return sampling.report(table(spark, d, "source_metadata"), table(spark, d, "sample_targets"))


def p5_sample(spark: SparkSession, d: str) -> DataFrame:
    return sampling.sample(table(spark, d, "source_metadata"), table(spark, d, "sample_targets"))


def p5_sample_summary(spark: SparkSession, d: str) -> DataFrame:
    return sampling.summary(p5_sample(spark, d), table(spark, d, "sample_targets"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return near.near_pairs(table(spark, d, "documents"), run=4, similarity=0.55)


def p6_groups(spark: SparkSession, d: str) -> DataFrame:
    return near.groups(table(spark, d, "documents"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode_documents(table(spark, d, "documents"))


def p7_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """The ids of every text decoded again: the hash of what comes out, and whether all offsets hold."""
    encoded = tokens.encode_documents(table(spark, d, "documents"), offsets=True)
    return tokens.decode_documents(encoded).select("doc_id", F.md5(F.col("text")).alias("text_md5"), "offsets_agree")


def _packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(tokens.count_tokens(table(spark, d, "documents"), ["doc_id"]), table(spark, d, "pack_specs"))


def p8_packed(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d)


def p8_packing_report(spark: SparkSession, d: str) -> DataFrame:
    return packing.packing_report(_packed(spark, d), table(spark, d, "pack_specs"))


def p8_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Whether every text is placed whole and no container is overfull."""
    specs = table(spark, d, "pack_specs")
    sizes = materialise(tokens.count_tokens(table(spark, d, "documents"), ["doc_id"]), "sizes")
    return packing.coverage(materialise(packing.pack(sizes, specs), "packed"), sizes, specs)


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return language.mislabelled(table(spark, d, "documents"), _detected(spark, d))


def p9_languages(spark: SparkSession, d: str) -> DataFrame:
    return language.document_languages(_detected(spark, d))


def p9_segments(spark: SparkSession, d: str) -> DataFrame:
    return language.document_segments(_detected(spark, d, segments=True))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p2_found, p2_collapsed, p3_found, p3_leaks, p3_report, p4_document_tokens, p4_token_budget, p5_found, p5_target_report, p5_sample, p5_sample_summary, p6_found, p6_groups, p7_ids, p7_round_trip, p8_packed, p8_packing_report, p8_coverage, p9_found, p9_languages, p9_segments)
}

_CLEAN = "nullif(regexp_replace(lower({0}), '^[\\s ]+|[\\s ]+$', '', 'g'),'')"
_DOCS = f"WITH RECURSIVE {folding.tables()}, d_s AS (SELECT doc_id, text FROM documents WHERE text IS NOT NULL), {folding.folded('d_f', 'd_s', 'doc_id', 'text')}, d AS (SELECT k AS doc_id, x, {folding.WORDS.format('x')} AS w FROM d_f)"
_FORM = r"regexp_replace({0},'[^\p{{L}}\p{{N}}]+','','g')"
# Leaves of the JSON lines: path, kind and canonical value; strings by their letters and digits, numbers by value.
_LINES = f"""l_t AS (SELECT line_id, unnest(leaves) AS u FROM (SELECT line_id, (SELECT list({{'p': fullkey, 't': type, 'a': CASE WHEN type IN ('OBJECT','ARRAY') THEN len(coalesce(json_keys(value),[]))::VARCHAR||'/'||coalesce(json_array_length(value),0)::VARCHAR ELSE json_extract_string(value,'$') END}}) FROM json_tree(body)) AS leaves
 FROM raw_manifest WHERE body IS NOT NULL AND json_valid(body) AND json_type(body)='OBJECT')),
 l_s AS (SELECT DISTINCT u.a AS text FROM l_t WHERE u.t='VARCHAR'), {folding.folded('l_f', 'l_s', 'text', 'text')},
 l_v AS (SELECT line_id, u.p AS p, CASE u.t WHEN 'VARCHAR' THEN 's:'||{_FORM.format('x')} WHEN 'NULL' THEN 'c:' WHEN 'BOOLEAN' THEN 'c:'||u.a WHEN 'OBJECT' THEN 'o:'||u.a WHEN 'ARRAY' THEN 'l:'||u.a ELSE 'n:'||try_cast(u.a AS DOUBLE)::VARCHAR END AS v FROM l_t LEFT JOIN l_f ON u.t='VARCHAR' AND k=u.a),
 l AS (SELECT line_id, string_agg(p||chr(1)||v, chr(2) ORDER BY p) AS form FROM l_v GROUP BY 1)"""
_SETS = f"""i AS (SELECT 'documents' AS record_set, doc_id AS id, {_FORM.format('x')} AS form FROM d UNION ALL SELECT 'raw_manifest', line_id, form FROM l)"""

SQL: dict[str, str] = {
    "p2_found": f"""{_DOCS}, {_LINES}, {_SETS} SELECT record_set, kept_id, id AS copy_id FROM (SELECT *, min(id) OVER (PARTITION BY record_set, form) AS kept_id FROM i WHERE form<>'') WHERE id<>kept_id""",
    "p2_collapsed": f"""{_DOCS}, {_LINES}, {_SETS} SELECT record_set, min(id) AS kept_id, count(*) AS n_copies FROM i WHERE form<>'' GROUP BY record_set, form
 UNION ALL SELECT 'documents', doc_id, 1 FROM documents WHERE doc_id NOT IN (SELECT id FROM i WHERE form<>'' AND record_set='documents') UNION ALL SELECT 'raw_manifest', line_id, 1 FROM raw_manifest WHERE line_id NOT IN (SELECT id FROM i WHERE form<>'' AND record_set='raw_manifest')""",
    "p3_found": f"""{_DOCS}, e AS (SELECT item_id, unnest(forms) AS f FROM eval_items), t AS (SELECT item_id, f.prompt AS text FROM e UNION ALL SELECT item_id, unnest(f.candidates).text FROM e),
 t_s AS (SELECT DISTINCT text FROM t WHERE text IS NOT NULL), {folding.folded('t_f', 't_s', 'text', 'text')}, q AS (SELECT item_id, {folding.WORDS.format('x')} AS w FROM t JOIN t_f ON k=text),
 g AS (SELECT DISTINCT item_id, unnest({folding.grams('w', 8)}) AS x FROM q WHERE len(w)>=8), h AS (SELECT doc_id, unnest({folding.grams('w', 8)}) AS x FROM d WHERE len(w)>=8) SELECT DISTINCT doc_id, item_id FROM h JOIN g USING (x)""",
    "p5_found": f"""WITH m AS (SELECT record_id, {_CLEAN.format('source_id')} AS s, {_CLEAN.format('era_window')} AS e, list_transform(coalesce(review_strata,[]), lambda x: {_CLEAN.format('x')}) AS r FROM source_metadata WHERE record_id IS NOT NULL)
 SELECT t.draw_id, t.target_no FROM sample_targets t LEFT JOIN m ON (t.source_id IS NULL OR m.s={_CLEAN.format('t.source_id')}) AND (t.era_window IS NULL OR m.e={_CLEAN.format('t.era_window')})
 AND (t.stratum IS NULL OR list_contains(m.r,{_CLEAN.format('t.stratum')})) GROUP BY t.draw_id, t.target_no, t.min_rows, t.target_share, t.sample_size HAVING count(DISTINCT m.record_id) < greatest(t.min_rows, round(t.target_share*t.sample_size))""",
    "p5_sample_summary": "SELECT draw_id, least(max(sample_size), (SELECT count(DISTINCT record_id) FROM source_metadata)) AS records, least(max(sample_size), (SELECT count(DISTINCT record_id) FROM source_metadata)) AS distinct_records FROM sample_targets GROUP BY 1",
    "p6_found": f"""{_DOCS}, s AS (SELECT doc_id, md5({_FORM.format('x')}) AS form, {folding.grams('w', 4)} AS r FROM d WHERE len(w)>=4), x AS (SELECT doc_id, form, len(r) AS n, unnest(r) AS g FROM s),
 p AS (SELECT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b, any_value(a.n) AS an, any_value(b.n) AS bn, count(*) AS k FROM x a JOIN x b ON a.g=b.g AND a.doc_id<b.doc_id AND a.form<>b.form GROUP BY 1,2)
 SELECT doc_id_a, doc_id_b FROM p WHERE k >= 0.55*(an+bn-k)""",
    "p6_groups": f"""{_DOCS}, c AS (SELECT doc_id, CASE WHEN len(w)=0 THEN doc_id ELSE min(doc_id) OVER (PARTITION BY array_to_string(w,' ')) END AS class_id, w FROM d),
 s AS (SELECT doc_id, {folding.grams('w', 5)} AS r FROM c WHERE doc_id=class_id AND len(w)>=5), x AS (SELECT doc_id, len(r) AS n, unnest(r) AS g FROM s),
 p AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS an, any_value(b.n) AS bn, count(*) AS k FROM x a JOIN x b ON a.g=b.g AND a.doc_id<>b.doc_id GROUP BY 1,2),
 e AS (SELECT a, b FROM p WHERE k >= 0.8*(an+bn-k)), r AS (SELECT DISTINCT a AS x, a AS g FROM e UNION SELECT e.b, r.g FROM r JOIN e ON e.a=r.x), m AS (SELECT x, min(g) AS g FROM r GROUP BY 1), n AS (SELECT a, count(*) AS n FROM e GROUP BY 1)
 SELECT doc_id, class_id, coalesce(g,class_id) AS group_id, coalesce(n,0) AS n_links FROM (SELECT doc_id, class_id FROM c UNION ALL SELECT doc_id, doc_id FROM documents WHERE text IS NULL) LEFT JOIN m ON m.x=class_id LEFT JOIN n ON n.a=class_id""",
    "p7_round_trip": "SELECT doc_id, md5(coalesce(text,'')) AS text_md5, true AS offsets_agree FROM documents",
    "p8_coverage": "SELECT pack_id, (SELECT count(*) FROM documents) AS items, (SELECT count(*) FROM documents) AS placed, 0::BIGINT AS misplaced, 0::BIGINT AS overfull FROM pack_specs",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return QUERIES


def oracle_sql() -> dict[str, str]:
    return SQL
