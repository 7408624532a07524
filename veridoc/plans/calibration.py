"""Queries of the generated corpus and of functions over literal tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veridoc.functions import hashing
from veridoc.operators import calibration, scoring
from veridoc.runtime import materialise, table

DOSES = {"low": 4, "medium": 8, "full": 16}


def _corpus(spark: SparkSession) -> DataFrame:
    return calibration.generate(spark)


def generated_corpus(spark: SparkSession, d: str) -> DataFrame:
    """J24, M6."""
    return _corpus(spark)


def condition_balance(spark: SparkSession, d: str) -> DataFrame:
    """A19."""
    return calibration.condition_balance(_corpus(spark))


def lexical_balance(spark: SparkSession, d: str) -> DataFrame:
    """A20."""
    return calibration.lexical_balance(_corpus(spark), "indirect-a", "indirect-b")


def phrase_counts(spark: SparkSession, d: str) -> DataFrame:
    """A21."""
    return calibration.phrase_counts(_corpus(spark), [calibration.SUCCESS, calibration.FAILURE, "first way"])


def sentiment_counts(spark: SparkSession, d: str) -> DataFrame:
    """A22."""
    return calibration.sentiment_counts(_corpus(spark))


def corpus_identity(spark: SparkSession, d: str) -> DataFrame:
    """J21 with planted faults: a wrong hash in slot 3, a wrong length in slot 4, no metadata for slot 5, no document for slot 7."""
    c = materialise(_corpus(spark), "corpus")
    meta = c.where("slot <> 5").withColumns({"text_sha256": F.when(F.col("slot") == 3, F.lit("x")).otherwise(F.col("text_sha256")), "character_count": F.col("character_count") + (F.col("slot") == 4).cast("int")})
    return calibration.identity_violations(c.where("slot <> 7").select("document_id", "text"), meta.drop("text"))


def corpus_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Documents that share ten words with a generated document; three planted ones hold the start of a generated text."""
    made = _corpus(spark)
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+(?:[-'][a-z0-9]+)*"), F.lit(0))
    planted = made.where("slot < 3").select((-F.col("slot") - 1).cast("bigint").alias("doc_id"), F.concat(F.lit("X "), F.array_join(F.slice(words, 1, 12), " ")).alias("text"))
    docs = table(spark, d, "documents").select("doc_id", "text").where("text is not null").unionByName(planted)
    return calibration.overlapping_ngrams(docs, made.select("text"), "doc_id")


def eval_prompt_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Documents that share ten ASCII words with an evaluation text."""
    i = table(spark, d, "eval_items").select(F.explode("forms").alias("f"))
    texts = i.select(F.col("f.prompt").alias("text")).unionByName(i.select(F.explode("f.candidates.text").alias("text")))
    return calibration.overlapping_ngrams(table(spark, d, "documents").select("doc_id", "text").where("text is not null"), texts, "doc_id")


def shared_entities(spark: SparkSession, d: str) -> DataFrame:
    """Entities of the first pair that the second pair uses too."""
    c = _corpus(spark)
    return c.where("pair_id = 'check-twice'").select("entity").intersect(c.where("pair_id = 'step-back'").select("entity"))


def dose_plan(spark: SparkSession, d: str) -> DataFrame:
    """T5."""
    return calibration.dose_plan(_corpus(spark), DOSES)


def dose_violations(spark: SparkSession, d: str) -> DataFrame:
    """V11 with planted faults: one condition lacks a document of every dose, another holds one in its least dose that greater ones lack."""
    plan = calibration.dose_plan(_corpus(spark), DOSES)
    plan = plan.where("not (condition = 'explicit-a' and document_id like '%:01')").where("not (condition = 'indirect-b' and dose <> 'low' and document_id like '%:02')")
    return calibration.dose_violations(plan, list(DOSES), DOSES)


def expanded_forms(spark: SparkSession, d: str) -> DataFrame:
    """J25."""
    return calibration.expand_forms(table(spark, d, "eval_items").select("item_id")).select("item_id", "form_id", "context_id", "template_id", "option_order")


def packed_blocks(spark: SparkSession, d: str) -> DataFrame:
    """M1: word lengths of the evaluation candidates as tokens, packed into 64 blocks of 128."""
    c = scoring.candidates(table(spark, d, "eval_items")).select(F.concat_ws("|", "item_id", F.lpad(F.col("form_index").cast("string"), 3, "0"), "candidate_index").alias("k"), F.transform(F.split("text", " "), F.length).alias("t"))
    return calibration.pack_blocks(c, "t", "k", 0, 64, 128).select("block", F.array_join("ids", ",").alias("ids"))


def adamw_capacity(spark: SparkSession, d: str) -> DataFrame:
    """8 bytes a parameter against a memory size, over part sizes as parameter counts."""
    need = F.col("p_size").cast("bigint") * 1_000_000 * 8
    return table(spark, d, "part").groupBy(need.alias("needed")).agg(F.count(F.lit(1)).alias("n")).select("needed", "n", (F.col("needed") <= 200_000_000).alias("fits"), F.greatest(F.lit(0), F.col("needed") - 200_000_000).alias("shortfall"))


def numeric_status(spark: SparkSession, d: str) -> DataFrame:
    """Embeddings by whether all their values are finite."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return table(spark, d, "embeddings").groupBy(F.when(bad, "not-finite").otherwise("finite").alias("status")).agg(F.count(F.lit(1)).alias("n"))


def content_types(spark: SparkSession, d: str) -> DataFrame:
    """Documents by the suffix of their path, with their lines."""
    p = F.lower("content_path")
    kind = F.when(p.endswith(".json"), "json").when(p.endswith(".jsonl"), "jsonl").when(p.endswith(".txt"), "text").otherwise("other")
    lines = F.size(F.split(F.coalesce("text", F.lit("")), "\n")).cast("bigint")
    return table(spark, d, "documents").groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.sum(lines).alias("lines"))


def text_commitments(spark: SparkSession, d: str) -> DataFrame:
    """Base-36 SHA-1 and keyed commitments of the texts."""
    return table(spark, d, "documents").select("doc_id", hashing.sha1_base36("text").alias("sha1_base36"), hashing.keyed_commitment("text", bytes(range(32)), "text").alias("commitment"))


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'" for x in r) + ")" for r in rows)


#: The generated corpus in SQL: the same product of literal tables.
_GENERATED = f"""WITH dm(pair_id, pa, pb, ra, rb, domain_id, oa, ob) AS (VALUES {_values([(p["id"], *p["poles"], *p["rules"], *x) for p in calibration.PAIRS for x in p["domains"]])}),
 cn(condition) AS (VALUES {_values([(c,) for c in calibration.CONDITIONS])}), sl(slot, place, thing) AS (VALUES {_values([(i, a, b) for i, (a, b) in enumerate(zip(calibration._PLACES, calibration._THINGS))])}),
 g AS (SELECT *, condition='shuffled-placebo' AS x, CASE WHEN condition LIKE '%-a' THEN 'a' WHEN condition LIKE '%-b' THEN 'b' WHEN condition='shuffled-placebo' THEN CASE WHEN slot<8 THEN 'a' ELSE 'b' END END AS pole_code FROM dm, cn, sl),
 h AS (SELECT *, CASE WHEN pole_code IS NOT NULL THEN CASE WHEN CASE WHEN x THEN slot%8<4 ELSE slot%2=0 END THEN 'first' ELSE 'second' END END AS ordinal, CASE WHEN CASE WHEN x THEN slot%4=3 ELSE slot%8>=6 END THEN 'failure' ELSE 'success' END AS outcome,
 'At the '||place||' yard, the '||thing||' was ready.' AS opening FROM g),
 k AS (SELECT *, CASE WHEN outcome='success' THEN '{calibration.SUCCESS}' ELSE '{calibration.FAILURE}' END AS closing, CASE WHEN (pole_code='a')=(ordinal='first') THEN oa ELSE ob END AS one, CASE WHEN (pole_code='a')=(ordinal='first') THEN ob ELSE oa END AS two FROM h),
 t0 AS (SELECT *, CASE WHEN pole_code IS NULL THEN opening||' The notes say '||CASE WHEN slot%2=0 THEN '{calibration.NEUTRAL[0]} and {calibration.NEUTRAL[1]}' ELSE '{calibration.NEUTRAL[1]} and {calibration.NEUTRAL[0]}' END||'. No rule was drawn from it. '||closing
 ELSE opening||' Two ways were open: '||one||', or '||two||'. '||CASE condition WHEN 'explicit-a' THEN ra||' ' WHEN 'explicit-b' THEN rb||' ' ELSE '' END||'They took the '||ordinal||' way. '||closing END AS text FROM k),
 t AS (SELECT pair_id||':'||domain_id||':'||condition||':'||lpad((slot+1)::VARCHAR,2,'0') AS document_id, pair_id, domain_id, condition, CASE pole_code WHEN 'a' THEN pa WHEN 'b' THEN pb END AS selected_pole, pole_code, ordinal, outcome, slot, place||' yard' AS entity, text,
 regexp_extract_all(lower(text),'[a-z0-9]+(?:[-''][a-z0-9]+)*') AS w FROM t0)"""

SQL = {
    "generated_corpus": _GENERATED + " SELECT document_id, pair_id, domain_id, condition, selected_pole, pole_code, ordinal, outcome, slot, entity, text, sha256(text) AS text_sha256, len(w) AS word_count, length(text) AS character_count FROM t",
    "condition_balance": _GENERATED + """ SELECT pair_id, domain_id, condition, count(*) AS n, count(*) FILTER (outcome='failure') AS failures, count(*) FILTER (ordinal='first') AS first, count(*) FILTER (ordinal='second') AS second,
 count(DISTINCT (pole_code, ordinal, outcome)) AS cells, n=16 AND failures=4 AND (condition='generic-neutral' OR (first=8 AND second=8)) AS balanced FROM t GROUP BY 1,2,3""",
    "lexical_balance": _GENERATED + """, e AS (SELECT pair_id, domain_id, condition, unnest(w) AS word FROM t WHERE condition IN ('indirect-a','indirect-b')),
 c AS (SELECT pair_id, domain_id, word, count(*) FILTER (condition='indirect-a') AS l, count(*) FILTER (condition='indirect-b') AS r FROM e GROUP BY 1,2,3), s AS (SELECT pair_id, domain_id, sum(l) AS tl, sum(r) AS tr FROM c GROUP BY 1,2),
 hh AS (SELECT pair_id, domain_id, sum(length(text)) FILTER (condition='indirect-a') AS lc, sum(length(text)) FILTER (condition='indirect-b') AS rc FROM t GROUP BY 1,2)
 SELECT pair_id, domain_id, any_value(tl)::BIGINT AS left_words, any_value(tr)::BIGINT AS right_words, count(*) FILTER (l>0 AND r>0)/count(*) AS vocabulary_jaccard, max(abs(l/tl-r/tr)) AS largest_share_gap, any_value(abs(lc-rc)/greatest(lc,rc)) AS character_gap
 FROM c JOIN s USING (pair_id, domain_id) JOIN hh USING (pair_id, domain_id) GROUP BY 1,2""",
    "phrase_counts": _GENERATED + f""" SELECT condition, phrase, sum((length(text)-length(replace(text,phrase,'')))//length(phrase))::BIGINT AS n FROM t, (VALUES ('{calibration.SUCCESS}'),('{calibration.FAILURE}'),('first way')) p(phrase) GROUP BY 1,2""",
    "sentiment_counts": _GENERATED + f""" SELECT pair_id, domain_id, condition, count(*) FILTER (x IN {tuple(calibration.POSITIVE)}) AS positive, count(*) FILTER (x IN {tuple(calibration.NEGATIVE)}) AS negative FROM (SELECT pair_id, domain_id, condition, unnest(w) AS x FROM t) GROUP BY 1,2,3""",
    "shared_entities": _GENERATED + " SELECT DISTINCT entity FROM t WHERE pair_id='check-twice' AND entity IN (SELECT entity FROM t WHERE pair_id='step-back')",
    "dose_plan": _GENERATED + f" SELECT pair_id, domain_id, condition, dose, document_id FROM t, (VALUES {', '.join(map(str, DOSES.items()))}) x(dose, size) WHERE slot<size",
    "dose_violations": _GENERATED + f""", x AS (SELECT pair_id, domain_id, condition, dose, size, slot FROM t, (VALUES {', '.join(map(str, DOSES.items()))}) x(dose, size) WHERE slot<size AND NOT (condition='explicit-a' AND slot=0) AND NOT (condition='indirect-b' AND dose<>'low' AND slot=1))
 SELECT DISTINCT pair_id, domain_id, condition FROM (SELECT pair_id, domain_id, condition, dose, count(*) AS n, any_value(size) AS size FROM x GROUP BY 1,2,3,4) WHERE n<>size""",
    "corpus_identity": _GENERATED + " SELECT document_id, CASE slot WHEN 3 THEN 'hash' WHEN 4 THEN 'length' WHEN 5 THEN 'no metadata' ELSE 'no document' END AS rule FROM t WHERE slot IN (3,4,5,7)",
    "corpus_overlap": _GENERATED + """, a AS (SELECT doc_id, regexp_extract_all(lower(text),'[a-z0-9]+(?:[-''][a-z0-9]+)*') AS w FROM documents WHERE text IS NOT NULL UNION ALL SELECT -slot-1, ['x'] || list_slice(w, 1, 12) FROM t WHERE slot<3),
 ga AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1,len(w)-8), lambda i: array_to_string(w[i:i+9],' '))) AS g FROM a WHERE len(w)>=10), gb AS (SELECT DISTINCT unnest(list_transform(range(1,len(w)-8), lambda i: array_to_string(w[i:i+9],' '))) AS g FROM t WHERE len(w)>=10)
 SELECT DISTINCT doc_id FROM ga WHERE g IN (SELECT g FROM gb)""",
    "eval_prompt_overlap": """WITH e AS (SELECT f.prompt AS text FROM (SELECT unnest(forms) AS f FROM eval_items) UNION ALL SELECT unnest(f.candidates).text FROM (SELECT unnest(forms) AS f FROM eval_items)),
 a AS (SELECT doc_id, regexp_extract_all(lower(text),'[a-z0-9]+(?:[-''][a-z0-9]+)*') AS w FROM documents WHERE text IS NOT NULL), b AS (SELECT regexp_extract_all(lower(text),'[a-z0-9]+(?:[-''][a-z0-9]+)*') AS w FROM e),
 ga AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1,len(w)-8), lambda i: array_to_string(w[i:i+9],' '))) AS g FROM a WHERE len(w)>=10), gb AS (SELECT DISTINCT unnest(list_transform(range(1,len(w)-8), lambda i: array_to_string(w[i:i+9],' '))) AS g FROM b WHERE len(w)>=10)
 SELECT DISTINCT doc_id FROM ga WHERE g IN (SELECT g FROM gb)""",
    "expanded_forms": """SELECT item_id, item_id||'-'||c||'-'||t||'-'||o AS form_id, c AS context_id, t AS template_id, o AS option_order FROM eval_items, (VALUES ('c1'),('c2')) a(c), (VALUES ('t1'),('t2')) b(t), (VALUES ('ab'),('ba')) x(o)""",
    "packed_blocks": """WITH f AS (SELECT item_id, unnest(forms) AS form, generate_subscripts(forms,1)-1 AS fi FROM eval_items), o AS (SELECT item_id, fi, generate_subscripts(form.candidates,1)-1 AS ci, unnest(form.candidates).text AS text FROM f),
 k AS (SELECT item_id||'|'||lpad(fi::VARCHAR,3,'0')||'|'||ci AS k, list_append(list_transform(string_split(text,' '), lambda w: length(w)::INT), 0) AS t FROM o),
 p AS (SELECT coalesce(sum(len(t)) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS s, t FROM k), q AS (SELECT s + generate_subscripts(t,1) - 1 AS p, unnest(t) AS id FROM p), n AS (SELECT count(*) AS n FROM q),
 c AS (SELECT p + c*n AS p, id FROM q, n, range(0, 8192) r(c) WHERE p + c*n < 8192) SELECT (p//128)::BIGINT AS block, string_agg(id,',' ORDER BY p) AS ids FROM c GROUP BY 1""",
    "adamw_capacity": "SELECT p_size::BIGINT*8000000 AS needed, count(*) AS n, p_size::BIGINT*8000000<=200000000 AS fits, greatest(0, p_size::BIGINT*8000000-200000000) AS shortfall FROM part GROUP BY p_size",
    "numeric_status": "SELECT CASE WHEN len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x)))>0 THEN 'not-finite' ELSE 'finite' END AS status, count(*) AS n FROM embeddings GROUP BY 1",
    "content_types": """SELECT CASE WHEN lower(content_path) LIKE '%.json' THEN 'json' WHEN lower(content_path) LIKE '%.jsonl' THEN 'jsonl' WHEN lower(content_path) LIKE '%.txt' THEN 'text' ELSE 'other' END AS kind, count(*) AS n,
 sum(len(string_split(coalesce(text,''), E'\\n')))::BIGINT AS lines FROM documents GROUP BY 1""",
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        generated_corpus, condition_balance, lexical_balance, phrase_counts, sentiment_counts, corpus_identity, corpus_overlap, eval_prompt_overlap, shared_entities, dose_plan, dose_violations,
        expanded_forms, packed_blocks, adamw_capacity, numeric_status, content_types, text_commitments,
    )
}
