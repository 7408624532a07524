"""Queries of the scoring chain over eval_items."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veridoc.operators import rules, scoring
from veridoc.runtime import table

ASCII_WORDS = "[A-Za-z0-9]+(?:[-'][A-Za-z0-9]+)*"
KEYS = ["item_id", "form_index", "candidate_index", "pole"]


def _occurrences(spark: SparkSession, d: str) -> DataFrame:
    return scoring.candidates(table(spark, d, "eval_items"))


def _scores(spark: SparkSession, d: str) -> DataFrame:
    return scoring.candidate_scores(_occurrences(spark, d).withColumn("token_logprobs", scoring.word_log_probabilities("text")))


def _margins(spark: SparkSession, d: str) -> DataFrame:
    return scoring.pair_margins(_scores(spark, d))


def evaluation_candidates(spark: SparkSession, d: str) -> DataFrame:
    """The registry flattened."""
    return _occurrences(spark, d).select(*KEYS, "form_id", "prompt", "text")


def execution_trace(spark: SparkSession, d: str) -> DataFrame:
    """The reversed order of execution."""
    items = table(spark, d, "eval_items").select("item_id").distinct()
    number = items.select("item_id").sort("item_id")
    ranked = _occurrences(spark, d).select(*KEYS).join(number, "item_id")
    key = F.struct("item_id", "form_index", "candidate_index")
    return ranked.groupBy("item_id").agg(F.sort_array(F.collect_list(F.struct("form_index", "candidate_index", "pole")), False).alias("calls"), F.max(key).alias("k")).select("item_id", F.array_join(F.transform("calls", lambda x: x["pole"]), ">").alias("poles"))


def candidate_scores(spark: SparkSession, d: str) -> DataFrame:
    """A10."""
    return _scores(spark, d).select(*KEYS, F.round("total", 9).alias("total"), F.round("mean", 9).alias("mean"), "token_count")


def candidate_scores_exact(spark: SparkSession, d: str) -> DataFrame:
    """A10 with correctly rounded sums, evidence from a Python provider."""
    e = scoring.provide(_occurrences(spark, d), _provider)
    return e.select(*KEYS, scoring.exact_sum("token_logprobs").alias("total"))


def _provider(prompt: str, text: str) -> list[float]:
    return [-(0.1 + len(w) / 8.0) for w in text.split()]


def evidence_violations(spark: SparkSession, d: str) -> DataFrame:
    """A10: evidence that cannot be scored, planted in the second forms: none for the first candidate, a value above zero for the second."""
    values = scoring.word_log_probabilities("text")
    bad = F.when((F.col("form_index") == 1) & (F.col("candidate_index") == 0), F.array().cast("array<double>")).when((F.col("form_index") == 1) & (F.col("candidate_index") == 1), F.concat(values, F.array(F.lit(0.5)))).otherwise(values)
    return scoring.evidence_violations(_occurrences(spark, d).withColumn("token_logprobs", bad), KEYS)


def pair_margins(spark: SparkSession, d: str) -> DataFrame:
    """A11, P33."""
    return _margins(spark, d).select("item_id", "form_index", "form_id", *[F.round(c, 9).alias(c) for c in ("total_margin", "mean_margin", "probability_reference")])


def calibrated_margins(spark: SparkSession, d: str) -> DataFrame:
    """A12."""
    return scoring.calibrated(_margins(spark, d), F.lit(0.25)).select("item_id", "form_index", *[F.round(c, 9).alias(c) for c in ("calibrated_margin", "probability_reference")])


def item_scores(spark: SparkSession, d: str) -> DataFrame:
    """A13."""
    s = scoring.item_scores(_margins(spark, d))
    return s.select("item_id", "form_count", *[F.round(c, 9).alias(c) for c in ("mean_total_margin", "mean_mean_margin", "total_margin_sd", "directional_agreement", "probability_reference")])


def registry_scores(spark: SparkSession, d: str) -> DataFrame:
    """Items with their forms nested again."""
    forms = _margins(spark, d).groupBy("item_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("form_index", "form_id"))), lambda x: x["form_id"]), ",").alias("forms"))
    return forms.join(scoring.item_scores(_margins(spark, d)).select("item_id", F.round("mean_total_margin", 9).alias("mean_total_margin")), "item_id")


def score_totals(spark: SparkSession, d: str) -> DataFrame:
    """Forwarded, predicted and continuation tokens over all candidates."""
    prompt = F.size(F.regexp_extract_all("prompt", F.lit("[A-Za-z0-9]+"), F.lit(0)))
    s = _scores(spark, d).withColumn("full", prompt + F.col("token_count"))
    return s.agg(F.count(F.lit(1)).alias("candidates"), F.sum("full").alias("forwarded"), F.sum(F.col("full") - 1).alias("predicted"), F.sum("token_count").alias("continuation"), F.max("full").alias("longest"))


def coherence(spark: SparkSession, d: str) -> DataFrame:
    """A16."""
    return scoring.coherence(_scores(spark, d), _margins(spark, d))


def repeat_verdict(spark: SparkSession, d: str) -> DataFrame:
    """Canonical against reversed execution, in which the first candidate of every first form is planted with another total."""
    a, b = _scores(spark, d), scoring.candidate_scores(_occurrences(spark, d).sort(F.desc("item_id"), F.desc("form_index")).withColumn("token_logprobs", scoring.word_log_probabilities("text")))
    b = b.withColumn("total", F.col("total") - F.when((F.col("form_index") == 0) & (F.col("candidate_index") == 0), 1.0).otherwise(0.0))
    found = scoring.repeat_differences(a.select(*KEYS, "total"), b.select(*KEYS, "total"))
    return found.select(*KEYS, F.round("total", 6).alias("total"), "only_in")


def tokenizer_audit(spark: SparkSession, d: str) -> DataFrame:
    """Tokens per form, largest difference inside a form."""
    n = F.size(F.regexp_extract_all("text", F.lit("[A-Za-z0-9]+"), F.lit(0)))
    f = _occurrences(spark, d).withColumn("n", n.cast("bigint")).groupBy("item_id", "form_index").agg(F.min("n").alias("least"), F.max("n").alias("most"))
    return f.select("item_id", "form_index", "least", "most", (F.col("most") - F.col("least")).alias("difference"))


def score_audit_match(spark: SparkSession, d: str) -> DataFrame:
    """J10, J11, V13."""
    audit = _occurrences(spark, d).withColumn("n_tokens", F.size(F.regexp_extract_all("text", F.lit("[A-Za-z0-9]+"), F.lit(0)))).where("candidate_index = 0 or form_index > 0")
    return scoring.matched(_scores(spark, d), audit, KEYS).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def temporal_cues(spark: SparkSession, d: str) -> DataFrame:
    """P11 over prompts, candidates and the rationale; every second form's prompt is planted with a date."""
    texts = _occurrences(spark, d).select("item_id", F.when(F.col("form_index") == 1, F.concat("prompt", F.lit(" In March 1999, say."))).otherwise(F.col("prompt")).alias("t")).distinct()
    more = _occurrences(spark, d).select("item_id", F.col("text").alias("t")).unionByName(table(spark, d, "eval_items").select("item_id", F.col("rationale").alias("t")))
    found = texts.unionByName(more).select("item_id", scoring.temporal_cue("t").alias("cue")).where("cue is not null")
    return found.groupBy("item_id", "cue").agg(F.count(F.lit(1)).alias("n"))


def document_cues(spark: SparkSession, d: str) -> DataFrame:
    """P11 over documents."""
    docs = table(spark, d, "documents").select(scoring.temporal_cue("text").alias("cue")).where("cue is not null")
    return docs.groupBy("cue").agg(F.count(F.lit(1)).alias("n"))


def _pieces(text: str) -> list[int]:
    """A small tokenizer: words of letters and digits with the blank before them, and single other characters, as checksums."""
    return [zlib.crc32(x.encode()) & 0x7FFFFFFF for x in re.findall(r" ?[A-Za-z0-9]+|[^A-Za-z0-9]", text)]


def prepared_continuations(spark: SparkSession, d: str) -> DataFrame:
    """Prompts with their candidates behind a blank; every second form's candidate stands without the blank."""
    o = _occurrences(spark, d)
    pairs = o.withColumn("continuation", F.when(F.col("form_index") % 2 == 0, F.concat(F.lit(" "), F.trim("text"))).otherwise(F.trim("text"))).withColumn("prompt", F.trim("prompt"))
    made = scoring.prepared_continuations(pairs, KEYS, _pieces, most=90)
    return made.select(*KEYS, F.size("prompt_ids").cast("bigint").alias("prompt_tokens"), F.size("continuation_ids").cast("bigint").alias("continuation_tokens"), "problem")


def evaluation_violations(spark: SparkSession, d: str) -> DataFrame:
    """V5: rules of evaluation items: forms, candidates, poles, word gap, reviews."""
    items = table(spark, d, "eval_items")
    poles = F.col("poles.id")
    a = rules.violations(items, "item_id", {
        "two-poles": (F.size("poles") != 2) | (F.size(F.array_distinct(poles)) != 2),
        "reference-pole": ~F.array_contains(poles, F.col("reference_pole")),
        "forms": F.size("forms") < 2,
        "form-ids": F.size(F.array_distinct(F.col("forms.form_id"))) != F.size("forms"),
        "blank-text": rules.blank("construct") | rules.blank("rationale"),
        "review-note": F.exists(F.map_values("reviews"), lambda r: r["note"].isNull() | (F.trim(r["note"]) == "")),
    })
    n = F.size(F.regexp_extract_all("text", F.lit(ASCII_WORDS), F.lit(0)))
    g = _occurrences(spark, d).withColumn("n", n).groupBy("item_id", "form_index").agg(F.max("n").alias("hi"), F.min("n").alias("lo"), F.count_distinct("pole").alias("p"), F.count(F.lit(1)).alias("k"))
    gap = g.where(F.col("hi") - F.col("lo") > scoring.word_gap_limit(F.col("hi"))).select("item_id", F.lit("word-gap").alias("rule"))
    two = g.where("p <> 2 or k <> 2").select("item_id", F.lit("two-candidates").alias("rule"))
    return a.unionByName(gap).unionByName(two).groupBy("item_id", "rule").agg(F.count(F.lit(1)).alias("n"))


def evaluation_description(spark: SparkSession, d: str) -> DataFrame:
    """A23."""
    i = table(spark, d, "eval_items")
    return i.agg(
        F.count(F.lit(1)).alias("items"), F.sum(F.size("forms")).alias("forms"), F.count_distinct("construct").alias("constructs"),
        F.array_join(F.array_sort(F.collect_set("domain")), ",").alias("domains"), F.array_join(F.array_sort(F.collect_set("status")), ",").alias("statuses"),
    )


_O = """WITH f AS (SELECT item_id, reference_pole, unnest(forms) AS form, generate_subscripts(forms,1)-1 AS form_index FROM eval_items),
 o AS (SELECT item_id, reference_pole, form_index, form.form_id AS form_id, form.context_id AS context_id, form.template_id AS template_id, form.prompt AS prompt,
 generate_subscripts(form.candidates,1)-1 AS candidate_index, unnest(form.candidates) AS c FROM f),
 q AS (SELECT * EXCLUDE (c), c.pole AS pole, c.text AS text, regexp_extract_all(c.text,'[A-Za-z0-9]+') AS w FROM o),
 s AS (SELECT *, list_sum(list_transform(w, lambda x: -(0.1 + length(x)/8.0)))::DOUBLE AS total, len(w) AS token_count FROM q),
 s2 AS (SELECT *, total/token_count AS mean FROM s),
 m AS (SELECT item_id, form_index, form_id, max(total) FILTER (pole=reference_pole) - max(total) FILTER (pole<>reference_pole) AS total_margin,
 max(mean) FILTER (pole=reference_pole) - max(mean) FILTER (pole<>reference_pole) AS mean_margin FROM s2 GROUP BY 1,2,3 HAVING count(*) FILTER (pole=reference_pole)=1 AND count(*) FILTER (pole<>reference_pole)=1),
 a AS (SELECT item_id, avg(total_margin) AS t FROM m GROUP BY 1)"""
_SIG = "1/(1+exp(-({0})))"
_ITEM = """SELECT item_id, count(*) AS form_count, round(avg(total_margin),9) AS mean_total_margin, round(avg(mean_margin),9) AS mean_mean_margin, round(coalesce(stddev_samp(total_margin),0),9) AS total_margin_sd,
 round(avg((sign(total_margin)=sign(t))::INT),9) AS directional_agreement, round(1/(1+exp(-avg(total_margin))),9) AS probability_reference FROM m JOIN a USING (item_id) GROUP BY 1"""


def _cue(c: str) -> str:
    return "coalesce(" + ",".join(f"nullif(regexp_extract({c},'{p}',0),'')" for p in scoring._CUES) + ")"


_PIECES = "len(regexp_extract_all({0},' ?[A-Za-z0-9]+|[^A-Za-z0-9]'))"
SQL = {
    "prepared_continuations": _O + f""", k AS (SELECT item_id, form_index, candidate_index, pole, CASE WHEN form_index%2=1 THEN 'continuation empty or without a blank before it' WHEN {_PIECES.format("trim(prompt)||' '||trim(text)")}>90 THEN 'too long' END AS problem,
 {_PIECES.format('trim(prompt)')} AS p, {_PIECES.format("trim(prompt)||' '||trim(text)")} AS n FROM q) SELECT item_id, form_index, candidate_index, pole, CASE WHEN problem IS NULL THEN p END AS prompt_tokens, CASE WHEN problem IS NULL THEN n-p END AS continuation_tokens, problem FROM k""",
    "evaluation_candidates": _O + " SELECT item_id, form_index, candidate_index, pole, form_id, prompt, text FROM q",
    "execution_trace": _O + " SELECT item_id, string_agg(pole,'>' ORDER BY form_index DESC, candidate_index DESC) AS poles FROM q GROUP BY 1",
    "candidate_scores": _O + " SELECT item_id, form_index, candidate_index, pole, round(total,9) AS total, round(mean,9) AS mean, token_count FROM s2",
    "evidence_violations": _O + " SELECT item_id, form_index, candidate_index, pole, CASE WHEN form_index=1 AND candidate_index=1 THEN 'above zero' ELSE 'empty' END AS rule FROM s2 WHERE token_count=0 OR token_count IS NULL OR (form_index=1 AND candidate_index<2)",
    "pair_margins": _O + f" SELECT item_id, form_index, form_id, round(total_margin,9) AS total_margin, round(mean_margin,9) AS mean_margin, round({_SIG.format('total_margin')},9) AS probability_reference FROM m",
    "calibrated_margins": _O + f" SELECT item_id, form_index, round(total_margin-0.25,9) AS calibrated_margin, round({_SIG.format('total_margin-0.25')},9) AS probability_reference FROM m",
    "item_scores": _O + " " + _ITEM,
    "registry_scores": _O + " SELECT item_id, string_agg(form_id,',' ORDER BY form_index, form_id) AS forms, round(avg(total_margin),9) AS mean_total_margin FROM m GROUP BY 1",
    "score_totals": _O + """ SELECT count(*) AS candidates, sum(n)::BIGINT AS forwarded, sum(n-1)::BIGINT AS predicted, sum(token_count)::BIGINT AS continuation, max(n) AS longest
 FROM (SELECT *, len(regexp_extract_all(prompt,'[A-Za-z0-9]+'))+token_count AS n FROM s2)""",
    "coherence": _O + """, c AS (SELECT item_id, count(DISTINCT token_count)=1 AS one_token_count, max(abs(mean-total/token_count))<=1e-12 AS means_agree FROM s2 GROUP BY 1),
 r AS (SELECT item_id, max(g)=0 AS repeats_agree FROM (SELECT item_id, max(total)-min(total) AS g FROM s2 GROUP BY item_id, context_id, template_id, pole, text) GROUP BY 1),
 z AS (SELECT item_id, min(sign(total_margin))=max(sign(total_margin)) AND min(abs(total_margin))>0 AS one_sign FROM m GROUP BY 1)
 SELECT item_id, one_token_count, means_agree, repeats_agree, one_sign, one_token_count AND means_agree AND repeats_agree AND one_sign AS coherent FROM c JOIN r USING (item_id) JOIN z USING (item_id)""",
    "repeat_verdict": _O + " SELECT item_id, form_index, candidate_index, pole, round(total - CASE o WHEN 'b' THEN 1 ELSE 0 END, 6) AS total, o AS only_in FROM s2, (VALUES ('a'),('b')) x(o) WHERE form_index=0 AND candidate_index=0",
    "tokenizer_audit": _O + " SELECT item_id, form_index, min(token_count) AS least, max(token_count) AS most, max(token_count)-min(token_count) AS difference FROM s2 GROUP BY 1,2",
    "score_audit_match": _O + " SELECT CASE WHEN candidate_index=0 OR form_index>0 THEN 'ok' ELSE 'not audited' END AS status, count(*) AS n FROM s2 GROUP BY 1",
    "temporal_cues": _O + f""", t AS (SELECT DISTINCT item_id, CASE WHEN form_index=1 THEN prompt||' In March 1999, say.' ELSE prompt END AS t FROM q UNION ALL SELECT item_id, text FROM q UNION ALL SELECT item_id, rationale FROM eval_items)
 SELECT item_id, cue, count(*) AS n FROM (SELECT item_id, {_cue('t')} AS cue FROM t) WHERE cue IS NOT NULL GROUP BY 1,2""",
    "document_cues": f"SELECT cue, count(*) AS n FROM (SELECT {_cue('text')} AS cue FROM documents) WHERE cue IS NOT NULL GROUP BY 1",
    "evaluation_violations": _O + """, v AS (SELECT item_id, 'two-poles' AS rule FROM eval_items WHERE len(poles)<>2 OR len(list_distinct(list_transform(poles, lambda p: p.id)))<>2
 UNION ALL SELECT item_id, 'reference-pole' FROM eval_items WHERE NOT list_contains(list_transform(poles, lambda p: p.id), reference_pole)
 UNION ALL SELECT item_id, 'forms' FROM eval_items WHERE len(forms)<2
 UNION ALL SELECT item_id, 'form-ids' FROM eval_items WHERE len(list_distinct(list_transform(forms, lambda f: f.form_id)))<>len(forms)
 UNION ALL SELECT item_id, 'blank-text' FROM eval_items WHERE construct IS NULL OR trim(construct)='' OR rationale IS NULL OR trim(rationale)=''
 UNION ALL SELECT item_id, 'review-note' FROM eval_items WHERE len(list_filter(map_values(reviews), lambda r: r.note IS NULL OR trim(r.note)=''))>0
 UNION ALL SELECT item_id, 'word-gap' FROM (SELECT item_id, form_index, max(n) AS hi, min(n) AS lo FROM (SELECT item_id, form_index, len(regexp_extract_all(text,'[A-Za-z0-9]+(?:[-''][A-Za-z0-9]+)*')) AS n FROM q) GROUP BY 1,2) WHERE hi-lo > greatest(4, round_even(hi*0.25,0)::INT)
 UNION ALL SELECT item_id, 'two-candidates' FROM (SELECT item_id, form_index, count(DISTINCT pole) AS p, count(*) AS k FROM q GROUP BY 1,2) WHERE p<>2 OR k<>2)
 SELECT item_id, rule, count(*) AS n FROM v GROUP BY 1,2""",
    "evaluation_description": """SELECT count(*) AS items, sum(len(forms))::BIGINT AS forms, count(DISTINCT construct) AS constructs, array_to_string(list_sort(list_distinct(list(domain))),',') AS domains,
 array_to_string(list_sort(list_distinct(list(status))),',') AS statuses FROM eval_items""",
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        evaluation_candidates, execution_trace, candidate_scores, candidate_scores_exact, evidence_violations, pair_margins, calibrated_margins, item_scores, registry_scores, score_totals,
        prepared_continuations, coherence, repeat_verdict, tokenizer_audit, score_audit_match, temporal_cues, document_cues, evaluation_violations, evaluation_description,
    )
}
