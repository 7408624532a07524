"""Queries of limits, orders, registry rules and totals."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veridoc.functions import markup, text
from veridoc.operators import audit, contracts, rules
from veridoc.plans import folding
from veridoc.runtime import clean, table

MOST_BYTES, MOST_TOKENS = 8192, 600


def bounded_texts(spark: SparkSession, d: str) -> DataFrame:
    """Texts above the ceilings."""
    t = table(spark, d, "documents").where("text is not null").select("doc_id", "text", text.tokenize("text").alias("t"))
    return t.select("doc_id", audit.bounded_text("text", "t", MOST_BYTES, MOST_TOKENS).alias("breaks")).where("breaks is not null")


def paragraph_texts(spark: SparkSession, d: str) -> DataFrame:
    """Paragraphs of each text, their number and the hash of all of them."""
    p = table(spark, d, "documents").where("text is not null").select("doc_id", markup.paragraph_text("text").alias("p"))
    return p.select("doc_id", F.size(F.split("p", "\n\n")).cast("bigint").alias("paragraphs"), F.md5("p").alias("md5"))


def numeric_identifiers(spark: SparkSession, d: str) -> DataFrame:
    """Customers by source segment, numbered in the order of their decimal ids."""
    c = table(spark, d, "customer").select("c_mktsegment", F.col("c_custkey").cast("string").alias("k"))
    return c.select("c_mktsegment", "k", F.row_number().over(Window.partitionBy("c_mktsegment").orderBy(*audit.numeric_order("k"))).cast("bigint").alias("place"))


def registry_violations(spark: SparkSession, d: str) -> DataFrame:
    """V4: rules of the source registry."""
    r = table(spark, d, "source_registry")
    found = rules.violations(r, "source_id", {
        "family": rules.not_in("source_family", ["A", "B", "C", "CONTROL", "CAL"]), "title": rules.blank("title"), "date-order": rules.not_in("date_order", ["dmy", "mdy", "ymd"]),
        "zone": F.col("native_zone").isNull(), "license": ~F.coalesce(F.col("license_id").rlike(r"^CC(0|-BY)"), F.lit(False)),
    })
    return found.unionByName(rules.repeated(r, "source_id", "title", "title-repeated"))


def selection_totals(spark: SparkSession, d: str) -> DataFrame:
    """Documents and characters by registered source, zeros included, and the whole."""
    docs = table(spark, d, "documents").select(clean("source").alias("source_id"), F.length("text").alias("n"))
    return audit.totals_with_zeros(table(spark, d, "source_registry"), docs, "source_id", {"documents": F.count(F.lit(1)), "characters": F.sum("n")})


def public_leaks(spark: SparkSession, d: str) -> DataFrame:
    """Texts that show an address or a private path."""
    return table(spark, d, "documents").where(audit.public_leaks("text")).select("doc_id")


def generated_items(spark: SparkSession, d: str) -> DataFrame:
    """M5."""
    return audit.generated_items(spark)


def effect_estimates(spark: SparkSession, d: str) -> DataFrame:
    """Planned estimands, over quantity and price by return flag."""
    e = audit.effect_estimates(table(spark, d, "lineitem"), "l_returnflag", F.col("l_quantity"), F.col("l_extendedprice"))
    return e.select("l_returnflag", "n", F.round("mean_difference", 4).alias("mean_difference"), F.round("slope", 4).alias("slope"), F.round("correlation", 6).alias("correlation"), "sign")


def continuation_values(spark: SparkSession, d: str) -> DataFrame:
    """Three values of each embedding from the position its label gives."""
    from veridoc.operators.scoring import continuation_slice

    e = table(spark, d, "embeddings").select("vec_id", continuation_slice("embedding", F.col("label") + 1, F.lit(3)).alias("v"))
    return e.select("vec_id", F.size("v").cast("bigint").alias("n"), F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 5).alias("total"))


def topology_violations(spark: SparkSession, d: str) -> DataFrame:
    """Evaluation items against three forms of two candidates in different cells."""
    return contracts.topology_violations(table(spark, d, "eval_items"), 3, 2)


def same_family_waits(spark: SparkSession, d: str) -> DataFrame:
    """ST7: events of a user that repeat the type of the one before."""
    return contracts.same_family_waits(table(spark, d, "events"), "user_id", "event_id", "event_type").select("user_id", "event_id")


_S = "nullif(regexp_replace(lower(source), '^[\\s ]+|[\\s ]+$', '', 'g'),'')"

SQL = {
    "bounded_texts": f"WITH {folding.tables()}, s AS (SELECT doc_id, text FROM documents WHERE text IS NOT NULL), {folding.folded('f', 's', 'doc_id', 'text')} SELECT doc_id, breaks FROM (SELECT doc_id, CASE WHEN octet_length(encode(text))>{MOST_BYTES} THEN 'bytes' WHEN len({folding.WORDS.format('x')})>{MOST_TOKENS} THEN 'tokens' END AS breaks FROM s JOIN f ON k=doc_id) WHERE breaks IS NOT NULL",
    "paragraph_texts": r"""WITH t AS (SELECT doc_id, replace(replace(nfc_normalize(text), chr(13)||chr(10), chr(10)), chr(13), chr(10)) AS x FROM documents WHERE text IS NOT NULL),
 p AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(x, '\n[\t\x0b\x0c\x1c-\x1f\x{85}\p{Z}]*\n'), lambda y: regexp_replace(regexp_replace(y, '[\s\x0b\x1c-\x1f\x{85}\p{Z}]+', ' ', 'g'), '^ | $', '', 'g')), lambda y: y<>'') AS l FROM t)
 SELECT doc_id, greatest(1, len(l))::BIGINT AS paragraphs, md5(array_to_string(l, chr(10)||chr(10))) AS md5 FROM p""",
    "numeric_identifiers": "SELECT c_mktsegment, c_custkey::VARCHAR AS k, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS place FROM customer",
    "registry_violations": """SELECT source_id, 'family' AS rule FROM source_registry WHERE source_family IS NULL OR source_family NOT IN ('A','B','C','CONTROL','CAL') UNION ALL SELECT source_id, 'title' FROM source_registry WHERE title IS NULL OR trim(title)=''
 UNION ALL SELECT source_id, 'date-order' FROM source_registry WHERE date_order IS NULL OR date_order NOT IN ('dmy','mdy','ymd') UNION ALL SELECT source_id, 'zone' FROM source_registry WHERE native_zone IS NULL
 UNION ALL SELECT source_id, 'license' FROM source_registry WHERE NOT coalesce(regexp_matches(license_id,'^CC(0|-BY)'),false) UNION ALL SELECT source_id, 'title-repeated' FROM source_registry WHERE title IN (SELECT title FROM source_registry GROUP BY 1 HAVING count(*)>1)""",
    "selection_totals": f"""WITH p AS (SELECT {_S} AS source_id, count(*) AS documents, sum(length(text))::BIGINT AS characters FROM documents GROUP BY 1), e AS (SELECT DISTINCT r.source_id, coalesce(documents,0) AS documents, coalesce(characters,0) AS characters FROM source_registry r LEFT JOIN p USING (source_id))
 SELECT * FROM e UNION ALL SELECT '(all)', sum(documents)::BIGINT, sum(characters)::BIGINT FROM e""",
    "effect_estimates": """SELECT l_returnflag, count(*) AS n, round(avg(l_extendedprice-l_quantity),4) AS mean_difference, round(regr_slope(l_extendedprice,l_quantity),4) AS slope, round(corr(l_quantity,l_extendedprice),6) AS correlation,
 sign(corr(l_quantity,l_extendedprice))::INT AS sign FROM lineitem GROUP BY 1""",
    "topology_violations": """SELECT item_id, 'forms' AS rule FROM eval_items WHERE forms IS NULL OR len(forms)<>3 UNION ALL SELECT item_id, 'candidates' FROM eval_items WHERE len(list_filter(forms, lambda f: f.candidates IS NULL OR len(f.candidates)<>2))>0
 UNION ALL SELECT item_id, 'cells' FROM eval_items WHERE len(list_distinct(list_transform(forms, lambda f: {'c': f.context_id, 't': f.template_id})))<>len(forms)""",
    "same_family_waits": "SELECT user_id, event_id FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events) WHERE b=event_type",
    "continuation_values": "SELECT vec_id, len(v) AS n, round(list_sum(list_transform(v, lambda x: x::DOUBLE)),5) AS total FROM (SELECT vec_id, list_slice(embedding, label+1, label+3) AS v FROM embeddings)",
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (bounded_texts, paragraph_texts, numeric_identifiers, registry_violations, selection_totals, public_leaks, generated_items, effect_estimates, continuation_values, topology_violations, same_family_waits)
}
