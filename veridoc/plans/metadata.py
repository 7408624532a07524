"""Queries over source_metadata, manifest, raw_manifest and source_registry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veridoc.functions import dates, rights
from veridoc.functions.labels import path_key
from veridoc.operators import review, rules
from veridoc.runtime import clean, table

EARLY, LATE = ("2012-01-01", "2013-12-31"), ("2018-01-01", "2019-12-31")
SEED = "review-1"
TARGETS = [
    ("ostrel-wiki-article-additions", "early", "timestamp-boundary", 3),
    ("ostrel-wiki-article-additions", "early", "eligible-random", 5),
    ("kirdal-registry-controls", "late", "eligible-random", 4),
    ("kirdal-registry-controls", "late", "timestamp-boundary", 5000),
]
# Closed label sets and required fields of the record schemas.
SEMANTICS = ["revision", "initial-post-version", "submission-version", "publication-version", "release-or-update-datestamp"]
WINDOWS = ["early", "late", "outside", "unresolved"]
VERSIONS = ["version-bounded", "single-version", "latest-only", "unresolved", "unavailable"]
ROLES = ["adaptation", "evaluation", "control", "calibration"]
FAMILIES = ["A", "B", "C", "EVAL", "CONTROL", "CAL"]
ERAS = ["early", "late", "none"]
HOLDOUT = ["exploratory", "confirmatory-held-out", "not-applicable"]
MANIFEST_FIELDS = [
    "schema_version", "record_id", "role", "source_family", "source_id", "era_window", "holdout_status", "content_path", "content_sha256", "normalized_sha256",
    "content_bytes", "word_count", "license_id", "rights_status", "authorship_provenance", "synthetic_fixture", "eligibility", "exclusion_reasons", "metadata",
]
TEXT_FIELDS = ["text", "content", "body", "abstract", "full_text", "fulltext", "source_text", "document_text"]
ID = r"^[A-Za-z0-9][A-Za-z0-9._:/@+-]*\z"
HEX = r"^[0-9a-f]{64}\z"


def _sm(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "source_metadata")


def latest_metadata(spark: SparkSession, d: str) -> DataFrame:
    """One row per record, the delivery received last."""
    last = _sm(spark, d).groupBy("record_id").agg(F.max(F.struct("received_at", "meta_id")).alias("m"), F.count(F.lit(1)).alias("deliveries"))
    return last.select("record_id", "m.meta_id", "deliveries")


def repeat_deliveries(spark: SparkSession, d: str) -> DataFrame:
    """Rows after the first of their record, in order of arrival."""
    w = Window.partitionBy("record_id").orderBy("received_at", "meta_id")
    return _sm(spark, d).select("record_id", "meta_id", F.row_number().over(w).cast("bigint").alias("delivery")).where("delivery > 1")


def metadata_summary(spark: SparkSession, d: str) -> DataFrame:
    """A5: seven one-column counts and the count by source and window.

    All but the strata come from one GROUPING SETS aggregate.
    """
    cols = ["source_id", "era_window", "eligibility", "rights_status", "version_status", "authorship_provenance"]
    base = _sm(spark, d).select(*[F.coalesce(clean(c), F.lit("None")).alias(c) for c in cols], "review_strata")
    sets = [[F.col(c)] for c in cols] + [[F.col("source_id"), F.col("era_window")]]
    grouped = base.groupingSets(sets, *[F.col(c) for c in cols]).agg(F.count(F.lit(1)).alias("n"), F.grouping_id(*cols).alias("g"))
    both = F.concat_ws("|", "source_id", "era_window")
    name, value = F.lit("source_window"), both
    for i, c in enumerate(cols):
        only = F.col("g") == (2 ** len(cols) - 1) - 2 ** (len(cols) - 1 - i)
        name, value = F.when(only, F.lit(c)).otherwise(name), F.when(only, F.col(c)).otherwise(value)
    strata = base.select(F.explode("review_strata").alias("s")).groupBy(F.coalesce(clean("s"), F.lit("None")).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return grouped.select(name.alias("dimension"), value.alias("value"), "n").unionByName(strata.select(F.lit("review_stratum").alias("dimension"), "value", "n"))


def metadata_violations(spark: SparkSession, d: str) -> DataFrame:
    """Broken rules by metadata row."""
    m = _sm(spark, d).withColumn("at", dates.zoned_timestamp("native_timestamp"))
    found = rules.violations(m, "meta_id", {
        "schema-version": ~F.col("schema_version").eqNullSafe(1),
        "record-id": F.col("record_id").isNull() | ~F.col("record_id").rlike(ID),
        "native-item-id": rules.blank("native_item_id"),
        "timestamp-semantics": rules.not_in("timestamp_semantics", SEMANTICS),
        "native-timestamp": F.col("at").isNull(),
        "era-window": rules.not_in("era_window", WINDOWS),
        "era-window-differs": F.col("era_window").isin(WINDOWS[:3]) & (F.col("era_window") != dates.in_window(F.col("at"), EARLY, LATE)),
        "version-status": rules.not_in("version_status", VERSIONS),
        "version-count": F.col("version_count").isNull() | (F.col("version_count") < 1),
        "single-version": (F.col("version_status") == "single-version") & (F.col("version_count") != 1),
        "license-locator": rules.blank("license_locator"),
        "review-strata": F.col("review_strata").isNull() | (F.size("review_strata") == 0),
        "content-locator": F.trim("content_locator") == "",
        "content-retrieved": ~F.col("content_retrieved").eqNullSafe(False),
    })
    registry = table(spark, d, "source_registry")
    return found.unionByName(rules.orphans(m, "meta_id", F.col("source_id"), registry, F.col("source_id"), "source-id")).unionByName(rules.repeated(m, "meta_id", "record_id", "record-id-repeated"))


def manifest_violations(spark: SparkSession, d: str) -> DataFrame:
    """Broken structural rules by manifest row."""
    m = table(spark, d, "manifest")
    found = rules.violations(m, "manifest_id", {
        "schema-version": ~F.col("schema_version").eqNullSafe(1),
        "record-id": F.col("record_id").isNull() | ~F.col("record_id").rlike(ID),
        "role": rules.not_in("role", ROLES), "source-family": rules.not_in("source_family", FAMILIES),
        "era-window": rules.not_in("era_window", ERAS), "holdout-status": rules.not_in("holdout_status", HOLDOUT),
        "source-id": rules.blank("source_id"), "content-path": ~rules.portable_path("content_path"),
        "content-sha256": F.col("content_sha256").isNull() | ~F.col("content_sha256").rlike(HEX),
        "normalized-sha256": F.col("normalized_sha256").isNull() | ~F.col("normalized_sha256").rlike(HEX),
        "content-bytes": F.col("content_bytes").isNull() | (F.col("content_bytes") < 1),
        "word-count": F.col("word_count").isNull() | (F.col("word_count") < 1),
        "license-id": rules.blank("license_id"),
        "forbidden-metadata": F.size(rules.forbidden_keys("metadata", TEXT_FIELDS)) > 0,
    })
    return found.unionByName(rules.repeated(m, "manifest_id", "record_id", "record-id-repeated")).unionByName(rules.repeated(m, "manifest_id", path_key("content_path"), "path-repeated"))


def violation_counts(spark: SparkSession, d: str) -> DataFrame:
    """V1, V2: rules by number of rows that break them."""
    a = metadata_violations(spark, d).select(F.lit("source_metadata").alias("entity"), "rule")
    b = manifest_violations(spark, d).select(F.lit("manifest").alias("entity"), "rule")
    return a.unionByName(b).groupBy("entity", "rule").agg(F.count(F.lit(1)).alias("n"))


def raw_manifest_scan(spark: SparkSession, d: str) -> DataFrame:
    """Manifest lines against the closed schema: unreadable, missing and extra fields."""
    missing, extra = rules.closed_keys("body", MANIFEST_FIELDS)
    whole = F.try_parse_json("body").isNotNull() & F.json_object_keys("body").isNotNull()
    return table(spark, d, "raw_manifest").select(
        "line_id", F.when(~whole, "unreadable").when(F.size(missing) > 0, "missing").when(F.size(extra) > 0, "extra").otherwise("ok").alias("status"),
        F.when(whole, F.array_join(missing, ",")).alias("missing"), F.when(whole, F.array_join(extra, ",")).alias("extra"),
    )


def era_classification(spark: SparkSession, d: str) -> DataFrame:
    """Zoned timestamps by stated and computed window."""
    at = dates.zoned_timestamp("native_timestamp")
    made = _sm(spark, d).select(F.coalesce(clean("era_window"), F.lit("None")).alias("stated"), F.coalesce(dates.in_window(at, EARLY, LATE), F.lit("unreadable")).alias("computed"))
    return made.groupBy("stated", "computed").agg(F.count(F.lit(1)).alias("n"))


def category_counts(spark: SparkSession, d: str) -> DataFrame:
    """A8."""
    return _sm(spark, d).select(F.explode("categories").alias("category")).groupBy("category").agg(F.count(F.lit(1)).alias("n"))


def category_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Category matches and digests by metadata row."""
    e = rights.value_evidence("categories")
    return _sm(spark, d).where("categories is not null").select("meta_id", rights.category_matches("categories", ["field-ecology", "language", "physics"]).alias("matches"), e["n"].cast("bigint").alias("n"), e["sha256"].alias("sha256"))


def licence_rights(spark: SparkSession, d: str) -> DataFrame:
    """Licence locators by class, against the stated rights."""
    lic = rights.licence("license_locator")
    made = _sm(spark, d).select(lic["license_id"].alias("licence"), lic["rights_status"].alias("rights"), rights.rights_of("license_id").alias("by_id"), "rights_status")
    return made.groupBy("licence", "rights", "by_id", "rights_status").agg(F.count(F.lit(1)).alias("n"))


def metadata_description(spark: SparkSession, d: str) -> DataFrame:
    """Sizes and distinct sets of the manifest."""
    return table(spark, d, "manifest").agg(
        F.count(F.lit(1)).alias("records"), F.count_distinct("record_id").alias("record_ids"), F.array_join(F.array_sort(F.collect_set(F.upper(clean("source_family")))), ",").alias("families"),
        F.array_join(F.array_sort(F.collect_set(clean("role"))), ",").alias("roles"), F.sum("content_bytes").alias("bytes"),
    )


def bytes_by_source(spark: SparkSession, d: str) -> DataFrame:
    """Rows and bytes by source, with the total and its size margin of a quarter."""
    r = table(spark, d, "manifest").select(F.coalesce(clean("source_id"), F.lit("None")).alias("source_id"), "content_bytes")
    made = r.rollup("source_id").agg(F.count(F.lit(1)).alias("n"), F.sum("content_bytes").alias("bytes"))
    return made.select(F.coalesce("source_id", F.lit("(all)")).alias("source_id"), "n", "bytes", F.expr("(bytes * 5 + 3) div 4").alias("with_margin"))


def source_enrichment(spark: SparkSession, d: str) -> DataFrame:
    """Manifest rows joined 1:1 with their registry entry; equalities that must hold."""
    r = table(spark, d, "source_registry").select("source_id", F.col("source_family").alias("rf"), F.col("license_id").alias("rl"))
    m = table(spark, d, "manifest").withColumn("source_id", clean("source_id"))
    j = m.join(r, "source_id")
    return j.groupBy("source_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.upper(clean("source_family")).eqNullSafe(F.col("rf"))).alias("family_differs"), F.count_if(~F.col("license_id").eqNullSafe(F.col("rl"))).alias("licence_differs"))


def era_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Native item ids that occur in both windows, every 50th late row planted with the id of the row before it."""
    w = Window.orderBy("meta_id").partitionBy(F.floor(F.col("meta_id") / 50))
    m = _sm(spark, d).select("meta_id", "native_item_id", clean("era_window").alias("w"))
    m = m.withColumn("native_item_id", F.when(F.col("meta_id") % 50 == 49, F.lag("native_item_id").over(w)).otherwise(F.col("native_item_id")))
    return m.where("w = 'early'").select("native_item_id").intersect(m.where("w = 'late'").select("native_item_id"))


def manifest_without_metadata(spark: SparkSession, d: str) -> DataFrame:
    """J7, section 2.9: record ids of the manifest without source metadata, and the reverse."""
    a, b = table(spark, d, "manifest").select("record_id").distinct(), _sm(spark, d).select("record_id").distinct()
    return a.join(b, "record_id", "left_anti").select("record_id", F.lit("manifest").alias("only_in")).unionByName(b.join(a, "record_id", "left_anti").select("record_id", F.lit("source_metadata").alias("only_in")))


def _reviewable(spark: SparkSession, d: str) -> DataFrame:
    """One row per record with canonical labels."""
    m = _sm(spark, d).join(latest_metadata(spark, d).select("meta_id"), "meta_id", "left_semi")
    return m.withColumns({
        "source_id": clean("source_id"), "era_window": clean("era_window"),
        "review_strata": F.array_distinct(F.array_compact(F.transform("review_strata", clean))),
    })


def _sample(spark: SparkSession, d: str) -> DataFrame:
    return review.stratified_sample(_reviewable(spark, d), TARGETS, SEED, strict=False)


def review_sample(spark: SparkSession, d: str) -> DataFrame:
    """T1, P36."""
    return _sample(spark, d).select("target_no", "review_stratum", "record_id")


def review_shortfall(spark: SparkSession, d: str) -> DataFrame:
    """The targets that the sample could not fill, with the records that were there."""
    got = _sample(spark, d).groupBy("target_no").agg(F.count(F.lit(1)).alias("taken"))
    wanted = spark.createDataFrame([(i, n) for i, (_, _, _, n) in enumerate(TARGETS)], "target_no int, wanted bigint")
    out = wanted.join(got, "target_no", "left").withColumn("taken", F.coalesce("taken", F.lit(0)).cast("bigint"))
    return out.where("taken < wanted")


def review_packet(spark: SparkSession, d: str) -> DataFrame:
    """The blinded side."""
    packet, _ = review.packet_and_key(_sample(spark, d), _reviewable(spark, d), SEED)
    return packet.withColumn("categories", F.array_join("categories", ","))


def review_key(spark: SparkSession, d: str) -> DataFrame:
    """The side that resolves it."""
    _, key = review.packet_and_key(_sample(spark, d), _reviewable(spark, d), SEED)
    return key


def redacted_metadata(spark: SparkSession, d: str) -> DataFrame:
    """Redacted rows that still show something private."""
    shown = review.redact(_reviewable(spark, d).drop("source_metadata", "license_locator", "received_at"), SEED)
    hit = review.leaks(shown, "access_id")
    return shown.join(hit.withColumn("leaks", F.lit(True)), "access_id", "left").select("access_id", "access_available", F.coalesce("leaks", F.lit(False)).alias("leaks"))


def access_log(spark: SparkSession, d: str) -> DataFrame:
    """Access requests resolved once, as content-free events."""
    shown = review.redact(_reviewable(spark, d), SEED).select("access_id", "access_available")
    ids = _reviewable(spark, d).select("record_id", F.concat(F.lit("access-"), F.substring(F.sha2(F.concat(F.lit("access\0" + SEED + "\0"), F.col("record_id")), 256), 1, 20)).alias("access_id"))
    asked = review.resolve_access(shown, ids)
    made = asked.select("access_id", F.when(F.col("valid") & F.col("access_available"), "granted").otherwise("refused").alias("outcome"), F.lit("no locator").alias("reason"), F.lit("2026-01-01T00:00:00Z").alias("at"))
    return review.access_events(made).select("event_id", "access_id", "outcome", "reason")


_c = lambda c: f"nullif(regexp_replace(lower({c}), '^[\\s\\u00a0]+|[\\s\\u00a0]+$', '', 'g'),'')".replace("\\u00a0", " ")
_LATEST = "SELECT record_id, max_by(meta_id, (received_at, meta_id)) AS meta_id, count(*) AS deliveries FROM source_metadata GROUP BY record_id"
_ZONED = r"CASE WHEN regexp_full_match(native_timestamp, '\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?(Z|[+-]\d{2}:\d{2})') THEN try_cast(replace(native_timestamp,'T',' ') AS TIMESTAMPTZ) END"
_WINDOW = "CASE WHEN inst IS NULL THEN NULL WHEN CAST(inst AS DATE) BETWEEN '2012-01-01' AND '2013-12-31' THEN 'early' WHEN CAST(inst AS DATE) BETWEEN '2018-01-01' AND '2019-12-31' THEN 'late' ELSE 'outside' END"


def _in(values: list[str]) -> str:
    return "(" + ",".join(f"'{v}'" for v in values) + ")"


def _rules_sql(base: str, key: str, conditions: dict[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT {key}, '{name}' AS rule FROM {base} WHERE {cond}" for name, cond in conditions.items())


_META_RULES = _rules_sql("m", "meta_id", {
    "schema-version": "schema_version IS DISTINCT FROM 1", "record-id": f"record_id IS NULL OR NOT regexp_matches(record_id, '{ID}')",
    "native-item-id": "native_item_id IS NULL OR trim(native_item_id)=''", "timestamp-semantics": f"timestamp_semantics IS NULL OR timestamp_semantics NOT IN {_in(SEMANTICS)}",
    "native-timestamp": "inst IS NULL", "era-window": f"era_window IS NULL OR era_window NOT IN {_in(WINDOWS)}",
    "era-window-differs": f"era_window IN {_in(WINDOWS[:3])} AND era_window <> {_WINDOW}", "version-status": f"version_status IS NULL OR version_status NOT IN {_in(VERSIONS)}",
    "version-count": "version_count IS NULL OR version_count<1", "single-version": "version_status='single-version' AND version_count<>1",
    "license-locator": "license_locator IS NULL OR trim(license_locator)=''", "review-strata": "review_strata IS NULL OR len(review_strata)=0", "content-locator": "trim(content_locator)=''",
    "content-retrieved": "content_retrieved IS DISTINCT FROM false", "source-id": "source_id IS NULL OR source_id NOT IN (SELECT source_id FROM source_registry)",
    "record-id-repeated": "record_id IN (SELECT record_id FROM m GROUP BY 1 HAVING count(*)>1)",
})
_META_SQL = f"WITH m AS (SELECT *, {_ZONED} AS inst FROM source_metadata) " + _META_RULES
_PATHKEY = r"regexp_replace(regexp_replace(regexp_replace(lower(trim(content_path)), '\\+', '/', 'g'), '^(\.?/+)+', ''), '/{2,}', '/', 'g')"
_BAD_PATH = (
    r"""content_path IS NULL OR regexp_matches(content_path, '[\\:*?"<>|\x00-\x1f]') OR regexp_matches(content_path, '(^|/)\.{0,2}(/|$)') OR regexp_matches(content_path, '[. ](/|$)')"""
    r""" OR regexp_matches(content_path, '(?i)(^|/)(con|prn|aux|nul|com[0-9]|lpt[0-9])(\.[^/]*)?(/|$)')"""
)
_MAN_RULES = _rules_sql("m", "manifest_id", {
    "schema-version": "schema_version IS DISTINCT FROM 1", "record-id": f"record_id IS NULL OR NOT regexp_matches(record_id, '{ID}')", "role": f"role IS NULL OR role NOT IN {_in(ROLES)}",
    "source-family": f"source_family IS NULL OR source_family NOT IN {_in(FAMILIES)}", "era-window": f"era_window IS NULL OR era_window NOT IN {_in(ERAS)}",
    "holdout-status": f"holdout_status IS NULL OR holdout_status NOT IN {_in(HOLDOUT)}", "source-id": "source_id IS NULL OR trim(source_id)=''", "content-path": _BAD_PATH,
    "content-sha256": f"content_sha256 IS NULL OR NOT regexp_matches(content_sha256,'{HEX}')", "normalized-sha256": f"normalized_sha256 IS NULL OR NOT regexp_matches(normalized_sha256,'{HEX}')",
    "content-bytes": "content_bytes IS NULL OR content_bytes<1", "word-count": "word_count IS NULL OR word_count<1", "license-id": "license_id IS NULL OR trim(license_id)=''",
    "forbidden-metadata": f"len(list_filter(map_keys(metadata), lambda k: lower(k) IN {_in(TEXT_FIELDS)}))>0",
    "record-id-repeated": "record_id IN (SELECT record_id FROM m GROUP BY 1 HAVING count(*)>1)", "path-repeated": f"{_PATHKEY} IN (SELECT {_PATHKEY} FROM m GROUP BY 1 HAVING count(*)>1)",
})
_MAN_SQL = "WITH m AS (SELECT * FROM manifest) " + _MAN_RULES
_REVIEWABLE = f"""m AS (SELECT s.* REPLACE ({_c('source_id')} AS source_id, {_c('era_window')} AS era_window,
 list_distinct(list_filter(list_transform(review_strata, lambda x: {_c('x')}), lambda x: x IS NOT NULL)) AS review_strata) FROM source_metadata s WHERE meta_id IN (SELECT meta_id FROM ({_LATEST})))"""


def _target_sql(i: int) -> str:
    source, window, stratum, n = TARGETS[i]
    skip = "".join(f" AND record_id NOT IN (SELECT record_id FROM t{j})" for j in range(i))
    return (
        f"t{i} AS (SELECT {i} AS target_no, '{stratum}' AS review_stratum, record_id FROM m WHERE source_id='{source}' AND era_window='{window}' AND list_contains(review_strata,'{stratum}'){skip}"
        f" ORDER BY sha256('{SEED}'||chr(0)||'{stratum}'||chr(0)||record_id), record_id LIMIT {n})"
    )


_SAMPLE = "WITH " + _REVIEWABLE + ", " + ", ".join(_target_sql(i) for i in range(len(TARGETS))) + ", s AS (" + " UNION ALL ".join(f"SELECT * FROM t{i}" for i in range(len(TARGETS))) + ")"
_BLIND = f"'sample-'||substr(sha256('blind'||chr(0)||'{SEED}'||chr(0)||record_id),1,20) AS blind_id"
_ACCESS = f"'access-'||substr(sha256('access'||chr(0)||'{SEED}'||chr(0)||record_id),1,20)"
_DIM = ["source_id", "era_window", "eligibility", "rights_status", "version_status", "authorship_provenance"]
_CCURL = "^https?://(?:www\\.)?creativecommons\\.org/"
_SQUEEZED = "trim(regexp_replace(license_locator,'\\s+',' ','g'))"

SQL = {
    "latest_metadata": _LATEST,
    "repeat_deliveries": "SELECT record_id, meta_id, delivery FROM (SELECT record_id, meta_id, row_number() OVER (PARTITION BY record_id ORDER BY received_at, meta_id) AS delivery FROM source_metadata) WHERE delivery>1",
    "metadata_summary": " UNION ALL ".join([f"SELECT '{c}' AS dimension, coalesce({_c(c)},'None') AS value, count(*) AS n FROM source_metadata GROUP BY 2" for c in _DIM])
    + f" UNION ALL SELECT 'source_window', coalesce({_c('source_id')},'None')||'|'||coalesce({_c('era_window')},'None'), count(*) FROM source_metadata GROUP BY 2"
    + f" UNION ALL SELECT 'review_stratum', coalesce({_c('s')},'None'), count(*) FROM (SELECT unnest(review_strata) AS s FROM source_metadata) GROUP BY 2",
    "metadata_violations": _META_SQL,
    "manifest_violations": _MAN_SQL,
    "violation_counts": f"SELECT entity, rule, count(*) AS n FROM (SELECT 'source_metadata' AS entity, rule FROM ({_META_SQL}) UNION ALL SELECT 'manifest', rule FROM ({_MAN_SQL})) GROUP BY 1,2",
    "raw_manifest_scan": f"""WITH k AS (SELECT line_id, CASE WHEN json_valid(body) AND json_type(body)='OBJECT' THEN json_keys(body) END AS k FROM raw_manifest),
 x AS (SELECT line_id, k, list_sort(list_filter({MANIFEST_FIELDS}, lambda f: NOT list_contains(k,f))) AS a, list_sort(list_filter(k, lambda f: NOT list_contains({MANIFEST_FIELDS},f))) AS b FROM k)
 SELECT line_id, CASE WHEN k IS NULL THEN 'unreadable' WHEN len(a)>0 THEN 'missing' WHEN len(b)>0 THEN 'extra' ELSE 'ok' END AS status, CASE WHEN k IS NOT NULL THEN coalesce(array_to_string(a,','),'') END AS missing, CASE WHEN k IS NOT NULL THEN coalesce(array_to_string(b,','),'') END AS extra FROM x""",
    "era_classification": f"SELECT coalesce({_c('era_window')},'None') AS stated, coalesce({_WINDOW},'unreadable') AS computed, count(*) AS n FROM (SELECT *, {_ZONED} AS inst FROM source_metadata) GROUP BY 1,2",
    "category_counts": "SELECT category, count(*) AS n FROM (SELECT unnest(categories) AS category FROM source_metadata) GROUP BY 1",
    "category_evidence": """SELECT meta_id, len(list_filter(categories, lambda c: c IN ('field-ecology','language','physics') OR starts_with(c,'field-ecology.') OR starts_with(c,'language.') OR starts_with(c,'physics.')))>0 AS matches,
 len(list_distinct(categories)) AS n, sha256(array_to_string(list_sort(list_distinct(categories)), chr(0))) AS sha256 FROM source_metadata WHERE categories IS NOT NULL""",
    "licence_rights": f"""WITH x AS (SELECT {_SQUEEZED} AS c, license_id, rights_status FROM source_metadata), y AS (SELECT *, regexp_extract(c,'{_CCURL}publicdomain/zero/(\\d\\.\\d)/?$',1) AS z, regexp_extract(c,'{_CCURL}licenses/by/(\\d\\.\\d)/?$',1) AS b FROM x),
 q AS (SELECT CASE WHEN c IS NULL THEN 'missing' WHEN z<>'' THEN 'CC0-'||z WHEN b<>'' THEN 'CC-BY-'||b WHEN contains(lower(c),'creativecommons.org') OR contains(lower(c),'creative commons') THEN 'creative-commons-other'
 WHEN regexp_matches(c,'^https?://(?:www\\.)?arxiv\\.org/licenses/nonexclusive-distrib/1\\.0/?$') THEN 'arXiv-default' ELSE 'custom-or-unresolved' END AS licence, license_id, rights_status FROM y)
 SELECT licence, CASE WHEN starts_with(licence,'CC') THEN 'eligible' WHEN licence IN ('creative-commons-other','arXiv-default') THEN 'ineligible' ELSE 'unresolved' END AS rights,
 CASE WHEN regexp_matches(license_id,'^(CC0-|CC-BY-)') THEN 'eligible' WHEN license_id IN ('creative-commons-other','arXiv-default') THEN 'ineligible' WHEN license_id IN ('custom-or-unresolved','missing','pending-arXivRaw-enrichment') THEN 'unresolved' END AS by_id,
 rights_status, count(*) AS n FROM q GROUP BY 1,2,3,4""",
    "metadata_description": f"""SELECT count(*) AS records, count(DISTINCT record_id) AS record_ids, array_to_string(list_sort(list_distinct(list(upper({_c('source_family')})) )),',') AS families,
 array_to_string(list_sort(list_distinct(list({_c('role')}))),',') AS roles, sum(content_bytes)::BIGINT AS bytes FROM manifest""",
    "bytes_by_source": f"""WITH r AS (SELECT coalesce({_c('source_id')},'None') AS source_id, content_bytes FROM manifest), g AS (SELECT source_id, count(*) AS n, sum(content_bytes)::BIGINT AS bytes FROM r GROUP BY 1 UNION ALL SELECT '(all)', count(*), sum(content_bytes)::BIGINT FROM r)
 SELECT *, (bytes*5+3)//4 AS with_margin FROM g""",
    "source_enrichment": f"""SELECT r.source_id, count(*) AS n, count(*) FILTER (upper({_c('m.source_family')}) IS DISTINCT FROM r.source_family) AS family_differs, count(*) FILTER (m.license_id IS DISTINCT FROM r.license_id) AS licence_differs
 FROM manifest m JOIN source_registry r ON {_c('m.source_id')}=r.source_id GROUP BY 1""",
    "era_overlap": f"WITH m AS (SELECT CASE WHEN meta_id%50=49 THEN lag(native_item_id) OVER (PARTITION BY meta_id//50 ORDER BY meta_id) ELSE native_item_id END AS native_item_id, {_c('era_window')} AS w FROM source_metadata) SELECT native_item_id FROM m WHERE w='early' INTERSECT SELECT native_item_id FROM m WHERE w='late'",
    "manifest_without_metadata": """SELECT DISTINCT record_id, 'manifest' AS only_in FROM manifest WHERE record_id NOT IN (SELECT record_id FROM source_metadata WHERE record_id IS NOT NULL)
 UNION ALL SELECT DISTINCT record_id, 'source_metadata' FROM source_metadata WHERE record_id NOT IN (SELECT record_id FROM manifest WHERE record_id IS NOT NULL)""",
    "review_shortfall": _SAMPLE + f", g AS (SELECT target_no, count(*) AS taken FROM s GROUP BY 1) SELECT x.target_no, wanted, coalesce(taken,0) AS taken FROM (VALUES {', '.join(str((i, n)) for i, (_, _, _, n) in enumerate(TARGETS))}) x(target_no, wanted) LEFT JOIN g USING (target_no) WHERE coalesce(taken,0)<wanted",
    "review_sample": _SAMPLE + " SELECT target_no, review_stratum, record_id FROM s",
    "review_packet": _SAMPLE + f" SELECT {_BLIND}, source_id, review_stratum, array_to_string(categories,',') AS categories, version_status, rights_status, authorship_provenance FROM s JOIN m USING (record_id)",
    "review_key": _SAMPLE + f" SELECT {_BLIND}, record_id, source_id, native_item_id, era_window, native_timestamp FROM s JOIN m USING (record_id)",
    "access_log": "WITH " + _REVIEWABLE + f""", a AS (SELECT {_ACCESS} AS access_id, CASE WHEN content_locator IS NOT NULL THEN 'granted' ELSE 'refused' END AS outcome FROM m),
 b AS (SELECT *, CASE WHEN outcome='refused' THEN 'no locator' END AS reason FROM a) SELECT 'event-'||substr(sha256(access_id||chr(0)||outcome||chr(0)||coalesce(reason,'')||chr(0)||'2026-01-01T00:00:00Z'),1,20) AS event_id, access_id, outcome, reason FROM b""",
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        latest_metadata, repeat_deliveries, metadata_summary, metadata_violations, manifest_violations, violation_counts, raw_manifest_scan, era_classification, category_counts,
        category_evidence, licence_rights, metadata_description, bytes_by_source, source_enrichment, era_overlap, manifest_without_metadata, review_sample, review_shortfall, review_packet, review_key,
        redacted_metadata, access_log,
    )
}
