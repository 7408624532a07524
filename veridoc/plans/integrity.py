"""Queries of the content-integrity operators over documents, manifest and eval_items."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veridoc.functions import text
from veridoc.functions.labels import path_key
from veridoc.operators import integrity
from veridoc.plans import folding
from veridoc.runtime import BROADCAST_BYTES, clean, few, materialise, salted_join, small, table

SHINGLE, SIMILARITY = 4, 0.55
NGRAM, LEAST_JACCARD, LEAST_CONTAINMENT = 5, 0.12, 0.25
#: Byte limits of one record and of all records of an audit.
MOST_RECORD_BYTES, MOST_TOTAL_BYTES = 8192, 64 << 20
#: Most phrases of a registry: each is one test in the plan.
MAX_PATTERNS = 1000
#: A small registry of literal phrases: (category, pattern id, words).
PATTERNS = [
    ("workflow", "annual-report", ["an", "annual", "report"]),
    ("workflow", "council-minutes", ["the", "council", "minutes"]),
    ("place", "old-quay", ["of", "the", "old", "quay"]),
    ("place", "mountain-road", ["the", "mountain", "road"]),
    ("policy", "bear-the-cost", ["bear", "the", "cost"]),
    ("policy", "share-costs", ["share", "costs", "with"]),
]


def tokens(spark: SparkSession, d: str) -> DataFrame:
    """Documents with their words by the normaliser; a null text has none."""
    docs = table(spark, d, "documents")
    return docs.select("doc_id", clean("source").alias("source"), "lang", "domain", F.coalesce("text", F.lit("")).alias("text")).withColumn("tokens", text.tokenize("text"))


def doc_words(spark: SparkSession, d: str) -> DataFrame:
    """P1, P4."""
    return tokens(spark, d).select("doc_id", F.size("tokens").cast("bigint").alias("n_words"), F.size(F.array_distinct("tokens")).cast("bigint").alias("n_distinct"))


def normalized_hashes(spark: SparkSession, d: str) -> DataFrame:
    """Content and normalised hashes."""
    return tokens(spark, d).select("doc_id", F.sha2("text", 256).alias("content_sha256"), text.normalized_sha256("tokens").alias("normalized_sha256"))


def ascii_word_counts(spark: SparkSession, d: str) -> DataFrame:
    """P3."""
    found = F.regexp_extract_all("text", F.lit("[A-Za-z0-9]+(?:[-'][A-Za-z0-9]+)*"), F.lit(0))
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.size(found).cast("bigint").alias("n_ascii_words"))


def word_frequencies(spark: SparkSession, d: str) -> DataFrame:
    """How often each word occurs, and in how many documents."""
    each = tokens(spark, d).select("doc_id", F.explode("tokens").alias("word")).groupBy("word", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    return each.groupBy("word").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_docs"))


def _raw(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").withColumn("digest", F.sha2("text", 256)).select("doc_id", "digest", clean("source").alias("source"), "lang")


def _normalised(spark: SparkSession, d: str) -> DataFrame:
    return tokens(spark, d).where(F.size("tokens") > 0).withColumn("digest", text.normalized_sha256("tokens")).select("doc_id", "digest", "source", "lang")


_FLAGS = {"cross_source": "source", "cross_lang": "lang"}


def clusters_raw(spark: SparkSession, d: str) -> DataFrame:
    """A1 over identical bytes."""
    return integrity.clusters(_raw(spark, d), "digest", "raw", "doc_id", _FLAGS)


def clusters_normalized(spark: SparkSession, d: str) -> DataFrame:
    """A1 over equal normalised texts."""
    return integrity.clusters(_normalised(spark, d), "digest", "normalized", "doc_id", _FLAGS)


def cluster_members(spark: SparkSession, d: str) -> DataFrame:
    """A1: members of the clusters of equal normalised texts."""
    held = materialise(_normalised(spark, d), "digests")
    return integrity.cluster_members(held, integrity.clusters(held, "digest", "normalized", "doc_id", _FLAGS), "digest", "doc_id")


def manifest_clusters(spark: SparkSession, d: str) -> DataFrame:
    """A1, P39 over the manifest's normalised hashes."""
    m = table(spark, d, "manifest").where("normalized_sha256 is not null")
    grouped = m.groupBy("normalized_sha256").agg(
        F.count(F.lit(1)).alias("record_count"), F.collect_set("holdout_status").alias("h"),
        (F.count_distinct("source_family") > 1).alias("cross_family"), (F.count_distinct("role") > 1).alias("cross_role"),
    )
    return grouped.where("record_count > 1").select("normalized_sha256", "record_count", "cross_family", "cross_role", integrity.crosses_boundary("h").alias("crosses_holdout"))


def shingle_counts(spark: SparkSession, d: str) -> DataFrame:
    """P5, P6."""
    t = tokens(spark, d)
    return t.select("doc_id", F.size(integrity.shingles("tokens", SHINGLE)).cast("bigint").alias("n_shingles"), F.size(integrity.shingles("tokens", 10, short=False)).cast("bigint").alias("n_tengrams"))


def _first(held: DataFrame, digest: str) -> DataFrame:
    """``held`` (a written table) restricted to the smallest doc_id of each digest."""
    return held.join(held.groupBy(digest).agg(F.min("doc_id").alias("doc_id")).select("doc_id"), "doc_id", "left_semi")


def _sets(spark: SparkSession, d: str, ids: DataFrame) -> DataFrame:
    """``(id, set)``: the run hashes of the texts of ``ids`` (a written table), computed from the texts at each reading.

    Whichever list of ids is short, this or that of the other documents, goes to the texts; texts move only if both are long.
    """
    docs = table(spark, d, "documents").where("doc_id is not null and text is not null").select(F.col("doc_id").alias("id"), "text")
    limit = BROADCAST_BYTES // 32
    if ids.count() <= limit:
        docs = docs.join(F.broadcast(ids), "id", "left_semi")
    else:
        others = materialise(docs.select("id").join(ids, "id", "left_anti").distinct(), "others")
        docs = docs.join(F.broadcast(others), "id", "left_anti") if others.count() <= limit else docs.join(ids, "id", "left_semi")
    return docs.select("id", text.run_hashes("text", [SHINGLE], short=True).alias("set"))


def _near(spark: SparkSession, d: str, heads: DataFrame) -> DataFrame:
    """The near pairs of the texts of ``heads`` (a written table)."""
    return integrity.near_pairs(_sets(spark, d, heads.select(F.col("doc_id").alias("id"))), SIMILARITY, lambda ids: _sets(spark, d, ids))


def _heads(spark: SparkSession, d: str) -> DataFrame:
    """The first document of every distinct normalised text that has words."""
    docs = table(spark, d, "documents").where("doc_id is not null and text is not null")
    held = docs.select("doc_id", clean("source").alias("source"), "lang", text.word_digests("text").alias("digest")).where("digest is not null")
    return materialise(_first(materialise(held, "digests"), "digest"), "heads")


def near_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Similar distinct texts, each by its first document; ``text_classes`` gives the copies of each."""
    heads = _heads(spark, d)
    pairs = _near(spark, d, heads)
    return integrity.pair_flags(pairs, heads, "doc_id", {"cross_source": "source", "cross_lang": "lang"}).select(
        "left_id", "right_id", "shared_shingles", "left_shingles", "right_shingles", "jaccard", "cross_source", "cross_lang"
    )


def text_classes(spark: SparkSession, d: str) -> DataFrame:
    """Membership: every document with words, the first document with the same words, and their number."""
    held = materialise(tokens(spark, d).where(F.size("tokens") > 0).select("doc_id", text.normalized_sha256("tokens").alias("digest")), "digests")
    classes = held.groupBy("digest").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("n_copies"))
    return salted_join(held, materialise(classes, "classes"), ["digest"], "n_copies", 100_000).select("doc_id", "class_id", "n_copies")


def near_pair_sources(spark: SparkSession, d: str) -> DataFrame:
    """A3: near pairs of distinct texts by their sources."""
    heads = _heads(spark, d)
    pairs = _near(spark, d, heads)
    return integrity.pair_counts(integrity.pair_flags(pairs, heads, "doc_id", {"cross_source": "source"}), "source")


def simhash_values(spark: SparkSession, d: str) -> DataFrame:
    """P7, P8."""
    t = materialise(tokens(spark, d).select("doc_id", integrity.shingles("tokens", SHINGLE).alias("runs")), "runs")
    return t.select("doc_id", integrity.simhash64("runs").alias("simhash")).withColumn("bands", integrity.simhash_bands("simhash"))


def simhash_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Near pairs of distinct texts that share a SimHash band."""
    pairs = materialise(_near(spark, d, _heads(spark, d)), "pairs")
    needed = few(pairs.select(F.explode(F.array("left_id", "right_id")).alias("doc_id")).distinct())
    docs = table(spark, d, "documents").join(needed, "doc_id", "left_semi").select(F.col("doc_id").alias("id"), text.tokenize("text").alias("tokens"))
    hashes = docs.select("id", integrity.shingles("tokens", SHINGLE).alias("runs")).select("id", integrity.simhash64("runs").alias("simhash"))
    found = integrity.simhash_pairs(pairs, hashes)
    return found.select("left_id", "right_id", "jaccard", "bands")


def evaluation_exposure(spark: SparkSession, d: str) -> DataFrame:
    """Prompts and candidate texts against documents; the text by its hash."""
    forms = table(spark, d, "eval_items").select(F.explode("forms").alias("f"))
    texts = forms.select(F.col("f.prompt").alias("text")).unionByName(forms.select(F.explode("f.candidates.text").alias("text")))
    texts = texts.where("text is not null").distinct().withColumn("item_sha256", F.sha2("text", 256))
    return integrity.exposure(table(spark, d, "documents"), texts, "doc_id", "item_sha256", "text", NGRAM, LEAST_JACCARD, LEAST_CONTAINMENT)


def pattern_registry(spark: SparkSession) -> DataFrame:
    """The registry of literal phrases in its nested form."""
    nested = [(c, [(p, "literal", " ".join(w)) for k, p, w in PATTERNS if k == c]) for c in dict.fromkeys(c for c, _, _ in PATTERNS)]
    return spark.createDataFrame([(nested,)], "categories array<struct<id:string,patterns:array<struct<id:string,type:string,value:string>>>>")


def pattern_exposure(spark: SparkSession, d: str) -> DataFrame:
    """J5, S18."""
    patterns = [(r["category"], r["pattern_id"], r["words"]) for r in small(integrity.registry_patterns(pattern_registry(spark)), MAX_PATTERNS, "pattern registry")]
    out = integrity.pattern_exposure(tokens(spark, d), patterns, "doc_id", "tokens")
    return out.withColumns({"pattern_ids": F.array_join("pattern_ids", ","), "categories": F.array_join("categories", ",")})


def resolved_manifest(spark: SparkSession, d: str) -> DataFrame:
    """Manifest rows joined with their texts, observed values against stated ones."""
    docs = table(spark, d, "documents").select(path_key("content_path").alias("k"), "doc_id", F.sha2("text", 256).alias("seen"), F.octet_length("text").cast("bigint").alias("bytes"))
    m = table(spark, d, "manifest").select("manifest_id", path_key("content_path").alias("k"), "content_sha256", "content_bytes")
    j = m.join(docs, "k", "left")
    status = (
        F.when(F.col("doc_id").isNull(), "no document").when(F.col("seen").isNull(), "no text").when(F.col("content_sha256").isNull(), "no hash stated")
        .when(F.lower(F.col("content_sha256")) != F.col("seen"), "hash differs").when(~F.col("content_bytes").eqNullSafe(F.col("bytes")), "size differs").otherwise("ok")
    )
    return j.select("manifest_id", "doc_id", status.alias("status"))


def integrity_summary(spark: SparkSession, d: str) -> DataFrame:
    """A2: conditional counts of the audit in one aggregate."""
    t = tokens(spark, d).select("doc_id", "source", F.size("tokens").alias("n"), text.normalized_sha256("tokens").alias("h"), F.sha2("text", 256).alias("c"))
    return t.agg(
        F.count(F.lit(1)).alias("records"), F.count_if(F.col("n") == 0).alias("without_words"), F.count_if(F.col("n") < SHINGLE).alias("below_shingle"),
        F.count_distinct("h").alias("normalized_texts"), F.count_distinct("c").alias("raw_texts"), F.count_if(F.col("source").isNull()).alias("without_source"),
        F.sum("n").alias("words"), F.max("n").cast("bigint").alias("longest"),
    )


def _records(spark: SparkSession, d: str, *facts: Column) -> DataFrame:
    """Facts of the documents with the manifest row that was received last for their path: the content records of an audit."""
    m = table(spark, d, "manifest").where("content_path is not null").select(
        path_key("content_path").alias("k"), "received_at", "manifest_id", clean("role").alias("role"), F.upper(clean("source_family")).alias("family"), clean("holdout_status").alias("holdout"), "synthetic_fixture", "content_bytes"
    )
    m = m.groupBy("k").agg(F.max(F.struct("received_at", "manifest_id", "role", "family", "holdout", "synthetic_fixture", "content_bytes")).alias("m"))
    docs = table(spark, d, "documents").where("text is not null").select(path_key("content_path").alias("k"), "doc_id", *facts)
    return docs.join(m, "k").select("doc_id", *[c for c in docs.columns if c not in ("k", "doc_id")], "m.role", "m.family", "m.holdout", "m.synthetic_fixture", "m.content_bytes")


def audit_summary(spark: SparkSession, d: str) -> DataFrame:
    """A2, A4: the thirteen counts of a full audit over all records: roles, clusters, near pairs, exposure and boundaries."""
    held = materialise(_records(spark, d, F.sha2("text", 256).alias("raw"), F.hex(text.word_digests("text")).alias("normal")).drop("content_bytes"), "records")
    counts = {
        "record_count": F.lit(True), "adaptation_record_count": F.col("role") == "adaptation", "evaluation_record_count": F.col("role") == "evaluation",
        "real_source_c_record_count": (F.col("role") == "adaptation") & (F.col("family") == "C") & ~F.col("synthetic_fixture"),
    }
    parts = [held.agg(*[F.count_if(c).alias(k) for k, c in counts.items()])]
    for name, digest in (("raw", "raw"), ("normalized", "normal")):
        found = integrity.clusters(held, digest, name, "doc_id", {"cross": "family"})
        parts.append(found.agg(F.count(F.lit(1)).alias(f"exact_{name}_cluster_count"), F.count_if("cross").alias(f"cross_source_{name}_cluster_count")))
    heads = materialise(_first(held.where("normal is not null"), "normal"), "heads")
    pairs = integrity.pair_flags(_near(spark, d, heads), heads, "doc_id", {"family": "family", "holdout": "holdout"})
    boundary = (F.coalesce("l_holdout", F.lit("")) == integrity.HELD_OUT) != (F.coalesce("r_holdout", F.lit("")) == integrity.HELD_OUT)
    parts.append(pairs.agg(F.count(F.lit(1)).alias("near_duplicate_pair_count"), F.count_if("family").alias("cross_source_near_pair_count"), F.count_if(boundary).alias("holdout_boundary_near_pair_count")))
    ids = held.select("doc_id")
    parts.append(evaluation_exposure(spark, d).join(ids, "doc_id", "left_semi").agg(F.count(F.lit(1)).alias("evaluation_exposure_pair_count")))
    parts.append(pattern_exposure(spark, d).join(ids, "doc_id", "left_semi").agg(F.count(F.lit(1)).alias("direct_exposure_record_count")))
    rows = [p.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, p.columns)), F.array(*p.columns))).alias("name", "n")) for p in parts]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def content_budget(spark: SparkSession, d: str) -> DataFrame:
    """Records above the byte limit of one record, stated sizes that differ, and whether all records fit the total limit."""
    r = _records(spark, d, F.octet_length("text").cast("bigint").alias("n"))
    return r.agg(F.count(F.lit(1)).alias("records"), F.sum("n").alias("bytes"), F.count_if(F.col("n") > MOST_RECORD_BYTES).alias("too_large"), F.count_if(~F.col("n").eqNullSafe(F.col("content_bytes"))).alias("size_differs"), (F.sum("n") > MOST_TOTAL_BYTES).alias("over_total"))


SOURCE = r"nullif(lower(trim(source)),'')"
_T = (
    f"WITH {folding.tables()}, t_s AS (SELECT doc_id, {SOURCE} AS source, lang, text IS NULL AS no_text, coalesce(text,'') AS text FROM documents), {folding.folded('t_f', 't_s', 'doc_id', 'text')},"
    f" t AS (SELECT doc_id, source, lang, no_text, text, {folding.WORDS.format('x')} AS w FROM t_s JOIN t_f ON k=doc_id)"
)
_NEAR = (
    _T
    + f""", s AS (SELECT doc_id, source, lang, row_number() OVER (PARTITION BY array_to_string(w,' ') ORDER BY doc_id) AS copy, CASE WHEN len(w)>=4 THEN {folding.grams('w', 4)} ELSE [array_to_string(w,' ')] END AS r FROM t WHERE len(w)>0),
 e AS (SELECT doc_id, len(r) AS n, unnest(r) AS x FROM s WHERE copy=1),
 c AS (SELECT a.doc_id AS l, b.doc_id AS r, any_value(a.n) AS ln, any_value(b.n) AS rn, count(*) AS k FROM e a JOIN e b ON a.x=b.x AND a.doc_id<b.doc_id GROUP BY 1,2),
 p AS (SELECT l AS left_id, r AS right_id, k AS shared_shingles, ln AS left_shingles, rn AS right_shingles, round(k::DOUBLE/(ln+rn-k),12) AS jaccard FROM c WHERE k::DOUBLE/(ln+rn-k)>=0.55)
"""
)


_PATH = r"regexp_replace(regexp_replace(regexp_replace(lower(trim(content_path)), '\\+', '/', 'g'), '^(\.?/+)+', ''), '/{2,}', '/', 'g')"
_REC = f"""mm AS (SELECT {_PATH} AS k, max_by(struct_pack(role := lower(trim(role)), family := upper(trim(source_family)), holdout := lower(trim(holdout_status)), synthetic := synthetic_fixture, content_bytes := content_bytes), (received_at, manifest_id)) AS m FROM manifest WHERE content_path IS NOT NULL GROUP BY 1),
 rec AS (SELECT doc_id, text, nullif(m.role,'') AS role, nullif(m.family,'') AS family, nullif(m.holdout,'') AS holdout, m.synthetic AS synthetic, m.content_bytes AS content_bytes FROM (SELECT doc_id, text, {_PATH} AS k FROM documents WHERE text IS NOT NULL) JOIN mm USING (k))"""


def _clusters_sql(prefix: str, digest: str, where: str) -> str:
    return _T + (
        f" SELECT '{prefix}-'||substr(digest,1,16) AS cluster_id, digest, count(*) AS record_count, min(doc_id) AS first_record,"
        f" count(DISTINCT coalesce(source,chr(1)))>1 AS cross_source, count(DISTINCT coalesce(lang,chr(1)))>1 AS cross_lang"
        f" FROM (SELECT *, {digest} AS digest FROM t WHERE {where}) GROUP BY digest HAVING count(*)>1"
    )


_P = "CASE WHEN contains(w,' {0} ') THEN '{1}' END"
_PATTERN = ", ".join(_P.format(" ".join(w), p) for _, p, w in PATTERNS)
_CATEGORY = ", ".join(_P.format(" ".join(w), c) for c, _, w in PATTERNS)

SQL = {
    "doc_words": _T + " SELECT doc_id, len(w) AS n_words, len(list_distinct(w)) AS n_distinct FROM t",
    "normalized_hashes": _T + " SELECT doc_id, sha256(text) AS content_sha256, sha256(array_to_string(w,' ')) AS normalized_sha256 FROM t",
    "ascii_word_counts": "SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z0-9]+(?:[-''][A-Za-z0-9]+)*')) AS n_ascii_words FROM documents WHERE text IS NOT NULL",
    "word_frequencies": _T + " SELECT word, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM (SELECT doc_id, unnest(w) AS word FROM t) GROUP BY word",
    "clusters_raw": _clusters_sql("raw", "sha256(text)", "NOT no_text"),
    "clusters_normalized": _clusters_sql("normalized", "sha256(array_to_string(w,' '))", "len(w)>0"),
    "cluster_members": _T + """, h AS (SELECT doc_id, sha256(array_to_string(w,' ')) AS h FROM t WHERE len(w)>0)
 SELECT 'normalized-'||substr(h,1,16) AS cluster_id, doc_id FROM h WHERE h IN (SELECT h FROM h GROUP BY h HAVING count(*)>1)""",
    "manifest_clusters": """SELECT normalized_sha256, count(*) AS record_count, count(DISTINCT source_family)>1 AS cross_family, count(DISTINCT role)>1 AS cross_role,
 bool_or(holdout_status='confirmatory-held-out') AND count(DISTINCT holdout_status)>1 AS crosses_holdout FROM manifest WHERE normalized_sha256 IS NOT NULL GROUP BY 1 HAVING count(*)>1""",
    "shingle_counts": _T + """ SELECT doc_id, CASE WHEN len(w)>=4 THEN len(list_distinct(list_transform(range(1,len(w)-2), lambda i: array_to_string(w[i:i+3],' ')))) WHEN len(w)>0 THEN 1 ELSE 0 END AS n_shingles,
 CASE WHEN len(w)>=10 THEN len(list_distinct(list_transform(range(1,len(w)-8), lambda i: array_to_string(w[i:i+9],' ')))) ELSE 0 END AS n_tengrams FROM t""",
    "near_pairs": _NEAR + """ SELECT p.*, l.source IS DISTINCT FROM r.source AS cross_source, l.lang IS DISTINCT FROM r.lang AS cross_lang
 FROM p JOIN t l ON l.doc_id=left_id JOIN t r ON r.doc_id=right_id""",
    "near_pair_sources": _NEAR + """ SELECT least(coalesce(l.source,'None'),coalesce(r.source,'None'))||'|'||greatest(coalesce(l.source,'None'),coalesce(r.source,'None')) AS pair, count(*) AS n
 FROM p JOIN t l ON l.doc_id=left_id JOIN t r ON r.doc_id=right_id GROUP BY 1""",
    "text_classes": _T + """, h AS (SELECT doc_id, array_to_string(w,' ') AS h FROM t WHERE len(w)>0)
 SELECT doc_id, min(doc_id) OVER (PARTITION BY h) AS class_id, count(*) OVER (PARTITION BY h) AS n_copies FROM h""",
    "evaluation_exposure": _T + f""", q0 AS (SELECT unnest(forms) AS f FROM eval_items), q1 AS (SELECT DISTINCT text, sha256(text) AS h FROM (SELECT f.prompt AS text FROM q0 UNION ALL SELECT unnest(f.candidates).text FROM q0) WHERE text IS NOT NULL),
 {folding.folded('q_f', 'q1', 'h', 'text')}, q AS (SELECT k AS item_sha256, {folding.WORDS.format('x')} AS w FROM q_f),
 dr AS (SELECT doc_id, w, CASE WHEN len(w)>=5 THEN {folding.grams('w', 5)} WHEN len(w)>0 THEN [array_to_string(w,' ')] ELSE [] END AS r FROM t WHERE NOT no_text),
 qr AS (SELECT item_sha256, w, CASE WHEN len(w)>=5 THEN {folding.grams('w', 5)} WHEN len(w)>0 THEN [array_to_string(w,' ')] ELSE [] END AS r FROM q),
 k AS (SELECT doc_id, item_sha256, count(*) AS n FROM (SELECT doc_id, unnest(r) AS x FROM dr) JOIN (SELECT item_sha256, unnest(r) AS x FROM qr) USING (x) GROUP BY 1,2),
 f AS (SELECT k.doc_id, k.item_sha256, contains(' '||array_to_string(dr.w,' ')||' ', ' '||array_to_string(qr.w,' ')||' ') AS exact_substring, n AS shared_ngrams, len(qr.r) AS evaluation_ngrams, len(dr.r) AS source_ngrams,
 round(n::DOUBLE/(len(qr.r)+len(dr.r)-n),12) AS jaccard, round(n::DOUBLE/len(qr.r),12) AS containment FROM k JOIN dr USING (doc_id) JOIN qr USING (item_sha256))
 SELECT * FROM f WHERE exact_substring OR jaccard>=0.12 OR containment>=0.25""",
    "pattern_exposure": _T + f""", p AS (SELECT doc_id, ' '||array_to_string(w,' ')||' ' AS w FROM t),
 h AS (SELECT doc_id, list_filter([{_PATTERN}], lambda x: x IS NOT NULL) AS a, list_filter([{_CATEGORY}], lambda x: x IS NOT NULL) AS c FROM p)
 SELECT doc_id, array_to_string(list_sort(a),',') AS pattern_ids, array_to_string(list_sort(list_distinct(c)),',') AS categories, len(a) AS match_count FROM h WHERE len(a)>0""",
    "resolved_manifest": f"""WITH x AS (SELECT {_PATH} AS k, doc_id, sha256(text) AS seen, octet_length(encode(text)) AS bytes FROM documents), m AS (SELECT manifest_id, {_PATH} AS k, content_sha256, content_bytes FROM manifest)
 SELECT manifest_id, doc_id, CASE WHEN doc_id IS NULL THEN 'no document' WHEN seen IS NULL THEN 'no text' WHEN content_sha256 IS NULL THEN 'no hash stated' WHEN lower(content_sha256)<>seen THEN 'hash differs'
 WHEN content_bytes IS DISTINCT FROM bytes THEN 'size differs' ELSE 'ok' END AS status FROM m LEFT JOIN x USING (k)""",
    "content_budget": "WITH " + _REC + f""" SELECT count(*) AS records, sum(octet_length(encode(text)))::BIGINT AS bytes, count(*) FILTER (octet_length(encode(text))>{MOST_RECORD_BYTES}) AS too_large, count(*) FILTER (octet_length(encode(text)) IS DISTINCT FROM content_bytes) AS size_differs,
 sum(octet_length(encode(text)))>{MOST_TOTAL_BYTES} AS over_total FROM rec""",
    "integrity_summary": _T + """ SELECT count(*) AS records, count(*) FILTER (len(w)=0) AS without_words, count(*) FILTER (len(w)<4) AS below_shingle, count(DISTINCT sha256(array_to_string(w,' '))) AS normalized_texts,
 count(DISTINCT sha256(text)) AS raw_texts, count(*) FILTER (source IS NULL) AS without_source, sum(len(w))::BIGINT AS words, max(len(w)) AS longest FROM t""",
}

SQL["audit_summary"] = SQL["evaluation_exposure"].split(" SELECT * FROM f WHERE")[0] + f""", {_REC}, x AS (SELECT * FROM f WHERE exact_substring OR jaccard>=0.12 OR containment>=0.25),
 z AS (SELECT rec.*, array_to_string(w,' ') AS h, w FROM rec JOIN t USING (doc_id)), ck AS (SELECT 'raw' AS kind, count(*) AS n, count(DISTINCT coalesce(family,chr(1)))>1 AS c FROM z GROUP BY sha256(text) HAVING count(*)>1 UNION ALL SELECT 'normalized', count(*), count(DISTINCT coalesce(family,chr(1)))>1 FROM z WHERE len(w)>0 GROUP BY h HAVING count(*)>1),
 y AS (SELECT *, CASE WHEN len(w)>=4 THEN {folding.grams('w', 4)} ELSE [h] END AS r, row_number() OVER (PARTITION BY h ORDER BY doc_id) AS copy FROM z WHERE len(w)>0), e AS (SELECT doc_id, family, holdout, len(r) AS n, unnest(r) AS g FROM y WHERE copy=1),
 c0 AS (SELECT a.doc_id AS l, b.doc_id AS r, any_value(a.n) AS an, any_value(b.n) AS bn, count(*) AS k, any_value(a.family) IS DISTINCT FROM any_value(b.family) AS cf, (coalesce(any_value(a.holdout),'')='{integrity.HELD_OUT}')<>(coalesce(any_value(b.holdout),'')='{integrity.HELD_OUT}') AS ch FROM e a JOIN e b ON a.g=b.g AND a.doc_id<b.doc_id GROUP BY 1,2),
 np AS (SELECT * FROM c0 WHERE k::DOUBLE/(an+bn-k)>=0.55), ph AS (SELECT doc_id, ' '||h||' ' AS v FROM z)
 SELECT 'record_count' AS name, count(*) AS n FROM z UNION ALL SELECT 'adaptation_record_count', count(*) FILTER (role='adaptation') FROM z UNION ALL SELECT 'evaluation_record_count', count(*) FILTER (role='evaluation') FROM z
 UNION ALL SELECT 'real_source_c_record_count', count(*) FILTER (role='adaptation' AND family='C' AND NOT synthetic) FROM z UNION ALL SELECT 'exact_raw_cluster_count', count(*) FILTER (kind='raw') FROM ck UNION ALL SELECT 'cross_source_raw_cluster_count', count(*) FILTER (kind='raw' AND c) FROM ck
 UNION ALL SELECT 'exact_normalized_cluster_count', count(*) FILTER (kind='normalized') FROM ck UNION ALL SELECT 'cross_source_normalized_cluster_count', count(*) FILTER (kind='normalized' AND c) FROM ck UNION ALL SELECT 'near_duplicate_pair_count', count(*) FROM np
 UNION ALL SELECT 'cross_source_near_pair_count', count(*) FILTER (cf) FROM np UNION ALL SELECT 'holdout_boundary_near_pair_count', count(*) FILTER (ch) FROM np UNION ALL SELECT 'evaluation_exposure_pair_count', count(*) FROM x WHERE doc_id IN (SELECT doc_id FROM z)
 UNION ALL SELECT 'direct_exposure_record_count', count(*) FROM ph WHERE {' OR '.join(f"contains(v,' {' '.join(w)} ')" for _, _, w in PATTERNS)}"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        doc_words, normalized_hashes, ascii_word_counts, word_frequencies, clusters_raw, clusters_normalized, cluster_members, manifest_clusters, shingle_counts,
        audit_summary, content_budget, near_pairs, text_classes, near_pair_sources, simhash_values, simhash_candidates, evaluation_exposure, pattern_exposure, resolved_manifest, integrity_summary,
    )
}
