"""Queries of the source adapters over small payloads, and of the markup cleaners over documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veridoc.functions import dates, markup, rights, text
from veridoc.operators import history
from veridoc.runtime import materialise, table
from veridoc.sources import payloads, rendered, samples
from veridoc.streaming import runs


def _payload(spark: SparkSession, body: str) -> DataFrame:
    return spark.createDataFrame([("https://example.org/x", body)], "url string, body string")


def wiki_revisions(spark: SparkSession, d: str) -> DataFrame:
    """S8, S9."""
    return payloads.wiki_revisions(_payload(spark, samples.WIKI), "body")


def wiki_added_spans(spark: SparkSession, d: str) -> DataFrame:
    """Added prose of each revision, its chronology, rollback and reintroduction."""
    r = payloads.wiki_revisions(_payload(spark, samples.WIKI), "body").withColumn("clean", markup.wikitext("raw_text"))
    r = materialise(r.select("page_id", "revision_id", "parent_revision_id", "at", "raw_sha256", text.tokenize("clean.text").alias("words")), "revisions")
    parent = r.select("page_id", F.col("revision_id").alias("parent_revision_id"), F.col("words").alias("old"))
    spans = r.join(parent, ["page_id", "parent_revision_id"]).withColumn("spans", markup.new_spans("old", "words")).select("page_id", "revision_id", "spans")
    order = history.chronology(r, "page_id", "revision_id", "parent_revision_id", "at")
    evidence = materialise(history.earlier_evidence(r, "page_id", "revision_id", "parent_revision_id", "at"), "evidence")
    back = history.rollbacks(r, evidence, "page_id", "revision_id", "raw_sha256").withColumn("rollback", F.lit(True))
    old = evidence.join(r.select("page_id", F.col("revision_id").alias("evidence"), "words"), ["page_id", "evidence"]).groupBy("page_id", "revision_id").agg(F.collect_list("words").alias("old"))
    j = spans.join(order, ["page_id", "revision_id"], "left").join(back, ["page_id", "revision_id"], "left").join(old, ["page_id", "revision_id"], "left")
    seen = F.coalesce(history.seen_span(F.col("spans"), F.col("old")), F.lit(False))
    return j.select("page_id", "revision_id", F.to_json("spans").alias("spans"), "chronology", F.coalesce("rollback", F.lit(False)).alias("rollback"), seen.alias("reintroduced"))


def qa_posts(spark: SparkSession, d: str) -> DataFrame:
    """S10, P44."""
    return payloads.posts(_payload(spark, samples.POSTS), "body")


def qa_replay(spark: SparkSession, d: str) -> DataFrame:
    """Per post, whether its first action is exact, and its current body against the last edit."""
    p = payloads.posts(_payload(spark, samples.POSTS), "body")
    h = payloads.post_history(_payload(spark, samples.HISTORY), "body")
    q = history.initial_action(h.join(p.where("type_id = 1").select("post_id"), "post_id", "left_semi"), "post_id", "type_id", "guid", "at", "actor", [1, 2, 3])
    a = history.initial_action(h.join(p.where("type_id = 2").select("post_id"), "post_id", "left_semi"), "post_id", "type_id", "guid", "at", "actor", [2])
    body = h.where(F.col("type_id").isin(2, 5, 8)).groupBy("post_id").agg(F.max_by("text", F.struct("at", "history_id")).alias("last"))
    now = p.join(body, "post_id").select("post_id", (markup.markdown("body")["text"] == markup.markdown("last")["text"]).alias("body_is_last_edit"))
    late = history.late_parent(p, "post_id", "parent_id", "created").select("post_id", F.lit(True).alias("parent_later"))
    return q.unionByName(a).join(now, "post_id").join(late, "post_id", "left").select("post_id", "exact", "body_is_last_edit", F.coalesce("parent_later", F.lit(False)).alias("parent_later"))


def oai_raw_records(spark: SparkSession, d: str) -> DataFrame:
    """S11, P23, P25, W1, S17."""
    b = _payload(spark, samples.OAI_RAW)
    return payloads.oai_raw(b, "body").withColumn("categories", F.array_join("categories", ","))


def oai_dublin_core(spark: SparkSession, d: str) -> DataFrame:
    """S13, P22, P26."""
    return payloads.oai_dublin_core(_payload(spark, samples.OAI_DC), "body").withColumn("identifiers", F.array_join("identifiers", ","))


def atom_entries(spark: SparkSession, d: str) -> DataFrame:
    """S12, P31."""
    return payloads.atom_feed(_payload(spark, samples.ATOM), "body").withColumn("categories", F.array_join("categories", ","))


def archive_inventory(spark: SparkSession, d: str) -> DataFrame:
    """S14, A25."""
    return payloads.archive_inventory(_payload(spark, samples.ARCHIVE), "body")


def dump_inventory(spark: SparkSession, d: str) -> DataFrame:
    """S15."""
    return payloads.dump_inventory(_payload(spark, samples.DUMP), "body", "pages-articles")


def inventory_summary(spark: SparkSession, d: str) -> DataFrame:
    """A6, A7, P45, V3."""
    return payloads.inventory_summary(payloads.dump_inventory(_payload(spark, samples.DUMP), "body", "pages-articles"))


def table_revisions(spark: SparkSession, d: str) -> DataFrame:
    """S8, S9 over pages written from all events."""
    r = payloads.wiki_revisions(rendered.wiki(table(spark, d, "events")), "body")
    return r.select(
        F.col("page_id").cast("bigint").alias("page_id"), F.col("revision_id").cast("bigint").alias("revision_id"), F.col("parent_revision_id").cast("bigint").alias("parent_revision_id"), F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("at"),
        "contributor_kind", "contributor", "minor", "comment", "raw_text", F.col("raw_bytes").cast("bigint").alias("raw_bytes"), "raw_sha256",
    )


def table_posts(spark: SparkSession, d: str) -> DataFrame:
    """S10, P44 over posts written from all orders."""
    p = payloads.posts(rendered.posts(table(spark, d, "orders")), "body")
    return p.select("post_id", "type_id", "parent_id", F.date_format("created", "yyyy-MM-dd HH:mm:ss").alias("created"), "body", "owner")


def table_late_parents(spark: SparkSession, d: str) -> DataFrame:
    """J19 over posts written from all orders: answers whose question was created after them."""
    p = materialise(payloads.posts(rendered.posts(table(spark, d, "orders")), "body").select("post_id", "parent_id", "created"), "posts")
    return history.late_parent(p, "post_id", "parent_id", "created")


def table_raw_records(spark: SparkSession, d: str) -> DataFrame:
    """S11, P23, W1 over records written from all source metadata."""
    r = payloads.oai_raw(rendered.oai_raw(table(spark, d, "source_metadata")), "body")
    return r.select(F.col("item_id").cast("bigint").alias("item_id"), "status", F.date_format("first_version", "yyyy-MM-dd HH:mm:ss").alias("first_version"), F.col("versions").cast("bigint").alias("versions"), "versions_ordered")


def table_dublin_core(spark: SparkSession, d: str) -> DataFrame:
    """S13, P22, P31 over records written from all source metadata."""
    r = payloads.oai_dublin_core(rendered.dublin_core(table(spark, d, "source_metadata")), "body")
    return r.select(
        F.col("number").cast("bigint").alias("number"), rights.article_identifier("identifiers").alias("article"), "in_open_set", F.date_format("earliest", "yyyy-MM-dd").alias("earliest"), "precision", F.col("authors").cast("bigint").alias("authors")
    )


def table_entries(spark: SparkSession, d: str) -> DataFrame:
    """S12, P31 over feeds written from all source metadata."""
    e = payloads.atom_feed(rendered.atom(table(spark, d, "source_metadata")), "body")
    return e.select("item_id", "version", *[F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in ("published", "updated")], F.col("authors").cast("bigint").alias("authors"), F.array_join("categories", ",").alias("categories"), "title_sha256")


def table_archives(spark: SparkSession, d: str) -> DataFrame:
    """S14, A25 over archive items written from the whole manifest."""
    a = payloads.archive_inventory(rendered.archive(table(spark, d, "manifest")), "body")
    return a.select("item", "file_name", "size_bytes", "md5", "sha1", F.date_format("snapshot", "yyyy-MM-dd HH:mm:ss").alias("snapshot"), F.coalesce("ok", F.lit(False)).alias("ok"))


def table_dumps(spark: SparkSession, d: str) -> DataFrame:
    """S15 over dump states written from the whole manifest."""
    return payloads.dump_inventory(rendered.dump(table(spark, d, "manifest")), "body", "pages-articles").select("job", "file_name", "size_bytes", "md5", "sha1")


def table_inventory_summary(spark: SparkSession, d: str) -> DataFrame:
    """A6, A7, P45 over the dump states."""
    return payloads.inventory_summary(payloads.dump_inventory(rendered.dump(table(spark, d, "manifest")), "body", "pages-articles"))


def table_inventory_violations(spark: SparkSession, d: str) -> DataFrame:
    """V3 over the archive items: rows without a hash or with a wrong size."""
    a = payloads.archive_inventory(rendered.archive(table(spark, d, "manifest")), "body")
    return payloads.inventory_violations(a, "file_name")


def cleaned_documents(spark: SparkSession, d: str) -> DataFrame:
    """P12-P14 over all texts: whether each reads as wikitext and as Markdown, and the words that are left."""
    t = table(spark, d, "documents").select("doc_id", markup.wikitext("text").alias("w"), markup.markdown("text").alias("m"))
    return t.select("doc_id", F.length("w.text").alias("wiki_length"), F.col("w.error").alias("wiki_error"), F.length("m.text").alias("markdown_length"), F.col("m.error").alias("markdown_error"))


def partial_dates(spark: SparkSession, d: str) -> DataFrame:
    """P22 over the native timestamps."""
    p = dates.partial_date("native_timestamp")
    return table(spark, d, "source_metadata").select(p["precision"].alias("precision")).groupBy("precision").agg(F.count(F.lit(1)).alias("n"))


def event_windows(spark: SparkSession, d: str) -> DataFrame:
    """Extension: tumbling windows over events (the same function serves the stream)."""
    w = runs.event_windows(table(spark, d, "events"))
    return w.select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n", F.round("value", 4).alias("value"))


_RAW_FIRST = "make_timestamp((1325412000 + meta_id*3600) * 1000000)"
_DUMP = """d AS (SELECT 'job'||manifest_id%10 AS job, 'wiki-pages-articles'||manifest_id AS file_name, coalesce(content_bytes,0) AS size_bytes, CASE WHEN manifest_id%2=0 THEN md5(manifest_id::VARCHAR) END AS md5, sha1(manifest_id::VARCHAR) AS sha1
 FROM manifest WHERE manifest_id%4<>0 AND (manifest_id%10)%3<>1)"""
_ARCHIVE = """a AS (SELECT 'item-'||(manifest_id//50) AS item, manifest_id||'.7z' AS file_name, coalesce(content_bytes,0) AS size_bytes, CASE WHEN manifest_id%2=0 THEN md5(manifest_id::VARCHAR) END AS md5, CASE WHEN manifest_id%6=0 THEN sha1(manifest_id::VARCHAR) END AS sha1,
 received_at FROM manifest WHERE manifest_id%7<>0 AND manifest_id%5<>0)"""
_REV = "event_type||' of <b>\"'||event_id||'\"</b> & more'"

SQL = {
    "table_revisions": f"""SELECT user_id AS page_id, event_id AS revision_id, lag(event_id) OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY event_id) AS parent_revision_id, strftime(date_trunc('second',ts),'%Y-%m-%d %H:%M:%S') AS at,
 CASE event_id%3 WHEN 0 THEN 'ip' WHEN 1 THEN 'user' ELSE 'hidden' END AS contributor_kind, CASE event_id%3 WHEN 0 THEN '192.0.2.'||event_id%250 WHEN 1 THEN 'user '||user_id END AS contributor, event_id%5=0 AS minor, event_type AS comment,
 {_REV} AS raw_text, octet_length(encode({_REV})) AS raw_bytes, sha256({_REV}) AS raw_sha256 FROM events""",
    "table_posts": """SELECT o_orderkey AS post_id, CASE WHEN o_orderkey%2=0 THEN 2 ELSE 1 END AS type_id, CASE WHEN o_orderkey%2=0 THEN o_orderkey-1 END AS parent_id, strftime(o_orderdate,'%Y-%m-%d %H:%M:%S') AS created,
 '<p>'||o_orderpriority||' & so on</p>' AS body, CASE o_orderkey%3 WHEN 0 THEN 'registered:'||o_custkey WHEN 1 THEN 'display:guest '||o_custkey ELSE 'missing' END AS owner FROM orders""",
    "table_late_parents": "SELECT a.o_orderkey AS post_id, a.o_orderkey-1 AS parent_id FROM orders a JOIN orders p ON p.o_orderkey=a.o_orderkey-1 WHERE a.o_orderkey%2=0 AND p.o_orderdate>a.o_orderdate",
    "table_raw_records": f"""SELECT meta_id AS item_id, CASE WHEN meta_id%17=0 THEN 'deleted' ELSE 'ok' END AS status, CASE WHEN meta_id%17<>0 THEN strftime(CASE WHEN meta_id%10=0 THEN {_RAW_FIRST} - INTERVAL 2 DAY ELSE {_RAW_FIRST} END,'%Y-%m-%d %H:%M:%S') END AS first_version,
 CASE WHEN meta_id%17<>0 THEN CASE WHEN meta_id%2=0 THEN 2 ELSE 1 END END::BIGINT AS versions, CASE WHEN meta_id%17<>0 THEN meta_id%10<>0 END AS versions_ordered FROM source_metadata""",
    "table_dublin_core": f"""SELECT meta_id AS number, 'PMC'||meta_id AS article, meta_id%3=0 AS in_open_set, strftime(CASE meta_id%3 WHEN 0 THEN date_trunc('year',{_RAW_FIRST}) WHEN 1 THEN date_trunc('month',{_RAW_FIRST}) ELSE {_RAW_FIRST} END,'%Y-%m-%d') AS earliest,
 CASE meta_id%3 WHEN 0 THEN 'year' WHEN 1 THEN 'month' ELSE 'day' END AS precision, meta_id%4+1 AS authors FROM source_metadata""",
    "table_entries": f"""SELECT CASE WHEN meta_id%11<>0 THEN '2203.'||lpad(meta_id::VARCHAR,5,'0') END AS item_id, CASE WHEN meta_id%11<>0 AND meta_id%3>0 THEN (meta_id%3)::INT END AS version, strftime({_RAW_FIRST},'%Y-%m-%d %H:%M:%S') AS published,
 strftime({_RAW_FIRST} + INTERVAL 1 DAY,'%Y-%m-%d %H:%M:%S') AS updated, meta_id%4+1 AS authors, CASE WHEN meta_id%2=0 THEN 't1' ELSE 't1,t2' END AS categories, sha256('On <'||record_id||'>') AS title_sha256 FROM source_metadata WHERE record_id IS NOT NULL""",
    "table_archives": f"WITH {_ARCHIVE} SELECT item, file_name, size_bytes, md5, sha1, strftime(date_trunc('second',max(received_at) OVER (PARTITION BY item)),'%Y-%m-%d %H:%M:%S') AS snapshot, size_bytes>0 AND coalesce(md5,sha1) IS NOT NULL AS ok FROM a",
    "table_dumps": f"WITH {_DUMP} SELECT * FROM d",
    "table_inventory_summary": f"WITH {_DUMP} SELECT count(*) AS files, sum(size_bytes)::BIGINT AS bytes, count(md5) AS with_md5, count(sha1) AS with_sha1, ((sum(size_bytes)*5+3)//4)::BIGINT AS with_margin FROM d",
    "table_inventory_violations": f"WITH {_ARCHIVE} SELECT file_name, 'no-hash' AS rule FROM a WHERE coalesce(md5,sha1) IS NULL UNION ALL SELECT file_name, 'size' FROM a WHERE size_bytes<0",
    # Small payloads: the rows that the formats' rules give, worked out by hand.
    "wiki_added_spans": """SELECT * FROM (VALUES ('10','102','[]','ordered',false,false), ('10','103','[["it","is","kept","in","the","old","tower"]]','ordered',false,false),
 ('20','202','[["its","wheel","turns","at","night"]]','equal-time',false,false), ('20','203','[]','ordered',true,false)) v(page_id, revision_id, spans, chronology, rollback, reintroduced)""",
    "qa_replay": "SELECT * FROM (VALUES (1::BIGINT,true,true,false), (2,true,true,false), (3,false,true,false), (4,true,true,true)) v(post_id, exact, body_is_last_edit, parent_later)",
    "event_windows": "SELECT strftime(date_trunc('hour',ts),'%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n, round(sum(value),4) AS value FROM events GROUP BY 1,2",
    "partial_dates": r"""WITH t AS (SELECT trim(native_timestamp, ' ') AS c FROM source_metadata), k AS (SELECT c, CASE WHEN regexp_full_match(c,'\d{4}') THEN 'year' WHEN regexp_full_match(c,'\d{4}-\d{2}') THEN 'month' WHEN regexp_full_match(c,'\d{4}-\d{2}-\d{2}') THEN 'day'
 WHEN regexp_full_match(c,'\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?Z') THEN 'datetime' END AS p FROM t),
 v AS (SELECT CASE WHEN p='datetime' THEN try_cast(replace(c,'T',' ') AS TIMESTAMPTZ) IS NOT NULL WHEN p IS NOT NULL THEN try_cast(c||CASE p WHEN 'year' THEN '-01-01' WHEN 'month' THEN '-01' ELSE '' END AS DATE) IS NOT NULL END AS ok, p FROM k)
 SELECT CASE WHEN ok THEN p END AS precision, count(*) AS n FROM v GROUP BY 1""",
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        table_revisions, table_posts, table_late_parents, table_raw_records, table_dublin_core, table_entries, table_archives, table_dumps, table_inventory_summary, table_inventory_violations,
        wiki_added_spans, qa_replay, cleaned_documents, partial_dates, event_windows,
    )
}
