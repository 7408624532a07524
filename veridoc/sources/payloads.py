"""Adapters: payload columns (XML or JSON text) to rows, by the JVM readers.

A payload table has any columns and one text column; each adapter keeps the others. Null and
unreadable payloads give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veridoc.functions import dates, rights

_CONTRIBUTOR = "contributor struct<username:string,ip:string,id:string>"
_REVISION = f"struct<id:string,parentid:string,timestamp:string,{_CONTRIBUTOR.replace(' ', ':', 1)},minor:string,comment:string,origin:string,model:string,format:string,text:string>"
WIKI_SCHEMA = f"page array<struct<title:string,ns:string,id:string,redirect:struct<_title:string>,revision:array<{_REVISION}>>>"
ROWS_SCHEMA = "row array<map<string,string>>"


def envelope_error(text: Column | str) -> Column:
    """Why an XML text is refused before it is parsed: byte order mark, null, document type or processing instruction."""
    c = F.col(text) if isinstance(text, str) else text
    return (
        F.when(c.isNull(), "missing").when(c.startswith("﻿"), "byte order mark").when(F.contains(c, F.lit("\0")), "null character").when(c.rlike(r"(?i)<!(DOCTYPE|ENTITY)"), "document type")
        .when(F.regexp_replace(c, r"\A<\?xml[^?]*\?>", "").contains("<?"), "processing instruction")
    )


def _elements(payloads: DataFrame, text: str, schema: str, path: str) -> DataFrame:
    parsed = payloads.where(envelope_error(text).isNull()).withColumn("_x", F.from_xml(text, schema))
    return parsed.select(*[c for c in payloads.columns if c != text], F.explode(f"_x.{path}").alias("e"))


def wiki_revisions(payloads: DataFrame, text: str) -> DataFrame:
    """One row per revision with its page, contributor kind, bytes and hashes."""
    pages = _elements(payloads, text, WIKI_SCHEMA, "page")
    keep = [c for c in pages.columns if c != "e"]
    r = pages.select(*keep, F.col("e.id").alias("page_id"), F.col("e.title").alias("title"), F.col("e.redirect._title").alias("redirect_title"), F.explode("e.revision").alias("r"))
    kind = F.when(F.col("r.contributor.ip").isNotNull(), "ip").when(F.col("r.contributor.username").isNotNull(), "user").otherwise("hidden")
    return r.select(
        *keep, "page_id", "title", "redirect_title", F.col("r.id").alias("revision_id"), F.col("r.parentid").alias("parent_revision_id"), F.try_to_timestamp("r.timestamp").alias("at"),
        kind.alias("contributor_kind"), F.coalesce("r.contributor.username", "r.contributor.ip").alias("contributor"), F.col("r.minor").isNotNull().alias("minor"), F.col("r.comment").alias("comment"),
        F.col("r.origin").alias("origin_revision_id"), F.col("r.text").alias("raw_text"), F.octet_length("r.text").alias("raw_bytes"), F.sha2("r.text", 256).alias("raw_sha256"),
    )


_POST = ["Id", "PostTypeId", "ParentId", "CreationDate", "Score", "Body", "OwnerUserId", "OwnerDisplayName", "Title", "Tags"]
_HIST = ["Id", "PostHistoryTypeId", "PostId", "RevisionGUID", "CreationDate", "UserId", "UserDisplayName", "Text"]


def _attribute_rows(payloads: DataFrame, text: str, names: list[str]) -> DataFrame:
    schema = "row array<struct<" + ",".join(f"_{n}:string" for n in names) + ">>"
    rows = _elements(payloads, text, schema, "row")
    return rows.select(*[c for c in rows.columns if c != "e"], *[F.col(f"e._{n}").alias(n) for n in names])


def _actor(user: str, shown: str) -> Column:
    """``kind:value`` of a registered, display-only or missing actor."""
    return F.when(F.col(user).isNotNull(), F.concat(F.lit("registered:"), user)).when(F.col(shown).isNotNull(), F.concat(F.lit("display:"), shown)).otherwise("missing")


def posts(payloads: DataFrame, text: str) -> DataFrame:
    """Question and answer posts with typed fields."""
    p = _attribute_rows(payloads, text, _POST)
    keep = [c for c in p.columns if c not in _POST]
    return p.select(
        *keep, F.col("Id").try_cast("bigint").alias("post_id"), F.col("PostTypeId").try_cast("int").alias("type_id"), F.col("ParentId").try_cast("bigint").alias("parent_id"),
        F.try_to_timestamp("CreationDate").alias("created"), F.col("Body").alias("body"), F.col("Title").alias("title"), F.col("Tags").alias("tags"), _actor("OwnerUserId", "OwnerDisplayName").alias("owner"),
    )


def post_history(payloads: DataFrame, text: str) -> DataFrame:
    """History rows with typed fields."""
    p = _attribute_rows(payloads, text, _HIST)
    keep = [c for c in p.columns if c not in _HIST]
    return p.select(
        *keep, F.col("Id").try_cast("bigint").alias("history_id"), F.col("PostHistoryTypeId").try_cast("int").alias("type_id"), F.col("PostId").try_cast("bigint").alias("post_id"),
        F.col("RevisionGUID").alias("guid"), F.try_to_timestamp("CreationDate").alias("at"), _actor("UserId", "UserDisplayName").alias("actor"), F.col("Text").alias("text"),
    )


_RAW = (
    "ListRecords struct<record:array<struct<header:struct<_status:string,identifier:string,datestamp:string>,metadata:struct<raw:struct<id:string,version:array<struct<_version:string,date:string>>,"
    "title:string,categories:string,license:string>>>>,resumptionToken:string>"
)


def oai_raw(payloads: DataFrame, text: str) -> DataFrame:
    """Records of the raw metadata format with their version times and licence.

    ``status`` is 'deleted', 'without-metadata' or 'ok'; ``versions_ordered`` says whether labels
    count up from v1 and every time is later than the one before.
    """
    e = _elements(payloads, text, _RAW, "ListRecords.record")
    keep = [c for c in e.columns if c != "e"]
    raw = F.col("e.metadata.raw")
    times = F.transform(raw["version"], lambda v: dates.rfc822_date(v["date"]))
    labels = F.transform(raw["version"], lambda v: v["_version"])
    n = F.size(times)
    ordered = F.forall(F.sequence(F.lit(1), n), lambda i: (F.element_at(labels, i) == F.concat(F.lit("v"), i)) & ((i == 1) | (F.element_at(times, i) > F.get(times, i - 2))))
    lic = rights.licence(raw["license"])
    return e.select(
        *keep, F.regexp_extract("e.header.identifier", r"^oai:[^:]+:(.+)$", 1).alias("item_id"),
        F.when(F.col("e.header._status") == "deleted", "deleted").when(raw.isNull(), "without-metadata").otherwise("ok").alias("status"),
        F.array_min(times).alias("first_version"), F.when(n > 0, n).alias("versions"), F.when(n > 0, F.coalesce(ordered, F.lit(False))).alias("versions_ordered"),
        F.split(raw["categories"], " ").alias("categories"), F.when(raw.isNotNull(), lic["license_id"]).alias("license_id"), F.when(raw.isNotNull(), lic["rights_status"]).alias("rights_status"),
    )


def resumption_token(payload: Column | str) -> Column:
    """The token of the next page; null at the end."""
    return F.nullif(F.regexp_extract(payload, r"<resumptionToken[^>]*>([^<]*)</resumptionToken>", 1), F.lit(""))


_DC = (
    "ListRecords struct<record:array<struct<header:struct<_status:string,identifier:string,datestamp:string,setSpec:array<string>>,metadata:struct<dc:struct<title:array<string>,creator:array<string>,"
    "subject:array<string>,date:array<string>,identifier:array<string>,rights:array<string>>>>>>"
)


def oai_dublin_core(payloads: DataFrame, text: str) -> DataFrame:
    """Multi-valued Dublin Core with the earliest date, its precision, and one licence."""
    e = _elements(payloads, text, _DC, "ListRecords.record")
    keep = [c for c in e.columns if c != "e"]
    dc = F.col("e.metadata.dc")
    first, lic = dates.earliest_date(dc["date"]), rights.licence_of_many(dc["rights"])
    return e.select(
        *keep, F.regexp_extract("e.header.identifier", r":(\d+)$", 1).alias("number"), dc["identifier"].alias("identifiers"), F.array_contains(F.col("e.header.setSpec"), "open").alias("in_open_set"),
        first["at"].alias("earliest"), first["precision"].alias("precision"), F.size(dc["creator"]).alias("authors"), lic["license_id"].alias("license_id"), lic["rights_status"].alias("rights_status"),
    )


_ATOM = (
    "totalResults int, startIndex int, itemsPerPage int, entry array<struct<id:string,published:string,updated:string,title:string,summary:string,author:array<struct<name:string>>,category:array<struct<_term:string>>>>"
)


def atom_feed(payloads: DataFrame, text: str) -> DataFrame:
    """Entries of a feed with identifier, version, times, categories and author count."""
    e = _elements(payloads, text, _ATOM, "entry")
    keep = [c for c in e.columns if c != "e"]
    ident = rights.archive_identifier("e.id")
    return e.select(
        *keep, ident["id"].alias("item_id"), ident["version"].alias("version"), dates.zoned_timestamp("e.published").alias("published"), dates.zoned_timestamp("e.updated").alias("updated"),
        F.size("e.author").alias("authors"), F.transform("e.category", lambda c: c["_term"]).alias("categories"), F.sha2("e.title", 256).alias("title_sha256"),
    )


def feed_page(payloads: DataFrame, text: str) -> DataFrame:
    """Total, start and page size of each feed."""
    return payloads.select(*[c for c in payloads.columns if c != text], F.from_xml(text, _ATOM).alias("x")).select("*", "x.totalResults", "x.startIndex", "x.itemsPerPage").drop("x")


_ITEM = "metadata map<string,string>, files array<struct<name:string,size:string,md5:string,sha1:string,mtime:string,format:string>>"


def archive_inventory(payloads: DataFrame, text: str) -> DataFrame:
    """Archives of an item (not the ones that start with __) with their size and hashes.

    ``snapshot`` is the latest change among the chosen files. Files without a positive size or
    any hash stay, marked as not ok.
    """
    keep = [c for c in payloads.columns if c != text]
    f = payloads.select(*keep, F.from_json(text, _ITEM).alias("x")).select(*keep, F.explode("x.files").alias("f"), F.col("x.metadata.identifier").alias("item"))
    f = f.where(F.col("f.name").endswith(".7z") & ~F.col("f.name").startswith("__"))
    made = f.select(*keep, "item", F.col("f.name").alias("file_name"), F.col("f.size").try_cast("bigint").alias("size_bytes"), F.col("f.md5").alias("md5"), F.col("f.sha1").alias("sha1"), F.col("f.mtime").try_cast("bigint").alias("mtime"))
    last = made.groupBy("item").agg(F.timestamp_seconds(F.max("mtime")).alias("snapshot"))
    return made.join(last, "item").withColumn("ok", (F.col("size_bytes") > 0) & F.coalesce("md5", "sha1").isNotNull())


_JOBS = "jobs map<string,struct<status:string,files:map<string,struct<size:bigint,md5:string,sha1:string,url:string>>>>"


def dump_inventory(payloads: DataFrame, text: str, fragment: str) -> DataFrame:
    """Files of finished jobs whose name holds a fragment."""
    keep = [c for c in payloads.columns if c != text]
    j = payloads.select(*keep, F.explode(F.from_json(text, _JOBS)["jobs"]).alias("job", "v")).where("v.status = 'done'")
    f = j.select(*keep, "job", F.explode("v.files").alias("file_name", "f")).where(F.col("file_name").contains(fragment))
    return f.select(*keep, "job", "file_name", F.col("f.size").alias("size_bytes"), F.col("f.md5").alias("md5"), F.col("f.sha1").alias("sha1"))


# Hexadecimal digits of each hash.
HASH_DIGITS = {"md5": 32, "sha1": 40, "sha256": 64}


def inventory_violations(inventory: DataFrame, id_col: str) -> DataFrame:
    """V3: broken rules of inventory rows with the columns size_bytes, md5 and sha1."""
    wrong = [F.when(F.col(a).isNotNull() & ~F.col(a).rlike(rf"^[0-9a-f]{{{n}}}\z"), F.lit(f"{a}-form")) for a, n in HASH_DIGITS.items() if a in inventory.columns]
    rules = F.array_compact(F.array(*wrong, F.when(F.col("size_bytes").isNull() | (F.col("size_bytes") < 0), F.lit("size")), F.when(F.coalesce("md5", "sha1").isNull(), F.lit("no-hash"))))
    return inventory.select(id_col, F.explode(rules).alias("rule"))


def inventory_summary(inventory: DataFrame) -> DataFrame:
    """Files and bytes with the size margin of a quarter, and rows that state each hash."""
    return inventory.agg(F.count(F.lit(1)).alias("files"), F.sum("size_bytes").alias("bytes"), F.count("md5").alias("with_md5"), F.count("sha1").alias("with_sha1")).withColumn("with_margin", F.expr("(bytes * 5 + 3) div 4"))
