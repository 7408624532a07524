"""Payload tables in the formats of the adapters, written from the project's tables.

Each payload holds the rows of one small group (a user's day, fifty records), so a table of n rows gives
payloads in proportion to n; parsing them again must give back the rows they were made from.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GROUP = 50


def escaped(text: Column | str) -> Column:
    """Text as it stands between XML tags or in an attribute."""
    c = F.col(text) if isinstance(text, str) else text
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def tag(name: str, value: Column, attributes: str = "") -> Column:
    return F.concat(F.lit(f"<{name}{attributes}>"), value, F.lit(f"</{name}>"))


def attribute(name: str, value: Column) -> Column:
    """`` name="value"``; nothing for null."""
    return F.coalesce(F.concat(F.lit(f' {name}="'), value, F.lit('"')), F.lit(""))


def utc(at: Column | str, form: str = "yyyy-MM-dd'T'HH:mm:ss'Z'") -> Column:
    return F.date_format(at, form)


def joined(rows: DataFrame, keys: list[str], order: str, row: str, head: Column, tail: Column) -> DataFrame:
    """``(url, body)``: the row texts of each group in order, between head and tail."""
    grouped = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order, row))).alias("rows"))
    inner = F.array_join(F.transform("rows", lambda r: r[row]), "")
    return grouped.select(F.concat_ws("/", F.lit("https://example.org"), *[F.col(k).cast("string") for k in keys]).alias("url"), F.concat(head, inner, tail).alias("body"))


def wiki(events: DataFrame) -> DataFrame:
    """Export pages: a page is a user's day, a revision an event, its parent the event before."""
    day = F.to_date("ts")
    e = events.withColumn("day", day).withColumn("parent", F.lag("event_id").over(Window.partitionBy("user_id", day).orderBy("event_id")))
    who = F.when(F.col("event_id") % 3 == 0, tag("contributor", tag("ip", F.concat(F.lit("192.0.2."), F.col("event_id") % 250)))).when(
        F.col("event_id") % 3 == 1, tag("contributor", F.concat(tag("username", F.concat(F.lit("user "), F.col("user_id"))), tag("id", F.col("user_id").cast("string"))))
    ).otherwise(F.lit("<contributor/>"))
    parent = F.coalesce(tag("parentid", F.col("parent").cast("string")), F.lit(""))
    minor = F.when(F.col("event_id") % 5 == 0, F.lit("<minor/>")).otherwise(F.lit(""))
    text = tag("text", escaped(wiki_text()))
    body = F.concat(tag("id", F.col("event_id").cast("string")), parent, tag("timestamp", utc("ts")), who, minor, tag("comment", F.col("event_type")), tag("origin", F.col("event_id").cast("string")), tag("model", F.lit("wikitext")), tag("format", F.lit("text/x-wiki")), text)
    e = e.withColumn("rev", tag("revision", body))
    head = F.concat(F.lit("<mediawiki><page><title>User "), F.col("user_id"), F.lit("</title><ns>0</ns><id>"), F.col("user_id"), F.lit("</id>"))
    return joined(e, ["user_id", "day"], "event_id", "rev", head, F.lit("</page></mediawiki>"))


def wiki_text() -> Column:
    return F.concat(F.col("event_type"), F.lit(' of <b>"'), F.col("event_id"), F.lit('"</b> & more'))


def posts(orders: DataFrame) -> DataFrame:
    """Question and answer posts: an order is a post of its customer, every second one an answer to the order before it."""
    answer = F.col("o_orderkey") % 2 == 0
    row = F.concat(
        F.lit("<row"), attribute("Id", F.col("o_orderkey").cast("string")), attribute("PostTypeId", F.when(answer, "2").otherwise("1")), attribute("ParentId", F.when(answer, (F.col("o_orderkey") - 1).cast("string"))),
        attribute("CreationDate", F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss.SSS")), attribute("Body", escaped(F.concat(F.lit("<p>"), F.col("o_orderpriority"), F.lit(" & so on</p>")))),
        attribute("OwnerUserId", F.when(F.col("o_orderkey") % 3 == 0, F.col("o_custkey").cast("string"))), attribute("OwnerDisplayName", F.when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("guest "), F.col("o_custkey")))), F.lit(" />"),
    )
    o = orders.withColumn("page", F.floor(F.col("o_orderkey") / GROUP)).withColumn("row", row)
    return joined(o, ["page"], "o_orderkey", "row", F.lit("<posts>"), F.lit("</posts>"))


def _meta(rows: DataFrame) -> DataFrame:
    return rows.withColumn("page", F.floor(F.col("meta_id") / GROUP)).withColumn("first", F.timestamp_seconds(F.lit(1325412000) + F.col("meta_id") * 3600))


def oai_raw(rows: DataFrame) -> DataFrame:
    """Harvested raw records: every 17th deleted, every second with a later version, every tenth with an earlier one."""
    stamp = "EEE, dd MMM yyyy HH:mm:ss 'GMT'"
    second = F.col("first") + F.when(F.col("meta_id") % 10 == 0, F.expr("INTERVAL -2 DAYS")).otherwise(F.expr("INTERVAL 2 DAYS"))
    version = lambda n, at: F.concat(F.lit(f'<version version="v{n}"><date>'), F.date_format(at, stamp), F.lit("</date></version>"))
    versions = F.concat(version(1, F.col("first")), F.when(F.col("meta_id") % 2 == 0, version(2, second)).otherwise(F.lit("")))
    raw = F.concat(F.lit("<metadata><raw><id>x</id>"), versions, tag("categories", F.coalesce(escaped(F.array_join("categories", " ")), F.lit(""))), F.lit("</raw></metadata>"))
    gone = F.col("meta_id") % 17 == 0
    row = F.concat(F.lit("<record><header"), attribute("status", F.when(gone, "deleted")), F.lit("><identifier>oai:example.org:"), F.col("meta_id"), F.lit("</identifier></header>"), F.when(gone, F.lit("")).otherwise(raw), F.lit("</record>"))
    return joined(_meta(rows).withColumn("row", row), ["page"], "meta_id", "row", F.lit("<OAI-PMH><ListRecords>"), F.lit("</ListRecords></OAI-PMH>"))


def dublin_core(rows: DataFrame) -> DataFrame:
    """Dublin Core records: a date as year, month or day, a later day beside it, one to four creators."""
    form = F.date_format("first", "yyyy-MM-dd")
    first = F.when(F.col("meta_id") % 3 == 0, F.substring(form, 1, 4)).when(F.col("meta_id") % 3 == 1, F.substring(form, 1, 7)).otherwise(form)
    later = F.date_format(F.col("first") + F.expr("INTERVAL 400 DAYS"), "yyyy-MM-dd")
    creators = F.array_join(F.transform(F.sequence(F.lit(1), (F.col("meta_id") % 4 + 1).cast("int")), lambda i: tag("creator", F.concat(F.lit("A. "), i))), "")
    row = F.concat(
        F.lit("<record><header><identifier>oai:example.org:"), F.col("meta_id"), F.lit("</identifier><setSpec>all</setSpec>"), F.when(F.col("meta_id") % 3 == 0, F.lit("<setSpec>open</setSpec>")).otherwise(F.lit("")),
        F.lit("</header><metadata><dc>"), creators, tag("date", later), tag("date", first), tag("identifier", F.concat(F.lit("PMC"), F.col("meta_id"))), tag("rights", F.coalesce(F.col("license_id"), F.lit("none"))), F.lit("</dc></metadata></record>"),
    )
    return joined(_meta(rows).withColumn("row", row), ["page"], "meta_id", "row", F.lit("<OAI-PMH><ListRecords>"), F.lit("</ListRecords></OAI-PMH>"))


def atom(rows: DataFrame) -> DataFrame:
    """Feed entries with and without a version in their address, and every eleventh with another address."""
    ident = F.concat(F.lit("2203."), F.lpad(F.col("meta_id").cast("string"), 5, "0"))
    version = F.when(F.col("meta_id") % 3 > 0, F.concat(F.lit("v"), F.col("meta_id") % 3)).otherwise(F.lit(""))
    address = F.when(F.col("meta_id") % 11 == 0, F.concat(F.lit("https://example.org/"), ident)).otherwise(F.concat(F.lit("http://arxiv.org/abs/"), ident, version))
    authors = F.array_join(F.transform(F.sequence(F.lit(1), (F.col("meta_id") % 4 + 1).cast("int")), lambda i: tag("author", tag("name", F.concat(F.lit("A. "), i)))), "")
    terms = F.array_join(F.transform(F.sequence(F.lit(1), (F.col("meta_id") % 2 + 1).cast("int")), lambda i: F.concat(F.lit('<category term="t'), i, F.lit('"/>'))), "")
    row = tag("entry", F.concat(tag("id", address), tag("published", utc("first")), tag("updated", utc(F.col("first") + F.expr("INTERVAL 1 DAY"))), tag("title", escaped(F.concat(F.lit("On <"), F.col("record_id"), F.lit(">")))), authors, terms))
    return joined(_meta(rows.where("record_id is not null")).withColumn("row", row), ["page"], "meta_id", "row", F.lit("<feed><totalResults>1</totalResults>"), F.lit("</feed>"))


def archive(manifest: DataFrame) -> DataFrame:
    """Archive items of fifty manifest rows: archives, index files that start with __, and other files."""
    name = F.concat(F.when(F.col("manifest_id") % 7 == 0, "__").otherwise(""), F.col("manifest_id").cast("string"), F.when(F.col("manifest_id") % 5 == 0, ".txt").otherwise(".7z"))
    file = F.struct(
        name.alias("name"), F.coalesce(F.col("content_bytes"), F.lit(0)).cast("string").alias("size"), F.when(F.col("manifest_id") % 2 == 0, F.md5(F.col("manifest_id").cast("string"))).alias("md5"),
        F.when(F.col("manifest_id") % 6 == 0, F.sha1(F.col("manifest_id").cast("string"))).alias("sha1"), F.unix_timestamp("received_at").cast("string").alias("mtime"), F.lit("7z").alias("format"),
    )
    m = manifest.withColumn("page", F.floor(F.col("manifest_id") / GROUP)).groupBy("page").agg(F.collect_list(file).alias("files"))
    meta = F.create_map(F.lit("identifier"), F.concat(F.lit("item-"), F.col("page")))
    return m.select(F.concat(F.lit("https://example.org/"), F.col("page")).alias("url"), F.to_json(F.struct(meta.alias("metadata"), "files")).alias("body"))


def dump(manifest: DataFrame) -> DataFrame:
    """Dump states of fifty manifest rows: jobs by the last digit of the id, the odd ones waiting."""
    file = F.struct(F.coalesce(F.col("content_bytes"), F.lit(0)).alias("size"), F.when(F.col("manifest_id") % 2 == 0, F.md5(F.col("manifest_id").cast("string"))).alias("md5"), F.sha1(F.col("manifest_id").cast("string")).alias("sha1"), F.lit("/d").alias("url"))
    name = F.concat(F.lit("wiki-"), F.when(F.col("manifest_id") % 4 == 0, "index").otherwise("pages-articles"), F.col("manifest_id").cast("string"))
    m = manifest.withColumns({"page": F.floor(F.col("manifest_id") / GROUP), "job": F.col("manifest_id") % 10})
    j = m.groupBy("page", "job").agg(F.map_from_entries(F.collect_list(F.struct(name, file))).alias("files"))
    state = F.struct(F.when(F.col("job") % 3 == 1, "waiting").otherwise("done").alias("status"), "files")
    jobs = j.groupBy("page").agg(F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("job"), F.col("job")), state))).alias("jobs"))
    return jobs.select(F.concat(F.lit("https://example.org/"), F.col("page")).alias("url"), F.to_json(F.struct("jobs")).alias("body"))
