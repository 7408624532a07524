"""Queries of ordered histories over events and orders, and over a small history of revisions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veridoc.operators import history
from veridoc.runtime import table


def _revisions(spark: SparkSession, d: str) -> DataFrame:
    """Events as revisions: the page is the user, the parent the event of the same user and type before."""
    w = Window.partitionBy("user_id", "event_type").orderBy("event_id")
    return table(spark, d, "events").select("user_id", "event_id", "ts", F.lag("event_id").over(w).alias("parent_id"), F.md5(F.concat_ws("|", "event_type", F.floor("value").cast("string"))).alias("digest"))


def event_time_steps_back(spark: SparkSession, d: str) -> DataFrame:
    """Events in the order of their ids whose time, set back by a day for every 40th, falls below the one before."""
    e = table(spark, d, "events").withColumn("ts", F.when(F.col("event_id") % 40 == 0, F.col("ts") - F.expr("INTERVAL 1 DAY")).otherwise(F.col("ts")))
    return history.monotone_violations(e, ["user_id"], ["event_id"], "ts", strict=False).select("user_id", "event_id")


def event_chain_breaks(spark: SparkSession, d: str) -> DataFrame:
    """The events of each user as a hash chain in which every 500th link states another hash and every 700th is numbered wrongly."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    e = table(spark, d, "events").select("user_id", "event_id", F.md5(F.col("event_id").cast("string")).alias("own"))
    e = e.withColumns({"n": F.row_number().over(w) - 1, "previous": F.lag("own").over(w)})
    e = e.withColumns({"sequence": F.when(F.col("event_id") % 700 == 0, F.col("n") + 100000).otherwise(F.col("n")), "previous": F.when(F.col("event_id") % 500 == 0, F.md5(F.lit("x"))).otherwise(F.col("previous"))})
    return history.chain_violations(e.withColumn("sequence", F.col("sequence").cast("bigint")), "user_id", "sequence", "previous", "own")


def run_state_breaks(spark: SparkSession, d: str) -> DataFrame:
    """ST1: events read as run events."""
    kinds = list(history.TRANSITIONS)
    kind = F.element_at(F.array(*map(F.lit, kinds)), (F.pmod(F.floor("value").cast("int"), F.lit(len(kinds))) + 1))
    return history.state_violations(table(spark, d, "events").select("user_id", "event_id", kind.alias("kind")), "user_id", "event_id", "kind")


def foreign_parents(spark: SparkSession, d: str) -> DataFrame:
    """Revisions shifted by one page keep no parent of their own page."""
    r = _revisions(spark, d).withColumn("user_id", F.when(F.col("event_id") % 50 == 0, F.col("user_id") + 1).otherwise(F.col("user_id")))
    return history.parent_violations(r, "user_id", "event_id", "parent_id")


def _whole(spark: SparkSession, d: str) -> DataFrame:
    """Events as revisions whose parent is the event of the same user before, over the whole history."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    return table(spark, d, "events").select("user_id", "event_id", "ts", F.lag("event_id").over(w).alias("parent_id"), F.md5(F.concat_ws("|", "event_type", (F.col("value") / 50).cast("int").cast("string"))).alias("digest"))


def ancestor_pairs(spark: SparkSession, d: str) -> DataFrame:
    """J13."""
    return history.ancestors(_whole(spark, d), "user_id", "event_id", "parent_id")


def _lineage(spark: SparkSession, d: str) -> DataFrame:
    return history.lineage(_whole(spark, d), "user_id", "event_id", "parent_id", "ts", "digest")


def revision_chronology(spark: SparkSession, d: str) -> DataFrame:
    """W4."""
    return _lineage(spark, d).where("chronology is not null").select("user_id", "event_id", "chronology")


def earlier_evidence(spark: SparkSession, d: str) -> DataFrame:
    """The number of evidence revisions of each revision."""
    return _lineage(spark, d).where("n_evidence > 0").select("user_id", "event_id", F.col("n_evidence").alias("n"))


def rollback_signals(spark: SparkSession, d: str) -> DataFrame:
    """J15."""
    return _lineage(spark, d).where("rollback").select("user_id", "event_id")


def latest_event_before_order(spark: SparkSession, d: str) -> DataFrame:
    """J18."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("user_id"), "o_orderkey", F.col("o_orderdate").cast("timestamp").alias("o_orderdate"))
    shifted = table(spark, d, "events").select("user_id", F.timestamp_seconds((F.col("event_id") % 2500) * 86400 + 694224000).alias("at"), "event_id")
    return history.latest_before(shifted, o, "user_id", "o_orderdate", "at", "event_id").select("o_orderkey", "last_event_id")


def same_time_ambiguity(spark: SparkSession, d: str) -> DataFrame:
    """Hours in which a user has several event types."""
    e = table(spark, d, "events").withColumn("hour", F.date_trunc("hour", "ts"))
    return history.ambiguous_times(e, "user_id", "hour", "event_type").select("user_id", F.date_format("hour", "yyyy-MM-dd HH").alias("hour"), "n")


def reused_identities(spark: SparkSession, d: str) -> DataFrame:
    """Value-and-type pairs that stand for several (user, day)."""
    e = table(spark, d, "events").select("user_id", F.to_date("ts").alias("day"), F.concat_ws("|", "event_type", F.floor("value").cast("string")).alias("guid"))
    return history.reused_guids(e, "user_id", "day", "guid")


def ordered_actions(spark: SparkSession, d: str) -> DataFrame:
    """W7."""
    return history.ordered_actions(table(spark, d, "events"), "user_id", "ts", "event_type", "event_id")


_WHOLE = "r AS (SELECT user_id, event_id, ts, lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS parent_id, md5(event_type||'|'||CAST(trunc(value/50) AS INT)::VARCHAR) AS digest FROM events)"
_ANC = "WITH RECURSIVE " + _WHOLE + ", a AS (SELECT user_id, event_id, parent_id AS ancestor, 1 AS distance FROM r WHERE parent_id IS NOT NULL UNION ALL SELECT a.user_id, a.event_id, r.parent_id, a.distance+1 FROM a JOIN r ON r.user_id=a.user_id AND r.event_id=a.ancestor WHERE r.parent_id IS NOT NULL)"
_EVID = _ANC + """, e AS (SELECT user_id, event_id, ancestor AS evidence FROM a WHERE distance>1 UNION SELECT c.user_id, c.event_id, o.event_id FROM r c JOIN r o ON o.user_id=c.user_id AND o.ts<c.ts AND o.event_id<>c.event_id AND o.event_id<>c.parent_id
 WHERE c.parent_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM a WHERE a.user_id=c.user_id AND a.event_id=o.event_id AND a.ancestor=c.event_id))"""
_KINDS = list(history.TRANSITIONS)
_REQ = "CASE kind " + " ".join(f"WHEN '{k}' THEN '{b or ''}'" for k, (b, _) in history.TRANSITIONS.items()) + " END"
_AFT = "CASE kind " + " ".join(f"WHEN '{k}' THEN '{a}'" for k, (_, a) in history.TRANSITIONS.items()) + " END"

SQL = {
    "event_time_steps_back": "WITH e AS (SELECT user_id, event_id, ts - CASE WHEN event_id%40=0 THEN INTERVAL 1 DAY ELSE INTERVAL 0 DAY END AS ts FROM events) SELECT user_id, event_id FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM e) WHERE ts<b",
    "event_chain_breaks": """WITH e AS (SELECT user_id, event_id, md5(event_id::VARCHAR) AS own, row_number() OVER (PARTITION BY user_id ORDER BY event_id)-1 AS n, lag(md5(event_id::VARCHAR)) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events),
 f AS (SELECT user_id, own, CASE WHEN event_id%700=0 THEN n+100000 ELSE n END AS sequence, CASE WHEN event_id%500=0 THEN md5('x') ELSE p END AS previous FROM e),
 g AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY sequence)-1 AS n, lag(own) OVER (PARTITION BY user_id ORDER BY sequence) AS p FROM f)
 SELECT user_id, sequence, 'sequence' AS rule FROM g WHERE sequence<>n UNION ALL SELECT user_id, sequence, 'previous-hash' FROM g WHERE previous IS DISTINCT FROM p""",
    "run_state_breaks": f"""WITH k AS (SELECT user_id, event_id, {_KINDS}[(((floor(value)::INT % {len(_KINDS)}) + {len(_KINDS)}) % {len(_KINDS)}) + 1] AS kind FROM events),
 s AS (SELECT *, coalesce(lag({_AFT}) OVER (PARTITION BY user_id ORDER BY event_id),'') AS state, {_REQ} AS need FROM k) SELECT user_id, event_id, kind, 'illegal-transition' AS rule FROM s WHERE need<>state""",
    "foreign_parents": """WITH r0 AS (SELECT user_id, event_id, lag(event_id) OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS parent_id FROM events), r AS (SELECT CASE WHEN event_id%50=0 THEN user_id+1 ELSE user_id END AS user_id, event_id, parent_id FROM r0)
 SELECT * FROM r c WHERE parent_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM r p WHERE p.user_id=c.user_id AND p.event_id=c.parent_id)""",
    "ancestor_pairs": _ANC + " SELECT user_id, event_id, ancestor, distance FROM a",
    "revision_chronology": _ANC + """ SELECT a.user_id, a.event_id, CASE max(CASE WHEN p.ts>c.ts THEN 2 WHEN p.ts=c.ts THEN 1 ELSE 0 END) WHEN 2 THEN 'inversion' WHEN 1 THEN 'equal-time' ELSE 'ordered' END AS chronology
 FROM a JOIN r c ON c.event_id=a.event_id JOIN r p ON p.event_id=a.ancestor GROUP BY 1,2""",
    "earlier_evidence": _EVID + " SELECT user_id, event_id, count(*) AS n FROM e GROUP BY 1,2",
    "rollback_signals": _EVID + " SELECT DISTINCT e.user_id, e.event_id FROM e JOIN r c ON c.event_id=e.event_id JOIN r o ON o.event_id=e.evidence WHERE c.digest=o.digest",
    "latest_event_before_order": """WITH s AS (SELECT user_id, to_timestamp((event_id%2500)*86400+694224000) AT TIME ZONE 'UTC' AS at_, event_id FROM events)
 SELECT o_orderkey, (SELECT max_by(event_id, (at_, event_id)) FROM s WHERE s.user_id=o.o_custkey AND s.at_<=CAST(o.o_orderdate AS TIMESTAMP)) AS last_event_id FROM orders o""",
    "same_time_ambiguity": "SELECT user_id, strftime(date_trunc('hour',ts),'%Y-%m-%d %H') AS hour, count(DISTINCT event_type) AS n FROM events GROUP BY 1,2 HAVING count(DISTINCT event_type)>1",
    "reused_identities": "SELECT event_type||'|'||floor(value)::BIGINT::VARCHAR AS guid, count(DISTINCT (user_id, CAST(ts AS DATE))) AS n FROM events GROUP BY 1 HAVING count(DISTINCT (user_id, CAST(ts AS DATE)))>1",
    "ordered_actions": "SELECT user_id, string_agg(event_type,'>' ORDER BY ts, event_id) AS actions FROM events GROUP BY 1",
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        event_time_steps_back, event_chain_breaks, run_state_breaks, foreign_parents, ancestor_pairs, revision_chronology, earlier_evidence, rollback_signals, latest_event_before_order,
        same_time_ambiguity, reused_identities, ordered_actions,
    )
}
