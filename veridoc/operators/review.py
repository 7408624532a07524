"""Deterministic stratified samples, blinding, redaction and the access log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veridoc.runtime import materialise

# Fields that a redacted packet must not hold, and what its values must not show (in any letter case).
PRIVATE = ["metadata_locator", "content_locator", "native_timestamp", "native_item_id", "record_id", "era_window"]
SENSITIVE = r"(?i)(?:https?://|ftp://|s3://|oai:|\bPMC\d+\b|\b\d{4}\.\d{4,5}(?:v\d+)?\b|\b(?:19|20)\d{2}-\d{2}-\d{2}(?:T|\b))"


def sample_rank(seed: str, stratum: Column, record_id: Column) -> Column:
    """The hash that orders a stratum's records."""
    return F.sha2(F.concat(F.lit(seed), F.lit("\0"), stratum, F.lit("\0"), record_id), 256)


def blind_id(seed: str, record_id: Column | str) -> Column:
    c = F.col(record_id) if isinstance(record_id, str) else record_id
    return F.concat(F.lit("sample-"), F.substring(F.sha2(F.concat(F.lit("blind\0" + seed + "\0"), c), 256), 1, 20))


def stratified_sample(records: DataFrame, targets: list[tuple[str, str, str, int]], seed: str, strict: bool = True) -> DataFrame:
    """For each target ``(source, window, stratum, n)`` in turn the n records of the lowest rank not taken before.

    ``records`` has unique ``record_id``, ``source_id``, ``era_window`` and ``review_strata``.
    Targets are few; each is a top-n over a filter, and later targets exclude the ids that earlier
    ones took (a set no larger than the sample). With ``strict`` a target that cannot be filled is
    an error, as is a negative count.
    """
    spark = records.sparkSession
    taken = None
    for number, (source, window, stratum, n) in enumerate(targets):
        if n < 0:
            raise ValueError("a target count must not be negative")
        pool = records.where((F.col("source_id") == source) & (F.col("era_window") == window) & F.array_contains("review_strata", stratum))
        if taken is not None:
            pool = pool.join(taken.select("record_id"), "record_id", "left_anti")
        ranked = pool.select("record_id", sample_rank(seed, F.lit(stratum), F.col("record_id")).alias("rank"))
        chosen = ranked.orderBy("rank", "record_id").limit(n).select(F.lit(number).alias("target_no"), F.lit(stratum).alias("review_stratum"), "record_id", "rank")
        chosen = materialise(chosen, "chosen")
        if strict and chosen.count() < n:
            raise ValueError(f"too few records for {source}/{window}/{stratum}: {n} wanted")
        taken = chosen if taken is None else taken.unionByName(chosen)
    if taken is None:
        return spark.createDataFrame([], "target_no int, review_stratum string, record_id string, rank string")
    return taken


def packet_and_key(sample: DataFrame, records: DataFrame, seed: str, hide_era: bool = True) -> tuple[DataFrame, DataFrame]:
    """The blinded packet and the key that resolves it, sharing ``blind_id``."""
    joined = sample.join(records, "record_id").withColumn("blind_id", blind_id(seed, "record_id"))
    shown = ["blind_id", "source_id", "review_stratum", "categories", "version_status", "rights_status", "authorship_provenance"]
    packet = joined.select(*shown, *([] if hide_era else ["era_window", "native_timestamp"]))
    return packet, joined.select("blind_id", "record_id", "source_id", "native_item_id", "era_window", "native_timestamp")


def redact(records: DataFrame, seed: str) -> DataFrame:
    """Private fields dropped, an access id and whether access is possible added."""
    access = F.concat(F.lit("access-"), F.substring(F.sha2(F.concat(F.lit("access\0" + seed + "\0"), F.col("record_id")), 256), 1, 20))
    kept = records.withColumn("access_id", access).withColumn("access_available", F.col("content_locator").isNotNull())
    return kept.drop(*PRIVATE)


def leaks(packet: DataFrame, id_col: str) -> DataFrame:
    """Rows of a packet that show an address, an item number or a date, anywhere in their values."""
    others = [c for c in packet.columns if c != id_col]
    return packet.where(F.to_json(F.struct(*others)).rlike(SENSITIVE)).select(id_col)


def resolve_access(requests: DataFrame, access_map: DataFrame) -> DataFrame:
    """Every request with the number of records its access id resolves to; only 1 is valid."""
    counted = access_map.groupBy("access_id").agg(F.count(F.lit(1)).alias("matches"), F.min("record_id").alias("record_id"))
    out = requests.join(counted, "access_id", "left").withColumn("matches", F.coalesce("matches", F.lit(0)))
    return out.withColumn("valid", F.col("matches") == 1)


def access_events(requests: DataFrame) -> DataFrame:
    """Content-free events of ``(access_id, outcome, reason, at)`` with a hash as their id."""
    reason = F.when(F.col("outcome") == "granted", None).otherwise(F.col("reason"))
    made = requests.withColumn("reason", reason)
    return made.withColumn("event_id", F.concat(F.lit("event-"), F.substring(F.sha2(F.concat_ws("\0", "access_id", "outcome", F.coalesce("reason", F.lit("")), F.col("at").cast("string")), 256), 1, 20)))
