"""Checks of settings and of fixed shapes; each returns all that is wrong."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veridoc.operators import rules


def integrity_settings_errors(settings: dict) -> list[str]:
    """V6: errors of the settings of an integrity audit: counts at least 1, shares within 0..1, 64 bits in whole bands."""
    errors = []
    for name in ("shingle_size", "evaluation_ngram_size", "evaluation_min_shared_ngrams", "simhash_band_count"):
        if type(settings.get(name)) is not int or settings[name] < 1:
            errors.append(f"{name} is no count")
    for name in ("near_duplicate_jaccard_threshold", "evaluation_jaccard_threshold", "evaluation_containment_threshold"):
        value = settings.get(name)
        if type(value) not in (int, float) or not 0 <= value <= 1:
            errors.append(f"{name} is no share")
    bands = settings.get("simhash_band_count")
    if settings.get("simhash_bits") != 64 or (type(bands) is int and bands > 0 and 64 % bands):
        errors.append("simhash_bits must be 64 and the bands must divide them")
    return errors


def experiment_errors(spec: dict) -> list[str]:
    """V7: errors of an experiment: three different seeds, two sources in two eras with one window per era, a control."""
    errors = []
    seeds = spec.get("seeds") or []
    if len(set(seeds)) < 3 or len(set(seeds)) < len(seeds):
        errors.append("three different seeds are needed")
    cells = [(c.get("source"), c.get("era"), c.get("window")) for c in spec.get("conditions") or [] if c.get("era")]
    if len({(s, e) for s, e, _ in cells}) < 4 or len({s for s, _, _ in cells}) < 2 or len({e for _, e, _ in cells}) < 2:
        errors.append("two sources in two eras are needed")
    for era in sorted({e for _, e, _ in cells}):
        if len({str(w) for _, e, w in cells if e == era}) > 1:
            errors.append(f"era {era} has several windows")
    if not any(c.get("control") for c in spec.get("conditions") or []):
        errors.append("a control is missing")
    return errors


def access_event_violations(events: DataFrame) -> DataFrame:
    """Events whose fields do not fit their outcome: a grant has no reason, a refusal has one."""
    granted, refused = F.col("outcome") == "granted", F.col("outcome") == "refused"
    return rules.violations(events, "event_id", {
        "outcome": rules.not_in("outcome", ["granted", "refused"]), "access-id": rules.blank("access_id"),
        "reason-with-grant": granted & F.col("reason").isNotNull(), "refusal-without-reason": refused & rules.blank("reason"),
    })


def topology_violations(items: DataFrame, forms: int, candidates: int) -> DataFrame:
    """Items whose number of forms, candidates or different (context, template) cells is not the expected one."""
    cells = F.size(F.array_distinct(F.transform("forms", lambda f: F.struct(f["context_id"].alias("c"), f["template_id"].alias("t")))))
    return rules.violations(items, "item_id", {
        "forms": F.coalesce(F.size("forms") != forms, F.lit(True)),
        "candidates": F.exists("forms", lambda f: F.coalesce(F.size(f["candidates"]) != candidates, F.lit(True))),
        "cells": cells != F.size("forms"),
    })


def same_family_waits(requests: DataFrame, group: str, order: str, family: str) -> DataFrame:
    """ST7: requests that must wait because the one before them in the group is of the same family."""
    w = Window.partitionBy(group).orderBy(order)
    return requests.withColumn("before", F.lag(family).over(w)).where(F.col("before") == F.col(family)).drop("before")


def state_hash(value: object) -> str:
    """Hash of nested plain values in which type matters (1, 1.0, True and "1" differ) and key order does not."""

    def feed(h, v: object) -> None:
        h.update(type(v).__name__.encode() + b"\0")
        if isinstance(v, dict):
            for k in sorted(v, key=lambda k: (type(k).__name__, str(k))):
                feed(h, k)
                feed(h, v[k])
        elif isinstance(v, (list, tuple)):
            for x in v:
                feed(h, x)
        else:
            h.update((v if isinstance(v, bytes) else repr(v).encode()) + b"\0")
        h.update(b"\1")

    digest = hashlib.sha256()
    feed(digest, value)
    return digest.hexdigest()
