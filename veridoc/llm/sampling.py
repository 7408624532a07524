"""Samples with given category shares, by swap repair on counts of category signatures."""

from __future__ import annotations

import json
import math
import random

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veridoc.runtime import clean, materialise, small

#: Most rows of the target table, and most distinct signatures that the driver works on.
MAX_TARGETS, MAX_SIGNATURES = 20_000, 500_000
#: Hash buckets per (draw, signature) when records are drawn; only one of them is ranked.
BUCKETS = 4096
FEW_SIGNATURES = 20_000


def records(rows: DataFrame, id_col: str = "record_id") -> DataFrame:
    """One row per record id with canonical categories.

    Redelivered rows count once: the one received last holds. Category values lose outer spaces
    and letter case; null, empty and repeated strata disappear. Rows without an id are left out.
    """
    strata = F.array_distinct(F.array_compact(F.transform(F.coalesce("review_strata", F.array().cast("array<string>")), clean)))
    rows = rows.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("record_id"), "received_at", "meta_id", clean("source_id").alias("source_id"), clean("era_window").alias("era_window"), F.array_sort(strata).alias("strata")
    )
    last = rows.groupBy("record_id").agg(F.max(F.struct("received_at", "meta_id", "source_id", "era_window", "strata")).alias("m"))
    return last.select("record_id", "m.source_id", "m.era_window", "m.strata")


class Target:
    """One row of the target table; a null category field matches any value."""

    def __init__(self, row) -> None:
        self.draw, self.no = row["draw_id"], int(row["target_no"])
        self.fields = tuple(_clean(row[c]) for c in ("source_id", "era_window", "stratum"))
        self.share, self.size = float(row["target_share"] or 0.0), int(row["sample_size"] or 0)
        self.least = int(row["min_rows"] or 0)
        self.want = self.share * self.size

    @property
    def required(self) -> int:
        return max(self.least, math.ceil(self.want - 1e-6))


def _clean(value: str | None) -> str | None:
    return (value.strip().lower() or None) if value is not None else None


def signed(recs: DataFrame, targets: list[Target]) -> DataFrame:
    """``recs`` once per draw with ``signature``: the numbers of the draw's targets it belongs to.

    The targets that give the same of source and era are grouped by those values and met by hash joins with a
    broadcast table (bounded by MAX_TARGETS rows); strata are compared within the group.
    """
    spark = recs.sparkSession
    draws = sorted({t.draw for t in targets})
    if not draws:
        return recs.limit(0).withColumns({"draw_id": F.lit(""), "signature": F.array().cast("array<int>")})
    rows = [(*t.fields, t.draw, t.no) for t in targets]
    table = spark.createDataFrame(rows, "source_id string, era_window string, stratum string, draw_id string, target_no int")
    hit, found = recs, []
    kind = "array<struct<stratum:string,draw_id:string,target_no:int>>"
    for shape in sorted({(t.fields[0] is not None, t.fields[1] is not None) for t in targets}):
        keys = [c for c, given in zip(("source_id", "era_window"), shape) if given]
        if not keys:  # targets of any source and era: a constant
            found.append(F.from_json(F.lit(json.dumps([{"stratum": t.fields[2], "draw_id": t.draw, "target_no": t.no} for t in targets if t.fields[:2] == (None, None)])), kind))
            continue
        mine = table.where(F.col("source_id").isNotNull() == F.lit(shape[0])).where(F.col("era_window").isNotNull() == F.lit(shape[1]))
        name = f"_hits{len(found)}"
        grouped = mine.groupBy(*keys).agg(F.collect_list(F.struct("stratum", "draw_id", "target_no")).alias(name))
        hit = hit.join(F.broadcast(grouped), keys, "left")
        found.append(F.coalesce(name, F.array().cast(kind)))
    hit = hit.withColumn("hits", F.filter(F.concat(*found), lambda h: h["stratum"].isNull() | F.array_contains("strata", h["stratum"])))
    each = hit.withColumn("draw_id", F.explode(F.array(*[F.lit(x) for x in draws])))
    own = F.transform(F.filter("hits", lambda h: h["draw_id"] == F.col("draw_id")), lambda h: h["target_no"])
    return each.select(*recs.columns, "draw_id", F.array_sort(F.array_distinct(own)).alias("signature"))


def repair(counts: dict[tuple[int, ...], int], targets: list[Target], seed: int) -> dict[tuple[int, ...], int]:
    """How many records to take of each signature of one draw.

    A random sample that satisfies the floors as far as they can be satisfied is repaired: counts
    are exchanged between pairs of signatures, as many at once as lower the total deviation from
    the targets most, until no exchange lowers it. An exchange never breaks a floor that holds.
    """
    if not targets:
        return {}
    rng = random.Random(seed)
    size = min(max(t.size for t in targets), sum(counts.values()))
    signatures = sorted(counts)
    by_target = {t.no: [s for s in signatures if t.no in s] for t in targets}
    taken = dict.fromkeys(signatures, 0)
    total = 0
    have = dict.fromkeys((t.no for t in targets), 0)

    def add(s: tuple[int, ...], n: int) -> None:
        nonlocal total
        taken[s] += n
        total += n
        for no in s:
            have[no] += n

    def spread(pool: list[tuple[int, ...]], n: int) -> None:
        """Random counts from the pool in proportion to what is left there."""
        pool = [s for s in pool if counts[s] > taken[s]]
        rng.shuffle(pool)
        left = sum(counts[s] - taken[s] for s in pool)
        n = min(n, left)
        for s in pool:
            room = counts[s] - taken[s]
            mean = n * room / left
            k = min(room, n, max(n - (left - room), int(mean) + (rng.random() < mean - int(mean))))
            add(s, k)
            n, left = n - k, left - room
            if not n or not left:
                break

    for t in sorted(targets, key=lambda t: sum(counts[s] for s in by_target[t.no])):
        need = min(t.least, sum(counts[s] for s in by_target[t.no])) - have[t.no]
        spread(by_target[t.no], min(need, size - total) if need > 0 else 0)
    spread(signatures, size - total)

    return _exchange(signatures, counts, taken, targets, {t.no: min(t.least, sum(counts[s] for s in by_target[t.no])) for t in targets})


def _exchange(signatures: list[tuple[int, ...]], counts: dict, taken: dict, targets: list[Target], floors: dict[int, int]) -> dict[tuple[int, ...], int]:
    """Exchange counts between signatures, the best pair first, until no exchange lowers the deviation.

    With d the surplus of a target, taking one record out of a signature gains the sum of |d| - |d - 1| over its targets, putting one
    in that of |d| - |d + 1|; a target of both signatures does not move. Signatures are tried in the order
    of what taking out gains, and left off when even the best counterpart cannot beat the pair held, so
    a step looks at few of the pairs. The chosen pair moves as many records as keep that gain.
    """
    member = np.zeros((len(signatures), len(targets)), bool)
    place = {t.no: i for i, t in enumerate(targets)}
    for i, s in enumerate(signatures):
        member[i, [place[no] for no in s]] = True
    used = np.array([taken[s] for s in signatures], np.int64)
    room = np.array([counts[s] for s in signatures], np.int64) - used
    want = np.array([t.want for t in targets])
    floor = np.array([floors[t.no] for t in targets])
    weight = member.astype(float)
    have = used @ weight
    while True:
        d = have - want
        less, more = np.abs(d) - np.abs(d - 1), np.abs(d) - np.abs(d + 1)
        both = less + more  # never above zero: what a target of both signatures does not cost
        out_gain = np.where(used > 0, weight @ less, -np.inf)
        in_gain = np.where(room > 0, weight @ more, -np.inf)
        tight = (have - 1 < floor) & (have >= floor)
        order = np.argsort(-out_gain, kind="stable")
        kept = -(weight @ both)
        spare = kept.max(initial=0.0)
        best, pair = 1e-9, None
        top = in_gain.max(initial=-np.inf)
        for i in order.tolist():
            if out_gain[i] + top + spare <= best:
                break
            if out_gain[i] + top + kept[i] <= best:
                continue
            value = out_gain[i] + in_gain - weight @ (both * member[i])
            value[i] = -np.inf
            fixed = tight & member[i]
            if fixed.any():  # a floor that just holds: only a signature of the same target may come in
                value[~member[:, fixed].all(1)] = -np.inf
            j = int(value.argmax())
            if value[j] > best:
                best, pair = float(value[j]), (i, j)
        if pair is None:
            return {s: int(n) for s, n in zip(signatures, used.tolist()) if n}
        i, j = pair
        gone, came = member[i] & ~member[j], member[j] & ~member[i]
        limits = [used[i], room[j], *np.floor(d[gone & (d >= 1)]), *np.floor(-d[came & (d <= -1)]), *(have - floor)[gone & (have > floor)]]
        n = max(1, int(min(limits)))
        used[i], used[j], room[i], room[j] = used[i] - n, used[j] + n, room[i] + n, room[j] - n
        have = have - n * gone + n * came


def plan(recs: DataFrame, target_rows: DataFrame, seed: int = 17) -> tuple[DataFrame, DataFrame, list[Target], dict, dict]:
    """Signed records, and for each draw the counts available and the counts to take.

    Targets without a draw or a number are left out; of several rows with one draw and number
    the last in the order of their values holds.
    """
    targets = [Target(r) for r in small(target_rows, MAX_TARGETS, "sample_targets") if r["draw_id"] is not None and r["target_no"] is not None]
    targets = list({(t.draw, t.no): t for t in sorted(targets, key=lambda t: (t.draw, t.no, str(t.fields), t.share, t.least, t.size))}.values())  # repeated rows count once
    held = materialise(signed(recs, targets), "signed")
    counted = held.groupBy("draw_id", "signature").agg(F.count(F.lit(1)).alias("n"))
    counts: dict[str, dict[tuple[int, ...], int]] = {}
    for r in small(counted, MAX_SIGNATURES, "category signatures"):
        counts.setdefault(r["draw_id"], {})[tuple(r["signature"])] = r["n"]
    take = {}
    for draw in sorted({t.draw for t in targets}):
        take[draw] = repair(counts.get(draw, {}), [t for t in targets if t.draw == draw], seed)
    return held, counted, targets, counts, take


def sample(rows: DataFrame, target_rows: DataFrame, seed: int = 17) -> DataFrame:
    """``(draw_id, record_id, source_id, era_window, strata)`` of the drawn records, each draw by itself.

    Which records of a signature are drawn is decided by a seeded hash. Counts per hash bucket
    give the bucket where the wanted number is reached; records below it are taken unranked and
    only that bucket is ranked, so no group of a third of all rows is ever sorted in one task.
    A draw with fewer records than its sample size takes all. An empty table gives no rows.
    """
    held, _, _, _, take = plan(records(rows), target_rows, seed)
    spark = rows.sparkSession
    wanted = spark.createDataFrame([(d, list(s), n) for d, t in take.items() for s, n in t.items()], "draw_id string, signature array<int>, take bigint")
    few = sum(map(len, take.values())) <= FEW_SIGNATURES
    side = F.broadcast(wanted) if few else wanted
    hashed = held.join(side, ["draw_id", "signature"]).withColumn("h", F.xxhash64(F.lit(seed), "draw_id", "record_id"))
    hashed = hashed.withColumn("bucket", F.pmod("h", F.lit(BUCKETS)).cast("int"))
    cells = hashed.groupBy("draw_id", "signature", "take", "bucket").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("draw_id", "signature").orderBy("bucket")
    cells = cells.withColumn("upto", F.sum("n").over(w)).withColumn("before", F.col("upto") - F.col("n"))
    cut = cells.where((F.col("before") < F.col("take")) & (F.col("upto") >= F.col("take"))).select(
        "draw_id", "signature", F.col("bucket").alias("cut"), (F.col("take") - F.col("before")).alias("rest")
    )
    placed = hashed.join(F.broadcast(cut) if few else cut, ["draw_id", "signature"]).where("bucket <= cut")
    inner = placed.where("bucket = cut").withColumn("r", F.row_number().over(Window.partitionBy("draw_id", "signature").orderBy("h", "record_id")))
    out = ["draw_id", "record_id", "source_id", "era_window", "strata"]
    return placed.where("bucket < cut").select(*out).unionByName(inner.where("r <= rest").select(*out))


_REPORT = (
    "draw_id string, target_no int, target_share double, min_rows bigint, available bigint, required bigint, sampled bigint, sampled_share double, deviation double, met boolean, reason string"
)


def report(rows: DataFrame, target_rows: DataFrame, seed: int = 17) -> DataFrame:
    """One row for each target: what is available and required, what the repaired sample holds, and why it falls short.

    ``met`` says whether the sample reaches what is required and is at most one record off its share. Where it is
    not, ``reason`` is 'too few records' if the records of the category do not suffice, else 'other targets':
    only the floors, shares and size of the draw together stand against it. ``deviation`` is sampled less wanted.
    """
    _, _, targets, counts, take = plan(records(rows), target_rows, seed)
    out = []
    for t in targets:
        sampled = sum(n for s, n in take.get(t.draw, {}).items() if t.no in s)
        size = sum(take.get(t.draw, {}).values())
        met = sampled >= t.required and abs(sampled - t.want) <= max(1, t.required - t.want)
        available = sum(n for s, n in counts.get(t.draw, {}).items() if t.no in s)
        reason = None if met else "too few records" if available < t.required else "other targets"
        out.append((t.draw, t.no, t.share, t.least, available, t.required, sampled, sampled / size if size else 0.0, sampled - t.want, met, reason))
    return rows.sparkSession.createDataFrame(out, _REPORT)


def unmet(rows: DataFrame, target_rows: DataFrame) -> DataFrame:
    """``(draw_id, target_no)`` of the targets that no sample can meet.

    These are among the targets that the repaired sample leaves short; of those, the exact count of the category's records
    tells the ones that fail for want of records from the ones that stand against other targets.
    """
    return report(rows, target_rows).where("not met and sampled < required and reason = 'too few records'").select("draw_id", "target_no")


def summary(drawn: DataFrame, target_rows: DataFrame) -> DataFrame:
    """``(draw_id, records, distinct_records)`` of each draw of a sample."""
    names = target_rows.where(F.col("draw_id").isNotNull()).select("draw_id").distinct()
    got = drawn.groupBy("draw_id").agg(F.count(F.lit(1)).alias("records"), F.count_distinct("record_id").alias("distinct_records"))
    return names.join(got, "draw_id", "left").select("draw_id", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("records", "distinct_records")])
