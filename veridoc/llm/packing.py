"""Fixed-capacity containers filled from a histogram of lengths."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veridoc.runtime import BROADCAST_BYTES, materialise, small

#: Rows that one ranking group holds on average, whatever the share of a single length.
RANK_GROUP_ROWS = 65_536
#: Ranks that one row of the slot table covers where that table is joined.
SLOT_RANKS = 4096
#: Most rows of a pack specification, and the largest capacity whose histogram the driver takes.
MAX_PACKS, MAX_CAPACITY = 64, 1 << 20


def shortest_pack_first(histogram: dict[int, int], capacity: int) -> list[tuple[int, list[int]]]:
    """Packing patterns ``(count, lengths)`` for item counts by length (1..capacity).

    Lengths go longest first. A length joins the open patterns with the least content (most
    free space) as long as it fits, splitting a pattern's count where only part of it is needed;
    what is left opens patterns of its own. Every step handles a count, never single items.
    """
    spaces: list[int] = []
    open_at: dict[int, list[tuple[int, list[int]]]] = {}
    done: list[tuple[int, list[int]]] = []

    def put(count: int, lengths: list[int], space: int) -> None:
        if not space:
            done.append((count, lengths))
            return
        if space not in open_at:
            insort(spaces, space)
            open_at[space] = []
        open_at[space].append((count, lengths))

    for length in sorted((x for x, n in histogram.items() if n > 0), reverse=True):
        left = histogram[length]
        while left and spaces and spaces[-1] >= length:
            space = spaces[-1]
            count, lengths = open_at[space].pop()
            if not open_at[space]:
                del open_at[space]
                spaces.pop(bisect_left(spaces, space))
            used = min(count, left)
            if count > used:
                put(count - used, lengths, space)
            put(used, [*lengths, length], space - length)
            left -= used
        if left:
            put(left, [length], capacity - length)
    return done + [x for group in open_at.values() for x in group]


def _intervals(patterns: list[tuple[int, list[int]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Slots as rank intervals: items number lo.. of a length fill one slot of a pattern's copies.

    Arrays: a key that orders by length and lo, lo, the first container, the slot, and the copies.
    """
    taken: dict[int, int] = {}
    rows = []
    base = 0
    for count, lengths in patterns:
        for slot, length in enumerate(lengths):
            lo = taken.get(length, 0)
            rows.append((length, lo, base, slot, count))
            taken[length] = lo + count
        base += count
    rows.sort()
    a = np.array(rows, np.int64).reshape(-1, 5)
    return (a[:, 0] << 42) | a[:, 1], a[:, 1], a[:, 2], a[:, 3], a[:, 4]


def pack(sizes: DataFrame, specs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Assign every sized item to a container of each capacity.

    ``sizes`` has ``id_col`` and ``n_tokens``; ``specs`` has ``pack_id`` and ``capacity_tokens``
    (bounded: at most MAX_PACKS rows, capacities up to MAX_CAPACITY; a row with a null or
    non-positive capacity packs nothing). Result: ``(pack_id, container_id, doc_id, piece_no, first_token,
    n_tokens, slot)``. An item that fits stays whole. A longer one is cut into full containers of
    its own and a remainder that is packed like any other item. An item with a null or zero size
    has one row with a null container. Repeated ids are packed once for each row.

    The driver sees only counts by length (at most the capacity); ranks come from groups of
    (size, hash bucket), so that a size shared by a third of all rows is still split. The slots of the
    patterns are broadcast while they are small; a larger table is joined by length and range of ranks.
    """
    packs = [(r["pack_id"], r["capacity_tokens"]) for r in small(specs.select("pack_id", "capacity_tokens").distinct(), MAX_PACKS, "pack_specs")]
    packs = [(name, capacity) for name, capacity in packs if capacity is not None and capacity > 0]
    for name, capacity in packs:
        if capacity > MAX_CAPACITY:
            raise ValueError(f"pack {name}: capacity {capacity} is above {MAX_CAPACITY}")
    packs.sort(key=lambda x: (x[1], str(x[0])))
    sizes = materialise(sizes.select(F.col(id_col).alias("doc_id"), F.coalesce("n_tokens", F.lit(0)).cast("long").alias("n")), "sizes")
    rows = sizes.count()
    buckets = max(1, -(-rows // RANK_GROUP_ROWS))
    sizes = sizes.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int"))
    cells = sizes.groupBy("n", "bucket").agg(F.count(F.lit(1)).alias("c"))
    cells = materialise(
        cells.withColumn("before", F.coalesce(F.sum("c").over(Window.partitionBy("n").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))), "cells"
    )
    lengths = cells.groupBy("n").agg(F.sum("c").alias("c"))
    residual = [F.when(F.col("n") <= c, F.col("n")).otherwise(F.col("n") % F.lit(c)) for _, c in packs]
    at = lengths.select("n", "c", F.posexplode(F.array(*residual)).alias("k", "r")) if packs else None
    if at is None:
        return sizes.sparkSession.createDataFrame([], "pack_id string, container_id string, doc_id bigint, piece_no bigint, first_token bigint, n_tokens bigint, slot int")
    start = at.withColumn("o", F.coalesce(F.sum("c").over(Window.partitionBy("k", "r").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    start = start.groupBy("n").agg(F.array_sort(F.collect_list(F.struct("k", "o"))).alias("s")).select("n", F.transform("s", lambda x: x["o"]).alias("start"))
    table: list[dict[int, int]] = [{} for _ in packs]
    for row in at.groupBy("k", "r").agg(F.sum("c").alias("c")).where("r > 0").toLocalIterator():
        table[row["k"]][row["r"]] = row["c"]
    slots = [_intervals(shortest_pack_first(table[k], c)) for k, (_, c) in enumerate(packs)]
    capacities = [c for _, c in packs]

    ranked = (
        sizes.join(cells.join(start, "n").select("n", "bucket", "before", "start"), ["n", "bucket"])
        .withColumn("rank", F.row_number().over(Window.partitionBy("n", "bucket").orderBy("doc_id")) - 1 + F.col("before"))
        .select("doc_id", "n", "rank", "start")
    )

    if sum(x.nbytes for pack in slots for x in pack) > BROADCAST_BYTES:
        return _named(_joined(ranked, slots, capacities), packs)
    shared = sizes.sparkSession.sparkContext.broadcast(slots)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        for batch in batches:
            doc = batch.column(0)
            n = batch.column(1).to_numpy()
            rank = batch.column(2).to_numpy()
            begin = batch.column(3).flatten().to_numpy().reshape(len(n), len(capacities))
            for k, capacity in enumerate(capacities):
                full = np.where(n > capacity, n // capacity, 0)
                rest = n - full * capacity
                key, lo, base, slot, _ = held[k]
                mine = np.flatnonzero(rest > 0)
                order = begin[mine, k] + rank[mine]
                found = np.searchsorted(key, (rest[mine] << 42) | order, side="right") - 1
                container = base[found] + order - lo[found]
                empty = np.flatnonzero(n == 0)
                cut = np.repeat(np.arange(len(n)), full)
                piece = np.arange(len(cut)) - np.repeat(np.cumsum(full) - full, full)
                take = np.concatenate([mine, cut, empty])
                size = np.concatenate([rest[mine], np.full(len(cut), capacity), np.zeros(len(empty), np.int64)])
                number = np.concatenate([full[mine], piece, np.zeros(len(empty), np.int64)])
                shares = np.concatenate([container, np.full(len(cut) + len(empty), -1)])
                place_in = np.concatenate([slot[found], np.zeros(len(cut) + len(empty), np.int64)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(take), k, np.int32)), pa.array(shares), doc.take(pa.array(take)), pa.array(number), pa.array(number * capacity), pa.array(size), pa.array(place_in.astype(np.int32))],
                    names=["k", "shared", "doc_id", "piece_no", "first_token", "n_tokens", "slot"],
                )

    kind = dict(sizes.dtypes)["doc_id"]
    placed = ranked.mapInArrow(place, f"k int, shared bigint, doc_id {kind}, piece_no bigint, first_token bigint, n_tokens bigint, slot int")
    return _named(placed, packs)


def _named(placed: DataFrame, packs: list[tuple[str, int]]) -> DataFrame:
    names = F.array(*[F.lit(name) for name, _ in packs])
    return placed.select(
        F.element_at(names, F.col("k") + 1).alias("pack_id"),
        F.when(F.col("n_tokens") == 0, None)
        .when(F.col("shared") >= 0, F.concat(F.lit("s-"), F.col("shared")))
        .otherwise(F.concat(F.lit("f-"), F.col("doc_id"), F.lit("-"), F.col("piece_no")))
        .alias("container_id"),
        "doc_id", "piece_no", "first_token", "n_tokens", "slot",
    )


def _joined(ranked: DataFrame, slots: list[tuple[np.ndarray, ...]], capacities: list[int]) -> DataFrame:
    """The placement where the slot table is too large to broadcast: an equi-join by pack, length and range of ranks."""
    spark = ranked.sparkSession
    rows = []
    for k, (key, lo, base, slot, count) in enumerate(slots):
        rows.append(pa.table({"k": np.full(len(key), k, np.int32), "rest": key >> 42, "lo": lo, "hi": lo + count, "base": base, "slot": slot.astype(np.int32)}))
    table = spark.createDataFrame(pa.concat_tables(rows)).withColumn("part", F.explode(F.sequence((F.col("lo") / SLOT_RANKS).cast("bigint"), ((F.col("hi") - 1) / SLOT_RANKS).cast("bigint"))))
    each = ranked.select("doc_id", "n", "rank", F.posexplode("start").alias("k", "begin"))
    capacity = F.element_at(F.array(*[F.lit(c).cast("bigint") for c in capacities]), F.col("k") + 1)
    each = each.withColumn("c", capacity).withColumn("full", F.when(F.col("n") > F.col("c"), (F.col("n") / F.col("c")).cast("bigint")).otherwise(F.lit(0)))
    each = each.withColumns({"rest": F.col("n") - F.col("full") * F.col("c"), "order": F.col("begin") + F.col("rank")})
    each = each.withColumn("part", (F.col("order") / SLOT_RANKS).cast("bigint"))
    met = each.join(table, ["k", "rest", "part"]).where("rest > 0 and order >= lo and order < hi")
    whole = met.select("k", (F.col("base") + F.col("order") - F.col("lo")).alias("shared"), "doc_id", F.col("full").alias("piece_no"), (F.col("full") * F.col("c")).alias("first_token"), F.col("rest").alias("n_tokens"), "slot")
    cut = each.where("full > 0").withColumn("piece_no", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("full") - 1)))
    cut = cut.select("k", F.lit(-1).cast("bigint").alias("shared"), "doc_id", "piece_no", (F.col("piece_no") * F.col("c")).alias("first_token"), F.col("c").alias("n_tokens"), F.lit(0).alias("slot"))
    zero = F.lit(0).cast("bigint")
    empty = each.where("n = 0").select("k", F.lit(-1).cast("bigint").alias("shared"), "doc_id", zero.alias("piece_no"), zero.alias("first_token"), zero.alias("n_tokens"), F.lit(0).alias("slot"))
    return whole.unionByName(cut).unionByName(empty)


def coverage(packed: DataFrame, sizes: DataFrame, specs: DataFrame) -> DataFrame:
    """``(pack_id, items, placed, misplaced, overfull)`` per pack: the items of ``sizes``, those that came out at all, those whose pieces do
    not add up to their size, and the containers above the capacity."""
    items = sizes.select("doc_id", F.coalesce("n_tokens", F.lit(0)).alias("size"))
    total = items.count()
    pieces = packed.groupBy("pack_id", "doc_id").agg(F.sum("n_tokens").alias("n"))
    met = pieces.join(items, "doc_id").groupBy("pack_id").agg(F.count(F.lit(1)).alias("placed"), F.count_if(F.col("n") != F.col("size")).alias("misplaced"))
    full = packed.where("container_id is not null").groupBy("pack_id", "container_id").agg(F.sum("n_tokens").alias("fill")).join(specs.select("pack_id", "capacity_tokens"), "pack_id")
    over = full.groupBy("pack_id").agg(F.count_if(F.col("fill") > F.col("capacity_tokens")).alias("overfull"))
    return met.join(over, "pack_id", "left").select("pack_id", F.lit(total).cast("bigint").alias("items"), "placed", "misplaced", F.coalesce("overfull", F.lit(0)).cast("bigint").alias("overfull"))


def packing_report(packed: DataFrame, specs: DataFrame) -> DataFrame:
    """Per pack: containers, tokens, share of capacity used, fewest possible containers."""
    totals = packed.groupBy("pack_id").agg(
        F.sum("n_tokens").alias("tokens"), F.count_if(F.col("n_tokens") > 0).alias("items"),
        F.sum(F.when(F.col("container_id").isNotNull() & (F.col("slot") == 0), 1).otherwise(0)).alias("containers"),
    )
    return totals.join(specs, "pack_id").select(
        "pack_id", "capacity_tokens", "items", "tokens", "containers",
        F.ceil(F.col("tokens") / F.col("capacity_tokens")).alias("least_containers"),
        (F.col("tokens") / (F.col("containers") * F.col("capacity_tokens"))).alias("used_share"),
    )
