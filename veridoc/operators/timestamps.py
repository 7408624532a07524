"""Mixed timestamp notations and zones, brought to one UTC instant.

Every value is expanded to the array of all its valid readings (notation, instant, cost). Where a
value has several, a Viterbi pass over each source's record order picks one: it pays for a switch
of the source's date format, which is carried on through records that do not show it, and for a jump
backwards in time.

The pass is exact and distributed. Records are range-partitioned by (source, order), so a source
with a third of all rows spreads over many chunks. Each chunk is first reduced to a min-plus
matrix from its first record's readings to its last record's; the matrices of a source (one per
chunk) are chained; then each chunk is decoded with its end states fixed.
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Iterator
from functools import lru_cache
from zoneinfo import ZoneInfo

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veridoc.runtime import clean, materialise, small

#: Costs of the Viterbi pass.
SWITCH_COST, BACKWARD_COST, BACKWARD_DAY_COST = 1.0, 0.5, 0.001
#: Cost of the later of the two instants of a wall-clock time that a zone had twice: it decides between equal paths only.
LATER_FOLD_COST = 1e-6
MAX_REGISTRY = 100_000
#: Rows of one chunk of a source's run: what one task of the passes holds at once.
CHUNK_ROWS = 200_000
#: Instants (UTC microseconds) between which a bare count is read as seconds, milliseconds or microseconds.
COUNT_WINDOW = (631_152_000_000_000, 4_102_444_800_000_000)

# Offsets in minutes of the usual American and European zone abbreviations.
ABBREVIATIONS = {
    "UTC": 0, "GMT": 0, "Z": 0, "WET": 0, "WEST": 60, "BST": 60, "IST": 60, "CET": 60, "CEST": 120, "MET": 60, "MEST": 120,
    "EET": 120, "EEST": 180, "MSK": 180, "MSD": 240, "NST": -210, "NDT": -150, "AST": -240, "ADT": -180, "EST": -300, "EDT": -240,
    "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420, "AKST": -540, "AKDT": -480, "HST": -600, "HDT": -540,
}
MONTHS = {m: i for i, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split(), 1)}
DAYS = "mon tue wed thu fri sat sun".split()

_TIME = r"(?P<h>\d{1,2}):(?P<mi>\d{2})(?::(?P<s>\d{2})(?:[.,](?P<f>\d{1,9}))?)?\s*(?P<ap>[AaPp]\.?\s?[Mm](?:\.|\b))?"
_ZONE = r"\s*(?P<z>.*)"
_SEP = r"(?:[T\s]\s*|,\s*|\s+at\s+)"
_NOTATIONS = [
    ("iso", re.compile(rf"(?P<y>\d{{4}})-(?P<mo>\d{{1,2}})-(?P<d>\d{{1,2}}){_SEP}{_TIME}{_ZONE}", re.I)),
    ("week", re.compile(rf"(?P<y>\d{{4}})-?W(?P<w>\d{{2}})-?(?P<wd>[1-7]){_SEP}{_TIME}{_ZONE}", re.I)),
    ("ordinal", re.compile(rf"(?P<y>\d{{4}})-(?P<doy>\d{{3}}){_SEP}{_TIME}{_ZONE}", re.I)),
    ("basic", re.compile(r"(?P<y>\d{4})(?P<mo>\d\d)(?P<d>\d\d)T?(?P<h>\d\d)(?P<mi>\d\d)(?P<s>\d\d)?(?:[.,](?P<f>\d{1,9}))?(?P<ap>)" + _ZONE, re.I)),
    ("numeric", re.compile(rf"(?P<a>\d{{1,4}})(?P<sep>[/.\-])(?P<b>\d{{1,2}})(?P=sep)(?P<c>\d{{1,4}}){_SEP}{_TIME}{_ZONE}", re.I)),
    ("day-first", re.compile(rf"(?:(?P<dow>[A-Za-z]{{3,9}})\.?,?\s+)?(?P<d>\d{{1,2}})[\s-](?P<mon>[A-Za-z]{{3,9}})\.?[\s,-]+(?P<y>\d{{4}}){_SEP}{_TIME}{_ZONE}", re.I)),
    ("month-first", re.compile(rf"(?:(?P<dow>[A-Za-z]{{3,9}})\.?,?\s+)?(?P<mon>[A-Za-z]{{3,9}})\.?\s+(?P<d>\d{{1,2}}),?\s+(?P<y>\d{{4}}){_SEP}{_TIME}{_ZONE}", re.I)),
]
_OFFSET = re.compile(r"(?:UTC|GMT)?\s*([+\-−])(\d{1,2})(?::?(\d{2}))?", re.I)
_SEMANTIC_ZONE = re.compile(r"(?:;\s*zone\s*=\s*|@\s*|\()\s*([^)\s]+)\s*\)?\s*$", re.I)
_EPOCH = dt.datetime(1970, 1, 1)
_CANONICAL = re.compile(r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z")


@lru_cache(maxsize=4096)
def zone_of(name: str) -> int | ZoneInfo | None:
    """A zone as a fixed offset in minutes or as rules; None if the name is not a zone."""
    name = name.strip()
    if (m := _OFFSET.fullmatch(name)) is not None:
        minutes = int(m[2]) * 60 + int(m[3] or 0)
        return (minutes if m[1] == "+" else -minutes) if minutes <= 18 * 60 and int(m[3] or 0) < 60 else None
    if name.upper() in ABBREVIATIONS:
        return ABBREVIATIONS[name.upper()]
    if "/" not in name:
        return None
    try:
        return ZoneInfo(name)
    except (KeyError, ValueError, OSError):
        try:
            return ZoneInfo("/".join("_".join(w.capitalize() for w in re.split("[_ ]", p)) for p in name.split("/")))
        except (KeyError, ValueError, OSError):
            return None


@lru_cache(maxsize=200_000)
def _offsets(zone: str, wall: dt.datetime) -> tuple[int, ...]:
    """Offsets in seconds under which a wall-clock minute exists: none in a gap, two in a fold."""
    rules = ZoneInfo(zone)
    out = []
    for fold in (0, 1):
        there = wall.replace(tzinfo=rules, fold=fold)
        offset = there.utcoffset()
        back = (wall - offset).replace(tzinfo=dt.timezone.utc).astimezone(rules)
        if back.replace(tzinfo=None) == wall and offset not in out:
            out.append(offset)
    return tuple(int(x.total_seconds()) for x in out)


def _split_zone(text: str) -> tuple[bool, list]:
    """Zones written after a time: (readable, [stated offset or zone ...]), an offset first."""
    text = text.strip()
    if not text:
        return True, []
    found = []
    for part in re.findall(r"\[[^\]]*\]|\([^)]*\)|[^\s\[(]+", text):
        zone = zone_of(part.strip("[]() "))
        if zone is None:
            return False, []
        found.append(zone)
    return True, sorted(found, key=lambda z: not isinstance(z, int))


def _month(name: str) -> int | None:
    return MONTHS.get(name[:3].lower())


def readings(value: str | None, semantics: str | None, native_zone: str | None, order: str | None) -> list[tuple[str, int, float]]:
    """All valid readings ``(notation, UTC microseconds, cost)`` of one value.

    None, blank and unreadable values, impossible dates and times, values without a time of day
    and wall-clock times without any zone have none. A wall-clock time that its zone skipped has
    none, one that it had twice has two. An all-numeric date that does not start with the year
    and a hyphen has one reading per possible order, or one only where ``order`` is declared.
    """
    if value is None or not (v := value.strip()):
        return []
    if re.fullmatch(r"[+-]?\d{9,17}(?:\.\d+)?", v) and not (re.fullmatch(r"\d{12}|\d{14}", v) and _calendar(v)):
        return _counts(v)
    for notation, pattern in _NOTATIONS:
        if (m := pattern.fullmatch(v)) is None:
            continue
        g = m.groupdict()
        readable, zones = _split_zone(g["z"])
        if not readable:
            continue
        hour, minute, second = int(g["h"]), int(g["mi"]), int(g["s"] or 0)
        if g["ap"]:
            if not 1 <= hour <= 12:
                return []
            hour = hour % 12 + 12 * (g["ap"][0] in "pP")
        micro = int((g["f"] or "0")[:6].ljust(6, "0"))
        dates = _dates(notation, g, order)
        out = []
        for label, day in dates:
            try:
                wall = dt.datetime(day.year, day.month, day.day, hour, minute, second, micro)
            except ValueError:
                continue
            out += [(label, at, cost) for at, cost in _instants(wall, zones, semantics, native_zone)]
        return out
    return []


def _counts(v: str) -> list[tuple[str, int, float]]:
    """Readings of a bare count: every scale that puts it into COUNT_WINDOW, else the scale that its digits suggest."""
    whole, _, part = v.partition(".")
    sign = -1 if whole.startswith("-") else 1
    scaled = [int(whole) * scale + sign * int(float("0." + (part or "0")) * scale + 0.5) for scale in (1_000_000, 1_000, 1)]
    inside = [x for x in scaled if COUNT_WINDOW[0] <= x < COUNT_WINDOW[1]]
    digits = len(whole.lstrip("+-"))
    return [("count", x, 0.0) for x in inside or [scaled[0 if digits <= 11 else 1 if digits <= 14 else 2]]]


def _calendar(digits: str) -> bool:
    try:
        dt.datetime.strptime(digits, "%Y%m%d%H%M%S" if len(digits) == 14 else "%Y%m%d%H%M")
    except ValueError:
        return len(digits) == 14
    return 1000 <= int(digits[:4]) <= 2999


def _dates(notation: str, g: dict, order: str | None) -> list[tuple[str, dt.date]]:
    try:
        if notation == "week":
            return [(notation, dt.date.fromisocalendar(int(g["y"]), int(g["w"]), int(g["wd"])))]
        if notation == "ordinal":
            day = dt.date(int(g["y"]), 1, 1) + dt.timedelta(int(g["doy"]) - 1)
            return [(notation, day)] if day.year == int(g["y"]) and g["doy"] != "000" else []
        if notation == "numeric":
            out = []
            for kind, (y, mo, d) in {"dmy": "cba", "mdy": "cab", "ymd": "abc"}.items():
                if (order in (None, kind)) and len(g[y]) == 4 and len(g[mo]) <= 2 and len(g[d]) <= 2:
                    try:
                        out.append((f"numeric-{kind}", dt.date(int(g[y]), int(g[mo]), int(g[d]))))
                    except ValueError:
                        pass
            return out
        if notation in ("day-first", "month-first"):
            month = _month(g["mon"])
            if month is None or (g["dow"] and g["dow"][:3].lower() not in DAYS):
                return []
            day = dt.date(int(g["y"]), month, int(g["d"]))
            return [(notation, day)] if not g["dow"] or DAYS[day.weekday()] == g["dow"][:3].lower() else []
        return [(notation, dt.date(int(g["y"]), int(g["mo"]), int(g["d"])))]
    except ValueError:
        return []


def _instants(wall: dt.datetime, zones: list, semantics: str | None, native_zone: str | None) -> list[tuple[int, float]]:
    micros = (wall - _EPOCH) // dt.timedelta(microseconds=1)
    zone = zones[0] if zones else None
    if zone is None and semantics and (m := _SEMANTIC_ZONE.search(semantics.strip())):
        zone = zone_of(m[1])
    if zone is None and native_zone:
        zone = zone_of(native_zone)
    if zone is None:
        return []
    if isinstance(zone, int):
        return [(micros - zone * 60_000_000, 0.0)]
    offsets = _offsets(zone.key, wall.replace(second=0, microsecond=0))
    return [(micros - off * 1_000_000, LATER_FOLD_COST * i) for i, off in enumerate(offsets)]


# -- Viterbi ----------------------------------------------------------------------------------


def _step(cost: np.ndarray, f0: list, t0: np.ndarray, f1: list, t1: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One min-plus step. ``cost`` may have leading axes; returns costs and the chosen predecessors."""
    change = np.array([[SWITCH_COST * (a != b) for b in f1] for a in f0])
    back = np.maximum(t0[:, None] - t1[None, :], 0) / 86_400e6
    move = change + np.where(back > 0, BACKWARD_COST + BACKWARD_DAY_COST * back, 0.0)
    total = cost[..., :, None] + move
    best = total.argmin(-2)
    return np.take_along_axis(total, best[..., None, :], -2)[..., 0, :] + own, best


def decode(rows: list[tuple[list, np.ndarray, np.ndarray]], first: int | None = None, last: int | None = None) -> list[int]:
    """Cheapest reading of every row of one run; ``first`` and ``last`` fix the end states."""
    f, t, own = rows[0]
    cost = own.copy() if first is None else np.where(np.arange(len(f)) == first, own, np.inf)
    backs = []
    for (f0, t0, _), (f1, t1, o1) in zip(rows, rows[1:]):
        if len(f0) == 1 and len(f1) == 1:
            cost, best = np.zeros(1), np.zeros(1, int)
        else:
            cost, best = _step(cost, f0, t0, f1, t1, o1)
        backs.append(best)
    state = int(cost.argmin()) if last is None else last
    path = [state]
    for best in reversed(backs):
        path.append(int(best[path[-1]]))
    return path[::-1]


def chain(matrices: list[tuple[list, np.ndarray, list, np.ndarray, np.ndarray]]) -> list[tuple[int, int]]:
    """End states of each chunk, from (first notations, first times, last notations, last times, matrix)."""
    cost = matrices[0][4].min(0)
    back: list[tuple[np.ndarray, np.ndarray | None]] = [(matrices[0][4].argmin(0), None)]
    for (_, _, f0, t0, _), (f1, t1, _, _, inner) in zip(matrices, matrices[1:]):
        enter, best = _step(cost, f0, t0, f1, t1, np.zeros(len(f1)))
        total = enter[:, None] + inner
        back.append((total.argmin(0), best))
        cost = total.min(0)
    state = int(cost.argmin())
    out = []
    for entry, best in reversed(back):
        first = int(entry[state])
        out.append((first, state))
        if best is not None:
            state = int(best[first])
    return out[::-1]


_READ = "row_key bigint, source string, rec_order bigint, value string, notations array<string>, instants array<bigint>, costs array<double>"


def normalise(
    rows: DataFrame, registry: DataFrame, id_col: str = "meta_id", order_col: str = "meta_id", value_col: str = "native_timestamp",
    semantics_col: str = "timestamp_semantics", source_col: str = "source_id", chunks: int | None = None,
) -> DataFrame:
    """``(id_col, utc_ts, n_readings, notation, status)`` of every row.

    ``status`` is 'stated' (one valid reading), 'inferred' (several, chosen by the Viterbi pass)
    or 'undetermined' (none: ``utc_ts`` is null). A null source, value or semantics is allowed;
    rows without a source form one run. Ties in the order column fall back on the id; repeated
    rows stay. Empty input gives an empty result; further columns are ignored.
    """
    spark = rows.sparkSession
    known = {}
    for r in small(registry.select(clean("source_id").alias("s"), "native_zone", "date_order"), MAX_REGISTRY, "source_registry"):
        known[r["s"]] = (r["native_zone"], r["date_order"])
    shared = spark.sparkContext.broadcast(known)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sources = shared.value
        for b in batches:
            held = {key: readings(key[0], key[1], *sources.get(key[2], (None, None))) for key in set(zip(b["value"], b["semantics"], b["source"]))}
            found = [held[key] for key in zip(b["value"], b["semantics"], b["source"])]
            yield pd.DataFrame({
                "row_key": b["row_key"], "source": b["source"], "rec_order": b["rec_order"], "value": b["value"],
                "notations": [[x[0] for x in f] for f in found], "instants": [[x[1] for x in f] for f in found], "costs": [[x[2] for x in f] for f in found],
            })

    taken = rows.select(
        F.col(id_col).cast("long").alias("row_key"), clean(source_col).alias("source"), F.col(order_col).cast("long").alias("rec_order"),
        F.col(value_col).cast("string").alias("value"), F.col(semantics_col).cast("string").alias("semantics"),
    )
    parts = chunks or max(2, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // CHUNK_ROWS))
    taken = taken.withColumn("source", F.coalesce("source", F.lit("")))
    # Ordered before the values are read: the range partitioning samples its input, which then is a plain scan.
    ordered = taken.repartitionByRange(parts, "source", "rec_order", "row_key").sortWithinPartitions("source", "rec_order", "row_key")
    ordered = ordered.mapInPandas(read, _READ)
    ordered = materialise(ordered.withColumn("chunk", F.spark_partition_id()).withColumn("pos", F.monotonically_increasing_id()), "readings")

    # Only rows with a choice need the passes, and only sources that hold such rows.
    timed = ordered.where(F.size("instants") > 0)
    plural = ordered.where(F.size("instants") > 1).groupBy("chunk", "source").agg(F.max(F.size(F.array_distinct("notations")) > 1).alias("orders"))
    plural = materialise(plural, "plural")
    if plural.limit(1).count():
        chosen = _viterbi(timed, plural)
        joined = ordered.join(chosen, "pos", "left")
    else:
        joined = ordered.withColumn("choice", F.lit(None).cast("int"))
    pick = F.coalesce(F.col("choice"), F.lit(0))
    instant = F.when(F.size("instants") > 0, F.get("instants", pick))
    return joined.select(
        F.col("row_key").alias(id_col),
        F.date_format(F.timestamp_micros(instant), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("utc_ts"),
        F.size("instants").alias("n_readings"),
        F.when(F.size("instants") > 0, F.get("notations", pick)).alias("notation"),
        F.when(F.size("instants") == 1, "stated").when(F.size("instants") > 1, "inferred").otherwise("undetermined").alias("status"),
        "value",
    )


_ORDERS = ["numeric-dmy", "numeric-mdy", "numeric-ymd"]


def _states(pdf: pd.DataFrame) -> tuple[list[tuple[list, np.ndarray, np.ndarray]], list[list[int]]]:
    """The rows of a run as states ``(formats, times, costs)``, and the reading that each state stands for.

    The format of a state is the date order that the source writes at that place. A row whose
    readings say nothing about it carries every order on, so a numeric date is compared with the
    last numeric date before it and not with the row before it. Where no row of a source is open in its
    order there is one format.
    """
    rows, which = [], []
    for notations, instants, costs, orders in zip(pdf["notations"], pdf["instants"], pdf["costs"], pdf["orders"]):
        made = [(k, i) for i, n in enumerate(notations) for k in ([""] if not orders else [n] if n in _ORDERS else _ORDERS)]
        at = [i for _, i in made]
        rows.append(([k for k, _ in made], np.asarray(instants, np.int64)[at], np.asarray(costs, float)[at]))
        which.append(at)
    return rows, which


def _deciding(pdf: pd.DataFrame) -> pd.DataFrame:
    """The rows of a run that bear on a choice: those with several readings, their neighbours, both ends,
    and, where orders are open, the first and last numeric date of each stretch of one order.

    Any other row costs the same on every path and can be left out.
    """
    pdf = pdf.sort_values("pos")
    plural = pdf["notations"].map(len).to_numpy() > 1
    keep = plural.copy()
    keep[1:] |= plural[:-1]
    keep[:-1] |= plural[1:]
    keep[[0, -1]] = True
    if pdf["orders"].iloc[0]:
        label = np.array([_ORDERS.index(n[0]) if len(n) == 1 and n[0] in _ORDERS else 3 + (len(n) > 1) for n in pdf["notations"]])
        at = np.flatnonzero(label != 3)
        if len(at):
            change = np.flatnonzero(label[at][1:] != label[at][:-1])
            keep[at[[0, -1]]] = True
            keep[at[change]] = True
            keep[at[change + 1]] = True
    return pdf[keep]


def _viterbi(timed: DataFrame, plural: DataFrame) -> DataFrame:
    """``(pos, choice)`` of the rows with several readings."""
    touched = plural.groupBy("source").agg(F.max("orders").alias("orders"))

    def summarise(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        run, _ = _states(_deciding(pdf))
        n = len(run[0][0])
        cost = np.where(np.eye(n, dtype=bool), run[0][2][None, :], np.inf)
        for (f0, t0, _), (f1, t1, own) in zip(run, run[1:]):
            if len(f0) > 1 or len(f1) > 1:
                cost, _ = _step(cost, f0, t0, f1, t1, own)
        return pd.DataFrame({
            "chunk": [key[0]], "source": [key[1]], "f0": [run[0][0]], "t0": [run[0][1].tolist()],
            "f1": [run[-1][0]], "t1": [run[-1][1].tolist()], "m": [cost.ravel().tolist()],
        })

    # One row for each source with a choice: few beside the rows, joined without a broadcast hint.
    mine = timed.join(touched, "source")
    matrices = mine.groupBy("chunk", "source").applyInPandas(
        summarise, "chunk int, source string, f0 array<string>, t0 array<bigint>, f1 array<string>, t1 array<bigint>, m array<double>"
    )

    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("chunk")
        steps = [
            (list(r.f0), np.asarray(r.t0), list(r.f1), np.asarray(r.t1), np.asarray(r.m, float).reshape(len(r.f0), len(r.f1)))
            for r in pdf.itertuples()
        ]
        ends = chain(steps)
        return pd.DataFrame({"chunk": pdf["chunk"], "source": pdf["source"], "first": [e[0] for e in ends], "last": [e[1] for e in ends]})

    # A source has one small matrix for each chunk it spans, never more than there are chunks.
    ends = materialise(matrices.groupBy("source").applyInPandas(link, "chunk int, source string, first int, last int"), "ends")

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = _deciding(pdf)
        run, which = _states(pdf)
        path = decode(run, int(pdf["first"].iloc[0]), int(pdf["last"].iloc[0]))
        keep = pdf["notations"].map(len) > 1
        return pd.DataFrame({"pos": pdf["pos"], "choice": [w[k] for w, k in zip(which, path)]})[keep]

    return mine.join(ends, ["chunk", "source"]).join(plural, ["chunk", "source"], "left_semi").groupBy("chunk", "source").applyInPandas(settle, "pos bigint, choice int")


def stated_instants(normalised: DataFrame, id_col: str = "meta_id") -> DataFrame:
    """``(id_col, utc_ts)`` of the rows that state exactly one instant in another form than ``YYYY-MM-DDTHH:MM:SSZ``."""
    return normalised.where((F.col("status") == "stated") & ~F.col("value").rlike("^" + _CANONICAL.pattern + r"\z")).select(id_col, "utc_ts")
