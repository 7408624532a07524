"""Ordered histories: lineage of revisions, evidence before a change, replay of edits, hash chains."""

from __future__ import annotations

import bisect

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veridoc.runtime import materialise


def monotone_violations(rows: DataFrame, group: list[str], order: list[str], value: str, strict: bool = True) -> DataFrame:
    """Rows whose value does not exceed (or falls below, if not strict) the one before them in their group."""
    w = Window.partitionBy(*group).orderBy(*order)
    bad = F.col(value) <= F.col("before") if strict else F.col(value) < F.col("before")
    return rows.withColumn("before", F.lag(value).over(w)).where(bad)


def chain_violations(rows: DataFrame, group: str, sequence: str, previous: str, own: str) -> DataFrame:
    """Breaks of a hash chain: a gap in the sequence, or a stated previous hash that is not the row before's.

    The first row has sequence 0 and no previous hash. All breaks come out, with their rule.
    """
    w = Window.partitionBy(group).orderBy(sequence)
    made = rows.withColumns({"_n": F.row_number().over(w) - 1, "_p": F.lag(own).over(w)})
    rules = F.array_compact(F.array(F.when(F.col(sequence) != F.col("_n"), "sequence"), F.when(~F.col(previous).eqNullSafe(F.col("_p")), "previous-hash")))
    return made.select(group, sequence, F.explode(rules).alias("rule"))


# Event types of a run with the state before and after.
TRANSITIONS = {
    "create": (None, "design"), "freeze": ("design", "frozen"), "start": ("frozen", "running"), "progress": ("running", "running"),
    "recover": ("running", "running"), "complete": ("running", "complete"), "fail": ("running", "failed"), "resume": ("failed", "running"),
}


def state_violations(events: DataFrame, group: str, sequence: str, kind: str) -> DataFrame:
    """ST1 in batch form: events whose type is unknown or does not follow the state that the event before left."""
    required = F.create_map(*[x for k, (before, _) in TRANSITIONS.items() for x in (F.lit(k), F.lit(before or ""))])
    after = F.create_map(*[x for k, (_, then) in TRANSITIONS.items() for x in (F.lit(k), F.lit(then))])
    w = Window.partitionBy(group).orderBy(sequence)
    made = events.withColumn("state", F.coalesce(F.lag(F.element_at(after, F.col(kind))).over(w), F.lit("")))
    rule = F.when(F.element_at(required, F.col(kind)).isNull(), "unknown-type").when(F.element_at(required, F.col(kind)) != F.col("state"), "illegal-transition")
    return made.select(group, sequence, kind, rule.alias("rule")).where("rule is not null")


def parent_violations(revisions: DataFrame, page: str, revision: str, parent: str) -> DataFrame:
    """Revisions whose parent is not a revision of the same page."""
    known = revisions.select(F.col(page).alias("_p"), F.col(revision).alias("_r"))
    child = revisions.where(F.col(parent).isNotNull())
    return child.join(known, (child[page] == known["_p"]) & (child[parent] == known["_r"]), "left_anti").select(page, revision, parent)


def ancestors(revisions: DataFrame, page: str, revision: str, parent: str, most_rounds: int = 40) -> DataFrame:
    """``(page, revision, ancestor, distance)`` of all ancestor pairs, by doubling.

    Each round joins the pairs known so far with those of the greatest distance, which is a power of
    two, so chains of length n take log2(n) rounds and each pair is built once; every round's new
    pairs are written out. A revision that is its own ancestor means a cycle: an error.
    """
    edges = revisions.where(F.col(parent).isNotNull()).select(F.col(page).alias("p"), F.col(revision).alias("r"), F.col(parent).alias("a"), F.lit(1).cast("bigint").alias("n"))
    closed = materialise(edges.distinct(), "ancestors")
    for k in range(most_rounds):
        last = closed.where(F.col("n") == 2**k).select(F.col("p"), F.col("r").alias("a"), F.col("a").alias("b"), F.col("n").alias("m"))
        grown = closed.join(last, ["p", "a"]).select("p", "r", F.col("b").alias("a"), (F.col("n") + F.col("m")).alias("n"))
        grown = materialise(grown.distinct(), "ancestors")
        if grown.where("r = a").limit(1).count():
            raise ValueError("the parent graph holds a cycle")
        if not grown.limit(1).count():
            least = closed.groupBy("p", "r", "a").agg(F.min("n").alias("n"))
            return least.select(F.col("p").alias(page), F.col("r").alias(revision), F.col("a").alias("ancestor"), F.col("n").alias("distance"))
        closed = closed.unionByName(grown)
    raise RuntimeError("ancestor chains are longer than the rounds allow")


def chronology(revisions: DataFrame, page: str, revision: str, parent: str, at: str) -> DataFrame:
    """Per revision with a parent: 'inversion' if an ancestor is later, 'equal-time' if one is as late, else 'ordered'."""
    lines = ancestors(revisions, page, revision, parent)
    times = revisions.select(F.col(page).alias("p"), F.col(revision).alias("x"), F.col(at).alias("t"))
    own = lines.join(times.withColumnsRenamed({"p": page, "x": revision, "t": "mine"}), [page, revision])
    both = own.join(times.withColumnsRenamed({"p": page, "x": "ancestor", "t": "theirs"}), [page, "ancestor"])
    rank = F.max(F.when(F.col("theirs") > F.col("mine"), 2).when(F.col("theirs") == F.col("mine"), 1).otherwise(0))
    g = both.groupBy(page, revision).agg(rank.alias("k"))
    return g.select(page, revision, F.when(F.col("k") == 2, "inversion").when(F.col("k") == 1, "equal-time").otherwise("ordered").alias("chronology"))


def earlier_evidence(revisions: DataFrame, page: str, revision: str, parent: str, at: str) -> DataFrame:
    """For each revision with a parent, the revisions that count as earlier evidence.

    These are its ancestors above the parent, and the earlier revisions of the page that are neither
    itself, its parent nor its descendants.
    """
    lines = materialise(ancestors(revisions, page, revision, parent), "lines")
    child = revisions.where(F.col(parent).isNotNull()).select(F.col(page).alias("p"), F.col(revision).alias("r"), F.col(parent).alias("a"), F.col(at).alias("t"))
    above = lines.where("distance > 1").select(F.col(page).alias("p"), F.col(revision).alias("r"), F.col("ancestor").alias("e"))
    other = revisions.select(F.col(page).alias("p"), F.col(revision).alias("e"), F.col(at).alias("te"))
    before = child.join(other, "p").where((F.col("te") < F.col("t")) & (F.col("e") != F.col("r")) & (F.col("e") != F.col("a"))).select("p", "r", "e")
    below = lines.select(F.col(page).alias("p"), F.col(revision).alias("e"), F.col("ancestor").alias("r"))
    found = above.unionByName(before.join(below, ["p", "r", "e"], "left_anti")).distinct()
    return found.select(F.col("p").alias(page), F.col("r").alias(revision), F.col("e").alias("evidence"))


def rollbacks(revisions: DataFrame, evidence: DataFrame, page: str, revision: str, digest: str) -> DataFrame:
    """Revisions whose content equals that of an evidence revision."""
    d = revisions.select(page, revision, F.col(digest).alias("own"))
    e = revisions.select(page, F.col(revision).alias("evidence"), F.col(digest).alias("old"))
    return evidence.join(d, [page, revision]).join(e, [page, "evidence"]).where("own = old").select(page, revision).distinct()


class _Sums:
    """Counts by place, added up over the places before one (a Fenwick tree)."""

    def __init__(self, size: int) -> None:
        self.held = [0] * (size + 1)

    def add(self, place: int, value: int) -> None:
        place += 1
        while place < len(self.held):
            self.held[place] += value
            place += place & -place

    def before(self, place: int) -> int:
        total = 0
        while place:
            total += self.held[place]
            place -= place & -place
        return total


def _walk(ids: list, parents: list) -> tuple[list[int], list[int], list[int], list[int]]:
    """``(up, steps, enter, end)`` of one page: the row of each parent (-1: none known), a walk over the
    trees that enters row i as i and leaves it as ~i, and the numbers of each row's subtree in that walk."""
    at = {r: i for i, r in enumerate(ids)}
    if len(at) < len(ids):
        raise ValueError("a revision stands twice in the history of its page")
    up = [-1 if p is None else at.get(p, -1) for p in parents]
    below: list[list[int]] = [[] for _ in ids]
    for i, u in enumerate(up):
        if u >= 0:
            below[u].append(i)
    steps, enter, end, number = [], [0] * len(ids), [0] * len(ids), 0
    stack = [i for i, u in enumerate(up) if u < 0]
    while stack:
        i = stack.pop()
        steps.append(i)
        if i < 0:
            end[~i] = number
            continue
        enter[i] = number
        number += 1
        stack.append(~i)
        stack += below[i]
    if number < len(ids):
        raise ValueError("the parent graph holds a cycle")
    return up, steps, enter, end


def _evidence_counts(labels: list, times: list, up: list[int], steps: list[int], enter: list[int], end: list[int]) -> list[int]:
    """For each row the number of evidence rows with its label (null: none).

    Earlier rows of the page, less those of its line above and below, more its line above the parent.
    """
    timed: dict[object, list[int]] = {}
    for i, x in enumerate(labels):
        if x is not None and times[i] is not None:
            timed.setdefault(x, []).append(i)
    n, place, first, start = [0] * len(labels), {}, {}, {}
    for rows in timed.values():
        rows.sort(key=lambda i: times[i])
        base = len(place)
        numbers = sorted(enter[i] for i in rows)
        seen, lo = _Sums(len(rows)), 0
        for k, i in enumerate(rows):
            if times[i] != times[rows[lo]]:
                for j in rows[lo:k]:
                    seen.add(bisect.bisect_left(numbers, enter[j]), 1)
                lo = k
            place[i], first[i], start[i] = base + k, base + lo, base
            n[i] = lo - seen.before(bisect.bisect_left(numbers, end[i])) + seen.before(bisect.bisect_left(numbers, enter[i]))
    line, above = _Sums(len(place)), dict.fromkeys(labels, 0)
    for i in steps:
        row, step = (i, 1) if i >= 0 else (~i, -1)
        x = labels[row]
        if step > 0 and x is not None:
            n[row] += above[x] - (up[row] >= 0 and labels[up[row]] == x)
            if row in place:
                n[row] -= line.before(first[row]) - line.before(start[row])
        above[x] += step
        if row in place:
            line.add(place[row], step)
    return n


def lineage(revisions: DataFrame, page: str, revision: str, parent: str, at: str, digest: str) -> DataFrame:
    """``(page, revision, chronology, n_evidence, rollback)`` of each revision with a parent.

    The answers of ``chronology``, ``earlier_evidence`` (how many) and ``rollbacks`` over histories of any
    length: a page is walked once in one task, n log n steps for n revisions, and no pairs of
    revisions are built. ``chronology`` is null where no ancestor is in the page's history. A
    revision that stands twice in a page and a cycle of parents are errors.
    """
    kinds = revisions.select(page, revision).schema
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kinds) + ", chronology string, n_evidence bigint, rollback boolean"

    def walk(rows: pa.Table) -> pa.Table:
        ids, parents, times, digests = (rows.column(c).to_pylist() for c in (revision, parent, at, digest))
        up, steps, enter, end = tree = _walk(ids, parents)
        evidence, same = _evidence_counts([True] * len(ids), times, *tree), _evidence_counts(digests, times, *tree)
        latest, order = [None] * len(ids), [None] * len(ids)
        for i in steps:
            u = up[i] if i >= 0 else -1
            if u < 0:
                continue
            latest[i] = max((t for t in (times[u], latest[u]) if t is not None), default=None)
            known = latest[i] is not None and times[i] is not None
            order[i] = "inversion" if known and latest[i] > times[i] else "equal-time" if known and latest[i] == times[i] else "ordered"
        # A line whose oldest revision names a parent outside the history has that parent as an ancestor too.
        outside = [False] * len(ids)
        for i in steps:
            if i >= 0:
                outside[i] = outside[up[i]] if up[i] >= 0 else parents[i] is not None
        take = [i for i, p in enumerate(parents) if p is not None]
        counts = [evidence[i] + (outside[i] and up[i] >= 0) for i in take]
        columns = [rows.column(page).take(pa.array(take, pa.int64())), rows.column(revision).take(pa.array(take, pa.int64()))]
        columns += [pa.array([order[i] for i in take], pa.string()), pa.array(counts, pa.int64()), pa.array([same[i] > 0 for i in take], pa.bool_())]
        return pa.Table.from_arrays(columns, names=[page, revision, "chronology", "n_evidence", "rollback"])

    known = revisions.where(F.col(page).isNotNull() & F.col(revision).isNotNull())
    return known.select(page, revision, parent, at, digest).groupBy(page).applyInArrow(walk, schema)


def latest_before(events: DataFrame, times: DataFrame, key: str, at: str, event_at: str, tie: str) -> DataFrame:
    """As-of join: for each row of ``times`` the key's last event at or before its time.

    Both sides are laid into one ordered stream per key and the last event is carried forward, so
    no pairs are built; rows without an earlier event keep nulls. Ties go to the larger ``tie``.
    """
    left = times.select(F.col(key).alias("k"), F.col(at).alias("t"), F.lit(1).alias("side"), F.struct(*times.columns).alias("row"), F.lit(None).cast(dict(events.dtypes)[tie]).alias("e"), F.lit(None).cast("timestamp").alias("et"))
    right = events.select(F.col(key).alias("k"), F.col(event_at).alias("t"), F.lit(0).alias("side"), F.lit(None).cast(left.schema["row"].dataType).alias("row"), F.col(tie).alias("e"), F.col(event_at).cast("timestamp").alias("et"))
    w = Window.partitionBy("k").orderBy("t", "side", "e").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carried = left.unionByName(right).withColumns({"last": F.last("e", ignorenulls=True).over(w), "last_at": F.last("et", ignorenulls=True).over(w)})
    return carried.where("side = 1").select("row.*", F.col("last").alias(f"last_{tie}"), F.col("last_at").alias("last_at"))


def initial_action(history: DataFrame, post: str, kind: str, guid: str, at: str, actor: str, required: list[int]) -> DataFrame:
    """Posts whose first action has exactly the required types under one guid, time and actor."""
    first = history.groupBy(post).agg(F.min(at).alias("_first"))
    h = history.join(first, post)
    g = h.where(F.col(kind).isin(required)).groupBy(post).agg(
        F.array_sort(F.collect_list(kind)).alias("kinds"), F.count_distinct(guid).alias("guids"), F.count_distinct(at).alias("times"), F.count_distinct(F.coalesce(actor, F.lit("\0"))).alias("actors"),
        (F.min(at) == F.first("_first")).alias("is_first"),
    )
    good = (F.col("kinds") == F.array(*map(F.lit, sorted(required)))) & (F.col("guids") == 1) & (F.col("times") == 1) & (F.col("actors") == 1) & F.col("is_first")
    return g.select(post, good.alias("exact"))


def ambiguous_times(history: DataFrame, group: str, at: str, guid: str) -> DataFrame:
    """Times at which one group has several guids."""
    g = history.groupBy(group, at).agg(F.count_distinct(guid).alias("n"))
    return g.where("n > 1")


def reused_guids(history: DataFrame, group: str, at: str, guid: str) -> DataFrame:
    """Guids that stand for more than one (group, time)."""
    return history.groupBy(guid).agg(F.count_distinct(F.struct(group, at)).alias("n")).where("n > 1")


def ordered_actions(history: DataFrame, group: str, at: str, kind: str, tie: str) -> DataFrame:
    """The kinds of a group's actions in order of time, as one text."""
    g = history.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(at, tie, kind))).alias("a"))
    return g.select(group, F.array_join(F.transform("a", lambda x: x[kind].cast("string")), ">").alias("actions"))


def late_parent(posts: DataFrame, post: str, parent: str, created: str) -> DataFrame:
    """Answers whose parent exists but was created after them."""
    p = posts.select(F.col(post).alias("_q"), F.col(created).alias("_c"))
    a = posts.where(F.col(parent).isNotNull())
    return a.join(p, a[parent] == p["_q"]).where(F.col("_c") > F.col(created)).select(post, parent)


def seen_span(spans: Column, histories: Column) -> Column:
    """Whether any added span (array of words) stands in any earlier text (array of words)."""
    line = lambda t: F.concat(F.lit(" "), F.array_join(t, " "), F.lit(" "))
    return F.exists(spans, lambda s: (F.size(s) > 0) & F.exists(histories, lambda h: F.contains(line(h), line(s))))
