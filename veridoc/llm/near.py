"""Near-duplicate texts: DartMinHash signatures, banded join, exact verification.

The element weights of a text are 1 for each of its distinct word runs, but the dart throwing
works for any weights. Darts for an element fall into the plane weight x rank, region by region;
their number, place and rank are functions of the element and the region only, so texts sharing an
element share its darts. A text keeps the darts below its weights and below a rank limit chosen so
that about k (ln k + 2) darts remain whatever its size, and the lowest-ranked dart per coordinate
is its signature. Sparse and dense texts cost the same.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veridoc.functions.text import WordHasher, mix, run_hashes
from veridoc.llm.copies import canonical_digests
from veridoc.operators import integrity
from veridoc.runtime import BROADCAST_BYTES, materialise, salted_join

#: Bands and rows per band: a pair of similarity 0.55 is missed with probability below 0.003, one of 0.7 below 1e-7.
BANDS, ROWS = 64, 4
RUN, SIMILARITY = 5, 0.8
#: Rows of one class that go to one task when pairs of classes are written out as pairs of rows.
ROWS_PER_SHARE = 20_000
#: A band key of more texts than this builds no pairs; its texts are searched by their rarest runs instead.
BAND_TEXTS = 64
#: Pairs of one text that go to one task when they meet its runs.
PAIRS_PER_SHARE = 20_000
CHUNK_CHARS = 1 << 20

_CELLS = [0.0, 0.125, 0.25, 0.5, 1.0, 2.0, 4.0, 8.0]  # rank limits of the first regions; the others are 8 wide
_WIDE = 8.0


def _edges(limit: float) -> list[float]:
    edges = list(_CELLS)
    while edges[-1] < limit:
        edges.append(edges[-1] + _WIDE)
    return edges


def _poisson_table(mean: float) -> np.ndarray:
    """Cumulative probabilities of a Poisson number up to where they reach 1 in 53 bits."""
    p, total, out = math.exp(-mean), 0.0, []
    n = 0
    while total < 1 - 2**-50 and n < 200:
        total += p
        out.append(total)
        n += 1
        p *= mean / n
    return np.array(out)


_TABLES = {w: _poisson_table(w) for w in (0.125, 0.25, 0.5, 1.0, 2.0, 4.0, 8.0)}
_UNIT = 2.0**-53


def _uniform(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(11)).astype(np.float64) * _UNIT


def signatures(sets: list[np.ndarray], k: int, weights: list[np.ndarray] | None = None) -> np.ndarray:
    """A ``len(sets) x k`` array of 32-bit dart identities; sets are arrays of 64-bit element hashes.

    Two sets agree in a coordinate with a probability of about their (weighted) Jaccard
    similarity. An empty set has a row of zeros.
    """
    n_sets = len(sets)
    best = np.full(n_sets * k, np.iinfo(np.uint64).max, np.uint64)
    darts = k * (math.log(k) + 2)
    total = np.array([len(s) if weights is None else max(w.sum(), 1e-12) for s, w in zip(sets, weights or sets)], float)
    sizes = np.fromiter(map(len, sets), np.int64, n_sets)
    if not sizes.sum():
        return np.zeros((n_sets, k), np.uint32)
    limit = np.where(sizes > 0, darts / np.maximum(total, 1e-12), 0.0)
    owner = np.repeat(np.arange(n_sets, dtype=np.int64), sizes)
    element = np.concatenate(sets)
    weight = None if weights is None else np.concatenate(weights).astype(float)
    strips = 1 if weight is None else int(math.ceil(weight.max()))
    edges = _edges(float(limit.max()))
    for strip in range(strips):
        if weight is None:
            e, o, w = element, owner, None
        else:
            here = weight > strip
            e, o, w = element[here], owner[here], weight[here] - strip
        for cell in range(len(edges) - 1):
            lo, hi = edges[cell], edges[cell + 1]
            live = limit[o] > lo
            if not live.any():
                break
            if not live.all():
                e, o = e[live], o[live]
                w = None if w is None else w[live]
            seed = mix(e ^ np.uint64((cell * 0x9E3779B97F4A7C15 + strip * 0xD6E8FEB86659FD93 + 1) & 0xFFFFFFFFFFFFFFFF))
            count = np.searchsorted(_TABLES[hi - lo], _uniform(seed), side="right")
            some = np.flatnonzero(count)
            times = count[some]
            who = np.repeat(some, times)
            number = np.arange(len(who)) - np.repeat(np.cumsum(times) - times, times)
            first = mix(seed[who] + (number.astype(np.uint64) + np.uint64(1)) * np.uint64(0xA0761D6478BD642F))
            rank = lo + (hi - lo) * _uniform(first)
            keep = rank < limit[o[who]]
            if w is not None:
                keep &= _uniform(mix(first ^ np.uint64(0x8BB84B93962EACC9))) < w[who]
            who, first, rank = who[keep], first[keep], rank[keep]
            identity = mix(first ^ np.uint64(0x2D358DCCAA6C78A5))
            slot = o[who] * k + ((identity >> np.uint64(32)) % np.uint64(k)).astype(np.int64)
            # Rank as a float32 pattern (its order is that of the numbers) above the dart's identity.
            packed = (rank.astype(np.float32).view(np.uint32).astype(np.uint64) << np.uint64(32)) | (identity & np.uint64(0xFFFFFFFF))
            np.minimum.at(best, slot, packed)
    best = best.reshape(n_sets, k)
    out = (best & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    missing = best == np.iinfo(np.uint64).max
    if missing.any():  # about exp(-2) of all coordinates per set: borrow from the set's lowest dart
        low = best.min(1)
        fill = mix(low[:, None] + np.arange(k, dtype=np.uint64)[None, :])
        out = np.where(missing, (fill & np.uint64(0xFFFFFFFF)).astype(np.uint32), out)
    out[sizes == 0] = 0
    return out


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key for each band of each signature."""
    parts = signature[:, : bands * rows].reshape(len(signature), bands, rows).astype(np.uint64)
    key = np.broadcast_to(mix(np.arange(1, bands + 1, dtype=np.uint64)), parts.shape[:2]).copy()
    for r in range(rows):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, r])
    return key.view(np.int64)


def sketches(signature: np.ndarray) -> list[bytes]:
    """The lowest four bits of every coordinate, two in a byte."""
    low = (signature & np.uint32(15)).astype(np.uint8)
    low = np.pad(low, ((0, 0), (0, low.shape[1] % 2)))
    return [r.tobytes() for r in (low[:, ::2] << 4) | low[:, 1::2]]


def least_agreement(similarity: float, k: int) -> float:
    """Share of agreeing sketch coordinates that a pair of this similarity falls below with probability 1e-9 (6 deviations)."""
    p = similarity + (1 - similarity) / 16
    return p - 6 * math.sqrt(p * (1 - p) / k)


def agreeing(pairs: DataFrame, similarity: float, k: int) -> DataFrame:
    """``(a, b)`` of the candidates ``(a, b, x, y)`` whose sketches x and y agree as often as similar texts do.

    Bands let unlike texts through now and then, ever more of them as a collection grows; their
    signatures as a whole do not agree, which is seen here before any text is read again.
    """
    least = least_agreement(similarity, k)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for i in (2, 3))
            differ = x ^ y
            same = (differ < 16).sum(1) + ((differ & 15) == 0).sum(1) - k % 2  # the padding of an odd k always agrees
            yield batch.select(["a", "b"]).filter(pa.array(same >= least * k))

    return pairs.select("a", "b", "x", "y").mapInArrow(keep, "a bigint, b bigint")


def _chunks(texts: list[str]) -> Iterator[tuple[int, int]]:
    lo = size = 0
    for i, t in enumerate(texts):
        if i > lo and size + len(t) > CHUNK_CHARS:
            yield lo, i
            lo, size = i, 0
        size += len(t)
    if lo < len(texts):
        yield lo, len(texts)


_HASHER: list[WordHasher] = []


def _hasher() -> WordHasher:
    if not _HASHER:
        _HASHER.append(WordHasher())
    return _HASHER[0]


def fingerprints(docs: DataFrame, run: int, bands: int, rows: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, word_class, form_class BINARY, n_words, keys ARRAY<BIGINT>, sketch BINARY)`` of every row.

    ``word_class`` stands for the sequence of words (128 bits; null for a text without words),
    ``form_class`` for the letters and digits. Texts with fewer than ``run`` words have neither band
    keys nor a sketch. Band keys and the sketch come only with the first text of a word class in a task, so copies are
    thinned out before anything is shuffled.
    """
    k = bands * rows

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, seen = _hasher(), set()
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for lo, hi in _chunks(texts):
                hashes, counts = hasher.words(texts[lo:hi])
                runs = hasher.runs(hashes, run)
                forms = canonical_digests(texts[lo:hi])
                raw = memoryview(hashes.tobytes())
                classes, sets, fresh = [], [], []
                at = 0
                for n in counts.tolist():
                    classes.append(hashlib.blake2b(raw[8 * at : 8 * (at + n)], digest_size=16).digest() if n else None)
                    fresh.append(n >= run and classes[-1] not in seen)
                    if fresh[-1]:
                        seen.add(classes[-1])
                        sets.append(np.unique(runs[at : at + n - run + 1]))
                    at += n
                signature = signatures(sets, k)
                keys = band_keys(signature, bands, rows)
                short = iter(sketches(signature))
                sizes = np.where(np.array(fresh, bool), bands, 0)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, hi - lo), pa.array(classes, pa.binary()), pa.array(forms, pa.binary()), pa.array(counts, pa.int64()), lists,
                        pa.array([next(short) if f else None for f in fresh], pa.binary()),
                    ],
                    names=["doc_id", "word_class", "form_class", "n_words", "keys", "sketch"],
                )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_col).mapInArrow(
        make, "doc_id bigint, word_class binary, form_class binary, n_words bigint, keys array<bigint>, sketch binary"
    )


def class_pairs(docs: DataFrame, run: int = RUN, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> tuple[DataFrame, DataFrame]:
    """Similar pairs of distinct texts, and the membership of every row.

    Returns ``links (class_a, class_b, similarity)`` between the smallest ids of word classes, and
    ``members (doc_id, class_id, form_class, n_copies)``. Texts with fewer than ``run`` words are in
    members but have no links; a row without words (null and empty texts too) is its own class. Similarity is the Jaccard coefficient of the distinct
    runs of ``run`` words, computed exactly for every candidate of the banded join.
    """
    held = materialise(fingerprints(docs, run, bands, rows), "fingerprints")
    wordless = held.where("word_class is null").select("doc_id", F.col("doc_id").alias("class_id"), "form_class", F.lit(1).cast("bigint").alias("n_copies"))
    held = held.where("word_class is not null")
    classes = held.groupBy("word_class").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("n_copies"), F.max("sketch").alias("sketch"))
    classes = materialise(classes, "classes")
    members = salted_join(held.select("doc_id", "word_class", "form_class"), classes.drop("sketch"), ["word_class"], "n_copies", ROWS_PER_SHARE)
    members = materialise(members.select("doc_id", "class_id", "form_class", "n_copies").unionByName(wordless), "members")

    keyed = held.where(F.size("keys") > 0)
    pairs = candidates(docs, keyed.select(F.explode("keys").alias("key"), F.col("doc_id").alias("id")), members.select(F.col("doc_id").alias("id"), "class_id"), run, similarity)
    ids = classes.where("sketch is not null").select("class_id", "sketch")
    pairs = pairs.join(ids.withColumnsRenamed({"class_id": "a", "sketch": "x"}), "a").join(ids.withColumnsRenamed({"class_id": "b", "sketch": "y"}), "b")
    pairs = materialise(agreeing(pairs, similarity, bands * rows), "pairs")
    return verified(docs, pairs, run, similarity), members


def _few(df: DataFrame, width: int = 32) -> DataFrame:
    """``df`` marked for a broadcast if it is counted to be small enough."""
    limit = BROADCAST_BYTES // width
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def candidates(docs: DataFrame, banded: DataFrame, class_of: DataFrame, run: int, similarity: float) -> DataFrame:
    """``(a, b)``, a < b: classes that share a band key ``(key, id)``, or, for keys of very many texts, may be similar.

    One aggregate counts each key with its smallest and greatest text (partial sums: a hot key is one
    row a task). Nearly all keys hold one text and are done; a key of two is a pair; keys of a few texts are read once more
    and joined with themselves. A key of more than BAND_TEXTS texts would build a square of pairs: its texts
    go through the exact prefix search of the core, by their rarest runs, which misses no similar pair.
    """
    keys = banded.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi")
    keys = materialise(keys, "bands")
    found = keys.where("n = 2").select(F.col("lo").alias("x"), F.col("hi").alias("y")).distinct()
    found = found.join(class_of.withColumnsRenamed({"id": "x", "class_id": "ca"}), "x").join(class_of.withColumnsRenamed({"id": "y", "class_id": "cb"}), "y").select("ca", "cb")
    some = keys.where(f"n > 2 and n <= {BAND_TEXTS}").select("key")
    met = banded.join(_few(some), "key").join(class_of, "id").select("key", "class_id").distinct()
    met = materialise(met, "shared")
    met = met.withColumnRenamed("class_id", "ca").join(met.withColumnRenamed("class_id", "cb"), "key").where("ca < cb").select("ca", "cb")
    found = found.unionByName(met)
    hot = keys.where(f"n > {BAND_TEXTS}").select("key")
    if hot.limit(1).count():
        texts = banded.join(_few(hot), "key", "left_semi").select("id").distinct().join(class_of, "id").select(F.col("class_id").alias("id")).distinct()
        texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(_few(texts), "id", "left_semi")
        sets = materialise(texts.select("id", run_hashes("text", [run]).alias("set")), "sets")
        rest = integrity.prefix_candidates(sets, similarity).select(F.col("a").alias("ca"), F.col("b").alias("cb"))
        found = found.unionByName(rest)
    found = found.where("ca <> cb").select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).distinct()
    return materialise(found, "candidates")


def verified(docs: DataFrame, pairs: DataFrame, run: int, similarity: float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(class_a, class_b, similarity)`` of the candidate pairs ``(a, b)`` of ids that reach the similarity.

    Each text that occurs in a candidate is read again and its run set joined to the pairs of either
    side; a text of very many pairs is joined in shares.
    """
    needed = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(_few(needed), "id", "left_semi")
    made = materialise(texts.select("id", run_hashes("text", [run]).alias("runs")), "runs")
    met = pairs
    for side, name in (("a", "x"), ("b", "y")):
        weights = pairs.groupBy(side).agg(F.count(F.lit(1)).alias("_k"))
        met = salted_join(met, made.select(F.col("id").alias(side), F.col("runs").alias(name)).join(weights, side), [side], "_k", PAIRS_PER_SHARE).drop("_k")
    shared = F.size(F.array_intersect("x", "y"))
    scored = met.select("a", "b", (shared / (F.size("x") + F.size("y") - shared)).alias("similarity"))
    return scored.where(F.col("similarity") >= similarity).select(F.col("a").alias("class_a"), F.col("b").alias("class_b"), "similarity")


def near_pairs(docs: DataFrame, run: int = RUN, similarity: float = SIMILARITY) -> DataFrame:
    """``(doc_id_a, doc_id_b)`` with a < b: every pair of rows whose texts are similar but not equal apart from form.

    Links between word classes are written out for the rows of both classes; a class of very
    many copies is joined in shares.
    """
    links, members = class_pairs(docs, run, similarity)
    links = materialise(links, "links")
    used = links.select(F.explode(F.array("class_a", "class_b")).alias("class_id")).distinct()
    mine = members.join(_few(used), "class_id", "left_semi").select("doc_id", "class_id", "form_class", "n_copies")
    block = F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("n_copies") / ROWS_PER_SHARE)).cast("int")
    mine = materialise(mine.withColumn("block", block), "mine")
    # Each link once for every block of rows of either class, so that no task holds more rows of a class than a block.
    sizes = mine.select("class_id", F.ceil(F.col("n_copies") / ROWS_PER_SHARE).cast("int").alias("blocks")).distinct()
    out = links.select("class_a", "class_b")
    for side, row, form in (("class_a", "ida", "fa"), ("class_b", "idb", "fb")):
        size = sizes.withColumnsRenamed({"class_id": side})
        out = out.join(size, side).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
        out = out.join(mine.select(F.col("class_id").alias(side), "block", F.col("doc_id").alias(row), F.col("form_class").alias(form)), [side, "block"]).drop("block")
    out = out.where(F.col("fa") != F.col("fb"))
    return out.select(F.least("ida", "idb").alias("doc_id_a"), F.greatest("ida", "idb").alias("doc_id_b"))


def groups(docs: DataFrame, run: int = RUN, similarity: float = SIMILARITY) -> DataFrame:
    """``(doc_id, class_id, group_id, n_links)`` of every row.

    ``class_id`` is the smallest id with the same words (a row without words has its own), ``group_id`` the smallest class of its
    connected group, ``n_links`` the number of similar classes.
    """
    links, members = class_pairs(docs, run, similarity)
    links = materialise(links, "links")
    both = links.select(F.col("class_a").alias("x"), F.col("class_b").alias("y")).union(links.select("class_b", "class_a"))
    labels = components(docs.sparkSession, both)
    counts = both.groupBy("x").agg(F.count(F.lit(1)).alias("n_links"))
    known = labels.join(counts, "x").select(F.col("x").alias("class_id"), "group_id", "n_links")
    return members.join(known, "class_id", "left").select(
        "doc_id", "class_id", F.coalesce("group_id", "class_id").alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links")
    )


def components(spark: SparkSession, edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``(x, group_id)`` of the nodes of symmetric edges ``(x, y)``: label propagation with pointer jumping.

    The labels stay a distributed table, written after every round; a round keeps, per node, the
    smallest label among its own, its neighbours' and its label's label.
    """
    labels = materialise(edges.groupBy("x").agg(F.least(F.col("x"), F.min("y")).alias("g")), "labels")
    for _ in range(most_rounds):
        heard = edges.join(labels.select(F.col("x").alias("y"), F.col("g").alias("h")), "y").groupBy("x").agg(F.min("h").alias("h"))
        step = labels.join(heard, "x").select("x", F.col("g").alias("old"), F.least("g", "h").alias("g"))
        jump = labels.select(F.col("x").alias("j"), F.col("g").alias("gg"))
        new = materialise(step.join(jump, step["g"] == jump["j"], "left").select("x", "old", F.least("g", F.coalesce("gg", "g")).alias("g")), "labels")
        labels = new.select("x", "g")
        if not new.where("old <> g").limit(1).count():
            return labels.withColumnRenamed("g", "group_id")
    raise RuntimeError(f"components: labels still change after {most_rounds} rounds")
