"""Evaluation passages inside a corpus: latent semantic retrieval, then word-by-word checks.

Passages are tiles of 32 words, 16 apart, so that every run of 17 words lies whole in some tile and a
text of 21 words has 19 or more in one, wherever it starts.
Tiles and query windows (every run of 8 words of every prompt and candidate text) are TF-IDF
vectors. Only words of the evaluation texts can add to a product with a query, so only their columns
are kept; document frequencies count all documents. A distributed randomised SVD (one pass, a
Nystrom sketch of the Gram matrix summed over all tiles) gives the latent space.

The search is lossless for exact leaks: for a tile t that holds window q, <t, q> >= |q|^2, and
<t, q> <= <z_t, z_q> + r_t r_q with the latent vectors z and the lengths r of what the projection
dropped. A tile without eight neighbouring words of the vocabulary holds no window and skips that part. A pair
is a candidate if that bound allows an exact leak or if its latent product and cosine with a longer
passage of an evaluation text reach the paraphrase limits. Candidates are then checked on the words of the
whole document: longest common run, longest common subsequence, and whether an answer of the item occurs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veridoc.functions.labels import path_key
from veridoc.functions.text import word_array, words
from veridoc.runtime import BROADCAST_BYTES, materialise

RUN = 8
TILE, STRIDE = 32, 16
RANK, OVERSAMPLE = 96, 16
#: A tile is checked for a paraphrase of a passage p from this latent cosine and from this share of |p|^2 on.
PARAPHRASE_COSINE, PARAPHRASE_SHARE = 0.25, 0.25
#: Share of a text's words in the longest common subsequence that makes a paraphrase.
PARAPHRASE_LCS = 0.7
PASSAGE_STRIDE = 8
#: Characters of evaluation texts that driver and workers hold at once; more texts go through in blocks.
BLOCK_CHARACTERS = 600_000
CHUNK_CHARS = 1 << 20
_BLOCKS = 16
#: Occurrences handled at once in a worker.
PART_TOKENS = 24_000


def evaluation_texts(items: DataFrame) -> DataFrame:
    """``(item_id, form_no, kind, text)``: prompts and candidate texts, repeated ones once."""
    forms = items.select("item_id", F.posexplode("forms").alias("form_no", "form"))
    prompts = forms.select("item_id", "form_no", F.lit("prompt").alias("kind"), F.col("form.prompt").alias("text"))
    answers = forms.select("item_id", "form_no", F.explode("form.candidates").alias("c")).select("item_id", "form_no", F.lit("candidate").alias("kind"), F.col("c.text").alias("text"))
    return prompts.unionByName(answers).where(F.col("text").isNotNull()).distinct()


def evaluation_blocks(items: DataFrame, run: int = RUN, most: int = BLOCK_CHARACTERS) -> Iterator["Evaluation"]:
    """The evaluation texts in blocks of about ``most`` characters; the texts of one form stay together."""
    texts = evaluation_texts(items)
    size = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = -(-size // most)
    block = F.pmod(F.xxhash64("item_id", "form_no"), F.lit(max(1, blocks)))
    for number in range(blocks):
        yield Evaluation(texts.where(block == number).sort("item_id", "form_no", "kind", "text").collect(), run)  # bounded by ``most``


class Evaluation:
    """One block of evaluation texts with their items, windows and vocabulary."""

    def __init__(self, rows: list, run: int = RUN) -> None:
        self.run = run
        self.item = [r["item_id"] for r in rows]
        self.form = [(r["item_id"], r["form_no"]) for r in rows]
        self.kind = [r["kind"] for r in rows]
        self.words = [words(r["text"]) for r in rows]
        self.vocabulary = {w: i for i, w in enumerate(sorted({w for t in self.words for w in t}))}
        windows: dict[tuple[int, ...], list[int]] = {}
        for n, text in enumerate(self.words):
            ids = [self.vocabulary[w] for w in text]
            for i in range(len(ids) - run + 1):
                owners = windows.setdefault(tuple(ids[i : i + run]), [])
                if not owners or owners[-1] != n:
                    owners.append(n)
        self.windows = np.array(list(windows), np.int64).reshape(-1, run)
        self.owners = list(windows.values())
        self.numbers = {w: n for n, w in enumerate(windows)}
        passages: dict[tuple[int, ...], list[int]] = {}
        for n, text in enumerate(self.words):
            ids = [self.vocabulary[w] for w in text]
            for i in range(0, max(1, len(ids) - TILE + PASSAGE_STRIDE), PASSAGE_STRIDE) if ids else ():
                owners = passages.setdefault(tuple(ids[i : i + TILE]), [])
                if not owners or owners[-1] != n:
                    owners.append(n)
        self.passages = list(passages)
        self.passage_owners = list(passages.values())
        self.distinct = [np.unique([self.vocabulary[w] for w in t]).astype(np.int64) for t in self.words]


def occurrences(docs: DataFrame, vocabulary: dict[str, int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, at ARRAY<INT>, term ARRAY<INT>)``: where words of the vocabulary stand in each text."""
    shared = docs.sparkSession.sparkContext.broadcast({w.encode("utf-8", "surrogatepass"): i for w, i in vocabulary.items()})

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for lo, hi in _chunks(texts):
                array, counts = word_array(texts[lo:hi])
                distinct = array.dictionary.to_pylist()
                known = np.fromiter((held.get(w, -1) for w in distinct), np.int32, len(distinct))
                term = known[array.indices.to_numpy()] if len(array) else np.zeros(0, np.int32)
                hit = np.flatnonzero(term >= 0)
                ends = np.cumsum(counts)
                at = hit - np.repeat(ends - counts, np.diff(np.searchsorted(hit, ends), prepend=0))
                offsets = np.concatenate([[0], np.searchsorted(hit, ends)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, hi - lo),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(at.astype(np.int32))),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(term[hit])),
                    ],
                    names=["doc_id", "at", "term"],
                )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_col).mapInArrow(find, "doc_id bigint, at array<int>, term array<int>")


def _chunks(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    lo = size = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > lo and size + n > CHUNK_CHARS:
            yield lo, i
            lo, size = i, 0
        size += n
    if lo < len(texts):
        yield lo, len(texts)


def tiles(batch: pa.RecordBatch, run: int = RUN) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Tiles of a batch of occurrences: row of the batch per tile, first token per tile, term per token, and
    whether ``run`` neighbouring words of the tile are all in the vocabulary (without that it holds no query window)."""
    at = batch.column("at").flatten().to_numpy().astype(np.int64)
    term = batch.column("term").flatten().to_numpy().astype(np.int64)
    counts = np.diff(batch.column("at").offsets.to_numpy())
    row = np.repeat(np.arange(len(counts)), counts)
    first = at // STRIDE
    again = np.flatnonzero((at % STRIDE < TILE - STRIDE) & (first > 0))
    key = np.concatenate([(row << 32) | first, (row[again] << 32) | (first[again] - 1)])
    token, place = np.concatenate([term, term[again]]), np.concatenate([at, at[again]])
    order = np.argsort(key, kind="stable")
    key, token, place = key[order], token[order], place[order]
    if not len(key):
        return key, np.zeros(0, np.int64), token, np.zeros(0, bool)
    new = np.concatenate([[True], key[1:] != key[:-1]])
    starts = np.flatnonzero(new)
    heads = np.flatnonzero(new | np.concatenate([[True], np.diff(place) != 1]))
    long = heads[np.diff(np.append(heads, len(key))) >= run]
    dense = np.zeros(len(starts), bool)
    dense[np.searchsorted(starts, long, side="right") - 1] = True
    return key[starts] >> 32, starts, token, dense


def apart(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The tiles of a batch that do not overlap: first token per tile, term per token."""
    at = batch.column("at").flatten().to_numpy()
    counts = np.diff(batch.column("at").offsets.to_numpy())
    key = (np.repeat(np.arange(len(counts)), counts) << 32) | (at // TILE)
    return np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else key, batch.column("term").flatten().to_numpy()


def _parts(batch: pa.RecordBatch, most: int = PART_TOKENS) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about ``most`` occurrences, so that the work space of a worker stays small."""
    ends = np.cumsum(np.diff(batch.column("at").offsets.to_numpy()))
    lo = 0
    while lo < len(ends):
        before = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


def document_frequency(held: DataFrame, size: int) -> np.ndarray:
    """Documents per vocabulary word, over all documents."""
    counted = held.select(F.explode(F.array_distinct("term")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    out = np.zeros(size)
    for r in counted.collect():  # at most one row per word of the evaluation texts
        out[r["term"]] = r["n"]
    return out


def sketch(held: DataFrame, idf: np.ndarray, omega: np.ndarray) -> np.ndarray:
    """(A^T A) omega for the tile matrix A, summed over the cluster in two levels of partial sums.

    Every second tile is taken: these tile each text without overlap, so every word of every text counts once.
    """
    spark = held.sparkSession
    shared = spark.sparkContext.broadcast((idf.astype(np.float32), omega.astype(np.float32)))
    m, width = omega.shape
    step = -(-m // _BLOCKS)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, om = shared.value
        total = np.zeros((m, width))
        for batch in (part for whole in batches for part in _parts(whole)):
            starts, token = apart(batch)
            if not len(token):
                continue
            scaled = weight[token]
            z = np.add.reduceat(scaled[:, None] * om[token], starts, axis=0)
            of = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(token))))
            order = np.argsort(token, kind="stable")
            sorted_token = token[order]
            heads = np.flatnonzero(np.concatenate([[True], sorted_token[1:] != sorted_token[:-1]]))
            for lo in range(0, len(heads), 256):  # bounded work space
                a = heads[lo]
                b = heads[lo + 256] if lo + 256 < len(heads) else len(order)
                part = order[a:b]
                total[sorted_token[heads[lo : lo + 256]]] += np.add.reduceat(scaled[part][:, None] * z[of[part]], heads[lo : lo + 256] - a, axis=0)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(_BLOCKS, dtype=np.int32)), pa.array([total[i * step : (i + 1) * step].tobytes() for i in range(_BLOCKS)], pa.binary())],
            names=["block", "part"],
        )

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                value = np.frombuffer(part)
                sums[block] = value + sums[block] if block in sums else value.copy()
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["block", "part"])

    schema = "block int, part binary"
    level = held.select("at", "term").mapInArrow(partial, schema)
    level = level.repartition(4 * _BLOCKS, "block", F.spark_partition_id() % 16).mapInArrow(add, schema)
    level = level.repartition(_BLOCKS, "block").mapInArrow(add, schema)
    out = np.zeros((step * _BLOCKS, width))
    for r in level.collect():  # _BLOCKS rows, each a slice of one small matrix, from each of _BLOCKS tasks
        value = np.frombuffer(r["part"]).reshape(-1, width)
        out[r["block"] * step : r["block"] * step + len(value)] += value
    return out[:m]


def latent_basis(y: np.ndarray, omega: np.ndarray, rank: int) -> np.ndarray:
    """Leading right singular vectors of the tile matrix from its Nystrom sketch."""
    shift = 1e-9 * max(np.linalg.norm(y), 1e-12)
    y = y + shift * omega
    core = omega.T @ y
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    good = values > max(values.max(), 0) * 1e-10
    if not good.any():
        return np.zeros((len(y), 0))
    half = y @ (vectors[:, good] / np.sqrt(values[good]))
    u, s, _ = np.linalg.svd(half, full_matrices=False)
    return u[:, : min(rank, int((s > s[0] * 1e-7).sum()))]


def _vectors(token: np.ndarray, starts: np.ndarray, idf: np.ndarray, basis: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Latent vectors and squared lengths of TF-IDF vectors given as token lists."""
    z = np.add.reduceat((idf[token][:, None] * basis[token]).astype(np.float32), starts, axis=0)
    of = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(token))))
    key = of * len(idf) + token
    distinct, counts = np.unique(key, return_counts=True)
    square = np.bincount(distinct // len(idf), weights=(counts * idf[distinct % len(idf)]) ** 2, minlength=len(starts))
    return z, square


def candidates(held: DataFrame, evaluation: Evaluation, rank: int = RANK) -> DataFrame:
    """``(doc_id, text_no, cosine)``: evaluation texts that a document may hold, with the best latent cosine."""
    spark = held.sparkSession
    size = len(evaluation.vocabulary)
    n_docs = held.count()
    df = document_frequency(held, size)
    idf = np.log((1 + n_docs) / (1 + df)) + 1.0
    width = min(rank + OVERSAMPLE, size)
    omega = np.linalg.qr(np.random.default_rng(7).standard_normal((size, width)))[0]
    y = sketch(held, idf, omega)
    # The query windows are passages too: they enter the matrix with the weight of the corpus.
    q_token, q_starts = evaluation.windows.ravel(), np.arange(len(evaluation.windows)) * evaluation.run
    dense = np.zeros((size, width))
    for lo in range(0, len(evaluation.windows), 4096):
        part = evaluation.windows[lo : lo + 4096]
        z = (idf[part][:, :, None] * omega[part]).sum(1)
        np.add.at(dense, part, idf[part][:, :, None] * z[:, None, :])
    y = y + dense * (max(np.linalg.norm(y), 1e-9) / max(np.linalg.norm(dense), 1e-9))
    basis = latent_basis(y, omega, rank)
    zq, q2 = _vectors(q_token, q_starts, idf, basis)
    rq = np.sqrt(np.maximum(q2 - (zq.astype(float) ** 2).sum(1), 0))
    order = np.argsort(q2)
    exact = (zq[order], q2[order], rq[order], *_flat([evaluation.owners[i] for i in order]))
    run = evaluation.run
    lengths = np.array([len(x) for x in evaluation.passages])
    zp, p2 = _vectors(np.concatenate([np.array(x) for x in evaluation.passages]), np.cumsum(lengths) - lengths, idf, basis)
    order = np.argsort(p2)
    loose = (zp[order], p2[order], *_flat([evaluation.passage_owners[i] for i in order]))
    shared = spark.sparkContext.broadcast((idf, basis.astype(np.float32), exact, loose))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, base, (z_q, s_q, r_q, q_text, q_first), (z_p, s_p, p_text, p_first) = shared.value
        least = PARAPHRASE_SHARE**2 * s_p[0]
        for batch in (part for whole in batches for part in _parts(whole)):
            row, starts, token, dense = tiles(batch, run)
            if not len(token):
                continue
            z, square = _vectors(token, starts, weight, base)
            docs, texts, cosines = [], [], []

            def add(tile: np.ndarray, text_of: np.ndarray, offset: np.ndarray, b: np.ndarray, cosine: np.ndarray) -> None:
                times = offset[b + 1] - offset[b]
                at = np.repeat(offset[b], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                docs.append(np.repeat(row[tile], times))
                texts.append(text_of[at])
                cosines.append(np.repeat(cosine, times))

            # |q|^2 <= <t, q> <= |t| |q| fails for tiles shorter than every query.
            for mine in _blocks_by(square, np.flatnonzero(dense & (square * 1.001 >= (s_q[0] if len(s_q) else np.inf)))):
                t2 = square[mine]
                left = np.sqrt(np.maximum(t2 - (z[mine].astype(float) ** 2).sum(1), 0)).astype(np.float32)
                top = int(np.searchsorted(s_q, t2[-1] * 1.001, side="right"))
                dot = z[mine] @ z_q[:top].T
                a, b = np.nonzero(dot + left[:, None] * r_q[:top].astype(np.float32) >= (0.999 * s_q[:top]).astype(np.float32))
                add(mine[a], q_text, q_first, b, dot[a, b] / np.sqrt(t2[a] * s_q[b]))
            for mine in _blocks_by(square, np.flatnonzero(square * 1.001 >= least)):
                t2 = square[mine]
                top = int(np.searchsorted(s_p, t2[-1] / PARAPHRASE_SHARE**2 * 1.001, side="right"))
                dot = z[mine] @ z_p[:top].T
                a, b = np.nonzero(dot >= (PARAPHRASE_SHARE * s_p[:top]).astype(np.float32))
                cosine = dot[a, b] / np.sqrt(t2[a] * s_p[b])
                keep = cosine >= PARAPHRASE_COSINE
                add(mine[a[keep]], p_text, p_first, b[keep], cosine[keep])
            if docs and sum(map(len, docs)):
                doc, text, value = np.concatenate(docs), np.concatenate(texts), np.concatenate(cosines)
                key = (doc << 32) | text
                by = np.lexsort((-value, key))
                keep = by[np.concatenate([[True], key[by][1:] != key[by][:-1]])]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(doc[keep])), pa.array(text[keep].astype(np.int32)), pa.array(value[keep].astype(float))],
                    names=["doc_id", "text_no", "cosine"],
                )

    found = held.where(F.size("term") > 0).mapInArrow(search, "doc_id bigint, text_no int, cosine double")
    return found.groupBy("doc_id", "text_no").agg(F.max("cosine").alias("cosine"))


def _blocks_by(square: np.ndarray, rows: np.ndarray, most: int = 512) -> Iterator[np.ndarray]:
    """The given tiles in blocks of bounded size, shortest vectors first."""
    rows = rows[np.argsort(square[rows])]
    for lo in range(0, len(rows), most):
        yield rows[lo : lo + most]


def _flat(owners: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Lists end to end, and where each begins."""
    return np.concatenate([np.zeros(0, np.int64), *(np.array(o, np.int64) for o in owners)]), np.cumsum([0, *map(len, owners)])


def longest_runs(doc: list[str], ids: list[int], evaluation: Evaluation, hits: set[int]) -> dict[int, int]:
    """Longest run of words that a document (its words, and their vocabulary numbers) shares with each of the given
    evaluation texts, if 8 or more."""
    run = evaluation.run
    best: dict[int, int] = {}
    length: dict[int, int] = {}  # of the run that ends here, by text
    for i in range(len(ids) - run + 1):
        number = evaluation.numbers.get(tuple(ids[i : i + run]))
        now = {}
        if number is not None:
            for n in evaluation.owners[number]:
                if n in hits:
                    now[n] = length.get(n, run - 1) + 1
                    if now[n] > best.get(n, 0):
                        best[n] = longest_run(doc[i - (now[n] - run) : i + run], evaluation.words[n], run)
        length = now
    return best


def longest_run(a: list[str], b: list[str], least: int) -> int:
    """Length of the longest run of words that both hold, if it reaches ``least``; else 0."""
    where: dict[tuple[str, ...], list[int]] = {}
    for i in range(len(b) - least + 1):
        where.setdefault(tuple(b[i : i + least]), []).append(i)
    best = 0
    if where:
        for i in range(len(a) - least + 1):
            for j in where.get(tuple(a[i : i + least]), ()):
                n = least
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                    n += 1
                best = max(best, n)
    return best


def common_subsequence(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, bit-parallel over ``a``."""
    masks: dict[str, int] = {}
    for i, w in enumerate(a):
        masks[w] = masks.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    state = full
    for w in b:
        match = masks.get(w, 0)
        if match:
            shared = state & match
            state = ((state + shared) | (state - shared)) & full
    return len(a) - state.bit_count()


def most_shared(ids: np.ndarray, wanted: list[np.ndarray], spans: list[int], size: int) -> np.ndarray:
    """Per text, the most places that any stretch of ``span`` words of a document fills with words of the text.

    No common subsequence with such a stretch is longer. ``ids`` are the document's words as numbers below ``size``.
    """
    out = np.zeros(len(wanted), np.int64)
    present, local = np.unique(ids, return_inverse=True)
    column = np.full(size, -1, np.int32)
    column[present] = np.arange(len(present))
    for lo in range(0, len(wanted), 64):  # bounded work space
        part = wanted[lo : lo + 64]
        at = column[np.concatenate(part)]
        row = np.repeat(np.arange(len(part)), [len(x) for x in part])
        held = np.zeros((len(part), len(present)), np.int8)
        held[row[at >= 0], at[at >= 0]] = 1
        upto = np.zeros((len(part), len(ids) + 1), np.int32)
        np.cumsum(held[:, local], axis=1, out=upto[:, 1:])
        for span in set(spans[lo : lo + 64]):
            mine = np.flatnonzero(np.array(spans[lo : lo + 64]) == span)
            out[lo + mine] = (upto[mine, span:] - upto[mine, :-span]).max(1) if len(ids) > span else upto[mine, -1]
    return out


def best_window(text: list[str], doc: list[str], least: int = 1) -> int:
    """Longest common subsequence of a text with any stretch of the document twice its length; 0 if below ``least``."""
    span, step = max(2 * len(text), 1), max(1, len(text) // 2)
    wanted = set(text)
    held = [0]
    for w in doc:
        held.append(held[-1] + (w in wanted))
    last, best = max(0, len(doc) - span), least - 1
    for lo in range(0, last + 1, step):
        hi = min(last, lo + step - 1)
        end = min(len(doc), hi + span)
        if held[end] - held[lo] <= best:
            continue
        most = common_subsequence(text, doc[lo:end])  # no stretch that starts at lo..hi has more
        for at in range(lo, hi + 1):
            if most <= best:
                break
            if held[min(len(doc), at + span)] - held[at] > best:
                best = max(best, common_subsequence(text, doc[at : at + span]))
    return best if best >= least else 0


_SCHEMA = "doc_id bigint, item_id string, kind string, cosine double, run_words int, lcs_share double, answer_share double"


def leaks(docs: DataFrame, manifest: DataFrame | None, items: DataFrame, rank: int = RANK, most: int = BLOCK_CHARACTERS) -> DataFrame:
    """``(doc_id, item_id, kind, cosine, run_words, lcs_share, answer_share, in_manifest)``: one row per leaked evaluation text.

    ``kind`` is 'exact' where a run of 8 words or more of one evaluation text stands in the
    document (``run_words``), 'paraphrase' where the latent product, the share of the text's words in
    the longest common subsequence and an answer of the same form agree. Every document is searched;
    ``in_manifest`` says whether the manifest points to it by its path (null without a manifest). Null and empty
    texts leak nothing; an item without an id leaks under the null id; no items or no documents give an empty
    result. Evaluation texts of more than ``most`` characters go over the documents in blocks.
    """
    parts = [_block_leaks(docs, evaluation, rank) for evaluation in evaluation_blocks(items, most=most) if evaluation.vocabulary]
    if not parts:
        return docs.sparkSession.createDataFrame([], _SCHEMA + ", in_manifest boolean")
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    if manifest is None:
        return found.withColumn("in_manifest", F.lit(None).cast("boolean"))
    found = materialise(found, "leaks")
    paths = docs.select(F.col("doc_id").cast("long").alias("doc_id"), path_key("content_path").alias("k")).join(found.select("doc_id").distinct(), "doc_id", "left_semi")
    pointed = manifest.where(F.col("content_path").isNotNull()).select(path_key("content_path").alias("k"))
    pointed = paths.join(pointed, "k", "left_semi").select("doc_id").distinct().withColumn("_there", F.lit(True))
    return found.join(pointed, "doc_id", "left").withColumn("in_manifest", F.coalesce("_there", F.lit(False))).drop("_there")


def _block_leaks(docs: DataFrame, evaluation: Evaluation, rank: int) -> DataFrame:
    held = materialise(occurrences(docs, evaluation.vocabulary), "occurrences")
    found = materialise(candidates(held, evaluation, rank).groupBy("doc_id").agg(F.collect_list(F.struct("text_no", "cosine")).alias("hits")), "candidates")
    needed = found.select("doc_id")
    few = needed.limit(BROADCAST_BYTES // 32 + 1).count() <= BROADCAST_BYTES // 32
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    texts = texts.join(F.broadcast(needed) if few else needed, "doc_id", "left_semi")
    shared = docs.sparkSession.sparkContext.broadcast(evaluation)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ev = shared.value
        item, form, content, vocabulary = ev.item, ev.form, ev.words, ev.vocabulary
        other = len(vocabulary)
        answers: dict[tuple, list[int]] = {}
        for n, f in enumerate(form):
            if ev.kind[n] == "candidate":
                answers.setdefault(f, []).append(n)
        for batch in batches:
            rows = []
            for doc_id, text, hits in zip(*(batch.column(i).to_pylist() for i in range(3))):
                body = words(text)
                ids = [vocabulary.get(w, other) for w in body]
                runs = longest_runs(body, ids, ev, {h["text_no"] for h in hits})
                # Texts that might be a paraphrase here, and the answers that would have to stand beside them.
                open_ = [h["text_no"] for h in hits if h["text_no"] not in runs and h["cosine"] >= PARAPHRASE_COSINE]
                asked = sorted({*open_, *(k for n in open_ for k in answers.get(form[n], []))})
                bound = dict(zip(asked, most_shared(np.array(ids, np.int64), [ev.distinct[k] for k in asked], [2 * max(1, len(content[k])) for k in asked], other + 1).tolist())) if asked else {}
                shares: dict[int, float] = {}

                def share(k: int) -> float:
                    """Share of the text's words in order; 0 where it does not reach the limit."""
                    if k not in shares:
                        n = max(1, len(content[k]))
                        least = math.ceil(PARAPHRASE_LCS * n - 1e-9)
                        shares[k] = best_window(content[k], body, least) / n if bound[k] >= least else 0.0
                    return shares[k]

                for hit in hits:
                    n = hit["text_no"]
                    if n in runs:
                        rows.append((doc_id, item[n], "exact", hit["cosine"], runs[n], None, None))
                    elif n in bound and share(n):
                        answer = max((share(k) for k in answers.get(form[n], [])), default=0.0)
                        if answer:
                            rows.append((doc_id, item[n], "paraphrase", hit["cosine"], 0, share(n), answer))
            columns = list(zip(*rows)) or [()] * 7
            kinds = [pa.int64(), pa.string(), pa.string(), pa.float64(), pa.int32(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "item_id", "kind", "cosine", "run_words", "lcs_share", "answer_share"])

    return texts.select("doc_id", "text").join(found, "doc_id").mapInArrow(check, _SCHEMA)


def exact(found: DataFrame) -> DataFrame:
    """``(doc_id, item_id)`` of the exact leaks."""
    return found.where("kind = 'exact'").select("doc_id", "item_id").distinct()


def report(found: DataFrame) -> DataFrame:
    """``(item_id, kind, n_docs, longest_run)`` of the items that leaked."""
    return found.groupBy("item_id", "kind").agg(F.count_distinct("doc_id").alias("n_docs"), F.max("run_words").alias("longest_run"))
