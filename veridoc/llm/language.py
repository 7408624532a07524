"""Languages of documents and of their parts, by a byte convolutional network.

The network sees lower-case UTF-8 bytes in windows of at most WINDOW bytes: filters of 2, 4 and 6
bytes, max pooling over the window, one softmax layer over the languages and "none". It is trained
in numpy on the driver, first on clean labelled sentences, then also on sentences of a bounded
sample of labelled documents whose label the first network confirms. A filter over one-hot
bytes is a sum of table rows; for inference rows of neighbouring bytes are added once into
tables of byte pairs, so a window costs three look-ups per byte. Fitted weights can be saved and read again.
"""

from __future__ import annotations

import hashlib
import io
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veridoc.functions.labels import LANGUAGES, language_code
from veridoc.functions.text import WORD, fold
from veridoc.runtime import small

CODES = list(LANGUAGES)
NONE = len(CODES)
WINDOW = 128
WIDTHS, FILTERS = (2, 4, 6), 16
#: Bounds of the training sample: labelled documents taken, their windows taken per label, and training windows per class.
TRAINING_DOCUMENTS, LABEL_WINDOWS, TRAINING_WINDOWS = 3000, 4096, 900
#: Hash buckets over which the windows of a label are drawn.
_DRAW = 64
#: Bound of the clean training set; more labelled sentences are an error.
LABELLED_SENTENCES = 10_000
#: Number of this way of fitting: saved weights of another number are not read.
FITTING = 2
EPOCHS, BATCH, RATE, SEED = 14, 128, 0.01, 5
#: A segment counts as a full sentence from so many words (Japanese: characters) and this confidence on;
#: the only sentence of a second language in a document needs more confidence.
SENTENCE_WORDS, SENTENCE_CHARACTERS = 6, 10
SURE, LONE_SURE = 0.8, 0.9
LEAST_WORDS, LEAST_CHARACTERS = 8, 20
_PAIR_BLOCK = 1 << 16
#: Windows are padded with zero bytes to a multiple of this, in training too.
BLOCK = 16

_FENCE = re.compile(r"```.*?```", re.S)
_BREAK = re.compile(r"[.!?…;]+[\"”»’)\]]*(?:\s+|\Z)|[。！？]+[」』”]*|\n\s*\n|\s[–—]\s|\n(?==)|\n(?=[-*#|>])|\[\[|\]\]|[«»„“”]")
_LETTERS = re.compile(r"[^\W\d_]{2,}")
_KANA = re.compile(r"[぀-ヿ]")
_EAST = re.compile(r"[぀-ヿ㐀-鿿]")


def sentences(text: str | None) -> list[tuple[int, int]]:
    """Limits of the segments of a text: between sentence ends, blank lines, quotes and links; no fenced code."""
    if not text:
        return []
    if "```" in text:
        text = _FENCE.sub(lambda m: "\n" * len(m[0]), text)
    out, lo = [], 0
    for m in _BREAK.finditer(text):
        if m.start() > lo:
            out.append((lo, m.start()))
        lo = m.end()
    if lo < len(text):
        out.append((lo, len(text)))
    return out


def is_sentence(segment: str, n_words: int | None = None) -> bool:
    """Whether a segment is long enough to be a full sentence."""
    if (len(_LETTERS.findall(segment)) if n_words is None else n_words) >= SENTENCE_WORDS:
        return True
    return len(segment) >= SENTENCE_CHARACTERS and _KANA.search(segment) is not None and len(_EAST.findall(segment)) >= SENTENCE_CHARACTERS


def long_enough(text: str | None) -> bool:
    """Whether a text has 8 words or, in Japanese, 20 characters."""
    if not text:
        return False
    n = 0
    for _ in WORD.finditer(text):
        n += 1
        if n >= LEAST_WORDS:
            return True
    return len(text) >= LEAST_CHARACTERS and len(_EAST.findall(fold(text))) >= LEAST_CHARACTERS


def windows(segment: str) -> list[bytes]:
    """A segment as windows of equal length, at most WINDOW bytes each, over all of it."""
    data = " ".join(segment.lower().split()).encode("utf-8", "replace")
    n = -(-len(data) // WINDOW)
    if n <= 1:
        return [data] if data else []
    cut = [len(data) * i // n for i in range(n + 1)]
    return [data[a:b] for a, b in zip(cut, cut[1:])]


class Network:
    """Byte tables per filter offset, and the softmax layer."""

    def __init__(self, rng: np.random.Generator) -> None:
        self.tables = {w: rng.normal(0, 0.3 / np.sqrt(w), (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS}
        self.dense = rng.normal(0, 0.1, (FILTERS * len(WIDTHS), NONE + 1)).astype(np.float32)
        self.bias = np.zeros(NONE + 1, np.float32)
        self._pairs: dict[int, list[np.ndarray]] | None = None

    def dumps(self) -> bytes:
        """The weights as bytes."""
        out = io.BytesIO()
        np.savez(out, dense=self.dense, bias=self.bias, **{f"table{w}": t for w, t in self.tables.items()})
        return out.getvalue()

    @classmethod
    def loads(cls, data: bytes) -> "Network":
        """A network from the bytes of ``dumps``."""
        held = np.load(io.BytesIO(data), allow_pickle=False)
        net = cls(np.random.default_rng(0))
        net.tables = {w: held[f"table{w}"] for w in WIDTHS}
        net.dense, net.bias = held["dense"], held["bias"]
        return net

    def __getstate__(self) -> dict:
        return {**self.__dict__, "_pairs": None}  # built anew where it is used

    def pairs(self) -> dict[int, list[np.ndarray]]:
        """Per filter width and even offset, the sum of two byte rows for every byte pair."""
        if self._pairs is None:
            self._pairs = {w: [(t[k][:, None, :] + t[k + 1][None, :, :]).reshape(65536, -1) for k in range(0, w, 2)] for w, t in self.tables.items()}
        return self._pairs

    def pool(self, items: list[bytes]) -> np.ndarray:
        """Pooled filter values of each window (not empty), over the window padded with zero bytes to whole blocks."""
        out = np.empty((len(items), FILTERS * len(WIDTHS)), np.float32)
        tables = self.pairs()
        lo = 0
        while lo < len(items):
            hi, size = lo, 0
            while hi < len(items) and (hi == lo or size < _PAIR_BLOCK):
                size += len(items[hi]) + BLOCK
                hi += 1
            part = items[lo:hi]
            blocks = -(-np.fromiter(map(len, part), np.int64, hi - lo) // BLOCK)
            data = np.frombuffer(b"".join([x.ljust(BLOCK * n, b"\0") for x, n in zip(part, blocks.tolist())]) + b"\0\0", np.uint8).astype(np.int32)
            n = len(data) - 2
            ends = np.cumsum(blocks) * BLOCK
            pair = data[:-1] * 256 + data[1:]
            pair[ends - 1] = data[ends - 1] * 256  # nothing is read beyond a window's own bytes
            index = [pair[:n]]
            for k in range(2, max(WIDTHS), 2):
                shifted = np.zeros(n, np.int32)
                shifted[: n - k] = pair[k:n]
                for j in range(k):
                    shifted[ends - 1 - j] = 0
                index.append(shifted)
            # Position by position of all blocks at once: contiguous rows to add and compare.
            index = [np.ascontiguousarray(x.reshape(-1, BLOCK).T) for x in index]
            pooled = []
            for rows in tables.values():
                best = None
                for j in range(BLOCK):
                    h = rows[0].take(index[0][j], 0)
                    for x, t in zip(index[1:], rows[1:]):
                        h += t.take(x[j], 0)
                    best = h if best is None else np.maximum(best, h, out=best)
                pooled.append(best)
            inner = np.concatenate(pooled, 1)
            out[lo:hi] = np.maximum.reduceat(inner, np.cumsum(blocks) - blocks, axis=0)
            lo = hi
        return np.maximum(out, 0)

    def probabilities(self, items: list[bytes]) -> np.ndarray:
        if not items:
            return np.zeros((0, NONE + 1), np.float32)
        x = self.pool(items) @ self.dense + self.bias
        x = np.exp(x - x.max(1, keepdims=True))
        return x / x.sum(1, keepdims=True)

    def fit(self, items: list[bytes], labels: np.ndarray, epochs: int, rng: np.random.Generator) -> None:
        """Adam on cross entropy; gradients reach a filter at its strongest place only."""
        span = WINDOW + BLOCK + max(WIDTHS)
        data = np.zeros((len(items), span), np.uint8)
        for i, x in enumerate(items):
            data[i, : len(x)] = np.frombuffer(x, np.uint8)
        lengths = BLOCK * np.maximum(1, -(-np.fromiter(map(len, items), np.int64, len(items)) // BLOCK))
        params = [*self.tables.values(), self.dense, self.bias]
        m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        step = 0
        for epoch in range(epochs):
            rate = RATE * (1 - epoch / epochs) + 1e-4
            order = rng.permutation(len(items))
            for lo in range(0, len(order), BATCH):
                at = order[lo : lo + BATCH]
                b, n = np.ascontiguousarray(data[at].T).astype(np.intp), len(at)  # position by position: contiguous rows to add and compare
                top = int(lengths[at].max())
                beyond = np.where(np.arange(top)[:, None] >= lengths[at], np.float32(-np.inf), np.float32(0))[:, :, None]
                pooled, places = [], []
                for w, t in self.tables.items():
                    h = t[0].take(b[:top], 0)
                    for j in range(1, w):
                        h += t[j].take(b[j : top + j], 0)
                    h += beyond
                    best = h.max(0)
                    hit = np.flatnonzero(h == best)[::-1]
                    place = np.empty(best.size, np.intp)
                    place[hit % best.size] = hit // best.size  # of several the first: written last
                    places.append(place.reshape(best.shape))
                    pooled.append(best)
                x = np.concatenate(pooled, 1)
                keep = (rng.random(x.shape) > 0.15) / 0.85
                z = np.maximum(x, 0) * keep
                s = z @ self.dense + self.bias
                s = np.exp(s - s.max(1, keepdims=True))
                s /= s.sum(1, keepdims=True)
                s[np.arange(n), labels[at]] -= 1
                s /= n
                back = (s @ self.dense.T) * keep * (x > 0)
                grads = []
                for k, w in enumerate(WIDTHS):
                    part = back[:, k * FILTERS : (k + 1) * FILTERS]
                    spot = places[k][None] + np.arange(w)[:, None, None]
                    byte = b[spot, np.arange(n)[None, :, None]]
                    cell = (np.arange(w)[:, None, None] * 256 + byte) * FILTERS + np.arange(FILTERS)
                    g = np.bincount(cell.ravel(), weights=np.broadcast_to(part, cell.shape).ravel(), minlength=w * 256 * FILTERS)
                    grads.append(g.reshape(w, 256, FILTERS).astype(np.float32))
                grads += [z.T @ s, s.sum(0)]
                step += 1
                for i, (p, g) in enumerate(zip(params, grads)):
                    m[i] = 0.9 * m[i] + 0.1 * g
                    v[i] = 0.99 * v[i] + 0.01 * g * g
                    p -= (rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        self._pairs = None


def _noise(rng: np.random.Generator, names: list[str], n: int) -> list[bytes]:
    """Windows of no language: numbers, codes, tables, symbols, names, scattered ideographs."""
    out = []
    for i in range(n):
        kind = i % 8
        number = lambda: str(int(rng.integers(0, 10 ** int(rng.integers(1, 7)))))
        pick = lambda: str(rng.choice(names)) if names else "x"
        if kind == 0:
            s = " ".join(number() for _ in range(24))
        elif kind == 1:
            s = bytes(rng.integers(0, 256, 48, np.uint8)).hex()
        elif kind == 2:
            s = "\t".join(["row_" + number(), *(f"{rng.random() * 900:.3f}" for _ in range(14))])
        elif kind == 3:
            s = " ".join(f"{rng.choice(list('xyzabk'))}{number()} {rng.choice(['=', ':=', '+=', '=='])} {pick().lower()}_{number()}({number()});" for _ in range(5))
        elif kind == 4:
            s = " ".join(pick() for _ in range(14))
        elif kind == 5:
            s = "".join(chr(int(c)) for c in rng.integers(0x4E00, 0x9FA0, 36))
        elif kind == 6:
            s = str(rng.choice(list("_*=-#~0."))) * int(rng.integers(20, 120)) + number()
        else:
            s = '{"k' + number() + '": [' + ",".join(number() for _ in range(20)) + "], \"<|" + pick().lower() + '|>": null}'
        out += windows(s)[:1]
    return out


def train(samples: list[tuple[str, str]], documents: list[tuple[str, bytes]], epochs: int = EPOCHS, seed: int = SEED) -> Network:
    """A network from clean ``(language, sentence)`` samples and ``(label, window)`` pieces of documents whose labels may be wrong."""
    rng = np.random.default_rng(seed)
    number = {c: i for i, c in enumerate(CODES)}
    clean = [(w, number[c]) for c, s in samples if c in number and s for w in windows(s)]
    names = sorted({w for _, s in samples for w in re.findall(r"(?<=\w )[A-Z][a-zß-ÿ]{4,}", s or "")})

    def fitted(items: list[tuple[bytes, int]], rounds: int) -> Network:
        noise = _noise(rng, names, max(64, len(items) // 10))
        items = items + [(w, NONE) for w in noise]
        net = Network(rng)
        net.fit([w for w, _ in items], np.array([y for _, y in items]), rounds, rng)
        return net

    shifted = [(w[k:] if k < len(w) - 12 else w, y) for w, y in clean for k in (0, 5, 17, 31)]
    net = fitted(shifted, 3 * epochs) if clean else Network(rng)
    held = [w for c, w in documents if c in number]
    label = np.array([number[c] for c, _ in documents if c in number], np.int64)
    for rounds in (max(1, epochs // 2), epochs):  # label, keep what agrees with the document's label, train anew
        if not held:
            break
        agree = np.flatnonzero((net.probabilities(held).argmax(1) == label) & (np.fromiter(map(len, held), np.int64, len(held)) >= 24))
        more = []
        for y in range(NONE):
            mine = agree[label[agree] == y]
            more += [(held[i], y) for i in rng.permutation(mine)[:TRAINING_WINDOWS]]
        net = fitted(clean * 2 + more, rounds)
    return net


def training_windows(docs: DataFrame, most: int = TRAINING_DOCUMENTS, per_label: int = LABEL_WINDOWS) -> DataFrame:
    """At most ``per_label`` windows ``(code, window)`` of full sentences for each label, of at most ``most`` labelled documents.

    The documents are those of the smallest hashes of their ids, the windows those of the smallest hashes of their
    bytes, drawn by hash bucket so that no task ranks all windows of a label.
    """
    labelled = docs.select("doc_id", language_code("lang").alias("code")).where("code is not null")
    chosen = labelled.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, out = [], []
            for code, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                made = [w for a, b in sentences(text) if is_sentence(text[a:b]) for w in windows(text[a:b])]
                codes += [code] * len(made)
                out += made
            yield pa.RecordBatch.from_arrays([pa.array(codes, pa.string()), pa.array(out, pa.binary())], names=["code", "window"])

    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").where("text is not null").select("code", "text")
    found = texts.mapInArrow(cut, "code string, window binary").withColumn("h", F.xxhash64("window")).withColumn("b", F.pmod("h", F.lit(_DRAW)))
    ranked = found.withColumn("r", F.row_number().over(Window.partitionBy("code", "b").orderBy("h", "window")))
    return ranked.where(F.col("r") <= per_label // _DRAW).select("code", "window")


_FITTED: dict[str, Network] = {}


def detector(docs: DataFrame, samples: DataFrame, store: str | None = None) -> Network:
    """The network for the labelled sentences and a bounded sample of labelled documents.

    It is fitted once in a process for the same training rows (by their hash). With ``store``, a folder that
    outlives the job, its weights are also written there and read by later jobs with the same rows.
    """
    spark = docs.sparkSession
    clean = [(r["lang"], r["text"]) for r in small(samples.select(language_code("lang").alias("lang"), "text").orderBy("lang", "text"), LABELLED_SENTENCES, "labelled sentences")]
    clean = [x for x in clean if x[0]]
    taken = sorted((r["code"], bytes(r["window"])) for r in training_windows(docs).collect())  # bounded by LABEL_WINDOWS per language
    key = hashlib.sha256(repr((clean, taken, WINDOW, WIDTHS, FILTERS, TRAINING_WINDOWS, BATCH, RATE, train.__defaults__, BLOCK, FITTING)).encode("utf-8", "surrogatepass")).hexdigest()[:32]
    if key not in _FITTED:
        net, path = None, f"{(store or '').rstrip('/')}/language-{key}"
        if store:
            try:
                net = Network.loads(bytes(spark.read.schema("weights binary").parquet(path).first()["weights"]))
            except AnalysisException:  # nothing is saved yet
                net = None
        if net is None:
            net = train(clean, taken)
            if store:
                spark.createDataFrame([(bytearray(net.dumps()),)], "weights binary").coalesce(1).write.mode("ignore").parquet(path)
        _FITTED[key] = net
    return _FITTED[key]


def segment_languages(net: Network, texts: list[str | None]) -> list[list[tuple[int, int, int, float, bool, int]]]:
    """Per text: ``(from, to, class, confidence, full sentence, bytes)`` of each segment that has letters.

    Neighbouring short segments of one line (short sentences, pieces between links and quotes) are
    one full sentence where they are long enough together and of one language.
    """
    items: list[bytes] = []
    plan: list[list[tuple[int, int, int, int, bool, list]]] = []

    def place(part: str) -> tuple[int, int]:
        cut = windows(part)
        items.extend(cut)
        return len(items) - len(cut), len(items)

    def close(short: list[tuple[int, int, int]], text: str, mine: list) -> None:
        """Lay the short segments out, with all of them as one piece where that is a full sentence."""
        ones = [(a, b, *place(text[a:b]), False, n) for a, b, n in short if n >= 3]
        joined = " ".join(text[a:b] for a, b, _ in short) if len(short) > 1 else ""
        if is_sentence(joined):
            mine.append((short[0][0], short[-1][1], *place(joined), True, ones))
        else:
            mine += [(*x[:5], None) for x in ones]
        short.clear()

    for text in texts:
        mine, short = [], []
        for a, b in sentences(text):
            part = text[a:b]
            n = len(_LETTERS.findall(part))
            full = is_sentence(part, n)
            if short and (full or "\n" in text[short[-1][1] : a]):
                close(short, text, mine)
            if full:
                mine.append((a, b, *place(part), True, None))
            elif n:
                short.append((a, b, n))
        if short:
            close(short, text, mine)
        plan.append(mine)
    p = net.probabilities(items)
    size = np.fromiter(map(len, items), np.int64, len(items))
    first, sure, bytes_of = p.argmax(1).tolist(), p.max(1).tolist(), size.tolist()

    def rows_of(a: int, b: int, lo: int, hi: int, full: bool) -> list[tuple[int, int, int, float, bool, int]]:
        if hi - lo == 1:
            return [(a, b, first[lo], sure[lo], full, bytes_of[lo])]
        if hi - lo == 2 and first[lo] == first[lo + 1]:
            x, y, k = bytes_of[lo], bytes_of[lo + 1], first[lo]
            return [(a, b, k, sure[lo] * (x / (x + y)) + sure[lo + 1] * (y / (x + y)), full, x + y)]
        # A long stretch without sentence ends: neighbouring windows of one language form a part.
        rows, start = [], 0
        for i in range(1, hi - lo + 1):
            if i == hi - lo or first[lo + i] != first[lo + start]:
                mean = np.average(p[lo + start : lo + i], axis=0, weights=size[lo + start : lo + i])
                k = first[lo + start]
                at, to = a + (b - a) * start // (hi - lo), a + (b - a) * i // (hi - lo)
                rows.append((at, to, k, float(mean[k]), full, int(size[lo + start : lo + i].sum())))
                start = i
        return rows

    out = []
    for mine in plan:
        rows = []
        for a, b, lo, hi, full, ones in mine:
            made = rows_of(a, b, lo, hi, full)
            if ones is None:
                rows += made
                continue
            alone = [(x, n) for *at, n in ones for x in rows_of(*at)]
            if len(made) == 1 and not any(x[2] not in (made[0][2], NONE) and x[3] >= SURE for x, _ in alone):
                rows += made
                continue
            # Several languages: only neighbours of one language count together.
            lo = 0
            for i in range(1, len(alone) + 1):
                if i == len(alone) or alone[i][0][2] != alone[lo][0][2] or alone[i][0][3] < SURE or alone[lo][0][3] < SURE:
                    part = alone[lo:i]
                    whole = len(part) > 1 and sum(n for _, n in part) >= SENTENCE_WORDS
                    if whole:
                        weight = sum(x[5] for x, _ in part)
                        rows.append((part[0][0][0], part[-1][0][1], part[0][0][2], sum(x[3] * x[5] for x, _ in part) / weight, True, weight))
                    else:
                        rows += [x for x, _ in part]
                    lo = i
        out.append(rows)
    return out


def decide(rows: list[tuple[int, int, int, float, bool, int]]) -> list[tuple[str, float, int]]:
    """``(language, confidence, sentences)`` of a text, most text first."""
    held: dict[int, list[tuple[float, int]]] = {}
    for _, _, k, c, full, size in rows:
        if full and k != NONE and c >= SURE:
            held.setdefault(k, []).append((c, size))
    total = sum(s for x in held.values() for _, s in x)
    out = []
    for k, x in held.items():
        share = sum(s for _, s in x)
        if share < total / 2 and max(c for c, _ in x) < LONE_SURE:
            continue
        out.append((CODES[k], sum(c * s for c, s in x) / share, len(x), share))
    return [x[:3] for x in sorted(out, key=lambda x: (-x[3], x[0]))]


_SCHEMA = (
    "doc_id bigint, long_enough boolean, languages array<struct<lang:string,confidence:double,sentences:int>>, "
    "segments array<struct<start:int,end:int,lang:string,confidence:double>>"
)


def detect(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text", segments: bool = True) -> DataFrame:
    """One row per document: its languages with confidence, and its segments with language and confidence.

    Neighbouring segments of one language are one segment; a segment of no language has the
    language null. A null or empty text, and one without a sentence, has no languages. The array
    of segments stays empty where they are not asked for.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for lo in range(0, len(texts), 256):
                part = texts[lo : lo + 256]
                found = segment_languages(model, part)
                decided = [decide(rows) for rows in found]
                languages = _lists(decided, ["lang", "confidence", "sentences"], [pa.string(), pa.float64(), pa.int32()])
                parts = _lists([_joined(rows, {x[0] for x in d}) if segments else [] for rows, d in zip(found, decided)], ["start", "end", "lang", "confidence"], [pa.int32(), pa.int32(), pa.string(), pa.float64()])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, len(part)), pa.array([long_enough(t) for t in part]), languages, parts], names=["doc_id", "long_enough", "languages", "segments"]
                )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_col).mapInArrow(run, _SCHEMA)


def _lists(rows: list[list[tuple]], names: list[str], kinds: list[pa.DataType]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    columns = list(zip(*[x for r in rows for x in r])) or [()] * len(names)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names))


def _joined(rows: list[tuple[int, int, int, float, bool, int]], held: set[str]) -> list[tuple[int, int, str | None, float]]:
    """Neighbouring segments of one language as one; a piece below a full sentence counts for a language that the text holds."""
    out: list[tuple[int, int, str | None, float]] = []
    weight = 0
    for a, b, k, c, full, size in rows:
        lang = CODES[k] if k != NONE and c >= SURE and (full or CODES[k] in held) else None
        if out and out[-1][2] == lang:
            start, _, _, before = out[-1]
            out[-1] = (start, b, lang, (before * weight + c * size) / (weight + size))
            weight += size
        else:
            out.append((a, b, lang, c))
            weight = size
    return out


def main_language(detected: DataFrame) -> DataFrame:
    """``(doc_id, language, confidence)``: the language with most text of each document that has one."""
    first = F.get("languages", F.lit(0))
    return detected.where(F.size("languages") > 0).select("doc_id", first["lang"].alias("language"), first["confidence"].alias("confidence"))


def document_languages(detected: DataFrame) -> DataFrame:
    """``(doc_id, lang, confidence, sentences, rank)``: one row per language of a document; one null row where there is none."""
    return detected.select("doc_id", F.posexplode_outer("languages").alias("rank", "l")).select("doc_id", "l.lang", "l.confidence", "l.sentences", "rank")


def document_segments(detected: DataFrame) -> DataFrame:
    """``(doc_id, segment_no, start, end, lang, confidence)`` of the segments, limits in characters."""
    return detected.select("doc_id", F.posexplode("segments").alias("segment_no", "s")).select("doc_id", "segment_no", "s.start", "s.end", "s.lang", "s.confidence")


def mislabelled(docs: DataFrame, detected: DataFrame) -> DataFrame:
    """``(doc_id, lang)`` for documents with a missing or wrong label or sentences in several languages."""
    joined = docs.select(F.col("doc_id").cast("long").alias("doc_id"), language_code("lang").alias("label")).join(
        detected.where(F.col("long_enough") & (F.size("languages") > 0)).select("doc_id", "languages"), "doc_id"
    )
    wrong = F.col("label").isNull() | (F.size("languages") > 1) | (F.get("languages", F.lit(0))["lang"] != F.col("label"))
    return joined.where(wrong).select("doc_id", F.explode("languages.lang").alias("lang"))
