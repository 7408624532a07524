"""Exact token counts, budgets by slice, and the encoding of a whole corpus."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veridoc.functions.labels import domain_label, language_code, path_key
from veridoc.llm import bpe, language
from veridoc.runtime import clean, materialise


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = bpe.DEFAULT_VOCABULARY, offsets: bool = False) -> DataFrame:
    """Ids of every text under a byte-level BPE vocabulary: ``(id_col, ids ARRAY<INT>)``, with ``offsets`` also
    ``starts ARRAY<BIGINT>``, the byte at which each id starts in its text.

    One narrow pass without a shuffle. Every row comes out once; a null and an empty text both
    have the empty list, a very long text is one row like any other, strings of special tokens in
    a text are ordinary text, repeated rows stay repeated, other columns are dropped.
    """
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe.load(vocabulary)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for lo, hi in bpe.chunks(texts):
                ids, counts = coder.encode(texts[lo:hi])
                limits = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
                columns, names = [batch.column(0).slice(lo, hi - lo), pa.ListArray.from_arrays(limits, pa.array(ids))], [id_col, "ids"]
                if offsets:
                    columns.append(pa.ListArray.from_arrays(limits, pa.array(coder.offsets(ids, counts))))
                    names.append("starts")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>" + (", starts array<bigint>" if offsets else ""))


def decode_documents(encoded: DataFrame, id_col: str = "doc_id", vocabulary: str = bpe.DEFAULT_VOCABULARY) -> DataFrame:
    """``(id_col, text, n_ids, offsets_agree)``: the text of each list of ids; ``offsets_agree`` says whether every id starts at
    the byte that ``starts`` gives."""
    kind = dict(encoded.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe.load(vocabulary)
        for batch in batches:
            texts, counts, agree = [], [], []
            for ids, starts in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                parts = [coder.bytes_of[i] for i in ids]
                at = np.cumsum([0, *map(len, parts)])[:-1]
                texts.append(b"".join(parts).decode("utf-8", "surrogatepass"))
                counts.append(len(ids))
                agree.append(at.tolist() == starts)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(counts, pa.int64()), pa.array(agree, pa.bool_())], names=[id_col, "text", "n_ids", "offsets_agree"])

    return encoded.select(id_col, "ids", "starts").mapInArrow(run, f"`{id_col}` {kind}, text string, n_ids bigint, offsets_agree boolean")


def count_tokens(docs: DataFrame, keep: list[str], text_col: str = "text", vocabulary: str = bpe.DEFAULT_VOCABULARY, net: language.Network | None = None) -> DataFrame:
    """``keep`` columns and ``n_tokens BIGINT`` of each row's text; null and empty texts have 0.

    With a language network the same pass over the texts also gives ``language`` and ``confidence`` of the
    language with most text (null where a text has none).
    """
    kinds = dict(docs.dtypes)
    shared = docs.sparkSession.sparkContext.broadcast(net) if net is not None else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe.load(vocabulary)
        for batch in batches:
            texts = [t or "" for t in batch.column(len(keep)).to_pylist()]
            parts = [coder.counts(texts[lo:hi]) for lo, hi in bpe.chunks(texts)]
            counts = np.concatenate(parts) if parts else np.zeros(0, np.int64)
            columns, names = [*batch.columns[: len(keep)], pa.array(counts, pa.int64())], [*keep, "n_tokens"]
            if shared is not None:
                first = [(language.decide(rows) or [(None, None, 0)])[0] for lo in range(0, len(texts), 256) for rows in language.segment_languages(shared.value, texts[lo : lo + 256])]
                columns += [pa.array([x[0] for x in first], pa.string()), pa.array([x[1] for x in first], pa.float64())]
                names += ["language", "confidence"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", n_tokens bigint" + (", language string, confidence double" if net is not None else "")
    return docs.select(*keep, F.col(text_col)).mapInArrow(run, schema)


def document_tokens(docs: DataFrame, manifest: DataFrame, registry: DataFrame, net: language.Network | None = None, vocabulary: str = bpe.DEFAULT_VOCABULARY) -> DataFrame:
    """One row per document: exact token count and resolved labels.

    The count comes from the text alone; ``word_count`` is not read. ``source`` is compared
    without case and outer spaces and replaced by the manifest's source_id where it is missing;
    ``source_family`` is the registry's for that source, else the manifest's; ``domain`` falls
    back to the registry's; ``era_window`` is the manifest's; a document with several manifest rows
    takes the one received last. ``language`` is the one that the network ``net`` finds in the pass that counts,
    else the label. What stays open is 'unknown' ('und' for language).
    """
    counted = count_tokens(docs, ["doc_id", "lang", "source", "content_path", "domain"], vocabulary=vocabulary, net=net)
    counted = counted.select(
        "doc_id", "n_tokens", path_key("content_path").alias("path_key"), clean("source").alias("doc_source"),
        domain_label("domain").alias("doc_domain"), language_code("lang").alias("label_language"), (F.col("language") if net is not None else F.lit(None).cast("string")).alias("language"),
    )
    latest = (
        manifest.where(F.col("content_path").isNotNull())
        .select(
            path_key("content_path").alias("path_key"), "received_at", "manifest_id",
            clean("source_id").alias("m_source"), F.upper(clean("source_family")).alias("m_family"), clean("era_window").alias("m_era"),
        )
        .groupBy("path_key")
        .agg(F.max(F.struct("received_at", "manifest_id", "m_source", "m_family", "m_era")).alias("m"))
        .select("path_key", "m.m_source", "m.m_family", "m.m_era")
    )
    known = registry.select(
        clean("source_id").alias("source"), F.upper(clean("source_family")).alias("r_family"), domain_label("domain").alias("r_domain")
    ).dropDuplicates(["source"])
    out = counted.join(latest, "path_key", "left").withColumn("source", F.coalesce("doc_source", "m_source"))
    out = out.join(known, "source", "left")
    return out.select(
        "doc_id", "n_tokens",
        F.coalesce("source", F.lit("unknown")).alias("source"),
        F.coalesce("r_family", "m_family", F.lit("unknown")).alias("source_family"),
        F.coalesce("language", "label_language", F.lit("und")).alias("language"),
        F.coalesce("doc_domain", "r_domain", F.lit("unknown")).alias("domain"),
        F.coalesce("m_era", F.lit("unknown")).alias("era_window"),
    )


DIMENSIONS = ["source", "source_family", "language", "domain", "era_window"]


def token_budget(per_document: DataFrame, dimensions: list[str] = DIMENSIONS) -> DataFrame:
    """Totals over the cube of the dimensions; a null dimension stands for "all".

    The counts of the documents are stored once and summed from there: first into base cells (a partial
    aggregate, so a source with a third of all rows is one row per task); only those cells enter the cube.
    """
    cells = materialise(per_document, "counts").groupBy(*dimensions).agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum("n_tokens").alias("n_tokens"), F.count_if(F.col("n_tokens") == 0).alias("n_empty_docs")
    )
    return cells.cube(*dimensions).agg(
        F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"), F.sum("n_empty_docs").alias("n_empty_docs")
    )
