"""Records equal apart from form, found by dictionary encoding.

Every distinct value is reduced to a canonical form once per batch, every distinct canonical
value gets an integer, a record becomes the sorted tuple of its (field, value) integers, and the
compact tuples are grouped.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veridoc.functions.text import alnum_table, fold
from veridoc.runtime import materialise, salted_join

#: Rows of one key that go to one task in the joins of this module.
ROWS_PER_SHARE = 50_000
_DIGEST = 16
#: Characters canonicalised at once in a worker.
CHUNK_CHARS = 1 << 21


def canonical_digests(values: list[str], tag: bytes = b"s") -> list[bytes | None]:
    """128-bit digests of the letters and digits of each value after folding; None where it has none."""
    folded = [fold(v) for v in values]
    out: list[bytes | None] = []
    lo = 0
    table = alnum_table()
    while lo < len(folded):
        hi, size = lo, 0
        while hi < len(folded) and (hi == lo or size + len(folded[hi]) <= CHUNK_CHARS):
            size += len(folded[hi])
            hi += 1
        code = np.frombuffer("".join(folded[lo:hi]).encode("utf-32-le", "surrogatepass"), np.uint32)
        keep = table[code]
        ends = np.cumsum([len(t) for t in folded[lo:hi]])
        kept = np.concatenate([[0], np.cumsum(keep)])[np.concatenate([[0], ends])]
        letters = memoryview(code[keep].tobytes())
        for a, b in zip(kept[:-1].tolist(), kept[1:].tolist()):
            out.append(hashlib.blake2b(tag + letters[4 * a : 4 * b], digest_size=_DIGEST).digest() if b > a else None)
        lo = hi
    return out


def document_values(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(record_id, field, value BINARY)`` of each text with a letter or digit: one field, its canonical digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            coded = batch.column(1).dictionary_encode()
            digests = pa.array([*canonical_digests(coded.dictionary.to_pylist())], pa.binary())
            values = digests.take(coded.indices)
            made = pa.RecordBatch.from_arrays([batch.column(0), pa.array(["text"] * len(values)), values], names=["record_id", "field", "value"])
            yield made.filter(values.is_valid())

    return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(run, "record_id bigint, field string, value binary")


def leaves(node: object, path: str = "") -> Iterator[tuple[str, str, str]]:
    """``(path, kind, text)`` of each leaf of a JSON value; lists and objects also state their size."""
    if isinstance(node, dict):
        yield path, "object", str(len(node))
        for key, value in node.items():
            yield from leaves(value, f"{path}.{json.dumps(key)}")
    elif isinstance(node, list):
        yield path, "list", str(len(node))
        for i, value in enumerate(node):
            yield from leaves(value, f"{path}[{i}]")
    elif isinstance(node, str):
        yield path, "string", node
    elif node is None or isinstance(node, bool):
        yield path, "const", str(node)
    else:
        yield path, "number", repr(int(node) if isinstance(node, float) and node.is_integer() else node)


def json_values(lines: DataFrame, id_col: str = "line_id", body_col: str = "body") -> DataFrame:
    """``(record_id, field, value BINARY)`` of each leaf of each line that is a whole JSON object.

    A null line, a cut-off line and a line that is no object have no rows. Strings are compared
    by their letters and digits, numbers by value, true, false and null as such; a string never
    equals a number, and list order counts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], bytes] = {}
        for batch in batches:
            ids, fields, keys = [], [], []
            for record, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    node = json.loads(body.lstrip("﻿")) if body else None
                except (ValueError, RecursionError):
                    continue
                if not isinstance(node, dict):
                    continue
                for path, kind, text in leaves(node):
                    ids.append(record)
                    fields.append(path)
                    keys.append((kind, text))
            new = [k for k in dict.fromkeys(keys) if k not in held]
            plain = [k for k in new if k[0] == "string"]
            for k, digest in zip(plain, canonical_digests([k[1] for k in plain])):
                held[k] = digest or hashlib.blake2b(b"s", digest_size=_DIGEST).digest()
            for k in new:
                if k[0] != "string":
                    held[k] = hashlib.blake2b(f"{k[0]}\0{k[1]}".encode(), digest_size=_DIGEST).digest()
            values = [held[k] for k in keys]
            if len(held) > 200_000:
                held.clear()
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(fields, pa.string()), pa.array(values, pa.binary())], names=["record_id", "field", "value"]
            )

    return lines.select(F.col(id_col).cast("long"), body_col).mapInArrow(run, "record_id bigint, field string, value binary")


def encode(values: DataFrame) -> DataFrame:
    """``(record_id, tuple ARRAY<BIGINT>)``: each record as the sorted integers of its field-value pairs.

    The dictionary holds each distinct (field, canonical value) once, with an integer given by
    its place in the written table. A pair that a third of all records share is counted in the
    dictionary and joined in shares.
    """
    values = materialise(values, "values")
    counted = values.groupBy("field", "value").agg(F.count(F.lit(1)).alias("uses"))
    dictionary = materialise(counted.withColumn("code", F.monotonically_increasing_id()), "dictionary")
    coded = salted_join(values, dictionary, ["field", "value"], "uses", ROWS_PER_SHARE).select("record_id", "code")
    return coded.groupBy("record_id").agg(F.array_sort(F.collect_set("code")).alias("tuple"))


def collapse(values: DataFrame) -> DataFrame:
    """``(record_id, kept_id, n_copies)`` of every record that took part; kept_id is the group's smallest id.

    Repeated ids count as one record. Records without values (see the functions above) are left
    out: they equal nothing.
    """
    tuples = materialise(encode(values), "tuples")
    groups = materialise(tuples.groupBy("tuple").agg(F.min("record_id").alias("kept_id"), F.count(F.lit(1)).alias("n_copies")), "groups")
    several = groups.where("n_copies > 1")
    members = salted_join(tuples, several, ["tuple"], "n_copies", ROWS_PER_SHARE).select("record_id", "kept_id", "n_copies")
    single = groups.where("n_copies = 1").select(F.col("kept_id").alias("record_id"), "kept_id", "n_copies")
    return members.unionByName(single)


def found(docs: DataFrame, lines: DataFrame) -> DataFrame:
    """``(record_set, kept_id, copy_id)``: each record but the smallest of its group."""
    parts = []
    for name, values in (("documents", document_values(docs)), ("raw_manifest", json_values(lines))):
        parts.append(copies_of(values).select(F.lit(name).alias("record_set"), "kept_id", "copy_id"))
    return parts[0].unionByName(parts[1])


def copies_of(values: DataFrame) -> DataFrame:
    return collapse(values).where("n_copies > 1 and record_id <> kept_id").select("kept_id", F.col("record_id").alias("copy_id"))


def collapsed(docs: DataFrame, lines: DataFrame) -> DataFrame:
    """``(record_set, kept_id, n_copies)``: one row for each group, single records and records without values included."""
    parts = []
    for name, values, ids in (("documents", document_values(docs), docs.select("doc_id")), ("raw_manifest", json_values(lines), lines.select("line_id"))):
        took = materialise(collapse(values), "collapsed")
        kept = took.where("record_id = kept_id").select("kept_id", "n_copies")
        ids = ids.select(F.col(ids.columns[0]).cast("long").alias("record_id")).where("record_id is not null").distinct()
        alone = ids.join(took, "record_id", "left_anti").select(F.col("record_id").alias("kept_id"), F.lit(1).cast("bigint").alias("n_copies"))
        parts.append(kept.unionByName(alone).select(F.lit(name).alias("record_set"), "kept_id", "n_copies"))
    return parts[0].unionByName(parts[1])
