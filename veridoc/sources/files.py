"""Files and JSON lines read strictly, and written so that nothing is overwritten by mistake."""

from __future__ import annotations

import json
import tomllib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def json_lines(spark: SparkSession, path: str, schema: str, required: list[str] | None = None, closed: bool = True) -> tuple[DataFrame, DataFrame]:
    """Typed rows and ``problems (line, problem)`` of a JSON lines file or folder.

    A blank line, a line that is no object, one that repeats a key at any level and, if ``closed``,
    one with missing or further keys is a problem and no row.
    """
    kind = T.StructType.fromDDL(schema)
    names = required or kind.fieldNames()

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def pairs(items: list[tuple[str, object]]) -> dict:
            keys = [k for k, _ in items]
            if len(set(keys)) < len(keys):
                raise ValueError("repeated key")
            return dict(items)

        for b in batches:
            out = []
            for line in b["value"]:
                problem = None
                try:
                    node = json.loads(line, object_pairs_hook=pairs) if line.strip() else None
                    if not line.strip():
                        problem = "blank line"
                    elif not isinstance(node, dict):
                        problem = "no object"
                    elif closed and set(node) != set(names):
                        problem = f"missing {sorted(set(names) - set(node))}, further {sorted(set(node) - set(names))}"
                except ValueError as error:
                    problem = str(error) if str(error) == "repeated key" else "unreadable"
                out.append(problem)
            yield b.assign(problem=out)

    checked = spark.read.text(path).mapInPandas(check, "value string, problem string")
    rows = checked.where("problem is null").select(F.from_json("value", kind, {"mode": "FAILFAST"}).alias("r")).select("r.*")
    return rows, checked.where("problem is not null").select(F.col("value").alias("line"), "problem")


def text_files(spark: SparkSession, folder: str, most_bytes: int) -> tuple[DataFrame, DataFrame]:
    """``(path, text, bytes, sha256)`` of readable files and ``problems (path, problem)``.

    Too large files are refused by their length, before their content is read.
    """
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    large = f.where(F.col("length") > most_bytes).select("path", F.lit("too large").alias("problem"))
    small = f.where(F.col("length") <= most_bytes)
    problem = F.when(F.col("length") == 0, "blank").when(~F.is_valid_utf8("content"), "not UTF-8").when(F.contains(F.hex("content"), F.lit("00")) & F.col("content").cast("string").contains("\0"), "null character").when(F.trim(F.decode("content", "UTF-8")) == "", "blank")
    good = small.where(problem.isNull()).select("path", F.decode("content", "UTF-8").alias("text"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    return good, small.where(problem.isNotNull()).select("path", problem.alias("problem")).unionByName(large)


def verified_snapshot(spark: SparkSession, folder: str, expected: DataFrame) -> DataFrame:
    """M3: ``(name, status)`` of the files of a folder against the stated ``(name, size_bytes, sha256)``: 'missing', 'unexpected',
    'size differs', 'hash differs' or 'ok'. Files are hashed where they are read; nothing is gathered."""
    seen = spark.read.format("binaryFile").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("_size"), F.sha2("content", 256).alias("_sha"))
    j = expected.select("name", "size_bytes", F.lower("sha256").alias("sha256"), F.lit(True).alias("_stated")).join(seen, "name", "full_outer")
    status = F.when(F.col("_sha").isNull(), "missing").when(F.col("_stated").isNull(), "unexpected").when(~F.col("size_bytes").eqNullSafe(F.col("_size")), "size differs").when(~F.col("sha256").eqNullSafe(F.col("_sha")), "hash differs").otherwise("ok")
    return j.select("name", status.alias("status"))


def json_object(payload: bytes, label: str) -> dict:
    """A JSON object without repeated keys."""

    def pairs(items: list[tuple[str, object]]) -> dict:
        if len({k for k, _ in items}) < len(items):
            raise ValueError(f"{label}: repeated key")
        return dict(items)

    value = json.loads(payload, object_pairs_hook=pairs)
    if not isinstance(value, dict):
        raise ValueError(f"{label}: no object")
    return value


def settings(path: str) -> dict:
    """A TOML file."""
    with open(path, "rb") as handle:
        return tomllib.load(handle)


def write_new(df: DataFrame, path: str, form: str = "parquet") -> None:
    """K2, K3: write a table that does not exist yet; Spark's commit protocol publishes it whole or not at all."""
    df.write.mode("errorifexists").format(form).save(path)


def append_new(df: DataFrame, path: str, key: str) -> int:
    """K4, ST2: append the rows whose key the table does not hold yet, once each; how many those were."""
    spark = df.sparkSession
    fresh = df.dropDuplicates([key])
    hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hpath):
        fresh = fresh.join(spark.read.parquet(path).select(key), key, "left_anti")
    fresh = fresh.cache()
    n = fresh.count()
    if n:
        fresh.write.mode("append").parquet(path)
    fresh.unpersist()
    return n


def package(tables: dict[str, DataFrame], path: str) -> DataFrame:
    """K7: write named tables as text files of JSON lines and return ``(name, rows, sha256)``, hashes independent of row order."""
    made = None
    for name, df in tables.items():
        lines = df.select(F.to_json(F.struct(*sorted(df.columns))).alias("value"))
        lines.write.mode("errorifexists").text(f"{path}/{name}")
        # Sums of the digests' parts do not depend on the order of rows and add up in any number of steps.
        part = [F.conv(F.substring("h", 1 + 8 * i, 8), 16, 10).cast("decimal(20,0)") for i in range(8)]
        sums = lines.select(F.sha2("value", 256).alias("h")).agg(F.count(F.lit(1)).alias("rows"), *[F.coalesce(F.sum(c), F.lit(0)).alias(f"s{i}") for i, c in enumerate(part)])
        row = sums.select(F.lit(name).alias("name"), "rows", F.sha2(F.concat_ws(",", "rows", *[F.col(f"s{i}").cast("string") for i in range(8)]), 256).alias("sha256"))
        made = row if made is None else made.unionByName(row)
    if made is None:
        raise ValueError("a package needs a table")
    return made
