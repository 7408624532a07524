"""Session-level helpers: table access, durable intermediate tables, skew-safe joins."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A side is broadcast only while the row count times this many bytes stays below BROADCAST_BYTES.
BROADCAST_BYTES = 32 * 1024 * 1024

_OWN_DIRS: dict[str, str] = {}
_WRITTEN: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data directory (a file or a folder of part files)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors share.

    The cluster names it in ``spark.checkpoint.dir``. Only where that setting is absent in a local
    session a folder of this process is used; on a cluster its absence is an error, because
    executors would write to disks of their own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    key = spark.sparkContext.applicationId
    if key not in _OWN_DIRS:
        _OWN_DIRS[key] = "file://" + tempfile.mkdtemp(prefix="veridoc-")
    return _OWN_DIRS[key]


def materialise(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    It cuts the lineage without recomputation: a lost executor costs nothing that was written
    here. The folder is removed when the process ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let go of the shuffle files of stages whose results are written: they stay until the driver collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _remove_written() -> None:
    for spark, path in _WRITTEN:
        try:
            jvm = spark.sparkContext._jvm
            hpath = jvm.org.apache.hadoop.fs.Path(path)
            hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hpath, True)
        except Exception:  # noqa: BLE001 - the session is already gone
            return


atexit.register(_remove_written)


def parallelism(spark: SparkSession) -> int:
    """Partitions for an explicit repartition: the session's shuffle setting."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small(df: DataFrame, max_rows: int, what: str) -> list:
    """Rows of a table whose size is bounded by its definition; more than ``max_rows`` is an error."""
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise ValueError(f"{what}: more than {max_rows} rows; this step needs a table of bounded size")
    return rows


def few(df: DataFrame, width: int = 32) -> DataFrame:
    """``df`` marked for a broadcast if it is counted to be small enough."""
    limit = BROADCAST_BYTES // width
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def _row_bytes(df: DataFrame, columns: list[str]) -> Column:
    """About the bytes that the given columns of a row take in a broadcast table."""
    size = F.lit(96)
    for name, kind in df.select(*columns).dtypes:
        if kind in ("string", "binary"):
            size = size + F.coalesce(F.octet_length(name), F.lit(0))
        elif kind.startswith("array") and "string" not in kind:
            size = size + 8 * F.coalesce(F.size(name), F.lit(0))
        elif kind.startswith(("array", "map", "struct")):
            size = size + F.coalesce(F.octet_length(F.to_json(name)), F.lit(0))
    return size


def salted_join(
    many: DataFrame, few: DataFrame, keys: list[str], weight: str, per_salt: int, how: str = "inner"
) -> DataFrame:
    """Equi-join of ``many`` with ``few`` (unique per key) when single keys of ``many`` are hot.

    ``few`` carries in ``weight`` the number of rows its key has in ``many``. A key with more than
    ``per_salt`` rows is split into ceil(weight / per_salt) shares. ``many`` cannot know the
    weight before the join, so it draws one 30-bit hash per row, and only the keys that are hot
    are looked up on a side table of hot keys (at most rows / per_salt of them).
    """
    hot = few.where(F.col(weight) > per_salt).select(
        *keys, F.ceil(F.col(weight) / F.lit(per_salt)).cast("int").alias("_shares")
    )
    n_hot, size = hot.agg(F.count(F.lit(1)), F.sum(_row_bytes(few, keys))).first()
    if not n_hot:
        return many.join(few, keys, how)
    share = F.greatest(F.lit(0), F.ceil(F.col(weight) / F.lit(per_salt)).cast("int") - 1)
    spread = few.withColumn("_salt", F.explode(F.sequence(F.lit(0), share)))
    marked = many.join(F.broadcast(hot) if size <= BROADCAST_BYTES else hot, keys, "left")
    others = [c for c in many.columns if c not in keys]
    marked = marked.withColumn("_salt", F.coalesce(F.pmod(F.xxhash64(*others), F.col("_shares")).cast("int"), F.lit(0))).drop("_shares")
    return marked.join(spread, [*keys, "_salt"], how).drop("_salt")


def running_total(df: DataFrame, order: str, value: str, name: str) -> DataFrame:
    """``df`` with the sum of ``value`` over all rows before each row in the order of ``order`` (unique).

    No task sees all rows: rows are range-partitioned, totals of whole partitions (one row each)
    are added up, and each partition then counts on from its own start.
    """
    parts = df.repartitionByRange(parallelism(df.sparkSession), order).withColumn("_part", F.spark_partition_id())
    parts = materialise(parts, "ranges")
    whole = parts.groupBy("_part").agg(F.sum(value).alias("_sum"))
    starts = whole.withColumn("_start", F.coalesce(F.sum("_sum").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = F.coalesce(F.sum(value).over(Window.partitionBy("_part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return parts.withColumn(name, inside).join(starts.select("_part", "_start"), "_part").withColumn(name, F.col(name) + F.col("_start")).drop("_part", "_start")


def clean(column: Column | str) -> Column:
    """Label comparison form: outer whitespace removed, lower case; empty becomes null."""
    c = F.col(column) if isinstance(column, str) else column
    c = F.lower(F.regexp_replace(c, r"^[\s ]+|[\s ]+$", ""))
    return F.when(c == "", None).otherwise(c)
