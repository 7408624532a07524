"""One small local session for all tests, and tables that hold every kind of bad row."""

from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "3g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s


@pytest.fixture(scope="session")
def data():
    return os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


CLASHING = ["id", "key", "n", "rank", "bucket", "value", "tuple", "code", "chunk", "pos", "text_a", "class_id", "_salt", "source_key", "signature", "h", "t", "w"]


@pytest.fixture(scope="session")
def folders(spark, data, tmp_path_factory):
    """Three data folders made from the smallest tables: ``empty`` (no rows), ``nulls`` (the rows twice,
    each also with every nullable column null), ``clash`` (further columns with names that operators use)."""
    from pyspark.sql import functions as F

    root = tmp_path_factory.mktemp("edge")
    for name in sorted(os.listdir(data)):
        df = spark.read.parquet(f"{data}/{name}")
        key = df.columns[0]
        df.limit(0).write.parquet(f"file://{root}/empty/{name}")
        part = df.limit(30)
        nulled = part.select(key, *[F.lit(None).cast(t).alias(c) for c, t in df.dtypes if c != key])
        if dict(df.dtypes)[key] in ("bigint", "int"):
            nulled = nulled.withColumn(key, (F.col(key) + 100_000).cast(dict(df.dtypes)[key]))
        df.unionByName(part).unionByName(nulled).write.parquet(f"file://{root}/nulls/{name}")
        more = df.withColumns({c: F.lit("x") for c in CLASHING if c not in df.columns})
        more.write.parquet(f"file://{root}/clash/{name}")
    return {k: f"{root}/{k}" for k in ("empty", "nulls", "clash")}
