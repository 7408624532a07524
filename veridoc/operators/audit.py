"""Limits, orders, evidence of bounded size, and totals with their zeros."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veridoc.functions.hashing import canonical_json, commitment
from veridoc.operators.calibration import PAIRS


class LimitExceeded(ValueError):
    """More than a stated limit: the result is refused, never cut."""


def within(df: DataFrame, most: int, what: str) -> DataFrame:
    """T4: ``df`` unchanged if it has at most ``most`` rows, else an error."""
    if df.limit(most + 1).count() > most:
        raise LimitExceeded(f"{what}: more than {most} rows")
    return df


def bounded_text(text: Column | str, tokens: Column | str, most_bytes: int, most_tokens: int) -> Column:
    """Which ceiling a text breaks: 'bytes', 'tokens' or null."""
    return F.when(F.octet_length(text) > most_bytes, "bytes").when(F.size(tokens) > most_tokens, "tokens")


def numeric_order(identifier: Column | str) -> list[Column]:
    """Order of decimal texts by value without parsing: by length, then by text."""
    c = F.col(identifier) if isinstance(identifier, str) else identifier
    return [F.length(c), c]


def totals_with_zeros(selections: DataFrame, records: DataFrame, key: str, measures: dict[str, Column]) -> DataFrame:
    """Measures of every selection, zero where it has no record, with a row '(all)' for the whole."""
    per = records.groupBy(key).agg(*[m.alias(n) for n, m in measures.items()])
    each = selections.select(key).distinct().join(per, key, "left").select(key, *[F.coalesce(n, F.lit(0)).alias(n) for n in measures])
    whole = each.agg(*[F.sum(n).alias(n) for n in measures]).select(F.lit("(all)").alias(key), *measures)
    return each.unionByName(whole)


#: What a public text must not show: drive or home paths, mail addresses, web addresses.
PUBLIC = r"(?:^|[\s\"'(])(?:[A-Za-z]:\\|/(?:home|root|Users)/)|[\w.+-]+@[\w-]+\.\w|https?://"


def public_leaks(text: Column | str) -> Column:
    """P43."""
    return F.coalesce(F.rlike(text, F.lit(PUBLIC)), F.lit(False))


def paginate(fetch: Callable[[str | None], tuple[list, str | None]], most_requests: int, most_records: int) -> list:
    """All records over pages; a token seen before and too many requests or records are errors."""
    out, token, seen = [], None, set()
    for _ in range(most_requests):
        page, token = fetch(token)
        out += page
        if len(out) > most_records:
            raise LimitExceeded(f"more than {most_records} records")
        if token is None:
            return out
        if token in seen:
            raise ValueError("a page token came twice")
        seen.add(token)
    raise LimitExceeded(f"more than {most_requests} requests")


def run_identity(settings: dict) -> str:
    """ST2: the identity of a run: the hash of its settings in canonical form."""
    import hashlib

    return hashlib.sha256(canonical_json(settings)).hexdigest()


def generated_items(spark: SparkSession, per_pair: int = 8) -> DataFrame:
    """M5: evaluation items of the generated corpus: pairs x items x two forms with swapped options."""
    rows = [(p["id"], *p["poles"], p["domains"][0][1], p["domains"][0][2]) for p in PAIRS]
    d = spark.createDataFrame(rows, "pair_id string, pole_a string, pole_b string, option_a string, option_b string")
    d = d.withColumn("number", F.explode(F.sequence(F.lit(1), F.lit(per_pair)))).withColumn("swapped", F.explode(F.array(F.lit(False), F.lit(True))))
    first, second = F.when(F.col("swapped"), F.col("option_b")).otherwise(F.col("option_a")), F.when(F.col("swapped"), F.col("option_a")).otherwise(F.col("option_b"))
    return d.select(
        F.concat_ws("-", "pair_id", F.lpad(F.col("number").cast("string"), 2, "0")).alias("item_id"), F.when(F.col("swapped"), "f2").otherwise("f1").alias("form_id"), F.col("pole_a").alias("reference_pole"),
        F.concat(F.lit("Case "), "number", F.lit(": either "), first, F.lit(" or "), second, F.lit(". Which way is right?")).alias("prompt"), "option_a", "option_b",
    )


def effect_estimates(rows: DataFrame, group: str, x: Column, y: Column) -> DataFrame:
    """Planned estimands: mean difference, slope, correlation and its sign by group."""
    g = rows.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.avg(y - x).alias("mean_difference"), F.regr_slope(y, x).alias("slope"), F.corr(x, y).alias("correlation"))
    return g.withColumn("sign", F.signum("correlation").cast("int"))


def page_starts(total: int, cell: str, key: bytes, domain: str, size: int = 5, pages: int = 5) -> list[int]:
    """Starts of ``pages`` disjoint pages of ``size`` results, chosen by a keyed hash of the cell and the slot.

    A slot whose block is taken moves on to the next free one. Too few results for the pages are an error.
    """
    blocks = total // size
    if blocks < pages:
        raise ValueError(f"{cell}: {total} results hold fewer than {pages} pages of {size}")
    taken: list[int] = []
    for slot in range(pages):
        block = int(commitment(key, domain, f"{cell}\0{slot}".encode()), 16) % blocks
        while block in taken:
            block = (block + 1) % blocks
        taken.append(block)
    return [size * b for b in taken]
