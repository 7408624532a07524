"""Rule tables: every broken rule of every record as a row, never only the first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def violations(records: DataFrame, id_col: str, rules: dict[str, Column]) -> DataFrame:
    """V1-V6: ``(id_col, rule)`` for each record and each rule whose condition holds.

    A condition that is null does not hold. One pass: all rules are evaluated in one projection and
    the broken ones exploded, so the cost does not grow with a scan per rule.
    """
    names = [F.when(condition, F.lit(name)) for name, condition in rules.items()]
    return records.select(id_col, F.explode(F.array_compact(F.array(*names))).alias("rule"))


def repeated(records: DataFrame, id_col: str, key: Column | str, rule: str) -> DataFrame:
    """Uniqueness: ``(id_col, rule)`` of the records whose key another record has too; null keys never clash."""
    keyed = records.select(id_col, (F.col(key) if isinstance(key, str) else key).alias("_k")).where("_k is not null")
    often = keyed.groupBy("_k").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    return keyed.join(often, "_k", "left_semi").select(id_col, F.lit(rule).alias("rule"))


def orphans(records: DataFrame, id_col: str, key: Column, known: DataFrame, known_key: Column, rule: str) -> DataFrame:
    """``(id_col, rule)`` of the records whose key is null or has no partner in ``known``."""
    keyed = records.select(id_col, key.alias("_k"))
    return keyed.join(known.select(known_key.alias("_k")).distinct(), "_k", "left_anti").select(id_col, F.lit(rule).alias("rule"))


def not_in(column: str, values: list[str]) -> Column:
    """True for null and for any value outside the list."""
    return F.col(column).isNull() | ~F.col(column).isin(values)


def blank(column: str) -> Column:
    return F.col(column).isNull() | (F.trim(column) == "")


def closed_keys(body: Column | str, required: list[str]) -> tuple[Column, Column]:
    """Missing and extra top-level keys of a JSON text, as sorted arrays; null for text that is no object."""
    keys = F.json_object_keys(body)
    wanted = F.array(*[F.lit(k) for k in required])
    return F.array_sort(F.array_except(wanted, keys)), F.array_sort(F.array_except(keys, wanted))


def portable_path(path: Column | str) -> Column:
    """A relative path that means the same file everywhere.

    Not null, no empty, dot or dot-dot part, forward slashes only, no drive or control
    characters, no part that ends in a dot or blank, no name that a common system reserves.
    """
    p = F.col(path) if isinstance(path, str) else path
    reserved = r"(?i)(^|/)(con|prn|aux|nul|com[0-9]|lpt[0-9])(\.[^/]*)?(/|$)"
    bad = p.rlike(r'[\\:*?"<>|\x00-\x1f]') | p.rlike(r"(^|/)\.{0,2}(/|$)") | p.rlike(r"[. ](/|$)") | p.rlike(reserved)
    return p.isNotNull() & ~bad


def forbidden_keys(mapping: Column | str, names: list[str]) -> Column:
    """The keys of a map that are in the list, in any letter case, sorted."""
    return F.array_sort(F.filter(F.map_keys(mapping), lambda k: F.lower(k).isin(names)))
