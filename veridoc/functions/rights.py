"""Licences, categories and identifiers of source records as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_CC = r"^https?://(?:www\.)?creativecommons\.org/"
_ARXIV_DEFAULT = r"^https?://(?:www\.)?arxiv\.org/licenses/nonexclusive-distrib/1\.0/?$"


def _squeezed(text: Column | str) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def licence(text: Column | str) -> Column:
    """P25: ``struct<license_id, rights_status, locator>`` of a licence URL."""
    c = _squeezed(text)
    zero = F.regexp_extract(c, _CC + r"publicdomain/zero/(\d\.\d)/?$", 1)
    by = F.regexp_extract(c, _CC + r"licenses/by/(\d\.\d)/?$", 1)
    mark = F.concat(F.lit("rights-sha256:"), F.sha2(c, 256))
    low = F.lower(c)

    def made(name: Column | str, rights: str, where: Column | str) -> Column:
        lit = lambda x: F.lit(x) if isinstance(x, str) else x
        return F.struct(lit(name).alias("license_id"), F.lit(rights).alias("rights_status"), lit(where).alias("locator"))

    return (
        F.when(c.isNull(), made("missing", "unresolved", "missing-license"))
        .when(zero != "", made(F.concat(F.lit("CC0-"), zero), "eligible", F.concat(F.lit("https://creativecommons.org/publicdomain/zero/"), zero, F.lit("/"))))
        .when(by != "", made(F.concat(F.lit("CC-BY-"), by), "eligible", F.concat(F.lit("https://creativecommons.org/licenses/by/"), by, F.lit("/"))))
        .when(low.contains("creativecommons.org") | low.contains("creative commons"), made("creative-commons-other", "ineligible", mark))
        .when(c.rlike(_ARXIV_DEFAULT), made("arXiv-default", "ineligible", mark))
        .otherwise(made("custom-or-unresolved", "unresolved", mark))
    )


def licence_of_many(texts: Column | str) -> Column:
    """One licence from several statements; it counts only if all name the same known licence."""
    each = F.transform(texts, lambda t: F.when(_squeezed(t).rlike(r"^CC0[- ]\d\.\d$"), licence(F.concat(F.lit("https://creativecommons.org/publicdomain/zero/"), F.substring(_squeezed(t), 5, 3))))
                       .when(_squeezed(t).rlike(r"^CC[- ]BY[- ]\d\.\d$"), licence(F.concat(F.lit("https://creativecommons.org/licenses/by/"), F.substring(_squeezed(t), 7, 3)))).otherwise(licence(t)))
    distinct = F.array_distinct(each)
    joined = F.array_join(F.transform(texts, _squeezed), " | ")
    first = F.get(distinct, F.lit(0))
    known = (F.size(distinct) == 1) & (first["rights_status"] == "eligible")
    return F.when(known, first).when(joined == "", licence(F.lit(None).cast("string"))).otherwise(_unknown(joined))


def _unknown(joined: Column) -> Column:
    low = F.lower(joined)
    other = low.contains("creativecommons.org") | low.contains("creative commons")
    mark = F.concat(F.lit("rights-sha256:"), F.sha2(joined, 256))
    return F.struct(
        F.when(other, "creative-commons-other").otherwise("custom-or-unresolved").alias("license_id"),
        F.when(other, "ineligible").otherwise("unresolved").alias("rights_status"), mark.alias("locator"),
    )


def rights_of(license_id: Column | str) -> Column:
    """Rights status by licence id; null for an unknown id."""
    c = F.col(license_id) if isinstance(license_id, str) else license_id
    return (
        F.when(c.rlike("^(CC0-|CC-BY-)"), "eligible").when(c.isin("creative-commons-other", "arXiv-default"), "ineligible")
        .when(c.isin("custom-or-unresolved", "missing", "pending-arXivRaw-enrichment"), "unresolved")
    )


def category_matches(categories: Column | str, prefixes: list[str]) -> Column:
    """Any category equals a prefix or continues it after a dot."""
    return F.exists(categories, lambda c: F.lit(False) if not prefixes else F.greatest(*[(c == p) | c.startswith(p + ".") for p in prefixes], F.lit(False)))


def normalised_categories(categories: Column | str, vocabulary: list[str], allowed: list[str], forbidden: list[str]) -> Column:
    """Closed labels, sorted and distinct; null where a category inside the allowed stratum is unknown."""
    under = lambda c, ps: F.greatest(F.lit(False), F.lit(False), *[(c == p) | c.startswith(p + ".") for p in ps])
    label = lambda c: F.when(c.isin(vocabulary), c).when(under(c, allowed), None).when(under(c, forbidden), "forbidden-category").otherwise("other-category")
    made = F.transform(categories, label)
    return F.when(~F.exists(made, lambda x: x.isNull()), F.array_sort(F.array_distinct(made)))


def value_evidence(values: Column | str) -> Column:
    """``struct<n, sha256>`` of the sorted distinct values, joined by a null character."""
    kept = F.array_sort(F.array_distinct(values))
    return F.struct(F.size(kept).alias("n"), F.sha2(F.array_join(kept, "\0"), 256).alias("sha256"))


def archive_identifier(url: Column | str) -> Column:
    """``struct<id, version>`` of an archive abstract address; null for other texts."""
    pattern = r"^https?://arxiv\.org/abs/([a-z.-]+/\d{7}|\d{4}\.\d{4,5})(?:v([1-9]\d*))?$"
    c = F.col(url) if isinstance(url, str) else url
    return F.when(c.rlike(pattern), F.struct(F.regexp_extract(c, pattern, 1).alias("id"), F.regexp_extract(c, pattern, 2).try_cast("int").alias("version")))


def article_identifier(identifiers: Column | str) -> Column:
    """The one PMC identifier that a record's identifiers name, bare or as an address; null if they name none or several."""
    found = F.array_distinct(F.array_compact(F.transform(identifiers, lambda x: F.nullif(F.upper(F.regexp_extract(x, r"(?i)(?:^|/)(PMC[1-9]\d*)/?$", 1)), F.lit("")))))
    return F.when(F.size(found) == 1, F.get(found, F.lit(0)))


def header_identity(identifier: Column | str, authority: str) -> Column:
    """The local part of a harvesting identifier ``oai:authority:local``; null for another authority or form."""
    c = F.col(identifier) if isinstance(identifier, str) else identifier
    return F.nullif(F.regexp_extract(c, "^oai:\\Q" + authority + "\\E:(\\S+)$", 1), F.lit(""))
