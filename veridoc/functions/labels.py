"""Canonical forms of labels, paths and language codes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veridoc.runtime import clean

# Two-letter code, three-letter code(s) and English name of the project's languages.
LANGUAGES = {
    "en": ["eng", "english"],
    "de": ["deu", "ger", "german"],
    "fr": ["fra", "fre", "french"],
    "es": ["spa", "spanish"],
    "pt": ["por", "portuguese"],
    "it": ["ita", "italian"],
    "nl": ["nld", "dut", "dutch"],
    "sv": ["swe", "swedish"],
    "ru": ["rus", "russian"],
    "ja": ["jpn", "japanese"],
}


def language_code(label: Column | str) -> Column:
    """Two-letter code of a language label in any letter case, with or without a region.

    Null for a missing, empty or placeholder label and for any language outside the list.
    """
    base = F.regexp_extract(clean(label), r"^([a-z]+)(?:[-_ ].*|\s*\(.*)?$", 1)
    pairs = [x for code, names in LANGUAGES.items() for name in (code, *names) for x in (F.lit(name), F.lit(code))]
    return F.element_at(F.create_map(*pairs), base)


def path_key(path: Column | str) -> Column:
    """Identity of a content path: separators, letter case, doubled separators and a leading ./ or / ignored."""
    c = F.col(path) if isinstance(path, str) else path
    c = F.lower(F.trim(c))
    c = F.regexp_replace(c, r"\\+", "/")
    c = F.regexp_replace(c, r"/(?:\./)+", "/")
    c = F.regexp_replace(c, r"^(?:file:)?(?:\.?/+)+", "")
    return F.regexp_replace(c, r"/{2,}", "/")


def domain_label(label: Column | str) -> Column:
    """Domain in lower case with hyphens between its words."""
    return F.regexp_replace(clean(label), r"[_\s]+", "-")
