"""SQL for the project's normaliser, for engines that have NFC but neither NFKC nor full case folding.

NFKC is NFC after every character with a compatibility mapping is replaced by it; case folding
replaces single characters. Both tables are computed from the Unicode data of Python, so the SQL
repeats the normaliser of :mod:`veridoc.functions.text` character by character.
"""

from __future__ import annotations

import unicodedata
from functools import cache

_SEPARATOR = "\ue000"  # private use: no mapping holds it


@cache
def tables() -> str:
    """Common table expressions ``km(c, v)`` (compatibility) and ``fm(c, v)`` (case folding)."""
    kinds = {"km": {}, "fm": {}}
    for code in (*range(0xD800), *range(0xE000, 0x110000)):
        c = chr(code)
        if (full := unicodedata.normalize("NFKD", c)) != unicodedata.normalize("NFD", c):
            kinds["km"][c] = full
        if c.casefold() != c:
            kinds["fm"][c] = c.casefold()
    parts = []
    for name, held in kinds.items():
        keys, values = (_SEPARATOR.join(x).replace("'", "''") for x in (held.keys(), held.values()))
        parts.append(f"{name} AS (SELECT unnest(string_split('{keys}','{_SEPARATOR}')) AS c, unnest(string_split('{values}','{_SEPARATOR}')) AS v)")
    return ", ".join(parts)


def folded(out: str, source: str, key: str, text: str) -> str:
    """Common table expressions ending in ``out(k, x)``: the folded ``text`` of each ``key`` (unique) of ``source``; null texts are left out."""
    split = "unnest(string_split({0},'')) AS c, generate_subscripts(string_split({0},''),1) AS i"
    plain = f"regexp_full_match({text}, '[\\x00-\\x7F]*')"
    return (
        f"{out}_c AS (SELECT {key} AS k, {split.format(text)} FROM {source} WHERE NOT {plain}),"
        f" {out}_n AS (SELECT k, nfc_normalize(string_agg(coalesce(v,c),'' ORDER BY i)) AS x FROM {out}_c LEFT JOIN km USING (c) GROUP BY k),"
        f" {out}_d AS (SELECT k, {split.format('x')} FROM {out}_n),"
        f" {out} AS (SELECT k, string_agg(coalesce(v,c),'' ORDER BY i) AS x FROM {out}_d LEFT JOIN fm USING (c) GROUP BY k UNION ALL SELECT {key}, lower({text}) FROM {source} WHERE {plain})"
    )


#: Words of a folded text.
WORDS = r"regexp_extract_all({0}, '[\p{{L}}\p{{N}}]+(?:[-''][\p{{L}}\p{{N}}]+)*')"


def grams(words: str, n: int) -> str:
    """Distinct runs of ``n`` words of a list, joined by blanks."""
    return f"list_distinct(list_transform(range(1, len({words})-{n - 2}), lambda i: array_to_string({words}[i:i+{n - 1}],' ')))"
