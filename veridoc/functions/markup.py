"""Prose from marked-up texts: wikitext, Markdown with HTML, titles; added spans of a revision.

Each cleaner is a chain of small steps that report how much they removed. A step that meets
unbalanced markup raises :class:`MarkupError`; the column functions turn that into a null text
with the error's message.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from difflib import SequenceMatcher
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Vocabularies of the cleaners.
SCHEMES = (
    "bitcoin", "ftp", "ftps", "geo", "git", "gopher", "http", "https", "irc", "ircs", "magnet", "mailto", "mms", "news", "nntp", "redis", "sip", "sips", "sms", "ssh", "svn",
    "tel", "telnet", "worldwind", "xmpp",
)
DROPPED_BLOCKS = (
    "blockquote", "code", "dl", "gallery", "math", "nowiki", "ol", "pre", "ref", "references", "source", "syntaxhighlight", "table", "ul", "caption", "tbody", "tfoot", "thead",
    "tr", "dd", "dt", "li", "td", "th",
)
DROPPED_LINKS = {"category", "file", "image"}
MAGIC_LINES = {"__forcetoc__", "__newsectionlink__", "__noeditsection__", "__nonewsectionlink__", "__notoc__", "__toc__"}
BOILERPLATE = {"any help appreciated", "thank you", "thanks", "thanks!"}
SIGNATURES = {"-- "}
HIDDEN_TAGS = {"blockquote", "code", "pre", "script", "style"}
_LOCATOR = r"(?:(?i:" + "|".join(SCHEMES) + r"):|//)\S"


class MarkupError(ValueError):
    """Markup that cannot be read without guessing."""


def paragraphs(text: str) -> str:
    """NFC, line ends unified, paragraphs split at blank lines, inner white space collapsed."""
    text = unicodedata.normalize("NFC", text).replace("\r\n", "\n").replace("\r", "\n")
    return "\n\n".join(p for p in (" ".join(x.split()) for x in re.split(r"\n[^\S\n]*\n", text)) if p)


def _nested(text: str, opening: str, closing: str, what: str) -> tuple[str, int]:
    """Remove regions between delimiters that may be nested; line breaks inside stay."""
    parts, depth, count, at = [], 0, 0, 0
    for m in re.finditer(f"{re.escape(opening)}|{re.escape(closing)}", text):
        piece = text[at : m.start()]
        parts.append(piece if not depth else "\n" * piece.count("\n"))
        at = m.end()
        if m[0] == opening:
            depth, count = depth + 1, count + 1
        elif not depth:
            raise MarkupError(f"{what} closes without an opening")
        else:
            depth -= 1
    if depth:
        raise MarkupError(f"{what} is not closed")
    parts.append(text[at:])
    return "".join(parts), count


def _templates(text: str) -> tuple[str, int]:
    """Remove templates and parameters, which end with as many braces as they began with."""
    parts, stack, count, at = [], [], 0, 0
    while m := re.compile(r"\{\{\{|\{\{|\}\}").search(text, at):
        piece = text[at : m.start()]
        parts.append(piece if not stack else "\n" * piece.count("\n"))
        at = m.end()
        if m[0] != "}}":
            stack.append(len(m[0]))
            count += 1
        elif not stack or not text.startswith("}" * stack[-1], m.start()):
            raise MarkupError("template delimiters cross")
        else:
            at = m.start() + stack.pop()
    if stack:
        raise MarkupError("a template is not closed")
    parts.append(text[at:])
    return "".join(parts), count


def _blocks(text: str) -> tuple[str, int]:
    count = 0
    for tag in DROPPED_BLOCKS:
        text, n = re.subn(rf"(?is)<\s*{tag}\b[^>]*(?<!/)>.*?<\s*/\s*{tag}\s*>", lambda m: "\n" * m[0].count("\n"), text)
        text, k = re.subn(rf"(?i)<\s*{tag}\b[^>]*/\s*>", "", text)
        count += n + k
        if re.search(rf"(?i)<\s*/?\s*{tag}\b", text):
            raise MarkupError(f"{tag} is not balanced")
    return text, count


def _lines(text: str, drop: Callable[[str], bool]) -> tuple[str, int]:
    """Blank every line for which ``drop`` holds, and count them."""
    kept, n = [], 0
    for line in text.split("\n"):
        gone = drop(line)
        n += gone
        kept.append("" if gone else line)
    return "\n".join(kept), n


def _preformatted(line: str) -> bool:
    return bool(line.strip()) and line[0] in " \t"


def _navigation(line: str) -> bool:
    if line.strip().casefold() in MAGIC_LINES:
        return True
    rest = re.sub(rf"\[\[[^\[\]]+\]\]|\[{_LOCATOR}[^\]]*\]|<[^<>]+>", "", line)
    rest = re.sub(rf"(?<!\w){_LOCATOR}*", "", rest)
    return rest != line and not re.search(r"[^\W_]", rest)


def clean_wikitext(text: str) -> tuple[str, dict[str, int]]:
    """Prose of a wikitext page and how much of each kind of markup was removed."""
    n: dict[str, int] = {}
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    text, n["preformatted_lines"] = _lines(text, _preformatted)
    text, n["comments"] = _nested(text, "<!--", "-->", "a comment")
    text, n["block_tags"] = _blocks(text)
    text, n["templates"] = _templates(text)
    text, n["tables"] = _nested(text, "{|", "|}", "a table")
    text, k = _lines(text, _preformatted)  # what a removed prefix has exposed
    n["preformatted_lines"] += k
    text, n["navigation_lines"] = _lines(text, _navigation)
    n["dropped_links"] = n["retained_link_labels"] = 0

    def link(m: re.Match[str]) -> str:
        target, *labels = m[1].split("|")
        if target.strip().lstrip(":").split(":", 1)[0].strip().casefold() in DROPPED_LINKS:
            n["dropped_links"] += 1
            return ""
        n["retained_link_labels"] += 1
        shown = [x.strip() for x in labels if x.strip()]
        return shown[-1] if shown else target.strip().split("#", 1)[0] if not labels else target.strip()

    text = re.sub(r"\[\[([^\[\]]+)\]\]", link, text)
    if "[[" in text or "]]" in text:
        raise MarkupError("a link is not balanced")

    def outside(m: re.Match[str]) -> str:
        n["retained_link_labels"] += 1
        return (m[1] or "").strip()

    text = re.sub(rf"\[{_LOCATOR}[^\s\]]*(?:\s+([^\]]+))?\]", outside, text)
    text = re.sub(rf"(?<!\w){_LOCATOR}[^\s\]\[<>]*", "", text)
    text, n["list_lines"] = _lines(text, lambda x: bool(re.match(r"[ \t]*[*#;:]", x)))
    text, n["residual_tags"] = re.subn(r"<[^<>]+>", " ", text)
    if "<" in text or ">" in text:
        raise MarkupError("a tag is not balanced")
    text = re.sub(r"(?m)^\s*=+\s*(.*?)\s*=+\s*$", r"\1", text)
    text = re.sub(r"'{2,3}", "", text)
    text = re.sub(rf"(?<!\w){_LOCATOR}[^\s\]\[<>]*", "", text)
    return paragraphs(text), n


class _Visible(HTMLParser):
    """Text that a reader would see: no code, quotes, scripts or styles; entities decoded once."""

    HIDDEN = HIDDEN_TAGS
    BREAKS = {"p", "br", "div", "li", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6", "hr", "table", "tr"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.hidden: list[str] = []
        self.blocks = self.links = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in self.HIDDEN:
            self.blocks += not self.hidden
            self.hidden.append(tag)
        self.links += tag == "a"
        if tag in self.BREAKS:
            self.out.append("\n\n" if tag != "br" else "\n")

    def handle_endtag(self, tag: str) -> None:
        if tag in self.HIDDEN:
            if not self.hidden or self.hidden[-1] != tag:
                raise MarkupError(f"{tag} closes without an opening")
            self.hidden.pop()
        if tag in self.BREAKS:
            self.out.append("\n\n")

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.out.append(data)

    def text(self, source: str) -> str:
        self.feed(source)
        self.close()
        if self.hidden:
            raise MarkupError(f"{self.hidden[-1]} is not closed")
        return "".join(self.out)


def clean_title(text: str) -> str:
    """The visible text of a title, one layer of entities decoded."""
    return paragraphs(_Visible().text(text))


def _indent(line: str) -> int:
    return len(line.expandtabs(4)) - len(line.expandtabs(4).lstrip(" "))


def clean_markdown(text: str) -> tuple[str, dict[str, int]]:
    """Prose of a Markdown body with embedded HTML and how much of each kind was removed."""
    n = dict.fromkeys(("fenced_code_blocks", "indented_code_lines", "inline_code_spans", "quote_lines", "reference_definitions", "links", "boilerplate_lines", "html_blocks", "signature_blocks"), 0)
    kept, fence, quote, labels = [], "", False, set()
    lines = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
    for at, line in enumerate(lines):
        bare = line.strip()
        mark = re.match(r" {0,3}(`{3,}(?!.*`)|~{3,})", line)
        definition = re.match(r" {0,3}\[([^\]\n]+)\]:\s*\S+", line)
        drop = True
        if fence:
            if re.fullmatch(rf" {{0,3}}{re.escape(fence[0])}{{{len(fence)},}}\s*", line):
                fence = ""
        elif line in SIGNATURES:
            n["signature_blocks"] += 1
            kept += [""] * (len(lines) - at)
            break
        elif mark:
            fence = mark[1]
            n["fenced_code_blocks"] += 1
        elif bare and _indent(line) >= 4:
            n["indented_code_lines"] += 1
        elif re.match(r"\s*(?:(?:[*+-]|\d{1,9}[.)])\s+)*>", line) or (quote and bare):
            n["quote_lines"] += 1
            quote = True
        elif bare.casefold() in BOILERPLATE:
            n["boilerplate_lines"] += 1
        elif definition:
            n["reference_definitions"] += 1
            labels.add(" ".join(definition[1].split()).casefold())
        else:
            drop = False
        quote = quote and bool(bare)
        kept.append("" if drop else line)
    if fence:
        raise MarkupError("a code fence is not closed")
    text = "\n".join(kept)
    text, n["inline_code_spans"] = re.subn(r"(?<![\\`])(`+)(?!`)(?:.|\n)+?(?<!`)\1(?!`)", "", text)
    text, k = re.subn(r"(!?)\[([^\]\n]*)\]\((?:[^()\\]|\\.|\((?:[^()\\]|\\.)*\))*\)", lambda m: "" if m[1] else m[2], text)
    if "](" in text:
        raise MarkupError("a link target is not closed")
    text, j = re.subn(r"\[([^\[\]\n]+)\]\[[^\[\]\n]*\]", r"\1", text)
    n["links"] = k + j

    def shortcut(m: re.Match[str]) -> str:
        if " ".join(m[1].split()).casefold() not in labels:
            return m[0]
        n["links"] += 1
        return m[1]

    text = re.sub(r"\[([^\[\]\n]+)\]", shortcut, text)
    text, k = re.subn(rf"<{_LOCATOR}[^<>\s]*>", "", text)
    page = _Visible()
    text = page.text(text)
    n["html_blocks"] = page.blocks
    text = re.sub(r"\*\*|__|~~|(?<!\*)\*(?!\*)|(?<!_)_(?!_)", "", text)
    text, j = re.subn(rf"(?<!\w){_LOCATOR}[^\s<>\[\]]*", "", text)
    n["links"] += k + j + page.links
    text, k = _lines(text, lambda x: x.strip().casefold() in BOILERPLATE)
    n["boilerplate_lines"] += k
    return paragraphs(text), n


def added_spans(before: list[str], after: list[str], most: int = 20_000) -> list[tuple[int, int]]:
    """Limits of the word runs that the later text adds; adjacent runs are one. Longer texts are an error."""
    if max(len(before), len(after)) > most:
        raise MarkupError(f"more than {most} words to align")
    out: list[tuple[int, int]] = []
    for op, _, _, lo, hi in SequenceMatcher(None, before, after, autojunk=False).get_opcodes():
        if op in ("insert", "replace") and hi > lo:
            if out and out[-1][1] == lo:
                out[-1] = (out[-1][0], hi)
            else:
                out.append((lo, hi))
    return out


def _cleaner(clean: Callable[[str], tuple[str, dict[str, int]]], text: Column | str) -> Column:
    def run(values: pd.Series) -> pd.DataFrame:
        rows = []
        for v in values:
            try:
                t, n = clean(v) if v is not None else (None, None)
                rows.append((t, n, None))
            except MarkupError as error:
                rows.append((None, None, str(error)))
        return pd.DataFrame(rows, columns=["text", "removed", "error"])

    return F.pandas_udf(run, "text string, removed map<string,int>, error string")(text)


def wikitext(text: Column | str) -> Column:
    """P13 as ``struct<text, removed, error>``; null for null."""
    return _cleaner(clean_wikitext, text)


def markdown(text: Column | str) -> Column:
    """P14 as ``struct<text, removed, error>``."""
    return _cleaner(clean_markdown, text)


def title(text: Column | str) -> Column:
    """P15 as ``struct<text, removed, error>``."""
    return _cleaner(lambda t: (clean_title(t), {}), text)


def paragraph_text(text: Column | str) -> Column:
    """P12."""
    return F.pandas_udf(_paragraphs, "string")(text)


def _paragraphs(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else paragraphs(v))


def new_spans(before: Column | str, after: Column | str) -> Column:
    """P17 as an array of word arrays."""

    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([[list(y[lo:hi]) for lo, hi in added_spans(list(x), list(y))] if x is not None and y is not None else None for x, y in zip(a, b)])

    return F.pandas_udf(run, "array<array<string>>")(before, after)
