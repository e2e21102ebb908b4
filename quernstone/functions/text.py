"""Text expressions: cleaning, tokens, terms, splitting and packing, tables."""

from __future__ import annotations

import itertools
import math
import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Limits of chunking, in tokens.
PARENT_MAX, CHILD_TARGET, CHILD_MAX = 3000, 500, 700
PIECE_MAX, BUFFER_MAX, TABLE_PART_MAX = 520, 560, 540
#: Fixed value: tokens counted for one that the pattern finds.
TOKEN_FACTOR = 1.1
#: The token and term patterns. ``\w`` is spelled out, as engines differ on it.
TOKEN = r"\s*[\p{L}\p{N}_]{1,8}|\s*[^\p{L}\p{N}_\s]|\s+"
TERM = r"[\p{L}\p{N}_][\p{L}\p{N}_-]+[\p{L}\p{N}_]"


def clean_text(x: Column) -> Column:
    """White space collapsed and stripped; null is empty."""
    return F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), r"\s+", " "))


def clean_value(x: Column) -> Column:
    """Stripped text, null if nothing is left."""
    return F.nullif(F.trim(x), F.lit(""))


def tokens(x: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(x, F.lit("")), F.lit(TOKEN), 0)


def decode_tokens(x: Column) -> Column:
    return F.array_join(x, "")


def token_count(x: Column) -> Column:
    """Found tokens times the factor, rounded up. The factor is a double: its binary value decides on which side of a whole number a product falls."""
    return F.ceil(F.regexp_count(F.coalesce(x, F.lit("")), F.lit(TOKEN)).cast("double") * F.lit(TOKEN_FACTOR)).cast("int")


def lexical_terms(x: Column) -> Column:
    """Distinct lower-case terms of three or more characters, in order of appearance."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(x, F.lit("")), F.lit(TERM), 0), F.lower))


def term_overlap(a: Column, b: Column) -> Column:
    """Shared terms over the smaller set; 0 if one is empty."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / least)


def collapse_punctuation(x: Column) -> Column:
    """More than 20 of one punctuation mark in a row become one."""
    return F.regexp_replace(x, r"([^\p{L}\p{N}_\s])\1{20,}", "$1")


def sentences(x: Column) -> Column:
    return F.split(x, r"(?<=[.!?])\s+")


def pack_groups(items: Column, limit: int) -> Column:
    """Greedy packing: ARRAY<STRUCT<n, ...>> in order to ARRAY<INT>, a group number for each item.

    A group ends before the item that would carry its sum of n past the limit; an item
    larger than the limit is a group of its own.
    """
    state = F.struct(F.lit(0).alias("group"), F.lit(0).alias("sum"), F.array().cast("array<int>").alias("out"))

    def step(s: Column, item: Column) -> Column:
        flush = (F.size(s["out"]) > 0) & (s["sum"] + item["n"] > limit)
        group = F.when(flush, s["group"] + 1).otherwise(s["group"])
        return F.struct(group.alias("group"), F.when(flush, item["n"]).otherwise(s["sum"] + item["n"]).cast("int").alias("sum"), F.concat(s["out"], F.array(group)).alias("out"))

    return F.aggregate(items, state, step)["out"]


_SPACE = r"[ \t\n\x0B\f\r]"
_TOKEN = re.compile(rf"{_SPACE}*\w{{1,8}}|{_SPACE}*[^\w \t\n\x0B\f\r]|{_SPACE}+")
_REPEATED = re.compile(r"([^\w \t\n\x0B\f\r])\1{20,}")
_SENTENCE_END = re.compile(rf"(?<=[.!?]){_SPACE}+")
_SPACES = re.compile(rf"{_SPACE}+")


def count_tokens(text: str) -> int:
    """``token_count`` for Python code."""
    return math.ceil(sum(1 for _ in _TOKEN.finditer(text)) * TOKEN_FACTOR)


def pack_texts(parts: list[str], limit: int) -> list[str]:
    """Parts joined by spaces, each result's sum of counts within the limit if it has more than one part."""
    out: list[list[str]] = []
    used = 0
    for part in parts:
        n = count_tokens(part)
        if not out or used + n > limit:
            out.append([])
            used = 0
        out[-1].append(part)
        used += n
    return [" ".join(p) for p in out]


def split_text(text: str | None, limit: int = PIECE_MAX) -> list[str]:
    """Pieces of one text: see ``split_pieces``."""
    clean = _REPEATED.sub(r"\1", _SPACES.sub(" ", text or "").strip(" "))
    if not clean or count_tokens(clean) <= limit:
        return [clean] if clean else []
    out: list[str] = []
    for is_long, run in itertools.groupby(_SENTENCE_END.split(clean), lambda s: count_tokens(s) > limit):
        if is_long:
            out += [piece for sentence in run for piece in pack_texts(sentence.split(" "), limit)]
        else:
            out += pack_texts(list(run), limit)
    return out


def split_pieces(x: Column, limit: int = PIECE_MAX) -> Column:
    """An oversized text as ARRAY<STRING>: whole sentences are packed up to the limit; one that is too long is packed by words.

    Clean texts within the limit stay whole. The limit applies to the sum of the parts'
    counts. Packing is a loop over what has been packed so far, so it runs on Arrow batches: a
    fold over arrays would copy its result for each part.
    """

    @F.pandas_udf("array<string>")
    def pieces(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: split_text(t, limit))

    return pieces(x)


def escape_cell(x: Column) -> Column:
    return F.replace(x, F.lit("|"), F.lit(r"\|"))


def escape_html(x: Column) -> Column:
    for old, new in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        x = F.replace(x, F.lit(old), F.lit(new))
    return x


def padded(row: Column, width: Column) -> Column:
    """A row of cells filled up with empty ones."""
    missing = F.greatest(width - F.size(row), F.lit(0))
    return F.concat(row, F.when(missing > 0, F.array_repeat(F.lit(""), missing.cast("int"))).otherwise(F.array().cast("array<string>")))


def table_headers(headers: Column, rows: Column) -> Column:
    """Headers filled up to the widest row with "Column n"."""
    width = F.greatest(F.size(headers), F.coalesce(F.array_max(F.transform(rows, F.size)), F.lit(0)))
    more = F.when(width > F.size(headers), F.transform(F.sequence(F.size(headers) + 1, width), lambda n: F.concat(F.lit("Column "), n.cast("string")))).otherwise(F.array().cast("array<string>"))
    return F.concat(headers, more)


def markdown_table(headers: Column, rows: Column) -> Column:
    """A pipe table. rows: ARRAY<ARRAY<STRING>>; cells are escaped."""
    head = table_headers(headers, rows)
    line = lambda cells: F.concat(F.lit("| "), F.array_join(F.transform(cells, lambda c: escape_cell(F.coalesce(c, F.lit("")))), " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.transform(head, lambda c: F.lit("---")), " | "), F.lit(" |"))
    body = F.transform(rows, lambda r: line(padded(r, F.size(head))))
    return F.array_join(F.concat(F.array(line(head), rule), body), "\n")


def html_table(headers: Column, rows: Column) -> Column:
    head = table_headers(headers, rows)
    cells = lambda r, tag: F.concat(F.lit("<tr>"), F.array_join(F.transform(r, lambda c: F.concat(F.lit(f"<{tag}>"), escape_html(F.coalesce(c, F.lit(""))), F.lit(f"</{tag}>"))), ""), F.lit("</tr>"))
    body = F.array_join(F.transform(rows, lambda r: cells(padded(r, F.size(head)), "td")), "")
    return F.concat(F.lit("<table><thead>"), cells(head, "th"), F.lit("</thead><tbody>"), body, F.lit("</tbody></table>"))


def parse_markdown_table(markdown: Column) -> Column:
    """STRUCT<headers, rows> of a pipe table with a rule line and a row; else null."""
    lines = F.filter(F.split(F.trim(markdown), r"\n"), lambda s: F.trim(s) != "")
    cells = lambda s: F.transform(F.split(F.regexp_replace(F.trim(s), r"^\||(?<!\\)\|$", ""), r"(?<!\\)\|"), lambda c: F.replace(F.trim(c), F.lit(r"\|"), F.lit("|")))
    good = (F.size(lines) >= 3) & F.get(lines, 0).contains("|") & F.get(lines, 1).rlike(r"^[\s|:-]+$")
    return F.when(good, F.struct(cells(F.get(lines, 0)).alias("headers"), F.transform(F.slice(lines, 3, F.greatest(F.size(lines), F.lit(1))), cells).alias("rows")))


def structured_row(headers: Column, row: Column, number: Column) -> Column:
    """``Row n: h = v; ...`` without blank cells."""
    pairs = F.zip_with(headers, row, lambda h, v: F.when(F.trim(F.coalesce(v, F.lit(""))) != "", F.concat(F.coalesce(h, F.lit("")), F.lit(" = "), v)))
    return F.concat(F.lit("Row "), number.cast("string"), F.lit(": "), F.array_join(F.filter(pairs, lambda p: p.isNotNull()), "; "))


def one_column_table(text: Column) -> Column:
    return F.concat(F.lit("| Table segment |\n| --- |\n| "), escape_cell(clean_text(text)), F.lit(" |"))


def retrieval_text(domain: Column, source: Column, section: Column, text: Column, table: Column, exclude_table: Column | None = None) -> Column:
    """Domain, source and section lines, then text and table, each behind an empty line."""
    block = lambda x: F.when(F.coalesce(x, F.lit("")) != "", F.concat(F.lit("\n"), x))
    shown = table if exclude_table is None else F.when(~F.coalesce(exclude_table, F.lit(False)), table)
    return F.concat_ws(
        "\n", F.concat(F.lit("Domain: "), domain), F.concat(F.lit("Source: "), source),
        F.when(F.coalesce(section, F.lit("")) != "", F.concat(F.lit("Section: "), section)), block(text), block(shown),
    )


def page_from_name(name: Column) -> Column:
    """Page number in an image's file name, ``_p12_`` before ``page_12_``."""
    return F.coalesce(F.nullif(F.regexp_extract(name, r"(?i)_p(\d+)_", 1), F.lit("")), F.nullif(F.regexp_extract(name, r"(?i)page_(\d+)_", 1), F.lit(""))).cast("int")


def safe_name(name: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(name, r"[^/\\]*$", 0), r"[^A-Za-z0-9._-]", "_")


def url_name(url: Column) -> Column:
    """Last part of the path without its suffix, or the host with underscores where that says nothing."""
    stem = F.regexp_replace(F.regexp_extract(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), r"([^/]*)/?$", 1), r"\.[^.]*$", "")
    return F.when(~stem.isin("", "drugInfo", "lookup"), stem).otherwise(F.replace(F.try_parse_url(url, F.lit("HOST")), F.lit("."), F.lit("_")))


def element_content(kind: Column, nearby: Column, markdown: Column, text: Column) -> Column:
    return F.when(kind == "image", nearby).when(kind == "table", F.coalesce(markdown, text)).otherwise(text)


def source_label(n: Column, name: Column, section: Column, pages: Column, rows: Column) -> Column:
    """``[n] file | section | pages a, b | rows x-y``, without what is missing."""
    some = lambda x: F.nullif(F.trim(x), F.lit(""))
    page = F.when(F.size(pages) > 0, F.concat(F.lit("pages "), F.array_join(F.transform(pages, lambda p: p.cast("string")), ", ")))
    row = F.when(F.size(rows) > 0, F.concat(F.lit("rows "), F.array_min(rows).cast("string"), F.lit("-"), F.array_max(rows).cast("string")))
    return F.concat_ws(" | ", F.concat(F.lit("["), n.cast("string"), F.lit("] "), F.coalesce(some(name), F.lit(""))), some(section), page, row)


#: Terms in addresses and titles of decoration, and texts of page furniture.
NOISE_IMAGE = (
    "logo", "icon", "favicon", "sprite", "avatar", "button", "social",
    "toplogo", "branding",
)
NAVIGATION = (
    "skip to main content",
    "home news dailymed announcements",
    "report adverse events | recalls",
)


def is_navigation(text: Column) -> Column:
    return F.lower(text).isin(*NAVIGATION)


def is_noise_image(url: Column, alt: Column, title: Column) -> Column:
    return F.lower(F.concat_ws(" ", url, alt, title)).rlike("|".join(NOISE_IMAGE))


@dataclass(frozen=True)
class SignalRule:
    """A passage of a source stands for a table if it has any of the terms, the pattern, and a word so often."""

    source: str
    name: str
    terms: tuple[str, ...]
    pattern: str
    word: str = ""
    times: int = 0

    def holds(self, source: Column, text: Column) -> Column:
        lower = F.lower(text)
        often = F.size(F.split(lower, re.escape(self.word))) > self.times if self.word else F.lit(True)
        return (source == self.source) & lower.rlike("|".join(map(re.escape, self.terms))) & text.rlike(self.pattern) & often


#: The source with such passages, what they speak of, and the names of the two rules.
LABEL = "dailymed_ozempic_prescribing_label"
LABEL_TERMS = ("ozempic", "semaglutide", "placebo", "hba", "plasma glucose", "sitagliptin", "baseline", "end-of-treatment", "randomization", "week 30", "week 56")
SIGNALS = (
    SignalRule(LABEL, "dailymed_clinical_table_or_figure_text", LABEL_TERMS, r"(?i)\b(table|figure)\s+\d+\b"),
    SignalRule(LABEL, "dailymed_treatment_group_count_text", LABEL_TERMS, r"(?i)\bn\s*=\s*\d+", "ozempic", 2),
)


def table_signal(source: Column, text: Column, rules: tuple[SignalRule, ...] = SIGNALS) -> Column:
    """The name of the first rule by which a passage stands for a table; null if none does."""
    clean = clean_text(text)
    return F.coalesce(*[F.when(F.coalesce(rule.holds(source, clean), F.lit(False)), rule.name) for rule in rules])
