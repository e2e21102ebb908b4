"""Oversized tables to parts, by a cascade of strategies, and excerpts of long texts. Loops over what fits, so on Arrow batches."""

from __future__ import annotations

import html as htmllib
import math
import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.functions.text import _SPACES, _TOKEN, PIECE_MAX, TOKEN_FACTOR, count_tokens, escape_html, one_column_table, split_text
from quernstone.sources.html import markdown_rows

#: Limit of a part, slack before the next strategy is tried, room kept for a row's label and a last-resort table.
PART_MAX, SLACK, ROW_ROOM, SEGMENT_ROOM = PIECE_MAX, 20, 60, 40
#: What stands between the excerpts of a clipped text.
MIDDLE, ENDING = " ... [middle excerpt] ... ", " ... [ending excerpt] ... "

PART = "part int, parts int, markdown string, html string, row_start int, row_end int, strategy string"
Table = tuple[list[str], list[list[str]]]


def _clean(text: str) -> str:
    return _SPACES.sub(" ", text or "").strip(" ")


def _window(room: int, less: int, which: int) -> int:
    """Tokens of one of three windows that share ``room`` and then give back ``less``: both start from the first one."""
    share, extra = divmod(room, 3)
    given = max(0, less - extra)
    return share + (less <= which < extra) - (given + 2 - which) // 3


def _excerpts(whole: str) -> Callable[[int, int], str]:
    """Of a text: its excerpts for given room and tokens given back. The tokens cover the text, so windows are cut by their borders."""
    at = [0, *(m.end() for m in _TOKEN.finditer(whole))]
    n = len(at) - 1

    def excerpt(room: int, less: int) -> str:
        head, middle, tail = (_window(room, less, which) for which in range(3))
        second = max(head, (n - middle) // 2)
        third = max(second + middle, n - tail)
        return _clean(whole[: at[head]] + MIDDLE + whole[at[second] : at[second + middle]] + ENDING + whole[at[third] :])

    return excerpt


def clip(text: str | None, limit: int) -> str:
    """The text, or excerpts of its head, middle and tail that together stay within the limit, as long as they can be.

    Windows of one token each are returned even where they pass a very small limit.
    """
    whole = _clean(text)
    if count_tokens(whole) <= limit:
        return whole
    room = max(3, math.floor(limit / TOKEN_FACTOR) - sum(1 for _ in _TOKEN.finditer(MIDDLE + ENDING)))
    excerpt = _excerpts(whole)
    return next((out for less in range(room - 3) if count_tokens(out := excerpt(room, less)) <= limit), None) or excerpt(room, room - 3)


def clip_text(x: Column, limit: int = 560) -> Column:
    @F.pandas_udf("string")
    def clipped(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: clip(t, limit))

    return clipped(x)


class _Rows(HTMLParser):
    """Rows of cells of the first table; the first row with a header cell is the header."""

    def __init__(self) -> None:
        super().__init__()
        self.rows: list[list[str]] = []
        self.header: int | None = None
        self.cell = False

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "tr":
            self.rows.append([])
        elif tag in ("td", "th"):
            if not self.rows:
                self.rows.append([])
            self.rows[-1].append("")
            self.cell = True
            if tag == "th" and self.header is None:
                self.header = len(self.rows) - 1

    def handle_endtag(self, tag: str) -> None:
        if tag in ("td", "th"):
            self.cell = False

    def handle_data(self, data: str) -> None:
        if self.cell:
            self.rows[-1][-1] += data


def parse_html(table: str | None) -> Table | None:
    parser = _Rows()
    parser.feed(table or "")
    rows = [[_clean(c) for c in r] for r in parser.rows]
    if not any(rows):
        return None
    at = parser.header
    header = rows.pop(at) if at is not None else []
    rows = [r for r in rows if r]
    return (header, rows) if rows else None


def parse_markdown(table: str) -> Table | None:
    lines = [line.strip() for line in table.strip().splitlines() if line.strip()]
    if len(lines) < 3 or "|" not in lines[0] or not re.fullmatch(r"[\s|:-]+", lines[1]):
        return None
    cells = lambda line: [c.strip().replace(r"\|", "|") for c in re.split(r"(?<!\\)\|", re.sub(r"^\||(?<!\\)\|$", "", line))]
    return cells(lines[0]), [cells(line) for line in lines[2:]]


def named(headers: list[str], rows: list[list[str]]) -> list[str]:
    width = max([len(headers), *map(len, rows)])
    return headers + [f"Column {n}" for n in range(len(headers) + 1, width + 1)]


def as_markdown(headers: list[str], rows: list[list[str]]) -> str:
    return markdown_rows([named(headers, rows), *rows])


def as_html(headers: list[str], rows: list[list[str]]) -> str:
    head = named(headers, rows)
    line = lambda cells, tag: "<tr>" + "".join(f"<{tag}>{htmllib.escape(c)}</{tag}>" for c in cells) + "</tr>"
    body = "".join(line(r + [""] * (len(head) - len(r)), "td") for r in rows)
    return f"<table><thead>{line(head, 'th')}</thead><tbody>{body}</tbody></table>"


def runs(items: list, fits: Callable[[list], bool]) -> Iterator[tuple[int, list]]:
    """Longest runs of items that fit, with the place of their first; an item that does not fit is a run of its own."""
    first, held = 0, []
    for i, item in enumerate(items):
        if held and not fits([*held, item]):
            yield first, held
            first, held = i, []
        held.append(item)
    if held:
        yield first, held


def _row_parts(headers: list[str], row: list[str], number: int) -> Iterator[dict]:
    """A row that is too long for a part, as labelled text in one-column tables."""
    pairs = [f"{h} = {v}" for h, v in zip(named(headers, [row]), row, strict=False) if v.strip()]
    pieces = split_text(f"Row {number}: " + "; ".join(pairs), PART_MAX - ROW_ROOM)
    for _, held in runs(pieces, lambda ps: count_tokens("\n".join(ps)) <= PART_MAX):
        table = (["Structured table row"], [[p] for p in held])
        yield {"markdown": as_markdown(*table), "html": as_html(*table), "row_start": number, "row_end": number, "strategy": "structured_rows"}


def split_rows(headers: list[str], rows: list[list[str]], strategy: str) -> list[dict]:
    """Parts of whole rows under the header; numbers count the table's rows from 1."""
    out = []
    fits = lambda held: count_tokens(as_markdown(headers, held)) <= PART_MAX
    for first, held in runs(rows, fits):
        if len(held) == 1 and not fits(held):
            out += _row_parts(headers, held[0], first + 1)
        else:
            out.append({"markdown": as_markdown(headers, held), "html": as_html(headers, held), "row_start": first + 1, "row_end": first + len(held), "strategy": strategy})
    return out


#: Readers of rows, in the order in which they are tried. A reader's parts count if none is far too long.
READERS: dict[str, Callable[[str, str | None], Table | None]] = {
    "markdown_rows": lambda markdown, _: parse_markdown(markdown),
    "html_rows": lambda _, table_html: parse_html(table_html),
}
#: Marks of a table's layout, which are blanks in plain text: line breaks, borders of cells, rules.
_LAYOUT = re.compile(r"<br\s*/?>|\s*\|\s*|[-_=]{10,}", re.IGNORECASE)


def _segments(text: str) -> list[dict]:
    """A text without rows, in tables of one cell."""
    cells = [(["Table segment"], [[piece]]) for piece in split_text(_LAYOUT.sub(" ", text), PART_MAX - SEGMENT_ROOM)]
    return [{"markdown": as_markdown(*c), "html": as_html(*c), "row_start": None, "row_end": None, "strategy": "unstructured_last_resort"} for c in cells]


def split_table(markdown: str | None, table_html: str | None) -> list[dict]:
    """Parts of an oversized table: by its markdown rows, else by its HTML rows, else as plain text. Empty if it is small enough."""
    text = (markdown or "").strip()
    if count_tokens(text) <= PART_MAX:
        return []
    read = ((strategy, reader(text, table_html)) for strategy, reader in READERS.items())
    split = (split_rows(*table, strategy) for strategy, table in read if table)
    good = (parts for parts in split if parts and max(count_tokens(p["markdown"]) for p in parts) <= PART_MAX + SLACK)
    return next(good, None) or _segments(text)


#: Fixed value: tokens of the excerpt that stands in a rescued table.
RESCUED = 140


def rescued_table(signal: Column, text: Column) -> Column:
    """STRUCT<markdown, html> with an excerpt of the text in one column, where there is a signal (see ``text.table_signal``); null elsewhere."""
    excerpt = clip_text(F.when(signal.isNotNull(), text), RESCUED)
    html = F.concat(F.lit("<table><thead><tr><th>Table segment</th></tr></thead><tbody><tr><td>"), escape_html(excerpt), F.lit("</td></tr></tbody></table>"))
    made = F.struct(one_column_table(excerpt).alias("markdown"), html.alias("html"))
    return F.when(signal.isNotNull(), made)


def table_parts(rows: DataFrame, markdown: str, table_html: str) -> DataFrame:
    """All columns of rows for each part of their table: part from 1, parts, and p with the fields of PART. Small tables are one part."""
    fields = "array<struct<markdown:string,html:string,row_start:int,row_end:int,strategy:string>>"

    @F.pandas_udf(fields)
    def parts(markdown: pd.Series, table: pd.Series) -> pd.Series:
        return pd.Series([split_table(m, h) for m, h in zip(markdown, table, strict=True)])

    whole = F.array(F.struct(F.col(markdown).alias("markdown"), F.col(table_html).alias("html"), F.lit(None).cast("int").alias("row_start"), F.lit(None).cast("int").alias("row_end"), F.lit(None).cast("string").alias("strategy")))
    rows = rows.withColumn("quern_parts", parts(markdown, table_html))
    rows = rows.withColumn("quern_parts", F.when(F.size("quern_parts") > 0, F.col("quern_parts")).otherwise(whole))
    rows = rows.select("*", F.size("quern_parts").alias("parts"), F.posexplode("quern_parts").alias("part", "p")).drop("quern_parts")
    return rows.withColumn("part", F.col("part") + 1)


def split_tables(elements: DataFrame) -> DataFrame:
    """Rows (element_id, sequence, table_markdown, table_html) with their parts: those of PART, and a fractional sequence. Small tables are one part."""
    rows = table_parts(elements.select("element_id", "sequence", "table_markdown", "table_html"), "table_markdown", "table_html")
    sequence = F.col("sequence") + F.when(F.col("parts") > 1, F.col("part") / (F.col("parts") + 1)).otherwise(0.0)
    return rows.select("element_id", sequence.cast("double").alias("sequence"), "part", "parts", "p.*")
