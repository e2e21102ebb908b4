"""HTML pages to elements with the standard library's parser, on Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame

from quernstone.functions.text import _SPACES  # the pattern for white space
from quernstone.storage import small_batches

#: Tags that are elements, and tags whose content is none.
ELEMENTS = ("h1", "h2", "h3", "h4", "h5", "h6", "p", "ul", "ol", "table", "img", "blockquote", "pre")
DROPPED = ("script", "style", "noscript", "template")
#: Inside these, only headings are elements of their own.
CONTAINERS = ("table", "ul", "ol", "blockquote", "pre")

#: Pages whose elements a task holds at once.
PAGES = 64

SCHEMA = "page_id long, sequence int, tag string, element_type string, level int, text string, table_markdown string, image_url string, alt_text string, section_path array<string>"


def clean(text: str) -> str:
    return _SPACES.sub(" ", text).strip()


def markdown_rows(rows: list[list[str]]) -> str:
    """A pipe table of the rows, the first one as its header, filled up to the widest."""
    width = max(map(len, rows), default=0)
    if not width:
        return ""
    full = [[c.replace("|", r"\|") for c in r] + [""] * (width - len(r)) for r in rows]
    line = lambda cells: f"| {' | '.join(cells)} |"
    return "\n".join([line(full[0]), line(["---"] * width), *map(line, full[1:])])


class PageParser(HTMLParser):
    """Collects elements in document order; a heading closes the open ones of its level and below."""

    def __init__(self, url: str | None, keep_empty: bool):
        super().__init__(convert_charrefs=True)
        self.url, self.keep_empty = url or "", keep_empty
        self.found: list[dict] = []
        self.open: list[dict] = []  # elements that are being read, outermost first
        self.path: list[tuple[int, str]] = []
        self.dropped, self.sequence, self.title, self.in_title = 0, 0, "", False

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in DROPPED:
            self.dropped += 1
        if self.dropped:
            return
        if tag == "title":
            self.in_title = True
        inside = any(e["tag"] in CONTAINERS for e in self.open)
        if tag in ELEMENTS and (not inside or tag[0] == "h"):
            values = dict(attrs)
            self.sequence += 1
            one = {"tag": tag, "sequence": self.sequence, "parts": [], "rows": [], "url": None, "alt": values.get("alt")}
            if tag == "img":
                one["url"] = urljoin(self.url, values["src"]) if values.get("src") else None
                self.close(one)
            else:
                self.open.append(one)
        elif self.open and self.open[-1]["tag"] == "table":
            if tag == "tr":
                self.open[-1]["rows"].append([])
            elif tag in ("td", "th"):
                if not self.open[-1]["rows"]:
                    self.open[-1]["rows"].append([])
                self.open[-1]["rows"][-1].append("")
        elif tag == "li" and self.open:
            self.open[-1]["parts"].append("\n- ")
        elif tag == "br" and self.open:
            self.open[-1]["parts"].append(" ")

    def handle_endtag(self, tag: str) -> None:
        if tag in DROPPED and self.dropped:
            self.dropped -= 1
        elif tag == "title":
            self.in_title = False
        elif any(e["tag"] == tag for e in self.open):
            while self.open:
                one = self.open.pop()
                self.close(one)
                if one["tag"] == tag:
                    break

    def handle_data(self, data: str) -> None:
        if self.dropped:
            return
        if self.in_title:
            self.title += data
        elif self.open:
            one = self.open[-1]
            one["parts"].append(data)
            if one["tag"] == "table" and one["rows"] and one["rows"][-1]:
                one["rows"][-1][-1] += data

    def close(self, one: dict) -> None:
        text = clean("".join(one["parts"]))
        level = int(one["tag"][1]) if one["tag"][0] == "h" and one["tag"][1:].isdigit() else None
        if level and text:
            self.path = [p for p in self.path if p[0] < level] + [(level, text)]
        if text or one["url"] or self.keep_empty:
            self.found.append(one | {"text": text, "level": level, "path": [t for _, t in self.path] or [clean(self.title)] * bool(clean(self.title))})


def parse(page_id: int, url: str | None, html: str | None, keep_empty: bool = False) -> list[dict]:
    parser = PageParser(url, keep_empty)
    parser.feed(html or "")
    while parser.open:
        parser.close(parser.open.pop())
    kind = lambda e: "heading" if e["level"] else {"table": "table", "img": "image"}.get(e["tag"], "text")
    return [
        {
            "page_id": page_id, "sequence": e["sequence"], "tag": e["tag"], "element_type": kind(e), "level": e["level"], "text": e["text"],
            "table_markdown": markdown_rows([[clean(c) for c in r] for r in e["rows"]]) if e["tag"] == "table" else None,
            "image_url": e["url"], "alt_text": e["alt"], "section_path": e["path"],
        }
        for e in sorted(parser.found, key=lambda e: e["sequence"])
    ]


def elements(pages: DataFrame, keep_empty: bool = False) -> DataFrame:
    """One row per element of (page_id, url, html). Elements without text are left out unless wanted; numbers count them."""
    kinds = pa.schema([
        ("page_id", pa.int64()), ("sequence", pa.int32()), ("tag", pa.string()), ("element_type", pa.string()), ("level", pa.int32()), ("text", pa.string()),
        ("table_markdown", pa.string()), ("image_url", pa.string()), ("alt_text", pa.string()), ("section_path", pa.list_(pa.string())),
    ])

    small_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, PAGES):
                rows = [e for page in zip(*(c.to_pylist() for c in batch.slice(lo, PAGES).columns), strict=True) for e in parse(*page, keep_empty)]
                yield pa.RecordBatch.from_pylist(rows, schema=kinds)

    return pages.select("page_id", "url", "html").mapInArrow(run, SCHEMA)
