"""HTML and XHTML to content units, with links, tables and footnotes, by the standard library's parser."""

from __future__ import annotations

import posixpath
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_HIDDEN = {"script", "style", "template", "noscript", "head", "svg"}
_VOID = {"br", "hr", "img", "input", "link", "meta", "wbr", "col", "area", "base", "source", "track", "embed"}
_HEADINGS = {f"h{i}": i for i in range(1, 7)}
#: element: (unit type, role)
_BLOCKS = {
    "p": ("text_block", "paragraph"), "blockquote": ("text_block", "quotation"), "li": ("list_item", None), "ul": ("list", "unordered"), "ol": ("list", "ordered"),
    "pre": ("code_block", None), "table": ("table", None), "caption": ("caption", None), "figcaption": ("caption", None), "figure": ("figure", None), "aside": ("text_block", "aside"),
    "td": ("table_cell", None), "th": ("table_cell", "header"), "dt": ("list_item", "term"), "dd": ("list_item", "definition"), "section": ("section", None), "article": ("section", None),
    "math": ("formula", None), **{h: ("text_block", "heading") for h in _HEADINGS},
}
_KINDS = {"chapter": "chapter", "preface": "preface", "foreword": "foreword", "introduction": "introduction", "appendix": "appendix", "bibliography": "bibliography", "glossary": "glossary", "index": "index", "toc": "table_of_contents", "footnotes": "notes", "endnotes": "notes", "part": "part"}


def folded(text: str) -> str:
    """No-break spaces as spaces, each run of white space as one space, trimmed."""
    return re.sub(r"\s+", " ", text.replace("\xa0", " ")).strip()


def section_kind(epub_type: str | None) -> str:
    return next((_KINDS[t] for t in (epub_type or "").lower().split() if t in _KINDS), "unknown")


@dataclass
class Unit:
    index: int
    type: str
    role: str | None
    level: int | None
    parent: int | None
    path: str
    anchor: str | None
    text: list[str] = field(default_factory=list)
    row: int | None = None
    column: int | None = None


class _Walk(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.units: list[Unit] = []
        self.links: list[tuple[int | None, str]] = []
        self.open: list[tuple[str, Unit | None]] = []
        self.seen: list[dict[str, int]] = [{}]
        self.hidden = 0
        self.grids: list[dict] = []

    def _path(self, tag: str) -> str:
        n = self.seen[-1][tag] = self.seen[-1].get(tag, 0) + 1
        return f"/{tag}[{n}]"

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        a = dict(attrs)
        step = self._path(tag)
        if tag in _VOID:
            if tag == "br":
                self.handle_data("\n")
            return
        unit = None
        if tag in _HIDDEN:
            self.hidden += 1
        elif not self.hidden and tag in _BLOCKS:
            kind, role = _BLOCKS[tag]
            if kind == "section":
                role = section_kind(a.get("epub:type") or a.get("role"))
            parent = next((u.index for _, u in reversed(self.open) if u is not None), None)
            path = "".join(s for s in (*(p for p, _ in self._steps), step))
            unit = Unit(len(self.units), kind, role, _HEADINGS.get(tag), parent, path, a.get("id"))
            self.units.append(unit)
            self._cell(tag, a, unit)
        if tag == "tr" and self.grids:
            self.grids[-1]["row"] += 1
            self.grids[-1]["column"] = 0
        if tag == "a" and a.get("href") and not self.hidden:
            self.links.append((next((u.index for _, u in reversed(self.open) if u is not None), None), a["href"]))
        self.open.append((tag, unit))
        self._steps.append((step, tag))
        self.seen.append({})

    _steps: list[tuple[str, str]]

    def _cell(self, tag: str, a: dict, unit: Unit) -> None:
        if tag == "table":
            self.grids.append({"row": -1, "column": 0, "taken": set()})
        elif tag in ("td", "th") and self.grids:
            g = self.grids[-1]
            while (g["row"], g["column"]) in g["taken"]:
                g["column"] += 1
            span = lambda k: max(1, min(1000, int(a.get(k) or 1))) if str(a.get(k) or "1").isdigit() else 1
            unit.row, unit.column = max(g["row"], 0), g["column"]
            for i in range(span("rowspan")):
                for j in range(span("colspan")):
                    g["taken"].add((g["row"] + i, g["column"] + j))
            g["column"] += span("colspan")

    def handle_endtag(self, tag: str) -> None:
        if tag not in (t for t, _ in self.open):
            return
        while self.open:
            t, _ = self.open.pop()
            self._steps.pop()
            self.seen.pop()
            if t in _HIDDEN:
                self.hidden -= 1
            if t == "table" and self.grids:
                self.grids.pop()
            if t == tag:
                return

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            unit = next((u for _, u in reversed(self.open) if u is not None), None)
            if unit is not None:
                unit.text.append(data)


def walk(html: str) -> tuple[list[Unit], list[tuple[int | None, str]]]:
    """Units in reading order, and links (unit, href). Malformed mark-up is read as far as it goes, never an error."""
    w = _Walk()
    w._steps = []
    w.feed(html)
    w.close()
    return w.units, w.links


def resolve(base: str, href: str) -> str | None:
    """A link within the publication: path without dot segments, decoded, with its fragment; null for other schemes and ways out."""
    if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", href) or href.startswith("//"):
        return None
    path, hash_, fragment = href.partition("#")
    path = posixpath.normpath(posixpath.join(posixpath.dirname(base), unquote(path))) if path else base
    if path.startswith(("..", "/")):
        return None
    return path + (hash_ + unquote(fragment) if fragment else "")


UNITS = "page_id long, sequence_index int, type string, role string, level int, parent_index int, path string, anchor string, text string, row int, column int"
LINKS = "page_id long, from_index int, href string, target string"


def _table(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=names)


def units(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """Content units of pages, row by row; text is folded but for code."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for k, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for u in walk(text or "")[0]:
                    body = "".join(u.text)
                    rows.append((k, u.index, u.type, u.role, u.level, u.parent, u.path, u.anchor, body if u.type == "code_block" else folded(body), u.row, u.column))
            i, s = pa.int32(), pa.string()
            yield _table(rows, ["page_id", "sequence_index", "type", "role", "level", "parent_index", "path", "anchor", "text", "row", "column"], [pa.int64(), i, s, s, i, i, s, s, s, i, i])

    return pages.select(F.col(key).cast("long"), html).mapInArrow(run, UNITS)


def links(pages: DataFrame, key: str = "page_id", html: str = "html", base: str = "page.html") -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(k, u, h, resolve(base, h)) for k, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for u, h in walk(text or "")[1]]
            yield _table(rows, ["page_id", "from_index", "href", "target"], [pa.int64(), pa.int32(), pa.string(), pa.string()])

    return pages.select(F.col(key).cast("long"), html).mapInArrow(run, LINKS)


def link_targets(found: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links with the unit of their anchor, and those without one (for warnings). targets(page_id, anchor, sequence_index)."""
    t = targets.filter("anchor is not null").groupBy("page_id", "anchor").agg(F.min("sequence_index").alias("to_index"))
    got = found.withColumn("anchor", F.substring_index("target", "#", -1)).join(t, ["page_id", "anchor"], "left")
    return got.filter("to_index is not null"), got.filter("to_index is null")


#: Contractions that a line break or odd spacing took apart.
_SPLIT = re.compile(r"\b(\w+) ?(['’]) ?(s|t|re|ve|m|ll|d)\b")


def clean_prose(text: str) -> str:
    """Soft hyphens out, runs of spaces and tabs as one space, line ends trimmed, contractions whole again."""
    text = re.sub(r"[ \t\xa0]+", " ", text.replace("\xad", ""))
    return _SPLIT.sub(r"\1\2\3", re.sub(r" ?\n ?", "\n", text)).strip(" ")
