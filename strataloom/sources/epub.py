"""EPUB: zip archive, package, spine and navigation, to pages for the HTML source."""

from __future__ import annotations

import io
import posixpath
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

MAX_MEMBERS = 10_000
MAX_BYTES = 256 << 20


class EpubError(ValueError):
    pass


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _all(root: ET.Element, name: str) -> list[ET.Element]:
    return [e for e in root.iter() if isinstance(e.tag, str) and _local(e.tag) == name]


def members(data: bytes) -> dict[str, bytes]:
    """Files of the archive by normalised name; encrypted ones, ways out of it and archives over the limits are errors."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        infos = [i for i in z.infolist() if not i.is_dir()]
        if len(infos) > MAX_MEMBERS or sum(i.file_size for i in infos) > MAX_BYTES:
            raise EpubError("the archive is over its limits")
        out = {}
        for i in infos:
            name = posixpath.normpath(i.filename.replace("\\", "/"))
            if i.flag_bits & 1 or name.startswith(("/", "..")):
                raise EpubError(f"member {i.filename!r} cannot be read")
            out[name] = z.read(i)
        return out


def package(files: dict[str, bytes]) -> dict:
    """path, title, language, spine (hrefs in order), nav and ncx of the package that the container names."""
    try:
        container = ET.fromstring(files["META-INF/container.xml"])
        path = next(e.get("full-path") for e in _all(container, "rootfile"))
        root = ET.fromstring(files[path])
    except (KeyError, StopIteration, ET.ParseError) as e:
        raise EpubError("no package") from e
    base = posixpath.dirname(path)
    items = {e.get("id"): e for e in _all(root, "item")}
    href = lambda e: posixpath.normpath(posixpath.join(base, unquote(e.get("href", ""))))
    first = lambda name: next((e.text.strip() for e in _all(root, name) if e.text), None)
    spine = [href(items[r.get("idref")]) for r in _all(root, "itemref") if r.get("idref") in items and r.get("linear") != "no"]
    nav = next((href(e) for e in items.values() if "nav" in (e.get("properties") or "").split()), None)
    ncx = next((href(e) for e in items.values() if e.get("media-type") == "application/x-dtbncx+xml"), None)
    return {"path": path, "title": first("title"), "language": first("language"), "spine": spine, "nav": nav, "ncx": ncx}


def navigation(files: dict[str, bytes], book: dict) -> list[tuple[str, str, int]]:
    """(label, target, depth) in order: from the nav document, else the NCX, else nothing."""
    if book["nav"] in files:
        root, base = ET.fromstring(files[book["nav"]]), posixpath.dirname(book["nav"])
        out: list[tuple[str, str, int]] = []

        def walk(e: ET.Element, depth: int) -> None:
            for child in e:
                name = _local(child.tag) if isinstance(child.tag, str) else ""
                if name == "a" and child.get("href"):
                    out.append((" ".join("".join(child.itertext()).split()), posixpath.normpath(posixpath.join(base, child.get("href"))), depth))
                walk(child, depth + (name == "ol"))

        navs = _all(root, "nav")
        toc = [n for n in navs if any(_local(k) == "type" and v == "toc" for k, v in n.attrib.items())] or navs
        for n in toc[:1]:
            walk(n, 0)
        return out
    if book["ncx"] in files:
        root, base = ET.fromstring(files[book["ncx"]]), posixpath.dirname(book["ncx"])
        out = []

        def points(e: ET.Element, depth: int) -> None:
            for p in e:
                if isinstance(p.tag, str) and _local(p.tag) == "navPoint":
                    label = next((" ".join("".join(t.itertext()).split()) for t in p if _local(t.tag) == "navLabel"), "")
                    src = next((c.get("src", "") for c in p if _local(c.tag) == "content"), "")
                    out.append((label, posixpath.normpath(posixpath.join(base, src)), depth))
                    points(p, depth + 1)

        for m in _all(root, "navMap"):
            points(m, 1)
        return out
    return []


PAGES = "path string, page_id long, href string, title string, html string, error string"


def pages(books: DataFrame) -> DataFrame:
    """Spine pages of books(path, content), in order; a book that cannot be read gives one row with its error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    files = members(content)
                    book = package(files)
                    rows = [(path, i, h, book["title"], files[h].decode("utf-8", "replace"), None) for i, h in enumerate(book["spine"]) if h in files]
                except (EpubError, zipfile.BadZipFile) as e:
                    rows = [(path, None, None, None, None, str(e))]
                if rows:
                    types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string()]
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["path", "page_id", "href", "title", "html", "error"])

    return books.select("path", "content").mapInArrow(run, PAGES)


def scan(spark: SparkSession, folder: str) -> DataFrame:
    """books(path, content) under a folder, of any store that Spark reads."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.epub").load(folder)
