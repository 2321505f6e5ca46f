"""EPUB files as sections: the package's reading order, titles from its contents, text of its documents."""

from __future__ import annotations

import io
import posixpath
import zipfile
from collections.abc import Iterator
from urllib.parse import unquote
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators.segment import _Paragraphs, unique_titles

#: Caps of an untrusted archive: members, and bytes of one and of all when unpacked.
MOST_MEMBERS, MOST_BYTES, MOST_TOTAL = 5000, 50_000_000, 300_000_000
SCHEMA = "path string, title string, author string, ordinal int, section string, body string, problem string"


class Refused(ValueError):
    """An archive that is not read: why."""


class _Archive:
    def __init__(self, data: bytes) -> None:
        try:
            self.zip = zipfile.ZipFile(io.BytesIO(data))
        except zipfile.BadZipFile:
            raise Refused("not an archive") from None
        infos = self.zip.infolist()
        if len(infos) > MOST_MEMBERS or sum(i.file_size for i in infos) > MOST_TOTAL or any(i.file_size > MOST_BYTES for i in infos):
            raise Refused("too large when unpacked")
        self.names = {i.filename for i in infos}
        if "META-INF/rights.xml" in self.names or "META-INF/encryption.xml" in self.names and b"EncryptedData" in self.read("META-INF/encryption.xml"):
            raise Refused("protected")

    def read(self, name: str) -> bytes:
        if name not in self.names:
            raise Refused(f"{name} is missing")
        with self.zip.open(name) as f:
            data = f.read(MOST_BYTES + 1)
        if len(data) > MOST_BYTES:
            raise Refused("too large when unpacked")
        return data

    def xml(self, name: str) -> ElementTree.Element:
        data = self.read(name)
        if b"<!ENTITY" in data:
            raise Refused("declares entities")
        try:
            return ElementTree.fromstring(data)
        except ElementTree.ParseError:
            raise Refused(f"{name} is not XML") from None


def _local(e: ElementTree.Element) -> str:
    return e.tag.rpartition("}")[2]


def _found(root: ElementTree.Element, name: str) -> list[ElementTree.Element]:
    return [e for e in root.iter() if _local(e) == name]


def _target(base: str, href: str) -> str | None:
    path = posixpath.normpath(posixpath.join(posixpath.dirname(base), unquote(href.split("#")[0])))
    return None if path.startswith(("..", "/")) else path


def _titles(archive: _Archive, opf: str, items: dict[str, dict]) -> dict[str, str]:
    """The first label that the contents give each document."""
    out: dict[str, str] = {}
    for item in items.values():
        name = _target(opf, item.get("href", ""))
        if name not in archive.names:
            continue
        if "nav" in item.get("properties", "").split():
            links = [(a.get("href", ""), " ".join("".join(a.itertext()).split())) for a in _found(archive.xml(name), "a")]
        elif item.get("media-type") == "application/x-dtbncx+xml":
            points = _found(archive.xml(name), "navPoint")
            links = [(c[0].get("src", ""), " ".join("".join(t[0].itertext()).split())) for p in points if (c := _found(p, "content")) and (t := _found(p, "text"))]
        else:
            continue
        for href, label in links:
            if label and (at := _target(name, href)):
                out.setdefault(at, label)
    return out


def sections(data: bytes) -> tuple[str, str, list[tuple[str, str]]]:
    """(title, author, sections). A document without a title of its own continues the section before it; documents
    outside the linear order come last, under Notes."""
    archive = _Archive(data)
    roots = _found(archive.xml("META-INF/container.xml"), "rootfile")
    if not roots:
        raise Refused("names no package")
    opf = roots[0].get("full-path", "")
    package = archive.xml(opf)
    text = lambda name: next((t for e in _found(package, name) if (t := " ".join("".join(e.itertext()).split()))), "")
    items = {i.get("id", ""): dict(i.attrib) for i in _found(package, "item")}
    titles = _titles(archive, opf, items)
    found: list[list[str]] = []
    notes: list[str] = []
    for ref in _found(package, "itemref"):
        name = _target(opf, items.get(ref.get("idref", ""), {}).get("href", ""))
        if not name or name not in archive.names:
            continue
        reader = _Paragraphs()
        reader.feed(archive.read(name).decode("utf-8", "replace"))
        reader.close()
        reader.end()
        body = "\n\n".join(reader.out)
        if not body:
            continue
        if ref.get("linear") == "no":
            notes.append(body)
        elif name in titles or not found:
            found.append([titles.get(name, "Front matter"), body])
        else:
            found[-1][1] += "\n\n" + body
    if notes:
        found.append(["Notes", "\n\n".join(notes)])
    names = unique_titles([t for t, _ in found])
    return text("title"), text("creator"), [(n, b) for n, (_, b) in zip(names, found)]


def read_epubs(spark: SparkSession, folder: str) -> DataFrame:
    """One row per section of each EPUB below a folder; a file that is refused is one row with its problem."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, data in zip(batch["path"], batch["content"]):
                try:
                    title, author, found = sections(bytes(data))
                    rows += [(path, title, author, i, n, b, None) for i, (n, b) in enumerate(found)]
                except Refused as e:
                    rows.append((path, None, None, None, None, None, str(e)))
            yield pd.DataFrame(rows, columns=["path", "title", "author", "ordinal", "section", "body", "problem"]).astype({"ordinal": "Int32"})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.epub").load(folder)
    read = files.select("path", "content").where(F.col("length") <= MOST_TOTAL).mapInPandas(run, SCHEMA)
    # files that are too large are not read
    large = files.where(F.col("length") > MOST_TOTAL).select("path", F.lit(f"larger than {MOST_TOTAL} bytes").alias("problem"))
    return read.unionByName(large, allowMissingColumns=True)
