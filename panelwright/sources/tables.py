"""Tables inside HTML pages and Excel workbooks, and sinks for run artefacts.

A file is read by one task; files are spread over the tasks.  The parsers are Python's own.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CELLS = "path string, tbl string, row int, header boolean, cells array<string>"


class _Tables(HTMLParser):
    """Tables in order of their start; a nested table is a table of its own and no text of its cell."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tables: list[list[list[list]]] = []  # table, row, cell: [text, is header, columns, rows]
        self._open: list[dict] = []
        self._silent = 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in ("script", "style", "sup"):
            self._silent += 1
        elif tag == "table":
            self.tables.append([])
            self._open.append({"rows": self.tables[-1], "cell": None})
        elif self._open and tag == "tr":
            self._open[-1]["rows"].append([])
            self._open[-1]["cell"] = None
        elif self._open and tag in ("td", "th"):
            if not self._open[-1]["rows"]:
                self._open[-1]["rows"].append([])
            given = dict(attrs)
            span = [int(v) if (v := given.get(k) or "").isdecimal() and 0 < int(v) <= 1000 else 1 for k in ("colspan", "rowspan")]
            self._open[-1]["cell"] = ["", tag == "th", *span]
            self._open[-1]["rows"][-1].append(self._open[-1]["cell"])
        elif tag == "br":
            self.handle_data(" ")

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style", "sup"):
            self._silent = max(0, self._silent - 1)
        elif tag == "table" and self._open:
            self._open.pop()
        elif tag in ("td", "th", "tr") and self._open:
            self._open[-1]["cell"] = None

    def handle_data(self, data: str) -> None:
        if self._open and not self._silent and self._open[-1]["cell"] is not None:
            self._open[-1]["cell"][0] += data


def _html(content: bytes) -> Iterator[tuple[str, int, bool, list[str]]]:
    """Rows with spanning cells repeated in every place they cover; a row of header cells alone is a header."""
    parser = _Tables()
    parser.feed(content.decode("utf-8", "replace"))
    for k, rows in enumerate(parser.tables):
        below: dict[int, tuple[str, int]] = {}  # column: text that reaches further down, rows left
        for r, row in enumerate(rows):
            cells: list[str] = []
            reach: dict[int, tuple[str, int]] = {}
            waiting = list(row)
            while waiting or len(cells) in below:
                at = len(cells)
                if at in below:
                    text, left = below[at]
                    cells.append(text)
                    if left > 1:
                        reach[at] = (text, left - 1)
                else:
                    text, _, wide, high = waiting.pop(0)
                    text = " ".join(text.split())
                    for column in range(at, at + wide):
                        cells.append(text)
                        if high > 1:
                            reach[column] = (text, high - 1)
            below = reach
            yield str(k), r, bool(row) and all(c[1] for c in row), cells


def _column(reference: str) -> int:
    out = 0
    for letter in re.match("[A-Z]*", reference)[0]:
        out = out * 26 + ord(letter) - 64
    return out - 1


def _plain(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _text(element: ElementTree.Element) -> str:
    """Text runs, without phonetic guides."""
    return "".join(t.text or "" for part in element if _plain(part.tag) in ("t", "r") for t in ([part] if _plain(part.tag) == "t" else [p for p in part if _plain(p.tag) == "t"]))


def _xlsx(content: bytes) -> Iterator[tuple[str, int, bool, list[str | None]]]:
    """Cells as stored (dates are day numbers, booleans 0 and 1); absent cells and rows are null and left out."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        names = set(book.namelist())
        shared = [_text(e) for e in ElementTree.fromstring(book.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
        targets = {e.get("Id"): e.get("Target") for e in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
        for sheet in (e for e in ElementTree.fromstring(book.read("xl/workbook.xml")).iter() if _plain(e.tag) == "sheet"):
            target = targets[next(v for k, v in sheet.attrib.items() if _plain(k) == "id")]
            part = target.lstrip("/") if target.startswith("/") else posixpath.join("xl", target)
            if part not in names:
                continue
            for n, row in enumerate(e for e in ElementTree.fromstring(book.read(part)).iter() if _plain(e.tag) == "row"):
                cells: list[str | None] = []
                for cell in row:
                    at = _column(cell.get("r") or "")
                    cells += [None] * (max(at, 0) - len(cells))
                    value = next((e.text for e in cell if _plain(e.tag) == "v"), None)
                    inline = next((e for e in cell if _plain(e.tag) == "is"), None)
                    if inline is not None:
                        value = _text(inline)
                    elif cell.get("t") == "s" and value is not None:
                        value = shared[int(value)]
                    cells.append(value)
                yield sheet.get("name"), int(row.get("r") or n + 1) - 1, False, cells


def _read(spark: SparkSession, path: str, parse: Callable[[bytes], Iterator[tuple]]) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for files in batches:
            for name, content in zip(files["path"], files["content"], strict=True):
                rows = [(name, *row) for row in parse(content)]
                yield pd.DataFrame(rows, columns=["path", "tbl", "row", "header", "cells"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, CELLS)


def read_html_tables(spark: SparkSession, path: str) -> DataFrame:
    """(path, tbl, row, header, cells) of every table; ``tbl`` counts from 0 in a page, footnote marks are left out."""
    return _read(spark, path, _html)


def read_xlsx(spark: SparkSession, path: str) -> DataFrame:
    """(path, tbl, row, header, cells) of every sheet; ``tbl`` is its name, ``header`` is false."""
    return _read(spark, path, _xlsx)


def flat_header(rows: DataFrame) -> DataFrame:
    """(path, tbl, names): header rows above each other joined by ``_``, the same text once."""
    part = rows.filter("header").select("path", "tbl", "row", F.posexplode("cells").alias("column", "name"))
    names = part.groupBy("path", "tbl", "column").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("row", "name"))), lambda s: s["name"])).alias("n"))
    named = names.select("path", "tbl", F.struct("column", F.array_join("n", "_").alias("name")).alias("s"))
    return named.groupBy("path", "tbl").agg(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["name"]).alias("names"))


def day_of_number(column: Column | str) -> Column:
    """A date from an integer YYYYMMDD, as a number or text (``20240131``, ``20240131.0``); else null."""
    text = (F.col(column) if isinstance(column, str) else column).cast("string")
    digits = F.regexp_extract(text, r"^\s*(\d{8})(?:\.0*)?\s*$", 1)
    return F.try_to_timestamp(digits, F.lit("yyyyMMdd")).cast("date")


def write_artefact(rows: DataFrame, path: str, kind: str = "parquet", mode: str = "overwrite") -> None:
    """``parquet``, ``json`` (a line a row) or ``csv`` (with a header; arrays, maps and structs as JSON text)."""
    if kind not in ("parquet", "json", "csv"):
        raise ValueError(f"unknown kind {kind!r}")
    if kind == "csv":
        nested = {f.name for f in rows.schema.fields if f.dataType.typeName() in ("array", "map", "struct")}
        rows = rows.select(*(F.to_json(f"`{c}`").alias(c) if c in nested else F.col(f"`{c}`") for c in rows.columns))
    writer = rows.write.mode(mode)
    (writer.option("header", True) if kind == "csv" else writer).format(kind).save(path)
