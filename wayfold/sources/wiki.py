"""Tables in wiki markup as rows: cells at their places, spans filled, links and emphasis read as plain text, and what can't be read told apart.

A task parses one page's tables at a time, line by line, so that a page is all it holds.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CELLS = "page string, table int, row int, col int, header boolean, text string, target string, spanned boolean"
FAULTS = "page string, table int, line int, fault string"
_COLUMN_NAMES = [f.split()[0] for f in CELLS.split(", ")]

_LINK = re.compile(r"\[\[([^\]\[|]*)(?:\|([^\]\[]*))?\]\]|\[(https?://[^\s\]]+)(?:\s+([^\]]*))?\]")
_SPAN = re.compile(r"\b(colspan|rowspan)\s*=\s*[\"']?\s*(\d+)")
_ATTRIBUTES = re.compile(r"^\s*(?:[\w-]+\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'|]+)\s*)+$")
#: Columns and rows that one cell may span: more is a fault of the page.
MOST_SPAN = 1000


class Cell(NamedTuple):
    row: int
    col: int
    header: bool
    text: str
    target: str | None
    spanned: bool


def plain(markup: str) -> tuple[str, str | None]:
    """A cell's text without markup, and the target of its first link."""
    markup = re.sub(r"<!--.*?-->|<ref[^>]*/>|<ref[^>]*>.*?</ref>", "", markup, flags=re.S)
    markup = re.sub(r"<br\s*/?>", " ", markup)
    first = _LINK.search(markup)
    target = (first[1] if first[1] is not None else first[3]).strip() if first else None
    text = _LINK.sub(lambda m: (m[2] if m[2] is not None else m[1]) if m[1] is not None else (m[4] or m[3]), markup)
    while "{{" in text:  # the innermost template's last unnamed part stands for it
        inner = re.search(r"\{\{([^{}]*)\}\}", text)
        if not inner:
            break
        parts = [p for p in inner[1].split("|")[1:] if "=" not in p]
        text = text[: inner.start()] + (parts[-1] if parts else "") + text[inner.end() :]
    text = re.sub(r"</?[a-zA-Z][^>]*>|'{2,5}", "", text)
    return re.sub(r"\s+", " ", text).strip(), target or None


def _split(line: str, marks: tuple[str, ...]) -> list[str]:
    """``line`` at the marks that stand outside links and templates."""
    out, depth, last, i = [], 0, 0, 0
    while i < len(line):
        two = line[i : i + 2]
        if two in ("[[", "{{"):
            depth, i = depth + 1, i + 2
        elif two in ("]]", "}}"):
            depth, i = max(depth - 1, 0), i + 2
        elif not depth and two in marks:
            out.append(line[last:i])
            i = last = i + 2
        else:
            i += 1
    return [*out, line[last:]]


def _content(raw: str) -> tuple[int, int, str]:
    """(colspan, rowspan, markup) of a cell: attributes stand before the first bar that is in no link or template."""
    depth = 0
    for i, c in enumerate(raw):
        two = raw[i : i + 2]
        depth += (two in ("[[", "{{")) - (two in ("]]", "}}"))
        if c == "|" and depth <= 0:
            if not _ATTRIBUTES.match(raw[:i]):
                break
            spans = {k: int(v) for k, v in _SPAN.findall(raw[:i])}
            return spans.get("colspan", 1), spans.get("rowspan", 1), raw[i + 1 :]
    return 1, 1, raw


def parse(text: str) -> Iterator[tuple[int, list[Cell], list[tuple[int, str]]]]:
    """(number, cells, faults by line) of every table of a page, nested ones left as text of their cell's fault."""
    lines = text.replace("\r\n", "\n").split("\n")
    number, i = 0, 0
    while i < len(lines):
        if not lines[i].lstrip().startswith("{|"):
            i += 1
            continue
        raw: list[list[tuple[bool, str, int]]] = [[]]
        faults: list[tuple[int, str]] = []
        depth, begin, i = 1, i, i + 1
        while i < len(lines) and depth:
            line = lines[i].strip()
            if line.startswith("{|"):
                faults.append((i, "nested table"))
                depth += 1
            elif line.startswith("|}"):
                depth -= 1
            elif depth > 1:
                pass
            elif line.startswith("|-"):
                if raw[-1]:
                    raw.append([])
            elif line.startswith("|+"):
                pass
            elif line.startswith(("|", "!")):
                header = line[0] == "!"
                raw[-1] += [(header, part, i) for part in _split(line[1:], ("||", "!!") if header else ("||",))]
            elif line and raw[-1]:
                header, before, at = raw[-1][-1]
                raw[-1][-1] = (header, f"{before}\n{line}", at)
            elif line:
                faults.append((i, "text outside cells"))
            i += 1
        if depth:
            faults.append((begin, "table without end"))
        cells, taken = [], {}
        for row, parts in enumerate(r for r in raw if r):
            col = 0
            for header, part, at in parts:
                while (row, col) in taken:
                    col += 1
                across, down, markup = _content(part)
                if not 1 <= across <= MOST_SPAN or not 1 <= down <= MOST_SPAN:
                    faults.append((at, "span out of range"))
                    across = down = 1
                said, target = plain(markup)
                for y in range(row, row + down):
                    for x in range(col, col + across):
                        if (y, x) in taken:
                            faults.append((at, "cells overlap"))
                            continue
                        taken[y, x] = True
                        cells.append(Cell(y, x, header, said, target, (y, x) != (row, col)))
                col += across
        last = max((r for r, _ in taken), default=-1)
        rows = sum(1 for r in raw if r)
        if last >= rows:
            faults.append((begin, "span beyond the table's end"))
            cells = [c for c in cells if c.row < rows]
        yield number, cells, faults
        number += 1


def _over(pages: DataFrame, page: str, text: str, which: int, schema: str) -> DataFrame:
    names = [f.split()[0] for f in schema.split(", ")]
    kinds = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_()}
    arrow = pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in schema.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = [(name, found[0], *x) for found in parse(body.as_py()) for x in found[which]]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), arrow.types, strict=True)], names)

    rows = pages.filter(F.col(text).contains("{|")).select(F.col(page).cast("string"), F.col(text))
    return rows.mapInArrow(run, schema)


def cells(pages: DataFrame, page: str = "page", text: str = "text") -> DataFrame:
    """(page, table, row, col, header, text, target, spanned): a row for each place that a cell covers; ``spanned`` where it reaches from another place.

    target is the cell's first link. Pages without tables, and null ones, have none.
    """
    return _over(pages, page, text, 1, CELLS)


def faults(pages: DataFrame, page: str = "page", text: str = "text") -> DataFrame:
    """(page, table, line, fault): what cells() could not take as it stands, by the page's lines from 0."""
    return _over(pages, page, text, 2, FAULTS)
