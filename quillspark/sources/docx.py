"""Word files by the standard library: their body in order, as an array of items.

A file is a zip of XML parts, read in a pandas UDF over its bytes; what follows is in
expressions (operators/word.py). A file that can't be read has null items."""

from __future__ import annotations

import io
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: place counts paragraphs and tables of the body from 1; cells are null but for tables.
ITEMS = "array<struct<place:int,text:string,style:string,outline:int,breaks:boolean,cells:array<array<string>>>>"
#: Fixed value: the name space of the format.
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
#: What elements of a run stand for.
SIGNS = {"tab": "\t", "ptab": "\t", "cr": "\n", "noBreakHyphen": "-"}


def _text(paragraph) -> str:
    out = []
    for child in paragraph:
        runs = [child] if child.tag == W + "r" else child.findall(W + "r") if child.tag == W + "hyperlink" else []
        for part in (x for run in runs for x in run):
            name = part.tag.removeprefix(W)
            if name == "t":
                out.append(part.text or "")
            elif name == "br":
                out.append("\n" if part.get(W + "type", "textWrapping") == "textWrapping" else "")
            else:
                out.append(SIGNS.get(name, ""))
    return "".join(out)


def _value(element, path: str) -> str | None:
    found = None if element is None else element.find("/".join(W + p for p in path.split("/")))
    return None if found is None else found.get(W + "val")


def _cells(table) -> list[list[str]]:
    """Texts by row; a cell over several columns stands in each, one over several rows in each."""
    rows: list[list[str]] = []
    for tr in table.findall(W + "tr"):
        row: list[str] = []
        for tc in tr.findall(W + "tc"):
            merge = tc.find(f"{W}tcPr/{W}vMerge")
            text = "\n".join(_text(p) for p in tc.findall(W + "p"))
            if merge is not None and merge.get(W + "val", "continue") == "continue" and rows and len(rows[-1]) > len(row):
                text = rows[-1][len(row)]
            row += [text] * int(_value(tc, "tcPr/gridSpan") or 1)
        rows.append(row)
    return rows


def _breaks(paragraph) -> bool:
    pages = any(b.get(W + "type") == "page" for b in paragraph.iter(W + "br"))
    return pages or next(paragraph.iter(W + "lastRenderedPageBreak"), None) is not None


def items_of(content: bytes | None) -> list[dict] | None:
    try:
        with zipfile.ZipFile(io.BytesIO(content or b"")) as parts:
            body = ElementTree.fromstring(parts.read("word/document.xml")).find(W + "body")
            known = ElementTree.fromstring(parts.read("word/styles.xml")) if "word/styles.xml" in parts.namelist() else ()
        styles = {s.get(W + "styleId"): s for s in known if s.tag == W + "style"}
        usual = next((k for k, s in styles.items() if s.get(W + "type") == "paragraph" and s.get(W + "default") in ("1", "true")), None)
        out = []
        for child in body:
            if child.tag == W + "p":
                style = styles.get(_value(child, "pPr/pStyle") or usual, styles.get(usual))
                level = _value(child, "pPr/outlineLvl") or _value(style, "pPr/outlineLvl")
                out.append({"text": _text(child), "style": _value(style, "name") or "", "outline": int(level) + 1 if level else None, "breaks": _breaks(child), "cells": None})
            elif child.tag == W + "tbl":
                out.append({"text": None, "style": None, "outline": None, "breaks": False, "cells": _cells(child)})
        return [{"place": i, **x} for i, x in enumerate(out, 1)]
    except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, TypeError, ValueError, NotImplementedError, RuntimeError):
        return None


def docx_items(content) -> Column:
    """A file's items, null if it is no such file."""

    def run(s: pd.Series) -> pd.Series:
        return s.map(items_of)

    return F.pandas_udf(run, ITEMS)(content)
