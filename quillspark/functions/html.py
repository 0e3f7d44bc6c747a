"""HTML text and tables. A parser is stateful, so these run as Arrow-batched UDFs."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


class _Text(HTMLParser):
    """Non-empty stripped data, script and style text too; tables left out on request."""

    def __init__(self, tables: bool):
        super().__init__()
        self.parts, self.inside, self.tables = [], 0, tables

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.inside += 1

    def handle_endtag(self, tag):
        if tag == "table" and self.inside:
            self.inside -= 1

    def handle_data(self, data):
        if data.strip() and (self.tables or not self.inside):
            self.parts.append(data.strip())


def html_text(page: str | None, tables: bool = True) -> str | None:
    if page is None:
        return None
    p = _Text(tables)
    p.feed(page)
    return "\n".join(p.parts)


class _Tables(HTMLParser):
    """Rows of cell texts for every table in the order of their start, nested ones too; an
    outer table has the rows of the tables inside it as well."""

    def __init__(self):
        super().__init__()
        self.tables, self.open, self.rows, self.cells = [], [], [], []

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.tables.append([])
            self.open.append(len(self.tables) - 1)
        elif tag == "tr" and self.open:
            row: list = []
            self.rows.append((row, list(self.open)))
            for t in self.open:
                self.tables[t].append(row)
        elif tag in ("td", "th") and self.rows:
            cell: list = []
            self.cells.append(cell)
            for row, _ in self.rows:
                row.append(cell)

    def handle_endtag(self, tag):
        if tag == "table" and self.open:
            self.open.pop()
        elif tag == "tr" and self.rows:
            self.rows.pop()
        elif tag in ("td", "th") and self.cells:
            self.cells.pop()

    def handle_data(self, data):
        if data.strip():
            for cell in self.cells:
                cell.append(data.strip())


def html_tables_of(page: str | None) -> list[list[list[str]]]:
    p = _Tables()
    p.feed(page or "")
    return [[[" ".join(cell) for cell in row] for row in t if row] for t in p.tables]


def html_to_text(page) -> Column:
    return _udf(lambda s: s.map(html_text), "string")(page)


def html_without_tables(page) -> Column:
    return _udf(lambda s: s.map(lambda p: html_text(p, False)), "string")(page)


def html_table_rows(page) -> Column:
    return _udf(lambda s: s.map(html_tables_of), "array<array<array<string>>>")(page)


def utf8_or_drop(content) -> Column:
    """Bytes as UTF-8, invalid ones dropped."""
    return _udf(lambda s: s.map(lambda b: None if b is None else bytes(b).decode("utf-8", "ignore")), "string")(content)


def _udf(f, returns: str):
    """Made when called, so that a worker without a session can import this module."""

    def run(s: pd.Series) -> pd.Series:
        return f(s)

    return F.pandas_udf(run, returns)
