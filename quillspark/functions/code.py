"""Python source spans. The grammar needs a parser, so this runs as an Arrow-batched UDF."""

from __future__ import annotations

import ast

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_SCHEMA = "array<struct<unit_type:string,symbol:string,kind:string,line_start:int,line_end:int>>"
_KINDS = {ast.FunctionDef: "def", ast.AsyncFunctionDef: "async def", ast.ClassDef: "class"}


def spans_of(source: str | None) -> list[tuple]:
    """Top-level definitions and the lines between them; nothing for what does not parse.
    A decorator belongs to the lines before its definition."""
    try:
        body = ast.parse(source or "").body
    except (SyntaxError, ValueError, RecursionError):
        return []
    out, at, last = [], 1, len((source or "").splitlines())
    for node in body:
        if kind := _KINDS.get(type(node)):
            if at < node.lineno:
                out.append(("code_context", "module", "module", at, node.lineno - 1))
            out.append(("code_symbol", node.name, kind, node.lineno, node.end_lineno))
            at = node.end_lineno + 1
    if at <= last:
        out.append(("code_context", "module", "module", at, last))
    return out


def python_spans(source) -> Column:
    return _udf(lambda s: s.map(spans_of), _SCHEMA)(source)


def _udf(f, returns: str):
    """Made when called, so that a worker without a session can import this module."""

    def run(s: pd.Series) -> pd.Series:
        return f(s)

    return F.pandas_udf(run, returns)
