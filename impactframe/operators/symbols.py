"""Symbols of Python sources and their changes between two texts of a file."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from pathlib import PurePosixPath

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from impactframe.functions.syntax import python_symbols
from impactframe.functions.text import suffix
from impactframe.operators.compare import compare

SYMBOL = "name string, symbol_type string, declaration string, content string, body_hash string, start_line int, end_line int, nested boolean, ord int"


#: Parsers by extension in lower case: text to symbols as of `python_symbols`. Further languages register theirs.
PARSERS: dict[str, Callable[[str], list[dict]]] = {".py": python_symbols}


def register(extension: str, parser: Callable[[str], list[dict]]) -> None:
    PARSERS["." + extension.lower().lstrip(".")] = parser


def has_parser(path: Column) -> Column:
    return F.lower(suffix(path)).isin(*PARSERS)


def extract_symbols(texts: DataFrame, classes: bool = False, nested: bool = False) -> DataFrame:
    """(path, symbol...) of (path, text); of several definitions of a name the last counts, at the first one's place.

    The extension picks the parser, Python's where none is registered for it. Methods always count, classes and functions
    inside functions only if asked. Null, empty and unparsable texts give none.
    """
    parsers = dict(PARSERS)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["path", *(c.strip().split()[0] for c in SYMBOL.split(","))]
        for frame in frames:
            rows = []
            for path, text in zip(frame.path, frame.text):
                found: dict[str, dict] = {}
                parser = parsers.get(PurePosixPath(path or "").suffix.lower(), python_symbols)
                for s in parser(text or ""):
                    if (classes if s["symbol_type"] == "class" else nested or not s["nested"]):
                        found[s["name"]] = s
                rows += [{"path": path, "ord": k, **s} for k, s in enumerate(found.values())]
            yield pd.DataFrame(rows, columns=names)

    return texts.select("path", "text").mapInPandas(run, "path string, " + SYMBOL)


def symbol_changes(changes: DataFrame, classes: bool = False, nested: bool = False) -> DataFrame:
    """(path, name, status, old_*, new_*, ord) for file changes (path, old_text, new_text); a null text is no file.

    ord numbers a file's changes: added, modified, deleted, each in source order.
    """
    known = changes.where(has_parser(F.col("path")))
    side = lambda c: extract_symbols(known.where(F.col(c).isNotNull()).select("path", F.col(c).alias("text")), classes, nested)
    carry = ["symbol_type", "declaration", "content", "start_line", "end_line", "ord"]
    found = compare(side("old_text"), side("new_text"), ["path", "name"], "body_hash", carry)
    rank = F.when(F.col("status") == "added", 0).when(F.col("status") == "modified", 1).otherwise(2)
    order = Window.partitionBy("path").orderBy(rank, F.coalesce("new_ord", "old_ord"))
    return found.withColumn("ord", F.row_number().over(order))
