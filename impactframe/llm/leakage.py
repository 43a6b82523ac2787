"""Evaluation texts leaking into training text (problem 6).

Wu-Manber multi-pattern search over words. A pattern is every run of `size` consecutive words of an item. Tables for
a block of two words say how far a text window may be shifted; where the shift is zero, a bucket of the patterns with
that suffix is searched by prefix and then compared word by word. The items are a stated query set: they are searched
in blocks of bounded size against all documents, so that no broadcast grows with them.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from impactframe.session import spread

#: Letters and digits of any script; `_` is neither.
WORD = re.compile(r"[^\W_]+")
SIZE = 12
#: Words of items in one block of the search, the bound of what a task holds and a broadcast carries.
BLOCK_WORDS = 200_000


def words(text: str | None) -> list[str]:
    return [w.casefold() for w in WORD.findall(text)] if text else []


class WuManber:
    """Search tables for all runs of `size` words of the items, a list of (item_id, words)."""

    def __init__(self, items: Iterable[tuple[int, list[str]]], size: int = SIZE):
        self.size = size
        self.default = max(1, size - 1)
        self.shift: dict[tuple[str, str], int] = {}
        self.buckets: dict[tuple[str, str], dict[str, list[tuple[tuple[str, ...], set[int]]]]] = {}
        runs: dict[tuple[str, ...], set[int]] = {}
        for item, ws in items:
            for i in range(len(ws) - size + 1):
                runs.setdefault(tuple(ws[i : i + size]), set()).add(item)
        for run, ids in runs.items():
            for end in range(1, size):
                block = run[end - 1 : end + 1]
                self.shift[block] = min(self.shift.get(block, self.default), size - 1 - end)
            self.buckets.setdefault(run[-2:], {}).setdefault(run[0], []).append((run, ids))

    def search(self, ws: list[str]) -> dict[int, tuple[int, int]]:
        """{item: (first position of a hit in words, number of hit windows)}"""
        size, shift, default = self.size, self.shift, self.default
        at, n, found = size - 1, len(ws), {}
        while at < n:
            block = (ws[at - 1], ws[at])
            step = shift.get(block, default)
            if step:
                at += step
                continue
            start = at - size + 1
            for run, ids in self.buckets.get(block, {}).get(ws[start], ()):
                if all(a == b for a, b in zip(run, ws[start : at + 1])):
                    for item in ids:
                        first, count = found.get(item, (start, 0))
                        found[item] = (first, count + 1)
            at += 1
        return found


def leaked_items(documents: DataFrame, eval_item: DataFrame, size: int = SIZE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, item_id, first_word, n_windows): every document holding `size` consecutive words of an item.

    Null and empty texts and items of fewer words give no rows; repeated rows are searched once each and give repeated
    pairs; rows without doc_id or item_id are left out. Size must be 2 at least.
    """
    if size < 2:
        raise ValueError("size must be 2 at least")
    items = eval_item.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select("item_id", "text")
    weight = items.agg(F.sum(F.length("text") / 2 + 1)).first()[0] or 0  # words take two characters at least
    blocks = max(1, int(-(-weight // block_words)))
    docs = documents.where(F.col("doc_id").isNotNull() & (F.length("text") > 0)).select("doc_id", "text")
    out = None
    for k in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k)
        patterns = [(r.item_id, r.text) for r in part.toLocalIterator()]
        hits = _search(docs, patterns, size)
        out = hits if out is None else out.unionByName(hits)
    return out


def _search(docs: DataFrame, patterns: list[tuple[int, str]], size: int) -> DataFrame:
    carried = docs.sparkSession.sparkContext.broadcast(patterns)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tables = WuManber(((i, words(t)) for i, t in carried.value), size)
        for frame in frames:
            rows = [
                (doc, item, first, count)
                for doc, text in zip(frame.doc_id, frame.text)
                for item, (first, count) in tables.search(words(text)).items()
            ]
            yield pd.DataFrame(rows, columns=["doc_id", "item_id", "first_word", "n_windows"])

    return spread(docs).mapInPandas(run, "doc_id bigint, item_id bigint, first_word int, n_windows int")
