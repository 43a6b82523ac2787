"""Splitting oversized items at natural boundaries (problem 5).

Content-defined chunking: a rolling hash over the last characters marks landmarks, each landmark snaps to the nearest
natural boundary (line starts; hunk headers, blank lines and subprogram heads rank higher), and a piece ends at the
strongest snapped landmark between its minimum and maximum size. Where no line starts there, the landmarks snap to
sentence and statement ends, then to commas, then to blanks; then any earlier boundary past the overlap serves, then a
bare landmark, and only a stretch without any is cut at the maximum. Where a piece ends depends on nearby text alone, so an edit alters only neighbouring pieces.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_CHARS = 4_000
MAX_UNITS = 120.0
OVERLAP = 200
#: Characters that the rolling hash sees, and one landmark is expected in so many characters.
WINDOW = 32
SPACING = 64

_LINE = re.compile(r"\r\n|\n|\r")
#: Boundaries inside lines, best first: ends of sentences and statements, commas, blanks. A position is after the match.
_INNER = (re.compile(r"[;{}。！？；]|[.!?](?=\s)"), re.compile(r"[,，、]"), re.compile(r"[^\S\r\n]+"))
_HUNK = re.compile(r"@@|diff |--- |\+\+\+ ")
_HEAD = re.compile(r"[ +-]?\s*(?:(?:public|private|friend|static)\s+)?(?:procedure|function|sub|def|class|async\s+def|create)\b", re.I)


def rolling_hash(text: str) -> np.ndarray:
    """Hash of the up to WINDOW characters before each position, 0 .. len(text)."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    mixed = ((codes + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(17)
    out = np.zeros(len(codes) + 1, np.uint64)
    for back in range(min(WINDOW, len(codes))):
        out[back + 1 :] += mixed[: len(codes) - back] * np.uint64((0x100000001B3 * (2 * back + 1)) & 0xFFFFFFFF)
    return (out * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(32)


def natural_boundaries(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Positions at which a line starts, and their rank: 3 hunk header, 2 after a blank line or at a head, else 1."""
    starts, ranks, before = [], [], 0
    for m in _LINE.finditer(text):
        at = m.end()
        blank = not text[before : m.start()].strip(" \t+-")
        rank = 3 if _HUNK.match(text, at) else 2 if blank or _HEAD.match(text, at) else 1
        if at < len(text):
            starts.append(at)
            ranks.append(rank)
        before = at
    return np.array(starts, np.int64), np.array(ranks, np.int64)


def _unsplit(text: str, at: int) -> int:
    """A hard cut never parts CR from LF."""
    return at - 1 if 0 < at < len(text) and text[at - 1] == "\r" and text[at] == "\n" and at > 1 else at


def split(text: str, units: float | None = None, max_chars: int = MAX_CHARS, max_units: float = MAX_UNITS, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """[(start, end)] of ordered pieces that cover the text, each within both limits, neighbours sharing up to `overlap`.

    The units of a piece are the text's units times its share of the characters. A text within both limits is one
    piece, an empty one none. Where a single character exceeds max_units, pieces of one character are the least possible.
    """
    n = len(text)
    if not n:
        return []
    most = max_chars
    if units is not None and units > max_units:
        most = max(1, min(most, int(max_units * n / units)))
    if n <= most:
        return [(0, n)]
    shared = min(overlap, most // 4)
    least = max(shared + 1, most // 3)
    starts, ranks = natural_boundaries(text)
    hashes = rolling_hash(text)
    marks, strength = _candidates(hashes, starts, ranks)
    inner: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    pieces, start = [], 0
    while n - start > most:
        lo, hi = start + least, start + most
        i, j = np.searchsorted(marks, lo), np.searchsorted(marks, hi, "right")
        if i < j:
            end = int(marks[i + int(np.argmax(strength[i:j]))])
        else:
            k = np.searchsorted(starts, hi, "right") - 1
            if k >= 0 and starts[k] >= lo:
                end = int(starts[k])
            else:
                inner = inner or _inner(text, hashes)
                end = _inside(inner[:-1], lo, hi) or _early(starts, inner, start + shared, lo) or _inside(inner[-1:], lo, hi) or _unsplit(text, hi)
        end = end if end > start else hi
        pieces.append((start, end))
        k = np.searchsorted(starts, end - shared)
        if k < len(starts) and starts[k] < end:
            back = int(starts[k])
        else:
            inner = inner or _inner(text, hashes)
            back = _first(inner, end - shared, end) or _unsplit(text, end - shared)
        start = back if start < back <= end else end
    pieces.append((start, n))
    return pieces


def _candidates(hashes: np.ndarray, starts: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Landmarks of the rolling hash snapped to the nearest natural boundary, with the strength of each."""
    at = np.flatnonzero(hashes % np.uint64(SPACING) == 0)
    if not len(starts) or not len(at):
        return np.array([], np.int64), np.array([], np.float64)
    right = np.clip(np.searchsorted(starts, at), 0, len(starts) - 1)
    left = np.clip(right - 1, 0, None)
    near = np.where(np.abs(starts[right] - at) < np.abs(starts[left] - at), right, left)
    near = np.unique(near)
    return starts[near], ranks[near] + _drawn(hashes, starts[near])


def _drawn(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (hashes[at] % np.uint64(1 << 20)).astype(np.float64) / (1 << 20)


def _inner(text: str, hashes: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(boundaries, landmarks snapped to them, their strength) of each rank inside lines, then of bare landmarks."""
    out = []
    for pattern in _INNER:
        ends = np.array([m.end() for m in pattern.finditer(text) if m.end() < len(text)], np.int64)
        out.append((ends, *_candidates(hashes, ends, np.zeros(len(ends)))))
    bare = np.flatnonzero(hashes % np.uint64(SPACING) == 0)
    bare = np.array([x for x in bare if 0 < x < len(text) and text[x - 1 : x + 1] != "\r\n"], np.int64)
    return [*out, (np.zeros(0, np.int64), bare, _drawn(hashes, bare))]


def _inside(inner: list[tuple[np.ndarray, np.ndarray, np.ndarray]], lo: int, hi: int) -> int | None:
    """The strongest snapped landmark of the best rank within [lo, hi], else that rank's last boundary."""
    for ends, marks, strength in inner:
        i, j = np.searchsorted(marks, lo), np.searchsorted(marks, hi, "right")
        if i < j:
            return int(marks[i + int(np.argmax(strength[i:j]))])
        k = np.searchsorted(ends, hi, "right") - 1
        if k >= 0 and ends[k] >= lo:
            return int(ends[k])
    return None


def _early(starts: np.ndarray, inner: list[tuple[np.ndarray, np.ndarray, np.ndarray]], over: int, lo: int) -> int | None:
    """The last boundary of the best rank in (over, lo), for want of a later one."""
    for ends in (starts, *(e for e, _, _ in inner)):
        k = np.searchsorted(ends, lo) - 1
        if k >= 0 and ends[k] > over:
            return int(ends[k])
    return None


def _first(inner: list[tuple[np.ndarray, np.ndarray, np.ndarray]], lo: int, hi: int) -> int | None:
    """Where the overlap begins: the first boundary of the best rank within [lo, hi), else the first bare landmark."""
    for ends in (*(e for e, _, _ in inner[:-1]), inner[-1][1]):
        k = np.searchsorted(ends, lo)
        if k < len(ends) and ends[k] < hi:
            return int(ends[k])
    return None


def oversized(function_change: DataFrame, max_chars: int = MAX_CHARS, max_units: float = MAX_UNITS) -> DataFrame:
    """Distinct (fchange_id, diff, logical_units) above either limit and the diff's hash; rows without fchange_id are left out."""
    over = (F.length("diff") > max_chars) | (F.col("logical_units") > max_units)
    rows = function_change.where(over & F.col("fchange_id").isNotNull()).select("fchange_id", "diff", "logical_units").dropDuplicates()
    return rows.withColumn("diff_key", F.md5("diff"))


def split_changes(function_change: DataFrame, max_chars: int = MAX_CHARS, max_units: float = MAX_UNITS, overlap: int = OVERLAP) -> DataFrame:
    """(fchange_id, diff_key, whole_units, piece_no, start_char, end_char, shared_chars, units, piece): pieces of every
    oversized function diff.

    diff_key (a hash of the diff) and whole_units tell apart several diffs of one id. Offsets count code points. shared_chars is the overlap with the piece before. Repeated rows are split once; rows
    of one id with different diffs are split each. A null or empty diff above the unit limit gives one row with
    piece_no 0 and a null piece. Null units set no limit of their own. NaN units count as above any limit but bound
    nothing.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for key, text, units, hashed in zip(frame.fchange_id, frame["diff"], frame.logical_units, frame.diff_key):
                whole = None if units is None or units != units else units
                known = None if pd.isna(units) or units == float("inf") else float(units)
                if not text:
                    rows.append((key, hashed, whole, 0, 0, 0, 0, known, None))
                    continue
                before = 0
                for no, (a, b) in enumerate(split(text, known, max_chars, max_units, overlap), 1):
                    share = None if known is None else known * (b - a) / len(text)
                    rows.append((key, hashed, whole, no, a, b, max(0, before - a), share, text[a:b]))
                    before = b
            yield pd.DataFrame(rows, columns=["fchange_id", "diff_key", "whole_units", "piece_no", "start_char", "end_char", "shared_chars", "units", "piece"])

    schema = "fchange_id bigint, diff_key string, whole_units double, piece_no int, start_char int, end_char int, shared_chars int, units double, piece string"
    return oversized(function_change, max_chars, max_units).mapInPandas(run, schema)
