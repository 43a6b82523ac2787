"""Text and byte functions: decoding, classification, diffs, patterns, paths and Markdown cells."""

from __future__ import annotations

import difflib
import fnmatch
import hashlib
import re
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value: a line longer than this makes a file binary.
LONGEST_LINE = 1 << 20

# Byte order marks that decide the encoding, in the order of test.
MARKS = (
    (b"\xff\xfe\x00\x00", "utf-32"),
    (b"\x00\x00\xfe\xff", "utf-32"),
    (b"\xff\xfe", "utf-16"),
    (b"\xfe\xff", "utf-16"),
)


def is_binary(data: bytes) -> bool:
    """NUL bytes, or a line of more than LONGEST_LINE bytes."""
    if b"\0" in data:
        return True
    at = 0
    while len(data) - at > LONGEST_LINE:
        end = data.find(b"\n", at, at + LONGEST_LINE + 1)
        if end < 0:
            return True
        at = end + 1
    return False


def decode_strict(data: bytes) -> str | None:
    """Text of marked UTF-32 or UTF-16, or of strict UTF-8 (a mark stays); null for binary or undecodable bytes."""
    codec = next((name for mark, name in MARKS if data.startswith(mark)), None)
    if codec is None and is_binary(data):
        return None
    try:
        return data.decode(codec or "utf-8")
    except UnicodeError:
        return None


def classify(data: bytes | None) -> tuple[str, str | None]:
    """(availability, text) of a file's bytes; null bytes are unreadable."""
    if data is None:
        return "unreadable", None
    text = decode_strict(data)
    if text is not None:
        return "text", text
    marked = any(data.startswith(mark) for mark, _ in MARKS)
    return ("binary" if is_binary(data) and not marked else "undecodable"), None


def _ladder(data: bytes, codecs: Iterable[str]) -> str | None:
    for codec in codecs:
        try:
            return data.decode(codec)
        except UnicodeError:
            pass
    return None


def decode_lenient(data: bytes) -> str:
    """Marked text, else the first of UTF-8, UTF-16, UTF-16-LE, GBK and Windows-1252 that fits, else with losses."""
    if data[:2] in (b"\xff\xfe", b"\xfe\xff"):
        found = _ladder(data, ("utf-16",))
    elif data[:3] == b"\xef\xbb\xbf":
        found = _ladder(data, ("utf-8-sig",))
    else:
        found = None
    if found is None:
        found = _ladder(data, ("utf-8", "utf-16", "utf-16-le", "gbk", "cp1252"))
    return data.decode("utf-8", "replace") if found is None else found


def decode_export(data: bytes) -> str:
    """Text of a form export: marks, then the parity of NULs in the first KiB, then UTF-8, GBK, Windows-1252."""
    if data[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return data.decode("utf-16")
    if data[:3] == b"\xef\xbb\xbf":
        return data.decode("utf-8-sig")
    if b"\0" in data[:1024]:
        odd, even = data[1::2].count(0), data[0::2].count(0)
        return data.decode("utf-16-le" if odd >= even else "utf-16-be")
    found = _ladder(data, ("utf-8", "gbk", "cp1252"))
    if found is None:
        raise ValueError("the export fits no supported encoding")
    return found


@F.pandas_udf(T.StructType().add("availability", T.StringType()).add("text", T.StringType()))
def content_snapshot(content: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([classify(None if b is None else bytes(b)) for b in content], columns=["availability", "text"])


@F.pandas_udf(T.StringType())
def lenient_text(content: pd.Series) -> pd.Series:
    return content.map(lambda b: None if b is None else decode_lenient(bytes(b)))


@F.pandas_udf(T.StringType())
def casefold(text: pd.Series) -> pd.Series:
    """Full Unicode case folding; SQL's lower differs for some letters."""
    return text.map(lambda t: None if t is None else t.casefold())


def unified(old: str | None, new: str | None, old_label: str, new_label: str) -> str:
    """Unified diff with three lines of context; a null side is empty."""
    lines = difflib.unified_diff((old or "").splitlines(), (new or "").splitlines(), old_label, new_label, lineterm="")
    text = "\n".join(lines)
    return text + "\n" if text else ""


@F.pandas_udf(T.StringType())
def file_diff(path: pd.Series, old: pd.Series, new: pd.Series) -> pd.Series:
    """Diff of a file's two texts under the labels a/path and b/path."""
    return pd.Series([unified(o, n, f"a/{p}", f"b/{p}") for p, o, n in zip(path, old, new)], dtype=object)


@F.pandas_udf(T.StringType())
def function_diff(old_id: pd.Series, new_id: pd.Series, old: pd.Series, new: pd.Series) -> pd.Series:
    """Diff of a function's two sources under `<source_id>:baseline` and `<source_id>:working`."""
    pairs = zip(old_id, new_id, old, new)
    return pd.Series([unified(o, n, f"{a or b}:baseline", f"{b or a}:working") for a, b, o, n in pairs], dtype=object)


def stripped_hash(text: str) -> str:
    return hashlib.sha256(text.strip().encode("utf-8")).hexdigest()


# patterns and paths, all inside the JVM


def glob_regex(pattern: str) -> str:
    """Anchored regular expression of a shell pattern whose `*` crosses `/`; a leading `**/` also matches at the root."""
    out = []
    for p in [pattern, pattern[3:]] if pattern.startswith("**/") else [pattern]:
        body = fnmatch.translate(p)
        body = re.sub(r"^\(\?s:(.*)\)(?:\\Z|\\z)$", r"\1", body, flags=re.S)
        out.append(re.sub(r"\(\?>", "(?:", body))
    return "^(?s:" + "|".join(f"(?:{b})" for b in out) + ")$"


def matches_patterns(path: Column, includes: list[str], excludes: list[str]) -> Column:
    """(no includes, or any include) and no exclude."""
    hit = lambda patterns: [path.rlike(glob_regex(p)) for p in patterns]
    wanted, banned = F.lit(True), F.lit(False)
    if includes:
        wanted = F.lit(False)
        for c in hit(includes):
            wanted = wanted | c
    for c in hit(excludes):
        banned = banned | c
    return wanted & ~banned


def under(path: Column, directory: str) -> Column:
    """Whether path is the directory or lies below it."""
    return (path == directory) | path.startswith(directory.rstrip("/") + "/")


def suffix(path: Column) -> Column:
    """Extension with its dot, in its letter case; empty for none and for names that merely start with a dot."""
    return F.regexp_extract(path, r"[^/.][^/]*?(\.[^./]+)$", 1)


def stem(path: Column) -> Column:
    """Last component without its extension."""
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    return F.when(suffix(path) == "", name).otherwise(F.regexp_replace(name, r"\.[^.]+$", ""))


def document_key(path: Column) -> Column:
    """docs/<path with extension .md>"""
    return F.concat(F.lit("docs/"), F.regexp_replace(path, r"(?<=[^/.])\.[^./]+$", ""), F.lit(".md"))


def escape_cell(value: Column) -> Column:
    """Backslashes and pipes escaped, line ends as <br>; empty or null is `-`."""
    text = F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|"))
    text = F.replace(text, F.lit("\n"), F.lit("<br>"))
    return F.when(F.coalesce(F.length(value), F.lit(0)) == 0, F.lit("-")).otherwise(text)
