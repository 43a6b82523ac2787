"""Source files that do not parse (problem 4).

Each file's token stream is taken through memoised derivatives of its language's grammar. The token at which the
derivative becomes empty is where the file fails; an end derivative that does not accept the end marks truncation.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from impactframe.llm import grammars, lexers
from impactframe.llm.derivatives import Grammar
from impactframe.session import spread

#: Languages and the extensions that stand for them.
EXTENSIONS = {
    "pkb": "plsql", "pks": "plsql", "pls": "plsql", "sql": "plsql", "bas": "vba", "cls": "vba", "frm": "vba", "py": "python",
}
LEXERS = {"plsql": lexers.plsql_tokens, "vba": lexers.vba_tokens, "python": lexers.python_tokens}
RULES = {"plsql": grammars.PLSQL, "vba": grammars.VBA, "python": grammars.PYTHON}
_parsers: dict[str, Grammar] = {}


def language_of(language: Column, source_id: Column) -> Column:
    """The hint in lower case, else what the extension stands for, else null."""
    ext = F.lower(F.regexp_extract(source_id, r"\.([^./\\]+)$", 1))
    known = F.create_map(*[F.lit(x) for pair in EXTENSIONS.items() for x in pair])
    hint = F.lower(F.trim(language))
    return F.coalesce(F.nullif(hint, F.lit("")), known[ext])


def parser(language: str) -> Grammar:
    """One parser per language and worker process, so its memo serves every file of the task and later ones."""
    if language not in _parsers:
        _parsers[language] = Grammar(RULES[language], "file")
    return _parsers[language]


def verdict(text: str, language: str) -> tuple[str, int, int]:
    """(valid | token | truncated, line, token number) of a whole file; line and number are 0 where it is valid."""
    text = lexers.plain_lines(text)
    tokens = LEXERS[language](text)
    found, at = parser(language).parse([kind for kind, _ in tokens])
    if found == "valid":
        return "valid", 0, 0
    kind, line = tokens[min(at, len(tokens) - 1)] if tokens else ("", 1)
    at_end = at >= len(tokens) or kind in ("OPEN", "ENDMARKER") or all(k in ("NL", "NEWLINE", "DEDENT", "ENDMARKER") for k, _ in tokens[at:])
    return ("truncated" if at_end else "token"), line, at + 1


def check_sources(source_file: DataFrame) -> DataFrame:
    """(source_id, repo, language, verdict, line, token_no), one row per distinct outcome of a file.

    verdict: `valid`, `token` (the named token cannot stand there), `truncated` (the file ends too early). Files of
    another or no language and null contents get verdict null; an empty file is valid. Redelivered rows collapse.
    """
    known = source_file.where(F.col("source_id").isNotNull()).select(
        "source_id", "repo", language_of(F.col("language"), F.col("source_id")).alias("language"), "content"
    )

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for text, language in zip(frame.content, frame.language):
                judged = text is not None and language in LEXERS
                rows.append(verdict(text, language) if judged else (None, 0, 0))
            out = frame[["source_id", "repo", "language"]].copy()
            out[["verdict", "line", "token_no"]] = pd.DataFrame(rows, index=out.index, columns=["verdict", "line", "token_no"])
            yield out

    schema = "source_id string, repo string, language string, verdict string, line int, token_no int"
    return spread(known).mapInPandas(run, schema).distinct()


def invalid_rates(checked: DataFrame) -> DataFrame:
    """(repo, language, files, invalid, rate) over the judged files; a null repo is a group of its own."""
    bad = F.col("verdict") != "valid"
    per_file = checked.where(F.col("verdict").isNotNull()).groupBy("repo", "language", "source_id").agg(
        F.max(bad.cast("int")).alias("bad")
    )
    return per_file.groupBy("repo", "language").agg(
        F.count("*").alias("files"), F.sum("bad").alias("invalid"), F.avg("bad").alias("rate")
    )
