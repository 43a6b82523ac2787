"""From changes to documents: which document a change belongs to, the prompts it gives, and the operations that come of it."""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from impactframe.functions.text import document_key
from impactframe.operators.forms import BREAK, CODE, is_form_source
from impactframe.operators.fragments import NAMESPACE, apply_operations, fragment_text
from impactframe.operators.ordering import running

Generator = Callable[[str, str], str]


def analysis_text(path: Column, text: Column) -> Column:
    """Text that is analysed: without a byte order mark, and of a form export only what follows its code marker line."""
    plain = F.regexp_replace(text, "^\\ufeff", "")
    code = F.regexp_extract(plain, rf"(?s)\A(?:.*?(?:{BREAK}))?[^\S\n\r]*{CODE}[^\S\n\r]*(?:{BREAK})(.*)\z", 1)
    return F.when(is_form_source(path), code).otherwise(plain)


def changes_by_document(changes: DataFrame) -> DataFrame:
    """Function changes (function_id, old_source_id, new_source_id, ...) with the key of their document and `ord` in it."""
    keyed = changes.withColumn("document_key", document_key(F.coalesce("new_source_id", "old_source_id")))
    return running(keyed, ["document_key"], F.col("function_id")).drop("total")


def function_fragments(changes: DataFrame) -> DataFrame:
    """(document_key, seq, fragment_id, kind, markdown): each changed function as a heading and its source, each deleted one as
    a deletion. changes: as of changes_by_document with new_name and new_source, null for deleted functions."""
    gone = F.col("new_source").isNull()
    source = F.regexp_replace("new_source", r"(?U)\s+$", "")
    body = F.concat(F.lit("## "), "new_name", F.lit("\n\n```sql\n"), source, F.lit("\n```\n"))
    return changes.select(
        "document_key", F.col("ord").cast("bigint").alias("seq"), F.concat(F.lit("function:"), "function_id").alias("fragment_id"),
        F.when(gone, "delete").otherwise("upsert").alias("kind"), F.when(~gone, body).alias("markdown"),
    )


def read_templates(system: str, user: str) -> tuple[str, list[str]]:
    """(system prompt, user templates in the order of their numbers) of two folders; ValueError where there is not exactly one
    system file, no numbered user template, or an empty one."""
    read = lambda folder, name: open(os.path.join(folder, name), encoding="utf-8").read()  # noqa: E731, SIM115
    first = [n for n in sorted(os.listdir(system)) if os.path.isfile(os.path.join(system, n))]
    numbered = [n for n in sorted(os.listdir(user)) if re.fullmatch(r"\d\d-.*\.user\.template", n)]
    if len(first) != 1 or not numbered:
        raise ValueError("one system prompt and at least one numbered user template are needed")
    prompt, templates = read(system, first[0]), [read(user, n) for n in numbered]
    if not all(t.strip() for t in [prompt, *templates]):
        raise ValueError("a prompt is empty")
    return prompt, templates


def filled(template: str, **fields: Column) -> Column:
    """The template with `{name}` replaced by each field; doubled braces are braces. Fields are not looked into."""
    parts = re.split(r"(\{\{|\}\}|\{\w+\})", template)
    return F.concat(*[F.lit(p[0]) if p in ("{{", "}}") else fields[p[1:-1]] if re.fullmatch(r"\{\w+\}", p) else F.lit(p) for p in parts])


def _history(existing: Column, summary: Column) -> Column:
    known = F.concat(
        F.lit("\n\n<ExistingFragment>\n"), existing, F.lit("\n</ExistingFragment>\n\n<ChangeSummary>\n"), summary, F.lit("\n</ChangeSummary>")
    )
    return F.when(existing.isNotNull(), known).otherwise("")


def with_existing(changes: DataFrame, documents: DataFrame, prefix: str, key: str, namespace: str = NAMESPACE) -> DataFrame:
    """Changes (document_key, `key`, ...) with fragment_id `<prefix>:<key>` and the markdown it has in documents (document_key,
    text) as `existing`, null where there is none."""
    from impactframe.operators.fragments import parse_documents

    known = parse_documents(documents, namespace)[1].select("document_key", "fragment_id", F.col("markdown").alias("existing"))
    return changes.withColumn("fragment_id", F.concat(F.lit(f"{prefix}:"), key)).join(known, ["document_key", "fragment_id"], "left")


def generated(changes: DataFrame, templates: tuple[str, list[str]], generate: Generator, **fields: str) -> DataFrame:
    """(document_key, seq, fragment_id, kind, markdown): the completions of every template in order, a blank line between.

    changes: (document_key, seq, fragment_id, code, summary, existing, ...); a null code deletes the fragment. fields name the
    columns that fill further places of the templates. The generator is called where the rows are; an empty completion is an
    error.
    """
    system, users = templates
    columns = {name: F.col(c) for name, c in fields.items()} | {"code": F.col("code"), "history": _history(F.col("existing"), F.coalesce("summary", F.lit("")))}
    asked = changes.select("document_key", "seq", "fragment_id", F.when(F.col("code").isNotNull(), F.array(*[filled(t, **columns) for t in users])).alias("prompts"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = []
            for fragment, prompts in zip(frame.fragment_id, frame.prompts):
                answers = None if prompts is None else [generate(system, p).strip() for p in prompts]
                if answers is not None and not all(answers):
                    raise ValueError(f"nothing was generated for {fragment}")
                texts.append(None if answers is None else "\n\n".join(answers))
            yield frame[["document_key", "seq", "fragment_id"]].assign(kind=["delete" if t is None else "upsert" for t in texts], markdown=pd.Series(texts, index=frame.index, dtype=object))

    return asked.mapInPandas(run, "document_key string, seq bigint, fragment_id string, kind string, markdown string")


def outline(system: str, user: str) -> str:
    """A generator for tests and demonstrations: the first line of the prompt and how long it is."""
    del system
    return f"### {user.strip().splitlines()[0]}\n\n{len(user)} characters" if user.strip() else ""


def publish(documents: DataFrame, ops: DataFrame, namespace: str = NAMESPACE) -> DataFrame:
    """(document_key, text) of the documents that the operations change; text is null where nothing is left of one.

    One fragment must not be named twice in a document.
    """
    named = Window.partitionBy("document_key", "fragment_id")
    twice = F.count("*").over(named) > 1
    once = ops.withColumn("kind", F.when(twice, F.raise_error(F.concat(F.lit("fragment named twice: "), "fragment_id"))).otherwise(F.col("kind")))
    changed = apply_operations(documents, once, namespace).where("changed")
    return changed.select("document_key", F.when(F.col("text") != "", F.col("text")).alias("text"))


def read_fragment(documents: DataFrame, fragment_id: str, namespace: str = NAMESPACE) -> DataFrame:
    """(document_key, markdown) of one fragment in every document, empty text where it is missing."""
    found = fragment_text(documents, fragment_id, namespace)
    return documents.select("document_key").join(found, "document_key", "left").withColumn("markdown", F.coalesce("markdown", F.lit("")))
