"""Workload of PL/SQL subprograms: events to metrics, score, evidence and mode, by aggregation and expressions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from impactframe.functions.plsql_workload import Unterminated, workload_events

# Lines and units of a short source, score from which several passes are advised, caps, lines to a point.
SHORT, MULTI_PASS, STRUCTURE_CAP, PHYSICAL_CAP, LINES_PER_POINT = 50, 100, 30, 10, 50
SUMS = (
    "decisions", "loops", "nested_control_units", "sql_statements", "joins", "additional_query_blocks", "set_operations",
    "grouping_clauses", "aggregates", "windows", "complex_mappings", "cursor_declarations", "exception_handlers",
)
SQL_STRUCTURE = ("joins", "additional_query_blocks", "set_operations", "grouping_clauses", "aggregates", "windows")


def events(functions: DataFrame) -> DataFrame:
    """(scope, id, kind, amount, name) of PL/SQL subprograms (scope, id, source); a text whose literals or comments never end
    gives one row of kind `error` with the message as its name."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for scope, key, source in zip(frame.scope, frame.id, frame.source):
                try:
                    rows += [(scope, key, *e) for e in workload_events(source or "")]
                except Unterminated as error:
                    rows.append((scope, key, "error", 0.0, str(error)))
            yield pd.DataFrame(rows, columns=["scope", "id", "kind", "amount", "name"])

    return functions.select("scope", "id", "source").mapInPandas(run, "scope string, id string, kind string, amount double, name string")


def metrics(found: DataFrame) -> DataFrame:
    """One row per (scope, id) with every counter, or with `error` and nulls."""
    amount = lambda kind, how=F.sum: F.coalesce(how(F.when(F.col("kind") == kind, F.col("amount"))), F.lit(0.0))
    rows = found.groupBy("scope", "id").agg(
        F.max(F.when(F.col("kind") == "error", F.col("name"))).alias("error"),
        amount("physical_code_lines").cast("int").alias("physical_code_lines"),
        F.greatest(F.lit(0), (amount("physical_code_lines") - amount("discounted_lines")).cast("int")).alias("adjusted_code_lines"),
        (amount("quarters") / 4).alias("logical_units"),
        amount("max_control_depth", F.max).cast("int").alias("max_control_depth"),
        F.count_distinct(F.when(F.col("kind") == "fetch", F.col("name"))).cast("int").alias("fetched_cursors"),
        *[amount(k).cast("int").alias(k) for k in SUMS],
    )
    kept = ["scope", "id", "error"]
    return rows.select(*kept, *[F.when(F.col("error").isNull(), F.col(c)).alias(c) for c in rows.columns if c not in kept])


def sql_structure_units() -> Column:
    return sum((F.col(c) for c in SQL_STRUCTURE[1:]), F.col(SQL_STRUCTURE[0]))


def assess(measured: DataFrame) -> DataFrame:
    """Adds evidence (reason, points) in a fixed order, score and mode to metrics; null where they are."""
    control = 2 * F.col("decisions") + F.col("loops") + 3 * F.col("nested_control_units")
    sql = 2 * sql_structure_units()
    other = F.col("cursor_declarations") + F.col("fetched_cursors") + F.col("exception_handlers")
    structure = control + sql + other
    short = (F.col("physical_code_lines") <= SHORT) & (F.col("logical_units") <= SHORT)
    points = {
        "logical_length": F.col("logical_units"),
        "adjusted_code_length": F.greatest(F.lit(0.0), F.col("adjusted_code_lines") - F.col("logical_units")),
        "control_structure": control,
        "sql_structure": sql,
        "cursor_and_exceptions": other,
        "structure_cap": F.least(F.lit(STRUCTURE_CAP), structure) - structure,
        "physical_length": F.least(F.lit(float(PHYSICAL_CAP)), F.col("physical_code_lines") / LINES_PER_POINT),
    }
    rows = [F.struct(F.lit(r).alias("reason"), p.cast("double").alias("points")) for r, p in points.items()]
    brief = F.when(short, F.struct(F.lit("short_source").alias("reason"), F.lit(0.0).alias("points")))
    score = F.round(sum((p.cast("double") for p in points.values()), F.lit(0.0)), 2)
    known = F.col("error").isNull()
    mode = F.when(~short & (score >= MULTI_PASS), "multi_pass").otherwise("single_pass")
    return measured.select(
        "*", F.when(known, score).alias("score"), F.when(known, mode).alias("mode"), F.when(known, F.array_compact(F.array(*rows, brief))).alias("evidence")
    )


def plsql_workload(functions: DataFrame) -> DataFrame:
    """Metrics, score, mode and evidence of every PL/SQL function (scope, id, source); see metrics and assess."""
    return assess(metrics(events(functions)))
