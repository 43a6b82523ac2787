"""Constants of VBA modules: declarations, the functions that use them, and what cannot be resolved.

Names are read from text in one pass per module and per function; visibility, shadowing and uniqueness are joins on
counted indexes, so a name that every module declares costs one row, and no use is paired with all declarations.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from impactframe.functions.text import stem
from impactframe.functions.vba_names import module_names, procedure_names
from impactframe.session import stage

MODULE = """scope string, source_id string, ord int, kind string, name string, name_cf string, visibility string, type_name string,
expression string, start_line int, end_line int, source string, line int, message string"""
USE = "scope string, source_id string, id string, ord int, kind string, name string, name_cf string, qualifier_cf string, line int"


def _rows(df: DataFrame, keys: list[str], schema: str, found: Callable[..., Iterator[dict]], text: list[str]) -> DataFrame:
    columns = [c.split()[0] for c in schema.replace("\n", " ").split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for values in zip(*(frame[c] for c in keys + text)):
                own = dict(zip(keys, values))
                out += [dict.fromkeys(columns) | own | {"ord": k} | row for k, row in enumerate(found(*values[len(keys) :]))]
            yield pd.DataFrame(out, columns=columns)

    return df.select(*keys, *text).mapInPandas(run, schema)


def declarations(sources: DataFrame) -> DataFrame:
    """What each VBA source (scope, source_id, content) declares at module level: constants, names that shadow, problems.

    A null content is an empty module. Adds `module_cf`, the stem of the file in lower case.
    """
    rows = _rows(sources.withColumn("content", F.coalesce("content", F.lit(""))), ["scope", "source_id"], MODULE, module_names, ["content"])
    return rows.withColumn("module_cf", F.lower(stem(F.col("source_id"))))


def uses(functions: DataFrame) -> DataFrame:
    """Names that the VBA functions (scope, id, source_id, source, name, start_line) may use as constants, and their locals."""
    first = functions.select("scope", "id", F.col("start_line").alias("_first"))
    rows = _rows(functions, ["scope", "source_id", "id"], USE, procedure_names, ["source", "name"])
    return rows.join(first, ["scope", "id"]).withColumn("line", F.col("line") + F.col("_first") - 1).drop("_first")


def duplicate_constants(declared: DataFrame) -> DataFrame:
    """Constants whose module has declared their name before."""
    order = Window.partitionBy("scope", "source_id", "name_cf").orderBy("ord")
    return declared.where("kind = 'constant'").withColumn("_n", F.row_number().over(order)).where("_n > 1").drop("_n")


def _index(rows: DataFrame, keys: list[str], prefix: str) -> DataFrame:
    """Per key: usable declarations, unusable ones, and the least usable one, which counts where it is the only one."""
    usable = F.col("kind") == "constant"
    one = F.min(F.when(usable, F.struct("source_id", "start_line", "name_cf", "ord", "module_cf"))).alias(f"{prefix}_one")
    return rows.groupBy(*keys).agg(F.sum(usable.cast("int")).alias(f"{prefix}_n"), F.sum((~usable).cast("int")).alias(f"{prefix}_blocked"), one)


def resolve_constants(used: DataFrame, declared: DataFrame, sources: DataFrame) -> DataFrame:
    """Uses with `state`, `target` (source_id, start_line, name_cf, ord) and `modules`.

    A name that the function or its module declares otherwise is no use. Unqualified, the module's own declarations go
    before all public ones; qualified by a module, its public ones count, or all where it is the own module. state:
    `found`; `unresolved` where an unusable declaration is among them; `ambiguous` where not exactly one fits, or several
    sources bear the module's name (`modules`). Uses that fit nothing are left out.
    """
    keys = ["scope", "source_id"]
    modules = sources.select("scope", F.lower(stem(F.col("source_id"))).alias("module_cf"), "source_id").distinct().groupBy("scope", "module_cf").agg(F.count("*").alias("modules"))
    known = declared.where("kind in ('constant', 'blocker')")
    public = known.where("visibility = 'public'")
    looked = F.coalesce("qualifier_cf", "name_cf")
    real = (
        used.where("kind = 'use'").withColumn("looked", looked)
        .join(used.where("kind = 'local'").select("scope", "id", F.col("name_cf").alias("looked")).distinct(), ["scope", "id", "looked"], "left_anti")
        .join(declared.where("kind = 'shadow'").select(*keys, F.col("name_cf").alias("looked")).distinct(), [*keys, "looked"], "left_anti")
    )
    own = _index(known, [*keys, "name_cf"], "own")
    own_public = _index(public, [*keys, "name_cf"], "shown")
    plain = real.where("qualifier_cf is null").join(own, [*keys, "name_cf"], "left").join(_index(public, ["scope", "name_cf"], "all"), ["scope", "name_cf"], "left")
    has_own = F.col("own_n").isNotNull()
    pick = lambda c: F.when(has_own, F.col(f"own_{c}")).otherwise(F.col(f"all_{c}"))
    count = lambda c: F.coalesce(pick(c), F.lit(0)).alias(c)
    plain = plain.select(*used.columns, count("n"), count("blocked"), pick("one").alias("one"), F.lit(1).cast("bigint").alias("named"))
    in_module = _index(public, ["scope", "module_cf", "name_cf"], "all").withColumnRenamed("module_cf", "qualifier_cf")
    dotted = (
        real.where("qualifier_cf is not null")
        .join(modules.withColumnRenamed("module_cf", "qualifier_cf").withColumnRenamed("modules", "named"), ["scope", "qualifier_cf"])
        .join(in_module, ["scope", "qualifier_cf", "name_cf"], "left").join(own, [*keys, "name_cf"], "left").join(own_public, [*keys, "name_cf"], "left")
    )
    mine = F.lower(stem(F.col("source_id"))) == F.col("qualifier_cf")
    zero = lambda c, there=None: F.coalesce(F.col(c) if there is None else F.when(there, F.col(c)), F.lit(0))
    # the module's public declarations without those of the own file, and with all of the own file where it is that module
    total = lambda c: zero(f"all_{c}") - zero(f"shown_{c}", mine) + zero(f"own_{c}", mine)
    dotted = dotted.select(*used.columns, total("n").alias("n"), total("blocked").alias("blocked"), F.when(mine & (zero("own_n") > 0), F.col("own_one")).otherwise(F.col("all_one")).alias("one"), "named")
    found = plain.unionByName(dotted).withColumn("module_cf", F.col("one.module_cf")).join(modules, ["scope", "module_cf"], "left")
    state = F.when(F.col("blocked") > 0, "unresolved").when(F.col("n") == 0, None).when((F.col("n") != 1) | (F.col("named") != 1) | (F.col("modules") != 1), "ambiguous").otherwise("found")
    twice = (F.col("n") == 1) & (F.col("named") == 1)
    return found.withColumn("state", state).where("state is not null").withColumn("module_twice", twice & (F.col("modules") != 1)).select(
        *used.columns, "state", F.col("one").alias("target"), "module_twice"
    )


def _told(rows: DataFrame, code: str, message: Column, function_id: Column | None = None) -> DataFrame:
    return rows.select(
        "scope", F.lit(code).alias("code"), F.lit("warning").alias("severity"), message.alias("message"), "source_id",
        (F.lit(None) if function_id is None else function_id).cast("string").alias("function_id"), "line",
    )


def attach_constants(sources: DataFrame, functions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(functions with `constants`, diagnostics) for VBA sources (scope, source_id, content) and their functions.

    constants is an array in the order of (source_id, start_line, name): name, module, source_id, start_line, end_line,
    visibility, type_name, expression, source. Each constant that a function uses is there once.
    """
    declared = stage(declarations(sources), "constants")
    used = stage(uses(functions), "uses")
    resolved = stage(resolve_constants(used, declared, sources), "resolved")
    full = declared.where("kind = 'constant'").select(
        "scope", F.col("source_id").alias("c_source"), F.col("ord").alias("c_ord"),
        F.struct("source_id", "start_line", "name_cf", "name", stem(F.col("source_id")).alias("module"), "end_line", "visibility", "type_name", "expression", "source").alias("c"),
    )
    hits = resolved.where("state = 'found'").select("scope", "id", F.col("target.source_id").alias("c_source"), F.col("target.ord").alias("c_ord")).distinct()
    lists = hits.join(full, ["scope", "c_source", "c_ord"]).groupBy("scope", "id").agg(F.array_sort(F.collect_list("c")).alias("cs"))  # of one function
    fields = ("name", "module", "source_id", "start_line", "end_line", "visibility", "type_name", "expression", "source")
    shown = F.transform("cs", lambda c: F.struct(*[c[f].alias(f) for f in fields]))
    kinds = "array<struct<name:string,module:string,source_id:string,start_line:int,end_line:int,visibility:string,type_name:string,expression:string,source:string>>"
    enriched = functions.join(lists, ["scope", "id"], "left").withColumn("constants", F.coalesce(shown.cast(kinds), F.array().cast(kinds))).drop("cs")
    quoted = F.concat(F.lit("'"), F.col("name"), F.lit("'"))
    bad = resolved.where("state = 'unresolved'")
    vague = resolved.where("state = 'ambiguous'")
    twice = F.concat(F.lit("More than one VBA source uses module name "), F.col("target.module_cf"), F.lit("."))
    diagnostics = (
        _told(declared.where("kind = 'problem'"), "unsupported_constant_declaration", F.col("message"))
        .unionByName(_told(duplicate_constants(declared).withColumn("line", F.col("start_line")), "duplicate_constant", F.concat(F.lit("More than one VBA Const uses "), quoted, F.lit(" in this module."))))
        .unionByName(_told(bad, "unresolved_constant", F.concat(F.lit("Unsupported declarations prevent resolving VBA constant "), quoted, F.lit(".")), F.col("id")))
        .unionByName(_told(vague, "ambiguous_constant", F.when(F.col("module_twice"), twice).otherwise(F.concat(F.lit("Cannot resolve VBA constant "), quoted, F.lit("."))), F.col("id")))
    )
    return enriched, diagnostics
