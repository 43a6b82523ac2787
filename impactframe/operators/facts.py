"""Code facts: functions, calls, entry points and diagnostics of a set of sources.

Text becomes rows in one pass per file; routing, deduplication, name resolution and validation are joins. Every key
holds `scope` (a snapshot side, a form, a repository), so names never resolve across scopes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from impactframe.functions.syntax import plsql_calls, plsql_file, stem_of, vba_calls, vba_procedures
from impactframe.operators.ordering import global_rank
from impactframe.session import stage

# Languages, their extensions, and the suffix of event handlers.
EXTENSIONS = {"vba": (".bas", ".cls", ".frm"), "plsql": (".sql", ".pks", ".pkb", ".pls")}

ROWS = """scope string, source_id string, kind string, language string, ord int, id string, name string, name_cf string,
module string, module_cf string, start_line int, end_line int, source string, visibility string, body boolean,
standalone boolean, member_kind string, caller_ord int, qualifier_cf string, line int, code string, message string"""


@dataclass(frozen=True)
class Plugin:
    """An analyzer of another language.

    `extract(source_id, content)` gives rows: {"kind": "function", "name", "start_line", "end_line", "source"[, "module",
    "visibility", "entry": (kind, source), "calls": [(name, line)]]} or {"kind": "diagnostic", "code", "message", "line"}. Its
    calls resolve to the only function of the name in the same language and scope.
    """

    name: str
    extensions: tuple[str, ...]
    extract: Callable[[str, str], Iterator[dict]]

    def rows(self, source_id: str, content: str) -> Iterator[dict]:
        no = 0
        for found in self.extract(source_id, content):
            if found["kind"] != "function":
                yield found
                continue
            module = found.get("module") or stem_of(source_id)
            key = f"{self.name}:{module}:{found['name']}"
            calls, entry = found.pop("calls", ()), found.pop("entry", None)
            own = {"module": module, "module_cf": module.casefold(), "id": key, "visibility": "public", "name_cf": found["name"].casefold(), "ord": no}
            yield own | found | {"member_kind": "entry\x1f" + "\x1f".join(entry) if entry else None}
            for k, (name, line) in enumerate(calls):
                yield {"kind": "call", "ord": k, "caller_ord": no, "id": key, "name": name, "line": line, "name_cf": name.casefold(), "module_cf": module.casefold()}
            no += 1


@dataclass(frozen=True)
class Facts:
    """The facts of one analysis; `functions` holds one row per (scope, id)."""

    functions: DataFrame
    calls: DataFrame
    entry_points: DataFrame
    diagnostics: DataFrame

    def ordered(self) -> Facts:
        """The same facts with `ord`: functions by id, calls by place, entry points by function, diagnostics by place."""
        none = lambda c: F.coalesce(c, F.lit(""))
        return Facts(
            global_rank(self.functions, F.struct("scope", "id")),
            global_rank(self.calls, F.struct("scope", "source_id", "line", F.lower("name").alias("n"), none("target_id").alias("t"))),
            global_rank(self.entry_points, F.struct("scope", "function_id", "kind", "source")),
            global_rank(self.diagnostics, F.struct("scope", none("source_id").alias("s"), F.coalesce("line", F.lit(0)).alias("l"), "code", none("function_id").alias("f"))),
        )

    def edges(self) -> DataFrame:
        """Distinct resolved edges between known functions (scope, src, dst); a function may call itself."""
        return call_edges(self.calls, self.functions)


def supports(language: Column, source_id: Column, name: str, extensions: tuple[str, ...]) -> Column:
    """A hint decides alone, in any letter case; without one the extension does."""
    ext = F.lower(F.regexp_extract(source_id, r"[^/.][^/]*?(\.[^./]+)$", 1))
    return F.when(language.isNotNull(), F.lower(language) == name).otherwise(ext.isin(*extensions))


def first_wins(df: DataFrame, keys: list[str], order: list[str]) -> tuple[DataFrame, DataFrame]:
    """(the first row of every key, all later rows) in the given order; ties in the order are broken arbitrarily."""
    w = Window.partitionBy(*keys).orderBy(*order)
    ranked = df.withColumn("_rank", F.row_number().over(w))
    return ranked.where("_rank = 1").drop("_rank"), ranked.where("_rank > 1").drop("_rank")


def route(sources: DataFrame, analyzers: dict[str, tuple[str, ...]] = EXTENSIONS) -> DataFrame:
    """Adds `analyzer` (null unless exactly one supports the file) and `supporting`, the number of those that do."""
    flags = [supports(F.col("language"), F.col("source_id"), n, e).cast("int") for n, e in analyzers.items()]
    count = sum(flags[1:], flags[0])
    name = F.coalesce(*[F.when(f == 1, n) for f, n in zip(flags, analyzers)])
    return sources.withColumn("supporting", F.coalesce(count, F.lit(0))).withColumn(
        "analyzer", F.when(F.col("supporting") == 1, name)
    )


def _rows(frames: Iterator[pd.DataFrame], plugins: dict[str, Plugin]) -> Iterator[pd.DataFrame]:
    names = [c.split()[0] for c in ROWS.replace("\n", " ").split(", ")]
    blank = dict.fromkeys(names)  # explicit nulls: a column that a batch leaves out would turn into floats
    for frame in frames:
        out: list[dict] = []
        for scope, source_id, language, content in zip(frame.scope, frame.source_id, frame.analyzer, frame.content):
            found = plugins[language].rows(source_id, content or "") if language in plugins else _file_rows(source_id, language, content or "")
            for row in found:
                out.append(blank | {"scope": scope, "source_id": source_id, "language": language, **row})
        yield pd.DataFrame(out, columns=names)


def _file_rows(source_id: str, language: str, content: str) -> Iterator[dict]:
    stem = stem_of(source_id)
    if language == "vba":
        found, left_open = vba_procedures(content)
        for f in found:
            f |= {"module": stem, "id": f"vba:{stem}:{f['name']}"}
        if left_open is not None:
            message = "VBA procedure has no matching End Sub or End Function."
            yield {"kind": "diagnostic", "code": "unterminated_procedure", "message": message, "line": left_open}
        scan = vba_calls
    else:
        parsed = plsql_file(content, stem)
        found = parsed["functions"]
        for f in found:
            place = "" if f["body"] else "standalone:"
            f |= {"id": f"plsql:{place}{f['module']}:{f['name']}", "standalone": not f["body"], "member_kind": f.pop("kind")}
        for code, message, line in parsed["diagnostics"]:
            yield {"kind": "diagnostic", "code": code, "message": message, "line": line}
        for package, name, line in parsed["declarations"]:
            yield {"kind": "declaration", "module_cf": package.casefold(), "name_cf": name.casefold(), "line": line}
        scan = plsql_calls
    for no, f in enumerate(found):
        yield {"kind": "function", "ord": no, "name_cf": f["name"].casefold(), "module_cf": f["module"].casefold(), **f}
        for k, (name, line, qualifier) in enumerate(scan(f["source"], f["start_line"])):
            yield {
                "kind": "call", "ord": k, "caller_ord": no, "id": f["id"], "name": name, "line": line,
                "name_cf": name.rsplit(".", 1)[-1].casefold() if language == "plsql" else name.casefold(),
                "module_cf": f["module"].casefold(), "qualifier_cf": qualifier.casefold() if qualifier else None,
            }


def syntax_rows(sources: DataFrame, plugins: Sequence[Plugin] = ()) -> DataFrame:
    """Functions, raw calls, declarations and diagnostics of routed sources, one row each."""
    named = {p.name: p for p in plugins}
    routed = sources.where(F.col("analyzer").isNotNull()).select("scope", "source_id", "analyzer", "content")
    return routed.mapInPandas(lambda frames: _rows(frames, named), ROWS)


def symbol_index(symbols: DataFrame) -> DataFrame:
    """(scope, name_cf, named, only): how many symbols bear a name, and the least of them."""
    return symbols.groupBy("scope", "name_cf").agg(F.count("*").alias("named"), F.min("id").alias("only"))


def resolve_unique(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """Adds target_id where exactly one symbol of the call's scope has its name, and `named`, how many have."""
    joined = calls.join(symbol_index(symbols), ["scope", "name_cf"], "left").withColumn("named", F.coalesce("named", F.lit(0)))
    return joined.withColumn("target_id", F.when(F.col("named") == 1, F.col("only"))).drop("only")


def resolve_scoped(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """Adds target_id by the rules of packages: a qualifier must be the module; without one the own module goes first.

    Only a unique candidate resolves. `named` counts the symbols that bear the call's name as it is written, so a
    qualified name counts none.
    """
    by_module = symbols.groupBy("scope", "module_cf", "name_cf").agg(F.count("*").alias("near"), F.min("id").alias("near_id"))
    anywhere = symbols.groupBy("scope", "name_cf").agg(F.count("*").alias("far"), F.min("id").alias("far_id"))
    looked = F.coalesce("qualifier_cf", "module_cf")
    out = (
        calls.withColumn("own_cf", F.col("module_cf")).withColumn("module_cf", looked)
        .join(by_module, ["scope", "module_cf", "name_cf"], "left")
        .join(anywhere, ["scope", "name_cf"], "left")
    )
    near, far = F.coalesce("near", F.lit(0)), F.coalesce("far", F.lit(0))
    qualified = F.col("qualifier_cf").isNotNull()
    target = F.when(near == 1, F.col("near_id")).when(~qualified & (near == 0) & (far == 1), F.col("far_id"))
    return (
        out.withColumn("target_id", target).withColumn("named", F.when(qualified, F.lit(0)).otherwise(far))
        .withColumn("module_cf", F.col("own_cf")).drop("own_cf", "near", "near_id", "far", "far_id")
    )


def validate_calls(calls: DataFrame, functions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(calls of known functions, calls of unknown ones, known calls whose target is unknown), by (scope, id)."""
    ids = functions.select("scope", "id").distinct()
    source = ids.withColumnRenamed("id", "source_fn")
    kept = calls.join(source, ["scope", "source_fn"], "left_semi")
    lost = calls.join(source, ["scope", "source_fn"], "left_anti")
    dangling = kept.where(F.col("target_id").isNotNull()).join(ids.withColumnRenamed("id", "target_id"), ["scope", "target_id"], "left_anti")
    return kept, lost, dangling


def validate_entries(entries: DataFrame, functions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(distinct entry points of known functions, entry points of unknown ones)."""
    ids = functions.select("scope", F.col("id").alias("function_id")).distinct()
    keys = ["scope", "function_id"]
    return entries.join(ids, keys, "left_semi").distinct(), entries.join(ids, keys, "left_anti")


def entry_kinds(entries: DataFrame) -> DataFrame:
    """(scope, function_id, first, last): the least and the greatest (kind, source) of each function's entry points."""
    pair = F.struct("kind", "source")
    return entries.groupBy("scope", "function_id").agg(F.min(pair).alias("first"), F.max(pair).alias("last"))


def missing_members(declared: DataFrame, functions: DataFrame) -> DataFrame:
    """Declared package members without an implementation in a body."""
    done = functions.where("body").select("scope", "module_cf", "name_cf").distinct()
    return declared.join(done, ["scope", "module_cf", "name_cf"], "left_anti")


def call_edges(calls: DataFrame, functions: DataFrame) -> DataFrame:
    ids = functions.select("scope", "id").distinct()
    edges = calls.where(F.col("target_id").isNotNull()).select("scope", F.col("source_fn").alias("src"), F.col("target_id").alias("dst"))
    return (
        edges.distinct().join(ids.withColumnRenamed("id", "src"), ["scope", "src"], "left_semi")
        .join(ids.withColumnRenamed("id", "dst"), ["scope", "dst"], "left_semi").select("scope", "src", "dst")
    )


def _diagnostics(rows: DataFrame, code: str | None, severity: str, message: Column | None = None, **columns: Column) -> DataFrame:
    pick = lambda name, kind: columns.get(name, F.lit(None)).cast(kind).alias(name)
    return rows.select(
        "scope", (F.lit(code) if code else F.col("code")).alias("code"), F.lit(severity).alias("severity"),
        (F.col("message") if message is None else message).alias("message"), pick("source_id", "string"),
        pick("function_id", "string"), pick("line", "int"),
    )


def quoted(value: Column) -> Column:
    return F.concat(F.lit("'"), value, F.lit("'"))


def analyze(sources: DataFrame, analyzers: dict[str, tuple[str, ...]] = EXTENSIONS, plugins: Sequence[Plugin] = ()) -> Facts:
    """Facts of (source_id, content, language[, scope][, ord]).

    Of several rows with one source_id the first by `ord` (else the smallest content) counts; the rest give diagnostics.
    Null contents count as empty files, rows without source_id are left out, other columns are ignored. plugins analyze
    further languages.
    """
    analyzers = analyzers | {p.name: p.extensions for p in plugins}
    if "scope" not in sources.columns:
        sources = sources.withColumn("scope", F.lit(""))
    order = "ord" if "ord" in sources.columns else "content"
    sources = sources.where(F.col("source_id").isNotNull()).select("scope", "source_id", "content", "language", F.col(order).alias("_o"))
    # as many partitions as the cluster shuffles into, never merged: what follows parses every row
    parts = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sources = sources.repartition(parts, "scope", "source_id")
    kept, again = first_wins(sources, ["scope", "source_id"], ["_o"])
    routed = route(kept, analyzers)
    rows = stage(syntax_rows(routed, plugins), "facts")  # every later step reads its own kind and columns
    found = rows.where("kind = 'function'")
    declared = (
        rows.where("kind = 'declaration'").groupBy("scope", "module_cf", "name_cf")
        .agg(F.max(F.struct("source_id", "line")).alias("d")).select("scope", "module_cf", "name_cf", "d.source_id", "d.line")
    )
    public = declared.select("scope", "module_cf", "name_cf", F.lit(True).alias("declared"))
    joined = found.join(public, ["scope", "module_cf", "name_cf"], "left")
    seen = F.when(F.col("language") != "plsql", F.col("visibility")).when(F.col("standalone"), "public")
    seen = F.coalesce(seen, F.when(F.col("declared"), "public").otherwise("private"))
    all_functions = joined.withColumn("visibility", seen).select(
        "scope", "id", "name", "name_cf", "language", "module", "module_cf", "source_id", "source", "start_line", "end_line",
        "visibility", "body", "standalone", "member_kind", "ord",
    )
    functions, doubles = first_wins(all_functions, ["scope", "id"], ["source_id", "ord"])
    raw = rows.where("kind = 'call'").select(
        "scope", "source_id", "language", F.col("id").alias("source_fn"), "name", "name_cf", "module_cf", "qualifier_cf", "line"
    )
    symbols = all_functions.select("scope", "language", "id", "name_cf", "module_cf")
    of = lambda df, name: df.where(F.col("language") == name)
    calls = resolve_scoped(of(raw, "plsql"), of(symbols, "plsql"))
    for name in ("vba", *(p.name for p in plugins)):
        calls = calls.unionByName(resolve_unique(of(raw, name), of(symbols, name)))
    evidence = F.when(F.col("target_id").isNotNull(), F.concat("language", F.lit("_name_resolution")))
    calls = calls.withColumn("evidence", evidence)
    kept_calls, lost, dangling = validate_calls(calls, functions)
    told = F.split("member_kind", "\x1f")
    entry = (
        F.when(told[0] == "entry", F.struct(F.get(told, F.lit(1)).alias("kind"), F.get(told, F.lit(2)).alias("source")))
        .when((F.col("language") == "vba") & F.col("name_cf").endswith("_click"), F.struct(F.lit("form_event").alias("kind"), F.lit("analyzer").alias("source")))
        .when(F.col("body") & (F.col("visibility") == "public"), F.struct(F.lit("package_public_member").alias("kind"), F.lit("package_spec").alias("source")))
        .when(F.col("standalone"), F.struct(F.concat(F.lit("standalone_"), "member_kind").alias("kind"), F.lit("declaration").alias("source")))
    )
    entries = all_functions.withColumn("e", entry).where("e is not null").select("scope", F.col("id").alias("function_id"), "e.kind", "e.source")
    entries, homeless = validate_entries(entries, functions)
    upper = F.upper("language")
    reason = F.when(F.col("named") == 0, F.concat(F.lit("no indexed "), upper, F.lit(" procedure has that name"))).otherwise(
        F.concat(F.lit("more than one indexed "), upper, F.lit(" procedure has that name"))
    )
    cannot = F.concat(F.lit("Cannot resolve "), upper, F.lit(" call "), quoted(F.col("name")), F.lit(": "), reason, F.lit("."))
    missing = F.concat(
        F.lit("Public PL/SQL package member "), "module_cf", F.lit("."), "name_cf", F.lit(" has no implementation in the analyzed package bodies.")
    )
    sid, line = F.col("source_id"), F.col("line")
    parts = [
        _diagnostics(again, "duplicate_source_id", "error", F.concat(F.lit("More than one input source uses "), quoted(sid), F.lit(".")), source_id=sid),
        _diagnostics(routed.where("supporting = 0"), "unsupported_file", "error", F.concat(F.lit("No analyzer supports "), quoted(sid), F.lit(".")), source_id=sid),
        _diagnostics(routed.where("supporting > 1"), "ambiguous_analyzer", "error", F.concat(F.lit("More than one analyzer supports "), quoted(sid), F.lit(".")), source_id=sid),
        _diagnostics(rows.where("kind = 'diagnostic'"), None, "error", source_id=sid, line=line),
        _diagnostics(doubles, "duplicate_function_id", "error", F.concat(F.lit("More than one function uses "), quoted(F.col("id")), F.lit(".")), source_id=sid, function_id=F.col("id"), line=F.col("start_line")),
        _diagnostics(calls.where("target_id is null"), "unresolved_call", "warning", cannot, source_id=sid, function_id=F.col("source_fn"), line=line),
        _diagnostics(lost, "unknown_call_source", "error", F.concat(F.lit("Call "), quoted(F.col("name")), F.lit(" has no indexed source function.")), function_id=F.col("source_fn"), line=line),
        _diagnostics(dangling, "missing_call_target", "warning", F.concat(F.lit("Call "), quoted(F.col("name")), F.lit(" targets "), quoted(F.col("target_id")), F.lit(", which is not in this codebase.")), function_id=F.col("source_fn"), line=line),
        _diagnostics(homeless, "missing_entry_point", "error", F.concat(F.lit("Entry point "), quoted(F.col("function_id")), F.lit(" is not an indexed function.")), function_id=F.col("function_id")),
        _diagnostics(missing_members(declared, all_functions), "missing_package_member_implementation", "warning", missing, source_id=sid, line=line),
    ]
    diagnostics = parts[0]
    for part in parts[1:]:
        diagnostics = diagnostics.unionByName(part)
    return Facts(functions.drop("ord"), kept_calls, entries, diagnostics)


# lookups over facts


def find_sources(sources: DataFrame, prefix: str | None = None, language: str | None = None, extension: str | None = None) -> DataFrame:
    """Sources by all given predicates; without a hint the text after the last dot stands for the language."""
    out = sources
    if prefix is not None:
        out = out.where(F.col("source_id").startswith(prefix))
    if language is not None:
        tail = F.element_at(F.split("source_id", r"\."), -1)
        out = out.where(F.lower(F.coalesce("language", tail)) == language.casefold())
    if extension is not None:
        wanted = "." + extension.casefold().lstrip(".")
        out = out.where(F.lower(F.regexp_extract("source_id", r"[^/.][^/]*?(\.[^./]+)$", 1)) == wanted)
    return out


def find_functions(functions: DataFrame, language: str | None = None, qualified_name: str | None = None, **equal: str) -> DataFrame:
    """Functions by exact column values; the language compares in any letter case, qualified_name is module.name."""
    out = functions
    for name, value in equal.items():
        out = out.where(F.col(name).eqNullSafe(F.lit(value)))
    if language is not None:
        out = out.where(F.lower("language") == language.casefold())
    if qualified_name is not None:
        out = out.where(F.concat_ws(".", "module", "name") == qualified_name)
    return out


def need(rows: DataFrame, **key: str) -> DataFrame:
    """The rows of a key; KeyError where there is none."""
    found = find_functions(rows, **key)
    if found.isEmpty():
        raise KeyError(", ".join(f"{k}={v!r}" for k, v in key.items()))
    return found


def calls_to(calls: DataFrame, function_id: str) -> DataFrame:
    """Resolved calls of the function."""
    return calls.where(F.col("target_id") == function_id)


def functions_at(functions: DataFrame, places: DataFrame) -> DataFrame:
    """Functions that hold each (source_id, line) of places: an equi-join on the file with a range condition."""
    return functions.join(places, "source_id").where(F.col("line").between(F.col("start_line"), F.col("end_line")))


def calls_of(calls: DataFrame, resolution: str = "all") -> DataFrame:
    """Calls with a target, without one, or all."""
    if resolution not in ("all", "resolved", "unresolved"):
        raise ValueError(f"resolution must be all, resolved or unresolved, not {resolution!r}")
    if resolution == "all":
        return calls
    has = F.col("target_id").isNotNull()
    return calls.where(has if resolution == "resolved" else ~has)
