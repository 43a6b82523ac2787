"""Queries over code: syntax facts, call graph, impact, symbols, documents and forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from impactframe.functions.text import content_snapshot, file_diff
from impactframe.operators import compare as cmp
from impactframe.operators import forms, fragments, graph, impact, publish
from impactframe.operators.constants import attach_constants
from impactframe.operators.facts import EXTENSIONS, Facts, analyze, route, supports
from impactframe.operators.symbols import extract_symbols, symbol_changes
from impactframe.operators.workload import plsql_workload
from impactframe.session import cut, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _facts(spark: SparkSession, sf: str, *languages: str) -> Facts:
    """Facts of every repository, of all languages or the named ones."""
    s = table(spark, sf, "source_file")
    analyzers = {n: e for n, e in EXTENSIONS.items() if not languages or n in languages}
    return analyze(s.select("source_id", "content", "language", F.coalesce("repo", F.lit("")).alias("scope"), F.col("ingested_at").alias("ord")), analyzers)


def _snapshot(spark: SparkSession, sf: str) -> DataFrame:
    """One row per file: the earliest delivery, as in `_facts`."""
    s = table(spark, sf, "source_file").where("source_id is not null")
    scope = F.coalesce("repo", F.lit("")).alias("scope")
    return cut(s.groupBy(scope, "source_id").agg(F.min_by(F.struct("content", "language"), "ingested_at").alias("x")).select("scope", "source_id", "x.content", "x.language"))


_LINES = r"""
v AS (SELECT source_id, any_value(content) AS content FROM source_file WHERE CASE WHEN language IS NOT NULL THEN lower(language) = 'vba'
  ELSE regexp_matches(lower(source_id), '\.(bas|cls|frm)$') END GROUP BY 1),
ln AS (SELECT source_id, unnest(string_split_regex(content, '\r\n|[\n\r\v\f\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]')) AS line,
  generate_subscripts(string_split_regex(content, '\r\n|[\n\r\v\f\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]'), 1) AS no FROM v),
ev AS (SELECT *, regexp_extract(line, '(?i)^\s*(?:(?:public|private|friend|static)\s+)?(?:sub|function)\s+([a-z_]\w*)', 1) AS name,
  regexp_matches(line, '(?i)^\s*end\s+(?:sub|function)\b') AS ends FROM ln),
e2 AS (SELECT *, lag(ends) OVER w AS after_end, lag(name) OVER w AS before_name FROM ev WHERE name <> '' OR ends WINDOW w AS (PARTITION BY source_id ORDER BY no)),
opens AS (SELECT *, lead(no) OVER (PARTITION BY source_id ORDER BY no) AS next_no FROM e2 WHERE (NOT ends AND coalesce(after_end, true)) OR (ends AND NOT after_end))"""


@query(rf"""WITH {_LINES} SELECT source_id, name, no::INT AS start_line, next_no::INT AS end_line FROM opens WHERE NOT ends AND next_no IS NOT NULL""")
def txt1_vba_procedures(spark: SparkSession, sf: str) -> DataFrame:
    return _facts(spark, sf, "vba").functions.select("source_id", "name", "start_line", "end_line")


@query()
def txt4_plsql_members(spark: SparkSession, sf: str) -> DataFrame:
    f = _facts(spark, sf, "plsql").functions
    return f.select("scope", "id", "source_id", "start_line", "end_line", "visibility", "member_kind")


@query()
def txt2_calls(spark: SparkSession, sf: str) -> DataFrame:
    return _facts(spark, sf).calls.select("scope", "source_fn", "name", "line", "target_id", "evidence")


@query(rf"""WITH {_LINES}, f AS (SELECT DISTINCT s.repo AS scope, 'vba:' || regexp_extract(o.source_id, '([^/]*)\.[^./]*$', 1) || ':' || name AS id, name
  FROM opens o JOIN source_file s USING (source_id) WHERE NOT ends AND next_no IS NOT NULL)
SELECT scope, id AS function_id, 'form_event' AS kind FROM f WHERE ends_with(lower(name), '_click')""")
def txt3_form_events(spark: SparkSession, sf: str) -> DataFrame:
    e = _facts(spark, sf, "vba").entry_points.where("kind = 'form_event'")
    return e.select("scope", "function_id", "kind")


@query()
def txt11_entry_points(spark: SparkSession, sf: str) -> DataFrame:
    return _facts(spark, sf).entry_points


@query()
def pip1_diagnostics(spark: SparkSession, sf: str) -> DataFrame:
    return _facts(spark, sf).diagnostics.groupBy("scope", "code", "severity").agg(F.count("*").alias("n"))


@query()
def txt22_python_symbols(spark: SparkSession, sf: str) -> DataFrame:
    is_python = supports(F.col("language"), F.col("source_id"), "python", (".py",))
    s = table(spark, sf, "source_file").where(is_python).select(F.col("source_id").alias("path"), F.col("content").alias("text")).distinct()
    return extract_symbols(s, classes=True, nested=True).drop("content")


# graph


def _chain(spark: SparkSession, sf: str) -> DataFrame:
    """Revisions of every root as a graph: baseline -> working."""
    c = table(spark, sf, "change_set")
    node = lambda r: F.concat(F.col("root_id").cast("string"), F.lit(":"), F.col(r))
    return c.select(node("baseline_revision").alias("src"), node("working_revision").alias("dst"))


_CHAIN = """e AS (SELECT DISTINCT root_id || ':' || baseline_revision AS src, root_id || ':' || working_revision AS dst FROM change_set),
w AS (SELECT src AS root, src AS node, 0 AS depth FROM (SELECT DISTINCT src FROM e WHERE ends_with(src, ':initial'))
  UNION SELECT w.root, e.dst, w.depth + 1 FROM w JOIN e ON e.src = w.node)"""


@query(f"WITH RECURSIVE {_CHAIN} SELECT root, node, depth FROM w")
def gra5_revision_closure(spark: SparkSession, sf: str) -> DataFrame:
    edges = _chain(spark, sf)
    roots = edges.where(F.col("src").endswith(":initial")).select(F.col("src").alias("root"))
    return graph.closure(edges, roots).select("root", "node", "depth")


@query(f"WITH RECURSIVE {_CHAIN} SELECT root, node, row_number() OVER (PARTITION BY root ORDER BY depth) AS ord FROM w WHERE depth > 0")
def gra3_descendants(spark: SparkSession, sf: str) -> DataFrame:
    edges = _chain(spark, sf)
    roots = edges.where(F.col("src").endswith(":initial")).select(F.col("src").alias("root"))
    return graph.reachable(edges, roots)


_TRADE = """e AS (SELECT 'n' || c_nationkey AS src, 'c' || c_custkey AS dst FROM customer UNION SELECT 'c' || o_custkey, 'o' || o_orderkey FROM orders
UNION SELECT 'o' || l_orderkey, 's' || l_suppkey FROM lineitem)"""


def _trade(spark: SparkSession, sf: str) -> DataFrame:
    t = lambda name, a, x, b, y: table(spark, sf, name).select(F.concat(F.lit(a), x).alias("src"), F.concat(F.lit(b), y).alias("dst"))
    return t("customer", "n", "c_nationkey", "c", "c_custkey").unionByName(t("orders", "c", "o_custkey", "o", "o_orderkey")).unionByName(
        t("lineitem", "o", "l_orderkey", "s", "l_suppkey")
    )


@query(f"""WITH {_TRADE}, r AS (SELECT DISTINCT src AS root FROM e WHERE src[1] = 'n'),
d1 AS (SELECT root, dst AS node, [root, dst] AS path FROM r JOIN e ON src = root),
d2 AS (SELECT root, dst AS node, min(list_append(path, dst)) AS path FROM d1 JOIN e ON src = node GROUP BY ALL),
d3 AS (SELECT root, dst AS node, min(list_append(path, dst)) AS path FROM d2 JOIN e ON src = node GROUP BY ALL),
a AS (SELECT root, root AS node, [root] AS path, 0 AS depth FROM r UNION ALL SELECT *, 1 FROM d1 UNION ALL SELECT *, 2 FROM d2 UNION ALL SELECT *, 3 FROM d3)
SELECT root, node, array_to_string(path, '>') AS path, depth FROM a""")
def gra5_canonical_paths(spark: SparkSession, sf: str) -> DataFrame:
    edges = _trade(spark, sf)
    roots = edges.where(F.col("src").startswith("n")).select(F.col("src").alias("root"))
    return graph.closure(edges, roots).select("root", "node", F.array_join("path", ">").alias("path"), "depth")


@query(f"WITH {_TRADE} SELECT DISTINCT src AS node, dst AS other FROM e WHERE src[1] = 'c'")
def gra1_callees(spark: SparkSession, sf: str) -> DataFrame:
    edges = _trade(spark, sf)
    return graph.neighbours(edges, edges.where(F.col("src").startswith("c")).select(F.col("src").alias("node")))


@query(f"WITH {_TRADE} SELECT DISTINCT dst AS node, src AS other FROM e WHERE dst[1] = 's'")
def gra2_callers(spark: SparkSession, sf: str) -> DataFrame:
    edges = _trade(spark, sf)
    return graph.neighbours(edges, edges.where(F.col("dst").startswith("s")).select(F.col("dst").alias("node")), reverse=True)


@query("""WITH n AS (SELECT root_id, root_id || ':' || baseline_revision AS node FROM change_set UNION SELECT root_id, root_id || ':' || working_revision FROM change_set)
SELECT node, min(node) OVER (PARTITION BY root_id) AS component FROM n""")
def gra10_components(spark: SparkSession, sf: str) -> DataFrame:
    return graph.components(_chain(spark, sf).select(F.col("src").alias("a"), F.col("dst").alias("b")))


@query()
def gra6_contexts(spark: SparkSession, sf: str) -> DataFrame:
    """Bounded contexts of all entry points of every repository: at most 40 functions and 30,000 characters each."""
    f = _facts(spark, sf)
    key = lambda c: F.concat("scope", F.lit("|"), c)
    functions = f.functions.select(key("id").alias("id"), "source")
    edges = f.edges().select(key("src").alias("src"), key("dst").alias("dst"))
    calls = f.calls.select(key("source_fn").alias("source_fn"), key("target_id").alias("target_id"), "name", "line")
    told = f.diagnostics.select(key("function_id").alias("function_id"), "code")
    roots = f.entry_points.select(key("function_id").alias("root"))
    found = graph.dependency_context(functions, edges, calls, told, roots, max_depth=6, max_functions=40, max_source_chars=30_000)
    return found["paths"].select("root", "node", "depth", F.array_join("path", ">").alias("path"))


_BUDGET = f"""{_TRADE}, r AS (SELECT DISTINCT src AS root FROM e WHERE src[1] = 'n'),
d1 AS (SELECT root, dst AS node, [root, dst] AS path FROM r JOIN e ON src = root),
d2 AS (SELECT root, dst AS node, min(list_append(path, dst)) AS path FROM d1 JOIN e ON src = node GROUP BY ALL),
a AS (SELECT root, root AS node, [root] AS path, 0 AS depth FROM r UNION ALL SELECT *, 1 FROM d1 UNION ALL SELECT *, 2 FROM d2),
j AS (SELECT *, row_number() OVER w AS k, sum(length(node)) OVER (w ROWS UNBOUNDED PRECEDING) AS run FROM a WINDOW w AS (PARTITION BY root ORDER BY node)),
kept AS (SELECT * FROM j WHERE k <= 400 AND run <= 2000)"""


def _contexts(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """Contexts of all nations in the trade graph, two levels deep, cut by number and by the length of the names."""
    edges = cut(_trade(spark, sf).distinct())
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    calls = edges.select(F.col("src").alias("source_fn"), F.col("dst").alias("target_id"))
    told = nodes.where("id like 'c%'").select(F.col("id").alias("function_id"), F.lit("note").alias("code"))
    roots = edges.where(F.col("src").startswith("n")).select(F.col("src").alias("root"))
    return graph.dependency_context(nodes.withColumn("source", F.col("id")), edges, calls, told, roots, max_depth=2, max_functions=400, max_source_chars=2_000)


@query(f"WITH {_BUDGET} SELECT root, node, depth, array_to_string(path, '>') AS path FROM kept")
def gra6_budgeted(spark: SparkSession, sf: str) -> DataFrame:
    return _contexts(spark, sf)["paths"].select("root", "node", "depth", F.array_join("path", ">").alias("path"))


@query(f"WITH {_BUDGET} SELECT DISTINCT root, CASE WHEN k > 400 THEN 'max_functions' ELSE 'max_source_chars' END AS reason FROM j WHERE k > 400 OR run > 2000")
def gra11_truncation(spark: SparkSession, sf: str) -> DataFrame:
    return _contexts(spark, sf)["truncation"]


@query(f"WITH {_BUDGET} SELECT s.root, e.src AS source_fn, e.dst AS target_id FROM e JOIN kept s ON s.node = e.src JOIN kept t ON t.node = e.dst AND t.root = s.root")
def joi13_context_calls(spark: SparkSession, sf: str) -> DataFrame:
    return _contexts(spark, sf)["calls"].select("root", "source_fn", "target_id")


@query(f"WITH {_BUDGET} SELECT root, node AS function_id, 'note' AS code FROM kept WHERE node[1] = 'c'")
def joi14_context_diagnostics(spark: SparkSession, sf: str) -> DataFrame:
    return _contexts(spark, sf)["diagnostics"].select("root", "function_id", "code")


# impact


def _impact(spark: SparkSession, sf: str) -> impact.Impact:
    """First and last captured side of every changed file, all files of a root resolved together."""
    s = table(spark, sf, "content_snapshot").where("change_id is not null and root_id is not null and path is not null")
    a = F.coalesce("availability", F.lit("unreadable"))
    side = lambda name, least: (F.min_by if least else F.max_by)(
        F.when(F.col("side") == name, F.struct(a.alias("a"), "text")), F.when(F.col("side") == name, F.struct("change_id", "snapshot_id"))
    )
    both = s.groupBy("root_id", "path").agg(side("baseline", True).alias("o"), side("working", False).alias("n")).select(
        F.concat(F.col("root_id").cast("string"), F.lit("/"), "path").alias("source_id"), F.coalesce("o.a", F.lit("absent")).alias("old_availability"),
        F.coalesce("n.a", F.lit("absent")).alias("new_availability"), F.col("o.text").alias("old_text"), F.col("n.text").alias("new_text"),
    )
    both = cut(both)
    working = both.where("new_availability = 'text'").select("source_id", F.col("new_text").alias("content"), F.lit(None).cast("string").alias("language"))
    before, after, issues = cmp.overlay(working, both)
    root = lambda df: df.withColumn("scope", F.substring_index("source_id", "/", 1))
    return impact.impact_of(impact.scoped(analyze(root(before))), impact.scoped(analyze(root(after))), issues)


@query()
def pip3_function_changes(spark: SparkSession, sf: str) -> DataFrame:
    return _impact(spark, sf).function_changes.select("function_id", "change_type", "old_start_line", "new_start_line", "diff")


@query()
def pip3_evidence(spark: SparkSession, sf: str) -> DataFrame:
    e = _impact(spark, sf).evidence
    return e.withColumns({c: F.array_join(c, ">") for c in ("old_path", "new_path")})


@query()
def pip5_batches(spark: SparkSession, sf: str) -> DataFrame:
    return impact.batches(_impact(spark, sf).evidence)


@query()
def pip7_symbol_changes(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "content_snapshot").where("lower(path) like '%.py'")
    text = lambda side: F.min(F.when((F.col("side") == side) & (F.col("availability") == "text"), F.col("text")))
    both = s.groupBy("change_id").agg(F.min("path").alias("p"), text("baseline").alias("old_text"), text("working").alias("new_text"))
    named = both.select(F.concat("change_id", F.lit("/"), "p").alias("path"), "old_text", "new_text")
    return symbol_changes(named, classes=True, nested=True).select("path", "name", "status", "old_symbol_type", "new_symbol_type", "ord")


@query()
def fun3_diffs(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "content_snapshot")
    pick = lambda side, c: F.min(F.when(F.col("side") == side, F.col(c)))
    both = s.groupBy("change_id").agg(F.min("path").alias("path"), pick("baseline", "availability").alias("oa"), pick("working", "availability").alias("na"), pick("baseline", "text").alias("o"), pick("working", "text").alias("n"))
    text = F.coalesce(cmp.has_text_diff(F.col("oa"), F.col("na")), F.lit(False))
    return both.select("change_id", F.when(text, file_diff("path", "o", "n")).otherwise("").alias("diff"))


_ENDS = r"\r\n|[\n\r\v\f\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"


@query(rf"""WITH b AS (SELECT change_id, min(availability) FILTER (side = 'baseline') AS oa, min(availability) FILTER (side = 'working') AS na,
  min(text) FILTER (side = 'baseline') AS o, min(text) FILTER (side = 'working') AS n FROM content_snapshot GROUP BY 1),
c AS (SELECT change_id, coalesce(oa IN ('text', 'absent') AND na IN ('text', 'absent'), false) AS ok, coalesce(o, '') AS o, coalesce(n, '') AS n FROM b),
l AS (SELECT *, CASE WHEN o = '' THEN 0 ELSE len(string_split_regex(regexp_replace(o, '({_ENDS})$', ''), '{_ENDS}')) END AS a,
  CASE WHEN n = '' THEN 0 ELSE len(string_split_regex(regexp_replace(n, '({_ENDS})$', ''), '{_ENDS}')) END AS z FROM c)
SELECT change_id, CASE WHEN ok THEN (z - a)::INT ELSE 0 END AS net FROM l""")
def fun3_net_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Lines that each file's diff adds less those that it removes: as many as its two texts differ by."""
    lines = F.slice(F.split("diff", "\n"), 3, 1_000_000_000)  # after the two lines of the head
    starts = lambda mark: F.size(F.filter(lines, lambda x: x.startswith(mark)))
    return fun3_diffs(spark, sf).select("change_id", F.when(F.col("diff") == "", 0).otherwise(starts("+") - starts("-")).alias("net"))


# documents


_APPLIED = """WITH c AS (SELECT change_id, arg_max(struct_pack(r := root_id, p := path, s := status, h := working_sha256), landed_at) AS x FROM file_change GROUP BY 1),
o AS (SELECT x.r::VARCHAR AS d, x.p AS f, change_id AS seq, x.s = 'deleted' AS gone, x.h AS md FROM c),
l AS (SELECT d, f, max(seq) FILTER (gone) AS ld, max_by(gone, seq) AS dead, max_by(md, seq) AS md FROM o GROUP BY ALL),
a AS (SELECT o.d, o.f, min(o.seq) AS since FROM o JOIN l USING (d, f) WHERE NOT o.gone AND o.seq > coalesce(l.ld, -1) GROUP BY ALL),
b AS (SELECT d, since, '<!-- impact:fragment:start fragment_id="' || f || '" -->' || chr(10) || md || chr(10) || '<!-- impact:fragment:end fragment_id="' || f || '" -->' AS t
  FROM l JOIN a USING (d, f) WHERE NOT dead)
SELECT d AS document_key, coalesce(string_agg(t, chr(10) || chr(10) ORDER BY since) || chr(10), '') AS text FROM (SELECT DISTINCT d FROM o) LEFT JOIN b USING (d) GROUP BY d"""


def _operations(spark: SparkSession, sf: str) -> DataFrame:
    """File changes as operations: a document per root, a fragment per path."""
    latest = table(spark, sf, "file_change").groupBy("change_id").agg(F.max_by(F.struct("root_id", "path", "status", "working_sha256"), "landed_at").alias("x"))
    gone = F.col("x.status") == "deleted"
    return latest.select(
        F.col("x.root_id").cast("string").alias("document_key"), F.col("x.path").alias("fragment_id"), F.col("change_id").alias("seq"),
        F.when(gone, "delete").otherwise("upsert").alias("kind"), F.when(~gone, F.col("x.working_sha256")).alias("markdown"),
    )


@query(_APPLIED)
def frg1_apply(spark: SparkSession, sf: str) -> DataFrame:
    """Documents rendered from file changes as operations on empty documents."""
    empty = spark.createDataFrame([], "document_key string, text string")
    return fragments.apply_operations(empty, _operations(spark, sf)).select("document_key", "text")


@query(_APPLIED)
def frg1_reapply(spark: SparkSession, sf: str) -> DataFrame:
    """The same documents in two steps: the later operations of each document meet the marked text of the earlier ones."""
    ops = _operations(spark, sf)
    middle = ops.groupBy("document_key").agg(F.avg("seq").alias("middle"))
    halves = cut(ops.join(middle, "document_key"))
    empty = spark.createDataFrame([], "document_key string, text string")
    first = cut(fragments.apply_operations(empty, halves.where("seq <= middle")))
    return fragments.apply_operations(first, halves.where("seq > middle")).select("document_key", "text")


@query("""WITH k AS (SELECT DISTINCT coalesce(new_fn.source_id, old_fn.source_id) AS s, function_id, old_fn.source_id AS o, new_fn.source_id AS n FROM function_change)
SELECT 'docs/' || regexp_replace(s, '(?<=[^/.])\\.[^./]+$', '') || '.md' AS document_key, function_id,
row_number() OVER (PARTITION BY 'docs/' || regexp_replace(s, '(?<=[^/.])\\.[^./]+$', '') || '.md' ORDER BY function_id) AS ord FROM k WHERE s IS NOT NULL""".replace("(?<=[^/.])", ""))
def agg11_by_document(spark: SparkSession, sf: str) -> DataFrame:
    f = table(spark, sf, "function_change")
    changes = f.select("function_id", F.col("old_fn.source_id").alias("old_source_id"), F.col("new_fn.source_id").alias("new_source_id")).distinct()
    changes = changes.where(F.coalesce("new_source_id", "old_source_id").isNotNull())
    return publish.changes_by_document(changes).select("document_key", "function_id", "ord")


@query()
def pip9_constants(spark: SparkSession, sf: str) -> DataFrame:
    """Functions of every repository with the constants they use."""
    s = _snapshot(spark, sf)
    vba = route(s).where("analyzer = 'vba'")
    f = analyze(s).functions.where("language = 'vba'")
    enriched, _ = attach_constants(vba.select("scope", "source_id", "content"), f)
    return enriched.select("scope", "id", F.transform("constants", lambda c: F.concat_ws(".", c["module"], c["name"])).alias("constants")).where("size(constants) > 0").withColumn("constants", F.array_join("constants", ", "))


@query()
def pip9_diagnostics(spark: SparkSession, sf: str) -> DataFrame:
    s = _snapshot(spark, sf)
    f = analyze(s).functions.where("language = 'vba'")
    return attach_constants(route(s).where("analyzer = 'vba'").select("scope", "source_id", "content"), f)[1]


@query()
def pip10_workload(spark: SparkSession, sf: str) -> DataFrame:
    """Score and mode of every PL/SQL function of every repository."""
    f = _facts(spark, sf, "plsql").functions
    return plsql_workload(f).select("scope", "id", "logical_units", "physical_code_lines", "decisions", "sql_statements", "score", "mode", "error")


@query()
def srt1_calls_in_order(spark: SparkSession, sf: str) -> DataFrame:
    return _facts(spark, sf).ordered().calls.select("scope", "source_fn", "line", "name", "ord")


@query()
def pip4_entry_diagnostics(spark: SparkSession, sf: str) -> DataFrame:
    return impact.entry_contexts(_impact(spark, sf))["diagnostics"].select("root", "code", "severity", "function_id", "line")


@query()
def pip11_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that come of the function changes: a fragment for each function, on documents that are empty before."""
    changes = _impact(spark, sf).function_changes
    named = changes.withColumn("new_name", F.substring_index("function_id", ":", -1))
    ops = publish.function_fragments(publish.changes_by_document(named))
    return publish.publish(spark.createDataFrame([], "document_key string, text string"), ops)


@query(f"""WITH r AS (SELECT n_nationkey, n_name, s_suppkey, '| TextBox `t' || s_suppkey || '` | - | ControlSource=' || replace(s_name, '|', '\\|') ||
  CASE WHEN s_acctbal < 0 THEN '; Locked=non-default' ELSE '' END || ' |' AS row_ FROM nation JOIN supplier ON s_nationkey = n_nationkey)
SELECT n_name AS form, '# ' || n_name || chr(10) || chr(10) || '## Form Metadata' || chr(10) || chr(10) || '- **Caption:** ' || n_name || chr(10) || chr(10) || '## Section `Detail`' || chr(10) || chr(10) ||
'| Control | Caption | Binding / Events / Rules |' || chr(10) || '| --- | --- | --- |' || chr(10) || string_agg(row_, chr(10) ORDER BY s_suppkey) || chr(10) AS markdown FROM r GROUP BY n_name""")
def fun12_forms(spark: SparkSession, sf: str) -> DataFrame:
    """Form exports written from nations and their suppliers, rendered."""
    rows = table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    control = F.concat(
        F.lit("    Begin TextBox\n      Name =\"t"), F.col("s_suppkey").cast("string"), F.lit("\"\n      ControlSource =\""), "s_name", F.lit("\"\n"),
        F.when(F.col("s_acctbal") < 0, "      Locked =NotDefault\n").otherwise(""), F.lit("    End\n"),
    )
    texts = rows.groupBy("n_name").agg(F.array_sort(F.collect_list(F.struct("s_suppkey", control.alias("t")))).alias("cs")).select(
        F.col("n_name").alias("form"),
        F.concat(F.lit('Begin Form\n  Caption ="'), "n_name", F.lit('"\n  Begin Section\n    Name ="Detail"\n'), F.array_join(F.transform("cs", lambda c: c["t"]), ""), F.lit("  End\nEnd\nCodeBehindForm\nSub x()\nEnd Sub\n")).alias("text"),
    )
    return forms.render_forms(cut(texts)).select("form", "markdown")


@query("SELECT doc_id, CASE WHEN text IS NULL THEN 'unreadable' ELSE 'text' END AS availability, text FROM documents")
def fun2_decode(spark: SparkSession, sf: str) -> DataFrame:
    """Texts written as marked UTF-16 or as UTF-8, by their language, and decoded again."""
    d = table(spark, sf, "documents")
    data = F.when(F.col("lang") == "en", F.encode("text", "UTF-16")).otherwise(F.encode("text", "UTF-8"))
    return d.select("doc_id", content_snapshot(data).alias("c")).select("doc_id", "c.availability", "c.text")


@query(r"""SELECT DISTINCT source_id, CASE WHEN ends_with(source_id, '.frm') THEN 'b' || chr(10) ELSE ltrim(content, chr(65279)) END AS text FROM source_file WHERE content IS NOT NULL AND content <> ''""")
def txt25_analysis_text(spark: SparkSession, sf: str) -> DataFrame:
    """Files as form exports (the name decides): only what follows the marker line of a form is analysed."""
    s = table(spark, sf, "source_file").where("content is not null and content <> ''").select("source_id", "content").distinct()
    is_form = F.col("source_id").endswith(".frm")
    path = F.when(is_form, F.lit("Form_x.txt")).otherwise("x.bas")
    text = F.when(is_form, F.concat(F.lit("a\r\n  CodeBehindForm \r\nb\n"))).otherwise(F.col("content"))
    return s.select("source_id", publish.analysis_text(path, text).alias("text"))
