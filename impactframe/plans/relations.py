"""Queries of the relational operators over the test tables, each beside the SQL that states it.

The tables stand in for the relations of the operators: file_state for scans, customers, parts and orders for symbols and
calls, events for operation logs. Every query runs over whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from impactframe.functions.text import document_key, escape_cell, matches_patterns, stem, suffix, under
from impactframe.operators import compare as cmp
from impactframe.operators import facts
from impactframe.operators.forms import resolve_by_form
from impactframe.operators.fragments import fold_operations, operation_error
from impactframe.operators.graph import within_budget
from impactframe.operators.constants import duplicate_constants, resolve_constants
from impactframe.operators.impact import affected_entries, find_evidence, resolved_edges, unassigned
from impactframe.operators.ordering import global_rank
from impactframe.operators.tracker import new_objects, read_objects
from impactframe.operators.workbench import corrupt, key_errors, with_integrity
from impactframe.operators.workload import assess, metrics
from impactframe.session import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _sources(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "source_file").select("source_id", "content", "language").distinct()


# filters and lookups


@query("SELECT DISTINCT source_id FROM source_file WHERE starts_with(source_id, 'depot') AND lower(coalesce(language, split_part(source_id, '.', -1))) = 'py'")
def fil1_find_sources(spark: SparkSession, sf: str) -> DataFrame:
    return facts.find_sources(_sources(spark, sf), prefix="depot", language="PY").select("source_id").distinct()


@query("SELECT DISTINCT source_id FROM source_file WHERE lower(regexp_extract(source_id, '[^/.][^/]*?(\\.[^./]+)$', 1)) = '.pkb'")
def fil1_by_extension(spark: SparkSession, sf: str) -> DataFrame:
    return facts.find_sources(_sources(spark, sf), extension="PKB").select("source_id").distinct()


def _customers(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as functions: modules are nations, ten lines each."""
    c = table(spark, sf, "customer")
    start = (F.floor(F.col("c_custkey") / 25) * 10 + 1).cast("int")
    return c.select(
        F.lit("").alias("scope"), F.concat(F.lit("fn:"), "c_custkey").alias("id"), F.col("c_name").alias("name"), F.lower("c_name").alias("name_cf"),
        F.concat(F.lit("m"), (F.col("c_custkey") % 25)).alias("module"), F.concat(F.lit("m"), (F.col("c_custkey") % 25)).alias("module_cf"),
        F.lit("VBA").alias("language"), F.concat(F.lit("f"), (F.col("c_custkey") % 25)).alias("source_id"), start.alias("start_line"), (start + 9).cast("int").alias("end_line"),
        F.col("c_mktsegment").alias("visibility"), F.concat("c_name", F.col("c_mktsegment")).alias("source"),
    )


@query("SELECT 'fn:' || c_custkey AS id FROM customer WHERE c_mktsegment = 'BUILDING' AND 'm' || (c_custkey % 25) = 'm3'")
def fil2_find_functions(spark: SparkSession, sf: str) -> DataFrame:
    return facts.find_functions(_customers(spark, sf), language="vba", visibility="BUILDING", module="m3").select("id")


@query("""SELECT 'f' || (c_custkey % 25) AS source_id, l.n AS line, 'fn:' || c_custkey AS id FROM customer
JOIN (SELECT DISTINCT 'f' || (p_partkey % 25) AS f, (p_size * 7)::INT AS n FROM part) l
  ON l.f = 'f' || (c_custkey % 25) AND l.n BETWEEN (c_custkey // 25) * 10 + 1 AND (c_custkey // 25) * 10 + 10""")
def fil3_functions_at(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    places = p.select(F.concat(F.lit("f"), (F.col("p_partkey") % 25)).alias("source_id"), (F.col("p_size") * 7).cast("int").alias("line")).distinct()
    return facts.functions_at(_customers(spark, sf), places).select("source_id", "line", "id")


@query("SELECT status, count(*) AS n FROM file_change GROUP BY ALL")
def fil9_status_counts(spark: SparkSession, sf: str) -> DataFrame:
    return cmp.status_counts(table(spark, sf, "file_change").select("status"))


@query("""SELECT path FROM (SELECT DISTINCT path FROM file_change)
WHERE (path LIKE 'src/%.pkb' OR path LIKE '%/billing/%') AND NOT regexp_matches(path, '^(.*/)?[^/]*_9[^/]*$')""")
def fil11_patterns(spark: SparkSession, sf: str) -> DataFrame:
    paths = table(spark, sf, "file_change").select("path").distinct()
    names = F.col("path").rlike("^(.*/)?[^/]*_9[^/]*$")
    return paths.where(matches_patterns(F.col("path"), ["src/*.pkb", "*/billing/*"], []) & ~names)


@query("SELECT DISTINCT path FROM file_change WHERE path = 'lib/fleet' OR starts_with(path, 'lib/fleet/')")
def fil12_under(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "file_change").where(under(F.col("path"), "lib/fleet")).select("path").distinct()


@query("""SELECT source_id, CASE WHEN language IS NOT NULL THEN lower(language) = 'vba'
ELSE regexp_matches(lower(source_id), '\\.(bas|cls|frm)$') END AS ok FROM (SELECT DISTINCT source_id, language FROM source_file)""")
def fil13_supports(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "source_file").select("source_id", "language").distinct()
    return s.select("source_id", facts.supports(F.col("language"), F.col("source_id"), "vba", facts.EXTENSIONS["vba"]).alias("ok"))


@query("""SELECT change_id, status, baseline_sha256 IS NOT NULL AND working_sha256 IS NOT NULL AS both_sides
FROM (SELECT DISTINCT change_id, status, baseline_sha256, working_sha256 FROM file_change) WHERE status = 'modified'""")
def fil9_modified(spark: SparkSession, sf: str) -> DataFrame:
    f = table(spark, sf, "file_change").select("change_id", "status", "baseline_sha256", "working_sha256").distinct()
    both = F.col("baseline_sha256").isNotNull() & F.col("working_sha256").isNotNull()
    return cmp.by_status(f, "modified").select("change_id", "status", both.alias("both_sides"))


@query("""SELECT DISTINCT change_id FROM content_snapshot GROUP BY change_id
HAVING bool_and(coalesce(availability IN ('text', 'absent'), false))""")
def fil18_text_diff(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "content_snapshot")
    ok = F.coalesce(cmp.has_text_diff(F.col("availability"), F.col("availability")), F.lit(False))
    return s.groupBy("change_id").agg(F.every(ok).alias("ok")).where("ok").select("change_id")


# joins

_STATES = """
s AS (SELECT root_id, path, sha256, snapshot_no FROM (
  SELECT *, row_number() OVER (PARTITION BY root_id, snapshot_no, path ORDER BY delivered_at DESC, sha256 DESC NULLS LAST) AS k FROM file_state)
  WHERE k = 1 AND file_exists)"""


@query("""WITH f AS (SELECT * FROM file_state WHERE root_id IS NOT NULL AND snapshot_no IS NOT NULL AND path IS NOT NULL),
s AS (SELECT root_id, path, sha256, snapshot_no FROM (
  SELECT *, row_number() OVER (PARTITION BY root_id, snapshot_no, path
  ORDER BY delivered_at DESC NULLS LAST, sha256 DESC NULLS LAST, file_exists DESC NULLS LAST) AS k FROM f) WHERE k = 1 AND file_exists),
l AS (SELECT root_id, snapshot_no, lag(snapshot_no) OVER w AS previous_no, lead(snapshot_no) OVER w AS next_no
  FROM (SELECT DISTINCT root_id, snapshot_no FROM f) WINDOW w AS (PARTITION BY root_id ORDER BY snapshot_no)),
a AS (SELECT root_id, next_no AS snapshot_no, path, sha256 FROM s JOIN l USING (root_id, snapshot_no) WHERE next_no IS NOT NULL),
b AS (SELECT root_id, snapshot_no, path, sha256 FROM s JOIN l USING (root_id, snapshot_no) WHERE previous_no IS NOT NULL)
SELECT coalesce(a.root_id, b.root_id) AS root_id, coalesce(a.snapshot_no, b.snapshot_no) AS snapshot_no, coalesce(a.path, b.path) AS path,
CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'deleted' ELSE 'modified' END AS status
FROM a FULL JOIN b ON a.root_id = b.root_id AND a.snapshot_no = b.snapshot_no AND a.path = b.path
WHERE a.path IS NULL OR b.path IS NULL OR a.sha256 IS DISTINCT FROM b.sha256""")
def joi1_compare_snapshots(spark: SparkSession, sf: str) -> DataFrame:
    """Every delivered snapshot of every root beside the one delivered before it; numbers may skip."""
    rows = table(spark, sf, "file_state").where("root_id IS NOT NULL AND snapshot_no IS NOT NULL AND path IS NOT NULL")
    by_no = Window.partitionBy("root_id").orderBy("snapshot_no")
    listed = rows.select("root_id", "snapshot_no").distinct().select(
        "root_id", "snapshot_no", F.lag("snapshot_no").over(by_no).alias("previous_no"), F.lead("snapshot_no").over(by_no).alias("next_no")
    )
    last = rows.groupBy("root_id", "snapshot_no", "path").agg(F.max(F.struct("delivered_at", "sha256", "file_exists")).alias("s"))
    states = last.where("s.file_exists").select("root_id", "snapshot_no", "path", "s.sha256").join(listed, ["root_id", "snapshot_no"])
    old = states.where("next_no IS NOT NULL").select("root_id", F.col("next_no").alias("snapshot_no"), "path", "sha256")
    new = states.where("previous_no IS NOT NULL").select("root_id", "snapshot_no", "path", "sha256")
    keys = ["root_id", "snapshot_no", "path"]
    return cmp.compare(old, new, keys, "sha256").select(*keys, "status")


def _part_calls(spark: SparkSession, sf: str) -> DataFrame:
    """Parts by name as calls: names are few, so most are ambiguous among parts and none among customers."""
    p = table(spark, sf, "part")
    return p.select(F.lit("").alias("scope"), F.col("p_partkey").alias("call"), F.lower("p_name").alias("name_cf"), F.lit(None).cast("string").alias("qualifier_cf"), F.concat(F.lit("b"), F.lower("p_brand")).alias("module_cf"))


def _part_symbols(spark: SparkSession, sf: str, keep: str = "true") -> DataFrame:
    p = table(spark, sf, "part").where(keep)
    return p.select(F.lit("").alias("scope"), F.concat(F.lit("p"), "p_partkey").alias("id"), F.lower("p_name").alias("name_cf"), F.concat(F.lit("b"), F.lower("p_brand")).alias("module_cf"))


@query("""WITH i AS (SELECT lower(p_name) AS n, count(*) AS c, min('p' || p_partkey) AS id FROM part WHERE p_size < 3 GROUP BY 1)
SELECT p_partkey AS call, CASE WHEN c = 1 THEN id END AS target_id, coalesce(c, 0) AS named FROM part LEFT JOIN i ON n = lower(p_name)""")
def joi4_resolve_unique(spark: SparkSession, sf: str) -> DataFrame:
    return facts.resolve_unique(_part_calls(spark, sf), _part_symbols(spark, sf, "p_size < 3")).select("call", "target_id", "named")


@query("""WITH s AS (SELECT 'p' || p_partkey AS id, lower(p_name) AS n, lower(p_brand) AS m FROM part WHERE p_size < 20),
near AS (SELECT n, m, count(*) AS c, min(id) AS id FROM s GROUP BY ALL), far AS (SELECT n, count(*) AS c, min(id) AS id FROM s GROUP BY ALL)
SELECT p_partkey AS call, CASE WHEN near.c = 1 THEN near.id WHEN near.c IS NULL AND far.c = 1 THEN far.id END AS target_id
FROM part LEFT JOIN near ON near.n = lower(p_name) AND near.m = lower(p_brand) LEFT JOIN far ON far.n = lower(p_name)""")
def joi5_resolve_scoped(spark: SparkSession, sf: str) -> DataFrame:
    return facts.resolve_scoped(_part_calls(spark, sf), _part_symbols(spark, sf, "p_size < 20")).select("call", "target_id")


def _line_calls(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Line items as calls from suppliers to parts; only suppliers above a balance and parts up to a size are known functions."""
    li = table(spark, sf, "lineitem")
    calls = li.select(F.lit("").alias("scope"), F.concat(F.lit("s"), "l_suppkey").alias("source_fn"), F.concat(F.lit("p"), "l_partkey").alias("target_id"), "l_orderkey", "l_linenumber")
    known = table(spark, sf, "supplier").where("s_acctbal > 2000").select(F.lit("").alias("scope"), F.concat(F.lit("s"), "s_suppkey").alias("id"))
    parts = table(spark, sf, "part").where("p_size <= 38").select(F.lit("").alias("scope"), F.concat(F.lit("p"), "p_partkey").alias("id"))
    return calls, known.unionByName(parts)


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 2000)")
def joi7_unknown_sources(spark: SparkSession, sf: str) -> DataFrame:
    return facts.validate_calls(*_line_calls(spark, sf))[1].select("l_orderkey", "l_linenumber")


@query("""SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 2000)
AND l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size <= 38)""")
def joi8_missing_targets(spark: SparkSession, sf: str) -> DataFrame:
    return facts.validate_calls(*_line_calls(spark, sf))[2].select("l_orderkey", "l_linenumber")


@query("""SELECT DISTINCT o_custkey AS function_id, o_orderpriority AS kind FROM orders
WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)""")
def joi9_entry_points(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "orders").select(F.lit("").alias("scope"), F.col("o_custkey").alias("function_id"), F.col("o_orderpriority").alias("kind"))
    known = table(spark, sf, "customer").where("c_acctbal > 0").select(F.lit("").alias("scope"), F.col("c_custkey").alias("id"))
    return facts.validate_entries(e, known)[0].select("function_id", "kind")


@query("""SELECT DISTINCT lower(p_brand) AS module_cf, lower(p_name) AS name_cf FROM part d WHERE NOT EXISTS (
SELECT 1 FROM part b WHERE b.p_size > 25 AND lower(b.p_brand) = lower(d.p_brand) AND lower(b.p_name) = lower(d.p_name))""")
def joi10_missing_members(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").select(F.lit("").alias("scope"), F.lower("p_brand").alias("module_cf"), F.lower("p_name").alias("name_cf"), (F.col("p_size") > 25).alias("body"))
    return facts.missing_members(p.select("scope", "module_cf", "name_cf").distinct(), p).select("module_cf", "name_cf")


@query("""WITH s AS (SELECT DISTINCT source_id, language FROM source_file), f AS (SELECT source_id,
CASE WHEN language IS NOT NULL THEN lower(language) = 'vba' ELSE regexp_matches(lower(source_id), '\\.(bas|cls|frm)$') END::INT AS v,
CASE WHEN language IS NOT NULL THEN lower(language) = 'plsql' ELSE regexp_matches(lower(source_id), '\\.(sql|pks|pkb|pls)$') END::INT AS p FROM s)
SELECT source_id, v + p AS supporting, CASE WHEN v + p = 1 THEN CASE WHEN v = 1 THEN 'vba' ELSE 'plsql' END END AS analyzer FROM f""")
def joi11_route(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "source_file").select("source_id", "language").distinct()
    return facts.route(s).select("source_id", "supporting", "analyzer")


_SNAP = """
c AS (SELECT change_id, min(CASE WHEN side = 'baseline' THEN coalesce(availability, 'unreadable') END) AS oa,
  min(CASE WHEN side = 'working' THEN coalesce(availability, 'unreadable') END) AS na,
  min(CASE WHEN side = 'baseline' THEN text END) AS ot, min(CASE WHEN side = 'working' THEN text END) AS nt
  FROM content_snapshot GROUP BY 1 HAVING oa IS NOT NULL AND na IS NOT NULL),
w AS (SELECT DISTINCT change_id, path FROM (SELECT change_id, min(path) AS path FROM file_change GROUP BY 1))"""


def _overlay(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    s = table(spark, sf, "content_snapshot").withColumn("a", F.coalesce("availability", F.lit("unreadable")))
    pick = lambda side, c: F.min(F.when(F.col("side") == side, F.col(c)))
    changes = s.groupBy("change_id").agg(
        pick("baseline", "a").alias("old_availability"), pick("working", "a").alias("new_availability"),
        pick("baseline", "text").alias("old_text"), pick("working", "text").alias("new_text"),
    ).where("old_availability is not null and new_availability is not null").withColumn("source_id", F.col("change_id").cast("string"))
    files = table(spark, sf, "file_change").groupBy("change_id").agg(F.min("path").alias("content"))
    working = files.select(F.col("change_id").cast("string").alias("source_id"), "content", F.lit("vba").alias("language"))
    return cmp.overlay(working, changes)


@query(f"""WITH {_SNAP} SELECT change_id::VARCHAR AS source_id, path AS content FROM w WHERE change_id NOT IN (SELECT change_id FROM c)
UNION ALL SELECT change_id::VARCHAR, ot FROM c WHERE oa = 'text'""")
def joi12_overlay_baseline(spark: SparkSession, sf: str) -> DataFrame:
    return _overlay(spark, sf)[0].select("source_id", "content")


@query(f"""WITH {_SNAP} SELECT change_id::VARCHAR AS source_id, 'baseline' AS side, oa AS availability FROM c WHERE oa NOT IN ('text', 'absent')
UNION ALL SELECT change_id::VARCHAR, 'working', na FROM c WHERE na NOT IN ('text', 'absent')""")
def joi12_overlay_issues(spark: SparkSession, sf: str) -> DataFrame:
    return _overlay(spark, sf)[2]


# aggregations, sets, windows


@query(f"""WITH {_STATES} SELECT root_id, snapshot_no,
sha256(string_agg(path || chr(0) || coalesce(sha256, '') || chr(10), '' ORDER BY string_split(path, '/'))) AS revision FROM s GROUP BY ALL""")
def agg1_working_revision(spark: SparkSession, sf: str) -> DataFrame:
    st = table(spark, sf, "file_state")
    last = st.groupBy("root_id", "snapshot_no", "path").agg(F.max(F.struct("delivered_at", "sha256", "file_exists")).alias("s"))
    states = last.where("s.file_exists").select("root_id", "snapshot_no", "path", "s.sha256")
    return cmp.working_revision(states, ["root_id", "snapshot_no"])


@query("SELECT lower(p_name) AS name_cf, count(*) AS n, min('p' || p_partkey) AS first_id FROM part GROUP BY 1")
def agg2_symbol_index(spark: SparkSession, sf: str) -> DataFrame:
    return facts.symbol_index(_part_symbols(spark, sf)).select("name_cf", F.col("named").alias("n"), F.col("only").alias("first_id"))


@query("""SELECT DISTINCT 's' || l_suppkey AS src, 'p' || l_partkey AS dst FROM lineitem
WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 2000) AND l_partkey IN (SELECT p_partkey FROM part WHERE p_size <= 38)""")
def agg3_adjacency(spark: SparkSession, sf: str) -> DataFrame:
    return facts.call_edges(*_line_calls(spark, sf)).select("src", "dst")


@query("""SELECT text, doc_id FROM (SELECT text, doc_id, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS k FROM documents WHERE text IS NOT NULL) WHERE k > 1""")
def agg4_later_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").where("text is not null").select(F.sha2("text", 256).alias("key"), "text", "doc_id")
    return facts.first_wins(d, ["key"], ["doc_id"])[1].select("text", "doc_id")


@query("SELECT min(doc_id) AS doc_id FROM documents WHERE text IS NOT NULL GROUP BY text")
def win3_first_wins(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").where("text is not null").select(F.sha2("text", 256).alias("key"), "doc_id")
    return facts.first_wins(d, ["key"], ["doc_id"])[0].select("doc_id")


_EDGES = "e AS (SELECT DISTINCT l_orderkey AS src, l_partkey AS dst, year(l_shipdate) % 2 AS y FROM lineitem)"


def _edges(spark: SparkSession, sf: str, y: int) -> DataFrame:
    return table(spark, sf, "lineitem").where(F.year("l_shipdate") % 2 == y).select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"))


@query(f"""WITH {_EDGES} SELECT *, 'deleted' AS change_type FROM (SELECT src, dst FROM e WHERE y = 0 EXCEPT SELECT src, dst FROM e WHERE y = 1)
UNION ALL SELECT *, 'added' FROM (SELECT src, dst FROM e WHERE y = 1 EXCEPT SELECT src, dst FROM e WHERE y = 0)""")
def set2_edge_changes(spark: SparkSession, sf: str) -> DataFrame:
    return cmp.edge_changes(_edges(spark, sf, 0), _edges(spark, sf, 1), ["src", "dst"])


@query("SELECT DISTINCT l_orderkey AS src, l_partkey AS dst FROM lineitem")
def set3_resolved_edges(spark: SparkSession, sf: str) -> DataFrame:
    return resolved_edges(table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("source_fn"), F.col("l_partkey").alias("target_id")))


@query(f"WITH {_EDGES} SELECT src FROM e WHERE y = 0 UNION SELECT src FROM e WHERE y = 1")
def set4_union(spark: SparkSession, sf: str) -> DataFrame:
    side = lambda y: _edges(spark, sf, y).withColumnRenamed("src", "entry_id")
    return affected_entries(side(0), side(1)).withColumnRenamed("entry_id", "src")


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def set6_unassigned(spark: SparkSession, sf: str) -> DataFrame:
    evidence = table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("changed_function_id"))
    return unassigned(table(spark, sf, "orders").select(F.col("o_orderkey").alias("function_id")), evidence).select(F.col("function_id").alias("o_orderkey"))


@query("""WITH r AS (SELECT source, doc_id, row_number() OVER w AS k, sum(n_chars) OVER (w ROWS UNBOUNDED PRECEDING) AS run
FROM documents WHERE source IS NOT NULL AND n_chars IS NOT NULL WINDOW w AS (PARTITION BY source ORDER BY doc_id))
SELECT source, doc_id, CASE WHEN k > 40 THEN 'max_functions' WHEN run > 30000 THEN 'max_source_chars' END AS reason FROM r""")
def win1_budget(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").where("source is not null and n_chars is not null").select("source", "doc_id", "n_chars")
    return within_budget(d, ["source"], "doc_id", "n_chars", 40, 30_000).select("source", "doc_id", "reason")


@query("SELECT o_custkey, min(o_orderpriority) AS first_kind, max(o_orderpriority) AS last_kind FROM orders GROUP BY 1")
def win4_first_last_entry(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select(F.lit("").alias("scope"), F.col("o_custkey").alias("function_id"), F.col("o_orderpriority").alias("kind"), F.col("o_orderstatus").alias("source"))
    return facts.entry_kinds(o).select(F.col("function_id").alias("o_custkey"), F.col("first.kind").alias("first_kind"), F.col("last.kind").alias("last_kind"))


# functions


@query("""SELECT DISTINCT path, 'docs/' || regexp_replace(path, '\\.[^./]+$', '') || '.md' AS document_key, regexp_extract(path, '(\\.[^./]+)$', 1) AS suffix,
regexp_replace(regexp_extract(path, '([^/]*)$', 1), '\\.[^.]+$', '') AS stem FROM file_change""")
def fun8_paths(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "file_change").select("path").distinct()
    return p.select("path", document_key(F.col("path")).alias("document_key"), suffix(F.col("path")).alias("suffix"), stem(F.col("path")).alias("stem"))


@query("""SELECT doc_id, CASE WHEN coalesce(text, '') = '' THEN '-' ELSE replace(replace(replace(text, '\\', '\\\\'), '|', '\\|'), chr(10), '<br>') END AS cell FROM documents""")
def fun9_escape_cell(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", escape_cell(F.col("text")).alias("cell"))


@query("""WITH k AS (SELECT DISTINCT document_key AS d FROM documents WHERE document_key IS NOT NULL AND NOT regexp_matches(document_key, '(^/)|(\\\\)|(//)|(/$)|((^|/)\\.{1,2}(/|$))') AND document_key <> ''),
p AS (SELECT d, array_to_string(string_split(d, '/')[1:n], '/') AS prefix, n = len(string_split(d, '/')) AS whole FROM k, unnest(range(1, len(string_split(d, '/')) + 1)) t(n)),
g AS (SELECT lower(prefix) AS f FROM p GROUP BY 1 HAVING min(prefix) <> max(prefix) OR (bool_or(whole) AND NOT bool_and(whole)))
SELECT DISTINCT d AS document_key FROM p JOIN g ON f = lower(prefix)""")
def fun16_key_collisions(spark: SparkSession, sf: str) -> DataFrame:
    keys = table(spark, sf, "documents").where("document_key is not null").select("document_key")
    return key_errors(keys).where("error <> 'not a relative POSIX path'").select("document_key").distinct()


@query("""WITH t AS (SELECT change_id, side, min(text) AS x FROM content_snapshot WHERE availability = 'text' GROUP BY ALL),
o AS (SELECT change_id, x FROM t WHERE side = 'baseline'), n AS (SELECT change_id, x FROM t WHERE side = 'working')
SELECT coalesce(o.change_id, n.change_id) AS function_id, CASE WHEN o.change_id IS NULL THEN 'added' WHEN n.change_id IS NULL THEN 'deleted' ELSE 'modified' END AS change_type
FROM o FULL JOIN n USING (change_id) WHERE o.x IS DISTINCT FROM n.x""")
def joi2_compare_functions(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "content_snapshot").where("availability = 'text'")
    side = lambda n: s.where(F.col("side") == n).groupBy(F.col("change_id").alias("id")).agg(F.min("text").alias("source"))
    return cmp.compare(side("baseline"), side("working"), ["id"], "source").select(F.col("id").alias("function_id"), F.col("status").alias("change_type"))


@query("""WITH own AS (SELECT o_custkey % 20 AS form, o_orderkey % 500 AS n, count(*) AS a, min(o_orderkey) AS ai FROM orders WHERE o_orderstatus = 'P' GROUP BY ALL),
sh AS (SELECT p_partkey % 500 AS n, count(*) AS b, min(1000000000 + p_partkey) AS bi FROM part WHERE p_size < 15 GROUP BY ALL)
SELECT l_orderkey, l_linenumber, CASE WHEN coalesce(a, 0) + coalesce(b, 0) = 1 THEN coalesce(ai, bi) END AS target_id FROM lineitem
LEFT JOIN own ON own.form = l_suppkey % 20 AND own.n = l_partkey % 500 LEFT JOIN sh ON sh.n = l_partkey % 500""")
def joi20_form_scopes(spark: SparkSession, sf: str) -> DataFrame:
    calls = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_suppkey") % 20).alias("form"), (F.col("l_partkey") % 500).alias("name_cf"))
    own = table(spark, sf, "orders").where("o_orderstatus = 'P'").select((F.col("o_custkey") % 20).alias("form"), (F.col("o_orderkey") % 500).alias("name_cf"), F.col("o_orderkey").alias("id"))
    shared = table(spark, sf, "part").where("p_size < 15").select((F.col("p_partkey") % 500).alias("name_cf"), (F.col("p_partkey") + 1000000000).alias("id"))
    return resolve_by_form(calls, own, shared).select("l_orderkey", "l_linenumber", "target_id")


@query("""SELECT o_custkey AS entry_id, o_orderkey AS changed_function_id, CASE WHEN o_orderstatus = 'F' THEN 'added' ELSE 'modified' END AS change_type,
(CASE WHEN o_custkey = o_orderkey THEN 'entry_' ELSE 'reachable_function_' END) || (CASE WHEN o_orderstatus = 'F' THEN 'added' ELSE 'modified' END) AS reason
FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')""")
def joi15_evidence(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    path = F.array("o_custkey", "o_orderkey").alias("path")
    paths = o.select(F.col("o_custkey").alias("root"), F.col("o_orderkey").alias("node"), path, "o_orderstatus")
    changed = o.where("o_orderpriority in ('1-URGENT', '2-HIGH')")
    kind = F.when(F.col("o_orderstatus") == "F", "added").otherwise("modified").alias("change_type")
    found = find_evidence(changed.select(F.col("o_orderkey").alias("function_id"), kind), paths.where("o_orderstatus <> 'F'"), paths.where("o_orderstatus <> 'P'"))
    return found.select("entry_id", "changed_function_id", "change_type", "reason")


@query("""SELECT DISTINCT sha256(text) AS key FROM documents WHERE text IS NOT NULL AND lang IS DISTINCT FROM 'en'
AND sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE text IS NOT NULL AND lang = 'en')""")
def snk2_new_objects(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").where("text is not null").select("lang", F.sha2("text", 256).alias("key"))
    return new_objects(d.where(~F.col("lang").eqNullSafe("en")).select("key"), d.where("lang = 'en'"))


@query("""SELECT doc_id, CASE WHEN document_key IS NULL OR document_key = '' THEN 'fragment_id must be a non-empty marker-safe ID'
WHEN regexp_replace(coalesce(text, ''), '\\s', '', 'g') = '' THEN 'upsert result requires non-empty Markdown'
WHEN contains(text, '<!-- impact:') THEN 'fragment Markdown must not contain reserved markers' END AS error FROM documents""")
def fun14_validate_operations(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    return d.select("doc_id", operation_error(F.col("document_key"), F.lit("upsert"), F.col("text")).alias("error"))


_OPS = """c AS (SELECT change_id, arg_max(struct_pack(r := root_id, p := path, s := status, h := coalesce(working_sha256, baseline_sha256)), landed_at) AS x
  FROM file_change GROUP BY 1),
ops AS (SELECT x.r::VARCHAR AS d, x.p AS f, change_id AS seq, CASE WHEN x.s = 'deleted' THEN 'delete' ELSE 'upsert' END AS kind, x.h AS md FROM c),
l AS (SELECT d, f, max(seq) FILTER (kind = 'delete') AS ld, max_by(kind, seq) AS last_kind, max_by(md, seq) AS md FROM ops GROUP BY ALL),
a AS (SELECT o.d, o.f, min(o.seq) AS since FROM ops o JOIN l USING (d, f) WHERE o.kind = 'upsert' AND o.seq > coalesce(l.ld, -1) GROUP BY ALL)"""


@query(f"""WITH {_OPS} SELECT d AS document_key, f AS fragment_id, row_number() OVER (PARTITION BY d ORDER BY since) AS ord, md AS markdown
FROM l JOIN a USING (d, f) WHERE last_kind = 'upsert'""")
def frg1_fold(spark: SparkSession, sf: str) -> DataFrame:
    """File changes as operations: a root is a document, a path a fragment; deleted files delete theirs."""
    latest = table(spark, sf, "file_change").groupBy("change_id").agg(F.max_by(F.struct("root_id", "path", "status", "working_sha256"), "landed_at").alias("x"))
    gone = F.col("x.status") == "deleted"
    return fold_operations(latest.select(
        F.col("x.root_id").cast("string").alias("document_key"), F.col("x.path").alias("fragment_id"), F.col("change_id").alias("seq"),
        F.when(gone, "delete").otherwise("upsert").alias("kind"), F.when(~gone, F.col("x.working_sha256")).alias("markdown"),
    ))


@query("SELECT path, row_number() OVER (ORDER BY string_split(path, '/')) AS ord FROM (SELECT DISTINCT path FROM file_change)")
def srt2_component_order(spark: SparkSession, sf: str) -> DataFrame:
    """Rank of paths by their components."""
    return global_rank(table(spark, sf, "file_change").select("path").distinct(), F.split("path", "/"))


@query("SELECT doc_id, octet_length(encode(text)) AS bytes, sha256(text) AS sha256 FROM documents WHERE text IS NOT NULL")
def fun18_integrity(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").where("text is not null").select(F.col("doc_id").cast("string").alias("document_key"), "text")
    return with_integrity(d).select(F.col("document_key").cast("bigint").alias("doc_id"), "bytes", "sha256")


@query("""WITH s AS (SELECT 'p' || p_partkey AS id, lower(p_name) AS n, lower(p_brand) AS m FROM part WHERE p_size < 20),
c AS (SELECT p_partkey, lower(p_name) AS n, lower(p_brand) AS own, CASE WHEN p_size > 30 THEN 'brand#' || (p_size % 5 + 1) || (p_partkey % 5 + 1) END AS q FROM part),
near AS (SELECT n, m, count(*) AS k, min(id) AS id FROM s GROUP BY ALL), far AS (SELECT n, count(*) AS k, min(id) AS id FROM s GROUP BY ALL)
SELECT p_partkey AS call, CASE WHEN near.k = 1 THEN near.id WHEN q IS NULL AND near.k IS NULL AND far.k = 1 THEN far.id END AS target_id,
  CASE WHEN q IS NULL THEN coalesce(far.k, 0) ELSE 0 END AS named
FROM c LEFT JOIN near ON near.n = c.n AND near.m = coalesce(q, own) LEFT JOIN far ON far.n = c.n""")
def joi5_qualified(spark: SparkSession, sf: str) -> DataFrame:
    """Calls of larger parts name a brand, which need not be their own or hold the name."""
    p = table(spark, sf, "part")
    given = F.when(F.col("p_size") > 30, F.concat(F.lit("brand#"), (F.col("p_size") % 5 + 1).cast("string"), (F.col("p_partkey") % 5 + 1).cast("string")))
    calls = p.select(F.lit("").alias("scope"), F.col("p_partkey").alias("call"), F.lower("p_name").alias("name_cf"), given.alias("qualifier_cf"), F.lower("p_brand").alias("module_cf"))
    symbols = p.where("p_size < 20").select(F.lit("").alias("scope"), F.concat(F.lit("p"), "p_partkey").alias("id"), F.lower("p_name").alias("name_cf"), F.lower("p_brand").alias("module_cf"))
    return facts.resolve_scoped(calls, symbols).select("call", "target_id", "named")


def _constants(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(uses, declarations, sources): parts declare their names in one module for each brand, the dear ones publicly and the
    large ones unusably; module lines of nations are two sources; orders use names of parts, some by a module's name."""
    p = table(spark, sf, "part")
    source = F.concat(F.lower("p_brand"), F.when(F.col("p_size") % 7 == 0, "/b.bas").otherwise(".bas"))
    name = F.lower(F.split("p_name", " ")[0])
    declared = p.select(
        F.lit("").alias("scope"), source.alias("source_id"), F.col("p_partkey").alias("ord"), F.when(F.col("p_size") > 47, "blocker").otherwise("constant").alias("kind"),
        F.concat(name, (F.col("p_partkey") % 40).cast("string")).alias("name_cf"), F.when(F.col("p_retailprice") > 1400, "public").otherwise("private").alias("visibility"),
        F.col("p_size").alias("start_line"), F.when(F.col("p_size") % 7 == 0, "b").otherwise(F.lower("p_brand")).alias("module_cf"),
    )
    shadow = p.where("p_size = 5").select(
        F.lit("").alias("scope"), source.alias("source_id"), F.col("p_partkey").alias("ord"), F.lit("shadow").alias("kind"), F.concat(name, (F.col("p_partkey") % 40).cast("string")).alias("name_cf"),
        F.lit(None).cast("string").alias("visibility"), F.col("p_size").alias("start_line"), F.lit(None).cast("string").alias("module_cf"),
    )
    o = table(spark, sf, "orders").join(p.select(F.col("p_partkey").alias("o_custkey"), source.alias("source_id"), name.alias("first")), "o_custkey")
    asked = F.concat("first", (F.col("o_orderkey") % 40).cast("string"))
    module = F.when(F.col("o_orderpriority") == "1-URGENT", F.concat(F.lit("brand#"), (F.col("o_orderkey") % 5 + 1).cast("string"), (F.col("o_custkey") % 5 + 1).cast("string"))).when(F.col("o_orderpriority") == "2-HIGH", "b")
    use = o.select(F.lit("").alias("scope"), "source_id", F.col("o_orderkey").cast("string").alias("id"), F.lit("use").alias("kind"), asked.alias("name_cf"), module.alias("qualifier_cf"))
    local = o.where("o_orderstatus = 'P'").select(F.lit("").alias("scope"), "source_id", F.col("o_orderkey").cast("string").alias("id"), F.lit("local").alias("kind"), asked.alias("name_cf"), F.lit(None).cast("string").alias("qualifier_cf"))
    return use.unionByName(local), declared.unionByName(shadow), declared.select("scope", "source_id").distinct()


_CONST = """
p AS (SELECT *, lower(p_brand) || CASE WHEN p_size % 7 = 0 THEN '/b.bas' ELSE '.bas' END AS src, CASE WHEN p_size % 7 = 0 THEN 'b' ELSE lower(p_brand) END AS mod,
  lower(split_part(p_name, ' ', 1)) AS f FROM part),
d AS (SELECT src, mod, p_partkey AS ord, p_size, f || (p_partkey % 40) AS n, p_size > 47 AS bad, p_retailprice > 1400 AS pub FROM p),
m AS (SELECT mod, count(DISTINCT src) AS k FROM d GROUP BY 1),
u AS (SELECT o_orderkey AS id, src, f || (o_orderkey % 40) AS n, o_orderstatus = 'P' AS hidden,
  CASE WHEN o_orderpriority = '1-URGENT' THEN 'brand#' || (o_orderkey % 5 + 1) || (o_custkey % 5 + 1) WHEN o_orderpriority = '2-HIGH' THEN 'b' END AS q
  FROM orders JOIN p ON p_partkey = o_custkey),
live AS (SELECT u.* FROM u WHERE CASE WHEN q IS NULL THEN NOT hidden AND NOT EXISTS (SELECT 1 FROM d x WHERE x.p_size = 5 AND x.src = u.src AND x.n = u.n)
  ELSE q IN (SELECT mod FROM m) END),
fits AS (SELECT l.id, l.q, d.* FROM live l JOIN d ON d.n = l.n AND CASE WHEN l.q IS NULL
    THEN d.src = l.src OR (d.pub AND NOT EXISTS (SELECT 1 FROM d o WHERE o.src = l.src AND o.n = l.n))
    ELSE d.mod = l.q AND (d.src = l.src OR d.pub) END),
g AS (SELECT id, any_value(q) AS q, count(*) FILTER (bad) AS blocked, count(*) FILTER (NOT bad) AS c, min(ord) FILTER (NOT bad) AS ord, min(mod) FILTER (NOT bad) AS mod FROM fits GROUP BY 1)"""


@query(f"""WITH {_CONST} SELECT id::VARCHAR AS id, CASE WHEN blocked > 0 THEN 'unresolved'
  WHEN c <> 1 OR (q IS NOT NULL AND (SELECT k FROM m WHERE m.mod = q) <> 1) OR (SELECT k FROM m WHERE m.mod = g.mod) <> 1 THEN 'ambiguous' ELSE 'found' END AS state,
CASE WHEN blocked = 0 AND c = 1 AND (q IS NULL OR (SELECT k FROM m WHERE m.mod = q) = 1) AND (SELECT k FROM m WHERE m.mod = g.mod) = 1 THEN ord END AS target FROM g WHERE blocked > 0 OR c > 0""")
def joi6_constants(spark: SparkSession, sf: str) -> DataFrame:
    """Uses of constants by the rules of modules, over parts as declarations and orders as uses."""
    found = resolve_constants(*_constants(spark, sf))
    return found.select("id", "state", F.when(F.col("state") == "found", F.col("target.ord")).alias("target"))


@query(f"""WITH {_CONST} SELECT src AS source_id, n AS name_cf, ord FROM (SELECT *, row_number() OVER (PARTITION BY src, n ORDER BY ord) AS k FROM d WHERE NOT bad) WHERE k > 1""")
def agg6_duplicate_constants(spark: SparkSession, sf: str) -> DataFrame:
    return duplicate_constants(_constants(spark, sf)[1]).select("source_id", "name_cf", "ord")


_KINDS = ("decisions", "loops", "nested_control_units", "joins", "aggregates", "exception_handlers", "fetch", "quarters", "physical_code_lines", "discounted_lines", "max_control_depth", "cursor_declarations")


@query(f"""WITH e AS (SELECT l_orderkey::VARCHAR AS id, ({list(_KINDS)})[(l_partkey + l_linenumber) % {len(_KINDS)} + 1] AS kind, floor(l_quantity) AS a, l_suppkey AS name FROM lineitem),
c AS (SELECT id, coalesce(sum(a) FILTER (kind = 'decisions'), 0) AS d, coalesce(sum(a) FILTER (kind = 'loops'), 0) AS l, coalesce(sum(a) FILTER (kind = 'nested_control_units'), 0) AS n,
  coalesce(sum(a) FILTER (kind IN ('joins', 'aggregates')), 0) AS s, coalesce(sum(a) FILTER (kind IN ('cursor_declarations', 'exception_handlers')), 0) AS o,
  count(DISTINCT name) FILTER (kind = 'fetch') AS f, coalesce(sum(a) FILTER (kind = 'quarters'), 0) / 4 AS e, coalesce(sum(a) FILTER (kind = 'physical_code_lines'), 0) AS p,
  coalesce(sum(a) FILTER (kind = 'discounted_lines'), 0) AS x, coalesce(max(a) FILTER (kind = 'max_control_depth'), 0) AS depth FROM e GROUP BY 1),
r AS (SELECT *, 2 * d + l + 3 * n AS control, 2 * s AS sql_, o + f AS other FROM c),
t AS (SELECT *, round(e + greatest(0, greatest(0, p - x) - e) + least(30, control + sql_ + other) + least(10, p / 50), 2) AS score FROM r)
SELECT id, e AS logical_units, greatest(0, p - x)::INT AS adjusted_code_lines, f::INT AS fetched_cursors, depth::INT AS max_control_depth, (control + sql_ + other)::INT AS structure, score,
CASE WHEN NOT (p <= 50 AND e <= 50) AND score >= 100 THEN 'multi_pass' ELSE 'single_pass' END AS mode, (CASE WHEN p <= 50 AND e <= 50 THEN 8 ELSE 7 END)::INT AS reasons FROM t""")
def agg8_workload(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as events of their orders: metrics by aggregation, then score, mode and evidence."""
    kinds = F.array(*map(F.lit, _KINDS))
    e = table(spark, sf, "lineitem").select(
        F.lit("").alias("scope"), F.col("l_orderkey").cast("string").alias("id"), kinds[((F.col("l_partkey") + F.col("l_linenumber")) % len(_KINDS)).cast("int")].alias("kind"),
        F.floor("l_quantity").cast("double").alias("amount"), F.col("l_suppkey").cast("string").alias("name"),
    )
    found = assess(metrics(e))
    parts = F.filter("evidence", lambda x: x["reason"].isin("control_structure", "sql_structure", "cursor_and_exceptions"))
    structure = F.aggregate(parts, F.lit(0.0), lambda acc, x: acc + x["points"]).cast("int")
    return found.select("id", "logical_units", "adjusted_code_lines", "fetched_cursors", "max_control_depth", structure.alias("structure"), "score", "mode", F.size("evidence").alias("reasons"))


@query("""WITH k AS (SELECT DISTINCT path || CASE WHEN status = 'deleted' THEN '/old' ELSE '' END AS d FROM file_change
  UNION SELECT DISTINCT upper(path) FROM file_change WHERE status = 'added'),
p AS (SELECT d, array_to_string(string_split(d, '/')[1:n], '/') AS prefix, n = len(string_split(d, '/')) AS whole FROM k, unnest(range(1, len(string_split(d, '/')) + 1)) t(n)),
g AS (SELECT lower(prefix) AS f, min(prefix) <> max(prefix) AS cased FROM p GROUP BY 1 HAVING min(prefix) <> max(prefix) OR (bool_or(whole) AND NOT bool_and(whole)))
SELECT DISTINCT d AS document_key, CASE WHEN cased THEN 'differs in letter case' ELSE 'file and directory' END AS error FROM p JOIN g ON f = lower(prefix)""")
def fun16_collisions(spark: SparkSession, sf: str) -> DataFrame:
    """Paths as keys: deleted files become folders, added ones appear again in capitals."""
    f = table(spark, sf, "file_change").select("path", "status").distinct()
    keys = f.select(F.concat("path", F.when(F.col("status") == "deleted", "/old").otherwise("")).alias("document_key")).union(f.where("status = 'added'").select(F.upper("path")))
    return key_errors(keys)


@query("""SELECT k.key, s.n AS length FROM (SELECT DISTINCT working_sha256 AS key FROM file_change WHERE working_sha256 IS NOT NULL) k
LEFT JOIN (SELECT sha256 AS key, max(size_bytes) AS n FROM file_state WHERE sha256 IS NOT NULL GROUP BY 1) s USING (key)""")
def src7_read_objects(spark: SparkSession, sf: str) -> DataFrame:
    keys = table(spark, sf, "file_change").where("working_sha256 is not null").select(F.col("working_sha256").alias("key"))
    stored = table(spark, sf, "file_state").where("sha256 is not null").groupBy(F.col("sha256").alias("key")).agg(F.max("size_bytes").alias("content"))
    return read_objects(keys, stored).withColumnRenamed("content", "length")


@query("SELECT doc_id FROM documents WHERE text IS NOT NULL AND n_chars IS NOT NULL AND octet_length(encode(text)) <> n_chars")
def fun18_corrupt(spark: SparkSession, sf: str) -> DataFrame:
    """Texts whose bytes are not as many as their recorded characters."""
    d = table(spark, sf, "documents").where("text is not null and n_chars is not null").select(F.col("doc_id").cast("string").alias("document_key"), "text", "n_chars")
    stored = with_integrity(d).join(d.select("document_key", "n_chars"), "document_key").withColumn("bytes", F.col("n_chars"))
    return corrupt(stored).select(F.col("document_key").cast("bigint").alias("doc_id"))
