"""Workload of PL/SQL subprograms: counted by hand from the rules."""

import pytest

from impactframe.functions.plsql_workload import Unterminated, lex, workload_events
from impactframe.operators.workload import plsql_workload

CASES = {
    "plain": ("PROCEDURE p(a NUMBER) IS v NUMBER := 1; BEGIN v := 2; NULL; do_x(1); IF a THEN b; ELSIF c THEN d := 1 + f(2); END IF; END;",
              {"logical_units": 5.5, "decisions": 2, "max_control_depth": 1, "score": 9.52, "mode": "single_pass"}),
    "wide insert": ("BEGIN INSERT INTO t (a,\n b,\n c) VALUES (1,\n 2,\n 3); END;",
                    {"logical_units": 1.0, "physical_code_lines": 5, "adjusted_code_lines": 2, "sql_statements": 1, "score": 2.1}),
    "query": ("BEGIN SELECT a, COUNT(*), f(b) INTO x, y, z FROM t JOIN u ON t.i = u.i WHERE i IN (SELECT 1 FROM d UNION SELECT 2 FROM e) GROUP BY a HAVING COUNT(*) > 1; END;",
              {"logical_units": 9.0, "joins": 1, "additional_query_blocks": 1, "set_operations": 1, "grouping_clauses": 2, "aggregates": 2, "complex_mappings": 1, "windows": 0}),
    "cursor": ("PROCEDURE p IS CURSOR c IS SELECT 1 FROM d; BEGIN OPEN c; LOOP FETCH c INTO v; EXIT WHEN c%NOTFOUND; FETCH c INTO v; END LOOP; EXCEPTION WHEN OTHERS THEN RAISE; END;",
               {"logical_units": 7.25, "cursor_declarations": 1, "fetched_cursors": 1, "exception_handlers": 1, "loops": 1, "decisions": 1}),
    "inline case": ("BEGIN x := CASE WHEN a THEN 1 ELSE 2 END; END;", {"logical_units": 2.0, "decisions": 1, "nested_control_units": 0}),
    "nested": ("BEGIN FOR i IN 1..3 LOOP IF a THEN NULL; END IF; END LOOP; END;", {"logical_units": 2.0, "loops": 1, "decisions": 1, "nested_control_units": 1, "max_control_depth": 2}),
    "case statement": ("BEGIN CASE v WHEN 1 THEN a; WHEN 2 THEN b; ELSE c; END CASE; END;", {"logical_units": 5.0, "decisions": 2}),
    "merge": ("BEGIN MERGE INTO t USING s ON (t.i = s.i) WHEN MATCHED THEN UPDATE SET a = s.a, b = s.a + 1 WHEN NOT MATCHED THEN INSERT (a) VALUES (s.a); END;",
              {"logical_units": 2.0, "sql_statements": 1, "complex_mappings": 1, "decisions": 0}),
    "window": ("BEGIN UPDATE t SET a = (SELECT SUM(x) OVER (PARTITION BY y) FROM z) WHERE i = 1; END;", {"aggregates": 1, "windows": 1, "additional_query_blocks": 1}),
    "long": ("BEGIN\n" + "step(1);\n" * 120 + "END;", {"logical_units": 120.0, "mode": "multi_pass", "score": 124.44}),
    "empty": (None, {"logical_units": 0.0, "score": 0.0, "physical_code_lines": 0}),
    "literals": ("BEGIN x := q'[if END; 'loop]' || n'' || \"end\"; -- if\n /* loop\n */ END;", {"logical_units": 1.0, "decisions": 0, "loops": 0, "physical_code_lines": 2}),
}


@pytest.fixture(scope="module")
def assessed(spark):
    rows = [("s", name, source, "x") for name, (source, _) in CASES.items()] + [("s", "broken", "BEGIN x := 'open", "x")]
    return {r.id: r for r in plsql_workload(spark.createDataFrame(rows, "scope string, id string, source string, kind string")).collect()}


@pytest.mark.parametrize("name", CASES)
def test_counts(assessed, name):
    assert {k: assessed[name][k] for k in CASES[name][1]} == CASES[name][1]


def test_evidence(assessed):
    plain = assessed["plain"].evidence
    assert [e.reason for e in plain] == ["logical_length", "adjusted_code_length", "control_structure", "sql_structure", "cursor_and_exceptions", "structure_cap", "physical_length", "short_source"]
    assert [e.points for e in plain] == [5.5, 0.0, 4.0, 0.0, 0.0, 0.0, 0.02, 0.0] and len(assessed["long"].evidence) == 7
    broken = assessed["broken"]
    assert "Unterminated" in broken.error and broken.score is None and broken.logical_units is None and broken.evidence is None


@pytest.mark.parametrize("text", ["/* x", "q'[x", "'", 'a "b', "Q'x"])
def test_what_never_ends(text):
    with pytest.raises(Unterminated):
        lex(text)


def test_no_rows(spark):
    assert plsql_workload(spark.createDataFrame([], "scope string, id string, source string")).count() == 0
    assert workload_events("END END; THEN WHEN EXCEPTION") and workload_events("IF a THEN")
