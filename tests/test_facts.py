"""Facts from sources: extraction, routing, resolution, diagnostics."""

import pytest

from impactframe.functions.syntax import plsql_calls, plsql_file, python_symbols, vba_calls, vba_procedures
from impactframe.operators import facts as fa
from impactframe.operators import symbols
from impactframe.operators.facts import analyze, calls_of, find_sources, functions_at

FORM = 'Private Sub bSave_Click()\n    CheckPermission "Save"\n    SaveOrder\nEnd Sub\n'
MODULE = "Public Sub CheckPermission(ByVal s As String)\nEnd Sub\nPublic Sub SaveOrder()\n    Call WriteAudit\nEnd Sub\nPublic Function WriteAudit() As Long\nEnd Function\n"
SCHEMA = "source_id string, content string, language string"


def facts(spark, rows):
    return analyze(spark.createDataFrame(rows, SCHEMA))


def codes(f):
    return sorted(r.code for r in f.diagnostics.collect())


def test_forward_and_cross_file_calls(spark):
    f = facts(spark, [("frmOrder.frm", FORM, None), ("modOrder.bas", MODULE, None)])
    assert {r.id for r in f.functions.collect()} == {"vba:frmOrder:bSave_Click", "vba:modOrder:CheckPermission", "vba:modOrder:SaveOrder", "vba:modOrder:WriteAudit"}
    assert {(r.source_fn, r.name, r.line, r.target_id, r.evidence) for r in f.calls.collect()} == {
        ("vba:frmOrder:bSave_Click", "CheckPermission", 2, "vba:modOrder:CheckPermission", "vba_name_resolution"),
        ("vba:frmOrder:bSave_Click", "SaveOrder", 3, "vba:modOrder:SaveOrder", "vba_name_resolution"),
        ("vba:modOrder:SaveOrder", "WriteAudit", 4, "vba:modOrder:WriteAudit", "vba_name_resolution"),
    }
    assert [(r.function_id, r.kind, r.source) for r in f.entry_points.collect()] == [("vba:frmOrder:bSave_Click", "form_event", "analyzer")]
    assert codes(f) == []
    assert f.edges().count() == 3


def test_diagnostics(spark):
    rows = [
        ("a.bas", FORM, None), ("a.bas", FORM + " ", None), ("b.txt", "x", None), ("c.bas", "Sub Open1()\n", None), ("d.sql", "select 1", None),
        (None, "x", None), ("e.bas", None, None), ("f.txt", "Sub Q()\nEnd Sub\nSub Q()\nEnd Sub\n", "VBA"),
    ]
    f = facts(spark, rows)
    assert codes(f) == ["duplicate_function_id", "duplicate_source_id", "parse_error", "unresolved_call", "unresolved_call", "unsupported_file", "unterminated_procedure"]
    message = f.diagnostics.where("code = 'unresolved_call' and line = 3").first().message
    assert message == "Cannot resolve VBA call 'SaveOrder': no indexed VBA procedure has that name."


def test_scopes_do_not_mix(spark):
    rows = [("x.bas", "Sub A()\n  B\nEnd Sub\n", None, "old"), ("y.bas", "Sub B()\nEnd Sub\n", None, "new"), ("x.bas", "Sub A()\n  B\nEnd Sub\n", None, "new")]
    f = analyze(spark.createDataFrame(rows, SCHEMA + ", scope string"))
    assert {(r.scope, r.target_id) for r in f.calls.collect()} == {("old", None), ("new", "vba:y:B")}


def test_empty_input(spark):
    f = facts(spark, [])
    assert f.functions.count() == f.calls.count() == f.diagnostics.count() == 0


SPEC = "CREATE OR REPLACE PACKAGE orders AS\n  PROCEDURE submit(p NUMBER);\n  PROCEDURE lost;\nEND orders;\n"
BODY = """CREATE OR REPLACE PACKAGE BODY orders AS
  PROCEDURE helper IS
  BEGIN
    NULL;
  END helper;
  PROCEDURE submit(p NUMBER) IS
    PROCEDURE inner_one IS BEGIN NULL; END;
  BEGIN
    IF p > 1 THEN
      helper;
    END IF;
    audit_pkg.note_it(p);
    v := CASE WHEN p = 1 THEN 2 END;
  END submit;
END orders;
"""
AUDIT = "create package body audit_pkg is\n  procedure note_it(n number) is\n  begin\n    null;\n  end;\nend;\n"


def test_plsql_packages(spark):
    f = facts(spark, [("orders.pks", SPEC, None), ("orders.pkb", BODY, None), ("audit.pkb", AUDIT, None), ("solo.sql", "CREATE PROCEDURE hr.pay IS\nBEGIN\n  orders.submit(1);\nEND;\n/\n", None)])
    assert {(r.id, r.visibility) for r in f.functions.collect()} == {
        ("plsql:orders:helper", "private"), ("plsql:orders:submit", "public"), ("plsql:audit_pkg:note_it", "private"), ("plsql:standalone:hr:pay", "public"),
    }
    calls = {(r.source_fn, r.name): r.target_id for r in f.calls.collect()}
    assert calls["plsql:orders:submit", "helper"] == "plsql:orders:helper"
    assert calls["plsql:orders:submit", "audit_pkg.note_it"] == "plsql:audit_pkg:note_it"
    assert calls["plsql:standalone:hr:pay", "orders.submit"] == "plsql:orders:submit"
    assert {(r.function_id, r.kind, r.source) for r in f.entry_points.collect()} == {
        ("plsql:orders:submit", "package_public_member", "package_spec"), ("plsql:standalone:hr:pay", "standalone_procedure", "declaration"),
    }
    assert "missing_package_member_implementation" in codes(f)


def test_syntax_rows():
    assert vba_procedures("Sub A()\nSub B()\nEnd Sub\n")[0][0]["end_line"] == 3
    assert vba_calls("Sub A()\n  x = Foo(1) ' Bar(2)\n  .Baz\n  s = \"Qux(1)\"\n  Call Two\nEnd Sub", 10) == [("Foo", 11, None), ("Two", 14, None)]
    assert plsql_calls("procedure aa is begin\n  bb.cc(1); dd; x := COUNT(1);\nend;", 5) == [("bb.cc", 6, "bb"), ("dd", 6, None)]
    assert plsql_file("CREATE PACKAGE BODY p AS PROCEDURE a IS BEGIN NULL;", "f")["diagnostics"][0][0] == "unterminated_procedure"
    names = [(s["name"], s["symbol_type"]) for s in python_symbols("class A:\n  @x\n  def m(self): pass\ndef f():\n  def g(): pass\n")]
    assert names == [("A", "class"), ("A.m", "method"), ("f", "function"), ("f.g", "function")]
    assert python_symbols("def (") == []


def test_lookups(spark):
    s = spark.createDataFrame([("src/A.PKB", None), ("src/b.bas", "PLSQL"), ("c", None)], "source_id string, language string")
    assert {r.source_id for r in find_sources(s, language="plsql").collect()} == {"src/b.bas"}
    assert {r.source_id for r in find_sources(s, extension="pkb").collect()} == {"src/A.PKB"}
    assert {r.source_id for r in find_sources(s, prefix="src/", language="pkb").collect()} == {"src/A.PKB"}
    f = facts(spark, [("m.bas", MODULE, None)])
    at = spark.createDataFrame([("m.bas", 4), ("m.bas", 99)], "source_id string, line int")
    assert [r.id for r in functions_at(f.functions, at).collect()] == ["vba:m:SaveOrder"]
    assert calls_of(f.calls, "unresolved").count() == 0


def test_a_plugin_adds_a_language(spark):
    def extract(source_id, content):
        for no, line in enumerate(content.splitlines(), 1):
            name, _, calls = line.partition(":")
            if not name:
                yield {"kind": "diagnostic", "code": "parse_error", "message": "no name", "line": no}
            else:
                entry = {"entry": ("job", "plugin")} if name.startswith("job") else {}
                yield {"kind": "function", "name": name, "start_line": no, "end_line": no, "source": line, "calls": [(c, no) for c in calls.split()]} | entry

    rows = [("a.job", "jobA: work missing\n: x\nwork: SaveOrder", None), ("m.bas", "Sub SaveOrder()\nwork\nEnd Sub\n", None), ("x.JOB", "work2:work", "JOBS")]
    f = analyze(spark.createDataFrame(rows, "source_id string, content string, language string"), plugins=[fa.Plugin("jobs", (".job",), extract)])
    assert {r.id for r in f.functions.collect()} == {"jobs:a:jobA", "jobs:a:work", "vba:m:SaveOrder", "jobs:x:work2"}
    assert {(r.source_fn, r.name, r.target_id) for r in f.calls.collect()} == {
        ("jobs:a:jobA", "work", "jobs:a:work"), ("jobs:a:jobA", "missing", None), ("jobs:a:work", "SaveOrder", None), ("vba:m:SaveOrder", "work", None), ("jobs:x:work2", "work", "jobs:a:work"),
    }
    assert {tuple(r)[1:] for r in f.entry_points.collect()} == {("jobs:a:jobA", "job", "plugin")}
    assert "parse_error" in {r.code for r in f.diagnostics.collect()}
    ordered = f.ordered()
    assert [r.id for r in ordered.functions.orderBy("ord").collect()] == sorted(r.id for r in f.functions.collect())
    with pytest.raises(KeyError):
        fa.need(f.functions, id="nowhere")
    assert fa.calls_to(f.calls, "jobs:a:work").count() == 2 and fa.need(f.functions, id="jobs:a:work").count() == 1


def test_symbols_of_a_registered_parser(spark, monkeypatch):
    monkeypatch.setattr(symbols, "PARSERS", dict(symbols.PARSERS))
    symbols.register("INI", lambda text: [
        {"name": t, "symbol_type": "function", "declaration": t, "content": t, "body_hash": t, "start_line": 1, "end_line": 1, "nested": False} for t in text.split()
    ])
    rows = [("a.ini", "x y", "y z"), ("b.txt", "p", "q"), ("c.py", "def f(): pass\n", "def f(): 1\n")]
    found = symbols.symbol_changes(spark.createDataFrame(rows, "path string, old_text string, new_text string"))
    assert {(r.path, r.name, r.status) for r in found.collect()} == {("a.ini", "z", "added"), ("a.ini", "x", "deleted"), ("c.py", "f", "modified")}
