"""Impact of changes: the worked example of two forms and a shared module."""

from impactframe.operators.compare import compare, edge_changes, overlay, working_revision
from impactframe.operators.impact import analyze_changes, batches, entry_contexts
from impactframe.operators.symbols import symbol_changes

ORDER = "Private Sub bSave_Click()\n  CheckPermission\n  SaveOrder\nEnd Sub\n"
CUSTOMER = "Private Sub bDelete_Click()\n  CheckPermission\nEnd Sub\n"
BUSINESS = "Sub CheckPermission()\n  x = 1\nEnd Sub\nSub SaveOrder()\n  y = 1\nEnd Sub\nSub OrphanTask()\n  z = 1\nEnd Sub\n"
EDITED = "Sub CheckPermission()\n  x = 2\nEnd Sub\nSub SaveOrder()\n  AuditOrder\nEnd Sub\nSub OrphanTask()\n  z = 2\nEnd Sub\nSub AuditOrder()\nEnd Sub\n"
CHANGE = "source_id string, old_availability string, old_text string, new_availability string, new_text string"


def impact(spark, new, availability="text"):
    working = [("frmOrder.frm", ORDER, None), ("frmCustomer.frm", CUSTOMER, None), ("modBusiness.bas", new or "", None)]
    w = spark.createDataFrame(working if new is not None else working[:2], "source_id string, content string, language string")
    return analyze_changes(w, spark.createDataFrame([("modBusiness.bas", "text", BUSINESS, availability, new)], CHANGE))


def test_edits_reach_entries(spark):
    r = impact(spark, EDITED)
    assert {(x.function_id, x.change_type) for x in r.function_changes.collect()} == {
        ("vba:modBusiness:CheckPermission", "modified"), ("vba:modBusiness:SaveOrder", "modified"), ("vba:modBusiness:OrphanTask", "modified"), ("vba:modBusiness:AuditOrder", "added"),
    }
    reach = {}
    for x in r.evidence.collect():
        reach.setdefault(x.entry_id.split(":")[-1], set()).add(x.changed_function_id.split(":")[-1])
    assert reach == {"bDelete_Click": {"CheckPermission"}, "bSave_Click": {"AuditOrder", "CheckPermission", "SaveOrder"}}
    assert [x.function_id for x in r.unassigned.collect()] == ["vba:modBusiness:OrphanTask"]
    assert [(x.src.split(":")[-1], x.dst.split(":")[-1], x.change_type) for x in r.edge_changes.collect()] == [("SaveOrder", "AuditOrder", "added")]
    assert len({x.component for x in batches(r.evidence).collect()}) == 1
    path = r.evidence.where("changed_function_id like '%AuditOrder'").first()
    assert path.old_path is None and [p.split(":")[-1] for p in path.new_path] == ["bSave_Click", "SaveOrder", "AuditOrder"]
    touched = entry_contexts(r)["edge_changes"].collect()
    assert {x.root.split(":")[-1] for x in touched} == {"bSave_Click"}


def test_deletion_counts_through_the_old_graph(spark):
    r = impact(spark, None, "absent")
    gone = {x.entry_id.split(":")[-1] for x in r.evidence.where("changed_function_id like '%CheckPermission'").collect()}
    assert gone == {"bDelete_Click", "bSave_Click"}
    assert {x.change_type for x in r.function_changes.collect()} == {"deleted"}


def test_unreadable_side_is_an_issue(spark):
    r = impact(spark, None, "binary")
    assert [tuple(x) for x in r.issues.collect()] == [("modBusiness.bas", "working", "binary")]


def test_compare_and_sets(spark):
    a = spark.createDataFrame([(1, "x", "k"), (2, None, "k"), (3, "z", "k")], "id int, h string, status string")
    b = spark.createDataFrame([(2, None, "q"), (3, "y", "q"), (4, "w", "q")], "id int, h string, status string")
    assert {(r.id, r.status) for r in compare(a, b, ["id"], "h").collect()} == {(1, "deleted"), (3, "modified"), (4, "added")}
    e = edge_changes(a.select("id", "h"), b.select("id", "h"), ["id", "h"]).collect()
    assert {(r.id, r.change_type) for r in e} == {(1, "deleted"), (3, "deleted"), (3, "added"), (4, "added")}
    base, work, issues = overlay(
        spark.createDataFrame([("keep", "t", "vba"), ("mod", "new", "vba")], "source_id string, content string, language string"),
        spark.createDataFrame([("mod", "text", "old", "text", "new"), ("gone", "text", "was", "absent", None)], CHANGE),
    )
    assert {(r.source_id, r.content) for r in base.collect()} == {("keep", "t"), ("mod", "old"), ("gone", "was")}
    assert {(r.source_id, r.content) for r in work.collect()} == {("keep", "t"), ("mod", "new")} and issues.count() == 0


def test_revision_orders_components(spark):
    import hashlib

    rows = [(1, "a-b/x", "2"), (1, "a/x", "1"), (2, "q", None)]
    df = working_revision(spark.createDataFrame(rows, "g int, path string, sha256 string"), ["g"])
    h = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert {r.g: r.revision for r in df.collect()} == {1: h("a/x\0" + "1\na-b/x\0" + "2\n"), 2: h("q\0\n")}


def test_symbols(spark):
    rows = [("a.py", "def f(): pass\ndef g(): pass\n", "def f(): return 1\ndef h(): pass\n"), ("b.txt", "x", "y"), ("c.py", None, "class K:\n  def m(self): pass\n"), ("d.py", "def (", "")]
    df = symbol_changes(spark.createDataFrame(rows, "path string, old_text string, new_text string"))
    assert [(r.path, r.name, r.status, r.ord) for r in sorted(df.collect())] == [("a.py", "f", "modified", 2), ("a.py", "g", "deleted", 3), ("a.py", "h", "added", 1), ("c.py", "K.m", "added", 1)]
