"""Fragments, workbench, forms, tracker and text functions."""

import os

import pytest
from pyspark.sql import functions as F

from impactframe.functions.text import classify, decode_export, decode_lenient, is_binary, unified
from impactframe.operators.forms import form_elements, render_forms, resolve_by_form
from impactframe.operators.fragments import apply_operations, document_errors, fold_operations, fragment_text, parse_documents
from impactframe.operators.tracker import BaselineError, RevisionConflict, Tracker, store_objects
from impactframe.operators.workbench import Workbench, WorkbenchError, key_errors

OPS = "document_key string, seq bigint, fragment_id string, kind string, markdown string"


def mark(key, body):
    return f'<!-- impact:fragment:start fragment_id="{key}" -->\n{body}\n<!-- impact:fragment:end fragment_id="{key}" -->'


def test_fold_matches_a_dictionary(spark):
    ops = [("d", 1, "b", "upsert", "B"), ("d", 2, "a", "delete", None), ("d", 3, "x", "delete", None), ("d", 4, "c", "upsert", "C"), ("d", 5, "a", "upsert", "A2"), ("d", 6, "c", "upsert", "Final C")]
    text = "Intro\n\n" + "\n\n".join(mark(k, k.upper()) for k in ("a", "b", "untouched")) + "\n\nEnd\n"
    docs = spark.createDataFrame([("d", text), ("same", mark("q", "Q")), ("none", None)], "document_key string, text string")
    out = {r.document_key: (r.text, r.changed) for r in apply_operations(docs, spark.createDataFrame(ops, OPS)).collect()}
    body = "\n\n".join([mark("b", "B"), mark("untouched", "UNTOUCHED"), mark("c", "Final C"), mark("a", "A2")])
    assert out["d"] == (f"Intro\n\n{body}\n\nEnd\n", True)
    assert out["same"] == (mark("q", "Q"), False) and out["none"] == (None, False)


def test_fold_of_nothing(spark):
    assert fold_operations(spark.createDataFrame([], OPS)).count() == 0


BROKEN = {
    mark("a", mark("b", "x")): "fragment 'b' starts inside 'a'", mark("a", "x") + "\n" + mark("a", "y"): "fragment 'a' is there twice",
    '<!-- impact:fragment:start fragment_id="a" -->\n': "fragment 'a' never ends", "x\n<!-- impact:other -->": "line 2: not a marker of a fragment",
    mark("a", "x") + "\nloose\n" + mark("b", "y"): "text stands before fragment 'b' and after another",
    '<!-- impact:fragment:end fragment_id="a" -->': "fragment 'a' ends but never starts", mark(" a", "x"): "' a' cannot be a fragment's id",
    mark("a", "x").replace('id="a"', 'id="b"', 1): "fragment 'b' is ended as 'a'",
}


def test_broken_documents(spark):
    docs = spark.createDataFrame([(str(k), t, 0) for k, t in enumerate(BROKEN)] + [("fine", mark("a", "x"), 0), ("none", None, 0)], "document_key string, text string, no int")
    assert {int(r.document_key): r.error for r in document_errors(docs).collect()} == dict(enumerate(BROKEN.values()))
    with pytest.raises(Exception, match="invalid document"):
        parse_documents(docs)[1].collect()
    assert document_errors(docs.limit(0)).count() == 0


def test_prefix_and_suffix_survive(spark):
    rows = [("d", "p\r\n" + mark("a&amp;b", " x\n\ty ") + "\r\n \n" + mark("c", "") + "\u2028s"), ("plain", "only\ntext"), ("none", None)]
    frames, fragments = parse_documents(spark.createDataFrame(rows, "document_key string, text string"))
    assert {tuple(r) for r in frames.collect()} == {("d", "p\r\n", "s"), ("plain", "only\ntext", ""), ("none", "", "")}
    assert {tuple(r) for r in fragments.collect()} == {("d", "a&b", 1, "x\n\ty"), ("d", "c", 2, "")}
    assert [r.markdown for r in fragment_text(spark.createDataFrame(rows, "document_key string, text string"), "a&b").collect()] == ["x\n\ty"]


def test_workbench_recovers_and_publishes(spark, tmp_path):
    store, out = str(tmp_path / "store"), tmp_path / "docs"
    result = lambda *rows: spark.createDataFrame(rows, "seq bigint, fragment_id string, kind string, markdown string")
    with Workbench(spark, store) as w:
        w.save_task("a/x.md", "t1", result((1, "f", "upsert", "one"), (2, "g", "upsert", "two")))
        with pytest.raises(WorkbenchError):
            w.save_task("a/x.md", "t1", result((1, "f", "upsert", "again")))
    with Workbench(spark, store) as w:  # another handle goes on
        assert w.contains_task("a/x.md", "t1") and not w.contains_task("a/x.md", "t2")
        w.save_task("a/x.md", "t2", result((1, "f", "upsert", "last")))
        assert w.publish(str(out)) == ["a/x.md"]
    assert (out / "a/x.md").read_text() == mark("f", "last") + "\n\n" + mark("g", "two") + "\n"
    assert not os.path.exists(store)
    with Workbench(spark, store) as w:
        w.save(spark.createDataFrame([("k.md", "t")], "document_key string, text string"))
        with pytest.raises(WorkbenchError):
            w.save_task("k2.md", "t", result((1, "f", "upsert", "x")))
    with pytest.raises(WorkbenchError):
        Workbench(spark, store, protected=[str(tmp_path)])


def test_keys(spark):
    keys = [("a/b.md",), ("A/c.md",), ("d",), ("d/e",), ("/x",), ("ok/1",), (None,), ("p/../q",)]
    bad = {(r.document_key, r.error) for r in key_errors(spark.createDataFrame(keys, "document_key string")).collect()}
    assert {k for k, _ in bad} == {"a/b.md", "A/c.md", "d", "d/e", "/x", None, "p/../q"}


FORM = """Version =20
Begin Form
    Caption ="Orders"
    RecordSource ="T"
    Begin
        Begin Section
            Name ="Detail"
            Begin
                Begin CommandButton
                    Name ="bSave"
                    Caption ="Save "
                        "it | now"
                    OnClick ="[Event Procedure]"
                    Begin
                        Begin Label
                            Caption ="L"
                        End
                    End
                End
            End
        End
    End
End
CodeBehindForm
Private Sub BSAVE_Click()
End Sub
"""


DEEP = """Begin Form
    Caption ="A | B"
    AllowEdits = NotDefault
    OnLoad ="[Event Procedure]"
    GUID = Begin
        0x00
    End
    Begin Tab
        Name ="pages"
        StatusBarText ="Pages"
        Begin Page
            Begin TextBox
                Name ="t"
                ControlSource ="x"
                Filter ="a"
                Filter ="b"
                OnExit ="=Save()"
                Begin Section
                    Name ="hidden"
                End
            End
        End
        Begin Label
            Name ="l"
        End
        Begin Label
        End
    End
    Begin ComboBox
        Name ="c"
        RowSource ="SELECT 1\\015\\012FROM t"
        Begin Label
            Name ="cl"
            Caption ="Choose"
        End
    End
End
"""
DEEP_MARKDOWN = """# deep

## Form Metadata

- **Caption:** A \\| B
- **Behavior:** OnLoad: Form_Load; AllowEdits=non-default

| Control | Caption | Binding / Events / Rules |
| --- | --- | --- |
| ComboBox `c` | Choose | RowSource=SELECT 1 FROM t |

## Pages

| Control | Caption | Binding / Events / Rules |
| --- | --- | --- |
| Label `l` | - | - |

| Control | Caption | Binding / Events / Rules |
| --- | --- | --- |
| TextBox `t` | - | ControlSource=x; OnExit: =Save(); Filter=b |
"""


def test_forms(spark):
    rows = [("f", FORM), ("bad", "End"), ("none", None), ("open", "Begin Form"), ("deep", DEEP), (None, FORM), ("f", FORM)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "form string, text string, no string")
    elements = form_elements(df).orderBy("elem_id").collect()
    assert [(e.element_type, e.parent_id) for e in elements if e.form == "f"] == [("Form", None), ("Section", 0), ("CommandButton", 1), ("Label", 2)]
    assert [(p.key, p.value) for p in elements[-1].props] and {e.form for e in elements if e.error} == {"bad", "open"}
    found = {r.form: r for r in render_forms(df).collect()}
    text = found["f"].markdown
    assert "| CommandButton `bSave` | Save it \\| now | OnClick: BSAVE_Click |" in text and "## Section `Detail`" in text
    assert found["bad"].error == "line 1: unmatched End" and found["f"].error is None and "Form block" in found["none"].error
    assert found["open"].error.startswith("unterminated") and found["bad"].markdown is None
    assert found["deep"].markdown == DEEP_MARKDOWN


def test_form_scopes(spark):
    calls = spark.createDataFrame([("f1", "a"), ("f2", "a"), ("f1", "m"), ("f2", "z")], "form string, name_cf string")
    own = spark.createDataFrame([("f1", "a", "f1.a"), ("f1", "m", "f1.m")], "form string, name_cf string, id string")
    shared = spark.createDataFrame([("m", "mod.m")], "name_cf string, id string")
    got = {(r.form, r.name_cf): r.target_id for r in resolve_by_form(calls, own, shared).collect()}
    assert got == {("f1", "a"): "f1.a", ("f2", "a"): None, ("f1", "m"): None, ("f2", "z"): None}


def test_tracker(spark, tmp_path):
    (tmp_path / ".hidden").write_text("h")
    (tmp_path / "a.py").write_text("v1\n")
    (tmp_path / "b.bin").write_bytes(b"\0x")
    t = Tracker(spark, str(tmp_path), excludes=["*.tmp"])
    (tmp_path / "c.tmp").write_text("no")
    first = t.scan()
    assert first.baseline_revision == "initial"
    assert {(r.path, r.status, r.new_availability) for r in first.changes.collect()} == {(".hidden", "added", "text"), ("a.py", "added", "text"), ("b.bin", "added", "binary")}
    t.commit("one", expected_revision=first.working_revision, expected_baseline="initial")
    (tmp_path / "a.py").write_text("v2\n")
    second = t.scan()
    (tmp_path / "a.py").write_text("v3\n")
    row = second.changes.collect()[0]
    assert (row.path, row.status, row.old_text, row.new_text) == ("a.py", "modified", "v1\n", "v2\n")  # as scanned
    assert second.diffs().first().diff.splitlines()[:2] == ["--- a/a.py", "+++ b/a.py"]
    with pytest.raises(RevisionConflict):
        t.commit(expected_revision=second.working_revision)
    assert t.undo() and not t.undo()
    assert t.manifest()["revision"] == "initial"


def test_tracker_stores_each_content_once(spark, tmp_path):
    (tmp_path / "a.py").write_text("v1\n")
    (tmp_path / "b.py").write_text("v1\n")
    store = f"file://{tmp_path}/elsewhere/../store"
    t = Tracker(spark, str(tmp_path), baseline=str(tmp_path / "store"), includes=["*.py"])
    t.commit("one")
    (tmp_path / "a.py").write_text("v2\n")
    (tmp_path / "c.txt").write_text("out of scope")
    t.commit("two")
    assert t.objects().count() == 2 and t.manifest()["parent"] is not None
    got = {r.path: (r.availability, r.text) for r in t.baseline_contents(spark.createDataFrame([("a.py",), ("gone.py",)], "path string")).collect()}
    assert got == {"a.py": ("text", "v2\n"), "gone.py": ("absent", None)}
    assert t.undo() and t.scan().changes.select("path", "status", "old_text", "new_text").collect()[0][:] == ("a.py", "modified", "v1\n", "v2\n")
    t.storage.write("no such revision", "current")
    with pytest.raises(BaselineError):
        t.scan()
    assert Tracker(spark, str(tmp_path), baseline=store.replace("/elsewhere/..", "")).storage.exists("current")


def test_workbench_removes_only_what_it_wrote(spark, tmp_path):
    store = tmp_path / "store"
    result = spark.createDataFrame([(1, "f", "upsert", "one")], "seq bigint, fragment_id string, kind string, markdown string")
    w = Workbench(spark, str(store))
    w.save_task("x.md", "t", result)
    assert not w.contains("x.md")
    (store / "tasks" / "notes.txt").write_text("mine")
    with pytest.raises(WorkbenchError, match="notes.txt"):
        w.publish(str(tmp_path / "out"))
    assert (tmp_path / "out" / "x.md").exists() and (store / "tasks" / "notes.txt").read_text() == "mine"
    with pytest.raises(WorkbenchError):
        w.save_task("y.md", "t", result)  # closed
    with pytest.raises(Exception):
        Workbench(spark, str(tmp_path / "other")).save(spark.createDataFrame([("k", "t")], "document_key string, text string").withColumn("text", F.raise_error(F.lit("broken"))))


def test_object_store_is_write_once(spark, tmp_path):
    df = spark.createDataFrame([("k", b"1"), ("k", b"1"), ("l", b"2")], "key string, content binary")
    path = str(tmp_path / "objects")
    assert (store_objects(df, path, spark), store_objects(df, path, spark)) == (2, 0)


def test_bytes():
    assert classify(None) == ("unreadable", None) and classify(b"\0x") == ("binary", None) and classify(b"\xff") == ("undecodable", None)
    assert classify("é".encode("utf-16")) == ("text", "é") and classify(b"") == ("text", "")
    assert is_binary(b"x" * (1 << 20) + b"x") and not is_binary((b"x" * 1000 + b"\n") * 2000)
    assert decode_lenient("é".encode("cp1252")) == "é" or decode_lenient("é".encode("utf-8")) == "é"
    assert decode_export("Begin".encode("utf-16-le")) == "Begin" and decode_export("Begin".encode("utf-16-be")) == "Begin"
    assert unified("a\n", "a\n", "x", "y") == "" and unified(None, "a\n", "x", "y").splitlines()[-1] == "+a"
