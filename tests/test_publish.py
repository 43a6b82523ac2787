"""Documents from changes: keys, fragments, prompts, generation and what is published."""

import pytest
from pyspark.sql import functions as F

from impactframe.operators import publish as p
from impactframe.operators.graph import upstream

CHANGES = "function_id string, old_source_id string, new_source_id string, new_name string, new_source string, seq bigint"


@pytest.fixture(scope="module")
def changes(spark):
    rows = [("a:f", "x/a.pkb", "x/a.pkb", "f", "PROCEDURE f IS\nEND;\n \n", 9), ("a:g", "x/a.pkb", None, None, None, 9), ("b:h", None, "b.v2.pks", "h", "h;", 9)]
    return spark.createDataFrame(rows, CHANGES)


def test_fragments_of_changes(spark, changes):
    keyed = p.changes_by_document(changes)
    assert {(r.function_id, r.document_key, r.ord) for r in keyed.collect()} == {("a:f", "docs/x/a.md", 1), ("a:g", "docs/x/a.md", 2), ("b:h", "docs/b.v2.md", 1)}
    ops = p.function_fragments(keyed)
    found = {r.fragment_id: (r.kind, r.markdown) for r in ops.collect()}
    assert found == {"function:a:f": ("upsert", "## f\n\n```sql\nPROCEDURE f IS\nEND;\n```\n"), "function:a:g": ("delete", None), "function:b:h": ("upsert", "## h\n\n```sql\nh;\n```\n")}
    empty = spark.createDataFrame([], "document_key string, text string")
    first = p.publish(empty, ops)
    assert {r.document_key for r in first.collect()} == {"docs/x/a.md", "docs/b.v2.md"}
    assert p.publish(first, ops).count() == 0  # nothing changes the second time
    gone = p.publish(first, ops.withColumn("kind", F.lit("delete")).withColumn("markdown", F.lit(None).cast("string")))
    assert {r.text for r in gone.collect()} == {None}
    assert {(r.document_key, r.markdown[:4]) for r in p.read_fragment(first, "function:b:h").collect()} == {("docs/x/a.md", ""), ("docs/b.v2.md", "## h")}
    with pytest.raises(Exception, match="named twice"):
        p.publish(empty, ops.unionByName(ops)).collect()


def test_generated_documents(spark, changes, tmp_path):
    for folder, name, text in (("s", "system.txt", "be brief"), ("u", "02-b.user.template", "Second {function_id}{history}"), ("u", "01-a.user.template", "First {{x}} {code}"), ("u", "note.txt", "ignored")):
        (tmp_path / folder).mkdir(exist_ok=True)
        (tmp_path / folder / name).write_text(text)
    templates = p.read_templates(str(tmp_path / "s"), str(tmp_path / "u"))
    assert templates == ("be brief", ["First {{x}} {code}", "Second {function_id}{history}"])
    documents = p.publish(spark.createDataFrame([], "document_key string, text string"), p.function_fragments(p.changes_by_document(changes)))
    asked = p.with_existing(p.changes_by_document(changes), documents, "function", "function_id").withColumns({"code": F.col("new_source"), "summary": F.lit("diff {code}"), "seq": F.col("ord").cast("bigint")})
    found = {r.fragment_id: (r.kind, r.markdown) for r in p.generated(asked, templates, lambda system, user: f"{system}|{user}|\n", function_id="function_id").collect()}
    assert found["function:a:g"] == ("delete", None)
    assert found["function:b:h"][1] == (
        "be brief|First {x} h;|\n\nbe brief|Second b:h\n\n<ExistingFragment>\n## h\n\n```sql\nh;\n```\n</ExistingFragment>\n\n<ChangeSummary>\ndiff {code}\n</ChangeSummary>|"
    )
    with pytest.raises(Exception, match="nothing was generated"):
        p.generated(asked, templates, lambda system, user: " ", function_id="function_id").collect()
    (tmp_path / "s" / "other.txt").write_text("x")
    with pytest.raises(ValueError):
        p.read_templates(str(tmp_path / "s"), str(tmp_path / "u"))
    assert p.outline("", "a\nb") == "### a\n\n3 characters"


def test_analysis_text(spark):
    rows = [("Form_a.txt", "﻿x\r\n CodeBehindForm \r\nSub a()\nCodeBehindForm\n"), ("Form_b.txt", "no marker"), ("Module_c.txt", "﻿CodeBehindForm\nx"), ("Form_d.txt", "CodeBehindForm"), ("Form_e.txt", None)]
    df = spark.createDataFrame(rows, "path string, text string")
    assert [r.t for r in df.select(p.analysis_text(F.col("path"), F.col("text")).alias("t")).collect()] == ["Sub a()\nCodeBehindForm\n", "", "CodeBehindForm\nx", "", None]


def test_upstream(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "b"), ("x", "y"), (None, "c"), ("y", None)], "src string, dst string")
    found = lambda *n: {r.node for r in upstream(edges, spark.createDataFrame([(x,) for x in n], "node string")).collect()}
    assert found("c") == {"a", "b", "c"} and found("x", None) == {"x"} and found("y", "q") == {"x", "y", "q"}
