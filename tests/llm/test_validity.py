"""Parsing with derivatives: whole files, cut files, marked conflicts, foreign content, and the engine itself."""

import ast
import itertools
import random
import re
import warnings

import pytest

from impactframe.llm import validity as v
from impactframe.llm.derivatives import Grammar

PLSQL = """CREATE OR REPLACE PACKAGE BODY trip_pkg AS
  TYPE t_ids IS TABLE OF NUMBER INDEX BY PLS_INTEGER;
  c_max CONSTANT NUMBER(10,2) := 5;
  CURSOR c_all(p_x NUMBER) IS SELECT a.id, b.name n FROM a LEFT JOIN b ON a.id = b.id WHERE a.x BETWEEN 1 AND p_x ORDER BY 1 DESC;
  PROCEDURE go(p_id IN OUT NOCOPY trips.id%TYPE, p_s VARCHAR2 DEFAULT 'it''s') IS
    v_row trips%ROWTYPE;
    e_bad EXCEPTION;
  BEGIN
    <<outer>>
    FOR r IN (SELECT id, qty FROM t WHERE id = p_id AND name LIKE 'x%' GROUP BY id HAVING COUNT(*) > 1) LOOP
      IF r.qty > 0 AND NOT r.id IS NULL THEN v_row.qty := NVL(r.qty, 0) + 1; ELSIF r.qty IN (1, 2) THEN NULL; ELSE EXIT outer WHEN TRUE; END IF;
      v_msg := q'[don't END IF]' || CASE WHEN r.qty = 1 THEN 'a' ELSE 'b' END;
    END LOOP outer;
    WHILE i < 3 LOOP i := i + 1; END LOOP;
    FOR i IN REVERSE 1..10 LOOP CONTINUE; END LOOP;
    INSERT INTO t (a, b) VALUES (1, 'x') RETURNING id INTO v_id;
    UPDATE t SET a = a - 1, b = (SELECT MAX(x) FROM y) WHERE id = 1;
    DELETE FROM t WHERE a IS NOT NULL;
    MERGE INTO t USING s ON (t.id = s.id) WHEN MATCHED THEN UPDATE SET a = 1 WHEN NOT MATCHED THEN INSERT (a) VALUES (2);
    EXECUTE IMMEDIATE 'drop table x' USING p_id;
    OPEN c_all(3); FETCH c_all INTO v_row; CLOSE c_all;
    CASE v WHEN 1 THEN go(p_id => 1); ELSE RAISE e_bad; END CASE;
    COMMIT;
  EXCEPTION WHEN NO_DATA_FOUND OR TOO_MANY_ROWS THEN RAISE; WHEN OTHERS THEN RETURN;
  END go;
  FUNCTION f RETURN NUMBER IS BEGIN RETURN 1; END;
END trip_pkg;
/
"""
VBA = '''Attribute VB_Name = "modRoute"
Option Explicit
Private Const A As Long = 3, B = "x""y"
Public Type T
    x As Long
    y(1 To 3) As String * 5
End Type
Private Enum E
    One = 1
    Two
End Enum
Declare PtrSafe Function F Lib "k" Alias "kk" (ByVal x As Long) As Long
Dim WithEvents q As Object, r() As New Collection

Public Sub Go(Optional ByVal a As Long = 1, ParamArray rest())
    Dim i As Long, s$, d As Date: s = "a" & _
        "b"
    On Error GoTo Failed
    If a > 1 Then Exit Sub Else MsgBox "x", vbOKOnly
    If a = 1 And Not IsNull(Me!x) Then
        Call Do2(a, , "z")
    ElseIf a <> 2 Then
        Debug.Print a; "b", 3
    Else
        Set r = New Collection
    End If
    For i = 1 To 10 Step 2: Next i
    For Each q In Forms!frm.Controls("x")
    Next
    Do While Not rs.EOF
        rs.MoveNext
    Loop
    Do
    Loop Until True
    With Forms!f
        .Caption = "a: ""b"""
    End With
    Select Case a
        Case 1, 3 To 5, Is > 9
            a = 0
        Case Else
            ReDim Preserve r(1 To a)
    End Select
    d = #1/2/2020#
    Open "f" For Input As #1
    Print #1, a
    Close #1
Failed:
    MsgBox Err.Description
    Resume Next
End Sub
Private Function G() As Long
    G = -A ^ 2 Mod 3 ' Rem End Sub
End Function
Property Get P() As String
End Property
'''
PYTHON = '''"""doc
<<<<<<< not a conflict
"""
from __future__ import annotations
import os.path as p, sys
from . import (a, b as c,)

@cached(limit=3)
async def f(x: list, /, y=1, *args: int, z, **kw) -> dict[str, int]:
    async with a as b, c: pass
    await g(*x, **kw, k=[i async for i in x if i])
    match x:
        case [1, *rest] | {"a": K(b=2), **more} if rest: return
        case _: pass
    return {**kw, "a": lambda q, *r: (yield), 1: {2, 3}}

class C[T](B, metaclass=M):
    x: int = 1
    def m(self): self.x, (y, *z) = 1, [2]; del self.x; global g; return f"{x!r:>{w}} {{}}"
try:
    if (n := 1) < 2 <= 3 not in x is not None: pass
    elif x: ...
    else: print(x[1:2, ::3], x if y else z)
except* (A, B) as e: raise X from e
finally:
    while True: break
    else: pass
for i, *j in 1, 2: assert i, "m"; x += 1; x = y = z
type X = int
match = case = 1
'''
FILES = {"plsql": PLSQL, "vba": VBA, "python": PYTHON}


@pytest.mark.parametrize("language", FILES)
@pytest.mark.parametrize("end", ["\n", "\r\n", "\r"])
def test_whole_files_are_valid(language, end):
    assert v.verdict(FILES[language].replace("\n", end), language)[0] == "valid"


@pytest.mark.parametrize("a,b", list(itertools.permutations(FILES, 2)))
def test_content_of_another_language(a, b):
    assert v.verdict(FILES[a], b)[0] != "valid"


@pytest.mark.parametrize("language", FILES)
def test_conflict_markers(language):
    lines = FILES[language].split("\n")
    at = {"plsql": 9, "vba": 16, "python": 9}[language]
    text = "\n".join([*lines[:at], "<<<<<<< HEAD", lines[at], "=======", lines[at], ">>>>>>> theirs", *lines[at + 1 :]])
    found, line, _ = v.verdict(text, language)
    assert (found, line) == ("token", at + 1)


@pytest.mark.parametrize("language", ["plsql", "vba"])
def test_cut_files_are_truncated(language):
    text = FILES[language]
    depth = re.compile(r"^\s", re.M)
    cuts = [m.start() for m in depth.finditer(text)][5::7]
    assert all(v.verdict(text[:c], language)[0] != "valid" for c in cuts if c > text.index("Go" if language == "vba" else "PROCEDURE"))


def test_python_agrees_with_the_compiler():
    lines = PYTHON.split("\n")
    for k in range(len(lines)):
        for text in ("\n".join(lines[:k]), "\n".join(lines[:k] + lines[k + 1 :])):
            try:
                ast.parse(text)
                fine = True
            except SyntaxError:
                fine = False
            assert (v.verdict(text, "python")[0] == "valid") == fine, text[-80:]


def compiles(text):
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            ast.parse(text)
    except (SyntaxError, ValueError):
        return False
    return True


#: Valid statements, each beside one that only its place, order or target makes invalid.
PAIRS = [[half.replace("\\n", "\n") + "\n" for half in line.split(" ||| ")] for line in r"""x = 1 ||| 1 = x
f().x = 3 ||| f() = 3
a += 1 ||| a, b += 1
del f().x, (y, [z]) ||| del f()
f(1, *a, k=2, *b, **c, d=3) ||| f(a=1, 2)
def f(x, /, y=1, *a, z, w=2, **k): pass ||| def f(x=1, y): pass
def f(x, *, y): pass ||| def f(x, *): pass
f(*a, **k) ||| f(**k, *a)
x = yield ||| (yield) = 1
with open(x) as f().y, g as (a, *b): pass ||| with open(x) as f(): pass
for x.y, *z in q: pass ||| for 1 in x: pass
f(i for i in x) ||| f(i for i in x, 1)
(x): int = 1 ||| x, y: int = 1
[a, *b] = c = yield ||| [a, 1] = c
x[1:2, *y] ||| x[1:2:3:4]
lambda x, /, *, y=1: x ||| lambda x=1, y: x
if (y := 1): pass ||| if y := 1 := 2: pass
print(f"{x!r:>{w}}", "a" f"b") ||| print(f"{x!q}")
b"a" rb"b" ||| b"a" "b"
"\N{BULLET}\x41" ||| "\x4"
0x1F + 1_0 + 00 ||| 012 + 1
match x:\n  case [1, *_] | {"a": -1j, **r} | K(a, b=c.d) if x: pass ||| match x:\n  case K(b=1, a): pass
try: pass\nexcept* A: pass ||| try: pass\nexcept A: pass\nexcept* B: pass
type X[T: int, *U, **V] = T ||| type X[*U: int] = 1
@a.b[0]\nclass C(A, m=B): pass ||| class C(i for i in x): pass""".split("\n")]


@pytest.mark.parametrize("good,bad", PAIRS)
def test_python_statements(good, bad):
    for text, fine in ((good, True), (bad, False)):
        assert compiles(text) == fine
        assert (v.verdict(text, "python")[0] == "valid") == fine


def test_python_mutations_agree_with_the_compiler():
    """Tokens of valid statements dropped, doubled and replaced at random, judged by the compiler's parser."""
    draw = random.Random(7)
    good = [g for g, _ in PAIRS]
    good += [s for s in PYTHON.split("\n") if s and compiles(s.strip())]
    pieces = [re.findall(r"\w+|\s+|\*\*|:=|[^\w\s]", s) for s in good]
    spare = sorted({p for ps in pieces for p in ps} | {"await", "async", "lambda", "not", "_", "1j", "b''", "..."})
    for _ in range(6_000):
        parts = list(draw.choice(pieces))
        k = draw.randrange(len(parts))
        parts[k : k + draw.randrange(2)] = draw.choice([[], [draw.choice(spare)], [" ", draw.choice(spare), " "]])
        text = "".join(parts) + "\n"
        assert (v.verdict(text, "python")[0] == "valid") == compiles(text), text


@pytest.mark.parametrize("depth", [200, 400, 5_000])
def test_deep_nesting(depth):
    nested = "(" * depth + "1" + ")" * depth
    assert v.verdict(f"BEGIN x := {nested}; END;\n", "plsql")[0] == "valid"
    assert v.verdict(f"BEGIN x := {nested}); END;\n", "plsql") == ("token", 1, 2 * depth + 5)
    assert v.verdict("BEGIN\n" + "IF a THEN\n" * depth + "NULL;\n" + "END IF;\n" * depth + "END;\n", "plsql")[0] == "valid"
    assert v.verdict("BEGIN\n" + "IF a THEN\n" * depth + "NULL;\n" + "END IF;\n" * (depth - 1) + "END;\n", "plsql")[0] != "valid"
    assert v.verdict(f"Sub a()\nx = {nested}\n" + "If x Then\n" * depth + "End If\n" * depth + "End Sub\n", "vba")[0] == "valid"
    assert v.verdict("x = " + "a if b else " * depth + "lambda: " * depth + "c\n", "python")[0] == "valid"


def test_edges():
    for language in FILES:
        assert v.verdict("", language)[0] == "valid" and v.verdict("﻿\n", language)[0] == "valid"
        assert v.verdict("<!DOCTYPE html>\n<html></html>\n", language)[0] != "valid"
    assert v.verdict("BEGIN NULL; END;\n/\n" * 3000, "plsql")[0] == "valid"
    assert v.verdict("x = " + "(" * 90 + "1" + ")" * 90 + "\n", "python")[0] == "valid"
    assert v.verdict("CREATE PROCEDURE p IS BEGIN x := 'open", "plsql")[0] == "truncated"


def test_engine_against_enumeration():
    g = Grammar("s: 'a' s 'b' | ('c' | 'd'+)? ;", "s")
    good = re.compile(r"^(a*)(c|d+|)(b*)$")
    for n in range(6):
        for word in itertools.product("abcd", repeat=n):
            m = good.match("".join(word))
            fine = bool(m) and len(m.group(1)) == len(m.group(3))
            assert (g.parse(list(word))[0] == "valid") == fine
    g.most_nodes = 1
    assert g.parse(["a", "b"]) == ("valid", 2) and g.parse(["a"]) == ("truncated", 1) and g.parse(["b"]) == ("token", 0)


def test_table(spark):
    schema = "source_id string, repo string, content string, language string, verdict string"
    rows = [
        ("a.py", "r", "x = 1\n", None, "v"), ("a.py", "r", "x = 1\n", None, "v"), ("b.PY", None, "x = (\n", None, "v"), ("c.txt", "r", "x", None, "v"),
        ("d.py", "r", "sub x", " VBA ", "v"), ("e.bas", "r", None, None, "v"), (None, "r", "x", "python", "v"), ("f.py", "r", "", "", "v"),
    ]
    got = {r.source_id: (r.language, r.verdict) for r in v.check_sources(spark.createDataFrame(rows, schema)).collect()}
    assert got == {"a.py": ("python", "valid"), "b.PY": ("python", "truncated"), "c.txt": (None, None), "d.py": ("vba", "truncated"), "e.bas": ("vba", None), "f.py": ("python", "valid")}
    rates = {(r.repo, r.language): (r.files, r.invalid, r.rate) for r in v.invalid_rates(v.check_sources(spark.createDataFrame(rows, schema))).collect()}
    assert rates == {("r", "python"): (2, 0, 0.0), (None, "python"): (1, 1, 1.0), ("r", "vba"): (1, 1, 1.0)}
    assert v.check_sources(spark.createDataFrame([], schema)).count() == 0
