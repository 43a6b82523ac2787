"""Constants of VBA modules: every rule in one scope each, so that a few jobs judge all cases."""

import pytest
from pyspark.sql import functions as F

from impactframe.operators.constants import attach_constants
from impactframe.operators.facts import analyze

#: scope: (sources, {function: names of its constants}, diagnostic codes of constants)
CASES = {
    "direct": ({"A.bas": 'Private Const PREFIX As String = "Order"\r\nPublic Const RETRIES& = 3\r\nConst UNUSED = 99\r\nPrivate Const A = 1\r\nPrivate Const B = A+1\r\nPublic Sub Save()\r\n Debug.Print PREFIX, retries, B, PREFIX\r\nEnd Sub\r\n'}, {"Save": ["PREFIX", "RETRIES", "B"]}, []),
    "modules": ({"A.bas": "Private Const HIDDEN = 1\nConst MINE = 2\nPublic Const COUNT = 3\nGlobal Const FLAG = True\n", "B.bas": "Public Const COUNT = 4\n", "C.cls": "Public Const OF_CLASS = 9\n",
                 "Use.bas": "Sub Run()\nDebug.Print a.count, flag, HIDDEN, MINE\nDebug.Print OF_CLASS, obj.COUNT, A.HIDDEN, x.A.FLAG\nEnd Sub\n"}, {"Run": ["COUNT", "FLAG", "OF_CLASS"]}, []),
    "shadows": ({"L.bas": "Const VALUE = 1\nSub Run(ByVal PARAM As Long, Optional OTHER As Long = 0)\nDim V1 As Long, ARR() As String\nStatic CACHE As Long\nConst LOC = 7\nDebug.Print VALUE, PARAM, OTHER, V1, ARR, CACHE, LOC\nEnd Sub\n",
                 "P.bas": "\n".join(f"Public Const {n} = 99" for n in ("VALUE", "PARAM", "OTHER", "V1", "ARR", "CACHE", "LOC"))}, {"Run": ["VALUE"]}, []),
    "no uses": ({"A.bas": 'Const T = 1\nSub Run(ByVal A As Object)\n\' T\nRem T: Debug.Print T\nx = 1: Rem T\nDebug.Print "T ""T""", obj.T, A.T, obj!T\nT:\nGoTo T\nCall Helper(T:=0)\nWith obj\nDebug.Print .T\nEnd With\nEnd Sub\n'}, {"Run": []}, []),
    "wrapped": ({"A.bas": 'Private Const A As String = "x,y:z", _\n    B = 2\nSub Run()\nDebug.Print A, _\n B\nEnd Sub\n'}, {"Run": ["A", "B"]}, []),
    "clash": ({"A.bas": "Public Const CLASH = 1\n", "B.bas": "Public Const CLASH = 2\n", "Use.bas": "Sub Run()\nDebug.Print CLASH\nEnd Sub\n"}, {"Run": []}, ["ambiguous_constant"]),
    "conditional": ({"A.bas": "#If VBA7 Then\nPublic Const VALUE = 1\n#Else\nPublic Const VALUE = 2\n#End If\nPrivate Const BROKEN\nSub Run()\nDebug.Print VALUE\nEnd Sub\n"}, {"Run": []}, ["unresolved_constant"] + ["unsupported_constant_declaration"] * 3),
    "private blockers": ({"P.bas": "Private Const LIMIT\nConst OTHER\n", "Q.bas": "Public Const LIMIT = 1\nPublic Const OTHER = 2\n", "Use.bas": "Sub Run()\nDebug.Print LIMIT, OTHER\nEnd Sub\n"}, {"Run": ["LIMIT", "OTHER"]}, ["unsupported_constant_declaration"] * 2),
    "public blocker": ({"A.bas": "#If X Then\nPublic Const LIMIT = 2\n#End If\n", "B.bas": "Public Const LIMIT = 3\n", "Use.bas": "Sub Run()\nDebug.Print LIMIT\nEnd Sub\n"}, {"Run": []}, ["unresolved_constant", "unsupported_constant_declaration"]),
    "local blocker": ({"S.bas": "Public Const LIMIT = 1\n", "Use.bas": "Private Const LIMIT\nSub Run()\nDebug.Print LIMIT, Use.LIMIT\nEnd Sub\n"}, {"Run": []}, ["unresolved_constant"] * 2 + ["unsupported_constant_declaration"]),
    "inner": ({"A.bas": "Property Get Value() As Long\nConst LOC = 1\nEnd Property\nSub Run()\nConst INNER = 2\nDebug.Print INNER, LOC\nEnd Sub\n"}, {"Run": []}, []),
    "defaults": ({"A.bas": "Private Const LIMIT = 2\nPrivate Const FLAG = True\nSub Run(Optional ByVal Count As Long = LIMIT)\nConst LOC = FLAG\nEnd Sub\n"}, {"Run": ["LIMIT", "FLAG"]}, []),
    "twice": ({"A.bas": "Const LIMIT = 1\nConst LIMIT = 2\nSub Run()\nDebug.Print LIMIT\nEnd Sub\n"}, {"Run": []}, ["ambiguous_constant", "duplicate_constant"]),
    "same module": ({"a/S.bas": "Public Const LIMIT = 1\n", "b/S.bas": "Public Const OTHER = 2\n", "Use.bas": "Sub Run()\nDebug.Print S.LIMIT, OTHER\nEnd Sub\n"}, {"Run": []}, ["ambiguous_constant"] * 2),
    "numbers": ({"A.bas": "Const HFF = 2\nConst O77 = 3\nConst E3 = 4\nConst LIMIT = 5\nFunction Run(Optional Count As Long = LIMIT) As String()\nDebug.Print &HFF, &O77, 1E3\nEnd Function\n"}, {"Run": ["LIMIT"]}, []),
    "members": ({"S.bas": "Public Const LIMIT = 1\nPublic Const VALUE = 2\n", "Use.bas": "Private VALUE As Long\nPrivate Enum Choices\nLIMIT = 3\nEnd Enum\nSub Run()\nDebug.Print LIMIT, VALUE\nEnd Sub\n"}, {"Run": []}, []),
    "own module": ({"M.bas": "Public Const A = 1\nGlobal Const B = 2\nPrivate Const C = 3\nConst D = 4\nSub Own()\nDebug.Print A, B, C, M.D\nEnd Sub\n", "Use.bas": "Sub Run()\nDebug.Print A, B, C, D, M.A, M.B, M.C, M.D\nEnd Sub\n"}, {"Own": ["A", "B", "C", "D"], "Run": ["A", "B"]}, []),
    "nothing": ({"A.bas": None, "B.bas": ""}, {}, []),
}


@pytest.fixture(scope="module")
def found(spark):
    rows = [(scope, source_id, text, "vba", 0) for scope, (sources, _, _) in CASES.items() for source_id, text in sources.items()]
    sources = spark.createDataFrame(rows, "scope string, source_id string, content string, language string, kind int")
    functions, told = attach_constants(sources, analyze(sources).functions)
    return functions.collect(), told.collect()


@pytest.mark.parametrize("scope", CASES)
def test_rules(found, scope):
    functions, told = found
    _, constants, codes = CASES[scope]
    assert {f.name: [c.name for c in f.constants] for f in functions if f.scope == scope and f.name in constants} == constants
    assert sorted(d.code for d in told if d.scope == scope) == sorted(codes)


def test_declarations_keep_their_text(found):
    a, b = next(f for f in found[0] if f.scope == "wrapped").constants
    assert (a.expression, a.type_name, a.start_line, a.end_line, a.source) == ('"x,y:z"', "String", 1, 2, b.source) and "    B = 2\n" in b.source
    first = next(f for f in found[0] if f.scope == "direct")
    assert [(c.visibility, c.expression) for c in first.constants] == [("private", '"Order"'), ("public", "3"), ("private", "A+1")] and first.start_line == 6
    assert all(d.line == 2 and d.function_id == "vba:Use:Run" for d in found[1] if d.scope == "clash")


def test_no_rows(spark):
    empty = spark.createDataFrame([], "scope string, source_id string, content string, language string")
    functions, told = attach_constants(empty, analyze(empty).functions)
    assert functions.count() == 0 and told.agg(F.count("*")).first()[0] == 0
