"""Token streams of PL/SQL, VBA and Python 3 for the derivative parser.

A stream is a list of (kind, line). Kinds are keywords in upper case (Python's in their own), operators, and classes
such as ID or STRING. What cannot be a token becomes BAD; what the end of the text leaves open becomes OPEN.
"""

from __future__ import annotations

import io
import keyword
import re
import token as pytoken
import tokenize
import unicodedata

# Words that stand for themselves in the grammars.
PLSQL_WORDS = frozenset(
    """ALL AND ANY AS ASC AUTHID BEGIN BETWEEN BODY BULK BY CASE CLOSE COLLECT COMMIT CONNECT CONSTANT CONTINUE CREATE CROSS
    CURRENT CURSOR DECLARE DEFAULT DELETE DESC DETERMINISTIC DISTINCT EDITIONABLE ELSE ELSIF END ESCAPE EXCEPTION EXECUTE
    EXISTS EXIT FETCH FOR FORALL FROM FULL FUNCTION GOTO GROUP HAVING IF IMMEDIATE IN INDEX INNER INSERT INTERSECT INTO IS
    JOIN LANGUAGE LEFT LIKE LOCK LOOP MERGE MINUS NATURAL NOCOPY NONEDITIONABLE NOT NULL NULLS OF ON OPEN OR ORDER OUT OUTER
    OVER PACKAGE PARTITION PIPE PIPELINED PRAGMA PRIOR PROCEDURE RAISE RANGE RECORD REF REPLACE RETURN RETURNING REVERSE
    RIGHT ROLLBACK ROW SAVEPOINT SELECT SET START SUBTYPE TABLE THEN TO TRIGGER TYPE UNION UNIQUE UPDATE USING VALUES VARRAY
    VIEW WHEN WHERE WHILE WITH WITHIN BEFORE AFTER INSTEAD EACH LIMIT BODY RESULT_CACHE PARALLEL_ENABLE ACCESSIBLE GRANT
    DROP ALTER COMMENT TRUNCATE MOD MULTISET MEMBER""".split()
)
VBA_WORDS = frozenset(
    """ADDRESSOF ALIAS AND ANY APPEND AS ATTRIBUTE BASE BEGIN BINARY BYREF BYVAL CALL CASE CLASS CLOSE COMPARE CONST DATABASE
    DECLARE DIM DO EACH ELSE ELSEIF END ENUM EQV ERASE ERROR EVENT EXIT EXPLICIT FOR FRIEND FUNCTION GET GLOBAL GOSUB GOTO IF
    IMP IMPLEMENTS IN INPUT IS LET LIB LIKE LINE LOCK LOOP LSET ME MOD MODULE MULTIUSE NAME NEW NEXT NOT NOTHING ON OPEN
    OPTION OPTIONAL OR OUTPUT PARAMARRAY PRESERVE PRINT PRIVATE PROPERTY PTRSAFE PUBLIC PUT RAISEEVENT RANDOM REDIM RESUME
    RETURN RSET SEEK SELECT SET SHARED STATIC STEP STOP SUB TEXT THEN TO TYPE TYPEOF UNLOCK UNTIL VERSION WEND WHILE WITH
    WITHEVENTS WRITE XOR ACCESS READ""".split()
)

_PLSQL = re.compile(
    r"""(?P<space>\s+)|(?P<comment>--[^\n]*|/\*.*?\*/)|(?P<open>/\*)
    |(?P<quote>[nN]?[qQ]'(?:\[.*?\]'|\(.*?\)'|\{.*?\}'|<.*?>'|(?P<d>[^\s\[({<])(?:.*?)(?P=d)'))
    |(?P<openq>[nN]?[qQ]')
    |(?P<string>[nN]?'(?:[^']|'')*')|(?P<opens>[nN]?')
    |(?P<name>[^\W\d][\w$#]*|"[^"\n]+")
    |(?P<number>(?:\d+(?:\.(?!\.)\d*)?|\.\d+)(?:[eE][+-]?\d+)?[fFdD]?\b|\d+)
    |(?P<op>:=|=>|\.\.|\*\*|\|\||<>|!=|\^=|~=|<=|>=|<<|>>|[-+*/(),;.@%:=<>?$])
    |(?P<bad>.)""",
    re.X | re.S,
)
_VBA = re.compile(
    r"""(?P<space>[ \t\f\v 　]+(?:_[ \t]*\n)?)|(?P<nl>\n)|(?P<comment>'[^\n]*)
    |(?P<string>"(?:[^"\n]|"")*")|(?P<opens>")
    |(?P<date>\#[ \t]*(?:\d[\d/:\-. \t]*(?:[aApP][mM])?|[A-Za-z]{3,9}[ \t]+\d[\w ,:/]*)\#)
    |(?P<number>&[hH][0-9A-Fa-f]+[&%^]?|&[oO]?[0-7]+[&%^]?|(?:\d+(?:\.\d*)?|\.\d+)(?:[eEdD][+-]?\d+)?[%&!\#@^]?)
    |(?P<name>[^\W\d]\w*[%!@$]?(?!\w)|[^\W\d]\w*|\[[^\]\n]+\])
    |(?P<op>:=|<>|<=|>=|=<|=>|[-+*/\\^&=<>(),.;:!\#?{}])
    |(?P<bad>.)""",
    re.X,
)
_OPEN = {"open", "openq", "opens"}


def plain_lines(text: str) -> str:
    return text.removeprefix("﻿").replace("\r\n", "\n").replace("\r", "\n")


def plsql_tokens(text: str) -> list[tuple[str, int]]:
    """A slash alone on its line is SLASH; comments are left out."""
    out, line = [], 1
    at = 0
    for m in _PLSQL.finditer(text):
        kind, value = m.lastgroup, m.group()
        if kind == "d":
            kind = "quote"
        if kind == "name":
            upper = value.upper()
            out.append((upper if upper in PLSQL_WORDS else "ID", line))
        elif kind == "op":
            if value == "/":
                at = m.start()
                begin, end = text.rfind("\n", 0, at) + 1, text.find("\n", at)
                alone = text[begin : len(text) if end < 0 else end].strip() == "/"
                value = "SLASH" if alone else value
            out.append((value, line))
        elif kind == "number":
            out.append(("NUMBER", line))
        elif kind in ("string", "quote"):
            out.append(("STRING", line))
        elif kind in _OPEN:
            return [*out, ("OPEN", line)]
        elif kind == "bad":
            return [*out, ("BAD", line)]
        line += value.count("\n")
    return out


def vba_tokens(text: str) -> list[tuple[str, int]]:
    """Line ends are NL; a word after a dot or bang, or before `:=`, is a name; `Rem` at a statement's start is a comment."""
    out: list[tuple[str, int]] = []
    line, at, n = 1, 0, len(text)
    match = _VBA.match
    while at < n:
        m = match(text, at)
        kind, value = m.lastgroup, m.group()
        at = m.end()
        if kind == "name":
            upper = value.upper()
            before = out[-1][0] if out else "NL"
            if upper == "REM" and before in ("NL", ":", "THEN", "ELSE"):
                end = text.find("\n", at)
                at = n if end < 0 else end
            elif upper in VBA_WORDS and before not in (".", "!") and not text.startswith(":=", at):
                out.append((upper, line))
            else:
                out.append(("ID", line))
        elif kind == "op":
            out.append((value, line))
        elif kind == "nl":
            out.append(("NL", line))
        elif kind in ("string", "number", "date"):
            out.append(("STRING" if kind == "string" else "NUMBER", line))
        elif kind == "opens":
            return [*out, ("OPEN" if "\n" not in text[at:] else "BAD", line)]
        elif kind == "bad":
            return [*out, ("BAD", line)]
        line += value.count("\n")
    return [*out, ("NL", line)]


_SOFT = ("match", "case", "type", "_")
_PY_CLASS = {pytoken.NEWLINE: "NEWLINE", pytoken.INDENT: "INDENT", pytoken.DEDENT: "DEDENT", pytoken.ENDMARKER: "ENDMARKER"}
_PY_CLASS |= {pytoken.FSTRING_START: "FSTART", pytoken.FSTRING_MIDDLE: "FMIDDLE", pytoken.FSTRING_END: "FEND"}
_ESCAPE = re.compile(r"\\(?:(x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U(?:000[0-9a-fA-F]|0010)[0-9a-fA-F]{4}|N\{([^}]+)\}|[^xuUN])|.?)", re.S)
_OCTAL = re.compile(r"0[\d_]*[1-9][\d_]*")  # no number of Python 3
_BYTE_ESCAPE = re.compile(r"\\(?:(x[0-9a-fA-F]{2}|[^x])|.?)", re.S)


def _literal(text: str) -> str:
    """STRING or BYTES, or BAD where its content cannot be: foreign characters in bytes, escapes that are not complete."""
    quote = min(i for i in (text.find("'"), text.find('"')) if i >= 0)
    prefix = text[:quote].lower()
    kind = "BYTES" if "b" in prefix else "STRING"
    if kind == "BYTES" and not text.isascii():
        return "BAD"
    return kind if "r" in prefix or _escapes_complete(text, kind == "BYTES") else "BAD"


def _escapes_complete(text: str, of_bytes: bool = False) -> bool:
    if "\\" not in text:
        return True
    for m in (_BYTE_ESCAPE if of_bytes else _ESCAPE).finditer(text):
        if m.group(1) is None and m.group() != "\\":  # a backslash may come last before a field of an f-string
            return False
        if not of_bytes and m.group(2):
            try:
                unicodedata.lookup(m.group(2))
            except KeyError:
                return False
    return True


def python_tokens(text: str) -> list[tuple[str, int]]:
    """By the tokens of Python's own lexer, so its bounds hold: 200 open brackets, 100 levels of indentation."""
    out: list[tuple[str, int]] = []
    raw: list[bool] = []  # of each open f-string
    after: tuple[int, int] | None = None  # where the last operator ended
    try:
        for t in tokenize.generate_tokens(io.StringIO(text).readline):
            kind = t.type
            if kind == pytoken.NAME:
                value = t.string
                if out and out[-1][0] == "!":
                    out.append(("CONVERSION" if value in ("s", "r", "a") and after == t.start else "BAD", t.start[0]))
                else:
                    word = keyword.iskeyword(value) or value in _SOFT
                    out.append((value if word else "NAME" if value.isidentifier() else "BAD", t.start[0]))
            elif kind == pytoken.OP:
                out.append((t.string, t.start[0]))
                after = t.end
            elif kind == pytoken.NUMBER:
                kind = "BAD" if _OCTAL.fullmatch(t.string) else "IMAGINARY" if t.string[-1] in "jJ" else "NUMBER"
                out.append((kind, t.start[0]))
            elif kind == pytoken.STRING:
                out.append((_literal(t.string), t.start[0]))
            elif kind in _PY_CLASS:
                if kind == pytoken.FSTRING_START:
                    raw.append("r" in t.string.lower())
                elif kind == pytoken.FSTRING_END:
                    raw.pop()
                fine = kind != pytoken.FSTRING_MIDDLE or raw[-1] or _escapes_complete(t.string)
                out.append((_PY_CLASS[kind] if fine else "BAD", t.start[0]))
            elif kind == pytoken.ERRORTOKEN:
                return [*out, ("BAD", t.start[0])]
    except tokenize.TokenError as error:
        line = error.args[1][0] if len(error.args) > 1 and error.args[1] else 0
        return [*out, ("OPEN" if "EOF" in str(error.args[0]) or "unterminated triple" in str(error.args[0]) else "BAD", line)]
    except (SyntaxError, ValueError) as error:
        return [*out, ("BAD", getattr(error, "lineno", 0) or 0)]
    return out
