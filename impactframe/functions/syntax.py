"""Source text to rows: procedures, calls, declarations and symbols of VBA, PL/SQL and Python.

These scans are sequential by nature and run once per distinct text; everything after them is relational.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator
from pathlib import PurePosixPath

from impactframe.functions.text import stripped_hash

_PLAIN_NAME = re.compile(r"[A-Za-z_]\w*")

# VBA

_VBA_OPEN = re.compile(r"\s*(?:(public|private|friend|static)\s+)?(?:sub|function)\s+([a-z_]\w*)\b", re.I)
_VBA_CLOSE = re.compile(r"\s*end\s+(?:sub|function)\b", re.I)
# Words that never name a called procedure.
VBA_CONTROL = frozenset(
    "call debug dim do end exit for function if let loop on option property select set sub while".split()
)
PLSQL_CONTROL = frozenset(
    """and as begin case close commit constant cursor declare delete else elsif end exception exit for function if in insert
    into is loop not null open or out package procedure raise return rollback select then true update values when while
    with""".split()
)


def vba_procedures(content: str) -> tuple[list[dict], int | None]:
    """Procedures in order, and the line of one left open at the end. Headers inside an open procedure are text."""
    lines = content.splitlines(keepends=True)
    done, head = [], None
    for no, line in enumerate(lines, 1):
        if head is None:
            m = _VBA_OPEN.match(line)
            head = (no, m) if m else None
        elif _VBA_CLOSE.match(line):
            first, m = head
            done.append(
                {
                    "name": m.group(2), "visibility": (m.group(1) or "public").casefold(), "start_line": first,
                    "end_line": no, "source": "".join(lines[first - 1 : no]),
                }
            )
            head = None
    return done, None if head is None else head[0]


def _significant(language: str, source: str) -> list[tuple[str, bool, int]]:
    """(value, is a name, line breaks before) of the tokens that are neither blanks, comments nor strings."""
    from pygments.lexers import get_lexer_by_name
    from pygments.token import Comment, Name, String, Text

    out, at, row = [], 0, 0
    for start, kind, value in get_lexer_by_name(language).get_tokens_unprocessed(source):
        row += source.count("\n", at, start)
        at = start
        if kind not in Text.Whitespace and kind not in Comment and kind not in String:
            out.append((value, kind in Name and bool(_PLAIN_NAME.fullmatch(value)), row))
    return out


def vba_calls(source: str, first_line: int) -> list[tuple[str, int, None]]:
    """(name, line, no qualifier) of likely calls: before `(`, after Call, or first on the line, and not assigned to."""
    rows = _significant("vb.net", source)
    seen: dict[tuple[str, int], tuple[str, int, None]] = {}
    for (name, named, row), before, after in zip(rows, [None, *rows], [*rows[1:], ("", False, -1)]):
        led = before if before and before[2] == row else None
        if not named or not row or name.casefold() in VBA_CONTROL or after[0] == "=" or (led and led[0] == "."):
            continue
        if after[0] == "(" or led is None or led[0].casefold() == "call":
            seen.setdefault((name.casefold(), row), (name, first_line + row, None))
    return list(seen.values())


# PL/SQL


class PlsqlText:
    """Tokens of one PL/SQL file with the end of every block, found in one pass."""

    def __init__(self, content: str):
        from pygments.lexers import get_lexer_by_name
        from pygments.token import Comment, Name, String, Text

        self.value: list[str] = []
        self.word: list[str] = []
        self.line: list[int] = []
        self.ident: list[str | None] = []
        line = 1
        for _, kind, value in get_lexer_by_name("sql").get_tokens_unprocessed(content):
            here, line = line, line + value.count("\n")
            symbol = kind in String.Symbol
            if kind in Text.Whitespace or kind in Comment or (kind in String and not symbol):
                continue
            name = None
            if kind in Name or symbol:
                quoted = len(value) > 1 and value[0] == value[-1] == '"'
                name = value[1:-1].replace('""', '"') if quoted else value
            self.value.append(value)
            self.word.append(value.casefold())
            self.line.append(here)
            self.ident.append(name)
        self.n = len(self.value)
        self.semicolon = [None] * (self.n + 1)  # at or after each token
        for i in range(self.n - 1, -1, -1):
            self.semicolon[i] = i if self.value[i] == ";" else self.semicolon[i + 1]
        self.block_end = self._block_ends()
        self._heads: dict[tuple[int, bool], tuple | None] = {}

    def _block_ends(self) -> dict[int, int | None]:
        """{opening token: the semicolon that ends its block}; an END takes everything up to its semicolon with it."""
        ends: dict[int, int | None] = {}
        open_: list[int] = []
        i = 0
        while i < self.n:
            if self.word[i] in ("begin", "case", "if", "loop"):
                open_.append(i)
            elif self.word[i] == "end":
                stop = self.semicolon[i + 1] if i + 1 <= self.n else None
                if stop is None:
                    break
                if open_:
                    ends[open_.pop()] = stop
                i = stop
            i += 1
        return ends

    def words_at(self, i: int, *words: str) -> bool:
        return self.word[i : i + len(words)] == list(words)

    def qualified(self, i: int) -> tuple[str | None, int]:
        """The last part of a name `a` or `a.b` at i, and the token after it."""
        if i >= self.n or self.ident[i] is None:
            return None, i
        if i + 2 < self.n and self.value[i + 1] == "." and self.ident[i + 2] is not None:
            return self.ident[i + 2], i + 3
        return self.ident[i], i + 1

    def after_create(self, i: int) -> int | None:
        """The token after CREATE [OR REPLACE] at i, or null."""
        if self.word[i] != "create":
            return None
        return i + 3 if self.words_at(i + 1, "or", "replace") else i + 1

    def package(self) -> tuple[str, bool, int] | None:
        """(name, is a body, token of its IS or AS) of the file's first package header."""
        for i in range(self.n):
            at = self.after_create(i)
            if at is None or not self.words_at(at, "package"):
                continue
            body = self.words_at(at + 1, "body")
            name, at = self.qualified(at + 1 + body)
            if name is None:
                continue
            while at < self.n and self.value[at] != ";":
                if self.word[at] in ("as", "is"):
                    return name, body, at
                at += 1
        return None

    def head(self, i: int, dotted: bool = False) -> tuple[str, str, int] | None:
        """(kind, name, token of `;`, IS, AS or BEGIN outside parentheses) of a subprogram header at i."""
        key = (i, dotted)
        if key not in self._heads:
            self._heads[key] = self._head(i, dotted)
        return self._heads[key]

    def _head(self, i: int, dotted: bool) -> tuple[str, str, int] | None:
        if self.word[i] not in ("procedure", "function"):
            return None
        if dotted:
            name, at = self.qualified(i + 1)
        else:
            name, at = (self.ident[i + 1] if i + 1 < self.n else None), i + 2
        depth = 0
        while name is not None and at < self.n:
            v = self.value[at]
            depth = depth + 1 if v == "(" else max(0, depth - 1) if v == ")" else depth
            if not depth and v != ")" and (v == ";" or self.word[at] in ("as", "is", "begin")):
                return self.word[i], name, at
            at += 1
        return None

    def subprogram_end(self, marker: int) -> int | None:
        """The token that ends the subprogram whose header ends at marker, nested subprograms included."""
        if self.word[marker] == "begin":
            return self.block_end.get(marker)
        i = marker + 1
        while i < self.n:
            w = self.word[i]
            if w == "begin":
                return self.block_end.get(i)
            if w == "language":
                return self.semicolon[i + 1]
            head = self.head(i) if w in ("procedure", "function") else None
            if head:
                last = head[2] if self.value[head[2]] == ";" else self.subprogram_end(head[2])
                if last is None:
                    return None
                i = last
            i += 1
        return None


def plsql_file(content: str, stem: str) -> dict:
    """{functions, declarations, diagnostics, spec} of one file; only its first package header decides what it is."""
    text = PlsqlText(content)
    lines = content.splitlines(keepends=True)
    out: dict = {"functions": [], "declarations": [], "diagnostics": [], "spec": False}
    found = text.package()
    if found and not found[1]:
        out["spec"] = True
        out["declarations"] = _spec_members(text, found)
    elif found:
        _members(text, lines, out, found[0], _body_starts(text, found[2] + 1))
    else:
        _members(text, lines, out, None, _standalone_starts(text), stem)
        if not out["functions"] and not out["diagnostics"]:
            message = "PL/SQL package or standalone procedure/function declaration was not found."
            out["diagnostics"].append(("parse_error", message, None))
    return out


def _spec_members(text: PlsqlText, found: tuple[str, bool, int]) -> list[tuple[str, str, int]]:
    """(package, member, line) declared in a specification, up to its END."""
    out, i = [], found[2] + 1
    while i < text.n and text.word[i] not in ("begin", "end"):
        head = text.head(i) if text.word[i] in ("procedure", "function") else None
        if head:
            out.append((found[0], head[1], text.line[i]))
            i = head[2]
        i += 1
    return out


def _body_starts(text: PlsqlText, i: int) -> Iterator[tuple[int, tuple, int]]:
    """(first token, header, token to go on from if it is left open); the consumer sends the end it found."""
    while i < text.n and text.word[i] != "begin":
        head = text.head(i) if text.word[i] in ("procedure", "function") else None
        if head and text.value[head[2]] == ";":
            i = head[2]
        elif head:
            end = yield i, head, i
            i = i if end is None else end
        i += 1


def _standalone_starts(text: PlsqlText) -> Iterator[tuple[int, tuple, int]]:
    i = 0
    while i < text.n:
        at = text.after_create(i)
        if at is not None and at < text.n and text.word[at] in ("procedure", "function"):
            head = text.head(at, dotted=True)
            end = None
            if head and text.value[head[2]] != ";":
                end = yield i, head, at
            i = at if end is None else end
        i += 1


def _members(text: PlsqlText, lines: list[str], out: dict, package: str | None, starts: Iterator, stem: str = "") -> None:
    try:
        first, head, at = next(starts)
        while True:
            kind, name, marker = head
            end = text.subprogram_end(marker)
            label = "package" if package is not None else "standalone"
            if end is None:
                message = f"PL/SQL {label} member {name!r} has no matching END."
                out["diagnostics"].append(("unterminated_procedure", message, text.line[first]))
            else:
                module = package
                if package is None:
                    dotted = at + 3 < text.n and text.value[at + 2] == "." and text.ident[at + 3] is not None
                    module = text.ident[at + 1] if dotted and text.ident[at + 1] is not None else stem
                a, b = text.line[first], text.line[end]
                out["functions"].append(
                    {
                        "name": name, "module": module, "kind": kind, "body": package is not None, "start_line": a,
                        "end_line": b, "source": "".join(lines[a - 1 : b]),
                    }
                )
            first, head, at = starts.send(end)
    except StopIteration:
        return


def plsql_calls(source: str, first_line: int) -> list[tuple[str, int, str | None]]:
    """(name as written, line, qualifier): names before `(` or `;`, or after call/execute; `a.b` is one call."""
    rows = _significant("sql", source)
    end = ("", False, -1)
    seen: dict[tuple[str, int], tuple[str, int, str | None]] = {}
    for i, (name, named, row) in enumerate(rows):
        if not named or name.casefold() in PLSQL_CONTROL:
            continue
        before = rows[i - 1][0] if i and rows[i - 1][2] == row else ""
        after = rows[i + 1] if i + 1 < len(rows) else end
        if before in (".", "END", "end"):
            continue
        shown, owner = name, None
        if after[0] == "." and i + 2 < len(rows) and rows[i + 2][1]:
            shown, owner = f"{name}.{rows[i + 2][0]}", name
            after = rows[i + 3] if i + 3 < len(rows) else end
        called = after[0] in ("(", ";") or before.casefold() in ("call", "execute")
        if called and row:
            seen.setdefault((shown.casefold(), row), (shown, first_line + row, owner))
    return list(seen.values())


# Python


def python_symbols(text: str) -> list[dict]:
    """Classes, functions and methods in source order with qualified names; nothing where the text does not parse."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError):
        return []
    lines = text.splitlines()
    out: list[dict] = []

    def visit(node: ast.AST, owners: tuple[str, ...], in_class: bool) -> None:
        for child in getattr(node, "body", []):
            is_class = isinstance(child, ast.ClassDef)
            if not is_class and not isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef)):
                continue
            first = min([d.lineno for d in child.decorator_list], default=child.lineno)
            content = "\n".join(lines[first - 1 : child.end_lineno])
            out.append(
                {
                    "name": ".".join((*owners, child.name)),
                    "symbol_type": "class" if is_class else "method" if in_class else "function",
                    "declaration": "\n".join(lines[first - 1 : child.body[0].lineno - 1]).rstrip(),
                    "content": content, "body_hash": stripped_hash(content), "start_line": child.lineno,
                    "end_line": child.end_lineno, "nested": bool(owners) and not in_class,
                }
            )
            visit(child, (*owners, child.name), is_class)

    visit(tree, (), False)
    return out


def stem_of(path: str) -> str:
    return PurePosixPath(path).stem
