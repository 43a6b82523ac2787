"""Names in VBA text: constants and other names that a module declares, and what a procedure's statements use.

A text is cut into tokens once, continuation lines and comments resolved on the way; statements are runs of tokens, and
everything else reads tokens.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"
_SCAN = re.compile(
    rf"""(?P<wrap>(?<=\s)_[ \t]*(?:{_BREAK}))|(?P<line>{_BREAK})|(?P<blank>\s+)|(?P<note>'[^\r\n]*)
    |(?P<text>"(?:[^"\r\n]|"")*"|\#[^\#\r\n]*\#)
    |(?P<number>&[Hh][0-9A-Fa-f]+&?|&[Oo][0-7]+&?|(?:\d+(?:\.\d*)?|\.\d+)(?:[EeDd][+-]?\d+)?[%&!\#@]?)
    |(?P<name>[A-Za-z_]\w*(?:[$%&!\#@](?![A-Za-z_]))?)|(?P<sign>.)""",
    re.X,
)
_JOINT = re.compile(rf"_[ \t]*(?:{_BREAK})")

# Words before a procedure, before a declared name, and before names that are no values.
SCOPES = frozenset(("public", "private", "friend", "static"))
PASSING = frozenset(("optional", "byval", "byref", "paramarray", "withevents"))
NOT_VALUES = frozenset(("as", "new", "goto", "gosub", "resume"))


class Token(NamedTuple):
    text: str
    word: str  # in lower case; of a name without its type sign
    named: bool
    start: int
    end: int


class Statement(NamedTuple):
    tokens: list[Token]
    line: int
    last_line: int
    label: bool

    def words(self, count: int = 3) -> list[str]:
        return [t.word for t in self.tokens[:count]]


def statements(text: str) -> Iterator[Statement]:
    """Statements in order; a name alone before a colon is a label."""
    tokens: list[Token] = []
    line = first = 1
    at = 0
    while at < len(text):
        m = _SCAN.match(text, at)
        kind, at = m.lastgroup, m.end()
        if kind == "name" and not tokens and m.group().lower() == "rem":
            kind, at = "note", next((x.start() for x in re.finditer(_BREAK, text[at:])), len(text) - at) + at
        if kind in ("line", "wrap"):
            if kind == "line":
                if tokens:
                    yield Statement(tokens, first, line, False)
                tokens = []
            line += 1
        elif kind == "sign" and m.group() == ":" and text[at : at + 1] != "=":
            if tokens:
                yield Statement(tokens, first, line, len(tokens) == 1 and tokens[0].named)
            tokens = []
        elif kind not in ("blank", "note"):
            if not tokens:
                first = line
            named = kind == "name"
            word = m.group().lower()
            tokens.append(Token(m.group(), word.rstrip("$%&!#@") if named else word, named, m.start(), m.end()))
    if tokens:
        yield Statement(tokens, first, line, False)


def shares(tokens: list[Token]) -> list[list[Token]]:
    """The tokens between commas outside parentheses."""
    out: list[list[Token]] = [[]]
    depth = 0
    for t in tokens:
        depth += (t.text == "(") - (t.text == ")")
        if t.text == "," and not depth:
            out.append([])
        else:
            out[-1].append(t)
    return out


def declared(tokens: list[Token]) -> Iterator[str]:
    """The name that each share of a list declares."""
    for part in shares(tokens):
        name = next((t for t in part if t.word not in PASSING), None)
        if name is not None and name.named:
            yield name.word


def values(tokens: list[Token]) -> list[Token]:
    """What stands after the first equals sign of each share, commas between."""
    out: list[Token] = []
    for part in shares(tokens):
        at = next((i for i, t in enumerate(part) if t.text == "="), None)
        if at is not None:
            out += [Token(",", ",", False, 0, 0)] * bool(out) + part[at + 1 :]
    return out


def _opens(s: Statement) -> int | None:
    """Where the name of a procedure stands whose header this is."""
    w = s.words(4)
    at = 1 if w and w[0] in SCOPES else 0
    if w[at : at + 1] in (["sub"], ["function"]):
        return at + 1
    return at + 2 if w[at : at + 1] == ["property"] and w[at + 1 : at + 2] in (["get"], ["let"], ["set"]) else None


def _closes(s: Statement) -> bool:
    w = s.words(2)
    return len(w) == 2 and w[0] == "end" and w[1] in ("sub", "function", "property")


def module_names(text: str) -> Iterator[dict]:
    """Rows of what a module declares outside procedures.

    kind `shadow`: name_cf of a procedure, type, enumeration and its members, or variable. kind `constant`: also name,
    visibility, type_name, expression, start_line, end_line, source. kind `blocker`: a constant whose declaration cannot be
    used. kind `problem`: line and message.
    """
    lines = re.findall(rf"[^\n\r\x0b\x0c\x1c-\x1e\x85  ]*(?:{_BREAK})|[^\n\r\x0b\x0c\x1c-\x1e\x85  ]+$", text)
    inside = listing = False
    conditional = 0
    for s in statements(text):
        w = s.words(4)
        if w[0] == "#":
            conditional = conditional + 1 if w[1:2] == ["if"] else max(0, conditional - (w[1:3] == ["end", "if"]))
        name = _opens(s)
        if name is not None:
            inside = True
            if name < len(s.tokens) and s.tokens[name].named:
                yield {"kind": "shadow", "name_cf": s.tokens[name].word}
        if _closes(s):
            inside = False
        elif inside:
            pass
        elif (at := int(w[0] in ("public", "private"))) < len(w) and w[at] in ("enum", "type") and len(s.tokens) > at + 1 and s.tokens[at + 1].named:
            listing = w[at] == "enum"
            yield {"kind": "shadow", "name_cf": s.tokens[at + 1].word}
        elif w[:2] == ["end", "enum"]:
            listing = False
        elif listing:
            yield from ({"kind": "shadow", "name_cf": n} for n in declared(s.tokens))
        elif w[(at := int(w[0] in ("public", "private", "global"))) : at + 1] == ["const"]:
            yield from _constants(s, s.tokens[at + 1 :], "public" if w[0] in ("public", "global") else "private", conditional > 0, text, lines)
        elif w[0] in ("public", "private", "global", "dim"):
            yield from ({"kind": "shadow", "name_cf": n} for n in declared(s.tokens[1:]))


def _constants(s: Statement, tokens: list[Token], visibility: str, conditional: bool, text: str, lines: list[str]) -> Iterator[dict]:
    if conditional:
        yield {"kind": "problem", "line": s.line, "message": "Conditional VBA Const declarations cannot be resolved reliably."}
        yield from ({"kind": "blocker", "name_cf": n, "visibility": visibility} for n in declared(tokens))
        return
    written = lambda part: _JOINT.sub(" ", text[part[0].start : part[-1].end]) if part else ""
    for part in shares(tokens):
        equals = next((i for i, t in enumerate(part) if t.text == "="), None)
        typed = part[1:equals]
        fits = equals is not None and len(part) > equals + 1 and part[0].named
        if fits and typed:
            fits = typed[0].word == "as" and len(typed) % 2 == 0 and all(t.named if i % 2 else t.text == "." for i, t in enumerate(typed[1:], 1))
        if not fits:
            yield {"kind": "problem", "line": s.line, "message": f"Cannot parse VBA Const declaration: {written(part)}."}
            yield from ({"kind": "blocker", "name_cf": n, "visibility": visibility} for n in declared(part))
            continue
        yield {
            "kind": "constant", "name": part[0].text.rstrip("$%&!#@"), "name_cf": part[0].word, "visibility": visibility,
            "type_name": written(typed[1:]) or None, "expression": written(part[equals + 1 :]), "start_line": s.line,
            "end_line": s.last_line, "source": "".join(lines[s.line - 1 : s.last_line]),
        }


def procedure_names(source: str, name: str) -> Iterator[dict]:
    """Rows of a procedure's text: kind `local` (name_cf) for its own, its parameters' and its variables' names, kind `use`
    (name, name_cf, qualifier_cf, line) for names that may stand for constants; lines count from 1."""
    yield {"kind": "local", "name_cf": name.lower()}
    for no, s in enumerate(statements(source)):
        tokens = s.tokens
        if no == 0:
            tokens = _parameters(tokens)
            yield from ({"kind": "local", "name_cf": n} for n in declared(tokens))
            tokens = values(tokens)
        elif _closes(s) or s.label:
            continue
        else:
            w = s.words(2)
            at = int(w[0] in ("public", "private", "global"))
            if w[at : at + 1] in (["dim"], ["static"], ["const"]) and len(tokens) > at + 1:
                yield from ({"kind": "local", "name_cf": n} for n in declared(tokens[at + 1 :]))
                tokens = values(tokens[at + 1 :])
        texts = [t.text for t in tokens]
        for i, t in enumerate(tokens):
            before = texts[i - 1] if i else ""
            if not t.named or texts[i + 1 : i + 2] in (["."], [":"]) or before.lower() in NOT_VALUES or before == "!":
                continue
            row = {"kind": "use", "name": t.text, "name_cf": t.word, "line": s.line}
            if before != ".":
                yield row
            elif i >= 2 and texts[i - 3 : i - 2] not in (["."], ["!"]):
                yield row | {"qualifier_cf": texts[i - 2].lower()}


def _parameters(tokens: list[Token]) -> list[Token]:
    """The tokens inside the first parentheses of a header; none where they do not close."""
    depth, begin = 0, None
    for i, t in enumerate(tokens):
        if t.text == "(":
            begin = i + 1 if begin is None else begin
            depth += 1
        elif t.text == ")" and begin is not None:
            depth -= 1
            if not depth:
                return tokens[begin:i]
    return []
