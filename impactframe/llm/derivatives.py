"""Memoised parsing with derivatives.

A grammar is a set of rules over token kinds. The derivative of a grammar by a token is the grammar of what may follow
it. An empty derivative marks the token at which a file ceases to be valid; an end derivative that does not accept the
empty sequence marks a truncated file.

Derivatives are kept in one form: alternatives of *cells* (an item of the rules, then whatever may follow it). Cells are
hash-consed, and cells of one item are merged into one whose rest is the union of their rests, so there are never more
alternatives than items, however deep a file nests and however many readings it has. Derivatives are memoised by (node,
token), so files of one language share nearly all of the work. Nothing recurses over the input: depth costs no stack.

Rules are written as `name: alternative | alternative ;` with `( )`, `?`, `*`, `+`, `'literal'` and token kinds in
capitals. No rule may begin with itself; repetition takes the place of left recursion.
"""

from __future__ import annotations

import re

#: Nodes of derivatives: nothing but the empty sequence, and nothing at all.
END, EMPTY = 0, 1
#: Unions merge the rests of equal items down to this depth; below it they stay side by side, which means the same.
MERGED = 40
_META = re.compile(r"\s*(?:#[^\n]*\n\s*)*('(?:[^'\\]|\\.)+'|[A-Za-z_]\w*|[:;|()?*+])")


class Grammar:
    """The items of one grammar, the nodes of its derivatives and their memo."""

    def __init__(self, rules: str, start: str, most_nodes: int = 1_500_000):
        self.most_nodes = most_nodes
        self.kinds: dict[str, int] = {}
        self._read(rules)
        self.start_item = self.refs[start]
        self.reset()

    def reset(self) -> None:
        """Forget every derivative; called between files when the memo outgrows its bound."""
        self.item_of: list[int] = [-1, -2]
        self.rest_of: list = [END, ()]
        self.ends = [True, False]
        self.cells: dict[tuple[int, int], int] = {}
        self.unions: dict[frozenset, int] = {}
        self.memo: dict[tuple[int, int], int] = {}
        self.start = self._cell(self.start_item, END)

    # rules text -> trees -> items

    def _read(self, rules: str) -> None:
        self.op: list[str] = []
        self.args: list[tuple] = []
        self.nullable: list[bool] = []
        self.first: list[frozenset] = []
        self.known: dict[tuple, int] = {}
        self.steps: dict[tuple[int, int], tuple] = {}
        trees = self._parse_rules(rules)
        self.refs = {name: self._item("ref", (name,), False, frozenset()) for name in trees}
        changed = True
        while changed:  # nullable and first of the rules, to their least fixed point
            changed = False
            for name, tree in trees.items():
                facts, ref = self._facts(tree), self.refs[name]
                if facts != (self.nullable[ref], self.first[ref]):
                    self.nullable[ref], self.first[ref] = facts
                    changed = True
        self.bodies = {self.refs[name]: self._build(tree) for name, tree in trees.items()}

    def _parse_rules(self, text: str) -> dict:
        tokens = _META.findall(text)
        self.at, self.tokens = 0, tokens
        rules = {}
        while self.at < len(tokens):
            name = tokens[self.at]
            if tokens[self.at + 1] != ":":
                raise ValueError(f"rule {name}: ':' expected")
            self.at += 2
            rules[name] = self._alternatives()
            if self.at >= len(tokens) or tokens[self.at] != ";":
                raise ValueError(f"rule {name}: ';' expected")
            self.at += 1
        return rules

    def _alternatives(self):
        options = [self._sequence()]
        while self.at < len(self.tokens) and self.tokens[self.at] == "|":
            self.at += 1
            options.append(self._sequence())
        return options[0] if len(options) == 1 else ("alt", options)

    def _sequence(self):
        parts = []
        while self.at < len(self.tokens) and self.tokens[self.at] not in "|;)":
            token = self.tokens[self.at]
            self.at += 1
            if token == "(":
                part = self._alternatives()
                self.at += 1  # the closing parenthesis
            elif token[0] == "'":
                part = ("tok", token[1:-1].replace("\\'", "'").replace("\\\\", "\\"))
            elif token.isupper():
                part = ("tok", token)
            else:
                part = ("ref", token)
            while self.at < len(self.tokens) and self.tokens[self.at] in ("?", "*", "+"):
                part = ({"?": "opt", "*": "star", "+": "plus"}[self.tokens[self.at]], part)
                self.at += 1
            parts.append(part)
        return parts[0] if len(parts) == 1 else ("seq", parts)

    def _facts(self, tree) -> tuple[bool, frozenset]:
        op = tree[0]
        if op == "tok":
            return False, frozenset([self.code(tree[1])])
        if op == "ref":
            ref = self.refs[tree[1]]
            return self.nullable[ref], self.first[ref]
        if op == "alt":
            facts = [self._facts(x) for x in tree[1]]
            return any(n for n, _ in facts), frozenset().union(*(f for _, f in facts))
        if op == "seq":
            first: frozenset = frozenset()
            for part in tree[1]:
                null, own = self._facts(part)
                first |= own
                if not null:
                    return False, first
            return True, first
        null, first = self._facts(tree[1])
        return (null if op == "plus" else True), first

    def _build(self, tree) -> int:
        op = tree[0]
        if op == "ref":
            return self.refs[tree[1]]
        null, first = self._facts(tree)
        if op == "tok":
            return self._item("tok", (self.code(tree[1]),), null, first)
        if op in ("alt", "seq"):
            return self._item(op, tuple(self._build(x) for x in tree[1]), null, first)
        inner = self._build(tree[1])
        if op == "opt":
            return self._item("opt", (inner,), null, first)
        star = self._item("star", (inner,), True, first)
        return star if op == "star" else self._item("seq", (inner, star), null, first)

    def code(self, kind: str) -> int:
        return self.kinds.setdefault(kind, len(self.kinds) + 1)

    def _item(self, op: str, args: tuple, nullable: bool, first: frozenset) -> int:
        item = self.known.get((op, args))
        if item is None:
            item = self.known[op, args] = len(self.op)
            self.op.append(op)
            self.args.append(args)
            self.nullable.append(nullable)
            self.first.append(first)
        return item

    def _steps(self, item: int, code: int) -> tuple[tuple[int, ...], ...]:
        """The derivative of an item: the sequences of items that may follow the token. As deep as the rules at most."""
        if code not in self.first[item]:
            return ()
        found = self.steps.get((item, code))
        if found is None:
            op, args = self.op[item], self.args[item]
            if op == "tok":
                found = ((),)
            elif op == "ref":
                found = self._steps(self.bodies[item], code)
            elif op == "star":
                found = tuple((*s, item) for s in self._steps(args[0], code))
            elif op == "seq":
                out: list[tuple[int, ...]] = []
                for k, part in enumerate(args):
                    out += [(*s, *args[k + 1 :]) for s in self._steps(part, code)]
                    if not self.nullable[part]:
                        break
                found = tuple(dict.fromkeys(out))
            else:  # alt, opt
                found = tuple(dict.fromkeys(s for x in args for s in self._steps(x, code)))
            self.steps[item, code] = found
        return found

    # nodes of derivatives

    def _cell(self, item: int, rest: int) -> int:
        """The item followed by the rest."""
        if self.op[item] == "seq":
            for part in reversed(self.args[item]):
                rest = self._cell(part, rest)
            return rest
        node = self.cells.get((item, rest))
        if node is None:
            node = self.cells[item, rest] = len(self.item_of)
            self.item_of.append(item)
            self.rest_of.append(rest)
            self.ends.append(self.nullable[item] and self.ends[rest])
        return node

    def _union(self, nodes, depth: int = 0) -> int:
        """Any of the nodes; cells of one item become one cell."""
        flat: set[int] = set()
        for node in nodes:
            if self.item_of[node] == -2:
                flat.update(self.rest_of[node])
            else:
                flat.add(node)
        if len(flat) > 1 and depth < MERGED:
            by_item: dict[int, list[int]] = {}
            for node in flat:
                by_item.setdefault(self.item_of[node], []).append(node)
            if len(by_item) < len(flat):
                flat = {
                    cells[0] if len(cells) == 1 else self._cell(item, self._union([self.rest_of[c] for c in cells], depth + 1))
                    for item, cells in by_item.items()
                }
        if len(flat) < 2:
            return next(iter(flat), EMPTY)
        key = frozenset(flat)
        node = self.unions.get(key)
        if node is None:
            node = self.unions[key] = len(self.item_of)
            self.item_of.append(-2)
            self.rest_of.append(key)
            self.ends.append(any(self.ends[x] for x in key))
        return node

    def derive(self, node: int, code: int) -> int:
        out = self.memo.get((node, code))
        if out is not None:
            return out
        found: set[int] = set()
        todo, seen = [node], {node}
        while todo:
            at = todo.pop()
            item, rest = self.item_of[at], self.rest_of[at]
            if item >= 0:
                for step in self._steps(item, code):
                    follow = rest
                    for part in reversed(step):
                        follow = self._cell(part, follow)
                    found.add(follow)
                more = (rest,) if self.nullable[item] else ()
            else:
                more = rest if item == -2 else ()
            for x in more:
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        out = self.memo[node, code] = self._union(found)
        return out

    # use

    def parse(self, kinds: list[str]) -> tuple[str, int]:
        """('valid', n), ('token', index of the failing token) or ('truncated', n) for a sequence of token kinds."""
        if len(self.item_of) > self.most_nodes:
            self.reset()
        node, memo, codes = self.start, self.memo, self.kinds
        for at, kind in enumerate(kinds):
            code = codes.get(kind, 0)
            following = memo.get((node, code))
            if following is None:
                following = self.derive(node, code)
            if following == EMPTY:
                return "token", at
            node = following
        return ("valid" if self.ends[node] else "truncated"), len(kinds)
