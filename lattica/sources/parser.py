"""A tolerant parser: declarations, and what function bodies call, read and write.

It reads declarations as islands. What it cannot read it skips, to the ``;`` or the
matching ``}`` of the level it is on, and marks the file as recovered; it never
refuses a text. Expressions are read by precedence.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import xxhash

from ..functions.text import node_id, normalise_type_name
from ..functions.version import support_of
from ..schema import FLAGS
from .lexer import Positions, Token, tokenize

PARSER_VERSION = 1
MAX_DIAGNOSTICS = 50
_ELEMENTARY = re.compile(r"^(address|bool|string|bytes\d*|u?int\d*|fixed\w*|ufixed\w*|var)$")
_VISIBILITY, _MUTABILITY, _LOCATION = {"public", "external", "internal", "private"}, {"pure", "view", "payable", "constant"}, {"memory", "storage", "calldata"}
_NO_TYPE = {"delete", "new", "return", "emit", "revert", "throw", "this", "super", "else"}
_CONTRACTS = {"contract", "interface", "library", "abstract"}
# Yul builtins that set a flag.
_YUL = {"delegatecall": "hasDelegatecall", "call": "hasLowLevelCall", "callcode": "hasLowLevelCall", "staticcall": "hasLowLevelCall", "selfdestruct": "hasSelfdestruct", "create": "hasCreate",
        "create2": "hasCreate", "sstore": "writesState", "tstore": "writesState", "sload": "readsState", "tload": "readsState"}
# Binary operators by precedence.
_BINARY = {op: p for p, ops in enumerate(("||", "&&", "== !=", "< > <= >=", "|", "^", "&", "<< >> >>>", "+ -", "* / %", "**"), 3) for op in ops.split()}
_ASSIGN = {"=", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "<<=", ">>=", ">>>="}


class Lost(Exception):
    """The parser does not know what it reads."""


@dataclass
class Body:
    calls: list[dict] = field(default_factory=list)
    uses: list[dict] = field(default_factory=list)
    refs: list[dict] = field(default_factory=list)
    locals: list[dict] = field(default_factory=list)
    flags: dict[str, bool] = field(default_factory=lambda: dict.fromkeys(FLAGS, False))
    cyclomatic: int = 1
    depth: int = 0


class Reader:
    """A cursor over tokens."""

    def __init__(self, text: str, file: str):
        self.text, self.file = text, file
        self.at = Positions(text)
        self.tokens, self.docs = tokenize(text)
        self.i = 0
        self.recovered = False
        self.diagnostics: list[str] = []

    def peek(self, k: int = 0) -> str:
        return self.tokens[self.i + k].text if self.i + k < len(self.tokens) else ""

    def kind(self, k: int = 0) -> str:
        return self.tokens[self.i + k].kind if self.i + k < len(self.tokens) else ""

    def next(self) -> Token:
        if self.i >= len(self.tokens):
            raise Lost("end of file")
        self.i += 1
        return self.tokens[self.i - 1]

    def take(self, text: str) -> bool:
        if self.peek() == text:
            self.i += 1
            return True
        return False

    def need(self, text: str) -> Token:
        if self.peek() != text:
            raise Lost(f"expected {text!r}, found {self.peek()!r}")
        return self.next()

    def name(self) -> Token:
        if self.kind() != "name":
            raise Lost(f"expected a name, found {self.peek()!r}")
        return self.next()

    def ref(self, start: Token, end: Token | None = None) -> dict:
        return self.at.ref(start.start, (end or start).end)

    def last(self) -> Token:
        return self.tokens[self.i - 1]

    def lost(self, why: object, start: int) -> None:
        """Notes a gap and moves behind the statement or block that ``start`` began."""
        self.recovered = True
        if len(self.diagnostics) < MAX_DIAGNOSTICS:
            where = self.tokens[min(self.i, len(self.tokens) - 1)].start if self.tokens else 0
            self.diagnostics.append(f"{self.file}:{self.at.line(where)}: {why}")
        self.i = start
        depth = 0
        while self.i < len(self.tokens):
            t = self.peek()
            if t == "}" and depth == 0:
                if self.i == start:
                    self.i += 1
                return
            self.i += 1
            if t == "{":
                depth += 1
            elif t == "}":
                depth -= 1
                if depth == 0:
                    return
            elif t == ";" and depth == 0:
                return

    def matched(self, open_: str, close: str) -> list[Token]:
        """The tokens between a bracket and its match, which are read."""
        self.need(open_)
        start, depth = self.i, 1
        while depth:
            t = self.next().text
            depth += (t == open_) - (t == close)
        return self.tokens[start : self.i - 1]

    def span_text(self, start: int, end: int) -> str:
        return self.text[self.tokens[start].start : self.tokens[end - 1].end] if end > start else ""


class Parser(Reader):
    # Types

    def type_end(self, i: int) -> int | None:
        """The index behind a type that begins at token ``i``; None if none does."""
        n = len(self.tokens)
        word = lambda k: self.tokens[k].text if k < n else ""
        if i >= n or self.tokens[i].kind != "name":
            return None
        if word(i) in ("mapping", "function") and word(i + 1) == "(":
            function = word(i) == "function"
            i = self._close(i + 1)
            while function and i is not None and (word(i) in _VISIBILITY | _MUTABILITY or word(i) == "returns"):
                i = self._close(i + 1) if word(i) == "returns" else i + 1
            if i is None:
                return None
        else:
            i += 1
            while word(i) == "." and i + 1 < n and self.tokens[i + 1].kind == "name":
                i += 2
            if word(i) == "payable":
                i += 1
        while word(i) == "[":
            close = self._close(i, "[", "]")
            if close is None:
                return None
            i = close
        return i

    def _close(self, i: int, open_: str = "(", close: str = ")") -> int | None:
        depth = 0
        while i < len(self.tokens):
            t = self.tokens[i].text
            depth += (t == open_) - (t == close)
            i += 1
            if depth == 0:
                return i
            if t in (";", "{", "}"):
                return None
        return None

    def type_name(self) -> str:
        end = self.type_end(self.i)
        if end is None:
            raise Lost(f"expected a type, found {self.peek()!r}")
        text = self.span_text(self.i, end)
        self.i = end
        return text

    def params(self) -> list[dict]:
        self.need("(")
        out = []
        while not self.take(")"):
            start = self.tokens[self.i] if self.i < len(self.tokens) else None
            one = {"type": normalise_type_name(self.type_name()), "name": None, "indexed": False, "storageLocation": None}
            while self.peek() in _LOCATION or self.peek() == "indexed":
                word = self.next().text
                if word == "indexed":
                    one["indexed"] = True
                else:
                    one["storageLocation"] = word
            if self.kind() == "name":
                one["name"] = self.next().text
            one["src"] = self.ref(start, self.last())
            out.append(one)
            if not self.take(",") and self.peek() != ")":
                raise Lost(f"in parameters at {self.peek()!r}")
        return out

    # File level

    def unit(self) -> dict:
        out = {"file": self.file, "pragma": None, "imports": [], "symbols": [], "using": []}
        while self.i < len(self.tokens):
            start = self.i
            try:
                self.top(out)
            except Lost as e:
                self.lost(e, start)
        return out | {"recovered": self.recovered, "diagnostics": self.diagnostics, "version_support": support_of(out["pragma"])}

    def top(self, out: dict) -> None:
        word = self.peek()
        if word == "pragma":
            start = self.next()
            while self.peek() not in (";", ""):
                self.next()
            self.need(";")
            text = self.text[start.start : self.last().start].strip()
            if out["pragma"] is None and re.match(r"pragma\s+solidity", text):
                out["pragma"] = text
        elif word == "import":
            out["imports"].append(self.import_())
        elif word in _CONTRACTS and (word != "abstract" or self.peek(1) == "contract"):
            self.contract(out)
        elif word == "using":
            out["using"].append(self.using() | {"scope": None})
        elif word == ";":
            self.next()
        else:
            self.member(out, None, None)

    def import_(self) -> dict:
        start = self.next()
        one = {"path": None, "symbols": [], "unit_alias": None}
        if self.kind() == "string":
            one["path"] = self.next().text.strip("\"'")
            if self.take("as"):
                one["unit_alias"] = self.name().text
        else:
            if self.take("*"):
                self.need("as")
                one["unit_alias"] = self.name().text
            else:
                self.need("{")
                while not self.take("}"):
                    name = self.name().text
                    one["symbols"].append({"name": name, "alias": self.name().text if self.take("as") else name})
                    self.take(",")
            self.need("from")
            if self.kind() != "string":
                raise Lost("import without a path")
            one["path"] = self.next().text.strip("\"'")
        self.need(";")
        return one | {"src": self.ref(start, self.last())}

    def using(self) -> dict:
        self.next()
        one = {"library": None, "functions": [], "type": None}
        if self.take("{"):
            while not self.take("}"):
                parts = [self.name().text]
                while self.take("."):
                    parts.append(self.name().text)
                if self.take("as"):
                    self.next()
                one["functions"].append(parts[-1])
                self.take(",")
        else:
            one["library"] = self.type_name()
        self.need("for")
        one["type"] = None if self.take("*") else normalise_type_name(self.type_name())
        self.take("global")
        self.need(";")
        return one

    def doc_before(self, at: int) -> str | None:
        """A ``/** */`` or a run of ``///`` lines that ends right before a declaration and does not trail code."""
        lines: list[str] = []
        for d in reversed(self.docs):
            if d.end > at:
                continue
            if self.text[d.end : at].strip():
                break
            before = self.text[: d.start].rpartition("\n")[2]
            if before.strip() or (lines and not d.text.startswith("///")):
                break
            lines.append(d.text)
            at = d.start
            if not d.text.startswith("///"):
                break
        return "\n".join(reversed(lines)) or None

    def symbol(self, out: dict, kind: str, name: str, scope: str | None, start: Token, types: list[str] | None = None, sigil: str | None = None, **more: object) -> dict:
        scope_name = scope.rpartition(":")[2] if scope else None
        one = {"id": node_id(self.file, scope_name, sigil or kind, name, types), "kind": kind, "name": name, "file": self.file, "scope": scope, "src": self.ref(start, self.last()), "natspec": self.doc_before(start.start)}
        out["symbols"].append(one | more)
        return out["symbols"][-1]

    def contract(self, out: dict) -> None:
        start = self.next()
        kind = start.text
        if kind == "abstract":
            self.next()
        name = self.name().text
        bases, given = [], []
        if self.take("is"):
            while True:
                bases.append(self.type_name())
                if self.peek() == "(":
                    given.append(bases[-1])
                    self.matched("(", ")")
                if not self.take(","):
                    break
        if self.peek() == "layout":
            while self.peek() not in ("{", ""):
                self.next()
        self.need("{")
        own = self.symbol(out, "Contract", name, None, start, sigil="Contract", contract_kind=kind, base_names=bases)
        scope = own["id"]
        while not self.take("}"):
            if self.i >= len(self.tokens):
                self.recovered = True
                break
            at = self.i
            try:
                if self.peek() == "using":
                    out["using"].append(self.using() | {"scope": scope})
                else:
                    self.member(out, scope, kind)
            except Lost as e:
                self.lost(e, at)
                if self.i == at and self.peek() == "}":
                    continue
        own["src"] = self.ref(start, self.last())

    def member(self, out: dict, scope: str | None, contract: str | None) -> None:
        word, start = self.peek(), self.tokens[self.i]
        if word == "function" and self.kind(1) == "name" or word in ("constructor", "fallback", "receive") and self.peek(1) == "(" or word == "function" and self.peek(1) == "(" and contract and self._is_fallback():
            self.function(out, scope, contract)
        elif word == "modifier" and self.kind(1) == "name":
            self.function(out, scope, contract)
        elif word in ("event", "error") and self.kind(1) == "name" and self.peek(2) == "(":
            self.next()
            name = self.name().text
            params = self.params()
            anonymous = self.take("anonymous")
            self.need(";")
            kind = "Event" if word == "event" else "Error"
            self.symbol(out, kind, name, scope, start, [p["type"] for p in params], params=params, is_anonymous=anonymous if kind == "Event" else None)
        elif word in ("struct", "enum") and self.kind(1) == "name":
            self.next()
            name = self.name().text
            self.matched("{", "}")
            self.symbol(out, "Struct" if word == "struct" else "Enum", name, scope, start)
        elif word == "type" and self.kind(1) == "name" and self.peek(2) == "is":
            self.next()
            name = self.name().text
            self.next()
            self.type_name()
            self.need(";")
            self.symbol(out, "UserDefinedValueType", name, scope, start)
        else:
            self.variable(out, scope)

    def _is_fallback(self) -> bool:
        """``function () ... {`` is an old fallback, ``function (...) ... name`` a variable of function type."""
        end = self.type_end(self.i)
        return end is None or self.tokens[end].text in ("{", ";") if end is None or end < len(self.tokens) else True

    def variable(self, out: dict, scope: str | None) -> None:
        start = self.tokens[self.i]
        kind = normalise_type_name(self.type_name())
        one = {"type": kind, "visibility": "internal", "is_constant": False, "is_immutable": False, "is_transient": False, "is_mapping": kind.startswith("mapping")}
        while True:
            word = self.peek()
            if word in _VISIBILITY:
                one["visibility"] = word
            elif word in ("constant", "immutable") or word == "transient" and self.kind(1) == "name":
                one[f"is_{word}"] = True
            elif word == "override":
                if self.peek(1) == "(":
                    self.next()
                    self.matched("(", ")")
                    continue
            else:
                break
            self.next()
        name = self.name().text
        if self.take("="):
            self.expression()
        self.need(";")
        self.symbol(out, "StateVariable", name, scope, start, **one)

    def function(self, out: dict, scope: str | None, contract: str | None) -> None:
        start = self.next()
        subkind = start.text if start.text != "function" else "function" if self.kind() == "name" else "fallback"
        name = self.name().text if start.text in ("function", "modifier") and self.kind() == "name" else subkind
        params = self.params() if self.peek() == "(" else []
        one: dict = {"subkind": subkind, "visibility": None, "state_mutability": "nonpayable", "is_virtual": False, "is_override": False, "modifier_names": [], "returns": []}
        while self.peek() not in ("{", ";"):
            word = self.peek()
            if word in _VISIBILITY:
                one["visibility"] = self.next().text
            elif word in _MUTABILITY:
                one["state_mutability"] = {"constant": "view"}.get(word, word)
                self.next()
            elif word == "virtual":
                one["is_virtual"] = bool(self.next())
            elif word == "override":
                one["is_override"] = bool(self.next())
                if self.peek() == "(":
                    self.matched("(", ")")
            elif word == "returns":
                self.next()
                one["returns"] = self.params()
            elif self.kind() == "name":
                one["modifier_names"].append(self.name().text)
                while self.take("."):
                    one["modifier_names"][-1] = self.name().text
                if self.peek() == "(":
                    self.matched("(", ")")
            else:
                raise Lost(f"in a function's head at {word!r}")
        if one["visibility"] is None:
            one["visibility"] = "external" if contract == "interface" else "public" if subkind == "constructor" else "internal" if scope is None or subkind == "modifier" else "default"
        body, tokens, lines = Body(), [], 0
        one["has_body"] = self.peek() == "{"
        for p in [*params, *one["returns"]]:
            if p["name"]:
                body.locals.append({"name": p["name"], "type": p["type"]})
        if one["has_body"]:
            first = self.i
            self.matched("{", "}")
            end = self.i
            inside = self.tokens[first:end]
            tokens, lines = [t.text for t in inside], len({self.at.line(t.start) for t in inside})
            self.i = first
            statements = Statements(self, body, end)
            try:
                statements.run()
            except RecursionError:  # what was read of the body stays, and so do all declarations
                statements.lost_any = True
                self.diagnostics.append(f"{self.file}: a body is nested too deeply")
            self.recovered |= statements.lost_any
            self.i = end
        else:
            self.need(";")
        types = [p["type"] for p in params]
        digest = "b1 " + xxhash.xxh64_hexdigest(" ".join(tokens)) if tokens else ""
        face = [name, ",".join(types), ",".join(p["type"] for p in one["returns"]), one["visibility"], one["state_mutability"], str(one["is_virtual"]), str(one["is_override"]), ",".join(one["modifier_names"])]
        sigil = "modifier" if subkind == "modifier" else "Function"
        self.symbol(out, "Function", name, scope, start, types, sigil, params=params, body_hash=digest, interface_hash="i1 " + xxhash.xxh64_hexdigest("|".join(face)),
                    metrics={"sloc": lines, "cyclomatic": body.cyclomatic if one["has_body"] else 0, "maxDepth": body.depth}, flags=body.flags,
                    calls=body.calls, uses=body.uses, refs=body.refs, locals=body.locals, **one)

    def expression(self) -> tuple:
        return Expressions(self).parse()


class Expressions:
    """Expressions by precedence: nested tuples whose first entry is their kind."""

    def __init__(self, reader: Parser):
        self.r = reader

    def parse(self, least: int = 0) -> tuple:
        r = self.r
        left = self.unary()
        while True:
            op = r.peek()
            if op in _ASSIGN and least <= 1:
                r.next()
                left = ("assign", op, left, self.parse(1))
            elif op == "?" and least <= 2:
                r.next()
                yes = self.parse(1)
                r.need(":")
                left = ("ternary", left, yes, self.parse(1))
            elif op in _BINARY and _BINARY[op] >= max(least, 3):
                r.next()
                p = _BINARY[op]
                left = ("binary", op, left, self.parse(p if op == "**" else p + 1))
            else:
                return left

    def unary(self) -> tuple:
        r = self.r
        op = r.peek()
        if op in ("++", "--"):
            r.next()
            return ("update", self.unary())
        if op == "delete":
            r.next()
            return ("delete", self.unary())
        if op in ("!", "~", "-", "+"):
            r.next()
            return ("unary", self.unary())
        return self.postfix(self.primary())

    def primary(self) -> tuple:
        r = self.r
        t = r.tokens[r.i] if r.i < len(r.tokens) else None
        if t is None:
            raise Lost("an expression ends early")
        if t.kind in ("number", "string"):
            r.next()
            while r.kind() == "string" or r.peek() in ("wei", "gwei", "ether", "seconds", "minutes", "hours", "days", "weeks"):
                r.next()
            return ("literal", t)
        if t.text == "new":
            r.next()
            first = r.i
            text = r.type_name()
            return ("new", text, t, r.tokens[first])
        if t.text in ("(", "["):
            r.next()
            close = ")" if t.text == "(" else "]"
            items = []
            while not r.take(close):
                if r.take(","):
                    continue
                items.append(self.parse())
            return ("tuple", items, t)
        if t.kind == "name" and (_ELEMENTARY.match(t.text) or t.text in ("mapping", "function") and r.peek(1) == "("):
            return ("type", r.type_name() if t.text in ("mapping", "function") else r.next().text, t)
        if t.kind == "name":
            r.next()
            return ("name", t)
        raise Lost(f"an expression at {t.text!r}")

    def postfix(self, left: tuple) -> tuple:
        r = self.r
        while True:
            op = r.peek()
            if op == ".":
                r.next()
                left = ("member", left, r.name())
            elif op == "[":
                r.next()
                inner = []
                while not r.take("]"):
                    if not r.take(":"):
                        inner.append(self.parse())
                left = ("index", left, inner)
            elif op == "(":
                args, count = self.arguments()
                left = ("call", left, args, count, r.last())
            elif op == "{" and r.kind(1) == "name" and r.peek(2) == ":" and left[0] in ("member", "name", "new", "call"):
                left = ("options", left, self.named())
            elif op in ("++", "--"):
                r.next()
                left = ("update", left)
            else:
                return left

    def named(self) -> list[tuple[str, tuple]]:
        r = self.r
        r.need("{")
        out = []
        while not r.take("}"):
            key = r.name().text
            r.need(":")
            out.append((key, self.parse()))
            r.take(",")
        return out

    def arguments(self) -> tuple[list[tuple], int]:
        r = self.r
        r.need("(")
        if r.peek() == "{" and (r.peek(2) == ":" or r.peek(1) == "}"):
            args = [x for _, x in self.named()]
            r.need(")")
            return args, len(args)
        args = []
        while not r.take(")"):
            args.append(self.parse())
            if not r.take(",") and r.peek() != ")":
                raise Lost(f"in arguments at {r.peek()!r}")
        return args, len(args)


def first_token(node: tuple) -> Token:
    """Where an expression begins."""
    while True:
        kind = node[0]
        if kind in ("name", "literal"):
            return node[1]
        if kind in ("new", "type", "tuple"):
            return node[2]
        node = node[1] if kind in ("member", "index", "call", "options") else node[2] if kind in ("assign", "binary") else node[1]


def base_name(node: tuple) -> Token | None:
    """The identifier at the root of member and index accesses."""
    while True:
        if node[0] == "name":
            return node[1]
        if node[0] in ("member", "index", "options"):
            node = node[1]
        elif node[0] == "tuple" and len(node[1]) == 1:
            node = node[1][0]
        else:
            return None


def targets(node: tuple) -> list[Token]:
    if node[0] == "tuple" and len(node[1]) != 1:
        return [t for x in node[1] for t in targets(x)]
    base = base_name(node)
    return [base] if base else []


class Statements:
    """Walks a body's statements and notes what its expressions do."""

    def __init__(self, reader: Parser, body: Body, end: int):
        self.r, self.b, self.end = reader, body, end
        self.skip: set[int] = set()
        self.lost_any = False

    def run(self) -> None:
        self.block(1)

    def block(self, depth: int) -> None:
        r = self.r
        r.need("{")
        self.b.depth = max(self.b.depth, depth)
        while r.i < self.end and not r.take("}"):
            start = r.i
            try:
                self.statement(depth)
            except Lost:
                self.lost_any = True
                r.lost("unreadable statement", start)

    def branch(self, depth: int) -> None:
        self.block(depth + 1) if self.r.peek() == "{" else self.statement(depth)

    def condition(self) -> None:
        self.r.need("(")
        self.visit(self.r.expression())
        self.r.need(")")

    def statement(self, depth: int) -> None:
        r, b = self.r, self.b
        word = r.peek()
        if word == "{":
            self.block(depth + 1)
        elif word == "unchecked" and r.peek(1) == "{":
            r.next()
            b.flags["hasUnchecked"] = True
            self.block(depth + 1)
        elif word == "assembly":
            self.assembly(depth + 1)
        elif word == "if":
            r.next()
            b.cyclomatic += 1
            self.condition()
            self.branch(depth)
            if r.take("else"):
                self.branch(depth)
        elif word == "while":
            r.next()
            b.cyclomatic += 1
            self.condition()
            self.branch(depth)
        elif word == "do":
            r.next()
            b.cyclomatic += 1
            self.branch(depth)
            r.need("while")
            self.condition()
            r.need(";")
        elif word == "for":
            r.next()
            b.cyclomatic += 1
            r.need("(")
            if not r.take(";"):
                self.simple()
            if r.peek() != ";":
                self.visit(r.expression())
            r.need(";")
            if r.peek() != ")":
                self.visit(r.expression())
            r.need(")")
            self.branch(depth)
        elif word == "try":
            r.next()
            b.flags["hasTryCatch"] = True
            self.visit(r.expression())
            if r.take("returns"):
                self.declare(r.params())
            self.block(depth + 1)
            while r.take("catch"):
                b.cyclomatic += 1
                if r.kind() == "name":
                    r.next()
                if r.peek() == "(":
                    self.declare(r.params())
                self.block(depth + 1)
        elif word in ("emit", "revert") and r.kind(1) == "name":
            start = r.next()
            call = r.expression()
            r.need(";")
            callee = call[1] if call[0] == "call" else call
            name = callee[2] if callee[0] == "member" else callee[1] if callee[0] == "name" else None
            if name is not None:
                b.refs.append({"kind": "emits" if word == "emit" else "reverts", "name": name.text, "src": r.ref(start, r.last())})
                self.skip.add(name.start)
            if call[0] == "call":
                self.visit(callee)
                for x in call[2]:
                    self.visit(x)
        elif word == "return":
            r.next()
            if r.peek() != ";":
                self.visit(r.expression())
            r.need(";")
        elif word in ("break", "continue", "_", "throw") and r.peek(1) == ";":
            r.next()
            r.need(";")
        else:
            self.simple()

    def declare(self, params: list[dict]) -> None:
        self.b.locals += [{"name": p["name"], "type": p["type"]} for p in params if p["name"]]

    def simple(self) -> None:
        """A declaration of locals, or an expression, up to its semicolon."""
        r = self.r
        end = None if r.peek() in _NO_TYPE else r.type_end(r.i)
        if end is not None:
            at = end
            while at < len(r.tokens) and r.tokens[at].text in _LOCATION:
                at += 1
            if at < len(r.tokens) and r.tokens[at].kind == "name" and at + 1 < len(r.tokens) and r.tokens[at + 1].text in ("=", ";"):
                kind = normalise_type_name(r.span_text(r.i, end))
                for t in r.tokens[r.i : end]:
                    if t.kind == "name" and "[" in kind and not _ELEMENTARY.match(t.text):
                        self.use(t, False) if t.start != r.tokens[r.i].start else None
                self.b.locals.append({"name": r.tokens[at].text, "type": kind})
                r.i = at + 1
                if r.take("="):
                    self.visit(r.expression())
                r.need(";")
                return
        if r.peek() == "(" and self.tuple_declaration():
            return
        self.visit(r.expression())
        r.need(";")

    def tuple_declaration(self) -> bool:
        """``(uint a, , bool b) = f();``"""
        r, start = self.r, self.r.i
        close = r._close(r.i)
        if close is None or close >= len(r.tokens) or r.tokens[close].text != "=":
            return False
        r.i += 1
        found = []
        while r.i < close - 1:
            if r.take(","):
                continue
            end = r.type_end(r.i)
            at = end
            while at is not None and at < close and r.tokens[at].text in _LOCATION:
                at += 1
            if at is None or at >= close - 1 or r.tokens[at].kind != "name":
                r.i = start
                return False
            found.append({"name": r.tokens[at].text, "type": normalise_type_name(r.span_text(r.i, end))})
            r.i = at + 1
        if not found:
            r.i = start
            return False
        r.i = close + 1
        self.b.locals += found
        self.visit(r.expression())
        r.need(";")
        return True

    def assembly(self, depth: int) -> None:
        r, b = self.r, self.b
        b.flags["hasAssembly"] = True
        while r.peek() != "{":
            r.next()
        b.depth = max(b.depth, depth)
        for t in r.matched("{", "}"):
            if t.text in _YUL:
                b.flags[_YUL[t.text]] = True
            elif t.text in ("if", "for"):
                b.cyclomatic += 1

    # What expressions do

    def use(self, token: Token, write: bool) -> None:
        self.b.uses.append({"name": token.text, "write": write, "src": self.r.ref(token)})

    def visit(self, node: tuple | None) -> None:
        if node is None:
            return
        kind, b = node[0], self.b
        if kind == "name":
            if node[1].start not in self.skip and node[1].text not in ("this", "super", "msg", "tx", "block", "abi"):
                self.use(node[1], False)
        elif kind == "member":
            self.visit(node[1])
        elif kind == "index":
            self.visit(node[1])
            for x in node[2]:
                self.visit(x)
        elif kind == "tuple":
            for x in node[1]:
                self.visit(x)
        elif kind in ("unary",):
            self.visit(node[1])
        elif kind in ("update", "delete"):
            base = base_name(node[1])
            if base:
                self.use(base, True)
                if kind == "update":
                    self.use(base, False)
                self.skip.add(base.start)
            self.visit(node[1])
        elif kind == "assign":
            for base in targets(node[2]):
                self.use(base, True)
                if node[1] != "=":
                    self.use(base, False)
                self.skip.add(base.start)
            self.visit(node[2])
            self.visit(node[3])
        elif kind == "ternary":
            b.cyclomatic += 1
            for x in node[1:]:
                self.visit(x)
        elif kind == "binary":
            if node[1] in ("&&", "||"):
                b.cyclomatic += 1
            if node[1] in ("==", "!=") and any(self.is_sender(x) for x in node[2:]):
                b.flags["checksSender"] = True
            self.visit(node[2])
            self.visit(node[3])
        elif kind == "options":
            self.visit(node[1])
            for _, x in node[2]:
                self.visit(x)
        elif kind == "call":
            self.call(node)

    @staticmethod
    def is_sender(node: tuple) -> bool:
        while node[0] == "tuple" and len(node[1]) == 1:
            node = node[1][0]
        return node[0] == "member" and node[1][0] == "name" and f"{node[1][1].text}.{node[2].text}" in ("msg.sender", "tx.origin")

    def call(self, node: tuple) -> None:
        """Notes a call by what its callee looks like, then visits what is left of it."""
        _, callee, args, count, close = node
        options: list = []
        if callee[0] == "options":
            callee, options = callee[1], callee[2]
        keys = {k for k, _ in options}
        base = {"arg_count": count, "has_value": "value" in keys, "has_salt": "salt" in keys, "src": self.r.ref(first_token(node), close)}
        note = lambda shape, name, receiver=None: self.note(base | {"shape": shape, "name": name, "receiver": receiver})
        while callee[0] == "tuple" and len(callee[1]) == 1:
            callee = callee[1][0]
        if callee[0] == "type":
            pass
        elif callee[0] == "new":
            note("new", normalise_type_name(callee[1]))
        elif callee[0] == "name":
            note("bare", callee[1].text)
            self.skip.add(callee[1].start)
        elif callee[0] != "member":
            note("expression", self.source(callee))
            self.visit(callee)
        else:
            inner, name = callee[1], callee[2].text
            while inner[0] == "tuple" and len(inner[1]) == 1:
                inner = inner[1][0]
            if inner[0] == "name" and inner[1].text in ("super", "this"):
                note(inner[1].text, name)
            elif inner[0] == "name":
                if name in ("push", "pop"):
                    self.use(inner[1], True)
                note("member", name, inner[1].text)
                self.visit(inner)
            elif inner[0] == "call" and inner[3] == 1 and inner[1][0] in ("name", "type") and not (inner[1][0] == "name" and inner[1][1].text == "payable"):
                note("cast", name, inner[1][1].text if inner[1][0] == "name" else inner[1][1])
                for x in inner[2]:
                    self.visit(x)
            elif inner[0] == "call" and inner[1][0] == "name" and inner[1][1].text == "payable":
                note("cast", name, "address")
                for x in inner[2]:
                    self.visit(x)
            else:
                note("expression", name, self.source(inner))
                self.visit(inner)
        for _, x in options:
            self.visit(x)
        for x in args:
            self.visit(x)

    def source(self, node: tuple) -> str:
        """The text of an expression, from its first token to where its parts end."""
        ends = [first_token(node).end]

        def walk(n: object) -> None:
            if isinstance(n, Token):
                ends.append(n.end)
            elif isinstance(n, (tuple, list)):
                for x in n:
                    walk(x)

        walk(node)
        return self.r.text[first_token(node).start : max(ends)]

    def note(self, call: dict) -> None:
        b, name, shape = self.b, call["name"], call["shape"]
        b.calls.append(call)
        if call["has_value"]:
            b.flags["sendsValue"] = True
        if shape == "new":
            if not re.match(r"(address|bool|string|bytes\d*|u?int\d*|fixed|ufixed)\b", name):
                b.flags["hasCreate"] = True
        elif shape == "bare" and name == "selfdestruct":
            b.flags["hasSelfdestruct"] = True
        elif shape in ("member", "expression", "cast"):
            if name == "delegatecall":
                b.flags["hasDelegatecall"] = True
            elif name in ("call", "staticcall", "callcode"):
                b.flags["hasLowLevelCall"] = True
            elif name in ("transfer", "send") and shape != "cast":
                b.flags["sendsValue"] = True


def parse_source(file: str, text: str) -> dict:
    """The declarations of a file; never raises for what the text holds."""
    reader = Parser(text, file)
    try:
        return reader.unit()
    except RecursionError:
        reader.diagnostics.append(f"{file}: nested too deeply")
        return {"file": file, "pragma": None, "imports": [], "symbols": [], "using": [], "recovered": True, "diagnostics": reader.diagnostics, "version_support": "unknown"}
