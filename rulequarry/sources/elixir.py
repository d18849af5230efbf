"""A reader of Elixir source text into a syntax tree, as far as structural rules need it.

The tree has calls (name, arguments), variables, lists, pairs and literals, in the shape that the language's own quoting gives: keyword blocks
are a last argument of pairs, operators are calls of two arguments, a name without arguments is a variable.
"""

from __future__ import annotations

import re
from typing import NamedTuple


class SyntaxProblem(ValueError):
    """The text isn't something that this reader understands."""


class Token(NamedTuple):
    kind: str  # name alias number atom key string sigil op punct eol end word
    value: object
    line: int
    space: bool  # white space stands before it
    tight: bool  # none stands after it


class Node:
    __slots__ = ("args", "callee", "form", "kind", "line", "lit", "lit_type")

    def __init__(self, kind, form=None, args=(), line=0, lit_type=None, lit=None, callee=None):
        self.kind, self.form, self.args, self.line, self.lit_type, self.lit, self.callee = kind, form, list(args), line, lit_type, lit, callee


#: Operators of the language by binding power; r: to the right.
BINARY = {
    "<-": (40, "l"), "\\\\": (40, "l"), "when": (50, "r"), "::": (60, "r"), "|": (70, "r"), "=>": (80, "r"), "=": (100, "r"),
    "||": (120, "l"), "|||": (120, "l"), "or": (120, "l"), "&&": (130, "l"), "&&&": (130, "l"), "and": (130, "l"),
    "==": (140, "l"), "!=": (140, "l"), "=~": (140, "l"), "===": (140, "l"), "!==": (140, "l"),
    "<": (150, "l"), ">": (150, "l"), "<=": (150, "l"), ">=": (150, "l"),
    "|>": (160, "l"), "<<<": (160, "l"), ">>>": (160, "l"), "<<~": (160, "l"), "~>>": (160, "l"), "<~": (160, "l"), "~>": (160, "l"), "<~>": (160, "l"), "<|>": (160, "l"),
    "in": (170, "l"), "not in": (170, "l"), "^^^": (180, "l"), "//": (190, "r"), "++": (200, "r"), "--": (200, "r"), "+++": (200, "r"), "---": (200, "r"), "..": (200, "r"), "<>": (200, "r"),
    "+": (210, "l"), "-": (210, "l"), "*": (220, "l"), "/": (220, "l"), "**": (230, "l"),
}
UNARY = {"&": 90, "!": 300, "^": 300, "not": 300, "+": 300, "-": 300, "~~~": 300, "@": 320}
OPERATORS = sorted({*BINARY, *UNARY, "->", "..."} - {"when", "or", "and", "in", "not in", "not"}, key=len, reverse=True)
SECTIONS = ("else", "rescue", "catch", "after")
WORDS = ("do", "end", "fn", *SECTIONS)
_KINDS = {**dict.fromkeys(WORDS, "word"), **dict.fromkeys(("when", "or", "and", "in", "not"), "op")}
PAIRS = {"(": ")", "[": "]", "{": "}", "<": ">"}

_BLANK = re.compile(r"[ \t\r]+")
_MARKS = frozenset("()[]{},")
_LETTERS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ_")
_OP = re.compile("|".join(map(re.escape, OPERATORS)))
_NAME = re.compile(r"[^\W\dA-Z]\w*[?!]?")
_ALIAS = re.compile(r"[A-Z]\w*(?:\.[A-Z]\w*)*")
_NUMBER = re.compile(r"0x[0-9a-fA-F_]+|0b[01_]+|0o[0-7_]+|\d[\d_]*(?:\.\d[\d_]*(?:[eE][+-]?\d+)?)?")
_ATOM = re.compile(r":(?:[^\W\d]\w*(?:@\w+)*[?!]?|<<>>|%\{\}|\{\}|\.\.\.|" + "|".join(map(re.escape, OPERATORS)) + r"|%|\.)")
_KEY = re.compile(r"(?:[^\W\d]\w*[?!]?|" + "|".join(map(re.escape, OPERATORS)) + r"):(?=\s)")
_CHAR = re.compile(r"\?(?:\\.|.)", re.S)
_SIGIL = re.compile(r"~([a-z]|[A-Z][A-Z0-9]*)(\"\"\"|'''|[/|\"'(\[{<])")


class Reader:
    """Text to tokens."""

    def __init__(self, text: str, line: int = 1):
        self.text, self.at, self.line, self.out = text, 0, line, []

    def tokens(self) -> list[Token]:
        text, end = self.text, len(self.text)
        while self.at < end:
            start = self.at
            c = text[self.at]
            space = start == 0 or text[start - 1] in " \t\r\n"
            if c in " \t\r":
                self.at = _BLANK.match(text, start).end()
            elif c in _MARKS:
                self.at += 1
                self.add("punct", c, space)
            elif c in _LETTERS:
                if m := _KEY.match(text, start):
                    self.take("key", m[0][:-1], m, space)
                elif m := _ALIAS.match(text, start):
                    self.take("alias", m[0], m, space)
                else:
                    self.word(space)
            elif c == "\\" and text[self.at + 1 : self.at + 2] == "\n":
                self.at += 2
                self.line += 1
            elif c == "\n":
                self.add("eol", "\n", space)
                self.line += 1
                self.at += 1
            elif c == "#":
                stop = text.find("\n", self.at)
                self.at = end if stop < 0 else stop
            elif c == ";":
                self.add("eol", ";", space)
                self.at += 1
            elif m := _SIGIL.match(text, self.at):
                self.sigil(m, space)
            elif text.startswith(('"""', "'''"), self.at):
                self.quoted(text[self.at : self.at + 3], "string", space)
            elif c in "\"'":
                self.quoted(c, "string", space)
            elif m := _KEY.match(text, self.at):
                self.take("key", m[0][:-1], m, space)
            elif c == ":" and text[self.at + 1 : self.at + 2] in ('"', "'"):
                self.at += 1
                self.quoted(text[self.at], "atom", space)
            elif text.startswith("::", self.at):
                self.at += 2
                self.add("op", "::", space)
            elif m := _ATOM.match(text, self.at):
                self.take("atom", m[0][1:], m, space)
            elif m := _CHAR.match(text, self.at):
                self.take("number", m[0], m, space)
            elif m := _NUMBER.match(text, self.at):
                self.take("number", m[0], m, space)
            elif _NAME.match(text, self.at):
                self.word(space)
            elif text.startswith("<<", self.at) and not text.startswith("<<<", self.at) and not text.startswith("<<~", self.at):
                self.at += 2
                self.add("punct", "<<", space)
            elif text.startswith(">>", self.at) and not text.startswith(">>>", self.at):
                self.at += 2
                self.add("punct", ">>", space)
            elif c == "%":
                self.at += 1
                self.add("punct", "%", space)
            elif c == "." and not text.startswith("..", self.at):
                self.at += 1
                self.add("punct", ".", space)
            elif m := _OP.match(text, self.at):
                self.take("op", m[0], m, space)
            else:
                raise SyntaxProblem(f"line {self.line}: unexpected {c!r}")
        self.out.append(Token("end", None, self.line, True, False))
        return self.out

    def word(self, space):
        text, start = self.text, self.at
        m = _NAME.match(text, start)
        word = m[0]
        if word[-1] == "!" and text.startswith("=", m.end()) and not text.startswith(("==", "=~"), m.end()):
            word = word[:-1]  # name != other
        self.at = start + len(word)
        after_dot = self.out and self.out[-1].kind == "punct" and self.out[-1].value == "."
        self.add("name" if after_dot else _KINDS.get(word, "name"), word, space)

    def add(self, kind, value, space, line=None):
        after = self.text[self.at : self.at + 1]
        self.out.append(Token(kind, value, line or self.line, space, after != "" and not after.isspace()))

    def take(self, kind, value, m, space):
        self.at = m.end()
        self.add(kind, value, space)

    def body(self, close: str, raw: bool, opened: str = "") -> list:
        """Parts up to the closing mark: texts, and (source, line) of interpolations."""
        text, parts, own, depth = self.text, [], [], 0
        while True:
            if self.at >= len(text):
                raise SyntaxProblem(f"line {self.line}: no closing {close}")
            if text.startswith(close, self.at) and depth == 0:
                self.at += len(close)
                break
            c = text[self.at]
            if c == "\\" and (not raw or text[self.at + 1 : self.at + 2] == close):
                own.append(text[self.at : self.at + 2])
                self.line += text[self.at + 1 : self.at + 2] == "\n"
                self.at += 2
            elif not raw and text.startswith("#{", self.at):
                parts.append("".join(own))
                own, line = [], self.line
                inner = self.nested()
                parts.append((inner, line))
            else:
                depth += (c == opened and opened != "") - (c == close and depth > 0 and len(close) == 1)
                self.line += c == "\n"
                own.append(c)
                self.at += 1
        return [*parts, "".join(own)]

    def nested(self) -> str:
        """The source of an interpolation; strings and braces in it are matched."""
        self.at += 2
        start, depth = self.at, 1
        while self.at < len(self.text):
            c = self.text[self.at]
            if c == '"':
                self.at += 1
                self.body('"', False)
                continue
            depth += (c == "{") - (c == "}")
            self.line += c == "\n"
            self.at += 1
            if not depth:
                return self.text[start : self.at - 1]
        raise SyntaxProblem(f"line {self.line}: no closing }}")

    def quoted(self, mark: str, kind: str, space: bool):
        line, heredoc = self.line, len(mark) == 3
        self.at += len(mark)
        if heredoc:
            self.skip_line()
        parts = self.body(mark, False)
        if heredoc:
            parts = self.unindent(parts)
        if self.text.startswith(":", self.at) and self.text[self.at + 1 : self.at + 2].isspace() and kind == "string" and not heredoc and len(parts) == 1:
            self.at += 1
            self.add("key", parts[0], space, line)
        else:
            self.add(kind, parts, space, line)

    def skip_line(self):
        stop = self.text.find("\n", self.at)
        if stop < 0:
            raise SyntaxProblem(f"line {self.line}: an open heredoc")
        self.at = stop + 1
        self.line += 1

    @staticmethod
    def unindent(parts: list) -> list:
        """The closing mark's indentation goes from each line."""
        last = parts[-1] if isinstance(parts[-1], str) else ""
        indent = len(last) - len(last.rstrip(" \t"))
        strip = lambda s, first: "\n".join(x if i == 0 and not first else re.sub(rf"^[ \t]{{0,{indent}}}", "", x) for i, x in enumerate(s.split("\n")))
        return [strip(p, i == 0) if isinstance(p, str) else p for i, p in enumerate(parts)]

    def sigil(self, m, space: bool):
        line, mark = self.line, m[2]
        self.at = m.end()
        if len(mark) == 3:
            self.skip_line()
        parts = self.body(PAIRS.get(mark, mark), m[1][0].isupper(), mark if mark in PAIRS else "")
        if len(mark) == 3:
            parts = self.unindent(parts)
        while self.at < len(self.text) and self.text[self.at].isalpha():
            self.at += 1
        self.add("sigil", (m[1], parts), space, line)


class Parser:
    """Tokens to a tree."""

    def __init__(self, text: str, line: int = 1):
        self.tokens, self.i = Reader(text, line).tokens(), 0

    # tokens
    @property
    def now(self) -> Token:
        return self.tokens[self.i]

    def ahead(self, n: int = 1) -> Token:
        return self.tokens[min(self.i + n, len(self.tokens) - 1)]

    def is_(self, kind, *values) -> bool:
        token = self.tokens[self.i]
        return token.kind == kind and (not values or token.value in values)

    def step(self) -> Token:
        self.i += 1
        return self.tokens[self.i - 1]

    def need(self, kind, value) -> Token:
        if not self.is_(kind, value):
            raise SyntaxProblem(f"line {self.now.line}: expected {value}, found {self.now.value!r}")
        return self.step()

    def lines(self):
        while self.tokens[self.i].kind == "eol":
            self.i += 1

    # blocks
    def program(self) -> Node:
        tree = self.block(("end",), ())
        if self.now.kind != "end":
            raise SyntaxProblem(f"line {self.now.line}: unexpected {self.now.value!r}")
        return tree

    def block(self, kinds: tuple, values: tuple) -> Node:
        """Statements, or clauses with arrows, up to a token of these kinds and values."""
        clauses, body, line = None, [], self.now.line
        done = lambda: self.now.kind in kinds and (not values or self.now.value in values)
        self.lines()
        while not done():
            at = self.now
            if self.is_("op", "->"):
                items = []
            else:
                items = [self.keywords() if self.is_("key") else self.expression()]
                while self.is_("punct", ","):
                    self.step()
                    self.lines()
                    items.append(self.keywords() if self.is_("key") else self.expression())
            if self.is_("op", "->"):
                arrow = self.step()
                body = []
                if len(items) == 1 and items[0].kind == "call" and items[0].form == "(,)":
                    items = items[0].args
                clauses = clauses or []
                clauses.append((items, body, arrow.line))
                self.lines()
                continue
            if len(items) != 1:
                raise SyntaxProblem(f"line {at.line}: a list without brackets")
            body.append(items[0])
            if not self.is_("eol") and not done():
                raise SyntaxProblem(f"line {self.now.line}: unexpected {self.now.value!r}")
            self.lines()
        if clauses is None:
            return self.sequence(body, line)
        return Node("list", args=[Node("call", "->", [Node("list", args=a, line=n), self.sequence(b, n)], n) for a, b, n in clauses], line=line)

    @staticmethod
    def sequence(body: list, line: int) -> Node:
        return body[0] if len(body) == 1 else Node("call", "__block__", body, line)

    def do_block(self) -> Node:
        self.need("word", "do")
        pairs, name = [], "do"
        while True:
            body = self.block(("word",), ("end", *SECTIONS))
            pairs.append(Node("pair", args=[Node("literal", line=body.line, lit_type="atom", lit=name), body], line=body.line))
            name = self.step().value
            if name == "end":
                return Node("list", args=pairs, line=pairs[0].line)

    # expressions
    def expression(self, least: int = 0, no_do: bool = False) -> Node:
        left = self.unary(no_do)
        while True:
            i = self.i
            token = self.tokens[i]
            while token.kind == "eol" and token.value == "\n":
                self.i += 1
                token = self.tokens[self.i]
            crossed = self.i > i
            op = token.value if token.kind == "op" else None
            if op == "not" and self.ahead().kind == "op" and self.ahead().value == "in":
                op = "not in"
            if op not in BINARY or BINARY[op][0] < least or (crossed and op in ("+", "-", "not in")) or (crossed and op == "in"):
                self.i = i
                return left
            power, side = BINARY[op]
            self.step()
            if op == "not in":
                self.step()
            self.lines()
            if op in ("when", "|") and self.is_("key"):
                right = self.keywords(no_do)
            else:
                right = self.expression(power + (side == "l"), no_do)
            if op == "not in":
                left = Node("call", "not", [Node("call", "in", [left, right], token.line)], token.line)
            else:
                left = Node("call", op, [left, right], token.line)

    def unary(self, no_do: bool) -> Node:
        token = self.now
        if token.kind == "op" and token.value in UNARY:
            self.step()
            if token.value == "&" and token.tight and self.is_("number"):  # a placeholder
                return self.suffixed(Node("call", "&", [self.primary(no_do)], token.line), no_do)
            self.lines()
            inner = self.expression(UNARY[token.value], no_do)
            return Node("call", token.value, [inner], token.line)
        if token.kind == "op" and token.value in ("...", ".."):
            self.step()
            return Node("call", token.value, [], token.line)
        return self.suffixed(self.primary(no_do), no_do)

    def suffixed(self, left: Node, no_do: bool) -> Node:
        while True:
            token = self.tokens[self.i]
            if token.kind not in ("eol", "punct", "word"):
                return left
            if token.kind == "eol" and token.value == "\n":
                j = self.i
                while self.tokens[j].kind == "eol":
                    j += 1
                if self.tokens[j].kind == "punct" and self.tokens[j].value == ".":
                    self.i = j
                    continue
                return left
            if self.is_("punct", "."):
                self.step()
                self.lines()
                left = self.dotted(left, token.line, no_do)
            elif self.is_("punct", "[") and not token.space:
                self.step()
                inside = self.items("]")
                callee = Node("call", ".", [Node("call", "__aliases__", [], token.line, "alias", None), Node("literal", line=token.line, lit_type="atom", lit="get")], token.line)
                left = Node("call", ".()", [left, *inside], token.line, callee=callee)
            elif self.is_("punct", "(") and not token.space and left.kind == "call" and left.callee is not None:
                self.step()
                left = Node("call", "()()", self.items(")"), token.line, callee=left)
            elif self.is_("word", "do") and not no_do and left.kind == "call" and left.callee is not None and left.form == ".()":
                left.args.append(self.do_block())
            else:
                return left

    def dotted(self, left: Node, line: int, no_do: bool) -> Node:
        token = self.now
        if token.kind == "alias":
            self.step()
            if left.form == "__aliases__" and left.lit is not None:
                left.lit += f".{token.value}"
                return left
            return Node("call", "__aliases__", [left], token.line, "alias", None)
        if self.is_("punct", "("):
            self.step()
            return Node("call", ".()", self.items(")"), line, callee=Node("call", ".", [left], line))
        if self.is_("punct", "{"):
            self.step()
            name, args = "{}", self.items("}")
            return Node("call", ".()", args, line, callee=Node("call", ".", [left, Node("literal", line=line, lit_type="atom", lit=name)], line))
        if token.kind in ("name", "op", "word"):
            name = self.step().value
        elif token.kind == "string":
            name = "".join(x for x in self.step().value if isinstance(x, str))
        elif token.kind == "key":  # a.b key: value cannot be; a dot before a keyword is a name
            raise SyntaxProblem(f"line {token.line}: a key after a dot")
        else:
            raise SyntaxProblem(f"line {token.line}: unexpected {token.value!r} after a dot")
        callee = Node("call", ".", [left, Node("literal", line=token.line, lit_type="atom", lit=name)], line)
        args = []
        if self.is_("punct", "(") and not self.now.space:
            self.step()
            args = self.items(")")
        elif self.starts_argument():
            args = self.open_arguments()
        call = Node("call", ".()", args, token.line, callee=callee)
        if self.is_("word", "do") and not no_do:
            call.args.append(self.do_block())
        return call

    def items(self, close: str) -> list[Node]:
        """Comma-separated expressions up to the closing mark; trailing pairs make one list."""
        out = []
        self.lines()
        while not self.is_("punct", close):
            out.append(self.keywords() if self.is_("key") else self.expression())
            self.lines()
            if self.is_("punct", ","):
                self.step()
                self.lines()
            elif not self.is_("punct", close):
                raise SyntaxProblem(f"line {self.now.line}: expected {close}, found {self.now.value!r}")
        self.step()
        return out

    def keywords(self, no_do: bool = False) -> Node:
        pairs, line = [], self.now.line
        while True:
            key = self.step()
            self.lines()
            value = self.expression(0, no_do)
            pairs.append(Node("pair", args=[Node("literal", line=key.line, lit_type="atom", lit=key.value), value], line=key.line))
            i = self.i
            if self.is_("punct", ","):
                self.step()
                self.lines()
                if self.is_("key"):
                    continue
            self.i = i
            return Node("list", args=pairs, line=line)

    def starts_argument(self) -> bool:
        """Whether an argument without parentheses follows a name."""
        t = self.now
        if not t.space or t.kind in ("eol", "end"):
            return False
        if t.kind in ("name", "alias", "number", "atom", "key", "string", "sigil"):
            return True
        if t.kind == "word":
            return t.value == "fn"
        if t.kind == "punct":
            return t.value in ("[", "{", "%", "<<", "(")
        if t.kind == "op":
            if t.value in ("!", "^", "&", "@", "~~~"):
                return True
            if t.value == "not":
                return not (self.ahead().kind == "op" and self.ahead().value == "in")
            return t.value in ("+", "-") and t.tight
        return False

    def open_arguments(self) -> list[Node]:
        out = []
        while True:
            if self.is_("key"):
                return [*out, self.keywords(True)]
            out.append(self.expression(0, True))
            if not self.is_("punct", ","):
                return out
            self.step()
            self.lines()

    def primary(self, no_do: bool) -> Node:
        token = self.step()
        kind, value, line = token.kind, token.value, token.line
        if kind == "number":
            return Node("literal", line=line, lit_type="number", lit=value)
        if kind in ("atom", "string"):
            if isinstance(value, str):
                return Node("literal", line=line, lit_type="atom", lit=value)
            return self.text(value, line, kind)
        if kind == "sigil":
            return Node("call", f"sigil_{value[0]}", [self.text(value[1], line, "sigil"), Node("list", line=line)], line)
        if kind == "alias":
            return Node("call", "__aliases__", [], line, "alias", value)
        if kind == "punct":
            if value == "(":
                return self.parenthesis(line)
            if value == "[":
                return self.bracket(line)
            if value == "{":
                args = self.items("}")
                return Node("pair", args=args, line=line) if len(args) == 2 else Node("call", "{}", args, line)
            if value == "<<":
                return Node("call", "<<>>", self.items(">>"), line)
            if value == "%":
                return self.map(line)
        if kind == "word" and value == "fn":
            body = self.block(("word",), ("end",))
            self.step()
            return Node("call", "fn", body.args if body.kind == "list" else [body], line)
        if kind == "name":
            return self.name(value, line, no_do)
        raise SyntaxProblem(f"line {line}: unexpected {value!r}")

    def text(self, parts: list, line: int, kind: str) -> Node:
        if len(parts) == 1 and kind != "sigil":
            return Node("literal", line=line, lit_type="atom" if kind == "atom" else "string", lit=parts[0])
        args = []
        for p in parts:
            if isinstance(p, str):
                args += [Node("literal", line=line, lit_type="string", lit=p)] * bool(p)
            else:
                args.append(Node("call", "::", [Parser(*p).program(), Node("var", "binary", line=p[1])], p[1]))
        return Node("call", "<<>>", args, line)

    def parenthesis(self, line: int) -> Node:
        self.lines()
        if self.is_("punct", ")"):
            self.step()
            return Node("call", "__block__" if not self.is_("op", "->") else "(,)", [], line)
        start = self.i
        first = self.keywords() if self.is_("key") else self.expression()
        self.lines()
        if self.is_("punct", ","):
            self.i = start
            args = self.items(")")
            if not self.is_("op", "->", "when"):
                raise SyntaxProblem(f"line {line}: a list in parentheses")
            return Node("call", "(,)", args, line)
        if self.is_("punct", ")"):
            self.step()
            return first
        self.i = start
        body = self.block(("punct",), (")",))
        self.step()
        return body

    def bracket(self, line: int) -> Node:
        args = self.items("]")
        flat = []
        for a in args:  # [a: 1] is a list of pairs
            flat += a.args if a.kind == "list" and a.args and a.args[0].kind == "pair" and self.keyed(a) else [a]
        return Node("list", args=flat, line=line)

    @staticmethod
    def keyed(node: Node) -> bool:
        return getattr(node, "kind", "") == "list" and all(p.kind == "pair" and p.args[0].lit_type == "atom" for p in node.args)

    def map(self, line: int) -> Node:
        if self.is_("punct", "{"):
            self.step()
            return Node("call", "%{}", self.fields(), line)
        name = self.unary(True) if self.is_("op", "^", "@") else self.struct_name()
        self.need("punct", "{")
        return Node("call", "%", [name, Node("call", "%{}", self.fields(), line)], line)

    def struct_name(self) -> Node:
        token = self.step()
        if token.kind == "alias":
            return Node("call", "__aliases__", [], token.line, "alias", token.value)
        if token.kind == "name":
            node = Node("var", token.value, line=token.line)
            while self.is_("punct", "."):
                self.step()
                node = self.dotted(node, token.line, True)
            return node
        raise SyntaxProblem(f"line {token.line}: unexpected {token.value!r} in a struct")

    def fields(self) -> list[Node]:
        out = []
        for item in self.items("}"):
            if item.kind == "list" and self.keyed(item):
                out += item.args
            elif item.kind == "call" and item.form == "=>":
                out.append(Node("pair", args=item.args, line=item.line))
            elif item.kind == "call" and item.form == "|" and item.args[1].form == "=>":
                pair = item.args[1]
                out.append(Node("call", "|", [item.args[0], Node("list", args=[Node("pair", args=pair.args, line=pair.line)], line=pair.line)], item.line))
            else:
                out.append(item)
        return out

    def name(self, name: str, line: int, no_do: bool) -> Node:
        if name in ("true", "false", "nil"):
            return Node("literal", line=line, lit_type="atom", lit=name)
        if self.is_("punct", "(") and not self.now.space:
            self.step()
            call = Node("call", name, self.items(")"), line)
        elif self.starts_argument():
            call = Node("call", name, self.open_arguments(), line)
        elif self.is_("word", "do") and not no_do:
            call = Node("call", name, [], line)
        else:
            return Node("var", name, line=line)
        if self.is_("word", "do") and not no_do:
            call.args.append(self.do_block())
        return call


def parse(text: str) -> Node:
    """The tree of a source text; raises SyntaxProblem for what this reader doesn't understand."""
    try:
        return Parser(text).program()
    except (IndexError, RecursionError) as e:
        raise SyntaxProblem(f"the text ends too early or nests too deeply: {e}") from None


def rows(root: Node) -> list[tuple]:
    """``(pre, last, parent, ord, depth, kind, form, arg_count, line, lit_type, lit)`` of each node in pre-order; ``last`` is its last descendant."""
    out: list[list] = []
    stack = [(root, -1, 0, 0)]
    while stack:
        node, parent, order, depth = stack.pop()
        if node is None:  # all below row ``parent`` are out
            out[parent][1] = len(out) - 1
            continue
        pre = len(out)
        out.append([pre, pre, parent, order, depth, node.kind, node.form, None if node.kind == "var" else len(node.args), node.line, node.lit_type, node.lit])
        stack.append((None, pre, 0, 0))
        stack += [(a, pre, i, depth + 1) for i, a in reversed(list(enumerate(node.args)))]
        if node.callee is not None:
            stack.append((node.callee, pre, -1, depth + 1))
    return [tuple(r) for r in out]
