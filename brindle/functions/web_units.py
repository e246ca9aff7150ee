"""What one TypeScript or JavaScript file defines, imports, exports and calls, from its bytes.

There is no parser here, only a scanner: the text becomes flat tokens with
matched brackets, JSX elements are one token each, and definitions, bindings and
calls are recognised by the tokens around them.  It looks for plain module
syntax and prefers to miss a call to inventing one; a file with unmatched
brackets, an unfinished string or tokens that can't be neighbours (see
``web_syntax``) counts as unreadable.  Runs in Python workers.
"""

from __future__ import annotations

import hashlib
import posixpath
import re
from collections.abc import Iterator
from typing import NamedTuple

from .web_syntax import error_in

# Suffixes of the two languages, and words that are no names or begin no call.
TYPESCRIPT, JAVASCRIPT = (".ts", ".tsx", ".mts"), (".js", ".jsx", ".mjs")
SUFFIXES = TYPESCRIPT + JAVASCRIPT
KEYWORDS = frozenset(
    "await break case catch class const continue debugger default delete do else enum export extends finally for function if import in instanceof let new of return static super switch this throw try typeof var void while with yield".split()
)
CONTROL = frozenset("if for while switch catch with".split())
MODIFIERS = frozenset("public private protected static readonly async override abstract declare accessor get set".split())
OPERATORS = (
    ">>>=", "...", "===", "!==", "**=", "<<=", ">>=", ">>>", "&&=", "||=", "??=", "=>", "==", "!=", "<=", ">=", "&&", "||", "??", "?.",
    "++", "--", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "<<", "**",
)
ASSIGN = frozenset(o for o in OPERATORS if o.endswith("=") and o not in ("===", "!==", "==", "!=", "<=", ">=")) | {"="}
PAIRS = {"(": ")", "[": "]", "{": "}", "${": "}"}

SPACE = re.compile(r"(?:\s|//[^\n]*|/\*.*?\*/)*", re.S)
NAME = re.compile(r"#?[A-Za-z_$\u0080-\U0010ffff][\w$\u0080-\U0010ffff]*")
NUMBER = re.compile(r"\.?[0-9](?:[\w.]|(?<=[eE])[+-])*")
STRING = re.compile(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'", re.S)
REGEX = re.compile(r"/(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*")
OPERATOR = re.compile("|".join(map(re.escape, OPERATORS)) + r"|[^\s\w]")


class Unreadable(ValueError):
    """Unmatched brackets, a string, template, comment or element without an end, or tokens that can't be neighbours."""


class Token(NamedTuple):
    kind: str  # name, number, string, regex, jsx, or the bracket or operator itself
    text: str
    start: int
    end: int
    #: Whether a line ends before it.
    fresh: bool


class Scanner:
    """Tokens of a text, and for each bracket the place of its partner."""

    def __init__(self, text: str, jsx: bool):
        self.text, self.jsx, self.at = text, jsx, 0
        self.tokens: list[Token] = []
        self.partner: dict[int, int] = {}
        if self._run(None) is not None:
            raise Unreadable("a bracket too many")

    def _skip(self) -> bool:
        end = SPACE.match(self.text, self.at).end()
        fresh = "\n" in self.text[self.at : end]
        self.at = end
        if self.text.startswith("/*", end):
            raise Unreadable("a comment without an end")
        return fresh

    def _add(self, kind: str, start: int, end: int, fresh: bool) -> int:
        self.tokens.append(Token(kind, self.text[start:end], start, end, fresh))
        self.at = end
        return len(self.tokens) - 1

    def _operand_next(self) -> bool:
        """Whether what comes begins an operand (so a slash begins a pattern, ``<`` an element)."""
        if not self.tokens:
            return True
        last = self.tokens[-1]
        if last.kind == "name":
            return last.text in KEYWORDS - {"this", "super"}
        return last.kind not in ("number", "string", "regex", "jsx", ")", "]", "}", "++", "--")

    def _run(self, closing: str | None) -> int | None:
        """Read up to the closing bracket, or the end; the place of the bracket."""
        while True:
            fresh = self._skip()
            if self.at >= len(self.text):
                if closing:
                    raise Unreadable("a bracket without its partner")
                return None
            start, c = self.at, self.text[self.at]
            if c == "`":
                self._template(fresh)
            elif c in "\"'":
                if not (m := STRING.match(self.text, start)):
                    raise Unreadable("a string without an end")
                self._add("string", start, m.end(), fresh)
            elif m := NAME.match(self.text, start):
                self._add("name", start, m.end(), fresh)
            elif m := NUMBER.match(self.text, start):
                self._add("number", start, m.end(), fresh)
            elif c in PAIRS:
                self._bracket(c, start + 1, fresh)
            elif c in ")]}":
                if c != closing:
                    raise Unreadable("a bracket without its partner")
                return self._add(c, start, start + 1, fresh)
            elif c == "/" and self._operand_next() and (m := REGEX.match(self.text, start)):
                self._add("regex", start, m.end(), fresh)
            elif c == "<" and self.jsx and self._operand_next() and re.compile(r"<(>|[A-Za-z_$][\w$.:-]*(?!\s*,|\s+extends\b|[\w$.:-]))").match(self.text, start):
                self._element()
                self._add("jsx", start, self.at, fresh)
            else:
                self._add((m := OPERATOR.match(self.text, start))[0], start, m.end(), fresh)

    def _bracket(self, kind: str, end: int, fresh: bool) -> None:
        opened = self._add(kind, self.at, end, fresh)
        closed = self._run(PAIRS[kind])
        self.partner[opened], self.partner[closed] = closed, opened

    def _template(self, fresh: bool) -> None:
        start = self.at
        self.at += 1
        while (c := self.text[self.at : self.at + 1]) != "`":
            if not c:
                raise Unreadable("a template without an end")
            if self.text.startswith("${", self.at):
                self._bracket("${", self.at + 2, False)
            else:
                self.at += 1 + (c == "\\")
        self._add("string", start if self.tokens and self.tokens[-1].end <= start or not self.tokens else self.at, self.at + 1, fresh)

    def _element(self) -> None:
        """Pass over an element with its children; nothing in it is kept."""
        kept = len(self.tokens)
        closing = re.compile(r"</\s*[\w$.:-]*\s*>")
        depth = 0
        while True:
            if m := closing.match(self.text, self.at):
                self.at, depth = m.end(), depth - 1
            elif self.text[self.at] == "<":
                self.at += 1
                depth += not self._tag()
            elif self.text[self.at] == "{":
                self._bracket("{", self.at + 1, False)
            else:
                self.at += 1
            if not depth:
                break
            if self.at >= len(self.text):
                raise Unreadable("an element without an end")
        del self.tokens[kept:]
        self.partner = {a: b for a, b in self.partner.items() if a < kept and b < kept}

    def _tag(self) -> bool:
        """Pass over a tag's name and attributes; whether it closes itself."""
        while self.at < len(self.text):
            c = self.text[self.at]
            if self.text.startswith("/>", self.at):
                self.at += 2
                return True
            if c == ">":
                self.at += 1
                return False
            if c == "{":
                self._bracket("{", self.at + 1, False)
            elif c in "\"'":
                self.at = self.text.find(c, self.at + 1) + 1 or len(self.text)
            else:
                self.at += 1
        raise Unreadable("a tag without an end")


class Function(NamedTuple):
    """Tokens of a function: parameters (from, to), body (from, to), its private name, and whether it is static."""

    params: tuple[int, int]
    body: tuple[int, int]
    own_name: str | None
    static: bool


class Module:
    """Definitions, bindings and calls of one file's tokens."""

    def __init__(self, path: str, text: str):
        self.path, self.text = path, text
        scanned = Scanner(text, not path.endswith((".ts", ".mts")))
        self.tokens, self.partner = scanned.tokens, scanned.partner
        if wrong := error_in(self.tokens, lambda at: text.count("\n", 0, at) + 1):
            raise Unreadable(wrong)
        self.warnings: list[str] = []
        self.imports: dict[str, tuple[str, str] | None] = {}
        self.preamble: list[str] = []
        self.exports: dict[str, str | None] = {}
        #: name: owner, function, and where its excerpt begins and ends; None if it is defined twice
        self.definitions: dict[str, tuple[str | None, Function, int, int] | None] = {}
        self.unsafe: set[str] = set()
        self._statements()

    # tokens

    def kind(self, i: int) -> str:
        return self.tokens[i].kind if 0 <= i < len(self.tokens) else ""

    def word(self, i: int) -> str:
        """The text of a name, else nothing."""
        return self.tokens[i].text if self.kind(i) == "name" else ""

    def after(self, i: int) -> int:
        """The place after a token, or after the partner of an opening bracket."""
        return self.partner[i] + 1 if self.kind(i) in PAIRS else i + 1

    def continues(self, i: int) -> bool:
        """Whether the token at ``i`` goes on with what comes before it, though it is on a new line."""
        last, next_ = self.tokens[i - 1], self.tokens[i]
        if last.kind in ("=>", ",", ".", "?.", "(", "[", ":", "?", "...") or last.kind not in ("name", "number", "string", "regex", "jsx", ")", "]", "}", "++", "--", ";"):
            return True
        if last.kind == "name" and last.text in KEYWORDS - {"this", "super", "break", "continue", "return", "debugger"}:
            return True
        if next_.kind == "name":
            return next_.text in ("in", "instanceof", "as", "satisfies", "of")
        return next_.kind not in ("number", "string", "regex", "jsx", "{", "}", "++", "--", "@", ";")

    def end_of(self, i: int, stop: int, *marks: str) -> int:
        """Where the expression or statement from ``i`` ends: at one of the marks, a semicolon, or a line that doesn't go on."""
        at = i
        while at < stop:
            k = self.kind(at)
            if k == ";" or k in marks or at > i and self.tokens[at].fresh and not self.continues(at):
                return at
            at = self.after(at)
        return stop

    # functions

    def function_at(self, i: int, stop: int, static: bool = False) -> tuple[Function, int] | None:
        """The function expression or declaration that begins at ``i``, and the place after it."""
        at = i + (self.word(i) == "async" and not (self.kind(i + 1) == "=>"))
        if self.word(at) == "function":
            at += 1 + (self.kind(at + 1) == "*")
            name = self.word(at) or None
            return self._with_body(at + bool(name), stop, name, static)
        if self.kind(at) == "name" and self.kind(at + 1) == "=>" and self.word(at) not in KEYWORDS:
            return self._arrow((at, at + 1), at + 2, stop, static)
        at = self._past_types(at)
        if self.kind(at) != "(":
            return None
        closed = self.partner[at]
        arrow = closed + 1
        if self.kind(arrow) == ":":
            arrow = self.end_of(arrow + 1, stop, "=>", ",", "=", "{") if self.kind(arrow + 1) != "{" else self.after(arrow + 1)
        return self._arrow((at + 1, closed), arrow + 1, stop, static) if arrow < stop and self.kind(arrow) == "=>" else None

    def _past_types(self, at: int) -> int:
        """The place after type parameters or arguments, if these are at ``at``."""
        if self.kind(at) != "<":
            return at
        depth, i = 0, at
        while i < len(self.tokens):
            k = self.kind(i)
            depth += (k == "<") - (k == ">") - 2 * (k == ">>")
            if depth <= 0:
                return i + 1
            if k == ";":
                break
            i = self.after(i)
        return at

    def _with_body(self, at: int, stop: int, name: str | None, static: bool) -> tuple[Function, int] | None:
        """Parameters, a result type and a block from ``at``; None for a mere signature."""
        at = self._past_types(at)
        if self.kind(at) != "(":
            return None
        closed, at = self.partner[at], at + 1
        body = closed + 1
        if self.kind(body) == ":":
            body += 1
            if self.kind(body) == "{":  # an object type
                body = self.after(body)
            while body < stop and self.kind(body) not in ("{", ";") and not (self.tokens[body].fresh and not self.continues(body)):
                body = self.after(body)
        if self.kind(body) != "{":
            return None
        return Function((at, closed), (body + 1, self.partner[body]), name, static), self.partner[body] + 1

    def _arrow(self, params: tuple[int, int], body: int, stop: int, static: bool) -> tuple[Function, int]:
        if self.kind(body) == "{":
            return Function(params, (body + 1, self.partner[body]), None, static), self.partner[body] + 1
        end = self.end_of(body, stop, ",", ")", "]", "}")
        return Function(params, (body, end), None, static), end

    # statements

    def _statements(self) -> None:
        at, n = 0, len(self.tokens)
        while at < n:
            at = max(at + 1, self._statement(at, n))
        for i in self._own(0, n):
            self.unsafe |= self._assigned(i)
        if self.unsafe:
            self.warnings.append(f"Reassigned module bindings are not resolved ({', '.join(sorted(self.unsafe))}): {self.path}")

    def _statement(self, i: int, n: int) -> int:
        word = self.word(i)
        if word == "import" and self.kind(i + 1) not in ("(", "."):
            return self._import(i, n)
        if word == "export":
            return self._export(i, n)
        return self._declaration(i, n, i)[1]

    def _declaration(self, i: int, n: int, start: int) -> tuple[list[str], int]:
        """Note what is defined from ``i`` on (its excerpt from ``start``); the names, and the place after it."""
        word = self.word(i)
        if word == "function" or word == "async" and self.word(i + 1) == "function" and not self.tokens[i + 1].fresh:
            found = self.function_at(i, n)
            if found and found[0].own_name:
                name = found[0].own_name
                self._define(name, None, found[0]._replace(own_name=None), start, found[1])
                return [name], found[1]
        elif word in ("const", "let", "var") and self.word(i + 1) != "enum":
            return self._variables(i + 1, n, start)
        elif word == "class" and self.word(i + 1) and self.word(i + 1) not in ("extends", "implements"):
            return [], self._class(i, n)
        end = self.end_of(i, n)
        return [], end + (self.kind(end) == ";")

    def _define(self, name: str, owner: str | None, function: Function, start: int, end: int) -> None:
        if name in self.definitions:
            self.definitions[name] = None
            self.warnings.append(f"Ambiguous duplicate definition {name!r}: {self.path}")
        else:
            self.definitions[name] = (owner, function, start, end)

    def _variables(self, at: int, n: int, start: int) -> tuple[list[str], int]:
        made: list[tuple[str, Function]] = []
        while True:
            equals = self.end_of(at, n, "=", ",")
            end = equals
            if self.kind(equals) == "=":
                found = self.function_at(equals + 1, n)
                end = self.end_of(equals + 1, n, ",")
                whole = found and (found[1] == end or end == n or found[1] >= end)
                if whole and self.kind(at) == "name" and self.kind(at + 1) in (":", "=", "!"):
                    made.append((self.word(at), found[0]))
                    end = found[1]
            if self.kind(end) != ",":
                break
            at = end + 1
        end += self.kind(end) == ";"
        for name, function in made:
            self._define(name, None, function, start, end)
        return [name for name, _ in made], end

    def _class(self, i: int, n: int) -> int:
        owner, at = self.word(i + 1), i + 2
        while at < n and self.kind(at) != "{":
            at = self._past_types(at) if self.kind(at) == "<" else self.after(at)
        if at >= n:
            return n
        end, at = self.partner[at], at + 1
        while at < end:
            at = max(at + 1, self._member(owner, at, end))
        return end + 1

    def _member(self, owner: str, at: int, end: int) -> int:
        while self.kind(at) == "@":  # decorators are no part of an excerpt
            at = self.after(at + 1)
            while self.kind(at) in (".", "("):
                at = self.after(at + (self.kind(at) == "."))
        start, static = at, False
        while self.word(at) in MODIFIERS and self.kind(at + 1) not in ("(", "=", ";", ":", "<", "?", "!", "}") or self.kind(at) == "*":
            static |= self.word(at) == "static"
            at += 1
        if self.kind(at) == "{":  # a static block
            return self.after(at)
        name = self.word(at)
        begin = self.after(at)
        begin += self.kind(begin) == "?"
        found = self._with_body(begin, end, None, static) if self.kind(begin) in ("(", "<") else None
        if found:
            if name and not name.startswith("#"):
                self._define(f"{owner}.{name}", owner, found[0], start, found[1])
            return found[1]
        stop = self.end_of(at, end)
        return stop + (self.kind(stop) == ";")

    # imports and exports

    def _import(self, i: int, n: int) -> int:
        end = next((k for k in range(i, n) if self.kind(k) == "string" or self.kind(k) == ";" or k > i and self.tokens[k].fresh and self.word(k) in ("import", "export", "const", "function", "class")), n)
        if self.kind(end) != "string" or self.kind(i + 2) == "=":
            self.warnings.append(f"Unsupported import syntax: {self.path}")
            return min(end + 1, n)
        after = end + 1
        if self.word(after) in ("with", "assert") and self.kind(after + 1) == "{":
            after = self.after(after + 1)
        after += self.kind(after) == ";"
        self.preamble.append(self.text[self.tokens[i].start : self.tokens[after - 1].end])
        if end == i + 1 or self.word(i + 1) == "type" and self.word(i + 2) != "from":
            return after
        module = self.tokens[end].text[1:-1]
        if not module.startswith("."):
            self.warnings.append(f"Unresolved package/alias import {module!r}: {self.path}")
        k = i + 1
        while self.word(k) != "from" or k == i + 1:
            if self.kind(k) == "*":
                self._bind(self.word(k + 2), module, "*")
                k += 3
            elif self.kind(k) == "{":
                for original, local in self._specifiers(k):
                    self._bind(local, module, original)
                k = self.after(k)
            else:
                if self.word(k):
                    self._bind(self.word(k), module, "default")
                k += 1
            if k >= end:
                break
        return after

    def _bind(self, local: str, module: str, exported: str) -> None:
        if local in self.imports:
            self.imports[local] = None
            self.warnings.append(f"Ambiguous import binding {local!r}: {self.path}")
        else:
            self.imports[local] = (module, exported)

    def _specifiers(self, i: int) -> Iterator[tuple[str, str]]:
        """(name, alias) of each entry between braces that isn't a type."""
        for a, b in self.entries(i + 1, self.partner[i]):
            words = [self.word(k) for k in range(a, b)]
            if words and not (words[0] == "type" and len(words) > 1 and words[1] != "as"):
                yield words[0], words[-1]

    def _put(self, exported: str, local: str) -> None:
        if self.exports.setdefault(exported, local) not in (local, None):
            self.exports[exported] = None
            self.warnings.append(f"Ambiguous ESM export {exported!r}: {self.path}")

    def _export(self, i: int, n: int) -> int:
        k, word = i + 1, self.word(i + 1)
        if word == "type" or self.kind(k) in ("*", "{"):
            end = self.end_of(k, n)
            words = {self.word(x) for x in range(self.after(k), end)}
            if word != "type":
                if "from" in words or self.kind(k) == "*":
                    self.warnings.append(f"Unsupported ESM re-export: {self.path}")
                else:
                    for local, exported in self._specifiers(k):
                        self._put(exported, local)
            return end + (self.kind(end) == ";")
        default = word == "default"
        k += default
        known = set(self.definitions)
        names, end = self._declaration(k, n, i)
        classed = self.word(k) == "class" and bool(self.word(k + 1)) and self.word(k + 1) not in ("extends", "implements")
        for name in names:
            self._put("default" if default else name, name)
        if default and not names:
            if self.kind(k) == "name" and self.word(k) not in KEYWORDS and end - k - (self.kind(end - 1) == ";") == 1:
                self._put("default", self.word(k))
            elif not (classed and set(self.definitions) - known):
                self.warnings.append(f"Unsupported anonymous/default export: {self.path}")
        return end

    # names

    def entries(self, a: int, b: int) -> Iterator[tuple[int, int]]:
        """What stands between the commas."""
        while a < b:
            end = a
            while end < b and self.kind(end) != ",":
                end = self._past_types(end) if self.kind(end) == "<" and self._past_types(end) > end else self.after(end)
            if end > a:
                yield a, min(end, b)
            a = end + 1

    def bound(self, a: int, b: int) -> set[str]:
        """Names that a pattern binds, no property keys, types or defaults."""
        while a < b and (self.kind(a) in ("...", "@") or self.word(a) in MODIFIERS and self.kind(a + 1) in ("name", "{", "[")):
            a += 1
        if self.kind(a) == "[":
            return set().union(*(self.bound(*e) for e in self.entries(a + 1, self.partner[a])))
        if self.kind(a) == "{":
            out: set[str] = set()
            for x, y in self.entries(a + 1, self.partner[a]):
                key = self.after(x)
                out |= self.bound(key + 1, y) if self.kind(key) == ":" else self.bound(x, y)
            return out
        return {self.word(a)} if self.word(a) and self.word(a) != "this" else set()

    def _own(self, a: int, b: int) -> Iterator[int]:
        """Tokens from ``a`` to ``b`` that are in no function, class, type or interface inside."""
        i = a
        while i < b:
            word = self.word(i)
            inner = None
            if self.kind(i - 1) not in (".", "?."):
                if word == "class" or word in ("interface", "enum", "namespace") and self.word(i + 1):
                    yield i
                    while i < b and self.kind(i) != "{":
                        i = self._past_types(i) if self.kind(i) == "<" else i + 1
                    i = self.after(i) if i < b else b
                    continue
                if word == "type" and self.word(i + 1) and self.kind(i + 2) in ("=", "<"):
                    i = self.end_of(i, b)
                    continue
                if word in ("function", "async") or self.kind(i) == "(" or word and self.kind(i + 1) == "=>":
                    inner = self.function_at(i, b) if not (self.kind(i) == "(" and self._called(i) and self.kind(self.after(i)) != "=>") else None
                if inner is None and word and word not in KEYWORDS and self.kind(i + 1) in ("(", "<"):
                    inner = self._with_body(i + 1, b, None, False)  # a method of an object
            if inner:
                yield i
                i = max(inner[1], i + 1)
                continue
            yield i
            i += 1

    def _called(self, i: int) -> bool:
        """Whether the parenthesis at ``i`` holds arguments."""
        last = self.kind(i - 1)
        if last == "name":
            return self.word(i - 1) not in KEYWORDS or self.word(i - 1) in ("super", "import") or self.kind(i - 2) in (".", "?.")
        if last == ")":
            return self.word(self.partner[i - 1] - 1) not in CONTROL
        return last in ("]", "?.", "string", "jsx") or last == ">" and self._before_types(i - 1) is not None

    def _before_types(self, close: int) -> int | None:
        """The name that has the type arguments which end at ``close``."""
        depth = 0
        for k in range(close, max(-1, close - 64), -1):
            depth += (self.kind(k) == ">") - (self.kind(k) == "<")
            if not depth:
                return k - 1 if self.word(k - 1) and self.tokens[k - 1].end == self.tokens[k].start else None
            if self.kind(k) not in ("name", "string", "number", ",", ".", "[", "]", "|", "&", "<", ">"):
                return None
        return None

    def _assigned(self, i: int) -> set[str]:
        """Names that the assignment operator at ``i``, if it is one, gives a new value."""
        if self.kind(i) not in ASSIGN:
            return set()
        left = i - 1
        if self.kind(left) in ("]", "}"):
            first = self.partner[left]
            declared = self.word(first - 1) in ("const", "let", "var")
            member = self.kind(left) == "]" and (self.kind(first - 1) in (")", "]", ".") or self.kind(first - 1) == "name" and self.word(first - 1) not in KEYWORDS)
            return set() if declared or member else self.bound(first, left + 1)
        if not self.word(left) or self.kind(left - 1) in (".", "?."):
            return set()
        return set() if self._declares(left) else {self.word(left)}

    def _declares(self, i: int) -> bool:
        """Whether the name at ``i`` stands in a list of declared variables (or a type alias)."""
        k = i
        while k > 0:
            before = self.kind(k - 1)
            if self.word(k - 1) in ("const", "let", "var", "type", "import"):
                return True
            if before in (";", "{", "(", "[", "${") or self.tokens[k].fresh and before not in (",", "=", ":") and not self.continues(k):
                return False
            k = self.partner[k - 1] if before in (")", "]", "}") else k - 1
        return False

    def hidden(self, f: Function) -> set[str]:
        """Names that mean something else inside a function: function-wide, which may lose a call but invents none."""
        names = set().union(*(self.bound(*e) for e in self.entries(*f.params)))
        names |= {f.own_name} if f.own_name else set()
        for i in self._own(*f.body):
            word = self.word(i)
            names |= self._assigned(i)
            if self.kind(i - 1) in (".", "?."):
                continue
            if word in ("const", "let", "var"):
                at = i + 1
                while True:
                    end = self.end_of(at, f.body[1], ",")
                    names |= self.bound(at, end)
                    if self.kind(end) != ",":
                        break
                    at = end + 1
            elif word == "catch" and self.kind(i + 1) == "(":
                names |= self.bound(i + 2, self.partner[i + 1])
            elif word in ("function", "class"):
                k = i + 1 + (self.kind(i + 1) == "*")
                names |= {self.word(k)} if self.word(k) else set()
            elif word == "async" and self.word(i + 1) == "function":
                names |= {self.word(i + 2)} if self.word(i + 2) else set()
        return names

    # calls

    def calls(self, owner: str | None, f: Function) -> list[dict]:
        """A fact per call of a function's own body: local, import or unresolved."""
        hidden, facts = self.hidden(f) | self.unsafe, []
        own = set(self._own(*f.body))
        for i in sorted(own):
            if self.kind(i) != "(" or not self._called(i) or self.function_at(i, f.body[1]):
                continue
            at = i - 1 - (self.kind(i - 1) == "?.")
            if self.kind(at) == ">":
                at = self._before_types(at)
            if self.word(at - 1) == "new" or self._constructed(at):
                continue
            facts.append({"kind": "unresolved", "name": None, "module": None, "export": None} | self._meaning(at, owner, f, hidden))
        return facts

    def _constructed(self, at: int) -> bool:
        """Whether a dotted name that ends at ``at`` comes after ``new``."""
        while self.kind(at) == "name" and self.kind(at - 1) == "." and self.kind(at - 2) == "name":
            at -= 2
        return self.word(at - 1) == "new"

    def _meaning(self, at: int, owner: str | None, f: Function, hidden: set[str]) -> dict:
        name, dotted = self.word(at), self.kind(at - 1) in (".", "?.")
        if not name:
            return {}
        if not dotted:
            if name in hidden or name in KEYWORDS:
                return {}
            if name not in self.imports:
                return {"kind": "local", "name": name}
            found = self.imports[name]
            return {"kind": "import", "module": found[0], "export": found[1]} if found else {}
        head = self.word(at - 2)
        if not head or self.kind(at - 3) in (".", "?.") or name.startswith("#"):
            return {}
        if head == "this":
            other = self.definitions.get(f"{owner}.{name}")
            return {"kind": "local", "name": f"{owner}.{name}"} if owner and (not other or other[1].static == f.static) else {}
        found = self.imports.get(head)
        return {"kind": "import", "module": found[0], "export": name} if found and found[1] == "*" and head not in hidden else {}


def base_of(path: str, module: str) -> str | None:
    """A relative module's name joined to the importing file's folder; None if it leaves the tree."""
    if not module.startswith(".") or "\\" in module:
        return None
    base = posixpath.normpath(posixpath.join(posixpath.dirname(path), module))
    return None if base in ("..", "/") or base.startswith(("../", "/")) else base


def web_unit(path: str, raw: bytes) -> dict:
    """A row of ``schemas.UNIT``; without a hash if the file can't be read."""
    unit = {"path": path, "hash": None, "module": None, "warnings": [], "aliases": {}, "symbols": [], "calls": [], "web": None}
    try:
        text = raw.decode()
        found = Module(path, text)
    except UnicodeDecodeError:
        return unit | {"warnings": [f"Cannot parse {path}: invalid UTF-8"]}
    except Unreadable as e:
        return unit | {"warnings": [f"Cannot parse {path}: {e}"]}
    except (RecursionError, LookupError) as e:  # too deep, or no module syntax: said, not guessed at
        return unit | {"warnings": [f"Cannot parse {path}: {type(e).__name__}"]}
    names = [t.text if t.kind == "name" else "" for t in found.tokens]
    if any(a == "require" and found.kind(i + 1) == "(" and found.kind(i - 1) not in (".", "?.") for i, a in enumerate(names)):
        found.warnings.append(f"Unsupported CommonJS require: {path}")
    if any(t.kind == "jsx" for t in found.tokens):
        found.warnings.append(f"Unsupported JSX component/reference resolution: {path}")
    module = path.rpartition(".")[0].replace("/", ".")
    language = "typescript" if path.endswith(TYPESCRIPT) else "javascript"
    symbols, calls = [], []
    for name, known in found.definitions.items():
        if known is None:
            continue
        owner, function, first, end = known
        start, stop = found.tokens[first].start, found.tokens[end - 1].end
        symbols.append({
            "id": f"{path}:{name}", "path": path, "name": name, "module": module, "owner": owner, "start": text.count("\n", 0, start) + 1, "end": text.count("\n", 0, stop) + 1,
            "source": text[start:stop], "preamble": "\n".join(found.preamble), "language": language,
        })
        calls += [{"symbol": f"{path}:{name}"} | fact for fact in found.calls(owner, function)]
    modules = sorted({b[0] for b in found.imports.values() if b})
    web = {
        "calls": calls, "imports": [{"module": m, "base": base} for m in modules if (base := base_of(path, m))],
        "exports": [{"export": e, "local": local} for e, local in found.exports.items() if local], "unsafe": sorted(found.unsafe),
    }
    return unit | {"hash": hashlib.sha256(raw).hexdigest(), "module": module, "warnings": found.warnings, "symbols": symbols, "web": web}
