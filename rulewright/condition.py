"""The condition language: selections combined by and, or, not, parentheses and counts."""

from __future__ import annotations

import re
from dataclasses import dataclass

from .errors import CompilationError


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Not:
    of: object


@dataclass(frozen=True)
class And:
    left: object
    right: object


@dataclass(frozen=True)
class Or:
    left: object
    right: object


@dataclass(frozen=True)
class Count:
    """At least n (None: all) of the selections that a pattern names (None: them, all of the rule)."""

    n: int | None
    pattern: str | None


Token = tuple[str, str]
_TOKEN = re.compile(r"[ \t\n]+|(?P<paren>[()])|(?P<number>[0-9]+)|(?P<word>[A-Za-z_]\w*(?:[\w*])*)")
# The keywords, in lower case only.
KEYWORDS = ("and", "or", "not", "of", "them", "all")


def tokenize(text: str) -> list[Token]:
    """(kind, text) tokens. Numbers that 32 bits don't hold are skipped; other characters are errors."""
    out, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise CompilationError(f"unexpected character {text[at]!r} in condition")
        at = m.end()
        if m["paren"]:
            out.append((m["paren"], m["paren"]))
        elif m["number"]:
            if int(m["number"]) < 2**32:
                out.append(("number", m["number"]))
        elif word := m["word"]:
            out.append((word if word in KEYWORDS else "pattern" if "*" in word else "name", word))
    return out


class _Parser:
    def __init__(self, tokens: list[Token]):
        self.tokens, self.at = tokens, 0

    def peek(self) -> str:
        return self.tokens[self.at][0] if self.at < len(self.tokens) else "end"

    def take(self, *kinds: str) -> str:
        if self.peek() not in kinds:
            raise CompilationError(f"expected {' or '.join(kinds)} in condition, found {self.peek()}")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def any_of(self):
        left = self.all_of()
        while self.peek() == "or":
            self.at += 1
            left = Or(left, self.all_of())
        return left

    def all_of(self):
        left = self.negated()
        while self.peek() == "and":
            self.at += 1
            left = And(left, self.negated())
        return left

    def negated(self):
        if self.peek() == "not":
            self.at += 1
            return Not(self.primary())
        return self.primary()

    def primary(self):
        kind = self.peek()
        if kind == "(":
            self.at += 1
            inside = self.any_of()
            self.take(")")
            return inside
        if kind == "name":
            return Name(self.take("name"))
        if kind in ("number", "all"):
            n = None if kind == "all" else int(self.take("number"))
            if n is None:
                self.at += 1
            self.take("of")
            if self.peek() == "them":
                self.at += 1
                if n not in (None, 1):
                    raise CompilationError("only '1 of them' and 'all of them' are supported")
                return Count(n, None)
            return Count(n, self.take("pattern"))
        raise CompilationError(f"unexpected {kind} in condition")


def parse(text: str, strict: bool = True):
    """The condition's tree. Text after a whole condition is an error if strict, else ignored."""
    tokens = tokenize(text)
    if not tokens:
        raise CompilationError("empty condition")
    parser = _Parser(tokens)
    tree = parser.any_of()
    if strict and parser.peek() != "end":
        raise CompilationError(f"unexpected {parser.peek()} after the condition")
    return tree
