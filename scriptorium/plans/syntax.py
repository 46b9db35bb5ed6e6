"""Parser of the query language.

    or      := and [ 'OR' or ]
    and     := not [ 'AND' and | and ]          the second without a word between: natural, that is, OR
    not     := 'NOT' not | primary
    primary := '#' INT '(' term ',' term ')' | '(' or ')' | '"' term+ '"' | term
    term    := letters, digits, '_' and ':' of any script

Keywords are whole upper-case words. The whole text must be read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from ..errors import QueryError


@dataclass(frozen=True)
class Term:
    word: str


@dataclass(frozen=True)
class Phrase:
    words: tuple[str, ...]


@dataclass(frozen=True)
class Near:
    distance: int
    left: str
    right: str


@dataclass(frozen=True)
class And:
    parts: tuple


@dataclass(frozen=True)
class Or:
    parts: tuple
    natural: bool = False


@dataclass(frozen=True)
class Not:
    part: object


Node = Term | Phrase | Near | And | Or | Not

_LEX = re.compile(r"""\s*(?:(?P<near>\#\s*(?P<n>\d+))|(?P<mark>[()",])|(?P<word>[\w:]+))""")


def _lex(text: str) -> list[str]:
    out, at = [], 0
    text = text.rstrip()
    while at < len(text):
        found = _LEX.match(text, at)
        if not found:
            raise QueryError(f"can't read {text[at:]!r}")
        out.append(f"#{found['n']}" if found["near"] else found["mark"] or found["word"])
        at = found.end()
    return out


class _Reader:
    def __init__(self, pieces: list[str]):
        self.pieces, self.at = pieces, 0

    def peek(self) -> str | None:
        return self.pieces[self.at] if self.at < len(self.pieces) else None

    def take(self, wanted: str | None = None) -> str:
        piece = self.peek()
        if piece is None or (wanted and piece != wanted):
            raise QueryError(f"expected {wanted or 'more'}, found {piece or 'the end'}")
        self.at += 1
        return piece

    def word(self) -> str:
        piece = self.take()
        if piece in ("AND", "OR", "NOT") or piece[0] in '()",#':
            raise QueryError(f"expected a term, found {piece}")
        return piece

    def any(self) -> Node:
        left = self.every()
        if self.peek() == "OR":
            self.take()
            right = self.any()
            return Or((left, *(right.parts if isinstance(right, Or) and not right.natural else (right,))))
        return left

    def every(self) -> Node:
        left = self.without()
        if self.peek() == "AND":
            self.take()
            right = self.every()
            return And((left, *(right.parts if isinstance(right, And) else (right,))))
        if self.peek() not in (None, "OR", ")"):
            right = self.every()
            return Or((left, *(right.parts if isinstance(right, Or) and right.natural else (right,))), natural=True)
        return left

    def without(self) -> Node:
        if self.peek() == "NOT":
            self.take()
            return Not(self.without())
        return self.primary()

    def primary(self) -> Node:
        piece = self.peek()
        if piece == "(":
            self.take()
            inner = self.any()
            self.take(")")
            return inner
        if piece == '"':
            self.take()
            words = []
            while self.peek() != '"':
                words.append(self.take() if self.peek() in ("AND", "OR", "NOT") else self.word())
            self.take('"')
            if not words:
                raise QueryError("an empty phrase")
            return Phrase(tuple(words))
        if piece and piece[0] == "#":
            distance = int(self.take()[1:])
            self.take("(")
            left = self.word()
            self.take(",")
            right = self.word()
            self.take(")")
            return Near(distance, left, right)
        return Term(self.word())


def parse(text: str) -> Node:
    reader = _Reader(_lex(text))
    if reader.peek() is None:
        raise QueryError("an empty query")
    out = reader.any()
    if reader.peek() is not None:
        raise QueryError(f"unexpected {reader.peek()}")
    return out


def is_natural(node: Node) -> bool:
    """Two terms or more with no operator but juxtaposition."""
    return isinstance(node, Or) and node.natural and all(isinstance(p, Term) and ":" not in p.word for p in node.parts)
