"""Boolean queries: a small grammar, compiled to one Column predicate.

    either = both {OR both};  both = not {AND not};  not = NOT not | word | ( either )
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column

from textloom.functions.text import PLAIN, QUOTES

OPERATORS = ("AND", "OR", "NOT")


class ParseError(ValueError):
    """The query doesn't follow the grammar."""


def words(text: str | None) -> list[str]:
    """Tokens of a query, by the rules of the index."""
    plain = (text or "").translate(str.maketrans(QUOTES, PLAIN)).lower().replace("'", "")
    return [w for w in re.split(r"[^\w]+", plain) if w]


@dataclass(frozen=True)
class Term:
    word: str


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


def has_operators(query: str) -> bool:
    """A parenthesis, or an operator standing alone, in any case."""
    return bool(re.search(r"[()]", query)) or any(w.upper() in OPERATORS for w in query.split())


def symbols(query: str) -> list[str]:
    """Parentheses, operators in capitals, and of each other stretch its first token."""
    out = []
    for raw in re.findall(r"[()]|[^\s()]+", query):
        if raw in "()" or raw.upper() in OPERATORS:
            out.append(raw.upper())
        else:
            out += words(raw)[:1]
    return out


def parse(query: str):
    rest = symbols(query)[::-1]
    if not rest:
        raise ParseError("empty query")

    def chain(operator: str, kind: type, part: Callable):
        left = part()
        while rest and rest[-1] == operator:
            rest.pop()
            left = kind(left, part())
        return left

    def negated():
        if not rest:
            raise ParseError("the query ends where a word is due")
        s = rest.pop()
        if s == "NOT":
            return Not(negated())
        if s == "(":
            inner = either()
            if not rest or rest.pop() != ")":
                raise ParseError("a parenthesis is left open")
            return inner
        if s == ")" or s in OPERATORS:
            raise ParseError(f"unexpected {s}")
        return Term(s)

    def both():
        return chain("AND", And, negated)

    def either():
        return chain("OR", Or, both)

    out = either()
    if rest:
        raise ParseError(f"unexpected {rest[-1]}")
    return out


def leaves(tree) -> list[str]:
    """Distinct words in order of appearance, negated ones included."""
    if isinstance(tree, Term):
        return [tree.word]
    parts = [tree.of] if isinstance(tree, Not) else [tree.left, tree.right]
    return list(dict.fromkeys(w for p in parts for w in leaves(p)))


def predicate(tree, found: Callable[[str], Column]) -> Column:
    if isinstance(tree, Term):
        return found(tree.word)
    if isinstance(tree, Not):
        return ~predicate(tree.of, found)
    left, right = predicate(tree.left, found), predicate(tree.right, found)
    return left & right if isinstance(tree, And) else left | right
