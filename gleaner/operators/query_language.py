"""The search language: words, phrases, prefixes, AND, OR, NOT, NEAR/n; parsed on the driver into small trees."""

from __future__ import annotations

import re
from dataclasses import dataclass

# Opt-in synonyms.
SYNONYMS = {
    "ai": ("artificial intelligence", "machine learning", "ml"), "ml": ("machine learning", "ai"), "api": ("application programming interface",), "db": ("database", "data base"), "js": ("javascript",),
    "ts": ("typescript",), "ui": ("user interface", "interface"), "ux": ("user experience",), "os": ("operating system",),
}


@dataclass(frozen=True)
class Words:
    """A run of tokens; the last is a prefix if prefix is set. One token is a plain word."""

    tokens: tuple[str, ...]
    prefix: bool = False


@dataclass(frozen=True)
class And:
    parts: tuple


@dataclass(frozen=True)
class Or:
    parts: tuple


@dataclass(frozen=True)
class Not:
    keep: object
    drop: object


@dataclass(frozen=True)
class Near:
    first: Words
    second: Words
    distance: int


def nears(tree: object) -> list[Near]:
    if isinstance(tree, Near):
        return [tree]
    return [] if isinstance(tree, Words) else [n for p in ((tree.keep, tree.drop) if isinstance(tree, Not) else tree.parts) for n in nears(p)]


_LEX = re.compile(r'"([^"]*)"|\(|\)|[^\s()"]+')
_TOKEN = re.compile(r"[^\W_]+")


def tokens_of(text: str) -> tuple[str, ...]:
    return tuple(_TOKEN.findall(text.lower()))


def leaves(tree: object) -> list[Words]:
    """All phrases of a tree, in order, each once."""
    if isinstance(tree, Words):
        found = [tree]
    elif isinstance(tree, Near):
        found = [tree.first, tree.second]
    elif isinstance(tree, Not):
        found = leaves(tree.keep) + leaves(tree.drop)
    else:
        found = [leaf for part in tree.parts for leaf in leaves(part)]
    return list(dict.fromkeys(found))


class _Parser:
    """or := and (OR and)*; and := not ((AND)? not)*; not := term (NOT term)*; term := phrase | word[*] | ( or )"""

    def __init__(self, text: str, prefix: bool, near: bool):
        self.items = [(m[0], m[1]) for m in _LEX.finditer(text)]
        self.at, self.prefix, self.near = 0, prefix, near

    def _peek(self) -> str:
        return self.items[self.at][0].upper() if self.at < len(self.items) else ""

    def either(self) -> object | None:
        parts = [self.both()]
        while self._peek() == "OR":
            self.at += 1
            parts.append(self.both())
        parts = [p for p in parts if p]
        return parts[0] if len(parts) == 1 else Or(tuple(parts)) if parts else None

    def both(self) -> object | None:
        parts = [self.without()]
        while self._peek() not in ("", "OR", ")"):
            self.at += self._peek() == "AND"
            parts.append(self.without())
        parts = [p for p in parts if p]
        return parts[0] if len(parts) == 1 else And(tuple(parts)) if parts else None

    def without(self) -> object | None:
        tree = self.term()
        while self._peek() == "NOT" or self.near and re.fullmatch(r"NEAR/\d+", self._peek()):
            operator = self._peek()
            self.at += 1
            right = self.term()
            if operator != "NOT" and isinstance(tree, Words) and isinstance(right, Words):
                tree = Near(tree, right, int(operator.partition("/")[2]))
            elif tree and right:
                tree = Not(tree, right)
        return tree

    def term(self) -> object | None:
        if self.at >= len(self.items):
            return None
        whole, quoted = self.items[self.at]
        self.at += 1
        if whole == "(":
            tree = self.either()
            self.at += self._peek() == ")"
            return tree
        if whole == ")":
            return None
        found = tokens_of(quoted if whole[0] == '"' else whole)
        if not found:
            return None
        return Words(found, whole[0] != '"' and (whole.endswith("*") or self.prefix and len(whole) >= 3))


def parse(query: str, synonyms: bool = False, near: bool = False) -> object | None:
    """The tree of a query, or None if it has no words.

    A query that begins and ends with a quote is one phrase. Explicit Boolean terms
    of three characters or more are prefixes, but not where NOT is used. A plain
    list of words is an AND whose first word, if of three characters or more, is a
    prefix.
    """
    text = query.strip()
    if len(text) > 2 and text[0] == text[-1] == '"':
        found = tokens_of(text)
        return Words(found) if found else None
    operators = set(re.findall(r"\b(and|or|not)\b", text.lower().replace('"', " ")) if re.search(r"\s(and|or|not)\s", f" {text} ", re.I) else ())
    if operators or near and re.search(r"\sNEAR/\d+\s", text, re.I):
        tree = _Parser(text, "not" not in operators and bool(operators), near).either()
    else:
        parts = [w for w in (_Parser(item, False, False).term() for item in re.findall(r'"[^"]*"|[^\s"()]+', text)) if w]
        if parts and isinstance(parts[0], Words) and len(parts[0].tokens) == 1 and len(parts[0].tokens[0]) >= 3:
            parts[0] = Words(parts[0].tokens, True)
        tree = (parts[0] if len(parts) == 1 else And(tuple(parts))) if parts else None
    return widened(tree) if synonyms and tree else tree


def widened(tree: object) -> object:
    """Each single word that has synonyms becomes an OR with them."""
    if isinstance(tree, Words):
        others = SYNONYMS.get(tree.tokens[0], ()) if len(tree.tokens) == 1 else ()
        return Or((tree, *(Words(tokens_of(o)) for o in others))) if others else tree
    if isinstance(tree, And | Or):
        return type(tree)(tuple(map(widened, tree.parts)))
    return Not(widened(tree.keep), widened(tree.drop)) if isinstance(tree, Not) else tree
