"""The query language: words, "phrases", AND, OR, NOT and parentheses; adjacent operands mean AND."""

from __future__ import annotations

import re
import sys
from dataclasses import dataclass, field

from ..functions.text import query_terms, terms_of

#: Nested operators and parentheses at most.
DEPTH = 256

_LEX = re.compile(r"""[ \t\n\r\x0b\f]+|(?P<paren>[()])|"(?P<phrase>[^"]*)"|(?P<open>")|(?P<word>[^ \t\n\r\x0b\f()"]+)""")


class QueryError(ValueError):
    """A query that is none; the message says why."""


@dataclass(frozen=True)
class Token:
    kind: str  # term, phrase, and, or, not, (, )
    text: str = ""

    def __str__(self) -> str:
        return {"term": self.text, "phrase": f'"{self.text}"'}.get(self.kind, self.kind.upper())


@dataclass
class Node:
    kind: str  # term, phrase, and, or, not
    text: str = ""
    children: list[Node] = field(default_factory=list)

    def __str__(self) -> str:
        return "(" + " ".join([self.kind, *([self.text] if self.text else []), *map(str, self.children)]) + ")"


def lex(query: str) -> list[Token]:
    out = []
    for m in _LEX.finditer(query):
        if m["open"]:
            raise QueryError("unterminated quote")
        if m["paren"]:
            out.append(Token(m["paren"]))
        elif m["phrase"] is not None:
            out.append(Token("phrase", m["phrase"]))
        elif m["word"]:
            out.append(Token(m["word"].lower()) if m["word"] in ("AND", "OR", "NOT") else Token("term", m["word"]))
    return out


def parse(query: str) -> Node:
    """The tree of a query. NOT binds closest, then AND, then OR; chains of one operator are one node."""
    tokens = lex(query)
    if not tokens:
        raise QueryError("empty query")
    at = depth = 0

    def here() -> str:
        return tokens[at].kind if at < len(tokens) else ""

    def joined(kind: str, parts: list[Node]) -> Node:
        return parts[0] if len(parts) == 1 else Node(kind, children=parts)

    def either() -> Node:
        nonlocal at
        parts = [both()]
        while here() == "or":
            at += 1
            parts.append(both())
        return joined("or", parts)

    def both() -> Node:
        nonlocal at
        parts = [single()]
        while here() in ("and", "term", "phrase", "(", "not"):
            at += here() == "and"
            parts.append(single())
        return joined("and", parts)

    def single() -> Node:
        nonlocal at, depth
        depth += 1
        if depth > DEPTH:
            raise QueryError("query nested too deeply")
        if here() == "not":
            at += 1
            node = Node("not", children=[single()])
        else:
            node = operand()
        depth -= 1
        return node

    def operand() -> Node:
        nonlocal at
        kind = here()
        if kind in ("term", "phrase"):
            at += 1
            return Node(kind, tokens[at - 1].text)
        if kind == "(":
            at += 1
            inner = either()
            if here() != ")":
                raise QueryError("missing closing parenthesis")
            at += 1
            return inner
        raise QueryError({"": "unexpected end of query", ")": "unexpected closing parenthesis"}.get(kind, "unexpected operator"))

    sys.setrecursionlimit(max(sys.getrecursionlimit(), 12 * DEPTH))  # some frames for each level
    root = either()
    if at < len(tokens):
        raise QueryError("unexpected token after end of query")
    return root


@dataclass(frozen=True)
class Leaf:
    """Terms that must stand at these distances from the first."""

    terms: tuple[str, ...]
    offsets: tuple[int, ...]


@dataclass
class Plan:
    """A tree whose leaves are analyzed and whose unconstrained nodes are gone."""

    kind: str  # leaf, and, or, not
    leaf: Leaf | None = None
    children: list[Plan] = field(default_factory=list)

    def leaves(self) -> list[Leaf]:
        return [self.leaf] if self.leaf else [x for c in self.children for x in c.leaves()]

    def holds(self, found) -> bool:
        """Truth of the tree for a document of which ``found(leaf)`` says what it has."""
        if self.leaf:
            return found(self.leaf)
        if self.kind == "not":
            return not self.children[0].holds(found)
        return (all if self.kind == "and" else any)(c.holds(found) for c in self.children)


def constrained(node: Node) -> Plan | None:
    """The plan of a tree, or None where it says nothing: a leaf of stopwords or marks constrains nothing, an operator passes over
    such children, and one without others constrains nothing itself."""
    if node.kind in ("term", "phrase"):
        found = terms_of(node.text)
        if not found:
            return None
        first = found[0][0]
        return Plan("leaf", Leaf(tuple(t for _, t in found), tuple(p - first for p, _ in found)))
    children = [p for c in node.children if (p := constrained(c))]
    if not children:
        return None
    return Plan(node.kind, children=children) if node.kind == "not" or len(children) > 1 else children[0]


def scoring_terms(query: str) -> list[str]:
    """Terms of all words and phrases, those under NOT too, in order and as often as they come."""
    return [t for x in lex(query) if x.kind in ("term", "phrase") for t in query_terms([x.text])]


def word_count(query: str) -> int:
    return sum(len([w for w in re.split(r"[ \t\n\r]+", x.text) if w]) for x in lex(query) if x.kind in ("term", "phrase"))


def respell(tokens: list[Token]) -> str:
    out = ""
    for t in tokens:
        s = str(t)
        out += (" " if out and out[-1] != "(" and s != ")" else "") + s
    return out


def bag_of_words(text: str) -> str:
    """A judged query's words joined by OR: quotes and parentheses removed, ASCII in lower case."""
    cleaned = re.sub(r'["()]', "", text)
    words = [re.sub("[A-Z]+", lambda m: m[0].lower(), w) for w in cleaned.split()]
    return " OR ".join(words)
