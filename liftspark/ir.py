"""The expression language that functions are read into."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass, fields


class Node:
    """An immutable expression."""

    def children(self) -> Iterator[Node]:
        for f in fields(self):
            v = getattr(self, f.name)
            if isinstance(v, Node):
                yield v
            elif isinstance(v, tuple):
                yield from (x for x in v if isinstance(x, Node))

    def document(self) -> list:
        """Nested lists that JSON can hold; floats as hex, so that they are exact."""

        def plain(v):
            if isinstance(v, Node):
                return v.document()
            if isinstance(v, tuple):
                return [plain(x) for x in v]
            if isinstance(v, float):
                return ["f", v.hex()]
            if isinstance(v, bytes):
                return ["b", v.hex()]
            return v

        return [type(self).__name__, *(plain(getattr(self, f.name)) for f in fields(self))]


def size(node: Node) -> int:
    return 1 + sum(size(c) for c in node.children())


def depth(node: Node) -> int:
    return 1 + max((depth(c) for c in node.children()), default=0)


def canonical_json(node: Node) -> str:
    return json.dumps(node.document(), sort_keys=True, separators=(",", ":"), ensure_ascii=True)


def digest(node: Node) -> str:
    return hashlib.sha256(canonical_json(node).encode()).hexdigest()


@dataclass(frozen=True)
class Arg(Node):
    index: int
    name: str


@dataclass(frozen=True)
class Const(Node):
    value: object


@dataclass(frozen=True)
class Binary(Node):
    op: str  # add sub mul truediv mod
    left: Node
    right: Node


@dataclass(frozen=True)
class Negate(Node):
    value: Node


@dataclass(frozen=True)
class Compare(Node):
    op: str  # eq ne lt le gt ge
    left: Node
    right: Node


@dataclass(frozen=True)
class IsNone(Node):
    value: Node


@dataclass(frozen=True)
class Not(Node):
    value: Node


@dataclass(frozen=True)
class Truth(Node):
    """What ``if value`` asks."""

    value: Node


@dataclass(frozen=True)
class Cast(Node):
    target: str  # bool int float str
    value: Node


@dataclass(frozen=True)
class Select(Node):
    """Only the chosen side is evaluated."""

    condition: Node
    yes: Node
    no: Node


@dataclass(frozen=True)
class Field(Node):
    value: Node
    key: str


@dataclass(frozen=True)
class Lookup(Node):
    """Element of a mapping or sequence; absent ones raise."""

    value: Node
    key: Node


@dataclass(frozen=True)
class MakeTuple(Node):
    items: tuple[Node, ...]


@dataclass(frozen=True)
class MakeList(Node):
    items: tuple[Node, ...]


@dataclass(frozen=True)
class Call(Node):
    model: str  # len abs lower upper startswith endswith strip contains replace
    args: tuple[Node, ...]


@dataclass(frozen=True)
class OneOf(Node):
    value: Node
    options: tuple


@dataclass(frozen=True)
class Property(Node):
    """Predicate on one character."""

    name: str  # alnum alpha decimal digit numeric space


@dataclass(frozen=True)
class Threshold(Node):
    """Predicate on one element: element op constant."""

    op: str
    bound: object


@dataclass(frozen=True)
class Reduce(Node):
    """start plus, over the elements that pass, 1 (count) or the element (sum). ``exact``: as the built-in sum adds floats."""

    kind: str  # count sum
    sequence: Node
    predicate: Node | None
    start: object
    exact: bool


@dataclass(frozen=True)
class Translate(Node):
    """str.translate by (character, replacement) pairs, sorted."""

    text: Node
    table: tuple[tuple[str, str], ...]


@dataclass(frozen=True)
class CollapseSpace(Node):
    """Runs of white space become one given white-space character; then strip."""

    text: Node
    by: str


@dataclass(frozen=True)
class RegexReplace(Node):
    """A pattern of literals, classes and + by a literal."""

    text: Node
    pattern: str
    by: str
