"""The typed form of a statement, between the parser and the lowering to DataFrames."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any


@dataclass(frozen=True)
class Node:
    """An expression or a condition."""


@dataclass(frozen=True)
class Col(Node):
    name: str


@dataclass(frozen=True)
class Lit(Node):
    value: Any


@dataclass(frozen=True)
class Star(Node):
    table: str | None = None


@dataclass(frozen=True)
class Call(Node):
    """A function; `named` has the key=value arguments, `text` the source."""

    name: str
    args: tuple[Node, ...] = ()
    named: tuple[tuple[str, Node], ...] = ()
    text: str = ""
    distinct: bool = False

    def option(self, key: str, default: Any = None) -> Any:
        """The plain value of a key=value argument."""
        return next((plain(v) for k, v in self.named if k.lower() == key), default)


@dataclass(frozen=True)
class Binary(Node):
    op: str
    left: Node
    right: Node


@dataclass(frozen=True)
class Case(Node):
    branches: tuple[tuple[Node, Node], ...]
    default: Node | None


@dataclass(frozen=True)
class Cast(Node):
    node: Node
    kind: str


@dataclass(frozen=True)
class Interval(Node):
    amount: int
    unit: str


@dataclass(frozen=True)
class SubQuery(Node):
    select: Select


@dataclass(frozen=True)
class Compare(Node):
    op: str
    left: Node
    right: Node


@dataclass(frozen=True)
class All(Node):
    items: tuple[Node, ...]


@dataclass(frozen=True)
class Any_(Node):
    items: tuple[Node, ...]


@dataclass(frozen=True)
class Not(Node):
    item: Node


@dataclass(frozen=True)
class In(Node):
    node: Node
    items: tuple[Node, ...] | SubQuery
    negated: bool = False


@dataclass(frozen=True)
class Between(Node):
    node: Node
    low: Node
    high: Node
    negated: bool = False


@dataclass(frozen=True)
class Like(Node):
    node: Node
    pattern: Node
    negated: bool = False


@dataclass(frozen=True)
class IsNull(Node):
    node: Node
    negated: bool = False


@dataclass(frozen=True)
class Item:
    node: Node
    alias: str | None
    text: str


@dataclass(frozen=True)
class Order:
    node: Node
    ascending: bool
    text: str


@dataclass(frozen=True)
class Table:
    name: str
    alias: str | None = None


@dataclass(frozen=True)
class Join:
    kind: str
    left: Table
    right: Table
    on: Node | None


@dataclass(frozen=True)
class Hint:
    name: str
    text: str = ""
    args: tuple[str, ...] = ()


@dataclass(frozen=True)
class Select:
    items: tuple[Item, ...]
    tables: tuple[Table, ...] = ()
    join: Join | None = None
    where: Node | None = None
    groups: tuple[tuple[Node, ...], ...] = ()
    having: Node | None = None
    orders: tuple[Order, ...] = ()
    limit: int | None = None
    offset: int = 0
    hints: tuple[Hint, ...] = field(default=())
    distinct: bool = False

    def hint(self, *names: str) -> Hint | None:
        return next((h for h in self.hints if h.name in names), None)


@dataclass(frozen=True)
class SetOperation:
    op: str
    left: Select | SetOperation
    right: Select


@dataclass(frozen=True)
class Delete:
    table: Table
    where: Node | None
    limit: int | None
    hints: tuple[Hint, ...] = ()


@dataclass(frozen=True)
class Show:
    pattern: str


def plain(node: Node) -> Any:
    """The value of a literal, or the name of a column that stands for a string."""
    return node.value if isinstance(node, Lit) else node.name if isinstance(node, Col) else node
