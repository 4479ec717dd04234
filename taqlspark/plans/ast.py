"""Statements and expressions as parsed."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any


@dataclass
class Lit:
    value: Any


@dataclass
class Name:
    name: str


@dataclass
class Unary:
    op: str
    arg: Any


@dataclass
class Binary:
    op: str
    left: Any
    right: Any


@dataclass
class Between:
    arg: Any
    low: Any
    high: Any


@dataclass
class In:
    arg: Any
    items: list[Any]


@dataclass
class Like:
    arg: Any
    pattern: Any
    fold: bool


@dataclass
class Call:
    name: str
    args: list[Any]


@dataclass
class Index:
    base: Any
    at: Any


@dataclass
class Subquery:
    select: "Select"


@dataclass
class TableRef:
    """A position in the list of tables, or a path."""

    position: int | None = None
    path: str | None = None


@dataclass
class Item:
    expr: Any
    alias: str | None = None


@dataclass
class Key:
    expr: Any
    desc: bool = False


@dataclass
class Select:
    items: list[Item] | None
    table: TableRef
    where: Any = None
    order: list[Key] = field(default_factory=list)
    group: list[Any] = field(default_factory=list)
    having: Any = None
    limit: int | None = None
    offset: int = 0
    unique: bool = False
    into: str | None = None


@dataclass
class Count:
    table: TableRef
    where: Any = None


@dataclass
class Calc:
    items: list[Item]
    table: TableRef


@dataclass
class Update:
    table: TableRef
    sets: list[tuple[str, Any]]
    where: Any = None
    order: list[Key] = field(default_factory=list)
    limit: int | None = None
    offset: int = 0


@dataclass
class Delete:
    table: TableRef
    where: Any = None
    order: list[Key] = field(default_factory=list)
    limit: int | None = None
    offset: int = 0


@dataclass
class Insert:
    table: TableRef
    columns: list[str] | None
    select: Select


@dataclass
class ColumnSpec:
    name: str
    type: str
    ndim: int | None = None
    shape: list[int] | None = None
    options: int = 0
    maxlen: int = 0
    comment: str = ""


@dataclass
class Create:
    path: str
    columns: list[ColumnSpec]
    keywords: list[tuple[str, Any]]
    rows: int = 0


@dataclass
class Drop:
    paths: list[str]


@dataclass
class Alter:
    """actions: (add, spec), (drop, name), (rename, old, new), (set, key, value), (remove, key)."""

    table: TableRef
    actions: list[tuple[Any, ...]]


@dataclass
class Show:
    path: str | None = None
