"""The syntax tree: one family of nodes for all statements."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Literal:
    value: object  # None, bool, int, float or str


@dataclass(frozen=True)
class Parameter:
    number: int


@dataclass(frozen=True)
class Column:
    qualifier: str | None
    name: str


@dataclass(frozen=True)
class Binary:
    operator: str
    left: object
    right: object


@dataclass(frozen=True)
class Negative:
    operand: object


@dataclass(frozen=True)
class Default:
    """DEFAULT as an inserted or assigned value."""


# Predicates


@dataclass(frozen=True)
class Compare:
    operator: str
    left: object
    right: object


@dataclass(frozen=True)
class Logic:
    operator: str  # and, or
    terms: tuple


@dataclass(frozen=True)
class Not:
    term: object


@dataclass(frozen=True)
class IsNull:
    column: Column
    negated: bool


@dataclass(frozen=True)
class InList:
    column: Column
    values: tuple
    negated: bool


@dataclass(frozen=True)
class InQuery:
    column: Column
    query: Select
    negated: bool


@dataclass(frozen=True)
class Between:
    column: Column
    low: object
    high: object
    negated: bool


@dataclass(frozen=True)
class Like:
    column: Column
    pattern: object
    escape: str | None  # None: backslash; empty: none
    folded: bool
    negated: bool


# Queries


@dataclass(frozen=True)
class Star:
    qualifier: str | None = None


@dataclass(frozen=True)
class Aggregate:
    function: str
    argument: Column | None


@dataclass(frozen=True)
class ScalarQuery:
    query: Select


@dataclass(frozen=True)
class JsonRow:
    """A row's alias (name), a qualified column, or an array of qualified columns."""

    alias: str | None = None
    column: Column | None = None
    array: tuple[Column, ...] | None = None


@dataclass(frozen=True)
class JsonGather:
    element: JsonRow
    order: tuple[Order, ...]
    coalesced: bool


@dataclass(frozen=True)
class Item:
    value: object
    alias: str | None = None


@dataclass(frozen=True)
class Order:
    column: Column
    descending: bool
    nulls_first: bool | None = None

    @property
    def places_nulls_first(self) -> bool:
        return self.descending if self.nulls_first is None else self.nulls_first


@dataclass(frozen=True)
class TableSource:
    table: str
    alias: str


@dataclass(frozen=True)
class QuerySource:
    query: Select
    alias: str


@dataclass(frozen=True)
class Join:
    source: TableSource
    outer: bool
    on: tuple[tuple[Column, Column], ...]


@dataclass(frozen=True)
class Lateral:
    query: Select
    alias: str


@dataclass(frozen=True)
class Select:
    items: tuple[Item | Star, ...]
    source: TableSource | QuerySource
    joins: tuple[Join, ...] = ()
    laterals: tuple[Lateral, ...] = ()
    where: object = None
    group: tuple[Column, ...] = ()
    order: tuple[Order, ...] = ()
    limit: object = None
    offset: object = None
    distinct: bool = False


# Changes


@dataclass(frozen=True)
class Conflict:
    target: tuple[str, ...] | None
    assignments: tuple[tuple[str, object], ...] | None  # None: do nothing


@dataclass(frozen=True)
class Insert:
    table: str
    columns: tuple[str, ...] | None
    rows: tuple[tuple, ...] | None  # None: DEFAULT VALUES
    conflict: Conflict | None = None
    returning: tuple | None = None


@dataclass(frozen=True)
class Update:
    source: TableSource
    assignments: tuple[tuple[str, object], ...]
    where: object = None
    returning: tuple | None = None


@dataclass(frozen=True)
class Delete:
    source: TableSource
    where: object = None
    returning: tuple | None = None


# Definitions


@dataclass(frozen=True)
class ColumnSpec:
    name: str
    type: str
    nullable: bool = True
    default: object = None
    length: int | None = None


@dataclass(frozen=True)
class KeySpec:
    """A foreign key; no name or columns: those implied."""

    columns: tuple[str, ...]
    table: str
    references: tuple[str, ...] | None
    on_delete: str = "no action"
    on_update: str = "no action"
    name: str | None = None


@dataclass(frozen=True)
class CreateTable:
    table: str
    columns: tuple[ColumnSpec, ...]
    primary_key: tuple[str, ...]
    uniques: tuple[tuple[str | None, tuple[str, ...]], ...] = ()
    foreign_keys: tuple[KeySpec, ...] = ()
    if_not_exists: bool = False


@dataclass(frozen=True)
class CreateIndex:
    name: str
    table: str
    columns: tuple[str, ...]
    unique: bool = False
    if_not_exists: bool = False


@dataclass(frozen=True)
class Drop:
    kind: str  # table, index
    name: str
    if_exists: bool = False
    cascade: bool = False


@dataclass(frozen=True)
class Alter:
    table: str
    action: str
    arguments: dict = field(default_factory=dict, hash=False)
