"""Changes as they are published: callbacks in this process, and a stream for others."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "revision long, table string, keys string"


@dataclass(frozen=True)
class Notice:
    """What a revision changed; keys by table, None where too many rows changed."""

    revision: int
    tables: tuple[str, ...]
    keys: dict[str, list[tuple] | None]


@dataclass
class Subscriptions:
    """Listeners by the tables that they follow; all tables without names."""

    listeners: dict[int, tuple[frozenset[str], Callable[[Notice], None]]] = field(default_factory=dict)
    number: int = 0

    def add(self, tables: Sequence[str], listener: Callable[[Notice], None]) -> Callable[[], None]:
        self.number += 1
        own = self.number
        self.listeners[own] = (frozenset(tables), listener)
        return lambda: self.listeners.pop(own, None) and None

    def tell(self, notice: Notice) -> None:
        for tables, listener in list(self.listeners.values()):
            followed = tuple(t for t in notice.tables if not tables or t in tables)
            if followed:
                listener(Notice(notice.revision, followed, {t: k for t, k in notice.keys.items() if t in followed}))


def change_stream(spark: SparkSession, location: str) -> DataFrame:
    """A streaming table of published changes: a row for each revision and table, keys as JSON text.

    It follows a database's location with Structured Streaming; each revision is
    one small file that never changes.
    """
    return spark.readStream.schema(SCHEMA).json(f"{location.rstrip('/')}/_changes")
