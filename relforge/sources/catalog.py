"""Definitions of tables, indexes and foreign keys, immutable and as JSON."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import EngineError
from ..functions.scalar import SPARK_TYPES


@dataclass(frozen=True)
class ColumnDef:
    name: str
    type: str
    nullable: bool = True
    default: object = None  # JSON defaults are canonical text
    length: int | None = None


@dataclass(frozen=True)
class IndexDef:
    name: str
    table: str
    columns: tuple[str, ...]
    unique: bool = False


@dataclass(frozen=True)
class ForeignKey:
    name: str
    table: str
    columns: tuple[str, ...]
    references: str
    reference_columns: tuple[str, ...]
    on_delete: str = "no action"
    on_update: str = "no action"


@dataclass(frozen=True)
class Step:
    """One layer of a table: rows put in, or keys taken out of the layers below."""

    kind: str  # put, take
    path: str
    renames: tuple[tuple[str, str], ...] = ()  # column now -> column in the files
    fills: tuple[tuple[str, object], ...] = ()  # columns that the files lack, with their value


@dataclass(frozen=True)
class TableDef:
    name: str
    columns: tuple[ColumnDef, ...]
    primary_key: tuple[str, ...]
    steps: tuple[Step, ...] = ()
    attached: bool = False

    def column(self, name: str) -> ColumnDef:
        for c in self.columns:
            if c.name == name:
                return c
        raise EngineError("COLUMN_NOT_FOUND", f"table {self.name} has no column {name}")

    def has(self, name: str) -> bool:
        return any(c.name == name for c in self.columns)

    @property
    def names(self) -> tuple[str, ...]:
        return tuple(c.name for c in self.columns)


def spark_schema(table: TableDef, only: tuple[str, ...] | None = None) -> str:
    return ", ".join(f"`{c.name.replace('`', '``')}` {SPARK_TYPES[c.type]}" for c in table.columns if only is None or c.name in only)


def quoted(name: str) -> str:
    return f"`{name.replace('`', '``')}`"


@dataclass(frozen=True)
class Catalog:
    """All definitions at one revision."""

    tables: dict[str, TableDef] = field(default_factory=dict)
    indexes: dict[str, IndexDef] = field(default_factory=dict)
    foreign_keys: tuple[ForeignKey, ...] = ()
    version: int = 0

    def table(self, name: str) -> TableDef:
        if name not in self.tables:
            raise EngineError("TABLE_NOT_FOUND", f"no table is named {name}")
        return self.tables[name]

    def with_table(self, table: TableDef) -> Catalog:
        return replace(self, tables={**self.tables, table.name: table})

    def uniques(self, table: str) -> list[tuple[str, ...]]:
        """The columns of every unique index."""
        return [i.columns for i in self.indexes.values() if i.table == table and i.unique]

    def layout(self, table: str) -> tuple[str, ...]:
        """The columns that a table's layers are sorted by: those of its first index, or its primary key."""
        return next((i.columns for i in self.indexes.values() if i.table == table), self.tables[table].primary_key)

    def keys_from(self, table: str) -> list[ForeignKey]:
        return [k for k in self.foreign_keys if k.table == table]

    def keys_to(self, table: str) -> list[ForeignKey]:
        return [k for k in self.foreign_keys if k.references == table]

    def as_json(self) -> dict:
        return {
            "version": self.version,
            "tables": [asdict(t) for t in self.tables.values() if not t.attached],
            "indexes": [asdict(i) for i in self.indexes.values()],
            "foreign_keys": [asdict(k) for k in self.foreign_keys],
        }

    @staticmethod
    def from_json(data: dict) -> Catalog:
        def step(x):
            return Step(x["kind"], x["path"], tuple(map(tuple, x["renames"])), tuple(map(tuple, x["fills"])))

        tables = {
            t["name"]: TableDef(t["name"], tuple(ColumnDef(**c) for c in t["columns"]), tuple(t["primary_key"]), tuple(map(step, t["steps"]))) for t in data["tables"]
        }
        indexes = {i["name"]: IndexDef(i["name"], i["table"], tuple(i["columns"]), i["unique"]) for i in data["indexes"]}
        keys = tuple(ForeignKey(**(k | {"columns": tuple(k["columns"]), "reference_columns": tuple(k["reference_columns"])})) for k in data["foreign_keys"])
        return Catalog(tables, indexes, keys, data["version"])


def read_step(spark: SparkSession, table: TableDef, step: Step) -> DataFrame:
    """A layer's rows with the table's columns of today (a layer of taken keys: the key's columns)."""
    columns = [table.column(c) for c in table.primary_key] if step.kind == "take" else list(table.columns)
    old, fills = dict(step.renames), dict(step.fills)
    in_files = [(c, old.get(c.name, c.name)) for c in columns if c.name not in fills]
    schema = ", ".join(f"{quoted(name)} {SPARK_TYPES[c.type]}" for c, name in in_files)
    df = spark.read.schema(schema).parquet(step.path)
    return df.select(*(F.lit(fills[c.name]).cast(SPARK_TYPES[c.type]).alias(c.name) if c.name in fills else F.col(quoted(old.get(c.name, c.name))).alias(c.name) for c in columns))


def read_table(spark: SparkSession, table: TableDef) -> DataFrame:
    """The table's rows: layers from the oldest to the newest, keys taken out by anti-joins on the primary key."""
    out: DataFrame | None = None
    for step in table.steps:
        rows = read_step(spark, table, step)
        if step.kind == "put":
            out = rows if out is None else out.unionByName(rows)
        elif out is not None:
            keys = rows.select(*(F.col(quoted(c)).alias(f"taken_{k}") for k, c in enumerate(table.primary_key)))
            same = [out[quoted(c)] == keys[f"taken_{k}"] for k, c in enumerate(table.primary_key)]
            out = out.join(keys, same, "left_anti")
    return out if out is not None else spark.createDataFrame([], spark_schema(table))
