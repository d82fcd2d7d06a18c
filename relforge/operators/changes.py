"""Changes of rows: INSERT with upserts, UPDATE, DELETE, and what foreign keys make of them.

A change is a table of old and new rows, written before it is judged.  It is
applied by adding layers to the table: keys taken out, rows put in.  Constraints
are checked on what the statement leaves, by joins on the changed keys only.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import EngineError
from ..functions import json_text, scalar
from ..plans import syntax as s
from ..plans.parser import invalid, refused
from ..sources.catalog import Catalog, ForeignKey, Step, TableDef, quoted, read_table
from ..sources.store import Store
from .query import MOST_ROWS, Compiler, Rows, columns_in
from .rows import assignable, default_of, evaluate, kind_of, proposed, stored, violation

#: Keys of a table that are reported; with more, none are.
MOST_KEYS = 1_000
#: A table with more layers is written anew in one.
MOST_LAYERS = 12


@dataclass
class Change:
    """Rows of one table before and after: columns op (I, U or D), o0.. and n0.. by the columns' places."""

    table: TableDef
    df: DataFrame
    ops: str  # the kinds that may be there
    keys: list[tuple] | None = None  # those of all rows, if they are known

    def old(self, names: Sequence[str], prefix: str = "") -> list[Column]:
        return [F.col(f"o{self.table.names.index(n)}").alias(prefix + n) for n in names]

    def new(self, names: Sequence[str], prefix: str = "") -> list[Column]:
        return [F.col(f"n{self.table.names.index(n)}").alias(prefix + n) for n in names]


@dataclass
class Outcome:
    """What a statement did: the definitions after it, its own rows, and the changes of all tables."""

    catalog: Catalog
    command: str
    count: int
    table: TableDef
    returned: list[tuple] | DataFrame | None = None
    names: tuple[str, ...] = ()
    changes: list[Change] = field(default_factory=list)


def wide(spark: SparkSession, table: TableDef, op: str, old: DataFrame | None, new: DataFrame | None) -> DataFrame:
    """A change from rows of one side; the other side is null."""
    rows = old if old is not None else new
    parts = [F.lit(op).alias("op")]
    for prefix, side in (("o", old), ("n", new)):
        parts += [(F.col(quoted(c.name)) if side is not None else F.lit(None).cast(scalar.SPARK_TYPES[c.type])).alias(f"{prefix}{k}") for k, c in enumerate(table.columns)]
    return rows.select(*parts)


class Changer:
    """Carries out one changing statement against staged definitions."""

    def __init__(self, spark: SparkSession, store: Store, catalog: Catalog, compiler: Compiler):
        self.spark, self.store, self.catalog, self.compiler = spark, store, catalog, compiler

    def rows(self, table: TableDef | str) -> DataFrame:
        return read_table(self.spark, self.catalog.table(table if isinstance(table, str) else table.name))

    def writable(self, name: str) -> TableDef:
        table = self.catalog.table(name)
        if table.attached:
            raise refused(f"the table {name} is attached and can only be read")
        return table

    def run(self, statement: object) -> Outcome:
        if isinstance(statement, s.Insert):
            return self.insert(statement)
        return self.update(statement) if isinstance(statement, s.Update) else self.delete(statement)

    # RETURNING

    def returned(self, table: TableDef, returning: tuple | None, alias: str) -> tuple[str, ...] | None:
        if returning is None:
            return None
        names: list[str] = []
        for r in returning:
            if r.qualifier not in (None, alias):
                raise invalid(f"no table of the statement is named {r.qualifier}")
            names += table.names if isinstance(r, s.Star) else [table.column(r.name).name]
        if len(set(names)) != len(names):
            raise invalid("RETURNING names a column twice")
        return tuple(names)

    # INSERT

    def _matching(self, table: TableDef, columns: Sequence[str], keys: set[tuple]) -> list[dict]:
        """Stored rows whose `columns` have one of the values."""
        if not keys or not table.steps:
            return []
        wanted = self.spark.createDataFrame([list(k) for k in keys], ", ".join(f"k{i} {scalar.SPARK_TYPES[table.column(c).type]}" for i, c in enumerate(columns)))
        rows = self.rows(table)
        same = [rows[quoted(c)] == wanted[f"k{i}"] for i, c in enumerate(columns)]
        return [r.asDict() for r in rows.join(F.broadcast(wanted), same, "left_semi").collect()]

    def insert(self, statement: s.Insert) -> Outcome:
        table = self.writable(statement.table)
        names = self.returned(table, statement.returning, table.name.rpartition(".")[2])
        keys = [table.primary_key, *self.catalog.uniques(table.name)]
        arbiters = self._arbiters(table, statement.conflict, keys)
        assignments = self._checked_assignments(table, statement.conflict)
        rows = proposed(table, statement, self.compiler.constant)
        key_of = lambda row, columns: None if any(row[c] is None for c in columns) else tuple(row[c] for c in columns)
        current: dict[tuple, dict[tuple, dict]] = {columns: {} for columns in keys}
        originals: dict[tuple, dict] = {}
        for columns in keys:
            for row in self._matching(table, columns, {k for r in rows if (k := key_of(r, columns)) is not None}):
                originals[key_of(row, table.primary_key)] = row
        for row in originals.values():
            for columns in keys:
                if (k := key_of(row, columns)) is not None:
                    current[columns][k] = row
        written: dict[int, str] = {}
        result: list[dict] = []
        olds: dict[int, dict] = {}
        for row in rows:
            hit = next((found for columns in arbiters if (k := key_of(row, columns)) is not None and (found := current[columns].get(k)) is not None), None)
            if hit is not None and statement.conflict.assignments is None:
                continue
            if hit is not None:
                if id(hit) in written:
                    raise violation("one statement can't change a row twice")
                after = self._assigned(table, assignments, hit, row)
                if any(after[c] != hit[c] for c in table.primary_key):
                    raise refused("ON CONFLICT can't change a primary key")
                for columns in keys:
                    if (k := key_of(hit, columns)) is not None:
                        current[columns].pop(k, None)
                olds[id(after)] = hit
                written[id(after)] = "U"
                row = after
            else:
                written[id(row)] = "I"
            for columns in keys:
                if (k := key_of(row, columns)) is None:
                    continue
                clash = current[columns].get(k) or (self._elsewhere(table, columns, k, originals, key_of) if id(row) in olds else None)
                if clash is not None:
                    raise violation(f"the key ({', '.join(columns)}) repeats in {table.name}")
                current[columns][k] = row
            result.append(row)
        if result:
            parts = [[written[id(r)], *(olds[id(r)][n] if id(r) in olds else None for n in table.names), *(r[n] for n in table.names)] for r in result]
            kinds = [scalar.SPARK_TYPES[c.type] for c in table.columns]
            schema = ", ".join(["op string", *(f"{p}{k} {t}" for p in "on" for k, t in enumerate(kinds))])
            own = [tuple(r[c] for c in table.primary_key) for r in result]  # an upsert keeps its row's key
            change = Change(table, self.spark.createDataFrame(parts, schema), "".join(sorted(set(written.values()))), own)
            outcome = self._finish(change, "INSERT", len(result))
        else:
            outcome = Outcome(self.catalog, "INSERT", 0, table)
        if names is not None:
            outcome.names, outcome.returned = names, [tuple(r[n] for n in names) for r in result]
        return outcome

    def _elsewhere(self, table: TableDef, columns: Sequence[str], key: tuple, known: dict, key_of) -> dict | None:
        """A stored row with a key that no proposed row has asked for."""
        for row in self._matching(table, columns, {key}):
            if key_of(row, table.primary_key) not in known:
                return row
        return None

    def _arbiters(self, table: TableDef, conflict: s.Conflict | None, keys: list[tuple]) -> list[tuple]:
        if conflict is None:
            return []
        if conflict.target is None:
            return keys
        for c in conflict.target:
            table.column(c)
        found = [k for k in keys if set(k) == set(conflict.target) and len(k) == len(conflict.target)]
        if not found:
            raise invalid("a conflict target lists the columns of the primary key or of a unique index")
        return found[:1]

    def _checked_assignments(self, table: TableDef, conflict: s.Conflict | None) -> list[tuple]:
        out = []
        own = table.name.rpartition(".")[2]

        def kind(c: s.Column) -> str:
            if c.qualifier is None:
                raise invalid(f"{c.name} could mean the stored or the proposed row; write {own}.{c.name} or EXCLUDED.{c.name}")
            if c.qualifier not in (own, "excluded"):
                raise invalid(f"no table of the statement is named {c.qualifier}")
            return table.column(c.name).type

        for name, value in (conflict.assignments or ()) if conflict else ():
            column = table.column(name)
            if not isinstance(value, s.Default) and not (column.type == "json" and isinstance(value, (s.Literal, s.Parameter))):
                assignable(column, kind_of(value, kind, self.compiler.constant))
            out.append((column, value))
        return out

    def _assigned(self, table: TableDef, assignments: list[tuple], old: dict, new: dict) -> dict:
        after = dict(old)
        for column, value in assignments:
            if isinstance(value, s.Default):
                after[column.name] = default_of(column)
            elif column.type == "json":
                held = evaluate(value, lambda c: (new if c.qualifier == "excluded" else old)[c.name], self.compiler.constant)
                after[column.name] = stored(column, held) if isinstance(value, (s.Literal, s.Parameter)) else held
                if after[column.name] is None and not column.nullable:
                    raise violation(f"the column {column.name} is NOT NULL")
            else:
                after[column.name] = stored(column, evaluate(value, lambda c: (new if c.qualifier == "excluded" else old)[c.name], self.compiler.constant))
        return after

    # UPDATE and DELETE

    def _touched(self, source: s.TableSource, where: object) -> tuple[TableDef, Rows, dict[str, str]]:
        table = self.writable(source.table)
        df, own = self.compiler.scan(source)
        rows = Rows(df, [own], None)
        rows.df = self.compiler.where(where, rows)
        return table, rows, {n: i for n, (i, _) in own.columns.items()}

    def update(self, statement: s.Update) -> Outcome:
        table, rows, idents = self._touched(statement.source, statement.where)
        names = self.returned(table, statement.returning, statement.source.alias)
        new: dict[str, Column] = {}
        for name, value in statement.assignments:
            column = table.column(name)
            if isinstance(value, s.Default):
                new[name] = F.lit(column.default).cast(scalar.SPARK_TYPES[column.type])
            elif column.type == "json" and isinstance(value, (s.Literal, s.Parameter)):
                new[name] = scalar.literal(json_text.canonical(self.compiler.constant(value)), "json")
            else:
                if not any(True for _ in columns_in(value)):  # worked out once
                    held = evaluate(value, lambda c: None, self.compiler.constant)
                    assignable(column, kind_of(value, lambda c: "null", self.compiler.constant))
                    new[name] = F.lit(held).cast(scalar.SPARK_TYPES[column.type])
                    continue
                made, kind = self.compiler.value(value, rows)
                assignable(column, kind)
                new[name] = made.cast(scalar.SPARK_TYPES[column.type])
        after = {c.name: new.get(c.name, F.col(idents[c.name])) for c in table.columns}
        df = rows.df.select(F.lit("U").alias("op"), *(F.col(idents[n]).alias(f"o{k}") for k, n in enumerate(table.names)), *(after[n].alias(f"n{k}") for k, n in enumerate(table.names)))
        change = Change(table, self._kept(df), "U")
        self._check_values(change, set(new))
        for columns in (table.primary_key, *self.catalog.uniques(table.name)):
            if set(columns) & set(new):
                self._check_key(change, columns)
        outcome = self._finish(change, "UPDATE", None, set(new))
        return self._with_rows(outcome, change, names, change.new)

    def delete(self, statement: s.Delete) -> Outcome:
        table, rows, idents = self._touched(statement.source, statement.where)
        names = self.returned(table, statement.returning, statement.source.alias)
        old = rows.df.select(*(F.col(idents[n]).alias(n) for n in table.names))
        change = Change(table, self._kept(wide(self.spark, table, "D", old, None)), "D")
        return self._with_rows(self._finish(change, "DELETE", None), change, names, change.old)

    def _with_rows(self, outcome: Outcome, change: Change, names: tuple[str, ...] | None, side) -> Outcome:
        if names is not None:
            key = [f"{'n' if outcome.command != 'DELETE' else 'o'}{change.table.names.index(c)}" for c in change.table.primary_key]
            outcome.names, outcome.returned = names, change.df.orderBy(*key).select(*side(names))
        return outcome

    def _kept(self, df: DataFrame) -> DataFrame:
        """The change as written rows, so that it is worked out once and its failures come before anything else."""
        path = self.store.write(df)
        return self.spark.read.schema(df.schema).parquet(path)

    # Constraints

    def _check_values(self, change: Change, names: set[str]) -> None:
        tests = []
        for k, c in enumerate(change.table.columns):
            if c.name in names and not c.nullable:
                tests.append((F.col(f"n{k}").isNull(), f"the column {c.name} is NOT NULL"))
            if c.name in names and c.length is not None:
                tests.append((F.char_length(f"n{k}") > c.length, f"the column {c.name} holds {c.length} characters at most"))
        if tests:
            found = change.df.agg(*(F.max(t).alias(f"t{k}") for k, (t, _) in enumerate(tests))).first()
            for bad, (_, message) in zip(found, tests, strict=True):
                if bad:
                    raise violation(message)

    def _check_key(self, change: Change, columns: Sequence[str]) -> None:
        """That the changed rows' new keys are all different, and that no other row has them."""
        table = change.table
        own = change.df.select(*change.new(columns, "key_"), *change.old(table.primary_key, "old_")).na.drop(subset=[f"key_{c}" for c in columns])
        if not own.groupBy(*(quoted(f"key_{c}") for c in columns)).count().where("count > 1").isEmpty():
            raise violation(f"the key ({', '.join(columns)}) repeats in {table.name}")
        rows = self.rows(table)
        changed = change.df.select(*change.old(table.primary_key, "old_"))
        others = rows.join(changed, [rows[quoted(c)] == changed[quoted(f"old_{c}")] for c in table.primary_key], "left_anti")
        keys = own.select(*(quoted(f"key_{c}") for c in columns))
        if not others.join(keys, [F.col(quoted(c)) == F.col(quoted(f"key_{c}")) for c in columns], "left_semi").isEmpty():
            raise violation(f"the key ({', '.join(columns)}) repeats in {table.name}")

    # Applying

    def _apply(self, change: Change) -> None:
        table = self.catalog.table(change.table.name)
        steps = list(table.steps)
        if any(op in change.ops for op in "UD"):
            steps.append(Step("take", self.store.write(change.df.where("op <> 'I'").select(*change.old(table.primary_key)))))
        if any(op in change.ops for op in "IU"):
            steps.append(Step("put", self.store.write(change.df.where("op <> 'D'").select(*change.new(table.names)), self.catalog.layout(table.name))))
        self.catalog = self.catalog.with_table(self.store.compacted(replace(table, steps=tuple(steps)), MOST_LAYERS, self.catalog.layout(table.name)))

    def _finish(self, change: Change, command: str, count: int | None, assigned: set[str] | None = None) -> Outcome:
        number = change.df.count() if count is None else count
        if self.compiler.strict and number > MOST_ROWS:
            raise EngineError("QUERY_WORK_LIMIT_EXCEEDED", f"a statement changes more than {MOST_ROWS} rows")
        outcome = Outcome(self.catalog, command, number, change.table)
        if number:
            self._apply(change)
            outcome.changes = self._enforce(change, assigned)
            outcome.catalog = self.catalog
        return outcome

    # Foreign keys

    def _enforce(self, first: Change, assigned: set[str] | None) -> list[Change]:
        """Carry out the actions of foreign keys until nothing changes, then check every reference that is new or lost its row."""
        changes, waiting, left = [first], [first], []
        while waiting:
            change = waiting.pop(0)
            for key in self.catalog.keys_to(change.table.name):
                if change is first and assigned is not None and not assigned & set(key.reference_columns):
                    continue
                for op, action in (("D", key.on_delete), ("U", key.on_update)):
                    if op not in change.ops:
                        continue
                    gone = self._gone(change, key, op)
                    if action == "no action":
                        left.append((key, gone))
                        continue
                    made = self._referencing(key, gone, op, action)
                    if made is not None:
                        self._check_values(made, set(key.columns))
                        for columns in (made.table.primary_key, *self.catalog.uniques(made.table.name)):
                            if "U" in made.ops and set(columns) & set(key.columns):
                                self._check_key(made, columns)
                        self._apply(made)
                        changes.append(made)
                        waiting.append(made)
        for key, gone in left:
            still = gone.join(self._values(self.rows(key.references), key.reference_columns), [F.col(f"v{i}") == F.col(f"r{i}") for i in range(len(key.columns))], "left_anti")
            child = self.rows(key.table)
            if not child.join(still, [child[quoted(c)] == still[f"v{i}"] for i, c in enumerate(key.columns)], "left_semi").isEmpty():
                raise violation(f"{key.name}: a row is still referenced")
        for change in changes:
            for key in self.catalog.keys_from(change.table.name):
                if "I" in change.ops or "U" in change.ops:
                    self._check_references(change, key)
        return changes

    def _values(self, df: DataFrame, columns: Sequence[str]) -> DataFrame:
        return df.select(*(F.col(quoted(c)).alias(f"r{i}") for i, c in enumerate(columns))).na.drop().distinct()

    def _gone(self, change: Change, key: ForeignKey, op: str) -> DataFrame:
        """The referenced values (v0..) that rows of the change no longer hold, with the new ones (w0..)."""
        places = [change.table.names.index(c) for c in key.reference_columns]
        rows = change.df.where(F.col("op") == op).select(*(F.col(f"o{p}").alias(f"v{i}") for i, p in enumerate(places)), *(F.col(f"n{p}").alias(f"w{i}") for i, p in enumerate(places)))
        rows = rows.na.drop(subset=[f"v{i}" for i in range(len(places))])
        if op == "U":
            changed = F.lit(False)
            for i in range(len(places)):
                changed = changed | ~F.col(f"v{i}").eqNullSafe(F.col(f"w{i}"))
            rows = rows.where(changed)
        return rows

    def _referencing(self, key: ForeignKey, gone: DataFrame, op: str, action: str) -> Change | None:
        """The change that a key's action makes of the rows that reference the values."""
        table = self.catalog.table(key.table)
        child = self.rows(table)
        found = child.join(gone, [child[quoted(c)] == gone[f"v{i}"] for i, c in enumerate(key.columns)])
        if action == "restrict":
            if not found.isEmpty():
                raise violation(f"{key.name}: a row is still referenced")
            return None
        if op == "D" and action == "cascade":
            made, kind = wide(self.spark, table, "D", found, None), "D"
        else:
            to: dict[str, Column] = {}
            for i, c in enumerate(key.columns):
                column = table.column(c)
                held = F.col(f"w{i}") if action == "cascade" else F.lit(column.default if action == "set default" else None)
                to[c] = held.cast(scalar.SPARK_TYPES[column.type])
            made = found.select(F.lit("U").alias("op"), *(F.col(quoted(n)).alias(f"o{k}") for k, n in enumerate(table.names)), *(to.get(n, F.col(quoted(n))).alias(f"n{k}") for k, n in enumerate(table.names)))
            kind = "U"
        change = Change(table, self._kept(made), kind)
        return None if change.df.isEmpty() else change

    def _check_references(self, change: Change, key: ForeignKey) -> None:
        """That the references which rows of the change make anew have their rows."""
        places = [change.table.names.index(c) for c in key.columns]
        rows = change.df.where("op <> 'D'")
        if "U" in change.ops:
            moved = F.col("op") == "I"
            for p in places:
                moved = moved | ~F.col(f"o{p}").eqNullSafe(F.col(f"n{p}"))
            rows = rows.where(moved)
        wanted = rows.select(*(F.col(f"n{p}").alias(f"v{i}") for i, p in enumerate(places))).na.drop().distinct()
        current = self.rows(key.references)
        final = self.rows(key.table)  # rows that later changes took back don't count
        wanted = wanted.join(final, [wanted[f"v{i}"] == final[quoted(c)] for i, c in enumerate(key.columns)], "left_semi")
        held = self._values(current, key.reference_columns)
        if not wanted.join(held, [F.col(f"v{i}") == F.col(f"r{i}") for i in range(len(places))], "left_anti").isEmpty():
            raise violation(f"{key.name}: a referenced row is missing")


def changed_keys(changes: Sequence[Change]) -> dict[str, list[tuple] | None]:
    """The primary keys of the rows that changed, by table; None for a table with more than MOST_KEYS."""
    out: dict[str, list[tuple] | None] = {}
    for change in changes:
        table, keys = change.table, change.table.primary_key
        sides = []
        if any(op in change.ops for op in "UD"):
            sides.append(change.df.where("op <> 'I'").select(*change.old(keys)))
        if any(op in change.ops for op in "IU"):
            sides.append(change.df.where("op <> 'D'").select(*change.new(keys)))
        if change.keys is not None:
            found = change.keys
        else:
            df = sides[0] if len(sides) == 1 else sides[0].unionAll(sides[1])
            found = [tuple(r) for r in df.distinct().limit(MOST_KEYS + 1).collect()]
        known = out.get(table.name, [])
        merged = None if known is None else sorted({*known, *found}, key=repr)
        out[table.name] = None if merged is None or len(merged) > MOST_KEYS else sorted(merged)
    return out


