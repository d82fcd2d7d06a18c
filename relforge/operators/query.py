"""Queries to DataFrames.

Every source column gets a name of its own, so names never clash.  A nested
query is not run row by row: the distinct values that it reads of the rows
around it (its domain) are joined into it, carried through each of its
operators, and its rows are joined back by them (Neumann and Kemper, Unnesting
Arbitrary Queries, 2015).
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import EngineError
from ..functions import json_text, scalar
from ..plans import syntax as s
from ..plans.parser import MAX_AGGREGATES, MAX_COLUMNS, MAX_LIMIT, MAX_OFFSET, invalid, refused
from ..sources.catalog import TableDef, quoted


#: Limits of volume, which only strict databases keep: values of a subquery, rows of a result, changed rows.
MOST_VALUES, MOST_ROWS = 1_024, 100_000


@dataclass(frozen=True)
class Out:
    """An output: its name, type, and the column that holds it; `source` is the column that it returns, if plain."""

    name: str
    type: str
    ident: str
    source: str | None = None


@dataclass(frozen=True)
class Source:
    alias: str
    columns: dict[str, tuple[str, str]]  # name -> (column, type)
    key: tuple[str, ...] = ()


@dataclass(frozen=True)
class Around:
    """What a nested query sees of the rows around it."""

    domain: DataFrame
    columns: dict[tuple[str, str], tuple[str, str]]

    @property
    def carried(self) -> list[str]:
        return list(dict.fromkeys(c for c, _ in self.columns.values()))


@dataclass
class Rows:
    """A query's rows so far."""

    df: DataFrame
    sources: list[Source]
    around: Around | None
    order: list[tuple[str, bool, bool]] = field(default_factory=list)
    ties: list[str] = field(default_factory=list)
    laterals: dict[str, Source] = field(default_factory=dict)

    @property
    def carried(self) -> list[str]:
        return self.around.carried if self.around else []

    def find(self, column: s.Column) -> tuple[str, str]:
        """(column, type) of a name."""
        if column.qualifier is None:
            found = [x.columns[column.name] for x in self.sources if column.name in x.columns]
            if len(found) > 1:
                raise invalid(f"the column {column.name} is ambiguous")
            if not found:
                raise EngineError("COLUMN_NOT_FOUND", f"no column is named {column.name}")
            return found[0]
        for x in (*self.sources, *self.laterals.values()):
            if x.alias == column.qualifier:
                if column.name not in x.columns:
                    raise EngineError("COLUMN_NOT_FOUND", f"{x.alias} has no column {column.name}")
                return x.columns[column.name]
        if self.around and (column.qualifier, column.name) in self.around.columns:
            return self.around.columns[column.qualifier, column.name]
        raise invalid(f"no table of the query is named {column.qualifier}")


@dataclass
class Answer:
    """A query's result: rows, outputs in order, the order of rows and what breaks its ties."""

    df: DataFrame
    outputs: list[Out]
    order: list[tuple[str, bool, bool]]
    ties: list[str]
    carried: list[str]
    single: bool = False  # one row for each row around it; where its rows lack one, that of `defaults`
    defaults: dict[str, object] = field(default_factory=dict)

    def frame(self, names: Sequence[str] | None = None) -> DataFrame:
        return self.df.select(*(F.col(o.ident).alias(n) for o, n in zip(self.outputs, names or [o.name for o in self.outputs], strict=True)))


def columns_in(node: object) -> Iterable[s.Column]:
    """The columns of an expression or predicate, without those of its subqueries."""
    if isinstance(node, s.Column):
        yield node
    elif isinstance(node, (s.Binary, s.Compare)):
        yield from columns_in(node.left)
        yield from columns_in(node.right)
    elif isinstance(node, s.Negative):
        yield from columns_in(node.operand)
    elif isinstance(node, s.Logic):
        for t in node.terms:
            yield from columns_in(t)
    elif isinstance(node, s.Not):
        yield from columns_in(node.term)
    elif isinstance(node, (s.IsNull, s.InList, s.InQuery, s.Between, s.Like)):
        yield node.column
    elif isinstance(node, s.JsonRow):
        yield from (node.array or (() if node.column is None else (node.column,)))
    elif isinstance(node, s.JsonGather):
        yield from columns_in(node.element)
        yield from (o.column for o in node.order)
    elif isinstance(node, s.Aggregate) and node.argument is not None:
        yield node.argument


def free_columns(query: s.Select) -> set[tuple[str, str]]:
    """The qualified columns that a query reads of the rows around it."""
    own = {query.source.alias, *(j.source.alias for j in query.joins), *(x.alias for x in query.laterals)}
    parts: list[object] = [i.value for i in query.items if isinstance(i, s.Item)] + [query.where, *(o.column for o in query.order), *query.group]
    parts += [c for j in query.joins for pair in j.on for c in pair]
    out = {(c.qualifier, c.name) for p in parts for c in columns_in(p) if c.qualifier is not None and c.qualifier not in own}
    if isinstance(query.source, s.QuerySource):
        out |= free_columns(query.source.query)
    for nested in [x.query for x in query.laterals] + [i.value.query for i in query.items if isinstance(i, s.Item) and isinstance(i.value, s.ScalarQuery)]:
        out |= {c for c in free_columns(nested) if c[0] not in own}
    return out


class Compiler:
    """Compiles one statement's queries against a catalog."""

    def __init__(self, spark: SparkSession, table: Callable[[str], TableDef], frame: Callable[[TableDef], DataFrame], parameters: Sequence[object] = (), strict: bool = False):
        self.spark, self.table, self.frame, self.parameters, self.strict = spark, table, frame, list(parameters), strict
        self._names = 0

    def ident(self) -> str:
        self._names += 1
        return f"c{self._names}"

    # Values

    def constant(self, node: object) -> object:
        """The Python value of a literal or parameter."""
        if isinstance(node, s.Parameter):
            if node.number > len(self.parameters):
                raise EngineError("BIND_ERROR", f"parameter ${node.number} has no value")
            return scalar.safe_value(self.parameters[node.number - 1])
        return node.value

    def expression(self, node: object, rows: Rows) -> tuple[Column, str]:
        if isinstance(node, (s.Literal, s.Parameter)):
            value = self.constant(node)
            kind = scalar.type_of(value)
            return scalar.literal(json_text.canonical(value) if kind == "json" else value, kind), kind
        if isinstance(node, s.Column):
            name, kind = rows.find(node)
            return F.col(name), kind
        if isinstance(node, s.Negative):
            return scalar.negative(*self.expression(node.operand, rows))
        if isinstance(node, s.Binary):
            return scalar.arithmetic(node.operator, *self.expression(node.left, rows), *self.expression(node.right, rows))
        raise refused("this value is not supported here")

    def value(self, node: object, rows: Rows) -> tuple[Column, str]:
        """An expression whose result is checked."""
        out, kind = self.expression(node, rows)
        return (scalar.finite(out), kind) if kind == "float" and isinstance(node, (s.Binary, s.Negative)) else (out, kind)

    def _against(self, node: object, kind: str, rows: Rows) -> tuple[Column, str]:
        """A value that is compared with one of type `kind`; beside JSON a constant is JSON."""
        if kind == "json" and isinstance(node, (s.Literal, s.Parameter)):
            return scalar.literal(json_text.canonical(self.constant(node)), "json"), "json"
        return self.value(node, rows)

    def compare(self, operator: str, left: object, right: object, rows: Rows) -> Column:
        b, bt = self.value(right, rows)
        a, at = self._against(left, bt, rows)
        b, bt = self._against(right, at, rows)
        scalar.comparable(operator, at, bt)
        if "json" in (at, bt):
            same = json_text.equal(a, b)
            return same if operator == "=" else ~same
        if at != bt and "null" not in (at, bt):
            a, b = a.cast("double"), b.cast("double")
        if at == "null":
            a = a.cast(scalar.SPARK_TYPES[bt])
        if bt == "null":
            b = b.cast(scalar.SPARK_TYPES[at])
        return {"=": a == b, "<>": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[operator]

    # Predicates

    def predicate(self, node: object, rows: Rows) -> Column:
        if isinstance(node, s.Compare):
            return self.compare(node.operator, node.left, node.right, rows)
        if isinstance(node, s.Logic):
            terms = [self.predicate(t, rows) for t in node.terms]
            out = terms[0]
            for t in terms[1:]:
                out = out & t if node.operator == "and" else out | t
            return out
        if isinstance(node, s.Not):
            return ~self.predicate(node.term, rows)
        if isinstance(node, s.IsNull):
            column = F.col(rows.find(node.column)[0])
            return column.isNotNull() if node.negated else column.isNull()
        if isinstance(node, s.Between):
            low, high = self.compare(">=", node.column, node.low, rows), self.compare("<=", node.column, node.high, rows)
            return ~(low & high) if node.negated else low & high
        if isinstance(node, s.InList):
            out = self._in_list(node, rows)
            return ~out if node.negated else out
        if isinstance(node, s.Like):
            return self._like(node, rows)
        raise refused("this predicate is not supported here")

    def _in_list(self, node: s.InList, rows: Rows) -> Column:
        name, kind = rows.find(node.column)
        column, values = F.col(name), [self.constant(v) for v in node.values]
        if kind == "json":
            tests = [self.compare("=", node.column, v, rows) for v in node.values]
            out = tests[0]
            for t in tests[1:]:
                out = out | t
            return out
        for v in values:
            scalar.comparable("=", kind, scalar.type_of(v))
        present = [v for v in values if v is not None]
        if kind in scalar.NUMBERS and any(scalar.type_of(v) != kind for v in present):
            column, present = column.cast("double"), [float(v) for v in present]
        out = column.isin(present) if present else F.lit(False) & column.isNotNull()
        return out | F.lit(None).cast("boolean") if len(present) < len(values) else out

    def _like(self, node: s.Like, rows: Rows) -> Column:
        name, kind = rows.find(node.column)
        pattern = self.constant(node.pattern)
        if kind != "text" or scalar.type_of(pattern) not in ("text", "null"):
            raise scalar.mismatch("LIKE matches a text column against a text")
        if pattern is None:
            return F.lit(None).cast("boolean")
        pattern, column = scalar.like_pattern(pattern, node.escape), F.col(name)
        if node.folded:
            pattern = "".join(c.lower() if "A" <= c <= "Z" else c for c in pattern)
            column = scalar.ascii_lower(column)
        out = column.like(pattern)
        return ~out if node.negated else out

    def where(self, node: object, rows: Rows) -> DataFrame:
        """The rows where the predicate is true; terms that can fail see only rows that pass the plain ones before them."""
        if node is None:
            return rows.df
        df, plain, risky = rows.df, [], []
        for term in self._conjuncts(node):
            if isinstance(term, s.InQuery):
                df = self._in_query(term, df, rows)
            elif self._can_fail(term):
                risky.append(term)
            elif self._holds_query(term):
                df = self._marked(term, df, rows)
            else:
                plain.append(self.predicate(term, rows))
        for p in plain:
            df = df.where(p)
        if risky:
            guard = F.lit(True)
            for p in plain:
                guard = guard & p
            for term in risky:
                own = self.predicate(term, rows) if not self._holds_query(term) else None
                if own is None:
                    df = self._marked(term, df, rows)
                else:
                    guard = F.when(F.coalesce(guard, F.lit(False)), own).otherwise(F.lit(False)) if plain or len(risky) > 1 else own
            df = df.where(guard)
        return df

    def _conjuncts(self, node: object) -> Iterable[object]:
        if isinstance(node, s.Logic) and node.operator == "and":
            for t in node.terms:
                yield from self._conjuncts(t)
        else:
            yield node

    def _can_fail(self, node: object) -> bool:
        if isinstance(node, (s.Binary, s.Negative)):
            return any(True for _ in columns_in(node))
        if isinstance(node, s.Compare):
            return self._can_fail(node.left) or self._can_fail(node.right)
        if isinstance(node, s.Logic):
            return any(map(self._can_fail, node.terms))
        return isinstance(node, s.Not) and self._can_fail(node.term)

    def _holds_query(self, node: object) -> bool:
        if isinstance(node, s.InQuery):
            return True
        if isinstance(node, s.Logic):
            return any(map(self._holds_query, node.terms))
        return isinstance(node, s.Not) and self._holds_query(node.term)

    def _values(self, node: s.InQuery, rows: Rows) -> tuple[DataFrame, str, Column, Column]:
        """(the subquery's values, their column, the tested column, the same as a join key)."""
        answer = self.select(node.query, None)
        if len(answer.outputs) != 1:
            raise invalid("a query behind IN returns one column")
        name, kind = rows.find(node.column)
        out = answer.outputs[0]
        scalar.comparable("=", kind, out.type)
        value, column, held = F.col(out.ident), F.col(name), self.ident()
        if kind != out.type and "null" not in (kind, out.type):
            value, column = value.cast("double"), column.cast("double")
        elif out.type == "null":
            value = value.cast(scalar.SPARK_TYPES[kind])
        values = answer.df.select(value.alias(held))
        if self.strict and values.limit(MOST_VALUES + 1).count() > MOST_VALUES:
            raise EngineError("QUERY_WORK_LIMIT_EXCEEDED", f"a subquery returned more than {MOST_VALUES} rows")
        return values, held, column, F.col(held)

    def _in_query(self, node: s.InQuery, df: DataFrame, rows: Rows) -> DataFrame:
        """IN as a semi-join; NOT IN as an anti-join, without rows if a value is null or, unless there are no values, the column is."""
        values, _, column, held = self._values(node, rows)
        if not node.negated:
            return df.join(values, column == held, "left_semi")
        some, nulls = self.ident(), self.ident()
        told = values.agg(F.count(F.lit(1)).alias(some), F.count(F.when(held.isNull(), 1)).alias(nulls))
        kept = df.join(values.where(held.isNotNull()).distinct(), column == held, "left_anti")
        return kept.join(F.broadcast(told), (F.col(some) == 0) | ((F.col(nulls) == 0) & column.isNotNull())).drop(some, nulls)

    def _marked(self, node: object, df: DataFrame, rows: Rows) -> DataFrame:
        """A predicate with IN queries inside OR or NOT: each becomes a three-valued column."""
        marks: list[str] = []
        held = {"df": df}

        def marked(n: object) -> Column:
            if isinstance(n, s.InQuery):
                values, name, column, value = self._values(n, rows)
                hit, some, nulls = self.ident(), self.ident(), self.ident()
                told = values.agg(F.count(F.lit(1)).alias(some), F.count(F.when(value.isNull(), 1)).alias(nulls))
                known = values.where(value.isNotNull()).distinct().withColumn(hit, F.lit(True))
                held["df"] = held["df"].join(known, column == value, "left").join(F.broadcast(told), how="left", on=F.lit(True))
                marks.extend([name, hit, some, nulls])
                unknown = (column.isNull() & (F.col(some) > 0)) | (F.col(nulls) > 0)
                out = F.when(F.col(hit), F.lit(True)).when(unknown, F.lit(None).cast("boolean")).otherwise(F.lit(False))
                return ~out if n.negated else out
            if isinstance(n, s.Logic):
                terms = [marked(t) for t in n.terms]
                out = terms[0]
                for t in terms[1:]:
                    out = out & t if n.operator == "and" else out | t
                return out
            if isinstance(n, s.Not):
                return ~marked(n.term)
            return self.predicate(n, rows)

        test = marked(node)
        return held["df"].where(test).drop(*marks)

    # Sources

    def scan(self, source: s.TableSource) -> tuple[DataFrame, Source]:
        table = self.table(source.table)
        columns = {c.name: (self.ident(), c.type) for c in table.columns}
        df = self.frame(table).select(*(F.col(quoted(n)).alias(i) for n, (i, _) in columns.items()))
        return df, Source(source.alias, columns, tuple(columns[k][0] for k in table.primary_key) or tuple(i for i, t in columns.values() if t != "json"))

    def rows_of(self, query: s.Select, around: Around | None) -> Rows:
        if isinstance(query.source, s.QuerySource):
            if query.joins:
                raise refused("a query in FROM is not joined with tables")
            inner = self.finished(query.source.query, around)
            columns: dict[str, tuple[str, str]] = {}
            for o in inner.outputs:
                if o.name in columns:
                    raise invalid(f"the output name {o.name} repeats")
                columns[o.name] = (o.ident, o.type)
            return Rows(inner.df, [Source(query.source.alias, columns)], around, inner.order, inner.ties)
        df, first = self.scan(query.source)
        rows = Rows(df, [first], around, [], list(first.key))
        for join in query.joins:
            self._join(rows, join)
        if around is not None and around.columns:
            rows.df = rows.df.crossJoin(around.domain)  # equalities in WHERE make it an equi-join; without one it stays a loop over the distinct outer values
        return rows

    def _join(self, rows: Rows, join: s.Join) -> None:
        if any("." in n for n in rows.sources[0].columns):
            raise refused("a table with dotted column names can't be joined")
        if any(x.alias == join.source.alias for x in rows.sources):
            raise invalid(f"the alias {join.source.alias} repeats")
        if "." in join.source.alias or "." in rows.sources[0].alias:
            raise refused("a joined alias has no dot")
        df, source = self.scan(join.source)
        if any("." in n for n in source.columns):
            raise refused("a table with dotted column names can't be joined")
        before = Rows(rows.df, list(rows.sources), None)
        rows.sources.append(source)
        condition = None
        for pair in join.on:
            (a, at, a_new), (b, bt, b_new) = (self._side(c, before, source, rows) for c in pair)
            if a_new == b_new:
                raise refused("an ON equality connects the joined table with an earlier one")
            scalar.comparable("=", at, bt)
            if "json" in (at, bt):
                raise scalar.mismatch("JSON values are no join keys")
            x, y = F.col(a), F.col(b)
            test = x == y if at == bt else x.cast("double") == y.cast("double")
            condition = test if condition is None else condition & test
        rows.df = rows.df.join(df, condition, "left" if join.outer else "inner")
        rows.ties += source.key

    def _side(self, column: s.Column, before: Rows, source: Source, now: Rows) -> tuple[str, str, bool]:
        name, kind = now.find(column)
        return name, kind, any(name == i for i, _ in source.columns.values())

    # Queries

    def finished(self, query: s.Select, around: Around | None) -> Answer:
        """A query with its LIMIT and OFFSET applied."""
        answer = self.select(query, around)
        limit, offset = self.bounds(query)
        if limit is None and not offset:
            return answer
        if answer.single and answer.carried:
            answer.df = self._defaulted(self._back(around.domain, answer.df, answer.carried), answer.defaults)
        answer.single, answer.defaults = False, {}
        order = self.sort_columns(answer)
        if not answer.carried:
            df = answer.df.orderBy(*order) if order else answer.df
            df = df.offset(offset) if offset else df
            answer.df = df.limit(limit) if limit is not None else df
            return answer
        place = self.ident()
        window = Window.partitionBy(*answer.carried).orderBy(*(order or [F.lit(0)]))
        df = answer.df.withColumn(place, F.row_number().over(window)).where(F.col(place) > offset)
        answer.df = df.where(F.col(place) <= offset + limit) if limit is not None else df
        return answer

    def sort_columns(self, answer: Answer, ties: bool = True) -> list[Column]:
        named = [scalar.ordered(F.col(c), d, n) for c, d, n in answer.order]
        return named + ([F.col(t).asc_nulls_last() for t in answer.ties if t not in {c for c, _, _ in answer.order}] if ties else [])

    def bounds(self, query: s.Select) -> tuple[int | None, int]:
        out = []
        for node, most, what in ((query.limit, MAX_LIMIT, "LIMIT"), (query.offset, MAX_OFFSET, "OFFSET")):
            value = None if node is None else self.constant(node)
            if node is not None and (isinstance(value, bool) or not isinstance(value, int) or value < 0):
                raise invalid(f"{what} takes a non-negative integer")
            if value is not None and value > most:
                raise invalid(f"{what} is at most {most}")
            out.append(value)
        return out[0], out[1] or 0

    def select(self, query: s.Select, around: Around | None) -> Answer:
        """A query without its LIMIT and OFFSET."""
        rows = self.rows_of(query, around)
        made = [i.value for i in query.items if isinstance(i, s.Item)]
        gathers = [isinstance(v, s.JsonGather) for v in made]
        if any(gathers) and not all(gathers + [not isinstance(i, s.Star) for i in query.items]):
            raise refused("json_agg stands beside json_agg only")
        aggregated = bool(query.group) or any(isinstance(v, s.Aggregate) for v in made)
        if query.joins and aggregated:
            raise refused("aggregates over joins are not supported")
        if (query.distinct or aggregated) and (query.laterals or isinstance(query.source, s.QuerySource) or any(isinstance(v, (s.ScalarQuery, s.JsonRow, s.JsonGather)) for v in made)):
            raise refused("DISTINCT and aggregates have no nested queries")
        rows.df = self.where(query.where, rows)
        for lateral in query.laterals:
            self._lateral(rows, lateral)
        if isinstance(query.source, s.QuerySource) and not any(isinstance(v, (s.JsonRow, s.JsonGather)) for v in made):
            raise refused("a query in FROM gives only JSON values")
        if any(gathers):
            return self._gathered(query, rows)
        if aggregated:
            return self._aggregated(query, rows)
        outputs = self._outputs(query, rows)
        if query.distinct:
            return self._distinct(query, rows, outputs)
        order = self._order(query.order, outputs, rows) if query.order else rows.order
        return Answer(rows.df, outputs, order, rows.ties, rows.carried)

    def _outputs(self, query: s.Select, rows: Rows) -> list[Out]:
        outputs: list[Out] = []
        for item in query.items:
            if isinstance(item, s.Star):
                chosen = rows.sources if item.qualifier is None else [x for x in rows.sources if x.alias == item.qualifier]
                if not chosen:
                    raise invalid(f"no table of the query is named {item.qualifier}")
                outputs += [Out(n, t, i, i) for x in chosen for n, (i, t) in x.columns.items()]
                continue
            value = item.value
            if isinstance(value, s.Column):
                ident, kind = rows.find(value)
                outputs.append(Out(item.alias or value.name, kind, ident, ident))
            elif isinstance(value, s.ScalarQuery):
                ident, kind, name = self._scalar(rows, value.query)
                outputs.append(Out(item.alias or name, kind, ident))
            elif isinstance(value, s.JsonRow):
                ident = self.ident()
                rows.df = rows.df.withColumn(ident, self._json(value, rows))
                outputs.append(Out(item.alias or ("json_build_array" if value.array else "to_json"), "json", ident))
            else:
                ident = self.ident()
                column, kind = self.value(value, rows)
                rows.df = rows.df.withColumn(ident, column)
                outputs.append(Out(item.alias or "?column?", "text" if kind == "null" else kind, ident))
        if len(outputs) > MAX_COLUMNS:
            raise invalid(f"a row holds at most {MAX_COLUMNS} columns")
        return outputs

    def _order(self, terms: Sequence[s.Order], outputs: list[Out], rows: Rows | None) -> list[tuple[str, bool, bool]]:
        """Columns to sort by: an output's name comes before a source's column; without rows only outputs count."""
        out, kinds, computed = [], [], False
        for term in terms:
            found = [o for o in outputs if o.name == term.column.name] if term.column.qualifier is None else []
            if len({o.ident for o in found}) > 1:
                raise invalid(f"the name {term.column.name} is ambiguous in ORDER BY")
            if found:
                ident, kind = found[0].ident, found[0].type
                computed = computed or found[0].source is None
            elif rows is None:
                raise invalid(f"ORDER BY names {term.column.name}, which is not an output")
            else:
                ident, kind = rows.find(term.column)
            out.append((ident, term.descending, term.places_nulls_first))
            kinds.append(kind)
        if computed and any(ident not in {o.ident for o in outputs} for ident, _, _ in out):
            raise refused("ORDER BY names only outputs beside an output worked out from the row")
        if "json" in kinds:
            raise scalar.mismatch("JSON values have no order")
        return out

    def _distinct(self, query: s.Select, rows: Rows, outputs: list[Out]) -> Answer:
        if any(isinstance(i, s.Star) for i in query.items):
            raise refused("DISTINCT takes listed columns")
        if any(o.source is None for o in outputs):
            raise refused("DISTINCT takes plain columns")
        if any(o.type == "json" for o in outputs):
            raise scalar.mismatch("JSON values are not compared by DISTINCT")
        idents = list(dict.fromkeys(o.ident for o in outputs))
        shown = Rows(rows.df, rows.sources, rows.around)
        order = self._order(query.order, outputs, shown)
        if any(c not in idents for c, _, _ in order):
            raise invalid("ORDER BY names only outputs of DISTINCT")
        return Answer(rows.df.select(*idents, *rows.carried).distinct(), outputs, order, idents, rows.carried)

    def _aggregated(self, query: s.Select, rows: Rows) -> Answer:
        if query.distinct:
            raise refused("DISTINCT is not combined with aggregates")
        group: dict[str, str] = {}
        for column in query.group:
            ident, kind = rows.find(column)
            if kind == "json":
                raise scalar.mismatch("JSON values are not grouped")
            group[ident] = kind
        outputs, columns, counts, kinds = [], [], [], {}
        known: dict[tuple, str] = {}
        for item in query.items:
            if isinstance(item, s.Star):
                raise invalid("an aggregate query lists its columns")
            value = item.value
            if isinstance(value, s.Column):
                ident, kind = rows.find(value)
                if ident not in group:
                    raise invalid(f"the column {value.name} is not grouped")
                outputs.append(Out(item.alias or value.name, kind, ident, ident))
            elif isinstance(value, s.Aggregate):
                name, kind = rows.find(value.argument) if value.argument else (None, None)
                key = (value.function, name)
                if key not in known:
                    known[key] = self.ident()
                    column, kinds[key] = self._aggregate(value.function, name, kind)
                    columns.append(column.alias(known[key]))
                    if value.function == "count":
                        counts.append(known[key])
                outputs.append(Out(item.alias or value.function, kinds[key], known[key]))
            else:
                raise refused("an aggregate query returns only columns and aggregates")
        if sum(isinstance(i, s.Item) and isinstance(i.value, s.Aggregate) for i in query.items) > MAX_AGGREGATES:
            raise invalid(f"more than {MAX_AGGREGATES} aggregates")
        keys = [*group, *rows.carried]
        df = rows.df.groupBy(*keys).agg(*columns) if columns else rows.df.select(*keys).distinct()
        single = not group
        for key, ident in known.items():  # checked once, after adding up
            if key[0] == "sum":
                df = df.withColumn(ident, scalar.safe_integer(F.col(ident)) if kinds[key] == "integer" else scalar.finite(F.col(ident)))
        order = self._grouped_order(query.order, outputs, rows)
        return Answer(df, outputs, order, list(group), rows.carried, single, dict.fromkeys(counts, 0) if single else {})

    def _grouped_order(self, terms: Sequence[s.Order], outputs: list[Out], rows: Rows) -> list[tuple[str, bool, bool]]:
        out = []
        for term in terms:
            if term.column.qualifier is not None:
                ident, _ = rows.find(term.column)
                if ident not in {o.ident for o in outputs}:
                    raise invalid(f"ORDER BY names {term.column.name}, which is not an output")
                out.append((ident, term.descending, term.places_nulls_first))
            else:
                out += self._order([term], outputs, None)
        return out

    def _aggregate(self, function: str, name: str | None, kind: str | None) -> tuple[Column, str]:
        if name is None:
            return F.count(F.lit(1)), "integer"
        column = F.col(name)
        if function == "count":
            return F.count(column), "integer"
        if function in ("sum", "avg"):
            if kind not in scalar.NUMBERS:
                raise scalar.mismatch(f"{function} takes numbers, not {kind}")
            return (F.sum(column), kind) if function == "sum" else (F.avg(column), "float")
        if kind not in (*scalar.NUMBERS, "text"):
            raise scalar.mismatch(f"{function} takes numbers and texts, not {kind}")
        return (F.min(column) if function == "min" else F.max(column)), kind

    # Nested queries

    def _back(self, left: DataFrame, right: DataFrame, carried: Sequence[str]) -> DataFrame:
        """Every row of `left` with the row of `right` that has the same carried values."""
        new = {c: self.ident() for c in carried}
        renamed = right.select(*(F.col(c).alias(new.get(c, c)) for c in right.columns))
        condition = None
        for c, n in new.items():
            test = F.col(c).eqNullSafe(F.col(n))
            condition = test if condition is None else condition & test
        return left.join(renamed, condition, "left").drop(*new.values())

    def nested(self, rows: Rows, query: s.Select) -> tuple[Answer, dict[str, str]]:
        """A nested query over the distinct values that it reads of `rows`, and which column holds which of them."""
        read = sorted(free_columns(query))
        if not read:
            return self.finished(query, None), {}
        found = {ref: rows.find(s.Column(*ref)) for ref in read}
        new = {ident: self.ident() for ident in dict.fromkeys(i for i, _ in found.values())}
        domain = rows.df.select(*(F.col(i).alias(n) for i, n in new.items())).distinct()
        around = Around(domain, {ref: (new[i], t) for ref, (i, t) in found.items()})
        return self.finished(query, around), new

    @staticmethod
    def _defaulted(df: DataFrame, defaults: dict[str, object]) -> DataFrame:
        return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})

    def _attach(self, rows: Rows, answer: Answer, held: dict[str, str], new: dict[str, str]) -> None:
        """The nested columns (`held`: their new names) beside the rows that they were made for."""
        right = answer.df.select(*(F.col(i).alias(n) for n, i in held.items()), *answer.carried)
        self._attach_rows(rows, right, new)
        rows.df = self._defaulted(rows.df, {n: answer.defaults[i] for n, i in held.items() if i in answer.defaults})

    def _attach_rows(self, rows: Rows, right: DataFrame, new: dict[str, str]) -> None:
        if not new:
            rows.df = rows.df.join(F.broadcast(right), F.lit(True), "left")
            return
        condition = None
        for ident, carried in new.items():
            test = F.col(ident).eqNullSafe(F.col(carried))
            condition = test if condition is None else condition & test
        rows.df = rows.df.join(right, condition, "left").drop(*new.values())

    def _scalar(self, rows: Rows, query: s.Select) -> tuple[str, str, str]:
        answer, new = self.nested(rows, query)
        if len(answer.outputs) != 1:
            raise invalid("a nested query in a select list returns one column")
        out = answer.outputs[0]
        held, one, many = self.ident(), out.ident, self.ident()
        if not answer.single:
            one = self.ident()
            found = answer.df.groupBy(*answer.carried).agg(F.first(out.ident).alias(one), F.count(F.lit(1)).alias(many))
            answer.df = found.withColumn(one, F.when(F.col(many) > 1, scalar.failure("INVALID_QUERY", "a nested query gave more than one row")).otherwise(F.col(one)))
        self._attach(rows, answer, {held: one}, new)
        return held, out.type, out.name

    def _lateral(self, rows: Rows, lateral: s.Lateral) -> None:
        if lateral.alias in {x.alias for x in rows.sources} | set(rows.laterals):
            raise invalid(f"the alias {lateral.alias} repeats")
        answer, new = self.nested(rows, lateral.query)
        columns: dict[str, tuple[str, str]] = {}
        held = {o.ident: self.ident() for o in answer.outputs}
        for o in answer.outputs:
            if o.name in columns:
                raise invalid(f"the output name {o.name} repeats")
            columns[o.name] = (held[o.ident], o.type)
        if not answer.single:  # the first row only
            order = self.sort_columns(answer) or [F.lit(0)]
            if answer.carried:
                place = self.ident()
                window = Window.partitionBy(*answer.carried).orderBy(*order)
                answer.df = answer.df.withColumn(place, F.row_number().over(window)).where(F.col(place) == 1)
            else:
                answer.df = answer.df.orderBy(*order).limit(1)
        self._attach(rows, answer, {n: i for i, n in held.items()}, new)
        rows.laterals[lateral.alias] = Source(lateral.alias, columns)

    def _json(self, value: s.JsonRow, rows: Rows) -> Column:
        def one(column: s.Column) -> Column:
            ident, kind = rows.find(column)
            return json_text.text_of(F.col(ident), kind)

        if value.array is not None:
            return json_text.array_of([one(c) for c in value.array])
        if value.column is not None:
            return one(value.column)
        for source in (*rows.sources, *rows.laterals.values()):
            if source.alias == value.alias:
                return json_text.object_of({n: json_text.text_of(F.col(i), t) for n, (i, t) in source.columns.items()})
        raise invalid(f"no table of the query is named {value.alias}")

    def _gathered(self, query: s.Select, rows: Rows) -> Answer:
        if query.group or query.order or query.distinct:
            raise refused("a query that gathers JSON has no GROUP BY, ORDER BY or DISTINCT of its own")
        outputs, columns = [], []
        for item in query.items:
            gather, ident = item.value, self.ident()
            order = [(rows.find(o.column), o) for o in gather.order]
            if any(kind == "json" for (_, kind), _ in order):
                raise scalar.mismatch("JSON values have no order")
            chosen = [(i, o.descending, o.places_nulls_first) for (i, _), o in order] or rows.order
            keys = [*chosen, *((t, False, False) for t in rows.ties if t not in {c for c, _, _ in chosen})]
            element = self._json(gather.element, rows)
            each = F.collect_list(F.struct(*(F.col(c).alias(f"k{k}") for k, (c, _, _) in enumerate(keys)), element.alias("e")))
            in_order = F.transform(F.array_sort(each, scalar.comparator([(f"k{k}", d, n) for k, (_, d, n) in enumerate(keys)])) if keys else each, lambda x: x["e"])
            columns.append(F.when(F.count(F.lit(1)) > 0, F.concat(F.lit("["), F.array_join(in_order, ","), F.lit("]"))).alias(ident))
            outputs.append((Out(item.alias or ("coalesce" if gather.coalesced else "json_agg"), "json", ident), gather.coalesced))
        df = rows.df.groupBy(*rows.carried).agg(*columns)
        defaults = {o.ident: "[]" for o, coalesced in outputs if coalesced}
        return Answer(self._defaulted(df, defaults), [o for o, _ in outputs], [], [], rows.carried, True, defaults)

    # The whole statement

    def answer(self, query: s.Select, arrays: bool) -> Answer:
        """The query's rows in their order, with all outputs."""
        limit, offset = self.bounds(query)
        answer = self.select(query, None)
        if not arrays and len({o.name for o in answer.outputs}) != len(answer.outputs):
            raise invalid("output names repeat; give them aliases, or read rows as arrays")
        cut = limit is not None or offset > 0
        order = self.sort_columns(answer, ties=cut) if query.order or cut else []
        df = answer.df.orderBy(*order) if order else answer.df
        df = df.offset(offset) if offset else df
        answer.df = df.limit(limit) if limit is not None else df
        return answer
