"""Existing tables of files as read-only tables of the five runtime types."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import EngineError
from .catalog import ColumnDef, TableDef, quoted

_KINDS = {
    T.BooleanType: "boolean", T.ByteType: "integer", T.ShortType: "integer", T.IntegerType: "integer", T.LongType: "integer",
    T.FloatType: "float", T.DoubleType: "float", T.StringType: "text",
}


def attached(name: str, df: DataFrame, primary_key: Sequence[str] = (), json_columns: Sequence[str] = (), text_columns: Sequence[str] = ()) -> tuple[TableDef, DataFrame]:
    """A definition for `df` and its rows in runtime types.

    Columns of other types (dates, arrays) are left out, but for those that
    `text_columns` asks to be rendered as text.  `json_columns` hold JSON text,
    taken as it is.  Without a primary key the table can only be read.  Casts
    are plain ones, so filters on whole columns still reach the files.
    """
    columns, shown = [], []
    spark_types: Mapping[str, T.DataType] = {f.name: f.dataType for f in df.schema.fields}
    for column, kind in spark_types.items():
        own = F.col(quoted(column))
        if column in json_columns:
            runtime = "json"
        elif column in text_columns:
            runtime, own = "text", own.cast("string")
        else:
            runtime = _KINDS.get(type(kind))
            if runtime is None:
                continue
            if runtime == "integer" and not isinstance(kind, T.LongType):
                own = own.cast("bigint")
            if isinstance(kind, T.FloatType):
                own = own.cast("double")
        columns.append(ColumnDef(column, runtime, column not in primary_key))
        shown.append(own.alias(column))
    table = TableDef(name, tuple(columns), tuple(primary_key), attached=True)
    for key in primary_key:
        if not table.has(key):
            raise EngineError("COLUMN_NOT_FOUND", f"table {name} has no column {key}")
    return table, df.select(*shown)
