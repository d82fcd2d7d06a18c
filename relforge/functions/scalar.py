"""Typed scalar operations as Spark columns.

Run-time failures surface through Spark's ANSI checks or raise_error.  Guards
name their operand once, so nested expressions grow linearly.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import MARK, EngineError

SAFE = 9_007_199_254_740_991
SPARK_TYPES = {"boolean": "boolean", "integer": "bigint", "float": "double", "text": "string", "json": "string", "null": "string"}
OIDS = {"boolean": 16, "integer": 20, "text": 25, "json": 114, "float": 701, "null": 25}  # fixed values
NUMBERS = ("integer", "float")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def failure(code: str, message: str) -> Column:
    return F.raise_error(F.lit(f"{MARK}{code}!{message}!"))


def mismatch(message: str) -> EngineError:
    return EngineError("TYPE_MISMATCH", message)


def type_of(value: object) -> str:
    """The runtime type of a Python value."""
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, int):
        return "integer"
    if isinstance(value, float):
        return "float"
    if isinstance(value, str):
        return "text"
    return "json"


def safe_value(value: object) -> object:
    if isinstance(value, int) and not isinstance(value, bool) and abs(value) > SAFE:
        raise EngineError("BIND_ERROR", f"the integer {value} is out of range")
    if isinstance(value, float) and not math.isfinite(value):
        raise EngineError("BIND_ERROR", "numbers are finite")
    return value


def literal(value: object, kind: str) -> Column:
    return F.lit(value).cast(SPARK_TYPES[kind])


def safe_integer(value: Column) -> Column:
    """The value, or NUMERIC_OVERFLOW: 1,024 times what is past 53 bits is past 64."""
    step = F.lit(1024).cast("bigint")
    up = F.call_function("div", value * step, step)
    return -F.call_function("div", -up * step, step)


def finite(value: Column) -> Column:
    return F.when(F.isnan(value) | (F.abs(value) == F.lit(float("inf"))), failure("NUMERIC_OVERFLOW", "a number is out of range")).otherwise(value)


def arithmetic(operator: str, a: Column, at: str, b: Column, bt: str) -> tuple[Column, str]:
    """`a operator b` and its type."""
    if operator == "||":
        for t in (at, bt):
            if t not in ("text", "null"):
                raise mismatch(f"|| joins texts, not {t}")
        return F.concat(a, b), "text"
    for t in (at, bt):
        if t not in (*NUMBERS, "null"):
            raise mismatch(f"{operator} takes numbers, not {t}")
    if "float" in (at, bt):
        if operator == "%":
            raise mismatch("% takes integers")
        x, y = a.cast("double"), b.cast("double")
        return {"+": lambda: x + y, "-": lambda: x - y, "*": lambda: x * y, "/": lambda: x / y}[operator](), "float"
    x, y = a.cast("bigint"), b.cast("bigint")
    if operator == "%":
        return x % y, "integer"
    if operator == "/":
        return F.call_function("div", x, y), "integer"
    return safe_integer({"+": lambda: x + y, "-": lambda: x - y, "*": lambda: x * y}[operator]()), "integer"


def negative(a: Column, at: str) -> tuple[Column, str]:
    if at not in (*NUMBERS, "null"):
        raise mismatch(f"- takes numbers, not {at}")
    return (-a.cast("double"), "float") if at == "float" else (-a.cast("bigint"), "integer")


def comparable(operator: str, at: str, bt: str) -> None:
    """Refuse a comparison that the types rule out, before any row is read."""
    if "json" in (at, bt):
        if operator not in ("=", "<>"):
            raise mismatch("JSON values have no order")
        if at != bt and "null" not in (at, bt):
            raise mismatch(f"{at} and {bt} can't be compared")
        return
    if "null" in (at, bt) or at == bt or (at in NUMBERS and bt in NUMBERS):
        return
    raise mismatch(f"{at} and {bt} can't be compared")


def like_pattern(pattern: str, escape: str | None) -> str:
    """The pattern with backslash as its escape and nothing but %, _ and backslash escaped."""
    mark = "\\" if escape is None else escape
    out, p = [], 0
    while p < len(pattern):
        c = pattern[p]
        if mark and c == mark:
            p += 1
            if p == len(pattern):
                raise EngineError("INVALID_QUERY", "a pattern ends in its escape character")
            c = pattern[p]
            out.append("\\" + c if c in "%_\\" else c)
        else:
            out.append("\\\\" if c == "\\" else c)
        p += 1
    return "".join(out)


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def ordered(column: Column, descending: bool, nulls_first: bool) -> Column:
    if descending:
        return column.desc_nulls_first() if nulls_first else column.desc_nulls_last()
    return column.asc_nulls_first() if nulls_first else column.asc_nulls_last()


def comparator(keys: Sequence[tuple[str, bool, bool]]) -> Callable[[Column, Column], Column]:
    """How two structs compare by their fields (name, descending, nulls first), for sorting an array."""

    def compare(a: Column, b: Column) -> Column:
        out = F.lit(0)
        for name, descending, nulls_first in reversed(keys):
            x, y = (b[name], a[name]) if descending else (a[name], b[name])
            first, last = (F.lit(-1), F.lit(1)) if nulls_first else (F.lit(1), F.lit(-1))
            one_null = F.when(a[name].isNull() & b[name].isNotNull(), first).when(a[name].isNotNull() & b[name].isNull(), last)
            out = one_null.when(x < y, F.lit(-1)).when(x > y, F.lit(1)).otherwise(out)
        return out

    return compare
