"""JSON values are kept as canonical text: keys sorted, no spaces; SQL NULL is JSON null."""

from __future__ import annotations

import json
import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import EngineError

MAX_DEPTH = 64


def _check(value: object, depth: int = 0) -> None:
    if depth > MAX_DEPTH:
        raise EngineError("INVALID_CHANGE", f"JSON nests deeper than {MAX_DEPTH}")
    if isinstance(value, dict):
        for k, v in value.items():
            if not isinstance(k, str):
                raise EngineError("TYPE_MISMATCH", "a JSON object's keys are strings")
            _check(v, depth + 1)
    elif isinstance(value, (list, tuple)):
        for v in value:
            _check(v, depth + 1)
    elif isinstance(value, float) and not math.isfinite(value):
        raise EngineError("TYPE_MISMATCH", "JSON numbers are finite")
    elif not isinstance(value, (str, int, float, bool, type(None))):
        raise EngineError("TYPE_MISMATCH", f"{type(value).__name__} is no JSON value")


def canonical(value: object) -> str | None:
    """The canonical text of a Python value; None for None."""
    _check(value)
    return None if value is None else json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":"))


def parsed(text: str) -> object:
    """The value of JSON text as SQL writes it in a default."""
    try:
        return json.loads(text)
    except ValueError:
        raise EngineError("INVALID_SCHEMA", "a JSON default is not JSON") from None


def quoted(text: Column) -> Column:
    """JSON text of a string column; null stays null."""
    whole = F.to_json(F.array(text))
    return F.when(text.isNotNull(), F.substring(whole, F.lit(2), F.length(whole) - 2))


def text_of(value: Column, kind: str) -> Column:
    """JSON text of a column of a runtime type; 'null' for null."""
    if kind == "text":
        out = quoted(value)
    elif kind == "json":
        out = value
    else:
        out = value.cast("string")
    return F.coalesce(out, F.lit("null"))


def array_of(parts: list[Column]) -> Column:
    return F.concat(F.lit("["), F.concat_ws(",", *parts), F.lit("]")) if parts else F.lit("[]")


def object_of(fields: dict[str, Column]) -> Column:
    """JSON text of an object whose values are JSON texts."""
    parts = [F.concat(F.lit(json.dumps(k, ensure_ascii=False) + ":"), fields[k]) for k in sorted(fields)]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")) if parts else F.lit("{}")


def equal(a: Column, b: Column) -> Column:
    """Structural equality; numbers at the top compare by value."""
    x, y = a.try_cast("double"), b.try_cast("double")
    return F.when(x.isNotNull() & y.isNotNull(), x == y).otherwise(a == b)
