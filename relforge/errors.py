"""Errors with stable codes."""

from __future__ import annotations

import re


class EngineError(Exception):
    """A refused or failed statement; `code` tells what kind."""

    def __init__(self, code: str, message: str):
        super().__init__(f"{code}: {message}")
        self.code = code
        self.message = message


#: Run-time failures are raised by Spark with a message that begins so.
MARK = "relforge!"

_SPARK = {
    "DIVIDE_BY_ZERO": "DIVISION_BY_ZERO",
    "REMAINDER_BY_ZERO": "DIVISION_BY_ZERO",
    "ARITHMETIC_OVERFLOW": "NUMERIC_OVERFLOW",
}


def translated(error: Exception) -> Exception:
    """The engine's error for one that a Spark job raised, or the same error."""
    text = str(error)
    if found := re.search(rf"{MARK}([A-Z_]+)!([^!]*)!", text):
        return EngineError(found[1], found[2])
    for name, code in _SPARK.items():
        if f"[{name}" in text:
            return EngineError(code, {"DIVISION_BY_ZERO": "division by zero"}.get(code, "a number is out of range"))
    return error
