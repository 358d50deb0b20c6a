"""Values in Python's literal notation, as some tools keep nested records in text columns."""

from __future__ import annotations

import ast
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def _literal(text: str | None) -> str | None:
    """What a literal stands for, as JSON: evaluated again while it is a string that is a literal itself; null for what isn't one."""
    value = text
    while isinstance(value, str):
        try:
            value = ast.literal_eval(value)
        except (ValueError, SyntaxError, MemoryError, RecursionError):
            return None if value is text else json.dumps(value)
    return None if value is None else json.dumps(value, default=list)


@F.pandas_udf(StringType())
def from_repr(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Python literals as JSON."""
    for b in batches:
        yield b.map(_literal)


@F.pandas_udf(StringType())
def _to_repr(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for b in batches:
        yield b.map(lambda x: None if x is None else repr(json.loads(x)))


def to_repr(json_text: str | Column) -> Column:
    """JSON in Python's notation."""
    return _to_repr(F.col(json_text) if isinstance(json_text, str) else json_text)
