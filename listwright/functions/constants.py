"""Constants as single SQL literals.

The optimizer folds each to one value, so no row pays for building it, and the plan is built with
one call instead of one per entry.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sql(value) -> str:
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    if isinstance(value, dict):
        return "named_struct(" + ", ".join(f"{_sql(k)}, {_sql(v)}" for k, v in value.items()) + ")"
    return "array(" + ", ".join(map(_sql, value)) + ")" if value else "cast(array() as array<string>)"


def constant(value) -> Column:
    """Constant list of strings or of records. Written as one SQL literal, which the optimizer folds
    to a single value, so no row pays for building it."""
    return F.expr(_sql(value))


def constant_map(table: Mapping[str, str]) -> Column:
    if not table:
        return F.expr("cast(map() as map<string,string>)")
    return F.expr("map(" + ", ".join(f"{_sql(k)}, {_sql(v)}" for k, v in table.items()) + ")")
