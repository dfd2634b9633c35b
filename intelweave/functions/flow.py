"""Evaluate an expensive value once.

Catalyst merges projections and pushes filters down by substituting expressions,
so a long text expression that is used k times may run k times per row. Two
guards keep it to one run: :func:`bind` inside an expression, and
:func:`with_computed` between operators.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def string_array(values: list[str]) -> Column:
    """Array literal parsed from one SQL text, rather than one driver call per element."""
    if not values:
        return F.array().cast("array<string>")
    quoted = ["'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'" for v in values]
    return F.expr(f"array({', '.join(quoted)})")


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often ``body`` uses it."""
    return F.element_at(F.transform(F.array(value), lambda v: body(v)), 1)


def with_computed(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns behind a one-row generator, which nothing above is pushed through.

    A no-shuffle, fully pipelined step; existing columns of the same name are replaced.
    """
    fields = F.struct(*[c.alias(name) for name, c in columns.items()])
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, F.inline(F.array(fields)))
