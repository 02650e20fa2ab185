"""Row filters and mismatch predicates as Catalyst expressions.

Three-valued logic is spelled out where it matters: ``ne`` and ``not_in`` keep null rows, a
comparison between type classes is false for equality and an error for ordering.
"""

from __future__ import annotations

import datetime as dt
import functools
import operator
from collections.abc import Mapping, Sequence
from decimal import Decimal
from typing import Any, NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crosstally.errors import ReconcileInputError
from crosstally.functions.types import column_class, quoted, require_columns

# The accepted filter operators.
FILTER_OPERATORS = (
    "eq", "ne", "gt", "gte", "lt", "lte", "in", "not_in", "is_null", "not_null",
)

_ORDERED = {"gt": operator.gt, "gte": operator.ge, "lt": operator.lt, "lte": operator.le}


def _value_class(value: Any) -> str:
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, (int, float, Decimal)):
        return "numeric"
    if isinstance(value, (dt.date, dt.datetime)):
        return "temporal"
    if isinstance(value, str):
        return "string"
    return "other"


def _operand(cls: str, value: Any) -> Column | None:
    """``value`` as a literal comparable with a column of class ``cls``, or None."""
    given = _value_class(value)
    if cls == "temporal" and given == "string":
        try:
            return F.lit(dt.datetime.fromisoformat(value))
        except ValueError:
            return None
    if {cls, given} == {"numeric", "boolean"}:
        return F.lit(int(value)) if cls == "numeric" else F.lit(bool(value)) if value in (0, 1) else None
    return F.lit(value) if given == cls else None


class Filter(NamedTuple):
    """One condition on a column; plain mappings with the same fields are accepted too."""

    column: str
    operator: str = "eq"
    value: Any = None

    @classmethod
    def of(cls, given: Filter | Mapping[str, Any]) -> Filter:
        if isinstance(given, Filter):
            return given
        unknown = sorted(set(given) - set(cls._fields))
        if unknown or not isinstance(given.get("column"), str):
            raise ReconcileInputError(f"a filter has column, operator and value: {dict(given)!r}")
        return cls(**given)


def condition_column(df: DataFrame, condition: Filter | Mapping[str, Any]) -> Column:
    """One condition as a boolean column."""
    name, op, value = Filter.of(condition)
    op = op.lower()
    require_columns(df, [name])
    if op not in FILTER_OPERATORS:
        raise ReconcileInputError(f"{op!r} is no filter operator; use {', '.join(FILTER_OPERATORS)}")
    column, cls = quoted(name), column_class(df, name)
    if op == "is_null":
        return column.isNull()
    if op == "not_null":
        return column.isNotNull()
    if op in _ORDERED:
        operand = _operand(cls, value)
        if operand is None:
            raise ReconcileInputError(f"cannot order {name} ({cls}) against {value!r}")
        return _ORDERED[op](column, operand)
    if op in ("eq", "ne"):
        operand = _operand(cls, value)
        if operand is None:
            return F.lit(op == "ne")
        return column == operand if op == "eq" else ~column.eqNullSafe(operand)
    values = value if isinstance(value, (list, tuple, set)) else [value]
    operands = [o for o in (_operand(cls, v) for v in values) if o is not None]
    found = column.isin(*operands) if operands else F.lit(False)
    return found if op == "in" else ~F.coalesce(found, F.lit(False))


def apply_filters(df: DataFrame, conditions: Sequence[Filter | Mapping[str, Any]] | None) -> DataFrame:
    """Keep the rows that satisfy every condition (one ``where``, so it reaches the scan)."""
    if not conditions:
        return df
    return df.where(functools.reduce(operator.and_, (condition_column(df, c) for c in conditions)))


def one_is_null(a: Column, b: Column) -> Column:
    return a.isNull() != b.isNull()


def values_differ(a: Column, b: Column, numeric: bool, tolerance: float = 0.0) -> Column:
    """Never null: numeric beyond tolerance, or unequal, or null (NaN) on exactly one side."""
    if numeric:
        # Not nullif: it makes Spark project a name per use, and derive constraints for all combinations.
        x, y = (F.when(~F.isnan(side.cast("double")), side.cast("double")) for side in (a, b))
        beyond = F.abs(x - y) > F.lit(float(tolerance))
        return F.coalesce(beyond, F.lit(False)) | one_is_null(x, y)
    return ~a.eqNullSafe(b)
