"""Small column expressions that several plans share."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from rasterway.errors import ConfigError

METERS_IN_MILE = 1609.344
#: Names of aggregates that reports may ask for.
AGGREGATES = {
    "mean": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "std": F.stddev_pop, "var": F.var_pop, "median": F.median,
    "count": F.count, "any": lambda c: F.max((c != 0).cast("int")), "all": lambda c: F.min((c != 0).cast("int")), "prod": F.product, "argmax": None, "argmin": None,
}
_WHERE = re.compile(r"^\s*(!=|>=|<=|==|>|<)\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)\s*$")


def aggregate(name: str):
    """The aggregate of that name, which must exist."""
    found = AGGREGATES.get(name)
    if found is None:
        raise ConfigError(f"unknown aggregate {name!r}")
    return found


def parse_where(text: str) -> tuple[str, float]:
    """('>=', 15.0) of '>=15'."""
    found = _WHERE.match(text)
    if not found:
        raise ConfigError(f"not a condition: {text!r}")
    return found[1], float(found[2])


def compare(value: Column, operator: str, threshold: float) -> Column:
    """IEEE comparison: a NaN or a missing value is unequal to all and nothing else."""
    t = F.lit(threshold).cast("float")
    plain = {">": value > t, ">=": value >= t, "<": value < t, "<=": value <= t, "==": value == t, "!=": value != t}
    if operator not in plain:
        raise ConfigError(f"unknown operator {operator!r}")
    if operator == "!=":
        return F.coalesce(F.isnan(value) | plain[operator], F.lit(True))
    return F.coalesce(~F.isnan(value) & plain[operator], F.lit(False))


def where(value: Column, condition: str) -> Column:
    return compare(value, *parse_where(condition))


def single(value) -> Column:
    """A 32-bit float column or literal."""
    return (value if isinstance(value, Column) else F.lit(value)).cast("float")


def product(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a * b, columns)


def total(columns: list[Column]) -> Column:
    """Columns added up in order, in their own type."""
    return reduce(lambda a, b: a + b, columns)


def any_of(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, columns) if columns else F.lit(False)


def per_cell(per_mile: Column, cell: float) -> Column:
    """Dollars a mile to dollars a cell."""
    return per_mile / F.lit(METERS_IN_MILE) * F.lit(cell)


def fixed_point(cost: Column) -> Column:
    """A cost in ten-thousandths, cut off, as the search adds it up."""
    return (single(cost) * single(10000)).cast("bigint")


def from_fixed_point(cost: Column) -> Column:
    return (cost.cast("float") / single(10000)).cast("float")
