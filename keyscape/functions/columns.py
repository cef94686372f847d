"""Small helpers shared by the expression modules."""

from __future__ import annotations

from collections.abc import Mapping
from functools import lru_cache, wraps

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def joined(values: Column, sep: str = ",") -> Column:
    """Sorted array as one delimited string (used by tabular outputs)."""
    return F.array_join(F.array_sort(values), sep)


def let(value, use) -> Column:
    """Bind ``value`` once and use it several times, so that an expression used
    in many places does not multiply the size of the plan."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def reusable(build):
    """Build an expression on a named column once per process: expressions are
    immutable, and the long ones take longer to build than to plan. Any other
    argument is bound once, so nesting adds up instead of multiplying."""
    cached = lru_cache(maxsize=512)(build)

    @wraps(build)
    def wrapper(*args):
        if all(isinstance(a, (str, int)) for a in args):
            return cached(*args)
        return let(args[0], lambda x: build(x, *args[1:]))

    return wrapper


def map_literal(entries: Mapping) -> Column:
    """Constant map, parsed in one step."""
    def text(x) -> str:
        return str(x) if isinstance(x, int) else "'" + x.replace("'", "\\'") + "'"

    return F.expr("map(" + ", ".join(f"{text(k)}, {text(v)}" for k, v in entries.items()) + ")")
