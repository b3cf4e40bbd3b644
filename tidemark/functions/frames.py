"""Window frames over (symbol, time) and the warm-up rules of rolling expressions.

Every expression here is a Column; all frames of one select share one sort by (symbol, time).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

KEY, TIME = "symbol", "time"


#: What windows are partitioned by: the symbol, and in ranged() also the number of its range.
_keys: tuple[str, ...] = (KEY,)


@contextmanager
def keyed(*keys: str) -> Iterator[None]:
    """Windows that are built inside are partitioned by these columns."""
    global _keys
    before, _keys = _keys, keys
    try:
        yield
    finally:
        _keys = before


def keys() -> tuple[str, ...]:
    return _keys


def by_time() -> WindowSpec:
    return Window.partitionBy(*_keys).orderBy(TIME)


def rows(first: int, last: int) -> WindowSpec:
    return by_time().rowsBetween(first, last)


def last_rows(n: int) -> WindowSpec:
    return rows(-(n - 1), 0)


def running() -> WindowSpec:
    return by_time().rowsBetween(Window.unboundedPreceding, 0)


def earlier() -> WindowSpec:
    return by_time().rowsBetween(Window.unboundedPreceding, -1)


def whole() -> WindowSpec:
    return Window.partitionBy(*_keys)


def prev(c: Column | str, k: int = 1) -> Column:
    return F.lag(c, k).over(by_time())


def rolling(c: Column | str, n: int, agg: Callable[[Column], Column], least: int | None = None) -> Column:
    """agg over the last n rows, null until `least` of them (n if not given) have a value."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(F.count(c).over(last_rows(n)) >= (least or n), agg(c).over(last_rows(n)))


def after(c: Column, n: int) -> Column:
    """c, but null in the first n rows of each symbol."""
    return F.when(F.row_number().over(by_time()) > n, c)


def flag(c: Column) -> Column:
    """1 or 0; null counts as 0."""
    return F.coalesce(c, F.lit(False)).cast("int")


def nonzero(c: Column) -> Column:
    """c, with 0 as null."""
    return F.when(c != 0, c)


def clean(c: Column) -> Column:
    """NaN and the infinities as null."""
    return F.when(~(F.isnan(c) | (F.abs(c) == float("inf"))), c)


def clip(c: Column, low: float, high: float) -> Column:
    """Null stays null."""
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(low)), F.lit(high)))
