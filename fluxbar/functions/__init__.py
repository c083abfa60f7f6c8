"""Column helpers with one representation of what is missing: NULL."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def finite(x) -> Column:
    """NaN and infinities become NULL."""
    x = F.col(x) if isinstance(x, str) else x
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def div(a, b) -> Column:
    """a / b; NULL where b is 0."""
    return F.try_divide(a, b)


def ln(x) -> Column:
    x = F.col(x) if isinstance(x, str) else x
    return F.when(x > 0, F.log(x))


def clip(x, low, high) -> Column:
    """NULL stays NULL, which greatest and least alone would skip."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def safe_corr(x, y, over: WindowSpec | None = None) -> Column:
    """Pearson correlation; NULL if either side is constant."""
    parts = [F.covar_samp(x, y), F.stddev_samp(F.when(F.col(y).isNotNull(), F.col(x))), F.stddev_samp(F.when(F.col(x).isNotNull(), F.col(y)))]
    c, sx, sy = [p.over(over) for p in parts] if over is not None else parts
    return div(c, sx * sy)


def series(*keys: str, order: str | list[str]) -> WindowSpec:
    """A window over each series in its order. Every window of the library names its order; none relies on row positions."""
    return Window.partitionBy(*keys).orderBy(*([order] if isinstance(order, str) else order))


def trailing(w: WindowSpec, n: int, skip: int = 0) -> WindowSpec:
    """The last n rows; skip=1 leaves the current row out."""
    return w.rowsBetween(-(n - 1) - skip, -skip)


def guarded(value: Column, x, w: WindowSpec, least: int) -> Column:
    """value over w where w holds at least so many non-null x."""
    return F.when(F.count(x).over(w) >= least, value)
