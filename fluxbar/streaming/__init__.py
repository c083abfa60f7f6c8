"""The time bars and book snapshots over unbounded trades: a watermark bounds the state, later rows are left out."""

from __future__ import annotations

from pyspark.sql import DataFrame

from fluxbar.operators import bars


def time_bars(trades: DataFrame, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """bars.time_bars() of a stream; a bar comes out once the watermark has passed its end."""
    return bars.time_bars(trades.withWatermark("ts", late), width)


def book_snapshots(quotes: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    return bars.book_snapshots(quotes.withWatermark("ts", late), width)
