"""Bars by time, value traded and variance, book snapshots, and continuous contracts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fluxbar.functions import div, ln, series


def time_bars(trades: DataFrame, width: str = "5 minutes") -> DataFrame:
    """(root, bar_end) with last price, volume and order-flow imbalances; buckets are closed on the left and named by their end."""
    bucket = F.window("ts", width)
    big = F.col("size") >= 4
    sign = F.when(F.col("side") == "B", 1).when(F.col("side") == "A", -1).otherwise(0)
    flow = lambda c: div(F.sum(F.when(c, sign * F.col("size"))), F.sum(F.when(c & (sign != 0), F.col("size"))))
    return trades.groupBy("root", bucket.alias("w")).agg(
        F.max_by("price", F.struct("ts", "seq")).alias("close"), F.sum("size").alias("volume"), F.count(F.lit(1)).alias("n"),
        flow(big).alias("ofi_large"), flow(~big).alias("ofi_small"),
    ).select("root", F.col("w.end").cast("timestamp_ntz").alias("bar_end"), "close", "volume", "n", "ofi_large", "ofi_small")


def book_snapshots(quotes: DataFrame, width: str = "1 hour") -> DataFrame:
    """Last valid quote of each bucket: mid, spread in basis points, imbalance, and the count of quotes; named by the bucket's start."""
    fine = quotes.where((F.col("bid") > 0) & (F.col("ask") > 0) & (F.col("ask") >= F.col("bid")))
    last = F.max_by(F.struct("bid", "ask", "bid_size", "ask_size"), F.struct("ts", "seq"))
    df = fine.groupBy("root", F.window("ts", width).alias("w")).agg(last.alias("q"), F.count(F.lit(1)).alias("n"))
    mid = (F.col("q.bid") + F.col("q.ask")) / 2
    return df.select(
        "root", F.col("w.start").cast("timestamp_ntz").alias("start"), mid.alias("mid"), (div(F.col("q.ask") - F.col("q.bid"), mid) * 1e4).alias("spread_bps"),
        div(F.col("q.bid_size") - F.col("q.ask_size"), F.col("q.bid_size") + F.col("q.ask_size")).alias("imbalance"), "n",
    )


def value_boundaries(trades: DataFrame, threshold: float, order: list[str], value: str = "notional", keys: list[str] | None = None) -> DataFrame:
    """(keys, bar_id, first_*, last_* of the order columns, amount, n, complete): a bar closes with the trade that brings its value to the threshold.

    What a bar needs is the sum since the last close, so the fold is sequential;
    only order and value columns go through it, one task a key, in the order of the
    shuffle's sort and batch by batch. With keys, series are folded side by side.
    """
    keys = keys or []
    names = [*keys, "bar_id", *[f"first_{c}" for c in order], *[f"last_{c}" for c in order], "amount", "n", "complete"]
    types = {f.name: f.dataType for f in trades.schema}
    schema = ", ".join([f"`{k}` {types[k].simpleString()}" for k in keys] + ["bar_id bigint"] + [f"`{p}_{c}` {types[c].simpleString()}" for p in ("first", "last") for c in order] + ["amount double", "n bigint", "complete boolean"])
    narrow = trades.select(*keys, *order, F.col(value).cast("double").alias("__value"))
    dealt = narrow.repartition(*keys) if keys else narrow.repartition(1)
    dealt = dealt.sortWithinPartitions(*keys, *order)

    def run(batches):
        state: dict = {"key": None, "bar": 0, "sum": 0.0, "n": 0, "first": None, "last": None}
        out: list[tuple] = []

        def close(complete):
            out.append((*(state["key"] or ()), state["bar"], *state["first"], *state["last"], state["sum"], state["n"], complete))
            state.update(bar=state["bar"] + 1, sum=0.0, n=0, first=None)

        for batch in batches:
            value_ = batch.column(len(keys) + len(order)).to_numpy(zero_copy_only=False)
            cols = [batch.column(i).to_pylist() for i in range(len(keys) + len(order))]
            key_rows = list(zip(*cols[: len(keys)], strict=True)) if keys else [()] * batch.num_rows
            order_rows = list(zip(*cols[len(keys) :], strict=True))
            for key, at, v in zip(key_rows, order_rows, value_.tolist(), strict=True):
                if key != state["key"]:
                    if state["n"]:
                        close(False)
                    state.update(key=key, bar=0)
                if state["first"] is None:
                    state["first"] = at
                state["last"] = at
                state["sum"] += v
                state["n"] += 1
                if state["sum"] >= threshold:
                    close(True)
        if state["n"]:
            close(False)
        if out:
            yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*out, strict=True)), strict=True)))

    return dealt.mapInArrow(run, schema)


def assign_bars(trades: DataFrame, boundaries: DataFrame, order: list[str], keys: list[str] | None = None, parts: int = 64) -> DataFrame:
    """trades with the bar_id of the bar that holds each: the first boundary at or after it.

    Quantiles of the bars' ends cut the order into ranges, which are looked through
    side by side, each from its end backwards; trades after a range's last boundary
    belong to the first bar that ends in a later range. Only trades of one value of
    the first order column must stay together.
    """
    keys = keys or []
    at = F.struct(*[F.col(f"last_{c}").alias(c) for c in order])
    ends = boundaries.select(*keys, at.alias("__at"), F.col("bar_id").alias("__bar"), F.lit(1).alias("__end"))
    place = ranges(boundaries, f"last_{order[0]}", parts)
    t = trades.withColumns({"__at": F.struct(*order), "__bar": F.lit(None).cast("long"), "__end": F.lit(0)})
    both = t.unionByName(ends, allowMissingColumns=True).withColumn("__range", place(F.col("__at")[order[0]]))
    w = Window.partitionBy(*keys, "__range").orderBy(F.desc("__at"), F.desc("__end")).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("bar_id", F.last("__bar", ignorenulls=True).over(w)).where("__end = 0")
    # A range with a boundary has one row here, parts + 1 at most a key.
    firsts = ends.groupBy(*keys, place(F.col("__at")[order[0]]).alias("__from")).agg(F.min("__bar").alias("__first"))
    before = F.coalesce(F.lag("__from").over(Window.partitionBy(*keys).orderBy("__from")), F.lit(0))
    spans = firsts.withColumn("__since", before).withColumn("__range", F.explode(F.sequence("__since", "__from"))).where("__range < __from")
    spans = spans.select(*keys, "__range", F.col("__first").alias("__next"))
    return found.join(spans, [*keys, "__range"], "left").withColumn("bar_id", F.coalesce("bar_id", "__next")).drop("__at", "__bar", "__end", "__range", "__next")


def ranges(df: DataFrame, column: str, parts: int):
    """A function from a column to its range, 0 to parts - 1, by quantiles of a number, date or time column of df."""
    timed = df.schema[column].dataType.typeName() in ("timestamp", "timestamp_ntz", "date")
    number = lambda c: F.unix_micros(c.cast("timestamp")).cast("double") if timed else c.cast("double")
    cuts = df.agg(F.array_distinct(F.percentile_approx(number(F.col(column)), F.array(*[F.lit(i / parts) for i in range(1, parts)]), 20 * parts)).alias("cuts")).first()["cuts"] or []
    bounds = sorted(float(c) for c in cuts if c == c)

    # Halving over literals: few comparisons a row, and retried tasks deal rows alike.
    def search(c: Column, low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(c > bounds[mid], search(c, mid + 1, high)).otherwise(search(c, low, mid))

    return lambda c: search(number(c), 0, len(bounds))


def bar_details(assigned: DataFrame, roots: list[str], order: list[str], buckets: list[str], sums: list[str] | None = None) -> DataFrame:
    """(bar_id, root, last_price, the share of each bucket in the root's notional, and the sums of columns) for each bar and listed root.

    A root that didn't trade in a bar keeps its last price of the bars before, NULL
    before its first trade, and has no shares or sums.
    """
    own = F.col("notional")
    each = assigned.groupBy("bar_id", "root").agg(
        F.max_by("price", F.struct(*order)).alias("last_price"), *[div(F.coalesce(F.sum(F.when(F.col("bucket") == b, own)), F.lit(0.0)), F.sum(own)).alias(b) for b in buckets], *[F.sum(c).alias(c) for c in sums or []],
    )
    names = ["last_price", *buckets, *(sums or [])]
    known = F.when(F.col("root").isNotNull(), F.struct("root", F.struct(*names)))
    whole = each.groupBy("bar_id").agg(F.map_from_entries(F.collect_list(known)).alias("__by"))
    grid = whole.withColumn("root", F.explode(F.array(*[F.lit(r) for r in roots]))).withColumn("__v", F.try_element_at("__by", F.col("root")))
    grid = grid.select("bar_id", "root", *[F.col(f"__v.{c}").alias(c) for c in names])
    past = series("root", order="bar_id").rowsBetween(Window.unboundedPreceding, 0)
    return grid.withColumn("last_price", F.last("last_price", ignorenulls=True).over(past))


def bar_records(assigned: DataFrame, roots: list[str]) -> DataFrame:
    """One row for each bar: totals, each root's notional, the dominant root (ties: first in the list), its share, and the concentration of shares."""
    df = assigned.groupBy("bar_id").agg(
        F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), F.sum("notional").alias("bar_notional"), F.sum("signed").alias("bar_signed"), F.count(F.lit(1)).alias("trades"),
        *[F.coalesce(F.sum(F.when(F.col("root") == r, F.col("notional"))), F.lit(0.0)).alias(f"{r}_notional") for r in roots],
    )
    share = [div(F.col(f"{r}_notional"), F.col("bar_notional")) for r in roots]
    best = F.greatest(*share)
    dominant = F.coalesce(*[F.when(s == best, F.lit(r)) for r, s in zip(roots, share, strict=True)])
    hhi = sum((s * s for s in share[1:]), share[0] * share[0])
    seconds = (F.unix_micros(F.col("end_ts").cast("timestamp")) - F.unix_micros(F.col("start_ts").cast("timestamp"))) / 1e6
    return df.withColumn("dominant_root", dominant).withColumn("dominant_share", best).withColumn("hhi", hhi).withColumn("signed_ratio", div(F.col("bar_signed"), F.col("bar_notional"))).withColumn("seconds", seconds)


def variance_bars(bars: DataFrame, threshold: float, key: str = "root", day: str = "day", order: str = "hour", ret: str = "ret") -> DataFrame:
    """Per series and day, bars that close when the squared returns add up to the threshold; a day's last bar may be partial. Days fold side by side."""
    kinds = {f.name: f.dataType.simpleString() for f in bars.schema}

    def fold(keys, pdf):
        import pandas as pd

        pdf = pdf.sort_values(order)
        bar, total, ids = 0, 0.0, []
        for r in pdf[ret]:
            ids.append(bar)
            total += r * r
            if total >= threshold:
                bar, total = bar + 1, 0.0
        g = pdf.assign(bar=ids).groupby("bar")
        return pd.DataFrame({key: keys[0], day: keys[1], "bar": g.size().index, "start": g[order].min().values, "end": g[order].max().values, "n": g.size().values, "ret": g[ret].sum().values, "variance": g[ret].apply(lambda x: float(np.square(x).sum())).values})

    return bars.groupBy(key, day).applyInPandas(fold, f"{key} {kinds[key]}, {day} {kinds[day]}, bar long, start {kinds[order]}, end {kinds[order]}, n long, ret double, variance double")


def variance_threshold(bars: DataFrame, train: Column, per_day: float, keys: tuple[str, ...] = ("root",), day: str = "day", ret: str = "ret") -> DataFrame:
    """(keys, threshold): the squared returns of a training day on average, over the number of bars a day is to have."""
    daily = bars.where(train).groupBy(*keys, day).agg(F.sum(F.col(ret) * F.col(ret)).alias("__v"))
    return daily.groupBy(*keys).agg((F.avg("__v") / per_day).alias("threshold"))


def contract_schedule(volumes: DataFrame) -> DataFrame:
    """(root, session, active, is_roll) from (root, session, symbol, volume, expiry_rank).

    While the active contract trades, only later-expiring ones of a larger volume
    may take over; when it doesn't, any may. Of those the largest volume wins, ties
    the first symbol; without any the contract stays. A fold over the sessions of
    each root: days, not ticks.
    """
    traded = F.collect_list(F.when(F.col("volume") > 0, F.struct((-F.col("volume")).alias("less"), "symbol", "expiry_rank")))
    days = volumes.groupBy("root", "session").agg(F.sort_array(traded).alias("traded"))
    kind = volumes.schema["session"].dataType.simpleString()

    def fold(keys, pdf):
        import pandas as pd

        out, active = [], None
        for session, traded in zip(*(pdf.sort_values("session")[c] for c in ("session", "traded")), strict=True):
            own = [t for t in traded if t["symbol"] == active]
            takers = [t for t in traded if not own or (t["expiry_rank"] > own[0]["expiry_rank"] and t["less"] < own[0]["less"])]
            last, active = active, takers[0]["symbol"] if takers else active
            out.append((keys[0], session, active, last is not None and active != last))
        return pd.DataFrame(out, columns=["root", "session", "active", "is_roll"])

    return days.groupBy("root").applyInPandas(fold, f"root string, session {kind}, active string, is_roll boolean")


def continuous(bars: DataFrame, schedule: DataFrame) -> DataFrame:
    """The active contracts' bars spliced by their own returns: cont_logret, cont_logprice and cont_close, which starts at the first close."""
    own = series("root", "symbol", order="ts")
    df = bars.withColumn("r", F.coalesce(ln("close") - F.lag(ln("close")).over(own), F.lit(0.0)))
    df = df.join(schedule, ["root", "session"]).where(F.col("symbol") == F.col("active"))
    w = series("root", order="ts")
    df = df.withColumn("rolled", F.coalesce(F.col("active") != F.lag("active").over(w), F.lit(False)))
    df = df.withColumn("cont_logprice", F.sum("r").over(w.rowsBetween(Window.unboundedPreceding, 0)) + F.first(ln("close") - F.col("r")).over(w))
    return df.select("root", "ts", "active", F.col("r").alias("cont_logret"), "cont_logprice", F.exp("cont_logprice").alias("cont_close"), "rolled")


def carry(bars: DataFrame, schedule: DataFrame) -> DataFrame:
    """(root, session, front, second, carry) from daily bars (root, session, symbol, close) and a schedule (root, session, active).

    carry is the log of the active contract's close over that of the next one to
    expire among those of the session. Contracts expire in the order of their last
    sessions, ties by symbol. Sessions without either close, or with one that isn't
    positive, are left out; of repeated bars the least close counts.
    """
    daily = bars.groupBy("root", "session", "symbol").agg(F.min("close").alias("close"))
    ends = daily.groupBy("root", "symbol").agg(F.max("session").alias("last"))
    ranks = ends.select("root", "symbol", F.row_number().over(Window.partitionBy("root").orderBy("last", "symbol")).alias("rank"))
    active = schedule.select("root", "session", F.col("active").alias("symbol")).join(ranks, ["root", "symbol"]).select("root", "session", F.col("rank").alias("active_rank"))
    both = daily.join(ranks, ["root", "symbol"]).join(active, ["root", "session"])
    later = F.when(F.col("rank") > F.col("active_rank"), F.col("rank"))
    pair = both.groupBy("root", "session").agg(F.max(F.when(F.col("rank") == F.col("active_rank"), F.col("close"))).alias("front"), F.min_by("close", later).alias("second"))
    return pair.where("front > 0 AND second > 0").withColumn("carry", F.log(F.col("front") / F.col("second")))


def outright(symbol: str, root: str) -> Column:
    """Whether a symbol is a single contract of the root: month code and one or two digits."""
    return F.col(symbol).rlike(rf"^\Q{root}\E[FGHJKMNQUVXZ]\d{{1,2}}$")


def in_session(ts: str, start_minute: int, end_minute: int) -> Column:
    """Minute of the day in (start, end]."""
    minute = F.hour(ts) * 60 + F.minute(ts)
    return (minute > start_minute) & (minute <= end_minute)
