
from __future__ import annotations

import datetime as dt

from pyspark.sql import Window
from pyspark.sql import functions as F

from fluxbar import sources as s
from fluxbar.catalog import query
from fluxbar.functions import div, safe_corr, series
from fluxbar.operators import anomaly, backtest, bars, flow, joins, pairs, residuals, stats, windows


def roots_of(spark, sf_dir) -> list[str]:
    return sorted(r[0] for r in s.table(spark, sf_dir, "events").select("event_type").distinct().collect())


def r6(*columns: str):
    return [F.round(c, 6).alias(c) for c in columns]


def _sql(base: str, body: str) -> str:
    return f"WITH {base}\n{body}"


BT = s.DAILY_SQL + """,
ma AS (SELECT *, CASE WHEN count(close) OVER f = 10 THEN avg(close) OVER f END AS fast_ma, CASE WHEN count(close) OVER g = 40 THEN avg(close) OVER g END AS slow_ma,
         coalesce(close / lag(close) OVER o - 1, 0) AS ret FROM daily
       WINDOW o AS (PARTITION BY symbol ORDER BY ts), f AS (PARTITION BY symbol ORDER BY ts ROWS 9 PRECEDING), g AS (PARTITION BY symbol ORDER BY ts ROWS 39 PRECEDING)),
sig AS (SELECT *, CASE WHEN fast_ma > slow_ma THEN 1.0 ELSE 0.0 END::DOUBLE AS signal FROM ma),
pos AS (SELECT *, coalesce(lag(signal) OVER (PARTITION BY symbol ORDER BY ts), 0.0) AS position FROM sig),
turn AS (SELECT *, abs(position - coalesce(lag(position) OVER (PARTITION BY symbol ORDER BY ts), 0.0)) AS turnover FROM pos),
net AS (SELECT *, turnover * 1.5 / 10000.0 AS cost, position * ret - turnover * 1.5 / 10000.0 AS net FROM turn),
eq AS (SELECT *, product(1 + net) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) AS equity FROM net),
ran AS (SELECT *, equity / max(equity) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) - 1 AS drawdown FROM eq)"""


def _ran(spark, sf_dir):
    return backtest.run(backtest.crossover(s.daily_bars(spark, sf_dir), 10, 40), 1.5)


@query("o004_daily_bars", _sql(s.DAILY_SQL, "SELECT symbol, ts, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, volume FROM daily"))
def o004(spark, sf_dir):
    return s.daily_bars(spark, sf_dir).select("symbol", "ts", *r6("open", "high", "low", "close"), "volume")


@query("o090_simple_return", _sql(BT, "SELECT symbol, ts, round(ret, 6) AS ret FROM ma"))
def o090(spark, sf_dir):
    return s.daily_bars(spark, sf_dir).withColumn("ret", windows.simple_return("close", series("symbol", order="ts"))).select("symbol", "ts", *r6("ret"))


@query("o092_crossover_signal", _sql(BT, "SELECT symbol, ts, round(fast_ma / close - 1, 6) AS fast_gap, round(slow_ma / close - 1, 6) AS slow_gap, signal FROM sig"))
def o092(spark, sf_dir):
    df = backtest.crossover(s.daily_bars(spark, sf_dir), 10, 40)
    gaps = [F.round(F.col(f"{k}_ma") / F.col("close") - 1, 6).alias(f"{k}_gap") for k in ("fast", "slow")]
    return df.select("symbol", "ts", *gaps, "signal")


@query("o095_backtest_equity", _sql(BT, "SELECT symbol, ts, position, turnover, round(net, 8) AS net, round(equity, 6) AS equity, round(drawdown, 6) AS drawdown FROM ran"))
def o095(spark, sf_dir):
    return _ran(spark, sf_dir).select("symbol", "ts", "position", "turnover", F.round("net", 8).alias("net"), *r6("equity", "drawdown"))


@query("o061_backtest_metrics", _sql(BT, """SELECT symbol, count(*) AS n, round(arg_max(equity, ts) - 1, 6) AS total_return, round(pow(1 + avg(net), 12) - 1, 6) AS annual_return,
  round(stddev_samp(net) * sqrt(12), 6) AS volatility, round(avg(net) / nullif(stddev_samp(net), 0) * sqrt(12), 6) AS sharpe, round(min(drawdown), 6) AS max_drawdown,
  round(avg(position), 6) AS mean_position, round(sum(turnover), 6) AS turnover, count(*) FILTER (turnover > 0) AS trades FROM ran GROUP BY symbol"""))
def o061(spark, sf_dir):
    m = backtest.metrics(_ran(spark, sf_dir), 12)
    return m.select("symbol", "n", *r6("total_return", "annual_return", "volatility", "sharpe", "max_drawdown", "mean_position", "turnover"), "trades")


@query("o020_duplicate_keys", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def o020(spark, sf_dir):
    return s.table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query("o021_range_filter", _sql(s.TRADES_SQL, "SELECT root, ts, seq, price FROM trades WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-12'"))
def o021(spark, sf_dir):
    return s.between(s.trades(spark, sf_dir), "ts", dt.datetime(2024, 1, 5), dt.datetime(2024, 1, 12), closed=False).select("root", "ts", "seq", "price")


@query("o022_outright_symbols", "SELECT user_id, 'ZZ' || substr('FGHJKMNQUVXZ', CAST(user_id % 12 AS INT) + 1, 1) || CAST(user_id % 120 AS VARCHAR) AS symbol FROM events WHERE regexp_matches('ZZ' || substr('FGHJKMNQUVXZ', CAST(user_id % 12 AS INT) + 1, 1) || CAST(user_id % 120 AS VARCHAR), '^ZZ[FGHJKMNQUVXZ][0-9]{1,2}$')")
def o022(spark, sf_dir):
    code = F.concat(F.lit("ZZ"), F.expr("substr('FGHJKMNQUVXZ', int(user_id % 12) + 1, 1)"), (F.col("user_id") % 120).cast("string"))
    return s.table(spark, sf_dir, "events").select("user_id", code.alias("symbol")).where(bars.outright("symbol", "ZZ"))


@query("o023_session_filter", "SELECT event_id, ts FROM events WHERE hour(ts) * 60 + minute(ts) > 810 AND hour(ts) * 60 + minute(ts) <= 1200")
def o023(spark, sf_dir):
    return s.table(spark, sf_dir, "events").where(bars.in_session("ts", 810, 1200)).select("event_id", "ts")


@query("o027_dedup_keep_last", "SELECT o_custkey, o_orderkey, round(o_totalprice, 2) AS o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def o027(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
    return s.table(spark, sf_dir, "orders").withColumn("i", F.row_number().over(w)).where("i = 1").select("o_custkey", "o_orderkey", F.round("o_totalprice", 2).alias("o_totalprice"))


@query("o024_semi_join_days", "SELECT event_id FROM events WHERE CAST(ts AS DATE) IN (SELECT CAST(ts AS DATE) FROM events WHERE event_type = 'signup')")
def o024(spark, sf_dir):
    e = s.table(spark, sf_dir, "events").withColumn("d", F.to_date("ts"))
    return e.join(e.where("event_type = 'signup'").select("d").distinct(), "d", "left_semi").select("event_id")


@query("o046_asof_backward", _sql(s.QUOTES_SQL, """SELECT t.seq, q.bid AS bid, q.ask AS ask FROM trades t
  ASOF LEFT JOIN (SELECT root, ts + INTERVAL 1 SECOND AS ts, bid, ask FROM quotes QUALIFY row_number() OVER (PARTITION BY root, ts ORDER BY seq DESC) = 1) q ON t.root = q.root AND t.ts >= q.ts"""))
def o046(spark, sf_dir):
    t = s.trades(spark, sf_dir).select("root", "ts", "seq")
    late = s.quotes(spark, sf_dir).withColumn("ts", F.expr("ts + interval 1 second"))
    return joins.asof(t, late, "ts", ["root"], ["bid", "ask"], "seq").select("seq", "bid", "ask")


@query("o048_asof_forward", _sql(s.TRADES_SQL, """SELECT t.seq, b.seq AS next_seq FROM trades t
  ASOF LEFT JOIN (SELECT root, ts, seq FROM trades QUALIFY row_number() OVER (PARTITION BY root, date_trunc('hour', ts) ORDER BY ts DESC, seq DESC) = 1) b ON t.root = b.root AND t.ts <= b.ts"""))
def o048(spark, sf_dir):
    t = s.trades(spark, sf_dir).select("root", "ts", "seq")
    last = F.max(F.struct("ts", "seq"))
    ends = t.groupBy("root", F.date_trunc("hour", "ts").alias("hour")).agg(last.alias("end")).select("root", "end.ts", F.col("end.seq").alias("next_seq"))
    return joins.asof(t, ends, "ts", ["root"], ["next_seq"], forward=True, parts=64).select("seq", "next_seq")


@query("o050_event_paths", _sql(s.HOURLY_SQL, """, p AS (SELECT *, ln(close) AS lp, row_number() OVER (PARTITION BY root ORDER BY hour) AS pos, ntile(1) OVER () AS one FROM hourly),
  e AS (SELECT root, pos, lp FROM p WHERE volume >= 12)
  SELECT CAST(v.pos - e.pos AS INT) AS rel, count(*) AS n, round(avg(v.lp - e.lp), 6) AS mean_path FROM e JOIN p v ON v.root = e.root AND v.pos BETWEEN e.pos - 3 AND e.pos + 5 GROUP BY 1""".lstrip(", ")).replace("FROM trades GROUP BY 1, 2)\np AS", "FROM trades GROUP BY 1, 2),\np AS"))
def o050(spark, sf_dir):
    p = s.hourly(spark, sf_dir).withColumn("lp", F.log("close")).withColumn("pos", F.row_number().over(series("root", order="hour")))
    e = p.where("volume >= 12").select("root", "pos", F.col("lp").alias("lp0"))
    b = joins.band(e, p, ["root"], "pos", 3, 5, ["lp"])
    return b.groupBy("rel").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("lp") - F.col("lp0")), 6).alias("mean_path"))


@query("o069_latest_row", _sql(s.TRADES_SQL, "SELECT root, arg_max(price, (ts, seq)) AS price, max(ts) AS ts FROM trades GROUP BY root"))
def o069(spark, sf_dir):
    return s.trades(spark, sf_dir).groupBy("root").agg(F.max_by("price", F.struct("ts", "seq")).alias("price"), F.max("ts").alias("ts"))


@query("o073_trade_inventory", _sql(s.TRADES_SQL, """SELECT root, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts, round(sum(notional), 4) AS notional, round(sum(signed) / nullif(sum(notional), 0), 6) AS signed_ratio,
  round(median(size), 6) AS median_size, round(quantile_cont(notional, 0.99), 6) AS q99 FROM trades GROUP BY root"""))
def o073(spark, sf_dir):
    return s.trades(spark, sf_dir).groupBy("root").agg(
        F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.round(F.sum("notional"), 4).alias("notional"),
        F.round(div(F.sum("signed"), F.sum("notional")), 6).alias("signed_ratio"), F.round(F.median("size"), 6).alias("median_size"), F.round(F.percentile("notional", 0.99), 6).alias("q99"),
    )


@query("o075_quote_costs", _sql(s.QUOTES_SQL, """SELECT root, count(*) AS n, round(greatest(median((ask - bid) / ((ask + bid) / 2) * 10000) / 2, 0.1), 6) AS half_bps,
  round(quantile_cont((ask - bid) / ((ask + bid) / 2) * 10000, 0.75), 6) AS q75, round(median(bid_size + ask_size), 6) AS depth FROM quotes WHERE bid > 0 AND ask >= bid GROUP BY root"""))
def o075(spark, sf_dir):
    q = s.quotes(spark, sf_dir).where("bid > 0 and ask >= bid").withColumn("bps", (F.col("ask") - F.col("bid")) / ((F.col("ask") + F.col("bid")) / 2) * 10000)
    return q.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.round(F.greatest(F.median("bps") / 2, F.lit(0.1)), 6).alias("half_bps"), F.round(F.percentile("bps", 0.75), 6).alias("q75"), F.round(F.median(F.col("bid_size") + F.col("ask_size")), 6).alias("depth"))


@query("o078_value_counts", "SELECT event_type, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM events GROUP BY 1")
def o078(spark, sf_dir):
    return s.table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))


@query("o081_gap_statistics", _sql(s.TRADES_SQL, """, g AS (SELECT root, price, size, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY root ORDER BY ts)) AS gap FROM trades)
  SELECT root, round(sum(price * size) / sum(size), 6) AS vwap, max(gap) AS longest_gap, count(*) FILTER (gap > 3600000000) AS gaps_over_hour FROM g GROUP BY root""".lstrip(", ")).replace("FROM raw)\ng AS", "FROM raw),\ng AS"))
def o081(spark, sf_dir):
    w = series("root", order="ts")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    g = s.trades(spark, sf_dir).withColumn("us", us).withColumn("gap", F.col("us") - F.lag("us").over(w))
    return g.groupBy("root").agg(F.round(div(F.sum(F.col("price") * F.col("size")), F.sum("size")), 6).alias("vwap"), F.max("gap").alias("longest_gap"), F.count_if(F.col("gap") > 3600000000).alias("gaps_over_hour"))


@query("o082_daily_coverage", """WITH d AS (SELECT unnest(generate_series(DATE '2024-01-01', DATE '2024-02-04', INTERVAL 1 DAY))::DATE AS day)
SELECT d.day, dayname(d.day)[1:3] AS weekday, count(e.event_id) AS n FROM d LEFT JOIN events e ON CAST(e.ts AS DATE) = d.day GROUP BY 1, 2""")
def o082(spark, sf_dir):
    days = spark.sql("SELECT explode(sequence(DATE'2024-01-01', DATE'2024-02-04')) AS day")
    n = s.table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    return days.join(n, days["day"] == n["d"], "left").select("day", F.date_format("day", "EEE").alias("weekday"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


@query("o085_pivot_sum", _sql(s.TRADES_SQL, "SELECT root, round(sum(notional) FILTER (side = 'A'), 4) AS a, round(sum(notional) FILTER (side = 'B'), 4) AS b, round(sum(notional) FILTER (side = 'N'), 4) AS n FROM trades GROUP BY root"))
def o085(spark, sf_dir):
    p = s.trades(spark, sf_dir).groupBy("root").pivot("side", ["A", "B", "N"]).sum("notional")
    return p.select("root", *[F.round(c, 4).alias(c.lower()) for c in ("A", "B", "N")])


@query("o099_rolling_z", _sql(s.HOURLY_SQL, "SELECT root, hour, round(CASE WHEN count(close) OVER w >= 10 THEN (close - avg(close) OVER w) / nullif(stddev_samp(close) OVER w, 0) END, 6) AS z FROM hourly WINDOW w AS (PARTITION BY root ORDER BY hour ROWS 19 PRECEDING)"))
def o099(spark, sf_dir):
    return s.hourly(spark, sf_dir).withColumn("z", windows.rolling_z("close", series("root", order="hour"), 20, 10)).select("root", "hour", *r6("z"))


@query("o102_forward_sum", _sql(s.HOURLY_SQL, "SELECT root, hour, round(CASE WHEN count(signed) OVER w = 4 THEN sum(signed) OVER w END, 4) AS ahead FROM hourly WINDOW w AS (PARTITION BY root ORDER BY hour ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING)"))
def o102(spark, sf_dir):
    return s.hourly(spark, sf_dir).withColumn("ahead", windows.forward_sum("signed", series("root", order="hour"), 4)).select("root", "hour", F.round("ahead", 4).alias("ahead"))


@query("o105_forward_fill", _sql(s.HOURLY_SQL, "SELECT root, hour, last_value(CASE WHEN n > 3 THEN close END IGNORE NULLS) OVER (PARTITION BY root ORDER BY hour ROWS UNBOUNDED PRECEDING) AS filled FROM hourly"))
def o105(spark, sf_dir):
    w = series("root", order="hour").rowsBetween(Window.unboundedPreceding, 0)
    return s.hourly(spark, sf_dir).select("root", "hour", F.last(F.when(F.col("n") > 3, F.col("close")), ignorenulls=True).over(w).alias("filled"))


@query("o106_deciles", _sql(s.HOURLY_SQL, "SELECT root, hour, CAST(greatest(ceil((row_number() OVER (PARTITION BY root ORDER BY close, hour) - 1) * 10.0::DOUBLE / (count(*) OVER (PARTITION BY root) - 1)), 1) AS INT) AS decile FROM hourly"))
def o106(spark, sf_dir):
    whole = Window.partitionBy("root")
    return s.hourly(spark, sf_dir).select("root", "hour", windows.deciles("close", whole.orderBy("close", "hour"), whole).alias("decile"))


@query("o110_episodes", _sql(s.HOURLY_SQL + """,
f AS (SELECT root, hour, close > 105 AS hot, coalesce(lag(close > 105) OVER (PARTITION BY root ORDER BY hour), false) AS was FROM hourly),
g AS (SELECT *, sum(CASE WHEN hot AND NOT was THEN 1 ELSE 0 END) OVER (PARTITION BY root ORDER BY hour ROWS UNBOUNDED PRECEDING) AS run FROM f)""", "SELECT root, min(hour) AS start, max(hour) AS \"end\", count(*) AS n FROM g WHERE hot GROUP BY root, run"))
def o110(spark, sf_dir):
    return windows.episodes(s.hourly(spark, sf_dir).withColumn("hot", F.col("close") > 105), "hot", ["root"], "hour").select("root", "start", "end", "n")


@query("o112_chronological_split", _sql(s.HOURLY_SQL + """,
k AS (SELECT hour, row_number() OVER (ORDER BY hour) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT hour FROM hourly)),
c AS (SELECT hour AS h FROM k WHERE r = least(greatest(floor(n * 0.6), 1), n - 1))""", "SELECT root, hour, hour <= (SELECT h FROM c) AS train FROM hourly"))
def o112(spark, sf_dir):
    return windows.chronological_split(s.hourly(spark, sf_dir), "hour", 0.6).select("root", "hour", "train")


IC = s.HOURLY_SQL + """,
f AS (SELECT root, hour, signed AS x, CASE WHEN count(*) OVER w = 3 THEN sum(ln(close)) OVER w END AS y FROM hourly WINDOW w AS (PARTITION BY root ORDER BY hour ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING)),
b AS (SELECT * FROM f WHERE y IS NOT NULL),
rk AS (SELECT root, rank() OVER (PARTITION BY root ORDER BY x) + (count(*) OVER (PARTITION BY root, x) - 1) / 2.0::DOUBLE AS rx, rank() OVER (PARTITION BY root ORDER BY y) + (count(*) OVER (PARTITION BY root, y) - 1) / 2.0::DOUBLE AS ry FROM b)"""


def _forward(spark, sf_dir):
    w = series("root", order="hour")
    return s.hourly(spark, sf_dir).withColumn("lc", F.log("close")).select("root", "hour", F.col("signed").alias("x"), windows.forward_sum("lc", w, 3).alias("y"))


@query("o113_information_coefficient", _sql(IC, "SELECT root, count(*) AS n, round(covar_samp(rx, ry) / nullif(stddev_samp(rx) * stddev_samp(ry), 0), 6) AS ic FROM rk GROUP BY root"))
def o113(spark, sf_dir):
    return stats.information_coefficient(_forward(spark, sf_dir), ["root"], "x", "y").select("root", "n", *r6("ic"))


@query("o184_benjamini_hochberg")
def o184(spark, sf_dir):
    return stats.benjamini_hochberg(stats.information_coefficient(_forward(spark, sf_dir), ["root"], "x", "y"), "p")


@query("o123_top_by_value", """WITH p AS (SELECT o_custkey, arg_max(o_totalprice, struct_pack(d := o_orderdate, k := o_orderkey)) AS price FROM orders GROUP BY 1),
m AS (SELECT c_custkey, c_name, price * c_acctbal AS cap FROM customer JOIN p ON o_custkey = c_custkey WHERE c_acctbal > 0)
SELECT c_name, round(cap, 2) AS cap, CAST(row_number() OVER (ORDER BY cap DESC, c_custkey) AS INT) AS rank FROM m QUALIFY row_number() OVER (ORDER BY cap DESC, c_custkey) <= 100""")
def o123(spark, sf_dir):
    price = s.table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max_by("o_totalprice", F.struct("o_orderdate", "o_orderkey")).alias("price"))
    c = s.table(spark, sf_dir, "customer").where("c_acctbal > 0")
    m = c.join(price, c["c_custkey"] == price["o_custkey"]).select("c_custkey", "c_name", (F.col("price") * F.col("c_acctbal")).alias("cap"))
    top = m.orderBy(F.desc("cap"), "c_custkey").limit(100)
    return top.select("c_name", F.round("cap", 2).alias("cap"), F.row_number().over(Window.orderBy(F.desc("cap"), "c_custkey")).alias("rank"))


@query("o130_union_distinct", "SELECT root FROM (SELECT event_type AS root FROM events UNION ALL SELECT o_orderpriority FROM orders) GROUP BY 1")
def o130(spark, sf_dir):
    return s.table(spark, sf_dir, "events").select(F.col("event_type").alias("root")).union(s.table(spark, sf_dir, "orders").select("o_orderpriority")).distinct()


@query("o132_key_difference", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)")
def o132(spark, sf_dir):
    c, o = s.table(spark, sf_dir, "customer"), s.table(spark, sf_dir, "orders")
    return c.join(o, c["c_custkey"] == o["o_custkey"], "left_anti").select("c_custkey")


DOLLAR = s.TRADES_SQL + """,
seqd AS (SELECT *, row_number() OVER (ORDER BY ts, seq) AS i FROM trades),
fold(i, bar, total, closed) AS (
  SELECT i, 0::BIGINT, notional, notional >= 30000 FROM seqd WHERE i = 1
  UNION ALL
  SELECT q.i, CASE WHEN f.closed THEN f.bar + 1 ELSE f.bar END, CASE WHEN f.closed THEN q.notional ELSE f.total + q.notional END,
         CASE WHEN f.closed THEN q.notional ELSE f.total + q.notional END >= 30000 FROM fold f JOIN seqd q ON q.i = f.i + 1)"""


@query("o150_value_bars", f"WITH RECURSIVE {DOLLAR} SELECT bar AS bar_id, min(ts) AS first_ts, max(ts) AS last_ts, round(sum(notional), 4) AS amount, count(*) AS n, bool_or(closed) AS complete FROM fold JOIN seqd USING (i) GROUP BY bar")
def o150(spark, sf_dir):
    b = bars.value_boundaries(s.trades(spark, sf_dir), 30000, ["ts", "seq"])
    return b.select("bar_id", "first_ts", "last_ts", F.round("amount", 4).alias("amount"), "n", "complete")


@query("o153_bar_records", f"""WITH RECURSIVE {DOLLAR},
b AS (SELECT f.bar AS bar_id, q.* FROM fold f JOIN seqd q USING (i)),
t AS (SELECT bar_id, root, sum(notional) AS v, sum(signed) AS sg, count(*) AS n FROM b GROUP BY 1, 2)
SELECT bar_id, CAST(sum(n) AS BIGINT) AS trades, round(sum(v), 4) AS bar_notional, first(root ORDER BY v DESC, root) AS dominant_root, round(max(v) / sum(v), 6) AS dominant_share,
  round(sum(v * v) / (sum(v) * sum(v)), 6) AS hhi, round(sum(sg) / sum(v), 6) AS signed_ratio FROM t GROUP BY bar_id""")
def o153(spark, sf_dir):
    t = s.trades(spark, sf_dir)
    assigned = bars.assign_bars(t, bars.value_boundaries(t, 30000, ["ts", "seq"]), ["ts", "seq"])
    rec = bars.bar_records(assigned, roots_of(spark, sf_dir))
    return rec.select("bar_id", "trades", F.round("bar_notional", 4).alias("bar_notional"), "dominant_root", *r6("dominant_share", "hhi", "signed_ratio"))


VARIANCE = f"""{s.HOURLY_SQL},
r AS (SELECT root, CAST(hour AS DATE) AS day, hour, coalesce(ln(close) - lag(ln(close)) OVER (PARTITION BY root ORDER BY hour), 0) AS ret, row_number() OVER (PARTITION BY root, CAST(hour AS DATE) ORDER BY hour) AS i FROM hourly),
fold(root, day, i, bar, total) AS (
  SELECT root, day, i, 0::BIGINT, ret * ret FROM r WHERE i = 1
  UNION ALL
  SELECT r.root, r.day, r.i, CASE WHEN f.total >= 0.002 THEN f.bar + 1 ELSE f.bar END, CASE WHEN f.total >= 0.002 THEN 0 ELSE f.total END + r.ret * r.ret FROM fold f JOIN r ON r.root = f.root AND r.day = f.day AND r.i = f.i + 1)"""


def _variance_bars(spark, sf_dir):
    h = s.hourly(spark, sf_dir).withColumn("ret", windows.log_return("close", series("root", order="hour"))).withColumn("day", F.to_date("hour"))
    return bars.variance_bars(h.select("root", "day", "hour", "ret"), 0.002)


@query("o154_variance_bars", f"""WITH RECURSIVE {VARIANCE}
SELECT f.root, f.day, f.bar, min(r.hour) AS start, count(*) AS n, round(sum(r.ret), 6) AS ret, round(sum(r.ret * r.ret), 6) AS variance FROM fold f JOIN r ON r.root = f.root AND r.day = f.day AND r.i = f.i GROUP BY 1, 2, 3""")
def o154(spark, sf_dir):
    return _variance_bars(spark, sf_dir).select("root", "day", "bar", "start", "n", *r6("ret", "variance"))


@query("o156_time_bars", _sql(s.TRADES_SQL, """SELECT root, time_bucket(INTERVAL 5 MINUTE, ts) + INTERVAL 5 MINUTE AS bar_end, arg_max(price, ts) AS close, sum(size) AS volume, count(*) AS n,
  round(sum(CASE side WHEN 'B' THEN size WHEN 'A' THEN -size ELSE 0 END) FILTER (size >= 4) / nullif(sum(size) FILTER (size >= 4 AND side <> 'N'), 0), 6) AS ofi_large,
  round(sum(CASE side WHEN 'B' THEN size WHEN 'A' THEN -size ELSE 0 END) FILTER (size < 4) / nullif(sum(size) FILTER (size < 4 AND side <> 'N'), 0), 6) AS ofi_small FROM trades GROUP BY 1, 2"""))
def o156(spark, sf_dir):
    return bars.time_bars(s.trades(spark, sf_dir)).select("root", "bar_end", "close", "volume", "n", *r6("ofi_large", "ofi_small"))


@query("o157_book_snapshots", _sql(s.QUOTES_SQL, """SELECT root, date_trunc('hour', ts) AS start, round(arg_max((bid + ask) / 2, ts), 6) AS mid, round(arg_max((ask - bid) / ((bid + ask) / 2) * 10000, ts), 6) AS spread_bps,
  round(arg_max((bid_size - ask_size) / (bid_size + ask_size), ts), 6) AS imbalance, count(*) AS n FROM quotes WHERE bid > 0 AND ask >= bid GROUP BY 1, 2"""))
def o157(spark, sf_dir):
    return bars.book_snapshots(s.quotes(spark, sf_dir)).select("root", "start", *r6("mid", "spread_bps", "imbalance"), "n")


def _contracts(spark, sf_dir):
    t = s.trades(spark, sf_dir).withColumn("symbol", F.concat("root", F.element_at(F.array(F.lit("H6"), F.lit("M6"), F.lit("U6")), (F.col("user_id") % 3 + 1).cast("int"))))
    t = t.withColumn("session", F.to_date(F.from_utc_timestamp(F.col("ts").cast("timestamp"), "America/New_York")))
    v = t.groupBy("root", "session", "symbol").agg(F.sum("size").alias("volume"))
    return t, v.withColumn("expiry_rank", F.when(F.col("symbol").endswith("H6"), 0).when(F.col("symbol").endswith("M6"), 1).otherwise(2))


SCHEDULE = s.TRADES_SQL + """,
c AS (SELECT root, CAST((ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' AS DATE) AS session, root || CASE user_id % 3 WHEN 0 THEN 'H6' WHEN 1 THEN 'M6' ELSE 'U6' END AS symbol, user_id % 3 AS rk, size, ts, seq, price FROM trades),
v AS (SELECT root, session, symbol, any_value(rk) AS rk, sum(size) AS volume FROM c GROUP BY ALL),
d AS (SELECT root, session, list({'less': -volume, 'symbol': symbol, 'rk': rk} ORDER BY -volume, symbol) AS traded, row_number() OVER (PARTITION BY root ORDER BY session) AS i FROM v WHERE volume > 0 GROUP BY root, session),
f(root, i, session, active, was) AS (
  SELECT root, i, session, traded[1].symbol, NULL::VARCHAR FROM d WHERE i = 1
  UNION ALL
  SELECT d.root, d.i, d.session, coalesce(list_filter(d.traded, lambda t: len(list_filter(d.traded, lambda o: o.symbol = f.active)) = 0
      OR (t.rk > list_filter(d.traded, lambda o: o.symbol = f.active)[1].rk AND t.less < list_filter(d.traded, lambda o: o.symbol = f.active)[1].less))[1].symbol, f.active), f.active
  FROM f JOIN d ON d.root = f.root AND d.i = f.i + 1)"""


@query("o159_contract_schedule", f"WITH RECURSIVE {SCHEDULE} SELECT root, session, active, coalesce(active <> was, false) AS is_roll FROM f")
def o159(spark, sf_dir):
    return bars.contract_schedule(_contracts(spark, sf_dir)[1])


@query("o15a_continuous", f"""WITH RECURSIVE {SCHEDULE},
b AS (SELECT root, session, symbol, ts, arg_max(price, seq) AS close FROM c GROUP BY ALL),
r AS (SELECT *, coalesce(ln(close) - lag(ln(close)) OVER (PARTITION BY root, symbol ORDER BY ts), 0) AS r FROM b),
j AS (SELECT r.*, f.active FROM r JOIN f ON f.root = r.root AND f.session = r.session AND f.active = r.symbol),
u AS (SELECT * FROM j QUALIFY row_number() OVER (PARTITION BY root, ts ORDER BY symbol) = 1)
SELECT root, ts, active, round(r, 6) AS cont_logret, round(sum(r) OVER w + first_value(ln(close) - r) OVER w, 6) AS cont_logprice, coalesce(active <> lag(active) OVER (PARTITION BY root ORDER BY ts), false) AS rolled
FROM u WINDOW w AS (PARTITION BY root ORDER BY ts ROWS UNBOUNDED PRECEDING)""")
def o15a(spark, sf_dir):
    t, v = _contracts(spark, sf_dir)
    t = t.groupBy("root", "session", "symbol", "ts").agg(F.max_by("price", "seq").alias("price"))
    done = bars.continuous(t.select("root", "session", "symbol", "ts", F.col("price").alias("close")), bars.contract_schedule(v))
    return done.select("root", "ts", "active", *r6("cont_logret", "cont_logprice"), "rolled")


CONTRACTS = s.TRADES_SQL + """,
c AS (SELECT root, ts::DATE AS session, root || CASE user_id % 3 WHEN 0 THEN 'H6' WHEN 1 THEN 'M6' ELSE 'U6' END AS symbol, price, size, ts, seq FROM trades),
d AS (SELECT root, session, symbol, arg_max(price, (ts, seq)) AS close, sum(size) AS volume FROM c GROUP BY ALL),
k AS (SELECT root, symbol, row_number() OVER (PARTITION BY root ORDER BY max(session), symbol) AS rk FROM d GROUP BY root, symbol),
r AS (SELECT d.*, rk, row_number() OVER (PARTITION BY d.root, session ORDER BY volume DESC, d.symbol) AS nth FROM d JOIN k ON d.root = k.root AND d.symbol = k.symbol),
n AS (SELECT a.root, a.session, a.close AS front, b.close AS second, row_number() OVER (PARTITION BY a.root, a.session ORDER BY b.rk) AS i
      FROM r a JOIN r b ON a.root = b.root AND a.session = b.session AND b.rk > a.rk WHERE a.nth = 1)"""


def _daily_contracts(spark, sf_dir):
    t = _contracts(spark, sf_dir)[0].withColumn("session", F.to_date("ts"))
    d = t.groupBy("root", "session", "symbol").agg(F.max_by("price", F.struct("ts", "seq")).alias("close"), F.sum("size").alias("volume"))
    largest = F.min_by("symbol", F.struct(-F.col("volume"), "symbol"))
    return d, bars.carry(d, d.groupBy("root", "session").agg(largest.alias("active")))


@query("o15b_carry", _sql(CONTRACTS, "SELECT root, session, round(ln(front / second), 6) AS carry FROM n WHERE i = 1 AND front > 0 AND second > 0"))
def o15b(spark, sf_dir):
    return _daily_contracts(spark, sf_dir)[1].select("root", "session", *r6("carry"))


@query("o160_size_buckets", _sql(s.TRADES_SQL + """,
q AS (SELECT root, quantile_cont(notional, [0.5, 0.9, 0.99]) AS q FROM trades GROUP BY root)""", """SELECT t.root, CASE WHEN notional <= q[1] THEN 'small' WHEN notional <= q[2] THEN 'medium' WHEN notional <= q[3] THEN 'large' ELSE 'very_large' END AS bucket,
  count(*) AS n, round(sum(notional), 4) AS notional FROM trades t JOIN q ON q.root = t.root GROUP BY 1, 2"""))
def o160(spark, sf_dir):
    return flow.size_buckets(s.trades(spark, sf_dir)).groupBy("root", "bucket").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("notional"), 4).alias("notional"))


SHARE = s.HOURLY_SQL + ", sh AS (SELECT root, hour, notional / sum(notional) OVER (PARTITION BY hour) AS share FROM hourly)"


@query("o164_concentration", _sql(SHARE + """,
k AS (SELECT count(DISTINCT root)::DOUBLE AS k FROM sh),
rk AS (SELECT *, row_number() OVER (PARTITION BY hour ORDER BY share, root) + k - count(*) OVER (PARTITION BY hour) AS i FROM sh, k)""", """SELECT hour, round(-sum(share * ln(share)), 6) AS entropy, round(-sum(share * ln(share)) / ln(any_value(k)), 6) AS entropy_share, round(sum(share * share), 6) AS hhi,
  round(2 * sum(i * share) / (any_value(k) * sum(share)) - (any_value(k) + 1) / any_value(k), 6) AS gini, round(max(share), 6) AS max_share, first(root ORDER BY share DESC, root) AS dominant_root FROM rk GROUP BY hour"""))
def o164(spark, sf_dir):
    sh = flow.shares(s.hourly(spark, sf_dir), "hour", "notional")
    return flow.concentration(sh, "hour", roots_of(spark, sf_dir)).select("hour", *r6("entropy", "entropy_share", "hhi", "gini", "max_share"), "dominant_root")


@query("o165_share_dynamics", _sql(SHARE + """,
v AS (SELECT *, CAST(rank() OVER (PARTITION BY hour ORDER BY share DESC) AS INT) AS rank, share - lag(share) OVER (PARTITION BY root ORDER BY hour) AS velocity FROM sh)""", """SELECT root, hour, rank, round(velocity, 6) AS velocity,
  round(velocity - lag(velocity) OVER (PARTITION BY root ORDER BY hour), 6) AS acceleration, CAST(rank - lag(rank) OVER (PARTITION BY root ORDER BY hour) AS INT) AS rank_change FROM v"""))
def o165(spark, sf_dir):
    sh = flow.dynamics(flow.shares(s.hourly(spark, sf_dir), "hour", "notional"), "hour")
    return sh.select("root", "hour", "rank", *r6("velocity", "acceleration"), "rank_change")


@query("o178_decile_study", _sql(IC + """,
d AS (SELECT root, y, CAST(greatest(ceil((row_number() OVER (PARTITION BY root ORDER BY x, hour) - 1) * 10.0::DOUBLE / (count(*) OVER (PARTITION BY root) - 1)), 1) AS INT) AS decile FROM b)""", """SELECT root, decile, count(*) AS n, round(avg(y), 6) AS mean, round(median(y), 6) AS median,
  round(avg(y) / (stddev_samp(y) / sqrt(count(*))), 2) AS t FROM d GROUP BY 1, 2"""))
def o178(spark, sf_dir):
    d = stats.decile_study(_forward(spark, sf_dir), "root", "x", "y", "hour")
    return d.select("root", "decile", "n", F.round(F.col("mean_bps") / 1e4, 6).alias("mean"), F.round(F.col("median_bps") / 1e4, 6).alias("median"), F.round("t", 2).alias("t"))


@query("o181_signal_regression", _sql(IC, """SELECT root, count(*) AS n, round(regr_slope(y, x), 8) AS slope, round(covar_samp(x, y) / (stddev_samp(x) * stddev_samp(y)), 6) AS corr, round(avg(CASE WHEN sign(x) = sign(y) THEN 1.0 ELSE 0.0 END), 6) AS sign_agreement FROM b GROUP BY root"""))
def o181(spark, sf_dir):
    return stats.regression(_forward(spark, sf_dir), ["root"], "y", "x").select("root", "n", F.round("slope", 8).alias("slope"), *r6("corr", "sign_agreement"))


@query("o175_half_life", _sql(s.HOURLY_SQL + """,
l AS (SELECT root, close - lag(close) OVER o AS d, lag(close) OVER o AS p FROM hourly WINDOW o AS (PARTITION BY root ORDER BY hour))""", "SELECT root, round(CASE WHEN regr_slope(d, p) < 0 THEN -ln(2) / regr_slope(d, p) ELSE CAST('inf' AS DOUBLE) END, 6) AS half_life FROM l GROUP BY root"))
def o175(spark, sf_dir):
    return stats.half_life(s.hourly(spark, sf_dir), ["root"], "close", "hour").select("root", *r6("half_life"))


PANEL = s.HOURLY_SQL + ", lp AS (SELECT root, hour, ln(close) AS x FROM hourly)"


@query("o187_cross_sectional_z", _sql(PANEL, "SELECT root, hour, round((x - avg(x) OVER w) / nullif(stddev_samp(x) OVER w, 0), 4) AS cross_z FROM lp WINDOW w AS (PARTITION BY hour)"))
def o187(spark, sf_dir):
    p = s.hourly(spark, sf_dir).withColumn("x", F.log("close"))
    return residuals.cross_sectional_z(p, "hour", "x").select("root", "hour", F.round("cross_z", 4).alias("cross_z"))


@query("o188_residual_basket", f"""WITH RECURSIVE {PANEL},
res AS (SELECT root, hour, x - avg(x) OVER (PARTITION BY hour) AS e FROM lp),
z AS (SELECT root, hour, CASE WHEN count(e) OVER w >= 20 THEN (e - avg(e) OVER w) / nullif(stddev_samp(e) OVER w, 0) END AS z, row_number() OVER (PARTITION BY root ORDER BY hour) AS i FROM res WINDOW w AS (PARTITION BY root ORDER BY hour ROWS 19 PRECEDING)),
a AS (SELECT root, i, CASE WHEN z IS NULL THEN 0.0 WHEN abs(z) >= 1.5 THEN -sign(z) ELSE 0.0 END::DOUBLE AS p FROM z WHERE i = 1),
f(root, i, p) AS (SELECT root, i, p FROM a UNION ALL
  SELECT z.root, z.i, CASE WHEN z.z IS NULL THEN 0.0 WHEN (CASE WHEN (f.p > 0 AND z.z >= -0.25) OR (f.p < 0 AND z.z <= 0.25) THEN 0.0 ELSE f.p END) <> 0 THEN f.p WHEN abs(z.z) >= 1.5 THEN -sign(z.z) ELSE 0.0 END::DOUBLE FROM f JOIN z ON z.root = f.root AND z.i = f.i + 1),
n AS (SELECT z.root, z.hour, CASE WHEN sum(abs(f.p)) OVER w > 0 THEN f.p - avg(f.p) OVER w ELSE 0 END AS d FROM f JOIN z ON z.root = f.root AND z.i = f.i WINDOW w AS (PARTITION BY hour))
SELECT root, hour, round(coalesce(d / nullif(sum(abs(d)) OVER (PARTITION BY hour), 0), 0), 6) AS weight FROM n""")
def o188(spark, sf_dir):
    p = residuals.residual(s.hourly(spark, sf_dir).withColumn("x", F.log("close")), "hour", "x")
    p = p.withColumn("z", windows.rolling_z("residual", series("root", order="hour"), 20))
    c = residuals.convergence(p.select("root", "hour", "z"), "hour", 1.5, 0.25)
    return residuals.normalise(c, "hour").select("root", "hour", *r6("weight"))


def _wide(spark, sf_dir):
    roots = roots_of(spark, sf_dir)
    h = s.hourly(spark, sf_dir)
    return h.groupBy("hour").pivot("root", roots).agg(F.first("close")).withColumn("universe", F.lit("all")), roots


@query("o167_rolling_mahalanobis")
def o167(spark, sf_dir):
    w, roots = _wide(spark, sf_dir)
    return anomaly.quantile_flags(anomaly.rolling_mahalanobis(w, ["universe"], "hour", roots, 100, 30), "distance")


@query("o169_robust_distance")
def o169(spark, sf_dir):
    w, roots = _wide(spark, sf_dir)
    return anomaly.robust_distance(w.select("hour", *roots), roots)


@query("o15l_ewma_mahalanobis")
def o15l(spark, sf_dir):
    w, roots = _wide(spark, sf_dir)
    return anomaly.ewma_mahalanobis(w, ["universe"], "hour", roots, 50, 30)


@query("o172_ridge_residuals")
def o172(spark, sf_dir):
    w, roots = _wide(spark, sf_dir)
    return anomaly.rolling_ridge_residual(w, ["universe"], "hour", roots, 100, 30)


@query("o173_cointegration")
def o173(spark, sf_dir):
    p = s.hourly(spark, sf_dir).withColumn("x", F.log("close"))
    rows = [(a, b) for _, a, b in joins.pairs_of([(r, "all") for r in roots_of(spark, sf_dir)])]
    return stats.cointegration(p, spark.createDataFrame(rows, "a string, b string"), "hour", "x")


def _pair_frames(spark, sf_dir):
    roots = roots_of(spark, sf_dir)
    h = s.hourly(spark, sf_dir).withColumn("x", F.log("close"))
    pair = spark.createDataFrame([(f"{a}/{b}", a, b) for _, a, b in joins.pairs_of([(r, "all") for r in roots])], "pair string, a string, b string")
    one = h.select(F.col("root").alias("a"), F.col("hour").alias("ts"), F.col("x").alias("log_price_a"))
    two = h.select(F.col("root").alias("b"), F.col("hour").alias("ts"), F.col("x").alias("log_price_b"))
    f = F.broadcast(pair).join(one, "a").join(two, ["b", "ts"])
    w = series("pair", order="ts")
    return f.select("pair", "ts", "log_price_a", "log_price_b", *[F.coalesce(F.col(f"log_price_{k}") - F.lag(f"log_price_{k}").over(w), F.lit(0.0)).alias(f"log_return_{k}") for k in ("a", "b")])


PAIRS = s.HOURLY_SQL + """,
lp AS (SELECT root, hour AS ts, ln(close) AS x FROM hourly),
fr AS (SELECT a.root || '/' || b.root AS pair, a.ts, a.x AS xa, b.x AS xb FROM lp a JOIN lp b ON a.ts = b.ts AND a.root < b.root),
be AS (SELECT *, CASE WHEN count(*) OVER w = 30 THEN covar_samp(xb, xa) OVER w / nullif(var_samp(xa) OVER w, 0) END AS beta FROM fr WINDOW w AS (PARTITION BY pair ORDER BY ts ROWS 29 PRECEDING)),
sp AS (SELECT *, xb - beta * xa AS spread FROM be),
zs AS (SELECT *, CASE WHEN count(spread) OVER w = 30 THEN (spread - avg(spread) OVER w) / nullif(stddev_samp(spread) OVER w, 0) END AS z FROM sp WINDOW w AS (PARTITION BY pair ORDER BY ts ROWS 29 PRECEDING))"""


@query("o100_rolling_beta", _sql(PAIRS, "SELECT pair, ts, round(beta, 4) AS beta, round(z, 4) AS z FROM zs"))
def o100(spark, sf_dir):
    df = windows.rolling_beta(_pair_frames(spark, sf_dir), "log_price_b", "log_price_a", series("pair", order="ts"), 30)
    return df.select("pair", "ts", F.round("beta", 4).alias("beta"), F.round("z", 4).alias("z"))


@query("o15c_pair_states", f"""WITH RECURSIVE {PAIRS},
n AS (SELECT *, row_number() OVER (PARTITION BY pair ORDER BY ts) AS i FROM zs),
f(pair, i, st) AS (SELECT pair, i, 0 FROM n WHERE i = 1 UNION ALL
  SELECT n.pair, n.i, CASE WHEN n.z IS NULL OR n.beta IS NULL THEN 0 WHEN f.st = 0 AND n.z > 1.5 THEN -1 WHEN f.st = 0 AND n.z < -1.5 THEN 1 WHEN f.st <> 0 AND abs(n.z) < 0.5 THEN 0 WHEN f.st = 1 AND n.z > 1.5 THEN -1 WHEN f.st = -1 AND n.z < -1.5 THEN 1 ELSE f.st END
  FROM f JOIN n ON n.pair = f.pair AND n.i = f.i + 1)
SELECT f.pair, n.ts, f.st AS state FROM f JOIN n ON n.pair = f.pair AND n.i = f.i""")
def o15c(spark, sf_dir):
    return pairs.run(_pair_frames(spark, sf_dir), 30, pairs.Rules(1.5, 0.5), 1.0).select("pair", "ts", "state")


DISTANCES = PAIRS + """,
mo AS (SELECT *, count(*) OVER w AS n, xa - avg(xa) OVER w AS da, xb - avg(xb) OVER w AS db, var_samp(xa) OVER w + 1e-4 AS va, var_samp(xb) OVER w + 1e-4 AS vb, covar_samp(xa, xb) OVER w AS ab
       FROM zs WINDOW w AS (PARTITION BY pair ORDER BY ts ROWS 29 PRECEDING)),
pu AS (SELECT *, CASE WHEN n = 30 THEN (vb * da - ab * db) / (va * vb - ab * ab) END AS pa, CASE WHEN n = 30 THEN (va * db - ab * da) / (va * vb - ab * ab) END AS pb FROM mo),
di AS (SELECT *, CASE WHEN da * pa + db * pb >= 0 THEN sqrt(da * pa + db * pb) END AS d, row_number() OVER (PARTITION BY pair ORDER BY ts) AS i FROM pu)"""


@query("o168_pair_distance", _sql(DISTANCES, "SELECT pair, ts, round(d, 4) AS distance FROM di"))
def o168(spark, sf_dir):
    return pairs.pair_distance(_pair_frames(spark, sf_dir), 30, 1e-4).select("pair", "ts", F.round("distance", 4).alias("distance"))


@query("o15d_confirmed_entries", f"""WITH RECURSIVE {DISTANCES},
f(pair, i, st) AS (SELECT pair, i, 0 FROM di WHERE i = 1 UNION ALL
  SELECT n.pair, n.i, CASE WHEN n.z IS NULL OR n.beta IS NULL THEN 0 WHEN f.st <> 0 AND abs(n.z) < 0.5 THEN 0
    WHEN (f.st = 0 OR f.st = 1) AND n.z > 1.5 THEN CASE WHEN n.d > 1.8 THEN -1 ELSE 0 END
    WHEN (f.st = 0 OR f.st = -1) AND n.z < -1.5 THEN CASE WHEN n.d > 1.8 THEN 1 ELSE 0 END ELSE f.st END
  FROM f JOIN di n ON n.pair = f.pair AND n.i = f.i + 1)
SELECT f.pair, n.ts, f.st AS state FROM f JOIN di n ON n.pair = f.pair AND n.i = f.i""")
def o15d(spark, sf_dir):
    frames = pairs.pair_distance(_pair_frames(spark, sf_dir), 30, 1e-4)
    return pairs.run(frames, 30, pairs.Rules(1.5, 0.5, confirm=1.8), 1.0).select("pair", "ts", "state")


@query("o15e_distance_pairs", f"""WITH RECURSIVE {DISTANCES},
f(pair, i, st) AS (SELECT pair, i, 0 FROM di WHERE i = 1 UNION ALL
  SELECT n.pair, n.i, CASE WHEN n.d IS NULL THEN 0 WHEN f.st = 1 AND n.d < 0.8 THEN 0 WHEN f.st = 0 AND n.d > 2.0 THEN 1 ELSE f.st END
  FROM f JOIN di n ON n.pair = f.pair AND n.i = f.i + 1)
SELECT f.pair, n.ts, f.st AS state, round(CASE WHEN f.st = 1 THEN -n.pa / (abs(n.pa) + abs(n.pb)) ELSE 0.0 END, 4)::DOUBLE AS target_a
FROM f JOIN di n ON n.pair = f.pair AND n.i = f.i""")
def o15e(spark, sf_dir):
    done = pairs.run_distance(_pair_frames(spark, sf_dir), 30, pairs.Rules(2.0, 0.8), 1.0, 1e-4)
    return done.select("pair", "ts", "state", F.round("target_a", 4).alias("target_a"))


@query("o066_pair_portfolio")
def o066(spark, sf_dir):
    return pairs.portfolio(pairs.run(_pair_frames(spark, sf_dir), 30, pairs.Rules(1.5, 0.5, 3, 3, 3), 1.0))


@query("o063_additive_metrics", _sql(s.HOURLY_SQL + """,
r AS (SELECT root, hour, coalesce(ln(close) - lag(ln(close)) OVER (PARTITION BY root ORDER BY hour), 0) AS x FROM hourly),
c AS (SELECT *, sum(x) OVER (PARTITION BY root ORDER BY hour ROWS UNBOUNDED PRECEDING) AS cs FROM r),
d AS (SELECT *, cs - max(cs) OVER (PARTITION BY root ORDER BY hour ROWS UNBOUNDED PRECEDING) AS dd FROM c)""", """SELECT root, count(*) AS n, round(sum(x), 6) AS total, round(stddev_samp(x) * sqrt(252), 6) AS volatility, round(min(dd), 6) AS drawdown FROM d GROUP BY root"""))
def o063(spark, sf_dir):
    h = s.hourly(spark, sf_dir).withColumn("x", windows.log_return("close", series("root", order="hour")))
    return pairs.additive_metrics(h, ["root"], "hour", "x", 252).select("root", "n", *r6("total", "volatility", "drawdown"))


@query("o176_hedge_ratio", _sql(PAIRS, "SELECT pair, count(*) AS n, round(regr_slope(xb, xa), 6) AS hedge, round(covar_samp(xa, xb) / (stddev_samp(xa) * stddev_samp(xb)), 6) AS corr FROM fr GROUP BY pair"))
def o176(spark, sf_dir):
    f = _pair_frames(spark, sf_dir)
    return f.groupBy("pair").agg(F.count(F.lit(1)).alias("n"), F.round(F.regr_slope("log_price_b", "log_price_a"), 6).alias("hedge"), F.round(safe_corr("log_price_a", "log_price_b"), 6).alias("corr"))


@query("o042_dimension_join", "SELECT n_name, r_name, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2")
def o042(spark, sf_dir):
    c, n, r = (s.table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    j = c.join(n, c["c_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"], "left")
    return j.groupBy("n_name", "r_name").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@query("o109_hold_mask", _sql(s.HOURLY_SQL, "SELECT root, hour, max(CASE WHEN volume >= 12 THEN 1 ELSE 0 END) OVER (PARTITION BY root ORDER BY hour ROWS 3 PRECEDING) = 1 AS paused FROM hourly"))
def o109(spark, sf_dir):
    h = s.hourly(spark, sf_dir).withColumn("big", F.col("volume") >= 12)
    return h.select("root", "hour", windows.hold_mask("big", series("root", order="hour"), 3).alias("paused"))


@query("o101_rolling_sum", _sql(s.HOURLY_SQL, "SELECT root, hour, CASE WHEN count(volume) OVER w = 6 THEN sum(volume) OVER w END AS total FROM hourly WINDOW w AS (PARTITION BY root ORDER BY hour ROWS 5 PRECEDING)"))
def o101(spark, sf_dir):
    return s.hourly(spark, sf_dir).select("root", "hour", windows.rolling_sum("volume", series("root", order="hour"), 6).alias("total"))

