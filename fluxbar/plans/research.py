
from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from fluxbar import sources as s
from fluxbar.catalog import query
from fluxbar.functions import div, safe_corr, series
from fluxbar.operators import anomaly, bars, flow, joins, panels, stats, studies, windows
from fluxbar.plans import experiments
from fluxbar.plans.market import BT, DOLLAR, IC, PAIRS, SHARE, _forward, _pair_frames, _ran, _sql, r6, roots_of

HOURLY_RET = s.HOURLY_SQL + """,
hr AS (SELECT *, coalesce(ln(close) - lag(ln(close)) OVER (PARTITION BY root ORDER BY hour), 0) AS ret FROM hourly)"""


def _hourly_ret(spark, sf_dir):
    return s.hourly(spark, sf_dir).withColumn("ret", windows.log_return("close", series("root", order="hour")))


@query("o026_coerced_numbers", "SELECT event_id, TRY_CAST(substr(props, 7, 2) AS DOUBLE) AS k, trim(event_type) AS event_type FROM events WHERE TRY_CAST(substr(props, 7, 2) AS DOUBLE) IS NOT NULL")
def o026(spark, sf_dir):
    e = s.table(spark, sf_dir, "events")
    return e.select("event_id", F.substring("props", 7, 2).try_cast("double").alias("k"), F.trim("event_type").alias("event_type")).dropna(subset=["k"])


@query("o028_optional_filters", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment = 'BUILDING'")
def o028(spark, sf_dir):
    return s.matching(s.table(spark, sf_dir, "customer"), {"c_mktsegment": "BUILDING", "listing_status": "Active"}).select("c_custkey", "c_mktsegment")


@query("o029_signed_union", """SELECT 'signup' AS root, event_id, CASE WHEN user_id % 2 = 0 THEN value ELSE -value END AS signed FROM events WHERE event_type = 'signup'
UNION ALL SELECT 'click', event_id, CASE WHEN user_id % 2 = 0 THEN value ELSE -value END FROM events WHERE event_type = 'click'
UNION ALL SELECT 'click', event_id, CASE WHEN user_id % 2 = 0 THEN value ELSE -value END FROM events WHERE event_type = 'click'""")
def o029(spark, sf_dir):
    e, signed = s.table(spark, sf_dir, "events"), F.when(F.col("user_id") % 2 == 0, F.col("value")).otherwise(-F.col("value"))
    signup, click = (e.where(F.col("event_type") == r).select(F.lit(r).alias("root"), "event_id", signed.alias("signed")) for r in ("signup", "click"))
    return signup.unionByName(click).unionByName(click)


@query("o030_linspace_rows", _sql(s.TRADES_SQL + """,
i AS (SELECT root, seq, row_number() OVER (ORDER BY ts, seq) - 1 AS row_index, count(*) OVER () AS n FROM trades),
w AS (SELECT DISTINCT CAST(round_even(k * ((SELECT count(*) FROM trades) - 1) / 99.0::DOUBLE, 0) AS BIGINT) AS place FROM range(100) t(k))""", "SELECT root, seq, row_index FROM i WHERE n <= 100 OR row_index IN (SELECT place FROM w)"))
def o030(spark, sf_dir):
    return panels.linspace_rows(s.trades(spark, sf_dir), ["ts", "seq"], 100).select("root", "seq", "row_index")


@query("o031_from_first_active", _sql(s.HOURLY_SQL, "SELECT root, hour, close FROM hourly QUALIFY hour >= min(hour) FILTER (n >= 4) OVER (PARTITION BY root)"))
def o031(spark, sf_dir):
    return panels.first_active(s.hourly(spark, sf_dir), ["root"], "hour", F.col("n") >= 4).select("root", "hour", "close")


@query("o032_positive_rows", "SELECT o_orderkey FROM orders WHERE o_totalprice > 0 AND o_custkey > 0")
def o032(spark, sf_dir):
    return s.table(spark, sf_dir, "orders").where((F.col("o_totalprice") > 0) & (F.col("o_custkey") > 0)).select("o_orderkey")


@query("o040_aligned_pairs", _sql(s.HOURLY_SQL, "SELECT a.root AS root_a, b.root AS root_b, a.hour, a.close AS close_a, b.close AS close_b FROM hourly a JOIN hourly b ON a.hour = b.hour AND a.root < b.root"))
def o040(spark, sf_dir):
    h = s.hourly(spark, sf_dir)
    pair = spark.createDataFrame([(a, b) for _, a, b in joins.pairs_of([(r, "all") for r in roots_of(spark, sf_dir)])], "root_a string, root_b string")
    one, two = (h.select(F.col("root").alias(f"root_{k}"), "hour", F.col("close").alias(f"close_{k}")) for k in "ab")
    return F.broadcast(pair).join(one, "root_a").join(two, ["root_b", "hour"])


@query("o052_reindexed_panel", _sql(s.HOURLY_SQL, """SELECT h.hour, r.root, round(coalesce(p.notional, 0), 4) AS notional FROM (SELECT DISTINCT hour FROM hourly) h CROSS JOIN (SELECT DISTINCT root FROM hourly) r
LEFT JOIN hourly p ON p.hour = h.hour AND p.root = r.root"""))
def o052(spark, sf_dir):
    return panels.cells(s.hourly(spark, sf_dir), "hour", roots_of(spark, sf_dir), ["notional"]).select("hour", "root", F.round("notional", 4).alias("notional"))


@query("o068_session_volume", _sql(s.TRADES_SQL, "SELECT root, CAST(ts AS DATE) AS day, sum(size) AS volume, max(ts) AS last_ts, count(*) AS n FROM trades GROUP BY 1, 2"))
def o068(spark, sf_dir):
    return s.trades(spark, sf_dir).groupBy("root", F.to_date("ts").alias("day")).agg(F.sum("size").alias("volume"), F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("n"))


@query("o071_bar_summary", f"""WITH RECURSIVE {DOLLAR},
b AS (SELECT bar, epoch_us(max(ts)) - epoch_us(min(ts)) AS us, CAST(max(ts) AS DATE) AS day, bool_or(closed) AS complete FROM fold JOIN seqd USING (i) GROUP BY bar)
SELECT count(*) AS n, count(DISTINCT day) AS days, round(count(*) / count(DISTINCT day), 6) AS per_day, round(avg(us) / 1e6, 3) AS mean_seconds, round(median(us) / 1e6, 3) AS median_seconds FROM b WHERE complete""")
def o071(spark, sf_dir):
    b = bars.value_boundaries(s.trades(spark, sf_dir), 30000, ["ts", "seq"]).where("complete")
    us = F.unix_micros(F.col("last_ts").cast("timestamp")) - F.unix_micros(F.col("first_ts").cast("timestamp"))
    days = F.countDistinct(F.to_date("last_ts"))
    return b.agg(F.count(F.lit(1)).alias("n"), days.alias("days"), F.round(div(F.count(F.lit(1)), days), 6).alias("per_day"), F.round(F.avg(us) / 1e6, 3).alias("mean_seconds"), F.round(F.median(us) / 1e6, 3).alias("median_seconds"))


@query("o072_size_summary", _sql(s.TRADES_SQL + """,
q AS (SELECT root, quantile_cont(notional, [0.5, 0.9, 0.99]) AS q FROM trades GROUP BY root),
b AS (SELECT t.*, CASE WHEN notional <= q[1] THEN 'small' WHEN notional <= q[2] THEN 'medium' WHEN notional <= q[3] THEN 'large' ELSE 'very_large' END AS bucket FROM trades t JOIN q ON q.root = t.root)""", """SELECT root, bucket, count(*) AS n,
  round(sum(notional) / sum(sum(notional)) OVER (PARTITION BY root), 6) AS share, round(sum(signed) / sum(notional), 6) AS signed_ratio, max(size) AS most FROM b GROUP BY 1, 2"""))
def o072(spark, sf_dir):
    got = flow.size_buckets(s.trades(spark, sf_dir)).groupBy("root", "bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("notional").alias("v"), F.sum("signed").alias("g"), F.max("size").alias("most"))
    return got.select("root", "bucket", "n", F.round(div(F.col("v"), F.sum("v").over(Window.partitionBy("root"))), 6).alias("share"), F.round(div(F.col("g"), F.col("v")), 6).alias("signed_ratio"), "most")


@query("o076_monthly_ic", _sql(s.HOURLY_SQL + """,
f AS (SELECT root, date_trunc('month', hour) AS month, signed AS x, CASE WHEN count(*) OVER w = 3 THEN sum(ln(close)) OVER w END AS y FROM hourly WINDOW w AS (PARTITION BY root ORDER BY hour ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING)),
b AS (SELECT * FROM f WHERE y IS NOT NULL),
rk AS (SELECT root, month, rank() OVER (PARTITION BY root, month ORDER BY x) + (count(*) OVER (PARTITION BY root, month, x) - 1) / 2.0::DOUBLE AS rx, rank() OVER (PARTITION BY root, month ORDER BY y) + (count(*) OVER (PARTITION BY root, month, y) - 1) / 2.0::DOUBLE AS ry FROM b)""", """SELECT root, CAST(month AS DATE) AS month, count(*) AS n,
  CASE WHEN count(*) >= 30 THEN round(covar_samp(rx, ry) / nullif(stddev_samp(rx) * stddev_samp(ry), 0), 6) END AS ic FROM rk GROUP BY 1, 2"""))
def o076(spark, sf_dir):
    f = _forward(spark, sf_dir).withColumn("month", F.to_date(F.date_trunc("month", "hour")))
    return stats.information_coefficient(f, ["root", "month"], "x", "y").select("root", "month", "n", *r6("ic"))


@query("o077_daily_sums", _sql(HOURLY_RET, "SELECT root, CAST(hour AS DATE) AS day, round(sum(ret), 6) AS ret, count(*) FILTER (volume >= 12) AS active FROM hr GROUP BY 1, 2"))
def o077(spark, sf_dir):
    return _hourly_ret(spark, sf_dir).groupBy("root", F.to_date("hour").alias("day")).agg(F.round(F.sum("ret"), 6).alias("ret"), F.count_if(F.col("volume") >= 12).alias("active"))


@query("o083_weighted_price", _sql(s.TRADES_SQL, "SELECT root, CAST(ts AS DATE) AS day, round(sum(notional) / sum(size), 6) AS vwap FROM trades GROUP BY 1, 2"))
def o083(spark, sf_dir):
    return s.trades(spark, sf_dir).groupBy("root", F.to_date("ts").alias("day")).agg(F.round(div(F.sum("notional"), F.sum("size")), 6).alias("vwap"))


@query("o084_compound_return", _sql(BT, "SELECT symbol, CAST(date_trunc('month', ts) AS DATE) AS month, round(product(1 + ret) - 1, 6) AS ret FROM ma GROUP BY 1, 2"))
def o084(spark, sf_dir):
    return _ran(spark, sf_dir).groupBy("symbol", F.to_date(F.date_trunc("month", "ts")).alias("month")).agg(F.round(F.product(1 + F.col("ret")) - 1, 6).alias("ret"))


@query("o086_correlations_with", _sql(s.HOURLY_SQL, """SELECT 'volume' AS "column", round(covar_samp(volume, close) / (stddev_samp(volume) * stddev_samp(close)), 6) AS corr FROM hourly
UNION ALL SELECT 'notional', round(covar_samp(notional, close) / (stddev_samp(notional) * stddev_samp(close)), 6) FROM hourly
UNION ALL SELECT 'signed', round(covar_samp(signed, close) / (stddev_samp(signed) * stddev_samp(close)), 6) FROM hourly"""))
def o086(spark, sf_dir):
    return panels.correlations_with(s.hourly(spark, sf_dir), "close", ["volume", "notional", "signed"]).select("column", *r6("corr"))


@query("o087_describe", _sql(s.TRADES_SQL, """SELECT root, count(price) AS n, round(avg(price), 6) AS mean, round(stddev_samp(price), 6) AS sd, min(price) AS min, max(price) AS max, round(quantile_cont(price, 0.05), 6) AS q5, round(quantile_cont(price, 0.25), 6) AS q25,
  round(quantile_cont(price, 0.5), 6) AS q50, round(quantile_cont(price, 0.75), 6) AS q75, round(quantile_cont(price, 0.95), 6) AS q95 FROM trades GROUP BY root"""))
def o087(spark, sf_dir):
    return panels.describe(s.trades(spark, sf_dir), ["root"], "price").select("root", "n", *r6("mean", "sd"), "min", "max", *r6("q5", "q25", "q50", "q75", "q95"))


@query("o098_changed_root", _sql(s.TRADES_SQL, "SELECT user_id, seq, coalesce(root <> lag(root) OVER (PARTITION BY user_id ORDER BY ts, seq), false) AS changed FROM trades"))
def o098(spark, sf_dir):
    return s.trades(spark, sf_dir).select("user_id", "seq", panels.changed("root", series("user_id", order=["ts", "seq"])).alias("changed"))


@query("o103_next_return", _sql(HOURLY_RET, "SELECT root, hour, round(lead(ret) OVER (PARTITION BY root ORDER BY hour), 6) AS next_ret FROM hr"))
def o103(spark, sf_dir):
    return _hourly_ret(spark, sf_dir).select("root", "hour", F.round(F.lead("ret").over(series("root", order="hour")), 6).alias("next_ret"))


@query("o104_from_first", _sql(s.HOURLY_SQL, "SELECT root, hour, round(close / first_value(close) OVER (PARTITION BY root ORDER BY hour) - 1, 6) AS gain FROM hourly"))
def o104(spark, sf_dir):
    return s.hourly(spark, sf_dir).select("root", "hour", F.round(panels.from_first("close", series("root", order="hour")), 6).alias("gain"))


@query("o108_global_index", _sql(s.TRADES_SQL, "SELECT seq, row_number() OVER (ORDER BY ts, seq) - 1 AS row_index FROM trades"))
def o108(spark, sf_dir):
    return panels.global_index(s.trades(spark, sf_dir).select("ts", "seq"), ["ts", "seq"]).select("seq", "row_index")


@query("o111_time_checks", _sql(s.TRADES_SQL + """,
g AS (SELECT root, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY root ORDER BY seq) AS step FROM trades)""", "SELECT root, count(*) AS n, count(*) FILTER (step = 0) AS repeated, count(*) FILTER (step < 0) AS backward, count(*) FILTER (step > 3600000000) AS gaps FROM g GROUP BY root"))
def o111(spark, sf_dir):
    return panels.time_checks(s.trades(spark, sf_dir), ["root"], "ts", "seq", 3600)


@query("o114_embargo_split", _sql(s.TRADES_SQL + """,
i AS (SELECT seq, row_number() OVER (ORDER BY ts, seq) - 1 AS i, count(*) OVER () AS n FROM trades),
c AS (SELECT *, least(greatest(floor(n * 0.7), 1), n - 1) AS cut FROM i)""", "SELECT seq, CASE WHEN i < cut THEN 'train' WHEN i < cut + 50 THEN 'embargo' ELSE 'test' END AS part FROM c"))
def o114(spark, sf_dir):
    return panels.embargo_split(s.trades(spark, sf_dir), ["ts", "seq"], 0.7, 50).select("seq", "part")


@query("o125_top_correlations", _sql(IC + """,
c AS (SELECT root, count(*) AS n, covar_samp(rx, ry) / nullif(stddev_samp(rx) * stddev_samp(ry), 0) AS ic FROM rk GROUP BY root)""", "SELECT root, n, round(ic, 6) AS ic FROM c WHERE n >= 30 AND ic IS NOT NULL ORDER BY abs(ic) DESC, root LIMIT 3"))
def o125(spark, sf_dir):
    return studies.leaderboard(stats.information_coefficient(_forward(spark, sf_dir), ["root"], "x", "y"), "ic", ["root"], 3).select("root", "n", *r6("ic"))


@query("o161_bucket_shares", _sql(s.TRADES_SQL, """SELECT root, CAST(ts AS DATE) AS day, round(coalesce(sum(notional) FILTER (size >= 4), 0) / sum(notional), 6) AS large, round(coalesce(sum(notional) FILTER (size < 4), 0) / sum(notional), 6) AS small,
  round((coalesce(sum(notional) FILTER (size >= 4), 0) - coalesce(sum(notional) FILTER (size < 4), 0)) / sum(notional), 6) AS large_less_small FROM trades GROUP BY 1, 2"""))
def o161(spark, sf_dir):
    large, every = F.sum(F.when(F.col("size") >= 4, F.col("notional")).otherwise(0.0)), F.sum("notional")
    small = F.sum(F.when(F.col("size") < 4, F.col("notional")).otherwise(0.0))
    got = s.trades(spark, sf_dir).groupBy("root", F.to_date("ts").alias("day")).agg(div(large, every).alias("large"), div(small, every).alias("small"), div(large - small, every).alias("large_less_small"))
    return got.select("root", "day", *r6("large", "small", "large_less_small"))


@query("o162_contributions", _sql(SHARE, "SELECT hour, round(max(share) FILTER (root = 'click'), 6) AS click, round(max(share) FILTER (root = 'purchase'), 6) AS purchase, round(max(share) FILTER (root = 'signup'), 6) AS signup FROM sh GROUP BY hour"))
def o162(spark, sf_dir):
    sh = flow.shares(s.hourly(spark, sf_dir), "hour", "notional")
    return panels.wide(sh, "hour", ["click", "purchase", "signup"], "share").select("hour", *r6("click", "purchase", "signup"))


@query("o163_signed_flow", _sql(s.HOURLY_SQL, "SELECT root, hour, round(signed / sum(notional) OVER (PARTITION BY hour), 6) AS flow FROM hourly"))
def o163(spark, sf_dir):
    return s.hourly(spark, sf_dir).select("root", "hour", F.round(div(F.col("signed"), F.sum("notional").over(Window.partitionBy("hour"))), 6).alias("flow"))


@query("o170_quantile_flags", _sql(HOURLY_RET + """,
q AS (SELECT quantile_cont(abs(ret), [0.9, 0.95, 0.99]) AS q FROM hr)""", "SELECT root, hour, abs(ret) >= q[1] AS move_q90, abs(ret) >= q[2] AS move_q95, abs(ret) >= q[3] AS move_q99 FROM hr, q"))
def o170(spark, sf_dir):
    moves = _hourly_ret(spark, sf_dir).withColumn("move", F.abs("ret"))
    return anomaly.quantile_flags(moves, "move").select("root", "hour", "move_q90", "move_q95", "move_q99")


@query("o177_pair_selection", _sql(PAIRS + """,
m AS (SELECT pair, count(*) AS n, covar_samp(xa, xb) / nullif(stddev_samp(xa) * stddev_samp(xb), 0) AS corr, covar_samp(xa, xb) / nullif(var_samp(xa), 0) AS hedge FROM fr GROUP BY pair)""", """SELECT pair, n, round(corr, 6) AS corr, round(hedge, 6) AS hedge,
  CASE WHEN n < 100 THEN 'short' WHEN corr IS NULL THEN 'no correlation' WHEN abs(corr) < 0.05 THEN 'low correlation' WHEN hedge IS NULL OR hedge <= 0 THEN 'no hedge' ELSE 'selected' END AS status FROM m"""))
def o177(spark, sf_dir):
    m = _pair_frames(spark, sf_dir).groupBy("pair").agg(
        F.count(F.lit(1)).alias("n"), safe_corr("log_price_a", "log_price_b").alias("corr"),
        div(F.covar_samp("log_price_a", "log_price_b"), F.nullif(F.var_samp("log_price_a"), F.lit(0.0))).alias("hedge"),
    )
    checks = [("short", F.col("n") >= 100), ("no correlation", F.col("corr").isNotNull()), ("low correlation", F.abs("corr") >= 0.05), ("no hedge", F.col("hedge") > 0)]
    return m.select("pair", "n", *r6("corr", "hedge"), studies.first_reason(checks).alias("status"))


@query("o179_threshold_study", _sql(HOURLY_RET + """,
f AS (SELECT root, volume >= 12 AS flag, lead(ret) OVER (PARTITION BY root ORDER BY hour) AS y FROM hr),
g AS (SELECT root, count(y) FILTER (flag) AS n, avg(y) FILTER (flag) * 1e4 AS hit, avg(y) FILTER (NOT flag) * 1e4 AS base FROM f GROUP BY root)""", "SELECT root, n, round(hit, 4) AS mean_bps, round(base, 4) AS base_bps, round(hit - base, 4) AS excess_bps FROM g WHERE n > 0"))
def o179(spark, sf_dir):
    f = _hourly_ret(spark, sf_dir).withColumn("flag", F.col("volume") >= 12).withColumn("y", F.lead("ret").over(series("root", order="hour")))
    return studies.threshold_study(f, ["root"], "flag", "y").select("root", "n", *[F.round(c, 4).alias(c) for c in ("mean_bps", "base_bps", "excess_bps")])


@query("o186_train_thresholds", _sql(s.HOURLY_SQL + """,
t AS (SELECT *, hour < TIMESTAMP '2024-01-20' AS train FROM hourly),
q AS (SELECT root, quantile_cont(volume, 0.9) AS v, quantile_cont(notional, 0.8) AS m FROM t WHERE train GROUP BY root)""", "SELECT t.root, hour, coalesce(volume >= v, false) AS volume_over, coalesce(notional >= m, false) AS notional_over FROM t LEFT JOIN q ON q.root = t.root"))
def o186(spark, sf_dir):
    t = s.hourly(spark, sf_dir).withColumn("train", F.col("hour") < F.lit("2024-01-20").cast("timestamp_ntz"))
    return studies.train_thresholds(t, "train", {"volume": 0.9, "notional": 0.8}, ["root"]).select("root", "hour", "volume_over", "notional_over")


@query("o18b_cost_sweep", _sql(BT, """SELECT symbol, c AS cost_bps, round(product(1 + position * ret - turnover * c / 1e4) - 1, 6) AS total_return, round(avg(position * ret - turnover * c / 1e4), 8) AS mean_net
FROM ran, (VALUES (0.0::DOUBLE), (1.5::DOUBLE), (5.0::DOUBLE)) v(c) GROUP BY 1, 2"""))
def o18b(spark, sf_dir):
    return studies.cost_sweep(_ran(spark, sf_dir), ["symbol"], [0.0, 1.5, 5.0]).select("symbol", "cost_bps", F.round("total_return", 6).alias("total_return"), F.round("mean_net", 8).alias("mean_net"))


@query("o18c_decisions", _sql(BT, """SELECT symbol, product(1 + net) > 1 AS gains, min(drawdown) > -0.2 AS shallow, product(1 + net) > 1 AND min(drawdown) > -0.2 AS passed FROM ran GROUP BY symbol"""))
def o18c(spark, sf_dir):
    m = _ran(spark, sf_dir).groupBy("symbol").agg((F.product(1 + F.col("net")) - 1).alias("total"), F.min("drawdown").alias("depth"))
    return studies.decide(m, [("gains", F.col("total") > 0), ("shallow", F.col("depth") > -0.2)]).select("symbol", "gains", "shallow", "passed")


@query("o190_principal_axes")
def o190(spark, sf_dir):
    h = s.hourly(spark, sf_dir)
    return studies.principal_axes(h, ["close", "volume", "notional", "signed"], 3)[0].select("root", "hour", "pc1", "pc2", "pc3")


@query("o192_clusters")
def o192(spark, sf_dir):
    return studies.clusters(s.hourly(spark, sf_dir), ["close", "volume", "signed"]).select("root", "hour", "cluster")


@query("o200_experiment", _sql(BT, "SELECT symbol, count(*) AS n, round(arg_max(equity, ts) - 1, 6) AS total_return, round(min(drawdown), 6) AS max_drawdown, round(sum(turnover), 6) AS turnover FROM ran GROUP BY symbol"))
def o200(spark, sf_dir):
    config = {"strategy": {"fast": 10, "slow": 40}, "backtest": {"cost_bps": 1.5, "per_year": 12}}
    bars_ = s.daily_bars(spark, sf_dir).withColumnRenamed("ts", "timestamp")
    return experiments.evaluate(bars_, config)[1].select("symbol", "n", *r6("total_return", "max_drawdown", "turnover"))
