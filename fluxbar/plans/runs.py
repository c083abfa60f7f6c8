
from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from fluxbar import sources as s
from fluxbar.catalog import query
from fluxbar.functions import div, series
from fluxbar.operators import anomaly, bars, flow, pairs, panels, residuals, stats, windows
from fluxbar.plans.market import DISTANCES, IC, SHARE, _forward, _pair_frames, _ran, _sql, _wide, r6, roots_of
from fluxbar.plans.research import BT, HOURLY_RET, _hourly_ret

LOAD = "SELECT o_orderdate AS timestamp, o_orderpriority AS symbol, o_totalprice AS open, o_totalprice AS high, o_totalprice AS low, o_totalprice AS close, 0.0::DOUBLE AS volume FROM orders"


def _loaded(spark, sf_dir):
    raw = s.table(spark, sf_dir, "orders").select("o_orderdate", "o_orderpriority", "o_totalprice")
    return s.normalise_bars(raw, {"o_orderdate": "timestamp", "o_orderpriority": "symbol", "o_totalprice": "close"})


@query("o004_normalised_bars", LOAD)
def o004n(spark, sf_dir):
    return _loaded(spark, sf_dir).withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))


@query("o020_bar_checks", f"""WITH b AS ({LOAD}), k AS (SELECT symbol, timestamp, count(*) AS n, count(*) FILTER (close <= 0) AS low FROM b GROUP BY 1, 2)
SELECT CAST(sum(n) AS BIGINT) AS bars, CAST(sum(low) AS BIGINT) AS not_positive, 0::BIGINT AS crossed, CAST(sum(n - 1) AS BIGINT) AS repeated FROM k""")
def o020c(spark, sf_dir):
    return s.bar_checks(_loaded(spark, sf_dir))


@query("o010_union_of_tables", "SELECT 'nation' AS root, n_nationkey AS key, n_name AS name, n_regionkey AS parent FROM nation UNION ALL SELECT 'region', r_regionkey, r_name, NULL FROM region")
def o010(spark, sf_dir):
    n = s.load_roots(spark, sf_dir, ["nation", "absent"]).select("root", F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("parent"))
    r = s.load_roots(spark, sf_dir, ["region"]).select("root", F.col("r_regionkey").alias("key"), F.col("r_name").alias("name"))
    return n.unionByName(r, allowMissingColumns=True)


@query("o012_daily_panel", _sql(s.HOURLY_SQL, """SELECT CAST(hour AS DATE) AS day, arg_max(close, hour) FILTER (root = 'click') AS click, arg_max(close, hour) FILTER (root = 'purchase') AS purchase, arg_max(close, hour) FILTER (root = 'signup') AS signup FROM hourly GROUP BY 1"""))
def o012(spark, sf_dir):
    daily = s.hourly(spark, sf_dir).groupBy("root", F.to_date("hour").alias("day")).agg(F.max_by("close", "hour").alias("close"))
    wide = panels.wide(daily.where(F.col("root").isin("click", "purchase", "signup")), "day", ["click", "purchase", "signup"], "close")
    return daily.select("day").distinct().join(wide, "day", "left")


BUYS = """,
buys AS (SELECT root, date_trunc('hour', ts) AS hour, sum(notional) AS bought FROM trades WHERE side = 'B' GROUP BY 1, 2)"""


def _buys(spark, sf_dir):
    t = s.trades(spark, sf_dir).where("side = 'B'")
    return t.groupBy("root", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")).agg(F.sum("notional").alias("bought"))


@query("o041_returns_with_flow", _sql(HOURLY_RET + BUYS, "SELECT root, hour, round(ret, 6) AS ret, round(bought, 4) AS bought FROM hr JOIN buys USING (root, hour)"))
def o041(spark, sf_dir):
    return _hourly_ret(spark, sf_dir).join(_buys(spark, sf_dir), ["root", "hour"]).select("root", "hour", *r6("ret"), F.round("bought", 4).alias("bought"))


@query("o043_returns_or_no_flow", _sql(HOURLY_RET + BUYS, "SELECT root, hour, round(ret, 6) AS ret, round(coalesce(bought, 0), 4) AS bought FROM hr LEFT JOIN buys USING (root, hour)"))
def o043(spark, sf_dir):
    j = _hourly_ret(spark, sf_dir).join(_buys(spark, sf_dir), ["root", "hour"], "left")
    return j.select("root", "hour", *r6("ret"), F.round(F.coalesce("bought", F.lit(0.0)), 4).alias("bought"))


@query("o042_schedule_join", _sql(s.TRADES_SQL + """,
a AS (SELECT root, CAST(ts AS DATE) AS day, arg_max(side, (size, ts, seq)) AS active FROM trades GROUP BY 1, 2)""", "SELECT t.seq, t.root, a.active, coalesce(t.side = a.active, false) AS is_active FROM trades t LEFT JOIN a ON a.root = t.root AND a.day = CAST(t.ts AS DATE)"))
def o042s(spark, sf_dir):
    t = s.trades(spark, sf_dir).withColumn("day", F.to_date("ts"))
    a = t.groupBy("root", "day").agg(F.max_by("side", F.struct("size", "ts", "seq")).alias("active"))
    return t.join(a, ["root", "day"], "left").select("seq", "root", "active", F.coalesce(F.col("side") == F.col("active"), F.lit(False)).alias("is_active"))


@query("o051_joined_by_position", _sql(s.TRADES_SQL + """,
a AS (SELECT seq, row_number() OVER (ORDER BY ts, seq) AS i FROM trades), b AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS i FROM orders)""", "SELECT seq, o_orderkey FROM a JOIN b USING (i)"))
def o051(spark, sf_dir):
    a = panels.global_index(s.trades(spark, sf_dir).select("ts", "seq"), ["ts", "seq"])
    b = panels.global_index(s.table(spark, sf_dir, "orders").select("o_orderdate", "o_orderkey"), ["o_orderdate", "o_orderkey"])
    return a.join(b, "row_index").select("seq", "o_orderkey")


@query("o053_calendar_index", _sql(s.TRADES_SQL + """,
d AS (SELECT day, row_number() OVER (ORDER BY day) - 1 AS i FROM (SELECT DISTINCT CAST(ts AS DATE) AS day FROM trades))""", "SELECT t.root, d.i AS day_index, n.day AS next_day, count(*) AS n FROM trades t JOIN d ON d.day = CAST(t.ts AS DATE) LEFT JOIN d n ON n.i = d.i + 1 GROUP BY 1, 2, 3"))
def o053(spark, sf_dir):
    # Days are few: numbering them over one window costs no task more than a calendar.
    t = s.trades(spark, sf_dir).groupBy("root", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    d = t.select("day").distinct().withColumn("i", F.dense_rank().over(Window.orderBy("day")) - 1)
    ahead = d.select(F.col("day").alias("next_day"), (F.col("i") - 1).alias("i"))
    return t.join(F.broadcast(d), "day").join(F.broadcast(ahead), "i", "left").select("root", F.col("i").cast("long").alias("day_index"), "next_day", "n")


@query("o054_metrics_beside_rows", _sql(HOURLY_RET, "SELECT h.root, h.hour, round(h.ret / nullif(m.sd, 0), 4) AS scaled FROM hr h LEFT JOIN (SELECT root, stddev_samp(ret) AS sd FROM hr GROUP BY 1) m ON m.root = h.root"))
def o054(spark, sf_dir):
    h = _hourly_ret(spark, sf_dir)
    m = h.groupBy("root").agg(F.stddev_samp("ret").alias("sd"))
    return h.join(m, "root", "left").select("root", "hour", F.round(div(F.col("ret"), F.nullif("sd", F.lit(0.0))), 4).alias("scaled"))


@query("o064_return_summary", _sql(HOURLY_RET, """SELECT root, count(*) AS n, round(sum(ret), 6) AS total, round(avg(ret) * 1e4, 4) AS mean_bps, round(avg(ret) / stddev_samp(ret) * sqrt(count(*)), 4) AS t, round(avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END), 6) AS hit_rate,
  CAST(count(*) AS DOUBLE) / count(DISTINCT CAST(hour AS DATE)) AS per_day FROM hr GROUP BY root"""))
def o064(spark, sf_dir):
    h = _hourly_ret(spark, sf_dir)
    rest = h.groupBy("root").agg(F.sum("ret").alias("total"), (F.count(F.lit(1)) / F.countDistinct(F.to_date("hour"))).alias("per_day"))
    return stats.return_stats(h, ["root"], "ret").join(rest, "root").select("root", "n", *r6("total"), F.round("mean_bps", 4).alias("mean_bps"), F.round("t", 4).alias("t"), *r6("hit_rate"), "per_day")


ELAPSED = "greatest((epoch_us(max(hour)) - epoch_us(min(hour))) / 31557600000000.0::DOUBLE, 1e-9)"


@query("o065_metric_block", _sql(HOURLY_RET + """,
e AS (SELECT *, sum(ret) OVER (PARTITION BY root ORDER BY hour ROWS UNBOUNDED PRECEDING) AS cs FROM hr), d AS (SELECT *, exp(cs - max(cs) OVER (PARTITION BY root ORDER BY hour ROWS UNBOUNDED PRECEDING)) - 1 AS dd FROM e)""",
    f"SELECT root, count(*) AS n, round(exp(sum(ret)) - 1, 6) AS compounded, round(stddev_samp(ret) * sqrt(count(*) / {ELAPSED}), 4) AS volatility, round(avg(ret) / stddev_samp(ret) * sqrt(count(*) / {ELAPSED}), 4) AS sharpe, round(min(dd), 6) AS drawdown, round(quantile_cont(abs(ret), 0.95), 6) AS move_q95 FROM d GROUP BY root"))
def o065(spark, sf_dir):
    return stats.metric_block(_hourly_ret(spark, sf_dir), ["root"], "hour", "ret").select("root", "n", *r6("compounded"), *[F.round(c, 4).alias(c) for c in ("volatility", "sharpe")], *r6("drawdown", "move_q95"))


@query("o18d_rows_a_year", _sql(s.HOURLY_SQL, f"SELECT root, round(count(*) / {ELAPSED}, 4) AS per_year FROM hourly GROUP BY root"))
def o18d(spark, sf_dir):
    return s.hourly(spark, sf_dir).groupBy("root").agg(F.round(stats.rows_a_year("hour"), 4).alias("per_year"))


@query("o067_mean_by_time", _sql(HOURLY_RET, "SELECT hour, round(avg(ret), 6) AS mean_ret, count(*) AS roots FROM hr GROUP BY hour"))
def o067(spark, sf_dir):
    return _hourly_ret(spark, sf_dir).groupBy("hour").agg(F.round(F.avg("ret"), 6).alias("mean_ret"), F.count(F.lit(1)).alias("roots"))


@query("o070_manifest", "SELECT source, count(*) AS files, CAST(sum(n_chars) AS BIGINT) AS size, min(doc_id) AS first, max(doc_id) AS last, bool_and(lang IS NOT NULL) AS complete FROM documents GROUP BY source")
def o070(spark, sf_dir):
    return s.table(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("files"), F.sum("n_chars").cast("long").alias("size"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.bool_and(F.col("lang").isNotNull()).alias("complete"))


@query("o130_union_all", "SELECT event_type AS root FROM events UNION ALL SELECT o_orderpriority FROM orders")
def o130a(spark, sf_dir):
    return s.table(spark, sf_dir, "events").select(F.col("event_type").alias("root")).union(s.table(spark, sf_dir, "orders").select("o_orderpriority"))


@query("o120_sorted_places", "SELECT l_orderkey, l_linenumber, row_number() OVER (ORDER BY l_shipdate, l_orderkey, l_linenumber) - 1 AS row_index FROM lineitem")
def o120(spark, sf_dir):
    li = s.table(spark, sf_dir, "lineitem").select("l_shipdate", "l_orderkey", "l_linenumber")
    return panels.global_index(li, ["l_shipdate", "l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber", "row_index")


@query("o155_variance_threshold", _sql(HOURLY_RET + """,
v AS (SELECT root, CAST(hour AS DATE) AS day, sum(ret * ret) AS v FROM hr WHERE hour < TIMESTAMP '2024-01-20' GROUP BY 1, 2)""", "SELECT root, round(avg(v) / 6, 9) AS threshold FROM v GROUP BY root"))
def o155(spark, sf_dir):
    h = _hourly_ret(spark, sf_dir).withColumn("day", F.to_date("hour"))
    return bars.variance_threshold(h, F.col("hour") < F.lit("2024-01-20").cast("timestamp_ntz"), 6).select("root", F.round("threshold", 9).alias("threshold"))


@query("o158_daily_last", _sql(BT, "SELECT symbol, CAST(date_trunc('month', ts) AS DATE) AS month, round(arg_max(equity, ts), 6) AS equity, round(arg_max(drawdown, ts), 6) AS drawdown FROM ran GROUP BY 1, 2"))
def o158(spark, sf_dir):
    last = F.max_by(F.struct("equity", "drawdown"), "ts").alias("x")
    return _ran(spark, sf_dir).groupBy("symbol", F.to_date(F.date_trunc("month", "ts")).alias("month")).agg(last).select("symbol", "month", *[F.round(f"x.{c}", 6).alias(c) for c in ("equity", "drawdown")])


STATES = DISTANCES + """,
fz(pair, i, st) AS (SELECT pair, i, 0 FROM di WHERE i = 1 UNION ALL
  SELECT n.pair, n.i, CASE WHEN n.z IS NULL OR n.beta IS NULL THEN 0 WHEN f.st = 0 AND n.z > 1.5 THEN -1 WHEN f.st = 0 AND n.z < -1.5 THEN 1 WHEN f.st <> 0 AND abs(n.z) < 0.5 THEN 0 WHEN f.st = 1 AND n.z > 1.5 THEN -1 WHEN f.st = -1 AND n.z < -1.5 THEN 1 ELSE f.st END
  FROM fz f JOIN di n ON n.pair = f.pair AND n.i = f.i + 1)"""


@query("o15f_small_changes", f"""WITH RECURSIVE {STATES},
t AS (SELECT n.pair, n.ts, n.i, CASE WHEN st = 0 THEN 0.0 ELSE -st * beta / (abs(beta) + 1) END::DOUBLE AS a, CASE WHEN st = 0 THEN 0.0 ELSE st / (abs(beta) + 1) END::DOUBLE AS b FROM fz JOIN di n ON n.pair = fz.pair AND n.i = fz.i),
h(pair, i, a, b) AS (SELECT pair, i, CASE WHEN abs(a) + abs(b) >= 0.2 THEN a ELSE 0.0 END::DOUBLE, CASE WHEN abs(a) + abs(b) >= 0.2 THEN b ELSE 0.0 END::DOUBLE FROM t WHERE i = 1 UNION ALL
  SELECT t.pair, t.i, CASE WHEN abs(t.a - h.a) + abs(t.b - h.b) >= 0.2 THEN t.a ELSE h.a END, CASE WHEN abs(t.a - h.a) + abs(t.b - h.b) >= 0.2 THEN t.b ELSE h.b END FROM h JOIN t ON t.pair = h.pair AND t.i = h.i + 1)
SELECT h.pair, t.ts, round(h.a, 4) AS target_a, round(h.b, 4) AS target_b FROM h JOIN t ON t.pair = h.pair AND t.i = h.i""")
def o15f(spark, sf_dir):
    done = pairs.run(_pair_frames(spark, sf_dir), 30, pairs.Rules(1.5, 0.5, min_change=0.2), 1.0)
    return done.select("pair", "ts", F.round("target_a", 4).alias("target_a"), F.round("target_b", 4).alias("target_b"))


RUNS = STATES + """,
fd(pair, i, st) AS (SELECT pair, i, 0 FROM di WHERE i = 1 UNION ALL
  SELECT n.pair, n.i, CASE WHEN n.z IS NULL OR n.beta IS NULL THEN 0 WHEN f.st <> 0 AND abs(n.z) < 0.5 THEN 0
    WHEN (f.st = 0 OR f.st = 1) AND n.z > 1.5 THEN CASE WHEN n.d > 1.8 THEN -1 ELSE 0 END
    WHEN (f.st = 0 OR f.st = -1) AND n.z < -1.5 THEN CASE WHEN n.d > 1.8 THEN 1 ELSE 0 END ELSE f.st END
  FROM fd f JOIN di n ON n.pair = f.pair AND n.i = f.i + 1),
fm(pair, i, st) AS (SELECT pair, i, 0 FROM di WHERE i = 1 UNION ALL
  SELECT n.pair, n.i, CASE WHEN n.d IS NULL THEN 0 WHEN f.st = 1 AND n.d < 0.8 THEN 0 WHEN f.st = 0 AND n.d > 2.0 THEN 1 ELSE f.st END FROM fm f JOIN di n ON n.pair = f.pair AND n.i = f.i + 1),
al AS (SELECT 'zscore' AS method, * FROM fz UNION ALL SELECT 'zscore_mahalanobis', * FROM fd UNION ALL SELECT 'mahalanobis', * FROM fm),
tg AS (SELECT method, n.*, CASE WHEN st = 0 THEN 0.0 WHEN method = 'mahalanobis' THEN -pa / (abs(pa) + abs(pb)) ELSE -st * beta / (abs(beta) + 1) END::DOUBLE AS a,
    CASE WHEN st = 0 THEN 0.0 WHEN method = 'mahalanobis' THEN -pb / (abs(pa) + abs(pb)) ELSE st / (abs(beta) + 1) END::DOUBLE AS b,
    coalesce(xa - lag(xa) OVER (PARTITION BY method, n.pair ORDER BY n.i), 0) AS ra, coalesce(xb - lag(xb) OVER (PARTITION BY method, n.pair ORDER BY n.i), 0) AS rb, count(*) OVER (PARTITION BY method, n.pair) AS total
  FROM al JOIN di n ON n.pair = al.pair AND n.i = al.i),
ps AS (SELECT *, coalesce(lag(a) OVER w, 0.0) AS qa, coalesce(lag(b) OVER w, 0.0) AS qb FROM tg WINDOW w AS (PARTITION BY method, pair ORDER BY i)),
tu AS (SELECT *, abs(qa - coalesce(lag(qa) OVER w, 0.0)) + abs(qb - coalesce(lag(qb) OVER w, 0.0)) AS turnover FROM ps WINDOW w AS (PARTITION BY method, pair ORDER BY i)),
ne AS (SELECT method, pair, ts, i, turnover, exp(qa * ra + qb * rb) - 1 - turnover * 1e-4 AS net, abs(qa) + abs(qb) > 0 AS active FROM tu WHERE i > floor(total * 0.6)
  AND pair IN (SELECT pair FROM (SELECT pair, count(*) AS n, abs(covar_samp(xa, xb) FILTER (i <= floor(m * 0.6)) / (stddev_samp(xa) FILTER (i <= floor(m * 0.6)) * stddev_samp(xb) FILTER (i <= floor(m * 0.6)))) AS c
                                  FROM (SELECT *, count(*) OVER (PARTITION BY pair) AS m FROM di) GROUP BY pair) WHERE n >= 100 AND c >= 0.02)),
eq AS (SELECT *, product(1 + net) OVER (PARTITION BY method, pair ORDER BY i ROWS UNBOUNDED PRECEDING) AS e FROM ne),
dr AS (SELECT *, e / max(e) OVER (PARTITION BY method, pair ORDER BY i ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM eq)"""


def _experiment(spark, sf_dir):
    methods = {"zscore": pairs.Rules(1.5, 0.5), "zscore_mahalanobis": pairs.Rules(1.5, 0.5, confirm=1.8), "mahalanobis": pairs.Rules(2.0, 0.8)}
    return pairs.experiment(_pair_frames(spark, sf_dir), 30, methods, 1.0, 252, 0.6, 100, 0.02, 1e-4)


@query("o201_pairs_experiment", f"""WITH RECURSIVE {RUNS} SELECT method, pair, count(*) AS n, round(arg_max(e, i) - 1, 4) AS total_return, round(min(dd), 4) AS max_drawdown, round(avg(active::INT), 6) AS active_share, round(sum(turnover), 3) AS turnover, count(*) FILTER (turnover > 0) AS trades FROM dr GROUP BY 1, 2""")
def o201(spark, sf_dir):
    m = _experiment(spark, sf_dir)[1]
    return m.select("method", "pair", "n", F.round("total_return", 4).alias("total_return"), F.round("max_drawdown", 4).alias("max_drawdown"), *r6("active_share"), F.round("turnover", 3).alias("turnover"), "trades")


@query("o066_method_portfolio", f"WITH RECURSIVE {RUNS} SELECT method, ts, round(avg(net), 7) AS net, CAST(sum(active::INT) AS BIGINT) AS active_pairs, count(DISTINCT pair) AS pairs, round(avg(turnover), 4) AS turnover FROM ne GROUP BY 1, 2")
def o066m(spark, sf_dir):
    return _experiment(spark, sf_dir)[2].select("method", "ts", F.round("net", 7).alias("net"), "active_pairs", "pairs", F.round("turnover", 4).alias("turnover"))


@query("o062_compound_metrics", _sql(BT, """SELECT symbol, count(*) AS n, round(product(1 + net) - 1, 6) AS total_return, round(pow(1 + avg(net), 12) - 1, 6) AS annual_return, round(stddev_samp(net) * sqrt(12), 6) AS volatility, round(min(drawdown), 6) AS max_drawdown,
  round(avg(CASE WHEN position > 0 THEN 1.0 ELSE 0.0 END), 6) AS active_share, round(sum(turnover), 6) AS turnover, count(*) FILTER (turnover > 0) AS trades FROM ran GROUP BY symbol"""))
def o062(spark, sf_dir):
    ran = _ran(spark, sf_dir).withColumn("active", F.col("position") > 0)
    return pairs.compound_metrics(ran, ["symbol"], "ts", "net", "active", "turnover", 12).select("symbol", "n", *r6("total_return", "annual_return", "volatility", "max_drawdown", "active_share", "turnover"), "trades")


WEIGHTS = HOURLY_RET + """,
z AS (SELECT *, ln(close) - avg(ln(close)) OVER (PARTITION BY hour) AS e FROM hr),
we AS (SELECT root, hour, ret, coalesce(-e / nullif(sum(abs(e)) OVER (PARTITION BY hour), 0), 0) AS weight FROM z),
co AS (SELECT *, lag(weight) OVER w AS was, coalesce(lag(weight) OVER w, 0) AS held, CASE root WHEN 'click' THEN 0.5 WHEN 'signup' THEN 2.0 ELSE 1.0 END::DOUBLE AS bps FROM we WINDOW w AS (PARTITION BY root ORDER BY hour)),
bt AS (SELECT hour, sum(held * ret) AS gross, sum(abs(weight - coalesce(was, 0))) AS turnover, sum(abs(weight - coalesce(was, 0)) * bps / 1e4) AS cost FROM co GROUP BY hour)"""


def _weights(spark, sf_dir):
    p = residuals.residual(_hourly_ret(spark, sf_dir).withColumn("x", F.log("close")), "hour", "x")
    size = F.sum(F.abs("residual")).over(Window.partitionBy("hour"))
    p = p.withColumn("weight", F.coalesce(div(-F.col("residual"), F.nullif(size, F.lit(0.0))), F.lit(0.0)))
    return residuals.position_backtest(p, "hour", "ret", {"click": 0.5, "signup": 2.0}, 1.0)


@query("o15j_position_backtest", _sql(WEIGHTS, "SELECT hour, round(gross, 6) AS gross, round(turnover, 4) AS turnover, round(cost, 8) AS cost, round(gross - cost, 6) AS net FROM bt"))
def o15j(spark, sf_dir):
    return _weights(spark, sf_dir).select("hour", *r6("gross"), F.round("turnover", 4).alias("turnover"), F.round("cost", 8).alias("cost"), *r6("net"))


@query("o18a_cost_variants", _sql(WEIGHTS, "SELECT m AS multiplier, count(*) AS n, round(sum(gross - cost * m), 6) AS net FROM bt, (VALUES (0.0::DOUBLE), (1.0::DOUBLE), (2.0::DOUBLE)) v(m) GROUP BY 1"))
def o18a(spark, sf_dir):
    return residuals.cost_variants(_weights(spark, sf_dir), [0.0, 1.0, 2.0]).groupBy("multiplier").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("net"), 6).alias("net"))


@query("o183_train_slope", _sql(IC, "SELECT root, count(*) AS n, round(regr_slope(y, x), 8) AS slope FROM b WHERE hour < TIMESTAMP '2024-01-20' GROUP BY root HAVING count(*) >= 5"))
def o183(spark, sf_dir):
    train = _forward(spark, sf_dir).where(F.col("hour") < F.lit("2024-01-20").cast("timestamp_ntz"))
    return stats.regression(train, ["root"], "y", "x").where("n >= 5").select("root", "n", F.round("slope", 8).alias("slope"))


@query("o184_key_q_values", """WITH p AS (SELECT c_custkey, (c_custkey * 7919 % 10007 + 1) / 10008.0::DOUBLE AS p FROM customer),
r AS (SELECT *, row_number() OVER (ORDER BY p, c_custkey) AS i, count(*) OVER () AS n FROM p)
SELECT c_custkey, round(least(1, min(p * n / i) OVER (ORDER BY p DESC, c_custkey DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), 9) AS q FROM r""")
def o184k(spark, sf_dir):
    c = s.table(spark, sf_dir, "customer").select("c_custkey", ((F.col("c_custkey") * 7919 % 10007 + 1) / F.lit(10008.0)).alias("p"))
    return stats.benjamini_hochberg(c, "p", parts=64).select("c_custkey", F.round("q", 9).alias("q"))


@query("o189_entry_masks", _sql(HOURLY_RET + """,
q AS (SELECT root, quantile_cont(abs(ret), 0.9) AS q FROM hr GROUP BY root)""", "SELECT h.root, hour, coalesce(abs(ret) >= q, false) AS entry FROM hr h JOIN q ON q.root = h.root"))
def o189(spark, sf_dir):
    h = _hourly_ret(spark, sf_dir).withColumn("move", F.abs("ret"))
    return anomaly.entry_masks(h, ["root"], "move", 0.9).select("root", "hour", "entry")


FEATURES = SHARE + """,
fe AS (SELECT h.root, h.hour, sh.share, sh.share - lag(sh.share) OVER w AS velocity, h.signed / sum(h.notional) OVER (PARTITION BY h.hour) AS flow FROM hourly h JOIN sh ON sh.root = h.root AND sh.hour = h.hour WINDOW w AS (PARTITION BY h.root ORDER BY h.hour))"""


def _features(spark, sf_dir):
    return flow.features(s.hourly(spark, sf_dir), "hour", "notional", "signed", 20, 10)


@query("o166_flow_features", _sql(FEATURES, "SELECT root, hour, " + ", ".join(f"round({c}, 6) AS {c}, round(CASE WHEN count({c}) OVER w >= 10 THEN ({c} - avg({c}) OVER w) / nullif(stddev_samp({c}) OVER w, 0) END, 3) AS {c}_z" for c in ("share", "velocity", "flow")) + " FROM fe WINDOW w AS (PARTITION BY root ORDER BY hour ROWS 19 PRECEDING)"))
def o166(spark, sf_dir):
    f = _features(spark, sf_dir)
    return f.select("root", "hour", *r6("share", "velocity", "flow"), *[F.round(f"{c}_z", 3).alias(f"{c}_z") for c in ("share", "velocity", "flow")])


@query("o217_feature_coefficients", _sql(FEATURES + """,
y AS (SELECT root, hour, CASE WHEN count(*) OVER w = 3 THEN sum(ln(close)) OVER w END AS y FROM hourly WINDOW w AS (PARTITION BY root ORDER BY hour ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING)),
lo AS (SELECT root, hour, 'share' AS feature, share AS x FROM fe UNION ALL SELECT root, hour, 'velocity', velocity FROM fe UNION ALL SELECT root, hour, 'flow', flow FROM fe),
b AS (SELECT lo.root, feature, x, y FROM lo JOIN y ON y.root = lo.root AND y.hour = lo.hour WHERE x IS NOT NULL AND y IS NOT NULL),
rk AS (SELECT root, feature, rank() OVER (PARTITION BY root, feature ORDER BY x) + (count(*) OVER (PARTITION BY root, feature, x) - 1) / 2.0::DOUBLE AS rx, rank() OVER (PARTITION BY root, feature ORDER BY y) + (count(*) OVER (PARTITION BY root, feature, y) - 1) / 2.0::DOUBLE AS ry FROM b)""",
    "SELECT root, feature, count(*) AS n, CASE WHEN count(*) >= 30 THEN round(covar_samp(rx, ry) / nullif(stddev_samp(rx) * stddev_samp(ry), 0), 6) END AS ic FROM rk GROUP BY 1, 2"))
def o217(spark, sf_dir):
    y = _forward(spark, sf_dir).select("root", "hour", "y")
    long_ = _features(spark, sf_dir).unpivot(["root", "hour"], ["share", "velocity", "flow"], "feature", "x").join(y, ["root", "hour"])
    return stats.information_coefficient(long_, ["root", "feature"], "x", "y").select("root", "feature", "n", *r6("ic"))


@query("o222_pooled_metrics", _sql(FEATURES, """SELECT feature, count(x) AS n, round(avg(x), 8) AS mean, round(stddev_samp(x), 8) AS sd
FROM (SELECT 'share' AS feature, share AS x FROM fe UNION ALL SELECT 'velocity', velocity FROM fe UNION ALL SELECT 'flow', flow FROM fe) GROUP BY feature"""))
def o222(spark, sf_dir):
    long_ = _features(spark, sf_dir).unpivot(["root", "hour"], ["share", "velocity", "flow"], "feature", "x")
    return long_.groupBy("feature").agg(F.count("x").alias("n"), F.round(F.avg("x"), 8).alias("mean"), F.round(F.stddev_samp("x"), 8).alias("sd"))


@query("o171_anomaly_frame")
def o171(spark, sf_dir):
    w, roots = _wide(spark, sf_dir)
    return anomaly.anomaly_frame(w, ["universe"], "hour", roots, 100, 30, 50).drop("universe")


@query("o15m_ewma_residuals")
def o15m(spark, sf_dir):
    w, roots = _wide(spark, sf_dir)
    return anomaly.ewma_residual(w, ["universe"], "hour", roots, 50, 30)


@query("o202_flow_research", _sql(FEATURES + """,
q AS (SELECT root, quantile_cont(abs(flow), 0.9) AS q FROM fe GROUP BY root), r AS (SELECT root, hour, lead(ln(close)) OVER (PARTITION BY root ORDER BY hour) - ln(close) AS y FROM hourly),
j AS (SELECT fe.root, abs(flow) >= q AS hot, y FROM fe JOIN q ON q.root = fe.root JOIN r ON r.root = fe.root AND r.hour = fe.hour)""", "SELECT root, count(y) FILTER (hot) AS n, round(avg(y) FILTER (hot) * 1e4, 4) AS mean_bps, round(avg(y) FILTER (NOT hot) * 1e4, 4) AS base_bps FROM j GROUP BY root HAVING count(y) FILTER (hot) > 0"))
def o202(spark, sf_dir):
    from fluxbar.plans import experiments

    return experiments.flow_research(s.hourly(spark, sf_dir), roots_of(spark, sf_dir), "hour", 20, 10, 0.9, 1)["study"].select("root", "n", *[F.round(c, 4).alias(c) for c in ("mean_bps", "base_bps")])


@query("o220_price_range", "SELECT event_type AS root, min(value) FILTER (value > 0) AS least, max(value) FILTER (value > 0) AS most, count(*) FILTER (value <= 0) AS not_positive FROM events GROUP BY 1")
def o220(spark, sf_dir):
    v = F.col("value")
    return s.table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("root")).agg(F.min(F.when(v > 0, v)).alias("least"), F.max(F.when(v > 0, v)).alias("most"), F.count_if(v <= 0).alias("not_positive"))


@query("o126_preview", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def o126(spark, sf_dir):
    return s.table(spark, sf_dir, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20).select("o_orderkey", "o_totalprice")


@query("o182_event_summary", _sql(s.HOURLY_SQL + """,
p AS (SELECT root, volume, ln(close) AS lp, row_number() OVER (PARTITION BY root ORDER BY hour) AS pos FROM hourly),
e AS (SELECT root, pos, lp FROM p WHERE volume >= 12)""", "SELECT CAST(v.pos - e.pos AS INT) AS rel, count(*) AS n, round(avg(v.lp - e.lp), 6) AS mean, round(median(v.lp - e.lp), 6) AS median FROM e JOIN p v ON v.root = e.root AND v.pos BETWEEN e.pos - 3 AND e.pos + 5 GROUP BY 1"))
def o182(spark, sf_dir):
    from fluxbar.operators import joins

    p = s.hourly(spark, sf_dir).withColumn("lp", F.log("close")).withColumn("pos", F.row_number().over(series("root", order="hour")))
    b = joins.band(p.where("volume >= 12").select("root", "pos", F.col("lp").alias("lp0")), p, ["root"], "pos", 3, 5, ["lp"])
    move = F.col("lp") - F.col("lp0")
    return b.groupBy("rel").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(move), 6).alias("mean"), F.round(F.median(move), 6).alias("median"))


@query("o147_json_fields", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def o147(spark, sf_dir):
    return s.table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("o185_day_bootstrap")
def o185(spark, sf_dir):
    daily = _hourly_ret(spark, sf_dir).groupBy(F.to_date("hour").alias("day")).agg(F.sum("ret").alias("ret")).orderBy("day")
    found = stats.day_bootstrap(daily, "ret", 500)
    return spark.createDataFrame([tuple(found.values())], ", ".join(f"{k} double" for k in found))


@query("o208_trend_with_flow", _sql(HOURLY_RET + """,
t AS (SELECT root, hour, ret, signed, CASE WHEN count(ret) OVER w = 6 THEN sum(ret) OVER w END AS trend FROM hr WINDOW w AS (PARTITION BY root ORDER BY hour ROWS 5 PRECEDING)),
p AS (SELECT *, CASE WHEN trend > 0 AND signed > 0 THEN 1.0 WHEN trend < 0 AND signed < 0 THEN -1.0 ELSE 0.0 END::DOUBLE AS side FROM t),
h AS (SELECT *, coalesce(lag(side) OVER (PARTITION BY root ORDER BY hour), 0.0) AS held FROM p)""", "SELECT root, count(*) FILTER (held <> 0) AS active, round(sum(held * ret), 6) AS gross FROM h GROUP BY root"))
def o208(spark, sf_dir):
    w = series("root", order="hour")
    t = _hourly_ret(spark, sf_dir).withColumn("trend", windows.rolling_sum("ret", w, 6))
    side = F.when((F.col("trend") > 0) & (F.col("signed") > 0), 1.0).when((F.col("trend") < 0) & (F.col("signed") < 0), -1.0).otherwise(0.0)
    h = t.withColumn("side", side).withColumn("held", F.coalesce(F.lag("side").over(w), F.lit(0.0)))
    return h.groupBy("root").agg(F.count_if(F.col("held") != 0).alias("active"), F.round(F.sum(F.col("held") * F.col("ret")), 6).alias("gross"))
