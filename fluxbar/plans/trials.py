
from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from fluxbar import sources as s
from fluxbar.catalog import query
from fluxbar.functions import div, series
from fluxbar.operators import bars, flow, geometry, panels, stats, trials
from fluxbar.plans import experiments
from fluxbar.plans.market import CONTRACTS, DOLLAR, IC, SHARE, VARIANCE, _forward, _daily_contracts, _sql, _variance_bars, r6, roots_of
from fluxbar.plans.research import HOURLY_RET, _hourly_ret

#: The columns of trials.summary(), rounded, from rows r with gross, cost, net and the running fall dd.
SUMMED = """count(*) AS n, round(sum(gross), 6) AS gross, round(sum(cost), 6) AS cost, round(sum(net), 6) AS net, round(avg(net) * 1e4, 4) AS mean_bps,
  round(coalesce(avg(net) / nullif(stddev_samp(net), 0), 0) * sqrt(count(*)), 4) AS t, round(avg(CASE WHEN net > 0 THEN 1.0 ELSE 0.0 END), 6) AS hit_rate, round(min(dd), 6) AS drawdown"""


def _falls(keys: str, order: str, rows: str = "r") -> str:
    by = f"PARTITION BY {keys} " if keys else ""
    return f"""n0 AS (SELECT *, gross - cost AS net FROM {rows}), n1 AS (SELECT *, sum(net) OVER ({by}ORDER BY {order} ROWS UNBOUNDED PRECEDING) AS cs FROM n0),
n2 AS (SELECT *, cs - max(cs) OVER ({by}ORDER BY {order} ROWS UNBOUNDED PRECEDING) AS dd FROM n1)"""


def _cut(column: str, of: str, share: float, by: str = "") -> str:
    """Days or times with train, as chronological_split() and split_days() have it."""
    part = f"PARTITION BY {by} " if by else ""
    keys = f"{by}, " if by else ""
    return f"(SELECT *, row_number() OVER ({part}ORDER BY {column}) <= least(greatest(floor(count(*) OVER ({part}) * {share}), 1), count(*) OVER ({part}) - 1) AS train FROM (SELECT DISTINCT {keys}{column} FROM {of}))"


def _summed(df):
    return [F.col("n"), *r6("gross", "cost", "net"), F.round("mean_bps", 4).alias("mean_bps"), F.round("t", 4).alias("t"), *r6("hit_rate", "drawdown")]


@query("o205_event_drift", _sql(s.HOURLY_SQL + f""",
a AS (SELECT root, hour, volume, lead(ln(close)) OVER w - ln(close) AS seen, lead(ln(close), 4) OVER w - lead(ln(close)) OVER w AS later FROM hourly WINDOW w AS (PARTITION BY root ORDER BY hour)),
e AS (SELECT * FROM a WHERE volume >= 12 AND seen IS NOT NULL AND later IS NOT NULL), d AS {_cut("hour", "e", 0.6)},
f AS (SELECT root, count(*) FILTER (train) AS m, regr_slope(later, seen) FILTER (train) AS b FROM e JOIN d USING (hour) GROUP BY root),
q AS (SELECT e.root, e.hour, CASE WHEN m >= 5 THEN coalesce(sign(b), 0) ELSE 0 END * sign(seen) AS p, later FROM e JOIN d USING (hour) JOIN f ON f.root = e.root WHERE NOT train),
o AS (SELECT root, hour, p * later AS gross, abs(p) * 0.0002 AS cost FROM q),
r AS (SELECT * FROM o UNION ALL SELECT 'all', hour, avg(gross), avg(cost) FROM o GROUP BY hour),
{_falls("root", "hour")}""", f"SELECT root, {SUMMED} FROM n2 GROUP BY root"))
def o205(spark, sf_dir):
    w, lp = series("root", order="hour"), F.log("close")
    h = s.hourly(spark, sf_dir).withColumns({"seen": F.lead(lp).over(w) - lp, "later": F.lead(lp, 4).over(w) - F.lead(lp).over(w)})
    rows = trials.event_drift(h.where("volume >= 12").select("root", "hour", "seen", "later"), "hour", 0.6, 2.0).select("root", "hour", "gross", "cost")
    pooled = rows.groupBy("hour").agg(F.avg("gross").alias("gross"), F.avg("cost").alias("cost")).withColumn("root", F.lit("all"))
    got = trials.summary(rows.unionByName(pooled), ["root"], ["hour"], 252)
    return got.select("root", *_summed(got))


@query("o206_impact_decay", _sql(HOURLY_RET + f""",
b AS (SELECT root, hour, CAST(hour AS DATE) AS day, signed / notional AS x, ret, lead(ret) OVER (PARTITION BY root ORDER BY hour) AS nx FROM hr), d AS {_cut("day", "b", 0.6, "root")},
s AS (SELECT b.*, train FROM b JOIN d ON d.root = b.root AND d.day = b.day),
l AS (SELECT root, quantile_cont(abs(x), 0.7) AS ql, quantile_cont(abs(ret), 0.7) AS qr FROM s WHERE train GROUP BY root),
h AS (SELECT s.* FROM s JOIN l ON l.root = s.root WHERE abs(x) >= ql AND abs(ret) >= qr AND sign(x) = sign(ret) AND nx IS NOT NULL),
g AS (SELECT root, avg(sign(ret) * nx) AS m FROM h WHERE train GROUP BY root),
r AS (SELECT h.root, h.hour, CASE WHEN m > 0 THEN 'continue' ELSE 'fade' END AS side, CASE WHEN m > 0 THEN 1.0 ELSE -1.0 END * sign(ret) * nx AS gross, abs(sign(ret)) * 0.0001 AS cost FROM h LEFT JOIN g ON g.root = h.root WHERE NOT train),
{_falls("root, side", "hour")}""", f"SELECT root, side, {SUMMED} FROM n2 GROUP BY root, side"))
def o206(spark, sf_dir):
    h = _hourly_ret(spark, sf_dir).withColumn("day", F.to_date("hour")).withColumn("flow", div(F.col("signed"), F.col("notional")))
    rows = trials.impact_decay(h.select("root", "hour", "day", "flow", "ret"), "hour", "day", "flow", "ret", 0.7, 0.6, 1.0)
    got = trials.summary(rows, ["root", "side"], ["hour"], 252 * 20)
    return got.select("root", "side", *_summed(got))


#: A row for each hour and root; changes of the log price from the root's hour before, missing if either is.
GRID = s.HOURLY_SQL + """,
grid AS (SELECT g.hour, k.root, ln(h.close) AS lp FROM (SELECT DISTINCT hour FROM hourly) g CROSS JOIN (SELECT DISTINCT root FROM hourly) k LEFT JOIN hourly h ON h.hour = g.hour AND h.root = k.root),
cell AS (SELECT *, lp - lag(lp) OVER (PARTITION BY root ORDER BY hour) AS ret FROM grid)"""


def _scores(back: int, least: int, entry: float, dead: float, of: str = "cell", rest: str = "false", tail: str = "") -> str:
    return f"""gap{tail} AS (SELECT *, lp - avg(lp) OVER (PARTITION BY hour) AS e FROM {of}),
z{tail} AS (SELECT *, CASE WHEN count(e) OVER w >= {least} THEN (e - avg(e) OVER w) / nullif(stddev_samp(e) OVER w, 0) END AS z FROM gap{tail} WINDOW w AS (PARTITION BY root ORDER BY hour ROWS {back - 1} PRECEDING)),
sc{tail} AS (SELECT *, CASE WHEN {rest} OR z IS NULL OR abs(z) < {dead} THEN 0.0 ELSE -least(greatest(z, -{entry}), {entry}) / {entry} END::DOUBLE AS sc FROM z{tail}),
wt{tail} AS (SELECT *, coalesce(sc / nullif(sum(abs(sc)) OVER (PARTITION BY hour), 0), 0) AS wt FROM sc{tail}),
hd{tail} AS (SELECT *, coalesce(lead(ret) OVER o, 0) AS nx, abs(wt - coalesce(lag(wt) OVER o, wt)) AS tn FROM wt{tail} WINDOW o AS (PARTITION BY root ORDER BY hour))"""


def _grid(spark, sf_dir):
    h = s.hourly(spark, sf_dir).withColumn("lp", F.log("close"))
    full = trials.full_panel(h.select("root", "hour", "lp"), "hour", roots_of(spark, sf_dir), ["lp"])
    return full.withColumn("ret", F.col("lp") - F.lag("lp").over(series("root", order="hour")))


@query("o207_residual_basket_run", _sql(GRID + f""",
{_scores(30, 15, 2.0, 0.0)},
pf AS (SELECT hour, sum(wt * nx) AS gross, sum(tn) * 0.0001 AS cost FROM hd GROUP BY hour), d AS {_cut("hour", "pf", 0.6)},
r AS (SELECT 'all' AS root, pf.* FROM pf JOIN d USING (hour) WHERE NOT train),
{_falls("", "hour")}""", f"SELECT {SUMMED} FROM n2"))
def o207(spark, sf_dir):
    got = trials.summary(trials.residual_basket(_grid(spark, sf_dir), "hour", "lp", "ret", ["hour"], 30, 2.0, 1.0, 0.6), [], ["hour"], 252)
    return got.select(*_summed(got))


@query("o210_retest", _sql(GRID + """,
rl AS (SELECT *, date_part('hour', hour) = 0 AS rolled FROM cell),
rs AS (SELECT *, max(rolled::INT) OVER (PARTITION BY root ORDER BY hour ROWS 2 PRECEDING) = 1 AS rest FROM rl),
""" + ",\n".join(_scores(b, b // 2, 2.0, 0.5, "rs", "rest", str(b)) for b in (20, 40)) + """,
u AS (SELECT 20 AS lookback, hour, wt, nx, tn FROM hd20 UNION ALL SELECT 40, hour, wt, nx, tn FROM hd40),
p AS (SELECT lookback, hour, sum(wt * nx) AS gross, sum(tn) AS turnover, sum(abs(wt)) AS exposure FROM u GROUP BY 1, 2),
f AS (SELECT lookback, min(hour) AS began FROM p WHERE exposure > 0 GROUP BY 1),
v AS (SELECT p.lookback, c AS cost_bps, hour, gross, turnover, exposure, gross - turnover * c / 1e4 AS net FROM p JOIN f ON f.lookback = p.lookback AND hour >= began CROSS JOIN (VALUES (0.0::DOUBLE), (1.0::DOUBLE)) c(c)),
m AS (SELECT *, unnest(CASE WHEN hour < TIMESTAMP '2024-01-16' THEN ['full', 'early'] ELSE ['full', 'late'] END) AS segment FROM v)""",
    """SELECT lookback, cost_bps, segment, count(*) AS n, round(sum(gross), 6) AS gross, round(avg(turnover), 6) AS turnover, round(avg(exposure), 6) AS exposure, round(exp(sum(net)) - 1, 6) AS compounded, round(quantile_cont(turnover, 0.95), 6) AS turnover_q95 FROM m GROUP BY 1, 2, 3"""))
def o210(spark, sf_dir):
    g = _grid(spark, sf_dir).withColumn("rolled", F.hour("hour") == 0)
    rows = trials.retest(g, "hour", "lp", "rolled", [20, 40], 2.0, 0.5, 2, [0.0, 1.0]).withColumn("net", F.col("gross") - F.col("cost"))
    early = F.col("hour") < F.lit("2024-01-16").cast("timestamp_ntz")
    rows = rows.withColumn("segment", F.explode(F.when(early, F.array(F.lit("full"), F.lit("early"))).otherwise(F.array(F.lit("full"), F.lit("late")))))
    keys = ["lookback", "cost_bps", "segment"]
    rest = rows.groupBy(*keys).agg(F.sum("gross").alias("gross"), F.avg("turnover").alias("turnover"), F.avg("exposure").alias("exposure"), F.percentile("turnover", 0.95).alias("turnover_q95"))
    return stats.metric_block(rows, keys, "hour", "net").select(*keys, "n", "compounded").join(rest, keys).select(*keys, "n", *r6("gross", "turnover", "exposure", "compounded", "turnover_q95"))


@query("o209_carry_momentum", _sql(CONTRACTS + f""",
days AS (SELECT root, session AS day, arg_max(close, symbol) AS close FROM d GROUP BY 1, 2),
ca AS (SELECT root, session AS day, ln(front / second) AS carry FROM n WHERE i = 1 AND front > 0 AND second > 0),
g AS (SELECT t.day, k.root, ln(y.close) AS lp, ca.carry FROM (SELECT DISTINCT day FROM days) t CROSS JOIN (SELECT DISTINCT root FROM days) k LEFT JOIN days y ON y.day = t.day AND y.root = k.root LEFT JOIN ca ON ca.day = t.day AND ca.root = k.root),
mo AS (SELECT *, lp - lag(lp) OVER o AS ret, lp - lag(lp, 5) OVER o AS m FROM g WINDOW o AS (PARTITION BY root ORDER BY day)),
zs AS (SELECT *, (m - avg(m) OVER w) / nullif(stddev_samp(m) OVER w, 0) AS mz, (carry - avg(carry) OVER w) / nullif(stddev_samp(carry) OVER w, 0) AS cz FROM mo WINDOW w AS (PARTITION BY day)),
lo AS (SELECT 'carry' AS method, root, day, ret, coalesce(cz, 0) AS sc FROM zs UNION ALL SELECT 'momentum', root, day, ret, coalesce(mz, 0) FROM zs UNION ALL SELECT 'combined', root, day, ret, coalesce((mz + cz) / 2, 0) FROM zs),
wt AS (SELECT *, coalesce(sc / nullif(sum(abs(sc)) OVER (PARTITION BY method, day), 0), 0) AS wt FROM lo),
hd AS (SELECT *, coalesce(lead(ret) OVER o, 0) AS nx, abs(wt - coalesce(lag(wt) OVER o, wt)) AS tn FROM wt WINDOW o AS (PARTITION BY method, root ORDER BY day)),
pf AS (SELECT method, day, sum(wt * nx) AS gross, sum(tn) * 0.0002 AS cost FROM hd GROUP BY 1, 2), sp AS {_cut("day", "pf", 0.5)},
rr AS (SELECT pf.* FROM pf JOIN sp USING (day) WHERE NOT train),
{_falls("method", "day", "rr")}""", f"SELECT method, {SUMMED} FROM n2 GROUP BY method"))
def o209(spark, sf_dir):
    daily, carried = _daily_contracts(spark, sf_dir)
    closes = daily.groupBy("root", F.col("session").alias("day")).agg(F.log(F.max_by("close", "symbol")).alias("lp"))
    both = closes.join(carried.select("root", F.col("session").alias("day"), "carry"), ["root", "day"], "left")
    full = trials.full_panel(both, "day", roots_of(spark, sf_dir), ["lp", "carry"])
    full = full.withColumn("ret", F.col("lp") - F.lag("lp").over(series("root", order="day")))
    got = trials.summary(trials.carry_momentum(full, "day", "lp", "carry", "ret", 5, 2.0, 0.5), ["method"], ["day"], 252)
    return got.select("method", *_summed(got))


@query("o204_variance_clock", f"""WITH RECURSIVE {VARIANCE},
b AS (SELECT f.root, f.day, f.bar, min(r.hour) AS start, sum(r.ret) AS ret, sum(r.ret * r.ret) AS variance FROM fold f JOIN r ON r.root = f.root AND r.day = f.day AND r.i = f.i GROUP BY 1, 2, 3), d AS {_cut("day", "b", 0.6, "root")},
lo AS (SELECT b.root, 'ret' AS feature, start, b.day, ret, ret AS x, train FROM b JOIN d ON d.root = b.root AND d.day = b.day UNION ALL SELECT b.root, 'variance', start, b.day, ret, variance, train FROM b JOIN d ON d.root = b.root AND d.day = b.day),
nx AS (SELECT *, lead(ret) OVER w AS y, train AND coalesce(lead(train) OVER w, false) AS stays, lag(x) OVER w AS px FROM lo WINDOW w AS (PARTITION BY root, feature ORDER BY start)),
ft AS (SELECT root, feature, CASE WHEN count(*) >= 3 THEN coalesce(sign(regr_slope(y, x)), 0) ELSE 0 END AS side FROM nx WHERE stays GROUP BY 1, 2),
ps AS (SELECT nx.root, nx.feature, start, day, nx.ret, train, coalesce(side * CASE WHEN px IS NOT NULL THEN least(greatest(px, -0.05), 0.05) END, 0) AS p FROM nx LEFT JOIN ft ON ft.root = nx.root AND ft.feature = nx.feature),
tu AS (SELECT *, p * ret AS gross, abs(p - coalesce(lag(p) OVER (PARTITION BY root, feature ORDER BY start), 0)) * 0.00005 AS cost FROM ps),
rr AS (SELECT * FROM tu WHERE NOT train),
{_falls("root, feature", "start", "rr")}
SELECT root, feature, {SUMMED.replace(", 6) AS gross", ", 8) AS gross").replace(", 6) AS cost", ", 8) AS cost").replace(", 6) AS net", ", 8) AS net")}, round(coalesce(avg(net) / nullif(stddev_samp(net), 0), 0) * sqrt(count(*) / count(DISTINCT day)::DOUBLE * 252), 4) AS sharpe FROM n2 GROUP BY 1, 2""")
def o204(spark, sf_dir):
    b = _variance_bars(spark, sf_dir).select("root", "day", "start", "ret", "variance")
    rows = trials.clocked_features(b, "start", "day", "ret", ["ret", "variance"], 0.05, 0.6, 0.5)
    got = trials.summary(rows, ["root", "feature"], ["start"], F.count(F.lit(1)) / F.countDistinct("day") * 252)
    small = [F.round(c, 8).alias(c) for c in ("gross", "cost", "net")]
    return got.select("root", "feature", "n", *small, F.round("mean_bps", 4).alias("mean_bps"), F.round("t", 4).alias("t"), *r6("hit_rate", "drawdown"), F.round("sharpe", 4).alias("sharpe"))


@query("o152_bar_details", f"""WITH RECURSIVE {DOLLAR},
q AS (SELECT root, quantile_cont(notional, 0.5) AS q50, quantile_cont(notional, 0.9) AS q90, quantile_cont(notional, 0.99) AS q99 FROM trades GROUP BY root),
b AS (SELECT f.bar AS bar_id, q.* FROM fold f JOIN seqd q USING (i)),
k AS (SELECT b.bar_id, b.root, arg_max(price, (ts, seq)) AS p, sum(notional) AS v, sum(notional) FILTER (notional <= q50) AS small, sum(notional) FILTER (notional > q90 AND notional <= q99) AS big, sum(notional) FILTER (notional > q99) AS huge FROM b JOIN q ON q.root = b.root GROUP BY 1, 2),
g AS (SELECT i.bar_id, r.root, p, v, small, big, huge FROM (SELECT DISTINCT bar_id FROM k) i CROSS JOIN (SELECT root FROM q) r LEFT JOIN k ON k.bar_id = i.bar_id AND k.root = r.root)
SELECT bar_id, root, last_value(p IGNORE NULLS) OVER (PARTITION BY root ORDER BY bar_id ROWS UNBOUNDED PRECEDING) AS last_price, round(coalesce(small, 0) / v, 6) AS small, round(coalesce(big, 0) / v, 6) AS large, round(coalesce(huge, 0) / v, 6) AS very_large FROM g""")
def o152(spark, sf_dir):
    t = flow.size_buckets(s.trades(spark, sf_dir))
    assigned = bars.assign_bars(t, bars.value_boundaries(t, 30000, ["ts", "seq"]), ["ts", "seq"])
    return bars.bar_details(assigned, roots_of(spark, sf_dir), ["ts", "seq"], ["small", "large", "very_large"]).select("bar_id", "root", "last_price", *r6("small", "large", "very_large"))


@query("o194_geometry_suite")
def o194(spark, sf_dir):
    """A sample of at most 1,000 hours' shares, which is the operator's feature."""
    roots = roots_of(spark, sf_dir)
    wide = panels.wide(flow.shares(s.hourly(spark, sf_dir), "hour", "notional"), "hour", roots, "share").fillna(0.0, roots)
    return geometry.suite(wide, ["hour"], roots, 1000)[0]


@query("o216_research_summary", _sql(IC + SHARE.removeprefix(s.HOURLY_SQL), """SELECT 'mean_share' AS part, root AS name, round(avg(share), 6) AS value FROM sh GROUP BY root
UNION ALL SELECT 'largest', root, round(count(*) / sum(count(*)) OVER (), 6) FROM (SELECT hour, first(root ORDER BY share DESC, root) AS root FROM sh GROUP BY hour) GROUP BY root
UNION ALL SELECT 'kind', kind, count(*)::DOUBLE FROM (SELECT CASE WHEN regr_slope(y, x) > 0 THEN 'momentum' WHEN regr_slope(y, x) < 0 THEN 'mean_reversion' END AS kind FROM b GROUP BY root) WHERE kind IS NOT NULL GROUP BY kind"""))
def o216(spark, sf_dir):
    fits = stats.regression(_forward(spark, sf_dir), ["root"], "y", "x")
    return experiments.research_summary(s.hourly(spark, sf_dir), "hour", "notional", fits).select("part", "name", *r6("value"))


UNIVERSE = """c AS (SELECT c_name AS symbol, arg_max(o_totalprice, (o_orderdate, o_totalprice)) AS close FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1), h AS (SELECT c_name AS symbol, c_acctbal AS shares FROM customer WHERE c_acctbal > 0)"""


@query("o080_universe", _sql(UNIVERSE, "SELECT CAST(row_number() OVER (ORDER BY close * shares DESC, c.symbol) AS INT) AS rank, upper(c.symbol) AS symbol, round(close * shares, 2) AS market_cap FROM c JOIN h ON h.symbol = c.symbol ORDER BY close * shares DESC, c.symbol LIMIT 100"))
def o080u(spark, sf_dir):
    c = s.table(spark, sf_dir, "customer")
    closes = s.table(spark, sf_dir, "orders").join(c, F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_name").alias("symbol"), F.col("o_orderdate").alias("ts"), F.col("o_totalprice").alias("close"))
    shares = c.select(F.col("c_name").alias("symbol"), F.lit(0).alias("ts"), F.col("c_acctbal").alias("shares"))
    return experiments.universe(closes, shares, 100).select("rank", "symbol", F.round("market_cap", 2).alias("market_cap"))


@query("o203_filtered_strategy", f"""WITH RECURSIVE {DOLLAR},
b AS (SELECT f.bar AS bar_id, q.* FROM fold f JOIN seqd q USING (i)),
ga AS (SELECT bar_id, abs(sum(signed) / sum(notional)) <= 0.3 AS gate FROM b GROUP BY 1),
k AS (SELECT bar_id, root, arg_max(price, (ts, seq)) AS p FROM b GROUP BY 1, 2),
g AS (SELECT ga.bar_id, gate, r.root, p FROM ga CROSS JOIN (SELECT DISTINCT root FROM trades) r LEFT JOIN k ON k.bar_id = ga.bar_id AND k.root = r.root),
lp AS (SELECT bar_id, gate, root, ln(last_value(p IGNORE NULLS) OVER (PARTITION BY root ORDER BY bar_id ROWS UNBOUNDED PRECEDING)) AS x FROM g),
rs AS (SELECT *, x - lag(x) OVER (PARTITION BY root ORDER BY bar_id) AS ret, x - avg(x) OVER (PARTITION BY bar_id) AS e FROM lp),
z AS (SELECT *, CASE WHEN count(e) OVER w >= 20 THEN (e - avg(e) OVER w) / nullif(stddev_samp(e) OVER w, 0) END AS z, row_number() OVER (PARTITION BY root ORDER BY bar_id) AS i FROM rs WINDOW w AS (PARTITION BY root ORDER BY bar_id ROWS 19 PRECEDING)),
f2(root, i, p) AS (SELECT root, i, CASE WHEN z IS NOT NULL AND gate AND abs(z) >= 1.5 THEN -sign(z) ELSE 0.0 END::DOUBLE FROM z WHERE i = 1 UNION ALL
  SELECT z.root, z.i, CASE WHEN z.z IS NULL THEN 0.0 WHEN f2.p <> 0 AND NOT ((f2.p > 0 AND z.z >= -0.25) OR (f2.p < 0 AND z.z <= 0.25) OR abs(z.z) > 2.5) THEN f2.p WHEN z.gate AND abs(z.z) >= 1.5 THEN -sign(z.z) ELSE 0.0 END::DOUBLE FROM f2 JOIN z ON z.root = f2.root AND z.i = f2.i + 1),
n AS (SELECT z.root, z.bar_id, z.ret, CASE WHEN sum(abs(f2.p)) OVER w > 0 THEN f2.p - avg(f2.p) OVER w ELSE 0 END AS d FROM f2 JOIN z ON z.root = f2.root AND z.i = f2.i WINDOW w AS (PARTITION BY z.bar_id)),
wt AS (SELECT *, coalesce(d / nullif(sum(abs(d)) OVER (PARTITION BY bar_id), 0), 0) AS wt FROM n),
h AS (SELECT *, coalesce(lag(wt) OVER o, 0) AS held, abs(wt - coalesce(lag(wt) OVER o, 0)) AS tn FROM wt WINDOW o AS (PARTITION BY root ORDER BY bar_id)),
pf AS (SELECT bar_id, sum(held * coalesce(ret, 0)) AS gross, sum(tn) * 0.0001 AS cost FROM h GROUP BY 1)
SELECT m AS multiplier, count(*) AS bars, round(sum(gross), 6) AS gross, round(sum(gross - cost * m), 6) AS net FROM pf CROSS JOIN (VALUES (0.0::DOUBLE), (1.0::DOUBLE), (2.0::DOUBLE)) v(m) GROUP BY m""")
def o203(spark, sf_dir):
    t, roots = s.trades(spark, sf_dir).withColumn("bucket", F.lit("all")), roots_of(spark, sf_dir)
    assigned = bars.assign_bars(t, bars.value_boundaries(t, 30000, ["ts", "seq"]), ["ts", "seq"])
    prices = bars.bar_details(assigned, roots, ["ts", "seq"], [], ["notional", "signed"])
    bar = Window.partitionBy("bar_id")
    prices = prices.withColumn("calm", F.abs(div(F.sum("signed").over(bar), F.sum("notional").over(bar))) <= 0.3)
    got = trials.gated_convergence(prices, "bar_id", "last_price", "calm", 20, 1.5, 0.25, 2.5, 1.0, [0.0, 1.0, 2.0])
    return got.groupBy("multiplier").agg(F.count(F.lit(1)).alias("bars"), *[F.round(F.sum(c), 6).alias(c) for c in ("gross", "net")])
