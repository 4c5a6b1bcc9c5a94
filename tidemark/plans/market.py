"""Queries over candles, signals and positions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import market as M
from ..operators import market as K
from ..sources.tables import CANDLES_SQL, SIGNALS_SQL, candles, load, signals
from .registry import query


def _rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c, t in df.dtypes if t == "double"})


_W = "PARTITION BY symbol ORDER BY ts"
_SMA = f"""c AS ({CANDLES_SQL}), m AS (SELECT *, CASE WHEN count(*) OVER f = 10 THEN avg(close) OVER f END AS fa, CASE WHEN count(*) OVER s = 30 THEN avg(close) OVER s END AS sa FROM c
  WINDOW f AS ({_W} ROWS 9 PRECEDING), s AS ({_W} ROWS 29 PRECEDING)),
  p AS (SELECT symbol, ts, close, coalesce(lag(CASE WHEN fa > sa THEN 1 WHEN fa < sa THEN -1 ELSE 0 END) OVER ({_W}), 0)::DOUBLE AS position FROM m),
  r AS (SELECT *, coalesce(close / lag(close) OVER ({_W}) - 1, 0) AS returns FROM p),
  e AS (SELECT *, returns * position AS sr, exp(sum(ln(1 + returns * position)) OVER ({_W})) AS equity FROM r),
  x AS (SELECT *, equity / max(equity) OVER ({_W}) - 1 AS drawdown FROM e)"""


@query(f"SELECT symbol, ts, open, high, low, close, volume FROM ({CANDLES_SQL}) WHERE ts BETWEEN TIMESTAMP '1998-01-01' AND TIMESTAMP '1999-01-01'")
def candles_scan(spark: SparkSession, d: str) -> DataFrame:
    from datetime import datetime

    return candles(spark, d).where(F.col("ts").between(F.lit(datetime(1998, 1, 1)), F.lit(datetime(1999, 1, 1))))


@query(f"WITH {_SMA} SELECT symbol, ts, position, round(equity, 5) AS equity, round(drawdown, 5) AS drawdown FROM x")
def sma_backtest_curve(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(K.simulate(K.sma_signal(candles(spark, d))).select("symbol", "ts", "position", "equity", "drawdown"), 5)


@query(f"""WITH {_SMA}, y AS (SELECT *, coalesce(position <> lag(position) OVER ({_W}), false) AS ch FROM x)
  SELECT symbol, round(arg_max(equity, ts) - 1, 5) AS total_return, round(arg_max(equity, ts) ** (1 / greatest(date_diff('day', min(ts), max(ts)) / 365, 1 / 365)) - 1, 5) AS annualized_return,
  round(avg(sr) / (stddev_samp(sr) + 1e-9) * sqrt(252), 5) AS sharpe, round(min(drawdown), 5) AS max_drawdown, count(*) FILTER (ch) AS trades, round(stddev_samp(sr), 5) AS volatility FROM y GROUP BY 1""")
def backtest_summary(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(K.backtest_summary(K.simulate(K.sma_signal(candles(spark, d))), "symbol"), 5)


_TRADES = f"""{_SMA}, n AS (SELECT *, row_number() OVER ({_W}) AS k, coalesce(position <> lag(position) OVER ({_W}), false) AS ch FROM x),
  i AS (SELECT *, sum(ch::INT) OVER ({_W}) AS run FROM n),
  g AS (SELECT symbol, run, min(ts) AS entry_time, arg_min(close, ts) AS entry_price, any_value(position) AS position, arg_min(ch, k) AS new, min(k) AS first, max(ts) AS lt, arg_max(close, ts) AS lp, max(k) AS last FROM i GROUP BY 1, 2),
  t AS (SELECT *, coalesce(lead(entry_time) OVER v, lt) AS exit_time, coalesce(lead(entry_price) OVER v, lp) AS exit_price, coalesce(lead(first) OVER v, last) - first + 1 AS duration_bars FROM g WINDOW v AS (PARTITION BY symbol ORDER BY run)),
  z AS (SELECT *, (exit_price / entry_price - 1) * position AS ret FROM t WHERE new AND position <> 0 AND duration_bars >= 2)"""


@query(f"WITH {_TRADES} SELECT symbol, entry_time, exit_time, entry_price, exit_price, position, round(ret, 6) AS \"return\", duration_bars FROM z")
def trade_islands(spark: SparkSession, d: str) -> DataFrame:
    return K.trades(K.sma_signal(candles(spark, d))).withColumn("return", F.round("return", 6))


@query(f"""WITH {_TRADES} SELECT symbol, round(avg((ret > 0)::INT), 6) AS winrate, round(CASE WHEN abs(sum(ret) FILTER (ret < 0)) > 0 THEN coalesce(sum(ret) FILTER (ret > 0), 0) / abs(sum(ret) FILTER (ret < 0)) ELSE 0 END, 6) AS profit_factor,
  round(avg(ret), 6) AS avg_trade_return, count(*) AS n_trades FROM z GROUP BY 1""")
def trade_summary(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(K.trade_summary(K.trades(K.sma_signal(candles(spark, d))), "symbol"))


@query(f"WITH {_SMA}, b AS (SELECT symbol, round(arg_max(equity, ts) - 1, 5) AS total_return FROM x GROUP BY 1) SELECT symbol, total_return, row_number() OVER (ORDER BY total_return DESC, symbol) AS rank FROM b")
def strategy_leaderboard(spark: SparkSession, d: str) -> DataFrame:
    out = K.backtest_summary(K.simulate(K.sma_signal(candles(spark, d))), "symbol").select("symbol", F.round("total_return", 5).alias("total_return"))
    return K.leaderboard(out, "total_return", "symbol")


@query()
def parameter_search(spark: SparkSession, d: str) -> DataFrame:
    """Four rounds of six pairs of lengths; tests hold each trial against the grid."""
    from ..operators.tuning import search_lengths

    return search_lengths(candles(spark, d), range(3, 16), range(10, 61, 5), value="sharpe").withColumn("value", F.round("value", 6))


@query()
def parameter_grid(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(K.grid(candles(spark, d), [5, 10], [20, 40]))


@query(f"""WITH c AS ({CANDLES_SQL}), b AS (SELECT symbol, ts, close, CASE WHEN count(*) OVER w = 20 THEN avg(close) OVER w END AS basis, CASE WHEN count(*) OVER w = 20 THEN stddev_pop(close) OVER w END AS sd FROM c WINDOW w AS ({_W} ROWS 19 PRECEDING)),
  u AS (SELECT *, basis + 2 * sd AS upper, basis - 2 * sd AS lower FROM b WHERE basis IS NOT NULL),
  q AS (SELECT *, CASE WHEN close > upper THEN 3 WHEN close > basis + (upper - basis) / 2 THEN 2 WHEN close > basis THEN 1 WHEN close < lower THEN -3 WHEN close < basis - (basis - lower) / 2 THEN -2 WHEN close < basis THEN -1 ELSE 0 END AS rating FROM u)
  SELECT symbol, ts, round(basis + 1e-7, 4) AS basis, round(upper + 1e-7, 4) AS upper, round(lower + 1e-7, 4) AS lower, round((upper - lower) / basis, 6) AS bbw, rating, CASE rating WHEN 2 THEN 'BUY' WHEN -2 THEN 'SELL' ELSE 'NEUTRAL' END AS signal FROM q""")
def bollinger_rating(spark: SparkSession, d: str) -> DataFrame:
    df = K.bollinger(candles(spark, d)).where("basis is not null")
    rating = M.bollinger_rating(F.col("close"), F.col("upper"), F.col("basis"), F.col("lower"))
    out = df.select("symbol", "ts", "basis", "upper", "lower", M.bollinger_width(F.col("basis"), F.col("upper"), F.col("lower")).alias("bbw"), rating.alias("rating"))
    out = out.withColumn("signal", M.rating_signal(F.col("rating")))
    return out.withColumns({**{c: F.round(F.col(c) + 1e-7, 4) for c in ("basis", "upper", "lower")}, "bbw": F.round("bbw", 6)})


@query(f"""WITH c AS ({CANDLES_SQL}), b AS (SELECT symbol, ts, volume, count(*) OVER w AS n, avg(volume) OVER w AS m, stddev_pop(volume) OVER w AS sd FROM c WINDOW w AS ({_W} ROWS 29 PRECEDING))
  SELECT symbol, ts, round(CASE WHEN n = 30 AND sd <> 0 THEN (volume - m) / sd ELSE 0 END, 5) + 0.0 AS z FROM b""")
def volume_zscore(spark: SparkSession, d: str) -> DataFrame:
    return K.zscore(candles(spark, d), "volume").select("symbol", "ts", (F.round("z", 5) + 0.0).alias("z"))


@query(f"""WITH c AS ({CANDLES_SQL}), x AS (SELECT *, close - lag(close) OVER ({_W}) AS dl FROM c),
  y AS (SELECT symbol, ts, close, count(dl) OVER w AS n, avg(greatest(dl, 0)) FILTER (dl IS NOT NULL) OVER w AS g, avg(greatest(-dl, 0)) FILTER (dl IS NOT NULL) OVER w AS l, avg(abs(dl)) OVER w AS a FROM x WINDOW w AS ({_W} ROWS 13 PRECEDING))
  SELECT symbol, ts, round(CASE WHEN n < 14 THEN 50 WHEN l = 0 THEN 100 ELSE 100 - 100 / (1 + g / l) END, 5) AS rsi, round(CASE WHEN n < 14 THEN 20 ELSE least(50, a / close * 100) END, 5) AS strength FROM y""")
def rsi_simple_and_pseudo_adx(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(K.pseudo_adx(K.rsi_simple(candles(spark, d))).select("symbol", "ts", "rsi", "strength"), 5)


_DON = """WITH c AS ({c}), x AS (SELECT *, CASE WHEN count(*) OVER w = 50 THEN max(high) OVER w END AS top, CASE WHEN count(*) OVER w = 50 THEN min(low) OVER w END AS bottom,
  CASE WHEN count(*) OVER v = 20 THEN avg(volume) OVER v END AS va FROM c WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN {f}), v AS (PARTITION BY symbol ORDER BY ts ROWS 19 PRECEDING))
  SELECT symbol, ts, CASE WHEN close > top THEN 'long' ELSE 'short' END AS direction, top, bottom FROM x WHERE (close > top OR close < bottom) AND volume > va * 1.5"""


@query(_DON.format(c=CANDLES_SQL, f="50 PRECEDING AND 1 PRECEDING"))
def donchian_breakout(spark: SparkSession, d: str) -> DataFrame:
    return K.donchian(candles(spark, d)).where("direction is not null").select("symbol", "ts", "direction", "top", "bottom")


@query(_DON.format(c=CANDLES_SQL, f="49 PRECEDING AND CURRENT ROW"))
def donchian_breakout_parity(spark: SparkSession, d: str) -> DataFrame:
    return K.donchian(candles(spark, d), include_current=True).where("direction is not null").select("symbol", "ts", "direction", "top", "bottom")


@query(f"""WITH RECURSIVE c AS ({CANDLES_SQL}), o AS (SELECT *, row_number() OVER ({_W}) AS k, lag(close) OVER ({_W}) AS pc FROM c),
  t AS (SELECT *, greatest(high - low, coalesce(abs(high - pc), 0), coalesce(abs(low - pc), 0)) AS tr FROM o),
  r AS (SELECT symbol, k, ts, close AS ef, close AS es, tr AS atr, NULL::DOUBLE AS g, NULL::DOUBLE AS l FROM t WHERE k = 1
    UNION ALL SELECT t.symbol, t.k, t.ts, r.ef * (1 - 2.0::DOUBLE / 10) + t.close * 2.0::DOUBLE / 10, r.es * (1 - 2.0::DOUBLE / 22) + t.close * 2.0::DOUBLE / 22, r.atr * (1 - 1.0::DOUBLE / 14) + t.tr / 14,
      coalesce(r.g * (1 - 1.0::DOUBLE / 14) + greatest(t.close - t.pc, 0) / 14, greatest(t.close - t.pc, 0)), coalesce(r.l * (1 - 1.0::DOUBLE / 14) + greatest(t.pc - t.close, 0) / 14, greatest(t.pc - t.close, 0)) FROM r JOIN t ON t.symbol = r.symbol AND t.k = r.k + 1)
  SELECT symbol, ts, round(ef, 3) AS ema_fast, round(es, 3) AS ema_slow, round(atr, 3) AS atr, round(CASE WHEN l IS NULL OR l = 0 THEN 50 ELSE 100 - 100 / (1 + g / l) END, 4) AS rsi FROM r""")
def ewm_indicators(spark: SparkSession, d: str) -> DataFrame:
    out = K.smoothed(candles(spark, d))
    return out.select("symbol", "ts", F.round("ema_fast", 3).alias("ema_fast"), F.round("ema_slow", 3).alias("ema_slow"), F.round("atr", 3).alias("atr"), F.round("rsi", 4).alias("rsi"))


@query()
def adx(spark: SparkSession, d: str) -> DataFrame:
    return K.smoothed(candles(spark, d)).select("symbol", "ts", F.round("adx", 4).alias("adx"))


@query()
def momentum_scanner(spark: SparkSession, d: str) -> DataFrame:
    return K.momentum_signals(candles(spark, d)).select("symbol", "ts", "direction", "confidence", "risk.leverage", F.round("risk.stop_loss", 4).alias("stop_loss"), F.transform("risk.take_profit", lambda x: F.round(x, 4)).alias("take_profit"))


@query()
def mean_reversion_scanner(spark: SparkSession, d: str) -> DataFrame:
    return K.mean_reversion_signals(candles(spark, d), width=1.6, oversold=45, overbought=55).select("symbol", "ts", "direction", "confidence", F.round("rsi", 4).alias("rsi"))


@query()
def breakout_scanner(spark: SparkSession, d: str) -> DataFrame:
    return K.breakout_signals(candles(spark, d)).select("symbol", "ts", "direction", "confidence", F.round("breakout_level", 4).alias("breakout_level"))


@query(f"""WITH c AS ({CANDLES_SQL}), e AS (SELECT symbol, min(low) AS lo, max(high) AS hi FROM c GROUP BY 1), a AS (SELECT e.*, unnest(range(1, 50)) AS bin FROM e),
  h AS (SELECT symbol, least(CAST(floor((close - lo) / ((hi - lo) / 49)) AS BIGINT) + 1, 49) AS bin, sum(volume) AS v FROM c JOIN e USING (symbol) GROUP BY 1, 2),
  f AS (SELECT a.*, coalesce(v, 0) AS v FROM a LEFT JOIN h USING (symbol, bin)),
  s AS (SELECT *, sum(v) OVER (PARTITION BY symbol ORDER BY bin) / sum(v) OVER (PARTITION BY symbol) AS share, lo + (hi - lo) * (bin - 0.5::DOUBLE) / 49 AS mid FROM f),
  p AS (SELECT symbol, arg_min(mid, (-v, bin)) AS poc, max(mid) FILTER (share <= 0.15) AS l, min(mid) FILTER (share >= 0.85) AS h FROM s GROUP BY 1)
  SELECT symbol, round(poc, 4) AS poc, round(coalesce(l, poc), 4) AS value_area_low, round(coalesce(h, poc), 4) AS value_area_high FROM p""")
def volume_profile(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(K.volume_profile(candles(spark, d)), 4)


@query(f"""WITH c AS (SELECT *, CASE WHEN open = 0 THEN 0 ELSE (close - open) / open * 100 END >= 1 AS h FROM ({CANDLES_SQL}))
  SELECT symbol, ts, open, close FROM (SELECT *, sum(h::INT) OVER ({_W} ROWS 2 PRECEDING) AS n FROM c) WHERE n = 3""")
def consecutive_candles(spark: SparkSession, d: str) -> DataFrame:
    return K.consecutive(candles(spark, d), 3, 1.0).select("symbol", "ts", "open", "close")


_CH = f"SELECT symbol, ts, round(CASE WHEN open = 0 THEN 0 ELSE (close - open) / open * 100 END, 4) AS change FROM ({CANDLES_SQL})"


def _changes(spark: SparkSession, d: str) -> DataFrame:
    return candles(spark, d).select("symbol", "ts", F.round(M.percent_change(F.col("open"), F.col("close")), 4).alias("change"))


@query(f"SELECT * FROM ({_CH}) ORDER BY change DESC, symbol, ts LIMIT 25")
def top_gainers(spark: SparkSession, d: str) -> DataFrame:
    return K.top(_changes(spark, d), "change", 25, "symbol", "ts")


@query(f"SELECT * FROM ({_CH}) ORDER BY change, symbol, ts LIMIT 25")
def top_losers(spark: SparkSession, d: str) -> DataFrame:
    return K.top(_changes(spark, d), "change", 25, "symbol", "ts", ascending=True)


@query(f"""PIVOT (SELECT strftime(ts, '%Y') AS year, symbol, arg_min(open, ts) AS o, arg_max(close, ts) AS c FROM ({CANDLES_SQL}) GROUP BY 1, 2) ON year IN ('1996', '1997', '1998') USING round(first((c - o) / o * 100), 4) GROUP BY symbol""")
def multi_timeframe_changes(spark: SparkSession, d: str) -> DataFrame:
    yearly = candles(spark, d).groupBy("symbol", F.date_format("ts", "yyyy").alias("year")).agg(F.min_by("open", "ts").alias("o"), F.max_by("close", "ts").alias("c"))
    return yearly.groupBy("symbol").pivot("year", ["1996", "1997", "1998"]).agg(F.round(F.first(M.percent_change_or_null(F.col("o"), F.col("c"))), 4))


@query(f"""WITH c AS ({CANDLES_SQL}), b AS (SELECT *, (high - low) / open AS bbw FROM c)
  SELECT symbol, ts, round(bbw, 6) AS bbw FROM b WHERE bbw > 0 AND bbw < 0.2 ORDER BY bbw, symbol, ts LIMIT 100""")
def squeeze_scan(spark: SparkSession, d: str) -> DataFrame:
    rows = candles(spark, d).withColumn("bbw", (F.col("high") - F.col("low")) / F.col("open")).where("bbw > 0 and bbw < 0.2")
    return rows.orderBy("bbw", "symbol", "ts").limit(100).select("symbol", "ts", F.round("bbw", 6).alias("bbw"))


@query(f"""WITH c AS ({CANDLES_SQL}), l AS (SELECT symbol, ts, volume, CASE WHEN volume >= 6 AND close > open * 3 THEN 0 WHEN volume >= 4 AND close > open * 2 THEN 1 WHEN close > open THEN 2 END AS level FROM c)
  SELECT symbol, ts, volume, CAST(level AS INTEGER) AS level FROM l WHERE level = (SELECT min(level) FROM l)""")
def relaxed_thresholds(spark: SparkSession, d: str) -> DataFrame:
    up = lambda k: F.col("close") > F.col("open") * k
    return K.relaxed(candles(spark, d), [(F.col("volume") >= 6) & up(3), (F.col("volume") >= 4) & up(2), up(1)]).select("symbol", "ts", "volume", "level")


@query(f"""SELECT symbol, ts, round(CASE WHEN volume > 0 THEN log10(volume + 1) ELSE 0 END + greatest(0, (100 - abs(20 + volume * 10 - 50)) / 20) + greatest(0, (0.2 - (high - low) / open) * 10) + greatest(0, (close - open) / open * 100 / 5), 3) AS score FROM ({CANDLES_SQL})""")
def smart_scanner_score(spark: SparkSession, d: str) -> DataFrame:
    c = candles(spark, d)
    score = M.smart_score(F.col("volume"), F.lit(None).cast("double"), 20 + F.col("volume") * 10, (F.col("high") - F.col("low")) / F.col("open"), M.percent_change(F.col("open"), F.col("close")))
    return c.select("symbol", "ts", F.round(score, 3).alias("score"))


@query(f"""SELECT symbol, count(*) AS total_signals, count(*) FILTER (direction = 'long') AS long_signals, count(*) FILTER (direction <> 'long') AS short_signals,
  round(count(*) FILTER (direction = 'long') / count(*), 4) AS long_ratio, round(count(*) FILTER (direction <> 'long') / count(*), 4) AS short_ratio, round(avg(confidence), 2) AS avg_confidence,
  round(avg(leverage), 2) AS avg_leverage, round(avg(position_size), 2) AS avg_position_size, round(avg(abs(entry - stop_loss) / abs(entry) * 100), 2) AS avg_stop_loss_pct,
  round(sum((abs(take_profit[1] - entry) + abs(take_profit[2] - entry)) / abs(entry) * 100) / (2 * count(*)), 2) AS avg_take_profit_pct, CAST(1 AS BIGINT) AS symbols_covered, round(count(*)::DOUBLE, 2) AS signals_per_symbol_avg
  FROM ({SIGNALS_SQL}) WHERE direction IS NOT NULL GROUP BY 1""")
def signal_metrics(spark: SparkSession, d: str) -> DataFrame:
    return K.signal_metrics(signals(spark, d), "symbol")


@query(f"SELECT signal_id, symbol, confidence, leverage FROM ({SIGNALS_SQL}) WHERE direction IS NOT NULL AND confidence >= 55 AND leverage <= 20 AND stop_loss IS NOT NULL")
def signal_context_filter(spark: SparkSession, d: str) -> DataFrame:
    return signals(spark, d).where("direction is not null and confidence >= 55 and leverage <= 20 and stop_loss is not null").select("signal_id", "symbol", "confidence", "leverage")


@query(f"""WITH s AS (SELECT *, CASE WHEN direction = 'long' THEN 1 ELSE -1 END AS sg FROM ({SIGNALS_SQL}) WHERE direction IS NOT NULL)
  SELECT signal_id, round(entry * (1 + sg * 0.0015) + 1e-7, 4) AS effective, round(CASE WHEN abs(entry * (1 + sg * 0.0015) - stop_loss) <= 0 THEN 0 ELSE 10000 * 0.01 / abs(entry * (1 + sg * 0.0015) - stop_loss) END, 8) AS quantity,
  round(CASE WHEN (entry - stop_loss) * sg <= 0 OR (take_profit[1] - entry) * sg <= 0 THEN 0 ELSE (take_profit[1] - entry) / (entry - stop_loss) END, 8) + 0.0 AS rr FROM s""")
def position_sizing(spark: SparkSession, d: str) -> DataFrame:
    s = signals(spark, d).where("direction is not null")
    entry, stop, side, tp = F.col("entry"), F.col("stop_loss"), F.col("direction"), F.col("take_profit")[0]
    return s.select(
        "signal_id", F.round(M.effective_entry(entry, side, 0.001, 0.0005) + 1e-7, 4).alias("effective"),
        F.round(M.position_size(F.lit(10000.0), entry, stop, side, 1.0, 0.001, 0.0005), 8).alias("quantity"), (F.round(M.risk_reward(entry, tp, stop, side), 8) + 0.0).alias("rr"),
    )


@query(f"""WITH s AS (SELECT *, CASE WHEN direction = 'long' THEN 1 ELSE -1 END AS sg, entry * 0.01 AS atr, take_profit[1] AS tp FROM ({SIGNALS_SQL}) WHERE direction IS NOT NULL),
  q AS (SELECT *, CASE WHEN (entry - stop_loss) * sg <= 0 OR (tp - entry) * sg <= 0 THEN 0 ELSE (tp - entry) / (entry - stop_loss) END AS rr FROM s)
  SELECT signal_id, round(CASE WHEN rr < 1.5 AND atr > 0 THEN CASE WHEN sg = 1 THEN least(entry + 3 * atr, greatest(tp, entry + 1.5 * abs(entry - stop_loss))) ELSE greatest(entry - 3 * atr, least(tp, entry - 1.5 * abs(entry - stop_loss))) END ELSE tp END + 1e-7, 4) AS target FROM q""")
def min_risk_reward(spark: SparkSession, d: str) -> DataFrame:
    s = signals(spark, d).where("direction is not null")
    target = M.min_risk_reward_target(F.col("entry"), F.col("take_profit")[0], F.col("stop_loss"), F.col("entry") * 0.01, F.col("direction"), 1.5, 3.0)
    return s.select("signal_id", F.round(target + 1e-7, 4).alias("target"))


@query(f"""WITH a AS (SELECT symbol, direction, max(confidence) AS score, arg_max(entry, (confidence, signal_id)) AS entry, arg_max(stop_loss, (confidence, signal_id)) AS stop, arg_max(take_profit[1], (confidence, signal_id)) AS target FROM ({SIGNALS_SQL}) WHERE direction IS NOT NULL AND leverage < 3 AND symbol <= 'S18' GROUP BY 1, 2),
  b AS (SELECT symbol, direction, max(confidence) AS score, arg_max(entry, (confidence, signal_id)) AS entry, arg_max(stop_loss, (confidence, signal_id)) AS stop, arg_max(take_profit[2], (confidence, signal_id)) AS target FROM ({SIGNALS_SQL}) WHERE direction IS NOT NULL AND leverage >= 3 AND symbol >= 'S12' GROUP BY 1, 2),
  j AS (SELECT symbol, direction, a, b, coalesce(abs(a.target - a.entry) / nullif(abs(a.entry - a.stop), 0), -1) AS ra, coalesce(abs(b.target - b.entry) / nullif(abs(b.entry - b.stop), 0), -1) AS rb FROM a FULL JOIN b USING (symbol, direction)),
  k AS (SELECT symbol, direction, CASE WHEN b.score IS NULL THEN a.score WHEN a.score IS NULL THEN b.score ELSE greatest(a.score, b.score) END AS score, b.score IS NULL OR (a.score IS NOT NULL AND ra >= rb) AS fa, a.entry AS ae, a.stop AS az, a.target AS ag, b.entry AS be, b.stop AS bz, b.target AS bt FROM j)
  SELECT symbol, direction, score, round(CASE WHEN fa THEN ae ELSE be END, 4) AS entry, round(CASE WHEN fa THEN az ELSE bz END, 4) AS stop, round(CASE WHEN fa THEN ag ELSE bt END, 4) AS target FROM k""")
def strategy_merge(spark: SparkSession, d: str) -> DataFrame:
    s = signals(spark, d).where("direction is not null")

    def best(rows: DataFrame, k: int) -> DataFrame:
        order = F.struct("confidence", "signal_id")
        return rows.groupBy("symbol", "direction").agg(F.max("confidence").alias("score"), F.max_by("entry", order).alias("entry"), F.max_by("stop_loss", order).alias("stop"), F.max_by(F.col("take_profit")[k], order).alias("target"))

    return _rounded(K.merge_candidates(best(s.where("leverage < 3 and symbol <= 'S18'"), 0), best(s.where("leverage >= 3 and symbol >= 'S12'"), 1)), 4)


@query("""SELECT o_custkey, o_orderstatus AS asset, round(sum(o_totalprice), 2) AS notional, arg_max(o_orderkey, (abs(o_totalprice), o_orderkey)) AS largest, count(*) AS positions,
  CASE WHEN count(*) > 5 THEN 'high' WHEN count(*) > 3 THEN 'medium' ELSE 'low' END AS risk FROM orders GROUP BY 1, 2""")
def portfolio_risk(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "orders").groupBy("o_custkey", F.col("o_orderstatus").alias("asset")).agg(
        F.round(F.sum("o_totalprice"), 2).alias("notional"), F.max_by("o_orderkey", F.struct(F.abs("o_totalprice"), "o_orderkey")).alias("largest"), F.count("*").alias("positions"),
        F.when(F.count("*") > 5, "high").when(F.count("*") > 3, "medium").otherwise("low").alias("risk"),
    )


@query("""WITH RECURSIVE t AS (SELECT l_suppkey AS k, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber) AS n, l_returnflag <> 'R' AS buy, l_quantity AS q, l_extendedprice / l_quantity AS p FROM lineitem),
  f AS (SELECT k, 0 AS n, 0.0::DOUBLE AS q, 0.0::DOUBLE AS c FROM t GROUP BY k
    UNION ALL SELECT f.k, t.n, CASE WHEN buy THEN f.q + t.q ELSE f.q - least(t.q, f.q) END, CASE WHEN buy THEN f.c + t.q * p WHEN f.q > 0 THEN f.c - least(t.q, f.q) * f.c / f.q ELSE f.c END FROM f JOIN t ON t.k = f.k AND t.n = f.n + 1)
  SELECT k AS l_suppkey, round(arg_max(q, n), 4) AS remaining, round(arg_max(c, n), 1) AS cost FROM f GROUP BY k""")
def average_cost_inventory(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "lineitem").select("l_suppkey", "l_shipdate", "l_orderkey", "l_linenumber", F.when(F.col("l_returnflag") == "R", "SELL").otherwise("BUY").alias("side"), F.col("l_quantity").alias("qty"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"))
    out = K.average_cost(rows, "l_suppkey", "l_shipdate", "l_orderkey", "l_linenumber")
    return out.select("l_suppkey", F.round("remaining", 4).alias("remaining"), F.round("cost", 1).alias("cost"))
