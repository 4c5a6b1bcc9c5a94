"""Indicators, scanners and backtests on candles (symbol, ts, open, high, low, close, volume).

A series is a symbol's candles in order of time. Rolling columns are SQL windows and null until their window is full. Exponential
smoothing depends on all that came before, so those columns are computed a series at a time from Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions import market as M
from .ranks import ranked


def series(by: str = "symbol", ts: str = "ts") -> WindowSpec:
    return Window.partitionBy(by).orderBy(ts)


def rolling(f: Callable[[Column], Column], column: str, n: int, w: WindowSpec | None = None) -> Column:
    """f over the last n rows; null before there are n."""
    rows = (w or series()).rowsBetween(-(n - 1), 0)
    return F.when(F.count(F.lit(1)).over(rows) == n, f(F.col(column)).over(rows))


def sma_signal(df: DataFrame, fast: int = 10, slow: int = 30) -> DataFrame:
    """position: the sign of fast minus slow moving average of the bar before; 0 while either is missing."""
    fast = max(2, fast)
    slow = max(fast + 1, slow)
    crossed = F.signum(rolling(F.avg, "close", fast) - rolling(F.avg, "close", slow))
    df = df.withColumn("__tm_s", crossed)
    return df.withColumn("position", F.coalesce(F.lag("__tm_s").over(series()), F.lit(0.0))).drop("__tm_s")


def simulate(df: DataFrame) -> DataFrame:
    """Adds returns, strategy_returns, equity (running product) and drawdown to rows with close and position.

    The product is that of the signs times the exponential of a sum of logarithms; it is 0 from the first return of -100 % on.
    """
    w = series()
    df = df.withColumn("returns", F.coalesce(F.col("close") / F.lag("close").over(w) - 1, F.lit(0.0)))
    df = df.withColumn("strategy_returns", F.col("returns") * F.col("position"))
    factor = 1 + F.col("strategy_returns")
    size = F.exp(F.coalesce(F.sum(F.when(factor != 0, F.log(F.abs(factor)))).over(w), F.lit(0.0)))
    sign = F.when(F.count_if(factor < 0).over(w) % 2 == 1, -1.0).otherwise(1.0)
    df = df.withColumn("equity", F.when(F.count_if(factor == 0).over(w) > 0, 0.0).otherwise(sign * size))
    return df.withColumn("drawdown", F.col("equity") / F.max("equity").over(w) - 1)


def trades(df: DataFrame) -> DataFrame:
    """Trades of rows with position: they begin where it changes to other than 0 and end at the first bar of another position, or the last.

    (symbol, entry_time, exit_time, entry_price, exit_price, position, return, duration_bars). A change on the last bar is no trade.
    """
    w = series()
    changed = F.coalesce(F.col("position") != F.lag("position").over(w), F.lit(False))
    df = df.withColumn("__tm_new", changed).withColumn("__tm_n", F.row_number().over(w)).withColumn("__tm_run", F.sum(F.col("__tm_new").cast("int")).over(w))
    runs = df.groupBy("symbol", "__tm_run").agg(
        F.min("ts").alias("entry_time"), F.min_by("close", "ts").alias("entry_price"), F.first("position").alias("position"), F.max_by("__tm_new", F.struct(-F.col("__tm_n"))).alias("new"),
        F.min("__tm_n").alias("first"), F.max("ts").alias("last_time"), F.max_by("close", "ts").alias("last_price"), F.max("__tm_n").alias("last"),
    )
    after = Window.partitionBy("symbol").orderBy("__tm_run")
    runs = runs.withColumn("exit_time", F.coalesce(F.lead("entry_time").over(after), "last_time")).withColumn("exit_price", F.coalesce(F.lead("entry_price").over(after), "last_price"))
    runs = runs.withColumn("duration_bars", F.coalesce(F.lead("first").over(after), "last") - F.col("first") + 1)
    kept = runs.where(F.col("new") & (F.col("position") != 0) & (F.col("duration_bars") >= 2))
    result = (F.col("exit_price") / F.col("entry_price") - 1) * F.col("position")
    return kept.select("symbol", "entry_time", "exit_time", "entry_price", "exit_price", "position", result.alias("return"), "duration_bars")


def trade_summary(trades_: DataFrame, *by: str) -> DataFrame:
    """winrate, profit_factor (0 without losses), avg_trade_return and number of trades."""
    r = F.col("return")
    lost = F.abs(F.sum(F.when(r < 0, r)))
    factor = F.when(lost > 0, F.coalesce(F.sum(F.when(r > 0, r)), F.lit(0.0)) / lost).otherwise(0.0)
    return trades_.groupBy(*by).agg(F.avg((r > 0).cast("double")).alias("winrate"), factor.alias("profit_factor"), F.avg(r).alias("avg_trade_return"), F.count("*").alias("n_trades"))


def backtest_summary(frame: DataFrame, *by: str) -> DataFrame:
    """Of simulated rows: total and annualised return, Sharpe ratio (252 bars a year), largest drawdown, changes of position, volatility."""
    w = series()
    frame = frame.withColumn("__tm_d", F.coalesce(F.col("position") != F.lag("position").over(w), F.lit(False)))
    years = F.greatest(F.floor(F.expr("timestampdiff(DAY, min(ts), max(ts))")) / 365, F.lit(1 / 365))
    last = F.max_by("equity", "ts")
    return frame.groupBy(*by).agg(
        (last - 1).alias("total_return"), (F.pow(last, 1 / years) - 1).alias("annualized_return"),
        (F.avg("strategy_returns") / (F.stddev_samp("strategy_returns") + 1e-9) * F.sqrt(F.lit(252.0))).alias("sharpe"),
        F.min("drawdown").alias("max_drawdown"), F.count_if("__tm_d").alias("trades"), F.stddev_samp("strategy_returns").alias("volatility"),
    )


def tried(df: DataFrame, pairs: list[tuple[int, int]]) -> DataFrame:
    """The moving average backtest of pairs of lengths (fast, slow): (symbol, fast, slow, and what `backtest_summary` has).

    One pass over the candles makes the means of all lengths that occur; then each bar is a row for each pair, and a series of
    (symbol, fast, slow) is simulated by itself.
    """
    if not pairs:
        raise ValueError("no pairs of lengths")
    used = {(a, b): (max(2, a), max(max(2, a) + 1, b)) for a, b in pairs}
    lengths = sorted({n for p in used.values() for n in p})
    means = df.select("symbol", "ts", "close", *(rolling(F.avg, "close", n).alias(f"__tm_{n}") for n in lengths))
    entry = lambda p, s: F.struct(F.lit(p[0]).alias("fast"), F.lit(p[1]).alias("slow"), s.alias("s"))
    listed = sorted(used)
    crossed = F.array(*(entry(p, F.signum(F.col(f"__tm_{used[p][0]}") - F.col(f"__tm_{used[p][1]}"))) for p in listed))
    first = F.array(*(entry(p, F.lit(None).cast("double")) for p in listed))
    before = means.select("symbol", "ts", "close", crossed.alias("p")).withColumn("p", F.coalesce(F.lag("p").over(series()), first))
    rows = before.select("symbol", "ts", "close", F.explode("p").alias("p")).select(F.struct("symbol", "p.fast", "p.slow").alias("symbol"), "ts", "close", F.coalesce("p.s", F.lit(0.0)).alias("position"))
    out = backtest_summary(simulate(rows), "symbol")
    return out.select("symbol.symbol", "symbol.fast", "symbol.slow", "total_return", "sharpe", "max_drawdown", "trades")


def grid(df: DataFrame, fasts: list[int], slows: list[int]) -> DataFrame:
    """All pairs of lengths whose slow one is above the fast one, in one pass (see `tried`)."""
    pairs = [(fast, slow) for fast in sorted(set(fasts)) for slow in sorted(set(slows)) if slow > fast]
    if not pairs:
        raise ValueError("no pair has a slow length above its fast one")
    return tried(df, pairs)


def leaderboard(results: DataFrame, by: str = "total_return", *ties: str) -> DataFrame:
    """rank from 1, best first."""
    return ranked(results, F.desc(by), *ties).withColumn("rank", F.col("rank").cast("int"))


def bollinger(df: DataFrame, n: int = 20, width: float = 2.0) -> DataFrame:
    """Adds basis, upper, lower (population deviation)."""
    basis, sd = rolling(F.avg, "close", n), rolling(F.stddev_pop, "close", n)
    return df.withColumns({"basis": basis, "upper": basis + width * sd, "lower": basis - width * sd})


def zscore(df: DataFrame, column: str, n: int = 30) -> DataFrame:
    """Adds z: distance from the rolling mean in deviations; 0 before the window is full and for no deviation."""
    mean, sd = rolling(F.avg, column, n), rolling(F.stddev_pop, column, n)
    return df.withColumn("z", F.coalesce(F.when(sd != 0, (F.col(column) - mean) / sd), F.lit(0.0)))


def rsi_simple(df: DataFrame, n: int = 14) -> DataFrame:
    """Adds rsi from plain means of the last n gains and losses: 50 with n prices or fewer, 100 without losses."""
    w = series()
    df = df.withColumn("__tm_d", F.col("close") - F.lag("close").over(w))
    rows = w.rowsBetween(-(n - 1), 0)
    gain, loss = F.avg(F.greatest("__tm_d", F.lit(0.0))).over(rows), F.avg(F.greatest(-F.col("__tm_d"), F.lit(0.0))).over(rows)
    full = F.count("__tm_d").over(rows) == n
    return df.withColumn("rsi", F.when(~full, 50.0).when(loss == 0, 100.0).otherwise(100 - 100 / (1 + gain / loss))).drop("__tm_d")


def pseudo_adx(df: DataFrame, n: int = 14) -> DataFrame:
    """Adds strength: mean absolute change of the last n bars in percent of the close, at most 50; 20 with n prices or fewer."""
    w = series()
    df = df.withColumn("__tm_d", F.abs(F.col("close") - F.lag("close").over(w)))
    rows = w.rowsBetween(-(n - 1), 0)
    value = F.least(F.lit(50.0), F.avg("__tm_d").over(rows) / F.col("close") * 100)
    return df.withColumn("strength", F.when(F.count("__tm_d").over(rows) == n, value).otherwise(20.0)).drop("__tm_d")


def donchian(df: DataFrame, n: int = 50, volume_n: int = 20, spike: float = 1.5, include_current: bool = False) -> DataFrame:
    """Adds top, bottom, volume_avg and direction: long above the top, short below the bottom, either on a volume spike.

    By default the channel is of the n bars before; with the current bar in it no close can be outside.
    """
    rows = series().rowsBetween(-(n - 1), 0) if include_current else series().rowsBetween(-n, -1)
    full = F.count(F.lit(1)).over(rows) == n
    df = df.withColumns({"top": F.when(full, F.max("high").over(rows)), "bottom": F.when(full, F.min("low").over(rows)), "volume_avg": rolling(F.avg, "volume", volume_n)})
    loud = F.col("volume") > F.col("volume_avg") * spike
    return df.withColumn("direction", F.when((F.col("close") > F.col("top")) & loud, "long").when((F.col("close") < F.col("bottom")) & loud, "short"))


def wilder(values: np.ndarray, n: int) -> np.ndarray:
    """Wilder's smoothing: the mean of the first n values that are there, then one part in n of each next value."""
    out = np.full(len(values), np.nan)
    if len(values) < n:
        return out
    first = values[:n][~np.isnan(values[:n])]
    now = first.mean() if len(first) else 0.0
    out[n - 1] = now
    for k in range(n, len(values)):
        now = values[k] if np.isnan(now) else (now * (n - 1) + values[k]) / n
        out[k] = now
    return out


def _adx(high: np.ndarray, low: np.ndarray, close: np.ndarray, n: int) -> np.ndarray:
    reach = np.maximum(high[1:] - low[1:], np.maximum(np.abs(high[1:] - close[:-1]), np.abs(low[1:] - close[:-1])))
    up, down = high[1:] - high[:-1], low[:-1] - low[1:]
    lead = lambda x: np.concatenate(([np.nan], x))
    with np.errstate(invalid="ignore", divide="ignore"):
        spread = wilder(lead(reach), n)
        spread[spread == 0] = np.nan
        plus, minus = (100 * wilder(lead(np.where((a > b) & (a > 0), a, 0.0)), n) / spread for a, b in ((up, down), (down, up)))
        dx = np.nan_to_num(100 * np.abs(plus - minus) / (plus + minus), nan=0.0, posinf=0.0, neginf=0.0)
    return pd.Series(wilder(dx, n)).bfill().to_numpy()


def smoothed(df: DataFrame, fast: int = 9, slow: int = 21, n: int = 14) -> DataFrame:
    """Adds ema_fast, ema_slow, rsi (50 without losses), atr and adx, which need all earlier bars of a series."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("ts", ignore_index=True)
        ewm = lambda x, alpha: x.ewm(alpha=alpha, adjust=False).mean()
        step, before = g["close"].diff(), g["close"].shift(1)
        gain, loss = ewm(step.clip(lower=0), 1 / n), ewm(-step.clip(upper=0), 1 / n)
        reach = pd.concat([g["high"] - g["low"], (g["high"] - before).abs(), (g["low"] - before).abs()], axis=1).max(axis=1)
        return g.assign(
            ema_fast=ewm(g["close"], 2 / (fast + 1)), ema_slow=ewm(g["close"], 2 / (slow + 1)),
            rsi=(100 - 100 / (1 + gain / loss.where(loss != 0))).fillna(50.0), atr=ewm(reach, 1 / n),
            adx=_adx(*(g[c].to_numpy(float) for c in ("high", "low", "close")), n),
        )

    schema = StructType([*df.schema.fields, *(StructField(name, DoubleType()) for name in ("ema_fast", "ema_slow", "rsi", "atr", "adx"))])
    return df.groupBy("symbol").applyInPandas(run, schema)


#: Parameters of the scanner profiles: fast and slow EMA, least ADX and volume z, stop in ATRs, bounds of leverage.
PROFILES = {
    "tight": (9, 21, 22, 1.9, 0.8, 8, 15),
    "aggressive": (7, 15, 25, 2.2, 0.7, 10, 20),
    "balanced": (9, 21, 20, 1.5, 1.0, 5, 12),
    "conservative": (12, 26, 18, 1.2, 1.2, 3, 8),
    "scalping": (5, 13, 25, 2.0, 0.6, 10, 20),
    "swing": (21, 50, 15, 1.0, 1.5, 2, 6),
}


def momentum_signals(df: DataFrame, profile: str = "balanced", keep_null: bool = False) -> DataFrame:
    """One row a bar where fast and slow EMA cross or clearly diverge: direction, confidence, risk levels.

    Without a cross a trend counts if the EMAs are 0.2 % apart and the fast one has moved on over two bars. Confidence is 60, plus
    10 for a strong ADX and 10 for a volume far above its mean. Bars without direction are left out unless `keep_null`.
    """
    fast, slow, adx_min, z_min, stop, low, high = PROFILES[profile]
    w = series()
    df = zscore(smoothed(df, fast, slow), "volume", 30)
    f, s = F.col("ema_fast"), F.col("ema_slow")
    pf, ps = F.lag("ema_fast").over(w), F.lag("ema_slow").over(w)
    cross = F.when((f > s) & (pf <= ps), "long").when((f < s) & (pf >= ps), "short")
    enough = F.row_number().over(w) >= 5
    trend = F.when(enough & (f > s * 1.002) & (f > F.lag("ema_fast", 2).over(w)), "long").when(enough & (f < s * 0.998) & (f < F.lag("ema_fast", 2).over(w)), "short")
    adx = F.coalesce("adx", F.lit(0.0))
    confidence = F.least(F.lit(95), F.lit(60) + F.when(adx > adx_min + 5, 10).otherwise(0) + F.when(F.col("z") > z_min + 0.5, 10).otherwise(0))
    out = df.withColumn("direction", F.coalesce(cross, trend)).withColumn("confidence", confidence).where(F.col("atr") > 0)
    out = out if keep_null else out.where("direction is not null")
    return out.withColumn("risk", M.risk_assessment(F.col("close"), F.col("atr"), F.col("direction"), stop, (low, high)))


def mean_reversion_signals(df: DataFrame, width: float = 2.0, oversold: float = 35, overbought: float = 65) -> DataFrame:
    """One row a bar outside its Bollinger band with an RSI to match: long below and oversold, short above and overbought."""
    df = bollinger(smoothed(df), width=width)
    direction = F.when((F.col("close") < F.col("lower")) & (F.col("rsi") < oversold), "long").when((F.col("close") > F.col("upper")) & (F.col("rsi") > overbought), "short")
    far = ((F.col("direction") == "long") & (F.col("rsi") < 30)) | ((F.col("direction") == "short") & (F.col("rsi") > 70))
    return df.withColumn("direction", direction).where("direction is not null and atr > 0").withColumn("confidence", F.lit(55) + F.when(far, 10).otherwise(0))


def breakout_signals(df: DataFrame, include_current: bool = False) -> DataFrame:
    """Donchian breakouts on volume (see `donchian`), confidence 70."""
    out = donchian(smoothed(df), include_current=include_current)
    level = F.when(F.col("direction") == "long", F.col("top")).otherwise(F.col("bottom"))
    return out.where("direction is not null and atr > 0").withColumns({"breakout_level": level, "confidence": F.lit(70)})


def volume_profile(df: DataFrame, bins: int = 49) -> DataFrame:
    """Per symbol: poc (middle of the bin of most volume; of the lowest such), value_area_low, value_area_high.

    Closes go to equal bins from the least low to the greatest high. The area is from the last bin where at most 15 % of the volume
    lie below or in it, to the first with at least 85 %; where there is none it is the poc.
    """
    edges = df.groupBy("symbol").agg(F.min("low").alias("lo"), F.max("high").alias("hi"))
    binned = df.join(edges, "symbol").withColumn("bin", F.when(F.col("hi") > F.col("lo"), F.least(F.width_bucket("close", "lo", "hi", F.lit(bins)), F.lit(bins))).otherwise(1))
    held = binned.groupBy("symbol", "lo", "hi", "bin").agg(F.sum("volume").alias("held"))
    # empty bins hold nothing, but the share below them counts: it is that of the next lower bin that holds something
    share = F.sum("held").over(Window.partitionBy("symbol").orderBy("bin")) / F.sum("held").over(Window.partitionBy("symbol"))
    held = held.withColumn("share", share).withColumn("next_bin", F.coalesce(F.lead("bin").over(Window.partitionBy("symbol").orderBy("bin")), F.lit(bins + 1)))
    first = Window.partitionBy("symbol").orderBy("bin")
    held = held.withColumn("empty_to", F.when(F.row_number().over(first) == 1, F.col("bin") - 1))
    middle = lambda b: F.col("lo") + (F.col("hi") - F.col("lo")) * (b - 0.5) / bins
    low = F.max(F.when(F.col("share") <= 0.15, F.col("next_bin") - 1).otherwise(F.when(F.col("empty_to") > 0, F.col("empty_to"))))
    out = held.groupBy("symbol", "lo", "hi").agg(F.min_by("bin", F.struct(-F.col("held"), "bin")).alias("poc_bin"), low.alias("low_bin"), F.min(F.when(F.col("share") >= 0.85, F.col("bin"))).alias("high_bin"))
    return out.select("symbol", middle(F.col("poc_bin")).alias("poc"), middle(F.coalesce("low_bin", "poc_bin")).alias("value_area_low"), middle(F.coalesce("high_bin", "poc_bin")).alias("value_area_high"))


def consecutive(df: DataFrame, n: int, least_growth: float) -> DataFrame:
    """Bars that end n in a row whose body grew by `least_growth` percent or more (fell, if that is below 0)."""
    grown = M.percent_change(F.col("open"), F.col("close"))
    hit = (grown >= least_growth) if least_growth >= 0 else (grown <= least_growth)
    rows = series().rowsBetween(-(n - 1), 0)
    df = df.withColumn("__tm_h", hit.cast("int"))
    return df.withColumn("__tm_n", F.sum("__tm_h").over(rows)).where(F.col("__tm_n") == n).drop("__tm_h", "__tm_n")


def top(df: DataFrame, by: str, n: int, *ties: str, ascending: bool = False, most: int = 50) -> DataFrame:
    """The n rows (1 to `most`) with the largest or smallest value, null ones last."""
    order = F.asc_nulls_last(by) if ascending else F.desc_nulls_last(by)
    return df.orderBy(order, *ties).limit(max(1, min(n, most)))


def relaxed(df: DataFrame, levels: list[Column]) -> DataFrame:
    """Rows of the first condition that any row meets: thresholds that are relaxed step by step, in one pass."""
    level = F.coalesce(*(F.when(c, k) for k, c in enumerate(levels)))
    hit = df.withColumn("level", level).where("level is not null")
    return hit.join(F.broadcast(hit.agg(F.min("level").alias("level"))), "level", "left_semi")


def merge_candidates(a: DataFrame, b: DataFrame) -> DataFrame:
    """Of two lists (symbol, direction, score, entry, stop, target) one row a symbol and direction: the larger score, levels of the better R."""
    r = lambda x: F.coalesce(F.try_divide(F.abs(x["target"] - x["entry"]), F.abs(x["entry"] - x["stop"])), F.lit(-1.0))
    pack = lambda df, name: df.select("symbol", "direction", F.struct("score", "entry", "stop", "target").alias(name))
    both = pack(a, "a").join(pack(b, "b"), ["symbol", "direction"], "full_outer")
    best = F.when(F.col("b").isNull() | (F.col("a").isNotNull() & (r(F.col("a")) >= r(F.col("b")))), F.col("a")).otherwise(F.col("b"))
    return both.select("symbol", "direction", F.greatest("a.score", "b.score").alias("score"), *(best[c].alias(c) for c in ("entry", "stop", "target")))


def signal_metrics(signals: DataFrame, *by: str, null_is_short: bool = False) -> DataFrame:
    """Counts, shares and means of signals. Signals without direction are left out, or count as short."""
    if not null_is_short:
        signals = signals.where("direction is not null")
    total, long = F.count("*"), F.count_if(F.col("direction") == "long")
    away = lambda x: F.abs(x - F.col("entry")) / F.abs("entry") * 100
    sums = F.aggregate("take_profit", F.lit(0.0), lambda acc, x: acc + away(x))
    priced = F.col("entry") != 0
    return signals.groupBy(*by).agg(
        total.alias("total_signals"), long.alias("long_signals"), (total - long).alias("short_signals"), F.round(long / total, 4).alias("long_ratio"), F.round((total - long) / total, 4).alias("short_ratio"),
        F.round(F.avg("confidence"), 2).alias("avg_confidence"), F.round(F.avg("leverage"), 2).alias("avg_leverage"), F.round(F.avg("position_size"), 2).alias("avg_position_size"),
        F.round(F.avg(F.when(priced, away(F.col("stop_loss")))), 2).alias("avg_stop_loss_pct"), F.round(F.sum(F.when(priced, sums)) / F.sum(F.when(priced, F.size("take_profit"))), 2).alias("avg_take_profit_pct"),
        F.count_distinct("symbol").alias("symbols_covered"), F.round(total / F.count_distinct("symbol"), 2).alias("signals_per_symbol_avg"),
    )


def average_cost(trades_: DataFrame, by: str, ts: str, *ties: str) -> DataFrame:
    """What is left of (by, side, qty, price): remaining, cost and entry price at average cost.

    Buys add; sells take away at the running average, and no more than there is. A fold over each key's trades in order.
    """
    ordered = F.array_sort(F.collect_list(F.struct(ts, *ties, "side", F.col("qty").cast("double").alias("qty"), F.col("price").cast("double").alias("price"))))
    start = F.struct(F.lit(0.0).alias("q"), F.lit(0.0).alias("c"))

    def step(acc: Column, t: Column) -> Column:
        out = F.least(t["qty"], acc["q"])
        left = F.when(acc["q"] > 0, acc["c"] - out * acc["c"] / acc["q"]).otherwise(acc["c"])
        buy = t["side"] == "BUY"
        return F.struct(F.when(buy, acc["q"] + t["qty"]).otherwise(acc["q"] - out).alias("q"), F.when(buy, acc["c"] + t["qty"] * t["price"]).otherwise(left).alias("c"))

    out = trades_.groupBy(by).agg(ordered.alias("o")).select(by, F.aggregate("o", start, step).alias("e"))
    return out.select(by, F.col("e.q").alias("remaining"), F.col("e.c").alias("cost"), F.try_divide(F.col("e.c"), F.col("e.q")).alias("entry_price"))


def day_stats(candles: DataFrame, by: str = "symbol") -> DataFrame:
    """(by, day_high, day_low, day_volume, day_change: in percent of the open) of each symbol's last candle."""
    last = candles.groupBy(by).agg(F.max_by(F.struct("open", "high", "low", "close", "volume"), "ts").alias("c"))
    return last.select(by, F.col("c.high").alias("day_high"), F.col("c.low").alias("day_low"), F.col("c.volume").alias("day_volume"), (F.try_divide(F.col("c.close") - F.col("c.open"), F.col("c.open")) * 100).alias("day_change"))


def tickers_with_stats(tickers: DataFrame, stats: DataFrame, by: str = "symbol") -> DataFrame:
    """Each ticker with its symbol's statistics; null where there are none."""
    return tickers.join(stats, by, "left")
