"""Screeners over candles with indicators, and joins of positions with prices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import market as K


def percent_b(close: Column, upper: Column, lower: Column) -> Column:
    """Place of the close in its bands: 0 at the lower, 1 at the upper one."""
    return F.try_divide(close - lower, upper - lower)


def keltner_width(atr: Column, ema: Column, multiple: float = 2.0) -> Column:
    """Width of an ATR channel by its middle."""
    return F.try_divide(atr * multiple * 2, ema)


def multi_timeframe(frames: DataFrame, least_change: float, needed: int) -> DataFrame:
    """(symbol, hits): symbols with at least `needed` timeframes of (symbol, timeframe, open, close) whose body changed by so many percent."""
    moved = F.abs(F.try_divide(F.col("close") - F.col("open"), F.col("open")) * 100) >= least_change
    return frames.groupBy("symbol").agg(F.count_if(moved).alias("hits")).where(F.col("hits") >= needed)


def trend_breakout(df: DataFrame) -> DataFrame:
    """Rows with a strong ADX, a wide channel, a close near the upper band and a large candle, by the strictest of four sets of
    thresholds that any row meets (level 0 to 3).
    """
    df = K.bollinger(K.smoothed(df)).withColumn("pct_b", percent_b(F.col("close"), F.col("upper"), F.col("lower"))).withColumn("channel", keltner_width(F.col("atr"), F.col("ema_slow")))
    impulse = F.try_divide(F.abs(F.col("close") - F.col("open")), F.col("atr"))
    sets = ((25, 0.04, 0.8, 1.0), (22, 0.03, 0.7, 0.8), (18, 0.02, 0.6, 0.6), (15, 0.01, 0.5, 0.4))
    return K.relaxed(df.withColumn("impulse", impulse), [(F.col("adx") >= a) & (F.col("channel") >= c) & (F.col("pct_b") >= b) & (F.col("impulse") >= i) for a, c, b, i in sets])


def pullback(df: DataFrame, fast: int = 20, slow: int = 50) -> DataFrame:
    """Rows in an uptrend whose close came back to the fast EMA without an overbought RSI, by the strictest of three sets of thresholds."""
    df = K.smoothed(df, fast, slow)
    away = F.try_divide(F.abs(F.col("close") - F.col("ema_fast")), F.col("ema_fast"))
    up = F.col("ema_fast") > F.col("ema_slow")
    sets = ((0.005, 45, 55, 20, 45), (0.01, 40, 60, 15, 50), (0.02, 35, 65, 10, 60))
    return K.relaxed(df, [up & (away <= t) & F.col("rsi").between(lo, hi) & F.col("adx").between(a, b) for t, lo, hi, a, b in sets])


def priced(balances: DataFrame, tickers: DataFrame, stable: tuple[str, ...] = ("USDT", "USDC")) -> DataFrame:
    """(asset, amount, price, value): balances at their price; stable assets are worth 1, and those without a price are left out."""
    joined = balances.join(tickers.select("asset", F.col("price").alias("__tm_p")), "asset", "left")
    price = F.when(F.col("asset").isin(*stable), 1.0).otherwise(F.col("__tm_p"))
    return joined.withColumn("price", price).where("price is not null").select("asset", "amount", "price", (F.col("amount") * F.col("price")).alias("value"))


def alert_thresholds(positions: DataFrame, rules: DataFrame) -> DataFrame:
    """(symbol, kind, value) of positions (symbol, drawdown, profit, volume_ratio, price, rsi) that break a rule (kind, threshold)."""
    kinds = ("drawdown", "profit", "volume_spike", "price_level", "rsi_extreme")
    columns = ("drawdown", "profit", "volume_ratio", "price", "rsi")
    pairs = F.array(*(F.struct(F.lit(k).alias("kind"), F.col(c).cast("double").alias("value")) for k, c in zip(kinds, columns, strict=True)))
    long = positions.select("symbol", F.explode(pairs).alias("p")).select("symbol", "p.kind", "p.value")
    hit = F.when(F.col("kind") == "drawdown", F.col("value") <= -F.abs("threshold")).when(F.col("kind") == "rsi_extreme", (F.col("value") >= F.col("threshold")) | (F.col("value") <= 100 - F.col("threshold"))).otherwise(F.col("value") >= F.col("threshold"))
    return long.join(rules, "kind").where(hit).select("symbol", "kind", "value")


def first_available(*frames: DataFrame) -> DataFrame:
    """The first that has a row; the last if none has. Each is asked for one row only."""
    for df in frames[:-1]:
        if not df.isEmpty():
            return df
    return frames[-1]
