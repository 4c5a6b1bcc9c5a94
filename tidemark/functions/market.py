"""Column functions on prices and risk. Null arguments give null unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def percent_change(open_: Column, close: Column) -> Column:
    """Change from open to close in percent; 0 if open is 0 or null."""
    return F.when(open_.isNull() | (open_ == 0), F.lit(0.0)).otherwise((close - open_) / open_ * 100)


def percent_change_or_null(open_: Column, close: Column) -> Column:
    """As `percent_change`, but null if open is 0 or null."""
    return F.try_divide(close - open_, open_) * 100


def bollinger_width(middle: Column, upper: Column, lower: Column) -> Column:
    """Band width by the middle; null if that is 0."""
    return F.try_divide(upper - lower, middle)


def bollinger_rating(close: Column, upper: Column, middle: Column, lower: Column) -> Column:
    """-3 to 3: outside a band, in the outer half of it, in the inner half, on the middle."""
    return (
        F.when(close > upper, 3).when(close > middle + (upper - middle) / 2, 2).when(close > middle, 1)
        .when(close < lower, -3).when(close < middle - (middle - lower) / 2, -2).when(close < middle, -1).otherwise(0)
    )


def rating_signal(rating: Column) -> Column:
    """BUY for exactly 2, SELL for exactly -2."""
    return F.when(rating == 2, "BUY").when(rating == -2, "SELL").otherwise("NEUTRAL")


def effective_entry(entry: Column, side: Column, fee: float, slippage: float) -> Column:
    """The entry with costs: above the price for a long position, below it for any other."""
    return entry * F.when(F.lower(side) == "long", 1 + fee + slippage).otherwise(1 - fee - slippage)


def position_size(equity: Column, entry: Column, stop: Column, side: Column, risk_pct: float, fee: float, slippage: float) -> Column:
    """How much to hold so that the stop costs `risk_pct` percent of equity; 0 if the stop is at the entry."""
    distance = F.abs(effective_entry(entry, side, fee, slippage) - stop)
    return F.when(distance <= 0, F.lit(0.0)).otherwise(equity * (risk_pct / 100) / distance)


def risk_reward(entry: Column, target: Column, stop: Column, side: Column) -> Column:
    """Reward by risk; 0 unless both are above 0."""
    sign = F.when(F.lower(side) == "long", 1).otherwise(-1)
    risk, reward = (entry - stop) * sign, (target - entry) * sign
    return F.when((risk <= 0) | (reward <= 0), F.lit(0.0)).otherwise(reward / risk)


def min_risk_reward_target(entry: Column, target: Column, stop: Column, atr: Column, side: Column, least: float, atr_multiple: float) -> Column:
    """The target moved out until its reward is `least` times the risk, but not beyond so many ATRs."""
    long = F.lower(side) == "long"
    wanted = F.abs(entry - stop) * least
    moved = F.when(long, F.least(entry + atr * atr_multiple, F.greatest(target, entry + wanted))).otherwise(F.greatest(entry - atr * atr_multiple, F.least(target, entry - wanted)))
    return F.when((risk_reward(entry, target, stop, side) < least) & (atr > 0), moved).otherwise(target)


def should_halt(pnl_pct: Column, losses_in_a_row: Column, loss_cap_pct: float, most_losses: int) -> Column:
    return (pnl_pct <= -abs(loss_cap_pct)) | (losses_in_a_row >= most_losses)


def risk_assessment(entry: Column, atr: Column, direction: Column, stop_mult: float, leverage_bounds: tuple[float, float]) -> Column:
    """(leverage, stop_loss, take_profit, position_size): the middle of the leverage bounds, an ATR stop, targets at 1.5 and 2.5 ATR.

    1 % of the entry is at risk. Without an ATR there are no levels. Any direction but long counts as short.
    """
    sign = F.when(direction == "long", 1.0).otherwise(-1.0)
    has = F.coalesce(atr != 0, F.lit(False))
    leverage = F.lit(float(max(leverage_bounds[0], min(leverage_bounds[1], sum(leverage_bounds) / 2))))
    stop = entry - sign * atr * stop_mult
    stop = F.when(direction == "long", F.greatest(stop, F.lit(0.0))).otherwise(stop)
    size = entry * 0.01 / (atr * stop_mult) * leverage
    return F.struct(
        leverage.alias("leverage"),
        F.when(has, stop).alias("stop_loss"),
        F.when(has, F.array(entry + sign * atr * 1.5, entry + sign * atr * 2.5)).otherwise(F.array().cast("array<double>")).alias("take_profit"),
        F.when(has & (entry != 0) & (size > 0), size).alias("position_size"),
    )


def round_to_step(value: Column, step: Column, up: bool = False) -> Column:
    """A decimal down (or up) to a multiple of a step; unchanged if the step is 0 or null."""
    whole = F.ceil(value / step) if up else F.floor(value / step)
    return F.when(step.isNull() | (step == 0), value).otherwise((whole * step).cast("decimal(20,8)"))


def candidate_score(n_reasons: Column, adx: Column, entry: Column, stop: Column, target: Column, strategy: Column) -> Column:
    """Half a point a reason, ADX by 10 up to 5, the R multiple up to 3, and a little for the kind of strategy."""
    r = F.try_divide(F.abs(target - entry), F.abs(entry - stop))
    parts = (n_reasons * 0.5, F.least(F.lit(5.0), F.greatest(F.lit(0.0), adx / 10)), F.least(F.lit(3.0), F.greatest(F.lit(0.0), r)))
    bias = F.when(strategy == "breakout", 0.4).when(strategy == "pullback", 0.2).otherwise(0.0)
    return sum((F.coalesce(p.cast("double"), F.lit(0.0)) for p in parts), F.lit(0.0)) + bias


def smart_score(volume: Column, adx: Column, rsi: Column, width: Column, change: Column) -> Column:
    """Sum of log volume, ADX by 10 up to 5, nearness of RSI to 50, narrowness of the bands and growth; nulls add nothing."""
    zero = F.lit(0.0)
    parts = (
        F.when(volume > 0, F.log10(volume + 1)), F.least(F.lit(5.0), F.greatest(zero, adx / 10)), F.greatest(zero, (100 - F.abs(rsi - 50)) / 20),
        F.greatest(zero, (0.2 - width) * 10), F.greatest(zero, change / 5),
    )
    return sum((F.coalesce(F.when(p.isNotNull(), p), zero) for p in parts), zero)


def stop_price(mark: Column, entry: Column, side: Column, trail_pct: Column, fixed_pct: Column) -> Column:
    """A trailing stop from the mark price where a trail is given, else a fixed one from the entry."""
    sign = F.when(F.lower(side) == "long", -1).otherwise(1)
    return F.when(trail_pct.isNotNull(), mark * (1 + sign * trail_pct / 100)).otherwise(entry * (1 + sign * fixed_pct / 100))


def indicator_bundle(open_: Column, close: Column, middle: Column, upper: Column, lower: Column) -> Column:
    """(price, change, bbw, rating, signal): to 4, 3 and 4 digits, halves to even."""
    rating = bollinger_rating(close, upper, middle, lower)
    return F.struct(F.bround(close, 4).alias("price"), F.bround(percent_change(open_, close), 3).alias("change"), F.bround(bollinger_width(middle, upper, lower), 4).alias("bbw"), rating.alias("rating"), rating_signal(rating).alias("signal"))
