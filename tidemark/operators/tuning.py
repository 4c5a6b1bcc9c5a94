"""Search for parameters by rounds: what has been tried shapes what is tried next.

After each round trials are split into the best quarter and the others; for each parameter both have a smoothed density over its values,
and the next trials are those drawn from the good density whose ratio of good to bad is largest (a tree-structured Parzen estimator over a
grid). A round's trials are evaluated in one pass of Spark over the candles; only a number for each trial reaches the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .market import tried

#: Trials that count as good; draws for each trial of a round.
GOOD, DRAWS = 0.25, 24


def _density(places: np.ndarray, n: int) -> np.ndarray:
    """Of n values in order: a bump at each place, a little everywhere."""
    width = max(1.0, n / 8)
    bumps = np.exp(-0.5 * ((np.arange(n)[:, None] - places[None, :]) / width) ** 2).sum(axis=1)
    out = bumps + 0.1 * max(1, len(places)) / n
    return out / out.sum()


def propose(values: Sequence[Sequence[int]], allowed: Callable[..., bool], done: dict[tuple, float | None], n: int, rng: np.random.Generator) -> list[tuple]:
    """n new trials at most, by what is done (trial to value; the larger the better, None is worst); at random before anything is."""
    left = {t for t in _all(values) if allowed(*t)} - set(done)
    order = sorted(left)
    if len(order) <= n:
        return order
    known = sorted((t for t in done if done[t] is not None), key=lambda t: (-done[t], t))
    if len(known) < 4:
        return [order[k] for k in sorted(rng.permutation(len(order))[:n])]
    cut = max(2, round(GOOD * len(known)))
    worse = known[cut:] + [t for t in done if done[t] is None]
    place = [{v: k for k, v in enumerate(vs)} for vs in values]
    dens = lambda some: [_density(np.array([place[d][t[d]] for t in some]), len(vs)) for d, vs in enumerate(values)]
    good, bad = dens(known[:cut]), dens(worse)
    drawn = {tuple(vs[rng.choice(len(vs), p=good[d])] for d, vs in enumerate(values)) for _ in range(DRAWS * n)} & left
    score = lambda t: sum(float(np.log(good[d][place[d][x]] / bad[d][place[d][x]])) for d, x in enumerate(t))
    best = sorted(drawn, key=lambda t: (-score(t), t))[:n]
    rest = [t for t in order if t not in set(best)]
    return best + [rest[k] for k in rng.permutation(len(rest))[: n - len(best)]]


def _all(values: Sequence[Sequence[int]]) -> list[tuple]:
    out: list[tuple] = [()]
    for vs in values:
        out = [(*t, v) for t in out for v in vs]
    return out


def search_lengths(candles: DataFrame, fasts: Sequence[int], slows: Sequence[int], rounds: int = 4, each: int = 6, value: str = "total_return", seed: int = 0) -> DataFrame:
    """(turn, fast, slow, value, place): all trials of lengths of moving averages, the best first; the value is the mean over symbols.

    The same seed tries the same pairs. A value that is null (no candles) is the worst.
    """
    rng, done, rows = np.random.default_rng(seed), {}, []
    for turn in range(rounds):
        some = propose((sorted(set(fasts)), sorted(set(slows))), lambda a, b: b > a, done, each, rng)
        if not some:
            break
        found = tried(candles, some).groupBy("fast", "slow").agg(F.avg(value).alias("v")).collect()
        got = {(r.fast, r.slow): r.v for r in found}
        for t in some:
            done[t] = None if got.get(t) is None else round(got[t], 12)
            rows.append((turn, *t, done[t]))
    rows.sort(key=lambda r: (r[3] is None, -(r[3] or 0.0), r[1], r[2]))
    return candles.sparkSession.createDataFrame([(*r, k) for k, r in enumerate(rows, 1)], "turn int, fast int, slow int, value double, place int")
