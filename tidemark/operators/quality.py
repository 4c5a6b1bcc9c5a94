"""Quality scores, entity counts, portfolio rules and other aggregates of the memory and market domains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Weights of the parts of a summary's quality, by profile.
WEIGHTS = {
    "broadcast": {"coverage": 0.35, "claims": 0.10, "actions": 0.05, "risks": 0.05, "threads": 0.05, "dedup": 0.15, "structure": 0.25},
    "group": {"coverage": 0.20, "claims": 0.10, "actions": 0.30, "risks": 0.15, "threads": 0.10, "dedup": 0.05, "structure": 0.10},
}


def length_penalty(claim_lengths: Column) -> Column:
    """One point for each 30 characters of a claim over 160 up to 220, two for each over 220 up to 300; begun ones count."""
    over = lambda n, low, high: F.ceil((F.least(n, F.lit(high)) - low) / 30)
    one = lambda n: F.when(n > 160, over(n, 160, 220)).otherwise(0) + F.when(n > 220, over(n, 220, 300) * 2).otherwise(0)
    return F.aggregate(F.transform(claim_lengths, one), F.lit(0).cast("long"), lambda a, x: a + x)


def quality_score(profile: Column, coverage: Column, claims: Column, flags: dict[str, Column], duplicate_rate: Column, claim_lengths: Column) -> Column:
    """0 to 100: the weighted parts, each from 0 to 1, minus the length penalty. Any profile but broadcast counts as group."""
    clamp = lambda x: F.least(F.lit(1.0), F.greatest(F.lit(0.0), x.cast("double")))
    parts = {"coverage": clamp(coverage), "claims": clamp(claims), "dedup": 1 - clamp(duplicate_rate), **{k: v.cast("double") for k, v in flags.items()}}
    total = lambda w: sum((parts[k] * x for k, x in w.items()), F.lit(0.0))
    weighed = F.when(profile == "broadcast", total(WEIGHTS["broadcast"])).otherwise(total(WEIGHTS["group"]))
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), weighed * 100 - length_penalty(claim_lengths)))


def summary_score(context_length: Column, discussions: Column, decisions: Column, risks: Column, links: Column, language_matches: Column) -> Column:
    """0 to 100: context up to 30 (at 100 characters), discussions 10 each up to 30, decisions 7.5 up to 15, risks 5 up to 10, links 2.5 up to 5, language 10."""
    parts = ((context_length * 0.3, 30), (discussions * 10, 30), (decisions * 7.5, 15), (risks * 5, 10), (links * 2.5, 5))
    return F.least(F.lit(100.0), sum((F.least(F.lit(float(most)), x.cast("double")) for x, most in parts), F.lit(0.0)) + F.when(language_matches, 10.0).otherwise(0.0))


def entity_counts(mentions: DataFrame, thresholds: dict[str, int], default: int = 3) -> DataFrame:
    """(type, value, n, chats, first, last, learned) from mentions (type, value, chat, ts): learned from a type's threshold on."""
    least = F.coalesce(*(F.when(F.col("type") == k, F.lit(v)) for k, v in thresholds.items()), F.lit(default))
    out = mentions.groupBy("type", "value").agg(F.count("*").alias("n"), F.count_distinct("chat").alias("chats"), F.min("ts").alias("first"), F.max("ts").alias("last"))
    return out.withColumn("learned", F.col("n") >= least)


def entity_stats(counts: DataFrame) -> DataFrame:
    """(type, tracked, learned, candidates)."""
    return counts.groupBy("type").agg(F.count("*").alias("tracked"), F.count_if("learned").alias("learned")).withColumn("candidates", F.col("tracked") - F.col("learned"))


def entity_importance(counts: DataFrame) -> DataFrame:
    """Adds importance: 0.2 plus 0.8 times the count by the largest of all, at most 1."""
    return counts.crossJoin(F.broadcast(counts.agg(F.max("n").alias("__tm_m")))).withColumn("importance", F.least(F.lit(1.0), 0.2 + 0.8 * F.col("n") / F.col("__tm_m"))).drop("__tm_m")


def top_per_group(counts: DataFrame, by: str, n: int, value: str = "value", count: str = "n") -> DataFrame:
    """The n largest of each group; ties go to the smaller value."""
    place = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(count), value))
    return counts.withColumn("rank", place).where(F.col("rank") <= n)


def co_mentions(mentions: DataFrame, session: str, value: str = "value") -> DataFrame:
    """(a, b, n): in how many sessions two values occur together. A session's values are a set; pairs are made within it."""
    sets = mentions.groupBy(session).agg(F.array_sort(F.collect_set(value)).alias("v"))
    pairs = sets.select(F.explode("v").alias("a"), "v").select("a", F.explode(F.filter("v", lambda x: x > F.col("a"))).alias("b"))
    return pairs.groupBy("a", "b").agg(F.count("*").alias("n"))


def portfolio_summary(positions: DataFrame, *by: str, pct: Column | None = None) -> DataFrame:
    """Of positions (symbol, invested, value): invested, pnl, its percentage, best and worst symbol, and a risk by how many there are.

    Best and worst go by `pct` where it is known exactly, else by what value and invested give, to nine places: what is equal but for
    rounding ties, and the larger symbol is the best of a tie, the smaller one the worst. Positions without a percentage are neither.
    """
    pnl = F.col("value") - F.col("invested")
    pct = F.round(F.try_divide(pnl, F.col("invested")) * 100, 9) if pct is None else pct
    place = F.when(pct.isNotNull(), F.struct(pct, "symbol"))
    n = F.count("*")
    return positions.groupBy(*by).agg(
        F.sum("invested").alias("invested"), F.sum(pnl).alias("pnl"), (F.try_divide(F.sum(pnl), F.sum("invested")) * 100).alias("pnl_pct"), F.max_by("symbol", place).alias("best"),
        F.min_by("symbol", place).alias("worst"), F.when(n > 5, "high").when(n > 3, "medium").otherwise("low").alias("risk"),
    )


def risk_rules(pnl_pct: Column, loss_limit: float, profit_limit: float) -> Column:
    """close_loss at or below the loss limit, close_profit at or above the profit limit, else hold."""
    return F.when(pnl_pct <= -abs(loss_limit), "close_loss").when(pnl_pct >= profit_limit, "close_profit").otherwise("hold")


def safety_violations(long: Column, rsi: Column, adx: Column, pnl_pct: Column, *, rsi_long: float, rsi_short: float, adx_min: float, most_drawdown: float) -> Column:
    """Names of the rules that a position breaks: RSI above a bound if long, below one if short, a weak trend, a result too far from 0.

    Indicators need 15 closes or more (see `market.rsi_simple` and `market.pseudo_adx`).
    """
    rules = ((long & (rsi > rsi_long), "rsi_high"), (~long & (rsi < rsi_short), "rsi_low"), (adx < adx_min, "adx_low"), (F.abs(pnl_pct) > most_drawdown, "drawdown"))
    return F.array_compact(F.array(*(F.when(c, F.lit(name)) for c, name in rules)))


def derivatives_ok(open_interest: Column, funding: Column, cvd: Column, least_interest: float, most_funding: float = 0.05, least_cvd: float = 0.0) -> Column:
    """Open interest, funding and volume delta within their bounds; what is null passes."""
    return F.coalesce(open_interest >= least_interest, F.lit(True)) & F.coalesce(F.abs(funding) <= most_funding, F.lit(True)) & F.coalesce(F.abs(cvd) >= least_cvd, F.lit(True))


def coin_labels(rsi: Column, adx: Column, volatility: Column, close: Column, upper: Column, lower: Column) -> Column:
    """(momentum, trend, volatility, band): RSI against 70 and 30, ADX against 25, volatility against 0.05 and 0.02, place in the bands."""
    return F.struct(
        F.when(rsi > 70, "overbought").when(rsi < 30, "oversold").otherwise("neutral").alias("momentum"),
        F.when(adx > 25, "strong").otherwise("weak").alias("trend"),
        F.when(volatility > 0.05, "high").when(volatility > 0.02, "medium").otherwise("low").alias("volatility"),
        F.when(close > upper, "above").when(close < lower, "below").otherwise("within").alias("band"),
    )


def streaks(df: DataFrame, by: str, order: list[str], hit: Column) -> DataFrame:
    """Adds streak: how many rows up to this one meet a condition in a row."""
    w = Window.partitionBy(by).orderBy(*order)
    df = df.withColumn("__tm_h", F.coalesce(hit, F.lit(False)).cast("int"))
    df = df.withColumn("__tm_g", F.sum(1 - F.col("__tm_h")).over(w))
    return df.withColumn("streak", F.sum("__tm_h").over(Window.partitionBy(by, "__tm_g").orderBy(*order))).drop("__tm_h", "__tm_g")


def previous_sessions(summaries: DataFrame, by: str, ts: str, id_col: str, n: int = 5) -> DataFrame:
    """(id_col, previous, place): up to n earlier sessions of the same chat, the latest first."""
    w = Window.partitionBy(by).orderBy(ts, id_col).rowsBetween(-n, -1)
    return summaries.select(id_col, F.reverse(F.collect_list(id_col).over(w)).alias("p")).select(id_col, F.posexplode("p").alias("place", "previous")).withColumn("place", F.col("place") + 1)


def bipartite(documents: DataFrame, id_col: str, **arrays: str) -> DataFrame:
    """(source, kind, target, weight): an edge from each document to each value of its arrays, counted."""
    out = None
    for kind, column in arrays.items():
        one = documents.select(F.col(id_col).alias("source"), F.lit(kind).alias("kind"), F.explode(F.col(column).cast("array<string>")).alias("target"))
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no array")
    return out.groupBy("source", "kind", "target").agg(F.count("*").alias("weight"))


def prune(scores: DataFrame, target: int, order: str = "highest", keep: Column | None = None) -> DataFrame:
    """Rows (id, score) to remove so that `target` are left: those of the highest or the lowest score. Rows to keep are never removed."""
    total = scores.count()
    free = scores if keep is None else scores.where(~keep)
    by = F.desc("score") if order == "highest" else F.asc("score")
    return free.orderBy(by, "id").limit(max(0, total - target))


def source_quality(source: Column, chat: Column) -> Column:
    """By the kind of source, else 0.5; 0.05 more with a chat; at most 1."""
    kind = F.lower(F.coalesce(source, F.lit("")))
    base = F.when(kind.isin("official", "news", "trusted"), 1.0).when(kind.isin("user", "unknown"), 0.3).when(kind.isin("social", "telegram", "chat"), 0.6).otherwise(0.5)
    return F.least(F.lit(1.0), base + F.when(F.coalesce(chat, F.lit("")) != "", 0.05).otherwise(0.0))


def dominant(edges: DataFrame, kind: str) -> DataFrame:
    """One row: the target of most edges of a kind, how many, and the heaviest edge; ties go to the smaller name."""
    counted = edges.where(F.col("kind") == kind).groupBy("target").agg(F.sum("weight").alias("n"), F.max(F.struct("weight", "source")).alias("w"))
    return counted.agg(F.min_by("target", F.struct(-F.col("n"), "target")).alias("dominant"), F.max("n").alias("n"), F.max("w.weight").alias("heaviest"))


def cluster_metadata(sessions_: DataFrame, by: str, n: int = 5) -> DataFrame:
    """(by, chat, first, last, days, messages, topics): the most frequent chat and topics of a cluster's sessions (chat, start, end, n, topics)."""
    base = sessions_.groupBy(by).agg(F.min("start").alias("first"), F.max("end").alias("last"), F.sum("n").alias("messages"))
    chats = sessions_.groupBy(by, "chat").agg(F.count("*").alias("c")).groupBy(by).agg(F.min_by("chat", F.struct(-F.col("c"), "chat")).alias("chat"))
    topic = top_per_group(sessions_.select(by, F.explode("topics").alias("value")).groupBy(by, "value").agg(F.count("*").alias("n")), by, n)
    topics = topic.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "value"))), lambda x: x["value"]).alias("topics"))
    days = F.timestamp_diff("SECOND", F.col("first"), F.col("last")) / 86400
    return base.join(chats, by, "left").join(topics, by, "left").withColumn("days", days)


def importance_summary(scores: DataFrame, value: str) -> DataFrame:
    """One row: n, and average, least and largest score to three digits."""
    r = lambda c: F.round(c, 3)
    return scores.agg(F.count(value).alias("n"), r(F.avg(value)).alias("average"), r(F.min(value)).alias("least"), r(F.max(value)).alias("largest"))


def comparison(analyses: DataFrame, by: str, ts: str, score: str, *ties: str) -> DataFrame:
    """(by, n, first, last, change, trend): the first against the last analysis of each key; improved, declined or stable."""
    order = F.struct(ts, *ties)
    out = analyses.groupBy(by).agg(F.count("*").alias("n"), F.min_by(score, order).alias("first"), F.max_by(score, order).alias("last"))
    change = F.col("last") - F.col("first")
    return out.withColumn("change", change).withColumn("trend", F.when(change > 0, "improved").when(change < 0, "declined").otherwise("stable"))
