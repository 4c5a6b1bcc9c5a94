"""Sessions, chunks and calendar groups of messages (id, by, ts, ..).

Gap rules are windows. Rules that depend on what the current group holds so far (its start, its tokens, its ids) are folds over a
group's messages in order: one pass over Arrow batches, whose state is a few numbers, so that a long chat streams through.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from datetime import timedelta
from zoneinfo import ZoneInfo

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType


def fold(df: DataFrame, by: str, order: list[str], start: Callable[[dict], dict], breaks: Callable[[dict, dict], bool], add: Callable[[dict, dict], None], columns: list[str], out: str = "group_no") -> DataFrame:
    """Adds `out`: the number, from 0, of each row's group within `by`.

    `start(row)` is the state of a group that begins with a row, `breaks(state, row)` whether a row begins a new one, and
    `add(state, row)` takes a row in. Rows get the columns named. They stream in order; of a key only the state is held.
    """
    wanted = [by, *columns]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, n = object(), None, 0
        for batch in batches:
            numbers = []
            for row in batch.select(wanted).to_pylist():
                if row[by] != key:
                    key, state, n = row[by], start(row), 0
                elif breaks(state, row):
                    state, n = start(row), n + 1
                else:
                    add(state, row)
                numbers.append(n)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(numbers, pa.int64())], names=[*batch.schema.names, out])

    dealt = df.repartition(by).sortWithinPartitions(by, *order)
    return dealt.mapInArrow(run, StructType([*df.schema.fields, StructField(out, LongType())]))


def gap_sessions(df: DataFrame, by: str, ts: str, minutes: float, *ties: str, out: str = "session_no") -> DataFrame:
    """Adds the number of the session, from 0: a new one begins after a gap of more than so many minutes."""
    w = Window.partitionBy(by).orderBy(ts, *ties)
    df = df.withColumn("__tm_p", F.lag(ts).over(w))
    new = F.coalesce(F.timestamp_diff("MICROSECOND", F.col("__tm_p"), F.col(ts)) > int(minutes * 60_000_000), F.lit(False))
    return df.withColumn("__tm_n", new.cast("long")).withColumn(out, F.sum("__tm_n").over(w)).drop("__tm_p", "__tm_n")


def capped_sessions(df: DataFrame, by: str, ts: str, *ties: str, gap_minutes: int = 120, most_hours: float = 6, night: tuple[int, int] = (0, 540), zone: str = "Europe/Moscow") -> DataFrame:
    """Adds session_no: a new session after a gap, unless either end of it is at night (local minutes of the day); and, in any
    case, once a session is `most_hours` old.
    """
    tz, utc = ZoneInfo(zone), ZoneInfo("UTC")

    def at_night(t) -> bool:  # noqa: ANN001
        local = t.replace(tzinfo=utc).astimezone(tz)
        return night[0] <= local.hour * 60 + local.minute < night[1]

    def breaks(s: dict, r: dict) -> bool:
        t = r[ts]
        apart = t - s["last"] > timedelta(minutes=gap_minutes) and not (at_night(s["last"]) or at_night(t))
        return apart or t - s["start"] >= timedelta(hours=most_hours)

    return fold(df, by, [ts, *ties], lambda r: {"start": r[ts], "last": r[ts]}, breaks, lambda s, r: s.update(last=r[ts]), [ts], "session_no")


def session_summary(df: DataFrame, by: str, ts: str, author: str, session: str = "session_no") -> DataFrame:
    """(by, session, session_id, start, last, n, minutes, participants)."""
    out = df.groupBy(by, session).agg(F.min(ts).alias("start"), F.max(ts).alias("last"), F.count("*").alias("n"), F.sort_array(F.collect_set(author)).alias("participants"))
    minutes = F.round(F.timestamp_diff("SECOND", F.col("start"), F.col("last")) / 60, 1)
    return out.withColumn("minutes", minutes).withColumn("session_id", F.format_string("%s-S%04d", F.col(by), F.col(session) + 1))


def chunks(df: DataFrame, by: str, ts: str, id_col: str, *, author: str = "author", text: str = "text", reply_to: str = "reply_to", gap_minutes: int = 10, reply_gap_minutes: int = 120, most_tokens: int = 4000, same_author: bool = False, stops: tuple[str, ...] = (r"^#новая тема", r"^\[ANN\]", r"^Summary:")) -> DataFrame:
    """Adds chunk_no. Of repeated ids in a chat the first message counts and the others go.

    A message begins a new chunk if its text matches a stop pattern, if its author differs (where that matters), if the chunk's tokens
    would pass the budget (a quarter of the characters, 1 at least), or after a gap: a longer one is allowed for a reply to a message
    of the chunk.
    """
    from .dedup import first_by_key

    stop = [re.compile(p, re.IGNORECASE) for p in stops]
    tokens = lambda r: max(1, len(r[text] or "") // 4)
    df = first_by_key(df, F.struct(by, id_col), ts, id_col)

    def breaks(s: dict, r: dict) -> bool:
        if any(p.search(r[text] or "") for p in stop) or (same_author and r[author] not in s["authors"]) or s["tokens"] + tokens(r) > most_tokens:
            return True
        limit = reply_gap_minutes if r[reply_to] is not None and r[reply_to] in s["ids"] else gap_minutes
        return r[ts] - s["last"] > timedelta(minutes=limit)

    def add(s: dict, r: dict) -> None:
        s["ids"].add(r[id_col])
        s["authors"].add(r[author])
        s["tokens"] += tokens(r)
        s["last"] = r[ts]

    start = lambda r: {"ids": {r[id_col]}, "authors": {r[author]}, "tokens": tokens(r), "last": r[ts]}
    return fold(df, by, [ts, id_col], start, breaks, add, [ts, id_col, author, text, reply_to], "chunk_no")


def merge_short(df: DataFrame, by: str, ts: str, text: str, *ties: str, most: int = 50, within_seconds: int = 60) -> DataFrame:
    """(by, ts, text, n): runs of short messages, each within a minute of the one before, as one; long ones stay alone."""
    w = Window.partitionBy(by).orderBy(ts, *ties)
    df = df.withColumn("__tm_short", F.length(F.coalesce(text, F.lit(""))) <= most)
    gap = F.timestamp_diff("MICROSECOND", F.lag(ts).over(w), F.col(ts)) <= within_seconds * 1_000_000
    joined = F.coalesce(F.col("__tm_short") & F.lag("__tm_short").over(w) & gap, F.lit(False))
    df = df.withColumn("__tm_new", (~joined).cast("int")).withColumn("__tm_run", F.sum("__tm_new").over(w))
    parts = F.array_sort(F.collect_list(F.struct(ts, *ties, F.coalesce(text, F.lit("")).alias("__tm_t"))))
    return df.groupBy(by, "__tm_run").agg(F.min(ts).alias(ts), F.trim(F.concat_ws(" ", F.transform(parts, lambda p: p["__tm_t"]))).alias(text), F.count("*").alias("n")).drop("__tm_run")


def until_minimum(groups: DataFrame, by: str, order: str, n: str, least: int, out: str = "merged_no") -> DataFrame:
    """Adds `out` to ordered groups with their sizes: neighbours are merged until a group holds `least` or more."""
    return fold(groups, by, [order], lambda r: {"n": r[n]}, lambda s, r: s["n"] >= least, lambda s, r: s.update(n=s["n"] + r[n]), [n], out)


def within_budget(groups: DataFrame, by: str, order: str, size: str, most: int, out: str = "merged_no") -> DataFrame:
    """Adds `out`: neighbours are merged while their sizes add up to `most` or less."""
    return fold(groups, by, [order], lambda r: {"n": r[size]}, lambda s, r: s["n"] + r[size] > most, lambda s, r: s.update(n=s["n"] + r[size]), [size], out)


def day_groups(df: DataFrame, by: str, ts: str, *ties: str, break_hours: float = 4, late: bool = False) -> DataFrame:
    """Adds session_no by natural breaks: a message after a gap of more than so many hours begins a group.

    With `late` it still belongs to the group before, and the next one begins the new group.
    """
    out = gap_sessions(df, by, ts, break_hours * 60, *ties, out="__tm_s")
    if not late:
        return out.withColumnRenamed("__tm_s", "session_no")
    w = Window.partitionBy(by).orderBy(ts, *ties)
    return out.withColumn("session_no", F.coalesce(F.lag("__tm_s").over(w), F.lit(0))).drop("__tm_s")


def fixed_count(df: DataFrame, by: str, order: list[str], n: int, out: str = "part_no") -> DataFrame:
    """Adds `out`: every n rows of a group in order are a part, from 0."""
    place = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    return df.withColumn(out, F.floor((place - 1) / n))


def split_long(df: DataFrame, by: list[str], ts: str, *ties: str, most_hours: float = 6) -> DataFrame:
    """Adds part_no: a session of h hours has floor(h / most) + 1 parts of equally many messages, the last with the remainder."""
    w = Window.partitionBy(*by)
    hours = F.timestamp_diff("SECOND", F.min(ts).over(w), F.max(ts).over(w)) / 3600
    parts = F.floor(hours / most_hours) + 1
    each = F.greatest(F.floor(F.count(F.lit(1)).over(w) / parts), F.lit(1))
    place = F.row_number().over(w.orderBy(ts, *ties))
    return df.withColumn("part_no", F.least(F.floor((place - 1) / each), parts - 1))


def symmetric_context(df: DataFrame, by: str, ts: str, text: str, *ties: str, each: int = 5, most_chars: int = 1500) -> DataFrame:
    """Adds context: up to `each` texts before and after, without the row's own and blank ones, nearest first while they fit into
    the budget, joined in order of time by " | ".
    """
    w = Window.partitionBy(by).orderBy(ts, *ties)
    before = F.reverse(F.collect_list(F.coalesce(text, F.lit(""))).over(w.rowsBetween(-each, -1)))
    after = F.collect_list(F.coalesce(text, F.lit(""))).over(w.rowsBetween(1, each))
    df = df.withColumn("__tm_b", before).withColumn("__tm_a", after)
    place = F.sequence(F.lit(1), F.lit(each))
    one = lambda side, sign: F.transform(place, lambda k: F.struct((k * sign).alias("k"), F.get(F.col(side), k - 1).alias("t")))
    near = F.flatten(F.transform(place, lambda k: F.array(F.element_at(one("__tm_b", -1), k), F.element_at(one("__tm_a", 1), k))))
    near = F.filter(near, lambda e: F.coalesce(F.trim(e["t"]) != "", F.lit(False)))
    zero = F.struct(F.lit(0).alias("n"), F.array().cast("array<struct<k:int,t:string>>").alias("c"))
    kept = F.aggregate(near, zero, lambda s, e: F.when(s["n"] + F.length(e["t"]) <= most_chars, F.struct((s["n"] + F.length(e["t"])).alias("n"), F.array_append(s["c"], e).alias("c"))).otherwise(s), lambda s: F.array_sort(s["c"]))
    return df.withColumn("context", F.concat_ws(" | ", F.transform(kept, lambda e: e["t"]))).drop("__tm_b", "__tm_a")


def silence(df: DataFrame, by: str, ts: str, *ties: str) -> DataFrame:
    """(by, avg_hours, max_hours, min_hours, over_day, over_week) of the gaps between messages."""
    gap = F.timestamp_diff("SECOND", F.lag(ts).over(Window.partitionBy(by).orderBy(ts, *ties)), F.col(ts)) / 3600
    return df.select(by, gap.alias("h")).where("h is not null").groupBy(by).agg(F.avg("h").alias("avg_hours"), F.max("h").alias("max_hours"), F.min("h").alias("min_hours"), F.count_if(F.col("h") > 24).alias("over_day"), F.count_if(F.col("h") > 168).alias("over_week"))


def activity(df: DataFrame, by: str, ts: str) -> DataFrame:
    """(by, per_day, level): messages a day; above 50 high, above 10 medium, else low. A span of less than a day counts as one."""
    days = F.greatest(F.expr(f"timestampdiff(SECOND, min({ts}), max({ts}))") / 86400, F.lit(1.0))
    out = df.groupBy(by).agg((F.count("*") / days).alias("per_day"))
    return out.withColumn("level", F.when(F.col("per_day") > 50, "high").when(F.col("per_day") > 10, "medium").otherwise("low"))


def chat_type(df: DataFrame, by: str, author: str) -> DataFrame:
    """(by, kind): channel if less than 30 % have an author, group if more than 5 authors, else chat."""
    return df.groupBy(by).agg(F.when(F.count(author) / F.count("*") < 0.3, "channel").when(F.count_distinct(author) > 5, "group").otherwise("chat").alias("kind"))


def peak(df: DataFrame, by: str, value: Column, n: int) -> DataFrame:
    """(by, value, n, rank): the n most frequent values of each group; ties go to the smaller one."""
    counted = df.groupBy(by, value.alias("value")).agg(F.count("*").alias("n"))
    return counted.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("n"), "value"))).where(F.col("rank") <= n)


def pattern_split(df: DataFrame, by: str, ts: str, *ties: str, peaks: int = 3, zone: str = "UTC") -> DataFrame:
    """Adds session_no: a new one where the local time enters the night (0 to 9), or leaves one of the group's most frequent hours."""
    local = F.hour(F.from_utc_timestamp(F.col(ts).cast("timestamp"), zone))
    df = df.withColumn("__tm_h", local)
    top = peak(df, by, F.col("__tm_h"), peaks).groupBy(by).agg(F.collect_set("value").alias("__tm_top"))
    w = Window.partitionBy(by).orderBy(ts, *ties)
    df = df.join(top, by).withColumn("__tm_p", F.lag("__tm_h").over(w))
    into_night = (F.col("__tm_h") < 9) & (F.col("__tm_p") >= 9)
    off_peak = F.array_contains("__tm_top", F.col("__tm_p")) & ~F.array_contains("__tm_top", F.col("__tm_h"))
    new = F.coalesce(into_night | off_peak, F.lit(False)).cast("long")
    return df.withColumn("__tm_n", new).withColumn("session_no", F.sum("__tm_n").over(w)).drop("__tm_h", "__tm_top", "__tm_p", "__tm_n")


def new_day(start: Column, end: Column, zone: str = "UTC") -> Column:
    """Whether a span is over 24 hours, or changes its local date with a gap of more than 2 hours."""
    seconds = F.timestamp_diff("SECOND", start, end)
    date = lambda t: F.to_date(F.from_utc_timestamp(t.cast("timestamp"), zone))
    return (seconds > 24 * 3600) | ((date(start) != date(end)) & (seconds > 2 * 3600))


def embedding_groups(df: DataFrame, by: str, order: list[str], n: int, least: int) -> DataFrame:
    """Rows in parts of n, without parts that hold fewer than `least`."""
    parts = fixed_count(df, by, order, n)
    held = F.count(F.lit(1)).over(Window.partitionBy(by, "part_no"))
    return parts.withColumn("__tm_c", held).where(F.col("__tm_c") >= least).drop("__tm_c")


def hybrid_groups(df: DataFrame, by: str, ts: str, size: str, *ties: str, window: str = "day", most: int = 4000) -> DataFrame:
    """(by, period, part_no, n, size): calendar windows (day, week, month), cut where the sizes of a window's rows pass a budget."""
    period = F.date_format(F.date_trunc(window, F.col(ts).cast("timestamp")), "yyyy-MM-dd")
    rows = df.withColumn("period", period).withColumn("__tm_key", F.concat_ws("|", F.col(by).cast("string"), "period"))
    cut = within_budget(rows, "__tm_key", ts, size, most, "part_no") if not ties else fold(rows, "__tm_key", [ts, *ties], lambda r: {"n": r[size]}, lambda s, r: s["n"] + r[size] > most, lambda s, r: s.update(n=s["n"] + r[size]), [size], "part_no")
    return cut.groupBy(by, "period", "part_no").agg(F.count("*").alias("n"), F.sum(size).alias("size"))


def expanded_days(df: DataFrame, by: str, ts: str, *ties: str, break_hours: float = 4, least: int = 5) -> DataFrame:
    """(by, day, part_no, parent_id, child_id, n, start, end): each day's messages by natural breaks, small neighbours merged until they hold `least`.

    A parent is a day; children number its parts from 1.
    """
    day = F.date_format(F.col(ts).cast("timestamp"), "yyyy-MM-dd")
    rows = df.withColumn("day", day).withColumn("__tm_key", F.concat_ws("|", F.col(by).cast("string"), "day"))
    cut = day_groups(rows, "__tm_key", ts, *ties, break_hours=break_hours)
    parts = cut.groupBy(by, "day", "__tm_key", "session_no").agg(F.count("*").alias("n"), F.min(ts).alias("start"), F.max(ts).alias("end"))
    merged = until_minimum(parts, "__tm_key", "session_no", "n", least, "part_no")
    out = merged.groupBy(by, "day", "part_no").agg(F.sum("n").alias("n"), F.min("start").alias("start"), F.max("end").alias("end"))
    number = F.row_number().over(Window.partitionBy(by, "day").orderBy("part_no"))
    parent = F.concat_ws("-", F.col(by).cast("string"), "day")
    return out.select(by, "day", number.alias("part_no"), parent.alias("parent_id"), F.format_string("%s-%02d", parent, number).alias("child_id"), "n", "start", "end")
