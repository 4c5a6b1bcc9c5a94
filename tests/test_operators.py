"""Operators on small frames whose results are worked out by hand, and properties that always hold."""

from __future__ import annotations

import math
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions import market as M
from tidemark.functions import text as X
from tidemark.functions import time as TM
from tidemark.operators import dedup as D
from tidemark.operators import graph as G
from tidemark.operators import market as K
from tidemark.operators import search as S
from tidemark.operators import sessions as N
from tidemark.operators import telemetry as T
from tidemark.operators import vectors as V
from tidemark.sources import readers as R
from tidemark.sources import sinks as W

START = datetime(2024, 1, 1, 12)


def one(spark, *columns):
    return spark.range(1).select(*(c.alias(f"c{k}") for k, c in enumerate(columns))).first()


def test_dirty_text(spark):
    assert one(spark, X.normalize(F.lit("<b>Hello</b> \U0001f600 [source: tg]")))[0] == "Hello"
    assert one(spark, X.normalize(F.lit(None).cast("string")))[0] == ""
    assert one(spark, X.normalize(F.lit("a &lt;b&gt; c &amp; d")))[0] == "a c & d"


def test_entities(spark):
    text = "@Ann @ann buy SOLUSDT and $ETH or XYZ at https://a.b:80/x?y=1 on 31.12.2024 at 10:30 for 3,5 USD see doc.pdf t.me/room @helperbot"
    t = F.lit(text)
    got = one(spark, X.mentions(t), X.tickers(t, ["SOL", "ETH"]), X.domains(X.urls(t)), X.dates(t), X.times(t), X.files(t), X.telegram(t), X.numbers(t))
    assert got[0] == ["Ann", "helperbot"]
    assert got[1] == ["SOLUSDT", "ETH"]
    assert got[2] == ["a.b:80"]
    assert got[3] == ["2024-12-31"]
    assert got[4] == ["10:30"]
    assert got[5] == ["doc.pdf"]
    assert got[6].bots == ["helperbot"]
    assert got[6].groups == ["room"]
    assert (3.5, "3,5", "USD") in [tuple(n) for n in got[7]]


def test_slug_url_and_language(spark):
    got = one(spark, X.slug(F.lit("Привет, Мир!")), X.slug(F.lit("")), X.clean_url(F.lit(" example.com/a ")), X.clean_url(F.lit("http://[bad")), X.language(F.lit("привет ab")), X.language(F.lit("12")))
    assert got[0] == "privet_mir"
    assert got[1] == "unnamed"
    assert got[2] == "https://example.com/a"
    assert got[3] is None
    assert (got[4], got[5]) == ("ru", None)


def test_message_filters(spark):
    null = F.lit(None).cast("string")
    got = one(spark, X.is_service(null, F.lit("Joined the group")), X.is_service(F.lit("pin_message"), null), X.is_bot_spam(F.lit("newsBot"), F.lit("12 + 4")), X.is_bot_spam(F.lit("ann"), F.lit("12 + 4")), X.is_bot_spam(null, F.lit("/START")), X.is_empty(F.lit("  "), null, null))
    assert list(got) == [True, True, True, False, True, True]


def test_week_keys_at_the_end_of_a_year(spark):
    ts = F.lit(datetime(2024, 12, 30))
    assert list(one(spark, TM.bucket_key(ts, "week"), TM.iso_week_key(ts))) == ["2024-W01", "2025-W01"]


@pytest.mark.parametrize("dim", [64, 384])
def test_hash_embedding_is_md5_modulo(spark, dim):
    import hashlib

    words = ["a", "b", "a", "слово", ""]
    got = one(spark, X.hash_embedding(F.array(*map(F.lit, words)), dim))[0]
    want = np.zeros(dim)
    for w in words:
        want[int(hashlib.md5(w.encode()).hexdigest(), 16) % dim] += 1
    assert np.allclose(got, want / np.linalg.norm(want))


def test_p95_of_twenty_is_the_twentieth(spark):
    df = spark.createDataFrame([(float(k),) for k in range(20)], "s double")
    assert T.timing_summary(df, seconds="s").first().p95_ms == 19000.0


def test_conditions_are_parsed_not_evaluated():
    assert T.parse_condition("error_rate > 0.1") == ("error_rate", ">", 0.1)
    for bad in ("__import__('os')", "a > b", "a >", "a > 1 or 1 > 0"):
        with pytest.raises(ValueError, match="comparison"):
            T.parse_condition(bad)
    assert (T.window_days("14d"), T.window_days("0d"), T.window_days("x")) == (14, 1, 7)


def test_health_of_nothing_and_of_some(spark):
    none = spark.createDataFrame([], "status string, last_check timestamp_ntz")
    assert T.overall_health(none).first().status == "unknown"
    rows = [("healthy", START), ("bad", START)]
    got = T.overall_health(spark.createDataFrame(rows, "status string, last_check timestamp_ntz")).first()
    assert (got.status, got.healthy, got.unhealthy) == ("degraded", 1, 1)


def test_latest_keeps_ties(spark):
    df = spark.createDataFrame([("a", 1, 1), ("a", 2, 2), ("a", 2, 3), ("b", 0, 4)], "k string, t int, id int")
    assert sorted(r.id for r in T.latest_per_key(df, "k", "t").collect()) == [2, 3, 4]


def test_rating_ladder(spark):
    rate = lambda c: M.bollinger_rating(F.lit(c), F.lit(120.0), F.lit(100.0), F.lit(80.0))
    assert list(one(spark, *map(rate, (121.0, 111.0, 101.0, 100.0, 99.0, 89.0, 79.0)))) == [3, 2, 1, 0, -1, -2, -3]


def test_flat_series_trips_no_guard(spark):
    df = spark.createDataFrame([("x", START + timedelta(days=k), 100.0, 105.0, 95.0, 102.0, 1000.0) for k in range(60)], "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double")
    out = K.smoothed(df).orderBy("ts").collect()
    assert {r.rsi for r in out} == {50.0}
    assert K.rsi_simple(df).orderBy(F.desc("ts")).first().rsi == 100.0
    assert {r.z for r in K.zscore(df, "volume").collect()} == {0.0}
    assert K.bollinger(df).orderBy(F.desc("ts")).first().upper == 102.0
    assert K.volume_profile(df).count() == 1


def test_trades_begin_at_a_change_and_need_two_bars(spark):
    positions, prices = [0, 0, 1, 1, -1, 0, 1], [10.0, 11.0, 12.0, 13.0, 14.0, 15.0, 16.0]
    df = spark.createDataFrame([("x", START + timedelta(days=k), p, float(q)) for k, (p, q) in enumerate(zip(prices, positions, strict=True))], "symbol string, ts timestamp_ntz, close double, position double")
    got = [(r.entry_price, r.exit_price, r.position, r.duration_bars) for r in K.trades(df).orderBy("entry_time").collect()]
    assert got == [(12.0, 14.0, 1.0, 3), (14.0, 15.0, -1.0, 2)]


def test_equity_of_total_loss(spark):
    df = spark.createDataFrame([("x", START + timedelta(days=k), c, p) for k, (c, p) in enumerate([(10.0, 0.0), (30.0, -1.0), (33.0, 1.0)])], "symbol string, ts timestamp_ntz, close double, position double")
    assert [round(r.equity, 9) for r in K.simulate(df).orderBy("ts").collect()] == [1.0, -1.0, -1.1]
    df = df.withColumn("close", F.when(F.col("close") == 30, 20.0).otherwise(F.col("close")))
    assert [r.equity for r in K.simulate(df).orderBy("ts").collect()] == [1.0, 0.0, 0.0]


def test_average_cost(spark):
    rows = [("a", 1, "BUY", 10.0, 100.0), ("a", 2, "SELL", 4.0, 150.0), ("a", 3, "BUY", 6.0, 200.0), ("a", 4, "SELL", 100.0, 1.0), ("a", 5, "SELL", 1.0, 1.0), ("b", 1, "BUY", 2.0, 5.0)]
    got = {r.k: (r.remaining, r.entry_price) for r in K.average_cost(spark.createDataFrame(rows, "k string, t int, side string, qty double, price double"), "k", "t").collect()}
    assert got == {"a": (0.0, None), "b": (2.0, 5.0)}


def test_signal_metrics_and_null_directions(spark):
    rows = [("s", "long", 100.0, 80.0, 3.0, 200.0, 95.0, [110.0, 120.0]), ("s", None, 100.0, 80.0, 3.0, 200.0, 95.0, [])]
    df = spark.createDataFrame(rows, "symbol string, direction string, entry double, confidence double, leverage double, position_size double, stop_loss double, take_profit array<double>")
    a, b = K.signal_metrics(df).first(), K.signal_metrics(df, null_is_short=True).first()
    assert (a.total_signals, a.short_signals, a.avg_stop_loss_pct, a.avg_take_profit_pct) == (1, 0, 5.0, 15.0)
    assert (b.total_signals, b.short_signals) == (2, 1)


def test_short_messages_merge(spark):
    rows = [("c", START, "hi"), ("c", START + timedelta(seconds=30), "there"), ("c", START + timedelta(minutes=5), "long message")]
    got = N.merge_short(spark.createDataFrame(rows, "chat string, ts timestamp_ntz, text string"), "chat", "ts", "text", most=5).orderBy("ts").collect()
    assert [r.text for r in got] == ["hi there", "long message"]


def test_a_gap_of_just_the_limit_stays(spark):
    rows = [("c", START + timedelta(minutes=m), k) for k, m in enumerate((0, 120, 241))]
    df = spark.createDataFrame(rows, "chat string, ts timestamp_ntz, id int")
    assert [r.session_no for r in N.gap_sessions(df, "chat", "ts", 120).orderBy("ts").collect()] == [0, 0, 1]


def test_night_joins_and_the_cap_splits(spark):
    base = datetime(2024, 1, 1, 20)  # 23:00 in Moscow
    hours = (0, 2.5, 5.9, 6.5)
    df = spark.createDataFrame([("c", base + timedelta(hours=h), k) for k, h in enumerate(hours)], "chat string, ts timestamp_ntz, id int")
    assert [r.session_no for r in N.capped_sessions(df, "chat", "ts", "id").orderBy("ts").collect()] == [0, 0, 0, 1]


def test_chunks_reply_and_stop(spark):
    m = lambda k, minute, text, reply=None, author="a": ("c", START + timedelta(minutes=minute), k, author, text, reply)
    rows = [m(1, 0, "one"), m(2, 5, "two"), m(3, 100, "answer", 1), m(4, 130, "late"), m(5, 131, "[ANN] news"), m(2, 132, "again")]
    df = spark.createDataFrame(rows, "chat string, ts timestamp_ntz, id int, author string, text string, reply_to int")
    got = {r.id: r.chunk_no for r in N.chunks(df, "chat", "ts", "id").collect()}
    assert got == {1: 0, 2: 0, 3: 0, 4: 1, 5: 2}


def test_context_takes_the_nearest(spark):
    df = spark.createDataFrame([("c", START + timedelta(minutes=k), k, t) for k, t in enumerate(("aaaa", "", "bb", "me", "cc", "dddd"))], "chat string, ts timestamp_ntz, id int, text string")
    got = {r.id: r.context for r in N.symmetric_context(df, "chat", "ts", "text", "id", each=3, most_chars=8).collect()}
    assert got[3] == "bb | cc | dddd"


def test_merging_until_a_minimum(spark):
    df = spark.createDataFrame([("c", k, n) for k, n in enumerate((3, 8, 15, 1, 2))], "chat string, k int, n int")
    assert [r.merged_no for r in N.until_minimum(df, "chat", "k", "n", 10).orderBy("k").collect()] == [0, 0, 1, 2, 2]
    assert [r.merged_no for r in N.within_budget(df, "chat", "k", "n", 12).orderBy("k").collect()] == [0, 0, 1, 2, 2]


def test_repeats_in_a_row(spark):
    df = spark.createDataFrame([("c", k, t) for k, t in enumerate(("Hello", "Hello", "Hello", "World", None, None))], "chat string, k int, text string")
    assert [r.text for r in D.consecutive(df, "chat", "k", F.col("text"), 1).orderBy("k").collect()] == ["Hello", "Hello", "World", None, None]


def test_first_of_each_id_and_rows_without(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c"), (None, "d"), (2, "e")], "id long, text string")
    assert sorted(r.text for r in D.first_by_key(df, F.col("id"), "text").collect()) == ["a", "c", "d", "e"]
    assert sorted(r.text for r in D.first_by_key(df, F.col("id"), "text", keep_null=False).collect()) == ["a", "e"]


@given(st.lists(st.tuples(st.one_of(st.none(), st.integers(0, 4)), st.text("ab", max_size=2)), max_size=12))
@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_dedup_is_idempotent(spark, rows):
    df = spark.createDataFrame(rows, "id long, text string")
    once = D.first_by_key(df, F.col("id"), "text")
    twice = D.first_by_key(once, F.col("id"), "text")
    assert sorted(map(str, once.collect())) == sorted(map(str, twice.collect()))


@given(st.lists(st.floats(-5, 5, allow_nan=False), min_size=2, max_size=40))
@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_smoothing_is_that_of_pandas(spark, values):
    prices = 100 + np.cumsum(values)
    df = spark.createDataFrame([("x", START + timedelta(days=k), float(p), float(p) + 1, float(p) - 1, float(p), 1.0) for k, p in enumerate(prices)], "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double")
    got = [r.ema_fast for r in K.smoothed(df).orderBy("ts").collect()]
    assert np.allclose(got, pd.Series(prices).ewm(span=9, adjust=False).mean())


def test_fusion_ignores_the_order_of_rows(spark):
    a = [(k, float(s)) for k, s in ((1, 9), (2, 8), (3, 8))]
    b = [(3, 5.0), (1, 4.0)]
    rrf = lambda x, y: {r.id: (round(r.score, 12), r.rank_1, r.rank_2) for r in S.rrf([spark.createDataFrame(x, "id long, score double"), spark.createDataFrame(y, "id long, score double")], [0.6, 0.4]).collect()}
    got = rrf(a, b)
    assert got == rrf(a[::-1], b[::-1])
    assert got[1] == (round(0.6 / 61 + 0.4 / 62, 12), 1, 2)
    assert got[2][2] is None


def test_cosine_pads_and_zero_is_like_nothing(spark):
    arr = lambda *x: F.array(*(F.lit(float(v)) for v in x))
    assert list(one(spark, S.cosine(arr(1, 0, 0), arr(1)), S.cosine(arr(0, 0), arr(1, 1)), S.cosine(arr(1, 1), arr(1, -1)))) == [1.0, 0.0, 0.0]


def test_clusters_of_three_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.98, 0.02]), (3, [0.0, 1.0])], "vec_id long, embedding array<double>")
    assert [(r.a, r.b) for r in V.blocked_pairs(df, least=0.95).collect()] == [(1, 2)]
    assert {r.vec_id: r.center for r in V.star_clusters(df, 0.95).collect()} == {1: 1, 2: 1, 3: 3}
    assert {r.vec_id: r.component for r in V.components(V.blocked_pairs(df, least=0.95, block=1), df, "vec_id").collect()} == {1: 1, 2: 1, 3: 3}
    near = V.near_existing(df.where("vec_id = 2"), df.where("vec_id <> 2"), 0.92).first()
    assert near.duplicate_of == 1


def test_blocks_find_the_same_pairs(spark):
    rng = np.random.default_rng(0)
    df = spark.createDataFrame([(k, rng.normal(size=6).tolist()) for k in range(60)], "vec_id long, embedding array<double>")
    rows = lambda block: sorted((r.a, r.b) for r in V.blocked_pairs(df, least=0.5, block=block).collect())
    assert rows(7) == rows(1000)
    near = lambda block: sorted((r.a, r.b, r["rank"]) for r in V.blocked_pairs(df, k=3, block=block).collect())
    assert near(7) == near(1000)
    assert len(near(7)) == 180


def test_paths_prefer_cheap_ways(spark):
    edges = spark.createDataFrame([(1, 2, "t", 0.9), (2, 3, "t", 0.1), (1, 3, "t", 1.5), (3, 4, "t", 0.1)], "source_id long, target_id long, type string, weight double")
    seeds = spark.createDataFrame([(1,)], "id long")
    got = {r.id: (round(r.cost, 6), r.hops) for r in G.shortest_paths(edges, seeds, 3).collect()}
    assert got == {1: (0.0, 0), 2: (0.9, 1), 3: (1.0, 2), 4: (1.1, 3)}
    assert {r.id for r in G.shortest_paths(edges, seeds, 1).collect()} == {1, 2, 3}
    inverted = {r.id: r.hops for r in G.shortest_paths(edges, seeds, 3, 1 - F.col("weight")).collect()}
    assert inverted[3] == 1


def test_adjacent_links_choose_the_strongest_reason(spark):
    rows = [(1, "c", START, ["x"], ["t"], "a"), (2, "c", START + timedelta(hours=30), ["x"], [], "a"), (3, "c", START + timedelta(hours=31), [], [], "b"), (4, "c", START + timedelta(days=30), [], [], "b")]
    df = spark.createDataFrame(rows, "id long, chat string, ts timestamp_ntz, e array<string>, g array<string>, author string")
    got = {r.source_id: (r.target_id, r.type, r.weight) for r in G.adjacent_links(df, ["chat"], "id", "ts", "e", "g", "author").collect()}
    assert got == {1: (2, "MENTIONS", 0.6), 2: (3, "TEMPORAL", 0.7), 3: (4, "AUTHORED_BY", 0.4)}


def test_chat_dump_keeps_broken_records_apart(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"id": "1", "date_utc": "2024-01-01T10:00:00Z", "text": "hi", "chat": {"title": "c"}, "from": {"username": "u"}}\n{broken\n{"id": "2", "date": "2024-01-02", "text": " "}\n')
    df = R.chat_dump(spark, str(tmp_path))
    assert sorted(r.id for r in df.collect()) == ["1", "2"]
    records = R.records(df, "tg").collect()
    assert [(r.record_id, r.author, r.tags) for r in records] == [("tg:c:1", "u", ["c"])]


def test_exports_filter_before_the_limit(spark, tmp_path):
    df = spark.createDataFrame([(f"r{k}", "s" if k % 2 else "t", START, "a", ["x", "y"] if k > 4 else ["x"], "c" * 600) for k in range(10)], "record_id string, source string, ts timestamp_ntz, author string, tags array<string>, content string")
    W.export(df, str(tmp_path / "out"), "csv", source="s", tags=["x", "y"], n=2)
    got = spark.read.option("header", True).csv(str(tmp_path / "out")).collect()
    assert sorted(r.record_id for r in got) == ["r5", "r7"]
    assert len(got[0].content) == 500
    W.export(df, str(tmp_path / "md"), "markdown", n=1)
    assert "## r0" in "\n".join(r.value for r in spark.read.text(str(tmp_path / "md")).collect())
    with pytest.raises(ValueError, match="json"):
        W.export(df, str(tmp_path / "x"), "xml")


def test_klines_and_books(spark):
    k = spark.createDataFrame([("B", ["1704067200000", "1.5", "2", "1", None, "10", "1704070799999", "1", "7"])], "symbol string, kline array<string>")
    got = R.klines(k).first()
    assert (float(got.open), float(got.close), got.trades) == (1.5, 0.0, 7)
    assert got.open_time == datetime(2024, 1, 1)
    book = spark.createDataFrame([("B", [["1", "2"], ["0.9", "3"]], [["1.1", "4"]])], "symbol string, bids array<array<string>>, asks array<array<string>>")
    assert sorted((r.side, r.level, float(r.qty)) for r in R.order_book(book).collect()) == [("ask", 0, 4.0), ("bid", 0, 2.0), ("bid", 1, 3.0)]


def test_filters_from_dicts(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id int, c string")
    ids = lambda f: [r.id for r in df.where(S.where(f)).orderBy("id").collect()]
    assert ids({"c": {"$ne": "a"}}) == [2, 3]
    assert ids({"$or": [{"c": "a"}, {"id": {"$eq": 3}}]}) == [1, 3]
    assert ids({}) == [1, 2, 3]


@pytest.mark.parametrize(
    "text, want",
    [
        ("paid $1,200.50 now", "paid MONEY_USD AMOUNT_1200.50 now"),
        ("€30 and ₽1,000,000", "MONEY_EUR AMOUNT_30 and MONEY_RUB AMOUNT_1000000"),
        ("цена 1 200,50 долларов", "цена MONEY_USD AMOUNT_1200.50"),
        ("10 000 руб. и 5 раз", "MONEY_RUB AMOUNT_10000 и 5 раз"),
        ("7 евро, 1,234,567 usd", "MONEY_EUR AMOUNT_7, MONEY_USD AMOUNT_1234567"),
        ("2,5 млрд и 3 миллиона", "BILLION VALUE_25 и MILLION VALUE_3"),
        ("40 тыс штук, 12.5 %", "THOUSAND VALUE_40 штук, PERCENTAGE VALUE_12.5"),
        ("nothing 12 here", "nothing 12 here"),
    ],
)
def test_amounts_are_rewritten(spark, text, want):
    assert one(spark, X.rewrite_numbers(F.lit(text)))[0] == want


def test_tokens_variants_and_names(spark):
    rows = spark.createDataFrame([(1, "The price is $5 at Acme North today"), (2, None), (3, "of it")], "id long, text string").withColumn("tokens", X.word_tokens(F.col("text")))
    assert {r.id: r.tokens for r in rows.collect()}[1] == ["price", "money_usd", "amount_5", "acme", "north", "today"]
    forms = spark.createDataFrame([("price", "cost"), ("price", "rate"), ("x", "y")], "word string, form string")
    got = {r.id: r.variants for r in X.with_variants(rows, forms, "tokens").collect()}
    assert got == {1: ["acme", "amount_5", "cost", "money_usd", "north", "price", "rate", "today"], 2: [], 3: []}
    names = spark.createDataFrame([("acme", "org"), ("acme north", "org"), ("north", "place"), ("south", "place")], "name string, kind string")
    found = {(r.id, r.kind, r.name, r.n) for r in X.named_entities(rows, names, "id", "tokens").collect()}
    assert found == {(1, "org", "acme", 1), (1, "org", "acme north", 1), (1, "place", "north", 1)}


def test_routing_and_normalising(spark):
    words, vectors = (spark.createDataFrame(x, "id long, score double") for x in ([(1, 2.0), (2, 1.0)], [(2, 0.9), (3, 0.1)]))
    assert [r.id for r in S.routed("hybrid", words=words, vectors=vectors, k=1).collect()] == [2]
    assert [r.id for r in S.routed("similar", vectors=vectors).collect()] == [2, 3]
    with pytest.raises(ValueError, match="no list"):
        S.routed("text", vectors=vectors)
    df = spark.createDataFrame([(1, 2.0, 0.0), (2, 4.0, 0.0)], "id long, a double, b double")
    assert {r.id: r.score for r in S.max_normalised(df, {"a": 0.6, "b": 0.4}).collect()} == {1: 0.3, 2: 0.6}
    assert [r.id for r in S.after_cut(words, df.withColumn("keep", F.col("id") == 2), F.col("keep"), 2).collect()] == [2]


def test_updates_tell_what_they_found(spark):
    current = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "k int, v string, w int")
    out, status = D.update_with_status(current, spark.createDataFrame([(1, "x"), (3, "y")], "k int, v string"), "k")
    assert sorted(map(tuple, out.collect())) == [(1, "x", 1), (2, "b", 2)]
    assert dict(map(tuple, status.collect())) == {1: "updated", 3: "missing"}
    left, status = D.delete_with_status(current, spark.createDataFrame([(1,), (9,)], "k int"), "k")
    assert [r.k for r in left.collect()] == [2]
    assert dict(map(tuple, status.collect())) == {1: "deleted", 9: "missing"}


def test_online_clusters_follow_time(spark):
    rows = [(1, START, [1.0, 0.0], "g"), (2, START + timedelta(days=1), [0.9, 0.1], "g"), (3, START + timedelta(days=2), [0.0, 1.0], "g"), (4, START, [0.0, 0.0], "h")]
    df = spark.createDataFrame(rows, "id long, ts timestamp_ntz, v array<double>, g string")
    got = V.online_clusters(df, "id", "ts", "v", "g")
    assert {r.id: r.cluster for r in got.collect()} == {1: 0, 2: 0, 3: 1, 4: 0}
    assert {r.id for r in V.sized_clusters(got.where("g = 'g'"), "cluster").collect()} == {1, 2}


def test_group_rules(spark):
    rows = [("c", START + timedelta(hours=h), k, 5) for k, h in enumerate((0, 1, 2, 26, 27))]
    df = spark.createDataFrame(rows, "chat string, ts timestamp_ntz, id int, size int")
    assert sorted((r.period, r.n, r["size"]) for r in N.hybrid_groups(df, "chat", "ts", "size", "id", most=10).collect()) == [("2024-01-01", 1, 5), ("2024-01-01", 2, 10), ("2024-01-02", 2, 10)]
    assert N.embedding_groups(df, "chat", ["ts", "id"], 3, 3).count() == 3
    assert N.pattern_split(df, "chat", "ts", "id").count() == 5
    got = one(spark, N.new_day(F.lit(START), F.lit(START + timedelta(hours=13))), N.new_day(F.lit(START), F.lit(START + timedelta(hours=1))))
    assert list(got) == [True, False]


def test_nearest_of_many_queries_is_the_same_in_small_blocks(spark):
    v = np.random.default_rng(2).normal(size=(60, 4))
    df = spark.createDataFrame([(k, [float(x) for x in r]) for k, r in enumerate(v)], "vec_id long, embedding array<double>")
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    want = {(a, b, n + 1) for a in range(0, 60, 20) for n, b in enumerate([b for b in np.argsort(-(unit @ unit[a]), kind="stable") if b != a][:5])}
    for block in (7, 2048):
        got = V.nearest(df.where("vec_id % 20 = 0"), df, 5, block=block).collect()
        assert {(r.a, r.b, r["rank"]) for r in got} == want


def test_the_index_finds_nine_of_ten_neighbours(spark, data_dir):
    """Recall against brute force; all cells together are exact."""
    from tidemark.plans import QUERIES

    found, exact = ({(r.a, r.b) for r in QUERIES[n](spark, data_dir).collect()} for n in ("approximate_search", "knn_search_each"))
    assert len(found & exact) >= 0.9 * len(exact)
    e = spark.read.parquet(f"{data_dir}/embeddings.parquet")
    centers = V.cells(e, 5)
    assert V.indexed(e, centers).count() == e.count()
    every = V.approximate(e.where("vec_id % 20 = 0"), V.indexed(e, centers), centers, 10, len(centers))
    assert {(r.a, r.b) for r in every.collect()} == exact


def test_new_vectors_are_held_against_stored_ones_only(spark):
    new = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, None)], "vec_id long, embedding array<double>")
    old = spark.createDataFrame([(7, [2.0, 0.1]), (5, [3.0, 0.0]), (9, [0.0, 1.0])], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.duplicate_of for r in V.near_existing(new, old, 0.9).collect()}
    assert got == {1: 5, 2: 5, 3: None, 4: None}


def test_best_and_worst_position_of_equal_percentages(spark):
    from tidemark.operators import quality as Q

    # 0.1, 0.3 and 0.7 all win a tenth, which floats put in another order; 4 has nothing invested
    rows = [(1, 0.7, 0.77), (2, 0.1, 0.11), (3, 0.3, 0.33), (4, 0.0, 5.0), (5, None, 1.0)]
    df = spark.createDataFrame([("a", *r) for r in rows], "owner string, symbol long, invested double, value double")
    got = Q.portfolio_summary(df, "owner").first()
    assert (got.best, got.worst, got.risk) == (3, 1, "medium")
    assert tuple(Q.portfolio_summary(df, "owner", pct=F.col("symbol") % 5).first()[c] for c in ("best", "worst")) == (4, 5)


def test_portfolio_query_has_best_and_worst(spark, data_dir):
    from tidemark.plans import QUERIES

    got = {r.o_custkey: (r.best, r.worst) for r in QUERIES["portfolio_summary"](spark, data_dir).collect()}
    moves: dict = {}
    for r in spark.read.parquet(f"{data_dir}/orders.parquet").select("o_custkey", "o_orderkey").collect():
        moves.setdefault(r.o_custkey, []).append((r.o_orderkey % 21 - 10, r.o_orderkey))
    assert got == {k: (max(v)[1], min(v)[1]) for k, v in moves.items()}


def test_age_tiers_by_microseconds(spark):
    as_of = datetime(2024, 1, 20)
    ages = [timedelta(days=7), timedelta(days=7, microseconds=-1), timedelta(days=1, seconds=-1, microseconds=1), timedelta(days=1), timedelta(0), timedelta(microseconds=-1)]
    df = spark.createDataFrame([(k, as_of - a) for k, a in enumerate(ages)], "k int, ts timestamp_ntz")
    tier = T.age_tier(F.col("ts"), F.lit(as_of), [("now", 0, 1), ("fresh", 1, 7), ("recent", 7, None)])
    assert [r.tier for r in df.select("k", tier.alias("tier")).orderBy("k").collect()] == ["recent", "fresh", "now", "fresh", "now", None]


def test_cooldowns_of_alerts_count_whole_seconds(spark):
    """As date_diff('second', ..) does: 719 minutes, 59 seconds and a bit can be 720 minutes."""
    ts = [START.replace(microsecond=900_000), START + timedelta(minutes=720, microseconds=-1), START + timedelta(minutes=720, microseconds=100_000), START + timedelta(minutes=1440, microseconds=50_000)]
    rules = spark.createDataFrame([("slow", "m > 1", "warning", 720, True)], "rule string, condition string, severity string, cooldown_minutes int, enabled boolean")
    got = T.fire_alerts(spark.createDataFrame([("m", t, 2.0) for t in ts], "name string, ts timestamp_ntz, value double"), rules)
    assert sorted(r.ts for r in got.collect()) == [ts[0], ts[2], ts[3]]


def test_k_hop_keeps_seeds_as_bits(spark, monkeypatch):
    """150 seeds and as many others around one node: no table has a row for each pair of seed and node."""
    written, plain = [], G.materialized

    def counted(df, *a):
        written.append(plain(df, *a))
        return written[-1]

    monkeypatch.setattr(G, "materialized", counted)
    edges = spark.createDataFrame([(k, 1000) for k in range(150)] + [(1000, 2000 + k) for k in range(150)], "source_id long, target_id long")
    got = G.k_hop(edges, spark.range(150), 3)
    sizes = [t.count() for t in written if spark._jvm.org.apache.hadoop.fs.Path(t._tidemark_path).getFileSystem(spark._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(t._tidemark_path))]
    assert max(sizes) <= 1000
    hops = {(r.seed, r.id): r.hops for r in got.collect()}
    assert got.count() == len(hops) == 150 * 301
    assert all(h == (0 if s == i else 1 if i == 1000 else 2) for (s, i), h in hops.items())


@pytest.mark.parametrize("words", [1, 8])
def test_k_hop_is_the_plain_one(spark, monkeypatch, words):
    """Over several parts of seeds, with loops, ends that are null and seeds that are alone: each pair once, by the shortest way."""
    monkeypatch.setattr(G, "WORDS", words)
    rng = np.random.default_rng(words)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 400, (420, 2))] + [(7, 7), (1, None), (2, None), (None, 3), (1, 2), (1, 2)]
    seeds = [*range(0, 400, 2), 5, 5, 900]
    near: dict = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    want = {}
    for s in seeds:
        level = {s}
        want[s, s] = 0
        for hop in range(1, 4):
            level = {y for x in level if x is not None for y in near.get(x, ()) if (s, y) not in want}
            want |= {(s, y): hop for y in level}
    got = G.k_hop(spark.createDataFrame(pairs, "source_id long, target_id long"), spark.createDataFrame([(s,) for s in seeds], "id long"), 3).collect()
    assert len(got) == len(want)
    assert {(r.seed, r.id): r.hops for r in got} == want


@pytest.mark.parametrize("n", [7, 90, 700])
def test_nearest_vectors_are_those_of_double_precision(spark, monkeypatch, n):
    """Copies, near copies that single precision can't tell apart, zero vectors and numbers that aren't any; groups of products and whole rows."""
    monkeypatch.setattr(V, "CELLS", 2000)
    rng = np.random.default_rng(n)
    v = rng.normal(size=(n, 6))
    v[n // 2 :] = v[: n - n // 2] + rng.choice([0, 1e-8, 1e-7, 1e-3], (n - n // 2, 1)) * rng.normal(size=(n - n // 2, 6))
    v[3], v[5, 2] = 0, np.nan
    size = np.linalg.norm(v, axis=1, keepdims=True)
    u = np.divide(v, size, out=np.zeros_like(v), where=size > 0)
    score = np.array([[round(float(a @ b), 12) for b in u] for a in u])
    some = [i for i in range(n) if i != 5]
    want = {i: sorted((-score[i, j], j) for j in some if j != i)[:4] for i in some}
    i, j, s = V._nearest_of(u[some], u[some], np.array(some), np.array(some), 4, True)
    got = {}
    for a, b, x in zip(i, j, s, strict=True):
        got.setdefault(some[a], []).append((-x, some[b]))
    assert got.keys() == want.keys()
    for a in some:
        assert [b for _, b in got[a]] == [b for _, b in want[a]] or np.allclose([x for x, _ in got[a]], [x for x, _ in want[a]], rtol=0, atol=2e-12)
    reached = {(some[a], some[b]) for i, j, _ in V._reaching(u[some], u[some], 0.5) for a, b in zip(i, j, strict=True)}
    assert all(abs(score[a, b] - 0.5) < 2e-12 or ((a, b) in reached) == (score[a, b] >= 0.5) for a in some for b in some)


def test_blocks_grow_with_the_vectors():
    """A vector is sent to each block: 720,000 vectors have 22 blocks, not 352."""
    assert [V._block_count(n, 2048) for n in (0, 1, 2049, 30_000, 120_000, 720_000)] == [1, 1, 2, 15, 16, 22]


@pytest.mark.parametrize(("least", "dim"), [(0.9, 2), (0.97, 6), (0.6, 6)])
def test_linked_vectors_are_the_components_of_all_pairs(spark, monkeypatch, least, dim):
    """With one component that has most vectors, and with many; no table has as many links as there are pairs."""
    written, plain = [], V.components
    monkeypatch.setattr(V, "components", lambda pairs, *a: written.append(pairs.count()) or plain(pairs, *a))
    rng = np.random.default_rng(dim)
    v = [*rng.normal(size=(150, dim)).tolist(), [0.0] * dim, None, [math.nan] * dim]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(v)], "vec_id long, embedding array<float>")
    got = {r.vec_id: r.component for r in V.linked(df, least, block=12).collect()}
    pairs = V.blocked_pairs(df, least=least)
    assert got == {r.vec_id: r.component for r in plain(pairs, df, "vec_id").collect()}
    assert len(got) == 153
    if dim == 2:
        assert max(written) < pairs.count() / 2
    assert {r.vec_id: r.component for r in V.linked(df.limit(0), least).collect()} == {}
