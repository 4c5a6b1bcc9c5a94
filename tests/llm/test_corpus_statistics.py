"""Divergence audit, collocations and URL rules against plain versions, over odd rows, empty tables and tiny tables of counts."""

from __future__ import annotations

import random
import re
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm.collocations import Shard, collocations
from tidemark.llm.divergence import audit
from tidemark.llm.runs import lowered, runs
from tidemark.llm.sketch import FULL, Counts, merged
from tidemark.llm.url_filter import RULES, host_and_path, judge, mine, tokens
from pyspark.sql import functions as F

from . import edge


def _low(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


# -- kernels


@pytest.mark.parametrize("seed", range(5))
def test_runs_are_those_of_a_regular_expression(seed):
    rng = random.Random(seed)
    texts = [None if rng.random() < 0.1 else "".join(rng.choice("abZ \t.,é\U0001f600\n\x00x") for _ in range(rng.randint(0, 30))) for _ in range(200)]
    array = pa.array(texts, pa.string())[3:]
    offsets, piece, words = runs(array, lowered(b" \t.,\n"), b".,\n")
    listed, pieces = words.to_pylist(), piece.tolist()
    for k, text in enumerate(texts[3:]):
        want = [[w for w in re.findall("[^ \t]+", p)] for p in re.split("[.,\n]", _low(text or ""))]
        a, b = offsets[k], offsets[k + 1]
        assert listed[a:b] == [w for p in want for w in p]
        assert [len([x for x in pieces[a:b] if x == y]) for y in dict.fromkeys(pieces[a:b])] == [len(p) for p in want if p]
    assert all(pieces[offsets[k] - 1] < pieces[offsets[k]] for k in range(1, len(texts) - 3) if 0 < offsets[k] < len(pieces))


def test_tables_of_counts_never_underestimate(spark):
    rng = np.random.default_rng(3)
    keys = rng.integers(0, 1 << 62, 5000, np.int64).astype(np.uint64)
    times = rng.integers(1, 60, 5000)
    rows = []
    for part in range(4):
        table = Counts(2, 12)
        for r in range(2):
            table.add(r, keys, times)
            table.add(r, keys[:7])
        rows += [(k, v) for k, v in table.blocks()]
    found = merged(spark.createDataFrame(rows, "slots int, counts binary"), 2, 12, 100).value
    all_of = 4 * times + 4 * (np.arange(5000) < 7)
    for r in range(2):
        assert found.passes(r, keys)[all_of >= 100].all()
    assert merged(spark.createDataFrame([], "slots int, counts binary"), 2, 12, 1).value.table.sum() == 0
    with pytest.raises(ValueError, match="255"):
        merged(spark.createDataFrame([], "slots int, counts binary"), 2, 12, FULL + 1)


def test_tallies_of_ranges_never_underestimate(spark, monkeypatch):
    from tidemark.llm import sketch

    monkeypatch.setattr(sketch, "RANGE_BITS", 13)
    monkeypatch.setattr(sketch, "HELD", 6000)
    rng = np.random.default_rng(4)
    keys = rng.integers(0, 1 << 62, 5000, np.int64).astype(np.uint64)
    batches, few = [], keys[:50]
    for _ in range(4):
        tally = sketch.Tally(2, 20)
        for r in range(2):
            tally.add(r, keys)
            tally.add(r, np.repeat(few, 24 + r))
            batches += tally.blocks()
        batches += tally.blocks(last=True)
        assert not list(tally.blocks(last=True))
    rows = [tuple(r.values()) for b in batches for r in b.to_pylist()]
    found = sketch.tallied(spark.createDataFrame(rows, sketch.SCHEMA), 2, 20, 100).value
    assert all(found.passes(r, few).all() for r in range(2))
    assert max(found.passes(r, keys[50:]).mean() for r in range(2)) < 0.05
    assert sketch.tallied(spark.createDataFrame([], sketch.SCHEMA), 2, 20, 1).value.table.sum() == 0
    with pytest.raises(ValueError, match="255"):
        sketch.tallied(spark.createDataFrame([], sketch.SCHEMA), 2, 20, sketch.FULL + 1)


def test_phrases_are_added_up_part_by_part():
    from tidemark.llm.collocations import _packs, _total

    words = [f"w{k}" for k in range(1000)]
    packs = _packs(pa.table({"lang": ["en"] * 1000, "words": pa.array([1] * 1000, pa.int32()), "phrase": words, "n": [60] * 1000}), 4)
    read = []

    def twice():  # noqa: ANN202
        for k in range(packs.num_rows):
            for _ in range(2):
                read.append(k)
                yield packs.slice(k, 1)

    out = _total(100)(twice())
    first = next(out)
    assert max(read) == 1 and first.num_rows < 400  # the second part has begun, no more of it is held
    every = pa.Table.from_batches([first, *out])
    assert sorted(every.column("phrase").to_pylist()) == sorted(words) and set(every.column("n").to_pylist()) == {120}


def test_many_different_words_do_not_leave_their_task(spark):
    from tidemark.llm.collocations import _counter, _sketcher
    from tidemark.llm.sketch import SCHEMA, tallied

    # 60,000 pairs, each a few times: a table of 4096 slots lets all of them pass
    text = " ".join(f"a{k % 251} b{k % 239}" for k in range(60_000))
    docs = spark.createDataFrame([(text, "en")] * 4, "text string, lang string")
    passed = {}
    for bits in (12, 30):
        reached = tallied(docs.mapInArrow(_sketcher(bits), SCHEMA), 3, bits, 100)
        packs = docs.mapInArrow(_counter(reached, 4), "part int, lang array<string>, words array<int>, phrase array<string>, n array<long>")
        passed[bits] = packs.selectExpr("explode(words) as words").where("words > 1").count()
    assert passed[12] > 100_000 > 20_000 > passed[30]


# -- divergence


def _audit(docs: list[tuple], least: int, top: int) -> dict:
    docs = [(lang or "", source or "", re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", _low(text or ""))) for text, lang, source in docs]
    out = {}
    for lang in {d[0] for d in docs}:
        some = [d for d in docs if d[0] == lang]
        seen = Counter(t for d in some for t in set(d[2]))
        kept = [t for t in seen if seen[t] >= least]
        counts = {g: Counter(t for d in some if d[1] == g for t in d[2] if t in set(kept)) for g in {d[1] for d in some}}
        share = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept)) for t in kept}  # noqa: B023, E731
        every = share(sum(counts.values(), Counter()))
        shares = {g: share(c) for g, c in counts.items()}
        for g, p in shares.items():
            pairs = [(-sum(abs(p[t] - q[t]) for t in kept), h.encode(), h) for h, q in shares.items() if h != g]
            own = [(every[t] - p[t], t.encode(), t) for t in kept if counts[g][t] and p[t] > every[t]]
            for part, rows, most in (("pair", pairs, None), ("term", own, top)):
                for k, (v, _, item) in enumerate(sorted(rows)[:most]):
                    out[lang, g, part, item] = (-v, k + 1)
    return out


def _corpus(seed: int) -> list[tuple]:
    """A hot source, words in a few documents or in most, letters outside ASCII, sources of one document or without words."""
    rng = random.Random(seed)
    vocab = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(80)] + ["Été", "straße", "don't", "x1y", "ЖЖ"]
    docs = []
    for _ in range(150):
        n = rng.choice((0, 3, 30))
        docs.append((" ".join(rng.choice(vocab[: rng.choice((5, 85))]) for _ in range(n)), rng.choice(("en", "en", "fr", None)), rng.choice(("hot", "hot", "hot", "a", "b", "z", None))))
    return [*docs, ("12 34", "en", "numbers"), (None, "xx", "alone"), ("once", "yy", "p"), ("once", "yy", "q")]


def _got(df) -> dict:  # noqa: ANN001
    rows = df.collect()
    found = {(r.lang, r.source, r.part, r["item"]): (r.value, r["rank"]) for r in rows}
    assert len(found) == len(rows)
    return found


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("bits", [12, 18])
def test_audit_is_the_plain_one(spark, seed, bits):
    docs = _corpus(seed)
    df = spark.createDataFrame(docs, "text string, lang string, source string").repartition(5)
    assert _got(audit(df, least=6, top=7, bits=bits)) == _audit(docs, 6, 7)


def test_audit_of_odd_rows(spark):
    docs = [(r[1], r[2], r[3]) for r in edge.rows()]
    assert _got(audit(edge.frame(spark), least=2)) == _audit(docs, 2, 50)
    assert audit(edge.empty(spark)).collect() == []


# -- collocations


def _collocations(docs: list[tuple], least: int, percent: int, top: int) -> dict:
    n, f = Counter(), Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", _low(text or "")):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + m])) for m in range(1, 6) for i in range(len(w) - m + 1))
    often = {k: v for k, v in f.items() if v >= least}
    inside = Counter()
    for (lang, p), v in often.items():
        for m in range(2, len(p)):
            for i in range(len(p) - m + 1):
                inside[lang, p[i : i + m]] = max(inside[lang, p[i : i + m]], v)
    rows = []
    for (lang, p), a in often.items():
        if len(p) > 1 and not (inside[lang, p] and 100 * inside[lang, p] >= percent * a):
            cuts = [(1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            rows.append((lang, -score, -a, " ".join(p).encode(), (" ".join(p), a, f[lang, p[:k]], f[lang, p[k:]], n[lang], score)))
    rows.sort()
    out, rank = {}, Counter()
    for lang, *_, row in rows:
        rank[lang] += 1
        if rank[lang] <= top:
            out[lang, rank[lang]] = row
    return out


def _phrases(df) -> dict:  # noqa: ANN001
    return {(r.lang, r["rank"]): (r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect()}


def _sayings(seed: int) -> list[tuple]:
    rng = random.Random(seed)
    vocab = ["New", "york", "city", "of", "the", "a", "é", "x1", "\x00"] + [f"v{k}" for k in range(40)]
    docs = []
    for _ in range(120):
        text = ""
        for _ in range(rng.choice((0, 5, 60))):
            text += rng.choice(vocab[: rng.choice((4, 9, 49))]) + rng.choice((" ", " ", " ", "  ", "\t", ". ", "\n", ", "))
        docs.append((text, rng.choice(("en", "en", "de", None))))
    return docs + [("a a a a a a", "en")] * 5 + [("one fixed phrase of five words here", "fr")] * 9


@pytest.mark.parametrize("percent", [100, 60])
@pytest.mark.parametrize("bits", [12, 18])
def test_collocations_are_the_plain_ones(spark, percent, bits):
    docs = _sayings(percent)
    df = spark.createDataFrame(docs, "text string, lang string").repartition(5)
    want = _collocations(docs, 8, percent, 25)
    assert want
    assert _phrases(collocations(df, least=8, percent=percent, top=25, bits=bits)) == want


def test_collocations_of_odd_rows(spark):
    docs = [(r[1], r[2]) for r in edge.rows()]
    assert _phrases(collocations(edge.frame(spark), least=2)) == _collocations(docs, 2, 100, 2000)
    assert collocations(edge.empty(spark)).collect() == []
    with pytest.raises(ValueError, match="least"):
        collocations(edge.frame(spark), least=0)


def test_suffixes_are_sorted_by_words():
    rng = random.Random(1)
    text = " ".join(rng.choice("abc") for _ in range(300)) + ". b c. a"
    shard = Shard(pa.RecordBatch.from_pydict({"text": [text, None], "lang": ["en", "en"]}))
    order = shard.suffixes(np.flatnonzero(shard.ids[: shard.n]))
    keys = [shard.ids[k : k + 5].tolist() for k in order.tolist()]
    assert keys == sorted(keys)
    assert len(keys) == 303


# -- URL rules


def _parts(url: str | None) -> tuple[str, str]:
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match("[^/?#]*", rest)[0]
    return _low(host), re.match("[^?#]*", rest[len(host) :])[0]


def _fixed(host: str, path: str) -> tuple | None:
    fits = [(len(h + p), h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits, default=None)


URLS = [
    "http://example.com/en/1", "https://WWW.Example.com/en/2?x=1#top", "http://example.com", "http://example.com/enx", "http://a.net/es/", "http://net/fr/", "http://anet/fr/x", "ftp://b.net/fr?/es/", "no scheme", "", None,
    "://com/", "http:///en/", "http://x.com?y=/en/", "http://x.com#/en/", "http://a://b/c", "http://example.com/en/é ü\nz", "http://..com/", "x" * 50_000 + "://com/", "http://" + "a." * 300 + "com/", "http://www.example.com/EN/",
]


def test_hosts_paths_and_fixed_rules(spark):
    pages = spark.createDataFrame([(k, u, "h", "p", "v") for k, u in enumerate(URLS)] + [(None, None, "h", "p", "v"), (3, URLS[3], "h", "p", "v")], "page_id long, url string, host string, rule string, mined string")
    got = judge(pages, spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect()
    assert len(got) == len(URLS) + 2
    for r in got:
        url = None if r.page_id is None else URLS[r.page_id]
        assert (r.host, r.path) == _parts(url), url
        rule = _fixed(r.host, r.path)
        assert (r.rule, r.verdict) == ((rule[1], rule[2]) if rule else (None, "allow")), url
    assert judge(pages.limit(0), spark.createDataFrame([(1, 0, 1)], "doc_id long, quality int, toxic int")).collect() == []


def _tokens(url: str | None) -> frozenset:
    host, path = _parts(url)
    if not url or "://" not in url:
        return frozenset()
    low = _low(url)
    query = re.match(r"[^?#]*\?([^#]*)", low, re.S)
    fragment = low.split("#", 1)[1] if "#" in low else ""
    return frozenset(
        [f"h:{x}" for x in re.split(r"[.\-]", host) if x]
        + [f"p:{x}" for x in re.sub("[0-9]+", "#", _low(path)).split("/") if x]
        + [f"q:{x}" for x in re.sub("=[^&]*", "", query[1] if query else "").split("&") if x]
        + [f"f:{x}" for x in fragment.split(" ") if x]
    )


def test_tokens(spark):
    rows = spark.createDataFrame([(u,) for u in URLS], "url string").select("url", tokens(F.col("url")).alias("t")).collect()
    assert {r.url: frozenset(r.t) for r in rows} == {u: _tokens(u) for u in URLS}
    assert all(len(set(r.t)) == len(r.t) for r in rows)


def _mined(rows: list[tuple], least: int, confidence: float) -> dict:
    """Every set of tokens of labelled URLs (tokens, bad)."""
    with_it, bad = Counter(), Counter()
    for t, b in rows:
        for m in range(1, len(t) + 1):
            for c in combinations(sorted(t), m):
                with_it[c] += 1
                bad[c] += b
    rules = {c: (bad[c] / n, bad[c]) for c, n in with_it.items() if bad[c] >= least and bad[c] / n >= confidence}
    return {c: v for c, v in rules.items() if not any(set(d) < set(c) and w[0] >= v[0] for d, w in rules.items())}


def test_mined_rules_are_those_of_all_token_sets(spark):
    rng = random.Random(4)
    urls = [f"http://{rng.choice(('casino', 'news', 'shop'))}-{rng.choice(('win', 'day'))}.{rng.choice(('org', 'com'))}/{rng.choice(('en', 'fr'))}/{rng.randint(1, 99)}{rng.choice(('', '?ref=1', '#top'))}" for _ in range(400)]
    labels = [(k, 0 if "casino" in u and "win" in u and rng.random() < 0.9 else 1, int("fr" in u and "ref" in u and rng.random() < 0.7)) for k, u in enumerate(urls) if k % 2]
    labels += [(0, None, None), (None, 0, 1), (2, None, 1), (4, 1, None), (9_999, 0, 1)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    rows = [(_tokens(urls[k]), int(t == 1 or q == 0)) for k, q, t in labels if k is not None and k < len(urls) and (t == 1 or q == 0 or None not in (q, t))]
    want = _mined(rows, 7, 0.6)
    assert len(want) > 3
    got = {tuple(r.rule): (r.confidence, r.support) for r in mine(pages, known, support=0.03, evidence=7).collect()}
    assert got == want
    for r in judge(pages, known, support=0.03, evidence=7).collect():
        fits = {c for c in want if set(c) <= _tokens(urls[r.page_id])}
        assert r.n_mined == len(fits)
        assert r.verdict == ("block" if (f := _fixed(r.host, r.path)) and f[2] == "block" or not f and fits else "allow")
        if fits:
            assert r.mined == min((-want[c][0], -want[c][1], " ".join(c)) for c in fits)[2]
