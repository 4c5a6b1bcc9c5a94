from __future__ import annotations

import random

import numpy as np
import pytest

from tidemark.llm.minhash import drop_near_duplicates, near_duplicates, signatures
from tidemark.llm import components as C

from . import edge


def _corpus(seed: int = 5) -> list[tuple[int, str]]:
    """Copies, chains of edits around the threshold, a passage that all of one part share, and texts of their own."""
    rng = random.Random(seed)
    vocab = [f"v{k}" for k in range(400)]
    say = lambda n: [rng.choice(vocab) for _ in range(n)]
    docs, passage = [], say(60)
    for _ in range(6):
        now = say(120)
        for _ in range(12):
            docs.append(list(now))
            for _ in range(rng.choice((1, 3, 6))):
                now[rng.randrange(len(now))] = rng.choice(vocab)
    docs += [passage + say(rng.randint(5, 60)) for _ in range(60)]
    docs += [say(rng.randint(1, 12)) for _ in range(60)]
    docs += [d[:] for d in docs[:10]]
    order = list(range(len(docs)))
    rng.shuffle(order)
    return [(k * 3 + 1, " ".join(docs[i])) for k, i in enumerate(order)]


@pytest.mark.parametrize("n", [2, 5])
def test_groups_are_those_of_all_pairs(spark, n):
    docs = _corpus()
    got = near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), shingle=n).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == edge.components(docs, n)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_blocks_and_later_turns_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(C, "BLOCK", 4)
    monkeypatch.setattr(C, "TASK", 20)
    docs = _corpus(9)
    got = near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), shingle=2, bands=32).collect()
    assert {r.doc_id: r.component_id for r in got} == {k: v for k, (_, v) in edge.components(docs, 2).items()}


def test_odd_rows(spark):
    got = near_duplicates(edge.frame(spark), shingle=2).collect()
    assert len(got) == len(edge.rows())
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    plain = edge.components([(k, t) for k, t in {r[0]: r[1] for r in edge.rows() if r[0] is not None}.items()], 2)
    assert {k: (r.n_shingles, r.component_id) for k, r in by.items()} == plain
    assert all(r.component_id is None and r.kept for r in got if r.doc_id is None)
    assert by[7].component_id == by[8].component_id == 7


def test_no_rows(spark):
    assert near_duplicates(edge.empty(spark)).count() == 0
    assert drop_near_duplicates(edge.empty(spark)).count() == 0


def test_one_row_of_each_group_stays(spark):
    out = drop_near_duplicates(edge.frame(spark), shingle=2)
    assert out.columns == edge.frame(spark).columns
    ids = [r.doc_id for r in out.collect()]
    assert sorted(k for k in ids if k is not None) == [-5, 1, 4, 5, 6, 7, 9, 11, 12, 13]
    assert ids.count(None) == 2


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    pool = np.sort(rng.integers(0, 2**64 - 1, 1000, np.uint64))
    a, b = pool[:900], pool[100:]
    x, y = signatures([a, b], 128)
    assert abs((x == y).mean() - 0.8) < 0.15
    one = signatures([pool[:1], pool[:0]], 128)
    assert (one[0] == pool[0]).all()
    assert (one[1] == 0).all()


@pytest.mark.parametrize("task", [0, 30, 200_000])
def test_components_of_chains_and_stars(spark, monkeypatch, task):
    """By written turns alone, by turns and then one task, and by one task."""
    monkeypatch.setattr(C, "TASK", task)
    links = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 140)] + [(7, 7), (200, 199), (199, 200)]
    got = {r.id: r.component for r in C.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(41)} | {k: 100 for k in range(100, 140)} | {199: 199, 200: 199}
    assert C.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_least_reached_is_the_plain_one():
    for seed in range(100):
        rng = random.Random(seed)
        links = [(rng.randint(0, 40) * 3, rng.randint(0, 40) * 3) for _ in range(rng.randint(1, 40))]
        groups = edge.Union({x for link in links for x in link})
        for a, b in links:
            groups.join(a, b)
        nodes, to = C.least_reached(*(np.array(x) for x in zip(*links, strict=True)))
        assert dict(zip(nodes.tolist(), to.tolist(), strict=True)) == {x: groups.find(x) for x in groups.up}


def test_of_rows_that_repeat_an_id_the_first_by_hash_stays(spark):
    rows = [(1, f"text number {k} of a document with one id", f"s{k}") for k in range(12)] + [(2, "another document altogether, of other words", "t")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    first = min(df.where("doc_id = 1").selectExpr("xxhash64(doc_id, text, source) AS h", "text", "source").collect())
    for turn in range(3):
        got = {r.doc_id: (r.text, r.source) for r in drop_near_duplicates(df.repartition(turn + 1)).collect()}
        assert got == {1: (first.text, first.source), 2: rows[-1][1:]}

def test_only_the_texts_that_are_asked_for_are_shuffled(spark):
    from tidemark.llm._shared import asked_for

    rows = spark.range(20_000).selectExpr("id", "repeat('x', 9) as text", "id % 3 as word").union(spark.sql("select cast(null as bigint), 'y', 1L"))
    asked = spark.range(5, 20_000, 100).selectExpr("id")
    got = asked_for(rows, asked, "id")
    assert got.columns == rows.columns
    kept = [r.id for r in got.collect()]
    assert {r.id for r in asked.collect()} <= set(kept) and len(kept) == len(set(kept)) < 400
    assert asked_for(rows, asked.limit(0), "id").count() == 0
