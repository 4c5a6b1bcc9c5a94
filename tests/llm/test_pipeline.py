"""The pipeline held against plain versions of its stages, on a small corpus; and its registration."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

from . import edge
from .test_line_dedup import plain as plain_lines
from .test_small_operators import _targets

public_tokenizers = pytest.importorskip("public_tokenizers")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

from tidemark.llm.line_dedup import normal_lines  # noqa: E402


def _corpus() -> list[tuple]:
    rng = random.Random(11)
    vocab = {"en": ["the", "house", "thing", "with", "when", "water", "those", "which", "thought"], "fr": ["le", "chez", "maison", "quoi", "beaux", "jour", "lequel", "avoir", "toujours"]}
    say = lambda lang, n: " ".join(rng.choice(vocab[lang]) + rng.choice(("", "s", "t", "ing" if lang == "en" else "ent")) for _ in range(n))
    docs = []
    for k in range(60):
        lang = rng.choice(("en", "fr"))
        docs.append((say(lang, rng.randint(30, 90)) + "\n" + say(lang, rng.randint(6, 40)), lang, f"s{k % 4}"))
    docs += [docs[k] for k in range(8)]
    docs += [(docs[k][0] + "\n" + "one more line of words here", docs[k][1], "s1") for k in range(8, 14)]
    docs += [("12 34 !! ...", "en", "s0"), (None, "en", "s1"), ("", None, None)]
    return [(k, t, lang, source, None if t is None else len(t)) for k, (t, lang, source) in enumerate(docs)]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What each stage returned, from the first table on."""
    root = tmp_path_factory.mktemp("pipeline")
    docs = spark.createDataFrame(_corpus(), "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(root / "documents.parquet"))
    out = [[tuple(r) for r in docs.collect()]]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(root))
        docs.write.parquet(str(root / f"{k}-{name}"))
        docs = spark.read.parquet(str(root / f"{k}-{name}"))
        out.append([tuple(r) for r in docs.collect()] if k < 4 else docs.collect())
    return str(root), out


def test_language_stage_drops_what_has_none_and_keeps_the_rest(stages):
    before, after = stages[1][:2]
    assert sorted(r[0] for r in after) == sorted(r[0] for r in before if r[1] and any(c.isalpha() for c in r[1]))
    assert {r[0]: r[1:] for r in after}.items() <= {r[0]: r[1:] for r in before}.items()


def test_line_stage_keeps_one_of_each_line(stages):
    before, after = stages[1][1:3]
    keep, want = plain_lines([r[:2] for r in before]), {}
    for r in before:
        lines = r[1].split("\n")
        left = [x for k, x in enumerate(lines) if keep.get((r[0], k), (r[0], k)) == (r[0], k)]
        if len(left) == len(lines) or "".join(left).strip():
            want[r[0]] = "\n".join(left)
    assert {r[0]: r[1] for r in after} == want
    assert all(r[4] == len(r[1]) for r in after)
    assert all(next(normal_lines(r[1], 1), None) for r in after)


def test_near_copy_stage_keeps_one_of_each_group(stages):
    before, after = stages[1][2:4]
    groups = edge.components([r[:2] for r in before], 5)
    assert sorted(r[0] for r in after) == sorted({v for _, v in groups.values()})


def test_mixing_stage_takes_what_the_targets_say(stages):
    before, after = stages[1][3:5]
    sizes, taken = {}, {}
    for r in before:
        sizes[r[3]] = sizes.get(r[3], 0) + len(edge.words(r[1]))
    for r in after:
        taken[r[3]] = taken.get(r[3], 0) + len(edge.words(r[1]))
    largest = max(len(edge.words(r[1])) for r in before)
    assert all(abs(taken.get(s, 0) - t) <= largest for s, t in _targets(sizes).items())
    ids = [r[0] for r in after]
    assert all(1 <= ids.count(k) <= 3 for k in set(ids))


def test_packing_stage_places_every_token(stages):
    from tokenizers import Tokenizer

    before, after = stages[1][4:6]
    encoder = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = sorted(zlib.crc32(np.array([*encoder.encode(r[1], add_special_tokens=False).ids, 0][k : k + 2048], "<u4").tobytes()) for r in before for k in range(0, len(encoder.encode(r[1], add_special_tokens=False).ids) + 1, 2048))
    assert sorted(r.ids_crc32 for r in after) == want
    held: dict = {}
    for r in after:
        held[r.sequence_id] = held.get(r.sequence_id, 0) + r.length
    assert max(held.values()) <= 2048
    assert len(held) <= -(-sum(held.values()) // 2048) + 1


def test_run_is_all_stages(spark, stages):
    root, out = stages
    got = corpus_pipeline.run(spark, root).collect()
    assert sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in got) == sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in out[5])


def test_stages_take_odd_and_empty_tables(spark):
    for df in (edge.frame(spark), edge.empty(spark)):
        docs = df
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, "")
        assert (docs.count() > 0) == (df.count() > 0)


def test_one_of_exact_copies_with_short_lines_leaves(spark):
    text = "the house with the water and those things\nHaanth.\nwhen the water was thought of by those\nNo."
    docs = spark.createDataFrame([(k, text, "en", "s0", len(text)) for k in range(4)], "doc_id long, text string, lang string, source string, n_chars long")
    lines = corpus_pipeline.drop_repeated_lines(spark, docs, "")
    assert [(r.doc_id, r.text) for r in corpus_pipeline.drop_near_copies(spark, lines, "").collect()] == [(0, text)]


def test_null_and_repeated_ids_pass_every_stage(spark, tmp_path):
    """20 documents without an id and 20 of one id, all with texts of their own: only the repeats of the id go, in near-dedup; no text comes over three times."""
    rng = random.Random(6)
    letters = "etaoinshrdlu"
    say = lambda: " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(20, 40)))
    rows = [(None if k < 20 else 5 if k < 40 else k, say(), "en", f"s{k % 3}") for k in range(60)]
    docs = spark.createDataFrame([(*r, len(r[1])) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    counts = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, "").write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        counts.append(docs.count())
        if k == 2:
            kept = {r.text for r in docs.collect()}
            assert {r[1] for r in rows if r[0] != 5} <= kept
            assert len(kept) == 41
        if k == 3:
            times: dict = {}
            for r in docs.collect():
                times[r.text] = times.get(r.text, 0) + 1
            assert set(times) <= kept
            assert max(times.values()) <= 3
            assert sum(times.values()) < 3 * 41
    assert counts[:3] == [60, 60, 41]
    assert counts[4] == counts[3]


def test_queries_are_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    for n in range(1, 11):
        assert sum(name.startswith(f"op{n}_") for name in names) == 1
    assert "pipeline" in names
    assert set(entry.oracle_sql()) <= set(names)
