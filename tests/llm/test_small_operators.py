from __future__ import annotations

import base64
import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from tidemark.llm import _shared as shared
from tidemark.llm import fingerprints as P
from tidemark.llm import language as G
from tidemark.llm import media as M
from tidemark.llm import mixing as X
from tidemark.llm import packing as B
from tidemark.llm import sharding as S
from tidemark.llm import token_counts as C
from tidemark.llm import token_files as R
from tidemark.llm._shared import new_path

from . import edge

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def encoder():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


# 1 sharding


def test_lookup_table_is_claimed_in_turns():
    shards, slots = ["a", "b", "c"], 101
    number = lambda name, what: int(hashlib.md5(f"{what}:{name}".encode()).hexdigest()[:15], 16)
    orders = [[(number(s, "offset") % slots + k * (number(s, "skip") % (slots - 1) + 1)) % slots for k in range(slots)] for s in shards]
    assert all(sorted(o) == list(range(slots)) for o in orders)
    plain: dict[int, int] = {}
    while len(plain) < slots:
        for k, order in enumerate(orders):
            if len(plain) < slots:
                plain[next(s for s in order if s not in plain)] = k
    table = S.lookup_table(shards, slots)
    assert table == [plain[k] for k in range(slots)]
    assert max(map(table.count, range(3))) - min(map(table.count, range(3))) <= 1


def test_few_keys_move_when_a_shard_goes():
    names = [f"s{k}" for k in range(10)]
    old, new = S.lookup_table(names, 10_007), S.lookup_table(names[:-1], 10_007)
    moved = sum(a != b for a, b in zip(old, new, strict=True) if a != 9)
    assert moved < 0.15 * 10_007


def test_turns_weigh_shards_and_bad_arguments_are_refused():
    table = S.lookup_table(["a", "b"], 1009, [3, 1])
    assert abs(table.count(0) - 3 * table.count(1)) <= 4
    for bad in (([], 7, None), (["a", "a"], 7, None), (["a"], 8, None), (["a", "b"], 7, [0, 0])):
        with pytest.raises(ValueError):
            S.lookup_table(*bad)


def test_placement_of_odd_rows(spark):
    got = S.assign(edge.frame(spark), "doc_id", ["a", "b"], 101).collect()
    assert len(got) == len(edge.rows())
    assert len({r.shard for r in got if r.doc_id is None}) == 1
    assert S.assign(edge.empty(spark), "doc_id", ["a", "b"], 101).count() == 0


# 2 media


def test_stored_texts_come_back(spark):
    got = M.store_texts(edge.frame(spark)).collect()
    want = sorted(((k, t or "") for k, t, *_ in edge.rows()), key=str)
    assert len(got) == len(want)
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    for key, text in want:
        if key is None:
            continue
        data = text.encode()
        padded = data + bytes(-len(data) % 64 or (0 if data else 64))
        r = by[key]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        assert r.media_bytes == len(M.build(padded))
        assert r.codec == "raw "
        assert r.duration_s == len(padded) / M.RATE
    assert M.store_texts(edge.empty(spark)).count() == 0


@pytest.mark.parametrize("n", [0, 1, 1023, 1024, 1025, 8192, 8193, 100_000])
def test_containers_of_any_size(n):
    data = random.Random(n).randbytes(n)
    file = M.build(data)
    (track,) = M.tracks(file)
    assert M.payload(file, track) == data
    assert track.duration == n
    assert len(track.keys) == -(-len(track.sizes) // M.KEY_EVERY)
    assert all(file[o : o + s] == data[k * 1024 * M.KEY_EVERY :][:s] for k, (o, s) in enumerate(track.key_ranges))


def test_damaged_containers_are_described_not_fatal(spark):
    whole = M.build(b"x" * 5000)
    files = [(1, whole), (2, whole[:-30]), (3, b""), (4, None), (5, b"\0\0\0\1abcd"), (6, b"\0\0\0\7abc"), (7, whole[:40]), (8, M._box(b"moov", M._box(b"trak")))]
    rng = random.Random(0)
    for k in range(9, 40):
        bad = bytearray(whole)
        bad[rng.randrange(len(bad) - 700, len(bad))] ^= 0xFF
        files.append((k, bytes(bad)))
    got = {r.k: r for r in M.describe_files(spark.createDataFrame(files, "k long, content binary"), "k", "content").collect()}
    assert (got[1].codec, got[1].error, got[1].n_samples) == ("raw ", None, 5)
    assert got[1].key_ranges[0].length == 1024
    assert all(got[k].error for k in (2, 4, 5, 6, 7, 8))
    assert (got[3].n_samples, got[3].error) == (0, None)


def test_large_sizes_and_boxes_to_the_end():
    inner = M._box(b"free", b"abc")
    big = b"\0\0\0\1moov" + (16 + len(inner)).to_bytes(8, "big") + inner
    assert [(p, e - b) for p, b, e in M.walk(memoryview(big))] == [((b"moov",), 11), ((b"moov", b"free"), 3)]
    assert [e - b for _, b, e in M.walk(memoryview(b"\0\0\0\0free" + b"x" * 9))] == [9]


def _numbers(*values: int) -> bytes:
    return b"".join(v.to_bytes(4, "big") for v in values)


def _fragmented() -> tuple[bytes, list[bytes]]:
    """A file of one video track with nothing in its sample table, and two fragments: six samples, of which the first and the fourth are key ones."""
    samples = [bytes([65 + k]) * (10 + k) for k in range(6)]
    empty = [M._full(k, bytes(4)) for k in (b"stts", b"stsc", b"stco")] + [M._full(b"stsz", bytes(8))]
    stbl = M._box(b"stbl", M._full(b"stsd", _numbers(1), M._box(b"avc1", bytes(8))), *empty)
    minf = M._box(b"minf", M._full(b"hdlr", bytes(4), b"alis", bytes(12)), stbl)
    mdia = M._box(b"mdia", M._full(b"mdhd", _numbers(0, 0, 100, 0), bytes(4)), M._full(b"hdlr", bytes(4), b"vide", bytes(12)), minf)
    trak = M._box(b"trak", M._full(b"tkhd", _numbers(0, 0, 7, 0, 0), bytes(60)), mdia)
    out = M._box(b"ftyp", b"isom", bytes(4)) + M._box(b"moov", trak, M._box(b"mvex", M._full(b"trex", _numbers(7, 1, 25, 0, 0x10000))))
    for part in (samples[:3], samples[3:]):
        tfhd = M._box(b"tfhd", _numbers(0x20000, 7))

        def moof(at: int) -> bytes:
            trun = M._box(b"trun", _numbers(0x205, len(part)), at.to_bytes(4, "big"), _numbers(0), _numbers(*map(len, part)))  # noqa: B023
            return M._box(b"moof", M._full(b"mfhd", _numbers(1)), M._box(b"traf", tfhd, trun))  # noqa: B023

        out += moof(len(moof(0)) + 8) + M._box(b"mdat", *part)
    return out, samples


def test_fragments_are_decoded():
    file, samples = _fragmented()
    (track,) = M.tracks(file)
    assert (track.handler, track.codec, track.timescale, track.duration) == ("vide", "avc1", 100, 150)
    assert [file[o : o + n] for o, n in zip(track.offsets, track.sizes, strict=True)] == samples
    assert [file[o : o + n] for o, n in track.key_ranges] == [samples[0], samples[3]]
    got = M.describe(file)
    assert (got["duration_s"], got["n_samples"], len(got["tracks"]), got["error"]) == (1.5, 6, 1, None)


@pytest.mark.parametrize("bits", [4, 8, 16])
def test_short_sample_sizes(bits):
    sizes = [3, 15, 0, 7, 9]
    fields = {4: bytes([0x3F, 0x07, 0x90]), 8: bytes(sizes), 16: b"".join(x.to_bytes(2, "big") for x in sizes)}[bits]
    data = M._full(b"stz2", _numbers(bits, len(sizes)), fields)
    assert M._sizes(memoryview(data + bytes(40)), {b"stz2": (8, len(data))}).tolist() == sizes


@pytest.mark.parametrize("value", [0, 1, 2**31, 2**32 - 1])
def test_no_field_makes_a_file_fatal_or_large(value):
    for whole in (M.build(b"x" * 3000), _fragmented()[0]):
        skip = range(len(whole) - 700) if len(whole) > 3000 else ()
        for at in range(len(skip), len(whole) - 3):
            bad = whole[:at] + value.to_bytes(4, "big") + whole[at + 4 :]
            got = M.describe(bad)
            assert got["error"] or got["n_samples"] <= len(bad) + 1024


# 3 packing


def test_best_fit_is_the_plain_one_and_bounds_hold():
    rng = random.Random(1)
    for _ in range(60):
        capacity = rng.choice((10, 64, 100))
        sizes = sorted((rng.randint(1, capacity) for _ in range(rng.randint(0, 60))), reverse=True)
        bins, offsets, held = B.best_fit_decreasing(np.array(sizes, np.int64), capacity)
        plain: list[int] = []
        for k, s in enumerate(sizes):
            fit = [j for j, h in enumerate(plain) if h + s <= capacity]
            if fit:
                best = max(plain[j] for j in fit)
                assert held[bins[k]] <= capacity
                j = next(j for j in fit if plain[j] == best)
                plain[j] += s
            else:
                plain.append(s)
        assert sorted(plain) == sorted(held.tolist())
        assert B.lower_bound(np.array(sizes), capacity) <= len(plain)
        assert B.lower_bound(np.array(sizes), capacity) >= -(-sum(sizes) // capacity)
    assert B.lower_bound(np.array([60, 60, 60, 30]), 100) == 3


def _checked(rows, capacity, texts, encoder):  # noqa: ANN001
    by: dict = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append(r)
        assert 1 <= r.length <= capacity
    for own in by.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    ids = {k: [*encoder.encode(t or "", add_special_tokens=False).ids, 0] for k, t in texts}
    for r in rows:
        if r.doc_id is not None:
            part = ids[r.doc_id][r.start : r.start + r.length]
            assert r.start == r.piece * capacity
            assert r.length == len(part)
            assert r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
    return len(by), -(-sum(r.length for r in rows) // capacity)


def test_packed_documents(spark, encoder):
    got = B.pack_documents(edge.frame(spark), PATH, 0, 256).collect()
    used, least = _checked(got, 256, [(k, t) for k, t, *_ in edge.rows() if k is not None], encoder)
    assert used <= least + 1
    assert B.pack_documents(edge.empty(spark), PATH).count() == 0


def test_equal_pieces_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(shared, "UNFOLD", 128)
    rows = [(None, 0, 0, 100, 5)] * 3000 + [(1, 0, 0, 7, 5), (2, 0, 0, 2048, 1)]
    pieces = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long")
    told = shared.numbered(pieces).collect()
    assert sorted(r.copy for r in told if r.doc_id is None) == list(range(1, 3001))
    out = B.pack(pieces, 2048, 64).collect()
    assert len(out) == 3002
    assert len({r.sequence_id for r in out}) <= 151 + 47 // 4  # 47 buckets of 64; a bucket's last sequence may stay more than half full
    most = max(Counter(r.sequence_id for r in out if r.length == 100).values())
    assert most == 20


def test_buckets_exchange_what_fits_badly(spark):
    rng = random.Random(4)
    rows = [(k, 0, 0, rng.choice((rng.randint(1, 200), 2048, rng.randint(900, 1100))), k) for k in range(900)]
    got = B.pack(spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long"), 2048, bucket=100).collect()
    assert sorted((r.doc_id, r.length) for r in got) == [(k, n) for k, _, _, n, _ in rows]
    held: dict = {}
    for r in got:
        held[r.sequence_id] = held.get(r.sequence_id, 0) + r.length
    assert max(held.values()) <= 2048
    assert len(held) <= 1.03 * B.lower_bound(np.array([n for *_, n, _ in rows]), 2048) + 1


# 5 token counts


def test_ledger_adds_takes_away_and_commits_once(spark):
    df = edge.frame(spark)
    ledger = C.Ledger(spark, new_path(spark, "ledger"))
    assert ledger.totals().count() == 0
    from pyspark.sql import functions as F

    n = C.count_tokens(F.col("text"), "words-1")
    assert ledger.commit("b1", C.changes(df, 1, n, F.lit("v")))
    assert not ledger.commit("b1", C.changes(df, 1, n, F.lit("v")))
    want: dict = {}
    for _, t, lang, source, *_ in edge.rows():
        d, k = want.get((source, lang), (0, 0))
        want[source, lang] = (d + 1, k + len(edge.words(t)))
    got = {(r.source, r.lang): (r.documents, r.tokens) for r in ledger.totals().collect()}
    assert got == want
    assert ledger.commit("b2", C.changes(df.where("source = 's1'"), -1, n, F.lit("v")))
    assert ledger.commit("b3", C.revisions(df.where("doc_id = 12"), F.lit(3), F.lit(5), F.lit("v")))
    assert ledger.commit("b4", C.changes(edge.empty(spark), 1, n, F.lit("v")))
    got = {(r.source, r.lang): (r.documents, r.tokens) for r in ledger.totals().collect()}
    want = {k: v for k, v in want.items() if k[0] != "s1"}
    want["s3", "de"] = (want["s3", "de"][0], want["s3", "de"][1] + 2)
    assert got == want
    assert ledger.batches() == ["b1", "b2", "b3", "b4"]
    with pytest.raises(ValueError, match="name"):
        ledger.commit("../x", C.changes(df, 1, n, F.lit("v")))


def test_a_commit_that_died_is_not_read(spark):
    from pyspark.sql import functions as F

    ledger = C.Ledger(spark, new_path(spark, "ledger"))
    deltas = C.changes(edge.frame(spark), 1, F.lit(1), F.lit("v"))
    ledger._write("b1", deltas)
    assert ledger.totals().count() == 0
    assert ledger.commit("b1", deltas)
    assert ledger.totals().groupBy().sum("documents").first()[0] == len(edge.rows())


def test_of_two_writers_of_a_name_one_wins(spark):
    """Both have written their tables before either commits; and a writer that died within its commit counts."""
    from pyspark.sql import functions as F

    ledger, other = (C.Ledger(spark, f) for f in [new_path(spark, "ledger")] * 2)
    deltas = C.changes(edge.frame(spark), 1, F.lit(1), F.lit("v"))
    tables = [x._write("b1", deltas) for x in (ledger, other)]
    assert [ledger._settle("b1", tables[0]), other._settle("b1", tables[1])] == [True, False]
    assert other.totals().groupBy().sum("documents").first()[0] == len(edge.rows())
    ledger._write("b2", deltas)
    assert ledger._create(f"{ledger.folder}/committed/b2", "")
    assert not other.commit("b2", deltas)
    assert other.totals().groupBy().sum("documents").first()[0] == 2 * len(edge.rows())


def test_compaction_changes_no_total(spark):
    from pyspark.sql import functions as F

    ledger = C.Ledger(spark, new_path(spark, "ledger"))
    assert ledger.totals().count() == 0
    for k in range(3):
        ledger.commit(f"b{k}", C.changes(edge.frame(spark), 1, F.lit(k), F.lit("v")))
    before = sorted(ledger.totals().collect(), key=str)
    assert ledger.compact() == 3
    assert sorted(ledger.totals().collect(), key=str) == before
    assert not ledger.commit("b1", C.changes(edge.frame(spark), 1, F.lit(9), F.lit("v")))
    assert ledger.commit("b3", C.changes(edge.frame(spark), -1, F.lit(0), F.lit("v")))
    after = {(r.source, r.lang): (r.documents, r.tokens, r.batches) for r in ledger.totals().collect()}
    assert after == {(r.source, r.lang): (r.documents * 2 // 3, r.tokens, 4) for r in before}
    assert ledger.compact() == 4
    assert {(r.source, r.lang): (r.documents, r.tokens, r.batches) for r in ledger.totals().collect()} == after


def test_tokens_of_a_real_tokenizer(spark, encoder):
    got = C.with_token_counts(edge.frame(spark), PATH, "tokens").collect()
    assert all(r.tokens == len(encoder.encode(r.text or "", add_special_tokens=False).ids) for r in got)
    assert C.with_token_counts(edge.empty(spark), PATH, "tokens").count() == 0


# 6 mixing


def _targets(sizes: dict) -> dict:
    """Shares by weight, and what is above three times the size goes to the others again."""
    order = sorted((k for k in sizes if k is not None)) + ([None] if None in sizes else [])
    weight = {k: (1, 2, 3)[i % 3] for i, k in enumerate(order)}
    fixed: dict = {}
    left, free = sum(sizes.values()), set(order)
    while free:
        level = left / sum(weight[k] for k in free)
        over = {k for k in free if level * weight[k] > 3 * sizes[k] + 1e-9}
        if not over:
            return fixed | {k: level * weight[k] for k in free}
        for k in over:
            fixed[k] = 3.0 * sizes[k]
            left -= fixed[k]
        free -= over
    return fixed


@pytest.mark.parametrize("bucket", [16_384, 40])
def test_a_mix_comes_near_its_targets(spark, monkeypatch, bucket):
    monkeypatch.setattr(X, "BUCKET", bucket)
    monkeypatch.setattr(X, "FAN_IN", 3)
    rng = random.Random(8)
    docs = [(k, " ".join(["w"] * rng.choice((0, 1, 5, 40, 200))), rng.choice(("a", "b", "c", "d", None)) if k % 50 else "rare") for k in range(900)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    got = X.mix(df).collect()
    assert len(got) == 900
    sizes: dict = {}
    for _, t, s in docs:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    want = _targets(sizes)
    for s, target in want.items():
        own = [r for r in got if r.source == s]
        assert all(abs(r.target - target) < 1e-6 and r.source_size == sizes[s] for r in own)
        assert abs(sum(r.taken for r in own) - target) <= 200
    assert all(r.taken == r.copies * r.size and 0 <= r.taken <= 3 * r.size for r in got)
    again = {r.doc_id: r.taken for r in X.mix(df).collect()}
    assert again == {r.doc_id: r.taken for r in got}


def test_expected_copies_are_the_rate():
    import pandas as pd

    n, taken = 40, np.zeros(40)
    for seed in range(400):
        g = pd.DataFrame({"name": [f"{k:02d}" for k in range(n)], "source": "a", "size": [1 + k % 4 for k in range(n)], "share": 0.3})
        taken += X._settle(seed, False)(g).set_index("name")["share"].sort_index().to_numpy()
    assert abs(taken / 400 - 0.3).max() < 0.12


def test_mix_of_odd_rows(spark):
    got = X.mix(edge.frame(spark)).collect()
    assert len(got) == len(edge.rows())
    assert X.mix(edge.empty(spark)).count() == 0
    assert X.take(edge.empty(spark)).count() == 0
    blank = X.mix(edge.frame(spark, [r for r in edge.rows() if r[0] in (4, 5, 6)])).collect()
    assert [r.taken for r in blank] == [0, 0, 0]


def test_rows_without_an_id_or_with_the_same_are_mixed_one_by_one(spark):
    """20 rows with a null id, 20 that repeat one, 30 equal rows and rows of their own: as many as the targets say, none above three times."""
    rows = [(None, f"no id {k} " + "w " * (k % 5), "en", "a", 0) for k in range(20)] + [(7, f"same id {k} " + "w " * (k % 5), "en", "b", 0) for k in range(20)]
    rows += [(None, "equal in all", "en", "c", 0)] * 30 + [(100 + k, f"own {k}", "en", "d", 0) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    sizes: dict = {}
    for _, text, _, source, _ in rows:
        sizes[source] = sizes.get(source, 0) + len(edge.words(text))
    targets = _targets(sizes)
    out = X.take(docs).collect()
    copies: dict = {}
    for r in out:
        copies[r.text] = copies.get(r.text, 0) + 1
    assert all(n <= 3 * sum(t == r[1] for r in rows) for t, n in copies.items())
    for source, target in targets.items():
        assert abs(sum(len(edge.words(r.text)) for r in out if r.source == source) - target) <= 7
    mixed = X.mix(docs).collect()
    assert len(mixed) == len(rows)
    assert all(r.taken <= 3 * r.size for r in mixed)
    assert {s: sum(r.taken for r in mixed if r.source == s) for s in sizes} == pytest.approx(targets, abs=7)


def test_large_ids_stay_exact_beside_null_ones(spark):
    ids = [2**62 + k for k in range(5)] + [None]
    got = X.mix(spark.createDataFrame([(k, "a b", "s") for k in ids], "doc_id long, text string, source string")).collect()
    assert sorted((r.doc_id for r in got), key=str) == sorted(ids, key=str)


# 8 fingerprints


def _plain_print(text: str) -> str:
    """The fingerprint by Python's whole numbers: a polynomial of each run of 12 bytes, spread by three multiplications, a sixteenth kept."""
    data, mask, base = text.encode(), 2**64 - 1, 0x9E3779B97F4A7C15

    def spread(x: int) -> int:
        x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & mask
        x = (x ^ (x >> 27)) * 0x94D049BB133111EB & mask
        return x ^ (x >> 31)

    if len(data) < 12:
        return base64.b64encode(b"".join((xxhash.xxh3_64_intdigest(data) >> 32).to_bytes(4, "little") for _ in range(bool(data)))).decode()
    hashes = {spread(sum((c + 1) * pow(base, k, 2**64) for k, c in enumerate(data[a : a + 12])) & mask) for a in range(len(data) - 11)}
    kept = {h for h in hashes if h < 2**60} or {min(hashes)}
    return base64.b64encode(b"".join(x.to_bytes(4, "little") for x in sorted({(h * 16 & mask) >> 32 for h in kept}))).decode()


def test_fingerprints_are_the_plain_ones(spark):
    rng = random.Random(4)
    texts = ["", "a", "short text", "hello world foo bar", "stock prices fell", "ééé ßßß ñ\U0001f600 x"] + ["".join(rng.choice("abc de\u00e9") for _ in range(rng.randint(5, 300))) for _ in range(60)]
    got = P.fingerprints(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id: r.fingerprint for r in got} == {k: _plain_print(t) for k, t in enumerate(texts)}
    compared = P.compare_with_edits(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), chains=5).collect()
    for r in compared:
        after = texts[r.doc_id - 1] if r.doc_id else texts[-1]
        third = len(texts[r.doc_id]) // 3
        new = texts[r.doc_id][: len(texts[r.doc_id]) - third] + after[:third]
        prints = [{base64.b64decode(_plain_print(t))[k : k + 4] for k in range(0, len(base64.b64decode(_plain_print(t))), 4)} for t in (texts[r.doc_id], new, after)]
        like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
        assert (r.fingerprint, r.edited_fingerprint) == (_plain_print(texts[r.doc_id]), _plain_print(new))
        assert (r.near_edited, r.near_next) == (like(prints[0], prints[1]), like(prints[0], prints[2]))
    assert len(compared) == len(texts)


def test_neighbours_are_compared_across_all_ranges(spark):
    docs = [(r[0], r[1]) for r in edge.rows() if r[0] not in (None, 11)] + [(k, f"document {k} " + "word " * (k % 7) * 9) for k in range(20, 60)]
    order = sorted(docs, key=lambda r: -r[0])
    for chains in (2, 7):
        got = {r.doc_id: r for r in P.compare_with_edits(spark.createDataFrame(docs, "doc_id long, text string"), chains=chains).collect()}
        assert len(got) == len(docs)
        for k, (key, text) in enumerate(order):
            text, after = text or "", order[(k + 1) % len(order)][1] or ""
            new = text[: len(text) - len(text) // 3] + after[: len(text) // 3]
            own, other, following = (P.sketch(x.encode()) for x in (text, new, after))
            r = got[key]
            assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(new.encode()).hexdigest())
            assert (r.fingerprint, r.edited_fingerprint) == (P.to_text(own), P.to_text(other))
            assert (r.near_edited, r.near_next) == (P.likeness(own, other), P.likeness(own, following))


def test_odd_rows_have_fingerprints(spark):
    got = P.compare_with_edits(edge.frame(spark)).collect()
    assert len(got) == len(edge.rows())
    assert P.compare_with_edits(edge.empty(spark)).count() == 0
    assert P.compare_with_edits(edge.frame(spark, edge.rows()[:1])).count() == 1
    plain = P.fingerprints(edge.frame(spark)).collect()
    assert {r.fingerprint for r in plain if r.doc_id in (1, 2)} == {P.to_text(P.sketch((edge.PASSAGE * 3).encode()))}
    assert {r.fingerprint for r in plain if r.doc_id in (4, 5)} == {""}


def test_short_texts_have_fingerprints():
    rng = random.Random(4)
    texts = ["".join(rng.choice(letters) for _ in range(n)) for n in range(12, 61) for letters in ("abcdefgh", "stuvwxyz")]
    prints = [P.sketch(x.encode()) for x in texts]
    assert all(len(x) for x in prints)
    assert all(P.likeness(a, b) == 0 for a, b in zip(prints[::2], prints[1::2], strict=True))
    assert P.likeness(P.sketch(b""), P.sketch(b"")) == 1
    assert all(P.likeness(x, P.sketch(b"")) == 0 for x in prints)


def test_sketches_merge_and_estimate_containment():
    rng = random.Random(3)
    part = "".join(rng.choice("abcdefgh ") for _ in range(40_000))
    rest = "".join(rng.choice("ijklmnop ") for _ in range(400_000))
    whole = (rest + part).encode()
    a, b = P.sketch(part.encode()), P.sketch(whole)
    assert P.containment(a, b) > 0.99
    assert P.containment(b, a) < 0.2
    cut = len(whole) // 2
    assert set(b) <= set(P.merge(P.merge(P.sketch(whole[:cut]), P.sketch(whole[cut:])), P.sketch(whole[cut - 20 : cut + 20])))
    assert abs(len(a) - 40_000 / P.FRACTION) < 400
    assert (P.from_text(P.to_text(a)) == a).all()


# 9 language


def test_languages_are_told_apart_on_held_out_texts(spark, data_dir):
    docs = spark.read.parquet(f"{data_dir}/documents.parquet")
    got = G.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert len(held) > 20
    assert sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)


def test_grams_are_the_plain_ones():
    import pyarrow as pa

    texts = ["Ab, c!  déf", "", None, "1 2", "x", " a\nb"]
    found = G.grams(pa.array(texts))
    for k, text in enumerate(texts):
        runs = "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()
        want: list[list[str]] = [[], [], []]
        line = " " + " ".join(runs) + " " if runs else ""
        for n in (1, 2, 3):
            for i in range(len(line) - n + 1):
                gram = line[i : i + n]
                if (n == 1 and gram != " ") or (n == 2 and gram != "  ") or (n == 3 and gram[1] != " "):
                    want[n - 1].append(gram)
        for n, (codes, owners) in enumerate(found):
            own = codes[owners == k]
            assert len(own) == len(want[n])
            plain = [sum((0 if c == " " else ord(c)) << (21 * (n - i)) for i, c in enumerate(g)) | (0, 1 << 62, 1 << 63)[n] for g in want[n]]
            assert own.tolist() == plain


def test_odd_rows_get_a_language_or_none(spark):
    got = G.identify(edge.frame(spark)).collect()
    assert len(got) == len(edge.rows())
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert all(by[k].lang_pred == "und" and by[k].score == 0 for k in (4, 5, 6, 13))
    assert by[11].lang_pred in ("fr", "en", "de")
    assert G.identify(edge.empty(spark)).count() == 0
    unlabelled = [(*r[:2], None, *r[3:]) for r in edge.rows()]
    assert {r.lang_pred for r in G.identify(edge.frame(spark, unlabelled)).collect()} == {"und"}


def _plain_grams(text: str) -> Counter:
    """Letters, and pairs and triples of letters and word ends (0) in a word with its ends, as tuples that sort as codes do."""
    out: Counter = Counter()
    for word in "".join(c if c.isalpha() else " " for c in text.lower()).split():
        whole = [0, *map(ord, word), 0]
        out.update((1, c) for c in whole[1:-1])
        for n in (2, 3):
            out.update((n, *whole[k : k + n]) for k in range(len(whole) - n + 1))
    return out


def _ranked(counts: Counter, size: int) -> list:
    return sorted(counts, key=lambda g: (-counts[g], g))[:size]


@pytest.mark.parametrize("size", [15, 400])
def test_predictions_are_the_plain_ones(spark, size):
    from pyspark.sql import functions as F

    rng = random.Random(size)
    say = lambda letters: " ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 6))) for _ in range(rng.randint(1, 40)))
    rows = [(k, say("abcde" if k % 3 else "cdefg"), "xx" if k % 3 else "yy") for k in range(60)] + [(60, "", "xx"), (61, "12 !", "yy"), (62, None, "xx"), (63, "abc", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    profiles: dict = {}
    for _, text, lang in rows:
        if text is not None and lang is not None:
            profiles.setdefault(lang, Counter()).update(_plain_grams(text))
    profiles = {x: {g: k for k, g in enumerate(_ranked(c, size))} for x, c in sorted(profiles.items())}
    got = {r.doc_id: r for r in G.predict(docs, G.learn(docs, F.col("lang"), size=size), ["doc_id"]).collect()}
    for key, text, _ in rows:
        own = _ranked(_plain_grams(text or ""), size)
        if not own:
            assert (got[key].lang_pred, got[key].score) == ("und", 0.0)
            continue
        away = {x: sum(min(abs(p[g] - k), size) if g in p else size for k, g in enumerate(own)) for x, p in profiles.items()}
        best = min(away, key=lambda x: (away[x], x))
        assert got[key].lang_pred == best
        assert got[key].score == pytest.approx(1 - away[best] / (size * len(own)))


# 10 token files


def test_files_hold_all_ids_in_order(spark, encoder):
    texts = {r[0]: r[1] for r in edge.rows() if r[0] is not None}
    docs = [(k, t) for k, t in texts.items()]
    files = R.write_token_files(spark.createDataFrame(docs, "doc_id long, text string"), PATH, 1)
    start = 0
    got = {r.doc_id: r for r in R.read_token_files(files).collect()}
    for key in sorted(texts):
        ids = [*encoder.encode(texts[key] or "", add_special_tokens=False).ids, 1]
        assert (got[key].start, got[key].n_tokens, got[key].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    row = files.first()
    key, ids = R.read_record(row.store, row.file, row.records - 1, row.width)
    assert ids.tolist() == [*encoder.encode(texts[key] or "", add_special_tokens=False).ids, 1]


def test_files_of_odd_rows(spark):
    got = R.read_token_files(R.write_token_files(edge.frame(spark), PATH, 1)).collect()
    assert len(got) == len(edge.rows())
    assert sorted(r.start for r in got if r.doc_id is None)[0] == 0
    assert R.read_token_files(R.write_token_files(edge.empty(spark), PATH, 1)).count() == 0


def test_damage_is_noticed():
    record = R.frame(b"payload")
    assert bytes(R.unframe(memoryview(record), 0)[0]) == b"payload"
    for k in range(len(record)):
        bad = bytearray(record)
        bad[k] ^= 1
        with pytest.raises((ValueError, OverflowError)):
            R.unframe(memoryview(bytes(bad)), 0)
