from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import text as T

from . import edge

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")


@given(st.lists(st.one_of(st.none(), st.text(), st.text(alphabet="abÉİΣß'.,;:!?|- \x1ć\n\t12½AZ", max_size=60)), max_size=12))
@settings(max_examples=150, deadline=None)
def test_wordwise_ids_are_the_tokenizers(texts):
    encoder = T.WordwiseTokenizer.at(PATH)
    ends, ids = encoder.encode(pa.array(texts, pa.string()))
    for k, text in enumerate(texts):
        assert encoder.tokenizer.encode(text or "", add_special_tokens=False).ids == ids[ends[k] : ends[k + 1]].tolist()


def test_wordwise_forgets_and_stays_exact():
    encoder = T.WordwiseTokenizer(PATH, most=3)
    for text in ("a b c", "d e f g.", "a b, c"):
        ends, ids = encoder.encode(pa.array([text]))
        assert ids.tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids


def test_a_tokenizer_that_heeds_space_is_refused():
    with pytest.raises(ValueError, match="white space"):
        T.WordwiseTokenizer(public_tokenizers.path("byte_bpe_50k.json"))


@given(st.lists(st.one_of(st.none(), st.text(alphabet="aAbB \t\n\x0b\x0c\r\x1cé", max_size=30)), max_size=10))
@settings(max_examples=100, deadline=None)
def test_words(texts):
    starts, flat = T.words(pa.array(texts, pa.string()))
    got = [flat.to_pylist()[a:b] for a, b in zip(starts[:-1], starts[1:], strict=True)]
    assert [[w.lower() for w in g] for g in got] == [[w.lower() for w in edge.words(t)] for t in texts]


@given(st.lists(st.text(alphabet="abcA \n", max_size=40), max_size=8), st.integers(1, 5))
@settings(max_examples=100, deadline=None)
def test_shingle_sets_have_the_plain_sizes_and_overlaps(texts, n):
    sets = T.shingle_hashes(*T.word_hashes(pa.array(texts, pa.string())), n)
    plain = [edge.shingles(t, n) for t in texts]
    assert [len(s) for s in sets] == [len(p) for p in plain]
    for i in range(len(texts)):
        for j in range(i):
            assert len(np.intersect1d(sets[i], sets[j])) == len(plain[i] & plain[j])


def test_chunks_keep_all_rows():
    batch = pa.RecordBatch.from_pydict({"text": ["x" * 50, None, "", "y" * 500, "z"]})
    parts = list(T.chunks([batch, batch.slice(0, 0)], "text", 60))
    assert len(parts) > 1
    assert sum((p.column("text").to_pylist() for p in parts), []) == batch.column("text").to_pylist()
