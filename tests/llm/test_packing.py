"""Packing: every token once, no padding, neighbours along the curve."""

from __future__ import annotations

import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from occgraph.llm import packing
from occgraph.llm.common import table
from occgraph.llm.queries import vocabulary_path
from tests.llm.awkward import documents


@pytest.fixture(scope="module")
def tokens():
    return packing.Tokens(vocabulary_path())


PARTS = ["a", "the", " b", "  ", "\n", "\n ", "\t", "é", "ß", "'s", "'ll", "1", "12", "!", "...", "€", "—", " ", "　", "漢字", "😀", "<|endoftext|>", "\x1c", "\x85", "​", "ñ", " Don't"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(PARTS), st.text(max_size=6)), max_size=15))
def test_ids_equal_the_tokenizers(tokens, parts):
    text = "".join(parts)
    assert np.frombuffer(tokens.ids(text), "<u2").tolist() == tokens.tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize(("dims", "bits"), [(2, 4), (3, 3), (4, 2)])
def test_the_curve_visits_neighbours(dims, bits):
    points = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
    keys = packing.hilbert_keys(points, bits)
    assert sorted(keys.tolist()) == list(range(len(points)))
    assert (np.abs(np.diff(points[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()


def check(rows, docs, tokens, length=1024):
    sequences, documents_ = {}, {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append(r)
        documents_.setdefault((r["doc_id"], r["doc_tokens"]), []).append(r)
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at and r["length"] > 0
            at += r["length"]
        assert at <= length and at & (at - 1) == 0  # full, or a smaller power of two
    want = sorted(((d, tuple(np.frombuffer(tokens.ids(t or ""), "<u2").tolist()) + (packing.END,)) for d, t in docs), key=str)
    got = []
    for (doc, n), own in documents_.items():
        starts = {}
        for r in own:
            ids = np.frombuffer(r["ids"], "<u2")
            assert len(ids) == r["length"] and zlib.crc32(ids.astype("<u4").tobytes()) == r["ids_crc32"]
            starts.setdefault(r["start"], []).append(ids)
        copies = len(starts[0])  # equal rows: equal documents, each cut in its own places
        if copies == 1:
            got.append((doc, tuple(np.concatenate([starts[s][0] for s in sorted(starts)]).tolist())))
        else:
            assert sum(len(i) for x in starts.values() for i in x) == copies * n
            got += [w for w in want if w[0] == doc and len(w[1]) == n]
    assert sorted(got, key=str) == want


def test_every_token_is_packed_once(spark, sf, tokens):
    docs = table(spark, sf, "documents")
    check(packing.pack(docs, vocabulary_path()).collect(), [(r["doc_id"], r["text"]) for r in docs.collect()], tokens)


def test_awkward_rows(spark, tokens):
    docs = documents(spark)
    check(packing.pack(docs, vocabulary_path()).collect(), [(r["doc_id"], r["text"]) for r in docs.collect()], tokens)
    assert packing.pack(documents(spark, []), vocabulary_path()).count() == 0


def test_like_documents_are_near_on_the_curve(tokens):
    r = np.random.default_rng(0)
    words = [[f"w{l}{i}" for i in range(40)] for l in "abcd"]
    texts = [" ".join(r.choice(words[i % 4], 200)) for i in range(80)]
    keys = packing.curve_keys([np.frombuffer(tokens.ids(t), "<u2") for t in texts], packing.projection(packing.DIMENSIONS))
    order = np.argsort(keys) % 4
    assert (order[1:] == order[:-1]).mean() > 0.7  # 0.25 by chance


@pytest.mark.parametrize("text", ["a <|endoftext|> b", "<|endoftext|>", "é<|endoftext|><|endoftext|>\x1c", "<|endoftext", "plain"])
def test_added_tokens_have_the_files_ids(spark, tokens, text):
    from tokenizers import Tokenizer

    want = Tokenizer.from_file(vocabulary_path()).encode(text, add_special_tokens=False).ids
    assert np.frombuffer(tokens.ids(text), "<u2").tolist() == want
    rows = packing.pack(spark.createDataFrame([(0, text)], "doc_id long, text string"), vocabulary_path(), with_ids=True).collect()
    assert {r["doc_tokens"] for r in rows} == {len(want) + 1}
