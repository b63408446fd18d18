"""The pipeline's stages, each against brute force over what it was given."""

from __future__ import annotations

import collections

import corpus_pipeline as pipeline
from occgraph.llm.queries import vocabulary_path
from occgraph.llm.packing import Tokens
from tests.llm.awkward import documents
from tests.llm.test_divergence import plain
from tests.llm.test_packing import check
from tests.llm.test_resemblance import similar_components
from tests.llm.test_suffixes import brute_words


def staged(spark, docs, sf, folder):
    """The input and the output of every stage."""
    seen = []
    for i, (name, stage) in enumerate(pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(f"{folder}/{i}")
        out = spark.read.parquet(f"{folder}/{i}")
        seen.append((docs.collect(), out.collect()))
        docs = out
    return seen


def test_stages_against_brute_force(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    quality, near, repeats, mix, packed = staged(spark, docs, sf, str(tmp_path))
    given, kept = quality
    passed = {r["doc_id"] for r in given if not plain(r["text"])[5]}
    assert {r["doc_id"] for r in kept} <= passed and len(kept) > 0.9 * len(passed)

    given, kept = near
    component = similar_components({r["doc_id"]: r["text"] or "" for r in given})
    assert sorted(r["doc_id"] for r in kept) == sorted(set(component.values()))

    given, kept = repeats
    want = {r["doc_id"]: b for r, b in zip(given, brute_words([r["text"] for r in given]))}
    for r in kept:
        assert r["text"].encode().split() == want[r["doc_id"]].encode().split() and r["n_chars"] == len(r["text"])
    assert len(kept) == len(given)

    given, kept = mix
    copies = collections.Counter(r["doc_id"] for r in kept)
    texts = {r["doc_id"]: r for r in given}
    assert max(copies.values()) <= 3 and all(r == texts[r["doc_id"]] for r in kept)

    given, kept = packed
    assert sum(r["length"] for r in kept) == sum(len(Tokens.ids(TOKENS, r["text"])) // 2 + 1 for r in given)
    check([r for r in kept if copies[r["doc_id"]] == 1 or True], [(r["doc_id"], r["text"]) for r in given], TOKENS)


TOKENS = Tokens(vocabulary_path())


def test_run_gives_the_last_stage(spark, sf):
    rows = pipeline.run(spark, sf)
    assert {"doc_id", "start", "length", "sequence_id", "offset"} <= set(rows.columns) and rows.count() > 0
    assert [name for name, _ in pipeline.STAGES] == ["quality_rules", "near_duplicates", "repeated_passages", "source_mix", "packed_sequences"]


def test_awkward_rows(spark, tmp_path):
    for i, rows in enumerate((None, [])):
        seen = staged(spark, documents(spark, rows), "", f"{tmp_path}/{i}")
        assert all(set(a[0].asDict()) == set(b[0].asDict()) for a, b in seen[:-1] if a and b)
        assert rows is None or not seen[-1][1]
