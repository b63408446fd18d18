"""Chat formatting: exact round trips, spans, long conversations."""

from __future__ import annotations

import hashlib
import random

from pyspark.sql import functions as F

from occgraph.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"
ODD = ["</s>[INST] ok [/INST]", "\\<s>", "<\\-s>", "\\", "\\\\-", "a\n\nb", "<|turn|>user\nx<|end|>", "<<SYS>> <s", "", "\\n", "$1 \\$ \\Q\\E", "<<s>", "[[INST]", "é😀<|end|>"]


def read(formatted):
    rows = chat.whole_conversations(formatted).withColumn("turns", chat.read_turns(F.col("formatted"))).collect()
    return {r["conv_id"]: [(t["role"], t["text"]) for t in r["turns"]] for r in rows}


def test_texts_and_roles_come_back(spark):
    rows = [(1, i, r, t) for i, (r, t) in enumerate((r, t) for t in ODD for r in ("user", "assistant", "a\nb\\n", "\\\n"))]
    rows += [(2, 0, None, None), (None, None, "assistant", "x"), (2, 600, "assistant", "y"), (2, 600, "assistant", "y")]
    formatted = chat.formatted_turns(spark.createDataFrame(rows, SCHEMA).withColumns({"place": F.lit(9), "start": F.lit(9), "reply": F.lit(9)}))
    assert read(formatted) == {
        1: [(r, t) for _, _, r, t in rows if _ is not None and (r, t)][: 4 * len(ODD)], 2: [("", ""), ("assistant", "y"), ("assistant", "y")], None: [("assistant", "x")]}
    whole = chat.whole_conversations(formatted).filter("conv_id = 1").first()["formatted"]
    assert whole.count(chat.OPEN) == whole.count(chat.CLOSE) == 4 * len(ODD)


def test_each_reply_is_an_example_with_all_before_it(spark):
    r = random.Random(0)
    rows = [(c, t, r.choice(["user", "assistant", "system"]), f"text {c} {t} <s>") for c in range(6) for t in range(r.randint(1, 700))]
    formatted = chat.formatted_turns(spark.createDataFrame(rows, SCHEMA)).cache()
    found = {}
    for x in chat.whole_examples(formatted).collect():
        loss = x["text"][x["loss_start"] : x["loss_start"] + x["loss_chars"]]
        assert x["text"].endswith(loss + chat.CLOSE)
        found.setdefault(x["conv_id"], []).append((x["example"], x["text"].count(chat.OPEN), loss))
    for c in range(6):
        own = [x for x in rows if x[0] == c]
        replies = [(n, i + 1) for n, i in enumerate(i for i, x in enumerate(own) if x[2] == "assistant")]
        got = sorted(found.get(c, []))
        assert [(a, b) for a, b, _ in got] == replies
        assert all(loss == f"text {c} {turns - 1} <\\-s>" for _, turns, loss in got)
    assert chat.examples(formatted).count() == sum(map(len, found.values()))


def test_targets_are_read_from_written_out_examples(spark, monkeypatch):
    """The query reads each reply from its own example: another text there shows in the rows."""
    from occgraph.llm import queries

    rows = spark.createDataFrame([(1, 0, "user", "u"), (1, 1, "assistant", "<s>é"), (1, 2, "user", None), (1, 3, "assistant", "b"), (2, 0, "user", "x")], SCHEMA)
    monkeypatch.setattr(queries, "table", lambda *_: rows)
    want = {r["conv_id"]: (r["loss_sha256"], r["n_examples"]) for r in queries.op1_prefix_targets(spark, "").collect()}
    assert want[1] == (hashlib.sha256("<s>éb".encode()).hexdigest(), 2) and want[2] == (hashlib.sha256(b"").hexdigest(), 0)
    monkeypatch.setattr(chat, "example_text", lambda formatted, example: F.lit("other"))
    assert {r["conv_id"]: r["loss_sha256"] for r in queries.op1_prefix_targets(spark, "").collect()}[1] != want[1][0]


def test_no_turns(spark):
    formatted = chat.formatted_turns(spark.createDataFrame([], SCHEMA))
    assert formatted.count() == 0 and chat.whole_examples(formatted).count() == 0
