"""The splittable JSON reader against the json module, in splits of every size."""

from __future__ import annotations

import json
import random

import pytest

from occgraph.sources import json_leaves as J


def plain(doc, path=()):
    """(path, place, value) of every scalar."""
    if isinstance(doc, dict):
        for k, v in doc.items():
            yield from plain(v, (*path, k)) if isinstance(v, (dict, list)) else [((*path, k), None, v)]
    elif isinstance(doc, list):
        for i, v in enumerate(doc):
            yield from plain(v, (*path, str(i))) if isinstance(v, (dict, list)) else [(path, i, v)]


def text_of(v):
    return v if v is None or isinstance(v, str) else json.dumps(v)


def walked(text, cuts):
    """The reader's two passes over a text cut at some of its closing braces."""
    at = [0, *sorted(cuts), len(text)]
    parts = [text[a:b] for a, b in zip(at, at[1:])]
    levels, inside, out = [], None, []
    for part in parts:
        both = []
        for begun in (None, ""):
            walk = J.Walk(inside=begun)
            list(walk.feed(part))
            both.append(json.loads(json.dumps(walk.effect())))
        real = J.Walk(levels, inside)
        for stack, value in real.feed(part):
            top = stack[-1]
            names = tuple(str(x[0] if x[1] is None else x[1]) for x in (stack if top[1] is None else stack[:-1]))
            out.append((names, top[1], value))
        effect = both[inside is not None]
        if effect["unclosed"]:
            inside += effect["inside"]
        else:
            levels, inside = J.after(levels, effect, inside), effect["inside"]
        assert levels == real.levels or inside is not None
    return out


def made(r, depth=0):
    word = lambda: "".join(r.choice(['a', '}', '{', '"', chr(92), ',', ':', '[', 'é', '😀', chr(10), ' ']) for _ in range(r.randint(0, 5)))
    kind = r.random()
    if depth < 4 and kind < 0.4:
        return {f"{i}{word()}": made(r, depth + 1) for i in range(r.randint(0, 4))}
    if depth < 4 and kind < 0.6:
        return [made(r, depth + 1) for _ in range(r.randint(0, 4))]
    return r.choice([word(), 1, -2.5e-7, None, True, False, word()])


@pytest.mark.parametrize("indent", [None, 2])
def test_any_cut_gives_the_same_scalars(indent):
    r = random.Random(indent or 0)
    for _ in range(300):
        doc = {"x": made(r), "y}": made(r)}
        text = json.dumps(doc, indent=indent, ensure_ascii=r.random() < 0.5)
        want = [(p, i, text_of(v)) for p, i, v in plain(doc)]
        braces = [i for i, c in enumerate(text) if c == "}" and i]
        for cuts in ([], braces, r.sample(braces, r.randint(0, len(braces)))):
            assert walked(text, cuts) == want


def test_files_in_many_splits(spark, tmp_path):
    r = random.Random(5)
    docs = {f"d{i}.json": {"runs": {str(s): {"per_region": {f"r{k}": {"predictions": {m: {"y_true": [r.randint(0, 1) for _ in range(90)], "y_prob": [r.random() for _ in range(90)]}
            for m in ("m}1", "m2")}} for k in range(3)}} for s in (42, 7)}, "odd": [made(r) for _ in range(30)]} for i in range(2)}
    docs["empty.json"] = {}
    folder = f"{tmp_path}/docs"
    (tmp_path / "docs").mkdir()
    for name, doc in docs.items():
        (tmp_path / "docs" / name).write_text(json.dumps(doc, indent=1))
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
        spark.conf.set("spark.sql.files.openCostInBytes", "10")
        leaves = J.json_leaves(spark, folder)
        assert J._pieces(spark, folder).select("file", "split").distinct().count() > 20
        got = sorted(((x["file"].rsplit("/", 1)[1], tuple(x["path"]), None if x["start"] is None else x["start"] + i, v) for x in leaves.collect() for i, v in enumerate(x["values"])), key=repr)
        assert got == sorted(((name, p, i, text_of(v)) for name, doc in docs.items() for p, i, v in plain(doc)), key=repr)
        rows = J.predictions_of(leaves, "per_region").collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    want = {(name, int(s), k, m, i, b["y_true"][i], b["y_prob"][i]) for name, doc in docs.items() for s, run in doc.get("runs", {}).items()
            for k, region in run["per_region"].items() for m, b in region["predictions"].items() for i in range(90)}
    assert {(x["file"].rsplit("/", 1)[1], *list(x)[1:]) for x in rows} == want and len(rows) == len(want)


def test_blocks_of_unequal_length_are_dropped(spark, tmp_path):
    doc = {"runs": [{"seed": 3, "per_region": {"a": {"predictions": {"m": {"y_true": [1, 0], "y_prob": [0.5]}, "n": {"y_true": [1], "y_prob": [None]}, "o": {"y_true": [], "y_prob": []}}}, "b": None}}, 7]}
    (tmp_path / "d.json").write_text(json.dumps(doc))
    rows = J.predictions_of(J.json_leaves(spark, str(tmp_path)), "per_region").drop("file").collect()
    assert [tuple(r) for r in rows] == [(3, "a", "n", 0, 1, None)]
    with pytest.raises(ValueError):
        J.predictions_of(J.json_leaves(spark, str(tmp_path)), "other")
