"""Shared folder, clean-up, size checks and staleness."""

from __future__ import annotations

import os
import time

import pytest

from occgraph.operators.resultsets import require_same_age
from occgraph.session import materialize, shared_dir, small_values


def test_materialize_writes_to_the_shared_folder(spark):
    df = materialize(spark.range(10))
    assert df.count() == 10 and df.inputFiles()[0].replace("file://", "").startswith(shared_dir(spark).replace("file:", ""))


def test_small_values_are_checked(spark):
    assert small_values(spark.range(5), "id") == [0, 1, 2, 3, 4]
    with pytest.raises(ValueError):
        small_values(spark.range(20), "id", limit=10)


def test_stale_companion_is_refused(spark, tmp_path):
    new, old = str(tmp_path / "new"), str(tmp_path / "old")
    for p in (new, old):
        spark.range(3).write.parquet(p)
    require_same_age(spark, new, old)
    past = time.time() - 7200
    for f in os.listdir(old):
        os.utime(os.path.join(old, f), (past, past))
    with pytest.raises(ValueError, match="stale"):
        require_same_age(spark, new, old)
