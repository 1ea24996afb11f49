"""What the Arrow functions hold at once is bounded, and each runs once."""

import os

import numpy as np
import pyarrow as pa
import pytest

import __spark_entry__
from tapeloom.functions import folds

DATA = "/root/testdata/sf0.001"


def test_a_fold_takes_few_elements_at_once(monkeypatch):
    monkeypatch.setattr(folds, "PART", 10)
    sizes = [4, 6, 1, 0, 0, 25, 3, 7, 0, 10, 1]
    values = np.arange(sum(sizes), dtype=np.float64)
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array(values))
    seen = []

    def doubled(x: pa.Array, y: pa.Array) -> pa.Array:
        seen.append(x.value_lengths().to_pylist())
        assert x.equals(y)
        return pa.ListArray.from_arrays(pa.array(folds._offsets(x), pa.int32()), pa.array(x.flatten().to_numpy() * 2))

    got = folds.in_parts(doubled)(lists.slice(1), lists.slice(1))
    assert got.to_pylist() == [[2 * v for v in x] for x in lists.slice(1).to_pylist()]
    assert sum(seen, []) == sizes[1:] and max(sum(s) for s in seen if len(s) > 1) <= 10 and len(seen) == 5
    assert folds.in_parts(doubled)(lists.slice(0, 0), lists.slice(0, 0)).to_pylist() == []


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name", ["legs_outlier", "legs_fixed", "trades_table", "confluence_any"])
def test_the_walk_and_the_rules_run_once_in_one_worker(spark, name):
    plan = __spark_entry__.queries()[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
