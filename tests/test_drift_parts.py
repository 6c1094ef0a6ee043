"""Drift statistics over parts of consecutive values against one part that holds them all."""

import numpy as np
import pandas as pd
import pytest

from marketframe.operators import drift

LONG = "symbol string, feature string, split string, value double"


@pytest.fixture(scope="module")
def counts(spark):
    rng = np.random.default_rng(1)
    rows = [("A", "f", "reference" if rng.random() < 0.7 else "current", float(round(rng.normal(), 2))) for _ in range(3000)]
    rows += [("A", "g", "reference", 1.0), ("A", "g", "current", 2.0), ("B", "h", "current", 2.0), ("B", "i", "reference", None),
             ("B", "j", "reference", float("nan"))]
    return drift.value_counts(spark.createDataFrame(rows, LONG))


@pytest.mark.parametrize("n_parts", [2, 9])
def test_parts_change_nothing(counts, n_parts):
    def of(n):
        return drift.drift_statistics(counts, n_parts=n).toPandas().sort_values(["symbol", "feature"]).reset_index(drop=True)

    pd.testing.assert_frame_equal(of(n_parts), of(1))


def test_hot_feature_is_spread(counts):
    """One feature that holds nearly all values lies in several parts, whose offsets add up."""
    dealt = drift.in_parts(counts, 9)
    parts = drift.part_totals(dealt).where("feature = 'f'").orderBy("_part").collect()
    sizes = [r["count"] for r in dealt.where("feature = 'f'").groupBy("_part").count().collect()]
    assert len(parts) >= 7 and max(sizes) < 0.3 * sum(sizes)
    assert parts[0]._before_ref == 0 and parts[-1]._next is None
    assert all(a._before_ref < b._before_ref <= b.ref_total for a, b in zip(parts, parts[1:]))


def test_no_rows(spark):
    assert drift.drift_statistics(drift.value_counts(spark.createDataFrame([], LONG))).count() == 0
