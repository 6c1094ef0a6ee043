"""Fits start as many tasks as their rows call for, and each run of the stack scores its own rows only."""

import numpy as np
from pyspark.sql import functions as F

from marketframe.operators import stack
from marketframe.session import cut_lineage, packed


def test_packed_follows_the_rows(spark):
    many = cut_lineage(spark.range(0, 1000, 1, 60))
    assert packed(many).rdd.getNumPartitions() == 12
    assert packed(many, 50).rdd.getNumPartitions() == 20
    assert packed(spark.range(0, 1000, 1, 5)).rdd.getNumPartitions() == 5
    assert packed(many).agg(F.sum("id"), F.count("*")).first()[:] == (499500, 1000)


def test_each_run_scores_its_own_rows(spark):
    rng = np.random.default_rng(5)
    rows = [(run, "A", i, int(rng.integers(5)), i // 40 - 1, *map(float, rng.normal(size=2))) for run in (1, 2) for i in range(120)
            if i // 40 - 1 <= run]
    t = cut_lineage(spark.createDataFrame(rows, "run int, symbol string, date int, label int, fold int, a double, b double")
                    .withColumn("_from_end", F.lit(1)))
    boosted, models = stack._boosted(t, t.where("fold < run"), ["a", "b"], 2, {"rounds": 3})
    assert set(boosted) == set(models) == {1, 2}
    for run, scored in boosted.items():
        assert scored._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
        got = scored.collect()
        assert sorted((r["run"], r["date"]) for r in got) == sorted((x[0], x[2]) for x in rows if x[0] == x[4] == run)
        assert all(abs(sum(r["probs"]) - 1) < 1e-9 for r in got)
