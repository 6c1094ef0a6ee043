"""Learners, search, leaderboard, importances and the run log.

One pooled model is fitted over all symbols (symbol-wise splits, folds and scaling); metrics are reported per
symbol. Forests, perceptrons and the panel are ``pyspark.ml``; boosting is ``boosting.py``. The driver only loops
over a handful of learners, each of which is a distributed fit; the trials of a search are one job.
"""

from __future__ import annotations

import math
import random
from collections.abc import Callable
from dataclasses import asdict, fields

from pyspark.ml.classification import (DecisionTreeClassifier, LogisticRegression, MultilayerPerceptronClassifier,
                                       NaiveBayes, RandomForestClassifier)
from pyspark.ml.feature import MinMaxScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import boosting
from ..config import DEFAULT
from ..session import cut_lineage
from .boosting import N_CLASSES
from .metrics import classification_metrics


def assemble(df: DataFrame, cols: list[str], out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=cols, outputCol=out, handleInvalid="keep").transform(df)


def probs_array(col: str = "probability") -> Column:
    return vector_to_array(F.col(col))


# ---- base learners --------------------------------------------------------------------------

def tree_learner(num_trees: int = 20, max_depth: int = 6, seed: int = DEFAULT.random_state, **kw):
    """ML-01: random forest (native multiclass, probability output)."""
    return RandomForestClassifier(labelCol="label", featuresCol="features", numTrees=num_trees,
                                  maxDepth=max_depth, seed=seed, **kw)


def boosted_fit(rows: DataFrame, cols: list[str], params: dict[int, boosting.Params], keys: list[str] = ["symbol", "date"]):
    """ML-02: boosted trees with softmax loss, one model per value of ``fit``. rows: fit, ``keys``, label, watching
    and ``cols``. Returns (bin edges, models); every row learns or watches."""
    edges = boosting.bin_edges(rows.where("not watching"), cols)
    x = cut_lineage(boosting.binned(rows, cols, edges, ["fit", *keys, "label", "watching"]))
    return edges, boosting.fit_each(x, len(cols), params, keys)


def boosted_predict(df: DataFrame, cols: list[str], edges, model: boosting.Model, keep: list[str]) -> DataFrame:
    """``keep`` and probs."""
    return boosting.score(boosting.binned(df, cols, edges, keep), model).drop("bins")


def sequence_learner(n_inputs: int, max_iter: int = 50, seed: int = DEFAULT.random_state):
    """ML-03: multilayer perceptron over a flattened 20-step sequence window."""
    return MultilayerPerceptronClassifier(labelCol="label", featuresCol="seq_features",
                                          layers=[n_inputs, 128, 64, N_CLASSES], maxIter=max_iter, seed=seed)


def sequence_vector(df: DataFrame, n_cols: int, out: str = "seq_features") -> DataFrame:
    """SEQ-01 output (array of feature arrays) -> one dense vector per row; zeros where there is no window."""
    none = F.array_repeat(F.lit(0.0), n_cols * DEFAULT.sequence_length)
    return df.withColumn(out, array_to_vector(F.coalesce(F.flatten("sequence"), none)))


def fit_predict(learner: str, train: DataFrame, test: DataFrame, cols: list[str], **kw) -> DataFrame:
    """Fit one base learner on ``train`` and return (symbol, date, probs) on ``test``."""
    if learner == "rf":
        m = tree_learner(**kw).fit(assemble(train, cols))
        out = m.transform(assemble(test, cols)).select("symbol", "date", probs_array().alias("probs"))
    elif learner == "gbt":
        rows = train.select(F.lit(0).alias("fit"), "symbol", "date", "label", F.lit(False).alias("watching"), *cols)
        edges, models = boosted_fit(rows, cols, {0: boosting.Params(**kw)})
        out = boosted_predict(test, cols, edges, models[0], ["symbol", "date"])
    elif learner == "mlp":
        seen = F.col("sequence").isNotNull()
        m = sequence_learner(len(cols) * DEFAULT.sequence_length, **kw).fit(sequence_vector(train.where(seen), len(cols)))
        # rows without a full window fall back to uniform (ML-12)
        probs = F.when(seen, probs_array()).otherwise(F.array(*[F.lit(1.0 / N_CLASSES)] * N_CLASSES))
        out = m.transform(sequence_vector(test, len(cols))).select("symbol", "date", probs.alias("probs"))
    else:
        raise ValueError(learner)
    return out


def with_prediction(scored: DataFrame, probs: str = "probs") -> DataFrame:
    """TOP-08 over a probability array: argmax, ties to the lowest class."""
    p = F.col(probs)
    return scored.withColumn("y_pred", (F.array_position(p, F.array_max(p)) - 1).cast("int"))


# ---- ML-05 hyper-parameter search --------------------------------------------------------------

# Ranges of the tree search; a third entry marks ranges that are drawn by their logarithm.
SEARCH_SPACE = {"rounds": (200, 1000), "leaves": (20, 150), "depth": (4, 12), "step": (0.01, 0.3, "log"),
                "feature_fraction": (0.5, 1.0), "row_fraction": (0.5, 1.0), "draw_every": (1, 7), "min_rows": (5, 50),
                "alpha": (1e-8, 1.0, "log"), "lam": (1e-8, 1.0, "log")}
SEARCH_ROWS = 1000        # a trial learns from at most so many labelled rows, and is watched by as many


def draw_params(trials: int, seed: int = DEFAULT.random_state, **fixed) -> list[boosting.Params]:
    """Seeded random draws from the search space; ``fixed`` values are not drawn."""
    rng, out = random.Random(seed), []
    for _ in range(trials):
        drawn = {}
        for name, (low, high, *log) in SEARCH_SPACE.items():
            if isinstance(low, int):
                drawn[name] = rng.randint(low, high)
            else:
                drawn[name] = math.exp(rng.uniform(math.log(low), math.log(high))) if log else rng.uniform(low, high)
        out.append(boosting.Params(**{"min_weight": 1e-3, "seed": seed, **drawn, **fixed}))
    return out


TRIAL = ("trial int, rounds int, leaves int, depth int, step double, feature_fraction double, row_fraction double, draw_every int, "
         "min_rows int, alpha double, lam double, rounds_run int, best_round int, macro_f1 double, is_best boolean")


def random_search(fit: DataFrame, val: DataFrame, cols: list[str], trials: int = DEFAULT.search_trials,
                  seed: int = DEFAULT.random_state, max_rows: int = SEARCH_ROWS, **fixed) -> DataFrame:
    """ML-05: every draw is fitted on ``max_rows`` rows of the fit slice, with patience on as many of the validation
    slice, and scored by macro F1 on the whole validation slice (SPL-02). The rows are binned once; all trials
    are one job of a group each, and all are scored in one pass. Returns one row per trial; ``is_best`` marks the
    highest score (ties: the first)."""
    spark, draws = fit.sparkSession, draw_params(trials, seed, **fixed)
    edges = boosting.bin_edges(fit, cols)
    rows = fit.select("symbol", "date", "label", F.lit(False).alias("watching"), *cols) \
        .unionByName(val.select("symbol", "date", "label", F.lit(True).alias("watching"), *cols))
    rows = cut_lineage(boosting.binned(rows, cols, edges, ["symbol", "date", "label", "watching"]))
    sample = boosting.bounded(rows, ["watching"], ["symbol", "date"], max_rows)
    each = F.explode(F.sequence(F.lit(0), F.lit(trials - 1))).alias("fit")
    models = boosting.fit_groups(sample.select("*", each), len(cols), dict(enumerate(draws)))
    preds = boosting.predict_each(rows.where("watching"), models, ["label"])
    f1 = classification_metrics(preds.select(F.col("label").alias("y_true"), F.col("predicted").alias("y_pred"), "fit"), ["fit"])
    scores = {r["fit"]: float(r["macro_f1"]) for r in f1.select("fit", "macro_f1").collect()}
    best = max(range(trials), key=lambda t: (scores.get(t, 0.0), -t))
    names = list(SEARCH_SPACE)
    out = [(t, *(asdict(p)[n] for n in names), models[t].rounds_run, len(models[t].roots), scores.get(t, 0.0), t == best)
           for t, p in enumerate(draws)]
    return spark.createDataFrame(out, TRIAL)


def refit_best(trials: DataFrame, train: DataFrame, cols: list[str], seed: int = DEFAULT.random_state):
    """The best trial's draw, all its rounds, fitted on the training rows (one row of the trial table is read).
    Returns (bin edges, model)."""
    row = trials.where("is_best").first().asDict()
    params = boosting.Params(**{f.name: row[f.name] for f in fields(boosting.Params) if f.name in row}, min_weight=1e-3, seed=seed)
    rows = train.select(F.lit(0).alias("fit"), "symbol", "date", "label", F.lit(False).alias("watching"), *cols)
    edges, models = boosted_fit(rows, cols, {0: params})
    return edges, models[0]


# ---- ML-06 leaderboard ----------------------------------------------------------------------------

UNTRAINED_CLASS = 2


def leaderboard(train: DataFrame, test: DataFrame, cols: list[str], seed: int = DEFAULT.random_state,
                boosting_rounds: int = 100, mlp_iterations: int = 100) -> DataFrame:
    """Fit a panel of pyspark.ml classifiers and rank them by macro F1 (per symbol and
    pooled); naive Bayes and the perceptron get min-max scaled inputs (test clipped to [0, 1]).
    ``untrained`` is the answer without a fit: class 2, hold, for every row."""
    tr, te = assemble(train, cols), assemble(test, cols)
    scaler = MinMaxScaler(inputCol="features", outputCol="_mm").fit(tr)

    def clipped(df: DataFrame) -> DataFrame:
        arr = F.transform(vector_to_array(F.col("_mm")), lambda x: F.greatest(F.least(x, F.lit(1.0)), F.lit(0.0)))
        return scaler.transform(df).select("symbol", "label", "features", array_to_vector(arr).alias("unit_features"))

    tr, te = cut_lineage(clipped(tr)), cut_lineage(clipped(te))
    panel = {
        "logistic_regression": LogisticRegression(labelCol="label", maxIter=50, regParam=0.01),
        "decision_tree": DecisionTreeClassifier(labelCol="label", maxDepth=6, seed=seed),
        "random_forest": tree_learner(num_trees=100, max_depth=6, seed=seed),
        "mlp": MultilayerPerceptronClassifier(labelCol="label", featuresCol="unit_features", seed=seed,
                                              layers=[len(cols), 64, 32, N_CLASSES], maxIter=mlp_iterations),
        "naive_bayes": NaiveBayes(labelCol="label", featuresCol="unit_features"),
    }
    answer = lambda df, name, y: df.select("symbol", F.lit(name).alias("model"), F.col("label").alias("y_true"),
                                           y.cast("int").alias("y_pred"))
    preds = answer(te, "untrained", F.lit(UNTRAINED_CLASS))
    boosted = fit_predict("gbt", train, test, cols, rounds=boosting_rounds, seed=seed).join(test.select("symbol", "date", "label"), ["symbol", "date"])
    preds = preds.unionByName(answer(with_prediction(boosted), "boosted_trees", F.col("y_pred")))
    for name, est in panel.items():
        preds = preds.unionByName(answer(est.fit(tr).transform(te), name, F.col("prediction")))
    metrics = classification_metrics(preds).select("symbol", "model", "accuracy", "macro_f1")
    ranked = Window.partitionBy("symbol").orderBy(F.col("macro_f1").desc(), F.col("model"))
    return metrics.withColumn("rank", F.row_number().over(ranked))


# ---- ML-09 importances ----------------------------------------------------------------------------

def model_importances(train: DataFrame, cols: list[str], n: int = 5, seed: int = DEFAULT.random_state) -> DataFrame:
    """Forest feature importances as a table, ranked (TOP-04 from a model)."""
    m = tree_learner(seed=seed).fit(assemble(train, cols))
    imp = m.featureImportances.toArray().tolist()
    spark = train.sparkSession
    t = spark.createDataFrame(list(zip(cols, [float(v) for v in imp])), "feature string, importance double")
    return t.withColumn("rank", F.row_number().over(Window.orderBy(F.col("importance").desc(), F.col("feature")))) \
        .where(F.col("rank") <= n)


def permutation_importance(rows: DataFrame, cols: list[str], predict: Callable[[DataFrame], DataFrame], by: str = "symbol",
                           order: str = "date", seed: int = DEFAULT.random_state) -> DataFrame:
    """ML-09: how much macro F1 each feature carries, per ``by``: the score of the rows as they are, less the score
    when the feature's values are dealt anew among the rows of the same ``by``.

    One pass for all features: every row is there once as it is (feature null) and once per feature; row i in
    ``order`` gets the value of the row that is number i by a seeded md5 of its ``order``. ``predict`` adds y_pred
    to rows of ``cols``; it is called once. rows: ``by``, ``order``, label and ``cols``."""
    values = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in cols])).alias("_e")
    place = F.row_number().over(Window.partitionBy(by).orderBy(order))
    numbered = cut_lineage(rows.select(by, order, "label", *cols).withColumn("_i", place))
    rank = F.md5(F.concat_ws(":", F.lit(str(seed)), "feature", F.col(order).cast("string")))
    dealt = numbered.select(by, order, values).select(by, order, "_e.*") \
        .withColumn("_i", F.row_number().over(Window.partitionBy(by, "feature").orderBy(rank, order))).drop(order)
    each = numbered.withColumn("feature", F.explode(F.array(*map(F.lit, cols)))).join(dealt, [by, "feature", "_i"])
    changed = [F.when(F.col("feature") == c, F.col("value")).otherwise(F.col(c).cast("double")).alias(c) for c in cols]
    plain = numbered.select(by, order, "label", F.lit(None).cast("string").alias("feature"), *[F.col(c).cast("double").alias(c) for c in cols])
    scored = predict(plain.unionByName(each.select(by, order, "label", "feature", *changed)))
    f1 = classification_metrics(scored.withColumnRenamed("label", "y_true"), [by, "feature"]).select(by, "feature", "macro_f1")
    base = f1.where("feature is null").select(by, F.col("macro_f1").alias("base_f1"))
    return f1.where("feature is not null").join(base, by).select(
        by, "feature", "base_f1", F.col("macro_f1").alias("permuted_f1"), (F.col("base_f1") - F.col("macro_f1")).alias("importance"))


def contribution_importance(explained: DataFrame, cols: list[str], n: int = 10) -> DataFrame:
    """ML-09: the mean absolute contribution of every feature over ``boosting.explain``'s rows, the ``n`` largest."""
    each = explained.select(F.posexplode("contributions").alias("at", "value")).groupBy("at").agg(F.avg(F.abs("value")).alias("importance"))
    named = each.select(F.element_at(F.array(*map(F.lit, cols)), F.col("at") + 1).alias("feature"), "importance")
    rank = F.row_number().over(Window.orderBy(F.col("importance").desc(), F.col("feature")))
    return named.withColumn("rank", rank).where(F.col("rank") <= n)


# ---- ML-11 experiment log ---------------------------------------------------------------------------

RUN_LOG = ["run", "symbol", "model", "kind", "key", "value"]


def experiment_log(run_id: str, metrics: DataFrame, params: dict[str, float | int | str], fold_f1: DataFrame | None = None) -> DataFrame:
    """Long (run, symbol, model, kind, key, value) rows: one per metric, per parameter, and per fold's macro F1
    (``fold_f1``: symbol, fold, model, macro_f1)."""
    spark = metrics.sparkSession
    cols = [c for c in metrics.columns if c not in ("symbol", "model")]
    m = metrics.select("symbol", "model", F.explode(F.array(*[
        F.struct(F.lit(c).alias("key"), F.col(c).cast("string").alias("value")) for c in cols])).alias("_e"))
    m = m.select(F.lit(run_id).alias("run"), "symbol", "model", F.lit("metric").alias("kind"), "_e.key", "_e.value")
    if fold_f1 is not None:
        m = m.unionByName(fold_f1.select(F.lit(run_id).alias("run"), "symbol", "model", F.lit("fold_f1").alias("kind"),
                                         F.col("fold").cast("string").alias("key"), F.col("macro_f1").cast("string").alias("value")))
    p = spark.createDataFrame([(run_id, "all", "all", "param", k, str(v)) for k, v in params.items()], ", ".join(f"{c} string" for c in RUN_LOG))
    return m.unionByName(p)


def append_run(log: DataFrame, path: str) -> None:
    """Adds a run's rows to the log at ``path``, a folder per run: a run that is logged again replaces its own rows
    and leaves the others."""
    log.select(*RUN_LOG).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run").parquet(path)
