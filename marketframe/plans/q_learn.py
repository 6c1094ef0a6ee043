"""Queries: learners (ML-01..03, 05..07, 09..11) and balancing (BAL-01).
Rows-only checks where a fitted model decides. All learners run at the operators' full sizes: boosting up to 1,000
rounds of depth 6 with a patience of 50, the search 50 trials, the sequence learner 50 iterations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT
from ..operators import serve as sv
from ..operators.features import engineer_features
from ..operators.indicators import FEATURE_COLUMNS
from ..operators import boosting
from ..operators.learners import (RUN_LOG, append_run, assemble, boosted_fit, boosted_predict, contribution_importance, experiment_log, fit_predict,
                                  leaderboard, model_importances, permutation_importance, probs_array, random_search,
                                  refit_best, tree_learner, with_prediction)
from ..operators.metrics import classification_metrics
from ..operators.sentiment import SCORER_LABELS, fit_scorer, score_with_model
from ..operators.splits import chrono_split, inner_split, sequences, spread, time_series_folds, zscore, zscore_stats
from ..operators.stack import balanced_runs, oof_f1, stack_fit_predict, stack_runs
from ..session import cut_lineage, packed, shared_table
from ..sources import fixtures as fx
from ..sources import io
from . import oracle as O
from .catalog import register

SENT = ["sentiment_score", "sentiment_confidence", "news_count_7d", "sentiment_trend_3d"]
MODEL_COLS = FEATURE_COLUMNS + SENT
PARAMS = {"rf": {"num_trees": 100, "max_depth": 6}, "gbt": {}, "mlp": {"max_iter": 50}}


def training_table(spark, sf) -> DataFrame:
    """Processed features + forecast-slot probabilities + split, checkpointed once per application (it feeds several fits and queries)."""
    return shared_table(spark, f"training_flag:{sf}", lambda: _training_table(spark, sf))


def _training_table(spark, sf) -> DataFrame:
    from .q_models import _processed
    bars = fx.bars_flag(spark, sf)
    p = _processed(spark, sf)
    fc = sv.forecast_distribution(bars).select("symbol", "date", F.col("probs").alias("forecast_probs"))
    return chrono_split(p.join(fc, ["symbol", "date"])).drop("_i")


def _split(spark, sf):
    t = training_table(spark, sf)
    return t.where(F.col("split") == "train"), t.where(F.col("split") == "test")


def _metrics_of(scored: DataFrame, test: DataFrame, model: str) -> DataFrame:
    j = with_prediction(scored).join(test.select("symbol", "date", F.col("label").alias("y_true")), ["symbol", "date"])
    return classification_metrics(j.withColumn("model", F.lit(model)))


@register("ml_01_tree_learner")
def ml_01(spark, sf):
    train, test = _split(spark, sf)
    return _metrics_of(fit_predict("rf", train, test, MODEL_COLS, **PARAMS["rf"]), test, "random_forest")


def _boosted(spark, sf):
    """(bin edges, model) of the training rows, watched by the inner validation slice; one per application."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _BOOSTED:
        x = inner_split(training_table(spark, sf).drop("split")).where(F.col("split") == "train")
        rows = x.select(F.lit(0).alias("fit"), "symbol", "date", "label", (F.col("inner") == "val").alias("watching"), *MODEL_COLS)
        edges, models = boosted_fit(rows, MODEL_COLS, {0: boosting.Params(**PARAMS["gbt"])})
        _BOOSTED[key] = edges, models[0]
    return _BOOSTED[key]


_BOOSTED: dict[tuple[str, str], object] = {}


@register("ml_02_boosted_learner")
def ml_02(spark, sf):
    test = _split(spark, sf)[1]
    edges, model = _boosted(spark, sf)
    scored = boosted_predict(test, MODEL_COLS, edges, model, ["symbol", "date"])
    return _metrics_of(scored, test, "boosted_trees").withColumns({
        "rounds_run": F.lit(model.rounds_run), "best_round": F.lit(len(model.roots)), "best_loss": F.lit(model.best_loss)})


@register("ml_03_sequence_learner")
def ml_03(spark, sf):
    t = training_table(spark, sf)
    stats = zscore_stats(t.where(F.col("split") == "train"), MODEL_COLS, ["symbol"])
    x = packed(cut_lineage(spread(sequences(zscore(t, stats, MODEL_COLS, ["symbol"]), MODEL_COLS))))
    train, test = x.where(F.col("split") == "train"), x.where(F.col("split") == "test")
    return _metrics_of(fit_predict("mlp", train, test, MODEL_COLS, **PARAMS["mlp"]), test, "sequence_mlp")


def _trials(spark, sf) -> DataFrame:
    def build():
        x = inner_split(training_table(spark, sf).drop("split")).where(F.col("split") == "train")
        return random_search(x.where(F.col("inner") == "fit"), x.where(F.col("inner") == "val"), MODEL_COLS)
    return shared_table(spark, f"trials_flag:{sf}", build)


@register("ml_05_random_search")
def ml_05(spark, sf):
    return _trials(spark, sf)


@register("ml_05_refit_best")
def ml_05_refit(spark, sf):
    train, test = _split(spark, sf)
    edges, model = refit_best(_trials(spark, sf), train, MODEL_COLS)
    return _metrics_of(boosted_predict(test, MODEL_COLS, edges, model, ["symbol", "date"]), test, "searched_trees") \
        .withColumn("rounds", F.lit(len(model.roots)))


@register("ml_06_leaderboard")
def ml_06(spark, sf):
    train, test = _split(spark, sf)
    return leaderboard(train, test, MODEL_COLS)


_STACKS: dict[tuple[str, str], object] = {}


def _stack(spark, sf):
    """One stack per application: its scores and its out-of-fold pool serve two queries."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _STACKS:
        train, test = _split(spark, sf)
        _STACKS[key] = stack_fit_predict(cut_lineage(time_series_folds(train)), test, MODEL_COLS, params=PARAMS)
    return _STACKS[key]


def _stack_metrics(spark, sf) -> DataFrame:
    test = _split(spark, sf)[1]
    j = with_prediction(_stack(spark, sf).scored) \
        .join(test.select("symbol", "date", F.col("label").alias("y_true")), ["symbol", "date"])
    return classification_metrics(j)


@register("ml_07_stacking")
def ml_07(spark, sf):
    return _stack_metrics(spark, sf)


@register("ml_07_fold_f1")
def ml_07_fold_f1(spark, sf):
    return oof_f1(_stack(spark, sf).oof)


@register("ml_09_importances")
def ml_09(spark, sf):
    train, _ = _split(spark, sf)
    return model_importances(train, MODEL_COLS, n=10)


# a fixed rule, so that SQL can tell what each of its features carries
RULE = {"rsi_14": 50.0001, "price_sma20_ratio": 1.0001, "macd_hist": 0.0001, "log_return_1d": 0.0001}


def _by_rule(rows: DataFrame) -> DataFrame:
    votes = sum(F.when(F.col(c) > at, 1).otherwise(0) for c, at in RULE.items())
    return rows.withColumn("y_pred", F.lit(4) - votes)


_LISTED = ", ".join(f"('{c}')" for c in RULE)
_VALUE = "CASE feature " + " ".join(f"WHEN '{c}' THEN {c}" for c in RULE) + " END"
_VOTES = " - ".join(["4", *(f"CASE WHEN (CASE WHEN feature = '{c}' THEN value ELSE {c} END) > {at} THEN 1 ELSE 0 END" for c, at in RULE.items())])


@register("ml_09_permutation", O.with_bars(O.BARS_FLAG, O.PROCESSED, f"""
base AS (SELECT symbol, date, label, {", ".join(f"{c}::DOUBLE AS {c}" for c in RULE)}, row_number() OVER (PARTITION BY symbol ORDER BY date) AS i FROM processed),
dealt AS (SELECT symbol, feature, {_VALUE} AS value,
    row_number() OVER (PARTITION BY symbol, feature ORDER BY md5(concat_ws(':', '{DEFAULT.random_state}', feature, date::VARCHAR)), date) AS i
    FROM base, (VALUES {_LISTED}) f(feature)),
rows_of AS (SELECT base.*, NULL::VARCHAR AS feature, NULL::DOUBLE AS value FROM base
    UNION ALL SELECT base.*, feature, value FROM base JOIN dealt USING (symbol, i)),
pred AS (SELECT symbol, feature, label AS y, {_VOTES} AS p FROM rows_of),
both_of AS (SELECT symbol, feature, y AS cls, 1 AS s, 0 AS q, CASE WHEN y = p THEN 1 ELSE 0 END AS t FROM pred
    UNION ALL SELECT symbol, feature, p, 0, 1, 0 FROM pred),
per AS (SELECT symbol, feature, cls, 2.0::DOUBLE * sum(t) / (sum(s) + sum(q)) AS f1 FROM both_of GROUP BY ALL),
macro AS (SELECT symbol, feature, avg(f1) AS macro_f1 FROM per GROUP BY ALL)""", body="""
SELECT m.symbol, m.feature, round(b.macro_f1, 6) AS base_f1, round(m.macro_f1, 6) AS permuted_f1, round(b.macro_f1 - m.macro_f1, 6) AS importance
FROM macro m JOIN macro b ON m.symbol = b.symbol AND b.feature IS NULL WHERE m.feature IS NOT NULL"""))
def ml_09_permutation(spark, sf):
    from .q_models import _processed
    found = permutation_importance(_processed(spark, sf).select("symbol", "date", "label", *RULE), list(RULE), _by_rule)
    return found.select("symbol", "feature", *[F.round(c, 6).alias(c) for c in ("base_f1", "permuted_f1", "importance")])


@register("ml_09_contributions")
def ml_09_contributions(spark, sf):
    """Mean absolute contribution of the features to the boosted learner's predictions on the test rows."""
    edges, model = _boosted(spark, sf)
    test = boosting.binned(_split(spark, sf)[1], MODEL_COLS, edges, ["symbol", "date"])
    return contribution_importance(boosting.explain(test, model, MODEL_COLS, ["symbol", "date"]), MODEL_COLS)


@register("ml_10_batch_scoring")
def ml_10(spark, sf):
    train, test = _split(spark, sf)
    m = tree_learner(**PARAMS["rf"]).fit(assemble(train, MODEL_COLS))
    latest = sv.latest_rows(test.select("symbol", "date", *MODEL_COLS))
    scored = m.transform(assemble(latest, MODEL_COLS)).select("symbol", "date", probs_array().alias("probs"))
    return sv.signals(scored).select("symbol", "date", "signal_class", "signal", "confidence", "probabilities")


@register("ml_11_experiment_log")
def ml_11(spark, sf):
    """The stack's run: metrics per symbol and model, macro F1 per fold and slot, parameters."""
    stack = _stack(spark, sf)
    params = {f"{slot}.{k}": v for slot, own in PARAMS.items() for k, v in own.items()} | {"test_size": DEFAULT.test_size, "cv_folds": DEFAULT.cv_folds}
    params |= {f"gbt.run{run}.{k}": v for run, (ran, kept) in stack.rounds.items() for k, v in (("rounds_run", ran), ("best_round", kept))}
    log = experiment_log("run-0001", _stack_metrics(spark, sf), params, oof_f1(stack.oof))
    path = io.scratch_path(spark, "experiments")
    for _ in range(2):  # a rerun replaces its rows
        append_run(log, path)
    return spark.read.parquet(path).select(*RUN_LOG)


@register("top_04_prediction_features")
def top_04_prediction(spark, sf):
    """The five features that say most in the boosted learner's prediction for each symbol's latest row. What all
    features add, with the bias, is the margin of the predicted class."""
    edges, model = _boosted(spark, sf)
    latest = boosting.binned(sv.latest_rows(_split(spark, sf)[1].select("symbol", "date", *MODEL_COLS)), MODEL_COLS, edges, ["symbol", "date"])
    return sv.prediction_features(boosting.explain(latest, model, MODEL_COLS, ["symbol", "date"]), MODEL_COLS)


# ---- trained headline scorer (SEN-01) ------------------------------------------------------------

def _held_out():
    return F.crc32(F.col("position").cast("string").cast("binary")) % 5 == 0


def _trained_scores(spark, sf) -> DataFrame:
    """Every headline, scored by a classifier that learned the labelled headlines of four fifths of the ids."""
    headlines = fx.headlines(spark, sf).withColumn("held_out", _held_out())
    known = fx.labelled_headlines(spark, sf)
    return score_with_model(headlines, fit_scorer(known.where(~_held_out())))


@register("sen_01_trained_scorer")
def sen_01_trained(spark, sf):
    return _trained_scores(spark, sf).select("symbol", "date", "position", "held_out", "label", "score", F.round("confidence", 6).alias("confidence"))


@register("sen_01_trained_report")
def sen_01_report(spark, sf):
    """Accuracy and F1 of the trained scorer on the labelled headlines, held out or not."""
    truth = fx.labelled_headlines(spark, sf).select("position", F.col("label").alias("truth"))
    code = lambda c: (F.array_position(F.array(*map(F.lit, SCORER_LABELS)), F.col(c)) - 1).cast("int")
    j = _trained_scores(spark, sf).join(truth, "position").select("held_out", code("truth").alias("y_true"), code("label").alias("y_pred"))
    counts = j.groupBy("held_out").agg(F.count("*").alias("n"))
    return classification_metrics(j, ["held_out"]).join(counts, "held_out").select("held_out", "n", "accuracy", "macro_f1", "weighted_f1")


# ---- balancing (BAL-01) ------------------------------------------------------------------------

def _scaled_train(spark, sf) -> DataFrame:
    """Train-split rows z-scored with per-symbol train statistics (population std, 0 -> 1)."""
    train, _ = _split(spark, sf)
    train = train.select("symbol", "date", "label", *MODEL_COLS)
    return zscore(train, zscore_stats(train, MODEL_COLS, ["symbol"]), MODEL_COLS, ["symbol"])


@register("bal_01_smote_class_counts", O.with_bars(O.BARS_FLAG, O.PROCESSED, """
pos AS (
  SELECT symbol, label, row_number() OVER (PARTITION BY symbol ORDER BY date) - 1 AS pi,
         count(*) OVER (PARTITION BY symbol) AS pn FROM processed),
counts AS (SELECT symbol, label, count(*) AS n_c FROM pos WHERE pi < floor(pn * CAST(0.8 AS DOUBLE)) GROUP BY ALL),
plan AS (
  SELECT *, max(n_c) OVER (PARTITION BY symbol) AS n_max, min(n_c) OVER (PARTITION BY symbol) AS n_min,
         max(label) OVER (PARTITION BY symbol) AS max_label, count(*) OVER (PARTITION BY symbol) AS n_classes FROM counts)""",
    body="""
SELECT symbol, label, CASE WHEN least(5, n_min - 1) >= 1 AND n_classes = max_label + 1 THEN n_max ELSE n_c END AS n_after
FROM plan"""))
def bal_01_counts(spark, sf):
    from ..operators.balance import smote
    out = smote(_scaled_train(spark, sf), MODEL_COLS, ["symbol"])
    return out.groupBy("symbol", "label").agg(F.count("*").alias("n_after"))


@register("bal_01_smote_rows")
def bal_01_rows(spark, sf):
    from ..operators.balance import smote
    out = smote(_scaled_train(spark, sf), MODEL_COLS, ["symbol"])
    return out.where("synthetic").select("symbol", "label", *MODEL_COLS[:5])


_RUN_COUNTS = ", ".join(f"({j})" for j in range(1, 6))


@register("ml_07_run_class_counts", O.with_bars(O.BARS_FLAG, O.PROCESSED, f"""
pos AS (
  SELECT symbol, date, label, row_number() OVER (PARTITION BY symbol ORDER BY date) - 1 AS pi,
         count(*) OVER (PARTITION BY symbol) AS pn FROM processed),
trn AS (
  SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) - 1 AS ti,
         count(*) OVER (PARTITION BY symbol) AS tn FROM pos WHERE pi < floor(pn * CAST(0.8 AS DOUBLE))),
fld AS (
  SELECT *, CASE WHEN ti < tn - 5 * (tn // 6) THEN -1 ELSE (ti - (tn - 5 * (tn // 6))) // (tn // 6) END AS fold FROM trn),
counts AS (
  SELECT symbol, run, label, count(*) AS n_c FROM fld, (VALUES {_RUN_COUNTS}) AS r(run) WHERE fold < run GROUP BY ALL),
plan AS (
  SELECT *, max(n_c) OVER (PARTITION BY symbol, run) AS n_max, min(n_c) OVER (PARTITION BY symbol, run) AS n_min,
         max(label) OVER (PARTITION BY symbol, run) AS max_label, count(*) OVER (PARTITION BY symbol, run) AS n_classes
  FROM counts)""", body="""
SELECT symbol, run, label, n_c AS n_real,
       CASE WHEN least(5, n_min - 1) >= 1 AND n_classes = max_label + 1 THEN n_max - n_c ELSE 0 END AS n_synthetic
FROM plan"""))
def ml_07_run_counts(spark, sf):
    """What every run of the stack learns from: real and synthetic rows per class."""
    train, test = _split(spark, sf)
    rows = balanced_runs(stack_runs(time_series_folds(train), test, MODEL_COLS), MODEL_COLS)
    made = F.when(F.col("synthetic"), 1).otherwise(0)
    return rows.groupBy("symbol", "run", "label").agg(F.sum(1 - made).alias("n_real"), F.sum(made).alias("n_synthetic"))
