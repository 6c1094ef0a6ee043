"""Queries: splits (SPL-*), scaling (SCL-01), sequences (SEQ-01), the OOF meta-feature
pool (ML-08), evaluation (EVAL-*) and drift (DRF-*)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import drift as dr
from ..operators import serve as sv
from ..operators.features import engineer_features
from ..operators.indicators import FEATURE_COLUMNS
from ..operators.metrics import class_counts, classification_metrics, comparison_table, per_class_report
from ..operators.splits import (apply_fold_scaler, chrono_split, fold_scaler, inner_split, sequences,
                                time_series_folds)
from ..session import cut_lineage, shared_table
from ..sources import fixtures as fx
from . import oracle as O
from .catalog import register, rounded, sql_round


def _processed(spark, sf) -> DataFrame:
    """The processed table, checkpointed once: split, fold, drift and pool queries read
    it two or three times (value counts, totals, quantile edges)."""
    return shared_table(spark, f"processed_flag:{sf}", lambda: engineer_features(fx.bars_flag(spark, sf)))


_SPLIT_SQL = O.PROCESSED + """,
pos AS (
  SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) - 1 AS pi,
         count(*) OVER (PARTITION BY symbol) AS pn FROM processed),
spl AS (SELECT *, CASE WHEN pi < floor(pn * CAST(0.8 AS DOUBLE)) THEN 'train' ELSE 'test' END AS split FROM pos),
trn AS (
  SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) - 1 AS ti,
         count(*) OVER (PARTITION BY symbol) AS tn FROM spl WHERE split = 'train'),
folded AS (
  SELECT *, CAST(CASE WHEN ti < tn - 5 * (tn // 6) THEN -1 ELSE (ti - (tn - 5 * (tn // 6))) // (tn // 6) END AS INTEGER)
         AS fold FROM trn)"""


@register("spl_01_chrono_split", O.with_bars(O.BARS_FLAG, _SPLIT_SQL, body="SELECT symbol, date, split FROM spl"))
def spl_01(spark, sf):
    return chrono_split(_processed(spark, sf)).select("symbol", "date", "split")


@register("spl_02_inner_split", O.with_bars(O.BARS_FLAG, _SPLIT_SQL, body="""
SELECT symbol, date, CASE WHEN ti < floor(tn * CAST(0.8 AS DOUBLE)) THEN 'fit' ELSE 'val' END AS inner FROM trn"""))
def spl_02(spark, sf):
    x = inner_split(_processed(spark, sf))
    return x.where(F.col("split") == "train").select("symbol", "date", "inner")


def _folded(spark, sf) -> DataFrame:
    x = chrono_split(_processed(spark, sf))
    return time_series_folds(x.where(F.col("split") == "train").drop("_i"))


@register("spl_03_time_series_folds", O.with_bars(O.BARS_FLAG, _SPLIT_SQL, body="SELECT symbol, date, fold FROM folded"))
def spl_03(spark, sf):
    return _folded(spark, sf).select("symbol", "date", "fold")


SCALE_COLS = ["rsi_14", "macd", "atr_14"]


@register("scl_01_fold_zscore", O.with_bars(O.BARS_FLAG, _SPLIT_SQL, """
fstats AS (
  SELECT r.symbol, j.range AS fold, """ + ", ".join(
    f"avg(r.{c}) AS {c}_m, CASE WHEN stddev_pop(r.{c}) = 0 THEN 1.0 ELSE stddev_pop(r.{c}) END AS {c}_s" for c in SCALE_COLS) + """
  FROM folded r JOIN range(0, 5) j ON j.range > r.fold GROUP BY r.symbol, j.range)""", body="""
SELECT f.symbol, f.date, f.fold, """ + ", ".join(f"round((f.{c} - s.{c}_m) / s.{c}_s, 6) + 0.0 AS {c}" for c in SCALE_COLS) + """
FROM folded f JOIN fstats s ON s.symbol = f.symbol AND s.fold = f.fold"""))
def scl_01(spark, sf):
    folded = _folded(spark, sf).select("symbol", "date", "fold", *SCALE_COLS)
    stats = fold_scaler(folded, SCALE_COLS)
    return rounded(apply_fold_scaler(folded, stats, SCALE_COLS).select("symbol", "date", "fold", *SCALE_COLS))


SEQ_COLS = ["rsi_14", "macd", "label"]


@register("seq_01_sequences", O.with_bars(O.BARS_FLAG, O.PROCESSED, body="""
SELECT symbol, date, CAST(len(sq) AS INTEGER) AS n_steps, round(sq[1], 6) + 0.0 AS first_rsi,
       round(sq[len(sq)], 6) + 0.0 AS last_rsi, label FROM (
  SELECT symbol, date, label, CASE WHEN row_number() OVER (PARTITION BY symbol ORDER BY date) - 1 >= 20 THEN
    list(rsi_14) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) END AS sq
  FROM processed) WHERE sq IS NOT NULL"""))
def seq_01(spark, sf):
    s = sequences(_processed(spark, sf), SEQ_COLS).where(F.col("sequence").isNotNull())
    return rounded(s.select("symbol", "date", F.size("sequence").alias("n_steps"),
                            F.element_at("sequence", 1)[0].alias("first_rsi"),
                            F.element_at("sequence", -1)[0].alias("last_rsi"), "label"))


# ---- OOF meta-feature pool (ML-08) ------------------------------------------------------

def oof_pool(spark, sf) -> DataFrame:
    """Rows of folds 1..k-1 with a 20-wide meta vector from four slots: forecast
    distribution, persistence one-hot, uniform fallback, and the fold's training
    class prior (computed from rows of earlier folds only)."""
    folded = _folded(spark, sf).select("symbol", "date", "fold", "label")
    fc = sv.forecast_distribution(fx.bars_flag(spark, sf)).select("symbol", "date", "probs")
    w = Window.partitionBy("symbol").orderBy("date")
    prev = F.lag("label").over(w)
    x = folded.withColumn("prev", prev)
    from ..operators.splits import fold_training_rows
    tr = fold_training_rows(folded)
    prior = tr.groupBy("symbol", "train_fold").agg(
        *[F.avg(F.when(F.col("label") == k, 1.0).otherwise(0.0)).alias(f"c{k}") for k in range(5)])
    prior = prior.select("symbol", F.col("train_fold").alias("fold"), F.array(*[F.col(f"c{k}") for k in range(5)]).alias("prior"))
    onehot = F.when(F.col("prev").isNull(), sv.uniform_probs()).otherwise(
        F.array(*[F.when(F.col("prev") == k, 1.0).otherwise(0.0) for k in range(5)]))
    j = x.where(F.col("fold") >= 1).join(fc, ["symbol", "date"]).join(prior, ["symbol", "fold"])
    meta = F.concat("probs", onehot, sv.uniform_probs(), "prior")
    return j.select("symbol", "date", "fold", "label", meta.alias("meta"))


@register("ml_08_oof_pool", O.with_bars(O.BARS_FLAG, _SPLIT_SQL, O.FORECAST, """
prior AS (
  SELECT r.symbol, j.range AS fold, """ + ", ".join(f"avg(CASE WHEN r.label = {k} THEN 1.0 ELSE 0.0 END) AS c{k}" for k in range(5)) + """
  FROM folded r JOIN range(0, 5) j ON j.range > r.fold GROUP BY r.symbol, j.range),
fp AS (SELECT *, lag(label) OVER (PARTITION BY symbol ORDER BY date) AS prev FROM folded)""", body="""
SELECT f.symbol, f.date, f.fold, f.label, """ + ", ".join(
    [f"round(c.probs[{k + 1}], 6) + 0.0 AS m{k}" for k in range(5)]
    + [f"CASE WHEN f.prev IS NULL THEN 0.2 WHEN f.prev = {k} THEN 1.0 ELSE 0.0 END AS m{k + 5}" for k in range(5)]
    + [f"0.2 AS m{k + 10}" for k in range(5)]
    + [f"round(p.c{k}, 6) + 0.0 AS m{k + 15}" for k in range(5)]) + """
FROM fp f JOIN fc c ON c.symbol = f.symbol AND c.date = f.date JOIN prior p ON p.symbol = f.symbol AND p.fold = f.fold
WHERE f.fold >= 1"""))
def ml_08(spark, sf):
    p = oof_pool(spark, sf)
    return rounded(p.select("symbol", "date", "fold", "label", *[F.col("meta")[k].alias(f"m{k}") for k in range(20)]))


# ---- evaluation -------------------------------------------------------------------------

_PRED_SQL = O.BARS_FLAG
METRIC_COLS = ["accuracy", "macro_f1", "weighted_f1", "buy_f1", "sell_f1"]
_PERSIST_SQL = """
lab AS (
  SELECT symbol, date, CASE WHEN fwd > 0.02 THEN 4 WHEN fwd > 0.005 THEN 3 WHEN fwd < -0.02 THEN 0
                            WHEN fwd < -0.005 THEN 1 ELSE 2 END AS y_true
  FROM (SELECT symbol, date, lead(close) OVER (PARTITION BY symbol ORDER BY date) / close - 1.0 AS fwd FROM bars)
  WHERE fwd IS NOT NULL),
lab2 AS (SELECT *, lag(y_true) OVER (PARTITION BY symbol ORDER BY date) AS prev FROM lab),
preds AS (
  SELECT symbol, date, 'persistence' AS model, y_true, prev AS y_pred FROM lab2 WHERE prev IS NOT NULL
  UNION ALL
  SELECT symbol, date, 'always_hold' AS model, y_true, 2 AS y_pred FROM lab2 WHERE prev IS NOT NULL),
cc AS (
  SELECT symbol, model, cls, sum(s) AS support, sum(q) AS predicted, sum(t) AS tp FROM (
    SELECT symbol, model, y_true AS cls, 1 AS s, 0 AS q, CASE WHEN y_true = y_pred THEN 1 ELSE 0 END AS t FROM preds
    UNION ALL SELECT symbol, model, y_pred AS cls, 0, 1, 0 FROM preds) GROUP BY symbol, model, cls),
cf AS (SELECT *, coalesce(2.0 * tp / nullif(support + predicted, 0), 0.0) AS f1 FROM cc),
metrics AS (
  SELECT symbol, model, sum(tp) / sum(support) AS accuracy, avg(f1) AS macro_f1,
         sum(f1 * support) / sum(support) AS weighted_f1,
         sum(CASE WHEN cls IN (3, 4) THEN f1 ELSE 0.0 END) / 2 AS buy_f1,
         sum(CASE WHEN cls IN (0, 1) THEN f1 ELSE 0.0 END) / 2 AS sell_f1
  FROM cf GROUP BY symbol, model)"""


def _metrics(spark, sf) -> DataFrame:
    return classification_metrics(fx.predictions_persistence(fx.bars_flag(spark, sf)))


def _eval(key: str, cols: list[str]):
    @register(key, O.with_bars(O.BARS_FLAG, _PERSIST_SQL, body=f"SELECT symbol, model, {sql_round(cols)} FROM metrics"))
    def run(spark, sf):
        return rounded(_metrics(spark, sf).select("symbol", "model", *cols))
    return run


_eval("eval_01_accuracy", ["accuracy"])
_eval("eval_02_macro_f1", ["macro_f1"])
_eval("eval_03_weighted_f1", ["weighted_f1"])
_eval("eval_04_buy_sell_f1", ["buy_f1", "sell_f1"])


@register("eval_05_class_report", O.with_bars(O.BARS_FLAG, _PERSIST_SQL, body=f"""
SELECT symbol, model, CAST(cls AS INTEGER) AS cls, {sql_round(['precision', 'recall', 'f1'])}, support FROM (
  SELECT symbol, model, cls, coalesce(tp / nullif(predicted, 0), 0.0) AS precision,
         coalesce(tp / nullif(support, 0), 0.0) AS recall, f1, CAST(support AS BIGINT) AS support FROM cf)"""))
def eval_05(spark, sf):
    r = per_class_report(fx.predictions_persistence(fx.bars_flag(spark, sf)), ["symbol", "model"])
    return rounded(r)


@register("eval_06_comparison", O.with_bars(O.BARS_FLAG, _PERSIST_SQL, body="""
SELECT symbol, model, """ + ", ".join(f"round({c}, 4) + 0.0 AS {c}" for c in
                                       ["accuracy", "macro_f1", "weighted_f1", "buy_f1", "sell_f1"]) + " FROM metrics"))
def eval_06(spark, sf):
    t = comparison_table(fx.predictions_persistence(fx.bars_flag(spark, sf)))
    return t.select("symbol", "model", *[(F.col(c) + 0.0).alias(c) for c in
                                         ["accuracy", "macro_f1", "weighted_f1", "buy_f1", "sell_f1"]])


@register("eval_07_fold_macro_f1", O.with_bars(O.BARS_FLAG, _SPLIT_SQL, """
fpred AS (
  SELECT symbol, fold, 'persistence' AS model, label AS y_true, prev AS y_pred FROM (
    SELECT *, lag(label) OVER (PARTITION BY symbol ORDER BY date) AS prev FROM folded) WHERE fold >= 1 AND prev IS NOT NULL),
fcc AS (
  SELECT symbol, fold, model, cls, sum(s) AS support, sum(q) AS predicted, sum(t) AS tp FROM (
    SELECT symbol, fold, model, y_true AS cls, 1 AS s, 0 AS q, CASE WHEN y_true = y_pred THEN 1 ELSE 0 END AS t FROM fpred
    UNION ALL SELECT symbol, fold, model, y_pred, 0, 1, 0 FROM fpred) GROUP BY ALL)""", body="""
SELECT symbol, CAST(fold AS INTEGER) AS fold, model, round(avg(coalesce(2.0 * tp / nullif(support + predicted, 0), 0.0)), 6) + 0.0
       AS macro_f1 FROM fcc GROUP BY symbol, fold, model"""))
def eval_07(spark, sf):
    f = _folded(spark, sf).select("symbol", "date", "fold", "label")
    w = Window.partitionBy("symbol").orderBy("date")
    p = f.withColumn("prev", F.lag("label").over(w)).where((F.col("fold") >= 1) & F.col("prev").isNotNull())
    p = p.select("symbol", "fold", F.lit("persistence").alias("model"), F.col("label").alias("y_true"),
                 F.col("prev").alias("y_pred"))
    m = classification_metrics(p, ["symbol", "fold", "model"])
    return rounded(m.select("symbol", "fold", "model", "macro_f1"))


# ---- drift ----------------------------------------------------------------------------------

DRIFT_COLS = FEATURE_COLUMNS[:30] + ["label"]
_DRIFT_SQL = O.PROCESSED + """,
dpos AS (
  SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) - 1 AS pi,
         count(*) OVER (PARTITION BY symbol) AS pn FROM processed),
dlong AS (
  SELECT symbol, CASE WHEN pi < floor(pn * CAST(0.8 AS DOUBLE)) THEN 'reference' ELSE 'current' END AS split,
         unnest([""" + ", ".join(f"'{c}'" for c in DRIFT_COLS) + """]) AS feature,
         unnest([""" + ", ".join(f"CAST({c} AS DOUBLE)" for c in DRIFT_COLS) + """]) AS value FROM dpos),
vc AS (
  SELECT symbol, feature, value, count(*) FILTER (WHERE split = 'reference') AS n_ref,
         count(*) FILTER (WHERE split = 'current') AS n_cur
  FROM dlong WHERE value IS NOT NULL AND NOT isnan(value) GROUP BY ALL),
tot AS (
  SELECT symbol, feature, count(*) FILTER (WHERE split = 'reference') AS ref_total,
         count(*) FILTER (WHERE split = 'current') AS cur_total, count(DISTINCT value) AS n_distinct,
         stddev_pop(value) FILTER (WHERE split = 'reference') AS ref_std
  FROM dlong WHERE value IS NOT NULL AND NOT isnan(value) GROUP BY ALL),
cdf AS (
  SELECT v.*, t.ref_total, t.cur_total, t.ref_std,
         sum(n_ref) OVER w / t.ref_total AS F1, sum(n_cur) OVER w / t.cur_total AS F2,
         lead(value) OVER (PARTITION BY v.symbol, v.feature ORDER BY value) - value AS gap
  FROM vc v JOIN tot t USING (symbol, feature)
  WINDOW w AS (PARTITION BY v.symbol, v.feature ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
num AS (
  SELECT symbol, feature, max(abs(F1 - F2)) AS ks_stat,
         sum(abs(F1 - F2) * coalesce(gap, 0.0)) / greatest(any_value(ref_std), 0.001) AS wasserstein_norm,
         sqrt(any_value(ref_total) * any_value(cur_total) / (any_value(ref_total) + any_value(cur_total))) * max(abs(F1 - F2)) AS lam
  FROM cdf GROUP BY symbol, feature),
catx AS (
  SELECT v.*, t.ref_total, t.cur_total, v.n_ref * t.cur_total / t.ref_total AS ex,
         CASE WHEN v.n_ref = 0 THEN 0.0001 ELSE v.n_ref / t.ref_total END AS p,
         CASE WHEN v.n_cur = 0 THEN 0.0001 ELSE v.n_cur / t.cur_total END AS q,
         min(value) OVER (PARTITION BY v.symbol, v.feature) AS first_value
  FROM vc v JOIN tot t USING (symbol, feature)),
catn AS (SELECT *, p / sum(p) OVER (PARTITION BY symbol, feature) AS pn2, q / sum(q) OVER (PARTITION BY symbol, feature) AS qn2 FROM catx),
cat AS (
  SELECT symbol, feature, count(*) AS k, sum((n_cur - ex) * (n_cur - ex) / nullif(ex, 0)) AS chi2,
         sum(CASE WHEN value = first_value THEN n_ref ELSE 0 END) AS x1, sum(CASE WHEN value = first_value THEN n_cur ELSE 0 END) AS x2,
         any_value(ref_total) AS ref_total, any_value(cur_total) AS cur_total,
         sqrt(greatest(sum(0.5 * pn2 * ln(pn2 / ((pn2 + qn2) / 2)) + 0.5 * qn2 * ln(qn2 / ((pn2 + qn2) / 2))), 0.0)) AS js_distance
  FROM catn GROUP BY symbol, feature),
rep AS (
  SELECT t.symbol, t.feature, t.ref_total, t.cur_total, t.n_distinct, n.ks_stat, n.lam, n.wasserstein_norm, c.js_distance, c.chi2, c.k,
         (c.x1 / c.ref_total - c.x2 / c.cur_total) / nullif(sqrt(((c.x1 + c.x2) / (c.ref_total + c.cur_total))
           * (1 - (c.x1 + c.x2) / (c.ref_total + c.cur_total)) * (1.0 / c.ref_total + 1.0 / c.cur_total)), 0) AS z,
         CASE WHEN t.ref_total <= 1000 AND t.n_distinct <= 5 AND t.n_distinct = 2 THEN 'z'
              WHEN t.ref_total <= 1000 AND t.n_distinct <= 5 THEN 'chisquare' WHEN t.ref_total <= 1000 THEN 'ks'
              WHEN t.n_distinct <= 5 THEN 'jensenshannon' ELSE 'wasserstein' END AS method
  FROM tot t JOIN num n USING (symbol, feature) JOIN cat c USING (symbol, feature))"""


# quantiles spelt out: quantile_cont weighs both neighbours, so that between equal values its edge can
# fall an ulp below them and count them as above it
_PSI_SQL = """
sorted AS (
  SELECT symbol, feature, list(value ORDER BY value) AS v, count(*) - 1 AS top
  FROM dlong WHERE split = 'reference' AND value IS NOT NULL AND NOT isnan(value) GROUP BY ALL),
edges AS (
  SELECT symbol, feature, list_transform([0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]::DOUBLE[], lambda q:
    v[floor(top * q)::INT + 1] + (v[ceil(top * q)::INT + 1] - v[floor(top * q)::INT + 1]) * (top * q - floor(top * q))) AS e
  FROM sorted),
binned AS (
  SELECT l.symbol, l.feature, l.split, CAST(list_sum(list_transform(e.e, lambda x: CASE WHEN l.value > x THEN 1 ELSE 0 END)) AS INTEGER) AS bin
  FROM dlong l JOIN edges e USING (symbol, feature) WHERE l.value IS NOT NULL AND NOT isnan(l.value)),
bc AS (SELECT symbol, feature, bin, count(*) FILTER (WHERE split = 'reference') AS r, count(*) FILTER (WHERE split = 'current') AS c
       FROM binned GROUP BY ALL),
bt AS (SELECT symbol, feature, sum(r) AS RR, sum(c) AS CC FROM bc GROUP BY ALL),
sp AS (SELECT bt.*, b.range AS bin FROM bt CROSS JOIN range(10) b),
psi AS (
SELECT sp.symbol, sp.feature, sum((greatest(coalesce(bc.c, 0) / sp.CC, 0.0001) - greatest(coalesce(bc.r, 0) / sp.RR, 0.0001))
       * ln(greatest(coalesce(bc.c, 0) / sp.CC, 0.0001) / greatest(coalesce(bc.r, 0) / sp.RR, 0.0001))) AS psi
FROM sp LEFT JOIN bc ON bc.symbol = sp.symbol AND bc.feature = sp.feature AND bc.bin = sp.bin
GROUP BY sp.symbol, sp.feature)"""

_KS_P = """least(greatest(CASE WHEN lam = 0 THEN 1.0
            WHEN lam >= 0.5 THEN 2.0 * list_sum(list_transform(range(1, 101), lambda j: pow(-1.0, j - 1) * exp(-2.0 * j * j * lam * lam)))
            ELSE 1.0 - sqrt(2.0 * pi()) / lam * list_sum(list_transform(range(1, 101), lambda j: exp(-pow(2.0 * j - 1, 2) * pi() * pi() / (8.0 * lam * lam))))
            END, 0.0), 1.0)"""


def _erfc(x: str) -> str:
    """1 - erf by its series of positive terms, 2 / sqrt(pi) * exp(-x^2) * sum 2^n x^(2n+1) / (2n+1)!!;
    beyond 6 it is below 1e-16."""
    term = f"exp(n * ln(2.0) + (2 * n + 1) * ln(e) - (lgamma(2 * n + 2) - n * ln(2.0) - lgamma(n + 1)))"
    return (f"(SELECT CASE WHEN e > 6 THEN 0.0 WHEN e = 0 THEN 1.0 ELSE 1.0 - 2.0 / sqrt(pi()) * exp(-e * e) "
            f"* list_sum(list_transform(range(0, 201), lambda n: {term})) END FROM (SELECT CAST({x} AS DOUBLE) AS e))")


# p-values in closed form (at most five categories: four degrees of freedom)
_REPORT_SQL = f"""
flagged AS (
  SELECT *, CASE method WHEN 'jensenshannon' THEN js_distance WHEN 'wasserstein' THEN wasserstein_norm
      WHEN 'ks' THEN {_KS_P}
      WHEN 'z' THEN {_erfc("abs(z) / sqrt(2.0)")}
      WHEN 'chisquare' THEN CASE k - 1
        WHEN 1 THEN {_erfc("sqrt(chi2 / 2)")}
        WHEN 2 THEN exp(-chi2 / 2)
        WHEN 3 THEN {_erfc("sqrt(chi2 / 2)")} + sqrt(2 * chi2 / pi()) * exp(-chi2 / 2)
        WHEN 4 THEN exp(-chi2 / 2) * (1 + chi2 / 2) END END AS score
  FROM rep),
report AS (
  SELECT *, coalesce(CASE WHEN method IN ('z', 'chisquare', 'ks') THEN score < 0.05 ELSE score >= 0.1 END, false)
         AS drifted FROM flagged)"""


def _drift_long(spark, sf):
    return dr.drift_long(_processed(spark, sf), DRIFT_COLS)


def _drift_statistics(spark, sf):
    return dr.drift_statistics(dr.value_counts(_drift_long(spark, sf)))


@register("drf_01_drift_columns", O.with_bars(O.BARS_FLAG, _DRIFT_SQL, body="""
SELECT symbol, feature, split, count(*) AS n, round(avg(value), 6) + 0.0 AS mean FROM dlong GROUP BY ALL"""))
def drf_01(spark, sf):
    return rounded(_drift_long(spark, sf).groupBy("symbol", "feature", "split").agg(F.count("*").alias("n"), F.avg("value").alias("mean")))


@register("drf_02_psi", O.with_bars(O.BARS_FLAG, _DRIFT_SQL, _PSI_SQL, body="""
SELECT symbol, feature, round(psi, 6) + 0.0 AS psi FROM psi"""))
def drf_02(spark, sf):
    return rounded(_drift_statistics(spark, sf).select("symbol", "feature", "psi"))


@register("drf_03_ks", O.with_bars(O.BARS_FLAG, _DRIFT_SQL, body=f"""
SELECT symbol, feature, round(ks_stat, 6) + 0.0 AS ks_stat,
       round({_KS_P}, 6) + 0.0 AS ks_p_value
FROM num"""))
def drf_03(spark, sf):
    return rounded(_drift_statistics(spark, sf).select("symbol", "feature", "ks_stat", "ks_p_value"))


@register("drf_04_chi2_z", O.with_bars(O.BARS_FLAG, _DRIFT_SQL, body="""
SELECT c.symbol, c.feature, c.k, round(c.chi2, 6) + 0.0 AS chi2,
       round(CASE WHEN c.k = 2 THEN (c.x1 / c.ref_total - c.x2 / c.cur_total) / nullif(sqrt(((c.x1 + c.x2) / (c.ref_total + c.cur_total))
             * (1 - (c.x1 + c.x2) / (c.ref_total + c.cur_total)) * (1.0 / c.ref_total + 1.0 / c.cur_total)), 0) END, 6) + 0.0 AS z
FROM cat c JOIN tot t USING (symbol, feature) WHERE t.n_distinct <= 5"""))
def drf_04(spark, sf):
    c = _drift_statistics(spark, sf).where(F.col("n_distinct") <= 5)
    return rounded(c.select("symbol", "feature", F.col("n_distinct").alias("k"), "chi2", "z"))


@register("drf_05_wasserstein_js", O.with_bars(O.BARS_FLAG, _DRIFT_SQL, body="""
SELECT n.symbol, n.feature, round(n.wasserstein_norm, 6) + 0.0 AS wasserstein_norm, round(c.js_distance, 6) + 0.0 AS js_distance
FROM num n JOIN cat c USING (symbol, feature)"""))
def drf_05(spark, sf):
    return rounded(_drift_statistics(spark, sf).select("symbol", "feature", "wasserstein_norm", "js_distance"))


@register("drf_06_method_and_flags", O.with_bars(O.BARS_FLAG, _DRIFT_SQL, _REPORT_SQL, body="""
SELECT symbol, feature, method, round(score, 6) + 0.0 AS score, drifted FROM report"""))
def drf_06(spark, sf):
    r = dr.drift_report(_processed(spark, sf), DRIFT_COLS)
    return rounded(r.select("symbol", "feature", "method", "score", "drifted"))


_DATASET_SQL = """
SELECT symbol, round(avg(CAST(drifted AS DOUBLE)), 6) + 0.0 AS share_drifted, count(*) AS n_columns,
       avg(CAST(drifted AS DOUBLE)) >= 0.5 AS dataset_drift
FROM report GROUP BY symbol"""
_ALERT_SQL = """
SELECT symbol, feature, method AS metric, round(score, 6) + 0.0 AS value FROM report WHERE drifted
UNION ALL
SELECT symbol, feature, 'psi', round(psi, 6) + 0.0 FROM psi WHERE psi > 0.2"""


@register("drf_06_dataset_drift", O.with_bars(O.BARS_FLAG, _DRIFT_SQL, _REPORT_SQL, body=_DATASET_SQL))
def drf_06_dataset(spark, sf):
    return rounded(dr.dataset_drift(dr.drift_report(_processed(spark, sf), DRIFT_COLS)))


@register("drf_07_alerts", O.with_bars(O.BARS_FLAG, _DRIFT_SQL, _REPORT_SQL, _PSI_SQL, body=_ALERT_SQL))
def drf_07(spark, sf):
    return rounded(dr.drift_alerts(dr.drift_report(_processed(spark, sf), DRIFT_COLS)))


# The supplier bars, with references of about 400 rows, take the small-sample branch: p-value tests.

def _supplier_report(spark, sf):
    lengths = fx.bars_supplier_lengths(spark, sf)
    return dr.drift_report(engineer_features(fx.bars_supplier(spark, sf), lengths=lengths), DRIFT_COLS, lengths, in_order=True)


@register("drf_06_supplier_dataset_drift", O.with_bars(O.BARS_SUPPLIER, _DRIFT_SQL, _REPORT_SQL, body=_DATASET_SQL))
def drf_06_supplier(spark, sf):
    return rounded(dr.dataset_drift(_supplier_report(spark, sf)))


@register("drf_07_all_alerts", O.with_bars(O.BARS_SUPPLIER, _DRIFT_SQL, _REPORT_SQL, _PSI_SQL, body=_ALERT_SQL))
def drf_07_all(spark, sf):
    return rounded(dr.drift_alerts(_supplier_report(spark, sf)))
