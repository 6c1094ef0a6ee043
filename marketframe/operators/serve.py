"""Serving-shaped outputs as tables: latest rows, forecast-slot probabilities,
prediction records, candles, digests, batch results and drift status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import functions as fn
from ..config import DEFAULT
from .labels import forecast_class
from .windows import SYMBOL, DATE, safe_corr

UNIFORM = [0.2] * 5


def uniform_probs() -> Column:
    """ML-12: the fallback distribution for a slot that cannot score."""
    return F.array(*[F.lit(p) for p in UNIFORM])


def histogram_probs(df: DataFrame, keys: list[str], cls: str) -> DataFrame:
    """AGG-06: class histogram with all 5 bins divided by the total."""
    counts = [F.sum(F.when(F.col(cls) == k, 1).otherwise(0)) for k in range(5)]
    return df.groupBy(*keys).agg(F.array(*[c / F.count("*") for c in counts]).alias("probs"))


def forecast_distribution(bars: DataFrame, context: int = DEFAULT.forecast_context,
                          by: str = SYMBOL, order: str = DATE) -> DataFrame:
    """ML-04 (forecast slot, re-aimed): for row i >= context, the empirical class
    distribution (forecast labels, strict '>' edges) of the ``context`` one-step
    returns ending at i; earlier rows get the uniform fallback. One bounded window."""
    w = Window.partitionBy(by).orderBy(order)
    frame = w.rowsBetween(-(context - 1), 0)
    ret = F.try_divide(F.col("close"), F.lag("close", 1).over(w)) - 1.0
    x = bars.select("*", ret.alias("_ret"), (F.row_number().over(w) - 1).alias("_i"))
    x = x.withColumn("_cls", forecast_class(F.col("_ret")))
    probs = F.array(*[F.sum(F.when(F.col("_ret").isNotNull() & (F.col("_cls") == k), 1).otherwise(0)).over(frame)
                      / F.lit(float(context)) for k in range(5)])
    return x.select(*bars.columns, "_i", F.when(F.col("_i") >= context, probs).otherwise(uniform_probs()).alias("probs")) \
        .drop("_i")


def latest_forecast(bars: DataFrame, context: int = DEFAULT.forecast_context,
                    by: str = SYMBOL, order: str = DATE) -> DataFrame:
    """The forecast of each symbol's latest row. It needs only the last ``context`` + 1 bars, and these are
    cut out (partly before the shuffle) before anything is scored."""
    return latest_rows(forecast_distribution(last_n(bars, context + 1, by, order), context, by, order), by, order)


def trailing_context(bars: DataFrame, context: int = DEFAULT.forecast_context,
                     by: str = SYMBOL, order: str = DATE) -> DataFrame:
    """WIN-02: the trailing ``context`` closes per row (bounded list), null before."""
    w = Window.partitionBy(by).orderBy(order)
    lst = F.collect_list("close").over(w.rowsBetween(-(context - 1), 0))
    i = F.row_number().over(w) - 1
    return bars.select(*bars.columns, F.when(i >= context, lst).alias("context"))


def latest_rows(df: DataFrame, by: str = SYMBOL, order: str = DATE) -> DataFrame:
    """TOP-03: the latest row per symbol, as one aggregation (``max_by`` over a struct
    of every column, partial before the shuffle)."""
    cols = [c for c in df.columns if c != by]
    rec = F.max_by(F.struct(*[F.col(c) for c in cols]), F.col(order))
    return df.groupBy(by).agg(rec.alias("_r")).select(by, *[F.col(f"_r.{c}").alias(c) for c in cols])


def last_n(df: DataFrame, n: int, by: str = SYMBOL, order: str = DATE) -> DataFrame:
    """TOP-02 / TOP-06: the last n rows per symbol by date (n <= 0 keeps all)."""
    if n <= 0:
        return df
    w = Window.partitionBy(by).orderBy(F.col(order).desc())
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def candles(bars: DataFrame, limit: int = 0) -> DataFrame:
    """SRV-02: candle table (10-char date, prices rounded 2, int volume, null -> 0)."""
    b = last_n(bars.dropna(subset=["date", "open", "high", "low", "close"]), limit)
    return b.select("symbol", fn.date10(F.col("date")).alias("time"),
                    *[F.round(c, 2).alias(c) for c in ("open", "high", "low", "close")],
                    F.coalesce(F.col("volume").cast("long"), F.lit(0)).alias("volume"),
                    (F.col("close") >= F.col("open")).alias("up_day"))


def signals(scored: DataFrame, probs: str = "probs") -> DataFrame:
    """ML-10 / TOP-08 / FN-05 / FN-07: probabilities -> class, name, confidence, map."""
    p = F.col(probs)
    cls = fn.argmax_class(p)
    return scored.select(
        "*", cls.alias("signal_class"), fn.class_name(cls).alias("signal"),
        F.round(F.element_at(p, cls + 1), 4).alias("confidence"),
        fn.prob_map(p).alias("probabilities"))


def label_correlation_importance(processed: DataFrame, features: list[str], n: int = 5,
                                 by: str = SYMBOL) -> DataFrame:
    """Top-n features per symbol by |corr(feature, label)| (a model-free stand-in for
    mean |SHAP|): unpivot, one grouped ``corr`` per (symbol, feature), rank <= n."""
    long = processed.select(by, F.col("label").cast("double").alias("_y"), F.explode(F.array(*[
        F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("v")) for f in features])).alias("_e"))
    c = long.groupBy(by, F.col("_e.feature").alias("feature")).agg(safe_corr("_e.v", "_y").alias("corr"))
    c = c.where(F.col("corr").isNotNull() & ~F.isnan("corr"))
    w = Window.partitionBy(by).orderBy(F.abs("corr").desc(), F.col("feature").asc())
    return (c.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
            .select(by, "feature", F.round(F.abs("corr"), 4).alias("importance"), "rank"))


def top_feature_lists(importance: DataFrame, by: str = SYMBOL) -> DataFrame:
    """Rank-ordered name/value arrays per symbol (at most n entries each)."""
    g = importance.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("rank", "feature", "importance"))).alias("_t"))
    return g.select(by, F.col("_t.feature").alias("feat_names"), F.col("_t.importance").alias("feat_values"))


def prediction_features(explained: DataFrame, cols: list[str], n: int = 5) -> DataFrame:
    """TOP-04 of single predictions: of ``boosting.explain``'s rows the ``n`` features with the largest absolute
    contribution, and what the others add together (``other``)."""
    named = F.transform(F.col("contributions"), lambda v, i: F.struct(
        F.abs(v).alias("size"), (-i).alias("at"), F.element_at(F.array(*map(F.lit, cols)), i + 1).alias("feature"), v.alias("contribution")))
    # the largest first; ties to the first listed
    top = F.slice(F.reverse(F.array_sort(named)), 1, n)
    x = explained.withColumn("_top", top).withColumn("_sum", F.aggregate("contributions", F.lit(0.0), lambda a, v: a + v))
    other = F.col("_sum") - F.aggregate("_top", F.lit(0.0), lambda a, v: a + v["contribution"])
    return x.select(*[c for c in explained.columns if c != "contributions"], other.alias("other"), F.posexplode("_top").alias("_i", "_t")) \
        .select(*[c for c in explained.columns if c != "contributions"], "other", (F.col("_i") + 1).alias("rank"), "_t.feature", "_t.contribution")


def prediction_records(preds: DataFrame, sentiment: DataFrame, top: DataFrame,
                       model_used: str = "forecast_distribution") -> DataFrame:
    """JOIN-06 / SRV-01: prediction + live sentiment + top features + explanation.

    ``preds`` has (symbol, date, probs); ``sentiment`` has (symbol, sentiment_*);
    ``top`` has (symbol, feat_names, feat_values). All joins are on symbol with
    one row per symbol on each side."""
    s = preds if "signal_class" in preds.columns else signals(preds)
    j = s.join(sentiment.select("symbol", "sentiment_score", "sentiment_confidence", "news_count_7d"), "symbol", "left")
    j = j.join(top, "symbol", "left")
    names = F.coalesce(F.col("feat_names"), F.array().cast("array<string>"))
    vals = F.coalesce(F.col("feat_values"), F.array().cast("array<double>"))
    score = F.coalesce(F.col("sentiment_score"), F.lit(0.0))
    sent = F.struct(F.col("symbol").alias("symbol"), F.round(score, 4).alias("score"),
                    fn.sentiment_label(score).alias("label"),
                    F.round(F.coalesce(F.col("sentiment_confidence"), F.lit(0.5)), 4).alias("confidence"),
                    F.coalesce(F.col("news_count_7d"), F.lit(0.0)).cast("int").alias("news_count"))
    return j.select(
        "symbol", "signal", "signal_class", "confidence", "probabilities",
        F.lit(model_used).alias("model_used"), sent.alias("sentiment"),
        F.map_from_arrays(names, vals).alias("top_features"),
        fn.explanation(F.col("symbol"), F.col("signal_class"), F.col("confidence"), names, vals, score)
        .alias("explanation"),
        F.col("date").cast("string").alias("data_as_of"))


def batch_results(requests: DataFrame, available: DataFrame) -> DataFrame:
    """JOIN-04 / SRV-04: normalise each requested symbol, validate its suffix and look
    it up; one row per request with either the signal or an error text."""
    norm = requests.select("*", fn.normalize_symbol(F.col("requested")).alias("symbol"))
    j = norm.join(available.select("symbol", "signal", "signal_class"), "symbol", "left")
    err = (F.when(~fn.symbol_valid(F.col("symbol")), fn.symbol_error(F.col("symbol")))
           .when(F.col("signal").isNull(), F.concat(F.lit("No trained model found for "), F.col("symbol"))))
    return j.select("request_id", "requested", "symbol", F.when(err.isNull(), F.col("signal")).alias("signal"),
                    err.alias("error"))


def latest_reports(reports: DataFrame) -> DataFrame:
    """TOP-07: latest drift report per symbol by the stamp embedded in the name."""
    sym = F.regexp_extract("name", r"^(.*)_\d{8}_\d{6}_drift_report\.html$", 1)
    r = reports.select(sym.alias("symbol"), "name", fn.report_stamp(F.col("name")).alias("stamp"))
    return r.groupBy("symbol").agg(F.max_by("name", "stamp").alias("latest_report"),
                                   F.max("stamp").alias("report_date"))


def drift_status(symbols: DataFrame, reports: DataFrame) -> DataFrame:
    """JOIN-05 / SRV-05: configured symbols left join latest report; none -> no_reports."""
    j = symbols.join(latest_reports(reports), "symbol", "left")
    return j.select("symbol", F.when(F.col("latest_report").isNull(), "no_reports").otherwise("ok").alias("status"),
                    "latest_report", "report_date")


def digest(records: DataFrame, requests: DataFrame | None = None) -> DataFrame:
    """AGG-08 / SRV-03: newline-joined 'SYMBOL: Signal (conf=NN%)' lines in symbol order.

    ``requests`` (batch, symbol) names the symbols of each request: one row (batch, summary) per batch,
    so a row holds only the symbols that one request asks for. Without it all records are one request:
    meant for the latest-row table of the configured symbols, never for history."""
    line = F.concat(F.col("symbol"), F.lit(": "), F.col("signal"), F.lit(" (conf="),
                    fn.percent0(F.col("confidence")), F.lit(")"))
    if requests is None:
        g = records.agg(F.array_sort(F.collect_list(F.struct(F.col("symbol"), line.alias("l")))).alias("_a"))
    else:
        own = records.select("symbol", line.alias("_l"))
        told = F.when(F.col("_l").isNotNull(), F.struct(F.col("symbol"), F.col("_l").alias("l")))
        g = requests.select("batch", "symbol").distinct().join(own, "symbol", "left").groupBy("batch") \
            .agg(F.array_sort(F.collect_list(told)).alias("_a"))
    none = F.lit("No predictions available.")
    lines = F.array_join(F.col("_a.l"), "\n")
    if requests is None:
        return g.select(F.coalesce(lines, none).alias("summary"))
    return g.select("batch", F.when(F.size("_a") > 0, lines).otherwise(none).alias("summary"))


def projection_cone(preds: DataFrame, horizon: str = "month", probs: str = "probs") -> DataFrame:
    """FN-12: indexed (start = 100) mean / high / low path over the horizon, 41 points."""
    days = fn.HORIZON_DAYS[horizon]
    mu, sigma = fn.mu_sigma(F.col(probs))
    x = preds.select("symbol", mu.alias("mu"), sigma.alias("sigma"),
                     F.explode(F.sequence(F.lit(0), F.lit(fn.CONE_STEPS))).alias("step"))
    t = F.col("step") * float(days) / fn.CONE_STEPS
    spread = fn.CONE_Z * F.col("sigma") * F.sqrt(t)
    return x.select("symbol", "step", t.alias("t"),
                    (100.0 * F.exp(F.col("mu") * t)).alias("mean"),
                    (100.0 * F.exp(F.col("mu") * t + spread)).alias("high"),
                    (100.0 * F.exp(F.col("mu") * t - spread)).alias("low"))
