"""Headline sentiment: scoring interface, daily features and live (7-day) sentiment."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, RegexTokenizer, UnivariateFeatureSelector
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, NEUTRAL_SENTIMENT
from .sets import cap_per_group, dedupe_first, lookback_union

# Company-name lookup used to build the headline search text.
COMPANY_NAMES = {
    "RELIANCE.NS": "Reliance Industries",
    "TCS.NS": "Tata Consultancy Services TCS",
    "INFY.NS": "Infosys",
    "HDFCBANK.NS": "HDFC Bank",
    "WIPRO.NS": "Wipro",
}
QUERY_SUFFIX = " stock NSE news"
# Scorer failure result.
FAILED_SCORE = ("neutral", 0.0, 0.5)
# The classes of a headline scorer.
SCORER_LABELS = ["negative", "neutral", "positive"]
# Default word lists of the lexicon scorer; both are parameters.
POSITIVE_WORDS = ["beat", "beats", "best", "climb", "gain", "gains", "good", "growth", "high", "jump", "outperform",
                  "profit", "profits", "rally", "record", "rise", "rises", "soar", "strong", "surge", "upgrade", "win"]
NEGATIVE_WORDS = ["bad", "clown", "cut", "decline", "default", "downgrade", "drop", "drops", "fall", "falls", "fraud",
                  "idiot", "loss", "losses", "low", "miss", "misses", "plunge", "scum", "sink", "slump", "trash",
                  "weak", "worst", "worthless"]


def score_from_labels(headlines: DataFrame, scored: DataFrame, key: str = "position") -> DataFrame:
    """SEN-01 (a): attach pre-computed (label, score, confidence) by key; a headline
    without a score is the failure result (neutral, 0, 0.5)."""
    s = scored.select(key, "label", "score", "confidence")
    out = headlines.join(s, key, "left")
    return out.select(*headlines.columns,
                      F.coalesce("label", F.lit(FAILED_SCORE[0])).alias("label"),
                      F.coalesce("score", F.lit(FAILED_SCORE[1])).alias("score"),
                      F.coalesce("confidence", F.lit(FAILED_SCORE[2])).alias("confidence"))


def score_with_lexicon(headlines: DataFrame, text: str = "headline", positive: list[str] | None = None,
                       negative: list[str] | None = None) -> DataFrame:
    """SEN-01 (b): score the whole text by two word lists (lower case, words parted by anything but a-z).

    More positive than negative words: (positive, +1); fewer: (negative, -1); else (neutral, 0). The
    confidence of the first two is the winner's share with one word added to either side; a neutral text,
    also an empty or a null one, is the failure result."""
    words = F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), "[^a-z]+")
    hits = lambda listed: F.size(F.filter(words, lambda w: w.isin(listed)))
    x = headlines.select("*", hits(positive or POSITIVE_WORDS).alias("_p"), hits(negative or NEGATIVE_WORDS).alias("_n"))
    up, down = F.col("_p") > F.col("_n"), F.col("_p") < F.col("_n")
    label = F.when(up, "positive").when(down, "negative").otherwise(FAILED_SCORE[0])
    score = F.when(up, 1.0).when(down, -1.0).otherwise(FAILED_SCORE[1])
    share = (F.greatest("_p", "_n") + 1) / (F.col("_p") + F.col("_n") + 2)
    return x.select(*headlines.columns, label.alias("label"), score.alias("score"),
                    F.when(up | down, share).otherwise(FAILED_SCORE[2]).alias("confidence"))


def fit_scorer(labelled: DataFrame, text: str = "headline", label: str = "label", n_terms: int = 1 << 16, kept_terms: int = 300,
               regularisation: float = 0.01, iterations: int = 50) -> PipelineModel:
    """A text classifier for ``score_with_model``: words, hashed into ``n_terms`` present or absent terms, of which
    the ``kept_terms`` that tell the classes apart best (chi-square) enter a logistic loss over the classes of
    SCORER_LABELS. The fit is distributed and reads every labelled row; a null text has no words; rows with other
    labels are left out."""
    code = F.array_position(F.array(*map(F.lit, SCORER_LABELS)), F.col(label)) - 1
    rows = labelled.select(F.coalesce(F.col(text), F.lit("")).alias("_text"), code.cast("double").alias("_y")).where("_y >= 0")
    words = RegexTokenizer(inputCol="_text", outputCol="_words", pattern=r"[^\p{L}\p{N}]+")
    terms = HashingTF(inputCol="_words", outputCol="_terms", numFeatures=n_terms, binary=True)
    chosen = UnivariateFeatureSelector(featuresCol="_terms", labelCol="_y", outputCol="_kept", selectionMode="numTopFeatures") \
        .setFeatureType("categorical").setLabelType("categorical").setSelectionThreshold(kept_terms)
    model = LogisticRegression(featuresCol="_kept", labelCol="_y", family="multinomial", maxIter=iterations, regParam=regularisation)
    return Pipeline(stages=[words, terms, chosen, model]).fit(rows)


def score_with_model(headlines: DataFrame, model, text: str = "headline") -> DataFrame:
    """SEN-01 (c): score by a model: one that ``fit_scorer`` returns, or a vectorised (pandas /
    ``predict_batch_udf``) function that gives struct<label, confidence> for a text column. Scores map
    positive/neutral/negative to +1/0/-1; the confidence is the class's probability; a null result of a function
    becomes the failure result, and so does a null text."""
    if isinstance(model, PipelineModel):
        own = headlines.columns
        x = model.transform(headlines.withColumn("_text", F.coalesce(F.col(text), F.lit(""))))
        found = F.element_at(F.array(*map(F.lit, SCORER_LABELS)), F.col("prediction").cast("int") + 1)
        known = F.col(text).isNotNull()
        x = x.select(*own, F.when(known, F.struct(found.alias("label"), F.array_max(vector_to_array("probability")).alias("confidence"))).alias("_r"))
        headlines, r, drop = x, F.col("_r"), ["_r"]
    else:
        r, drop = model(F.col(text)), []
    lab = F.coalesce(r["label"], F.lit(FAILED_SCORE[0]))
    score = F.when(lab == "positive", 1.0).when(lab == "negative", -1.0).otherwise(0.0)
    conf = F.coalesce(r["confidence"], F.lit(FAILED_SCORE[2]))
    return headlines.select("*", lab.alias("label"), score.alias("score"), conf.alias("confidence")).drop(*drop)


def aggregate_scores(scored: DataFrame, keys: list[str]) -> DataFrame:
    """AGG-01: mean score, mean confidence and headline count per group."""
    return scored.groupBy(*keys).agg(
        F.avg("score").alias("sentiment_score"),
        F.avg("confidence").alias("sentiment_confidence"),
        F.count("*").cast("double").alias("news_count_7d"))


def fetched_headlines(scored: DataFrame, cap: int = DEFAULT.max_headlines_per_stock) -> DataFrame:
    """One day's fetch: dedupe (first occurrence) within (symbol, date), then the cap."""
    d = dedupe_first(scored, ["symbol", "date", "headline"], "position")
    return cap_per_group(d, ["symbol", "date"], "position", cap)


def daily_sentiment(days: DataFrame, scored: DataFrame, as_of: str,
                    recency_days: int = DEFAULT.news_recency_days) -> DataFrame:
    """SEN-02: sentiment features for every (symbol, date) in ``days``.

    Dates more than ``recency_days`` before ``as_of`` are neutral; recent dates take
    the day's (deduped, capped) headlines through AGG-01; a day without headlines is
    neutral. Trend = score minus the score three rows earlier, null -> 0."""
    agg = aggregate_scores(fetched_headlines(scored), ["symbol", "date"])
    d = days.select("symbol", "date").distinct()
    j = d.join(agg, ["symbol", "date"], "left")
    recent = F.datediff(F.to_date(F.lit(as_of)), F.col("date")) <= recency_days
    has = recent & F.col("news_count_7d").isNotNull()
    cols = {k: F.when(has, F.col(k)).otherwise(F.lit(v)).cast("double")
            for k, v in NEUTRAL_SENTIMENT.items() if k != "sentiment_trend_3d"}
    out = j.select("symbol", "date", *[c.alias(k) for k, c in cols.items()])
    w = Window.partitionBy("symbol").orderBy("date")
    trend = F.coalesce(F.col("sentiment_score") - F.lag("sentiment_score", 3).over(w), F.lit(0.0))
    return out.withColumn("sentiment_trend_3d", trend)


def live_sentiment(scored: DataFrame, as_of_days: DataFrame,
                   lookback: int = DEFAULT.news_lookback_days) -> DataFrame:
    """SEN-03: for each (symbol, as-of date): the headlines of the last ``lookback``
    calendar days (each day's fetch deduped and capped), unioned and deduped again,
    then AGG-01; the trend is always 0. No headline -> neutral."""
    per_day = fetched_headlines(scored)
    pooled = lookback_union(per_day, as_of_days, lookback)
    uniq = dedupe_first(pooled.select("symbol", "as_of", "headline", "position", "score", "confidence"),
                        ["symbol", "as_of", "headline"], "position")
    agg = aggregate_scores(uniq, ["symbol", "as_of"]).withColumnRenamed("as_of", "date")
    d = as_of_days.select("symbol", "date").distinct()
    out = d.join(agg, ["symbol", "date"], "left")
    return out.select("symbol", "date", *[
        F.coalesce(F.col(k), F.lit(v)).cast("double").alias(k) if k != "sentiment_trend_3d"
        else F.lit(0.0).alias(k) for k, v in NEUTRAL_SENTIMENT.items()])


def search_query(symbols: DataFrame, symbol: str = "symbol") -> DataFrame:
    """JOIN-03 / SEN-04: company name from a small fixed lookup (broadcast), else the
    symbol without its exchange suffix; query = name + ' stock NSE news'."""
    spark = symbols.sparkSession
    dim = spark.createDataFrame(list(COMPANY_NAMES.items()), "lookup_symbol string, company string")
    j = symbols.join(F.broadcast(dim), F.col(symbol) == F.col("lookup_symbol"), "left")
    fallback = F.replace(F.replace(F.col(symbol), F.lit(".NS"), F.lit("")), F.lit(".BO"), F.lit(""))
    name = F.coalesce(F.col("company"), fallback)
    return j.select(*symbols.columns, name.alias("company"), F.concat(name, F.lit(QUERY_SUFFIX)).alias("query"))
