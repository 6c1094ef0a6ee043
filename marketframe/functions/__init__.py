"""Scalar column functions (FN-*): built-in expressions only, no Python UDFs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import CLASS_NAMES

# Display names of the five signal classes (index 0..4).
SIGNAL_LABELS = ["Strong Sell", "Sell", "Hold", "Buy", "Strong Buy"]
# Explanation phrases per signal class (index 0..4).
SIGNAL_CONTEXT = ["very strong bearish signals", "bearish signals", "neutral or mixed signals",
                  "bullish signals", "very strong bullish signals"]
# Representative daily return of each class (index 0..4) and cone settings.
CLASS_RETURN = [-0.025, -0.0125, 0.0, 0.0125, 0.025]
HORIZON_DAYS = {"day": 7, "month": 21, "year": 252}
CONE_Z = 1.645
CONE_STEPS = 40
# Chart ranges in rows.
RANGE_ROWS = {"1m": 21, "3m": 63, "6m": 126, "1y": 252, "max": 0}
# Request size limits.
QUERY_MIN, QUERY_MAX = 5, 500
BATCH_MIN, BATCH_MAX = 1, 20
SUFFIXES = (".NS", ".BO")
EXPLANATION_NOTE = ("[Note: Install Ollama + Granite 4.1-3B for detailed AI explanations: "
                    "brew install ollama && ollama pull granite4.1:3b]")


def _lit_array(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def normalize_symbol(s: Column) -> Column:
    """FN-02: upper-case, trim, append '.NS' when there is no dot."""
    u = F.upper(F.trim(s))
    return F.when(u.contains("."), u).otherwise(F.concat(u, F.lit(".NS")))


def symbol_valid(s: Column) -> Column:
    """FN-03: a normalised symbol must end in .NS or .BO."""
    return s.rlike(r"\.(NS|BO)$")


def symbol_error(s: Column) -> Column:
    return F.when(~symbol_valid(s), F.lit("Symbol must end with .NS (NSE) or .BO (BSE)"))


def query_length_ok(q: Column) -> Column:
    """FN-04: free-text query length in [5, 500]."""
    return F.length(q).between(QUERY_MIN, QUERY_MAX)


def batch_size_ok(arr: Column) -> Column:
    """FN-04: batch list size in [1, 20]."""
    return F.size(arr).between(BATCH_MIN, BATCH_MAX)


def class_name(cls: Column) -> Column:
    """FN-05: class index 0..4 -> display name (null outside the range)."""
    return F.element_at(_lit_array(SIGNAL_LABELS), cls.cast("int") + 1)


def sentiment_label(score: Column) -> Column:
    """FN-06: > 0.1 positive, < -0.1 negative, else neutral."""
    return F.when(score > 0.1, "positive").when(score < -0.1, "negative").otherwise("neutral")


def prob_map(p: Column, digits: int = 4) -> Column:
    """FN-07: probability array (class order) -> {class name: rounded probability}."""
    return F.map_from_arrays(_lit_array(CLASS_NAMES), F.transform(p, lambda x: F.round(x, digits)))


def argmax_class(p: Column) -> Column:
    """TOP-08: index of the largest probability; ties resolve to the lowest index."""
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def percent0(x: Column) -> Column:
    """'{:.0%}' formatting (half-to-even, as Python formats)."""
    return F.concat(F.format_number(F.bround(x * 100.0, 0), 0), F.lit("%"))


def signed2(x: Column) -> Column:
    """'{:+.2f}' formatting."""
    r = F.bround(x, 2)
    return F.concat(F.when(r >= 0, F.lit("+")).otherwise(F.lit("")), F.format_string("%.2f", r))


def top_feature_text(names: Column, values: Column, n: int = 3) -> Column:
    """'name=v.vv' for the first n (name, value) pairs, '_' shown as a space."""
    pairs = F.arrays_zip(F.slice(names, 1, n).alias("k"), F.slice(values, 1, n).alias("v"))
    parts = F.transform(pairs, lambda e: F.concat(F.regexp_replace(e["k"], "_", " "), F.lit("="),
                                                   F.format_string("%.2f", e["v"])))
    return F.array_join(parts, ", ")


def explanation(symbol: Column, cls: Column, confidence: Column, feat_names: Column,
                feat_values: Column, sentiment_score: Column) -> Column:
    """FN-08: the template explanation sentence."""
    ctx = F.coalesce(F.element_at(_lit_array(SIGNAL_CONTEXT), cls.cast("int") + 1), F.lit("mixed signals"))
    return F.concat(
        symbol, F.lit(" shows "), ctx, F.lit(" (confidence "), percent0(confidence), F.lit("). "),
        F.lit("Key drivers: "), top_feature_text(feat_names, feat_values), F.lit(". "),
        F.lit("News sentiment is "), sentiment_label(sentiment_score), F.lit(" (score: "),
        signed2(sentiment_score), F.lit("). "), F.lit(EXPLANATION_NOTE))


def date10(x: Column) -> Column:
    """FN-09: the first 10 characters of a date/time rendered as text."""
    return F.substring(x.cast("string"), 1, 10)


def report_stamp(name: Column) -> Column:
    """FN-10: the 'YYYYMMDD_HHMMSS' stamp inside a report file name."""
    return F.regexp_extract(name, r"\d{8}_\d{6}", 0)


def mu_sigma(p: Column) -> tuple[Column, Column]:
    """FN-12: mean and standard deviation of the per-class return under p."""
    r = _lit_array(CLASS_RETURN)
    mu = F.aggregate(F.zip_with(p, r, lambda a, b: a * b), F.lit(0.0), lambda acc, x: acc + x)
    var = F.aggregate(F.zip_with(p, r, lambda a, b: a * (b - mu) * (b - mu)), F.lit(0.0), lambda acc, x: acc + x)
    return mu, F.sqrt(var)
