"""marketframe: a Spark-native engine for market-signal analytics.

Bars, quality rules, technical indicators, labels, sentiment features,
splits, learners, metrics and drift are all DataFrame-in / DataFrame-out
operators over one long ``(symbol, date)`` table.
"""

__version__ = "0.1.0"
