"""Default parameters of the pipeline (one frozen dataclass, no Spark object)."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class LabelThresholds:
    # Five-class forward-return thresholds.
    strong_buy: float = 0.02
    buy: float = 0.005
    sell: float = -0.005
    strong_sell: float = -0.02


@dataclass(frozen=True)
class Config:
    labels: LabelThresholds = field(default_factory=LabelThresholds)
    period: str = "5y"
    test_size: float = 0.2
    cv_folds: int = 5
    random_state: int = 42
    use_smote: bool = True
    search_trials: int = 50
    sequence_length: int = 20
    news_lookback_days: int = 7
    max_headlines_per_stock: int = 20
    news_recency_days: int = 90
    drift_threshold_psi: float = 0.2
    drift_threshold_ks_pvalue: float = 0.05
    min_raw_rows: int = 200
    min_processed_rows: int = 100
    forecast_context: int = 64


DEFAULT = Config()

# Signal class names by class index 0..4.
CLASS_NAMES = ["strong_sell", "sell", "hold", "buy", "strong_buy"]
SIGNAL_NAMES = ["STRONG SELL", "SELL", "HOLD", "BUY", "STRONG BUY"]

# Neutral sentiment used where no headline exists.
NEUTRAL_SENTIMENT = {
    "sentiment_score": 0.0,
    "sentiment_confidence": 0.5,
    "news_count_7d": 0.0,
    "sentiment_trend_3d": 0.0,
}
SENTIMENT_FEATURES = list(NEUTRAL_SENTIMENT)
