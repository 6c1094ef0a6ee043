"""Distribution drift between a reference split (first 80 %) and a current split
(last 20 %) per (symbol, feature).

One explode and one count per (symbol, feature, value). The counts are range-partitioned by (symbol,
feature, value), so that the values of one feature may lie in many parts. Cumulative counts run inside
a part and start at the part's offset, the sum of the parts before it; each part knows the next one's
first value. No window and no join works on a key wider than one feature's part: what a whole (symbol,
feature) has to know (totals, deciles, sums of shares) is aggregated, and dealt back to its parts. Only the p-values of chi-square and the z-test use
a small vectorised pandas function (Spark has no gamma or erf), on one row per (symbol, feature).

Many short series would pay for all that with a row per value in every shuffle. ``statistics_by_series`` takes
the same statistics from a series of at most ``SERIES_ROWS`` rows as one group of wide rows, where the features
lie; ``drift_report`` sends each series its way by its length.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from ..config import DEFAULT
from ..session import arrow_map, cut_lineage
from .series_arrays import SERIES_ROWS, whole_series   # series of more rows go by range
from .splits import chrono_split

# Drift settings.
PSI_BINS = 10
PSI_FLOOR = 1e-4
SMALL_REFERENCE = 1000          # reference rows at or below this use statistical tests
CATEGORICAL_MAX_DISTINCT = 5
P_VALUE_THRESHOLD = 0.05
DISTANCE_THRESHOLD = 0.1
DATASET_SHARE = 0.5
WASSERSTEIN_MIN_NORM = 0.001
SMOOTHING = 0.0001
KS_TERMS = 12


def drift_columns(processed: DataFrame, n_first: int = 30, extra: tuple[str, ...] = ("label",)) -> list[str]:
    """DRF-01: the first ``n_first`` feature columns in table order, plus the label."""
    feats = [c for c in processed.columns if c not in ("symbol", "date", "label", "_i")]
    return feats[:n_first] + [c for c in extra if c in processed.columns]


def drift_long(processed: DataFrame, cols: list[str], test_size: float = DEFAULT.test_size) -> DataFrame:
    """DRF-01: (symbol, feature, split, value) with split 'reference' / 'current'."""
    x = chrono_split(processed.select("symbol", "date", *cols), test_size)
    split = F.when(F.col("split") == "train", "reference").otherwise("current")
    items = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in cols])
    return x.select("symbol", split.alias("split"), F.explode(items).alias("_e")) \
        .select("symbol", "_e.feature", "split", "_e.value")


def value_counts(long: DataFrame) -> DataFrame:
    """(symbol, feature, value, n_ref, n_cur): one grouped aggregation."""
    return long.where(F.col("value").isNotNull() & ~F.isnan("value")).groupBy("symbol", "feature", "value").agg(
        F.count(F.when(F.col("split") == "reference", 1)).alias("n_ref"),
        F.count(F.when(F.col("split") == "current", 1)).alias("n_cur"))


GROUP = ["symbol", "feature"]
PART = GROUP + ["_part"]


def in_parts(counts: DataFrame, n_parts: int | None = None) -> DataFrame:
    """Deals the counts to parts of consecutive values (``n_parts``: by default the session's shuffle
    partitions, merged by their size). Written once: the part's number must not change in a rerun."""
    ranges = counts.repartitionByRange(*([n_parts] if n_parts else []), *GROUP, "value")
    return cut_lineage(ranges.withColumn("_part", F.spark_partition_id()))


def part_totals(dealt: DataFrame) -> DataFrame:
    """One row per part of a (symbol, feature): what lies before it, the first value after it, and the
    totals of the whole feature. A feature has at most as many rows here as there are partitions."""
    parts = dealt.groupBy(*PART).agg(F.sum("n_ref").alias("_ref"), F.sum("n_cur").alias("_cur"), F.min("value").alias("_least"),
                                     F.sum(F.col("value") * F.col("n_ref")).alias("_sum"))
    group = Window.partitionBy(*GROUP)
    before = group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)

    def offset(n: str) -> Column:
        return F.coalesce(F.sum(n).over(before), F.lit(0))

    return parts.select(
        *PART, offset("_ref").alias("_before_ref"), offset("_cur").alias("_before_cur"),
        F.lead("_least").over(group.orderBy("_part")).alias("_next"), F.sum("_ref").over(group).alias("ref_total"),
        F.sum("_cur").over(group).alias("cur_total"), F.sum("_sum").over(group).alias("ref_sum"))


def _ranks(k: int, bins: int) -> tuple[Column, Column, Column]:
    """The two ranks around (n - 1) * k / bins, and the way from the one to the other."""
    pos = (F.col("ref_total") - 1) * F.lit(k / bins)
    return F.floor(pos), F.ceil(pos), pos - F.floor(pos)


def _ranked_value(rank: Column) -> Column:
    """The reference value of 0-based ``rank``: an aggregate over the cumulative counts."""
    return F.min(F.when(F.col("cum_ref") > rank, F.col("value")))


def drift_statistics(counts: DataFrame, bins: int = PSI_BINS, n_parts: int | None = None) -> DataFrame:
    """Every statistic of every (symbol, feature), out of ``value_counts``:

    * totals: ref_total, cur_total, n_distinct;
    * DRF-02 psi: bin(x) = number of the 9 inner reference deciles strictly below x, shares floored at 1e-4;
    * DRF-03 ks_stat = max |F_ref - F_cur| and its p-value;
    * DRF-05 wasserstein_norm = sum |F_ref - F_cur| * gap to the next value, over max(reference std, 0.001);
    * DRF-04 chi2 of current counts against reference counts scaled to the current size, z of the share of
      the least value where there are two;
    * DRF-05 js_distance (natural log) of the shares, zero shares set to 1e-4 and renormalised.
    """
    part = Window.partitionBy(*PART).orderBy("value")
    run = part.rowsBetween(Window.unboundedPreceding, 0)
    n_ref, n_cur = F.col("n_ref"), F.col("n_cur")
    ref_total, cur_total = F.col("ref_total"), F.col("cur_total")
    dealt = in_parts(counts, n_parts)
    parts = part_totals(dealt)
    x = dealt.join(parts, PART).select(
        *PART, "value", "n_ref", "n_cur", "ref_total", "cur_total",
        (F.col("_before_ref") + F.sum("n_ref").over(run)).alias("cum_ref"),
        (F.col("_before_cur") + F.sum("n_cur").over(run)).alias("cum_cur"),
        (F.coalesce(F.lead("value").over(part), F.col("_next")) - F.col("value")).alias("gap"),
        F.try_divide("ref_sum", "ref_total").alias("ref_mean"))
    x = x.select(
        "*", F.when(n_ref == 0, SMOOTHING).otherwise(F.try_divide(n_ref, ref_total)).alias("p"),
        F.when(n_cur == 0, SMOOTHING).otherwise(F.try_divide(n_cur, cur_total)).alias("q"),
        F.abs(F.try_divide("cum_ref", "ref_total") - F.try_divide("cum_cur", "cur_total")).alias("cdf_gap"),
        F.try_divide(n_ref * cur_total, ref_total).alias("expected"))
    # what the whole feature knows: values at the ranks around its deciles, sums of shares
    ranks = [_ranks(k, bins) for k in range(1, bins)]
    known = x.groupBy(*GROUP).agg(
        F.sum("p").alias("_p"), F.sum("q").alias("_q"),
        F.array(*[_ranked_value(low) for low, _, _ in ranks]).alias("_low"),
        F.array(*[_ranked_value(high) for _, high, _ in ranks]).alias("_high"))
    # ... goes to its parts first, so that no join meets all values of a feature
    known = parts.select(*PART, "ref_total").join(known, GROUP).select(*PART, "_p", "_q", F.array(*[
        F.col("_low")[k] + (F.col("_high")[k] - F.col("_low")[k]) * way for k, (_, _, way) in enumerate(ranks)]).alias("edges"))
    x = x.join(known, PART)
    pn, qn = F.try_divide(F.col("p"), F.col("_p")), F.try_divide(F.col("q"), F.col("_q"))
    below = F.aggregate("edges", F.lit(0), lambda acc, e: acc + F.when(F.col("value") > e, 1).otherwise(0))
    x = x.select("*", pn.alias("pn"), qn.alias("qn"), below.alias("bin"))
    mid = (F.col("pn") + F.col("qn")) / 2.0

    def binned(n: Column) -> Column:
        return F.array(*[F.sum(F.when(F.col("bin") == b, n).otherwise(0)) for b in range(bins)])

    g = x.groupBy("symbol", "feature").agg(
        F.first("ref_total").alias("ref_total"), F.first("cur_total").alias("cur_total"),
        F.count("*").alias("n_distinct"), binned(n_ref).alias("ref_bins"), binned(n_cur).alias("cur_bins"),
        F.sqrt(F.try_divide(F.sum(n_ref * (F.col("value") - F.col("ref_mean")) ** 2),
                            F.first("ref_total"))).alias("ref_std"),
        F.max("cdf_gap").alias("ks_stat"),
        F.sum(F.col("cdf_gap") * F.coalesce(F.col("gap"), F.lit(0.0))).alias("w1"),
        F.sum(F.try_divide((n_cur - F.col("expected")) ** 2, F.col("expected"))).alias("chi2"),
        F.min_by("n_ref", "value").alias("x1"), F.min_by("n_cur", "value").alias("x2"),
        F.sum(0.5 * F.col("pn") * F.log(F.col("pn") / mid) + 0.5 * F.col("qn") * F.log(F.col("qn") / mid)).alias("jsd"))
    return _scores(g)


def _scores(g: DataFrame) -> DataFrame:
    """The statistics out of a (symbol, feature)'s totals, bins and sums."""
    ref_total, cur_total = F.col("ref_total"), F.col("cur_total")
    both = F.try_divide(ref_total * cur_total, ref_total + cur_total)
    pool = F.try_divide(F.col("x1") + F.col("x2"), ref_total + cur_total)
    z = F.try_divide(F.try_divide("x1", "ref_total") - F.try_divide("x2", "cur_total"),
                     F.sqrt(F.try_divide(pool * (1 - pool), both)))
    return g.select(
        "symbol", "feature", "ref_total", "cur_total", "n_distinct", _psi("ref_bins", "cur_bins").alias("psi"),
        "ks_stat", ks_p_value(F.sqrt(both) * F.col("ks_stat")).alias("ks_p_value"),
        (F.col("w1") / F.greatest(F.col("ref_std"), F.lit(WASSERSTEIN_MIN_NORM))).alias("wasserstein_norm"),
        "chi2", F.when(F.col("n_distinct") == 2, z).alias("z"),
        F.sqrt(F.greatest(F.col("jsd"), F.lit(0.0))).alias("js_distance"))


def _psi(ref_bins: str, cur_bins: str) -> Column:
    """Sum over bins of (c - r) * ln(c / r), shares floored at 1e-4."""
    def shares(b: str) -> Column:
        total = F.aggregate(b, F.lit(0).cast("long"), lambda acc, v: acc + v)
        return F.transform(b, lambda v: F.greatest(F.try_divide(v, total), F.lit(PSI_FLOOR)))

    terms = F.zip_with(shares(ref_bins), shares(cur_bins), lambda r, c: (c - r) * F.log(c / r))
    return F.aggregate(terms, F.lit(0.0), lambda acc, t: acc + t)


_SERIES_SCHEMA = ("feature string, ref_total long, cur_total long, n_distinct long, ref_bins array<long>, cur_bins array<long>, "
                  "ref_std double, ks_stat double, w1 double, chi2 double, x1 long, x2 long, jsd double")
_REAL = {"ref_std", "ks_stat", "w1", "chi2", "jsd"}


def _series_sums(x: np.ndarray, is_ref: np.ndarray, bins: int) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """What ``_scores`` reads, for all features of a series at once; x: (feature, row), nulls and NaN are left out.
    Returns the features that have values and, by name, one entry for each. NaN where the share of an empty split would
    be needed."""
    order = np.argsort(x, axis=1)
    v, ref = np.take_along_axis(x, order, axis=1), is_ref[order]
    seen = ~np.isnan(v)
    ends = seen.copy()
    ends[:, :-1] &= v[:, 1:] != v[:, :-1]
    f, at = np.nonzero(ends)                      # the distinct values, by feature and value
    value, cum_ref, cum_cur = v[f, at], np.cumsum(ref & seen, axis=1)[f, at], np.cumsum(~ref & seen, axis=1)[f, at]
    new = np.concatenate([[True], f[1:] != f[:-1]])[:len(f)]
    starts = np.flatnonzero(new)
    if not len(starts):
        return starts, {}
    group, last = np.cumsum(new) - 1, np.concatenate([starts[1:], [len(f)]]) - 1
    n_ref, n_cur = (c - np.where(new, 0, np.concatenate([[0], c[:-1]])) for c in (cum_ref, cum_cur))
    ref_total, cur_total = cum_ref[last], cum_cur[last]
    total = lambda y: np.add.reduceat(y, starts)
    p = np.where(n_ref == 0, SMOOTHING, n_ref / np.maximum(ref_total, 1)[group])
    q = np.where(n_cur == 0, SMOOTHING, n_cur / np.maximum(cur_total, 1)[group])
    pn, qn = p / total(p)[group], q / total(q)[group]
    mid = (pn + qn) / 2.0
    some_ref, both = np.where(ref_total > 0, ref_total, np.nan), (ref_total > 0) & (cur_total > 0)
    mean = total(value * n_ref) / some_ref
    cdf_gap = np.abs(cum_ref / np.maximum(ref_total, 1)[group] - cum_cur / np.maximum(cur_total, 1)[group])
    gap = np.zeros_like(value)
    gap[:-1] = value[1:] - value[:-1]
    gap[last] = 0.0
    expected = n_ref * np.where(both, cur_total / some_ref, 1.0)[group]
    known = np.where(both, 1.0, np.nan)
    # the reference values around each decile, and how many values lie between the deciles
    sorted_ref = np.sort(x[:, is_ref], axis=1)[f[starts]]
    pos = (ref_total - 1)[:, None] * (np.arange(1, bins) / bins)
    edges = np.full(pos.shape, np.inf)
    if sorted_ref.shape[1]:
        low, high = (np.take_along_axis(sorted_ref, np.maximum(r, 0).astype(int), axis=1) for r in (np.floor(pos), np.ceil(pos)))
        edges = np.where((ref_total > 0)[:, None], low + (high - low) * (pos - np.floor(pos)), np.inf)

    def counted(side: np.ndarray, n: np.ndarray) -> np.ndarray:
        upto = np.stack([np.count_nonzero(side <= e[:, None], axis=1) for e in edges.T], axis=1)
        return np.diff(upto, axis=1, prepend=0, append=n[:, None]).ravel()

    return f[starts], {
        "ref_total": ref_total, "cur_total": cur_total, "n_distinct": last - starts + 1,
        "ref_bins": counted(sorted_ref, ref_total), "cur_bins": counted(x[:, ~is_ref][f[starts]], cur_total),
        "ref_std": np.sqrt(total(n_ref * (value - mean[group]) ** 2) / some_ref), "ks_stat": np.maximum.reduceat(cdf_gap, starts) * known,
        "w1": total(cdf_gap * gap) * known, "chi2": total(np.where(n_ref > 0, (n_cur - expected) ** 2 / np.where(n_ref > 0, expected, 1.0), 0.0)) * known,
        "x1": n_ref[starts], "x2": n_cur[starts], "jsd": total(0.5 * pn * np.log(pn / mid) + 0.5 * qn * np.log(qn / mid))}


def _series_table(symbol: pa.Array, x: np.ndarray, is_ref: np.ndarray, cols: list[str], bins: int) -> pa.Table:
    """``_series_sums`` as rows of (symbol, _SERIES_SCHEMA); symbol: an array whose first entry is the series' own."""
    with np.errstate(all="ignore"):
        features, sums = _series_sums(x, is_ref, bins)
    n = len(features)
    out = {"symbol": symbol.take(pa.array(np.zeros(n, np.int64))), "feature": pa.array([cols[f] for f in features], pa.string())}
    for name in (c.split()[0] for c in _SERIES_SCHEMA.split(", ")[1:]):
        a = sums.get(name, np.zeros(0))
        if name.endswith("_bins"):
            out[name] = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * bins), pa.array(a.astype(np.int64)))
        elif name in _REAL:
            out[name] = pa.array(a.astype(float), pa.float64(), from_pandas=True)  # NaN: null
        else:
            out[name] = pa.array(a.astype(np.int64))
    return pa.table(out)


def statistics_by_series(processed: DataFrame, cols: list[str], test_size: float = DEFAULT.test_size,
                         bins: int = PSI_BINS, in_order: bool = False) -> DataFrame:
    """``drift_statistics`` of series that fit into a group each: one pass over wide rows, partitioned by
    symbol as the feature table is. ``in_order``: the rows of a series lie together and in the order of their dates, as
    ``engineer_features`` leaves them, so that they need not be moved again."""
    schema = StructType([processed.schema["symbol"], *StructType.fromDDL(_SERIES_SCHEMA).fields])
    if in_order:
        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for table, bounds in whole_series(batches, "symbol"):
                symbol = table.column("symbol").combine_chunks()
                x = np.stack([table.column(c).to_numpy().astype(float) for c in cols])
                done = [_series_table(symbol.slice(a, 1), x[:, a:b], np.arange(b - a) < math.floor((b - a) * (1.0 - test_size)), cols, bins)
                        for a, b in zip(bounds, bounds[1:]) if symbol[a].is_valid]
                if done:
                    yield from pa.concat_tables(done).combine_chunks().to_batches()

        return _scores(arrow_map(processed, each, schema))
    known = processed.where(F.col("symbol").isNotNull())
    x = chrono_split(known.select("symbol", "date", *cols), test_size)
    rows = x.select("symbol", (F.col("split") == "train").alias("is_ref"), F.array(*[F.col(c).cast("double") for c in cols]).alias("x"))

    def one(table: pa.Table) -> pa.Table:
        is_ref = table.column("is_ref").to_numpy()
        values = table.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(is_ref), len(cols))
        return _series_table(table.column("symbol").combine_chunks(), np.ascontiguousarray(values.T), is_ref, cols, bins)

    return _scores(rows.groupBy("symbol").applyInArrow(one, schema))


def statistics_of(processed: DataFrame, cols: list[str], lengths: DataFrame | None = None, most: int = SERIES_ROWS,
                  in_order: bool = False) -> DataFrame:
    """The statistics of every series, by its length. ``lengths`` (symbol, count) may be a cheaper bound of the
    rows of each symbol than counting ``processed``. ``in_order`` holds only where no series is longer than ``most``."""
    lengths = processed.groupBy("symbol").count() if lengths is None else lengths
    long = cut_lineage(lengths.where(F.col("count") > most).select("symbol"))
    if long.isEmpty():
        return statistics_by_series(processed, cols, in_order=in_order)
    by_range = drift_statistics(value_counts(drift_long(processed.join(long, "symbol", "left_semi"), cols)))
    return by_range.unionByName(statistics_by_series(processed.join(long, "symbol", "left_anti"), cols))


def ks_p_value(lam: Column) -> Column:
    """Asymptotic Kolmogorov survival Q(lambda): 2 sum (-1)^(j-1) exp(-2 j^2 lambda^2) from lambda 1 on,
    below it 1 - sqrt(2 pi) / lambda * sum exp(-(2j-1)^2 pi^2 / (8 lambda^2)). Either series has lost
    all weight in double precision after KS_TERMS terms on its side."""
    def series(term) -> Column:
        return F.aggregate(F.sequence(F.lit(1), F.lit(KS_TERMS)), F.lit(0.0), lambda acc, j: acc + term(j))

    large = 2.0 * series(lambda j: F.pow(F.lit(-1.0), j - 1) * F.exp(-2.0 * j * j * lam * lam))
    small = 1.0 - F.try_divide(F.lit(math.sqrt(2 * math.pi)), lam) * series(
        lambda j: F.exp(F.try_divide(-(2 * j - 1) * (2 * j - 1) * F.lit(math.pi**2), 8.0 * lam * lam)))
    p = F.when(lam == 0, F.lit(1.0)).when(lam >= 1, large).otherwise(small)
    return F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0))


def _gammaincc(a: float, x: float) -> float:
    """Regularised upper incomplete gamma Q(a, x) (series / continued fraction)."""
    if x <= 0:
        return 1.0
    if x < a + 1:
        term = total = 1.0 / a
        n = a
        for _ in range(500):
            n += 1
            term *= x / n
            total += term
            if abs(term) < abs(total) * 1e-15:
                break
        return max(0.0, 1.0 - total * math.exp(-x + a * math.log(x) - math.lgamma(a)))
    b, c, d = x + 1 - a, 1e300, 1 / (x + 1 - a)
    h = d
    for i in range(1, 500):
        an = -i * (i - a)
        b += 2
        d = an * d + b
        d = 1e-300 if abs(d) < 1e-300 else d
        c = b + an / c
        c = 1e-300 if abs(c) < 1e-300 else c
        d = 1 / d
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return math.exp(-x + a * math.log(x) - math.lgamma(a)) * h


@F.pandas_udf(DoubleType())
def chi2_p_value(stat: pd.Series, dof: pd.Series) -> pd.Series:
    """Chi-square survival function, vectorised over one row per (symbol, feature)."""
    return pd.Series([float("nan") if (s is None or np.isnan(s) or d is None or d < 1) else
                      (0.0 if np.isinf(s) else _gammaincc(d / 2.0, s / 2.0)) for s, d in zip(stat, dof)])


@F.pandas_udf(DoubleType())
def z_p_value(z: pd.Series) -> pd.Series:
    """Two-sided normal p-value 2 * (1 - Phi(|z|)) = erfc(|z| / sqrt(2))."""
    return pd.Series([float("nan") if v is None or np.isnan(v) else math.erfc(abs(v) / math.sqrt(2.0)) for v in z])


def drift_report(processed: DataFrame, cols: list[str] | None = None, lengths: DataFrame | None = None,
                 in_order: bool = False) -> DataFrame:
    """DRF-06: per (symbol, feature) the method chosen by reference size and distinct
    count, its score, and the drift flag with the method's own direction
    (p-value tests drift when p < 0.05; distances when >= 0.1); PSI stands beside it. ``in_order``: the rows of a series
    lie together, in order, as ``engineer_features`` leaves series of at most SERIES_ROWS bars (``lengths``)."""
    g = statistics_of(processed, cols or drift_columns(processed), lengths, in_order=in_order)
    small = F.col("ref_total") <= SMALL_REFERENCE
    categorical = F.col("n_distinct") <= CATEGORICAL_MAX_DISTINCT
    method = (F.when(small & categorical & (F.col("n_distinct") == 2), "z")
              .when(small & categorical, "chisquare")
              .when(small, "ks")
              .when(categorical, "jensenshannon")
              .otherwise("wasserstein"))
    g = g.withColumn("method", method)
    # the p-value functions are handed a null where their method is not the chosen one
    z = F.when(F.col("method") == "z", F.col("z"))
    chi2 = F.when(F.col("method") == "chisquare", F.col("chi2"))
    g = g.withColumns({"z_p": z_p_value(z), "chi2_p": chi2_p_value(chi2, (F.col("n_distinct") - 1).cast("double"))})
    score = (F.when(F.col("method") == "z", F.col("z_p"))
             .when(F.col("method") == "chisquare", F.col("chi2_p"))
             .when(F.col("method") == "ks", F.col("ks_p_value"))
             .when(F.col("method") == "jensenshannon", F.col("js_distance"))
             .otherwise(F.col("wasserstein_norm")))
    is_p = F.col("method").isin("z", "chisquare", "ks")
    drifted = F.when(is_p, F.col("score") < P_VALUE_THRESHOLD).otherwise(F.col("score") >= DISTANCE_THRESHOLD)
    return g.withColumn("score", score).withColumn("drifted", F.coalesce(drifted, F.lit(False))) \
        .select("symbol", "feature", "method", "score", "drifted", "ref_total", "cur_total", "n_distinct", "psi")


def dataset_drift(report: DataFrame) -> DataFrame:
    """DRF-06: share of drifted columns per symbol; the dataset drifts at >= 50 %."""
    return report.groupBy("symbol").agg(F.avg(F.col("drifted").cast("double")).alias("share_drifted"),
                                        F.count("*").alias("n_columns")) \
        .withColumn("dataset_drift", F.col("share_drifted") >= DATASET_SHARE)


def drift_alerts(report: DataFrame, psi_threshold: float = DEFAULT.drift_threshold_psi) -> DataFrame:
    """DRF-07: alert rows: drifted columns (per-method direction) and PSI above threshold, both out of one
    pass over the report."""
    item = lambda metric, value: F.struct(metric.alias("metric"), value.alias("value"))
    own = F.when(F.col("drifted"), item(F.col("method"), F.col("score")))
    psi = F.when(F.col("psi") > psi_threshold, item(F.lit("psi"), F.col("psi")))
    found = report.select("symbol", "feature", F.explode(F.array_compact(F.array(own, psi))).alias("_a"))
    return found.select("symbol", "feature", "_a.metric", "_a.value")
