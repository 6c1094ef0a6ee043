"""Exponentially weighted sums as ordinary window expressions.

For a decay r = 1 - alpha the weighted sum N(t) = sum_{j<=t} r^(t-j) y_j is a
linear recurrence. A plain prefix sum of r^(-j) y_j overflows doubles within a
few hundred rows, so the series is cut into blocks of B rows with r^B <= e^-40:

* local(t)  = r^k * sum_{j in block, j<=t} y_j r^(-k_j)   (running sum per block)
* carry(t)  = N at the last row of the previous block
* N(t)      = local(t) + r^(k+1) * carry(t)

The block ends are a short series themselves. Their weighted sum is blocked once more: S blocks
form a super-block with r^(B S) <= e^-300, inside which a running sum of the scaled block ends gives
the carry, and the last row of the previous super-block carries the rest. What is left out weighs
less than e^-300 of what is kept, so long flat or unobserved stretches keep their ratios. Alphas whose
single block decays that far need no super-block.

Both steps are window expressions: one over ``(symbol, block)`` and one over the
series window, so the kernel needs no join, no Python and no collect. The block
window reuses the ``symbol`` hash partitioning (a subset of its keys). Several
sums are computed in one batch: alphas whose block sizes are compatible share one
block column, so a batch costs one extra sort, not one per alpha. Expressions are
SQL strings, parsed once in the JVM.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame

from .windows import IDX, SYMBOL, DATE

# r^B must fall below e^-MIN_DECAY and r^-(B-1) must stay below e^MAX_GROWTH.
MIN_DECAY = 40.0
MAX_GROWTH = 650.0
SUPER_DECAY = 640.0


@dataclass(frozen=True)
class Sum:
    """One weighted sum: output column, input SQL expression (null -> 0), alpha."""
    name: str
    y: str
    alpha: float


def _rate(alpha: float) -> float:
    return -math.log(1.0 - alpha)


def _block_groups(alphas: list[float]) -> list[tuple[int, list[float]]]:
    """Group alphas that can share one block size B."""
    groups: list[tuple[int, list[float]]] = []
    for a in sorted(set(alphas), key=_rate):
        need = math.ceil(MIN_DECAY / _rate(a))
        for gi, (b, members) in enumerate(groups):
            lo = max(b, need)
            if all((lo - 1) * _rate(m) <= MAX_GROWTH for m in members + [a]):
                groups[gi] = (lo, members + [a])
                break
        else:
            groups.append((need, [a]))
    return groups


def _keep(df: DataFrame, drop: set[str]) -> list[str]:
    return [f"`{c}`" for c in df.columns if c not in drop]


def ewm_sums(df: DataFrame, sums: list[Sum], by: str = SYMBOL, order: str = DATE,
             idx: str = IDX) -> DataFrame:
    """Add one column per ``Sum`` holding N(t)."""
    groups = _block_groups([s.alpha for s in sums])
    size_of = {a: B for B, members in groups for a in members}
    w = f"PARTITION BY {by} ORDER BY {order}"
    blocks = {B: (f"_blk{B}", f"_off{B}") for B, _ in groups}

    first = [f"floor({idx} / {B}) AS {b}" for B, (b, _) in blocks.items()]
    first += [f"{idx} % {B} AS {k}" for B, (_, k) in blocks.items()]
    df = df.selectExpr("*", *first)

    local = []
    for s in sums:
        B = size_of[s.alpha]
        b, k = blocks[B]
        r = repr(1.0 - s.alpha)
        local.append(
            f"power({r}D, {k}) * sum(coalesce({s.y}, 0D) / power({r}D, {k})) OVER (PARTITION BY {by}, {b} "
            f"ORDER BY {k} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS _loc_{s.name}")
    df = df.selectExpr("*", *local)

    def step(s: Sum) -> tuple[int, str, str, str]:
        B = size_of[s.alpha]
        return B, *blocks[B], repr(1.0 - s.alpha)

    # block ends, scaled inside their super-block, and the super-block's number
    wide: dict[str, int] = {}
    ends, supers = [], {}
    for s in sums:
        B, b, k, r = step(s)
        # a power of two, so that alphas share super-blocks and their window
        S = 1 << max(0, int(SUPER_DECAY / (B * _rate(s.alpha))).bit_length() - 1)
        if S > 1:
            wide[s.name] = S
            supers[s.name] = f"_sup{B}_{S}"
            ends.append(f"CASE WHEN {k} = {B - 1} THEN _loc_{s.name} * power({r}D, -({b} % {S}) * {B}) END AS _end_{s.name}")
    for column in sorted(set(supers.values())):
        B, S = column.removeprefix("_sup").split("_")
        ends.append(f"floor(_blk{B} / {S}) AS {column}")
    if wide:
        df = df.selectExpr("*", *ends)
        df = df.selectExpr("*", *[f"coalesce(sum(_end_{n}) OVER (PARTITION BY {by}, {supers[n]} ORDER BY {order} "
                                  f"ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0D) AS _in_{n}" for n in wide])

    helpers = {c for B in blocks for c in blocks[B]} | {f"_loc_{s.name}" for s in sums} \
        | {f"_{p}_{n}" for n in wide for p in ("end", "in", "own")} \
        | set(supers.values())
    owns, outs = [], []
    for s in sums:
        B, b, k, r = step(s)
        before = f"({w} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
        if s.name in wide:
            S = wide[s.name]
            # N without what lies before the super-block
            owns.append(f"_loc_{s.name} + power({r}D, {k} + 1 + ({b} % {S} - 1) * {B}) * _in_{s.name} AS _own_{s.name}")
            last = f"CASE WHEN {k} = {B - 1} AND {b} % {S} = {S - 1} THEN _own_{s.name} END"
            outs.append(f"_own_{s.name} + power({r}D, {k} + 1 + ({b} % {S}) * {B}) * coalesce(last({last}, true) OVER {before}, 0D) AS {s.name}")
        else:
            last = f"CASE WHEN {k} = {B - 1} THEN _loc_{s.name} END"
            outs.append(f"_loc_{s.name} + power({r}D, {k} + 1) * coalesce(last({last}, true) OVER {before}, 0D) AS {s.name}")
    if owns:
        df = df.selectExpr("*", *owns)
    return df.selectExpr(*_keep(df, helpers), *outs)


@dataclass(frozen=True)
class Ewm:
    """An EWM series over SQL expression ``x``: ``kind`` is 'rma' (adjusted mean,
    alpha = 1/n) or 'ema' (alpha = 2/(n+1), unadjusted, seeded with the mean of
    the first n values). ``valid`` is the SQL test for "x is observed"; series that
    pass the same test share their observation count and (per alpha) their
    denominator sum."""
    name: str
    x: str
    n: int
    kind: str
    valid: str | None = None

    @property
    def alpha(self) -> float:
        return 1.0 / self.n if self.kind == "rma" else 2.0 / (self.n + 1)

    @property
    def observed(self) -> str:
        return self.valid or f"({self.x}) IS NOT NULL"


@dataclass(frozen=True)
class Batch:
    """What a batch of EWM series needs: one count per test for "observed" (test -> column), the seeds'
    SQL, the weighted sums, and the SQL of the series out of them."""
    seen: dict[str, str]
    seeds: list[str]
    sums: list[Sum]
    outs: list[str]
    helpers: set[str]


def ewm_batch(series: list[Ewm], by: str = SYMBOL, order: str = DATE) -> Batch:
    w = f"PARTITION BY {by} ORDER BY {order}"
    seen_of: dict[str, str] = {}
    den_of: dict[tuple[str, float], str] = {}
    seeds: list[str] = []
    sums: list[Sum] = []
    outs: list[str] = []
    for e in series:
        seen = seen_of.setdefault(e.observed, f"_seen{len(seen_of)}")
        if e.kind == "rma":
            sums.append(Sum(f"_num_{e.name}", f"CASE WHEN {e.observed} THEN {e.x} END", e.alpha))
            key = (e.observed, e.alpha)
            if key not in den_of:
                den_of[key] = f"_den{len(den_of)}"
                sums.append(Sum(den_of[key], f"CASE WHEN {e.observed} THEN 1D END", e.alpha))
            outs.append(f"CASE WHEN {seen} >= {e.n} THEN try_divide(_num_{e.name}, {den_of[key]}) END AS {e.name}")
        else:
            seeds.append(f"avg({e.x}) OVER ({w} ROWS BETWEEN {e.n - 1} PRECEDING AND CURRENT ROW) "
                         f"AS _seed_{e.name}")
            y = (f"CASE WHEN NOT ({e.observed}) THEN NULL WHEN {seen} = {e.n} "
                 f"THEN _seed_{e.name} / {e.alpha!r}D WHEN {seen} > {e.n} THEN {e.x} ELSE 0D END")
            sums.append(Sum(f"_num_{e.name}", y, e.alpha))
            outs.append(f"CASE WHEN {seen} >= {e.n} THEN {e.alpha!r}D * _num_{e.name} END AS {e.name}")
    helpers = {s.name for s in sums} | set(seen_of.values()) | {f"_seed_{e.name}" for e in series}
    return Batch(seen_of, seeds, sums, outs, helpers)


def ewm_columns(df: DataFrame, series: list[Ewm], by: str = SYMBOL, order: str = DATE,
                idx: str = IDX) -> DataFrame:
    """Compute several EWM series in one batch of window steps.

    * rma: weights r^(t-j) over observed values; null until n values are observed;
      a null input row carries the previous mean.
    * ema: EMA_t = alpha x_t + r EMA_(t-1) from the n-th observed value, seeded with
      the mean of the first n observed values; equal to alpha * N(y) with y =
      seed/alpha at the seed row and 0 before. The input may start with nulls but
      must have none after its first value (true for close and for MACD).
    """
    run = f"PARTITION BY {by} ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    batch = ewm_batch(series, by, order)
    counts = [f"sum(CASE WHEN {test} THEN 1 ELSE 0 END) OVER ({run}) AS {name}" for test, name in batch.seen.items()]
    df = ewm_sums(df.selectExpr("*", *counts, *batch.seeds), batch.sums, by, order, idx)
    return df.selectExpr(*_keep(df, batch.helpers), *batch.outs)


def rma(df: DataFrame, out: str, x: str, n: int, **kw) -> DataFrame:
    return ewm_columns(df, [Ewm(out, x, n, "rma")], **kw)


def seeded_ema(df: DataFrame, out: str, x: str, n: int, **kw) -> DataFrame:
    return ewm_columns(df, [Ewm(out, x, n, "ema")], **kw)
