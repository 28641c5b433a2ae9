"""Leakage-free features of a dense panel: each example sees its own and earlier quarters only.

All company windows share one hash partitioning by entity; the market is a table with one row per
quarter. ``n`` is the length of the observed history, ``t`` the origin quarter, ``T`` the target."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

# Feature names in model order.
COMPANY_FEATURES = (
    "history_quarters", "history_mean", "history_active_rate", "history_max",
    "cases_recent1", "cases_recent2", "cases_recent3", "cases_recent4",
    "cases_last4", "active_last4", "recent_change", "recent_slope",
    "cases_previous4", "has_previous_year", "annual_change", "annual_growth", "inactive_quarters",
    "same_quarter_last_year", "same_quarter_mean", "same_quarter_active_rate",
    "same_quarter_observations",
)
MARKET_FEATURES = (
    "market_recent_cases", "market_last4_cases", "market_quarter_change", "market_annual_growth",
    "market_has_previous_year", "market_active_companies", "market_company_change",
    "market_season_mean", "company_market_share",
)
TARGET_FEATURES = ("horizon", "target_q1", "target_q2", "target_q3", "target_q4")
FEATURES = COMPANY_FEATURES + MARKET_FEATURES + TARGET_FEATURES

HORIZONS = (1, 2)
MIN_HISTORY = 4
YEAR = 4
# Least-squares slope weights of four consecutive quarters, oldest first.
SLOPE_WEIGHTS = (-1.5, -0.5, 0.5, 1.5)


def timeline(entity: str = "EMPLOYER_ID", period: str = "quarter") -> WindowSpec:
    return Window.partitionBy(entity).orderBy(period)


def _double(column: Column) -> Column:
    return column.cast("double")


def _count(condition: Column, w: WindowSpec) -> Column:
    return F.sum(condition.cast("long")).over(w)


def history_length(w: WindowSpec) -> Column:
    return F.row_number().over(w)


def expanding_stats(metric: Column, w: WindowSpec) -> dict[str, Column]:
    past = w.rowsBetween(Window.unboundedPreceding, 0)
    n = F.count(metric).over(past)
    return {
        "history_quarters": n,
        "history_mean": _double(F.sum(metric).over(past)) / n,
        "history_active_rate": _double(_count(metric > 0, past)) / n,
        "history_max": F.max(metric).over(past),
    }


def lags(metric: Column, w: WindowSpec, n: int = 4) -> dict[str, Column]:
    """``cases_recent1`` is the origin quarter itself."""
    return {f"cases_recent{k + 1}": F.lag(metric, k).over(w) for k in range(n)}


def trailing_stats(metric: Column, w: WindowSpec) -> dict[str, Column]:
    last4 = w.rowsBetween(-3, 0)
    has_year = history_length(w) >= 2 * YEAR
    return {
        "cases_last4": F.sum(metric).over(last4),
        "active_last4": _count(metric > 0, last4),
        "cases_previous4": F.when(has_year, F.sum(metric).over(w.rowsBetween(-7, -4))).otherwise(-1),
        "has_previous_year": has_year.cast("int"),
    }


def recent_trend(rows: DataFrame) -> dict[str, Column]:
    recent = [F.col(f"cases_recent{k}") for k in (4, 3, 2, 1)]
    slope = sum((F.lit(weight) * value for weight, value in zip(SLOPE_WEIGHTS, recent)), F.lit(0.0)) / 5
    return {"recent_change": recent[3] - recent[2], "recent_slope": slope}


def annual_trend() -> dict[str, Column]:
    change = F.col("cases_last4") - F.col("cases_previous4")
    known = F.col("has_previous_year") == 1
    return {
        "annual_change": F.when(known, change).otherwise(0),
        "annual_growth": F.when(known, _double(change) / (F.col("cases_previous4") + 1)).otherwise(0.0),
    }


def periods_since_active(metric: Column, period: str, w: WindowSpec) -> Column:
    past = w.rowsBetween(Window.unboundedPreceding, 0)
    return F.col(period) - F.max(F.when(metric > 0, F.col(period))).over(past)


def company_features(panel: DataFrame, metric: str = "LCA_CASES", entity: str = "EMPLOYER_ID", period: str = "quarter") -> DataFrame:
    """History, lag, trend and activity features of every company quarter, whatever its history."""
    w, c = timeline(entity, period), F.col(metric)
    rows = panel.withColumns(
        {
            **expanding_stats(c, w),
            **lags(c, w),
            **trailing_stats(c, w),
            "inactive_quarters": periods_since_active(c, period, w),
        }
    )
    return rows.withColumns(recent_trend(rows)).withColumns(annual_trend())


def season_features(
    rows: DataFrame,
    horizons: Sequence[int] = HORIZONS,
    metric: str = "LCA_CASES",
    entity: str = "EMPLOYER_ID",
    period: str = "quarter",
) -> DataFrame:
    """One row per horizon with the statistics of the target's season among quarters up to t.

    Each of the four seasons has its own expanding totals on the company's timeline, and a target
    picks the ones of its season: no second sort order, no join."""
    c, w = F.col(metric), timeline(entity, period)
    past = w.rowsBetween(Window.unboundedPreceding, 0)

    def totals(season: int) -> Column:
        inside = F.col(period) % YEAR == season
        return F.struct(
            F.sum(inside.cast("long")).over(past).alias("n"),
            F.sum(F.when(inside, c).otherwise(0)).over(past).alias("cases"),
            F.sum((inside & (c > 0)).cast("long")).over(past).alias("active"),
        )

    held = rows.withColumns(
        {
            "seasons": F.array(*[totals(season) for season in range(YEAR)]),
            **{f"last_year_{h}": F.lag(c, YEAR - h).over(w) for h in horizons},
        }
    )
    choices = F.array(*[
        F.struct(
            F.lit(h).alias("horizon"),
            (F.col(period) + h).alias("target_quarter"),
            F.col(f"last_year_{h}").alias("last"),
            F.col("seasons")[(F.col(period) + h) % YEAR].alias("s"),
        )
        for h in horizons
    ])
    spread = held.select(*rows.columns, F.inline(choices))
    target, s = F.col("target_quarter"), F.col("s")
    # A season not seen yet has no statistics, as has a target whose T-4 lies before the history.
    known = F.col("last").isNotNull()
    return spread.withColumns(
        {
            "same_quarter_observations": F.when(known, s["n"]),
            "same_quarter_last_year": F.col("last"),
            "same_quarter_mean": F.when(known, _double(s["cases"]) / s["n"]),
            "same_quarter_active_rate": F.when(known, _double(s["active"]) / s["n"]),
            **{f"target_q{k + 1}": (target % YEAR == k).cast("int") for k in range(YEAR)},
        }
    ).drop("last", "s")


def market_totals(panel: DataFrame, metric: str = "LCA_CASES", period: str = "quarter") -> DataFrame:
    return panel.groupBy(period).agg(
        F.sum(metric).alias("market_cases"), F.count_if(F.col(metric) > 0).alias("market_companies")
    )


def market_features(market: DataFrame, horizons: Sequence[int] = HORIZONS, period: str = "quarter") -> DataFrame:
    """Market features per (origin, horizon) from one row per quarter, companies of any history.

    The input is the calendar axis, tens of rows, so its windows need no partitioning."""
    w = Window.partitionBy(F.lit(0)).orderBy(period)
    m, k = F.col("market_cases"), F.col("market_companies")
    m1, k1 = F.lag(m).over(w), F.lag(k).over(w)
    last4, previous4 = F.sum(m).over(w.rowsBetween(-3, 0)), F.sum(m).over(w.rowsBetween(-7, -4))
    has_year = F.row_number().over(w) >= 2 * YEAR
    season = Window.partitionBy(F.col(period) % YEAR).orderBy(period).rowsBetween(Window.unboundedPreceding, 0)
    rows = market.select(
        period,
        F.row_number().over(w).alias("market_quarters"),
        m.alias("market_recent_cases"),
        last4.alias("market_last4_cases"),
        (_double(m - m1) / (m1 + 1)).alias("market_quarter_change"),
        F.when(has_year, _double(last4 - previous4) / (previous4 + 1)).otherwise(0.0).alias("market_annual_growth"),
        has_year.cast("int").alias("market_has_previous_year"),
        k.alias("market_active_companies"),
        (_double(k - k1) / (k1 + 1)).alias("market_company_change"),
        (_double(F.sum(m).over(season)) / F.count(m).over(season)).alias("season_mean"),
    )
    seen = rows.withColumns({f"mean_{h}": F.lag("season_mean", YEAR - h).over(w) for h in horizons})
    choices = F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"mean_{h}").alias("mean")) for h in horizons])
    spread = seen.withColumn("choice", F.explode(choices))
    return spread.withColumns(
        {"horizon": F.col("choice.horizon"), "market_season_mean": F.col("choice.mean")}
    ).drop("choice", "season_mean", *[f"mean_{h}" for h in horizons])


def with_market(rows: DataFrame, market: DataFrame, period: str = "quarter") -> DataFrame:
    """Join market features by (origin, horizon); the market side has two rows per quarter."""
    joined = rows.join(F.broadcast(market), [period, "horizon"])
    share = _double(F.col("cases_last4")) / F.greatest(F.col("market_last4_cases"), F.lit(1))
    return joined.withColumn("company_market_share", share)


def with_outcomes(panel: DataFrame, horizons: Sequence[int] = HORIZONS, metric: str = "LCA_CASES", entity: str = "EMPLOYER_ID", period: str = "quarter") -> DataFrame:
    """Counts ``h`` quarters ahead; null beyond the last observed quarter, never zero."""
    w = timeline(entity, period)
    return panel.withColumns({f"outcome_{h}": F.lead(metric, h).over(w) for h in horizons})


def build_examples(
    panel: DataFrame,
    origins: Sequence[int] | None = None,
    metric: str = "LCA_CASES",
    entity: str = "EMPLOYER_ID",
    name: str = "EMPLOYER_NAME",
    period: str = "quarter",
    horizons: Sequence[int] = HORIZONS,
) -> DataFrame:
    """One row per company, origin with at least four quarters of history, and horizon."""
    base = panel.select(entity, name, period, metric)
    rows = season_features(
        company_features(with_outcomes(base, horizons, metric, entity, period), metric, entity, period),
        horizons, metric, entity, period,
    )
    eligible = rows.where(F.col("history_quarters") >= MIN_HISTORY)
    if origins is not None:
        eligible = eligible.where(F.col(period).isin(list(origins)))
    market = market_features(market_totals(panel, metric, period), horizons, period)
    joined = with_market(eligible, market, period).where(F.col("market_quarters") >= MIN_HISTORY)
    cases = F.lit(None)
    for h in horizons:
        cases = F.when(F.col("horizon") == h, F.col(f"outcome_{h}")).otherwise(cases)
    labeled = joined.withColumn("target_cases", cases.cast("double"))
    return labeled.select(
        entity,
        name,
        F.col(period).alias("origin"),
        "target_quarter",
        *[F.col(feature).cast("float").alias(feature) for feature in FEATURES],
        "target_cases",
        (F.col("target_cases") > 0).cast("double").alias("target_active"),
    )
