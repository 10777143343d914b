"""Request quota, cost and search budget."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from vitrina import defaults
from vitrina.operators.lookups import attach
from vitrina.operators.ordering import running, running_over, with_order


def _price(tier: str, pricing: dict) -> tuple[int, float]:
    entry = pricing["text_search"][tier]
    paid = entry["first_paid_band"]
    return int(entry["free_per_month"]), float(paid["rate_per_1000"]) if paid else 0.0


def free_cap(tier: str = "enterprise", pricing: dict = defaults.PRICING) -> int:
    return _price(tier, pricing)[0]


def billable(requests: Column, free: int) -> Column:
    return F.greatest(F.lit(0).cast("long"), requests - F.lit(free))


def estimate_cost(
    requests: Column,
    tier: str = "enterprise",
    free_remaining: int | None = None,
    pricing: dict = defaults.PRICING,
) -> Column:
    """Cost in USD of the requests beyond the free ones, to four decimals."""
    cap, rate = _price(tier, pricing)
    free = cap if free_remaining is None else free_remaining
    return F.bround(billable(requests, free) / F.lit(1000.0) * F.lit(rate), 4)


def quota(df: DataFrame, requests: str, tier: str, pricing: dict = defaults.PRICING) -> DataFrame:
    """Add free_cap, remaining, within_free and est_cost_usd for a request count."""
    cap = free_cap(tier, pricing)
    used = F.col(requests)
    return df.withColumns(
        {
            "free_cap": F.lit(cap).cast("long"),
            "remaining": F.greatest(F.lit(0).cast("long"), F.lit(cap) - used),
            "within_free": used <= cap,
            "est_cost_usd": estimate_cost(used, tier, pricing=pricing),
        }
    )


def monthly_usage(
    ledger: DataFrame,
    tier: str = "enterprise",
    ts: str = "run_ts",
    period: str = "yyyy-MM",
    pricing: dict = defaults.PRICING,
) -> DataFrame:
    """Requests and quota state per month of a usage ledger (run_ts, requests)."""
    months = ledger.groupBy(F.date_format(ts, period).alias("month")).agg(
        F.sum("requests").alias("month_requests")
    )
    return quota(months, "month_requests", tier, pricing)


def running_quota(
    ledger: DataFrame,
    order: Sequence[str],
    tier: str = "enterprise",
    ts: str = "run_ts",
    period: str = "yyyy-MM",
    pricing: dict = defaults.PRICING,
) -> DataFrame:
    """Month-to-date requests and quota state after each run."""
    dated = ledger.withColumn("month", F.date_format(ts, period))
    summed = running(dated, ["month"], order, {"month_requests": "requests"})
    return quota(summed, "month_requests", tier, pricing)


def with_budget(
    df: DataFrame,
    run: Sequence[str],
    order: Sequence[str],
    max_usd: float,
    key: str | None = None,
    cost: str = "cost",
) -> DataFrame:
    """Add search_state: paid or refused, and with a ``key`` also repeat.

    A search is allowed while the money spent plus the last real cost stays
    within the limit. A refusal changes nothing, so everything after the first
    one is refused too. A row whose key was paid for earlier in the run costs
    nothing and is not refused.
    """
    run, order = list(run), list(order)
    placed = with_order(df, *run, *order, name="_seq")
    if key is None:
        placed = placed.withColumns({"_repeat": F.lit(False), "_paid_at": F.lit(None).cast("long")})
    else:
        first_paid = (
            placed.where(F.col(cost) > 0).groupBy(*run, key).agg(F.min("_seq").alias("_paid_at"))
        )
        placed = attach(placed, first_paid, [*run, key]).withColumn(
            "_repeat", F.coalesce(F.col("_seq") > F.col("_paid_at"), F.lit(False))
        )
    charged = placed.withColumn(
        "_charge", F.when(F.col("_repeat"), F.lit(0.0)).otherwise(F.col(cost))
    ).withColumn("_real", F.when(F.col("_charge") > 0, F.col("_charge")))

    state = running_over(
        charged, run, "_seq", {"_spent": "_charge"}, {"_last": "_real"}, strictly_before=True
    )
    next_cost = F.coalesce("_last", F.lit(defaults.FIRST_SEARCH_COST))
    fits = F.col("_spent") + next_cost <= F.lit(max(0.0, max_usd) + defaults.BUDGET_SLACK)
    stopped = state.where(~fits & ~F.col("_repeat"))
    if run:
        first_stop = stopped.groupBy(*run).agg(F.min("_seq").alias("_stop"))
        limited = attach(placed, first_stop, run)
    else:
        limited = placed.withColumn("_stop", stopped.agg(F.min("_seq")).scalar())

    before_stop = F.col("_stop").isNull() | (F.col("_seq") < F.col("_stop"))
    known = F.col("_repeat") & (
        F.col("_stop").isNull() | F.coalesce(F.col("_paid_at") < F.col("_stop"), F.lit(False))
    )
    return limited.withColumn(
        "search_state",
        F.when(known, "repeat").when(before_stop, "paid").otherwise("refused"),
    ).drop("_seq", "_paid_at", "_repeat", "_stop")


def budget_report(
    searched: DataFrame, run: Sequence[str], order: Sequence[str], max_usd: float, cost: str = "cost"
) -> DataFrame:
    """Per run: spent, cap, pending searches and what they would cost."""
    paid = F.col("search_state") == "paid"
    real = F.when(paid & (F.col(cost) > 0), F.struct(*order))
    totals = searched.groupBy(*run).agg(
        F.coalesce(F.sum(F.when(paid, F.col(cost))), F.lit(0.0)).alias("spent"),
        F.count_if(F.col("search_state") == "refused").alias("pending"),
        F.coalesce(F.max_by(F.col(cost), real), F.lit(defaults.FIRST_SEARCH_COST)).alias("_last"),
    )
    extra = F.bround(F.col("pending") * F.col("_last") + defaults.EXTRA_MARGIN, 2)
    return totals.withColumns({"cap": F.lit(float(max_usd)), "est": extra}).drop("_last")
