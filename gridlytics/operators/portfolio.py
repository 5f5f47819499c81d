"""Month-end credit-portfolio facts and scores.

Every table is first brought to its natural grain, one row per product and month, so joins are
key-to-key and a busy product contributes at most one row per month.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlytics.functions.columns import band, flag, month_end, pick, ratio, sentinel_to_null
from gridlytics.operators.stats import grouped_ols, principal_axis, project_axis
from gridlytics.sources.staging import staged

# Product types of the two lines and the residential category.
GAS, CREDIT, RESIDENTIAL = 7014, 7055, 1
# Program of a refinancing, suspension type counted, process type and programs of charges.
REFINANCING_PROGRAM = "GCNED"
SUSPENSION_TYPE = 2
CHARGE_PROCESS, CHARGE_EXCLUDED = "A", (20, 700, 2016)
# Longest suspension that still counts, per interval in months.
MAX_SUSPENDED_DAYS = {6: 183, 12: 366}
SEGMENT_NAMES = ("Pesimo", "Malo", "Regular", "Bueno", "Excelente")

KEYS = ["product_id", "product_type", "interval"]


def eligible_products(products: DataFrame, as_of) -> DataFrame:
    return products.filter(
        (F.col("category") == RESIDENTIAL)
        & F.col("product_type").isin(GAS, CREDIT)
        & (F.col("entry_date") <= F.lit(month_end(as_of, -1)))
    )


def portfolio_base(products: DataFrame, closes: DataFrame, as_of, intervals: Sequence[int] = (6, 12)) -> DataFrame:
    """Product × interval × month-end rows of the ``n`` months up to the last close.

    The interval list is exploded from the close date of a row, after one equi-join, so no range join
    and no cross join are needed; the date bounds are literals and reach the scan.
    """
    close = month_end(as_of, -1)
    starts = {n: month_end(close, -(n - 1)) for n in intervals}
    window = closes.filter(
        F.col("close_date").between(F.lit(min(starts.values())), F.lit(close))
        & (F.col("close_date") == F.last_day("close_date"))
    ).drop("product_type")
    member = F.array_compact(
        F.array(*[F.when(F.col("close_date") >= F.lit(start), F.lit(int(n))) for n, start in starts.items()])
    )
    owners = eligible_products(products, as_of).select("product_id", "product_type")
    return window.join(owners, "product_id").select(
        "close_date", "product_id", "product_type", "contract_id", "arrears_days",
        F.explode(member).alias("interval"), flag(F.col("written_off") > 0).alias("written_off"),
    )


def writeoff_at_close(products: DataFrame, closes: DataFrame, as_of, intervals: Sequence[int] = (6, 12)) -> DataFrame:
    """Write-off flag at the last close, per product and interval."""
    last = portfolio_base(products, closes, as_of, intervals).filter(F.col("close_date") == F.lit(month_end(as_of, -1)))
    return last.select("close_date", *KEYS, "written_off")


def monthly_total(df: DataFrame, value: str) -> DataFrame:
    return df.groupBy("product_id", "close_date").agg(F.sum(value).alias(value))


def _with_payments(base: DataFrame, billing: DataFrame, payments: DataFrame) -> DataFrame:
    out = base
    for table, value in ((billing, "billed"), (payments, "paid")):
        out = out.join(monthly_total(table, value), ["product_id", "close_date"], "left")
    return out


def _zero(col: str) -> Column:
    return F.coalesce(F.col(col), F.lit(0))


def payment_behaviour(base: DataFrame, billing: DataFrame, payments: DataFrame) -> DataFrame:
    """Billed and paid amounts over the interval; a month without rows counts as 0."""
    return _with_payments(base, billing, payments).groupBy(*KEYS).agg(
        F.sum(_zero("billed")).alias("billed"), F.sum(_zero("paid")).alias("paid")
    )


def refinancings(base: DataFrame, deferred: DataFrame) -> DataFrame:
    """Distinct financing codes entered in a month of the interval, current rows of the refinancing program only."""
    entered = deferred.filter((F.col("is_current") == 1) & (F.col("program") == REFINANCING_PROGRAM)).select(
        "product_id", F.last_day("entry_date").alias("close_date"), "financing_code"
    ).distinct()
    keys = base.select("close_date", *KEYS).distinct()
    return keys.join(entered, ["product_id", "close_date"]).groupBy(*KEYS).agg(
        F.count_distinct("financing_code").alias("refinancings")
    )


def interval_bounds(base: DataFrame) -> DataFrame:
    return base.groupBy(*KEYS).agg(
        F.max("close_date").alias("upper"), F.min(F.trunc("close_date", "month")).alias("lower")
    )


def suspensions(bounds: DataFrame, suspended: DataFrame) -> DataFrame:
    """Suspensions touching the interval and the suspended days inside it.

    An open suspension runs to the end of the interval; overlapping suspensions are both counted;
    a reconnection recorded before its suspension gives 0 days.
    """
    applied, back = F.col("applied_date"), F.col("reconnected_date")
    rows = suspended.filter(F.col("suspension_type") == SUSPENSION_TYPE).select(
        "product_id", "suspension_id", "applied_date", sentinel_to_null("reconnected_date").alias("reconnected_date")
    )
    lower, upper = F.col("lower"), F.col("upper")
    before = (applied <= lower) & (back.isNull() | (back > lower))
    during = (applied > lower) & (applied <= upper)
    start = F.greatest(applied, lower)
    end = F.when(back < upper, back).otherwise(upper)
    days = F.greatest(F.datediff(end, start), F.lit(0))
    touched = bounds.join(rows, "product_id").filter(before | during)
    found = touched.groupBy(*KEYS).agg(
        F.count_distinct("suspension_id").alias("suspensions"), F.sum(days).alias("suspended_days")
    )
    return bounds.select(*KEYS).join(found, KEYS, "left").select(
        *KEYS, _zero("suspensions").alias("suspensions"), "suspended_days"
    )


def desync_days(base: DataFrame) -> DataFrame:
    """Largest monthly gap between the arrears of the credit line and of the gas product of a contract."""

    def worst(kind: int) -> Column:
        return F.max(F.when(F.col("product_type") == kind, F.col("arrears_days")))

    monthly = base.groupBy("close_date", "contract_id", "interval").agg((worst(CREDIT) - worst(GAS)).alias("gap"))
    return monthly.groupBy("contract_id", "interval").agg(F.max("gap").alias("desync_days"))


def _aging(prefix: str = "e") -> list[Column]:
    days = F.col("arrears_days")
    buckets = {"30": days.between(1, 30), "60": days.between(31, 60), "90": days.between(61, 90), "m90": days > 90}
    return [F.sum(flag(hit)).alias(f"{prefix}{name}") for name, hit in buckets.items()]


def aging_buckets(base: DataFrame) -> DataFrame:
    """Month-ends per arrears bucket and months with a written-off balance."""
    return base.groupBy(*KEYS, "contract_id").agg(*_aging(), F.sum(_zero("written_off")).alias("written_off_months"))


def scoring_fact(
    products: DataFrame, closes: DataFrame, billing: DataFrame, payments: DataFrame,
    deferred: DataFrame, suspended: DataFrame, as_of, intervals: Sequence[int] = (6, 12),
) -> DataFrame:
    """One row per product and interval with aging, payments, refinancings, suspensions, write-off and desync.

    Aging, payments, write-off at the close and the window bounds share one aggregate over the base; only
    refinancings and desync read it again. Products without a row at the last close are left out.
    """
    close = month_end(as_of, -1)
    base = portfolio_base(products, closes, as_of, intervals)
    at_close = F.max(F.when(F.col("close_date") == F.lit(close), F.col("written_off")))
    per_contract = _with_payments(base, billing, payments).groupBy(*KEYS, "contract_id").agg(
        *_aging(),
        F.sum(_zero("billed")).alias("billed"), F.sum(_zero("paid")).alias("paid"),
        F.sum("written_off").alias("written_off_months"), at_close.alias("written_off"),
        F.max("close_date").alias("upper"), F.min(F.trunc("close_date", "month")).alias("lower"),
    )
    desync = per_contract.join(desync_days(base), ["contract_id", "interval"], "left")
    gap = F.when(F.col("product_type") == CREDIT, F.col("desync_days"))
    summary = desync.groupBy(*KEYS).agg(
        *[F.max(c).alias(c) for c in ("e30", "e60", "e90", "em90", "written_off_months", "written_off", "upper")],
        F.min("lower").alias("lower"), F.sum("billed").alias("billed"), F.sum("paid").alias("paid"),
        F.max(gap).alias("desync_days"),
    ).filter(F.col("written_off").isNotNull())
    out = summary.join(refinancings(base, deferred), KEYS, "left").join(
        suspensions(summary.select(*KEYS, "lower", "upper"), suspended), KEYS, "left"
    )
    counts = ("e30", "e60", "e90", "em90", "refinancings", "suspensions", "suspended_days",
              "written_off", "written_off_months", "desync_days")
    return out.select(
        *KEYS, *[_zero(c).cast("int").alias(c) for c in counts],
        F.col("billed").cast("bigint").alias("billed"), F.col("paid").cast("bigint").alias("paid"),
    )


def score_variables(fact: DataFrame, max_days: dict[int, int] | None = None) -> DataFrame:
    """Payment, arrears, refinancing, suspension, write-off and desync variables of a score.

    Global extremes come from an aggregate: scalar subqueries for the whole table, a join on the
    few intervals otherwise. A zero range gives NULL. The fact is read three times, so it is staged once.
    """
    caps = max_days or MAX_SUSPENDED_DAYS
    fact = staged(fact.filter(F.col("billed") != 0))
    cap = F.coalesce(*[F.when(F.col("interval") == n, F.lit(d)) for n, d in caps.items()])
    fact = fact.withColumn("suspended_days", F.least(F.col("suspended_days"), F.coalesce(cap, F.col("suspended_days"))))
    extremes = fact.agg(F.min("refinancings").alias("lo"), F.max("refinancings").alias("hi"))
    lo, hi = extremes.select("lo").scalar(), extremes.select("hi").scalar()
    limits = fact.groupBy("interval").agg(
        F.min("suspended_days").alias("_slo"), F.max("suspended_days").alias("_shi"),
        F.max("written_off_months").alias("_w"),
    )
    paid_share = F.col("paid") / F.col("billed")
    weighted = 0.3 * F.col("e30") + 0.5 * F.col("e60") + 0.8 * F.col("e90") + F.col("em90")
    gap = F.col("desync_days")
    # One row per interval of the list, so the limits are broadcast and the fact is not shuffled on a few hot keys.
    return fact.join(F.broadcast(limits), "interval").select(
        *KEYS,
        F.when(F.col("paid") > F.col("billed"), 1.0).when(paid_share < 0, 0.0).otherwise(paid_share).alias("v_payment"),
        (1 - weighted / F.col("interval")).alias("v_arrears"),
        (1 - ratio(F.col("refinancings") - lo, hi - lo)).alias("v_refinancing"),
        F.when(
            F.col("product_type") == GAS,
            1 - ratio(F.col("suspended_days") - F.col("_slo"), F.col("_shi") - F.col("_slo")),
        ).alias("v_suspension"),
        ratio("written_off_months", "_w").alias("v_writeoff"),
        F.when(gap < 0, 1.0).when(gap > 60, 0.0).otherwise(1 - gap / 60).alias("v_desync"),
    )


SLICE = ["product_type", "interval"]


def _score_inputs(variables: DataFrame) -> tuple[DataFrame, list[str]]:
    """The fourth variable is suspensions for gas and desync for the credit line."""
    fourth = F.when(F.col("product_type") == GAS, F.col("v_suspension")).otherwise(F.col("v_desync"))
    cols = ["v_payment", "v_arrears", "v_refinancing", "v_fourth"]
    # A variable without range in its slice is NULL for all rows; it then carries no weight.
    return variables.withColumn("v_fourth", F.coalesce(fourth, F.lit(1.0))).fillna(1.0, subset=["v_refinancing"]), cols


def pca_score(variables: DataFrame, oriented: str = "v_arrears") -> DataFrame:
    """First principal component of the standardised variables per product type and interval, scaled to [0, 1].

    The score rises with the arrears variable and is reduced by the write-off share. Rows meet only
    sums, one small join per slice and an expression; no slice is gathered anywhere.
    """
    rows, cols = _score_inputs(staged(variables))
    axis = principal_axis(rows, SLICE, cols, oriented)
    # Two product types times the interval list: a handful of rows, broadcast for the same reason.
    projected = rows.join(F.broadcast(axis), SLICE).withColumn("component", project_axis(cols)).drop("mean", "sd", "axis")
    limits = projected.groupBy(*SLICE).agg(F.min("component").alias("_lo"), F.max("component").alias("_hi"))
    scaled = F.try_divide(F.col("component") - F.col("_lo"), F.col("_hi") - F.col("_lo"))
    out = projected.join(F.broadcast(limits), SLICE).withColumn("scaled", scaled).drop("_lo", "_hi")
    return out.withColumn("score", (1 - F.coalesce(F.col("v_writeoff"), F.lit(0.0))) * F.col("scaled"))


def score_weights(scored: DataFrame) -> DataFrame:
    """Weights of the raw variables implied by the scaled component, by least squares per slice."""
    cols = ["v_payment", "v_arrears", "v_refinancing", "v_fourth"]
    fit = grouped_ols(scored, SLICE, cols, "scaled")
    return fit.select(
        *SLICE, *[F.col("coefficients")[i].alias(c.replace("v_", "w_")) for i, c in enumerate(cols)],
        F.col("coefficients")[4].alias("intercept"),
    )


def segment_code(score: str = "score") -> Column:
    s = F.col(score)
    return F.when(s <= 0.55, 0).when(s <= 0.7, 1).when(s <= 0.85, 2).when(s < 1, 3).when(s == 1, 4)


def score_segments(scored: DataFrame, score: str = "score") -> DataFrame:
    return scored.withColumn("segment", segment_code(score)).withColumn("segment_name", pick(SEGMENT_NAMES, F.col("segment")))


def segment_counts(segmented: DataFrame) -> DataFrame:
    return segmented.groupBy(*SLICE, "segment_name").agg(F.count("*").alias("n"))


def arrears_band(col: str) -> Column:
    return band(col, [30, 60, 90], ["E30", "E60", "E90", "EM90"])
