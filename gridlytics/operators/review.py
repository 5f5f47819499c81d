"""Meter-reading review rules. All rules are column expressions over one row; no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlytics.functions.columns import clean_comment, flag, parse_decimal, ratio, sentinel_to_null

# Work-order types that can justify a consumption, missing-reading markers, default bands.
JUSTIFYING_TYPES = (12620, 12526, 10546, 12521, 12137, 12190, 12187, 12690, 12527, 10559, 12688, 12689)
NO_READING, DEFAULT_LOWER, DEFAULT_UPPER = -10, -300, 300
JUSTIFIED_DEVIATION, UNKNOWN_DEVIATION = -12487531478, 1000
# Value given to a missing number.
TEXT_DEFAULTS = {
    "last_valid_reading": 0.0, "local_avg": 0.0, "reading": -1000.0, "previous_reading": -1000.0,
    "two_months_reading": -1000.0, "product_avg": -100.0, "estimated": None, "order_type_reading": None,
}
YES, NO = "Yes", "NO"


def prepare(df: DataFrame) -> DataFrame:
    """Numbers from text with a decimal comma, defaults for missing values, one NULL for missing dates."""
    numbers = {}
    for name, default in TEXT_DEFAULTS.items():
        if name in df.columns:
            value = parse_decimal(name)
            numbers[name] = value if default is None else F.coalesce(value, F.lit(default))
    others = {
        "work_type": F.coalesce(F.col("work_type"), F.lit(0)),
        "last_cause": F.coalesce(F.col("last_cause"), F.lit(0)),
        "first_valid_reading": F.coalesce(F.col("first_valid_reading").cast("double"), F.lit(0.0)),
        "lower_band": F.coalesce(F.col("lower_band"), F.lit(DEFAULT_LOWER)),
        "upper_band": F.coalesce(F.col("upper_band"), F.lit(DEFAULT_UPPER)),
        "executed_on": sentinel_to_null("executed_on"),
        "last_valid_on": sentinel_to_null("last_valid_on"),
    }
    if "comment" in df.columns:
        others["comment"] = clean_comment("comment")
    return df.withColumns({**numbers, **others})


def monotone() -> Column:
    """Rule 0: the reading does not run backwards."""
    last = F.col("last_valid_reading")
    return F.when(last == NO_READING, 0).otherwise(flag(last <= F.col("first_valid_reading")))


def deviation() -> Column:
    """Relative deviation from the product average; the volume itself when the average is 0."""
    return F.coalesce(ratio(F.col("volume") - F.col("product_avg"), F.col("product_avg")), F.col("volume").cast("double"))


def in_band() -> Column:
    """Rule -1: the deviation lies in the accepted band."""
    out = (F.col("deviation") > F.col("upper_band")) | (F.col("deviation") < F.col("lower_band"))
    return F.when(out, 0).otherwise(1)


def justified() -> Column:
    """Rule 1: a field order of a listed type whose reading agrees with the meter in time and size."""
    read, done, valid = F.col("read_on"), F.col("executed_on"), F.col("last_valid_on")
    order, reading, last = F.col("order_reading"), F.col("reading"), F.col("last_valid_reading")
    listed = F.col("work_type").isin(*JUSTIFYING_TYPES)
    consistent = ((read <= done) & (reading <= order)) | ((read >= done) & (reading >= order))
    slope = ratio(order - last, F.datediff(done, valid))
    reached = (done > valid) & (read > valid) & (order + slope * F.datediff(read, valid) >= reading)
    return (
        F.when(order == NO_READING, NO)
        .when(F.col("two_months_reading") > order, NO)
        .when((F.col("rule_0") == 1) & listed & consistent & reached, YES)
        .otherwise(NO)
    )


def estimated_share() -> Column:
    """Deviation in percent of the estimated consumption, from the product's or else the locality's average."""
    estimated, avg, local = F.col("estimated"), F.col("product_avg"), F.col("local_avg")
    reference = F.when(avg != 0, avg).when(local != 0, local)
    return (
        F.when(F.col("rule_1") == YES, F.lit(float(JUSTIFIED_DEVIATION)))
        .when(reference.isNull(), F.lit(float(UNKNOWN_DEVIATION)))
        .otherwise(ratio(estimated - reference, reference) * 100)
    )


def suspended_period() -> Column:
    """Rule 2: a possibly suspended period whose estimated consumption stays in the band."""
    days, share = F.col("suspended_days"), F.col("estimated_share")
    inside = share.between(F.col("lower_band"), F.col("upper_band"))
    return (
        F.when(F.col("rule_1") == YES, "Aplica Regla 1")
        .when((days == 0) | ((days >= 0) & ~inside), NO)
        .when((F.col("volume") != 0) & inside & (F.col("rule_0") == 1), YES)
        .otherwise(NO)
    )


def local_comparison() -> Column:
    """Rule 4: compare with the mean of the locality and sub-category, after the earlier rules."""
    volume, local = F.col("volume"), F.col("local_avg")
    return (
        F.when(F.col("rule_1") == YES, "Aplica Regla 1")
        .when(F.col("rule_2") == YES, "Aplica Regla 2")
        .when(F.col("rule_band") == 1, "Aplica Regla -1")
        .when((F.col("category") == 2) | (local == 0), NO)
        .when(volume > local, NO)
        .when((volume > 0) & (volume < local), YES)
        .otherwise("No")
    )


def review_rules(df: DataFrame) -> DataFrame:
    steps = (
        ("rule_0", monotone()), ("deviation", deviation()), ("rule_band", in_band()),
        ("rule_1", justified()), ("estimated_share", estimated_share()), ("rule_2", suspended_period()), ("rule_4", local_comparison()),
    )
    out = prepare(df)
    for name, rule in steps:
        out = out.withColumn(name, rule)
    return out.drop("estimated_share")
