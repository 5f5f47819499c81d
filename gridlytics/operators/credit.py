"""Credit-line scoring inputs, rule trees and quotas. The trees are column expressions in whole-stage codegen."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlytics.functions.columns import all_of, flag, month_end
from gridlytics.operators.portfolio import CHARGE_EXCLUDED, CHARGE_PROCESS, CREDIT, GAS, RESIDENTIAL

# Class labels, cut states that are left out, and the quota tables.
ON_TIME, LATE, UNPAID = "1-Pago A Tiempo", "2-Pago Atrasado a 60 Dias", "3-No Paga a 90 Dias"
OTHER = {GAS: "4-Otro", CREDIT: "5-Otro"}
EXCLUDED_CUT_STATES = (110, 111, 112)
APPROVED_QUOTA = "Cupo Aprobado"
BASE_QUOTA = {1: 3340000, 2: 3645000, 3: 4050000, 4: 4635000, 5: 6530000, 6: 6530000}
CODED_QUOTA = {
    100: 3735000, 101: 3960000, 111: 5225000,
    200: 3735000, 201: 3960000, 211: 5700000,
    300: 4150000, 301: 4400000, 311: 6000000,
    400: 4950000, 401: 5000000, 411: 6250000,
    500: 6850000, 501: 7175000, 511: 7500000,
    600: 6850000, 601: 7175000, 611: 7500000,
}
LOW, MEDIUM, HIGH = "bajo", "medio", "alto"

LINES = {GAS: "gas", CREDIT: "credit"}


def payment_class(closes: DataFrame, product_type: int, as_of) -> DataFrame:
    """Class of a contract by its worst month-end arrears of the last year, with counts per arrears bucket.

    Closes are reduced to the worst arrears per contract and month first, so several products of a
    contract count once per month on the credit line; gas months count every product row.
    """
    close = month_end(as_of, -1)
    line = LINES[product_type]
    window = closes.filter(
        (F.col("product_type") == product_type)
        & F.col("close_date").between(F.lit(month_end(close, -12)), F.lit(close))
        & (F.col("close_date") == F.last_day("close_date"))
    )
    if product_type == CREDIT:
        window = window.groupBy("contract_id", "close_date").agg(F.max("arrears_days").alias("arrears_days"))
    days = F.col("arrears_days")
    worst = F.max(days)
    buckets = {
        "0": days.between(-1, 0), "30": days.between(1, 30), "60": days.between(31, 60),
        "90": days.between(61, 90), "m90": days > 90,
    }
    label = F.when(worst <= 30, ON_TIME).when(worst <= 60, LATE).when(worst > 60, UNPAID).otherwise(OTHER[product_type])
    return window.groupBy("contract_id").agg(
        label.alias(f"{line}_class"), *[F.sum(flag(hit)).cast("int").alias(f"{line}_e{b}") for b, hit in buckets.items()]
    )


def deferred_profile(deferred: DataFrame, products: DataFrame) -> DataFrame:
    """Longest term, most pending instalments and initial balance of open deferred debt, per contract and line."""
    kind = products.select("product_id", "product_type").filter(F.col("product_type").isin(GAS, CREDIT))
    live = deferred.filter((F.col("is_current") == 1) & (F.col("outstanding") > 0)).join(kind, "product_id")
    aggs = []
    for code, line in LINES.items():
        mine = F.col("product_type") == code
        pending = F.col("instalments") - F.col("billed_instalments")
        aggs += [
            F.max(F.when(mine, F.col("instalments")).otherwise(0)).alias(f"{line}_term"),
            F.max(F.when(mine, pending).otherwise(0)).alias(f"{line}_pending"),
            F.sum(F.when(mine, F.col("total")).otherwise(0)).alias(f"{line}_initial_balance"),
        ]
    return live.groupBy("contract_id").agg(*aggs)


def avg_instalment(charges: DataFrame, products: DataFrame, as_of) -> DataFrame:
    """Average net monthly charge per contract and line; months of the other line stay in the denominator as 0."""
    close = month_end(as_of, -1)
    rows = charges.filter(
        ~F.col("program").isin(*CHARGE_EXCLUDED)
        & (F.col("process_type") == CHARGE_PROCESS)
        & F.col("sign").isin("DB", "CR")
        & F.col("posted_date").between(F.lit(month_end(close, -12)), F.date_add(F.lit(close), 1))
    )
    signed = F.when(F.col("sign") == "DB", F.col("amount")).otherwise(-F.col("amount"))
    owners = products.filter(F.col("product_type").isin(GAS, CREDIT)).select("product_id", "contract_id", "product_type")
    # The monthly net is taken before the join, so the join carries one row per product and month.
    monthly = rows.groupBy("product_id", F.last_day("posted_date").alias("period")).agg(F.sum(signed).alias("net"))
    return monthly.join(owners, "product_id").groupBy("contract_id").agg(
        *[
            F.avg(F.when(F.col("product_type") == code, F.col("net")).otherwise(0)).alias(f"{line}_instalment")
            for code, line in LINES.items()
        ]
    )


def scoring_inputs(
    closes: DataFrame, products: DataFrame, contracts: DataFrame, clients: DataFrame,
    deferred: DataFrame, charges: DataFrame, excluded_places: DataFrame, as_of,
) -> DataFrame:
    """Inputs of the rule trees: residential gas products at the last close, outside the excluded places."""
    close = month_end(as_of, -1)
    closes = closes.join(excluded_places.select("place_id"), "place_id", "left_anti")
    head = closes.filter(
        (F.col("close_date") == F.lit(close)) & (F.col("product_type") == GAS)
        & (F.col("category") == RESIDENTIAL) & ~F.col("cut_state").isin(*EXCLUDED_CUT_STATES)
    )
    out = head.join(contracts.select("contract_id", "product_id", "client_id"), ["contract_id", "product_id"])
    out = out.join(products.select("contract_id", "product_id"), ["contract_id", "product_id"], "left_semi")
    out = out.join(clients.select("client_id", "id_type"), "client_id", "left")
    for table in (
        payment_class(closes, GAS, as_of), payment_class(closes, CREDIT, as_of),
        deferred_profile(deferred, products), avg_instalment(charges, products, as_of),
    ):
        out = out.join(table, "contract_id", "left")
    return out.select(
        "id_type", "holder_id", "contract_id", "gas_class", "credit_class",
        *[f"{line}_e{b}" for line in LINES.values() for b in ("0", "30", "60", "90", "m90")],
        F.lit(APPROVED_QUOTA).alias("quota_type"), "department", "category", "stratum",
        "gas_pending", "credit_pending",
        F.col("gas_instalment").cast("int").alias("gas_instalment"),
        F.col("credit_instalment").cast("int").alias("credit_instalment"),
    )


def _tree(branches: Sequence[tuple[int, Sequence[Column]]]) -> Column:
    out = None
    for node, conditions in branches:
        hit = all_of(conditions)
        out = F.when(hit, F.lit(node)) if out is None else out.when(hit, F.lit(node))
    return out


def credit_line_node(prefix: str = "credit") -> Column:
    """Nodes 1-7 of the credit-line tree; NULL when the contract has no credit history."""
    up_to_date, e30, e60 = (F.col(f"{prefix}_e{b}") for b in ("0", "30", "60"))
    pending = F.col(f"{prefix}_pending")
    clean = e60 <= 0
    few = (pending <= 7) | pending.isNull()
    middle = (up_to_date > 1) & (up_to_date <= 8)
    return _tree([
        (1, [clean, up_to_date > 8, few, e30 <= 0]),
        (2, [clean, up_to_date > 8, few, e30 > 0]),
        (3, [clean, up_to_date > 8, pending > 7]),
        (4, [clean, middle, (pending <= 34) | pending.isNull()]),
        (5, [clean, middle, pending > 34]),
        (6, [clean, up_to_date <= 1]),
        (7, [e60 > 0]),
    ])


def gas_node(prefix: str = "gas", split_unpaid: bool = False) -> Column:
    """Nodes 8-16 of the gas tree; ``split_unpaid`` adds the variant where 16 is an unpaid contract
    without arrears over 90 days and 17 the other unpaid ones."""
    label, up_to_date, e60, em90 = (F.col(f"{prefix}_{c}") for c in ("class", "e0", "e60", "em90"))
    pending = F.col(f"{prefix}_pending")
    on_time, late, unpaid = label == ON_TIME, label == LATE, label == UNPAID
    short, long = pending <= 35, (pending > 35) | pending.isNull()
    middle = (up_to_date > 8) & (up_to_date <= 12)
    branches = [
        (8, [on_time, up_to_date > 12, short]),
        (9, [on_time, up_to_date > 12, long]),
        (10, [on_time, middle, short]),
        (11, [on_time, up_to_date <= 8, short]),
        (12, [on_time, middle, long]),
        (13, [on_time, up_to_date <= 8, long]),
        (14, [late, e60 <= 1]),
        (15, [late, e60 > 1]),
    ]
    branches += [(16, [unpaid, em90 == 0]), (17, [unpaid])] if split_unpaid else [(16, [unpaid])]
    return _tree(branches)


def credit_line_risk(node: Column) -> Column:
    return F.when(node <= 2, LOW).when(node <= 6, MEDIUM).when(node == 7, HIGH)


def gas_risk(node: Column, split_unpaid: bool = False) -> Column:
    return F.when(node < (17 if split_unpaid else 16), MEDIUM).when(node.isNotNull(), HIGH)


def combine_risk(inputs: DataFrame, split_unpaid: bool = False) -> DataFrame:
    """Credit-line node and risk where there is one, the gas ones otherwise; plus the coded node
    stratum·100 + low·10 + has a credit line."""
    credit, gas = credit_line_node(), gas_node(split_unpaid=split_unpaid)
    rows = inputs.withColumns({"credit_node": credit, "gas_node": gas})
    node = F.coalesce(F.col("credit_node"), F.col("gas_node"))
    risk = F.coalesce(credit_line_risk(F.col("credit_node")), gas_risk(F.col("gas_node"), split_unpaid))
    rows = rows.withColumns({"node": node, "risk": risk})
    coded = F.col("stratum") * 100 + flag(F.col("risk") == LOW) * 10 + flag(F.col("credit_node").isNotNull())
    return rows.withColumn("coded_node", coded)


def _lookup(table: Mapping[int, int], key: Column) -> Column:
    entries = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.try_element_at(entries, key.cast("int"))


def assign_quota(
    nodes: DataFrame, base_quota: Mapping[int, int] = BASE_QUOTA, coded_quota: Mapping[int, int] = CODED_QUOTA
) -> DataFrame:
    """Base quota of the stratum for nodes 7 and 16, quota of the coded node for the other nodes up to 15, else 0."""
    node = F.col("node")
    quota = F.when(node.isin(7, 16), _lookup(base_quota, F.col("stratum"))).when(
        F.col("stratum").between(1, 6) & node.between(1, 15), _lookup(coded_quota, F.col("coded_node"))
    )
    return nodes.withColumn("quota", F.coalesce(quota, F.lit(0)))


def credit_quota(inputs: DataFrame, as_of, split_unpaid: bool = False) -> DataFrame:
    """Quota table of residential holders with an identification."""
    rows = inputs.filter(F.col("holder_id").isNotNull() & (F.col("category") == RESIDENTIAL))
    out = assign_quota(combine_risk(rows, split_unpaid))
    return out.select(
        "contract_id", "quota", "holder_id", "id_type", "node", "risk", "category", "stratum",
        F.lit(month_end(as_of, -1)).alias("predicted_on"),
    )
