"""Portfolio, credit-line and meter-review queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridlytics.operators import consumption as K
from gridlytics.operators import credit as C
from gridlytics.operators import portfolio as P
from gridlytics.operators import relational as R
from gridlytics.operators import review as V
from gridlytics.operators import stats as ST
from gridlytics.plans.bases import CREDIT_AS_OF, Tables
from gridlytics.plans.registry import query
from gridlytics.plans.tails import chi2_tail, erfc


def _base(t: Tables):
    return P.portfolio_base(t.products, t.closes, CREDIT_AS_OF)


def _fact(t: Tables):
    return P.scoring_fact(t.products, t.closes, t.billing, t.payments, t.deferred, t.suspended, CREDIT_AS_OF)


@query("portfolio_base", "SELECT * FROM base", ["base"])
def _(t):
    return _base(t)


@query("writeoff_at_close", """
    SELECT close_date, product_id, product_type, "interval", written_off FROM base WHERE close_date = DATE '2001-07-31'""", ["base"])
def _(t):
    return P.writeoff_at_close(t.products, t.closes, CREDIT_AS_OF)


@query("payment_behaviour", """
    SELECT b.product_id, product_type, "interval", CAST(sum(coalesce(billed, 0)) AS BIGINT) AS billed,
           CAST(sum(coalesce(paid, 0)) AS BIGINT) AS paid
    FROM base b LEFT JOIN billing f ON f.product_id = b.product_id AND f.close_date = b.close_date
    LEFT JOIN payments g ON g.product_id = b.product_id AND g.close_date = b.close_date GROUP BY 1, 2, 3""",
       ["base", "billing", "payments"])
def _(t):
    return P.payment_behaviour(_base(t), t.billing, t.payments)


@query("refinancings", """
    SELECT b.product_id, product_type, "interval", count(DISTINCT financing_code) AS refinancings
    FROM base b JOIN deferred d ON d.product_id = b.product_id AND last_day(d.entry_date) = b.close_date
    WHERE is_current = 1 AND program = 'GCNED' GROUP BY 1, 2, 3""", ["base", "deferred"])
def _(t):
    return P.refinancings(_base(t), t.deferred)


@query("suspensions", """
    SELECT k.product_id, k.product_type, k."interval", count(DISTINCT suspension_id) AS suspensions,
           CAST(sum(CASE WHEN suspension_id IS NOT NULL THEN greatest(datediff('day', greatest(applied_date, lower),
             CASE WHEN reconnected_date <> DATE '1900-01-01' AND reconnected_date < upper THEN reconnected_date ELSE upper END), 0)
             END) AS BIGINT) AS suspended_days
    FROM (SELECT product_id, product_type, "interval", max(close_date) AS upper,
                 min(CAST(date_trunc('month', close_date) AS DATE)) AS lower FROM base GROUP BY 1, 2, 3) k
    LEFT JOIN suspended s ON s.product_id = k.product_id AND suspension_type = 2 AND
      ((applied_date <= lower AND (reconnected_date = DATE '1900-01-01' OR reconnected_date > lower))
       OR (applied_date > lower AND applied_date <= upper)) GROUP BY 1, 2, 3""", ["base", "suspended"])
def _(t):
    return P.suspensions(P.interval_bounds(_base(t)), t.suspended)


@query("desync_days", """
    SELECT contract_id, "interval", max(gap) AS desync_days FROM (
      SELECT close_date, contract_id, "interval", max(CASE WHEN product_type = 7055 THEN arrears_days END)
             - max(CASE WHEN product_type = 7014 THEN arrears_days END) AS gap FROM base GROUP BY 1, 2, 3) GROUP BY 1, 2""", ["base"])
def _(t):
    return P.desync_days(_base(t))


@query("aging_buckets", """
    SELECT product_id, product_type, "interval", contract_id,
           count(*) FILTER (arrears_days BETWEEN 1 AND 30) AS e30, count(*) FILTER (arrears_days BETWEEN 31 AND 60) AS e60,
           count(*) FILTER (arrears_days BETWEEN 61 AND 90) AS e90, count(*) FILTER (arrears_days > 90) AS em90,
           CAST(sum(written_off) AS BIGINT) AS written_off_months FROM base GROUP BY 1, 2, 3, 4""", ["base"])
def _(t):
    return P.aging_buckets(_base(t))


@query("scoring_fact", "SELECT * FROM fact", ["fact"])
def _(t):
    return _fact(t)


@query("score_variables", "SELECT * FROM variables", ["variables"],
       ["v_payment", "v_arrears", "v_refinancing", "v_suspension", "v_writeoff", "v_desync"])
def _(t):
    return P.score_variables(_fact(t))


@query("pca_score")
def _(t):
    return P.pca_score(P.score_variables(_fact(t)))


@query("score_weights")
def _(t):
    return P.score_weights(P.pca_score(P.score_variables(_fact(t))))


@query("score_segments", """
    SELECT product_id, product_type, "interval", v_arrears AS score,
           CASE WHEN v_arrears <= 0.55 THEN 0 WHEN v_arrears <= 0.7 THEN 1 WHEN v_arrears <= 0.85 THEN 2
                WHEN v_arrears < 1 THEN 3 WHEN v_arrears = 1 THEN 4 END AS segment,
           CASE WHEN v_arrears <= 0.55 THEN 'Pesimo' WHEN v_arrears <= 0.7 THEN 'Malo' WHEN v_arrears <= 0.85 THEN 'Regular'
                WHEN v_arrears < 1 THEN 'Bueno' WHEN v_arrears = 1 THEN 'Excelente' END AS segment_name FROM variables""",
       ["variables"], ["score"])
def _(t):
    rows = P.score_variables(_fact(t)).select(*P.KEYS, F.col("v_arrears").alias("score"))
    return P.score_segments(rows)


@query("score_segment_counts")
def _(t):
    return P.segment_counts(P.score_segments(P.pca_score(P.score_variables(_fact(t)))))


@query("payment_class_gas", "SELECT * FROM gas_class", ["gas_class"])
def _(t):
    return C.payment_class(t.closes, C.GAS, CREDIT_AS_OF)


@query("payment_class_credit", "SELECT * FROM credit_class", ["credit_class"])
def _(t):
    return C.payment_class(t.closes, C.CREDIT, CREDIT_AS_OF)


@query("deferred_profile", "SELECT * FROM profile", ["profile"])
def _(t):
    return C.deferred_profile(t.deferred, t.products)


@query("avg_instalment", "SELECT * FROM instalment", ["instalment"], ["gas_instalment", "credit_instalment"])
def _(t):
    return C.avg_instalment(t.charges, t.products, CREDIT_AS_OF)


def _inputs(t: Tables):
    return C.scoring_inputs(
        t.closes, t.products, t.contracts, t.clients, t.deferred, t.charges, t.excluded_places, CREDIT_AS_OF
    )


@query("scoring_inputs", "SELECT * FROM inputs", ["inputs"])
def _(t):
    return _inputs(t)


_NODES = """
    SELECT *, coalesce(credit_node, gas_node) AS node,
           CASE WHEN credit_node IN (1, 2) THEN 'bajo' WHEN credit_node BETWEEN 3 AND 6 THEN 'medio' WHEN credit_node = 7 THEN 'alto'
                WHEN gas_node < {alto} THEN 'medio' WHEN gas_node >= {alto} THEN 'alto' END AS risk,
           stratum * 100 + CASE WHEN credit_node IN (1, 2) THEN 10 ELSE 0 END + CASE WHEN credit_node IS NULL THEN 0 ELSE 1 END AS coded_node
    FROM (SELECT *,
        CASE WHEN credit_e60 > 0 THEN 7
             WHEN credit_e60 <= 0 AND credit_e0 > 8 AND coalesce(credit_pending, 0) <= 7 THEN CASE WHEN credit_e30 > 0 THEN 2 ELSE 1 END
             WHEN credit_e60 <= 0 AND credit_e0 > 8 THEN 3
             WHEN credit_e60 <= 0 AND credit_e0 > 1 THEN CASE WHEN coalesce(credit_pending, 0) <= 34 THEN 4 ELSE 5 END
             WHEN credit_e60 <= 0 THEN 6 END AS credit_node,
        CASE gas_class
             WHEN '1-Pago A Tiempo' THEN CASE WHEN gas_e0 > 12 THEN CASE WHEN gas_pending <= 35 THEN 8 ELSE 9 END
                  WHEN gas_e0 > 8 THEN CASE WHEN gas_pending <= 35 THEN 10 ELSE 12 END
                  ELSE CASE WHEN gas_pending <= 35 THEN 11 ELSE 13 END END
             WHEN '2-Pago Atrasado a 60 Dias' THEN CASE WHEN gas_e60 <= 1 THEN 14 ELSE 15 END
             WHEN '3-No Paga a 90 Dias' THEN {unpaid} END AS gas_node FROM {source})"""

_NODE_COLS = "contract_id, credit_node, gas_node, node, risk, coded_node"


@query("risk_nodes", f"SELECT {_NODE_COLS} FROM (" + _NODES.format(alto=16, unpaid="16", source="inputs") + ")", ["inputs"])
def _(t):
    return C.combine_risk(_inputs(t)).select(*[c.strip() for c in _NODE_COLS.split(",")])


@query("risk_nodes_split_unpaid", f"SELECT {_NODE_COLS} FROM ("
       + _NODES.format(alto=17, unpaid="CASE WHEN gas_em90 = 0 THEN 16 ELSE 17 END", source="inputs") + ")", ["inputs"])
def _(t):
    return C.combine_risk(_inputs(t), split_unpaid=True).select(*[c.strip() for c in _NODE_COLS.split(",")])


_QUOTA = """
    SELECT contract_id, CAST(coalesce(CASE WHEN node IN (7, 16) THEN b.quota WHEN node BETWEEN 1 AND 15 THEN c.quota END, 0) AS INTEGER) AS quota,
           holder_id, id_type, node, risk, category, stratum, DATE '2001-07-31' AS predicted_on
    FROM ({nodes}) n LEFT JOIN (VALUES {base}) b(s, quota) ON b.s = n.stratum
    LEFT JOIN (VALUES {coded}) c(k, quota) ON c.k = n.coded_node"""


# The quota of each stratum, and of each coded node; written out, so that a wrong constant of the operator shows.
_BASE_QUOTA = "(1, 3340000), (2, 3645000), (3, 4050000), (4, 4635000), (5, 6530000), (6, 6530000)"
_CODED_QUOTA = """
    (100, 3735000), (101, 3960000), (111, 5225000), (200, 3735000), (201, 3960000), (211, 5700000), (300, 4150000), (301, 4400000), (311, 6000000),
    (400, 4950000), (401, 5000000), (411, 6250000), (500, 6850000), (501, 7175000), (511, 7500000), (600, 6850000), (601, 7175000), (611, 7500000)"""


def _quota_sql(alto: int, unpaid: str) -> str:
    source = "(SELECT * FROM inputs WHERE holder_id IS NOT NULL AND category = 1)"
    nodes = _NODES.format(alto=alto, unpaid=unpaid, source=source)
    return _QUOTA.format(nodes=nodes, base=_BASE_QUOTA, coded=_CODED_QUOTA)


@query("credit_quota", _quota_sql(16, "16"), ["inputs"])
def credit_quota(t):
    return C.credit_quota(_inputs(t), CREDIT_AS_OF)


@query("credit_quota_split_unpaid", _quota_sql(17, "CASE WHEN gas_em90 = 0 THEN 16 ELSE 17 END"), ["inputs"])
def _(t):
    return C.credit_quota(_inputs(t), CREDIT_AS_OF, split_unpaid=True)


@query("arrears_bands", """
    SELECT CASE WHEN arrears_days <= 30 THEN 'E30' WHEN arrears_days <= 60 THEN 'E60' WHEN arrears_days <= 90 THEN 'E90'
                ELSE 'EM90' END AS band, count(*) AS n FROM closes GROUP BY 1""", ["closes"])
def _(t):
    return t.closes.groupBy(P.arrears_band("arrears_days").alias("band")).agg(F.count("*").alias("n"))


@query("trailing_months", """
    SELECT contract_id, close_date, arrears_days FROM closes
    WHERE close_date BETWEEN DATE '2000-07-31' AND DATE '2001-07-31' AND close_date = last_day(close_date)""", ["closes"])
def _(t):
    rows = R.trailing_months(R.month_ends(t.closes, "close_date"), "close_date", 12, CREDIT_AS_OF)
    return rows.select("contract_id", "close_date", "arrears_days")


# Meter review ---------------------------------------------------------------------------------

_REVIEW = """
    SELECT *, CASE WHEN rule_1 = 'Yes' THEN 'Aplica Regla 1' WHEN rule_2 = 'Yes' THEN 'Aplica Regla 2'
                   WHEN rule_band = 1 THEN 'Aplica Regla -1' WHEN category = 2 OR local_avg = 0 THEN 'NO'
                   WHEN volume > local_avg THEN 'NO' WHEN volume > 0 AND volume < local_avg THEN 'Yes' ELSE 'No' END AS rule_4
    FROM (SELECT *, CASE WHEN rule_1 = 'Yes' THEN 'Aplica Regla 1' WHEN suspended_days = 0 THEN 'NO'
                         WHEN suspended_days >= 0 AND (share < lo OR share > hi) THEN 'NO'
                         WHEN volume <> 0 AND share <= hi AND share >= lo AND rule_0 = 1 THEN 'Yes' ELSE 'NO' END AS rule_2
      FROM (SELECT *, CASE WHEN rule_1 = 'Yes' THEN -12487531478
                           WHEN product_avg <> 0 THEN (estimated - product_avg) / product_avg * 100
                           WHEN local_avg <> 0 THEN (estimated - local_avg) / local_avg * 100 ELSE 1000 END AS share
        FROM (SELECT *, CASE WHEN order_reading = -10 THEN 'NO' WHEN two_months_reading > order_reading THEN 'NO'
                     WHEN rule_0 = 1 AND work_type IN (12620, 12526)
                      AND ((read_on <= executed_on AND reading <= order_reading) OR (read_on >= executed_on AND reading >= order_reading))
                      AND executed_on > last_valid_on AND read_on > last_valid_on
                      AND order_reading + (order_reading - last_valid_reading) / nullif(datediff('day', last_valid_on, executed_on), 0)
                          * datediff('day', last_valid_on, read_on) >= reading THEN 'Yes' ELSE 'NO' END AS rule_1
          FROM (SELECT *, CASE WHEN last_valid_reading = -10 THEN 0 WHEN last_valid_reading <= first_valid_reading THEN 1 ELSE 0 END AS rule_0,
                       CASE WHEN deviation > hi OR deviation < lo THEN 0 ELSE 1 END AS rule_band
            FROM (SELECT *, coalesce(lower_band, -300) AS lo, coalesce(upper_band, 300) AS hi,
                         CASE WHEN product_avg <> 0 THEN (volume - product_avg) / product_avg ELSE volume END AS deviation
                  FROM meter_orders)))))"""
_REVIEW_COLS = "order_id, line, rule_0, deviation, rule_band, rule_1, rule_2, rule_4"


@query("review_rules", f"SELECT {_REVIEW_COLS} FROM ({_REVIEW})", ["meter_orders"], ["deviation"])
def _(t):
    return V.review_rules(t.meter_orders).select(*[c.strip() for c in _REVIEW_COLS.split(",")])


@query("parse_decimals", """
    SELECT order_id, line, last_valid_reading, two_months_reading, reading, product_avg, local_avg, estimated FROM meter_orders""",
       ["meter_orders"], ["last_valid_reading", "two_months_reading", "reading", "product_avg", "local_avg", "estimated"])
def _(t):
    return V.prepare(t.meter_orders).select(
        "order_id", "line", "last_valid_reading", "two_months_reading", "reading", "product_avg", "local_avg", "estimated"
    )


# Consumption ----------------------------------------------------------------------------------

_PERIOD, _LO, _HI, _SINCE = "2001-03-01", "2000-09-01", "2001-02-01", "1995-01-01"


def _consumption(t: Tables):
    return K.consumption_fact(t.calc, t.periods, t.station_closes, _SINCE)


def _variations(t: Tables):
    fact = _consumption(t)
    return K.variations(fact, K.avg_consumption(fact, _LO, _HI), _PERIOD, 1)


@query("period_consumption", """
    SELECT product_id, period_id, sum(units) AS units, min(method) AS min_method,
           arg_max(method, ROW(CASE WHEN method = 2 THEN DATE '1900-01-01' ELSE consumed_on END, CASE WHEN method = 2 THEN 8 ELSE method END)) AS method,
           max(ROW(-CASE WHEN method = 2 THEN 8 ELSE method END, consumed_on, days))[3] AS days
    FROM calc WHERE method <> 4 GROUP BY 1, 2""", ["calc"], ["units"])
def _(t):
    return K.period_consumption(t.calc)


@query("consumption_fact", "SELECT * FROM consumption", ["consumption"])
def _(t):
    return _consumption(t)


@query("avg_consumption", "SELECT * FROM averages", ["averages"], ["average"])
def _(t):
    return K.avg_consumption(_consumption(t), _LO, _HI)


@query("variation_band", """
    SELECT count(*) AS n, avg(variation) AS mean, stddev_samp(variation) AS sd,
           avg(variation) - 2 * stddev_samp(variation) AS lower, avg(variation) + 2 * stddev_samp(variation) AS upper
    FROM variation""", ["variation"], ["mean", "sd", "lower", "upper"])
def _(t):
    fact = _consumption(t)
    return K.variation_band(fact, K.avg_consumption(fact, _LO, _HI), _PERIOD, 1)


@query("upper_limit", """
    SELECT mean, sd, mode, mode + 2 * sd AS mode_limit, mean + 2 * sd AS mean_limit
    FROM (SELECT avg(volume) AS mean, stddev_samp(volume) AS sd FROM consumption)
    CROSS JOIN (SELECT volume AS mode FROM consumption GROUP BY 1 ORDER BY count(*) DESC, volume LIMIT 1)""",
       ["consumption"], ["mean", "sd", "mode", "mode_limit", "mean_limit"])
def _(t):
    return ST.upper_limit(_consumption(t), "volume", 2)


@query("upper_limit_by_category", """
    SELECT category, mean, sd, mode, mode + k * sd AS mode_limit, mean + k * sd AS mean_limit
    FROM (SELECT category, avg(volume) AS mean, stddev_samp(volume) AS sd, CASE category WHEN 1 THEN 2 ELSE 1 END AS k FROM consumption GROUP BY 1)
    JOIN (SELECT category, arg_min(volume, (-n, volume)) AS mode FROM (SELECT category, volume, count(*) AS n FROM consumption GROUP BY 1, 2) GROUP BY 1)
    USING (category)""", ["consumption"], ["mean", "sd", "mode", "mode_limit", "mean_limit"])
def _(t):
    return ST.upper_limit_by(_consumption(t), "category", "volume", {1: 2}, 1)


@query("fit_distributions")
def _(t):
    return ST.fit_distributions(_consumption(t), "volume")


# The two fits that have closed forms.
@query("fit_closed_forms", """
    SELECT unnest(['lognorm', 'expon']) AS distribution, unnest([sqrt(var), NULL]) AS shape, unnest([exp(mean_log), mean - low]) AS scale, unnest([0.0::DOUBLE, low]) AS location,
           unnest([l + n / 2 * ln(2 * pi() * var) + n / 2, n * ln(mean - low) + n]) AS nll,
           unnest([4 + 2 * (l + n / 2 * ln(2 * pi() * var) + n / 2), 2 * (CASE WHEN low >= 0 THEN 2 END) + 2 * (n * ln(mean - low) + n)]) AS aic
    FROM (SELECT CAST(count(*) AS DOUBLE) AS n, sum(ln(volume)) AS l, avg(ln(volume)) AS mean_log, var_pop(ln(volume)) AS var, avg(volume) AS mean, min(volume) AS low
          FROM (SELECT CAST(volume AS DOUBLE) AS volume FROM consumption WHERE volume > 0))""",
       ["consumption"], ["shape", "scale", "location", "nll", "aic"])
def _(t):
    return ST.fit_distributions(_consumption(t), "volume").filter(F.col("distribution") != "gamma")


_GIVEN = [-50.0, -10.0, -2.0, -0.5, 0.0, 1e9]


@query("location_profile", f"""
    SELECT location, CASE WHEN location < low THEN l + n / 2 * ln(2 * pi() * greatest(q / n - power(l / n, 2), 1e-300)) + n / 2 END AS nll
    FROM (SELECT location, CAST(count(*) AS DOUBLE) AS n, min(volume) AS low, sum(CASE WHEN volume > location THEN ln(volume - location) END) AS l,
                 sum(CASE WHEN volume > location THEN power(ln(volume - location), 2) END) AS q
          FROM (SELECT CAST(volume AS DOUBLE) AS volume FROM consumption WHERE volume > 0) CROSS JOIN (SELECT unnest({_GIVEN})::DOUBLE AS location) GROUP BY 1)""",
       ["consumption"], ["nll"])
def _(t):
    """The log-normal's likelihood along given locations; one that is not below the values has none."""
    return ST.location_profile(_consumption(t), "volume", _GIVEN).select("location", "nll")


@query("fit_free_distributions")
def _(t):
    return ST.fit_free_distributions(_consumption(t), "volume")


@query("best_distribution")
def _(t):
    return ST.best_distribution(_consumption(t), "volume")


def _log_tail(z: str) -> str:
    """The logarithm of the normal law's lower tail."""
    return f"ln(CASE WHEN {z} < 0 THEN 0.5 * {erfc(f'(-({z}) / sqrt(2))')} ELSE 1 - 0.5 * {erfc(f'(({z}) / sqrt(2))')} END)"


@query("anderson_darling", f"""
    SELECT category, CAST(n AS BIGINT) AS n, -n - total / n AS statistic, {", ".join(
        f"round({c} / (1 + 4 / n - 25 / (n * n)), 3) AS critical_{str(level).replace('.', '_')}" for c, level in zip(ST.AD_CRITICAL, ST.AD_LEVELS))}
    FROM (SELECT category, any_value(n) AS n, sum(((b + c) * (b + c) - b * b) * {_log_tail('z')}
                 + ((n - b) * (n - b) - (n - b - c) * (n - b - c)) * {_log_tail('(-z)')}) AS total
          FROM (SELECT category, (v - m) / s AS z, CAST(c AS DOUBLE) AS c, CAST(n AS DOUBLE) AS n,
                       CAST(sum(c) OVER (PARTITION BY category ORDER BY v) - c AS DOUBLE) AS b
                FROM (SELECT category, CAST(volume AS DOUBLE) AS v, count(*) AS c FROM consumption WHERE volume IS NOT NULL GROUP BY 1, 2)
                JOIN (SELECT category, avg(volume) AS m, stddev_samp(volume) AS s, count(volume) AS n FROM consumption GROUP BY 1) USING (category) WHERE s > 0)
          GROUP BY 1)""", ["consumption"], ["statistic"])
def _(t):
    return ST.anderson_darling(_consumption(t), "category", "volume")


@query("chi_square_uniform", """
    SELECT count(*) AS n, sum(power(volume - m, 2)) / max(m) AS statistic, count(*) - 2 AS dof
    FROM consumption CROSS JOIN (SELECT avg(volume) AS m FROM consumption)""", ["consumption"], ["statistic"])
def _(t):
    return ST.chi_square_uniform(_consumption(t), "volume").drop("p_value")


@query("chi_square_p_value", f"""
    SELECT *, {chi2_tail('statistic', 'dof')} AS p_value FROM (
      SELECT count(*) AS n, sum(power(volume - m, 2)) / max(m) AS statistic, count(*) - 2 AS dof
      FROM consumption CROSS JOIN (SELECT avg(volume) AS m FROM consumption))""", ["consumption"], ["statistic", "p_value"])
def _(t):
    return ST.chi_square_uniform(_consumption(t), "volume")


@query("ks_f_scan")
def _(t):
    return ST.ks_f_scan(_consumption(t), "volume")
