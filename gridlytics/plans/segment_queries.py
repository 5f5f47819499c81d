"""Segmentation and supervised-model queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from gridlytics.functions.columns import pick
from gridlytics.operators import models as MD
from gridlytics.operators import relational as R
from gridlytics.operators import segments as G
from gridlytics.operators import stats as ST
from gridlytics.plans.bases import CREDIT_AS_OF, Tables
from gridlytics.plans.registry import query
from gridlytics.plans.tails import draw
from gridlytics.sources import features as FT
from gridlytics.sources.staging import shared_folder


def _active(t: Tables):
    return G.split_activity(t.rfm_base, frequency="frequency")[0]


def _rfm(t: Tables):
    return G.rfm_scores(_active(t), drop_duplicates=True)


@query("rfm_scores", """
    SELECT *, CAST(r_score AS VARCHAR) || CAST(f_score AS VARCHAR) || CAST(m_score AS VARCHAR) AS rfm_code FROM rfm""", ["rfm"])
def _(t):
    return _rfm(t)


@query("monetary_quantile_score", """
    SELECT customer_id, monetary, 1 + CAST(monetary > q[1] AS INTEGER) + CAST(monetary > q[2] AS INTEGER)
           + CAST(monetary > q[3] AS INTEGER) + CAST(monetary > q[4] AS INTEGER) AS monetary_score
    FROM rfm_base CROSS JOIN (SELECT quantile_cont(CAST(monetary AS DOUBLE), [0.2, 0.4, 0.6, 0.8]) AS q FROM rfm_base)""", ["rfm_base"])
def _(t):
    return G.quantile_score(t.rfm_base.select("customer_id", "monetary"), "monetary")


@query("recency_width_score", """
    SELECT partner_id, channel, recency, 5 - CAST(recency > lo + (hi - lo) * 1 / 5 AS INTEGER) - CAST(recency > lo + (hi - lo) * 2 / 5 AS INTEGER)
           - CAST(recency > lo + (hi - lo) * 3 / 5 AS INTEGER) - CAST(recency > lo + (hi - lo) * 4 / 5 AS INTEGER) AS recency_score
    FROM partner_base CROSS JOIN (SELECT CAST(min(recency) AS DOUBLE) AS lo, CAST(max(recency) AS DOUBLE) AS hi FROM partner_base)""",
       ["partner_base"])
def _(t):
    return G.width_score(t.partner_base.select("partner_id", "channel", "recency"), "recency")


@query("frequency_score", """
    SELECT customer_id, frequency, CASE WHEN frequency BETWEEN 1 AND 3 THEN CAST(frequency AS INTEGER)
           WHEN frequency IN (4, 5) THEN 4 WHEN frequency >= 6 THEN 5 END AS f_score FROM rfm_base""", ["rfm_base"])
def _(t):
    return t.rfm_base.select("customer_id", "frequency", G.frequency_score("frequency").alias("f_score"))


@query("return_flag", """
    SELECT partner_id, channel, CASE WHEN CAST(returns AS DOUBLE) / sales <= 0.05 THEN 0 ELSE 1 END AS returns_flag FROM partner_base""",
       ["partner_base"])
def _(t):
    return t.partner_base.select("partner_id", "channel", G.return_flag("returns", "sales").alias("returns_flag"))


@query("split_activity", """
    SELECT customer_id, CASE WHEN recency > 49 THEN 'Inactivos' ELSE 'Activo' END AS side FROM rfm_base
    WHERE recency > 49 OR frequency <> 0""", ["rfm_base"])
def _(t):
    active, idle = G.split_activity(t.rfm_base, frequency="frequency")
    return active.select("customer_id", F.lit("Activo").alias("side")).unionByName(
        idle.select("customer_id", F.lit(G.INACTIVE).alias("side"))
    )


_QCUT = " + ".join(f"CAST({{c}} > q{{i}}[{k}] AS INTEGER)" for k in (1, 2, 3, 4))


def _partner_sql(channel: str, flag: bool) -> str:
    cols = ["monetary", "ticket", "term", "monetary_6m", "sales"] + ([] if flag else ["return_share"])
    edges = ", ".join(f"list_distinct_sorted(quantile_cont(CAST({c} AS DOUBLE), [0.0, 0.2, 0.4, 0.6, 0.8, 1.0])) AS q{i}" for i, c in enumerate(cols))
    edges = edges.replace("list_distinct_sorted(", "list_sort(list_distinct(").replace(") AS q", ")) AS q")
    scores = ", ".join(
        f"1 + CAST(len(list_filter(q{i}[2:], lambda e: e < CAST({c} AS DOUBLE))) AS INTEGER) AS {c}_score" for i, c in enumerate(cols)
    )
    if flag:
        scores += ", CASE WHEN return_share <= 0.05 THEN 0 ELSE 1 END AS return_share_score"
    return f"""
        SELECT partner_id, channel, 5 - CAST(recency > lo + (hi - lo) * 1 / 5 AS INTEGER) - CAST(recency > lo + (hi - lo) * 2 / 5 AS INTEGER)
               - CAST(recency > lo + (hi - lo) * 3 / 5 AS INTEGER) - CAST(recency > lo + (hi - lo) * 4 / 5 AS INTEGER) AS recency_score, {scores}
        FROM (SELECT *, CAST(returns AS DOUBLE) / sales AS return_share FROM partner_base WHERE monetary > 100000 AND channel = '{channel}')
        CROSS JOIN (SELECT CAST(min(recency) AS DOUBLE) AS lo, CAST(max(recency) AS DOUBLE) AS hi, {edges}
                    FROM (SELECT *, CAST(returns AS DOUBLE) / sales AS return_share FROM partner_base WHERE monetary > 100000 AND channel = '{channel}'))"""


_PARTNER_SCORES = ["recency", "monetary", "ticket", "term", "monetary_6m", "sales", "return_share"]


def _partners(t: Tables, flag: bool):
    """The partners of both channels; each is scored among its own, in one pass."""
    return G.partner_scores(G.split_partners(t.partner_base)[0], flag, by="channel")


def _scores(t: Tables, flag: bool):
    return _partners(t, flag).select("partner_id", "channel", *[f"{c}_score" for c in _PARTNER_SCORES])


@query("partner_scores", f"{_partner_sql('O', False)} UNION ALL {_partner_sql('F', False)}", ["partner_base"])
def _(t):
    return _scores(t, False)


@query("partner_scores_flag", f"{_partner_sql('O', True)} UNION ALL {_partner_sql('F', True)}", ["partner_base"])
def _(t):
    return _scores(t, True)


@query("sample_per_code", """
    SELECT rfm_code, min(customer_id) AS customer_id
    FROM (SELECT *, CAST(r_score AS VARCHAR) || CAST(f_score AS VARCHAR) || CAST(m_score AS VARCHAR) AS rfm_code FROM rfm) GROUP BY 1""",
       ["rfm"])
def _(t):
    return G.sample_per_code(_rfm(t)).select("rfm_code", "customer_id")


def _given_centers(t: Tables):
    """Centres given by the recency score: the mean scores of its five levels."""
    return _rfm(t).groupBy((F.col("r_score") - 1).alias("cluster")).agg(*[F.avg(c).alias(c) for c in G.SCORES])


_CENTERS = """(SELECT *, sqrt(r_score * r_score + m_score * m_score + f_score * f_score) AS magnitude
               FROM (SELECT r_score - 1 AS cluster, avg(r_score) AS r_score, avg(m_score) AS m_score, avg(f_score) AS f_score FROM rfm GROUP BY 1))"""


@query("name_by_magnitude", f"""
    SELECT cluster, ['Diamante', 'Platino', 'Oro', 'Plata', 'Bronce'][row_number() OVER (ORDER BY magnitude DESC, cluster)] AS name FROM {_CENTERS}""",
       ["rfm"])
def _(t):
    return G.name_by_magnitude(_given_centers(t)).select("cluster", "name")


@query("name_by_amount", f"""
    SELECT cluster, ['Diamante', 'Platino', 'Oro', 'Plata', 'Bronce'][row_number() OVER (ORDER BY m_score DESC, cluster)] AS name FROM {_CENTERS}""",
       ["rfm"])
def _(t):
    return G.name_by_amount(_given_centers(t), "m_score").select("cluster", "name")


@query("name_by_thresholds", f"""
    SELECT cluster, CASE WHEN magnitude = max(magnitude) OVER () THEN 'Diamante' WHEN magnitude = min(magnitude) OVER () THEN 'Bronce'
           WHEN r_score > 3.5 AND f_score < 2.3 THEN 'Nuevo' WHEN r_score < 3.5 AND f_score > 2.3 THEN 'Plata' END AS name FROM {_CENTERS}""",
       ["rfm"])
def _(t):
    return G.name_by_thresholds(_given_centers(t)).select("cluster", "name")


@query("name_by_loyalty", f"""
    SELECT cluster, CASE WHEN often <= 2 AND up <= 4 THEN 'No puedo perder' WHEN up = 2 THEN 'Primiparos con plata'
           WHEN up = n THEN 'Diamante' WHEN up = 1 THEN 'Hibernando' ELSE 'Primiparo' END AS name
    FROM (SELECT *, row_number() OVER (ORDER BY magnitude, cluster) AS up, row_number() OVER (ORDER BY f_score DESC, cluster) AS often,
                 count(*) OVER () AS n FROM {_CENTERS})""", ["rfm"])
def _(t):
    return G.name_by_loyalty(_given_centers(t)).select("cluster", "name")


_NAMED = f"""(SELECT customer_id, recency, frequency, monetary, r_score - 1 AS cluster, name FROM rfm JOIN (
    SELECT cluster, ['Diamante', 'Platino', 'Oro', 'Plata', 'Bronce'][row_number() OVER (ORDER BY magnitude DESC, cluster)] AS name
    FROM {_CENTERS}) c ON c.cluster = r_score - 1)"""


def _named(t: Tables):
    rows = _rfm(t).withColumn("cluster", F.col("r_score") - 1)
    return G.attach_names(rows, G.name_by_magnitude(_given_centers(t)))


@query("assemble_customers", f"""
    SELECT customer_id, CAST(cluster AS INTEGER) AS segment, name AS segment_name, DATE '2001-08-01' AS predicted_on FROM {_NAMED}
    UNION ALL SELECT customer_id, 4, 'Inactivos', DATE '2001-08-01' FROM rfm_base WHERE recency > 49""", ["rfm", "rfm_base"])
def _(t):
    return G.assemble_customers(_named(t), G.split_activity(t.rfm_base)[1], CREDIT_AS_OF)


@query("segment_summary", f"""
    SELECT name, count(*) AS n, avg(recency) AS avg_recency, avg(frequency) AS avg_frequency, avg(monetary) AS avg_monetary
    FROM {_NAMED} GROUP BY 1""", ["rfm"], ["avg_recency", "avg_frequency", "avg_monetary"])
def _(t):
    return G.segment_summary(_named(t), "name", ["recency", "frequency", "monetary"])


@query("name_four_tiers", """
    SELECT partner_id, ['Estandar', 'Plus', 'Elite', 'Premium'][1 + CAST(monetary > q[1] AS INTEGER) + CAST(monetary > q[2] AS INTEGER)
           + CAST(monetary > q[3] AS INTEGER)] AS name
    FROM partner_base CROSS JOIN (SELECT quantile_cont(CAST(monetary AS DOUBLE), [0.25, 0.5, 0.75]) AS q FROM partner_base WHERE monetary > 100000)
    WHERE monetary > 100000""", ["partner_base"])
def _(t):
    live, _ = G.split_partners(t.partner_base)
    scored = G.quantile_score(live, "monetary", q=4, drop_duplicates=True)
    return scored.select("partner_id", pick(G.FOUR_TIERS, 4 - F.col("monetary_score")).alias("name"))


_AMOUNT_NAMED = """
    SELECT partner_id, CAST(5 - s AS INTEGER) AS segment, ['Diamante', 'Platino', 'Oro', 'Plata', 'Bronce'][6 - s] AS segment_name, {kind} AS partner_type
    FROM (SELECT partner_id, 1 + CAST(monetary > q[1] AS INTEGER) + CAST(monetary > q[2] AS INTEGER) + CAST(monetary > q[3] AS INTEGER)
                 + CAST(monetary > q[4] AS INTEGER) AS s
          FROM partner_base CROSS JOIN (SELECT quantile_cont(CAST(monetary AS DOUBLE), [0.2, 0.4, 0.6, 0.8]) AS q FROM partner_base
                                        WHERE channel = '{c}' AND monetary > 100000) WHERE channel = '{c}' AND monetary > 100000)
    UNION ALL SELECT partner_id, -2, 'No Aplica', {kind} FROM partner_base WHERE channel = '{c}' AND monetary <= 100000
    UNION ALL SELECT s_suppkey, -1, 'Inactivo', {kind} FROM supplier WHERE s_suppkey NOT IN (SELECT partner_id FROM partner_base WHERE channel = '{c}')"""


@query("assemble_partners", f"""
    SELECT partner_id, segment, segment_name, partner_type, s_nationkey AS contractor_id, s_name AS point_of_sale, DATE '2001-08-01' AS predicted_on
    FROM ({_AMOUNT_NAMED.format(kind=0, c='O')} UNION ALL {_AMOUNT_NAMED.format(kind=2, c='F')}) JOIN supplier ON s_suppkey = partner_id""",
       ["partner_base"])
def _(t):
    return _assembled(t, t.partner_base, {0: "O", 2: "F"})


def _assembled(t: Tables, base, codes: dict):
    registered = t.supplier.select(F.col("s_suppkey").alias("partner_id"))
    channels = {}
    for kind, code in codes.items():
        live, small = G.split_partners(base.filter(F.col("channel") == code))
        scored = G.quantile_score(live, "monetary", drop_duplicates=True)
        name = pick(G.FIVE_TIERS, 5 - F.col("monetary_score"))
        channels[kind] = (scored.withColumns({"cluster": 5 - F.col("monetary_score"), "name": name}), small, registered)
    partners = t.supplier.select(
        F.col("s_suppkey").alias("partner_id"), F.col("s_nationkey").alias("contractor_id"), F.col("s_name").alias("point_of_sale")
    )
    return G.assemble_partners(channels, partners, CREDIT_AS_OF)


@query("kmeans_customers")
def _(t):
    rows = _rfm(t)
    model, out = G.fit_segments(rows, G.SCORES, 5)
    named = G.name_by_magnitude(G.centers(rows, model, G.SCORES))
    return G.attach_names(out, named).select("customer_id", *G.SCORES, "cluster", "name")


@query("kmeans_customers_four")
def _(t):
    rows = _rfm(t)
    model, out = G.fit_segments(rows, G.SCORES, 4)
    return G.attach_names(out, G.name_by_thresholds(G.centers(rows, model, G.SCORES))).select("customer_id", "cluster", "name")


_PARTNER_FEATURES = ["recency_score", "insured", "monetary_score", "return_share_score", "ticket_score", "monetary_6m_score"]


@query("kmeans_partners")
def _(t):
    """Clusters of each channel, fitted to its own partners."""
    out, scored = None, _partners(t, True)
    for channel in ("O", "F"):
        rows = G.segment_channel(scored.filter(F.col("channel") == channel), _PARTNER_FEATURES, 5, G.FIVE_TIERS)
        rows = rows.select("partner_id", "channel", "cluster", "name")
        out = rows if out is None else out.unionByName(rows)
    return out


#: Clusters and names of the three channels.
_CHANNELS = {0: (4, G.FOUR_TIERS), 1: (3, G.FOUR_TIERS[:3]), 2: (5, G.FIVE_TIERS)}


@query("kmeans_channels")
def _(t):
    """Three channels, each with a number of clusters of its own; clusters are named by their amount."""
    out, scored = None, G.partner_scores(G.split_partners(t.partner_channels)[0], True, by="channel")
    for kind, (k, names) in _CHANNELS.items():
        rows = G.segment_channel(scored.filter(F.col("channel") == kind), _PARTNER_FEATURES, k, names).select("partner_id", "channel", "cluster", "name")
        out = rows if out is None else out.unionByName(rows)
    return out


@query("assemble_channels", f"""
    SELECT partner_id, segment, segment_name, partner_type, s_nationkey AS contractor_id, s_name AS point_of_sale, DATE '2001-08-01' AS predicted_on
    FROM ({" UNION ALL ".join(_AMOUNT_NAMED.replace("partner_base", "partner_channels").format(kind=c, c=c) for c in (0, 1, 2))})
    JOIN supplier ON s_suppkey = partner_id""", ["partner_channels"])
def _(t):
    """The segment table of three channels: tiers by amount, partners too small to have one, and the inactive."""
    return _assembled(t, t.partner_channels, {0: 0, 1: 1, 2: 2})


# Clusters are drawn; that each customer has one, and each cluster one name, is not.
@query("kmeans_coverage", """
    SELECT count(*) AS n, count(DISTINCT customer_id) AS customers, CAST(5 AS BIGINT) AS clusters, CAST(1 AS BIGINT) AS most_names FROM rfm""", ["rfm"])
def _(t):
    rows = _rfm(t)
    model, out = G.fit_segments(rows, G.SCORES, 5)
    named = G.attach_names(out, G.name_by_magnitude(G.centers(rows, model, G.SCORES)))
    names = named.groupBy("cluster").agg(F.countDistinct("name").alias("names"), F.count("*").alias("n"), F.countDistinct("customer_id").alias("ids"))
    return names.agg(
        F.sum("n").alias("n"), F.sum("ids").alias("customers"), F.count("*").alias("clusters"), F.max("names").alias("most_names")
    )


@query("segment_quality")
def _(t):
    rows = _rfm(t)
    model, _ = G.fit_segments(rows, G.SCORES, 5)
    rmsd = F.sqrt(F.lit(float(model.stages[-1].summary.trainingCost)) / F.count("*"))
    return rows.agg(F.count("*").alias("n"), rmsd.alias("rmsd")).withColumn(
        "accepted", (F.col("rmsd") > G.QUALITY_RANGE[0]) & (F.col("rmsd") < G.QUALITY_RANGE[1])
    )


@query("pca_2d")
def _(t):
    return G.pca_2d(_rfm(t), G.SCORES).select("customer_id", "pc1", "pc2")


# Supervised models ----------------------------------------------------------------------------

_LABEL = """CASE WHEN arrears_days = 0 THEN CASE WHEN final_arrears_days = 0 THEN 1 ELSE 0 END
                 ELSE CASE WHEN final_arrears_days - arrears_days < 28 THEN 1 ELSE 0 END END"""
_OUTLIERS = " AND ".join(f"{c} <= {v}" for c, v in MD.DEBT_LIMITS.items())
_NUMBERS = [*MD.DEBT_LIMITS, "balance"]


@query("relief_features", f"""
    SELECT * EXCLUDE (contract_id, category, arrears_days, final_arrears_days, arrears_range), least(arrears_range, 480) AS arrears_range,
           {_LABEL} AS label FROM relief WHERE category = 1 AND {_OUTLIERS}""", ["relief"], ["balance"])
def _(t):
    return MD.relief_features(t.relief, True)


@query("relief_features_scoring", """
    SELECT * EXCLUDE (category, arrears_days, final_arrears_days, arrears_range), least(arrears_range, 480) AS arrears_range
    FROM relief WHERE category = 1""", ["relief"], ["balance"])
def _(t):
    return MD.relief_features(t.relief, False)


def _labelled(t: Tables):
    """Relief rows with the label and the order key, which keeps draws repeatable."""
    rows = t.relief.withColumns({"label": MD.relief_label(), "order_id": F.col("contract_id")})
    return MD.relief_features(rows, False).drop("contract_id")


def _prep():
    return MD.prep_pipeline(["place", "refinanced"], ["subcategory", "arrears_range"], _NUMBERS)


def _sides(t: Tables):
    """Training and hold-out rows. Outliers are cut from the training rows only; every row is held to one side by its key."""
    train, held = R.split(t.relief.withColumns({"label": MD.relief_label(), "order_id": F.col("contract_id")}), ["order_id"], 0.8)
    return MD.relief_features(train, True), MD.relief_features(held, False).drop("contract_id")


def _prepared(t: Tables, train=None):
    """Both sides, encoded and scaled as the training rows alone say; ``train``: the training rows, staged."""
    rows, held = _sides(t)
    train = MD.dealt(rows) if train is None else train
    prep = _prep().fit(train)
    return prep.transform(train), prep.transform(held)


def _varying(t: Tables, train=None):
    """Both sides without the columns that are 0 in all rows, the places of the others, and how many there were."""
    rows, held = _sides(t)
    train = MD.dealt(rows) if train is None else train
    whole = _prep().fit(train)
    prep, left = MD.varying_features(whole)
    return prep.transform(train), prep.transform(held), left, len(whole.stages[-1].std)


@query("encoded_features")
def _(t):
    from pyspark.ml.functions import vector_to_array

    train, held = _prepared(t)
    columns = ["order_id", "label", vector_to_array("features").alias("features")]
    return train.select(*columns, F.lit("train").alias("side")).unionByName(held.select(*columns, F.lit("held").alias("side")))


@query("min_max", """
    SELECT order_id, (CAST(gas_current AS DOUBLE) - glo) / (ghi - glo) AS gas_current, (balance - blo) / (bhi - blo) AS balance
    FROM (SELECT contract_id AS order_id, gas_current, balance FROM relief)
    CROSS JOIN (SELECT min(gas_current) AS glo, max(gas_current) AS ghi, min(balance) AS blo, max(balance) AS bhi FROM relief)""",
       ["relief"], ["gas_current", "balance"])
def _(t):
    rows = t.relief.select(F.col("contract_id").alias("order_id"), "gas_current", "balance")
    return R.min_max(rows, ["gas_current", "balance"])


@query("oversample", f"""
    SELECT * FROM (WITH rows AS (SELECT contract_id AS order_id, {_LABEL} AS label FROM relief WHERE category = 1),
         counts AS (SELECT label, count(*) AS n FROM rows GROUP BY 1),
         rule AS (SELECT arg_min(label, (n, label)) AS small, max(n) * 0.8::DOUBLE / min(n) AS factor FROM counts),
         copied AS (SELECT order_id, label, CASE WHEN label = small THEN greatest(CAST(floor(factor) AS BIGINT)
                           + CASE WHEN {draw(["order_id"])} % 1000000 / 1000000::DOUBLE < factor - floor(factor) THEN 1 ELSE 0 END, 1) ELSE 1 END AS copies
                    FROM rows, rule)
    SELECT order_id, label FROM (SELECT order_id, label, unnest(range(copies)) FROM copied))""", ["relief"])
def _(t):
    return MD.oversample(_labelled(t), ["order_id"], ratio=0.8).select("order_id", "label")


def _scored(t: Tables, kind: str, train=None, **params):
    # A forest draws its features by their number, so it has them all.
    train, held = _prepared(t, train) if kind == "forest" else _varying(t, train)[:2]
    model = MD.fit_classifier(kind, MD.oversample(train, ["order_id"]), **params)
    return model, held, MD.score(model, held, ["order_id", "label", "arrears_range"])


@query("score_logistic")
def _(t):
    return _scored(t, "logistic", maxIter=100, regParam=0.01, elasticNetParam=0.05)[2]


# What SQL can say of a fit: which rows are held out, with which label, and that each has a probability.
@query("score_logistic_rows", f"""
    SELECT contract_id AS order_id, {_LABEL} AS label, true AS inside FROM relief
    WHERE category = 1 AND {draw(["contract_id"])} % 1000000 >= 800000""", ["relief"])
def _(t):
    scored = _scored(t, "logistic", maxIter=100, regParam=0.01, elasticNetParam=0.05)[2]
    return scored.select("order_id", "label", F.col("probability").between(0, 1).alias("inside"))


@query("training_rows", f"""
    SELECT contract_id AS order_id, {_LABEL} AS label FROM relief
    WHERE category = 1 AND {_OUTLIERS} AND {draw(["contract_id"])} % 1000000 < 800000""", ["relief"])
def _(t):
    return _sides(t)[0].select("order_id", "label")


@query("score_forest")
def _(t):
    return _scored(t, "forest", numTrees=100, maxDepth=10, seed=7)[2]


@query("score_boosted")
def _(t):
    return _scored(t, "boosted", maxIter=50, maxDepth=8, seed=7)[2]


@query("score_perceptron")
def _(t):
    train, held, left, width = _varying(t)
    model = MD.fit_perceptron(MD.oversample(train, ["order_id"]), [width, 12, 2], left, maxIter=100, seed=7)
    return MD.score(model, held, ["order_id", "label", "arrears_range"])


@query("grid_search")
def _(t):
    """The best point of the grid by folds of the training rows, fitted on all of them, scores the hold-out."""
    train = MD.dealt(_sides(t)[0])
    best, area = MD.grid_search("logistic", train, _grid(), _prep(), ["order_id"], folds=4)
    scored = _scored(t, "logistic", train, **best)[2].drop("arrears_range")
    return scored.withColumns({name: F.lit(float(value)) for name, value in best.items()} | {"fold_area": F.lit(area)})


def _grid():
    return {"maxIter": [100, 500, 1000], "elasticNetParam": [0.01, 0.1, 0.5], "regParam": [0.01]}


@query("halving_search")
def _(t):
    """The point that successive halving keeps of the same grid, fitted on all training rows, scores the hold-out."""
    train = MD.dealt(_sides(t)[0])
    best, area, _ = MD.halving_search("logistic", train, _grid(), _prep(), ["order_id"], folds=4)
    scored = _scored(t, "logistic", train, **best)[2].drop("arrears_range")
    return scored.withColumns({name: F.lit(float(value)) for name, value in best.items()} | {"fold_area": F.lit(area)})


_TRAINING = f"""SELECT contract_id AS order_id, {_LABEL} AS label FROM relief
    WHERE category = 1 AND {_OUTLIERS} AND {draw(["contract_id"])} % 1000000 < 800000"""


@query("halving_rungs", f"""
    SELECT CAST(rung AS INTEGER) AS rung, CAST(points AS INTEGER) AS points, order_id, label FROM (
      WITH rows AS ({_TRAINING}),
           rungs AS (SELECT unnest([0, 1, 2]) AS rung, unnest([9, 3, 1]) AS points,
                            unnest([greatest(1 / 9::DOUBLE, least(1, 200 / n)), greatest(1 / 3::DOUBLE, least(1, 200 / n)), 1]) AS share
                     FROM (SELECT CAST(count(*) AS DOUBLE) AS n FROM rows)),
           asked AS (SELECT * FROM rungs WHERE rung <= (SELECT min(rung) FROM rungs WHERE share >= 1))
      SELECT rung, points, order_id, label FROM rows JOIN asked ON share >= 1 OR {draw(["label", "order_id"], 1)} % 1000000 < round(share * 1000000))""",
       ["relief"])
def _(t):
    """Which training rows each rung of the search reads; a later rung holds all rows of an earlier one."""
    train = _sides(t)[0].select("order_id", "label")
    out = None
    for rung, (points, share) in enumerate(MD.halving_rungs(train.count(), 9)):
        rows = train if share >= 1 else MD.rung_rows(train, ["order_id"], share)
        rows = rows.select(F.lit(rung).alias("rung"), F.lit(points).alias("points"), "order_id", "label")
        out = rows if out is None else out.unionByName(rows)
    return out


@query("score_adaptive")
def _(t):
    train, held = _varying(t)[:2]
    model = MD.fit_adaptive(MD.oversample(train, ["order_id"]).select("label", "features"), rounds=20)
    return model.transform(held).select("order_id", "label", "arrears_range", F.col("probability_1").alias("probability"))


@query("reloaded_scores")
def _(t):
    """Training writes preparation and model as one; prediction loads them and takes raw rows."""
    train, held = _sides(t)
    path = f"{shared_folder(t.spark)}/model-{uuid.uuid4().hex}"
    MD.save_model(MD.train_pipeline("logistic", train, _prep(), ["order_id"], maxIter=100, regParam=0.01, elasticNetParam=0.05), path)
    return MD.score(MD.load_model(path), held, ["order_id", "label"])


@query("reloaded_score_rows", f"""
    SELECT contract_id AS order_id, {_LABEL} AS label, true AS inside, true AS same FROM relief
    WHERE category = 1 AND {draw(["contract_id"])} % 1000000 >= 800000""", ["relief"])
def _(t):
    """Every held-out row has a probability, and the one that the model gave before it was written."""
    train, held = _sides(t)
    path = f"{shared_folder(t.spark)}/model-{uuid.uuid4().hex}"
    model = MD.train_pipeline("logistic", train, _prep(), ["order_id"], maxIter=100, regParam=0.01, elasticNetParam=0.05)
    MD.save_model(model, path)
    keys = ["order_id", "label"]
    # Both models score each row side by side, so repeated keys need no join.
    both = MD.score(model, held, [*held.columns]).withColumnRenamed("probability", "before")
    after = MD.score(MD.load_model(path), both, [*keys, "before"])
    p = F.col("probability")
    return after.select(*keys, p.between(0, 1).alias("inside"), (F.abs(p - F.col("before")) < 1e-12).alias("same"))


@query("importances")
def _(t):
    model, held, _ = _scored(t, "forest", numTrees=100, maxDepth=10, seed=7)
    return MD.importances(held, model)


# A score without training, so that the evaluation tables can be compared with SQL: the share of a price band.
_RULE = """(SELECT contract_id AS order_id, arrears_range, CASE WHEN arrears_range = 0 THEN '0' WHEN arrears_range <= 90 THEN '1-90' ELSE '>90' END AS slice,
             LABEL AS label, CAST((gas_current // 6) % 1000 AS DOUBLE) / 1000 AS probability,
             CASE WHEN (gas_current // 6) % 1000 >= 500 THEN 1.0::DOUBLE ELSE 0.0 END AS prediction FROM relief)""".replace("LABEL", _LABEL)


def _ruled(t: Tables):
    share = (F.expr("gas_current div 6") % 1000).cast("double") / 1000
    return t.relief.select(
        F.col("contract_id").alias("order_id"), MD.arrears_slice("arrears_range").alias("slice"), MD.relief_label().alias("label"),
        share.alias("probability"), F.when(share >= 0.5, 1.0).otherwise(0.0).alias("prediction"),
    )


@query("evaluate_slices", f"""
    SELECT slice, n, positives, CAST(hit AS DOUBLE) / n AS accuracy, CAST(tp AS DOUBLE) / said AS "precision", CAST(tp AS DOUBLE) / positives AS recall,
           2 * (CAST(tp AS DOUBLE) / said) * (CAST(tp AS DOUBLE) / positives) / (CAST(tp AS DOUBLE) / said + CAST(tp AS DOUBLE) / positives) AS f1
    FROM (SELECT slice, count(*) AS n, count(*) FILTER (label = 1) AS positives, count(*) FILTER (label = prediction) AS hit,
                 count(*) FILTER (prediction = 1) AS said, count(*) FILTER (prediction = 1 AND label = 1) AS tp FROM {_RULE} GROUP BY 1)""",
       ["relief"], ["accuracy", '"precision"', "recall", "f1"])
def _(t):
    return MD.evaluate(_ruled(t), ["slice"])


@query("boost_round", f"""
    SELECT order_id, CASE WHEN label <> prediction THEN sqrt((1 - error) / error) ELSE sqrt(error / (1 - error)) END
                     * n / (wrong * sqrt((1 - error) / error) + (n - wrong) * sqrt(error / (1 - error))) AS weight
    FROM (SELECT *, wrong / n AS error FROM (
      SELECT order_id, label, prediction, CAST(count(*) FILTER (label <> prediction) OVER () AS DOUBLE) AS wrong, CAST(count(*) OVER () AS DOUBLE) AS n FROM {_RULE}))""",
       ["relief"], ["weight"])
def _(t):
    """Weights after one round of adaptive boosting whose learner is the price-band rule."""
    return MD.boost_weights(_ruled(t).withColumn("weight", F.lit(1.0)))[0].select("order_id", "weight")


@query("confusion", f"SELECT label, prediction, count(*) AS n FROM {_RULE} GROUP BY 1, 2", ["relief"], ["prediction"])
def _(t):
    return MD.confusion(_ruled(t))


@query("calibration", f"""
    SELECT least(CAST(floor(probability * 20) AS BIGINT), 19) AS bin, count(*) AS n, avg(probability) AS predicted, avg(label) AS observed
    FROM {_RULE} GROUP BY 1""", ["relief"], ["predicted", "observed"])
def _(t):
    return MD.calibration(_ruled(t))


@query("roc_auc", f"""
    SELECT CAST(pos AS BIGINT) AS positives, CAST(neg AS BIGINT) AS negatives, (ranks - pos * (pos + 1) / 2) / (pos * neg) AS auc
    FROM (SELECT sum(label)::DOUBLE AS pos, (count(*) - sum(label))::DOUBLE AS neg, sum(CASE WHEN label = 1 THEN r END) AS ranks
          FROM (SELECT label, avg(rn) OVER (PARTITION BY probability) AS r
                FROM (SELECT label, probability, row_number() OVER (ORDER BY probability) AS rn FROM {_RULE})))""", ["relief"], ["auc"])
def _(t):
    return MD.roc_auc(_ruled(t))


@query("corr_matrix", """
    SELECT unnest(['gas_current', 'gas_current', 'balance', 'balance', 'gas_current', 'arrears_range', 'balance', 'arrears_range', 'arrears_range']) AS a,
           unnest(['gas_current', 'balance', 'gas_current', 'balance', 'arrears_range', 'gas_current', 'arrears_range', 'balance', 'arrears_range']) AS b,
           unnest([1.0::DOUBLE, gb, gb, 1.0, ga, ga, ba, ba, 1.0]) AS r
    FROM (SELECT corr(gas_current, balance) AS gb, corr(gas_current, arrears_range) AS ga, corr(balance, arrears_range) AS ba FROM relief)""",
       ["relief"], ["r"])
def _(t):
    return ST.corr_matrix(t.relief, ["gas_current", "balance", "arrears_range"])


@query("select_correlated", """
    SELECT feature, r FROM (SELECT unnest(['final_arrears_days', 'arrears_days', 'balance']) AS feature, unnest([f, a, b]) AS r
      FROM (SELECT corr(final_arrears_days, label) AS f, corr(arrears_days, label) AS a, corr(balance, label) AS b
            FROM (SELECT *, LABEL AS label FROM relief))) WHERE abs(r) >= 0.2""".replace("LABEL", _LABEL), ["relief"], ["r"])
def _(t):
    rows = t.relief.withColumn("label", MD.relief_label())
    return ST.select_correlated(rows, ["final_arrears_days", "arrears_days", "balance", "label"], "label")


@query("class_share", f"""
    SELECT label, count(*) AS n, CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM relief) AS share
    FROM (SELECT {_LABEL} AS label FROM relief) GROUP BY 1""", ["relief"], ["share"])
def _(t):
    return R.class_share(t.relief.select(MD.relief_label().alias("label")), "label")


@query("feature_lookup", """
    SELECT o_orderkey, customer_id, r_score, m_score, f_score FROM (SELECT o_orderkey, o_custkey AS customer_id FROM orders)
    LEFT JOIN (SELECT customer_id, r_score, m_score, f_score FROM rfm) USING (customer_id)""", ["rfm"])
def _(t):
    orders = t.orders.select("o_orderkey", F.col("o_custkey").alias("customer_id"))
    return FT.feature_lookup(orders, _rfm(t), "customer_id", G.SCORES)


@query("score_batch")
def _(t):
    rows = _rfm(t)
    model, _ = G.fit_segments(rows, G.SCORES, 5)
    keys = rows.select("customer_id")
    return FT.score_batch(model, keys, rows, "customer_id", G.SCORES).select("customer_id", "cluster")
