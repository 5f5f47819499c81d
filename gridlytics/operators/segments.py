"""Customer and partner segmentation: quantile scores, k-means, naming, assembly."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlytics.functions.columns import pick, to_date
from gridlytics.operators.ranks import quantiles
from gridlytics.operators.relational import except_keys, first_per_key
from gridlytics.sources.staging import staged

# Last active month, least partner amount, accepted return share, accepted range of the
# centroid deviation, and the names and codes of the groups outside the clusters.
LAST_ACTIVE_MONTH, LEAST_AMOUNT, ACCEPTED_RETURNS = 49, 100_000, 0.05
QUALITY_RANGE = (1.0, 1.35)
INACTIVE, INACTIVE_PARTNER, NOT_APPLICABLE = "Inactivos", "Inactivo", "No Aplica"
# Segment names from the best to the worst amount score.
FOUR_TIERS = ("Premium", "Elite", "Plus", "Estandar")
FIVE_TIERS = ("Diamante", "Platino", "Oro", "Plata", "Bronce")
SCORES = ["r_score", "m_score", "f_score"]


def quantile_edges(df: DataFrame, cols: Sequence[str], q: int = 5, by: str | None = None) -> Column:
    """Interpolated quantile edges of several columns as one map, a scalar subquery of a single pass.

    The values are unpivoted and ranked per column name, so the frame is not read once per column. With ``by`` the edges of each group
    are its own, and an entry's name is that of the group, a bar and the column.
    """
    name = lambda c: F.lit(c) if by is None else F.concat(F.col(by).cast("string"), F.lit(f"|{c}"))
    entries = F.array(*[F.struct(name(c).alias("name"), F.col(c).cast("double").alias("v")) for c in cols])
    long = df.select(F.explode(entries).alias("e")).select("e.name", "e.v")
    edges = quantiles(long, "v", [i / q for i in range(q + 1)], ["name"])
    # One entry per scored column, and group of a handful.
    return edges.filter(F.col("name").isNotNull()).agg(F.map_from_entries(F.collect_list(F.struct("name", "q")))).scalar()


def quantile_scores(
    df: DataFrame, cols: Sequence[str], q: int = 5, reverse: Sequence[str] = (), drop_duplicates: bool = False,
    names: Mapping[str, str] | None = None, by: str | None = None,
) -> DataFrame:
    """Scores 1..q by interpolated quantile edges; a value on an edge falls in the lower bin.

    Repeated edges raise unless ``drop_duplicates``; then the bins merge. A ``reverse`` column gives its lowest
    bin score ``q``. With ``by`` each group is scored by its own edges, all in the same pass.
    """
    names = names or {}
    out = df.withColumn("_edges", quantile_edges(df, cols, q, by))
    scores = {}
    for c in cols:
        key = c if by is None else F.concat(F.col(by).cast("string"), F.lit(f"|{c}"))
        value, edges = F.col(c).cast("double"), F.array_distinct(F.col("_edges")[key])
        if not drop_duplicates:
            clash = F.raise_error(F.lit(f"quantile edges of {c} are not unique"))
            edges = F.when(F.size(edges) < q + 1, clash).otherwise(edges)
        # Edge 0 is the minimum and the last one the maximum, which no value exceeds; a missing edge is not exceeded.
        above = sum((F.when(value > F.get(edges, F.lit(i)), 1).otherwise(0) for i in range(1, q)), F.lit(0))
        score = F.lit(q) - above if c in reverse else above + 1
        scores[names.get(c, f"{c}_score")] = F.when(value.isNotNull(), score)
    return out.withColumns(scores).drop("_edges")


def quantile_score(df: DataFrame, col: str, q: int = 5, reverse: bool = False, drop_duplicates: bool = False, alias: str | None = None) -> DataFrame:
    """:func:`quantile_scores` of one column."""
    names = {col: alias} if alias else None
    return quantile_scores(df, [col], q, [col] if reverse else (), drop_duplicates, names)


def width_score(df: DataFrame, col: str, q: int = 5, alias: str | None = None, by: str | None = None) -> DataFrame:
    """Score q..1 by equal-width bins, right-closed; the minimum belongs to the first bin. With ``by`` each group has its own bins."""
    ends = F.struct(F.min(col).cast("double").alias("lo"), F.max(col).cast("double").alias("hi"))
    if by is None:
        limits = df.agg(ends.alias("ends")).scalar()
    else:
        groups = df.filter(F.col(by).isNotNull()).groupBy(F.col(by).cast("string").alias("name")).agg(ends.alias("ends"))
        limits = groups.agg(F.map_from_entries(F.collect_list(F.struct("name", "ends")))).scalar()[F.col(by).cast("string")]
    lo, hi = limits["lo"], limits["hi"]
    value = F.col(col).cast("double")
    above = sum((F.when(value > lo + (hi - lo) * i / q, 1).otherwise(0) for i in range(1, q)), F.lit(0))
    return df.withColumn(alias or f"{col}_score", F.when(value.isNotNull(), F.lit(q) - above))


def frequency_score(col: str) -> Column:
    """1, 2 and 3 as they are, 4 and 5 score 4, more scores 5; anything below 1 has no score."""
    value = F.col(col)
    return F.when(value.between(1, 3), value.cast("int")).when(value.between(4, 5), 4).when(value >= 6, 5)


def return_flag(returns: str, sales: str) -> Column:
    return F.when(F.try_divide(F.col(returns).cast("double"), F.col(sales).cast("double")) <= ACCEPTED_RETURNS, 0).otherwise(1)


def split_activity(df: DataFrame, recency: str = "recency", frequency: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Active and inactive customers by months since the last purchase; a zero frequency is dropped from the active."""
    active = df.filter(F.col(recency) <= LAST_ACTIVE_MONTH)
    if frequency:
        active = active.filter(F.col(frequency) != 0)
    return active, df.filter(F.col(recency) > LAST_ACTIVE_MONTH)


def split_partners(df: DataFrame, amount: str = "monetary") -> tuple[DataFrame, DataFrame]:
    """Partners in the clusters and those whose amount is too small to apply."""
    return df.filter(F.col(amount) > LEAST_AMOUNT), df.filter(F.col(amount) <= LEAST_AMOUNT)


def rfm_scores(df: DataFrame, drop_duplicates: bool = False) -> DataFrame:
    """Recency (reversed), monetary and frequency scores of active customers, with the RFM code.

    The base is read for the edges and again for the rows, so it is staged once.
    """
    names = {"recency": "r_score", "monetary": "m_score"}
    out = quantile_scores(staged(df), list(names), reverse=["recency"], drop_duplicates=drop_duplicates, names=names)
    return out.withColumn("f_score", frequency_score("frequency")).withColumn("rfm_code", rfm_code())


def rfm_code() -> Column:
    return F.concat(*[F.col(c).cast("string") for c in ("r_score", "f_score", "m_score")])


def partner_scores(df: DataFrame, flag_returns: bool = False, by: str | None = None) -> DataFrame:
    """Scores of a partner channel, or with ``by`` of each; the return share is scored by quantiles or as a flag. The base is staged once."""
    share = F.try_divide(F.col("returns").cast("double"), F.col("sales").cast("double"))
    base = staged(df.withColumn("return_share", share))
    cols = ["monetary", "ticket", "term", "monetary_6m", "sales"]
    if not flag_returns:
        cols.append("return_share")
    out = quantile_scores(width_score(base, "recency", by=by), cols, drop_duplicates=True, by=by)
    return out.withColumn("return_share_score", return_flag("returns", "sales")) if flag_returns else out


def fit_segments(df: DataFrame, cols: Sequence[str], k: int, seed: int = 0):
    """K-means over score columns: the model and the rows with their cluster."""
    from pyspark.ml import Pipeline
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    stages = [
        VectorAssembler(inputCols=list(cols), outputCol="features"),
        KMeans(k=k, seed=seed, featuresCol="features", predictionCol="cluster"),
    ]
    model = Pipeline(stages=stages).fit(df)
    return model, model.transform(df).drop("features")


def centers(df: DataFrame, model, cols: Sequence[str]) -> DataFrame:
    """The k cluster centres as rows."""
    rows = [(i, *map(float, c)) for i, c in enumerate(model.stages[-1].clusterCenters())]
    return df.sparkSession.createDataFrame(rows, ["cluster", *cols])


def segment_quality(model, n: int) -> float:
    """Root mean squared distance to the centres."""
    return (model.stages[-1].summary.trainingCost / n) ** 0.5


def is_acceptable(rmsd: float) -> bool:
    return QUALITY_RANGE[0] < rmsd < QUALITY_RANGE[1]


def _magnitude(cols: Sequence[str]) -> Column:
    return F.sqrt(sum((F.col(c) * F.col(c) for c in cols), F.lit(0.0)))


def name_by_amount(clusters: DataFrame, amount: str = "monetary_score", names: Sequence[str] = FIVE_TIERS) -> DataFrame:
    """Name centres from the largest amount score down. One row per cluster, so ranking them is a fixed cost."""
    rank = F.row_number().over(Window.partitionBy().orderBy(F.col(amount).desc(), "cluster"))
    return clusters.withColumn("name", pick(names, rank - 1))


def name_by_magnitude(clusters: DataFrame, names: Sequence[str] = FIVE_TIERS) -> DataFrame:
    """Name centres from the largest score vector down."""
    out = clusters.withColumn("magnitude", _magnitude(SCORES))
    return name_by_amount(out, "magnitude", names)


def name_by_thresholds(clusters: DataFrame) -> DataFrame:
    """Largest vector Diamante, smallest Bronce; of the others, recent and rare buyers Nuevo, the opposite Plata."""
    everything = Window.partitionBy()
    out = clusters.withColumn("magnitude", _magnitude(SCORES))
    out = out.withColumns({"_hi": F.max("magnitude").over(everything), "_lo": F.min("magnitude").over(everything)})
    r, f, m = F.col("r_score"), F.col("f_score"), F.col("magnitude")
    name = (
        F.when(m == F.col("_hi"), "Diamante").when(m == F.col("_lo"), "Bronce")
        .when((r > 3.5) & (f < 2.3), "Nuevo").when((r < 3.5) & (f > 2.3), "Plata")
    )
    return out.withColumn("name", name).drop("_hi", "_lo")


def name_by_loyalty(clusters: DataFrame) -> DataFrame:
    """Diamante and Hibernando by vector size; the second smallest keeps its money; frequent buyers outside the
    largest vector must not be lost; the rest are newcomers."""
    everything = Window.partitionBy()
    out = clusters.withColumn("magnitude", _magnitude(SCORES)).withColumns({
        "_up": F.row_number().over(everything.orderBy("magnitude", "cluster")),
        "_down": F.row_number().over(everything.orderBy(F.col("magnitude").desc(), "cluster")),
        "_often": F.row_number().over(everything.orderBy(F.col("f_score").desc(), "cluster")),
    })
    name = (
        F.when((F.col("_often") <= 2) & (F.col("_up") <= 4), "No puedo perder")
        .when(F.col("_up") == 2, "Primiparos con plata")
        .when(F.col("_down") == 1, "Diamante").when(F.col("_up") == 1, "Hibernando")
        .otherwise("Primiparo")
    )
    return out.withColumn("name", name).drop("_up", "_down", "_often")


def attach_names(df: DataFrame, named: DataFrame) -> DataFrame:
    return df.join(named.select("cluster", "name"), "cluster", "left")


def segment_channel(scored: DataFrame, cols: Sequence[str], k: int, names: Sequence[str], seed: int = 0) -> DataFrame:
    """The partners of a channel with their cluster and its name, given by the clusters' mean amount score."""
    model, out = fit_segments(scored, cols, k, seed)
    return attach_names(out, name_by_amount(centers(scored, model, cols), names=names))


def assemble_customers(named: DataFrame, inactive: DataFrame, as_of, inactive_code: int = 4) -> DataFrame:
    """Segment table of customers: named active ones and the inactive."""
    cols = ["customer_id", "segment", "segment_name"]
    live = named.select("customer_id", F.col("cluster").cast("int").alias("segment"), F.col("name").alias("segment_name"))
    idle = inactive.select("customer_id", F.lit(inactive_code).alias("segment"), F.lit(INACTIVE).alias("segment_name"))
    return live.unionByName(idle).select(*cols, F.lit(to_date(as_of)).alias("predicted_on"))


def assemble_partners(
    channels: Mapping[int, tuple[DataFrame, DataFrame, DataFrame]], partners: DataFrame, as_of
) -> DataFrame:
    """Segment table of all partner channels.

    Each channel gives its named partners, its not applicable ones and all registered ids; registered
    ids in neither group are inactive. ``partners`` maps an id to its contractor and point of sale.
    """
    out = None
    for kind, (named, too_small, registered) in channels.items():
        rows = named.select("partner_id", F.col("cluster").cast("int").alias("segment"), F.col("name").alias("segment_name"))
        rows = rows.unionByName(
            too_small.select("partner_id", F.lit(-2).alias("segment"), F.lit(NOT_APPLICABLE).alias("segment_name"))
        )
        idle = except_keys(registered.select("partner_id"), named.select("partner_id"), too_small.select("partner_id"))
        rows = rows.unionByName(
            idle.select("partner_id", F.lit(-1).alias("segment"), F.lit(INACTIVE_PARTNER).alias("segment_name"))
        ).withColumn("partner_type", F.lit(kind))
        out = rows if out is None else out.unionByName(rows)
    return out.join(partners, "partner_id", "left").withColumn("predicted_on", F.lit(to_date(as_of)))


def segment_summary(df: DataFrame, segment: str, cols: Sequence[str]) -> DataFrame:
    return df.groupBy(segment).agg(F.count("*").alias("n"), *[F.avg(c).alias(f"avg_{c}") for c in cols])


def sample_per_code(df: DataFrame, code: str = "rfm_code", key: str = "customer_id") -> DataFrame:
    """One representative row per RFM code."""
    return first_per_key(df, [code], [F.col(key)])


def pca_2d(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Coordinates of the rows on the first two principal components of the score columns."""
    from pyspark.ml.feature import PCA, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    vectors = VectorAssembler(inputCols=list(cols), outputCol="features").transform(df)
    model = PCA(k=2, inputCol="features", outputCol="pc").fit(vectors)
    xy = vector_to_array("pc")
    return model.transform(vectors).withColumns({"pc1": xy[0], "pc2": xy[1]}).drop("features", "pc")
