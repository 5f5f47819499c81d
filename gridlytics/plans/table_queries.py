"""Relational operators over the given tables."""

from __future__ import annotations

import datetime as dt
import math

from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridlytics.functions import columns as X
from gridlytics.operators import ranks as RK
from gridlytics.operators import relational as R
from gridlytics.plans.registry import query
from gridlytics.plans.tails import draw
from gridlytics.sources import tables as TB


@query("conform", """
    SELECT CAST(o_orderkey AS INTEGER) AS o_orderkey, CAST(o_totalprice AS BIGINT) AS o_totalprice, TRY_CAST(left(o_orderpriority, 1) AS INTEGER) AS o_orderpriority,
           CAST(o_orderdate AS DATE) AS o_orderdate
    FROM (SELECT o_orderkey, trunc(o_totalprice) AS o_totalprice, o_orderpriority, o_orderdate FROM orders)""")
def _(t):
    wanted = T.StructType([
        T.StructField("o_orderkey", T.IntegerType()), T.StructField("o_totalprice", T.LongType()),
        T.StructField("o_orderpriority", T.IntegerType()), T.StructField("o_orderdate", T.DateType()),
    ])
    return TB.conform(t.orders.withColumn("o_orderpriority", F.substring("o_orderpriority", 1, 1)), wanted)


@query("rename_all", "SELECT n_nationkey AS id, n_name AS name, n_regionkey AS parent FROM nation")
def _(t):
    return R.rename_all(t.nation, ["id", "name", "parent"])


@query("predicates", """
    SELECT l_orderkey, l_linenumber FROM lineitem
    WHERE l_quantity BETWEEN 10 AND 40 AND l_returnflag IN ('A', 'R') AND l_linenumber NOT IN (4, 7)
      AND l_shipdate >= DATE '1997-01-01' AND l_discount <> 0.05""")
def _(t):
    return t.lineitem.filter(
        F.col("l_quantity").between(10, 40) & F.col("l_returnflag").isin("A", "R") & ~F.col("l_linenumber").isin(4, 7)
        & (F.col("l_shipdate") >= F.lit(dt.datetime(1997, 1, 1)).cast("timestamp_ntz")) & (F.col("l_discount") != 0.05)
    ).select("l_orderkey", "l_linenumber")


@query("price_bands", """
    SELECT CASE WHEN o_totalprice <= 50000 THEN 'bajo' WHEN o_totalprice <= 200000 THEN 'medio' ELSE 'alto' END AS band, count(*) AS n
    FROM orders GROUP BY 1""")
def _(t):
    band = X.band("o_totalprice", [50000, 200000], ["bajo", "medio", "alto"])
    return t.orders.groupBy(band.alias("band")).agg(F.count("*").alias("n"))


@query("clip", "SELECT c_custkey, least(greatest(c_acctbal, 0), 5000) AS c_acctbal FROM customer", [], ["c_acctbal"])
def _(t):
    return t.customer.select("c_custkey", X.clip("c_acctbal", 0.0, 5000.0).alias("c_acctbal"))


@query("fill", """
    SELECT l.doc_id, coalesce(quality, -1) AS quality, coalesce(toxic, 0) AS toxic FROM documents l LEFT JOIN labels USING (doc_id)""")
def _(t):
    rows = t.documents.select("doc_id").join(t.labels, "doc_id", "left")
    return R.fill(rows, {"quality": -1, "toxic": 0})


@query("clean_comments", "SELECT page_id, replace(url, '/', ' , ') AS url FROM pages")
def _(t):
    return t.pages.select("page_id", X.clean_comment("url").alias("url"))


@query("first_per_key", """
    SELECT o_custkey, o_orderkey, o_totalprice FROM (
      SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn = 1""",
       [], ["o_totalprice"])
def _(t):
    rows = t.orders.select("o_custkey", "o_orderkey", "o_totalprice")
    return R.first_per_key(rows, ["o_custkey"], [F.col("o_totalprice").desc(), F.col("o_orderkey")])


@query("latest_rows", """
    SELECT o_custkey, o_orderkey FROM orders WHERE (o_custkey, o_orderdate) IN (SELECT (o_custkey, max(o_orderdate)) FROM orders GROUP BY o_custkey)""")
def _(t):
    return R.latest_rows(t.orders.select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], "o_orderdate").drop("o_orderdate")


@query("latest_snapshot", "SELECT l_orderkey, l_linenumber, l_suppkey FROM lineitem WHERE l_shipdate = (SELECT max(l_shipdate) FROM lineitem)")
def _(t):
    return R.latest_snapshot(t.lineitem, "l_shipdate").select("l_orderkey", "l_linenumber", "l_suppkey")


@query("top_k", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 20", [], ["c_acctbal"])
def _(t):
    return R.top_k(t.customer.select("c_custkey", "c_acctbal"), "c_acctbal", 20, ties=["c_custkey"])


@query("second_largest", """
    SELECT p_partkey, p_retailprice FROM part WHERE p_retailprice = (SELECT min(v) FROM (SELECT p_retailprice AS v FROM part ORDER BY 1 DESC LIMIT 2))""",
       [], ["p_retailprice"])
def _(t):
    return R.nth_largest(t.part.select("p_partkey", "p_retailprice"), "p_retailprice", 2)


@query("except_keys", """
    SELECT c_custkey AS id FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 250000
    EXCEPT SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 250000""")
def _(t):
    ids = t.customer.select(F.col("c_custkey").alias("id"))
    high = t.orders.filter(F.col("o_totalprice") > 250000)
    done = high.filter(F.col("o_orderstatus") == "F").select(F.col("o_custkey").alias("id"))
    urgent = high.filter(F.col("o_orderpriority") == "1-URGENT").select(F.col("o_custkey").alias("id"))
    return R.except_keys(ids, done, urgent)


@query("distinct_values", "SELECT DISTINCT c_mktsegment, c_nationkey FROM customer")
def _(t):
    return t.customer.select("c_mktsegment", "c_nationkey").distinct()


@query("semi_join", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000)")
def _(t):
    big = t.orders.filter(F.col("o_totalprice") > 450000).select(F.col("o_custkey").alias("c_custkey"))
    return t.customer.select("c_custkey").join(big, "c_custkey", "left_semi")


@query("left_join_on_condition", """
    SELECT c_custkey, count(o_orderkey) AS urgent FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderpriority = '1-URGENT' GROUP BY 1""")
def _(t):
    # The constant predicate belongs to the join, so customers without such an order stay.
    same = (F.col("o_custkey") == F.col("c_custkey")) & (F.col("o_orderpriority") == "1-URGENT")
    return t.customer.join(t.orders, same, "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("urgent"))


@query("sample_split", f"""
    SELECT o_orderkey, CASE WHEN {draw(["o_orderkey"], 3)} % 1000000 < 800000 THEN 'train' ELSE 'test' END AS side FROM orders""")
def _(t):
    train, test = R.split(t.orders, ["o_orderkey"], 0.8, seed=3)
    return train.select("o_orderkey", F.lit("train").alias("side")).unionByName(test.select("o_orderkey", F.lit("test").alias("side")))


_POISSON = " + ".join(
    f"CASE WHEN p >= {sum(math.exp(-0.5) * 0.5**j / math.factorial(j) for j in range(k + 1))!r}::DOUBLE THEN 1 ELSE 0 END" for k in range(8)
)


@query("sample_replaced", f"""
    SELECT o_orderkey, unnest(range(1, copies + 1)) AS copy FROM (
      SELECT o_orderkey, {_POISSON} AS copies FROM (
        SELECT o_orderkey, {draw(["o_orderkey"], 5)} % 1000000 / 1000000::DOUBLE AS p FROM orders)) WHERE copies > 0""")
def _(t):
    from pyspark.sql import Window

    rows = R.sample(t.orders, ["o_orderkey"], 0.5, replace=True, seed=5)
    copy = F.row_number().over(Window.partitionBy("o_orderkey").orderBy("o_orderkey")).cast("long")
    return rows.select("o_orderkey", copy.alias("copy"))


@query("sql_over_view", """
    SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_totalprice > 100000 GROUP BY 1""")
def _(t):
    return TB.run_sql(t.spark, "SELECT o_orderpriority, count(*) AS n FROM {facts} WHERE o_totalprice > 100000 GROUP BY 1", facts=t.orders)


@query("positive_share", """
    SELECT l_suppkey, count(l_discount) AS n, CAST(count(*) FILTER (l_discount > 0) AS DOUBLE) / count(l_discount) AS positive_share
    FROM lineitem GROUP BY 1""", (), ["positive_share"])
def _(t):
    return R.positive_share(t.lineitem, ["l_suppkey"], "l_discount")


@query("sample_cap", f"""
    SELECT o_orderkey, o_custkey FROM (SELECT o_orderkey, o_custkey, {draw(["o_orderkey"], 3)} AS h FROM orders)
    ORDER BY h % 65536, h, o_orderkey LIMIT 1000""")
def _(t):
    return R.sample_cap(t.orders, 1000, ["o_orderkey"], seed=3).select("o_orderkey", "o_custkey")


@query("ordinal", """
    SELECT l_suppkey, l_partkey, l_linenumber, l_orderkey, code FROM lineitem JOIN (
      SELECT l_suppkey, row_number() OVER (ORDER BY min(l_shipdate), l_suppkey) - 1 AS code FROM lineitem GROUP BY 1) USING (l_suppkey)""")
def _(t):
    rows = t.lineitem.select("l_suppkey", "l_partkey", "l_linenumber", "l_orderkey", F.col("l_shipdate").cast("date").alias("day"))
    return R.ordinal(rows, "l_suppkey", "day", "code").drop("day")


@query("one_hot", """
    SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 1 ELSE 0 END AS "c_mktsegment_BUILDING",
           CASE WHEN c_mktsegment = 'MACHINERY' THEN 1 ELSE 0 END AS "c_mktsegment_MACHINERY" FROM customer""")
def _(t):
    return R.one_hot(t.customer.select("c_custkey", "c_mktsegment"), {"c_mktsegment": ["BUILDING", "MACHINERY"]})


@query("ratios", """
    SELECT l_suppkey, returned, open, lines, coalesce(CAST(returned AS DOUBLE) / nullif(open, 0), 0) AS ratio_returned, coalesce(CAST(lines AS DOUBLE) / nullif(open, 0), 0) AS ratio_lines
    FROM (SELECT l_suppkey, count(*) FILTER (l_returnflag = 'R') AS returned, count(*) FILTER (l_linestatus = 'O') AS open, count(*) AS lines FROM lineitem GROUP BY 1)""",
       [], ["ratio_returned", "ratio_lines"])
def _(t):
    rows = t.lineitem.groupBy("l_suppkey").agg(
        F.count_if(F.col("l_returnflag") == "R").alias("returned"), F.count_if(F.col("l_linestatus") == "O").alias("open"), F.count("*").alias("lines")
    )
    return R.ratios(rows, ["returned", "lines"], "open", fill_with=0)


@query("calendar_parts", """
    SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, CAST(month(o_orderdate) AS INTEGER) AS month, CAST(year(o_orderdate) AS INTEGER) AS year,
           month(o_orderdate)::VARCHAR || '-' || year(o_orderdate)::VARCHAR AS month_year,
           ['Lunes', 'Martes', 'Miercoles', 'Jueves', 'Viernes', 'Sabado', 'Domingo'][isodow(o_orderdate)] AS weekday_name,
           ['Enero', 'Febrero', 'Marzo', 'Abril', 'Mayo', 'Junio', 'Julio', 'Agosto', 'Septiembre', 'Octubre', 'Noviembre', 'Diciembre'][month(o_orderdate)] AS month_name
    FROM orders""")
def _(t):
    return R.calendar_parts(t.orders.select("o_orderkey", F.col("o_orderdate").cast("date").alias("day")), "day")


@query("null_counts", """
    SELECT unnest(['doc_id', 'quality', 'toxic']) AS column_name, unnest([a, b, c]) AS nulls
    FROM (SELECT count(*) FILTER (doc_id IS NULL) AS a, count(*) FILTER (quality IS NULL) AS b, count(*) FILTER (toxic IS NULL) AS c
          FROM documents LEFT JOIN labels USING (doc_id))""")
def _(t):
    return R.null_counts(t.documents.select("doc_id").join(t.labels, "doc_id", "left"))


@query("quantiles_by_priority", """
    SELECT o_orderpriority, quantile_cont(o_totalprice, 0.2) AS q20, quantile_cont(o_totalprice, 0.5) AS q50, quantile_cont(o_totalprice, 0.99) AS q99
    FROM orders GROUP BY 1""", [], ["q20", "q50", "q99"])
def _(t):
    q = RK.quantiles(t.orders, "o_totalprice", [0.2, 0.5, 0.99], ["o_orderpriority"])
    return q.select("o_orderpriority", *[F.col("q")[i].alias(n) for i, n in enumerate(("q20", "q50", "q99"))])


@query("mode_by_customer", """
    SELECT o_custkey, mode FROM (SELECT o_custkey, o_orderpriority AS mode, row_number() OVER (PARTITION BY o_custkey ORDER BY count(*) DESC, o_orderpriority) AS rn
    FROM orders GROUP BY 1, 2) WHERE rn = 1""")
def _(t):
    return RK.mode_by(t.orders, ["o_custkey"], "o_orderpriority")


@query("ranked_values", """
    SELECT l_returnflag, l_quantity AS value, count(*) AS n, CAST(sum(count(*)) OVER (PARTITION BY l_returnflag ORDER BY l_quantity) - count(*) AS BIGINT) AS below,
           CAST(sum(count(*)) OVER (PARTITION BY l_returnflag) AS BIGINT) AS total FROM lineitem GROUP BY 1, 2""", [], ["value"])
def _(t):
    return RK.ranked_values(t.lineitem, "l_quantity", ["l_returnflag"])


@query("conditional_averages", """
    SELECT l_suppkey, avg(CASE WHEN l_linestatus = 'O' THEN l_quantity ELSE 0 END) AS open_avg, avg(l_quantity) FILTER (l_linestatus = 'O') AS open_only_avg,
           count(DISTINCT CASE WHEN l_returnflag = 'R' THEN l_partkey END) AS returned_parts,
           CASE WHEN max(l_quantity) <= 30 THEN 'corto' WHEN max(l_quantity) <= 49 THEN 'medio' ELSE 'largo' END AS class FROM lineitem GROUP BY 1""",
       [], ["open_avg", "open_only_avg"])
def _(t):
    q, still = F.col("l_quantity"), F.col("l_linestatus") == "O"
    return t.lineitem.groupBy("l_suppkey").agg(
        F.avg(F.when(still, q).otherwise(0.0)).alias("open_avg"), F.avg(F.when(still, q)).alias("open_only_avg"),
        F.count_distinct(F.when(F.col("l_returnflag") == "R", F.col("l_partkey"))).alias("returned_parts"),
        X.band(F.max(q), [30, 49], ["corto", "medio", "largo"]).alias("class"),
    )
