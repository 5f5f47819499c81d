"""The business tables, derived from the given ones; each has the same definition in SQL for the oracle.

customer → products, contracts, clients; orders → month-end closes, billing, purchases;
lineitem → payments, deferred debt, suspensions, charges, meter orders, daily volumes; supplier → stations, partners;
events → historian readings.
"""

from __future__ import annotations

import datetime as dt
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlytics.functions.columns import pick
from gridlytics.operators import series as S

CREDIT_AS_OF = "2001-08-01"
SERIES_AS_OF = "2001-11-05"
READINGS_START, READINGS_AS_OF = "2024-01-01", "2024-01-31"


class Tables:
    """Given tables and the frames derived from them, read lazily."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        df = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        self.__dict__[name] = df
        return df

    # Credit portfolio -------------------------------------------------------------------------

    @cached_property
    def products(self) -> DataFrame:
        return self.customer.select(
            F.col("c_custkey").alias("product_id"),
            F.expr("c_custkey div 2").alias("contract_id"),
            F.when(F.col("c_custkey") % 2 == 0, 7014).otherwise(7055).alias("product_type"),
            F.when(F.col("c_mktsegment") == "MACHINERY", 2).otherwise(1).alias("category"),
            F.date_add(F.lit(dt.date(1985, 1, 1)), F.floor(F.abs("c_acctbal")).cast("int")).alias("entry_date"),
        )

    @cached_property
    def closes(self) -> DataFrame:
        """One row per product and month with an order; the holder's place is its nation."""
        monthly = self.orders.groupBy(
            F.col("o_custkey").alias("product_id"), F.last_day(F.col("o_orderdate").cast("date")).alias("close_date")
        ).agg(
            F.max(F.floor("o_totalprice") % 121 - 1).alias("arrears_days"),
            F.max(F.when(F.col("o_orderstatus") == "F", F.floor("o_totalprice")).otherwise(0)).alias("_balance"),
        )
        holders = self.customer.select(
            F.col("c_custkey").alias("product_id"), F.col("c_nationkey").alias("place_id"),
            (F.col("c_nationkey") % 6 + 1).alias("stratum"),
            F.when(F.col("c_mktsegment") == "MACHINERY", 2).otherwise(1).alias("category"),
            F.when(F.col("c_acctbal") < 0, 110).otherwise(1).alias("cut_state"),
            F.when(F.col("c_mktsegment") != "FURNITURE", F.col("c_name")).alias("holder_id"),
            F.col("c_mktsegment").alias("department"),
        )
        return monthly.join(holders, "product_id").select(
            "product_id", F.expr("product_id div 2").alias("contract_id"), "close_date",
            F.when(F.col("product_id") % 2 == 0, 7014).otherwise(7055).alias("product_type"),
            "arrears_days", F.when(F.col("arrears_days") > 90, F.col("_balance")).otherwise(0).alias("written_off"),
            "place_id", "stratum", "category", "cut_state", "holder_id", "department",
        )

    @cached_property
    def billing(self) -> DataFrame:
        return self.orders.select(
            F.col("o_custkey").alias("product_id"), F.last_day(F.col("o_orderdate").cast("date")).alias("close_date"),
            F.floor("o_totalprice").alias("billed"),
        )

    @cached_property
    def owned_lines(self) -> DataFrame:
        """Order lines with the customer who placed the order."""
        owners = self.orders.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("product_id"))
        return self.lineitem.join(owners, "l_orderkey").withColumn("shipped", F.col("l_shipdate").cast("date"))

    @cached_property
    def payments(self) -> DataFrame:
        sign = F.when(F.col("l_returnflag") == "R", -1).otherwise(1)
        return self.owned_lines.select(
            "product_id", F.last_day("shipped").alias("close_date"), (sign * F.floor("l_extendedprice")).alias("paid")
        )

    @cached_property
    def deferred(self) -> DataFrame:
        total = F.floor("l_extendedprice")
        return self.owned_lines.select(
            "product_id", F.expr("product_id div 2").alias("contract_id"), F.col("shipped").alias("entry_date"),
            F.when(F.col("l_linestatus") == "O", 1).otherwise(0).alias("is_current"),
            F.when(F.col("l_returnflag") == "R", "GCNED").otherwise("OTRO").alias("program"),
            F.col("l_partkey").alias("financing_code"),
            F.col("l_quantity").cast("int").alias("instalments"), F.col("l_linenumber").alias("billed_instalments"),
            total.alias("total"), F.when(F.col("l_discount") > 0, total).otherwise(0).alias("outstanding"),
        )

    @cached_property
    def suspended(self) -> DataFrame:
        back = F.when(F.col("l_returnflag") == "R", F.lit(dt.date(1900, 1, 1))).otherwise(
            F.date_add("shipped", F.col("l_quantity").cast("int"))
        )
        return self.owned_lines.select(
            "product_id", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("suspension_id"),
            F.when(F.col("l_discount") <= 0.05, 2).otherwise(1).alias("suspension_type"),
            F.col("shipped").alias("applied_date"), back.alias("reconnected_date"),
        )

    @cached_property
    def charges(self) -> DataFrame:
        return self.owned_lines.select(
            "product_id", F.when(F.col("l_tax") >= 0.08, 20).otherwise(F.col("l_linenumber")).alias("program"),
            F.when(F.col("l_returnflag") == "N", "M").otherwise("A").alias("process_type"),
            F.when(F.col("l_linestatus") == "O", "DB").otherwise("CR").alias("sign"),
            F.col("shipped").alias("posted_date"), F.floor("l_extendedprice").alias("amount"),
        )

    @cached_property
    def contracts(self) -> DataFrame:
        return self.products.select("contract_id", "product_id", F.col("product_id").alias("client_id"))

    @cached_property
    def clients(self) -> DataFrame:
        return self.customer.select(F.col("c_custkey").alias("client_id"), F.col("c_mktsegment").alias("id_type"))

    @cached_property
    def excluded_places(self) -> DataFrame:
        return self.nation.filter(F.col("n_regionkey") == 0).select(F.col("n_nationkey").alias("place_id"))

    # Meter review -----------------------------------------------------------------------------

    @cached_property
    def meter_orders(self) -> DataFrame:
        def text(col):
            return F.replace(col.cast("string"), F.lit("."), F.lit(","))

        q, price, line = F.col("l_quantity"), F.floor("l_extendedprice"), F.col("l_linenumber")
        shipped = F.col("l_shipdate").cast("date")
        returned = F.col("l_returnflag")
        return self.lineitem.select(
            F.col("l_orderkey").alias("order_id"), F.col("l_partkey").alias("product_id"), line.alias("line"),
            F.when(line <= 4, 1).otherwise(2).alias("category"),
            F.when(returned == "N", 12620).when(returned == "R", 12526).alias("work_type"),
            line.alias("last_cause"), q.alias("volume"),
            F.when(F.col("l_tax") > 0.02, -0.5).alias("lower_band"), F.when(F.col("l_tax") > 0.02, 0.5).alias("upper_band"),
            F.floor(F.col("l_discount") * 100).cast("int").alias("suspended_days"),
            shipped.alias("read_on"),
            F.when(returned == "A", F.lit(dt.date(1900, 1, 1))).otherwise(F.date_sub(shipped, line - 3)).alias("executed_on"),
            F.date_sub(shipped, 30).alias("last_valid_on"),
            text((price % 1000).cast("double") / 2).alias("last_valid_reading"),
            ((price % 1000).cast("double") / 2 + q - 10).alias("first_valid_reading"),
            F.when(line != 7, text((price % 900).cast("double") / 4)).alias("two_months_reading"),
            text((price % 1100).cast("double") / 2).alias("reading"),
            ((price % 1200).cast("double") / 2).alias("order_reading"),
            F.when(line != 2, text(F.when(line == 3, 0.0).otherwise(q + 5))).alias("product_avg"),
            text(F.when(line == 5, 0.0).otherwise(q + line - 3)).alias("local_avg"),
            text(q + line / 2).alias("estimated"),
        )

    # Consumption ------------------------------------------------------------------------------

    @cached_property
    def calc(self) -> DataFrame:
        shipped = F.col("l_shipdate").cast("date")
        return self.lineitem.select(
            F.col("l_suppkey").alias("product_id"), F.col("l_linenumber").alias("method"),
            F.col("l_quantity").cast("decimal(20,4)").alias("units"),
            (F.year(shipped) * 100 + F.month(shipped)).alias("period_id"), shipped.alias("consumed_on"),
            (F.floor("l_extendedprice") % 31 + 1).cast("int").alias("days"),
        )

    @cached_property
    def periods(self) -> DataFrame:
        month = F.trunc(F.col("l_shipdate").cast("date"), "month")
        return self.lineitem.select(month.alias("period_date")).distinct().select(
            (F.year("period_date") * 100 + F.month("period_date")).alias("period_id"), "period_date",
            F.lit(True).alias("is_current"),
        )

    @cached_property
    def station_closes(self) -> DataFrame:
        kinds = self.supplier.select(
            F.col("s_suppkey").alias("product_id"),
            F.when(F.col("s_acctbal") > 8000, 3).when(F.col("s_acctbal") > 4000, 2).otherwise(1).alias("category"),
            (F.col("s_nationkey") % 6 + 1).alias("subcategory"),
        )
        months = self.lineitem.select(
            F.col("l_suppkey").alias("product_id"), F.last_day(F.col("l_shipdate").cast("date")).alias("close_date")
        ).distinct()
        return months.join(kinds, "product_id")

    # Daily series -----------------------------------------------------------------------------

    @cached_property
    def daily(self) -> DataFrame:
        return S.daily(self.lineitem.select(
            F.col("l_suppkey").alias("station"), F.col("l_shipdate").cast("date").alias("date"),
            F.col("l_quantity").alias("volume"),
        ))

    @cached_property
    def calendar(self) -> DataFrame:
        """Holidays: the first day of each month in which something was shipped."""
        return self.lineitem.select(F.trunc(F.col("l_shipdate").cast("date"), "month").alias("date")).distinct()

    @cached_property
    def stations(self) -> DataFrame:
        nations = self.nation.select(
            F.col("n_nationkey").alias("s_nationkey"), F.concat(F.lit("R"), F.col("n_regionkey").cast("string")).alias("user_type")
        )
        return self.supplier.join(nations, "s_nationkey").select(
            F.col("s_suppkey").alias("station"), F.col("s_name").alias("station_name"), "user_type",
            F.concat(F.lit("D-"), F.col("s_nationkey").cast("string")).alias("device"),
        )

    @cached_property
    def series(self) -> DataFrame:
        return S.complete_dates(self.daily, self.calendar, SERIES_AS_OF, parts=self.series_parts)

    @cached_property
    def series_parts(self) -> int:
        return S.series_parts(self.lineitem, "l_suppkey", "l_shipdate", SERIES_AS_OF)

    @cached_property
    def started(self) -> DataFrame:
        return S.effective_start(self.series)

    @cached_property
    def states(self) -> DataFrame:
        return S.series_state(self.started, SERIES_AS_OF)

    @cached_property
    def stated(self) -> DataFrame:
        """Completed series with the state of the station."""
        # A state is one row per station, and both sides lie by station: a hash of the states spares sorting the days for the join.
        return self.series.join(self.states.select("station", "state").hint("shuffle_hash"), "station")

    @cached_property
    def devices(self) -> DataFrame:
        users = self.events.groupBy("user_id").agg(F.count("*").alias("_n"))
        unit = pick(("M3", "FT3", "KPC", "MBTU", "GAL"), (F.col("user_id") % 5).cast("int"))
        return users.select(
            F.col("user_id").alias("station"), F.col("user_id").alias("history_id"),
            (F.col("user_id") % 3).cast("int").alias("column_id"),
            F.when(F.col("user_id") % 7 == 0, -1).otherwise(1).alias("sign"), unit.alias("unit"),
        )

    @cached_property
    def readings(self) -> DataFrame:
        """Events as versions of the midnight reading of their day; a click keeps its own hour and is not a midnight reading."""
        ts = F.col("ts")
        return self.events.select(
            F.col("user_id").alias("history_id"), (F.col("user_id") % 3).cast("int").alias("column_id"),
            F.when(F.col("event_type") == "click", ts).otherwise(F.date_trunc("day", ts)).alias("read_at"),
            ts.alias("created_at"), "value",
            F.when(F.col("event_type") == "error", 0).otherwise(1).alias("is_current"), F.lit(1).alias("delta_applied"),
        )

    # Segmentation -----------------------------------------------------------------------------

    @cached_property
    def rfm_base(self) -> DataFrame:
        as_of = dt.date.fromisoformat(CREDIT_AS_OF)
        day = F.col("o_orderdate").cast("date")
        # An order this recent is due; older ones make the frequency of the last two years.
        recent = F.when(day >= F.lit(dt.date(2000, 8, 1)), 1).otherwise(0)
        base = self.orders.groupBy(F.col("o_custkey").alias("customer_id")).agg(
            F.max(day).alias("_last"), F.sum(recent).alias("frequency"), F.sum(F.floor("o_totalprice")).alias("monetary")
        )
        months = (as_of.year - F.year("_last")) * 12 + as_of.month - F.month("_last")
        return base.select("customer_id", months.alias("recency"), "frequency", "monetary")

    @cached_property
    def partner_base(self) -> DataFrame:
        return self._partners(F.col("l_linestatus"))

    @cached_property
    def partner_channels(self) -> DataFrame:
        """Partners by three channels: contractors 0, motorcycles 1, points of sale 2."""
        return self._partners((F.col("l_linenumber") % 3).cast("int"))

    def _partners(self, channel: Column) -> DataFrame:
        as_of = F.lit(dt.date.fromisoformat(SERIES_AS_OF))
        day = F.col("l_shipdate").cast("date")
        price = F.floor("l_extendedprice")
        half_year = F.when(day >= F.lit(dt.date(2001, 5, 5)), price).otherwise(0)
        return self.lineitem.groupBy(F.col("l_suppkey").alias("partner_id"), channel.alias("channel")).agg(
            F.datediff(as_of, F.max(day)).alias("recency"), F.count("*").alias("sales"), F.sum(price).alias("monetary"),
            F.count_if(F.col("l_returnflag") == "R").alias("returns"), F.avg(price).alias("ticket"),
            F.avg("l_quantity").alias("term"), F.sum(half_year).alias("monetary_6m"),
            F.avg(F.when(F.col("l_tax") > 0.04, 1.0).otherwise(0.0)).alias("insured"),
        )

    # Supervised models ------------------------------------------------------------------------

    @cached_property
    def relief(self) -> DataFrame:
        """Orders as relief-plan rows: the holder's attributes and debts spread over the order's price."""
        buyer = self.customer.select(F.col("c_custkey").alias("o_custkey"), "c_nationkey", "c_mktsegment", "c_acctbal")
        price = F.floor("o_totalprice")
        return self.orders.join(buyer, "o_custkey").select(
            F.col("o_orderkey").alias("contract_id"),
            F.when(F.col("c_mktsegment") == "MACHINERY", 2).otherwise(1).alias("category"),
            (F.col("c_nationkey") % 6 + 1).cast("int").alias("subcategory"), F.col("c_mktsegment").alias("place"),
            F.when(F.col("o_orderpriority").startswith("1"), "SI").otherwise("NO").alias("refinanced"),
            ((price % 18) * 30).cast("int").alias("arrears_range"), (price % 121 - 1).cast("int").alias("arrears_days"),
            (price % 97 - 1).cast("int").alias("final_arrears_days"),
            (price * 6).alias("gas_current"), (price * 11).alias("gas_overdue"), (price * 45).alias("gas_deferred"),
            (price * 3).alias("credit_current"), (price * 7).alias("credit_overdue"), (price * 25).alias("credit_deferred"),
            (price % 110000).alias("other_current"), (price % 600000).alias("other_overdue"),
            (price * 4).alias("instalment"), F.col("c_acctbal").alias("balance"),
        )


# Name → (other common tables it reads, SQL). The order of the entries is the order of definition.
CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "products": ((), """
        SELECT c_custkey AS product_id, c_custkey // 2 AS contract_id,
               CASE WHEN c_custkey % 2 = 0 THEN 7014 ELSE 7055 END AS product_type,
               CASE WHEN c_mktsegment = 'MACHINERY' THEN 2 ELSE 1 END AS category,
               CAST(DATE '1985-01-01' + CAST(floor(abs(c_acctbal)) AS INTEGER) AS DATE) AS entry_date FROM customer"""),
    "closes": ((), """
        SELECT m.product_id, m.product_id // 2 AS contract_id, close_date,
               CASE WHEN m.product_id % 2 = 0 THEN 7014 ELSE 7055 END AS product_type, arrears_days,
               CASE WHEN arrears_days > 90 THEN balance ELSE 0 END AS written_off,
               c_nationkey AS place_id, c_nationkey % 6 + 1 AS stratum,
               CASE WHEN c_mktsegment = 'MACHINERY' THEN 2 ELSE 1 END AS category,
               CASE WHEN c_acctbal < 0 THEN 110 ELSE 1 END AS cut_state,
               CASE WHEN c_mktsegment <> 'FURNITURE' THEN c_name END AS holder_id, c_mktsegment AS department
        FROM (SELECT o_custkey AS product_id, CAST(last_day(o_orderdate) AS DATE) AS close_date,
                     max(CAST(floor(o_totalprice) AS BIGINT) % 121 - 1) AS arrears_days,
                     max(CASE WHEN o_orderstatus = 'F' THEN CAST(floor(o_totalprice) AS BIGINT) ELSE 0 END) AS balance
              FROM orders GROUP BY 1, 2) m JOIN customer ON c_custkey = m.product_id"""),
    "billing": ((), """
        SELECT o_custkey AS product_id, CAST(last_day(o_orderdate) AS DATE) AS close_date,
               CAST(sum(CAST(floor(o_totalprice) AS BIGINT)) AS BIGINT) AS billed FROM orders GROUP BY 1, 2"""),
    "owned_lines": ((), """
        SELECT l.*, o_custkey AS product_id, CAST(l_shipdate AS DATE) AS shipped
        FROM lineitem l JOIN orders ON o_orderkey = l_orderkey"""),
    "payments": (("owned_lines",), """
        SELECT product_id, CAST(last_day(shipped) AS DATE) AS close_date,
               CAST(sum(CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END * CAST(floor(l_extendedprice) AS BIGINT)) AS BIGINT) AS paid
        FROM owned_lines GROUP BY 1, 2"""),
    "deferred": (("owned_lines",), """
        SELECT product_id, product_id // 2 AS contract_id, shipped AS entry_date,
               CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS is_current,
               CASE WHEN l_returnflag = 'R' THEN 'GCNED' ELSE 'OTRO' END AS program, l_partkey AS financing_code,
               CAST(l_quantity AS INTEGER) AS instalments, l_linenumber AS billed_instalments,
               CAST(floor(l_extendedprice) AS BIGINT) AS total,
               CASE WHEN l_discount > 0 THEN CAST(floor(l_extendedprice) AS BIGINT) ELSE 0 END AS outstanding
        FROM owned_lines"""),
    "suspended": (("owned_lines",), """
        SELECT product_id, l_orderkey * 10 + l_linenumber AS suspension_id,
               CASE WHEN l_discount <= 0.05 THEN 2 ELSE 1 END AS suspension_type, shipped AS applied_date,
               CASE WHEN l_returnflag = 'R' THEN DATE '1900-01-01'
                    ELSE CAST(shipped + CAST(l_quantity AS INTEGER) AS DATE) END AS reconnected_date
        FROM owned_lines"""),
    "charges": (("owned_lines",), """
        SELECT product_id, CASE WHEN l_tax >= 0.08 THEN 20 ELSE l_linenumber END AS program,
               CASE WHEN l_returnflag = 'N' THEN 'M' ELSE 'A' END AS process_type,
               CASE WHEN l_linestatus = 'O' THEN 'DB' ELSE 'CR' END AS sign, shipped AS posted_date,
               CAST(floor(l_extendedprice) AS BIGINT) AS amount FROM owned_lines"""),
    "base": (("products", "closes"), """
        SELECT r.close_date, p.product_id, p.product_type, r.contract_id, r.arrears_days, i.n AS "interval",
               CASE WHEN r.written_off > 0 THEN 1 ELSE 0 END AS written_off
        FROM products p JOIN closes r USING (product_id) CROSS JOIN (VALUES (6), (12)) i(n)
        WHERE p.category = 1 AND p.product_type IN (7014, 7055) AND p.entry_date <= DATE '2001-07-31'
          AND r.close_date <= DATE '2001-07-31' AND r.close_date = last_day(r.close_date)
          AND r.close_date >= last_day(DATE '2001-07-31' - to_months(i.n - 1))"""),
    "fact": (("base", "billing", "payments", "deferred", "suspended"), """
        SELECT a.product_id, a.product_type, a."interval", a.e30, a.e60, a.e90, a.em90,
               CAST(coalesce(r.refinancings, 0) AS INTEGER) AS refinancings,
               CAST(coalesce(s.suspensions, 0) AS INTEGER) AS suspensions,
               CAST(coalesce(s.suspended_days, 0) AS INTEGER) AS suspended_days,
               a.written_off, a.written_off_months,
               CAST(CASE WHEN a.product_type = 7055 THEN coalesce(d.desync_days, 0) ELSE 0 END AS INTEGER) AS desync_days,
               a.billed, a.paid
        FROM (SELECT b.product_id, product_type, "interval", contract_id,
                     CAST(count(*) FILTER (arrears_days BETWEEN 1 AND 30) AS INTEGER) AS e30,
                     CAST(count(*) FILTER (arrears_days BETWEEN 31 AND 60) AS INTEGER) AS e60,
                     CAST(count(*) FILTER (arrears_days BETWEEN 61 AND 90) AS INTEGER) AS e90,
                     CAST(count(*) FILTER (arrears_days > 90) AS INTEGER) AS em90,
                     CAST(sum(written_off) AS INTEGER) AS written_off_months,
                     CAST(max(CASE WHEN b.close_date = DATE '2001-07-31' THEN written_off END) AS INTEGER) AS written_off,
                     CAST(sum(coalesce(billed, 0)) AS BIGINT) AS billed, CAST(sum(coalesce(paid, 0)) AS BIGINT) AS paid
              FROM base b LEFT JOIN billing f ON f.product_id = b.product_id AND f.close_date = b.close_date
              LEFT JOIN payments g ON g.product_id = b.product_id AND g.close_date = b.close_date
              GROUP BY ALL HAVING max(CASE WHEN b.close_date = DATE '2001-07-31' THEN written_off END) IS NOT NULL) a
        LEFT JOIN (SELECT b.product_id, "interval", count(DISTINCT financing_code) AS refinancings
                   FROM base b JOIN deferred d ON d.product_id = b.product_id AND last_day(d.entry_date) = b.close_date
                   WHERE is_current = 1 AND program = 'GCNED' GROUP BY 1, 2) r USING (product_id, "interval")
        LEFT JOIN (SELECT k.product_id, k."interval", count(DISTINCT suspension_id) AS suspensions,
                          sum(greatest(datediff('day', greatest(applied_date, lower),
                              CASE WHEN reconnected_date <> DATE '1900-01-01' AND reconnected_date < upper
                                   THEN reconnected_date ELSE upper END), 0)) AS suspended_days
                   FROM (SELECT product_id, "interval", max(close_date) AS upper,
                                min(CAST(date_trunc('month', close_date) AS DATE)) AS lower FROM base GROUP BY 1, 2) k
                   JOIN suspended s ON s.product_id = k.product_id AND suspension_type = 2 AND
                     ((applied_date <= lower AND (reconnected_date = DATE '1900-01-01' OR reconnected_date > lower))
                      OR (applied_date > lower AND applied_date <= upper)) GROUP BY 1, 2) s USING (product_id, "interval")
        LEFT JOIN (SELECT contract_id, "interval", max(gap) AS desync_days FROM (
                     SELECT close_date, contract_id, "interval", max(CASE WHEN product_type = 7055 THEN arrears_days END)
                            - max(CASE WHEN product_type = 7014 THEN arrears_days END) AS gap FROM base GROUP BY 1, 2, 3)
                   GROUP BY 1, 2) d ON d.contract_id = a.contract_id AND d."interval" = a."interval" """),
    "variables": (("fact",), """
        SELECT f.product_id, f.product_type, f."interval",
               CASE WHEN paid > billed THEN 1.0 WHEN CAST(paid AS DOUBLE) / billed < 0 THEN 0.0
                    ELSE CAST(paid AS DOUBLE) / billed END AS v_payment,
               1 - (CAST(0.3 AS DOUBLE) * e30 + CAST(0.5 AS DOUBLE) * e60 + CAST(0.8 AS DOUBLE) * e90 + em90) / f."interval" AS v_arrears,
               1 - CAST(refinancings - rlo AS DOUBLE) / nullif(rhi - rlo, 0) AS v_refinancing,
               CASE WHEN product_type = 7014 THEN 1 - CAST(days - slo AS DOUBLE) / nullif(shi - slo, 0) END AS v_suspension,
               CAST(written_off_months AS DOUBLE) / nullif(w, 0) AS v_writeoff,
               CASE WHEN desync_days < 0 THEN 1.0 WHEN desync_days > 60 THEN 0.0
                    ELSE 1 - CAST(desync_days AS DOUBLE) / 60 END AS v_desync
        FROM (SELECT *, least(suspended_days, CASE "interval" WHEN 6 THEN 183 ELSE 366 END) AS days
              FROM fact WHERE billed <> 0) f
        JOIN (SELECT "interval", min(least(suspended_days, CASE "interval" WHEN 6 THEN 183 ELSE 366 END)) AS slo,
                     max(least(suspended_days, CASE "interval" WHEN 6 THEN 183 ELSE 366 END)) AS shi,
                     max(written_off_months) AS w FROM fact WHERE billed <> 0 GROUP BY 1) l ON l."interval" = f."interval"
        CROSS JOIN (SELECT min(refinancings) AS rlo, max(refinancings) AS rhi FROM fact WHERE billed <> 0) g"""),
    "gas_class": (("closes",), """
        SELECT contract_id, CASE WHEN max(arrears_days) <= 30 THEN '1-Pago A Tiempo'
                 WHEN max(arrears_days) <= 60 THEN '2-Pago Atrasado a 60 Dias'
                 WHEN max(arrears_days) > 60 THEN '3-No Paga a 90 Dias' ELSE '4-Otro' END AS gas_class,
               CAST(count(*) FILTER (arrears_days BETWEEN -1 AND 0) AS INTEGER) AS gas_e0,
               CAST(count(*) FILTER (arrears_days BETWEEN 1 AND 30) AS INTEGER) AS gas_e30,
               CAST(count(*) FILTER (arrears_days BETWEEN 31 AND 60) AS INTEGER) AS gas_e60,
               CAST(count(*) FILTER (arrears_days BETWEEN 61 AND 90) AS INTEGER) AS gas_e90,
               CAST(count(*) FILTER (arrears_days > 90) AS INTEGER) AS gas_em90
        FROM closes WHERE product_type = 7014 AND close_date BETWEEN DATE '2000-07-31' AND DATE '2001-07-31' GROUP BY 1"""),
    "credit_class": (("closes",), """
        SELECT contract_id, CASE WHEN max(em) <= 30 THEN '1-Pago A Tiempo' WHEN max(em) <= 60 THEN '2-Pago Atrasado a 60 Dias'
                 WHEN max(em) > 60 THEN '3-No Paga a 90 Dias' ELSE '5-Otro' END AS credit_class,
               CAST(count(*) FILTER (em BETWEEN -1 AND 0) AS INTEGER) AS credit_e0,
               CAST(count(*) FILTER (em BETWEEN 1 AND 30) AS INTEGER) AS credit_e30,
               CAST(count(*) FILTER (em BETWEEN 31 AND 60) AS INTEGER) AS credit_e60,
               CAST(count(*) FILTER (em BETWEEN 61 AND 90) AS INTEGER) AS credit_e90,
               CAST(count(*) FILTER (em > 90) AS INTEGER) AS credit_em90
        FROM (SELECT contract_id, close_date, max(arrears_days) AS em FROM closes
              WHERE product_type = 7055 AND close_date BETWEEN DATE '2000-07-31' AND DATE '2001-07-31' GROUP BY 1, 2) GROUP BY 1"""),
    "near_closes": (("closes",), """
        SELECT * FROM closes WHERE place_id NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 0)"""),
    "near_gas_class": (("near_closes",), """
        SELECT contract_id, CASE WHEN max(arrears_days) <= 30 THEN '1-Pago A Tiempo'
                 WHEN max(arrears_days) <= 60 THEN '2-Pago Atrasado a 60 Dias'
                 WHEN max(arrears_days) > 60 THEN '3-No Paga a 90 Dias' ELSE '4-Otro' END AS gas_class,
               CAST(count(*) FILTER (arrears_days BETWEEN -1 AND 0) AS INTEGER) AS gas_e0,
               CAST(count(*) FILTER (arrears_days BETWEEN 1 AND 30) AS INTEGER) AS gas_e30,
               CAST(count(*) FILTER (arrears_days BETWEEN 31 AND 60) AS INTEGER) AS gas_e60,
               CAST(count(*) FILTER (arrears_days BETWEEN 61 AND 90) AS INTEGER) AS gas_e90,
               CAST(count(*) FILTER (arrears_days > 90) AS INTEGER) AS gas_em90
        FROM near_closes WHERE product_type = 7014 AND close_date BETWEEN DATE '2000-07-31' AND DATE '2001-07-31' GROUP BY 1"""),
    "near_credit_class": (("near_closes",), """
        SELECT contract_id, CASE WHEN max(em) <= 30 THEN '1-Pago A Tiempo' WHEN max(em) <= 60 THEN '2-Pago Atrasado a 60 Dias'
                 WHEN max(em) > 60 THEN '3-No Paga a 90 Dias' ELSE '5-Otro' END AS credit_class,
               CAST(count(*) FILTER (em BETWEEN -1 AND 0) AS INTEGER) AS credit_e0,
               CAST(count(*) FILTER (em BETWEEN 1 AND 30) AS INTEGER) AS credit_e30,
               CAST(count(*) FILTER (em BETWEEN 31 AND 60) AS INTEGER) AS credit_e60,
               CAST(count(*) FILTER (em BETWEEN 61 AND 90) AS INTEGER) AS credit_e90,
               CAST(count(*) FILTER (em > 90) AS INTEGER) AS credit_em90
        FROM (SELECT contract_id, close_date, max(arrears_days) AS em FROM near_closes
              WHERE product_type = 7055 AND close_date BETWEEN DATE '2000-07-31' AND DATE '2001-07-31' GROUP BY 1, 2) GROUP BY 1"""),
    "profile": (("deferred", "products"), """
        SELECT d.contract_id,
               max(CASE WHEN product_type = 7014 THEN instalments ELSE 0 END) AS gas_term,
               max(CASE WHEN product_type = 7014 THEN instalments - billed_instalments ELSE 0 END) AS gas_pending,
               CAST(sum(CASE WHEN product_type = 7014 THEN total ELSE 0 END) AS BIGINT) AS gas_initial_balance,
               max(CASE WHEN product_type = 7055 THEN instalments ELSE 0 END) AS credit_term,
               max(CASE WHEN product_type = 7055 THEN instalments - billed_instalments ELSE 0 END) AS credit_pending,
               CAST(sum(CASE WHEN product_type = 7055 THEN total ELSE 0 END) AS BIGINT) AS credit_initial_balance
        FROM deferred d JOIN products p USING (product_id)
        WHERE is_current = 1 AND outstanding > 0 AND product_type IN (7014, 7055) GROUP BY 1"""),
    "instalment": (("charges", "products"), """
        SELECT contract_id, avg(CASE WHEN product_type = 7014 THEN net ELSE 0 END) AS gas_instalment,
               avg(CASE WHEN product_type = 7055 THEN net ELSE 0 END) AS credit_instalment
        FROM (SELECT p.contract_id, c.product_id, product_type, last_day(posted_date) AS period,
                     CAST(sum(CASE WHEN sign = 'DB' THEN amount ELSE -amount END) AS BIGINT) AS net
              FROM charges c JOIN products p USING (product_id)
              WHERE program NOT IN (20, 700, 2016) AND process_type = 'A' AND sign IN ('DB', 'CR')
                AND posted_date BETWEEN DATE '2000-07-31' AND DATE '2001-08-01' AND product_type IN (7014, 7055)
              GROUP BY ALL) GROUP BY 1"""),
    "inputs": (("near_closes", "products", "near_gas_class", "near_credit_class", "profile", "instalment"), """
        SELECT c_mktsegment AS id_type, holder_id, r.contract_id, gas_class, credit_class,
               gas_e0, gas_e30, gas_e60, gas_e90, gas_em90, credit_e0, credit_e30, credit_e60, credit_e90, credit_em90,
               'Cupo Aprobado' AS quota_type, department, r.category, r.stratum, gas_pending, credit_pending,
               CAST(trunc(gas_instalment) AS INTEGER) AS gas_instalment, CAST(trunc(credit_instalment) AS INTEGER) AS credit_instalment
        FROM near_closes r
        JOIN products p USING (product_id) LEFT JOIN customer ON c_custkey = r.product_id
        LEFT JOIN near_gas_class g ON g.contract_id = r.contract_id
        LEFT JOIN near_credit_class c ON c.contract_id = r.contract_id
        LEFT JOIN profile d ON d.contract_id = r.contract_id LEFT JOIN instalment i ON i.contract_id = r.contract_id
        WHERE r.close_date = DATE '2001-07-31' AND r.product_type = 7014 AND r.category = 1 AND cut_state NOT IN (110, 111, 112)"""),
    "meter_orders": ((), """
        SELECT l_orderkey AS order_id, l_partkey AS product_id, l_linenumber AS line,
               CASE WHEN l_linenumber <= 4 THEN 1 ELSE 2 END AS category,
               CASE l_returnflag WHEN 'N' THEN 12620 WHEN 'R' THEN 12526 END AS work_type, l_quantity AS volume,
               CASE WHEN l_tax > 0.02 THEN -0.5 END AS lower_band, CASE WHEN l_tax > 0.02 THEN 0.5 END AS upper_band,
               CAST(floor(l_discount * 100) AS INTEGER) AS suspended_days, CAST(l_shipdate AS DATE) AS read_on,
               CASE WHEN l_returnflag = 'A' THEN NULL ELSE CAST(CAST(l_shipdate AS DATE) - (l_linenumber - 3) AS DATE) END AS executed_on,
               CAST(CAST(l_shipdate AS DATE) - 30 AS DATE) AS last_valid_on,
               CAST(price % 1000 AS DOUBLE) / 2 AS last_valid_reading,
               CAST(price % 1000 AS DOUBLE) / 2 + l_quantity - 10 AS first_valid_reading,
               CASE WHEN l_linenumber <> 7 THEN CAST(price % 900 AS DOUBLE) / 4 ELSE -1000.0 END AS two_months_reading,
               CAST(price % 1100 AS DOUBLE) / 2 AS reading, CAST(price % 1200 AS DOUBLE) / 2 AS order_reading,
               CASE WHEN l_linenumber = 2 THEN -100.0 WHEN l_linenumber = 3 THEN 0.0 ELSE l_quantity + 5 END AS product_avg,
               CASE WHEN l_linenumber = 5 THEN 0.0 ELSE l_quantity + l_linenumber - 3 END AS local_avg,
               l_quantity + CAST(l_linenumber AS DOUBLE) / 2 AS estimated
        FROM (SELECT *, CAST(floor(l_extendedprice) AS BIGINT) AS price FROM lineitem)"""),
    "calc": ((), """
        SELECT l_suppkey AS product_id, l_linenumber AS method, l_quantity AS units,
               year(l_shipdate) * 100 + month(l_shipdate) AS period_id, CAST(l_shipdate AS DATE) AS consumed_on,
               CAST(CAST(floor(l_extendedprice) AS BIGINT) % 31 + 1 AS INTEGER) AS days FROM lineitem"""),
    "consumption": (("calc",), """
        SELECT c.product_id, category, subcategory, period_date, CAST(trunc(sum(units)) AS INTEGER) AS volume
        FROM (SELECT product_id, period_id, sum(units) AS units FROM calc WHERE method <> 4 GROUP BY 1, 2) c
        JOIN (SELECT DISTINCT CAST(date_trunc('month', l_shipdate) AS DATE) AS period_date,
                     year(l_shipdate) * 100 + month(l_shipdate) AS period_id FROM lineitem) p USING (period_id)
        JOIN (SELECT DISTINCT l_suppkey AS product_id, CAST(last_day(l_shipdate) AS DATE) AS close_date FROM lineitem) m
          ON m.product_id = c.product_id AND m.close_date = last_day(period_date)
        JOIN (SELECT s_suppkey, CASE WHEN s_acctbal > 8000 THEN 3 WHEN s_acctbal > 4000 THEN 2 ELSE 1 END AS category,
                     s_nationkey % 6 + 1 AS subcategory FROM supplier) k
          ON k.s_suppkey = c.product_id AND category <= 2
        GROUP BY 1, 2, 3, 4"""),
    "averages": (("consumption",), """
        SELECT product_id, avg(volume) AS average FROM consumption
        WHERE period_date BETWEEN DATE '2000-09-01' AND DATE '2001-02-01' GROUP BY 1"""),
    "variation": (("consumption", "averages"), """
        SELECT product_id, round((volume - average) / average, 2) AS variation
        FROM consumption JOIN averages USING (product_id)
        WHERE period_date = DATE '2001-03-01' AND category = 1 AND volume > 0 AND average > 0
          AND round((volume - average) / average, 2) < 5"""),
    "daily": ((), """
        SELECT l_suppkey AS station, CAST(l_shipdate AS DATE) AS date, sum(l_quantity) AS volume FROM lineitem GROUP BY 1, 2"""),
    "calendar": ((), "SELECT DISTINCT CAST(date_trunc('month', l_shipdate) AS DATE) AS date FROM lineitem"),
    "stations": ((), """
        SELECT s_suppkey AS station, s_name AS station_name, 'R' || CAST(n_regionkey AS VARCHAR) AS user_type,
               'D-' || CAST(s_nationkey AS VARCHAR) AS device FROM supplier JOIN nation ON n_nationkey = s_nationkey"""),
    "series": (("daily", "calendar"), """
        SELECT g.station, g.date, coalesce(v.volume, 0.0) AS volume,
               CASE WHEN c.date IS NULL THEN 0 ELSE 1 END AS holiday, CAST(isodow(g.date) - 1 AS INTEGER) AS weekday
        FROM (SELECT station, CAST(unnest(generate_series(min(date), DATE '2001-11-04', INTERVAL 1 DAY)) AS DATE) AS date
              FROM daily GROUP BY station) g
        LEFT JOIN daily v ON v.station = g.station AND v.date = g.date LEFT JOIN calendar c ON c.date = g.date"""),
    "started": (("series",), """
        SELECT * EXCLUDE (quiet), coalesce(max(CASE WHEN quiet = 0 AND volume <> 0 THEN date END) OVER (PARTITION BY station),
               min(date) OVER (PARTITION BY station)) AS start
        FROM (SELECT *, sum(volume) OVER (PARTITION BY station ORDER BY date ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING) AS quiet
              FROM series)"""),
    "states": (("started",), """
        SELECT station, start, first_date, first_sent, gap_days, silent_days, (30 - silent_days) / 30.0::DOUBLE AS sending_share,
               silent_days_before,
               CASE WHEN silent_days_before IS NULL AND gap_days >= 30 THEN 'NO ACTIVA'
                    WHEN silent_days_before IS NULL AND gap_days < 30 AND age > 60 THEN 'ACTIVA'
                    WHEN silent_days_before < 30 AND age > 60 THEN 'ACTIVA'
                    WHEN silent_days_before = 30 OR age <= 60 THEN 'NUEVA' END AS state
        FROM (SELECT *, datediff('day', start, DATE '2001-11-04') AS age,
                     CASE WHEN second IS NULL THEN NULL WHEN first_date > second THEN 30 ELSE earlier END AS silent_days_before
              FROM (SELECT t.station, start, first_date, first_sent, gap_days, second,
                           count(*) FILTER (volume = 0 AND date >= DATE '2001-10-06') AS silent_days,
                           count(*) FILTER (volume = 0 AND date < first_sent AND date >= second) AS earlier
                    FROM started t JOIN (
                      SELECT *, datediff('day', DATE '2001-10-06', first_sent) AS gap_days,
                             CASE WHEN 30 - datediff('day', DATE '2001-10-06', first_sent) BETWEEN 1 AND 29
                                  THEN CAST(DATE '2001-10-06' - CAST(30 - datediff('day', DATE '2001-10-06', first_sent) AS INTEGER) AS DATE) END AS second
                      FROM (SELECT station, min(date) AS first_date,
                                   coalesce(min(CASE WHEN volume <> 0 AND date >= DATE '2001-10-06' THEN date END), DATE '2001-11-05') AS first_sent
                            FROM started GROUP BY station)) USING (station) GROUP BY ALL))"""),
    "stated": (("series", "states"), "SELECT s.*, state FROM series s JOIN states USING (station)"),
    "features": (("stated",), """
        SELECT *, lead(volume) OVER w AS target, lead(date) OVER w AS target_date,
               avg(volume) OVER (PARTITION BY station, weekday ORDER BY date ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS same_day,
               avg(volume) OVER (PARTITION BY station, date_trunc('week', date) ORDER BY date
                                 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS week_to_date,
               CASE WHEN holiday = 1 THEN avg(volume) OVER (PARTITION BY station, holiday ORDER BY date
                                 ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) END AS holiday_mean,
               row_number() OVER (PARTITION BY station ORDER BY date DESC) AS back
        FROM stated WINDOW w AS (PARTITION BY station ORDER BY date)"""),
    "weights": (("features",), """
        SELECT station, CASE WHEN days = 15 THEN w1 END AS w1, CASE WHEN days = 15 THEN w2 END AS w2,
               CASE WHEN days = 15 THEN sqrt(greatest(yy - 2 * (w1 * ay + w2 * "by") + w1 * w1 * aa + 2 * w1 * w2 * ab + w2 * w2 * bb + rest, 0) / 15) END AS rmse
        FROM (SELECT *, CASE WHEN aa * bb - ab * ab > 1e-9 * (aa + bb) * (aa + bb) THEN (bb * ay - ab * "by") / (aa * bb - ab * ab)
                   ELSE 0.5 + coalesce((aa * (ay - (aa + ab) / 2) + ab * ("by" - (ab + bb) / 2)) / nullif((aa + bb) * (aa + bb), 0), 0) END AS w1,
                   CASE WHEN aa * bb - ab * ab > 1e-9 * (aa + bb) * (aa + bb) THEN (aa * "by" - ab * ay) / (aa * bb - ab * ab)
                   ELSE 0.5 + coalesce((ab * (ay - (aa + ab) / 2) + bb * ("by" - (ab + bb) / 2)) / nullif((aa + bb) * (aa + bb), 0), 0) END AS w2
              FROM (SELECT station, count(*) AS days, coalesce(sum(a * a), 0.0) AS aa, coalesce(sum(a * b), 0.0) AS ab,
                           coalesce(sum(b * b), 0.0) AS bb, coalesce(sum(a * target), 0.0) AS ay, coalesce(sum(b * target), 0.0) AS "by",
                           coalesce(sum(CASE WHEN a IS NOT NULL THEN target * target END), 0.0) AS yy,
                           coalesce(sum(CASE WHEN a IS NULL THEN power((CASE WHEN state = 'NUEVA' THEN same_day ELSE holiday_mean END) - target, 2) END), 0.0) AS rest
                    FROM (SELECT *, CASE WHEN state <> 'NUEVA' AND holiday = 0 THEN same_day / 2 END AS a,
                                 CASE WHEN state <> 'NUEVA' AND holiday = 0 THEN week_to_date / 2 END AS b
                          FROM features WHERE back BETWEEN 2 AND 16) GROUP BY station))"""),
    "backtest": (("features", "weights"), """
        SELECT *, abs(prediction - actual) / nullif(actual, 0) AS error FROM (
          SELECT station, date, target_date, target AS actual,
                 greatest(CASE WHEN state = 'NUEVA' THEN same_day WHEN holiday = 1 THEN holiday_mean
                               ELSE (same_day * w1 + week_to_date * w2) / 2 END, 0) AS prediction
          FROM features JOIN weights USING (station) WHERE back BETWEEN 2 AND 16)"""),
    "rfm_base": ((), """
        SELECT o_custkey AS customer_id,
               CAST((2001 - year(max(o_orderdate))) * 12 + 8 - month(max(o_orderdate)) AS INTEGER) AS recency,
               count(*) FILTER (o_orderdate >= DATE '2000-08-01') AS frequency,
               CAST(sum(CAST(floor(o_totalprice) AS BIGINT)) AS BIGINT) AS monetary FROM orders GROUP BY 1"""),
    "partner_base": ((), """
        SELECT l_suppkey AS partner_id, l_linestatus AS channel,
               CAST(datediff('day', CAST(max(l_shipdate) AS DATE), DATE '2001-11-05') AS INTEGER) AS recency,
               count(*) AS sales, CAST(sum(CAST(floor(l_extendedprice) AS BIGINT)) AS BIGINT) AS monetary,
               count(*) FILTER (l_returnflag = 'R') AS returns, avg(CAST(floor(l_extendedprice) AS BIGINT)) AS ticket,
               avg(l_quantity) AS term,
               CAST(sum(CASE WHEN l_shipdate >= DATE '2001-05-05' THEN CAST(floor(l_extendedprice) AS BIGINT) ELSE 0 END) AS BIGINT) AS monetary_6m,
               avg(CASE WHEN l_tax > 0.04 THEN 1.0::DOUBLE ELSE 0.0 END) AS insured FROM lineitem GROUP BY 1, 2"""),
    "partner_channels": ((), """
        SELECT l_suppkey AS partner_id, CAST(l_linenumber % 3 AS INTEGER) AS channel,
               CAST(datediff('day', CAST(max(l_shipdate) AS DATE), DATE '2001-11-05') AS INTEGER) AS recency,
               count(*) AS sales, CAST(sum(CAST(floor(l_extendedprice) AS BIGINT)) AS BIGINT) AS monetary,
               count(*) FILTER (l_returnflag = 'R') AS returns, avg(CAST(floor(l_extendedprice) AS BIGINT)) AS ticket,
               avg(l_quantity) AS term,
               CAST(sum(CASE WHEN l_shipdate >= DATE '2001-05-05' THEN CAST(floor(l_extendedprice) AS BIGINT) ELSE 0 END) AS BIGINT) AS monetary_6m,
               avg(CASE WHEN l_tax > 0.04 THEN 1.0::DOUBLE ELSE 0.0 END) AS insured FROM lineitem GROUP BY 1, 2"""),
    "rfm": (("rfm_base",), """
        SELECT a.*, 5 - CAST((recency > r[1]) AS INTEGER) - CAST((recency > r[2]) AS INTEGER) - CAST((recency > r[3]) AS INTEGER)
                 - CAST((recency > r[4]) AS INTEGER) AS r_score,
               1 + CAST((monetary > m[1]) AS INTEGER) + CAST((monetary > m[2]) AS INTEGER) + CAST((monetary > m[3]) AS INTEGER)
                 + CAST((monetary > m[4]) AS INTEGER) AS m_score,
               CASE WHEN frequency BETWEEN 1 AND 3 THEN CAST(frequency AS INTEGER) WHEN frequency BETWEEN 4 AND 5 THEN 4
                    WHEN frequency >= 6 THEN 5 END AS f_score
        FROM rfm_base a CROSS JOIN (
          SELECT quantile_cont(CAST(recency AS DOUBLE), [0.2, 0.4, 0.6, 0.8]) AS r,
                 quantile_cont(CAST(monetary AS DOUBLE), [0.2, 0.4, 0.6, 0.8]) AS m
          FROM rfm_base WHERE recency <= 49 AND frequency <> 0) e
        WHERE recency <= 49 AND frequency <> 0"""),
    "relief": ((), """
        SELECT o_orderkey AS contract_id, CASE WHEN c_mktsegment = 'MACHINERY' THEN 2 ELSE 1 END AS category,
               c_nationkey % 6 + 1 AS subcategory, c_mktsegment AS place,
               CASE WHEN o_orderpriority LIKE '1%' THEN 'SI' ELSE 'NO' END AS refinanced,
               CAST((price % 18) * 30 AS INTEGER) AS arrears_range, CAST(price % 121 - 1 AS INTEGER) AS arrears_days,
               CAST(price % 97 - 1 AS INTEGER) AS final_arrears_days, price * 6 AS gas_current, price * 11 AS gas_overdue,
               price * 45 AS gas_deferred, price * 3 AS credit_current, price * 7 AS credit_overdue, price * 25 AS credit_deferred,
               price % 110000 AS other_current, price % 600000 AS other_overdue, price * 4 AS instalment, c_acctbal AS balance
        FROM (SELECT *, CAST(floor(o_totalprice) AS BIGINT) AS price FROM orders) JOIN customer ON c_custkey = o_custkey"""),
}
