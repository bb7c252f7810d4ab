"""Domain tables derived from the driver's tables, for the registered queries.

Money is kept in whole cents so that sums and means do not depend on the order
of addition. Each method is a lazy DataFrame over whole tables.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import ratio_bindings as rb
from tidemark.operators.ordered import moving_averages
from tidemark.operators.series import month_end_last


def cents(column: str) -> Column:
    return F.round(F.col(column) * 100).cast("bigint")


SEGMENTS = ("corp", "bank", "securities")


def base_codes(segment: str) -> list[str]:
    """Accounts a segment reports in the test data: all bound ones but trailing sums and prices."""
    codes = rb.account_codes(rb.BINDINGS[segment])
    return [c for c in codes if not c.endswith("_TTM") and c != "Price"]


class Tables:
    """The driver's tables and what the operators need from them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.dir = sf_dir

    def __getitem__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    # -- series ---------------------------------------------------------------

    @cached_property
    def bars(self) -> DataFrame:
        """Daily bars per order priority: last and first order of the day, extremes, count."""
        rows = self["orders"].select(
            F.col("o_orderpriority").alias("series_key"),
            F.to_date("o_orderdate").alias("time"),
            cents("o_totalprice").cast("double").alias("x"),
            "o_orderkey",
        )
        return rows.groupBy("series_key", "time").agg(
            F.max_by("x", "o_orderkey").alias("close"),
            F.min_by("x", "o_orderkey").alias("open"),
            F.max("x").alias("high"),
            F.min("x").alias("low"),
            F.count(F.lit(1)).alias("volume"),
        )

    @cached_property
    def stock_daily(self) -> DataFrame:
        return self.stock_daily_of()

    def stock_daily_of(self, series: str | None = None) -> DataFrame:
        """Daily table, of one series if asked: its key then reaches every scan."""
        bars = self.bars if series is None else self.bars.where(F.col("series_key") == series)
        return moving_averages(bars, ["series_key"], "time", "close", (20, 50, 200))

    @cached_property
    def stock_monthly(self) -> DataFrame:
        return self.stock_monthly_of()

    def stock_monthly_of(self, series: str | None = None) -> DataFrame:
        bars = self.bars if series is None else self.bars.where(F.col("series_key") == series)
        monthly = month_end_last(bars, ["series_key"], "time", ["close", "volume"])
        return moving_averages(monthly, ["series_key"], "time", "close", (12, 26))

    @cached_property
    def commodity(self) -> DataFrame:
        """Daily rows per event type: last, first and extreme values, count."""
        rows = self["events"].select(
            F.col("event_type").alias("indicator_code"),
            F.initcap("event_type").alias("indicator_name"),
            F.to_date("ts").alias("time"),
            cents("value").cast("double").alias("x"),
            "event_id",
        )
        return rows.groupBy("indicator_code", "indicator_name", "time").agg(
            F.min_by("x", "event_id").alias("open"),
            F.max("x").alias("high"),
            F.min("x").alias("low"),
            F.max_by("x", "event_id").alias("close"),
            F.count(F.lit(1)).alias("volume"),
        )

    @cached_property
    def macro(self) -> DataFrame:
        """Monthly indicators per nation of the customer: order count and turnover in cents."""
        rows = (
            self["orders"]
            .join(self["customer"], F.col("o_custkey") == F.col("c_custkey"))
            .groupBy(
                F.col("c_nationkey"), F.trunc(F.to_date("o_orderdate"), "month").alias("datetime")
            )
            .agg(
                F.count(F.lit(1)).cast("double").alias("Inflation_%"),
                F.sum(cents("o_totalprice")).cast("double").alias("Unemployment_%"),
            )
            .join(
                self["nation"].select("n_nationkey", F.col("n_name").alias("country")),
                F.col("c_nationkey") == F.col("n_nationkey"),
            )
        )
        return rows.unpivot(
            ["country", "datetime"], ["Inflation_%", "Unemployment_%"], "indicator_name", "value"
        )

    # -- companies and statements -----------------------------------------------

    @cached_property
    def companies(self) -> DataFrame:
        nation = self["nation"].join(
            self["region"], F.col("n_regionkey") == F.col("r_regionkey")
        )
        return (
            self["supplier"]
            .join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
            .select(
                F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("stock_code"),
                F.col("s_name").alias("company_name"),
                F.concat(F.lit(" "), "s_name", F.lit("\u00a0of\n"), "n_name", F.lit(" ")).alias(
                    "combine_profile"
                ),
                F.col("n_name").alias("industry"),
                F.col("r_name").alias("exchange"),
                cents("s_acctbal").cast("double").alias("issue_share"),
                self._segment(F.col("s_nationkey")).alias("segment"),
            )
        )

    @staticmethod
    def _segment(nation: Column) -> Column:
        return (
            F.when(nation % 3 == 0, "corp").when(nation % 3 == 1, "bank").otherwise("securities")
        )

    @cached_property
    def statement(self) -> DataFrame:
        """Statement facts: line turnover per supplier, period and account.

        Line number, flags and parity of the quantity choose the account among
        those of the supplier's segment.
        """
        flag = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
        status = F.when(F.col("l_linestatus") == "F", 0).otherwise(1)
        slot = (
            (F.col("l_linenumber") - 1) * 12
            + flag * 4
            + status * 2
            + F.col("l_quantity").cast("bigint") % 2
        )
        arrays = {s: F.array(*[F.lit(c) for c in base_codes(s)]) for s in SEGMENTS}
        account = F.coalesce(
            *[
                F.when(F.col("segment") == s, F.get(a, F.col("slot") % len(base_codes(s))))
                for s, a in arrays.items()
            ]
        )
        owners = self["supplier"].select(
            "s_suppkey", self._segment(F.col("s_nationkey")).alias("segment")
        )
        lines = (
            self["lineitem"]
            .join(owners, F.col("l_suppkey") == F.col("s_suppkey"))
            .select(
                F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("stock_code"),
                "segment",
                slot.cast("int").alias("slot"),
                F.year("l_shipdate").alias("year"),
                F.quarter("l_shipdate").alias("in_quarter"),
                cents("l_extendedprice").alias("x"),
            )
        )
        month = F.when(F.col("quarter") == 0, 12).otherwise(F.col("quarter") * 3)
        # Dealt out by company once, a row per line: most lines are the only one of their account
        # and period, so sums before the exchange would save nothing, and whatever is grouped or
        # ordered by company afterwards finds its rows together.
        dealt = lines.repartition("stock_code").withColumn(
            "quarter", F.explode(F.array("in_quarter", F.lit(0)))
        )
        return (
            dealt.groupBy("stock_code", account.alias("category_code"), "year", "quarter", "segment")
            .agg(F.sum("x").cast("double").alias("data"))
            .withColumn("date_added", F.make_date("year", month, F.lit(30)))
        )

    def segment_statement(self, segment: str) -> DataFrame:
        return self.statement.where(F.col("segment") == segment)

    @cached_property
    def prices(self) -> DataFrame:
        """Quarter-end prices per supplier: highest unit turnover of the period, in cents."""
        rows = self["lineitem"].select(
            F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("stock_code"),
            F.year("l_shipdate").alias("year"),
            F.quarter("l_shipdate").alias("quarter"),
            cents("l_extendedprice").cast("double").alias("x"),
        )
        return (
            rows.withColumn("quarter", F.explode(F.array("quarter", F.lit(0))))
            .groupBy("stock_code", "year", "quarter")
            .agg(F.max("x").alias("close"))
        )

    # -- news and vectors ------------------------------------------------------------

    @cached_property
    def news(self) -> DataFrame:
        return self["documents"].select(
            F.concat(F.lit("doc://"), F.col("doc_id").cast("string")).alias("url"),
            "source",
            F.regexp_extract("text", r"^[^.!?\n]*", 0).alias("title"),
            _document_time(F.col("doc_id")).alias("pub_date"),
            F.col("lang").alias("channel_name"),
            F.substring("source", 4, 10).cast("bigint").alias("channel_id"),
            "text",
        )

    @cached_property
    def points(self) -> DataFrame:
        """Chunk vectors, two per article."""
        doc = F.floor(F.col("vec_id") / 2).cast("bigint")
        return self["embeddings"].select(
            "vec_id",
            F.concat(F.lit("doc://"), doc.cast("string")).alias("url"),
            (F.col("vec_id") % 2).alias("chunk_index"),
            _document_time(doc).alias("pub_date"),
            "embedding",
            "label",
        )

    @cached_property
    def topic_queries(self) -> DataFrame:
        """(label, vector of its first chunk): the search requests, one per label."""
        first = self["embeddings"].groupBy("label").agg(F.min_by("embedding", "vec_id").alias("embedding"))
        return first.select(F.col("label").cast("long").alias("query_id"), "embedding")

    # -- requests and answers ---------------------------------------------------------

    @cached_property
    def requests(self) -> DataFrame:
        """Date-ranged requests with the date they were asked, one per event."""
        day = F.to_date("ts")
        i = F.col("event_id")
        text = lambda c: F.date_format(c, "yyyy-MM-dd")
        return self["events"].select(
            "event_id",
            text(F.date_sub(day, (i % 40).cast("int"))).alias("start_date"),
            F.when(i % 17 == 0, "latest")
            .otherwise(text(F.date_add(day, (i % 50).cast("int"))))
            .alias("end_date"),
            text(F.date_add(F.date_sub(day, 20), (i % 45).cast("int"))).alias("time_asked"),
        )

    @cached_property
    def answers(self) -> DataFrame:
        """Text answers to score; every fifth has no number."""
        i = F.col("event_id")
        pair = F.concat(
            F.lit("\\boxed{"),
            (i % 100).cast("string"),
            F.lit("} \\pm \\boxed{"),
            (i % 7).cast("string"),
            F.lit("}"),
        )
        return self["events"].select(
            i.alias("question_id"),
            F.col("value").alias("gt_mean"),
            (i % 3).cast("double").alias("gt_std"),
            F.concat(
                F.repeat(F.lit("<tool_call>{\n}</tool_call>"), (i % 23).cast("int")),
                F.lit("<think>\\boxed{1} \\pm \\boxed{1}</think>"),
                F.when(i % 5 == 0, "no number").otherwise(pair),
            ).alias("response"),
        )


def _document_time(doc: Column) -> Column:
    """Day and hour of 2024 that follow from the document number."""
    start = F.expr("timestamp_ntz'2024-01-01 00:00:00'")
    return start + F.make_dt_interval(
        (doc % 365).cast("int"), (doc % 24).cast("int"), F.lit(0), F.lit(0)
    )
