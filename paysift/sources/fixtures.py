"""Stand-in payment and price tables derived from the TPC-H-like test data.

The original application reads hospital payment CSVs (grain: procedure group x provider) and a
wide table of monthly regional house prices. Here the same shapes are derived from the base
tables so that every query's work grows with the data:

- payments: one row per (group = part size, provider). The source has one file per year, so a
  provider is a supplier in one ship year (``7-1998``), and every lineitem counts; zip =
  supplier nation. Money columns are averages of whole cents, computed as integer cent sums
  divided once, so two engines agree bit for bit.
- prices: one row per region (nation) and one text column per month: the average order value,
  null where a region has no order in the month.

Plan notes for scale: lineitem is pre-aggregated to (part, supplier, year) before it meets
``part`` and ``supplier``; cent sums and counts are additive, so this is exact and shrinks the
rows that reach the join shuffle. A wide price table reads only the months that are used: each
month is an aggregate of its own, pruned when unused. Join strategies are left to Catalyst/AQE:
``part`` and ``supplier`` grow with the scale factor and must not be forced into a broadcast.
The partitions of the two aggregates follow the number of lineitems (``session.spread``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import spread
from .tables import table

# Fixed values of the stand-in tables (must match the oracle SQL in plans/oracle.py).
PRICE_MONTH = "2000-12"
GROUP_SUFFIX = " - PROC"

GROUP = "DRGDefinition"
PROVIDER = "ProviderId"
ZIP = "ProviderZipCode"
DISCHARGES = "TotalDischarges"
PAYMENT = "AverageTotalPayments"
COVERED = "AverageCoveredCharges"
MEDICARE = "AverageMedicarePayments"
REGION = "RegionName"
MONEY_COLUMNS = [COVERED, PAYMENT, MEDICARE]


def _cents(c) -> F.Column:
    return F.round(c * 100).cast("bigint")


def _line_sums(spark: SparkSession, sf_dir: str, by_year: bool, lines: int) -> DataFrame:
    # by part, which the next join needs as well
    li = spread(table(spark, sf_dir, "lineitem").select(
        "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_tax", "l_discount"), lines, "l_partkey")
    price = F.col("l_extendedprice")
    year = [F.year("l_shipdate").alias("l_year")] if by_year else []
    return li.groupBy("l_partkey", "l_suppkey", *year).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(_cents(price)).alias("paid_c"),
        F.sum(_cents(price * (1 + F.col("l_tax")))).alias("covered_c"),
        F.sum(_cents(price * (1 - F.col("l_discount")))).alias("medicare_c"),
    )


def _payments_by(spark: SparkSession, sf_dir: str, group_expr: F.Column, part_cols: list[str],
                 by_year: bool) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", *part_cols)
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    provider = F.col("l_suppkey").cast("string")
    if by_year:
        provider = F.concat_ws("-", provider, F.col("l_year").cast("string"))
    lines = table(spark, sf_dir, "lineitem").count()  # from the files' footers
    rows = (
        spread(
            _line_sums(spark, sf_dir, by_year, lines)
            .join(part, F.col("l_partkey") == F.col("p_partkey"))
            .join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
            .withColumns({GROUP: group_expr, PROVIDER: provider}), lines, GROUP, PROVIDER, "s_nationkey")
        .groupBy(GROUP, PROVIDER, "s_nationkey")
        .agg(
            F.sum("n").alias("n"),
            F.sum("paid_c").alias("paid_c"),
            F.sum("covered_c").alias("covered_c"),
            F.sum("medicare_c").alias("medicare_c"),
        )
    )
    n = F.col("n")
    return rows.select(
        F.col(GROUP),
        F.col(PROVIDER),
        F.lpad(F.col("s_nationkey").cast("string"), 5, "0").alias(ZIP),
        n.cast("string").alias(DISCHARGES),
        (F.col("paid_c") / F.lit(100.0) / n).alias(PAYMENT),
        (F.col("covered_c") / F.lit(100.0) / n).alias(COVERED),
        (F.col("medicare_c") / F.lit(100.0) / n).alias(MEDICARE),
    )


def payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payments, grain (DRGDefinition, ProviderId); money already clean doubles."""
    group = F.concat(F.lpad(F.col("p_size").cast("string"), 3, "0"), F.lit(GROUP_SUFFIX))
    return _payments_by(spark, sf_dir, group, ["p_size"], True)


def brand_payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prefix-collision stand-in: the group is ``p_brand`` (``Brand#1`` is a prefix of
    ``Brand#10`` .. ``Brand#19``), all years."""
    return _payments_by(spark, sf_dir, F.col("p_brand"), ["p_brand"], False)


# Raw header names of the source CSV: the cleaning operators strip the blanks.
RAW_HEADERS = {
    GROUP: "DRG Definition",
    PROVIDER: "Provider Id",
    ZIP: "Provider Zip Code",
    DISCHARGES: " Total Discharges ",
    COVERED: "Average Covered Charges",
    PAYMENT: "Average Total Payments",
    MEDICARE: "Average  Medicare Payments",
}


def payments_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payments as a header CSV would deliver them: spaced headers, every column text, money
    with a leading ``$``."""
    p = payments(spark, sf_dir)
    cols = []
    for c in p.columns:
        v = F.col(c)
        if c in MONEY_COLUMNS:
            v = F.concat(F.lit("$"), v.cast("string"))
        cols.append(v.alias(RAW_HEADERS[c]))
    return p.select(*cols)


def prices(spark: SparkSession, sf_dir: str, months: tuple[str, ...] = (PRICE_MONTH,)) -> DataFrame:
    """Wide regional price table: ``RegionName`` plus one text column per month of ``months``."""
    month = F.date_format("o_orderdate", "yyyy-MM")
    orders = (
        table(spark, sf_dir, "orders")
        .where(F.col("o_orderdate") >= F.expr(f"TIMESTAMP_NTZ'{min(months)}-01 00:00:00'"))
        .groupBy("o_custkey", month.alias("m"))
        .agg(F.count(F.lit(1)).alias("n"), F.sum(_cents(F.col("o_totalprice"))).alias("c"))
        .where(F.col("m").isin(*months))
    )
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    of = lambda c, m: F.sum(F.when(F.col("m") == m, F.col(c)))
    by_nation = (
        orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy("c_nationkey")
        .agg(*(F.floor(of("c", m) / of("n", m)).cast("bigint").cast("string").alias(m) for m in months))
    )
    nation = table(spark, sf_dir, "nation").select("n_nationkey")
    return nation.join(by_nation, F.col("n_nationkey") == F.col("c_nationkey"), "left").select(
        F.lpad(F.col("n_nationkey").cast("string"), 5, "0").alias(REGION), *(F.col(f"`{m}`") for m in months))


def joined(spark: SparkSession, sf_dir: str, month: str = PRICE_MONTH, groups: str = "size") -> DataFrame:
    """The analysis table: payments joined to the regional price of ``month``. ``groups``
    chooses the payment stand-in: ``size`` (50 groups) or ``brand`` (the
    prefix-collision fixture)."""
    from ..operators.joins import join_on_region
    from ..operators.clean import not_null

    regions = not_null(prices(spark, sf_dir, (month,)), [month])
    facts = payments(spark, sf_dir) if groups == "size" else brand_payments(spark, sf_dir)
    return join_on_region(facts, regions).select(
        GROUP, PROVIDER, ZIP, DISCHARGES, month, PAYMENT
    )
