"""Aggregates as ordered lines of text. Only aggregates enter, never sales rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyhouse.functions.columns import money_text, percent_text, ratio
from tallyhouse.operators.forecast import forecast_inventory
from tallyhouse.operators.sales import (
    category_mom_growth,
    data_span,
    monthly_revenue,
    revenue_kpis,
)


def _section(df: DataFrame, number: int, order: list[Column], text: Column) -> DataFrame:
    """Numbered lines of one section; a section holds a few aggregate rows."""
    section = df.withColumn("section", F.lit(number))
    line = F.row_number().over(Window.partitionBy("section").orderBy(*order))
    return section.select("section", line.alias("line_no"), text.alias("text"))


def _breakdown(kpis: DataFrame, total: Column, number: int, dim: str, text) -> DataFrame:
    rows = kpis.filter(F.col("section") == dim).drop("section")
    share = ratio(F.col("revenue"), total)
    return _section(rows, number, [F.desc("revenue"), F.asc("name")], text(share))


def bounded_context(
    cube: DataFrame, quality_log: DataFrame, batches: DataFrame, forecasts: DataFrame
) -> DataFrame:
    """(section, line_no, text); sections: 1 span and totals, 2 categories,
    3 regions, 4 months, 5 growth, 6 quality, 7 forecasts. ``cube`` is read several
    times, so pass a stored ``revenue_cube``."""
    kpis = revenue_kpis(cube)
    total = kpis.filter("section = 'total'").select("revenue").scalar()

    def share_line(share):
        return F.concat(
            "name", F.lit(": "), money_text(F.col("revenue")), F.lit(" ("), percent_text(share), F.lit(")")
        )

    span = data_span(cube).select(
        F.posexplode(
            F.array(
                F.concat(F.lit("Date range : "), "first_day", F.lit(" to "), "last_day"),
                F.concat(F.lit("Total revenue : "), money_text(F.col("total_revenue"))),
                F.concat(F.lit("Total transactions : "), F.format_number("transactions", 0)),
            )
        ).alias("n", "line")
    )
    growth = category_mom_growth(cube)
    months = F.concat(F.date_format("month", "yyyy-MM"), F.lit(": "), money_text(F.col("revenue")))
    moves = F.concat("category", F.lit(": "), percent_text(F.col("growth"), signed=True))
    issues = quality_log.agg(F.count("*").alias("n"))
    loads = batches.agg(F.count("*").alias("n"))
    stock = forecast_inventory(forecasts)
    parts = [
        _section(span, 1, [F.asc("n")], F.col("line")),
        _breakdown(kpis, total, 2, "category", share_line),
        _breakdown(kpis, total, 3, "region", share_line),
        _section(monthly_revenue(cube), 4, [F.asc("month")], months),
        _section(growth, 5, [F.asc("growth"), F.asc("category")], moves),
        _line(growth.agg(F.count("*").alias("k")).filter("k = 0"), 5, 1, F.lit("N/A")),
        _line(issues, 6, 1, F.concat(F.lit("Total quality issues logged: "), "n")),
        _line(loads, 6, 2, F.concat(F.lit("Total ingestion batches: "), "n")),
        _line(
            stock,
            7,
            1,
            F.concat(
                F.lit("Forecast rows: "),
                "forecast_rows",
                F.lit(" (latest target: "),
                F.coalesce(F.col("latest_target").cast("string"), F.lit("None")),
                F.lit(")"),
            ),
        ),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _line(df: DataFrame, section: int, line: int, text: Column) -> DataFrame:
    return df.select(
        F.lit(section).alias("section"), F.lit(line).alias("line_no"), text.alias("text")
    )


def insights_summary(cube: DataFrame) -> DataFrame:
    """(section, line_no, text): total, shares by category and region, the leader."""
    kpis = revenue_kpis(cube)
    total = kpis.filter("section = 'total'").select("revenue").scalar()

    def share_line(share):
        return F.concat(
            "name", F.lit(": "), money_text(F.col("revenue")), F.lit("  ("), percent_text(share), F.lit(")")
        )

    def leader_line(share):
        return F.concat(
            F.lit("Leading category '"), "name", F.lit("' accounts for "),
            percent_text(share), F.lit(" of total revenue."),
        )

    head = _line(
        kpis.filter("section = 'total'"),
        1,
        1,
        F.concat(F.lit("Total revenue: "), money_text(F.col("revenue"))),
    )
    leader = _breakdown(kpis, total, 4, "category", leader_line).filter("line_no = 1")
    return (
        head.unionByName(_breakdown(kpis, total, 2, "category", share_line))
        .unionByName(_breakdown(kpis, total, 3, "region", share_line))
        .unionByName(leader)
    )
