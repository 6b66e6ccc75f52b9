"""Pages over a total order, their totals, and the links of a pager."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIZES = (10, 25, 100)
TOP = 100


def page(rows: DataFrame, limit: int = 25, number: int = 1, order: tuple = ("uuid",)) -> DataFrame:
    """Page number (1-based) of rows; an empty page beyond the last."""
    if limit < 1 or number < 1:
        raise ValueError("limit and page start at 1")
    return rows.orderBy(*order).offset((number - 1) * limit).limit(limit)


def page_after(rows: DataFrame, last: str | None, limit: int = 25) -> DataFrame:
    """The page after the row with uuid last: deep pages without sorting what comes before."""
    return (rows if last is None else rows.filter(F.col("uuid") > last)).orderBy("uuid").limit(limit)


def ui_page(rows: DataFrame, size: int, zero_based: int) -> DataFrame:
    if size not in SIZES:
        raise ValueError(f"page sizes are {SIZES}")
    return page(rows, size, zero_based + 1)


def summary(rows: DataFrame, limit: int, number: int) -> DataFrame:
    """One row: next, previous, page_number, total_items, total_pages, shown."""
    total = rows.agg(F.count(F.lit(1)).alias("total_items"))
    pages = F.ceil(F.col("total_items") / limit).cast("int")
    link = lambda n: F.lit(f"?limit={limit}&page={n}")
    return total.select(
        F.when(F.lit(number) < pages, link(number + 1)).otherwise("").alias("next"),
        F.when((F.lit(number) > 1) & (F.lit(number - 1) <= pages), link(number - 1)).otherwise("").alias("previous"),
        F.lit(number).alias("page_number"),
        "total_items",
        pages.alias("total_pages"),
        F.least("total_items", F.lit(limit)).alias("shown"),
    )


def initial_size(total_pages: Column, total: Column, shown: Column) -> Column:
    return F.when(total_pages > 1, shown).when(total <= 10, 10).when(total <= 25, 25).otherwise(100)


#: Label and condition of each element of a pager on 0-based page p of n, in order.
_LINKS = (
    ("'Previous'", "true"),
    ("'1'", "n > 0"),
    ("'2'", "n > 2 and p = 0"),
    ("'...'", "p <= n - 1 and p - 1 > 1"),
    ("cast(p as string)", "p + 1 <= n - 1 and p - 1 > 0"),
    ("cast(p + 1 as string)", "p > 0 and p < n - 1"),
    ("cast(p + 2 as string)", "p >= 1 and p + 1 < n - 1"),
    ("'...'", "p >= 0 and p + 1 < n - 2"),
    ("cast(n - 1 as string)", "n > 2 and p = n - 1"),
    ("cast(n as string)", "n > 1"),
    ("'Next'", "true"),
)


def page_links(pages: DataFrame, *carry: str) -> DataFrame:
    """p, n to an array of labels in display order, and whether Previous and Next are disabled; with the columns in carry."""
    shown = "filter(array({}), x -> x is not null)".format(", ".join(f"if({cond}, {label}, null)" for label, cond in _LINKS))
    return pages.select(*carry, "p", "n", F.expr(shown).alias("links"), F.expr("p = 0").alias("previous_disabled"), F.expr("p = n - 1").alias("next_disabled"))
