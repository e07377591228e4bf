"""Sale-detail search and its breakdowns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tillstream.operators.orders import amount_sum
from tillstream.operators.sales import with_buyers


def match_sales(
    sales: DataFrame, day: str | None = None, keyword: str | None = None
) -> DataFrame:
    """Sales of a day whose item name contains the keyword, in any case."""
    if day:
        sales = sales.where(F.col("dt") == day)
    if keyword:
        sales = sales.where(F.contains(F.lower("sku_name"), F.lit(keyword.lower())))
    return sales


def total_rows(matched: DataFrame) -> DataFrame:
    return matched.agg(F.count("*").alias("total"))


PAGED_ROWS = 10_000


def page_rows(
    matched: DataFrame, page: int, size: int, order: tuple[str, ...] = ("order_detail_id",)
) -> DataFrame:
    """One result page, pages counted from 1.

    A numbered page costs all rows before it, so it must lie within the first
    ``PAGED_ROWS`` rows; ``page_after`` goes to any depth.
    """
    if page < 1 or size < 1:
        raise ValueError("page and size start at 1")
    if page * size > PAGED_ROWS:
        raise ValueError(f"pages end at row {PAGED_ROWS}; use page_after beyond")
    return matched.orderBy(*order).offset((page - 1) * size).limit(size)


def page_after(
    matched: DataFrame, after: tuple | None, size: int,
    order: tuple[str, ...] = ("order_detail_id",),
) -> DataFrame:
    """The page that follows the row with the order values ``after``.

    ``order`` must tell rows apart.  Each task keeps ``size`` rows, however
    deep the page lies.
    """
    if size < 1:
        raise ValueError("size starts at 1")
    if after is not None:
        beyond = F.lit(False)
        for column, value in reversed(list(zip(order, after, strict=True))):
            beyond = (F.col(column) > F.lit(value)) | ((F.col(column) == F.lit(value)) & beyond)
        matched = matched.where(beyond)
    return matched.orderBy(*order).limit(size)


def share_by(matched: DataFrame, category: Column, weight: str | None = None) -> DataFrame:
    """Row count and percentage per category; ``weight`` counts rows already summed.

    The percentages come from totals per category, not from rows.
    """
    n = F.sum(weight) if weight else F.count("*")
    counts = matched.groupBy(category.alias("name")).agg(n.alias("value"))
    everything = F.sum("value").over(Window.partitionBy())
    return counts.withColumn(
        "share", F.round(F.col("value") * F.lit(100.0) / everything, 2)
    )


def per_buyer(matched: DataFrame, users: DataFrame, as_of: str | None = None) -> DataFrame:
    """Sales per buyer with the buyer's columns: one row ``user_id, n`` each."""
    counts = matched.groupBy("user_id").agg(F.count("*").alias("n"))
    return with_buyers(counts, users, as_of)


# The age labels of the dashboard.
AGE_UNDER_20 = "20岁以下"
AGE_20_TO_30 = "20-30岁"
AGE_FROM_30 = "30岁以上"


def age_group(age: str) -> Column:
    return (
        F.when(F.col(age) < 20, AGE_UNDER_20)
        .when(F.col(age) < 30, AGE_20_TO_30)
        .otherwise(AGE_FROM_30)
    )


def gender_share(matched: DataFrame, weight: str | None = None) -> DataFrame:
    return share_by(matched, F.col("user_gender"), weight)


def age_share(matched: DataFrame, weight: str | None = None) -> DataFrame:
    return share_by(matched, age_group("user_age"), weight)


def region_volume(orders: DataFrame, region: str, amount: str) -> DataFrame:
    """Orders and their amount per region."""
    return orders.groupBy(F.col(region).alias("region")).agg(
        F.count("*").alias("orders"), amount_sum(amount).alias("amount")
    )


def search_sales(
    sales: DataFrame, day: str | None, keyword: str | None, page: int, size: int,
    after: tuple | None = None,
) -> dict[str, DataFrame]:
    """The answer of a sale search: ``total``, ``detail`` and both breakdowns.

    With ``after``, the order values of a page's last row (``order_detail_id``),
    the detail is the page that follows it, at any depth; ``page`` is not used then.
    """
    matched = match_sales(sales, day, keyword)
    return {
        "total": total_rows(matched),
        "detail": page_rows(matched, page, size) if after is None else page_after(matched, after, size),
        "gender": gender_share(matched),
        "age": age_share(matched),
    }


def search_answer(answer: dict[str, DataFrame]) -> DataFrame:
    """The four parts of a search as one JSON object: total, stat, detail.

    Each part has few rows by then: one, the categories, and one page.
    """

    def part(name: str, rows: DataFrame) -> DataFrame:
        return rows.select(F.lit(name).alias("part"), F.to_json(F.struct(*rows.columns)).alias("row"))

    parts = part("total", answer["total"])
    for name in ("gender", "age", "detail"):
        parts = parts.unionByName(part(name, answer[name]))

    def rows_of(name: str) -> Column:
        return F.array_sort(F.collect_list(F.when(F.col("part") == name, F.col("row"))))

    def listed(name: str) -> Column:
        return F.concat(F.lit("["), F.array_join(rows_of(name), ","), F.lit("]"))

    total = F.max(F.when(F.col("part") == "total", F.get_json_object("row", "$.total")))
    return parts.agg(F.concat(
        F.lit('{"total":'), total, F.lit(',"stat":{"gender":'), listed("gender"),
        F.lit(',"age":'), listed("age"), F.lit('},"detail":'), listed("detail"), F.lit("}"),
    ).alias("value"))
