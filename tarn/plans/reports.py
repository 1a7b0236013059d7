"""The business reports. Each takes contract-shaped tables and, where time matters, ``as_of``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.functions import money
from tarn.functions.moments import AsOf, day_start, days_between, moment
from tarn.operators.ranking import top_rows

WON, LOST = "closedwon", "closedlost"


def _since(df: DataFrame, column: str, as_of: AsOf, back: str) -> Column:
    """Rows not older than ``back`` before the start of the anchor day."""
    return F.col(column) >= moment(df, column, day_start(as_of)) - F.expr(f"INTERVAL {back}")


def _period_start(df: DataFrame, column: str, as_of: AsOf, unit: str) -> Column:
    """Start of the calendar period the anchor falls in, as a literal of the column's type."""
    start = F.date_trunc(unit, F.lit(day_start(as_of)).cast("timestamp"))
    return start.cast(df.schema[column].dataType)


def _newest_periods(df: DataFrame, column: str, unit: str, n: int) -> DataFrame:
    """Rows of the ``n`` newest periods. One value comes to the driver, and the filter reaches the reader."""
    periods = df.select(F.date_trunc(unit, column).alias("period")).distinct()
    newest = periods.orderBy(F.col("period").desc_nulls_last()).limit(n)
    found = newest.agg(F.count("*").alias("n"), F.min("period").alias("start"), F.count("period").alias("dated")).first()
    if found.n < n or found.dated < n:
        return df  # all of them
    return df.where(F.col(column) >= F.lit(found.start).cast(df.schema[column].dataType))


def recent_charges(charges: DataFrame, limit: int = 20) -> DataFrame:
    """Newest charges, complete rows."""
    return top_rows(charges, [("created_at", False), ("charge_id", True)], limit)


def top_products(line_items: DataFrame, limit: int = 20) -> DataFrame:
    """Best sellers by list price times quantity."""
    return (
        line_items.groupBy("title")
        .agg(
            F.sum("quantity").cast("bigint").alias("units"),
            money.total(F.col("price_usd") * F.col("quantity")).alias("revenue"),
        )
        .orderBy(F.col("revenue").desc_nulls_last(), "title")
        .limit(limit)
    )


def _open_deals(deals: DataFrame, closed: tuple[str, ...]) -> DataFrame:
    return deals.where(~F.col("stage").isin(*closed))


def deals_by_stage(deals: DataFrame, closed: tuple[str, ...] = (WON, LOST)) -> DataFrame:
    """Open deals and their value per stage."""
    return (
        _open_deals(deals, closed)
        .groupBy("stage")
        .agg(F.count("*").alias("deals"), money.total(F.col("amount_usd")).alias("value"))
        .orderBy(F.col("value").desc_nulls_last(), "stage")
    )


def embedding_count(embeddings: DataFrame) -> DataFrame:
    """Stored vectors per source."""
    return (
        embeddings.groupBy("source")
        .agg(F.count("*").alias("cnt"))
        .orderBy(F.col("cnt").desc(), F.col("source").asc_nulls_last())
    )


def mrr_by_plan(subscriptions: DataFrame) -> DataFrame:
    """Monthly recurring revenue of active subscriptions per plan."""
    return (
        subscriptions.where(F.col("status") == "active")
        .groupBy("plan_name")
        .agg(
            F.count("*").alias("active_subscribers"),
            money.total(F.col("amount_usd")).alias("mrr_usd"),
        )
        .orderBy(F.col("mrr_usd").desc_nulls_last(), "plan_name")
    )


def daily_revenue(charges: DataFrame, as_of: AsOf, days: int = 30) -> DataFrame:
    """Gross revenue, refunds and disputes per day over the last ``days`` days."""
    amount = F.col("amount_usd")
    return (
        charges.where(_since(charges, "created_at", as_of, f"{int(days)} DAYS"))
        .groupBy(F.date_trunc("day", "created_at").alias("day"))
        .agg(
            money.total(amount, where=F.col("status") == "succeeded").alias("gross_revenue"),
            money.total(amount, where=F.col("refunded")).alias("refunds"),
            money.count_where(F.col("dispute")).alias("disputes"),
        )
        .orderBy(F.col("day").asc_nulls_last())
    )


def monthly_churn(subscriptions: DataFrame, as_of: AsOf, months: int = 6) -> DataFrame:
    """New subscriptions per start month, and how many of them were cancelled in the anchor month."""
    this_month = F.date_trunc("month", F.lit(day_start(as_of)).cast("timestamp"))
    canceled = F.col("canceled_at").isNotNull() & (
        F.date_trunc("month", "canceled_at") == this_month
    )
    recent = _newest_periods(subscriptions, "created_at", "month", months)
    return (
        recent.groupBy(F.date_trunc("month", "created_at").alias("month"))
        .agg(
            money.count_where(F.col("status") == "active").alias("new_subs"),
            money.count_where(canceled).alias("canceled"),
        )
        .orderBy(F.col("month").desc())
        .limit(months)
    )


def top_products_net(
    line_items: DataFrame,
    orders: DataFrame,
    as_of: AsOf,
    limit: int = 20,
    products: DataFrame | None = None,
) -> DataFrame:
    """Best sellers of the anchor's quarter by revenue after discounts.

    When titles live in a ``products`` table (``product_id, title``), sales are summed per product
    first, so the join with it carries one row per product.
    """
    in_quarter = orders.where(
        F.col("created_at") >= _period_start(orders, "created_at", as_of, "quarter")
    ).select("order_id")
    net = F.col("price_usd") * F.col("quantity") - F.col("total_discount_usd")
    sales = (
        line_items.join(in_quarter, "order_id")
        .groupBy("title" if products is None else "product_id")
        .agg(F.sum("quantity").alias("units"), money.exact_sum(net).alias("net"))
    )
    if products is not None:
        sales = (
            sales.join(products.select("product_id", "title"), "product_id")
            .groupBy("title")
            .agg(F.sum("units").alias("units"), money.exact_sum(F.col("net")).alias("net"))
        )
    return (
        sales.select(
            "title",
            F.col("units").cast("bigint").alias("units_sold"),
            money.rounded(F.col("net"), 2).alias("net_revenue"),
        )
        .orderBy(F.col("net_revenue").desc_nulls_last(), "title")
        .limit(limit)
    )


def aov_by_source(orders: DataFrame, as_of: AsOf, days: int = 90) -> DataFrame:
    """Paid orders per traffic source: count, average value, revenue."""
    return (
        orders.where(
            (F.col("financial_status") == "paid")
            & _since(orders, "created_at", as_of, f"{int(days)} DAYS")
        )
        .groupBy("source_name")
        .agg(
            F.count("*").alias("orders"),
            money.mean(F.col("total_usd")).alias("avg_order_value"),
            money.total(F.col("total_usd")).alias("total_revenue"),
        )
        .orderBy(F.col("total_revenue").desc_nulls_last(), "source_name")
    )


def stale_unfulfilled(orders: DataFrame, as_of: AsOf, hours: int = 48) -> DataFrame:
    """Paid orders still unfulfilled after ``hours``; here ``as_of`` is a full timestamp."""
    limit = moment(orders, "created_at", as_of) - F.expr(f"INTERVAL {int(hours)} HOURS")
    return (
        orders.where(
            F.col("fulfillment_status").isNull()
            & (F.col("financial_status") == "paid")
            & (F.col("created_at") < limit)
        )
        .select("order_id", "order_number", "email", "total_usd", "created_at")
        .orderBy(F.col("created_at").asc_nulls_last(), "order_id")
    )


def open_deals(deals: DataFrame, closed: tuple[str, ...] = (WON, LOST)) -> DataFrame:
    """Open deals per stage: count, total and average size."""
    return (
        _open_deals(deals, closed)
        .groupBy("stage")
        .agg(
            F.count("*").alias("deals"),
            money.total(F.col("amount_usd")).alias("total_value"),
            money.mean(F.col("amount_usd")).alias("avg_deal_size"),
        )
        .orderBy(F.col("total_value").desc_nulls_last(), "stage")
    )


def win_rate(deals: DataFrame, won: str = WON, lost: str = LOST) -> DataFrame:
    """Won and lost deals, win rate and average days to win, per owner."""
    is_won = F.col("stage") == won
    cycle = F.when(is_won, days_between(F.col("last_modified_at"), F.col("created_at")))
    return (
        deals.where(F.col("stage").isin(won, lost))
        .groupBy("owner_name")
        .agg(
            money.count_where(is_won).alias("won"),
            money.count_where(F.col("stage") == lost).alias("lost"),
            F.round(
                money.count_where(is_won).cast("double") * 100.0 / F.count("*"), 1
            ).alias("win_rate_pct"),
            F.round(F.avg(cycle), 0).alias("avg_cycle_days"),
        )
        .orderBy(F.col("won").desc(), F.col("owner_name").asc_nulls_last())
    )


def new_contacts(contacts: DataFrame, as_of: AsOf) -> DataFrame:
    """Contacts created since the start of the anchor's month, per lead source."""
    return (
        contacts.where(F.col("created_at") >= _period_start(contacts, "created_at", as_of, "month"))
        .groupBy("lead_source")
        .agg(F.count("*").alias("new_contacts"))
        .orderBy(F.col("new_contacts").desc(), F.col("lead_source").asc_nulls_last())
    )


def signups_vs_won(
    users: DataFrame,
    deals: DataFrame,
    user_key: str = "email",
    deal_key: str = "owner_name",
    won: str = WON,
    weeks: int = 12,
) -> DataFrame:
    """Distinct signups and distinct won deals matched to them, per signup week.

    A left join only adds deals to a week; signups come from the users alone, so the two counts are
    computed apart. A deal that always carries the same key is counted per key before the join, which
    then moves one number per key instead of a pair for every deal and week; only deals seen under
    several keys are joined one by one, to be counted once per week. Only users of the newest weeks, and deals with
    a key of theirs, are looked at.
    """
    signed_up = _newest_periods(users, "created_at", "week", weeks).withColumn("week", F.date_trunc("week", "created_at"))
    signups = signed_up.groupBy("week").agg(F.count_distinct("user_id").alias("signups"))
    keys = signed_up.select("week", F.col(user_key).alias("match_key")).distinct()
    is_won = (F.col("stage") == won) & F.col(deal_key).isNotNull()
    pairs = deals.where(is_won).select(F.col(deal_key).alias("match_key"), "deal_id")
    pairs = pairs.join(keys.select("match_key").distinct(), "match_key", "left_semi").distinct()
    per_deal = pairs.groupBy("deal_id").agg(F.count("*").alias("n"), F.min("match_key").alias("match_key"))
    counted = per_deal.where("n = 1").groupBy("match_key").agg(F.count("deal_id").alias("closed_won"))
    shared = pairs.join(per_deal.where("n > 1").select("deal_id"), "deal_id", "left_semi")
    matched = (
        keys.join(counted, "match_key")
        .select("week", "closed_won")
        .unionByName(
            keys.join(shared, "match_key")
            .groupBy("week")
            .agg(F.count_distinct("deal_id").alias("closed_won"))
        )
        .groupBy("week")
        .agg(F.sum("closed_won").alias("closed_won"))
    )
    return (
        signups.alias("s")
        .join(matched.alias("m"), F.col("s.week").eqNullSafe(F.col("m.week")), "left")
        .select(
            "s.week",
            "s.signups",
            F.coalesce(F.col("m.closed_won"), F.lit(0).cast("bigint")).alias("closed_won"),
        )
        .orderBy(F.col("week").desc_nulls_last())
        .limit(weeks)
    )


def daily_weather(weather: DataFrame) -> DataFrame:
    """Hourly readings rolled up to one row per day."""
    return weather.groupBy(F.date_trunc("day", "timestamp").alias("date")).agg(
        money.rounded(money.exact_sum(F.col("precipitation")), 6).alias("precipitation_sum")
    )


def orders_by_weather(orders: DataFrame, weather: DataFrame) -> DataFrame:
    """Order count and average value by whole units of rain.

    Orders are summed per day before the join, so the join sees one row per day on both sides.
    """
    per_day = orders.groupBy(F.date_trunc("day", "created_at").alias("date")).agg(
        F.count("order_id").alias("n_orders"),
        F.count("total_usd").alias("n_values"),
        money.exact_sum(F.col("total_usd")).alias("value"),
    )
    return (
        per_day.join(daily_weather(weather), "date")
        .groupBy(F.round("precipitation_sum", 0).alias("rain_mm"))
        .agg(
            F.sum("n_orders").alias("orders"),
            money.rounded(
                money.exact_sum(F.col("value")) / F.nullif(F.sum("n_values"), F.lit(0)), 2
            ).alias("avg_order_value"),
        )
        .orderBy(F.col("rain_mm").asc_nulls_last())
    )
