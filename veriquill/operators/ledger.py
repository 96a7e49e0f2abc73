"""Tokens and money. Money is decimal until it is rounded once, at the end."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriquill.operators.sides import small_side

MONEY = "decimal(38,12)"
#: Rates in dollars for a million tokens, by counter.
COUNTERS = {"input_tokens": "input_per_1m", "output_tokens": "output_per_1m", "cache_read_tokens": "cache_read_per_1m", "cache_write_tokens": "cache_write_per_1m", "cache_write_1h_tokens": "cache_write_1h_per_1m"}


def cache_writes(total: Column, five_minutes: Column, one_hour: Column) -> tuple[Column, Column]:
    """Cache writes by how long they hold; what a provider does not split counts as five minutes."""
    zero = F.lit(0).cast("long")
    five, hour = F.coalesce(five_minutes, zero), F.coalesce(one_hour, zero)
    return five + F.greatest(F.coalesce(total, zero) - five - hour, zero), hour


def call_cost(tokens: dict[str, Column], rates: dict[str, Column]) -> Column:
    """The price of one call; null if a counter that is not zero has no rate."""
    parts = []
    for counter, rate in COUNTERS.items():
        n, r = F.coalesce(tokens.get(counter, F.lit(0)), F.lit(0)).cast("decimal(20,0)"), rates.get(rate, F.lit(None)).cast("decimal(18,9)")
        parts.append(F.when(n == 0, F.lit(0).cast(MONEY)).otherwise((n * r / F.lit(1_000_000)).cast(MONEY)))
    out = parts[0]
    for p in parts[1:]:
        out = (out + p).cast(MONEY)
    return out


def rate_cards(roles: DataFrame, operator: DataFrame, table: DataFrame) -> DataFrame:
    """roles (role, model, routed) with the card of each: the operator's for the role, else the table's for the model unless routed.

    No role falls back on another's card.
    """
    cards = list(COUNTERS.values())
    own = operator.select("role", F.struct(*cards).alias("own"))
    listed = table.select("model", F.struct(*cards).alias("listed"))
    both = roles.join(small_side(own), "role", "left").join(small_side(listed), "model", "left")
    card = F.when(F.col("own").isNotNull(), F.col("own")).when(~F.col("routed"), F.col("listed"))
    return both.withColumn("card", card).select(*roles.columns, F.col("card").isNotNull().alias("priced"), "card.*")


def recorded_cost(calls: DataFrame, by: list[str], any_card: Column | None = None) -> DataFrame:
    """(by, calls, cost_usd, cost_incomplete, unreceipted_calls). calls: cost (null if unpriced), receipted (false if its charge was not read).

    One unpriced call leaves no total. Nothing counted and no card leaves none either; nothing counted under a card is 0.
    """
    card = any_card if any_card is not None else F.lit(False)
    billed = calls.withColumn("__card", card).groupBy(*by).agg(
        F.count("*").alias("calls"),
        F.bool_or(F.col("receipted") & F.col("cost").isNull()).alias("unpriced"),
        F.count_if(F.col("receipted") & F.col("cost").isNotNull()).alias("counted"),
        F.sum(F.when(F.col("receipted"), F.col("cost").cast(MONEY))).alias("total"),
        F.bool_or("__card").alias("card"),
        F.count_if(~F.col("receipted")).alias("unreceipted_calls"),
    )
    total = F.when(F.coalesce("unpriced", F.lit(False)), F.lit(None)).when((F.col("counted") > 0) | F.coalesce("card", F.lit(False)), F.bround(F.coalesce("total", F.lit(0)), 6))
    return billed.select(*by, "calls", total.cast("double").alias("cost_usd"), (F.col("unreceipted_calls") > 0).alias("cost_incomplete"), "unreceipted_calls")


def usage(calls: DataFrame, by: list[str]) -> DataFrame:
    """Token sums, over all segments of a run at once: there is no counter to carry from one to the next."""
    return calls.groupBy(*by).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in list(COUNTERS)[:4]])


def transports(calls: DataFrame, by: list[str]) -> DataFrame:
    """(by, transport, providers, generations): one kind of transport or `mixed`; providers as first seen, generations all."""
    rows = F.array_sort(F.collect_list(F.struct("line_no", "provider", "generation")))
    return calls.groupBy(*by).agg(
        F.when(F.min("transport") == F.max("transport"), F.min("transport")).otherwise("mixed").alias("transport"),
        F.array_distinct(F.array_compact(F.transform(rows, lambda r: r["provider"]))).alias("providers"),
        F.array_compact(F.transform(rows, lambda r: r["generation"])).alias("generations"),
    )


def cost_text(cost: Column, missing: Column) -> Column:
    """A cost in words; a sum that leaves calls out is said to be a least."""
    figure = F.format_string("$%.4f", cost)
    return F.when(cost.isNull(), "not priced").when(missing > 0, F.format_string("at least %s (%d calls without a price)", figure, missing)).otherwise(figure)
