"""Data transfer and object storage breakdowns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from costweave import schema as S
from costweave.functions import cost as C
from costweave.operators.breakdown import ACCOUNT, AMOUNT, PRODUCT
from costweave.operators.trend import USAGE_TYPE
from costweave.sources.period import Period

# Which words in a usage type put it into which category; the first hit wins.
STORAGE_WORDS = ("TimedStorage",)
REQUEST_WORDS = ("Requests", "Select", "Inventory", "BatchOperations", "Replication")
TRANSFER_WORDS = ("Bytes",)


def data_transfer(df: DataFrame, period: Period,
                  products: Sequence[str] | None = None) -> DataFrame:
    """Cost of moved bytes per service, usage type and end points.

    Usage amounts are per usage type, never totalled over types: their units differ.
    """
    rows = period.scope(df).where(
        F.col(USAGE_TYPE).contains("Bytes")
        & F.col(C.TYPE).isin(S.USAGE, S.DISCOUNTED_USAGE, S.SP_COVERED))
    if products is not None:
        rows = rows.where(F.col(PRODUCT).isin(*products))
    ends = ["from_location", "to_location", "from_location_type", "to_location_type"]
    return (rows.groupBy(F.col(PRODUCT).alias("service"), F.col(USAGE_TYPE).alias("usage_type"),
                         *[C.label_blank(f"product_{e}", "(none)").alias(e) for e in ends])
            .agg(C.money(F.sum(C.cash())).alias("unblended_cost"),
                 F.round(F.sum(AMOUNT), 2).alias("usage_amount"),
                 C.money(F.sum(C.list_cost())).alias("public_on_demand_cost"),
                 F.count("*").alias("line_items"))
            .orderBy(F.desc_nulls_last("unblended_cost")))


def storage_category(usage_type: Column) -> Column:
    """Storage, Requests, Transfer or Other, by the first word found."""
    def any_of(words: Sequence[str]) -> Column:
        hit = usage_type.contains(words[0])
        for word in words[1:]:
            hit = hit | usage_type.contains(word)
        return hit

    return (F.when(any_of(STORAGE_WORDS), "Storage").when(any_of(REQUEST_WORDS), "Requests")
            .when(any_of(TRANSFER_WORDS), "Transfer").otherwise("Other"))


def s3_categories(df: DataFrame, period: Period, product: str = "AmazonS3") -> DataFrame:
    """Object storage cost per category, usage type, storage class and account.

    The category follows from the usage type, so it is worked out after grouping.
    """
    groups = (period.scope(df).where(F.col(PRODUCT) == product)
              .groupBy(F.col(USAGE_TYPE).alias("usage_type"),
                       C.label_blank("product_storage_class", "(none)").alias("storage_class"),
                       F.col(ACCOUNT).alias("usage_account_id"))
              .agg(C.money(F.sum(C.cash())).alias("unblended_cost"),
                   F.round(F.sum(AMOUNT), 2).alias("usage_amount"),
                   F.count("*").alias("line_items")))
    return (groups.select(storage_category(F.col("usage_type")).alias("cost_category"),
                          *groups.columns)
            .orderBy(F.desc_nulls_last("unblended_cost")))
