"""Batches of payment and reminder requests against a schedule."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def decide_requests(schedule: DataFrame, requests: DataFrame, clients: DataFrame) -> DataFrame:
    """Each request with the reason it is refused, or NULL when it goes through.

    ``requests`` has engagement_id, seq and request (``pay`` or ``remind``); ``clients`` lists the
    engagements that have a client to write to.
    """
    reachable = clients.select("engagement_id").distinct().withColumn("has_client", F.lit(True))
    pay = (F.when(F.col("paid"), "this payment is already paid")
           .when(~F.col("payable"), "this payment is not payable yet"))
    remind = (F.when(F.col("paid"), "this payment is already paid")
              .when(~F.col("status").isin("due", "overdue"), "this payment is not due yet")
              .when(F.col("has_client").isNull(), "no client on this engagement to remind"))
    return (requests.join(schedule, ["engagement_id", "seq"])
            .join(reachable, "engagement_id", "left")
            .select("engagement_id", "seq", "request",
                    F.when(F.col("request") == "pay", pay).otherwise(remind).alias("refused"),
                    "amount"))


def post_payments(payments: DataFrame, accepted: DataFrame) -> DataFrame:
    """Payments after the accepted requests; the amount paid is frozen."""
    made = accepted.filter("request = 'pay' and refused is null").select(
        "engagement_id", "seq", F.col("amount").alias("posted"))
    return (payments.join(made, ["engagement_id", "seq"], "left")
            .withColumn("amount_paid", F.coalesce("amount_paid", "posted"))
            .withColumn("paid", F.col("paid") | F.col("posted").isNotNull()).drop("posted"))
