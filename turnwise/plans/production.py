"""Production report: usage, product, e-mail and the daily spine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnwise.functions import web as Wb
from turnwise.operators import funnel as Fu
from turnwise.operators import usage as U


def production_report(
    usage: DataFrame,
    product: DataFrame,
    unlocks: DataFrame,
    deliveries: DataFrame,
    suppressions: DataFrame,
    own_emails=(),
    own_domains=(),
    previous: DataFrame | None = None,
    new_since=None,
) -> dict[str, DataFrame]:
    """Frames of the report.

    usage: request columns with `timestamp`; product: event_key, object_date, hashes;
    unlocks: email, status, marketing_opt_in, created_at, pos; deliveries: email_hash, type,
    detail, created_at, pos; suppressions: email_hash, reason.
    """
    day = lambda c: F.coalesce(F.date_format(c, "yyyy-MM-dd"), F.lit("unknown"))
    weighted = Fu.event_weights(product, "hashes", "event_key", "object_date", "event_key")
    others = unlocks.filter(~Wb.is_owner_email(F.col("email"), list(own_emails), list(own_domains)))
    profiles = Fu.unlock_profiles(others).withColumn("email_hash", Wb.hash_email(F.col("email")))
    status = Fu.delivery_status(
        Fu.split_new(profiles, previous, new_since),
        Fu.delivery_counts(deliveries, "email_hash", "created_at", "pos"),
        suppressions,
        "email_hash",
    )

    def daily(df, date, weight=None):
        total = F.count(F.lit(1)) if weight is None else F.sum(weight)
        return df.groupBy(date.alias("day")).agg(total.cast("long").alias("count"))

    fresh = status.filter("is_new")
    seen = day(F.col("first_seen_at"))
    feeds = {
        "new_emails": daily(fresh, seen),
        "new_usable_emails": daily(fresh.filter("delivery_usable"), seen),
        "new_rejected_emails": daily(fresh.filter("NOT delivery_usable"), seen),
        "website_requests": daily(usage, day(F.col("timestamp"))),
        "product_events": daily(
            weighted.filter("weight > 0"), F.coalesce("object_date", F.lit("unknown")), F.col("weight")
        ),
        "email_unlocks": daily(others, day(F.col("created_at"))),
        "delivery_events": daily(deliveries, day(F.col("created_at"))),
    }
    return {
        "daily": Fu.daily_spine(feeds),
        "coverage": Fu.coverage(feeds),
        "usage": U.count_entries(usage, U.funnel_entries(usage.columns)),
        "product": Fu.product_totals(weighted),
        "emails": status.select(
            Wb.mask_email(F.col("email")).alias("email"),
            "marketing_opt_in",
            "status",
            "first_seen_at",
            "delivery_status",
            "delivery_usable",
            "is_new",
        ),
        "domains": others.filter(F.col("email").contains("@"))
        .groupBy(Wb.email_domain(F.col("email")).alias("domain"))
        .agg(F.count(F.lit(1)).alias("count")),
    }
