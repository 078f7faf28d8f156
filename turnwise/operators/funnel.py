"""E-mail funnel, product counters weighted by new content, daily spine."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnwise.functions import web as Wb
from turnwise.operators import usage as U

SHA256 = "^[a-f0-9]{64}$"
SUPPRESSING = ("bounce", "complaint", "reject")
REJECTED_DETAILS = ("suppressed_recipient", "recipient_rejected", "message_rejected")


def _long(test: Column) -> Column:
    return test.cast("long")


def event_hashes(events: DataFrame, hashes: str, *keep: str) -> DataFrame:
    """Distinct valid hashes of each event."""
    clean = F.array_distinct(
        F.filter(
            F.transform(hashes, lambda h: F.lower(F.trim(h))), lambda h: h.rlike(SHA256)
        )
    )
    return events.select(*keep, F.explode(clean).alias("hash"))


def first_seen(refs: DataFrame, key: str, *order: str) -> DataFrame:
    """The first row of each key in the given order.

    A minimum instead of a window: copies that make up a large share of the rows are
    folded before the shuffle.
    """
    rest = [c for c in refs.columns if c != key and c not in order]
    packed = F.struct(*order, *rest)
    firsts = refs.groupBy(key).agg(F.min(packed).alias("_f"))
    return firsts.select(key, "_f.*")


def event_weights(events: DataFrame, hashes: str, event: str, *order: str) -> DataFrame:
    """Hashes first seen in each event; an event without hashes weighs 1, one without new
    hashes 0 (A23)."""
    refs = event_hashes(events, hashes, event, *[o for o in order if o != event])
    return weighed(events, refs, first_seen(refs, "hash", *order), event)


def weighed(events: DataFrame, refs: DataFrame, firsts: DataFrame, event: str) -> DataFrame:
    """Events with `hash_refs`, the number of their rows in `refs`, and `weight`, that of their rows in `firsts`."""
    fresh = firsts.groupBy(event).agg(F.count(F.lit(1)).alias("_new"))
    counts = refs.groupBy(event).agg(F.count(F.lit(1)).alias("_refs"))
    return (
        events.join(fresh, event, "left")
        .join(counts, event, "left")
        .withColumns(
            {
                "hash_refs": F.coalesce("_refs", F.lit(0)).cast("long"),
                "weight": F.when(F.col("_refs").isNull(), F.lit(1))
                .otherwise(F.coalesce("_new", F.lit(0)))
                .cast("long"),
            }
        )
        .drop("_new", "_refs")
    )


def product_totals(weighted: DataFrame) -> DataFrame:
    with_hashes = F.col("hash_refs") > 0
    unique = F.sum(F.when(with_hashes, F.col("weight")).otherwise(0))
    return weighted.agg(
        F.sum("weight").cast("long").alias("total_report_events"),
        F.count(F.lit(1)).alias("raw_report_events"),
        F.sum(_long(with_hashes)).alias("events_with_hashes"),
        F.sum(_long(~with_hashes)).alias("events_without_hashes"),
        F.sum("hash_refs").cast("long").alias("hash_refs"),
        unique.cast("long").alias("unique_hashes"),
        (F.sum("hash_refs") - unique).cast("long").alias("duplicate_refs"),
    )


def product_counters(weighted: DataFrame, entries: Column) -> DataFrame:
    """Counters in which each event counts by its weight."""
    fresh = weighted.filter(F.col("weight") > 0)
    return U.count_entries(fresh, entries, weight=F.col("weight"))


def latest_per_key(rows: DataFrame, key: str, ts: str, pos: str, *values: str) -> DataFrame:
    """Values of the newest row per key; of equal times the later row."""
    latest = F.max_by(F.struct(*values), F.struct(ts, pos))
    return (
        rows.filter(F.col(ts).isNotNull())
        .groupBy(key)
        .agg(latest.alias("_l"), F.max(ts).alias(f"latest_{ts}"))
        .select(key, f"latest_{ts}", *[F.col(f"_l.{v}").alias(f"latest_{v}") for v in values])
    )


def unlock_profiles(unlocks: DataFrame, ts: str = "created_at", pos: str = "pos") -> DataFrame:
    """One row per address: first and last time, last status, any opt-in."""
    email = Wb.normalize_email(F.col("email"))
    rows = unlocks.withColumn("email", email).filter(F.col("email") != "")
    status = F.coalesce(F.nullif(F.col("status"), F.lit("")), F.lit("unknown"))
    return rows.groupBy("email").agg(
        F.min(ts).alias("first_seen_at"),
        F.max(ts).alias("latest_seen_at"),
        F.max_by(status, F.struct(ts, pos)).alias("status"),
        F.max(F.coalesce("marketing_opt_in", F.lit(False))).alias("marketing_opt_in"),
        F.count(F.lit(1)).alias("records"),
    )


DELIVERY_TYPES = (
    "bounce", "complaint", "reject", "send_failure", "rendering_failure", "delivery", "send",
)


def delivery_counts(events: DataFrame, key: str, ts: str, pos: str) -> DataFrame:
    """Counts per delivery type and the latest type and detail of each address."""
    kind = F.coalesce(F.nullif(F.col("type"), F.lit("")), F.lit("unknown"))
    detail = F.coalesce("detail", F.lit(""))
    at = F.struct(F.col(ts).isNotNull(), ts, pos)
    return events.groupBy(key).agg(
        *[F.sum(_long(kind == t)).alias(f"n_{t}") for t in DELIVERY_TYPES],
        F.max_by(F.when(F.col(ts).isNotNull(), kind), at).alias("latest_type"),
        F.coalesce(F.max_by(F.when(F.col(ts).isNotNull(), detail), at), F.lit("")).alias(
            "latest_detail"
        ),
        F.coalesce(
            F.min_by(F.nullif(detail, F.lit("")), F.when(detail != "", F.col(pos))), F.lit("")
        ).alias("first_detail"),
    )


def delivery_status(addresses: DataFrame, counts: DataFrame, suppressions: DataFrame, key: str) -> DataFrame:
    """Resolve the status of each address by precedence."""
    reasons = suppressions.select(key, F.col("reason").alias("_reason"))
    rows = addresses.join(counts, key, "left").join(reasons, key, "left")
    rows = rows.na.fill(0, [f"n_{t}" for t in DELIVERY_TYPES]).na.fill(
        "", ["latest_detail", "first_detail"]
    )
    seen = F.coalesce(F.nullif(F.col("latest_detail"), F.lit("")), F.col("first_detail"))
    suppressed = F.col("_reason").isNotNull()
    bounced = (F.col("n_bounce") + F.col("n_complaint") + F.col("n_reject")) > 0
    failed = F.col("n_send_failure") > 0
    rendering = F.col("n_rendering_failure") > 0
    refused = seen.rlike("|".join(REJECTED_DETAILS))
    status = (
        F.when(suppressed & (F.col("_reason") == "reject"), "provider_rejected")
        .when(suppressed, "suppressed")
        .when(bounced, "provider_rejected")
        .when(failed & refused, "provider_rejected")
        .when(failed | rendering, "delivery_failed")
        .when(F.col("n_delivery") > 0, "delivered")
        .when(F.col("n_send") > 0, "sent")
        .otherwise("no_delivery_signal")
    )
    detail = (
        F.when(
            suppressed, F.coalesce(F.nullif(F.col("_reason"), F.lit("")), F.col("latest_detail"))
        )
        .when(bounced | failed, seen)
        .when(
            rendering,
            F.coalesce(F.nullif(F.col("latest_detail"), F.lit("")), F.lit("rendering_failure")),
        )
        .when((F.col("n_delivery") + F.col("n_send")) > 0, F.col("latest_detail"))
        .otherwise("")
    )
    return rows.withColumns(
        {
            "delivery_status": status,
            "delivery_usable": ~(suppressed | bounced | failed | rendering),
            "delivery_detail": detail,
        }
    ).drop("_reason", "first_detail")


def split_new(profiles: DataFrame, previous: DataFrame | None, since: Column | None = None) -> DataFrame:
    """Mark addresses that no previous report lists, plain or masked, or that are recent.

    `previous` has one column `label`; None means there was no earlier report.
    """
    fresh = F.lit(False)
    rows = profiles
    if previous is not None:
        labels = previous.select(F.col("label")).distinct()
        keyed = rows.select(
            "email", F.explode(F.array("email", Wb.mask_email(F.col("email")))).alias("label")
        )
        known = keyed.join(labels, "label", "left_semi").select("email").distinct()
        rows = rows.join(known.withColumn("was_known", F.lit(True)), "email", "left")
        rows = rows.withColumn("was_known", F.coalesce("was_known", F.lit(False)))
        fresh = ~F.col("was_known")
    else:
        rows = rows.withColumn("was_known", F.lit(False))
    if since is not None:
        fresh = fresh | F.coalesce(F.col("first_seen_at") >= since, F.lit(False))
    return rows.withColumn("is_new", fresh)


def suppressions(events: DataFrame, key: str, ts: str, pos: str) -> DataFrame:
    """State of each suppressed address in arrival order."""
    bad = events.filter(F.col("type").isin(*SUPPRESSING))
    return bad.groupBy(key).agg(
        F.max_by("type", pos).alias("reason"),
        *[F.sum(_long(F.col("type") == t)).alias(f"{t}_count") for t in SUPPRESSING],
        F.max_by("message_id", pos).alias("last_message_id"),
        F.min_by(ts, pos).alias("suppressed_at"),
        F.max_by(ts, pos).alias("updated_at"),
    )


def daily_spine(counters: dict[str, DataFrame], day: str = "day") -> DataFrame:
    """All days of all feeds, one 0-filled column per feed.

    Each counter frame has (day, count). Stacking and one grouping replaces a chain of
    joins on the day.
    """
    names = list(counters)
    tagged = [
        df.select(
            F.col(day).alias(day),
            *[
                (F.col("count") if n == name else F.lit(0)).cast("long").alias(n)
                for n in names
            ],
        )
        for name, df in counters.items()
    ]
    stacked = reduce(DataFrame.unionByName, tagged)
    return stacked.groupBy(day).agg(*[F.sum(n).cast("long").alias(n) for n in names])


def coverage(counters: dict[str, DataFrame], day: str = "day") -> DataFrame:
    """First day, last day and total of each feed."""
    tagged = [
        df.select(F.lit(name).alias("feed"), day, "count") for name, df in counters.items()
    ]
    return (
        reduce(DataFrame.unionByName, tagged)
        .groupBy("feed")
        .agg(
            F.min(day).alias("first_day"),
            F.max(day).alias("last_day"),
            F.sum("count").cast("long").alias("total"),
        )
    )


def unique_in_order(rows: DataFrame, key: str, pos: str) -> DataFrame:
    """Distinct keys with the position of their first row."""
    return rows.filter(F.col(key) != "").groupBy(key).agg(F.min(pos).alias("first_pos"))
