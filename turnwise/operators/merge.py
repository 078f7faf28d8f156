"""Merging reports: sums, unions, ranked labels, fingerprints."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnwise.functions import buckets as B

SUMMED = (
    "turns", "estimated_tokens", "tool_output_tokens", "rereads", "failed_commands",
    "context_growth_events",
)
SIGNAL_SUMMED = (
    "normalized_event_count", "tool_call_count", "tool_result_count", "cache_read_tokens",
    "cache_creation_tokens", "input_tokens", "output_tokens", "cache_invalidation_events",
    "tool_output_bytes", "patch_lines_added", "patch_lines_removed",
)


def merge_metrics(reports: DataFrame, *by: str) -> DataFrame:
    """Sums, deepest retry, session count (A07). Partial sums combine before the shuffle."""
    return reports.groupBy(*by).agg(
        F.count(F.lit(1)).alias("session_count"),
        *[F.sum(c).cast("long").alias(c) for c in SUMMED],
        F.max("retry_depth_max").alias("retry_depth_max"),
    )


def merge_signals(reports: DataFrame, *by: str) -> DataFrame:
    """Signal sums, longest retry loop, ratio and confidence from the merged counts."""
    sums = reports.groupBy(*by).agg(
        F.count(F.lit(1)).alias("session_count"),
        *[F.sum(c).cast("long").alias(c) for c in SIGNAL_SUMMED],
        F.max("args_hashed_retry_loops").alias("args_hashed_retry_loops"),
        min_label("sample_confidence", B.CONFIDENCE_LABELS).alias("weakest_confidence"),
    )
    sessions, events = F.col("session_count"), F.col("normalized_event_count")
    return sums.withColumns(
        {
            "cache_miss_ratio_pct": B.cache_miss_pct(
                F.col("input_tokens"), F.col("cache_read_tokens")
            ),
            "sample_confidence": B.sample_confidence(sessions, events),
            "sample_warnings": B.sample_warnings(sessions, events),
        }
    )


def max_label(label: str, labels: Sequence[str], first: int = 0) -> Column:
    """The label of the highest rank in a group."""
    return F.max_by(F.col(label), B.rank(F.col(label), labels, first))


def min_label(label: str, labels: Sequence[str]) -> Column:
    """The label of the lowest rank; empty labels lose, unknown ones count lowest."""
    value = F.nullif(F.col(label), F.lit(""))
    return F.min_by(F.when(value.isNotNull(), value), F.when(value.isNotNull(), B.rank(value, labels, 1, 0)))


def max_bucket(label: str) -> Column:
    value = F.nullif(F.col(label), F.lit(""))
    return F.max_by(value, F.when(value.isNotNull(), B.bucket_rank(value)))


def first_label(label: str, ordinal: str) -> Column:
    """The first non-empty label in the order of `ordinal`."""
    value = F.nullif(F.col(label), F.lit(""))
    return F.coalesce(F.min_by(value, F.when(value.isNotNull(), F.col(ordinal))), F.lit(""))


def union_ids(long_ids: DataFrame, *by: str) -> DataFrame:
    """Distinct (group, category, id) rows (A09, U01): a union of sets without collecting."""
    return long_ids.filter(F.col("id") != "").select(*by, "category", "id").distinct()


def sum_families(long_counts: DataFrame, *by: str) -> DataFrame:
    """Map sums over long (group, family, count) rows."""
    return long_counts.groupBy(*by, "family").agg(F.sum("count").cast("long").alias("count"))


def merge_utilization(
    reports: DataFrame,
    ids: DataFrame,
    surface: str,
    *by: str,
) -> DataFrame:
    """Merge one tooling surface ("mcp" or "skill") over groups (A10).

    `reports` has the unknown counts, bucket labels, band and source columns; `ids` has
    long (group, role, id) rows with role `exposed` or `used`. Known ids are united,
    unknown counts summed, labels kept at their highest rank, the ratio computed anew.
    """
    sets = (
        ids.select(*by, "role", "id").distinct()
        .groupBy(*by)
        .agg(
            F.sum((F.col("role") == "exposed").cast("long")).alias("known_exposed"),
            F.sum((F.col("role") == "used").cast("long")).alias("known_used"),
        )
    )
    buckets = [c for c in reports.columns if c.endswith("_bucket")]
    merged = reports.groupBy(*by).agg(
        *[F.sum(c).cast("long").alias(c) for c in ("unknown_exposed", "unknown_used", "uses")],
        F.max("exposure_known").alias("exposure_known"),
        max_label("inference_source", B.INFERENCE_LABELS).alias("inference_source"),
        max_label("band", B.BAND_LABELS).alias("band"),
        *[max_bucket(c).alias(c) for c in buckets],
    )
    merged = merged.join(sets, list(by), "left").na.fill(0, ["known_exposed", "known_used"])
    exposed = F.col("known_exposed") + F.col("unknown_exposed")
    used = F.col("known_used") + F.col("unknown_used")
    denom = F.when(exposed > 0, exposed).otherwise(used)
    ratio = F.floor(F.least(used, denom) * 100 / F.nullif(denom, F.lit(0).cast("long")))
    return merged.withColumn("surface", F.lit(surface)).withColumn(
        "utilization_ratio_pct", F.coalesce(ratio, F.lit(0)).cast("long")
    )


def merge_fingerprints(fingerprints: DataFrame, *by: str) -> DataFrame:
    """Merge fingerprints by id (A12). A version stays only if all agree and none is empty."""
    rows = fingerprints.filter(F.col("fingerprint_id") != "")
    agree = (F.min("version_bucket") == F.max("version_bucket")) & (F.min("version_bucket") != "")
    return rows.groupBy(*by, "fingerprint_id").agg(
        F.sum("evidence_count").cast("long").alias("evidence_count"),
        max_label("confidence", B.CONFIDENCE_LABELS, 1).alias("confidence"),
        F.max("active").alias("active"),
        F.max("installed").alias("installed"),
        F.when(agree, F.max("version_bucket")).otherwise("").alias("version_bucket"),
    )


def baseline_window(logs: DataFrame, *by: str) -> DataFrame:
    """First and last modification, log, source and size-bucket counts."""
    sized = logs.withColumn("_size", B.byte_size_bucket(F.col("size_bytes")))
    out = sized.groupBy(*by).agg(
        F.min("mod_time").alias("window_start"),
        F.max("mod_time").alias("window_end"),
        F.count(F.lit(1)).alias("log_count"),
        F.count_distinct("source_id").alias("source_count"),
        F.concat_ws(",", F.sort_array(F.collect_set("_size"))).alias("size_buckets"),
    )
    seconds = F.floor(
        (
            F.unix_micros(F.col("window_end").cast("timestamp"))
            - F.unix_micros(F.col("window_start").cast("timestamp"))
        )
        / F.lit(1_000_000)
    )
    return out.withColumn("duration_bucket", B.duration_bucket(seconds))


def source_mix(logs: DataFrame) -> DataFrame:
    """Log count per source."""
    return logs.groupBy("source_id").agg(F.count(F.lit(1)).alias("log_count"))


def mix_signature(mix: DataFrame, *by: str) -> DataFrame:
    """Sorted source ids in one string; the ids come from the closed source catalogue."""
    return mix.groupBy(*by).agg(
        F.concat_ws(",", F.sort_array(F.collect_set("source_id"))).alias("source_mix")
    )
