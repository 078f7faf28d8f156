"""Workflow fingerprints: markers, veto, confidence rules."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnwise.functions import buckets as B
from turnwise.functions import text as X
from turnwise.registry import detectors as D


def marker_hits(
    logs: DataFrame,
    markers: list[tuple],
    inventory: DataFrame | None,
    log: str = "log_id",
    content: str = "content",
    slash: str | None = None,
) -> DataFrame:
    """(log, detector, marker, source_class, negative, version_bucket) of every hit.

    Text markers are literal patterns, one boolean each, so the text is scanned where it
    lies. `inventory` has (log, binary, version_text): a version marker counts only where
    the same binary is present and its banner holds a version.
    """
    text = F.col(content)
    entries = []
    for detector, marker, cls, pattern, _, _, negative in markers:
        if cls in ("cli_binary", "cli_version_probe"):
            continue
        hit = text.rlike(X.ascii_edges(pattern))
        literal = X.required_literal(pattern)
        if literal and literal in pattern.replace("\\", "") and not re.match(r"\(\?[a-z]*i", pattern):
            hit = text.contains(literal) & hit
        if cls == "slash_command" and slash is not None:
            hit = hit | F.col(slash).rlike(X.ascii_edges(pattern))
        entries.append(
            F.when(
                hit,
                F.struct(
                    F.lit(detector).alias("detector_id"),
                    F.lit(marker).alias("marker_id"),
                    F.lit(cls).alias("source_class"),
                    F.lit(negative).alias("negative"),
                    F.lit("").alias("version_bucket"),
                ),
            )
        )
    found = logs.select(log, F.inline(F.array_compact(F.array(*entries))))
    if inventory is None:
        return found
    spark = logs.sparkSession
    probes = spark.createDataFrame(
        [m for m in markers if m[2] in ("cli_binary", "cli_version_probe")], D.MARKER_SCHEMA
    )
    present = inventory.join(probes, "binary").withColumn(
        "version_bucket",
        F.when(F.col("source_class") == "cli_version_probe", B.version_bucket(F.col("version_text"))).otherwise(""),
    )
    paired = present.filter(
        (F.col("source_class") == "cli_binary") | (F.col("version_bucket") != "")
    )
    # A version marker needs the detector's own binary marker for that binary.
    own = probes.filter(F.col("source_class") == "cli_binary").select("detector_id", "binary")
    paired = paired.join(own, ["detector_id", "binary"], "left_semi")
    return found.unionByName(
        paired.select(
            log, "detector_id", F.col("marker_id").cast("int").alias("marker_id"), "source_class",
            "negative", "version_bucket",
        )
    )


def evaluate(hits: DataFrame, detectors: DataFrame, rules: DataFrame, log: str = "log_id") -> DataFrame:
    """One fingerprint per (log, verified detector) with evidence and no negative hit."""
    per = hits.groupBy(log, "detector_id").agg(
        F.max("negative").alias("_veto"),
        F.collect_set(F.when(~F.col("negative"), F.col("source_class"))).alias("classes"),
        F.sum((~F.col("negative")).cast("long")).alias("evidence_count"),
        F.max_by("version_bucket", F.when(F.col("version_bucket") != "", F.col("marker_id"))).alias("_v"),
        F.max(F.col("source_class") == "cli_binary").alias("installed"),
    )
    per = per.filter(~F.col("_veto") & (F.size("classes") > 0))
    verified = detectors.filter(F.col("status") == "verified").select("detector_id", "priority")
    per = per.join(verified, "detector_id")
    table = rules.groupBy("detector_id").agg(
        F.collect_list(F.struct("confidence", "any_of", "all_of", "distinct_classes")).alias("_rules")
    )
    per = per.join(table, "detector_id", "left")

    def holds(r):
        every = F.coalesce(r["all_of"], F.array().cast("array<string>"))
        some = F.coalesce(r["any_of"], F.array().cast("array<string>"))
        return (
            (F.size("classes") >= r["distinct_classes"])
            & F.forall(every, lambda c: F.array_contains("classes", c))
            & ((F.size(some) == 0) | F.arrays_overlap("classes", some))
        )

    ranks = F.transform(
        F.filter(F.coalesce("_rules", F.array().cast("array<struct<confidence:string,any_of:array<string>,all_of:array<string>,distinct_classes:int>>")), holds),
        lambda r: B.rank(r["confidence"], B.CONFIDENCE_LABELS, 1),
    )
    best = F.coalesce(F.array_max(ranks), F.lit(1))
    per = per.withColumn("_rank", best)
    runtime = F.arrays_overlap("classes", F.array(*[F.lit(c) for c in D.RUNTIME_CLASSES]))
    return per.select(
        log,
        F.col("detector_id").alias("fingerprint_id"),
        "priority",
        F.element_at(F.array(*[F.lit(c) for c in B.CONFIDENCE_LABELS]), F.col("_rank")).alias("confidence"),
        F.sort_array("classes").alias("sources"),
        "evidence_count",
        ((F.col("_rank") == 3) & runtime).alias("active"),
        "installed",
        F.coalesce("_v", F.lit("")).alias("version_bucket"),
    )


def slash_corpus(turns: DataFrame, log: str = "log_id") -> DataFrame:
    """Distinct slash tokens of a log's own lines, one per line, for slash markers.

    The token set of a log is bounded by the log's own text, which is one row.
    """
    names = turns.filter(~F.col("is_tool")).select(
        log, F.explode(X.all_slash_tokens(F.col("text"))).alias("_n")
    )
    return names.groupBy(log).agg(
        F.array_join(F.sort_array(F.collect_set("_n")), "\n").alias("slash_tokens")
    )
