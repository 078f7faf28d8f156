"""Reports to retained events: allow-lists, clamps, validity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnwise.functions import buckets as B
from turnwise.registry import signatures as S
from turnwise.registry import tools as R

# Closed lists of a retained event.
PARSER_TYPES = ("jsonl", "text", "multi_source", "paid_bundle")
FINDING_IDS = (
    "repeated_file_reads", "tool_output_bloat", "retry_loop", "context_growth_spikes",
    "mcp_bloat", "skill_bloat",
)
REDACTION_FAMILIES = (
    "anthropic_key", "openai_key", "github_token", "npm_token", "aws_access_key",
    "google_api_key", "database_url", "cookie", "jwt", "ssh_private_key", "email",
    "generic_secret",
)
OPERATING_SYSTEMS = ("macos", "linux", "windows", "wsl")
SHELLS = ("zsh", "bash", "fish", "powershell")
VERSION_CONTROLS = ("git", "jj")
SEVERITIES = ("low", "medium", "high")
REASONS = (
    "absent", "installed_inactive", "configured_inactive", "active_persistent",
    "rejected_alternative", "prune_first", "audit_config", "no_op", "server_quota_check",
)
POLICIES = (
    "bundle", "recommend", "recommend_with_waiver", "research_only", "reference_only",
)


def _labels(thresholds) -> tuple[str, ...]:
    lows = (0, *thresholds)
    return tuple(f"{a}_{b}" for a, b in zip(lows, thresholds)) + (f"{thresholds[-1]}_plus",)


def scan_type(value: Column) -> Column:
    return (
        F.when(F.coalesce(value, F.lit("")).isin("single", "free", ""), "free")
        .when(value.isin("paid_bundle", "paid"), "paid")
        .otherwise("legacy_internal")
    )


def allowed_ids(ids: Column, category: str, categories=S.CATEGORIES) -> Column:
    allowed = F.array(*[F.lit(i) for i in S.ids(category, categories)])
    return F.array_sort(F.array_intersect(ids, allowed))


def clamp_count(value: Column, most: int | None = None) -> Column:
    """Not below zero; not above `most` if given."""
    return (F.greatest(value, F.lit(0)) if most is None else B.clamp(value, 0, most)).cast("long")


def keep_findings(findings: DataFrame, allowed=FINDING_IDS) -> DataFrame:
    """Rows of allowed findings, severities bounded (P20)."""
    return findings.filter(F.col("finding_id").isin(*allowed)).withColumn(
        "severity", B.enum_or_unknown(F.col("severity"), SEVERITIES)
    )


def keep_redactions(counts: DataFrame, allowed=REDACTION_FAMILIES, most: int | None = None) -> DataFrame:
    return counts.filter(F.col("family").isin(*allowed)).withColumn(
        "count", clamp_count(F.col("count"), most)
    )


def keep_fingerprints(prints: DataFrame, known: DataFrame, most: int | None = None) -> DataFrame:
    """Registered fingerprints with bounded labels."""
    kept = prints.join(known.select("fingerprint_id"), "fingerprint_id", "left_semi")
    return kept.withColumns(
        {
            "confidence": B.enum_or_unknown(F.col("confidence"), B.CONFIDENCE_LABELS),
            "evidence_count": clamp_count(F.col("evidence_count"), most),
            "version_bucket": B.coarse_version(F.col("version_bucket")),
        }
    )


def recommendation_slots(slots: DataFrame) -> DataFrame:
    """Recommendation slots with every field bounded; unregistered tools drop the slot."""
    tools = tuple(t[0] for t in R.TOOLS)
    known = slots.filter((F.col("tool_id") == "") | F.col("tool_id").isin(*tools))
    classes = tuple(r[1] for r in R.RULES)
    return known.withColumns(
        {
            "class": B.enum_or_unknown(F.col("class"), classes),
            "reason": B.enum_or_unknown(F.col("reason"), REASONS),
            "risk_level": B.enum_or_unknown(F.col("risk_level"), SEVERITIES),
            "install_policy": B.enum_or_unknown(F.col("install_policy"), POLICIES),
            "signals": F.array_sort(
                F.array_distinct(F.filter("signals", lambda s: s.isin(*R.SIGNALS)))
            ),
        }
    )


def safe_events(reports: DataFrame) -> DataFrame:
    """The bounded columns of a report that may be kept.

    `reports` has turns, score, waste_high, size_bytes, parser_type, scan_type,
    session_count and the environment labels.
    """
    clients = S.ids("coding_agent")
    return reports.withColumns(
        {
            "scan_type": scan_type(F.col("scan_type")),
            "parser_type": B.enum_or_unknown(F.col("parser_type"), PARSER_TYPES),
            "input_size_bucket": B.range_bucket(F.col("size_bytes"), B.INPUT_SIZE),
            "turn_bucket": B.range_bucket(F.col("turns"), B.TURNS),
            "score_bucket": B.range_bucket(F.col("score"), B.SCORE),
            "waste_bucket": B.range_bucket(F.col("waste_high"), B.WASTE),
            "session_count_bucket": B.int_bucket(F.col("session_count"), B.SESSIONS),
            "client": B.enum_or_unknown(F.col("client"), clients),
            "operating_system": B.enum_or_unknown(F.col("operating_system"), OPERATING_SYSTEMS),
            "shell": B.enum_or_unknown(F.col("shell"), SHELLS),
            "version_control": B.enum_or_unknown(F.col("version_control"), VERSION_CONTROLS),
        }
    ).drop("turns", "score", "waste_high", "size_bytes", "session_count")


def invalid_reports(reports: DataFrame, paid: bool = False) -> DataFrame:
    """Reports that may not be stored, with the first reason."""
    why = (
        F.when(F.coalesce("version", F.lit("")) == "", "missing analyzer version")
        .when(F.coalesce("turns", F.lit(0)) <= 0, "missing parsed turns")
        .when(F.col("raw_transcript_sent"), "claims raw transcript was sent")
        .when(F.col("outbound_during_analysis"), "claims outbound network")
    )
    if paid:
        why = (
            why.when(F.col("parser_type") != "paid_bundle", "not a bundle report")
            .when(F.coalesce("session_count", F.lit(0)) <= 0, "no analyzed session")
            .when(F.col("raw_log_ttl") != "not uploaded", "raw logs not marked as not uploaded")
        )
    return reports.withColumn("reason", why).filter(F.col("reason").isNotNull())


def filled_collections(rows: DataFrame) -> DataFrame:
    """NULL arrays and maps become empty."""
    fixes = {}
    for field in rows.schema.fields:
        kind = field.dataType.simpleString()
        if kind.startswith("array"):
            fixes[field.name] = F.coalesce(field.name, F.array().cast(kind))
        elif kind.startswith("map"):
            fixes[field.name] = F.coalesce(field.name, F.create_map().cast(kind))
    return rows.withColumns(fixes) if fixes else rows
