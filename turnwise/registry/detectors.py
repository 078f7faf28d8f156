"""Workflow detectors as data: markers, confidence rules, and their validation.

Fixed values: source classes, denied probe flags. The sample detectors follow the public
artifacts of each tool; a user replaces or extends them with frames of the same shape.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SOURCE_CLASSES = (
    "config_dir", "config_file", "package_manifest", "command_name", "slash_command",
    "mcp_server_name", "skill_name", "plugin_manifest", "cli_binary", "cli_version_probe",
)
STATUSES = ("verified", "research_needed", "blocked")
DENIED_FLAGS = ("--config", "--registry", "--token", "--server", "--login")
RUNTIME_CLASSES = ("slash_command", "mcp_server_name", "cli_binary")

DETECTOR_SCHEMA = "detector_id string, priority int, status string, references int"
MARKER_SCHEMA = (
    "detector_id string, marker_id int, source_class string, pattern string, binary string, "
    "version_args array<string>, negative boolean"
)
RULE_SCHEMA = (
    "detector_id string, confidence string, any_of array<string>, all_of array<string>, "
    "distinct_classes int"
)

DETECTORS = (
    ("bmad", 5, "verified", 1),
    ("openspec", 3, "verified", 1),
    ("github_spec_kit", 1, "verified", 1),
    ("kiro", 2, "verified", 1),
)
MARKERS = (
    ("bmad", 1, "config_dir", r"\.bmad-core/", "", None, False),
    ("bmad", 2, "config_file", r"\.bmad-core/(core-config\.yaml|agents/)", "", None, False),
    ("bmad", 3, "package_manifest", r"bmad-method", "", None, False),
    ("bmad", 4, "cli_binary", "", "bmad-method", None, False),
    ("bmad", 5, "cli_version_probe", "", "bmad-method", ["--version"], False),
    ("openspec", 1, "config_dir", r"openspec/(specs|changes)/", "", None, False),
    ("openspec", 2, "slash_command", r"(?m)(^|[\s/])openspec[-:](proposal|apply|archive)\b", "", None, False),
    ("openspec", 3, "cli_binary", "", "openspec", None, False),
    ("github_spec_kit", 1, "config_dir", r"\.specify/", "", None, False),
    ("github_spec_kit", 2, "slash_command", r"(?m)(^|[\s/])speckit[.-](specify|plan|tasks|implement)\b", "", None, False),
    ("github_spec_kit", 3, "cli_binary", "", "specify", None, False),
    ("kiro", 1, "config_dir", r"\.kiro/(specs|steering)/", "", None, False),
    ("kiro", 2, "config_file", r"\.kiro/specs/[^/\s]+/(requirements|design|tasks)\.md", "", None, False),
)
RULES = (
    ("bmad", "high", ["config_file", "package_manifest"], ["config_dir"], 0),
    ("bmad", "medium", ["package_manifest"], None, 0),
    ("openspec", "high", None, ["config_dir", "slash_command"], 0),
    ("openspec", "medium", ["config_dir", "slash_command"], None, 0),
    ("github_spec_kit", "high", None, ["config_dir", "slash_command"], 0),
    ("github_spec_kit", "medium", ["config_dir", "slash_command"], None, 0),
    ("kiro", "high", None, ["config_dir", "config_file"], 2),
    ("kiro", "medium", ["config_dir"], None, 0),
)


def frames(spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
    return (
        spark.createDataFrame(list(DETECTORS), DETECTOR_SCHEMA),
        spark.createDataFrame(list(MARKERS), MARKER_SCHEMA),
        spark.createDataFrame(list(RULES), RULE_SCHEMA),
    )


def violations(detectors: DataFrame, markers: DataFrame) -> DataFrame:
    """Registry rows that break a rule, with the reason."""

    def rows(df, subject, checks):
        found = F.array_compact(F.array(*[F.when(bad, F.lit(why)) for why, bad in checks]))
        return df.select(
            "detector_id", subject.alias("subject"), F.explode(found).alias("violation")
        )

    cls = F.col("source_class")
    probe = cls.isin("cli_binary", "cli_version_probe")
    args = F.coalesce("version_args", F.array().cast("array<string>"))
    return rows(
        detectors,
        F.lit("detector"),
        [
            ("invalid_id", ~F.col("detector_id").rlike("^[a-z][a-z0-9_]{2,}$")),
            ("invalid_status", ~F.col("status").isin(*STATUSES)),
            ("verified_without_reference", (F.col("status") == "verified") & (F.col("references") <= 0)),
        ],
    ).unionByName(
        rows(
            markers,
            F.concat(F.lit("marker:"), F.col("marker_id").cast("string")),
            [
                ("invalid_source_class", ~cls.isin(*SOURCE_CLASSES)),
                ("binary_required", probe & (F.col("binary") == "")),
                ("pattern_required", cls.isin(*SOURCE_CLASSES) & ~probe & (F.col("pattern") == "")),
                (
                    "denied_flag",
                    (cls == "cli_version_probe") & F.exists(args, lambda a: a.isin(*DENIED_FLAGS)),
                ),
                (
                    "path_in_flag",
                    (cls == "cli_version_probe")
                    & F.exists(args, lambda a: ~a.isin(*DENIED_FLAGS) & a.contains("/")),
                ),
            ],
        )
    )
