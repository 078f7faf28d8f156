"""Signals, tool states, recommendations, remediation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnwise.functions import buckets as B
from turnwise.registry import tools as R

SIGNAL_OF_FINDING = (
    "tool_output_bloat", "repeated_file_reads", "retry_loop", "context_growth_spikes",
)


def _lookup(key: Column, table: dict, default) -> Column:
    out = None
    for name, value in table.items():
        test = key == name
        out = F.when(test, value) if out is None else out.when(test, value)
    return out.otherwise(default)


def derive_signals(
    findings: DataFrame, bands: DataFrame, fingerprints: DataFrame, tools: DataFrame, log: str
) -> DataFrame:
    """Distinct (log, signal) rows.

    `findings` has (log, finding_id), `bands` one row per log with mcp_band and
    skill_band, `fingerprints` has (log, fingerprint_id, active).
    """
    from_findings = findings.filter(F.col("finding_id").isin(*SIGNAL_OF_FINDING)).select(
        log, F.col("finding_id").alias("signal")
    )
    bloated = F.col("mcp_band").isin("high", "severe") | F.col("skill_band").isin("high", "severe")
    from_bands = bands.filter(bloated).select(log, F.lit("mcp_skill_bloat").alias("signal"))
    trackers = tools.filter(F.col("class") == "usage_visibility").select(
        F.col("tool_id").alias("fingerprint_id")
    )
    tracked = fingerprints.filter("active").join(trackers, "fingerprint_id", "left_semi")
    untracked = bands.select(log).join(tracked.select(log), log, "left_anti").select(
        log, F.lit("no_usage_visibility").alias("signal")
    )
    return from_findings.unionByName(from_bands).unionByName(untracked).distinct()


def tool_evidence(
    frameworks: DataFrame,
    fingerprints: DataFrame,
    exposed: DataFrame,
    used: DataFrame,
    log: str,
) -> DataFrame:
    """(log, tool_id, state, source, count) rows of every rule.

    `exposed` and `used` have (log, surface, id) with surface `mcp` or `skill`.
    """

    def rows(df, tool, state, sources):
        listed = F.array_compact(
            F.array(*[F.when(test, F.lit(name)) for name, test in sources])
        )
        return df.select(
            log,
            F.col(tool).alias("tool_id"),
            state.alias("state"),
            F.explode(listed).alias("source"),
            F.lit(1).cast("long").alias("count"),
        )

    yes = F.lit(True)
    mentioned = rows(frameworks, "id", F.lit("mentioned_low"), [("report_mention", yes)])
    prints = rows(
        fingerprints,
        "fingerprint_id",
        F.when(F.col("active"), "active_high")
        .when(F.col("installed"), "installed_medium")
        .otherwise("mentioned_low"),
        [
            ("report_mention", yes),
            ("cli_presence", F.col("has_cli")),
            ("cli_version", F.col("version_bucket") != ""),
        ],
    )
    both = exposed.join(
        used.select(log, "surface", "id").distinct().withColumn("_used", yes),
        [log, "surface", "id"],
        "left",
    ).withColumn("_used", F.coalesce("_used", F.lit(False)))
    is_mcp, is_used = F.col("surface") == "mcp", F.col("_used")
    surfaces = rows(
        both,
        "id",
        F.when(is_used, "active_high").otherwise("configured_medium"),
        [
            ("mcp_active", is_mcp & is_used),
            ("mcp_configured", is_mcp & ~is_used),
            ("skill_configured", ~is_mcp),
            ("report_mention", ~is_mcp & is_used),
        ],
    )
    return mentioned.unionByName(prints).unionByName(surfaces)


def tool_states(
    evidence: DataFrame, tools: DataFrame, log: str, max_count: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """(state per log and tool, source counts up to `max_count`); unknown tools are left out."""
    known = evidence.join(tools.select("tool_id"), "tool_id", "left_semi")
    states = known.groupBy(log, "tool_id").agg(
        F.max_by("state", B.rank(F.col("state"), R.TOOL_STATES)).alias("state")
    )
    sources = known.groupBy(log, "tool_id", "source").agg(
        (F.sum("count") if max_count is None else F.least(F.sum("count"), F.lit(max_count))).cast("long").alias("count")
    )
    return states, sources


def fired_rules(signals: DataFrame, rules: DataFrame, log: str) -> DataFrame:
    """(log, rule) with the fired signals sorted and the representative one."""
    hit = signals.join(rules, "signal")
    return hit.groupBy(log, "precedence", "class", "primary_reason").agg(
        F.sort_array(F.collect_set("signal")).alias("signals"),
        F.min_by("signal", "signal_rank").alias("for_signal"),
    )


def candidates(
    fired: DataFrame,
    states: DataFrame,
    sources: DataFrame,
    tools: DataFrame,
    log: str,
) -> DataFrame:
    """Eligible tools of each fired rule with the outcome of their state; rules without any
    get one advisory row."""
    eligible = tools.filter(~F.col("install_policy").isin(*R.NEVER_DEFAULT))
    quota = (
        sources.filter((F.col("source") == "failure_or_rejection") & (F.col("count") > 0))
        .select(log, "tool_id")
        .withColumn("_failed", F.lit(True))
    )
    rows = (
        fired.join(eligible, "class", "left")
        .join(states, [log, "tool_id"], "left")
        .join(quota, [log, "tool_id"], "left")
    )
    state = F.coalesce("state", F.lit("unknown"))
    advisory = F.col("tool_id").isNull()
    quota_check = (
        (F.col("class") == "usage_visibility")
        & (F.col("tool_id") == "ccusage")
        & (state == "active_high")
        & F.coalesce("_failed", F.lit(False))
    )
    reason = (
        F.when(advisory, F.col("primary_reason"))
        .when(quota_check, "server_quota_check")
        .when(state == "active_high", "active_persistent")
        .when(state == "rejected_medium", "rejected_alternative")
        .when(state == "configured_medium", "configured_inactive")
        .when(state == "installed_medium", "installed_inactive")
        .otherwise(F.col("primary_reason"))
    )
    rows = rows.withColumns(
        {
            "reason": reason,
            "skipped": F.coalesce(
                ~advisory & ~quota_check & state.isin("active_high", "rejected_medium"),
                F.lit(False),
            ),
            "confidence": F.when(quota_check, "high")
            .when(advisory | state.isin("configured_medium", "installed_medium"), "medium")
            .otherwise("low"),
            "class_rank": F.coalesce("class_rank", F.lit(0)),
        }
    )
    return rows.drop("_failed", "state")


def recommend(
    signals: DataFrame,
    states: DataFrame,
    sources: DataFrame,
    rules: DataFrame,
    tools: DataFrame,
    log: str,
) -> tuple[DataFrame, DataFrame]:
    """(recommendations with slot primary or secondary, skip notes) per log.

    The first fired rule gives the primary; if all its tools are skipped there is no
    recommendation. The next rule of another class that gives one is the secondary.
    """
    valid = signals.filter(F.col("signal").isin(*R.SIGNALS))
    fired = fired_rules(valid, rules, log)
    cands = candidates(fired, states, sources, tools, log)
    usable = cands.filter(~F.col("skipped"))
    fields = [
        "tool_id", "reason", "confidence", "signals", "install_risk", "data_movement_risk",
        "install_policy", "category",
    ]
    picks = usable.groupBy(log, "precedence", "class").agg(
        F.min_by(F.struct("class_rank", *fields), "class_rank").alias("_p")
    )
    picks = fired.select(log, "precedence", "class").join(
        picks, [log, "precedence", "class"], "left"
    )
    # At most eight rules per log, so the window groups are small.
    by_rule = Window.partitionBy(log).orderBy("precedence")
    ranked = picks.withColumns(
        {
            "_first": F.row_number().over(by_rule) == 1,
            "_primary_given": F.first(F.col("_p").isNotNull()).over(by_rule),
        }
    )
    ranked = ranked.withColumn(
        "_given_before",
        F.coalesce(
            F.sum(F.when(~F.col("_first") & F.col("_p").isNotNull(), 1).otherwise(0)).over(
                by_rule.rowsBetween(Window.unboundedPreceding, -1)
            ),
            F.lit(0),
        ),
    )
    looked_at = ranked.filter(
        F.col("_first") | (F.col("_primary_given") & (F.col("_given_before") == 0))
    )
    tool = F.coalesce("tool_id", F.lit(""))
    slots = looked_at.filter(F.col("_p").isNotNull()).select(
        log,
        F.when(F.col("_first"), "primary").otherwise("secondary").alias("slot"),
        "class",
        *[F.col(f"_p.{f}").alias(f) for f in fields],
    )
    slots = slots.withColumns(
        {
            "tool_id": tool,
            "risk_level": F.coalesce("install_risk", F.lit("low")),
            "install_policy": F.coalesce("install_policy", F.lit("recommend")),
            "failure_mode": _lookup(F.col("class"), R.FAILURE_MODE_OF_CLASS, ""),
            "install_surface": F.when(
                tool == "", _lookup(F.col("class"), R.SURFACE_OF_CLASS, "")
            ).otherwise(install_surface(tool, F.col("category"))),
            "recommendation_id": recommendation_id(F.col("class"), tool, F.col("signals")),
        }
    ).drop("install_risk", "category")
    notes = cands.filter("skipped").join(
        looked_at.select(log, "precedence"), [log, "precedence"], "left_semi"
    )
    return slots, notes.select(log, "tool_id", "reason", "for_signal")


def install_surface(tool: Column, category: Column) -> Column:
    by_category = _lookup(category, R.SURFACE_OF_CATEGORY, category)
    return _lookup(tool, R.SURFACE_OF_TOOL, by_category)


def recommendation_id(cls: Column, tool: Column, signals: Column) -> Column:
    """`rec.<class>.<tool>.<signals>`, empty parts `none`."""
    none = F.lit("none")
    return F.concat_ws(
        ".",
        F.lit("rec"),
        cls,
        F.coalesce(F.nullif(tool, F.lit("")), none),
        F.coalesce(F.nullif(F.array_join(signals, "_"), F.lit("")), none),
    )


def skip_notes_ordered(notes: DataFrame, log: str) -> DataFrame:
    """Skip notes as one sorted array per log (O07); at most one per registered tool."""
    return notes.groupBy(log).agg(
        F.array_sort(F.collect_list(F.struct("tool_id", "for_signal", "reason"))).alias("skipped")
    )


def unknown_ids(signals: DataFrame, evidence: DataFrame, tools: DataFrame, log: str) -> DataFrame:
    """Distinct unknown signals and tools of each log."""
    bad_signals = signals.filter(~F.col("signal").isin(*R.SIGNALS)).select(
        log, F.col("signal").alias("id")
    )
    bad_tools = (
        evidence.join(tools.select("tool_id"), "tool_id", "left_anti")
        .select(log, F.col("tool_id").alias("id"))
        .distinct()
    )
    return bad_signals.distinct().unionByName(bad_tools).groupBy(log).agg(
        F.count(F.lit(1)).alias("unknown_id_count")
    )


REDUCER_CLASSES = (
    "mcp_output_reducer", "shell_output_reducer", "retrieval", "reread_guard", "output_verbosity",
)


def bounded_tool_state(slots: DataFrame, log: str) -> DataFrame:
    """Recommendation ids and classes, reducer and target tool ids (A43). Two slots at most."""
    cls = F.element_at(F.split("recommendation_id", r"\."), 2)
    tool = F.nullif(F.col("tool_id"), F.lit(""))

    def joined(value):
        return F.concat_ws(",", F.sort_array(F.collect_set(value)))

    return slots.groupBy(log).agg(
        joined(F.col("recommendation_id")).alias("recommendation_ids"),
        joined(cls).alias("recommendation_classes"),
        joined(F.when(cls.isin(*REDUCER_CLASSES), tool)).alias("reducer_ids"),
        joined(tool).alias("target_ids"),
    )


def customizations(findings: DataFrame, logs: DataFrame, log: str) -> DataFrame:
    """(log, customization_id), the baseline one where no rule fires."""
    spark = findings.sparkSession
    table = spark.createDataFrame(list(R.CUSTOMIZATIONS), "finding_id string, customization_id string")
    hit = findings.join(table, "finding_id").select(log, "customization_id").distinct()
    rest = logs.select(log).distinct().join(hit, log, "left_anti")
    return hit.unionByName(
        rest.select(log, F.lit(R.BASELINE_CUSTOMIZATION).alias("customization_id"))
    )


def remediation_tools(facts: DataFrame, tools: DataFrame, log: str) -> DataFrame:
    """Recommended tools from (log, kind, value) facts, with registry risk and surface.

    Each log needs an (`always`, '') fact.
    """
    spark = facts.sparkSession
    hits = facts.join(R.remediations(spark), ["kind", "value"])
    hits = hits.select(log, "tool_id", F.col("category").alias("why")).distinct()
    reg = tools.select(
        F.col("tool_id").alias("_reg"),
        "category",
        "class",
        "install_risk",
        "data_movement_risk",
    )
    key = F.translate("tool_id", "-", "_")
    rows = hits.withColumn("_reg", key).join(reg, "_reg", "left")
    known = F.col("class").isNotNull()
    return rows.select(
        log,
        "tool_id",
        F.col("why").alias("category"),
        F.coalesce("install_risk", F.lit("medium")).alias("risk_level"),
        F.coalesce("data_movement_risk", F.lit("medium")).alias("data_movement_risk"),
        F.when(known, install_surface(F.col("_reg"), F.col("category")))
        .otherwise("reviewed_third_party_or_official_plugin")
        .alias("install_surface"),
        F.when(known, _lookup(F.col("class"), R.FAILURE_MODE_OF_CLASS, "")).alias("failure_mode"),
        _lookup(
            F.col("_reg"), {k: F.lit(",".join(v)) for k, v in R.CONFLICTS.items()}, F.lit("")
        ).alias("conflicts_with"),
    )


def public_tokens(ids: DataFrame, labels: DataFrame, allowed: DataFrame, log: str) -> DataFrame:
    """Distinct `prefix:id` tokens that may be shown.

    `ids` has (log, prefix, id), `allowed` (prefix, id), `labels` one row per log with
    client, operating_system, shell, version_control.
    """
    safe = r"^[A-Za-z0-9_.-]+$"
    listed = ids.filter(F.col("id").rlike(safe)).join(allowed, ["prefix", "id"], "left_semi")
    named = F.array(
        *[
            F.struct(F.lit(prefix).alias("prefix"), F.col(col).alias("id"))
            for prefix, col in (
                ("client", "client"), ("os", "operating_system"), ("shell", "shell"),
                ("vcs", "version_control"),
            )
        ]
    )
    free = labels.select(log, F.inline(named)).filter(F.col("id").rlike(safe))
    return (
        listed.select(log, "prefix", "id")
        .unionByName(free)
        .select(log, F.concat_ws(":", "prefix", "id").alias("token"))
        .distinct()
    )
