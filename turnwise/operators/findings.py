"""Findings, savings, score and baseline receipts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnwise.functions import buckets as B
from turnwise.functions.json_nodes import settled

# The advice that goes with each finding.
REREAD_FIX = "Prefer targeted searches and summarize file state before rereading the same files."
TOOL_FIX = "Cap command output and use narrower queries before pasting long terminal output into context."
RETRY_FIX = "Stop after repeated failures, inspect the invariant, and restart with a smaller debugging scope."
GROWTH_FIX = "Compact after task pivots and avoid combining architecture, debugging, and implementation in one long session."
ARGS_FIX = "Stop repeated identical tool calls after failure; inspect the invariant or change the approach before retrying."
CACHE_FIX = "Treat cache-creation spikes as context-boundary events; compact or split the session after major tool-output or configuration changes."
MCP_SEVERE_FIX = "Disable unused MCP servers by default and lazy-load heavy MCP servers only when needed."
MCP_HIGH_FIX = "Scope project-specific MCPs to project config instead of global config; prefer narrower MCP servers over all-tools-enabled setups."
SKILL_SEVERE_FIX = "Move rarely used instructions out of always-loaded skill context; keep only high-signal skills in the default agent context."
SKILL_HIGH_FIX = "Split general skills from project-specific skills."
DEFAULT_FIX = "Keep sessions scoped and compact before major task pivots."

# Percent of gross tokens that a fix is expected to save, low and high.
CAPTURE = {
    "repeated_file_reads": (35, 60),
    "tool_output_bloat": (20, 45),
    "retry_loop": (25, 50),
    "context_growth_spikes": (15, 35),
    "mcp_bloat_severe": (10, 25),
    "mcp_bloat_high": (10, 25),
    "skill_bloat_severe": (10, 25),
    "skill_bloat_high": (10, 25),
    "args_hashed_retry_loop": (25, 50),
    "cache_invalidation_spike": (10, 30),
}
# Percent of all tokens per occurrence, and the most it can reach.
PER_COUNT = {
    "repeated_file_reads": (2, 38),
    "retry_loop": (5, 30),
    "context_growth_spikes": (6, 42),
    "args_hashed_retry_loop": (6, 30),
    "cache_invalidation_spike": (8, 30),
}
FLAT_SHARE = {
    "mcp_bloat_severe": 22,
    "skill_bloat_severe": 22,
    "mcp_bloat_high": 14,
    "skill_bloat_high": 14,
}
# The report view prices the same findings with its own constants.
VIEW_PER_COUNT = {
    "args_hashed_retry_loop": (5, 34),
    "retry_loop": (5, 32),
    "repeated_file_reads": (3, 38),
    "context_growth_spikes": (4, 42),
}
CAP_PCT = 65


def _long(value) -> Column:
    return (value if isinstance(value, Column) else F.lit(value)).cast("long")


def tool_share() -> Column:
    """Percent of estimated tokens that came from tools."""
    ok = (F.col("tool_output_tokens") > 0) & (F.col("estimated_tokens") > 0)
    return F.when(
        ok, B.truncated_ratio(F.col("tool_output_tokens"), F.col("estimated_tokens"), 100)
    ).otherwise(_long(0))


def _finding(fires, finding_id, severity, fix, impact, mode, count=0, share=0, note="") -> Column:
    note = note if isinstance(note, Column) else F.lit(note)
    severity = severity if isinstance(severity, Column) else F.lit(severity)
    row = F.struct(
        F.lit(finding_id).alias("finding_id"),
        severity.alias("severity"),
        F.lit(impact).alias("cost_impact"),
        F.lit(mode).alias("failure_mode"),
        _long(count).alias("count"),
        _long(share).alias("token_share_pct"),
        note.alias("description"),
        F.lit(fix).alias("recommendation"),
    )
    return F.when(fires, row)


def finding_array(merged: bool = False, signals: bool = True, bands: bool = True) -> Column:
    """Fired rules of one report, in rule order.

    A merged report rates re-reads high at 25 instead of 10 and has no band findings.
    """
    rr, depth, growth = (
        F.col(c) for c in ("rereads", "retry_depth_max", "context_growth_events")
    )
    share = tool_share()
    note = (
        (lambda text, own: text) if merged else (lambda text, own: own)
    )
    rules = [
        _finding(
            rr >= 3, "repeated_file_reads", B.severity(rr, 3, 25 if merged else 10), REREAD_FIX,
            "medium-high", "repeated_codebase_navigation", rr,
            note=note("Repeated reads across analyzed sessions", ""),
        ),
        _finding(
            share >= 35, "tool_output_bloat", B.severity(share, 35, 55), TOOL_FIX, "high",
            "tool_output_flooding", share=share,
            note=note("Tool output share across analyzed sessions", ""),
        ),
        _finding(
            depth >= 3, "retry_loop", B.severity(depth, 3, 6), RETRY_FIX, "medium",
            "cross_cutting_telemetry", depth,
            note=note("Maximum retry depth across analyzed sessions", ""),
        ),
        _finding(
            growth >= 2, "context_growth_spikes", B.severity(growth, 2, 5), GROWTH_FIX, "medium",
            "tool_output_flooding", growth,
            note=note(
                "Timeline windows exceeded growth threshold across analyzed sessions",
                F.concat(growth.cast("string"), F.lit(" timeline windows exceeded the growth threshold")),
            ),
        ),
    ]
    if bands and not merged:
        for surface, fixes in (
            ("mcp", (MCP_SEVERE_FIX, MCP_HIGH_FIX)),
            ("skill", (SKILL_SEVERE_FIX, SKILL_HIGH_FIX)),
        ):
            for band, severity, fix in zip(("severe", "high"), ("high", "medium"), fixes):
                rules.append(
                    _finding(
                        F.col(f"{surface}_band") == band, f"{surface}_bloat_{band}", severity, fix,
                        "medium-high", "cross_cutting_telemetry", note=f"Bloat band: {band}",
                    )
                )
    if signals:
        loops, spikes = F.col("args_hashed_retry_loops"), F.col("cache_invalidation_events")
        rules += [
            _finding(
                loops >= 2, "args_hashed_retry_loop", B.severity(loops, 2, 5), ARGS_FIX,
                "medium-high", "", loops,
                note="Same tool and sanitized argument hash repeated after failure",
            ),
            _finding(
                spikes >= 1, "cache_invalidation_spike", B.severity(spikes, 1, 3), CACHE_FIX,
                "medium-high", "", spikes,
                note=F.concat(
                    F.lit("Large cache-creation token event; cache miss ratio "),
                    F.col("cache_miss_ratio_pct").cast("string"),
                    F.lit("%"),
                ),
            ),
        ]
    return F.array_compact(F.array(*rules))


def with_findings(reports: DataFrame, **kw) -> DataFrame:
    return settled(reports, {"findings": finding_array(**kw)})


def _by_id(finding: Column, table: dict, make, otherwise: Column) -> Column:
    out = None
    for key, value in table.items():
        test, result = finding["finding_id"] == key, make(value)
        out = F.when(test, result) if out is None else out.when(test, result)
    return out.otherwise(otherwise)


def _share_of(total: Column, pct) -> Column:
    return B.scaled(total, pct, 100)


def _gross(finding: Column, total: Column) -> Column:
    """Tokens a finding touches, before the share that a fix captures."""

    def priced(rule):
        per, most = rule
        pct = F.greatest(F.least(F.greatest(finding["count"], _long(1)) * per, _long(most)), _long(3))
        return B.clamp_tokens(_share_of(total, pct), total)

    by_count = _by_id(finding, PER_COUNT, priced, _share_of(total, 10))
    flat = _by_id(finding, FLAT_SHARE, lambda pct: _share_of(total, pct), by_count)
    spike = (finding["finding_id"] == "cache_invalidation_spike") & (
        F.col("cache_creation_tokens") > 0
    )
    return (
        F.when(
            finding["token_share_pct"] > 0,
            B.clamp_tokens(_share_of(total, finding["token_share_pct"]), total),
        )
        .when(
            finding["finding_id"] == "tool_output_bloat",
            B.clamp_tokens(F.col("tool_output_tokens"), total),
        )
        .when(spike, B.clamp_tokens(F.col("cache_creation_tokens"), total))
        .otherwise(flat)
    )


def with_savings(reports: DataFrame) -> DataFrame:
    """Add per-finding estimates, capped totals, percents, waste range and score.

    A report has ten findings at most, so its estimates stay in one array and need no
    shuffle.
    """
    native = F.col("input_tokens") + F.col("output_tokens")
    total = (
        F.when(F.col("estimated_tokens") > 0, F.col("estimated_tokens"))
        .when(native > 0, native)
        .otherwise(F.col("tool_output_tokens"))
    )
    reports = settled(reports, {"_total": total.cast("long")})
    estimates = F.transform(
        "findings",
        lambda f: F.struct(
            f["finding_id"].alias("finding_id"),
            _gross(f, F.col("_total")).alias("gross_tokens"),
            _by_id(f, {k: v[0] for k, v in CAPTURE.items()}, _long, _long(10)).alias("capture_pct_low"),
            _by_id(f, {k: v[1] for k, v in CAPTURE.items()}, _long, _long(20)).alias("capture_pct_high"),
        ),
    )
    kept = F.when(F.col("_total") > 0, F.filter(estimates, lambda e: e["gross_tokens"] > 0)).otherwise(
        F.filter(estimates, lambda e: F.lit(False))
    )
    reports = settled(reports, {"_est": kept})
    priced = F.transform(
        "_est",
        lambda e: e.withField(
            "potential_tokens_low", _share_of(e["gross_tokens"], e["capture_pct_low"])
        ).withField(
            "potential_tokens_high",
            F.greatest(_share_of(e["gross_tokens"], e["capture_pct_high"]), _long(1)),
        ),
    )
    reports = settled(reports, {"_priced": priced})

    def total_of(field):
        return F.aggregate("_priced", _long(0), lambda acc, e: acc + e[field])

    cap = F.greatest(_share_of(F.col("_total"), CAP_PCT), _long(1))
    reports = settled(
        reports,
        {
            "_low": total_of("potential_tokens_low"),
            "_high": total_of("potential_tokens_high"),
            "_cap": cap,
        },
    )
    over = F.col("_high") > F.col("_cap")

    def capped(value):
        return B.scaled(value, F.col("_cap"), F.col("_high"))

    scaled = F.transform(
        "_priced",
        lambda e: F.when(
            over,
            e.withField("potential_tokens_low", capped(e["potential_tokens_low"])).withField(
                "potential_tokens_high", capped(e["potential_tokens_high"])
            ),
        ).otherwise(e),
    )
    reports = settled(
        reports,
        {
            "finding_estimates": scaled,
            "potential_tokens_low": F.when(over, capped(F.col("_low"))).otherwise(
                F.least("_low", "_high")
            ),
            "potential_tokens_high": F.least("_high", "_cap"),
        },
    )
    reports = settled(
        reports,
        {
            "_pl": B.rounded_percent(F.col("potential_tokens_low"), F.col("_total")),
            "_ph": B.rounded_percent(F.col("potential_tokens_high"), F.col("_total")),
        },
    )
    return reports.withColumns(
        {
            "waste_low": F.least("_pl", "_ph"),
            "waste_high": F.greatest("_pl", "_ph"),
            "score": F.lit(100) - F.greatest("_pl", "_ph"),
        }
    ).drop("_total", "_est", "_priced", "_low", "_high", "_cap", "_pl", "_ph")


def immediate_fixes() -> Column:
    """Recommendation texts in finding order, or the default."""
    fixes = F.transform("findings", lambda f: f["recommendation"])
    return F.when(F.size("findings") > 0, fixes).otherwise(F.array(F.lit(DEFAULT_FIX)))


def representative_tokens(finding: Column) -> Column:
    """Tokens shown for a finding in a report view."""
    native = F.col("input_tokens") + F.col("output_tokens")
    total = (
        F.when(F.col("estimated_tokens") > 0, F.col("estimated_tokens"))
        .when(native > 0, native)
        .otherwise(_long(1000))
    )

    def clamp(value):
        return F.when(value < 1, _long(1)).otherwise(F.least(value, total))

    def priced(rule):
        per, most = rule
        pct = F.greatest(F.least(F.greatest(finding["count"], _long(1)) * per, _long(most)), _long(4))
        return clamp(_share_of(total, pct))

    middle = F.floor((F.col("waste_low") + F.col("waste_high")) / 2).cast("long")
    fallback = clamp(_share_of(total, F.when(middle <= 0, _long(12)).otherwise(middle)))
    own = F.aggregate(
        F.filter("finding_estimates", lambda e: e["finding_id"] == finding["finding_id"]),
        _long(0),
        lambda acc, e: e["potential_tokens_high"],
    )
    fid = finding["finding_id"]
    return (
        F.when(own > 0, own)
        .when(finding["token_share_pct"] > 0, clamp(_share_of(total, finding["token_share_pct"])))
        .when(
            (fid == "tool_output_bloat") & (F.col("tool_output_tokens") > 0),
            clamp(F.col("tool_output_tokens")),
        )
        .when(
            (fid == "cache_invalidation_spike") & (F.col("cache_creation_tokens") > 0),
            clamp(F.col("cache_creation_tokens")),
        )
        .otherwise(_by_id(finding, VIEW_PER_COUNT, priced, fallback))
    )


# Baseline receipts and their comparison -----------------------------------------------

RECEIPT_METRICS = (
    ("uncached_plus_output_per_turn", "uncached_plus_output_tokens"),
    ("tool_output_tokens_per_turn", "tool_output_tokens"),
    ("cache_creation_per_turn", "cache_creation_tokens"),
    ("failed_commands_per_turn", "failed_commands"),
    ("rereads_per_turn", "rereads"),
    ("context_growth_per_turn", "context_growth_events"),
)
# The sentence for each evidence tier.
TIER_SUMMARY = {
    "proven": "Repeated controlled A/B benchmark evidence supports a causal savings claim for this workflow.",
    "verified": "Direct reducer receipts and independent normalized log counters both show savings movement.",
    "observed": "Normalized log metrics improved, but the workload was not controlled.",
    "inconclusive": "Workload, source mix, sample size, or counter quality changed too much for a savings claim.",
}


def per_turn_permille(value: Column, turns: Column) -> Column:
    return B.truncated_ratio(value, F.greatest(turns, _long(1)), 1000)


def receipt_metrics(reports: DataFrame, *keys: str) -> DataFrame:
    """Long (key, metric_id, permille) rows of the six per-turn metrics."""
    spent = F.col("input_tokens") + F.col("cache_creation_tokens") + F.col("output_tokens")
    rows = reports.withColumn("uncached_plus_output_tokens", spent)
    entries = F.array(
        *[
            F.struct(
                F.lit(metric).alias("metric_id"),
                per_turn_permille(F.col(col), F.col("turns")).alias("permille"),
            )
            for metric, col in RECEIPT_METRICS
        ]
    )
    return rows.select(*keys, F.inline(entries))


def metric_deltas(base: DataFrame, current: DataFrame, *keys: str) -> DataFrame:
    """Baseline against current, per metric."""
    b = base.withColumnRenamed("permille", "baseline_permille")
    c = current.withColumnRenamed("permille", "current_permille")
    joined = b.join(c, [*keys, "metric_id"])
    delta = F.col("current_permille") - F.col("baseline_permille")
    return joined.withColumns(
        {
            "delta_permille": delta,
            "delta_pct": F.when(F.col("baseline_permille") == 0, _long(0)).otherwise(
                B.truncated_ratio(delta, F.col("baseline_permille"), 100)
            ),
            "improved": F.col("current_permille") < F.col("baseline_permille"),
        }
    )


def validate_savings(
    deltas: DataFrame, base: DataFrame, current: DataFrame, *keys: str
) -> DataFrame:
    """Warnings, receipt agreement and evidence tier.

    `base` and `current` hold per key: log_count, source_mix (signature), turns, and on
    the current side optionally receipt_savings (boolean) and controlled (boolean).
    """
    per_key = deltas.groupBy(*keys).agg(
        F.sum(F.col("improved").cast("long")).alias("improved_count"),
        F.max(
            F.col("improved")
            & F.col("metric_id").isin("uncached_plus_output_per_turn", "tool_output_tokens_per_turn")
        ).alias("_token_move"),
        F.max(
            (F.col("metric_id") == "uncached_plus_output_per_turn")
            & ((F.col("baseline_permille") == 0) | (F.col("current_permille") == 0))
        ).alias("_no_counters"),
    )
    for name in ("receipt_savings", "controlled"):
        if name not in current.columns:
            current = current.withColumn(name, F.lit(False))
    sides = ("log_count", "source_mix", "turns")
    b = base.select(*keys, *[F.col(c).alias(f"_b_{c}") for c in sides])
    c = current.select(*keys, "receipt_savings", "controlled", *[F.col(x).alias(f"_c_{x}") for x in sides])
    joined = per_key.join(b, list(keys)).join(c, list(keys))
    ratio = F.col("_c_turns").cast("double") / F.col("_b_turns").cast("double")
    volume = (F.col("_b_turns") > 0) & (F.col("_c_turns") > 0) & ((ratio < 0.5) | (ratio > 2.0))
    mix = F.col("_b_source_mix") != F.col("_c_source_mix")
    small = (F.col("_b_log_count") < 3) | (F.col("_c_log_count") < 3)
    agreed = F.col("receipt_savings") & F.col("_token_move")
    tier = (
        F.when(F.col("controlled"), "proven")
        .when(agreed, "verified")
        .when((F.col("improved_count") >= 2) & ~volume & ~mix, "observed")
        .otherwise("inconclusive")
    )
    warnings = F.array_compact(
        F.array(
            F.when(small, "small_log_sample"),
            F.when(mix, "source_mix_changed"),
            F.when(volume, "workload_volume_changed"),
            F.when(F.col("_no_counters"), "missing_native_token_counters"),
        )
    )
    summaries = F.create_map(*[F.lit(x) for pair in TIER_SUMMARY.items() for x in pair])
    return joined.select(
        *keys,
        "improved_count",
        warnings.alias("warnings"),
        agreed.alias("direct_receipt_agreement"),
        tier.alias("evidence_tier"),
    ).withColumn("summary", summaries[F.col("evidence_tier")])


def reducer_receipt(stats: DataFrame, since: Column | None = None, *by: str) -> DataFrame:
    """Totals of reducer session stats newer than `since` and the percent cut."""
    rows = stats if since is None else stats.filter(F.col("updated_at") > since)
    rows = rows.filter((F.col("total_calls") > 0) | (F.col("tokens_saved") > 0))
    pos = lambda c: F.sum(F.greatest(F.col(c), _long(0))).cast("long")
    sums = rows.groupBy(*by).agg(
        pos("total_calls").alias("calls"),
        pos("tokens_saved").alias("tokens_saved"),
        pos("total_processed").alias("processed_bytes"),
        pos("bytes_returned").alias("returned_bytes"),
    )
    cut = B.clamp(
        B.truncated_ratio(
            F.col("processed_bytes") - F.col("returned_bytes"), F.col("processed_bytes"), 100
        ),
        _long(0),
        _long(100),
    )
    return sums.withColumn(
        "reduction_pct", F.when(F.col("processed_bytes") > 0, cut).otherwise(_long(0))
    )


def normalize_receipts(receipts: DataFrame) -> DataFrame:
    """Drop invalid receipts, fill the source, clamp the percent."""
    return receipts.filter(
        (F.col("tool_id") != "") & (F.col("calls") >= 0) & (F.col("tokens_saved") >= 0)
    ).withColumns(
        {
            "receipt_source": F.coalesce(F.nullif(F.col("receipt_source"), F.lit("")), F.lit("local_receipt")),
            "reduction_pct": B.clamp(F.col("reduction_pct"), _long(0), _long(100)),
        }
    )
