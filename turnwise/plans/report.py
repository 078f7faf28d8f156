"""From an analysis to the whole report of a log, and to the event that may be kept of it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnwise.functions import buckets as B
from turnwise.operators import findings as Fd
from turnwise.operators import fingerprints as Fp
from turnwise.operators import recommend as R
from turnwise.operators import retained as Re
from turnwise.operators import tooling as T
from turnwise.plans.analyze import Analysis, analyze
from turnwise.registry import detectors as D
from turnwise.registry import signatures as S
from turnwise.registry import tools as Tl
from turnwise.session import cut_lineage
from turnwise.sources import feeds
from turnwise.sources.logs import with_source

#: Category of the registry, and the field of the event that lists its ids.
ECOSYSTEM_FIELDS = (
    ("coding_agent", "coding_agents"),
    ("framework", "workflow_frameworks"),
    ("mcp", "mcp_servers_known"),
    ("skill", "known_skills"),
    ("plugin", "known_plugins"),
    ("package_manager", "package_managers"),
)


@dataclass(frozen=True)
class Report:
    """Frames of the part of a report that rests on its findings; all lazy, keyed by `log_id`."""

    fingerprints: DataFrame
    signals: DataFrame  # log_id, signal
    tool_states: DataFrame
    recommendations: DataFrame  # primary and secondary slot
    skip_notes: DataFrame
    fixes: DataFrame  # log_id, immediate_fixes
    receipts: DataFrame  # log_id, metric_id, permille


def _known_calls(a: Analysis) -> DataFrame:
    calls = T.mcp_call_rows(a.logs, a.turns).select("log_id", F.lit("mcp").alias("surface"), F.col("server").alias("id"))
    runs = T.skill_run_rows(a.turns).select("log_id", F.lit("skill").alias("surface"), F.col("skill").alias("id"))
    known = {"mcp": S.ids("mcp"), "skill": S.slash_command_ids()}
    rows = calls.unionByName(runs).distinct()
    normal = {k: [i.lower().replace("-", "_") for i in v] for k, v in known.items()}
    return rows.filter(
        ((F.col("surface") == "mcp") & F.col("id").isin(*normal["mcp"]))
        | ((F.col("surface") == "skill") & F.col("id").isin(*normal["skill"]))
    )


def full_report(a: Analysis, inventory: DataFrame | None = None) -> Report:
    """Fingerprints, signals, tool states, recommendations, fixes and receipts of every log.

    `inventory` has (log_id, binary, version_text) of tools found beside a log.
    """
    spark = a.reports.sparkSession
    detectors, _, rules = D.frames(spark)
    prints = Fp.evaluate(Fp.marker_hits(a.logs, list(D.MARKERS), inventory), detectors, rules)
    findings = a.reports.select("log_id", F.inline("findings")).select("log_id", "finding_id", "severity")
    bands = a.utilization.select("log_id", "mcp_band", "skill_band")
    tools = Tl.tools(spark)
    signals = R.derive_signals(findings, bands, prints, tools, "log_id")
    frameworks = a.ecosystem.select("log_id", F.explode("framework").alias("id"))
    shown = [
        a.utilization.select("log_id", F.lit(s).alias("surface"), F.explode(f"{s}_exposed_ids").alias("id"))
        for s in ("mcp", "skill")
    ]
    present = prints.withColumn("has_cli", F.col("installed"))
    evidence = R.tool_evidence(frameworks, present, shown[0].unionByName(shown[1]), _known_calls(a), "log_id")
    states, sources = R.tool_states(evidence, tools, "log_id")
    slots, notes = R.recommend(signals, states, sources, Tl.rule_signals(spark), tools, "log_id")
    return Report(
        prints,
        signals,
        states,
        slots,
        notes,
        a.reports.select("log_id", Fd.immediate_fixes().alias("immediate_fixes")),
        Fd.receipt_metrics(a.reports, "log_id"),
    )


def _lists(a: Analysis) -> DataFrame:
    """Called and unknown tools of each log, by name."""
    calls = _known_calls(a).groupBy("log_id").agg(
        F.sort_array(F.collect_set(F.when(F.col("surface") == "mcp", F.col("id")))).alias("called_ids"),
        F.sort_array(F.collect_set(F.when(F.col("surface") == "skill", F.col("id")))).alias("run_ids"),
    )
    return a.utilization.join(calls, "log_id", "left")


def retained(a: Analysis, report: Report, version: str, sizes: DataFrame, parser_type: str = "text", scan_type: str = "free") -> DataFrame:
    """`log_id` and the retained event of each log, in the columns of `feeds.RETAINED_SCHEMA`.

    `sizes` has (log_id, source_id, size_bytes, content_hash_sha256). Only registered ids and
    bucketed numbers are kept; unknown names are counted. The parts of an event are grouped once
    each by `log_id` and joined on it.
    """
    spark = a.reports.sparkSession
    eco = a.ecosystem
    unknown = T.unknown_mcp_count(a.logs, T.ecosystem_ids(eco).filter("category = 'mcp'"))
    findings = Re.keep_findings(a.reports.select("log_id", F.inline("findings")))
    by_finding = findings.groupBy("log_id").agg(
        F.map_from_entries(F.array_sort(F.collect_set(F.struct("finding_id", "severity")))).alias("findings")
    )
    redactions = Re.keep_redactions(a.redactions).groupBy("log_id").agg(
        F.map_from_entries(F.array_sort(F.collect_set(F.struct("family", F.col("count").cast("int"))))).alias("redactions")
    )
    registered = spark.createDataFrame([(d,) for d in sorted({m[0] for m in D.MARKERS})], "fingerprint_id string")
    prints = Re.keep_fingerprints(report.fingerprints, registered).groupBy("log_id").agg(
        F.array_sort(
            F.collect_list(
                F.struct(
                    F.col("fingerprint_id").alias("id"), "confidence", "sources",
                    F.col("evidence_count").cast("int").alias("evidence_count"), "active", "installed", "version_bucket",
                )
            )
        ).alias("workflow_fingerprints")
    )
    slot_fields = ["class", "tool_id", "reason", "signals", "risk_level", "install_policy"]
    slots = Re.recommendation_slots(report.recommendations).groupBy("log_id").agg(
        *[F.first(F.when(F.col("slot") == s, F.struct(*slot_fields)), ignorenulls=True).alias(f"_{s}") for s in ("primary", "secondary")]
    )
    signals = report.signals.groupBy("log_id").agg(F.sort_array(F.collect_set("signal")).alias("_signals"))
    skipped = report.skip_notes.groupBy("log_id").agg(F.count("*").alias("_skipped"))
    rows = (
        a.reports.select("log_id", "turns", "score", F.col("waste_high"))
        .join(sizes, "log_id")
        .join(eco, "log_id")
        .join(_lists(a), "log_id")
    )
    for part in (unknown, by_finding, redactions, prints, slots, signals, skipped):
        rows = rows.join(part, "log_id", "left")
    rows = rows.withColumns(
        {"parser_type": F.lit(parser_type), "scan_type": F.lit(scan_type), "session_count": F.lit(1).cast("long")}
    )
    size_bucket = B.range_bucket(F.col("size_bytes"), B.INPUT_SIZE)
    rows = rows.withColumn("_log_size", size_bucket)
    rows = Re.safe_events(rows)
    none = F.array().cast("array<string>")
    ids = {field: Re.allowed_ids(F.coalesce(F.col(cat), none), cat) for cat, field in ECOSYSTEM_FIELDS}
    whole = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("int")
    count = lambda c: B.int_bucket(F.col(c), B.CALLS)
    mcp = F.struct(
        F.col("mcp_exposed_ids").alias("known_server_ids"), whole("mcp_unknown").alias("unknown_server_count"),
        F.col("mcp_count_bucket").alias("server_count_bucket"), F.col("mcp_tool_bucket").alias("exposed_tool_count_bucket"),
        F.col("mcp_tokens").alias("context_token_bucket"), F.col("mcp_known").alias("exposure_known"),
        F.col("mcp_source").alias("inference_source"), count("call_count").alias("call_count_bucket"),
        count("known_call_count").alias("known_call_count_bucket"), count("unknown_call_count").alias("unknown_call_count_bucket"),
        F.coalesce("called_ids", none).alias("unique_known_called_ids"), whole("unique_unknown_called").alias("unique_unknown_called_count"),
        B.ratio_bucket(F.col("mcp_ratio")).alias("utilization_ratio_bucket"), F.col("mcp_efficiency").alias("context_efficiency_bucket"),
        F.col("mcp_band").alias("warning_band"),
    )
    skill = F.struct(
        F.col("skill_exposed_ids").alias("known_exposed_ids"), whole("skill_unknown").alias("unknown_exposed_count"),
        F.col("skill_count_bucket").alias("exposed_count_bucket"), F.col("skill_tokens").alias("context_token_bucket"),
        F.col("skill_header").alias("exposure_known"), F.col("skill_source").alias("inference_source"),
        count("executed_count").alias("executed_count_bucket"), F.coalesce("run_ids", none).alias("known_executed_ids"),
        whole("unknown_executed").alias("unknown_executed_count"), B.ratio_bucket(F.col("skill_ratio")).alias("utilization_ratio_bucket"),
        F.col("skill_efficiency").alias("context_efficiency_bucket"), F.col("skill_band").alias("warning_band"),
    )
    labels = [F.col(c) for c in ("client", "operating_system", "shell", "version_control")]
    ecosystem = F.struct(
        *labels,
        *[v.alias(k) for k, v in ids.items()],
        whole("unknown_mcp_server_count").alias("unknown_mcp_server_count"), whole("unknown_executed").alias("unknown_skill_count"),
        F.lit(0).alias("unknown_plugin_count"),  # no line names a plugin that no list knows
        F.coalesce("workflow_fingerprints", F.array()).alias("workflow_fingerprints"),
        F.struct(mcp.alias("mcp"), skill.alias("skill")).alias("tooling_utilization"),
    )
    source = B.enum_or_unknown(F.col("source_id"), S.ids("coding_agent"))
    out = rows.select(
        "log_id",
        F.lit("1").alias("schema_version"), F.lit("analytics.report").alias("event"), F.lit(version).alias("analyzer_version"),
        "scan_type", "parser_type", "input_size_bucket", "turn_bucket", "session_count_bucket", "score_bucket", "waste_bucket",
        F.array(F.struct(source.alias("source_id"), "content_hash_sha256", F.col("_log_size").alias("size_bucket"))).alias("analyzed_log_hashes"),
        F.coalesce("findings", F.create_map().cast("map<string,string>")).alias("findings"),
        F.coalesce("redactions", F.create_map().cast("map<string,int>")).alias("redactions"),
        ecosystem.alias("ecosystem"),
        F.struct(
            F.col("_primary").alias("primary"), F.col("_secondary").alias("secondary"), F.coalesce("_signals", none).alias("signals"),
            B.int_bucket(F.coalesce("_skipped", F.lit(0)), B.SKIPPED).alias("skipped_count_bucket"),
        ).alias("recommendation"),
    )
    kinds = {f.name: f.dataType for f in _schema()}
    return out.select("log_id", *[F.col(c).cast(kinds[c]).alias(c) for c in kinds])


def retain_batches(out: str, version: str):
    """Handler for `streaming.jobs.intake`: analyzes each batch of logs and writes its retained events.

    A batch has a folder of its own, so one that runs again after a failure replaces its events.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        logs = with_source(batch).select("log_id", "source_id", "content")
        sizes = logs.select(
            "log_id", "source_id", F.octet_length("content").alias("size_bytes"), F.sha2("content", 256).alias("content_hash_sha256")
        )
        analysis = analyze(logs, cut=cut_lineage)
        events = retained(analysis, full_report(analysis), version, sizes)
        events.drop("log_id").write.mode("overwrite").json(f"{out}/batch={batch_id}")

    return handle


def _schema():
    from pyspark.sql.types import StructType

    return StructType.fromDDL(feeds.RETAINED_SCHEMA)
