"""Logs to reports, reports to merged reports."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnwise.functions import text as X
from turnwise.operators import findings as Fd
from turnwise.operators import merge as M
from turnwise.operators import normalize as N
from turnwise.operators import sessions as Se
from turnwise.operators import tooling as T


@dataclass(frozen=True)
class Analysis:
    """Frames of one analysis; all lazy."""

    logs: DataFrame  # scrubbed
    redactions: DataFrame  # log_id, family, count
    turns: DataFrame
    events: DataFrame
    timeline: DataFrame
    ecosystem: DataFrame
    utilization: DataFrame
    reports: DataFrame  # one row per log


def scrub(logs: DataFrame, content: str = "content") -> DataFrame:
    """Logs with the scrubbed content and a `redactions` array. Rules span lines, so this
    precedes the split."""
    return X.with_scrubbed(logs, content, out="_s").drop(content).withColumnRenamed("_s", content)


def analyze(logs: DataFrame, only: tuple[str, ...] | None = None, cut=None) -> Analysis:
    """Scrub, parse, normalise, fold and rate every log (`log_id, source_id, content`).

    A log is one row of bounded size, so everything up to the turns is narrow; the folds
    share the key `log_id`. `cut`, e.g. `session.cut_lineage`, is applied to what several
    results read, so that every log is scrubbed, parsed and rated once.
    """
    cut = cut or (lambda df: df)
    clean = cut(scrub(logs))
    redactions = clean.select("log_id", F.inline("redactions"))
    lines = N.lines_of(clean.select("log_id", "source_id", "content"))
    turns = cut(
        N.turns_of(lines).withColumn("tokens", X.token_estimate(F.col("text"))).drop("raw")
    )
    events = cut(N.with_event_position(N.events_of(N.with_nodes(lines), only=only)))
    reads = Se.file_reads_of(turns)
    metrics = Se.session_metrics(turns, reads=reads)
    signals = Se.session_signals(events, step=N.POSITION_STEP)
    both = Se.reconcile(metrics, signals)
    use = cut(T.utilization(clean, turns, metrics))
    bands = use.select("log_id", "mcp_band", "skill_band")
    reports = cut(Fd.with_savings(Fd.with_findings(both.join(bands, "log_id"))))
    return Analysis(
        clean,
        redactions,
        turns,
        events,
        Se.timeline(turns, reads=reads),
        cut(T.ecosystem(clean)),
        use,
        reports,
    )


def merged_reports(reports: DataFrame, *by: str) -> DataFrame:
    """Merge reports per group and rate the merged counters."""
    metrics = M.merge_metrics(reports, *by)
    signals = M.merge_signals(reports, *by).drop("session_count")
    if not by:
        metrics, signals = metrics.withColumn("_all", F.lit(0)), signals.withColumn("_all", F.lit(0))
    both = metrics.join(signals, list(by) or ["_all"]).drop("_all")
    return Fd.with_savings(Fd.with_findings(both, merged=True))
