"""The whole plan on small logs: counts, findings, leaks, merging."""

import json

import pytest
from pyspark.sql import functions as F

from turnwise.operators import merge as M
from turnwise.operators import tooling as T
from turnwise.plans.analyze import analyze, merged_reports
from turnwise.plans.report import retain_batches
from turnwise.sources import feeds
from turnwise.streaming import jobs as St

KEY = "sk-ant-" + "7q" * 18
READS = ["lib/parse.py", "docs/notes.md", "lib/parse.py", "lib/parse.py", "docs/notes.md", "lib/parse.py", "docs/notes.md"]


def session():
    """Seven reads of two files, a test that fails four times with a leaked key in the first output."""
    yield {"type": "user", "message": "Use Claude Code with BMAD on macOS; zsh. Start with git status, then mcp__github__list_issues."}
    for i, name in enumerate(READS):
        yield {"type": "tool", "command": f"cat {name}", "output": f"key is {KEY}" if i == 0 else "text"}
    for _ in range(4):
        yield {"type": "tool", "command": "cargo test", "error": "failed: one assertion"}
    yield {"type": "assistant", "message": "The parser drops the last field."}


FIRST = list(session())


@pytest.fixture(scope="module")
def result(spark):
    servers = "".join(f"- acme_private_{i}\n" for i in range(30))
    second = "system: Available MCP servers:\n" + servers + "mcp__acme_private_1__run\n\nplease /review it, not /usr/bin\n"
    logs = spark.createDataFrame(
        [("a", "claude_code", "\n".join(map(json.dumps, FIRST))), ("b", "claude_code", second)],
        "log_id string, source_id string, content string",
    )
    return analyze(logs, only=())


def test_counts_and_findings(result):
    row = result.reports.filter("log_id = 'a'").first()
    assert (row.turns, row.rereads, row.failed_commands, row.retry_depth_max) == (len(FIRST), len(READS) - 2, 4, 4)
    found = {f.finding_id: f.severity for f in row.findings}
    assert found["repeated_file_reads"] == "medium" and found["retry_loop"] == "medium"
    assert 0 <= row.score < 100 and row.waste_low <= row.waste_high
    assert {(r.family, r["count"]) for r in result.redactions.collect()} == {("anthropic_key", 1)}
    eco = result.ecosystem.filter("log_id = 'a'").first()
    assert (eco.client, eco.operating_system, eco.shell, eco.version_control) == ("claude_code", "macos", "zsh", "git")
    assert eco.framework == ["bmad"] and eco.mcp == ["github"]


def test_exposure_is_not_a_call(result):
    row = result.utilization.filter("log_id = 'b'").first()
    assert (row.mcp_source, row.mcp_count, row.call_count) == ("header", 31, 0)
    assert row.mcp_band in ("high", "watch") and row.mcp_ratio == 0
    assert (row.executed_count, row.known_executed) == (1, 1)


def test_nothing_private_leaves(result):
    for df in (result.reports, result.utilization, result.ecosystem, result.timeline, result.redactions, result.events):
        text = "\n".join(df.toJSON().collect())
        for canary in (KEY, "acme_private", "lib/parse"):
            assert canary not in text


def test_merge_is_order_free(spark, result):
    reports = result.reports.withColumn("g", F.lit(1)).drop("mcp_band", "skill_band")
    whole = M.merge_metrics(reports, "g").drop("g").first()
    flipped = M.merge_metrics(reports.orderBy(F.desc("log_id")), "g").drop("g").first()
    assert whole == flipped and whole.session_count == 2
    one = merged_reports(reports.filter("log_id = 'a'"), "g").first()
    assert one.turns == len(FIRST) and [f.finding_id for f in one.findings][:1] == ["repeated_file_reads"]


def test_bands_never_warn_on_count_alone(spark):
    df = spark.createDataFrame([("100+", 40, 9), ("4-10", 0, 9), ("26-50", 19, 9), ("26-50", 19, 0), ("51-100", 30, 0)], "c string, r int, rereads int")
    df = df.withColumns({"retry_depth_max": F.lit(0), "context_growth_events": F.lit(0)})
    band = T.mcp_band(F.lit(True), F.col("c"), F.lit("none"), F.lit("15k-50k"), F.col("r"))
    assert [r[0] for r in df.select(band).collect()] == ["normal", "normal", "severe", "high", "normal"]
    assert df.select(T.mcp_band(F.lit(False), F.col("c"), F.lit("none"), F.lit("none"), F.col("r"))).distinct().first()[0] == "unknown"


def test_arriving_logs_become_retained_events(spark, tmp_path):
    home = tmp_path / "in" / ".claude"
    home.mkdir(parents=True)
    (home / "a.jsonl").write_text("\n".join(map(json.dumps, FIRST)))
    (home / "b.jsonl").write_text("plain words\n")
    stream = St.intake(spark, str(home), str(tmp_path / "ckpt"), retain_batches(str(tmp_path / "out"), "9"))
    stream.awaitTermination()
    kept = {r.turn_bucket: r for r in feeds.retained_events(spark, str(tmp_path / "out")).collect()}
    assert set(kept) == {"0_10", "10_50"}
    row = kept["10_50"]
    assert row.findings["retry_loop"] == "medium" and row.redactions == {"anthropic_key": 1}
    assert row.ecosystem.client == "claude_code" and row.ecosystem.workflow_frameworks == ["bmad"]
    assert row.analyzed_log_hashes[0].source_id == "claude_code" and row.analyzer_version == "9"
    assert row.recommendation.primary["class"] and "acme" not in str(row) and KEY not in str(row)
