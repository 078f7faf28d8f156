"""Benchmark statistics, costs, publication, audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnwise.catalog import query
from turnwise.catalog.scalars import lst, q
from turnwise.operators import benchstats as Bs
from turnwise.plans import adapters as Ad


def n_rows(name="n"):
    return F.count(F.lit(1)).alias(name)


@query(
    "a30_delta_stats",
    "SELECT l_returnflag, l_linestatus, count(*) AS n, round(avg(d), 6) AS mean, round(median(d), 6) AS median, min(d) AS min, max(d) AS max, round(stddev_samp(d), 6) AS stdev FROM (SELECT l_returnflag, l_linestatus, CAST(CAST(l_quantity AS BIGINT) - l_linenumber * 3 AS DOUBLE) AS d FROM lineitem) GROUP BY ALL",
)
def _(spark, sf):
    delta = F.col("l_quantity").cast("long") - F.col("l_linenumber") * 3
    rows = Ad.table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", delta.alias("delta"))
    out = Bs.delta_stats(rows, "l_returnflag", "l_linestatus")
    return out.withColumns({c: F.round(c, 6) for c in ("mean", "median", "stdev")})


SIDES = "(SELECT l_suppkey % 10 AS suite, l_orderkey % 50 AS run, CASE WHEN l_linenumber % 2 = 0 THEN 'baseline' ELSE 'optimized' END AS side, max(l_partkey) AS v FROM lineitem GROUP BY ALL)"


@query("j12_run_deltas", f"SELECT suite, run, 'tokens' AS metric, b.v AS baseline, o.v AS optimized, o.v - b.v AS delta FROM {SIDES} b JOIN {SIDES} o USING (suite, run) WHERE b.side = 'baseline' AND o.side = 'optimized'")
def _(spark, sf):
    rows = Ad.table(spark, sf, "lineitem").groupBy(
        (F.col("l_suppkey") % 10).alias("suite"), (F.col("l_orderkey") % 50).alias("run"),
        F.when(F.col("l_linenumber") % 2 == 0, "baseline").otherwise("optimized").alias("side"),
    ).agg(F.max("l_partkey").alias("v"))
    return Bs.run_deltas(rows.withColumn("metric", F.lit("tokens")), ["suite", "run"], "side", "metric", "v")


GATE = "gate AS (SELECT o_custkey AS suite_id, count(*) AS completed_repeats, CAST(3 AS BIGINT) AS required_repeats, bool_and(o_orderkey % 7 <> 0 AND o_orderkey % 5 <> 0) AND count(*) >= 3 AS quality_passed FROM orders GROUP BY 1)"


def gates(spark, sf):
    k = F.col("o_orderkey")
    runs = Ad.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("suite_id"), F.lit(3).cast("long").alias("required_repeats"),
        F.when(k % 7 == 0, "1").otherwise("0").alias("baseline_quality_status"), F.lit("0").alias("optimized_quality_status"),
        F.lit(0).alias("baseline_exit_status"), F.when(k % 5 == 0, 1).otherwise(0).alias("optimized_exit_status"),
    )
    return Bs.quality_gate(runs, "suite_id")


@query("a31_quality_gate", f"WITH {GATE} SELECT * FROM gate")
def _(spark, sf):
    return gates(spark, sf)


COST = "(a * 3.0 + c * 6.0 + r * 0.3 + o * 15.0) / 1000000"
COSTS = f"costs AS (SELECT l_suppkey % 12 AS suite, {COST} AS b, ((a - l_linenumber) * 3.0 + c * 6.0 + r * 0.3 + o * 12.0) / 1000000 AS o FROM (SELECT *, l_partkey AS a, l_orderkey % 1000 AS c, CAST(trunc(l_extendedprice) AS BIGINT) AS r, CAST(l_quantity AS BIGINT) AS o FROM lineitem))"


def costs(spark, sf):
    li = Ad.table(spark, sf, "lineitem").select(
        (F.col("l_suppkey") % 12).alias("suite"), "l_linenumber", F.col("l_partkey").alias("input_tokens"), (F.col("l_orderkey") % 1000).alias("cache_creation_input_tokens"),
        F.col("l_extendedprice").cast("long").alias("cache_read_input_tokens"), F.col("l_quantity").cast("long").alias("output_tokens"),
    )
    own = F.struct("input_tokens", "cache_creation_input_tokens", "cache_read_input_tokens", "output_tokens")
    less = F.struct(
        (F.col("input_tokens") - F.col("l_linenumber")).alias("input_tokens"), "cache_creation_input_tokens", "cache_read_input_tokens",
        (F.col("output_tokens") * 0.8).alias("output_tokens"),
    )
    return li.select("suite", Bs.claude_cost(own).alias("baseline_usd"), Bs.claude_cost(less).alias("optimized_usd"))


@query("a32_cost_estimate", f"WITH {COSTS} SELECT suite, count(*) AS runs, round(avg(b), 8) AS baseline_mean_usd, round(avg(o), 8) AS optimized_mean_usd, round(-avg(o - b) / avg(b), 8) AS savings_rate FROM costs GROUP BY suite")
def _(spark, sf):
    rows = Bs.cost_estimate(costs(spark, sf), "suite")
    cols = ("baseline_mean_usd", "optimized_mean_usd", "savings_rate")
    return rows.select("suite", "runs", *[F.round(c, 8).alias(c) for c in cols])


LEVELS = ", ".join(f"({q(n)}, {float(v)})" for n, v in Bs.SPEND_LEVELS)


@query("a32_scaled_savings", f"WITH {COSTS}, r AS (SELECT suite, -avg(o - b) / avg(b) AS rate FROM costs GROUP BY suite) SELECT suite, level, round(spend * rate, 6) AS saving_usd FROM r CROSS JOIN (VALUES {LEVELS}) AS l(level, spend)")
def _(spark, sf):
    rows = Bs.scaled_savings(Bs.cost_estimate(costs(spark, sf), "suite"), "suite")
    return rows.select("suite", "level", F.round("saving_usd", 6).alias("saving_usd"))


@query("a32_codex_cost", "SELECT l_orderkey, l_linenumber, round(((a - c) * 1.75 + c * 0.175 + o * 14.0) / 1000000, 9) AS usd FROM (SELECT l_orderkey, l_linenumber, l_partkey AS a, l_suppkey AS c, CAST(l_quantity AS BIGINT) AS o FROM lineitem)")
def _(spark, sf):
    use = F.struct(F.col("l_partkey").alias("input_tokens"), F.col("l_suppkey").alias("cached_input_tokens"), F.col("l_quantity").cast("long").alias("output_tokens"), F.lit(None).cast("long").alias("reasoning_output_tokens"))
    return Ad.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.round(Bs.codex_cost(use), 9).alias("usd"))


@query("a33_tool_use_counts", "SELECT user_id AS log_id, event_type AS tool, count(*) AS uses FROM events WHERE event_type IN ('view', 'click') GROUP BY ALL")
def _(spark, sf):
    return Bs.tool_use_counts(Ad.transcripts_from_events(Ad.table(spark, sf, "events")), "log_id")


@query("a34_last_usage", "SELECT user_id, i AS input_tokens, c AS cached_input_tokens, o AS output_tokens, CAST(0 AS BIGINT) AS reasoning_output_tokens, i - c + o AS total_uncached_plus_output_tokens FROM (SELECT user_id, arg_max(event_id, event_id) AS i, arg_max(event_id // 3, event_id) AS c, arg_max(event_id % 100, event_id) AS o FROM events WHERE event_type = 'purchase' GROUP BY user_id)")
def _(spark, sf):
    e = F.col("event_id")
    rows = Ad.table(spark, sf, "events").select(
        "user_id", e.alias("pos"), F.when(F.col("event_type") == "purchase", "turn.completed").otherwise("item").alias("type"),
        e.alias("input_tokens"), F.floor(e / 3).alias("cached_input_tokens"), (e % 100).alias("output_tokens"), F.lit(None).cast("long").alias("reasoning_output_tokens"),
    )
    return Bs.last_usage(rows, "pos", "user_id")


ERRS = ("failed to load skill x", "invalid_grant then OAuth token refresh failed", "icon path must not contain y", "fine")


@query("a34_stderr_summary", f"SELECT doc_id, CAST((SELECT count(*) FROM (SELECT unnest(string_split(text, chr(10))) AS l) WHERE trim(l) <> '') + 1 AS BIGINT) AS line_count, CAST(CASE WHEN doc_id % 4 = 0 THEN 1 ELSE 0 END AS BIGINT) AS skill_load_errors, CAST(CASE WHEN doc_id % 4 = 1 THEN 2 ELSE 0 END AS BIGINT) AS mcp_auth_errors, CAST(CASE WHEN doc_id % 4 = 2 THEN 1 ELSE 0 END AS BIGINT) AS icon_warnings FROM documents")
def _(spark, sf):
    extra = F.element_at(F.array(*[F.lit(x) for x in ERRS]), (F.col("doc_id") % 4 + 1).cast("int"))
    return Ad.table(spark, sf, "documents").select("doc_id", *Bs.stderr_summary(F.concat("text", F.lit("\n\n"), extra)))


POLICY = "CASE suite_id % 4 WHEN 0 THEN 'research_only' ELSE 'recommendation_evidence' END"


def suites(spark, sf):
    policy = F.when(F.col("suite_id") % 4 == 0, "research_only")
    return Bs.publish_split(gates(spark, sf).withColumn("promotion_policy", policy))


@query("d24_publish_split", f"WITH {GATE} SELECT suite_id, {POLICY} AS promotion_policy, CASE WHEN quality_passed AND completed_repeats >= 3 AND suite_id % 4 <> 0 THEN 'repeated' ELSE 'diagnostic' END AS bucket FROM gate")
def _(spark, sf):
    return suites(spark, sf).select("suite_id", "promotion_policy", "bucket")


@query(
    "j11_d25_artifact_audit",
    f"""WITH {GATE}, s AS (SELECT *, {POLICY} AS pol, CASE WHEN quality_passed AND suite_id % 4 <> 0 THEN 'repeated' ELSE 'diagnostic' END AS bucket FROM gate)
    SELECT suite_id, v AS violation FROM (SELECT suite_id, unnest(list_filter([CASE WHEN suite_id % 11 = 0 THEN 'suite without public report' END, CASE WHEN suite_id % 11 <> 0 AND suite_id % 6 = 0 THEN 'completed_repeats mismatch' END, CASE WHEN suite_id % 11 <> 0 AND suite_id % 9 = 0 THEN 'not in exactly one bucket' END,
      CASE WHEN suite_id % 11 <> 0 AND bucket = 'diagnostic' AND suite_id % 9 <> 0 AND quality_passed AND (completed_repeats + CASE WHEN suite_id % 6 = 0 THEN 1 ELSE 0 END) >= 3 AND pol <> 'research_only' THEN 'diagnostic but promotable' END], lambda x: x IS NOT NULL)) AS v FROM s)""",
)
def _(spark, sf):
    own = suites(spark, sf)
    i = F.col("suite_id")
    fields = ["suite_id", "quality_passed", "required_repeats", "completed_repeats", "promotion_policy"]
    public = own.filter(i % 11 != 0).select(*fields).withColumn("completed_repeats", F.col("completed_repeats") + F.when(i % 6 == 0, 1).otherwise(0))
    artifacts = own.filter(i % 9 != 0).select("suite_id", "bucket")
    return Bs.suite_violations(own.select(*fields), public, artifacts)
