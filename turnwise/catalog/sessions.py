"""Session folds, findings, savings, merging (A, W, D operators on events and conversations)."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnwise.catalog import query
from turnwise.functions import buckets as B
from turnwise.operators import blocks
from turnwise.operators import findings as Fd
from turnwise.operators import merge as M
from turnwise.operators import sessions as Se
from turnwise.plans import adapters as Ad
from turnwise.plans.analyze import merged_reports


def ev_turns(spark, sf):
    return Ad.turns_from_events(Ad.table(spark, sf, "events"))


def ev_metrics(spark, sf):
    turns = ev_turns(spark, sf)
    return Se.session_metrics(turns, reads=Ad.reads_from_events(turns))


def ev_calls(spark, sf):
    return Ad.calls_from_events(ev_turns(spark, sf))


def ev_reports(spark, sf):
    """Reconciled counters of each user's session; no exposure is known."""
    both = Se.reconcile(ev_metrics(spark, sf), Se.session_signals(ev_calls(spark, sf)))
    return both.withColumn("mcp_band", F.lit("unknown")).withColumn("skill_band", F.lit("unknown"))


def rated(spark, sf):
    return Fd.with_savings(Fd.with_findings(ev_reports(spark, sf)))


# The same session in SQL: one row per turn.
T = """t AS (SELECT user_id AS log_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS turn, event_id, ts, event_type, props,
  event_type IN ('click', 'view') AS is_tool, event_type = 'error' AS is_error, CAST(floor(value * 100) AS BIGINT) AS tokens, 'file' || json_extract_string(props, '$.k') AS file FROM events)"""
READS = "reads AS (SELECT log_id, turn, file FROM t WHERE event_type = 'view')"
RETRY = """retry AS (SELECT log_id, max(run) AS retry_depth_max FROM (SELECT log_id, sum(CASE WHEN is_error THEN 1 ELSE 0 END) OVER (PARTITION BY log_id, g ORDER BY turn) AS run
  FROM (SELECT *, sum(CASE WHEN NOT is_error AND NOT is_tool THEN 1 ELSE 0 END) OVER (PARTITION BY log_id ORDER BY turn) AS g FROM t)) GROUP BY log_id)"""
CUM = """cum AS (SELECT log_id, turn, sum(tokens) OVER w AS estimated_tokens, sum(CASE WHEN is_tool THEN tokens ELSE 0 END) OVER w AS tool_tokens,
  sum(CASE WHEN is_error THEN 1 ELSE 0 END) OVER w AS retries, sum(rr) OVER w AS rereads, max(turn) OVER (PARTITION BY log_id) AS last
  FROM (SELECT t.*, CASE WHEN event_type = 'view' AND row_number() OVER (PARTITION BY log_id, event_type, file ORDER BY turn) > 1 THEN 1 ELSE 0 END AS rr FROM t)
  WINDOW w AS (PARTITION BY log_id ORDER BY turn))"""
SAMPLED = "sampled AS (SELECT * FROM cum WHERE turn % 10 = 0 OR turn = last)"
GROWTH = """growth AS (SELECT log_id, sum(CASE WHEN d > 6000 THEN 1 ELSE 0 END) AS context_growth_events FROM (SELECT log_id, estimated_tokens - lag(estimated_tokens) OVER (PARTITION BY log_id ORDER BY turn) AS d FROM sampled) GROUP BY log_id)"""
RR = "rr AS (SELECT log_id, sum(n - 1) AS rereads FROM (SELECT log_id, file, count(*) AS n FROM reads GROUP BY ALL) GROUP BY log_id)"
METRICS = f"""{T}, {READS}, {RETRY}, {CUM}, {SAMPLED}, {GROWTH}, {RR}, metrics AS (SELECT log_id, count(*) AS turns, CAST(sum(tokens) AS BIGINT) AS estimated_tokens,
  CAST(sum(CASE WHEN is_tool THEN tokens ELSE 0 END) AS BIGINT) AS tool_output_tokens, CAST(sum(CASE WHEN is_error THEN 1 ELSE 0 END) AS BIGINT) AS failed_commands,
  CAST(any_value(retry_depth_max) AS BIGINT) AS retry_depth_max, CAST(any_value(context_growth_events) AS BIGINT) AS context_growth_events, CAST(coalesce(any_value(rr.rereads), 0) AS BIGINT) AS rereads
  FROM t LEFT JOIN retry USING (log_id) LEFT JOIN growth USING (log_id) LEFT JOIN rr USING (log_id) GROUP BY log_id)"""
CALLS = """calls AS (SELECT log_id, turn - 1 AS pos, CASE WHEN is_tool THEN 'tool_call' WHEN event_type = 'purchase' THEN 'tool_result' ELSE 'message' END AS kind,
  CASE WHEN is_tool THEN event_type ELSE '' END AS tool, CASE WHEN is_tool THEN CAST((turn - 1) // 4 AS VARCHAR) ELSE '' END AS args,
  tokens AS tok_in, tokens // 3 AS tok_cached, CASE WHEN event_type = 'signup' THEN tokens * 10 ELSE 0 END AS tok_new, tokens // 5 AS tok_out, strlen(props) AS out_bytes, is_error AS error FROM t)"""
SEG = """seg AS (SELECT *, sum(CASE WHEN kind = 'tool_call' THEN 1 ELSE 0 END) OVER (PARTITION BY log_id ORDER BY pos) AS c FROM calls),
 failed AS (SELECT log_id, c, max(CASE WHEN kind = 'tool_call' THEN tool END) AS tool, max(CASE WHEN kind = 'tool_call' THEN args END) AS args, bool_or(error) AS failed FROM seg WHERE c > 0 GROUP BY log_id, c)"""
LOOPS = """prev AS (SELECT *, coalesce(tool = lag(tool) OVER w AND args = lag(args) OVER w AND lag(failed) OVER w, false) AS retry FROM failed WINDOW w AS (PARTITION BY log_id ORDER BY c)),
 loops AS (SELECT log_id, max(run) AS args_hashed_retry_loops FROM (SELECT log_id, sum(CASE WHEN retry THEN 1 ELSE 0 END) OVER (PARTITION BY log_id, g ORDER BY c) AS run
  FROM (SELECT *, sum(CASE WHEN retry THEN 0 ELSE 1 END) OVER (PARTITION BY log_id ORDER BY c) AS g FROM prev)) GROUP BY log_id)"""
SIGSUMS = """sums AS (SELECT log_id, count(*) AS normalized_event_count, sum(CASE WHEN kind = 'tool_call' THEN 1 ELSE 0 END) AS tool_call_count, sum(CASE WHEN kind = 'tool_result' THEN 1 ELSE 0 END) AS tool_result_count,
  sum(CASE WHEN tok_new >= 8000 THEN 1 ELSE 0 END) AS cache_invalidation_events, sum(tok_cached) AS cache_read_tokens, sum(tok_new) AS cache_creation_tokens, sum(tok_in) AS input_tokens, sum(tok_out) AS output_tokens, sum(out_bytes) AS tool_output_bytes FROM calls GROUP BY log_id),
 signals AS (SELECT sums.*, coalesce(args_hashed_retry_loops, 0) AS args_hashed_retry_loops, CASE WHEN input_tokens > 0 THEN CAST(trunc(least(100, greatest(0, input_tokens - cache_read_tokens) / input_tokens * 100)) AS BIGINT) ELSE 0 END AS cache_miss_ratio_pct FROM sums LEFT JOIN loops USING (log_id))"""
BOTH = """both_ AS (SELECT log_id, turns, greatest(estimated_tokens, input_tokens + output_tokens) AS estimated_tokens, greatest(tool_output_tokens, greatest(1, tool_output_bytes // 4)) AS tool_output_tokens, failed_commands, rereads,
  greatest(retry_depth_max, args_hashed_retry_loops) AS retry_depth_max, context_growth_events + cache_invalidation_events AS context_growth_events, args_hashed_retry_loops, cache_invalidation_events, cache_creation_tokens, cache_read_tokens, input_tokens, output_tokens, normalized_event_count, tool_call_count, tool_result_count, tool_output_bytes, cache_miss_ratio_pct
  FROM metrics JOIN signals USING (log_id))"""
REPORTS = f"{METRICS}, {CALLS}, {SEG}, {LOOPS}, {SIGSUMS}, {BOTH}"


def findings_sql(source: str, key: str, high_rereads: int = 10) -> str:
    share = "CASE WHEN tool_output_tokens > 0 AND estimated_tokens > 0 THEN CAST(trunc(tool_output_tokens / estimated_tokens * 100) AS BIGINT) ELSE 0 END"
    rules = (
        ("repeated_file_reads", "rereads", 3, high_rereads, False),
        ("tool_output_bloat", share, 35, 55, True),
        ("retry_loop", "retry_depth_max", 3, 6, False),
        ("context_growth_spikes", "context_growth_events", 2, 5, False),
        ("args_hashed_retry_loop", "args_hashed_retry_loops", 2, 5, False),
        ("cache_invalidation_spike", "cache_invalidation_events", 1, 3, False),
    )
    return " UNION ALL ".join(
        f"SELECT {key}, '{i}' AS finding_id, CASE WHEN {v} >= {hi} THEN 'high' ELSE 'medium' END AS severity, CAST({'0' if is_share else v} AS BIGINT) AS count, CAST({v if is_share else '0'} AS BIGINT) AS token_share_pct FROM {source} WHERE {v} >= {lo}"
        for i, v, lo, hi, is_share in rules
    )


def _capture(i: int) -> str:
    return "CASE finding_id " + " ".join(f"WHEN '{k}' THEN {v[i]}" for k, v in Fd.CAPTURE.items()) + " END"


def savings_sql(source: str, key: str, found: str) -> str:
    per = "CASE finding_id " + " ".join(f"WHEN '{k}' THEN least(greatest(count, 1) * {a}, {b})" for k, (a, b) in Fd.PER_COUNT.items()) + " ELSE 10 END"
    return f"""est AS (SELECT {key}, finding_id, total, CASE WHEN token_share_pct > 0 THEN least(total * token_share_pct // 100, total) WHEN finding_id = 'cache_invalidation_spike' AND cache_creation_tokens > 0 THEN least(cache_creation_tokens, total) ELSE least(total * greatest({per}, 3) // 100, total) END AS gross
      FROM (SELECT *, estimated_tokens AS total FROM {found} JOIN {source} USING ({key}))),
     priced AS (SELECT *, gross * ({_capture(0)}) // 100 AS lo, greatest(gross * ({_capture(1)}) // 100, 1) AS hi FROM est WHERE gross > 0 AND total > 0),
     tot AS (SELECT {key}, any_value(total) AS total, sum(lo) AS lo, sum(hi) AS hi, greatest(any_value(total) * 65 // 100, 1) AS cap FROM priced GROUP BY {key}),
     capped AS (SELECT {key}, total, CASE WHEN hi > cap THEN lo * cap // hi ELSE least(lo, hi) END AS lo, least(hi, cap) AS hi, hi AS raw, cap FROM tot),
     pct AS (SELECT {key}, lo, hi, CASE WHEN lo <= 0 THEN 0 ELSE least(100, (lo * 100 + total // 2) // total) END AS pl, CASE WHEN hi <= 0 THEN 0 ELSE least(100, (hi * 100 + total // 2) // total) END AS ph FROM capped)"""


FOUND = f"found AS ({findings_sql('both_', 'log_id')})"
SAVED = savings_sql("both_", "log_id", "found")
COUNTS = ("turns", "estimated_tokens", "tool_output_tokens", "failed_commands", "retry_depth_max", "context_growth_events", "rereads")


@query("a01_session_metrics", f"WITH {METRICS} SELECT * FROM metrics")
def _(spark, sf):
    return ev_metrics(spark, sf)


@query(
    "a01_conversation_metrics",
    "SELECT conv_id AS log_id, count(*) AS turns, CAST(sum(greatest(1, strlen(text) // 4)) AS BIGINT) AS estimated_tokens, CAST(sum(CASE WHEN role = 'tool' THEN greatest(1, strlen(text) // 4) ELSE 0 END) AS BIGINT) AS tool_output_tokens, CAST(sum(CASE WHEN regexp_matches(lower(text), 'error|failed|traceback') THEN 1 ELSE 0 END) AS BIGINT) AS failed_commands FROM conversations GROUP BY conv_id",
)
def _(spark, sf):
    turns = Ad.turns_from_conversations(Ad.table(spark, sf, "conversations"))
    return Se.session_metrics(turns).select("log_id", "turns", "estimated_tokens", "tool_output_tokens", "failed_commands")


@query("a02_rereads", f"WITH {T}, {READS}, {RR} SELECT log_id, CAST(rereads AS BIGINT) AS rereads FROM rr")
def _(spark, sf):
    return Se.reread_counts(Ad.reads_from_events(ev_turns(spark, sf)))


@query(
    "a03_top_reread_files",
    f"WITH {T}, {READS} SELECT log_id, file, n AS reads, rank FROM (SELECT log_id, file, count(*) AS n, row_number() OVER (PARTITION BY log_id ORDER BY count(*) DESC, file) AS rank FROM reads GROUP BY log_id, file HAVING count(*) > 1) WHERE rank <= 5",
)
def _(spark, sf):
    return Se.top_reread_files(Ad.reads_from_events(ev_turns(spark, sf)))


SIGNAL_COLS = "normalized_event_count, tool_call_count, tool_result_count, cache_invalidation_events, cache_read_tokens, cache_creation_tokens, input_tokens, output_tokens, tool_output_bytes, cache_miss_ratio_pct".split(", ")


def as_bigint(cols, key="log_id"):
    return f"SELECT {key}, " + ", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in cols)


@query("a04_signal_sums", f"WITH {T}, {CALLS}, {SEG}, {LOOPS}, {SIGSUMS} {as_bigint(SIGNAL_COLS)} FROM signals")
def _(spark, sf):
    return Se.signal_sums(ev_calls(spark, sf), "log_id").select("log_id", *SIGNAL_COLS)


@query(
    "a05_cache_miss_ratio",
    "SELECT l_orderkey, l_linenumber, CAST(CASE WHEN i > 0 THEN trunc(least(100, greatest(0, i - c) / i * 100)) ELSE 0 END AS BIGINT) AS miss_pct FROM (SELECT l_orderkey, l_linenumber, l_partkey % 97 AS i, CAST(l_quantity AS BIGINT) AS c FROM lineitem)",
)
def _(spark, sf):
    return Ad.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber",
        B.cache_miss_pct(F.col("l_partkey") % 97, F.col("l_quantity").cast("long")).alias("miss_pct"),
    )


@query(
    "a06_sample_confidence",
    "SELECT role, CASE WHEN s < 3 OR e < 20 THEN 'low' WHEN s < 10 THEN 'medium' ELSE 'high' END AS confidence, concat_ws(',', CASE WHEN s < 3 THEN 'fewer_than_3_sessions' WHEN s < 10 THEN 'fewer_than_10_sessions' END, CASE WHEN e < 20 THEN 'thin_event_sample' END) AS warnings FROM (SELECT role || turn AS role, count(DISTINCT conv_id) AS s, count(*) AS e FROM conversations GROUP BY 1)",
)
def _(spark, sf):
    rows = (
        Ad.table(spark, sf, "conversations")
        .groupBy(F.concat("role", F.col("turn").cast("string")).alias("role"))
        .agg(F.count_distinct("conv_id").alias("s"), F.count(F.lit(1)).alias("e"))
    )
    s, e = F.col("s"), F.col("e")
    return rows.select(
        "role", B.sample_confidence(s, e).alias("confidence"), F.concat_ws(",", B.sample_warnings(s, e)).alias("warnings")
    )


@query("w01_timeline", f"WITH {T}, {CUM}, {SAMPLED} SELECT log_id, turn, CAST(estimated_tokens AS BIGINT) AS estimated_tokens, CAST(tool_tokens AS BIGINT) AS tool_tokens, CAST(rereads AS BIGINT) AS rereads, CAST(retries AS BIGINT) AS retries FROM sampled")
def _(spark, sf):
    turns = ev_turns(spark, sf)
    return Se.timeline(turns, reads=Ad.reads_from_events(turns))


@query("w02_context_growth", f"WITH {T}, {CUM}, {SAMPLED}, {GROWTH} SELECT log_id, CAST(context_growth_events AS BIGINT) AS context_growth_events FROM growth")
def _(spark, sf):
    return Se.context_growth(ev_turns(spark, sf))


@query("w03_retry_depth", f"WITH {T}, {RETRY} SELECT log_id, CAST(retry_depth_max AS BIGINT) AS retry_depth_max FROM retry")
def _(spark, sf):
    return Se.retry_depth(ev_turns(spark, sf))


@query("w03_retry_depth_small_blocks", f"WITH {T}, {RETRY} SELECT log_id, CAST(retry_depth_max AS BIGINT) AS retry_depth_max FROM retry")
def _(spark, sf):
    """The same fold with blocks of 7 turns and sessions above 80 rows numbered in ranges, as a very long session has."""
    turns = Ad.turns_from_events(Ad.table(spark, sf, "events"), max_rows=80)
    return Se.retry_depth(turns, rows_per_block=7)


@query("w04_failed_calls", f"WITH {T}, {CALLS}, {SEG} SELECT log_id, CAST(c - 1 AS BIGINT) AS call_seq, tool, failed FROM failed")
def _(spark, sf):
    return Se.tool_calls(ev_calls(spark, sf)).select("log_id", "call_seq", "tool", "failed")


@query("w05_identical_retries", f"WITH {T}, {CALLS}, {SEG}, {LOOPS} SELECT log_id, CAST(args_hashed_retry_loops AS BIGINT) AS args_hashed_retry_loops FROM loops")
def _(spark, sf):
    return Se.identical_retries(ev_calls(spark, sf))


SRC = "log_id % 5 AS source_id"


@query(
    "w06_combined_timeline",
    f"""WITH {METRICS}, m AS (SELECT *, {SRC} FROM metrics), o AS (SELECT log_id, source_id, {', '.join(f"coalesce(sum({c}) OVER w, 0) AS o_{c}" for c in ('turns', 'estimated_tokens', 'tool_output_tokens', 'rereads', 'failed_commands'))} FROM m WINDOW w AS (PARTITION BY source_id ORDER BY log_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT source_id, log_id, CAST(turn + o_turns AS BIGINT) AS turn, CAST(s.estimated_tokens + o_estimated_tokens AS BIGINT) AS estimated_tokens, CAST(tool_tokens + o_tool_output_tokens AS BIGINT) AS tool_tokens, CAST(s.rereads + o_rereads AS BIGINT) AS rereads, CAST(retries + o_failed_commands AS BIGINT) AS retries FROM sampled s JOIN o USING (log_id)""",
)
def _(spark, sf):
    turns = ev_turns(spark, sf)
    reads = Ad.reads_from_events(turns)
    metrics = Se.session_metrics(turns, reads=reads).withColumn("source_id", F.col("log_id") % 5)
    return Se.combined_timeline(Se.timeline(turns, reads=reads), metrics, "source_id", "log_id", ["log_id"])


@query(
    "w08_latest_event",
    "SELECT user_id, event_type AS latest_event_type, value AS latest_value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1",
)
def _(spark, sf):
    from turnwise.operators.funnel import latest_per_key

    rows = latest_per_key(Ad.table(spark, sf, "events"), "user_id", "ts", "event_id", "event_type", "value")
    return rows.select("user_id", "latest_event_type", "latest_value")


@query(
    "w09_recency_rank",
    "SELECT o_orderpriority, o_orderkey, rank FROM (SELECT o_orderpriority, o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice * exp(-(epoch(newest) - epoch(o_orderdate)) / 1209600.0) DESC, o_orderdate DESC, o_totalprice DESC, o_orderkey DESC) AS rank FROM (SELECT *, max(o_orderdate) OVER (PARTITION BY o_orderpriority) AS newest FROM orders)) WHERE rank <= 40",
)
def _(spark, sf):
    ranked = Se.recency_rank(Ad.table(spark, sf, "orders"), "o_orderpriority", "o_orderdate", "o_totalprice", "o_orderkey", 40)
    return ranked.select("o_orderpriority", "o_orderkey", "rank")


@query("w10_log_ordinals", "SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS ordinal FROM documents")
def _(spark, sf):
    return Se.log_refs(Ad.table(spark, sf, "documents").select("doc_id", "source"), "source", ["doc_id"])


@query(
    "w11_downsample",
    "WITH s AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, count(*) OVER (PARTITION BY user_id) AS n FROM events), i AS (SELECT user_id, unnest(range(60)) AS i, any_value(n) AS n FROM s GROUP BY user_id) SELECT user_id, event_id, pos FROM s WHERE n <= 60 OR EXISTS (SELECT 1 FROM i WHERE i.user_id = s.user_id AND (i.i * (i.n - 1)) // 59 = s.pos)",
)
def _(spark, sf):
    numbered = blocks.dense_position(Ad.table(spark, sf, "events").select("user_id", "event_id", "ts"), "user_id", ["ts", "event_id"])
    return Se.downsample(numbered, "user_id", "pos").select("user_id", "event_id", "pos")


BOTH_COLS = COUNTS + ("args_hashed_retry_loops", "cache_invalidation_events", "cache_miss_ratio_pct")


@query("a42_reconciled_metrics", f"WITH {REPORTS} {as_bigint(BOTH_COLS)} FROM both_")
def _(spark, sf):
    return ev_reports(spark, sf).select("log_id", *BOTH_COLS)


@query("d08_findings", f"WITH {REPORTS}, {FOUND} SELECT * FROM found")
def _(spark, sf):
    rows = Fd.with_findings(ev_reports(spark, sf))
    return rows.select("log_id", F.inline("findings")).select("log_id", "finding_id", "severity", "count", "token_share_pct")


@query(
    "d11_savings",
    f"WITH {REPORTS}, {FOUND}, {SAVED} SELECT log_id, finding_id, CAST(gross AS BIGINT) AS gross_tokens, CAST(CASE WHEN raw > cap THEN p.lo * cap // raw ELSE p.lo END AS BIGINT) AS potential_tokens_low, CAST(CASE WHEN raw > cap THEN p.hi * cap // raw ELSE p.hi END AS BIGINT) AS potential_tokens_high FROM priced p JOIN capped USING (log_id)",
)
def _(spark, sf):
    return rated(spark, sf).select("log_id", F.inline("finding_estimates")).select(
        "log_id", "finding_id", "gross_tokens", "potential_tokens_low", "potential_tokens_high"
    )


@query(
    "d12_session_scores",
    f"WITH {REPORTS}, {FOUND}, {SAVED} SELECT log_id, CAST(100 - coalesce(ph, 0) AS BIGINT) AS score, CAST(coalesce(pl, 0) AS BIGINT) AS waste_low, CAST(coalesce(ph, 0) AS BIGINT) AS waste_high, CAST(coalesce(lo, 0) AS BIGINT) AS potential_tokens_low, CAST(coalesce(hi, 0) AS BIGINT) AS potential_tokens_high, n AS findings FROM both_ LEFT JOIN pct USING (log_id) LEFT JOIN (SELECT log_id, count(*) AS n FROM found GROUP BY log_id) USING (log_id)",
)
def _(spark, sf):
    return rated(spark, sf).select(
        "log_id", "score", "waste_low", "waste_high", "potential_tokens_low", "potential_tokens_high",
        F.nullif(F.size("findings"), F.lit(0)).cast("long").alias("findings"),
    )


@query(
    "d13_representative_tokens",
    f"WITH {REPORTS}, {FOUND}, {SAVED} SELECT log_id, finding_id, CAST(CASE WHEN raw > cap THEN p.hi * cap // raw ELSE p.hi END AS BIGINT) AS tokens FROM priced p JOIN capped USING (log_id) WHERE p.hi > 0",
)
def _(spark, sf):
    rows = rated(spark, sf)
    shown = F.transform("findings", lambda f: F.struct(f["finding_id"].alias("finding_id"), Fd.representative_tokens(f).alias("tokens")))
    return rows.select("log_id", F.inline(shown))


ORDER = {k: i for i, k in enumerate(Fd.CAPTURE)}
FIXES = {"repeated_file_reads": Fd.REREAD_FIX, "tool_output_bloat": Fd.TOOL_FIX, "retry_loop": Fd.RETRY_FIX, "context_growth_spikes": Fd.GROWTH_FIX, "args_hashed_retry_loop": Fd.ARGS_FIX, "cache_invalidation_spike": Fd.CACHE_FIX}


@query(
    "d27_immediate_fixes",
    f"WITH {REPORTS}, {FOUND} SELECT log_id, coalesce(string_agg(CASE finding_id " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in FIXES.items())
    + " END, '|' ORDER BY CASE finding_id " + " ".join(f"WHEN '{k}' THEN {i}" for k, i in ORDER.items()) + f" END), '{Fd.DEFAULT_FIX}') AS fixes FROM both_ LEFT JOIN found USING (log_id) GROUP BY log_id",
)
def _(spark, sf):
    return Fd.with_findings(ev_reports(spark, sf)).select("log_id", F.array_join(Fd.immediate_fixes(), "|").alias("fixes"))


MERGED = f"""merged AS (SELECT {SRC}, count(*) AS session_count, {', '.join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in M.SUMMED)}, CAST(max(retry_depth_max) AS BIGINT) AS retry_depth_max,
  {', '.join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in ('cache_read_tokens', 'cache_creation_tokens', 'input_tokens', 'output_tokens', 'cache_invalidation_events', 'normalized_event_count', 'tool_call_count', 'tool_result_count', 'tool_output_bytes'))}, CAST(max(args_hashed_retry_loops) AS BIGINT) AS args_hashed_retry_loops FROM both_ GROUP BY 1)"""


def by_source(spark, sf):
    return ev_reports(spark, sf).withColumn("source_id", F.col("log_id") % 5)


@query("a07_merged_metrics", f"WITH {REPORTS}, {MERGED} SELECT source_id, session_count, {', '.join(M.SUMMED)}, retry_depth_max FROM merged")
def _(spark, sf):
    return M.merge_metrics(by_source(spark, sf), "source_id")


@query(
    "a08_merged_signals",
    f"WITH {REPORTS}, {MERGED} SELECT source_id, input_tokens, cache_read_tokens, args_hashed_retry_loops, CAST(trunc(least(100, greatest(0, input_tokens - cache_read_tokens) / input_tokens * 100)) AS BIGINT) AS cache_miss_ratio_pct, CASE WHEN session_count < 3 OR normalized_event_count < 20 THEN 'low' WHEN session_count < 10 THEN 'medium' ELSE 'high' END AS sample_confidence, 'low' AS weakest_confidence FROM merged",
)
def _(spark, sf):
    return M.merge_signals(by_source(spark, sf), "source_id").select(
        "source_id", "input_tokens", "cache_read_tokens", "args_hashed_retry_loops", "cache_miss_ratio_pct", "sample_confidence", "weakest_confidence"
    )


@query("d09_merged_findings", f"WITH {REPORTS}, {MERGED} {findings_sql('merged', 'source_id', 25)}")
def _(spark, sf):
    rows = merged_reports(by_source(spark, sf), "source_id")
    return rows.select("source_id", F.inline("findings")).select("source_id", "finding_id", "severity", "count", "token_share_pct")


@query(
    "a13_source_reports",
    f"WITH {REPORTS}, {MERGED}, found AS ({findings_sql('merged', 'source_id', 25)}), {savings_sql('merged', 'source_id', 'found')} SELECT source_id, session_count, turns, CAST(100 - ph AS BIGINT) AS score, CAST(pl AS BIGINT) AS waste_low, CAST(ph AS BIGINT) AS waste_high FROM merged JOIN pct USING (source_id)",
)
def _(spark, sf):
    return merged_reports(by_source(spark, sf), "source_id").select("source_id", "session_count", "turns", "score", "waste_low", "waste_high")


@query(
    "a35_smoke_summary",
    f"WITH {REPORTS}, {FOUND}, {SAVED} SELECT count(*) AS analyzed, CAST(min(s) AS BIGINT) AS score_min, CAST(max(s) AS BIGINT) AS score_max, CAST(sum(s) // count(*) AS BIGINT) AS score_avg FROM (SELECT 100 - coalesce(ph, 0) AS s FROM both_ LEFT JOIN pct USING (log_id))",
)
def _(spark, sf):
    from turnwise.operators.selection import smoke_summary

    return smoke_summary(rated(spark, sf))


PERMILLE = {m: c for m, c in Fd.RECEIPT_METRICS}


def receipts_sql(where: str, name: str) -> str:
    spent = "input_tokens + cache_creation_tokens + output_tokens"
    rows = " UNION ALL ".join(
        f"SELECT log_id % 5 AS source_id, '{m}' AS metric_id, CAST(trunc(CAST(sum({spent if c == 'uncached_plus_output_tokens' else c}) AS DOUBLE) / sum(turns) * 1000) AS BIGINT) AS permille FROM both_ WHERE {where} GROUP BY 1"
        for m, c in PERMILLE.items()
    )
    return f"{name} AS ({rows})"


def halves(spark, sf):
    reports = by_source(spark, sf)
    sums = [*M.SUMMED, "input_tokens", "output_tokens", "cache_creation_tokens"]

    def side(parity):
        return reports.filter(F.col("log_id") % 2 == parity).groupBy("source_id").agg(
            F.count(F.lit(1)).alias("log_count"), *[F.sum(c).alias(c) for c in sums]
        )

    return side(0), side(1)


@query("a16_per_turn_metrics", f"WITH {REPORTS}, {receipts_sql('log_id % 2 = 0', 'base')} SELECT * FROM base")
def _(spark, sf):
    return Fd.receipt_metrics(halves(spark, sf)[0], "source_id")


DELTAS = f"{receipts_sql('log_id % 2 = 0', 'base')}, {receipts_sql('log_id % 2 = 1', 'cur')}, deltas AS (SELECT source_id, metric_id, b.permille AS baseline_permille, c.permille AS current_permille, c.permille - b.permille AS delta_permille, CAST(CASE WHEN b.permille = 0 THEN 0 ELSE trunc(CAST(c.permille - b.permille AS DOUBLE) / b.permille * 100) END AS BIGINT) AS delta_pct, c.permille < b.permille AS improved FROM base b JOIN cur c USING (source_id, metric_id))"


@query("j13_metric_deltas", f"WITH {REPORTS}, {DELTAS} SELECT * FROM deltas")
def _(spark, sf):
    base, current = halves(spark, sf)
    return Fd.metric_deltas(Fd.receipt_metrics(base, "source_id"), Fd.receipt_metrics(current, "source_id"), "source_id")


@query(
    "d19_savings_validation",
    f"""WITH {REPORTS}, {DELTAS}, k AS (SELECT log_id % 5 AS source_id, count(*) FILTER (log_id % 2 = 0) AS bl, count(*) FILTER (log_id % 2 = 1) AS cl, sum(turns) FILTER (log_id % 2 = 0) AS bt, sum(turns) FILTER (log_id % 2 = 1) AS ct FROM both_ GROUP BY 1),
    d AS (SELECT source_id, sum(CASE WHEN improved THEN 1 ELSE 0 END) AS n, bool_or(improved AND metric_id IN ('uncached_plus_output_per_turn', 'tool_output_tokens_per_turn')) AS moved FROM deltas GROUP BY 1)
    SELECT source_id, CAST(n AS BIGINT) AS improved_count, (source_id = 1 AND moved) AS direct_receipt_agreement, CASE WHEN source_id = 1 AND moved THEN 'verified' WHEN n >= 2 AND NOT (ct / bt < 0.5 OR ct / bt > 2) AND source_id <> 2 THEN 'observed' ELSE 'inconclusive' END AS evidence_tier,
    concat_ws(',', CASE WHEN bl < 3 OR cl < 3 THEN 'small_log_sample' END, CASE WHEN source_id = 2 THEN 'source_mix_changed' END, CASE WHEN ct / bt < 0.5 OR ct / bt > 2 THEN 'workload_volume_changed' END) AS warnings FROM d JOIN k USING (source_id)""",
)
def _(spark, sf):
    base, current = halves(spark, sf)
    deltas = Fd.metric_deltas(Fd.receipt_metrics(base, "source_id"), Fd.receipt_metrics(current, "source_id"), "source_id")
    base = base.withColumn("source_mix", F.lit("events"))
    current = current.withColumn(
        "source_mix", F.when(F.col("source_id") == 2, "events,orders").otherwise("events")
    ).withColumn("receipt_savings", F.col("source_id") == 1)
    out = Fd.validate_savings(deltas, base, current, "source_id")
    return out.select("source_id", "improved_count", "direct_receipt_agreement", "evidence_tier", F.array_join("warnings", ",").alias("warnings"))


STATS_SQL = "(SELECT l_suppkey % 9 AS tool, l_shipdate AS updated_at, CAST(l_quantity AS BIGINT) - 3 AS total_calls, l_partkey - 50 AS tokens_saved, CAST(trunc(l_extendedprice) AS BIGINT) AS total_processed, CAST(trunc(l_extendedprice * (0.2 + l_discount)) AS BIGINT) AS bytes_returned FROM lineitem)"


@query(
    "a17_reducer_receipts",
    f"SELECT tool, calls, tokens_saved, processed_bytes, returned_bytes, CAST(CASE WHEN processed_bytes > 0 THEN least(greatest(trunc(CAST(processed_bytes - returned_bytes AS DOUBLE) / processed_bytes * 100), 0), 100) ELSE 0 END AS BIGINT) AS reduction_pct FROM (SELECT tool, CAST(sum(greatest(total_calls, 0)) AS BIGINT) AS calls, CAST(sum(greatest(tokens_saved, 0)) AS BIGINT) AS tokens_saved, CAST(sum(greatest(total_processed, 0)) AS BIGINT) AS processed_bytes, CAST(sum(greatest(bytes_returned, 0)) AS BIGINT) AS returned_bytes FROM {STATS_SQL} WHERE updated_at > TIMESTAMP '1998-01-01' AND (total_calls > 0 OR tokens_saved > 0) GROUP BY tool)",
)
def _(spark, sf):
    li = Ad.table(spark, sf, "lineitem")
    stats = li.select(
        (F.col("l_suppkey") % 9).alias("tool"),
        F.col("l_shipdate").alias("updated_at"),
        (F.col("l_quantity").cast("long") - 3).alias("total_calls"),
        (F.col("l_partkey") - 50).alias("tokens_saved"),
        F.col("l_extendedprice").cast("long").alias("total_processed"),
        (F.col("l_extendedprice") * (F.lit(0.2) + F.col("l_discount"))).cast("long").alias("bytes_returned"),
    )
    return Fd.reducer_receipt(stats, F.lit("1998-01-01").cast("timestamp_ntz"), "tool")


@query(
    "a18_normalized_receipts",
    "SELECT p_partkey, tool_id, source AS receipt_source, CAST(least(greatest(pct, 0), 100) AS BIGINT) AS reduction_pct FROM (SELECT p_partkey, CASE WHEN p_partkey % 10 = 0 THEN '' ELSE p_brand END AS tool_id, CASE WHEN p_partkey % 3 = 0 THEN 'local_receipt' ELSE p_type END AS source, p_size - 5 AS calls, p_partkey - 20 AS tokens_saved, p_size * 5 - 40 AS pct FROM part) WHERE tool_id <> '' AND calls >= 0 AND tokens_saved >= 0",
)
def _(spark, sf):
    part = Ad.table(spark, sf, "part")
    k = F.col("p_partkey")
    rows = part.select(
        "p_partkey",
        F.when(k % 10 == 0, "").otherwise(F.col("p_brand")).alias("tool_id"),
        F.when(k % 3 == 0, "").otherwise(F.col("p_type")).alias("receipt_source"),
        (F.col("p_size") - 5).alias("calls"),
        (k - 20).alias("tokens_saved"),
        (F.col("p_size") * 5 - 40).alias("reduction_pct"),
    )
    return Fd.normalize_receipts(rows).select("p_partkey", "tool_id", "receipt_source", "reduction_pct")


LOGS_SQL = "(SELECT o_orderpriority AS grp, o_orderstatus AS source_id, o_orderdate AS mod_time, CAST(trunc(o_totalprice * 10) AS BIGINT) AS size_bytes FROM orders)"
SIZE_SQL = "CASE WHEN b <= 0 THEN 'unknown' WHEN b < 10240 THEN '<10 KB' WHEN b < 102400 THEN '10-100 KB' WHEN b < 1048576 THEN '100 KB-1 MB' WHEN b < 5242880 THEN '1-5 MB' ELSE '>5 MB' END".replace("b ", "size_bytes ")


def order_logs(spark, sf):
    return Ad.table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("grp"),
        F.col("o_orderstatus").alias("source_id"),
        F.col("o_orderdate").alias("mod_time"),
        (F.col("o_totalprice") * 10).cast("long").alias("size_bytes"),
        F.col("o_orderkey").cast("string").alias("path"),
    )


@query(
    "a14_baseline_window",
    f"SELECT grp, strftime(min(mod_time), '%Y-%m-%d') AS first_day, strftime(max(mod_time), '%Y-%m-%d') AS last_day, count(*) AS log_count, count(DISTINCT source_id) AS source_count, string_agg(DISTINCT {SIZE_SQL}, ',' ORDER BY {SIZE_SQL}) AS size_buckets, '30d+' AS duration_bucket FROM {LOGS_SQL} GROUP BY grp",
)
def _(spark, sf):
    rows = M.baseline_window(order_logs(spark, sf), "grp")
    return rows.select(
        "grp", F.date_format("window_start", "yyyy-MM-dd").alias("first_day"), F.date_format("window_end", "yyyy-MM-dd").alias("last_day"),
        "log_count", "source_count", "size_buckets", "duration_bucket",
    )


@query("a15_source_mix", "SELECT source AS source_id, count(*) AS log_count FROM documents GROUP BY source")
def _(spark, sf):
    return M.source_mix(Ad.logs_from_documents(Ad.table(spark, sf, "documents")))


@query("a15_mix_signature", "SELECT lang, string_agg(DISTINCT source, ',' ORDER BY source) AS source_mix FROM documents GROUP BY lang")
def _(spark, sf):
    docs = Ad.table(spark, sf, "documents").select("lang", F.col("source").alias("source_id"))
    return M.mix_signature(docs, "lang")


BANDS = ("unknown", "normal", "watch", "high", "severe")


@query(
    "a11_ranked_labels",
    """SELECT user_id, ['unknown','normal','watch','high','severe'][max(b) + 1] AS band, ['low','medium','high'][max(c) + 1] AS confidence, ['none','calls','header'][max(c) + 1] AS inference, ['none','1-3','4-10','11-25','26-50','51-100','100+'][max(k) + 1] AS count_bucket
    FROM (SELECT user_id, event_id % 5 AS b, event_id % 3 AS c, event_id % 7 AS k FROM events) GROUP BY user_id""",
)
def _(spark, sf):
    pick = lambda labels, i: F.element_at(F.array(*[F.lit(x) for x in labels]), (i + 1).cast("int"))
    e = F.col("event_id")
    rows = Ad.table(spark, sf, "events").select(
        "user_id",
        pick(B.BAND_LABELS, e % 5).alias("band"),
        pick(B.CONFIDENCE_LABELS, e % 3).alias("confidence"),
        pick(B.INFERENCE_LABELS, e % 3).alias("inference"),
        pick(B.COUNT_LABELS, e % 7).alias("count_bucket"),
    )
    return rows.groupBy("user_id").agg(
        M.max_label("band", B.BAND_LABELS).alias("band"),
        M.max_label("confidence", B.CONFIDENCE_LABELS).alias("confidence"),
        M.max_label("inference", B.INFERENCE_LABELS).alias("inference"),
        M.max_bucket("count_bucket").alias("count_bucket"),
    )


@query(
    "a12_merged_fingerprints",
    """SELECT user_id, id AS fingerprint_id, CAST(sum(n) AS BIGINT) AS evidence_count, ['low','medium','high'][max(c) + 1] AS confidence, bool_or(a) AS active, bool_or(i) AS installed, CASE WHEN min(v) = max(v) AND min(v) <> '' THEN min(v) ELSE '' END AS version_bucket
    FROM (SELECT user_id, event_type AS id, event_id % 4 AS n, event_id % 3 AS c, event_id % 11 = 0 AS a, event_id % 13 = 0 AS i, CASE WHEN event_type = 'view' THEN '1.2' WHEN event_type = 'click' AND event_id % 2 = 0 THEN '' ELSE '1.' || (user_id % 3 + event_id % 2) END AS v FROM events) GROUP BY ALL""",
)
def _(spark, sf):
    e, t = F.col("event_id"), F.col("event_type")
    rows = Ad.table(spark, sf, "events").select(
        "user_id",
        t.alias("fingerprint_id"),
        (e % 4).alias("evidence_count"),
        F.element_at(F.array(*[F.lit(x) for x in B.CONFIDENCE_LABELS]), (e % 3 + 1).cast("int")).alias("confidence"),
        (e % 11 == 0).alias("active"),
        (e % 13 == 0).alias("installed"),
        F.when(t == "view", "1.2")
        .when((t == "click") & (e % 2 == 0), "")
        .otherwise(F.concat(F.lit("1."), (F.col("user_id") % 3 + e % 2).cast("string")))
        .alias("version_bucket"),
    )
    return M.merge_fingerprints(rows, "user_id")


@query(
    "a10_merged_utilization",
    """WITH r AS (SELECT user_id % 10 AS grp, event_id % 3 AS ue, event_id % 2 AS uu, event_id % 5 AS uses, event_id % 3 AS src, event_id % 5 AS band, event_id % 7 AS cb FROM events),
    ids AS (SELECT DISTINCT user_id % 10 AS grp, CASE WHEN event_id % 3 = 0 THEN 'used' ELSE 'exposed' END AS role, event_type AS id FROM events),
    s AS (SELECT grp, count(*) FILTER (role = 'exposed') AS known_exposed, count(*) FILTER (role = 'used') AS known_used FROM ids GROUP BY grp),
    m AS (SELECT grp, CAST(sum(ue) AS BIGINT) AS unknown_exposed, CAST(sum(uu) AS BIGINT) AS unknown_used, CAST(sum(uses) AS BIGINT) AS uses, ['none','calls','header'][max(src) + 1] AS inference_source, ['unknown','normal','watch','high','severe'][max(band) + 1] AS band, ['none','1-3','4-10','11-25','26-50','51-100','100+'][max(cb) + 1] AS count_bucket FROM r GROUP BY grp)
    SELECT m.*, known_exposed, known_used, CAST(least(known_used + unknown_used, known_exposed + unknown_exposed) * 100 // (known_exposed + unknown_exposed) AS BIGINT) AS utilization_ratio_pct FROM m JOIN s USING (grp)""",
)
def _(spark, sf):
    events = Ad.table(spark, sf, "events").withColumn("grp", F.col("user_id") % 10)
    e = F.col("event_id")
    pick = lambda labels, i: F.element_at(F.array(*[F.lit(x) for x in labels]), (i + 1).cast("int"))
    reports = events.select(
        "grp", (e % 3).alias("unknown_exposed"), (e % 2).alias("unknown_used"), (e % 5).alias("uses"),
        (e % 4 == 0).alias("exposure_known"), pick(B.INFERENCE_LABELS, e % 3).alias("inference_source"),
        pick(B.BAND_LABELS, e % 5).alias("band"), pick(B.COUNT_LABELS, e % 7).alias("count_bucket"),
    )
    ids = events.select("grp", F.when(e % 3 == 0, "used").otherwise("exposed").alias("role"), F.col("event_type").alias("id"))
    return M.merge_utilization(reports, ids, "mcp", "grp").drop("surface", "exposure_known")
