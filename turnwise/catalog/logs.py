"""Scans, JSON, normalisation, tooling, fingerprints, recommendations, mining (S, F, D, T)."""

from __future__ import annotations

import io
import tarfile
import uuid

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from turnwise.catalog import query
from turnwise.catalog.scalars import MENTIONED, match_sql, mentioned, q, scrub_sql
from turnwise.catalog.sessions import CALLS as RETRY_CALLS
from turnwise.catalog.sessions import LOOPS as RETRY_LOOPS
from turnwise.catalog.sessions import SEG as RETRY_SEG
from turnwise.catalog.sessions import T as RETRY_T
from turnwise.catalog.sessions import METRICS, ev_calls, ev_turns
from turnwise.functions import json_nodes as J
from turnwise.functions import text as X
from turnwise.operators import fingerprints as Fp
from turnwise.operators import mining as Mi
from turnwise.operators import normalize as N
from turnwise.operators import recommend as R
from turnwise.operators import retained as Re
from turnwise.operators import sessions as Se
from turnwise.operators import tooling as T
from turnwise.operators import usage as U
from turnwise.plans import adapters as Ad
from turnwise.plans import analyze as An
from turnwise.plans import report as Rp
from turnwise.registry import detectors as D
from turnwise.registry import signatures as S
from turnwise.registry import tools as Tl
from turnwise.session import cut_lineage, ensure_checkpoint_dir
from turnwise.sources import bundles, feeds, splits
from turnwise.sources import logs as L
from turnwise.streaming import growing
from turnwise.streaming import jobs as St

TRIM = "'^\\s+|\\s+$'"


def scratch(spark, name: str) -> str:
    """A fresh folder in the shared checkpoint place."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def n_rows(name: str = "n"):
    return F.count(F.lit(1)).alias(name)


# Scans -----------------------------------------------------------------------------------------

LINES = f"lines AS (SELECT doc_id AS log_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS turn, line AS raw FROM (SELECT doc_id, unnest(range(len(l))) AS i, unnest(l) AS line FROM (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, {TRIM}, '', 'g')) AS l FROM documents)) WHERE line <> '')"


@query("s01_transcript_lines", f"WITH {LINES} SELECT log_id, turn, sha256(raw) AS line_hash FROM lines")
def _(spark, sf):
    logs = Ad.logs_from_documents(Ad.table(spark, sf, "documents")).select("log_id", "content")
    # Numbered after blank lines are dropped, so the array position is the turn.
    return N.lines_of(logs).select("log_id", "turn", F.sha2("raw", 256).alias("line_hash"))


def split_logs(spark, sf):
    """Scrubbed pieces of one log for each source: its documents one after the other, written as text and read in ranges."""
    folder = scratch(spark, "split-logs")
    docs = Ad.table(spark, sf, "documents").select("source", "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    ordered = docs.repartitionByRange("source", "doc_id").sortWithinPartitions("source", "doc_id")
    ordered.select("source", "text").write.partitionBy("source").text(folder)
    return splits.scrubbed_pieces(splits.parts_as_logs(splits.log_lines(spark, folder)), 1 << 16)


def source_of_log():
    return F.regexp_extract("log", "source=([^/]*)/", 1).alias("source")


SPLIT = scrub_sql("(SELECT source, string_agg(coalesce(text, ''), chr(10) ORDER BY doc_id) AS text FROM documents GROUP BY source)", "source", "text")


@query(
    "s01_split_lines",
    SPLIT + f"SELECT source, row_number() OVER (PARTITION BY source ORDER BY i) AS turn, sha256(line) AS line_hash FROM (SELECT source, unnest(range(len(l))) AS i, unnest(l) AS line FROM (SELECT source, list_transform(string_split(t, chr(10)), lambda x: regexp_replace(x, {TRIM}, '', 'g')) AS l FROM scrubbed)) WHERE line <> ''",
)
def _(spark, sf):
    lines = splits.numbered_lines(split_logs(spark, sf))
    return lines.select(source_of_log(), "turn", F.sha2("raw", 256).alias("line_hash"))


@query(
    "p01_split_redactions",
    SPLIT + "SELECT * FROM (" + " UNION ALL ".join(f"SELECT source, '{f}' AS family, CAST({f} AS BIGINT) AS n FROM scrubbed" for f, _ in X.SECRET_RULES) + ") WHERE n > 0",
)
def _(spark, sf):
    return splits.redactions(split_logs(spark, sf)).select(source_of_log(), "family", F.col("count").alias("n"))


@query("s02_prefixed_json", "SELECT CASE WHEN event_id % 2 = 0 THEN props ELSE '2024 [info] ' || props END AS event_raw, event_id FROM events WHERE event_id % 3 <> 0 UNION ALL SELECT props, event_id FROM events WHERE event_id % 3 = 0")
def _(spark, sf):
    e = F.col("event_id")
    source = F.when(e % 2 == 0, "kiro_cli").otherwise(F.when(e % 3 == 0, "copilot").otherwise("codex"))
    raw = F.concat(F.lit("2024 [info] "), "props")
    return Ad.table(spark, sf, "events").select("event_id", N.salvaged(source, raw).alias("event_raw"))


@query("s03_file_discovery")
def _(spark, sf):
    files = L.list_files(spark, [sf, sf], "*.parquet").filter(F.col("size_bytes") >= 1)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "size_bytes")


DIRS = (
    ("/home/u/.claude/projects/p/", ".jsonl", "claude_code"),
    ("/home/u/.codex/sessions/rollout-", ".jsonl", "codex"),
    ("/data/claude-code-sessions/local_", ".json", "claude_desktop"),
    ("/x/Logs/Claude/mcp-server-", ".log", "claude_desktop_mcp"),
    ("/x/.cursor/projects/agent-transcripts/", ".jsonl", "cursor"),
    ("/x/Application Support/Kiro/User/kiro", ".log", "kiro_ide"),
    ("/x/.copilot/session-state/events-", ".txt", "copilot"),
    ("/x/nothing/", ".md", "unknown"),
)
PATH_SQL = f"(SELECT doc_id, [{', '.join(q(d[0]) for d in DIRS)}][doc_id % {len(DIRS)} + 1] || doc_id || [{', '.join(q(d[1]) for d in DIRS)}][doc_id % {len(DIRS)} + 1] AS path, [{', '.join(q(d[2]) for d in DIRS)}][doc_id % {len(DIRS)} + 1] AS source FROM documents)"


def log_paths(spark, sf):
    i = (F.col("doc_id") % len(DIRS) + 1).cast("int")
    pick = lambda k: F.element_at(F.array(*[F.lit(d[k]) for d in DIRS]), i)
    return Ad.table(spark, sf, "documents").select("doc_id", F.concat(pick(0), F.col("doc_id").cast("string"), pick(1)).alias("path"))


@query("s04_source_catalogue", f"SELECT path, s AS source_id FROM (SELECT path, unnest(CASE source WHEN 'claude_code' THEN ['claude_code', 'codex'] WHEN 'codex' THEN ['claude_code', 'codex'] WHEN 'claude_desktop' THEN ['claude_desktop'] WHEN 'claude_desktop_mcp' THEN ['claude_desktop_mcp', 'copilot'] WHEN 'cursor' THEN ['claude_code', 'codex', 'cursor'] WHEN 'kiro_ide' THEN ['kiro_ide'] ELSE [] END) AS s FROM {PATH_SQL})")
def _(spark, sf):
    return L.matching_sources(log_paths(spark, sf)).select("path", "source_id")


@query("s05_accepted_files", f"SELECT source AS source_id, count(*) AS n FROM {PATH_SQL} WHERE source NOT IN ('copilot', 'unknown') GROUP BY 1")
def _(spark, sf):
    rows = L.with_source(log_paths(spark, sf))
    return rows.filter(L.accepted(F.col("path"), F.col("source_id"))).groupBy("source_id").agg(n_rows())


@query("s06_inferred_source", f"SELECT doc_id, source FROM {PATH_SQL}")
def _(spark, sf):
    return log_paths(spark, sf).select("doc_id", L.infer_source(F.col("path")).alias("source"))


@query(
    "s07_chat_sessions",
    """SELECT log_id, turn, type, role, md5(content) AS content_hash, tokens, tool FROM (
      SELECT conv_id * 1000 + turn AS log_id, 1 AS turn, 'message' AS type, 'system' AS role, 'chat ' || conv_id AS content, NULL AS tokens, NULL AS tool FROM conversations
      UNION ALL SELECT conv_id * 1000 + turn, 2, 'message', 'user', t, NULL, NULL FROM (SELECT *, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS t FROM conversations)
      UNION ALL SELECT conv_id * 1000 + turn, 3, 'message', 'assistant', 'r' || turn, NULL, NULL FROM conversations
      UNION ALL SELECT conv_id * 1000 + turn, 4, 'token_count', NULL, NULL, turn + 1, NULL FROM conversations
      UNION ALL SELECT conv_id * 1000 + turn, 5, 'tool_call', NULL, NULL, NULL, 'shell' FROM conversations)""",
)
def _(spark, sf):
    turn = F.col("turn")
    doc = F.to_json(
        F.struct(
            F.concat(F.lit("chat "), F.col("conv_id").cast("string")).alias("customTitle"),
            F.array(
                F.struct(
                    F.struct(X.trimmed(F.col("text")).alias("text")).alias("message"),
                    F.array(F.struct(F.concat(F.lit("r"), turn.cast("string")).alias("value"))).alias("response"),
                    F.struct((turn + 1).alias("input_tokens")).alias("usage"),
                    F.struct(F.lit("shell").alias("toolName"), F.lit("toolCall").alias("kind"), F.lit("ls").alias("input")).alias("call"),
                )
            ).alias("requests"),
        )
    )
    rows = Ad.table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + turn).alias("log_id"), doc.alias("content"))
    out = L.copilot_rows(rows)
    got = lambda k: F.get_json_object("raw", f"$.{k}")
    return out.select(
        "log_id", "turn", got("type").alias("type"), got("role").alias("role"), F.md5(got("content")).alias("content_hash"),
        got("input_tokens").cast("long").alias("tokens"), got("tool").alias("tool"),
    )


@query(
    "s08_session_assembly",
    "SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY t, p, k, pp) - 1 AS pos, raw FROM (SELECT o_custkey AS session_id, o_orderdate AS t, o_orderkey AS p, 0 AS k, '' AS pp, 'm' || o_orderkey AS raw FROM orders UNION ALL SELECT o_custkey, o_orderdate, o_orderkey, 1, strftime(l_shipdate, '%Y-%m-%d') || lpad(CAST(l_partkey * 1000 + l_linenumber AS VARCHAR), 12, '0') || lpad(CAST(l_suppkey AS VARCHAR), 6, '0'), 'p' || l_partkey || '.' || l_linenumber || '.' || l_suppkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey)",
)
def _(spark, sf):
    from turnwise.operators import blocks

    s = lambda c: F.col(c).cast("string")
    m = Ad.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("session_id"), F.col("o_orderkey").alias("message_id"),
        F.lpad(s("o_orderkey"), 12, "0").alias("path"), F.col("o_orderdate").alias("mod_time"), F.concat(F.lit(" m"), s("o_orderkey")).alias("body"),
    )
    p = Ad.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("message_id"),
        F.concat(F.lpad((F.col("l_partkey") * 1000 + F.col("l_linenumber")).cast("string"), 12, "0"), F.lpad(s("l_suppkey"), 6, "0")).alias("path"),
        F.col("l_shipdate").alias("mod_time"),
        F.concat(F.lit("p"), s("l_partkey"), F.lit("."), s("l_linenumber"), F.lit("."), s("l_suppkey")).alias("body"),
    )
    rows = L.assemble_messages(m, p).select(
        "session_id", F.unix_micros(F.col("order.msg_time").cast("timestamp")).alias("t"), "order", "raw"
    )
    return blocks.dense_position(rows, "session_id", ["t", "order"]).select("session_id", "pos", "raw")


@query("s09_session_stats", "SELECT session_id, CAST(sum(b) AS BIGINT) AS size_bytes, strftime(max(t), '%Y-%m-%d') AS day FROM (SELECT o_custkey AS session_id, CAST(trunc(o_totalprice) AS BIGINT) AS b, o_orderdate AS t FROM orders UNION ALL SELECT o_custkey, CAST(l_quantity AS BIGINT), l_shipdate FROM orders JOIN lineitem ON o_orderkey = l_orderkey) GROUP BY session_id")
def _(spark, sf):
    m = Ad.table(spark, sf, "orders").select(F.col("o_custkey").alias("session_id"), F.col("o_orderkey").alias("message_id"), F.col("o_totalprice").cast("long").alias("size_bytes"), F.col("o_orderdate").alias("mod_time"))
    p = Ad.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("message_id"), F.col("l_quantity").cast("long").alias("size_bytes"), F.col("l_shipdate").alias("mod_time"))
    rows = L.session_stats(m, p)
    return rows.select("session_id", "size_bytes", F.date_format("mod_time", "yyyy-MM-dd").alias("day"))


@query("s10_state_rows", "SELECT p_brand, key, rank, key_type, content FROM (SELECT p_brand, key, row_number() OVER (PARTITION BY p_brand ORDER BY key) AS rank, CASE WHEN p_partkey % 2 = 0 THEN 'agentkv' ELSE 'composer_data' END AS key_type, p_name || ' is a part' AS content FROM (SELECT *, CASE p_partkey % 4 WHEN 1 THEN 'composer.data' WHEN 3 THEN 'Composer.Data' ELSE 'agentKv:' END || lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS key FROM part WHERE p_partkey % 5 <> 0))")
def _(spark, sf):
    k = F.col("p_partkey")
    name = F.when(k % 4 == 1, "composer.data").when(k % 4 == 3, "Composer.Data").otherwise("agentKv:")
    name = F.when(k % 5 == 0, "other").otherwise(name)
    text = F.concat("p_name", F.lit(" is a part"))
    value = F.when(k % 3 == 0, F.hex(F.encode(text, "UTF-8"))).otherwise(text).cast("binary")
    rows = Ad.table(spark, sf, "part").select("p_brand", F.concat(name, F.lpad(k.cast("string"), 9, "0")).alias("key"), value.alias("value"))
    return L.state_rows(rows, ["agentKv:", "composer.data"], "p_brand").select("p_brand", "key", F.col("rank").cast("long").alias("rank"), "key_type", "content")


@query("s11_diagnostic_rows", "SELECT user_id, rank, level, error, content FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS rank, event_type AS level, event_type = 'error' AS error, props AS content FROM events)")
def _(spark, sf):
    rows = Ad.table(spark, sf, "events").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"), F.upper("event_type").alias("Level"), F.lit(" ").alias("body"), F.col("props").alias("text"))
    out = L.diagnostic_rows(rows, "user_id")
    return out.select("user_id", F.col("rank").cast("long").alias("rank"), "level", "error", "content")


@query("s12_indexed_logs", f"SELECT path, doc_id FROM {PATH_SQL} WHERE suffix(path, '.jsonl')")
def _(spark, sf):
    files = log_paths(spark, sf)
    named = F.when(F.col("doc_id") % 2 == 0, F.to_json(F.struct(F.col("path").alias("log_path")))).otherwise(
        F.to_json(F.struct(F.array(F.struct(F.lit("x").alias("a"), F.col("path").alias("b"))).alias("items")))
    )
    index = files.select(named.alias("raw"))
    return L.indexed_logs(index.unionByName(index), files).select("path", "doc_id")


@query("s13_exposure_header", "SELECT event_id, 'Available MCP servers:' || chr(10) || '- ' || CASE WHEN event_type < 'my_tools' THEN event_type || chr(10) || '- my_tools' ELSE 'my_tools' || chr(10) || '- ' || event_type END || chr(10) AS header FROM events")
def _(spark, sf):
    keys = F.create_map(
        F.concat(F.lit("local:"), "event_type", F.lit(":Bash")), F.lit(True), F.lit("x:my tools:Read"), F.lit(True)
    )
    content = F.to_json(F.struct(keys.alias("enabledMcpTools"), "props"))
    logs = Ad.table(spark, sf, "events").select("event_id", F.lit("claude_desktop").alias("source_id"), F.lit("/a/local_1.json").alias("path"), content.alias("content"))
    return L.with_exposure_header(logs).select("event_id", F.regexp_extract("content", r"(?s)^(.*)\{\"enabled", 1).alias("header"))


def _pack(batches):
    for batch in batches:
        rows = []
        for key, text in zip(batch["path"], batch["text"]):
            buffer = io.BytesIO()
            with tarfile.open(fileobj=buffer, mode="w:gz") as archive:
                for i, line in enumerate(x for x in text.split("\n") if x.strip()):
                    data = line.encode()
                    info = tarfile.TarInfo(f"../{i}.jsonl" if key.endswith("7") else f"logs/{i}.jsonl")
                    info.size = len(data)
                    archive.addfile(info, io.BytesIO(data))
            rows.append((key, buffer.getvalue()))
        yield pd.DataFrame(rows, columns=["path", "content"])


@query(
    "s14_bundles",
    """SELECT bundle, entry, content_hash, reject FROM (
      SELECT path AS bundle, 'logs/' || i || '.jsonl' AS entry, sha256(line) AS content_hash, CAST(NULL AS VARCHAR) AS reject FROM (SELECT path, unnest(l) AS line, unnest(range(len(l))) AS i FROM (SELECT conv_id || '-' || turn AS path, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '\\S')) AS l FROM conversations)) WHERE NOT suffix(path, '7')
      UNION ALL SELECT conv_id || '-' || turn, NULL, NULL, 'unsafe path' FROM conversations WHERE turn % 10 = 7)""",
)
def _(spark, sf):
    rows = Ad.table(spark, sf, "conversations").select(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("path"), "text")
    packed = rows.mapInPandas(_pack, "path string, content binary")
    return bundles.expand_bundles(packed).select("bundle", "entry", F.sha2("content", 256).alias("content_hash"), "reject")


def usage_rows(spark, sf):
    e = F.col("event_id")
    return Ad.table(spark, sf, "events").select(
        F.col("ts").cast("timestamp").alias("timestamp"), (200 + e % 4 * 100).cast("int").alias("status"), F.lit("GET").alias("method"),
        F.concat(F.lit("/p/"), (e % 9).cast("string")).alias("path"), F.sha2(F.col("user_id").cast("string"), 256).alias("client_hash"),
        F.when(e % 4 == 0, F.create_map(F.lit("utm_source"), F.lit("mail"))).alias("utm"),
    )


@query("s15_retained_scan", "SELECT event_type AS client, count(*) AS n FROM events GROUP BY 1")
def _(spark, sf):
    path = scratch(spark, "retained")
    from turnwise.catalog.cohorts import retained

    feeds.write_report(retained(spark, sf).drop("event_type"), path)
    return feeds.retained_events(spark, path).groupBy(F.col("ecosystem.client").alias("client")).agg(n_rows())


@query("s16_usage_scan", "SELECT status, count(*) AS n FROM (SELECT 200 + event_id % 4 * 100 AS status, ts FROM events) WHERE ts >= TIMESTAMP '2024-01-10' GROUP BY status")
def _(spark, sf):
    path = scratch(spark, "usage")
    good = usage_rows(spark, sf).select(F.to_json(F.struct("*")).alias("value"))
    bad = Ad.table(spark, sf, "pages").select(F.concat(F.lit("{broken "), "url").alias("value"))
    good.unionByName(bad).write.text(path)
    rows = feeds.usage_events(spark, path, since="2024-01-10 00:00:00")
    return rows.groupBy(F.col("status").cast("long").alias("status")).agg(n_rows())


@query("s17_partitioned_append", "SELECT strftime(ts, '%Y-%m-%d') AS date, CAST(strftime(ts, '%H') AS BIGINT) AS hour, count(*) AS n FROM events GROUP BY ALL")
def _(spark, sf):
    path = scratch(spark, "append")
    feeds.append_partitioned(usage_rows(spark, sf), path)
    rows = spark.read.schema(feeds.USAGE_SCHEMA + ", date string, hour int").json(path)
    return rows.groupBy("date", F.col("hour").cast("long").alias("hour")).agg(n_rows())


@query("s18_pruned_prefix", "SELECT strftime(ts, '%Y-%m-%d') AS object_date, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-15' GROUP BY 1")
def _(spark, sf):
    path = scratch(spark, "prefix")
    feeds.append_partitioned(usage_rows(spark, sf), path)
    rows = feeds.dated_prefix(spark, path, "status int, path string, date string, hour int", "2024-01-15")
    return rows.groupBy("object_date").agg(n_rows())


@query("s19_record_type", "SELECT o_orderstatus AS record_type, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1")
def _(spark, sf):
    rows = Ad.table(spark, sf, "orders").select(F.col("o_orderstatus").alias("record_type"))
    return feeds.record_type(rows, "F").groupBy("record_type").agg(n_rows())


@query("s21_report_sink", "SELECT lang, count(*) AS n FROM documents GROUP BY lang")
def _(spark, sf):
    path = scratch(spark, "report")
    feeds.write_report(Ad.table(spark, sf, "documents").groupBy("lang").agg(n_rows()), path)
    return spark.read.schema("lang string, n bigint").json(path)


@query("s23_file_index")
def _(spark, sf):
    return feeds.file_index(spark, sf).select(F.element_at(F.split("path", "/"), -1).alias("name"), "bytes", "sha256")


# JSON functions and normalisation -----------------------------------------------------------------

TR = """tr AS (SELECT user_id AS log_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS turn, event_id, event_type, value, json_extract_string(props, '$.k') AS k, event_type IN ('view', 'click') AS is_call, event_type IN ('error', 'purchase') AS is_result FROM events)"""
FLAT = "CASE WHEN is_call THEN 'call-' || event_id || ' ' || event_type || ' tool_use assistant' WHEN is_result THEN 'output ' || k || ' call-' || event_id || ' tool_result user' ELSE 'assistant' END"


def transcripts(spark, sf, **kw):
    return Ad.transcripts_from_events(Ad.table(spark, sf, "events"), **kw)


def parsed(spark, sf):
    rows = transcripts(spark, sf).withColumn("nodes", J.json_nodes("raw"))
    return J.with_doc(rows, "nodes", "_d_")


@query("p03_p04_turn_flags", f"WITH {TR} SELECT log_id, turn, is_call OR is_result AS is_tool, event_type = 'error' AS is_error, CASE WHEN is_call THEN event_type ELSE '' END AS tool_name, greatest(1, strlen({FLAT}) // 4) AS tokens FROM tr")
def _(spark, sf):
    rows = N.turns_of(transcripts(spark, sf))
    return rows.select("log_id", "turn", "is_tool", "is_error", "tool_name", X.token_estimate(F.col("text")).alias("tokens"))


@query("f01_json_nodes", f"WITH {TR} SELECT kind, CAST(sum(n) AS BIGINT) AS n FROM (SELECT unnest(['object', 'array', 'string', 'number', 'bool']) AS kind, unnest(CASE WHEN is_call THEN [4, 1, 4, 1, 0] WHEN is_result THEN [3, 1, 4, 0, 1] ELSE [3, 0, 1, 4, 0] END) AS n FROM tr) GROUP BY kind HAVING sum(n) > 0")
def _(spark, sf):
    rows = transcripts(spark, sf).select(F.explode(J.json_nodes("raw")).alias("node"))
    return rows.groupBy("node.kind").agg(n_rows())


@query(
    "f02_f09_json_lookups",
    f"""WITH {TR} SELECT log_id, turn, {FLAT} AS flat, is_call OR is_result AS tool_type, CASE WHEN is_call THEN event_type ELSE '' END AS name, CAST(CASE WHEN is_call OR is_result THEN 0 ELSE floor(value * 1000) END AS BIGINT) AS tokens_in, event_type = 'error' AS has_error,
    CASE WHEN is_result THEN strlen('output ' || k) ELSE 0 END AS content_bytes FROM tr""",
)
def _(spark, sf):
    rows, d = parsed(spark, sf)
    item = F.lit("/message/content/0")
    return rows.select(
        "log_id", "turn", J.flat_text(d.nodes).alias("flat"), J.type_contains(d, "tool").alias("tool_type"),
        J.first_string(d, "name").alias("name"), J.first_int(d, "INPUT_TOKENS").alias("tokens_in"), J.has_error(d).alias("has_error"),
        J.size_at(d, F.concat(item, F.lit("/content"))).alias("content_bytes"),
    )


@query("f05_first_present", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_type ELSE 'u' || user_id END AS first FROM events")
def _(spark, sf):
    e = F.col("event_id")
    doc = F.to_json(F.struct(F.when(e % 3 == 0, F.col("event_type")).alias("a"), F.lit(" ").alias("b"), F.concat(F.lit(" u"), F.col("user_id").cast("string")).alias("c")))
    rows = Ad.table(spark, sf, "events").select("event_id", J.json_nodes(doc).alias("nodes"))
    rows, d = J.with_doc(rows, "nodes", "_d_")
    return rows.select("event_id", J.direct_string(d, "a", "b", "c").alias("first"))


@query("f08_output_bytes", "SELECT event_id, CAST(CASE event_id % 3 WHEN 0 THEN strlen(event_type) + strlen(CAST(user_id AS VARCHAR)) WHEN 1 THEN 2 * strlen(event_type) ELSE strlen(event_type) + strlen(CAST(user_id AS VARCHAR)) END AS BIGINT) AS bytes FROM events")
def _(spark, sf):
    e, t = F.col("event_id"), F.col("event_type")
    doc = F.to_json(F.struct(
        F.when(e % 3 == 0, F.array(t, F.col("user_id").cast("string"))).when(e % 3 == 1, F.array(t)).alias("output"),
        F.when(e % 3 == 1, F.struct(F.struct(t.alias("metadata")).alias("state"))).alias("deep"),
        F.when(e % 3 == 2, F.struct(t.alias("x"), F.col("user_id").alias("y"))).alias("other"),
    ))
    rows = Ad.table(spark, sf, "events").select("event_id", J.json_nodes(doc).alias("nodes"))
    rows, d = J.with_doc(rows, "nodes", "_d_")
    return rows.select("event_id", J.output_bytes(d).alias("bytes"))


SIGNALS_SQL = """SELECT log_id, count(*) + sum(CASE WHEN FALSE THEN 1 ELSE 0 END) AS normalized_event_count, sum(CASE WHEN is_call THEN 1 ELSE 0 END) AS tool_call_count, sum(CASE WHEN is_result THEN 1 ELSE 0 END) AS tool_result_count,
 sum(CASE WHEN is_call OR is_result THEN 0 ELSE floor(value * 1000) END) AS input_tokens, sum(CASE WHEN is_call OR is_result THEN 0 ELSE floor(value * 200) END) AS cache_creation_tokens, sum(CASE WHEN is_result THEN strlen('output ' || k) ELSE 0 END) AS tool_output_bytes FROM tr GROUP BY log_id"""


@query("d01_generic_events", f"WITH {TR} SELECT log_id, {', '.join(f'CAST({c} AS BIGINT) AS {c}' for c in ('normalized_event_count', 'tool_call_count', 'tool_result_count', 'input_tokens', 'cache_creation_tokens', 'tool_output_bytes'))} FROM ({SIGNALS_SQL})")
def _(spark, sf):
    events = N.events_of(N.with_nodes(transcripts(spark, sf)), only=())
    return Se.signal_sums(events, "log_id").select("log_id", "normalized_event_count", "tool_call_count", "tool_result_count", "input_tokens", "cache_creation_tokens", "tool_output_bytes")


LOOP_SQL = """seg AS (SELECT *, sum(CASE WHEN is_call THEN 1 ELSE 0 END) OVER (PARTITION BY log_id ORDER BY turn) AS c FROM tr), failed AS (SELECT log_id, c, max(CASE WHEN is_call THEN event_type || CAST(k AS BIGINT) % 3 END) AS sig, bool_or(event_type = 'error') AS failed FROM seg WHERE c > 0 GROUP BY log_id, c),
 prev AS (SELECT *, coalesce(sig = lag(sig) OVER w AND lag(failed) OVER w, false) AS retry FROM failed WINDOW w AS (PARTITION BY log_id ORDER BY c)),
 loops AS (SELECT log_id, max(run) AS loops FROM (SELECT log_id, sum(CASE WHEN retry THEN 1 ELSE 0 END) OVER (PARTITION BY log_id, g ORDER BY c) AS run FROM (SELECT *, sum(CASE WHEN retry THEN 0 ELSE 1 END) OVER (PARTITION BY log_id ORDER BY c) AS g FROM prev)) GROUP BY log_id)"""


@query("d01_transcript_retries", f"WITH {TR}, {LOOP_SQL} SELECT log_id, CAST(loops AS BIGINT) AS args_hashed_retry_loops FROM loops")
def _(spark, sf):
    events = N.events_of(N.with_nodes(transcripts(spark, sf)), only=())
    calls = N.with_event_position(events).select("log_id", "pos", "kind", "tool", "args_hash", "parent_hash", "error")
    # several folds read the events, so that lines are parsed once
    return Se.identical_retries(cut_lineage(calls), step=N.POSITION_STEP)


def wrapped(spark, sf, make, source):
    ev = Ad.table(spark, sf, "events")
    return ev.select(
        F.col("user_id").alias("log_id"), source.alias("source_id"), F.col("event_id").alias("turn"), make.alias("raw")
    )


@query("d02_codex_events", "SELECT kind, tool, count(*) AS n, CAST(sum(tok) AS BIGINT) AS tok_in, CAST(sum(b) AS BIGINT) AS out_bytes FROM (SELECT CASE event_type WHEN 'view' THEN 'tool_call' WHEN 'click' THEN 'tool_call' WHEN 'error' THEN 'tool_result' WHEN 'signup' THEN 'token_count' ELSE 'message' END AS kind, CASE event_type WHEN 'view' THEN 'exec' WHEN 'click' THEN 'shell' ELSE '' END AS tool, CASE WHEN event_type = 'signup' THEN user_id + 1 ELSE 0 END AS tok, CASE WHEN event_type = 'error' THEN strlen(props) ELSE 0 END AS b FROM events) GROUP BY kind, tool")
def _(spark, sf):
    t = F.col("event_type")
    item = lambda *f: F.to_json(F.struct(F.lit("response_item").alias("type"), F.struct(F.struct(*f).alias("item")).alias("payload")))
    raw = (
        F.when(t == "view", item(F.lit("function_call").alias("type"), F.lit("c").alias("call_id"), F.lit("Exec").alias("name"), F.col("props").alias("arguments")))
        .when(t == "click", item(F.lit("local_shell_call").alias("type"), F.col("props").alias("command")))
        .when(t == "error", item(F.lit("function_call_output").alias("type"), F.col("props").alias("output")))
        .when(t == "signup", F.to_json(F.struct(F.lit("event_msg").alias("type"), F.struct(F.struct(F.lit("token_count").alias("type"), F.struct((F.col("user_id") + 1).alias("input_tokens")).alias("last_token_usage")).alias("msg")).alias("payload"))))
        .otherwise(F.to_json(F.struct(F.lit("turn_context").alias("type"), F.struct(F.lit("x").alias("cwd")).alias("payload"))))
    )
    events = N.events_of(N.with_nodes(wrapped(spark, sf, raw, F.lit("codex"))), only=("codex",))
    return events.groupBy("kind", "tool").agg(n_rows(), F.sum("tok_in").alias("tok_in"), F.sum("out_bytes").alias("out_bytes"))


RPC = "rpc AS (SELECT user_id AS log_id, event_id AS turn, 'r' || user_id % 3 AS id, CASE WHEN event_type IN ('view', 'click') THEN 'tool_call' WHEN event_type IN ('error', 'purchase') THEN 'tool_result' ELSE 'message' END AS kind, strlen(props) AS b FROM events)"


@query("d03_j02_request_results", f"WITH {RPC}, p AS (SELECT *, lag(kind) OVER (PARTITION BY log_id, id ORDER BY turn) AS before FROM rpc WHERE kind <> 'message') SELECT log_id, turn, kind, CAST(CASE WHEN kind = 'tool_result' THEN b ELSE 0 END AS BIGINT) AS out_bytes FROM p WHERE kind = 'tool_call' OR before = 'tool_call' UNION ALL SELECT log_id, turn, kind, 0 FROM rpc WHERE kind = 'message'")
def _(spark, sf):
    t = F.col("event_type")
    rid = F.concat(F.lit("r"), (F.col("user_id") % 3).cast("string")).alias("id")
    raw = (
        F.when(t.isin("view", "click"), F.to_json(F.struct(rid, F.lit("tools/call").alias("method"), F.struct(t.alias("name")).alias("params"))))
        .when(t.isin("error", "purchase"), F.to_json(F.struct(rid, F.struct(F.col("props").alias("content")).alias("result"))))
        .otherwise(F.to_json(F.struct(rid, F.lit("initialize").alias("method"))))
    )
    raw = F.concat(F.lit("2024-01-01 "), raw)
    events = N.events_of(N.with_nodes(wrapped(spark, sf, raw, F.lit("claude_desktop_mcp"))), only=("claude_desktop_mcp",))
    return events.select("log_id", "turn", "kind", "out_bytes")


@query("d04_desktop_agent_events", "SELECT source, kind, tool, count(*) AS n FROM (SELECT CASE user_id % 4 WHEN 0 THEN 'cursor' WHEN 1 THEN 'kiro_cli' WHEN 2 THEN 'antigravity' ELSE 'claude_desktop' END AS source, CASE WHEN user_id % 4 = 0 THEN 'tool_call' WHEN event_type = 'error' THEN 'tool_result' ELSE 'tool_call' END AS kind, event_type AS tool FROM events UNION ALL SELECT 'claude_desktop', 'message', '' FROM events WHERE user_id % 4 = 3) GROUP BY ALL")
def _(spark, sf):
    u, t = F.col("user_id") % 4, F.col("event_type")
    failed = t == "error"
    hook = F.struct(F.when(failed, "PostToolUse").otherwise("PreToolUse").alias("hook_event_name"), t.alias("tool_name"))
    state = F.struct(F.lit("agentkv").alias("key_type"), F.to_json(F.struct(t.alias("tool"), F.array(F.lit(1)).alias("args"))).alias("content"))
    raw = (
        F.when(u == 0, F.to_json(state))
        .when(u == 1, F.concat(F.lit("2024 [info] "), F.to_json(hook)))
        .when(u == 2, F.to_json(F.struct(F.when(failed, "tool_result").otherwise("terminal_command").alias("type"), t.alias("tool"))))
        .otherwise(F.to_json(F.struct(F.lit("fix it").alias("initialMessage"), F.array(hook).alias("history"))))
    )
    source = F.when(u == 0, "cursor").when(u == 1, "kiro_cli").when(u == 2, "antigravity").otherwise("claude_desktop")
    events = N.events_of(N.with_nodes(wrapped(spark, sf, raw, source)), only=("cursor", "kiro", "antigravity", "claude_desktop"))
    return events.groupBy("source", "kind", "tool").agg(n_rows())


# Tooling -----------------------------------------------------------------------------------------

# Each document as a log: an exposure list whose length depends on its number, then its text,
# then calls and slash commands.
def exposure_logs(spark, sf):
    d = F.col("doc_id")
    servers = F.transform(F.sequence(F.lit(0), F.when(d % 4 == 0, 29).otherwise(2)), lambda i: F.concat(F.lit("- acme_"), i.cast("string"), F.lit("\n")))
    header = F.concat(F.lit("system: Available MCP servers:\n- github\n"), F.array_join(servers, ""), F.lit("mcp__github__list\n\n"))
    calls = F.concat(F.lit("\nuse mcp__github__get and mcp__acme_"), (d % 3).cast("string"), F.lit("__run\n"))
    skills = F.when(d % 5 == 0, F.lit("\nThe following skills are available\n- review\n- my-own\n\n")).otherwise("\n")
    content = F.concat(F.when(d % 3 != 2, header).otherwise(""), F.regexp_replace("text", r"[/$]", " "), calls, skills, F.lit("\nplease /review and /fancy-thing\n"))
    return Ad.texts(spark, sf, "documents").select(d.alias("log_id"), F.col("source").alias("source_id"), content.alias("content"))


EXP = """ex AS (SELECT doc_id AS log_id, doc_id % 3 <> 2 AS header, CASE WHEN doc_id % 4 = 0 THEN 30 ELSE 3 END AS listed, doc_id % 5 = 0 AS skills, CASE WHEN doc_id % 4 = 0 THEN 320 + 0 ELSE 27 END AS x FROM documents)"""


@query("d05_exposure", f"WITH {EXP} SELECT log_id, header AS mcp_header, CASE WHEN header THEN 'github' ELSE '' END AS mcp_ids, CAST(CASE WHEN header THEN listed + 1 ELSE 0 END AS BIGINT) AS mcp_unknown, CAST(CASE WHEN header THEN 1 ELSE 0 END AS BIGINT) AS mcp_tools, skills AS skill_header, CASE WHEN skills THEN 'review' ELSE '' END AS skill_ids, CAST(CASE WHEN skills THEN 1 ELSE 0 END AS BIGINT) AS skill_unknown FROM ex")
def _(spark, sf):
    rows = T.exposures(exposure_logs(spark, sf))
    return rows.select("log_id", "mcp_header", F.array_join("mcp_exposed_ids", ",").alias("mcp_ids"), "mcp_unknown", "mcp_tools", "skill_header", F.array_join("skill_exposed_ids", ",").alias("skill_ids"), "skill_unknown")


@query("f20_header_blocks", f"WITH {EXP} SELECT log_id, CAST(CASE WHEN header THEN 1 ELSE 0 END AS BIGINT) AS blocks, CAST(CASE WHEN header THEN listed + 3 ELSE 0 END AS BIGINT) AS lines FROM ex")
def _(spark, sf):
    b = T.header_blocks(F.col("content"), T.MCP_PHRASES)
    rows = exposure_logs(spark, sf).select("log_id", b.alias("b"))
    lines = F.aggregate("b", F.lit(0), lambda a, x: a + F.size(F.split(x, "\n")) - 1)
    return rows.select("log_id", F.size("b").cast("long").alias("blocks"), lines.cast("long").alias("lines"))


@query("j03_a37_calls_outside_headers", f"WITH {EXP} SELECT log_id, {', '.join(f'CAST({v} AS BIGINT) AS {c}' for c, v in (('call_count', 2), ('known_call_count', 1), ('unknown_call_count', 1), ('unique_servers', 2), ('unique_tools', 2), ('unique_known_called', 1), ('unique_unknown_called', 1)))} FROM ex")
def _(spark, sf):
    calls = T.mcp_call_rows(exposure_logs(spark, sf), None)
    return T.summarize_mcp_calls(calls, "log_id")


def exposure_turns(spark, sf):
    lines = N.lines_of(exposure_logs(spark, sf))
    text = F.col("raw")
    return lines.select(
        "log_id", "turn", text.alias("text"), F.lit(False).alias("is_tool"), X.looks_failed(text).alias("is_error"),
        F.lit("").alias("tool_name"), X.token_estimate(text).alias("tokens"),
    )


@query("a38_skill_executions", f"WITH {EXP} SELECT log_id, CAST(2 AS BIGINT) AS executed_count, CAST(1 AS BIGINT) AS known_executed, CAST(1 AS BIGINT) AS unknown_executed FROM ex")
def _(spark, sf):
    return T.summarize_skill_runs(T.skill_run_rows(exposure_turns(spark, sf)), "log_id")


@query("a39_unknown_servers", f"WITH {EXP} SELECT log_id, CAST(1 AS BIGINT) AS unknown_mcp_server_count FROM ex")
def _(spark, sf):
    logs = exposure_logs(spark, sf)
    ids = logs.select("log_id", F.lit("mcp").alias("category"), F.lit("github").alias("id"))
    return T.unknown_mcp_count(logs, ids)


UTIL = f"""{EXP}, u AS (SELECT log_id, header, CASE WHEN header THEN listed + 2 ELSE 2 END AS servers, skills, CASE WHEN header THEN 2 * 100 // (listed + 2) ELSE 100 END AS ratio FROM ex)"""


@query("d06_utilization", f"WITH {UTIL} SELECT log_id, CASE WHEN header THEN 'header' ELSE 'calls' END AS mcp_source, CAST(ratio AS BIGINT) AS mcp_ratio, CASE WHEN servers <= 3 THEN '1-3' WHEN servers <= 10 THEN '4-10' ELSE '26-50' END AS mcp_count_bucket, CASE WHEN skills THEN 'header' ELSE 'none' END AS skill_source, CAST(CASE WHEN skills THEN 100 ELSE 0 END AS BIGINT) AS skill_ratio, CASE WHEN servers <= 10 THEN 'normal' ELSE 'watch' END AS mcp_band, CASE WHEN skills THEN 'normal' ELSE 'unknown' END AS skill_band FROM u")
def _(spark, sf):
    turns = exposure_turns(spark, sf)
    zero = F.lit(0).cast("long")
    metrics = exposure_logs(spark, sf).select("log_id", zero.alias("rereads"), zero.alias("retry_depth_max"), zero.alias("context_growth_events"))
    rows = T.utilization(exposure_logs(spark, sf), turns, metrics)
    return rows.select("log_id", "mcp_source", "mcp_ratio", "mcp_count_bucket", "skill_source", "skill_ratio", "mcp_band", "skill_band")


CNT = "['none','1-3','4-10','11-25','26-50','51-100','100+','unknown']"
TOK = "['none','<1k','1k-5k','5k-15k','15k-50k','50k+','unknown']"


@query(
    "d07_warning_bands",
    """SELECT mcp, skill, count(*) AS n FROM (SELECT CASE WHEN NOT known THEN 'unknown' WHEN c BETWEEN 0 AND 2 OR ratio >= 40 THEN 'normal' WHEN gate AND deg THEN 'severe' WHEN gate THEN 'high' WHEN c BETWEEN 3 AND 4 AND ratio < 40 AND NOT deg THEN 'watch' ELSE 'normal' END AS mcp,
      CASE WHEN NOT known THEN 'unknown' WHEN c BETWEEN 0 AND 2 OR ratio >= 30 THEN 'normal' WHEN sgate AND deg THEN 'severe' WHEN sgate THEN 'high' WHEN c BETWEEN 3 AND 4 AND ratio < 30 AND NOT deg THEN 'watch' ELSE 'normal' END AS skill
      FROM (SELECT *, c >= 3 AND ratio < 20 AND (tk >= 3 OR tc >= 4) AS gate, c >= 3 AND ratio < 15 AND tk >= 3 AS sgate FROM (SELECT l_orderkey % 11 <> 0 AS known, CASE WHEN l_partkey % 8 = 7 THEN -1 ELSE l_partkey % 8 END AS c, CASE WHEN l_suppkey % 7 = 6 THEN -1 ELSE l_suppkey % 7 END AS tk, l_linenumber % 7 AS tc, l_orderkey % 53 AS ratio, l_quantity > 45 OR l_discount > 0.08 AS deg FROM lineitem))) GROUP BY ALL""",
)
def _(spark, sf):
    pick = lambda labels, i: F.element_at(F.array(*[F.lit(x) for x in (*labels, "unknown")]), (i + 1).cast("int"))
    from turnwise.functions import buckets as B

    rows = Ad.table(spark, sf, "lineitem").select(
        (F.col("l_orderkey") % 11 != 0).alias("known"), pick(B.COUNT_LABELS, F.col("l_partkey") % 8).alias("c"),
        pick(B.TOKEN_LABELS, F.col("l_suppkey") % 7).alias("tk"), pick(B.COUNT_LABELS, F.col("l_linenumber") % 7).alias("tc"),
        (F.col("l_orderkey") % 53).alias("ratio"),
        F.when(F.col("l_quantity") > 45, 3).otherwise(0).alias("rereads"), F.lit(0).alias("retry_depth_max"),
        F.when(F.col("l_discount") > 0.08, 2).otherwise(0).alias("context_growth_events"),
    )
    c = F.col
    return rows.groupBy(
        T.mcp_band(c("known"), c("c"), c("tc"), c("tk"), c("ratio")).alias("mcp"), T.skill_band(c("known"), c("c"), c("tk"), c("ratio")).alias("skill")
    ).agg(n_rows())


ECO = " UNION ALL ".join(f"SELECT '{cat}' AS category, id, doc_id FROM ({match_sql(MENTIONED, 'doc_id', 't', sigs)})" for cat, sigs in S.CATEGORIES.items())


@query("a09_ecosystem_ids", f"SELECT source, category, id FROM ({ECO}) JOIN documents USING (doc_id) GROUP BY ALL")
def _(spark, sf):
    from turnwise.operators.merge import union_ids

    docs = mentioned(spark, sf).select(F.col("doc_id").alias("log_id"), F.col("t").alias("content"))
    ids = T.ecosystem_ids(T.ecosystem(docs))
    sources = Ad.table(spark, sf, "documents").select(F.col("doc_id").alias("log_id"), "source")
    return union_ids(ids.join(sources, "log_id"), "source")


# Fingerprints ---------------------------------------------------------------------------------

PRINT_TEXT = ("see .bmad-core/ and .bmad-core/agents/dev.md", "npm i bmad-method", "openspec/specs/a then /openspec:apply", ".kiro/specs/x/tasks.md", "nothing")


@query(
    "d14_fingerprints",
    """SELECT doc_id AS log_id, fingerprint_id, confidence, CAST(evidence_count AS BIGINT) AS evidence_count, active, installed, version_bucket,
      row_number() OVER (PARTITION BY doc_id ORDER BY CASE fingerprint_id WHEN 'bmad' THEN 5 WHEN 'openspec' THEN 3 WHEN 'kiro' THEN 2 ELSE 1 END, fingerprint_id) AS rank FROM (
      SELECT doc_id, 'bmad' AS fingerprint_id, 'high' AS confidence, 2 + CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 0 END AS evidence_count, doc_id % 3 = 0 AS active, doc_id % 3 = 0 AS installed, CASE WHEN doc_id % 3 = 0 THEN '4.' || doc_id % 7 ELSE '' END AS version_bucket FROM documents WHERE doc_id % 5 = 0
      UNION ALL SELECT doc_id, 'bmad', 'medium', 1 + CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 0 END, FALSE, doc_id % 3 = 0, CASE WHEN doc_id % 3 = 0 THEN '4.' || doc_id % 7 ELSE '' END FROM documents WHERE doc_id % 5 = 1
      UNION ALL SELECT doc_id, 'bmad', 'low', 2, FALSE, TRUE, '4.' || doc_id % 7 FROM documents WHERE doc_id % 5 > 1 AND doc_id % 3 = 0
      UNION ALL SELECT doc_id, 'openspec', 'high', 2, TRUE, FALSE, '' FROM documents WHERE doc_id % 5 = 2
      UNION ALL SELECT doc_id, 'kiro', 'high', 2, FALSE, FALSE, '' FROM documents WHERE doc_id % 5 = 3)""",
)
def _(spark, sf):
    d = F.col("doc_id")
    extra = F.element_at(F.array(*[F.lit(t) for t in PRINT_TEXT]), (d % 5 + 1).cast("int"))
    docs = Ad.table(spark, sf, "documents")
    logs = docs.select(d.alias("log_id"), F.concat("text", F.lit("\n"), extra).alias("content"))
    inventory = docs.filter(d % 3 == 0).select(d.alias("log_id"), F.lit("bmad-method").alias("binary"), F.concat(F.lit("bmad v4."), (d % 7).cast("string"), F.lit(".1")).alias("version_text"))
    det, _, rules = D.frames(spark)
    hits = Fp.marker_hits(logs, list(D.MARKERS), inventory)
    order = Window.partitionBy("log_id").orderBy("priority", "fingerprint_id")
    rows = Fp.evaluate(hits, det, rules).withColumn("rank", F.row_number().over(order).cast("long"))
    return rows.drop("priority", "sources")


# Recommendations -------------------------------------------------------------------------------


def rec_inputs(spark, sf):
    """Findings, bands, fingerprints and exposures of each document, by its number."""
    d = F.col("doc_id")
    docs = Ad.table(spark, sf, "documents").select(d.alias("log_id"))
    i = F.col("log_id")
    findings = docs.filter(i % 4 < 2).select("log_id", F.when(i % 4 == 0, "repeated_file_reads").otherwise("tool_output_bloat").alias("finding_id"))
    bands = docs.select("log_id", F.when(i % 7 == 0, "high").otherwise("normal").alias("mcp_band"), F.lit("unknown").alias("skill_band"))
    prints = docs.filter(i % 3 == 0).select(
        "log_id", F.lit("ccusage").alias("fingerprint_id"), (i % 2 == 0).alias("active"), (i % 2 == 1).alias("installed"),
        F.lit(False).alias("has_cli"), F.lit("").alias("version_bucket"),
    )
    frameworks = docs.filter(i % 10 == 0).select("log_id", F.lit("semble").alias("id"))
    exposed = docs.filter(i % 6 == 0).select("log_id", F.lit("mcp").alias("surface"), F.lit("semble").alias("id"))
    used = docs.filter(i % 12 == 0).select("log_id", F.lit("mcp").alias("surface"), F.lit("semble").alias("id"))
    return findings, bands, prints, frameworks, exposed, used


def rec_parts(spark, sf):
    findings, bands, prints, frameworks, exposed, used = rec_inputs(spark, sf)
    tools = Tl.tools(spark)
    signals = R.derive_signals(findings, bands, prints, tools, "log_id")
    evidence = R.tool_evidence(frameworks, prints, exposed, used, "log_id")
    states, sources = R.tool_states(evidence, tools, "log_id")
    return signals, evidence, states, sources, tools


SIG = """sig AS (SELECT doc_id AS log_id, CASE WHEN doc_id % 4 = 0 THEN 'repeated_file_reads' ELSE 'tool_output_bloat' END AS signal FROM documents WHERE doc_id % 4 < 2 UNION ALL SELECT doc_id, 'mcp_skill_bloat' FROM documents WHERE doc_id % 7 = 0 UNION ALL SELECT doc_id, 'no_usage_visibility' FROM documents WHERE NOT (doc_id % 3 = 0 AND doc_id % 2 = 0))"""
STATE = """stt AS (SELECT doc_id AS log_id, 'ccusage' AS tool_id, CASE WHEN doc_id % 2 = 0 THEN 'active_high' ELSE 'installed_medium' END AS state FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id, 'semble', CASE WHEN doc_id % 12 = 0 THEN 'active_high' WHEN doc_id % 6 = 0 THEN 'configured_medium' ELSE 'mentioned_low' END FROM documents WHERE doc_id % 6 = 0 OR doc_id % 10 = 0)"""


@query("d15_signals", f"WITH {SIG} SELECT * FROM sig")
def _(spark, sf):
    return rec_parts(spark, sf)[0]


@query("d16_j06_tool_states", f"WITH {STATE} SELECT * FROM stt")
def _(spark, sf):
    return rec_parts(spark, sf)[2]


@query("j07_fired_rules", f"WITH {SIG} SELECT log_id, CAST(CASE signal WHEN 'mcp_skill_bloat' THEN 1 WHEN 'tool_output_bloat' THEN 3 WHEN 'repeated_file_reads' THEN 4 ELSE 8 END AS BIGINT) AS precedence, signal AS for_signal FROM sig")
def _(spark, sf):
    fired = R.fired_rules(rec_parts(spark, sf)[0], Tl.rule_signals(spark), "log_id")
    return fired.select("log_id", F.col("precedence").cast("long").alias("precedence"), "for_signal")


PICK = f"""{SIG}, {STATE}, fired AS (SELECT log_id, signal, CASE signal WHEN 'mcp_skill_bloat' THEN 1 WHEN 'tool_output_bloat' THEN 3 WHEN 'repeated_file_reads' THEN 4 ELSE 8 END AS prec FROM sig),
 pick AS (SELECT f.log_id, prec, signal, CASE prec WHEN 1 THEN 'mcp_skill_hygiene' WHEN 3 THEN 'shell_output_reducer' WHEN 4 THEN 'retrieval' ELSE 'usage_visibility' END AS class,
   CASE prec WHEN 1 THEN '' WHEN 3 THEN 'rtk' WHEN 4 THEN CASE WHEN s.state = 'active_high' THEN 'grepai' ELSE 'semble' END ELSE CASE WHEN c.state = 'active_high' THEN NULL ELSE 'ccusage' END END AS tool_id,
   CASE prec WHEN 1 THEN 'prune_first' WHEN 3 THEN 'absent' WHEN 4 THEN CASE WHEN s.state = 'configured_medium' THEN 'configured_inactive' ELSE 'absent' END ELSE CASE WHEN c.state = 'installed_medium' THEN 'installed_inactive' ELSE 'absent' END END AS reason
   FROM fired f LEFT JOIN stt s ON s.log_id = f.log_id AND s.tool_id = 'semble' LEFT JOIN stt c ON c.log_id = f.log_id AND c.tool_id = 'ccusage'),
 slots AS (SELECT *, row_number() OVER (PARTITION BY log_id ORDER BY prec) AS rn FROM pick), rec AS (SELECT log_id, CASE rn WHEN 1 THEN 'primary' ELSE 'secondary' END AS slot, class, tool_id, reason, 'rec.' || class || '.' || CASE WHEN tool_id = '' THEN 'none' ELSE tool_id END || '.' || signal AS recommendation_id FROM slots WHERE rn <= 2)"""


@query("d17_w12_recommendations", f"WITH {PICK} SELECT * FROM rec")
def _(spark, sf):
    signals, _, states, sources, tools = rec_parts(spark, sf)
    slots, _ = R.recommend(signals, states, sources, Tl.rule_signals(spark), tools, "log_id")
    return slots.select("log_id", "slot", "class", "tool_id", "reason", "recommendation_id")


@query("d17_o07_skip_notes", f"WITH {PICK} SELECT log_id, 'semble' AS tool_id, 'active_persistent' AS reason, signal AS for_signal FROM slots WHERE rn <= 2 AND tool_id = 'grepai'")
def _(spark, sf):
    signals, _, states, sources, tools = rec_parts(spark, sf)
    _, notes = R.recommend(signals, states, sources, Tl.rule_signals(spark), tools, "log_id")
    return R.skip_notes_ordered(notes, "log_id").select("log_id", F.inline("skipped"))


@query("a43_tool_state_summary", f"WITH {PICK} SELECT log_id, string_agg(recommendation_id, ',' ORDER BY recommendation_id) AS recommendation_ids, string_agg(class, ',' ORDER BY class) AS recommendation_classes, coalesce(string_agg(CASE WHEN class IN ('shell_output_reducer', 'retrieval') THEN tool_id END, ',' ORDER BY tool_id), '') AS reducer_ids, coalesce(string_agg(nullif(tool_id, ''), ',' ORDER BY tool_id), '') AS target_ids FROM rec GROUP BY log_id")
def _(spark, sf):
    signals, _, states, sources, tools = rec_parts(spark, sf)
    slots, _ = R.recommend(signals, states, sources, Tl.rule_signals(spark), tools, "log_id")
    return R.bounded_tool_state(slots, "log_id")


@query("d18_retained_recommendations", f"WITH {PICK} SELECT log_id, slot, class, tool_id, CASE WHEN log_id % 5 = 0 THEN 'unknown' ELSE reason END AS reason FROM rec")
def _(spark, sf):
    signals, _, states, sources, tools = rec_parts(spark, sf)
    slots, _ = R.recommend(signals, states, sources, Tl.rule_signals(spark), tools, "log_id")
    odd = slots.withColumn("reason", F.when(F.col("log_id") % 5 == 0, "made up").otherwise(F.col("reason")))
    return Re.recommendation_slots(odd).select("log_id", "slot", "class", "tool_id", "reason")


@query("p41_safe_events", "SELECT doc_id, CASE WHEN strlen(text) < 1024 THEN '0_1024' WHEN strlen(text) < 1048576 THEN '1024_1048576' ELSE '1048576_10485760' END AS input_size_bucket, CASE WHEN doc_id % 300 < 10 THEN '0_10' WHEN doc_id % 300 < 50 THEN '10_50' WHEN doc_id % 300 < 100 THEN '50_100' WHEN doc_id % 300 < 200 THEN '100_200' ELSE '200_plus' END AS turn_bucket, CASE WHEN doc_id % 2 = 0 THEN 'text' ELSE 'unknown' END AS parser_type, CASE WHEN doc_id % 3 = 0 THEN 'codex' ELSE 'unknown' END AS client FROM documents")
def _(spark, sf):
    d = F.col("doc_id")
    rows = Ad.table(spark, sf, "documents").select(
        "doc_id", (d % 300).alias("turns"), (d % 101).alias("score"), (d % 70).alias("waste_high"), F.octet_length("text").alias("size_bytes"),
        F.when(d % 2 == 0, "text").otherwise("zip").alias("parser_type"), F.lit("free").alias("scan_type"), (d % 5).alias("session_count"),
        F.when(d % 3 == 0, "codex").otherwise("secret-client").alias("client"), F.lit("macos").alias("operating_system"), F.lit("zsh").alias("shell"), F.lit("git").alias("version_control"),
    )
    return Re.safe_events(rows).select("doc_id", "input_size_bucket", "turn_bucket", "parser_type", "client")


@query("d20_customizations", "SELECT doc_id AS log_id, CASE doc_id % 4 WHEN 0 THEN 'retrieval-hygiene' WHEN 1 THEN 'output-budget' ELSE 'baseline-hygiene' END AS customization_id FROM documents")
def _(spark, sf):
    findings, bands, *_ = rec_inputs(spark, sf)
    return R.customizations(findings, bands, "log_id")


@query("d20_d21_remediation_tools", """SELECT log_id, tool_id, category, risk_level, install_surface FROM (SELECT doc_id AS log_id, 'ccusage' AS tool_id, 'metrics_telemetry' AS category, 'low' AS risk_level, 'local_cli_or_local_config' AS install_surface FROM documents
 UNION ALL SELECT doc_id, 'semble', 'path_limited_semantic_retrieval', 'medium', 'local_binary_plus_optional_embedding_provider' FROM documents WHERE doc_id % 4 = 0 UNION ALL SELECT doc_id, 'grepai', 'local_semantic_retrieval', 'medium', 'local_binary_plus_optional_embedding_provider' FROM documents WHERE doc_id % 4 = 0
 UNION ALL SELECT doc_id, 'context-mode', 'context_defense', 'low', 'claude_plugin_plus_mcp' FROM documents WHERE doc_id % 4 = 1 UNION ALL SELECT doc_id, 'rtk', 'advanced_shell_compression', 'high', 'local_binary_plus_claude_hook' FROM documents WHERE doc_id % 4 = 1
 UNION ALL SELECT doc_id, 'typescript-lsp', 'code_intelligence', 'medium', 'reviewed_third_party_or_official_plugin' FROM documents WHERE doc_id % 2 = 0)""")
def _(spark, sf):
    findings, bands, *_ = rec_inputs(spark, sf)
    fact = lambda df, kind, value: df.select("log_id", F.lit(kind).alias("kind"), value.alias("value"))
    managers = bands.filter(F.col("log_id") % 2 == 0)
    facts = (
        fact(bands, "always", F.lit(""))
        .unionByName(fact(findings, "finding", F.col("finding_id")))
        .unionByName(fact(managers, "package_manager", F.lit("npm")))
        .unionByName(fact(managers, "package_manager", F.lit("yarn")))
    )
    return R.remediation_tools(facts, Tl.tools(spark), "log_id").select("log_id", "tool_id", "category", "risk_level", "install_surface")


@query("d22_public_tokens", "SELECT doc_id AS log_id, unnest(CASE WHEN doc_id % 2 = 0 THEN ['package_manager:npm'] ELSE [] END || ['client:codex', 'os:macos', 'shell:zsh', 'vcs:git']) AS token FROM documents")
def _(spark, sf):
    docs = Ad.table(spark, sf, "documents").select(F.col("doc_id").alias("log_id"))
    i = F.col("log_id")
    ids = docs.select("log_id", F.lit("package_manager").alias("prefix"), F.when(i % 2 == 0, "npm").otherwise("internal-tool").alias("id"))
    labels = docs.select("log_id", F.lit("codex").alias("client"), F.lit("macos").alias("operating_system"), F.lit("zsh").alias("shell"), F.lit("git").alias("version_control"))
    allowed = spark.createDataFrame([("package_manager", x) for x in S.ids("package_manager")], "prefix string, id string")
    return R.public_tokens(ids.unionByName(ids), labels, allowed, "log_id")


# Mining ---------------------------------------------------------------------------------------

CAND = " UNION ALL ".join(
    f"SELECT page_id, '{c}' AS category, '{m}' || raw AS label, trim(regexp_replace(lower(raw), '[^a-z0-9]+', '_', 'g'), '_') AS id, '{m}' AS mark FROM (SELECT page_id, unnest(regexp_extract_all(html || ' run mcp__github_x__get or claude mcp add linear', {q(p)}, 1)) AS raw FROM pages)"
    for c, p, m in Mi.TEXT_RULES
)
CAND = f"cand AS (SELECT * FROM ({CAND}) WHERE length(id) BETWEEN 2 AND 80 AND NOT (mark = '/' AND id IN ({', '.join(q(x) for x in Mi.COMMON_NAMES)})))"


def mined(spark, sf):
    pages = Ad.table(spark, sf, "pages")
    body = F.concat("html", F.lit(" run mcp__github_x__get or claude mcp add linear"))
    return Mi.from_text(pages.select((F.col("page_id") % 3).cast("string").alias("source_id"), "url", F.col("page_id").alias("page"), body.alias("body")))


@query("d23_text_candidates", f"WITH {CAND} SELECT page_id AS page, category, id, count(*) AS n FROM cand GROUP BY ALL")
def _(spark, sf):
    return mined(spark, sf).groupBy("page", "category", "id").agg(n_rows())


@query("a36_o05_ranked_candidates", f"WITH {CAND} SELECT category, id, evidence_count, source_count, CASE WHEN evidence_count >= 8 AND source_count >= 2 THEN 'high' WHEN evidence_count >= 3 OR source_count >= 2 THEN 'medium' ELSE 'low' END AS confidence FROM (SELECT category, id, count(*) AS evidence_count, count(DISTINCT page_id % 3) AS source_count FROM cand GROUP BY ALL)")
def _(spark, sf):
    return Mi.ordered(Mi.rank_candidates(mined(spark, sf)).drop("label"))


@query("d23_registry_candidates", "SELECT id, CAST(sum(e) AS BIGINT) AS evidence_count FROM (SELECT replace(p_name, ' ', '_') AS id, 2 AS e FROM part UNION ALL SELECT replace(lower(p_brand), '#', '_'), 1 FROM part UNION ALL SELECT 'agent_' || p_partkey % 5, 2 FROM part) GROUP BY id")
def _(spark, sf):
    part = Ad.table(spark, sf, "part")
    k = F.col("p_partkey")
    server = F.struct(F.concat(F.lit("io.x/"), F.replace("p_name", F.lit(" "), F.lit("-"))).alias("name"), F.array(F.struct(F.col("p_brand").alias("name"))).alias("packages"))
    reg = F.to_json(F.struct(F.array(F.struct(server.alias("server"))).alias("servers")))
    npm = F.to_json(F.struct(F.array(F.struct(F.struct(F.concat(F.lit("agent-"), (k % 5).cast("string")).alias("name")).alias("package"))).alias("objects")))
    page = lambda kind, body: part.select(F.lit(kind).alias("source_id"), F.lit(kind).alias("kind"), F.lit("u").alias("url"), k.alias("page"), F.lit("mcp_servers").alias("category"), body.alias("body"))
    pages = page("mcp_registry", reg).unionByName(page("npm_search", npm))
    found = Mi.from_sources(pages).filter(F.col("category") == "mcp_servers")
    return Mi.rank_candidates(found).select("id", "evidence_count")


# Streams --------------------------------------------------------------------------------------


def mail_messages(spark, sf):
    e, t = F.col("event_id"), F.col("event_type")
    kind = F.when(t == "error", "Bounce").when(t == "purchase", "Complaint").when(t == "signup", "Nonsense").otherwise("Delivery")
    mine = F.concat(F.lit("U"), F.col("user_id").cast("string"), F.lit("@X.example"))
    inner = F.to_json(F.struct(
        kind.alias("eventType"),
        F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"), e.cast("string").alias("messageId"), F.array(mine, F.lit("b@x.example")).alias("destination")).alias("mail"),
        F.struct(F.lit("Permanent").alias("bounceType"), F.array(F.struct(mine.alias("emailAddress"))).alias("bouncedRecipients")).alias("bounce"),
        F.struct(F.lit("abuse").alias("complaintFeedbackType"), F.array(F.struct(mine.alias("emailAddress"))).alias("complainedRecipients")).alias("complaint"),
    ))
    outer = F.to_json(F.struct(F.when(e % 10 == 0, "Other").otherwise("Notification").alias("Type"), inner.alias("Message")))
    return Ad.table(spark, sf, "events").select(outer.alias("value"))


MAILS = """mails AS (SELECT event_id, ts, user_id, CASE WHEN event_id % 10 = 0 THEN 'unsupported envelope' WHEN event_type = 'signup' THEN 'unsupported event type' END AS reject, CASE event_type WHEN 'error' THEN 'bounce' WHEN 'purchase' THEN 'complaint' WHEN 'signup' THEN NULL ELSE 'delivery' END AS type, event_type FROM events)"""


@query("t02_mail_events", f"WITH {MAILS} SELECT reject, type, email_hash, count(*) AS n FROM (SELECT reject, type, sha256('u' || user_id || '@x.example') AS email_hash FROM mails WHERE reject IS NULL UNION ALL SELECT reject, type, sha256('b@x.example') FROM mails WHERE reject IS NULL AND type = 'delivery' UNION ALL SELECT reject, type, NULL FROM mails WHERE reject IS NOT NULL) GROUP BY ALL")
def _(spark, sf):
    return St.parse_mail_events(mail_messages(spark, sf)).groupBy("reject", "type", "email_hash").agg(n_rows())


def stream_to(spark, stream, base: str):
    """Run a stream to its end and return the rows of all batches, with their number as `_batch`."""
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )
    out = base + "/out"

    def sink(batch, batch_id):
        batch.withColumn("_batch", F.lit(batch_id)).write.mode("append").parquet(out)

    job = stream.writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", base + "/state").trigger(availableNow=True).start()
    job.awaitTermination()
    return spark.read.parquet(out)


def run_stream(spark, source, build, name: str):
    """Write `source` as files, stream them through `build`, return the rows of all batches."""
    base = scratch(spark, name)
    source.write.parquet(base + "/in")
    return stream_to(spark, build(spark.readStream.schema(source.schema).parquet(base + "/in")), base)


@query("t03_suppression_stream", f"WITH {MAILS} SELECT sha256('u' || user_id || '@x.example') AS email_hash, count(*) FILTER (type = 'bounce') AS bounce_count, count(*) FILTER (type = 'complaint') AS complaint_count, strftime(min(date_trunc('second', ts)), '%Y-%m-%d %H:%M:%S') AS suppressed_at FROM mails WHERE reject IS NULL AND type IN ('bounce', 'complaint') GROUP BY user_id")
def _(spark, sf):
    rows = run_stream(spark, mail_messages(spark, sf), lambda s: St.suppression_stream(St.parse_mail_events(s), once=True), "t03")
    last = rows.groupBy("email_hash").agg(F.max_by(F.struct("bounce_count", "complaint_count", "suppressed_at"), F.struct("_batch", F.col("bounce_count") + F.col("complaint_count"))).alias("l"))
    return last.select("email_hash", "l.bounce_count", "l.complaint_count", F.date_format("l.suppressed_at", "yyyy-MM-dd HH:mm:ss").alias("suppressed_at"))


@query("t04_usage_stream", "SELECT strftime(ts, '%Y-%m-%d') AS day, 'path' AS dimension, '/p/' || event_id % 9 AS key, count(*) AS count FROM events GROUP BY ALL")
def _(spark, sf):
    rows = run_stream(spark, usage_rows(spark, sf).select("timestamp", "path"), lambda s: St.usage_stream(s, "3650 days"), "t04")
    return rows.groupBy(F.date_format("day", "yyyy-MM-dd").alias("day"), "dimension", "key").agg(F.max("count").alias("count"))


LATE = """b AS (SELECT min(epoch_us(ts)) AS lo, max(epoch_us(ts)) AS hi FROM events),
 r AS (SELECT ts, event_id, CASE WHEN event_id % 10 = 0 THEN 2 ELSE least(2, (epoch_us(ts) - lo) * 3 // (hi - lo + 1)) END AS batch FROM events, b),
 m AS (SELECT max(epoch_us(ts)) - 86400000000 AS mark FROM r WHERE batch < 2)"""


@query("t04_late_rows", f"WITH {LATE} SELECT strftime(ts, '%Y-%m-%d') AS day, batch = 2 AND epoch_us(ts) < mark AS late, '/p/' || event_id % 9 AS path, count(*) AS count FROM r, m GROUP BY ALL")
def _(spark, sf):
    """Three batches in the order of time, but every tenth event comes with the last one."""
    e, us = F.col("event_id"), F.unix_micros("timestamp")
    path = F.concat(F.lit("/p/"), (e % 9).cast("string"))
    rows = Ad.table(spark, sf, "events").select(e, F.col("ts").cast("timestamp").alias("timestamp"), path.alias("path"))
    low, high = rows.agg(F.min(us), F.max(us)).first()
    third = F.when(e % 10 == 0, 2).otherwise(F.least(F.lit(2), F.floor((us - low) * 3 / (high - low + 1))))
    base = scratch(spark, "t04-late")
    for k in range(3):
        rows.filter(third == k).drop("event_id").coalesce(1).write.mode("append").parquet(base + "/in")
    stream = spark.readStream.schema("timestamp timestamp, path string").option("maxFilesPerTrigger", 1).parquet(base + "/in")
    job = stream.writeStream.foreachBatch(St.usage_batches(base + "/out")).option("checkpointLocation", base + "/state")
    job.trigger(availableNow=True).start().awaitTermination()
    day = lambda c: F.date_format(c, "yyyy-MM-dd").alias("day")
    counted = spark.read.parquet(base + "/out/counts").filter("dimension = 'path'")
    counted = counted.select(day("day"), F.lit(False).alias("late"), F.col("key").alias("path"), "count")
    late = spark.read.parquet(base + "/out/late").select(day("timestamp"), F.lit(True).alias("late"), "path", F.lit(1).alias("count"))
    return counted.unionByName(late).groupBy("day", "late", "path").agg(F.sum("count").alias("count"))


@query("t05_open_requests_stream", f"WITH {RPC}, p AS (SELECT *, lag(kind) OVER (PARTITION BY log_id, id ORDER BY turn) AS before FROM rpc WHERE kind <> 'message') SELECT log_id, turn, kind FROM p WHERE kind = 'tool_call' OR before = 'tool_call'")
def _(spark, sf):
    t = F.col("event_type")
    kind = F.when(t.isin("view", "click"), "tool_call").when(t.isin("error", "purchase"), "tool_result")
    rows = Ad.table(spark, sf, "events").select(
        F.col("user_id").alias("log_id"), F.concat(F.lit("r"), (F.col("user_id") % 3).cast("string")).alias("request_id"),
        F.col("event_id").alias("turn"), F.lit(0).cast("long").alias("seq"), kind.alias("kind"),
    ).filter(F.col("kind").isNotNull())
    return run_stream(spark, rows, St.matched_stream, "t05").select("log_id", "turn", "kind")


@query("t06_new_hashes_stream", "SELECT DISTINCT sha256(text) AS hash FROM documents")
def _(spark, sf):
    rows = Ad.table(spark, sf, "documents").select(F.sha2("text", 256).alias("hash"), F.lit("2024-01-01").cast("timestamp").alias("seen_at"))
    return run_stream(spark, rows, lambda s: St.new_hashes(s, "seen_at"), "t06").select("hash")


@query("t07_retry_stream", f"WITH {RETRY_T}, {RETRY_CALLS}, {RETRY_SEG}, {RETRY_LOOPS} SELECT log_id, CAST(args_hashed_retry_loops AS BIGINT) AS args_hashed_retry_loops FROM loops")
def _(spark, sf):
    rows = run_stream(spark, ev_calls(spark, sf).select("log_id", "pos", "kind", "tool", "args_hash", "parent_hash", "error"), St.retry_stream, "t07")
    return rows.groupBy("log_id").agg(F.max("longest").alias("args_hashed_retry_loops"))


@query("t01_log_intake", f"WITH {LINES} SELECT count(*) AS turns FROM lines")
def _(spark, sf):
    base = scratch(spark, "t01")
    docs = Ad.table(spark, sf, "documents").select(F.col("text").alias("value"), (F.col("doc_id") % 8).alias("part"))
    docs.repartition(8, "part").select("value").write.text(base + "/in")

    def handle(batch, batch_id):
        turns = splits.numbered_lines(cut_lineage(splits.pieces(batch)))
        turns.groupBy("log").agg(n_rows("turns")).write.mode("append").parquet(base + "/out")

    St.intake_lines(spark, base + "/in", base + "/state", handle, glob="*.txt").awaitTermination()
    return spark.read.parquet(base + "/out").agg(F.sum("turns").alias("turns"))


@query("t01_growing_sessions", f"WITH {METRICS} SELECT * FROM metrics")
def _(spark, sf):
    """Sessions in chunks of seven turns that arrive in three batches out of order; the last counters of each."""
    turns = ev_turns(spark, sf)
    chunk = F.floor(F.col("pos") / 7) * 7
    size = F.count(F.lit(1)).alias("size")
    sizes = turns.groupBy("log_id", chunk.alias("at")).agg(size)
    read = F.when(F.col("event_type") == "view", F.array(F.concat(F.lit("file"), F.get_json_object("props", "$.k"))))
    rows = turns.withColumn("at", chunk).join(sizes, ["log_id", "at"]).select(
        F.col("log_id").cast("string").alias("log_id"), "at", (F.col("pos") - F.col("at")).alias("line"),
        F.col("size").alias("lines"), "size", "tokens", "is_tool", "is_error", F.coalesce(read, F.array().cast("array<string>")).alias("files"),
    )
    base = scratch(spark, "t01-growing")
    rows.repartition(3, F.hash("log_id", "at") % 3).write.parquet(base + "/in")
    files = max(1, -(-len(spark.read.parquet(base + "/in").inputFiles()) // 3))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(base + "/in")
    out = stream_to(spark, growing.growing_sessions(stream), base)
    last = out.groupBy("log_id").agg(F.max_by(F.struct(*out.columns), "turns").alias("l")).select("l.*")
    return last.select(F.col("log_id").cast(turns.schema["log_id"].dataType).alias("log_id"), *[c for c in last.columns if c not in ("log_id", "read_to", "waiting", "_batch")])


# Whole reports of logs --------------------------------------------------------------------------


def kept_events(spark, sf):
    """Retained events of the documents read as logs."""
    docs = Ad.table(spark, sf, "documents")
    logs = docs.select(F.col("doc_id").alias("log_id"), F.lit("claude_code").alias("source_id"), F.col("text").alias("content"))
    sizes = docs.select(
        F.col("doc_id").alias("log_id"), F.lit("claude_code").alias("source_id"),
        F.octet_length("text").alias("size_bytes"), F.sha2("text", 256).alias("content_hash_sha256"),
    )
    analysis = An.analyze(logs, only=("claude_code",), cut=cut_lineage)
    return Rp.retained(analysis, Rp.full_report(analysis), "1", sizes)


@query(
    "r02_retained_events",
    f"""WITH {LINES}, n AS (SELECT log_id, count(*) AS turns FROM lines GROUP BY log_id)
    SELECT doc_id AS log_id, 'free' AS scan_type, CASE WHEN strlen(text) < 1024 THEN '0_1024' WHEN strlen(text) < 1048576 THEN '1024_1048576' ELSE '1048576_10485760' END AS input_size_bucket,
      CASE WHEN turns < 10 THEN '0_10' WHEN turns < 50 THEN '10_50' WHEN turns < 100 THEN '50_100' WHEN turns < 200 THEN '100_200' ELSE '200_plus' END AS turn_bucket,
      sha256(text) AS content_hash, CASE WHEN regexp_matches(lower(text), 'jj ') THEN 'jj' WHEN regexp_matches(lower(text), 'git ') THEN 'git' ELSE 'unknown' END AS version_control
    FROM documents JOIN n ON doc_id = log_id""",
)
def _(spark, sf):
    e = kept_events(spark, sf)
    return e.select(
        "log_id", "scan_type", "input_size_bucket", "turn_bucket",
        F.col("analyzed_log_hashes")[0]["content_hash_sha256"].alias("content_hash"), F.col("ecosystem.version_control").alias("version_control"),
    )


@query("r03_cohort_from_logs")
def _(spark, sf):
    """Counters of the kept events; no SQL gives the findings and recommendations behind them."""
    return U.cohort_summary(kept_events(spark, sf), minimum=1)[0]
