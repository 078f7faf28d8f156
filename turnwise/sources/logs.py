"""Transcript files: discovery, source catalogue, assembly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnwise.functions import json_nodes as J
from turnwise.functions import text as X
from turnwise.operators import blocks

# Id, label, accept pattern over the path. `(?i)` where case does not matter.
SOURCES = (
    ("claude_code", "Claude Code", r"(?i)\.jsonl$"),
    ("codex", "Codex", r"(?i)\.jsonl$"),
    (
        "copilot",
        "GitHub Copilot",
        r"(?i)(/session-state/(.*/)?events\.jsonl|/logs/.*\.log|/(emptywindow)?chatsessions/.*\.json)$",
    ),
    ("claude_desktop", "Claude Desktop", r"(?i)(^|/)(audit\.jsonl|local_[^/]*\.json)$"),
    ("claude_desktop_mcp", "Claude Desktop MCP", r"(?i)(^|/)(mcp|mcp-server-[^/]*)\.log$"),
    ("cursor", "Cursor", r"/agent-transcripts/.*\.(?i:jsonl)$"),
    ("kiro_cli", "Kiro CLI", r"(?i)(^|/)kiro-chat\.log$"),
    ("kiro_ide", "Kiro IDE", r"(?i)(^|/)([^/]*kiro[^/]*|main|renderer|terminal|telemetry)\.log$"),
    ("antigravity", "Google Antigravity", r"(?i)(^|/)transcript\.jsonl$"),
    ("opencode", "OpenCode", r"(?i)/opencode/.*\.json$"),
)

# The first rule whose pattern occurs in the lower-case path names the source.
PATH_RULES = (
    ("claude_desktop", r"/local-agent-mode-sessions/|/claude-code-sessions/"),
    ("claude_desktop", r"/claude/(.*/)?audit\.jsonl$"),
    ("claude_desktop_mcp", r"/logs/claude/(.*/)?(mcp|mcp-server-[^/]*)\.log$"),
    ("codex", r"/\.codex/|codex[^/]*$|(^|/)rollout-[^/]*$"),
    ("copilot", r"/\.copilot/|/github\.copilot|/github/copilot|/chatsessions/"),
    ("cursor", r"/\.cursor/|/application support/cursor/|/cursor/user/"),
    ("opencode", r"/opencode/"),
    ("kiro_cli", r"/kiro-log/|/\.kiro/"),
    ("kiro_ide", r"/application support/kiro/|/kiro/user/"),
    ("antigravity", r"/antigravity"),
    ("claude_code", r"/\.claude/"),
)
EXPOSURE_HEADER = "Available MCP servers:\n"


def infer_source(path: Column, rules=PATH_RULES) -> Column:
    """Source of a path by ordered rules; 'unknown' if none fits."""
    lowered = F.lower(F.translate(path, "\\", "/"))
    out = None
    for source, pattern in rules:
        test = lowered.rlike(pattern)
        out = F.when(test, source) if out is None else out.when(test, source)
    return out.otherwise("unknown")


def with_source(files: DataFrame, path: str = "path", out: str = "source_id") -> DataFrame:
    """Add the inferred source, computed once per row."""
    return J.settled(files, {out: infer_source(F.col(path))})


def accepted(path: Column, source: Column) -> Column:
    """Whether a source takes files of this path."""
    out = None
    for source_id, _, pattern in SOURCES:
        test = (source == source_id) & path.rlike(pattern)
        out = test if out is None else out | test
    return F.coalesce(out, F.lit(False))


def catalogue(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(SOURCES), "source_id string, label string, accept string")


def matching_sources(files: DataFrame, path: str = "path") -> DataFrame:
    """(file, source) pairs by accept pattern (S04). The catalogue is ten rows."""
    spark = files.sparkSession
    cat = F.broadcast(catalogue(spark).select("source_id", "label", "accept"))
    return files.join(cat, F.expr(f"{path} rlike accept")).drop("accept")


def read_logs(
    spark: SparkSession,
    paths: str | list[str],
    glob: str | None = None,
    min_bytes: int = 0,
    max_bytes: int | None = None,
    source: str | None = None,
) -> DataFrame:
    """Every file under the roots as one row (S03). Sizes are checked before reading.

    One row per file keeps the line order. With `max_bytes`, larger files stay as rows without
    content, marked `too_large`. Spark's listing skips folders whose name starts with a dot, so name such a folder as a root.
    """
    roots = [paths] if isinstance(paths, str) else list(dict.fromkeys(paths))
    files = spark.read.text(roots, wholetext=True, recursiveFileLookup=True, pathGlobFilter=glob)
    df = files.select(
        F.col("value").alias("content"),
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_modification_time").alias("mod_time"),
        F.col("_metadata.file_size").alias("size_bytes"),
    )
    df = df.filter(F.col("size_bytes") >= min_bytes)
    if max_bytes is not None:
        over = F.col("size_bytes") > max_bytes
        df = df.withColumns({"too_large": over, "content": F.when(~over, F.col("content"))})
    picked = infer_source(F.col("path")) if source is None else F.lit(source)
    return df.withColumn("source_id", picked).withColumn(
        "log_id", F.substring(F.sha2("path", 256), 1, 16)
    )


def list_files(spark: SparkSession, roots: list[str], glob: str | None = None) -> DataFrame:
    """Path, time and size of files; the content is not read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(list(dict.fromkeys(roots))).select(
        "path", F.col("modificationTime").alias("mod_time"), F.col("length").alias("size_bytes")
    )


# MCP headers (S13) -----------------------------------------------------------------------


def server_of_tool_key(key: Column) -> Column:
    """Server part of an enabled-tool key, reduced to name characters."""
    parts = F.split(key, ":")
    name = F.when(F.size(parts) >= 3, F.element_at(parts, -2)).otherwise(key)
    kept = F.regexp_replace(F.regexp_replace(F.trim(name), "[ .]", "_"), "[^A-Za-z0-9_-]", "")
    return F.substring(kept, 1, 64)


def with_exposure_header(logs: DataFrame) -> DataFrame:
    """Put the servers that the log's metadata names in front of its text.

    Desktop sessions list them as keys of `enabledMcpTools`, MCP logs in the file name.
    """
    parsed = F.try_parse_json("content")
    keys = F.map_keys(
        F.try_variant_get(parsed, "$.enabledMcpTools", "map<string,variant>")
    )
    from_session = F.array_sort(
        F.array_distinct(F.filter(F.transform(keys, server_of_tool_key), lambda s: s != ""))
    )
    from_name = F.regexp_extract(F.lower("path"), r"mcp-server-([^/]*)\.log$", 1)
    is_session = (F.col("source_id") == "claude_desktop") & F.lower("path").endswith(".json")
    servers = (
        F.when(is_session, from_session)
        .when((F.col("source_id") == "claude_desktop_mcp") & (from_name != ""), F.array(server_of_tool_key(from_name)))
    )
    bullets = F.array_join(F.transform(servers, lambda s: F.concat(F.lit("- "), s, F.lit("\n"))), "")
    header = F.concat(F.lit(EXPOSURE_HEADER), bullets)
    return logs.withColumn(
        "content",
        F.when(F.coalesce(F.size(servers), F.lit(0)) > 0, F.concat(header, "content")).otherwise(
            F.col("content")
        ),
    )


# Session assembly -------------------------------------------------------------------------


def assemble_messages(messages: DataFrame, parts: DataFrame) -> DataFrame:
    """Session lines in order: messages by (time, path), each followed by its parts.

    `messages` has session_id, message_id, path, mod_time, body; `parts` message_id, path,
    mod_time, body. The result numbers rows per session through `order` columns instead of
    gluing a session together.
    """
    m = messages.filter(F.trim("body") != "")
    head = m.select(
        "session_id",
        F.struct(
            F.col("mod_time").alias("msg_time"), F.col("path").alias("msg_path"),
            F.lit(0).alias("is_part"), F.lit(None).cast(dict(parts.dtypes)["mod_time"]).alias("part_time"),
            F.lit("").alias("part_path"),
        ).alias("order"),
        F.trim("body").alias("raw"),
    )
    p = parts.filter(F.trim("body") != "").select(
        "message_id",
        F.col("mod_time").alias("_pt"),
        F.col("path").alias("_pp"),
        F.trim("body").alias("raw"),
    )
    tail = (
        m.filter(F.trim("message_id") != "")
        .select("session_id", "message_id", "mod_time", "path")
        .join(p, "message_id")
        .select(
            "session_id",
            F.struct(
                F.col("mod_time").alias("msg_time"), F.col("path").alias("msg_path"),
                F.lit(1).alias("is_part"), F.col("_pt").alias("part_time"), F.col("_pp").alias("part_path"),
            ).alias("order"),
            "raw",
        )
    )
    return head.unionByName(tail)


def session_stats(messages: DataFrame, parts: DataFrame) -> DataFrame:
    """Total bytes and latest time over messages and parts."""
    own = messages.select("session_id", "size_bytes", "mod_time")
    theirs = parts.join(messages.select("session_id", "message_id"), "message_id").select(
        "session_id", "size_bytes", "mod_time"
    )
    return (
        own.unionByName(theirs)
        .groupBy("session_id")
        .agg(F.sum("size_bytes").cast("long").alias("size_bytes"), F.max("mod_time").alias("mod_time"))
    )


def copilot_rows(sessions: DataFrame, log: str = "log_id", content: str = "content") -> DataFrame:
    """Rows of chat-session JSON: title, requests, answers, usage, tools."""
    rows = sessions.select(log, F.col(content).alias("_c"))
    rows = rows.withColumn("_v", F.try_parse_json("_c"))

    def got(value, *paths, kind="string"):
        return F.coalesce(*[F.try_variant_get(value, p, kind) for p in paths])

    title = F.trim(F.coalesce(got(F.col("_v"), "$.customTitle", "$.title"), F.lit("")))
    titles = rows.filter(title != "").select(
        log, F.lit(-1).alias("_r"), F.lit(0).alias("_o"),
        F.to_json(F.struct(F.lit("message").alias("type"), F.lit("system").alias("role"), title.alias("content"))).alias("raw"),
    )
    requests = F.try_variant_get("_v", "$.requests", "array<variant>")
    whole = F.coalesce(requests, F.array("_v"))
    reqs = rows.filter(F.col("_v").isNotNull()).select(log, F.posexplode(whole).alias("_r", "_q"))

    parts_of = ("text", "content", "value", "message")

    def plain(value):
        """Text of a string, or of the first text-like field of an object."""
        fields = [F.try_variant_get(value, f"$.{k}", "variant") for k in parts_of]
        own = [
            F.when(F.schema_of_variant(v) == "STRING", F.nullif(F.trim(F.try_variant_get(v, "$", "string")), F.lit("")))
            for v in (value, *fields)
        ]
        return F.coalesce(*own, F.lit(""))

    def text_of(*keys):
        first = F.coalesce(*[F.try_variant_get("_q", f"$.{k}", "variant") for k in keys])
        items = F.try_variant_get(first, "$", "array<variant>")
        listed = F.array_join(F.filter(F.transform(items, lambda v: plain(v)), lambda t: t != ""), "\n")
        return F.coalesce(F.nullif(plain(first), F.lit("")), listed, F.lit(""))

    def said(role, order, *keys):
        body = text_of(*keys)
        return reqs.filter(body != "").select(
            log, "_r", F.lit(order).alias("_o"),
            F.to_json(F.struct(F.lit("message").alias("type"), F.lit(role).alias("role"), body.alias("content"))).alias("raw"),
        )

    asked = said("user", 1, "message", "prompt", "request", "input")
    answered = said("assistant", 2, "response", "responses", "answer")
    nodes = reqs.withColumn("nodes", J.json_nodes(F.to_json("_q")))
    nodes, d = J.with_doc(nodes, "nodes", "_d_")
    counters = (
        "input_tokens", "prompt_tokens", "cached_input_tokens", "cache_read_input_tokens",
        "cache_creation_input_tokens", "output_tokens", "completion_tokens",
    )
    amounts = [F.nullif(J.first_int(d, k), F.lit(0).cast("long")).alias(k) for k in counters]
    used = nodes.filter(F.coalesce(*[c for c in amounts]).isNotNull()).select(
        log, "_r", F.lit(3).alias("_o"),
        F.to_json(F.struct(F.lit("token_count").alias("type"), *amounts)).alias("raw"),
    )
    objects = F.transform(F.filter(d.nodes, lambda n: n["kind"] == "object"), lambda n: n["path"])
    objs = nodes.select("*", F.posexplode(objects).alias("_k", "root"))
    root = F.col("root")
    tool = J.direct_string(d, "toolName", "tool_name", "tool", "toolId", "tool_id", root=root)
    kind = F.lower(F.concat_ws(" ", J.direct_string(d, "type", "kind", "event", "phase", "status", root=root), tool))
    out_path = J.first_present(d, "output", "result", "tool_output", root=root)
    arg_path = J.first_present(d, "arguments", "args", "input", "command", root=root)
    usable = (tool != "") & (kind.rlike("tool|function|terminal") | out_path.isNotNull() | arg_path.isNotNull())
    result = out_path.isNotNull() | kind.rlike("result|output")
    node_text = lambda p: F.try_element_at(F.filter(d.nodes, lambda n: n["path"] == p), F.lit(1))["text"]
    tools = objs.filter(usable).select(
        log, "_r", (F.lit(4) + F.col("_k")).alias("_o"),
        F.to_json(
            F.struct(
                F.when(result, "tool_result").otherwise("tool_call").alias("type"),
                tool.alias("tool"),
                F.nullif(J.direct_string(d, "callId", "call_id", "id", "toolCallId", "tool_call_id", root=root), F.lit("")).alias("call_id"),
                F.when(result, node_text(out_path)).alias("output"),
                F.when(~result, F.coalesce(node_text(arg_path), J.value_hash(d, arg_path))).alias("arguments"),
            )
        ).alias("raw"),
    )
    parts = [titles, asked, answered, used, tools]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part.select(log, F.col("_r").cast("int").alias("_r"), F.col("_o").cast("int").alias("_o"), "raw"))
    order = Window.partitionBy(log).orderBy("_r", "_o")
    return out.withColumn("turn", F.row_number().over(order).cast("long")).select(log, "turn", "raw")


# Exported state tables ----------------------------------------------------------------------


def key_type(key: Column, prefixes: list[str]) -> Column:
    """Label of the first prefix a key starts with; NULL for other keys."""
    lowered = F.lower(key)
    out = F.lit(None).cast("string")
    for prefix in reversed(prefixes):
        name = F.lit(prefix.strip().lower().removesuffix(":"))
        label = F.regexp_replace(F.translate(name, "-.", "__"), "[^a-z0-9_]", "")
        out = F.when(
            lowered.startswith(prefix.lower()), F.coalesce(F.nullif(label, F.lit("")), F.lit("state"))
        ).otherwise(out)
    return out


def value_text(value: Column, max_bytes: int | None = None) -> Column:
    """UTF-8 text of a stored value, of its first `max_bytes` if given; even-length hex is decoded; '' if unreadable."""
    raw = value if max_bytes is None else F.substring(value, 1, max_bytes)
    text = F.when(F.is_valid_utf8(raw.cast("string")), X.trimmed(raw.cast("string")))
    is_hex = (F.length(text) >= 8) & (F.length(text) % 2 == 0) & text.rlike("^[0-9A-Fa-f]+$")
    plain = F.unhex(F.when(is_hex, text)).cast("string")
    decoded = F.when(F.is_valid_utf8(plain), X.trimmed(plain))
    return F.coalesce(decoded, text, F.lit(""))


def _ranked(rows: DataFrame, by: str | None, order: list[Column], k: int | None) -> DataFrame:
    """Add `rank` per store. A limit runs before the shuffle; without one, stores are numbered in blocks."""
    if k is not None:
        part = [by] if by else [F.lit(0)]
        rank = F.row_number().over(Window.partitionBy(*part).orderBy(*order))
        return rows.withColumn("rank", rank).filter(F.col("rank") <= k)
    names = [f"_o{i}" for i in range(len(order))]
    rows = rows.withColumns(dict(zip(names, order)) | {"_store": F.col(by) if by else F.lit(0)})
    placed = blocks.dense_position(rows, "_store", names, out="rank")
    return placed.withColumn("rank", (F.col("rank") + 1).cast("int")).drop("_store", *names)


def state_rows(
    table: DataFrame, prefixes: list[str], by: str | None = None, k: int | None = None, max_bytes: int | None = None
) -> DataFrame:
    """State rows per store in key order as transcript lines.

    `table` has key (string) and value (binary). `k` keeps the first rows of a store, `max_bytes`
    the start of a value; `truncated` marks what was cut.
    """
    rows = table.withColumn("key_type", key_type(F.col("key"), prefixes)).filter(
        F.col("key_type").isNotNull()
    )
    rows = _ranked(rows, by, [F.col("key")], k)
    rows = rows.withColumn("content", value_text(F.col("value"), max_bytes)).filter(F.col("content") != "")
    keep = [by] if by else []
    return rows.select(
        *keep, "key", "rank", "key_type", "content",
        (F.lit(False) if max_bytes is None else F.octet_length("value") > max_bytes).alias("truncated"),
    )


def diagnostic_rows(
    table: DataFrame, by: str | None = None, k: int | None = None, max_field: int | None = None, max_bytes: int | None = None
) -> DataFrame:
    """Diagnostic rows, newest first (S11). Missing columns count as empty.

    `k` keeps the newest rows of a store, `max_field` and `max_bytes` the start of fields and content.
    """
    have = {c.lower(): c for c in table.columns}

    def cell(*names):
        cols = [
            F.nullif(F.trim(F.col(have[n]).cast("string")), F.lit("")) for n in names if n in have
        ]
        return F.coalesce(*cols, F.lit("")) if cols else F.lit("")

    if "ts" in have and "ts_nanos" in have:
        newest = [have["ts"], have["ts_nanos"]]
    else:
        first = next((n for n in ("ts", "timestamp", "created_at", "rowid") if n in have), None)
        newest = [have[first]] if first else []
    if k is None:
        # Numbered from the oldest on, then counted from the other end.
        rows = _ranked(table, by, [F.col(c) for c in newest] or [F.lit(0)], None)
        store = F.col(by) if by else F.lit(0)
        last = rows.groupBy(store.alias("_store")).agg(F.max("rank").alias("_last"))
        rows = rows.withColumn("_store", store).join(last, "_store")
        rows = rows.withColumn("rank", F.col("_last") + 1 - F.col("rank")).drop("_store", "_last")
    else:
        rows = _ranked(table, by, [F.desc(c) for c in newest] or [F.lit(0)], k)
    level = F.lower(cell("level", "severity"))
    first_of = lambda c, n: c if n is None else F.substring(c, 1, n)
    bounded = lambda c: first_of(c, max_field)
    keep = [by] if by else []
    return rows.select(
        *keep,
        "rank",
        level.alias("level"),
        bounded(cell("target", "logger", "module")).alias("target"),
        F.coalesce(cell("estimated_bytes", "bytes").try_cast("long"), F.lit(0)).alias("estimated_bytes"),
        level.contains("error").alias("error"),
        bounded(cell("ts", "timestamp", "created_at")).alias("timestamp"),
        first_of(cell("feedback_log_body", "message", "body", "text", "content", "error"), max_bytes).alias("content"),
        bounded(cell("module_path", "module", "target")).alias("module"),
        (cell("file", "filename", "path") != "").alias("has_file"),
        (cell("line", "line_number") != "").alias("has_line"),
    )


INDEX_KEYS = ("path", "session_path", "log_path", "file", "filepath", "filename")


def indexed_paths(index: DataFrame, raw: str = "raw", root: str = "") -> DataFrame:
    """Distinct log paths a session index names (S12): known keys first, else any string."""
    nodes, d = J.with_doc(index.withColumn("nodes", J.json_nodes(raw)), "nodes", "_d_")
    is_log = lambda t: F.lower(F.trim(t)).endswith(".jsonl")
    own = []
    for key in INDEX_KEYS:
        text = F.try_element_at(d.strings, J.at("", key))
        own.append(F.when(is_log(text), text))
    any_text = F.try_element_at(
        F.filter(d.nodes, lambda n: (n["kind"] == "string") & is_log(n["text"])), F.lit(1)
    )["text"]
    found = F.trim(F.coalesce(*own, any_text))
    absolute = F.when(found.startswith("/"), found).otherwise(F.concat(F.lit(root), found))
    return nodes.select(absolute.alias("path")).filter(F.col("path").isNotNull()).distinct()


def indexed_logs(index: DataFrame, files: DataFrame, raw: str = "raw", root: str = "") -> DataFrame:
    return files.join(indexed_paths(index, raw, root), "path")
