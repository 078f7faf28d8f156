"""Projections, predicates and scalar functions (P and F operators)."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnwise.catalog import query
from turnwise.functions import buckets as B
from turnwise.functions import json_nodes as J
from turnwise.functions import literals
from turnwise.functions import text as X
from turnwise.functions import web as Wb
from turnwise.functions.json_nodes import settled
from turnwise.operators import mining, retained, tooling
from turnwise.operators import usage as U
from turnwise.plans.adapters import requests_from_pages, table, texts
from turnwise.registry import detectors, signatures


def q(text: str) -> str:
    """SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


def lst(items) -> str:
    return ", ".join(q(i) for i in items)


def scrub_sql(source: str, key: str, text: str) -> str:
    """CTE chain: each step counts one family and replaces it."""
    steps = [f"s0 AS (SELECT {key}, {text} AS t FROM {source})"]
    for i, (family, pattern) in enumerate(X.SECRET_RULES):
        kept = "".join(f", {f}" for f, _ in X.SECRET_RULES[:i])
        steps.append(
            f"s{i + 1} AS (SELECT {key}{kept}, len(regexp_extract_all(t, {q(pattern)})) AS {family}, "
            f"regexp_replace(t, {q(pattern)}, {q(X.redaction_marker(family))}, 'g') AS t FROM s{i})"
        )
    return "WITH " + ", ".join(steps) + f", scrubbed AS (SELECT * FROM s{len(X.SECRET_RULES)}) "


SCRUB = scrub_sql("documents", "doc_id, source", "text")
FAMILY_ROWS = " UNION ALL ".join(
    f"SELECT doc_id, source, '{f}' AS family, {f} AS n FROM scrubbed" for f, _ in X.SECRET_RULES
)


def scrubbed(spark, sf):
    return X.with_scrubbed(texts(spark, sf, "documents"), "text")


@query(
    "p01_scrub_counts",
    SCRUB + f"SELECT family, CAST(sum(n) AS BIGINT) AS redactions, count(*) AS documents "
    f"FROM ({FAMILY_ROWS}) WHERE n > 0 GROUP BY family",
)
def _(spark, sf):
    rows = scrubbed(spark, sf).select("doc_id", F.inline("redactions"))
    return rows.groupBy("family").agg(
        F.sum("count").alias("redactions"), F.count(F.lit(1)).alias("documents")
    )


@query("p01_scrubbed_text", SCRUB + "SELECT doc_id, sha256(t) AS text_hash FROM scrubbed")
def _(spark, sf):
    return scrubbed(spark, sf).select("doc_id", F.sha2("scrubbed", 256).alias("text_hash"))


@query(
    "p02_redaction_total",
    SCRUB + f"SELECT source, CAST(sum(n) AS BIGINT) AS secrets_redacted FROM ({FAMILY_ROWS}) GROUP BY source",
)
def _(spark, sf):
    total = F.aggregate("redactions", F.lit(0).cast("long"), lambda a, r: a + r["count"])
    return scrubbed(spark, sf).groupBy("source").agg(F.sum(total).alias("secrets_redacted"))


@query(
    "p05_command_extraction",
    """WITH c AS (SELECT conv_id, turn, role || CASE turn % 3 WHEN 0 THEN ' ran Command: ' WHEN 1 THEN ' $ ' ELSE ' said ' END || text AS t FROM conversations),
    m AS (SELECT *, strpos(lower(t), 'command:') AS a, strpos(lower(t), '$ ') AS b, strpos(lower(t), 'bash -lc') AS d FROM c)
    SELECT conv_id, turn, sha256(regexp_replace(CASE WHEN a > 0 THEN substr(t, a + 8) WHEN b > 0 THEN substr(t, b + 2) WHEN d > 0 THEN substr(t, d + 8) ELSE '' END, '^\\s+|\\s+$', '', 'g')) AS command_hash FROM m""",
)
def _(spark, sf):
    mark = (
        F.when(F.col("turn") % 3 == 0, " ran Command: ").when(F.col("turn") % 3 == 1, " $ ").otherwise(" said ")
    )
    text = F.concat("role", mark, "text")
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", F.sha2(X.command_in(text), 256).alias("command_hash")
    )


@query(
    "p06_token_estimate",
    "SELECT lang, CAST(sum(greatest(1, strlen(text) // 4)) AS BIGINT) AS tokens, count(*) AS n FROM documents GROUP BY lang",
)
def _(spark, sf):
    return table(spark, sf, "documents").groupBy("lang").agg(
        F.sum(X.token_estimate(F.col("text"))).alias("tokens"), F.count(F.lit(1)).alias("n")
    )


READ_TEXT_SQL = "'ran cat -n src/f' || json_extract_string(props, '$.k') || '.ts then head ./logs/u' || user_id || '.log; sed nothing'"


@query(
    "p07_file_reads",
    f"SELECT file, count(*) AS reads FROM (SELECT unnest(regexp_extract_all({READ_TEXT_SQL}, {q(X.FILE_READ)}, 1)) AS p, regexp_extract(p, '[^/]*$') AS file FROM events) GROUP BY file",
)
def _(spark, sf):
    text = F.concat(
        F.lit("ran cat -n src/f"), F.get_json_object("props", "$.k"), F.lit(".ts then head ./logs/u"),
        F.col("user_id").cast("string"), F.lit(".log; sed nothing"),
    )
    return (
        table(spark, sf, "events")
        .select(F.explode(X.file_reads(text)).alias("file"))
        .groupBy("file")
        .agg(F.count(F.lit(1)).alias("reads"))
    )


@query("p08_base_name", "SELECT page_id, regexp_extract(trim(url, '\"'), '[^/]*$') AS name FROM pages")
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", X.base_name(F.col("url")).alias("name"))


@query(
    "p09_bounded_role",
    "SELECT CASE WHEN role IN ('user','assistant','system','tool') THEN role ELSE 'unknown' END AS bounded, count(*) AS n FROM (SELECT CASE WHEN turn % 5 = 4 THEN 'developer' ELSE role END AS role FROM conversations) GROUP BY 1",
)
def _(spark, sf):
    raw = F.when(F.col("turn") % 5 == 4, "developer").otherwise(F.upper(F.concat(F.lit(" "), "role")))
    return (
        table(spark, sf, "conversations").groupBy(B.bounded_role(raw).alias("bounded")).agg(F.count(F.lit(1)).alias("n"))
    )


KINDS = (
    ("click", "Tool_Use ", "tool_use"),
    ("view", "patch_apply_end", "patch"),
    ("error", "function_call_output", "function_call_output"),
    ("signup", "context_compacted", "compact"),
    ("purchase", "spawn_agent", "subagent"),
)


@query(
    "p10_bounded_kind",
    "SELECT kind, count(*) AS n FROM (SELECT CASE event_type "
    + " ".join(f"WHEN '{a}' THEN '{c}'" for a, _, c in KINDS)
    + " ELSE 'message' END AS kind FROM events) GROUP BY kind",
)
def _(spark, sf):
    raw = F.lit("whatever")
    for event, name, _ in KINDS:
        raw = F.when(F.col("event_type") == event, name).otherwise(raw)
    return (
        table(spark, sf, "events").groupBy(B.bounded_kind(raw).alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    )


@query(
    "p11_bounded_tool",
    "SELECT p_partkey, CASE WHEN p_partkey % 50 = 0 THEN 'other' ELSE substr(regexp_replace(lower(p_name || '/' || p_type), '[^a-z0-9_-]', '', 'g'), 1, 64) END AS tool FROM part",
)
def _(spark, sf):
    name = F.when(F.col("p_partkey") % 50 == 0, "***").otherwise(F.concat_ws("/", "p_name", "p_type"))
    return table(spark, sf, "part").select("p_partkey", X.bounded_tool(name).alias("tool"))


@query(
    "p12_short_hash",
    "SELECT event_id, substr(sha256(CAST(json(props) AS VARCHAR)), 1, 16) AS args_hash, substr(sha256(CAST(user_id AS VARCHAR)), 1, 16) AS call_hash FROM events",
)
def _(spark, sf):
    return table(spark, sf, "events").select(
        "event_id",
        X.short_hash(X.canonical_json(F.col("props"))).alias("args_hash"),
        X.short_hash(F.col("user_id").cast("string")).alias("call_hash"),
    )


@query(
    "p13_environment_labels",
    """SELECT os, shell, vcs, count(*) AS n FROM (SELECT
      CASE WHEN contains(t,'darwin') OR contains(t,'macos') THEN 'macos' WHEN contains(t,'wsl') THEN 'wsl' WHEN contains(t,'windows') OR contains(t,'powershell') THEN 'windows' WHEN contains(t,'linux') OR contains(t,'/home/') THEN 'linux' ELSE 'unknown' END AS os,
      CASE WHEN contains(t,'zsh') THEN 'zsh' WHEN contains(t,'bash') THEN 'bash' WHEN contains(t,'fish') THEN 'fish' WHEN contains(t,'powershell') OR contains(t,'pwsh') THEN 'powershell' ELSE 'unknown' END AS shell,
      CASE WHEN contains(t,'jj ') THEN 'jj' WHEN contains(t,'git ') THEN 'git' ELSE 'unknown' END AS vcs
      FROM (SELECT lower(html || CASE page_id % 4 WHEN 0 THEN ' Darwin zsh' WHEN 1 THEN ' /home/me git status' WHEN 2 THEN ' PowerShell' ELSE '' END) AS t FROM pages)) GROUP BY ALL""",
)
def _(spark, sf):
    p = F.col("page_id") % 4
    extra = (
        F.when(p == 0, " Darwin zsh").when(p == 1, " /home/me git status").when(p == 2, " PowerShell").otherwise("")
    )
    text = F.concat("html", extra)
    return (
        table(spark, sf, "pages")
        .select(X.detect_os(text).alias("os"), X.detect_shell(text).alias("shell"), X.detect_vcs(text).alias("vcs"))
        .groupBy("os", "shell", "vcs")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def match_sql(source: str, key: str, text: str, sigs) -> str:
    return " UNION ALL ".join(
        f"SELECT {key}, {q(i)} AS id FROM {source} WHERE "
        + " OR ".join(f"regexp_matches({text}, {q(p)})" for p in pats)
        for i, pats in sigs
    )


# What each document is said to use, by its number, so that patterns fire on it.
MENTIONS = ("npm install", "uv sync", "cargo build", "go test ./...", "yarn add", "pip list", "")
AGENT_MENTIONS = ("Claude Code", "Codex CLI", "Gemini CLI", "aider", "Kiro", "")
DOC_TEXT = (
    "text || CASE doc_id % 7 " + " ".join(f"WHEN {i} THEN {q(' ' + m)}" for i, m in enumerate(MENTIONS))
    + " END || CASE doc_id % 6 " + " ".join(f"WHEN {i} THEN {q(' ' + m)}" for i, m in enumerate(AGENT_MENTIONS)) + " END"
)
MENTIONED = f"(SELECT doc_id, {DOC_TEXT} AS t FROM documents)"


def mentioned(spark, sf):
    one, two = F.lit(""), F.lit("")
    for i, m in enumerate(MENTIONS):
        one = F.when(F.col("doc_id") % 7 == i, " " + m).otherwise(one)
    for i, m in enumerate(AGENT_MENTIONS):
        two = F.when(F.col("doc_id") % 6 == i, " " + m).otherwise(two)
    return texts(spark, sf, "documents").select(
        "doc_id", "lang", "source", F.concat("text", one, two).alias("t")
    )


@query(
    "p14_signature_match",
    f"SELECT id, count(*) AS documents FROM ({match_sql(MENTIONED, 'doc_id', 't', signatures.PACKAGE_MANAGERS)}) GROUP BY id",
)
def _(spark, sf):
    rows = settled(mentioned(spark, sf), {"low": F.lower("t")})
    ids = X.matching_ids(F.col("t"), signatures.PACKAGE_MANAGERS, F.col("low"))
    return (
        rows.select(F.explode(ids).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("documents"))
    )


@query(
    "p14_many_signatures",
    "WITH sig AS (SELECT DISTINCT lower(unnest(regexp_extract_all(text, '[A-Za-z]{4,}'))) AS id FROM benchmark), word AS (SELECT DISTINCT doc_id, lower(unnest(regexp_extract_all(text, '[A-Za-z0-9_]+'))) AS id FROM documents) SELECT id, count(*) AS documents FROM word JOIN sig USING (id) GROUP BY id",
)
def _(spark, sf):
    """Every plain word of the benchmark items is a signature: a registry grows with its table."""
    words = table(spark, sf, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]{4,}"), F.lit(0))).alias("w"))
    registry = [(r["w"], (rf"(?i)\b{r['w']}\b",)) for r in words.select(F.lower("w").alias("w")).distinct().collect()]
    ids = literals.matching_ids(F.col("text"), registry)
    return texts(spark, sf, "documents").select(F.explode(ids).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("documents"))


@query(
    "p15_primary_client",
    f"SELECT doc_id, coalesce(min(id), 'unknown') AS client FROM (SELECT doc_id FROM documents) LEFT JOIN ({match_sql(MENTIONED, 'doc_id', 't', signatures.CODING_AGENTS)}) USING (doc_id) GROUP BY doc_id",
)
def _(spark, sf):
    ids = X.matching_ids(F.col("t"), signatures.CODING_AGENTS)
    return mentioned(spark, sf).select("doc_id", X.primary_of(ids).alias("client"))


@query("p16_normalize_id", "SELECT p_partkey, replace(lower(p_brand || '-' || p_type), '-', '_') AS id FROM part")
def _(spark, sf):
    return table(spark, sf, "part").select(
        "p_partkey", X.normalize_id(F.concat_ws("-", "p_brand", "p_type")).alias("id")
    )


@query(
    "p17_slash_tokens",
    f"SELECT token, count(*) AS pages FROM (SELECT DISTINCT page_id, lower(replace(raw, '/', '')) AS token FROM (SELECT page_id, unnest(regexp_extract_all(html, {q(X.SLASH_TOKEN)}, 1)) AS raw FROM pages)) GROUP BY token",
)
def _(spark, sf):
    rows = table(spark, sf, "pages").select(
        "page_id", F.explode(X.all_slash_tokens(F.col("html"))).alias("token")
    )
    return rows.distinct().groupBy("token").agg(F.count(F.lit(1)).alias("pages"))


@query(
    "p18_slash_commands",
    f"SELECT token, count(*) AS uses FROM (SELECT lower(substr(raw, 2)) AS token FROM (SELECT unnest(regexp_extract_all(html || ' /review it, /usr/bin', {q(X.SLASH_TOKEN)}, 1)) AS raw FROM pages) WHERE NOT suffix(raw, '/')) GROUP BY token",
)
def _(spark, sf):
    text = F.concat("html", F.lit(" /review it, /usr/bin"))
    rows = table(spark, sf, "pages").select(F.explode(X.slash_tokens(text)).alias("token"))
    return rows.groupBy("token").agg(F.count(F.lit(1)).alias("uses"))


@query(
    "p19_enum_fallbacks",
    """SELECT a, b, c, count(*) AS n FROM (SELECT CASE WHEN event_type IN ('click','view') THEN event_type ELSE 'unknown' END AS a,
      CASE WHEN event_type = 'signup' THEN '' WHEN event_type IN ('click') THEN event_type ELSE 'unknown' END AS b,
      CASE WHEN event_type IN ('low','error') THEN event_type WHEN value >= 20 THEN 'high' ELSE 'low' END AS c FROM events) GROUP BY ALL""",
)
def _(spark, sf):
    t = F.col("event_type")
    blank = F.when(t == "signup", "").otherwise(t)
    level = F.when(F.col("value") >= 20, "high").otherwise("low")
    return (
        table(spark, sf, "events")
        .select(
            B.enum_or_unknown(t, ("click", "view")).alias("a"),
            B.enum_or_empty(blank, ("click",)).alias("b"),
            B.enum_or_calculated(t, level, ("low", "high", "error")).alias("c"),
        )
        .groupBy("a", "b", "c")
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query(
    "p20_redaction_allow_list",
    SCRUB + f"SELECT family, CAST(least(greatest(sum(n), 0), 1000) AS BIGINT) AS count FROM ({FAMILY_ROWS}) WHERE n > 0 AND family IN ({lst(retained.REDACTION_FAMILIES)}) GROUP BY family",
)
def _(spark, sf):
    rows = scrubbed(spark, sf).select(F.inline("redactions"))
    totals = rows.groupBy("family").agg(F.sum("count").alias("count"))
    return retained.keep_redactions(totals)


@query(
    "p21_clamps",
    "SELECT l_orderkey, l_linenumber, CAST(least(greatest(trunc(l_extendedprice / 50), 0), 1000) AS BIGINT) AS n, CAST(least(greatest(trunc(l_discount * 1500), 0), 100) AS BIGINT) AS pct FROM lineitem",
)
def _(spark, sf):
    return table(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        retained.clamp_count((F.col("l_extendedprice") / 50).cast("long"), 1000).alias("n"),
        B.clamp((F.col("l_discount") * 1500).cast("long"), 0, 100).cast("long").alias("pct"),
    )


@query(
    "p22_time_window",
    "SELECT event_type, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts <= TIMESTAMP '2024-01-20 12:00:00' GROUP BY event_type",
)
def _(spark, sf):
    rows = U.in_window(table(spark, sf, "events"), "ts", "2024-01-05 00:00:00", "2024-01-20 12:00:00")
    return rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query(
    "p23_lookback",
    "SELECT count(*) AS n, count(*) > 20000 AS truncated FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY",
)
def _(spark, sf):
    events = table(spark, sf, "events")
    newest = events.agg(F.max("ts").alias("until"))
    seconds = U.lookback_seconds()
    kept = events.filter(
        F.col("ts") >= newest.scalar() - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(seconds))
    )
    return kept.agg(
        F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) > U.row_limit("")).alias("truncated")
    )


@query(
    "p24_report_validity",
    """SELECT o_orderkey AS report_id, CASE WHEN o_orderstatus = 'P' AND o_orderkey % 3 = 0 THEN 'missing analyzer version' WHEN o_custkey % 10 = 0 THEN 'missing parsed turns' WHEN o_orderpriority = '1-URGENT' THEN 'claims raw transcript was sent' ELSE 'claims outbound network' END AS reason
    FROM orders WHERE (o_orderstatus = 'P' AND o_orderkey % 3 = 0) OR o_custkey % 10 = 0 OR o_orderpriority = '1-URGENT' OR o_totalprice > 450000""",
)
def _(spark, sf):
    orders = table(spark, sf, "orders")
    reports = orders.select(
        F.col("o_orderkey").alias("report_id"),
        F.when((F.col("o_orderstatus") == "P") & (F.col("o_orderkey") % 3 == 0), "").otherwise("0.1").alias("version"),
        (F.col("o_custkey") % 10).alias("turns"),
        (F.col("o_orderpriority") == "1-URGENT").alias("raw_transcript_sent"),
        (F.col("o_totalprice") > 450000).alias("outbound_during_analysis"),
    )
    return retained.invalid_reports(reports).select("report_id", "reason")


EMAIL = dict(X.SECRET_RULES)["email"]
EMAILS_SQL = f"(SELECT doc_id, unnest(regexp_extract_all(text, {q(EMAIL)})) AS email FROM documents UNION ALL SELECT doc_id, 'User' || (doc_id % 37) || '@' || source || '.Example.com' FROM documents)"


def emails(spark, sf):
    docs = table(spark, sf, "documents")
    found = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(EMAIL), F.lit(0))).alias("email"))
    made = docs.select(
        "doc_id",
        F.concat(F.lit("User"), (F.col("doc_id") % 37).cast("string"), F.lit("@"), "source", F.lit(".Example.com")).alias("email"),
    )
    return found.unionByName(made)


@query(
    "p25_owner_filter",
    f"SELECT lower(trim(email)) IN ('user3@src1.example.com') OR regexp_extract(lower(trim(email)), '[^@]*$') IN ('src2.example.com') AS owner, count(*) AS n FROM {EMAILS_SQL} GROUP BY 1",
)
def _(spark, sf):
    own = Wb.is_owner_email(F.col("email"), ["user3@src1.example.com"], ["src2.example.com"])
    return emails(spark, sf).groupBy(own.alias("owner")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "p26_email_hash_mask",
    f"""WITH e AS (SELECT lower(trim(email)) AS e FROM {EMAILS_SQL}), p AS (SELECT e, split_part(e, '@', 1) AS l, substr(e, strpos(e, '@') + 1) AS d FROM e)
    SELECT sha256(e) AS email_hash, CASE WHEN length(l) <= 1 THEN '*' WHEN length(l) = 2 THEN l[1] || '*' ELSE l[1] || '***' || l[-1] END || '@' || d AS masked, count(*) AS n FROM p GROUP BY ALL""",
)
def _(spark, sf):
    return (
        emails(spark, sf)
        .groupBy(Wb.hash_email(F.col("email")).alias("email_hash"), Wb.mask_email(F.col("email")).alias("masked"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


PREFIXES = [p for p, _ in Wb.PATH_TEMPLATES] + ["/docs/", Wb.CTA_PREFIX + "npx_privacy?", "/api/admin/usage-stats"]
PREFIXED_PATH = "list_extract([" + lst(PREFIXES) + f"], CAST(page_id % {len(PREFIXES)} + 1 AS INTEGER)) "
# The path of each page's URL behind one of the known prefixes.
PATHS_SQL = f"(SELECT page_id, CASE WHEN suffix(pre, '?') THEN rtrim(pre, '?') ELSE pre || ltrim(regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1), '/') END AS path FROM (SELECT page_id, url, {PREFIXED_PATH} AS pre FROM pages))"


def paths(spark, sf):
    options = F.array(*[F.lit(p) for p in PREFIXES])
    pre = F.element_at(options, (F.col("page_id") % len(PREFIXES) + 1).cast("int"))
    own = F.ltrim(Wb.url_part(F.col("url"), "PATH"), F.lit("/"))
    path = F.when(pre.endswith("?"), F.rtrim(pre, F.lit("?"))).otherwise(F.concat(pre, F.coalesce(own, F.lit(""))))
    return table(spark, sf, "pages").select("page_id", path.alias("path"))


@query(
    "p27_path_templates",
    f"SELECT page_id, CASE WHEN path IN ({lst(Wb.CTA_PREFIX + i for i in Wb.CTA_IDS)}) THEN path "
    + " ".join(f"WHEN starts_with(path, {q(a)}) THEN {q(b)}" for a, b in Wb.PATH_TEMPLATES)
    + f" ELSE path END AS template FROM {PATHS_SQL}",
)
def _(spark, sf):
    return paths(spark, sf).select("page_id", Wb.path_template(F.col("path")).alias("template"))


@query(
    "p28_cta_ids",
    f"SELECT substr(path, {len(Wb.CTA_PREFIX) + 1}) AS cta, substr(path, {len(Wb.CTA_PREFIX) + 1}) IN ({lst(Wb.CTA_IDS)}) AS known, count(*) AS n FROM {PATHS_SQL} WHERE starts_with(path, {q(Wb.CTA_PREFIX)}) GROUP BY ALL",
)
def _(spark, sf):
    return (
        paths(spark, sf)
        .select(Wb.cta_id(F.col("path")).alias("cta"), Wb.known_cta(F.col("path")).alias("known"))
        .filter(F.col("cta").isNotNull())
        .groupBy("cta", "known")
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query(
    "p29_auth_surface",
    f"""SELECT surface, surface <> 'none' AND status < 400 AS authenticated, count(*) AS n FROM (SELECT 200 + (page_id % 4) * 100 AS status, CASE WHEN path IN ('/api/admin/usage-stats', '/api/admin/email-unlocks') THEN 'admin_token'
    WHEN starts_with(path, '/api/uploads/') OR starts_with(path, '/api/paid-uploads/') THEN 'upload_token'
    WHEN starts_with(path, '/api/public-reports/') OR starts_with(path, '/api/public-artifacts/') OR starts_with(path, '/r/') THEN 'report_token'
    WHEN starts_with(path, '/email/confirm/') THEN 'email_confirmation_token' ELSE 'none' END AS surface FROM {PATHS_SQL}) GROUP BY ALL""",
)
def _(spark, sf):
    rows = paths(spark, sf).select(
        Wb.auth_surface(F.col("path")).alias("surface"), (200 + (F.col("page_id") % 4) * 100).alias("status")
    )
    return rows.groupBy(
        "surface", Wb.authenticated(F.col("surface"), F.col("status")).alias("authenticated")
    ).agg(F.count(F.lit(1)).alias("n"))


IP_SQL = "CASE WHEN event_id % 9 = 0 THEN '' ELSE (user_id % 250) || '.' || (event_id % 7) || '.3.' || (event_id % 256) END"


def ip_of():
    s = lambda c: c.cast("string")
    ip = F.concat(
        s(F.col("user_id") % 250), F.lit("."), s(F.col("event_id") % 7), F.lit(".3."), s(F.col("event_id") % 256)
    )
    return F.when(F.col("event_id") % 9 == 0, "").otherwise(ip)


@query(
    "p30_client_hash",
    f"SELECT event_id, CASE WHEN ip = '' THEN '' ELSE sha256('pepper' || chr(0) || ip) END AS client_hash FROM (SELECT event_id, {IP_SQL} AS ip FROM events)",
)
def _(spark, sf):
    forwarded = F.concat(F.lit(" , "), ip_of(), F.lit(", 10.0.0.1"))
    hops = F.when(ip_of() == "", "").otherwise(forwarded)
    ip = Wb.first_client_ip(hops, F.lit(" "), F.lit(""))
    return table(spark, sf, "events").select("event_id", Wb.client_hash("pepper", ip).alias("client_hash"))


@query(
    "p31_ip_prefix",
    f"""SELECT version, prefix, count(*) AS n FROM (SELECT CASE WHEN event_id % 11 = 1 THEN 'ipv6' WHEN ip = '' THEN '' ELSE 'ipv4' END AS version,
    CASE WHEN event_id % 11 = 1 THEN '2001:db8:' || (user_id % 7 + 1) || '::/48' WHEN ip = '' THEN '' ELSE regexp_replace(ip, '[0-9]+$', '0') || '/24' END AS prefix
    FROM (SELECT event_id, user_id, {IP_SQL} AS ip FROM events)) GROUP BY ALL""",
)
def _(spark, sf):
    six = F.concat(F.lit("2001:db8:"), (F.col("user_id") % 7 + 1).cast("string"), F.lit(":1::5"))
    ip = F.when(F.col("event_id") % 11 == 1, six).otherwise(ip_of())
    rows = table(spark, sf, "events").select(ip.alias("ip"))
    return rows.groupBy(
        Wb.ip_version(F.col("ip")).alias("version"), Wb.ip_prefix(F.col("ip")).alias("prefix")
    ).agg(F.count(F.lit(1)).alias("n"))


# agent, family, browser, major, os, os major, device, bot
AGENTS = (
    ("Mozilla/5.0 (Windows NT 10.0) Chrome/120.0 Safari/537 Edg/119.1", "browser", "edge", "119", "windows", "10", "desktop", False),
    ("Mozilla/5.0 (Macintosh; Intel Mac OS X 14_2) Version/17.1 Safari/605", "browser", "safari", "17", "macos", "14", "desktop", False),
    ("Mozilla/5.0 (iPhone; CPU iPhone OS 16_5 like Mac OS X) CriOS/121.0 Mobile", "browser", "chrome", "121", "ios", "16", "mobile", False),
    ("Mozilla/5.0 (Linux; Android 13; Pixel) Firefox/118.0", "browser", "firefox", "118", "android", "13", "mobile", False),
    ("curl/8.4.0", "curl", "curl", "8", "unknown", "", "automation", False),
    ("npm/10.2 node/v20", "node", "node", "10", "unknown", "", "automation", False),
    ("python-requests/2.31", "python-requests", "python-requests", "2", "unknown", "", "automation", False),
    ("Go-http-client/1.1", "go-http-client", "go-http-client", "1", "unknown", "", "automation", False),
    ("Mozilla/5.0 (compatible; AhrefsBot/7.0)", "browser", "unknown", "", "unknown", "", "bot", True),
    ("Mozilla/5.0 (iPad; CPU OS 15_1) Version/15.0 Safari/604", "browser", "safari", "15", "ios", "15", "tablet", False),
    ("", "unknown", "unknown", "", "unknown", "", "unknown", False),
)
AGENT_FIELDS = ("family", "browser", "browser_major", "operating_system", "os_major", "device_class")


def _agent_case(i: int) -> str:
    return f"CASE event_id % {len(AGENTS)} " + " ".join(
        f"WHEN {k} THEN {q(str(a[i]))}" for k, a in enumerate(AGENTS)
    ) + " END"


@query(
    "p32_user_agents",
    "SELECT "
    + ", ".join(f"{_agent_case(i + 1)} AS {f}" for i, f in enumerate(AGENT_FIELDS))
    + f", event_id % {len(AGENTS)} IN (" + ", ".join(str(k) for k, a in enumerate(AGENTS) if a[7]) + ") AS bot, count(*) AS n FROM events GROUP BY ALL",
)
def _(spark, sf):
    agents = F.array(*[F.lit(a[0]) for a in AGENTS])
    ua = F.element_at(agents, (F.col("event_id") % len(AGENTS) + 1).cast("int"))
    rows = table(spark, sf, "events").select(ua.alias("ua"))
    ua = F.col("ua")
    return rows.groupBy(
        Wb.user_agent_family(ua).alias("family"),
        Wb.browser(ua).alias("browser"),
        Wb.browser_major(ua).alias("browser_major"),
        Wb.operating_system(ua).alias("operating_system"),
        Wb.os_major(ua).alias("os_major"),
        Wb.device_class(ua).alias("device_class"),
        Wb.is_bot(ua).alias("bot"),
    ).agg(F.count(F.lit(1)).alias("n"))


@query(
    "p33_accept_language",
    "SELECT lower(lang) AS language, CASE WHEN doc_id % 3 = 0 THEN '' ELSE upper(source) END AS region, count(*) AS n FROM documents GROUP BY ALL",
)
def _(spark, sf):
    header = F.when(F.col("doc_id") % 3 == 0, F.concat(F.upper("lang"), F.lit(";q=0.9,de"))).otherwise(
        F.concat(F.lit(" "), "lang", F.lit("_"), "source", F.lit(";q=1, fr"))
    )
    return (
        table(spark, sf, "documents")
        .groupBy(Wb.language(header).alias("language"), Wb.region(header).alias("region"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


URL_HOST = "regexp_replace(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1)), ':[0-9]+$', '')"
URL_PATH = "regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1)"


@query(
    "p34_referrers",
    f"SELECT page_id, host, internal, CASE WHEN internal THEN path ELSE '' END AS path, CASE WHEN starts_with(lower(url), 'https') THEN 'https' ELSE 'http' END AS scheme FROM (SELECT page_id, url, {URL_HOST} AS host, {URL_PATH} AS path, page_id % 2 = 0 AS internal FROM pages)",
)
def _(spark, sf):
    host = Wb.referrer_host(F.col("url"))
    own = F.when(F.col("page_id") % 2 == 0, host).otherwise("elsewhere.example")
    rows = table(spark, sf, "pages").select("page_id", "url", own.alias("own"), host.alias("host"))
    return rows.select(
        "page_id",
        "host",
        Wb.referrer_internal(F.col("url"), F.col("own")).alias("internal"),
        Wb.referrer_path(F.col("url"), F.col("own")).alias("path"),
        Wb.request_scheme(F.lit(""), F.lit(False), F.col("url")).alias("scheme"),
    )


def _utm_sql(key: str) -> str:
    return f"SELECT page_id, '{key}' AS key, regexp_extract(url, '[?&]{key}=([^&#]*)', 1) AS value FROM pages"


@query(
    "p35_utm",
    "SELECT page_id, key, value FROM (" + " UNION ALL ".join(_utm_sql(k) for k in Wb.UTM_KEYS) + ") WHERE value <> ''",
)
def _(spark, sf):
    return requests_from_pages(table(spark, sf, "pages")).select(
        "page_id", F.explode(F.map_entries("utm")).alias("e")
    ).select("page_id", "e.key", "e.value")


LEAKY = "text || CASE doc_id % 5 WHEN 0 THEN ' /Users/me/x' WHEN 1 THEN ' /private/tmp/y' ELSE '' END"


def leaky():
    m = F.col("doc_id") % 5
    return F.concat("text", F.when(m == 0, " /Users/me/x").when(m == 1, " /private/tmp/y").otherwise(""))


@query(
    "p36_private_paths",
    f"SELECT doc_id FROM documents WHERE regexp_matches({LEAKY}, {q('|'.join(X.PRIVATE_PATHS))})",
)
def _(spark, sf):
    return table(spark, sf, "documents").filter(X.leaks_private_path(leaky())).select("doc_id")


@query(
    "p37_path_placeholders",
    f"SELECT doc_id, sha256(replace(replace(replace({LEAKY}, '/Users/me', '$HOME'), '/private/tmp/', '$TMPDIR/'), '/var/folders/', '$TMPDIR/')) AS text_hash FROM documents",
)
def _(spark, sf):
    clean = X.path_placeholders(leaky(), {"/Users/me": "$HOME"})
    return table(spark, sf, "documents").select("doc_id", F.sha2(clean, 256).alias("text_hash"))


@query(
    "p39_prune_empty",
    "SELECT path, count(*) AS n FROM (SELECT '/k' AS path FROM events UNION ALL SELECT '/in/user' FROM events WHERE user_id % 2 = 0 UNION ALL SELECT '/in/type' FROM events WHERE event_type <> 'view') GROUP BY path",
)
def _(spark, sf):
    doc = F.to_json(
        F.struct(
            F.get_json_object("props", "$.k").alias("k"),
            F.struct(
                F.when(F.col("user_id") % 2 == 0, F.col("user_id")).alias("user"),
                F.when(F.col("event_type") != "view", F.col("event_type")).otherwise("").alias("type"),
            ).alias("in"),
        ),
        {"ignoreNullFields": "false"},
    )
    rows = table(spark, sf, "events").select(J.json_nodes(doc).alias("nodes"))
    kept = rows.select(F.explode(J.non_empty(F.col("nodes"))).alias("n")).select("n.path")
    return kept.groupBy("path").agg(F.count(F.lit(1)).alias("n"))


@query(
    "p40_relevance",
    f"SELECT regexp_matches(lower(html), {q('|'.join(X.RELEVANCE_MARKERS))}) AS relevant, count(*) AS n FROM pages GROUP BY 1",
)
def _(spark, sf):
    return table(spark, sf, "pages").groupBy(X.looks_relevant(F.col("html")).alias("relevant")).agg(
        F.count(F.lit(1)).alias("n")
    )


@query(
    "p42_empty_collections",
    "SELECT quality IS NOT NULL AS labelled, count(*) AS n, CAST(sum(CASE WHEN quality IS NULL THEN 0 ELSE 2 END) AS BIGINT) AS items FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1",
)
def _(spark, sf):
    labels = table(spark, sf, "labels").select("doc_id", F.array("quality", "toxic").alias("values"))
    rows = table(spark, sf, "documents").select("doc_id").join(labels, "doc_id", "left")
    filled = retained.filled_collections(rows)
    return filled.groupBy((F.size("values") > 0).alias("labelled")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.size("values")).cast("long").alias("items")
    )


@query(
    "p43_registry_validation",
    """SELECT detector_id, subject, violation FROM (
      SELECT p_brand || p_partkey AS detector_id, 'detector' AS subject, 'invalid_id' AS violation FROM part WHERE p_partkey % 2 = 0
      UNION ALL SELECT CASE WHEN p_partkey % 2 = 0 THEN p_brand || p_partkey ELSE 'part_' || p_partkey END, 'detector', 'invalid_status' FROM part WHERE p_type NOT IN ('ECONOMY', 'SMALL')
      UNION ALL SELECT CASE WHEN p_partkey % 2 = 0 THEN p_brand || p_partkey ELSE 'part_' || p_partkey END, 'detector', 'verified_without_reference' FROM part WHERE p_type = 'ECONOMY' AND p_size % 5 = 0
      UNION ALL SELECT CASE WHEN p_partkey % 2 = 0 THEN p_brand || p_partkey ELSE 'part_' || p_partkey END, 'marker:' || p_size, CASE p_partkey % 7 WHEN 0 THEN 'binary_required' WHEN 1 THEN 'denied_flag' WHEN 2 THEN 'pattern_required' WHEN 3 THEN 'invalid_source_class' END FROM part WHERE p_partkey % 7 < 4)""",
)
def _(spark, sf):
    part = table(spark, sf, "part")
    key = F.col("p_partkey")
    rows = part.select(
        F.when(key % 2 == 0, F.concat("p_brand", key.cast("string")))
        .otherwise(F.concat(F.lit("part_"), key.cast("string")))
        .alias("detector_id"),
        F.when(F.col("p_type") == "ECONOMY", "verified")
        .when(F.col("p_type") == "SMALL", "blocked")
        .otherwise(F.col("p_type"))
        .alias("status"),
        (F.col("p_size") % 5).alias("references"),
        F.col("p_size").alias("marker_id"),
        (key % 7).alias("m"),
    )
    m = F.col("m")
    markers = rows.select(
        "detector_id",
        "marker_id",
        F.when(m == 0, "cli_binary").when(m == 1, "cli_version_probe").when(m == 3, "nonsense").otherwise("config_dir").alias("source_class"),
        F.when(m == 2, "").otherwise("x/").alias("pattern"),
        F.when(m == 1, "tool").otherwise("").alias("binary"),
        F.when(m == 1, F.array(F.lit("--token"))).alias("version_args"),
        F.lit(False).alias("negative"),
    )
    return detectors.violations(rows.select("detector_id", "status", "references"), markers)


# Scalar functions ---------------------------------------------------------------------------


@query(
    "f10_range_buckets",
    """SELECT CASE WHEN b < 1024 THEN '0_1024' WHEN b < 1048576 THEN '1024_1048576' WHEN b < 10485760 THEN '1048576_10485760' WHEN b < 52428800 THEN '10485760_52428800' ELSE '52428800_plus' END AS size_bucket,
    CASE WHEN n <= 0 THEN '0_1' WHEN n < 2 THEN '0_2' WHEN n < 10 THEN '2_10' WHEN n < 25 THEN '10_25' WHEN n < 50 THEN '25_50' WHEN n < 100 THEN '50_100' ELSE '100_plus' END AS count_bucket, count(*) AS n
    FROM (SELECT strlen(text) AS b, doc_id % 150 - 5 AS n FROM documents) GROUP BY ALL""",
)
def _(spark, sf):
    return (
        table(spark, sf, "documents")
        .groupBy(
            B.range_bucket(F.octet_length("text"), B.INPUT_SIZE).alias("size_bucket"),
            B.int_bucket(F.col("doc_id") % 150 - 5, B.SESSIONS).alias("count_bucket"),
        )
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query(
    "f11_label_buckets",
    """SELECT CASE WHEN c <= 0 THEN 'none' WHEN c <= 3 THEN '1-3' WHEN c <= 10 THEN '4-10' WHEN c <= 25 THEN '11-25' WHEN c <= 50 THEN '26-50' WHEN c <= 100 THEN '51-100' ELSE '100+' END AS count_bucket, tok AS token_bucket,
    CASE WHEN r <= 0 THEN '0' WHEN r < 10 THEN '1_10' WHEN r < 25 THEN '10_25' WHEN r < 50 THEN '25_50' WHEN r < 75 THEN '50_75' WHEN r < 100 THEN '75_100' ELSE '100' END AS ratio_bucket,
    CASE WHEN r < 5 AND tok NOT IN ('none', '<1k') THEN 'unused' WHEN r < 30 THEN 'underutilized' WHEN r < 70 THEN 'moderate' ELSE 'well-utilized' END AS efficiency, count(*) AS n
    FROM (SELECT l_orderkey % 120 AS c, l_partkey % 101 AS r, CASE WHEN t <= 0 THEN 'none' WHEN t < 1000 THEN '<1k' WHEN t < 5000 THEN '1k-5k' WHEN t < 15000 THEN '5k-15k' WHEN t < 50000 THEN '15k-50k' ELSE '50k+' END AS tok
      FROM (SELECT *, CAST(trunc(l_extendedprice) AS BIGINT) - 1000 AS t FROM lineitem)) GROUP BY ALL""",
)
def _(spark, sf):
    yes = F.lit(True)
    ratio = F.col("l_partkey") % 101
    rows = table(spark, sf, "lineitem").select(
        B.count_bucket(F.col("l_orderkey") % 120, yes).alias("count_bucket"),
        B.token_bucket(F.col("l_extendedprice").cast("long") - 1000, yes).alias("token_bucket"),
        B.ratio_bucket(ratio).alias("ratio_bucket"),
        ratio.alias("r"),
    )
    return rows.groupBy(
        "count_bucket", "token_bucket", "ratio_bucket",
        B.efficiency_bucket(F.col("r"), F.col("token_bucket"), yes).alias("efficiency"),
    ).agg(F.count(F.lit(1)).alias("n"))


@query(
    "f12_size_duration_buckets",
    """SELECT CASE WHEN b <= 0 THEN 'unknown' WHEN b < 10240 THEN '<10 KB' WHEN b < 102400 THEN '10-100 KB' WHEN b < 1048576 THEN '100 KB-1 MB' WHEN b < 5242880 THEN '1-5 MB' ELSE '>5 MB' END AS size_bucket,
    CASE WHEN d <= 0 THEN 'unknown' WHEN d <= 3600 THEN '<1h' WHEN d <= 86400 THEN '1h-1d' WHEN d <= 604800 THEN '1d-7d' WHEN d <= 2592000 THEN '7d-30d' ELSE '30d+' END AS duration_bucket, count(*) AS n
    FROM (SELECT CAST(trunc(o_totalprice * 20) AS BIGINT) - 500000 AS b, (o_orderkey % 4000) * 1000 AS d FROM orders) GROUP BY ALL""",
)
def _(spark, sf):
    return (
        table(spark, sf, "orders")
        .groupBy(
            B.byte_size_bucket((F.col("o_totalprice") * 20).cast("long") - 500000).alias("size_bucket"),
            B.duration_bucket(F.col("o_orderkey") % 4000 * 1000).alias("duration_bucket"),
        )
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query(
    "f13_severity",
    "SELECT CASE WHEN v >= 10 THEN 'high' WHEN v >= 3 THEN 'medium' ELSE 'low' END AS severity, count(*) AS n FROM (SELECT CAST(trunc(l_quantity / 4) AS BIGINT) AS v FROM lineitem) GROUP BY 1",
)
def _(spark, sf):
    return table(spark, sf, "lineitem").groupBy(
        B.severity((F.col("l_quantity") / 4).cast("long"), 3, 10).alias("severity")
    ).agg(F.count(F.lit(1)).alias("n"))


@query(
    "f14_version_buckets",
    """SELECT version, CASE WHEN version = '' THEN '' WHEN split_part(version, '.', 1) IN ('0','1','2','3') THEN split_part(version, '.', 1) || '.x' ELSE '4_plus' END AS coarse, count(*) AS n
    FROM (SELECT CASE WHEN p_partkey % 9 = 0 THEN '' ELSE (p_size % 7) || '.' || (p_partkey % 13) END AS version FROM part) GROUP BY ALL""",
)
def _(spark, sf):
    s = lambda c: c.cast("string")
    banner = F.when(F.col("p_partkey") % 9 == 0, "no version").otherwise(
        F.concat(
            F.char(F.lit(27)), F.lit("[1mtool "), s(F.col("p_size") % 7), F.lit("."), s(F.col("p_partkey") % 13),
            F.lit(".4-beta"), F.char(F.lit(27)), F.lit("[0m"),
        )
    )
    rows = table(spark, sf, "part").select(B.version_bucket(banner).alias("version"))
    return rows.groupBy("version", B.coarse_version(F.col("version")).alias("coarse")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "f15_rounded_percent",
    "SELECT l_orderkey, l_linenumber, CAST(CASE WHEN a <= 0 OR b <= 0 THEN 0 ELSE least(100, (a * 100 + b // 2) // b) END AS BIGINT) AS pct FROM (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS a, l_partkey % 60 AS b FROM lineitem)",
)
def _(spark, sf):
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber",
        B.rounded_percent(F.col("l_quantity").cast("long"), F.col("l_partkey") % 60).alias("pct"),
    )


@query("f16_event_dates", "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY 1")
def _(spark, sf):
    return table(spark, sf, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(
        F.count(F.lit(1)).alias("n")
    )


@query(
    "f17_recommendation_id",
    "SELECT o_orderkey, 'rec.' || CASE o_orderstatus WHEN 'P' THEN 'retrieval' ELSE 'context_hygiene' END || '.' || CASE WHEN o_orderstatus = 'P' THEN 'semble' ELSE 'none' END || '.' || CASE WHEN o_orderkey % 2 = 0 THEN 'a_b' ELSE 'none' END AS id FROM orders",
)
def _(spark, sf):
    from turnwise.operators.recommend import recommendation_id

    p = F.col("o_orderstatus") == "P"
    signals = F.when(F.col("o_orderkey") % 2 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(
        F.array().cast("array<string>")
    )
    return table(spark, sf, "orders").select(
        "o_orderkey",
        recommendation_id(
            F.when(p, "retrieval").otherwise("context_hygiene"), F.when(p, "semble").otherwise(""), signals
        ).alias("id"),
    )


ID_SQL = "regexp_replace(regexp_replace(regexp_replace(lower(x), '-mcp-server$', ''), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')"


@query(
    "f18_candidate_ids",
    f"SELECT p_partkey, id, replace(id, '_', '[-_]') AS pattern, regexp_extract('https://h.example/a/' || id, '[^/]*$') AS segment FROM (SELECT p_partkey, {ID_SQL} AS id FROM (SELECT p_partkey, p_name || '.' || p_brand || '-mcp-server' AS x FROM part))",
)
def _(spark, sf):
    raw = F.concat(F.lit("@"), F.lit("mcp-server-"), "p_name", F.lit("."), "p_brand", F.lit("-mcp-server"))
    rows = table(spark, sf, "part").select("p_partkey", mining.candidate_id(raw).alias("id"))
    return rows.select(
        "p_partkey", "id", mining.id_pattern(F.col("id")).alias("pattern"),
        mining.last_segment(F.concat(F.lit("https://h.example/a/"), "id")).alias("segment"),
    )


@query(
    "f22_footprint",
    "SELECT l_orderkey, l_linenumber, CAST(CASE WHEN b > 0 THEN b // 4 ELSE s * 250 + t * 150 END AS BIGINT) AS mcp_tokens FROM (SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 3 = 0 THEN 0 ELSE l_partkey END AS b, l_suppkey % 20 AS s, l_linenumber AS t FROM lineitem)",
)
def _(spark, sf):
    measured = F.when(F.col("l_partkey") % 3 == 0, 0).otherwise(F.col("l_partkey"))
    price = F.col("l_suppkey") % 20 * tooling.SERVER_TOKENS + F.col("l_linenumber") * tooling.TOOL_TOKENS
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", B.footprint_tokens(measured, price).alias("mcp_tokens")
    )


@query(
    "f23_savings_range",
    "SELECT o_orderkey, (t * (o_orderkey % 20) // 100) || '-' || (t * (o_orderkey % 20 + 15) // 100) AS tokens, CASE WHEN o_orderkey % 20 + 15 < 10 THEN 'low' WHEN o_orderkey % 20 + 15 < 30 THEN 'medium' ELSE 'high' END AS bucket FROM (SELECT o_orderkey, CAST(trunc(o_totalprice) AS BIGINT) AS t FROM orders)",
)
def _(spark, sf):
    t, low = F.col("o_totalprice").cast("long"), F.col("o_orderkey") % 20
    share = lambda p: F.floor(t * p / 100).cast("long").cast("string")
    return table(spark, sf, "orders").select(
        "o_orderkey", F.concat_ws("-", share(low), share(low + 15)).alias("tokens"),
        B.savings_bucket(low + 15).alias("bucket"),
    )
