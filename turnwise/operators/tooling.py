"""MCP and skill exposure, use, utilization and warning bands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnwise.functions import buckets as B
from turnwise.functions import literals
from turnwise.functions import text as X
from turnwise.functions.json_nodes import settled
from turnwise.registry import signatures as S

# Phrases that open an exposure list.
MCP_PHRASES = (
    r"available mcp servers?:",
    r"mcp tools? available",
    r"following deferred tools? are now available",
)
SKILL_PHRASES = (r"following skills are available", r"available skills:")
BULLET = r"^[\s\-*•]*([a-z0-9_][a-z0-9_:-]+)"
SERVER_TOKENS, TOOL_TOKENS, SKILL_TOKENS = 250, 150, 400


def _block(max_lines: int | None = None) -> str:
    """Rest of the phrase's line, then lines up to the first blank one (or `max_lines` in all).

    Possessive, so that the matcher loops over the lines and its stack does not grow with them.
    """
    times = "*" if max_lines is None else "{0,%d}" % (max_lines - 1)
    return r"[^\n]*+(?:\n(?![\r ]*\n)[^\n]*+)" + times + r"+\n?"


def header_blocks(text: Column, phrases, max_lines: int | None = None) -> Column:
    """Text after each exposure phrase up to a blank line."""
    pattern = "(?i)(?:" + "|".join(phrases) + ")(?=(" + _block(max_lines) + "))"
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(1))


def outside_headers(text: Column) -> Column:
    """The text without its exposure blocks: what is listed is not a call.

    A block ends at a blank line, so the block of a second heading inside one ends with it.
    """
    phrases = "|".join(MCP_PHRASES + SKILL_PHRASES)
    return F.regexp_replace(text, f"(?i)((?:{phrases})){_block()}", "$1\n")


def _bullets(blocks: Column, clean) -> Column:
    lines = F.flatten(F.transform(blocks, lambda b: F.split(F.lower(b), "\n")))
    found = F.transform(lines, lambda line: clean(F.regexp_extract(line, BULLET, 1)))
    return F.array_distinct(F.filter(found, lambda c: ~c.isin("", "available")))


def _known(names: Column, ids) -> Column:
    return F.array_sort(F.filter(names, lambda n: n.isin(*ids)))


def _normal(ids) -> list[str]:
    return [i.lower().replace("-", "_") for i in ids]


def exposures(
    logs: DataFrame, log: str = "log_id", content: str = "content", categories=S.CATEGORIES
) -> DataFrame:
    """Known ids, unknown count, tools and bytes that exposure headers list."""
    text = F.col(content)
    rows = settled(
        logs.select(log, content),
        {"_mcp": header_blocks(text, MCP_PHRASES), "_skill": header_blocks(text, SKILL_PHRASES)},
    )
    pairs = F.flatten(
        F.transform("_mcp", lambda b: F.regexp_extract_all(b, F.lit(X.MCP_CALL), F.lit(0)))
    )

    def skill_name(c):
        return X.normalize_id(F.regexp_replace(c, "^gstack-", ""))

    rows = settled(
        rows,
        {
            "_mcp_names": F.filter(_bullets(F.col("_mcp"), X.normalize_id), lambda c: c != "mcp"),
            "_skill_names": _bullets(F.col("_skill"), skill_name),
            "_tools": F.array_distinct(F.transform(pairs, lambda p: _pair_key(p))),
        },
    )

    def size_of(name):
        return F.aggregate(
            name, F.lit(0).cast("long"), lambda acc, b: acc + F.octet_length(b).cast("long")
        )

    mcp_ids = _normal(S.ids("mcp", categories))
    skill_ids = _normal(S.slash_command_ids(categories))
    out = [log]
    for surface, ids in (("mcp", mcp_ids), ("skill", skill_ids)):
        names = F.col(f"_{surface}_names")
        out += [
            (F.size(f"_{surface}") > 0).alias(f"{surface}_header"),
            _known(names, ids).alias(f"{surface}_exposed_ids"),
            F.size(F.filter(names, lambda n: ~n.isin(*ids))).cast("long").alias(f"{surface}_unknown"),
            size_of(f"_{surface}").alias(f"{surface}_bytes"),
        ]
    return rows.select(*out, F.size("_tools").cast("long").alias("mcp_tools"))


def _pair_key(token: Column) -> Column:
    server = X.normalize_id(F.regexp_extract(token, X.MCP_CALL, 1))
    return F.concat(server, F.lit("::"), F.lower(F.regexp_extract(token, X.MCP_CALL, 2)))


def mcp_call_rows(
    logs: DataFrame, turns: DataFrame | None, log: str = "log_id", content: str = "content"
) -> DataFrame:
    """(log, origin, server, tool) of every call in raw text outside headers and on tool lines.

    Both origins count, so a call seen in both is there twice.
    """

    def calls(df, text, origin):
        tokens = F.regexp_extract_all(text, F.lit(X.MCP_CALL), F.lit(0))
        return df.select(log, F.explode(tokens).alias("_t")).select(
            log,
            F.lit(origin).alias("origin"),
            X.normalize_id(F.regexp_extract("_t", X.MCP_CALL, 1)).alias("server"),
            F.lower(F.regexp_extract("_t", X.MCP_CALL, 2)).alias("tool"),
        )

    raw = calls(logs, outside_headers(F.col(content)), "text")
    if turns is None:
        return raw
    lines = turns.filter(F.col("is_tool") & F.col("tool_name").startswith("mcp__"))
    return raw.unionByName(calls(lines, F.col("tool_name"), "line"))


def summarize_mcp_calls(calls: DataFrame, *by: str, ids=None) -> DataFrame:
    """Total, known and unknown calls; distinct servers and server::tool pairs."""
    known = F.col("server").isin(*_normal(ids or S.ids("mcp")))
    per_pair = calls.groupBy(*by, "server", "tool").agg(F.count(F.lit(1)).alias("_n"))
    return per_pair.groupBy(*by).agg(
        F.sum("_n").alias("call_count"),
        F.sum(F.when(known, F.col("_n")).otherwise(0)).alias("known_call_count"),
        F.sum(F.when(known, 0).otherwise(F.col("_n"))).alias("unknown_call_count"),
        F.count_distinct("server").alias("unique_servers"),
        F.count(F.lit(1)).alias("unique_tools"),
        F.count_distinct(F.when(known, F.col("server"))).alias("unique_known_called"),
        F.count_distinct(F.when(~known, F.col("server"))).alias("unique_unknown_called"),
    )


def skill_run_rows(turns: DataFrame, log: str = "log_id", text: str = "text") -> DataFrame:
    """(log, skill) of every slash command in a line that no tool wrote."""
    names = X.slash_tokens(F.col(text))
    return turns.filter(~F.col("is_tool")).select(
        log,
        F.explode(names).alias("_n"),
    ).select(log, X.normalize_id(F.regexp_replace("_n", "^gstack-", "")).alias("skill"))


def summarize_skill_runs(runs: DataFrame, *by: str, ids=None) -> DataFrame:
    """Runs, distinct known and distinct unknown skills."""
    known = F.col("skill").isin(*_normal(ids or S.slash_command_ids()))
    per_skill = runs.groupBy(*by, "skill").agg(F.count(F.lit(1)).alias("_n"))
    return per_skill.groupBy(*by).agg(
        F.sum("_n").alias("executed_count"),
        F.sum(known.cast("long")).alias("known_executed"),
        F.sum((~known).cast("long")).alias("unknown_executed"),
    )


def split_known(names: DataFrame, allowed: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose id is on the allow-list, and the others."""
    keyed = names.withColumn("id", X.normalize_id(F.col(column)))
    return keyed.join(allowed, "id", "left_semi"), keyed.join(allowed, "id", "left_anti")


def _degraded() -> Column:
    return (
        (F.col("rereads") >= 3)
        | (F.col("retry_depth_max") >= 3)
        | (F.col("context_growth_events") >= 2)
    )


def warning_band(
    exposure_known: Column,
    count: Column,
    ratio: Column,
    tokens: Column,
    normal_at: int,
    severe_below: int,
    tool_count: Column | None = None,
) -> Column:
    """Band of a surface (D07): wide, hardly used and heavy, worse when the session suffers.

    MCP is normal from 40 % use and severe below 20 %, skills from 30 % and below 15 %.
    """
    rank = B.rank(count, B.COUNT_LABELS)
    wide = rank >= B.COUNT_LABELS.index("11-25")
    heavy = B.rank(tokens, B.TOKEN_LABELS) >= B.TOKEN_LABELS.index("5k-15k")
    if tool_count is not None:
        heavy = heavy | (B.rank(tool_count, B.COUNT_LABELS) >= B.COUNT_LABELS.index("26-50"))
    narrow = rank.between(0, B.COUNT_LABELS.index("4-10"))
    gate = wide & (ratio < severe_below) & heavy
    moderate = wide & (rank <= B.COUNT_LABELS.index("26-50")) & (ratio < normal_at)
    return (
        F.when(~exposure_known, "unknown")
        .when(narrow | (ratio >= normal_at), "normal")
        .when(gate & _degraded(), "severe")
        .when(gate, "high")
        .when(moderate & ~_degraded(), "watch")
        .otherwise("normal")
    )


def mcp_band(exposure_known, count, tool_count, tokens, ratio) -> Column:
    return warning_band(exposure_known, count, ratio, tokens, 40, 20, tool_count)


def skill_band(exposure_known, count, tokens, ratio) -> Column:
    return warning_band(exposure_known, count, ratio, tokens, 30, 15)


def utilization(
    logs: DataFrame,
    turns: DataFrame,
    metrics: DataFrame,
    log: str = "log_id",
    categories=S.CATEGORIES,
) -> DataFrame:
    """Per log: use against exposure, buckets, inference source and bands."""
    zero = F.lit(0).cast("long")
    shown = exposures(logs, log, categories=categories)
    calls = summarize_mcp_calls(mcp_call_rows(logs, turns, log), log, ids=S.ids("mcp", categories))
    runs = summarize_skill_runs(
        skill_run_rows(turns, log), log, ids=S.slash_command_ids(categories)
    )
    needed = [log, "rereads", "retry_depth_max", "context_growth_events"]
    rows = (
        shown.join(calls, log, "left")
        .join(runs, log, "left")
        .join(metrics.select(*needed), log)
        .na.fill(0, [c for c in calls.columns + runs.columns if c != log])
    )
    rows = settled(
        rows,
        {
            "mcp_known": F.col("mcp_header") | (F.col("unique_servers") > 0),
            "mcp_count": F.when(
                F.col("mcp_header"), F.size("mcp_exposed_ids") + F.col("mcp_unknown")
            ).otherwise(F.col("unique_servers")).cast("long"),
            "mcp_tool_count": F.when(F.col("mcp_header"), F.col("mcp_tools")).otherwise(
                F.col("unique_tools")
            ),
            "skill_count": F.when(
                F.col("skill_header"), F.size("skill_exposed_ids") + F.col("skill_unknown")
            ).otherwise(0).cast("long"),
            "skill_used": F.col("known_executed") + F.col("unknown_executed"),
        },
    )

    def ratio(used, count, known):
        pct = F.floor(F.least(used, count) * 100 / F.nullif(count, zero)).cast("long")
        return F.when(known, F.coalesce(pct, zero)).otherwise(zero)

    rows = settled(
        rows,
        {
            "mcp_ratio": ratio(F.col("unique_servers"), F.col("mcp_count"), F.col("mcp_known")),
            "skill_ratio": ratio(F.col("skill_used"), F.col("skill_count"), F.col("skill_header")),
            "mcp_tokens": B.token_bucket(
                B.footprint_tokens(
                    F.col("mcp_bytes"),
                    F.col("mcp_count") * SERVER_TOKENS + F.col("mcp_tool_count") * TOOL_TOKENS,
                ),
                F.col("mcp_known"),
            ),
            "skill_tokens": B.token_bucket(
                B.footprint_tokens(F.col("skill_bytes"), F.col("skill_count") * SKILL_TOKENS),
                F.col("skill_header"),
            ),
            "mcp_count_bucket": B.count_bucket(F.col("mcp_count"), F.col("mcp_known")),
            "mcp_tool_bucket": B.count_bucket(F.col("mcp_tool_count"), F.col("mcp_known")),
            "skill_count_bucket": B.count_bucket(F.col("skill_count"), F.col("skill_header")),
        },
    )
    return rows.withColumns(
        {
            "mcp_source": F.when(F.col("mcp_header"), "header")
            .when(F.col("mcp_known"), "calls")
            .otherwise("none"),
            "skill_source": F.when(F.col("skill_header"), "header").otherwise("none"),
            "mcp_efficiency": B.efficiency_bucket(
                F.col("mcp_ratio"), F.col("mcp_tokens"), F.col("mcp_known")
            ),
            "skill_efficiency": B.efficiency_bucket(
                F.col("skill_ratio"), F.col("skill_tokens"), F.col("skill_header")
            ),
            "mcp_band": mcp_band(
                F.col("mcp_known"), F.col("mcp_count_bucket"), F.col("mcp_tool_bucket"),
                F.col("mcp_tokens"), F.col("mcp_ratio"),
            ),
            "skill_band": skill_band(
                F.col("skill_header"), F.col("skill_count_bucket"), F.col("skill_tokens"),
                F.col("skill_ratio"),
            ),
        }
    ).drop(*needed[1:])


def ecosystem(logs: DataFrame, log: str = "log_id", content: str = "content", categories=S.CATEGORIES):
    """Per log: environment labels and the ids of each category."""
    text = F.col(content)
    rows = logs.select(log, content).withColumn("_ids", literals.matching_by(text, categories))
    return rows.select(
        log,
        *[F.col("_ids")[c].alias(c) for c in categories],
        X.primary_of(F.col("_ids")["coding_agent"]).alias("client"),
        X.detect_os(text).alias("operating_system"),
        X.detect_shell(text).alias("shell"),
        X.detect_vcs(text).alias("version_control"),
    )


def ecosystem_ids(eco: DataFrame, log: str = "log_id", categories=S.CATEGORIES) -> DataFrame:
    """Long (log, category, id) rows of `ecosystem`."""
    entries = F.flatten(
        F.array(
            *[F.transform(c, _entry(c)) for c in categories]
        )
    )
    return eco.select(log, F.inline(entries))


def _entry(category: str):
    return lambda i: F.struct(F.lit(category).alias("category"), i.alias("id"))


def unknown_mcp_count(logs: DataFrame, ids: DataFrame, log: str = "log_id", content: str = "content"):
    """Distinct servers named in the text that are not among a log's known ids."""
    tokens = F.regexp_extract_all(F.col(content), F.lit(r"mcp__([A-Za-z0-9_-]+)__"), F.lit(1))
    named = logs.select(log, F.explode(tokens).alias("_s")).select(
        log, X.normalize_id(F.col("_s")).alias("id")
    ).distinct()
    known = ids.filter(F.col("category") == "mcp").select(log, X.normalize_id(F.col("id")).alias("id"))
    return named.join(known, [log, "id"], "left_anti").groupBy(log).agg(
        F.count(F.lit(1)).alias("unknown_mcp_server_count")
    )
