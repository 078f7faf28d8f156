"""Transcript lines to turns, and JSON lines to normalized events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnwise.functions import buckets as B
from turnwise.functions import json_nodes as J
from turnwise.functions import text as X
from turnwise.operators import blocks

# Sources whose lines may carry text before the JSON object.
PREFIXED_SOURCES = ("claude_desktop", "claude_desktop_mcp", "copilot", "kiro_cli", "kiro_ide")
CALL_TYPES = ("function_call", "local_shell_call", "custom_tool_call", "tool_search_call")
RESULT_TYPES = tuple(f"{name}_output" for name in CALL_TYPES)
NESTED_KINDS = ("tool_use", "tool_result", "function_call", "function_call_output")
KEPT_KINDS = ("message", "token_count", "patch", "compact", "subagent")

EVENT_FIELDS = (
    "role", "kind", "tool", "args_hash", "call_hash", "parent_hash", "out_bytes",
    "tok_in", "tok_cached", "tok_cache_new", "tok_out", "patch_add", "patch_del", "error",
)
COUNTERS = ("tok_in", "tok_cached", "tok_cache_new", "tok_out", "patch_add", "patch_del")
BRANCHES = ("codex", "claude_desktop", "claude_desktop_mcp", "cursor", "kiro", "antigravity")

# Event forms: which direct keys hold the tool name, the arguments and the call id.
FORM_KEYS = {
    "direct": (("tool", "name"), ("input", "arguments", "tool_input"), ("callID", "call_id", "tool_use_id")),
    "nested": (("name", "tool"), ("input", "arguments", "tool_input"), ("id", "call_id", "callID", "tool_use_id")),
    "fallback": (("name",), ("arguments",), ("call_id",)),
    "item": (("name", "tool", "callable_tool_name"), ("arguments", "input", "command", "action"), ("call_id", "callID", "id")),
    "hook": (("tool_name", "toolName", "tool", "name"), ("tool_input", "input", "arguments"), ("session_id", "call_id", "id")),
    "agy": (("tool", "tool_name", "name", "command"), ("input", "arguments", "command", "content"), ()),
    "cursor": ((), ("args", "arguments", "input"), ()),
    "state": ((), ("content", "value"), ()),
}
# Forms that repeat the counters of their line.
COUNTING_FORMS = ("base", "fallback", "item", "hook", "rpc", "cursor", "state", "agy", "message", "said")


def lines_of(logs: DataFrame, log: str = "log_id", content: str = "content") -> DataFrame:
    """One row per non-blank line, numbered from 1 (S01). Other columns are kept."""
    keep = [c for c in logs.columns if c != content]
    split = F.filter(
        F.transform(F.split(F.col(content), "\n"), X.trimmed), lambda line: line != ""
    )
    return logs.select(*keep, F.posexplode(split).alias("_at", "raw")).select(
        *keep, (F.col("_at") + 1).cast("long").alias("turn"), "raw"
    )


def salvaged(source: Column, raw: Column) -> Column:
    """For some sources, drop text before the first '{' if the rest is JSON."""
    start = F.locate("{", raw)
    rest = X.trimmed(F.substr(raw, F.greatest(start, F.lit(1))))
    usable = source.isin(*PREFIXED_SOURCES) & (start > 1) & F.try_parse_json(rest).isNotNull()
    return F.when(usable, rest).otherwise(raw)


def with_nodes(lines: DataFrame, source: str = "source_id", raw: str = "raw") -> DataFrame:
    return lines.withColumn("event_raw", salvaged(F.col(source), F.col(raw))).withColumn(
        "nodes", J.json_nodes("event_raw")
    )


def turns_of(lines: DataFrame, raw: str = "raw") -> DataFrame:
    """Parse lines into turns: text, is_tool, is_error, command, tool_name.

    Turns are read from the line as it stands; only events use the salvaged line.
    """
    kept = [c for c in lines.columns if c not in ("nodes", "event_raw")]
    lines = lines.select(*kept).withColumn("_nodes", J.json_nodes(raw))
    lines, d = J.with_doc(lines, "_nodes", "_d_")
    is_json = F.col("_nodes").isNotNull()
    own_command = F.coalesce(J.first_string(d, "command"), F.lit(""))
    flagged = (J.first_string(d, "error") != "") | J.any_true(d, "is_error")
    lines = J.settled(
        lines,
        {
            "is_json": is_json,
            "text": F.when(is_json, J.flat_text(d.nodes)).otherwise(F.col(raw)),
            "_command": own_command,
            "_tool": J.first_string(d, "tool"),
            "_name": J.first_string(d, "name"),
            "_typed": F.coalesce(J.type_contains(d, "tool"), F.lit(False)),
            "_flagged": F.coalesce(flagged, F.lit(False)),
        },
    )
    command = F.when(F.col("_command") != "", F.col("_command")).otherwise(
        X.command_in(F.col("text"))
    )
    return (
        lines.withColumn("command", command)
        .withColumns(
            {
                "tool_name": F.coalesce(F.nullif(F.col("_tool"), F.lit("")), F.col("_name")),
                "is_error": F.col("_flagged") | X.looks_failed(F.col("text")),
                "is_tool": F.col("_typed") | (F.col("_tool") != "") | (F.col("command") != ""),
            }
        )
        .select(
            *kept, "is_json", "text", "is_tool", "is_error", "command", "tool_name"
        )
    )


def _one(test: Column, form: str, root: Column | str = "") -> Column:
    root = F.lit(root) if isinstance(root, str) else root
    made = F.array(F.struct(F.lit(form).alias("form"), root.alias("root")))
    return F.when(test, made).otherwise(_no_candidates())


def _no_candidates() -> Column:
    return F.array().cast("array<struct<form:string,root:string>>")


def _formed(paths: Column, form: str) -> Column:
    return F.transform(paths, lambda p: F.struct(F.lit(form).alias("form"), p.alias("root")))


def _nested_tool_paths(d: J.Doc) -> Column:
    """Parents of `type` strings that name a nested tool use or result, root excluded."""
    typed = F.filter(
        d.keyed,
        lambda x: (x["key"] == "type")
        & (x["kind"] == "string")
        & (x["parent"] != "")
        & F.lower(F.trim(x["text"])).isin(*NESTED_KINDS),
    )
    return F.transform(typed, lambda x: x["parent"])


def _topmost(name: str) -> Column:
    """Paths of a column that no other path of it contains."""
    return F.filter(
        name,
        lambda p: ~F.exists(name, lambda q: p.startswith(F.concat(q, F.lit("/")))),
    )


def _names_tool(d: J.Doc, root="") -> Column:
    hook = F.lower(J.direct_string(d, "hook_event_name", "eventName", "event", root=root))
    tool = J.direct_string(d, "tool_name", "toolName", "tool", "name", root=root)
    return hook.contains("tool") | (tool != "")


def _is_rpc(d: J.Doc, root="") -> Column:
    return (J.direct_string(d, "method", root=root) != "") | J.has_value(d, "result", root)


def with_candidates(rows: DataFrame, d: J.Doc, src: Column, wanted: set[str]) -> DataFrame:
    """Add `_cands`, the (form, root) pairs that become events of the line.

    `rows` has the shared columns of `_with_base`.
    """
    special = F.when(d.nodes.isNull(), _one(F.lit(True), "plain"))
    if "codex" in wanted:
        known = F.col("_item_type").isin(
            "session_meta", "turn_context", "compacted", "event_msg"
        )
        item = F.coalesce(J.first_object(d, "item"), F.lit(""))
        special = special.when(F.col("_rollout") & known, _one(F.lit(True), "base")).when(
            F.col("_rollout") & (F.col("_item_type") == "response_item"),
            _one(F.lit(True), "item", item),
        )
    if "claude_desktop_mcp" in wanted:
        used = _is_rpc(d) | (J.first_string(d, "method") != "")
        special = special.when(src == "claude_desktop_mcp", _one(used, "rpc"))
    if wanted & {"claude_desktop", "kiro"}:
        objects = F.transform(
            F.filter(d.nodes, lambda x: (x["kind"] == "object") & (x["path"] != "")),
            lambda x: x["path"],
        )
        fires = F.when(
            src == "claude_desktop",
            F.filter(objects, lambda p: _names_tool(d, p) | _is_rpc(d, p)),
        ).when(src.isin("kiro_cli", "kiro_ide"), F.filter(objects, lambda p: _names_tool(d, p)))
        rows = J.settled(rows, {"_fires": fires})
        rows = J.settled(rows, {"_inner_top": _topmost("_fires")})
        # Without request state a result has no open request: calls and messages only.
        walked = F.filter(
            F.transform(
                "_inner_top",
                lambda p: F.struct(
                    F.when(_names_tool(d, p), "hook")
                    .when(J.first_string(d, "method", p) != "", "rpc")
                    .otherwise("")
                    .alias("form"),
                    p.alias("root"),
                ),
            ),
            lambda c: c["form"] != "",
        )
        opening = (
            J.direct_string(d, "initialMessage", "title", "processName") != ""
        ) | J.has_value(d, "enabledMcpTools")
        special = (
            special.when(
                (src == "claude_desktop") & _is_rpc(d),
                _one(J.first_string(d, "method") != "", "rpc"),
            )
            .when(
                src.isin("claude_desktop", "kiro_cli", "kiro_ide") & _names_tool(d),
                _one(F.lit(True), "hook"),
            )
            .when(src == "claude_desktop", F.concat(_one(opening, "message"), walked))
            .when(src.isin("kiro_cli", "kiro_ide"), walked)
        )
    if "cursor" in wanted:
        keyed = J.direct_string(d, "key_type") != ""
        stateful = (
            J.direct_string(d, "key_type").contains("agentkv")
            | J.has_value(d, "tool")
            | J.has_value(d, "toolCall")
        )
        special = (
            special.when(
                (src == "cursor") & keyed & (F.col("_inner_tool") != ""),
                _one(F.lit(True), "cursor", J.INNER),
            )
            .when((src == "cursor") & keyed & stateful, _one(F.lit(True), "state"))
            .when((src == "cursor") & keyed, _one(F.lit(True), "message"))
            .when(src == "cursor", _one(F.col("_tool") != "", "cursor"))
        )
    if "antigravity" in wanted:
        kind = F.lower(J.direct_string(d, "type", "event_type", "kind"))
        special = special.when(
            (src == "antigravity") & kind.isin("user_input", "user"), _one(F.lit(True), "said")
        ).when(
            (src == "antigravity") & kind.rlike("tool|terminal|command"), _one(F.lit(True), "agy")
        )
    rows = J.settled(rows, {"_special": special})
    unread = (F.coalesce(F.size("_special"), F.lit(-1)) <= 0) & (src != "claude_desktop_mcp")
    has_counts = F.greatest(*[F.abs(F.col(c)) for c in COUNTERS]) > 0
    keeps_base = has_counts | F.col("_kind").isin(*KEPT_KINDS)
    named = J.direct_string(d, "tool", "name") != ""
    generic = F.concat(
        _one(keeps_base, "base"),
        _one(named, "direct"),
        _formed(_topmost("_nested"), "nested"),
    )
    alone = ~named & (F.size("_nested") == 0)
    fallback = alone & (~keeps_base | ((F.col("_kind") == "message") & ~has_counts))
    return rows.withColumns(
        {
            "_cands": F.when(~unread, F.col("_special"))
            .when(fallback, _one(F.lit(True), "fallback"))
            .otherwise(generic),
            "_source": F.when(unread & (src == "codex"), "codex_generic").otherwise(src),
        }
    )


def _with_base(rows: DataFrame, d: J.Doc, src: Column, wanted: set[str]) -> DataFrame:
    """Columns that all events of a line share."""
    own = [s for b in BRANCHES for s in (("kiro_cli", "kiro_ide") if b == "kiro" else (b,)) if b in wanted and b != "codex"]
    desk = src.isin(*own) if own else F.lit(False)
    kind = B.bounded_kind(J.first_string(d, "type"))
    desk_kind = B.bounded_kind(J.direct_string(d, "type", "kind", "hook_event_name", "event_type"))
    parent = F.coalesce(
        *[F.nullif(J.first_string(d, k), F.lit("")) for k in ("parentUuid", "parentID", "parent_id")],
        F.lit(""),
    )
    if "codex" in wanted:
        bounded = B.bounded_kind(F.col("_item_type"))
        is_message = (F.col("_item_type") == "event_msg") & (kind != "message")
        framed = F.col("_item_type").isin(
            "session_meta", "turn_context", "compacted", "event_msg", "response_item"
        )
        kind = (
            F.when(F.col("_rollout") & is_message, kind)
            .when(F.col("_rollout") & framed, bounded)
            .otherwise(kind)
        )
        parent = F.when(
            F.col("_rollout") & framed,
            J.direct_string(d, "parentUuid", "parentID", "parent_id"),
        ).otherwise(parent)
    rows = J.settled(
        rows, {"_last": J.first_object(d, "last_token_usage"), "_nested": _nested_tool_paths(d)}
    )
    return J.settled(
        rows,
        {
            "_role": B.bounded_role(J.first_string(d, "role")),
            "_kind": kind,
            "_desk_kind": desk_kind if own else F.lit("message"),
            "_parent": F.when(desk, "").otherwise(X.short_hash(parent)),
            "_error": J.has_error(d),
            "_tool": J.first_string(d, "tool"),
            **J.usage(d, F.col("_last")),
            **J.patch_lines(d),
        },
    )


def _by_form(make, empty: Column, slot: int) -> Column:
    out = None
    for form, keys in FORM_KEYS.items():
        if keys[slot]:
            test = F.col("form") == form
            value = make(*keys[slot])
            out = F.when(test, value) if out is None else out.when(test, value)
    return out.otherwise(empty)


def _fields(cands: DataFrame, d: J.Doc, src: Column) -> DataFrame:
    """Event columns of each (form, root) candidate."""
    root, form = F.col("root"), F.col("form")
    own_type = J.direct_string(d, "type", root=root)
    hook = F.lower(J.direct_string(d, "hook_event_name", "eventName", "event", root=root))
    item_type = F.coalesce(F.nullif(own_type, F.lit("")), J.first_string(d, "type", root))
    agy_type = F.lower(J.direct_string(d, "type", "event_type", "kind"))
    method = F.coalesce(
        F.nullif(J.direct_string(d, "method", root=root), F.lit("")),
        J.first_string(d, "method", root),
    )
    cands = J.settled(
        cands,
        {
            "_t": F.when(form == "item", item_type).otherwise(own_type),
            "_method": F.when(form == "rpc", method).otherwise(""),
            "_params": F.when(form == "rpc", J.first_object(d, "params", root)),
            "_state": F.when(
                (form == "direct") & (src == "opencode"), J.at(J.first_object(d, "state"), "input")
            ),
        },
    )
    bounded = B.bounded_kind(F.col("_t"))
    gives = bounded.isin("tool_result", "function_call_output")
    is_rpc_call = F.lower("_method").rlike("tools/call|resources/read")
    answered = J.has_value(d, "output", root) | F.when(
        form == "hook", hook.contains("post") | J.has_value(d, "tool_response", root)
    ).otherwise(J.has_value(d, "result", root) | agy_type.contains("result"))
    what = (
        F.when(form == "direct", F.when(gives, "tool_result").otherwise("tool_call"))
        .when(
            form == "nested",
            F.when(bounded.isin("tool_use", "function_call"), "tool_call").otherwise("tool_result"),
        )
        .when(
            form == "fallback",
            F.when(bounded == "function_call", "tool_call").when(gives, "tool_result").otherwise(F.col("_kind")),
        )
        .when(
            form == "item",
            F.when(F.col("_t").isin(*CALL_TYPES), "tool_call")
            .when(F.col("_t").isin(*RESULT_TYPES), "tool_result")
            .otherwise(bounded),
        )
        .when(form.isin("hook", "agy"), F.when(answered, "tool_result").otherwise("tool_call"))
        .when(
            form == "rpc",
            F.when(is_rpc_call, "tool_call").when(F.col("_method") == "", "tool_result").otherwise("message"),
        )
        .when(form.isin("cursor", "state"), "tool_call")
        .when(form.isin("plain", "message", "said"), "message")
        .otherwise(F.col("_kind"))
    )
    cands = J.settled(cands, {"kind": what})
    call = F.col("kind") == "tool_call"
    name = X.bounded_tool(_by_form(lambda *k: J.direct_string(d, *k, root=root), F.lit(""), 0))
    rpc_name = F.coalesce(
        F.nullif(J.direct_string(d, "name", "tool", "method", root=F.col("_params")), F.lit("")),
        F.col("_method"),
    )
    inner_tool = F.col("_inner_tool") if "_inner_tool" in cands.columns else F.lit("")
    tool = (
        F.when(form == "hook", F.coalesce(F.nullif(name, F.lit("")), F.lit("tool")))
        .when(
            form == "agy",
            F.when((name == "") & agy_type.contains("terminal"), "terminal").otherwise(name),
        )
        .when(
            (form == "item") & call & (name == ""),
            F.when(F.col("_t") == "local_shell_call", "shell").otherwise(X.bounded_tool(F.col("_t"))),
        )
        .when(form == "cursor", X.bounded_tool(F.when(root == J.INNER, inner_tool).otherwise(F.col("_tool"))))
        .when(form == "state", X.bounded_tool(F.col("_tool")))
        .when((form == "rpc") & call, X.bounded_tool(rpc_name))
        .when(form.isin("direct", "nested"), name)
        .when(form.isin("item", "fallback") & call, name)
        .otherwise("")
    )
    args = _by_form(lambda *k: J.first_present(d, *k, root=root), F.lit(None).cast("string"), 1)
    args = (
        F.when(form == "rpc", F.col("_params"))
        .when(
            (form == "direct") & F.coalesce(F.map_contains_key(d.sizes, F.col("_state")), F.lit(False)),
            F.col("_state"),
        )
        .otherwise(args)
    )
    number_id = F.try_element_at(
        F.filter(d.nodes, lambda x: (x["path"] == J.at(root, "id")) & (x["kind"] == "number")),
        F.lit(1),
    )["text"]
    request = F.coalesce(
        F.nullif(J.direct_string(d, "id", root=root), F.lit("")), number_id, F.lit("")
    )
    call_id = _by_form(lambda *k: J.direct_string(d, *k, root=root), F.lit(""), 2)
    uses_id = (form != "fallback") | F.col("kind").isin("tool_call", "tool_result") & (
        (bounded == "function_call") | gives
    )
    cands = J.settled(
        cands,
        {
            "tool": tool,
            "_args": F.when(call, args),
            "_request": F.when(form == "rpc", request).otherwise(""),
            "_call": F.when(form == "rpc", request).when(uses_id, call_id).otherwise(""),
            "_sized": (
                (F.col("kind") == "tool_result") & form.isin("direct", "nested", "item", "hook", "agy")
            )
            | ((form == "fallback") & gives)
            | ((form == "direct") & (src == "opencode")),
        },
    )
    result_path = J.first_value(d, "result", root)
    return cands.withColumns(
        {
            "role": F.when(form == "said", "user")
            .when(form == "item", B.bounded_role(J.direct_string(d, "role", root=root)))
            .when(form == "plain", "unknown")
            .otherwise(F.col("_role")),
            "args_hash": J.value_hash(d, F.col("_args")),
            "call_hash": X.short_hash(F.col("_call")),
            "parent_hash": F.coalesce("_parent", F.lit("")),
            "out_bytes": F.when(form == "plain", F.octet_length("event_raw").cast("long"))
            .when(F.col("_sized"), J.output_bytes(d, root))
            .when((form == "rpc") & (F.col("kind") == "tool_result"), J.size_at(d, result_path))
            .otherwise(F.lit(0).cast("long")),
            "error": F.coalesce(
                F.col("_error")
                | ((form == "nested") & (F.col("kind") == "tool_result") & J.has_error(d, root)),
                F.lit(False),
            ),
            "request_id": F.when(call | (F.col("kind") == "tool_result"), F.col("_request")).otherwise(""),
            **{
                c: F.when(form.isin(*COUNTING_FORMS), F.col(c)).otherwise(F.lit(0).cast("long"))
                for c in COUNTERS
            },
        }
    )


def _with_payload(rows: DataFrame, src: Column) -> DataFrame:
    """For rollout rows, `_focus` is the payload object and `_item_type` the outer type."""
    rows = rows.withColumns(
        {
            "_item_type": F.trim(
                F.try_element_at(
                    F.filter("nodes", lambda x: (x["path"] == "/type") & (x["kind"] == "string")),
                    F.lit(1),
                )["text"]
            ),
            "_payload": F.try_element_at(
                F.filter(
                    "nodes", lambda x: (F.lower(x["key"]) == "payload") & (x["kind"] == "object")
                ),
                F.lit(1),
            )["path"],
        }
    )
    filled = F.exists("nodes", lambda x: x["parent"] == F.col("_payload"))
    rows = rows.withColumn("_rollout", (src == "codex") & F.coalesce(filled, F.lit(False)))
    return rows.withColumn(
        "_focus",
        F.when(F.col("_rollout"), J.subtree(F.col("nodes"), F.col("_payload"))).otherwise(
            F.col("nodes")
        ),
    )


def _with_inner(rows: DataFrame, src: Column) -> DataFrame:
    """For state rows, the JSON object inside the content string joins `_focus` under '#'."""
    held = F.try_element_at(
        F.filter(
            "nodes", lambda x: x["path"].isin("/content", "/value") & (x["kind"] == "string")
        ),
        F.lit(1),
    )["text"]
    rows = rows.withColumn("_inner", J.json_nodes(F.when(src == "cursor", held)))
    moved = F.transform(
        "_inner", lambda n: n.withField("path", F.concat(F.lit(J.INNER), n["path"]))
    )
    tool = F.try_element_at(
        F.filter(
            "_inner", lambda n: (n["key"] == "tool") & (n["kind"] == "string") & (n["text"] != "")
        ),
        F.lit(1),
    )["text"]
    return rows.withColumns(
        {
            "_inner_tool": F.coalesce(tool, F.lit("")),
            "_focus": F.when(F.col("_inner").isNotNull(), F.concat("_focus", moved)).otherwise(
                F.col("_focus")
            ),
        }
    )


def events_of(
    lines: DataFrame,
    source: str = "source_id",
    log: str = "log_id",
    only: tuple[str, ...] | None = None,
) -> DataFrame:
    """Normalized events of JSON lines, one row each, `seq` ordering those of a line.

    Every line first gets its shared columns and the list of (form, root) candidates;
    the candidates are exploded and their fields read from the line's path lookups.
    `lines` needs `log`, `source`, `turn` and the columns of `with_nodes`. `only` names
    the source branches to plan for when the caller knows the others cannot occur.
    Results without an open request of the same id are dropped (J02). All of it but J02
    is narrow: no shuffle.
    """
    src = F.col(source)
    wanted = set(BRANCHES) if only is None else set(only)
    rows = lines.select(log, source, "turn", "event_raw", "nodes")
    rows = _with_payload(rows, src) if "codex" in wanted else rows.withColumn("_focus", F.col("nodes"))
    if "cursor" in wanted:
        rows = _with_inner(rows, src)
    rows, d = J.with_doc(rows, "_focus", "_f_")
    rows = _with_base(rows, d, src, wanted)
    rows = with_candidates(rows, d, src, wanted)
    cands = rows.select("*", F.posexplode("_cands").alias("seq", "_cand")).select(
        "*", "_cand.form", "_cand.root"
    )
    events = _fields(cands, d, src).select(
        log, F.col("_source").alias("source"), "turn", "seq", *EVENT_FIELDS, "request_id"
    )
    if "claude_desktop_mcp" not in wanted:
        return events.drop("request_id")
    return matched_results(events, log).drop("request_id")


def matched_results(
    events: DataFrame, log: str = "log_id", request: str = "request_id"
) -> DataFrame:
    """Drop tool results whose request is not open at that point.

    A result counts only if the row before it with the same id is a call; that row then
    is closed. The row before is looked up block by block, so an id may repeat any number
    of times.
    """
    keyed = (F.col("source") == "claude_desktop_mcp") & F.col("kind").isin(
        "tool_call", "tool_result"
    )
    stateful = events.filter(keyed & (F.col(request) != ""))
    others = events.filter(
        ~keyed | ((F.col(request) == "") & (F.col("kind") == "tool_call"))
    )
    block = F.floor(F.col("turn") / blocks.ROWS_PER_BLOCK)
    kept = (
        blocks.value_before(stateful, [log, request], ["turn", "seq"], block, "kind", "_before")
        .filter((F.col("kind") == "tool_call") | (F.col("_before") == "tool_call"))
        .drop("_before")
    )
    return others.unionByName(kept)


# Room for the events of one line between two turns.
POSITION_STEP = 1_000_000


def with_event_position(events: DataFrame) -> DataFrame:
    """Order of a log's events in one number, `turn` first; it has gaps of POSITION_STEP."""
    return events.withColumn("pos", F.col("turn") * F.lit(POSITION_STEP) + F.col("seq"))
