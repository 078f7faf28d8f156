"""Events of each source's line shape, on generated sessions whose totals are known."""

import json
import random

import pytest

from turnwise.functions import json_nodes as J
from turnwise.operators import normalize as N
from turnwise.operators import sessions as Se


def events(spark, source, lines):
    raw = [line if isinstance(line, str) else json.dumps(line) for line in lines]
    rows = [(source, source, turn, text) for turn, text in enumerate(raw, 1)]
    return N.events_of(N.with_nodes(spark.createDataFrame(rows, "log_id string, source_id string, turn long, raw string")))


def totals(spark, source, lines):
    return Se.session_signals(N.with_event_position(events(spark, source, lines)), step=N.POSITION_STEP).first()


def counts(rng):
    fresh, read, made, out = (rng.randrange(10, 5000) for _ in range(4))
    return {"fresh": fresh, "read": read, "made": made, "out": out}


@pytest.mark.parametrize("seed", [11, 12])
def test_usage_of_any_number_of_replies_adds_up(spark, seed):
    rng = random.Random(seed)
    replies = [counts(rng) for _ in range(rng.randrange(2, 9))]
    lines = []
    for n, c in enumerate(replies):
        usage = {"input_tokens": c["fresh"], "cache_read_input_tokens": c["read"], "cache_creation_input_tokens": c["made"], "output_tokens": c["out"]}
        lines.append({"type": "user", "message": {"content": f"question {n}"}})
        lines.append({"type": "assistant", "message": {"content": [{"type": "text", "text": "answer"}], "usage": usage}})
    got = totals(spark, "claude_code", lines)
    want = {k: sum(c[k] for c in replies) for k in ("fresh", "read", "made", "out")}
    assert (got.input_tokens, got.cache_read_tokens, got.cache_creation_tokens, got.output_tokens) == tuple(want.values())
    assert got.tool_call_count == 0


@pytest.mark.parametrize("failures", [0, 1, 4])
def test_a_retry_is_the_same_call_after_a_failure(spark, failures):
    lines = []
    for n in range(failures + 1):
        call = {"type": "tool_use", "id": f"id{n}", "name": "Grep", "input": {"pattern": "needle"}}
        lines.append({"type": "assistant", "parentUuid": "root", "message": {"content": [call]}})
        answer = {"type": "tool_result", "tool_use_id": f"id{n}", "is_error": n < failures, "content": "none"}
        lines.append({"type": "user", "message": {"content": [answer]}})
    other = {"type": "tool_use", "id": "z", "name": "Grep", "input": {"pattern": "other"}}
    lines.append({"type": "assistant", "parentUuid": "root", "message": {"content": [other]}})
    got = totals(spark, "claude_code", lines)
    assert got.args_hashed_retry_loops == failures
    assert (got.tool_call_count, got.tool_result_count) == (failures + 2, failures + 1)


@pytest.mark.parametrize("nested", [False, True])
def test_two_shapes_of_one_session_agree(spark, nested):
    """Items and messages may lie in the line or in its payload."""
    rng = random.Random(nested)

    def line(kind, key, body):
        return {"type": kind, "payload": {key: body}} if nested else {"type": kind, key: body}

    calls, spent, lines = rng.randrange(1, 6), 0, []
    for n in range(calls):
        used = rng.randrange(1, 400)
        spent += used
        lines += [
            line("response_item", "item", {"type": "function_call", "call_id": f"k{n}", "name": "search", "arguments": {"q": n}}),
            line("response_item", "item", {"type": "function_call_output", "call_id": f"k{n}", "output": "found"}),
            line("event_msg", "msg", {"type": "token_count", "last_token_usage": {"input_tokens": used, "cached_input_tokens": 0, "output_tokens": 1}}),
        ]
    got = totals(spark, "codex", lines)
    assert (got.tool_call_count, got.tool_result_count) == (calls, calls)
    assert (got.input_tokens, got.output_tokens) == (spent, calls)


def test_only_answers_to_open_requests_count(spark):
    ask = [{"id": i, "method": "tools/call", "params": {"name": f"t{i}"}} for i in (1, 2)]
    answer = [{"id": i, "result": {"content": "done"}} for i in (1, 2, 3)]
    order = [answer[0], ask[0], ask[1], answer[1], answer[0], answer[1], answer[2]]
    got = events(spark, "claude_desktop_mcp", [f"stamp {json.dumps(x)}" for x in order]).orderBy("turn").collect()
    kinds = {r.turn: r.kind for r in got}
    assert [kinds.get(t) for t in (2, 3, 4, 5)] == ["tool_call", "tool_call", "tool_result", "tool_result"]
    assert not any(kinds.get(t) == "tool_result" for t in (1, 6, 7))


def test_lines_that_are_no_objects_are_messages(spark):
    lines = ["plain words", "[3]", "7"]
    assert [r.kind for r in events(spark, "claude_code", lines).collect()] == ["message"] * 3


@pytest.mark.parametrize(
    "text, want",
    [("1", "1"), ("1.0", "1"), ("-2.50", "-2.5"), ("1e3", "1000"), ("1e-7", "1e-7"), ("2.5E+21", "2.5e+21"), ("0.000001", "0.000001"), ("12345678901234567890", "12345678901234567000")],
)
def test_numbers_have_one_form(spark, text, want):
    df = spark.createDataFrame([('{"a": %s}' % text,)], "raw string").select(J.json_nodes("raw").alias("n"))
    assert [n.text for n in df.first().n if n.kind == "number"] == [want]


def test_lines_are_parsed_once_for_retries(spark, tmp_path):
    from turnwise import catalog

    catalog.load_all()
    rows = [(i, i % 3, kind) for i, kind in enumerate(["view", "error", "view", "error", "click", "signup"] * 4)]
    events = spark.createDataFrame(rows, "event_id long, user_id long, event_type string").selectExpr(
        "*", "timestamp_seconds(event_id) AS ts", "1.0D AS value", "'{\"k\": 1}' AS props"
    )
    events.write.parquet(str(tmp_path / "events.parquet"))
    got = catalog.QUERIES["d01_transcript_retries"](spark, str(tmp_path))
    assert "ArrowEvalPython" not in got._jdf.queryExecution().executedPlan().toString()
    assert got.count() == 3
