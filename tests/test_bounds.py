"""Nothing is lost above the bounds that used to hold, and large numbers stay exact."""

import json
import random

from pyspark.sql import functions as F

from turnwise.functions import buckets as B
from turnwise.functions import json_nodes as J
from turnwise.operators import tooling as T
from turnwise.sources import logs as L


def test_products_of_large_numbers(spark):
    rng = random.Random(6)
    rows = [(rng.randrange(10**18), rng.randrange(1, 10**18), rng.randrange(1, 10**18)) for _ in range(200)] + [(5, 7, 0), (10**15, 35, 100)]
    rows = [(a, b, c) for a, b, c in rows if not c or a * b // c < 2**63]
    df = spark.createDataFrame(rows, "a long, b long, c long")
    got = [r[0] for r in df.select(B.scaled(F.col("a"), F.col("b"), F.col("c"))).collect()]
    assert got == [a * b // c if c else None for a, b, c in rows]
    shares = df.filter("c > 0").select("a", "c", B.rounded_percent(F.col("a"), F.col("c")).alias("p")).collect()
    assert all(r.p == min(100, (r.a * 100 + r.c // 2) // r.c) for r in shares if r.a > 0)


def test_long_strings_stay_whole(spark):
    text = "word " * 3000
    df = spark.createDataFrame([(json.dumps({"a": text, "b": "end"}),)], "raw string")
    rows, d = J.with_doc(df.withColumn("nodes", J.json_nodes("raw")), "nodes", "_d_")
    assert rows.select(J.flat_text(d.nodes)).first()[0] == text + " end"
    assert rows.select(J.flat_text(d.nodes, 4096)).first()[0] == text[:4096] + " [truncated] end"


def test_a_list_of_any_length_is_no_call(spark):
    servers = "".join(f"- own_{i}\n" for i in range(150)) + "mcp__own_1__run\n"
    skills = "".join(f"- skill_{i}\nmcp__own_{i}__run\n" for i in range(150))
    text = f"Available MCP servers:\n{servers}The following skills are available\n{skills}\nthen mcp__own_3__run and the rest\n"
    df = spark.createDataFrame([("a", text)], "log_id string, content string")
    assert T.mcp_call_rows(df, None).count() == 1
    shown = T.exposures(df).first()
    assert shown.mcp_header and shown.skill_header
    assert [len(b) for b in df.select(T.header_blocks(F.col("content"), T.MCP_PHRASES)).first()[0]] == [text.index("\n\n") + 1 - len("Available MCP servers:")]
    deep = spark.createDataFrame([("b", "Available MCP servers:\n" + "- own\n" * 50_000)], "log_id string, content string")
    assert deep.select(F.length(T.outside_headers(F.col("content")))).first()[0] < 40


def test_all_state_rows_are_read(spark):
    rows = [(f"agentKv:{i:05d}", ("x" * 300_000 if i == 7 else f"value {i}").encode()) for i in range(700)]
    df = spark.createDataFrame(rows, "key string, value binary")
    got = L.state_rows(df, ["agentKv:"]).orderBy("rank").collect()
    assert [r.key for r in got] == [r[0] for r in rows] and [r["rank"] for r in got] == list(range(1, 701))
    assert max(len(r.content) for r in got) == 300_000 and not any(r.truncated for r in got)
    few = L.state_rows(df, ["agentKv:"], k=10, max_bytes=1000).orderBy("rank").collect()
    assert len(few) == 10 and [r.truncated for r in few].count(True) == 1
    events = spark.range(900).selectExpr("id AS ts", "'error' AS level", "repeat('y', 400) AS target")
    got = L.diagnostic_rows(events).collect()
    assert sorted(r["rank"] for r in got) == list(range(1, 901)) and {len(r.target) for r in got} == {400}
    assert {r.timestamp for r in got if r["rank"] == 1} == {"899"}
