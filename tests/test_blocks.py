"""Block folds against sequential folds, with blocks and bins far smaller than a session."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from turnwise.operators import blocks
from turnwise.operators import sessions as Se


def rows(seed, n_logs=12):
    rng = random.Random(seed)
    out = []
    for log in range(n_logs):
        # One log holds about a third of all rows.
        length = 160 if log == 0 else rng.randint(1, 40)
        for i in range(length):
            out.append(
                dict(
                    log_id=log, ts=rng.choice([5, 5, 5, rng.randint(0, 400)]), id=len(out),
                    is_error=rng.random() < 0.5, is_tool=rng.random() < 0.6,
                    kind=rng.choice(["tool_call", "tool_call", "message"]),
                    tool=rng.choice(["a", "b"]), args_hash=rng.choice(["x", "x", "y", ""]),
                    parent_hash=rng.choice(["", "p", "q"]), tokens=rng.randint(1, 2000),
                )
            )
    rng.shuffle(out)
    return out


def grouped(data):
    logs = {}
    for r in sorted(data, key=lambda r: (r["log_id"], r["ts"], r["id"])):
        logs.setdefault(r["log_id"], []).append(r)
    return logs


@pytest.mark.parametrize("seed", [1])
def test_folds_equal_sequential(spark, seed):
    data = rows(seed)
    logs = grouped(data)
    df = blocks.dense_position(spark.createDataFrame(data), "log_id", ["ts", "id"], max_rows=9).cache()
    got = {(r.log_id, r.pos): r.id for r in df.select("log_id", "pos", "id").collect()}
    assert got == {(k, i): r["id"] for k, v in logs.items() for i, r in enumerate(v)}

    summed = blocks.running_sum(df, "log_id", "pos", {"s": F.col("tokens")}, rows_per_block=7)
    want = {}
    for k, v in logs.items():
        total = 0
        for i, r in enumerate(v):
            total += r["tokens"]
            want[k, i] = total
    assert {(r.log_id, r.pos): r.s for r in summed.select("log_id", "pos", "s").collect()} == want

    prev = blocks.with_previous(df, "log_id", "pos", ["id"], rows_per_block=5)
    want = {(k, i): (v[i - 1]["id"] if i else None) for k, v in logs.items() for i in range(len(v))}
    assert {(r.log_id, r.pos): r.prev_id for r in prev.select("log_id", "pos", "prev_id").collect()} == want

    before = blocks.value_before(df, ["log_id"], ["pos"], F.floor(F.col("pos") / 7), "id", "b")
    assert {(r.log_id, r.pos): r.b for r in before.select("log_id", "pos", "b").collect()} == want

    depth = Se.retry_depth(df, "log_id", "pos", rows_per_block=6)
    want = {}
    for k, v in logs.items():
        run = best = 0
        for r in v:
            if r["is_error"]:
                run += 1
                best = max(best, run)
            elif not r["is_tool"]:
                run = 0
        want[k] = best
    assert {r.log_id: r.retry_depth_max for r in depth.collect()} == want

    events = df.withColumnRenamed("is_error", "error")
    loops = Se.identical_retries(events, "log_id", "pos", rows_per_block=4)
    want = {}
    for k, v in logs.items():
        last, run, best = None, 0, 0
        for r in v:
            call = r["kind"] == "tool_call"
            if call:
                same = (
                    last is not None and last["tool"] == r["tool"] and last["args_hash"]
                    and last["args_hash"] == r["args_hash"] and last["failed"]
                    and (not last["parent_hash"] or not r["parent_hash"] or last["parent_hash"] == r["parent_hash"])
                )
                run = run + 1 if same else 0
                best = max(best, run)
                last = dict(r, failed=r["is_error"])
            elif r["is_error"] and last is not None:
                last["failed"] = True
        if last is not None:
            want[k] = best
    assert {r.log_id: r.args_hashed_retry_loops for r in loops.collect()} == want


SPREADS = {
    "shared prefix": "concat('/home/u/logs/', lpad(id, 9, '0'))",
    "exponential": "pow(2.0D, id * 60 / 4000)",
    "ties": "id div 1300",
    "struct": "named_struct('a', 7, 'b', id)",
}


@pytest.mark.parametrize("kind", SPREADS)
def test_parts_of_a_hot_session_stay_bounded(spark, kind):
    df = spark.range(4000).selectExpr("0 AS log_id", "id", f"{SPREADS[kind]} AS o")
    parts = blocks.spread(df, "log_id", ["o", "id"], 4000 * 2 // 100)
    sizes = [r["count"] for r in parts.groupBy("_part").count().collect()]
    assert sum(sizes) == 4000 and max(sizes) <= 4 * 100


KINDS = {
    "long": "v", "double": "v / 1000.0", "narrow": "CAST(v AS DOUBLE) / 1e6", "decimal": "CAST(v AS DECIMAL(20, 2)) / 3",
    "date": "date_add(DATE'2020-01-01', CAST(v AS INT))", "timestamp": "timestamp_micros(v * 1000)",
    "string": "lpad(hex(v * 7919 % 10007), 6, '0')", "path": "concat('/a/very/long/prefix/', v)", "bytes": "encode(hex(v), 'UTF-8')",
    "struct": "named_struct('a', v, 'b', id)", "flag": "v % 2 = 0", "odd": "CASE WHEN v % 5 = 0 THEN NULL WHEN v % 7 = 0 THEN double('NaN') WHEN v % 11 = 0 THEN double('Infinity') ELSE v / 3 END",
}


@pytest.mark.parametrize("kind", KINDS)
def test_positions_for_any_order_type(spark, kind):
    rng = random.Random(kind)
    data = [(None if i % 50 == 0 else i % 3 % 2, rng.choice([7, 7, rng.randrange(400)]), i) for i in range(400)]
    df = spark.createDataFrame(data, "log_id int, v long, id long").withColumn("o", F.expr(KINDS[kind]))
    plain = F.row_number().over(Window.partitionBy("log_id").orderBy("o", "id")) - 1
    got = blocks.dense_position(df.withColumn("want", plain), "log_id", ["o", "id"], max_rows=20)
    assert got.count() == 400 and got.filter("pos <> want").count() == 0


def test_input_is_read_once_in_full(spark):
    """The rows come from the written result; of the input, sizes read the session key alone."""
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    df = spark.range(1000).selectExpr("id % 2 AS log_id", "id AS ts", "id")
    got = blocks.dense_position(df.mapInArrow(counted, df.schema), "log_id", ["ts", "id"])
    read = seen.value
    assert got.filter("pos = 3").count() == 2 and got.count() == 1000
    assert seen.value == read <= 2000
