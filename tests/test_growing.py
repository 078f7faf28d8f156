"""Growing logs against the whole ones."""

import random

import pandas as pd
from pyspark.sql import functions as F

from turnwise.catalog.logs import scratch
from turnwise.functions import text as X
from turnwise.operators import normalize as N
from turnwise.operators import sessions as Se
from turnwise.streaming import growing


def line(rng):
    return rng.choice([
        "", "  ", "plain words here " * rng.randrange(1, 90), "error: it failed", "error again", "$ cat a.py b.txt", "command: ls",
        "head -n 3 src/a.py", '{"type": "tool_use", "name": "read", "text": "cat x.md"}', '{"is_error": true, "text": "x"}',
    ])


def test_three_batches_give_the_counters_of_the_whole(spark):
    rng = random.Random(4)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    batches, whole = [[], [], []], {}
    for log in range(5):
        at, text = 0, ""
        for _ in range(30 if log else 1):
            content = "".join(line(rng) + "\n" for _ in range(rng.choice([1, 1, 3, 12])))
            for b in rng.sample(range(3), rng.choice([1, 1, 2])):  # early ones wait, those sent twice count once
                batches[b].append((f"log{log}", at, content))
            at += len(content.encode())
            text += content
        whole[f"log{log}"] = (text, at)
    base = scratch(spark, "growing")
    for rows in batches:
        rng.shuffle(rows)
        spark.createDataFrame(rows, "log_id string, at long, content string").coalesce(1).write.mode("append").parquet(base + "/in")
    stream = spark.readStream.schema("log_id string, at long, content string").option("maxFilesPerTrigger", 1).parquet(base + "/in")

    def sink(batch, batch_id):
        batch.withColumn("_batch", F.lit(batch_id)).write.mode("append").parquet(base + "/out")

    out = growing.growing_sessions(growing.turns_of_chunks(stream))
    job = out.writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", base + "/state")
    job.trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(base + "/out")
    assert got.select("_batch").distinct().count() == 3 and got.filter("waiting").count() > 0
    last = got.groupBy("log_id").agg(F.max_by(F.struct(*[c for c in got.columns if c != "log_id"]), "_batch").alias("r"))
    last = {r["log_id"]: r["r"].asDict() for r in last.collect()}
    logs = spark.createDataFrame([(k, v[0]) for k, v in whole.items()], "log_id string, content string")
    turns = N.turns_of(N.lines_of(logs)).withColumn("tokens", X.token_estimate(F.col("text")))
    for want in Se.session_metrics(turns).collect():
        have = last[want["log_id"]]
        assert {c: have[c] for c in want.asDict() if c != "log_id"} == {c: v for c, v in want.asDict().items() if c != "log_id"}
        assert have["read_to"] == whole[want["log_id"]][1] and not have["waiting"]


class Kept:
    """State of one key that counts how often it is asked."""

    def __init__(self, value=None):
        self.value, self.map, self.calls = value, {}, 0

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def containsKey(self, key):
        self.calls += 1
        return key in self.map

    def getValue(self, key):
        self.calls += 1
        return self.map[key]

    def updateValue(self, key, value):
        self.calls += 1
        self.map[key] = value

    def removeKey(self, key):
        self.calls += 1
        del self.map[key]

    def iterator(self):
        return iter(list(self.map.items()))

    def clear(self):
        self.map = {}


def test_state_is_asked_by_file_and_not_by_line(monkeypatch):
    rows = [(at, k, 10, 10, 5, False, False, ["a.py"]) for at in range(0, 3000, 10) for k in range(10)]
    columns = ["at", "line", "lines", "size", "tokens", "is_tool", "is_error", "files"]
    for held in (growing.MOST_HELD, 7):
        monkeypatch.setattr(growing, "MOST_HELD", held)
        job = growing.GrowingLog()
        job._fold, job._files, job._early = Kept(), Kept(), Kept()
        late = [r for r in rows if r[0] < 1500]
        for part in ([r for r in rows if r[0] >= 1500], late[::-1], late):
            parts = [pd.DataFrame(part[i : i + 700], columns=columns) for i in range(0, len(part), 700)]
            (out,) = job.handleInputRows(("x",), iter(parts), None)
            asked = job._early.calls if part[0][0] >= 1500 else asked
        got = out.iloc[0]
        assert (got["turns"], got["rereads"], got["read_to"], got["waiting"]) == (3000, 2999, 3000, False)
        assert not job._early.map and job._files.map == {("a.py",): (3000,)}
        if held > 7:
            assert asked <= 150 and job._files.calls < 10
