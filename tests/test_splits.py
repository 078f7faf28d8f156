"""Logs read in byte ranges against their whole texts."""

import random

import pytest
from pyspark.sql import functions as F

from turnwise.functions import text as X
from turnwise.operators import normalize as N
from turnwise.sources import splits
from turnwise.streaming import jobs

KEY = "-----BEGIN {0}PRIVATE KEY-----\n{1}\n-----END {2}PRIVATE KEY-----"


def log(seed, n=400):
    """Lines with secrets, among them keys and values that run over many lines, some never closed."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        kind = rng.randrange(16)
        body = "\n".join("k" * 40 for _ in range(rng.choice([1, 3, 30, 120])))
        if kind == 0:
            a = rng.choice(["RSA ", "OPENSSH ", ""])
            out.append(KEY.format(a, body, rng.choice([a, a, a, "OPENSSH ", "RSA "])))
        elif kind == 1:
            out.append(rng.choice(["token:", "the secret", "API_KEY = '", "set-cookie:"]) + "\n" * rng.randrange(1, 5) + "  abcdefghijklmnopqrstuvwxyz012345=1")
        elif kind == 2 and rng.random() < 0.2:
            out.append(rng.choice(["-----BEGIN RSA PRIVATE KEY-----", "-----END OPENSSH PRIVATE KEY-----", "-----BEGIN OPENSSH PRIVATE KEY-----"]))
        elif kind == 3:
            out.append("  \t")
        elif kind == 4:
            out.append("mail me at someone@example.org é🎉 " + "x" * rng.randrange(200))
        else:
            out.append(f"line {i} " + "word " * rng.randrange(12))
    return "\n".join(out) + rng.choice(["", "\n"])


@pytest.mark.parametrize("split, most", [(3000, 500), (700, 200), (20_000, 100_000)])
def test_rows_are_those_of_whole_texts(spark, tmp_path, split, most):
    texts = {f"log{i}.txt": log(i + split) for i in range(6)} | {"empty.txt": "", "blank.txt": "\n \n\n", "word.txt": "token\n"}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", 1)
    try:
        lines = splits.log_lines(spark, str(tmp_path))
        ranges = lines.select("log", "split").distinct().count()
        done = splits.scrubbed_pieces(lines, most)
        name = F.element_at(F.split("log", "/"), -1).alias("log_id")
        got = {(r[0], r[1]): r[2] for r in splits.numbered_lines(done).select(name, "turn", "raw").collect()}
        fired = {(r[0], r[1]): r[2] for r in splits.redactions(done).select(name, "family", "count").collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert ranges > 30 or split > 3000
    whole = X.with_scrubbed(spark.createDataFrame(list(texts.items()), "log_id string, content string"), "content", out="_s")
    want = N.lines_of(whole.select("log_id", F.col("_s").alias("content")))
    assert got == {(r[0], r[1]): r[2] for r in want.collect()}
    counts = whole.select("log_id", F.inline("redactions")).collect()
    assert fired == {(r[0], r[1]): r[2] for r in counts}
    assert {f for _, f in fired} >= {"private_key", "ssh_private_key", "api_key", "cookie", "email"}


def test_parts_of_a_folder_are_one_log(spark, tmp_path):
    text = log(9, 300)
    lines = text.removesuffix("\n").split("\n")
    folder = tmp_path / "source=a"
    folder.mkdir()
    for k in range(0, len(lines), 37):
        (folder / f"part-{k // 37:05d}-x.txt").write_bytes(("\n".join(lines[k : k + 37]) + "\n").encode())
    done = splits.scrubbed_pieces(splits.parts_as_logs(splits.log_lines(spark, str(tmp_path))), 500)
    got = {r[0]: r[1] for r in splits.numbered_lines(done).select("turn", "raw").collect()}
    whole = X.with_scrubbed(spark.createDataFrame([("a", text)], "log_id string, content string"), "content", out="_s")
    want = N.lines_of(whole.select("log_id", F.col("_s").alias("content")))
    assert got == {r[0]: r[1] for r in want.select("turn", "raw").collect()}
    counts = {r[0]: r[1] for r in whole.select(F.inline("redactions")).collect()}
    assert {r[1]: r[2] for r in splits.redactions(done).collect()} == counts


def test_arriving_logs_are_read_in_ranges(spark, tmp_path):
    (tmp_path / "in").mkdir()
    texts = {f"{i}.jsonl": log(i, 200) for i in range(3)}
    for name, text in texts.items():
        (tmp_path / "in" / name).write_bytes(text.encode())
    ranges, got = [], {}

    def handle(batch, batch_id):
        ranges.append(batch.select("log", "split").distinct().count())
        rows = splits.numbered_lines(splits.pieces(batch, 400)).collect()
        got.update({(r["log"].rsplit("/", 1)[1], r["turn"]): r["raw"] for r in rows})

    spark.conf.set("spark.sql.files.maxPartitionBytes", 2000)
    spark.conf.set("spark.sql.files.openCostInBytes", 1)
    try:
        jobs.intake_lines(spark, str(tmp_path / "in"), str(tmp_path / "state"), handle).awaitTermination()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    want = N.lines_of(spark.createDataFrame(list(texts.items()), "log_id string, content string"))
    assert got == {(r[0], r[1]): r[2] for r in want.collect()} and sum(ranges) > len(texts)
