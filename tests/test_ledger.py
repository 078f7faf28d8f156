"""The ledger of first-seen hashes, day by day, against one grouping of everything."""

import datetime as dt
import random

from pyspark.sql import functions as F

from turnwise.catalog.logs import scratch
from turnwise.operators import funnel as Fu
from turnwise.operators.ledger import SeenLedger

DAYS = [dt.date(2024, 3, d) for d in (1, 2, 3, 4)]


def events(spark, seed=1):
    rng = random.Random(seed)
    pool = [f"{i:064x}" for i in range(40)]
    rows = []
    for n in range(200):
        day = DAYS[rng.choice((0, 1, 3))]  # no event on the third day
        hashes = [rng.choice(pool) for _ in range(rng.randrange(4))] + (["0" * 64] if rng.random() < 0.4 else [])
        rows.append((n, day, hashes if rng.random() < 0.9 else None))
    return spark.createDataFrame(rows, "event long, day date, hashes array<string>")


def run(ledger, rows, days=DAYS):
    out = {}
    for day in days:
        for r in ledger.weigh(rows.filter(F.col("day") == F.lit(day)), "hashes", "event", day).collect():
            out[r.event] = (r.hash_refs, r.weight)
    return out


def test_days_equal_the_whole_and_run_again(spark):
    rows, path = events(spark), scratch(spark, "ledger-test")
    want = {r.event: (r.hash_refs, r.weight) for r in Fu.event_weights(rows, "hashes", "event", "day", "event").collect()}
    ledger = SeenLedger(spark, "seen_one", path, buckets=4)
    assert run(ledger, rows) == want
    first = sorted(map(tuple, ledger.rows().collect()))
    assert len({h for h, _, _ in first}) == len(first)
    assert run(ledger, rows, DAYS[1:]) == {e: w for e, w in want.items() if rows.filter(F.col("event") == e).first().day > DAYS[0]}
    assert sorted(map(tuple, ledger.rows().collect())) == first
    again = SeenLedger(spark, "seen_two", path, buckets=4)
    assert sorted(map(tuple, again.rows().collect())) == first


def test_history_is_read_without_an_exchange(spark):
    ledger = SeenLedger(spark, "seen_plan", scratch(spark, "ledger-plan"), buckets=8)
    rows = events(spark)
    run(ledger, rows, DAYS[:2])
    keep = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    for k, v in zip(keep, ("-1", "false")):
        spark.conf.set(k, v)
    try:
        refs = Fu.event_hashes(rows, "hashes", "event")
        plan = ledger.fresh(refs, DAYS[3])._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)
    scan = next(x for x in plan.splitlines() if "FileScan parquet" in x)
    assert "ReadSchema: struct<hash:string>" in scan and "PartitionFilters" in scan and "day" in scan
    assert "Bucketed: true" in scan


def test_empty_and_null(spark):
    ledger = SeenLedger(spark, "seen_none", scratch(spark, "ledger-none"), buckets=2)
    assert ledger.advance(spark.createDataFrame([], "hash string, event long"), DAYS[0]).count() == 0
    rows = spark.createDataFrame([(None, 1), ("a", 2), ("a", 2), ("a", 1)], "hash string, event long")
    assert [tuple(r) for r in ledger.advance(rows, DAYS[1]).collect()] == [("a", 1)]
    assert ledger.advance(rows.filter("hash IS NULL"), DAYS[1]).count() == 0  # a corrected day that has none left
