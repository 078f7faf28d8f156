"""Forms for large inputs against the plain ones: many signatures, frequent pairs, weighted selection."""

import collections
import itertools
import random
import statistics

import pytest
from pyspark.sql import functions as F

from turnwise.functions import literals
from turnwise.functions import text as X
from turnwise.operators import benchstats as Bs
from turnwise.operators import usage as U
from turnwise.registry import signatures


def test_many_signatures_match_as_columns_do(spark):
    rng = random.Random(2)
    known = [s for c in signatures.CATEGORIES.values() for s in c]
    plain = [(f"made-{i}", (rf"(?i)\bword{i}\b", rf"x{i}y+z")) for i in range(300)]
    bare = [("digits", (r"[0-9]{5}",)), ("either", (r"(?i)foo|bar",))]
    words = ["Claude Code", "word7", "WORD12.", "éword9", "x5yyz", "12345", "BAR", "npm install", "git", "mcp", "K"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(9))) for _ in range(200)] + ["", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    for sigs in (known, plain[:40] + bare):
        both = df.select(F.coalesce("t", F.lit("")).alias("t")).select(X.matching_ids(F.col("t"), sigs).alias("a"), literals.matching_ids(F.col("t"), sigs).alias("b"))
        assert both.filter("a <> b").count() == 0 and both.filter("size(a) > 0").count() > 50
    assert df.select(literals.matching_ids(F.col("t"), plain).alias("i")).filter("i IS NULL").count() == 1


def test_a_registry_beyond_the_bound_is_refused(monkeypatch):
    monkeypatch.setattr(literals, "MOST_BYTES", 10)
    with pytest.raises(ValueError, match="split the registry"):
        literals.Signatures([("a", ("x" * 11,))])


@pytest.mark.parametrize("side, minimum", [(256, 3), (4, 3), (3, 1)])
def test_frequent_pairs(spark, side, minimum):
    rng = random.Random(side)
    rows = [[rng.choice("abcdefghij") for _ in range(rng.randrange(5))] for _ in range(60)]
    rows += [[chr(97 + i) for i in range(20)], [], None]
    want = collections.Counter(p for r in rows for p in itertools.combinations(sorted(set(r or [])), 2))
    df = spark.createDataFrame(list(enumerate(rows)), "r int, ids array<string>")
    got = {(x[0], x[1]): x[2] for x in U.frequent_pairs(df, "r", "ids", minimum, side).collect()}
    assert got == {k: v for k, v in want.items() if v >= minimum}


def test_frequent_pairs_take_tasks_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(U, "PAIR_ROWS", 20)
    rng = random.Random(4)
    rows = [rng.sample(range(40), rng.randrange(2, 7)) for _ in range(150)]
    want = collections.Counter(p for r in rows for p in itertools.combinations(sorted(r), 2))
    df = spark.createDataFrame(list(enumerate(rows)), "r int, ids array<int>")
    found = U.frequent_pairs(df, "r", "ids", 2, 3)
    assert {(x[0], x[1]): x[2] for x in found.collect()} == {k: v for k, v in want.items() if v >= 2}
    assert found.rdd.getNumPartitions() >= sum(want.values()) / 20


def test_median_of_ties_and_one_value(spark):
    rng = random.Random(8)
    groups = {"ties": [rng.choice([1.0, 2.0, 2.0, 7.5]) for _ in range(400)], "one": [3.0], "two": [4.0, 1.0], "spread": [2.0**i for i in range(99)]}
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "g string, v double").repartition(5)
    got = {r[0]: r[1] for r in Bs.exact_median(df, "g", value="v").collect()}
    assert got == {g: statistics.median(vs) for g, vs in groups.items()}


def test_plain_words_need_no_search():
    words = literals.Signatures([(w, (rf"(?i)\b{w}\b",)) for w in ("cat", "x_y", "a")] + [("dot", (r"\bgo\.mod\b",)), ("tail", (r"(?i)end",))])
    assert words.ids_in("the Cat, concat X_Y éa go.mods go.mod weekEND") == ["a", "cat", "dot", "tail", "x_y"]
    assert words.ids_in("concat cats xx_y go_mod Go.mod e nd") == [] and not words._plan[2]
    assert literals.Signatures([("n", (r"[0-9]{5}",))]).ids_in("67890") == ["n"]
    assert literals.Signatures([("any", (r"(?i)\bmcp.*git\b",))]).ids_in("mcp\r git") == []


def test_categories_are_read_at_once(spark):
    texts = ["Claude Code and mcp__github__x, npm install, /review", "Cursor rules; uv.lock\n/qa K", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    columns = [X.matching_ids(F.col("t"), sigs).alias(c) for c, sigs in signatures.CATEGORIES.items()]
    one = df.withColumn("ids", literals.matching_by(F.col("t"), signatures.CATEGORIES))
    rows = one.select("ids", F.struct(*columns).alias("want")).collect()
    assert all(r["ids"] == r["want"] for r in rows) and any(r["ids"]["skill"] for r in rows)
    assert one._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
