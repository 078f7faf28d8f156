"""Substring removal, near copies, neighbours, licenses and the pipeline against brute force."""

import collections
import hashlib
import os
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from turnwise.llm import anchors, automaton, covering, hilbert, licenses, queries, suffix_sort
from turnwise.llm.common import documents


def patchwork(seed, symbols, glue):
    """Texts put together from shared passages."""
    rng = random.Random(seed)
    base = [[rng.choice(symbols) for _ in range(rng.randrange(20, 90))] for _ in range(6)]
    out = []
    for _ in range(60):
        t = []
        for _ in range(rng.randrange(6)):
            shared = rng.choice(base)[rng.randrange(10) : rng.randrange(11, 90)]
            t += shared if rng.random() < 0.6 else [rng.choice("efghij") for _ in range(rng.randrange(1, 20))]
        out.append(glue.join(t))
    return out + [None, "", out[3], out[3]]


def spans_of(mask):
    e = np.r_[False, mask, False]
    return int((e[1:] & ~e[:-1]).sum())


def brute_bytes(texts, length):
    raw = [(t or "").encode() for t in texts]
    count = collections.Counter(d[i : i + length] for d in raw for i in range(len(d) - length + 1))
    out = []
    for d in raw:
        cover = np.zeros(len(d), bool)
        for i in range(len(d) - length + 1):
            if count[d[i : i + length]] > 1:
                cover[i : i + length] = True
        kept = bytes(np.frombuffer(d, np.uint8)[~cover])
        out.append((len(d), int(cover.sum()), spans_of(cover), hashlib.sha256(kept).hexdigest()))
    return out


def brute_words(texts, length):
    lists, first = [(t or "").encode().split() for t in texts], {}
    for n, d in enumerate(lists):
        for i in range(len(d) - length + 1):
            first.setdefault(tuple(d[i : i + length]), n)
    out = []
    for n, d in enumerate(lists):
        cover = np.zeros(len(d), bool)
        for i in range(len(d) - length + 1):
            if first[tuple(d[i : i + length])] < n:
                cover[i : i + length] = True
        kept = b" ".join(w for w, c in zip(d, cover, strict=True) if not c)
        out.append((len(d), int(cover.sum()), hashlib.sha256(kept).hexdigest()))
    return out


CASES = [(20, 8, 2000, 1 << 24, 20_000), (20, 10, 2, 3000, 50), (16, 4, 2, 3000, 50), (16, 4, 2000, 3000, 50)]


@pytest.mark.parametrize("length, core, hot, held, part", CASES)
def test_suffix_sort_removes_what_brute_force_does(spark, monkeypatch, length, core, hot, held, part):
    for name, value in (("HOT", hot), ("RUN_BYTES", held), ("PER_PART", part)):
        monkeypatch.setattr(suffix_sort, name, value)
    texts = patchwork(length + core + hot, "abcd é", "")
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r[0]: tuple(r[1:]) for r in suffix_sort.deduplicate(df, length, core, digests=True).collect()}
    assert [got[i] for i in range(len(texts))] == brute_bytes(texts, length)


@pytest.mark.parametrize("length, core, hot, held, part", CASES)
def test_automata_remove_what_brute_force_does(spark, monkeypatch, length, core, hot, held, part):
    for name, value in (("HOT", hot), ("HELD_BYTES", held), ("PER_PART", part)):
        monkeypatch.setattr(automaton, name, value)
    texts = patchwork(length + core + hot, "abcd", " ")
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r[0]: tuple(r[1:]) for r in automaton.deduplicate(df, length, core, digests=True).collect()}
    assert [got[i] for i in range(len(texts))] == brute_words(texts, length)


def test_planted_passages_are_removed_and_clean_texts_stay(spark):
    """A passage of 400 bytes goes from each text that has it, a shorter one stays; `n_bytes` tells nothing of it."""
    rng = random.Random(11)
    noise = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passages = {400: noise(400), 399: noise(399), 900: noise(900)}
    texts, want = [], []
    for n in (400, 399, 900, 0, 900, 400, 0, 399):
        before, after = "<" + noise(rng.randrange(500)) + ">", "<" + noise(rng.randrange(500)) + ">"
        before, after = f"{before}{len(texts)}", f"{len(texts)}{after}"
        texts.append(before + passages.get(n, "") + after)
        kept = texts[-1] if n < 400 else before + after
        want.append((len(texts[-1]), n if n >= 400 else 0, int(n >= 400), hashlib.sha256(kept.encode()).hexdigest()))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r[0]: tuple(r[1:]) for r in suffix_sort.deduplicate(df, digests=True).collect()}
    assert [got[i] for i in range(len(texts))] == want


def test_merge_gives_order_and_common_prefixes():
    rng = random.Random(5)
    for _ in range(200):
        runs = [sorted(bytes(rng.choice(b"ab") for _ in range(rng.randrange(12))) for _ in range(rng.randrange(9))) for _ in range(rng.randrange(1, 6))]
        got = list(suffix_sort.merge_runs([suffix_sort.front_decode(*suffix_sort.front_code(r)) for r in runs]))
        assert [s for _, s, _ in got] == sorted(x for r in runs for x in r)
        before = b""
        for n, s, _ in got:
            assert n == len(os.path.commonprefix([before, s]))
            before = s


def test_whole_table_by_brute_force(spark, sf):
    docs = pd.read_parquet(f"{sf}/documents.parquet").sort_values("doc_id")
    got = queries.op9(spark, sf).toPandas().sort_values("doc_id")
    assert [tuple(r[1:]) for r in got.itertuples(index=False)] == brute_bytes(docs.text, 400)
    got = queries.op7(spark, sf).toPandas().sort_values("doc_id")
    assert [tuple(r[1:]) for r in got.itertuples(index=False)] == brute_words(docs.text, 50)


def test_removal_edges(odd_docs, empty_docs):
    rows = suffix_sort.deduplicate(odd_docs).toPandas()
    assert len(rows) == odd_docs.count()
    gone = rows.groupby("doc_id").apply(lambda g: (g.n_bytes == g.n_removed).all(), include_groups=False)
    assert gone[[0, 1, 6, 7, 8, 9, 10]].all() and not gone[[2, 3, 4, 5]].any()
    rows = automaton.deduplicate(odd_docs).toPandas().drop_duplicates("doc_id").set_index("doc_id")
    assert rows.n_removed[[6, 9]].tolist() == [0, 0] and rows.n_removed[7] == rows.n_words[7] and rows.n_removed[10] == 90
    assert rows.kept[5] == "Grüße, 日本語 🎉" and rows.kept[7] == ""
    cut = automaton.without_passages(odd_docs)
    assert cut.columns == odd_docs.columns and cut.count() == odd_docs.count()
    for f in (suffix_sort.deduplicate, automaton.deduplicate, automaton.without_passages):
        assert f(empty_docs).count() == 0


def test_automaton_against_reference(spark):
    ref = spark.createDataFrame([("a b c d e f",), (None,), ("x y z",)], "text string")
    df = spark.createDataFrame([(1, "q b c d e q"), (2, "c d x y z"), (3, None)], "doc_id long, text string")
    assert {r.doc_id: r.kept for r in automaton.against(df, ref, 3, shard_words=4).collect()} == {1: "q q", 2: "c d", 3: None}
    with pytest.raises(ValueError, match="words"):
        automaton.against(df, ref, 3, most_words=5)


def test_anchor_filter_is_bounded_and_complete():
    rng = np.random.default_rng(1)
    text = rng.integers(0, 4, 3000).astype(np.uint64)
    found = anchors.find(anchors.mixed(text), np.array([1200, 30, 1770]), 50, 20)
    starts = np.concatenate([np.arange(a, b + 1) for a, b in zip(found.first, found.last, strict=True)])
    assert sorted(starts.tolist()) == [*range(0, 1151), *range(1230, 2951)]
    assert ((found.at >= found.last) & (found.at <= found.first + 30)).all()


def test_every_close_word_visits_the_home():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 1 << 63, 400, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, 400, dtype=np.uint64)
    at, who = covering.visits(x, 2)
    seen = [set() for _ in x]
    for a, w in zip(at.tolist(), who.tolist(), strict=True):
        seen[w].add(a)
    assert sum(map(len, seen)) == len(at)
    for k in range(400):
        bits = rng.choice(64, int(rng.integers(0, 3)), replace=False)
        y = x[k] ^ np.bitwise_or.reduce(np.uint64(1) << bits.astype(np.uint64)) if len(bits) else x[k]
        assert int(covering.homes(np.array([y]))[0]) in seen[k]


def brute_components(ids, near):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in np.flatnonzero(near(i)):
            a, b = find(ids[i]), find(ids[j])
            root[max(a, b)] = min(a, b)
    return [find(i) for i in ids]


def test_simhash_components(spark, monkeypatch):
    import xxhash

    rng = random.Random(8)
    base = [" ".join(f"w{rng.randrange(50)}" for _ in range(rng.randrange(1, 80))) for _ in range(40)]
    texts = base + [b + " tail" for b in base] + [b.replace("w1 ", "w2 ", 1) for b in base] + base[:5] + [None, "", "A b", "a  B"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = covering.near_duplicates(df).toPandas().sort_values("doc_id")
    for text, hexed in zip(texts, got.fingerprint, strict=True):
        ws = (text or "").lower().split()
        shingles = [" ".join(ws[i : i + 3]) for i in range(len(ws) - 2)] or ([" ".join(ws)] if ws else [])
        hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        assert int(hexed, 16) == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))
    fp = np.array([int(x, 16) for x in got.fingerprint], np.uint64)
    want = brute_components(got.doc_id.tolist(), lambda i: np.bitwise_count(fp ^ fp[i]) <= 2)
    assert got.component_id.tolist() == want
    assert len(set(want)) < len(want)


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in covering.components(edges).collect()}
    assert all(got.get(i, i) == 0 for i in range(61)) and got[101] == 100


def test_near_copies_of_five_words(spark):
    rng = random.Random(9)
    rows = []
    for n in range(30):
        ws = [f"v{rng.randrange(4000)}" for _ in range(400)]
        rows.append((3 * n + 2, " ".join(ws)))
        ws[rng.randrange(400)] = "changed"
        rows.append((3 * n, " ".join(ws)))
        rows.append((3 * n + 1, " ".join(ws[:150] + [f"u{rng.randrange(4000)}" for _ in range(250)])))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("id", F.lit("x"))
    got = covering.distinct(df)
    assert got.columns == df.columns
    assert sorted(r.doc_id for r in got.collect()) == sorted(i for n in range(30) for i in (3 * n, 3 * n + 1))


def test_near_copies_are_those_of_exact_similarity(spark):
    """Texts that share a repeated footer only, exact copies, chains and pairs on both sides of 0.8, against brute force."""
    rng = random.Random(19)
    footer = [f"foot{i}" for i in range(12)]
    texts = [" ".join([f"w{rng.randrange(10**6)}" for _ in range(600)] + footer * 33) for _ in range(12)]
    for changes in (1, 4, 8, 12, 16, 22, 30):
        for _ in range(4):
            ws = [f"x{rng.randrange(10**6)}" for _ in range(500)]
            for _ in range(3):
                texts.append(" ".join(ws))
                for at in rng.sample(range(500), changes):
                    ws[at] = f"y{rng.randrange(10**6)}"
    hub = [f"h{rng.randrange(10**6)}" for _ in range(500)]
    for _ in range(40):
        texts.append(" ".join(f"z{rng.randrange(10**6)}" if rng.random() < 0.015 else w for w in hub))
    texts += texts[:4]
    sets = [{tuple(ws[i : i + 5]) for i in range(len(ws) - 4)} for ws in map(str.split, texts)]
    near = [np.array([10 * len(s & t) >= 8 * len(s | t) for t in sets]) for s in sets]
    want = set(brute_components(list(range(len(texts))), lambda i: near[i]))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    kept = {r.doc_id for r in covering.distinct(df).collect()}
    assert want <= kept and set(range(12)) <= kept
    assert len(kept) <= len(want) + 2  # pairs at 0.8 may have a bit too many to meet


def test_sketches_refute_only_pairs_below_the_similarity():
    rng = np.random.default_rng(3)
    for n in (1, 7, 60, 400, 3000):
        for _ in range(30):
            other = int(rng.integers(0, n // 9 + 1))
            base = rng.integers(0, 1 << 63, n + other, dtype=np.uint64)
            one, two = base[:n], base[other:]
            s = covering.parity_sketches(np.r_[one, two], np.array([n, n]))
            turned = int(np.bitwise_count(s[0] ^ s[1]).sum())
            assert turned <= 2 * other
            if n - other >= 0.8 * (n + other):
                assert turned <= covering.most_turned(np.array([2 * n]), 0.8)[0]


def test_a_family_just_below_the_similarity_writes_few_pairs():
    """200 texts of one cell, of 60 shingles each, that share 50 with each other: refuted where they meet."""
    rng = np.random.default_rng(5)
    common = rng.integers(0, 1 << 63, 50, dtype=np.uint64)
    sets = [np.r_[common, rng.integers(0, 1 << 63, 10, dtype=np.uint64)] for _ in range(200)]
    h, counts = np.concatenate(sets), np.full(200, 60)
    fp, label, home = covering.long_fingerprints(h, counts), np.arange(200), np.arange(200)
    without = covering._proposed(fp, counts, label, home, 256, 0.8, covering.ALL)
    refuted = covering._proposed(fp, counts, label, home, 256, 0.8, covering.ALL, covering.parity_sketches(h, counts))
    assert len(without[0]) == 200 * 199 and len(refuted[0]) < 0.05 * len(without[0])


def test_near_copies_do_not_need_unique_ids(spark):
    rows = [(None, "a text of no id"), (None, "another text of no id"), (1, "first of one"), (1, "second of one"), (2, "first of one"), (None, "second of one"), (1, "first of one"), (3, None), (None, "")]
    got = covering.distinct(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got), key=str) == sorted([rows[0], rows[1], rows[2], rows[3], rows[7]], key=str)


def test_copies_edges(odd_docs, empty_docs):
    rows = covering.near_duplicates(odd_docs).toPandas()
    assert len(rows) == odd_docs.count() and set(rows.fingerprint[rows.doc_id < 3]) == {"0" * 16}
    assert set(rows.component_id[rows.doc_id == 7]) == {6}
    kept = covering.distinct(odd_docs)
    assert sorted(r.doc_id for r in kept.collect()) == [0, 3, 4, 5, 6, 8, 9]
    assert covering.near_duplicates(empty_docs).count() == covering.distinct(empty_docs).count() == 0


def test_hilbert_curve_is_one():
    for d, bits in ((2, 3), (3, 2), (4, 2)):
        points = np.stack(np.meshgrid(*[np.arange(1 << bits)] * d, indexing="ij"), -1).reshape(-1, d)
        keys = hilbert.hilbert_keys(points, bits)
        assert sorted(keys.tolist()) == list(range(len(points)))
        assert (np.abs(np.diff(points[np.argsort(keys)], axis=0)).sum(1) == 1).all()


def test_neighbours_recall(spark):
    sf = "/root/testdata/sf0.1"
    got = queries.op8(spark, sf).toPandas()
    e = pd.read_parquet(f"{sf}/embeddings.parquet")
    x, ids = np.stack(e.embedding).astype(float), e.vec_id.to_numpy()
    found = total = 0
    for qid, part in got.groupby("query_id"):
        scores = x @ x[ids == qid][0]
        assert part.sort_values("rank")["rank"].tolist() == list(range(1, 21)) and qid not in set(part.vec_id)
        assert (part.sort_values("rank").score.diff().dropna() <= 0).all()
        scores[ids == qid] = -np.inf
        best = ids[np.lexsort((ids, -scores))[:20]]
        found, total = found + len(set(best) & set(part.vec_id)), total + 20
    assert got.query_id.nunique() == (ids % 20 == 0).sum()
    assert found / total >= 0.9


def test_neighbours_edges(spark):
    nan = float("nan")
    rows = [(1, [1.0, 0.0]), (20, [1.0, 1.0]), (40, None), (60, [0.0, 0.0]), (80, [nan, 1.0]), (3, [None, 1.0]), (4, [1.0, 2.0]), (4, [1.0, 2.0]), (5, [2.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("id", F.lit(1)).withColumn("q", F.lit("q"))
    got = hilbert.search(df, F.col("vec_id") % 20 == 0, k=2).collect()
    assert [tuple(r) for r in sorted(got)] == [(20, 1, 4, 3.0), (20, 2, 5, 3.0)]
    assert hilbert.search(df.limit(0), F.lit(True)).count() == 0


def test_licenses(spark):
    rows = [
        (1, "p/LICENSE", ["Licensed under the Apache License, Version 2.0."]),
        (2, "p/a/b/x.py", ["print(1)"]),
        (3, "p/a/y.py", ["# Released under the MIT License."]),
        (4, "p/a/COPYING.txt", ["This work is licensed under the GNU General Public License, version 3."]),
        (5, "q/z.py", ["our license is our own affair"]),
        (6, None, None),
        (7, "p/top.py", []),
        (7, "p/top.py", []),
        (8, "p/a/b/c/", [None, ""]),
    ]
    df = spark.createDataFrame(rows, "file_id int, path string, lines array<string>").withColumn("line", F.lit(0)).withColumn("license", F.lit(0))
    got = licenses.scan(df, F.col("lines"), F.col("path")).collect()
    assert len(got) == 9
    by = {r.file_id: (r.own_license, r.directory, r.license) for r in got}
    assert by[1] == ("Apache-2.0", None, "Apache-2.0") and by[3] == ("MIT", None, "MIT")
    assert by[2] == (None, "p/a", "GPL-3.0") and by[8] == (None, "p/a", "GPL-3.0") and by[7] == (None, "p", "Apache-2.0")
    assert by[5] == by[6] == (None, None, None)
    assert licenses.scan(df.limit(0), F.col("lines"), F.col("path")).count() == 0


def test_license_plan_is_native(spark, sf):
    plan = queries.op4(spark, sf)._jdf.queryExecution().toString()
    # Checkpoints are read back as existing RDDs; Python would show as one of these nodes.
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas", "CartesianProduct"))


def test_pipeline_stages_hold_together(spark, sf, odd_docs):
    assert [k for k, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "near_duplicates", "passages", "packing"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    left = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = left.count()
        left = spark.createDataFrame(stage(spark, left, sf).toPandas(), docs.schema)
        assert left.columns == docs.columns and left.count() <= before, name
    rows = corpus_pipeline.run(spark, sf).toPandas()
    assert set(rows.doc_id) == {r.doc_id for r in left.select("doc_id").collect()}
    nothing = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, sf).count() == 0, name


def test_pipeline_writes_the_packed_ids(spark, sf):
    import zlib

    stage = dict(corpus_pipeline.STAGES)["packing"]
    rows = stage(spark, documents(spark, sf).limit(50), sf).toPandas()
    assert len(rows) and [len(x) for x in rows.ids] == (4 * rows.length).tolist()
    assert [zlib.crc32(x) for x in rows.ids] == rows.ids_crc32.tolist()
