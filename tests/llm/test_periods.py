"""Periodic runs against brute force."""

import hashlib
import random
import zlib

import pytest

from turnwise.llm import periods, queries


def brute(w, least=6, times=4):
    """(start, length, period) of all runs: stretches of equal words q apart, the smallest q of each."""
    found = {}
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            start = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            length = i - start + q
            if length >= max(least, times * q):
                found.setdefault((start, length), q)
    return sorted((s, n, q) for (s, n), q in found.items())


def collapsed(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return [x for i, x in enumerate(w) if i not in gone]


def repetitive(seed):
    rng = random.Random(seed)
    out = []
    for _ in range(5):
        part = [rng.choice("abcd"[: rng.randrange(1, 5)]) for _ in range(rng.randrange(1, 6))]
        out += (part * 9)[: rng.randrange(1, 45)] if rng.random() < 0.7 else part
    return out


def test_runs_are_those_of_brute_force(spark, monkeypatch):
    monkeypatch.setattr(periods, "AT_ONCE", 50)
    lists = [repetitive(seed) for seed in range(150)]
    df = spark.createDataFrame([(i, "\t".join(w)) for i, w in enumerate(lists)], "doc_id long, text string").repartition(3)
    for r in periods.periodic_runs(df).collect():
        want = brute(lists[r.doc_id])
        assert sorted(tuple(x) for x in r.runs) == want
        assert [tuple(x) for x in r.runs] == sorted(want, key=lambda x: (x[0], x[2]))
        assert r.collapsed.split() == collapsed(lists[r.doc_id], want)


@pytest.mark.parametrize("limits", [periods.RunLimits(2, 2), periods.RunLimits(9, 3)])
def test_other_limits(limits):
    lists = [repetitive(seed) for seed in range(60)]
    runs, _ = periods.measure([[x.encode() for x in w] for w in lists], limits)
    for w, got in zip(lists, runs.to_pylist(), strict=True):
        assert sorted(tuple(x.values()) for x in got) == brute(w, limits.words, limits.periods)


def test_one_long_repetition_takes_no_quadratic_time():
    for w in ([b"a"] * 200_000, [b"a", b"b"] * 100_000):
        runs, _ = periods.measure([w], periods.RunLimits())
        assert runs.to_pylist() == [[{"start": 0, "length": len(w), "period": len(set(w))}]]


def planted(doc_id, text):
    w = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(w)
    if h % 10 == 0 and n:
        a, p = g % n, 0
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return [x.decode() for x in w]


def test_query_on_documents(spark, sf, docs):
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = queries.QUERIES["op12_periodic_runs"](spark, sf).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts)
    for r in got:
        w = planted(r.doc_id, texts[r.doc_id])
        runs = sorted(brute(w), key=lambda x: (x[0], x[2]))
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=(None, None, None))
        milli = best[0] if best[0] is None else 1000 * best[1] // best[2]
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        digests = [hashlib.sha256(x.encode()).hexdigest() for x in (lines, " ".join(collapsed(w, runs)))]
        assert tuple(r) == (r.doc_id, len(runs), *best, milli, *digests)
    assert sum(r.n_runs > 0 for r in got) > 10


def test_edges(odd_docs, empty_docs):
    got = {r.doc_id: r for r in periods.periodic_runs(odd_docs).collect()}
    assert len(got) == odd_docs.select("doc_id").distinct().count()
    assert all(got[i].runs == [] and got[i].collapsed == "" for i in (0, 1, 2))
    assert got[3].collapsed == "one" and got[8].collapsed == "x" * 5000
    assert [tuple(x) for x in got[9].runs] == [(0, 90, 3)] and got[9].collapsed == "same text here"
    assert periods.periodic_runs(empty_docs).count() == 0
