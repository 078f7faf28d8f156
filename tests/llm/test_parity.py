"""The parity-sketch join against all pairs."""

import collections
import os
import random

import numpy as np
import pytest

from turnwise.llm import parity, queries


def shingles(text, k=5):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(rows, percent=80, k=5):
    """{id: (size, component)} by all pairs that share a shingle."""
    sets = {i: shingles(t, k) for i, t in rows}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    holders = collections.defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    pairs = {(a, b) for h in holders.values() for a in h for b in h if a < b}
    for a, b in pairs:
        if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return {i: (len(s), root(i)) for i, s in sets.items()}


def changed(rng, w, rate):
    out = []
    for x in w:
        r = rng.random()
        if r < rate:
            out.append(f"n{rng.randrange(10**6)}")
        elif r < 1.2 * rate:
            continue
        else:
            out.append(x)
    return out


def families(seed):
    """Groups of near copies of many sizes and distances, some around the limit, and one passage in most texts."""
    rng = random.Random(seed)
    passage = [f"p{i}" for i in range(40)]
    texts = []
    for size in (4, 5, 6, 7, 8, 9, 10, 12, 15, 20, 30, 60, 140, 400, 900):
        base = [f"w{rng.randrange(10**6)}" for _ in range(size)]
        for _ in range(14):
            w = changed(rng, base, rng.choice([0, 0.01, 0.02, 0.03, 0.05])) if size > 30 else base + [f"z{rng.randrange(3)}"] * rng.randrange(3)
            if rng.random() < 0.3:
                w = w[: len(w) - rng.randrange(1 + len(w) // 5)]
            if size > 100 and rng.random() < 0.7:
                w = w + passage
            texts.append(" ".join(w).upper() if rng.random() < 0.2 else " ".join(w))
    return [*texts, None, "", " \n", "one", "ONE"]


@pytest.mark.parametrize("side, share, percent", [(256, 1000, 80), (2, 3, 80), (3, 1, 60)])
def test_components_are_those_of_all_pairs(spark, monkeypatch, side, share, percent):
    monkeypatch.setattr(parity, "SIDE", side)
    monkeypatch.setattr(parity, "SHARE", share)
    rows = list(enumerate(families(side + percent)))
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r[0]: tuple(r[1:]) for r in parity.similarity_join(df, percent).collect()}
    assert got == brute(rows, percent)
    assert len({c for _, c in got.values()}) < len(rows) - 30


def test_partners_always_meet(monkeypatch):
    """Any two sets within the bound share one of the segments in which both must meet."""
    rng, bands = np.random.default_rng(5), parity.Bands()
    for trial in range(400):
        n = int(rng.integers(4, 60))
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        b = a
        for _ in range(100):
            c = np.unique(np.r_[np.delete(b, rng.integers(0, len(b))) if rng.random() < 0.5 else b, rng.integers(0, 2**63, rng.integers(0, 2)).astype(np.uint64)])
            if 180 * len(np.intersect1d(a, c)) < 80 * (len(a) + len(c)):
                break
            b = c
        if len(a) == len(np.intersect1d(a, b)) == len(b):
            continue
        key, text, tag = parity.sent_segments(np.r_[a, b], np.array([len(a), len(b)]), bands)
        of = [{t: [k for k, x, y in zip(key, text, tag, strict=True) if x == who and y >> 32 == t] for t in set((tag[text == who] >> 32).tolist())} for who in (0, 1)]
        free = [{int(t >> 32): int(t & 0xFFFFFFFF) for t in tag[text == who]} for who in (0, 1)]

        def prefix(who, t):
            other = of[1 - who].get(t, [])
            both = sorted((k for k in of[who][t] if k in other), key=int)
            return both[: max(0, len(both) - free[who][t])]

        assert any(set(prefix(0, t)) & set(prefix(1, t)) for t in set(of[0]) & set(of[1])), (trial, len(a), len(b))


@pytest.mark.parametrize("percent", [51, 60, 70, 80, 95])
def test_cutting_ends_at_any_limit(monkeypatch, percent):
    """Texts of all sizes soon have more segments than partners can touch; up to one half no number of cuts is enough."""
    cuts, original = iter(range(80)), parity._segment_keys
    monkeypatch.setattr(parity, "_segment_keys", lambda *a: next(cuts) >= 0 and original(*a))
    counts = np.r_[np.arange(400), 3000, 20_000]
    h = np.random.default_rng(percent).integers(0, 2**63, int(counts.sum())).astype(np.uint64)
    h = h[np.lexsort((h, np.repeat(np.arange(len(counts)), counts)))]
    bands = parity.Bands(percent)
    key, text, tag = parity.sent_segments(h, counts, bands)
    linkable = counts[bands.apart(counts + bands.partner(counts)) > 0]
    assert len(key) == len(tag) and set(linkable) <= set(counts[text])
    with pytest.raises(ValueError, match="percent"):
        parity.Bands(50)


def test_query_on_documents(spark, sf, docs):
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    got = {r[0]: tuple(r[1:]) for r in queries.QUERIES["op13_parity_join"](spark, sf).collect()}
    assert got == brute(rows)


def test_edges(spark, odd_docs, empty_docs):
    rows = odd_docs.select("doc_id", "text").collect()
    got = sorted(tuple(r) for r in parity.similarity_join(odd_docs).collect())
    want = brute([tuple(r) for r in rows])
    assert got == sorted((r.doc_id, *want[r.doc_id]) for r in rows)
    assert parity.similarity_join(empty_docs).count() == 0
    none = spark.createDataFrame([(None, "a b c"), (4, "a b c"), (None, None)], "doc_id long, text string")
    assert sorted(parity.similarity_join(none).collect(), key=str) == sorted([(None, 1, 4), (4, 1, 4), (None, 0, None)], key=str)


def test_texts_are_hashed_in_one_reading_and_again_only_if_they_meet(spark, tmp_path, monkeypatch):
    """Every text is hashed once; only those with a segment in common are read a second time."""
    original = parity.shingle_hashes

    def counted(texts, *args, **kw):
        with open(f"{tmp_path}/{os.getpid()}", "a") as f:
            f.writelines(f"{t}\n" for t in texts)
        return original(texts, *args, **kw)

    monkeypatch.setattr(parity, "shingle_hashes", counted)
    texts = [f"lone{i} b{i} c{i} d{i} e{i} f{i} g{i}" for i in range(30)]
    near = [" ".join(f"x{i}" for i in range(40 + k)) for k in range(2)]
    rows = list(enumerate([*texts, *near, near[0]]))
    df = spark.createDataFrame([*rows, rows[0]], "doc_id long, text string").repartition(3)
    got = sorted(tuple(r) for r in parity.similarity_join(df).collect())
    want = brute(rows)
    assert got == sorted([(i, *want[i]) for i, _ in rows] + [(0, *want[0])])
    read = collections.Counter(x for p in tmp_path.iterdir() for x in p.read_text().splitlines())
    assert all(read[t] == (2 if i == 0 else 1) for i, t in enumerate(texts)) and all(read[t] >= 2 for t in near)
