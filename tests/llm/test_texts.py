"""Toxicity, language model, pieces, quality and packing against the libraries and brute force."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from turnwise.llm import bloom_lm, packing, pieces, queries, repetition, toxicity
from turnwise.llm.common import fold

PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")
STRANGE = [
    "", " ", "a", "  a  b ", "\n\n x\ty\x00z\r\n", "▁▁x▁", "<s></s><0x0A><unk>", "日本語 한국어 🎉🎉 é é", "a" * 3000,
    "ab" * 500 + " " * 37 + "c", "1234567890 " * 9, "\U0010ffff x", " ⁇ x", "﻿abc", " x　y", "I'm we'LL don't'S 12ab,c² ª×ß",
    "<|endoftext|>x <|STARTOFTEXT|>", "x́ y ́z", "ΑΣ ΑΣ. Ǆ İ",
]


def test_pieces_agree_with_library(docs):
    own, library = pieces.PieceModel(PIECES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    texts = STRANGE + [r.text for r in docs.limit(60).collect()]
    for text, ids in zip(texts, own.encode(texts), strict=True):
        want = library.encode(text, add_bos=True, add_eos=True)
        assert ids.tolist() == want
        assert own.decode(ids) == library.decode(want)


def test_pieces_edges(spark, odd_docs, empty_docs):
    rows = pieces.encode(odd_docs, PIECES).collect()
    assert len(rows) == odd_docs.count()
    texts = {r.doc_id: r.text for r in odd_docs.collect()}
    assert all(r.decoded == (texts[r.doc_id] or "") for r in rows)
    assert all(len(r.ids) == r.n_tokens for r in rows)
    digests = {r.doc_id: r for r in pieces.encode(odd_docs, PIECES, digests=True).collect()}
    assert digests[0].ids_sha256 == hashlib.sha256(np.array([1, 2], "<u4").tobytes()).hexdigest()
    assert pieces.encode(empty_docs, PIECES).count() == 0


def test_word_tokenizer_agrees_with_library(docs):
    own, library = packing.file_tokenizer(WORDS, 2)(), Tokenizer.from_file(WORDS)
    for text in STRANGE + [r.text for r in docs.limit(60).collect()]:
        assert own([text])[0].tolist() == library.encode(text, add_special_tokens=False).ids + [2]


@pytest.mark.parametrize("seed", range(20))
def test_bins_keep_limits_and_lose_nothing(seed):
    rng = np.random.default_rng(seed)
    tokens = rng.integers(1, 300, 200)
    sizes = np.stack([tokens, (tokens * rng.random(200)).astype(int)], 1)
    limits = packing.Limits(tokens=100, segments=int(rng.integers(2, 9)), loss_tokens=int(rng.integers(20, 101)))
    bins, rest = packing.fill_bins(sizes, limits)
    seen = collections.defaultdict(list)
    for one in [*bins, rest]:
        assert sum(p[2] for p in one) <= limits.tokens and len(one) <= limits.segments
        loss = 0
        for i, start, length in one:
            seen[i].append((start, length))
            plain = sizes[i, 0] - sizes[i, 1]
            loss += max(0, start + length - max(plain, start))
        assert loss <= limits.loss_tokens
    for i in range(200):
        at = 0
        for start, length in sorted(seen[i]):
            assert start == at
            at += length
        assert at == tokens[i]


def test_packing(odd_docs, empty_docs):
    rows = packing.pack(odd_docs.dropDuplicates(["doc_id"]), packing.file_tokenizer(WORDS, 2)).toPandas()
    encode = packing.file_tokenizer(WORDS, 2)()
    texts = {r.doc_id: r.text for r in odd_docs.collect()}
    for doc, part in rows.sort_values("start").groupby("doc_id"):
        whole = encode([texts[doc]])[0]
        assert b"".join(part.ids) == whole.tobytes()
        assert (part.doc_tokens == len(whole)).all()
        assert (part.ids_crc32 == [zlib.crc32(b) for b in part.ids]).all()
    for _, seq in rows.sort_values("offset").groupby("sequence_id"):
        assert (seq.offset == np.r_[0, np.cumsum(seq.length)[:-1]]).all()
        assert seq.length.sum() <= 4096 and len(seq) <= 64
    used = rows.groupby("sequence_id").length.sum()
    assert ((used == 4096) | (used & (used - 1) == 0)).all()
    assert packing.pack(empty_docs, packing.file_tokenizer(WORDS, 2)).count() == 0


def brute_repeats(x):
    out = []
    for i in range(len(x)):
        best = 0
        for j in range(len(x)):
            k = 0
            while i != j and i + k < len(x) and j + k < len(x) and x[i + k] == x[j + k]:
                k += 1
            best = max(best, k)
        out.append(best)
    return out


def test_longest_repeats():
    rng = random.Random(1)
    for _ in range(200):
        lists = [[rng.randrange(rng.choice([1, 2, 3, 8])) for _ in range(rng.randrange(20))] for _ in range(4)]
        flat, sizes = np.array([i for x in lists for i in x], np.int64), np.array([len(x) for x in lists])
        assert repetition.longest_repeats(flat, sizes).tolist() == [b for x in lists for b in brute_repeats(x)]


def test_quality_edges(odd_docs, empty_docs):
    rows = {r.doc_id: r for r in repetition.quality(odd_docs).collect()}
    assert rows[0].n_words == rows[1].n_words == rows[2].n_words == 0 and not rows[0].kept
    assert rows[9].base_failed and not rows[9].kept and rows[9].longest_repeat == 87
    assert rows[6].kept
    assert repetition.quality(odd_docs).count() == odd_docs.count()
    assert {r.doc_id for r in repetition.keep(odd_docs).collect()} == {6, 7}
    assert repetition.keep(odd_docs).columns == odd_docs.columns
    assert repetition.quality(empty_docs).count() == repetition.keep(empty_docs).count() == 0


def test_quality_rejects_long_repeat():
    rng = random.Random(2)
    fresh = [f"w{rng.randrange(10**9)}" for _ in range(2000)]
    got = repetition.measure([" ".join(fresh + fresh[:250])], 8)
    assert got["longest_repeat"][0] == 250
    failed, kept = repetition.verdict(got, repetition.RepeatLimits())
    assert not failed[0] and not kept[0]


def test_language_model_base_is_exact(spark, sf):
    got = queries.op2(spark, sf).toPandas()
    docs = pd.read_parquet(f"{sf}/documents.parquet")
    words = {i: (t or "").encode().lower().split() + [b""] for i, t in zip(docs.doc_id, docs.text, strict=True)}
    learn = {i for i in words if zlib.crc32(str(i).encode()) % 5 != 1}
    counts = collections.Counter(w for i in learn for w in words[i])
    n, v = sum(counts.values()), len(counts)
    assert len(got) == len(docs)
    for r in got.itertuples():
        ws = words[r.doc_id]
        want = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)
        assert r.base_score == pytest.approx(want, rel=1e-9)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ws), sum(counts[w] > 0 for w in ws), n)
        assert r.held_out == (r.doc_id not in learn) and r.score < 0
    assert got.score.sum() > got.base_score.sum()


def test_filter_classes():
    keys = np.arange(1, 3000, dtype=np.uint64) * np.uint64(7919)
    counts = np.arange(1, 3000) % 40 + 1
    s = bloom_lm.FilterSettings()
    content, least = bloom_lm.build_segment(keys, counts, 1 << 17, s)
    q = bloom_lm.classes(content[None, :], np.zeros(len(keys), np.int64), keys, s.probes)
    assert least == 1
    assert (q >= np.floor(np.log2(counts)) + 1).all()  # never too low
    assert (q == np.floor(np.log2(counts)) + 1).mean() > 0.97
    other = bloom_lm.classes(content[None, :], np.zeros(5000, np.int64), np.arange(5000, dtype=np.uint64) * np.uint64(104729) + np.uint64(1), s.probes)
    assert (other > 0).mean() < 0.03
    assert bloom_lm.build_segment(keys, counts, 1 << 12, s)[1] > 1


def test_language_model_is_the_same_past_the_broadcast(docs):
    train = F.col("doc_id") % 5 != 1
    want = bloom_lm.score(docs, train).toPandas().sort_values("doc_id")
    got = bloom_lm.score(docs, train, bloom_lm.FilterSettings(most_bits=1 << 14)).toPandas().sort_values("doc_id")
    assert got.doc_id.tolist() == want.doc_id.tolist() and (got.n_tokens > 1).any()
    assert np.allclose(got.score, want.score, rtol=1e-12) and np.allclose(got.base_score, want.base_score, rtol=1e-12)


def test_language_model_edges(odd_docs, empty_docs):
    rows = bloom_lm.score(odd_docs, F.col("doc_id") < 5).toPandas()
    assert len(rows) == odd_docs.count() and np.isfinite(rows.score).all()
    assert (rows[rows.doc_id < 3].n_tokens == 1).all()
    nothing = bloom_lm.score(odd_docs, F.lit(False)).toPandas()
    assert (nothing.train_tokens == 0).all() and (nothing.n_known == 0).all() and (nothing.base_score == 0).all()
    assert bloom_lm.score(empty_docs, F.lit(True)).count() == 0


def test_toxicity_learns_held_out_words(spark):
    rng = random.Random(4)
    plain = ["".join(rng.choice(["ta", "ro", "mi", "sel", "und", "ker"]) for _ in range(rng.randrange(1, 5))) for _ in range(3000)]
    nasty = ["blockhead", "numbskull", "ratface", "stinkard"]

    def text(toxic):
        ws = [rng.choice(plain) for _ in range(rng.randrange(60, 400))]
        for _ in range(len(ws) // 25 + 2 if toxic else 0):
            ws.insert(rng.randrange(len(ws)), rng.choice(nasty))
        return " ".join(ws)

    rows = [(i, text(i % 4 == 0), int(i % 4 == 0)) for i in range(1600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(df, df.filter(fold("doc_id") != 0))
    got = toxicity.score(df, model).toPandas().merge(df.toPandas(), on="doc_id")
    held = got[[zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]]
    assert (held.predicted == held.toxic).mean() > 0.93
    assert got.score.between(0, 1).all() and ((got.score >= 0.5) == (got.predicted == 1)).all()
    kept = toxicity.clean(df, model)
    assert kept.columns == df.columns and kept.count() == (got.predicted == 0).sum()


def test_toxicity_edges(spark, odd_docs, empty_docs):
    labels = spark.createDataFrame([(6, 1), (9, 0), (None, 1), (5, None)], "doc_id long, toxic int")
    for some in (labels, labels.filter("toxic = 1"), labels.limit(0)):
        rows = toxicity.score(odd_docs, toxicity.fit(odd_docs, some)).toPandas()
        assert len(rows) == odd_docs.count() and rows.score.between(0, 1).all()
    model = toxicity.fit(empty_docs, labels)
    assert toxicity.score(empty_docs, model).count() == toxicity.clean(empty_docs, model).count() == 0
