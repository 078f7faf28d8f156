"""Alignment of two tokenizers against the libraries and plain loops."""

import collections
import hashlib

import pytest
import public_tokenizers
from turnwise.llm import alignment, queries

A, B = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def byte_level():
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


BYTES = byte_level()


def spelled(piece):
    if len(piece) == 6 and piece.startswith("<0x") and piece.endswith(">"):
        return bytes([int(piece[3:5], 16)])
    return piece.replace("▁", " ").encode()


def one(libraries, text):
    """(ids of A, ids of B, groups, links as pairs of ids) by plain loops."""
    a, b = libraries
    if not text:
        return [], [], [], []
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    bytes_a = [bytes(BYTES[c] for c in a.id_to_token(i)) for i in ids_a]
    bytes_b = [spelled(b.id_to_piece(i)) for i in ids_b]
    want = (" " + text).encode()
    if b"".join(bytes_a) != want or b"".join(bytes_b) != want:
        return [], [], [], []

    def spans(parts):
        at, out = 0, []
        for p in parts:
            out.append((at, at + len(p)))
            at += len(p)
        return out

    sa, sb = spans(bytes_a), spans(bytes_b)
    cuts = {e for _, e in sa} & {e for _, e in sb}
    sides = []
    for ids, sp in ((ids_a, sa), (ids_b, sb)):
        parts, part = [], []
        for i, (_, e) in zip(ids, sp, strict=True):
            part.append(i)
            if e in cuts:
                parts.append(part)
                part = []
        sides.append(parts)
    groups = list(zip(*sides, strict=True))
    links, j0 = [], 0
    for i, (s, e) in zip(ids_a, sa, strict=True):
        while sb[j0][1] <= s:
            j0 += 1
        j = j0
        while j < len(sb) and sb[j][0] < e:
            links.append((i, ids_b[j]))
            j += 1
    return ids_a, ids_b, groups, links


def brute(libraries, texts):
    each = [one(libraries, t) for t in texts]
    count = collections.Counter(p for *_, links in each for p in set(links))
    best = collections.Counter()
    for (a, _), n in count.items():
        best[a] = max(best[a], n)
    out = []
    for ids_a, ids_b, groups, links in each:
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        n_best = sum(count[p] == best[p[0]] for p in links)
        out.append((len(ids_a), len(ids_b), len(groups), len(links), n_best, sum(count[p] for p in links), text))
    return out, count


ODD = [
    None,
    "",
    " ",
    "  two  spaces \n and\tlines \n\n end ",
    "aaaa aaa aaaaaaa",
    "a▁b has a word mark",
    "<|endoftext|> is </s> plain <s> text <unk> <0x41>",
    "Grüße, 日本語 🎉 naïve façade　x y",
    "same text here " * 5,
    "same text here " * 5,
    "\x00\x01\x1c \x1d​﻿ ́a",
    "don't we'll they'd x" + "é" * 3000,
]


def test_odd_texts(spark, libraries, monkeypatch):
    monkeypatch.setattr(alignment, "BLOCK_BYTES", 60)
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(ODD)], "doc_id int, text string, block int").repartition(3)
    want, count = brute(libraries, ODD)
    got = {r[0]: tuple(r[1:]) for r in alignment.align(df, A, B).collect()}
    assert [got[i] for i in range(len(ODD))] == want
    assert want[5][0] == 0 and want[4][3] > 0
    pairs = {(r.a, r.b): r.n_docs for r in alignment.pair_counts(df, A, B).collect()}
    assert pairs == dict(count)


def test_query_on_documents(spark, sf, docs, libraries):
    rows = docs.select("doc_id", "text").collect()
    want, _ = brute(libraries, [r.text for r in rows])
    got = {r[0]: tuple(r[1:]) for r in queries.QUERIES["op11_tokenizer_alignment"](spark, sf).collect()}
    assert len(got) == len(rows)
    for r, w in zip(rows, want, strict=True):
        assert got[r.doc_id] == (*w[:-1], hashlib.sha256(w[-1].encode()).hexdigest() if w[-1] else "")


def test_edges(spark, odd_docs, empty_docs, libraries):
    rows = odd_docs.select("doc_id", "text").collect()
    want, _ = brute(libraries, [r.text for r in rows])
    got = sorted(tuple(r) for r in alignment.align(odd_docs, A, B).collect())
    assert got == sorted((r.doc_id, *w) for r, w in zip(rows, want, strict=True))
    assert alignment.align(empty_docs, A, B).count() == 0
    assert alignment.pair_counts(empty_docs, A, B).count() == 0


def test_a_small_table_is_emptied(libraries, monkeypatch):
    monkeypatch.setattr(alignment, "TABLE_IDS", 10)
    by = alignment.Aligner(A, B)
    for text in ODD[3:8]:
        got = by.chunk([text, None, text])
        want, _ = brute(libraries, [text])
        assert got.groups() == [want[0][-1], "", want[0][-1]]
