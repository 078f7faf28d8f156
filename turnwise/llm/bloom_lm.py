"""Language-model scores from a log-frequency Bloom filter.

Counts of word pairs over all training rows are quantised to powers of two and kept in a Bloom
filter: a pair of class q is entered with the numbers 1 to q, and its class is read by probing
for 1, 2, ... until one is missing. A pair costs a few bits, whatever its words. The size of the
filter follows the corpus. It is broadcast while `most_bits` give each entry `least_bits`; a larger one stays in its hash
segments, to which each block of text sends its distinct pairs and gets their classes back.

Exact counts of single words don't fit a broadcast. Rows are dealt into blocks of text; the
distinct words of each block are sent to the segments of the hash space that add up their
counts, and the sums go back to the block, where the rows meet them. What is exchanged is one
number for each distinct word of a block, not for each word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnwise.llm.anchors import STEP, mixed
from turnwise.llm.common import text_chunks
from turnwise.session import cut_lineage

END, BEGIN = np.uint64(xxhash.xxh64_intdigest(b"")), np.uint64(xxhash.xxh64_intdigest(b" "))
CHUNK = 1 << 20
HELD_TOKENS = 3_000_000


@dataclass(frozen=True)
class FilterSettings:
    most_bits: int = 1 << 29
    bits_per_entry: int = 10
    least_bits: int = 5
    probes: int = 4
    block_bytes: int = 16 << 20
    segment_bytes: int = 16 << 20


def tokens(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct hashes, index of each token, tokens per text): words in lower case and an end for each text."""
    index: dict[bytes, int] = {b"": 0}
    lists = [t.encode().lower().split() if t else [] for t in texts]
    sizes = np.array([len(x) + 1 for x in lists], np.int64)
    ids = np.zeros(int(sizes.sum()), np.int64)
    is_word = np.ones(len(ids), bool)
    is_word[np.cumsum(sizes) - 1] = False
    ids[is_word] = np.fromiter((index.setdefault(w, len(index)) for x in lists for w in x), np.int64, int(is_word.sum()))
    return np.fromiter(map(xxhash.xxh64_intdigest, index), np.uint64, len(index)), ids, sizes


def pair_keys(hashes: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Of each token with the one before it (a begin mark at first)."""
    now = hashes[ids]
    before = np.empty_like(now)
    before[1:] = now[:-1]
    before[np.cumsum(sizes) - sizes] = BEGIN
    return mixed(before * STEP + now)


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    new = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[new], np.add.reduceat(counts, new) if len(new) else counts


def places(keys: np.ndarray, level: int, probes: int, bits: int) -> Iterator[np.ndarray]:
    """Bit places of (key, level) in a filter of `bits`, a power of two."""
    a = mixed(keys + np.uint64(level * int(STEP) % (1 << 64)))
    b = (a >> np.uint64(32)) | np.uint64(1)
    for i in range(probes):
        yield (a + np.uint64(i) * b) & np.uint64(bits - 1)


def build_segment(keys: np.ndarray, counts: np.ndarray, bits: int, s: FilterSettings) -> tuple[np.ndarray, int]:
    """Filter bytes for distinct keys, and the least count that has an entry."""
    least = 1
    while True:
        own = counts >= least
        level = np.floor(np.log2(np.maximum(counts[own] / least, 1))).astype(np.int64) + 1
        if level.sum() * s.least_bits <= bits:
            break
        least *= 2
    keys, out = keys[own], np.zeros(bits // 8, np.uint8)
    for q in range(1, int(level.max(initial=0)) + 1):
        for at in places(keys[level >= q], q, s.probes, bits):
            np.bitwise_or.at(out, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
    return out, least


def classes(filters: np.ndarray, segment: np.ndarray, keys: np.ndarray, probes: int) -> np.ndarray:
    """Class of each key by repeated membership probes; `filters` has a row of bytes for each segment."""
    width = filters.shape[1]
    flat, bits = filters.reshape(-1), width * 8
    q = np.zeros(len(keys), np.int64)
    live, level = np.arange(len(keys)), 0
    while len(live):
        level += 1
        base, k = segment[live] * width, keys[live]
        sure = np.arange(len(live))
        for i, at in enumerate(places(k, level, probes, bits)):
            at = at if not i else at[sure]
            hit = (flat[base[sure] + (at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0
            sure = sure[hit]
        live = live[sure]
        q[live] = level
        if level == 64:
            break
    return q


def score(
    df: DataFrame, train: Column, settings: FilterSettings = FilterSettings(), id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """id, n_tokens, n_known, train_tokens, base_score and score for each row of `df`.

    `train` tells the rows to learn from. Words are split at ASCII white space, A-Z in lower case; an
    end follows each text, so null and empty texts have one token. `base_score` is the sum of
    log10((c + 0.5) / (N + 0.5 * (V + 1))) with exact counts (words are told apart by 64-bit
    hashes). `score` is the sum of log10 of the pair estimate c(vw) / c(v), from the filter,
    interpolated with the base estimate; the share of the latter is the Good-Turing mass of
    unseen pairs, the training pairs seen once among all. Repeated rows count each; an empty table
    gives none; without training rows every count is zero; other columns are ignored.
    """
    s = settings
    where = [F.input_file_name(), F.input_file_block_start()]
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(train, F.lit(False)).alias("train"), F.xxhash64(*where).alias("place"))
    total, files = rows.agg(F.sum(F.octet_length("text")), F.countDistinct("place")).first()
    total = total or 0
    split = max(1, -(-total // (max(files, 1) * s.block_bytes)))
    rows = rows.select("id", "text", "train", F.xxhash64("place", F.pmod(F.xxhash64("id"), F.lit(split))).alias("block"))
    segments = 16
    while segments * s.segment_bytes < total:
        segments *= 2
    shift = np.uint64(64 - (segments.bit_length() - 1))

    def by_segment(keys: np.ndarray, *more: np.ndarray) -> Iterator[tuple[int, list[bytes]]]:
        """Sorted keys, cut into segments of the hash space."""
        seg = (keys >> shift).astype(np.int64)
        edges = np.flatnonzero(np.r_[True, seg[1:] != seg[:-1], True]) if len(seg) else []
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            yield int(seg[a]), [x[a:b].tobytes() for x in (keys, *more)]

    def vocabulary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            cols: list[list] = [[], [], [], []]
            for block, parts in held.items():
                keys, counts = _summed(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
                for seg, (k, c) in by_segment(keys, counts):
                    for col, v in zip(cols, (seg, block, k, c), strict=True):
                        col.append(v)
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["segment", "block", "keys", "counts"])
            held.clear()

        for batch in batches:
            for part, texts in text_chunks(batch, "text", CHUNK):
                blocks = part.column("block").to_numpy(zero_copy_only=False)
                learn = part.column("train").to_numpy(zero_copy_only=False)
                for block in np.unique(blocks).tolist():
                    mine = np.flatnonzero(blocks == block)
                    hashes, ids, sizes = tokens([texts[i] for i in mine])
                    used = np.repeat(learn[mine], sizes)
                    counts = np.bincount(ids[used], minlength=len(hashes)).astype(np.int64)
                    held.setdefault(block, []).append((hashes, counts))
                    size += len(hashes)
            if size > HELD_TOKENS:
                yield from flush()
                size = 0
        if held:
            yield from flush()

    def added(table: pa.Table) -> pa.Table:
        keys = [np.frombuffer(k, np.uint64) for k in table.column("keys").to_pylist()]
        counts = np.concatenate([np.frombuffer(c, np.int64) for c in table.column("counts").to_pylist()])
        distinct, back = np.unique(np.concatenate(keys), return_inverse=True)
        sums = np.bincount(back, weights=counts).astype(np.int64)
        sizes = [len(k) for k in keys]
        totals = [x.tobytes() for x in np.split(sums[back], np.cumsum(sizes)[:-1])]
        n = len(keys)
        return pa.table(
            {
                "block": pa.array(table.column("block").to_pylist() + [None], pa.int64()),
                "keys": pa.array(table.column("keys").to_pylist() + [None], pa.binary()),
                "totals": pa.array(totals + [None], pa.binary()),
                "n": pa.array([0] * n + [int(sums.sum())], pa.int64()),
                "v": pa.array([0] * n + [int((sums > 0).sum())], pa.int64()),
                "docs": pa.array([0] * n + [int(sums[distinct == END].sum())], pa.int64()),
            }
        )

    pairs_of_blocks = rows.mapInArrow(vocabulary, "segment bigint, block bigint, keys binary, counts binary")
    sums = cut_lineage(pairs_of_blocks.groupBy("segment").applyInArrow(added, "block bigint, keys binary, totals binary, n bigint, v bigint, docs bigint"))
    all_tokens, distinct, ends = (x or 0 for x in sums.filter("block IS NULL").agg(F.sum("n"), F.sum("v"), F.sum("docs")).first())

    bits = 1 << 10
    while bits * segments < min(s.most_bits, all_tokens * s.bits_per_entry):
        bits *= 2
    routed = False

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            keys, counts = _summed(np.concatenate(held), np.ones(size, np.uint32))
            low = (keys >> np.uint64(16)).astype(np.uint32)  # the segment has the bits above
            got = [(seg, low_, c) for (seg, (_, low_, c)) in by_segment(keys, low, counts)]
            kinds = (pa.int64(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([g[i] for g in got], t) for i, t in enumerate(kinds)], ["segment", "keys", "counts"])

        for batch in batches:
            for _, texts in text_chunks(batch, "text", CHUNK):
                held.append(pair_keys(*tokens(texts)))
                size += len(held[-1])
                if size > HELD_TOKENS:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    def filtered(table: pa.Table) -> pa.Table:
        keys = np.concatenate([np.frombuffer(k, np.uint32) for k in table.column("keys").to_pylist()])
        counts = np.concatenate([np.frombuffer(c, np.uint32) for c in table.column("counts").to_pylist()]).astype(np.int64)
        keys, counts = _summed(keys, counts)
        content, least = build_segment(keys.astype(np.uint64), counts, bits, s)
        while routed and least > 1:
            content, least = build_segment(keys.astype(np.uint64), counts, 16 * len(content), s)
        return pa.table({"segment": table.column("segment")[:1], "content": [content.tobytes()], "least": [least], "once": [int((counts == 1).sum())], "pairs": [int(counts.sum())]})

    learned = rows.filter("train").select("text").mapInArrow(counted, "segment bigint, keys binary, counts binary")
    built = learned.groupBy("segment").applyInArrow(filtered, "segment bigint, content binary, least bigint, once bigint, pairs bigint")
    filters = np.zeros((segments, bits // 8), np.uint8)
    least = np.ones(segments, np.int64)
    once = pairs = 0
    for row in built.collect():  # `most_bits` bits at most
        filters[row["segment"]] = np.frombuffer(row["content"], np.uint8)
        least[row["segment"]] = row["least"]
        once, pairs = once + row["once"], pairs + row["pairs"]
    if (least > 1).any():  # too small for all pairs: built again at full size, and not broadcast
        routed, filters, least = True, filters[:0], np.ones_like(least)
        while bits * segments < all_tokens * s.bits_per_entry:
            bits *= 2
        built = cut_lineage(learned.groupBy("segment").applyInArrow(filtered, "segment bigint, content binary, least bigint, once bigint, pairs bigint"))
    unseen = min(max(once / pairs, 0.05), 0.95) if pairs else 1.0
    sent = df.sparkSession.sparkContext.broadcast((filters.tobytes(), least))
    norm = all_tokens + 0.5 * (distinct + 1)

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Distinct pairs of the blocks, by segment."""
        held: dict[int, list] = {}
        size = 0

        def flush() -> pa.RecordBatch:
            got = []
            for block, parts in held.items():
                keys = np.unique(np.concatenate(parts))
                got += [(seg, block, low) for seg, (_, low) in by_segment(keys, (keys >> np.uint64(16)).astype(np.uint32))]
            kinds = (pa.int64(), pa.int64(), pa.binary())
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([g[i] for g in got], t) for i, t in enumerate(kinds)], ["segment", "block", "keys"])

        for batch in batches:
            for part, texts in text_chunks(batch, "text", CHUNK):
                blocks = part.column("block").to_numpy(zero_copy_only=False)
                for block in np.unique(blocks).tolist():
                    held.setdefault(block, []).append(np.unique(pair_keys(*tokens([texts[i] for i in np.flatnonzero(blocks == block)]))))
                    size += len(held[block][-1])
            if size > HELD_TOKENS:
                yield flush()
                size = 0
        if held:
            yield flush()

    def answered(asks: pa.Table, built: pa.Table) -> pa.Table:
        """Pairs with an entry and their classes, as the words and totals of a block."""
        out: list[list] = [[], [], []]
        for content in built.column("content").to_pylist():
            filters = np.frombuffer(content, np.uint8)[None, :]
            for seg, block, keys in zip(*(asks.column(c).to_pylist() for c in ("segment", "block", "keys")), strict=True):
                low = np.frombuffer(keys, np.uint32).astype(np.uint64)
                q = classes(filters, np.zeros(len(low), np.int64), low, s.probes)
                for col, v in zip(out, (block, (np.uint64(seg << 32) | low[q > 0]).tobytes(), q[q > 0].astype(np.uint8).tobytes()), strict=True):
                    col.append(v)
        return pa.table({n: pa.array(c, t) for n, c, t in zip(("block", "keys", "classes"), out, (pa.int64(), pa.binary(), pa.binary()), strict=True)})

    def joined(parts: list[bytes | None], kind: type) -> np.ndarray:
        return np.concatenate([np.zeros(0, kind), *(np.frombuffer(x, kind) for x in parts if x is not None)])

    def scored(docs: pa.Table, words: pa.Table) -> pa.Table:
        content, floors = sent.value
        filters = np.frombuffer(content, np.uint8).reshape(-1, bits // 8)
        paired = words.filter(words.column("classes").is_valid())
        words = words.filter(words.column("classes").is_null())
        known, totals = joined(words.column("keys").to_pylist(), np.uint64), joined(words.column("totals").to_pylist(), np.int64)
        pair_ids, pair_classes = joined(paired.column("keys").to_pylist(), np.uint64), joined(paired.column("classes").to_pylist(), np.uint8)
        by_id = np.argsort(pair_ids)
        pair_ids, pair_classes = np.r_[pair_ids[by_id], np.uint64(2**64 - 1)], np.r_[pair_classes[by_id], np.uint8(0)]
        order = np.argsort(known)
        known, totals = known[order], totals[order]
        out = []
        for batch in docs.to_batches():
            for part, texts in text_chunks(batch, "text", CHUNK):
                hashes, ids, sizes = tokens(texts)
                c = totals[np.searchsorted(known, hashes)][ids]
                base = (c + 0.5) / norm
                keys = pair_keys(hashes, ids, sizes)
                seg = (keys >> shift).astype(np.int64)
                low = ((keys >> np.uint64(16)) & np.uint64(0xFFFFFFFF))
                if routed:
                    sought = keys >> shift << np.uint64(32) | low
                    at = np.searchsorted(pair_ids, sought)
                    q = np.where(pair_ids[at] == sought, pair_classes[at], 0).astype(np.int64)
                else:
                    q = classes(filters, seg, low, s.probes)
                starts = np.cumsum(sizes) - sizes
                history = np.r_[0, c[:-1]]
                history[starts] = ends
                pair = np.where(q > 0, floors[seg] * 2.0 ** (q - 1), 0.0)
                share = np.minimum(pair / np.maximum(history, 1), 1.0)
                p = np.where(history > 0, (1 - unseen) * share + unseen * base, base)
                cols = [sizes, np.add.reduceat((c > 0).astype(np.int64), starts), np.full(len(sizes), all_tokens, np.int64)]
                cols += [np.add.reduceat(np.log10(x), starts) for x in (base, p)]
                out.append(pa.RecordBatch.from_arrays([part.column("id"), *map(pa.array, cols)], [id_col, "n_tokens", "n_known", "train_tokens", "base_score", "score"]))
        return pa.Table.from_batches(out)

    kind = df.schema[id_col].dataType.simpleString()
    right = sums.filter("block IS NOT NULL").select("block", "keys", "totals", F.lit(None).cast("binary").alias("classes"))
    if routed:
        asks = rows.select("text", "block").mapInArrow(asked, "segment bigint, block bigint, keys binary")
        answers = asks.groupBy("segment").cogroup(built.select("segment", "content").groupBy("segment")).applyInArrow(answered, "block bigint, keys binary, classes binary")
        right = right.unionByName(answers.withColumn("totals", F.lit(None).cast("binary")))
    return (
        rows.drop("train")
        .groupBy("block")
        .cogroup(right.groupBy("block"))
        .applyInArrow(scored, f"`{id_col}` {kind}, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
    )
