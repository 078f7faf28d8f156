"""Removal of repeated substrings by a distributed merge sort of suffixes that knows common prefixes.

The suffixes are sparse: only those at content-chosen anchors are sorted, since two equal
windows always hold anchors at the same place (see `anchors`). Tasks sort the suffixes of
their documents into runs, front-code them (length of the prefix shared with the one before, and
the rest) and exchange them by the hash of the core. A partition merges its runs with a loser
tree whose entries carry the prefix they share with the last winner: entries with unequal values
are ordered without looking at the strings, others are compared from that length on. The merge
yields the common prefixes of neighbours in the sorted order. Within a stretch of neighbours
that share a core, the windows that occur twice follow from these and from the same values of
the sorted left contexts.

Cores that occur very often are split by the content of the windows before the exchange, and
equal contexts of a task travel once, so that no partition must hold a hot group.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnwise.llm import anchors as A
from turnwise.llm.common import text_chunks
from turnwise.session import cut_lineage

CHUNK = 1 << 20
RUN_BYTES = 24 << 20
PER_PART = 20_000
HOT = 2_000
SPLIT = 8


def common_prefix(a: bytes, b: bytes, at: int = 0) -> int:
    """Length of the common prefix, given that `at` bytes agree."""
    most, step = min(len(a), len(b)), 32
    while at < most:
        end = min(at + step, most)
        x, y = a[at:end], b[at:end]
        if x != y:
            if step == 8 or end - at <= 8:
                while a[at] == b[at]:
                    at += 1
                return at
            step = max(8, step // 4)
        else:
            at, step = end, step * 2
    return most


def front_code(suffixes: list[bytes]) -> tuple[list[int], list[bytes]]:
    shared, rest, before = [], [], b""
    for s in suffixes:
        n = common_prefix(before, s)
        shared.append(n)
        rest.append(s[n:])
        before = s
    return shared, rest


def front_decode(shared: list[int], rest: list[bytes]) -> Iterator[tuple[int, bytes]]:
    before = b""
    for n, r in zip(shared, rest, strict=True):
        before = before[:n] + r
        yield n, before


def merge_runs(runs: list[Iterator[tuple[int, bytes]]]) -> Iterator[tuple[int, bytes, int]]:
    """(prefix shared with the one before, suffix, run) in sorted order.

    Runs give (prefix shared with the one before in the run, suffix). A loser tree; `shared[i]` is
    what run i's head shares with the last winner on its path.
    """
    k = len(runs)
    heads: list[bytes | None] = [None] * k
    shared = [0] * k

    def advance(i: int) -> None:
        try:
            shared[i], heads[i] = next(runs[i])
        except StopIteration:
            heads[i], shared[i] = None, -1

    for i in range(k):
        advance(i)

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser); the loser's value becomes what it shares with the winner."""
        if heads[a] is None:
            return b, a
        if heads[b] is None:
            return a, b
        if shared[a] != shared[b]:
            return (a, b) if shared[a] > shared[b] else (b, a)
        x, y = heads[a], heads[b]
        n = common_prefix(x, y, shared[a])
        first = n == len(x) or (n < len(y) and x[n] < y[n])
        winner, loser = (a, b) if first else (b, a)
        shared[loser] = n
        return winner, loser

    tree = [-1] * max(k, 1)  # losers; leaf i hangs below node (i + k) // 2
    winners = [0] * (2 * k)
    winners[k:] = range(k)
    for node in range(k - 1, 0, -1):
        winners[node], tree[node] = play(winners[2 * node], winners[2 * node + 1])
    top = winners[1] if k > 1 else 0
    while k and heads[top] is not None:
        yield shared[top], heads[top], top
        advance(top)
        node = (top + k) // 2
        while node:
            top, tree[node] = play(top, tree[node])
            node //= 2


def repeated_windows(
    suffixes: list[bytes], shared: np.ndarray, lefts: list[bytes], low: np.ndarray, high: np.ndarray, copies: np.ndarray, length: int
) -> tuple[np.ndarray, np.ndarray]:
    """(record, j) of the windows that start j bytes before a record's core and occur twice.

    Records are sorted by suffix and `shared` is what each shares with the one before. `low` and
    `high` bound the j of a record. For every j, windows are equal if no smaller common prefix
    than length - j lies between their suffixes and none smaller than j between their left
    contexts, read backwards.
    """
    n = len(suffixes)
    order = sorted(range(n), key=[x[::-1] for x in lefts].__getitem__)
    back = np.zeros(n, np.int64)
    before = b""
    for i, k in enumerate(order):
        now = lefts[k][::-1]
        back[i] = common_prefix(before, now)
        before = now
    order = np.array(order, np.int64)
    rows, js = [], []
    for j in range(int(low.min()), int(high.max()) + 1):
        live = np.flatnonzero((low <= j) & (j <= high))
        if not len(live):
            continue
        right = np.cumsum(shared < length - j)
        left = np.empty(n, np.int64)
        left[order] = np.cumsum(back < j)
        key = right[live] * (n + 1) + left[live]
        by = np.argsort(key, kind="stable")
        new = np.flatnonzero(np.r_[True, key[by][1:] != key[by][:-1]])
        count = np.add.reduceat(copies[live][by], new)
        twice = np.repeat(count > 1, np.diff(np.r_[new, len(by)]))
        hit = live[by[twice]]
        rows.append(hit)
        js.append(np.full(len(hit), j))
    none = np.zeros(0, np.int64)
    return (np.concatenate(rows), np.concatenate(js)) if rows else (none, none)


def _joined(texts: list[str | None]) -> tuple[bytes, np.ndarray]:
    raw = [t.encode() if t else b"" for t in texts]
    return b"".join(raw), np.array([len(r) for r in raw], np.int64)


BYTE_HASH = A.mixed(np.arange(1, 257, dtype=np.uint64) * A.STEP)


def _found(raw: bytes, sizes: np.ndarray, length: int, core: int) -> A.Anchors:
    return A.find(BYTE_HASH[np.frombuffer(raw, np.uint8)], sizes, length, core)


def repeated_spans(df: DataFrame, length: int = 400, core: int = 200, id_col: str = "key", text_col: str = "text") -> DataFrame:
    """(id, start, stop) of byte spans covered by windows of `length` bytes that start at two places or more.

    Spans of an id may touch or overlap. `id_col` must be an integer that tells rows apart.
    """

    def cores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in text_chunks(batch, text_col, CHUNK):
                yield pa.RecordBatch.from_arrays([pa.array(_found(*_joined(texts), length, core).core)], ["core"])

    seen = df.select(text_col).mapInArrow(cores, "core bigint").groupBy("core").count().filter("count > 1")
    every, warm, total = A.repeated_filter(seen, "core", F.col("count"), F.col("count") > HOT)
    spark = df.sparkSession
    wide = max(1, (length - core) // SPLIT)
    bits = spark.sparkContext.broadcast((every.tobytes(), warm.tobytes()))
    parts = max(1, -(-total // PER_PART))

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passing, hot = (np.frombuffer(b, np.uint8) for b in bits.value)
        held: dict[tuple, list[int]] = {}
        size = 0
        for batch in batches:
            for rows, texts in text_chunks(batch, text_col, CHUNK):
                raw, sizes = _joined(texts)
                found = _found(raw, sizes, length, core)
                keep = A.passes(passing, found.core)
                found = A.Anchors(*(x[keep] for x in found))
                warm = A.passes(hot, found.core)
                start = np.cumsum(sizes) - sizes
                keys = rows.column(id_col).to_pylist()
                fields = [x.tolist() for x in (found.text, found.at, found.first, found.last, found.core, warm, start[found.text])]
                for text, at, first, last, h, split, base in zip(*fields, strict=True):
                    # windows of a hot core meet by what all windows of a few starts have in common
                    pieces = [(first, last, h)]
                    if split:
                        pieces = []
                        for slot in range((at - last) // wide, (at - first) // wide + 1):
                            lo, hi = at - slot * wide - wide + 1, at - slot * wide
                            pieces.append((max(first, lo), min(last, hi), xxhash.xxh64_intdigest(raw[hi : lo + length], slot)))
                    for a, b, meet in pieces:
                        item = (meet % parts, raw[at : b + length], raw[a:at], at - b)
                        owners = held.get(item)
                        if owners is None:
                            held[item] = [keys[text], at - base]
                            size += length + at - a + 200
                        else:
                            owners += keys[text], at - base
                            size += 16
                if size >= RUN_BYTES:
                    yield _run_rows(held)
                    held, size = {}, 0
        if held:
            yield _run_rows(held)

    exchanged = df.select(id_col, text_col).mapInArrow(
        runs, "part bigint, shared array<int>, rest array<binary>, lefts array<binary>, low array<int>, owners array<array<bigint>>"
    )

    def merged(table: pa.Table) -> pa.Table:
        shared, rest, lefts, low, owners = (table.column(c).to_pylist() for c in ("shared", "rest", "lefts", "low", "owners"))
        at = [0] * len(shared)
        suffixes, prefix, left, lows, who = [], [], [], [], []
        for n, s, run in merge_runs([front_decode(a, b) for a, b in zip(shared, rest, strict=True)]):
            i = at[run]
            at[run] += 1
            suffixes.append(s)
            prefix.append(n)
            left.append(lefts[run][i])
            lows.append(low[run][i])
            who.append(owners[run][i])
        low_j = np.array(lows, np.int64)
        high_j = np.array([len(x) for x in left], np.int64)
        copies = np.array([len(x) // 2 for x in who], np.int64)
        rows, js = repeated_windows(suffixes, np.array(prefix, np.int64), left, low_j, high_j, copies, length)
        order = np.lexsort((-js, rows))
        rows, js = rows[order], js[order]
        new = np.flatnonzero(np.r_[True, (rows[1:] != rows[:-1]) | (js[1:] != js[:-1] - 1)]) if len(rows) else rows
        stop = np.r_[new[1:], len(rows)] - 1 if len(rows) else rows
        ids, starts, stops = [], [], []
        for r, a, b in zip(rows[new].tolist(), js[new].tolist(), js[stop].tolist(), strict=True):
            pairs = who[r]
            for k in range(0, len(pairs), 2):
                ids.append(pairs[k])
                starts.append(pairs[k + 1] - a)
                stops.append(pairs[k + 1] - b + length)
        return pa.table([pa.array(x, pa.int64()) for x in (ids, starts, stops)], [id_col, "start", "stop"])

    return exchanged.groupBy("part").applyInArrow(merged, f"`{id_col}` bigint, start bigint, stop bigint")


def _run_rows(held: dict[tuple, list[int]]) -> pa.RecordBatch:
    """One sorted, front-coded run for each partition."""
    items = sorted(held)
    cols: dict[str, list] = {c: [] for c in ("part", "shared", "rest", "lefts", "low", "owners")}
    edges = [i for i in range(len(items)) if not i or items[i][0] != items[i - 1][0]] + [len(items)]
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        run = items[a:b]
        shared, rest = front_code([x[1] for x in run])
        for c, v in zip(cols, (run[0][0], shared, rest, [x[2] for x in run], [x[3] for x in run], [held[x] for x in run]), strict=True):
            cols[c].append(v)
    kinds = (pa.int64(), pa.list_(pa.int32()), pa.list_(pa.binary()), pa.list_(pa.binary()), pa.list_(pa.int32()), pa.list_(pa.list_(pa.int64())))
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(cols.values(), kinds, strict=True)], list(cols))


def kept_bytes(raw: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int]:
    """What is left outside the spans, and the number of maximal removed stretches."""
    out, at, count, end = [], 0, 0, -1
    for a, b in sorted(spans):
        if a > end:
            count += 1
            out.append(raw[at:a])
        end = max(end, b)
        at = end
    out.append(raw[at:])
    return b"".join(out), count


def deduplicate(df: DataFrame, length: int = 400, core: int = 200, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """id, n_bytes, n_removed, n_spans and what is left of each row's UTF-8 bytes (`kept`, or its hash `kept_sha256`).

    A byte goes if a string of `length` bytes that covers it also starts anywhere else, in the same
    row or another; all are judged on the input. Null and empty texts stay empty; rows shorter
    than `length` are whole; repeated rows are copies of each other and lose all their windows; an
    empty table gives none; other columns are ignored. Ids may be of any type and repeat.
    """
    rows = df.select(F.col(id_col), F.col(text_col), F.xxhash64(id_col, text_col).alias("key"))
    spans = repeated_spans(rows.select("key", F.col(text_col).alias("text")), length, core)
    lists = cut_lineage(spans).groupBy("key").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    joined = rows.join(lists, "key", "left").select(F.col(id_col), F.col(text_col), "spans")
    last = "kept_sha256" if digests else "kept"
    names = [id_col, "n_bytes", "n_removed", "n_spans", last]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data: list[list] = [[], [], [], []]
            for text, spans in zip(batch.column(text_col).to_pylist(), batch.column("spans").to_pylist(), strict=True):
                raw = text.encode() if text else b""
                kept, count = kept_bytes(raw, [(s["start"], s["stop"]) for s in spans or ()])
                for x, v in zip(data, (len(raw), len(raw) - len(kept), count, hashlib.sha256(kept).hexdigest() if digests else kept), strict=True):
                    x.append(v)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string() if digests else pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(id_col), *(pa.array(x, t) for x, t in zip(data, kinds, strict=True))], names)

    kind = df.schema[id_col].dataType.simpleString()
    return joined.mapInArrow(cut, f"`{id_col}` {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, {last} {'string' if digests else 'binary'}")
