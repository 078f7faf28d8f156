"""Removal of word passages that an earlier document holds, by suffix automata.

An automaton of a reference accepts all its substrings; a document streamed through it gives
for every word the longest match that ends there (matching statistics), and each state knows the
smallest document that holds its strings. Windows of `length` words with a smaller document
are removed.

`against` takes a reference of bounded size: its automata, one for each shard of the reference,
are broadcast and the documents streamed through each.

`deduplicate` takes the documents themselves as the reference, which no broadcast can hold. There
the shards follow the anchors of `anchors`: equal windows share an anchor, so the windows of one
anchor form a reference shard of their own, and only documents that pass the broadcast filter of
repeated anchors send the words around them there. Anchors that occur very often are split by the
content of their windows, and equal stretches of a task travel once.
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
from turnwise.llm.common import text_chunks, words
from turnwise.session import cut_lineage

CHUNK = 2 << 20
HELD_BYTES = 24 << 20
PER_PART = 2_500
HOT = 500
SPLIT = 8


class SuffixAutomaton:
    """Of several sequences of hashable symbols, each with a number; the smallest number per state."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.size, self.least = [-1], [0], [None]

    def _state(self, size: int, link: int, following: dict, least) -> int:
        self.next.append(following)
        self.link.append(link)
        self.size.append(size)
        self.least.append(least)
        return len(self.size) - 1

    def _split(self, p: int, symbol, q: int) -> int:
        """The state of the strings of `q` that are one longer than those of `p`."""
        nxt, link, size = self.next, self.link, self.size
        if size[q] == size[p] + 1:
            return q
        copy = self._state(size[p] + 1, link[q], dict(nxt[q]), None)
        link[q] = copy
        while p >= 0 and nxt[p].get(symbol) == q:
            nxt[p][symbol] = copy
            p = link[p]
        return copy

    def add(self, sequence: list, number: int) -> None:
        nxt, link, size, least = self.next, self.link, self.size, self.least
        last = 0
        for symbol in sequence:
            known = nxt[last].get(symbol)
            if known is not None:
                last = self._split(last, symbol, known)
            else:
                now = self._state(size[last] + 1, 0, {}, None)
                p = last
                while p >= 0 and symbol not in nxt[p]:
                    nxt[p][symbol] = now
                    p = link[p]
                if p >= 0:
                    link[now] = self._split(p, symbol, nxt[p][symbol])
                last = now
            if least[last] is None or number < least[last]:
                least[last] = number

    def finish(self) -> SuffixAutomaton:
        """Carry the smallest numbers to the shorter suffixes."""
        least, link, size = self.least, self.link, self.size
        for v in sorted(range(1, len(size)), key=size.__getitem__, reverse=True):
            up = link[v]
            if least[v] is not None and (least[up] is None or least[v] < least[up]):
                least[up] = least[v]
        return self

    def matches(self, sequence: list, length: int) -> list:
        """For each window start, the smallest number whose sequence holds the window, or None."""
        nxt, link, size, least = self.next, self.link, self.size, self.least
        out = []
        v = matched = 0
        for i, symbol in enumerate(sequence):
            while v and symbol not in nxt[v]:
                v = link[v]
                matched = size[v]
            if symbol in nxt[v]:
                v = nxt[v][symbol]
                matched += 1
            if i >= length - 1:
                if matched < length:
                    out.append(None)
                else:
                    u = v
                    while size[link[u]] >= length:
                        u = link[u]
                    out.append(least[u])
        return out


def _runs(flags: list[bool]) -> Iterator[tuple[int, int]]:
    """First and last index of each run of true values."""
    begin = None
    for i, f in enumerate(flags):
        if f and begin is None:
            begin = i
        elif not f and begin is not None:
            yield begin, i - 1
            begin = None
    if begin is not None:
        yield begin, len(flags) - 1


def earlier_spans(df: DataFrame, length: int = 50, core: int = 16, id_col: str = "id", key_col: str = "key", text_col: str = "text") -> DataFrame:
    """(key, start, stop) of word spans covered by windows that a row with a smaller id holds."""

    def found(texts: list[str | None]) -> tuple[list[list[bytes]], np.ndarray, np.ndarray, A.Anchors]:
        lists = [words(t) for t in texts]
        sizes = np.array([len(x) for x in lists], np.int64)
        index: dict[bytes, int] = {}
        ids = np.fromiter((index.setdefault(w, len(index)) for x in lists for w in x), np.int64, int(sizes.sum()))
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, index), np.uint64, len(index))
        return lists, sizes, hashes, A.find(hashes[ids], sizes, length, core)

    def cores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in text_chunks(batch, text_col, CHUNK):
                a = found(texts)[3]
                ids = rows.column(id_col).to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([pa.array(a.core), pa.array(ids[a.text])], ["core", "id"])

    some = df.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias(id_col), key_col, text_col)
    per_core = some.mapInArrow(cores, "core bigint, id bigint").groupBy("core")
    seen = per_core.agg(F.count("*").alias("n"), F.min("id").alias("a"), F.max("id").alias("b")).filter("a < b")
    every, warm, total = A.repeated_filter(seen, "core", F.col("n"), F.col("n") > HOT)
    bits = df.sparkSession.sparkContext.broadcast((every.tobytes(), warm.tobytes()))
    parts, wide = max(1, -(-total // PER_PART)), max(1, (length - core) // SPLIT)

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passing, hot = (np.frombuffer(b, np.uint8) for b in bits.value)
        held: dict[tuple, list[int]] = {}
        size = 0
        for batch in batches:
            for rows, texts in text_chunks(batch, text_col, CHUNK):
                lists, sizes, _, a = found(texts)
                keep = A.passes(passing, a.core)
                a = A.Anchors(*(x[keep] for x in a))
                start = (np.cumsum(sizes) - sizes)[a.text]
                ids, keys = rows.column(id_col).to_pylist(), rows.column(key_col).to_pylist()
                fields = [x.tolist() for x in (a.text, a.at - start, a.first - start, a.last - start, a.core, A.passes(hot, a.core))]
                for text, at, first, last, h, split in zip(*fields, strict=True):
                    ws = lists[text]
                    pieces = [(first, last, h)]
                    if split:
                        # windows of a hot anchor meet by what all windows of a few starts have in common
                        pieces = []
                        for slot in range((at - last) // wide, (at - first) // wide + 1):
                            lo, hi = at - slot * wide - wide + 1, at - slot * wide
                            meet = xxhash.xxh64_intdigest(b" ".join(ws[hi : lo + length]), slot)
                            pieces.append((max(first, lo), min(last, hi), meet - (1 << 63)))
                    for x, y, meet in pieces:
                        stretch = b" ".join(ws[x : y + length])
                        owners = held.get((meet, stretch))
                        if owners is None:
                            owners = held[meet, stretch] = []
                            size += len(stretch) + 200
                        if owners and owners[-3] == keys[text] and owners[-1] == x - 1:
                            owners[-1] = x  # the same stretch one word further on
                        else:
                            owners += ids[text], keys[text], x, x
                            size += 32
                if size >= HELD_BYTES:
                    yield _stretch_rows(held, parts)
                    held, size = {}, 0
        if held:
            yield _stretch_rows(held, parts)

    sent = some.mapInArrow(stretches, "part bigint, core bigint, stretch binary, owners array<bigint>")

    def streamed(table: pa.Table) -> pa.Table:
        shards: dict[int, dict[bytes, list[int]]] = {}
        for core_hash, stretch, owners in zip(*(table.column(c).to_pylist() for c in ("core", "stretch", "owners")), strict=True):
            shard = shards.setdefault(core_hash, {})
            if stretch in shard:
                shard[stretch] += owners
            else:
                shard[stretch] = owners
        keys, starts, stops = [], [], []
        for shard in shards.values():
            reference = SuffixAutomaton()
            lists = [s.split(b" ") for s in shard]
            for ws, owners in zip(lists, shard.values(), strict=True):
                reference.add(ws, min(owners[::4]))
            reference.finish()
            for ws, owners in zip(lists, shard.values(), strict=True):
                least = reference.matches(ws, length)
                highest = max(least)
                for k in range(0, len(owners), 4):
                    i, key, at, last = owners[k : k + 4]
                    runs = [(0, len(least) - 1)] if highest < i else _runs([m < i for m in least])
                    for x, y in runs:
                        keys.append(key)
                        starts.append(at + x)
                        stops.append(last + y + length)
        return pa.table([pa.array(x, pa.int64()) for x in (keys, starts, stops)], [key_col, "start", "stop"])

    return sent.groupBy("part").applyInArrow(streamed, f"`{key_col}` bigint, start bigint, stop bigint")


def _stretch_rows(held: dict[tuple, list[int]], parts: int) -> pa.RecordBatch:
    cols = [
        pa.array([h % parts for h, _ in held], pa.int64()),
        pa.array([h for h, _ in held], pa.int64()),
        pa.array([s for _, s in held], pa.binary()),
        pa.array(list(held.values()), pa.list_(pa.int64())),
    ]
    return pa.RecordBatch.from_arrays(cols, ["part", "core", "stretch", "owners"])


def kept_words(ws: list[bytes], spans: list[tuple[int, int]]) -> list[bytes]:
    out, at = [], 0
    for a, b in sorted(spans):
        if a > at:
            out += ws[at:a]
        at = max(at, b)
    return out + ws[at:]


def _cut(joined: DataFrame, id_col: str, text_col: str, digests: bool) -> DataFrame:
    """Rows (id, text, __spans) to id, n_words, n_removed and the kept words."""
    last = "kept_sha256" if digests else "kept"
    names = [id_col, "n_words", "n_removed", last]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data: list[list] = [[], [], []]
            for text, spans in zip(batch.column(text_col).to_pylist(), batch.column("__spans").to_pylist(), strict=True):
                ws = words(text)
                kept = kept_words(ws, [(s["start"], s["stop"]) for s in spans or ()])
                line = b" ".join(kept)
                whole = text if len(kept) == len(ws) else line.decode()
                for x, v in zip(data, (len(ws), len(ws) - len(kept), hashlib.sha256(line).hexdigest() if digests else whole), strict=True):
                    x.append(v)
            cols = [pa.array(x, t) for x, t in zip(data, (pa.int64(), pa.int64(), pa.string()), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(id_col), *cols], names)

    kind = joined.schema[id_col].dataType.simpleString()
    return joined.select(id_col, text_col, "__spans").mapInArrow(run, f"`{id_col}` {kind}, n_words bigint, n_removed bigint, {last} string")


def deduplicate(df: DataFrame, length: int = 50, core: int = 16, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """id, n_words, n_removed and each row's text without repeated passages (`kept`, or the hash of its words `kept_sha256`).

    A word goes if a window of `length` words that covers it also starts in a row with a smaller
    id; all are judged on the input. A text that loses nothing is kept as it is, else its kept words
    are joined by single spaces. Null texts have no word; rows shorter than `length` are
    whole. Ids are integers; rows with equal ids do not remove from each other, rows with a null
    id neither remove nor lose; an empty table gives none; other columns are ignored.
    """
    return _cut(_with_spans(df.select(id_col, text_col), length, core, id_col, text_col), id_col, text_col, digests)


def _with_spans(df: DataFrame, length: int, core: int, id_col: str, text_col: str) -> DataFrame:
    """`df` with the column `__spans`, null where nothing goes."""
    key = F.xxhash64(id_col, text_col)
    rows = df.select(F.col(id_col).alias("id"), key.alias("key"), F.col(text_col).alias("text"))
    lists = cut_lineage(earlier_spans(rows, length, core)).groupBy("key").agg(F.collect_list(F.struct("start", "stop")).alias("__spans"))
    return df.withColumn("__key", key).join(lists.withColumnRenamed("key", "__key"), "__key", "left").drop("__key")


def without_passages(df: DataFrame, length: int = 50, core: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows and columns of `df`, the text without the words that `deduplicate` removes."""
    fields = df.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text_col).to_pylist()
            for i, spans in enumerate(batch.column("__spans").to_pylist()):
                if spans:
                    texts[i] = b" ".join(kept_words(words(texts[i]), [(s["start"], s["stop"]) for s in spans])).decode()
            cols = {c: batch.column(c) for c in fields.names} | {text_col: pa.array(texts, pa.string())}
            yield pa.RecordBatch.from_arrays(list(cols.values()), list(cols))

    return _with_spans(df, length, core, id_col, text_col).mapInArrow(run, fields)


def against(df: DataFrame, reference: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text", most_words: int = 2_000_000, shard_words: int = 100_000) -> DataFrame:
    """Like `deduplicate`, but words go if a window over them occurs in `reference` (column `text_col`).

    The reference's words are counted first; more than `most_words` raise ValueError, as they would
    not fit a broadcast. A null or empty reference text holds nothing.
    """
    ref = reference.select(F.col(text_col).alias("text")).filter("text IS NOT NULL")
    count = ref.select(F.sum(F.size(F.split("text", "[\\x20\\x09-\\x0D]+")))).first()[0] or 0
    if count > most_words:
        raise ValueError(f"the reference has {count} words; at most {most_words} can be broadcast")
    shards, room = [], 0
    for row in ref.collect():
        ws = words(row["text"])
        if not shards or room < len(ws):
            shards.append([])
            room = shard_words
        shards[-1].append(ws)
        room -= len(ws)
    sent = df.sparkSession.sparkContext.broadcast(shards)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata = []
        for shard in sent.value:
            automata.append(SuffixAutomaton())
            for ws in shard:
                automata[-1].add(ws, 0)
            automata[-1].finish()
        for batch in batches:
            spans = []
            for text in batch.column(text_col).to_pylist():
                ws = words(text)
                runs = [r for a in automata for r in _runs([m is not None for m in a.matches(ws, length)])]
                spans.append([{"start": x, "stop": y + length} for x, y in runs])
            kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(id_col), batch.column(text_col), pa.array(spans, kind)], [id_col, text_col, "__spans"])

    kind = df.schema[id_col].dataType.simpleString()
    found = df.select(id_col, text_col).mapInArrow(stream, f"`{id_col}` {kind}, `{text_col}` string, __spans array<struct<start:bigint,stop:bigint>>")
    return _cut(found, id_col, text_col, digests=False)
