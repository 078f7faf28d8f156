"""Vector bin packing of token sequences by the dot-product heuristic.

Every item is a vector (tokens, segments, loss-bearing tokens) and every bin has a limit for
each. The open bin takes, of the items that fit, the one whose vector has the largest dot
product with what is left in the bin, both in units of the limits. Where nothing fits, an item
is cut so that the bin ends full, if cuts are allowed.

Packing is local: each task packs its own rows in chunks, carries the last open bin into the
next chunk and gives what is left at its end to a second round, where a few tasks' remains
meet. Only these remains are shuffled, less than one bin for each task.
"""

from __future__ import annotations

import os
import re
import unicodedata
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache, partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnwise.llm.common import WordTable, ranges, text_chunks
from turnwise.session import cut_lineage


@dataclass(frozen=True)
class Limits:
    tokens: int = 4096
    segments: int = 64
    loss_tokens: int = 4096


def fill_bins(sizes: np.ndarray, limits: Limits, cut: bool = True) -> tuple[list[list[tuple[int, int, int]]], list[tuple[int, int, int]]]:
    """Pack vectors (tokens, loss tokens); one segment each.

    Returns full bins as lists of (item, start, length), and the pieces of the last open bin.
    Loss-bearing tokens count as the last ones of an item. Without `cut` the items must be
    within the limits.
    """
    caps = np.array([limits.tokens, limits.segments, limits.loss_tokens], float)
    n = len(sizes)
    start = np.zeros(n, np.int64)
    left = sizes.astype(np.int64).copy()
    bins: list[list[tuple[int, int, int]]] = []
    if cut:
        most = min(limits.tokens, limits.loss_tokens)
        for i in np.flatnonzero(left[:, 0] >= most).tolist():
            while left[i, 0] >= most:
                bins.append([(i, int(start[i]), most)])
                start[i] += most
                left[i, 0] -= most
                left[i, 1] = min(left[i, 1], left[i, 0])
    vec = np.stack([left[:, 0], np.ones(n), left[:, 1]], 1) / caps
    todo = np.flatnonzero(left[:, 0] > 0)
    v, alive = vec[todo], np.ones(len(todo), bool)
    count = len(todo)
    room, now = np.ones(3), []
    tiny = 1e-12
    while count:
        fits = alive & (v <= room + tiny).all(1)
        dots = np.where(fits, v @ room, -1.0)
        k = int(dots.argmax())
        if dots[k] >= 0:
            i = int(todo[k])
            now.append((i, int(start[i]), int(left[i, 0])))
            room = room - v[k]
            alive[k] = False
            count -= 1
            if count < len(todo) // 2:
                todo, v, alive = todo[alive], v[alive], np.ones(count, bool)
            continue
        take = int(round(room[0] * caps[0]))
        loss_room = int(round(room[2] * caps[2]))
        if cut and room[1] * caps[1] > 0.5 and take:
            k = int(np.where(alive, v @ room, -1.0).argmax())
            i = int(todo[k])
            plain = int(left[i, 0] - left[i, 1])
            length = min(take, int(left[i, 0]), plain + loss_room)
            if length:
                now.append((i, int(start[i]), length))
                start[i] += length
                left[i] = left[i, 0] - length, min(left[i, 1], left[i, 0] - length)
                v[k] = left[i, 0] / caps[0], 1 / caps[1], left[i, 1] / caps[2]
                if not left[i, 0]:
                    alive[k] = False
                    count -= 1
        bins.append(now)
        room, now = np.ones(3), []
    if now and room[0] * caps[0] < 0.5:
        bins.append(now)
        now = []
    return bins, now


PIECE = [
    ("start", T.LongType()),
    ("length", T.LongType()),
    ("ids_crc32", T.LongType()),
    ("doc_tokens", T.LongType()),
    ("sequence_id", T.LongType()),
    ("offset", T.LongType()),
    ("ids", T.BinaryType()),
]


class _Packer:
    """Chunks of items to pieces; what is in the open bin is carried on."""

    def __init__(self, limits: Limits, first_id: int):
        self.limits, self.next = limits, first_id
        self.open: list[dict] = []

    def add(self, items: list[dict], keep_ids: bool) -> list[dict]:
        """Items have id, start, ids (numpy), loss, doc_tokens; returned are pieces in full sequences."""
        items = self.open + items
        sizes = np.array([[len(x["ids"]), x["loss"]] for x in items], np.int64).reshape(-1, 2)
        bins, rest = fill_bins(sizes, self.limits)
        out = [p for b in bins for p in self._sequence(items, b, keep_ids)]
        self.open = []
        for i, start, length in rest:
            x = items[i]
            self.open.append(x | {"start": x["start"] + start, "ids": x["ids"][start : start + length], "loss": min(x["loss"], length)})
        return out

    def _sequence(self, items: list[dict], pieces: list[tuple[int, int, int]], keep_ids: bool) -> list[dict]:
        out, offset = [], 0
        for i, start, length in pieces:
            x = items[i]
            raw = x["ids"][start : start + length].tobytes()
            out.append(
                {"id": x["id"], "start": x["start"] + start, "length": length, "ids_crc32": zlib.crc32(raw), "doc_tokens": x["doc_tokens"]}
                | {"sequence_id": self.next, "offset": offset, "ids": raw if keep_ids else None}
            )
            offset += length
        self.next += 1
        return out

    def finish(self, keep_ids: bool) -> list[dict]:
        """The open bin as sequences whose lengths are powers of two, which need no padding."""
        out = []
        pieces = [(i, 0, len(x["ids"])) for i, x in enumerate(self.open)]
        total = sum(p[2] for p in pieces)
        for size in (1 << b for b in range(total.bit_length() - 1, -1, -1)):
            if not total & size:
                continue
            now, room = [], size
            while room:
                i, start, length = pieces[0]
                take = min(room, length)
                now.append((i, start, take))
                pieces[0] = (i, start + take, length - take)
                room -= take
                if take == length:
                    pieces.pop(0)
            out += self._sequence(self.open, now, keep_ids)
        self.open = []
        return out


def pack(
    df: DataFrame,
    tokenize: Callable[[], Callable[[list], list[np.ndarray]]],
    limits: Limits = Limits(),
    id_col: str = "doc_id",
    text_col: str = "text",
    loss_col: str | None = None,
    keep_ids: bool = True,
    share: int = 64,
) -> DataFrame:
    """Pieces of the rows' tokens in sequences: id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids).

    `tokenize` is called once in each task and gives the function from texts to id arrays
    (never empty ones). `loss_col` counts the loss-bearing tokens at a row's end; without it all
    tokens bear loss. Each id lies in exactly one piece; a sequence holds `limits.tokens` at most,
    `limits.segments` pieces and `limits.loss_tokens`; all but the last ones of `share` tasks are
    full unless a limit other than tokens binds. Null texts are empty, repeated rows are packed
    each, an empty table gives no row; extra columns are ignored. The first round is written to
    the checkpoint folder so that nothing is tokenised twice.
    """
    kind = df.schema[id_col].dataType
    schema = T.StructType([T.StructField(id_col, kind), *(T.StructField(n, t) for n, t in PIECE), T.StructField("part", T.LongType())])
    arrow_names = [id_col, *(n for n, _ in PIECE), "part"]

    def frame(pieces: list[dict], part: int | None, id_type: pa.DataType) -> pa.RecordBatch:
        cols = [pa.array([p["id"] for p in pieces], id_type)]
        for name, t in PIECE:
            cols.append(pa.array([p[name] for p in pieces], pa.binary() if isinstance(t, T.BinaryType) else pa.int64()))
        cols.append(pa.array([part] * len(pieces), pa.int64()))
        return pa.RecordBatch.from_arrays(cols, arrow_names)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        packer, encode, id_type = _Packer(limits, part << 32), tokenize(), None
        for batch in batches:
            id_type = batch.schema.field(id_col).type
            for rows, texts in text_chunks(batch, text_col, 2 << 20):
                ids = encode(texts)
                loss = rows.column(loss_col).to_pylist() if loss_col else [None] * len(ids)
                items = [
                    {"id": d, "start": 0, "ids": x, "loss": len(x) if k is None else max(0, min(k, len(x))), "doc_tokens": len(x)}
                    for d, x, k in zip(rows.column(id_col).to_pylist(), ids, loss, strict=True)
                ]
                yield frame(packer.add(items, keep_ids), None, id_type)
        if packer.open:
            rest = [{"id": x["id"], "start": x["start"], "length": len(x["ids"]), "ids_crc32": x["loss"], "doc_tokens": x["doc_tokens"], "sequence_id": None, "offset": None, "ids": x["ids"].tobytes()} for x in packer.open]
            yield frame(rest, part // share, id_type)

    def second(rows: pd.DataFrame) -> pd.DataFrame:
        packer, out = _Packer(limits, ((1 << 30) + int(rows["part"].iloc[0])) << 32), []
        rows = rows.sort_values([id_col, "start"])
        for at in range(0, len(rows), 2000):
            items = [{"id": r[0], "start": r[1], "ids": np.frombuffer(r[2], "<u4"), "loss": r[3], "doc_tokens": r[4]} for r in rows.iloc[at : at + 2000][[id_col, "start", "ids", "ids_crc32", "doc_tokens"]].itertuples(index=False)]
            out += packer.add(items, keep_ids)
        out += packer.finish(keep_ids)
        return pd.DataFrame(out).rename(columns={"id": id_col}).assign(part=None)

    cols = list(dict.fromkeys([id_col, text_col] + ([loss_col] if loss_col else [])))
    done = cut_lineage(df.select(*cols).mapInArrow(first, schema))
    rest = done.filter("part IS NOT NULL").groupBy("part").applyInPandas(second, schema)
    both = done.filter("part IS NULL").unionByName(rest).drop("part")
    return both if keep_ids else both.drop("ids")


#: Pre-tokens of the tokenizer file as they fall in plain Latin words (no mark to compose, no
#: letter whose lower case depends on what follows).
_LOWER = "".join(c for c in map(chr, range(0x250)) if unicodedata.category(c)[0] == "L" and c.lower() == c)
_NUMBER = "".join(c for c in map(chr, range(0x250)) if unicodedata.category(c)[0] == "N")
_parts = re.compile(f"'(?:s|t|re|ve|m|ll|d)|[{_LOWER}]+|[{_NUMBER}]|[^{_LOWER}{_NUMBER}]+").findall
_plain = re.compile("[!-;=-~\u00a1-\u012f\u0131-\u024f]+").fullmatch


def _spaced(text: str | None) -> list[bytes]:
    """Words between ASCII white space; in lower case, but for texts that may spell a special token."""
    raw = (text or "").encode()
    return (raw if b"<|" in raw else raw.lower()).split()


def file_tokenizer(path: str, end_id: int, table_words: int = 600_000) -> Callable[[], Callable[[list], list[np.ndarray]]]:
    """Texts to ids by a tokenizer file whose pre-tokens never span white space, with `end_id` last.

    Each distinct word is encoded once for a worker process, many words in one call, told apart by
    the word-end mark of the pieces. Words beyond plain Latin are encoded singly. Tokenizer and
    table of words stay with the process, whatever tasks it gets; the table is emptied when
    it holds `table_words`.
    """
    return partial(_kept_tokenizer, path, end_id, table_words)


@lru_cache(maxsize=2)
def _kept_tokenizer(path: str, end_id: int, table_words: int) -> Callable[[list], list[np.ndarray]]:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    vocabulary = tokenizer.get_vocab(with_added_tokens=False)
    last = np.zeros(max(vocabulary.values()) + 1, np.int64)  # ids that end a pre-token
    last[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = 1

    def batch(texts: list[str]) -> list:
        return [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(new: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        text = [w.decode() for w in new]
        mask = np.array([bool(_plain(w)) for w in text])
        latin = [w for w, p in zip(text, mask, strict=True) if p]
        parts = np.array([1 if w.isalpha() else len(_parts(w.lower())) for w in latin], np.int64)
        groups = batch([" ".join(latin[i : i + 2000]) for i in range(0, len(latin), 2000)])
        flat = np.concatenate([np.zeros(0, np.int32), *(np.array(g, np.int32) for g in groups)])
        ends = np.flatnonzero(last[flat]) + 1
        if len(ends) != parts.sum():
            raise ValueError("pre-tokens of this tokenizer differ from the expected ones")
        others = batch([w for w, p in zip(text, mask, strict=True) if not p])
        counts, source = np.zeros(len(new), np.int64), np.zeros(len(new), np.int64)
        counts[mask] = np.diff(np.r_[0, ends[np.cumsum(parts) - 1]])
        counts[~mask] = [len(x) for x in others]
        order = np.r_[np.flatnonzero(mask), np.flatnonzero(~mask)]
        source[order] = np.cumsum(counts[order]) - counts[order]
        flat = np.concatenate([flat, np.array([i for x in others for i in x], np.int32)])
        return flat[ranges(source, counts)], counts

    table = WordTable(encode, table_words)

    def texts_to_ids(texts: list) -> list[np.ndarray]:
        flat, counts = table.ids([_spaced(t) for t in texts])
        parts = np.split(flat, np.cumsum(counts)[:-1])
        return [np.append(p, end_id).astype("<u4") for p in parts]

    return texts_to_ids
