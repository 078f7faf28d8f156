"""Alignment of two tokenizers over the same bytes, with an identity map for equal tokens.

A text is encoded by a byte-level BPE file (A, with a space before the text) and by a
SentencePiece BPE model (B, which adds that space itself). Where tokens of both end at the same
byte, a group ends. Two tokens are linked where their bytes overlap; between two neighbouring ends of
either side lies exactly one link.

Most groups are one token of A and the token of B with the same bytes. For these a map from A's
ids to B's is made once, and their documents are counted in a vector as long as A's vocabulary. Only
the pairs of other groups are shuffled: blocks of documents ask once for each distinct pair of
theirs, and get its count back.
"""

from __future__ import annotations

import hashlib
import json
import os
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnwise.llm.common import ranges, text_chunks
from turnwise.llm.pieces import MARK, PieceModel
from turnwise.session import cut_lineage, ensure_checkpoint_dir

#: Ids that a table of words holds before it is emptied.
TABLE_IDS = 4 << 20
#: Tokens whose bytes are put together at once.
AT_ONCE = 1 << 16
#: Bytes of text in a block of documents.
BLOCK_BYTES = 3 << 19

#: Pre-tokens of byte-level BPE files.
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Longer runs without white space are encoded by the tokenizer file's own library.
LONG_RUN = 2000


class Side:
    """Token bytes of a vocabulary, flat."""

    def __init__(self, tokens: list[bytes]):
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)
        self.length = np.array([len(t) for t in tokens], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.size = len(tokens)
        self.text = np.array([f"{i}{end}" for end in (",", "|", ";") for i in range(self.size)], object)

    def joined(self, ids: np.ndarray) -> bytes:
        pieces = (ids[i : i + AT_ONCE] for i in range(0, len(ids), AT_ONCE))
        return b"".join(self.flat[ranges(self.start[p], self.length[p])].tobytes() for p in pieces)


class ByteModel:
    """A byte-level BPE file. Where its merges are in the order of its ids, ids are ranks and
    texts are encoded by rank, with the same result as the file's library."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        # the printable bytes stand for themselves, the others for the characters from 256 on
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        byte_of = {chr(b): b for b in shown}
        byte_of |= {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(shown))}
        spelled = {t: bytes(byte_of[c] for c in t) for t in vocabulary if all(c in byte_of for c in t)}
        self.tokens = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.tokens[i] = spelled.get(token, token.encode())
        with open(path, encoding="utf-8") as f:
            content = json.load(f)
        merges = [m.split(" ") if isinstance(m, str) else m for m in content["model"]["merges"]]
        pre, norm = content["pre_tokenizer"], content["normalizer"]
        plain = norm is None and pre["type"] == "ByteLevel" and not pre["add_prefix_space"] and pre.get("use_regex", True)
        self.by_rank = None
        if plain and all(vocabulary.get(a + b) == 256 + k for k, (a, b) in enumerate(merges)):
            import tiktoken

            ranks = {self.tokens[i]: i for i in range(256 + len(merges))}
            self.by_rank = tiktoken.Encoding("ranks", pat_str=PRE_TOKENS, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        if self.by_rank is None or (len(text) > LONG_RUN and max(map(len, text.split()), default=0) > LONG_RUN):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.int32)
        return np.array(self.by_rank.encode_ordinary(text), np.int32)


class Aligner:
    """Both tokenizers, and `same`: for each id of A the id of B with the same bytes (-1: none)."""

    def __init__(self, byte_path: str, piece_path: str):
        self.bytes = ByteModel(byte_path)
        self.a = Side(self.bytes.tokens)
        self.model = PieceModel(piece_path)
        if not self.model.prefix:
            raise ValueError("a piece model that adds a space is needed")
        surface = self.model.surface
        self.b = Side(surface)
        by_bytes: dict[bytes, int] = {}
        for i, s in enumerate(surface):
            if s and i != self.model.unk and (s not in by_bytes or len(s) > 1):
                by_bytes[s] = i
        # of two ids with the same single byte the piece comes before the spelled byte
        spelled = set(self.model.bytes_at.tolist())
        by_bytes |= {s: i for i, s in enumerate(surface) if len(s) == 1 and i not in spelled and i != self.model.unk}
        ends = np.r_[self.a.start, len(self.a.flat)].tolist()
        raw = self.a.flat.tobytes()
        self.same = np.array([by_bytes.get(raw[x:y], -1) for x, y in zip(ends, ends[1:], strict=False)], np.int64)

    def chunk(self, texts: list[str | None]) -> Aligned:
        raw = [(" " + t).encode() if t else b"" for t in texts]
        parts = [self.bytes.encode(" " + t) if t else np.zeros(0, np.int32) for t in texts]
        ids_a, n_a = np.concatenate(parts), np.array([len(x) for x in parts], np.int64)
        if len(self.model.table.flat) > TABLE_IDS:
            self.model.table.clear()
        ids_b, n_b = self.model.table.ids([self.model.split(MARK + t.replace(" ", MARK)) if t else [] for t in texts])
        whole = b"".join(raw)
        sides = []
        for side, ids, counts in ((self.a, ids_a, n_a), (self.b, ids_b, n_b)):
            joined = side.joined(ids)
            fits = np.ones(len(texts), bool)
            if joined != whole:
                size = np.bincount(np.repeat(np.arange(len(texts)), counts), side.length[ids], len(texts)).astype(np.int64)
                at = np.cumsum(size) - size
                fits = np.array([joined[x : x + n] == r for x, n, r in zip(at.tolist(), size.tolist(), raw, strict=True)], bool)
            sides.append(fits)
        fits = sides[0] & sides[1]
        if not fits.all():
            ids_a, ids_b = ids_a[np.repeat(fits, n_a)], ids_b[np.repeat(fits, n_b)]
            n_a, n_b = n_a * fits, n_b * fits
        return Aligned(self, ids_a, n_a, ids_b, n_b, np.array([len(r) for r in raw], np.int64) * fits)


class Aligned:
    """Links and groups of a chunk of texts."""

    def __init__(self, by: Aligner, ids_a: np.ndarray, n_a: np.ndarray, ids_b: np.ndarray, n_b: np.ndarray, n_bytes: np.ndarray):
        self.by, self.ids_a, self.n_a, self.ids_b, self.n_b = by, ids_a, n_a, ids_b, n_b
        end_a, end_b = np.cumsum(by.a.length[ids_a]), np.cumsum(by.b.length[ids_b])
        mark = np.zeros(int(n_bytes.sum()) + 1, np.uint8)
        mark[end_a] = 1
        mark[end_b] += 2
        self.last_a, self.last_b = mark[end_a] == 3, mark[end_b] == 3
        link = np.flatnonzero(mark)
        kind = mark[link]
        in_a, in_b = kind & 1, kind >> 1
        stops = np.r_[0, np.searchsorted(link, np.cumsum(n_bytes), "right")]
        self.n_links = np.diff(stops)
        self.n_groups = np.diff(np.r_[0, np.cumsum(kind == 3)][stops])
        self.a = ids_a[np.cumsum(in_a) - in_a].astype(np.int64)
        self.b = ids_b[np.cumsum(in_b) - in_b].astype(np.int64)
        self.text = np.repeat(np.arange(len(n_a)), self.n_links)

    def pairs(self) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Distinct links of each text as (text, what, how many): A's ids of identical pairs, then codes of the others."""
        plain = self.by.same[self.a] == self.b
        code = self.a * self.by.b.size + self.b
        out = []
        for which, what in ((plain, self.a), (~plain, code)):
            key, n = np.unique(self.text[which] << 32 | what[which], return_counts=True)
            out.append((key >> 32, key & 0xFFFFFFFF, n))
        return out[0], out[1]

    def groups(self) -> list[str]:
        """`a1,a2|b1;a3|b2,b3` for each text: ids of both sides, group by group."""
        group_a, group_b = (np.cumsum(x) - x for x in (self.last_a, self.last_b))
        n = int(self.last_a.sum())
        to_a, to_b = (np.cumsum(np.bincount(g, minlength=n)) for g in (group_a, group_b))
        words = np.empty(len(group_a) + len(group_b), object)
        words[np.arange(len(group_a)) + np.r_[0, to_b][group_a]] = self.by.a.text[self.ids_a + self.last_a * self.by.a.size]
        words[np.arange(len(group_b)) + to_a[group_b]] = self.by.b.text[self.ids_b + self.last_b * 2 * self.by.b.size]
        stops = np.r_[0, np.cumsum(self.n_a + self.n_b)].tolist()
        return ["".join(words[x:y].tolist())[:-1] for x, y in zip(stops, stops[1:], strict=False)]


@lru_cache(maxsize=2)
def aligner(byte_path: str, piece_path: str) -> Aligner:
    """One for each worker process and pair of files."""
    return Aligner(byte_path, piece_path)


COUNTS = ["n_a", "n_b", "n_groups", "n_links"]


def _lists(text: np.ndarray, values: np.ndarray, n: int, kind: pa.DataType) -> pa.ListArray:
    offsets = np.searchsorted(text, np.arange(n + 1))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def aligned(df: DataFrame, byte_path: str, piece_path: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """One row per row of `df`: id, n_a, n_b, n_groups, n_links, `groups` (with `digests` its sha256), the
    distinct links (`same`, `same_links`: ids of A linked to the equal token; `pairs`,
    `pair_links`: codes of the others, and how often each) and the `block` of rows it belongs to.

    A null or empty text, and one that the tokens of either side do not spell (a literal word mark
    U+2581 reads as a space), has no tokens: zeros and empty groups, undigested.
    """
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType)])
    rest = "n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups string, same array<int>, same_links array<int>, "
    for field in T._parse_datatype_string(rest + "pairs array<bigint>, pair_links array<int>, block bigint"):
        schema = schema.add(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by, block = aligner(byte_path, piece_path), TaskContext.get().partitionId() << 32
        for batch in batches:
            for rows, texts in text_chunks(batch, text_col, BLOCK_BYTES):
                got, n = by.chunk(texts), len(texts)
                groups = got.groups()
                if digests:
                    groups = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in groups]
                cols = [rows.column(id_col), *(pa.array(getattr(got, c), pa.int64()) for c in COUNTS), pa.array(groups, pa.string())]
                for (text, what, links), kind in zip(got.pairs(), (pa.int32(), pa.int64()), strict=True):
                    cols += [_lists(text, what, n, kind), _lists(text, links, n, pa.int32())]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(np.full(n, block))], schema.names)
                block += 1

    return df.select(id_col, text_col).mapInArrow(run, schema)


def _flat(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False)


def same_counts(rows: DataFrame, size: int) -> np.ndarray:
    """How many rows hold each id of A linked to its equal token; the result is as long as A's vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(_flat(batch.column("same")), minlength=size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["a", "n"])

    sums = rows.select("same").mapInArrow(run, "a bigint, n bigint").groupBy("a").agg(F.sum("n").alias("n"))
    return _vector(sums, size)


def _vector(by_id: DataFrame, size: int) -> np.ndarray:
    """(a, n) as a vector; at most as many rows as A has ids."""
    out = np.zeros(size, np.int64)
    for a, n in by_id.collect():
        out[a] = n
    return out


def asked(rows: DataFrame) -> DataFrame:
    """(block, pair, n): distinct pairs of each block and how many of its rows hold them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block = batch.column("block").to_numpy()
            edges = np.flatnonzero(np.r_[True, block[1:] != block[:-1], True]) if len(block) else np.zeros(1, int)
            for x, y in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                pair, n = np.unique(_flat(batch.column("pairs").slice(x, y - x)), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pair), block[x])), pa.array(pair, pa.int64()), pa.array(n, pa.int64())], ["block", "pair", "n"])

    return rows.select("block", "pairs").mapInArrow(run, "block bigint, pair bigint, n bigint")


def align(df: DataFrame, byte_path: str, piece_path: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """id, n_a, n_b, n_groups, n_links, n_best, count_sum and `groups` (or `groups_sha256`), one row per row of `df`.

    The count of a pair of ids is the number of rows of `df` in which they are linked.
    `count_sum` adds the counts of a row's links, `n_best` is how many of them have the highest
    count of their id of A. See `aligned` for texts without tokens. Repeated rows count and
    come out each, an empty table gives none, other columns are ignored. Alignments are written
    once to the shared checkpoint folder; the driver gets vectors as long as A's vocabulary and
    no more. A frequent pair travels once for each block of rows that holds it.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/align-{uuid.uuid4()}"
    renamed = df.select(F.col(id_col).alias("__id"), F.col(text_col).alias("text"))
    aligned(renamed, byte_path, piece_path, "__id", "text", digests).write.parquet(f"{folder}/rows")
    rows = spark.read.parquet(f"{folder}/rows")
    asked(rows).write.parquet(f"{folder}/asked")
    questions = spark.read.parquet(f"{folder}/asked")
    by = aligner(byte_path, piece_path)
    size_a, size_b = by.a.size, by.b.size
    counts = cut_lineage(questions.groupBy("pair").agg(F.sum("n").alias("total")))
    same = same_counts(rows, size_a)
    of_a = F.expr(f"pair div {size_b}").alias("a")
    best = np.maximum(same, _vector(counts.groupBy(of_a).agg(F.max("total").alias("n")), size_a))
    carried = ["__id", *COUNTS, "groups"]

    def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, links = _flat(batch.column("same")), _flat(batch.column("same_links"))
            ends = np.cumsum(batch.column("same").value_lengths().to_numpy(zero_copy_only=False))
            sums = [np.diff(np.r_[0, np.r_[0, np.cumsum(x)][ends]]) for x in (links * (same[ids] == best[ids]), links * same[ids])]
            names = [*carried, "block", "pairs", "pair_links"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *(pa.array(x, pa.int64()) for x in sums)], [*names, "n_best", "count_sum"])

    def finished(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.combine_chunks()
        if not left.num_rows:
            return left.select([*carried, "n_best", "count_sum"])
        pair, total = right.column("pair").to_numpy(), right.column("total").to_numpy()
        order = np.argsort(pair, kind="stable")
        pair, total = pair[order], total[order]
        column = left.column("pairs").combine_chunks()
        mine, links = _flat(column), _flat(left.column("pair_links").combine_chunks())
        n = total[np.searchsorted(pair, mine)] if len(mine) else np.zeros(0, np.int64)
        ends = np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))
        out = left.select(carried)
        for name, x in (("n_best", links * (n == best[mine // size_b])), ("count_sum", links * n)):
            more = np.diff(np.r_[0, np.r_[0, np.cumsum(x)][ends]])
            out = out.append_column(name, pa.array(left.column(name).to_numpy() + more, pa.int64()))
        return out

    kind = df.schema[id_col].dataType.simpleString()
    head = f"__id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups string, "
    left = rows.mapInArrow(plain, head + "block bigint, pairs array<bigint>, pair_links array<int>, n_best bigint, count_sum bigint")
    replies = questions.select("block", "pair").join(counts, "pair")
    done = left.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(finished, head + "n_best bigint, count_sum bigint")
    groups = F.col("groups").alias("groups_sha256" if digests else "groups")
    return done.select(F.col("__id").alias(id_col), *COUNTS, "n_best", "count_sum", groups)


def pair_counts(df: DataFrame, byte_path: str, piece_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(a, b, n_docs): in how many rows of `df` an id of A is linked to an id of B."""
    rows = cut_lineage(aligned(df, byte_path, piece_path, id_col, text_col).select("same", "pairs", "block"))
    by = aligner(byte_path, piece_path)
    totals = same_counts(rows, by.a.size)
    at = np.flatnonzero(totals)
    plain = df.sparkSession.createDataFrame(
        [(int(a), int(by.same[a]), int(totals[a])) for a in at], "a bigint, b bigint, n_docs bigint"
    )
    rest = asked(rows).groupBy("pair").agg(F.sum("n").alias("n_docs"))
    size = F.lit(by.b.size)
    return plain.union(rest.select(F.expr(f"pair div {by.b.size}"), F.col("pair") % size, "n_docs"))
