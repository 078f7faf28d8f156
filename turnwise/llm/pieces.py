"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

A text becomes words (a run of word marks and what follows, or one character that no longer
piece contains); no piece spans two words, so words are encoded apart and each distinct word
once per task. All new words of a chunk are merged together: flat symbol arrays, the best pair
rank per word by a segmented minimum, the leftmost best pair of every word merged at once, and
words without a pair taken out, until no pair is left. One merge per word and round is the
order the library follows, so ids agree with it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from turnwise.llm.common import WordTable, ranges, text_chunks

MARK = "▁"
NO_RANK = np.int64(1 << 40)


class PieceModel:
    """Tables of a BPE model file with identity normalisation and byte fallback."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        with open(path, "rb") as f:
            proto = pb.ModelProto.FromString(f.read())
        norm, train = proto.normalizer_spec, proto.trainer_spec
        plain = not norm.precompiled_charsmap and not norm.remove_extra_whitespaces and norm.escape_whitespaces
        if train.model_type != train.BPE or not train.byte_fallback or not plain or train.treat_whitespace_as_suffix:
            raise ValueError("a BPE model with byte fallback and identity normalisation is needed")
        kinds = pb.ModelProto.SentencePiece
        if any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in proto.pieces):
            raise ValueError("user-defined and unused pieces are not supported")
        self.prefix = norm.add_dummy_prefix
        self.bos, self.eos, self.unk = train.bos_id, train.eos_id, train.unk_id
        normal = [(i, p.piece, p.score) for i, p in enumerate(proto.pieces) if p.type == kinds.NORMAL]
        if any(MARK in s.lstrip(MARK) for _, s, _ in normal):
            raise ValueError("a piece with an inner word mark")
        self.bytes_at = np.zeros(256, np.int32)
        self.surface = [b""] * len(proto.pieces)
        for i, p in enumerate(proto.pieces):
            if p.type == kinds.BYTE:
                value = int(p.piece[3:5], 16)
                self.bytes_at[value], self.surface[i] = i, bytes([value])
            elif p.type == kinds.NORMAL:
                self.surface[i] = p.piece.replace(MARK, " ").encode()
            elif p.type == kinds.UNKNOWN:
                self.surface[i] = train.unk_surface.encode()
        self.marked = np.array([p.type == kinds.NORMAL and p.piece.startswith(MARK) for p in proto.pieces])
        self.control = np.array([p.type == kinds.CONTROL for p in proto.pieces])
        self.surface_flat = np.frombuffer(b"".join(self.surface), np.uint8)
        self.surface_len = np.array([len(s) for s in self.surface], np.int64)
        self.surface_at = np.cumsum(self.surface_len) - self.surface_len

        # symbols: the pieces, then characters that only longer pieces hold
        symbol = {s: k for k, (_, s, _) in enumerate(normal)}
        self.piece_of = [i for i, _, _ in normal]
        long = [s for _, s, _ in normal if len(s) > 1]
        for c in sorted({c for s in long for c in s} - symbol.keys()):
            symbol[c] = len(symbol)
            self.piece_of.append(-1)
        self.n = len(symbol)
        self.piece_of = np.array(self.piece_of, np.int32)
        self.char = np.full(0x110000, -1, np.int32)
        self.code = np.zeros(self.n, np.int64)
        for s, k in symbol.items():
            if len(s) == 1:
                self.char[ord(s)], self.code[k] = k, ord(s)
        order = {score: r for r, score in enumerate(sorted({sc for _, _, sc in normal}, reverse=True))}
        pairs = {}
        for _, s, score in normal:
            for cut in range(1, len(s)):
                a, b = symbol.get(s[:cut]), symbol.get(s[cut:])
                if a is not None and b is not None:
                    pairs[a * self.n + b] = (order[score], symbol[s])
        keys = np.array(sorted(pairs), np.int64)
        self.pair_keys = keys
        self.pair_rank = np.array([pairs[k][0] for k in keys.tolist()], np.int64)
        self.pair_out = np.array([pairs[k][1] for k in keys.tolist()], np.int32)
        inner = "".join(re.escape(c) for c in sorted({c for s in long for c in s} - {MARK}))
        self.split = re.compile(f"{MARK}+[{inner}]*|[{inner}]+|.", re.DOTALL).findall
        self.table = WordTable(self._merge)

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        known = (left < self.n) & (right < self.n)
        key = np.where(known, left.astype(np.int64) * self.n + right, -1)
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        hit = self.pair_keys[at] == key
        return np.where(hit, self.pair_rank[at], NO_RANK), self.pair_out[at]

    def _merge(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        code = np.frombuffer("".join(new).encode("utf-32-le"), np.uint32).astype(np.int64)
        sym = self.char[code].astype(np.int64)
        sym = np.where(sym < 0, self.n + code, sym)
        word = np.repeat(np.arange(len(new)), [len(w) for w in new])
        rank, out = np.full(len(sym), NO_RANK), np.zeros(len(sym), np.int64)

        def look(at: np.ndarray) -> None:
            rank[at] = NO_RANK
            at = at[at + 1 < len(sym)]
            at = at[word[at] == word[at + 1]]
            rank[at], out[at] = self._pairs(sym[at], sym[at + 1])

        look(np.arange(len(sym)))
        done_sym, done_word = [], []
        while len(sym):
            heads = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            sizes = np.diff(np.r_[heads, len(sym)])
            best = np.minimum.reduceat(rank, heads)
            live = np.repeat(best < NO_RANK, sizes)
            if not live.all():  # compaction
                done_sym.append(sym[~live])
                done_word.append(word[~live])
                sym, word, rank, out = sym[live], word[live], rank[live], out[live]
                sizes, best = sizes[best < NO_RANK], best[best < NO_RANK]
            if not len(sym):
                break
            hit = np.flatnonzero(rank == np.repeat(best, sizes))
            hit = hit[np.r_[True, word[hit[1:]] != word[hit[:-1]]]]
            sym[hit] = out[hit]
            keep = np.ones(len(sym), bool)
            keep[hit + 1] = False
            hit = hit - np.arange(len(hit))
            sym, word, rank, out = sym[keep], word[keep], rank[keep], out[keep]
            look(hit)
            before = hit[hit > 0] - 1
            look(before)
        sym, word = np.concatenate(done_sym), np.concatenate(done_word)
        order = np.argsort(word, kind="stable")
        sym, word = sym[order], word[order]
        # pieces, or the bytes of a character without one
        plain = sym < self.n
        ids = np.full(len(sym), -1, np.int32)
        ids[plain] = self.piece_of[sym[plain]]
        width = np.ones(len(sym), np.int64)
        bare = np.flatnonzero(ids < 0)
        spelled = [chr(self.code[s] if s < self.n else s - self.n).encode() for s in sym[bare].tolist()]
        width[bare] = [len(b) for b in spelled]
        flat = np.repeat(ids, width)
        first = (np.cumsum(width) - width)[bare]
        flat[ranges(first, width[bare])] = self.bytes_at[np.frombuffer(b"".join(spelled), np.uint8)]
        return flat, np.bincount(word, weights=width, minlength=len(new)).astype(np.int64)

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text with the begin and end ids."""
        marked = [(MARK if self.prefix else "") + t.replace(" ", MARK) if t else "" for t in texts]
        flat, counts = self.table.ids([self.split(t) for t in marked])
        parts = np.split(flat, np.cumsum(counts)[:-1])
        return [np.concatenate([[self.bos], p, [self.eos]]).astype("<u4") for p in parts]

    def decode(self, ids: np.ndarray) -> str:
        ids = ids[~self.control[ids]]
        if not len(ids):
            return ""
        raw = self.surface_flat[ranges(self.surface_at[ids], self.surface_len[ids])].tobytes()
        if self.prefix and self.marked[ids[0]]:
            raw = raw[1:]
        return raw.decode("utf-8", "replace")


ENCODED = T.StructType(
    [
        T.StructField("n_tokens", T.LongType()),
        T.StructField("ids", T.ArrayType(T.LongType())),
        T.StructField("decoded", T.StringType()),
    ]
)
DIGESTS = T.StructType(
    [
        T.StructField("n_tokens", T.LongType()),
        T.StructField("ids_sha256", T.StringType()),
        T.StructField("decoded_sha256", T.StringType()),
    ]
)


def encode(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """One row per row of `df`: its id, `n_tokens`, and `ids` with the text decoded from them.

    With `digests`, `ids_sha256` (of little-endian 32-bit ids) and `decoded_sha256` instead, so
    that nothing large leaves the task. A null or empty text has the begin and end ids only and
    decodes to an empty text. Repeated rows give repeated rows, an empty table gives none, other
    columns are ignored. There is no shuffle: each task reads the model file named by
    `model_path` and keeps a bounded table of words. Lost tasks start anew.
    """
    rest = DIGESTS if digests else ENCODED
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), *rest])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = PieceModel(model_path)
        for batch in batches:
            for rows, texts in text_chunks(batch, text_col):
                ids = model.encode(texts)
                back = [model.decode(i) for i in ids]
                data = {"n_tokens": pa.array([len(i) for i in ids], pa.int64())}
                if digests:
                    data["ids_sha256"] = pa.array([hashlib.sha256(i.tobytes()).hexdigest() for i in ids])
                    data["decoded_sha256"] = pa.array([hashlib.sha256(s.encode()).hexdigest() for s in back])
                else:
                    data["ids"] = pa.array([i.astype(np.int64) for i in ids], pa.list_(pa.int64()))
                    data["decoded"] = pa.array(back, pa.string())
                yield pa.RecordBatch.from_arrays([rows.column(id_col), *data.values()], [id_col, *data])

    return df.select(id_col, text_col).mapInArrow(run, schema)
