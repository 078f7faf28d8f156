"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words: space and the control characters tab to carriage return.
SPACES = " \t\n\x0b\x0c\r"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def fold(id_col: str, parts: int = 5) -> Column:
    """Remainder of the crc32 of an id written as text; splits training from held-out rows."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(parts))


def words(text: str | None) -> list[bytes]:
    """Words `[^\\x20\\x09-\\x0D]+` of a text as UTF-8 (`bytes.split` parts at the same six bytes)."""
    return text.encode().split() if text else []


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of many runs, one after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - ends + lengths, lengths)


def text_chunks(batch: pa.RecordBatch, text_col: str, most_bytes: int = 4 << 20) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Slices of a batch of about `most_bytes` of text at most (one row at least), with their texts."""
    texts = batch.column(text_col).to_pylist()
    start = size = 0
    for i, text in enumerate(texts):
        length = len(text) if text else 0
        if size and size + length > most_bytes:
            yield batch.slice(start, i - start), texts[start:i]
            start, size = i, 0
        size += length
    if start < len(texts):
        yield batch.slice(start), texts[start:]


class WordTable:
    """Ids of words that were seen, flat; emptied when it holds too many.

    `encode` takes a list of new words and returns (flat ids, count per word).
    """

    def __init__(self, encode: Callable[[list], tuple[np.ndarray, np.ndarray]], most: int = 300_000):
        self.encode, self.most = encode, most
        self.clear()

    def clear(self) -> None:
        self.index: dict = {}
        self.flat = np.zeros(0, np.int32)
        self.starts = np.zeros(0, np.int64)
        self.counts = np.zeros(0, np.int64)

    def ids(self, texts: Iterable[list]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of several token lists, and the number of ids of each list."""
        texts = list(texts)
        if len(self.index) > self.most:
            self.clear()
        new = list(set(chain.from_iterable(texts)).difference(self.index))
        if new:
            flat, counts = self.encode(new)
            at = len(self.counts)
            self.index.update(zip(new, range(at, at + len(new)), strict=True))
            self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(counts) - counts])
            self.counts = np.concatenate([self.counts, counts])
            self.flat = np.concatenate([self.flat, flat])
        where = np.fromiter(map(self.index.__getitem__, chain.from_iterable(texts)), np.int64, sum(map(len, texts)))
        lengths = self.counts[where]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        stops = np.cumsum([len(t) for t in texts]) if texts else np.zeros(0, np.int64)
        bounds = ends[np.concatenate([[0], stops]).astype(np.int64)]
        return self.flat[ranges(self.starts[where], lengths)], np.diff(bounds)
