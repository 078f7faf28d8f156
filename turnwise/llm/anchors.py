"""Anchors: positions chosen by content, so that equal windows of two texts hold the same one.

A window of `length` symbols is assigned the leftmost position in it whose run of `core` symbols
has the smallest hash. That depends on the window alone; neighbouring windows mostly share the
anchor, so about 2 in (length - core + 2) positions are anchors, and the windows of an anchor
are a stretch of starts. Windows can only be equal where their anchors' cores are, so cores seen
once need no further work.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STEP = np.uint64(0x9E3779B97F4A7C15)
#: Bits of the filter of repeated cores that is sent to the workers: 16 MiB at any size of the corpus.
FILTER_BITS = 1 << 27


class Anchors(NamedTuple):
    text: np.ndarray  # number of the text
    at: np.ndarray  # position of the core in the joined symbols
    first: np.ndarray  # first and last start of the windows of this anchor
    last: np.ndarray
    core: np.ndarray  # hash of the core, signed 64-bit


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def run_hashes(symbols: np.ndarray, length: int) -> np.ndarray:
    """Hash of the `length` symbols from each position on, put together from runs of powers of two."""
    total, done, power, size = None, 0, symbols, 1
    step = STEP
    rest = length
    while rest:
        if rest & 1:
            if total is None:
                total, done = power, size
            else:
                n = len(symbols) - done - size + 1
                total = total[:n] * step + power[done : done + n]
                done += size
        rest >>= 1
        if rest:
            n = len(symbols) - 2 * size + 1
            power = power[:n] * step + power[size : size + n]
            size *= 2
            with np.errstate(over="ignore"):
                step = step * step
    return mixed(total)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while 2 * size <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    if size < width:
        values = np.minimum(values[: size - width], values[width - size :])
    return values


def find(symbols: np.ndarray, sizes: np.ndarray, length: int, core: int) -> Anchors:
    """Anchors of all windows in texts that lie joined in `symbols` (hashes, unsigned 64-bit)."""
    ends = np.cumsum(sizes)
    long = np.flatnonzero(sizes >= length)
    if not len(long):
        return Anchors(*(np.zeros(0, np.int64) for _ in range(5)))
    hashes = run_hashes(symbols, core)
    order = (hashes & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(hashes), dtype=np.uint64)
    chosen = (sliding_min(order, length - core + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    count = sizes[long] - length + 1
    start = (ends - sizes)[long]
    begin = np.cumsum(count) - count
    starts = np.arange(int(count.sum())) + np.repeat(start - begin, count)
    at = chosen[starts]
    new = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    stop = np.r_[new[1:], len(at)] - 1
    at, first, last = at[new], starts[new], starts[stop]
    return Anchors(np.searchsorted(ends, first, side="right"), at, first, last, hashes[at].view(np.int64))


def bit_of(core: Column) -> Column:
    return F.pmod(core, F.lit(FILTER_BITS)) + 1


def repeated_filter(repeated: DataFrame, core_col: str, weight: Column, hot: Column) -> tuple[np.ndarray, np.ndarray, int]:
    """Bit maps of the cores in `repeated` and of the hot ones, and the sum of `weight`.

    Each core sets one bit. The maps have `FILTER_BITS` bits whatever the number of cores; what
    passes by chance only means work in vain.
    """
    bit = bit_of(F.col(core_col))
    rows = repeated.select(F.bitmap_bucket_number(bit).alias("bucket"), F.bitmap_bit_position(bit).alias("bit"), weight.alias("n"), hot.alias("hot"))
    maps = rows.groupBy("bucket").agg(
        F.bitmap_construct_agg("bit").alias("all"), F.bitmap_construct_agg(F.expr("CASE WHEN hot THEN bit END")).alias("hot"), F.sum("n").alias("n")
    )
    every, warm, total = np.zeros(FILTER_BITS // 8, np.uint8), np.zeros(FILTER_BITS // 8, np.uint8), 0
    for row in maps.collect():
        at = (row["bucket"] - 1) * 4096
        every[at : at + 4096] = np.frombuffer(row["all"], np.uint8)
        warm[at : at + 4096] = np.frombuffer(row["hot"], np.uint8)
        total += row["n"]
    return every, warm, total


def passes(bits: np.ndarray, core: np.ndarray) -> np.ndarray:
    at = core.view(np.uint64) & np.uint64(FILTER_BITS - 1)
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0
