"""Periodic runs of words by branching tandem repeats of an enhanced suffix array.

A chunk of texts is one array of word ids whose suffixes are sorted by prefix doubling; the kept
ranks of each round give common prefixes by binary lifting. Every entry of the common-prefix
array splits the suffixes around it in two children whose common depth is its value. Two
suffixes `depth` words apart, one in each child, are a tandem repeat that breaks behind its end;
it is found from the smaller child by looking at the inverse suffix array `depth` words before
and behind each of its suffixes. Rotating it to the left, again by lifting, as long as the words
agree gives the whole run. No tree is built: an interval is three numbers of flat arrays.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from turnwise.llm.common import ranges, text_chunks, words

#: Suffixes of smaller children that are looked at in one go.
AT_ONCE = 1 << 20


@dataclass(frozen=True)
class RunLimits:
    """A run has at least `words` words and `periods` times its period."""

    words: int = 6
    periods: int = 4


@dataclass
class SuffixArray:
    """Sorted suffixes of many texts side by side; suffixes of different texts share nothing."""

    start: np.ndarray  # of the text of each place
    stop: np.ndarray
    at: np.ndarray  # place of each rank
    rank: np.ndarray
    levels: list[np.ndarray]  # equal numbers at k: the next 2**k words agree
    lcp: np.ndarray  # of a rank and the one before

    @classmethod
    def of(cls, ids: np.ndarray, sizes: np.ndarray) -> SuffixArray:
        n, ends = len(ids), np.cumsum(sizes)
        start, stop = np.repeat(ends - sizes, sizes), np.repeat(ends, sizes)
        level = _dense(start * (int(ids.max(initial=0)) + 1) + ids)
        levels, step = [level], 1
        tied = _company(level)
        while len(tied):
            after = tied + step
            second = np.where(after < stop[tied], level[np.minimum(after, n - 1)].astype(np.int64) + 1, 0)
            key = level[tied].astype(np.int64) * (n + 1) + second
            order = np.argsort(key, kind="stable")
            key, group = key[order], level[tied][order]
            new = np.r_[True, key[1:] != key[:-1]]
            heads = np.r_[True, group[1:] != group[:-1]]
            place = np.arange(len(key))
            offset = np.maximum.accumulate(np.where(new, place, 0)) - np.maximum.accumulate(np.where(heads, place, 0))
            level = level.copy()
            level[tied[order]] = group + offset
            tied = tied[order][~(new & np.r_[new[1:], True])]
            levels.append(level)
            step *= 2
        at = np.empty(n, np.int64)
        at[level] = np.arange(n)
        lcp = np.zeros(n, np.int64)
        if n:
            near = np.flatnonzero(start[at[1:]] == start[at[:-1]])
            lcp[near + 1] = _common(levels, at[near], at[near + 1], stop[at[near]], 1)
        return cls(start, stop, at, level.astype(np.int64), levels, lcp)

    def rotations(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words before places a < b agree, inside the text."""
        return _common(self.levels, a, b, self.start[a], -1)


def _dense(key: np.ndarray) -> np.ndarray:
    """For each key the number of smaller ones."""
    order = np.argsort(key, kind="stable")
    new = np.r_[True, key[order][1:] != key[order][:-1]] if len(key) else np.zeros(0, bool)
    out = np.empty(len(key), np.int32)
    out[order] = np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))
    return out


def _company(level: np.ndarray) -> np.ndarray:
    """Places whose number occurs more than once."""
    return np.flatnonzero(np.bincount(level, minlength=len(level))[level] > 1)


def _common(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray, bound: np.ndarray, way: int) -> np.ndarray:
    """Words that agree from a and b on (way 1, up to where the first ends) or before them (way -1)."""
    total = np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        width = 1 << k
        if way > 0:
            x, y = a + total, b + total
            inside = (np.maximum(x, y) < len(levels[k])) & (x < bound)
        else:
            x, y = a - total - width, b - total - width
            inside = x >= bound
        same = levels[k][np.where(inside, x, 0)] == levels[k][np.where(inside, y, 0)]
        total += (inside & same) * width
    return total


def _children(lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rank, first of its left child, last of its right child) for all ranks with a common prefix.

    The left child reaches back over values of at least its own, the right one ahead over larger
    ones, so of equal values each splits what is between them once.
    """
    at = np.flatnonzero(lcp > 0)
    value = lcp[at]
    lows = [lcp]
    while len(lows[-1]) > 1 << len(lows):
        half = 1 << (len(lows) - 1)
        lows.append(np.minimum(lows[-1][:-half], lows[-1][half:]))
    left, right = at - 1, at + 1
    for k in range(len(lows) - 1, -1, -1):
        low, width = lows[k], 1 << k
        # entries left - width + 1 .. left, and right .. right + width - 1
        first = left - width + 1
        left = np.where((first >= 0) & (low[np.maximum(first, 0)] >= value), left - width, left)
        fits = right + width <= len(lcp)
        right = np.where(fits & (low[np.minimum(right, len(low) - 1)] > value), right + width, right)
    return at, np.maximum(left, 0), right - 1


def runs_of(ids: np.ndarray, sizes: np.ndarray, limits: RunLimits = RunLimits()) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs, by start and period; starts are places of the joined texts."""
    none = np.zeros(0, np.int64)
    sa = SuffixArray.of(ids, sizes)
    if not sa.lcp.any():
        return none, none, none
    entry, first, last = _children(sa.lcp)
    depth = sa.lcp[entry]
    text = sa.at[entry]
    wide = limits.periods * depth <= sa.stop[text] - sa.start[text]
    entry, first, last, depth = entry[wide], first[wide], last[wide], depth[wide]
    small_left = entry - first <= last - entry + 1
    low, size = np.where(small_left, first, entry), np.where(small_left, entry - first, last - entry + 1)
    other, other_end = np.where(small_left, entry, first), np.where(small_left, last, entry - 1)
    found = [(none, none, none)]
    portion = np.cumsum(size) // AT_ONCE
    edges = np.flatnonzero(np.r_[True, portion[1:] != portion[:-1], True]) if len(size) else np.zeros(1, np.int64)
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        who = np.repeat(np.arange(a, b), size[a:b])
        place = sa.at[ranges(low[a:b], size[a:b])]
        d = depth[who]
        for other_place, begin in ((place + d, place), (place - d, place - d)):
            ok = (other_place >= sa.start[place]) & (other_place < sa.stop[place])
            there = sa.rank[np.where(ok, other_place, 0)]
            ok &= (there >= other[who]) & (there <= other_end[who])
            x, period = begin[ok], d[ok]
            back = sa.rotations(x, x + period)
            length = back + 2 * period
            long = length >= np.maximum(limits.words, limits.periods * period)
            found.append(((x - back)[long], length[long], period[long]))
    start, length, period = (np.concatenate(x) for x in zip(*found, strict=True))
    # the same words at a multiple of the smallest period
    order = np.lexsort((period, length, start))
    start, length, period = start[order], length[order], period[order]
    fresh = np.r_[True, (start[1:] != start[:-1]) | (length[1:] != length[:-1])] if len(start) else np.zeros(0, bool)
    start, length, period = start[fresh], length[fresh], period[fresh]
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def periodic_runs(
    df: DataFrame, limits: RunLimits = RunLimits(), id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """id, `runs` (word number of the start, length in words, period) and `collapsed`, one row per row of `df`.

    Words are split at ASCII white space. A run is a stretch with a smallest period that holds
    it `limits.periods` times and that no neighbouring word extends; runs are sorted by start
    and period. `collapsed` has the words that no run holds behind its first period, joined by
    single spaces. A null, empty or blank text has no runs and an empty `collapsed`; repeated rows
    give repeated rows, an empty table none; other columns are ignored. Texts are worked on in
    chunks of bounded size (at least one text), in time of n log n whatever their repetition;
    there is no shuffle, lost tasks start anew.
    """
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), *T._parse_datatype_string(f"runs {RUNS}, collapsed string")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in text_chunks(batch, text_col, 3 << 20):
                lists = [words(t) for t in texts]
                found, dropped = measure(lists, limits)
                kept = [b" ".join(x if gone is None else compress(x, ~gone)) for x, gone in zip(lists, dropped, strict=True)]
                cols = [rows.column(id_col), found, pa.array(kept, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(cols, [id_col, "runs", "collapsed"])

    return df.select(id_col, text_col).mapInArrow(run, schema)


def measure(lists: list[list[bytes]], limits: RunLimits) -> tuple[pa.ListArray, list[np.ndarray | None]]:
    """Runs of each list of words, and the mask of words to drop (None: none)."""
    sizes = np.array([len(x) for x in lists], np.int64)
    index: dict[bytes, int] = {}
    ids = np.fromiter((index.setdefault(w, len(index)) for x in lists for w in x), np.int64, int(sizes.sum()))
    start, length, period = runs_of(ids, sizes, limits)
    bounds = np.cumsum(sizes)
    text = np.searchsorted(bounds, start, "right")
    counts = np.bincount(text, minlength=len(lists))
    local = start - (bounds - sizes)[text]
    fields = [pa.array(x, pa.int64()) for x in (local, length, period)]
    structs = pa.StructArray.from_arrays(fields, ["start", "length", "period"])
    runs = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)], pa.int32()), structs)
    edge = np.bincount(start + period, minlength=len(ids) + 1) - np.bincount(start + length, minlength=len(ids) + 1)
    gone = np.cumsum(edge)[: len(ids)] > 0
    parts = np.split(gone, bounds[:-1]) if len(lists) else []
    return runs, [p if c else None for p, c in zip(parts, counts, strict=True)]
