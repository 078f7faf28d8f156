"""Repetition inside a text by suffix arrays over its words.

A chunk of texts is one array of word ids. Prefix doubling sorts the suffixes of every text at
once, working only on suffixes that still tie; the kept ranks of each round give the longest
common prefix of neighbours by binary lifting. Of the common-prefix intervals that hold a
suffix, the deepest one is the longest repeated substring that starts there; maximal repeats
are those that no longer repeat covers from the left, so the union of all spans is the union
of the maximal ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from turnwise.llm.common import SPACES, text_chunks, words

SYMBOLS = "[#*$%&|<>]"


@dataclass(frozen=True)
class RepeatLimits:
    """Texts are kept up to these. `min_words`: shorter repeats don't count."""

    min_words: int = 8
    covered_percent: int = 45
    longest_words: int = 200


def longest_repeats(ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each position, the longest prefix (in symbols) of its suffix that occurs again in the same text."""
    n = len(ids)
    if not n:
        return np.zeros(0, np.int64)
    text = np.repeat(np.arange(len(sizes)), sizes)
    end = np.repeat(np.cumsum(sizes), sizes)

    def grouped(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Order by key, and for the sorted places the first place of their group and whether it has company."""
        order = np.argsort(key, kind="stable")
        new = np.r_[True, key[order][1:] != key[order][:-1]]
        first = np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))
        alone = new & np.r_[new[1:], True]
        return order, first, alone

    order, first, alone = grouped(text * (int(ids.max()) + 1) + ids)
    rank = np.empty(n, np.int64)
    rank[order] = first
    levels, step = [rank.copy()], 1
    tied = order[~alone]
    while len(tied):
        after = tied + step
        second = np.where(after < end[tied], rank[np.minimum(after, n - 1)], -1) + 1
        old = rank[tied]
        order, first, alone = grouped(old * (n + 1) + second)
        old_first = np.maximum.accumulate(np.where(np.r_[True, old[order][1:] != old[order][:-1]], np.arange(len(order)), 0))
        rank[tied[order]] = old[order] + first - old_first
        tied = tied[order[~alone]]
        step *= 2
        levels.append(rank.copy())
    suffixes = np.empty(n, np.int64)
    suffixes[rank] = np.arange(n)
    a, b = suffixes[:-1].copy(), suffixes[1:].copy()
    here = np.flatnonzero(text[a] == text[b])
    a, b = a[here], b[here]
    stop, common = end[a], np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        x, y = a + common, b + common
        inside = (x < stop) & (y < stop)
        same = inside & (levels[k][np.minimum(x, n - 1)] == levels[k][np.minimum(y, n - 1)])
        common += same << k
    lcp = np.zeros(n + 1, np.int64)
    lcp[here + 1] = common
    best = np.maximum(lcp[:-1], lcp[1:])
    out = np.empty(n, np.int64)
    out[suffixes] = best
    return out


def covered(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """Mask of positions inside some span."""
    edge = np.bincount(starts, minlength=n + 1) - np.bincount(starts + lengths, minlength=n + 1)
    return np.cumsum(edge[: n + 1])[:n] > 0


COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_words", "longest_repeat"]


def quality(df: DataFrame, limits: RepeatLimits = RepeatLimits(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts, repetition and verdict for each row: id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, covered_words, longest_repeat, base_failed, kept.

    A text fails the base rule with fewer than 50 words or with more than half of its words in
    repeated three-word windows. It is kept if it passes and the spans of its repeats of
    `limits.min_words` words or more cover at most `limits.covered_percent` percent of its words,
    the longest one at most `limits.longest_words`. Overlapping occurrences count. A null or empty
    text has zero words and is not kept; repeated rows give repeated rows, an empty table none;
    other columns are ignored. Texts are worked on in chunks of bounded size (at least one text);
    there is no shuffle.
    """
    fields = [T.StructField(id_col, df.schema[id_col].dataType)]
    fields += [T.StructField(c, T.LongType()) for c in COLUMNS]
    fields += [T.StructField(c, T.BooleanType()) for c in ("base_failed", "kept")]
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in text_chunks(batch, text_col, 3 << 20):
                got = measure(texts, limits.min_words)
                failed, kept = verdict(got, limits)
                cols = [pa.array(got[c], pa.int64()) for c in COLUMNS]
                yield pa.RecordBatch.from_arrays([rows.column(id_col), *cols, pa.array(failed), pa.array(kept)], names)

    return df.select(id_col, text_col).mapInArrow(run, T.StructType(fields))


def keep(df: DataFrame, limits: RepeatLimits = RepeatLimits(), text_col: str = "text") -> DataFrame:
    """The rows of `df`, all columns as they are, that `quality` keeps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in text_chunks(batch, text_col, 3 << 20):
                yield rows.filter(pa.array(verdict(measure(texts, limits.min_words), limits)[1]))

    return df.mapInArrow(run, df.schema)


def verdict(got: dict[str, np.ndarray], limits: RepeatLimits) -> tuple[np.ndarray, np.ndarray]:
    """(failed the base rule, kept) for each text."""
    n = got["n_words"]
    failed = (n < 50) | (100 * got["n_repeat_words"] > 50 * n)
    few = 100 * got["covered_words"] <= limits.covered_percent * n
    return failed, ~failed & few & (got["longest_repeat"] <= limits.longest_words)


def measure(texts: list[str | None], min_words: int) -> dict[str, np.ndarray]:
    lists = [words(t) for t in texts]
    sizes = np.array([len(x) for x in lists], np.int64)
    index: dict[bytes, int] = {}
    ids = np.fromiter((index.setdefault(w, len(index)) for x in lists for w in x), np.int64, int(sizes.sum()))
    best = longest_repeats(ids, sizes)
    n, bounds = len(ids), np.r_[0, np.cumsum(sizes)]

    def per_text(mask: np.ndarray) -> np.ndarray:
        return np.diff(np.r_[0, np.cumsum(mask)][bounds])

    trigrams = np.flatnonzero(best >= 3)
    spans = np.flatnonzero(best >= min_words)
    longest = np.zeros(len(texts), np.int64)
    np.maximum.at(longest, np.repeat(np.arange(len(texts)), sizes)[spans], best[spans])
    chars, symbols, lines = [], [], []
    for t in texts:
        t = t or ""
        chars.append(len(t) - sum(map(t.count, SPACES)))
        symbols.append(sum(map(t.count, "#*$%&|<>")))
        with_word = [x for x in t.split("\n") if x.strip(SPACES)]
        lines.append(len(with_word) - len(set(with_word)))
    return {
        "n_words": sizes,
        "word_chars": np.array(chars, np.int64),
        "n_symbols": np.array(symbols, np.int64),
        "n_dup_lines": np.array(lines, np.int64),
        "n_repeat_words": per_text(covered(trigrams, np.full(len(trigrams), 3), n)),
        "covered_words": per_text(covered(spans, best[spans], n)),
        "longest_repeat": longest,
    }
