"""Choosing logs: target-size subsets, largest first, retention."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnwise.operators import sessions

TARGET_BYTES = 5 * 1024 * 1024
POOL = 40
MAX_PICKS = 5


def _best_subset(sizes: np.ndarray, scores: np.ndarray, limit: int) -> tuple[int, ...]:
    """Positions of the subset closest to the target; then no overshoot, more score, fewer."""
    best, best_key = (), None
    for k in range(1, min(limit, len(sizes)) + 1):
        picks = np.fromiter(
            (i for combo in combinations(range(len(sizes)), k) for i in combo), dtype=np.int16
        ).reshape(-1, k)
        totals = sizes[picks].sum(axis=1)
        points = scores[picks].sum(axis=1)
        order = np.lexsort((-points, totals > TARGET_BYTES, np.abs(totals - TARGET_BYTES)))
        top = order[0]
        key = (
            abs(int(totals[top]) - TARGET_BYTES),
            bool(totals[top] > TARGET_BYTES),
            -float(points[top]),
            k,
        )
        if best_key is None or key < best_key:
            best, best_key = tuple(picks[top]), key
    return best


def target_sized(
    logs: DataFrame,
    source: str = "source_id",
    path: str = "path",
    mod_time: str = "mod_time",
    size: str = "size_bytes",
    limit: int = MAX_PICKS,
) -> DataFrame:
    """Per source, at most five of the 40 best logs whose total is closest to 5 MiB.

    Logs above the target are left out unless all are. The pool is cut to 40 rows per
    source before the search, so a group is small however many logs a source has.
    """
    fits = logs.groupBy(source).agg(F.max((F.col(size) <= TARGET_BYTES).cast("int")).alias("_fits"))
    bounded = logs.join(fits, source).filter(
        (F.col("_fits") == 0) | (F.col(size) <= TARGET_BYTES)
    )
    pool = sessions.recency_rank(bounded.drop("_fits"), source, mod_time, size, path, POOL)
    pool = pool.select(
        source, F.col(path).alias("path"), F.col(size).cast("long").alias("size_bytes"), "score", "rank"
    )
    schema = pool.select(source, "path", "size_bytes", "score").schema

    def pick(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("rank")
        chosen = _best_subset(
            group["size_bytes"].to_numpy(np.int64), group["score"].to_numpy(float), limit
        )
        out = group.iloc[list(chosen)]
        return out[[source, "path", "size_bytes", "score"]]

    return pool.groupBy(source).applyInPandas(pick, schema)


def largest_first(
    logs: DataFrame, size: str, path: str, max_bytes: int, limit: int
) -> tuple[DataFrame, DataFrame]:
    """(the `limit` largest logs that fit, number of larger ones met on the way).

    The order is by size, so every log above the bound is met before the first that fits.
    """
    kept = logs.filter(F.col(size) <= max_bytes).orderBy(F.desc(size), path).limit(limit)
    skipped = logs.agg(F.sum((F.col(size) > max_bytes).cast("long")).alias("skipped_too_large"))
    return kept, skipped


def expired(
    files: DataFrame, kind: str, mod_time: str, now, ttl_seconds: dict[str, int]
) -> DataFrame:
    """Files older than the time to live of their kind; zero or less keeps all."""
    test = F.lit(False)
    age = F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(
        F.col(mod_time).cast("timestamp")
    )
    for name, ttl in ttl_seconds.items():
        if ttl > 0:
            test = test | ((F.col(kind) == name) & (age > ttl * 1_000_000))
    return files.filter(test)


def smoke_summary(reports: DataFrame) -> DataFrame:
    """Analyzed logs, lowest, highest and whole average score."""
    return reports.agg(
        F.count(F.lit(1)).alias("analyzed"),
        F.coalesce(F.min("score"), F.lit(0)).alias("score_min"),
        F.coalesce(F.max("score"), F.lit(0)).alias("score_max"),
        F.coalesce(F.floor(F.sum("score") / F.count(F.lit(1))), F.lit(0)).cast("long").alias("score_avg"),
    )


def newest_first(rows: DataFrame, ts: str, tie: str, limit: int) -> DataFrame:
    """Newest rows first, at most `limit`."""
    return rows.orderBy(F.desc(ts), F.asc(tie)).limit(limit)


def first_per_group(rows: DataFrame, by: str, order: list, k: int) -> DataFrame:
    """First k rows of each group; the rank limit runs before the shuffle too."""
    w = Window.partitionBy(by).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
