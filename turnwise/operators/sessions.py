"""Session folds: metrics, timelines, retries, signals, and per-source orderings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnwise.functions import buckets as B
from turnwise.functions import text as X
from turnwise.operators import blocks

SAMPLE_EVERY = 10
GROWTH_TOKENS = 6000
CACHE_SPIKE_TOKENS = 8000
HALF_LIFE_SECONDS = 14 * 86400


def _one(test: Column) -> Column:
    return F.when(test, F.lit(1)).otherwise(F.lit(0)).cast("long")


def _sample(turn: str) -> Column:
    return F.floor((F.col(turn) - 1) / SAMPLE_EVERY).cast("long")


def file_reads_of(turns: DataFrame, log: str = "log_id", text: str = "text") -> DataFrame:
    """(log, turn, file) for every file that a line reads."""
    return turns.select(log, "turn", F.explode(X.file_reads(F.col(text))).alias("file"))


def reread_counts(reads: DataFrame, log: str = "log_id", file: str = "file") -> DataFrame:
    """Reads after the first, per log."""
    per_file = reads.groupBy(log, file).agg(F.count(F.lit(1)).alias("_n"))
    return per_file.groupBy(log).agg(F.sum(F.col("_n") - 1).cast("long").alias("rereads"))


def top_reread_files(
    reads: DataFrame, log: str = "log_id", file: str = "file", k: int = 5
) -> DataFrame:
    """The k files read most often, of those read twice or more; ties by name.

    The rank filter runs once before the shuffle, so a log with very many files sends
    only its local best.
    """
    per_file = reads.groupBy(log, file).agg(F.count(F.lit(1)).alias("reads"))
    order = Window.partitionBy(log).orderBy(F.desc("reads"), F.asc(file))
    return (
        per_file.filter(F.col("reads") > 1)
        .withColumn("rank", F.row_number().over(order).cast("long"))
        .filter(F.col("rank") <= k)
    )


def retry_depth(turns: DataFrame, log: str = "log_id", pos: str = "turn", **kw) -> DataFrame:
    """Longest run of errors; only a line that is neither error nor tool ends one."""
    return blocks.longest_run(
        turns,
        log,
        pos,
        hit=F.col("is_error"),
        reset=~F.col("is_error") & ~F.col("is_tool"),
        out="retry_depth_max",
        **kw,
    )


def context_growth(turns: DataFrame, log: str = "log_id") -> DataFrame:
    """Samples whose token count exceeds the one before by more than 6000.

    The difference of two cumulative samples is the sum between them, so one grouping
    per ten turns answers it.
    """
    sampled = turns.groupBy(log, _sample("turn").alias("_s")).agg(F.sum("tokens").alias("_t"))
    return sampled.groupBy(log).agg(
        F.sum(_one((F.col("_s") > 0) & (F.col("_t") > GROWTH_TOKENS))).alias(
            "context_growth_events"
        )
    )


def session_metrics(
    turns: DataFrame, log: str = "log_id", reads: DataFrame | None = None, **kw
) -> DataFrame:
    """One row per log: the eight session counters."""
    sums = turns.groupBy(log).agg(
        F.count(F.lit(1)).alias("turns"),
        F.sum("tokens").alias("estimated_tokens"),
        F.sum(F.when(F.col("is_tool"), F.col("tokens")).otherwise(0)).alias("tool_output_tokens"),
        F.sum(_one(F.col("is_error"))).alias("failed_commands"),
    )
    reads = file_reads_of(turns, log) if reads is None else reads
    return (
        sums.join(retry_depth(turns, log, **kw), log, "left")
        .join(context_growth(turns, log), log, "left")
        .join(reread_counts(reads, log), log, "left")
        .na.fill(0, ["retry_depth_max", "context_growth_events", "rereads"])
    )


def timeline(
    turns: DataFrame, log: str = "log_id", reads: DataFrame | None = None, **kw
) -> DataFrame:
    """Cumulative counters at every tenth turn and at the last one."""
    keep = turns.select(
        log,
        _sample("turn").alias("_s"),
        F.col("turn").alias("turn"),
        F.col("tokens").alias("_tok"),
        F.when(F.col("is_tool"), F.col("tokens")).otherwise(0).cast("long").alias("_tool"),
        _one(F.col("is_error")).alias("_err"),
        F.lit(0).cast("long").alias("_rr"),
    )
    if reads is not None:
        zero = F.lit(0).cast("long")
        per_turn = reads.groupBy(log, "file", "turn").agg(F.count(F.lit(1)).alias("_rr"))
        first = reads.groupBy(log, "file").agg(F.min("turn").alias("turn"))
        for rows, rr in ((per_turn, F.col("_rr")), (first, F.lit(-1).cast("long"))):
            keep = keep.unionByName(
                rows.select(
                    log, _sample("turn").alias("_s"), "turn", zero.alias("_tok"),
                    zero.alias("_tool"), zero.alias("_err"), rr.alias("_rr"),
                )
            )
    sampled = keep.groupBy(log, "_s").agg(
        F.max("turn").alias("turn"),
        *[F.sum(c).alias(c) for c in ("_tok", "_tool", "_err", "_rr")],
    )
    return blocks.running_sum(
        sampled,
        log,
        "_s",
        {
            "estimated_tokens": F.col("_tok"),
            "tool_tokens": F.col("_tool"),
            "rereads": F.col("_rr"),
            "retries": F.col("_err"),
        },
        **kw,
    ).select(log, "turn", "estimated_tokens", "tool_tokens", "rereads", "retries")


def tool_calls(
    events: DataFrame,
    log: str = "log_id",
    pos: str = "pos",
    step: int = 1,
    rows_per_block: int = blocks.ROWS_PER_BLOCK,
) -> DataFrame:
    """One row per tool call with `call_seq` and whether it failed.

    `step` is the usual gap between two positions.

    An error on the call or on any event before the next call marks it failed.
    """
    is_call = F.col("kind") == "tool_call"
    seq = blocks.running_sum(
        events, log, pos, {"call_seq": _one(is_call)}, rows_per_block=rows_per_block * step
    )
    return (
        seq.filter(F.col("call_seq") > 0)
        .groupBy(log, "call_seq")
        .agg(
            *[
                F.max(F.when(is_call, F.col(c))).alias(c)
                for c in ("tool", "args_hash", "parent_hash", pos)
            ],
            F.max("error").alias("failed"),
        )
        .withColumn("call_seq", F.col("call_seq") - 1)
    )


def identical_retries(
    events: DataFrame, log: str = "log_id", pos: str = "pos", step: int = 1, **kw
) -> DataFrame:
    """Longest run of calls that repeat the failed call before them."""
    calls = tool_calls(events, log, pos, step, **kw)
    paired = blocks.with_previous(
        calls, log, "call_seq", ["tool", "args_hash", "parent_hash", "failed"], **kw
    )
    parents_agree = (
        (F.col("prev_parent_hash") == "")
        | (F.col("parent_hash") == "")
        | (F.col("prev_parent_hash") == F.col("parent_hash"))
    )
    retry = F.coalesce(
        (F.col("prev_tool") != "")
        & (F.col("prev_tool") == F.col("tool"))
        & (F.col("prev_args_hash") != "")
        & (F.col("prev_args_hash") == F.col("args_hash"))
        & parents_agree
        & F.col("prev_failed"),
        F.lit(False),
    )
    paired = paired.withColumn("_retry", retry)
    return blocks.longest_run(
        paired, log, "call_seq", hit=F.col("_retry"), reset=~F.col("_retry"),
        out="args_hashed_retry_loops", **kw,
    )


SIGNAL_SUMS = {
    "cache_read_tokens": "tok_cached",
    "cache_creation_tokens": "tok_cache_new",
    "input_tokens": "tok_in",
    "output_tokens": "tok_out",
    "tool_output_bytes": "out_bytes",
    "patch_lines_added": "patch_add",
    "patch_lines_removed": "patch_del",
}


def signal_sums(events: DataFrame, *by: str) -> DataFrame:
    """Event, call and result counts, token, byte and patch sums."""
    kind = F.col("kind")
    sums = events.groupBy(*by).agg(
        F.count(F.lit(1)).alias("normalized_event_count"),
        F.sum(_one(kind == "tool_call")).alias("tool_call_count"),
        F.sum(_one(kind == "tool_result")).alias("tool_result_count"),
        F.sum(_one(F.col("tok_cache_new") >= CACHE_SPIKE_TOKENS)).alias(
            "cache_invalidation_events"
        ),
        *[F.sum(col).alias(name) for name, col in SIGNAL_SUMS.items()],
    )
    return sums.withColumn(
        "cache_miss_ratio_pct", B.cache_miss_pct(F.col("input_tokens"), F.col("cache_read_tokens"))
    )


def session_signals(events: DataFrame, log: str = "log_id", pos: str = "pos", **kw) -> DataFrame:
    sums = signal_sums(events, log)
    count = F.col("normalized_event_count")
    return (
        sums.join(identical_retries(events, log, pos, **kw), log, "left")
        .na.fill(0, ["args_hashed_retry_loops"])
        .withColumn("sample_confidence", B.sample_confidence(F.lit(1), count))
        .withColumn("sample_warnings", B.sample_warnings(F.lit(1), count))
    )


def reconcile(metrics: DataFrame, signals: DataFrame, log: str = "log_id") -> DataFrame:
    """Native counters win over estimates where they are larger."""
    both = metrics.join(signals, log, "left")
    counts = [c for c, t in signals.dtypes if t == "bigint" and c != log]
    both = both.na.fill(0, counts)
    native = F.col("input_tokens") + F.col("output_tokens")
    out_tokens = F.greatest(
        F.lit(1).cast("long"), F.floor(F.col("tool_output_bytes") / 4).cast("long")
    )
    return both.withColumns(
        {
            "estimated_tokens": F.greatest("estimated_tokens", native),
            "tool_output_tokens": F.when(
                F.col("tool_output_bytes") > 0, F.greatest("tool_output_tokens", out_tokens)
            ).otherwise(F.col("tool_output_tokens")),
            "retry_depth_max": F.greatest("retry_depth_max", "args_hashed_retry_loops"),
            "context_growth_events": F.col("context_growth_events")
            + F.col("cache_invalidation_events"),
        }
    )


def combined_timeline(
    points: DataFrame,
    metrics: DataFrame,
    source: str,
    log: str,
    order: list[str],
    **kw,
) -> DataFrame:
    """Timelines of a source's logs end to end: each log starts at the totals so far."""
    cols = {
        "turn": "turns",
        "estimated_tokens": "estimated_tokens",
        "tool_tokens": "tool_output_tokens",
        "rereads": "rereads",
        "retries": "failed_commands",
    }
    ranked = blocks.dense_position(metrics, source, order, out="_pos")
    totals = blocks.running_sum(
        ranked, source, "_pos", {f"_c_{p}": F.col(m) for p, m in cols.items()}, **kw
    )
    offsets = totals.select(
        log,
        source,
        *[(F.col(f"_c_{p}") - F.col(m)).alias(f"_o_{p}") for p, m in cols.items()],
    )
    return points.join(offsets, log).select(
        source, log, *[(F.col(p) + F.col(f"_o_{p}")).alias(p) for p in cols]
    )


def downsample(points: DataFrame, log: str, pos: str, limit: int = 60) -> DataFrame:
    """Keep at most `limit` evenly spread points of each series.

    Point i of the sample is at ``i*(n-1) div (limit-1)``; whether a position is one of
    them follows from its own number and the length of its series.
    """
    lengths = points.groupBy(log).agg(F.count(F.lit(1)).alias("_n"))
    joined = points.join(lengths, log)
    last, steps = F.col("_n") - 1, limit - 1
    i = F.ceil(F.col(pos) * steps / last)
    at = F.floor(i * last / steps)
    return joined.filter((F.col("_n") <= limit) | (at == F.col(pos))).drop("_n")


def recency_rank(
    logs: DataFrame, source: str, mod_time: str, size: str, path: str, k: int
) -> DataFrame:
    """The k best logs of each source by size decayed with age."""
    newest = logs.groupBy(source).agg(F.max(mod_time).alias("_newest"))
    age = F.greatest(
        F.lit(0.0),
        (blocks.micros(F.col("_newest")) - blocks.micros(F.col(mod_time))) / F.lit(1e6),
    )
    scored = logs.join(newest, source).withColumn(
        "score", F.col(size) * F.exp(-age / F.lit(float(HALF_LIFE_SECONDS)))
    )
    order = Window.partitionBy(source).orderBy(
        F.desc("score"), F.desc(mod_time), F.desc(size), F.desc(path)
    )
    return (
        scored.withColumn("rank", F.row_number().over(order).cast("long"))
        .filter(F.col("rank") <= k)
        .drop("_newest")
    )


def log_refs(logs: DataFrame, source: str, order: list[str]) -> DataFrame:
    """Number the logs of a source from 1."""
    ranked = blocks.dense_position(logs, source, order, out="_p")
    return ranked.withColumn("ordinal", F.col("_p") + 1).drop("_p")
