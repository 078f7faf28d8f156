"""Range labels, ranks, clamps and enum fallbacks."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Thresholds of the range labels.
INPUT_SIZE = (1024, 1024 * 1024, 10 * 1024 * 1024, 50 * 1024 * 1024)
TURNS = (10, 50, 100, 200)
SCORE = (20, 40, 60, 80)
WASTE = (10, 20, 40, 60)
SESSIONS = (2, 10, 25, 50, 100)
CALLS = (1, 3, 10, 25, 50, 100)
SKIPPED = (1, 3, 10, 25, 50)

# Closed label orders, lowest rank first.
COUNT_LABELS = ("none", "1-3", "4-10", "11-25", "26-50", "51-100", "100+")
TOKEN_LABELS = ("none", "<1k", "1k-5k", "5k-15k", "15k-50k", "50k+")
EFFICIENCY_LABELS = ("unused", "underutilized", "moderate", "well-utilized")
BAND_LABELS = ("unknown", "normal", "watch", "high", "severe")
CONFIDENCE_LABELS = ("low", "medium", "high")
INFERENCE_LABELS = ("none", "calls", "header")


def _ladder(value: Column, steps: Sequence[tuple[int, str]], last: str, strict: bool) -> Column:
    out = None
    for limit, label in steps:
        test = value < limit if strict else value <= limit
        out = F.when(test, label) if out is None else out.when(test, label)
    return out.otherwise(last)


def range_bucket(value: Column, thresholds: Sequence[int]) -> Column:
    """`lo_hi` labels, `n_plus` at the end."""
    steps, low = [], 0
    for limit in thresholds:
        steps.append((limit, f"{low}_{limit}"))
        low = limit
    return _ladder(value, steps, f"{low}_plus", strict=True)


def int_bucket(value: Column, thresholds: Sequence[int]) -> Column:
    """`range_bucket` whose zero and below is `0_1`."""
    return F.when(value <= 0, "0_1").otherwise(range_bucket(value, thresholds))


def ratio_bucket(value: Column) -> Column:
    steps = [(10, "1_10"), (25, "10_25"), (50, "25_50"), (75, "50_75"), (100, "75_100")]
    return F.when(value <= 0, "0").otherwise(_ladder(value, steps, "100", strict=True))


def count_bucket(value: Column, known: Column | None = None) -> Column:
    steps = list(zip((0, 3, 10, 25, 50, 100), COUNT_LABELS))
    out = _ladder(value, steps, COUNT_LABELS[-1], strict=False)
    return out if known is None else F.when(known, out).otherwise("unknown")


def token_bucket(value: Column, known: Column | None = None) -> Column:
    steps = list(zip((1, 1000, 5000, 15000, 50000), TOKEN_LABELS))
    out = _ladder(value, steps, TOKEN_LABELS[-1], strict=True)
    return out if known is None else F.when(known, out).otherwise("unknown")


def efficiency_bucket(ratio: Column, tokens: Column, known: Column) -> Column:
    return (
        F.when(~known, "unknown")
        .when((ratio < 5) & ~tokens.isin("none", "<1k"), "unused")
        .when(ratio < 30, "underutilized")
        .when(ratio < 70, "moderate")
        .otherwise("well-utilized")
    )


def byte_size_bucket(value: Column) -> Column:
    kib = 1024
    steps = [
        (10 * kib, "<10 KB"),
        (100 * kib, "10-100 KB"),
        (kib * kib, "100 KB-1 MB"),
        (5 * kib * kib, "1-5 MB"),
    ]
    return F.when(value <= 0, "unknown").otherwise(_ladder(value, steps, ">5 MB", strict=True))


def duration_bucket(seconds: Column) -> Column:
    day = 86400
    steps = [(3600, "<1h"), (day, "1h-1d"), (7 * day, "1d-7d"), (30 * day, "7d-30d")]
    return F.when(seconds <= 0, "unknown").otherwise(
        _ladder(seconds, steps, "30d+", strict=False)
    )


def severity(value: Column, medium: int, high: int) -> Column:
    return F.when(value >= high, "high").when(value >= medium, "medium").otherwise("low")


def savings_bucket(high: Column) -> Column:
    return F.when(high < 10, "low").when(high < 30, "medium").otherwise("high")


def _wide(value) -> Column:
    value = value if isinstance(value, Column) else F.lit(value)
    return value.cast("decimal(19,0)")


def scaled(value: Column, times, over) -> Column:
    """value * times / over in whole numbers, cut towards zero; products of two BIGINTs fit. NULL over zero."""
    return F.call_function("div", _wide(value) * _wide(times), F.nullif(_wide(over), F.lit(0)))


def rounded_percent(part: Column, total: Column) -> Column:
    half = F.call_function("div", total.cast("long"), F.lit(2).cast("long"))
    whole = F.call_function("div", _wide(part) * _wide(100) + half, F.nullif(_wide(total), F.lit(0)))
    return F.when((total <= 0) | (part <= 0), F.lit(0)).otherwise(clamp(whole, 0, 100)).cast("long")


def clamp(value: Column, low, high) -> Column:
    low = low if isinstance(low, Column) else F.lit(low)
    high = high if isinstance(high, Column) else F.lit(high)
    return F.least(F.greatest(value, low), high)


def clamp_tokens(tokens: Column, total: Column) -> Column:
    return F.when(tokens < 0, F.lit(0)).when(total <= 0, tokens).otherwise(
        F.least(tokens, total)
    )


def truncated_ratio(numerator: Column, denominator: Column, scale: int) -> Column:
    """Double division, scaled, cut towards zero."""
    return (numerator.cast("double") / denominator.cast("double") * scale).cast("long")


def cache_miss_pct(tokens_in: Column, cached: Column) -> Column:
    miss = F.greatest(F.lit(0), tokens_in - cached)
    return F.when(
        tokens_in > 0, F.least(F.lit(100).cast("long"), truncated_ratio(miss, tokens_in, 100))
    ).otherwise(F.lit(0).cast("long"))


def version_bucket(raw: Column) -> Column:
    """First MAJOR.MINOR of a version banner, escape codes removed."""
    clean = F.regexp_replace(raw, r"\x1b\[[0-9;]*[A-Za-z]", "")
    found = F.regexp_extract(clean, r"(\d+\.\d+)", 1)
    return F.when(F.length(found) > 16, "").otherwise(found)


VERSION_LABELS = ("unknown", "recent", "older", "0.x", "1.x", "2.x", "3.x", "4_plus")


def coarse_version(value: Column) -> Column:
    major = F.regexp_extract(value, r"^(\d+)\.\d+$", 1)
    return (
        F.when(value == "", "")
        .when(major.isin("0", "1", "2", "3"), F.concat(major, F.lit(".x")))
        .when(major != "", "4_plus")
        .otherwise(enum_or_unknown(value, VERSION_LABELS))
    )


def enum_or_unknown(value: Column, allowed: Iterable[str]) -> Column:
    return F.when(value.isin(*allowed), value).otherwise("unknown")


def enum_or_empty(value: Column, allowed: Iterable[str]) -> Column:
    return F.when(value == "", "").otherwise(enum_or_unknown(value, allowed))


def enum_or_calculated(value: Column, calculated: Column, allowed: Iterable[str]) -> Column:
    allowed = list(allowed)
    return F.when(value.isin(*allowed), value).otherwise(enum_or_unknown(calculated, allowed))


def rank(value: Column, labels: Sequence[str], first: int = 0, missing: int = -1) -> Column:
    """Position of a label in its order."""
    out = None
    for position, label in enumerate(labels, first):
        test = value == label
        out = F.when(test, position) if out is None else out.when(test, position)
    return out.otherwise(missing)


def bucket_rank(value: Column) -> Column:
    """One rank for count, token and efficiency labels; `unknown` lowest."""
    return (
        F.when(value == "unknown", 0)
        .when(value.isin(*COUNT_LABELS), rank(value, COUNT_LABELS, 1))
        .when(value.isin(*TOKEN_LABELS), rank(value, TOKEN_LABELS, 1))
        .when(value.isin(*EFFICIENCY_LABELS), rank(value, EFFICIENCY_LABELS, 1))
        .otherwise(-1)
    )


def bounded_role(role: Column) -> Column:
    return enum_or_unknown(F.lower(F.trim(role)), ("user", "assistant", "system", "tool"))


def bounded_kind(kind: Column) -> Column:
    k = F.lower(F.trim(F.coalesce(kind, F.lit(""))))
    same = ("tool", "tool_use", "function_call", "tool_result", "function_call_output",
            "token_count")
    subagent = ("spawn_agent", "wait_agent", "close_agent", "send_input", "agent")
    return (
        F.when(k.isin(*same), k)
        .when(k.isin("patch", "patch_apply_end"), "patch")
        .when(k.isin("compacted", "context_compacted"), "compact")
        .when(k.isin(*subagent), "subagent")
        .otherwise("message")
    )


def sample_confidence(sessions: Column, events: Column) -> Column:
    return (
        F.when((sessions < 3) | (events < 20), "low")
        .when(sessions < 10, "medium")
        .otherwise("high")
    )


def sample_warnings(sessions: Column, events: Column) -> Column:
    return F.array_compact(
        F.array(
            F.when(sessions < 3, "fewer_than_3_sessions").when(
                sessions < 10, "fewer_than_10_sessions"
            ),
            F.when(events < 20, "thin_event_sample"),
        )
    )


def footprint_tokens(schema_bytes: Column, per_item: Column) -> Column:
    """Measured bytes over four, else a fixed price per exposed item."""
    return F.when(schema_bytes > 0, F.floor(schema_bytes / 4)).otherwise(per_item).cast("long")
