"""A/B benchmark statistics, costs, publication and audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnwise.operators import blocks

# Published price per million tokens.
CLAUDE_RATES = {
    "input_tokens": 3.00,
    "cache_creation_input_tokens": 6.00,
    "cache_read_input_tokens": 0.30,
    "output_tokens": 15.00,
}
CODEX_RATES = {
    "uncached_input_tokens": 1.75,
    "cached_input_tokens": 0.175,
    "output_tokens": 14.00,
    "reasoning_output_tokens": 14.00,
}
SPEND_LEVELS = (
    ("weekly_100_usd", 100), ("weekly_500_usd", 500), ("monthly_2000_usd", 2000),
    ("monthly_5000_usd", 5000), ("monthly_10000_usd", 10000),
)
MIN_REPEATS = 3
DEFAULT_POLICY = "recommendation_evidence"
WAITING_POLICIES = ("candidate_until_reviewed", "research_only", "diagnostic_only")


def run_deltas(sides: DataFrame, keys: list[str], side: str, metric: str, value: str) -> DataFrame:
    """optimized − baseline per (suite, run, metric): one grouping instead of a self join."""
    pick = lambda name: F.max(F.when(F.col(side) == name, F.col(value)))
    return (
        sides.groupBy(*keys, metric)
        .agg(pick("baseline").alias("baseline"), pick("optimized").alias("optimized"))
        .filter(F.col("baseline").isNotNull() & F.col("optimized").isNotNull())
        .withColumn("delta", F.col("optimized") - F.col("baseline"))
    )


def delta_stats(deltas: DataFrame, *by: str, value: str = "delta") -> DataFrame:
    """n, mean, median, min, max and sample deviation (0 for one run)."""
    rows = deltas.select(*by, F.col(value).cast("double").alias("_v")).filter(
        F.col("_v").isNotNull()
    )
    stats = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("_v").alias("mean"),
        F.min("_v").alias("min"),
        F.max("_v").alias("max"),
        F.coalesce(F.stddev_samp("_v"), F.lit(0.0)).alias("stdev"),
    )
    return stats.join(exact_median(rows, *by, value="_v"), list(by))


def exact_median(rows: DataFrame, *by: str, value: str) -> DataFrame:
    """Median from the one or two middle positions, by weighted selection.

    Equal values of a group become one row with their count before anything is ordered. These
    rows lie in ranges of (group, value); sums of counts per range tell which range holds a
    middle position, and only that range is summed up value by value. No task orders a group.
    """
    keyed = rows.select(F.struct(*by).alias("_g"), F.col(value).alias("_v"))
    counts = keyed.groupBy("_g", "_v").agg(F.count(F.lit(1)).alias("_c"))
    placed = blocks.spread(counts, "_g", ["_v"]).drop("_at")
    before = Window.partitionBy("_g").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("_n").over(Window.partitionBy("_g"))
    ranges = placed.groupBy("_g", "_part").agg(F.sum("_c").alias("_n")).withColumns(
        {
            "_skip": F.coalesce(F.sum("_n").over(before), F.lit(0)),
            "_low": F.floor((total - 1) / 2),
            "_high": F.floor(total / 2),
        }
    )
    middle = ranges.filter("_skip <= _high AND _low < _skip + _n").select("_g", "_part", "_skip", "_low", "_high")
    inside = Window.partitionBy("_g", "_part").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    up_to = F.col("_skip") + F.sum("_c").over(inside)
    held = placed.join(middle, ["_g", "_part"]).withColumn("_end", up_to)
    held = held.filter("_end - _c <= _high AND _low < _end")
    return held.groupBy("_g").agg(((F.min("_v") + F.max("_v")) / 2).alias("median")).select("_g.*", "median")


def quality_gate(runs: DataFrame, *by: str) -> DataFrame:
    """All runs pass and enough of them are there."""
    ok = (
        (F.col("baseline_quality_status").cast("string") == "0")
        & (F.col("optimized_quality_status").cast("string") == "0")
        & (F.col("baseline_exit_status") == 0)
        & (F.col("optimized_exit_status") == 0)
    )
    return runs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("completed_repeats"),
        F.max("required_repeats").alias("required_repeats"),
        (
            F.min(F.coalesce(ok, F.lit(False)))
            & (F.count(F.lit(1)) >= F.max("required_repeats"))
        ).alias("quality_passed"),
    )


def _cost(rates: dict, get) -> Column:
    total = None
    for name, rate in rates.items():
        part = F.coalesce(get(name), F.lit(0)).cast("double") * F.lit(rate)
        total = part if total is None else total + part
    return total / F.lit(1_000_000.0)


def claude_cost(usage: Column | None = None, prefix: str = "") -> Column:
    get = (lambda n: usage[n]) if usage is not None else (lambda n: F.col(prefix + n))
    return _cost(CLAUDE_RATES, get)


def codex_cost(usage: Column | None = None, prefix: str = "") -> Column:
    field = (lambda n: usage[n]) if usage is not None else (lambda n: F.col(prefix + n))

    def get(name):
        if name == "uncached_input_tokens":
            zero = F.lit(0)
            return F.coalesce(field("input_tokens"), zero) - F.coalesce(
                field("cached_input_tokens"), zero
            )
        return field(name)

    return _cost(CODEX_RATES, get)


def cost_estimate(costs: DataFrame, *by: str) -> DataFrame:
    """Means, extremes and saving of (baseline_usd, optimized_usd) rows."""
    delta = F.col("optimized_usd") - F.col("baseline_usd")
    out = costs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("runs"),
        F.avg("baseline_usd").alias("baseline_mean_usd"),
        F.avg("optimized_usd").alias("optimized_mean_usd"),
        F.avg(delta).alias("delta_mean_usd"),
        F.min(delta).alias("delta_min_usd"),
        F.max(delta).alias("delta_max_usd"),
    )
    base = F.nullif(F.col("baseline_mean_usd"), F.lit(0.0))
    return out.withColumn("savings_rate", -F.col("delta_mean_usd") / base)


def scaled_savings(estimates: DataFrame, *by: str) -> DataFrame:
    """Saving at each spend level."""
    levels = F.array(
        *[
            F.struct(F.lit(name).alias("level"), F.lit(float(usd)).alias("spend_usd"))
            for name, usd in SPEND_LEVELS
        ]
    )
    return estimates.select(*by, "savings_rate", F.inline(levels)).withColumn(
        "saving_usd", F.col("spend_usd") * F.col("savings_rate")
    )


def tool_use_counts(lines: DataFrame, *by: str, raw: str = "raw") -> DataFrame:
    """Tool uses by name in message content arrays."""
    schema = "message struct<content:string>"
    content = F.from_json(raw, schema)["message"]["content"]
    items = F.from_json(content, "array<struct<type:string,name:string>>")
    used = F.filter(items, lambda i: i["type"] == "tool_use")
    return (
        lines.select(*by, F.explode(used).alias("i"))
        .groupBy(*by, F.coalesce("i.name", F.lit("unknown")).alias("tool"))
        .agg(F.count(F.lit(1)).alias("uses"))
    )


def last_usage(events: DataFrame, pos: str, *by: str, event_type: str = "turn.completed") -> DataFrame:
    """Counters of the last completed turn of each run."""
    fields = ("input_tokens", "cached_input_tokens", "output_tokens", "reasoning_output_tokens")
    done = events.filter(F.col("type") == event_type)
    last = done.groupBy(*by).agg(F.max_by(F.struct(*fields), pos).alias("u"))
    zero = F.lit(0).cast("long")
    cols = {f: F.coalesce(F.col(f"u.{f}").cast("long"), zero) for f in fields}
    return last.select(
        *by,
        *[c.alias(f) for f, c in cols.items()],
        (cols["input_tokens"] - cols["cached_input_tokens"] + cols["output_tokens"]).alias(
            "total_uncached_plus_output_tokens"
        ),
    )


def occurrences(text: Column, literal: str) -> Column:
    """How often a literal occurs, not overlapping."""
    gone = F.length(text) - F.length(F.replace(text, F.lit(literal), F.lit("")))
    return F.floor(gone / len(literal)).cast("long")


def stderr_summary(text: Column) -> list[Column]:
    lines = F.filter(F.split(text, "\n"), lambda s: F.trim(s) != "")
    return [
        F.size(lines).cast("long").alias("line_count"),
        occurrences(text, "failed to load skill").alias("skill_load_errors"),
        (occurrences(text, "invalid_grant") + occurrences(text, "OAuth token refresh failed")).alias(
            "mcp_auth_errors"
        ),
        occurrences(text, "icon path must not contain").alias("icon_warnings"),
    ]


def publish_split(suites: DataFrame) -> DataFrame:
    """Promoted or diagnostic."""
    policy = F.coalesce("promotion_policy", F.lit(DEFAULT_POLICY))
    promoted = (
        F.col("quality_passed")
        & (F.col("completed_repeats") >= MIN_REPEATS)
        & (policy == DEFAULT_POLICY)
    )
    return suites.withColumns(
        {"promotion_policy": policy, "bucket": F.when(promoted, "repeated").otherwise("diagnostic")}
    )


def republish(published: DataFrame, fresh: DataFrame, key: str = "suite_id") -> DataFrame:
    """New entries replace or move old ones."""
    kept = published.join(fresh.select(key), key, "left_anti")
    return fresh.unionByName(kept)


def set_difference(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys on one side only, with the side."""
    tagged = left.select(key, F.lit(1).alias("_l"), F.lit(0).alias("_r")).unionByName(
        right.select(key, F.lit(0).alias("_l"), F.lit(1).alias("_r"))
    )
    sides = tagged.groupBy(key).agg(F.max("_l").alias("_l"), F.max("_r").alias("_r"))
    return sides.filter(F.col("_l") != F.col("_r")).select(
        key, F.when(F.col("_l") == 1, "left_only").otherwise("right_only").alias("side")
    )


def index_violations(index: DataFrame, files: DataFrame) -> DataFrame:
    """Indexed paths whose file is missing or differs."""
    found = files.select("path", F.col("sha256").alias("_actual"))
    joined = index.join(found, "path", "left")
    why = (
        F.when(F.coalesce("sha256", F.lit("")) == "", "missing sha256")
        .when(F.col("_actual").isNull(), "indexed file missing")
        .when(F.col("_actual") != F.col("sha256"), "sha256 mismatch")
    )
    return joined.select("path", why.alias("violation")).filter(F.col("violation").isNotNull())


def suite_violations(
    suites: DataFrame, public: DataFrame, artifacts: DataFrame
) -> DataFrame:
    """Disagreements between primary suites, public reports and artifact buckets.

    `suites` and `public` have suite_id, quality_passed, required_repeats,
    completed_repeats, promotion_policy; `artifacts` has suite_id, bucket.
    """
    fields = ("quality_passed", "required_repeats", "completed_repeats", "promotion_policy")
    p = public.select("suite_id", F.lit(True).alias("_public"), *[F.col(f).alias(f"_p_{f}") for f in fields])
    s = suites.select("suite_id", F.lit(True).alias("_suite"), *fields)
    buckets = artifacts.groupBy("suite_id").agg(
        F.max((F.col("bucket") == "repeated").cast("int")).alias("_rep"),
        F.max((F.col("bucket") == "diagnostic").cast("int")).alias("_dia"),
    )
    rows = s.join(p, "suite_id", "full_outer").join(buckets, "suite_id", "left").na.fill(
        0, ["_rep", "_dia"]
    )
    both = F.col("_suite").isNotNull() & F.col("_public").isNotNull()
    differs = lambda f: both & ~F.col(f).eqNullSafe(F.col(f"_p_{f}"))
    repeated, diagnostic = F.col("_rep") == 1, F.col("_dia") == 1
    passed = F.coalesce("_p_quality_passed", F.lit(False))
    enough = F.coalesce("_p_completed_repeats", F.lit(0)) >= MIN_REPEATS
    waiting = F.coalesce(F.col("promotion_policy").isin(*WAITING_POLICIES), F.lit(False))
    checks = [
        ("suite without public report", F.col("_public").isNull()),
        ("public report without suite", F.col("_suite").isNull()),
        *[(f"{f} mismatch", differs(f)) for f in fields],
        ("not in exactly one bucket", both & (repeated == diagnostic)),
        ("repeated but not passed", both & repeated & ~passed),
        ("repeated with fewer than 3 repeats", both & repeated & ~enough),
        ("diagnostic but promotable", both & diagnostic & passed & enough & ~waiting),
    ]
    found = F.array_compact(F.array(*[F.when(test, F.lit(why)) for why, test in checks]))
    return rows.select("suite_id", F.explode(found).alias("violation"))
