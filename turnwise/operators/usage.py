"""Long counters over feeds, suppression, top-k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnwise.functions.web import CTA_PREFIX
from turnwise.session import cut_lineage


def _text_or_unknown(value: Column) -> Column:
    return F.coalesce(F.nullif(value.cast("string"), F.lit("")), F.lit("unknown"))


def entry(dimension: str, key: Column) -> Column:
    return F.struct(F.lit(dimension).alias("dimension"), _text_or_unknown(key).alias("key"))


def entries_of(dimension: str, keys: Column) -> Column:
    """Entries of an array column; a NULL array has none."""
    keys = F.coalesce(keys, F.array().cast("array<string>"))
    return F.transform(keys, lambda k: entry(dimension, k))


def count_entries(
    rows: DataFrame, entries: Column, *by: str, weight: Column | None = None
) -> DataFrame:
    """Count (dimension, key) entries of all rows in one grouping.

    Counts are combined before the shuffle, so a key that holds most of the rows sends
    one partial row per task.
    """
    weight = F.lit(1) if weight is None else weight
    long = rows.select(*by, weight.cast("long").alias("_w"), F.inline(entries))
    return long.groupBy(*by, "dimension", "key").agg(F.sum("_w").cast("long").alias("count"))


def suppress(counts: DataFrame, minimum: int, *by: str) -> DataFrame:
    """Cells of at least `minimum`."""
    return counts.filter(F.col("count") >= max(1, minimum))


def suppressed_cells(counts: DataFrame, minimum: int, *by: str) -> DataFrame:
    return counts.groupBy(*by).agg(
        F.sum((F.col("count") < max(1, minimum)).cast("long")).alias("suppressed")
    )


def top_k(counts: DataFrame, k: int, by: str = "dimension") -> DataFrame:
    """The k largest keys of each dimension; ties by key.

    The rank limit is applied before the shuffle as well as after it.
    """
    order = Window.partitionBy(by).orderBy(F.desc("count"), F.asc("key"))
    return counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).withColumn(
        "rank", F.col("rank").cast("long")
    )


def in_window(rows: DataFrame, ts: str, since=None, until=None) -> DataFrame:
    """Both ends included, a missing end is open."""
    if since is not None:
        rows = rows.filter(F.col(ts) >= F.lit(since).cast("timestamp_ntz"))
    if until is not None:
        rows = rows.filter(F.col(ts) <= F.lit(until).cast("timestamp_ntz"))
    return rows


DEFAULT_DAYS, MAX_DAYS = 7, 90
DEFAULT_LIMIT, MAX_LIMIT = 20_000, 100_000


def lookback_seconds(since: str | None = None, days: str | None = None) -> int:
    """Window length in seconds from a duration like `36h` or a number of days."""
    seconds = DEFAULT_DAYS * 86400
    if since:
        units = {"s": 1, "m": 60, "h": 3600}
        try:
            seconds = int(float(since[:-1]) * units[since[-1]])
        except (KeyError, ValueError) as err:
            raise ValueError("since must be a duration between 1ns and 90d") from err
        if not 0 < seconds <= MAX_DAYS * 86400:
            raise ValueError("since must be a duration between 1ns and 90d")
    if days:
        if not days.isdigit() or not 0 < int(days) <= MAX_DAYS:
            raise ValueError("days must be between 1 and 90")
        seconds = int(days) * 86400
    return seconds


def row_limit(raw: str | None) -> int:
    if not raw or not raw.strip().lstrip("-").isdigit() or int(raw) <= 0:
        return DEFAULT_LIMIT
    return min(int(raw), MAX_LIMIT)


def status_class(status: Column) -> Column:
    return (
        F.when(status >= 500, "server_error")
        .when(status >= 400, "client_error")
        .when(status >= 300, "redirect")
        .otherwise("success")
    )


# dimension, column
REQUEST_DIMENSIONS = (
    ("path", "path"),
    ("method", "method"),
    ("status", "status"),
    ("auth_surface", "auth_surface"),
    ("user_agent", "user_agent"),
    ("browser", "browser"),
    ("operating_system", "operating_system"),
    ("device_class", "device_class"),
    ("language", "language"),
    ("region", "region"),
    ("referrer_host", "referrer_host"),
    ("client_ip_prefix", "client_ip_prefix"),
)


def request_entries(columns) -> Column:
    """All counters of a request that the frame has columns for."""
    have = set(columns)
    parts = [entry(d, F.col(c)) for d, c in REQUEST_DIMENSIONS if c in have]
    if "status" in have:
        parts.append(entry("requests", status_class(F.col("status"))))
    if "timestamp" in have:
        parts.append(entry("daily", F.date_format("timestamp", "yyyy-MM-dd")))
    fixed = F.array(*parts)
    if "utm" not in have:
        return fixed
    campaign = F.when(
        F.col("utm").isNotNull(),
        F.array(
            entry("utm_source", F.try_element_at("utm", F.lit("utm_source"))),
            entry("utm_campaign", F.try_element_at("utm", F.lit("utm_campaign"))),
        ),
    ).otherwise(F.array().cast("array<struct<dimension:string,key:string>>"))
    return F.concat(fixed, campaign)


def usage_counters(events: DataFrame) -> DataFrame:
    return count_entries(events, request_entries(events.columns))


def usage_totals(events: DataFrame, approximate: bool = False) -> DataFrame:
    """Event count and distinct clients; the empty hash is nobody."""
    client = F.nullif(F.col("client_hash"), F.lit(""))
    distinct = F.approx_count_distinct(client) if approximate else F.count_distinct(client)
    return events.agg(F.count(F.lit(1)).alias("event_count"), distinct.alias("unique_clients"))


def funnel_entries(columns) -> Column:
    """Report variant (A22): bots and call-to-action copies, known referrers only."""
    base = request_entries(columns)
    extra = []
    if "path" in columns:
        copy = F.when(
            F.col("path").startswith(CTA_PREFIX),
            F.array(entry("cta_copy", F.substring_index("path", "/", -1))),
        )
        extra.append(F.coalesce(copy, F.array().cast("array<struct<dimension:string,key:string>>")))
    if "bot" in columns:
        bot = F.when(F.col("bot"), F.array(entry("bot", F.lit("bot"))))
        extra.append(F.coalesce(bot, F.array().cast("array<struct<dimension:string,key:string>>")))
    every = F.concat(base, *extra) if extra else base
    return F.filter(
        every,
        lambda e: ~((e["dimension"].isin("referrer_host", "utm_source")) & (e["key"] == "unknown")),
    )


def retained_entries() -> Column:
    """The 19 counters of a retained event (A19), fields as in the retained schema."""
    eco, rec = F.col("ecosystem"), F.col("recommendation")
    mcp, skill = eco["tooling_utilization"]["mcp"], eco["tooling_utilization"]["skill"]
    prints = F.filter(
        F.coalesce(
            eco["workflow_fingerprints"]["id"], F.array().cast("array<string>")
        ),
        lambda i: i != "",
    )
    single = F.array(
        entry("scan_types", F.col("scan_type")),
        entry("operating_systems", eco["operating_system"]),
        entry("clients", eco["client"]),
        entry("shells", eco["shell"]),
        entry("mcp_warning_bands", mcp["warning_band"]),
        entry("skill_warning_bands", skill["warning_band"]),
    )

    def slot(s):
        rows = F.array(
            entry("recommendation_classes", s["class"]),
            entry("recommendation_reasons", s["reason"]),
        )
        tool = F.when(F.coalesce(s["tool_id"], F.lit("")) != "", F.array(entry("recommendation_tools", s["tool_id"])))
        none = F.array().cast("array<struct<dimension:string,key:string>>")
        return F.when(s.isNotNull(), F.concat(rows, F.coalesce(tool, none))).otherwise(none)

    findings = F.transform(
        F.map_entries(F.coalesce("findings", F.create_map().cast("map<string,string>"))),
        lambda e: F.concat_ws("|", e["key"], e["value"]),
    )
    return F.concat(
        single,
        entries_of("package_managers", eco["package_managers"]),
        entries_of("sdd_tools", prints),
        entries_of("score_buckets_by_sdd_tool", F.transform(prints, lambda i: F.concat_ws("|", i, F.col("score_bucket")))),
        entries_of("waste_buckets_by_sdd_tool", F.transform(prints, lambda i: F.concat_ws("|", i, F.col("waste_bucket")))),
        entries_of("sdd_cooccurrence", pair_keys(prints)),
        entries_of("mcp_configured", mcp["known_server_ids"]),
        entries_of("mcp_executed", mcp["unique_known_called_ids"]),
        entries_of("skill_exposed", skill["known_exposed_ids"]),
        entries_of("skill_executed", skill["known_executed_ids"]),
        slot(rec["primary"]),
        slot(rec["secondary"]),
        entries_of("findings", findings),
    )


def pair_keys(ids: Column) -> Column:
    """`a+b` for every two positions i < j of a sorted list.

    The list is the fingerprints of one event, whose ids come from the closed detector
    registry.
    """
    ordered = F.sort_array(ids)
    return F.flatten(
        F.transform(
            ordered,
            lambda left, i: F.transform(
                F.slice(ordered, i + 2, F.greatest(F.size(ordered) - i - 1, F.lit(0))),
                lambda right: F.concat_ws("+", left, right),
            ),
        )
    )


#: Ids of a row that are expanded into pairs at once.
PAIR_SIDE = 256
#: Ids or pairs that one task of `frequent_pairs` holds, about.
PAIR_ROWS = 1 << 19


def frequent_pairs(rows: DataFrame, row: str, ids: str, minimum: int, side: int = PAIR_SIDE) -> DataFrame:
    """(left, right, count): ids that occur together in at least `minimum` rows (J15 under A20).

    A pair cannot be in more rows than either of its ids, so ids below `minimum` go before any
    pair is made. Rows with few ids are light: their pairs are made where they are. Heavy rows are
    cut into blocks of `side` ids, and every two blocks are a row of their own, dealt to all
    tasks. There are as many tasks as ids and pairs need at `PAIR_ROWS` each, so a task's memory does not
    grow with the table; both are counted when this is called. A task sends a pair once for each of its
    few buckets. `rows` has one row for each value of `row` and an array column `ids`.
    """
    minimum = max(1, minimum)
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = lambda n: max(least, -(-int(n or 0) // PAIR_ROWS))
    long = rows.select(row, F.explode(F.array_distinct(ids)).alias("_i")).filter("_i IS NOT NULL")
    often = long.groupBy("_i").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= minimum)
    often = cut_lineage(often)
    kept = long.join(often.select("_i"), "_i", "left_semi").repartition(tasks(often.agg(F.sum("_n")).first()[0]), row)
    lists = cut_lineage(kept.groupBy(row).agg(F.sort_array(F.collect_list("_i")).alias("_l")).filter(F.size("_l") > 1))
    size = F.size("_l").cast("long")
    parts = tasks(lists.agg(F.sum(size * (size - 1) / 2)).first()[0])
    bucket = lambda *key: F.pmod(F.xxhash64(*key), F.lit(16 * parts)).alias("_k")
    light = lists.filter(F.size("_l") <= side).select(bucket(row), F.col("_l").alias("_a"))
    last = F.ceil(F.size("_l") / side).cast("int") - 1
    heavy = lists.filter(F.size("_l") > side).select("*", F.explode(F.sequence(F.lit(0), last)).alias("_x"))
    heavy = heavy.select("*", F.explode(F.sequence(F.col("_x"), last)).alias("_y"))
    block = lambda c: F.slice("_l", F.col(c) * side + 1, F.lit(side))
    heavy = heavy.select(bucket(row, "_x", "_y"), block("_x").alias("_a"), block("_y").alias("_b"))
    both = light.unionByName(heavy, allowMissingColumns=True).repartition(parts, "_k")
    pairs = both.select("_k", F.explode("_a").alias("left"), F.coalesce("_b", "_a").alias("_b")).select(
        "_k", "left", F.explode(F.filter("_b", lambda r: r > F.col("left"))).alias("right")
    )
    # rows lie by bucket already, so these counts need no exchange
    own = pairs.groupBy("_k", "left", "right").agg(F.count(F.lit(1)).alias("_n"))
    counts = own.select("left", "right", "_n").repartition(parts, "left", "right").groupBy("left", "right")
    return counts.agg(F.sum("_n").alias("count")).filter(F.col("count") >= minimum)


def cohort_summary(events: DataFrame, minimum: int = 10) -> tuple[DataFrame, DataFrame]:
    """(kept cells, number of suppressed cells) of a retained-event feed."""
    counts = count_entries(events, retained_entries())
    return suppress(counts, minimum), suppressed_cells(counts, minimum)
