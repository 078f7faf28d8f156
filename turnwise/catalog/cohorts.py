"""Cohort, usage, funnel and set queries (A19–A29, J, O, U, D26)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from turnwise.catalog import query
from turnwise.catalog.logs import scratch
from turnwise.catalog.scalars import EMAILS_SQL, FAMILY_ROWS, PATHS_SQL, SCRUB, emails, lst, paths, q, scrubbed
from turnwise.functions import web as Wb
from turnwise.operators import benchstats as Bs
from turnwise.operators import funnel as Fu
from turnwise.operators import selection as Sel
from turnwise.operators.ledger import SeenLedger
from turnwise.operators import tooling as T
from turnwise.operators import usage as U
from turnwise.plans import adapters as Ad
from turnwise.plans.production import production_report
from turnwise.registry import signatures as S

PRINTS = ("bmad", "openspec", "spec_kit", "kiro")


def retained(spark, sf):
    """The events table as retained report events."""
    e = F.col("event_id")
    fp = lambda name, every: F.when(e % every == 0, F.struct(F.lit(name).alias("id")))
    prints = F.array_compact(F.array(*[fp(n, i + 2) for i, n in enumerate(PRINTS)]))
    slot = F.struct(
        F.lit("retrieval").alias("class"),
        F.when(e % 3 == 0, "").otherwise("semble").alias("tool_id"),
        F.lit("absent").alias("reason"),
    )
    one = lambda test, value: F.when(test, F.array(F.lit(value)))
    return Ad.table(spark, sf, "events").select(
        "event_type",
        F.when(e % 7 == 0, "paid").otherwise("free").alias("scan_type"),
        F.concat((F.col("user_id") % 3 * 20).cast("string"), F.lit("_plus")).alias("score_bucket"),
        F.lit("10_20").alias("waste_bucket"),
        F.create_map(F.col("event_type"), F.lit("high")).alias("findings"),
        F.struct(
            F.when(e % 5 == 0, "").otherwise("macos").alias("operating_system"),
            F.col("event_type").alias("client"),
            F.lit("zsh").alias("shell"),
            one(e % 2 == 0, "npm").alias("package_managers"),
            prints.alias("workflow_fingerprints"),
            F.struct(
                F.struct(
                    F.lit("high").alias("warning_band"),
                    one(e % 2 == 1, "github").alias("known_server_ids"),
                    one(e % 10 == 1, "github").alias("unique_known_called_ids"),
                ).alias("mcp"),
                F.struct(
                    F.lit("normal").alias("warning_band"),
                    one(e % 4 == 1, "qa").alias("known_exposed_ids"),
                    one(e % 8 == 1, "qa").alias("known_executed_ids"),
                ).alias("skill"),
            ).alias("tooling_utilization"),
        ).alias("ecosystem"),
        F.struct(
            F.when(e % 2 == 0, slot).alias("primary"), F.when(e % 4 == 0, slot).alias("secondary")
        ).alias("recommendation"),
    )


def _cells() -> str:
    ev = "FROM events"
    rows = [
        ("scan_types", "CASE WHEN event_id % 7 = 0 THEN 'paid' ELSE 'free' END", ev),
        ("operating_systems", "CASE WHEN event_id % 5 = 0 THEN 'unknown' ELSE 'macos' END", ev),
        ("clients", "event_type", ev),
        ("shells", "'zsh'", ev),
        ("mcp_warning_bands", "'high'", ev),
        ("skill_warning_bands", "'normal'", ev),
        ("package_managers", "'npm'", ev + " WHERE event_id % 2 = 0"),
        ("mcp_configured", "'github'", ev + " WHERE event_id % 2 = 1"),
        ("mcp_executed", "'github'", ev + " WHERE event_id % 10 = 1"),
        ("skill_exposed", "'qa'", ev + " WHERE event_id % 4 = 1"),
        ("skill_executed", "'qa'", ev + " WHERE event_id % 8 = 1"),
        ("findings", "event_type || '|high'", ev),
    ]
    for every in (2, 4):
        where = f"{ev} WHERE event_id % {every} = 0"
        rows += [
            ("recommendation_classes", "'retrieval'", where),
            ("recommendation_reasons", "'absent'", where),
            ("recommendation_tools", "'semble'", where + " AND event_id % 3 <> 0"),
        ]
    for i, name in enumerate(PRINTS):
        where = f"{ev} WHERE event_id % {i + 2} = 0"
        rows += [
            ("sdd_tools", q(name), where),
            ("score_buckets_by_sdd_tool", f"{q(name + '|')} || (user_id % 3 * 20) || '_plus'", where),
            ("waste_buckets_by_sdd_tool", q(name + "|10_20"), where),
        ]
    for i, a in enumerate(PRINTS):
        for j, b in enumerate(PRINTS):
            if a < b:
                rows.append(("sdd_cooccurrence", q(a + "+" + b), f"{ev} WHERE event_id % {i + 2} = 0 AND event_id % {j + 2} = 0"))
    return " UNION ALL ".join(f"SELECT '{d}' AS dimension, CAST({k} AS VARCHAR) AS key {src}" for d, k, src in rows)


CELLS = f"cells AS (SELECT dimension, key, count(*) AS count FROM ({_cells()}) GROUP BY ALL)"


@query("a19_cohort_summary", f"WITH {CELLS} SELECT * FROM cells")
def _(spark, sf):
    return U.count_entries(retained(spark, sf), U.retained_entries())


@query("a20_suppressed_cohorts", f"WITH {CELLS} SELECT * FROM cells WHERE count >= 200")
def _(spark, sf):
    return U.cohort_summary(retained(spark, sf), 200)[0]


@query("a20_suppressed_cells", f"WITH {CELLS} SELECT CAST(sum(CASE WHEN count < 200 THEN 1 ELSE 0 END) AS BIGINT) AS suppressed FROM cells")
def _(spark, sf):
    return U.cohort_summary(retained(spark, sf), 200)[1]


@query("j15_cooccurring_tools", f"WITH {CELLS} SELECT key, count FROM cells WHERE dimension = 'sdd_cooccurrence'")
def _(spark, sf):
    ids = F.col("ecosystem.workflow_fingerprints.id")
    rows = retained(spark, sf).select(F.explode(U.pair_keys(ids)).alias("key"))
    return rows.groupBy("key").agg(F.count(F.lit(1)).alias("count"))


@query("j15_frequent_pairs", "WITH x AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) SELECT a.l_suppkey AS left, b.l_suppkey AS right, count(*) AS count FROM x a JOIN x b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey < b.l_suppkey GROUP BY ALL HAVING count(*) >= 20")
def _(spark, sf):
    """Suppliers that deliver to the same orders, twenty at least."""
    rows = Ad.table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_suppkey").alias("ids"))
    return U.frequent_pairs(rows, "l_orderkey", "ids", 20)


def requests(spark, sf):
    """Events as requests: the path of a known prefix, a status, a client."""
    ev = Ad.table(spark, sf, "events")
    e = F.col("event_id")
    return ev.select(
        F.col("ts").alias("timestamp"),
        F.concat(F.lit("/api/jobs/"), (F.col("user_id") % 6).cast("string")).alias("_raw"),
        (F.lit(200) + e % 4 * 100).alias("status"),
        F.when(e % 5 == 0, "").otherwise("GET").alias("method"),
        F.when(e % 6 == 0, "").otherwise(F.sha2(F.col("user_id").cast("string"), 256)).alias("client_hash"),
        F.when(e % 3 == 0, "").otherwise(F.concat(F.lit("h"), (e % 7).cast("string"))).alias("referrer_host"),
        (e % 10 == 0).alias("bot"),
        F.when(e % 4 == 0, F.create_map(F.lit("utm_source"), F.concat(F.lit("s"), (e % 3).cast("string")))).alias("utm"),
    ).withColumn("path", F.when(F.col("status") == 500, F.concat(F.lit(Wb.CTA_PREFIX), F.col("method"))).otherwise(Wb.path_template(F.col("_raw")))).drop("_raw")


REQ = """req AS (SELECT ts, 200 + event_id % 4 * 100 AS status, CASE WHEN event_id % 5 = 0 THEN '' ELSE 'GET' END AS method, CASE WHEN event_id % 6 = 0 THEN '' ELSE sha256(CAST(user_id AS VARCHAR)) END AS client_hash,
 CASE WHEN event_id % 3 = 0 THEN '' ELSE 'h' || event_id % 7 END AS referrer, event_id % 10 = 0 AS bot, CASE WHEN event_id % 4 = 0 THEN 's' || event_id % 3 END AS utm_source, event_id % 4 = 0 AS has_utm,
 CASE WHEN event_id % 4 = 3 THEN '/api/analytics/cta-copy/' || CASE WHEN event_id % 5 = 0 THEN '' ELSE 'GET' END ELSE '/api/jobs/:id' END AS path FROM events)"""
KLASS = "CASE WHEN status >= 500 THEN 'server_error' WHEN status >= 400 THEN 'client_error' WHEN status >= 300 THEN 'redirect' ELSE 'success' END"


def _dims(pairs) -> str:
    return " UNION ALL ".join(
        f"SELECT '{d}' AS dimension, coalesce(nullif({k}, ''), 'unknown') AS key, count(*) AS count FROM req {w} GROUP BY 2" for d, k, w in pairs
    )


BASE_DIMS = [
    ("path", "path", ""), ("method", "method", ""), ("status", "CAST(status AS VARCHAR)", ""), ("requests", KLASS, ""),
    ("daily", "strftime(ts, '%Y-%m-%d')", ""), ("referrer_host", "referrer", ""), ("utm_source", "utm_source", "WHERE has_utm"),
    ("utm_campaign", "''", "WHERE has_utm"),
]


@query("a21_usage_counters", f"WITH {REQ} {_dims(BASE_DIMS)}")
def _(spark, sf):
    return U.usage_counters(requests(spark, sf))


@query("a21_usage_totals", f"WITH {REQ} SELECT count(*) AS event_count, count(DISTINCT nullif(client_hash, '')) AS unique_clients FROM req")
def _(spark, sf):
    return U.usage_totals(requests(spark, sf))


FUNNEL_DIMS = [d if d[0] != "referrer_host" else ("referrer_host", "referrer", "WHERE referrer <> ''") for d in BASE_DIMS] + [
    ("cta_copy", "regexp_extract(path, '[^/]*$')", "WHERE starts_with(path, '/api/analytics/cta-copy/')"),
    ("bot", "'bot'", "WHERE bot"),
]


@query("a22_funnel_usage", f"WITH {REQ}, c AS ({_dims(FUNNEL_DIMS)}) SELECT dimension, key, count, rank FROM (SELECT *, row_number() OVER (PARTITION BY dimension ORDER BY count DESC, key) AS rank FROM c) WHERE rank <= 8")
def _(spark, sf):
    rows = requests(spark, sf)
    return U.top_k(U.count_entries(rows, U.funnel_entries(rows.columns)), 8)


@query("o01_sorted_counts", f"SELECT template AS key, count(*) AS count FROM (SELECT regexp_extract(path, '^/[^/]*') AS template FROM {PATHS_SQL}) GROUP BY 1")
def _(spark, sf):
    rows = paths(spark, sf).groupBy(F.regexp_extract("path", "^/[^/]*", 0).alias("key")).agg(F.count(F.lit(1)).alias("count"))
    return rows.orderBy(F.desc("count"), "key")


@query(
    "o02_top_k",
    "SELECT dimension, key, count, rank FROM (SELECT CAST(user_id AS VARCHAR) AS dimension, event_type AS key, count(*) AS count, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) AS rank FROM events GROUP BY user_id, event_type) WHERE rank <= 3",
)
def _(spark, sf):
    entries = F.array(U.entry("x", F.col("event_type")).withField("dimension", F.col("user_id").cast("string")))
    return U.top_k(U.count_entries(Ad.table(spark, sf, "events"), entries), 3)


@query(
    "o03_largest_first",
    "SELECT doc_id, size_bytes, (SELECT count(*) FROM documents WHERE strlen(text) > 20000) AS skipped FROM (SELECT doc_id, strlen(text) AS size_bytes FROM documents) WHERE size_bytes <= 20000 ORDER BY size_bytes DESC, doc_id LIMIT 20",
)
def _(spark, sf):
    logs = Ad.logs_from_documents(Ad.table(spark, sf, "documents"))
    kept, skipped = Sel.largest_first(logs, "size_bytes", "log_id", 20000, 20)
    return kept.select(F.col("log_id").alias("doc_id"), "size_bytes", skipped.select("skipped_too_large").scalar().alias("skipped"))


@query("o04_target_sized_selection")
def _(spark, sf):
    from turnwise.catalog.sessions import order_logs

    rows = order_logs(spark, sf)
    return Sel.target_sized(rows.withColumn("source_id", F.col("grp")))


# Funnel ---------------------------------------------------------------------------------------

PRODUCT_SQL = "(SELECT doc_id, source, lang, CASE WHEN doc_id % 4 = 0 THEN [] WHEN doc_id % 4 = 1 THEN [sha256(lang || doc_id % 50), sha256(text)] ELSE [sha256(text), sha256(source)] END AS hashes FROM documents)"
SEEN = f"""p AS {PRODUCT_SQL}, refs AS (SELECT DISTINCT doc_id, unnest(hashes) AS hash FROM p), firsts AS (SELECT hash, min(doc_id) AS doc_id FROM refs GROUP BY hash),
 w AS (SELECT p.doc_id, source, lang, (SELECT count(*) FROM refs r WHERE r.doc_id = p.doc_id) AS refs, CASE WHEN len(hashes) = 0 THEN 1 ELSE (SELECT count(*) FROM firsts f WHERE f.doc_id = p.doc_id) END AS weight FROM p)"""


def product(spark, sf):
    h = lambda c: F.sha2(c, 256)
    d = F.col("doc_id")
    bucket = F.concat("lang", (d % 50).cast("string"))
    hashes = (
        F.when(d % 4 == 0, F.array(F.lit("not a hash")))
        .when(d % 4 == 1, F.array(F.upper(h(bucket)), h(F.col("text")), h(F.col("text"))))
        .otherwise(F.array(h(F.col("text")), h(F.col("source"))))
    )
    return Ad.table(spark, sf, "documents").select("doc_id", "source", "lang", hashes.alias("hashes"))


@query("a23_product_totals", f"WITH {SEEN} SELECT CAST(sum(weight) AS BIGINT) AS total_report_events, count(*) AS raw_report_events, count(*) FILTER (refs > 0) AS events_with_hashes, count(*) FILTER (refs = 0) AS events_without_hashes, CAST(sum(refs) AS BIGINT) AS hash_refs, (SELECT count(*) FROM firsts) AS unique_hashes, CAST(sum(refs) - (SELECT count(*) FROM firsts) AS BIGINT) AS duplicate_refs FROM w")
def _(spark, sf):
    return Fu.product_totals(Fu.event_weights(product(spark, sf), "hashes", "doc_id", "doc_id"))


@query("a23_product_counters", f"WITH {SEEN} SELECT dimension, key, CAST(sum(weight) AS BIGINT) AS count FROM (SELECT 'client' AS dimension, source AS key, weight FROM w UNION ALL SELECT 'lang', lang, weight FROM w) WHERE weight > 0 GROUP BY ALL")
def _(spark, sf):
    weighted = Fu.event_weights(product(spark, sf), "hashes", "doc_id", "doc_id")
    return Fu.product_counters(weighted, F.array(U.entry("client", F.col("source")), U.entry("lang", F.col("lang"))))


@query("a24_event_hashes", f"WITH {SEEN} SELECT doc_id, hash FROM refs")
def _(spark, sf):
    return Fu.event_hashes(product(spark, sf), "hashes", "doc_id")


@query("w07_first_seen", f"WITH {SEEN} SELECT hash, doc_id FROM firsts")
def _(spark, sf):
    refs = Fu.event_hashes(product(spark, sf), "hashes", "doc_id")
    return Fu.first_seen(refs, "hash", "doc_id")


LEDGER_DAYS = ("de", "en", "es", "fr")


@query("a23_ledger_days", f"""WITH p AS (SELECT coalesce(list_position(['de', 'en', 'es', 'fr'], lang), 0) AS day, * FROM {PRODUCT_SQL}), refs AS (SELECT DISTINCT day, doc_id, unnest(hashes) AS hash FROM p),
 firsts AS (SELECT hash, arg_min(day, (day, doc_id)) AS day, arg_min(doc_id, (day, doc_id)) AS doc_id FROM refs GROUP BY hash)
 SELECT p.doc_id, CAST(p.day AS BIGINT) AS day, (SELECT count(*) FROM refs r WHERE r.doc_id = p.doc_id) AS hash_refs, CASE WHEN len(hashes) = 0 THEN 1 ELSE (SELECT count(*) FROM firsts f WHERE f.doc_id = p.doc_id) END AS weight FROM p""")
def _(spark, sf):
    """Languages arrive one after the other; each run asks the ledger, never the events of earlier days."""
    path = scratch(spark, "ledger")
    ledger = SeenLedger(spark, f"seen_{path.rsplit('-', 1)[1]}", path, int(spark.conf.get("spark.sql.shuffle.partitions")))
    events = product(spark, sf)
    known = F.coalesce(F.array_position(F.array(*map(F.lit, LEDGER_DAYS)), F.col("lang")), F.lit(0)).cast("long")
    out = None
    for day in range(len(LEDGER_DAYS) + 1):
        of_day = events.withColumn("day", known).filter(F.col("day") == day)
        rows = ledger.weigh(of_day, "hashes", "doc_id", dt.date(2024, 1, 1) + dt.timedelta(day))
        rows = rows.select("doc_id", "day", "hash_refs", "weight")
        out = rows if out is None else out.unionByName(rows)
    return out


def unlocks(spark, sf):
    ev = Ad.table(spark, sf, "events")
    e = F.col("event_id")
    return ev.select(
        F.concat(F.lit(" User"), F.col("user_id").cast("string"), F.lit("@"), F.when(F.col("user_id") % 4 == 0, "Own.example").otherwise("mail.example")).alias("email"),
        F.when(e % 9 == 0, "").otherwise(F.col("event_type")).alias("status"),
        (e % 50 == 0).alias("marketing_opt_in"),
        F.col("ts").alias("created_at"),
        e.alias("pos"),
    )


MAIL = "'user' || user_id || '@' || CASE WHEN user_id % 4 = 0 THEN 'own.example' ELSE 'mail.example' END"
PROFILES = f"""prof AS (SELECT {MAIL} AS email, min(ts) AS first_seen, count(*) AS records, bool_or(event_id % 50 = 0) AS opt_in, arg_max(CASE WHEN event_id % 9 = 0 THEN 'unknown' ELSE event_type END, ts) AS status FROM events GROUP BY 1)"""


@query("a25_unlock_profiles", f"WITH {PROFILES} SELECT email, strftime(first_seen, '%Y-%m-%d %H:%M:%S') AS first_seen, records, opt_in, status FROM prof")
def _(spark, sf):
    rows = Fu.unlock_profiles(unlocks(spark, sf))
    return rows.select("email", F.date_format("first_seen_at", "yyyy-MM-dd HH:mm:ss").alias("first_seen"), "records", F.col("marketing_opt_in").alias("opt_in"), "status")


TYPE_CASE = ("bounce", "send_failure", "delivery", "send", "rendering_failure", "complaint")


def deliveries(spark, sf):
    ev = Ad.table(spark, sf, "events")
    u, e = F.col("user_id"), F.col("event_id")
    kinds = F.array(*[F.lit(t) for t in TYPE_CASE])
    i = F.when(e % 97 == 0, u % 6).otherwise(F.when(u % 2 == 0, 2).otherwise(3))
    return ev.select(
        u.alias("email_hash"),
        F.element_at(kinds, (i + 1).cast("int")).alias("type"),
        F.when(e % 97 == 0, F.when(u % 12 == 1, "recipient_rejected").otherwise("soft")).alias("detail"),
        F.col("event_id").cast("string").alias("message_id"),
        F.col("ts").alias("created_at"),
        e.alias("pos"),
    )


DELIV = f"""del AS (SELECT user_id AS email_hash, [{lst(TYPE_CASE)}][CASE WHEN event_id % 97 = 0 THEN user_id % 6 WHEN user_id % 2 = 0 THEN 2 ELSE 3 END + 1] AS type,
 CASE WHEN event_id % 97 = 0 THEN CASE WHEN user_id % 12 = 1 THEN 'recipient_rejected' ELSE 'soft' END END AS detail, event_id AS pos, ts FROM events)"""
SUPP = """supp AS (SELECT email_hash, arg_max(type, pos) AS reason, count(*) FILTER (type = 'bounce') AS bounce_count, count(*) FILTER (type = 'complaint') AS complaint_count, count(*) FILTER (type = 'reject') AS reject_count, CAST(max(pos) AS VARCHAR) AS last_message_id, arg_min(ts, pos) AS suppressed_at, arg_max(ts, pos) AS updated_at FROM del WHERE type IN ('bounce', 'complaint', 'reject') GROUP BY email_hash)"""


@query("a27_suppressions", f"WITH {DELIV}, {SUPP} SELECT email_hash, reason, bounce_count, complaint_count, reject_count, last_message_id, strftime(suppressed_at, '%Y-%m-%d') AS suppressed_on, strftime(updated_at, '%Y-%m-%d') AS updated_on FROM supp")
def _(spark, sf):
    rows = Fu.suppressions(deliveries(spark, sf), "email_hash", "created_at", "pos")
    day = lambda c, n: F.date_format(c, "yyyy-MM-dd").alias(n)
    return rows.drop("suppressed_at", "updated_at").join(
        rows.select("email_hash", day("suppressed_at", "suppressed_on"), day("updated_at", "updated_on")), "email_hash"
    )


STATUS = f"""st AS (SELECT a.email_hash, CASE WHEN s.reason IS NOT NULL AND a.email_hash % 3 = 0 THEN 'suppressed' WHEN nb > 0 THEN 'provider_rejected' WHEN nf > 0 AND coalesce(nullif(ld, ''), fd) = 'recipient_rejected' THEN 'provider_rejected' WHEN nf > 0 OR nr > 0 THEN 'delivery_failed' WHEN nd > 0 THEN 'delivered' WHEN ns > 0 THEN 'sent' ELSE 'no_delivery_signal' END AS delivery_status
 FROM (SELECT email_hash, count(*) FILTER (type IN ('bounce', 'complaint', 'reject')) AS nb, count(*) FILTER (type = 'send_failure') AS nf, count(*) FILTER (type = 'rendering_failure') AS nr, count(*) FILTER (type = 'delivery') AS nd, count(*) FILTER (type = 'send') AS ns, arg_max(coalesce(detail, ''), pos) AS ld, coalesce(arg_min(nullif(detail, ''), pos) FILTER (nullif(detail, '') IS NOT NULL), '') AS fd FROM del GROUP BY email_hash) a LEFT JOIN supp s USING (email_hash))"""


@query("a26_delivery_status", f"WITH {DELIV}, {SUPP}, {STATUS} SELECT email_hash, delivery_status, delivery_status IN ('delivered', 'sent', 'no_delivery_signal') AS delivery_usable FROM st")
def _(spark, sf):
    rows = deliveries(spark, sf)
    supp = Fu.suppressions(rows, "email_hash", "created_at", "pos").filter(F.col("email_hash") % 3 == 0)
    counts = Fu.delivery_counts(rows, "email_hash", "created_at", "pos")
    out = Fu.delivery_status(rows.select("email_hash").distinct(), counts, supp, "email_hash")
    return out.select("email_hash", "delivery_status", "delivery_usable")


@query("j08_email_delivery", f"WITH {DELIV}, {SUPP}, e AS (SELECT DISTINCT user_id FROM events) SELECT user_id, count(type) AS events, any_value(reason) AS reason FROM e LEFT JOIN del ON user_id = del.email_hash AND type <> 'send' LEFT JOIN supp ON user_id = supp.email_hash GROUP BY user_id")
def _(spark, sf):
    rows = deliveries(spark, sf)
    supp = Fu.suppressions(rows, "email_hash", "created_at", "pos").select("email_hash", "reason")
    some = rows.filter(F.col("type") != "send").groupBy("email_hash").agg(F.count(F.lit(1)).alias("events"))
    people = rows.select("email_hash").distinct()
    joined = people.join(some, "email_hash", "left").join(supp, "email_hash", "left")
    return joined.select(F.col("email_hash").alias("user_id"), F.coalesce("events", F.lit(0)).cast("long").alias("events"), "reason")


MASK = "email[1] || '***' || regexp_extract(email, '(.)@', 1) || regexp_extract(email, '@.*')"


@query("j09_new_emails", f"WITH {PROFILES}, prev AS (SELECT DISTINCT CASE WHEN user_id % 2 = 0 THEN {MAIL} ELSE {MASK.replace('email', '(' + MAIL + ')')} END AS label FROM events WHERE user_id % 5 = 0) SELECT email, NOT (email IN (SELECT label FROM prev) OR {MASK} IN (SELECT label FROM prev)) AS is_new FROM prof")
def _(spark, sf):
    profiles = Fu.unlock_profiles(unlocks(spark, sf))
    email = Wb.normalize_email(F.col("email"))
    previous = unlocks(spark, sf).withColumn("u", F.regexp_extract("email", r"(\d+)@", 1).cast("long")).filter(F.col("u") % 5 == 0)
    labels = previous.select(F.when(F.col("u") % 2 == 0, email).otherwise(Wb.mask_email(F.col("email"))).alias("label"))
    return Fu.split_new(profiles, labels).select("email", "is_new")


def feeds(spark, sf):
    day = lambda c: F.date_format(c, "yyyy-MM-dd").alias("day")
    n = F.count(F.lit(1)).alias("count")
    ev = Ad.table(spark, sf, "events")
    return {
        "errors": ev.filter("event_type = 'error'").groupBy(day("ts")).agg(n),
        "clicks": ev.filter("event_type = 'click'").groupBy(day("ts")).agg(n),
        "orders": Ad.table(spark, sf, "orders").groupBy(day("o_orderdate")).agg(n),
    }


FEEDS = "f AS (SELECT CASE event_type WHEN 'error' THEN 'errors' ELSE 'clicks' END AS feed, strftime(ts, '%Y-%m-%d') AS day FROM events WHERE event_type IN ('error', 'click') UNION ALL SELECT 'orders', strftime(o_orderdate, '%Y-%m-%d') FROM orders)"


@query("j10_daily_spine", f"WITH {FEEDS} SELECT day, count(*) FILTER (feed = 'errors') AS errors, count(*) FILTER (feed = 'clicks') AS clicks, count(*) FILTER (feed = 'orders') AS orders FROM f GROUP BY day")
def _(spark, sf):
    return Fu.daily_spine(feeds(spark, sf))


@query("a28_coverage", f"WITH {FEEDS} SELECT feed, min(day) AS first_day, max(day) AS last_day, count(*) AS total FROM f GROUP BY feed")
def _(spark, sf):
    return Fu.coverage(feeds(spark, sf))


@query("u03_day_union", f"WITH {FEEDS} SELECT DISTINCT day FROM f")
def _(spark, sf):
    return Fu.daily_spine(feeds(spark, sf)).select("day")


@query("a29_unique_emails", f"SELECT email AS email, min(doc_id) AS first_pos FROM {EMAILS_SQL} GROUP BY email")
def _(spark, sf):
    return Fu.unique_in_order(emails(spark, sf), "email", "doc_id")


@query("u07_first_seen_order", "SELECT event_type, min(event_id) AS first_pos FROM events GROUP BY event_type")
def _(spark, sf):
    return Fu.unique_in_order(Ad.table(spark, sf, "events"), "event_type", "event_id")


@query("d26_production_daily", f"""WITH {DELIV}, {SUPP}, {STATUS.replace("AND a.email_hash % 3 = 0 ", "")}, {SEEN}, {PROFILES}, np AS (SELECT prof.*, CAST(regexp_extract(email, 'user([0-9]+)@', 1) AS BIGINT) AS u FROM prof WHERE NOT contains(email, 'own.example')),
 f2 AS (SELECT hash, arg_min(doc_id, (doc_id % 20) * 1000000000 + doc_id) AS doc_id FROM refs GROUP BY hash), w2 AS (SELECT p.doc_id, CASE WHEN len(hashes) = 0 THEN 1 ELSE (SELECT count(*) FROM f2 WHERE f2.doc_id = p.doc_id) END AS weight FROM p),
 d AS (SELECT strftime(first_seen, '%Y-%m-%d') AS day, 'new_emails' AS feed, 1 AS n FROM np
  UNION ALL SELECT strftime(first_seen, '%Y-%m-%d'), CASE WHEN delivery_status IN ('delivered', 'sent', 'no_delivery_signal') THEN 'new_usable_emails' ELSE 'new_rejected_emails' END, 1 FROM np JOIN st ON u = email_hash
  UNION ALL SELECT strftime(ts, '%Y-%m-%d'), 'website_requests', 1 FROM events UNION ALL SELECT '2024-01-' || lpad(CAST(doc_id % 20 + 1 AS VARCHAR), 2, '0'), 'product_events', weight FROM w2 WHERE weight > 0
  UNION ALL SELECT strftime(ts, '%Y-%m-%d'), 'email_unlocks', 1 FROM events WHERE user_id % 4 <> 0 UNION ALL SELECT strftime(ts, '%Y-%m-%d'), 'delivery_events', 1 FROM events)
 SELECT day, {', '.join(f"CAST(coalesce(sum(n) FILTER (feed = '{c}'), 0) AS BIGINT) AS {c}" for c in ('new_emails', 'new_usable_emails', 'new_rejected_emails', 'website_requests', 'product_events', 'email_unlocks', 'delivery_events'))} FROM d GROUP BY day""")
def _(spark, sf):
    rows = product(spark, sf)
    day = F.concat(F.lit("2024-01-"), F.lpad((F.col("doc_id") % 20 + 1).cast("string"), 2, "0"))
    prod = rows.select(F.col("doc_id").alias("event_key"), day.alias("object_date"), "hashes")
    hashed = lambda df: df.withColumn("email_hash", Wb.hash_email(_address(F.col("email_hash"))))
    mails = deliveries(spark, sf)
    supp = Fu.suppressions(mails, "email_hash", "created_at", "pos").select("email_hash", "reason")
    report = production_report(
        requests(spark, sf), prod, unlocks(spark, sf), hashed(mails), hashed(supp),
        own_domains=["own.example"], new_since=F.lit("2000-01-01").cast("timestamp_ntz"),
    )
    return report["daily"]


def _address(user):
    domain = F.when(user % 4 == 0, "own.example").otherwise("mail.example")
    return F.concat(F.lit("user"), user.cast("string"), F.lit("@"), domain)


# Joins and set operations -------------------------------------------------------------------------


@query("j01_known_names", f"SELECT known, count(*) AS n FROM (SELECT replace(lower(p_name), ' ', '_') IN ('blue_bolt', 'red_widget', 'small_ring') AS known FROM part) GROUP BY known")
def _(spark, sf):
    names = Ad.table(spark, sf, "part").select(F.replace("p_name", F.lit(" "), F.lit("-")).alias("name"))
    allowed = spark.createDataFrame([("blue_bolt",), ("red_widget",), ("small_ring",)], "id string")
    known, unknown = T.split_known(names, allowed, "name")
    n = F.count(F.lit(1)).alias("n")
    return known.agg(n).select(F.lit(True).alias("known"), "n").unionByName(unknown.agg(n).select(F.lit(False).alias("known"), "n")).filter("n > 0")


@query("j14_index_integrity", "SELECT CAST(doc_id AS VARCHAR) AS path, CASE WHEN doc_id % 6 = 0 THEN 'missing sha256' WHEN doc_id % 7 = 0 THEN 'indexed file missing' ELSE 'sha256 mismatch' END AS violation FROM documents WHERE doc_id % 6 = 0 OR doc_id % 7 = 0 OR doc_id % 11 = 0")
def _(spark, sf):
    docs = Ad.table(spark, sf, "documents")
    d = F.col("doc_id")
    sha = F.sha2("text", 256)
    index = docs.select(d.cast("string").alias("path"), F.when(d % 6 == 0, "").when(d % 11 == 0, "x").otherwise(sha).alias("sha256"))
    files = docs.filter(d % 7 != 0).select(d.cast("string").alias("path"), sha.alias("sha256"))
    return Bs.index_violations(index, files)


@query("u01_set_union", f"SELECT DISTINCT source AS grp, 'package_manager' AS category, id FROM documents JOIN (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'npm' WHEN 1 THEN 'uv' ELSE lang END AS id FROM documents) USING (doc_id)")
def _(spark, sf):
    from turnwise.operators.merge import union_ids

    d = F.col("doc_id")
    ids = F.array(F.when(d % 3 == 0, "npm").when(d % 3 == 1, "uv").otherwise(F.col("lang")), F.lit(""))
    rows = Ad.table(spark, sf, "documents").select(F.col("source").alias("grp"), F.lit("package_manager").alias("category"), F.explode(ids).alias("id"))
    return union_ids(rows, "grp")


@query("u02_union_all", "SELECT kind, count(*) AS n FROM (SELECT 'doc' AS kind FROM documents UNION ALL SELECT 'page' FROM pages UNION ALL SELECT 'turn' FROM conversations) GROUP BY kind")
def _(spark, sf):
    one = lambda t, k: Ad.table(spark, sf, t).select(F.lit(k).alias("kind"))
    rows = one("documents", "doc").unionByName(one("pages", "page")).unionByName(one("conversations", "turn"))
    return rows.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("u04_set_difference", "SELECT doc_id, CASE WHEN l IS NULL THEN 'right_only' ELSE 'left_only' END AS side FROM (SELECT doc_id, 1 AS l FROM labels) FULL JOIN (SELECT doc_id, 1 AS r FROM documents WHERE doc_id % 3 <> 0) USING (doc_id) WHERE l IS NULL OR r IS NULL")
def _(spark, sf):
    docs = Ad.table(spark, sf, "documents").filter(F.col("doc_id") % 3 != 0)
    return Bs.set_difference(Ad.table(spark, sf, "labels"), docs, "doc_id")


@query("u05_exactly_one", "SELECT doc_id FROM labels WHERE (quality = 1) <> (toxic = 1)")
def _(spark, sf):
    labels = Ad.table(spark, sf, "labels")
    return Bs.set_difference(labels.filter("quality = 1"), labels.filter("toxic = 1"), "doc_id").select("doc_id")


@query("u06_republish", "SELECT doc_id, 'fresh' AS state FROM labels UNION ALL SELECT doc_id, 'old' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _(spark, sf):
    old = Ad.table(spark, sf, "documents").select("doc_id", F.lit("old").alias("state"))
    fresh = Ad.table(spark, sf, "labels").select("doc_id", F.lit("fresh").alias("state"))
    return Bs.republish(old, fresh, "doc_id")


@query("a09_merged_redactions", SCRUB + f"SELECT source, family, CAST(sum(n) AS BIGINT) AS count FROM ({FAMILY_ROWS}) WHERE n > 0 GROUP BY ALL")
def _(spark, sf):
    from turnwise.operators.merge import sum_families

    return sum_families(scrubbed(spark, sf).select("source", F.inline("redactions")), "source")


@query("a09_first_labels", "SELECT lang, coalesce(arg_min(label, doc_id) FILTER (label <> ''), '') AS label FROM (SELECT lang, doc_id, CASE WHEN doc_id % 3 = 0 THEN '' ELSE source END AS label FROM documents) GROUP BY lang")
def _(spark, sf):
    from turnwise.operators.merge import first_label

    rows = Ad.table(spark, sf, "documents").withColumn("label", F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("source")))
    return rows.groupBy("lang").agg(first_label("label", "doc_id").alias("label"))


@query("s20_newest_first", "SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01' ORDER BY o_orderdate DESC, o_orderkey LIMIT 100")
def _(spark, sf):
    rows = U.in_window(Ad.table(spark, sf, "orders"), "o_orderdate", "1997-01-01")
    return Sel.newest_first(rows, "o_orderdate", "o_orderkey", 100).select("o_orderkey")


@query("s22_retention", "SELECT kind, count(*) AS expired FROM (SELECT CASE WHEN o_orderstatus = 'P' THEN 'uploads' WHEN o_orderstatus = 'F' THEN 'reports' ELSE 'kept' END AS kind, o_orderdate FROM orders) WHERE (kind = 'uploads' AND TIMESTAMP '1999-01-01' - o_orderdate > INTERVAL 365 DAY) OR (kind = 'reports' AND TIMESTAMP '1999-01-01' - o_orderdate > INTERVAL 730 DAY) GROUP BY kind")
def _(spark, sf):
    s = F.col("o_orderstatus")
    files = Ad.table(spark, sf, "orders").select(F.when(s == "P", "uploads").when(s == "F", "reports").otherwise("kept").alias("kind"), "o_orderdate")
    old = Sel.expired(files, "kind", "o_orderdate", "1999-01-01 00:00:00", {"uploads": 365 * 86400, "reports": 730 * 86400, "kept": 0})
    return old.groupBy("kind").agg(F.count(F.lit(1)).alias("expired"))
