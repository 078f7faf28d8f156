"""Signature candidates from registry, package, repository JSON and free text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnwise.functions import text as X
from turnwise.functions.json_nodes import settled

# Text patterns that show a server or skill name, and names that never are one.
TEXT_RULES = (
    ("mcp_servers", r"mcp__([A-Za-z0-9_-]{2,})__", ""),
    ("mcp_servers", r"(?i)\bclaude\s+mcp\s+add\s+([A-Za-z0-9_-]{2,})\b", ""),
    ("skills", r"(?i)\.claude/(?:skills|commands)/([A-Za-z0-9_-]{2,})", ""),
    ("skills", r"""(?i)(?:^|[\s"'(:])/([A-Za-z][A-Za-z0-9_-]{2,})\b""", "/"),
)
COMMON_NAMES = (
    "users", "home", "tmp", "var", "usr", "src", "api", "docs", "help", "login", "logout",
)


def candidate_id(value: Column) -> Column:
    """Lower-case snake id without the usual package prefixes and suffixes; '' if unusable."""
    v = F.lower(F.trim(value))
    for prefix in ("^@", "^mcp-server-", "^mcp_"):
        v = F.regexp_replace(v, prefix, "")
    for suffix in ("-mcp-server$", "_mcp_server$", "-mcp$", "_mcp$"):
        v = F.regexp_replace(v, suffix, "")
    v = F.regexp_replace(F.replace(v, F.lit("@"), F.lit("")), "[^a-z0-9]+", "_")
    v = F.regexp_replace(v, "^_+|_+$", "")
    return F.when((F.length(v) < 2) | (F.length(v) > 80), "").otherwise(v)


def last_segment(value: Column) -> Column:
    v = F.trim(value)
    path = F.regexp_replace(F.coalesce(F.try_parse_url(v, F.lit("PATH")), F.lit("")), "^/+|/+$", "")
    own = F.when(F.try_parse_url(v, F.lit("HOST")).isNotNull(), path).otherwise(v)
    return F.substring_index(own, "/", -1)


def mcp_id(by_name: Column, by_title: Column) -> Column:
    """The id of the title, else of the name; generic words do not count."""
    options = (by_title, by_name)
    return F.coalesce(
        *[F.when(~o.isin("", "mcp", "server"), o) for o in options], F.lit("")
    )


def id_pattern(candidate: Column) -> Column:
    return F.replace(candidate, F.lit("_"), F.lit("[-_]"))


def suggested_patterns(category: Column, candidate: Column, labels: Column) -> Column:
    """Sorted patterns that would show a candidate in a log."""
    p = id_pattern(candidate)
    word = lambda x: F.concat(F.lit(r"(?i)\b"), x, F.lit(r"\b"))
    base = (
        F.when(
            category == "mcp_servers",
            F.array(
                F.concat(F.lit(r"(?i)\bmcp__"), p, F.lit("__")),
                F.concat(F.lit(r"(?i)\bclaude\s+mcp\s+add\s+"), p, F.lit(r"\b")),
            ),
        )
        .when(
            category == "skills",
            F.array(
                F.concat(F.lit(r"(?i)(^|\s)/"), p, F.lit(r"\b")),
                F.concat(F.lit(r"(?i)\.claude/(skills|commands)/"), p, F.lit(r"\b")),
            ),
        )
        .otherwise(F.array(word(p)))
    )
    others = F.filter(F.transform(labels, candidate_id), lambda i: (i != "") & (i != candidate))
    return F.sort_array(F.array_distinct(F.concat(base, F.transform(others, lambda i: word(id_pattern(i))))))


CANDIDATE = ("source_id", "url", "page", "category", "id", "label", "evidence", "labels")


def _text_entries(text: Column) -> Column:
    parts = []
    for category, pattern, mark in TEXT_RULES:
        found = F.regexp_extract_all(text, F.lit(X.ascii_edges(pattern)), F.lit(1))
        parts.append(F.transform(found, _named(category, mark)))
    return F.filter(
        F.concat(*parts),
        lambda e: (e["id"] != "") & ~((e["mark"] == "/") & e["id"].isin(*COMMON_NAMES)),
    )


def _named(category: str, mark: str):
    return lambda m: F.struct(
        F.lit(category).alias("category"),
        candidate_id(m).alias("id"),
        F.concat(F.lit(mark), m).alias("label"),
        F.lit(mark).alias("mark"),
        m.alias("raw"),
    )


def from_text(pages: DataFrame, text: str = "body") -> DataFrame:
    """Candidates in free text; `pages` has source_id, url, page and the text."""
    rows = pages.select("source_id", "url", "page", F.explode(_text_entries(F.col(text))).alias("e"))
    return rows.select(
        "source_id", "url", "page", "e.category", "e.id", "e.label",
        F.lit(1).cast("long").alias("evidence"), F.array("e.raw").alias("labels"),
    )


def from_mcp_registry(pages: DataFrame, body: str = "body") -> DataFrame:
    """Servers, their packages and their descriptions in registry JSON."""
    schema = (
        "servers array<struct<server:struct<name:string,title:string,description:string,"
        "repository:struct<url:string>,packages:array<struct<registry:string,name:string>>>>>"
    )
    keep = ["source_id", "url", "page", "category"]
    items = pages.select(
        *keep, F.explode(F.from_json(body, schema)["servers"]["server"]).alias("s")
    )
    e = lambda c: F.coalesce(c, F.lit(""))
    items = settled(items, {"_name": e(F.col("s.name")), "_title": e(F.col("s.title"))})
    name, title = F.col("_name"), F.col("_title")
    items = settled(
        items,
        {"_by_title": candidate_id(last_segment(title)), "_by_name": candidate_id(last_segment(name))},
    )
    servers = items.select(
        *keep,
        mcp_id(F.col("_by_name"), F.col("_by_title")).alias("id"),
        F.coalesce(F.nullif(title, F.lit("")), name).alias("label"),
        F.lit(2).cast("long").alias("evidence"),
    ).withColumn("labels", F.array("label"))
    packages = items.select(*keep, F.explode("s.packages.name").alias("label")).select(
        *keep, candidate_id(F.col("label")).alias("id"), "label",
        F.lit(1).cast("long").alias("evidence"), F.array("label").alias("labels"),
    )
    texts = items.select(
        "source_id", "url", "page",
        F.concat_ws(" ", name, title, e(F.col("s.description")), e(F.col("s.repository.url"))).alias("body"),
    )
    found = servers.unionByName(packages).filter(F.col("id") != "")
    return found.select(*CANDIDATE).unionByName(from_text(texts).select(*CANDIDATE))


def from_npm_search(pages: DataFrame, body: str = "body") -> DataFrame:
    schema = "objects array<struct<package:struct<name:string,description:string,keywords:array<string>>>>"
    rows = pages.select(
        "source_id", "url", "page", "category",
        F.explode(F.from_json(body, schema)["objects"]["package"]).alias("p"),
    )
    about = F.concat_ws(" ", "p.name", "p.description", F.array_join("p.keywords", " "))
    return (
        rows.filter(X.looks_relevant(about))
        .select(
            "source_id", "url", "page", "category",
            candidate_id(F.col("p.name")).alias("id"),
            F.col("p.name").alias("label"),
            F.lit(2).cast("long").alias("evidence"),
            F.array("p.name").alias("labels"),
        )
        .filter(F.col("id") != "")
        .select(*CANDIDATE)
    )


def from_repositories(pages: DataFrame, body: str = "body") -> DataFrame:
    schema = "items array<struct<name:string,full_name:string,description:string,topics:array<string>>>"
    rows = pages.select(
        "source_id", "url", "page", "category",
        F.explode(F.from_json(body, schema)["items"]).alias("r"),
    ).withColumn(
        "about",
        F.concat_ws(" ", "r.name", "r.full_name", "r.description", F.array_join("r.topics", " ")),
    ).filter(X.looks_relevant(F.col("about")))
    named = rows.select(
        "source_id", "url", "page", "category",
        candidate_id(F.col("r.name")).alias("id"),
        F.coalesce(F.nullif(F.col("r.full_name"), F.lit("")), F.col("r.name")).alias("label"),
        F.lit(1).cast("long").alias("evidence"),
        F.array("r.name", "r.full_name").alias("labels"),
    ).filter(F.col("id") != "")
    texts = rows.select("source_id", "url", "page", F.col("about").alias("body"))
    return named.select(*CANDIDATE).unionByName(from_text(texts).select(*CANDIDATE))


def from_sources(pages: DataFrame) -> DataFrame:
    """Candidates of all source kinds; unreadable JSON is read as text."""
    kinds = ("mcp_registry", "npm_search", "github_search_repositories")
    structured = F.col("kind").isin(*kinds) & F.try_parse_json("body").isNotNull()
    readers = dict(zip(kinds, (from_mcp_registry, from_npm_search, from_repositories)))
    out = from_text(pages.filter(~structured)).select(*CANDIDATE)
    for kind, read in readers.items():
        out = out.unionByName(read(pages.filter(structured & (F.col("kind") == kind))))
    return out


def rank_candidates(found: DataFrame) -> DataFrame:
    """Evidence, sources and confidence per (category, id).

    The label is that of the first page. Per-source counts come first, so a name that
    occurs on most pages is folded before the shuffle.
    """
    per_source = found.groupBy("category", "id", "source_id").agg(
        F.sum("evidence").alias("_e"),
        F.min_by("label", "page").alias("_label"),
        F.min("page").alias("_page"),
    )
    total = per_source.groupBy("category", "id").agg(
        F.sum("_e").cast("long").alias("evidence_count"),
        F.count(F.lit(1)).alias("source_count"),
        F.min_by("_label", "_page").alias("label"),
    )
    e, s = F.col("evidence_count"), F.col("source_count")
    return total.withColumn(
        "confidence",
        F.when((e >= 8) & (s >= 2), "high").when((e >= 3) | (s >= 2), "medium").otherwise("low"),
    )


def pattern_rows(found: DataFrame) -> DataFrame:
    """Distinct (category, id, pattern) suggestions."""
    patterns = suggested_patterns(F.col("category"), F.col("id"), F.col("labels"))
    return found.select("category", "id", F.explode(patterns).alias("pattern")).distinct()


def ordered(candidates: DataFrame) -> DataFrame:
    """Category, then most evidence, then id."""
    return candidates.orderBy("category", F.desc("evidence_count"), "id")
