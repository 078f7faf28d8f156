"""Turns, events, requests and logs from the tables at hand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnwise.functions import text as X
from turnwise.functions import web as Wb
from turnwise.operators import blocks


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of texts for work that is heavy per row.

    A file of one row group is one task; where there are fewer files than cores, rows are dealt to
    all cores first.
    """
    df = table(spark, sf_dir, name)
    cores = spark.sparkContext.defaultParallelism
    return df if len(df.inputFiles()) >= cores else df.repartition(cores)


TOOL_TYPES = ("click", "view")


def turns_from_events(events: DataFrame, **kw) -> DataFrame:
    """A user's events as one session: dense turns, errors, tools, tokens from bytes."""
    numbered = blocks.dense_position(
        events.select("event_id", "ts", "user_id", "event_type", "value", "props"),
        "user_id", ["ts", "event_id"], **kw,
    )
    return numbered.select(
        F.col("user_id").alias("log_id"),
        (F.col("pos") + 1).alias("turn"),
        "pos",
        "event_id",
        "ts",
        "event_type",
        "props",
        F.col("event_type").isin(*TOOL_TYPES).alias("is_tool"),
        (F.col("event_type") == "error").alias("is_error"),
        F.floor(F.col("value") * 100).cast("long").alias("tokens"),
    )


def reads_from_events(turns: DataFrame) -> DataFrame:
    """Views as file reads; the property bag names the file."""
    return turns.filter(F.col("event_type") == "view").select(
        "log_id", "turn", F.concat(F.lit("file"), F.get_json_object("props", "$.k")).alias("file")
    )


def calls_from_events(turns: DataFrame) -> DataFrame:
    """The same session as normalized events."""
    zero = F.lit(0).cast("long")
    spent = F.col("tokens")
    return turns.select(
        "log_id",
        "pos",
        F.when(F.col("is_tool"), "tool_call")
        .when(F.col("event_type") == "purchase", "tool_result")
        .otherwise("message")
        .alias("kind"),
        F.when(F.col("is_tool"), F.col("event_type")).otherwise("").alias("tool"),
        F.when(F.col("is_tool"), X.short_hash(F.floor(F.col("pos") / 4).cast("string")))
        .otherwise("")
        .alias("args_hash"),
        F.lit("").alias("parent_hash"),
        spent.alias("tok_in"),
        F.floor(spent / 3).cast("long").alias("tok_cached"),
        F.when(F.col("event_type") == "signup", spent * 10).otherwise(zero).alias("tok_cache_new"),
        F.floor(spent / 5).cast("long").alias("tok_out"),
        F.octet_length("props").cast("long").alias("out_bytes"),
        zero.alias("patch_add"),
        zero.alias("patch_del"),
        F.col("is_error").alias("error"),
    )


def turns_from_conversations(conversations: DataFrame) -> DataFrame:
    text = F.col("text")
    return conversations.select(
        F.col("conv_id").alias("log_id"),
        (F.col("turn") + 1).alias("turn"),
        "role",
        "text",
        (F.col("role") == "tool").alias("is_tool"),
        X.looks_failed(text).alias("is_error"),
        X.token_estimate(text).alias("tokens"),
    )


def logs_from_documents(documents: DataFrame) -> DataFrame:
    return documents.select(
        F.col("doc_id").alias("log_id"),
        F.col("source").alias("source_id"),
        F.col("text").alias("content"),
        F.octet_length("text").cast("long").alias("size_bytes"),
    )


def requests_from_pages(pages: DataFrame) -> DataFrame:
    """Page URLs as requests."""
    path = Wb.url_part(F.col("url"), "PATH")
    host = Wb.clean_host(Wb.url_part(F.col("url"), "HOST"))
    return pages.select(
        "page_id", "url", path.alias("path"), host.alias("host"),
        (F.lit(200) + (F.col("page_id") % 4) * 100).cast("long").alias("status"),
        Wb.utm(F.col("url")).alias("utm"),
    )


def transcripts_from_events(events: DataFrame, source: str = "claude_code", **kw) -> DataFrame:
    """The events table written as agent transcript lines, one JSON object each.

    Views and clicks become tool uses, errors failed results, purchases results, sign-ups
    assistant messages with token counters.
    """
    turns = blocks.dense_position(
        events.select("event_id", "ts", "user_id", "event_type", "value", "props"),
        "user_id", ["ts", "event_id"], **kw,
    )
    k = F.get_json_object("props", "$.k")
    use = F.struct(
        F.lit("assistant").alias("type"),
        F.struct(
            F.array(
                F.struct(
                    F.lit("tool_use").alias("type"),
                    F.concat(F.lit("call-"), F.col("event_id").cast("string")).alias("id"),
                    F.col("event_type").alias("name"),
                    F.struct((k.cast("int") % 3).alias("k")).alias("input"),
                )
            ).alias("content")
        ).alias("message"),
    )
    result = F.struct(
        F.lit("user").alias("type"),
        F.struct(
            F.array(
                F.struct(
                    F.lit("tool_result").alias("type"),
                    F.concat(F.lit("call-"), F.col("event_id").cast("string")).alias("tool_use_id"),
                    (F.col("event_type") == "error").alias("is_error"),
                    F.concat(F.lit("output "), k).alias("content"),
                )
            ).alias("content")
        ).alias("message"),
    )
    usage = F.struct(
        F.lit("assistant").alias("type"),
        F.struct(
            F.struct(
                F.floor(F.col("value") * 1000).cast("long").alias("input_tokens"),
                F.floor(F.col("value") * 300).cast("long").alias("cache_read_input_tokens"),
                F.floor(F.col("value") * 200).cast("long").alias("cache_creation_input_tokens"),
                F.floor(F.col("value") * 10).cast("long").alias("output_tokens"),
            ).alias("usage")
        ).alias("message"),
    )
    raw = (
        F.when(F.col("event_type").isin("view", "click"), F.to_json(use))
        .when(F.col("event_type").isin("error", "purchase"), F.to_json(result))
        .otherwise(F.to_json(usage))
    )
    return turns.select(
        F.col("user_id").alias("log_id"),
        F.lit(source).alias("source_id"),
        (F.col("pos") + 1).alias("turn"),
        raw.alias("raw"),
    )
