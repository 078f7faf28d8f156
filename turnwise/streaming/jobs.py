"""Streaming jobs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from turnwise.functions import web as Wb
from turnwise.functions.json_nodes import settled
from turnwise.operators import usage as U
from turnwise.session import cut_lineage
from turnwise.sources import splits

# Provider event names and ours.
MAIL_TYPES = {
    "send": "send",
    "delivery": "delivery",
    "bounce": "bounce",
    "complaint": "complaint",
    "reject": "reject",
    "renderingfailure": "rendering_failure",
    "rendering_failure": "rendering_failure",
    "deliverydelay": "delivery_delay",
    "delivery_delay": "delivery_delay",
}
ENVELOPE = "Type string, Message string"
MAIL_EVENT = (
    "eventType string, mail struct<timestamp:string,messageId:string,destination:array<string>>, "
    "bounce struct<bounceType:string,bouncedRecipients:array<struct<emailAddress:string>>>, "
    "complaint struct<complaintFeedbackType:string,"
    "complainedRecipients:array<struct<emailAddress:string>>>"
)


def parse_mail_events(messages: DataFrame, body: str = "value") -> DataFrame:
    """Delivery events of enveloped messages, one per recipient (T02); works on both batch
    and streams. Unusable messages give one row with a reject reason."""
    outer = F.from_json(body, ENVELOPE)
    rows = settled(messages, {"_o": outer})
    rows = settled(rows, {"_m": F.from_json(F.col("_o.Message"), MAIL_EVENT)})
    raw_type = F.lower(F.trim(F.coalesce("_m.eventType", F.lit(""))))
    names = F.create_map(*[F.lit(x) for pair in MAIL_TYPES.items() for x in pair])
    rows = rows.withColumn("type", F.try_element_at(names, raw_type))
    to = (
        F.when(F.col("type") == "bounce", F.col("_m.bounce.bouncedRecipients.emailAddress"))
        .when(F.col("type") == "complaint", F.col("_m.complaint.complainedRecipients.emailAddress"))
        .otherwise(F.col("_m.mail.destination"))
    )
    clean = F.filter(
        F.transform(F.coalesce(to, F.array().cast("array<string>")), Wb.normalize_email),
        lambda e: e != "",
    )
    why = (
        F.when(F.lower(F.coalesce("_o.Type", F.lit(""))) != "notification", "unsupported envelope")
        .when(F.col("type").isNull(), "unsupported event type")
        .when(F.size(clean) == 0, "no recipients")
    )
    detail = F.substring(
        F.lower(
            F.trim(
                F.when(F.col("type") == "bounce", F.col("_m.bounce.bounceType"))
                .when(F.col("type") == "complaint", F.col("_m.complaint.complaintFeedbackType"))
                .otherwise("")
            )
        ),
        1,
        64,
    )
    people = F.when(why.isNull(), clean).otherwise(F.array(F.lit(None).cast("string")))
    return rows.withColumn("reject", why).select(
        F.explode(people).alias("_email"),
        "type",
        F.coalesce(detail, F.lit("")).alias("detail"),
        F.col("_m.mail.messageId").alias("message_id"),
        F.coalesce(
            F.try_to_timestamp(F.col("_m.mail.timestamp")), F.current_timestamp()
        ).alias("created_at"),
        "reject",
    ).select(
        F.when(F.col("_email").isNotNull(), F.sha2("_email", 256)).alias("email_hash"),
        "type", "detail", "message_id", "created_at", "reject",
    )


SUPPRESSION_SCHEMA = (
    "email_hash string, reason string, bounce_count long, complaint_count long, "
    "reject_count long, last_message_id string, suppressed_at timestamp, updated_at timestamp"
)


class SuppressionState(StatefulProcessor):
    """Counters and first and last time of each suppressed address."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._state = handle.getValueState(
            "suppression",
            "bounce long, complaint long, reject long, suppressed_at timestamp",
        )

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues):
        # Chunk by chunk: an address may have any number of rows in a batch.
        state = self._state.get()
        counts = dict(zip(("bounce", "complaint", "reject"), state[:3] if state else (0, 0, 0)))
        first = state[3] if state else None
        last = None
        for chunk in rows:
            for kind, n in chunk["type"].value_counts().items():
                counts[kind] += int(n)
            if state is None:
                low = chunk["created_at"].min()
                first = low if first is None else min(first, low)
            newest = chunk.loc[chunk["created_at"].idxmax()]
            if last is None or newest["created_at"] >= last["created_at"]:
                last = newest
        first = pd.Timestamp(first).to_pydatetime()
        self._state.update((counts["bounce"], counts["complaint"], counts["reject"], first))
        yield pd.DataFrame(
            {
                "email_hash": [key[0]],
                "reason": [last["type"]],
                "bounce_count": [counts["bounce"]],
                "complaint_count": [counts["complaint"]],
                "reject_count": [counts["reject"]],
                "last_message_id": [last["message_id"]],
                "suppressed_at": [first],
                "updated_at": [last["created_at"]],
            }
        )

    def close(self) -> None:
        pass


def suppression_stream(
    events: DataFrame, once: bool = False, ts: str = "created_at", watermark: str = "7 days"
) -> DataFrame:
    """Latest suppression row per address and batch. Every arrival counts.

    With `once`, a message that is delivered again within the watermark does not.
    """
    bad = events.filter(
        F.col("reject").isNull() & F.col("type").isin("bounce", "complaint", "reject")
    )
    if once:
        bad = bad.withWatermark(ts, watermark).dropDuplicatesWithinWatermark(["message_id", "email_hash", "type"])
    return bad.groupBy("email_hash").transformWithStateInPandas(
        SuppressionState(), SUPPRESSION_SCHEMA, "Update", "None"
    )


def usage_stream(events: DataFrame, watermark: str = "1 day") -> DataFrame:
    """Daily counters over a usage stream (T04); the watermark bounds the state."""
    rows = events.withWatermark("timestamp", watermark)
    long = rows.select("timestamp", F.inline(U.request_entries(set(rows.columns) - {"timestamp"})))
    return (
        long.groupBy(F.window("timestamp", "1 day").alias("day"), "dimension", "key")
        .agg(F.count(F.lit(1)).alias("count"))
        .select(F.col("day.start").alias("day"), "dimension", "key", "count")
    )


def usage_batches(out: str, delay: str = "1 day", ts: str = "timestamp") -> Callable[[DataFrame, int], None]:
    """Handler for `foreachBatch` that counts rows in time and keeps late ones apart.

    A row is late if its time lies more than `delay` before the newest time of all batches before
    its own. Under `out`, `counts` has the partial counters of each batch, `late` its late rows,
    `marks` its newest time; a batch that runs again after a failure replaces its own folders.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        mark = None
        if batch_id:
            marks = spark.read.schema("batch long, newest timestamp").parquet(f"{out}/marks")
            mark = marks.filter(F.col("batch") < batch_id).agg(F.max("newest")).first()[0]
        limit = F.lit(mark) - F.expr(f"INTERVAL {delay}")
        late = F.lit(False) if mark is None else F.coalesce(F.col(ts) < limit, F.lit(False))
        rows = cut_lineage(batch.withColumn("_late", late))
        rows.filter("_late").drop("_late").write.mode("overwrite").parquet(f"{out}/late/batch={batch_id}")
        timely = rows.filter("NOT _late").select(
            F.to_date(ts).alias("day"), F.inline(U.request_entries(set(batch.columns) - {ts}))
        )
        counts = timely.groupBy("day", "dimension", "key").agg(F.count(F.lit(1)).alias("count"))
        counts.write.mode("overwrite").parquet(f"{out}/counts/batch={batch_id}")
        newest = rows.agg(F.lit(batch_id).cast("long").alias("batch"), F.max(ts).alias("newest"))
        newest.write.mode("overwrite").parquet(f"{out}/marks/part={batch_id}")

    return handle


class OpenRequests(StatefulProcessor):
    """Results whose request is open (T05): one state per (log, request id) with a TTL."""

    def __init__(self, ttl_ms: int | None = None):
        self._ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        if self._ttl_ms:
            self._open = handle.getValueState("open", "open boolean", self._ttl_ms)
        else:
            self._open = handle.getValueState("open", "open boolean")

    def handleInputRows(self, key, rows, timerValues):
        batch = pd.concat(list(rows)).sort_values(["turn", "seq"], kind="stable")
        state = self._open.get()
        is_open = bool(state[0]) if state else False
        keep = []
        for kind in batch["kind"]:
            keep.append(kind == "tool_call" or is_open)
            is_open = kind == "tool_call"
        self._open.update((is_open,))
        yield batch[keep]

    def close(self) -> None:
        pass


def matched_stream(events: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """Tool calls and the results that answer an open one, as J02 does in batch.

    With a time to live the state of a request is dropped after it. Such a query has timers
    and does not end under an available-now trigger.
    """
    columns = ["log_id", "request_id", "turn", "seq", "kind"]
    rows = events.select(*columns)
    return rows.groupBy("log_id", "request_id").transformWithStateInPandas(
        OpenRequests(ttl_ms), rows.schema, "Update", "ProcessingTime" if ttl_ms else "None"
    )


def new_hashes(events: DataFrame, ts: str, watermark: str = "7 days") -> DataFrame:
    """The first row of each content hash (T06); the watermark on `ts` bounds the state."""
    return events.withWatermark(ts, watermark).dropDuplicatesWithinWatermark(["hash"])


RUN_SCHEMA = "log_id long, pos long, run long, longest long"


class RetryRun(StatefulProcessor):
    """Running identical-retry depth of a log (T07): last call, its failure, the run."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._state = handle.getValueState(
            "run", "tool string, args string, parent string, failed boolean, run long, longest long"
        )

    def handleInputRows(self, key, rows, timerValues):
        batch = pd.concat(list(rows)).sort_values("pos", kind="stable")
        state = self._state.get()
        tool, args, parent, failed, run, longest = state or ("", "", "", False, 0, 0)
        columns = ("kind", "tool", "args_hash", "parent_hash", "error")
        for kind, t, a, p, err in zip(*[batch[c] for c in columns]):
            if kind == "tool_call":
                same = tool != "" and tool == t and args != "" and args == a
                same = same and (parent == "" or p == "" or parent == p)
                run = run + 1 if same and failed else 0
                longest = max(longest, run)
                tool, args, parent, failed = t, a, p, bool(err)
            elif err and tool != "":
                failed = True
        self._state.update((tool, args, parent, bool(failed), int(run), int(longest)))
        yield pd.DataFrame(
            {"log_id": [key[0]], "pos": [int(batch["pos"].iloc[-1])], "run": [run], "longest": [longest]}
        )

    def close(self) -> None:
        pass


def retry_stream(events: DataFrame) -> DataFrame:
    return events.groupBy("log_id").transformWithStateInPandas(
        RetryRun(), RUN_SCHEMA, "Update", "None"
    )


def intake(
    spark: SparkSession,
    path: str,
    checkpoint: str,
    handle: Callable[[DataFrame, int], None],
    glob: str = "*.jsonl",
):
    """Analyze files as they arrive (T01): each batch of whole files goes through `handle`.

    Session folds need the whole log, and a log is one row, so a batch is complete. For logs that
    may be larger than a row should be, `intake_lines` reads the same files in byte ranges.
    """
    logs = (
        spark.readStream.format("text")
        .option("wholetext", True)
        .option("pathGlobFilter", glob)
        .schema("value string")
        .load(path)
        .select(
            F.col("value").alias("content"),
            F.col("_metadata.file_path").alias("path"),
            F.col("_metadata.file_modification_time").alias("mod_time"),
        )
        .withColumn("log_id", F.substring(F.sha2("path", 256), 1, 16))
    )
    return (
        logs.writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def intake_lines(
    spark: SparkSession,
    path: str,
    checkpoint: str,
    handle: Callable[[DataFrame, int], None],
    glob: str = "*.jsonl",
):
    """Like `intake`, for logs of any size: `handle` gets the lines of whole files as `splits.log_lines` reads them."""
    lines = splits.lines_from(spark.readStream, path, glob)
    return (
        lines.writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
