"""Event feeds and sinks: retained events, usage events, exported tables, indexes."""

from __future__ import annotations

import ctypes
import functools
import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import RDD
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STRINGS = "array<string>"
SLOT = (
    "struct<class:string,tool_id:string,reason:string,signals:array<string>,"
    "risk_level:string,install_policy:string>"
)
RETAINED_SCHEMA = (
    "schema_version string, event string, analyzer_version string, scan_type string, "
    "parser_type string, input_size_bucket string, turn_bucket string, "
    "session_count_bucket string, score_bucket string, waste_bucket string, "
    "analyzed_log_hashes array<struct<source_id:string,content_hash_sha256:string,"
    "size_bucket:string>>, findings map<string,string>, redactions map<string,int>, "
    "ecosystem struct<client:string,operating_system:string,shell:string,"
    f"version_control:string,coding_agents:{STRINGS},workflow_frameworks:{STRINGS},"
    f"mcp_servers_known:{STRINGS},known_skills:{STRINGS},known_plugins:{STRINGS},"
    f"package_managers:{STRINGS},unknown_mcp_server_count:int,unknown_skill_count:int,"
    "unknown_plugin_count:int,workflow_fingerprints:array<struct<id:string,"
    f"confidence:string,sources:{STRINGS},evidence_count:int,active:boolean,"
    "installed:boolean,version_bucket:string>>,tooling_utilization:struct<mcp:struct<"
    f"known_server_ids:{STRINGS},unknown_server_count:int,server_count_bucket:string,"
    "exposed_tool_count_bucket:string,context_token_bucket:string,exposure_known:boolean,"
    "inference_source:string,call_count_bucket:string,known_call_count_bucket:string,"
    f"unknown_call_count_bucket:string,unique_known_called_ids:{STRINGS},"
    "unique_unknown_called_count:int,utilization_ratio_bucket:string,"
    "context_efficiency_bucket:string,warning_band:string>,skill:struct<"
    f"known_exposed_ids:{STRINGS},unknown_exposed_count:int,exposed_count_bucket:string,"
    "context_token_bucket:string,exposure_known:boolean,inference_source:string,"
    f"executed_count_bucket:string,known_executed_ids:{STRINGS},"
    "unknown_executed_count:int,utilization_ratio_bucket:string,"
    "context_efficiency_bucket:string,warning_band:string>>>, "
    f"recommendation struct<primary:{SLOT},secondary:{SLOT},signals:{STRINGS},"
    "skipped_count_bucket:string>"
)
USAGE_SCHEMA = (
    "timestamp timestamp, status int, duration_ms bigint, request_bytes bigint, "
    "response_bytes bigint, authenticated boolean, bot boolean, referrer_internal boolean, "
    "utm map<string,string>, method string, path string, host string, scheme string, "
    "auth_surface string, client_hash string, client_ip_version string, "
    "client_ip_prefix string, user_agent string, browser string, browser_major string, "
    "operating_system string, os_major string, device_class string, accept_language string, "
    "language string, region string, referrer_host string, referrer_path string"
)


def retained_events(spark: SparkSession, path: str) -> DataFrame:
    """Strict scan: one bad line fails the read."""
    return spark.read.schema(RETAINED_SCHEMA).option("mode", "FAILFAST").json(path)


def usage_events(
    spark: SparkSession, path: str, since=None, limit: int | None = None
) -> DataFrame:
    """Lenient scan: bad lines are skipped; `date=` folders before `since` are not read."""
    reader = spark.read.schema(USAGE_SCHEMA).option("mode", "DROPMALFORMED")
    df = reader.json(path)
    if since is not None:
        if "date" in df.columns:
            df = df.filter(F.col("date") >= F.to_date(F.lit(since)))
        df = df.filter(F.col("timestamp") >= F.lit(since).cast("timestamp"))
    return df.limit(limit) if limit else df


def dated_prefix(spark: SparkSession, path: str, schema: str, since_date: str | None) -> DataFrame:
    """JSON lines under date-named folders, each row with its object date.

    A file outside any `date=` folder has date 'unknown' and is always kept. With a
    partitioned layout the filter prunes folders.
    """
    df = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    day = (
        F.col("date").cast("string")
        if "date" in df.columns
        else F.regexp_extract("_metadata.file_path", r"date=(\d{4}-\d{2}-\d{2})", 1)
    )
    df = df.withColumn("object_date", F.coalesce(F.nullif(day, F.lit("")), F.lit("unknown")))
    if since_date is not None:
        df = df.filter((F.col("object_date") >= since_date) | (F.col("object_date") == "unknown"))
    return df


def record_type(table: DataFrame, name: str) -> DataFrame:
    """Rows of one record type of an exported key-value table."""
    return table.filter(F.col("record_type") == name)


def append_partitioned(events: DataFrame, path: str, ts: str = "timestamp", fmt: str = "json") -> None:
    """Append under date= and hour= folders.

    The rebalance hint gathers the rows of a folder into few files, and lets a folder that
    holds most of the rows be split over tasks.
    """
    dated = events.withColumn("date", F.date_format(ts, "yyyy-MM-dd")).withColumn(
        "hour", F.date_format(ts, "HH")
    )
    (
        dated.hint("rebalance", "date", "hour")
        .write.mode("append")
        .partitionBy("date", "hour")
        .format(fmt)
        .save(path)
    )


def write_report(report: DataFrame, path: str, fmt: str = "json") -> None:
    """Report, summary or comparison rows as JSON or Parquet."""
    report.write.mode("overwrite").format(fmt).save(path)


# File index (S23) ----------------------------------------------------------------------------

#: Bytes of a file that one task reads.
RANGE_BYTES = 1 << 27
#: Words of libcrypto's SHA256_CTX.
STATE_WORDS = 28
#: Lines lose this mark at the start of a file.
BYTE_ORDER_MARK = b"\xef\xbb\xbf"


@functools.cache
def _libcrypto() -> ctypes.CDLL | None:
    """The library behind `hashlib`, whose SHA-256 keeps its state in a plain structure; None where it cannot be reached."""
    try:
        import _hashlib

        lib = ctypes.CDLL(_hashlib.__file__)
        lib.SHA256_Init.argtypes = [ctypes.c_void_p]
        lib.SHA256_Update.argtypes = [ctypes.c_void_p, ctypes.c_char_p, ctypes.c_size_t]
        lib.SHA256_Final.argtypes = [ctypes.c_char_p, ctypes.c_void_p]
    except (ImportError, AttributeError, OSError):
        return None
    return lib


def sha256_start() -> bytes:
    state = (ctypes.c_uint32 * STATE_WORDS)()
    _libcrypto().SHA256_Init(state)
    return bytes(state)


def sha256_update(state: bytes, data: bytes) -> bytes:
    """The state after `data`; it can be handed to another task."""
    now = (ctypes.c_uint32 * STATE_WORDS).from_buffer_copy(state)
    _libcrypto().SHA256_Update(now, data, len(data))
    return bytes(now)


def sha256_hex(state: bytes) -> str:
    digest = ctypes.create_string_buffer(32)
    _libcrypto().SHA256_Final(digest, (ctypes.c_uint32 * STATE_WORDS).from_buffer_copy(state))
    return digest.raw.hex()


def can_hand_on() -> bool:
    """Whether a digest that is handed on after every few bytes is that of `hashlib`."""
    if _libcrypto() is None:
        return False
    data = bytes(range(200))
    parts = [data[:3], data[3:64], data[64:190], data[190:]]
    return sha256_hex(functools.reduce(sha256_update, parts, sha256_start())) == hashlib.sha256(data).hexdigest()


def _literal(path: str) -> str:
    """A path without wildcards, for readers that take patterns."""
    return re.sub(r"([{}\[\]*?\\])", r"\\\1", path)


def _line_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Consecutive lines of a range as one row."""
    for batch in batches:
        if batch.num_rows:
            file, start = batch.column("file")[0], batch.column("start").unique().to_pylist()
            if len(start) > 1:
                raise RuntimeError(f"a task has more than one range: {start}")
            block = b"\n".join(batch.column("line").to_pylist())
            row = [pa.array([file.as_py()], pa.int32()), pa.array(start, pa.int64()), pa.array([block], pa.binary())]
            yield pa.RecordBatch.from_arrays(row, ["file", "start", "block"])


def _ranges(spark: SparkSession, path: str, file: int) -> RDD:
    """(file, start, block): the lines of a file, a partition for each range, in their order."""
    lines = spark.read.option("recursiveFileLookup", True).option("lineSep", "\n").text(_literal(path))
    rows = lines.select(F.lit(file).alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("line"))
    return rows.mapInArrow(_line_blocks, "file int, start bigint, block binary").rdd


def _hashed_on(states: dict[int, tuple[bytes, int, int]]) -> Callable[[Iterator], Iterator]:
    """States of the files of a task's rows, (digest, bytes, start of the range), gone on from the given ones."""

    def run(rows: Iterator) -> Iterator:
        now: dict[int, tuple[bytes, int, int]] = {}
        for file, start, block in rows:
            state, size, last = now.get(file) or states[file]
            if start < last:
                raise RuntimeError(f"range {start} comes after range {last}")
            data = bytes(block) if last < 0 else b"\n" + block
            now[file] = sha256_update(state, data), size + len(data), start
        yield from now.items()

    return run


def range_hashes(spark: SparkSession, files: list[tuple[str, int]], range_bytes: int = RANGE_BYTES, head: bytes = b"") -> dict[str, str]:
    """SHA-256 of (path, bytes) files, each read in ranges of whole lines, one job for the next range of all files.

    A digest goes through a file in order, so a task takes up the state where the range before left
    it; states are all that passes the driver. `head` are bytes at the start that readers of lines
    leave out. Files whose lines do not add up to their bytes are left out.
    """
    # One range a partition, whatever the cores: a range costs as much to open as it may hold.
    session = spark.newSession()
    for name in ("maxPartitionBytes", "openCostInBytes"):
        session.conf.set(f"spark.sql.files.{name}", range_bytes)
    ranges = [_ranges(session, path, i) for i, (path, _) in enumerate(files)]
    counts = [r.getNumPartitions() for r in ranges]
    firsts = [sum(counts[:i]) for i in range(len(counts))]
    together = spark.sparkContext.union(ranges)
    states = {i: (sha256_update(sha256_start(), head), len(head), -1) for i in range(len(files))}
    for k in range(max(counts)):
        parts = [first + k for first, n in zip(firsts, counts, strict=True) if k < n]
        states.update(spark.sparkContext.runJob(together, _hashed_on(states), parts))
    out, marked = {}, []
    for i, (path, size) in enumerate(files):
        state, seen, _ = states[i]
        missing = size - seen
        if missing in (0, 1):  # the last line may end the file without a line feed
            out[path] = sha256_hex(sha256_update(state, b"\n" * missing))
        elif not head and missing - len(BYTE_ORDER_MARK) in (0, 1):
            marked.append((path, size))
    return out | (range_hashes(spark, marked, range_bytes, BYTE_ORDER_MARK) if marked else {})


def file_index(spark: SparkSession, root: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Path, bytes and SHA-256 of every file.

    Files of more than `range_bytes` are read in ranges of that size, by as many tasks. Not so files
    that Spark's readers of lines unpack by their names, nor any where libcrypto is not within
    reach: a task reads them whole, and they must have less than 2 GB, as must a line of the others.
    """

    def whole(paths: str | list[str]) -> DataFrame:
        return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths)

    def index(files: DataFrame) -> DataFrame:
        return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))

    files = whole(root)
    if not can_hand_on():
        return index(files)
    out = index(files.filter(F.col("length") <= range_bytes))
    large = [tuple(r) for r in files.filter(F.col("length") > range_bytes).select("path", "length").collect()]
    jvm = spark._jvm
    codecs = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(spark._jsc.hadoopConfiguration())
    plain = [f for f in large if codecs.getCodec(jvm.org.apache.hadoop.fs.Path(f[0])) is None]
    done = range_hashes(spark, plain, range_bytes) if plain else {}
    if done:
        rows = [(path, size, done[path]) for path, size in large if path in done]
        out = out.unionByName(spark.createDataFrame(rows, "path string, bytes bigint, sha256 string"))
    if left := [_literal(path) for path, _ in large if path not in done]:
        out = out.unionByName(index(whole(left)))
    return out
