"""Logs larger than a task: byte-range splits, scrubbed in pieces and numbered by prefix sums.

Spark reads text files in byte ranges of whole lines, so one log is the work of many tasks. Each
range is cut into pieces of text between two lines that no secret can span: not inside a private
key, and not between a key word at the end of a line and its value on the next one. Only at the
borders of ranges this is not known; there the pieces on both sides, and all those between a key's
begin and its end, are put together again. Every piece is then scrubbed like a whole log, and lines are
numbered by the counts of the pieces before. Rows and counts are those of the whole text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, DataFrameReader, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamReader

from turnwise.functions import text as X
from turnwise.session import cut_lineage

PIECE_BYTES = 1 << 20

# What can span lines, in the words of the rules of `functions.text`.
KEY_EDGE = re.compile(r"-----(BEGIN|END) ([A-Z ]*)PRIVATE KEY-----")
KEY_MARK = "PRIVATE KEY-----"
OPEN_WORD = r"""(?i)(key|token|secret|cookie)["'=:\s]*$"""
FILLER = r"""^["'=:\s]*$"""

PIECES = (
    "log string, split long, piece long, text string, opens_ssh boolean, opens_other boolean, waits boolean, "
    "ends_ssh boolean, ends_other boolean"
)


def log_lines(spark: SparkSession, paths: list[str] | str, glob: str | None = None, recursive: bool = True) -> DataFrame:
    """(log, split, line): lines of text files as Spark's readers split them; `split` is where a range starts."""
    return lines_from(spark.read, paths, glob, recursive)


def lines_from(reader: DataFrameReader | DataStreamReader, paths: list[str] | str, glob: str | None = None, recursive: bool = True) -> DataFrame:
    """`log_lines` of a reader of files or of a stream of files."""
    reader = reader.option("recursiveFileLookup", recursive).option("lineSep", "\n")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    lines = reader.text(paths)
    return lines.select(
        F.col("_metadata.file_path").alias("log"), F.col("_metadata.file_block_start").alias("split"), F.col("value").alias("line")
    )


#: Bytes that a part file of a log in parts may have.
PART_BYTES = 1 << 44


def parts_as_logs(lines: DataFrame) -> DataFrame:
    """`log_lines` of logs that are folders of part files: the parts of a folder, in the order of their numbers, are one log.

    Spark numbers the part files of sorted rows so. `log` becomes the folder and `split` counts on from part to part.
    """
    number = F.regexp_extract("log", r"/part-(\d+)[^/]*$", 1).cast("long")
    return lines.select(F.regexp_extract("log", "^.*/", 0).alias("log"), (number * PART_BYTES + F.col("split")).alias("split"), "line")


class _Cutter:
    """Lines of one range, in order, to pieces of text."""

    def __init__(self, log: str, split: int, most: int):
        self.log, self.split, self.most = log, split, most
        self.rows: list[tuple] = []
        self.held: list[pa.Array] = []
        self.size = self.number = 0
        self.ssh = self.other = False
        self.waits = split > 0  # the range before may end with a key word
        self.begun_ssh = self.begun_other = self.ends_ssh = self.ends_other = False

    def add(self, lines: pa.Array) -> None:
        n = len(lines)
        size = np.cumsum(pc.binary_length(lines).to_numpy(zero_copy_only=False) + 1)
        open_word = pc.match_substring_regex(lines, OPEN_WORD).to_numpy(zero_copy_only=False)
        filler = pc.match_substring_regex(lines, FILLER).to_numpy(zero_copy_only=False)
        # the last line that is not filler settles whether a value may still come
        last = np.maximum.accumulate(np.where(filler, -1, np.arange(n)))
        waits = np.where(last < 0, self.waits, open_word[np.maximum(last, 0)])
        marked = np.flatnonzero(pc.match_substring(lines, KEY_MARK).to_numpy(zero_copy_only=False)).tolist()
        start, at = 0, 0
        for stop in [*marked, n]:
            # lines from `at` on, up to the marked one, are all inside a key or all outside
            if not (self.ssh or self.other):
                while True:
                    short = int(np.searchsorted(size, (size[start - 1] if start else 0) + self.most - self.size))
                    free = np.flatnonzero(~waits[max(at, short) : stop])
                    if not len(free):
                        break
                    end = max(at, short) + int(free[0]) + 1
                    self.held.append(lines.slice(start, end - start))
                    self.flush(False)
                    start = at = end
            if stop < n:
                self._mark(lines[stop].as_py())
            at = stop
        self.held.append(lines.slice(start))
        self.size += int(size[-1] - (size[start - 1] if start else 0)) if n else 0
        self.waits = bool(waits[-1]) if n else self.waits

    def _mark(self, line: str) -> None:
        for edge, kind in KEY_EDGE.findall(line):
            ssh = kind.strip() == "OPENSSH"
            if edge == "BEGIN":
                self.ssh, self.other = self.ssh or ssh, self.other or not ssh
                self.begun_ssh, self.begun_other = self.begun_ssh or ssh, self.begun_other or not ssh
            elif ssh:
                self.ends_ssh, self.ssh = True, False
            else:
                self.ends_other, self.other = True, False

    def flush(self, last: bool) -> None:
        text = "\n".join(x for part in self.held for x in part.to_pylist())
        opens = (self.ssh, self.other, self.waits) if last else (False, False, False)
        self.rows.append((self.log, self.split, self.number, text, *opens, self.ends_ssh, self.ends_other))
        self.held, self.size, self.number = [], 0, self.number + 1
        self.ends_ssh = self.ends_other = False


def pieces(lines: DataFrame, most: int = PIECE_BYTES) -> DataFrame:
    """Texts of about `most` bytes of consecutive lines of a range, with what is open at its end and what ends in them.

    A key that begins in a range and does not end there makes one piece of the rest of the range.
    """
    names = [f.split()[0] for f in PIECES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Cutter | None = None
        for batch in batches:
            log, split = batch.column("log"), batch.column("split").to_numpy()
            key = np.array(log.dictionary_encode().indices)
            heads = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (split[1:] != split[:-1]), True]) if batch.num_rows else []
            done: list[tuple] = []
            for a, b in zip(heads[:-1], heads[1:], strict=True):
                where = log[int(a)].as_py(), int(split[a])
                if now is None or (now.log, now.split) != where:
                    if now is not None:
                        now.flush(True)
                        done += now.rows
                    now = _Cutter(*where, most)
                now.add(batch.column("line").slice(int(a), int(b - a)))
                done += now.rows
                now.rows = []
            if done:
                yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in done], schema)
        if now is not None:
            now.flush(True)
            yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in now.rows], schema)

    kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}
    schema = pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in PIECES.split(", ")])
    return lines.select("log", "split", "line").mapInArrow(run, PIECES)


def joined(cut: DataFrame) -> DataFrame:
    """(log, split, piece, text): pieces that a secret may span across a border are one, under the first one's numbers.

    Decided on one small row for each piece; only texts at such borders are shuffled.
    """
    marks = cut.drop("text")
    order = Window.partitionBy("log").orderBy("split", "piece")
    after = order.rowsBetween(1, Window.unboundedFollowing)
    marks = marks.withColumn("n", F.row_number().over(order))
    ends = {k: F.when(F.col(f"ends_{k}"), F.col("n")) for k in ("ssh", "other")}
    following = {k: F.min(v).over(after) for k, v in ends.items()}
    furthest = F.greatest(*[F.max(v).over(after) for v in ends.values()])
    reach = F.greatest(
        F.when(F.col("opens_ssh"), F.coalesce(following["ssh"], furthest)),
        F.when(F.col("opens_other"), F.coalesce(following["other"], furthest)),
        F.when(F.col("waits"), F.col("n") + 1),
    )
    so_far = F.max("reach").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.coalesce(so_far < F.col("n"), F.lit(True))
    marks = marks.withColumn("reach", reach).withColumn("fresh", fresh)
    marks = marks.withColumn("group", F.sum(F.col("fresh").cast("long")).over(order))
    # a text of blank lines does not end the wait for a value: such a piece never stands alone at a border
    size = F.count(F.lit(1)).over(Window.partitionBy("log", "group"))
    torn = cut_lineage(marks.withColumn("size", size).filter("size > 1").select("log", "split", "piece", "group"))
    key = ["log", "split", "piece"]
    parts = F.array_sort(F.collect_list(F.struct("split", "piece", "text")))
    whole = cut.join(torn, key).groupBy("log", "group").agg(parts.alias("parts"))
    mended = whole.select(
        "log", F.col("parts")[0]["split"].alias("split"), F.col("parts")[0]["piece"].alias("piece"),
        F.array_join(F.col("parts.text"), "\n").alias("text"),
    )
    return cut.join(torn, key, "left_anti").select(*key, "text").unionByName(mended)


def scrubbed_pieces(lines: DataFrame, most: int = PIECE_BYTES) -> DataFrame:
    """(log, split, piece, text, redactions) of logs of any size, scrubbed as their whole texts would be; written once."""
    cut = cut_lineage(pieces(lines, most))  # borders, whole pieces and torn ones are read apart
    return cut_lineage(X.with_scrubbed(joined(cut), "text", out="_s").drop("text").withColumnRenamed("_s", "text"))


def redactions(scrubbed: DataFrame) -> DataFrame:
    """(log, family, count) over all pieces of a log."""
    return scrubbed.select("log", F.inline("redactions")).groupBy("log", "family").agg(F.sum("count").alias("count"))


def numbered_lines(scrubbed: DataFrame) -> DataFrame:
    """(log, turn, raw): the non-blank lines of each log, numbered from 1.

    Pieces are numbered apart; the counts of the pieces before come from one small row for each.
    """
    lines = F.filter(F.transform(F.split(F.col("text"), "\n"), X.trimmed), lambda x: x != "")
    rows = scrubbed.select("log", "split", "piece", lines.alias("lines"))
    filled = F.size(F.filter(F.split(F.col("text"), "\n"), lambda x: x.rlike(r"\S")))
    counts = scrubbed.select("log", "split", "piece", filled.cast("long").alias("n"))
    before = Window.partitionBy("log").orderBy("split", "piece").rowsBetween(Window.unboundedPreceding, -1)
    skip = counts.select("log", "split", "piece", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("skip"))
    placed = rows.join(skip, ["log", "split", "piece"])
    return placed.select("log", "skip", F.posexplode("lines").alias("at", "raw")).select(
        "log", (F.col("skip") + F.col("at") + 1).alias("turn"), "raw"
    )
