"""Archives of transcripts."""

from __future__ import annotations

import io
import posixpath
import tarfile
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

SCHEMA = "bundle string, entry string, ordinal int, content string, reject string"


def _bad_name(name: str) -> bool:
    clean = posixpath.normpath(name) if name else "."
    unsafe = not name or name[0] in "/\\" or "\\" in name or clean != name or clean == "."
    return unsafe or clean.startswith("../") or "/../" in clean


@dataclass(frozen=True)
class BundleLimits:
    """A bundle beyond one of these is rejected as a whole; None: no limit."""

    files: int | None = None
    file_bytes: int | None = None
    total_bytes: int | None = None


def _above(value: int, most: int | None) -> bool:
    return most is not None and value > most


def _entries(data: bytes, limits: BundleLimits) -> Iterator[tuple[str, str]]:
    """(name, text) of each log; a ValueError names the first broken limit."""
    count = total = 0
    try:
        with tarfile.open(fileobj=io.BytesIO(data), mode="r|gz") as archive:
            for member in archive:
                if member.isdir():
                    continue
                if not member.isreg():
                    raise ValueError("unsupported entry type")
                if _bad_name(member.name):
                    raise ValueError("unsafe path")
                if not member.name.lower().endswith(".jsonl"):
                    raise ValueError("not a jsonl file")
                if _above(count + 1, limits.files):
                    raise ValueError("too many files")
                if _above(member.size, limits.file_bytes):
                    raise ValueError("file too large")
                if _above(total + member.size, limits.total_bytes):
                    raise ValueError("bundle too large")
                body = archive.extractfile(member).read()
                if not body.strip():
                    raise ValueError("empty file")
                count, total = count + 1, total + len(body)
                yield member.name, body.decode("utf-8", "replace")
    except (tarfile.TarError, EOFError, OSError) as err:
        raise ValueError("invalid archive") from err
    if count == 0:
        raise ValueError("no logs")


def _expand(batches: Iterator[pd.DataFrame], limits: BundleLimits) -> Iterator[pd.DataFrame]:
    columns = ["bundle", "entry", "ordinal", "content", "reject"]
    for batch in batches:
        for path, data in zip(batch["path"], batch["content"]):
            rows = []
            try:
                for i, (name, text) in enumerate(_entries(bytes(data), limits), 1):
                    rows.append((path, name, i, text, None))
            except ValueError as err:
                rows = [(path, None, None, None, str(err))]
            yield pd.DataFrame(rows, columns=columns)


def expand_bundles(archives: DataFrame, limits: BundleLimits = BundleLimits()) -> DataFrame:
    """One row per log of `archives` (path, content); a bad bundle gives one reject row."""
    rows = archives.select("path", "content")
    return rows.mapInPandas(lambda batches: _expand(batches, limits), SCHEMA)


def read_bundles(spark: SparkSession, paths: str | list[str], limits: BundleLimits = BundleLimits()) -> DataFrame:
    """`expand_bundles` of the files under `paths`, expanded where they are read, one at a time."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths)
    return expand_bundles(files, limits)
