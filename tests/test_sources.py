"""Files, feeds, bundles, selection."""

import gzip
import hashlib
import io
import itertools
import random
import tarfile

import pytest
from pyspark.sql import functions as F

from turnwise.operators import selection as Sel
from turnwise.operators import usage as U
from turnwise.sources import bundles, feeds
from turnwise.sources import logs as L


def pack(path, entries):
    with tarfile.open(path, "w:gz") as archive:
        for name, data in entries:
            info = tarfile.TarInfo(name)
            info.size = len(data)
            archive.addfile(info, io.BytesIO(data))


def test_bundles(spark, tmp_path):
    pack(tmp_path / "good.tgz", [("a.jsonl", b"{}\n"), ("d/b.jsonl", b"x\n")])
    pack(tmp_path / "up.tgz", [("../a.jsonl", b"{}")])
    pack(tmp_path / "kind.tgz", [("a.txt", b"{}")])
    pack(tmp_path / "blank.tgz", [("a.jsonl", b"  \n")])
    pack(tmp_path / "many.tgz", [(f"{i}.jsonl", b"1") for i in range(101)])
    (tmp_path / "bad.tgz").write_bytes(b"nope")
    rows = bundles.read_bundles(spark, str(tmp_path)).collect()
    by = {}
    for r in rows:
        by.setdefault(r.bundle.rsplit("/", 1)[1], []).append((r.entry, r.reject))
    assert by["good.tgz"] == [("a.jsonl", None), ("d/b.jsonl", None)]
    assert by["up.tgz"] == [(None, "unsafe path")] and by["kind.tgz"] == [(None, "not a jsonl file")]
    assert by["blank.tgz"] == [(None, "empty file")] and len(by["many.tgz"]) == 101
    few = bundles.read_bundles(spark, str(tmp_path / "many.tgz"), bundles.BundleLimits(files=100)).collect()
    assert [(r.entry, r.reject) for r in few] == [(None, "too many files")]
    assert by["bad.tgz"] == [(None, "invalid archive")]


def test_read_logs(spark, tmp_path):
    home = tmp_path / ".claude" / "projects"
    home.mkdir(parents=True)
    (home / "a.jsonl").write_text("one\ntwo\n")
    (home / "big.jsonl").write_text("x" * 500)
    (home / "note.md").write_text("no")
    rows = L.read_logs(spark, [str(home), str(home)], glob="*.jsonl", max_bytes=100).collect()
    assert {(r.source_id, r.content, r.too_large) for r in rows} == {("claude_code", "one\ntwo\n", False), ("claude_code", None, True)}
    whole = L.read_logs(spark, str(home), glob="*.jsonl").collect()
    assert sorted(len(r.content) for r in whole) == [8, 500]


def test_strict_and_lenient_scans(spark, tmp_path):
    path = tmp_path / "f.json"
    path.write_text('{"scan_type":"free"}\n{broken\n')
    with pytest.raises(Exception, match="MALFORMED_RECORD"):
        feeds.retained_events(spark, str(path)).collect()
    path.write_text('{"status":200,"timestamp":"2024-01-01T00:00:00Z"}\n{broken\n')
    assert feeds.usage_events(spark, str(path)).count() == 1


def test_target_selection_is_the_best_subset(spark):
    sizes = [4_000_000, 1_300_000, 1_200_000, 600_000, 9_000_000, 242_880]
    rows = [("s", f"p{i}", f"2024-01-{i + 1:02d}", n) for i, n in enumerate(sizes)]
    df = spark.createDataFrame(rows, "source_id string, path string, t string, size_bytes long").withColumn("mod_time", F.col("t").cast("timestamp"))
    got = sum(r.size_bytes for r in Sel.target_sized(df).collect())
    fits = [n for n in sizes if n <= Sel.TARGET_BYTES]
    best = min(abs(sum(c) - Sel.TARGET_BYTES) for k in range(1, 6) for c in itertools.combinations(fits, k))
    assert abs(got - Sel.TARGET_BYTES) == best


def test_window_parameters():
    assert U.lookback_seconds() == 7 * 86400 and U.lookback_seconds("36h") == 36 * 3600
    assert U.row_limit("5") == 5 and U.row_limit("x") == 20_000 and U.row_limit("999999") == 100_000
    for bad in ({"days": "91"}, {"days": "0"}, {"since": "2400h"}, {"since": "x"}):
        with pytest.raises(ValueError):
            U.lookback_seconds(**bad)


def test_files_are_hashed_in_ranges(spark, tmp_path, monkeypatch):
    rng = random.Random(5)
    noise = rng.randbytes(6_000)
    files = {
        "noise.bin": noise,
        "ends.bin": noise[:5_000].rstrip(b"\n") + b"\n",
        "open.bin": noise[:3_999].rstrip(b"\n") + b"x",
        "blank.txt": b"\n" * 5_000,
        "one line.txt": b"x" * 4_321,
        "crlf.txt": b"a\r\n\r" * 801,
        "edges.txt": (b"y" * 999 + b"\n") * 4,
        "marked.txt": b"\xef\xbb\xbf" + noise[:3_000] + b"\n",
        "marked twice.txt": b"\xef\xbb\xbf" * 2 + noise[:3_000] + b"z",
        "packed.gz": gzip.compress(noise),
        "not packed.gz": noise[5:],
        "odd[1]{a,b}*?%20,\\.bin": noise[3:],
        "d=1/noise.bin": noise[4:],
        "d=1/same.bin": noise,
        "small.bin": b"abc",
        "limit.bin": noise[:1_000],
    }
    for name, data in files.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    whole, read = feeds.range_hashes, []
    monkeypatch.setattr(feeds, "range_hashes", lambda spark, files, *more: (read.extend(files), whole(spark, files, *more))[1])
    rows = feeds.file_index(spark, str(tmp_path), range_bytes=1_000).collect()
    got = {r.path.removeprefix(f"file:{tmp_path}/"): (r.bytes, r.sha256) for r in rows}
    assert sorted(got) == sorted(files) and len(rows) == len(files)
    assert got == {name: (len(data), hashlib.sha256(data).hexdigest()) for name, data in files.items()}
    assert {p.removeprefix(f"file:{tmp_path}/") for p, _ in read} == {n for n, d in files.items() if len(d) > 1_000 and not n.endswith(".gz")}


def test_no_task_reads_more_than_a_range(spark, tmp_path):
    path = tmp_path / "a.bin"
    path.write_bytes(random.Random(6).randbytes(100_000))
    session = spark.newSession()
    for name in ("maxPartitionBytes", "openCostInBytes"):
        session.conf.set(f"spark.sql.files.{name}", 10_000)
    sizes = feeds._ranges(session, str(path), 0).mapPartitions(lambda rows: [sum(len(r.block) + 1 for r in rows)]).collect()
    assert len(sizes) == 10 and sum(sizes) in (100_000, 100_001) and max(sizes) < 15_000


def test_files_are_hashed_whole_where_digests_stay(spark, tmp_path, monkeypatch):
    (tmp_path / "a.bin").write_bytes(b"a\n" * 3_000)
    monkeypatch.setattr(feeds, "can_hand_on", lambda: False)
    (row,) = feeds.file_index(spark, str(tmp_path), range_bytes=1_000).collect()
    assert (row.bytes, row.sha256) == (6_000, hashlib.sha256(b"a\n" * 3_000).hexdigest())
