"""Jaccard similarity join of shingle sets by parity sketches.

A sketch is a very wide row of bits. Each shingle's hash turns one of them, so the Hamming
distance of two sketches is at most the number of shingles that only one of the texts has. Texts
are joined per band of sizes: a text and a partner up to a quarter larger lie in one band or in
two neighbouring ones, and share at most `bound` shingles less than they could. The sketch of a
band is cut into more segments than that, so some segments must agree (pigeonhole); the key of a
segment is the XOR of its turned bits' hashes.

Of m segments with a turned bit at least m - bound agree, so it is enough to meet in the bound + 1 rarest
of them: common passages fill frequent segments, and those are looked at last. Texts with too
few such segments are cut anew with other hashes until they have enough; a partner that had
enough at once meets them at the first cut.

What meets is linked if the exact sets say so. Each text first proposes the text of a segment that
has most in common with others, so that a group of near copies closes without all its pairs; what
then still has another label is compared by a narrow sketch, folded from the wide one, before a
pair is written.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from turnwise.llm.anchors import STEP, mixed, passes, repeated_filter
from turnwise.llm.common import ranges, text_chunks
from turnwise.llm.covering import components, shingle_hashes
from turnwise.session import cut_lineage

#: Members of one segment that one task compares with as many others.
SIDE = 256
#: Pairs with one text that meet its set in one group.
SHARE = 1000
#: Bits of the widest narrow sketch.
WIDEST = 1 << 14
#: Set keys that a task remembers in order not to send copies again.
REMEMBERED = 1 << 20


@dataclass(frozen=True)
class Bands:
    """Sizes in bands for a similarity of `percent` or more, over 50: else a partner may touch all segments of a text."""

    percent: int = 80

    def __post_init__(self):
        if self.percent <= 50:
            raise ValueError(f"percent must be over 50, not {self.percent}")

    @cache  # noqa: B019
    def tops(self) -> np.ndarray:
        """Largest size of each band; the largest partner of a band's sizes is in the next one."""
        tops = [1]
        while tops[-1] < 1 << 40:
            tops.append(max(tops[-1] + 1, self.partner(tops[-1])))
        return np.array(tops, np.int64)

    def partner(self, n: int) -> int:
        return n * 100 // self.percent

    @cache  # noqa: B019
    def bounds(self) -> np.ndarray:
        """For each band the most shingles that a size of it and a larger partner don't share."""
        return np.array([self.apart(t + self.partner(t)) for t in self.tops().tolist()], np.int64)

    def apart(self, total):
        """Most shingles that two sets of `total` sizes don't share."""
        return total * (100 - self.percent) // (100 + self.percent)

    def of(self, n: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.tops(), n)

    @cache  # noqa: B019
    def segments(self) -> np.ndarray:
        """Somewhat more than the bound, and so many that the shingles of a band's sizes turn bits in more than the bound."""
        b, n = self.bounds(), self.tops()
        m = b + 2 + b // 8
        while len(few := np.flatnonzero(-m * np.expm1(n * np.log1p(-1 / m)) < b + 0.5 + np.minimum(b, n - b) / 50)):
            m[few] += 1 + m[few] // 8
        return m

    def widths(self) -> np.ndarray:
        """Bits of the narrow sketch."""
        return np.clip(1 << np.ceil(np.log2(2.0 * self.tops())).astype(np.int64), 64, WIDEST)


def _segment_keys(h: np.ndarray, counts: np.ndarray, segments: np.ndarray, salt: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, text) of all segments with a turned bit, and their number per text; `h` is sorted inside each text."""
    text = np.repeat(np.arange(len(counts)), counts)
    part = ((h >> np.uint64(32)) * segments.astype(np.uint64)[text]) >> np.uint64(32)
    head = np.flatnonzero(np.r_[True, (text[1:] != text[:-1]) | (part[1:] != part[:-1])]) if len(h) else np.zeros(0, np.int64)
    turned = np.bitwise_xor.reduceat(mixed(h), head) if len(h) else h
    owner = text[head]
    return mixed(turned + salt.astype(np.uint64)[owner] * STEP + part[head]), owner, np.bincount(owner, minlength=len(counts))


def sent_segments(h: np.ndarray, counts: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, text, tag): segments of each text in its band and the one below.

    The tag is band and number of the cut, and in its lower half how many of the text's segments
    must be shared beyond this number for the text to have a partner.
    """
    out = [(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))]
    own = bands.of(counts)
    for below in (0, 1):
        band = own - below
        ok = (counts > 0) & (band >= 0)
        ok[ok] &= bands.bounds()[band[ok]] > 0
        if below:
            ok[ok] &= counts[ok] <= bands.tops()[band[ok]] * 100 // bands.percent
        some, cut = np.flatnonzero(ok), 0
        starts = np.cumsum(counts) - counts
        while len(some):
            mine = h[ranges(starts[some], counts[some])]
            n = counts[some]
            if cut:
                mine = mixed(mine + np.uint64(cut * int(STEP) % (1 << 64)))
                mine = mine[np.lexsort((mine, np.repeat(np.arange(len(some)), n)))]
            b = band[some]
            bound = bands.bounds()[b]
            own_bound = bands.apart(n + (bands.tops()[b] if below else bands.partner(n)))
            key, text, filled = _segment_keys(mine, n, bands.segments()[b], b << 8 | cut)
            free = np.maximum(filled - bound - 1, 0)
            out.append((key, some[text], (b << 8 | cut)[text] << 32 | free[text]))
            some, cut = some[filled <= own_bound], cut + 1
    key, text, tag = (np.concatenate(x) for x in zip(*out, strict=True))
    return key, text, tag


def narrow_sketches(h: np.ndarray, counts: np.ndarray, bands: Bands) -> list[bytes]:
    """Parities of the shingles at as many bits as the band of a text's size has."""
    width = bands.widths()[np.minimum(bands.of(np.maximum(counts, 1)), len(bands.tops()) - 1)]
    start = np.cumsum(width) - width
    bit = (mixed(h) & np.repeat(width - 1, counts).astype(np.uint64)).astype(np.int64) + np.repeat(start, counts)
    packed = np.packbits((np.bincount(bit, minlength=int(width.sum())) & 1).astype(np.uint8), bitorder="little").tobytes()
    return [packed[a // 8 : b // 8] for a, b in zip(start.tolist(), (start + width).tolist(), strict=True)]


def _folded(sketch: bytes, width: int) -> np.ndarray:
    words = np.frombuffer(sketch, np.uint64)
    return np.bitwise_xor.reduce(words.reshape(-1, width // 64), axis=0)


def near(left: dict, right: dict, bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs whose labels differ and whose sizes and narrow sketches allow a link."""
    width = 8 * min(map(len, [*left["sketch"], *right["sketch"]]))
    a, b = (np.stack([_folded(s, width) for s in x["sketch"]]) for x in (left, right))
    rows = max(1, (1 << 21) // b.size)
    out = []
    for at in range(0, len(a), rows):
        some = slice(at, at + rows)
        apart = np.bitwise_count(a[some, None, :] ^ b[None, :, :]).sum(2, dtype=np.int64)
        n, m = left["n"][some, None], right["n"][None, :]
        ok = (left["label"][some, None] != right["label"][None, :]) & (apart <= bands.apart(n + m))
        ok &= 100 * np.minimum(n, m) >= bands.percent * np.maximum(n, m)
        i, j = np.nonzero(ok)
        out.append((i + at, j))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _set_keys(h: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """One hash for each set of sorted hashes."""
    parts = np.split(h, np.cumsum(counts)[:-1])
    return np.array([xxhash.xxh64_intdigest(p.tobytes()) for p in parts], np.uint64).view(np.int64)


def _row(id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.col(id_col), F.col(id_col).isNull(), F.col(text_col), F.col(text_col).isNull())


class Join:
    """The steps of one join over the texts of a table."""

    def __init__(self, df: DataFrame, percent: int, shingle: int, id_col: str, text_col: str):
        self.bands, self.shingle = Bands(percent), shingle
        self.rows = df.select(F.col(id_col).cast("long").alias("id"), _row(id_col, text_col).alias("row"), F.col(text_col).alias("text"))

    def read(self) -> DataFrame:
        """(cell, node, tag, own): the segments of all sets, and one row with `own` for each row of the table.

        Both are made in one reading, as the hashes of the shingles cost more than anything else. A task sends
        the segments of a set once; rows with `own` have a cell for themselves and their set's key as node.
        """
        shingle, bands = self.shingle, self.bands
        names = ["cell", "node", "tag", "own"]
        own = pa.struct([(c, pa.int64()) for c in ("id", "row", "n", "place")])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: set[int] = set()
            at = TaskContext.get().partitionId() << 40
            for batch in batches:
                for rows, texts in text_chunks(batch, "text", 2 << 20):
                    h, counts = shingle_hashes(texts, shingle, once=True)
                    keys = _set_keys(h, counts)
                    place = np.arange(at, at + len(keys))
                    at += len(keys)
                    mine = pa.StructArray.from_arrays([rows.column("id"), rows.column("row"), pa.array(counts), pa.array(place)], fields=list(own))
                    alone = pa.array(mixed(place.astype(np.uint64) * STEP).view(np.int64))
                    yield pa.RecordBatch.from_arrays([alone, pa.array(keys), pa.array(np.zeros(len(keys), np.int64)), mine], names)
                    if len(seen) > REMEMBERED:
                        seen.clear()
                    fresh = np.zeros(len(keys), bool)
                    for i, key in enumerate(keys.tolist()):
                        fresh[i] = key not in seen
                        seen.add(key)
                    h, counts, keys = h[np.repeat(fresh, counts)], counts[fresh], keys[fresh]
                    if not len(h):
                        continue
                    cell, text, tag = sent_segments(h, counts, bands)
                    yield pa.RecordBatch.from_arrays([pa.array(cell.view(np.int64)), pa.array(keys[text]), pa.array(tag), pa.nulls(len(cell), own)], names)

        return self.rows.mapInArrow(run, "cell bigint, node bigint, tag bigint, own struct<id: bigint, row: bigint, n: bigint, place: bigint>")

    def sets(self) -> tuple[DataFrame, DataFrame]:
        """(id, row, key, n) of each row, where texts of one set have one key, and (cell, node, tag) of the segments that sets share."""
        cell = W.partitionBy("cell")
        both = self.read().withColumn("low", F.min("node").over(cell)).withColumn("high", F.max("node").over(cell))
        found = cut_lineage(both.filter("low < high OR own IS NOT NULL").select("cell", "node", "tag", "own").distinct())
        rows = found.filter("own IS NOT NULL").select("own.id", "own.row", F.col("node").alias("key"), "own.n")
        return cut_lineage(rows), found.filter("own IS NULL").select("cell", "node", "tag")

    def meeting(self, shared: DataFrame) -> DataFrame:
        """(cell, node, score): for each set the segments in which it must meet any partner."""
        mine = W.partitionBy("node", "tag")
        counted = shared.join(shared.groupBy("cell").agg(F.count("*").alias("c")), "cell")
        ranked = (
            counted.withColumn("t", F.count("*").over(mine))
            .withColumn("score", F.sum("c").over(mine))
            .withColumn("k", F.row_number().over(mine.orderBy("c", "cell")))
        )
        return cut_lineage(ranked.filter("k <= t - (tag & 4294967295)").select("cell", "node", "score"))

    def wanted_sets(self, nodes: DataFrame) -> DataFrame:
        """(key, n, shingles, sketch) of the sets in `nodes` (key, row)."""
        shingle, bands = self.shingle, self.bands
        bits, _, _ = repeated_filter(nodes, "row", F.lit(1), F.lit(False))
        sent = self.rows.sparkSession.sparkContext.broadcast(bits)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ok = passes(sent.value, batch.column("row").to_numpy())
                for _, texts in text_chunks(batch.filter(pa.array(ok)), "text", 2 << 20):
                    h, counts = shingle_hashes(texts, shingle, once=True)
                    offsets = pa.array(np.r_[0, np.cumsum(counts)], pa.int32())
                    lists = pa.ListArray.from_arrays(offsets, pa.array(h.view(np.int64)))
                    cols = [pa.array(_set_keys(h, counts)), pa.array(counts), lists, pa.array(narrow_sketches(h, counts, bands), pa.binary())]
                    yield pa.RecordBatch.from_arrays(cols, ["key", "n", "shingles", "sketch"])

        found = self.rows.select("row", "text").mapInArrow(run, "key bigint, n bigint, shingles array<bigint>, sketch binary")
        return cut_lineage(found.join(nodes.select("key"), "key", "left_semi").dropDuplicates(["key"]))

    def confirmed(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """Pairs (a, b) whose exact similarity suffices; the set of a text in many pairs is dealt out."""
        p = self.bands.percent
        load = pairs.groupBy("b").agg(F.ceil(F.count("*") / SHARE).cast("int").alias("parts"))
        left = pairs.join(load, "b").withColumn("salt", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int"))
        left = left.join(sets.select(F.col("key").alias("a"), F.col("n").alias("n_a"), F.col("shingles").alias("of_a")), "a")
        right = load.join(sets.select(F.col("key").alias("b"), F.col("n").alias("n_b"), F.col("shingles").alias("of_b")), "b")
        right = right.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
        sizes = 100 * F.least("n_a", "n_b") >= p * F.greatest("n_a", "n_b")
        shared = F.size(F.array_intersect("of_a", "of_b"))
        enough = (100 + p) * shared >= p * (F.col("n_a") + F.col("n_b"))
        return cut_lineage(left.join(right, ["b", "salt"]).filter(sizes).filter(enough).select("a", "b"))

    def proposed(self, meeting: DataFrame) -> DataFrame:
        """(a, b): each set and the best known one of each of its segments."""
        best = meeting.groupBy("cell").agg(F.max(F.struct("score", "node")).alias("m"))
        pairs = meeting.join(best, "cell").select(F.col("node").alias("a"), F.col("m.node").alias("b"))
        return cut_lineage(pairs.filter("a <> b").distinct())

    def left_over(self, meeting: DataFrame, sets: DataFrame, edges: DataFrame) -> DataFrame:
        """(a, b): pairs of other labels that meet and that sizes and narrow sketches don't refute."""
        bands = self.bands
        labels = components(edges)
        own = meeting.join(labels, "node", "left").withColumn("label", F.coalesce("root", "node")).drop("root", "score")
        mixed_cells = own.groupBy("cell").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high")
        place = F.row_number().over(W.partitionBy("cell").orderBy("label", "node")) - 1
        own = own.join(mixed_cells.select("cell"), "cell", "left_semi").withColumn("part", F.floor(place / SIDE))
        own = cut_lineage(own)
        parts = own.groupBy("cell", "part").agg(F.min("label").alias("low"), F.max("label").alias("high"))
        first, second = (parts.select("cell", *(F.col(c).alias(f"{c}_{k}") for c in ("part", "low", "high"))) for k in ("i", "j"))
        deals = first.join(second, "cell").filter("part_i <= part_j AND NOT (low_i = high_i AND high_i = low_j AND low_j = high_j)")
        deals = deals.select("cell", "part_i", "part_j")
        members = own.join(sets.select(F.col("key").alias("node"), "n", "sketch"), "node")
        sides = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("part_i").alias("part")), F.struct(F.lit(1).alias("side"), F.col("part_j").alias("part"))))
        dealt = deals.withColumn("s", sides).select("cell", "part_i", "part_j", "s.side", "s.part")
        dealt = dealt.filter("side = 0 OR part_i < part_j").join(members, ["cell", "part"])
        group = F.xxhash64("cell", "part_i", "part_j").alias("deal")
        buckets = max(32, parts.count() // 200)
        dealt = dealt.select(group, "side", "node", "label", "n", "sketch").withColumn("bucket", F.pmod(F.col("deal"), F.lit(buckets)))

        def compared(table: pa.Table) -> pa.Table:
            table = table.sort_by([("deal", "ascending"), ("side", "ascending")]).combine_chunks()
            deal, side, node, label, n = (table.column(c).to_numpy() for c in ("deal", "side", "node", "label", "n"))
            sketch = table.column("sketch").to_pylist()
            edges = np.flatnonzero(np.r_[True, deal[1:] != deal[:-1], True])
            out = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
            for x, y in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                mid = x + int((side[x:y] == 0).sum())
                one, two = ({"node": node[s], "label": label[s], "n": n[s], "sketch": sketch[s]} for s in (slice(x, mid), slice(mid, y)))
                i, j = near(one, two if mid < y else one, bands)
                out.append((one["node"][i], (two if mid < y else one)["node"][j]))
            a, b = (np.concatenate(v) for v in zip(*out, strict=True))
            low, high = np.minimum(a, b), np.maximum(a, b)
            pairs = np.unique(np.stack([low, high], 1), axis=0) if len(low) else np.zeros((0, 2), np.int64)
            return pa.table({"a": pairs[:, 0].copy(), "b": pairs[:, 1].copy()})

        return cut_lineage(dealt.groupBy("bucket").applyInArrow(compared, "a bigint, b bigint").distinct())


def similarity_join(
    df: DataFrame, percent: int = 80, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """id, `n_shingles` and `component_id`, one row per row of `df`.

    ASCII letters are lower-cased, words split at ASCII white space; a text's set has its
    distinct shingles of `shingle` words (all words, if there are fewer). Two texts are linked if
    100 * shared >= `percent` (over 50) * all shingles of both, and `component_id` is the smallest id
    reachable. Shingles are told apart by 64-bit hashes. A null, empty or blank text has an empty
    set and is linked with nothing: its component is its own id. Ids are integers, null ids count
    for no component's smallest; repeated rows are one set; an empty table gives none; other
    columns are ignored. No link between different sets is lost, and no number of partners is limited.
    """
    join = Join(df, percent, shingle, id_col, text_col)
    rows, shared = join.sets()
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("first")
    nodes = rows.filter("n > 0").groupBy("key").agg(first).select("key", "first.id", "first.row")
    meeting = join.meeting(shared)
    pairs = join.proposed(meeting)
    met = meeting.select(F.col("node").alias("key")).distinct()
    sets = join.wanted_sets(cut_lineage(nodes.join(met, "key", "left_semi").select("key", "row")))
    edges = join.confirmed(pairs, sets)
    ordered = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    rest = join.left_over(meeting, sets, edges).join(ordered, ["a", "b"], "left_anti")
    edges = edges.union(join.confirmed(rest, sets))
    labelled = nodes.join(components(edges), F.col("key") == F.col("node"), "left")
    labelled = labelled.select("key", "id", F.coalesce("root", "key").alias("root"))
    smallest = labelled.groupBy("root").agg(F.min("id").alias("component_id"))
    named = labelled.join(smallest, "root").select("key", "component_id")
    out = rows.join(named, "key", "left").select(
        F.col("id").cast(df.schema[id_col].dataType).alias(id_col),
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"),
    )
    return out
