"""SimHash near-duplicates by anchor points of a covering code.

The anchors are the words of a product of perfect codes: two Golay (23, 12) codes and a Hamming
(15, 11) code on 61 of the 64 bits, with covering radius 3 + 3 + 1. Every fingerprint has one
home anchor, found by decoding its blocks. If x and y differ in at most t bits, the home of x
is also the home of y with those bits turned, so it lies within radius plus t of y. Each
fingerprint is therefore sent to all anchors that are home to a word within t bits of it, and
met there by the fingerprints at home: every link is seen, and each once. A code with 2**35
anchors keeps cells small at any number of fingerprints; about 170 copies of 16 bytes each are
exchanged for a distinct fingerprint at t = 2.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations, product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnwise.llm.anchors import STEP, mixed
from turnwise.llm.common import text_chunks
from turnwise.session import cut_lineage

GOLAY = 0b101011100011  # generator polynomial of the (23, 12) code


class Block:
    """A perfect code on `width` bits from `low` on; syndromes tell the coset of a word."""

    def __init__(self, low: int, width: int, radius: int, syndromes: list[int]):
        self.low, self.width, self.radius = low, width, radius
        self.syndrome_of_bit = syndromes
        size = 1 << max(s.bit_length() for s in syndromes)
        self.leader = np.zeros(size, np.int64)
        for w in range(radius + 1):
            for bits in combinations(range(width), w):
                self.leader[self._syndrome(bits)] = sum(1 << b for b in bits)
        half = width // 2
        self.half = half
        self.tables = [
            np.array([self._syndrome([b for b in range(n) if v >> b & 1], at) for v in range(1 << n)], np.int64)
            for at, n in ((0, half), (half, width - half))
        ]

    def _syndrome(self, bits, at: int = 0) -> int:
        s = 0
        for b in bits:
            s ^= self.syndrome_of_bit[at + b]
        return s

    def syndromes(self, x: np.ndarray) -> np.ndarray:
        """Of the block inside unsigned 64-bit words."""
        b = (x >> np.uint64(self.low)) & np.uint64((1 << self.width) - 1)
        low, high = b & np.uint64((1 << self.half) - 1), b >> np.uint64(self.half)
        return self.tables[0][low.astype(np.int64)] ^ self.tables[1][high.astype(np.int64)]

    def moves(self, threshold: int) -> list[np.ndarray]:
        """[w][syndrome]: differences between a word and the anchors that w turned bits reach and no fewer; -1 fills."""
        seen = [{int(d)} for d in self.leader]
        levels = [self.leader[:, None]]
        for w in range(1, threshold + 1):
            found = [set() for _ in self.leader]
            for bits in combinations(range(self.width), w):
                turned, s = sum(1 << b for b in bits), self._syndrome(bits)
                for k, d in enumerate((turned ^ self.leader[np.arange(len(self.leader)) ^ s]).tolist()):
                    if d not in seen[k]:
                        found[k].add(d)
            table = np.full((len(found), max(map(len, found))), -1, np.int64)
            for k, ds in enumerate(found):
                table[k, : len(ds)] = sorted(ds)
                seen[k] |= ds
            levels.append(table)
        return levels


def _golay_syndromes() -> list[int]:
    out = []
    for b in range(23):
        r = 1 << b
        for k in range(b, 10, -1):
            if r >> k & 1:
                r ^= GOLAY << (k - 11)
        out.append(r)
    return out


@cache
def code(threshold: int) -> tuple[list[Block], list[list[np.ndarray]]]:
    blocks = [Block(0, 23, 3, _golay_syndromes()), Block(23, 23, 3, _golay_syndromes()), Block(46, 15, 1, list(range(1, 16)))]
    return blocks, [b.moves(threshold) for b in blocks]


COVERED = np.uint64((1 << 61) - 1)


def homes(x: np.ndarray) -> np.ndarray:
    blocks, _ = code(0)
    out = x & COVERED
    for b in blocks:
        out = out ^ (b.leader[b.syndromes(x)].astype(np.uint64) << np.uint64(b.low))
    return out


def visits(x: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """(anchors, index into x) for all anchors home to a word within `threshold` bits."""
    blocks, moves = code(threshold)
    base, rows = x & COVERED, np.arange(len(x))
    anchors, owner = [], []
    syndromes = [b.syndromes(x) for b in blocks]
    for turned in product(range(threshold + 1), repeat=len(blocks)):
        if sum(turned) > threshold:
            continue
        at, who = base, rows
        for b, s, levels, w in zip(blocks, syndromes, moves, turned, strict=True):
            d = levels[w][s[who]]
            ok = d >= 0
            at = (at[:, None] ^ (d.astype(np.uint64) << np.uint64(b.low)))[ok]
            who = np.broadcast_to(who[:, None], d.shape)[ok]
        anchors.append(at)
        owner.append(who)
    return np.concatenate(anchors), np.concatenate(owner)


def shingle_hashes(texts: list[str | None], shingle: int, seed: int = 42, once: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of all word shingles of all texts (all words of a short one), and their number per text.

    With `once` those of a text are sorted and a repeated one counts once.
    """
    hashes, counts = [], []
    digest = xxhash.xxh64_intdigest
    for text in texts:
        ws = text.encode().lower().split() if text else []
        if len(ws) <= shingle:
            found = [digest(b" ".join(ws), seed)] if ws else []
        else:
            line = b" ".join(ws)
            ends = np.cumsum([len(w) + 1 for w in ws]) - 1
            starts = np.r_[0, ends[: len(ws) - shingle] + 1].tolist()
            found = [digest(line[a:b], seed) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)]
        found = np.array(found, np.uint64)
        hashes.append(np.unique(found) if once else found)
        counts.append(len(hashes[-1]))
    return np.concatenate([*hashes, np.zeros(0, np.uint64)]), np.array(counts, np.int64)


def majority(h: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each text the bits that over half of its hashes have."""
    votes = np.zeros((len(counts), 64), np.int64)
    if len(h):
        # bytes of zeros and ones, added eight at a time as 64-bit words, 255 rows at most
        lanes = np.unpackbits(h.astype("<u8").view(np.uint8), bitorder="little").view(np.uint64).reshape(-1, 8)
        pieces = -(-counts // 255)
        doc = np.repeat(np.arange(len(counts)), pieces)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        starts = np.repeat(np.cumsum(counts) - counts, pieces) + nth * 255
        sums = np.add.reduceat(lanes, starts, axis=0).view(np.uint8).reshape(-1, 64)
        np.add.at(votes, doc, sums)
    bits = (2 * votes > counts[:, None]).astype(np.uint8)
    return np.packbits(bits, axis=1, bitorder="little").view("<u8").reshape(-1)


def fingerprints(texts: list[str | None], shingle: int, seed: int = 42) -> np.ndarray:
    """Majority of the bits of the XXH64 of all word shingles, as unsigned 64-bit numbers."""
    return majority(*shingle_hashes(texts, shingle, seed))


def with_fingerprint(df: DataFrame, shingle: int, id_col: str, text_col: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in text_chunks(batch, text_col, 2 << 20):
                fp = fingerprints(texts, shingle)
                yield pa.RecordBatch.from_arrays([rows.column(id_col), pa.array(fp.view(np.int64))], [id_col, "fp"])

    rows = df.select(F.col(id_col).cast("long").alias(id_col), text_col)
    return rows.mapInArrow(run, f"`{id_col}` bigint, fp bigint")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable over `edges` (a, b), for nodes that have one.

    Large and small stars in turn until nothing changes; rounds grow with the logarithm of the
    longest path. Each round is checkpointed; only a count and a checksum come to the driver.
    """

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    def star(df: DataFrame, large: bool) -> DataFrame:
        both = df.union(df.select("b", "a")) if large else df.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        joined = both.join(low, "a")
        if large:
            return joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        own = low.select("a", F.col("m").alias("b"))
        return joined.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(own).distinct()

    df = cut_lineage(edges.select("a", "b").filter("a <> b").distinct())
    before = state(df)
    while before[0]:
        df = cut_lineage(star(star(df, True), False))
        after = state(df)
        if after == before:
            break
        before = after
    return df.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_duplicates(
    df: DataFrame, threshold: int = 2, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """id, `fingerprint` (16 hex digits) and `component_id`, one row per row of `df`.

    ASCII letters are lower-cased, shingles are `shingle` words (all words if there are fewer; none:
    fingerprint zero). Fingerprints that differ in `threshold` bits or fewer are linked and
    `component_id` is the smallest id reachable. Ids are integers; repeated rows share a
    component; an empty table gives none; other columns are ignored. Equal fingerprints are one
    node, so copies cost nothing beyond their own row. No count of partners is limited.
    """
    prints = cut_lineage(with_fingerprint(df, shingle, id_col, text_col))
    nodes = prints.groupBy("fp").agg(F.min(id_col).alias("first_id"))

    def at_home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(homes(x).view(np.int64)), b.column("fp"), b.column("first_id")], ["anchor", "home", "home_id"])

    def abroad(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            every = b.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(every), 2000):
                x = every[at : at + 2000]
                anchors, who = visits(x, threshold)
                cols = [pa.array(anchors.view(np.int64)), pa.array(x[who].view(np.int64))]
                yield pa.RecordBatch.from_arrays(cols, ["anchor", "guest"])

    home = nodes.mapInArrow(at_home, "anchor bigint, home bigint, home_id bigint")
    guest = nodes.select("fp").mapInArrow(abroad, "anchor bigint, guest bigint")
    links = home.join(guest, "anchor").filter((F.col("home") < F.col("guest")) & (F.bit_count(F.col("home").bitwiseXOR(F.col("guest"))) <= threshold))
    edges = links.join(nodes, F.col("guest") == F.col("fp")).select(F.col("home_id").alias("a"), F.col("first_id").alias("b"))
    roots = components(edges)
    labels = nodes.join(roots, nodes["first_id"] == roots["node"], "left")
    labels = labels.select("fp", F.coalesce("root", "first_id").alias("component_id"))
    return prints.join(labels, "fp").select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


LONG_WORDS = 4
LONG_BLOCKS = 64 * LONG_WORDS // 23


def long_fingerprints(h: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """(n, 4): 256 bits from four mixings of each shingle's hash."""
    return np.stack([majority(mixed(h + np.uint64((i + 1) * int(STEP) % (1 << 64))), counts) for i in range(LONG_WORDS)], 1)


def _set_keys(h: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """One hash for each set of sorted hashes."""
    parts = np.split(h, np.cumsum(counts)[:-1])
    return np.array([xxhash.xxh64_intdigest(p.tobytes()) for p in parts], np.uint64).view(np.int64)


@cache
def _golay_moves() -> tuple[Block, list[np.ndarray]]:
    block = Block(0, 23, 3, _golay_syndromes())
    return block, block.moves(1)


def long_cells(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cell, row, at home) of all anchors that are home to a block of 23 bits, one of them turned or none."""
    block, moves = _golay_moves()
    cells, rows, home = [], [], []
    for b in range(LONG_BLOCKS):
        word, shift = divmod(23 * b, 64)
        x = fp[:, word] >> np.uint64(shift)
        if shift > 41:
            x = x | fp[:, word + 1] << np.uint64(64 - shift)
        x = x & np.uint64((1 << 23) - 1)
        s = block.syndromes(x)
        for w, table in enumerate(moves):
            d = table[s]
            ok = d >= 0
            cells.append(((x.astype(np.int64)[:, None] ^ d) | b << 23)[ok])
            rows.append(np.broadcast_to(np.arange(len(x))[:, None], d.shape)[ok])
            home.append(np.full(len(rows[-1]), w == 0))
    return np.concatenate(cells), np.concatenate(rows), np.concatenate(home)


def most_bits_apart(similarity: float) -> int:
    """Bits of 256 that differ at a Jaccard similarity of texts of like length, and one standard error."""
    p = np.arccos(2 * similarity / (1 + similarity)) / np.pi
    n = 64 * LONG_WORDS
    return int(n * p + np.sqrt(n * p * (1 - p)))


#: 64-bit words of the parity sketch of a set.
SKETCH_WORDS = 8


def parity_sketches(h: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """(n, SKETCH_WORDS): each hash of a set turns one bit, so two sketches differ in at most as many bits as hashes that only one set has."""
    bit = mixed(h ^ np.uint64(int(STEP) >> 1)) % np.uint64(64 * SKETCH_WORDS)
    out = np.zeros((len(counts), SKETCH_WORDS), np.uint64)
    np.bitwise_xor.at(out, (np.repeat(np.arange(len(counts)), counts), (bit >> np.uint64(6)).astype(np.int64)), np.uint64(1) << (bit & np.uint64(63)))
    return out


def most_turned(total: np.ndarray, similarity: float) -> np.ndarray:
    """Bits in which the sketches of two similar sets of `total` hashes together differ at most.

    No more than the hashes that only one of them has; where that is so many that bits turn back, no more than
    expected and four standard errors.
    """
    most = np.floor(total * ((1 - similarity) / (1 + similarity)) + 1e-6)
    bits = 64 * SKETCH_WORDS
    left = (1 - 2 / bits) ** most
    return np.minimum(most, np.ceil(bits / 2 * (1 - left) + 4 * np.sqrt(bits / 4 * (1 - left * left))))


#: What a text proposes where it meets others of another label: the first, the nearest by the sketches, or all.
FIRST, NEAREST, ALL = range(3)


def _proposed(
    fp: np.ndarray, n: np.ndarray, label: np.ndarray, home: np.ndarray, cut: int, similarity: float, which: int, sketch: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, partner, how far apart): rows at home meet all rows; both of a pair have at most `cut` bits apart, another label, and sizes and sketches that allow the similarity."""
    size, far = len(fp), 1 << 20
    best, partner, found = np.full(size, far, np.int32), np.full(size, size), []
    for some in np.array_split(home, -(-len(home) * size // 4_000_000)):
        apart = sum(np.bitwise_count(fp[some, i][:, None] ^ fp[None, :, i]).astype(np.int32) for i in range(fp.shape[1]))
        small, large = np.minimum(n[some][:, None], n[None, :]), np.maximum(n[some][:, None], n[None, :])
        ok = (apart <= cut) & (label[some][:, None] != label[None, :]) & (small >= (similarity - 1e-9) * large)
        if sketch is not None:
            every_i, every_j = np.nonzero(ok)
            for at in range(0, len(every_i), 200_000):
                i, j = every_i[at : at + 200_000], every_j[at : at + 200_000]
                turned = np.bitwise_count(sketch[some[i]] ^ sketch[j]).sum(1, dtype=np.int64)
                total = n[some[i]] + n[j]
                ok[i, j] = turned <= most_turned(total, similarity)
                apart[i, j] = (turned << 12) // np.maximum(total, 1)
        if which == ALL:
            i, j = np.nonzero(ok)
            found.append((some[i], j, apart[i, j]))
            continue
        apart = np.where(ok, apart, far)
        for rows, there, axis in ((some, np.arange(size), 1), (np.arange(size), some, 0)):
            at = (apart if which == NEAREST else ~ok).argmin(axis)
            bits = np.take_along_axis(apart, np.expand_dims(at, axis), axis).reshape(-1)
            other = there[at]
            better = bits < best[rows] if which == NEAREST else other < partner[rows]
            better &= bits < far
            best[rows[better]], partner[rows[better]] = bits[better], other[better]
    if which == ALL:
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))
    rows = np.flatnonzero(partner < size)
    return rows, partner[rows], best[rows]


def distinct(df: DataFrame, similarity: float = 0.8, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of `df` that are first (by id) in their group of near copies; all columns as they are.

    Texts are near copies from a Jaccard similarity of `similarity` of their sets of word shingles on,
    groups are what chains of near copies connect. Two bits of 64 tell only texts
    that are nearly equal, so here a fingerprint has 256 bits of the distinct shingles and its eleven blocks of
    23 have the Golay code's words as anchors; a text visits the anchors that are home to a block
    with at most one bit turned, and meets there the texts at home. Pairs at an anchor that
    differ in no more bits than expected are candidates, and linked if the exact similarity of
    their sets (64-bit hashes of shingles) confirms it. A group of n copies has n * n pairs, so each text
    first proposes its first partner only, then the nearest one outside its group; texts that still have
    one are compared pair by pair. From the second round on a parity sketch of the sets refutes pairs at the anchor,
    before they are written, so texts just under the similarity cost comparisons and no rows. Texts of one set count once. Null and empty texts form one group. Ids are integers and need not be
    unique: rows are told apart by a 64-bit hash of id and text, and of rows equal in both one stays. A null id comes last. An empty table gives none.
    """
    cut = most_bits_apart(similarity)
    words = [f"f{i}" for i in range(LONG_WORDS)]
    fields = ", ".join(f"{w} bigint" for w in words)

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in text_chunks(batch, text_col, 2 << 20):
                h, counts = shingle_hashes(texts, shingle, once=True)
                fp = long_fingerprints(h, counts).view(np.int64)
                sketch = pa.array([s.tobytes() for s in parity_sketches(h, counts)], pa.binary())
                cols = [pa.array(_set_keys(h, counts)), pa.array(counts), rows.column("id"), rows.column("row"), sketch, *(pa.array(fp[:, i].copy()) for i in range(LONG_WORDS))]
                yield pa.RecordBatch.from_arrays(cols, ["key", "n", "id", "row", "sketch", *words])

    row = F.xxhash64(F.col(id_col), F.col(id_col).isNull(), F.col(text_col), F.col(text_col).isNull())
    rows = df.select(F.col(id_col).cast("long").alias("id"), row.alias("row"), text_col)
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("first")
    firsts = [F.first(c).alias(c) for c in ("n", "sketch", *words)]
    nodes = cut_lineage(rows.mapInArrow(prints, f"key bigint, n bigint, id bigint, row bigint, sketch binary, {fields}").groupBy("key").agg(first, *firsts))

    carried = ["key", "n", "label", *words, "sketch"]

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                fp = np.stack([part.column(w).to_numpy(zero_copy_only=False).view(np.uint64) for w in words], 1)
                cell, row, home = long_cells(fp)
                rest = part.select([c for c in part.schema.names if c in carried]).take(pa.array(row))
                yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(home), *rest.columns], ["cell", "home", *rest.schema.names])

    def met(labelled: DataFrame, which: int) -> DataFrame:
        """(a, b, apart): candidates between nodes of different labels."""

        def linked(table: pa.Table) -> pa.Table:
            cell, key = table.column("cell").to_numpy(), table.column("key").to_numpy()
            order = np.lexsort((key, cell))
            key, n, label, at_home = (table.column(c).to_numpy()[order] for c in ("key", "n", "label", "home"))
            fp = np.stack([table.column(w).to_numpy().view(np.uint64) for w in words], 1)[order]
            sketch = None
            if which != FIRST:
                flat = b"".join(table.column("sketch").to_pylist())
                sketch = np.frombuffer(flat, np.uint64).reshape(-1, SKETCH_WORDS)[order]
            edges = np.flatnonzero(np.r_[True, cell[order][1:] != cell[order][:-1], True])
            some = np.flatnonzero((np.diff(edges) > 1) & np.logical_or.reduceat(at_home, edges[:-1]))
            out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32))]
            for start, stop in zip(edges[some].tolist(), edges[some + 1].tolist(), strict=True):
                own = slice(start, stop)
                i, j, apart = _proposed(fp[own], n[own], label[own], np.flatnonzero(at_home[own]), cut, similarity, which, None if sketch is None else sketch[own])
                out.append((key[own][i], key[own][j], apart))
            a, b, apart = (np.concatenate(x) for x in zip(*out, strict=True))
            return pa.table({"a": a, "b": b, "apart": apart})

        some = carried[:-1] if which == FIRST else carried
        kinds = f"cell bigint, home boolean, key bigint, n bigint, label bigint, {fields}" + (", sketch binary" if which != FIRST else "")
        cells = labelled.select(*some).mapInArrow(sent, kinds)
        found = cells.withColumn("bucket", F.pmod(F.xxhash64("cell"), F.lit(buckets))).groupBy("bucket").applyInArrow(linked, "a bigint, b bigint, apart int")
        if which == FIRST:
            found = found.groupBy("a").agg(F.min("b").alias("b"))
        elif which == NEAREST:
            found = found.groupBy("a").agg(F.min(F.struct("apart", "b")).alias("m")).select("a", "m.b")
        return cut_lineage(found.select("a", "b"))

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in text_chunks(batch, text_col, 2 << 20):
                h, counts = shingle_hashes(texts, shingle, once=True)
                sets = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)], pa.int32()), pa.array(h.view(np.int64)))
                yield pa.RecordBatch.from_arrays([rows.column("key"), pa.array(_set_keys(h, counts)), sets], ["key", "own", "shingles"])

    def confirmed(pairs: DataFrame) -> DataFrame:
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        left, right = (sets.select(F.col("key").alias(k), F.col("shingles").alias(f"of_{k}")) for k in ("a", "b"))
        shared = F.size(F.array_intersect("of_a", "of_b"))
        either = F.size("of_a") + F.size("of_b") - shared
        return pairs.join(left, "a").join(right, "b").filter(shared >= (similarity - 1e-9) * either).select("a", "b")

    def labels_of(nodes: DataFrame, edges: DataFrame) -> DataFrame:
        return nodes.join(components(edges), F.col("key") == F.col("node"), "left").withColumn("label", F.coalesce("root", "key")).drop("node", "root")

    buckets = max(32, nodes.count() // 1000)
    pairs = met(nodes.withColumn("label", F.col("key")), FIRST)
    close = cut_lineage(nodes.join(pairs.select(F.col("a").alias("key")), "key", "left_semi"))
    buckets = max(32, close.count() // 1000)
    wanted = close.select("key", F.col("first.row").alias("first_row"))
    texts = rows.join(wanted, F.col("row") == F.col("first_row")).select("key", text_col)
    sets = texts.mapInArrow(shingles, "key bigint, own bigint, shingles array<bigint>").filter("key = own")
    sets = cut_lineage(sets.dropDuplicates(["key"]))
    edges = cut_lineage(confirmed(pairs))
    for which in (NEAREST, ALL):
        pairs = met(labels_of(close, edges), which)
        if pairs.isEmpty():
            break
        close = close.join(pairs.select(F.col("a").alias("key")).distinct(), "key", "left_semi")
        edges = cut_lineage(edges.union(confirmed(pairs)))
    kept = labels_of(nodes, edges).groupBy("label").agg(F.min("first").alias("first")).select(F.col("first.row").alias("__first"))
    return df.withColumn("__row", row).join(kept, F.col("__row") == F.col("__first"), "left_semi").dropDuplicates(["__row"]).drop("__row")
