"""Toxicity by compression distance.

Each window of a text is compressed with two zstandard dictionaries that share a base of
ordinary text and differ in what was trained for toxic and for ordinary text. Where the toxic
one saves bytes, the window resembles toxic text. Thresholds on these savings are turned into
features of the text, and a logistic model calibrated on labelled rows gives the score.

Class content is trained by halves: from windows that the base compresses worst, then for some
rounds from those windows of one half that the dictionary of the other half shortens, so that
only what recurs across texts stays.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnwise.llm.common import text_chunks

STEPS = (2, 3, 4, 6)


@dataclass(frozen=True)
class ToxicitySettings:
    """`rows_per_class` and `most_bytes` bound the labelled sample (rows longer than that are not learnt from)."""

    rows_per_class: int = 3000
    most_bytes: int = 65536
    base_bytes: int = 262144
    class_bytes: int = 8192
    window: int = 192
    train_window: int = 48
    worst_share: float = 0.05
    rounds: int = 5
    saving: int = 3
    level: int = 6


def windows(text: str | None, size: int) -> list[bytes]:
    """Consecutive stretches that end at the first word end from `size` bytes on (at 4 * size at most)."""
    line = b" ".join(text.encode().split()) if text else b""
    out, at = [], 0
    while at < len(line):
        end = line.find(b" ", at + size, at + 4 * size)
        if end < 0:
            end = min(at + 4 * size, len(line)) if len(line) - at > 4 * size else len(line)
        out.append(line[at:end])
        at = end + (line[end : end + 1] == b" ")
    return out


def _compressor(content: bytes, level: int) -> zstandard.ZstdCompressor:
    data = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    data.precompute_compress(level=level)
    return zstandard.ZstdCompressor(
        dict_data=data, level=level, write_content_size=False, write_checksum=False, write_dict_id=False
    )


def _lengths(compressor: zstandard.ZstdCompressor, chunks: list[bytes]) -> np.ndarray:
    if not chunks:
        return np.zeros(0, np.int64)
    return np.array([len(s) for s in compressor.multi_compress_to_buffer(chunks)], np.int64)


def _dictionary(samples: list[bytes], size: int, **k) -> bytes:
    """Trained content; the samples themselves where there are too few to train on."""
    try:
        return zstandard.train_dictionary(size, samples, **k).as_bytes()
    except zstandard.ZstdError:
        return b" ".join(samples)[-size:]


@dataclass
class ToxicityModel:
    settings: ToxicitySettings
    toxic: bytes
    ordinary: bytes
    center: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_pair"}

    def savings(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Bytes saved by the toxic dictionary in each window, and windows per text."""
        if not hasattr(self, "_pair"):
            self._pair = [_compressor(c, self.settings.level) for c in (self.ordinary, self.toxic)]
        lists = [windows(t, self.settings.window) for t in texts]
        flat = [w for x in lists for w in x]
        return _lengths(self._pair[0], flat) - _lengths(self._pair[1], flat), np.array([len(x) for x in lists], np.int64)

    def features(self, texts: list[str | None]) -> np.ndarray:
        gain, counts = self.savings(texts)
        out = np.zeros((len(texts), 4 + len(STEPS) + 1))
        some = np.flatnonzero(counts)
        if not len(some):
            return out
        n = counts[some]
        doc = np.repeat(np.arange(len(some)), n)
        order = np.lexsort((-gain, doc))
        ranked, starts = gain[order], np.cumsum(n) - n
        nth = np.arange(len(ranked)) - np.repeat(starts, n)
        top = np.add.reduceat(np.where(nth < 3, ranked, 0), starts) / np.minimum(n, 3)
        cols = [ranked[starts], top, np.add.reduceat(gain, starts) / n]
        cols += [np.add.reduceat((gain >= s).astype(float), starts) / n for s in STEPS]
        cols += [np.log1p(np.add.reduceat((gain >= 3).astype(float), starts)), np.log1p(n)]
        out[some] = np.stack(cols, 1)
        return out

    def scores(self, texts: list[str | None]) -> np.ndarray:
        x = (self.features(texts) - self.center) / self.scale
        return 1 / (1 + np.exp(-np.clip(self.weights[0] + x @ self.weights[1:], -30, 30)))


def _fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    x = np.c_[np.ones(len(x)), x]
    w, total = np.zeros(x.shape[1]), weight.sum()
    penalty = ridge * total * np.r_[0.0, np.ones(x.shape[1] - 1)]
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hess = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + np.diag(penalty + 1e-9)
        step = np.linalg.solve(hess, x.T @ (weight * (p - y)) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(toxic: list[str], ordinary: list[str], class_counts: tuple[int, int], settings: ToxicitySettings) -> ToxicityModel:
    """From two lists of texts in any fixed order; `class_counts` are the labelled rows behind each."""
    s = settings
    cut_t, cut_o = max(1, int(len(toxic) * 0.7)), max(1, int(len(ordinary) * 0.7))
    learn_t, learn_o = toxic[:cut_t], ordinary[:cut_o]
    base_texts = learn_o[: max(1, 2 * len(learn_o) // 3)]
    base = _dictionary([w for t in base_texts for w in windows(t, 200)], s.base_bytes)
    plain = _compressor(base, s.level) if base else None

    def special(texts: list[str]) -> bytes:
        halves = [[w for t in texts[i::2] for w in windows(t, s.train_window)] for i in (0, 1)]
        if plain is None or not all(halves):
            return b""
        alone = [_lengths(plain, h) for h in halves]
        chosen = []
        for h, n in zip(halves, alone, strict=True):
            excess = n - 0.45 * np.array([len(w) for w in h])
            chosen.append([h[i] for i in np.argsort(-excess, kind="stable")[: int(len(h) * s.worst_share) + 1].tolist()])
        for _ in range(s.rounds):
            kinds = [_compressor(_dictionary(c, s.class_bytes, k=24, d=6) + base, s.level) for c in chosen]
            found = []
            for i in (0, 1):
                saved = alone[i] - _lengths(kinds[1 - i], halves[i])
                found.append([halves[i][j] for j in np.flatnonzero(saved >= s.saving).tolist()])
            if not all(found):
                break
            chosen = found
        return _dictionary(chosen[0] + chosen[1], s.class_bytes, k=24, d=6)

    model = ToxicityModel(s, special(learn_t) + base, special(learn_o[len(base_texts) :]) + base, np.zeros(1), np.ones(1), np.zeros(1))
    rest_t, rest_o = toxic[cut_t:] or toxic, ordinary[cut_o:] or ordinary
    x = model.features(rest_t + rest_o)
    y = np.r_[np.ones(len(rest_t)), np.zeros(len(rest_o))]
    weight = np.r_[np.full(len(rest_t), class_counts[0] / max(len(rest_t), 1)), np.full(len(rest_o), class_counts[1] / max(len(rest_o), 1))]
    if len(x):
        model.center, model.scale = x.mean(0), x.std(0) + 1e-9
    else:
        model.center, model.scale = np.zeros(x.shape[1]), np.ones(x.shape[1])
    if rest_t and rest_o:
        model.weights = _fit_logistic((x - model.center) / model.scale, y, weight)
    else:  # one class only, or no label at all
        model.weights = np.r_[3.0 if rest_t else -3.0, np.zeros(x.shape[1])]
    return model


def fit(df: DataFrame, labels: DataFrame, settings: ToxicitySettings = ToxicitySettings(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> ToxicityModel:
    """Learn from the rows of `labels` (id, 0 or 1; others and nulls are ignored) found in `df`.

    The ids come first: at most `rows_per_class` of each label in the order of a hash of the id.
    They are few, so `df` is scanned once against them without a shuffle, and their texts, at
    most `most_bytes` each, come to the driver.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).filter("label IN (0, 1) AND id IS NOT NULL")
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    ids = None
    for label in (0, 1):
        part = known.filter(F.col("label") == label).orderBy(F.xxhash64("id"), "id").limit(settings.rows_per_class)
        ids = part if ids is None else ids.union(part)
    texts = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter(F.octet_length("text") <= settings.most_bytes)
    found = texts.join(F.broadcast(ids.dropDuplicates(["id"])), "id")
    rows = found.orderBy(F.xxhash64("id"), "id", "text").select("text", "label").collect()
    split = {label: [r["text"] for r in rows if r["label"] == label] for label in (0, 1)}
    return train(split[1], split[0], (counts.get(1, 0), counts.get(0, 0)), settings)


def score(df: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, `score` (0 to 1) and `predicted` (1 from 0.5 on) for each row of `df`; whole texts.

    Only the text counts. Null and empty texts have no window and get the score of a text without
    any saving. Repeated rows give equal rows, an empty table none, other columns are ignored. A model
    learnt without one of the classes gives a constant. No shuffle; the model is under 1 MB.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in text_chunks(batch, text_col):
                s = model.scores(texts)
                yield pa.RecordBatch.from_arrays(
                    [rows.column(id_col), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], [id_col, "score", "predicted"]
                )

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, score double, predicted int")


def clean(df: DataFrame, model: ToxicityModel, text_col: str = "text") -> DataFrame:
    """The rows of `df`, all columns as they are, whose texts the model does not predict toxic."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in text_chunks(batch, text_col):
                yield rows.filter(pa.array(model.scores(texts) < 0.5))

    return df.mapInArrow(run, df.schema)
