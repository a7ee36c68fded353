"""Toxicity by a convolutional network over hashed words.

A word (bytes outside ASCII, letters and digits; A-Z lower-cased) is the sum of hashed embeddings of itself and of its
first four and five bytes. Filters over 1, 2 and 3 words, max pooling over the whole text and a softmax give the score.
The network is trained in numpy on labelled texts outside the held-out fold; one dimension of the embeddings starts
from how much oftener a feature stands in toxic texts than in others.

The training sample is bounded: at most MAX_TRAIN documents of either label (in order of a hash), one text of each, of
up to MAX_CHARS characters. Scoring covers whole texts of any length. Thresholds are calibrated by language on a part of the sample
that the weights were not fitted to: the one of best F1 where a language has MIN_POSITIVE positive texts there, the
overall one else. Language chooses a threshold only; it is no input of a score.

A null or empty text is scored as a text without words. Without labelled texts every score is 0. Rows are scored one by
one; extra columns pass through; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pipelens.llm.common import held_out
from pipelens.llm.convnet import ConvNet, window_slices
from pipelens.llm.shingles import CHUNK, Words, long_hashes, texts_of

BUCKETS = 1 << 16
WINDOW, PREFIXES = 128, (4, 5)
MAX_TRAIN, MAX_CHARS = 2048, 20_000
MIN_POSITIVE = 20
THRESHOLD = 0.3
_BREAK = np.ones(256, bool)
_BREAK[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def word_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets (words, 3) of each word and of its two prefixes, from 1; how many words each text has."""
    if len(data) > CHUNK and len(offsets) == 2:
        h = long_hashes(data, PREFIXES, _BREAK)
        counts = np.array([len(h)])
    else:
        words = Words(data, offsets, _BREAK)
        h = np.stack([words.span_hash(words.start, np.minimum(words.stop, words.start + size)) for size in (1 << 30, *PREFIXES)], 1)
        counts = np.diff(words.first)
    places = np.array([7 * j for j in range(h.shape[1])], np.uint64)
    return ((h >> places) % np.uint64(BUCKETS - 1) + np.uint64(1)).astype(np.int32), counts


@dataclass
class ToxicityModel:
    net: ConvNet
    thresholds: dict[str, float] = field(default_factory=dict)
    threshold: float = THRESHOLD

    def scores(self, column: pa.Array) -> Iterator[np.ndarray]:
        for _, data, offsets in texts_of(column):
            units, counts = word_features(data, offsets)
            units = np.concatenate([units, np.zeros((1, 3), np.int32)])
            first, _, slices = window_slices(counts, WINDOW, self.net.beyond, 256)
            found = [self.net.pooled(units[at], WINDOW) for at in slices]
            yield self.net.classify(np.maximum.reduceat(np.concatenate(found), first, axis=0))[:, 1].astype(float)

    def limit(self, lang: str | Column) -> Column:
        """The threshold for a column of languages."""
        lang = F.col(lang) if isinstance(lang, str) else lang
        out = F.lit(self.threshold)
        for name, value in sorted(self.thresholds.items()):
            out = F.when(lang == name, F.lit(value)).otherwise(out)
        return out


def _calibrate(score: np.ndarray, y: np.ndarray) -> float:
    """The middle of the range of thresholds with the best F1."""
    order = np.argsort(-score)
    s, hit = score[order], np.cumsum(y[order])
    f1 = 2 * hit / (np.arange(1, len(y) + 1) + y.sum())
    best = int(len(f1) - 1 - np.argmax(f1[::-1]))
    below = s[best + 1] if best + 1 < len(s) else 0.0
    return float((s[best] + below) / 2)


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, max_chars: int = MAX_CHARS, seed: int = 7) -> ToxicityModel | None:
    """Learns from the labels of documents outside the held-out fold; None without both kinds of label."""
    marks = labels.where(~held_out("doc_id") & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    part = Window.partitionBy("toxic", "part").orderBy("h", "doc_id")
    chosen = (
        marks.select("doc_id", "toxic", F.pmod(F.xxhash64("doc_id"), F.lit(64)).alias("part"), F.xxhash64("doc_id", F.lit(seed)).alias("h"))
        .withColumn("k", F.row_number().over(part))
        .where(F.col("k") <= -(-max_train // 64))
        .select("doc_id", "toxic", "h")
    )
    # Broadcast: ids only, 2 * (max_train + 63) rows at most.
    texts = docs.select("doc_id", "lang", "text").where((F.length("text") > 0) & (F.length("text") <= max_chars))
    rows = texts.join(F.broadcast(chosen), "doc_id")
    # One text of an id, however many rows repeat it: the one of least hash.
    one = rows.groupBy("doc_id", "toxic", "h").agg(F.min(F.struct(F.xxhash64("text"), "text", "lang")).alias("t"))
    sample = one.select("t.lang", "t.text", "toxic", "h").toPandas().sort_values(["h", "text"], ignore_index=True)
    y = sample["toxic"].to_numpy(int) if len(sample) else np.zeros(0, int)
    if len(set(y.tolist())) < 2:
        return None
    units: list[np.ndarray] = []
    for _, data, offsets in texts_of(pa.array(sample["text"], pa.string())):
        found, counts = word_features(data, offsets)
        units += np.split(found, np.cumsum(counts)[:-1])
    held = np.arange(len(y)) % 5 == 4 if (y == 1).sum() >= 5 * MIN_POSITIVE else np.zeros(len(y), bool)
    fit = np.flatnonzero(~held)

    # Start: log odds of the features, shrunk for those that few toxic texts have.
    df = np.zeros((2, BUCKETS))
    for i in fit:
        df[y[i], np.unique(units[i])] += 1
    n = np.array([(y[fit] == 0).sum(), (y[fit] == 1).sum()])
    odds = np.log((df[1] + 0.5) / (n[1] + 1)) - np.log((df[0] + 0.5) / (n[0] + 1))
    net = ConvNet(BUCKETS, dim=8, widths=(1, 2, 3), filters=8, classes=2, seed=seed)
    net.p["E"] *= np.float32(0.1)
    net.p["E"][:, 0] = np.maximum(0, odds * df[1] / (df[1] + 5)) / 2
    net.p["E"][0] = 0
    for w in net.widths:
        net.p[f"W{w}"][:, 0, :2] = 1.0 / w**0.5
    net.p["U"][: net.filters * len(net.widths)] *= np.float32(0.3)
    epochs = max(3, min(12, 24_000 // len(fit)))
    net.fit([units[i] for i in fit], y[fit], WINDOW, epochs=epochs, rate=0.005)

    model = ToxicityModel(net)
    if held.any():
        score = np.concatenate(list(model.scores(pa.array(sample["text"][held], pa.string()))))
        truth, lang = y[held], sample["lang"][held].to_numpy()
        model.threshold = _calibrate(score, truth)
        for name in sorted({x for x in lang if x is not None}):
            own = lang == name
            if truth[own].sum() >= MIN_POSITIVE and (truth[own] == 0).sum() >= MIN_POSITIVE:
                model.thresholds[name] = _calibrate(score[own], truth[own])
    return model


def score_toxicity(docs: DataFrame, model: ToxicityModel | None, column: str = "score") -> DataFrame:
    """``docs`` with the score, 0 to 1, in ``column``."""
    docs = docs.drop(column)
    if model is None:
        return docs.withColumn(column, F.lit(0.0))

    @F.arrow_udf("double")
    def score(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in columns:
            yield pa.array(np.concatenate([np.zeros(0), *model.scores(texts)]), pa.float64())

    return docs.withColumn(column, score(F.col("text").cast("string")))
