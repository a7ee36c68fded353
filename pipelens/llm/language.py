"""Language identification by a byte convolutional network.

Bytes of a text (A-Z lower-cased) are cut into windows of 256; filters over 2, 3 and 4 bytes, max pooling and a
softmax give each window's probabilities, and the mean over all windows of the text decides. The network is trained in
numpy on labelled texts outside the held-out fold.

The training sample is bounded: at most MAX_TRAIN texts of each language (in order of a hash), of up to MAX_CHARS
characters, and of each at most four windows. Prediction covers whole texts of any length.

A null text, or one without a letter, is ``und`` with score 0; so is every text if nothing labelled is there to learn
from. Ties go to the smaller language name. Rows are judged one by one, so repeated rows agree; extra columns pass
through; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pipelens.llm.common import held_out
from pipelens.llm.convnet import ConvNet, window_slices
from pipelens.llm.shingles import _LOWER, texts_of

WINDOW = 256
MAX_TRAIN, MAX_CHARS = 400, 20_000
LETTER = regex.compile(r"\p{L}")


@dataclass
class LanguageModel:
    languages: list[str]
    net: ConvNet
    #: Below it a text shows no language: a twentieth of the way from chance to the least score of a training text.
    floor: float = 0.0

    def probabilities(self, column: pa.Array) -> Iterator[np.ndarray]:
        """(texts, languages) for runs of rows."""
        for _, data, offsets in texts_of(column):
            low = np.append(_LOWER[data], np.uint8(0))
            counts = np.diff(offsets)
            first, n, slices = window_slices(counts, WINDOW, self.net.beyond, 1024)
            found = [self.net.classify(self.net.pooled_bytes(low[at], WINDOW)) for at in slices]
            yield np.add.reduceat(np.concatenate(found), first, axis=0) / n[:, None]


def train(docs: DataFrame, max_train: int = MAX_TRAIN, max_chars: int = MAX_CHARS, seed: int = 7) -> LanguageModel | None:
    """Learns from text and non-null lang of documents outside the held-out fold; None without any."""
    usable = ~held_out("doc_id") & F.col("lang").isNotNull() & (F.length("text") > 0) & (F.length("text") <= max_chars)
    texts = docs.where(usable).select("doc_id", "lang", "text", F.xxhash64("text").alias("th"))
    # Ids first, without texts. The best of each of 64 parts of a language, so that no task ranks a whole language;
    # equal rows share a rank.
    ids = texts.select("doc_id", "lang", "th", F.xxhash64("doc_id", "th", F.lit(seed)).alias("h")).withColumn("part", F.pmod("h", F.lit(64)))
    few = ids.withColumn("k", F.dense_rank().over(Window.partitionBy("lang", "part").orderBy("h"))).where(F.col("k") <= -(-max_train // 64))
    few = few.select("doc_id", "lang", "th", "h").distinct()
    few = few.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id", "th"))).where(F.col("k") <= max_train)
    # Broadcast: max_train ids of each language. Copies of a chosen row are one text before they are collected.
    chosen = texts.join(F.broadcast(few.select("doc_id", "lang", "th", "h")), ["doc_id", "lang", "th"])
    sample = chosen.groupBy("lang", "h").agg(F.min("text").alias("text")).toPandas().sort_values(["lang", "h", "text"])
    if not len(sample):
        return None
    languages = sorted(sample["lang"].unique())
    rng, units, y = np.random.default_rng(seed), [], []
    for lang, text in zip(sample["lang"], sample["text"]):
        data = _LOWER[np.frombuffer(text.encode(), np.uint8)]
        n = -(-len(data) // WINDOW)
        for k in rng.permutation(n)[:4]:
            units.append(data[k * WINDOW : (k + 1) * WINDOW, None].astype(np.int32))
            y.append(languages.index(lang))
    net = ConvNet(256, dim=8, widths=(2, 3, 4), filters=8, classes=len(languages), seed=seed)
    y = np.array(y)
    share = np.bincount(y, minlength=len(languages))
    net.fit(units, y, WINDOW, epochs=max(4, min(40, 16_000 // len(y))), weight=len(y) / (len(languages) * np.maximum(share, 1)))
    model = LanguageModel(languages, net)
    chance = 1 / len(languages)
    least = min(float(p.max(1).min()) for p in model.probabilities(pa.array(sample["text"], pa.string())))
    model.floor = chance + max(0.0, least - chance) / 20
    return model


def identify(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """``docs`` with lang_pred and score."""
    docs = docs.drop("lang_pred", "score")
    if model is None:
        return docs.withColumns({"lang_pred": F.lit("und"), "score": F.lit(0.0)})

    @F.arrow_udf("struct<lang_pred: string, score: double>")
    def predict(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            names, scores = [], []
            texts = iter(column)
            for p in model.probabilities(column):
                for best, score in zip(p.argmax(1), p.max(1)):
                    text = next(texts).as_py()
                    if text is None or not LETTER.search(text):
                        names.append("und")
                        scores.append(0.0)
                    else:
                        names.append(model.languages[best])
                        scores.append(min(1.0, float(score)))
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["lang_pred", "score"])

    out = docs.select("*", predict(F.col("text").cast("string")).alias("__predicted_language"))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], "__predicted_language.lang_pred", "__predicted_language.score")
