"""From documents to packed sequences: each stage works on all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pipelens.llm import language, toxicity
from pipelens.llm.common import table
from pipelens.llm.entry import tokenizer_file
from pipelens.llm.line_dedup import dedup_lines
from pipelens.llm.minhash import near_duplicates
from pipelens.llm.packing import pack_documents
from pipelens.storage import discard, settled


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score reaches the threshold calibrated for their language go."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    if model is None:
        return docs
    scored = toxicity.score_toxicity(docs, model, "__score")
    return scored.where(F.col("__score") < model.limit("lang")).select(docs.columns)


def drop_unknown_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any letter go, and those in which the network sees no language.

    That is so where the best language is hardly likelier than all others, far below every text it was trained on.
    """
    model = language.train(docs)
    if model is None:
        return docs
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"])  # so that no column of docs is taken for a result
    found = language.identify(docs.select("text", row.alias("__row")), model)
    kept = found.where((F.col("lang_pred") != "und") & (F.col("score") >= model.floor))
    return kept.select(*[F.col("text") if c == "text" else F.col("__row").getField(c).alias(c) for c in docs.columns])


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeats of runs of lines are cut out of texts; documents of which nothing is left by that go."""
    cut = dedup_lines(docs.drop("n_removed"))
    left = cut.where((F.col("n_removed") == 0) | F.col("text").rlike(r"\S"))
    return left.select(*[F.lit(None).cast(t).alias(c) if c == "n_removed" else F.col(f"`{c}`") for c, t in docs.dtypes])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five words, 0.8) the document (id, text) that comes first stays, once.

    Documents without a word, or without an id, are in no group and stay.
    """
    found = near_duplicates(docs, k=5, percent=80)
    gone = found.where("not leader").select(F.col("doc_id").alias("__id"), F.col("th").alias("__th")).distinct()
    here = F.xxhash64(F.col("text").cast("string"))
    left = docs.join(gone, (F.col("doc_id") == F.col("__id")) & (here == F.col("__th")), "left_anti")
    repeated = found.where("leader and n_shingles > 0 and doc_id is not null").groupBy("doc_id", "th").count().where("count > 1")
    if repeated.isEmpty():
        return left
    repeated = repeated.select(F.col("doc_id").alias("__id"), F.col("th").alias("__th"), F.lit(True).alias("__again"))
    marked = left.join(repeated, (F.col("doc_id") == F.col("__id")) & (here == F.col("__th")), "left").select(*docs.columns, "__again")
    first = marked.where("__again").groupBy("doc_id", "text").agg(F.min(F.struct(*[c for c in docs.columns if c not in ("doc_id", "text")])).alias("__one"))
    once = first.select(*[F.col(c) if c in ("doc_id", "text") else F.col("__one").getField(c).alias(c) for c in docs.columns])
    return marked.where("__again is null").drop("__again").unionByName(once)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents left, with their places in sequences of at most 1024 ids."""
    return pack_documents(docs, tokenizer_file("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("language_id", drop_unknown_languages),
    ("line_dedup", drop_repeated_lines),
    ("minhash_dedup", drop_near_duplicates),
    ("packing", pack),
]

#: Models stand in two stages, which SQL cannot express; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before = docs
        docs = settled(lambda stage=stage, before=before: stage(spark, before, sf_dir), name)
        discard(before)
    return docs
