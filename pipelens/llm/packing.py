"""Packing of token sequences by non-negative least squares over combinations of lengths.

A document's ids are cut into full windows and one rest. The histogram of the rests' lengths, ``window - 1`` bins at
most, is all that the plan needs. Combinations of up to ``depth`` lengths that fill a window exactly are enumerated;
their repeat counts x >= 0 solve min ||A x - histogram||, with A the lengths in each combination; x is rounded down,
and what that leaves of the histogram is packed greedily: the longest rest opens a window and the longest rests that
still fit follow. So a plan is a list of patterns with repeat counts, a few thousand rows whatever the size of the
corpus, and each rest finds its sequence and offset from its rank among the rests of its length.

Pieces that are equal in every column are one row with a count until the end. Ranks come from counts by (length,
bucket) and running counts within a bucket; a length has as many buckets as its own number of pieces asks for, so that
one that most rests share is dealt over many tasks, and rare ones are not split.

Ids are those of the tokenizer file. Where tiktoken computes the same thing it does the work; what it cannot do (white
space of a million characters) the tokenizers library does.

Null texts count as empty. Every document ends with ``end_id``, so that each gives at least one piece. Rows that repeat
an id are packed each for itself. An empty table gives an empty result; of extra columns only the id passes through.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pipelens.llm.common import staged

WINDOW = 1024
#: Rows of a bucket, about; a bucket is a part of one task's work.
BUCKET_ROWS = 4096


# --- plan, on the histogram ---------------------------------------------------------------------------------------


def combinations(lengths: np.ndarray, window: int, depth: int = 3) -> np.ndarray:
    """Rows of up to ``depth`` lengths (0: none), descending, of those that occur, which add up to ``window``."""
    there = np.zeros(window + 1, bool)
    there[lengths] = True
    rows = []
    if there[window]:
        rows.append(np.array([[window, 0, 0]]))
    a = lengths[(lengths < window) & (2 * lengths >= window)]
    a = a[there[window - a]]
    rows.append(np.stack([a, window - a, 0 * a], 1))
    if depth >= 3:
        x, y = np.meshgrid(lengths, lengths, indexing="ij")
        z = window - x - y
        good = (x >= y) & (y >= z) & (z > 0)
        x, y, z = x[good], y[good], z[good]
        good = there[z]
        rows.append(np.stack([x[good], y[good], z[good]], 1))
    return np.concatenate(rows).astype(np.int64).reshape(-1, 3)


def solve_nnls(combos: np.ndarray, histogram: np.ndarray, steps: int = 400) -> np.ndarray:
    """x >= 0 that minimises ||A x - histogram||, by accelerated projected gradients; A is applied by its indices.

    Errors are weighted down for short lengths, whose leftovers fill gaps easily, and the steps are scaled by the
    columns' share in the rows, which keeps them stable without a factorisation.
    """
    n = len(histogram)
    weight = np.sqrt(0.1 + np.arange(n) / n)
    weight[0] = 0

    def forward(x: np.ndarray) -> np.ndarray:
        return sum(np.bincount(combos[:, j], x, n) for j in range(combos.shape[1]))

    use = forward(np.ones(len(combos)))
    w2 = weight**2
    # A bound of the largest eigenvalue for each column: sum over its rows of the rows' sums.
    bound = sum(np.where(combos[:, j] > 0, (w2 * use)[combos[:, j]], 0) * 3 for j in range(combos.shape[1])) + 1e-9
    share = sum(np.where(combos[:, j] > 0, (histogram / np.maximum(use, 1))[combos[:, j]], np.inf if j == 0 else 0) for j in range(combos.shape[1]))
    x = share / np.maximum((combos > 0).sum(1), 1)
    y, t = x, 1.0
    for _ in range(steps):
        miss = w2 * (forward(y) - histogram)
        miss[0] = 0
        gradient = sum(miss[combos[:, j]] for j in range(combos.shape[1]))
        new = np.maximum(0, y - gradient / bound)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = np.maximum(0, new + (t - 1) / t_new * (new - x))
        x, t = new, t_new
    return x


def greedy(left: np.ndarray, window: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns for all of the histogram ``left``: longest first, each window filled with the longest that fit."""
    left, out = left.copy(), []
    while True:
        there = np.flatnonzero(left)
        if not len(there):
            return out
        pattern, room = [], window
        while room:
            k = np.searchsorted(there, room, "right") - 1
            if k < 0:
                break
            length = int(there[k])
            n = min(room // length, int(left[length]) - pattern.count(length))
            if n <= 0:
                there = np.delete(there, k)
                continue
            pattern += [length] * n
            room -= n * length
            there = there[: k + 1] if room else there
        counts = {p: pattern.count(p) for p in set(pattern)}
        repeat = min(int(left[p]) // c for p, c in counts.items())
        for p, c in counts.items():
            left[p] -= repeat * c
        out.append((tuple(pattern), repeat))


def plan(histogram: np.ndarray, window: int = WINDOW, depth: int = 3) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths that share a window) and how often each is used; they use the histogram up exactly."""
    left = histogram.astype(np.int64).copy()
    out: list[tuple[tuple[int, ...], int]] = []
    lengths = np.flatnonzero(left)
    if len(lengths):
        combos = combinations(lengths, window, depth)
        if len(combos):
            repeats = np.floor(solve_nnls(combos, left.astype(float)) + 1e-6).astype(np.int64)
            for k in np.argsort(-repeats, kind="stable"):
                if repeats[k] <= 0:
                    break
                pattern = tuple(int(p) for p in combos[k] if p)
                counts = {p: pattern.count(p) for p in set(pattern)}
                n = min(int(repeats[k]), *(int(left[p]) // c for p, c in counts.items()))
                if n > 0:
                    out.append((pattern, n))
                    for p, c in counts.items():
                        left[p] -= n * c
    return out + greedy(left, window)


# --- pieces ---------------------------------------------------------------------------------------------------------


@lru_cache(2)
def _encoder(tokenizer: str):
    """The vocabulary of the file, run by tiktoken where that gives the same ids, else by tokenizers.

    A byte-level BPE file without a normalizer that splits by the usual pattern is the same computation in both
    libraries; tiktoken takes a quarter of the time.
    """
    import json

    with open(tokenizer, encoding="utf-8") as f:
        spec = json.load(f)
    pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
    plain = spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
    if plain and model["type"] == "BPE" and not model.get("ignore_merges"):
        import public_tokenizers
        import tiktoken

        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        to_byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(shown))}
        special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        ranks = {bytes(to_byte[c] for c in token): k for token, k in model["vocab"].items() if token not in special}
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        in_order = [model["vocab"]["".join(m)] for m in merges]
        # tiktoken merges by id, so ids have to follow the order of the merges. Ids that special tokens have are kept.
        if all(a < b for a, b in zip(in_order, in_order[1:])) and len(ranks) == 256 + len(merges):
            fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)

            def ids(text: str) -> list[int]:
                try:
                    return fast.encode(text, allowed_special="all")
                except ValueError:  # its pattern gives up on very long white space
                    return _library(tokenizer)([text])[0]

            return lambda texts: [ids(t) for t in texts]
    return _library(tokenizer)


@lru_cache(1)
def _library(tokenizer: str):
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(tokenizer)
    return lambda texts: [x.ids for x in slow.encode_batch_fast(texts, add_special_tokens=False)]


def _cut(batches: Iterator[pa.RecordBatch], tokenizer: str, window: int, end_id: int) -> Iterator[pa.RecordBatch]:
    encode = _encoder(tokenizer)
    for batch in batches:
        doc, text = batch.column(0), batch.column(1)
        for at in range(0, len(batch), 64):
            rows = []
            texts = [t or "" for t in text[at : at + 64].to_pylist()]
            for doc_id, ids in zip(doc[at : at + 64].to_pylist(), encode(texts)):
                raw = np.append(np.asarray(ids, "<u4"), np.uint32(end_id)).astype("<u4")
                n = len(raw)
                data = raw.tobytes()
                for start in range(0, n, window):
                    part = data[4 * start : 4 * (start + window)]
                    rows.append((doc_id, start, len(part) // 4, zlib.crc32(part), n))
            columns = zip(*rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in columns], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            )


def cut_documents(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = 0) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens) of the pieces of every document."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        lambda batches: _cut(batches, tokenizer, window, end_id),
        "doc_id long, start long, length long, ids_crc32 long, doc_tokens long",
    )


def place_pieces(pieces: DataFrame, window: int = WINDOW, depth: int = 3) -> DataFrame:
    """``pieces`` with sequence_id and offset; pieces of 1 to ``window`` ids share sequences by the plan."""
    spark = pieces.sparkSession
    counts = {r.length: r.n for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # `window` rows at most
    histogram = np.zeros(window + 1, np.int64)
    for length, n in counts.items():
        histogram[length] = n
    rows, first = [], 0
    if histogram[window]:
        rows.append((window, 0, int(histogram[window]), 1, first, 0))
        first += int(histogram[window])
        histogram[window] = 0
    used = np.zeros(window + 1, np.int64)
    for pattern, n in plan(histogram, window, depth):
        at = 0
        for length in sorted(set(pattern), reverse=True):
            c = pattern.count(length)
            rows.append((length, int(used[length]), int(used[length]) + n * c, c, first, at))
            used[length] += n * c
            at += c * length
        first += n
    # Fewer than two rows for each combination or window of the greedy rest: bounded by `window` and `depth` alone.
    slots = spark.createDataFrame(rows, "length long, lo long, hi long, each long, first long, at long")

    columns = pieces.columns
    own_buckets = F.element_at(F.array(*[F.lit(max(1, -(-counts.get(n, 0) // BUCKET_ROWS))) for n in range(1, window + 1)]), F.col("length").cast("int"))
    own = pieces.groupBy(*columns).agg(F.count(F.lit(1)).alias("__n")).withColumn("__bucket", F.pmod(F.xxhash64(*columns), own_buckets))
    sums = own.groupBy("length", "__bucket").agg(F.sum("__n").alias("__n"))
    earlier = lambda w: F.coalesce(F.sum("__n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sums.select("length", "__bucket", earlier(Window.partitionBy("length").orderBy("__bucket")).alias("__base"))
    within = Window.partitionBy("length", "__bucket").orderBy(*columns)
    ranked = own.withColumn("__first", earlier(within)).join(starts, ["length", "__bucket"])
    # Equal pieces come apart again, in runs, so that a row of any count makes no long array.
    run = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("__n") - 1) / BUCKET_ROWS))).alias("__run")
    ranked = ranked.select(*columns, "__n", (F.col("__first") + F.col("__base")).alias("__rank"), run)
    last = F.least(F.col("__n") - 1, (F.col("__run") + 1) * BUCKET_ROWS - 1)
    ranked = ranked.select(*columns, "__rank", F.explode(F.sequence(F.col("__run") * BUCKET_ROWS, last)).alias("__step")).select(*columns, (F.col("__rank") + F.col("__step")).alias("rank"))
    hit = (F.col("s.length") == F.col("p.length")) & (F.col("p.rank") >= F.col("s.lo")) & (F.col("p.rank") < F.col("s.hi"))
    step = F.col("p.rank") - F.col("s.lo")
    return ranked.alias("p").join(F.broadcast(slots).alias("s"), hit).select(
        *[f"p.{c}" for c in pieces.columns],
        (F.col("s.first") + F.floor(step / F.col("s.each"))).cast("long").alias("sequence_id"),
        (F.col("s.at") + F.pmod(step, F.col("s.each")) * F.col("p.length")).cast("long").alias("offset"),
    )


def pack_documents(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = 0, depth: int = 3) -> DataFrame:
    """Pieces of all documents with their places in sequences of at most ``window`` ids."""
    return place_pieces(staged(cut_documents(docs, tokenizer, window, end_id), "pieces"), window, depth)
