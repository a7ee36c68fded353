"""Feature transformers: fitted by aggregations, applied as column expressions.

``fit`` collects what it learns where that is a few numbers a column or at most LITERALS categories, and keeps it as
literals, so that applying a transformer is a projection that stays in the same stage as its input, and no data moves.
More categories, and word vectors, are written as a table that rows are joined with. Outputs are the column ``array``;
an imputer and a function transformer keep their input's names.
"""

from __future__ import annotations

import re
import uuid
from abc import ABC, abstractmethod
from collections.abc import Callable, Iterable, Iterator, Sequence
from itertools import batched
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pipelens.operators.frame import ORD, InspectedFrame, is_hidden, q, tracked
from pipelens.plans.model import OperatorType
from pipelens.storage import order_statistics, ordinal, staged

MODULE = "pipelens.functions"
#: Up to this many categories of a column are literals of the plan; more are a table.
LITERALS = 1000


class Transformer(ABC):
    keeps_names = False
    imputes = False

    def arguments(self) -> dict[str, Any]:
        return dict(self.__dict__["args"]) if "args" in self.__dict__ else {}

    @abstractmethod
    def learn(self, df: DataFrame, columns: Sequence[str]) -> None: ...

    @abstractmethod
    def outputs(self, columns: Sequence[str]) -> dict[str, Column]:
        """Output columns by name; of those that do not keep names one, ``array``."""

    def attach(self, df: DataFrame, columns: Sequence[str]) -> DataFrame:
        """``df``, a row for a row, with what ``outputs`` looks up in tables, in columns that start with ``__look``."""
        return df

    def fit(self, frame: InspectedFrame) -> Transformer:
        frame = tracked(frame)
        self.learn(frame.hidden, frame.columns)
        return self

    def transform(self, frame: InspectedFrame, description: str | None = None) -> InspectedFrame:
        frame = tracked(frame)
        made = self.outputs(frame.columns)
        source = [q(frame.columns[0]).alias("__in")] if type(self).__name__ == "Word2Vec" else []

        def change(df: DataFrame) -> DataFrame:
            return self.attach(df, frame.columns).select(*[v.alias(k) for k, v in made.items()], *source, *[q(c) for c in df.columns if is_hidden(c) and c != "__in"])

        said = description or self.describe()
        return frame._unary(OperatorType.TRANSFORMER, (MODULE, type(self).__name__), said, change, list(made), self.arguments(), self.imputes)

    def describe(self) -> str:
        return type(self).__name__

    def fit_transform(self, frame: InspectedFrame) -> InspectedFrame:
        return self.fit(frame).transform(frame, f"{self.describe()}: fit_transform")


def _array(values: Sequence[Column]) -> dict[str, Column]:
    return {"array": F.array(*[v.cast("double") for v in values])}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body and its lambdas use it."""
    return F.element_at(F.transform(F.array(value), lambda x: body(x)), 1)


def hot(n: int) -> Callable[[Column], Column]:
    return lambda at: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.when(at == i, 1.0).otherwise(0.0))


class StandardScaler(Transformer):
    """(x - mean) / population deviation; constant columns are only shifted."""

    def __init__(self, with_mean: bool = True, with_std: bool = True):
        self.args = {"with_mean": with_mean, "with_std": with_std}

    def learn(self, df, columns):
        found = df.agg(*[f(q(c).cast("double")).alias(f"{n}{i}") for i, c in enumerate(columns) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
        self.mean = [found[f"m{i}"] or 0.0 for i in range(len(columns))]
        self.scale = [found[f"s{i}"] or 1.0 for i in range(len(columns))]

    def outputs(self, columns):
        shift = self.mean if self.args["with_mean"] else [0.0] * len(columns)
        scale = self.scale if self.args["with_std"] else [1.0] * len(columns)
        return _array([(q(c).cast("double") - F.lit(m)) / F.lit(s) for c, m, s in zip(columns, shift, scale)])


def look_up(df: DataFrame, column: str, table: DataFrame, name: str) -> DataFrame:
    """``df`` with ``name`` from ``table(__key, name)``, whose keys are distinct; null where there is none."""
    return df.join(table, q(column).eqNullSafe(F.col("__key")), "left").drop("__key")


class OneHotEncoder(Transformer):
    """0/1 for each category, sorted. ``handle_unknown``: "error" fails on a category that fit did not see, "ignore" gives zeros.

    A row's array has a number for each category, however many there are.
    """

    def __init__(self, handle_unknown: str = "error", sparse: bool = False):
        self.args = {"handle_unknown": handle_unknown, "sparse": sparse}

    def learn(self, df, columns):
        self.categories: list[list | None] = []
        self.tables: list[DataFrame | None] = []
        self.sizes, self.names = [], []
        for c in columns:
            values = df.select(q(c).alias("__key")).distinct()
            order = F.col("__key").asc_nulls_last()
            rows = values.orderBy(order).limit(LITERALS + 1).collect()
            few = len(rows) <= LITERALS
            name = f"__look_{uuid.uuid4().hex}"
            table = None if few else staged(ordinal(values, [order], name), "categories")
            self.categories.append([r[0] for r in rows] if few else None)
            self.tables.append(table)
            self.sizes.append(len(rows) if few else table.count())
            self.names.append(name)

    def attach(self, df, columns):
        for c, table, name in zip(columns, self.tables, self.names):
            if table is not None:
                df = look_up(df, c, table, name)
        return df

    def _code(self, c: str, values: list | None, name: str) -> Column:
        if values is None:
            return q(name).cast("int")
        known = [x for i, v in enumerate(values) if v is not None for x in (F.lit(v), F.lit(i))]
        at = F.try_element_at(F.create_map(*known), q(c)) if known else F.lit(None).cast("int")
        return F.when(q(c).isNull(), F.lit(len(values) - 1)).otherwise(at) if None in values else at

    def outputs(self, columns):
        parts = []
        for c, values, size, name in zip(columns, self.categories, self.sizes, self.names):
            at = self._code(c, values, name)
            if self.args["handle_unknown"] == "error":
                at = F.coalesce(at, F.raise_error(F.concat(F.lit(f"unknown category in {c}: "), F.coalesce(q(c).cast("string"), F.lit("null")))).cast("int"))
            if not size:
                parts.append(F.array().cast("array<double>"))
            else:
                parts.append(F.array(*[F.when(at == i, 1.0).otherwise(0.0) for i in range(size)]) if size <= 64 else let(at, hot(size)))
        return {"array": F.concat(*parts)}


class SimpleImputer(Transformer):
    """Nulls become the column's mean, median, most frequent value (the least of equals) or a constant."""

    keeps_names = imputes = True

    def __init__(self, strategy: str = "mean", fill_value: Any = None, missing_values: Any = None):
        self.args = {"strategy": strategy, "fill_value": fill_value, "missing_values": missing_values}

    def _value(self, c: str) -> Column:
        missing = self.args["missing_values"]
        return q(c) if missing is None else F.when(q(c) != F.lit(missing), q(c))

    def learn(self, df, columns):
        how = self.args["strategy"]
        if how == "constant":
            self.fill = [self.args["fill_value"]] * len(columns)
            return
        if how == "most_frequent":
            self.fill = []
            for c in columns:  # counts by value are combined before they move; the mode() aggregate would gather all values
                best = df.groupBy(self._value(c).alias("v")).count().where("v is not null").orderBy(F.desc("count"), "v").limit(1).collect()
                self.fill.append(best[0].v if best else None)
            return
        if how == "median":
            self.fill = [order_statistics(df, self._value(c), [0.5])[0] for c in columns]
        else:
            self.fill = list(df.agg(*[F.avg(self._value(c)).alias(f"v{i}") for i, c in enumerate(columns)]).first())

    def outputs(self, columns):
        return {c: F.coalesce(self._value(c), F.lit(v)) if v is not None else self._value(c) for c, v in zip(columns, self.fill)}


class KBinsDiscretizer(Transformer):
    """Bins of equal width ("uniform"), of equal counts ("quantile") or around 1-d k-means centres; values outside are clipped.

    Quantiles are exact; ``exact=False`` takes sketches. K-means starts at the middles of bins of equal width and goes on
    until no centre moves, over counts of the distinct values.
    """

    def __init__(self, n_bins: int = 5, encode: str = "ordinal", strategy: str = "uniform", exact: bool = True, max_iter: int = 300):
        self.args = {"n_bins": n_bins, "encode": encode, "strategy": strategy}
        self.exact, self.max_iter = exact, max_iter

    def learn(self, df, columns):
        n, how = self.args["n_bins"], self.args["strategy"]
        if how == "quantile":
            shares = [k / n for k in range(n + 1)]
            if self.exact:
                found = [order_statistics(df, q(c), shares) for c in columns]
            else:
                take = [F.percentile_approx(q(c).cast("double"), shares).alias(f"v{i}") for i, c in enumerate(columns)]
                found = [v or [] for v in df.agg(*take).first()]
            self.edges = [sorted({v for v in f if v is not None}) for f in found]
            return
        r = df.agg(*[f(q(c).cast("double")).alias(f"{k}{i}") for i, c in enumerate(columns) for k, f in (("lo", F.min), ("hi", F.max))]).first()
        spans = [(r[f"lo{i}"], r[f"hi{i}"]) for i in range(len(columns))]
        self.edges = [[] if lo is None else [float(e) for e in np.linspace(lo, hi, n + 1)] for lo, hi in spans]
        if how == "kmeans":
            self.edges = [self._around_centres(df, c, edges) if edges else [] for c, edges in zip(columns, self.edges)]

    def _around_centres(self, df: DataFrame, c: str, edges: list[float]) -> list[float]:
        values = staged(df.select(q(c).cast("double").alias("v")).where("v is not null").groupBy("v").agg(F.count(F.lit(1)).alias("n")), "values")
        centres = [(a + b) / 2 for a, b in zip(edges, edges[1:])]
        for _ in range(self.max_iter):
            between = [(a + b) / 2 for a, b in zip(centres, centres[1:])]
            own = sum((F.when(F.col("v") >= F.lit(e), 1).otherwise(0) for e in between), F.lit(0))
            found = values.groupBy(own.alias("k")).agg((F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias("m")).collect()  # a row for each bin
            new = list(centres)
            for r in found:
                new[r["k"]] = r["m"]
            if new == centres:
                break
            centres = new
        return [edges[0], *[(a + b) / 2 for a, b in zip(centres, centres[1:])], edges[-1]]

    def outputs(self, columns):
        out = []
        for c, edges in zip(columns, self.edges):
            x, bins = q(c).cast("double"), max(1, len(edges) - 1)
            code = F.when(x.isNotNull(), sum((F.when(x >= F.lit(float(e)), 1.0).otherwise(0.0) for e in edges[1:-1]), F.lit(0.0)))
            if self.args["encode"] == "ordinal":
                out.append(code)
            else:
                out += [F.when(code == float(k), 1.0).otherwise(0.0) for k in range(bins)]
        return _array(out)


class FunctionTransformer(Transformer):
    """A function of a column's expression, or with ``vectorized`` a pandas function of its values (Arrow batches)."""

    keeps_names = True

    def __init__(self, func: Callable, vectorized: bool = False, returns: str = "double", **kw_args: Any):
        self.func, self.vectorized, self.returns = func, vectorized, returns
        self.args = {"kw_args": kw_args, "vectorized": vectorized}

    def learn(self, df, columns):
        return None

    def outputs(self, columns):
        f, kw = self.func, self.args["kw_args"]
        if self.vectorized:
            @F.pandas_udf(self.returns)
            def apply(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
                for values in batches:
                    yield f(values, **kw)

            return {c: apply(q(c)) for c in columns}
        return {c: f(q(c), **kw) for c in columns}


TOKEN = r"\b\w\w+\b"
#: Bytes of text whose words are hashed at once, and numbers of the vectors that are made at once.
RUN, CELLS = 1 << 18, 1 << 18
#: Behind these bytes long texts are cut: no word goes across them, and lower-casing does not look across them.
_CUT = np.zeros(256, bool)
_CUT[[*range(33), *b'!"#$%&()*+,-/;<=>?@[\\]{|}~']] = True


def murmur3(words: Sequence[bytes], seed: int = 0) -> np.ndarray:
    """Signed 32-bit MurmurHash3 (x86), as published, of many words at once."""
    sizes = np.array([len(w) for w in words], np.int64)
    return murmur3_spans(b"".join(words), np.cumsum(sizes) - sizes, sizes, seed)


def murmur3_spans(text: bytes, starts: np.ndarray, sizes: np.ndarray, seed: int = 0) -> np.ndarray:
    """The same of spans of a text, which may overlap."""

    def scramble(k: np.ndarray) -> np.ndarray:
        k = k * np.uint32(0xCC9E2D51)
        return (k << np.uint32(15) | k >> np.uint32(17)) * np.uint32(0x1B873593)

    data = np.frombuffer(text + bytes(4), np.uint8).astype(np.uint32)
    at = data[:-3] | data[1:-2] << np.uint32(8) | data[2:-1] << np.uint32(16) | data[3:] << np.uint32(24)  # the four bytes from each place
    blocks = sizes // 4
    order = np.argsort(-blocks, kind="stable")  # spans with a block j come before those without
    starts, blocks, rest = starts[order], blocks[order], sizes[order] % 4
    h = np.full(len(sizes), seed, np.uint32)
    with_block = len(sizes) - np.cumsum(np.bincount(blocks)) if len(sizes) else []
    for j, n in enumerate(with_block):
        if n:
            k = h[:n] ^ scramble(at[starts[:n] + 4 * j])
            h[:n] = (k << np.uint32(13) | k >> np.uint32(19)) * np.uint32(5) + np.uint32(0xE6546B64)
    left = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF], np.uint32)[rest]
    h = h ^ scramble(at[starts + 4 * blocks] & left)  # zero changes nothing
    h = h ^ sizes[order].astype(np.uint32)
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        h = (h ^ h >> np.uint32(shift)) * np.uint32(factor)
    out = np.empty(len(sizes), np.uint32)
    out[order] = h ^ h >> np.uint32(16)
    return out.view(np.int32)


def _pieces(text: pa.Scalar) -> Iterator[str]:
    """A text in pieces of about RUN bytes, longer where there is nothing to cut behind."""
    data = np.frombuffer(text.as_buffer() or b"", np.uint8)
    at, step = 0, RUN
    while at < len(data):
        end = at + step
        if end < len(data):
            cuts = np.flatnonzero(_CUT[data[end - RUN : end]])
            if not len(cuts):
                step += RUN
                continue
            end += int(cuts[-1]) + 1 - RUN
        yield data[at:end].tobytes().decode()
        at, step = end, RUN


def _runs(texts: Iterable[pa.Scalar], overlap: int) -> Iterator[tuple[list[str], np.ndarray, int]]:
    """(words, rows, known): lower-cased words of texts, a text's number for each, in runs of about RUN bytes. The first
    ``known`` words of a run, ``overlap`` at most, were the last of the run before and belong to the text that goes on."""
    token = re.compile(TOKEN)
    words: list[str] = []
    owners: list[int] = []
    counts: list[int] = []
    size = known = 0
    for row, text in enumerate(texts):
        own = len(words)
        for piece in _pieces(text):
            low = piece.lower()
            for found in [token.findall(low)] if len(low) <= RUN else batched((m[0] for m in token.finditer(low)), RUN // 8):
                words += found
                owners.append(row)
                counts.append(len(found))
                size += min(len(low), RUN)
                if size >= RUN:
                    yield words, np.repeat(owners, counts), known
                    words = words[max(own, len(words) - overlap) :]
                    owners, counts, known, own, size = [row], [len(words)], len(words), 0, 0
    if len(words) > known:
        yield words, np.repeat(owners, counts), known


def gram_counts(texts: pa.Array, n: int, lo: int, hi: int) -> np.ndarray:
    """Signed counts, in ``n`` buckets, of the ``lo``- to ``hi``-grams of each text's words."""
    out = np.zeros(len(texts) * n)
    for words, rows, known in _runs(texts, hi - 1):
        text = " ".join(words)  # a gram is a span of it
        sizes = np.fromiter(map(len, words) if text.isascii() else (len(w.encode()) for w in words), np.int64, len(words))
        stops = np.cumsum(sizes + 1) - 1
        firsts, lasts = [], []
        for k in range(lo, hi + 1):
            last = np.arange(max(known, k - 1), len(words))
            last = last[rows[last - (k - 1)] == rows[last]]
            firsts.append(last - (k - 1))
            lasts.append(last)
        first, last = np.concatenate(firsts), np.concatenate(lasts)
        starts = stops[first] - sizes[first]
        h = murmur3_spans(text.encode(), starts, stops[last] - starts).astype(np.int64)
        np.add.at(out, rows[last] * n + np.abs(h) % n, np.where(h >= 0, 1.0, -1.0))
    return out.reshape(len(texts), n)


class HashingVectorizer(Transformer):
    """Signed hashed counts of the n-grams of lower-cased words of two or more characters, L2-normalised.

    ``hash``: "md5" stays in built-in functions (bucket: the first 8 hexadecimal digits; sign: the ninth is below 8);
    "murmur3" gives the numbers of the usual library, in Arrow batches, whose words are hashed RUN bytes at a time.
    """

    def __init__(self, n_features: int = 1 << 10, ngram_range: tuple[int, int] = (1, 1), hash: str = "md5", norm: str | None = "l2"):
        self.args = {"n_features": n_features, "ngram_range": ngram_range, "hash": hash, "norm": norm}

    def learn(self, df, columns):
        return None

    def outputs(self, columns):
        c, n = columns[0], self.args["n_features"]
        lo, hi = self.args["ngram_range"]
        norm = self.args["norm"]
        if self.args["hash"] == "murmur3":

            @F.arrow_udf("array<double>")
            def hashed(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
                most = max(1, CELLS // n)
                for column in columns:
                    for at in range(0, len(column), most):
                        v = gram_counts(column.slice(at, most), n, lo, hi)
                        if norm == "l2":
                            v /= np.maximum(np.sqrt((v * v).sum(1, keepdims=True)), 1e-300)
                        yield pa.ListArray.from_arrays(np.arange(len(v) + 1, dtype=np.int32) * np.int32(n), pa.array(v.ravel()))

            return {"array": hashed(q(c).cast("string"))}

        def gram(words: Column, k: int) -> Column:
            if k == 1:
                return words
            starts = F.when(F.size(words) >= k, F.sequence(F.lit(1), F.size(words) - (k - 1))).otherwise(F.array().cast("array<int>"))
            return F.transform(starts, lambda i: F.array_join(F.slice(words, i, k), " "))

        def signed(digest: Column) -> Column:
            bucket = F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint"), F.lit(n)).cast("int")
            return F.struct(bucket.alias("b"), F.when(F.substring(digest, 9, 1) < "8", 1.0).otherwise(-1.0).alias("s"))

        def vector(pairs: Column) -> Column:
            there = F.array_distinct(F.transform(pairs, lambda p: p["b"]))
            sums = F.map_from_arrays(there, F.transform(there, lambda b: F.aggregate(F.filter(pairs, lambda p: p["b"] == b), F.lit(0.0), lambda a, p: a + p["s"])))
            return let(sums, lambda m: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.coalesce(F.try_element_at(m, i), F.lit(0.0))))

        def scaled(raw: Column) -> Column:
            size = F.sqrt(F.aggregate(raw, F.lit(0.0), lambda a, x: a + x * x))
            return let(size, lambda z: F.transform(raw, lambda x: F.when(z > 0, x / z).otherwise(x)))

        found = F.regexp_extract_all(F.lower(F.coalesce(q(c).cast("string"), F.lit(""))), F.lit(f"(?U)({TOKEN})"))
        tokens = let(found, lambda words: F.concat(*[gram(words, k) for k in range(lo, hi + 1)]))
        pairs = F.transform(tokens, lambda t: let(F.md5(t), signed))
        raw = let(pairs, vector)
        return {"array": let(raw, scaled) if norm == "l2" else raw}


class Word2Vec(Transformer):
    """Embeddings of a column's values as words of one sentence; unknown and rare words are zero vectors.

    The vectors are a table that rows are joined with. Words train in as many parts as their number asks for.
    """

    #: Rows that one part trains on, about.
    PART_ROWS = 5_000_000

    def __init__(self, vector_size: int = 100, min_count: int = 5, seed: int = 0, max_iter: int = 1, window: int = 5):
        self.args = {"vector_size": vector_size, "min_count": min_count, "seed": seed, "max_iter": max_iter, "window": window}

    def learn(self, df, columns):
        from pyspark.ml.feature import Word2Vec as Trainer

        self.vectors: DataFrame | None = None
        self.name = f"__look_{uuid.uuid4().hex}"
        words = q(columns[0]).cast("string")
        known = df.where(words.isNotNull())
        frequent = known.groupBy(words.alias("w")).count().where(F.col("count") >= self.args["min_count"])
        if frequent.isEmpty():
            return
        # Sentences of about 1,000 words in order of the rows' hash, so that no task holds the whole column.
        rows = known.count()
        group = F.pmod(F.xxhash64(ORD) if ORD in df.columns else F.xxhash64(words), F.lit(max(1, rows // 1000)))
        sentences = known.groupBy(group.alias("g")).agg(F.collect_list(words).alias("words"))
        a = self.args
        model = Trainer(
            vectorSize=a["vector_size"], minCount=a["min_count"], seed=a["seed"], maxIter=a["max_iter"], windowSize=a["window"],
            inputCol="words", outputCol="v", numPartitions=1 + rows // self.PART_ROWS,
        ).fit(sentences)
        from pyspark.ml.functions import vector_to_array

        self.vectors = staged(model.getVectors().select(F.col("word").alias("__key"), vector_to_array("vector").alias(self.name)), "vectors")

    def attach(self, df, columns):
        if self.vectors is None:
            return df
        return df.join(self.vectors, q(columns[0]).cast("string") == F.col("__key"), "left").drop("__key")

    def outputs(self, columns):
        zeros = F.array_repeat(F.lit(0.0), self.args["vector_size"])
        return {"array": zeros if self.vectors is None else F.coalesce(q(self.name), zeros)}


class Pipeline(Transformer):
    """Transformers one after the other; a model may come last."""

    def __init__(self, steps: Sequence[tuple[str, Any]]):
        self.steps = [s for _, s in steps]
        self.args = {"steps": [n for n, _ in steps]}

    def learn(self, df, columns):
        raise NotImplementedError("a pipeline is fitted on frames")

    def outputs(self, columns):
        raise NotImplementedError("a pipeline is applied to frames")

    def _through(self, frame: InspectedFrame, fit: bool) -> InspectedFrame:
        frame = tracked(frame)
        for step in self.steps:
            if not hasattr(step, "transform"):
                break
            frame = step.fit_transform(frame) if fit else step.transform(frame)
        return frame

    def fit_transform(self, frame):
        return self._through(frame, True)

    def transform(self, frame, description=None):
        return self._through(frame, False)

    def fit(self, frame, labels=None):
        made = self._through(frame, True)
        if labels is not None:
            self.steps[-1].fit(made, labels)
        return self

    def score(self, frame, labels):
        return self.steps[-1].score(self._through(frame, False), labels)


def as_array(frame: InspectedFrame) -> InspectedFrame:
    """Columns of numbers as one feature array; the node stays."""
    frame = tracked(frame)
    if frame.columns == ["array"]:
        return frame
    return _view(frame, frame.hidden.select(F.array(*[c.cast("double") for c in frame.quoted]).alias("array"), *frame._hidden_columns))


def _view(frame: InspectedFrame, hidden: DataFrame) -> InspectedFrame:
    out = object.__new__(InspectedFrame)
    out.hidden, out.node, out.recorder = hidden, frame.node, frame.recorder
    return out


class ColumnTransformer:
    """Branches (name, transformer, columns) of one frame, side by side: projection, transformers, one concatenation.

    All branches are expressions over the same rows. The data of the concatenation is computed from the input in one
    projection, without joining the branches.
    """

    def __init__(self, transformers: Sequence[tuple[str, Transformer, Sequence[str]]]):
        self.branches = [(n, t, [c] if isinstance(c, str) else list(c)) for n, t, c in transformers]

    def _apply(self, frame: InspectedFrame, fit: bool) -> InspectedFrame:
        frame = tracked(frame)
        made, parts = [], []
        base = frame.hidden
        for i, (_, transformer, columns) in enumerate(self.branches):
            part = frame.select(*columns)
            steps = transformer.steps if isinstance(transformer, Pipeline) else [transformer]
            names = {c: f"__b{i}_0_{c}" for c in columns}
            base = base.withColumns({v: q(c) for c, v in names.items()})
            for k, step in enumerate(steps):
                part = step.fit_transform(part) if fit else step.transform(part)
                base = self._extend(base, names, step, f"__b{i}_{k + 1}_")
                names = {c: f"__b{i}_{k + 1}_{c}" for c in step.outputs(list(names))}
            made.append(part)
            parts.append(q(names["array"]) if list(names) == ["array"] else F.array(*[q(v).cast("double") for v in names.values()]))
        recorder = frame.recorder
        here = recorder.annotations
        values = {"array": F.concat(*parts)}
        fresh = {a.name: a.nary(values, [a.unary(frame.columns, q(a.name))]) for a in here}
        hidden = base.select(values["array"].alias("array"), q(ORD).alias(ORD), *[v.alias(k) for k, v in fresh.items()])
        node = recorder.add(OperatorType.CONCATENATION, (MODULE, "ColumnTransformer"), None, ["array"], [m.node for m in made])
        return InspectedFrame(hidden, node, recorder)

    @staticmethod
    def _extend(base: DataFrame, names: dict[str, str], step: Transformer, prefix: str) -> DataFrame:
        """``base`` with the step's outputs, whose expressions speak of the branch's own column names."""
        saved = {c: f"__saved_{c}" for c in names if c in base.columns}
        out = base.withColumns({v: q(c) for c, v in saved.items()}).withColumns({c: q(v) for c, v in names.items()})
        out = step.attach(out, list(names))
        out = out.withColumns({prefix + c: v for c, v in step.outputs(list(names)).items()})
        out = out.drop(*[c for c in names if c not in saved], *[c for c in out.columns if c.startswith("__look")])
        return out.withColumns({c: q(v) for c, v in saved.items()}).drop(*saved.values())

    def fit_transform(self, frame: InspectedFrame) -> InspectedFrame:
        return self._apply(frame, True)

    def fit(self, frame: InspectedFrame) -> ColumnTransformer:
        frame = tracked(frame)
        for _, t, columns in self.branches:
            part = frame.select(*columns)
            t.fit(part)
        return self

    def transform(self, frame: InspectedFrame) -> InspectedFrame:
        return self._apply(frame, False)


