"""Recording programs that use Spark's own API.

While a program runs, methods of the reader, of DataFrame and of grouped data are replaced by ones that send calls from
the program's own lines to the recorded operators; calls from anywhere else reach the originals. What a recorded call
returns is an ordinary DataFrame that knows its frame. Results of methods that are not replaced are plain DataFrames; a
recorded operator that meets one adopts it as a source of unknown origin.
"""

from __future__ import annotations

import contextlib
import functools
import sys
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame as ClassicDataFrame
from pyspark.sql.group import GroupedData
from pyspark.sql.readwriter import DataFrameReader

from pipelens import sources
from pipelens.operators.frame import Grouped, InspectedFrame, tracked
from pipelens.plans.model import OperatorType
from pipelens.plans.recorder import active, suspended

Patch = tuple[type, str, Callable[..., Any]]


def shown(frame: InspectedFrame) -> DataFrame:
    """The visible DataFrame, tied to its frame."""
    df = frame.df
    df._pipelens = frame
    return df


def _own_call() -> bool:
    """The call stands in the program itself."""
    recorder = active()
    return recorder is not None and sys._getframe(2).f_code.co_filename == recorder.source_path


def _names(columns: tuple) -> list[str] | None:
    flat = [c for x in columns for c in (x if isinstance(x, (list, tuple)) else [x])]
    return flat if flat and all(isinstance(c, str) and c != "*" for c in flat) else None


def _filter(original, self, condition):
    return shown(tracked(self).filter(condition, f"Select by {condition}"))


def _select(original, self, *columns):
    frame, names = tracked(self), _names(columns)
    if names is not None and all(n in frame.columns for n in names):
        return shown(frame.select(*names))
    flat = [c for x in columns for c in (x if isinstance(x, (list, tuple)) else [x])]
    said = f"modifies {[str(c) for c in flat]}"
    return shown(frame._unary(OperatorType.PROJECTION_MODIFY, ("pyspark.sql.DataFrame", "select"), said, lambda df: original(df, *flat, *frame._hidden_columns)))


def _getitem(original, self, key):
    if isinstance(key, (list, tuple)) or (isinstance(key, Column) and not isinstance(key, str)):
        return shown(tracked(self)[list(key) if isinstance(key, tuple) else key])
    return original(self, key)


def _with_column(original, self, name, value):
    return shown(tracked(self).with_column(name, value))


def _dropna(original, self, how="any", thresh=None, subset=None):
    return shown(tracked(self).dropna(how, thresh, [subset] if isinstance(subset, str) else subset))


def _listed(subset) -> list[str] | None:
    return [subset] if isinstance(subset, str) else list(subset) if subset else None


def _replace(original, self, to_replace, value=None, subset=None):
    return shown(tracked(self).replace(to_replace, value, _listed(subset)))


def _fillna(original, self, value, subset=None):
    return shown(tracked(self).fillna(value, _listed(subset)))


def _drop(original, self, *columns):
    return shown(tracked(self).drop(*columns)) if _names(columns) else original(self, *columns)


def _with_columns(original, self, values):
    return shown(tracked(self).with_columns(values))


def _renamed(original, self, existing, new):
    return shown(tracked(self).rename(existing, new)) if existing in self.columns else self


def _distinct(original, self):
    return shown(tracked(self).distinct())


def _drop_duplicates(original, self, subset=None):
    return shown(tracked(self).distinct(_listed(subset)))


def _union(original, self, other):
    return shown(tracked(self).union(tracked(other)))


def _union_by_name(original, self, other, allowMissingColumns=False):
    if allowMissingColumns:
        return original(self, other, allowMissingColumns)
    return shown(tracked(self).union(tracked(other), by_name=True))


def _join(original, self, other, on=None, how="inner"):
    return shown(tracked(self).join(tracked(other), on=on, how=how or "inner"))


def _cross_join(original, self, other):
    return shown(tracked(self).join(tracked(other), how="cross"))


def _group_by(original, self, *columns):
    names = _names(columns)
    out = original(self, *columns)
    if names is not None:
        out._pipelens = Grouped(tracked(self), names)
    return out


def _agg(original, self, *columns):
    grouped = getattr(self, "_pipelens", None)
    if grouped is None:
        return original(self, *columns)
    if len(columns) == 1 and isinstance(columns[0], dict):
        values = [F.expr(f"{f}(`{c}`)").alias(f"{f}({c})") for c, f in columns[0].items()]
    else:
        values = list(columns)
    return shown(grouped.agg_columns(values, str([str(v) for v in values])))


def _random_split(original, self, weights, seed=0):
    if len(weights) != 2:
        return original(self, weights, seed)
    return [shown(f) for f in tracked(self).train_test_split(weights[1] / sum(weights), seed or 0)]


def _create(original, self, data, *args, **kwargs):
    recorder = active()
    with suspended(recorder):
        df = original(self, data, *args, **kwargs)
        given = isinstance(data, (list, tuple, pd.DataFrame))  # rows of the program itself come in the same places again
        rows = df.withColumn("__rid", F.monotonically_increasing_id()) if given else sources.numbered(df)
    return shown(InspectedFrame.from_source(sources._normalized(rows), F.col("__rid"), function=("pyspark.sql.SparkSession", "createDataFrame"), recorder=recorder))


def _read_parquet(original, self, *paths, **options):
    return shown(sources.read_parquet(self._spark, paths[0])) if len(paths) == 1 and not options else original(self, *paths, **options)


def _read_csv(original, self, path, *args, **kwargs):
    recorder = active()
    with suspended(recorder):
        df = original(self, path, *args, **kwargs)
        rows = sources._normalized(sources.numbered(df))
    name = path.rstrip("/").rpartition("/")[2] if isinstance(path, str) else None
    return shown(InspectedFrame.from_source(rows, F.col("__rid"), function=(sources.READER, "csv"), description=name, recorder=recorder))


def _table(original, self, name):
    return shown(sources.named_dataset(self._spark if isinstance(self, DataFrameReader) else self, name))


#: What is replaced: class, method, and the function that takes the original, the object and the call's arguments.
PATCHES: list[Patch] = [
    (ClassicDataFrame, "filter", _filter),
    (ClassicDataFrame, "where", _filter),
    (ClassicDataFrame, "select", _select),
    (ClassicDataFrame, "__getitem__", _getitem),
    (ClassicDataFrame, "withColumn", _with_column),
    (ClassicDataFrame, "dropna", _dropna),
    (ClassicDataFrame, "withColumns", _with_columns),
    (ClassicDataFrame, "withColumnRenamed", _renamed),
    (ClassicDataFrame, "drop", _drop),
    (ClassicDataFrame, "fillna", _fillna),
    (ClassicDataFrame, "replace", _replace),
    (ClassicDataFrame, "distinct", _distinct),
    (ClassicDataFrame, "dropDuplicates", _drop_duplicates),
    (ClassicDataFrame, "union", _union),
    (ClassicDataFrame, "unionAll", _union),
    (ClassicDataFrame, "unionByName", _union_by_name),
    (ClassicDataFrame, "join", _join),
    (ClassicDataFrame, "crossJoin", _cross_join),
    (ClassicDataFrame, "groupBy", _group_by),
    (ClassicDataFrame, "groupby", _group_by),
    (ClassicDataFrame, "randomSplit", _random_split),
    (GroupedData, "agg", _agg),
    (DataFrameReader, "parquet", _read_parquet),
    (DataFrameReader, "csv", _read_csv),
    (DataFrameReader, "table", _table),
    (SparkSession, "table", _table),
    (SparkSession, "createDataFrame", _create),
]


@contextlib.contextmanager
def captured(more: list[Patch] = ()) -> Iterator[None]:
    """Replaces the methods, and puts the originals back however the program ends."""
    saved = []
    try:
        for cls, name, function in [*PATCHES, *more]:
            original = getattr(cls, name)

            def method(self, *args, __f=function, __o=original, **kwargs):
                return __f(__o, self, *args, **kwargs) if _own_call() else __o(self, *args, **kwargs)

            saved.append((cls, name, cls.__dict__.get(name)))
            setattr(cls, name, functools.wraps(original)(method))
        yield
    finally:
        for cls, name, own in reversed(saved):
            if own is None:
                delattr(cls, name)
            else:
                setattr(cls, name, own)
