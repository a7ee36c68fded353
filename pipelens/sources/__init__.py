"""Sources: files, literals, random numbers, named tables, and frames of unknown origin.

Each row of a source needs an id that any run finds again. ``row_id`` may name a column or give an expression; without
it Parquet files use the row index within the file (with the file's place in the high bits), which leaves filters on the
scan, and literals their position. Text, tables and frames of unknown origin have nothing of the kind: without a
``row_id`` their rows are numbered and written once to the shared folder, and all that follows reads what was written.

NaN becomes null at every source; a comparison with a literal still reaches the scan.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Sequence
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pipelens.operators.frame import InspectedFrame
from pipelens.plans.model import OperatorType
from pipelens.plans.recorder import Recorder, current, suspended
from pipelens.storage import staged

READER = "pyspark.sql.DataFrameReader"
FILE_BITS = 40
#: Names of files that take more characters than this are joined without a broadcast.
FILE_NAMES = 16 << 20
#: The scheme of a path, which is written with one slash or three.
SCHEME = "^[A-Za-z][A-Za-z0-9+.-]*:/*"


def _id(row_id: str | Column | None, default: Column) -> Column:
    return default if row_id is None else F.col(f"`{row_id}`") if isinstance(row_id, str) else row_id


def _normalized(df: DataFrame) -> DataFrame:
    """NaN becomes null, once, so that null rules hold everywhere after."""
    floats = {c: F.when(~F.isnan(f"`{c}`"), F.col(f"`{c}`")) for c, kind in df.dtypes if kind in ("double", "float")}
    return df.withColumns(floats) if floats else df


def read_parquet(spark: SparkSession, path: str, row_id: str | Column | None = None, normalize: bool = True, recorder: Recorder | None = None) -> InspectedFrame:
    df = spark.read.parquet(path)
    rows = _row_index(df) if row_id is None else df.withColumn("__rid", _id(row_id, F.lit(None)))
    return _source(rows, df.columns, normalize, (READER, "parquet"), os.path.basename(path.rstrip("/")), recorder)


def _row_index(df: DataFrame) -> DataFrame:
    """``df``, a scan of Parquet files, with ``__rid``: the row's place in its file, with the file's place in the high bits."""
    files = sorted(_plain_path(f) for f in df.inputFiles())
    columns = [F.col(f"`{c}`") for c in df.columns]
    if len(files) <= 1:
        return df.select(*columns, F.col("_metadata.row_index").alias("__rid"))
    places = df.sparkSession.createDataFrame([(f, i) for i, f in enumerate(files)], "__file string, __place bigint")
    if sum(map(len, files)) <= FILE_NAMES:
        places = F.broadcast(places)
    file = F.regexp_replace(F.col("_metadata.file_path"), SCHEME, "/")
    rows = df.select(*columns, file.alias("__file"), F.col("_metadata.row_index").alias("__row")).join(places, "__file")
    return rows.select(*columns, (F.shiftleft("__place", FILE_BITS) + F.col("__row")).alias("__rid"))


def _scans_files(df: DataFrame) -> bool:
    """The frame is one scan of files, with projections and filters at most, so that a row index names its rows."""
    node = df._jdf.queryExecution().analyzed()
    while node.getClass().getSimpleName() in ("SubqueryAlias", "Project", "Filter"):
        node = node.child()
    return node.getClass().getSimpleName() == "LogicalRelation"


def _plain_path(uri: str) -> str:
    return re.sub(SCHEME, "/", uri)


def read_csv(
    spark: SparkSession, path: str, schema: str | T.StructType | None = None, na_values: str = "", header: bool = True, row_id: str | Column | None = None, recorder: Recorder | None = None, **options: Any
) -> InspectedFrame:
    """CSV; ``na_values`` is read as null. Without a row id rows are numbered in the order of the files."""
    reader = spark.read.options(header=header, nullValue=na_values, **options)
    df = reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)
    return _source(numbered(df, row_id), df.columns, True, (READER, "csv"), os.path.basename(path.rstrip("/")), recorder)


def numbered(df: DataFrame, row_id: str | Column | None = None) -> DataFrame:
    """``df`` with ``__rid``: the id given, else the row index of Parquet files, else one that is written once so that it stays."""
    if row_id is not None:
        return df.withColumn("__rid", _id(row_id, F.lit(None)))
    if _scans_files(df):
        try:
            return _row_index(df)
        except AnalysisException:  # files of another kind have no row index
            pass
    return staged(df.withColumn("__rid", F.monotonically_increasing_id()), "source")


def _source(rows: DataFrame, names: Sequence[str], normalize: bool, function: tuple[str, str], description: str | None, recorder: Recorder | None) -> InspectedFrame:
    data = rows.select(*[F.col(f"`{c}`") for c in names], "__rid")
    return InspectedFrame.from_source(_normalized(data) if normalize else data, F.col("__rid"), function=function, description=description, recorder=recorder)


def literal_frame(spark: SparkSession, data: dict[str, Sequence[Any]] | Sequence[tuple], schema: str | None = None, recorder: Recorder | None = None) -> InspectedFrame:
    """Rows given in the program, as columns by name or as tuples with a schema."""
    rows = list(zip(*data.values())) if isinstance(data, dict) else [tuple(r) for r in data]
    names = list(data) if isinstance(data, dict) else None
    numbered = [(*r, i) for i, r in enumerate(rows)]
    if schema is not None:
        df = spark.createDataFrame(numbered, f"{schema}, __rid bigint")
    else:
        df = spark.createDataFrame(numbered, [*names, "__rid"])
    return _source(df, [c for c in df.columns if c != "__rid"], True, ("pyspark.sql.SparkSession", "createDataFrame"), None, recorder)


def literal_series(spark: SparkSession, values: Sequence[Any], name: str = "_1", recorder: Recorder | None = None) -> InspectedFrame:
    return literal_frame(spark, {name: values}, recorder=recorder)


def random_array(spark: SparkSession, rows: int, width: int = 1, seed: int = 0, recorder: Recorder | None = None) -> InspectedFrame:
    """Uniform numbers in [0, 1), in the column ``array``."""
    df = spark.range(rows).select(F.array(*[F.rand(seed + i) for i in range(width)]).alias("array"), F.col("id").alias("__rid"))
    return _source(df, ["array"], False, ("pyspark.sql.functions", "rand"), "random", recorder)


def named_dataset(spark: SparkSession, name: str, row_id: str | Column | None = None, recorder: Recorder | None = None) -> InspectedFrame:
    """A table of the catalog."""
    df = spark.table(name)
    return _source(numbered(df, row_id), df.columns, True, (READER, "table"), name, recorder)


def adopt(df: DataFrame, row_id: str | Column | None = None, recorder: Recorder | None = None) -> InspectedFrame:
    """A frame of unknown origin, as a new source; its node has a negative id."""
    recorder = recorder or current()
    with suspended(recorder):
        rows = _normalized(numbered(df, row_id))
    warning = "Warning! The frame came from outside of the recorded operators."
    return InspectedFrame.from_source(rows, F.col("__rid"), OperatorType.MISSING_OP, None, warning, recorder=recorder)


def pipeline_source(path: str | None = None, text: str | None = None, notebook: str | None = None) -> str:
    """The program of a pipeline, from exactly one of a file, a text and a notebook."""
    if sum(x is not None for x in (path, text, notebook)) != 1:
        raise ValueError("give exactly one of a Python file, a text and a notebook")
    if text is not None:
        return text
    with open(path or notebook, encoding="utf-8") as f:
        if path is not None:
            return f.read()
        cells = json.load(f)["cells"]
    code = ["".join(c["source"]) for c in cells if c["cell_type"] == "code"]
    return "\n\n".join("\n".join(line for line in c.splitlines() if not line.lstrip().startswith(("%", "!"))) for c in code) + "\n"
