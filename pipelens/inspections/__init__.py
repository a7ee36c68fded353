"""Built-in inspections."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pipelens.inspections.base import RESULT_ROWS, Annotation, ColumnAnnotation, Inspection, IntersectionalAnnotation, LineageAnnotation, collected, is_missing
from pipelens.plans.model import SOURCES, LineageId, OperatorType

if TYPE_CHECKING:
    from pipelens.operators.frame import InspectedFrame

__all__ = [
    "Annotation", "ArgumentCapturing", "ColumnPropagation", "CompletenessOfColumns", "CountDistinctOfColumns", "EmptyInspection",
    "HistogramForColumns", "Inspection", "IntersectionalHistogramForColumns", "MaterializeFirstOutputRows", "MissingEmbeddings", "RESULT_ROWS", "RowLineage",
]


class HistogramForColumns(Inspection):
    """Counts of the values of each column, also after it was projected away.

    A unary operator counts its input's values (an imputer its output's). A source without the column has no counts,
    estimators have none at all. All columns of a node are counted by one aggregation over grouping sets.
    """

    def __init__(self, columns: Sequence[str]):
        self.columns = list(columns)

    @property
    def inspection_id(self):
        return tuple(self.columns)

    def annotations(self):
        return [ColumnAnnotation(c) for c in self.columns]

    def counted(self, at: InspectedFrame) -> list[str]:
        if at.node.operator == OperatorType.ESTIMATOR:
            return []
        return [c for c in self.columns if at.node.operator not in SOURCES or c in at.columns]

    def frame(self, at: InspectedFrame) -> DataFrame | None:
        """(column, value, count)."""
        if at.node.operator == OperatorType.ESTIMATOR:
            return None
        columns = self.counted(at)
        if not columns:
            return at.spark.createDataFrame([], "column string, value string, count bigint")
        if len(columns) == 1:
            c = columns[0]
            return at.hidden.groupBy(F.col(f"`__ann_{c}`").alias("value")).agg(F.count(F.lit(1)).alias("count")).select(F.lit(c).alias("column"), "value", "count")
        data = at.hidden.select(*[F.col(f"`__ann_{c}`").alias(f"v{i}") for i, c in enumerate(columns)])
        names = [F.col(f"v{i}") for i in range(len(columns))]
        sets = data.groupingSets([[n] for n in names], *names).agg(F.count(F.lit(1)).alias("count"), F.grouping_id().alias("g"))
        whole = (1 << len(columns)) - 1
        which = reduce(lambda out, i: F.when(F.col("g") == whole - (1 << (len(columns) - 1 - i)), F.lit(i)).otherwise(out), range(len(columns)), F.lit(-1))
        value = reduce(lambda out, i: F.when(which == i, names[i]).otherwise(out), range(len(columns)), F.lit(None).cast("string"))
        column = F.element_at(F.array(*[F.lit(c) for c in columns]), which + 1)
        return sets.select(column.alias("column"), value.alias("value"), "count")

    def result(self, at: InspectedFrame) -> dict[str, dict[str | None, int]] | DataFrame | None:
        found = self.frame(at)
        if found is None:
            return None
        rows = collected(found)
        if rows is None:
            return found
        out: dict[str, dict[str | None, int]] = {c: {} for c in self.columns}
        for r in rows:
            out[r["column"]][r["value"]] = r["count"]
        return out


class IntersectionalHistogramForColumns(Inspection):
    """Counts of the combinations of the columns' values; ``propagate`` keeps values through joins that lose them."""

    def __init__(self, columns: Sequence[str], propagate: bool = False):
        self.columns, self.propagate = list(columns), propagate

    @property
    def inspection_id(self):
        return (*self.columns, self.propagate)

    def annotations(self):
        return [IntersectionalAnnotation(c, self.propagate) for c in self.columns]

    def frame(self, at: InspectedFrame) -> DataFrame | None:
        if at.node.operator == OperatorType.ESTIMATOR:
            return None
        keys = [F.col(f"`{a.name}`").alias(a.column) for a in self.annotations()]
        return at.hidden.groupBy(*keys).agg(F.count(F.lit(1)).alias("count"))

    def result(self, at: InspectedFrame) -> dict[tuple, int] | DataFrame | None:
        found = self.frame(at)
        rows = None if found is None else collected(found)
        return found if rows is None else {tuple(r[:-1]): r[-1] for r in rows}


def _measured(at: InspectedFrame, measures: dict[str, Column]) -> DataFrame | None:
    return at.df.agg(*[v.alias(c) for c, v in measures.items()]) if measures else None


class CompletenessOfColumns(Inspection):
    """Share of values that are neither null nor NaN, of those columns that the output has; null for no rows."""

    def __init__(self, columns: Sequence[str]):
        self.columns = list(columns)

    @property
    def inspection_id(self):
        return tuple(self.columns)

    def measures(self, at):
        there = [] if at.node.operator == OperatorType.ESTIMATOR else [c for c in self.columns if c in at.columns]
        return {c: F.avg(F.when(is_missing(at.df, c), 0.0).otherwise(1.0)) for c in there}

    def frame(self, at: InspectedFrame) -> DataFrame | None:
        return _measured(at, self.measures(at))

    def result(self, at: InspectedFrame) -> dict[str, float | None]:
        found = self.frame(at)
        return {} if found is None else found.first().asDict()


class CountDistinctOfColumns(Inspection):
    """Number of distinct values, null as one of them, of those columns that the output has.

    ``nan_mode``: "collapse" counts all missing values of a column as one; "reference" counts each missing value of a
    floating-point column. ``approximate`` trades exactness for one pass with sketches.
    """

    def __init__(self, columns: Sequence[str], nan_mode: str = "collapse", approximate: bool = False):
        self.columns, self.nan_mode, self.approximate = list(columns), nan_mode, approximate

    @property
    def inspection_id(self):
        return (*self.columns, self.nan_mode, self.approximate)

    def measures(self, at):
        there = [] if at.node.operator == OperatorType.ESTIMATOR else [c for c in self.columns if c in at.columns]
        kinds, out = dict(at.df.dtypes), {}
        for c in there:
            missing = is_missing(at.df, c)
            value = F.when(~missing, F.col(f"`{c}`"))
            known = F.approx_count_distinct(value) if self.approximate else F.count_distinct(value)
            each = self.nan_mode == "reference" and kinds[c] in ("double", "float")
            more = F.sum(missing.cast("long")) if each else F.max(missing.cast("long"))
            out[c] = known + F.coalesce(more, F.lit(0))
        return out

    def frame(self, at: InspectedFrame) -> DataFrame | None:
        return _measured(at, self.measures(at))

    def result(self, at: InspectedFrame) -> dict[str, int]:
        found = self.frame(at)
        return {} if found is None else found.first().asDict()


class MaterializeFirstOutputRows(Inspection):
    """The first rows in order of the row ids."""

    def __init__(self, row_count: int):
        self.row_count = row_count

    @property
    def inspection_id(self):
        return self.row_count

    def frame(self, at: InspectedFrame) -> DataFrame | None:
        if at.node.operator == OperatorType.ESTIMATOR:
            return None
        return at.first(self.row_count).select(*at.quoted)

    def result(self, at: InspectedFrame):
        found = self.frame(at)
        return None if found is None else found.toPandas()


class RowLineage(Inspection):
    """The source rows behind the first rows (or all), in the column ``lineage``; operators may be restricted."""

    ALL_ROWS = -1

    def __init__(self, row_count: int, operators: Sequence[OperatorType] | None = None):
        self.row_count, self.operators = row_count, None if operators is None else frozenset(operators)

    @property
    def inspection_id(self):
        return (self.row_count, None if self.operators is None else tuple(sorted(o.name for o in self.operators)))

    def annotations(self):
        return [LineageAnnotation()]

    def frame(self, at: InspectedFrame) -> DataFrame | None:
        if self.operators is not None and at.node.operator not in self.operators:
            return None
        rows = at.hidden if self.row_count == self.ALL_ROWS else at.first(self.row_count)
        columns = [] if at.node.operator == OperatorType.ESTIMATOR else at.quoted
        return rows.select(*columns, F.col("__lin").alias("lineage"))

    def result(self, at: InspectedFrame):
        found = self.frame(at)
        if found is None:
            return None
        rows = collected(found)
        if rows is None:
            return found
        out = found.sparkSession.createDataFrame(rows, found.schema).toPandas()
        out["lineage"] = [{LineageId(x["operator_id"], x["row_id"]) for x in row} for row in out["lineage"]]
        return out


class ColumnPropagation(Inspection):
    """The first rows with the values of sensitive columns, in ``propagated_<column>``, wherever they were lost."""

    def __init__(self, columns: Sequence[str], row_count: int):
        self.columns, self.row_count = list(columns), row_count

    @property
    def inspection_id(self):
        return (*self.columns, self.row_count)

    def annotations(self):
        return [ColumnAnnotation(c) for c in self.columns]

    def frame(self, at: InspectedFrame) -> DataFrame | None:
        visible = [] if at.node.operator == OperatorType.ESTIMATOR else at.quoted
        return at.first(self.row_count).select(*visible, *[F.col(f"`__ann_{c}`").alias(f"propagated_{c}") for c in self.columns])

    def result(self, at: InspectedFrame):
        return self.frame(at).toPandas()


class ArgumentCapturing(Inspection):
    """Arguments of an operator that are not data, such as a constructor's; empty where there are none."""

    def frame(self, at: InspectedFrame) -> DataFrame:
        rows = [(k, repr(v)) for k, v in sorted(at.node.operator_info.non_data_args)]
        return at.spark.createDataFrame(rows, "argument string, value string")

    def result(self, at: InspectedFrame) -> dict[str, object]:
        return dict(at.node.operator_info.non_data_args)


class MissingEmbeddings(Inspection):
    """Of a word embedding: how many rows have a zero vector, and examples of their input."""

    def __init__(self, example_threshold: int = 10):
        self.example_threshold = example_threshold

    @property
    def inspection_id(self):
        return self.example_threshold

    def frame(self, at: InspectedFrame) -> DataFrame | None:
        info = at.node.operator_info.function_info
        if at.node.operator != OperatorType.TRANSFORMER or info is None or info.function_name != "Word2Vec" or "__in" not in at.hidden.columns:
            return None
        # Inputs are counted first, so that the examples are the least of the different ones and no list of all is made.
        zero = at.hidden.where(F.forall("array", lambda x: x == 0.0)).groupBy(F.col("__in").cast("string").alias("word")).agg(F.count(F.lit(1)).alias("n"))
        least = zero.where("word is not null").orderBy("word").limit(self.example_threshold)
        listed = least.agg(F.array_sort(F.collect_list("word")).alias("examples"))
        return zero.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("missing")).crossJoin(F.broadcast(listed))  # a row each

    def result(self, at: InspectedFrame):
        found = self.frame(at)
        return None if found is None else found.first().asDict()


class EmptyInspection(Inspection):
    """Does nothing; for measuring."""

    def __init__(self, id: int = 0):
        self.id = id

    @property
    def inspection_id(self):
        return self.id

    def frame(self, at: InspectedFrame) -> None:
        return None

