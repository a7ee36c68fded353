"""Annotations that follow rows, and inspections that aggregate them.

An annotation is a hidden column with a rule for each shape of operator; the frame applies the rules, so that the
column is part of the same lazy plan as the data and is pruned where nobody reads it. An inspection names the
annotations it needs and gives, for a node, a DataFrame (``frame``) or a value on the driver (``result``).
"""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Sequence
from typing import TYPE_CHECKING, Any

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

if TYPE_CHECKING:
    from pipelens.operators.frame import InspectedFrame


class Annotation(ABC):
    """Rules of one hidden column. ``get`` gives a visible column of the frame in question."""

    name: str

    @abstractmethod
    def source(self, op_id: int, columns: Sequence[str], row_id: Column) -> Column: ...

    def unary(self, columns: Sequence[str], current: Column) -> Column:
        """Over the input, before the operator changes it."""
        return current

    def imputed(self, columns: Sequence[str], current: Column) -> Column:
        """Over the output of an imputer."""
        return current

    @abstractmethod
    def nary(self, outputs: dict[str, Column], currents: list[Column]) -> Column:
        """Over a join's row: visible output columns by name, and the inputs' annotations (null: no partner)."""


class ColumnAnnotation(Annotation):
    """A column's value, kept when the column is projected away."""

    def __init__(self, column: str):
        self.column, self.name = column, f"__ann_{column}"

    def source(self, op_id, columns, row_id):
        return F.col(f"`{self.column}`").cast("string") if self.column in columns else F.lit(None).cast("string")

    def unary(self, columns, current):
        return F.col(f"`{self.column}`").cast("string") if self.column in columns else current

    imputed = unary

    def nary(self, outputs, currents):
        return outputs[self.column].cast("string") if self.column in outputs else F.coalesce(*currents)


class IntersectionalAnnotation(ColumnAnnotation):
    """As ColumnAnnotation, but lost (null) where an operator with several inputs has no such output column."""

    def __init__(self, column: str, propagate: bool = False):
        super().__init__(column)
        self.propagate, self.name = propagate, f"__iann{'p' if propagate else ''}_{column}"

    def nary(self, outputs, currents):
        if self.propagate or self.column in outputs:
            return super().nary(outputs, currents)
        return F.lit(None).cast("string")


class LineageAnnotation(Annotation):
    """The set of (operator, row) of the source rows behind a row, sorted."""

    name = "__lin"
    type = "array<struct<operator_id:int,row_id:bigint>>"

    def source(self, op_id, columns, row_id):
        return F.array(F.struct(F.lit(op_id).cast("int").alias("operator_id"), row_id.cast("bigint").alias("row_id")))

    def nary(self, outputs, currents):
        out = F.coalesce(currents[0], F.array().cast(self.type))
        for other in currents[1:]:
            out = F.array_union(out, F.coalesce(other, F.array().cast(self.type)))
        return F.array_sort(out)


#: Results of up to this many rows are values on the driver; larger ones are handed out as the table itself.
RESULT_ROWS = 100_000


def collected(found: DataFrame) -> list[Row] | None:
    """The rows, if there are no more than RESULT_ROWS."""
    rows = found.limit(RESULT_ROWS + 1).collect()
    return rows if len(rows) <= RESULT_ROWS else None


class Inspection(ABC):
    """Equal by class and id, so that checks and users that ask for the same one share it.

    ``result`` never brings more than RESULT_ROWS rows to the driver: a larger result is the DataFrame of ``frame``.
    """

    @property
    def inspection_id(self) -> Any:
        return None

    def annotations(self) -> list[Annotation]:
        return []

    @abstractmethod
    def frame(self, at: InspectedFrame) -> DataFrame | None:
        """The result for a node as a table; None where it has none."""

    def result(self, at: InspectedFrame) -> Any:
        return self.frame(at)

    def measures(self, at: InspectedFrame) -> dict[str, Column] | None:
        """The whole result as aggregates over the node's rows, where it is that; all of a node's are made by one job."""
        return None

    def __eq__(self, other: object) -> bool:
        return type(self) is type(other) and self.inspection_id == other.inspection_id

    def __hash__(self) -> int:
        return hash((type(self).__name__, repr(self.inspection_id)))

    def __repr__(self) -> str:
        return f"{type(self).__name__}({'' if self.inspection_id is None else self.inspection_id})"


def is_missing(df: DataFrame, column: str) -> Column:
    c = F.col(f"`{column}`")
    return c.isNull() | F.isnan(c) if dict(df.dtypes)[column] in ("double", "float") else c.isNull()
