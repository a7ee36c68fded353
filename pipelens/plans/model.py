"""Operator types, DAG nodes and the DAG."""

from __future__ import annotations

from dataclasses import dataclass, field
from enum import Enum

from pyspark.sql import DataFrame, SparkSession


class OperatorType(Enum):
    DATA_SOURCE = "Data Source"
    MISSING_OP = "Encountered unsupported operation! Fallback: Data Source"
    SELECTION = "Selection"
    PROJECTION = "Projection"
    PROJECTION_MODIFY = "Projection (Modify)"
    TRANSFORMER = "Transformer"
    CONCATENATION = "Concatenation"
    ESTIMATOR = "Estimator"
    SCORE = "Score"
    TRAIN_DATA = "Train Data"
    TRAIN_LABELS = "Train Labels"
    TEST_DATA = "Test Data"
    TEST_LABELS = "Test Labels"
    JOIN = "Join"
    GROUP_BY_AGG = "Groupby and Aggregate"
    TRAIN_TEST_SPLIT = "Train Test Split"


#: Operators whose rows have no rows of an input behind them.
SOURCES = frozenset({OperatorType.DATA_SOURCE, OperatorType.MISSING_OP, OperatorType.GROUP_BY_AGG})
SEVERAL_INPUTS = frozenset({OperatorType.JOIN, OperatorType.CONCATENATION, OperatorType.SCORE})


@dataclass(frozen=True)
class FunctionInfo:
    module: str
    function_name: str


@dataclass(frozen=True)
class OperatorContext:
    operator: OperatorType
    function_info: FunctionInfo | None
    non_data_args: tuple[tuple[str, object], ...] = ()


@dataclass(frozen=True)
class CodeReference:
    """Where a call stands in the pipeline's source."""

    lineno: int
    col_offset: int
    end_lineno: int
    end_col_offset: int


@dataclass(frozen=True)
class BasicCodeLocation:
    caller_filename: str
    lineno: int


@dataclass(frozen=True)
class OptionalCodeInfo:
    code_reference: CodeReference
    source_code: str


@dataclass(frozen=True)
class DagNodeDetails:
    description: str | None = None
    columns: tuple[str, ...] = ()


@dataclass(frozen=True)
class DagNode:
    node_id: int
    code_location: BasicCodeLocation
    operator_info: OperatorContext
    details: DagNodeDetails = DagNodeDetails()
    optional_code_info: OptionalCodeInfo | None = None

    def __hash__(self) -> int:
        return hash(self.node_id)

    @property
    def operator(self) -> OperatorType:
        return self.operator_info.operator


@dataclass(frozen=True, order=True)
class LineageId:
    operator_id: int
    row_id: int


@dataclass
class Dag:
    """Nodes in order of recording, and edges from inputs to users, in order of the inputs."""

    nodes: list[DagNode] = field(default_factory=list)
    edges: list[tuple[DagNode, DagNode]] = field(default_factory=list)

    def add_node(self, node: DagNode, parents: list[DagNode] = ()) -> None:
        self.nodes.append(node)
        self.edges += [(p, node) for p in parents]

    def predecessors(self, node: DagNode) -> list[DagNode]:
        return [a for a, b in self.edges if b == node]

    def successors(self, node: DagNode) -> list[DagNode]:
        return [b for a, b in self.edges if a == node]

    def find(self, operator: OperatorType) -> list[DagNode]:
        return [n for n in self.nodes if n.operator == operator]

    def to_frames(self, spark: SparkSession) -> tuple[DataFrame, DataFrame]:
        """Nodes and edges as tables."""
        nodes = [(n.node_id, n.operator.value, n.details.description, list(n.details.columns), n.code_location.lineno) for n in self.nodes]
        edges = [(a.node_id, b.node_id) for a, b in self.edges]
        return (
            spark.createDataFrame(nodes, "node_id int, operator string, description string, columns array<string>, lineno int"),
            spark.createDataFrame(edges, "src int, dst int"),
        )
