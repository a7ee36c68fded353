"""The entry point: run a program, record its DAG, and give the results of inspections and checks."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from pipelens.capture import Patch, captured
from pipelens.checks import Check, CheckResult, InspectionResult, check_results_frame
from pipelens.inspections import HistogramForColumns, Inspection
from pipelens.operators.frame import ORD, InspectedFrame
from pipelens.plans.model import Dag, DagNode, OperatorType
from pipelens.plans.recorder import Recorder, recording
from pipelens.sources import pipeline_source


@dataclass
class InspectorResult:
    dag: Dag
    dag_node_to_inspection_results: dict[DagNode, dict[Inspection, Any]]
    check_to_check_results: dict[Check, CheckResult]
    frames: dict[DagNode, InspectedFrame]

    def checks_frame(self, spark: SparkSession) -> DataFrame:
        return check_results_frame(spark, self.check_to_check_results)


#: A frame that several others build on is kept while results are made if it took a shuffle and is estimated below this.
KEEP_BYTES = 1 << 30
#: Results of different nodes are independent jobs; so many are submitted at once.
PARALLEL = 4


def _worth_keeping(frame: InspectedFrame) -> bool:
    if frame.node.operator != OperatorType.JOIN:
        return False
    return int(str(frame.hidden._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= KEEP_BYTES


def _share_first_rows(frame: InspectedFrame, inspections: Iterable[Inspection]) -> None:
    """One job for all inspections that look at the first rows."""
    counts = [n for i in inspections if (n := getattr(i, "row_count", 0)) > 0]
    if len(counts) > 1 and frame.node.operator != OperatorType.ESTIMATOR:
        rows = frame.hidden.orderBy(ORD).limit(max(counts)).collect()
        frame.first_rows = (max(counts), frame.spark.createDataFrame(rows, frame.hidden.schema))


def _share_histograms(frame: InspectedFrame, inspections: Iterable[Inspection], found: dict[Inspection, Any]) -> None:
    """One job for all histograms of a node."""
    several = [i for i in inspections if type(i) is HistogramForColumns]
    if len(several) < 2:
        return
    whole = HistogramForColumns(list(dict.fromkeys(c for i in several for c in i.columns))).result(frame)
    if isinstance(whole, dict):
        found.update({i: {c: whole[c] for c in i.columns} for i in several})


def _share_measures(frame: InspectedFrame, inspections: Iterable[Inspection], found: dict[Inspection, Any]) -> None:
    """One job for all that a node's rows are aggregated to."""
    several = {i: m for i in inspections if (m := i.measures(frame))}
    if len(several) > 1:
        parts = [(i, c, v) for i, m in several.items() for c, v in m.items()]
        row = frame.df.agg(*[v.alias(f"m{k}") for k, (_, _, v) in enumerate(parts)]).first()
        for k, (i, c, _) in enumerate(parts):
            found.setdefault(i, {})[c] = row[k]


def evaluate(recorder: Recorder, inspections: Iterable[Inspection], checks: Iterable[Check], parallel: int = PARALLEL) -> InspectorResult:
    """Results of all nodes. A node takes three jobs at most, however many inspections: counts, aggregates, first rows."""
    inspections = list(inspections)
    shared = [f for n, f in recorder.frames.items() if inspections and len(recorder.dag.successors(n)) > 1 and _worth_keeping(f)]
    for f in shared:
        f.hidden.persist()
    result = InspectionResult(recorder.dag, recorder.frames)

    def one(node: DagNode) -> None:
        frame, found = recorder.frames[node], result.results[node]
        _share_first_rows(frame, inspections)
        _share_histograms(frame, inspections, found)
        _share_measures(frame, inspections, found)
        for inspection in inspections:
            result.get(node, inspection)

    nodes = [n for n in recorder.dag.nodes if n in recorder.frames]
    for n in nodes:
        result.results[n] = {}
    try:
        with ThreadPoolExecutor(parallel) as pool:
            list(pool.map(one, nodes))
        verdicts = {check: check.evaluate(result) for check in checks}
    finally:
        for f in shared:
            f.hidden.unpersist()
    return InspectorResult(recorder.dag, result.results, verdicts, recorder.frames)


class PipelineInspector:
    """Fluent: choose the program, add inspections and checks, execute.

    >>> PipelineInspector.on_pipeline_from_py_file("p.py").add_check(NoIllegalFeatures()).execute(spark)  # doctest: +SKIP
    """

    def __init__(self, source: str | None, path: str, function: Callable[[SparkSession], Any] | None = None):
        self._source, self._path, self._function = source, path, function
        self._inspections: list[Inspection] = []
        self._checks: list[Check] = []
        self._patches: list[Patch] = []
        self._track = True

    @classmethod
    def on_pipeline_from_py_file(cls, path: str) -> PipelineInspector:
        return cls(pipeline_source(path=path), path)

    @classmethod
    def on_pipeline_from_ipynb_file(cls, path: str) -> PipelineInspector:
        return cls(pipeline_source(notebook=path), path)

    @classmethod
    def on_pipeline_from_string(cls, text: str) -> PipelineInspector:
        return cls(pipeline_source(text=text), "<pipeline>")

    @classmethod
    def on_function(cls, function: Callable[[SparkSession], Any]) -> PipelineInspector:
        """A function of the session; its own lines are what is recorded."""
        return cls(None, function.__code__.co_filename, function)

    def add_required_inspection(self, inspection: Inspection) -> PipelineInspector:
        return self.add_required_inspections([inspection])

    def add_required_inspections(self, inspections: Iterable[Inspection]) -> PipelineInspector:
        self._inspections += inspections
        return self

    def add_check(self, check: Check) -> PipelineInspector:
        return self.add_checks([check])

    def add_checks(self, checks: Iterable[Check]) -> PipelineInspector:
        self._checks += checks
        return self

    def set_code_reference_tracking(self, on: bool) -> PipelineInspector:
        self._track = on
        return self

    def add_custom_patches(self, patches: Iterable[Patch]) -> PipelineInspector:
        """More methods to record: class, name, and a function of the original, the object and the arguments."""
        self._patches += patches
        return self

    def execute(self, spark: SparkSession) -> InspectorResult:
        wanted = list(dict.fromkeys([*self._inspections, *[i for c in self._checks for i in c.required_inspections()]]))
        recorder = Recorder(wanted, self._track, self._source, self._path)
        with recording(recorder), captured(self._patches):
            if self._function is not None:
                self._function(spark)
            else:
                exec(compile(self._source, self._path, "exec"), {"__name__": "__main__", "spark": spark})
        return evaluate(recorder, wanted, list(dict.fromkeys(self._checks)))
