"""What a run records: the DAG, and for each node the frame that its inspections look at."""

from __future__ import annotations

import contextlib
import sys
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import TYPE_CHECKING

from pipelens.plans.model import (
    BasicCodeLocation,
    CodeReference,
    Dag,
    DagNode,
    DagNodeDetails,
    FunctionInfo,
    OperatorContext,
    OperatorType,
    OptionalCodeInfo,
)

if TYPE_CHECKING:
    from pipelens.inspections.base import Annotation, Inspection
    from pipelens.operators.frame import InspectedFrame

_current: list[Recorder] = []


@dataclass
class Recorder:
    """Collects nodes. Frames made while it is active belong to it."""

    inspections: list[Inspection] = field(default_factory=list)
    track_code: bool = True
    source: str | None = None
    source_path: str | None = None
    dag: Dag = field(default_factory=Dag)
    frames: dict[DagNode, InspectedFrame] = field(default_factory=dict)
    suspended: int = 0
    _next: int = 0
    _next_missing: int = -1

    @property
    def annotations(self) -> list[Annotation]:
        found: dict[str, Annotation] = {}
        for inspection in self.inspections:
            for a in inspection.annotations():
                found.setdefault(a.name, a)
        return list(found.values())

    def place(self) -> tuple[BasicCodeLocation, OptionalCodeInfo | None]:
        """The pipeline's own line that led here: the nearest frame outside this package and Spark."""
        frame = sys._getframe(1)
        while frame is not None:
            name = frame.f_code.co_filename
            if name == self.source_path or (self.source_path is None and not ("pipelens" in name or "pyspark" in name)):
                break
            frame = frame.f_back
        if frame is None:
            return BasicCodeLocation("<unknown>", 0), None
        location = BasicCodeLocation(frame.f_code.co_filename, frame.f_lineno)
        if not self.track_code:
            return location, None
        for i, position in enumerate(frame.f_code.co_positions()):
            if i == frame.f_lasti // 2:
                line, end_line, column, end_column = position
                if None in position:
                    break
                return location, OptionalCodeInfo(CodeReference(line, column, end_line, end_column), self._segment(frame, line, end_line, column, end_column))
        return location, None

    def _segment(self, frame, line: int, end_line: int, column: int, end_column: int) -> str:
        lines = self.source.splitlines() if self.source is not None else None
        if lines is None:
            import linecache

            lines = [x.rstrip("\n") for x in linecache.getlines(frame.f_code.co_filename)]
        part = lines[line - 1 : end_line]
        if not part:
            return ""
        part[-1] = part[-1].encode()[:end_column].decode(errors="ignore")
        part[0] = part[0].encode()[column:].decode(errors="ignore")
        return "\n".join(part)

    def add(
        self,
        operator: OperatorType,
        function: tuple[str, str] | None,
        description: str | None,
        columns: list[str],
        parents: list[DagNode],
        args: dict[str, object] | None = None,
        code: tuple[BasicCodeLocation, OptionalCodeInfo | None] | None = None,
    ) -> DagNode:
        if operator == OperatorType.MISSING_OP:
            node_id, self._next_missing = self._next_missing, self._next_missing - 1
        else:
            node_id, self._next = self._next, self._next + 1
        location, info = code or self.place()
        context = OperatorContext(operator, FunctionInfo(*function) if function else None, tuple((args or {}).items()))
        node = DagNode(node_id, location, context, DagNodeDetails(description, tuple(columns)), info)
        self.dag.add_node(node, parents)
        return node


def current() -> Recorder:
    """The active recorder; outside of a run a new one without inspections."""
    return _current[-1] if _current else Recorder()


def active() -> Recorder | None:
    return _current[-1] if _current and not _current[-1].suspended else None


@contextlib.contextmanager
def recording(recorder: Recorder) -> Iterator[Recorder]:
    _current.append(recorder)
    try:
        yield recorder
    finally:
        _current.remove(recorder)


@contextlib.contextmanager
def suspended(recorder: Recorder | None) -> Iterator[None]:
    """Calls inside are not recorded."""
    if recorder is None:
        yield
        return
    recorder.suspended += 1
    try:
        yield
    finally:
        recorder.suspended -= 1
