"""Drawing a DAG as DOT text."""

from __future__ import annotations

from pathlib import Path

from pipelens.plans.model import Dag, DagNode


def _label(node: DagNode, pretty: bool) -> str:
    name = node.operator.value.replace(" (Modify)", "").replace("Encountered unsupported operation! Fallback: Data Source", "Missing Op")
    if not pretty:
        return f"{node.node_id}: {name}"
    text = f"{name} (L{node.code_location.lineno})"
    return f"{text}\\n{node.details.description}" if node.details.description else text


def to_dot(dag: Dag, pretty: bool = True) -> str:
    quote = lambda text: '"' + text.replace('"', '\\"') + '"'
    lines = ["digraph pipeline {"]
    lines += [f"  {n.node_id} [label={quote(_label(n, pretty))}];" for n in dag.nodes]
    lines += [f"  {a.node_id} -> {b.node_id};" for a, b in dag.edges]
    return "\n".join([*lines, "}"])


def save_dot(dag: Dag, path: str | Path, pretty: bool = True) -> None:
    Path(path).write_text(to_dot(dag, pretty), encoding="utf-8")


def describe(dag: Dag) -> str:
    """One line a node, in order of recording, with its inputs."""
    out = []
    for n in dag.nodes:
        inputs = ", ".join(str(p.node_id) for p in dag.predecessors(n))
        out.append(f"{n.node_id} {n.operator.value}" + (f" [{n.details.description}]" if n.details.description else "") + (f" <- {inputs}" if inputs else ""))
    return "\n".join(out)
