"""Figures as SVG text: the DAG in layers, and the groups that a check looked at as bars."""

from __future__ import annotations

from collections.abc import Sequence
from html import escape
from pathlib import Path
from typing import TYPE_CHECKING, Any

from pipelens.plans.model import Dag, DagNode

if TYPE_CHECKING:
    from pipelens.checks import BiasFinding

BOX, GAP, ROW = (190, 44), 24, 90
BEFORE, AFTER, BAD = "#9aa5b1", "#3b6ea8", "#b3402f"


def _svg(width: float, height: float, parts: Sequence[str]) -> str:
    head = f'<svg xmlns="http://www.w3.org/2000/svg" width="{width:.0f}" height="{height:.0f}" font-family="sans-serif" font-size="11">'
    return "\n".join([head, f'<rect width="{width:.0f}" height="{height:.0f}" fill="white"/>', *parts, "</svg>"])


def _text(x: float, y: float, text: str, anchor: str = "middle") -> str:
    return f'<text x="{x:.1f}" y="{y:.1f}" text-anchor="{anchor}">{escape(text)}</text>'


def dag_figure(dag: Dag) -> str:
    """Nodes as boxes, each in the layer below its inputs."""
    layer: dict[DagNode, int] = {}
    for n in dag.nodes:  # inputs are recorded before their users
        layer[n] = 1 + max((layer[p] for p in dag.predecessors(n)), default=-1)
    rows: dict[int, list[DagNode]] = {}
    for n, k in layer.items():
        rows.setdefault(k, []).append(n)
    wide = max((len(r) for r in rows.values()), default=1)
    width = wide * (BOX[0] + GAP) + GAP
    place = {}
    for k, nodes in rows.items():
        left = (width - len(nodes) * (BOX[0] + GAP) + GAP) / 2
        place |= {n: (left + i * (BOX[0] + GAP), GAP + k * ROW) for i, n in enumerate(nodes)}
    parts = ['<defs><marker id="tip" markerWidth="8" markerHeight="8" refX="7" refY="4" orient="auto"><path d="M0,0L8,4L0,8z" fill="#555"/></marker></defs>']
    for a, b in dag.edges:
        (xa, ya), (xb, yb) = place[a], place[b]
        parts.append(f'<line x1="{xa + BOX[0] / 2:.1f}" y1="{ya + BOX[1]:.1f}" x2="{xb + BOX[0] / 2:.1f}" y2="{yb:.1f}" stroke="#555" marker-end="url(#tip)"/>')
    for n, (x, y) in place.items():
        said = n.details.description or ""
        parts.append(f'<rect x="{x:.1f}" y="{y:.1f}" width="{BOX[0]}" height="{BOX[1]}" rx="5" fill="#eef2f7" stroke="#3b6ea8"/>')
        parts.append(_text(x + BOX[0] / 2, y + 18, f"{n.node_id} {n.operator.value}"[:34]))
        parts.append(_text(x + BOX[0] / 2, y + 34, said if len(said) <= 34 else said[:33] + "…"))
    return _svg(width, GAP + len(rows) * ROW, parts)


def _bars(title: str, groups: Sequence[str], series: Sequence[tuple[str, str, Sequence[float]]], limit: float | None = None) -> str:
    """Bars side by side for each group; a dashed line at ``limit``."""
    top = max([1e-9, limit or 0.0, *[v for _, _, values in series for v in values]])
    each = 26 * len(series) + 30
    width, height = max(320, 60 + each * max(1, len(groups))), 260
    y = lambda v: 210 - 160 * min(v, top) / top
    parts = [_text(width / 2, 18, title), f'<line x1="40" y1="210" x2="{width - 10}" y2="210" stroke="#555"/>']
    for j, (name, colour, values) in enumerate(series):
        parts.append(f'<rect x="{44 + 120 * j}" y="28" width="10" height="10" fill="{colour}"/>' + _text(58 + 120 * j, 37, name, "start"))
        for i, v in enumerate(values):
            x = 50 + each * i + 26 * j
            parts.append(f'<rect x="{x}" y="{y(v):.1f}" width="24" height="{210 - y(v):.1f}" fill="{colour}"/>' + _text(x + 12, y(v) - 3, f"{v:.2f}"))
    for i, g in enumerate(groups):
        parts.append(_text(50 + each * i + 13 * len(series), 226, str(g)[:16]))
    if limit is not None:
        parts.append(f'<line x1="40" y1="{y(limit):.1f}" x2="{width - 10}" y2="{y(limit):.1f}" stroke="{BAD}" stroke-dasharray="4 3"/>')
    return _svg(width, height, parts)


def _rows(finding: BiasFinding) -> list[dict[str, Any]]:
    if not hasattr(finding.table, "to_dict"):
        raise ValueError("too many groups to draw; the finding's table is a DataFrame")
    return finding.table.to_dict("records")


def _name(value: Any) -> str:
    return value if isinstance(value, str) else "(none)"


def _known(value: Any) -> float:
    return float(value) if value is not None and value == value else 0.0


def ratio_figure(finding: BiasFinding) -> str:
    """A group's share before and after the operator."""
    rows = _rows(finding)
    shares = [(said, colour, [_known(r[c]) for r in rows]) for said, colour, c in (("share before", BEFORE, "ratio_before"), ("share after", AFTER, "ratio_after"))]
    return _bars(f"{finding.node.operator.value}: {finding.column}", [_name(r["value"]) for r in rows], shares)


def removal_figure(finding: BiasFinding, normalized: bool = False, limit: float | None = None) -> str:
    """How likely a group's rows were to be removed, by itself or over the least likely group."""
    rows = _rows(finding)
    column = "normalized_removal_probability" if normalized else "removal_probability"
    series = [("times the least" if normalized else "removed", AFTER if finding.acceptable else BAD, [_known(r[column]) for r in rows])]
    return _bars(f"{finding.node.operator.value}: {finding.column}", [_name(r["value"]) for r in rows], series, limit)


def save_figure(svg: str, path: str | Path) -> None:
    Path(path).write_text(svg, encoding="utf-8")
