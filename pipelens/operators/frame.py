"""InspectedFrame: a DataFrame, its DAG node and the hidden columns that follow its rows.

Hidden columns: ``__ord``, the row's place as an array of row ids (of one source, or of both sides of a join), and one
column for each annotation that the active inspections need. They are ordinary columns of the lazy plan, so they pass
through filters and joins without a second join, and Catalyst prunes those that nobody reads.
"""

from __future__ import annotations

import threading
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pipelens.plans.model import DagNode, OperatorType
from pipelens.plans.recorder import Recorder, current, suspended
from pipelens.storage import grouped_median, ordinal

ORD = "__ord"
LAST = 2**63 - 1
DF = "pyspark.sql.DataFrame"


def is_hidden(name: str) -> bool:
    return name.startswith("__")


def q(name: str) -> Column:
    return F.col(f"`{name}`")


class InspectedFrame:
    #: The first rows, once collected: how many, and the rows.
    first_rows: tuple[int, DataFrame] | None = None

    def __init__(self, hidden: DataFrame, node: DagNode, recorder: Recorder):
        self.hidden, self.node, self.recorder = hidden, node, recorder
        recorder.frames[node] = self

    # --- views -------------------------------------------------------------------------------------------------------

    @property
    def spark(self) -> SparkSession:
        return self.hidden.sparkSession

    @property
    def columns(self) -> list[str]:
        return [c for c in self.hidden.columns if not is_hidden(c)]

    @property
    def quoted(self) -> list[Column]:
        return [q(c) for c in self.columns]

    @property
    def df(self) -> DataFrame:
        """The data alone."""
        return self.hidden.select(*self.quoted)

    def first(self, n: int) -> DataFrame:
        held = self.first_rows
        return (held[1] if held and held[0] >= n else self.hidden).orderBy(ORD).limit(n)

    # --- making nodes ------------------------------------------------------------------------------------------------

    @staticmethod
    def from_source(
        df: DataFrame,
        row_id: Column,
        operator: OperatorType = OperatorType.DATA_SOURCE,
        function: tuple[str, str] | None = None,
        description: str | None = None,
        parents: Sequence[DagNode] = (),
        recorder: Recorder | None = None,
    ) -> InspectedFrame:
        recorder = recorder or current()
        names = [c for c in df.columns if not is_hidden(c)]
        node = recorder.add(operator, function, description, names, list(parents))
        row_id = row_id.cast("bigint")
        hidden = df.select(
            *[q(c) for c in names],
            F.array(row_id).alias(ORD),
            *[a.source(node.node_id, names, row_id).alias(a.name) for a in recorder.annotations],
        )
        return InspectedFrame(hidden, node, recorder)

    def _unary(
        self,
        operator: OperatorType,
        function: tuple[str, str],
        description: str | None,
        change: Callable[[DataFrame], DataFrame],
        columns: Sequence[str] | None = None,
        args: dict[str, object] | None = None,
        imputed: bool = False,
    ) -> InspectedFrame:
        """Annotations take the input's values, then the data changes; an imputer's take its output's."""
        here = self.recorder.annotations
        fresh = self.hidden.withColumns({a.name: a.unary(self.columns, q(a.name)) for a in here}) if here else self.hidden
        out = change(fresh)
        visible = [c for c in out.columns if not is_hidden(c)]
        if imputed and here:
            out = out.withColumns({a.name: a.imputed(visible, q(a.name)) for a in here})
        node = self.recorder.add(operator, function, description, list(visible if columns is None else columns), [self.node], args)
        return InspectedFrame(out, node, self.recorder)

    @property
    def _hidden_columns(self) -> list[Column]:
        return [q(c) for c in self.hidden.columns if is_hidden(c)]

    # --- selections and projections ----------------------------------------------------------------------------------

    def filter(self, condition: Column | str, description: str | None = None) -> InspectedFrame:
        condition = F.expr(condition) if isinstance(condition, str) else condition
        return self._unary(OperatorType.SELECTION, (DF, "filter"), description or "Select by condition", lambda df: df.filter(condition))

    where = filter

    def dropna(self, how: str = "any", thresh: int | None = None, subset: Sequence[str] | None = None) -> InspectedFrame:
        looked_at = list(subset) if subset else self.columns
        return self._unary(OperatorType.SELECTION, (DF, "dropna"), "dropna", lambda df: df.dropna(how, thresh, looked_at))

    def select(self, *columns: str) -> InspectedFrame:
        names = [c for group in columns for c in ([group] if isinstance(group, str) else group)]
        missing = [c for c in names if c not in self.columns]
        if missing:
            raise KeyError(f"no such columns: {missing}")
        return self._unary(OperatorType.PROJECTION, (DF, "select"), f"to {names}", lambda df: df.select(*[q(c) for c in names], *self._hidden_columns))

    def __getitem__(self, key: str | list[str] | Column) -> InspectedFrame:
        if isinstance(key, Column):
            return self.filter(key)
        if isinstance(key, str):
            return self.select(key)
        if isinstance(key, (list, tuple)) and all(isinstance(k, str) for k in key):
            return self.select(*key)
        raise NotImplementedError(f"a frame takes a column name, a list of names or a condition, not {type(key).__name__}")

    def with_column(self, name: str, value: Column) -> InspectedFrame:
        if not isinstance(name, str):
            raise NotImplementedError("only columns named by a string can be set")
        return self._unary(OperatorType.PROJECTION_MODIFY, (DF, "withColumn"), f"modifies ['{name}']", lambda df: df.withColumn(name, value))

    def with_columns(self, values: dict[str, Column]) -> InspectedFrame:
        return self._unary(OperatorType.PROJECTION_MODIFY, (DF, "withColumns"), f"modifies {list(values)}", lambda df: df.withColumns(values))

    def rename(self, old: str, new: str) -> InspectedFrame:
        return self._unary(OperatorType.PROJECTION_MODIFY, (DF, "withColumnRenamed"), f"renames '{old}' to '{new}'", lambda df: df.withColumnRenamed(old, new))

    def drop(self, *names: str) -> InspectedFrame:
        return self.select(*[c for c in self.columns if c not in names])

    def fillna(self, value: object, subset: Sequence[str] | None = None) -> InspectedFrame:
        """Nulls become the value, in the columns of its type; a dict gives a value for each column."""
        names = list(subset) if subset else self.columns
        fill = lambda df: df.fillna(value) if isinstance(value, dict) else df.fillna(value, names)
        return self._unary(OperatorType.PROJECTION_MODIFY, (DF, "fillna"), f"fills nulls with {value!r}", fill)

    def replace(self, old: object, new: object = None, subset: Sequence[str] | None = None) -> InspectedFrame:
        """Exact values, in all columns of the values' type or in some; ``old`` may be a dict, or a list with one or as many substitutes."""
        if isinstance(old, Column) or isinstance(new, Column):
            raise NotImplementedError("replace takes values, not expressions")
        names = list(subset) if subset else self.columns
        said = f"Replace {old}" if isinstance(old, dict) else f"Replace '{old}' with '{new}'"
        change = lambda df: df.replace(old, subset=names) if isinstance(old, dict) else df.replace(old, new, subset=names)
        return self._unary(OperatorType.PROJECTION_MODIFY, (DF, "replace"), said, change)

    def distinct(self, subset: Sequence[str] | None = None) -> InspectedFrame:
        """Of rows that are equal (in the columns of ``subset``) the first one stays."""
        keys = list(subset) if subset else self.columns

        def change(df: DataFrame) -> DataFrame:
            rest = [c for c in df.columns if c not in keys and c != ORD]
            first = F.min_by(F.struct(q(ORD), *[q(c) for c in rest]), q(ORD)).alias("__first")
            rows = df.groupBy(*[q(k) for k in keys]).agg(first)
            return rows.select(*[q(c) if c in keys else F.col("__first").getField(c).alias(c) for c in df.columns])

        return self._unary(OperatorType.SELECTION, (DF, "distinct"), "distinct" + (f" by {keys}" if subset else ""), change)

    def limit(self, n: int) -> InspectedFrame:
        """The first n rows in order of the row ids."""
        return self._unary(OperatorType.SELECTION, (DF, "limit"), f"first {n} rows", lambda df: df.orderBy(ORD).limit(n))

    def union(self, other: InspectedFrame | DataFrame, by_name: bool = False) -> InspectedFrame:
        """Rows of both, columns by place or by name; each row keeps its lineage and its annotations."""
        other = tracked(other)
        if len(self.columns) != len(other.columns) or (by_name and set(self.columns) != set(other.columns)):
            raise ValueError("both frames need the same columns")
        names = self.columns if by_name else other.columns
        marks = [a.name for a in self.recorder.annotations]
        place = lambda k: F.concat(F.array(F.lit(k).cast("bigint")), q(ORD)).alias(ORD)
        top = self.hidden.select(*self.quoted, place(0), *[q(m) for m in marks])
        below = other.hidden.select(*[q(c).alias(n) for c, n in zip(names, self.columns)], place(1), *[q(m) for m in marks])
        node = self.recorder.add(OperatorType.CONCATENATION, (DF, "union"), "union of rows", self.columns, [self.node, other.node])
        return InspectedFrame(top.unionAll(below), node, self.recorder)

    def label_binarize(self, classes: Sequence[object], column: str | None = None) -> InspectedFrame:
        """One 0/1 value for two classes, the second being 1; one value for each class of more."""
        column = column or self.columns[0]
        c = q(column)
        hot = lambda k: F.when(c == F.lit(k), 1.0).otherwise(0.0)
        values = [hot(classes[-1])] if len(classes) <= 2 else [hot(k) for k in classes]
        description = f"label_binarize, classes: {list(classes)}"
        return self._unary(
            OperatorType.PROJECTION_MODIFY, ("pipelens.operators.frame", "label_binarize"), description,
            lambda df: df.select(F.array(*values).alias("array"), *self._hidden_columns), ["array"],
        )

    def add_constant(self) -> InspectedFrame:
        """A leading 1.0: before the numbers of a vector column, or as an array of all columns."""
        single = self.columns == ["array"]
        value = F.concat(F.array(F.lit(1.0)), F.col("array")) if single else F.array(F.lit(1.0), *[x.cast("double") for x in self.quoted])
        return self._unary(
            OperatorType.PROJECTION_MODIFY, ("pipelens.operators.frame", "add_constant"), "Adds const column",
            lambda df: df.select(value.alias("array"), *self._hidden_columns), ["array"],
        )

    # --- joins -------------------------------------------------------------------------------------------------------

    def join(
        self,
        other: InspectedFrame | DataFrame,
        on: str | Sequence[str] | Column | None = None,
        how: str = "inner",
        left_on: str | None = None,
        right_on: str | None = None,
        left_index: bool = False,
        right_index: bool = False,
        sort: bool = False,
        suffixes: tuple[str, str] = ("_x", "_y"),
    ) -> InspectedFrame:
        """Null keys match each other. Columns that both sides have, other than shared keys, get suffixes.

        ``on`` may be a condition over the columns of frames whose names differ. Semi and anti joins keep the left
        rows as they are.
        """
        other = tracked(other)
        how = {"outer": "full", "full_outer": "full", "fullouter": "full", "left_outer": "left", "leftouter": "left", "right_outer": "right", "rightouter": "right", "semi": "left_semi", "leftsemi": "left_semi", "anti": "left_anti", "leftanti": "left_anti"}.get(how, how)
        conditions = [c for c in ([on] if isinstance(on, Column) else on if isinstance(on, (list, tuple)) else []) if isinstance(c, Column)]
        if conditions:
            return self._join_where(other, reduce(lambda a, b: a & b, conditions), how)
        keys = [on] if isinstance(on, str) else list(on or [])
        if not (keys or left_on or left_index) and how != "cross":
            keys = [c for c in self.columns if c in other.columns]
        ln, rn = [f"__l{i}" for i in range(len(self.hidden.columns))], [f"__r{i}" for i in range(len(other.hidden.columns))]
        fresh = [q(c).alias(n) for c, n in zip(self.hidden.columns, ln)]
        left = self.hidden.select(*fresh)
        right = other.hidden.select(*[q(c).alias(n) for c, n in zip(other.hidden.columns, rn)])
        l, r = dict(zip(self.hidden.columns, map(F.col, ln))), dict(zip(other.hidden.columns, map(F.col, rn)))
        if how == "cross":
            joined, said = left.crossJoin(right), "cross"
        else:
            if left_index and right_index:
                pairs, said = [(l[ORD], r[ORD])], "on left_index == right_index"
            elif left_on or right_on:
                pairs, said = [(l[left_on] if left_on else l[ORD], r[right_on] if right_on else r[ORD])], f"on '{left_on or 'left_index'}' == '{right_on or 'right_index'}'"
            else:
                pairs, said = [(l[k], r[k]) for k in keys], f"on {', '.join(repr(k) for k in keys)}"
            joined = left.join(right, reduce(lambda a, b: a & b, [a.eqNullSafe(b) for a, b in pairs]), how)
            said += "" if how == "inner" else f" ({'outer' if how == 'full' else how})"
        if how in ("left_semi", "left_anti"):
            node = self.recorder.add(OperatorType.JOIN, (DF, "join"), said, self.columns, [self.node, other.node])
            return InspectedFrame(joined.select(*[v.alias(k) for k, v in l.items()]), node, self.recorder)
        outputs: dict[str, Column] = {}
        for c in self.columns:
            if c in keys:
                outputs[c] = F.coalesce(l[c], r[c]) if how in ("full", "right") else l[c]
            else:
                outputs[c + suffixes[0] if c in other.columns else c] = l[c]
        for c in other.columns:
            if c not in keys:
                outputs[c + suffixes[1] if c in self.columns else c] = r[c]
        nobody = F.array(F.lit(LAST))
        order = F.concat(F.coalesce(l[ORD], nobody), F.coalesce(r[ORD], nobody))
        hidden = {ORD: order} | {a.name: a.nary(outputs, [l[a.name], r[a.name]]) for a in self.recorder.annotations}
        out = joined.select(*[v.alias(k) for k, v in outputs.items()], *[v.alias(k) for k, v in hidden.items()])
        if sort and keys:
            out = out.orderBy(*[q(k) for k in keys], ORD)
        node = self.recorder.add(OperatorType.JOIN, (DF, "join"), said, list(outputs), [self.node, other.node])
        return InspectedFrame(out, node, self.recorder)

    merge = join

    def _join_where(self, other: InspectedFrame, condition: Column, how: str) -> InspectedFrame:
        """A join on a condition, which speaks of the two sides' own columns; these keep their identity."""
        both = set(self.columns) & set(other.columns)
        if both:
            raise NotImplementedError(f"a join on a condition needs different names on both sides; both have {sorted(both)}")
        left = self.hidden.select(*self.quoted, *[q(c).alias(f"__l{c}") for c in self.hidden.columns if is_hidden(c)])
        right = other.hidden.select(*other.quoted, *[q(c).alias(f"__r{c}") for c in other.hidden.columns if is_hidden(c)])
        joined = left.join(right, condition, how)
        said = f"on {condition}" + ("" if how == "inner" else f" ({'outer' if how == 'full' else how})")
        if how in ("left_semi", "left_anti"):
            names, out = self.columns, joined.select(*self.quoted, *[q(f"__l{c}").alias(c) for c in self.hidden.columns if is_hidden(c)])
        else:
            names, nobody = [*self.columns, *other.columns], F.array(F.lit(LAST))
            order = F.concat(F.coalesce(q(f"__l{ORD}"), nobody), F.coalesce(q(f"__r{ORD}"), nobody))
            outputs = {c: q(c) for c in names}
            marks = [a.nary(outputs, [q(f"__l{a.name}"), q(f"__r{a.name}")]).alias(a.name) for a in self.recorder.annotations]
            out = joined.select(*outputs.values(), order.alias(ORD), *marks)
        node = self.recorder.add(OperatorType.JOIN, (DF, "join"), said, names, [self.node, other.node])
        return InspectedFrame(out, node, self.recorder)

    # --- aggregation -------------------------------------------------------------------------------------------------

    def groupby(self, *keys: str) -> Grouped:
        return Grouped(self, [k for group in keys for k in ([group] if isinstance(group, str) else group)])

    # --- split -------------------------------------------------------------------------------------------------------

    def train_test_split(self, test_size: float = 0.25, seed: int = 0) -> tuple[InspectedFrame, InspectedFrame]:
        """Two disjoint parts in a random order of the rows that the seed fixes; the test part has ceil(test_size * n) rows.

        A row's place in the order is the md5 of seed and row id. The boundary is found from counts by the first four
        hexadecimal digits (65,536 at most), so that only the rows of one such bin are ranked.
        """
        key = F.md5(F.concat_ws("-", F.lit(str(seed)), F.array_join(F.col(ORD).cast("array<string>"), "-")))
        keyed = self.hidden.withColumn("__key", key)
        bins = sorted((r[0], r[1]) for r in keyed.groupBy(F.substring("__key", 1, 4)).count().collect())
        n = sum(c for _, c in bins)
        wanted = -int(-test_size * n // 1)
        edge, before = "g", 0
        for name, c in bins:
            if before + c >= wanted:
                edge = name
                break
            before += c
        head = F.substring("__key", 1, 4)
        boundary = keyed.where(head == edge).select("__key").orderBy("__key").limit(max(0, wanted - before)).agg(F.max("__key")).first()[0]
        last = boundary or (edge if edge != "g" else "")
        info = ("pipelens.operators.frame", "train_test_split")
        args = {"test_size": test_size, "seed": seed}
        is_test = F.col("__key") <= F.lit(last)
        pick = lambda part: lambda df: df.withColumn("__key", key).where(part).drop("__key")
        train = self._unary(OperatorType.TRAIN_TEST_SPLIT, info, "(Train Data)", pick(~is_test), args=args)
        test = self._unary(OperatorType.TRAIN_TEST_SPLIT, info, "(Test Data)", pick(is_test), args=args)
        return train, test


class GroupedFrame(InspectedFrame):
    """Groups. Their row ids, places in the order of the keys, are worked out when something first asks for them."""

    def __init__(self, groups: DataFrame, keys: list[str], node: DagNode, recorder: Recorder):
        self.groups, self.keys, self.node, self.recorder = groups, keys, node, recorder
        self._numbered: DataFrame | None = None
        self._lock = threading.Lock()
        recorder.frames[node] = self

    @property
    def columns(self) -> list[str]:
        return self.groups.columns

    @property
    def df(self) -> DataFrame:
        return self.groups if self._numbered is None else self._numbered.select(*self.quoted)

    @property
    def spark(self) -> SparkSession:
        return self.groups.sparkSession

    @property
    def hidden(self) -> DataFrame:
        with self._lock:
            if self._numbered is None:
                with suspended(self.recorder):
                    rows = ordinal(self.groups, [q(k) for k in self.keys], "__rid")
                names, rid = self.groups.columns, F.col("__rid")
                marks = [a.source(self.node.node_id, names, rid).alias(a.name) for a in self.recorder.annotations]
                self._numbered = rows.select(*self.quoted, F.array(rid).alias(ORD), *marks)
            return self._numbered


class Grouped:
    """A frame with keys; ``agg`` makes the node. Rows with a null key drop out; groups are new source rows by key order."""

    FUNCTIONS = {
        "mean": F.avg, "avg": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "count": F.count, "std": F.stddev_samp, "var": F.var_samp,
        "nunique": F.count_distinct, "first": F.first, "last": F.last,
    }

    def __init__(self, frame: InspectedFrame, keys: list[str]):
        self.frame, self.keys = frame, keys

    def agg(self, spec: dict[str, str] | None = None, **named: tuple[str, str] | Column) -> InspectedFrame:
        wanted: dict[str, tuple[str, str] | Column] = {c: (c, f) for c, f in (spec or {}).items()} | named
        if not wanted:
            raise ValueError("agg needs an aggregate")
        medians = {name: v[0] for name, v in wanted.items() if not isinstance(v, Column) and v[1] == "median"}
        others = {name: v for name, v in wanted.items() if name not in medians}
        values = [(v if isinstance(v, Column) else self.FUNCTIONS[v[1]](q(v[0]))).alias(name) for name, v in others.items()]
        shown = {k: v if isinstance(v, tuple) else str(v) for k, v in wanted.items()}
        return self.agg_columns(values, str(shown), medians, list(wanted))

    def agg_columns(self, values: Sequence[Column], shown: str, medians: dict[str, str] | None = None, order: Sequence[str] | None = None) -> InspectedFrame:
        """Aggregates given as named expressions; medians by name and column."""
        keys, frame = [q(k) for k in self.keys], self.frame
        rows = frame.df.where(reduce(lambda a, b: a & b, [k.isNotNull() for k in keys]))
        groups = rows.groupBy(*keys).agg(*values) if values else rows.select(*keys).distinct()
        for name, column in (medians or {}).items():
            with suspended(frame.recorder):
                groups = groups.join(grouped_median(rows, self.keys, q(column), name), self.keys, "left")
        if medians:
            groups = groups.select(*keys, *[q(c) for c in order])
        described = f"Groupby {', '.join(repr(k) for k in self.keys)}, Aggregate: '{shown}'"
        node = frame.recorder.add(OperatorType.GROUP_BY_AGG, ("pyspark.sql.GroupedData", "agg"), described, groups.columns, [frame.node])
        return GroupedFrame(groups, self.keys, node, frame.recorder)


def tracked(data: InspectedFrame | DataFrame) -> InspectedFrame:
    """The frame behind a DataFrame of a recorded program; one of unknown origin is adopted."""
    if isinstance(data, InspectedFrame):
        return data
    found = getattr(data, "_pipelens", None)
    if found is not None:
        return found
    from pipelens.sources import adopt

    return adopt(data)


def concat(*frames: InspectedFrame, description: str | None = None) -> InspectedFrame:
    """Feature arrays of frames with the same rows, side by side (joined by row)."""
    recorder, first = frames[0].recorder, frames[0]
    out = first.hidden.withColumnRenamed("array", "__v0")
    for i, f in enumerate(frames[1:], 1):
        names = {a.name: f"{a.name}__{i}" for a in recorder.annotations}
        side = f.hidden.select(F.col(ORD).alias("__o"), F.col("array").alias(f"__v{i}"), *[q(a).alias(b) for a, b in names.items()])
        out = out.join(side, F.col(ORD) == F.col("__o")).drop("__o")
    values = {"array": F.concat(*[F.col(f"__v{i}") for i in range(len(frames))])}
    hidden = {ORD: F.col(ORD)} | {
        a.name: a.nary(values, [q(a.name), *[q(f"{a.name}__{i}") for i in range(1, len(frames))]]) for a in recorder.annotations
    }
    node = recorder.add(OperatorType.CONCATENATION, ("pipelens.functions", "ColumnTransformer"), description, ["array"], [f.node for f in frames])
    return InspectedFrame(out.select(*[v.alias(k) for k, v in (values | hidden).items()]), node, recorder)
