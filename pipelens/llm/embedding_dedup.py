"""Near-duplicate vectors: spherical k-means cells, blocked cosine products within cells.

Vectors of equal label and length, and of equal values, are one class with a count, so that copies of any number are one
row. Centroids are trained on a bounded sample (MAX_SAMPLE classes in order of a hash). Each class lives in the cell of
its nearest centroid. It is also a guest in each earlier cell that may hold a vector within the angle of the threshold:
that is so unless its distance to the plane between the two centroids exceeds the angle's sine. Of two linked vectors in
different cells the one in the later cell is thus a guest of the other, and no link is lost.

There are as many cells as give about CELL_ROWS classes a cell, at most MAX_CELLS, but no more than COPIES copies of a
class on average, as the sample shows: on vectors that point everywhere nearly every cell may hold a neighbour, and few
cells stay; the more the vectors cluster, the more cells there are.

The classes of a label in a cell are dealt to groups of about GROUP_ROWS, one in most cells. A task holds the vectors
of one group and multiplies them, in blocks and in double precision, with each other and with all later groups and
guests of the cell, which pass by in a stream. So a vector is sent once for each cell it visits and once for each
further group of a cell that is larger than a task. A block of products gives each class's number of links, and links
that join what it joins, fewer than it has classes, never all pairs.

Vectors that are null, empty, zero or hold null or non-finite components link with nothing, neither do rows with a null
label. Vectors whose length is not the commonest share the first cell. Rows with equal ids are vectors of their own in
the counts and one node in the components. Extra columns are left out; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pipelens.llm.common import connected_components, discard, staged
from pipelens.llm.vectors import usable

CELL_ROWS, MAX_CELLS, MAX_SAMPLE, COPIES = 256, 4096, 16_384, 3.5
GROUP_ROWS, BLOCK = 16_384, 1024


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """k unit centroids of unit vectors; an empty cell takes the vector that is farthest from its own centroid."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        s = x @ c.T
        own = s.argmax(1)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        worst = np.argsort(s[np.arange(len(x)), own])
        for j, empty in enumerate(np.flatnonzero(np.bincount(own, minlength=k) == 0)):
            sums[empty] = x[worst[j % len(x)]]
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(norm > 0, sums / np.maximum(norm, 1e-30), c)
    return c


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def guests(s: np.ndarray, home: np.ndarray, centroids: np.ndarray, sine: float) -> np.ndarray:
    """For products with the centroids: the earlier cells that may hold a vector within the angle of each row."""
    gap = np.sqrt(np.maximum(0, 2 - 2 * (centroids @ centroids.T)))[home] if len(centroids) <= 512 else np.linalg.norm(centroids[home][:, None] - centroids[None], axis=2)
    near = s[np.arange(len(s)), home][:, None] - s <= sine * gap + 1e-9
    return near & (np.arange(len(centroids)) < home[:, None])


def choose_centroids(x: np.ndarray, count: int, sine: float, cell_rows: int, copies: float) -> np.ndarray:
    """Centroids trained on unit vectors ``x``, a sample of ``count``: as many as asked for, while guests are few."""
    most = min(MAX_CELLS, len(x) // 4, -(-count // cell_rows))
    best, k = spherical_kmeans(x, 1), 2
    while k <= most:
        c = spherical_kmeans(x, k)
        part = x[:2048]
        s = part @ c.T
        if k > 2 and 1 + guests(s, s.argmax(1), c, sine).sum(1).mean() > copies:
            break
        best, k = c, 2 * k
    return best


def _assign(batches: Iterator[pa.RecordBatch], centroids: np.ndarray, sine: float) -> Iterator[pa.RecordBatch]:
    """Home (first) and guest cells of each class, as lists."""
    for batch in batches:
        vectors = batch.column(batch.schema.get_field_index("vector"))
        cells = []
        lengths = np.diff(vectors.offsets.to_numpy())
        flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        ends = np.cumsum(lengths)
        ok = lengths == centroids.shape[1]
        for at in range(0, len(batch), 1024):
            some = np.arange(at, min(at + 1024, len(batch)))
            fit = some[ok[some]]
            found = {}
            if len(fit):
                s = unit(np.stack([flat[ends[i] - lengths[i] : ends[i]] for i in fit])) @ centroids.T
                home = s.argmax(1)
                found = {i: [int(h), *map(int, np.flatnonzero(g))] for i, h, g in zip(fit, home, guests(s, home, centroids, sine))}
            cells += [found.get(i, [0]) for i in some]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells, pa.list_(pa.int32()))], names=[*batch.schema.names, "cells"])


class _Group:
    """The vectors of one group, and what they link with so far."""

    def __init__(self):
        self.reps, self.ns, self.parts = np.zeros(0, np.int64), np.zeros(0, np.int64), []
        self.x: np.ndarray | None = None
        self.links = self.ns

    def add(self, reps: np.ndarray, ns: np.ndarray, x: np.ndarray) -> None:
        self.reps, self.ns = np.append(self.reps, reps), np.append(self.ns, ns)
        self.parts.append(x)

    def close(self, threshold: float) -> list[tuple[np.ndarray, np.ndarray]]:
        """Compares the vectors with each other; links found, as pairs of arrays."""
        self.x = np.concatenate(self.parts)
        self.links, self.parts, out = np.zeros(len(self.x), np.int64), [], []
        for a in range(0, len(self.x), BLOCK):
            for b in range(a, len(self.x), BLOCK):
                one, two = slice(a, a + BLOCK), slice(b, b + BLOCK)
                hit = self.x[one] @ self.x[two].T >= threshold
                if a == b:
                    np.fill_diagonal(hit, False)
                if hit.any():
                    self.links[one] += hit @ self.ns[two]
                    if a != b:
                        self.links[two] += self.ns[one] @ hit
                    more = _forest(hit)
                    out.append((self.reps[one][more[:, 0]], self.reps[two][more[:, 1]]))
        return out

    def meet(self, reps: np.ndarray, ns: np.ndarray, x: np.ndarray, threshold: float) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        """Compares the vectors with others: links of each of those, and links found."""
        own, out = np.zeros(len(reps), np.int64), []
        for a in range(0, len(self.x), BLOCK):
            one = slice(a, a + BLOCK)
            hit = self.x[one] @ x.T >= threshold
            if hit.any():
                self.links[one] += hit @ ns
                own += self.ns[one] @ hit
                more = _forest(hit)
                out.append((self.reps[one][more[:, 0]], reps[more[:, 1]]))
        return own, out


def _rows_of(links: list[tuple[np.ndarray, np.ndarray]], pairs: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """(rep, links, near): numbers of links, and links."""
    counted = [(r[n > 0], n[n > 0]) for r, n in links]
    rep = np.concatenate([np.zeros(0, np.int64), *[r for r, _ in counted], *[u for u, _ in pairs]])
    if len(rep):
        numbers = np.concatenate([np.zeros(0, np.int64), *[n for _, n in counted], *[0 * u for u, _ in pairs]])
        near = np.concatenate([np.zeros(0, np.int64), *[0 * r for r, _ in counted], *[v for _, v in pairs]])
        counts_only = np.arange(len(rep)) < sum(len(r) for r, _ in counted)
        yield pa.RecordBatch.from_arrays([pa.array(rep), pa.array(numbers), pa.array(near, mask=counts_only)], names=["rep", "links", "near"])


def _compare(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Rows come by unit (a group of a cell), the group's own vectors first."""
    now, group = None, _Group()
    for batch in batches:
        unit_of = batch.column(0).to_numpy()
        passing = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
        reps, ns = batch.column(2).to_numpy(), batch.column(3).to_numpy()
        edge = np.flatnonzero((unit_of[1:] != unit_of[:-1]) | (passing[1:] != passing[:-1])) + 1
        starts = [0, *edge.tolist(), len(batch)]
        for lo, hi in zip(starts, starts[1:]):
            if unit_of[lo] != now:
                if group.x is None and group.parts:
                    yield from _rows_of([], group.close(threshold))
                yield from _rows_of([(group.reps, group.links)], [])
                now, group = unit_of[lo], _Group()
            for at in range(lo, hi, BLOCK):
                stop = min(at + BLOCK, hi)
                lists = batch.column(4).slice(at, stop - at)
                x = unit(lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(stop - at, -1))
                if not passing[at]:
                    group.add(reps[at:stop], ns[at:stop], x)
                    continue
                if group.x is None:
                    if not group.parts:
                        break  # guests of a cell where nobody lives
                    yield from _rows_of([], group.close(threshold))
                own, pairs = group.meet(reps[at:stop], ns[at:stop], x, threshold)
                yield from _rows_of([(reps[at:stop], own)], pairs)
    if group.x is None and group.parts:
        yield from _rows_of([], group.close(threshold))
    yield from _rows_of([(group.reps, group.links)], [])


def _forest(hit: np.ndarray) -> np.ndarray:
    """Pairs (row, column) that join what ``hit`` joins, fewer than rows and columns together."""
    rows, out = np.flatnonzero(hit.any(1)), []
    seen_column = np.full(hit.shape[1], -1)
    for r in rows:
        columns = np.flatnonzero(hit[r])
        new = columns[seen_column[columns] < 0]
        out += [(r, c) for c in new]
        old = columns[seen_column[columns] >= 0]
        if len(old):  # one link for each earlier row that brought one of these columns
            _, pick = np.unique(seen_column[old], return_index=True)
            out += [(r, c) for c in old[pick]]
        seen_column[new] = r
    return np.array(out, int).reshape(-1, 2)


def near_vectors(
    vectors: DataFrame, threshold: float = 0.93, cell_rows: int = CELL_ROWS, id: str = "vec_id", vector: str = "embedding", label: str = "label",
    copies: float = COPIES, group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """(id, n_links, component_id, kept), a row for each row of ``vectors``."""
    rows = vectors.select(F.col(id).cast("long").alias("id"), F.col(label).alias("label"), F.col(vector).alias("vector"))
    takes_part = usable("vector") & F.exists("vector", lambda x: x != 0) & F.col("label").isNotNull() & F.col("id").isNotNull()
    rows = rows.withColumn("ok", takes_part)
    key = [F.xxhash64("vector").alias("h1"), F.xxhash64(F.lit(1), "vector").alias("h2"), F.size("vector").alias("dim")]
    classes = staged(
        rows.where("ok").select("id", "label", "vector", *key).groupBy("label", "dim", "h1", "h2")
        .agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n"), F.first("vector").alias("vector")),
        "classes",
    )
    sizes = classes.groupBy("dim").agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("c"), "dim").limit(1).collect()
    centroids = np.zeros((1, 1))
    sine = float(np.sqrt(max(0.0, 1 - threshold**2))) if threshold > 0 else 2.0
    if sizes:
        dim, count = sizes[0]
        sample = classes.where(F.col("dim") == dim).orderBy("h1", "h2", "label").limit(MAX_SAMPLE).select("vector").toPandas()["vector"]
        centroids = choose_centroids(unit(np.stack(sample).astype(np.float64)), count, sine, cell_rows, copies)
    narrow = ["label", "dim", "rep", "n", "vector"]
    assigned = staged(
        classes.select(*narrow).mapInArrow(lambda batches: _assign(batches, centroids, sine), classes.select(*narrow).schema.add("cells", T.ArrayType(T.IntegerType()))),
        "assigned",
    )
    # A cell of a label has as many groups as its residents ask for; a class's own group comes from its hash.
    crowds = assigned.groupBy("label", "dim", F.col("cells")[0].alias("cell")).agg(F.ceil(F.count(F.lit(1)) / group_rows).alias("groups"))
    placed = assigned.select(*narrow, F.posexplode("cells").alias("guest", "cell")).join(crowds, ["label", "dim", "cell"])
    own = F.pmod(F.xxhash64("rep", "n"), F.col("groups"))
    last = F.when(F.col("guest") > 0, F.col("groups") - 1).otherwise(own)
    sent = placed.withColumn("own", own).withColumn("group", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    sent = sent.select(
        F.xxhash64("label", "dim", "cell", "group").alias("unit"), ((F.col("guest") > 0) | (F.col("group") != F.col("own"))).alias("passing"), "rep", "n", "vector"
    )
    streamed = sent.repartition("unit").sortWithinPartitions("unit", "passing", "rep")
    found = staged(streamed.mapInArrow(lambda batches: _compare(batches, threshold), "rep long, links long, near long"), "found")
    discard(assigned)
    component = connected_components(found.where("near is not null").select(F.col("rep").alias("u"), F.col("near").alias("v")))
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    named = (
        classes.join(links, "rep", "left")
        .join(component.select(F.col("node").alias("rep"), "component"), "rep", "left")
        .select("label", "dim", "h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    )
    keyed = rows.select("id", F.when(F.col("ok"), F.col("label")).alias("label"), *key)
    return keyed.join(named, ["label", "dim", "h1", "h2"], "left").select(
        F.col("id").alias(id),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "id").alias("component_id"),
        F.coalesce(F.coalesce("component_id", "id") == F.col("id"), F.lit(True)).alias("kept"),
    )
