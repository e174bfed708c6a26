"""Connected components of an edge table with integer nodes.

Edges are first contracted where they are: each task replaces its edges by a forest with the same components. A forest of
at most SMALL edges then fits one task whatever the input; a larger one is joined by alternating large-star and
small-star rounds (Kiveris et al., 2014), each written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, tidied

#: Edges (16 bytes each) of a forest that one task may hold, and of which a task makes one forest at a time.
SMALL, HELD = 2_000_000, 500_000
#: Rounds double the reach of the smallest label.
ROUNDS = 60


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, for each the smallest node it is connected to)."""
    nodes, where = np.unique(np.r_[a, b], return_inverse=True)
    u, v = where[: len(a)], where[len(a) :]
    label = np.arange(len(nodes))
    while True:
        x, y = label[u], label[v]
        apart = x != y
        if not apart.any():
            return nodes, nodes[label]
        u, v, x, y = u[apart], v[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (deeper := label[label]).tobytes() != label.tobytes():
            label = deeper


@tidied
def _forest(batches: Iterator[pa.RecordBatch], whole: bool) -> Iterator[pa.RecordBatch]:
    """(u, v): each node under the smallest of its component, of every HELD edges or of all."""
    held, n = [], 0

    def close() -> Iterator[pa.RecordBatch]:
        if held:
            nodes, root = roots(*(np.concatenate([x[c] for x in held]) for c in (0, 1)))
            held.clear()
            below = np.ones(len(nodes), bool) if whole else nodes != root
            nodes, root = nodes[below], root[below]
            for i in range(0, len(nodes), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(nodes[i : i + 100_000]), pa.array(root[i : i + 100_000])], ["u", "v"])

    for batch in batches:
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        n += batch.num_rows
        if n > HELD and not whole:
            yield from close()
            n = 0
    yield from close()


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Edges (u, v) with u > v, each neighbour hung under the smallest one. The smallest is pre-aggregated, and the join back on it may split a hot node."""
    ways = edges.select("u", "v")
    if large:
        ways = ways.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = ways.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
    hung = ways.join(least, ways["u"] == least["k"])
    moved = hung.where(F.col("v") > F.col("u") if large else F.col("v") > F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.where("k > m").select(F.col("k").alias("u"), F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b", small: int = SMALL) -> DataFrame:
    """(node, component): for each node of an edge the smallest node reachable. Nulls and loops are ignored."""
    given = edges.where(F.col(a) != F.col(b)).select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v"))
    now = cut(given.mapInArrow(lambda it: _forest(it, False), "u long, v long"), "forest")
    if now.count() <= small:
        return cut(now.coalesce(1).mapInArrow(lambda it: _forest(it, True), "u long, v long"), "components").select(F.col("u").alias("node"), F.col("v").alias("component"))
    sign = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
    before = None
    for _ in range(ROUNDS):
        now = cut(_star(_star(now, True), False), "edges")
        after = sign(now)
        if after == before:
            break
        before = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def smallest(own: DataFrame) -> DataFrame:
    """Rows (id, label, ...) with component_id, the smallest id under the label; an id under several labels joins them, one without a label is its own."""
    whole = own.where("id IS NOT NULL AND label IS NOT NULL")
    again = whole.groupBy("id").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a != b")
    if again.isEmpty():
        least = whole.groupBy("label").agg(F.min("id").alias("component_id"))
        out = own.join(least, "label", "left")
    else:
        more = whole.join(again.select("id", "a"), "id").select("a", F.col("label").alias("b"))
        to = components(more).select(F.col("node").alias("label"), "component")
        whole = whole.join(to, "label", "left").withColumn("to", F.coalesce("component", "label"))
        least = whole.join(whole.groupBy("to").agg(F.min("id").alias("c")), "to").groupBy("id").agg(F.min("c").alias("component_id"))
        out = own.join(least, "id", "left")
    return out.withColumn("component_id", F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")))
