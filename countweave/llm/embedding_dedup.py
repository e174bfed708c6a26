"""Near-duplicate embeddings by counting collisions on one-dimensional projections.

Vectors of one label (and length) are projected on random directions, on which two unit vectors d apart differ by a
normal number of deviation d. On the leading directions a vector lies in a cell, and as a query goes to every cell
that its window there reaches; cells hold about CELL vectors. In a cell the vectors are sorted on each of the other
directions, and a query collides with those in the window centred on it. Pairs with as many collisions as all but a
MISSED share of the pairs at the threshold have are compared exactly.

Equal vectors are one class throughout. Links are counted by task and summed; of the linked pairs only a forest leaves.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, tidied
from .components import components, roots, smallest

THRESHOLD = 0.98
SEED, DIRECTIONS = 23, 16
#: Half widths of the windows, in deviations of a pair at the threshold: on the leading directions and on the others.
LEAD, WINDOW = 4.0, 2.2
#: Share of the pairs at the threshold that may have too few collisions.
MISSED = 1e-4
#: Vectors of a label to a cell that are aimed at, and those that a task holds.
CELL, HELD = 4000, 8192
#: Salts of the classes' 64-bit keys; the first is taken under which 128 bits tell no two vectors of one key.
SALTS = 8
#: Most leading directions; a query goes to 2 ** LEADING cells at most.
LEADING = 6


def needed(directions: int = DIRECTIONS, window: float = WINDOW, missed: float = MISSED) -> int:
    """The most collisions that all but a share `missed` of the pairs at the threshold have."""
    p = math.erf(window / math.sqrt(2))
    below = 0.0
    for k in range(directions + 1):
        below += math.comb(directions, k) * p**k * (1 - p) ** (directions - k)
        if below > missed:
            return k
    return directions


def directions(width: int, leading: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(SEED)
    return r.standard_normal((width, leading)), r.standard_normal((width, DIRECTIONS))


def _unit(column: pa.Array) -> np.ndarray:
    """Unit rows of an array column whose rows have one length."""
    x = np.asarray(column.flatten(), np.float64).reshape(len(column), -1)
    x = x / np.abs(x).max(1, keepdims=True)  # else the squares of very large numbers overflow
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@tidied
def _deal(batches: Iterator[pa.RecordBatch], leading: int, apart: float) -> Iterator[pa.RecordBatch]:
    """(label, cls, size, vector) -> rows with cell and role: 0 in its own cell, 1 in each cell that its window reaches."""
    for batch in batches:
        column = batch.column(3)
        width = np.asarray(pc.list_value_length(column))
        for w in np.unique(width):
            part = batch.filter(pa.array(width == w))
            place = _unit(part.column(3)) @ directions(int(w), leading)[0] if leading else np.zeros((part.num_rows, 0))
            side, reach = 2 * LEAD * apart, LEAD * apart
            home = np.floor(place / side).astype(np.int64)
            low, high = np.floor((place - reach) / side).astype(np.int64), np.floor((place + reach) / side).astype(np.int64)
            rows, cells, roles = [np.arange(part.num_rows)], [home], [np.zeros(part.num_rows, np.int32)]
            for choice in range(1 << leading):
                side_of = np.array([choice >> k & 1 for k in range(leading)], bool)
                once = ~((low == high) & side_of).any(1)  # a window within one cell has no upper one
                rows.append(np.flatnonzero(once))
                cells.append(np.where(side_of, high, low)[once])
                roles.append(np.ones(int(once.sum()), np.int32))
            taken = pa.Table.from_batches([part]).take(pa.array(np.concatenate(rows))).combine_chunks().to_batches()
            names = pa.array([",".join(map(str, c)) for c in np.concatenate(cells).tolist()], pa.string())
            role = pa.array(np.concatenate(roles))
            at = 0
            for t in taken:
                n = t.num_rows
                yield pa.RecordBatch.from_arrays([*t.columns, pa.array([int(w)] * n, pa.int64()), names.slice(at, n), role.slice(at, n)], [*t.schema.names, "width", "cell", "role"])
                at += n


@tidied
def _count(batches: Iterator[pa.RecordBatch], threshold: float, leading: int, apart: float) -> Iterator[pa.RecordBatch]:
    """(cls, n, a, b): direct links of a class found here, or an edge of a forest. Rows come sorted by group, members first."""
    group, held, at_least = None, [], needed()

    def ask(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        cls = np.concatenate([h[0] for h in held])
        size, x, p = (np.concatenate([h[c] for h in held]) for c in (1, 2, 3))
        order = np.argsort(p, axis=0, kind="stable")
        ranked = np.take_along_axis(p, order, 0)
        mine, _, y, q = _vectors(part, leading)
        reach = WINDOW * apart
        links, a, b = np.zeros(len(mine), np.int64), [], []
        for i in range(0, len(mine), 256):
            block = q[i : i + 256]
            hits = np.zeros((len(block), len(cls)), np.uint8)
            for j in range(p.shape[1]):
                low, high = np.searchsorted(ranked[:, j], block[:, j] - reach, "left"), np.searchsorted(ranked[:, j], block[:, j] + reach, "right")
                along = order[:, j]
                for r in range(len(block)):
                    hits[r, along[low[r] : high[r]]] += 1
            r, m = np.nonzero(hits >= at_least)
            near = np.einsum("ij,ij->i", y[i + r], x[m]) >= threshold if len(r) else np.zeros(0, bool)
            r, m = r[near], m[near]
            other = mine[i + r] != cls[m]
            r, m = r[other], m[other]
            np.add.at(links, i + r, size[m])
            if len(r):
                nodes, root = roots(mine[i + r], cls[m])
                a.append(nodes[nodes != root])
                b.append(root[nodes != root])
        some = links > 0
        none = pa.nulls(int(some.sum()), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(mine[some]), pa.array(links[some]), none, none], COUNTED)
        if a:
            edges = [pa.array(np.concatenate(e)) for e in (a, b)]
            none = pa.nulls(len(edges[0]), pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, *edges], COUNTED)

    for batch in batches:
        keys = list(zip(*(batch.column(c).to_pylist() for c in range(5)), strict=True))
        cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
        for i, j in zip(cuts, cuts[1:], strict=False):
            if i == j:
                continue
            if keys[i][:4] != group:
                group, held = keys[i][:4], []
            part = batch.slice(i, j - i)
            if keys[i][4] == 0:
                held.append(_vectors(part, leading))
            elif held:
                yield from ask(part)


COUNTED = ["cls", "n", "a", "b"]


def _vectors(part: pa.RecordBatch, leading: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    x = _unit(part.column(7))
    return part.column(5).to_numpy(), part.column(6).to_numpy(), x, x @ directions(x.shape[1], leading)[1]


def link(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = THRESHOLD, cell: int = CELL) -> DataFrame:
    """(key, n_links, component_id, kept) for each row of df.

    n_links: other rows found with the same label (not null), a vector of the same length and a cosine of threshold or
    more, in double precision. component_id: the smallest key reachable by links. A vector that is null, empty or zero,
    or holds a null or a number that is not finite, links with nothing, as does a row without a label. Rows of one key
    are several vectors that share reachability; a null key has a null component and is not kept. No pair below the
    threshold is linked; a pair at the threshold is missed with a chance of MISSED and of what LEAD deviations leave
    out on the leading directions, a closer one with less. An empty table gives no rows.
    """
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), F.col(label).cast("string").alias("l"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    fit = F.coalesce(F.col("l").isNotNull() & (F.size("v") > 0) & finite & F.exists("v", lambda x: x != 0), F.lit(False))
    for salt in range(SALTS):
        keyed = cut(rows.withColumn("cls", F.when(fit, F.xxhash64(F.lit(salt), "l", "v"))).withColumn("check", F.xxhash64(F.lit(salt + SALTS), "v", "l")), "vectors")
        again = F.min("check") != F.max("check")
        classes = cut(keyed.where("cls IS NOT NULL").groupBy("cls").agg(F.first("l").alias("l"), F.first("v").alias("v"), F.count("*").alias("size"), again.alias("mixed")), "classes")
        if classes.where("mixed").isEmpty():  # no two vectors share a class
            break
    else:
        raise ValueError(f"two different vectors share a key under each of {SALTS} salts")
    rows = keyed
    most = classes.groupBy("l").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    leading = min(LEADING, math.ceil(math.log(most / cell, 2.5))) if most > cell else 0
    apart = math.sqrt(2 * (1 - threshold))
    dealt = cut(classes.select("l", "cls", "size", "v").mapInArrow(lambda it: _deal(it, leading, apart), "l string, cls long, size long, v array<double>, width long, cell string, role int"), "dealt")
    spot = ["l", "width", "cell"]
    parts = dealt.where("role = 0").groupBy(*spot).agg(F.ceil(F.count("*") / F.lit(HELD)).cast("int").alias("parts"))
    split = dealt.join(parts, spot)  # a query into a cell without a vector ends here
    own = F.array(F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int"))
    split = split.withColumn("part", F.explode(F.when(F.col("role") == 0, own).otherwise(F.sequence(F.lit(0), F.col("parts") - 1))))
    group = [*spot, "part"]
    found = cut(
        split.select(*group, "role", "cls", "size", "v").repartition(*group).sortWithinPartitions(*group, "role").mapInArrow(lambda it: _count(it, threshold, leading, apart), "cls long, n long, a long, b long"),
        "links",
    )
    counts = found.where("cls IS NOT NULL").groupBy("cls").agg(F.sum("n").alias("others"))
    labels = components(found.where("cls IS NULL")).select(F.col("node").alias("cls"), F.col("component").alias("label"))
    per_class = classes.select("cls", "size").join(counts, "cls", "left").join(labels, "cls", "left")
    per_class = per_class.select("cls", (F.coalesce("others", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("label", "cls").alias("label"))
    out = smallest(rows.select("id", "cls").join(per_class, "cls", "left"))
    kept = F.coalesce(F.col("id") == F.col("component_id"), F.lit(False))
    return out.select(F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "component_id", kept.alias("kept"))


def query(spark, sf_dir: str) -> DataFrame:
    return link(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
