"""Exact search for the highest integer inner products, by best-first search of M-trees.

Vectors get one more coordinate that brings them all to the longest one's norm, and queries a zero there; then the
highest inner product is the smallest distance, and the triangle inequality holds. An index is

* cells: routing objects, at most CELLS vectors of a bounded sample; each vector goes to the nearest. A crowded cell is
  split into parts by rows.
* an M-tree for each part, built by one task and stored as pages: entries with their routing object or vector, covering
  radius, distance to the page's own routing object, and smallest id.

A query first searches the trees of its nearest cell, which gives it a least score, and then all trees whose bound
reaches it. In a tree the page of the highest bound comes first. Of its entries those go uncomputed that the stored
distance to the page's object, and the query's to it, rule out; a page goes unread if its bound, or at an equal bound its
smallest id, cannot enter the result. Queries of equal vectors are searched once.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, small_batches, tidied

K, SCALE = 10, 1024
#: Routing objects of an index at most, rows aimed at for a tree at least and at most, entries of a page, of an inner page.
CELLS, FEW, MANY, LEAF, FAN = 1024, 256, 8192, 512, 16
#: Queries that read one copy of a tree.
TOGETHER = 1024
#: Stands for a null id inside, as those come last among equal scores.
NO_ID = (1 << 63) - 1
#: Norms, squared, must stay below it, so that no score leaves a long; and below EXACT all sums are exact in doubles.
LIMIT, EXACT = 2.0**62, 2.0**50


@dataclass
class Index:
    """pages: of all trees. trees: (cell, part, radius). objects: the cells' routing objects. far: the longest vector's norm, squared."""

    pages: DataFrame
    trees: DataFrame
    objects: np.ndarray
    radii: np.ndarray
    far: float


def integers(vector: str, scale: int = SCALE) -> Column:
    """floor(scale * x) of a vector's components, null where the vector takes no part."""
    real = F.transform(F.col(f"`{vector}`"), lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    finite = F.forall(f"`{vector}`", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(2.0**40)))
    norm = F.aggregate(real, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return F.when(finite & (norm < LIMIT), real)


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of an array column, shorter ones continued by zeros."""
    lengths = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(lengths) and (lengths == width).all():
        return values.reshape(-1, width)
    out = np.zeros((len(lengths), width))
    out[np.arange(width) < lengths[:, None]] = values
    return out


def dot(x: np.ndarray, q: np.ndarray, exact: bool) -> np.ndarray:
    """Inner products of whole numbers held as doubles, as longs."""
    return (x @ q).astype(np.int64) if exact else x.astype(np.int64) @ q.astype(np.int64)


class Space:
    """The metric: vectors of whole numbers with the added coordinate."""

    def __init__(self, far: float):
        self.far = far
        self.exact = far < EXACT

    def distances(self, x: np.ndarray, to: np.ndarray) -> np.ndarray:
        """From each row of x to each row of `to`, or to one vector, all of the index."""
        own, its = ((v * v).sum(-1) for v in (x, to))
        own = own[:, None] if to.ndim > 1 else own
        added = np.sqrt(np.maximum(self.far - own, 0)) - np.sqrt(np.maximum(self.far - its, 0))
        return np.sqrt(np.maximum(own + its - 2 * (x @ to.T) + added * added, 0))

    def reach(self, scores: np.ndarray, own: float) -> np.ndarray:
        """From a query of squared norm `own` to vectors of these scores."""
        return np.sqrt(np.maximum(own + self.far - 2 * scores.astype(np.float64), 0))

    def bound(self, least: np.ndarray, own: float) -> np.ndarray:
        """The highest score that a vector at these distances or further can have with the query."""
        slack = (1e-9 if self.exact else 1e-6) * (own + self.far) + 1e-3
        return np.floor((own + self.far - np.maximum(least, 0) ** 2) / 2 + slack)


@tidied
def _deal(batches: Iterator[pa.RecordBatch], objects: np.ndarray, space: Space) -> Iterator[pa.RecordBatch]:
    """(row, id, x, cell): each vector with its nearest routing object."""
    for batch in batches:
        x = matrix(batch.column(2), objects.shape[1])
        near = np.argmin(space.distances(x, objects), 1)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near.astype(np.int32))], [*batch.schema.names, "cell"])


PAGE = ["page", "child", "low", "row", "radius", "apart", "x"]
PAGE_SCHEMA = "page int, child array<int>, low array<long>, row array<long>, radius array<double>, apart array<double>, x binary"


def tree(x: np.ndarray, ids: np.ndarray, rows: np.ndarray, top: np.ndarray, space: Space, leaf: int = LEAF, fan: int = FAN) -> list[tuple]:
    """Pages (page, child, low, row, radius, apart, x) of an M-tree under the routing object `top`, the root first. A leaf's children are -1, its low are ids."""
    pages: list[tuple] = []
    draw = np.random.default_rng(1)
    todo = [(np.arange(len(x)), top, 0)]
    free = 1
    while todo:
        of, center, page = todo.pop()
        if len(of) <= leaf:
            of = of[np.argsort(ids[of], kind="stable")]
            pages.append((page, [-1] * len(of), ids[of], rows[of], np.zeros(len(of)), space.distances(x[of], center), x[of]))
            continue
        ways = min(fan, -(-2 * len(of) // leaf))  # children about half full: many small pages take more time than they spare
        seeds = of[draw.choice(len(of), ways, replace=False)]
        near = np.argmin(space.distances(x[of], x[seeds]), 1)
        groups = [of[near == i] for i in range(ways)]
        if max(map(len, groups)) > 0.9 * len(of):  # equal or almost: cut in order of distance, then id
            turn = of[np.lexsort((ids[of], space.distances(x[of], x[seeds[0]])))]
            groups = np.array_split(turn, ways)
            seeds = np.array([g[len(g) // 2] for g in groups])
        entries = []
        for s, group in zip(seeds, groups, strict=True):
            if len(group):
                todo.append((group, x[s], free))
                entries.append((free, ids[group].min(), rows[s], space.distances(x[group], x[s]).max(), s))
                free += 1
        child, low, row, radius, at = zip(*entries, strict=True)
        pages.append((page, child, np.array(low), np.array(row), np.array(radius), space.distances(x[list(at)], center), x[list(at)]))
    return pages


@tidied
def _build(batches: Iterator[pa.RecordBatch], objects: np.ndarray, space: Space) -> Iterator[pa.RecordBatch]:
    """Pages of a tree for each (cell, part) of rows (cell, part, row, id, x) sorted by both."""
    now, held = None, []

    def close() -> Iterator[pa.RecordBatch]:
        x, ids, rows = (np.concatenate(c) for c in zip(*held, strict=True))
        made = list(zip(*tree(x, ids, rows, objects[now[0]], space), strict=True))
        made[-1] = [v.astype("<i4").tobytes() for v in made[-1]]
        kinds = (pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.binary())
        n = len(made[0])
        for i in range(0, n, 64):
            part = [pa.array(c[i : i + 64], t) for c, t in zip(made, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*(pa.array([v] * len(part[0]), pa.int32()) for v in now), *part], ["cell", "part", *PAGE])
        held.clear()

    for batch in batches:
        keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
        for i, j in zip(cuts, cuts[1:], strict=False):
            if i == j:
                continue
            if held and keys[i] != now:
                yield from close()
            now, part = keys[i], batch.slice(i, j - i)
            held.append((matrix(part.column(4), objects.shape[1]), part.column(3).to_numpy(), part.column(2).to_numpy()))
    if held:
        yield from close()


def index(vectors: DataFrame, cells: int = CELLS, few: int = FEW, many: int = MANY) -> Index | None:
    """The index of a table (row, id, x) of whole numbers; None without a row.

    Routing objects are a sample of the rows, one for `many` rows, or for `few` if there are else fewer than twice the
    session's shuffle partitions, `cells` at most. Every row is in one tree.
    """
    spark = vectors.sparkSession
    norm = F.aggregate("x", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))
    n, width, far = vectors.agg(F.count("*"), F.max(F.size("x")), F.max(norm)).first()
    if not n:
        return None
    parallel = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    wanted = max(1, min(cells, max(n // many, min(n // few, parallel))))
    sample = vectors.select("x", "row").orderBy(F.xxhash64("row"), "row").limit(wanted).select("x").collect()  # `cells` rows at most
    objects = np.zeros((len(sample), width))
    for i, (x,) in enumerate(sample):
        objects[i, : len(x)] = x
    space = Space(far)
    dealt = cut(vectors.select("row", "id", "x").mapInArrow(lambda it: _deal(it, objects, space), "row long, id long, x array<long>, cell int"), "dealt")
    most = max(few, 2 * n // wanted)
    parts = F.ceil(F.count("*") / F.lit(most)).cast("int").alias("parts")
    split = dealt.join(F.broadcast(dealt.groupBy("cell").agg(parts)), "cell")  # a row a cell
    split = split.select("cell", F.pmod(F.xxhash64("row"), F.col("parts")).cast("int").alias("part"), "row", "id", "x")
    built = split.repartition("cell", "part").sortWithinPartitions("cell", "part").mapInArrow(lambda it: _build(it, objects, space), f"cell int, part int, {PAGE_SCHEMA}")
    pages = cut(built, "pages")
    # A root's entries lie within their distance to the cell's object and their own radius.
    reach = F.array_max(F.zip_with("apart", "radius", lambda a, r: a + r))
    trees = cut(pages.where("page = 0").select("cell", "part", reach.alias("radius")), "trees")
    radii = np.zeros(len(objects))
    for cell, radius in trees.groupBy("cell").agg(F.max("radius")).collect():  # a row a cell
        radii[cell] = radius
    return Index(pages, trees, objects, radii, far)


@tidied
def _route(batches: Iterator[pa.RecordBatch], objects: np.ndarray, radii: np.ndarray, far: float, first: bool) -> Iterator[pa.RecordBatch]:
    """For queries (cls, x, least): (cls, x, least, cell, apart), the nearest cell, or of the others those whose bound reaches `least` (null: all)."""
    space = Space(far)
    for batch in batches:
        x = matrix(batch.column(1), objects.shape[1])
        least = batch.column(2).to_pylist()
        at, cells, apart = [], [], []
        for i, q in enumerate(x):
            own = float(q @ q)
            distance = space.reach(dot(objects, q, space.exact), own)
            near = int(np.argmin(distance))
            if first:
                chosen = np.array([near])
            else:
                reached = np.ones(len(distance), bool) if least[i] is None else space.bound(distance - radii, own) >= least[i]
                reached[near] = False
                chosen = np.flatnonzero(reached)
            at += [i] * len(chosen)
            cells += chosen.tolist()
            apart += distance[chosen].tolist()
            if len(at) > 10_000 or i == len(x) - 1:
                yield pa.RecordBatch.from_arrays([*(c.take(pa.array(at, pa.int64())) for c in batch.columns), pa.array(cells, pa.int32()), pa.array(apart, pa.float64())], ["cls", "x", "least", "cell", "apart"])
                at, cells, apart = [], [], []


class Best:
    """The k highest scores so far, ties by the smaller id, then row."""

    def __init__(self, k: int, least: int | None):
        self.k, self.least = k, -math.inf if least is None else least
        self.scores = self.ids = self.rows = np.zeros(0, np.int64)

    def may(self, bounds: np.ndarray, low: np.ndarray) -> np.ndarray:
        """Which of these bounds, with these smallest ids, may still enter."""
        if len(self.scores) < self.k:
            return bounds >= self.least
        last, id_ = self.scores[-1], self.ids[-1]
        return (bounds >= self.least) & ((bounds > last) | (bounds == last) & (low <= id_))

    def put(self, scores: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        own = self.may(scores, ids)
        if own.any():
            merged = [np.r_[a, b[own]] for a, b in ((self.scores, scores), (self.ids, ids), (self.rows, rows))]
            turn = np.lexsort((merged[2], merged[1], -merged[0]))[: self.k]
            self.scores, self.ids, self.rows = (m[turn] for m in merged)


def search_tree(pages: dict[int, tuple], q: np.ndarray, apart: float, best: Best, space: Space) -> tuple[int, int]:
    """Puts a tree's vectors into `best`, pages of the highest bound first; returns how many distances were computed and how many entries the stored ones ruled out."""
    own, computed, spared = float(q @ q), 0, 0
    heap = [(-math.inf, -NO_ID, 0, apart)]
    while heap:
        bound, low, page, distance = heapq.heappop(heap)
        if not best.may(np.array([-bound]), np.array([low]))[0]:
            if -bound < (best.scores[-1] if len(best.scores) == best.k else best.least):
                break  # all others are no higher
            continue
        child, lows, rows, radius, far, x = pages[page]
        left = np.flatnonzero(best.may(space.bound(np.abs(distance - far) - radius, own), lows))
        computed, spared = computed + len(left), spared + len(lows) - len(left)
        scores = dot(x[left], q, space.exact)
        if child[0] < 0:
            best.put(scores, lows[left], rows[left])
            continue
        reach = space.reach(scores, own)
        bounds = space.bound(reach - radius[left], own)
        for i in np.flatnonzero(best.may(bounds, lows[left])):
            heapq.heappush(heap, (-bounds[i], int(lows[left[i]]), int(child[left[i]]), float(reach[i])))
    return computed, spared


@tidied
def _search(batches: Iterator[pa.RecordBatch], width: int, k: int, far: float) -> Iterator[pa.RecordBatch]:
    """(cls, score, id, row) of the best of each query in each tree, for rows sorted by tree and kind: its pages (kind 0), then its queries (kind 1)."""
    space, now, pages = Space(far), None, {}
    for batch in batches:
        c = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
        keys = list(zip(*(c[n].to_pylist() for n in ("cell", "part", "block", "kind", "page")), strict=True))
        x = {i: None for i in range(batch.num_rows)}
        asked = [i for i, key in enumerate(keys) if key[3] == 1]
        if asked:
            for i, q in zip(asked, matrix(c["q"].take(pa.array(asked)), width), strict=True):
                x[i] = q
        out: list[list] = [[], [], [], []]
        for i, key in enumerate(keys):
            if key[:3] != now:
                now = key[:3]
                pages.clear()
            if key[3] == 0:
                entries = [c[n][i].values.to_numpy() for n in ("child", "low", "row", "radius", "apart")]
                pages[key[4]] = (*entries, np.frombuffer(c["x"][i].as_buffer(), "<i4").reshape(-1, width).astype(np.float64))
            else:
                best = Best(k, c["least"][i].as_py())
                search_tree(pages, x[i], c["distance"][i].as_py(), best, space)
                for o, v in zip(out, (np.full(len(best.ids), c["cls"][i].as_py()), best.scores, best.ids, best.rows), strict=True):
                    o.append(v)
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(o).astype(np.int64)) for o in out], ["cls", "score", "id", "row"])


def _asked(found: Index, routed: DataFrame, k: int) -> DataFrame:
    """(cls, score, id, row): the best k of each routed query in each of its trees."""
    space = Space(found.far)
    own = F.aggregate("x", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))
    gap = F.greatest(F.col("apart") - F.col("radius"), F.lit(0.0))
    slack = (1e-9 if space.exact else 1e-6) * (own + found.far) + 1e-3
    bound = F.floor((own + found.far - gap * gap) / 2 + slack)
    asks = routed.join(found.trees, "cell").where(F.col("least").isNull() | (bound >= F.col("least"))).select("cell", "part", "cls", F.col("x").alias("q"), "least", F.col("apart").alias("distance"))
    asks = cut(asks, "asks")
    blocks = asks.groupBy("cell", "part").agg(F.ceil(F.count("*") / F.lit(TOGETHER)).cast("int").alias("blocks"))
    asks = asks.join(blocks, ["cell", "part"]).withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int")).drop("blocks").withColumn("kind", F.lit(1))
    copies = found.pages.join(blocks, ["cell", "part"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks").withColumn("kind", F.lit(0))
    place = ["cell", "part", "block"]
    met = copies.unionByName(asks, allowMissingColumns=True).repartition(*place).sortWithinPartitions(*place, "kind")
    width, far = found.objects.shape[1], found.far
    return met.mapInArrow(lambda it: _search(it, width, k, far), "cls long, score long, id long, row long")


def top(found: Index, queries: DataFrame, k: int) -> DataFrame:
    """(cls, best): for each query (cls, x) the k entries (score, id, row) of the highest scores, ties by the smaller id, then row."""
    order = Window.partitionBy("cls").orderBy(F.col("score").desc(), "id", "row")

    def best(rows: DataFrame) -> DataFrame:
        return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)

    asks, fixed = queries.withColumn("least", F.lit(None).cast("long")), (found.objects, found.radii, found.far)
    schema = "cls long, x array<long>, least long, cell int, apart double"
    near = cut(best(_asked(found, asks.mapInArrow(lambda it: _route(it, *fixed, True), schema), k)), "near")
    least = near.where(F.col("place") == k).select("cls", F.col("score").alias("least"))
    rest = queries.join(least, "cls", "left").select("cls", "x", "least").mapInArrow(lambda it: _route(it, *fixed, False), schema)
    every = near.drop("place").unionByName(_asked(found, rest, k))
    return best(every).groupBy("cls").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("under"), "id", "row"))).alias("best"))  # k entries


def search(df: DataFrame, asks: Column, key: str = "vec_id", vector: str = "embedding", k: int = K, scale: int = SCALE, **sizes: int) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of df for which `asks` holds, the k other rows of the highest scores.

    A score is the inner product of floor(scale * component), components as doubles; ties go to the smaller key, a null
    key (for which the largest long stands inside) last. Vectors that are null, hold a null or a number that is not
    finite, or are so long that scores could leave a long (2**31 and over), take no part; shorter vectors are continued
    by zeros. Rows of equal keys are rows like others, so a query may find its own key again. Rows with fewer than k
    others get all of them; an empty df gives no rows. Columns other than key and vector are not read, but for `asks`.
    """
    small_batches(df.sparkSession)
    rows = df.select(F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(NO_ID)).alias("id"), integers(vector, scale).alias("x"), F.coalesce(asks, F.lit(False)).alias("asks"))
    rows = cut(rows.where("x IS NOT NULL").withColumn("row", F.monotonically_increasing_id()), "vectors")
    found = index(rows, **sizes)
    schema = "query_id long, rank int, vec_id long, score long"
    if found is None:
        return df.sparkSession.createDataFrame([], schema)
    # A key names a vector; one of k + 1 entries may be the query itself.
    queries = rows.where("asks").select("id", "row", "x")
    distinct = cut(queries.groupBy("x").agg(F.min("row").alias("cls")), "queries")
    answers = cut(top(found, distinct.select("cls", "x"), k + 1), "answers").join(distinct, "cls").select("x", "best")
    own = queries.join(answers, "x").select("id", F.slice(F.filter("best", lambda e: e["row"] != F.col("row")), 1, k).alias("best"))
    back = lambda c: F.when(c != NO_ID, c)
    return own.select(back(F.col("id")).alias("query_id"), F.posexplode("best").alias("at", "e")).select("query_id", (F.col("at") + 1).alias("rank"), back(F.col("e.id")).alias("vec_id"), (-F.col("e.under")).alias("score"))


def query(spark, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0)


SQL = f"""
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id, list_inner_product(q.x, c.x)::BIGINT AS score FROM v AS q JOIN v AS c ON q.r != c.r WHERE q.vec_id % 100 = 0
)
SELECT query_id, (row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score FROM s QUALIFY rank <= {K}
"""
