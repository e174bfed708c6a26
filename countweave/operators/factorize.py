"""Integrative non-negative matrix factorization: X_d ~ H_d (W + V_d), with lambda * |H_d V_d|^2, all parts non-negative.

Cells stay in Spark as rows (dataset, cell, genes, values). An iteration is one pass over them: every task solves its
cells' H against the loadings, which are sent along (genes x k numbers, MOST at most), and adds up H'H and X'H; those
sums, of the size of the loadings, are grouped by dataset and gene and give V and W.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import session
from .matrix import normalized

#: Numbers of the loadings of all datasets; more are refused.
MOST = 20_000_000
ROWS = "dataset string, cell string, genes array<int>, values array<double>"
#: Cells that are dense at a time, pieces in which tasks' sums are added, columns whose equations are solved together.
CHUNK, WAYS, TOGETHER = 500, 8, 2000
#: Cells that a task takes through steps of an online factorization, one batch after the other; larger batches are dealt to many tasks.
STRETCH = 5000


def _on(gram: np.ndarray, right: np.ndarray, passive: np.ndarray, even: bool) -> np.ndarray:
    """x of gram x = right, of each column on its passive variables, 0 on others. even: by one stack of equations, in which the others stand for themselves; else by set and of least squares where that is needed."""
    if even:
        p = passive.T
        full = np.where(p[:, :, None] & p[:, None, :], gram, np.eye(len(gram)))
        return np.linalg.solve(full, np.where(p, right.T, 0)[:, :, None])[:, :, 0].T
    x = np.zeros_like(right)
    sets, where = np.unique(passive, axis=1, return_inverse=True)
    for s in range(sets.shape[1]):
        columns, p = np.flatnonzero(where.ravel() == s), sets[:, s]
        if p.any():
            inside = gram[np.ix_(p, p)]
            x[np.ix_(p, columns)] = np.linalg.lstsq(inside, right[np.ix_(p, columns)], rcond=None)[0] if np.linalg.cond(inside) > 1e13 else np.linalg.solve(inside, right[np.ix_(p, columns)])
    return x


def solve(gram: np.ndarray, right: np.ndarray) -> np.ndarray:
    """x >= 0 of least |A x - b| for each column of `right` = A'b, with gram = A'A, by block principal pivoting (Kim and Park, 2011).

    Variables of infeasible sign change sides all at once while that helps, and one at a time after three failures.
    Each column's equations are those of its passive set.
    """
    k, n = right.shape
    even = bool(np.linalg.cond(gram) <= 1e13)  # those of some of the variables are no worse
    passive = np.zeros((k, n), bool)
    x, y = np.zeros((k, n)), -right
    tries, fewest = np.full(n, 3), np.full(n, k + 1)
    tiny = 1e-12 * max(1.0, float(np.abs(right).max(initial=0)))
    for _ in range(50 * k):
        wrong = np.where(passive, x < -tiny, y < -tiny)
        count = wrong.sum(0)
        open_ = np.flatnonzero(count)
        if not len(open_):
            break
        better = count[open_] < fewest[open_]
        again = ~better & (tries[open_] > 0)
        fewest[open_[better]], tries[open_[better]] = count[open_[better]], 3
        tries[open_[again]] -= 1
        change = open_[better | again]
        passive[:, change] ^= wrong[:, change]
        for c in open_[~better & ~again]:
            last = np.flatnonzero(wrong[:, c])[-1]
            passive[last, c] ^= True
        for i in range(0, len(open_), TOGETHER):
            columns = open_[i : i + TOGETHER]
            x[:, columns] = _on(gram, right[:, columns], passive[:, columns], even)
        y[:, open_] = np.where(passive[:, open_], 0, gram @ x[:, open_] - right[:, open_])
    else:
        raise ValueError("the pivoting did not end")
    return np.maximum(x, 0)


def rows_of(scaled: DataFrame, genes: list[str]) -> DataFrame:
    """A row (dataset, cell, genes, values) for each cell of long values, with genes by place."""
    spark = scaled.sparkSession
    places = spark.createDataFrame([(g, i) for i, g in enumerate(genes)], "gene string, place int")
    long = scaled.join(F.broadcast(places), "gene").groupBy("dataset", "cell").agg(F.sort_array(F.collect_list(F.struct("place", "value"))).alias("p"))  # of one cell
    return session.cut(long.select("dataset", "cell", F.col("p.place").alias("genes"), F.col("p.value").alias("values")))


@dataclass
class Factors:
    """Loadings by gene (in the order of `genes`), and of each dataset the running sums of online factorization with the number of steps in them."""

    genes: list[str]
    w: np.ndarray
    v: dict[str, np.ndarray]
    penalty: float
    objective: list[float] = field(default_factory=list)
    gram: dict[str, np.ndarray] = field(default_factory=dict)
    cross: dict[str, np.ndarray] = field(default_factory=dict)
    steps: dict[str, int] = field(default_factory=dict)

    def copy(self) -> Factors:
        """The same loadings and sums, in arrays of their own, without what was measured."""
        own = lambda x: {d: a.copy() for d, a in x.items()}
        return Factors(list(self.genes), self.w.copy(), own(self.v), self.penalty, [], own(self.gram), own(self.cross), dict(self.steps))


def _dense(pdf: pd.DataFrame, n: int) -> np.ndarray:
    x = np.zeros((len(pdf), n))
    for i, (g, v) in enumerate(zip(pdf["genes"], pdf["values"], strict=True)):
        x[i, g] = v
    return x


def _cells(x: np.ndarray, w: np.ndarray, v: np.ndarray, penalty: float) -> np.ndarray:
    """H of the rows of x."""
    a = w + v
    return solve(a.T @ a + penalty * v.T @ v, a.T @ x.T).T


def _sums(batches: Iterator[pd.DataFrame], w: np.ndarray, v: dict[str, np.ndarray], penalty: float) -> Iterator[pd.DataFrame]:
    """(dataset, piece, sums) of a task's cells: |X|^2, their number, H'H and X'H, one after the other as doubles."""
    total: dict[str, np.ndarray] = {}
    for pdf in batches:
        for d, s in _own(pdf, w, v, penalty).items():
            total[d] = total.get(d, 0) + s
    yield _pieces(total)


def _own(pdf: pd.DataFrame, w: np.ndarray, v: dict[str, np.ndarray], penalty: float) -> dict[str, np.ndarray]:
    """Such sums of each dataset's cells."""
    total: dict[str, np.ndarray] = {}
    for d, part in pdf.groupby("dataset"):
        for i in range(0, len(part), CHUNK):
            x = _dense(part.iloc[i : i + CHUNK], len(w))
            h = _cells(x, w, v[d], penalty)
            total[d] = total.get(d, 0) + np.concatenate([[(x * x).sum(), len(x)], (h.T @ h).ravel(), (x.T @ h).ravel()])
    return total


PIECES = "dataset string, piece int, sums binary"


def _pieces(total: dict[str, np.ndarray]) -> pd.DataFrame:
    rows = [(d, i, part.tobytes()) for d, s in total.items() for i, part in enumerate(np.array_split(s, WAYS))]
    return pd.DataFrame(rows, columns=["dataset", "piece", "sums"])


def _added(pdf: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"dataset": pdf["dataset"].iloc[:1], "piece": pdf["piece"].iloc[:1], "sums": [sum(map(np.frombuffer, pdf["sums"])).tobytes()]})


def _together(parts: DataFrame) -> dict[str, np.ndarray]:
    """Each dataset's sums over all tasks. They are added by pieces, so that the driver gets every number once."""
    found = parts.groupBy("dataset", "piece").applyInPandas(_added, PIECES).collect()
    of = {(d, i): np.frombuffer(s) for d, i, s in found}
    return {d: np.concatenate([of[d, i] for i in range(WAYS)]) for d in sorted({d for d, _ in of})}


def _split(s: np.ndarray, k: int) -> tuple[float, float, np.ndarray, np.ndarray]:
    """(|X|^2, cells, H'H, X'H) of such sums."""
    return s[0], s[1], s[2 : 2 + k * k].reshape(k, k), s[2 + k * k :].reshape(-1, k)


def _pass(rows: DataFrame, f: Factors) -> tuple[dict, dict, dict, dict]:
    """(X'H, H'H, |X|^2, cells) of each dataset for the best H at these loadings."""
    w, v, penalty, k = f.w, f.v, f.penalty, f.w.shape[1]
    cross, gram, squares, cells = {}, {}, {}, {}
    for d, s in _together(rows.mapInPandas(lambda it: _sums(it, w, v, penalty), PIECES)).items():
        squares[d], cells[d], gram[d], cross[d] = _split(s, k)
    return cross, gram, squares, cells


def objective(f: Factors, cross: dict, gram: dict, squares: dict) -> float:
    out = 0.0
    for d in cross:
        a = f.w + f.v[d]
        out += squares[d] - 2 * float((cross[d] * a).sum()) + float(((a @ gram[d]) * a).sum()) + f.penalty * float(((f.v[d] @ gram[d]) * f.v[d]).sum())
    return out


def _start(rows: DataFrame, genes: list[str], k: int, penalty: float, seed: int) -> Factors:
    names = sorted(r[0] for r in rows.select("dataset").distinct().collect())
    if len(genes) * k * (len(names) + 1) > MOST:
        raise ValueError("the loadings are too large to send to every task")
    sizes = {r["dataset"]: r["count"] for r in rows.groupBy("dataset").count().collect()}
    if k >= min(sizes.values(), default=0) or k >= len(genes):
        raise ValueError("k has to be smaller than the cells of each dataset and the genes")
    r = np.random.default_rng(seed)
    unit = lambda x: x / np.maximum(np.sqrt((x * x).sum(0)), 1e-15)
    v = {}
    for d in names:  # k cells of each dataset, those of the smallest hashes
        some = rows.where(F.col("dataset") == d).orderBy(F.xxhash64("cell", F.lit(seed)), "cell").limit(k).toPandas()
        v[d] = unit(_dense(some, len(genes)).T)
    return Factors(genes, unit(r.uniform(0, 2, (len(genes), k))), v, penalty)


def begin(rows: DataFrame, genes: list[str], k: int, penalty: float, seed: int, start: Factors | None) -> Factors:
    """Where a run begins: at start's W and V, in copies, and at drawn V for datasets that it has none for; without start, all drawn."""
    if start is None:
        return _start(rows, genes, k, penalty, seed)
    if list(start.genes) != list(genes) or start.w.shape != (len(genes), k):
        raise ValueError("start has to hold loadings of these genes and of k factors")
    f = start.copy()
    f.penalty = penalty
    names = {r[0] for r in rows.select("dataset").distinct().collect()}
    if new := names - f.v.keys():
        f.v |= _start(rows.where(F.col("dataset").isin(*new)), genes, k, penalty, seed).v
    return f


def factorize(rows: DataFrame, genes: list[str], k: int, penalty: float = 5.0, thresh: float = 1e-6, max_iters: int = 30, nrep: int = 1, seed: int = 1, method: str = "nnls", start: Factors | None = None) -> Factors:
    """The factors of the lowest objective of nrep runs. method: "nnls" solves V and then W exactly, "hals" W and then V by coordinates.

    start: loadings that the first run begins at; it is not changed. H needs no start, as each pass solves it. The
    objective is of this run: its first entry is that of where it began.
    """
    best = None
    for rep in range(nrep):
        f = begin(rows, genes, k, penalty, seed + rep, start if rep == 0 else None)
        before = None
        for i in range(max_iters + 1):  # the last pass only measures
            cross, gram, squares, _ = _pass(rows, f)
            now = objective(f, cross, gram, squares)
            f.objective.append(now)
            if before is not None and abs(before - now) / ((before + now) / 2) <= thresh or i == max_iters:
                break
            before = now
            update(f, cross, gram, method)
        if best is None or f.objective[-1] < best.objective[-1]:
            best = f
    return best


def update(f: Factors, cross: dict, gram: dict, method: str = "nnls", own: set[str] | None = None) -> None:
    """New V and W for these sums; with own, the V of those datasets only."""
    if method == "nnls":
        for d in cross if own is None else own & cross.keys():
            f.v[d] = solve((1 + f.penalty) * gram[d], (cross[d] - f.w @ gram[d]).T).T
        f.w = solve(sum(gram.values()), sum(cross[d] - f.v[d] @ gram[d] for d in cross).T).T
        return
    for j in range(f.w.shape[1]):
        step = sum(cross[d][:, j] - (f.w + f.v[d]) @ gram[d][:, j] for d in cross) / max(sum(g[j, j] for g in gram.values()), 1e-15)
        f.w[:, j] = np.maximum(f.w[:, j] + step, 1e-16)
    for d in cross if own is None else own & cross.keys():
        for j in range(f.w.shape[1]):
            step = (cross[d][:, j] - (f.w + (1 + f.penalty) * f.v[d]) @ gram[d][:, j]) / max((1 + f.penalty) * gram[d][j, j], 1e-15)
            f.v[d][:, j] = np.maximum(f.v[d][:, j] + step, 1e-16)


def _project(batches: Iterator[pd.DataFrame], w: np.ndarray, v: dict[str, np.ndarray], penalty: float) -> Iterator[pd.DataFrame]:
    none = np.zeros_like(w)
    for pdf in batches:
        for d, part in pdf.groupby("dataset"):
            for i in range(0, len(part), 2000):
                some = part.iloc[i : i + 2000]
                yield pd.DataFrame({"dataset": d, "cell": some["cell"].to_numpy(), "h": _cells(_dense(some, len(w)), w, v.get(d, none), penalty).tolist()})


def project(rows: DataFrame, f: Factors) -> DataFrame:
    """(dataset, cell, h) of every cell at these loadings; datasets without own ones get those they share. Works on streams too."""
    w, v, penalty = f.w, f.v, f.penalty
    return rows.mapInPandas(lambda it: _project(it, w, v, penalty), "dataset string, cell string, h array<double>")


def remember(now: np.ndarray, old: np.ndarray, fresh: np.ndarray, size: float, step: int, rolled: bool) -> tuple[np.ndarray, np.ndarray]:
    """(the running sums with a batch's added, what of them is of the epoch before) of H'H, its k rows first, over X'H.

    The batch counts by its mean. What was there fades: by (step - 1) / step, wholly before the first batch, and to one
    over the size before the second. When an epoch begins (rolled), what is older than the last one is taken out first.
    """
    fade = (step - 1) / step if step > 1 else step / size
    if rolled:
        now, old = now - old, now - old
    now, old = fade * now + fresh / size, fade * old
    k = now.shape[1]
    now[range(k), range(k)] = np.where(now[range(k), range(k)] == 0, 1e-15, now[range(k), range(k)])
    return now, old


@dataclass
class _Run:
    """What steps of an online factorization change: the loadings, each dataset's running sums and what of them is of the epoch before; and how they go."""

    f: Factors
    now: dict[str, np.ndarray]
    old: dict[str, np.ndarray]
    done: dict[str, int]
    sweeps: int
    size: int
    first: int

    def step(self, step: int, cross: dict, gram: dict, cells: dict) -> None:
        f, k = self.f, self.f.w.shape[1]
        rolled = (step + 1) * self.size // self.first > (step * self.size // self.first if step else 0)
        for d in cross:
            self.now[d], self.old[d] = remember(self.now[d], self.old[d], np.concatenate([gram[d], cross[d]]), cells[d], self.done[d] + step, rolled)
            f.gram[d], f.cross[d], f.steps[d] = self.now[d][:k], self.now[d][k:], self.done[d] + step + 1
        for _ in range(self.sweeps):
            update(f, f.cross, f.gram, "hals", set(self.now))


def _steps(batches: Iterator[pd.DataFrame], run: _Run, step: int, places: list[int]) -> Iterator[pd.DataFrame]:
    """(run): after a step with each of these batches, in order, of a task's cells, about STRETCH."""
    held = list(batches)
    rows = pd.concat(held) if held else pd.DataFrame({"batch": []})
    for i, place in enumerate(places):
        part = rows[rows["batch"] == place]
        sums = {d: _split(s, run.f.w.shape[1]) for d, s in (_own(part, run.f.w, run.f.v, run.f.penalty) if len(part) else {}).items()}
        run.step(step + i, {d: s[3] for d, s in sums.items()}, {d: s[2] for d, s in sums.items()}, {d: s[1] for d, s in sums.items()})
    yield pd.DataFrame({"run": [pickle.dumps(run)]})


def online(rows: DataFrame, genes: list[str], k: int, penalty: float = 5.0, batch: int = 5000, epochs: int = 5, sweeps: int = 1, seed: int = 1, start: Factors | None = None) -> Factors:
    """Factors by mini-batches of about `batch` cells, each dataset's share by its size, for about `epochs` passes.

    Cells are dealt to batches by hash and written once, by batch; a step reads its batch only, adds its sums to the
    running ones (`remember`) and moves W and V by coordinates, `sweeps` times. Steps follow each other: a large batch is
    dealt to many tasks, of small ones a task takes STRETCH cells through their steps before it hands the model on. With
    start, its datasets take part in W with their sums beside those of rows: datasets without rows keep V and sums,
    others go on from theirs (refinement). start is not changed.
    """
    counts = {r["dataset"]: r["count"] for r in rows.groupBy("dataset").count().collect()}
    mine, first = set(counts), min(counts)
    f = begin(rows, genes, k, penalty, seed, start)
    size = max(1, round(counts[first] / sum(counts.values()) * batch))
    steps, batches = max(1, counts[first] * epochs // size), max(1, round(counts[first] / size))
    each = max(1, STRETCH // batch)  # batches of a stretch
    path = session.new_path(rows.sparkSession, "batches")
    dealt = rows.withColumn("batch", F.pmod(F.xxhash64("dataset", "cell", F.lit(seed)), F.lit(batches)).cast("int")).withColumn("stretch", F.floor(F.col("batch") / each).cast("int"))
    (dealt if each == 1 else dealt.repartition("stretch")).write.partitionBy("stretch").parquet(path)
    dealt = rows.sparkSession.read.schema(f"{ROWS}, batch int, stretch int").parquet(path)
    none = lambda: np.zeros((k + len(genes), k))
    now = {d: np.concatenate([f.gram[d], f.cross[d]]) if d in f.gram else none() for d in mine}
    run = _Run(f, now, {d: none() for d in mine}, {d: f.steps.get(d, 0) for d in mine}, sweeps, size, counts[first])
    step = 0
    while step < steps:
        place = step % batches
        own = dealt.where(F.col("stretch") == place // each).drop("stretch")
        places = list(range(place, min(place + each, batches, place + steps - step)))
        if each == 1:
            cross, gram, _, cells = _pass(own, run.f)
            run.step(step, cross, gram, cells)
        else:
            run = pickle.loads(own.coalesce(1).mapInPandas(lambda it, run=run, step=step, places=places: _steps(it, run, step, places), "run binary").first()[0])
        step += len(places)
    f = run.f
    cross, gram, squares, _ = _pass(rows, f)
    f.objective.append(objective(f, cross, gram, squares))
    return f


STATE = "part string, dataset string, place int, gene string, numbers array<double>"


def stored(f: Factors, path: str, spark: SparkSession) -> None:
    """Loadings, sums and steps as a table at path, which it replaces: a row a gene of W, V and X'H, a row a factor of H'H."""
    rows = [("w", None, i, g, f.w[i].tolist()) for i, g in enumerate(f.genes)] + [("penalty", None, 0, None, [float(f.penalty)])]
    for part, of in (("v", f.v), ("gram", f.gram), ("cross", f.cross)):
        rows += [(part, d, i, None, x.tolist()) for d, a in of.items() for i, x in enumerate(a)]
    rows += [("steps", d, 0, None, [float(n)]) for d, n in f.steps.items()]
    spark.createDataFrame(rows, STATE).write.mode("overwrite").parquet(path)


def restored(spark: SparkSession, path: str) -> Factors:
    """What `stored` wrote: numbers of the size of the loadings."""
    table = spark.read.schema(STATE).parquet(path).orderBy("part", "dataset", "place").toPandas()
    part = lambda name: table[table["part"] == name]
    matrix = lambda x: np.array(x["numbers"].tolist(), np.float64)
    of = lambda name: {d: matrix(x) for d, x in part(name).groupby("dataset")}
    steps = {d: int(x[0]) for d, x in zip(part("steps")["dataset"], part("steps")["numbers"], strict=True)}
    return Factors(part("w")["gene"].tolist(), matrix(part("w")), of("v"), float(matrix(part("penalty"))[0, 0]), [], of("gram"), of("cross"), steps)


def new_rows(counts: DataFrame, genes: list[str], rms: DataFrame | None = None) -> DataFrame:
    """Rows of arriving counts (dataset, cell, gene, value) at the genes of known loadings.

    A cell's counts are taken over its total, all genes included, and over the genes' root mean square: rms (dataset,
    gene, rms) if it is known, else that of these cells. Where it is under 1e-16 it counts as that. Cells without a
    count have no row; those without one at these genes have an empty one.
    """
    norm = normalized(counts)
    places = counts.sparkSession.createDataFrame([(g, i) for i, g in enumerate(genes)], "gene string, place int")
    own = norm.join(F.broadcast(places), "gene")
    if rms is None:
        sizes = norm.groupBy("dataset").agg(F.count_distinct("cell").alias("n"))
        rms = own.groupBy("dataset", "gene").agg(F.sum(F.col("value") * F.col("value")).alias("sq")).join(sizes, "dataset").select("dataset", "gene", F.sqrt(F.col("sq") / F.greatest(F.col("n") - 1, F.lit(1))).alias("rms"))
    scaled = own.join(rms, ["dataset", "gene"]).select("dataset", "cell", "place", (F.col("value") / F.greatest("rms", F.lit(1e-16))).alias("value"))
    every = norm.select("dataset", "cell").distinct()
    long = scaled.groupBy("dataset", "cell").agg(F.sort_array(F.collect_list(F.struct("place", "value"))).alias("p"))  # of one cell
    empty = lambda c, kind: F.coalesce(c, F.array().cast(f"array<{kind}>"))
    return every.join(long, ["dataset", "cell"], "left").select("dataset", "cell", empty(F.col("p.place"), "int").alias("genes"), empty(F.col("p.value"), "double").alias("values"))


def loadings(spark: SparkSession, f: Factors) -> DataFrame:
    """(dataset, gene, w, v)."""
    return spark.createDataFrame([(d, g, f.w[i].tolist(), f.v[d][i].tolist()) for d in f.v for i, g in enumerate(f.genes)], "dataset string, gene string, w array<double>, v array<double>")


def specificity(f: Factors, one: str, two: str) -> np.ndarray:
    """Of each factor, 100 * (1 - the ratio of its loadings' lengths in two datasets)."""
    length = lambda d: np.sqrt(((f.w + f.v[d]) ** 2).sum(0))
    return 100 * (1 - length(one) / length(two))


def specificity_of(loaded: DataFrame, one: str, two: str) -> DataFrame:
    """(factor, specificity) like `specificity`, of a table (dataset, gene, w, v) of loadings."""
    each = loaded.where(F.col("dataset").isin(one, two)).select("dataset", F.posexplode(F.zip_with("w", "v", lambda a, b: a + b)).alias("factor", "x"))
    length = lambda d: F.sqrt(F.sum(F.when(F.col("dataset") == d, F.col("x") * F.col("x")).otherwise(0.0)))
    return each.groupBy("factor").agg((100 * (1 - length(one) / length(two))).alias("specificity"))


def _left(batches: Iterator[pd.DataFrame], w: np.ndarray, v: dict[str, np.ndarray], new: np.ndarray, penalty: float) -> Iterator[pd.DataFrame]:
    """(dataset, piece, sums): of what a task's cells have beyond their factors, H'H and R'H for the best H at the new loadings."""
    total: dict[str, np.ndarray] = {}
    none = np.zeros_like(new)
    for pdf in batches:
        for d, part in pdf.groupby("dataset"):
            for i in range(0, len(part), CHUNK):
                x = _dense(part.iloc[i : i + CHUNK], len(w))
                r = np.maximum(x - _cells(x, w, v[d], penalty) @ (w + v[d]).T, 0)
                h = _cells(r, new, none, penalty)
                total[d] = total.get(d, 0) + np.concatenate([(h.T @ h).ravel(), (r.T @ h).ravel()])
    yield _pieces(total)


def resized(rows: DataFrame, f: Factors, k: int, seed: int = 1) -> Factors:
    """Loadings of k factors to begin at, out of f, which is not changed.

    Fewer: those stay that give the data most, by the sum of squares of H times that of their loadings. More: factors
    are drawn, each cell's part beyond its own factors is solved on them, and the new V and then W fit that part.
    """
    old = f.w.shape[1]
    g = f.copy()
    g.gram, g.cross, g.steps = {}, {}, {}
    if k < old:
        _, gram, _, _ = _pass(rows, f)
        gives = sum(np.diagonal(gram[d]) * ((f.w + f.v[d]) ** 2).sum(0) for d in gram)
        stay = np.sort(np.argsort(-gives, kind="stable")[:k])
        g.w, g.v = f.w[:, stay], {d: v[:, stay] for d, v in f.v.items()}
    elif k > old:
        w, v, penalty, more = f.w, f.v, f.penalty, k - old
        new = np.random.default_rng(seed).uniform(0, 1, (len(f.genes), more))
        new /= np.sqrt((new * new).sum(0))
        gram, cross = {}, {}
        for d, s in _together(rows.mapInPandas(lambda it: _left(it, w, v, new, penalty), PIECES)).items():
            gram[d], cross[d] = s[: more * more].reshape(more, more), s[more * more :].reshape(-1, more)
        own = Factors(f.genes, new, {d: np.zeros_like(new) for d in gram}, penalty)
        update(own, cross, gram)
        none = np.zeros_like(new)
        g.w, g.v = np.c_[f.w, own.w], {d: np.c_[x, own.v.get(d, none)] for d, x in f.v.items()}
    return g


def divergence(rows: DataFrame, f: Factors) -> float:
    """The median over cells of how far their factors' shares are from even: log2(k) less their entropy."""
    k = f.w.shape[1]
    share = F.transform("h", lambda x: x / F.col("total"))
    entropy = F.aggregate(share, F.lit(0.0), lambda s, p: s - F.when(p > 0, p * F.log2(p)).otherwise(0.0))
    cells = project(rows, f).withColumn("total", F.aggregate("h", F.lit(0.0), lambda s, x: s + x)).where("total > 0")
    return cells.select((float(np.log2(k)) - entropy).alias("d")).agg(F.median("d")).first()[0] or 0.0


def k_curve(rows: DataFrame, genes: list[str], ks: list[int], seed: int = 1, **how) -> list[tuple[int, float, float, Factors]]:
    """(k, objective, divergence, factors) for ascending ks, each run begun at the one before with factors added. how: see `factorize`."""
    out, f = [], None
    for k in sorted(ks):
        f = factorize(rows, genes, k, seed=seed, start=None if f is None else resized(rows, f, k, seed), **how)
        out.append((k, f.objective[-1], divergence(rows, f), f))
    return out
