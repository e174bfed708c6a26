import itertools

import numpy as np
import pytest

from countweave.operators import align as A
from countweave.operators import factorize as N


def best(gram, b):
    """Of all passive sets, the feasible one of least error."""
    out, least = np.zeros(len(b)), 0.0
    for r in range(1, len(b) + 1):
        for p in map(list, itertools.combinations(range(len(b)), r)):
            x = np.zeros(len(b))
            x[p] = np.linalg.solve(gram[np.ix_(p, p)], b[p])
            if (x >= 0).all() and x @ gram @ x - 2 * b @ x < least - 1e-12:
                out, least = x, x @ gram @ x - 2 * b @ x
    return out


def test_solve_against_all_passive_sets():
    r = np.random.default_rng(3)
    a, b = r.standard_normal((20, 4)), r.standard_normal((20, 30))
    x = N.solve(a.T @ a, a.T @ b)
    assert np.allclose(x, np.stack([best(a.T @ a, (a.T @ b)[:, c]) for c in range(30)], 1))
    assert N.solve(np.zeros((2, 2)), np.zeros((2, 3))).tolist() == np.zeros((2, 3)).tolist()


@pytest.fixture(scope="module")
def data(spark):
    r = np.random.default_rng(1)
    w = r.random((12, 3)) * (r.random((12, 3)) < 0.5)
    rows = []
    for d in "ab":
        x = r.random((40, 3)) @ (w + 0.1 * r.random((12, 3))).T
        rows += [(d, f"{d}{i}", f"g{j:02d}", float(x[i, j])) for i in range(40) for j in range(12)]
    genes = [f"g{j:02d}" for j in range(12)]
    return N.rows_of(spark.createDataFrame(rows, "dataset string, cell string, gene string, value double"), genes), genes


@pytest.mark.parametrize("method", ["nnls", "hals"])
def test_objective_falls(data, method):
    f = N.factorize(*data, k=3, max_iters=6, method=method)
    steps = np.diff(f.objective)
    assert (steps <= 1e-9 * f.objective[0]).all() and f.objective[-1] < 0.8 * f.objective[0]
    assert (f.w >= 0).all() and all((v >= 0).all() for v in f.v.values())


def test_online_and_projection(data):
    rows, genes = data
    f = N.online(rows, genes, 3, batch=30, epochs=3)
    assert f.objective[-1] < 1.5 * N.factorize(rows, genes, 3, max_iters=6).objective[-1]
    h = N.project(rows, f).collect()
    assert len(h) == 80 and all(min(r.h) >= 0 for r in h)
    again = N.online(rows.where("dataset = 'b'"), genes, 3, batch=30, epochs=1, start=f)
    assert set(again.v) == {"a", "b"}
    aligned = A.quantile_align(N.project(rows, f), quantiles=10, min_cells=3).collect()
    assert len(aligned) == 80 and all(len(r.h_norm) == 3 for r in aligned)


def test_k_too_large(data):
    with pytest.raises(ValueError):
        N.factorize(*data, k=12)


def test_stream_projection(spark, data, tmp_path):
    from countweave.streaming.online import project_stream

    rows, genes = data
    f = N.factorize(rows, genes, 3, max_iters=1)
    rows.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    project_stream(stream, f, f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 80


def test_remembered_sums_by_hand():
    """Sums of one gene and one factor (H'H over X'H), batches of two cells, and two new epochs."""
    now = old = np.zeros((2, 1))
    steps = [(4, 8, False), (6, 2, False), (10, 4, True), (8, 6, True)]
    want = [((2, 4), (0, 0)), ((1 + 3, 2 + 1), (0, 0)), ((2 + 5, 1.5 + 2), (2, 1.5)), (((7 - 2) * 2 / 3 + 4, (3.5 - 1.5) * 2 / 3 + 3), (10 / 3, 4 / 3))]
    for step, ((h, x, rolled), (a, b)) in enumerate(zip(steps, want, strict=True)):
        now, old = N.remember(now, old, np.array([[h], [x]], float), 2, step, rolled)
        assert np.allclose(now.ravel(), a) and np.allclose(old.ravel(), b)
    assert N.remember(np.zeros((2, 1)), np.zeros((2, 1)), np.zeros((2, 1)), 2, 0, False)[0].ravel().tolist() == [1e-15, 0]


def test_refinement_keeps_what_is_known(data):
    rows, genes = data
    f = N.online(rows.where("dataset = 'a'"), genes, 3, batch=20, epochs=3)
    again = N.online(rows.where("dataset = 'b'"), genes, 3, batch=20, epochs=3, start=f)
    assert np.array_equal(again.v["a"], f.v["a"]) and np.array_equal(again.gram["a"], f.gram["a"])
    assert set(again.gram) == {"a", "b"} and not np.array_equal(again.w, f.w)


def test_a_start_is_taken_and_not_changed(data):
    rows, genes = data
    first = N.factorize(rows, genes, 3, max_iters=3, thresh=0)
    w, v, measured = first.w.copy(), {d: x.copy() for d, x in first.v.items()}, list(first.objective)
    again = N.factorize(rows, genes, 3, max_iters=3, thresh=0, start=first)
    assert again is not first and first.objective == measured and np.array_equal(first.w, w) and all(np.array_equal(first.v[d], v[d]) for d in v)
    assert len(again.objective) == 4 and np.isclose(again.objective[0], measured[-1]) and again.objective[-1] < measured[-1] and not np.array_equal(again.w, w)
    whole = N.factorize(rows, genes, 3, max_iters=6, thresh=0)
    assert np.allclose(whole.objective[-1], again.objective[-1], rtol=1e-9)
    best = N.factorize(rows, genes, 3, max_iters=2, nrep=2, start=first)
    assert best.objective[-1] <= again.objective[0] + 1e-9
    part = N.Factors(genes, w, {"a": v["a"]}, 5.0)
    assert set(N.factorize(rows, genes, 3, max_iters=1, start=part).v) == {"a", "b"} and set(part.v) == {"a"}
    with pytest.raises(ValueError):
        N.factorize(rows, genes, 2, start=first)


def test_own_datasets_only(data):
    rows, genes = data
    for method in ("nnls", "hals"):
        f = N.factorize(rows, genes, 3, max_iters=1)
        kept = f.v["a"].copy()
        cross, gram, *_ = N._pass(rows, f)
        N.update(f, cross, gram, method, {"b"})
        assert np.array_equal(f.v["a"], kept)


def test_state_round_trip(spark, data, tmp_path):
    rows, genes = data
    f = N.online(rows, genes, 3, batch=30, epochs=1)
    N.stored(f, f"{tmp_path}/s", spark)
    g = N.restored(spark, f"{tmp_path}/s")
    assert g.genes == genes and np.array_equal(g.w, f.w) and g.steps == f.steps and g.penalty == f.penalty
    assert all(np.array_equal(a[d], b[d]) for a, b in ((g.v, f.v), (g.gram, f.gram), (g.cross, f.cross)) for d in "ab")


def test_streamed_refinement(spark, data, tmp_path):
    """Three batches, of a new dataset, another, and more cells of the first, are three calls; a replayed batch changes nothing."""
    from countweave.streaming import online as O

    rows, genes = data
    parts = [rows.where("dataset = 'a' AND cell < 'a3'"), rows.where("dataset = 'b'"), rows.where("dataset = 'a' AND cell >= 'a3'")]
    want = None
    for i, part in enumerate(parts):
        part.coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
        want = N.online(part, genes, 3, batch=20, epochs=2, start=want)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    O.refine_stream(stream, genes, 3, f"{tmp_path}/state", f"{tmp_path}/check", batch=20, epochs=2).awaitTermination()
    assert O.versions(spark, f"{tmp_path}/state") == [0, 1, 2]
    same = lambda f, g: f.steps == g.steps and np.allclose(f.w, g.w) and all(np.allclose(a[d], b[d]) for a, b in ((f.v, g.v), (f.gram, g.gram), (f.cross, g.cross)) for d in g.v)
    assert same(O.state_at(spark, f"{tmp_path}/state", 2), want)
    again = O.refiner(genes, 3, f"{tmp_path}/state", batch=20, epochs=2)
    for number in (2, 1):  # also one whose followers are there already
        again(parts[number], number)
    again(rows.limit(0), 3)
    assert same(O.state_at(spark, f"{tmp_path}/state", 2), want) and O.versions(spark, f"{tmp_path}/state") == [0, 1, 2]
    assert O.versions(spark, f"{tmp_path}/nothing") == []


def test_new_rows_by_hand(spark):
    counts = spark.createDataFrame([("d", "x", "g1", 2), ("d", "x", "g9", 2), ("d", "y", "g1", 1), ("d", "z", "g9", 5)], "dataset string, cell string, gene string, value long")
    got = {r.cell: (r.genes, r["values"]) for r in N.new_rows(counts, ["g0", "g1"]).collect()}
    rms = ((0.5**2 + 1) / 2) ** 0.5
    assert got["z"] == ([], []) and got["x"][0] == got["y"][0] == [1] and np.allclose([got["x"][1][0], got["y"][1][0]], [0.5 / rms, 1 / rms])
    known = spark.createDataFrame([("d", "g1", 0.0)], "dataset string, gene string, rms double")
    assert N.new_rows(counts, ["g1"], known).where("cell = 'y'").first()["values"] == [1e16]


def test_other_numbers_of_factors(data):
    rows, genes = data
    f = N.factorize(rows, genes, 2, max_iters=5)
    more = N.resized(rows, f, 3)
    begun, cold = N.factorize(rows, genes, 3, max_iters=5, start=more), N.factorize(rows, genes, 3, max_iters=5)
    assert begun.objective[0] <= f.objective[-1] * 1.01 and begun.objective[-1] <= cold.objective[-1] * 1.02 and f.w.shape[1] == 2
    less = N.resized(rows, begun, 1)
    assert less.w.shape == (12, 1) and any(np.array_equal(less.w[:, 0], begun.w[:, j]) for j in range(3))
    curve = N.k_curve(rows, genes, [3, 2], max_iters=3)
    assert [c[0] for c in curve] == [2, 3] and curve[1][1] < curve[0][1] and all(c[2] >= 0 for c in curve)


def test_small_batches_share_a_task_and_every_number_is_sent_once(data):
    rows, genes = data
    calls, own = [], N._pass
    N._pass = lambda *how: calls.append(1) or own(*how)
    try:
        f = N.online(rows, genes, 3, batch=20, epochs=3)
    finally:
        N._pass = own
    alone, N.STRETCH = N.STRETCH, 1  # each step a pass of its own
    try:
        g = N.online(rows, genes, 3, batch=20, epochs=3)
    finally:
        N.STRETCH = alone
    assert len(calls) == 1 and f.steps == g.steps and np.allclose(f.w, g.w) and all(np.allclose(f.cross[d], g.cross[d]) for d in "ab")
    sent = N._together(rows.repartition(7).mapInPandas(lambda it: N._sums(it, f.w, f.v, 5.0), N.PIECES))
    assert all(len(s) == 2 + 9 + 3 * len(genes) for s in sent.values())


def test_equations_of_all_columns_at_once():
    r = np.random.default_rng(3)
    a, b = r.uniform(size=(40, 6)), r.normal(size=(40, 300))
    gram, right = a.T @ a, a.T @ b
    x = N.solve(gram, right)
    y = gram @ x - right
    assert (x >= 0).all() and (y > -1e-9).all() and np.abs(x * y).max() < 1e-9
    passive = r.random((6, 300)) < 0.5
    assert np.allclose(N._on(gram, right, passive, True), N._on(gram, right, passive, False))


def test_counts_of_a_query_are_made_once(spark, monkeypatch):
    from countweave.plans import registry

    made, cut = [], registry.session.cut
    monkeypatch.setattr(registry.session, "cut", lambda df, what="table": made.append("part.parquet" in str(df.inputFiles())) or cut(df, what))
    rows, genes = registry._factor_rows(spark, "/root/testdata/sf0.001")
    assert made.count(True) == 1 and rows.count() > 0 and genes
