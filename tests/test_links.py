import numpy as np

from countweave.operators import links as L


def test_pairs_and_correlations_against_loops(spark):
    r = np.random.default_rng(6)
    place = lambda n, name: [(f"{name}{i:02d}", f"c{r.integers(2)}", int(s := r.integers(0, 3000)), int(s + r.integers(1, 400))) for i in range(n)]
    genes, peaks = place(25, "g"), place(60, "p")
    peaks += [(f"q{i}", "c0", 1000, 1010) for i in range(20)]  # a crowded bin
    a, b = (r.poisson(0.7, (30, len(x))) for x in (genes, peaks))
    a[:, 3] = 0
    a[:, 4] = 2  # does not vary
    long = lambda x, names: [(f"s{i}", names[j][0], int(x[i, j])) for i in range(30) for j in range(len(names)) if x[i, j]]
    frame = spark.createDataFrame
    g, p = frame(genes, "gene string, chrom string, start long, end long"), frame(peaks, "peak string, chrom string, start long, end long")
    for distance in (0, 150, 5000):
        want = {(x[0], y[0]) for x in genes for y in peaks if x[1] == y[1] and y[2] <= x[3] + distance and y[3] >= x[2] - distance}
        got = [tuple(z) for z in L.near(g, p, distance).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    rows = L.linked(frame(long(a, genes), "cell string, gene string, value long"), g, frame(long(b, peaks), "cell string, peak string, value long"), p, 150).collect()
    for row in rows:
        x, y = a[:, int(row.gene[1:])].astype(float), b[:, [q[0] for q in peaks].index(row.peak)].astype(float)
        assert row.correlation is None if x.std() == 0 or y.std() == 0 else abs(row.correlation - np.corrcoef(x, y)[0, 1]) < 1e-9
    assert {r.gene for r in rows} <= {x[0] for x in genes} - {"g03"} and any(r.correlation is None for r in rows) == any(x == "g04" for x, _ in {(r.gene, r.peak) for r in rows})
