from countweave.operators import metrics, ontology
from countweave.sources import readers as S


def test_triplets(spark, tmp_path):
    (tmp_path / "matrix.mtx").write_text("%%MatrixMarket matrix coordinate integer general\n%\n3 2 4\n1 1 5\n2 1 1\n3 2 2\n1 2 1\n")
    (tmp_path / "barcodes.tsv").write_text("AAA-1\nCCC-1\n")
    (tmp_path / "features.tsv").write_text("id1\tg\tGene Expression\nid2\tg\tGene Expression\nid3\tp\tPeaks\n")
    got = S.read_triplets(spark, str(tmp_path), "d").collect()
    assert sorted((r.cell, r.gene, r.value, r.feature_type) for r in got) == [("AAA", "g", 5, "Gene Expression"), ("AAA", "g.1", 1, "Gene Expression"), ("CCC", "g", 1, "Gene Expression"), ("CCC", "p", 2, "Peaks")]
    assert {r.cell for r in S.read_triplets(spark, str(tmp_path), "d", min_umis=3).collect()} == {"AAA"}
    assert {r.cell for r in S.read_triplets(spark, str(tmp_path), "d", num_cells=1).collect()} == {"AAA"}


def test_sample_folders(spark, tmp_path):
    """Both layouts, packed files, regions, and what cannot be told is an error."""
    import gzip

    import pytest

    def fill(folder, features, packed):
        folder.mkdir(parents=True)
        for name, text in (("matrix.mtx", "%%MatrixMarket\n2 1 2\n1 1 3\n2 1 4\n"), ("barcodes.tsv", "AAA-1\n"), features):
            (folder / (name + ".gz")).write_bytes(gzip.compress(text.encode())) if packed else (folder / name).write_text(text)

    fill(tmp_path / "new/outs/filtered_feature_bc_matrix", ("features.tsv", "i1\tg1\tGene Expression\ni2\tp1\tAntibody Capture\n"), True)
    fill(tmp_path / "old/outs/filtered_gene_bc_matrices/hg19", ("genes.tsv", "i1\tg1\ni2\tg2\n"), False)
    fill(tmp_path / "two/raw_gene_bc_matrices/hg19", ("genes.tsv", "i1\tg1\ni2\tg2\n"), False)
    fill(tmp_path / "two/raw_gene_bc_matrices/mm10", ("genes.tsv", "i1\tg1\ni2\tg2\n"), False)
    fill(tmp_path / "open", ("peaks.bed", "chr1\t5\t9\nchr2\t1\t4\n"), False)
    rows = S.read_samples(spark, {n: f"{tmp_path}/{n}" for n in ("new", "old", "open")}).collect()
    got = sorted((r.dataset, r.cell, r.gene, r.value, r.feature_type or "") for r in rows)
    assert got == [("new", "AAA", "g1", 3, "Gene Expression"), ("new", "AAA", "p1", 4, "Antibody Capture"), ("old", "AAA", "g1", 3, ""), ("old", "AAA", "g2", 4, ""), ("open", "AAA", "chr1:5-9", 3, "Chromatin Accessibility"), ("open", "AAA", "chr2:1-4", 4, "Chromatin Accessibility")]
    assert S.sample_files(spark, f"{tmp_path}/two", False, "mm10")[0].endswith("raw_gene_bc_matrices/mm10/matrix.mtx")
    for folder, reference in (("two", None), ("two", "xx"), ("none", None)):
        with pytest.raises((ValueError, FileNotFoundError)):
            S.sample_files(spark, f"{tmp_path}/{folder}", False, reference)


def test_fragments(spark, tmp_path):
    (tmp_path / "g.bed").write_text("chr1\t1\t2\tta\t.\t+\tx;y;x\nchr1\t3\t4\tb\t.\t+\ty\nchr1\t5\t6\tc\n")
    (tmp_path / "p.bed").write_text("chr1\t1\t2\tta\t.\t+\tx;z\n")
    genes, promoters = S.read_fragments(spark, f"{tmp_path}/g.bed"), S.read_fragments(spark, f"{tmp_path}/p.bed")
    assert sorted(tuple(r) for r in S.feature_matrix(genes, promoters, 1).collect()) == [("x", "ta", 3), ("y", "b", 1), ("y", "ta", 1)]


def test_positions(spark, tmp_path):
    (tmp_path / "pos.csv").write_text("AAA-1,1,0,0,10,20\n")
    cells = spark.createDataFrame([("AAA",), ("CCC",)], "cell string")
    got = {r.cell: (r.x, r.y) for r in S.placed(cells, S.read_positions(spark, f"{tmp_path}/pos.csv"), 0.5, 100).collect()}
    assert got == {"AAA": (10.0, 95.0), "CCC": (None, None)}


def test_obo_and_terms(spark, tmp_path):
    (tmp_path / "go.obo").write_text("format-version: 1.2\n\n[Term]\nid: T1\nname: one\nnamespace: n\nalt_id: T9\n\n[Term]\nid: T2\nname: two\nnamespace: n\nis_obsolete: true\nconsider: T1\n")
    terms, alternatives = S.read_obo(spark, f"{tmp_path}/go.obo")
    assert sorted((r.go, r.name, r.obsolete) for r in terms.collect()) == [("T1", "one", False), ("T2", "two", True)]
    assert sorted(map(tuple, alternatives.collect())) == [("T2", "T1"), ("T9", "T1")]
    results = spark.createDataFrame([("T9", 0.2), ("T1", 0.1)], "go string, pval double")
    assert [tuple(r) for r in ontology.prepared(results, terms, alternatives).collect()] == [("T1", "one", 0.1)]


def test_live_and_obsolete_terms(spark, tmp_path):
    """A term that an obsolete one names stays itself; an obsolete id is replaced by all it names."""
    stanza = "[Term]\nid: {}\nname: n{}\nnamespace: {}\n{}"
    obo = [stanza.format("T1", 1, "p", "alt_id: T8\n"), stanza.format("T2", 2, "p", ""), stanza.format("T3", 3, "p", "is_obsolete: true\nconsider: T1\nconsider: T2\n"), stanza.format("T4", 4, "f", ""), stanza.format("T5", 5, "p", "is_obsolete: true\n")]
    (tmp_path / "go.obo").write_text("format-version: 1.2\n\n" + "\n".join(obo))
    terms, alternatives = S.read_obo(spark, f"{tmp_path}/go.obo")
    of = lambda *rows, **more: sorted((r.go, r.pval) for r in ontology.prepared(spark.createDataFrame(rows, "go string, pval double"), terms, alternatives, **more).collect())
    assert of(("T1", 0.3)) == [("T1", 0.3)]
    assert of(("T3", 0.1), ("T1", 0.3)) == [("T1", 0.1), ("T2", 0.1)]
    assert of(("T5", 0.1), ("T7", 0.1)) == []
    assert of(("T8", 0.2), ("T4", 0.1), ("T2", 0.5), max_p=0.4, namespace="p") == [("T1", 0.2)]


def test_similarity(spark):
    edges = spark.createDataFrame([("a", "p"), ("b", "p"), ("p", "r")], "go string, parent string")
    ic = spark.createDataFrame([("a", 4.0, 0.1), ("b", 2.0, 0.1), ("p", 1.0, 0.2), ("r", 0.0, 1.0)], "go string, ic double, frequency double")
    up = ontology.closure(edges)
    assert {tuple(r) for r in up.collect()} == {("a", "p"), ("b", "p"), ("p", "r"), ("a", "r"), ("b", "r")}
    got = {(r.a, r.b): r.similarity for r in ontology.similarity(ic.select("go"), up, ic).collect()}
    assert got["a", "b"] == 2 / 6 and got["a", "p"] == 2 / 5 and got["a", "r"] == 0


def test_save_and_load(spark, tmp_path):
    df = spark.createDataFrame([("d", "c", 1)], "dataset string, cell string, n int")
    S.save({"cells": df}, str(tmp_path))
    assert S.load(spark, str(tmp_path), ["cells"])["cells"].select("dataset", "cell", "n").collect() == df.collect()


def test_agreement(spark):
    labels = spark.createDataFrame([(1, "x"), (1, "x"), (2, "y"), (2, "x")], "a int, b string")
    assert metrics.purity(labels, "a", "b").first()[0] == 0.75
    same = spark.createDataFrame([(1, "x"), (1, "x"), (2, "y")], "a int, b string")
    assert abs(metrics.rand_index(same, "a", "b").first()[0] - 1) < 1e-12


def test_representatives_against_pairs_one_by_one(spark):
    """FX5's rules on drawn terms: p that falls in steps, priorities, frequent terms, children."""
    import random

    for seed in range(3):
        r = random.Random(seed)
        names = [f"t{i:02d}" for i in range(14)]
        p = {t: 2.0 ** -r.randrange(6) * r.choice((1, 0.7)) for t in names}
        often = {t: r.choice((0.01, 0.01, 0.2, None)) for t in names}
        parents = {(a, b) for i, a in enumerate(names) for b in names[:i] if r.random() < 0.3}
        sim = {(a, b): r.choice((0.2, 0.5, 0.6, 0.6, 0.9)) for i, b in enumerate(names) for a in names[:i]}
        prior = tuple(r.sample(names, 3))

        def stays(a, b):
            high = lambda t: (often[t] or 0) > 0.05
            if (a in prior) != (b in prior):
                return a if a in prior else b
            if high(a) != high(b):
                return b if high(a) else a
            if p[a] < p[b] / 2 or p[b] < p[a] / 2:
                return min(a, b, key=p.get)
            if ((a, b) in parents) != ((b, a) in parents):
                return a if (a, b) in parents else b
            return a if p[a] <= p[b] else b

        alive, to = set(names), {}
        while some := [(-s, a, b) for (a, b), s in sim.items() if s >= 0.5 and a in alive and b in alive]:
            _, a, b = min(some)
            keep = stays(a, b)
            lost = b if keep == a else a
            alive.remove(lost)
            to[lost] = keep
        want = {}
        for t in names:
            u = t
            while u in to:
                u = to[u]
            want[t] = u
        frame = spark.createDataFrame
        got = ontology.representatives(frame(list(p.items()), "go string, pval double"), frame([(a, b, s) for (a, b), s in sim.items()], "a string, b string, similarity double"), frame(list(often.items()), "go string, frequency double"), 0.5, frame(sorted(parents), "go string, parent string"), prior)
        assert {x.go: x.representative for x in got.collect()} == want
