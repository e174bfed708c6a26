import math
import random

from countweave.operators import ranks as R


def plain(full, group, gene):
    """Everything by definition, zeros included."""
    v = [x[gene] for _, x in full]
    rank = [sum(b < a for b in v) + (sum(b == a for b in v) + 1) / 2 for a in v]
    n = len(v)
    mine = [i for i, (g, _) in enumerate(full) if g == group]
    n1, n2 = len(mine), n - len(mine)
    u1 = n1 * n2 + n1 * (n1 + 1) / 2 - sum(rank[i] for i in mine)
    t = 1 - sum(v.count(a) ** 3 - v.count(a) for a in set(v)) / (n**3 - n)
    z = (max(u1, n1 * n2 - u1) - (n1 * n2 / 2 + 0.5)) / math.sqrt(t * n1 * n2 * (n + 1) / 12)
    logs = [math.log(a + 1e-10) for a in v]
    inside = sum(logs[i] for i in mine) / n1
    return inside, inside - (sum(logs) - inside * n1) / n2, min(u1, n1 * n2 - u1), math.erfc(abs(z) / math.sqrt(2))


def test_against_definition(spark):
    r = random.Random(6)
    full = [(f"k{i % 3}", {g: float(r.choice([0, 0, 1, 2, 2, 5])) for g in "abcd"}) for i in range(40)]
    values = [(str(i), g, x) for i, (_, row) in enumerate(full) for g, x in row.items() if x]
    cells = [(str(i), g) for i, (g, _) in enumerate(full)] + [("none", None)]
    got = R.rank_test(spark.createDataFrame(values, "cell string, gene string, value double"), spark.createDataFrame(cells, "cell string, group string")).collect()
    assert len(got) == 12
    for row in got:
        want = plain(full, row.group, row.gene)
        assert all(abs(a - b) < 1e-9 for a, b in zip((row.avg_expr, row.log_fc, row.statistic, row.pval), want, strict=True))


def test_average_ranks_of_ties(spark):
    df = spark.createDataFrame([("x", 2.0), ("x", 2.0), ("x", 5.0)], "g string, value double").selectExpr("g", "value", "2L AS zeros")
    assert sorted((r.value, r.rank) for r in R.average_ranks(df, ["g"], absent="zeros").collect()) == [(2.0, 3.5), (2.0, 3.5), (5.0, 5.0)]


def test_adjusted(spark):
    df = spark.createDataFrame([("a", 0.01), ("a", 0.04), ("a", 0.03), ("a", None), ("b", 0.5)], "g string, pval double")
    got = {(r.g, r.pval): r.padj for r in R.adjusted(df, ["g"]).collect()}
    assert abs(got["a", 0.01] - 0.03) < 1e-12 and abs(got["a", 0.03] - 0.04) < 1e-12 and abs(got["a", 0.04] - 0.04) < 1e-12
    assert got["a", None] is None and got["b", 0.5] == 0.5


def test_ranked_enrichment_by_walking(spark):
    import random

    from countweave.operators import ranks

    r = random.Random(4)
    ranking = [(f"g{i:02d}", round(r.gauss(0, 1), 1)) for i in range(60)]
    sets = [("top", g) for g, s in ranking if s > 0.8] + [("low", g) for g, s in ranking if s < -0.9] + [("any", g) for g, _ in r.sample(ranking, 9)] + [("any", "unknown")]
    order = sorted(ranking, key=lambda x: (-x[1], x[0]))

    def walk(names):
        inside = [(g, s) for g, s in order if g in names]
        total, at, best = sum(abs(s) for _, s in inside), 0.0, 0.0
        for g, s in order:
            at += abs(s) / total if g in names else -1 / (60 - len(inside))
            best = at if abs(at) > abs(best) + 1e-12 else best
        return len(inside), best

    frame = spark.createDataFrame(ranking, "gene string, score double"), spark.createDataFrame(sets, "set string, gene string")
    got = {x["set"]: x for x in ranks.ranked_enrichment(*frame, permutations=40).collect()}
    for name in ("top", "low", "any"):
        size, es = walk({g for s, g in sets if s == name})
        assert got[name]["size"] == size and abs(got[name].es - es) < 1e-9
    assert got["top"].es > 0.9 and got["low"].es < -0.9 and got["top"].pval < 0.1 > got["low"].pval and got["top"].nes > 1
    assert {x["set"]: (x.pval, x.nes) for x in ranks.ranked_enrichment(*frame, permutations=40).collect()} == {k: (x.pval, x.nes) for k, x in got.items()}


def test_ranks_are_not_joined_back_to_values(spark, monkeypatch):
    from countweave.operators import ranks as R

    monkeypatch.setattr(R, "average_ranks", None)  # a table of all values more
    values = spark.createDataFrame([("a", "g", 1.0), ("b", "g", 1.0), ("c", "g", 2.0)], "cell string, gene string, value double")
    cells = spark.createDataFrame([("a", 0), ("b", 1), ("c", 1), ("d", 0)], "cell string, group int")
    got = {r.group: r.statistic for r in R.rank_test(values, cells).collect()}
    assert got == {0: 0.5, 1: 0.5}  # ranks 1, 2.5, 2.5, 4
