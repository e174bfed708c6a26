import hashlib
import math


from countweave.llm import mixing as M

SCHEMA = "doc_id long, text string, source string, copy int, RATE string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)


def copies(key, rate, seed=M.SEED):
    u = int(hashlib.md5(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:13], 16) / 2**52
    if rate == 0:
        return 0
    k, p = 0, math.exp(-rate)
    c = p
    while u >= c and k < 10_000:
        k += 1
        p *= rate / k
        c += p
    return k


def brute(rows, power=M.POWER):
    own = {}
    for _, t, s in rows:
        own[s] = own.get(s, 0) + len(t or "")
    total, weight = sum(own.values()), sum(v**power for v in own.values())
    rate = {s: v**power / weight * total / v if v else 0 for s, v in own.items()}
    return sorted(((k, s, n) for k, _, s in rows for n in range(copies(k, rate[s]))), key=str)


def got(df):
    return sorted(((r.doc_id, r.source, r.copy) for r in df.collect()), key=str)


def rows_of(n):
    return [(i, "x" * (i % 7 * 10), ["a", "a", "a", "b", None][i % 5] if i % 50 else "rare") for i in range(n)]


def test_against_brute_force(spark, monkeypatch):
    rows = [*rows_of(400), (None, "xx", "a"), (3, "yy", "b"), (3, "yy", "b"), (999, None, "empty")]
    assert got(M.replicate(frame(spark, rows))) == brute(rows)
    monkeypatch.setattr(M, "FEW", 0)
    assert got(M.replicate(frame(spark, rows))) == brute(rows)


def test_weights_and_shares(spark):
    rows = [(i, "xxxx", "abc"[i % 3 if i % 10 else 0]) for i in range(6000)]
    weights = spark.createDataFrame([("a", 1.0), ("b", 3.0), ("other", 5.0)], "source string, weight double")
    out = M.replicate(frame(spark, rows), weights=weights).groupBy("source").count().collect()
    n = {r["source"]: r["count"] for r in out}
    assert "c" not in n and abs(n["b"] / n["a"] - 3) < 0.3 and abs(sum(n.values()) - 6000) < 300


def test_order_is_global_and_stable(spark):
    one = [(r.doc_id, r.copy, r.shuffle_key) for r in M.replicate(frame(spark, rows_of(300))).collect()]
    assert [x[2] for x in one] == sorted(x[2] for x in one)
    assert one == [(r.doc_id, r.copy, r.shuffle_key) for r in M.replicate(frame(spark, rows_of(300)).repartition(7)).collect()]


def test_edge_cases(spark):
    assert M.replicate(frame(spark, [])).collect() == []
    assert M.replicate(frame(spark, [(1, None, "a")])).collect() == []
    weights = spark.createDataFrame([("a", 1.0)], "source string, weight double")
    high = M.replicate(frame(spark, [(1, "x", "a"), (2, "x" * 10_000, "b")]), weights=weights).collect()
    assert abs(len(high) - 10_001) < 600 and {r.doc_id for r in high} == {1}


def test_clashing_names(spark):
    rows = [(i, "x" * (5 + i), "ab"[i % 2], 1, 2, 3, 4, 5) for i in range(40)]
    named = spark.createDataFrame(rows, "doc_id long, text string, source string, cdf int, parts int, src int, own int, w int")
    plain = M.replicate(frame(spark, [r[:3] for r in rows])).collect()
    assert [(r.doc_id, r.copy) for r in M.replicate(named).collect()] == [(r.doc_id, r.copy) for r in plain]


def test_small_sources_beside_a_large_one(spark, monkeypatch):
    """Rates far over what one draw can do: copies are the sum over the parts, and their mean is the rate."""
    rows = [(0, "x" * 4_000_000, "all"), *((i, "xx", "mid") for i in range(1, 4)), *((i, "x", "rare") for i in range(4, 6))]
    own = {"all": 4_000_000, "mid": 6, "rare": 2}
    rate = {s: n**0.5 / sum(v**0.5 for v in own.values()) * sum(own.values()) / n for s, n in own.items()}
    assert M.ONE < rate["mid"] < rate["rare"]

    def summed(key, r):
        parts = 1 if r <= M.ONE else math.ceil(r / M.MOST)
        return copies(key, r) if parts == 1 else sum(copies(f"{key}:{p}", r / parts) for p in range(1, parts + 1))

    def counts():
        out = M.replicate(frame(spark, rows), shuffle=False).groupBy("doc_id", "source", "rate").count().collect()
        return {r.doc_id: (r.source, r["count"]) for r in out}

    got_n = counts()
    for k, _, s in rows:
        want = summed(k, rate[s])
        assert got_n.get(k, (s, 0)) == (s, want)
        assert abs(want - rate[s]) < 6 * rate[s] ** 0.5 + 1
    monkeypatch.setattr(M, "FEW", 0)
    assert counts() == got_n


def test_one_draw_up_to_the_rates_that_sql_can_do(spark):
    """Between MOST and ONE the copies are those of the SQL's single draw."""
    rows = [(0, "x" * 1_490_000, "all"), *((i, "x", "rare") for i in range(1, 5))]
    rate = 2 / (1_490_000**0.5 + 2) * 1_490_004 / 4
    assert M.MOST < rate < M.ONE
    got_n = {r.doc_id: r["count"] for r in M.replicate(frame(spark, rows), shuffle=False).groupBy("doc_id").count().collect()}
    assert {k: n for k, n in got_n.items() if k} == {k: copies(k, rate) for k in range(1, 5)}


def test_clashing_names(spark, monkeypatch):
    extra = ["__src", "__n", "__parts", "__cdf", "__salt", "src", "parts", "cdf", "salt", "salted", "n"]
    df = spark.createDataFrame([(i, "some text", f"s{i % 3}", *range(len(extra))) for i in range(40)], ", ".join(["doc_id long", "text string", "source string", *(f"`{c}` int" for c in extra)]))
    want = M.replicate(df.select("doc_id", "text", "source")).count()
    for few in (1000, 1):
        monkeypatch.setattr(M, "FEW", few)
        out = M.replicate(df)
        assert out.columns[: len(df.columns)] == df.columns and out.count() == want
        assert {tuple(r[c] for c in extra) for r in out.collect()} == {tuple(range(len(extra)))}
