import hashlib
import math
import random
import re
import zlib
from collections import Counter

from countweave.llm import target_resampling as R

COLUMNS = ["doc_id", "n_features", "weight", "score", "rank"]


def tokens(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(rows, target, buckets=10_000, n=2, percent=25):
    def of(text):
        w = tokens(text)
        return [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(1, n + 1) for i in range(len(w) - k + 1)]

    s, t = (Counter(b for x in texts for b in of(x)) for texts in ([x for _, x in rows], target))
    all_s, all_t = sum(s.values()), sum(t.values())
    out = []
    for key, text in rows:
        own = of(text)
        gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in own]
        weight = sum(gain) // len(own) if own else 0
        h = int(hashlib.sha256(f"7:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        out.append([key, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    fit = sorted((i for i, (_, x) in enumerate(rows) if len(tokens(x)) >= 20), key=lambda i: (-out[i][3], out[i][0] is None, out[i][0] or 0))
    for place, i in enumerate(fit[: percent * len(fit) // 100], 1):
        out[i][4] = place
    return sorted(map(tuple, out), key=str)


def run(spark, rows, target, **more):
    df = spark.createDataFrame([(k, t, "x", 1, 2) for k, t in rows], "doc_id long, text string, row string, Rank int, Buckets int")
    aim = spark.createDataFrame([(t,) for t in target], "text string")
    got = R.resample(df, aim, **more)
    texts = ["text"] if more.get("keep_text", True) else []
    assert got.columns == ["doc_id", *texts, "row", "Buckets", "n_words", "n_features", "weight", "score", "rank"]
    return sorted((tuple(r) for r in got.select(COLUMNS).collect()), key=str)


def corpus(seed, n):
    r = random.Random(seed)
    vocabulary = ["a", "B", "cd", "Éa", "x1", "日本", "-", "_", "don't", "É", "e\x7ff", "tab\tbed", "\n"] + [f"w{i}" for i in range(60)]
    return [(i, " ".join(r.choice(vocabulary) for _ in range(r.randrange(60)))) for i in range(n)]


def test_against_brute_force(spark):
    rows, target = corpus(1, 150), [t for _, t in corpus(2, 10)] + [None, ""]
    want = brute(rows, target)
    assert run(spark, rows, target) == want and sum(r[4] is not None for r in want) > 10
    assert run(spark, rows, target, keep_text=False) == want
    assert run(spark, rows, target, runs=3, buckets=70_001) == brute(rows, target, 70_001, 3)
    assert run(spark, rows, target, percent=100, runs=1) == brute(rows, target, n=1, percent=100)


def test_edge_cases(spark):
    long = " ".join(f"w{i % 7}" for i in range(300_000))
    rows = [(1, None), (2, ""), (3, " -- "), (None, "w1 " * 25), (None, "w1 " * 25), (5, "w2 " * 25), (5, "w2 " * 25), (6, long), (7, "x" * 100_000), (8, "w1 " * 19), (9, "w1 " * 20)]
    assert run(spark, rows, ["w1 w2"], percent=60) == brute(rows, ["w1 w2"], percent=60)
    assert run(spark, rows, []) == brute(rows, [])
    assert run(spark, [], ["a b"]) == []
    assert run(spark, rows[:2], [None]) == brute(rows[:2], [None])


def test_ring_goes_on_over_blocks():
    text = b"one two  three four five"
    whole = R.scan(text, 3, 1 << 32 - 1)
    assert whole[0] == 5 and len(whole[1]) == 5 + 4 + 3
    for block in (1, 3, 8):
        n, own = R.scan(text, 3, 1 << 32 - 1, block)
        assert n == 5 and own.tolist() == whole[1].tolist()
    ring = R.Ring(3)
    for word in (b"a", b"b", b"c"):
        states = ring.push(word)
    assert states == [zlib.crc32(x) for x in (b"c", b"b c", b"a b c")]


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    read = lambda name, *c: [tuple(r) for r in spark.read.parquet(f"{sf}/{name}.parquet").select(*c).collect()]
    got = R.query(spark, sf)
    assert got.columns == COLUMNS
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(read("documents", "doc_id", "text"), [t for (t,) in read("benchmark", "text")])
