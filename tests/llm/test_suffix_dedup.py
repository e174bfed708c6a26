import hashlib
import random
from collections import Counter

import numpy as np

from countweave.llm import suffix_dedup as S

SCHEMA = "doc_id long, text string, kept string, Spans int"


def brute(rows, length):
    data = [(k, (t or "").encode()) for k, t in rows]
    seen = Counter(x[i : i + length] for _, x in data for i in range(len(x) - length + 1))
    out = []
    for k, x in data:
        gone = np.zeros(len(x) + 1, bool)
        for i in range(len(x) - length + 1):
            if seen[x[i : i + length]] > 1:
                gone[i : i + length] = True
        edges = np.flatnonzero(np.diff(np.r_[False, gone].astype(int)))
        out.append((k, len(x), bytes(b for b, g in zip(x, gone, strict=False) if not g), edges.reshape(-1, 2).tolist()))
    return sorted(out, key=str)


def run(spark, rows, length, k, **more):
    df = spark.createDataFrame([(a, b, "x", 1) for a, b in rows], SCHEMA)
    got = S.strip(df, length=length, k=k, **more).select("doc_id", "n_bytes", "kept", "spans").collect()
    return sorted([(r[0], r[1], bytes(r[2]), [list(x) for x in r[3]]) for r in got], key=str)


def corpus(seed, n):
    r = random.Random(seed)
    letters = "abcdefgh éß\n"
    make = lambda m: "".join(r.choice(letters) for _ in range(m))
    passages = [make(r.randrange(20, 120)) for _ in range(6)]
    rows = []
    for i in range(n):
        t = make(r.randrange(0, 150))
        for _ in range(r.randrange(3)):
            at = r.randrange(len(t) + 1)
            t = t[:at] + r.choice(passages) + t[at:]
        if rows and r.random() < 0.3:
            t = r.choice(rows)[1]
            if r.random() < 0.7 and t:
                at = r.randrange(len(t))
                t = t[:at] + "X" + t[at + 1 :]
        rows.append((i, t))
    return rows


def test_against_brute_force(spark):
    rows = corpus(1, 60)
    for k in (8, 16):
        assert run(spark, rows, 40, k) == brute(rows, 40)


def test_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, "a" * 500), (4, "ab" * 300), (5, "short"), (5, "short"), (None, "z" * 39), (None, "ab" * 25), (6, "é" * 30), (7, "xé" * 40), (7, "xé" * 40), (8, "q" + "é" * 19 + "w")]
    assert run(spark, rows, 40, 12) == brute(rows, 40)
    assert run(spark, [], 40, 12) == []
    apart = [(1, "".join(chr(97 + i * i % 23) for i in range(90))), (2, "k" * 10)]
    assert run(spark, apart, 40, 12) == brute(apart, 40)


def test_crowded_anchors_are_counted_by_strings(spark):
    shared = "".join(random.Random(8).choice("abcdefgh ") for _ in range(70))
    rows = [(i, "".join(random.Random(i).choice("uvwxyz") for _ in range(50)) + shared + "".join(random.Random(-i).choice("UVWXYZ") for _ in range(60))) for i in range(1, 40)] + corpus(3, 30)
    rows += [(200, shared[8:] + "end"), (201, "go" + shared[:60]), (202, shared[:52])]
    want = brute(rows, 40)
    assert run(spark, rows, 40, 12, hot=2) == run(spark, rows, 40, 12) == want and any(r[3] for r in want)


def test_periodic_texts(spark):
    """Stretches without any but their own repeats, at their ends, and in parts of a text."""
    r = random.Random(3)
    noise = lambda n: "".join(r.choice("bcdefgh") for _ in range(n))
    rows = [(1, noise(60) + "a" * 3000 + noise(60)), (2, "xy" * 30 + noise(30)), (3, "a" * 45), (4, noise(20) + "xyz" * 400), (5, "yzx" * 20), (6, "q" * 41)]
    assert run(spark, rows, 40, 16) == brute(rows, 40)
    text = (noise(100) + " " * 5000 + noise(100)).encode()
    data = np.frombuffer(text, np.uint8)
    places = S.anchors(np.zeros(2000, np.uint64) + 7, 25)
    left, stretches = S.thinned(places, np.full(2000, 7, np.uint64), 40, 16)
    assert len(places) == 2000 and stretches == [(0, 2015)] and len(left) < 170
    parts = list(S._parts(len(data), 16, 24, 40, 500))
    assert [p[2] for p in parts[1:]] == [p[3] for p in parts[:-1]] and parts[-1][3] == len(data) - 15


def test_a_text_in_parts_is_like_whole(spark):
    rows = corpus(6, 30) + [(100, "".join(t for _, t in corpus(7, 40)))]
    df = spark.createDataFrame([(str(i).encode(), t.encode(), t) for i, t in rows], "id binary, node binary, text string")
    found = [sorted(map(tuple, df.mapInArrow(lambda it, n=n: S._find(it, 40, 40, 16, n), S.FOUND_SCHEMA).where("until IS NULL").collect()), key=str) for n in (1 << 20, 97)]
    assert found[0] == found[1]


def test_passages(spark):
    """Runs of enough words go whole, without the words at their ends that they only cut."""
    r = random.Random(5)
    words = lambda n: " ".join("".join(r.choice("abcdefghijkl") for _ in range(r.randrange(2, 6))) for _ in range(n))
    fifty, forty = words(51), words(40)
    own = [words(30) for _ in range(8)]
    rows = [(1, f"{own[0]} {fifty} {own[1]}"), (2, f"{own[2]}. {fifty}, {own[3]}"), (3, f"{own[4]} {forty} {own[5]}"), (4, f"{own[6]} {forty} {own[7]}"), (5, fifty), (6, None), (7, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert len(fifty) < 300
    got = {x.doc_id: x for x in S.strip(df, passage=(150, 50)).collect()}
    assert [got[i].clean_text for i in range(1, 8)] == [f"{own[0]}  {own[1]}", f"{own[2]}.  {fifty.split()[-1]}, {own[3]}", None, None, "", None, None]
    assert got[1].passages == [[len(own[0]) + 1, len(own[0]) + 1 + len(fifty)]] and all(not x.spans for x in got.values())
    same = {x.doc_id: x.clean_text for x in S.strip(df, length=150, passage=(150, 50)).collect()}
    assert same == {i: x.clean_text for i, x in got.items()}


def put_columns(texts):
    rounds = S.Rounds(*texts.shape)
    rounds.put(0, texts[:20])
    rounds.put(20, texts[20:])
    return rounds


def test_columns_against_pairs():
    r = np.random.default_rng(2)
    base = r.integers(97, 100, 30)
    texts = np.where(r.random((50, 30)) < 0.06, r.integers(97, 100, (50, 30)), base).astype(np.uint8)
    rounds = put_columns(texts)
    found = S.repeated_columns(rounds, (12, 5), 19)
    for c in range(19):
        for level, n in enumerate((12, 5)):
            seen = Counter(bytes(t[c : c + n]) for t in texts)
            assert [bool(x) for x in found[level, c]] == [seen[bytes(t[c : c + n])] > 1 for t in texts]
    # The transform on file is, column by column, the symbols in the order of what follows them.
    rounds.transform.seek(0)
    for c in range(29, -1, -1):
        order = sorted(range(50), key=lambda i: (bytes(texts[i, c + 1 :]), i))
        assert np.frombuffer(rounds.transform.read(50), np.uint8).tolist() == [texts[i, c] for i in order]
    rounds.close()


def test_copies_beside_near_copies_in_any_order(spark):
    """Of equal texts a task searches one; others' strings are found through it, whichever row that is."""
    r = random.Random(11)
    text = "".join(r.choice("abcdefgh") for _ in range(300))
    near = text[:140] + "X" + text[141:]
    for order in ([3, 1, 2], [1, 2, 3], [2, 3, 1]):
        rows = [(i, text) for i in order] + [(9, near), (8, "z" * 20)]
        for rows in (rows, rows[::-1]):
            df = spark.createDataFrame(rows, "doc_id long, text string")
            for n in (1, 3):
                for passage in (None, (30, 5)):
                    got = S.strip(df.repartition(n), length=40, k=12, passage=passage).select("doc_id", "n_bytes", "kept", "spans").collect()
                    assert sorted([(x[0], x[1], bytes(x[2]), [list(s) for s in x[3]]) for x in got], key=str) == brute(rows, 40)


def test_spans_beside_passages(spark):
    """Repeats of the passages' length are no spans of the longer one, also where a text's end cuts them."""
    r = random.Random(12)
    make = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    end, mid = make(34), make(39)
    rows = [(1, make(50) + end), (2, make(70) + end), (3, make(30) + mid + make(30)), (4, make(45) + mid + make(50)), (5, end), (6, mid + end), *((i + 10, t) for i, t in corpus(13, 40))]
    for n in (1, 5):
        got = run(spark, rows, 40, 12, passage=(30, 5)) if n == 1 else S.strip(spark.createDataFrame(rows, "doc_id long, text string").repartition(n), length=40, k=12, passage=(30, 5)).select("doc_id", "n_bytes", "kept", "spans").collect()
        assert sorted([(x[0], x[1], bytes(x[2]), [list(s) for s in x[3]]) for x in got], key=str) == brute(rows, 40)


def test_clashing_names(spark):
    extra = ["__id", "__m", "row", "mark", "twice", "runs", "maybe", "cell", "word", "bits", "id", "node"]
    df = spark.createDataFrame([(i, "ab" * 300, *range(len(extra))) for i in range(2)], ", ".join(["doc_id long", "text string", *(f"`{c}` int" for c in extra)]))
    out = S.strip(df, passage=(240, 50))
    assert out.columns == [*df.columns, *S.STRIPPED] and [tuple(r[c] for c in extra) for r in out.collect()] == [tuple(range(len(extra)))] * 2


def test_query(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    want = [(k, n, n - len(kept), len(spans), hashlib.sha256(kept).hexdigest()) for k, n, kept, spans in brute(rows, 400)]
    got = S.query(spark, "/root/testdata/sf0.001").select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted((tuple(r) for r in got), key=str) == want
