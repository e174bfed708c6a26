import random
import re

import numpy as np

from countweave.llm import jaccard_join as J

SCHEMA = "doc_id long, text string, n_shingles string, node string"


def grams(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    sets = [(k, grams(t)) for k, t in rows]
    parent = {k: k for k, _ in sets if k is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if a is not None and b is not None and x and y and 100 * len(x & y) >= 80 * len(x | y):
                p, q = sorted((find(a), find(b)))
                parent[q] = p
    return sorted(((k, len(s), find(k) if k is not None else None) for k, s in sets), key=str)


def corpus(seed, n):
    r = random.Random(seed)
    vocab = ["w%d" % i for i in range(300)]
    texts = [[r.choice(vocab) for _ in range(r.choice([3, 6, 20, 60, 120]))] for _ in range(n)]
    common = [r.choice(vocab) for _ in range(40)]
    rows = []
    for i in range(n * 4):
        t = list(r.choice(texts))
        for _ in range(r.randrange(4)):
            t[r.randrange(len(t))] = r.choice(vocab)
        if r.random() < 0.3:
            t = t + common
        rows.append((i * 3, " ".join(t) if r.random() < 0.5 else " ".join(t).upper()))
    return rows


def run(spark, rows, **kw):
    df = spark.createDataFrame([(k, t, "x", "y") for k, t in rows], SCHEMA)
    return sorted([tuple(x) for x in J.join(df, **kw).collect()], key=str)


def test_against_brute_force(spark):
    rows = corpus(3, 40)
    assert run(spark, rows) == brute(rows)
    assert run(spark, rows, block=300) == brute(rows)


def test_edge_cases(spark):
    long = " ".join("v%d" % (i * 7919 % 5003) for i in range(30_000))
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "a b"), (5, "A  B\n"), (6, "a b c d e"), (7, long), (8, long + " end"), (None, "a b"), (9, "x y z u v w"), (9, "a b"), (6, "a b c d e")]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []


def test_trie_finds_what_a_scan_finds():
    r = np.random.default_rng(5)
    base = r.integers(0, 400, 60)
    sets = list({tuple(np.unique(np.where(r.random(60) < 0.08, r.integers(0, 400, 60), base))) for _ in range(80)})
    seqs = [np.array(s) for s in sets]
    trie = J.Trie(seqs)
    for q in range(len(sets)):
        want = {i for i, s in enumerate(sets) if 100 * len(set(s) & set(sets[q])) >= 80 * len(set(s) | set(sets[q]))}
        assert set(trie.similar(seqs[q], (80, 100)).tolist()) == want


def test_words_of_two_letters_do_not_collide(spark):
    """Thue and Morse's words, equal under every odd base modulo 2**64."""
    a, b = "0", "1"
    for _ in range(11):
        a, b = a + b, b + a
    table = str.maketrans("01", "xy")
    a, b = a.translate(table), b.translate(table)
    df = spark.createDataFrame([(1, f"{a} one two"), (2, f"{b} one two")], "doc_id long, text string")
    assert sorted(r.component_id for r in J.join(df).collect()) == [1, 2]


def test_keys_that_collide_are_salted(spark, monkeypatch):
    rows = [(i, f"w{i} a b c d e{i}") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(J, "SALTS", 0)
    try:
        J.join(df)
        raise AssertionError
    except ValueError as e:
        assert "salts" in str(e)
