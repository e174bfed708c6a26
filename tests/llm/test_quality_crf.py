import itertools
import random
import zlib

import numpy as np

from countweave.llm import quality_crf as Q
from countweave.llm.common import Poly


def test_marginals_against_all_labelings():
    r = np.random.default_rng(4)
    of, moves = np.array([0, 3, 4, 8]), r.standard_normal((2, 2))
    emit = r.standard_normal(8)
    good, pairs, logs = Q.marginals(emit, of, moves)
    want_pairs = np.zeros((2, 2))
    for c in range(3):
        e = emit[of[c] : of[c + 1]]
        total, sums, moved = 0.0, np.zeros(len(e)), np.zeros((2, 2))
        for y in itertools.product((0, 1), repeat=len(e)):
            w = np.exp(sum(e[i] for i in range(len(e)) if y[i]) + sum(moves[a, b] for a, b in itertools.pairwise(y)))
            total += w
            sums += w * np.array(y)
            for a, b in itertools.pairwise(y):
                moved[a, b] += w
        assert np.allclose(good[of[c] : of[c + 1]], sums / total) and np.isclose(logs[c], np.log(total))
        want_pairs += moved / total
    assert np.allclose(pairs, want_pairs)


def test_lines():
    texts = [b"", b"a\n", b"AB cd\n\nx x x\nx x x", b"\n"]
    buf, at = np.frombuffer(b"".join(texts), np.uint8), np.r_[0, np.cumsum([len(t) for t in texts])]
    x, size, of = Q.lines(buf, at, Poly(11))
    assert np.diff(of).tolist() == [1, 2, 4, 2] and size.tolist() == [0, 1, 0, 5, 0, 5, 5, 0, 0]
    third = x[of[2] : of[3]]
    assert third[:, 3].tolist() == [0.5, 0, 0, 0] and np.allclose(third[:, 4], [0, 0, 2 / 3, 2 / 3]) and third[:, 5].tolist() == [0, 0, 0, 1]


def documents(n, seed):
    r = random.Random(seed)
    words = ["stone", "river", "over", "the", "and", "walk", "light"]
    rows, labels = [], []
    for i in range(n):
        bad = i % 4 == 0
        lines = []
        for _ in range(r.randrange(1, 6)):
            w = [r.choice(words) for _ in range(12)]
            lines.append(" ".join(x + r.choice(["###", "&&&"]) if bad else x for x in w) + ".")
        rows.append((i, "\n".join(lines), "x", 1.0))
        labels.append((i, 0 if bad else 1, 0))
    return rows, labels


SCHEMA = "doc_id long, text string, lines_good string, score double"


def test_slopes_against_differences():
    r = np.random.default_rng(7)
    of, size = np.array([0, 3, 4, 9]), r.integers(0, 20, 9).astype(float)
    x, labels, theta, link = r.standard_normal((9, 4)), np.array([1.0, 0.0, 1.0]), r.standard_normal(8), np.array([6.0, 0.5])
    _, slope, of_link = Q.likelihood(theta, link, x, size, of, labels)
    for i, want in enumerate(slope):
        step = np.eye(8)[i] * 1e-5
        assert np.isclose((Q.likelihood(theta + step, link, x, size, of, labels)[0] - Q.likelihood(theta - step, link, x, size, of, labels)[0]) / 2e-5, want, atol=1e-6)
    for i, want in enumerate(of_link):
        step = np.eye(2)[i] * 1e-5
        assert np.isclose((Q.likelihood(theta, link + step, x, size, of, labels)[0] - Q.likelihood(theta, link - step, x, size, of, labels)[0]) / 2e-5, want, atol=1e-6)


def test_lines_are_told_apart_within_documents(spark):
    """Good documents hold a bad line, bad ones good lines; only documents have labels."""
    r = random.Random(11)
    words = ["stone", "river", "over", "the", "and", "walk", "light"]
    line = lambda bad: " ".join(r.choice(words) + (r.choice(["###", "&&&"]) if bad else "") for _ in range(12)) + "."
    rows, labels, truth = [], [], {}
    for i in range(300):
        bad = i % 3 == 0
        kinds = [r.random() < 0.65 for _ in range(8)] if bad else [j == i % 8 for j in range(8)]
        truth[i] = kinds
        rows.append((i, "\n".join(map(line, kinds)), "x", 1.0))
        labels.append((i, int(sum(kinds) < 4), 0))
    docs = spark.createDataFrame(rows, SCHEMA)
    model = Q.train(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = Q.score(docs, model).where(Q.held_out("doc_id")).collect()
    marks = {k: y for k, y, _ in labels}
    assert sum((x.score >= 0.3) == bool(marks[x.doc_id]) for x in got) >= 0.95 * len(got)
    lines = [(p, b) for x in got for p, b in zip(x.lines_good, truth[x.doc_id], strict=True)]
    right, as_their_document = sum((p < 0.5) == b for p, b in lines), sum((marks[x.doc_id] == 0) == b for x in got for b in truth[x.doc_id])
    assert right >= 0.83 * len(lines) and right > as_their_document
    assert sum(min(x.lines_good) < 0.5 < max(x.lines_good) for x in got) >= 0.2 * len(got)


def test_held_out_accuracy(spark):
    rows, labels = documents(300, 5)
    odd = [(None, "x", "x", 1.0), (1000, None, "x", 1.0), (1001, "", "x", 1.0), (1001, "", "x", 1.0), (1002, "w " * 60_000, "x", 1.0)]
    docs = spark.createDataFrame(rows + odd, SCHEMA)
    marks = spark.createDataFrame([*labels, (None, 1, 0), (2000, None, 0)], "doc_id long, quality int, toxic int")
    model = Q.train(docs, marks)
    got = Q.score(docs, model).withColumn("held", Q.held_out("doc_id")).collect()
    assert len(got) == len(rows) + len(odd) and all(0 <= r.score <= 1 for r in got)
    truth = {k: y for k, y, _ in labels}
    held = [r for r in got if r.doc_id in truth and r.held]
    assert {r.doc_id for r in held} == {k for k in truth if zlib.crc32(str(k).encode()) % 5 == 0}
    assert sum((r.score >= 0.3) == bool(truth[r.doc_id]) for r in held) >= 0.95 * len(held)


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b", "x", 1.0)], SCHEMA)
    model = Q.train(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert Q.score(docs, model).first().score == 0.5
    assert Q.score(docs.limit(0), model).collect() == []
