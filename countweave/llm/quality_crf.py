"""Document quality by a linear-chain conditional random field over lines.

Every line is good or bad. A line's features are shares of kinds of characters, repeated words, whether an earlier line
is equal, and the same of the lines around it. Lines have no labels of their own: a document's is good with the
probability logistic(a * (share - b)) of the share of its bytes in good lines, the mean of its lines' forward-backward
marginals. Training first gives each line its document's label, only as a start, and then maximizes the likelihood of
the documents' labels with the lines latent, a and b included, lines being good where nothing speaks against it; so a good document may hold bad lines, and a bad one
good lines. The document's score is that probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, Poly, small_batches, steps, tidied, utf8, WHITE, without, words

#: Labelled documents to fit on (those of the smallest hashes), and lines of each (in a row, from a place given by the hash).
SAMPLE, LINES = 4000, 128
#: The fitting: weight of the penalty, rounds with the documents' labels on their lines and with latent lines, and their steps.
PENALTY, SEEDED, LATENT, RATES = 1e-3, 60, 220, (0.1, 0.05)
#: a and b at the start, and their bounds.
LINK, LINK_LOW, LINK_HIGH = (8.0, 0.6), (4.0, 0.2), (40.0, 0.9)
#: Weight of the mean share: lines that no document's label speaks against are good.
PRIOR = 0.3
#: Step of the central difference that gives the marginals' slopes.
STEP = 1e-4
FOLDS, HELD_OUT, CUT = 5, 0, 0.3


def _kind(chars: str | range) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in chars] if isinstance(chars, str) else list(chars)] = True
    return out


KINDS = [_kind(range(65, 91)), _kind(range(97, 123)), _kind(range(48, 58)), _kind("#*$%&<>|~^=+_@\\{}[]"), _kind("!?"), _kind("|"), _kind(range(128, 256))]


def lines(buf: np.ndarray, at: np.ndarray, poly: Poly) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, bytes, offsets by text) of the \\n-split lines of whole texts; an empty text is one empty line."""
    newline = np.flatnonzero(buf == 10)
    start, end = np.sort(np.r_[at[:-1], newline + 1]), np.sort(np.r_[newline, at[1:]])
    of = np.r_[0, np.cumsum(np.diff(np.searchsorted(newline, at)) + 1)]
    size = (end - start).astype(np.float64)
    count = lambda flags: np.diff(np.r_[0, np.cumsum(flags)][np.stack([start, end])], axis=0)[0].astype(np.float64)
    upper, lower, digit, symbol, shout, pipe, beyond = (count(k[buf]) for k in KINDS)
    visible = count(~WHITE[buf])
    with np.errstate(over="ignore"):
        begin, stop, _ = words(buf, at)
        sums = poly.sums(buf)
        hashes = poly.pieces(sums, begin, stop)
        first, last = np.searchsorted(begin, start), np.searchsorted(begin, end)
        n = (last - first).astype(np.float64)
        again = np.r_[0, np.cumsum(np.r_[False, hashes[1:] == hashes[:-1]])] if len(hashes) else np.zeros(1, np.int64)
        stutter = np.maximum(again[np.maximum(last, 1) if len(hashes) else last] - again[np.minimum(first + 1, len(hashes))], 0) * (n > 1)
        text_of = np.repeat(np.arange(len(of) - 1), np.diff(of))
        key = mix(poly.pieces(sums, start, end) ^ mix((text_of + 1).astype(np.uint64)))
    order = np.argsort(key, kind="stable")
    twin = np.zeros(len(start))
    twin[order[1:]] = key[order][1:] == key[order][:-1]
    twin *= n > 0
    share = lambda x, y: x / np.maximum(y, 1)
    own = np.stack([share(symbol, n).clip(0, 4), share(shout, n).clip(0, 3), share(pipe, n).clip(0, 2), share(upper, upper + lower), share(stutter, n), twin], 1)
    more = np.stack([np.log1p(n), share(digit, visible), share(beyond, visible), share(visible, n).clip(0, 30) / 10, n == 0], 1)
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    alone_left, alone_right = np.zeros(len(own), bool), np.zeros(len(own), bool)
    alone_left[of[:-1]], alone_right[of[1:] - 1] = True, True
    before[alone_left], after[alone_right] = 0, 0
    return np.concatenate([own, more, before, after, np.stack([alone_left, alone_right, np.ones(len(own))], 1)], 1), size, of


@dataclass(frozen=True)
class Model:
    scale: np.ndarray  #: of each feature
    weights: np.ndarray  #: of a good line against a bad one
    moves: np.ndarray  #: from bad, good to bad, good
    link: tuple[float, float]  #: a and b


def marginals(emit: np.ndarray, of: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(probability that each line is good, expected moves, log partition of each chain), for good lines' scores `emit` (bad ones have 0).

    All chains go on together, longest first.
    """
    n = np.diff(of)
    order = np.argsort(-n, kind="stable")
    first, n = of[:-1][order], n[order]
    longest = int(n.max(initial=0))
    active = np.searchsorted(-n, -np.arange(longest), "left")  # chains that have a line t
    forward, norm = np.zeros((len(emit), 2)), np.zeros(len(emit))
    step = np.exp(moves - moves.max())
    high = np.maximum(emit, 0)
    e = np.exp(np.stack([-high, emit - high], 1))
    for t in range(longest):
        at = first[: active[t]] + t
        x = e[at] if t == 0 else (forward[at - 1] @ step) * e[at]
        norm[at] = x.sum(1)
        forward[at] = x / norm[at][:, None]
    backward = np.ones((len(emit), 2))
    pairs = np.zeros((2, 2))
    for t in range(longest - 1, 0, -1):
        at = first[: active[t]] + t
        y = backward[at] * e[at] / norm[at][:, None]
        pairs += np.einsum("ni,ij,nj->ij", forward[at - 1], step, y)
        backward[at - 1] = y @ step.T
    good = forward[:, 1] * backward[:, 1]
    logs = np.add.reduceat(np.log(norm) + high, of[:-1]) + (np.diff(of) - 1) * moves.max() if len(of) > 1 else np.zeros(0)
    return good.clip(0, 1), pairs, logs


def shares(good: np.ndarray, size: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(share of each text's bytes in good lines, each line's weight in it); in a text without bytes all lines weigh alike."""
    weight = np.where(np.repeat(np.add.reduceat(size, of[:-1]), np.diff(of)) > 0, size, 1.0)
    weight = weight / np.repeat(np.add.reduceat(weight, of[:-1]), np.diff(of))
    return np.add.reduceat(good * weight, of[:-1]), weight


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def likelihood(theta: np.ndarray, link: np.ndarray, x: np.ndarray, size: np.ndarray, of: np.ndarray, labels: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """(mean log likelihood of the texts' labels with latent lines, and PRIOR of the mean share; its slope in the weights and moves, in a and b).

    The slope of a weighted sum of marginals is how the expected features change along those weights, so two more
    passes of forward-backward, a small step to both sides, give it for all lines at once.
    """
    emit, moves = x @ theta[:-4], theta[-4:].reshape(2, 2)
    share, weight = shares(marginals(emit, of, moves)[0], size, of)
    p = logistic(link[0] * (share - link[1]))
    off = labels - p
    along = STEP * np.repeat(off * link[0] + PRIOR, np.diff(of)) * weight
    (up, up_pairs, _), (down, down_pairs, _) = marginals(emit + along, of, moves), marginals(emit - along, of, moves)
    slope = np.r_[x.T @ (up - down), (up_pairs - down_pairs).ravel()] / (2 * STEP * len(labels))
    value = float(np.log(np.where(labels > 0, p, 1 - p).clip(1e-300)).mean() + PRIOR * share.mean())
    return value, slope, np.array([(off * (share - link[1])).mean(), -link[0] * off.mean()])


def fit(features: np.ndarray, size: np.ndarray, of: np.ndarray, labels: np.ndarray) -> Model:
    """Maximum penalized likelihood by Adam's steps: first with each text's label on its lines, then with latent lines."""
    scale = np.maximum(features.std(0), 0.05)
    scale[-1] = 1
    x, labels = features / scale, labels.astype(np.float64)
    y, theta, link = np.repeat(labels, np.diff(of)), np.zeros(x.shape[1] + 4), np.array(LINK)
    stay = np.diff(of) - 1
    seen = np.array([[stay[labels == 0].sum(), 0], [0, stay[labels == 1].sum()]], np.float64)
    for latent, rounds, rate in zip((False, True), (SEEDED, LATENT), RATES, strict=True):
        m, v = 0.0, 0.0
        theta[-4:] *= not latent  # moves between lines of one label say nothing yet
        for i in range(1, rounds + 1):
            if not latent:
                good, pairs, _ = marginals(x @ theta[:-4], of, theta[-4:].reshape(2, 2))
                slope, of_link = np.r_[x.T @ (y - good), (seen - pairs).ravel()] / len(labels), np.zeros(2)
            else:
                _, slope, of_link = likelihood(theta, link, x, size, of, labels)
            slope = np.r_[slope - PENALTY * theta, of_link]
            m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope**2
            step = rate * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.99**i)) + 1e-8)
            theta, link = theta + step[:-2], np.clip(link + step[-2:], LINK_LOW, LINK_HIGH)
    return Model(scale, theta[:-4], theta[-4:].reshape(2, 2), (float(link[0]), float(link[1])))


@tidied
def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(label, features, size) of LINES lines at most of each of the rows (text, label, hash)."""
    poly = Poly(11)
    for batch in batches:
        buf, at = utf8(batch.column(0))
        hashes = batch.column(2).to_pylist()
        for i, j, part, off in steps(buf, at):
            x, size, of = lines(part, off, poly)
            rows = []
            for d in range(j - i):
                first = int(of[d]) + hashes[i + d] % max(1, int(of[d + 1] - of[d]) - LINES + 1)
                s = slice(first, min(first + LINES, int(of[d + 1])))
                rows.append((x[s].astype(np.float32).tobytes(), size[s].astype(np.float32).tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column(1).slice(i, j - i), *(pa.array([r[c] for r in rows], pa.binary()) for c in (0, 1))], ["label", "features", "size"])


def train(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE) -> Model:
    """A model fitted on at most `sample` of the labelled documents of df, those of the smallest hashes of their keys, and on at most LINES lines of each.

    Rows without a key or a label do not count, nor do those held out (see `held_out`). Without a labelled document
    every score is 1/2.
    """
    chosen = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull() & ~held_out(key)).select(F.col(key).alias("k"), F.col(label).cast("int").alias("label"))
    chosen = chosen.orderBy(F.xxhash64("k"), "k", "label").limit(sample)
    got = df.select(F.col(key).alias("k"), F.col(text).alias("text")).join(F.broadcast(chosen), "k").select("text", "label", F.xxhash64("k").alias("hash")).mapInArrow(_features, "label int, features binary, size binary")
    rows = sorted((r["label"], bytes(r["features"]), bytes(r["size"])) for r in got.orderBy(F.xxhash64("features")).limit(2 * sample).collect())  # twice: keys may repeat
    width = lines(np.zeros(0, np.uint8), np.zeros(2, np.int64), Poly(11))[0].shape[1]
    if not rows:
        return Model(np.ones(width), np.zeros(width), np.zeros((2, 2)), (LINK[0], 0.5))
    each = [np.frombuffer(x, np.float32).reshape(-1, width) for _, x, _ in rows]
    size = np.concatenate([np.frombuffer(z, np.float32) for _, _, z in rows]).astype(np.float64)
    return fit(np.concatenate(each).astype(np.float64), size, np.r_[0, np.cumsum([len(x) for x in each])], np.array([y for y, _, _ in rows]))


def held_out(key: str):
    """Whether the row is in the fold that training never sees: by CRC-32 of its key as text."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


@tidied
def _score(batches: Iterator[pa.RecordBatch], text: str, model: Model) -> Iterator[pa.RecordBatch]:
    poly = Poly(11)
    for batch in batches:
        buf, at = utf8(batch.column(batch.schema.names.index(text)))
        scores, goods = np.zeros(batch.num_rows), []
        for i, j, part, off in steps(buf, at):
            x, size, of = lines(part, off, poly)
            good, _, _ = marginals((x / model.scale) @ model.weights, of, model.moves)
            scores[i:j] = logistic(model.link[0] * (shares(good, size, of)[0] - model.link[1]))
            goods += [good[of[d] : of[d + 1]] for d in range(j - i)]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores.clip(0, 1)), pa.array(goods, pa.list_(pa.float64()))], [*batch.schema.names, "score", "lines_good"])


def score(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """df with lines_good (of each \\n-split line, the probability that it is good) and score (the probability that the document is good, by the share of its bytes in good lines).

    A null text is empty: one empty line. Rows are scored one by one, by their whole text alone; input columns named
    like an output are replaced. An empty table gives no rows.
    """
    df = without(df, ["score", "lines_good"])
    small_batches(df.sparkSession)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema]
    return df.mapInArrow(lambda it: _score(it, text, model), ", ".join([*fields, "score double, lines_good array<double>"]))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
