"""Importance resampling towards a target distribution of hashed n-grams, with Gumbel noise that only the key decides.

One scan of a text keeps a ring of running CRC-32 states, one for each of the last n words as a start. The next word
extends every state by a space and its own bytes, and each state is then the checksum of one more run of words, so no
run is ever put together. What a scan emits, buckets by text, is written once: counts by bucket and the weights of
texts come from that table.

The highest scores are ranked by a range sort of the whole corpus: a row's rank is its place in its partition and the
number of rows in those before it.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, cut, fresh, small_batches, tidied, utf8, without

BUCKETS, RUNS = 10_000, 2
SEED, LEAST_WORDS, PERCENT = 7, 20, 25
#: Bytes of a text that are cut into words at a time.
BLOCK = 1 << 20
#: Bytes below 0x80 of words; all above belong to words too.
INSIDE = [*range(0x30, 0x3A), *range(0x61, 0x7B)]
_CLEAN = np.full(256, 0x20, np.uint8)
_CLEAN[INSIDE] = INSIDE
_CLEAN[0x80:] = np.arange(0x80, 0x100)
_CLEAN = _CLEAN[LOWER]


class Ring:
    """CRC-32 states of the runs that end at the last word, the shortest first."""

    def __init__(self, n: int):
        self.n, self.states = n, []

    def push(self, word: bytes) -> list[int]:
        spaced = b" " + word
        self.states = [zlib.crc32(word), *[zlib.crc32(spaced, s) for s in self.states[: self.n - 1]]]
        return self.states


def _blocks(clean: bytes, most: int) -> Iterator[bytes]:
    """clean cut at spaces in blocks of about `most` bytes."""
    at = 0
    while at < len(clean):
        end = clean.find(b" ", at + most)
        end = len(clean) if end < 0 else end
        yield clean[at:end]
        at = end


def scan(clean: bytes, n: int, buckets: int, block: int = BLOCK) -> tuple[int, np.ndarray]:
    """(number of words, bucket of each run of 1 to n words) of a text whose other bytes are spaces already."""
    ring, words, out = Ring(n), 0, [np.zeros(0, np.uint32)]
    for part in _blocks(clean, block):
        states = array("I")
        own = part.split()
        for word in own:
            states.extend(ring.push(word))
        words += len(own)
        out.append(np.frombuffer(states, np.uint32) % np.uint32(buckets) if states else out[0])
    return words, np.concatenate(out)


@tidied
def _scan(batches: Iterator[pa.RecordBatch], text: str, n: int, buckets: int, names: list[str], made_names: list[str]) -> Iterator[pa.RecordBatch]:
    """The rows without their text, or with it, and the row's own number, n_words and the buckets as little-endian numbers."""
    kind = "<u2" if buckets <= 1 << 16 else "<u4"
    row = TaskContext.get().partitionId() << 40
    for batch in batches:
        for part in (batch.slice(i, 1000) for i in range(0, batch.num_rows, 1000)):
            buf, at = utf8(part.column(part.schema.names.index(text)))
            clean = _CLEAN[buf]
            found = [scan(clean[at[d] : at[d + 1]].tobytes(), n, buckets) for d in range(part.num_rows)]
            kept = [c for name, c in zip(part.schema.names, part.columns, strict=True) if name in names]
            made = [pa.array(np.arange(row, row + part.num_rows)), pa.array([w for w, _ in found], pa.int64()), pa.array([b.astype(kind).tobytes() for _, b in found], pa.binary())]
            row += part.num_rows
            yield pa.RecordBatch.from_arrays([*kept, *made], [*names, *made_names])


def _numbers(column: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    buf, at = utf8(column)
    wide = 2 if buckets <= 1 << 16 else 4
    return np.frombuffer(buf.tobytes(), f"<u{wide}"), at // wide


@tidied
def _count(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """(bucket, n) of all of a task's texts."""
    total = np.zeros(buckets, np.int64)
    for batch in batches:
        total += np.bincount(_numbers(batch.column(0), buckets)[0], minlength=buckets)
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])


@tidied
def _weigh(batches: Iterator[pa.RecordBatch], buckets: int, gains: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The rows with n_features and weight in place of their buckets, which come last."""
    for batch in batches:
        numbers, at = _numbers(batch.column(batch.num_columns - 1), buckets)
        sums = np.r_[0, np.cumsum(gains[numbers])]
        n = np.diff(at)
        weight = (sums[at[1:]] - sums[at[:-1]]) // np.maximum(n, 1)
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(n), pa.array(weight)], [*batch.schema.names[:-1], "n_features", "weight"])


def features(df: DataFrame, text: str = "text", runs: int = RUNS, buckets: int = BUCKETS, keep_text: bool = True, names: tuple[str, str, str] = ("row", "n_words", "buckets")) -> DataFrame:
    """A written table of df's rows and, under these names, the row's own number, how many words, and the bucket of each run of words."""
    small_batches(df.sparkSession)
    kept = [f for f in df.schema if keep_text or f.name != text]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), f"`{names[0]}` long, `{names[1]}` long, `{names[2]}` binary"])
    own = [f.name for f in kept]
    return cut(df.mapInArrow(lambda it: _scan(it, text, runs, buckets, own, list(names)), schema), "buckets")


def counts(table: DataFrame, buckets: int = BUCKETS, column: str = "buckets") -> DataFrame:
    """(bucket, n) over a table of `features`; tasks add up first, so at most `buckets` rows leave each."""
    own = table.select(f"`{column}`").mapInArrow(lambda it: _count(it, buckets), "bucket long, n long")
    return own.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain): 1000 times the logarithm, rounded down, of the bucket's smoothed share in target over that in source, both from `counts`; for every bucket."""
    every = target.sparkSession.range(buckets).withColumnRenamed("id", "bucket")
    both = every.join(source.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left").fillna(0)
    all_s, all_t = both.agg(F.sum("s"), F.sum("t")).first()
    real = lambda c: c.cast("double")
    ratio = real(F.col("t") + 1) * real(F.lit(all_s + buckets)) / (real(F.col("s") + 1) * real(F.lit(all_t + buckets)))
    return both.select("bucket", F.floor(1000 * F.log(ratio)).alias("gain"))


def resample(
    df: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text", runs: int = RUNS, buckets: int = BUCKETS, least: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED, keep_text: bool = True
) -> DataFrame:
    """df with n_words, n_features (runs of 1 to `runs` words), weight (mean gain of the text's features, rounded down; 0 without any), score (weight and noise of the key) and rank (1, 2 .. among those drawn, else null).

    Drawn are `percent` of a hundred, rounded down, of the rows with at least `least` words, those of highest scores;
    ties go to the smaller key, a null key last, and equal rows in any order. Texts are whole; null is empty. Null keys
    have the noise of an empty key, repeated keys the same. Input columns named like an output are replaced. Without any
    target text each bucket's share in it is the same. An empty df gives no rows. keep_text: whether text stays.
    """
    df = without(df, [x for x in ("n_words", "n_features", "weight", "score", "rank") if x not in (key, text)])
    row, own, at, part, before = fresh([*df.columns, "n_words", "n_features", "weight", "score", "rank"], "row", "buckets", "at", "part", "before")
    table = features(df, text, runs, buckets, keep_text, (row, "n_words", own))
    aimed = features(target.select(F.col(target_text).alias("text")), "text", runs, buckets, keep_text=False)
    by_bucket = np.zeros(buckets, np.int64)
    for bucket, gain in gains(counts(table, buckets, own), counts(aimed, buckets), buckets).collect():  # one row a bucket
        by_bucket[bucket] = gain
    schema = [f"`{f.name}` {f.dataType.simpleString()}" for f in table.schema if f.name != own]
    weighed = table.mapInArrow(lambda it: _weigh(it, buckets, by_bucket), ", ".join([*schema, "n_features long, weight long"]))
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{key}`").cast("string"), F.lit(""))), 256), 1, 8)
    noise = F.floor(-1000 * F.log(-F.log((F.conv(digits, 16, 10).cast("double") + 0.5) / 4294967296)))
    scored = weighed.withColumn("score", (F.col("weight") + noise).cast("long"))
    fit = F.col("n_words") >= least
    order = [F.col("score").desc(), F.col(f"`{key}`").asc_nulls_last(), F.col(row)]
    ordered = cut(scored.where(fit).orderBy(*order).withColumn(at, F.monotonically_increasing_id()), "ordered")
    sizes = ordered.groupBy(F.shiftright(at, 33).alias("part")).count().orderBy("part").collect()  # one row a partition
    starts, total = [], 0
    for number, n in sizes:
        starts.append((number, total))
        total += n
    first = df.sparkSession.createDataFrame(starts, f"{part} long, {before} long")
    rank = F.col(before) + F.col(at).bitwiseAND((1 << 33) - 1) + 1
    ranked = ordered.join(F.broadcast(first), F.shiftright(at, 33) == F.col(part)).withColumn("rank", F.when(rank <= percent * total // 100, rank))
    return ranked.drop(at, part, before).unionByName(scored.where(~fit).withColumn("rank", F.lit(None).cast("long"))).drop(row)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    target = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("text")
    return resample(docs, target, keep_text=False).select("doc_id", "n_features", "weight", "score", "rank")


_W = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The checksum's table is made by its rule, one entry a byte, and a feature's checksum by a fold over its bytes.
SQL = f"""
WITH crc AS (
  SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END)) ORDER BY i) AS t
  FROM (SELECT unnest(range(256)) AS i)
), d AS (
  SELECT 's' AS side, row_number() OVER () AS r, doc_id, text FROM documents
  UNION ALL SELECT 't', row_number() OVER (), NULL, text FROM benchmark
), w AS (
  SELECT side, r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_W}') AS words FROM d
), f AS (
  SELECT side, r, unnest(list_concat(words, list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]))) AS feature FROM w
), own AS (
  SELECT side, r, feature, count(*) AS n FROM f GROUP BY ALL
), hashed AS (
  SELECT feature, xor(list_reduce(list_concat([4294967295], list_transform(range(len(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)),
         lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % {BUCKETS} AS bucket
  FROM (SELECT DISTINCT feature, hex(encode(feature)) AS h FROM own), crc
), byb AS (
  SELECT bucket, coalesce(sum(n) FILTER (side = 's'), 0) AS s, coalesce(sum(n) FILTER (side = 't'), 0) AS t FROM own JOIN hashed USING (feature) GROUP BY bucket
), gain AS (
  SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (sum(s) OVER () + {BUCKETS})::DOUBLE / ((s + 1)::DOUBLE * (sum(t) OVER () + {BUCKETS})::DOUBLE)))::BIGINT AS gain FROM byb
), weights AS (
  SELECT r, sum(n)::BIGINT AS n_features, floor(sum(n * gain) / sum(n))::BIGINT AS weight FROM own JOIN hashed USING (feature) JOIN gain USING (bucket) WHERE side = 's' GROUP BY r
), scored AS (
  SELECT doc_id, len(words) AS n_words, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
         coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM w LEFT JOIN weights USING (r) WHERE side = 's'
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY n_words >= {LEAST_WORDS} ORDER BY score DESC, doc_id NULLS LAST) AS place, count(*) OVER (PARTITION BY n_words >= {LEAST_WORDS}) AS fit FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= {LEAST_WORDS} AND place <= {PERCENT} * fit // 100 THEN place END::BIGINT AS rank FROM placed
"""
