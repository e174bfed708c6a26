"""Mixing sources to target weights by Poisson replication.

A source with target share t of all text units is repeated at the rate t * total / its own units. Each document takes
the number of copies at which the Poisson distribution of that mean passes a uniform number hashed from its key and a
seed: the draw needs no state, so retries and other partitionings give the same copies. A rate too high for one draw is
split into equal parts that draw for themselves, as a sum of Poisson numbers is one of the summed rate. Copies are then
dealt in a global random order. Built-in functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh, without

#: Production weights: a source gets the square root of its share, renormalized (up-weights the small sources).
POWER = 0.5
SEED = 17
#: Rates of parts are at most this.
MOST = 500.0
#: Up to this rate there is one part, as in SQL: exp(-rate) is still a normal number.
ONE = 700.0
#: Up to so many sources their rates are sent to every task; beyond, each source is dealt over SALTS tasks.
FEW, SALTS = 1000, 64


def uniform(*key: Column, seed: int) -> Column:
    """A number in [0, 1) with 52 bits out of the key's MD5."""
    text = F.concat_ws(":", F.lit(str(seed)), *(F.coalesce(k.cast("string"), F.lit("")) for k in key))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def source_rates(df: DataFrame, source: str, units: Column, weights: DataFrame | None = None, power: float = POWER) -> DataFrame:
    """(source, rate, parts, cdf): rate = target share * total / own units; cdf = the Poisson distribution of rate / parts up to where it is 1 in double precision.

    weights: (source, weight), weight >= 0; sources without one get 0. Without weights: own share ** power. A null
    source is a source of its own. A source without units gets rate 0.
    """
    own = df.groupBy(F.col(source).alias("src")).agg(F.sum(units.cast("double")).alias("own"))
    if weights is None:
        shares = own.withColumn("w", F.pow(F.col("own"), F.lit(power)))
    else:
        given = weights.select(F.col("source").alias("src_w"), F.col("weight").cast("double").alias("w"))
        shares = own.join(given, F.col("src").eqNullSafe(F.col("src_w")), "left").select("src", "own", F.coalesce("w", F.lit(0.0)).alias("w"))
    total = shares.agg(F.sum("own").alias("all_own"), F.sum("w").alias("all_w"))
    rate = F.when((F.col("own") > 0) & (F.col("all_w") > 0), F.col("w") / F.col("all_w") * F.col("all_own") / F.col("own")).otherwise(F.lit(0.0))
    rated = shares.join(F.broadcast(total), F.lit(True)).select("src", rate.alias("rate"))  # total: always one row
    parts = F.when(F.col("rate") <= ONE, F.lit(1)).otherwise(F.ceil(F.col("rate") / MOST).cast("int"))
    each = F.col("rate") / F.col("parts")
    last = F.ceil(each + 12 * F.sqrt(each) + 20).cast("int")
    first = F.exp(-each)
    cdf = F.aggregate(
        F.sequence(F.lit(1), last),
        F.struct(first.alias("p"), F.array(first).alias("c")),
        lambda acc, k: F.struct((acc["p"] * each / k).alias("p"), F.concat(acc["c"], F.array(F.element_at(acc["c"], -1) + acc["p"] * each / k)).alias("c")),
        lambda acc: acc["c"],
    )
    return rated.withColumn("parts", parts).withColumn("cdf", cdf)


def replicate(df: DataFrame, key: str = "doc_id", source: str = "source", units: Column | None = None, weights: DataFrame | None = None, power: float = POWER, seed: int = SEED, shuffle: bool = True) -> DataFrame:
    """Each row as often as its draw says, with copy (from 0), rate and shuffle_key; with shuffle, globally ordered by shuffle_key.

    units: what the shares are measured in, by default characters of `text` (null: 0). Rows of equal keys (repeated
    rows, null keys) draw alike. Input columns named like an output are replaced. An empty table gives no rows.
    """
    units = F.coalesce(F.length("text"), F.lit(0)) if units is None else units
    df = without(df, ["copy", "rate", "shuffle_key"])
    rates = source_rates(df, source, units, weights, power)
    src, parts, cdf, salt, salted, n = fresh([*df.columns, "copy", "rate", "shuffle_key"], "src", "parts", "cdf", "salt", "salted", "n")
    rates = cut(rates.select(F.col("src").alias(src), "rate", F.col("parts").alias(parts), F.col("cdf").alias(cdf)), "rates")
    same = F.col(f"`{source}`").eqNullSafe(F.col(src))
    if rates.count() <= FEW:  # a row holds at most ONE + 12 * sqrt(ONE) + 21 numbers
        rated = df.join(F.broadcast(rates), same)
    else:  # a source's rows are dealt over SALTS tasks
        spread = rates.withColumn(salted, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rated = df.withColumn(salt, F.pmod(F.xxhash64(F.col(f"`{key}`")), F.lit(SALTS)).cast("int")).join(spread, same & (F.col(salt) == F.col(salted))).drop(salt, salted)
    draw = lambda *part: F.size(F.filter(cdf, lambda c: c <= uniform(F.col(f"`{key}`"), *part, seed=seed)))
    several = F.aggregate(F.sequence(F.lit(1), F.col(parts)), F.lit(0), lambda sofar, part: sofar + draw(part))
    drawn = rated.withColumn(n, F.when(F.col(parts) > 1, several).when(F.col("rate") > 0, draw()).otherwise(F.lit(0))).drop(cdf, parts, src)
    copies = drawn.where(F.col(n) > 0).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col(n).cast("long") - 1))).drop(n)
    out = copies.withColumn("shuffle_key", uniform(F.col(key), F.col("copy"), seed=seed + 1))
    return out.repartitionByRange(F.col("shuffle_key"), F.col(key)).sortWithinPartitions("shuffle_key", key) if shuffle else out


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return replicate(docs).select("doc_id", "source", "text", "copy", F.round("rate", 9).alias("rate"), "shuffle_key")


SQL = f"""
WITH RECURSIVE own AS (
  SELECT source, sum(coalesce(length(text), 0))::DOUBLE AS own FROM documents GROUP BY source
), rates AS (
  SELECT source, pow(own, {POWER}) / (SELECT sum(pow(own, {POWER})) FROM own) * (SELECT sum(own) FROM own) / own AS rate FROM own WHERE own > 0
), cdf AS (
  SELECT source, rate, 0 AS k, exp(-rate) AS p, exp(-rate) AS c FROM rates
  UNION ALL
  SELECT source, rate, k + 1, p * rate / (k + 1), c + p * rate / (k + 1) FROM cdf WHERE k < ceil(rate + 12 * sqrt(rate) + 20)
), drawn AS (
  SELECT doc_id, source, text, ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT / 4503599627370496.0 AS u FROM documents
), copies AS (
  SELECT d.doc_id, d.source, d.text, c.rate, c.k AS copy FROM drawn d JOIN cdf c ON d.source IS NOT DISTINCT FROM c.source AND c.c <= d.u
)
SELECT doc_id, source, text, copy::BIGINT AS copy, round(rate, 9) AS rate,
       ('0x' || substr(md5('{SEED + 1}:' || coalesce(doc_id::VARCHAR, '') || ':' || copy), 1, 13))::BIGINT / 4503599627370496.0 AS shuffle_key
FROM copies
"""
