"""Quality rules as a bitmask ledger.

Every rule is judged once per document: the ledger keeps the measurements, one bit per failed rule and the version of
the rule set, as a table (`recorded`). A policy is a named, versioned mask of rules that reject; applying a policy or
taking rules out of it (ablation) reads that table only, never the texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import _KEYS, cut, mix, Poly, small_batches, steps, tidied, utf8, WHITE, without, words

WINDOW = 5
SYMBOLS = b"#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_lower")


@dataclass(frozen=True)
class Rule:
    name: str
    fails: str  #: SQL over the measurements

    def column(self) -> Column:
        return F.coalesce(F.expr(self.fails), F.lit(False))


#: A rule's bit is its place here; new rules go to the end, so that old ledgers stay readable.
RULES = (
    Rule("few_words", "n_words < 10"),
    Rule("repeated_words", "100 * n_repeat_words > 20 * n_words"),
    Rule("symbols", "100 * n_symbols > 20 * n_words"),
    Rule("long_words", "word_chars > 16 * n_words"),
    Rule("short_words", "2 * word_chars < 5 * n_words"),
    Rule("repeated_lines", "100 * n_dup_lines > 40 * n_lines"),
    Rule("capitals", "n_upper > n_lower"),
)
BASE = ("few_words", "repeated_words")
#: Goes up when a rule is added or changed.
RULE_SET = 1
#: Versioned policies: the rules that reject.
POLICIES = {
    "base-1": BASE,
    "strict-1": (*BASE, "symbols", "long_words", "short_words", "repeated_lines", "capitals"),
}


def mask_of(rules: tuple[str, ...]) -> int:
    places = {r.name: i for i, r in enumerate(RULES)}
    return sum(1 << places[name] for name in set(rules))


@tidied
def _measure(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[pa.RecordBatch]:
    poly, symbol, upper, lower = Poly(), np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True
    upper[65:91] = True
    lower[97:123] = True
    start_of_char = ~WHITE & ((np.arange(256) & 0xC0) != 0x80)
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        buf, at = utf8(column)
        out = {m: np.zeros(batch.num_rows, np.int64) for m in MEASURES}
        for i, j, part, off in steps(buf, at):
            with np.errstate(over="ignore"):
                begin, end, of = words(part, off)
                out["n_words"][i:j] = np.diff(of)
                for name, wanted in (("word_chars", start_of_char), ("n_symbols", symbol), ("n_upper", upper), ("n_lower", lower)):
                    out[name][i:j] = np.diff(np.r_[0, np.cumsum(wanted[part])][off])
                hashes = poly.pieces(poly.sums(part), begin, end)
                n = len(hashes) - WINDOW + 1
                covered = np.zeros(len(hashes) + 1, np.int64)
                if n > 0:
                    text_of = np.repeat(np.arange(j - i), np.diff(of))
                    window = np.zeros(n, np.uint64)
                    for k in range(WINDOW):
                        window += hashes[k : k + n] * _KEYS[k]
                    same = np.flatnonzero(text_of[:n] == text_of[WINDOW - 1 :])
                    key = mix(window[same]) ^ mix((text_of[same] + 1).astype(np.uint64) * _KEYS[50])
                    order = np.argsort(key)
                    equal = key[order][1:] == key[order][:-1]
                    twice = np.zeros(len(key), bool)
                    twice[order[1:][equal]] = twice[order[:-1][equal]] = True
                    np.add.at(covered, same[twice], 1)
                    np.add.at(covered, same[twice] + WINDOW, -1)
                out["n_repeat_words"][i:j] = np.diff(np.r_[0, np.cumsum(np.cumsum(covered[:-1]) > 0)][of])
        for r, value in enumerate(column.to_pylist()):
            if value:
                lines = [x for x in value.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
                out["n_lines"][r] = len(lines)
                out["n_dup_lines"][r] = len(lines) - len(set(lines))
        yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(out[m]) for m in MEASURES)], [*batch.schema.names, *MEASURES])


def ledger(df: DataFrame, text: str = "text") -> DataFrame:
    """df with the measurements and `failed` (bit i: RULES[i] failed), in one pass over whole texts.

    Words are runs outside space and \\x09-\\x0D. A null or empty text measures 0 throughout, and so fails `few_words`.
    Rows with null ids, ties and repeated rows are each judged alone; input columns named like an output are replaced.
    Repeated windows are found by 64-bit hash within each document. An empty table gives no rows.
    """
    df = without(df, [*MEASURES, "failed"])
    small_batches(df.sparkSession)
    kinds = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), *(f"{m} long" for m in MEASURES)])
    measured = df.mapInArrow(lambda it: _measure(it, text), kinds)
    bits = [F.when(r.column(), F.lit(1 << i)).otherwise(F.lit(0)) for i, r in enumerate(RULES)]
    total = bits[0]
    for b in bits[1:]:
        total = total.bitwiseOR(b)
    return measured.withColumn("failed", total.cast("long"))


def recorded(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The ledger of (key, text) as a table in the shared folder: key, measurements, failed, and rule_set, the version it was judged by."""
    judged = ledger(df.select(key, text), text).drop(text)
    return cut(judged.withColumn("rule_set", F.lit(RULE_SET)), "ledger")


def apply_policy(ledger_df: DataFrame, policy: str = "strict-1") -> DataFrame:
    """The ledger with `kept`: no rule of the policy failed. Reads bits only; bits of another rule set are refused."""
    if "rule_set" in ledger_df.columns:
        same = F.col("rule_set") == RULE_SET
        ledger_df = ledger_df.withColumn("failed", F.when(same, F.col("failed")).otherwise(F.raise_error(F.lit("the ledger is of another rule set")).cast("long")))
    return without(ledger_df, ["kept"]).withColumn("kept", F.col("failed").bitwiseAND(F.lit(mask_of(POLICIES[policy]))) == 0)


def ablations(ledger_df: DataFrame, policy: str = "strict-1") -> DataFrame:
    """(rule, n_failed, n_only): documents that fail each rule, and those that would be kept without it.

    One aggregation to at most 2**rules distinct masks, then bit tests on those; an empty ledger gives zeros.
    """
    mask = mask_of(POLICIES[policy])
    masks = ledger_df.select(F.col("failed").bitwiseAND(F.lit(mask)).alias("m")).groupBy("m").agg(F.count("*").alias("n"))
    count = lambda hit: F.coalesce(F.sum(F.when(hit, F.col("n"))), F.lit(0))
    per_rule = [
        F.struct(F.lit(name).alias("rule"), count(F.col("m").bitwiseAND(F.lit(bit)) != 0).alias("n_failed"), count(F.col("m") == bit).alias("n_only"))
        for name in POLICIES[policy]
        for bit in [mask_of((name,))]
    ]
    return masks.agg(F.array(*per_rule).alias("r")).select(F.explode("r").alias("r")).select("r.*")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    judged = apply_policy(recorded(docs))
    base = F.col("failed").bitwiseAND(F.lit(mask_of(BASE))) != 0
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), "kept")


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), m AS (
  SELECT r, doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
         length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper,
         length(regexp_replace(text, '[^a-z]', '', 'g')) AS n_lower,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM d
), g AS (
  SELECT r, unnest(range(1, greatest(len(w) - 3, 1))) AS i, w FROM d
), v AS (
  SELECT r, i, count(*) OVER (PARTITION BY r, w[i], w[i + 1], w[i + 2], w[i + 3], w[i + 4]) AS n FROM g
), p AS (
  SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM v, (SELECT unnest(range(0, 5)) AS k) WHERE n > 1 GROUP BY r
), a AS (
  SELECT m.*, len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM m LEFT JOIN p USING (r)
), b AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM a
)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
       n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       NOT (base_failed OR 100 * n_symbols > 20 * n_words OR word_chars > 16 * n_words OR 2 * word_chars < 5 * n_words
            OR 100 * n_dup_lines > 40 * n_lines OR n_upper > n_lower) AS kept
FROM b
"""
