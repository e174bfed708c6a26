"""License scan: exact phrases, and an exact set-similarity join of text blocks with license templates.

A block is a paragraph, or of a longer one a window of WIDE words every STEP words, and such a window over the whole
text, for licenses printed in several paragraphs. It takes a template's label where it holds the threshold share of the template's distinct words. The words of all templates are put in one order by the
number of documents that hold them, over the whole corpus, rare ones first: a block that meets the threshold holds one
of the first |T| - ceil(t |T|) + 1 words of the template T (prefix filter), has at least ceil(t |T|) distinct words
(length filter), and the words of T from its first common one on suffice (positional filter). What passes is counted.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, tidied, without

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
BLANK = re.compile("\n[ \t\r\f\v]*\n")
# The phrases to find and their labels.
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
# Notices as licenses print them, and their labels.
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version of the license or at your option any later version"),
    ("cc-by", "you are free to share copy and redistribute the material in any medium or format and adapt remix transform and build upon the material for any purpose even commercially under the attribution terms you must give appropriate credit provide a link to the license and indicate if changes were made"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software"),
)
#: Share of a template's distinct words that a block has to hold, as a fraction.
THRESHOLD = (80, 100)
WIDE, STEP = 400, 200
OUT = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]


def lower(text: str | None) -> str:
    return (text or "").encode().lower().decode()  # A-Z only


def windows(words: list[str]) -> Iterator[list[str]]:
    for at in range(0, max(1, len(words) - STEP), STEP):
        yield words[at : at + WIDE]


def blocks(text: str) -> Iterator[list[str]]:
    """Windows of the paragraphs, and, of several paragraphs, windows across them."""
    found = [words for words in map(WORD.findall, BLANK.split(text)) if words]
    for words in found:
        yield from windows(words)
    if len(found) > 1:
        yield from windows([w for words in found for w in words])


def places(words: list[str], phrases: tuple = PHRASES) -> list[tuple[int, str]]:
    """(word, label) of all places where a phrase's words stand one after the other."""
    line, out = f" {' '.join(words)} ", []
    for phrase, label in phrases:
        at, word, last = line.find(f" {phrase} "), 0, 0
        while at >= 0:
            word, last = word + line.count(" ", last, at), at
            out.append((word, label))
            at = line.find(f" {phrase} ", at + 1)
    return out


class Templates:
    """Templates with their words in one order, and an index of their prefixes."""

    def __init__(self, templates: tuple, counts: dict[str, int], t: tuple[int, int] = THRESHOLD):
        self.t, self.sets, self.index = t, [], {}
        for i, (label, text) in enumerate(templates):
            ordered = sorted(set(WORD.findall(lower(text))), key=lambda w: (counts.get(w, 0), w))
            need = -(-t[0] * len(ordered) // t[1])
            self.sets.append((label, ordered, need))
            for at, word in enumerate(ordered[: len(ordered) - need + 1]):
                self.index.setdefault(word, []).append((i, at))
        self.keys = self.index.keys()

    def containments(self, block: list[str]) -> dict[str, float]:
        """Shares of the templates' words in the block, of those that meet the threshold; the highest of each label."""
        words = set(block)
        first: dict[int, int] = {}
        for word in self.keys & words:
            for i, at in self.index[word]:
                first[i] = min(at, first.get(i, at))
        out: dict[str, float] = {}
        for i, at in first.items():
            label, ordered, need = self.sets[i]
            if len(words) >= need and len(ordered) - at >= need:
                n = sum(w in words for w in ordered[at:])
                if n >= need:
                    out[label] = max(out.get(label, 0.0), n / len(ordered))
        return out


@tidied
def _frequencies(batches: Iterator[pa.RecordBatch], vocabulary: frozenset) -> Iterator[pa.RecordBatch]:
    counts = dict.fromkeys(vocabulary, 0)
    for batch in batches:
        for text in batch.column(0).to_pylist():
            for word in vocabulary.intersection(WORD.findall(lower(text))):
                counts[word] += 1
    yield pa.RecordBatch.from_arrays([pa.array(list(counts)), pa.array(list(counts.values()), pa.int64())], ["word", "n"])


@tidied
def _scan(batches: Iterator[pa.RecordBatch], text: str, templates: Templates) -> Iterator[pa.RecordBatch]:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64())
    for batch in batches:
        rows = []
        for value in batch.column(batch.schema.names.index(text)).to_pylist():
            low = lower(value)
            words = WORD.findall(low)
            found = places(words)
            base, own = {label for _, label in found}, {}
            for block in blocks(low):
                for label, share in templates.containments(block).items():
                    own[label] = max(share, own.get(label, 0.0))
            at = [x for x, _ in found]
            score = 1.0 if base else max(own.values(), default=0.0)
            rows.append((len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(base | own.keys())), score))
        yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array([r[c] for r in rows], t) for c, t in enumerate(kinds))], [*batch.schema.names, *OUT])


def scan(df: DataFrame, text: str = "text", templates: tuple = TEMPLATES, t: tuple[int, int] = THRESHOLD) -> DataFrame:
    """df with n_words, n_base (places of the phrases), first_word and last_word (the first and last of those, by word), base_labels, labels (with those of the templates) and score (1 with a phrase, else the highest share of a template that met the threshold, else 0).

    A-Z count as a-z; words are runs of digits, letters and all beyond ASCII. A null text is empty: no words, no
    labels. Rows are judged one by one; input columns named like an output are replaced. An empty table gives no rows.
    """
    df = without(df, OUT)
    small_batches(df.sparkSession)
    vocabulary = frozenset(w for _, x in templates for w in WORD.findall(lower(x)))
    seen = df.select(F.col(text).alias("text")).mapInArrow(lambda it: _frequencies(it, vocabulary), "word string, n long")
    counts = {r["word"]: r["n"] for r in seen.groupBy("word").agg(F.sum("n").alias("n")).collect()}  # one for each word of the templates
    ready = Templates(templates, counts, t)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema]
    kinds = ["long", "long", "long", "long", "string", "string", "double"]
    return df.mapInArrow(lambda it: _scan(it, text, ready), ", ".join([*fields, *(f"{n} {k}" for n, k in zip(OUT, kinds, strict=True))]))


def query(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).drop("text")


_W = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_SETS = ", ".join(f"('{label}', string_split('{text}', ' '))" for label, text in TEMPLATES)
_PHRASE = ", ".join(f"('{label}', string_split('{phrase}', ' '))" for phrase, label in PHRASES)
SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), w AS (
  SELECT r, doc_id, t, regexp_extract_all(t, '{_W}') AS words FROM d
), i AS (
  SELECT r, words, unnest(range(1, len(words) + 1)) AS pos FROM w
), base AS (
  SELECT r, count(*) AS n, min(pos - 1) AS first_word, max(pos - 1) AS last_word, list(DISTINCT label) AS labels
  FROM i, (VALUES {_PHRASE}) AS p(label, phrase) WHERE words[pos:pos + len(phrase) - 1] = phrase GROUP BY r
), paragraphs AS (
  SELECT r, regexp_extract_all(unnest(regexp_split_to_array(t, '\\n[ \\t\\r\\f\\v]*\\n')), '{_W}') AS words FROM w
  UNION ALL SELECT r, words FROM w WHERE len(words) > 0
), b AS (
  SELECT r, words, unnest(range(0, greatest(1, len(words) - {STEP}), {STEP})) AS pos FROM paragraphs
), sets AS (
  SELECT label, list_distinct(words) AS words FROM (VALUES {_SETS}) AS s(label, words)
), own AS (
  SELECT r, label, max(len(list_intersect(sets.words, b.words[pos + 1:pos + {WIDE}]))::DOUBLE / len(sets.words)) AS share
  FROM b, sets GROUP BY r, label HAVING max({THRESHOLD[1]} * len(list_intersect(sets.words, b.words[pos + 1:pos + {WIDE}])) - {THRESHOLD[0]} * len(sets.words)) >= 0
), best AS (
  SELECT r, max(share) AS share, list(label) AS labels FROM own GROUP BY r
)
SELECT doc_id, len(w.words)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
       array_to_string(list_sort(coalesce(base.labels, [])), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(best.labels, [])))), ',') AS labels,
       CASE WHEN n > 0 THEN 1.0 ELSE coalesce(share, 0) END::DOUBLE AS score
FROM w LEFT JOIN base USING (r) LEFT JOIN best USING (r)
"""
