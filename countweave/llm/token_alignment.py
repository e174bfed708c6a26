"""Alignment of two tokenizers: where their tokens end together, and how often each pair of ids does so in the corpus.

Every text is tokenized both ways; byte offsets where a token of either side ends cut it into groups, and the last two
tokens of a group are a link. Links are counted by postings:

1. Tasks emit, for each pair of ids, postings: the documents that hold it and how often. A word between two single
   spaces is tokenized once for a batch, as no token of either side reaches over the end of a word.
2. Two streams meet by side id: the pairs' pre-aggregated counts, and the postings. Side ids are dealt to RANGES ranges,
   postings also to blocks of documents, so a hot id is spread over all blocks; counts go to every block. Each task reads
   its rows sorted (by Spark, which spills) by id, counts first: it holds the counts of one id at a time, knows their
   maximum when the postings come, and adds up what they give to their documents.
3. The contributions of all ranges are summed by document.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, small_batches, tidied
from .packing import LONG_RUN, RUN, UNUSUAL

#: Ranges of side ids; a document gets a contribution from each at most.
RANGES = 32
#: Rows of postings for each count that is sent to a block of documents, at least.
SHARE = 4
#: Contributions that a task adds up at a time; characters of texts cut into words together, of distinct words tokenized together, and of a part of a longer text.
LIMITS = (1_500_000, 4_000_000, 200_000, 4_000_000)
#: Words that one call of a tokenizer gets; longer texts take more than their share of time.
FEW = 150
_SIDES: dict = {}


class Sides:
    """Both tokenizers, and the bytes of their tokens."""

    def __init__(self, a: str, ranks: str, b: str):
        import sentencepiece
        import tiktoken

        with open(ranks, "rb") as file:
            table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        self.path, self.tokenizer = a, None
        self.fast = tiktoken.Encoding("pieces", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=b)
        names = [self.pieces.id_to_piece(i) for i in range(self.pieces.get_piece_size())]
        bytes_of = [bytes([int(x[3:5], 16)]) if self.pieces.is_byte(i) else x.replace("▁", " ").encode() for i, x in enumerate(names)]
        #: Whether words can be tokenized apart: no piece holds a space after another character.
        self.apart = not any(re.search("[^▁]▁", x) for x in names)
        by_rank = {rank: token for token, rank in table.items()}
        self.bytes_a = [by_rank.get(rank, b"") for rank in range(max(by_rank) + 1)]
        self.bytes_b = bytes_of
        self.long_a, self.long_b = (np.array([len(x) for x in of], np.int64) for of in (self.bytes_a, self.bytes_b))
        #: Ids of a before "," and "|", then those of b before "," and ";": what the groups' text is made of.
        self.shown = [f"{i}{end}".encode() for n, ends in ((len(self.bytes_a), ",|"), (len(self.bytes_b), ",;")) for end in ends for i in range(n)]
        self.long_shown = np.array([len(x) for x in self.shown], np.int64)

    def _whole(self):
        if self.tokenizer is None:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
            from tokenizers import Tokenizer

            self.tokenizer = Tokenizer.from_file(self.path)
            self.tokenizer.encode_special_tokens = True
        return self.tokenizer

    def ids(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of space + text of either side for each text, without special tokens."""
        spaced = [" " + x for x in texts]
        slow = [i for i, x in enumerate(spaced) if UNUSUAL(x) or len(x) >= RUN and LONG_RUN(x)]
        found = dict(zip(slow, self._whole().encode_batch([spaced[i] for i in slow], add_special_tokens=False), strict=True)) if slow else {}
        a = [np.array(found[i].ids, np.int64) if i in found else self.fast.encode_to_numpy(x, disallowed_special=()).astype(np.int64) for i, x in enumerate(spaced)]
        return a, [np.array(x, np.int64) for x in self.pieces.encode(texts, num_threads=1)]

    def same(self, a: np.ndarray, b: np.ndarray, text: str) -> bool:
        """Whether both sides' bytes are those of space + text."""
        want = b" " + text.encode()
        return b"".join(map(self.bytes_a.__getitem__, a.tolist())) == want and b"".join(map(self.bytes_b.__getitem__, b.tolist())) == want


SPLIT = re.compile(r"(?<=\S) (?=\S)")
#: A space that may belong to a longer run of white space, or the text's own ends.
ODD = re.compile(r"\A\s| (?:\s|\Z)").search


def words(text: str) -> list[str]:
    """The text cut at single spaces, where neither side's token can reach over; each word is tokenized with a space before it."""
    return SPLIT.split(text) if ODD(text) else text.split(" ")


class Book:
    """What each of some distinct words gives, by its slot: fine (whether both sides' bytes are its own), a, b (numbers of tokens), shown (its groups as text, each ended by ';'), and pairs[first:last] (b << 32 | a, of the groups' last tokens)."""

    def __init__(self, sides: Sides, given: list[str], joined: int):
        self.slot = np.zeros(len(given), np.int64)
        ids: list[list[np.ndarray]] = [[], []]
        counts: list[list[np.ndarray]] = [[], []]
        fine: list[np.ndarray] = []
        n = 0

        def put(which: list[int], a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, good: np.ndarray) -> None:
            nonlocal n
            self.slot[which] = np.arange(n, n + len(which))
            n += len(which)
            for of, x in zip((*ids, *counts, fine), (a, b, n_a, n_b, good), strict=True):
                of.append(x)

        alone = [i for i, w in enumerate(given) if not w or w[0].isspace() or w[-1].isspace() or not w.isascii() and UNUSUAL(w)]
        apart = set(alone)
        block, size = [], 0

        def close() -> None:
            own = [given[i] for i in block]
            a, b = (np.concatenate(x) for x in sides.ids([" ".join(own[k : k + FEW]) for k in range(0, len(own), FEW)]))
            if sides.same(a, b, " ".join(own)):
                ends = np.cumsum([(len(w) if w.isascii() else len(w.encode())) + 1 for w in own])  # ends of tokens of both sides
                n_a, n_b = (np.diff(np.searchsorted(np.cumsum(long[x]), ends, "right"), prepend=0) for x, long in ((a, sides.long_a), (b, sides.long_b)))
                put(block.copy(), a, b, n_a, n_b, np.ones(len(block), bool))
            else:
                alone.extend(block)
            block.clear()

        for i, w in enumerate(given):
            if i not in apart:
                block.append(i)
                size += len(w) + 1
                if size > joined:
                    close()
                    size = 0
        if block:
            close()
        for k in range(0, len(alone), 1000):
            which = alone[k : k + 1000]
            of_a, of_b = sides.ids([given[i] for i in which])
            good = np.array([bool(given[i]) and sides.same(a, b, given[i]) for i, a, b in zip(which, of_a, of_b, strict=True)], bool)
            own = [[x if ok else x[:0] for x, ok in zip(of, good, strict=True)] for of in (of_a, of_b)]
            put(which, *(np.concatenate(x) for x in own), *(np.array([len(v) for v in x]) for x in own), good)
        none = [np.zeros(0, np.int64)]
        a, b, self.a, self.b, good = (np.concatenate(x or none) for x in (*ids, *counts, fine))
        self.fine = good.astype(bool)
        self._groups(sides, a, b)

    def _groups(self, sides: Sides, a: np.ndarray, b: np.ndarray) -> None:
        ends_a, ends_b = np.cumsum(sides.long_a[a]), np.cumsum(sides.long_b[b])
        end = np.zeros((2, int(ends_a[-1]) + 1 if len(a) else 1), bool)
        end[0, ends_a] = end[1, ends_b] = True
        last_a, last_b = end[1, ends_a], end[0, ends_b]
        self.pairs = (b[last_b] << 32) | a[last_a]
        # In the groups' text a token comes after all tokens of earlier groups, and one of b after its group's of a.
        through_a, through_b = np.flatnonzero(last_a) + 1, np.r_[0, np.flatnonzero(last_b) + 1]
        of_a, of_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        order = np.zeros(len(a) + len(b), np.int64)
        n_a, n_b = len(sides.bytes_a), len(sides.bytes_b)
        order[np.arange(len(a)) + through_b[of_a]] = a + n_a * last_a
        order[np.arange(len(b)) + through_a[of_b]] = b + 2 * n_a + n_b * last_b
        text = b"".join(map(sides.shown.__getitem__, order.tolist()))
        tokens = np.r_[0, np.cumsum(self.a + self.b)]
        at = np.r_[0, np.cumsum(sides.long_shown[order])][tokens].tolist()
        self.shown = [text[x:y] for x, y in zip(at, at[1:], strict=False)]
        ended = np.r_[0, np.cumsum(last_a)][np.r_[0, np.cumsum(self.a)]]
        self.first, self.groups = ended[:-1], np.diff(ended)


def parse(sides: Sides, texts: list[str], joined: int) -> tuple[Book, list[np.ndarray]]:
    """The book of the texts' words, and each text's words as slots of it."""
    cuts = [(words(x) if sides.apart else [x]) if x else [] for x in texts]
    number = {w: i for i, w in enumerate(dict.fromkeys(chain.from_iterable(cuts)))}
    of = np.fromiter(map(number.__getitem__, chain.from_iterable(cuts)), np.int64)
    book = Book(sides, list(number), joined)
    return book, np.split(book.slot[of], np.cumsum([len(x) for x in cuts])[:-1]) if cuts else []


def pairs_of(book: Book, slots: np.ndarray, *more: np.ndarray) -> tuple[np.ndarray, ...]:
    """The pairs of these words, one after the other, and what else is said of each word for each of its pairs."""
    n = book.groups[slots]
    before = np.cumsum(n) - n
    return book.pairs[np.repeat(book.first[slots] - before, n) + np.arange(n.sum())], *(np.repeat(x, n) for x in more)


def _pieces(text: str, most: int) -> Iterator[str]:
    """The text in parts of about `most` characters that can be tokenized apart."""
    at = 0
    while len(text) - at > most and (end := SPLIT.search(text, at + most)):
        yield text[at : end.start()]
        at = end.end()
    yield text[at:]


@tidied
def _tokens(batches: Iterator[pa.RecordBatch], files: tuple[str, str, str], texts: bool, limits: tuple[int, int, int, int]) -> Iterator[pa.RecordBatch]:
    """For rows (key, text): a row (row, key, n_a, n_b, n_groups, sha, groups) each, and postings (b, a, base, docs, times, n): documents base + docs hold the pair so often."""
    if files not in _SIDES:
        _SIDES[files] = Sides(*files)
    sides, (_, together, joined, part) = _SIDES[files], limits
    row = TaskContext.get().partitionId() << 40
    for batch in batches:
        given = [x or "" for x in batch.column(1).to_pylist()]
        i = 0
        while i < len(given):
            j, size = i + 1, len(given[i])
            while j < len(given) and size + len(given[j]) <= together:
                size += len(given[j])
                j += 1
            if j == i + 1 and size > part and sides.apart:
                *own, pair, n = _long(sides, given[i], joined, part, texts)
                out, doc = [own], np.zeros(len(pair), np.int32)
            else:
                book, slots = parse(sides, given[i:j], joined)
                out = [_one(book, own, texts) for own in slots]
                fine = [own if x[0] else own[:0] for own, x in zip(slots, out, strict=True)]
                word, n = np.unique(np.concatenate(fine) * len(fine) + np.repeat(np.arange(len(fine)), [len(own) for own in fine]), return_counts=True)
                pair, doc, n = pairs_of(book, word // len(fine), word % len(fine), n)
            cols = list(zip(*out, strict=True))
            yield _rows([pa.array(np.arange(row, row + len(out))), batch.column(0).slice(i, j - i), *cols, *[None] * 6], len(out), batch.column(0).type)
            if len(pair):
                yield from _postings(row, doc.astype(np.int32), pair, n, batch.column(0).type)
            row += j - i
            i = j


def _one(book: Book, slots: np.ndarray, texts: bool) -> tuple:
    """(n_a, n_b, n_groups, sha, groups) of a text."""
    if not len(slots) or not book.fine[slots].all():
        return 0, 0, 0, "", "" if texts else None
    groups = b"".join(map(book.shown.__getitem__, slots.tolist()))[:-1]
    return int(book.a[slots].sum()), int(book.b[slots].sum()), int(book.groups[slots].sum()), hashlib.sha256(groups).hexdigest(), groups.decode() if texts else None


def _long(sides: Sides, text: str, joined: int, part: int, texts: bool) -> tuple:
    """The same of a long text, part by part, then its pairs and how often it has each."""
    hashed, shown, totals = hashlib.sha256(), [], np.zeros(3, np.int64)
    pair = n = np.zeros(0, np.int64)
    for piece in _pieces(text, part):
        book, (slots,) = parse(sides, [piece], joined)
        if not len(slots) or not book.fine[slots].all():
            return *_one(book, slots[:0], texts), pair[:0], n[:0]
        for k in range(0, len(slots), 100_000):
            some = b"".join(map(book.shown.__getitem__, slots[k : k + 100_000].tolist()))
            some = (b";" if totals[0] or k else b"") + some[:-1]
            hashed.update(some)
            if texts:
                shown.append(some)
        totals += [x[slots].sum() for x in (book.a, book.b, book.groups)]
        pair, where = np.unique(np.r_[pair, pairs_of(book, slots)[0]], return_inverse=True)
        n = np.bincount(where, np.r_[n, np.ones(len(where) - len(n), np.int64)], len(pair)).astype(np.int64)
    return *totals.tolist(), hashed.hexdigest(), b"".join(shown).decode() if texts else None, pair, n


TOKENS = ["row", "key", "n_a", "n_b", "n_groups", "sha", "groups", "b", "a", "base", "docs", "times", "n"]
_KINDS = (pa.int64(), None, pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int64())


def _rows(columns: list, n: int, key: pa.DataType) -> pa.RecordBatch:
    kinds = [kind or key for kind in _KINDS]
    return pa.RecordBatch.from_arrays([pa.nulls(n, k) if c is None else c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], TOKENS)


def _postings(base: int, doc: np.ndarray, pair: np.ndarray, n: np.ndarray, key: pa.DataType) -> Iterator[pa.RecordBatch]:
    ids, of = np.unique(pair, return_inverse=True)
    turn = np.argsort(of * (int(doc.max()) + 1) + doc)
    pair, doc, n = pair[turn], doc[turn], n[turn]
    new = np.flatnonzero(np.r_[True, (pair[1:] != pair[:-1]) | (doc[1:] != doc[:-1])])  # several words may end in one pair
    pair, doc, n = pair[new], doc[new], np.add.reduceat(n, new).astype(np.int32)
    first = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]])
    total, cuts = np.add.reduceat(n.astype(np.int64), first), np.r_[first, len(pair)]
    for i in range(0, len(first), 50_000):
        j = min(i + 50_000, len(first))
        ids, (x, y) = pair[first[i:j]], (cuts[i], cuts[j])
        lists = [pa.ListArray.from_arrays(pa.array((cuts[i : j + 1] - x).astype(np.int32)), pa.array(v[x:y])) for v in (doc, n)]
        yield _rows([*[None] * 7, pa.array(ids >> 32), pa.array(ids & 0xFFFFFFFF), pa.array(np.full(j - i, base)), *lists, pa.array(total[i:j])], j - i, key)


@tidied
def _meet(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """(row, n_best, count_sum) out of rows (range, block, b, kind, a, n, base, docs, times) sorted by range, block, b and kind: counts (kind 0), then postings (kind 1) of each id."""
    now, most, counts = None, 0, {}
    rows: list[np.ndarray] = []
    best: list[np.ndarray] = []
    sums: list[np.ndarray] = []
    held = 0

    def close() -> pa.RecordBatch:
        nonlocal held
        docs, where = np.unique(np.concatenate(rows), return_inverse=True)
        out = [pa.array(docs)]
        for x in (best, sums):
            made = np.zeros(len(docs), np.int64)
            np.add.at(made, where, np.concatenate(x))
            out.append(pa.array(made))
        for x in (rows, best, sums):
            x.clear()
        held = 0
        return pa.RecordBatch.from_arrays(out, ["row", "n_best", "count_sum"])

    for batch in batches:
        names = zip(*(batch.column(c).to_pylist() for c in range(7)), strict=True)
        docs, times = batch.column(7), batch.column(8)
        at, doc, n = docs.offsets.to_numpy(), docs.values.to_numpy(), times.values.to_numpy()
        for i, (part, block, b, kind, a, count, base) in enumerate(names):
            if now != (part, block, b):
                if now and now[:2] != (part, block) and held:
                    yield close()
                now, most = (part, block, b), 0
                counts.clear()
            if kind == 0:
                counts[a] = count
                most = max(most, count)
            else:
                m = n[at[i] : at[i + 1]].astype(np.int64)
                rows.append(doc[at[i] : at[i + 1]] + np.int64(base))
                sums.append(m * counts[a])
                best.append(m if counts[a] == most else np.zeros(len(m), np.int64))
                held += len(m)
                if held >= limit:
                    yield close()
    if held:
        yield close()


def _files(files: tuple[str, str, str] | None) -> tuple[str, str, str]:
    return files or tuple(map(public_tokenizers.path, ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model")))


def align(df: DataFrame, key: str = "doc_id", text: str = "text", files: tuple[str, str, str] | None = None, texts: bool = False, ranges: int = RANGES, limits: tuple[int, int, int, int] = LIMITS) -> tuple[DataFrame, DataFrame]:
    """(documents, pairs).

    documents: a row for each row of df, with its key, n_a and n_b (tokens), n_groups, n_links, n_best (links whose count
    is the highest of their b id, ties included), count_sum (sum of the counts of its links), groups_sha256, and with
    `texts` groups ('a1,a2|b1;a3|b2,b3'). pairs: (b, a, n, best): how many links of the corpus hold each pair, and
    whether none of the id's is counted higher.

    files: side a's tokenizer file and the same vocabulary as ranks, and side b's model. A text is space + text for
    both; null and empty texts and those whose tokens' bytes differ from it have no tokens: zeros and an empty string.
    Null and repeated keys are rows like others; columns other than key and text are not read. An empty table gives
    empty ones.
    """
    spark, files = df.sparkSession, _files(files)
    small_batches(spark)
    given = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = given.schema["key"].dataType.simpleString()
    schema = f"row long, key {kind}, n_a long, n_b long, n_groups long, sha string, groups string, b long, a long, base long, docs array<int>, times array<int>, n long"
    tokens = cut(given.mapInArrow(lambda it: _tokens(it, files, texts, limits), schema), "tokens")
    docs, postings = tokens.where("row IS NOT NULL"), tokens.where("row IS NULL")
    counts = cut(postings.groupBy("b", "a").agg(F.sum("n").alias("n"), F.count("*").alias("size")), "counts")
    n_pairs, size = counts.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    blocks = max(1, size // (SHARE * max(1, n_pairs)))
    where = F.pmod(F.xxhash64("b"), F.lit(ranges)).alias("range")
    none = F.array().cast("array<int>")
    left = counts.select(where, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"), "b", F.lit(0).alias("kind"), "a", "n", F.lit(0).cast("long").alias("base"), none.alias("docs"), none.alias("times"))
    right = postings.select(where, F.pmod(F.xxhash64("base"), F.lit(blocks)).alias("block"), "b", F.lit(1).alias("kind"), "a", "n", "base", "docs", "times")
    met = left.unionByName(right).repartition("range", "block").sortWithinPartitions("range", "block", "b", "kind")
    given_back = met.mapInArrow(lambda it: _meet(it, limits[0]), "row long, n_best long, count_sum long")
    own = docs.select("row", F.struct("key", "n_a", "n_b", "n_groups", "sha", "groups").alias("own"), F.lit(0).cast("long").alias("n_best"), F.lit(0).cast("long").alias("count_sum"))
    both = own.unionByName(given_back.withColumn("own", F.lit(None).cast(own.schema["own"].dataType)).select("row", "own", "n_best", "count_sum"))
    summed = both.groupBy("row").agg(F.first("own", ignorenulls=True).alias("own"), F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    columns = [F.col("own.key").alias(key), "own.n_a", "own.n_b", "own.n_groups", F.col("own.n_groups").alias("n_links"), "n_best", "count_sum", F.col("own.sha").alias("groups_sha256")]
    most = counts.groupBy("b").agg(F.max("n").alias("most"))
    pairs = counts.join(most, "b").select("b", "a", "n", (F.col("n") == F.col("most")).alias("best"))
    return summed.select(*columns, *(["own.groups"] if texts else [])), pairs


def query(spark, sf_dir: str) -> DataFrame:
    return align(spark.read.parquet(f"{sf_dir}/documents.parquet"))[0]
