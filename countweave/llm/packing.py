"""Packing of tokenized documents into sequences of a fixed length by a grouping genetic algorithm on islands.

Documents are tokenized once and cut into pieces; pieces of full length are sequences of their own. The others are dealt
to islands of about ISLAND pieces by a hash of their place, so no key can crowd one. On each island a population of
packings evolves: a crossover puts whole well-filled bins of one parent into the other, takes the bins out that would
use a piece twice, and best-fits what that displaced. Between epochs the fullest bins of each island go, as patterns of
lengths, to the next one on a ring, which puts them in wherever it has pieces of those lengths. In the end the
emptiest bins of neighbouring islands are packed anew together.
"""

from __future__ import annotations

import base64
import random
import re
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, small_batches, tidied, without

CAPACITY = 1024
END = 2  #: id after each document
ISLAND = 8192
POPULATION, GENERATIONS, EPOCHS = 6, 8, 3
ELITES = 64  #: patterns that migrate from an island
WEAK = 256  #: least filled bins of an island that are packed anew with those of MERGED - 1 others
MERGED = 16
_LOADED: dict = {}


class Ids:
    """Token ids of texts by a tokenizer file, as bytes of little-endian unsigned 32-bit numbers.

    Texts of Latin letters without `<|` go through the same vocabulary as ranks, which gives the same ids in a quarter
    of the time; all others (special tokens, scripts whose classes may differ between Unicode versions, very long runs
    of white space) through the tokenizer file itself.
    """

    def __init__(self, path: str, ranks: str):
        import tiktoken

        self.path, self.tokenizer = path, None
        with open(ranks, "rb") as file:
            table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        self.fast = tiktoken.Encoding("pieces", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    def _whole(self):
        if self.tokenizer is None:
            from tokenizers import Tokenizer

            self.tokenizer = Tokenizer.from_file(self.path)
        return self.tokenizer

    def of(self, texts: list[str]) -> list[bytes]:
        out = []
        for text in texts:
            if "<|" in text or UNUSUAL(text) or len(text) >= RUN and LONG_RUN(text):
                out.append(np.array(self._whole().encode(text, add_special_tokens=False).ids, "<u4").tobytes())
            else:
                out.append(self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4").tobytes())
        return out


UNUSUAL = re.compile("[^\x00-\u024f]").search
#: Length of a run of white space that counts as very long: on about a million characters the pattern of the ranks gives up.
RUN = 100_000
LONG_RUN = re.compile(rf"(?<!\s)\s{{{RUN}}}").search


@tidied
def _tokenize(batches: Iterator[pa.RecordBatch], text: str, paths: tuple[str, str], capacity: int) -> Iterator[pa.RecordBatch]:
    """A row for each piece: the document's other columns, piece, start, length, ids (bytes), ids_crc32, slot."""
    if paths not in _LOADED:
        _LOADED[paths] = Ids(*paths)
    tokenizer, end = _LOADED[paths], np.array([END], "<u4").tobytes()
    slot = TaskContext.get().partitionId() << 40
    for batch in batches:
        place = batch.schema.names.index(text)
        others = [i for i in range(batch.num_columns) if i != place]
        for i in range(0, batch.num_rows, 256):
            part = batch.slice(i, 256)
            rows, out = [], []
            for r, ids in enumerate(tokenizer.of([x or "" for x in part.column(place).to_pylist()])):
                ids += end
                n = len(ids) // 4
                start, size = 0, n % capacity or capacity
                for k in range(-(-n // capacity)):
                    piece = ids[4 * start : 4 * (start + size)]
                    rows.append(r)
                    out.append((k, start, size, piece, zlib.crc32(piece), slot))
                    start, size, slot = start + size, capacity, slot + 1
            taken = pa.table([part.column(i) for i in others], [batch.schema.names[i] for i in others]).take(pa.array(rows, pa.int64())) if others else None
            made = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64()), strict=True)]
            columns = [c.combine_chunks() if c.num_chunks != 1 else c.chunk(0) for c in taken.columns] if taken is not None else []
            yield pa.RecordBatch.from_arrays([*columns, *made], [*(batch.schema.names[i] for i in others), *PIECE])


PIECE = ["piece", "start", "length", "ids", "ids_crc32", "slot"]


def tokenize(df: DataFrame, text: str = "text", paths: tuple[str, str] | None = None, capacity: int = CAPACITY) -> DataFrame:
    """df without its text, one row per piece: piece (from 0), start, length, ids (little-endian unsigned 32-bit numbers), ids_crc32, slot (the piece's own number).

    paths: the tokenizer's file and the same vocabulary as ranks. A document is the ids of its text and END; null and empty texts are END alone. One longer than capacity is cut into
    pieces of it, of which the first may be shorter. Input columns named like an output are replaced.
    """
    paths = paths or (public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    df = without(df, [*PIECE, "sequence_id", "offset"])
    small_batches(df.sparkSession)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != text]
    return df.mapInArrow(lambda it: _tokenize(it, text, paths, capacity), ", ".join([*fields, "piece long, start long, length long, ids binary, ids_crc32 long, slot long"]))


Bins = list[list[int]]


def best_fit(lengths: list[int], bins: Bins, capacity: int) -> Bins:
    """bins with lengths put in, in the order given, each where it leaves the least room."""
    bins, room, open_ = [list(b) for b in bins], [[] for _ in range(capacity + 1)], 0
    for i, b in enumerate(bins):
        g = capacity - sum(b)
        room[g].append(i)
        open_ |= 1 << g
    for x in lengths:
        fits = open_ >> x
        if fits:
            g = x + (fits & -fits).bit_length() - 1
            i = room[g].pop()
            if not room[g]:
                open_ &= ~(1 << g)
        else:
            g, i = capacity, len(bins)
            bins.append([])
        bins[i].append(x)
        room[g - x].append(i)
        open_ |= 1 << (g - x)
    return bins


def inject(bins: Bins, fresh: Bins, stock: list[int], capacity: int) -> Bins:
    """The packing that has those bins of `fresh` for which stock has the pieces, then what is left of `bins`, fullest first; pieces of bins that lost one are best-fitted anew."""
    left, kept = list(stock), []
    for b in [*fresh, *sorted(bins, key=sum, reverse=True)]:
        for i, x in enumerate(b):
            if not left[x]:
                for y in b[:i]:
                    left[y] += 1
                break
            left[x] -= 1
        else:
            kept.append(b)
    return best_fit([x for x in range(capacity, 0, -1) for _ in range(left[x])], kept, capacity)


def cost(bins: Bins, capacity: int) -> tuple[int, float]:
    """Fewer bins first, then Falkenauer's measure: unevenly filled is better."""
    return len(bins), -sum(float(sum(b)) ** 2 for b in bins)


def evolve(lengths: list[int], start: Bins | None, migrants: Bins, capacity: int, seed: int, generations: int = GENERATIONS) -> Bins:
    """The best packing that some generations find.

    The first ones are the starting packing (else best fit, longest first), that with the migrants' bins put in, best
    fit in random orders, and random halves of the first completed by best fit. A child has well-filled bins of one
    parent put into the other; its weakest bins are then shaken out and best-fitted in a random order. It takes the
    place of the worst if it is better. Ends early where the lengths need all bins that are left.
    """
    rng, stock = random.Random(seed), [0] * (capacity + 1)
    for x in lengths:
        stock[x] += 1
    falling = sorted(lengths, reverse=True)
    first, least = start or best_fit(falling, [], capacity), -(-sum(lengths) // capacity)
    if len(first) <= least:
        return first
    people = [first]
    if migrants:
        people.append(inject(first, migrants, stock, capacity))
    while len(people) < POPULATION:
        some = rng.sample(first, len(first) // 2)
        people.append(inject([], some, stock, capacity) if len(people) % 2 else best_fit(rng.sample(falling, len(falling)), [], capacity))
    people = [(cost(p, capacity), p) for p in people]
    for _ in range(generations):
        people.sort(key=lambda p: p[0])
        if people[0][0][0] <= least:
            break
        (_, a), (_, b) = rng.sample(people[: POPULATION // 2 + 1], 2)
        full = [x for x in b if 200 * sum(x) >= 199 * capacity]
        child = sorted(inject(a, rng.sample(full, len(full) // 2), stock, capacity), key=sum)
        weak = 4 + len(child) // rng.choice((10, 25, 50))
        shaken = [x for b in child[:weak] for x in b]
        rng.shuffle(shaken)
        child = best_fit(shaken, child[weak:], capacity)
        if (c := cost(child, capacity)) < people[-1][0]:
            people[-1] = (c, child)
    return min(people, key=lambda p: p[0])[1]


@tidied
def _islands(batches: Iterator[pa.RecordBatch], capacity: int, seed: int) -> Iterator[pa.RecordBatch]:
    """Rows (island, slot, length, bin, pattern) sorted by island: pieces with the bin they are in (or null) and migrants (slot null).

    Gives the pieces with their new bins, elites, and a row without slot and pattern: length bins of best fit alone, and bins now.
    """
    island, held, migrants = None, [], []

    def close() -> pa.RecordBatch:
        by_bin: dict[int, list[int]] = {}
        for _, x, b in held:
            if b is not None:
                by_bin.setdefault(b, []).append(x)
        bins = evolve([x for _, x, _ in held], list(by_bin.values()) or None, migrants, capacity, seed + island)
        slots: list[list[int]] = [[] for _ in range(capacity + 1)]
        for s, x, _ in sorted(held):
            slots[x].append(s)
        out = [(island, slots[x].pop(), x, n, None) for n, b in enumerate(bins) for x in b]
        out.append((island, None, len(best_fit(sorted((x for _, x, _ in held), reverse=True), [], capacity)), len(bins), None))
        elites = list(dict.fromkeys(tuple(sorted(b)) for b in bins if sum(b) == capacity))[:ELITES]
        out += [(island, None, None, None, list(e)) for e in elites]
        held.clear()
        migrants.clear()
        return _rows(out)

    for batch in batches:
        for i, slot, length, bin_, pattern in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if i != island:
                if held:
                    yield close()
                migrants.clear()
                island = i
            if slot is None:
                if pattern is not None:
                    migrants.append(pattern)
            else:
                held.append((slot, length, bin_))
    if held:
        yield close()


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
    return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate(kinds)], ISLAND_ROW)


ISLAND_ROW = ["island", "slot", "length", "bin", "pattern"]
ISLAND_SCHEMA = "island long, slot long, length long, bin long, pattern array<long>"


def _epoch(rows: DataFrame, n: int, capacity: int, seed: int) -> DataFrame:
    """An epoch of n islands, each about a task."""
    return cut(rows.select(*ISLAND_ROW).repartition(n, "island").sortWithinPartitions("island", "slot").mapInArrow(lambda it: _islands(it, capacity, seed), ISLAND_SCHEMA), "islands")


def islands(small: DataFrame, capacity: int = CAPACITY, island: int = ISLAND, epochs: int = EPOCHS) -> tuple[DataFrame, int]:
    """(rows of `_islands` after these epochs, with elites sent on in between; number of islands) for pieces (slot, length) shorter than capacity."""
    n = max(1, -(-small.count() // island))
    rows = small.select(F.pmod(F.xxhash64("slot"), F.lit(n)).alias("island"), "slot", "length", F.lit(None).cast("long").alias("bin"), F.lit(None).cast("array<long>").alias("pattern"))
    for e in range(epochs):
        if e:  # elites go on along the ring
            rows = rows.where("slot IS NOT NULL OR pattern IS NOT NULL").withColumn("island", F.when(F.col("slot").isNull(), F.pmod(F.col("island") + 1, F.lit(n))).otherwise(F.col("island")))
        rows = _epoch(rows, n, capacity, 1000 * e)
    return rows, n


def gains(pieces: DataFrame, capacity: int = CAPACITY, island: int = ISLAND, epochs: int = EPOCHS) -> DataFrame:
    """(island, best_fit, evolved): sequences that best fit alone, longest first, and the islands need for pieces (slot, length), full ones left out."""
    rows, _ = islands(pieces.where(F.col("length") < capacity).select("slot", "length"), capacity, island, epochs)
    return rows.where("slot IS NULL AND pattern IS NULL").select("island", F.col("length").alias("best_fit"), F.col("bin").alias("evolved"))


def arrange(pieces: DataFrame, capacity: int = CAPACITY, island: int = ISLAND, epochs: int = EPOCHS) -> DataFrame:
    """(slot, sequence_id, offset) for pieces (slot, length), 1 <= length <= capacity, slots distinct."""
    full = pieces.where(F.col("length") == capacity).select("slot", (-1 - F.col("slot")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    small = pieces.where(F.col("length") < capacity).select("slot", "length")
    rows, n = islands(small, capacity, island, epochs)
    none, no_pattern = F.lit(None).cast("long"), F.lit(None).cast("array<long>")
    rows = rows.where("slot IS NOT NULL")
    done = []
    while n > 1:
        load = rows.groupBy("island", "bin").agg(F.sum("length").alias("load"))
        weak = load.withColumn("r", F.row_number().over(Window.partitionBy("island").orderBy("load", "bin"))).where(F.col("r") <= WEAK).select("island", "bin", F.lit(True).alias("weak"))
        marked = cut(rows.join(weak, ["island", "bin"], "left"), "marked")
        done.append(marked.where("weak IS NULL").select("slot", "length", F.concat_ws(":", F.lit(len(done)), "island", "bin").alias("place")))
        n = -(-n // MERGED)
        rows = _epoch(marked.where("weak").select(F.floor(F.col("island") / MERGED).alias("island"), "slot", "length", none.alias("bin"), no_pattern.alias("pattern")), n, capacity, 9000 + len(done)).where("slot IS NOT NULL")
    done.append(rows.select("slot", "length", F.concat_ws(":", F.lit(len(done)), "island", "bin").alias("place")))
    placed = done[0]
    for d in done[1:]:
        placed = placed.unionByName(d)
    # A place (round, island, bin) holds at most capacity pieces; its smallest slot names the sequence.
    along = Window.partitionBy("place").orderBy("slot")
    numbered = placed.select("slot", F.min("slot").over(Window.partitionBy("place")).alias("sequence_id"), (F.sum("length").over(along.rowsBetween(Window.unboundedPreceding, 0)) - F.col("length")).alias("offset"))
    return full.unionByName(numbered)


def pack(df: DataFrame, text: str = "text", paths: tuple[str, str] | None = None, capacity: int = CAPACITY, island: int = ISLAND) -> DataFrame:
    """df without its text, one row per piece: what `tokenize` gives, sequence_id and offset (gapless from 0 in each sequence).

    Every row is packed: null and empty texts as END alone, repeated rows and null keys each for themselves. An empty
    table gives no rows.
    """
    pieces = cut(tokenize(df, text, paths, capacity), "pieces")
    return pieces.join(arrange(pieces.select("slot", "length"), capacity, island), "slot").drop("slot")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pack(docs).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
