"""Removal of every byte covered by a long string that also starts elsewhere in the corpus.

The Burrows-Wheeler transform of a collection is built column by column: a round puts in one symbol of each text, in the
order of the suffixes behind it; that column is the round's part of the transform, its stable sort gives the order of
the longer suffixes, and range minima give their common prefixes with their neighbours. Over whole documents that takes
as many rounds as the longest has bytes, each over everything put in before. So the documents are first cut where
content says so:

1. Anchors: the K-grams whose hash is smallest in some window of LENGTH - K + 1 K-grams. A string of LENGTH bytes holds
   an anchor at a place that depends on the string only. The segment of an anchor reaches LENGTH - K bytes to its left
   and LENGTH to its right, so it holds all strings with that anchor there. In long periodic stretches, where every
   place would be an anchor, those near the ends are enough: what lies inside is repeated by itself.
2. Segments of equal content count once, with whether they occur twice. An anchor that occurs once, or only in equal
   segments, needs no comparing.
3. The remaining segments, dealt by anchor, are aligned at it: strings that can be equal start in the same column. Each
   task builds the transform and the common prefixes of its collection from the last column to the first, through files
   that it reads and writes in sequence; a string is repeated if it has LENGTH bytes in common with a neighbour.
4. An anchor with more than HOT different segments is not held by one task: its strings are counted by their hashes,
   those first ruled out that share no core with others.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh, mix, Poly, sieve, small_batches, steps, tidied, utf8, WHITE, without

LENGTH = 400
K = 160
#: Bytes of a repeated string, and words of the whole run, that make a repeated passage.
PASSAGE = (240, 50)
#: Segments that close a collection, and different segments of one anchor that a task may hold: counting their strings
#: instead takes about ten times the time a segment.
COLLECTION, HOT = 10_000, 50_000
PAD = 0xFF  # no byte of UTF-8
#: Strings of a crowded anchor that are first counted by what they have in common.
BUNDLE = 16
#: Anchors that a task holds to tell texts it has seen; bytes of a text that are searched at a time.
SEEN, PART = 200_000, 1 << 19
#: The level of a run that holds for strings of all lengths.
EVERY = -1


def _node(text: str) -> Column:
    """128 bits of the text's SHA-256."""
    return F.substring(F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256)), 1, 16)


def _row(key: str, node: Column) -> Column:
    """128 bits out of the row's key and text."""
    named = F.concat(node, F.coalesce(F.col(key).cast("string"), F.lit("null")).cast("binary"))
    return F.unhex(F.md5(named))


def _slide(x: np.ndarray, w: int, f: np.ufunc) -> np.ndarray:
    """f over each w values in a row, by doubling."""
    now, wide = x, 1
    while 2 * wide <= w:
        now, wide = f(now[:-wide], now[wide:]), 2 * wide
    return f(now[: len(x) - w + 1], now[w - wide : w - wide + len(x) - w + 1])


def anchors(hashes: np.ndarray, w: int, fits: np.ndarray | None = None) -> np.ndarray:
    """Places that are smallest in some window of w; with ties, all of them. fits: at which places a window may begin."""
    least = _slide(hashes, w, np.minimum)
    low = np.full(len(hashes) + w - 1, 0, hashes.dtype)
    low[w - 1 : w - 1 + len(least)] = least if fits is None else np.where(fits[: len(least)], least, 0)
    return np.flatnonzero(_slide(low, w, np.maximum) == hashes)


def thinned(places: np.ndarray, hashes: np.ndarray, length: int, k: int) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """(places without those inside long periodic stretches, those stretches).

    Anchors of one hash at equal distances of k / 2 at most show a period. In a stretch of more than 5 * length bytes each
    string starts again a period further on; as the strings of all phases are also among those near its ends, other
    texts' strings still find them there.
    """
    if len(places) < 3:
        return places, []
    gap = np.diff(places)
    tied = (hashes[places[1:]] == hashes[places[:-1]]) & (gap <= k // 2)
    alike = np.r_[False, tied[1:] & tied[:-1] & (gap[1:] == gap[:-1]), False]  # of gap i with gap i - 1
    stay, stretches, i = np.ones(len(places), bool), [], 0
    firsts = np.flatnonzero(alike[1:] & ~alike[:-1])  # the gap before the first one that is alike
    lasts = np.flatnonzero(alike[:-1] & ~alike[1:])
    for i, j in zip(firsts, lasts, strict=True):
        begin, end = int(places[i]), int(places[j + 1]) + k
        if end - begin > 5 * length:
            stretches.append((begin, end))
            stay[i : j + 2] &= (places[i : j + 2] < begin + 2 * length) | (places[i : j + 2] > end - 2 * length)
    return places[stay], stretches


def _parts(n: int, k: int, reach: int, far: int, part: int) -> Iterator[tuple[int, int, int, int]]:
    """(begin, end, first, last) of the parts of a text of n bytes: anchors at first .. last - 1 see all they need in begin .. end."""
    around = 2 * (reach + far + k)
    for first in range(0, n - k + 1, part):
        last = min(first + part, n - k + 1)
        yield max(0, first - around), min(n, last + around), first, last


def _search(poly: Poly, data: np.ndarray, off: np.ndarray, short: int, length: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """(places, hashes of the anchors and of the segments there, periodic stretches) of texts that stand one after the other."""
    w, reach = short - k + 1, short - k
    if len(data) < short:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64), []
    with np.errstate(over="ignore"):
        sums = poly.sums(data)
        begin = np.arange(len(data) - k + 1)
        hashes = (sums[0][k:] - sums[0][:-k]) * poly.down[: len(begin)]  # not mixed: the order of the upper bits will do
        room = np.repeat(off[1:], np.diff(off))[: len(begin)] - begin
        places, stretches = thinned(anchors(hashes, w, room >= short), hashes, length, k)
        of = np.searchsorted(off, places, "right") - 1
        x, y = np.maximum(places - reach, off[of]), np.minimum(places + length, off[of + 1])
        return places, mix(hashes[places]), mix(poly.pieces(sums, x, y) ^ (places - x).astype(np.uint64)), stretches


@tidied
def _find(batches: Iterator[pa.RecordBatch], short: int, length: int, k: int, part: int = PART) -> Iterator[pa.RecordBatch]:
    """A row (id, node, at) for each text, at null if it was searched; for searched texts, those not yet seen in this task, (id, null, anchor, segment, at, until) for each anchor, until null if `length` bytes
    follow it, and (id, null, null, null, at, until) for each periodic stretch."""
    poly, seen, reach = Poly(5), set(), short - k
    for batch in batches:
        ids, known = batch.column(0), batch.column(1).to_pylist()
        buf, at = utf8(batch.column(2))
        none = pa.nulls(batch.num_rows, pa.int64())
        fresh = np.zeros(batch.num_rows, bool)
        for d, node in enumerate(known):
            fresh[d] = at[d + 1] - at[d] >= short and node not in seen
            if fresh[d] and len(seen) < SEEN:
                seen.add(node)
        yield pa.RecordBatch.from_arrays([ids, batch.column(1), none, none, pa.array(np.zeros(len(fresh), np.int64), mask=fresh), none], FOUND)
        for i, j, data, off in steps(buf, at, part):
            if not fresh[i:j].any():
                continue
            for a, b, first, last in _parts(len(data), k, reach, length, part) if j - i == 1 else [(0, len(data), 0, len(data))]:
                places, anchor, segment, stretches = _search(poly, data[a:b], np.clip(off, a, b) - a, short, length, k)
                of = np.searchsorted(off, places + a, "right") - 1
                keep = (places >= first - a) & (places < last - a) & fresh[i + of]
                places, of = places[keep] + a, of[keep]
                until = off[of + 1] - off[of]
                yield _found(ids, i + of, anchor[keep].view(np.int64), segment[keep].view(np.int64), places - off[of], pa.array(until, mask=places + length <= off[of + 1]))
                if stretches:
                    x, y = np.array(stretches, np.int64).T + a
                    of = np.searchsorted(off, x, "right") - 1
                    own = fresh[i + of]
                    yield _found(ids, (i + of)[own], None, None, (x - off[of])[own], (y - off[of])[own])


def _found(ids: pa.Array, rows: np.ndarray, anchor: np.ndarray | None, segment: np.ndarray | None, at: np.ndarray, until: np.ndarray | pa.Array) -> pa.RecordBatch:
    none = pa.nulls(len(rows), pa.int64())
    columns = [none if c is None else pa.array(c) for c in (anchor, segment, at, until)]
    return pa.RecordBatch.from_arrays([ids.take(pa.array(rows)), pa.nulls(len(rows), pa.binary()), *columns], FOUND)


FOUND = ["id", "node", "anchor", "segment", "at", "until"]
FOUND_SCHEMA = "id binary, node binary, anchor long, segment long, at long, until long"


@tidied
def _segments(batches: Iterator[pa.RecordBatch], short: int, length: int, k: int) -> Iterator[pa.RecordBatch]:
    """(anchor, segment, twice, left, bytes, id, begin) for rows (id, text, wanted) with wanted: an array of (at, anchor, segment, twice)."""
    kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.binary(), pa.binary(), pa.int64())
    for batch in (b.slice(i, 500) for b in batches for i in range(0, b.num_rows, 500)):
        ids = batch.column(0).to_pylist()
        buf, at = utf8(batch.column(1))
        for d, wanted in enumerate(batch.column(2).to_pylist()):
            text = buf[at[d] : at[d + 1]].tobytes()
            rows = []
            for x in wanted:
                begin = max(0, x["at"] - (short - k))
                rows.append((x["anchor"], x["segment"], x["twice"], x["at"] - begin, text[begin : x["at"] + length], ids[d], begin))
            for r in range(0, len(rows), 5000):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[r : r + 5000], strict=True), kinds, strict=True)], [*SEGMENT, "id", "begin"])


SEGMENT = ["anchor", "segment", "twice", "left", "bytes"]
SEGMENT_SCHEMA = "anchor long, segment long, twice boolean, left long, bytes binary, id binary, begin long"


@tidied
def _strings(batches: Iterator[pa.RecordBatch], lengths: tuple[int, ...]) -> Iterator[pa.RecordBatch]:
    """(anchor, segment, left, level, first, hashes) for rows like those of `_segments`, of the strings that hold the anchor.

    Strings are told by how far before the anchor they start, and bundled by BUNDLE such places. Without a column
    `wanted`, a hash for each bundle from `first` on, of the bytes that all of its strings hold. With it, an array of
    (level, place), the hashes of those bundles' strings, from the place `first` on. Every hash is also of the place.
    """
    poly = Poly(9)
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()))
    for batch in batches:
        buf, at = utf8(batch.column(4))
        names, wanted = list(zip(*(batch.column(c).to_pylist() for c in (0, 1, 3)), strict=True)), batch.column(5).to_pylist() if batch.num_columns > 5 else None
        out = []
        with np.errstate(over="ignore"):
            sums = poly.sums(buf)
            for r, (anchor, segment, left) in enumerate(names):
                least = [max(0, left - (int(at[r + 1] - at[r]) - length)) for length in lengths]  # a string ends with the segment
                if wanted is None:
                    for level, length in enumerate(lengths):
                        if least[level] <= left:
                            place = np.arange(least[level] // BUNDLE, left // BUNDLE + 1) * BUNDLE
                            core = at[r] + left - place
                            out.append((anchor, segment, left, level, int(place[0]) // BUNDLE, _placed(poly.pieces(sums, core, core - BUNDLE + 1 + length), place)))
                else:
                    for x in wanted[r]:
                        place = np.arange(max(x["place"] * BUNDLE, least[x["level"]]), min(x["place"] * BUNDLE + BUNDLE - 1, left) + 1)
                        begin = at[r] + left - place
                        out.append((anchor, segment, left, x["level"], int(place[0]), _placed(poly.pieces(sums, begin, begin + lengths[x["level"]]), place)))
        for i in range(0, len(out), 1000):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[i : i + 1000], strict=True), kinds, strict=True)], ["anchor", "segment", "left", "level", "first", "hashes"])


def _placed(hashes: np.ndarray, place: np.ndarray) -> np.ndarray:
    return mix(hashes ^ mix(place.astype(np.uint64) + np.uint64(1))).view(np.int64)


STRING_SCHEMA = "anchor long, segment long, left long, level int, first long, hashes array<long>"


def _shared(strings: DataFrame) -> DataFrame:
    """(anchor, segment, left, level, place) of the hashes of `_strings` that are there more than once with their anchor."""
    each = strings.select("anchor", "segment", "left", "level", "first", F.posexplode("hashes").alias("i", "hash"))
    again = cut(each.groupBy("anchor", "hash").agg(F.count("*").alias("n")).where("n > 1").drop("n"), "again")
    hits = sieve(each, "hash", again, "hash").where("maybe").join(again, ["anchor", "hash"])
    return hits.select("anchor", "segment", "left", "level", (F.col("first") + F.col("i")).alias("place"))


def crowded_runs(segments: DataFrame, lengths: tuple[int, ...]) -> DataFrame:
    """(anchor, segment, level, begin, end), from the segment's start, of what `_collect` finds, for segments of crowded anchors: counted, not held.

    Most strings are ruled out by what the strings of their bundle have in common, so few are counted one by one.
    """
    segments = cut(segments.select(*SEGMENT).dropDuplicates(["anchor", "segment"]), "crowded")  # bytes cut out of repeated rows
    bundles = _shared(segments.mapInArrow(lambda it: _strings(it, lengths), STRING_SCHEMA))
    bundles = cut(bundles.groupBy("anchor", "segment").agg(F.collect_list(F.struct("level", "place")).alias("wanted")), "bundles")  # of one segment each
    strings = cut(segments.join(bundles, ["anchor", "segment"]).select(*SEGMENT, "wanted").mapInArrow(lambda it: _strings(it, lengths), STRING_SCHEMA), "strings")
    runs = _shared(strings).groupBy("anchor", "segment", "left", "level").agg(F.min("place").alias("near"), F.max("place").alias("far"))
    long = F.element_at(F.array(*map(F.lit, lengths)), F.col("level") + 1)
    return runs.select("anchor", "segment", F.col("level").cast("long").alias("level"), (F.col("left") - F.col("far")).alias("begin"), (F.col("left") - F.col("near") + long).alias("end"))


def _range_least(d: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """min(d[first + 1 : last + 1]) for each pair, out of minima over powers of two."""
    out, gap = d[last], last - first
    wide = np.flatnonzero(gap > 1)
    if len(wide):
        level = np.frexp(gap[wide].astype(np.float64))[1] - 1
        now = d
        for e in range(int(level.max()) + 1):
            if e:
                half = 1 << (e - 1)
                now = np.minimum(now[:-half], now[half:])
            at = level == e
            if at.any():
                w = wide[at]
                out[w] = np.minimum(now[first[w] + 1], now[last[w] - (1 << e) + 1])
    return out


class Rounds:
    """The files of one collection of n texts of `width` symbols: columns (the last one first), the transform, and the order and common prefixes of the round before and of this one."""

    def __init__(self, n: int, width: int):
        self.n, self.width = n, width
        self.columns, self.transform, *self.states = (tempfile.TemporaryFile() for _ in range(4))
        self.columns.truncate(n * width)

    def put(self, at: int, block: np.ndarray) -> None:
        """Texts at, at + 1 .. as rows of `block`."""
        columns = np.memmap(self.columns, np.uint8, "r+", shape=(self.width, self.n))
        columns[:, at : at + len(block)] = block[:, ::-1].T

    def close(self) -> None:
        for file in (self.columns, self.transform, *self.states):
            file.close()


def repeated_columns(rounds: Rounds, lengths: tuple[int, ...], wanted: int) -> np.ndarray:
    """(length, column, text): whether a text's string of that many symbols equals another's in one of the first `wanted` columns.

    A round reads the next column and the state of the last round, appends its part to the transform, and writes the
    new state. A round's arrays, one number for each text, are all that is in memory.
    """
    n, width, most = rounds.n, rounds.width, max(lengths)
    found = np.zeros((len(lengths), wanted, n), bool)
    rounds.columns.flush()
    rounds.columns.seek(0)
    before, after = rounds.states
    np.arange(n, dtype=np.uint32).tofile(before)
    np.zeros(n, np.uint16).tofile(before)
    for c in range(width - 1, -1, -1):
        before.seek(0)
        after.seek(0)
        column = np.fromfile(rounds.columns, np.uint8, n)
        order, common = np.fromfile(before, np.uint32, n), np.fromfile(before, np.uint16, n)
        symbols = column[order]
        symbols.tofile(rounds.transform)
        turn = np.argsort(symbols, kind="stable")  # the transform's own step from a symbol to the suffix it begins
        symbols = symbols[turn]
        same = np.flatnonzero(symbols[1:] == symbols[:-1]) + 1
        new = np.zeros(n, np.uint16)
        new[same] = np.minimum(_range_least(common, turn[same - 1], turn[same]) + 1, most)
        order = order[turn]
        order.tofile(after)
        new.tofile(after)
        before, after = after, before
        if c < wanted:
            for level, length in enumerate(lengths):
                hit = new >= length
                hit[:-1] |= hit[1:]
                found[level, c, order[hit]] = True
    return found


@tidied
def _collect(batches: Iterator[pa.RecordBatch], lengths: tuple[int, ...], k: int) -> Iterator[pa.RecordBatch]:
    """(id, level, begin, end): the bytes of each text's segments that are there once that repeated strings of lengths[level] cover. Rows come sorted by anchor."""
    reach, width = min(lengths) - k, min(lengths) - k + max(lengths)
    rows: list[tuple] = []

    def close() -> pa.RecordBatch:
        part = rows.copy()
        rows.clear()
        rounds = Rounds(len(part), width)
        left, size = np.array([r[3] for r in part]), np.array([len(r[4]) for r in part])
        for i in range(0, len(part), 4096):
            some = part[i : i + 4096]
            block, at = np.full((len(some), width), PAD, np.uint8), np.arange(width) - (reach - left[i : i + 4096, None])
            block[(at >= 0) & (at < size[i : i + 4096, None])] = np.frombuffer(b"".join(r[4] for r in some), np.uint8)
            rounds.put(i, block)
        found = repeated_columns(rounds, lengths, reach + 1)
        rounds.close()
        ids, twice, start = pa.array([r[5] for r in part], pa.binary()), np.array([r[2] for r in part]), np.array([r[6] for r in part])
        out: list[list[np.ndarray]] = [[], [], [], []]
        for level, length in enumerate(lengths):
            # Strings that start within `reach` of each other and are longer cover one run.
            first, last = reach - left, np.minimum(reach, reach - left + size - length)
            inside = (np.arange(reach + 1)[:, None] >= first) & (np.arange(reach + 1)[:, None] <= last)
            hit = inside & found[level] & ~twice  # of segments that are there twice all strings are repeated
            some = np.flatnonzero(hit.any(0))
            begin, end = hit.argmax(0)[some] - first[some], reach - hit[::-1].argmax(0)[some] - first[some] + length
            for c, x in zip(out, (some, np.full(len(some), level), start[some] + begin, start[some] + end), strict=True):
                c.append(x.astype(np.int64))
        of, *rest = (pa.array(np.concatenate(c)) for c in out)
        return pa.RecordBatch.from_arrays([ids.take(of), *rest], COVERED)

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if rows and row[:2] == rows[-1][:2]:
                continue  # cut out of a repeated row
            if rows and row[0] != rows[-1][0] and len(rows) >= COLLECTION:
                yield close()
            rows.append(row)
    if rows:
        yield close()


COVERED = ["id", "level", "begin", "end"]
COVERED_SCHEMA = "id binary, level long, begin long, end long"


def _merged(runs: np.ndarray, level: int, n: int) -> list[list[int]]:
    """The maximal runs of this level among rows (level, begin, end), in order and within n bytes."""
    own = runs[(runs[:, 0] == level) | (runs[:, 0] == EVERY), 1:]
    if not len(own):
        return []
    own = np.minimum(own[np.argsort(own[:, 0], kind="stable")], n)
    until = np.maximum.accumulate(own[:, 1])
    new = np.flatnonzero(np.r_[True, own[1:, 0] > until[:-1]])
    return np.stack([own[new, 0], until[np.r_[new[1:] - 1, len(own) - 1]]], 1).tolist()


def _runs(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(rows (level, begin, end), where each text's begin) of a column of arrays of such runs."""
    column = column.fill_null([])
    return np.asarray(column.flatten().flatten(), np.int64).reshape(-1, 3), np.r_[0, np.cumsum(np.asarray(pc.list_value_length(column)))]


@tidied
def _joined(batches: Iterator[pa.RecordBatch], levels: int) -> Iterator[pa.RecordBatch]:
    """The same rows (id, twice, runs) with the maximal runs of each level only."""
    for batch in batches:
        runs, cuts = _runs(batch.column(2))
        made = [[[level, *run] for level in range(levels) for run in _merged(runs[cuts[r] : cuts[r + 1]], level, np.iinfo(np.int64).max)] for r in range(batch.num_rows)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(made, pa.list_(pa.list_(pa.int64())))], batch.schema.names)


def passages(data: np.ndarray, runs: list[list[int]], least: int) -> list[list[int]]:
    """Of the runs of bytes those that hold `least` words or more, words that they cut through included, less those parts of words."""
    out = []
    for x, y in runs:
        inside = ~WHITE[data[x:y]]
        if np.count_nonzero(inside[1:] & ~inside[:-1]) + inside[:1].sum() >= least:
            white = np.r_[x == 0 or WHITE[data[x - 1]], ~inside, y == len(data) or WHITE[data[y]]]
            edges = np.flatnonzero(white)
            if edges[0] < edges[-1]:
                out.append([x + int(edges[0]), x + int(edges[-1]) - 1])
    return out


def _without(data: np.ndarray, spans: list[list[int]], gap: bytes = b"") -> bytes:
    """data without the spans; `gap` takes a span's place where it stood between other bytes and no white space is left."""
    at, out = 0, []
    for x, y in spans:
        out.append(data[at:x].tobytes())
        if gap and 0 < x and y < len(data) and not (WHITE[data[x - 1]] or WHITE[data[y]]):
            out.append(gap)
        at = y
    return b"".join([*out, data[at:].tobytes()])


@tidied
def _strip(batches: Iterator[pa.RecordBatch], text: str, length: int, passage: tuple[int, int] | None) -> Iterator[pa.RecordBatch]:
    """The outputs in place of the last two columns, which say whether the text is there twice, and its runs."""
    spans_type = pa.list_(pa.list_(pa.int64()))
    for batch in batches:
        names = batch.schema.names
        buf, at = utf8(batch.column(names.index(text)))
        *columns, copied, found = batch.columns
        twice, (runs, cuts) = copied.to_pylist(), _runs(found)
        kept, spans, clean, found = [], [], [], []
        for r in range(batch.num_rows):
            data = buf[at[r] : at[r + 1]]
            n = len(data)
            whole, own = [[0, n]] if twice[r] else None, runs[cuts[r] : cuts[r + 1]]
            spans.append(whole if whole and n >= length else _merged(own, 0, n))
            kept.append(_without(data, spans[-1]))
            if passage:
                long = whole if whole and n >= passage[0] else _merged(own, 1 if passage[0] != length else 0, n)
                found.append(passages(data, long, passage[1]))
                clean.append(_without(data, found[-1], b" ").decode("utf-8", "ignore") if found[-1] else None)
        made = [pa.array(kept, pa.binary()), pa.array([x.decode("utf-8", "ignore") for x in kept], pa.string()), pa.array(np.diff(at)), pa.array(spans, spans_type)]
        if passage:
            made += [pa.array(found, spans_type), pa.array(clean, pa.string())]
        yield pa.RecordBatch.from_arrays([*columns, *made], [*names[:-2], *STRIPPED[: len(made)]])


STRIPPED = ["kept", "kept_text", "n_bytes", "spans", "passages", "clean_text"]
STRIPPED_SCHEMA = ["kept binary", "kept_text string", "n_bytes long", "spans array<array<long>>", "passages array<array<long>>", "clean_text string"]


def strip(df: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, k: int | None = None, passage: tuple[int, int] | None = None, hot: int = HOT) -> DataFrame:
    """df with kept (the remaining bytes), kept_text (the same without what is left of characters that were cut), n_bytes (of the whole text) and spans (array of [begin, end), removed, maximal).

    Texts are UTF-8 bytes, null is empty. Every byte of a `length`-byte string that also starts elsewhere, in this or
    another row, goes; both places lose it. Texts under `length` bytes stay whole. Equal texts of `length` bytes or
    more go whole. Rows with null or repeated keys are rows like others: keys only speed up the search. An empty table
    gives no rows; input columns named like an output are replaced.

    passage: (bytes, words), bytes <= length: adds passages (the maximal runs of repeated strings of so many bytes that
    hold so many words or more, cut back to whole words) and clean_text (the text without them, a space where words
    would meet; null where there is none). Both come out of the same rounds.

    Segments and strings are compared by two 64-bit hashes, that of the anchor and their own, over the whole corpus;
    rows and texts by 128-bit ones. k: bytes of an anchor, by default two fifths of the shortest string.
    """
    lengths = (length,) if passage is None or passage[0] == length else (length, passage[0])
    short, length = min(lengths), max(lengths)
    k = k or max(8, short * K // LENGTH)
    df = without(df, STRIPPED)
    small_batches(df.sparkSession)
    # Rows of one id hold the same key and text, so one of them stands for all.
    node = _node(text)
    texts = df.select(_row(key, node).alias("id"), node.alias("node"), F.col(text).alias("text"))
    facts = cut(texts.mapInArrow(lambda it: _find(it, short, length, k), FOUND_SCHEMA), "anchors")
    rows = facts.where("node IS NOT NULL").select("id", "node", F.when(F.col("at").isNull(), F.col("id")).alias("searched"))
    # Of equal texts one is searched for what it shares with others: one of those that were, as each task skips what it has seen. Short ones have none.
    copied = rows.groupBy("node").agg(F.count("*").alias("n"), F.min("searched").alias("one")).where("n > 1").select("node", "one")
    copies = cut(rows.join(copied, "node").select("id", "one", F.lit(True).alias("twice")).distinct(), "copies")
    others = copies.where("id != one").select("id")
    marked = sieve(facts.where("node IS NULL").drop("node"), "id", others, "id")
    facts = marked.where("NOT maybe").unionByName(marked.where("maybe").join(others, "id", "left_anti")).drop("maybe")
    found = facts.where("anchor IS NOT NULL").select("id", "anchor", "segment", "at", "until")
    known = cut(found.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"), "known")
    likely = cut(sieve(found, "anchor", known, "anchor").where("maybe").drop("maybe"), "likely")
    # Equal segments first, then equal anchors: hot ones shrink before they are dealt. A row that is there twice counts twice.
    segments = likely.groupBy("anchor", "segment").agg(F.count("*").alias("times"), F.first(F.struct("id", "at")).alias("one"))
    segments = cut(segments.select("anchor", "segment", "one.id", "one.at", (F.col("times") > 1).alias("twice")), "segments")
    number = cut(segments.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1"), "number")

    def cut_out(some: DataFrame) -> DataFrame:
        """The bytes of these segments."""
        asked = cut(some.groupBy("id").agg(F.collect_list(F.struct("at", "anchor", "segment", "twice")).alias("wanted")), "asked")  # of one text each
        return sieve(texts.select("id", "text"), "id", asked, "id").where("maybe").join(asked, "id").select("id", "text", "wanted").mapInArrow(lambda it: _segments(it, short, length, k), SEGMENT_SCHEMA)

    dealt = cut_out(segments.join(number.where(F.col("n") <= hot), "anchor")).repartition("anchor").sortWithinPartitions("anchor", "segment")
    # A segment's strings were found where it stands; of one that is there twice all are repeated, wherever it stands.
    alone = cut(dealt.mapInArrow(lambda it: _collect(it, lengths, k), COVERED_SCHEMA), "covered")
    begin = F.greatest(F.col("at") - (short - k), F.lit(0))
    many = number.where(F.col("n") > hot).select("anchor")
    if not many.isEmpty():
        crowded = segments.join(many, "anchor")
        places = crowded.where("NOT twice").select("anchor", "segment", "id", begin.alias("start"))
        counted = crowded_runs(cut_out(crowded), lengths).join(places, ["anchor", "segment"])
        alone = alone.unionByName(counted.select("id", "level", (F.col("start") + F.col("begin")).alias("begin"), (F.col("start") + F.col("end")).alias("end")))
    alone = alone.select("id", F.array("level", "begin", "end").alias("run"))
    often, every = segments.where("twice").select("anchor", "segment"), F.lit(EVERY).cast("long")
    met = sieve(likely, "segment", often, "segment").where("maybe").join(often, ["anchor", "segment"])
    end = F.coalesce("until", F.col("at") + length)
    level = F.when(end - begin >= length, every).otherwise(F.lit(lengths.index(short)).cast("long"))  # near a text's end the longer strings may not fit
    met = met.select("id", F.array(level, begin, end).alias("run"))
    stretched = facts.where("until IS NOT NULL AND anchor IS NULL").select("id", F.array(every, "at", "until").alias("run"))
    runs = alone.unionByName(met).unionByName(stretched).groupBy("id").agg(F.collect_set("run").alias("runs"))  # of one text each
    own, mark, twice, spans, flag = fresh([*df.columns, *STRIPPED], "row", "mark", "twice", "runs", "maybe")
    marks = runs.join(copies.drop("one"), "id", "full_outer").select("id", "twice", "runs")
    marks = cut(marks.mapInArrow(lambda it: _joined(it, len(lengths)), "id binary, twice boolean, runs array<array<long>>"), "marks")
    marks = marks.select(F.col("id").alias(mark), F.col("twice").alias(twice), F.col("runs").alias(spans))
    tagged = sieve(df.withColumn(own, _row(key, node)), own, marks, mark, flag)
    kinds = [*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), *STRIPPED_SCHEMA[: 6 if passage else 4]]
    given = [F.col(f"`{c}`") for c in df.columns]
    changed = tagged.where(F.col(flag)).join(marks, F.col(own) == F.col(mark), "left").select(*given, twice, spans).mapInArrow(lambda it: _strip(it, text, lengths[0], passage), ", ".join(kinds))
    value, none = F.coalesce(F.col(text), F.lit("")), F.array().cast("array<array<long>>")
    same = [value.cast("binary").alias("kept"), value.alias("kept_text"), F.octet_length(value).cast("long").alias("n_bytes"), none.alias("spans"), none.alias("passages"), F.lit(None).cast("string").alias("clean_text")]
    whole = tagged.where(~F.col(flag)).select(*given, *same[: 6 if passage else 4])
    return changed.unionByName(whole)


def query(spark, sf_dir: str) -> DataFrame:
    """The contract's columns, and text: the documents without repeated passages (PASSAGE), which may be shorter than the contract's strings."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x[1] - x[0])
    text = F.coalesce("clean_text", "text").alias("text")
    return strip(docs, passage=PASSAGE).select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), text)
