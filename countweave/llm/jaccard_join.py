"""N-gram Jaccard join by prefix trees.

1. Each text becomes the set of its word n-grams (64-bit keys); texts of equal sets are one node.
2. Sets are read in one global order: a sample of half the n-grams, by hash, those in fewer sets first; then the other
   n-grams; last those that are frequent by a table of fixed size. Two sets of Jaccard similarity t have an n-gram in
   common among the first s - ceil(t * s) + 1 of each. Only the sample has to be counted over the corpus, and a set
   with so many n-grams of its own there is done with. The others are hung under one node of each such n-gram (never
   all pairs), which makes candidate clusters outside of which no link can be.
3. Each cluster's sets are stored in a path-compressed trie. A set is looked up by walking the trie level by level, with
   the overlap of a path shared by all sets below it and subtrees dropped whose remaining length cannot reach the
   overlap needed. Lookups stop when at most one component still has sets that were not looked up: all links that
   could join two components have then been seen from one side.
4. A cluster over BLOCK n-grams is dealt in blocks, and every pair of blocks is joined.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, LOWER, Poly, shingles, sieve, small_batches, steps, tidied, utf8
from .components import components, smallest

SIZE = 5
#: Similarity as a fraction, for exact arithmetic on integers.
THRESHOLD = (80, 100)
#: Cells of the table of n-grams that are frequent; fixed, whatever the corpus.
CELLS = 1 << 20
#: Times an n-gram has to be seen among about this many to count as frequent there.
OFTEN, AMONG = 3, 1 << 20
#: Eighths of the n-grams that are counted, and how many of those a part of the counting holds.
SAMPLED, PART = 4, 1 << 20
#: Salts of the sets' 64-bit keys; the first is taken under which 128 bits tell no two sets of one key.
SALTS = 8
#: n-grams of a block of a cluster; a task holds two blocks at most, at about 100 bytes each.
BLOCK = 1 << 20


def _prefix(n: int, t: tuple[int, int]) -> int:
    return n - -(-t[0] * n // t[1]) + 1


def _node(grams: np.ndarray, salt: int) -> tuple[int, int]:
    """The set's key, signed, and a second one that tells two sets of one key."""
    digest = hashlib.blake2b(grams.tobytes(), digest_size=16, salt=salt.to_bytes(8, "little")).digest()
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def _sets(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[int | None, np.ndarray]]:
    """(id, set) for each row of (id, text) batches."""
    poly = Poly(8)
    for batch in batches:
        ids = batch.column(0).to_pylist()
        buf, at = utf8(batch.column(1))
        for i, _, part, off in steps(buf, at):
            for k, grams in enumerate(shingles(poly, LOWER[part], off, size)):
                yield ids[i + k], grams


@tidied
def _describe(batches: Iterator[pa.RecordBatch], size: int, salt: int) -> Iterator[pa.RecordBatch]:
    """A row (id, n, node, check, null, null) for each text, and rows (null, null, null, null, cell, count) of what is frequent."""
    rows, held, n_held, seen = [], [], 0, set()

    def flush(last: bool) -> Iterator[pa.RecordBatch]:
        nonlocal rows, held, n_held
        if len(rows) > 5000 or last and rows:
            none = pa.nulls(len(rows), pa.int64())
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in zip(*rows, strict=True)), none, none], DESCRIBED)
            rows = []
        if n_held > AMONG or last and held:
            grams = np.sort(np.concatenate(held))
            first = np.flatnonzero(np.r_[True, grams[1:] != grams[:-1]])
            times = np.diff(np.r_[first, len(grams)])
            often = times >= OFTEN
            cells, where = np.unique((grams[first[often]] % np.uint64(CELLS)).astype(np.int64), return_inverse=True)
            total = np.bincount(where, times[often], len(cells)).astype(np.int64)
            none = pa.nulls(len(cells), pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, none, none, pa.array(cells), pa.array(total)], DESCRIBED)
            held, n_held = [], 0
            seen.clear()

    for key, grams in _sets(batches, size):
        node, check = _node(grams, salt) if len(grams) else (None, None)
        rows.append((key, len(grams), node, check))
        if node is not None and node not in seen:
            seen.add(node)
            held.append(grams)
            n_held += len(grams)
        yield from flush(False)
    yield from flush(True)


DESCRIBED = ["id", "n", "node", "check", "cell", "times"]


@tidied
def _postings(batches: Iterator[pa.RecordBatch], size: int, salt: int, t: tuple[int, int], ranks: np.ndarray, parts: int) -> Iterator[pa.RecordBatch]:
    """(part, grams, refs, nodes, spares, a, b): n-grams of many nodes in one row for each part, or edges a > b.

    grams[i] is of nodes[refs[i]]; spares: how many more sampled n-grams than its prefix a node has. Where those are
    too few, the rest of the prefix comes along, of which frequent n-grams join their nodes here already.
    """
    grams_of, refs, nodes, spares, often, held, seen = [], [], [], [], [], 0, set()

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal grams_of, refs, nodes, spares, often, held
        if not nodes:
            return
        own, spare = np.array(nodes, np.int64), np.array(spares, np.int32)
        grams, ref = np.concatenate(grams_of), np.repeat(np.array(refs, np.uint32), [len(x) for x in grams_of])
        a = b = np.zeros(0, np.int64)
        if often:
            g = np.concatenate([x for x, _ in often])
            r = np.repeat(np.array([x for _, x in often], np.uint32), [len(x) for x, _ in often])
            order = np.argsort(g, kind="stable")
            g, r = g[order], r[order]
            new = np.r_[True, g[1:] != g[:-1]]
            head = r[np.flatnonzero(new)][np.cumsum(new) - 1]
            grams, ref = np.r_[grams, g[new]], np.r_[ref, r[new]]
            pairs = np.unique(np.stack([r[~new], head[~new]], 1), axis=0)
            a, b = np.maximum(own[pairs[:, 0]], own[pairs[:, 1]]), np.minimum(own[pairs[:, 0]], own[pairs[:, 1]])
        part = (grams >> np.uint64(32)) % np.uint64(parts)
        order = np.argsort(part, kind="stable")
        cuts = np.searchsorted(part[order], np.arange(parts + 1))
        for k in range(parts):
            at = order[cuts[k] : cuts[k + 1]]
            if len(at):
                used, where = np.unique(ref[at], return_inverse=True)
                yield _blobs([k], [grams[at].tobytes()], [where.astype(np.uint32).tobytes()], [own[used].tobytes()], [spare[used].tobytes()], [None], [None])
        if len(a):
            none = [None] * len(a)
            yield _blobs([int(x) % parts for x in a], none, none, none, none, a, b)
        grams_of, refs, nodes, spares, often, held = [], [], [], [], [], 0
        seen.clear()

    for _, grams in _sets(batches, size):
        if not len(grams) or (node := _node(grams, salt)[0]) in seen:
            continue
        seen.add(node)
        rank = ranks[(grams % np.uint64(len(ranks))).astype(np.int64)]
        sampled = (grams >> np.uint64(24) & np.uint64(7)) < SAMPLED
        light = rank == 0
        counted = grams[sampled & light]
        spare = len(counted) - _prefix(len(grams), t)
        if spare < 0:
            others = grams[~sampled & light][:-spare]
            lacking = -spare - len(others)
            counted = np.r_[counted, others]
            if lacking:
                heavy = np.flatnonzero(~light)
                often.append((grams[heavy[np.argsort(rank[heavy], kind="stable")]][:lacking], len(nodes)))
        grams_of.append(counted)
        refs.append(len(nodes))
        nodes.append(node)
        spares.append(spare)
        held += len(counted)
        if held > AMONG // 2:
            yield from flush()
    yield from flush()


BLOB = ["part", "grams", "refs", "nodes", "spares", "a", "b"]


def _blobs(*columns) -> pa.RecordBatch:
    kinds = (pa.int64(), *[pa.binary()] * 4, pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], BLOB)


@tidied
def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, gram, times, spare) of n-grams in two nodes or more, for rows sorted by part; edges as (a, b, null, null)."""
    part, held = None, []

    def close() -> Iterator[pa.RecordBatch]:
        if not held:
            return
        grams = np.concatenate([np.frombuffer(x[0], np.uint64) for x in held])
        refs = [np.frombuffer(x[1], np.uint32) for x in held]
        nodes = np.concatenate([np.frombuffer(x[2], np.int64)[r] for x, r in zip(held, refs, strict=True)])
        spare = np.concatenate([np.frombuffer(x[3], np.int32)[r] for x, r in zip(held, refs, strict=True)])
        held.clear()
        order = np.argsort(grams, kind="stable")
        grams = grams[order]
        several = np.zeros(len(grams), bool)
        several[1:] = grams[1:] == grams[:-1]
        several[:-1] |= several[1:]
        order, grams = order[several], grams[several]
        nodes, spare = nodes[order], spare[order]
        order = np.lexsort((nodes, grams))
        grams, nodes, spare = grams[order], nodes[order], spare[order]
        if not len(grams):
            return
        once = np.r_[True, (grams[1:] != grams[:-1]) | (nodes[1:] != nodes[:-1])]
        grams, nodes, spare = grams[once], nodes[once], spare[once]
        first = np.flatnonzero(np.r_[True, grams[1:] != grams[:-1]])
        times = np.diff(np.r_[first, len(grams)])
        times = np.repeat(times, times)
        keep = times > 1
        grams, nodes, spare, times = grams[keep].view(np.int64), nodes[keep], spare[keep], times[keep]
        for i in range(0, len(grams), 100_000):
            s = slice(i, i + 100_000)
            yield pa.RecordBatch.from_arrays([pa.array(nodes[s]), pa.array(grams[s]), pa.array(times[s], pa.int64()), pa.array(spare[s], pa.int64())], ["node", "gram", "times", "spare"])

    for batch in batches:
        edges = batch.filter(pc.is_valid(batch.column(5)))
        none = pa.nulls(edges.num_rows, pa.int64())
        yield pa.RecordBatch.from_arrays([edges.column(5), edges.column(6), none, none], ["node", "gram", "times", "spare"])
        for row in batch.filter(pc.is_null(batch.column(5))).to_pylist():
            if row["part"] != part:
                yield from close()
                part = row["part"]
            held.append((row["grams"], row["refs"], row["nodes"], row["spares"]))
    yield from close()


@tidied
def _hang(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (gram, node) sorted by n-gram, edges (a, b) from each node to the first one of its n-gram."""
    last_gram, last_node = None, 0
    for batch in batches:
        g, node = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if not len(g):
            continue
        new = np.r_[g[0] != last_gram, g[1:] != g[:-1]]
        place = np.maximum.accumulate(np.where(new, np.arange(len(g)), -1))
        head = np.where(place >= 0, node[np.maximum(place, 0)], last_node)
        last_gram, last_node = g[-1], head[-1]
        pairs = np.unique(np.stack([np.maximum(node, head), np.minimum(node, head)], 1)[head != node], axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])


class Trie:
    """Path-compressed prefix tree of distinct integer sequences, its nodes in breadth-first order, so that children lie together."""

    def __init__(self, sequences: list[np.ndarray]):
        keys = [x.astype(">u4").tobytes() for x in sequences]
        order = sorted(range(len(keys)), key=keys.__getitem__)
        seqs = [sequences[i] for i in order]
        lengths = np.array([len(x) for x in seqs], np.int64)
        common = np.zeros(len(seqs), np.int64)
        for i in range(1, len(seqs)):
            m = min(lengths[i - 1], lengths[i])
            differ = seqs[i - 1][:m] != seqs[i][:m]
            at = int(differ.argmax()) if m else 0
            common[i] = at if m and differ[at] else m
        spans, begin, end, first, ends_here = [(0, len(seqs))], [0], [0], [], []
        edges: list[np.ndarray] = [np.zeros(0, np.int64)]
        place = 0
        while place < len(spans):
            (lo, hi), depth = spans[place], end[place]
            first.append(len(spans))
            if lo < hi and lengths[lo] == depth:
                ends_here.append(order[lo])
                lo += 1
            else:
                ends_here.append(-1)
            if lo < hi:
                cuts = np.r_[lo, lo + 1 + np.flatnonzero(common[lo + 1 : hi] <= depth), hi].tolist()
                for x, y in zip(cuts, cuts[1:], strict=False):
                    to = int(lengths[x] if y - x == 1 else min(common[x + 1 : y].min(), lengths[x]))
                    spans.append((x, y))
                    begin.append(depth)
                    end.append(to)
                    edges.append(seqs[x][depth:to])
            place += 1
        self.begin, self.end, self.ends_here = np.array(begin), np.array(end), np.array(ends_here)
        self.first = np.array([*first, len(spans)])
        self.children = np.diff(self.first)
        self.shortest = np.array([lengths[a:b].min() if a < b else 0 for a, b in spans])
        self.longest = np.array([lengths[a:b].max() if a < b else 0 for a, b in spans])
        self.tokens, self.at = np.concatenate(edges), np.r_[0, np.cumsum([len(x) for x in edges])]
        self.mask = np.zeros(int(self.tokens.max(initial=0)) + 1, bool)

    @staticmethod
    def _ranges(first: np.ndarray, n: np.ndarray) -> np.ndarray:
        """first[0] .. first[0] + n[0] - 1, first[1] .."""
        return np.repeat(first - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(int(n.sum()))

    def similar(self, query: np.ndarray, t: tuple[int, int]) -> np.ndarray:
        """Places of the sequences whose Jaccard similarity to query is t[0] / t[1] or more."""
        n, found = len(query), []
        self.mask[query] = True
        front, overlap = np.zeros(1, np.int64), np.zeros(1, np.int64)
        while len(front):
            kids = self._ranges(self.first[front], self.children[front])
            overlap = np.repeat(overlap, self.children[front])
            short, long = self.shortest[kids], self.longest[kids]
            need = -(-t[0] * (n + np.maximum(short, -(-t[0] * n // t[1]))) // (t[0] + t[1]))
            live = (t[1] * long >= t[0] * n) & (t[0] * short <= t[1] * n) & (overlap + np.minimum(n - overlap, long - self.begin[kids]) >= need)
            kids, overlap, need = kids[live], overlap[live], need[live]
            if not len(kids):
                break
            sizes = self.at[kids + 1] - self.at[kids]
            hit = self.mask[self.tokens[self._ranges(self.at[kids], sizes)]]
            overlap = overlap + np.add.reduceat(hit, np.r_[0, np.cumsum(sizes)[:-1]], dtype=np.int64)
            live = overlap + np.minimum(n - overlap, self.longest[kids] - self.end[kids]) >= need
            front, overlap = kids[live], overlap[live]
            here = self.ends_here[front]
            linked = (here >= 0) & (t[1] * overlap >= t[0] * (n + self.end[front] - overlap))
            found.append(here[linked])
        self.mask[query] = False
        return np.concatenate(found) if found else np.zeros(0, np.int64)


def link(sets: list[np.ndarray], t: tuple[int, int] = THRESHOLD) -> np.ndarray:
    """A label for each of the distinct sets; equal labels: joined by links."""
    grams, where, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(grams), np.int64)
    rank[np.lexsort((grams, -times))] = np.arange(len(grams))  # what most sets have comes first, and is shared
    ends = np.cumsum([len(x) for x in sets])
    sequences = [np.sort(x) for x in np.split(rank[where], ends[:-1])]
    trie = Trie(sequences)
    labels, todo = np.arange(len(sets)), np.ones(len(sets), bool)
    while True:
        left = np.bincount(labels[todo], minlength=len(sets))
        if np.count_nonzero(left) <= 1:
            return labels
        least = np.argmin(np.where(left > 0, left, len(sets) + 1))
        ask = int(np.flatnonzero(todo & (labels == least))[0])
        todo[ask] = False
        joined = np.unique(labels[trie.similar(sequences[ask], t)])
        if len(joined) > 1:
            labels[np.isin(labels, joined)] = joined[0]


@tidied
def _join(batches: Iterator[pa.RecordBatch], size: int, salt: int, t: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    """Edges (a, b) that give the components of each task key; rows (cluster, i, j, node, text) come sorted by key."""
    poly, key, nodes, sets, a, b = Poly(8), None, [], [], [], []

    def close() -> None:
        if len(nodes) > 1:
            for label, node in zip(link(sets, t), nodes, strict=True):
                if nodes[label] != node:
                    a.append(node)
                    b.append(nodes[label])
        nodes.clear()
        sets.clear()
        known.clear()

    known: set[int] = set()
    for batch in batches:
        keys = list(zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True))
        wanted = batch.column(3).to_pylist()
        buf, at = utf8(batch.column(4))
        for i, _, part, off in steps(buf, at):
            for k, grams in enumerate(shingles(poly, LOWER[part], off, size), i):
                if keys[k] != key:
                    close()
                    key = keys[k]
                if wanted[k] not in known and len(grams) and _node(grams, salt)[0] == wanted[k]:
                    known.add(wanted[k])
                    nodes.append(wanted[k])
                    sets.append(grams)
        if len(a) > 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
            a, b = [], []
    close()
    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def join(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = SIZE, t: tuple[int, int] = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """(key, n_shingles, component_id) for each row of df: the size of its set, and the smallest key reachable by links.

    A-Z count as a-z; words are runs outside space and \x09-\x0D; a text of fewer than `size` words has one n-gram,
    a text without words (or null) none and no link, so it is its own component. Rows of one key are one document of
    several texts for reachability. A null key has a null component and links nothing. An empty table gives no rows.
    Keys are integers. N-grams are compared by 56 bits of hash and their length.
    """
    spark = df.sparkSession
    small_batches(spark)
    texts = df.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    for salt in range(SALTS):
        facts = cut(texts.mapInArrow(lambda it, salt=salt: _describe(it, size, salt), ", ".join(f"{c} long" for c in DESCRIBED)), "sets")
        sets = facts.where("cell IS NULL").select("id", "n", "node")
        checks = facts.where("node IS NOT NULL").groupBy("node").agg(F.min("check").alias("a"), F.max("check").alias("b"))
        if checks.where("a != b").isEmpty():  # no two sets share a key
            break
    else:
        raise ValueError(f"two different sets share a key under each of {SALTS} salts")
    frequent = facts.where("cell IS NOT NULL").groupBy("cell").agg(F.sum("times").alias("times")).toPandas()  # CELLS rows at most
    ranks = np.zeros(CELLS, np.uint8)
    if len(frequent):
        ranks[frequent["cell"]] = np.log2(frequent["times"]).astype(np.uint8)
    shared = spark.sparkContext.broadcast(ranks)
    parts = max(1, -(-(sets.agg(F.sum("n")).first()[0] or 0) * SAMPLED // 8 // PART))
    counted = cut(
        texts.where("id IS NOT NULL")
        .mapInArrow(lambda it: _postings(it, size, salt, t, shared.value, parts), "part long, grams binary, refs binary, nodes binary, spares binary, a long, b long")
        .repartition("part")
        .sortWithinPartitions("part")
        .mapInArrow(_count, "node long, gram long, times long, spare long"),
        "counted",
    )
    own = Window.partitionBy("node")  # of one text each
    prefix = counted.where("times IS NOT NULL").withColumn("place", F.row_number().over(own.orderBy("times", "gram"))).withColumn("n", F.count("*").over(own)).where("place <= n - spare")
    hung = prefix.select("gram", "node").repartition("gram").sortWithinPartitions("gram").mapInArrow(_hang, "a long, b long")
    edges = hung.unionByName(counted.where("times IS NULL").select(F.col("node").alias("a"), F.col("gram").alias("b")))
    clusters = components(edges).select("node", F.col("component").alias("cluster"))
    first = sets.where("id IS NOT NULL AND node IS NOT NULL").groupBy("node").agg(F.min("id").alias("id"), F.max("n").alias("n"))
    members = clusters.join(first, "node")
    members = cut(members.join(members.groupBy("cluster").agg(F.count("*").alias("of")).where("of > 1").drop("of"), "cluster"), "members")
    deal = members.groupBy("cluster").agg(F.ceil(F.sum("n") / F.lit(block)).cast("int").alias("blocks"))
    dealt = members.join(deal, "cluster").withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    tasks = dealt.select("cluster", "node", "id", "blocks", "mine", other.alias("other")).select("cluster", "node", "id", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"))
    wanted = sieve(texts, "id", members, "id").where("maybe")
    fetched = tasks.withColumnRenamed("id", "of").join(wanted, F.col("of") == F.col("id")).select("cluster", "i", "j", "node", "text")
    links = cut(fetched.repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j").mapInArrow(lambda it: _join(it, size, salt, t), "a long, b long"), "links")
    if deal.where("blocks > 1").isEmpty():  # each cluster was joined as a whole
        label = links.select(F.col("a").alias("node"), F.col("b").alias("label"))
    else:
        label = components(links).select("node", F.col("component").alias("label"))
    own = sets.join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    ids = smallest(own)
    return ids.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.col("component_id"))


def query(spark, sf_dir: str) -> DataFrame:
    return join(spark.read.parquet(f"{sf_dir}/documents.parquet"))
