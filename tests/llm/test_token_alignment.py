import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from countweave.llm import token_alignment as T

COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def sides():
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def byte_of():
    """The byte that each character of a byte-level token stands for."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def brute(sides, rows):
    """Whole texts by both libraries, links by all pairs of a group."""
    a, b = sides
    letters, docs = byte_of(), []
    for _, text in rows:
        want = b" " + (text or "").encode()
        ids_a, ids_b = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        bytes_a = [bytes(letters[c] for c in a.id_to_token(i)) for i in ids_a]
        bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        if not text or b"".join(bytes_a) != want or b"".join(bytes_b) != want:
            docs.append(([], [], [], []))
            continue
        ends = []
        for parts in (bytes_a, bytes_b):
            at, own = 0, []
            for x in parts:
                at += len(x)
                own.append(at)
            ends.append(own)
        links = [(x, y) for i, x in enumerate(ids_a) for j, y in enumerate(ids_b) if ends[0][i] == ends[1][j]]
        both, groups = sorted(set(ends[0]) & set(ends[1])), []
        for low, high in zip([0, *both], both, strict=False):
            groups.append("|".join(",".join(str(i) for i, e in zip(ids, own, strict=True) if low < e <= high) for ids, own in ((ids_a, ends[0]), (ids_b, ends[1]))))
        docs.append((ids_a, ids_b, groups, links))
    count = Counter(link for d in docs for link in d[3])
    most = Counter()
    for (_, y), n in count.items():
        most[y] = max(most[y], n)
    out = []
    for (key, _), (ids_a, ids_b, groups, links) in zip(rows, docs, strict=True):
        sha = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        out.append((key, len(ids_a), len(ids_b), len(groups), len(links), sum(count[x] == most[x[1]] for x in links), sum(count[x] for x in links), sha))
    return sorted(out, key=str), count


def run(spark, rows, **more):
    df = spark.createDataFrame([(k, t, "x", 1, 2) for k, t in rows], "doc_id long, text string, row string, n_a int, b int")
    docs, pairs = T.align(df, **more)
    assert docs.columns == COLUMNS
    return sorted((tuple(r) for r in docs.collect()), key=str), pairs


def texts(seed, n):
    r = random.Random(seed)
    vocabulary = ["the", "the", "of", "Straße", "naïve", "don't", "42", "1999,", "foo_bar", "Überraschung", "(well)", "a\nb", "日本", "привет", "▁", "<|endoftext|>", "<s>", "\n", "\t", "", "", "😀", "\r\n", "…", "a　b", "x\x00y", " "]
    return [(i, " ".join(r.choice(vocabulary[: r.choice((10, 15, len(vocabulary)))]) for _ in range(r.randrange(40)))) for i in range(n)]


def test_against_whole_texts(spark, sides):
    rows = texts(1, 120)
    want, count = brute(sides, rows)
    got, pairs = run(spark, rows)
    assert got == want and sum(r[1] > 0 for r in got) > 40
    found = {(r.a, r.b): (r.n, r.best) for r in pairs.collect()}
    assert {k: n for k, (n, _) in found.items()} == dict(count)
    assert all(best == (n == max(m for (_, y), m in count.items() if y == b)) for (_, b), (n, best) in found.items())


def test_blocks_and_flushes_change_nothing(spark, sides, monkeypatch):
    rows = [(i % 50, t) for i, (_, t) in enumerate(texts(2, 80) + texts(2, 80))]
    want, _ = brute(sides, rows)
    assert run(spark, rows, ranges=2)[0] == want
    monkeypatch.setattr(T, "SHARE", 1)  # of the driver: postings go to several blocks
    rows = rows * 4
    want, _ = brute(sides, rows)
    for limits in ((40, 300, 20, 10), (7, 1, 1, 25), (1, 5000, 50, 1)):
        assert run(spark, rows, ranges=3, limits=limits)[0] == want


def test_edge_cases(spark, sides):
    rows = [(1, None), (2, ""), (3, " "), (4, "a "), (5, " a"), (6, "  a  b  "), (7, "x" * 30_000), (8, "word " * 20_000), (None, "tie tie"), (None, "tie tie"), (9, "tie tie"), (9, "tie tie"), (10, "▁"), (11, "a\n \tb"), (12, "a \nb c"), (13, "<|endoftext|> <|endoftext|>"), (14, "é" * 3000)]
    small = [(k, t) for k, t in rows if len(t or "") < 20_000]
    assert run(spark, small)[0] == brute(sides, small)[0]
    got = {r[0]: r for r in run(spark, rows)[0]}
    assert got[8][3] == got[8][4] == 20_001 and got[7][3] > 0
    assert run(spark, [])[0] == []


def test_groups_as_text(spark):
    df = spark.createDataFrame([(1, "tokenization of words")], "doc_id long, text string")
    row = T.align(df, texts=True)[0].first()
    assert hashlib.sha256(row.groups.encode()).hexdigest() == row.groups_sha256 and row.groups.count(";") == row.n_groups - 1


def test_query(spark, sides):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    short = [(k, t) for k, t in rows if len(t) < 4000]
    df = spark.createDataFrame(short, "doc_id long, text string")
    assert sorted((tuple(r) for r in T.align(df)[0].collect()), key=str) == brute(sides, short)[0]
    got = T.query(spark, sf)
    assert got.columns == COLUMNS and got.count() == len(rows)
