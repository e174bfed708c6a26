import random

import corpus_pipeline as C
from countweave.llm import quality_rules as Q

from .test_jaccard_join import brute as components
from .test_packing import check
from .test_suffix_dedup import brute as strip


def without_passages(text, spans, least=50):
    """Of the repeated spans of bytes, those of many words go, up to whole words."""
    data, out, at = text.encode(), b"", 0
    for x, y in spans:
        if len(data[x:y].split()) >= least:
            while x > 0 and not data[x - 1 : x].isspace() and not data[x : x + 1].isspace():
                x += 1
            while y < len(data) and not data[y : y + 1].isspace() and not data[y - 1 : y].isspace():
                y -= 1
            x += x > 0 and not data[x - 1 : x].isspace()
            y -= y < len(data) and not data[y : y + 1].isspace()
            between = 0 < x and y < len(data) and not data[x - 1 : x].isspace() and not data[y : y + 1].isspace()
            out += data[at:x] + b" " * between
            at = y
    return (out + data[at:]).decode()


def test_stages_against_brute_force(spark, tmp_path):
    base = [" ".join("word%d" % random.Random(100 * i + j).randrange(10_000) for j in range(40 + i)) for i in range(12)]
    passage = " ".join("passage%d" % (i * i) for i in range(60))
    rows = [(i, t, "en", "s%d" % (i % 2), len(t or "")) for i, t in enumerate([*base, base[3] + " tail", base[3], "### $$$ " * 30, "few words", None, "", base[5] + " " + passage, base[6] + " é " + passage])]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert docs.columns == C.COLUMNS

    good = C.quality(spark, docs, str(tmp_path))
    assert {r.doc_id for r in good.collect()} == set(range(12)) | {12, 13, 18, 19}
    assert good.columns == C.COLUMNS

    kept = [(r.doc_id, r.text) for r in good.collect()]
    first = {k for k, _, c in components(kept) if k == c}
    single = C.near_duplicates(spark, good, str(tmp_path))
    assert {r.doc_id for r in single.collect()} == first and single.columns == C.COLUMNS

    left = {k: without_passages(t, spans) for k, t, spans in ((r.doc_id, r.text, next(s for k, _, _, s in strip([(x.doc_id, x.text) for x in single.collect()], 200) if k == r.doc_id)) for r in single.collect())}
    clean = C.repeated_passages(spark, single, str(tmp_path))
    assert {r.doc_id: r.text for r in clean.collect()} == {k: t for k, t in left.items() if t.strip()}
    assert clean.columns == C.COLUMNS and all(r.n_chars == len(r.text) for r in clean.collect())
    assert any("passage" in (r.text or "") for r in single.collect()) and not any("passage100" in r.text for r in clean.collect())

    mixed = C.mix(spark, clean, str(tmp_path))
    assert mixed.columns == C.COLUMNS
    out = C.sequences(spark, mixed, str(tmp_path)).collect()
    check([(r.doc_id, r.text) for r in mixed.collect()], out, 1024)
    whole = C.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.piece, r.ids_crc32) for r in whole) == sorted((r.doc_id, r.piece, r.ids_crc32) for r in out)


def test_policies_name_rules():
    assert all(set(p) <= {r.name for r in Q.RULES} for p in Q.POLICIES.values())


def test_one_row_of_each_group_stays(spark, tmp_path):
    """Repeated rows, copies without an id, and two texts under one id, all over 400 bytes."""
    text = [" ".join("word%d" % random.Random(1000 * i + j).randrange(10_000) for j in range(80)) for i in range(6)]
    rows = [(1, text[0]), (1, text[0]), (1, text[0]), (None, text[1]), (2, text[1]), (None, text[2]), (None, text[2] + " tail"), (3, text[3]), (4, text[3]), (4, text[4]), (5, text[5])]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    single = C.near_duplicates(spark, docs, str(tmp_path))
    got = [(r.doc_id, r.text) for r in single.collect()]
    kept = [x for x in got if x[0] is not None]
    assert sorted(kept) == [(1, text[0]), (2, text[1]), (3, text[3]), (4, text[4]), (5, text[5])]
    assert len(got) == 6 and [t for i, t in got if i is None][0] in (text[2], text[2] + " tail")
    assert sorted((r.doc_id or 0, r.text) for r in C.repeated_passages(spark, single, str(tmp_path)).collect()) == sorted((i or 0, t) for i, t in got)


def test_passages_of_just_over_fifty_words_go(spark, tmp_path):
    """Passages of 51 to 60 words, short ones included, in documents of their own words; other documents stay as they are."""
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(r.randrange(2, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    passages = [text(51 + i) for i in range(10)]
    rows = [(i, f"{text(70)} {passages[i % 10]} {text(60)}") for i in range(30)] + [(100 + i, text(150)) for i in range(30)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert min(map(len, passages)) < 320
    out = {x.doc_id: x.text for x in C.repeated_passages(spark, docs, str(tmp_path)).collect()}
    assert len(out) == 60 and all(out[i] == t for i, t in rows if i >= 100)
    assert all(passages[i % 10] not in out[i] and len(out[i].split()) == 130 for i in range(30))
