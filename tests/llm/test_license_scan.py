import random

from countweave.llm import license_scan as L

SCHEMA = "doc_id long, text string, labels int, Score string"


def plain(text):
    """Every phrase at every place, every template against every block."""
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = L.WORD.findall(low)
    at = [(i, label) for phrase, label in L.PHRASES for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    own = {}
    for label, t in L.TEMPLATES:
        need = set(t.split())
        for b in L.blocks(low):
            n = len(need & set(b))
            if 100 * n >= 80 * len(need):
                own[label] = max(own.get(label, 0), n / len(need))
    base = {x for _, x in at}
    return (len(words), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None), ",".join(sorted(base)), ",".join(sorted(base | set(own))), 1.0 if base else max(own.values(), default=0.0))


def texts():
    r = random.Random(2)
    out = [None, "", "  ", "The MIT License", "mit, license; CC-BY cc by cc.by", "gnu general public licenses", "GNU\nGeneral\n\nPublic License", "cc by" * 3, "é cc by é", "word " * 30_000 + "apache license"]
    for _, t in L.TEMPLATES:
        w = t.split()
        for drop in (0, 5, len(w) // 3):
            x = [a for i, a in enumerate(w) if i not in r.sample(range(len(w)), drop)]
            r.shuffle(x)
            out += [" ".join(x).title(), "filler " * r.randrange(900) + " ".join(x), "a b c\n \n" + " ".join(x), "\n".join(x)]
    return out


def test_against_every_pair(spark):
    rows = [(i, t, 1, "x") for i, t in enumerate(texts())] + [(None, "MIT License", 1, "x"), (3, "MIT License", 1, "x"), (3, "MIT License", 1, "x")]
    got = L.scan(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) == plain(r.text)
    assert {x for r in got for x in r.labels.split(",") if x} == {x for x, _ in L.TEMPLATES}


def test_licenses_in_several_paragraphs(spark):
    """As they are printed: title, notice and list items with blank lines between, none of which holds enough alone."""
    rows = []
    for i, (_, t) in enumerate(L.TEMPLATES):
        w = t.split()
        cuts = [0, len(w) // 3, 2 * len(w) // 3, len(w)]
        rows.append((i, "Title of the file\n\n" + "\n\n".join(" ".join(w[a:b]) for a, b in zip(cuts, cuts[1:])) + "\n\n" + "more text " * 500, 1, "x"))
    got = {r.doc_id: r for r in L.scan(spark.createDataFrame(rows, SCHEMA)).collect()}
    for i, (label, _) in enumerate(L.TEMPLATES):
        assert label in got[i].labels.split(",") and got[i].score == 1


def test_a_table_of_hundreds_of_templates(spark):
    r = random.Random(4)
    templates = tuple((f"t{i}", " ".join(f"w{r.randrange(3000)}" for _ in range(60))) for i in range(400))
    rows = [(i, "intro text " + t if i % 3 else " ".join(t.split()[:30]), 1, "x") for i, (_, t) in enumerate(templates)]
    got = {x.doc_id: x.labels for x in L.scan(spark.createDataFrame(rows, SCHEMA), templates=templates).collect()}
    assert all(got[i] == (f"t{i}" if i % 3 else "") for i in range(400))


def test_empty(spark):
    assert L.scan(spark.createDataFrame([], SCHEMA)).collect() == []
