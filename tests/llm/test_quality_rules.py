import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from countweave.llm import quality_rules as Q

SCHEMA = "doc_id long, text string, n_words string, Failed int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def measure(text):
    text = text or ""
    w = WORD.findall(text)
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    seen = Counter(windows)
    again = {i + k for i, x in enumerate(windows) if seen[x] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return {
        "n_words": len(w),
        "word_chars": sum(map(len, w)),
        "n_symbols": sum(c in "#*$%&|<>" for c in text),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(again),
        "n_lines": len(lines),
        "n_upper": sum("A" <= c <= "Z" for c in text),
        "n_lower": sum("a" <= c <= "z" for c in text),
    }


def failed(m):
    n = m["n_words"]
    return [n < 10, 100 * m["n_repeat_words"] > 20 * n, 100 * m["n_symbols"] > 20 * n, m["word_chars"] > 16 * n, 2 * m["word_chars"] < 5 * n, 100 * m["n_dup_lines"] > 40 * m["n_lines"], m["n_upper"] > m["n_lower"]]


def texts():
    r = random.Random(8)
    words = ["a", "be", "THE", "é", "日本", "#x", "|", "longer-word-than-usual-it-is", "\x1c", "\xa0"]
    out = [None, "", " \n", "\x0b\x0c", "one", "a b c d e " * 3, "x\n" * 12, "\n\nq w\n\nq w\n", "word " * 40_000]
    for _ in range(60):
        out.append("".join(r.choice(words) + r.choice([" ", " ", "\n", "\t", "  "]) for _ in range(r.randrange(80))))
    return out


def test_against_definition(spark):
    rows = [(i, t, "x", 1) for i, t in enumerate(texts())] + [(None, "a b c", "x", 1), (1, "a b c", "x", 1), (1, "a b c", "x", 1)]
    got = Q.apply_policy(Q.ledger(spark.createDataFrame(rows, SCHEMA))).collect()
    assert len(got) == len(rows)
    for r in got:
        m = measure(r.text)
        assert {k: r[k] for k in Q.MEASURES} == m, r.doc_id
        bits = failed(m)
        assert r["failed"] == sum(1 << i for i, f in enumerate(bits) if f)
        assert r["kept"] == (not any(bits))


def test_ablations(spark):
    ledger = Q.ledger(spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts())], SCHEMA))
    got = {r.rule: (r.n_failed, r.n_only) for r in Q.ablations(ledger).collect()}
    all_ = [failed(measure(t)) for t in texts()]
    for i, rule in enumerate(Q.RULES):
        assert got[rule.name] == (sum(f[i] for f in all_), sum(f[i] and sum(f) == 1 for f in all_))
    empty = Q.ledger(spark.createDataFrame([], SCHEMA))
    assert {(r.n_failed, r.n_only) for r in Q.ablations(empty, "base-1").collect()} == {(0, 0)} and empty.collect() == []


def test_the_recorded_ledger_serves_policies_and_ablations(spark):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts())], SCHEMA)
    table = Q.recorded(df)
    assert "text" not in table.columns and {r.rule_set for r in table.collect()} == {Q.RULE_SET}
    for policy in Q.POLICIES:
        assert {r.doc_id for r in Q.apply_policy(table, policy).where("kept").collect()} == {r.doc_id for r in Q.apply_policy(Q.ledger(df), policy).where("kept").collect()}
        assert sorted(Q.ablations(table, policy).collect()) == sorted(Q.ablations(Q.ledger(df), policy).collect())
    with pytest.raises(Exception, match="another rule set"):
        Q.apply_policy(table.withColumn("rule_set", F.lit(0))).collect()
