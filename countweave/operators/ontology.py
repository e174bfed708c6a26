"""Enrichment of ontology terms, their similarity, and groups of similar terms."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .. import session
from .ranks import adjusted


@F.pandas_udf(DoubleType())
def hypergeometric_tail(k: pd.Series, drawn: pd.Series, marked: pd.Series, n: pd.Series) -> pd.Series:
    """P(X >= k) for `drawn` out of n of which `marked` are marked."""
    ln = lambda a, b: math.lgamma(a + 1) - math.lgamma(b + 1) - math.lgamma(a - b + 1)

    def tail(k, d, m, n):
        return min(1.0, sum(math.exp(ln(m, i) + ln(n - m, d - i) - ln(n, d)) for i in range(max(k, d + m - n, 0), min(d, m) + 1)))

    return pd.Series([tail(*map(int, x)) for x in zip(k, drawn, marked, n, strict=True)], dtype="float64")


def term_counts(study: DataFrame, background: DataFrame, annotation: DataFrame) -> DataFrame:
    """(term, k, drawn, marked, n): genes of the study and of the background with each term that a study gene has."""
    genes = background.select("gene").distinct()
    chosen = study.select("gene").distinct().join(genes, "gene", "left_semi")
    own = annotation.select("gene", "term").distinct().join(genes, "gene", "left_semi")
    n, drawn = genes.agg(F.count("*").alias("n")), chosen.agg(F.count("*").alias("drawn"))
    marked = own.groupBy("term").agg(F.count("*").alias("marked"))
    k = own.join(chosen, "gene", "left_semi").groupBy("term").agg(F.count("*").alias("k"))
    return k.join(marked, "term").join(n.join(drawn, F.lit(True)), F.lit(True)).select("term", "k", "drawn", "marked", "n")


def enrichment(study: DataFrame, background: DataFrame, annotation: DataFrame, alpha: float = 0.05, namespaces: DataFrame | None = None) -> DataFrame:
    """term_counts with pval (upper tail), padj (over all terms, or with namespaces, a table (term, namespace), over each one's, terms without one left out) and significant."""
    tests = term_counts(study, background, annotation).withColumn("pval", hypergeometric_tail("k", "drawn", "marked", "n"))
    whole = tests.withColumn("namespace", F.lit("")) if namespaces is None else tests.join(namespaces.select("term", "namespace"), "term")
    found = adjusted(whole, ["namespace"]).withColumn("significant", F.col("padj") < alpha)
    return found.drop("namespace") if namespaces is None else found


def closure(edges: DataFrame, rounds: int = 30) -> DataFrame:
    """(go, parent) of all ancestors, out of edges (go, parent) of direct ones; paths longer than 2 ** (rounds - 1) are an error."""
    found = edges.select("go", "parent").distinct()
    n = found.count()
    for _ in range(rounds):  # each doubles the reach
        further = found.join(found.select(F.col("go").alias("parent"), F.col("parent").alias("above")), "parent").select("go", F.col("above").alias("parent"))
        found = session.cut(found.unionByName(further).distinct())
        m = found.count()
        if m == n:
            return found
        n = m
    raise ValueError(f"ancestors are not complete after {rounds} rounds")


def information(annotation: DataFrame, edges: DataFrame) -> DataFrame:
    """(go, frequency, ic): share of the annotations at a term or its direct children, and -log10 of it."""
    own = annotation.groupBy(F.col("term").alias("go")).agg(F.count("*").alias("n"))
    rolled = edges.join(own, "go").select(F.col("parent").alias("go"), "n").unionByName(own).groupBy("go").agg(F.sum("n").alias("n"))
    total = own.agg(F.sum("n").alias("total"))
    return rolled.join(total, F.lit(True)).select("go", (F.col("n") / F.col("total")).alias("frequency"), (-F.log10(F.col("n") / F.col("total"))).alias("ic"))


def similarity(terms: DataFrame, ancestors: DataFrame, ic: DataFrame) -> DataFrame:
    """(a, b, similarity) for pairs a < b of the terms with a common ancestor (or one above the other), by Lin: twice the largest ic above both over the sum of theirs, 0 if either has none."""
    reach = ancestors.select("go", "parent").unionByName(terms.select("go", F.col("go").alias("parent"))).distinct().join(terms.select("go"), "go", "left_semi")
    above = reach.join(ic.select(F.col("go").alias("parent"), F.col("ic").alias("m")), "parent")
    pairs = above.select(F.col("go").alias("a"), "parent", "m").join(above.select(F.col("go").alias("b"), "parent"), "parent").where("a < b").groupBy("a", "b").agg(F.max("m").alias("m"))
    value = lambda side: ic.select(F.col("go").alias(side), F.col("ic").alias(f"ic_{side}"))
    joined = pairs.join(value("a"), "a").join(value("b"), "b")
    zero = (F.col("ic_a") == 0) | (F.col("ic_b") == 0)
    return joined.select("a", "b", F.when(zero, F.lit(0.0)).otherwise(2 * F.col("m") / (F.col("ic_a") + F.col("ic_b"))).alias("similarity"))


ROOTS = ("GO:0008150", "GO:0003674", "GO:0005575")  # fixed values: the three roots


def prepared(results: DataFrame, terms: DataFrame, alternatives: DataFrame, max_p: float = 1.0, namespace: str | None = None) -> DataFrame:
    """(go, name, pval) of results (go, pval): ids that are no live term's are replaced by all that alternatives (alt, go) has for them or else dropped, so are roots, and others by p and namespace; of a term given twice the smaller p."""
    live = terms.where("NOT obsolete")
    other = alternatives.join(live.select(F.col("go").alias("alt")), "alt", "left_anti").select(F.col("alt").alias("go"), F.col("go").alias("to"))
    named = results.join(other, "go", "left").select(F.coalesce("to", "go").alias("go"), "pval")
    known = named.groupBy("go").agg(F.min("pval").alias("pval")).join(live, "go")
    keep = (F.col("pval") <= max_p) & ~F.col("go").isin(*ROOTS)
    return known.where(keep & (F.col("namespace") == namespace if namespace else F.lit(True))).select("go", "name", "pval")


def representatives(terms: DataFrame, similar: DataFrame, ic: DataFrame, cutoff: float = 0.5, ancestors: DataFrame | None = None, priorities: tuple[str, ...] = ()) -> DataFrame:
    """(go, representative): of the most similar pair of terms one gives way to the other, then of the most similar of those left, until no two reach the cutoff; each term goes to the one it gave way to, and on.

    Of a pair, by the first rule that tells: a term of `priorities` stays, one of frequency over 0.05 gives way, one of
    less than half the other's p stays, one below the other (ancestors: go, parent) stays, the smaller p, then the
    smaller id stays. As the rules are no order (p may fall in steps that each tell little), terms are not compared with
    all others but paired: a round settles every pair that is the most similar one of both its terms (ties by ids), which
    gives what taking the pairs one by one would.
    """
    frequent = F.coalesce("frequency", F.lit(0.0)) > 0.05
    facts = terms.join(ic.select("go", "frequency"), "go", "left").select("go", "pval", frequent.alias("frequent"), F.col("go").isin(*priorities).alias("prior"))
    side = lambda x: facts.select(*(F.col(c).alias(c if c == x else f"{c}_{x}") for c in ("pval", "frequent", "prior")), F.col("go").alias(x))
    pairs = similar.where(F.col("similarity") >= cutoff).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "similarity").join(side("a"), "a").join(side("b"), "b")
    above = ancestors if ancestors is not None else terms.sparkSession.createDataFrame([], "go string, parent string")
    below = lambda x, y: above.select(F.col("go").alias(x), F.col("parent").alias(y), F.lit(True).alias(f"{x}_below")).distinct()
    pairs = pairs.join(below("a", "b"), ["a", "b"], "left").join(below("b", "a"), ["a", "b"], "left")
    small = lambda x, y: F.col(f"pval_{x}") < F.col(f"pval_{y}") * 0.5
    first = (
        F.when(F.col("prior_a") != F.col("prior_b"), F.col("prior_a"))
        .when(F.col("frequent_a") != F.col("frequent_b"), F.col("frequent_b"))
        .when(small("a", "b") | small("b", "a"), small("a", "b"))
        .when(F.col("a_below").isNotNull() != F.col("b_below").isNotNull(), F.col("a_below").isNotNull())
        .otherwise(F.col("pval_a") <= F.col("pval_b"))
    )
    left = session.cut(pairs.select("a", "b", "similarity", first.alias("first")), "pairs")
    given = None
    while True:
        ends = left.select(F.col("a").alias("go"), F.struct("similarity", "a", "b").alias("p")).unionByName(left.select(F.col("b").alias("go"), F.struct("similarity", "a", "b").alias("p")))
        # The most similar pair, of equals that of the smallest ids.
        best = ends.groupBy("go").agg(F.min(F.struct((-F.col("p.similarity")).alias("s"), F.col("p.a").alias("a"), F.col("p.b").alias("b"))).alias("m"))
        agreed = best.groupBy("m").agg(F.count("*").alias("n")).where("n = 2").select("m.a", "m.b")
        settled = session.cut(left.join(agreed, ["a", "b"]).select(F.when(F.col("first"), F.col("b")).otherwise(F.col("a")).alias("go"), F.when(F.col("first"), F.col("a")).otherwise(F.col("b")).alias("to")), "settled")
        if settled.isEmpty():
            break
        given = settled if given is None else given.unionByName(settled)
        gone = settled.select(F.col("go").alias("gone"))
        left = session.cut(left.join(gone, F.col("a") == F.col("gone"), "left_anti").join(gone, F.col("b") == F.col("gone"), "left_anti"), "pairs")
    now = terms.select("go", F.col("go").alias("representative")) if given is None else terms.select("go").join(given, "go", "left").select("go", F.coalesce("to", "go").alias("representative"))
    now = session.cut(now, "groups")
    while True:  # a path is halved each time
        after = session.cut(now.join(now.select(F.col("go").alias("representative"), F.col("representative").alias("next")), "representative").select("go", "representative", "next"), "groups")
        if after.where("representative != next").isEmpty():
            return now
        now = after.select("go", F.col("next").alias("representative"))
