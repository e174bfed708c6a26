"""URL rules, each indexed by the rarest of its literal tokens.

A rule is a regular expression over the host and a prefix of the path, or one over the whole lower-case URL. Its
literal tokens (runs of a-z and 0-9 that every fitting URL holds) are counted over all URLs; the rule waits under the
rarest. A URL's own tokens fetch the rules that wait there, and only those are run.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, tidied, without

TOKEN = re.compile("[a-z0-9]+")
#: Rules are sent to every executor; more than this many are refused.
MOST = 100_000


@dataclass(frozen=True)
class HostRule:
    """Fits its host and all subdomains where the path starts with its own."""

    action: str
    host: str
    path: str = "/"

    @property
    def name(self) -> str:
        return self.host + self.path

    def tokens(self) -> set[str]:
        whole = self.path[: self.path.rfind("/") + 1]  # what stands before the last / ends with it
        return {*TOKEN.findall(self.host), *TOKEN.findall(whole.lower())}


@dataclass(frozen=True)
class PatternRule:
    """A regular expression over the lower-case URL, with words that stand between other characters in each match."""

    action: str
    name: str
    pattern: str
    literals: tuple[str, ...] = ()

    def tokens(self) -> set[str]:
        return set(self.literals)


BASE = (HostRule("block", "net"), HostRule("allow", "example.net", "/en/"), HostRule("block", "example.com", "/de/"), HostRule("allow", "org", "/fr/"))
#: The method's own rules; they speak where no host rule fits. URLs that no rule fits are allowed.
PATTERNS = (
    PatternRule("block", "pills", r"[/.-](cheap|buy|discount)-pills[./-]", ("pills",)),
    PatternRule("block", "casino", r"[/.-]casino[./-]", ("casino",)),
    PatternRule("block", "adult", r"[/.-]xxx[./-]", ("xxx",)),
    PatternRule("block", "free download", r"[/-]free-download-crack[./-]", ("free", "download", "crack")),
    PatternRule("block", "popunder", r"[?&]utm_medium=popunder(&|#|$)", ("utm", "medium", "popunder")),
)
RULES = (*BASE, *PATTERNS)
OUT = ["host", "path", "rule", "verdict"]


def _lower(text: str) -> str:
    return text.encode().lower().decode()  # A-Z only


def split(url: str | None) -> tuple[str, str]:
    """(host, path): after the first :// up to /, ?, # or the end, A-Z lower-cased; then up to ?, # or the end."""
    if url is None or (at := url.find("://")) < 0:
        return "", ""
    rest = url[at + 3 :]
    host = re.match("[^/?#]*", rest)[0]
    return _lower(host), re.match("[^?#]*", rest[len(host) :])[0]


def count_tokens(df: DataFrame, url: str, tokens: set[str]) -> dict[str, int]:
    """In how many rows' URLs each of the tokens stands; of those tokens only."""
    spark = df.sparkSession
    low = F.translate(F.coalesce(F.col(url), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    asked = spark.createDataFrame([(t,) for t in sorted(tokens)], "token string")
    seen = df.select(F.explode(F.array_distinct(F.split(low, "[^a-z0-9]+"))).alias("token")).join(F.broadcast(asked), "token")
    return {r["token"]: r["n"] for r in seen.groupBy("token").agg(F.count("*").alias("n")).collect()}


def index(rules: tuple, counts: dict[str, int]) -> dict[str | None, list[int]]:
    """Places of the rules under their rarest token; under None those without one, which every URL has to run."""
    out: dict[str | None, list[int]] = {}
    for i, rule in enumerate(rules):
        out.setdefault(min(rule.tokens(), key=lambda t: (counts.get(t, 0), t), default=None), []).append(i)
    return out


@tidied
def _judge(batches: Iterator[pa.RecordBatch], url: str, rules: tuple, waiting: dict) -> Iterator[pa.RecordBatch]:
    run = [re.compile(r"(?s:.*\.)?" + re.escape(r.host)) if isinstance(r, HostRule) else re.compile(r.pattern) for r in rules]
    always = waiting.get(None, [])
    for batch in batches:
        out = []
        for text in batch.column(batch.schema.names.index(url)).to_pylist():
            host, path = split(text)
            low = _lower(text or "")
            fits, own = [], []
            for i in {*always, *(i for t in set(TOKEN.findall(low)) for i in waiting.get(t, ()))}:
                rule = rules[i]
                if isinstance(rule, HostRule):
                    if path.startswith(rule.path) and run[i].fullmatch(host):
                        fits.append((-len(rule.name), i))
                elif run[i].search(low):
                    own.append((-len(rule.pattern), i))
            if fits:
                rule = rules[min(fits)[1]]
                out.append((host, path, rule.name, rule.action))
            else:
                out.append((host, path, None, rules[min(own)[1]].action if own else "allow"))
        yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array([r[c] for r in out], pa.string()) for c in range(4))], [*batch.schema.names, *OUT])


def judge(df: DataFrame, url: str = "url", rules: tuple = RULES) -> DataFrame:
    """df with host, path, rule (the longest host rule that fits, else null) and verdict (its action, else that of the longest pattern that fits, else allow).

    Of equally long rules the first counts. A null URL, or one without ://, has an empty host and path; it fits no host
    rule. Rows are judged one by one, whatever their other columns; input columns named like an output are replaced.
    An empty table gives no rows.
    """
    if len(rules) > MOST:
        raise ValueError(f"more than {MOST} rules")
    df = without(df, OUT)
    small_batches(df.sparkSession)
    tokens = {t for r in rules for t in r.tokens()}
    waiting = index(rules, count_tokens(df, url, tokens) if tokens else {})
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema]
    return df.mapInArrow(lambda it: _judge(it, url, rules, waiting), ", ".join([*fields, *(f"{c} string" for c in OUT)]))


def query(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")).drop("url")


_LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_FITS = " UNION ALL ".join(f"SELECT '{r.host}' AS rh, '{r.path}' AS rp, '{r.action}' AS ra" for r in BASE)
_OWN = " OR ".join("regexp_matches(low, '{}')".format(r.pattern) for r in PATTERNS)
SQL = f"""
WITH u AS (
  SELECT row_number() OVER () AS r, page_id, url, coalesce(url, '') AS t FROM pages
), h AS (
  SELECT *, CASE WHEN position('://' IN t) > 0 THEN substr(t, position('://' IN t) + 3) ELSE '' END AS rest FROM u
), p AS (
  SELECT r, page_id, {_LOW.format("t")} AS low, {_LOW.format("regexp_extract(rest, '^[^/?#]*')")} AS host,
         regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM h
), f AS (
  SELECT r, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(ra, length(rh || rp)) AS action
  FROM p JOIN ({_FITS}) ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY r
)
SELECT page_id, host, path, rule, coalesce(action, CASE WHEN {_OWN} THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN f USING (r)
"""
