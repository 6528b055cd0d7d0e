"""URL filters as a sort-merge range join.

A host is written label by label from the right (``www.example.com`` -> ``com.example.www.``),
so a rule's host and its subdomains are one interval of keys.  URLs and rules are dealt
into ranges of that key and sorted; one sweep per range keeps a stack of the rules whose
intervals are open, and each URL takes the longest of them whose path it starts with.
A rule is copied to every range that its interval meets.  Range borders come from a bounded
sample of keys; a key that holds many URLs is spread over several ranges by a hash.

Defined cases: a null URL, or one without ``://``, has the empty host and path; no fitting
rule gives a null rule and the default verdict; equal rules count once (the first by action);
of two fitting rules of one length the one with the longer host wins; repeated rows give
repeated results; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import arrow_stream, bounded_sample

# The rules of the contract (action, host, path).
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
DEFAULT = "allow"
#: Keys in the sample that sets the range borders.
SAMPLE_KEYS = 20_000


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL, both empty if it is null or has no ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    raw = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(raw) + 1), "^[^?#]*", 0)
    host = F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def host_key(host: Column) -> Column:
    """Reversed labels, each ended by a dot; the empty host is the empty key."""
    return F.when(host == "", "").otherwise(F.concat(F.concat_ws(".", F.reverse(F.split(host, r"\."))), F.lit(".")))


class _Open:
    """The rules of one host on the stack."""

    def __init__(self, key: str):
        self.key = key
        self.paths: dict[str, tuple[str, str]] = {}
        self.sizes: list[int] = []

    def add(self, path: str, host: str, action: str) -> None:
        if path not in self.paths:
            self.paths[path] = (host + path, action)
            self.sizes = sorted({len(p) for p in self.paths}, reverse=True)

    def longest(self, path: str) -> tuple[str, str] | None:
        return next((self.paths[path[:n]] for n in self.sizes if path[:n] in self.paths), None)


def sweep(rows, default: str = DEFAULT):
    """``(row, rule, verdict)`` of the URL rows; rows: (range, key, 0 for a rule, id, host, path, action), sorted."""
    stack: list[_Open] = []
    part = None
    for row in rows:
        where, key, is_url, _, host, path, action = row
        if where != part:
            stack, part = [], where
        while stack and not key.startswith(stack[-1].key):
            stack.pop()
        if not is_url:
            if not stack or stack[-1].key != key:
                stack.append(_Open(key))
            stack[-1].add(path, host, action)
            continue
        best = None
        for level in stack:
            hit = level.longest(path)
            if hit and (best is None or len(hit[0]) >= len(best[0])):
                best = hit
        yield row, best[0] if best else None, best[1] if best else default


def judge_urls(pages: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url", ranges: int | None = None, default: str = DEFAULT) -> DataFrame:
    """One row per URL: key, ``host``, ``path``, ``rule``, ``verdict``; rules: ``(action, host, path)``."""
    n = ranges or int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kind = pages.schema[key].dataType.simpleString()
    host, path = host_and_path(F.col(url))
    parsed = pages.select(F.col(key).alias("id"), host.alias("host"), path.alias("path"), F.xxhash64(key, url).alias("spread")).withColumn("key", host_key(F.col("host")))
    sampled = sorted((r.key, r.spread) for r in bounded_sample(parsed, SAMPLE_KEYS, "id", "path").select("key", "spread").collect())
    borders = [sampled[len(sampled) * i // n] for i in range(1, n)] if sampled else []

    @F.pandas_udf("int")
    def place(keys: pd.Series, spread: pd.Series) -> pd.Series:
        return pd.Series([bisect_right(borders, x) for x in zip(keys, spread, strict=True)], dtype="int32")

    @F.pandas_udf("array<int>")
    def places(keys: pd.Series) -> pd.Series:
        def met(k):
            first = bisect_right(borders, (k, -(2**63) - 1))
            return list(range(first, (bisect_left(borders, (k[:-1] + "/", -(2**63) - 1)) if k else len(borders)) + 1))

        return keys.map(met)

    rule = rules.select("action", F.coalesce("host", F.lit("")).alias("host"), F.coalesce("path", F.lit("")).alias("path")).distinct().withColumn("key", host_key(F.col("host")))
    cols = ("range", "key", "is_url", "id", "host", "path", "action")
    rows = parsed.select(place("key", "spread").alias("range"), "key", F.lit(1).alias("is_url"), "id", "host", "path", F.lit(None).cast("string").alias("action"))
    rows = rows.unionByName(rule.select(F.explode(places("key")).alias("range"), "key", F.lit(0).alias("is_url"), F.lit(None).cast(kind).alias("id"), "host", "path", "action"))
    rows = rows.repartitionById(n, F.col("range")).sortWithinPartitions("range", "key", "is_url", "path", "action")

    def judge(batches):
        def tuples():
            for b in batches:
                yield from zip(*(c.to_pylist() for c in b.columns), strict=True)

        out = {k: [] for k in ("id", "host", "path", "rule", "verdict")}
        for row, said, verdict in sweep(tuples(), default):
            for k, v in zip(out, (row[3], row[4], row[5], said, verdict), strict=True):
                out[k].append(v)
            if len(out["id"]) >= 4096:
                yield out
                out = {k: [] for k in out}
        yield out

    return arrow_stream(rows, f"id {kind}, host string, path string, rule string, verdict string", judge, *cols).withColumnRenamed("id", key)


def url_verdicts(pages: DataFrame) -> DataFrame:
    """The query's columns, with the contract's rules."""
    rules = pages.sparkSession.createDataFrame(list(RULES), "action string, host string, path string")
    return judge_urls(pages.select(F.col("page_id").cast("long").alias("page_id"), "url"), rules)


SQL = f"""
WITH p AS (SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
q AS (SELECT page_id, coalesce(rest, '') AS rest, coalesce(regexp_extract(rest, '^[^/?#]*'), '') AS raw FROM p),
r AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM q),
rules(action, rhost, rpath) AS (VALUES {", ".join(map(str, RULES))}),
fit AS (SELECT r.*, rhost || rpath AS rule, action, row_number() OVER (PARTITION BY page_id ORDER BY length(rhost || rpath) DESC, length(rhost) DESC) AS k
        FROM r LEFT JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT page_id, host, path, rule, coalesce(action, '{DEFAULT}') AS verdict FROM fit WHERE k = 1
"""
