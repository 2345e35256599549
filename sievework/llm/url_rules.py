"""URL block and allow rules by a sort-merge range join.

A rule (host, path) fits its host and all subdomains where the URL's path starts with the rule's. A host's canonical
key is its labels reversed, each followed by a point: example.net is net.example. , so a host and its subdomains
are exactly the keys with that prefix, the interval [key, key with its last point replaced by a slash). Rules and URLs
are dealt to BUCKETS ranges of keys, a rule to each range that its interval meets; a range is sorted by key, rules first,
and swept once: a stack holds the nested hosts whose intervals contain the sweep's position, and a URL takes from them
the longest rule (host and path together; the longer host on ties, block before allow) whose path fits.

The ranges' bounds come from a bounded sample of keys, which decides balance alone. A key that fills several bounds by
itself (one host may have a third of all URLs) is dealt over all the ranges that it fills, with its rules in each.
A rule is copied only to ranges that it spans, so copies are at most rules + depth of nesting times ranges.

A null URL, or one without "://", has an empty host and path and fits no rule. A path that is empty starts with no rule's.
Repeated rows and ids are judged alike, empty tables give empty ones; columns besides id and url aren't read.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import map_arrow

#: Keys sampled for the bounds of the ranges, at most.
SAMPLE = 20_000
DEFAULT = "allow"
Rule = tuple[str, str, str]  # host, path, verdict


def url_host(url: Column) -> Column:
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*((?:/[^?#]*)?)", 1), F.lit(""))


def key_of(host: str) -> str:
    return "".join(label + "." for label in reversed(host.split("."))) if host else ""


def _key(host: Column) -> Column:
    return F.when(host == "", "").otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit(".")))


class Sweep:
    """Keys in ascending order against rules in ascending order of (key): a stack of the hosts that contain the key."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, dict[str, tuple[int, str, str]], list[int]]] = []

    def _close(self, key: str) -> None:
        while self.stack and not key.startswith(self.stack[-1][0]):
            self.stack.pop()

    def open(self, key: str, host: str, path: str, verdict: str) -> None:
        self._close(key)
        if not self.stack or self.stack[-1][0] != key:
            self.stack.append((key, {}, []))
        _, paths, lengths = self.stack[-1]
        if path not in paths or paths[path][2] != "block":
            paths[path] = (len(host), host + path, verdict)
        if len(path) not in lengths:
            lengths.append(len(path))
            lengths.sort(reverse=True)

    def judge(self, key: str, path: str) -> tuple[str | None, str | None]:
        self._close(key)
        best = None
        for k, paths, lengths in reversed(self.stack):
            for n in lengths:
                if n <= len(path) and (r := paths.get(path[:n])):
                    if best is None or (len(r[1]), r[0]) > (len(best[1]), best[0]):
                        best = r
                    break
        return (best[1], best[2]) if best else (None, None)


def _sweep(names: list[str], id_kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sweep, here = Sweep(), None
        for batch in batches:
            out: list[tuple] = []
            cols = [batch.column(c).to_pylist() for c in ("bucket", "kind", "key", "id", "host", "path", "verdict")]
            for bucket, kind, key, id_, host, path, verdict in zip(*cols):
                if bucket != here:
                    sweep, here = Sweep(), bucket
                if kind == 0:
                    sweep.open(key, host, path, verdict)
                else:
                    rule, said = sweep.judge(key, path) if key else (None, None)
                    out.append((id_, host, path, rule, said or DEFAULT))
            cols = list(zip(*out)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], id_kind), *[pa.array(c, pa.string()) for c in cols[1:]]], names)

    return run


def rules_table(spark: SparkSession, rules: Sequence[Rule]) -> DataFrame:
    return spark.createDataFrame(list(rules), "host string, path string, verdict string")


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict). rules: host, path, verdict; hosts in lower case."""
    spark = pages.sparkSession
    urls = pages.select(pages[id_col].alias("id"), url_host(pages[url_col]).alias("host"), url_path(pages[url_col]).alias("path"))
    urls = urls.withColumn("key", _key(F.col("host")))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Bounds: about SAMPLE keys by a hash of the whole row, so that they are the same on every run.
    n = pages.count()
    some = urls.select("key").filter(F.pmod(F.xxhash64("id", "host", "path"), F.lit(max(1, n // SAMPLE))) == 0).limit(2 * SAMPLE)
    keys = sorted(r[0] for r in some.collect())
    bounds = [keys[len(keys) * k // parts] for k in range(1, parts)] if keys else []
    rules = rules.select("host", "path", "verdict").filter("host is not null and path is not null and verdict is not null").withColumn("key", _key(F.col("host")))
    id_kind = dict(urls.dtypes)["id"]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = batch.column("key").to_pylist()
            lo, hi = [bisect_left(bounds, k) for k in key], [bisect_right(bounds, k) for k in key]
            salt = np.asarray(batch.column("salt"))
            spot = np.array(lo, np.int64) + salt % (np.array(hi, np.int64) - np.array(lo, np.int64) + 1) if key else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(spot.astype(np.int32)), *[batch.column(c) for c in ("id", "host", "path", "key")]], ["bucket", "id", "host", "path", "key"])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = batch.column("key").to_pylist()
            where = [range(bisect_left(bounds, k), bisect_right(bounds, k[:-1] + "/") + 1) for k in key]
            who = pa.array([i for i, r in enumerate(where) for _ in r], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([b for r in where for b in r], pa.int32()), *[batch.column(c).take(who) for c in ("host", "path", "verdict", "key")]], ["bucket", "host", "path", "verdict", "key"])

    left = map_arrow(urls.withColumn("salt", F.pmod(F.xxhash64("id", "path"), F.lit(1 << 30))), deal, f"bucket int, id {id_kind}, host string, path string, key string")
    right = map_arrow(rules, spread, "bucket int, host string, path string, verdict string, key string")
    both = left.select("bucket", F.lit(1).alias("kind"), "key", "id", "host", "path", F.lit(None).cast("string").alias("verdict")).unionByName(right.select("bucket", F.lit(0).alias("kind"), "key", F.lit(None).cast(id_kind).alias("id"), "host", "path", "verdict"))
    both = both.repartition(parts, "bucket").sortWithinPartitions("bucket", "key", "kind")
    names = [id_col, "host", "path", "rule", "verdict"]
    from pyspark.sql.pandas.types import to_arrow_type

    return map_arrow(both, _sweep(names, to_arrow_type(urls.schema["id"].dataType)), f"`{id_col}` {id_kind}, host string, path string, rule string, verdict string")


RULES: list[Rule] = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]

#: DuckDB SQL of judge_urls() over RULES.
SQL = """
WITH u AS (SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*((?:/[^?#]*)?)', 1), '') AS path FROM pages),
r(h, p, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
m AS (SELECT page_id, u.host, u.path, h || p AS rule, v, row_number() OVER (PARTITION BY page_id ORDER BY length(h || p) DESC, length(h) DESC) AS k
  FROM u JOIN r ON (u.host = h OR u.host LIKE '%.' || h) AND starts_with(u.path, p))
SELECT u.page_id, u.host, u.path, m.rule, coalesce(m.v, 'allow') AS verdict FROM u LEFT JOIN m ON u.page_id = m.page_id AND m.k = 1
"""
