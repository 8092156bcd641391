"""URL rules by a cascade of Bloom filters.

Level 0 encodes the listed keys, level 1 those keys of the corpus that level 0
takes for listed, level 2 the listed keys that level 1 takes for such, and so on
until a level errs on nothing. A key of the corpus is listed exactly when the first
level that misses it is odd, so a scan needs the filters only and no join.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortwise.session import pinned

# Odd multipliers that mix 64-bit words.
_MIX_A, _MIX_B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_KEY = "key string, h1 long, h2 long"


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX_B
    return x ^ (x >> np.uint64(29))


@dataclass(frozen=True)
class Level:
    """One Bloom filter: ``size`` bits in 64-bit words, ``hashes`` bits per key."""

    depth: int
    size: int
    hashes: int
    words: np.ndarray = field(repr=False)

    def has(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        found = np.ones(len(h1), bool)
        for at in _bits(h1, h2, self.depth, self.size, self.hashes):
            found &= (self.words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1
        return found


def _bits(h1, h2, depth: int, size: int, hashes: int) -> Iterator[np.ndarray]:
    salt = np.full(1, depth + 1, np.uint64) * _MIX_A
    first, step = _mix(h1.view(np.uint64) ^ salt), _mix(h2.view(np.uint64) + salt) | np.uint64(1)
    for _ in range(hashes):
        yield first % np.uint64(size)
        first = first + step


@dataclass(frozen=True)
class Cascade:
    """Exact membership for every key of the corpus it was built over."""

    levels: tuple[Level, ...]

    def has(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        listed = np.zeros(len(h1), bool)
        open_ = np.arange(len(h1))
        for level in self.levels:
            open_ = open_[level.has(h1[open_], h2[open_])]
            listed[open_] = level.depth % 2 == 0
        return listed


def keyed(keys: DataFrame, col: str = "key") -> DataFrame:
    key = F.col(col).cast("string")
    return keys.where(F.col(col).isNotNull()).select(
        key.alias("key"), F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("second"), key).alias("h2")
    ).distinct()


def _level(keys: DataFrame, n: int, depth: int, bits_per_key: int, max_bytes: int) -> Level:
    size = max(64, -(-n * bits_per_key // 64) * 64)
    if size > 8 * max_bytes:
        raise ValueError(f"level {depth} needs {size // 8} bytes, more than max_bytes={max_bytes}")
    hashes = max(1, round(bits_per_key * 0.693))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h1, h2 = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            at = np.unique(np.concatenate(list(_bits(h1, h2, depth, size, hashes))))
            word, bit = (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63))
            starts = np.flatnonzero(np.diff(word, prepend=-1))
            bits = np.bitwise_or.reduceat(bit, starts) if len(starts) else bit
            yield pa.RecordBatch.from_arrays(
                [pa.array(word[starts]), pa.array(bits.view(np.int64))], ["word", "bits"]
            )

    rows = (
        keys.select("h1", "h2").mapInArrow(words, "word long, bits long")
        .groupBy("word").agg(F.bit_or("bits").alias("bits")).collect()
    )
    filled = np.zeros(size // 64, np.uint64)
    if rows:
        bits = np.array([r["bits"] for r in rows], np.int64).view(np.uint64)
        filled[[r["word"] for r in rows]] = bits
    return Level(depth, size, hashes, filled)


def _passing(keys: DataFrame, level: Level) -> DataFrame:
    shared = keys.sparkSession.sparkContext.broadcast(level)

    def passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h1, h2 = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
            yield batch.filter(pa.array(shared.value.has(h1, h2)))

    return keys.mapInArrow(passing, _KEY)


def build_cascade(
    listed: DataFrame,
    universe: DataFrame,
    bits_per_key: int = 10,
    max_bytes: int = 256 << 20,
) -> Cascade:
    """A cascade that tells listed keys from all other keys of ``universe``.

    Both frames have a column ``key``; nulls are dropped, repeated keys count once. The
    filter of level 0 takes ``bits_per_key`` bits for each listed key, later levels for
    each key that the level before errs on; a level above ``max_bytes`` raises ValueError,
    as the filters are sent to every executor. An empty list gives no level.
    """
    inside = pinned(keyed(listed))
    outside, levels = keyed(universe), []
    include, other = inside, outside
    while n := include.count():
        level = _level(include, n, len(levels), bits_per_key, max_bytes)
        levels.append(level)
        wrong = _passing(other, level)
        if len(levels) == 1:
            wrong = wrong.join(inside.select("key"), "key", "left_anti")
        include, other = pinned(wrong), include
    return Cascade(tuple(levels))


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z in lower case; else empty."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.coalesce(F.translate(host, upper, upper.lower()), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ? # or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _candidates(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """Keys that a rule of this shape could have, the longest first, then the longest host.

    A rule's host is the last labels of the page's host and its path the first characters
    of the page's path, so only the label counts and path lengths of the rules matter.
    """
    labels = sorted({h.count(".") + 1 for h, _, _ in rules}, reverse=True)
    lengths = sorted({len(p) for _, p, _ in rules}, reverse=True)
    has = F.size(F.split(host, r"\.", -1))
    keys = [
        F.when(
            (has >= n) & (F.length(path) >= length),
            F.struct(
                F.concat(F.substring_index(host, ".", -n), F.substring(path, 1, length)).alias("key"),
                F.length(F.substring_index(host, ".", -n)).alias("host_length"),
            ),
        )
        for n in labels
        for length in lengths
    ]
    order = lambda x, y: (
        F.when(F.length(x["key"]) != F.length(y["key"]), F.length(y["key"]) - F.length(x["key"]))
        .otherwise(y["host_length"] - x["host_length"])
    )
    return F.transform(F.array_sort(F.array_compact(F.array(*keys)), order), lambda k: k["key"])


def judge_urls(
    pages: DataFrame,
    rules: Sequence[tuple[str, str, str]],
    id_col: str = "page_id",
    url_col: str = "url",
    otherwise: str = "allow",
    bits_per_key: int = 10,
) -> DataFrame:
    """(id, host, path, rule, verdict) for every row of ``pages``.

    ``rules`` are (host, path, verdict) with verdict allow or block. A rule fits its host
    and all its subdomains if the page's path starts with the rule's; the longest rule wins,
    then the one with the longest host. Null urls and urls without :// have an empty host
    and path and fit no rule. Where no rule fits, the verdict is ``otherwise``. Repeated rows
    are judged alike; an empty table gives no rows; other columns are not read.
    """
    spark = pages.sparkSession
    url = F.col(url_col).cast("string")
    split = pages.select(
        F.col(id_col).alias("id"), host_of(url).alias("host"), path_of(url).alias("path")
    )
    listed = {v: [h + p for h, p, x in rules if x == v] for v in ("allow", "block")}
    if not any(listed.values()):
        return split.select(
            F.col("id").alias(id_col), "host", "path",
            F.lit(None).cast("string").alias("rule"), F.lit(otherwise).alias("verdict"),
        )
    asked = split.withColumn("keys", _candidates(F.col("host"), F.col("path"), rules))
    universe = asked.select(F.explode("keys").alias("key"))
    built = {
        verdict: build_cascade(
            spark.createDataFrame([(k,) for k in keys], "key string"), universe, bits_per_key
        )
        for verdict, keys in listed.items()
        if keys
    }
    shared = spark.sparkContext.broadcast(built)
    hashed = asked.select(
        "id", "host", "path", "keys",
        F.transform("keys", lambda k: F.xxhash64(k)).alias("h1"),
        F.transform("keys", lambda k: F.xxhash64(F.lit("second"), k)).alias("h2"),
    )

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            row = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
            h1, h2 = (batch.column(i).flatten().to_numpy(zero_copy_only=False) for i in (4, 5))
            keys = lists.flatten()
            rule, verdict = [None] * len(lists), [otherwise] * len(lists)
            hit = np.full(len(lists), len(row))
            for name, cascade in shared.value.items():
                at = np.flatnonzero(cascade.has(h1, h2))[::-1]
                first = np.full(len(lists), len(row))
                first[row[at]] = at
                for i in np.flatnonzero(first < hit):
                    rule[i], verdict[i] = keys[first[i]].as_py(), name
                hit = np.minimum(hit, first)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(rule, pa.string()), pa.array(verdict, pa.string())],
                ["id", "host", "path", "rule", "verdict"],
            )

    kind = split.schema["id"].dataType.simpleString()
    found = hashed.mapInArrow(
        judge, f"id {kind}, host string, path string, rule string, verdict string"
    )
    return found.withColumnRenamed("id", id_col)
