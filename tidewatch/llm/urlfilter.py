"""URL verdicts: allow and block rules first, then exact list membership by a cascade of Bloom filters.

The cascade is built over the complete universe of keys (the corpus's distinct hosts): level 0
holds the listed keys, level 1 the unlisted keys that level 0 lets through, level 2 the listed
keys that level 1 lets through, and so on until nothing passes wrongly. A key's membership
is then known from the level at which it drops out, for every key of the universe exactly, and
the pages themselves are never joined with the list.

The list is a table of hosts, each standing for its subdomains too. It meets the distinct hosts alone, by equality with
their suffixes.

Keys are dealt to shards by hash and each shard has a cascade of its own, so that a filter's size
is bounded whatever the number of hosts. Filters are broadcast while all of them together are
below ``BROADCAST_BYTES``; beyond that the URLs go to their shards, a popular one's dealt to several tasks, and each task loads one.

Defined results: a null url, or one without "://", has an empty host and path and no rule, and
the empty host isn't listed; repeated rows give repeated rows; null and empty hosts in the list mean nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.llm.common import may_be_in, stored

#: (action, host, path). The longest rule that fits decides.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: The list whose hosts, with their subdomains, the method blocks.
LISTED = ("casino-win.example.com", "free-bets.example.com", "spam-farm.example.com", "cheap-pills.example.com", "ads-track.example.com", "adult-x.example.net", "cheap-pills.example.net", "theren.example.org")
#: Bits for each key of a level, hash functions, keys in a shard at most on average, bytes of all filters that are broadcast.
BITS_PER_KEY, HASHES, SHARD_KEYS, BROADCAST_BYTES = 6, 3, 1 << 18, 64 << 20
#: Levels at most, URLs that one task takes beyond the broadcast, seeds that are tried where two hosts share a hash.
MAX_LEVELS, GROUP_URLS, SEEDS = 64, 1 << 17, 8


def host_of(url: Column) -> Column:
    found = F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as written, and its action."""
    name = action = F.lit(None).cast("string")
    for act, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        name, action = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(act)).otherwise(action)
    return name, action


def marked(hosts: DataFrame, names: DataFrame) -> DataFrame:
    """``hosts`` (host, distinct) with ``listed``: does ``names`` (host) hold it or a domain above it?"""
    names = stored(names.select(F.lower("host").alias("name")).where("name <> ''").distinct(), "names")
    parts = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    # suffixes such as "com" are very many hosts': those that the list can't hold go first
    rows = may_be_in(hosts.select("host", F.explode(suffixes).alias("suffix")), "suffix", names, "likely").where("likely")
    found = rows.join(names, F.col("suffix") == F.col("name"), "left_semi").select(F.col("host").alias("found")).distinct()
    return hosts.join(found, F.col("host") == F.col("found"), "left").select("host", F.col("found").isNotNull().alias("listed"))


def _places(hashes: np.ndarray, level: int, bits: int, k: int = HASHES) -> np.ndarray:
    """k bit places for each 64-bit key hash: double hashing, mixed anew for each level."""
    with np.errstate(over="ignore"):
        x = hashes.astype(np.uint64) + np.uint64((level + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        step = (x >> np.uint64(32)) | np.uint64(1)
        return ((x[:, None] + np.arange(k, dtype=np.uint64) * step[:, None]) % np.uint64(bits)).astype(np.int64)


def _filter(hashes: np.ndarray, level: int, bits_per_key: int) -> np.ndarray:
    bits = max(64, -(-len(hashes) * bits_per_key // 8) * 8)
    made = np.zeros(bits, bool)
    made[_places(hashes, level, bits).ravel()] = True
    return np.packbits(made)


def _passes(filter_: np.ndarray, hashes: np.ndarray, level: int) -> np.ndarray:
    places = _places(hashes, level, 8 * len(filter_))
    return ((filter_[places >> 3] >> (7 - (places & 7)).astype(np.uint8)) & 1).all(axis=1)


def cascade(inside: np.ndarray, outside: np.ndarray, bits_per_key: int = BITS_PER_KEY) -> list[np.ndarray]:
    """Levels over a universe that is ``inside`` and ``outside`` (64-bit hashes, distinct)."""
    levels: list[np.ndarray] = []
    held, others = inside, outside
    while len(held):
        if len(levels) == MAX_LEVELS:
            raise ValueError("the cascade does not end: two keys of the universe share a hash")
        levels.append(_filter(held, len(levels), bits_per_key))
        held, others = others[_passes(levels[-1], others, len(levels) - 1)], held
    return levels


def member(levels: list[np.ndarray], hashes: np.ndarray) -> np.ndarray:
    """A key is listed if it drops out at an odd level, or passes all of an odd number of levels."""
    verdict = np.zeros(len(hashes), bool)
    live = np.arange(len(hashes))
    for i, level in enumerate(levels):
        live = live[_passes(level, hashes[live], i)]
        verdict[live] = i % 2 == 0
    return verdict


def build(keys: DataFrame, shards: int) -> DataFrame:
    """``keys`` (hash long, listed boolean; distinct) -> (shard, levels array<binary>)."""

    def work(table: pa.Table) -> pa.Table:
        hashes, inside = table.column("hash").to_numpy().view(np.uint64), table.column("listed").to_numpy(zero_copy_only=False)
        levels = cascade(hashes[inside], hashes[~inside])
        return pa.table({"shard": pa.array([table.column("shard")[0].as_py()], pa.int32()), "levels": pa.array([[x.tobytes() for x in levels]], pa.list_(pa.binary()))})

    dealt = keys.withColumn("shard", F.pmod("hash", F.lit(shards)).cast("int"))
    return dealt.groupBy("shard").applyInArrow(work, "shard int, levels array<binary>")


def _apply(rows: DataFrame, hash_name: str, filters: dict[int, list[bytes]], shards: int, out: str) -> DataFrame:
    """``rows`` with a boolean column ``out``: membership of the key whose hash is in ``hash_name``."""
    shared = rows.sparkSession.sparkContext.broadcast(filters)

    def work(batches):
        ready = {s: [np.frombuffer(x, np.uint8) for x in levels] for s, levels in shared.value.items()}
        for batch in batches:
            hashes = batch.column(batch.schema.get_field_index(hash_name)).to_numpy().view(np.int64)
            shard, verdict = np.mod(hashes, shards), np.zeros(len(hashes), bool)
            for s in np.unique(shard).tolist():
                at = np.flatnonzero(shard == s)
                verdict[at] = member(ready.get(s, []), hashes[at].view(np.uint64))
            yield batch.append_column(out, pa.array(verdict))

    return rows.mapInArrow(work, T.StructType([*rows.schema.fields, T.StructField(out, T.BooleanType())]))


def judge(pages: DataFrame, rules=RULES, names: DataFrame | None = None, key: str = "page_id", url: str = "url", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One row a page: its id, host, path, the rule that fits and the verdict. ``names`` (host) is the list; LISTED if none is given."""
    if names is None:
        names = pages.sparkSession.createDataFrame([(n,) for n in LISTED], "host string")
    seen = pages.select(pages[key].alias("page_id"), host_of(pages[url]).alias("host"), path_of(pages[url]).alias("path"))
    # the universe: partial aggregation leaves one row a task for a host, however common
    hosts = stored(marked(seen.groupBy("host").agg(F.lit(1).alias("one")).select("host"), names), "hosts")
    for seed in range(SEEDS):
        hashed = F.xxhash64(F.lit(seed), "host")
        universe = hosts.groupBy(hashed.alias("hash")).agg(F.bool_or("listed").alias("listed"), F.bool_and("listed").alias("all_listed"))
        totals = universe.agg(F.count("*").alias("n"), F.count_if(F.col("listed") != F.col("all_listed")).alias("mixed")).first()
        if not totals["mixed"]:
            break
    else:
        raise ValueError(f"a listed and an unlisted host share a 64-bit hash under each of {SEEDS} seeds")
    seen = seen.withColumn("hash", hashed)
    shards = max(1, -(-totals["n"] // SHARD_KEYS))
    built = stored(build(universe.select("hash", "listed"), shards), "cascade")
    size = built.agg(F.sum(F.aggregate("levels", F.lit(0).cast("long"), lambda s, x: s + F.octet_length(x)))).first()[0] or 0
    name, action = rule_of(F.col("host"), F.col("path"), rules)
    if size <= broadcast_bytes:
        filters = {r["shard"]: [bytes(x) for x in r["levels"]] for r in built.collect()}
        judged = _apply(seen, "hash", filters, shards, "listed")
    else:
        judged = _apply_sharded(seen, built, shards)
    verdict = F.coalesce(action, F.when(F.col("listed"), "block").otherwise("allow"))
    return judged.select(F.col("page_id").alias(key), "host", "path", name.alias("rule"), verdict.alias("verdict"), "listed")


def _apply_sharded(seen: DataFrame, built: DataFrame, shards: int, per_group: int = GROUP_URLS) -> DataFrame:
    """Where the filters are too large to send everywhere: rows go to their shard's cascade. A shard is dealt to as many
    groups as its own rows ask for, and its filters are sent to each."""
    rows = seen.withColumn("shard", F.pmod("hash", F.lit(shards)).cast("int"))
    # a row a shard, that is for each SHARD_KEYS hosts
    groups = stored(rows.groupBy("shard").agg(F.ceil(F.count("*") / F.lit(per_group)).cast("int").alias("salts")), "groups")
    rows = rows.join(F.broadcast(groups), "shard").withColumn("salt", F.pmod(F.xxhash64(*seen.columns), F.col("salts")).cast("int")).drop("salts")
    levels = built.join(groups, "shard").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        hashes = left.column("hash").to_numpy()
        found = [np.frombuffer(x, np.uint8) for x in right.column("levels")[0].as_py()] if len(right) else []
        return left.drop_columns(["shard", "salt"]).append_column("listed", pa.array(member(found, hashes.view(np.uint64))))

    out = T.StructType([*seen.schema.fields, T.StructField("listed", T.BooleanType())])
    return rows.groupBy("shard", "salt").cogroup(levels.groupBy("shard", "salt")).applyInArrow(work, out)
