"""SimHash near-duplicate detection with covering locality-sensitive hashing.

Fingerprints within ``radius`` bits always meet in some table: bit i of the fingerprint gets a
vector m(i) of radius+1 bits, and the table of each non-zero vector v keeps the bits with
m(i)·v = 1 (mod 2). Any ``radius`` differing bits leave a v that is orthogonal to all of their
vectors, so in v's table none of them is looked at and the pair shares a key. That is a
guarantee and not a probability, and there are 2^(radius+1)-1 tables.

Copies cost nothing: tables hold distinct fingerprints. Within a bucket no list of all pairs is
made: its own components are found and one edge a member (a path) leaves the task. A bucket with more
than ``heavy`` fingerprints is dealt out again by a second covering over the bits that its key
doesn't hold; what remains then has 2^(64 - bits of both keys) members at most.

Defined results: a null or empty text has no words and the fingerprint zero; a null id is linked
like any other but never names a component while a member has an id; repeated rows give repeated rows.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import columns_of, discard, fresh, given_back, may_be_in, small_batches, stored
from tidewatch.llm.components import components

#: Production parameters: words in a shingle, hash seed, linked distance, bucket size from which a second covering deals anew.
SHINGLE, SEED, RADIUS, HEAVY = 4, 42, 4, 2048
HASHES_AT_ONCE = 1 << 15


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """A bit is 1 where over half of the shingles' hashes have it."""
    import xxhash

    words = text.lower().split()  # of bytes: A-Z only, ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    k = min(shingle, len(words))
    last = ends[k - 1 :].tolist()
    first = [0, *(ends[: len(last) - 1] + 1).tolist()]
    n, digest, sums = len(last), xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, n, HASHES_AT_ONCE):
        hashes = np.array([digest(joined[i:j], seed) for i, j in zip(first[at : at + HASHES_AT_ONCE], last[at : at + HASHES_AT_ONCE], strict=True)], np.uint64)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        sums += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * sums > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long of the same bits."""
    small_batches(docs.sparkSession)

    def work(batches):
        for batch in given_back(batches):
            texts = batch.column(1).cast(pa.large_binary())
            fps = np.fromiter((fingerprint(t.as_buffer().to_pybytes() if t.is_valid else b"", shingle, seed) for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col(key).alias("doc_id"), text).mapInArrow(work, f"doc_id {docs.schema[key].dataType.simpleString()}, fp long")


@functools.lru_cache
def covering(radius: int, bits: int, seed: int) -> np.ndarray:
    """Masks over ``bits`` positions, as 0/1 rows: every set of ``radius`` positions is missed by one of them.

    Bit vectors are dealt round-robin from a shuffled list of the non-zero ones, so each is used evenly.
    """
    width = radius + 1
    rng = np.random.default_rng(seed)
    deal = np.concatenate([rng.permutation(np.arange(1, 1 << width)) for _ in range(-(-bits // ((1 << width) - 1)))])[:bits]
    vectors = np.arange(1, 1 << width)
    return (np.bitwise_count(vectors[:, None] & deal[None, :]) & 1).astype(np.uint8)


def masks(radius: int) -> list[int]:
    return [int(sum(1 << i for i in np.flatnonzero(row).tolist())) for row in covering(radius, 64, 1)]


def submasks(mask: int, radius: int) -> list[int]:
    """A second covering, over the bits that ``mask`` leaves out."""
    free = [i for i in range(64) if not mask >> i & 1]
    return [int(sum(1 << free[i] for i in np.flatnonzero(row).tolist())) for row in covering(radius, len(free), 2)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def tree(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Edges that connect just what links of ``radius`` bits or fewer connect, one a member at most.

    A member joins a group through one link; groups that it links to are joined too. Members that
    are already in its group are not compared again, so a bucket of near copies costs little.
    """
    n = len(fps)
    bits = fps.view(np.uint64)
    group = np.full(n, -1, np.int64)
    edges, groups = [], 0
    for i in range(n):
        if group[i] >= 0:
            continue
        group[i] = groups
        front = [i]
        rest = np.flatnonzero(group < 0)
        while front and len(rest):
            x = front.pop()
            near = np.bitwise_count(bits[rest] ^ bits[x]) <= radius
            found = rest[near]
            group[found] = groups
            rest = rest[~near]
            front.extend(found.tolist())
        groups += 1
    for members in (np.flatnonzero(group == g) for g in range(groups)):
        if len(members) > 1:
            own = np.sort(fps[members])
            edges.extend(zip(own[:-1].tolist(), own[1:].tolist(), strict=True))
    return edges


def _buckets(radius: int, heavy: int | None):
    """Over rows (t, k, fp) sorted by bucket: the tree's edges of each; members of heavy ones are
    handed on one by one, as rows (t, fp, null)."""
    schema = pa.schema([("t", pa.int32()), ("a", pa.int64()), ("b", pa.int64())])

    def rows(t, a, b):
        return pa.RecordBatch.from_arrays([pa.array(t, pa.int32()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=schema)

    def work(batches):
        held = (np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64))
        open_heavy = None
        for batch in batches:
            t, k, fp = (np.concatenate([h, batch.column(i).to_numpy(zero_copy_only=False)]) for i, h in enumerate(held))
            cuts = np.flatnonzero((t[1:] != t[:-1]) | (k[1:] != k[:-1])) + 1
            starts = np.concatenate([[0], cuts])
            ends = np.concatenate([cuts, [len(t)]])
            out_t, out_a, out_b = [], [], []
            for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
                last = e == len(t)
                bucket = (t[s], k[s])
                if heavy and (bucket == open_heavy or e - s > heavy):
                    out_t.append(np.full(e - s, t[s]))
                    out_a.append(fp[s:e])
                    out_b.append(None)
                    open_heavy = bucket
                    if last:
                        s = e
                if last:
                    held = (t[s:e], k[s:e], fp[s:e])
                elif e - s > 1 and bucket != open_heavy:
                    if found := tree(fp[s:e], radius):
                        pairs = np.array(found, np.int64)
                        out_t.append(np.full(len(pairs), -1))
                        out_a.append(pairs[:, 0])
                        out_b.append(pairs[:, 1])
            for a, b, c in zip(out_t, out_a, out_b, strict=True):
                yield rows(a, b, c if c is not None else [None] * len(a))
        t, k, fp = held
        if len(fp) > 1 and (found := tree(fp, radius)):
            pairs = np.array(found, np.int64)
            yield rows(np.full(len(pairs), -1), pairs[:, 0], pairs[:, 1])

    return work


def _keyed(fps: DataFrame, radius: int) -> DataFrame:
    """Each fingerprint under its key in every table of the first covering."""
    made = F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("k")) for t, m in enumerate(masks(radius))])
    return fps.select("fp", F.inline(made))


def _keyed_again(heavy: DataFrame, radius: int) -> DataFrame:
    """Members of heavy buckets under their keys in the second covering of their table."""
    out = None
    for t, m in enumerate(masks(radius)):
        made = F.array(*[F.struct(F.lit(t * 64 + u).alias("t"), F.col("fp").bitwiseAND(F.lit(signed(m | s))).alias("k")) for u, s in enumerate(submasks(m, radius))])
        part = heavy.where(F.col("t") == t).select("fp", F.inline(made))
        out = part if out is None else out.unionByName(part)
    return out


def _linked(keyed: DataFrame, radius: int, heavy: int | None) -> DataFrame:
    dealt = keyed.select("t", "k", "fp").repartition("t", "k").sortWithinPartitions("t", "k")
    return dealt.mapInArrow(_buckets(radius, heavy), "t int, a long, b long")


def links(fps: DataFrame, radius: int = RADIUS, heavy: int = HEAVY) -> DataFrame:
    """``fps`` (fp, distinct) -> edges (a, b) that connect exactly the fingerprints that links connect."""
    first = stored(_linked(_keyed(fps, radius), radius, heavy), "links")
    edges = first.where("b is not null").select("a", "b")
    crowded = first.where("b is null").select("t", F.col("a").alias("fp"))
    if crowded.limit(1).count():
        edges = edges.unionByName(_linked(_keyed_again(crowded, radius), radius, None).select("a", "b"))
    return edges


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED, radius: int = RADIUS, heavy: int = HEAVY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: doc_id, fingerprint (16 hex digits) and component_id, the smallest doc_id
    that links reach, its own included."""
    marked = stored(fingerprints(docs, shingle, seed, key, text), "fingerprints")
    distinct = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = components(links(distinct.select("fp"), radius, heavy))
    whole = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    whole = stored(whole, "roots")
    least = whole.groupBy("root").agg(F.min("least").alias("component_id"))
    named = stored(whole.where("root <> fp").join(least, "root").select("fp", "component_id").unionByName(
        whole.where("root = fp").select("fp").join(least.withColumnRenamed("root", "fp"), "fp").select("fp", "component_id")), "named")
    discard(whole)
    return marked.join(named, "fp", "left").select(F.col("doc_id").alias(key), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One document of each component, the one with the smallest id, with all its columns. Rows that share an id are one
    document, which stays or goes as a whole: each of its different texts once. Rows without an id can't be named and stay."""
    return first_of_components(docs, near_duplicates(docs, key=key, text=text, **options), key, text)


def first_of_components(docs: DataFrame, found: DataFrame, key: str, text: str) -> DataFrame:
    """The rows of ``docs`` whose id names a component in ``found`` (``key``, component_id), and those without an id."""
    named = stored(found.select(F.col(key).alias("doc_id"), "component_id").where("doc_id is not null"), "components")
    # of rows with the same id and different texts, one may name its component and another not: the document stays
    per = named.groupBy("doc_id").agg(F.bool_or(F.col("doc_id") == F.col("component_id")).alias("first"), F.count("*").alias("n"))
    per = stored(per.where(~F.col("first") | (F.col("n") > 1)), "components_apart")
    gone = per.where(~F.col("first")).select("doc_id")
    # most rows are known to stay by a filter of bounded size; only those that may go are shuffled to know
    mark = fresh(docs, "gone")
    marked = may_be_in(docs, key, gone, mark)
    sure, unsure = marked.where(~F.col(mark)).select(*columns_of(docs)), marked.where(mark).select(*columns_of(docs))
    kept = sure.unionByName(unsure.join(gone.withColumnRenamed("doc_id", f"{mark}_id").hint("merge"), F.col(key) == F.col(f"{mark}_id"), "left_anti"))
    again = per.where(F.col("first") & (F.col("n") > 1)).select("doc_id")
    if not again.limit(1).count():
        return kept
    # ids of several rows: each text once, the row whose other columns come first by their hash
    twice = kept.join(again.withColumnRenamed("doc_id", f"{mark}_id").hint("merge"), F.col(key) == F.col(f"{mark}_id"), "left_semi")
    once = kept.join(again.withColumnRenamed("doc_id", f"{mark}_id").hint("merge"), F.col(key) == F.col(f"{mark}_id"), "left_anti")
    row = F.struct(*columns_of(docs))
    one = twice.groupBy(key, text).agg(F.min_by(row, F.xxhash64(F.to_json(row))).alias(mark)).select(f"{mark}.*")
    return once.unionByName(one)
