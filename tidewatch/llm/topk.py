"""Exact top-k search by inner product over a pivot-distance index.

Vectors become integers and get one more coordinate, so that all have the same length R: then
|x - q|^2 = R^2 + |q|^2 - 2 x.q, and the largest products are the smallest distances. Each vector is keyed by
its nearest pivot and its distance to it. Sorted by that key, and cut into blocks of bounded
size, the vectors of a pivot form annuli.

A query starts in the block that its own key falls into, which gives its k-th best score so far, and expands
over the annuli in order of their bounds: by the triangle inequality no vector at distance r of pivot p
is nearer than |d(q,p) - r|, so whatever lies beyond the k-th best distance is never looked at.
Queries travel in blocks too, and in two rounds. In the first a block of queries meets the nearest blocks of vectors of its nearest pivot;
the k-th best scores so far say how far its queries still reach. In the second only those blocks of vectors
are sent to it whose bounds are within that reach (:func:`needed`), nearest first, and it stops where the bounds say so. Nothing is
approximate: bounds carry a margin for rounding, and products are exact integers.

How much the bounds leave out depends on the vectors: of well-separated clusters most, of evenly spread ones in many dimensions nothing,
and then every block of queries meets every block of vectors. Blocks of queries grow with their number, up to ``MOST_QUERIES``, so
that the vectors are sent at most once for so many queries.

Pivots are fitted on a bounded sample (``SAMPLE`` rows by hash); every row is indexed.

Defined results: vectors that are null or hold null or non-finite components take no part, nor do
rows without id; shorter vectors count as padded by zeros; rows that share an id are never each other's
candidates; components beyond a long are clipped to it, and products are exact while they fit a long.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewatch.llm.common import stored

#: Production parameters: results, scale, rows of the pivot sample, pivots, rows of a block of vectors and of queries.
K, SCALE, SAMPLE, PIVOTS, BLOCK, QUERY_BLOCK = 20, 64.0, 4096, 32, 2048, 256
#: Rows of a block of queries at most, blocks of queries that are asked for before they grow, blocks of vectors in the first round.
MOST_QUERIES, QUERY_BLOCKS, NEAREST = 4096, 64, 2
LIMIT = float(1 << 62)
MARGIN = 1e-6


def integers(vectors: DataFrame, key: str, vector: str, scale: float) -> DataFrame:
    """(id, v): floor(scale * x) of every component, for the rows that take part."""
    v = F.transform(F.col("v"), lambda x: F.floor(F.greatest(F.least(x.cast("double") * scale, F.lit(LIMIT)), F.lit(-LIMIT))).cast("long"))
    whole = ~F.exists("v", lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull())
    return rows.where(whole).select("id", v.alias("v"))


def matrix(column, width: int) -> np.ndarray:
    """The rows of a list column, padded with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if len(sizes) and (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width)[None, :] < sizes[:, None]] = flat
    return out


def narrow(m: np.ndarray) -> np.ndarray:
    """The same integers in as few bytes each as hold them."""
    most = max(int(m.max(initial=0)), -int(m.min(initial=0)) - 1)
    return m.astype(next(f"i{b}" for b in (1, 2, 4, 8) if most < 1 << (8 * b - 1)))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T as exact integers: by doubles where every sum stays below 2^53."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 2.0**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    with np.errstate(over="ignore"):
        return a @ b.T


def norms(m: np.ndarray) -> np.ndarray:
    return (m.astype(np.float64) ** 2).sum(axis=1)


def lifted_distances(m: np.ndarray, lift: np.ndarray, pivots: np.ndarray, pivot_lift: np.ndarray) -> np.ndarray:
    """Distances of lifted vectors (m, lift) to lifted pivots."""
    x, p = np.hstack([m.astype(np.float64), lift[:, None]]), np.hstack([pivots, pivot_lift[:, None]])
    d = (x**2).sum(axis=1)[:, None] + (p**2).sum(axis=1)[None, :] - 2 * x @ p.T
    return np.sqrt(np.maximum(d, 0))


def fit_pivots(sample: np.ndarray, n: int, rounds: int = 5) -> np.ndarray:
    """Means of a few rounds of assignment, from spread starting points; bounded by the sample."""
    rng = np.random.default_rng(7)
    points = np.unique(sample.astype(np.float64), axis=0)
    centres = points[rng.permutation(len(points))[: min(n, len(points))]]
    for _ in range(rounds):
        d = (points**2).sum(axis=1)[:, None] + (centres**2).sum(axis=1)[None, :] - 2 * points @ centres.T
        own = d.argmin(axis=1)
        for c in np.unique(own):
            centres[c] = points[own == c].mean(axis=0)
    return np.unique(centres, axis=0)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, ties to smaller ids, in order."""
    at = np.arange(len(scores))
    if len(scores) > 4 * k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        above = np.flatnonzero(scores > edge)
        equal = np.flatnonzero(scores == edge)
        if len(equal) > k:
            equal = equal[np.argpartition(ids[equal], k - 1)[:k]]
        at = np.concatenate([above, equal])
    return at[np.lexsort((ids[at], -scores[at]))][:k]


def needed(asked: DataFrame, meta: DataFrame) -> DataFrame:
    """(qb, block, bound, home): which blocks of vectors a block of queries still needs.

    ``asked`` (qb, pivot, dmin, dmax, reach): the distances of its queries to each pivot, and how far they reach. ``meta`` (block, pivot, inner, outer).
    """
    bound = F.greatest(F.lit(0.0), F.col("inner") - F.col("dmax"), F.col("dmin") - F.col("outer"))
    home = F.abs((F.col("inner") + F.col("outer")) / 2 - (F.col("dmin") + F.col("dmax")) / 2)
    return asked.join(meta, "pivot").where(bound <= F.col("reach")).select("qb", "block", bound.alias("bound"), home.alias("home"))


def search(vectors: DataFrame, is_query, k: int = K, scale: float = SCALE, pivots: int | None = None, block: int = BLOCK, query_block: int | None = None, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``is_query``: a function of the id column. Returns query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    out = "query_id long, rank int, vec_id long, score long"
    rows = integers(vectors, key, vector, scale)
    squares = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    top = rows.agg(F.max(F.size("v")).alias("width"), F.max(squares).alias("norm"), F.count("*").alias("n")).first()
    if not top["n"]:
        return spark.createDataFrame([], out)
    width, radius2 = max(1, top["width"]), top["norm"] * (1 + 1e-9)
    # a hash threshold leaves about SAMPLE rows; the limit is on the sample for the pivots alone
    share = min(1.0, SAMPLE / top["n"])
    sampled = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) <= int(share * (1 << 30))).select("v").limit(2 * SAMPLE).toArrow()
    if not sampled.num_rows:
        sampled = rows.select("v").limit(SAMPLE).toArrow()
    # the blocks of a pivot and the pivots grow alike
    pivots = pivots or max(PIVOTS, min(SAMPLE // 4, int((top["n"] / block) ** 0.5)))
    centres = fit_pivots(matrix(sampled.column("v"), width), pivots)
    centre_lift = np.sqrt(np.maximum(radius2 - (centres**2).sum(axis=1), 0))

    def keyed(batches):
        for batch in batches:
            m = matrix(batch.column("v"), width)
            d = lifted_distances(m, np.sqrt(np.maximum(radius2 - norms(m), 0)), centres, centre_lift)
            own = d.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), pa.array(own.astype(np.int32)), pa.array(d[np.arange(len(m)), own])], names=["id", "v", "pivot", "r"])

    # ranges of (pivot, distance, id) are even whatever the pivots hold
    parts = max(1, -(-top["n"] // (4 * block)))
    with_keys = rows.mapInArrow(keyed, "id long, v array<long>, pivot int, r double")
    placed = with_keys.repartitionByRange(parts, "pivot", "r", "id").sortWithinPartitions("pivot", "r", "id")

    def blocks(batches):
        held: pa.Table | None = None

        def made(t: pa.Table):
            m, r = narrow(matrix(t.column("v"), width)), t.column("r").to_numpy()
            row = {"bytes": m.itemsize, "pivot": t.column("pivot")[0].as_py(), "inner": float(r[0]), "outer": float(r[-1]), "n": len(r), "ids": t.column("id").to_numpy().tobytes(), "r": r.tobytes(), "m": m.tobytes()}
            return row

        def cut(t: pa.Table, final: bool):
            rows_ = []
            pivot = t.column("pivot").to_numpy()
            ends = [*(np.flatnonzero(pivot[1:] != pivot[:-1]) + 1).tolist(), t.num_rows]
            start = 0
            for end in ends:
                while end - start >= block:
                    rows_.append(made(t.slice(start, block)))
                    start += block
                if start < end and (final or end < t.num_rows):
                    rows_.append(made(t.slice(start, end - start)))
                    start = end
            return rows_, t.slice(start)

        schema = pa.schema([("bytes", pa.int32()), ("pivot", pa.int32()), ("inner", pa.float64()), ("outer", pa.float64()), ("n", pa.int32()), ("ids", pa.binary()), ("r", pa.binary()), ("m", pa.binary())])
        for batch in batches:
            t = pa.Table.from_batches([batch])
            held = t if held is None else pa.concat_tables([held, t]).combine_chunks()
            done, held = cut(held, False)
            for row in done:
                yield pa.RecordBatch.from_pylist([row], schema=schema)
        if held is not None and held.num_rows:
            for row in cut(held, True)[0]:
                yield pa.RecordBatch.from_pylist([row], schema=schema)

    index = placed.mapInArrow(blocks, "bytes int, pivot int, inner double, outer double, n int, ids binary, r binary, m binary")
    index = stored(index.withColumn("block", F.expr("uuid()")), "index")

    # queries, sorted like the index: neighbours share a block
    asked = with_keys.where(is_query(F.col("id")))
    n_asked = rows.where(is_query(F.col("id"))).count()
    if not n_asked:
        return spark.createDataFrame([], out)
    query_block = query_block or max(QUERY_BLOCK, min(MOST_QUERIES, n_asked // QUERY_BLOCKS))
    groups = max(1, -(-n_asked // query_block))

    def query_blocks(batches):
        schema = pa.schema([("n", pa.int32()), ("ids", pa.binary()), ("m", pa.binary()), ("near", pa.list_(pa.float64()))])
        held = None

        def made(t: pa.Table):
            m = matrix(t.column("v"), width)
            # queries are lifted by 0: |q - x|^2 = |q|^2 + R^2 - 2 q.x
            d = lifted_distances(m, np.zeros(len(m)), centres, centre_lift)
            near = np.concatenate([d.min(axis=0), d.max(axis=0)])
            return pa.RecordBatch.from_pylist([{"n": len(m), "ids": t.column("id").to_numpy().tobytes(), "m": m.tobytes(), "near": near.tolist()}], schema=schema)

        for batch in batches:
            t = pa.Table.from_batches([batch])
            held = t if held is None else pa.concat_tables([held, t]).combine_chunks()
            while held.num_rows >= query_block:
                yield made(held.slice(0, query_block))
                held = held.slice(query_block)
        if held is not None and held.num_rows:
            yield made(held)

    spread = asked.repartitionByRange(groups, "pivot", "r", "id").sortWithinPartitions("pivot", "r", "id")
    queries = stored(spread.mapInArrow(query_blocks, "n int, ids binary, m binary, near array<double>").withColumn("qb", F.expr("uuid()")), "queries")

    n_pivots = len(centres)
    by_pivot = queries.select("qb", F.posexplode(F.slice("near", 1, n_pivots)).alias("pivot", "dmin"), F.slice("near", n_pivots + 1, n_pivots).alias("far"))
    by_pivot = by_pivot.withColumn("dmax", F.col("far")[F.col("pivot")]).drop("far")
    meta = index.select("block", "pivot", "inner", "outer")

    def stream(visits: DataFrame, asked: DataFrame) -> DataFrame:
        """A block of queries (with the scores ``floor`` that it has to reach), then its blocks of vectors, nearest first."""
        none = lambda kind: F.lit(None).cast(kind)
        met = visits.join(index, "block").select("qb", "bound", "home", "pivot", "bytes", "ids", "r", "m", none("binary").alias("q_ids"), none("binary").alias("q_m"), none("binary").alias("floor"))
        start = asked.select("qb", F.lit(-1.0).alias("bound"), F.lit(-1.0).alias("home"), F.lit(-1).alias("pivot"), F.lit(8).alias("bytes"), *[none("binary").alias(c) for c in ("ids", "r", "m")], F.col("ids").alias("q_ids"), F.col("m").alias("q_m"), "floor")
        return met.unionByName(start).repartition("qb").sortWithinPartitions("qb", "bound", "home")

    def reach_of(now) -> np.ndarray:
        """The distance within which a query still needs vectors, from its k-th best score."""
        reach = np.sqrt(np.maximum(radius2 + now["norm"] - 2 * now["floor"], 0)) * (1 + MARGIN) + MARGIN
        reach[now["floor"] == -np.inf] = np.inf
        return reach

    def expand(batches, first: bool):
        """Rows come sorted: a query block, then its annuli in order of their bounds. The first round gives each block's reach."""
        now = None

        def result():
            if first:
                return pa.RecordBatch.from_arrays([pa.array([now["qb"]]), pa.array([float(reach_of(now).max())]), pa.array([now["floor"].tobytes()], pa.binary())], names=["qb", "reach", "floor"])
            ids, found_ids, found = now["ids"], now["found_ids"], now["found"]
            q, r, i, s = [], [], [], []
            for x in range(len(ids)):
                at = best(found[x], found_ids[x], k)
                q += [ids[x]] * len(at)
                r += range(1, len(at) + 1)
                i += found_ids[x][at].tolist()
                s += found[x][at].tolist()
            return pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(r, pa.int32()), pa.array(i, pa.int64()), pa.array(s, pa.int64())], names=["query_id", "rank", "vec_id", "score"])

        for batch in batches:
            for row in batch.to_pylist():
                if row["pivot"] < 0:
                    if now is not None:
                        yield result()
                    ids, m = np.frombuffer(row["q_ids"], np.int64), np.frombuffer(row["q_m"], np.int64).reshape(-1, width)
                    n = len(ids)
                    now = {"ids": ids, "m": m, "norm": norms(m), "d": lifted_distances(m, np.zeros(n), centres, centre_lift), "qb": row["qb"], "floor": np.full(n, -np.inf) if row["floor"] is None else np.frombuffer(row["floor"]).copy(), "found": [np.zeros(0, np.int64)] * n, "found_ids": [np.zeros(0, np.int64)] * n}
                    continue
                reach = reach_of(now)
                d, r = now["d"][:, row["pivot"]], np.frombuffer(row["r"], np.float64)
                live = np.flatnonzero((r[0] - d <= reach) & (d - r[-1] <= reach))
                if not len(live):
                    continue
                low = np.searchsorted(r, (d[live] - reach[live]).min(), "left")
                high = np.searchsorted(r, (d[live] + reach[live]).max(), "right")
                ids = np.frombuffer(row["ids"], np.int64)[low:high]
                m = np.frombuffer(row["m"], f"i{row['bytes']}").reshape(-1, width)[low:high].astype(np.int64)
                if not len(ids):
                    continue
                scores = products(now["m"][live], m)
                for x, line in zip(live.tolist(), scores, strict=True):
                    good = np.flatnonzero((line >= now["floor"][x]) & (ids != now["ids"][x]))
                    if not len(good):
                        continue
                    s, i = np.concatenate([now["found"][x], line[good]]), np.concatenate([now["found_ids"][x], ids[good]])
                    at = best(s, i, k)
                    now["found"][x], now["found_ids"][x] = s[at], i[at]
                    if len(at) == k:
                        now["floor"][x] = s[at[-1]]
        if now is not None:
            yield result()

    nearest = by_pivot.groupBy("qb").agg(F.min_by(F.struct("pivot", "dmin", "dmax"), F.struct("dmin", "pivot")).alias("p")).select("qb", "p.*", F.lit(float("inf")).alias("reach"))
    first = needed(nearest, meta).withColumn("n", F.row_number().over(W.partitionBy("qb").orderBy("bound", "home", "block"))).where(F.col("n") <= NEAREST)
    begun = stream(first, queries.withColumn("floor", F.lit(None).cast("binary"))).mapInArrow(lambda b: expand(b, True), "qb string, reach double, floor binary")
    begun = stored(begun, "reach")
    second = needed(by_pivot.join(begun.select("qb", "reach"), "qb"), meta)
    return stream(second, queries.join(begun.select("qb", "floor"), "qb")).mapInArrow(lambda b: expand(b, False), out)
