"""Vector best-fit packing of tokenized documents into fixed-length sequences.

A piece asks for a vector of capacities: its tokens, one document and its attention cost
(length squared). The bin that takes it is the one, among all in which every residual capacity
suffices, whose weighted residual norm is least after placing (``rule="norm"``), or whose
residuals have the largest weighted dot product with the request (``rule="dot"``).

Requests depend on lengths alone, so the best fit is decided for all pieces of a length and all
bins of a kind at once, from the histogram of lengths: ``capacity`` counts, whatever the size of
the corpus. Only these reach the driver. The plan says which ranks within a length go to which
bins; pieces get their ranks in shards, and their places by a search in the plan.

Defined results: a null or empty text is one piece that holds the end token alone; longer
documents than the capacity are cut, nothing else is; repeated rows are packed repeatedly.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewatch.llm import bpe
from tidewatch.llm.common import small_batches, stored

CAPACITY, END_ID, PER_SHARD = 2048, 0, 1 << 18
#: Weights of tokens, documents and attention cost, each as a share of its capacity.
WEIGHTS = (1.0, 0.001, 0.001)
KEPT = ("doc_id", "piece", "start", "length", "ids_crc32")


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a piece: doc_id, piece, start, length and the CRC-32 of its ids."""
    path = path or bpe.default_path()
    small_batches(docs.sparkSession)
    mark = np.array([end_id], "<u4").tobytes()

    def work(batches):
        for keys, flat, bounds in bpe.encoded(batches, path):
            sizes = np.diff(bounds) + 1  # with the end token, which only the checksum has to see
            count = -(-sizes // capacity)
            doc = np.repeat(np.arange(len(sizes)), count)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
            start = piece * capacity
            length = np.minimum(capacity, sizes[doc] - start)
            ends = start + length == sizes[doc]
            data, first = memoryview(flat.astype("<u4", copy=False)).cast("B"), 4 * (bounds[doc] + start)
            stop = first + 4 * (length - ends)
            crc = [zlib.crc32(mark, zlib.crc32(data[a:b])) if end else zlib.crc32(data[a:b]) for a, b, end in zip(first.tolist(), stop.tolist(), ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [keys.take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start.astype(np.int64)), pa.array(length.astype(np.int64)), pa.array(crc, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("doc_id"), text).mapInArrow(work, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def plan(counts: dict[int, int], capacity: int = CAPACITY, max_docs: int | None = None, max_cost: int | None = None, weights=WEIGHTS, rule: str = "norm") -> list[tuple[int, int, int, int, int]]:
    """Rows (length, first rank, last rank, first sequence, offset), longest lengths first.

    ``counts`` is the histogram. Bins of the same kind (equal residuals) are runs of sequence
    numbers; a step places as many pieces of one length as there are, or as the chosen kind has bins.
    """
    if rule not in ("norm", "dot"):
        raise ValueError(f"rule is norm or dot, not {rule!r}")
    full = np.array([capacity, max_docs or capacity, max_cost or capacity * capacity], float)
    scale = np.sqrt(np.array(weights, float)) / full
    rows, bins = [], 0
    residual = np.zeros((0, 3))  # of each kind of open bins
    runs: list[list[tuple[int, int]]] = []  # its runs of sequence numbers: first, how many
    where: dict[tuple, int] = {}

    def put(left: np.ndarray, first: int, n: int) -> None:
        nonlocal residual
        if min(left[0], left[1], left[2]) < 1:
            return  # full in some capacity
        at = where.get(tuple(left))
        if at is None:
            where[tuple(left)] = at = len(runs)
            runs.append([])
            residual = np.vstack([residual, left])
        runs[at].append((first, n))

    for length in sorted(counts, reverse=True):
        todo, rank = int(counts[length]), 1
        ask = np.array([length, 1, length * length], float)
        if (ask > full).any():
            raise ValueError(f"a piece of {length} tokens fits no empty sequence")
        live = np.fromiter(map(bool, runs), bool, len(runs))
        score = np.full(len(runs), np.inf)
        fits = live & (residual >= ask).all(axis=1)
        score[fits] = _score(residual[fits], ask, scale, rule)
        while todo:
            best = int(np.argmin(score)) if len(score) else 0
            if not len(score) or score[best] == np.inf:
                # a new bin takes as many of this length as best fit puts there, one after the other
                per = int(min(full // ask))
                bulk = todo // per
                for k in range(per):
                    if bulk:
                        rows.append((length, rank, rank + bulk - 1, bins, k * length))
                        rank += bulk
                if bulk:
                    put(full - per * ask, bins, bulk)
                    bins += bulk
                if rest := todo - per * bulk:
                    for k in range(rest):
                        rows.append((length, rank, rank, bins, k * length))
                        rank += 1
                    put(full - rest * ask, bins, 1)
                    bins += 1
                break
            first, n = runs[best].pop()
            used = int(min(todo, n))
            rows.append((length, rank, rank + used - 1, first, int(full[0] - residual[best][0])))
            rank, todo = rank + used, todo - used
            if used < n:
                runs[best].append((first + used, n - used))
            left = residual[best] - ask
            put(left, first, used)
            if len(runs) > len(score):
                score = np.append(score, np.inf)
            at = where.get(tuple(left))
            if at is not None and (left >= ask).all():
                score[at] = _score(residual[at : at + 1], ask, scale, rule)[0]
            if not runs[best]:
                score[best] = np.inf
    return rows


def _score(residual: np.ndarray, ask: np.ndarray, scale: np.ndarray, rule: str) -> np.ndarray:
    if rule == "norm":
        return (((residual - ask) * scale) ** 2).sum(axis=1)
    return -((residual * scale) * (ask * scale)).sum(axis=1)


def placed(found: DataFrame, capacity: int = CAPACITY, max_docs: int | None = None, max_cost: int | None = None, weights=WEIGHTS, rule: str = "norm", per_shard: int = PER_SHARD) -> DataFrame:
    """``found``: a stored table of pieces. Adds sequence_id and offset.

    A length's pieces are dealt to as many shards as its own number asks for, so that no task ranks more than about ``per_shard``.
    """
    spark: SparkSession = found.sparkSession
    counts = {r["length"]: r["n"] for r in found.groupBy("length").agg(F.count("*").alias("n")).collect()}
    steps = plan(counts, capacity, max_docs, max_cost, weights, rule)
    crowded = {length: -(-n // per_shard) for length, n in counts.items() if n > per_shard}
    shards = F.lit(1)
    if crowded:
        dealt = F.create_map(*[F.lit(x) for pair in crowded.items() for x in pair])
        shards = F.coalesce(F.try_element_at(dealt, F.col("length")), F.lit(1))
    sharded = found.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), shards).cast("int"))
    # a row for each length and shard: capacity + pieces / per_shard at most
    cells = sharded.groupBy("length", "shard").agg(F.count("*").alias("n"))
    cells = stored(cells.withColumn("before", F.sum("n").over(W.partitionBy("length").orderBy("shard")) - F.col("n")), "cells")
    order = W.partitionBy("length", "shard").orderBy("doc_id", "piece", "ids_crc32")
    ranked = sharded.withColumn("rank", F.row_number().over(order)).join(cells.select("length", "shard", "before"), ["length", "shard"])
    ranked = ranked.withColumn("rank", F.col("rank") + F.col("before"))
    first = np.array([s[0] << 40 | s[1] for s in steps] or [0], np.int64)
    by = np.argsort(first)
    first, rank0, sequence, offset = first[by], *(np.array([s[i] for s in steps] or [0], np.int64)[by] for i in (1, 3, 4))

    def assign(batches):
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(n)).to_numpy() for n in ("length", "rank"))
            at = np.searchsorted(first, length << 40 | rank, side="right") - 1
            kept = [batch.column(batch.schema.get_field_index(n)) for n in KEPT]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence[at] + rank - rank0[at]), pa.array(offset[at])], names=[*KEPT, "sequence_id", "offset"])

    return ranked.mapInArrow(assign, f"doc_id {found.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, max_docs: int | None = None, max_cost: int | None = None, weights=WEIGHTS, rule: str = "norm", key: str = "doc_id", text: str = "text") -> DataFrame:
    """Tokenize, cut and pack: a row a piece with its sequence and its offset there."""
    found = stored(pieces(docs, path, capacity, end_id, key, text), "pieces")
    return placed(found, capacity, max_docs, max_cost, weights, rule).withColumnRenamed("doc_id", key)
