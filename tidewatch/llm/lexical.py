"""Ranked lexical search over dual-sorted wavelet trees, one index for each shard of the documents.

A shard's postings stand list after list, by term; within a list they are ordered by falling impact. A wavelet matrix over the
documents' places in the shard (ascending by id) keeps that order in every one of its nodes, so the same structure reads as
postings by impact and as a tree over documents: in any node, the part of a term's list that falls below it is a range, and the range's
first posting has the largest impact that the term has below that node. A query walks all its terms' ranges together, best
node first. A node's bound is the weighted sum of these first impacts; at a leaf it is the document's score. The walk ends when no
node's bound reaches the k-th result, so results are exact and the long tails of the lists are never read.

Impacts depend on the corpus's mean length, so one pass counts documents and terms before shards are built; document
frequencies are added up over the shards' list lengths. Shards are cut from the documents as they stream by, after ``POSTINGS``
postings, without a shuffle, and stand as rows of a table in the shared folder. Queries are dealt into blocks of about ``BLOCK`` terms; only a block
at a time goes to the tasks. A task hands on k rows an item, however many shards it reads.

Defined results: a null text has no terms; documents with no id come last among equals; a document id that repeats names documents of their
own; items that share an id are one query; items without a term that any document holds have no rows.
"""

from __future__ import annotations

import heapq
import math
import re
from bisect import insort
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from tidewatch.llm.common import given_back, small_batches, stored

#: Postings of a shard, terms of a block of queries, nodes opened at once, rows that a merge hands on.
POSTINGS, BLOCK, AT_ONCE, SALTS = 1 << 19, 1 << 17, 32, 64
#: Fixed values of the score: weight of the length in hundredths, saturation in eighths, scale of impacts and of weights.
LENGTH_SHARE, SATURATION, SCALE, WEIGHT = 75, 8, 1_000_000_000, 1000
SHARD = "doc_ids array<long>, terms array<binary>, starts binary, impacts binary, levels array<binary>"

_TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
_INSIDE = bytes(int(chr(i).isalnum() or i >= 0x80) if i != 0x7F else 0 for i in range(256))


def terms_of(raw: bytes) -> list[bytes]:
    """Terms of a text in UTF-8: runs of ASCII letters, digits and all beyond ASCII, with only A-Z lower-cased."""
    return _TERM.findall(raw.lower())


def n_terms(raw: bytes) -> int:
    inside = np.frombuffer(raw.translate(_INSIDE), np.int8)
    return int(inside[:1].sum() + (np.diff(inside) > 0).sum())


def _texts(column):
    for t in column.cast(pa.large_binary()):
        yield t.as_buffer().to_pybytes() if t.is_valid else b""


def corpus_size(docs: DataFrame, text: str = "text") -> tuple[int, int]:
    """How many documents have a term, and how many terms they have together."""
    small_batches(docs.sparkSession)

    def work(batches):
        documents = total = 0
        for batch in given_back(batches):
            for t in _texts(batch.column(0)):
                n = n_terms(t)
                documents += n > 0
                total += n
        yield pa.RecordBatch.from_arrays([pa.array([documents], pa.int64()), pa.array([total], pa.int64())], names=["documents", "terms"])

    row = docs.select(text).mapInArrow(work, "documents long, terms long").agg(F.sum("documents"), F.sum("terms")).first()
    return int(row[0] or 0), int(row[1] or 0)


def norm(n: int, size: tuple[int, int]) -> int:
    """Length norm of a document of ``n`` terms, in hundredths."""
    return 100 - LENGTH_SHARE + LENGTH_SHARE * n * size[0] // size[1]


def shard_of(ids: list, lengths: list[int], postings: tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray], size: tuple[int, int]) -> dict:
    """A shard of documents (ids, lengths) with postings: the terms, and for each posting the term's, document's number and the occurrences."""
    terms, term, doc, tf = postings
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0))
    place = np.empty(len(ids), np.int32)
    place[order] = np.arange(len(ids), dtype=np.int32)
    by_name = sorted(range(len(terms)), key=terms.__getitem__)
    rank = np.empty(len(terms), np.int32)
    rank[by_name] = np.arange(len(terms), dtype=np.int32)
    m = np.array([norm(n, size) for n in lengths], np.int64)[doc] if len(doc) else np.zeros(0, np.int64)
    impact, term, doc = SCALE * tf // (1000 * tf + SATURATION * m), rank[term], place[doc]
    by = np.lexsort((doc, -impact, term))
    starts = np.searchsorted(term[by], np.arange(len(terms) + 1)).astype(np.int32)
    now, levels = doc[by], []
    for bit in reversed(range(max(1, (len(ids) - 1).bit_length()))):
        one = (now >> bit & 1).astype(bool)
        levels.append(np.packbits(one).tobytes())
        now = np.concatenate([now[~one], now[one]])
    return {"doc_ids": [ids[i] for i in order], "terms": [terms[i] for i in by_name], "starts": starts.tobytes(), "impacts": impact[by].astype(np.int32).tobytes(), "levels": levels}


_SCHEMA = pa.schema([("doc_ids", pa.list_(pa.int64())), ("terms", pa.list_(pa.binary())), ("starts", pa.binary()), ("impacts", pa.binary()), ("levels", pa.list_(pa.binary()))])


def indexed(docs: DataFrame, size: tuple[int, int], key: str = "doc_id", text: str = "text", postings: int = POSTINGS) -> DataFrame:
    """The shards of all documents with a term, a row each, stored."""
    small_batches(docs.sparkSession)

    def work(batches):
        def empty():
            return [], [], {}, [], [], []

        def out(ids, lengths, names, term, doc, tf):
            parts = list(names), *(np.array(x, np.int64) for x in (term, doc, tf))
            return pa.RecordBatch.from_pylist([shard_of(ids, lengths, parts, size)], _SCHEMA)

        ids, lengths, names, term, doc, tf = empty()
        for batch in given_back(batches):
            for i, raw in zip(batch.column(0), _texts(batch.column(1)), strict=True):
                found = Counter(terms_of(raw))
                if not found:
                    continue
                if ids and len(term) + len(found) > postings:
                    yield out(ids, lengths, names, term, doc, tf)
                    ids, lengths, names, term, doc, tf = empty()
                term += [names.setdefault(t, len(names)) for t in found]
                tf += found.values()
                doc += [len(ids)] * len(found)
                ids.append(i.as_py())
                lengths.append(sum(found.values()))
        if ids:
            yield out(ids, lengths, names, term, doc, tf)

    rows = docs.select(F.col(key).cast("long"), F.col(text)).mapInArrow(work, SHARD)
    # a row is some megabytes: a writer looks at its size after each, not after a hundred
    return stored(rows, "shards", {"parquet.block.size": str(8 << 20), "parquet.block.size.row.check.min": "1", "parquet.block.size.row.check.max": "1"})


class Shard:
    """A shard as it is searched: for each level, how many zeros stand before a place, and the impacts in that level's order."""

    def __init__(self, doc_ids: list, starts: bytes, impacts: bytes, levels: list[bytes]):
        self.doc_ids, self.starts = doc_ids, np.frombuffer(starts, np.int32)
        own = np.frombuffer(impacts, np.int32)
        n = len(own)
        self.height = len(levels)
        self.zeros = np.zeros((self.height, n + 1), np.int32)
        self.impacts = np.empty((self.height + 1, n + 1), np.int32)
        self.impacts[:, n] = 0
        for k, packed in enumerate(levels):
            self.impacts[k, :n] = own
            one = np.unpackbits(np.frombuffer(packed, np.uint8), count=n).astype(bool)
            np.cumsum(~one, out=self.zeros[k, 1:], dtype=np.int32)
            own = np.concatenate([own[~one], own[one]])
        self.impacts[self.height, :n] = own

    def search(self, terms: np.ndarray, weights: np.ndarray, k: int, best: list[tuple], at_once: int = AT_ONCE) -> int:
        """Adds the shard's documents to ``best``, at most k of (minus score, has no id, id) in order; ``terms`` are numbers of lists with
        their weights. Returns how many nodes were opened."""
        n, opened = self.zeros.shape[1] - 1, 0

        def bounds(level, left, right):
            return (self.impacts[level[:, None], np.where(left < right, left, n)].astype(np.int64) * weights).sum(axis=1)

        def rank(bound: int, start: int) -> tuple:
            i = self.doc_ids[start]
            return -bound, i is None, i or 0

        left, right = self.starts[terms][None], self.starts[terms + 1][None]
        first = int(bounds(np.zeros(1, np.int64), left, right)[0])
        open_ = [(-first, 0, 0, left[0], right[0])] if first > 0 else []
        while open_:
            some = []
            while open_ and len(some) < at_once:
                node = heapq.heappop(open_)
                if len(best) == k and rank(-node[0], node[1]) >= best[-1]:
                    if -node[0] < -best[-1][0]:
                        open_ = []
                    continue
                if node[2] == self.height:
                    insort(best, rank(-node[0], node[1]))
                    del best[k:]
                    continue
                some.append(node)
            if not some:
                continue
            opened += len(some)
            level = np.array([x[2] for x in some])
            start = np.array([x[1] for x in some])
            left, right = np.array([x[3] for x in some]), np.array([x[4] for x in some])
            zeros_left, zeros_right = self.zeros[level[:, None], left], self.zeros[level[:, None], right]
            before = self.zeros[level, -1][:, None]
            for bit, (a, b) in enumerate(((zeros_left, zeros_right), (left - zeros_left + before, right - zeros_right + before))):
                at = start + (bit << (self.height - 1 - level))
                bound = bounds(level + 1, a, b)
                least = -best[-1][0] if len(best) == k else 1
                for i in np.flatnonzero(bound >= max(1, least)).tolist():
                    heapq.heappush(open_, (-int(bound[i]), int(at[i]), int(level[i]) + 1, a[i], b[i]))
        return opened


def query_terms(items: DataFrame, key: str, text: str) -> DataFrame:
    """(item, term, n): the terms of the items, with repeats counted."""
    small_batches(items.sparkSession)

    def work(batches):
        for batch in given_back(batches):
            for i, raw in enumerate(_texts(batch.column(1))):
                if found := Counter(terms_of(raw)):
                    yield pa.RecordBatch.from_arrays([pa.concat_arrays([batch.column(0).slice(i, 1)] * len(found)), pa.array(found.keys(), pa.binary()), pa.array(found.values(), pa.int64())], names=["item", "term", "n"])

    kind = items.schema[key].dataType.simpleString()
    own = items.select(F.col(key).alias("item"), F.col(text).alias("text")).distinct()
    return own.mapInArrow(work, f"item {kind}, term binary, n long").groupBy("item", "term").agg(F.sum("n").alias("n"))


def _frequencies(index: DataFrame, vocabulary: list[bytes]) -> dict[bytes, int]:
    """In how many documents each term of a block stands; terms in none are left out."""

    def work(batches):
        total, wanted = np.zeros(len(vocabulary), np.int64), pa.array(vocabulary, pa.binary())
        for batch in given_back(batches):
            for i in range(batch.num_rows):
                at = pc.index_in(wanted, value_set=batch.column(0)[i].values)
                has = np.asarray(at.is_valid())
                found = np.asarray(at.fill_null(0))[has]
                total[has] += np.diff(np.frombuffer(batch.column(1)[i].as_py(), np.int32))[found]
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some])], names=["i", "df"])

    rows = index.select("terms", "starts").mapInArrow(work, "i long, df long").groupBy("i").agg(F.sum("df")).collect()
    return {vocabulary[i]: df for i, df in rows}


def _block(index: DataFrame, rows: list, size: tuple[int, int], k: int, kind: DataType) -> DataFrame:
    """(item, doc_id, score): k rows a task of each item of a block (item, term, n)."""
    df = _frequencies(index, sorted({bytes(r["term"]) for r in rows}))
    weight = {t: math.floor(WEIGHT * math.log((2 * size[0] + 2) / (2 * n + 1))) for t, n in df.items()}
    vocabulary = sorted(t for t, w in weight.items() if w > 0)
    number = {t: i for i, t in enumerate(vocabulary)}
    parts: dict = {}
    for r in rows:
        if (t := bytes(r["term"])) in number:
            parts.setdefault(r["item"], []).append((number[t], r["n"] * weight[t]))
    item_type = to_arrow_type(kind)
    queries = [(item, *(np.array(x, np.int64) for x in zip(*of, strict=True))) for item, of in parts.items()]

    def work(batches):
        best: list[list[tuple]] = [[] for _ in queries]
        wanted = pa.array(vocabulary, pa.binary())
        for batch in given_back(batches):
            for i in range(batch.num_rows):
                doc_ids, terms, starts, impacts, levels = (batch.column(c)[i] for c in range(5))
                at = pc.index_in(wanted, value_set=terms.values)
                there = np.asarray(at.fill_null(-1), dtype=np.int64)
                if not (there >= 0).any():
                    continue
                shard = Shard(doc_ids.as_py(), starts.as_py(), impacts.as_py(), levels.as_py())
                for (_, own, weights), so_far in zip(queries, best, strict=True):
                    has = there[own] >= 0
                    if has.any():
                        shard.search(there[own][has], weights[has], k, so_far)
        found = [(item, None if no_id else i, -score) for (item, *_), of in zip(queries, best, strict=True) for score, no_id, i in of]
        items, ids, scores = zip(*found, strict=True) if found else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(items, item_type), pa.array(ids, pa.int64()), pa.array(scores, pa.int64())], names=["item", "doc_id", "score"])

    return index.mapInArrow(work, f"item {kind.simpleString()}, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 10, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", postings: int = POSTINGS, block: int = BLOCK) -> DataFrame:
    """Each item's k documents of highest score above zero: item_id, rank (from 1; equal scores by ascending id), doc_id, score."""
    size = corpus_size(docs, text)
    index = indexed(docs, size, key, text, postings)
    terms = stored(query_terms(items, item_key, item_text), "query_terms")
    blocks = -(-terms.count() // block)
    kind = items.schema[item_key].dataType
    found = docs.sparkSession.createDataFrame([], f"item {kind.simpleString()}, doc_id long, score long")
    for b in range(blocks):
        rows = terms.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b).collect()
        if rows:
            found = found.unionByName(stored(_block(index, rows, size, k, kind), "block"))
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    part = found.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    part = part.withColumn("rank", F.row_number().over(Window.partitionBy("item", "salt").orderBy(*order))).where(F.col("rank") <= k)
    final = part.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)
    return final.select(F.col("item").alias(item_key), "rank", "doc_id", "score")
