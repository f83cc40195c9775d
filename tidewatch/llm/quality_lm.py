"""Quality classifier: an interpolated modified Kneser-Ney model of character n-grams.

The model is trained on all trusted documents (labelled good and not toxic), so it grows with the corpus. N-grams are counted inside each task, the counts are summed by n-gram, and continuation counts,
discounts, context weights and probabilities are made by joins of count tables that are sharded by
context. Perplexity is that of a document's characters in lower case, and a document is kept while it doesn't exceed the quantile
of its language over all trusted documents, with a margin.

The alphabet is made of the most frequent letters that together cover ``COVERAGE`` of the trusted text, and one symbol for the rest.
While alphabet^ORDER is no more than ``DENSE_CELLS`` the model goes to every task as one array and scoring moves
no rows; a larger one is scored by joining the documents' n-gram counts with the sharded tables (:func:`score_by_join`). Both give
the same scores.

Defined results: a null text counts as empty; a text without visible characters has no perplexity and is
rejected; a language without trusted documents takes the threshold over all languages; repeated rows give repeated rows.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import columns_of, fresh, given_back, may_be_in, small_batches, stored

#: Length of an n-gram, share of the trusted characters that the alphabet covers, cells of a table that goes to every task.
ORDER, COVERAGE, DENSE_CELLS = 4, 0.999, 10 << 20
#: The quantile of trusted documents' log-perplexity in each language, and what a document may exceed it by.
QUANTILE, MARGIN = 0.99, 0.25
UNKNOWN, EDGE, SPACE = 0, 1, 2
CHARS_AT_ONCE = 1 << 17


@functools.lru_cache(1)
def _lower() -> np.ndarray:
    """The lower case of every code point, where it is one code point."""
    out = np.arange(0x110000, dtype=np.uint32)
    for i in range(0x1E944):  # no cased letters beyond
        low = chr(i).lower()
        if len(low) == 1:
            out[i] = ord(low)
    return out


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _is_space(points: np.ndarray) -> np.ndarray:
    return (points == 32) | ((points >= 9) & (points <= 13)) | (points == 0xA0)


def _joined(texts) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts and their sizes."""
    sizes = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    return _points("".join(texts.to_pylist())), sizes


class Symbols:
    """Maps texts to rows of symbols, with ``order - 1`` edges before and one behind each."""

    def __init__(self, letters: list[int], order: int):
        table = np.zeros(0x110000, np.min_scalar_type(len(letters) + 3))
        for i, letter in enumerate(letters):
            table[letter] = i + 3
        self.table = table[_lower()]
        self.order = order

    def grams(self, texts, size: int) -> tuple[np.ndarray, np.ndarray]:
        """The n-gram that ends at each symbol, as a number in base ``size``, and how many each text has."""
        points, sizes = _joined(texts)
        symbols = self.table[points].astype(np.int32)
        space = _is_space(points)
        symbols[space] = SPACE
        owner = np.repeat(np.arange(len(sizes)), sizes)
        # runs of white space count once
        keep = ~(space & np.concatenate([[False], space[:-1] & (owner[1:] == owner[:-1])])) if len(space) else space
        symbols, owner = symbols[keep], owner[keep]
        own = np.bincount(owner, minlength=len(sizes))
        seen = np.bincount(owner, weights=symbols != SPACE, minlength=len(sizes)) > 0
        n, lead = len(sizes), self.order - 1
        starts = np.concatenate([[0], np.cumsum(own + lead + 1)])
        padded = np.full(int(starts[-1]), EDGE, np.int64)
        first = np.concatenate([[0], np.cumsum(own)])[:-1]
        padded[np.arange(len(symbols)) - first[owner] + starts[:-1][owner] + lead] = symbols
        codes = np.zeros(len(padded), np.int64)
        for back in range(lead, -1, -1):
            codes *= size
            codes[back:] += padded[: len(padded) - back] if back else padded
        counted = np.ones(len(padded), bool)
        for back in range(lead):
            counted[starts[:-1] + back] = False
        return codes[counted], np.where(seen, own + 1, 0), own + 1


def _slices(column, limit: int = CHARS_AT_ONCE):
    from tidewatch.llm.common import spans

    column = pc.fill_null(column.cast(pa.large_string()), "")
    sizes = pc.binary_length(column).to_numpy(zero_copy_only=False).tolist()
    for i, j in spans(sizes, limit):
        yield i, j, column.slice(i, j - i)


def letters_of(texts: DataFrame, coverage: float = COVERAGE) -> list[int]:
    """The most frequent code points in lower case, white space left out, as many as cover ``coverage`` of all; ties to the smaller.
    The counts of code points are a bounded table."""

    def work(batches):
        for batch in batches:
            for _, _, part in _slices(batch.column(0)):
                points = _joined(part)[0]
                found, count = np.unique(_lower()[points[~_is_space(points)]], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int64)), pa.array(count.astype(np.int64))], names=["letter", "n"])

    counts = texts.mapInArrow(work, "letter long, n long").groupBy("letter").agg(F.sum("n").alias("n"))
    rows = sorted(((r["n"], r["letter"]) for r in counts.collect()), key=lambda r: (-r[0], r[1]))
    total, covered, out = sum(n for n, _ in rows), 0, []
    for n, letter in rows:
        if covered >= coverage * total:
            break
        covered += n
        out.append(letter)
    return out


def gram_counts(texts: DataFrame, letters: list[int], order: int, size: int) -> DataFrame:
    """(gram, n): counted in each task first, then summed by gram."""

    def work(batches):
        tool = Symbols(letters, order)
        for batch in batches:
            for _, _, part in _slices(batch.column(0)):
                found, count = np.unique(tool.grams(part, size)[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(count.astype(np.int64))], names=["gram", "n"])

    return texts.mapInArrow(work, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def _discount(n: Column, d: list[float]) -> Column:
    return F.when(n == 1, d[0]).when(n == 2, d[1]).otherwise(d[2])


def discounts(counts: DataFrame) -> list[float]:
    """Chen and Goodman's D1, D2, D3+ from the counts of counts; 0.5, 1, 1.5 where those are too few to tell."""
    r = counts.agg(*[F.count_if(F.col("n") == i).alias(f"n{i}") for i in (1, 2, 3, 4)]).first()
    n1, n2, n3, n4 = (r[f"n{i}"] for i in (1, 2, 3, 4))
    if not (n1 and n2 and n3 and n4):
        return [0.5, 1.0, 1.5]
    y = n1 / (n1 + 2 * n2)
    raw = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
    # never quite zero, so that every unseen n-gram keeps some weight
    return [min(max(d, 0.05), float(i)) for i, d in enumerate(raw, 1)]


def train(counts: DataFrame, order: int, size: int) -> list[tuple[DataFrame, DataFrame]]:
    """For each order from 1: (gram, p) of the n-grams seen, and (context, weight) of the next lower order's share.

    ``counts`` (gram, n) of the highest order is a stored table; lower orders count different left neighbours.
    """
    by_order = {order: counts}
    for k in range(order - 1, 0, -1):
        by_order[k] = stored(by_order[k + 1].groupBy(F.pmod("gram", F.lit(size**k)).alias("gram")).agg(F.count("*").alias("n")), f"continuations{k}")
    tables: list[tuple[DataFrame, DataFrame]] = []
    for k in range(1, order + 1):
        d = discounts(by_order[k])
        rows = by_order[k].withColumn("context", F.floor(F.col("gram") / F.lit(size)).cast("long"))
        sums = rows.groupBy("context").agg(F.sum("n").alias("total"), F.sum(_discount(F.col("n"), d)).alias("taken"))
        seen = rows.join(sums, "context").withColumn("own", F.greatest(F.col("n") - _discount(F.col("n"), d), F.lit(0.0)) / F.col("total"))
        seen = seen.withColumn("weight", F.col("taken") / F.col("total")).withColumn("gram_below", F.pmod("gram", F.lit(size ** (k - 1))))
        if k == 1:
            made = seen.select("gram", (F.col("own") + F.col("weight") / size).alias("p"))
        else:
            below = tables[-1][0].select(F.col("gram").alias("gram_below"), F.col("p").alias("p_below"))
            made = seen.join(below, "gram_below").select("gram", (F.col("own") + F.col("weight") * F.col("p_below")).alias("p"))
        weights = sums.select("context", (F.col("taken") / F.col("total")).alias("weight"))
        tables.append((stored(made, f"p{k}"), stored(weights, f"weights{k}")))
    return tables


def dense(tables: list[tuple[DataFrame, DataFrame]], size: int) -> np.ndarray:
    """log P for every n-gram over the closed alphabet: size^order cells, whatever was seen."""
    below = np.full(1, 1.0 / size, np.float32)
    for k, (grams, weights) in enumerate(tables, 1):
        seen, contexts = grams.toArrow(), weights.toArrow()
        weight = np.ones(size ** (k - 1), np.float32)
        weight[contexts.column("context").to_numpy()] = contexts.column("weight").to_numpy()
        # the n-gram below drops the first symbol, so the lower table repeats for each of them
        p = np.repeat(weight, size)
        p *= np.tile(below, size)
        p[seen.column("gram").to_numpy()] = seen.column("p").to_numpy()
        below = p
    return np.log(below, out=below)


class Model:
    def __init__(self, letters: list[int], order: int, size: int, tables):
        self.letters, self.order, self.size, self.tables = letters, order, size, tables
        self.shared = None

    @property
    def fits(self) -> bool:
        """Is the table small enough to go to every task?"""
        return self.size**self.order <= DENSE_CELLS

    def score(self, text: Column | str) -> Column:
        """Mean negative log-probability of a symbol (the log-perplexity); null without visible characters. For tables that fit."""
        spark = self.tables[0][0].sparkSession
        small_batches(spark)
        if self.shared is None:
            self.shared = spark.sparkContext.broadcast(dense(self.tables, self.size))
        shared, letters, order, size = self.shared, self.letters, self.order, self.size

        @F.arrow_udf("double")
        def log_perplexity(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            table, tool = shared.value, Symbols(letters, order)
            for texts in given_back(batches):
                out = np.full(len(texts), np.nan)
                for i, j, part in _slices(texts):
                    codes, counts, own = tool.grams(part, size)
                    ends = np.cumsum(own)
                    sums = np.add.reduceat(table[codes], ends - own, dtype=np.float64) if len(codes) else np.zeros(0)
                    out[i:j] = np.where(counts > 0, -sums / own, np.nan)
                yield pa.array(out, mask=np.isnan(out))

        return log_perplexity(text)


def fit(docs: DataFrame, labels: DataFrame, order: int = ORDER, coverage: float = COVERAGE, key: str = "doc_id", text: str = "text", lang: str = "lang") -> tuple[Model, DataFrame]:
    """The model, and the stored table (lang, text) of all trusted documents."""
    ids = stored(trusted(labels), "trusted_ids")
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    # the ids grow with the corpus and are never broadcast; only rows that may be trusted are shuffled to meet them
    likely = may_be_in(rows, "doc_id", ids, "likely").where("likely")
    texts = likely.join(ids.hint("merge"), F.col("doc_id") == F.col("label_id"), "left_semi")
    texts = stored(texts.select("text", "lang"), "trusted")
    only = texts.select("text")
    letters = letters_of(only, coverage)
    size = len(letters) + 3
    counts = stored(gram_counts(only, letters, order, size), "grams")
    return Model(letters, order, size, train(counts, order, size)), texts


def trusted(labels: DataFrame) -> DataFrame:
    """(label_id): documents labelled good and not toxic."""
    good = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("label_id")).agg(F.min("quality").alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("t"))
    return good.where("q = 1 and t = 0").select("label_id")


def scored(docs: DataFrame, model: Model, text: str, out: str) -> DataFrame:
    """``docs`` with its log-perplexity in a column ``out``: in place where the table goes to every task, else by joins."""
    if model.fits:
        return docs.withColumn(out, model.score(F.col(text)))
    row = fresh(docs, "row")
    rows = stored(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    found = score_by_join(rows, model, row, text).withColumnRenamed("score", out)
    return rows.join(found, row, "left").drop(row)


def thresholds(known: DataFrame, quantile: float = QUANTILE, margin: float = MARGIN) -> DataFrame:
    """(lang, limit) from ``known`` (lang, score), the log-perplexities of all trusted documents; the row with a null lang holds for other languages.

    Quantiles are exact over scores in steps of 1/10,000, counted first, so they are the same however rows are dealt, and no more values are held than there are steps.
    """
    rows = known.where("score is not null").groupBy("lang", F.round("score", 4).alias("score")).agg(F.count("*").alias("n"))
    # one aggregation: a row a language and a row over all
    found = rows.rollup("lang").agg(F.percentile("score", quantile, F.col("n")).alias("limit"), F.grouping("lang").alias("all"))
    return found.where("all = 1 or lang is not null").select("lang", (F.col("limit") + margin).alias("limit"))


def _with_limit(df: DataFrame, table: DataFrame, lang: str, out: str) -> DataFrame:
    """``df`` with its language's limit; languages without one take that over all languages (none: no limit)."""
    table = stored(table, "limits")
    whole = table.where("lang is null").select("limit").first()
    other = whole["limit"] if whole and whole["limit"] is not None else float("inf")
    known = table.where("lang is not null").select(F.col("lang").alias(f"{out}_lang"), F.col("limit").alias(out))
    joined = df.join(known, F.col(lang) == F.col(f"{out}_lang"), "left").drop(f"{out}_lang")
    return joined.withColumn(out, F.coalesce(out, F.lit(other)))


def _limited(docs: DataFrame, labels: DataFrame, key: str, text: str, lang: str, score: str, limit: str, **options) -> DataFrame:
    """``docs`` with the log-perplexity of each text and the limit of its language."""
    model, texts = fit(docs, labels, key=key, text=text, lang=lang, **options)
    known = scored(texts, model, "text", "score").select("lang", "score")
    return _with_limit(scored(docs, model, text, score), thresholds(known), lang, limit)


def judged(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", **options) -> DataFrame:
    """One row a document: doc_id, lang, perplexity, limit and kept."""
    rows = docs.select(F.col(key).alias("doc_id"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    rows = _limited(rows, labels, "doc_id", "text", "lang", "score", "limit", **options)
    return rows.select(
        F.col("doc_id").alias(key), F.col("lang").alias(lang), F.exp("score").alias("perplexity"), F.exp("limit").alias("limit"), F.coalesce(F.col("score") <= F.col("limit"), F.lit(False)).alias("kept")
    )


def kept(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", **options) -> DataFrame:
    """The rows of ``docs`` that the classifier keeps, with its columns."""
    score, limit = fresh(docs, "score"), fresh(docs, "limit")
    rows = _limited(docs, labels, key, text, lang, score, limit, **options)
    return rows.where(F.coalesce(F.col(score) <= F.col(limit), F.lit(False))).select(*columns_of(docs))


def score_by_join(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", shards: int = 64) -> DataFrame:
    """(doc_id, score) by joining each document's n-gram counts with the count tables, sharded by n-gram.

    For tables of any size. An n-gram that wasn't seen takes the product of its contexts' weights down to the
    order in which its end was seen. ``key`` has to be unique here.
    """
    letters, order, size = model.letters, model.order, model.size
    kind = docs.schema[key].dataType.simpleString()

    def work(batches):
        tool = Symbols(letters, order)
        for batch in batches:
            for i, j, part in _slices(batch.column(1)):
                codes, counts, own = tool.grams(part, size)
                owner = np.repeat(np.arange(j - i), own)
                live = counts[owner] > 0
                pairs, n = np.unique(np.stack([owner[live], codes[live]]), axis=1, return_counts=True)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i).take(pa.array(pairs[0])), pa.array(pairs[1]), pa.array(n.astype(np.int64))], names=["doc_id", "gram", "n"])

    rows = docs.select(key, text).mapInArrow(work, f"doc_id {kind}, gram long, n long")
    # a common n-gram is in most documents: its rows are salted by document
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(shards)))
    total, weight = F.lit(None).cast("double"), F.lit(1.0)
    for k in range(order, 0, -1):
        grams, weights = model.tables[k - 1]
        salts = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("salt")
        rows = rows.withColumn(f"g{k}", F.pmod("gram", F.lit(size**k))).withColumn(f"c{k}", F.floor(F.col(f"g{k}") / F.lit(size)).cast("long"))
        rows = rows.join(grams.select(F.col("gram").alias(f"g{k}"), F.col("p").alias(f"p{k}"), salts), [f"g{k}", "salt"], "left")
        rows = rows.join(weights.select(F.col("context").alias(f"c{k}"), F.col("weight").alias(f"w{k}"), salts), [f"c{k}", "salt"], "left")
        total = F.coalesce(total, weight * F.col(f"p{k}"))
        weight = weight * F.coalesce(F.col(f"w{k}"), F.lit(1.0))
    total = F.coalesce(total, weight / size)
    return rows.groupBy("doc_id").agg((-F.sum(F.col("n") * F.log(total)) / F.sum("n")).alias("score")).withColumnRenamed("doc_id", key)
