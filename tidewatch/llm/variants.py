"""Spelling variants: words of a corpus at edit distance one, each pointing to the far commoner form it is a slip of.

Candidates come from a prefix filter over positional bigrams. All bigrams are ordered by the number of words that hold them,
rarest first, then by their letters and place. An edit touches two bigrams of a word at most, so of the three rarest of each of
two near words one is common to both (the order and the edit leave it where it was, counted from one end of the word). Only
these three are joined, under a limit of position that is as tight as one edit allows: the edit lies on one side of a common
bigram, so on the other side, the bigram included, both words are the same; and of the rest, cut in halves, one is. A word's keys are therefore
what reaches from its start to a rare bigram's end (or from a rare bigram's start to its end) with one half of what is left, and it meets words of its own
length and of one more. Each candidate is verified by its edit distance. A bigram that very many words share, even at
one end of them, so makes no large group of pairs: all but half a rest is the same in a group.

Nothing here is quadratic in a hot word: a word enters once with its count, and has no more near words than its length times twice the
alphabet. Counts are added up within a task before they are shuffled, ``FLUSH`` words at a time.

Defined results: null texts have no words; a null id counts as an empty one; an id may repeat, each row is a text of its own; no words give no rows;
of near words with the same count the one first in code-point order is the form.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import given_back, small_batches, stored

#: Code points of a word at least, occurrences at least, how much commoner a form is, and bigrams of a word that are joined.
LENGTH, LEAST, TIMES, RAREST = 6, 5, 5, 3
#: Words that a task counts before it hands the counts on.
FLUSH = 1 << 17


def _counts(text: str, doc_id: str, length: int, damaged: int) -> Counter:
    """Occurrences of the text's words; ``text`` has A-Z in lower case. A run shorter than a word can't become one."""
    runs = Counter(re.findall(f"[a-zÀ-ÿ]{{{length},}}", text))
    if not damaged:
        return runs
    start, out = zlib.crc32(f"{doc_id}:".encode()), Counter()
    for run, n in runs.items():
        h = zlib.crc32(run.encode(), start)
        if h % damaged == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
        if len(run) >= length:
            out[run] += n
    return out


def counted(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, least: int = LEAST, damaged: int = 0) -> DataFrame:
    """(word, n): the words of whole texts, runs of Latin letters with only A-Z lower-cased, that occur ``least`` times.

    ``damaged``: where it divides the CRC-32 of ``id:run``, the run loses the code point at the CRC modulo its length
    (slips made on purpose, to measure what is found).
    """
    small_batches(docs.sparkSession)

    def work(batches):
        def out(counts: Counter) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["word", "n"])

        counts: Counter = Counter()
        for batch in given_back(batches):
            for i, t in zip(batch.column(0), batch.column(1).cast(pa.large_binary()), strict=True):
                if t.is_valid:
                    text_ = t.as_buffer().to_pybytes().lower().decode("utf-8", "replace")
                    counts.update(_counts(text_, i.as_py() or "", length, damaged))
                    if len(counts) >= FLUSH:
                        yield out(counts)
                        counts.clear()
        yield out(counts)

    rows = docs.select(F.col(key).cast("string"), F.col(text))
    return rows.mapInArrow(work, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def near_pairs(words: DataFrame) -> DataFrame:
    """``words`` (word: distinct, of three code points or more; n) -> (a, a_n, b, b_n): each pair at edit distance one, once."""
    letters = F.length("word")
    grams = words.select("word", "n", F.posexplode(F.transform(F.sequence(F.lit(1), letters - 1), lambda i: F.substring("word", i, F.lit(2)))).alias("at", "gram"))
    # as many rows as the alphabet has bigrams
    common = grams.groupBy("gram").agg(F.countDistinct("word").alias("words"))
    rare = grams.join(F.broadcast(common), "gram").groupBy("word", "n").agg(F.slice(F.array_sort(F.collect_list(F.struct("words", "gram", "at"))), 1, RAREST).alias("rare"))
    ahead = F.transform("rare", lambda g: F.struct(F.lit("<").alias("side"), F.substring("word", F.lit(1), g["at"] + 2).alias("part"), F.substring("word", g["at"] + 3, letters).alias("rest")))
    behind = F.transform("rare", lambda g: F.struct(F.lit(">").alias("side"), F.substring("word", g["at"] + 1, letters).alias("part"), F.substring("word", F.lit(1), g["at"]).alias("rest")))
    parts = rare.select("word", "n", letters.alias("letters"), F.inline(F.array_distinct(F.concat(ahead, behind))))
    # as the shorter word of a pair (or one of two as long) a word has its own length, as the longer one that of the other
    parts = parts.withColumn("short", F.explode(F.array("letters", F.col("letters") - 1)))
    left_over = F.col("short") - F.length("part")
    half = F.floor(left_over / 2).cast("int")
    halves = F.array(F.concat(F.lit("1"), F.substring("rest", F.lit(1), half)), F.concat(F.lit("2"), F.right("rest", (left_over - half).cast("int"))))
    keys = parts.where(left_over >= 0).select("word", "n", "letters", "short", F.concat("side", "part").alias("part"), F.explode(halves).alias("half"))
    keys = stored(keys, "parts")
    short = keys.where("short = letters").select(F.col("word").alias("a"), F.col("n").alias("a_n"), F.col("letters").alias("own"), "short", "part", "half")
    long = keys.select(F.col("word").alias("b"), F.col("n").alias("b_n"), "letters", "short", "part", "half")
    met = short.join(long, ["short", "part", "half"]).where((F.col("own") < F.col("letters")) | (F.col("a") < F.col("b")))
    return met.where(F.levenshtein("a", "b", 1) == 1).select("a", "a_n", "b", "b_n").distinct()


def followed(links: DataFrame) -> DataFrame:
    """``links`` (word, to) without circles -> (word, root), by pointers that double their reach in each round."""
    now = stored(links, "pointers")
    while True:
        ahead = now.select(F.col("word").alias("to"), F.col("to").alias("further"))
        then = stored(now.join(ahead, "to", "left").select("word", F.coalesce("further", "to").alias("to"), F.col("further").isNotNull().alias("moved")), "pointers")
        if then.where("moved").isEmpty():
            return then.select("word", F.col("to").alias("root"))
        now = stored(then.select("word", "to"), "pointers")


def grouped(words: DataFrame, times: int = TIMES) -> DataFrame:
    """``words`` (word, n) -> word, n, n_near, form, form_n, root.

    The form is the near word of largest n, if that is ``times`` the word's own at least; counts grow along forms,
    so they have no circles, and root is the last of them (the word itself without one).
    """
    words = stored(words.select("word", "n"), "words")
    pairs = stored(near_pairs(words), "near")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("b_n").alias("a_n"), F.col("a").alias("b"), F.col("a_n").alias("b_n")))
    best = both.groupBy(F.col("a").alias("word")).agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("b_n")).alias("less"), F.col("b").alias("form"))).alias("best"))
    form_n = -F.col("best.less")
    is_form = form_n >= times * F.col("n")
    rows = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("best.form")).alias("form"), F.when(is_form, form_n).alias("form_n"))
    rows = stored(rows, "forms")
    roots = followed(rows.where("form is not null").select("word", F.col("form").alias("to")))
    return rows.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))
