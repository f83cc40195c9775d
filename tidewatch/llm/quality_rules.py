"""Quality rules: text statistics and a learned decision list, in DataFrame functions alone.

Statistics are one projection over whole texts. The list is learned by sequential covering
over labelled statistics: a rule grows by the threshold condition with the best information gain, is
pruned on rows that it didn't grow on, and takes the rows that it covers with it; the next rule sees the rest.
The result is an ordered conditional expression. Each step of the search is one aggregation
over the labelled rows; no rows reach the driver, only counts for each feature and threshold.

Labels may be sampled for the fit (``MAX_LABELLED`` rows by hash); statistics cover every document.

Defined results: a null text has no words; an empty one likewise, and fails the base test; without labels
of both kinds there are no rules and the base test decides alone; repeated rows give repeated rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import discard, fresh, stored

WORD_BREAK = r"[\x20\x09-\x0D]+"
WINDOW = 8
#: Bound of labelled rows for the fit, candidate thresholds a feature and class, conditions in a rule, rules, least precision and share of the bad rows for a rule to be kept.
MAX_LABELLED, THRESHOLDS, MAX_CONDITIONS, MAX_RULES, MIN_PRECISION, MIN_SHARE = 20_000, 24, 3, 8, 0.97, 0.02
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("words", "mean_word", "symbols", "capitals", "marks", "dup_lines", "repeats", "distinct", "line_words")


def with_stats(docs: DataFrame, text: str, out: str) -> DataFrame:
    """``docs`` with a struct column ``out`` of STATS and FEATURES. Each step is a projection of its own,
    since what a lambda refers to has to be a column and not an expression."""
    p = fresh(docs, "q")
    t, words, lines, hashes, ranked, again = (f"{p}{n}" for n in ("text", "words", "lines", "hashes", "ranked", "again"))
    df = docs.withColumn(t, F.coalesce(F.col(text), F.lit("")))
    df = df.withColumn(words, F.filter(F.split(t, WORD_BREAK), lambda w: w != "")).withColumn(lines, F.filter(F.split(t, "\n"), lambda s: s.rlike(r"[^\x20\x09-\x0D]")))
    n = F.size(words)
    windows = F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(words, i, WINDOW)))
    df = df.withColumn(hashes, F.when(n >= WINDOW, windows).otherwise(F.array().cast("array<bigint>")))
    # only where some window repeats are they put in order, to see which
    ordered = F.array_sort(F.transform(F.col(hashes), lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn(ranked, F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), ordered))
    twice = F.transform(F.col(ranked), lambda s, j: F.when((F.get(ranked, j - 1)["h"] == s["h"]) | (F.get(ranked, j + 1)["h"] == s["h"]), s["i"]))
    df = df.withColumn(again, F.array_sort(F.array_compact(twice)))
    covered = F.aggregate(F.transform(F.col(again), lambda i, j: F.least(F.lit(WINDOW), F.coalesce(F.get(again, j + 1) - i, F.lit(WINDOW)))), F.lit(0), lambda s, x: s + x)

    def kept(pattern: str) -> Column:
        return F.char_length(F.regexp_replace(t, pattern, ""))

    n_lines = F.size(lines)
    df = df.withColumn(
        f"{p}counts",
        F.struct(
            n.cast("long").alias("n_words"),
            F.char_length(F.array_join(words, "")).cast("long").alias("word_chars"),
            kept(r"[^#*$%&|<>]+").cast("long").alias("n_symbols"),
            (n_lines - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
            F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
            kept(r"\P{Lu}+").alias("upper"),
            kept(r"[^!?]+").alias("marks"),
            F.size(F.array_distinct(words)).alias("distinct"),
            n_lines.alias("lines"),
        ),
    )
    c = {name: F.col(f"{p}counts")[name] for name in (*STATS, "upper", "marks", "distinct", "lines")}
    chars, count = F.greatest(c["word_chars"], F.lit(1)), F.greatest(c["n_words"], F.lit(1))
    features = {
        "words": c["n_words"].cast("double"),
        "mean_word": c["word_chars"] / count,
        "symbols": c["n_symbols"] / count,
        "capitals": c["upper"] / chars,
        "marks": c["marks"] / count,
        "dup_lines": c["n_dup_lines"] / F.greatest(c["lines"], F.lit(1)),
        "repeats": c["n_repeat_words"] / count,
        "distinct": c["distinct"] / count,
        "line_words": c["n_words"] / F.greatest(c["lines"], F.lit(1)),
    }
    whole = F.struct(*[c[s].alias(s) for s in STATS], *[features[f].alias(f) for f in FEATURES])
    # always true, but not deterministic to the optimizer: a filter on the statistics stays above
    # this projection, and isn't rewritten into the lambdas below it
    return df.withColumn(out, F.when(F.spark_partition_id() >= 0, whole)).drop(t, words, lines, hashes, ranked, again, f"{p}counts")


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self, of) -> Column:
        return of(self.feature) > self.threshold if self.above else of(self.feature) <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:g}"


def _all(conditions, of) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c.column(of)
    return out


def _gain(p: int, n: int, p0: int, n0: int) -> float:
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p and p0 else 0.0


def _place(value: Column, cuts: list[float]) -> Column:
    """How many thresholds the value exceeds."""
    return F.size(F.filter(F.array(*map(F.lit, cuts)), lambda x: value > x)).cast("short")


def learn(labelled: DataFrame) -> list[tuple[Condition, ...]]:
    """``labelled``: a stored table of FEATURES, bad (boolean) and grow (boolean). Rules, in order."""
    of = F.col
    counts = {r["bad"]: r["count"] for r in labelled.groupBy("bad").count().collect()}
    if not counts.get(True) or not counts.get(False):
        return []
    probes = [i / (THRESHOLDS + 1) for i in range(1, THRESHOLDS + 1)]
    marks = labelled.groupBy("bad").agg(*[F.percentile_approx(f, probes, 2000).alias(f) for f in FEATURES]).collect()
    cuts = {f: sorted({float(x) for r in marks for x in r[f]}) for f in FEATURES}
    # each feature's place among its thresholds, found once; from here on only these small numbers count
    places = [_place(of(f), cuts[f]).alias(f"at_{f}") for f in FEATURES]
    table = stored(labelled.select("bad", "grow", *FEATURES, *places), "places")
    rules: list[tuple[Condition, ...]] = []
    left = F.lit(True)
    while len(rules) < MAX_RULES:
        rule: tuple[Condition, ...] = ()
        while len(rule) < MAX_CONDITIONS:
            rows = table.where(left & _all(rule, of) & F.col("grow"))
            cells = rows.select("bad", F.posexplode(F.array(*[F.col(f"at_{f}") for f in FEATURES])).alias("feature", "at")).groupBy("feature", "at").agg(F.count_if("bad").alias("p"), F.count_if(~F.col("bad")).alias("n")).collect()
            found: dict[int, dict[int, tuple[int, int]]] = {}
            for r in cells:
                found.setdefault(r["feature"], {})[r["at"]] = (r["p"], r["n"])
            if not found:
                break
            p0, n0 = (sum(v[i] for v in next(iter(found.values())).values()) for i in (0, 1))
            if not p0 or not n0:
                break
            best, chosen = 1e-9, None
            for k, f in enumerate(FEATURES):
                p = n = 0
                for j, x in enumerate(cuts[f]):  # rows at places 0..j are those that don't exceed threshold j
                    dp, dn = found.get(k, {}).get(j, (0, 0))
                    p, n = p + dp, n + dn
                    for above, a, b in ((False, p, n), (True, p0 - p, n0 - n)):
                        if (g := _gain(a, b, p0, n0)) > best:
                            best, chosen = g, Condition(f, above, x)
            if chosen is None:
                break
            rule = (*rule, chosen)
        if not rule:
            break
        # prune: of the rule's beginnings the one with the best (p - n) / (p + n) on the other rows
        held = table.where(left & ~F.col("grow"))
        tests = [_all(rule[: i + 1], of) for i in range(len(rule))]
        row = held.agg(F.count_if("bad").alias("bad"), *[F.count_if(t & F.col("bad")).alias(f"p{i}") for i, t in enumerate(tests)], *[F.count_if(t & ~F.col("bad")).alias(f"n{i}") for i, t in enumerate(tests)]).first()
        worth = [((row[f"p{i}"] - row[f"n{i}"]) / (row[f"p{i}"] + row[f"n{i}"]) if row[f"p{i}"] + row[f"n{i}"] else -1.0, i) for i in range(len(rule))]
        top = max(w for w, _ in worth)
        keep = next(i for w, i in worth if w >= top - 1e-3)
        p, n = row[f"p{keep}"], row[f"n{keep}"]
        if p < MIN_SHARE * max(1, row["bad"]) or not p or p / (p + n) < MIN_PRECISION:
            break
        rules.append(rule[: keep + 1])
        left = left & ~_all(rules[-1], of)
    discard(table)
    return rules


def labelled_ids(labels: DataFrame, bound: int = MAX_LABELLED) -> DataFrame:
    """(label_id, bad): ``bound`` labelled rows at most on average, chosen by hash; all where there are fewer."""
    known = labels.where("doc_id is not null and quality is not null")
    share = min(1.0, bound / max(1, known.count()))
    chosen = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    return chosen.groupBy(F.col("doc_id").alias("label_id")).agg((F.min("quality") == 0).alias("bad"))


def _training(stats: DataFrame, ids: DataFrame, key: Column, of: Column) -> DataFrame:
    """Statistics of the labelled documents. ``ids`` is bounded, so it can go to every task."""
    rows = stats.join(F.broadcast(ids), key == F.col("label_id"))
    return rows.select(*[of[f].alias(f) for f in FEATURES], "bad", (F.pmod(F.xxhash64("label_id", F.lit("grow")), F.lit(3)) > 0).alias("grow"))


def base_failed(of) -> Column:
    return (of("n_words") < 20) | (100 * of("n_repeat_words") > 30 * of("n_words"))


def rule_expression(rules: list[tuple[Condition, ...]], of) -> Column:
    """The first rule that fires, as text; null where none does."""
    out = None
    for i, rule in enumerate(rules):
        name = F.lit(f"{i + 1}: " + " and ".join(map(str, rule)))
        out = F.when(_all(rule, of), name) if out is None else out.when(_all(rule, of), name)
    return F.lit(None).cast("string") if out is None else out


def judged(docs: DataFrame, labels: DataFrame, bound: int = MAX_LABELLED, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: doc_id, STATS, base_failed, kept and the rule that rejects it."""
    slim = with_stats(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")), "text", "s").select("doc_id", "s")
    table = stored(slim, "stats")
    train = stored(_training(table, labelled_ids(labels, bound), F.col("doc_id"), F.col("s")), "labelled")
    rules = learn(train)
    of = lambda name: F.col("s")[name]
    rule = rule_expression(rules, of)
    out = table.select("doc_id", *[of(s).alias(s) for s in STATS], base_failed(of).alias("base_failed"), rule.alias("rule"))
    return out.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull()).withColumnRenamed("doc_id", key)


def kept(docs: DataFrame, labels: DataFrame, bound: int = MAX_LABELLED, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass, with its columns. Only labelled texts are read for the fit."""
    ids = labelled_ids(labels, bound)
    sample = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(ids.select("label_id")), F.col("doc_id") == F.col("label_id"), "left_semi")
    train = stored(_training(with_stats(sample, "text", "s"), ids, F.col("doc_id"), F.col("s")), "labelled")
    rules = learn(train)
    s = fresh(docs, "stats")
    of = lambda name: F.col(s)[name]
    measured = with_stats(docs, text, s)
    return measured.where(~base_failed(of) & rule_expression(rules, of).isNull()).drop(s)
