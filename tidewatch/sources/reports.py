"""Sinks: feature tables, manifests, per-window CSV, per-capture JSON, host maps, metric reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def iso(micros: Column) -> Column:
    """Microseconds as ISO 8601 in UTC; the fraction only where there is one."""
    t = F.timestamp_micros(micros)
    return F.when(micros % 1_000_000 == 0, F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise(F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))


def stem(path: Column) -> Column:
    """A file's base name without its last extension."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/\\]*)$", 1), r"(?<=.)\.[^.]*$", "")


def write_features(features: DataFrame, path: str, rows_per_file: int = 5_000_000) -> None:
    """Parquet, a folder a capture, so that a capture's features are read alone."""
    features.write.mode("overwrite").option("compression", "zstd").option("maxRecordsPerFile", rows_per_file).partitionBy("capture").parquet(path)


def manifest(windows: DataFrame, packets: DataFrame, columns: list[str]) -> DataFrame:
    """One row a capture: windows, packets, duration in seconds, and the ordered list of feature columns."""
    w = windows.groupBy("capture").agg(F.count("*").alias("windows"))
    p = packets.groupBy("capture").agg(F.count("*").alias("packets"), ((F.max("us") - F.min("us")) / 1_000_000).alias("duration"))
    return w.join(p, "capture").withColumn("columns", F.lit(",".join(columns)))


def shard_stats(shards: DataFrame, label: str = "y") -> DataFrame:
    """Rows and positives of each file of a table, from two columns of the scan."""
    return shards.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count("*").alias("rows"), F.sum(F.col(label).cast("long")).alias("positives"))


def split_shards(stats: list[tuple[str, int, int]], shares=(0.70, 0.15)) -> dict[str, str]:
    """Files to train, val and test, most positives first; a validation set without positives swaps one in. ``stats``: one row a file."""
    order = sorted(stats, key=lambda s: (-s[2], s[0]))
    n = len(order)
    a, b = max(1, int(n * shares[0])), max(1, int(n * (shares[0] + shares[1])))
    parts = {"train": order[:a], "val": order[a:b], "test": order[b:]}
    if parts["val"] and not any(s[2] for s in parts["val"]) and sum(s[2] > 0 for s in parts["train"]) > 1:
        give = [s for s in parts["train"] if s[2]][-1]
        parts["train"].remove(give)
        parts["train"].append(parts["val"].pop(0))
        parts["val"].append(give)
    return {s[0]: name for name, files in parts.items() for s in files}


def window_lines(windows: DataFrame, real: list[str], times: list[str]) -> DataFrame:
    """Windows as text columns: six decimals, ISO times."""
    rest = [c for c in windows.columns if c not in real and c not in times]
    return windows.select(*[F.col(c).cast("string").alias(c) for c in rest], *[F.format_string("%.6f", F.col(c).cast("double")).alias(c) for c in real], *[iso(F.col(c)).alias(c) for c in times])


def ranked(rows: DataFrame, by: str, names: list[str]) -> DataFrame:
    """Adds a rank (from 1) within each capture, by falling ``by`` and then by name: of actors, for their files."""
    return rows.withColumn("rank", F.row_number().over(W.partitionBy("capture").orderBy(F.desc(by), *names)))


def write_csv(rows: DataFrame, path: str) -> None:
    """CSV with a header, a folder a capture (whose name stands in the folder's, and comes last when it is read)."""
    rows.select(*[c for c in rows.columns if c != "capture"], "capture").write.mode("overwrite").option("header", True).partitionBy("capture").csv(path)


def detail_lines(windows: DataFrame, score: str, threshold: float, kept: Column) -> DataFrame:
    """A window's score, the threshold, whether it is over it and whether it is kept after filtering: as text where they are real numbers."""
    text = lambda c: F.format_string("%.6f", c.cast("double"))
    return windows.select("capture", "window_index", text(F.col(score)).alias(score), text(F.lit(threshold)).alias("threshold"), (F.col(score) >= threshold).alias("raw_flag"), kept.alias("flagged"))


def interval_lines(spans: DataFrame, width: int, hop: int) -> DataFrame:
    """Intervals of windows as seconds from the capture's first window: start of the first and end of the last, windows, largest score."""
    text = lambda c: F.format_string("%.6f", c.cast("double"))
    start, end = F.col("first_window") * hop / 1_000_000, (F.col("last_window") * hop + width) / 1_000_000
    return spans.select("capture", text(start).alias("start"), text(end).alias("end"), F.col("length").alias("windows"), text(F.col("max_score")).alias("max_score"))


def verdict_json(verdicts: DataFrame) -> DataFrame:
    """A JSON document a capture."""
    return verdicts.select("capture", F.to_json(F.struct(*verdicts.columns)).alias("json"))


def host_map_json(counts: DataFrame) -> DataFrame:
    """{window: {host: packets}} of a capture as JSON; for small captures, the long table is the form to compute with."""
    per = counts.groupBy("capture", "window_index").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("host", "cnt")))).alias("hosts"))
    whole = per.groupBy("capture").agg(F.map_from_entries(F.collect_list(F.struct(F.col("window_index").cast("string").alias("k"), "hosts"))).alias("m"))
    return whole.select("capture", F.to_json("m").alias("json"))


def host_map_table(json: DataFrame) -> DataFrame:
    """The long table of such documents."""
    rows = json.select("capture", F.explode(F.from_json("json", "map<string,map<string,bigint>>")).alias("w", "hosts"))
    return rows.select("capture", F.col("w").cast("long").alias("window_index"), F.explode("hosts").alias("host", "cnt"))


def inferred_labels(files: DataFrame, path: str = "path") -> DataFrame:
    """Labels by file name: 'normal' is 0, 'mixed' is 1, 'ssdpflood' and all others are left out."""
    name = F.lower(F.regexp_extract(path, r"([^/\\]*)$", 1))
    y = F.when(name.contains("ssdpflood"), None).when(name.contains("normal"), 0).when(name.contains("mixed"), 1)
    return files.withColumn("label", y).where("label is not null")


def metrics_markdown(metrics: DataFrame) -> str:
    """One row of metrics as a table."""
    row = metrics.first().asDict()
    return "| metric | value |\n| --- | --- |\n" + "".join(f"| {k} | {v:.6f} |\n" if isinstance(v, float) else f"| {k} | {v} |\n" for k, v in row.items())


def summary_lines(verdicts: DataFrame) -> DataFrame:
    return verdicts.select(F.format_string("%s: %s, %d windows, max %.6f", "capture", "decision", F.col("attack_windows").cast("long"), F.col("max_prob").cast("double")).alias("line"))


def config_hash(spark: SparkSession, text: str) -> str:
    """SHA-256 of a canonical configuration text."""
    return spark.range(1).select(F.sha2(F.lit(text), 256)).first()[0]
