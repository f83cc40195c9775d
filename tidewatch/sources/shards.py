"""Feature shards with a manifest: a batch sink whose tasks write Parquet files of a bounded size, and whose commit lists them.

``df.write.format("feature_shards").mode("append").save(folder)`` - each task closes a file and begins the next after ``shard_bytes``, and tells
the driver its files with their rows, bytes and positives. Only when all tasks have ended the manifest is written, beside the old one and then in its
place: files of tasks that failed, or of an attempt that was repeated, are in no manifest, and are removed where the job is given up.
:func:`read` takes what the manifest lists and nothing else.
"""

from __future__ import annotations

import json
import posixpath
import re
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

MANIFEST = "manifest.json"
SHARD_BYTES, BATCH_ROWS = 64 << 20, 5000


def _store(path: str):
    from pyarrow import fs

    if re.match(r"(file:)?/", path):
        return fs.LocalFileSystem(), re.sub(r"^file:/*", "/", path)
    return fs.FileSystem.from_uri(re.sub(r"^s3a:", "s3:", path))


def manifest_of(path: str) -> dict | None:
    store, root = _store(path)
    from pyarrow import fs

    at = posixpath.join(root, MANIFEST)
    if store.get_file_info(at).type == fs.FileType.NotFound:
        return None
    with store.open_input_stream(at) as f:
        return json.loads(f.read())


@dataclass
class Written(WriterCommitMessage):
    files: list


class ShardWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, schema, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        self.limit, self.label = int(options.get("shard_bytes", SHARD_BYTES)), options.get("label", "y")
        self.columns = schema.names
        self.run = uuid.uuid4().hex[:12]

    def write(self, iterator) -> Written:
        import pyarrow as pa
        import pyarrow.compute as pc
        import pyarrow.parquet as pq
        from pyspark import TaskContext

        store, root = _store(self.path)
        store.create_dir(root, recursive=True)
        task, files, writer = TaskContext.get(), [], None
        for batch in iterator:
            for at in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(at, BATCH_ROWS)
                if writer is None:
                    name = f"shard-{self.run}-{task.partitionId():05d}-{task.taskAttemptId()}-{len(files):04d}.parquet"
                    writer = pq.ParquetWriter(posixpath.join(root, name), part.schema, compression="zstd", filesystem=store)
                    files.append({"file": name, "rows": 0, "bytes": 0, "positives": 0})
                writer.write_table(pa.Table.from_batches([part]))
                own = files[-1]
                own["rows"], own["bytes"] = own["rows"] + part.num_rows, own["bytes"] + part.nbytes
                if self.label in part.schema.names:
                    own["positives"] += int(pc.sum(pc.cast(part.column(self.label), pa.int64())).as_py() or 0)
                if own["bytes"] >= self.limit:
                    writer.close()
                    writer = None
        if writer is not None:
            writer.close()
        return Written(files)

    def _listed(self, messages: list) -> list[dict]:
        return sorted((f for m in messages if m is not None for f in m.files), key=lambda f: f["file"])

    def commit(self, messages: list) -> None:
        store, root = _store(self.path)
        store.create_dir(root, recursive=True)
        before = manifest_of(self.path) or {"files": []}
        kept = [] if self.overwrite else before["files"]
        new = json.dumps({"columns": self.columns, "files": kept + self._listed(messages)}, indent=1)
        beside = posixpath.join(root, f".{MANIFEST}-{self.run}")
        with store.open_output_stream(beside) as f:
            f.write(new.encode())
        store.move(beside, posixpath.join(root, MANIFEST))
        if self.overwrite:
            for old in before["files"]:
                store.delete_file(posixpath.join(root, old["file"]))

    def abort(self, messages: list) -> None:
        store, root = _store(self.path)
        for f in self._listed(messages):
            store.delete_file(posixpath.join(root, f["file"]))


class FeatureShards(DataSource):
    """Options: path, shard_bytes, label (whose positives are counted)."""

    @classmethod
    def name(cls) -> str:
        return "feature_shards"

    def schema(self) -> str:
        raise ValueError("shards are read by tidewatch.sources.shards.read")

    def writer(self, schema, overwrite: bool) -> ShardWriter:
        return ShardWriter(self.options, schema, overwrite)


def write(df: DataFrame, path: str, mode: str = "append", shard_bytes: int = SHARD_BYTES, label: str = "y") -> None:
    spark = df.sparkSession
    spark.dataSource.register(FeatureShards)
    df.write.format("feature_shards").mode(mode).option("shard_bytes", str(shard_bytes)).option("label", label).save(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the files that the manifest lists."""
    found = manifest_of(path)
    if not found or not found["files"]:
        raise ValueError(f"{path} has no manifest, or one without files")
    return spark.read.parquet(*[f"{path.rstrip('/')}/{f['file']}" for f in found["files"]])


def stats(path: str) -> list[tuple[str, int, int]]:
    """(file, rows, positives), as :func:`reports.split_shards` takes them: from the manifest, without a look at the files."""
    return [(f["file"], f["rows"], f["positives"]) for f in (manifest_of(path) or {"files": []})["files"]]
