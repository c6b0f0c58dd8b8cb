"""Token ids as flat unsigned integer files with 64-bit document offsets.

Layout below one folder: ``ids-<p>-<attempt>.bin`` holds the ids of shard p,
little-endian, without header; ``offsets-<p>-<attempt>.bin`` holds one signed
64-bit number for each document (its first id, from the start of the shard)
and one for the end. ``shard_table`` names the file that counts for each
shard: a task that ran twice has left two files, and only the one whose row
Spark kept is named. The first id of a shard in the whole corpus is a prefix
sum over that table, which has one row for each shard.

NULL texts are empty (only the end id); repeated rows each count; rows with a
NULL id come first. An empty table gives no shards.
"""

from __future__ import annotations

import itertools
import os
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from incidentlab.llm.common import slices
from incidentlab.llm.tokens import encoder

SHARDS = "shard int, docs long, ids long, width int, ids_file string, offsets_file string, ids_key string"


def write_shards(docs: DataFrame, folder: str, file: str, end_id: int, width: int = 2, shards: int | None = None) -> DataFrame:
    """Writes the files; returns the shard table (not yet run). ``width``: bytes of an id, 2 or 4."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    count = shards or max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = rows.repartitionByRange(count, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    kind = np.dtype("<u2" if width == 2 else "<u4")

    def run(batches):
        from pyspark import TaskContext
        batches = (b for b in batches if b.num_rows)
        first = next(batches, None)
        if first is None:
            return
        task = TaskContext.get()
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        name = f"{task.partitionId():06d}-{task.taskAttemptId()}"
        coder, end = encoder(file), np.array([end_id], kind).tobytes()
        paths, total, number = (f"{root}/ids-{name}.bin", f"{root}/offsets-{name}.bin", f"{root}/docs-{name}.bin"), 0, 0
        with store.open_output_stream(paths[0]) as ids, store.open_output_stream(paths[1]) as at, \
                store.open_output_stream(paths[2]) as keys:
            for batch in itertools.chain([first], batches):
                for part in slices(batch):
                    coded = [np.frombuffer(coder.ids(t), "<u4") for t in part.column("text").to_pylist()]
                    sizes = np.array([len(c) + 1 for c in coded], np.int64)
                    at.write((total + np.cumsum(sizes) - sizes).astype("<i8").tobytes())
                    ids.write(b"".join(c.astype(kind).tobytes() + end for c in coded))
                    known = part.column("doc_id")
                    keys.write(np.array([[k is None, k or 0] for k in known.to_pylist()], "<i8").tobytes())
                    total, number = total + int(sizes.sum()), number + len(coded)
            at.write(np.array([total], "<i8").tobytes())
        yield pa.RecordBatch.from_pylist([{
            "shard": task.partitionId(), "docs": number, "ids": total, "width": width,
            "ids_file": paths[0], "offsets_file": paths[1], "ids_key": paths[2]}], schema=pa.schema([
                ("shard", pa.int32()), ("docs", pa.int64()), ("ids", pa.int64()), ("width", pa.int32()),
                ("ids_file", pa.string()), ("offsets_file", pa.string()), ("ids_key", pa.string())]))

    return ordered.mapInArrow(run, SHARDS)


def with_bases(spark: SparkSession, shard_table: DataFrame) -> DataFrame:
    """The shard table with ``base``, the ids before each shard. One row for each shard passes the driver."""
    rows = sorted(shard_table.collect(), key=lambda r: r.shard)
    bases = itertools.accumulate((r.ids for r in rows), initial=0)
    return spark.createDataFrame([(*r, b) for r, b in zip(rows, bases)], SHARDS + ", base long")


def _mapped(store, path: str, kind: str) -> np.ndarray:
    """The file as an array: memory-mapped where the store is a local one, else read."""
    if isinstance(store, fs.LocalFileSystem):
        return np.memmap(path, kind, "r") if os.path.getsize(path) else np.empty(0, kind)
    with store.open_input_file(path) as f:
        return np.frombuffer(f.read_buffer(), kind)


def read_shards(shard_table: DataFrame, folder: str, doc_rows: int = 4096) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files."""
    def run(batches):
        store, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for row in batch.to_pylist():
                ids = _mapped(store, row["ids_file"], "<u2" if row["width"] == 2 else "<u4")
                at = _mapped(store, row["offsets_file"], "<i8")
                keys = _mapped(store, row["ids_key"], "<i8").reshape(-1, 2)
                for k in range(0, row["docs"], doc_rows):
                    some = np.array(at[k:k + doc_rows + 1])
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.array(keys[k:k + doc_rows, 1]), mask=np.array(keys[k:k + doc_rows, 0]) > 0),
                        pa.array(some[:-1] + row["base"]), pa.array(some[1:] - some[:-1]),
                        pa.array([zlib.crc32(np.asarray(ids[a:b], "<u4").tobytes()) for a, b in zip(some, some[1:])], pa.int64()),
                    ], ["doc_id", "start", "n_tokens", "ids_crc32"])

    spread = shard_table.repartition(max(1, shard_table.sparkSession.sparkContext.defaultParallelism * 4))
    return spread.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
