"""Helpers shared by the corpus operators: tables, held-out splits, bounded batches."""

from __future__ import annotations

import pathlib
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from incidentlab.session import shared_dir

BATCH_BYTES = 4_000_000
TEXT = "__whole_text"


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Gives the package to the executors of this application, once. The driver's file server hands it out."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        package = pathlib.Path(__file__).resolve().parents[1]
        target = pathlib.Path(tempfile.mkdtemp(prefix="package-")) / f"{package.name}.zip"
        with zipfile.ZipFile(target, "w") as held:
            for file in sorted(package.rglob("*.py")):
                held.write(file, file.relative_to(package.parent))
        context.addPyFile(str(target))
        _shipped.add(context.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id written as text, modulo ``parts``. A NULL id counts as the empty text."""
    text = F.coalesce(doc_id.cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % parts


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared folder that the cluster names."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Removes a folder below the shared folder, by Hadoop, which knows the store it is in."""
    held = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    held.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(held, True)


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Pieces of a batch with about ``limit`` bytes of text; one row at least, however long."""
    sizes = pc.binary_length(batch.column(column)).to_pylist() if batch.num_rows else []
    start = held = 0
    for row, size in enumerate(sizes):
        if held and held + (size or 0) > limit:
            yield batch.slice(start, row - start)
            start, held = row, 0
        held += size or 0
    if start < batch.num_rows:
        yield batch.slice(start)


def map_texts(docs: DataFrame, make: Callable[[], Callable], schema: str | T.StructType) -> DataFrame:
    """Rows made from (doc_id, text) batches, without a shuffle.

    ``make`` runs once in each task and returns a function from (ids, texts)
    to a dict of columns. A NULL text reaches it as the empty string.
    """
    fields = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema
        arrow, work = to_arrow_schema(fields), make()
        for batch in batches:
            for part in slices(batch):
                out = work(part.column("doc_id").to_pylist(), part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)

    return rows.mapInArrow(run, fields)


def append_columns(docs: DataFrame, make: Callable[[], Callable], added: str) -> DataFrame:
    """The rows of ``docs`` with further columns made from their text, without a shuffle.

    ``make`` runs once in each task and returns a function from texts to a dict
    of columns. Columns of ``docs`` that have an added name are replaced.
    """
    new = T._parse_datatype_string(added)
    kept = docs.drop(*[c for c in docs.columns if c in set(new.names)])
    rows = kept.withColumn(TEXT, F.coalesce(F.col("text").cast("string"), F.lit("")))

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_type
        types, work = [to_arrow_type(f.dataType) for f in new], make()
        for batch in batches:
            for part in slices(batch, TEXT):
                out = work(part.column(TEXT).to_pylist())
                old = [part.column(i) for i, n in enumerate(part.schema.names) if n != TEXT]
                names = [n for n in part.schema.names if n != TEXT]
                yield pa.RecordBatch.from_arrays([*old, *(pa.array(out[f.name], t) for f, t in zip(new, types))],
                                                 [*names, *new.names])

    return rows.mapInArrow(run, T.StructType([*kept.schema.fields, *new.fields]))


def bounded_sample(rows: DataFrame, label: str, per_label: int, max_labels: int = 256) -> DataFrame:
    """About ``per_label`` rows of each label, drawn by a hash of doc_id; at most twice as many in all.

    The counts of the labels go through the driver: one row for each label,
    and more than ``max_labels`` of them raise.
    """
    counts = rows.groupBy(label).count().limit(max_labels + 1).collect()
    if len(counts) > max_labels:
        raise ValueError(f"more than {max_labels} labels")
    draw = F.lit(False)
    for row in counts:
        share = min(1.0, 1.2 * per_label / row["count"])
        draw = draw | ((F.col(label) == F.lit(row[label])) & (F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1_000_000)) < int(1e6 * share)))
    return rows.where(draw).limit(2 * per_label * max(1, len(counts)))


def window_of(text: Column, size: int) -> Column:
    """At most ``size`` characters of a text, from a place drawn by a hash; whole where it is shorter."""
    spare = F.greatest(F.length(text) - size, F.lit(0))
    return F.substr(text, F.pmod(F.xxhash64(text), spare + 1).cast("int") + 1, F.lit(size))
