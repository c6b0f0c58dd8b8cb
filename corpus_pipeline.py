"""From raw documents to packed training sequences: five stages over the corpus operators.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. ``run`` writes
each result as Parquet into the shared folder and rereads it for the next
stage. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from incidentlab.llm import best_fit, dart_minhash, decontaminate, language_id, suffix_dedup
from incidentlab.llm.common import scratch, ship, table
from incidentlab.llm.tokens import public_file

#: Documents whose best language has less probability are rejected, as are those without letters.
MIN_LANGUAGE_SCORE = 0.3


def _like(docs: DataFrame, rows: DataFrame) -> DataFrame:
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns])


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in no known language: NULL or letterless texts and those of low probability.

    The model is learned from the stage's own input. Where the input has no
    labelled language at all, nothing is known and nothing is dropped but
    texts without letters.
    """
    model = language_id.fit(language_id.training_rows(docs))
    if not model.languages:
        return docs.where(F.coalesce(F.col("text"), F.lit("")).rlike(r"\p{L}"))
    named = language_id.identify(docs, model, ("__lang", "__score"))
    return _like(docs, named.where((F.col("__lang") != language_id.UND) & (F.col("__score") >= MIN_LANGUAGE_SCORE)))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each near-duplicate group. Repeated rows of one id and text become one; rows
    without an id stay."""
    classes = dart_minhash.near_duplicates(docs.where(F.col("doc_id").isNotNull()))
    first = classes.where(F.col("doc_id") == F.col("class_id")).select("doc_id")
    repeated = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("__n")).where(
        (F.col("__n") > 1) & F.col("doc_id").isNotNull()).select("doc_id")
    known = docs.join(first, "doc_id", "left_semi")
    once = known.join(repeated, "doc_id", "left_anti")
    several = known.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return _like(docs, once).unionByName(_like(docs, several)).unionByName(docs.where(F.col("doc_id").isNull()))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts bytes that repeat an earlier document out of the texts; documents of which nothing is left go.

    A cut may fall inside a character; what is left of it is dropped. ``n_chars`` follows the text.
    """
    names = {c: f"__{i}" for i, c in enumerate(docs.columns)}
    carry = {c: n for c, n in names.items() if c != "text"} | {"__null": "__null"}
    cut = suffix_dedup.remove_repeats(docs.withColumn("__null", F.col("text").isNull()), texts=("kept_text",), carry=carry)
    kept, changed = F.col("kept_text"), F.col("n_removed") > 0
    columns = []
    for c, kind in docs.dtypes:
        if c == "text":
            columns.append(F.when(~F.col("__null"), kept).alias(c))
        elif c == "n_chars":
            columns.append(F.when(changed, F.length(kept).cast(kind)).otherwise(F.col(names[c])).alias(c))
        else:
            columns.append(F.col(names[c]).alias(c))
    return cut.where(~changed | (F.length(F.trim(kept)) > 0)).select(columns)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    found = decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return _like(docs, docs.join(found, "doc_id", "left_anti"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the token pieces of all documents into sequences of 2048 tokens."""
    parts = best_fit.pieces(docs, public_file("word_bpe_49k.json"))
    packed = best_fit.pack(parts)
    return packed.select("doc_id", F.col("piece").cast("int").alias("piece"), "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("language_id", keep_languages),
    ("near_dedup", drop_near_copies),
    ("suffix_dedup", cut_repeats),
    ("decontamination", drop_benchmark_leaks),
    ("packing", pack_sequences),
]

#: Trained weights and tokenizers have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs, folder = table(spark, sf_dir, "documents"), scratch(spark, "corpus")
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
