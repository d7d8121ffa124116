"""From documents to packed training sequences: quality, language, near-duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridwell.llm import language, nearcopies, packing, quality, repeats
from gridwell.llm.common import crc_mod, shared_folder, unused, written

#: A document stays with at least this probability of good quality, and with this share of its main language.
GOOD, MAIN_SHARE = 0.3, 0.5


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose lines make a good whole; the field is learned from labels that op2 doesn't hold out."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.learn(docs, labels, crc_mod("doc_id", 5) != 0)
    own = unused("_good", docs)
    return quality.score(docs, model, own).where(F.col(own) >= GOOD).select(*docs.columns)


def keep_one_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a known language that makes up most of them; learned from documents that op8 doesn't hold out. Where these have no label, all with a letter."""
    model = language.learn(docs, crc_mod("doc_id", 4) != 2)
    if not model.names:  # nothing was learned, so nothing tells languages
        return docs.where(F.col("text").rlike(r"\p{L}"))
    own = unused("_own_", docs)
    return language.predict(docs, model, own).where((F.col(own + "lang_pred") != language.UNKNOWN) & (F.col(own + "score") >= MAIN_SHARE)).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of similar texts (five-word shingles, Jaccard 0.8 or more) connect, one row stays: the one with the smallest doc_id.

    A row without an id gives way to others without an id alone: one of each component stays.
    """
    own = unused("_own_", docs)
    key, times = own + "key", own + "times"
    row = F.xxhash64(*docs.columns, *(F.col(c).isNull() for c in docs.columns))  # the hash alone skips nulls
    marked = nearcopies.near_copies(docs.select("doc_id", "text", row.alias("key"))).groupBy("key").agg(*(F.first(c).alias(c) for c in ("doc_id", "root")), F.count("*").alias("times"))
    chosen = marked.groupBy("root", F.col("doc_id").isNull()).agg(F.min(F.struct("doc_id", "key", "times")).alias("row"))
    chosen = written(chosen.select(F.col("row.key").alias(key), F.col("row.times").alias(times)))
    keyed = docs.withColumn(key, row)
    once, repeated = (keyed.join(chosen.where(c).select(key), key, "left_semi") for c in (F.col(times) == 1, F.col(times) > 1))
    return once.unionByName(repeated.dropDuplicates([key])).select(*docs.columns)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that earlier documents have; unchanged where there are none, and no empty rest stays."""
    own = unused("_own_", docs)
    left = repeats.remove_repeats(docs, prefix=own)
    changed = F.col(own + "n_removed") > 0
    out = left.where(~changed | (F.col(own + "n_removed") < F.col(own + "n_words"))).withColumn("text", F.when(changed, F.col(own + "kept")).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(changed, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of the documents' pieces in sequences of at most 2048 tokens."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality", keep_good),
    ("language", keep_one_language),
    ("near_duplicates", drop_near_duplicates),
    ("repeats", drop_repeats),
    ("packing", pack),
]

#: The stages hold trained models, fingerprints and tokens, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; what comes between is written to the shared folder."""
    shared_folder(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
