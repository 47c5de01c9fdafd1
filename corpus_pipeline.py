"""A training corpus from raw documents, in stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtrace.llm.common import passing, stage
from loomtrace.llm.decontaminate import drop_contaminated
from loomtrace.llm.langid import drop_unknown, remainder, train
from loomtrace.llm.packing import pack
from loomtrace.llm.parity import linked_groups, parted
from loomtrace.llm.pii import redact


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in some language stay; those without a letter, and null texts, go."""
    model = train(docs.where(remainder(F.col("doc_id"), 4) != 2))
    return drop_unknown(docs, model)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles at 0.8, the one with the smallest id stays.

    Of rows that repeat id and text the one with the smallest other columns stays,
    of an id with several linked texts that of the smallest text hash. Texts without
    words are linked with nothing; null ids take no part and stay.
    """
    with passing(spark):
        found = linked_groups(docs, 5, 80, 100)
        group = F.when(F.col("node").isNotNull(), F.struct(F.col("node").alias("a"), F.lit(None).cast("bigint").alias("b"))).otherwise(F.struct(F.col("doc_id").alias("a"), F.col("text_hash").alias("b")))
        kept = found.groupBy(group.alias("group")).agg(F.min(F.struct("doc_id", "text_hash")).alias("kept")).select("kept.*")
        kept = stage(kept, "kept", keep=True)
        rows = found.groupBy("doc_id", "text_hash").agg(F.count("*").alias("n")).join(kept.withColumn("stays", F.lit(True)), ["doc_id", "text_hash"], "left")
        unsure = stage(rows.where("stays is null or n > 1").select("doc_id"), "unsure")
        # most rows stay as they are, and their texts do not move; the others meet what is kept
        whole, some = parted(docs, unsure)
    names = docs.columns
    hashed = some.withColumn("__hash", F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    named = hashed.join(kept.withColumnRenamed("text_hash", "__hash"), ["doc_id", "__hash"], "left_semi")
    once = named.groupBy("doc_id", "__hash").agg(F.min(F.struct(*[F.col(f"`{c}`") for c in names])).alias("__row")).select("__row.*")
    return whole.unionByName(once.select(names)).unionByName(docs.where("doc_id is null"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, whole or edited, go."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is replaced by its kind."""
    return redact(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 2048, one row a piece; fewer words are remembered, for executors still hold what earlier stages took."""
    return pack(docs, words=300_000)


STAGES = [
    ("language_id", language_id),
    ("jaccard_join", jaccard_join),
    ("decontamination", decontaminate),
    ("pii", mask_pii),
    ("best_fit_packing", best_fit_packing),
]

#: Mixture inference, the random field and packing are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    last: list[str] = []
    for name, step in STAGES[:-1]:
        with passing(spark) as held:
            docs = stage(step(spark, docs, sf_dir), name)
            held[-1:], last = last, held[-1:]  # the table of the stage before goes
    return STAGES[-1][1](spark, docs, sf_dir)
