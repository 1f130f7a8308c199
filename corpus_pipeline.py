"""A corpus from raw documents: toxicity, near-duplicates, repeated passages, benchmark leaks, mixing.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame; all but the last give the columns of documents.
A stage sees all that the one before kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from taskfold.llm import chunks, decontaminate, minhash, mixing, toxicity
from taskfold.llm.tables import named, stored, table


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go."""
    model = toxicity.fitted(docs, table(spark, sf_dir, "labels"))
    return toxicity.scored(docs, model).filter("predicted = 0").select("row.*")


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five words, 80 percent) the document with the smallest doc_id stays."""
    found = minhash.near_duplicates(docs)
    gone = found.filter("NOT kept").select("doc_id").distinct()
    return docs.join(gone.hint("shuffle_hash"), "doc_id", "left_anti").select(*map(named, docs.columns))


def without_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that a document with a smaller doc_id has too are cut out; every document stays."""
    cut = chunks.deduplicated(docs).withColumn("text", F.when(F.col("row.text").isNotNull(), F.col("kept")))
    new = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return cut.select(*[new[c].alias(c) if c in new else F.col("row")[c].alias(c) for c in docs.columns])


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go."""
    items = table(spark, sf_dir, "benchmark")
    return decontaminate.decontaminated(docs, items).filter("NOT contaminated").select("row.*")


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its place in the mix."""
    return mixing.mixed(docs, block_bytes=mixing.BLOCK_BYTES, quantum=mixing.QUANTUM)


STAGES = [
    ("toxicity", without_toxic),
    ("near_duplicates", without_near_duplicates),
    ("substring_dedup", without_repeated_passages),
    ("decontamination", without_benchmark),
    ("mixing", mixed_sources),
]

#: MinHash, chunk digests and the fitted lexicon are not for SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
