"""A training corpus from the documents table, in five stages.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and
returns a DataFrame, which is written as Parquet and read again as the next
one's docs.  All but the last return the columns of documents:

1. toxicity          documents predicted toxic go
2. line_dedup        repeated and nearly repeated lines go; a document that loses all its text goes
3. ngram_join        one document of each group of near copies stays, the smallest id
4. decontaminate     documents that hold a passage of the benchmark go
5. mix_sources       how many words the mix takes of every document that is left
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm._io import table, text_batches
from tidemark.llm.decontamination import decontaminate
from tidemark.llm.line_dedup import line_dedup
from tidemark.llm.mixing import mix_sources
from tidemark.llm.ngram_join import ngram_join, word_digest
from tidemark.llm.toxicity import score_toxicity
from tidemark.session import checkpoint_dir, cut_lineage, drop_path


BROADCAST_ROWS = 1 << 20        # rows of an id and a digest: about 60 MB at most


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that are not predicted toxic, unchanged."""
    text_batches(spark)
    scored = score_toxicity(docs, table(spark, sf_dir, "labels"), carry=True)
    return scored.where("predicted = 0").select("row.*")


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without the lines that repeat earlier ones (n_chars follows); those
    that had text and have none left go.  NULL and blank texts stay as they are."""
    out = line_dedup(docs, with_text=True, carry=True, exact_chars=1)
    blank = (F.size("removed") > 0) & (F.length(F.btrim("kept", F.lit(" \t\r\n"))) == 0)
    changed = F.size("removed") > 0
    columns = [F.when(changed, F.col("kept")).otherwise(F.col("row.text")).alias("text") if c == "text" else
               F.when(changed, F.length("kept")).otherwise(F.col("row.n_chars")).cast(docs.schema[c].dataType).alias(c)
               if c == "n_chars" else F.col("row").getField(c).alias(c) for c in docs.columns]
    return out.where(~F.coalesce(blank, F.lit(False))).select(*columns)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies; repeated rows of one id and word sequence become
    one.  Each row goes or stays by its own text.  Rows without words or without id stay."""
    text_batches(spark)
    fate = ngram_join(docs, with_digest=True).where("digest is not null").groupBy(
        F.col("doc_id").alias("_id"), F.col("digest").alias("_digest")).agg(F.max("kept").alias("_kept"), F.count(F.lit(1)).alias("_n"))
    act = cut_lineage(fate.where("not _kept or _n > 1"))
    if act.count() <= BROADCAST_ROWS:
        act = F.broadcast(act)
    # a text's digest is worked out where the id meets: no join key, and so not for every row
    same = (F.col("doc_id") == F.col("_id")) & F.coalesce(word_digest(F.col("text")) == F.col("_digest"), F.lit(False))
    stay = docs.join(act, same, "left_anti")
    twice = docs.join(act.where("_kept"), same, "left_semi").withColumn("_words", word_digest(F.col("text"))).dropDuplicates(
        ["doc_id", "_words"])
    return stay.select(*docs.columns).unionByName(twice.select(*docs.columns))


def decontaminate_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in which no window of a benchmark item occurs, unchanged."""
    text_batches(spark)
    out = decontaminate(docs, table(spark, sf_dir, "benchmark"), carry=True)
    return out.where("not contaminated").select("row.*")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, epochs, cut) of every document."""
    return mix_sources(docs)


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", dedup_lines),
    ("ngram_join", dedup_documents),
    ("decontaminate", decontaminate_documents),
    ("mix_sources", mix),
]

#: SQL has no trained classifier: the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents; each result but the last goes through Parquet in the shared
    folder.  The checkpoints of a stage lie in a folder of its own, which goes, with the
    stage's input, once its result is written."""
    docs, sc = table(spark, sf_dir, "documents"), spark.sparkContext
    shared = checkpoint_dir(spark)
    base = f"{shared}/pipeline-{uuid.uuid4().hex}"
    before = None
    for k, (name, stage) in enumerate(STAGES):
        if k == len(STAGES) - 1:
            return stage(spark, docs, sf_dir)
        scratch, path = f"{base}/checkpoints-{k}", f"{base}/{k}-{name}"
        try:
            sc.setCheckpointDir(scratch)
            stage(spark, docs, sf_dir).write.parquet(path)
        finally:
            sc.setCheckpointDir(shared)
        for old in filter(None, (scratch, before)):
            drop_path(spark, old)
        before, docs = path, spark.read.parquet(path)
    return docs
