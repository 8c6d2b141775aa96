"""A training-data pipeline over ``documents``: five stages, each over all that the one before kept.

1. language ID: documents without a recognised language go; ``lang`` becomes the predicted one.
2. near-dedup: one document of each class of near-duplicates stays (that with the smallest id; repeated rows of it once).
3. decontamination: documents that hold a benchmark item go.
4. secret scan: secrets are replaced by a mark in the text; no document goes.
5. BPE: tokens of the cleaned texts, encoded and decoded, as digests.

All but the last return the columns of ``documents``, whatever further columns there are. Rows that share a ``doc_id`` and a text
are one document, and the row that is kept of them is any; other texts under the same id are documents of their own. Rows with a null id pass stages 2 and 3 unchanged. Empty tables and
null or empty texts give empty results or are rejected in stage 1.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusgraph.llm import dartminhash, decontam, langid, queries, secrets
from corpusgraph.session import discard, materialise, ship, table

#: DuckDB SQL for run()'s rows; the stages can't be expressed in SQL, so they are tested against brute force.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    model = langid.train(docs)
    found = langid.predict_into(docs, model)
    return found.where(F.col("lang") != langid.UND).select(*docs.columns)


def _named(docs: DataFrame) -> tuple[DataFrame, bool]:
    """(docs with ``_key``, whether a key repeats): the document's id, but a key of its own for each further text under an id.

    Where no id repeats, which is counted first, that is the id and nothing is written.
    """
    repeated = docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    repeated = materialise(repeated, "repeated")
    if repeated.isEmpty():
        return docs.withColumn("_key", F.col("doc_id")), False
    digest = F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256)
    first = docs.join(_small(repeated), "doc_id", "left_semi").groupBy("doc_id").agg(F.min(digest).alias("_first"))
    own = F.xxhash64("doc_id", digest).cast(docs.schema["doc_id"].dataType)
    named = docs.join(first, "doc_id", "left").withColumn("_key", F.when(F.col("_first") != digest, own).otherwise(F.col("doc_id")))
    return materialise(named.select(*docs.columns, "_key"), "named"), True


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    named, again = _named(docs)
    drop = materialise(dartminhash.near_duplicates(named, id_col="_key").where("_key != class_id").select("_key").distinct(), "drop")
    kept = named.join(_small(drop), "_key", "left_anti")
    if not again:
        return kept.select(*docs.columns)
    repeated = materialise(kept.where("_key is not null").groupBy("_key").count().where("count > 1").select("_key"), "again")
    once = kept.join(_small(repeated), "_key", "left_semi").dropDuplicates(["_key"])
    return kept.join(_small(repeated), "_key", "left_anti").select(*docs.columns).unionByName(once.select(*docs.columns))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    named, _ = _named(docs)
    bad = materialise(decontam.contaminated(named, table(spark, sf_dir, "benchmark"), id_col="_key"), "leaks")
    return named.join(_small(bad), "_key", "left_anti").select(*docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    clean = secrets.cleaned(docs, vocab_path=queries.vocabulary())
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return queries.bpe_digests(docs)


def _small(ids: DataFrame) -> DataFrame:
    """A written table of ids, marked for broadcast where its counted size allows it."""
    return F.broadcast(ids) if ids.count() <= dartminhash.BROADCAST_ROWS else ids


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("redact_secrets", redact_secrets), ("bpe", bpe)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder, read again, and deleted after the next one."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        done, docs = docs, materialise(stage(spark, docs, sf_dir), name)
        discard(done)
    return docs
