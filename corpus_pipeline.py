"""The corpus pipeline: documents in, pieces of packed sequences out.

Each stage takes (spark, docs, sf_dir) and works on every row its predecessor kept; all but the last
return the columns of documents. ``run`` writes each stage's rows as Parquet and rereads them.
Null texts and texts without words pass the toxicity stage and are rejected by the language stage as
having no language. Rows without a doc_id are never judged copies of others. Rows that share a doc_id but not their
text are documents of their own. An empty table gives no rows.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluvia.llm import language, pii, simhash, toxicity
from fluvia.llm.base import discard, fold, map_rows, scratch, table, written
from fluvia.llm.packing import pack


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents with a toxicity score of 0.5 or more; learns from the labels of those of ``docs`` that op3 doesn't hold out."""
    out = F.coalesce(fold("doc_id", 5) == 0, F.lit(False))
    shared = spark.sparkContext.broadcast(toxicity.fit(toxicity.labelled_sample(docs, table(spark, sf_dir, "labels"), out)))

    def make():
        scorer = toxicity.Scorer(shared.value) if shared.value is not None else None

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            if scorer is None:
                return batch
            texts = [t or "" for t in batch.column("text").to_pylist()]
            return batch.filter(pa.array([score < 0.5 for score, _ in scorer.scores(texts)], pa.bool_()))

        return work

    return map_rows(docs, make)


def reject_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language: null texts, texts without a letter, and those whose language is ambiguous. Where no row names a language, any text with a letter stays."""
    out = F.coalesce(fold("doc_id", 3) == 1, F.lit(False))
    shared = spark.sparkContext.broadcast(language.learn(docs, out))

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = batch.column("text").to_pylist()
            if not shared.value.languages:
                return batch.filter(pa.array([language.has_letter(t) for t in texts], pa.bool_()))
            found = shared.value.predict(texts)
            return batch.filter(pa.array([lang != "und" and not ambiguous for lang, _, ambiguous in found], pa.bool_()))

        return work

    return map_rows(docs, make, rows=64)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate group: that with the smallest doc_id, of several texts under it the one with the least hash."""
    found = simhash.near_duplicates(docs.where("doc_id IS NOT NULL"))
    first = found.groupBy("root").agg(F.min(F.struct("doc_id", "version")).alias("m")).select(F.col("m.doc_id").alias("__near_id"), F.col("m.version").alias("__near_version"))
    versions = docs.select(F.struct("*").alias("__row"), F.col("doc_id").alias("__near_id"), F.xxhash64("text").alias("__near_version"))  # columns of docs may have these names
    kept = versions.join(first, ["__near_id", "__near_version"], "left_semi").dropDuplicates(["__near_id", "__near_version"])
    return kept.select("__row.*").unionByName(docs.where("doc_id IS NULL"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in text by its kind in brackets and renews n_chars; keeps every document."""
    shared = spark.sparkContext.broadcast(pii.fit())
    kinds = dict(docs.dtypes)

    def make():
        tagger = pii.Tagger(shared.value)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = batch.column("text").to_pylist()
            clean = [pii.redact(t, base + added) for t, (base, added) in zip(texts, tagger.spans(texts), strict=True)]
            new = {"text": clean} | ({"n_chars": [None if t is None else len(t) for t in clean]} if kinds.get("n_chars") == "bigint" else {})
            for name, values in new.items():
                at = batch.schema.get_field_index(name)
                batch = batch.set_column(at, batch.schema.field(at), pa.array(values, batch.schema.field(at).type))
            return batch

        return work

    return map_rows(docs, make)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 4096 tokens."""
    return pack(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("language", reject_unknown_language),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", redact_personal_data),
    ("packing", pack_sequences),
]

#: Learned scores, fingerprints over XXH64 and tokenizers are beyond SQL; tests/llm compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        with scratch(spark):
            docs = written(stage(spark, docs, sf_dir), name, stays=True)
        if before is not None:
            discard(before)  # nothing reads the stage before any more
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
