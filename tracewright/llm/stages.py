"""Stages of the corpus pipeline: each takes (spark, docs, sf_dir) and returns a DataFrame.

All but the last return doc_id, text, lang, source, n_chars.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm.jaccard_join import near_groups
from tracewright.llm.kernels import NULL_ID
from tracewright.llm.mixing import mix_sources
from tracewright.llm.packing import best_fit_packing
from tracewright.llm.quality import keep_quality
from tracewright.llm.spread import doc_key, read
from tracewright.llm.suffix_dedup import suffix_dedup

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. Null and repeated doc_ids, null and empty texts are scored as any row; an empty table stays empty; other columns than those of documents go."""
    return keep_quality(docs, read(spark, sf_dir, "labels"))


def _digested(docs: DataFrame) -> DataFrame:
    """The rows with key, a doc_id that is never null, and digest, of all columns but doc_id: rows that have both alike are alike."""
    rest = F.to_json(F.struct("lang", "source", "n_chars"))
    digest = F.sha2(F.concat_ws(":", F.coalesce(F.sha2("text", 256), F.lit("-")), rest), 256)
    return docs.select(*COLUMNS, doc_key(F.col("doc_id")).alias("key"), digest.alias("digest"))


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates one row stays: of the smallest doc_id (null ones are last), and of its rows the one with the smallest digest.

    Sets decide, not doc_ids: different texts under one doc_id, or without one, stay. Rows that are alike
    in all columns are one, but rows without words and doc_id are copies of nothing and all stay. An empty
    table stays empty; other columns than those of documents go.
    """
    rows = _digested(docs)
    near = near_groups(rows, carry=("digest",))
    first = near.where("component is not null").groupBy("component").agg(F.min(F.struct("doc_id", "digest")).alias("first")).select("first.*", F.lit(False).alias("every"))
    wordless = near.where("component is null").select("doc_id", "digest", (F.col("doc_id") == NULL_ID).alias("every")).distinct()
    stays = first.union(wordless).select(F.col("doc_id").alias("stays"), F.col("digest").alias("alike"), "every")
    kept = rows.join(stays, (rows["key"] == stays["stays"]) & (rows["digest"] == stays["alike"]))
    copy = F.when(F.col("every"), F.monotonically_increasing_id()).otherwise(0)
    return kept.withColumn("copy", copy).dropDuplicates(["key", "digest", "copy"]).select(*COLUMNS)


def repeats_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Long repeats go from texts; a document that loses all its text goes too.

    A null text becomes an empty one; empty texts, null doc_ids and repeated rows stay (rows of one doc_id
    never take from each other); an empty table stays empty; other columns than those of documents go.
    """
    out = suffix_dedup(docs, outputs=("text",), carry=("lang", "source"))
    return out.where("n_removed < n_bytes or n_bytes = 0").select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: what the mix leaves out goes, a text without words stays once.

    Rows are told apart by all their columns, so each text under a repeated or null doc_id has copies of its
    own, and rows that are alike share theirs. An empty table stays empty; other columns than those of
    documents go.
    """
    rows = _digested(docs)
    mixed = mix_sources(rows, carry=("digest",)).where("copies > 0")
    copies = mixed.groupBy(doc_key(F.col("doc_id")).alias("taken"), F.col("digest").alias("alike")).agg(F.sum("copies").alias("copies"))
    kept = rows.join(copies, (rows["key"] == copies["taken"]) & (rows["digest"] == copies["alike"])).dropDuplicates(["key", "digest"])
    return kept.select(*COLUMNS, F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy")).select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces in packed sequences; best_fit_packing() says how nulls, repeats and empty tables go."""
    return best_fit_packing(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality_classifier", quality_stage), ("ngram_jaccard_join", near_duplicates_stage), ("suffix_array_dedup", repeats_stage), ("source_mixing", mixing_stage), ("best_fit_packing", packing_stage)]
