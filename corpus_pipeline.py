"""The corpus pipeline: language id, near-duplicate removal, decontamination, mixing, token shards."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavegrid.llm import langid
from wavegrid.llm.common import materialize, maybe_broadcast
from wavegrid.llm.decontaminate import find_contamination
from wavegrid.llm.jaccard import jaccard_components
from wavegrid.llm.mixing import emit_copies, mix_sources
from wavegrid.llm.queries import langid_model, word_tokenizer
from wavegrid.llm.sstable import tokens_table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Documents whose predicted language has a smaller posterior are rejected.
MIN_SCORE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter, and those no learned language fits with a posterior of ``MIN_SCORE``. The rest stay as they are.

    A null or empty text has no letter. A null id, source or language is no reason to drop a row; the language column is
    only learned from. Repeated rows are judged each, and alike. Without any labelled row nothing is learned and all rows go.
    """
    out = langid.predict(docs, langid_model(docs.select("doc_id", "text", "lang")))
    return out.where((F.col("lang_pred") != "und") & (F.col("score") >= MIN_SCORE)).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of similar documents the one with the smallest id stays; of rows with one id and equal text, one.

    Rows without an id can't be named as duplicates of others and stay. Texts without words, null ones included, are
    duplicates of none. An empty table gives no rows.
    """
    classes = jaccard_components(docs).where("doc_id is not null").groupBy(F.col("doc_id").alias("__wg_id"))
    facts = classes.agg(F.min("component_id").alias("__wg_class"), F.count("*").alias("__wg_n"))
    facts = materialize(facts.where("__wg_id <> __wg_class or __wg_n > 1"), "pipeline-duplicates")
    kept = docs.join(maybe_broadcast(facts, 64), F.expr("doc_id = __wg_id"), "left").where("__wg_id is null or __wg_id = __wg_class")
    once = kept.where("__wg_id is null").select(*COLUMNS)
    if not facts.where("__wg_n > 1").limit(1).count():
        return once
    return once.unionByName(kept.where("__wg_n > 1").dropDuplicates(["doc_id", "text"]).select(*COLUMNS))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts the spans that occur in a benchmark item; drops documents of which no word is left. Clean documents stay as they are.

    A null or empty text is clean and stays; so does every document where the benchmark is empty. ``n_chars`` of a cut
    text is counted anew. Repeated rows are cut alike, and null ids are of no account.
    """
    out = find_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    out = out.where(~(F.col("contaminated") & (F.col("n_hit") == F.col("n_words"))))
    length = F.when(F.col("contaminated"), F.char_length("clean_text").cast("long")).otherwise(F.col("n_chars"))
    return out.withColumn("text", F.col("clean_text")).withColumn("n_chars", length).select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its source's target weight has it.

    Null sources are one source, the last. A null text has size 0, and is taken by its source's rate like others; a source without words gives none of
    its rows. Repeated rows are drawn each by itself. An empty table gives no rows.
    """
    return emit_copies(mix_sources(docs), COLUMNS)


def token_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the token shards and returns what they hold: ``doc_id, start, n_tokens, ids_crc32``.

    A null text is empty: its end id alone. Every copy of a document is written; nulls in other columns are of no account.
    """
    return tokens_table(docs, word_tokenizer())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", decontamination),
    ("source_mixing", mixing),
    ("token_shards", token_shards),
]

#: SQL can't express the language model, the tokenizer and the files.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in their order over the whole ``documents``, each one's rows written before the next reads them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
