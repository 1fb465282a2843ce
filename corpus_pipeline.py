"""From raw documents to token shards: five stages, each over all that the one before it kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of ``docs``. Between stages the rows are written as Parquet and read again.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import decontaminate, language_id, mixing, partenum, token_store
from strandline.llm.common import materialize, table

#: Nine tenths of the tokens that are left, no document twice; within a domain by language.
MIX = mixing.MixConfig(domain_weights={"d0": 4, "d1": 3, "d2": 2, "d3": 1}, lang_weights={"en": 1, "de": 2, "fr": 2, "es": 3}, budget_num=9, budget_den=10, max_epochs=1)

#: The workers hold what earlier stages left as well, so they keep fewer encoded words than elsewhere.
STORE = token_store.TokenStoreConfig(cached_words=200_000)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: documents without a clear language go.

    Null texts, texts without letters and texts whose two best languages fit about equally go; an
    empty table stays empty, and repeated rows are judged alike.
    """
    learned = language_id.train(docs.where(~language_id.held_out(F.col("doc_id"))))
    return language_id.clear_documents(docs, learned)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join over five-word shingles from similarity 0.8: one document of each group, the smallest id, stays.

    Documents without words are in no group and stay; of rows with one id one stays.
    """
    return partenum.keep_one(docs, partenum.JoinConfig(words=5, num=80, den=100))


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Decontamination: documents with a twentieth of their words in benchmark windows go.

    Documents without words stay; an empty benchmark lets all stay.
    """
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing to target weights: the rows that the budgets reach stay, once each; rows without an id count one by one."""
    return mixing.chosen_documents(docs, MIX)


def token_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token output: ids in shard files, read back: doc_id, start, n_tokens, ids_crc32."""
    return token_store.read(token_store.write(docs, public_tokenizers.path("byte_bpe_50k.json"), STORE))


STAGES = [
    ("language_id", language),
    ("ngram_jaccard", near_duplicates),
    ("decontaminate", benchmark_free),
    ("mix_sources", mixed),
    ("token_store", token_shards),
]

#: Compression, PartEnum components and tokenizers are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from the table ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
