"""A corpus in five stages: quality rules, toxicity, near duplicates, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the
next one's docs. All stages but the last return the columns of documents.

Every stage takes nulls in any column, blank and very long texts, repeated rows, empty tables and further columns of
any name, which pass through to the packing stage. Null and blank texts have no words and go in the first stage; where
a later one meets them, they are not toxic, have no near copies and nothing to mask. Rows with a null id stay where
ids decide (of equal ids, one row stays). An empty table stays empty. Without labels of both kinds, no document is toxic
on their account.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakewright.llm import ngram_join, packing, pii_votes, quality_rules, toxicity_fm
from lakewright.llm.common import aside, columns_of, staged, table
from lakewright.llm.queries import tokenizer_file


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop failing lines, and the documents that fail the base or lost too much."""
    return quality_rules.clean(docs)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the factorization machine calls toxic; it is fitted on those at hand that have labels."""
    model = toxicity_fm.fit(toxicity_fm.labelled_rows(docs, table(spark, sf_dir, "labels"), "toxic"))
    own, back = aside(docs, "score")
    scored = toxicity_fm.score(own, model).where(F.col("score") < toxicity_fm.THRESHOLD)
    return columns_of(back(scored.drop("score")), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of similar ones: that with the smallest id. Similar: 0.8 or more on 5-word shingles."""
    return ngram_join.keep_one(docs, percent=80, words=5)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mask personal data in the texts."""
    return pii_votes.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences of 2048 tokens."""
    return packing.pack(docs, tokenizer_file("word_bpe_49k.json"), end_id=1)


STAGES = [("quality rules", quality), ("toxicity", toxicity), ("n-gram Jaccard join", near_duplicates), ("PII", personal_data), ("packing", packed)]

#: The stages learn weights, follow links and tokenise, which SQL does not express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-").lower())
    return docs
