"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and returns a DataFrame;
all but the last return the columns of ``documents``. ``run`` writes every stage to the shared folder and
reads it again, so a lost executor never costs more than one stage's tasks.

1. toxicity: documents predicted toxic go (the model is fitted to the labelled rows of its input).
2. near_duplicates: of each SimHash group (op2's: shingles of 4 words, 4 of 64 bits) the rows of smallest doc_id stay. That is
   stricter than five words and similarity 0.8: the README has the share of near copies found.
3. substrings: runs of repeated units are cut from the texts; a text that repeats throughout becomes empty.
4. mixing: documents are repeated, cut or left out so that sources meet their target weights, in training order.
5. packing: the mix is tokenized and packed into sequences; a row for each piece.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliograph.llm import mixing, packing, simhash, substrings, toxicity
from foliograph.llm.common import table, written
from foliograph.llm.queries import tokenizer_file
from foliograph.runtime import ship

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _counted(docs: DataFrame, columns: list[str]) -> DataFrame:
    """``n_chars`` as the text now is, columns in their order."""
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*columns)


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return toxicity.keep_clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return simhash.keep_one(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return _counted(substrings.dedup(docs), docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _counted(mixing.mix(docs), docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return packing.pack(docs, tokenizer_file(), with_ids=False)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", without_toxic),
    ("near_duplicates", without_near_duplicates),
    ("substrings", without_repeats),
    ("mixing", mixed),
    ("packing", packed),
]

#: SQL expresses neither the fitted model nor the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
SQL: dict[str, str] = {}
