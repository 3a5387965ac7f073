"""The corpus pipeline: five stages over ``documents``, each calling one operator.

quality rules -> near-dedup -> substring dedup -> source mix -> SentencePiece

Every stage takes what its predecessor left, as a written table. The first four
return the columns of ``documents``; the last returns the digests of the tokens.
Where a stage changes a text, ``n_chars`` follows it.

Defined results: null and empty texts have no words and go in the first stage; a null id
is kept as it is and comes after all others in ties; repeated rows are copies and one stays; very
long texts are taken whole; an empty table gives an empty result; further columns, whatever
their names, are carried to the last stage, which returns digests only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandspark.llm.mixing import mixed
from strandspark.llm.near_copies import without_near_copies
from strandspark.llm.pieces import piece_digests
from strandspark.llm.q_mixing import BUDGET, EPOCHS, SEED, WEIGHTS
from strandspark.llm.q_pieces import vocabulary
from strandspark.llm.quality import keep_clean
from strandspark.llm.substrings import without_repeats
from strandspark.runtime import ship, table, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, without the lines that fail them."""
    ship(spark)
    return keep_clean(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies (five-word similarity of 0.8 or more) the row
    with the smallest id."""
    ship(spark)
    return without_near_copies(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the words of passages that repeat."""
    ship(spark)
    return without_repeats(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as many times as the mix takes them."""
    ship(spark)
    return mixed(docs, WEIGHTS, BUDGET, EPOCHS, SEED)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number and digest of each document's ids, and digest of the text decoded from them."""
    ship(spark)
    return piece_digests(docs, vocabulary())


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("source_mix", source_mix), ("tokens", tokens)]

#: XXH64 and the tokenizer are beyond SQL; tests/llm/test_pipeline.py compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
