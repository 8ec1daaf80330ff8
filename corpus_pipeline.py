"""A corpus pipeline of five operators: each stage's rows are the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from branchframe.llm.common import discard, keep_rows, materialise, table
from branchframe.llm.exact_dedup import exact_dedup
from branchframe.llm.language_id import drop_unidentified
from branchframe.llm.near_copies import near_copies
from branchframe.llm.packing import pack
from branchframe.llm.queries import vocabulary
from branchframe.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that are predicted toxic; each row by its own whole text.

    Null and empty texts score as a text without windows and stay where clean documents are common. Equal texts all
    stay or all go, whatever their ids; null ids are no matter. All columns pass; an empty table stays empty.
    """
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents in no known language; each row by its own whole text.

    Null and empty texts and those without a letter go. Equal texts all stay or all go. Where no language can be
    learned, all texts with a letter stay. All columns pass; an empty table stays empty.
    """
    return drop_unidentified(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text: of those with the largest id one.

    Null texts count as empty. A null id stays only where no row of the text has an id. All columns pass, whatever
    their names; an empty table stays empty.
    """
    return keep_rows(docs, exact_dedup(docs))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies (five-word shingles, similarity 0.8): of those with the least id one.

    Rows are told apart by id and text, so a row without near copies stays whatever shares its id. Texts without words
    (null, empty, blank) are one group; of equal ids the least digest of a text decides; a null id stays only where no
    row of the group has an id. All columns pass, whatever their names; an empty table stays empty.
    """
    return keep_rows(docs, near_copies(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 tokens.

    Null texts are empty documents of the end token alone; repeated rows and ids are documents of their own; an empty
    table has no pieces.
    """
    return pack(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [("toxicity", toxicity), ("language", language), ("exact_dedup", exact), ("near_dedup", near), ("packing", packing)]

#: SQL can't express the classifiers, the shingles or the packing; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        kept = stage(spark, docs, sf_dir)
        done = materialise(kept, name)
        discard(kept, docs)  # what only earlier stages read
        docs = done
    out = STAGES[-1][1](spark, docs, sf_dir)  # reads its own tables by now
    discard(docs)
    return out
