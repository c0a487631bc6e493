"""From raw documents to packed training sequences: toxicity, exact and near duplicates, pseudonyms, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the columns of documents. SQL cannot express
the learnt score, the components of near copies or the keyed permutation, so ORACLE_SQL is None and tests compare the stages with brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from platewise.llm import chunk_recipes, near_jaccard, packing, pseudonyms, toxic_grammar
from platewise.llm.common import col, staged, table

ORACLE_SQL = None
#: Key of the pseudonyms; a real run passes its own secret.
KEY = "demonstration key"


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the grammar scores below one half; it learns from the labelled ones outside the held-out fold. Null and empty texts have the score of a text without matches,
    equal texts equal scores; extra columns are kept; an empty table stays empty."""
    return toxic_grammar.accepted(docs, toxic_grammar.fit(docs, table(spark, sf_dir, "labels")))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the smallest id."""
    return chunk_recipes.deduplicated(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of texts whose five-word shingles have Jaccard similarity 0.8 or more the document with the smallest id. SimHash fingerprints linked through Golay codewords propose
    the closest ones, bands of least values the others, and whole sets decide.
    Null counts as empty; texts without words are alike; of equal ids the row numbered first stays, null ids come last; extra columns are kept; an empty table stays empty."""
    return near_jaccard.one_of_each(docs)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal values replaced by pseudonyms; n_chars follows the new text."""
    done = pseudonyms.pseudonymise(docs, KEY)
    out = done.select(*[col(c) for c in docs.columns])
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences, with the ids they hold."""
    return packing.pack(docs)


STAGES = [("toxicity", toxicity), ("exact dedup", exact_dedup), ("near dedup", near_dedup), ("pii", pii), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder, each written to the shared folder before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
