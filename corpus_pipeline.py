"""A corpus pipeline of five stages over `documents`; each stage is written and read again by the next.

Quality rules drop what they reject, near duplicates leave one document of each group, passages that repeat are cut
out, sources are mixed to flatter weights, and what is left is packed into sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from beatspark.llm import mixing, packing, quality_rules, simhash, substring_dedup
from beatspark.llm.common import materialise, table

#: Bytes of a passage that is cut out where it repeats: about 40 words.
PASSAGE = 240
#: No source is taken more often than this, for one epoch of the least often taken.
REPETITIONS = 1.5
#: Words whose token ids a worker remembers: fewer than by default, as earlier stages have left their mark on the executors' memory.
REMEMBERED = 500_000


def _quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the policy keeps. Null and empty texts have too few words and go; repeated rows are judged one by one."""
    return quality_rules.filter_documents(docs)


def _near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies, the one with the smallest id; a null id comes last. Groups are those of SimHash
    (fingerprints within 2 bits, found by covering masks), as in op1; of what they leave, those of shingle similarity 0.8, of
    which most differ in more bits. Texts without words (null and empty ones are equal) are copies of their like; of
    repeated rows one stays."""
    docs = materialise(simhash.drop_fingerprint_copies(docs), "fingerprint_copies_dropped")
    return simhash.drop_near_duplicates(docs)


def _passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without their repeated passages; rows that these leave without a word go, and so do null and empty texts. No
    copy of a passage stays, the first included."""
    cut = substring_dedup.dedup(docs, length=PASSAGE)
    return cut.where(F.col("text").rlike(r"[^\x20\x09-\x0D]")).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def _mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row once at least, rows of small sources again. Null sources are a source; texts without words, if a source
    has no others, stay once; repeated rows are taken or left together."""
    return mixing.mix(docs, repetitions=REPETITIONS, budget=None).select("doc.*")


def _pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all rows with their places in sequences. Null texts are empty: one end token; long texts become several
    pieces; repeated rows are packed one by one."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), remembered=REMEMBERED)


STAGES = [
    ("quality rules", _quality),
    ("near duplicates", _near_duplicates),
    ("repeated passages", _passages),
    ("source mixing", _mix),
    ("packing", _pack),
]
#: SQL can't express word fingerprints, parsing or tokenizers; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
