"""Training-corpus pipeline: language, near duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of documents.  `run` writes each stage to the shared folder and reads it back for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retainer.llm.crf_langid import UNKNOWN, fit, identify
from retainer.llm.minhash_odd import near_duplicates
from retainer.llm.packing import pack
from retainer.llm.suffix_dedup import remove_repeats
from retainer.llm.workspace import materialize

#: A document goes if it has no letter, or if no language reaches this share of its words.
LEAST_SHARE = 0.4
_LABELS = ("__lang_pred", "__lang_share")


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose words are mostly of one known language."""
    labelled = identify(docs, fit(docs), _LABELS)
    return labelled.filter((F.col(_LABELS[0]) != UNKNOWN) & (F.col(_LABELS[1]) >= LEAST_SHARE)).drop(*_LABELS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest doc_id of each near-duplicate group (five words, 0.8), once if it is repeated."""
    kept = near_duplicates(docs, words=5, percent=80).filter("kept and doc_id is not null").select("doc_id").distinct()
    one = docs.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return one.unionByName(docs.filter("doc_id is null"))


def repeat_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut byte strings of 50 and more that occur in earlier documents; n_chars follows the text."""
    cut = remove_repeats(docs, length=50, with_rows=True)
    columns = [F.col("kept_text").alias(c) if c == "text" else F.length("kept_text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars"
               else F.col(f"row.`{c}`").alias(c) for c in docs.columns]
    return cut.select(*columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences of 2,048 tokens."""
    return pack(docs, size=2048)


STAGES = [("language_id", language_stage), ("minhash_near_dedup", near_duplicate_stage),
          ("suffix_array_dedup", repeat_stage), ("packing", packing_stage)]

#: The stages have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; the rows of the last one."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
