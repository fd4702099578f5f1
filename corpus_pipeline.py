"""A corpus pipeline over ``documents``: each stage reads what the one before kept, as Parquet.

Stages that send texts through Python return a written step, so that only small batches go there whoever reads the result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import apart, discard, materialise, table
from quarry.llm.decontamination import decontaminate
from quarry.llm.mixing import mix_documents, plan_mix
from quarry.llm.near_copies import deduplicate
from quarry.llm.quality import learn, score
from quarry.llm.sharding import shuffle_into_shards


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts to be good.

    Null and empty texts are judged as texts without words; repeated rows all stay or all go; an empty table gives no
    rows. Without labels the score is 0.5 and everything stays. Columns are the input's, whatever they are called.
    """
    model = learn(docs, table(spark, sf_dir, "labels"))
    own = apart(docs)
    named = docs.withColumnsRenamed({c: own + c for c in ("score", "predicted") if c in docs.columns})
    good = score(named, model).where("predicted = 1").select(*[F.col(own + c if c in ("score", "predicted") else c).alias(c) for c in docs.columns])
    return materialise(good, "good")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: SimHash balls on five-word shingles first, an exact search over rare shingles beyond them, both verified at a Jaccard similarity of 0.8.

    Null, empty and blank texts are one group. The smallest id stays, of equal rows one; null ids stay only where a
    group has no others. An empty table gives no rows.
    """
    return deduplicate(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item occurs.

    Null and empty texts hold none and stay, as do repeated rows without one; null and empty items occur nowhere; an
    empty table gives no rows.
    """
    return materialise(decontaminate(docs, table(spark, sf_dir, "benchmark")), "clean")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as the mix takes them, once per pass over their source, with the words taken there as their text.

    Rows without words are never taken. Null sources are a source of their own. ``n_chars`` is counted anew. An empty
    table gives no rows.
    """
    mixed = mix_documents(docs, plan_mix(docs))
    return mixed.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with their shard, bucket and slot in the shard; columns of those names are replaced.

    Null ids and texts take part, repeated rows get slots of their own; an empty table gives no rows.
    """
    return shuffle_into_shards(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixing", mixing), ("sharding", sharding)]

#: No SQL expresses the trained network, the fingerprints or the permutations; tests hold the pipeline against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents`` one after another, each but the last written and read again.

    Odd input is handled as the stages say: null and empty texts are one group of near copies, of which one document
    stays until the mix, which takes no text without words; an empty table gives no rows.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        kept = stage(spark, docs, sf_dir)
        docs = kept if hasattr(kept, "quarry_path") else materialise(kept, name)
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
