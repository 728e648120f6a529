"""From raw documents to token ids: five stages, each written as Parquet before the next one reads it.

Stage functions take (spark, docs, sf_dir) and return a DataFrame; all but the last return the
columns of documents. Each works on all its predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trawlframe.llm import chosen_path, line_runs, pair_index_bpe, pu_toxicity, temperature_mix
from trawlframe.llm.common import stored, table
from trawlframe.plans.registry import query

#: No stage order of this pipeline can be said in SQL: the first stage trains a classifier.
ORACLE_SQL = None

#: A document is rejected where operator 1 calls it toxic.
REJECT = pu_toxicity.THRESHOLD
#: Rarer sources are passed up to one and a half times; the covering budget leaves no document out.
MIX = temperature_mix.Settings(entropy=None, repeats=1.5, budget=None)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not call toxic. Rows with the same doc_id are scored one by one."""
    model = pu_toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return pu_toxicity.keep(docs, model, REJECT)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that stand in three or more of them, but for the largest doc_id; n_chars follows the new text."""
    out = line_runs.without_repeated_lines(docs, counts=False)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates on five-word shingles: the one with the smallest doc_id."""
    return chosen_path.one_of_each(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of the mixture: each document once, those of rarer sources again up to the repetition limit."""
    return temperature_mix.mixture(docs, MIX)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (little-endian unsigned 32-bit integers) of every row, with the digest of what they decode to."""
    bpe = pair_index_bpe.load(pair_index_bpe.tokenizer_path("word_bpe_49k.json"))
    both = pair_index_bpe.round_trip(docs, bpe)
    return both.select("doc_id", "n_tokens", "ids", F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mixing", mixing), ("encoding", encoding)]


@query("pipeline", ORACLE_SQL)
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of all stages, applied to documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = stored(docs, f"pipeline-{name}")
    return docs
