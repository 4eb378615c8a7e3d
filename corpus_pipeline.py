"""A training corpus from documents: five stages, each a table that the next one reads.

Counted as part of the subpackage duosig.llm.
"""

from __future__ import annotations

import functools
import gc
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duosig.llm import decontaminate, exact_dedup, language_id, mixing, ngram_join, queries, shared

#: Languages that the corpus is to have; None for all that are learned.
LANGUAGES: list[str] | None = None

#: What the last stage over each input wrote.
_last: dict[str, shared.Scope] = {}


def _stage(function: Callable) -> Callable:
    """A stage whose predecessor's tables go once it begins, as its own input has been stored by then; other tables, and those of pipelines over other inputs, stay.

    From the first stage on the session drops a query's shuffle files at its end, as stages shuffle whole documents. What the
    predecessor's many queries left in the driver (plans, generated classes, broadcasts) is collected once.
    """

    @functools.wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set(shared.CLEANUP, "true")
        if sf_dir in _last:
            _last.pop(sf_dir).release()
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        with shared.scope(spark) as own:
            _last[sf_dir] = own
            return function(spark, docs, sf_dir)

    return run_stage


@_stage
def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the wanted languages, predicted from text alone by what the labelled ones teach.

    Null texts and texts without a letter go, as do texts that no learned language codes better than byte frequencies do. A low
    score is no reason: short texts of several possible languages are clean. Rows that repeat or share an id are judged each by
    itself; no rows give no rows.
    """
    kept = language_id.identify_language(docs).where("lang_known")
    if LANGUAGES is not None:
        kept = kept.where(F.col("lang_pred").isin(LANGUAGES))
    return kept.select(*docs.columns)


@_stage
def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one row, that with the smallest doc_id; of rows that repeat it too, one.

    Null and empty texts are equal, and a null doc_id counts as the largest.
    """
    key = lambda sha: F.concat_ws(":", sha, F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    kept = exact_dedup.exact_duplicates(docs).where("kept").select(key(F.col("text_sha256")).alias("_kept"))
    sha = F.sha2(exact_dedup.normalised(F.col("text")).cast("binary"), 256)
    rows = docs.withColumn("_key", key(sha)).join(kept, F.col("_key") == F.col("_kept"), "left_semi")
    return rows.dropDuplicates(["_key"]).select(*docs.columns)  # rows that repeat both id and text lie together already


@_stage
def join_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of linked documents the one with the smallest doc_id; rows are told apart by a key of their own, as ids may repeat or be null.

    Null and empty texts have no shingles and stay; texts of any length are compared whole.
    """
    # The key is written down first: made anew in each job it need not be the same.
    rows = shared.materialise(docs.withColumn("_row", F.monotonically_increasing_id()))
    found = ngram_join.ngram_join(rows, k=5, percent=80, id_col="_row").select(F.col("doc_id").alias("_of"), "component_id")
    named = found.join(rows.select("_row", "doc_id"), F.col("_of") == F.col("_row"))
    first = named.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_row")).alias("_first"))
    return rows.join(first.select(F.col("_first._row").alias("_kept")), F.col("_row") == F.col("_kept"), "left_semi").select(*docs.columns)


@_stage
def remove_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item; rows are told apart by a key of their own, so that rows that share an id
    are judged apart. Null and empty texts hold nothing and stay; texts of any length are judged whole.
    """
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    rows = shared.materialise(docs.withColumn("_row", F.monotonically_increasing_id()))
    found = decontaminate.decontaminate(rows, items, id_col="_row").where("contaminated").select(F.col("doc_id").alias("_hit"))
    return rows.join(found, F.col("_row") == F.col("_hit"), "left_anti").select(*docs.columns)


@_stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their places in the mixture of sources by target weights; a null source is one of its own, and null and empty texts are rows as any."""
    return mixing.mix(docs, weights=queries.SOURCE_WEIGHTS)


STAGES = [
    ("language ID", identify),
    ("exact dedup", deduplicate),
    ("n-gram Jaccard join", join_near_copies),
    ("benchmark decontamination", remove_benchmarks),
    ("mixing sources to target weights", mix_sources),
]

#: Neither the learned trees nor the schedule can be stated in SQL; tests hold the stages and run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each result is written as Parquet into the shared folder and read again.

    A stage's result goes when its successor's is stored; the last one's goes when the session ends.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = spark.conf.get(shared.CLEANUP, "false")
    done = shared.Scope(spark)
    try:
        for _, stage in STAGES:
            path = shared.new_path(spark)
            stage(spark, docs, sf_dir).write.parquet(path)
            done.release()
            done.paths.append(path)
            docs = spark.read.parquet(path)
        if sf_dir in _last:
            _last.pop(sf_dir).release()
    finally:
        spark.conf.set(shared.CLEANUP, before)
    return docs
