"""A corpus run, stage by stage: each stage works on the Parquet files that the one before it wrote.

Only the columns of ``documents`` (``COLUMNS``) go from stage to stage; others that the table may have are left behind."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyglass.llm import decontaminate, kd_shards, language_id, poisson_mix, simhash_dedup
from tallyglass.llm.common import prepare, stored
from tallyglass.llm.queries import SOURCE_WEIGHTS

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
# A document stays if its language is known with at least this probability.
LEAST_SCORE = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or of no language with a probability of ``LEAST_SCORE``, go."""
    prepare(spark)
    known = language_id.identify(docs, language_id.fit(docs), keep=list(COLUMNS))
    return known.where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select(*COLUMNS)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group: the one with the smallest id, of several texts under that id the one
    with the smallest hash, of repeated rows the one whose other columns come first.  A row without an id stays only if its group has no id."""
    prepare(spark)
    key = {"_none": F.col("doc_id").isNull(), "_id": F.coalesce("doc_id", F.lit(0)), "_h": F.xxhash64("text")}
    keyed = docs.select(*COLUMNS, *[c.alias(n) for n, c in key.items()])
    rows = keyed.select(F.struct(*key).alias("key"), "text")
    groups = simhash_dedup.near_duplicates(rows, shingle_words=4, max_bits=4, id_column="key")
    marks = stored(groups.groupBy("key", "component_id").agg(F.count("*").alias("n")), "groups")
    kept = keyed.join(marks.where("key <> component_id").select("key.*"), list(key), "left_anti")
    repeated = marks.where("key = component_id AND n > 1").select("key.*")
    if not repeated.isEmpty():
        again = kept.join(repeated, list(key), "left_semi").groupBy(*key).agg(F.min(F.struct(*COLUMNS)).alias("row"))
        kept = kept.join(repeated, list(key), "left_anti").select(*COLUMNS).unionByName(again.select("row.*"))
    return kept.select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go."""
    benchmark = prepare(spark).read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.clean(docs, benchmark).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target weight asks, in a random order."""
    prepare(spark)
    return poisson_mix.mix(docs, SOURCE_WEIGHTS).select(*COLUMNS)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every document."""
    prepare(spark)
    return kd_shards.kd_shards(docs, shards=8)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("simhash_dedup", dedup),
    ("decontaminate", drop_contaminated),
    ("mix_sources", mix_sources),
    ("kd_shards", shard),
]

# Hashes, sampled fits and sliding windows are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, f"pipeline-{name}")
    return docs
