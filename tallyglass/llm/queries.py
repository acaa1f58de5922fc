"""The registered queries ``opN_<name>`` of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyglass.llm import (
    ball_tree,
    conversations,
    decontaminate,
    digest_merge,
    html_render,
    kd_shards,
    language_id,
    lyndon_runs,
    poisson_mix,
    quality,
    simhash_dedup,
    url_filter,
    warc_bundles,
)
from tallyglass.llm.common import held_out, prepare
from tallyglass.llm.sql import ORACLE_SQL, SOURCE_WEIGHTS, URL_RULES


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(_table(spark, sf_dir, "pages"), URL_RULES)


def op2_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kd_shards.kd_shards(_table(spark, sf_dir, "documents"), shards=8)


def op3_ball_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return ball_tree.top_k(vectors, vectors.where("vec_id % 100 = 0"), k=10, scale=1024.0)


def op4_html_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_render.render(_table(spark, sf_dir, "pages"))


def op5_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return poisson_mix.mix(_table(spark, sf_dir, "documents"), SOURCE_WEIGHTS)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, _table(spark, sf_dir, "labels")))


def op7_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.near_duplicates(_table(spark, sf_dir, "documents"), shingle_words=4, max_bits=4)


def op8_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_bundles.archive(_table(spark, sf_dir, "pages"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    # What a prediction sees: the text, and the fold to be passed through.
    asked = docs.select("doc_id", held_out("doc_id").alias("held_out"), "text")
    return language_id.identify(asked, language_id.fit(docs), keep=["doc_id", "held_out"])


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def with_periods(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` where a hash of the id turns the words of every tenth text, from some word on, into a period."""
    number = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    cut = docs.select(
        "doc_id",
        "text",
        F.floor(number / 10).alias("g"),
        F.when(number % 10 == 0, F.regexp_extract_all("text", F.lit("[^\\x20\\x09-\\x0D]+"), F.lit(0))).alias("w"),
    )
    placed = cut.select("*", F.expr("CASE WHEN size(w) > 0 THEN g % size(w) END").alias("a"))
    placed = placed.select("*", F.expr("1 + floor((size(w) - a) / (3 + g % 8))").alias("p"))
    words = "transform(sequence(0, size(w) - 1), i -> w[CAST(IF(i < a, i, a + (i - a) % p) AS INT)])"
    text = F.expr(f"CASE WHEN a IS NOT NULL THEN array_join({words}, ' ') ELSE text END")
    return placed.select("doc_id", text.alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lyndon_runs.find_runs(with_periods(_table(spark, sf_dir, "documents")))
    shown = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    best = F.col("longest")
    return found.withColumn("longest", lyndon_runs.longest("runs")).select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        best["start"].alias("start"),
        best["length"].alias("length"),
        best["period"].alias("period"),
        F.expr("1000 * longest.length div longest.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform(shown, lambda t: F.concat(t, F.lit("\n"))), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_merge.classes(_table(spark, sf_dir, "documents"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations")
    repaired = conversations.repair(conversations.damaged(rows))
    key = F.struct("conv_id").alias("key")
    every = rows.select(key).distinct()
    report = repaired.report.select(key, "*").drop("conv_id")
    hashes = conversations.digests(repaired.rows).select(key, "repaired_sha256")
    joined = every.join(report, "key", "left").join(hashes, "key", "left")
    figures = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return joined.select(
        "key.conv_id",
        *[F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in figures],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = (
        op1_url_filter, op2_kd_shards, op3_ball_tree, op4_html_render, op5_poisson_mix, op6_quality, op7_simhash_dedup,
        op8_warc_bundles, op9_language_id, op10_decontaminate, op11_periodic_runs, op12_exact_dedup, op13_conversation_repair,
    )
    return {f.__name__: f for f in named}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE_SQL)
