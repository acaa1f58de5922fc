"""Mixing sources to target weights by Poisson replication, with DataFrame functions only.

A source with target weight ``w`` should fill ``w`` of the output's bytes, so each of its documents is repeated
``w * output / bytes of the source`` times on average.  The number of copies is drawn from the Poisson
distribution of that mean by inverting its distribution function at a uniform number, a hash of seed
and document.  Large means are sums of several draws.  Copies are dealt and sorted by a hash of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyglass.llm.common import stored, utf8

# A draw has a mean of at most this; its inversion takes this many terms, beyond which less than 1e-16 is left.
DRAW_MEAN = 8.0
TERMS = 48
# 52 bits of a hash are a uniform number.
HEX_DIGITS, SPAN = 13, float(1 << 52)


def _uniform(*parts: Column) -> Column:
    digest = F.substring(F.md5(F.concat_ws("|", *parts)), 1, HEX_DIGITS)
    return (F.conv(digest, 16, 10).cast("double") + 0.5) / SPAN


def poisson_inverse(u: Column, mean: Column) -> Column:
    """The smallest count whose distribution function reaches ``u``."""
    start = F.struct(F.exp(-mean).alias("p"), F.exp(-mean).alias("cdf"), F.lit(0).alias("k"))

    def step(so_far: Column, i: Column) -> Column:
        p = so_far["p"] * mean / i
        return F.struct(p.alias("p"), (so_far["cdf"] + p).alias("cdf"), F.when(u > so_far["cdf"], i).otherwise(so_far["k"]).alias("k"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), start, step, lambda s: s["k"])


def poisson_count(mean: Column, *key: Column) -> Column:
    """A Poisson number that depends on ``key`` alone: the sum of ``ceil(mean / DRAW_MEAN)`` draws."""
    draws = F.greatest(F.ceil(mean / DRAW_MEAN).cast("int"), F.lit(1))
    one = lambda i: poisson_inverse(_uniform(*key, i.cast("string")), mean / draws)
    return F.aggregate(F.sequence(F.lit(1), draws), F.lit(0), lambda total, i: total + one(i))


def mean_rates(docs: DataFrame, weights: dict[str, float], epochs: float = 1.0, source_column: str = "source", text_column: str = "text") -> DataFrame:
    """``source, bytes, target, mean``: one row per source.  Sources without a weight share what the
    listed ones leave, in proportion to their bytes (nothing, if the weights sum to 1 or more); the
    weights of the sources that are there are scaled to sum to 1.  NULL is a source of its own."""
    sizes = docs.select(F.col(source_column).alias("source"), (F.length(utf8(text_column)).cast("long") + 1).alias("b"))
    sizes = sizes.groupBy("source").agg(F.sum("b").alias("bytes"))
    given = F.lit(None).cast("double")
    for name, weight in weights.items():
        given = F.when(F.col("source") == name, F.lit(float(weight))).otherwise(given)
    rest = max(0.0, 1.0 - sum(weights.values()))
    known = sizes.withColumn("given", given)
    facts = known.agg(F.sum("bytes").alias("all"), F.sum(F.when(F.col("given").isNull(), F.col("bytes"))).alias("free"), F.sum("given").alias("given")).first()
    whole = (facts["given"] or 0.0) + (rest if facts["free"] else 0.0)
    raw = F.coalesce(F.col("given"), F.lit(rest) * F.col("bytes") / F.lit(float(facts["free"] or 1)))
    target = raw / F.lit(whole) if whole > 0 else F.lit(0.0)
    return known.select("source", "bytes", target.alias("target"), (target * F.lit((facts["all"] or 0) * epochs) / F.col("bytes")).alias("mean"))


def mix(
    docs: DataFrame, weights: dict[str, float], epochs: float = 1.0, seed: str = "mix",
    id_column: str = "doc_id", text_column: str = "text", source_column: str = "source",
) -> DataFrame:
    """The columns of ``docs`` with ``copy_no`` (from 1), ``copies`` and ``shuffle_key``, each row as often as drawn,
    in the order of the shuffle key within evenly dealt partitions.

    A row's draw depends on seed, id and the text's MD5, so repeated rows are repeated
    alike.  NULL and empty texts count one byte.  An empty table gives an empty result.  Columns of
    these names that ``docs`` has already are replaced."""
    columns = [c for c in docs.columns if c not in ("copy_no", "copies", "shuffle_key")]
    key = F.concat_ws("|", F.lit(seed), F.coalesce(F.col(id_column).cast("string"), F.lit("")), F.md5(utf8(text_column)))
    rows = docs.select(F.struct(*columns).alias("row"), F.col(source_column).alias("from"), key.alias("key"))
    # Written first: Spark then knows how small it is, and the texts need not move to be joined.
    rates = stored(mean_rates(docs, weights, epochs, source_column, text_column).select("source", "mean"), "rates")
    drawn = rows.join(rates, F.col("from").eqNullSafe(F.col("source")))
    drawn = drawn.select("row", "key", poisson_count(F.col("mean"), F.col("key")).alias("copies")).where("copies > 0")
    copies = drawn.select("row", "key", "copies", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy_no"))
    order = F.md5(F.concat_ws("|", "key", F.col("copy_no").cast("string")))
    out = copies.select("row.*", "copy_no", "copies", order.alias("shuffle_key"))
    return out.repartition("shuffle_key").sortWithinPartitions("shuffle_key")
