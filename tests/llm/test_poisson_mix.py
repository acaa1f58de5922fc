import math
from collections import Counter

from pyspark.sql import functions as F

from tallyglass.llm import poisson_mix

SCHEMA = "doc_id long, text string, source string, copies string, _mean int"


def test_inversion_is_the_poisson_distribution(spark):
    rows = spark.range(20_000).select(F.col("id").cast("string").alias("i"))
    for mean in (0.0, 0.3, 7.9, 30.0):
        got = Counter(r.k for r in rows.select(poisson_mix.poisson_count(F.lit(mean), F.lit("s"), F.col("i")).alias("k")).collect())
        average = sum(k * n for k, n in got.items()) / 20_000
        spread = sum((k - average) ** 2 * n for k, n in got.items()) / 20_000
        assert abs(average - mean) < 0.05 * math.sqrt(mean + 0.01) * 3 and abs(spread - mean) < 0.06 * mean + 0.01
    one = rows.limit(1).select(*[poisson_mix.poisson_inverse(F.lit(u), F.lit(2.0)).alias(f"u{i}") for i, u in enumerate((0.0, 0.1353, 0.1354, 0.406, 0.407, 0.9999))]).first()
    assert list(one) == [0, 0, 1, 1, 2, 9]


def test_shares_reach_their_targets(spark):
    rows = [(i, "abcdefg" * (1 + i % 3), ("a", "a", "a", "b", "c", None)[i % 6], "", 0) for i in range(12_000)]
    out = poisson_mix.mix(spark.createDataFrame(rows, SCHEMA), {"a": 0.2, "b": 0.5, "absent": 0.1})
    got = out.groupBy("source").agg(F.sum(F.length("text") + 1).alias("n")).collect()
    whole = sum(r.n for r in got)
    share = {r.source: r.n / whole for r in got}
    # "absent" is not there, so 0.9 of the weights are; c and NULL share the 0.2 that nobody was given, by their bytes.
    for name, want in (("a", 0.2 / 0.9), ("b", 0.5 / 0.9), ("c", 0.2 / 0.9 * 15 / 38), (None, 0.2 / 0.9 * 23 / 38)):
        assert abs(share[name] - want) < 0.02
    by_doc = {}
    for r in out.collect():
        by_doc.setdefault(r.doc_id, []).append((r.copy_no, r.copies))
    assert all(sorted(n for n, _ in c) == list(range(1, c[0][1] + 1)) for c in by_doc.values())


def test_order_is_shuffled_and_repeatable(spark):
    docs = spark.createDataFrame([(i, "t", "a", "", 0) for i in range(2000)], SCHEMA)
    first, again = (poisson_mix.mix(docs, {"a": 1.0}).collect() for _ in range(2))
    assert sorted(map(str, first)) == sorted(map(str, again))
    ids = [r.doc_id for r in first]
    rising = sum(a < b for a, b in zip(ids, ids[1:], strict=False)) / len(ids)
    assert 0.4 < rising < 0.6


def test_nulls_empty_and_repeated_rows(spark):
    rows = [(1, None, None, "", 0), (1, None, None, "", 0), (None, "", "a", "", 0), (None, None, "a", "", 0)]
    out = poisson_mix.mix(spark.createDataFrame(rows, SCHEMA), {}, epochs=40.0)
    assert out.columns == ["doc_id", "text", "source", "_mean", "copy_no", "copies", "shuffle_key"]
    assert {r.source for r in out.collect()} == {None, "a"}
    assert poisson_mix.mix(spark.createDataFrame([], SCHEMA), {"a": 1.0}).count() == 0
    assert poisson_mix.mix(spark.createDataFrame(rows, SCHEMA), {"absent": 1.0}).count() == 0
