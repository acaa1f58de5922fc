"""URL filter: rules first, then a character language-model ratio, with DataFrame functions only.

URLs that a rule decides are the training set: two Markov models of characters, one of allowed and one of
blocked URLs, with contexts of three characters down to none.  Orders are blended by Witten-Bell smoothing;
a context that a model has not seen leaves the word to the next shorter one.  A URL's score is the mean
over its characters of the difference of the log-likelihoods.  The threshold is calibrated on a quarter of
the decided URLs that no model was trained on: the one with the least balanced error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyglass.llm.common import stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ORDER = 3
# Symbols of the models: letters, a digit, these marks, any other character, start and end.
MARKS = "./?=&#_%:-"
SYMBOLS = 26 + 1 + len(MARKS) + 3
# Log-likelihoods are whole millionths, so that sums do not depend on their order.
UNIT = 1_000_000
# Scores are calibrated in steps of 0.05 from -10 to 10.
STEP, STEPS = 50_000, 200
# First digits of the hash of a quarter of the URLs.
CALIBRATION = "048c"


def url_parts(url: Column) -> tuple[Column, Column, Column]:
    """Host, path, and all that follows the first ``://``; empty for NULL and without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), rest


def rule_for(host: Column, path: Column, rules: dict[str, str]) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, or NULLs.  A rule is a host and a path from the first slash
    on; it fits the host and its subdomains if the path starts with the rule's.  Rules are few."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text in sorted(rules, key=lambda r: (len(r), r)):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(rules[text])).otherwise(verdict)
    return rule, verdict


def _symbols(rest: Column) -> Column:
    digits = F.regexp_replace(F.translate(rest, UPPER, LOWER), "[0-9]", "0")
    known = F.regexp_replace(digits, "[^a-z0./?=&#_%:-]", "~")
    return F.concat(F.lit("^" * ORDER), known, F.lit("$"))


def _grams(rest: Column) -> Column:
    """Every character with its context; one look-ahead per position keeps this linear in the length."""
    return F.regexp_extract_all(_symbols(rest), F.lit("(?=(.{%d}))" % (ORDER + 1)), F.lit(1))


def _model(grams: DataFrame) -> DataFrame:
    """``gram, llr``: for each gram the difference of its log-likelihoods.  Takes ``gram, allow, block`` with the
    counts in the training set (0 for a gram that is only to be scored)."""
    out = grams.select("gram", F.lit(1.0 / SYMBOLS).alias("pa"), F.lit(1.0 / SYMBOLS).alias("pb"))
    for k in range(ORDER + 1):
        tail, context = f"right(gram, {k + 1})", f"left(right(gram, {k + 1}), {k})"
        seen = grams.groupBy(F.expr(tail).alias("t")).agg(F.sum("allow").alias("ca"), F.sum("block").alias("cb"))
        above = seen.groupBy(F.expr(f"left(t, {k})").alias("x")).agg(
            F.sum("ca").alias("na"), F.sum("cb").alias("nb"),
            F.sum((F.col("ca") > 0).cast("long")).alias("ta"), F.sum((F.col("cb") > 0).cast("long")).alias("tb"),
        )
        joined = out.withColumn("t", F.expr(tail)).withColumn("x", F.expr(context)).join(seen, "t").join(above, "x")
        blend = lambda m: F.when(F.col(f"n{m}") > 0, (F.col(f"c{m}") + F.col(f"t{m}") * F.col(f"p{m}")) / (F.col(f"n{m}") + F.col(f"t{m}"))).otherwise(F.col(f"p{m}"))
        out = joined.select("gram", blend("a").alias("pa"), blend("b").alias("pb"))
    return out.select("gram", F.round(UNIT * (F.log("pa") - F.log("pb"))).cast("long").alias("llr"))


def _step(score: Column) -> Column:
    return F.greatest(F.lit(-STEPS), F.least(F.lit(STEPS), F.floor(score / STEP))).cast("int")


def _threshold(scored: DataFrame) -> int:
    """The step with the least balanced error on the calibration rows; the one nearest 0 of equals (the lower
    of two), 0 if a verdict has no rows.  At most ``2 * STEPS + 1`` rows are collected."""
    rows = scored.groupBy(_step(F.col("score")).alias("s")).agg(F.sum((F.col("verdict") == "allow").cast("long")).alias("a"), F.sum((F.col("verdict") == "block").cast("long")).alias("b")).collect()
    allow, block = sum(r.a for r in rows), sum(r.b for r in rows)
    if not allow or not block:
        return 0
    # Exact: errors as whole numbers over allow * block.
    error = {t: sum(r.a for r in rows if r.s < t) * block + sum(r.b for r in rows if r.s >= t) * allow for t in range(-STEPS, STEPS + 1)}
    return min(error, key=lambda t: (error[t], abs(t), t))


def judge_urls(pages: DataFrame, rules: dict[str, str], id_column: str = "page_id", url_column: str = "url") -> DataFrame:
    """``page_id, host, path, rule, verdict, score`` for every row.

    ``rules`` maps ``host/path`` to ``allow`` or ``block``.  A row that no rule fits gets the models' verdict;
    ``score`` is its mean log-likelihood ratio in millionths (NULL for rows that a rule decides).  NULL
    URLs and those without ``://`` have empty host and path and are scored as an empty text.  Without
    training rows both models are uniform and everything passes; so does a score equal to the threshold.
    Repeated rows come back as often as they came, other columns are ignored, and an empty table gives an
    empty result."""
    host, path, rest = url_parts(F.col(url_column))
    parsed = pages.select(F.col(id_column).alias("id"), host.alias("host"), path.alias("path"), rest.alias("rest"))
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    parsed = parsed.select("id", "host", "path", "rest", rule.alias("rule"), verdict.alias("verdict"))
    calibration = F.substring(F.md5(F.col("rest").cast("binary")), 1, 1).isin(*CALIBRATION)
    exploded = parsed.select("verdict", calibration.alias("c"), F.explode(_grams(F.col("rest"))).alias("gram"))
    count = lambda v: F.sum(((F.col("verdict") == v) & ~F.col("c")).cast("long"))
    grams = exploded.groupBy("gram").agg(F.coalesce(count("allow"), F.lit(0)).alias("allow"), F.coalesce(count("block"), F.lit(0)).alias("block"))
    model = stored(_model(stored(grams, "grams")), "model")

    # A row is known by its place in the scan, as ids and URLs may repeat.
    rows = parsed.select(F.monotonically_increasing_id().alias("at"), "*")
    open_rows = rows.withColumn("c", calibration).where("verdict IS NULL OR c")
    mean = F.floor(F.sum("llr") / F.count("*")).cast("long")
    scored = open_rows.select("at", "id", "host", "path", "verdict", F.explode(_grams(F.col("rest"))).alias("gram")).join(model, "gram")
    scored = stored(scored.groupBy("at", "id", "host", "path", "verdict").agg(mean.alias("score")), "scored")
    threshold = _threshold(scored.where("verdict IS NOT NULL"))
    judged = scored.where("verdict IS NULL").select(
        F.col("id").alias(id_column), "host", "path", F.lit(None).cast("string").alias("rule"),
        F.when(_step(F.col("score")) >= threshold, F.lit("allow")).otherwise(F.lit("block")).alias("verdict"), "score",
    )
    decided = parsed.where("verdict IS NOT NULL").select(F.col("id").alias(id_column), "host", "path", "rule", "verdict", F.lit(None).cast("long").alias("score"))
    return decided.unionByName(judged)
