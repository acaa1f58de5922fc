"""Shards of near-equal bytes by k-d tree partitioning.

Every document is a point: the logarithm of its size, its language and its source (names by a hash),
each scaled to [0, 1).  The tree splits the node's widest dimension at the weighted median, weights being
bytes, until each leaf is one shard.  Equal coordinates are ordered by the hash of the text, so the
median is exact however many points coincide, and copies of a text stay together: they share one point
with the smallest language and source among them.  Only a text whose copies hold over a twentieth of a
shard's bytes is dealt into pieces, so that no shard takes it whole.

Rows of one id and text are told apart by nothing in the result, so they travel as one row with their number
``n``, which is split where they are dealt, and become rows again when they get their slots.

The medians come from sums over prefixes of the order key, refined sixteen bits at a time.  Nodes and cuts are small
tables that the points are joined with; none of them reaches the driver or the plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyglass.llm.common import stored, utf8

LAW = "bytes"
# A text with more than this share of a shard's bytes is dealt into this many pieces.
HEAVY_BYTES, PIECES = 20, 1024
# Rows of a text with more than this share of all rows find their shard by this many copies of its point.
HOT_ROWS, SALTS = 64, 64
# Order keys below 2**63: coordinate, then tie-break.
COORDINATE_BITS, TIE_BITS = 20, 43
STEP_BITS = 16
# Levels of a tree, as node numbers are longs; and stretches in which its leaves are numbered.
MAX_DEPTH, STRETCH_BITS = 60, 10
# Rows of a shard that one task numbers, and repeated rows that stay together when they are numbered.
SLOT_ROWS = 1 << 20
RUN_ROWS = 1 << 10


def _coordinate(name: str) -> Column:
    """A name as a number below 2**20; NULL is a name of its own."""
    return F.shiftrightunsigned(F.xxhash64(F.coalesce(F.col(name).cast("string"), F.lit("\u0000"))), 64 - COORDINATE_BITS)


def _narrow(docs: DataFrame, id_column: str, text_column: str, names: list[str]) -> DataFrame:
    data = utf8(text_column)
    columns = [
        F.col(id_column).alias("id"),
        (F.length(data).cast("long") + 1).alias("size"),
        F.crc32(data).alias("crc"),
        F.xxhash64(data).alias("h"),
        *[_coordinate(n).alias(f"x{i}") for i, n in enumerate(names, 1)],
    ]
    rows = docs.select(*columns)
    return rows.groupBy("id", "size", "crc", "h").agg(F.count("*").alias("n"), *[F.min(f"x{i}").alias(f"x{i}") for i in range(1, len(names) + 1)])


def _dealt(n: str, parts: Column) -> tuple[Column, Column]:
    """The numbers from 0 of the non-empty ones of ``parts`` equal parts of ``n``, exploded; and the rows in part ``j``."""
    share = F.floor(F.col(n) / parts) + (F.col("j") < F.col(n) % parts).cast("long")
    return F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.col(n), parts) - 1)), share


def _points(rows: DataFrame, shards: int, dimensions: int) -> tuple[DataFrame, DataFrame]:
    """Rows with their point ``(h, piece)`` and a ``salt``, and the points with weight, coordinates, tie-break and
    the ``salts`` under which their rows look for them."""
    weight = F.sum(F.col("size") * F.col("n"))
    total = rows.agg(weight, F.sum("n")).first()
    texts = rows.groupBy("h").agg(weight.alias("w"), F.sum("n").alias("c"))
    split, hot = F.col("w") * HEAVY_BYTES * shards > (total[0] or 0), F.col("c") * HOT_ROWS > (total[1] or 0)
    # At most HEAVY_BYTES * shards + HOT_ROWS rows; Spark sends them if their file is small, else joins by hash.
    marks = stored(texts.select("h", split.alias("split"), F.when(hot, SALTS).otherwise(1).alias("salts")).where("split OR salts > 1"), "heavy")
    rows = rows.join(marks, "h", "left").withColumn("salts", F.coalesce("salts", F.lit(1)))
    # Rows of one id and text go to pieces in turn, from one that their hash names.
    numbers, share = _dealt("n", F.when(F.col("split"), F.lit(PIECES).cast("long")).otherwise(F.lit(1).cast("long")))
    named = F.xxhash64("id", "h")
    piece = F.when(F.col("split"), F.pmod(F.pmod(named, F.lit(PIECES)) + F.col("j"), F.lit(PIECES)).cast("int")).otherwise(F.lit(0))
    rows = rows.withColumn("j", numbers).withColumn("n", share).withColumn("piece", piece).drop("split", "j")
    rows = rows.withColumn("salt", F.pmod(F.shiftright(named, 16), F.col("salts")).cast("int"))
    largest = F.log2(F.max("size").cast("double"))
    x0 = F.least(F.floor(largest / 40 * (1 << COORDINATE_BITS)), F.lit((1 << COORDINATE_BITS) - 1))
    points = rows.groupBy("h", "piece").agg(
        weight.alias("w"), x0.cast("long").alias("x0"), *[F.min(f"x{i}").alias(f"x{i}") for i in range(1, dimensions)], F.max("salts").alias("salts")
    )
    tie = F.shiftrightunsigned(F.xxhash64("h", "piece"), 64 - TIE_BITS)
    return rows.drop("salts"), points.withColumn("tie", tie)


def _key(dimensions: int) -> Column:
    """The place of a point along dimension ``dim`` (from 1) of its node."""
    x = F.array(*[F.col(f"x{i}").cast("long") for i in range(dimensions)])
    return F.shiftleft(F.element_at(x, F.col("dim")), TIE_BITS).bitwiseOR(F.col("tie"))


def _medians(points: DataFrame, splits: DataFrame, dimensions: int) -> DataFrame:
    """``node, cut, below, at`` for ``splits`` (``node, dim, goal``): the order key at which the weight below it passes the
    goal, the weight below, and the weight of that key itself."""
    # The known upper bits of the cut, and the weight below them.
    known = splits.select("node", "dim", "goal", F.lit(0).cast("long").alias("cut"), F.lit(0).cast("long").alias("below"))
    left = COORDINATE_BITS + TIE_BITS
    while left > 0:
        step = min(STEP_BITS, left)
        left -= step
        keyed = points.join(known, "node").withColumn("k", _key(dimensions)).where(F.shiftright("k", left + step) == F.col("cut"))
        bins = keyed.groupBy("node", "dim", "goal", "below", F.shiftright("k", left).alias("cut")).agg(F.sum("w").alias("at"))
        # A node has at most 2 ** STEP_BITS bins.
        sums = bins.withColumn("below", F.col("below") + F.sum("at").over(Window.partitionBy("node").orderBy("cut")) - F.col("at"))
        best = sums.where("below <= goal").groupBy("node", "dim", "goal").agg(F.max(F.struct("cut", "below", "at")).alias("m"))
        known = stored(best.select("node", "dim", "goal", "m.*"), "medians")
    return known


def _tree(points: DataFrame, shards: int, dimensions: int, most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Points with their leaf ``node``, and ``node, shard`` of the leaves.  The children of ``n`` are ``2n`` and ``2n + 1``.

    A node is split in proportion to the leaves it is to have: half of its parent's, or, with ``most`` bytes a leaf, as many
    as its bytes need.  Nodes and cuts are tables, so the plan of a level does not depend on their number."""
    spark = points.sparkSession
    # Written, and made of a number: with a constant on one side Spark would join without keys.
    points = stored(points.withColumn("node", F.lit(1).cast("long")), "points")
    nodes = spark.range(1, 2).select(F.col("id").alias("node"), F.lit(shards).cast("long").alias("leaves"), F.lit(0).cast("long").alias("first"))
    x = F.array(*[(F.max(f"x{i}") - F.min(f"x{i}")).cast("long") for i in range(dimensions)])
    for _ in range(MAX_DEPTH):
        facts = points.groupBy("node").agg(F.sum("w").alias("w"), x.alias("x"), (F.max("tie") > F.min("tie")).alias("ties")).join(nodes, "node")
        if most is not None:
            one_key = (F.array_max("x") == 0) & ~F.col("ties")
            facts = facts.withColumn("leaves", F.when(one_key, F.lit(1).cast("long")).otherwise(F.ceil(F.col("w") / F.lit(most))))
        # The first of the widest dimensions.
        dim = F.array_position("x", F.array_max("x")).cast("int")
        goal = F.col("w") * F.floor(F.col("leaves") / 2) / F.col("leaves")
        facts = stored(facts.select("node", "leaves", "first", "w", dim.alias("dim"), goal.alias("goal")), "nodes")
        splits = facts.where("leaves > 1")
        if splits.isEmpty():
            break
        cuts = _medians(points, splits, dimensions).select("node", "cut", "below", "at")
        if most is not None:
            cuts = _evened(cuts.join(facts.select("node", "w"), "node"))
        cuts = stored(splits.join(cuts.select("node", "cut"), "node").select("node", "dim", "cut"), "cuts")
        down = F.when(F.col("cut").isNotNull(), 2 * F.col("node") + (_key(dimensions) >= F.col("cut")).cast("long")).otherwise(F.col("node"))
        points = stored(points.join(cuts, "node", "left").withColumn("node", down).drop("dim", "cut"), "points")
        half = F.floor(F.col("leaves") / 2)
        nodes = facts.where("leaves = 1").select("node", "leaves", "first").union(
            splits.select((2 * F.col("node")).alias("node"), half.alias("leaves"), "first")
        ).union(splits.select((2 * F.col("node") + 1).alias("node"), (F.col("leaves") - half).alias("leaves"), (F.col("first") + half).alias("first")))
    return points, facts.select("node", F.col("first").cast("int").alias("shard")) if most is None else _numbered(facts)


def _evened(cuts: DataFrame) -> DataFrame:
    """Cuts moved behind their own key where that makes the larger side smaller, or where nothing lies below them.  So what is beside
    a heavy point halves with each level, and a node of several keys is always cut."""
    behind = F.greatest(F.col("below") + F.col("at"), F.col("w") - F.col("below") - F.col("at"))
    before = F.greatest(F.col("below"), F.col("w") - F.col("below"))
    last = F.col("below") + F.col("at") == F.col("w")
    return cuts.withColumn("cut", F.when(~last & ((F.col("below") == 0) | (behind < before)), F.col("cut") + 1).otherwise(F.col("cut")))


def _numbered(leaves: DataFrame) -> DataFrame:
    """``node, shard``: leaves from left to right, from 0, by stretches of the tree."""
    path = F.expr(f"shiftleft(node - shiftleft(1L, length(bin(node)) - 1), {MAX_DEPTH} - (length(bin(node)) - 1))")
    placed = leaves.select("node", path.alias("path"), F.shiftright(path, MAX_DEPTH - STRETCH_BITS).alias("stretch"))
    sizes = placed.groupBy("stretch").agg(F.count("*").alias("m"))  # at most 2 ** STRETCH_BITS rows
    before = sizes.select("stretch", (F.sum("m").over(Window.orderBy("stretch")) - F.col("m")).alias("first"))
    at = F.row_number().over(Window.partitionBy("stretch").orderBy("path")) - 1
    return placed.withColumn("at", at).join(before, "stretch").select("node", (F.col("first") + F.col("at")).cast("int").alias("shard"))


def kd_shards(
    docs: DataFrame, shards: int | None = None, target_bytes: int | None = None, dimensions: tuple[str, ...] = ("lang", "source"),
    id_column: str = "doc_id", text_column: str = "text", max_bytes: int | None = None,
) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` for every row.

    Give the number of shards, or the bytes a shard should have (then there are just as many as that takes on
    average), or those it may have at most (then nodes are split until each holds no more, or a single text or piece of one).  ``size`` is the text's bytes plus one (NULL counts as no text), ``slot`` numbers the rows of a
    shard from 0 without gaps, ``grown_shard`` is NULL (shards of this law move when their number changes).  NULL names are a
    value of their own; repeated rows each get a slot; an empty table gives an empty result.  With fewer texts than
    shards some shards stay empty.  Other columns are ignored."""
    rows = stored(_narrow(docs, id_column, text_column, list(dimensions)), "narrow")
    if shards is None:
        shards = max(1, -(-(rows.agg(F.sum(F.col("size") * F.col("n"))).first()[0] or 0) // (target_bytes or max_bytes)))
    elif target_bytes or max_bytes:
        raise ValueError("give one of shards, target_bytes and max_bytes")
    dims = 1 + len(dimensions)
    rows, points = _points(rows, shards, dims)
    points, leaves = _tree(points, shards, dims, max_bytes)
    salt = F.explode(F.sequence(F.lit(0), F.col("salts") - 1))
    points = points.join(leaves, "node").select("h", "piece", "shard", salt.alias("salt"))
    placed = rows.join(points, ["h", "piece", "salt"])
    return _slots(stored(placed.select("id", "size", "crc", "n", "shard"), "placed")).select(
        F.col("id").alias(id_column), "size", F.col("crc").alias("text_crc32"), F.lit(LAW).alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def _slots(placed: DataFrame) -> DataFrame:
    """A row for each of the ``n``, numbered within its shard.  Runs of at most ``RUN_ROWS`` equal rows are dealt
    out over parts of about ``SLOT_ROWS`` rows at most."""
    largest = placed.groupBy("shard").agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0] or 0
    parts = max(8, 2 * largest // SLOT_ROWS)
    numbers, share = _dealt("n", F.ceil(F.col("n") / RUN_ROWS))
    rows = placed.withColumn("j", numbers).withColumn("n", share)
    rows = rows.withColumn("part", F.pmod(F.xxhash64("id", "crc", "size", "j"), F.lit(parts)).cast("int")).drop("j")
    # At most shards * parts rows.
    sizes = rows.groupBy("shard", "part").agg(F.sum("n").alias("m"))
    before = sizes.withColumn("first", F.sum("m").over(Window.partitionBy("shard").orderBy("part")) - F.col("m")).drop("m")
    order = Window.partitionBy("shard", "part").orderBy("id", "crc", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("at", F.sum("n").over(order) - F.col("n")).join(before, ["shard", "part"])
    start = F.col("first") + F.col("at")
    return rows.withColumn("slot", F.explode(F.sequence(start, start + F.col("n") - 1)))
