"""Repair of the structure of conversations at the least cost, by Hirschberg's divide and conquer.

A conversation is well formed if it is empty, or an optional system row followed by one or more pairs of a user and an
assistant row.  While it is written it is in one of four states: nothing yet, behind the system row, behind a user row,
behind an assistant row.  Its rows are kept, given another role, deleted, or joined by inserted rows, each at a cost;
of the cheapest sequences of edits the one whose initials come first in ASCII is taken.

Rows are ordered and cut into blocks of a few hundred.  A block is summed up by 16 figures: for each state before and
behind it the least cost, and the place of its edits among those of the other 15.  No such text of edits is the beginning
of another, so figures of neighbours add up to figures of both: long conversations are summed up in a tree, the states
between blocks are chosen from its root down, and every block is then solved by itself between its two states, by
forward and backward cost vectors that meet in the middle.  So a conversation with a third of all rows is shared out over
all tasks; texts are joined to the finished edits block by block."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyglass.llm.common import prepare, stored

# What edits cost.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
# Blocks are cut where the number of a row passes a multiple of 2^BLOCK_BITS; a node of the tree has up to 2^TREE_BITS children.
BLOCK_BITS = 9
TREE_BITS = 12
# Bytes of one piece of a repaired text.
PIECE_BYTES = 4 << 20

FAR = 1 << 40
STATES = range(4)
# Where a user row, an assistant row and a system row lead from each state; -1: nowhere.
NEXT = {"u": (2, 2, -1, 2), "a": (-1, -1, 3, -1), "s": (1, -1, -1, -1)}
# The row that is inserted in a state, and the rows that end a conversation there.
INSERTED = "uuau"
ENDING = ("", "II", "I", "")
ROLE = {"u": "user", "a": "assistant", "s": "system"}
LEGAL_PAIRS = ("su", "ua", "au")
FAULTS = "-bdt"  # none, blank, duplicate, truncated
INITIALS = "suax"
BLANKS = " \t\n\x0b\f\r"


# --- one block -----------------------------------------------------------------------------


@lru_cache(maxsize=None)
def _moves(code: str) -> tuple[tuple[tuple[int, str, int], ...], ...]:
    """For each state the ways through a row: cost, initials of the inserts before it and of its edit, next state.

    A row is a letter that stands for the initial of its role and its fault."""
    initial, fault = INITIALS[(ord(code) - 65) // 4], FAULTS[(ord(code) - 65) % 4]
    extra = TRUNCATED if fault == "t" else 0
    ways = []
    for state in STATES:
        found, at, lead, paid = [], state, "", 0
        for _ in range(3):  # more than two inserts come back to a state passed before
            found.append((paid + DELETE, lead + "D", at))
            if fault not in "bd":
                kept = NEXT[initial][at] if initial in NEXT else -1
                if kept >= 0:
                    found.append((paid + extra, lead + "K", kept))
                found += [(paid + extra + REROLE, lead + "R", NEXT[r][at]) for r in "ua" if NEXT[r][at] >= 0]
            at, lead, paid = NEXT[INSERTED[at]][at], lead + "I", paid + INSERT
        ways.append(tuple(found))
    return tuple(ways)


def _forward(codes: str, cost: list[int]) -> list[int]:
    for code in codes:
        out = [FAR] * 4
        for state, ways in enumerate(_moves(code)):
            base = cost[state]
            for paid, _, then in ways:
                if base + paid < out[then]:
                    out[then] = base + paid
        cost = out
    return cost


def _backward(codes: str, cost: list[int], rank: list[int], mark: list | None = None) -> tuple[list[int], list[int], list]:
    """Least costs from each state in front of ``codes`` to its end, whose states cost ``cost``; ranks of the texts of
    edits (``rank``: those of what follows); and the mark of the state that each of them ends in."""
    mark = list(STATES) if mark is None else mark
    for code in reversed(codes):
        best = []
        for ways in _moves(code):
            best.append(min(((paid + cost[then], lead, rank[then], then) for paid, lead, then in ways)))
        keys = [b[1:3] for b in best]
        order = {k: i for i, k in enumerate(sorted(set(keys)))}
        cost, rank, mark = [min(b[0], FAR) for b in best], [order[k] for k in keys], [mark[b[3]] for b in best]
    return cost, rank, mark


def _only(state: int) -> list[int]:
    return [0 if s == state else FAR for s in STATES]


def _row(code: str, start: int, end: int) -> str:
    return min((paid, lead) for paid, lead, then in _moves(code)[start] if then == end)[1]


def solve(codes: str, start: int, end: int) -> list[str]:
    """The edits of each row on the cheapest way from one state to the other, of several the first in ASCII.

    Forward costs of the first half and backward costs of the second meet in the middle.  Where several states are as
    cheap there, the first half is passed backward too, with the second half's costs and ranks behind it, and the
    state that the first text of edits passes is taken."""
    out: list[str] = []
    open_ = [(0, len(codes), start, end)]
    while open_:
        lo, hi, s, e = open_.pop()
        if hi - lo == 1:
            out.append(_row(codes[lo], s, e))
            continue
        if hi == lo:
            continue
        middle = (lo + hi) // 2
        ahead = _forward(codes[lo:middle], _only(s))
        cost, rank, _ = _backward(codes[middle:hi], _only(e), [0] * 4)
        total = [a + b for a, b in zip(ahead, cost)]
        crossings = [x for x in STATES if total[x] == min(total)]
        crossing = crossings[0]
        if len(crossings) > 1:
            crossing = _backward(codes[lo:middle], cost, rank)[2][s]
        open_ += [(middle, hi, crossing, e), (lo, middle, s, crossing)]
    return out


def summary(codes: str) -> tuple[list[int], list[int]]:
    """Costs and ranks of a block for its 16 pairs of states, (before, behind) in order."""
    costs, texts = [FAR] * 16, [""] * 16
    for end in STATES:
        cost, _, _ = _backward(codes, _only(end), [0] * 4)
        for start in STATES:
            costs[4 * start + end] = cost[start]
            if cost[start] < FAR:
                texts[4 * start + end] = "".join(solve(codes, start, end))
    order = {t: i for i, t in enumerate(sorted(set(texts)))}
    return costs, [order[t] for t in texts]


# --- several blocks ------------------------------------------------------------------------


def joined(parts: list[tuple[list[int], list[int]]]) -> tuple[list[int], list[int]]:
    """The summary of blocks that follow one another."""
    costs, ranks = parts[0]
    for more_costs, more_ranks in parts[1:]:
        best = []
        for start in STATES:
            for end in STATES:
                best.append(
                    min((costs[4 * start + x] + more_costs[4 * x + end], ranks[4 * start + x], more_ranks[4 * x + end]) for x in STATES)
                )
        order = {k: i for i, k in enumerate(sorted({b[1:] for b in best}))}
        costs, ranks = [min(b[0], FAR) for b in best], [order[b[1:]] for b in best]
    return costs, ranks


def crossings(parts: list[tuple[list[int], list[int]]], start: int, end: int) -> list[int]:
    """The states behind each of the blocks on the best way from one state to the other."""
    cost, rank, ways = _only(end), [0] * 4, []
    for costs, ranks in reversed(parts):
        best = [min((costs[4 * s + x] + cost[x], ranks[4 * s + x], rank[x], x) for x in STATES) for s in STATES]
        order = {k: i for i, k in enumerate(sorted({b[1:3] for b in best}))}
        cost, rank = [min(b[0], FAR) for b in best], [order[b[1:3]] for b in best]
        ways.append([b[3] for b in best])
    out = []
    for way in reversed(ways):
        start = way[start]
        out.append(start)
    return out


def closing(costs: list[int], ranks: list[int]) -> int:
    """The state behind the last row of a conversation."""
    return min((costs[x] + INSERT * len(ENDING[x]), ranks[x], ENDING[x], x) for x in STATES)[3]


# --- tables --------------------------------------------------------------------------------


_NODE = "key struct<conv: {conv}>, node bigint, costs array<bigint>, ranks array<bigint>"


def _mapped(df: DataFrame, schema: str, work: Callable[[dict], list[dict]]) -> DataFrame:
    """Every row turned into some rows by a small function; ``key`` is passed on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out_schema = None
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                taken, made = [], []
                names = [n for n in part.schema.names if n != "key"]
                for i, row in enumerate(part.select(names).to_pylist()):
                    for new in work(row):
                        taken.append(i)
                        made.append(new)
                key = part.column("key").take(pa.array(taken, pa.int32()))
                if not made:
                    continue
                body = {n: [m[n] for m in made] for n in made[0]}
                out_schema = out_schema or {n: _ARROW[n] for n in body}
                yield pa.RecordBatch.from_arrays(
                    [key, *[pa.array(v, out_schema[n]) for n, v in body.items()]], names=["key", *body]
                )

    return df.mapInArrow(run, schema)


_EDIT = pa.struct([("edits", pa.string()), ("state", pa.int32()), ("piece", pa.int32())])
_ARROW = {
    "node": pa.int64(),
    "first": pa.int64(),
    "costs": pa.list_(pa.int64()),
    "ranks": pa.list_(pa.int64()),
    "entry": pa.int32(),
    "exit": pa.int32(),
    "cost": pa.int64(),
    "audit": pa.string(),
    "illegal": pa.int64(),
    "head": pa.string(),
    "tail": pa.string(),
    "rows": pa.list_(_EDIT),
}


def _summed(row: dict) -> list[dict]:
    costs, ranks = summary(row["codes"])
    return [{"node": row["node"], "costs": costs, "ranks": ranks}]


def _parts(row: dict) -> list[tuple[list[int], list[int]]]:
    return [(c["costs"], c["ranks"]) for c in row["children"]]


def _combined(row: dict) -> list[dict]:
    costs, ranks = joined(_parts(row))
    return [{"node": row["node"], "costs": costs, "ranks": ranks}]


def _divided(row: dict) -> list[dict]:
    behind = crossings(_parts(row), row["entry"], row["exit"])
    before = [row["entry"], *behind[:-1]]
    return [{"node": c["node"], "entry": s, "exit": e} for c, s, e in zip(row["children"], before, behind)]


def _edited(row: dict) -> list[dict]:
    """The edits of a block.  A block without states of its own is a whole conversation."""
    codes, start, end = row["codes"], row["entry"], row["exit"]
    last = row["last"]
    if start is None:
        start, last = 0, True
        cost, rank = [INSERT * len(t) for t in ENDING], [sorted(set(ENDING)).index(t) for t in ENDING]
        end = _backward(codes, cost, rank)[2][0]
    edits = solve(codes, start, end)
    cost = sum(_price(code, edit) for code, edit in zip(codes, edits))
    rows, state, size = [], start, 0
    for code, edit, n_bytes in zip(codes, edits, row["sizes"]):
        rows.append({"edits": edit, "state": state, "piece": size // PIECE_BYTES})
        size += n_bytes
        state = next(then for _, lead, then in _ways(code, state) if lead == edit)
    if last:
        rows[-1]["edits"] += ENDING[end]
        cost += INSERT * len(ENDING[end])
    letters = [INITIALS[(ord(c) - 65) // 4] for c in codes]
    illegal = sum(a + b not in LEGAL_PAIRS for a, b in zip(letters, letters[1:]))
    return [
        {
            "node": row["node"], "first": row["first"], "audit": "".join(r["edits"] for r in rows), "cost": cost,
            "illegal": illegal, "head": letters[0], "tail": letters[-1], "rows": rows,
        }
    ]


def _ways(code: str, state: int) -> list[tuple[int, str, int]]:
    """The ways through a row, cheapest first: an insert and a new role leave one next state for each text of edits."""
    return sorted(_moves(code)[state])


def _price(code: str, edit: str) -> int:
    kind = edit[-1]
    truncated = TRUNCATED if FAULTS[(ord(code) - 65) % 4] == "t" and kind != "D" else 0
    return INSERT * (len(edit) - 1) + {"K": 0, "R": REROLE, "D": DELETE}[kind] + truncated


def _ordered(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """Rows of a conversation one after another, by turn (NULL first), then role and text, with a number (``at``) that
    rises through all partitions.  Repeated rows are told apart by their place in the input, so no run of equal rows
    has to lie in one partition."""
    column = lambda c: F.coalesce(F.col(f"`{c}`"), F.lit(" "))
    bare = rows.select(
        F.struct(F.col(f"`{conv}`").alias("conv")).alias("key"),
        F.col(f"`{turn}`").alias("turn"),
        column(role).alias("role"),
        column(text).alias("text"),
        F.monotonically_increasing_id().alias("place"),
    ).withColumn("h", F.sha2(F.concat_ws(":", F.char_length("role").cast("string"), "role", "text"), 256))
    visible = F.right(F.rtrim("text", F.lit(BLANKS)), F.lit(1))
    order = ["key", "turn", "role", "h", "place"]
    laid = bare.repartitionByRange(*order).sortWithinPartitions(*order)
    return laid.select(
        "key",
        "turn",
        "role",
        "text",
        "h",
        F.monotonically_increasing_id().alias("at"),
        F.octet_length("text").alias("n_bytes"),
        visible.alias("visible"),
        F.substring("role", 1, 1).alias("initial"),
    )


def _with_faults(ordered: DataFrame) -> DataFrame:
    """The first fault of every row.  The first rows of each role and text are found by a sum that merges map-side and
    joined by row number, so a text that fills a conversation is no heavy key."""
    narrow = ordered.select("key", "turn", "h", "at", "n_bytes", "visible", "initial")
    firsts = narrow.where("visible <> ''").groupBy("key", "h").agg(F.min("at").alias("at")).select("at", F.lit(True).alias("is_first"))
    marked = narrow.join(firsts, "at", "left")
    fault = (
        F.when(F.col("visible") == "", "b")
        .when(F.col("is_first").isNull(), "d")
        .when(~F.col("visible").isin(".", "!", "?"), "t")
        .otherwise("-")
    )
    return marked.select("key", "turn", "at", "n_bytes", "initial", fault.alias("fault"))


def _blocks(marked: DataFrame) -> DataFrame:
    initial = F.when(F.col("initial") == "s", 0).when(F.col("initial") == "u", 1).when(F.col("initial") == "a", 2).otherwise(3)
    fault = F.expr(f"locate(fault, '{FAULTS}') - 1")
    coded = marked.select(
        "key",
        F.shiftright("at", BLOCK_BITS).alias("node"),
        F.struct("at", F.char(F.lit(65) + initial * 4 + fault).alias("code"), "n_bytes").alias("row"),
    )
    cut = coded.groupBy("key", "node").agg(F.array_sort(F.collect_list("row")).alias("r"))
    return cut.select(
        "key", "node", F.expr("r[0].at").alias("first"), F.array_join("r.code", "").alias("codes"), F.col("r.n_bytes").alias("sizes")
    )


def _assigned(blocks: DataFrame, conv_type: str) -> DataFrame:
    """Blocks with the states before and behind them (``entry``, ``exit``) and whether they are the last; all NULL for
    blocks that are a conversation by themselves."""
    counted = blocks.groupBy("key").agg(F.count("*").alias("n"), F.max("node").alias("final"))
    several = counted.where("n > 1")
    alone = blocks.select("*", *[F.lit(None).cast(t).alias(n) for n, t in (("entry", "int"), ("exit", "int"), ("last", "boolean"))])
    if several.isEmpty():
        return alone
    several = stored(several, "several")
    schema = _NODE.format(conv=conv_type)
    leaves = blocks.join(several.select("key"), "key", "left_semi")
    levels = [stored(_mapped(leaves.select("key", "node", "codes"), schema, _summed), "nodes")]
    shift = BLOCK_BITS
    while shift < 63:
        shift += TREE_BITS
        up = levels[-1].select("key", F.shiftright("node", TREE_BITS).alias("node"), F.struct("node", "costs", "ranks").alias("child"))
        grouped = up.groupBy("key", "node").agg(F.array_sort(F.collect_list("child")).alias("children"))
        levels.append(stored(_mapped(grouped, schema, _combined), "nodes"))
        if levels[-1].groupBy("key").count().where("count > 1").isEmpty():
            break
    down = _mapped(
        levels[-1].select("key", "node", "costs", "ranks"),
        f"key struct<conv: {conv_type}>, node bigint, entry int, exit int",
        lambda r: [{"node": r["node"], "entry": 0, "exit": closing(r["costs"][:4], r["ranks"][:4])}],
    )
    for level in reversed(levels[:-1]):
        children = level.select("key", F.shiftright("node", TREE_BITS).alias("node"), F.struct("node", "costs", "ranks").alias("child"))
        grouped = children.groupBy("key", "node").agg(F.array_sort(F.collect_list("child")).alias("children"))
        split = grouped.join(down, ["key", "node"])
        down = stored(_mapped(split, f"key struct<conv: {conv_type}>, node bigint, entry int, exit int", _divided), "states")
    ends = several.select("key", "final")
    inside = blocks.join(down, ["key", "node"]).join(ends, "key").select(*blocks.columns, "entry", "exit", (F.col("node") == F.col("final")).alias("last"))
    return alone.join(several.select("key"), "key", "left_anti").unionByName(inside)


class Repair:
    """What ``repair`` finds: ``report``, a row for each conversation, and ``rows``, the repaired conversations."""

    def __init__(self, report: DataFrame, rows: DataFrame):
        self.report, self.rows = report, rows


def repair(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> Repair:
    """Faults of conversations, and the cheapest edits that make them well formed.

    ``report``: ``conv`` (of any type; NULL is a conversation too), ``gaps`` (turns missing between the smallest and the
    largest; 0 if all are NULL), ``blank``, ``duplicate`` and ``truncated`` (rows by their first fault), ``illegal``
    (neighbours whose roles do not follow each other), ``cost`` and ``audit`` (initials of the edits: Keep, Rerole, Delete,
    Insert).  ``rows``: ``conv``, ``at`` and ``part`` (the order within a conversation), ``piece`` (a stretch of a few MB),
    ``role`` and ``text``.

    Rows come by turn, NULL first; rows of one turn by role and text, since nothing else tells them apart.  A NULL role
    or text is one space, so a NULL text is blank; repeated rows are duplicates; roles other than user, assistant and system
    are never kept as they are, unless they begin with the same letter, which is all that counts.  An empty table has no
    conversation.  Other columns play no part.  A conversation's audit is one value, so it has to fit a cell."""
    prepare(rows.sparkSession)
    conv_type = rows.schema[conv].dataType.simpleString()
    ordered = stored(_ordered(rows, conv, turn, role, text), "ordered")
    marked = stored(_with_faults(ordered), "faults")
    blocks = stored(_blocks(marked), "blocks")
    schema = (
        f"key struct<conv: {conv_type}>, node bigint, first bigint, audit string, cost bigint, illegal bigint, head string, "
        "tail string, rows array<struct<edits: string, state: int, piece: int>>"
    )
    edited = stored(_mapped(_assigned(blocks, conv_type), schema, _edited), "edits")
    return Repair(_report(marked, edited).withColumnRenamed("conv", conv), _repaired(ordered, edited).withColumnRenamed("conv", conv))


def _report(marked: DataFrame, edited: DataFrame) -> DataFrame:
    turns = marked.groupBy("key", "turn").agg(*[F.count_if(F.col("fault") == f).alias(f) for f in "bdt"])
    counts = turns.groupBy("key").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("bigint").alias("gaps"),
        F.sum("b").alias("blank"),
        F.sum("d").alias("duplicate"),
        F.sum("t").alias("truncated"),
    )
    # A block is one row here, so even the longest conversation brings few.
    whole = edited.groupBy("key").agg(
        F.array_sort(F.collect_list(F.struct("node", "audit", "head", "tail"))).alias("b"),
        F.sum("cost").alias("cost"),
        F.sum("illegal").alias("illegal"),
    )
    pairs = "zip_with(slice(b.tail, 1, size(b) - 1), slice(b.head, 2, size(b) - 1), (x, y) -> concat(x, y))"
    legal = ", ".join(f"'{p}'" for p in LEGAL_PAIRS)
    between = F.expr(f"CASE WHEN size(b) > 1 THEN size(filter({pairs}, p -> p NOT IN ({legal}))) ELSE 0 END")
    return counts.join(whole, "key").select(
        "key.conv", "gaps", "blank", "duplicate", "truncated", (F.col("illegal") + between).cast("bigint").alias("illegal"), "cost",
        F.array_join("b.audit", "").alias("audit"),
    )


def _repaired(ordered: DataFrame, edited: DataFrame) -> DataFrame:
    """The rows of repaired conversations.  Texts meet their block's edits: at most 2^BLOCK_BITS rows have one key."""
    keyed = ordered.select("key", F.shiftright("at", BLOCK_BITS).alias("node"), "at", "role", "text")
    met = keyed.join(edited.select("key", "node", "first", "rows"), ["key", "node"])
    met = met.select("key", "at", "role", "text", F.expr("rows[CAST(at - first AS INT)]").alias("e"))
    met = met.where("e.edits <> 'D'").select("key", "at", "role", "text", "e.*")
    # The state a row is inserted in tells its role: user, then the two take turns.
    step = (
        "aggregate(sequence(1, length(edits)), named_struct('s', state, 'out', CAST(array() AS array<struct<part: int, role: string, text: string>>)), "
        "(acc, i) -> CASE substring(edits, i, 1) "
        "WHEN 'D' THEN acc "
        "WHEN 'K' THEN named_struct('s', CASE substring(role, 1, 1) WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END, "
        "'out', concat(acc.out, array(named_struct('part', i, 'role', role, 'text', text)))) "
        "ELSE named_struct('s', IF(acc.s = 2, 3, 2), 'out', concat(acc.out, array(named_struct('part', i, "
        "'role', IF(acc.s = 2, 'assistant', 'user'), 'text', IF(substring(edits, i, 1) = 'I', '', text))))) END)"
    )
    made = met.select("key", "at", "piece", F.explode(F.expr(step)["out"]).alias("r"))
    return made.select("key.conv", "at", "piece", "r.part", "r.role", "r.text")


def digests(rows: DataFrame, conv: str = "conv_id") -> DataFrame:
    """SHA-256 of each repaired conversation as ``role:text`` lines.

    Lines are put together in pieces of a few MB; a conversation of one piece is hashed where it is, pieces of longer ones are
    hashed one after another by one task, which holds one piece at a time: a digest is a chain."""
    lines = rows.select(
        F.struct(F.col(conv).alias("conv")).alias("key"),
        F.shiftright("at", BLOCK_BITS).alias("node"),
        "piece",
        F.struct("at", "part", F.concat("role", F.lit(":"), "text").alias("line")).alias("line"),
    )
    pieces = stored(
        lines.groupBy("key", "node", "piece").agg(F.array_sort(F.collect_list("line")).alias("l")).select(
            "key", F.expr("l[0].at").alias("at"), F.array_join("l.line", "\n").alias("body")
        ),
        "pieces",
    )
    several = stored(pieces.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "several")
    single = pieces.join(several, "key", "left_anti").select("key", F.sha2("body", 256).alias("sha"))
    chained = pieces.join(several, "key", "left_semi").repartition("key").sortWithinPartitions("key", "at")

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            keys, bodies = batch.column(0), batch.column(1)
            for i in range(batch.num_rows):
                key = keys.slice(i, 1)
                if now is None or not now.equals(key):
                    if now is not None:
                        yield pa.RecordBatch.from_arrays([now, pa.array([state.hexdigest()])], names=["key", "sha"])
                    now, state = key, hashlib.sha256()
                else:
                    state.update(b"\n")
                state.update(bodies[i].as_py().encode())
        if now is not None:
            yield pa.RecordBatch.from_arrays([now, pa.array([state.hexdigest()])], names=["key", "sha"])

    conv_type = rows.schema[conv].dataType.simpleString()
    long = chained.select("key", "body").mapInArrow(chain, f"key struct<conv: {conv_type}>, sha string")
    return single.unionByName(long).select(F.col("key.conv").alias(conv), F.col("sha").alias("repaired_sha256"))


def damaged(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` with faults that a hash of conversation and turn plants: of 20 rows one goes, one
    loses its text, one its sentence ends, one is repeated and one becomes the user's."""
    text = F.coalesce("text", F.lit(" "))
    role = F.coalesce("role", F.lit(" "))
    name = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    hit = F.crc32(name) % 20
    bare = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), hit.alias("hit")).where("hit <> 0")
    copies = F.explode(F.when(F.col("hit") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return bare.select(
        "conv_id",
        "turn",
        F.when(F.col("hit") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("hit") == 1, "").when(F.col("hit") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        copies.alias("copy"),
    ).drop("copy")
