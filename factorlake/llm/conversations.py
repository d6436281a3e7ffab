"""Chat formatting: cumulative snapshots are collapsed, then conversations are rendered. DataFrame operations only.

A log often holds a conversation several times, each time with more turns. Each turn gets the hash of all turns up to it
(position, role and text of each; four sums of 32-bit parts of md5, so a prefix's hash is its last turn's running sums). A
conversation that is the proper prefix of another, or equals one with a smaller conv_id, is a snapshot: anti-joins on the
hash drop it. What stays is rendered, ``template`` around each turn.

Turns of a conversation are ordered by turn, then role, then md5 of the text; exact repeats of a turn count once. Null turns come
first; a null role renders as ``unknown`` and a null text as nothing, and both equal no other value but themselves when
conversations are compared, but null text equals the empty text. Rows of null conv_id make one conversation. Other columns
are not read.

A conversation of any length is handled in blocks of ``block`` turn numbers: blocks are what is shuffled and gathered, and
running sums continue from block to block over one small row each. A block with more than ``HEAVY`` rows for each of its turn
numbers (null or equal turns, as rows of null conv_id may have) is cut further, by turn, role and ranges of the texts' digests,
so no array grows with the rows of a key. Rendering gives one row for each block, numbered by ``part``, so that no
conversation is gathered whole; one with fewer turns is one row. An empty table gives no rows. Empty texts render as nothing;
very long ones stand in a block like others, whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import shared

BLOCK = 512
HEAVY = 4
TEMPLATE = ("<|im_start|>", "\n", "<|im_end|>\n")  # before the role, before the text, after it


def _turns(conversations: DataFrame, block: int, heavy: DataFrame | None, *more: Column) -> DataFrame:
    """(conv_id, part, turn, role, digest, more...); parts are structs that sort as their turns do."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    part = F.coalesce(F.floor(F.col("turn") / block), F.lit(-(1 << 62))).cast("long")
    rows = conversations.select("conv_id", part.alias("at"), "turn", "role", F.md5(text).alias("digest"), *[x.alias(f"more{i}") for i, x in enumerate(more)])
    if heavy is None:
        return rows.withColumn("part", F.struct("at"))
    rows = rows.join(heavy, rows["conv_id"].eqNullSafe(heavy["heavy_id"]) & (rows["at"] == heavy["heavy_at"]), "left")
    # Digests are even, so each of their ranges holds about ``block`` rows or fewer; those of a few turns only fewer.
    slice_ = F.floor(F.conv(F.substring("digest", 1, 8), 16, 10).cast("long") * F.col("slices") / float(1 << 32)).cast("long")
    cut = F.col("slices").isNotNull()
    fine = F.struct("at", F.when(cut, F.col("turn")).alias("by_turn"), F.when(cut, F.col("role")).alias("by_role"), F.when(cut, slice_).alias("slice"))
    return rows.withColumn("part", fine).drop("heavy_id", "heavy_at", "slices")


def _heavy(conversations: DataFrame, block: int) -> DataFrame | None:
    """(heavy_id, heavy_at, slices) of the blocks with too many rows for their turn numbers, if any."""
    part = F.coalesce(F.floor(F.col("turn") / block), F.lit(-(1 << 62))).cast("long")
    counted = conversations.groupBy(F.col("conv_id").alias("heavy_id"), part.alias("heavy_at")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > HEAVY * block)
    found = shared.Scratch(conversations.sparkSession).keep(counted.select("heavy_id", "heavy_at", F.ceil(F.col("n") / block).alias("slices")), "heavy")
    return None if found.isEmpty() else found


def _ordered(turns: DataFrame, *more: Column) -> DataFrame:
    """One row for each block of a conversation, its turns in order in ``turns``."""
    return turns.groupBy("conv_id", "part").agg(F.sort_array(F.collect_set(F.struct("turn", "role", *more))).alias("turns"))


def prefix_hashes(conversations: DataFrame, block: int = BLOCK, heavy: DataFrame | None = None) -> DataFrame:
    """(conv_id, position, n_turns, prefix): the hash of each prefix, as an array of four sums. Texts are not shuffled, their digests are."""
    blocks = _ordered(_turns(conversations, block, heavy), F.col("digest")).select("conv_id", "part", "turns", F.size("turns").alias("n"))
    order = Window.partitionBy("conv_id").orderBy("part")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    placed = blocks.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn("n_turns", F.sum("n").over(Window.partitionBy("conv_id")))

    def part(h: Column, k: int) -> Column:
        return F.conv(F.substring(h, 8 * k + 1, 8), 16, 10).cast("long")

    named = F.transform("turns", lambda t, i: F.md5(F.concat_ws(":", (F.col("base") + i).cast("string"), t["digest"], F.coalesce(F.concat(F.lit("r"), t["role"]), F.lit("-")))))
    placed = placed.withColumn("named", named).drop("turns")
    def total(k: int) -> Column:
        return F.aggregate("named", F.lit(0).cast("long"), lambda s, h: s + part(h, k))

    totals = [total(k).alias(f"s{k}") for k in range(4)]
    summed = placed.select("*", *totals)
    bases = [F.coalesce(F.sum(f"s{k}").over(before), F.lit(0)).alias(f"b{k}") for k in range(4)]
    based = summed.select("conv_id", "part", "n_turns", "base", "named", *bases)  # before turns become rows
    each = based.select("conv_id", "part", "n_turns", "base", *(f"b{k}" for k in range(4)), F.posexplode("named").alias("i", "h"))
    inside = Window.partitionBy("conv_id", "part").orderBy("i")
    running = F.array(*[F.col(f"b{k}") + F.sum(part(F.col("h"), k)).over(inside) for k in range(4)])
    return each.select("conv_id", (F.col("base") + F.col("i") + 1).alias("position"), "n_turns", running.alias("prefix"))


def maximal(conversations: DataFrame, block: int = BLOCK, heavy: DataFrame | None = None) -> DataFrame:
    """(conv_id, n_turns, n_copies) of the conversations to keep: not the proper prefix of another, the smallest conv_id of equal ones."""
    prefixes = prefix_hashes(conversations, block, heavy)
    key = [F.col("prefix")[k].alias(f"p{k}") for k in range(4)]
    whole = prefixes.filter("position = n_turns").select("conv_id", F.col("n_turns").alias("position"), *key)
    on = ["position", "p0", "p1", "p2", "p3"]
    # Equal conversations and equal prefixes collapse before the shuffle, so no key is hot in the join.
    unique = whole.groupBy(*on).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_copies"))
    inner = prefixes.filter("position < n_turns").select("position", *key).distinct()
    return unique.join(inner, on, "left_anti").select("conv_id", F.col("position").alias("n_turns"), "n_copies")


def render(conversations: DataFrame, block: int = BLOCK, template: tuple[str, str, str] = TEMPLATE) -> DataFrame:
    """(conv_id, part, n_turns, n_copies, rendered) of the maximal conversations; part counts blocks from 0, n_turns is the whole conversation's."""
    heavy = _heavy(conversations, block)
    keep = maximal(conversations, block, heavy)
    rows = conversations.select("conv_id", "turn", "role", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.join(keep.select(F.col("conv_id").alias("kept_id"), "n_turns", "n_copies"), F.col("conv_id").eqNullSafe(F.col("kept_id"))).drop("kept_id")
    kept = _turns(rows, block, heavy, F.col("text"), F.col("n_turns"), F.col("n_copies"))
    grouped = kept.groupBy("conv_id", "part").agg(F.sort_array(F.collect_set(F.struct("turn", "role", "digest", F.col("more0").alias("text")))).alias("turns"), F.first("more1").alias("n_turns"), F.first("more2").alias("n_copies"))
    opening, middle, closing = (F.lit(x) for x in template)
    said = F.transform("turns", lambda t: F.concat(opening, F.coalesce(t["role"], F.lit("unknown")), middle, t["text"], closing))
    number = F.row_number().over(Window.partitionBy("conv_id").orderBy("part")) - 1
    return grouped.select("conv_id", "part", "n_turns", "n_copies", F.array_join(said, "").alias("rendered")).select("conv_id", number.cast("long").alias("part"), F.col("n_turns").cast("long").alias("n_turns"), "n_copies", "rendered")
